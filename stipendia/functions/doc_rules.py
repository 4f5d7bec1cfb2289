"""Fixed values for document texts: type rules, titles, states, authorities, boards."""

# Document types in tie-break order with (pattern, weight, reason).
TYPE_RULES = {
    "ms10": [
        (r"\bsslc\b", 6, "SSLC abbreviation"),
        (r"secondary\s+school\s+leaving\s+certificate|secondary\s+school", 8, "Secondary School Leaving Certificate title"),
        (r"\b(10th|tenth|class\s*x|std\s*x|standard\s*x|பத்தாம்\s*வகுப்பு)\b", 6, "10th/Class X standard indicator"),
        (r"board\s+of\s+school\s+examinations|department\s+of\s+government\s+examinations|board\s+of\s+secondary", 4,
         "Board of Examinations"),
        (r"\b(science|social\s+science|mathematics|optional\s+language)\b", 3, "10th core subject names"),
        (r"permanent\s+register\s+no|certificate\s+sl\.?\s*no\.?\s*:\s*sec", 5, "SSLC registration fields"),
        (r"total\s+marks|மொத்த\s+மதிப்பெண்கள்", 3, "Total marks summary"),
    ],
    "ms12": [
        (r"\b(hsc|hss|hr\.?\s*sec)\b", 6, "HSC / HSS / Hr Sec marker"),
        (r"higher\s+secondary(?:\s+course|\s+school|\s+examination|\s+certificate)?", 8,
         "Higher Secondary Certificate title"),
        (r"\b(12th|twelfth|class\s*xii|std\s*xii|standard\s*xii|plus\s*two|\+2|second\s*year|இரண்டாமாண்டு)\b", 6,
         "12th / Plus Two / Second Year standard"),
        (r"board\s+of\s+school\s+examinations|department\s+of\s+government\s+examinations", 4,
         "Board of School Examinations"),
        (r"\b(physics|chemistry|biology|computer\s+science|commerce|accountancy|economics|mathematics)\b", 4,
         "12th elective subject names"),
        (r"permanent\s+register\s+number|certificate\s+sl\.?\s*no\.?\s*:\s*hss|mark\s+certificate|statement\s+of\s+marks", 5,
         "Marksheet registration fields"),
        (r"total\s+marks|மொத்த\s+மதிப்பெண்கள்", 3, "Total marks summary"),
    ],
    "community": [
        (r"community\s+certificate|caste\s+certificate|சாதிச்\s+சான்றிதழ்", 9, "Community/Caste Certificate explicit title"),
        (r"scheduled\s+caste|scheduled\s+tribe|backward\s+class|most\s+backward\s+class|denotified\s+community", 7,
         "Recognized caste category mention"),
        (r"\b(sc|st|mbc|dnc|obc|bc)\b", 4, "Community abbreviation"),
        (r"(?s)belongs\s+to.*community|certified\s+that.*belongs", 6, "Community certification clause"),
        (r"tahsildar|revenue\s+divisional\s+officer|\brdo\b|zonal\s+deputy\s+tahsildar|talati", 3,
         "Revenue issuing authority"),
        (r"\btaluk\b|\bdistrict\b|வட்டம்|மாவட்டம்|\btaluka\b", 2, "Taluk/District administration fields"),
        (r"certificate\s*(?:no|number)|cert\s*no|சான்றிதழ்\s*எண்", 3, "Certificate registration number"),
    ],
    "income": [
        (r"income\s+certificate|வருமானச்\s+சான்றிதழ்", 9, "Income Certificate explicit title"),
        (r"annual\s+income|family\s+income|total\s+annual\s+income|yearly\s+income|குடும்ப\s+ஆண்டு\s+வருமானம்", 7,
         "Annual/Family income statement"),
        (r"(?:rupees|rs\.?|₹|ரூ\.?)\s*[\d,]+(?:\s*(?:per\s+annum|/annum|/year|only))?", 5, "Income amount notation"),
        (r"source\s+of\s+income|wages|salary|business|agriculture|rental", 5, "Income source breakdown table"),
        (r"(?s)this\s+is\s+(?:to\s+)?certify\s+that.*(?:income|family)", 5, "Income certification clause"),
        (r"certificate\s+validity\s+period|validity\s+period|செல்லுபடியாகும்\s+காலம்|valid\s+for\s+(?:three|\d+)\s+years", 5,
         "Income validity period clause"),
        (r"tahsildar|revenue\s+divisional\s+officer|\brdo\b|zonal\s+deputy\s+tahsildar|talati\s+cum\s+mantri", 3,
         "Revenue issuing authority"),
    ],
    "aadhaar": [
        (r"unique\s+identification\s+authority\s+of\s+india|\buidai\b", 10, "UIDAI header"),
        (r"aadhaar", 8, "Aadhaar government header"),
        (r"\b\d{4}\s\d{4}\s\d{4}\b", 8, "12-digit 4-4-4 formatted UID"),
        (r"mera\s+aadhaar,\s+meri\s+pehchan", 6, "Aadhaar slogan"),
    ],
    "bankpass": [
        (r"passbook|account\s+statement", 8, "Passbook title"),
        (r"account\s+(?:number|no)|savings\s+bank|current\s+account", 6, "Account number details"),
        (r"\bifsc\b|\bmicr\b", 7, "IFSC / Banking code"),
        (r"state\s+bank\s+of\s+india|canara\s+bank|indian\s+bank|hdfc|icici|axis\s+bank|bank\s+of\s+baroda"
         r"|punjab\s+national\s+bank", 6, "Major Indian bank name"),
    ],
}
TYPE_THRESHOLD = 6

# Labels of the document types.
TYPE_LABELS = {"marksheet": "Marksheet", "ms10": "10th Marksheet", "ms12": "12th Marksheet",
               "community": "Community / Category Certificate", "income": "Income Certificate",
               "aadhaar": "Aadhaar Card", "bankpass": "Bank Document", "unknown": "Other / Unknown"}
STANDARD_CATEGORY = {"ms10": "marksheet", "ms12": "marksheet", "marksheet": "marksheet", "income": "income",
                     "community": "community", "aadhaar": "aadhaar", "bankpass": "bankpass", "bank": "bankpass"}

# Document titles in order (type, title, weight, patterns).
TITLES = [
    ("ms10", "Secondary School Leaving Certificate (10th)", 95, [
        r"secondary\s*school\s*leaving\s*certificate",
        r"s\.?s\.?l\.?c\.?(?:\s+marksheet|\s+mark\s+certificate|\s+examination)?",
        r"secondary\s*school\s*examination", r"high\s*school\s*certificate\s*examination",
        r"all\s*india\s*secondary\s*school\s*examination", r"matriculation\s*examination",
        r"10th\s*(?:standard|std|class)?\s*(?:mark\s*sheet|marksheet|certificate)",
        r"பத்தாம்\s*வகுப்பு\s*மதிப்பெண்\s*சான்றிதழ்"]),
    ("ms12", "Higher Secondary Mark Sheet (12th)", 95, [
        r"higher\s*secondary(?:\s*course|\s*school|\s*academic)?\s*(?:certificate|examination|mark\s*sheet|statement\s*of\s*marks)",
        r"h\.?s\.?c\.?(?:\s+marksheet|\s+mark\s+certificate|\s+examination)?",
        r"senior\s*school\s*certificate\s*examination", r"all\s*india\s*senior\s*school\s*certificate",
        r"plus\s*two(?:\s*mark\s*sheet|\s*examination)?", r"intermediate\s*examination\s*certificate",
        r"12th\s*(?:standard|std|class)?\s*(?:mark\s*sheet|marksheet|certificate)",
        r"மேல்நிலைப்\s*பள்ளி\s*மதிப்பெண்\s*சான்றிதழ்"]),
    ("community", "Community Certificate", 95, [
        r"community\s*certificate", r"caste\s*certificate", r"scheduled\s*caste\s*certificate",
        r"scheduled\s*tribe\s*certificate", r"backward\s*class\s*certificate", r"சாதிச்\s*சான்றிதழ்|சமூகச்\s*சான்றிதழ்"]),
    ("income", "Income Certificate", 95, [r"income\s*certificate", r"வருமானச்\s*சான்றிதழ்"]),
    ("unknown", "Transfer Certificate", 88, [r"transfer\s*certificate", r"\bt\.?c\.?\s*certificate", r"மாற்றுச்\s*சான்றிதழ்"]),
    ("unknown", "Bonafide Certificate", 88, [
        r"bonafide\s*certificate", r"bonafide\s*student\s*certificate", r"உண்மைச்\s*சான்றிதழ்"]),
    ("aadhaar", "Aadhaar Card", 95, [
        r"unique\s*identification\s*authority\s*of\s*india", r"government\s*of\s*india.*aadhaar",
        r"मेरा\s*आधार,\s*मेरी\s*पहचान"]),
    ("bankpass", "Bank Passbook", 90, [r"bank\s*passbook", r"passbook\b", r"account\s*statement"]),
]
# Weaker anchors (pattern, title), in order.
PARTIAL_TITLES = [
    (r"(?:income|வருமானம்)\b", "Possible Income Certificate"),
    (r"(?:community|caste|சாதி)\b", "Possible Community Certificate"),
    (r"(?:sslc|secondary|10th)\b", "Possible 10th Marksheet"),
    (r"(?:hsc|higher\s*secondary|12th)\b", "Possible 12th Marksheet"),
]
# Repairs of OCR digits in titles.
TITLE_REPAIRS = [
    (r"[|_]+", " "), (r"(?i)\b0([a-z]+)\b", "O$1"), (r"(?i)\b([a-z]+)0\b", "$1O"), (r"(?i)SEC0NDARY", "SECONDARY"),
    (r"(?i)SCH00L", "SCHOOL"), (r"(?i)LEAV1NG", "LEAVING"), (r"(?i)CERT1F1CATE", "CERTIFICATE"),
    (r"(?i)H1GHER", "HIGHER"), (r"(?i)1NC0ME", "INCOME"), (r"(?i)C0MMUN1TY", "COMMUNITY"), (r"\s+", " "),
]

# States and the words that point to them, in order.
STATES = [
    ("Gujarat", ["gujarat", r"devbhumi\s+dwarka", r"talati\s+cum\s+mantri", r"gram\s+panchayat", "jam\\s+khambhali[y|a]"]),
    ("Tamil Nadu", [r"tamil\s*nadu", "தமிழ்நாடு", "chennai", "coimbatore", "madurai", "salem", "thiruchirappalli|trichy",
                    "thottiam", "வட்டம்|மாவட்டம்", "வட்டாட்சியர்"]),
    ("Kerala", ["kerala", "thiruvananthapuram", "kochi", "kozhikode", r"village\s+officer"]),
    ("Karnataka", ["karnataka", "bengaluru|bangalore", "mysuru|mysore", "nadakacheri", r"seva\s+sindhu"]),
    ("Maharashtra", ["maharashtra", "mumbai", "pune", "nagpur", "mahaonline", r"aaple\s+sarkar"]),
    ("Andhra Pradesh", [r"andhra\s+pradesh", "visakhapatnam", "vijayawada", "guntur"]),
    ("Telangana", ["telangana", "hyderabad", "warangal", "meeseva"]),
    ("Uttar Pradesh", [r"uttar\s+pradesh", "lucknow", "kanpur", "varanasi", r"edistrict\.up"]),
    ("Rajasthan", ["rajasthan", "jaipur", "jodhpur", "udaipur"]),
    ("West Bengal", [r"west\s+bengal", "kolkata", "banglarbhumi"]),
    ("Odisha", ["odisha|orissa", "bhubaneswar", "cuttack"]),
    ("Punjab", ["punjab", "chandigarh", "amritsar", "ludhiana"]),
    ("Bihar", ["bihar", "patna", "gaya"]),
    ("Madhya Pradesh", [r"madhya\s+pradesh", "bhopal", "indore"]),
    ("Haryana", ["haryana", "gurugram|gurgaon", "faridabad"]),
    ("Delhi", [r"delhi|nct\s+of\s+delhi"]),
    ("Assam", ["assam", "guwahati"]),
]
# Issuing authorities, in order.
AUTHORITIES = [
    ("Talati Cum Mantri", r"talati\s+cum\s+mantri|talati-cum-mantri|talati"),
    ("Zonal Deputy Tahsildar", r"zonal\s+deputy\s+tahsildar"),
    ("Headquarters Deputy Tahsildar", r"headquarters\s+deputy\s+tahsildar"),
    ("Tahsildar", r"tahsildar|tehsildar|வட்டாட்சியர்"),
    ("Revenue Divisional Officer", r"revenue\s+divisional\s+officer|\brdo\b"),
    ("Village Officer", r"village\s+officer|village\s+administrative\s+officer|\bvao\b"),
    ("District Collector / Magistrate", r"district\s+collector|district\s+magistrate|\bdc\b|\bdm\b"),
    ("Gram Panchayat", r"gram\s+panchayat|grama\s+panchayat"),
    ("Revenue Department", r"revenue\s+department|revenue\s+administration"),
]
# Marksheet layouts, in order (template, board, state, confidence, pattern).
TEMPLATES = [
    ("tn_hsc", "Tamil Nadu Higher Secondary (HSC)", "Tamil Nadu", 0.92,
     r"higher\s*secondary|hsc\b|class\s*(?:xii|12th)\b|department\s+of\s+government\s+examinations.*tamil|மேல்நிலைப்"),
    ("tn_sslc", "Tamil Nadu State Board (SSLC)", "Tamil Nadu", 0.90,
     r"secondary\s*school\s*leaving|sslc\b|class\s*(?:x|10th)\b|matriculation\s*board.*tamil|பத்தாம்"),
    ("cbse", "CBSE", None, 0.95,
     r"central\s*board\s*of\s*secondary|cbse\b|all\s*india\s*senior\s*school|all\s*india\s*secondary"),
    ("icse", "CISCE (ICSE/ISC)", None, 0.95, r"council\s*for\s*the\s*indian\s*school|cisce|icse|isc\b"),
]
# Boards of other states.
STATE_BOARDS = {
    "Gujarat": "Gujarat Secondary and Higher Secondary Education Board (GSEB)",
    "Kerala": "Kerala Board of Public Examinations",
    "Karnataka": "Karnataka School Examination and Assessment Board",
    "Maharashtra": "Maharashtra State Board of Secondary and Higher Secondary Education",
}
# Subjects looked for line by line, longest first.
SUBJECTS = ["COMPUTER SCIENCE", "SOCIAL SCIENCE", "PART II ENGLISH", "PART I TAMIL", "MATHEMATICS", "ACCOUNTANCY",
            "GEOGRAPHY", "CHEMISTRY", "ECONOMICS", "COMMERCE", "PHYSICS", "BIOLOGY", "ENGLISH", "HISTORY", "SCIENCE",
            "ZOOLOGY", "BOTANY", "MATHS", "TAMIL", "HINDI"]
# Banks, in order.
BANKS = ["State Bank of India", "Canara Bank", "Indian Bank", "Indian Overseas Bank", "Bank of Baroda",
         "Punjab National Bank", "Union Bank of India", "HDFC Bank", "ICICI Bank", "Axis Bank", "Kotak Mahindra Bank",
         "Central Bank of India", "UCO Bank", "Bank of India"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
          "December"]
