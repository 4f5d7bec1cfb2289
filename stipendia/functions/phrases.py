"""Phrases that name the intent of a question."""

# Priority intents, the first one with a phrase in the question decides.
PRIORITY_INTENTS = {
    "greeting": ["hi", "hello", "hey", "vanakkam", "good morning", "good afternoon", "good evening", "welcome", "start"],
    "i_am_student": ["i am student", "i am a student", "student here"],
    "bot_identity": ["your name", "what are you", "who are you", "what is your name", "are you a bot", "are you ai",
        "are you robot", "tell me about yourself", "introduce yourself", "who made you", "who built you"],
    "quota_7_5": ["7.5% quota", "7.5 percent quota", "7.5% government school quota", "7.5% govt school quota",
        "government school quota", "govt school quota", "7.5 quota", "7.5% reservation", "7.5 percent reservation",
        "what is 7.5% quota", "what is 7.5 quota", "am i eligible for 7.5% quota",
        "am i eligible for 7.5% government school quota", "eligible for 7.5% government school quota",
        "eligible for 7.5% quota", "eligible for 7.5"],
    "scholarship_purpose": ["why apply scholarship", "why should i apply for scholarship", "why do i need scholarship",
        "why do i need to apply for scholarship", "why i need to apply scholarship", "what is the purpose of scholarship",
        "purpose of scholarship", "purpose of scholarships", "why scholarships are important",
        "why scholarship is important", "benefits of applying for scholarship", "why should students apply for scholarships",
        "what are the benefits of scholarships", "benefits of scholarship", "benefits of scholarships",
        "importance of scholarship", "importance of scholarships", "why scholarship", "why apply for scholarship"],
    "how_it_works": ["how do you work", "how you work", "how does this work", "how does it work", "how this works",
        "api key", "based on", "offline", "online", "internet", "technology"],
    "off_topic": ["time now", "weather", "news", "cricket", "movie", "film", "song", "joke", "porn", "sex", "politics",
        "stock", "bitcoin", "game"],
}

# The other intents, the largest sum of phrase lengths decides.
SCORED_INTENTS = {
    "dbt_what": ["what is dbt", "dbt mean", "direct benefit transfer", "explain dbt"],
    "dbt_activate": ["activate dbt", "enable dbt", "how to dbt", "dbt enable", "npci mapping", "dbt bank", "bank dbt",
        "dbt active", "dbt not working", "dbt failed", "npci", "how do i enable dbt", "how to enable dbt"],
    "dbt_check": ["check dbt", "dbt status", "my dbt", "verify dbt", "dbt linked or not",
        "i don't know whether my bank is dbt enabled", "check whether dbt enabled", "is dbt enabled in my bank",
        "check dbt enabled", "how do i check npci mapping", "check npci mapping", "check npci", "npci mapping"],
    "dbt_difference": ["difference between linked", "difference between linked and seeded",
        "difference between linked seeded", "linked vs seeded", "seeded vs dbt", "aadhaar linked seeded",
        "linked and seeded", "linked or seeded", "is dbt enabled", "my aadhaar is linked to my bank. is dbt enabled",
        "my bank account is aadhaar seeded", "aadhaar seeded can i receive scholarship",
        "can i receive scholarship with seeded", "what is aadhaar seeding", "aadhaar seeding meaning",
        "explain aadhaar seeding", "aadhaar seeding"],
    "dbt_issues": ["dbt problem", "dbt issue", "dbt not received", "money not received", "payment failed dbt",
        "dbt common issue"],
    "bank_link": ["bank not linked", "bank account link", "link bank aadhaar", "bank for scholarship", "account not linked",
        "how do i link aadhaar with my bank account", "link aadhaar with my bank account", "link aadhaar to bank"],
    "aadhaar_mismatch": ["name mismatch", "dob mismatch", "aadhaar mismatch", "aadhaar correction", "wrong name aadhaar",
        "update aadhaar", "aadhaar name change", "mismatch aadhaar", "my name is different in aadhaar and 10th marksheet",
        "name is different in aadhaar", "why should my name match across documents",
        "what happens if my aadhaar name and marksheet name are different", "name are different", "name is different",
        "name different in marksheet", "aadhaar name and marksheet", "name match across documents"],
    "rejection": ["why rejected", "rejection reason", "application rejected", "scholarship rejected", "not approved",
        "failed application"],
    "deadline": ["deadline", "last date", "closing date", "when to apply", "scheme closing", "scheme closing date",
        "scholarship deadline"],
    "documents": ["documents needed", "document", "certificates needed", "required documents", "what to upload",
        "which documents", "certificate list", "documents required", "what documents do i need for scholarship",
        "what documents are required to apply"],
    "apply": ["how to apply", "how do i apply", "how can i apply", "apply online", "how to register", "where to apply",
        "application process", "step by step"],
    "eligibility": ["am i eligible", "check eligibility", "which scholarship for me", "scholarship for me",
        "which scheme for me", "can i apply", "eligible for scholarship", "qualify for scholarship", "eligible",
        "scholarships are available", "scholarships available"],
    "scan_tips": ["scan document", "how to scan", "document size", "upload size", "file size"],
    "portal_nsp": ["nsp portal", "scholarships.gov", "portal nsp"],
    "portal_umis": ["umis portal", "umis.tn", "portal umis"],
    "renewal": ["renew scholarship", "how to renew", "renewal process", "second year scholarship", "renewal application",
        "renew"],
    "income_expired": ["expired income certificate", "income certificate expired", "income validity",
        "old income certificate", "old date", "income certificate has an old date", "income certificate old"],
    "income_cert": ["income certificate", "get income certificate", "income proof", "family income certificate",
        "what income certificate is required"],
    "community_cert": ["community certificate", "caste certificate", "get community certificate",
        "what community certificate is required"],
    "verify_cert": ["verify whether my certificate is genuine", "verify certificate", "genuine certificate",
        "is my certificate genuine", "check certificate genuine", "can you verify whether my certificate"],
    "dual_scholarship": ["both nsp and tamil nadu", "both nsp and state", "can i get both nsp and tamil nadu scholarship",
        "two scholarships at the same time", "can i apply for two scholarships", "multiple scholarships"],
    "which_scholarship_first": ["which scholarship should i apply for first", "which scholarship to apply first",
        "which scheme first"],
    "scholarship_list": ["list of scholarships", "all scholarships", "available scholarships", "what scholarships",
        "types of scholarship", "scholarship schemes"],
    "amount": ["how much money", "scholarship amount", "how much scholarship", "payment amount", "scholarship money"],
    "status": ["application status", "check status", "track application", "scholarship status"],
    "readiness": ["am i ready", "ready to apply", "check readiness", "before applying", "checklist",
        "what should i do before applying"],
    "help": ["help", "what can you do", "guide me", "what do you know", "features"],
}
