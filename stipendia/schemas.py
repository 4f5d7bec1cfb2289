"""Entity schemas, stated once and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, MONEY = T.TimestampNTZType(), T.DecimalType(18, 2)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


APPLICATION = struct(
    application_id=S, student_id=S, college_id=S, scheme_id=S, academic_year=S, application_status=S, document_status=S,
    eligibility_status=S, lifecycle_stage=S, reviewer_id=S, route=S, open_deficiencies=L, external_status=S,
    submitted_at=TS, college_verified_at=TS, scrutinized_at=TS, selected_at=TS, sanctioned_at=TS, paid_at=TS,
    duplicate_matches=T.ArrayType(struct(application_id=S, student_id=S, match_reason=S, matched_at=TS)))
STUDENT = struct(student_id=S, register_number=S, full_name=S, date_of_birth=S, gender=S, category=S, state=S, district=S,
                 college_id=S, course=S, department=S, study_year=S, email=S, family_income=T.DecimalType(14, 2),
                 account_status=S)
COLLEGE = struct(college_id=S, college_name=S, district=S, state=S, status=S)
SCHEME = struct(scheme_id=S, scheme_name=S, scheme_type=S, target_category=T.ArrayType(S), academic_levels=T.ArrayType(S),
                max_income=T.DecimalType(14, 2))
SCHEME_RULE = struct(
    scheme_id=S, rule_version=S,
    eligibility=struct(max_income=T.DecimalType(14, 2), min_marks=D, categories=T.ArrayType(S)),
    deadlines=struct(application=TS, college_verification=TS, ministry_scrutiny=TS),
    continuation=struct(min_attendance=D, min_marks=D), budget=struct(allocated=MONEY, utilized=MONEY),
    effective_from=T.DateType(), effective_to=T.DateType())
PAYMENT = struct(payment_id=S, application_id=S, student_id=S, college_id=S, scheme_id=S, academic_year=S, instalment=I,
                 sanctioned=MONEY, paid=MONEY, payment_status=S, payment_reference=S, recipient_type=S, is_partial=B,
                 reversed_at=TS)
VERIFICATION = struct(
    verification_id=S, application_id=S, document_type=S, extracted=T.MapType(S, S), confidence=I, verification_status=S,
    mismatch=B, processed_at=TS)
ELIGIBILITY = struct(result_id=S, application_id=S, result=S, match_score=I, evaluated_at=TS,
                     criteria=T.ArrayType(struct(criterion=S, status=S, required=S, actual=S, reason=S)))
DEFICIENCY = struct(deficiency_id=S, application_id=S, deficiency_type=S, severity=S, status=S, created_at=TS, due_at=TS,
                    resolved_at=TS)
HISTORY = struct(history_id=S, application_id=S, previous_status=S, new_status=S, changed_by=S, changed_by_role=S, source=S,
                 changed_at=TS)
AUDIT = struct(log_id=S, actor_id=S, actor_role=S, action=S, entity_type=S, entity_id=S, old_value=S, new_value=S, at=TS)
REVIEW = struct(review_id=S, application_id=S, reviewer_id=S, reviewer_role=S, decision=S, comments=S, reviewed_at=TS)
NOTIFICATION = struct(notification_id=S, user_id=S, role=S, kind=S, link=S, created_at=TS)
TICKET = struct(ticket_id=S, student_id=S, owner=S, status=S, deadline=TS, opened_at=TS,
                replies=T.ArrayType(struct(author=S, message=S, at=TS)))
BOX = struct(x0=D, y0=D, x1=D, y1=D)
PAGE = struct(doc_id=S, page=I, page_width=D, page_height=D, lines=T.ArrayType(struct(
    text=S, confidence=D, bbox=BOX, words=T.ArrayType(struct(text=S, confidence=D, bbox=BOX)))))

# Labelled document file, as published.
GROUND_TRUTH_FIELDS = ["studentName", "dateOfBirth", "parentName", "community", "category", "annualIncome",
                       "certificateNumber", "registrationNumber", "schoolName", "board", "passingYear", "marks",
                       "percentage", "issueDate", "validity", "issuingAuthority"]
LABELLED_DOCUMENT = struct(
    id=S, image_filename=S, image_path=S, cohort_id=S, document_type=S, degradation=S, is_quarantine_sample=B,
    expected_cross_status=S, ground_truth=struct(**{f: S for f in GROUND_TRUTH_FIELDS}))

ENTITIES = {
    "applications": APPLICATION, "students": STUDENT, "colleges": COLLEGE, "schemes": SCHEME, "rules": SCHEME_RULE,
    "payments": PAYMENT, "verifications": VERIFICATION, "eligibility": ELIGIBILITY, "deficiencies": DEFICIENCY,
    "history": HISTORY, "audit": AUDIT, "reviews": REVIEW, "notifications": NOTIFICATION, "tickets": TICKET, "pages": PAGE,
}
