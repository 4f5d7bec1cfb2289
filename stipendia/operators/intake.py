"""Roster ingest: verdict per row, accepted and rejected parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stipendia.functions.scalars import first_case, is_true, kept, present
from stipendia.operators.frames import count_if, with_key_count


def row_errors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", kept([
        (~present(F.col("register_number")), F.lit("Missing Register Number")),
        (~present(F.col("full_name")), F.lit("Missing Student Name")),
        (~(present(F.col("email")) & is_true(F.contains("email", F.lit("@")))), F.lit("Missing or invalid Email"))]))


def verdicts(rows: DataFrame, register: DataFrame, accounts: DataFrame) -> DataFrame:
    """VALID, DUPLICATE or INVALID with the first applicable reason.

    ``register`` holds (college_id, register_number) in use, ``accounts`` the
    e-mail addresses in use anywhere.  Batch duplicates are counted by an
    aggregate and joined back; rows without a number are not compared.
    """
    numbered = rows.where(present(F.col("register_number")))
    blank = rows.where(~present(F.col("register_number"))).withColumn("copies", F.lit(1).cast("long"))
    counted = with_key_count(numbered, ["college_id", "register_number"], "copies").unionByName(blank)
    used = register.select("college_id", "register_number").distinct().withColumn("_in_register", F.lit(True))
    mails = accounts.select(F.lower("email").alias("_mail")).distinct().withColumn("_has_account", F.lit(True))
    joined = (row_errors(counted).withColumn("_mail", F.lower("email"))
              .join(used, ["college_id", "register_number"], "left").join(mails, "_mail", "left"))
    reason = first_case([
        (F.col("copies") > 1, "Duplicate register number within uploaded file"),
        (is_true(F.col("_in_register")), "Register number already registered in college"),
        (is_true(F.col("_has_account")), "Email already exists in system")], F.lit(None).cast("string"))
    status = first_case([(F.size("errors") > 0, "INVALID"), (reason.isNotNull(), "DUPLICATE")], "VALID")
    return joined.select(*rows.columns, "errors", reason.alias("duplicate_reason"), status.alias("verdict"))


def verdict_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("verdict") == "VALID", "valid"),
        count_if(F.col("verdict") == "DUPLICATE", "duplicate"), count_if(F.col("verdict") == "INVALID", "invalid"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("verdict") == "VALID").drop("errors", "duplicate_reason", "verdict")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("verdict") != "VALID")
