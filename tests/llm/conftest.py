import pytest

from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", None),
            (5, "One short line.", None, "b", 15), (5, "One short line.", None, "b", 15), (None, "no id here", "en", None, 10),
            (6, "é日本語 \x00 text\r\nwith\ttabs 😀", "fr", "b", 9), (7, LONG, "en", "a", None)]
    df = spark.createDataFrame(rows, DOCS)
    extra = "id ids words key kept component_id doc text_ host line packed digest anchor piece length start n_words bucket _words _raw".split()
    return df.selectExpr("*", *[f"'x' AS {name}" for name in extra])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def rows_of_docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
