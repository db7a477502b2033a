import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])

ODD = [None, "", "   \n", "!!! 123", "word", "two words", "a" * 5000, "same text here now yes", "same text here now yes", "漢字 é 😀 ñandú", "x\ty\x0bz"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null keys, texts, languages and sources; empty, short and long texts; equal texts; a repeated row; a column with a clashing name."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None) for i, t in enumerate(ODD)]
    rows += [(None, "a row without a key", "en", "src1", 3), rows[7]]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS score", "'clash' AS shard", "7 AS n_tokens", "'clash' AS component_id", "'clash' AS domain")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
