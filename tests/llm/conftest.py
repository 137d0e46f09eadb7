import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The smallest documents with null, empty, very long, tied and repeated rows, and columns whose names clash with the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long_text = " ".join(f"word{i % 997} Ünïcode{i}" for i in range(20000))
    line = "a passage of plain words that many documents share, and that is long enough to be found. " * 4
    extra = [
        (9001, None, "en", "x", 0),
        (9002, "", None, "x", 0),
        (9003, " \n\t ", "en", None, 3),
        (9004, "two words", "en", "x", 9),
        (9005, "Two WORDS", "xx", "x", 9),
        (9006, long_text, "en", "x", len(long_text)),
        (9007, line + "first end", "en", "x", 1),
        (9008, line + "second end", "en", "x", 1),
        (9008, line + "second end", "en", "x", 1),
        (9009, "aaaa" * 200, None, "x", 800),
        (9010, "日本語のテキスト 12 <|endoftext|> don't", "ja", "x", 1),
        (None, line + "third end", "en", "x", 1),
    ]
    both = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for i, name in enumerate(("h", "n", "kept", "rate", "spans", "token", "n_words", "posterior", "_th", "lower")):
        both = both.withColumn(name, F.lit(i))
    return both.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
