import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from a list of texts or (doc_id, text, source)."""

    def make(rows):
        full = [(i, r, "en", "s", None) if r is None or isinstance(r, str) else (r[0], r[1], "en", r[2], None) for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumn("n_chars", F.length("text").cast("long"))

    return make


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Texts that every operator must take: null, empty, white space, one word, repeated rows, other scripts, a long text.
AWKWARD = [None, "", " \t\n", "word", "word", "Ünï cödé 中文 😀 text", "a b c " * 20_000, "x" * 100_000, "line one here now\nline one here now\n\n", "a  b\x0bc\x0cd"]
