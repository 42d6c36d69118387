import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    long = "word " * 30_000 + "x" * 40_000
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, long), (4, "a b c d e f"), (4, "a b c d e f"), (None, "no id here"), (5, "<|endoftext|> İ ΑΣ é 日本 🚀 it's"), (6, "a\x1cb \x85 c  d \n\n e")]
    return spark.createDataFrame([(*r, 7, "src0", "en", "copy", "n") for r in rows], "doc_id long, text string, n_tokens int, source string, lang string, copy string, spans string")
