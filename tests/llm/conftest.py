import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, found string, stats string, id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, repeats, ties, long texts and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 700} follows{i % 311}" for i in range(9000)) + ".\n" + "x" * 30000
    body = "one two three four five six seven eight nine ten eleven twelve. thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    texts = [None, "", " \t\n", "word", "a b c d", body, body, body.upper(), body + "\n" + body, long, long + " tail", "é ü\u00a0ß\n\n" + body, "\n".join(["same line of words here with eight words"] * 4)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "k", "f", "s", "i") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, body, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")
