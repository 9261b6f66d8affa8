import pytest


@pytest.fixture(scope="session")
def docs(spark):
    long = " ".join(f"w{k % 97}x{k % 13}" for k in range(6000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"), (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"),
        (3, None, "en", "a"), (4, "", None, "b"), (5, long, "en", None), (6, "Un petit chat noir dort sur la chaise", "fr", "b"), (7, "\n\t ", "fr", "c"), (8, "one", None, "c"), (None, "no key at all", "en", "a"),
        (9, long, "en", "a"), (10, "Ça alors! 日本語 text here  with\tblanks <|endoftext|> done", "fr", "a"), (10, "Ça alors! 日本語 text here  with\tblanks <|endoftext|> done", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, size int, copies string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
