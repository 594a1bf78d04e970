import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


LONG = " ".join(f"word{i}" for i in range(3000))

# Nulls, empty and very long texts, ties, repeated rows; columns that clash with the operators' own.
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "src1", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "src1", "a"),
    (2, "the quick  brown fox\njumps over the lazy dog again and again", "en", "src2", "b"),
    (3, None, "en", None, None),
    (4, "", None, "src1", None),
    (5, " \t\n\x0b\x0c\r", "en", "src3", "c"),
    (None, "no name here but some words for all that", "en", "src1", None),
    (None, None, None, None, None),
    (7, LONG, "en", "src2", "d"),
    (8, LONG + " tail", "de", "src2", "d"),
    (9, "short", "en", "src1", "e"),
    (10, "two words", "en", "src1", "e"),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*row, i, f"{i}", True) for i, row in enumerate(EDGES)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, content string, row long, kept string, a boolean"
    )
