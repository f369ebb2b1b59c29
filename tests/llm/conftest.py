import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

EDGE_TEXTS = [
    None, "", " ", "\n\n", "a", "one two", "It's the  driver's\n\n  own: 12,5 km!", "tab\there nbsp   em", "日本語のテキスト と English", "été été Straße ªº µm",
    "<|endoftext|> inside <|startoftext|>", "x" * 3000, "word " * 4000, "same text twice", "same text twice", "\x00 nul \x1c file separator", "😀 emoji 👩‍👩‍👧 and more", "A.B,C;D don't I'LL we've", "   lead and trail   ",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Texts at the edges: null, empty, odd white space, long, repeated; null metadata; a clashing extra column."""
    rows = [(i if i != 5 else None, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(3, "same id again", "fr", "s1", 1), (3, "same id again", "fr", "s1", 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOC)
    for name in ("part", "rank", "length", "start", "shard", "curve", "run", "h"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
