import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: Null in every column, empty, blank and very long texts, repeated rows, ties.
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, None, None, None, None),
    (None, "der schnelle braune fuchs", "de", None, 25),
    (4, " \t\n\x0b\x0c\r", "en", "b", 6),
    (5, LONG, "en", "b", len(LONG)),
    (6, "éèê ▁ \U0001f600 字 \x00 <|endoftext|> </s>", "fr", "c", 10),
    (7, "x" * 70_000, None, "c", 70_000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with further columns whose names clash with results and inner names."""
    names = "size taken target fp key score kept word_chars n_tokens piece_ids shard quality _quality _row _text _key grp"
    rows = [(*r, *["clash"] * len(names.split())) for r in EDGE]
    return spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names.split()))


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
