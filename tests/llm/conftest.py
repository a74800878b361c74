import pytest

LONG = " ".join(f"word{i % 97}" for i in range(60_000))

#: (doc_id, text): nulls, empty texts, white space, repeated rows, ties and a very long text
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (2, None),
    (3, ""),
    (4, "  two  spaces \n and\ttabs\r\nends "),
    (5, "ünïcode 日本語 \u00a0 nbsp <|endoftext|> !!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!"),
    (6, LONG),
    (None, "a row without an id"),
    (7, "."),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases with extra columns whose names clash with outputs and helpers."""
    names = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n_tokens string, kinds string, simhash string, id string, size string, label string, host string, wrapper string"
    rows = [(i, t, "en" if i and i % 2 else None, "s" if i else None, None, *["x"] * 10) for i, t in EDGE]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
