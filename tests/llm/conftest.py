import pytest

#: Names that the operators use for columns of their own; documents may have them too.
CLASHING = ("shard", "size", "key", "rank", "block", "h", "th", "n", "token", "group", "roles", "copies", "score", "_bytes", "ids", "target")


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in CLASHING:
            docs = docs.selectExpr("*", f"'x' AS {name}")
        return docs

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, copies, repeated rows, letters of many scripts."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (5, "The quick brown fox jumps over the lazy dog and runs away again."), (3, None), (None, "no id here"), (9, ""), (8, " \t\n\x0b "), (7, long), (1, "a"), (2, "日本語 текст ελληνικά"),
        (4, "The quick brown fox jumps over the lazy dog and runs away again."), (5, "The quick brown fox jumps over the lazy dog and runs away again."), (6, "line one that is long enough to count\nline one that is long enough to count\r\nx"),
        (10, "İstanbul Σίσυφος don't <|endoftext|> $$$ a_b-c... ﬁ é"), (None, None), (11, None), (12, " "), (13, "x" * 5000),
    ]
