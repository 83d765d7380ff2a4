import pytest

#: Names the operators use for themselves, as extra columns of the input.
CLASHES = ("doc", "n", "k", "h1", "t1", "t2", "drop", "kept", "pos", "line", "row", "total", "text_", "__drop", "_x_kept")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows,
    ties and columns with clashing names."""
    long = " ".join(f"word{i % 977} a{i}." for i in range(20_000))
    line = "this very line is held by many documents."
    rows = [
        (1, "A first text. It has\nsome lines.\n" + line),
        (2, line + "\nother words here."),
        (3, None),
        (None, "no id here.\n" + line),
        (None, None),
        (4, ""),
        (5, " \t\n\x0b "),
        (6, long),
        (7, long),
        (8, line),
        (8, line),
        (9, "one two three"),
        (10, "one two three"),
        (11, "é ü 日本 text with \x85 odd\xa0white space <|endoftext|> and a lone ' quote's end"),
    ]
    extra = [f"x{i}" if i % 3 else None for i in range(len(rows))]
    data = [(d, t, *([e] * len(CLASHES))) for (d, t), e in zip(rows, extra, strict=True)]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(data, schema).repartition(3)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
