"""Tables with every awkward case, for all operators."""

import pytest

LONG = "".join(f"wort{i % 3001} " for i in range(48_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, node long, block long, h long, slot long, stream string, _row string, lang_pred string, score double, _text string, Piece int"


def _row(i, text, lang="en", source="src0"):
    return (i, text, lang, source, len(text or ""), "x", 1, 2, 3, 4, "y", "z", "q", 0.5, "w", 7)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts, languages and sources; empty and blank texts; a very long one; repeated rows; columns whose names clash with the operators' own."""
    rows = [
        _row(1, "The quick brown fox jumps over the lazy dog and runs away"),
        _row(1, "The quick brown fox jumps over the lazy dog and runs away"),
        _row(2, "The  quick brown fox\tjumps over the lazy dog and runs away"),
        _row(3, None, None, None),
        _row(4, ""),
        _row(5, " \t\n "),
        _row(6, LONG, "de", "src1"),
        _row(7, LONG + "etwas mehr", "de", "src1"),
        _row(None, "nobody knows my number", None, None),
        _row(None, "nobody knows my number", None, None),
        _row(8, "12345 67890 !!!", None, "src9"),
        _row(9, "größe straße über müller", "de", "src2"),
        _row(10, "single", "en", None),
        _row(11, "\x00 zero \x0b byte", "en", "src1"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
