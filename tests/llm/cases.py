"""Small document tables with every awkward row the operators must take."""

from __future__ import annotations

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, h string, node int, _id int"


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    prose = "Der Hund und die Katze sind im Haus, und das Haus ist alt. "
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, "   \n\t", "de", "b", 5),
        (4, long, "en", "a", len(long)),
        (5, long + " tail", "en", None, len(long)),
        (6, "one two three", "fr", "c", 13),
        (7, "One two THREE", "fr", "c", 13),
        (7, "One two THREE", "fr", "c", 13),
        (8, "é ü Ä " * 20, "de", "b", 120),
        (9, prose * 5, "de", "b", 300),
        (10, prose * 5, "de", "a", 300),
        (11, None, None, None, None),
        (None, prose * 5, "de", "b", 300),
        (None, None, None, None, None),
        (12, "12345 ,.;", "en", "d", 9),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
