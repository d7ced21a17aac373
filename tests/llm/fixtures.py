"""Small documents with the cases that every operator must handle."""

from pyspark.sql import Row

PROSE = "The of and to in that is for with on. A small house by the river was old, and the people from it are here. "


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with names that operators use."""
    rows = [
        Row(doc_id=1, text=PROSE * 3, lang="en", source="s", n_chars=1, text_hash="x", fp="y", kept="z", doc="w", h="v", lines="u", words="t", score="s"),
        (2, None, "en", "s", 1, *"abcdefgh"),
        (3, "", None, None, None, *"abcdefgh"),
        (None, "Nobody knows the number of this one. It is a text of its own, with enough words to be kept by all.", "en", "s", 1, *"abcdefgh"),
        (5, PROSE * 3, "en", "s", 1, *"abcdefgh"),
        (5, PROSE * 3, "en", "s", 1, *"abcdefgh"),
        (6, " \t\n\x0b ", "xx", "s", 1, *"abcdefgh"),
        (7, "word " * 40_000, "de", "s", 1, *"abcdefgh"),
        (8, "Ünïcode 世界 🌍 é é \x00 end", "fr", "s", 1, *"abcdefgh"),
        (9, "a", "en", "s", 1, *"abcdefgh"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, fp string, kept string, doc string, h string, lines string, words string, score string"
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
