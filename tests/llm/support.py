"""Small document tables with the awkward rows every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0, parts=3):
    """``texts`` (ids count from ``first``) as a documents table; a pair gives its own id."""
    rows = []
    for i, text in enumerate(texts):
        doc_id, text = text if isinstance(text, tuple) else (first + i, text)
        rows.append((doc_id, text, None if i % 7 == 3 else "en", f"src{i % 3}", len(text or "")))
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and texts, columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (None, "no id here", "en", "src1", 10),
        (2, "", "en", "src0", 0),
        (3, "word " * 3000, "en", None, None),
        (4, "same text", "de", "src0", 9),
        (4, "same text", "de", "src0", 9),
        (5, "same text", None, "src2", 9),
        (6, "x" * 5000, "en", "src2", 5000),
        (7, "<|endoftext|> straße 你好 🙂 it's", "fr", "src1", 20),
    ]
    schema = DOCS + ", size string, digest string, row string, shard string, length string, rank string"
    schema += ", hash string, pos string, class_id string, score string, n string, span string"
    extra = ("a",) * 12
    return spark.createDataFrame([r + extra for r in rows], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
