"""Small inputs that every corpus operator must take."""

from __future__ import annotations

import public_tokenizers

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, size string, block int, key string"

TEXTS = [
    (1, "The cat sat on the mat. The cat sat.", "en", "a"),
    (2, "The cat sat on the mat. The cat sat.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "Ünïcödé 中文 🎉 text\twith\nlines\r\n and  double  spaces", "xx", "b"),
    (6, "word " * 3000, "en", "a"),
    (7, "x" * 40_000, "en", None),
    (8, "The cat sat on the mat. The cat sat.", "en", "a"),
    (9, "   \n\t ", "en", "c"),
    (9, "   \n\t ", "en", "c"),
    (None, "no id at all", "en", "c"),
]


def docs(spark, rows=None):
    """Documents with nulls, ties, repeated rows, an empty and a long text, and columns with clashing names."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, g, s, None, "c", "s", 1, "k") for i, t, g, s in rows], SCHEMA)


def key(row):
    return tuple((x is None, str(x)) for x in row)
