"""Documents at the edges: nulls in every column, empty and very long texts, ties, repeated
rows, and extra columns whose names operators might use."""

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(20000))
PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch from old trees. "
EXTRA = "key long, a string, b string, pos int, n int, start int, words string, segments string, band string, ids string, group_id long, duplicate_of long, language string, accepted string, perplexity string, pack_id long, slot int, curve_key long, region string, rack string, shard string, s string, x string, rank int, d double, i int, c string, v string, row long, gram long, token_ids string, decoded string, content string, media_id long"
SCHEMA = f"text string, doc_id long, lang string, source string, n_chars long, {EXTRA}"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    n = EXTRA.count(",") + 1
    full = [(r[1], r[0], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), *[None] * n) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [
    (1, PROSE * 5, "en"),
    (2, PROSE * 5, "en"),
    (2, PROSE * 5, "en"),
    (3, "", "en"),
    (4, None, "en"),
    (None, PROSE * 5, "en"),
    (None, None, None),
    (5, "A", None),
    (6, LONG, "en"),
    (7, "   \n\t ", "de"),
    (8, "!!! ... ???", "de"),
    (9, "日本語のテキスト " * 30, "xx"),
    (10, "x" * 100000, "en"),
    (11, "\x00 zero \x00 bytes", "en"),
    (12, "😀 astral 😀 text", "fr"),
]
