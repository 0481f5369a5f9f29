"""The functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .normalize import FOLD_FROM, FOLD_TO, LETTERS, MARKS, WS


def register(spark: SparkSession) -> None:
    """``remove_tashkeel``, ``normalize_arabic``, ``contains_all_tokens`` and the table
    function ``tokenize_query`` as temporary SQL functions, which the optimizer inlines."""
    esc = lambda s: s.replace("\\", "\\\\")
    ws, letters, marks = esc(WS), esc(LETTERS), esc(MARKS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION remove_tashkeel(s STRING) RETURNS STRING RETURN regexp_replace(translate(s, 'ٱ', 'ا'), '[{marks}]', '')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_arabic(s STRING) RETURNS STRING RETURN "
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(remove_tashkeel(coalesce(s, '')), '[\\\\u0670\\\\u0640]', ''), '{FOLD_FROM}', '{FOLD_TO}'), "
        f"'[\\\\r\\\\n]+', ' '), '[^{letters}{ws}-]+', ''), '[{ws}]{{2,}}', ' '), '^[{ws}]+|[{ws}]+$', '')"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION contains_all_tokens(v STRING, q STRING) RETURNS BOOLEAN RETURN normalize_arabic(q) <> '' AND forall(split(normalize_arabic(q), '[{ws}]+'), t -> contains(normalize_arabic(v), t))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize_query(q STRING) RETURNS TABLE (position INT, token STRING) RETURN SELECT t.pos, t.w FROM (SELECT split(normalize_arabic(q), '[{ws}]+') AS a) LATERAL VIEW posexplode(a) t AS pos, w WHERE t.w <> ''")
