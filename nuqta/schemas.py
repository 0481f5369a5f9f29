"""Tables and enumerations of the search engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()

VERSE = T.StructType(
    [
        T.StructField("gid", L),
        T.StructField("uthmani", S),
        T.StructField("standard", S),
        *[T.StructField(c, I) for c in ("sura_id", "aya_id", "page_id", "juz_id")],
        *[T.StructField(c, S) for c in ("aya_id_display", "standard_full", "sura_name", "sura_name_en", "sura_name_romanization")],
    ]
)
VERSE_COLUMNS = ("gid", "uthmani", "standard")
MORPHOLOGY = T.StructType([T.StructField("gid", L), T.StructField("lemmas", T.ArrayType(S)), T.StructField("roots", T.ArrayType(S))])
WORD_MAP = T.StructType([T.StructField("token", S), T.StructField("lemma", S), T.StructField("root", S)])
QUERIES = T.StructType([T.StructField("qid", L), T.StructField("query", S)])
RANGES = "array<struct<start:int,end:int,token:string,matchType:string>>"
PARTS = "array<struct<text:string,matchType:string>>"

EXACT, LEMMA, ROOT, FUZZY, NONE = "exact", "lemma", "root", "fuzzy", "none"


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} lacks {', '.join(missing)}")
    return df
