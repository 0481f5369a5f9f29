"""Sources: JSON files of verses, morphology and the word map, Parquet, and frames of one's
own. Reads are lazy; a path is looked up at once, so that what is missing fails here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MORPHOLOGY, VERSE, VERSE_COLUMNS, WORD_MAP, require


class SourceError(RuntimeError):
    """A source could not be loaded."""


def _existing(spark: SparkSession, path: str, what: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    except Exception as error:
        raise SourceError(f"Could not load {what} from {path}: {error}") from error
    if not found:
        raise SourceError(f"Could not load {what}: {path} does not exist.")
    return path


def with_position(verses: DataFrame) -> DataFrame:
    """``verses`` with the ordinal ``_pos``, the order of ties, if it has none: the order of
    the rows as read."""
    require(verses, VERSE_COLUMNS, "the verse table")
    return verses if "_pos" in verses.columns else verses.withColumn("_pos", F.monotonically_increasing_id())


def load_verses(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of verses, in file order."""
    return with_position(spark.read.schema(VERSE).option("multiLine", True).json(_existing(spark, path, "verses")))


def clean_morphology(rows: DataFrame) -> DataFrame:
    """One row per gid, the last by ``_pos`` (or as read); rows without a gid are dropped,
    null lists are empty."""
    require(rows, ("gid", "lemmas", "roots"), "the morphology table")
    rows = rows if "_pos" in rows.columns else rows.withColumn("_pos", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    last = rows.where("gid is not null").groupBy(F.col("gid").cast("long").alias("gid")).agg(F.max_by(F.struct("lemmas", "roots"), "_pos").alias("m"))
    return last.select("gid", F.coalesce("m.lemmas", none).alias("lemmas"), F.coalesce("m.roots", none).alias("roots"))


def load_morphology(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of gid, lemmas and roots; null items and items whose gid isn't a number
    are dropped, and the last of equal gids stays."""
    whole = spark.read.text(_existing(spark, path, "morphology"), wholetext=True)
    whole.createOrReplaceTempView("_nuqta_morphology_source")
    items = spark.sql("select pos as _pos, value as v from (select parse_json(value) as j from _nuqta_morphology_source), lateral variant_explode(j)")
    items = items.where(F.expr("schema_of_variant(try_variant_get(v, '$.gid', 'variant')) rlike '^(BIGINT|DOUBLE|DECIMAL)'"))
    get = lambda c, t: F.expr(f"try_variant_get(v, '$.{c}', '{t}')").alias(c)
    return clean_morphology(items.select("_pos", get("gid", "bigint"), get("lemmas", "array<string>"), get("roots", "array<string>")))


def load_word_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from token to lemma and root, either of which may lack."""
    whole = spark.read.text(_existing(spark, path, "the word map"), wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,struct<lemma:string,root:string>>")).alias("token", "e"))
    return entries.select("token", "e.lemma", "e.root")


def from_parquet(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    return spark.read.parquet(_existing(spark, path, what))


def empty_morphology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MORPHOLOGY)


def empty_word_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], WORD_MAP)


def first_entries(word_map: DataFrame) -> DataFrame:
    """The word map with one entry a token. An object has unique keys; where a table repeats
    one, the last by (lemma, root) is taken."""
    require(word_map, ("token", "lemma", "root"), "the word map")
    w = Window.partitionBy("token").orderBy(F.desc_nulls_last("lemma"), F.desc_nulls_last("root"))
    return word_map.where("token is not null").select("token", "lemma", "root").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
