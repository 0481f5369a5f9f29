"""A corpus in Arabic letters made of the Latin texts of ``documents``: sentences are the
verses, letters are carried over one by one, and lemmas and roots are cut from the words."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_arabic
from ..operators.corpus import Corpus, spread
from ..operators.scan import OwnCorpus

LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "ابتدإفغهىجكلمنؤقظرسةوثشخئز"
FATHA = "َ"


def to_arabic(text: str) -> str:
    return text.lower().translate(str.maketrans(LATIN, ARABIC))


def lemma_of(word: Column) -> Column:
    return F.substring(word, 1, 4)


def root_of(word: Column) -> Column:
    strong = F.translate(word, "اوي", "")
    letters = [F.substring(strong, i, 1) for i in (1, 2, 3)]
    return F.when(word.isNotNull(), F.concat_ws(" ", *[F.when(c != "", c) for c in letters]))


def marked(text: Column) -> Column:
    return F.regexp_replace(text, "([بتد])", f"$1{FATHA}")


def lemma_text(word: str) -> str:
    return word[:4]


def root_text(word: str) -> str:
    return " ".join(word.replace("ا", "").replace("و", "").replace("ي", "")[:3])


def marked_text(text: str) -> str:
    for c in "بتد":
        text = text.replace(c, c + FATHA)
    return text


#: What the first 256 code points become, which are most texts' only ones.
_CARRIED = "".join(to_arabic(chr(i)) for i in range(256))
_LETTERS = str.maketrans(LATIN, ARABIC)


def _pieces(text: str) -> list[str]:
    """The text between full stops and line breaks; runs of these part it once."""
    first, *rest = text.replace("\n", ".").split(".")
    return [first, *(x for x in rest[:-1] if x), *rest[-1:]]


def standard_texts(text: str) -> list[str]:
    """``standard`` of a document's verses, in order, as ``verses_of`` has it."""
    try:
        return _pieces(codecs.charmap_decode(text.encode("latin-1"), "strict", _CARRIED)[0])
    except UnicodeEncodeError:
        return [v.lower().translate(_LETTERS) for v in _pieces(text)]


def source_of(documents: DataFrame) -> DataFrame:
    """doc_id and text of the documents that have verses."""
    return spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def verses_of(documents: DataFrame) -> DataFrame:
    """gid, standard, uthmani and _pos: a row for each piece between full stops and line
    breaks. gid has 32 bits for the piece."""
    v = source_of(documents).select("doc_id", F.posexplode(F.split("text", "[.\\n]+")).alias("pos", "v"))
    v = v.select((F.col("doc_id").cast("long") * (1 << 32) + F.col("pos")).alias("gid"), F.translate(F.lower("v"), LATIN, ARABIC).alias("standard"))
    return v.select("gid", "standard", marked(F.col("standard")).alias("uthmani"), F.col("gid").alias("_pos"))


def corpus_of(documents: DataFrame) -> Corpus:
    verses = verses_of(documents)
    words = verses.select("gid", F.posexplode(F.split(normalize_arabic("standard"), " ")).alias("n", "w")).where("w <> ''")
    morphology = words.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("x")).select(
        "gid", F.transform("x", lambda x: lemma_of(x["w"])).alias("lemmas"), F.filter(F.transform("x", lambda x: root_of(x["w"])), lambda r: r != "").alias("roots")
    )
    word_map = words.where(F.length("w") >= 4).select(F.col("w").alias("token")).distinct().select("token", lemma_of(F.col("token")).alias("lemma"), root_of(F.col("token")).alias("root"))
    return OwnCorpus(verses, morphology, word_map, lemma_of=lemma_of, root_of=root_of, spelt=marked, known=4, texts=(lemma_text, root_text, marked_text), source=source_of(documents), pieces=standard_texts)


_corpora: dict[tuple[str, str], Corpus] = {}


def corpus_at(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder's documents. Nothing of it is stored but its vocabulary, when a
    query first needs it: each query reads what it uses."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _corpora:
        _corpora[key] = corpus_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _corpora[key]
