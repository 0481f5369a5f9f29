"""The searched corpus and what is derived from it once: words, vocabularies, postings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_arabic, strip_word, text_or_empty, tokenize
from ..sources.readers import clean_morphology, empty_morphology, empty_word_map, first_entries, with_position
from ..sources.scratch import drop, scratch


def present(c: str) -> Column:
    """Null instead of '', which counts as absent."""
    return F.when(F.col(c) != "", F.col(c))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: one file is one
    partition, and all that is derived from it would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: The tables of a kept corpus, each with the columns by which its files are sorted.
BASE = {"verses": ("_pos",), "morphology": ("gid",), "word_map": ("token",)}
DERIVED = {"places": ("gid",), "postings": ("norm_word",), "vocabulary": ("norm_word",), "lemma_postings": ("norm_lemma",), "root_postings": ("norm_root",), "entries": ("token",), "verse_arrays": ("_pos",), "raw_words": ("word",), "raw_vocabulary": ("word",)}


@dataclass
class Corpus:
    """``verses`` needs gid, uthmani and standard; other columns pass through. ``kept`` holds
    the frames that ``persist`` keeps, ``folder`` the files they are read from."""

    verses: DataFrame
    morphology: DataFrame
    word_map: DataFrame
    kept: list[DataFrame] = field(default_factory=list)
    folder: str | None = None

    @classmethod
    def of(cls, verses: DataFrame, morphology: DataFrame | None = None, word_map: DataFrame | None = None) -> Corpus:
        spark = verses.sparkSession
        return cls(
            with_position(verses),
            clean_morphology(morphology) if morphology is not None else empty_morphology(spark),
            first_entries(word_map) if word_map is not None else empty_word_map(spark),
        )

    @cached_property
    def places(self) -> DataFrame:
        """gid with the first and the last position at which it occurs."""
        return self.verses.where("gid is not null").groupBy("gid").agg(F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"))

    def field_words(self, name: str = "standard") -> DataFrame:
        """Postings of a field: gid, _pos and each distinct word of its normalized text."""
        words = F.array_distinct(tokenize(normalize_arabic(name)))
        return self.verses.select("gid", "_pos", F.explode(words).alias("norm_word")).where("norm_word <> ''")

    @cached_property
    def postings(self) -> DataFrame:
        return self.field_words()

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.postings.select("norm_word").distinct()

    @cached_property
    def raw_words(self) -> DataFrame:
        """gid, _pos, key, word, start, end (both inclusive ends): the words of the raw text of
        both fields, for approximate matching."""
        out = None
        for k, name in enumerate(("standard", "uthmani")):
            pieces = F.regexp_extract_all(text_or_empty(name), F.lit(PIECE), F.lit(0))
            rows = self.verses.select("gid", "_pos", F.lit(k).alias("field"), F.lit(name).alias("key"), F.posexplode(with_offsets(pieces)).alias("n", "w"))
            rows = rows.select("gid", "_pos", "field", "key", "w.word", "w.start", "w.end")
            out = rows if out is None else out.unionByName(rows)
        return out

    @cached_property
    def raw_vocabulary(self) -> DataFrame:
        """word: the distinct words of the raw texts."""
        return self.raw_words.select("word").distinct()

    @cached_property
    def lemma_postings(self) -> DataFrame:
        return self._elements("lemmas", "lemma")

    @cached_property
    def root_postings(self) -> DataFrame:
        return self._elements("roots", "root")

    def _elements(self, column: str, name: str) -> DataFrame:
        # a gid has one row
        return self.morphology.select("gid", F.explode(F.array_distinct(F.transform(column, normalize_arabic))).alias(f"norm_{name}"))

    @cached_property
    def entries(self) -> DataFrame:
        """token with lemma and root as given and normalized; '' is no lemma and no root."""
        e = self.word_map.select("token", present("lemma").alias("lemma"), present("root").alias("root"))
        return e.withColumn("norm_lemma", F.when(F.col("lemma").isNotNull(), normalize_arabic("lemma"))).withColumn("norm_root", F.when(F.col("root").isNotNull(), normalize_arabic("root")))

    @cached_property
    def verse_word_roots(self) -> DataFrame:
        """gid, _pos, word_pos, word, stripped, norm and the dictionary's lemma and root of
        each word of ``standard``, if it has any."""
        words = self.verses.select("gid", "_pos", F.posexplode(tokenize(text_or_empty("standard"))).alias("word_pos", "word"))
        # what depends on the word alone is found once for each
        forms = words.select("word").distinct().withColumn("stripped", strip_word("word")).withColumn("norm", normalize_arabic("stripped"))
        e = self.entries.select(F.col("token").alias("norm"), F.col("norm_lemma").alias("word_lemma"), F.col("norm_root").alias("word_root"))
        return words.join(forms.join(e, "norm", "left"), "word").select("gid", "_pos", "word_pos", "word", "stripped", "norm", "word_lemma", "word_root")

    @cached_property
    def verse_arrays(self) -> DataFrame:
        """gid, _pos, the verse's words in order, and its morphology with normal forms."""
        words = self.verse_word_roots.groupBy("gid", "_pos").agg(F.array_sort(F.collect_list(F.struct("word_pos", "word", "stripped", "norm", "word_lemma", "word_root"))).alias("words"))
        norm = lambda c: F.transform(c, lambda x: F.struct(x.alias("s"), normalize_arabic(x).alias("n")))
        m = self.morphology.select("gid", norm("lemmas").alias("lemmas"), norm("roots").alias("roots"))
        return words.join(m, "gid", "left")

    def store(self, path: str) -> Corpus:
        """The corpus with all its tables, as written under ``path`` and read back: each is
        derived once, and a search's plan begins at files, whatever it took to make them."""
        spark = self.verses.sparkSession
        own = Corpus(self.verses, self.morphology, self.word_map)
        for name, order in (BASE | DERIVED).items():
            frame = spread(own.verses) if name == "verses" else getattr(own, name)
            frame.sortWithinPartitions(*order).write.parquet(f"{path}/{name}")
            setattr(own, name, spark.read.schema(frame.schema).parquet(f"{path}/{name}"))
        return own

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        """What ``store`` wrote."""
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in BASE | DERIVED}
        own = cls(*(tables[name] for name in BASE))
        own.__dict__.update({name: tables[name] for name in DERIVED})
        return own

    def persist(self) -> Corpus:
        """Keep all tables, for many searches over one corpus: stored in the session's shared
        folder until ``unpersist``, and in memory once read."""
        if self.folder is None:
            self.folder = scratch(self.verses.sparkSession, "corpus")
            stored = self.store(self.folder)
            for name in BASE | DERIVED:
                setattr(self, name, getattr(stored, name).persist())
                self.kept.append(getattr(self, name))
        return self

    def unpersist(self) -> None:
        """Give up what ``persist`` keeps; the corpus can't be searched afterwards."""
        for frame in self.kept:
            frame.unpersist()
        self.kept.clear()
        if self.folder is not None:
            drop(self.verses.sparkSession, self.folder)


from ..functions.normalize import WS  # noqa: E402

PIECE = f"[{WS}]*[^{WS}]+"
BLOCK = 64


def with_offsets(pieces: Column) -> Column:
    """array<struct<word, start, end>> of pieces (white space and a word): where the word is in
    the text, its last character included. Places are summed up in blocks of BLOCK pieces, so
    that a long text takes about linear time."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK)).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK))
    length = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p))
    no_block = F.array().cast("array<struct<at:int,block:array<string>>>")
    begin = F.struct(F.lit(0).alias("at"), no_block.alias("out"))
    each = F.aggregate(
        blocks, begin, lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b.alias("block")))).alias("out")), lambda acc: acc["out"]
    )
    return F.flatten(F.transform(each, lambda x: _block_offsets(x["block"], x["at"])))


def _block_offsets(pieces: Column, at: Column) -> Column:
    plain = F.transform(pieces, lambda p: F.struct(F.regexp_replace(p, f"^[{WS}]+", "").alias("word"), F.length(p).alias("size")))
    empty = F.array().cast("array<struct<word:string,start:int,end:int>>")
    start = F.struct(at.alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["size"]
        item = F.struct(x["word"].alias("word"), (end - F.length(x["word"])).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(plain, start, add, lambda acc: acc["out"])
