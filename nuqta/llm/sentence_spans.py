"""Sentence spans that repeat: every run of several consecutive sentences is hashed, equal
hashes are joined globally, and sentences that a repeated run covers, other than the first of
its kind, are removed. All of it is built-in expressions.

A run that very many places share would be one group of the join. Such runs are found in a
sample of the documents, which decides nothing but how their places are split: by a hash of
the place into groups of bounded size, whose firsts are then compared."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, written

#: A sentence with the marks that end it; the pieces of a text, joined, are the text.
PIECE = r"[^.!?\n]+[.!?\n]*|[.!?\n]+"
#: Runs that are compared: this many sentences, if they have this many characters together,
#: so that a few stock words do not match.
RUNS = tuple((run, 100) for run in range(2, 9))
#: Share of documents in which shared runs are looked for; how often one must be in them; places
#: in a group that are aimed at; and the shared runs at most (28 bytes each) that are handed out.
SHARE, OFTEN, GROUP, MOST = 1 / 64, 32, 4096, 100_000


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def clean(piece: Column) -> Column:
    """A sentence as it is compared: case-folded, single-spaced, without end marks."""
    return F.trim(F.regexp_replace(F.lower(piece), r"[ \t\r\n.!?]+", " "))


def _runs(run: int, least: int, lower: int | None) -> Column:
    """array<struct<pos, run, a, b>>: the runs of ``run`` of the hashed sentences ``s`` whose
    lengths are ``n``. Where runs one shorter are compared from ``lower`` characters on, a run
    whose first and last ``run`` - 1 sentences both have so many is left out: where it
    repeats they do, first in the same document or an earlier one, and together they cover
    it."""
    size = lambda i, k: reduce(add, [F.get("n", i + j) for j in range(k)]) + (k - 1)

    def needed(i: Column) -> Column:
        own = size(i, run) >= least
        return own if lower is None else own & ((size(i, run - 1) < lower) | (size(i + 1, run - 1) < lower))

    def span(i: Column) -> Column:
        part = F.slice("s", i + 1, run)
        return F.struct(i.alias("pos"), F.lit(run).alias("run"), F.xxhash64(F.lit(run), part["a"]).alias("a"), F.xxhash64(F.lit(run), part["b"]).alias("b"))

    places = F.when(F.size("s") >= run, F.sequence(F.lit(0), F.size("s") - run)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, needed), span)


def spans(docs: DataFrame, runs: tuple[tuple[int, int], ...]) -> DataFrame:
    """doc_id, h, pos, run, a, b: the runs of sentences of ``docs`` (doc_id, h, text)."""
    s = docs.select("doc_id", "h", F.filter(F.transform(pieces(F.col("text")), clean), lambda x: x != "").alias("s"))
    # two hashes of each sentence, and of a run those of its sentences' hashes: 128 bits
    s = s.select("doc_id", "h", F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("s"), F.transform("s", F.length).alias("n"))
    return s.select("doc_id", "h", F.explode(F.concat(*[_runs(run, least, dict(runs).get(run - 1)) for run, least in runs])).alias("x")).select("doc_id", "h", "x.*")


def repeated_runs(docs: DataFrame, runs: tuple[tuple[int, int], ...] = RUNS, often: int = OFTEN, share: float = SHARE, group: int = GROUP) -> DataFrame:
    """doc_id, h, pos, run: the runs of sentences of ``docs`` (doc_id, h, text) that occur at
    an earlier place, by (doc_id, h, pos)."""
    key = ["run", "a", "b"]
    every = spans(docs, runs)
    shared = spans(docs.sample(share, 17), runs).groupBy(*key).count().where(F.col("count") >= often)
    shared = shared.select(*key, (F.ceil(F.col("count") / (share * group)) + 1).cast("int").alias("salts"), "count").orderBy(F.desc("count"), *key).limit(MOST).drop("count")
    shared = docs.sparkSession.createDataFrame(shared.toArrow())  # MOST rows at most
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id", "h", "pos"), F.col("salts")) + 1).otherwise(0)
    placed = every.join(F.broadcast(shared), key, "left").withColumn("salt", salt)
    place = F.struct("doc_id", "h", "pos")
    groups = placed.groupBy(*key, "salt").agg(F.min(place).alias("first"), F.collect_list(place).alias("all"), F.max("salt").alias("split"))
    # written, as two things are read from them; runs that occur once are not
    groups = written(groups.where((F.size("all") > 1) | (F.col("split") > 0)), "groups")
    later = groups.where(F.size("all") > 1).select("run", "first", F.explode("all").alias("x")).where(F.col("x") != F.col("first")).select("run", "x")
    # the firsts of a split run's groups, but for the first of all
    firsts = groups.where("split > 0").select(*key, "first")
    least = firsts.groupBy(*key).agg(F.min("first").alias("least"))
    others = firsts.join(least, key).where(F.col("first") != F.col("least")).select("run", F.col("first").alias("x"))
    return later.unionByName(others).select("x.doc_id", "x.h", "x.pos", "run")


def _hashed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))


def _cleaned(given: DataFrame, runs: tuple[tuple[int, int], ...], **split: float) -> DataFrame:
    """doc_id, h, removed and what is left of the text, of the rows of ``given`` that lose
    sentences. Pieces are taken below the join, so that no lambda takes them again for each
    of its items."""
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("run") - 1)))).alias("covered")
    lists = repeated_runs(given, runs, **split).groupBy("doc_id", "h").agg(covered)
    real = F.transform(F.filter(F.transform("every", lambda x, i: F.struct(i.alias("i"), (clean(x) != "").alias("real"))), lambda x: x["real"]), lambda x: x["i"])
    cut = given.select("doc_id", "h", pieces(F.col("text")).alias("every")).select("doc_id", "h", "every", real.alias("real")).join(lists, ["doc_id", "h"])
    kept = F.array_except(F.sequence(F.lit(0), F.size("every") - 1), F.transform("covered", lambda k: F.get("real", k)))
    return cut.select("doc_id", "h", F.size("covered").alias("removed"), F.array_join(F.transform(kept, lambda i: F.get("every", i)), "").alias("text"))


def repeated_sentences(docs: DataFrame, *, runs: tuple[tuple[int, int], ...] = RUNS, **split: float) -> DataFrame:
    """doc_id, removed, text: every document that loses sentences, how many, and what is left
    of its text. A sentence goes if a run of sentences that occurs before covers it; marks and
    white space that belong to no sentence stay.

    ``runs`` gives the lengths of runs and the characters that a run must have, single spaces
    between sentences counted. The first of equal runs is the least by (doc_id, place), and
    stays. Texts with fewer sentences, empty and null texts and rows with a null doc_id lose
    nothing; rows that repeat a doc_id and its text are one document, whose rows lose the
    same; texts that share a doc_id are documents of their own, in the order of their hashes;
    runs may repeat within a document; an empty table gives no row. Only doc_id and text are
    read."""
    return _cleaned(_hashed(docs), runs, **split).select("doc_id", "removed", "text")


def remove_sentences(docs: DataFrame, *, runs: tuple[tuple[int, int], ...] = RUNS, **split: float) -> DataFrame:
    """``docs`` without the sentences that ``repeated_sentences`` removes: all rows and
    columns, whatever their names, n_chars being that of the new text. Edges are as there."""
    names = docs.columns
    mine, id_, h, found = docs, *(free_name(docs, x) for x in ("of_id", "of_hash", "of_text"))
    lists = _cleaned(_hashed(docs), runs, **split).groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.first("text").alias(found))
    both = mine.join(lists, (mine["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(mine["text"].cast("string")) == F.col(h)), "left")
    text = F.coalesce(F.col(found), mine["text"])
    cut = both.select(*[text.alias(c) if c == "text" else mine[c] for c in names], found)
    if "n_chars" in names:  # of the text as it is now
        cut = cut.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*names)


def repeated_sentences_sql(runs: tuple[tuple[int, int], ...] = RUNS) -> str:
    """``repeated_sentences`` in DuckDB's SQL, which compares the runs' texts."""
    joined = lambda run: " || ' ' || ".join(f"s[i + {k}]" for k in range(run))
    tiers = " union all ".join(f"select k, i - 1 as pos, {run} as run, {joined(run)} as t from (select k, s, unnest(range(1, len(s) - {run} + 2)) as i from real where len(s) >= {run}) where length({joined(run)}) >= {least}" for run, least in runs)
    return rf"""
with given as (select doc_id, text, row_number() over (order by doc_id, text) as k from (select distinct doc_id, text from documents where doc_id is not null and text is not null)),
pieces as (select k, regexp_extract_all(text, '[^.!?\n]+[.!?\n]*|[.!?\n]+') as p from given),
cleaned as (select k, p, list_transform(p, lambda x: trim(regexp_replace(lower(x), '[ \t\r\n.!?]+', ' ', 'g'), ' ')) as c from pieces),
real as (select k, p, list_filter(c, lambda x: x <> '') as s, list_filter(range(1, len(c) + 1), lambda j: c[j] <> '') as places from cleaned),
spans as ({tiers}),
firsts as (select run, t, min(struct_pack(k := k, p := pos)) as f from spans group by run, t having count(*) > 1),
later as (select k, run, pos from spans join firsts using (run, t) where k <> f.k or pos <> f.p),
gone as (select k, list(distinct places[i + 1]) as g from (select k, unnest(range(pos, pos + run)) as i from later) join real using (k) group by k)
select g.doc_id, cast(len(g_.g) as integer) as removed, array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda j: not list_contains(g_.g, j)), lambda j: p[j]), '') as text
from gone g_ join real using (k) join given g using (k) join documents d on d.doc_id = g.doc_id and d.text = g.text"""
