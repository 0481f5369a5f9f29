"""Near duplicates: MinHash bands find candidates, odd sketches verify them.

A document's set is its word pairs. 256 minimum hashes are kept; 32 bands of 4 bring
together documents that may be similar, and the odd sketch - a bitmap in which each
(position, minimum) toggles one bit - gives the similarity of two documents by the number
of bits in which they differ. Documents whose minima are all equal are copies: they share one
text number, which a band holds once. A band's texts are compared with one another, in tiles
where they are many, and texts that are alike are linked; groups are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, free_name, join_texts, written
from .textvec import U64, Words, buffers, chunks, grams, mix, ranges

SHINGLE = 2
HASHES = 256
BANDS = 32
ROWS = 4
BITS = 512
#: Texts of a band that are compared in one task; more are split into tiles of two such blocks.
TILE = 1024
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, np.uint32)


def max_distance(threshold: float) -> int:
    """Most bits in which two sketches may differ at an estimated similarity of
    ``threshold`` or more."""
    return int(np.floor(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * HASHES * (1 - threshold)))))


def estimate(distance: np.ndarray | int) -> np.ndarray:
    """Similarity from the number of differing bits."""
    share = np.minimum(2 * np.asarray(distance, float) / BITS, 1 - 1e-9)
    return np.clip(1 - np.log1p(-share) / np.log1p(-2 / BITS) / (2 * HASHES), 0, 1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each document's word pairs and where each document's begin; a
    document of one word has that word."""
    count = np.diff(words.first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    pair = grams(words.hash, SHINGLE)
    at = np.repeat(words.first[:-1], n) + ranges(n)
    single = np.repeat((count > 0) & (count < SHINGLE), n)
    out = np.empty(len(at), U64)
    out[~single] = pair[at[~single]]
    out[single] = mix(words.hash[at[single]] + U64(1))
    return (out >> U64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(n)])


def minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, HASHES) minimum hashes; each document has one value at least."""
    starts = first[:-1]
    out = np.empty((HASHES, len(starts)), np.uint32)
    h = np.empty(len(values), np.uint32)
    for i in range(HASHES):
        np.multiply(values, MULTIPLY[i], out=h)
        np.add(h, ADD[i], out=h)
        out[i] = np.minimum.reduceat(h, starts)
    return np.ascontiguousarray(out.T)


def sketch(minimum: np.ndarray) -> np.ndarray:
    """(documents, BITS / 8) bytes: the parity bitmaps."""
    n = len(minimum)
    bit = (mix(minimum.astype(U64) | (np.arange(HASHES, dtype=U64) << U64(32))) >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)
    parity = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, BITS), axis=1)


def fold(columns: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of each row."""
    h = np.full(len(columns), seed, U64)
    for j in range(columns.shape[1]):
        h = mix(h * U64(0x9E3779B97F4A7C15) + columns[:, j].astype(U64))
    return h


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text, by which texts under one doc_id are told apart), two
    64-bit hashes of all minima, the bands' hashes and the odd sketch, of every document with
    a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            for i, j in chunks(offsets):
                values, first = shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                m = minima(values, np.append(first[some], len(values)))
                bands = np.stack([fold(m[:, k * ROWS : (k + 1) * ROWS], k + 1) for k in range(BANDS)], 1).astype(np.int64)
                n, at = len(some), pa.array(i + some)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at),
                        b.column(1).take(at),
                        pa.array(fold(m, 101).astype(np.int64)),
                        pa.array(fold(m, 202).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
                        pa.array([r.tobytes() for r in sketch(m)], pa.binary()),
                    ],
                    names=["doc_id", "h", "sig_a", "sig_b", "bands", "sketch"],
                )

    given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, sig_a long, sig_b long, bands array<long>, sketch binary")


def alike(sk: np.ndarray, limit: int, across: np.ndarray | None) -> np.ndarray:
    """Which of the sketches (n, words of 64 bits) are within ``limit`` bits; with ``across``,
    only pairs of which it names one."""
    n = len(sk)
    out = np.empty((n, n), bool)
    for a in range(0, n, 64):
        out[a : a + 64] = np.bitwise_count(sk[a : a + 64, None] ^ sk[None]).sum(2) <= limit
    np.fill_diagonal(out, False)
    if across is not None:
        out &= across[:, None] != across[None]
    return out


def spanning(near: np.ndarray) -> np.ndarray:
    """(edges, 2): a forest that connects what the symmetric matrix ``near`` connects."""
    left = near.any(1)
    edges = []
    while left.any():
        front = np.flatnonzero(left)[:1]
        left[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(0) & left)
            edges.append(np.stack([front[near[np.ix_(front, new)].argmax(0)], new], 1))
            left[new] = False
            front = new
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def count_links(near: np.ndarray, bands: np.ndarray, pos: int) -> np.ndarray:
    """Links of each text that no band before ``pos`` has: a pair counts where it first meets."""
    x, y = np.nonzero(np.triu(near))
    if pos:
        fresh = np.ones(len(x), bool)
        for a in range(0, len(x), 1 << 15):
            at = slice(a, a + (1 << 15))
            fresh[at] = ~(bands[x[at], :pos] == bands[y[at], :pos]).any(1)
        x, y = x[fresh], y[fresh]
    return np.bincount(x, minlength=len(near)) + np.bincount(y, minlength=len(near))


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """a, b, n of ``members`` (pos, m: array of text, sketch, bands and side): pairs (n = 0)
    that connect the texts of a band which are alike, and each text's number of links (b is
    null) that are not in an earlier band. ``side`` is 0, or 1 and 2 where only pairs of
    either are compared."""
    limit = max_distance(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, lists = b.column(0).to_numpy(), b.column(1)
            off = lists.offsets.to_numpy()
            flat = lists.values.slice(off[0], off[-1] - off[0]) if len(off) else lists.values
            off = off - off[0]
            ids, side = flat.field("text").to_numpy(), flat.field("side").to_numpy()
            sk = buffers(flat.field("sketch"))[0].view(U64).reshape(-1, BITS // 64)
            bands = flat.field("bands").flatten().to_numpy().reshape(-1, BANDS)
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

            def put(a: np.ndarray, other: np.ndarray, n: np.ndarray) -> None:
                link = n > 0
                rows.append((a, np.where(link, 0, other), n, link))  # noqa: B023

            size = np.diff(off)
            at = off[:-1][size == 2]
            if len(at):  # most sets are pairs: all at once
                good = (np.bitwise_count(sk[at] ^ sk[at + 1]).sum(1) <= limit) & ((side[at] == 0) | (side[at] != side[at + 1]))
                at, p = at[good], pos[size == 2][good]
                put(ids[at], ids[at + 1], np.zeros(len(at), np.int64))
                before = ((bands[at] == bands[at + 1]) & (np.arange(BANDS) < p[:, None])).any(1)
                at = at[~before]
                put(np.concatenate([ids[at], ids[at + 1]]), np.zeros(2 * len(at), np.int64), np.ones(2 * len(at), np.int64))
            for g in np.flatnonzero(size > 2):
                own = slice(off[g], off[g + 1])
                near = alike(sk[own], limit, side[own] if side[own].any() else None)
                e = spanning(near)
                put(ids[own][e[:, 0]], ids[own][e[:, 1]], np.zeros(len(e), np.int64))
                n = count_links(near, bands[own], int(pos[g]))
                put(ids[own][n > 0], np.zeros(int((n > 0).sum()), np.int64), n[n > 0])
            if rows:
                a, other, n, link = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(other, mask=link), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return members.select("pos", "m").mapInArrow(run, "a long, b long, n long")


def compare(texts: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``verify`` over all bands of ``texts`` (text, bands, sketch). A band of up to ``tile``
    texts is one set, and the same set is compared once however many bands it is in; the
    texts of a larger one fall by hash into blocks, and each two blocks are a set."""
    each = texts.select("text", F.posexplode("bands").alias("pos", "band"))
    large = written(each.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > tile), "large_bands")
    some = large.limit(1_000_001).count()  # few, as each has many texts
    of = lambda how: each.join(F.broadcast(large) if some <= 1_000_000 else large, "band", how)
    small = (of("left_anti") if some else each).groupBy("band").agg(F.min("pos").alias("pos"), F.collect_list("text").alias("ids")).where(F.size("ids") > 1)
    sets = small.select("pos", F.array_sort("ids").alias("ids")).groupBy("ids").agg(F.min("pos").alias("pos"))
    sets = sets.select("pos", F.xxhash64("ids").alias("set"), F.xxhash64(F.lit(1), "ids").alias("set2"), F.explode("ids").alias("text"))
    member = F.struct("text", "sketch", "bands", "side")
    out = sets.join(texts, "text").withColumn("side", F.lit(0)).groupBy("set", "set2").agg(F.min("pos").alias("pos"), F.collect_list(member).alias("m"))
    out = verify(out, threshold)
    if some:
        blocks = of("inner").withColumn("k", F.ceil(F.col("size") / tile)).withColumn("own", F.pmod(F.xxhash64("text"), F.col("k")))
        met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        met = met.select("text", "pos", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
        tiles = met.join(texts, "text").groupBy("band", "lo", "hi").agg(F.min("pos").alias("pos"), F.collect_list(member).alias("m"))
        out = out.unionByName(verify(tiles, threshold))
    return out


def components(edges: DataFrame) -> DataFrame:
    """doc_id, group_id (its component's least doc_id) of every document in an edge, by
    alternating large-star and small-star rounds until no edge changes. A round is written,
    and the one before it dropped."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # large star: each node's larger neighbours go to its least neighbour, or to itself
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # small star: each node and its lesser neighbours go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        linked = large.join(low, "b").select(F.col("low"), "a", "b")
        new = written(linked.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(), "edges")
        drop_written(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("doc_id"), F.col("a").alias("group_id"))


def classify(docs: DataFrame, threshold: float = 0.55, tile: int = TILE) -> DataFrame:
    """doc_id, h, class_id, links and stays of every document with a word: its class's least
    doc_id, its number of links, and whether it is the one of its class that stays, the least
    by (doc_id, h)."""
    sk = written(sketches(docs), "sketches")
    texts = written(sk.groupBy("sig_a", "sig_b").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("text", F.monotonically_increasing_id()), "texts")
    of = written(sk.select("doc_id", "h", "sig_a", "sig_b").distinct().join(texts.select("sig_a", "sig_b", "text"), ["sig_a", "sig_b"]).select("doc_id", "h", "text"), "members")
    drop_written(sk)
    found = written(compare(texts.select("text", "bands", "sketch"), threshold, tile), "found")
    groups = components(found.where("b is not null").select("a", "b"))
    drop_written(texts)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "text")
    own = of.groupBy("text").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h")).alias("least"))
    own = own.join(groups.withColumnRenamed("doc_id", "text"), "text", "left").withColumn("class", F.coalesce("group_id", "text")).join(links, "text", "left")
    own = written(own.select("text", "class", "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links")), "own")
    least = own.groupBy("class").agg(F.min("least").alias("first"))
    out = of.join(own.join(least, "class").select("text", "first", "links"), "text")
    return out.select("doc_id", "h", F.col("first.doc_id").alias("class_id"), "links", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("stays"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.55) -> DataFrame:
    """doc_id, class_id, links: one row for every document that has a link. Documents of one
    class are connected by links; class_id is its least doc_id; ``links`` counts the other
    documents with the same minima and the other texts that are alike, every pair of different
    texts that meet in a band being compared.

    Similarity is the Jaccard similarity of the sets of word pairs, as estimated by odd
    sketches; ``threshold`` is the least. Rows with a null doc_id or text, and texts without
    a word, are linked to none; rows that repeat a doc_id and its text are one document; texts
    that share a doc_id are documents of their own, each with its row; an empty table gives
    none. Only doc_id and text are read."""
    return classify(docs, threshold).where("links > 0").select("doc_id", "class_id", "links")


def keep_one(docs: DataFrame, *, threshold: float = 0.55) -> DataFrame:
    """``docs`` with one row of each class, the least by doc_id (and a hash of its text).

    Rows that repeat a doc_id and its text are copies, of which one stays. Rows with a null
    doc_id or text, and texts without a word, stay. All columns stay, whatever their names."""
    each = written(classify(docs, threshold), "classes")
    out = join_texts(docs, each.where("not stays").select("doc_id", "h").distinct(), "left_anti")
    again = written(docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h")).count().where("count > 1").select("doc_id", "h"), "again")
    if again.limit(1).count():
        own = free_name(docs, "h")
        once = join_texts(out, again, "left_semi").withColumn(own, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", own]).drop(own)
        out = join_texts(out, again, "left_anti").unionByName(once)
    return out
