"""Packing along a space-filling curve: documents with like vectors share sequences.

A document's vector counts its hashed words; a fixed random projection takes it to few
dimensions, which are ranked to 16 bits and joined to one Hilbert key. Documents are
range-sorted by the key, laid end to end, and cut every ``capacity`` words. Only ids,
lengths and keys are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .textvec import U64, Words, buffers, chunks

HASHED = 256
DIMS = 3
DEPTH = 16
PROJECTION = np.random.default_rng(61).standard_normal((HASHED, DIMS))


def project(words: Words) -> np.ndarray:
    """(documents, DIMS) projections of the normed, signed counts of hashed words."""
    n = len(words.first) - 1
    doc = np.repeat(np.arange(n), np.diff(words.first))
    h = words.hash
    sign = ((h >> U64(20)) & U64(1)).astype(np.float64) * 2 - 1
    counts = np.bincount(doc * HASHED + (h & U64(HASHED - 1)).astype(np.int64), sign, n * HASHED).reshape(n, HASHED)
    norm = np.sqrt((counts**2).sum(1, keepdims=True))
    return (counts / np.maximum(norm, 1e-12)) @ PROJECTION


def grid(x: np.ndarray) -> np.ndarray:
    """Projections, which are about standard normal, on a grid of 2**DEPTH steps."""
    unit = 1 / (1 + np.exp(-1.702 * x))
    return np.minimum((unit * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1)


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Place on the Hilbert curve of each grid point (n, dims): Skilling's transform."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and curve_key of every document with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for i, j in chunks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count = np.diff(w.first)
                some = count > 0
                key = hilbert(grid(project(w)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).filter(pa.array(some)), pa.array(count[some]), pa.array(key[some])], names=["doc_id", "n_words", "curve_key"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, curve_key long")


def pack(docs: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """pack_id, slot, doc_id, start_word, end_word, curve_key: the sequence ``pack_id``
    holds, at its ``slot``-th place, words [start_word, end_word) of the document.

    All documents lie end to end in the order of (curve_key, doc_id, n_words), so every
    sequence but the last holds ``capacity`` words exactly, and a document longer than what
    is left continues in the next. Rows with a null doc_id or text and texts without a word
    are left out; repeated rows are packed as often as they occur; ties on the curve are
    ordered by doc_id; an empty table gives no row. Only doc_id and text are read."""
    # written first: the range partitioning reads its input twice, and texts are read once
    keyed = written(curve(docs), "keyed")
    ranged = keyed.repartitionByRange("curve_key", "doc_id", "n_words").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "curve")
    drop_written(keyed)
    # words before each partition: one row a partition
    sums = ranged.groupBy("part").agg(F.sum("n_words").alias("words"))
    ahead = sums.select("part", (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("ahead"))
    order = Window.partitionBy("part").orderBy("curve_key", "doc_id", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(ahead), "part").withColumn("until", F.col("ahead") + F.sum("n_words").over(order)).withColumn("from", F.col("until") - F.col("n_words"))
    cap = F.lit(capacity).cast("long")
    cutted = placed.withColumn("pack_id", F.explode(F.sequence(F.floor(F.col("from") / cap), F.floor((F.col("until") - 1) / cap))))
    pieces = cutted.select(
        "pack_id",
        "doc_id",
        "curve_key",
        F.greatest(F.lit(0), F.col("pack_id") * cap - F.col("from")).alias("start_word"),
        F.least("n_words", (F.col("pack_id") + 1) * cap - F.col("from")).alias("end_word"),
        (F.greatest(F.col("from"), F.col("pack_id") * cap) - F.col("pack_id") * cap).alias("offset"),
    )
    slot = F.row_number().over(Window.partitionBy("pack_id").orderBy("offset"))
    return pieces.withColumn("slot", slot).select("pack_id", "slot", "doc_id", "start_word", "end_word", "curve_key")
