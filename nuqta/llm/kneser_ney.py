"""Quality by an interpolated modified Kneser-Ney model over bytes.

Counting is distributed: tasks send the distinct 5-grams of their trusted texts, and the
lower orders' continuation counts, the context totals and the interpolation are group-bys
and joins of count tables sharded by n-gram. Scoring a document needs, for each byte, the
probability of the longest n-gram the model has and the weights of the longer contexts it
has. An n-gram of order n is an integer of n bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_ids, keep_rows, ship, written
from .textvec import U64, buffers, chunks

ORDER = 5
PAD = ORDER - 1
#: Rows of the model (n-grams and contexts of all orders) that may be sent to the workers,
#: 12 bytes each; a larger one is joined to the documents' n-grams shard by shard.
MAX_SENT_ROWS = 12_000_000


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each byte; what precedes a text is zero bytes."""
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.zeros(len(data) + PAD * len(lengths), np.uint8)
    at = np.arange(len(data)) + PAD * (doc + 1)
    padded[at] = data
    wide = padded.astype(U64)
    key = wide.copy()
    for j in range(1, ORDER):
        key[j:] |= wide[:-j] << U64(8 * j)
    return key[at]


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, n, and before them m if ``texts`` has a column m (0 or 1) next to text: the
    5-grams of each m, combined in the task before the shuffle."""
    by = "m" in texts.columns
    m = F.col("m").cast("long") if by else F.lit(0).cast("long")
    shift = U64(8 * ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            key = np.concatenate([k for k, _ in parts])
            order = np.argsort(key, kind="stable")
            key, n = key[order], np.concatenate([n for _, n in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            parts[:] = [(key[first], np.add.reduceat(n, first))]

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            part = batch.column(0).to_numpy().astype(U64) << shift
            for i, j in chunks(offsets):
                off = offsets[i : j + 1] - offsets[i]
                keys = np.sort(gram_keys(data[offsets[i] : offsets[j]], off) | np.repeat(part[i:j], np.diff(off)))
                if len(keys):
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    parts.append((keys[first], np.diff(np.append(first, len(keys)))))
            if len(parts) > 1 and sum(len(k) for k, _ in parts) > 2_000_000:
                merge()
        if parts:
            merge()
            key, n = parts[0]
            for a in range(0, len(key), 100_000):
                k = key[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((k >> shift).astype(np.int64)), pa.array((k & ((U64(1) << shift) - U64(1))).astype(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], names=["m", "gram", "n"])

    found = texts.select(m.alias("m"), F.col("text").cast("string")).mapInArrow(run, "m long, gram long, n long")
    return found.groupBy(*(["m"] if by else []), "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; where these give none, 0.5, 1 and 1.5, or
    less, so that no discount exceeds the count it is taken from."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)


def estimate(top: DataFrame) -> DataFrame:
    """The model from 5-gram counts: rows (kind, key, value). Kind n in 1..5: log
    probability of the n-gram ``key``; kind 10 + n: log of the weight that context ``key``
    of n bytes gives to the next lower order. Kind 0: the log probability of an unseen
    byte. If ``top`` has a column m, each of its values is a model of its own."""
    if "m" not in top.columns:
        return estimate(top.withColumn("m", F.lit(0))).drop("m")
    spark = top.sparkSession
    counts = {ORDER: written(top.select(F.col("m").cast("int").alias("m"), "gram", "n"), f"kn{ORDER}")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer n-grams that end so
        counts[n] = written(counts[n + 1].groupBy("m", F.col("gram").bitwiseAND((1 << 8 * n) - 1).alias("gram")).agg(F.count("*").alias("n")), f"kn{n}")
    of = reduce(DataFrame.unionAll, [c.groupBy("m").agg(F.lit(n).alias("order"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.sum("n").alias("total"), F.count("*").alias("kinds")) for n, c in counts.items()])
    stats = {(r["m"], r["order"]): r for r in of.collect()}  # five rows a model
    models = sorted({m for m, _ in stats})
    each = lambda values: reduce(lambda x, m: x.when(F.col("m") == m, float(values[m])), models, F.when(F.lit(False), 0.0))
    out, lower = [], None
    for n in range(1, ORDER + 1):
        d = {m: discounts(*[stats[m, n][f"n{k}"] for k in (1, 2, 3, 4)]) for m in models}
        d1, d2, d3 = (each({m: d[m][k] for m in models}) for k in range(3))
        c = counts[n].withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).withColumn("ctx", F.shiftright("gram", 8))
        if n == 1:
            total = {m: float(stats[m, 1]["total"]) for m in models}
            kept = {m: sum(x * y for x, y in zip((stats[m, 1]["n1"], stats[m, 1]["n2"], stats[m, 1]["kinds"] - stats[m, 1]["n1"] - stats[m, 1]["n2"]), d[m], strict=True)) / total[m] for m in models}
            p = c.select("m", "gram", ((F.col("n") - F.col("d")) / each(total) + each(kept) / 256).alias("p"))
            unseen = [(m, 0, 0, float(np.log(kept[m] / 256))) for m in models] or [(0, 0, 0, float(-np.log(256)))]
            out.append(spark.createDataFrame(unseen, "m int, kind int, key long, value double"))
        else:
            ctx = c.groupBy("m", "ctx").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("kept"))
            low = lower.select(F.col("m").alias("lm"), F.col("gram").alias("low"), F.col("p").alias("q"))
            p = (
                c.join(ctx, ["m", "ctx"])
                .join(low, (F.col("m") == F.col("lm")) & (F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1) == F.col("low")))
                .select("m", "gram", ((F.col("n") - F.col("d") + F.col("kept") * F.col("q")) / F.col("total")).alias("p"))
            )
            out.append(ctx.select("m", F.lit(10 + n - 1).alias("kind"), F.col("ctx").alias("key"), F.log(F.col("kept") / F.col("total")).alias("value")))
        lower = written(p, f"p{n}")
        out.append(lower.select("m", F.lit(n).alias("kind"), F.col("gram").alias("key"), F.log("p").alias("value")))
    model = written(reduce(DataFrame.unionAll, out), "kn_model")
    for c in counts.values():
        drop_written(c)
    return model


class Tables:
    """The model as sorted arrays over one buffer, which may be memory-mapped."""

    def __init__(self, blob: np.ndarray):
        head = blob[: 8 * 33].view(np.int64)
        self.unseen = float(head[:1].view(np.float64)[0])
        self.keys, self.values = {}, {}
        at = 8 * 33
        for kind in range(16):
            n = int(head[1 + kind])
            if n:
                self.keys[kind] = blob[at : at + 8 * n].view(U64)
                at += 8 * n
        for kind in range(16):
            n = int(head[1 + kind])
            if n:
                self.values[kind] = blob[at : at + 4 * n].view(np.float32)
                at += 4 * n

    @staticmethod
    def pack(kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> bytes:
        order = np.lexsort([key, kind])
        kind, key, value = kind[order], key[order].astype(U64), value[order].astype(np.float32)
        head = np.zeros(33, np.int64)
        real = kind > 0
        head[:1].view(np.float64)[0] = value[~real][0] if (~real).any() else -np.log(256)
        head[1:17] = np.bincount(kind[real], minlength=16)
        return head.tobytes() + key[real].tobytes() + value[real].tobytes()

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = self.keys.get(kind)
        if have is None:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.searchsorted(have, keys)
        at[at == len(have)] = 0
        return have[at] == keys, self.values[kind][at]

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Of each 5-gram's last byte after its first four."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            own = grams[left] & U64((1 << 8 * n) - 1)
            seen, value = self.find(n, own)
            out[left[seen]] += value[seen]
            left, own = left[~seen], own[~seen]
            if n > 1 and len(left):
                has, weight = self.find(10 + n - 1, own >> U64(8))
                out[left[has]] += weight[has]
        out[left] += self.unseen
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities and number of bytes of each text, over all its bytes.
        The distinct 5-grams of a chunk, sorted, are merged against the sorted tables."""
        data, offsets = buffers(column)
        total, size = np.zeros(len(column)), np.diff(offsets).astype(np.int64)
        for i, j in chunks(offsets):
            off = offsets[i : j + 1] - offsets[i]
            doc = np.repeat(np.arange(j - i, dtype=U64), np.diff(off))
            both = gram_keys(data[offsets[i] : offsets[j]], off)
            if j - i < 1 << 24:
                both = np.sort(both << U64(24) | doc)
                gram, doc = both >> U64(24), (both & U64((1 << 24) - 1)).astype(np.int64)
            else:
                order = np.argsort(both)
                gram, doc = both[order], doc[order].astype(np.int64)
            if not len(gram):
                continue
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            log_p = np.repeat(self.log_p(gram[first]), np.diff(np.append(first, len(gram))))
            total[i:j] += np.bincount(doc, log_p, j - i)
        return total, size


_mapped: dict[str, Tables] = {}


def _tables(name: str) -> Tables:
    if name not in _mapped:
        from pyspark import SparkFiles

        if len(_mapped) > 1:
            _mapped.clear()
        _mapped[name] = Tables(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _mapped[name]


@dataclass
class Quality:
    """A fitted model. ``table`` has its rows; ``name`` is the file sent to the workers, or
    None where it is too large for that."""

    table: DataFrame
    name: str | None
    mean: dict[str | None, float]
    limit: dict[str | None, float]
    prior: float


def send(table: DataFrame, limit: int = MAX_SENT_ROWS) -> str | None:
    if table.count() > limit:
        return None
    rows = table.toArrow()
    col = lambda c, t: rows.column(c).to_numpy().astype(t)
    return ship(table.sparkSession, "kneser_ney.bin", Tables.pack(col("kind", np.int64), col("key", np.int64), col("value", np.float32)))


def score(docs: DataFrame, table: DataFrame, name: str | None) -> DataFrame:
    """docs' doc_id and lang with log_p and size of each row's text."""
    if name is None:
        rows, names = _scored_rows(docs.select("doc_id", "lang", "text"), table)
        return rows.select(F.col(names[0]).cast("long").alias("doc_id"), F.col("lang").cast("string"), "log_p", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, size = _tables(name).score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(size)], names=["doc_id", "lang", "log_p", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang string, log_p double, size long")


def score_sharded(rows: DataFrame, table: DataFrame) -> DataFrame:
    """row and log_p of ``rows`` (row, text), for a model of any size: the texts' distinct
    n-grams are joined to the model's shards order by order, longest first; what an order lacks
    goes on to the next with the context's weight. A text without a byte has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            for i, j in chunks(offsets):
                off = offsets[i : j + 1] - offsets[i]
                doc = np.repeat(np.arange(i, j), np.diff(off))
                key = gram_keys(data[offsets[i] : offsets[j]], off)
                order = np.lexsort([key, doc])
                key, doc = key[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
                ids = b.column(0).to_numpy()[doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(key))).astype(np.int64))], names=["row", "gram", "n"])

    open_ = rows.select("row", F.col("text").cast("string")).mapInArrow(run, "row long, gram long, n long").withColumn("w", F.lit(0.0))
    done = []
    for n in range(ORDER, 0, -1):
        own = table.where(F.col("kind") == n).select(F.col("key").alias("gram"), F.col("value").alias("v"))
        open_ = written(open_.join(own, "gram", "left"), f"open{n}")
        done.append(open_.where("v is not null").select("row", (F.col("n") * (F.col("w") + F.col("v"))).alias("s")))
        open_ = open_.where("v is null").drop("v")
        if n > 1:
            ctx = table.where(F.col("kind") == 10 + n - 1).select(F.col("key").alias("ctx"), F.col("value").alias("v"))
            open_ = open_.withColumn("ctx", F.shiftright("gram", 8)).join(ctx, "ctx", "left")
            open_ = open_.select("row", F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1).alias("gram"), "n", (F.col("w") + F.coalesce("v", F.lit(0.0))).alias("w"))
    unseen = table.where("kind = 0").select("value").first()[0]
    done.append(open_.select("row", (F.col("n") * (F.col("w") + F.lit(unseen))).alias("s")))
    return reduce(DataFrame.unionAll, done).groupBy("row").agg(F.sum("s").alias("log_p"))


def _scored_rows(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` under names of our own (c0, c1, ...) but for lang and text, each row with its
    log_p and size."""
    names = [c if c in ("lang", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    out = rows.join(score_sharded(rows, table), "row", "left").withColumn("log_p", F.coalesce("log_p", F.lit(0.0)))
    return out.withColumn("size", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")), names


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()


def train(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.985, prior: float = 300, max_sent_rows: int = MAX_SENT_ROWS) -> Quality:
    """Fit on all trusted texts. A language's limit is the ``quantile`` of its trusted
    documents' perplexities, each by a model of the half of them (by a hash of doc_id) that it
    is not in; a language without any takes that of them all."""
    good = join_ids(docs.select("doc_id", "lang", "text").where("text is not null"), trusted_ids(labels), "left_semi")
    good = good.withColumn("m", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    halves = written(count_grams(good.select("m", "text")), "halves")
    both = halves.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(2).alias("m"), "gram", "n")
    models = estimate(halves.select(F.col("m").cast("int").alias("m"), "gram", "n").unionByName(both))
    of = [models.where(F.col("m") == m).drop("m") for m in range(3)]
    table, name = of[2], send(of[2], max_sent_rows)
    held = [score(good.where(F.col("m") == 1 - m), of[m], send(of[m], max_sent_rows)) for m in range(2)]
    scored = written(held[0].unionByName(held[1]), "trusted")
    mean = {r["lang"]: r["m"] for r in scored.groupBy("lang").agg((-F.sum("log_p") / F.sum("size")).alias("m")).collect() if r["m"] is not None}
    whole = scored.agg((-F.sum("log_p") / F.sum("size")).alias("m")).first()["m"]
    if whole is None:  # nothing to trust: nothing to reject
        return Quality(table, name, {None: float(np.log(256))}, {None: float("inf")}, prior)
    mean[None] = whole
    ppl = scored.select("lang", perplexity(mean, prior).alias("x"))
    limit = {r["lang"]: r["x"] for r in ppl.groupBy("lang").agg(F.percentile_approx("x", quantile, 100_000).alias("x")).collect()}
    limit[None] = ppl.agg(F.percentile_approx("x", quantile, 100_000).alias("x")).first()["x"]
    return Quality(table, name, mean, limit, prior)


def of_language(values: dict[str | None, float]) -> Column:
    """The value of the column lang; that of None for a null or unknown one."""
    known = [x for k, v in values.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
    rest = F.lit(float(values[None]))
    return F.coalesce(F.create_map(*known)[F.col("lang")], rest) if known else rest


def perplexity(mean: dict[str | None, float], prior: float) -> Column:
    """Per byte, from the columns lang, log_p and size. ``prior`` bytes at the language's mean
    are added to each text, so that a few bytes don't decide."""
    return F.exp((-F.col("log_p") + prior * of_language(mean)) / (F.col("size") + prior))


def assess(docs: DataFrame, q: Quality) -> DataFrame:
    """doc_id, lang, perplexity, threshold and accepted of every row of ``docs``.

    A null or empty text has its language's mean perplexity and isn't accepted; a null
    doc_id is kept; a null or unknown lang is judged by the threshold of all languages;
    repeated rows give repeated results; an empty table an empty result. A text exactly at
    the threshold is accepted. Columns besides doc_id, lang and text aren't read."""
    x, top = perplexity(q.mean, q.prior), of_language(q.limit)
    return score(docs, q.table, q.name).select("doc_id", "lang", x.alias("perplexity"), top.alias("threshold"), ((x <= top) & (F.col("size") > 0)).alias("accepted"))


def keep_good(docs: DataFrame, q: Quality) -> DataFrame:
    """The rows of ``docs`` that ``assess`` accepts, with all their columns, whatever their
    names; each row is judged by itself, whether its doc_id is null or repeats. Null and empty
    texts go; an empty table gives an empty one."""
    if q.name is None:
        rows, names = _scored_rows(docs, q.table)
        return rows.where((perplexity(q.mean, q.prior) <= of_language(q.limit)) & (F.col("size") > 0)).select(*names).toDF(*docs.columns)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    name, mean, limit, prior = q.name, q.mean, q.limit, q.prior

    def judge(b: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        langs = b.column(lang).to_pylist()
        of = lambda values: np.array([values.get(x, values[None]) for x in langs], float)
        total, size = _tables(name).score(b.column(text))
        x = np.exp((-total + prior * of(mean)) / (size + prior))
        return (x <= of(limit)) & (size > 0), {}

    return keep_rows(docs, judge)
