"""Repeated passages by merging Burrows-Wheeler transforms.

A passage repeats if ``length`` consecutive words occur at more than one place. Every
stretch of that many words is assigned to the least hash among its 16-word runs, so that
equal stretches meet under one key, wherever they are; stretches that follow one another
under one key form a segment. Keys that occur once are dropped, and of equal segments one is
kept, with the number of its content. The segments of a range of
keys are split into shards; each shard's suffixes are sorted on their own, and its BWT is
kept; the shards' BWTs are then merged by iterative interleave refinement: starting from any
interleave, each round distributes the rows of all shards, in their present order, to the
buckets of the symbols before them, after which the rows are in the order of one more
symbol. A boundary between neighbours that first shows in round t says that their common
prefix has t - 1 symbols; rows not parted after all rounds are a repeated interval. Nothing
but the small shards is ever sorted by suffix.

A symbol is a run of ``length / ROUNDS`` words, taken at that stride, so ROUNDS rounds
decide whether ``length`` words are equal.

A key under which there are more stretches than a task should hold is not merged: its
stretches meet one by one, by 128 bits of hash, in a group-by that combines before the
shuffle. A document is a doc_id with a text, ``h`` being the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .textvec import U64, Words, buffers, chunks, grams, mix, take_ranges

ROUNDS = 5
RUN = 16
LONGEST = 256
#: Words in a merge, beyond which the next key begins another; words in a shard.
MERGE_WORDS, SHARD_WORDS = 1 << 19, 1 << 17
#: Stretches of one key, beyond which they are grouped by hash.
HOT = 1 << 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive items."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segment(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, first word in the chunk, number of stretches and key of each segment."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < length:
        return none, none, none, none.astype(U64)
    least = sliding_min(grams(words.hash, RUN), length - RUN + 1)  # of the stretch at each word
    count = np.diff(words.first) - length + 1
    some = np.flatnonzero(count > 0)
    at = take_ranges(words.first[some], count[some])
    if not len(at):
        return none, none, none, none.astype(U64)
    doc = np.repeat(some, count[some])
    key = least[at]
    begins = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(at)))
    pieces = -(-size // LONGEST)
    if (pieces > 1).any():  # long segments in pieces
        begin = np.repeat(first, pieces) + take_ranges(np.zeros(len(pieces), np.int64), pieces) * LONGEST
        size = np.minimum(np.repeat(first + size, pieces) - begin, LONGEST)
        first = begin
    return doc[first], at[first], size, key[first]


def key_rows(docs: DataFrame, length: int) -> DataFrame:
    """key, doc_id, h, start, n and how often the key's run is in the segment (2: or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            for i, j in chunks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc, at, size, key = segment(w, length)
                if not len(doc):
                    continue
                span = size + length - RUN
                runs = grams(w.hash, RUN)
                same = runs[take_ranges(at, span)] == np.repeat(key, span)
                times = np.add.reduceat(same.astype(np.int64), np.cumsum(span) - span)
                row = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.minimum(times, 2).astype(np.int32))],
                    names=["key", "doc_id", "h", "start", "n", "times"],
                )

    return docs.mapInArrow(run, "key long, doc_id long, h long, start int, n int, times int")


def fingerprints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text ``words[first[i]:first[i + 1]]``."""
    at = take_ranges(np.zeros(len(first) - 1, np.int64), np.diff(first)).astype(U64)
    p = mix(words.astype(U64) + U64(7))
    return np.add.reduceat(mix(p + (at << U64(32))), first[:-1]), np.add.reduceat(mix(p ^ mix(at)), first[:-1])


def segment_rows(found: DataFrame, length: int) -> DataFrame:
    """doc_id, h, start, key, a, b, n and words: each segment of ``found`` (doc_id, h, text,
    segments) with its content's hashes and its words (32-bit hashes); of a hot key each
    stretch, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            lists = batch.column(3)
            loff = lists.offsets.to_numpy()
            loff, lists = loff - loff[0] if len(loff) else loff, lists.values.slice(loff[0], loff[-1] - loff[0]) if len(loff) else lists.values
            start, n, key, hot = (lists.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "key", "hot"))
            start, n = start.astype(np.int64), n.astype(np.int64)
            for i, j in chunks(offsets):
                own = slice(loff[i], loff[j])
                if own.start == own.stop:
                    continue
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                short = (w.hash >> U64(32)).astype(np.uint32)
                doc = np.repeat(np.arange(j - i), np.diff(loff[i : j + 1]))

                def rows(doc, start, n, key, words: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                    size = n + length - 1
                    for x in range(0, len(doc), 20_000):
                        part = slice(x, x + 20_000)
                        take = take_ranges(w.first[doc[part]] + start[part], size[part])  # noqa: B023
                        edge = np.concatenate([[0], np.cumsum(size[part])])
                        flat = short[take]  # noqa: B023
                        a, b = fingerprints(flat, edge)
                        content = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((edge * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]) if words else pa.nulls(len(a), pa.binary())
                        row = pa.array(i + doc[part])  # noqa: B023
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(row), batch.column(1).take(row), pa.array(start[part]), pa.array(key[part]), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(n[part].astype(np.int32)), content],  # noqa: B023
                            names=["doc_id", "h", "start", "key", "a", "b", "n", "words"],
                        )

                cold = ~hot[own].astype(bool)
                if cold.any():
                    yield from rows(doc[cold], start[own][cold], n[own][cold], key[own][cold], True)
                if not cold.all():
                    many = n[own][~cold]
                    each = np.repeat(np.flatnonzero(~cold), many)
                    yield from rows(doc[each], start[own][each] + take_ranges(np.zeros(len(many), np.int64), many), np.ones(len(each), np.int64), key[own][each], False)

    return found.mapInArrow(run, "doc_id long, h long, start long, key long, a long, b long, n int, words binary")


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers under 2**32, 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and x.max() > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """Suffixes of some texts, sorted by their first ROUNDS symbols, and the symbol before
    each. ``row`` is the suffix at each rank."""

    def __init__(self, symbol: np.ndarray, follows: np.ndarray, before: np.ndarray):
        """symbol: of each suffix, 0 for an empty one; follows: the suffix after its first
        symbol (itself if empty); before: the symbol before it, 0 if none."""
        columns, at = [], np.arange(len(symbol))
        for _ in range(ROUNDS):
            columns.append(symbol[at])
            at = follows[at]
        order = np.arange(len(symbol))
        for c in reversed(columns):
            order = order[stable_order(c[order])]
        self.row, self.bwt = order, before[order]


def merge(bwts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of all shards' rows (the shard of each row of the merged order) and
    the common prefix, in symbols, of each row with the one before it (ROUNDS: or more)."""
    sizes = [len(b) for b in bwts]
    z = np.repeat(np.arange(len(bwts)), sizes)
    every = np.concatenate(bwts)
    total = len(every)
    block = np.zeros(total, np.int64)
    common = np.full(total, ROUNDS)
    if total:
        common[0] = 0
    at = np.arange(total)  # the row of `every` at each rank: each shard's rows keep their order
    empty = int((every == 0).sum())
    home = np.repeat(np.arange(len(bwts)), [int((b == 0).sum()) for b in bwts])
    for t in range(1, ROUNDS + 1):
        s = every[at]
        order = stable_order(s)
        z, s, block = z[order], s[order], block[order]
        z[:empty] = home  # empty suffixes stay in the shards' order
        parted = np.ones(total, bool)
        parted[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        parted[1:empty] = False
        new = parted & (common == ROUNDS)
        common[new] = t - 1
        block = np.cumsum(parted)
        by = np.argsort(z.astype(np.uint16), kind="stable")
        at = np.empty(total, np.int64)
        at[by] = np.arange(total)
    return z, common


def repeats_in(tokens: np.ndarray, first: np.ndarray, length: int, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """Number of the repeated interval of each stretch of the texts ``tokens[first[i]:
    first[i + 1]]``, in the order of texts and stretches: equal numbers, equal stretches."""
    stride = length // ROUNDS
    sizes = np.diff(first)
    runs = grams(mix(tokens.astype(U64)), stride)
    # every word starts a suffix; the last `stride - 1` of a text none, and `stride` more are empty
    full = sizes - stride + 1
    text = np.repeat(np.arange(len(sizes)), full)
    at = take_ranges(first[:-1], full)
    _, dense = np.unique(runs[at], return_inverse=True)
    dense = dense.astype(np.int64) + 1
    rows = full + stride
    begin = np.concatenate([[0], np.cumsum(rows)])
    symbol = np.zeros(begin[-1], np.int64)
    place = begin[text] + at - first[text]
    symbol[place] = dense
    follows = np.arange(begin[-1])
    follows[place] = place + stride
    before = np.zeros(begin[-1], np.int64)
    before[place + stride] = dense
    # shards of whole texts
    shard = (begin[:-1] // max(1, shard_words)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    bounds = np.append(begin[edges], begin[-1])
    shards = [Shard(symbol[a:b], follows[a:b] - a, before[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    z, common = merge([s.bwt for s in shards])
    ranked = np.empty(begin[-1], np.int64)
    for k, s in enumerate(shards):
        ranked[z == k] = bounds[k] + s.row
    interval = np.empty(begin[-1], np.int64)
    interval[ranked] = np.cumsum(common < ROUNDS)
    return interval[take_ranges(begin[:-1], sizes - length + 1)]


def find_repeats(doc: np.ndarray, h: np.ndarray, start: np.ndarray, words: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """segment, offset, stretches, source doc, h and start: the runs of stretches of each of
    the distinct segments ``words``, whose earliest places are given, with the earliest place
    by (doc_id, h, word) of the same stretches."""
    sizes = np.array([len(w) // 4 for w in words], np.int64)
    tokens = np.frombuffer(b"".join(words), np.uint32)
    n = sizes - length + 1
    interval = repeats_in(tokens, np.concatenate([[0], np.cumsum(sizes)]), length)
    # the source of each interval: the least place of its members
    seg = np.repeat(np.arange(len(n)), n)
    at = take_ranges(np.zeros(len(n), np.int64), n)
    d, e, s = doc[seg], h[seg], start[seg] + at
    by = np.lexsort([s, e, d, interval])
    head = np.concatenate([[True], interval[by][1:] != interval[by][:-1]])
    source = np.empty(len(by), np.int64)
    source[by] = by[head][np.cumsum(head) - 1]
    d, e, s = d[source], e[source], s[source]
    # runs of stretches with one source, in each segment
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (s[1:] != s[:-1] + 1) | (seg[1:] != seg[:-1])
    first = np.flatnonzero(new)
    return seg[first], at[first], np.diff(np.append(first, len(d))), d[first], e[first], s[first]


def repeat_runs(contents: DataFrame, length: int) -> DataFrame:
    """a, b, offset, n, source_id, source_h, source of distinct segments (key, a, b, place,
    words), which come sorted by key. A worker holds ``MERGE_WORDS`` and one key."""
    names = ["a", "b", "offset", "n", "source_id", "source_h", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        amount = 0

        def result(t: pa.Table) -> pa.RecordBatch:
            a, b, doc, h, start = (t.column(c).to_numpy() for c in ("a", "b", "doc_id", "h", "start"))
            seg, *rest = find_repeats(doc, h, start, t.column("words").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(a[seg]), pa.array(b[seg]), *[pa.array(x.astype(np.int64)) for x in rest]], names=names)

        for batch in batches:
            key = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):  # a key each
                if not len(part):
                    continue
                piece = batch.slice(part[0], len(part))
                if amount > MERGE_WORDS and piece.column(0)[0].as_py() != held[-1].column(0)[0].as_py():
                    yield result(pa.Table.from_batches(held))
                    held, amount = [], 0
                held.append(piece)
                amount += piece.column(5).nbytes // 4
        if held:
            yield result(pa.Table.from_batches(held))

    return contents.select("key", "a", "b", "doc_id", "h", "words", "start").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def join_runs(runs: DataFrame, length: int) -> DataFrame:
    """Runs of a document that continue one another become one; words instead of stretches.
    ``runs`` come sorted by doc_id, h and start."""
    names = ["doc_id", "h", "start_word", "end_word", "source_id", "source_h", "source_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(c: list[np.ndarray]) -> pa.RecordBatch:
            doc, h, start, n, source_id, source_h, source = c
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, h, start, start + n + length - 1, source_id, source_h, source)], names=names)

        for b in batches:
            c = [x.to_numpy() for x in b.columns]
            if held is not None:
                c = [np.concatenate([x, y]) for x, y in zip(held, c, strict=True)]
            if not len(c[0]):
                continue
            same = np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in (0, 1, 4, 5)])
            new = np.concatenate([[True], ~(same & (c[2][1:] == c[2][:-1] + c[3][:-1]) & (c[6][1:] == c[6][:-1] + c[3][:-1]))])
            at = np.flatnonzero(new)
            c = [np.add.reduceat(x, at) if k == 3 else x[at] for k, x in enumerate(c)]
            held = [x[-1:] for x in c]
            if len(c[0]) > 1:
                yield out([x[:-1] for x in c])
        if held is not None:
            yield out(held)

    return runs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated_segments(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """``segment_rows`` of the keys that occur more than once. ``docs`` must have no null
    doc_id or text."""
    if length % ROUNDS or length <= RUN:
        raise ValueError(f"length must be a multiple of {ROUNDS} above {RUN}")
    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string"))
    keys = key_rows(given, length)
    often = keys.groupBy("key").agg(F.sum("times").alias("all"), F.sum("n").alias("stretches")).where(F.col("all") > 1).select("key", (F.col("stretches") > hot).alias("hot"))
    lists = keys.join(often, "key").groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n", "key", "hot")).alias("segments"))
    return segment_rows(given.join(lists, ["doc_id", "h"]).select("doc_id", "h", "text", "segments"), length)


def spans_of(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, h, start_word, end_word, source_id, source_h, source_word from written
    ``repeated_segments``: see ``repeated_passages``."""
    place = F.struct("doc_id", "h", "start")
    cold, hots = rows.where("words is not null"), rows.where("words is null")
    contents = cold.groupBy("key", "a", "b").agg(F.min(place).alias("place"), F.first("words").alias("words"))
    contents = contents.select("key", "a", "b", "words", "place.*").repartition("key").sortWithinPartitions("key")
    runs = repeat_runs(contents, length)
    met = cold.select("a", "b", "doc_id", "h", "start").join(runs, ["a", "b"])
    met = met.select("doc_id", "h", (F.col("start") + F.col("offset")).alias("start"), F.col("n").cast("long"), "source_id", "source_h", "source")
    # stretches of hot keys: equal by their hashes
    first = hots.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("a", "b", "first")
    single = hots.select("a", "b", "doc_id", "h", "start").join(first, ["a", "b"])
    single = single.select("doc_id", "h", "start", F.lit(1).cast("long").alias("n"), F.col("first.doc_id").alias("source_id"), F.col("first.h").alias("source_h"), F.col("first.start").alias("source"))
    every = met.unionByName(single).where("doc_id <> source_id or h <> source_h or start <> source").distinct()
    return join_runs(every.repartition("doc_id", "h").sortWithinPartitions("doc_id", "h", "start"), length)


def repeated_passages(docs: DataFrame, *, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word, source_id, source_word: the words [start_word, end_word)
    of the document also begin at word source_word of document source_id, the first such
    place by (doc_id, word); every stretch of ``length`` words that occurs at an earlier
    place is in a row, and no other is. ``hot`` decides how a key's stretches meet, not which.

    Words are case-folded and without marks (``textvec``). Rows with a null doc_id or text
    are left out; shorter and empty texts have no stretch; rows that repeat a doc_id and its
    text are one document; texts that share a doc_id are documents of their own, in the order
    of their hashes; a text that repeats itself counts too; an empty table gives no row. Only
    doc_id and text are read."""
    given = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = written(repeated_segments(given, length, hot), "segments")
    return spans_of(rows, length).select("doc_id", "start_word", "end_word", "source_id", "source_word")


def remove_passages(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """``docs`` without their repeated passages, as ``cut_repeats`` cuts them. Rows with a null
    doc_id or text stay as they are; rows that repeat a doc_id and text are cut alike; texts
    that share a doc_id are cut each by its own passages; all columns stay, whatever their
    names; an empty table gives an empty one."""
    whole = "doc_id is not null and text is not null"
    rows = written(repeated_segments(docs.where(whole).select("doc_id", "text"), length), "segments")
    spans = written(spans_of(rows, length).select("doc_id", "h", "start_word", "end_word"), "spans")
    drop_written(rows)
    mine, names = _plain(docs), docs.columns
    lists = _lists(spans.withColumnRenamed("doc_id", "__id").withColumnRenamed("h", "__h"), "__id", "__h")
    given = mine.where(whole)
    same = (given["doc_id"].cast("long") == lists["__id"]) & (F.xxhash64(given["text"].cast("string")) == lists["__h"])
    # by a shuffle at every size: there are about as many lists as documents that have repeats
    both = given.join(lists.hint("merge"), same, "left").drop("__id", "__h")
    return _cut(both, mine).unionByName(mine.where(f"not ({whole})")).toDF(*names)


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names of ours for the columns that are only carried along."""
    return docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)])


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words that ``spans`` (doc_id, start_word, end_word) cover, and
    without what stands between and up to the next word; other columns stay, but for n_chars,
    which is that of the new text. Texts without a span, null texts and rows without a doc_id
    are returned as they are; rows that share a doc_id are cut at the same words, as far as
    they have them; an empty table, or one without spans, gives itself."""
    mine = _plain(docs)
    lists = _lists(spans.withColumnRenamed("doc_id", "__id"), "__id")
    both = mine.join(lists, mine["doc_id"] == lists["__id"], "left").drop("__id")
    return _cut(both, mine).toDF(*docs.columns)


def _lists(spans: DataFrame, *by: str) -> DataFrame:
    return spans.groupBy(*by).agg(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("__spans"))


def _cut(both: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` from ``both``, which has them with a last column of spans."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(at))
            lists = b.column(len(names))
            loff, a, z = lists.offsets.to_numpy(), lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            texts = b.column(at)
            hit = np.flatnonzero(np.diff(loff))
            if len(hit):
                new: dict[int, str] = {}
                for i in hit.tolist():
                    raw = data[offsets[i] : offsets[i + 1]]
                    w = Words(raw, np.array([0, len(raw)]))
                    off = np.zeros(len(w) + 1, np.int64)
                    np.add.at(off, np.minimum(a[loff[i] : loff[i + 1]], len(w)), 1)
                    np.add.at(off, np.minimum(z[loff[i] : loff[i + 1]], len(w)), -1)
                    gone = np.cumsum(off)[:-1] > 0
                    cover = np.zeros(len(raw) + 1, np.int64)
                    till = np.append(w.start[1:], len(raw))  # up to the next word
                    cover[w.start[gone]] += 1
                    np.add.at(cover, till[gone], -1)
                    new[i] = raw[np.cumsum(cover)[:-1] == 0].tobytes().decode()
                py = texts.to_pylist()
                for i, t in new.items():
                    py[i] = t
                texts = pa.array(py, texts.type)
            columns = list(b.columns[: len(names)])
            columns[at] = texts
            if "n_chars" in names:
                k = names.index("n_chars")
                if len(hit):
                    counts = columns[k].to_pylist()
                    for i, t in new.items():
                        counts[i] = len(t)
                    columns[k] = pa.array(counts, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
