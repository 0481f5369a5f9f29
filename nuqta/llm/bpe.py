"""Byte-pair encoding and decoding with a public vocabulary.

The corpus' frequent words are compiled into a minimal acyclic transducer: sorted words are
added one by one, states with equal futures are shared, and each arc puts out a number, so
that the numbers along a word's path add up to its index in a table of token ids. The
transducer is one file, handed to every executor and memory-mapped. A chunk's distinct words
walk it together, one byte a step; those it lacks are merged exactly, pair by pair in rank
order, also together.

Text is split as by the usual pattern of contractions, ``" ?letters"``, ``" ?digits"``,
``" ?marks"`` and white space, by comparing the classes of neighbouring characters.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .textvec import _INV, _INV2, BASE, BASE2, U64, buffers, chunks, mix, powers, take_ranges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LETTER, DIGIT, SPACE, OTHER = range(4)
NO_RANK = np.int32(2**31 - 1)
#: Bytes of text whose distinct words are looked up together.
CHUNK = (1 << 20) - 16
#: Words up to this many bytes are merged in a matrix, longer ones with a heap.
MATRIX_BYTES = 64
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kind = {"L": LETTER, "N": DIGIT}
        t = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        t[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _classes.append(t)
    return _classes[0]


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the words of a chunk of texts begin; the words tile the chunk."""
    if not len(data):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    cls = classes()[cp]
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(lead, offsets)] = True  # of a text
    begins = begins[:n]
    runs = begins.copy()
    runs[1:] |= cls[1:] != cls[:-1]
    out = runs.copy()
    # a run after white space takes a last blank; another last white space stands alone
    i = np.flatnonzero(runs & ~begins & (cls != SPACE))
    i = i[cls[i - 1] == SPACE]
    out[i - 1] = True
    out[i[cp[i - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll: one apostrophe that begins a word, before letters
    i = np.flatnonzero((cp == 39) & out & runs)
    i = i[i + 1 < n]
    i = i[runs[i + 1] & ~begins[i + 1] & (cls[i + 1] == LETTER)]
    one = np.isin(cp[i + 1], np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
    two = np.zeros(len(i), bool)
    far = i + 2 < n
    j = i[far]
    pair = cp[j + 1].astype(np.int64) * 0x110000 + cp[j + 2]
    two[far] = np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")]) & ~begins[j + 2]
    out[i[one | two] + 1] = False
    after = np.concatenate([i[one] + 2, i[two] + 3])
    out[after[after < n]] = True
    return lead[out]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct word of a chunk, and each word's number among
    these. Words are told apart by two 64-bit hashes and then compared byte by byte."""
    ends = np.append(starts[1:], len(data))
    size = ends - starts
    h = size.astype(U64)
    for base, inverse in ((BASE, _INV), (BASE2, _INV2)):
        p, inv = powers(len(data) + 1, base, inverse)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=total[1:])
        h = mix(h ^ (total[ends] - total[starts]) * inv[starts])
    _, rep, number = np.unique(h, return_index=True, return_inverse=True)
    same = data[take_ranges(starts[rep[number]], size)] if (size[rep[number]] == size).all() else None
    if same is None or not np.array_equal(same, data):  # a collision: compare the words themselves
        seen: dict[bytes, int] = {}
        rep, number = [], np.empty(len(starts), np.int64)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            w = data[a:b].tobytes()
            if w not in seen:
                seen[w] = len(rep)
                rep.append(i)
            number[i] = seen[w]
        rep = np.array(rep, np.int64)
    return rep, number


class Vocabulary:
    """Token bytes by id, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for t, r in ranks.items():
            tokens[r] = t
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def pair_ranks(keys: np.ndarray, ranks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(left.shape, NO_RANK)
    want = (left.astype(np.int64) << 32) | right
    at = np.searchsorted(keys, want)
    at[at == len(keys)] = 0
    return np.where((keys[at] == want) & (left >= 0) & (right >= 0), ranks[at], NO_RANK)


def merge_long(parts: list[int], rank) -> list[int]:  # noqa: ANN001
    """Merge one word with a heap of pairs; the leftmost of equal ranks goes first."""
    nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    alive = [True] * len(parts)
    heap = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = nxt[i] if alive[i] else len(parts)
        if j >= len(parts) or rank(parts[i], parts[j]) != r:
            continue
        parts[i], alive[j], nxt[i] = r, False, nxt[j]
        if nxt[j] < len(parts):
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] < len(parts) and (s := rank(parts[a], parts[nxt[a]])) is not None:
                heapq.heappush(heap, (s, a))
    return [p for p, ok in zip(parts, alive, strict=True) if ok]


def merge_words(data: np.ndarray, starts: np.ndarray, size: np.ndarray, single: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words, one after the other, and how many each has."""
    count = np.zeros(len(starts), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bounds = [0, 4, 8, 12, 16, 24, 32, MATRIX_BYTES]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        of = np.flatnonzero((size > low) & (size <= high))
        if not len(of):
            continue
        cols = np.arange(high)
        inside = cols < size[of][:, None]
        parts = np.where(inside, single[data[np.minimum(starts[of][:, None] + cols, len(data) - 1)]], -1)
        parts = np.concatenate([parts, np.full((len(of), 2), -1)], 1).astype(np.int32)
        rank = pair_ranks(keys, ranks, parts[:, :-1], parts[:, 1:])
        live = np.arange(len(of))
        p, r = parts, rank
        while len(live):
            j = r.argmin(1)
            best = r[np.arange(len(r)), j]
            go = best < NO_RANK
            if not go.all():
                parts[live[~go]] = p[~go]
                live, p, r, j, best = live[go], p[go], r[go], j[go], best[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            p[rows, j] = best
            shift = np.arange(p.shape[1])[None] > j[:, None]
            p = np.where(shift, np.concatenate([p[:, 1:], np.full((len(p), 1), -1, np.int32)], 1), p)
            r = np.where(shift[:, : r.shape[1]], np.concatenate([r[:, 1:], np.full((len(r), 1), NO_RANK)], 1), r)
            r[rows, j] = pair_ranks(keys, ranks, p[rows, j], p[rows, j + 1])
            k = j > 0
            r[rows[k], j[k] - 1] = pair_ranks(keys, ranks, p[rows[k], j[k] - 1], p[rows[k], j[k]])
        real = parts >= 0
        count[of] = real.sum(1)
        found.append((of, parts[real]))
    long = np.flatnonzero(size > MATRIX_BYTES)
    if len(long):
        table = dict(zip(keys.tolist(), ranks.tolist(), strict=True))
        for i in long.tolist():
            ids = np.array(merge_long(single[data[starts[i] : starts[i] + size[i]]].tolist(), lambda a, b: table.get(a << 32 | b)), np.int32)
            count[i] = len(ids)
            found.append((np.array([i]), ids))
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for of, ids in found:
        out[take_ranges(first[of], count[of])] = ids
    return out, count


def build_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of sorted, distinct words: the outputs on a word's
    path add up to its index. arcs: key (state * 256 + byte, ascending), target, output;
    final: by state; root."""
    registry: dict[tuple, int] = {}
    states: list[tuple] = []
    futures: list[int] = []
    path: list[list] = [[False, []]]  # final, arcs [byte, target]

    def close(node: list) -> int:
        key = (node[0], tuple(map(tuple, node[1])))
        state = registry.get(key)
        if state is None:
            state = registry[key] = len(states)
            states.append(key)
            futures.append(node[0] + sum(futures[t] for _, t in node[1]))
        return state

    before = b""
    for w in words:
        same = 0
        limit = min(len(w), len(before))
        while same < limit and w[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1][-1][1] = close(node)
        for b in w[same:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        path[-1][0] = True
        before = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1][-1][1] = close(node)
    root = close(path[0])
    key, target, output = [], [], []
    for s, (final, arcs) in enumerate(states):
        ahead = int(final)
        for b, t in arcs:
            key.append(s * 256 + b)
            target.append(t)
            output.append(ahead)
            ahead += futures[t]
    return {"key": np.array(key, np.int64), "target": np.array(target, np.int32), "output": np.array(output, np.int32), "final": np.array([f for f, _ in states], np.uint8), "root": np.array([root], np.int64)}


def walk(t: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Index of each word in the lexicon, -1 if it lacks it; all words go a byte a step."""
    n = len(starts)
    out = np.full(n, -1, np.int64)
    if not len(t["key"]):
        return out
    live, state, total = np.arange(n), np.full(n, int(t["root"][0]), np.int64), np.zeros(n, np.int64)
    step = 0
    while len(live):
        want = state * 256 + data[starts[live] + step]
        at = np.searchsorted(t["key"], want)
        at[at == len(t["key"])] = 0
        ok = t["key"][at] == want
        live, at = live[ok], at[ok]
        state, total = t["target"][at].astype(np.int64), total[ok] + t["output"][at]
        step += 1
        done = size[live] == step
        end = done & (t["final"][state] == 1)
        out[live[end]] = total[end]
        live, state, total = live[~done], state[~done], total[~done]
    return out


FIELDS = ("key", "target", "output", "final", "root", "ids", "first", "blob", "offsets", "single", "pair_keys", "pair_ranks")
_TYPES = {"key": np.int64, "target": np.int32, "output": np.int32, "final": np.uint8, "root": np.int64, "ids": np.int32, "first": np.int64, "blob": np.uint8, "offsets": np.int64, "single": np.int32, "pair_keys": np.int64, "pair_ranks": np.int32}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    head = np.array([arrays[f].nbytes for f in FIELDS], np.int64).tobytes()
    body = b"".join(arrays[f].astype(_TYPES[f], copy=False).tobytes() + b"\0" * (-arrays[f].nbytes % 8) for f in FIELDS)
    return head + body


def unpack(blob: np.ndarray) -> dict[str, np.ndarray]:
    sizes = blob[: 8 * len(FIELDS)].view(np.int64)
    at, out = 8 * len(FIELDS), {}
    for f, n in zip(FIELDS, sizes.tolist(), strict=True):
        out[f] = blob[at : at + n].view(_TYPES[f])
        at += n + -n % 8
    return out


class Encoder:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        # these are looked up for every word that the lexicon lacks
        self.keys, self.ranks, self.single = (np.ascontiguousarray(arrays[k]) for k in ("pair_keys", "pair_ranks", "single"))

    def words(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, and where each word's begin and how many they are."""
        a = self.a
        index = walk(a, data, starts, size)
        known = index >= 0
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[known], count[known] = a["first"][index[known]], a["first"][index[known] + 1] - a["first"][index[known]]
        more, n = merge_words(data, starts[~known], size[~known], self.single, self.keys, self.ranks)
        first[~known], count[~known] = len(a["ids"]) + np.cumsum(n) - n, n
        return np.concatenate([a["ids"], more]), first, count

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a chunk of texts and the number of each text's."""
        starts = split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        rep, number = distinct(data, starts)
        size = np.append(starts[1:], len(data)) - starts
        ids, first, count = self.words(data, starts[rep], size[rep])
        per = count[number]
        out = ids[take_ranges(first[number], per)]
        until = np.concatenate([[0], np.cumsum(per)])[np.searchsorted(starts, offsets)]
        return out.astype(np.int32), np.diff(until)

    def bytes_of(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of ids and the offsets of each list's; ids out of range are passed
        over."""
        o = self.a["offsets"]
        ok = (ids >= 0) & (ids < len(o) - 1)
        safe = np.where(ok, ids, 0)
        size = np.where(ok, o[safe + 1] - o[safe], 0)
        until = np.concatenate([[0], np.cumsum(size)])
        return self.a["blob"][take_ranges(o[safe], size)], until[offsets]


@dataclass(frozen=True)
class Codec:
    """``name`` of the file that Spark hands to the executors."""

    name: str


_mapped: dict[str, Encoder] = {}


def _encoder(codec: Codec) -> Encoder:
    if codec.name not in _mapped:
        from pyspark import SparkFiles

        _mapped.clear()
        _mapped[codec.name] = Encoder(unpack(np.memmap(SparkFiles.get(codec.name), np.uint8, "r")))
    return _mapped[codec.name]


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n: over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(0))
            for i, j in chunks(offsets, CHUNK):
                d = data[offsets[i] : offsets[j]]
                starts = split(d, offsets[i : j + 1] - offsets[i])
                if not len(starts):
                    continue
                rep, number = distinct(d, starts)
                size = (np.append(starts[1:], len(d)) - starts)[rep]
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(rep), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(d[take_ranges(starts[rep], size)].tobytes())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(number, minlength=len(rep)).astype(np.int64))], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The file of a lexicon of these words."""
    words = sorted(set(words) - {b""})
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    v = vocabulary
    ids, count = merge_words(data, np.cumsum(size) - size, size, v.single, v.pair_keys, v.pair_ranks)
    return pack(build_transducer(words) | {"ids": ids, "first": np.concatenate([[0], np.cumsum(count)]), "blob": v.blob, "offsets": v.offsets, "single": v.single, "pair_keys": v.pair_keys, "pair_ranks": v.pair_ranks})


def fit(docs: DataFrame, *, vocabulary: str = VOCABULARY, lexicon_words: int = 1 << 17) -> Codec:
    """Compile the most frequent words of all texts: as many counts, from the top, as have
    ``lexicon_words`` words together at most. What is beyond these is encoded all the same, by
    merging. The vocabulary is read on the driver."""
    counts = written(count_words(docs).where((F.col("n") > 1) & (F.octet_length("word") <= 255)), "words")
    # words by count: no task sorts the words themselves
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = by_count.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("above")).where(F.col("above") <= lexicon_words)
    least = above.agg(F.min("n")).first()[0]
    words = counts.where(F.col("n") >= least).select("word").toArrow().column("word").to_pylist() if least else []
    return Codec(ship(docs.sparkSession, "lexicon.bin", compile_lexicon(words, Vocabulary.read(vocabulary))))


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, token_ids and n_tokens of every row of ``docs``; the ids are those of the
    vocabulary's merges, special tokens' strings being ordinary text.

    A null text has null ids and count, an empty one an empty list and 0; a null doc_id is
    kept; repeated rows give repeated results; a text of any length is encoded whole; an
    empty table gives an empty result. Only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(codec)
        for b in batches:
            data, offsets = buffers(b.column(1))
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, CHUNK):
                ids, n = e.chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                off = null[i:j]
                lists = pa.ListArray.from_arrays(at, pa.array(ids), mask=pa.array(off) if off.any() else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array(n.astype(np.int32), mask=off)], names=["doc_id", "token_ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens int")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """The columns of ``encode`` with ``decoded``, the text of the ids.

    Null ids decode to null, an empty list to an empty text; ids that are null or out of
    range are passed over; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(codec)
        for b in batches:
            lists = b.column(1)
            lo, hi = (lists.offsets[0].as_py(), lists.offsets[-1].as_py()) if len(lists) else (0, 0)
            ids = lists.values.slice(lo, hi - lo).fill_null(-1).to_numpy()
            offsets = lists.offsets.to_numpy().astype(np.int64) - lo
            null = lists.is_null().to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets * 4, CHUNK):
                raw, at = e.bytes_of(ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                off = null[i:j]
                bits = pa.py_buffer(np.packbits(~off, bitorder="little").tobytes()) if off.any() else None
                texts = pa.Array.from_buffers(pa.large_binary(), j - i, [bits, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
                try:
                    texts = texts.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns], texts], names=["doc_id", "token_ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "token_ids", "n_tokens").mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens int, decoded string")
