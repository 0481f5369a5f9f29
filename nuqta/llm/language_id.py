"""Language identification with a convolutional network over bytes.

Filters of several widths slide over fixed-length windows of bytes; their maxima over the
window feed a softmax. It is trained here in numpy on labelled text. At inference each
filter is a sum of table rows (one for each byte pair and byte under it), so a window costs
lookups, additions and maxima; a document's windows cover its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows
from .textvec import buffers, chunks

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 16


@dataclass
class Net:
    """Parameters; ``labels`` are the classes, the last of them ``und``."""

    labels: list[str]
    emb: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair table (65536, 4F): width 2, width 3's and 4's first pairs, width 4's second
        pair; byte table (256, F): width 3's last byte. Biases are in the first parts."""
        one = {w: [self.emb @ self.kernels[w][j * DIM : (j + 1) * DIM] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        t = np.concatenate([pair(one[2][0], one[2][1]) + self.biases[2], pair(one[3][0], one[3][1]) + self.biases[3], pair(one[4][0], one[4][1]) + self.biases[4], pair(one[4][2], one[4][3])], 1)
        return np.ascontiguousarray(t, np.float32), np.ascontiguousarray(one[3][2], np.float32)

    def windows(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Class probabilities of windows (n, WINDOW) of bytes."""
        pairs, last = tables
        n, f = len(x), FILTERS
        xt = np.ascontiguousarray(x.T)
        idx = xt[:-1].astype(np.int32) * 256 + xt[1:]
        a2, a3, a4 = (np.zeros((n, f), np.float32) for _ in WIDTHS)  # zero: the maxima are rectified
        ring = [np.empty((n, 4 * f), np.float32) for _ in range(3)]
        third, sums = np.empty((n, f), np.float32), np.empty((n, f), np.float32)
        for t in range(2):
            np.take(pairs, idx[t], 0, out=ring[t], mode="clip")
        for t in range(WINDOW - 1):
            q = ring[t % 3]
            np.maximum(a2, q[:, :f], out=a2)
            if t + 2 < WINDOW:
                np.take(last, xt[t + 2], 0, out=third, mode="clip")
                np.maximum(a3, np.add(q[:, f : 2 * f], third, out=sums), out=a3)
            if t + 3 < WINDOW:
                ahead = np.take(pairs, idx[t + 2], 0, out=ring[(t + 2) % 3], mode="clip")
                np.maximum(a4, np.add(q[:, 2 * f : 3 * f], ahead[:, 3 * f :], out=sums), out=a4)
        return softmax(np.concatenate([a2, a3, a4], 1) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a chunk of texts (zero-padded at each text's end), the number of
    windows of each text, and the bytes of text in each window."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    first = np.cumsum(count) - count
    padded = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], lengths)] = data
    filled = np.full(len(padded) // WINDOW, WINDOW)
    some = count > 0
    filled[(first + count - 1)[some]] = (lengths - (count - 1) * WINDOW)[some]
    return padded.reshape(-1, WINDOW), count, filled


def noise(rng: np.random.Generator, real: np.ndarray, n: int) -> np.ndarray:
    """Windows of no language: shuffled text, random bytes, letters, digits and marks."""
    out = np.empty((n, WINDOW), np.uint8)
    for i in range(n):
        kind = i % 4
        if kind == 0:
            out[i] = rng.permutation(real[rng.integers(len(real))])
        elif kind == 1:
            out[i] = rng.integers(0, 256, WINDOW)
        elif kind == 2:
            out[i] = rng.integers(97, 123, WINDOW)
        else:
            out[i] = rng.choice(np.frombuffer(b"0123456789 .,;:-_/()[]{}<>=+*&%$#@!?\"'\n", np.uint8), WINDOW)
    return out


def fit(texts: list[str], langs: list[str], *, epochs: int = 8, max_windows: int = 9000, seed: int = 7) -> Net:
    """Train on texts with their languages; ``max_windows`` bounds the windows, drawn at
    random from all windows of the texts."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    win, count, filled = cut_windows(np.frombuffer(b"".join(raw), np.uint8), offsets)
    y = np.repeat([labels.index(x) for x in langs], count)
    good = np.flatnonzero(filled >= 16)
    pick = []
    for c in range(len(labels)):  # as many of each language
        own = good[y[good] == c]
        pick.append(rng.permutation(own)[: max_windows // (len(labels) + 1)])
    pick = np.concatenate(pick) if pick else np.zeros(0, int)
    x, y = win[pick].copy(), y[pick]
    for i in np.flatnonzero(rng.random(len(x)) < 0.4):  # short texts occur too
        x[i, int(np.exp(rng.uniform(np.log(4), np.log(WINDOW)))) :] = 0
    if len(x):
        x = np.concatenate([x, noise(rng, x, max(8, len(x) // max(1, len(labels))))])
        y = np.concatenate([y, np.full(len(x) - len(y), len(labels))])
    classes = [*labels, UNKNOWN]
    g = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
    p = {"emb": g(256, DIM, k=0.5), "out": g(len(WIDTHS) * FILTERS, len(classes), k=0.2), "out_bias": np.zeros(len(classes), np.float32)}
    for w in WIDTHS:
        p[f"k{w}"], p[f"b{w}"] = g(w * DIM, FILTERS, k=1 / np.sqrt(w * DIM)), np.zeros(FILTERS, np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            xb, yb = x[order[at : at + 64]], y[order[at : at + 64]]
            step += 1
            for k, grad in _grads(p, xb, yb).items():
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad * grad - m2[k])
                p[k] -= 0.004 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Net(classes, p["emb"], {w: p[f"k{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["out"], p["out_bias"])


def _grads(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n = len(x)
    e = p["emb"][x]
    hidden, at = [], {}
    for w in WIDTHS:
        cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # n, L, DIM, w
        cols = np.ascontiguousarray(cols.transpose(0, 1, 3, 2)).reshape(n, WINDOW - w + 1, w * DIM)
        z = cols @ p[f"k{w}"] + p[f"b{w}"]
        best = z.argmax(1)
        at[w] = best, cols[np.arange(n)[:, None], best]
        hidden.append(np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0], 0))
    h = np.concatenate(hidden, 1)
    d = softmax(h @ p["out"] + p["out_bias"])
    d[np.arange(n), y] -= 1
    d /= n
    grads = {"out": h.T @ d, "out_bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
    dh = (d @ p["out"].T) * (h > 0)
    for i, w in enumerate(WIDTHS):
        own = dh[:, i * FILTERS : (i + 1) * FILTERS]
        best, under = at[w]
        grads[f"k{w}"] = np.einsum("nf,nfk->kf", own, under)
        grads[f"b{w}"] = own.sum(0)
        back = own[:, :, None] * p[f"k{w}"].T[None]
        for j in range(w):
            np.add.at(grads["emb"], x[np.arange(n)[:, None], best + j], back[:, :, j * DIM : (j + 1) * DIM])
    return grads


_built: dict[int, tuple[Net, tuple[np.ndarray, np.ndarray]]] = {}


def classify(net: Net, column: pa.Array, max_unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Class index and confidence of each text by the mean of its windows' probabilities,
    weighted by their bytes: ``und`` where that class has more than ``max_unknown``, else
    the likeliest language. A null or empty text is ``und`` with confidence 0."""
    tables = net.tables() if id(net) not in _built else _built[id(net)][1]
    _built.clear()
    _built[id(net)] = net, tables
    data, offsets = buffers(column)
    cls, conf = np.full(len(column), len(net.labels) - 1), np.zeros(len(column))
    for i, j in chunks(offsets):
        off = offsets[i : j + 1] - offsets[i]
        win, count, filled = cut_windows(data[offsets[i] : offsets[j]], off)
        if not len(win):
            continue
        prob = np.concatenate([net.windows(win[a : a + 1024], tables) for a in range(0, len(win), 1024)])
        some = np.flatnonzero(count)
        total =  np.add.reduceat(prob * filled[:, None], (np.cumsum(count) - count)[some]) / np.diff(off)[some, None]
        best = np.where(total[:, -1] > max_unknown, total.shape[1] - 1, total[:, :-1].argmax(1)) if total.shape[1] > 1 else np.zeros(len(total), int)
        cls[i + some], conf[i + some] = best, total[np.arange(len(best)), best]
    return cls, conf


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows of each language are drawn: as many of each, as far as it has them."""
    out = {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, (rows - sum(out.values())) // (len(counts) - i))
    return out


def draw(docs: DataFrame, rows: int, seed: int) -> list[dict]:
    """doc_id, lang and text of each language's rows that come first by a hash of doc_id and
    text, wherever they lie in the table."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return []
    quota = quotas(counts, rows)
    of = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("lang")]
    top = 2**63 - 1
    placed = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    for spare in (1, 16, math.inf):  # rows that repeat share a hash, so that a draw may be short
        below = {k: top if (share := spare * (1.3 * q + 100) / counts[k]) >= 1 else int(share * top) for k, q in quota.items()}
        few = labelled.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 1)).where(F.col("hash") <= of(below))
        out = few.withColumn("place", F.row_number().over(placed)).where(F.col("place") <= of(quota)).select("doc_id", "lang", "text").toArrow().to_pylist()
        if len(out) == sum(quota.values()):
            break
    return out


def train(docs: DataFrame, *, fit_rows: int = 3000, seed: int = 7) -> Net:
    """Fit on a bounded sample of ``docs`` that have a ``lang``: ``fit_rows`` rows, drawn by
    a hash for each language, is the documented bound of the labelled sample. Each language
    is in it, or the most frequent ``fit_rows``."""
    from .common import shared_dir

    shared_dir(docs.sparkSession)
    rows = draw(docs, fit_rows, seed)
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], seed=seed)


def identify(docs: DataFrame, net: Net, *, max_unknown: float = 0.7) -> DataFrame:
    """doc_id, language, confidence and accepted of every row of ``docs``.

    Reads only doc_id and text, so other columns of any name do no harm. A null or empty
    text is ``und`` with confidence 0 and not accepted; a null doc_id is kept; repeated
    rows give repeated results; an empty table gives an empty result. Every text is
    classified over its whole length. Ties go to the language first in the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(net.labels)
        for batch in batches:
            cls, conf = classify(net, batch.column(1), max_unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels[cls], pa.string()), pa.array(conf, pa.float64()), pa.array(cls < len(labels) - 1)],
                names=["doc_id", "language", "confidence", "accepted"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, language string, confidence double, accepted boolean")


def keep_identified(docs: DataFrame, net: Net, *, max_unknown: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with all their columns; ``lang``
    becomes the language found."""
    at = docs.columns.index("text")

    def judge(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        cls, conf = classify(net, batch.column(at), max_unknown)
        return cls < len(net.labels) - 1, {"lang": pa.array(np.array(net.labels)[cls], pa.string())}

    return keep_rows(docs, judge)
