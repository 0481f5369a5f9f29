"""Word splitting, BPE and media."""

import base64
import itertools
import os
import random

import edges
import numpy as np
import pyarrow as pa
import pytest

from nuqta.llm import bpe, iso_media
from nuqta.llm.textvec import Words, buffers, chunks, grams, hash_word, words_of

TEXTS = [r[1] for r in edges.ROWS]


def test_words_and_hashes():
    data, offsets = buffers(pa.array(TEXTS))
    for i, j in chunks(offsets, 500):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for d in range(j - i):
            want = words_of(TEXTS[i + d])
            own = slice(w.first[d], w.first[d + 1])
            assert len(want) == own.stop - own.start
            got = [hash_word(x) for x in want[:200]]
            assert got == w.hash[own].tolist()[:200]


def test_grams_tell_runs_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 2], np.uint64)
    g = grams(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4
    assert len(grams(h, 8)) == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.VOCABULARY)


def reference():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@pytest.mark.parametrize("words", [[], [b"the", b" the", b" other", b" mother", b" brother", b"'s", b"\n"]])
def test_bpe_is_exact(vocabulary, words):
    rng = random.Random(3)
    alphabet = " '\n\t\r 　stmdrevl'LLéß漢٣5!?.😀_-aZ"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)] + ["it's they'll 'sfoo ''s 's's \n's <|endoftext|>"]
    e = bpe.Encoder(bpe.unpack(np.frombuffer(bpe.compile_lexicon(words, vocabulary), np.uint8)))
    data, offsets = buffers(pa.array(texts))
    parts = [e.chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    ids, at = np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
    plain = reference()
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode_ordinary(t), t[:60]
    raw, _ = e.bytes_of(ids, at)
    assert raw.tobytes() == data.tobytes()


def test_transducer_is_minimal_and_indexes():
    words = sorted(a + b + c for a, b, c in itertools.product([b"un", b"re", b"x"], [b"do", b"tie", b"make"], [b"s", b"ing", b""]))
    t = bpe.build_transducer(words)
    data = np.frombuffer(b"".join(words) + b"undone", np.uint8)
    size = np.array([len(w) for w in words] + [6])
    index = bpe.walk(t, data, np.cumsum(size) - size, size)
    assert index.tolist() == [*range(len(words)), -1]
    # Myhill-Nerode: as many states as there are different sets of continuations
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(t["final"]) == len(futures)


@needs_vocabulary
def test_bpe_tables(spark):
    df = edges.docs(spark, edges.ROWS)
    codec = bpe.fit(df, lexicon_words=50)
    rows = bpe.decode(bpe.encode(df, codec), codec).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.decoded or "") for r in rows)) == sorted((i is None, i or 0, t or "") for i, t, _ in edges.ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[3].token_ids == [] and by[3].n_tokens == 0 and by[3].decoded == ""
    assert by[4].token_ids is None and by[4].n_tokens is None and by[4].decoded is None
    assert all(r.token_ids is None or len(r.token_ids) == r.n_tokens for r in rows)
    odd = spark.createDataFrame([(1, [-1, None, 10**6, 64], 4), (2, [255, 200], 2)], "doc_id long, token_ids array<int>, n_tokens int")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd, codec).collect()}[1] == "a"
    empty = df.where("false")
    assert bpe.decode(bpe.encode(empty, bpe.fit(empty)), codec).collect() == []


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("fragmented", [False, True])
@pytest.mark.parametrize("n", [0, 1, 399, 400, 401, 5000, 40000])
def test_media_ranges_give_the_payload(wide, fragmented, n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    f = iso_media.mux(payload, wide=wide, fragmented=fragmented, every=5)
    brand, tracks = iso_media.parse(f)
    at, size, time, key, shown = tracks[0].samples()
    assert brand == "isom" and tracks[0].codec == "avc1.64001f"
    assert b"".join(f[a : a + s] for a, s in zip(at, size, strict=True)) == payload
    assert np.flatnonzero(key).tolist() == list(range(0, len(size), 5))
    assert time.tolist() == shown.tolist() == [512 * k for k in range(len(size))]
    if not fragmented:
        at, size, _, key, _ = tracks[1].samples()
        assert tracks[1].handler == "soun" and key.all()
        assert b"".join(f[a : a + s] for a, s in zip(at, size, strict=True)) == payload[: n // 64 * 64]


def atom(kind, *body):
    data = b"".join(body)
    return (8 + len(data)).to_bytes(4, "big") + kind + data


def u32(*values):
    return b"".join((v % 2**32).to_bytes(4, "big") for v in values)


def by_hand(stbl, *, timescale=1000, number=7, extra=b""):
    """A file whose boxes have version-1 headers, written without the library's own writer."""
    long = lambda *v: b"".join(x.to_bytes(8, "big") for x in v)
    tkhd = atom(b"tkhd", u32(1 << 24), long(0, 0), u32(number, 0), long(5000), bytes(60))
    mdhd = atom(b"mdhd", u32(1 << 24), long(0, 0), u32(timescale), long(5000), bytes(4))
    hdlr = atom(b"hdlr", u32(0, 0), b"vide", bytes(13))
    stsd = atom(b"stsd", u32(0, 1), atom(b"hvc1", bytes(78)))
    uuid = atom(b"uuid", bytes(range(16)), b"whatever")
    trak = atom(b"trak", tkhd, uuid, atom(b"mdia", mdhd, hdlr, atom(b"minf", atom(b"stbl", stsd, *stbl))))
    return atom(b"ftyp", b"mp42", u32(0)) + atom(b"moov", trak, extra)


def tables_by_hand(places=(100, 200)):
    return [
        atom(b"stts", u32(0, 1, 5, 40)),
        atom(b"ctts", u32(1 << 24, 2, 1, 80, 1, -20)),
        atom(b"stss", u32(0, 2, 1, 2)),
        atom(b"stsc", u32(0, 2, 1, 3, 1, 2, 2, 1)),
        atom(b"stz2", u32(0, 4, 5), bytes([0x12, 0x34, 0x50])),
        atom(b"stco", u32(0, len(places), *places)),
    ]


def test_media_by_hand():
    brand, (t,) = iso_media.parse(by_hand(tables_by_hand()))
    at, size, time, key, shown = (x.tolist() for x in t.samples())
    assert (brand, t.id, t.handler, t.codec, t.timescale, t.duration) == ("mp42", 7, "vide", "hvc1", 1000, 5000)
    assert size == [1, 2, 3, 4, 5] and at == [100, 101, 103, 200, 204]
    assert time == [0, 40, 80, 120, 160] and shown == [80, 20, 80, 120, 160] and key == [True, True, False, False, False]
    # fragments: durations, sizes and flags from trex, then from tfhd; signed composition offsets
    trex = atom(b"mvex", atom(b"trex", u32(0, 7, 1, 20, 6, 0x10000)))
    first = atom(b"moof", atom(b"traf", atom(b"tfhd", u32(0, 7)), atom(b"trun", u32(0x5, 2, 1000, 0))))
    second = atom(b"moof", atom(b"traf", atom(b"tfhd", u32(0x38, 7, 5, 9, 0)), atom(b"tfdt", u32(1 << 24, 0, 700)), atom(b"trun", u32(0x1000801, 2, -4, -3, 4))))
    _, (t,) = iso_media.parse(by_hand([], extra=trex) + first + second)
    at, size, time, key, shown = (x.tolist() for x in t.samples())
    head = len(by_hand([], extra=trex))
    assert size == [6, 6, 9, 9] and time == [0, 20, 700, 705] and shown == [0, 20, 697, 709]
    assert at == [head + 1000, head + 1006, head + len(first) - 4, head + len(first) + 5] and key == [True, False, True, True]


def test_media_damage_is_reported():
    """Whatever is wrong with a file is a Malformed and no other exception: cut boxes, empty
    ones, and bytes at their extremes."""
    fragments = iso_media.mux(bytes(900), every=3, sample=100, fragmented=True)
    empty = [atom(b"moov", atom(b"trak", atom(k))) for k in (b"tkhd", b"edts")]
    empty += [atom(b"moov", atom(b"trak", atom(b"mdia", atom(k)))) for k in (b"mdhd", b"hdlr")] + [by_hand([atom(k)]) for k in (b"stsd", b"stts", b"stsz", b"stz2", b"stco", b"co64", b"ctts")]
    empty += [fragments + atom(b"moof", atom(b"traf", atom(k))) for k in (b"tfhd", b"tfdt", b"trun")]
    nested = b""
    for _ in range(5000):
        nested = atom(b"mdia", nested)
    files = [iso_media.mux(bytes(300), every=3, sample=40), iso_media.mux(bytes(300), every=3, sample=40, wide=True), fragments, by_hand(tables_by_hand()), *empty]
    rng = random.Random(5)

    def read(data):
        try:
            for t in iso_media.parse(data)[1]:
                for x in t.samples():
                    assert len(x) <= 8 * len(data)
        except iso_media.Malformed:
            return 1
        return 0

    assert all(read(f) for f in empty if b"edts" not in f) and read(atom(b"moov", atom(b"trak", nested)))
    damaged = 0
    for k in range(20000):
        g = bytearray(files[k % len(files)])
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([1, 1, 4, 8])
            at = rng.randrange(max(1, len(g) - n))
            g[at : at + n] = rng.choice([bytes(n), b"\xff" * n, b"\x7f" + b"\xff" * (n - 1), rng.randbytes(n)])
        damaged += read(bytes(g[: rng.randrange(len(g) + 1)] if k % 5 == 0 else g))
    assert damaged > 5000


def test_media_tables(spark):
    f = iso_media.mux(b"x" * 1000, every=2)
    rows = [(1, f), (1, f), (2, None), (3, b""), (4, f[:100]), (None, f), (5, b"not a box at all"), (6, iso_media.mux(b"", fragmented=True))]
    df = spark.createDataFrame(rows, "media_id long, content binary").selectExpr("content", "'x' as codec", "media_id", "1 as track_id")
    out = iso_media.tracks(df).collect()
    assert [sum(r.media_id == k for r in out) for k in (1, 2, 3, 4, None, 5, 6)] == [4, 1, 1, 1, 2, 1, 1]
    by = {r.media_id: r for r in out}
    assert by[2].error == "null" and by[3].error == "no moov box" and by[4].error and by[5].error and by[6].error is None
    video = next(r for r in out if r.media_id == 1 and r.handler == "vide")
    assert video.n_samples == 3 and video.n_bytes == 1000 and video.duration_s == pytest.approx(3 * 512 / 12800)
    assert [f[k.offset : k.offset + k.size] for k in video.keyframes] == [b"x" * 400, b"x" * 200]
    assert iso_media.tracks(df.where("false")).collect() == []
    media = iso_media.media_of(edges.docs(spark, edges.ROWS))
    assert {r.media_id: r.error for r in iso_media.tracks(media).collect()}[4] == "null"
