"""Near duplicates, repeated passages and repeated sentences."""

import random
from collections import defaultdict

import duckdb
import edges
import numpy as np
import pytest

from nuqta.llm import bwt_dedup, near_dup, sentence_spans
from nuqta.llm.textvec import words_of

VOCAB = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def jaccard(a, b):
    pairs = lambda w: set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w)
    a, b = pairs(words_of(a)), pairs(words_of(b))
    return len(a & b) / len(a | b) if a or b else 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.6, 0.7, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(20):
            every = rng.integers(0, 1 << 32, 1000, np.uint32)
            cut = int(1000 * (1 - share) / 2)
            a, b = every[: 1000 - cut], every[cut:]
            sk = near_dup.sketch(near_dup.minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
            errors.append(float(near_dup.estimate(int(np.unpackbits(sk[0] ^ sk[1]).sum()))) - (1000 - 2 * cut) / 1000)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
    assert near_dup.estimate(near_dup.max_distance(0.55)) >= 0.55


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(40):
        base = prose(rng, rng.randrange(30, 300))
        for copy in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(int(len(w) * 0.013 * copy)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((n, " ".join(w).capitalize() + "." if g % 2 else " ".join(w)))
            n += 1
    rng.shuffle(rows)
    df = edges.docs(spark, rows)
    got = {r.doc_id: (r.class_id, r.links) for r in near_dup.near_duplicates(df).collect()}
    texts = dict(rows)
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            j = jaccard(texts[a], texts[b])
            assert j < 0.4 or j > 0.62  # nothing in doubt
            if j > 0.55:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    # links: all pairs that share a band and whose sketches are near, counted one by one
    sk = {r.doc_id: r for r in near_dup.sketches(df).collect()}

    def linked(x, y):
        apart = (int.from_bytes(x.sketch) ^ int.from_bytes(y.sketch)).bit_count()
        return any(p == q for p, q in zip(x.bands, y.bands, strict=True)) and apart <= near_dup.max_distance(0.55)

    links = []
    for a in range(n):
        near = [sk[b] for b in range(n) if b != a and linked(sk[a], sk[b])]
        copies = [x for x in near if x.sig_a == sk[a].sig_a]
        links.append(len(copies) + len({x.sig_a for x in near} - {sk[a].sig_a}))
    assert got == {i: (g, links[i]) for i, g in enumerate(group) if links[i]}
    # bands of more than one block are compared in tiles, with the same result
    for tile in (2,):
        tiled = near_dup.classify(df, tile=tile).where("links > 0").collect()
        assert {r.doc_id: (r.class_id, r.links) for r in tiled} == got
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(group))


def test_near_duplicates_edges(spark):
    df = edges.docs(spark, edges.ROWS)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert near_dup.near_duplicates(df.where("false")).collect() == [] == near_dup.keep_one(df.where("false")).collect()
    many = edges.docs(spark, [(i, edges.PROSE * 3) for i in range(300)] + [(1000, "other words than these here")])
    assert sorted(tuple(r) for r in near_dup.near_duplicates(many).collect()) == [(i, 0, 299) for i in range(300)]
    assert sorted(r.doc_id for r in near_dup.keep_one(many).collect()) == [0, 1000]
    kept = near_dup.keep_one(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and len(ids) == len(edges.ROWS) - 2 and 2 not in ids and ids.count(None) == 2


def test_one_id_with_several_texts(spark):
    other = "other words than these are here and they go on for a while " * 3
    df = edges.docs(spark, [(1, edges.PROSE * 3), (1, other), (2, other), (1, other), (3, edges.PROSE * 3)])
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert sorted((r.doc_id, r.text) for r in near_dup.keep_one(df).collect()) == sorted([(1, edges.PROSE * 3), (1, other)])


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    group = list(range(200))
    for a, b in pairs:
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    got = dict(tuple(r) for r in near_dup.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: g for i, g in enumerate(group) if i != g}


def passages_by_brute_force(rows, length):
    seen, out = {}, {}
    for doc, text in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        w = words_of(text)
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            if g in seen:
                out[doc, p] = seen[g]
            else:
                seen[g] = doc, p
    return out


def passages_of(df, length, **options):
    got = {}
    for r in bwt_dedup.repeated_passages(df, length=length, **options).collect():
        for k in range(r.end_word - r.start_word - length + 1):
            assert (r.doc_id, r.start_word + k) not in got
            got[r.doc_id, r.start_word + k] = r.source_id, r.source_word + k
    return got


@pytest.mark.parametrize("length", [20, 50])
def test_passages_against_brute_force(spark, length):
    rng = random.Random(length)
    shared = [prose(rng, rng.randrange(length - 3, 3 * length)) for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += prose(rng, rng.randrange(60)) + rng.choice(shared)
        rows.append((i, " ".join(w)))
    rows += [(70, "same " * 400), (71, "same " * (length + 3)), (72, "a b " * 200), (73, "same " * length), (74, rows[3][1]), (3, rows[3][1])]
    df, want = edges.docs(spark, rows), passages_by_brute_force(rows, length)
    assert passages_of(df, length) == want
    assert passages_of(df, length, hot=100) == want  # some keys by merging, some by hashes
    assert passages_of(df, length, hot=0) == want


def test_interleave_of_many_shards():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 3, rng.integers(20, 60), np.uint32) for _ in range(60)]
    tokens, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    stretches = [tuple(t[p : p + 20]) for t in texts for p in range(len(t) - 19)]
    for shard_words in (10**9, 300, 1):
        number = bwt_dedup.repeats_in(tokens, first, 20, shard_words)
        assert len(set(zip(number.tolist(), stretches, strict=True))) == len(set(number.tolist())) == len(set(stretches))


def test_common_prefixes():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]

    def shard(own):
        symbol = np.concatenate([np.append(t, 0) for t in own])
        end = symbol == 0
        follows = np.where(end, np.arange(len(symbol)), np.arange(len(symbol)) + 1)
        before = np.concatenate([[0], np.where(end[:-1], 0, symbol[:-1])])
        return bwt_dedup.Shard(symbol, follows, before), symbol, follows

    shards = [shard(texts[:25]), shard(texts[25:])]
    z, common = bwt_dedup.merge([s[0].bwt for s in shards])
    at, rows = [0, 0], []
    for k in z.tolist():
        s, symbol, follows = shards[k]
        p, word = s.row[at[k]], []
        at[k] += 1
        while symbol[p] and len(word) < bwt_dedup.ROUNDS:
            word.append(int(symbol[p]))
            p = follows[p]
        rows.append(word)
    assert rows == sorted(rows)
    for a, b, c in zip(rows, rows[1:], common[1:].tolist(), strict=False):
        lcp = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if len(a) == len(b) == bwt_dedup.ROUNDS or lcp < min(len(a), len(b)):
            assert c == lcp


def test_passages_edges(spark):
    df = edges.docs(spark, edges.ROWS)
    assert passages_of(df, 50) == passages_by_brute_force([r[:2] for r in edges.ROWS], 50)
    assert bwt_dedup.repeated_passages(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        bwt_dedup.repeated_passages(df, length=51)


def test_cut_repeats(spark):
    df = edges.docs(spark, [(1, "Én, two; three four."), (2, "a b c"), (3, None), (4, ""), (None, "x y")])
    spans = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 0, 3), (9, 0, 1)], "doc_id long, start_word long, end_word long")
    out = bwt_dedup.cut_repeats(df, spans)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("Én, four.", 9), 2: ("", 0), 3: (None, None), 4: ("", 0), None: ("x y", 3)}


def test_remove_passages(spark):
    rng = random.Random(12)
    shared, own = prose(rng, 80), [prose(rng, 30) for _ in range(4)]
    rows = [(1, " ".join(own[0] + shared)), (2, " ".join(own[1] + shared + own[2])), (2, " ".join(own[3])), (2, " ".join(own[3])), (3, None), (None, " ".join(shared)), (4, "")]
    df = edges.docs(spark, rows)
    out = bwt_dedup.remove_passages(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in out.collect())
    cut = " ".join(own[1] + own[2])
    assert got == sorted((i or 0, t or "", None if t is None else len(t)) for i, t in [rows[0], (2, cut), *rows[2:]])
    assert bwt_dedup.remove_passages(df.where("false")).collect() == []
    again = edges.docs(spark, edges.ROWS)
    assert bwt_dedup.remove_passages(again).count() == len(edges.ROWS)


def sentence_rows(rng, n):
    sentence = lambda: " ".join(prose(rng, rng.randrange(1, 9))).capitalize() + rng.choice([". ", "! ", "?\n", ".\n\n", "..."])
    shared = ["".join(sentence() for _ in range(rng.randrange(3, 9))) for _ in range(6)]
    return [(i, "".join(rng.choice([sentence(), rng.choice(shared)]) for _ in range(rng.randrange(8)))) for i in range(n)]


def test_sentences_against_sql(spark):
    rows = sentence_rows(random.Random(8), 80)
    rows += [r[:2] for r in edges.ROWS if r[0] != 12] + [(90, "One two. " * 30), (91, "A. B. C. D. A. B. C. D.")]
    df = edges.docs(spark, rows)
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    want = sorted(duckdb.sql(sentence_spans.repeated_sentences_sql()).fetchall())
    got = sorted(tuple(r) for r in sentence_spans.repeated_sentences(df).collect())
    assert got == want and got
    # runs that many places share are split into groups, with the same result
    for group in (1, 5, 4096):
        assert sorted(tuple(r) for r in sentence_spans.repeated_sentences(df, often=2, share=1.0, group=group).collect()) == want
    assert sentence_spans.repeated_sentences(df.where("false")).collect() == []


def test_remove_sentences(spark):
    df = edges.docs(spark, [(1000 + i, t) for i, t in sentence_rows(random.Random(18), 60)] + edges.ROWS)
    changed = {r.doc_id: r.text for r in sentence_spans.repeated_sentences(df).collect()}
    out = sentence_spans.remove_sentences(df)
    assert out.columns == df.columns
    whole = sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert got == sorted((i, changed.get(i, t)) for i, t in whole) and got != whole
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())
    assert sentence_spans.remove_sentences(df.where("false")).collect() == []
    two = [(1, "".join(f"Sentence {k} of a passage that is long enough to be found. " for k in range(4))), (2, "Own words. "), (2, "")]
    two.append((2, two[0][1]))  # texts that share an id
    left = sorted((r.doc_id, r.text) for r in sentence_spans.remove_sentences(edges.docs(spark, two)).collect())
    assert left == sorted([two[0], two[1], (2, ""), (2, " ")])  # the blank after the last mark is no sentence


def removed_by_brute_force(rows):
    """All runs of 2 to 8 sentences with 100 characters or more."""
    seen = defaultdict(set)
    for i, s in rows:
        for run in range(2, 9):
            for p in range(len(s) - run + 1):
                t = " ".join(s[p : p + run])
                if len(t) >= 100:
                    seen[run, t].add((i, p))
    gone = defaultdict(set)
    for (run, _), places in seen.items():
        for i, p in places - {min(places)}:
            gone[i] |= set(range(p, p + run))
    return {i: "".join((" " if k else "") + x + "." for k, x in enumerate(s) if k not in gone[i]) + " " for i, s in rows if gone[i]}


def test_sentences_of_every_run_length(spark):
    rng = random.Random(9)
    one = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(2, 12)))
    shared = [[one() for _ in range(n)] for n in range(2, 10) for _ in range(4)]
    rows = [(i, [s for _ in range(4) for s in (rng.choice(shared) if rng.random() < 0.6 else [one(), one()])]) for i in range(80)]
    five = [f"one of five short sentences {k}" for k in range(5)]
    rows += [(90, five), (91, five), (92, ["a", "b"] * 9)]
    got = sentence_spans.repeated_sentences(edges.docs(spark, [(i, "".join(x + ". " for x in s)) for i, s in rows])).collect()
    assert {r.doc_id: r.text for r in got} == removed_by_brute_force(rows)
    assert {r.doc_id: r.text for r in got}[91] == " "
