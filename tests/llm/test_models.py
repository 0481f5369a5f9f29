"""Language identification, quality, packing, sharding and neighbours."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import edges
import numpy as np
import pytest
from pyspark.sql import functions as F

from nuqta.llm import hash_tree, kneser_ney, language_id, packing, queries, rp_forest
from nuqta.llm.textvec import words_of

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch pf ung eit ach", "cc": "eau oui ère né çon"}


def text(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    return language_id.fit([text(rng, x, rng.randrange(5, 120)) for x in langs], langs, epochs=4)


def test_language_held_out(spark, net):
    rng = random.Random(2)
    rows = [(i, text(rng, x, rng.randrange(4, 200)), x) for i, x in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    out = {r.doc_id: r for r in language_id.identify(edges.docs(spark, rows), net).collect()}
    assert sum(out[i].language == x for i, _, x in rows) >= 0.98 * len(rows)
    assert all(out[i].accepted for i, _, _ in rows)
    junk = [(i, "".join(chr(rng.randrange(33, 126)) for _ in range(400))) for i in range(40)]
    assert sum(r.accepted for r in language_id.identify(edges.docs(spark, junk), net).collect()) <= 4


def test_lookup_tables_equal_the_network(net):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (20, language_id.WINDOW), np.uint8)
    e = net.emb[x]
    h = []
    for w in language_id.WIDTHS:
        z = sum(e[:, j : language_id.WINDOW - w + 1 + j] @ net.kernels[w][j * language_id.DIM : (j + 1) * language_id.DIM] for j in range(w)) + net.biases[w]
        h.append(np.maximum(z.max(1), 0))
    want = language_id.softmax(np.concatenate(h, 1) @ net.out + net.out_bias)
    np.testing.assert_allclose(net.windows(x, net.tables()), want, atol=2e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 256, b"b" * 257, b"c"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    win, count, filled = language_id.cut_windows(np.frombuffer(b"".join(texts), np.uint8), off)
    assert count.tolist() == [0, 1, 2, 1] and filled.tolist() == [256, 256, 1, 1]
    assert b"".join(w.tobytes()[:f] for w, f in zip(win, filled, strict=True)) == b"".join(texts)


def test_language_edges(spark, net):
    df = edges.docs(spark, edges.ROWS)
    rows = language_id.identify(df, net).collect()
    assert len(rows) == len(edges.ROWS)
    for r in rows:
        if r.doc_id in (3, 4):
            assert (r.language, r.confidence, r.accepted) == ("und", 0.0, False)
    kept = language_id.keep_identified(df, net)
    assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in rows)
    none = df.where("false")
    blank = language_id.train(none)
    assert language_id.identify(none, blank).collect() == [] and language_id.keep_identified(df, blank).count() == 0


def test_language_sample_has_every_language_wherever_it_lies(spark, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda texts, langs, **_: (texts, langs))
    docs = spark.range(0, 8020, 1, 16).selectExpr("id as doc_id", "'text ' || id as text", "if(id < 8000, 'l' || (id div 2000), 'rare') as lang")
    texts, langs = language_id.train(docs, fit_rows=400)
    assert Counter(langs) == {"l0": 95, "l1": 95, "l2": 95, "l3": 95, "rare": 20} and len(set(texts)) == 400
    assert language_id.train(docs.orderBy("text"), fit_rows=400) == (texts, langs)
    none = docs.selectExpr("cast(null as long) as doc_id", "if(doc_id < 6000, 'same', text) as text", "lang")  # repeated rows
    assert Counter(language_id.train(none, fit_rows=400)[1]) == Counter(langs)


def kn_by_brute_force(texts):
    """Interpolated modified Kneser-Ney of order 5 over bytes, straight from its definition."""
    counts = [None, *(Counter() for _ in range(5))]
    for t in texts:
        b = bytes(4) + t.encode()
        counts[5].update(b[i : i + 5] for i in range(len(b) - 4))
    for n in range(4, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = [None]
    for n in range(1, 6):
        d.append(kneser_ney.discounts(*[sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]))
    totals = [None] + [defaultdict(int) for _ in range(5)]
    kept = [None] + [defaultdict(float) for _ in range(5)]
    for n in range(1, 6):
        for g, c in counts[n].items():
            totals[n][g[:-1]] += c
            kept[n][g[:-1]] += d[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        total = totals[n].get(g[:-1], 0)
        if not total:
            return p(g[1:])
        c = counts[n].get(g, 0)
        return (c - d[n][min(c, 3) - 1] if c else 0) / total + kept[n][g[:-1]] / total * p(g[1:])

    def log_p(t):
        b = bytes(4) + t.encode()
        return sum(math.log(p(b[i : i + 5])) for i in range(len(b) - 4))

    return log_p, p


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(3)
    train = [text(rng, x, 40) for x in ("aa", "bb", "aa", "cc") for _ in range(6)]
    table = kneser_ney.estimate(kneser_ney.count_grams(spark.createDataFrame([(t,) for t in train], "text string")))
    log_p, p = kn_by_brute_force(train)
    asked = [text(rng, "aa", 30), text(rng, "bb", 3), "ZZZ!! ###", "", None, train[0], "é漢\x00"]
    df = edges.docs(spark, list(enumerate(asked)))
    sent = {r.doc_id: r for r in kneser_ney.score(df, table, kneser_ney.send(table)).collect()}
    sharded = {r.doc_id: r for r in kneser_ney.score(df, table, kneser_ney.send(table, limit=10)).collect()}
    for i, t in enumerate(asked):
        assert sent[i].size == sharded[i].size == len((t or "").encode())
        assert sent[i].log_p == pytest.approx(log_p(t or ""), rel=1e-4, abs=1e-4)
        assert sharded[i].log_p == pytest.approx(sent[i].log_p, rel=1e-4, abs=1e-4)
    for ctx in (b"", b"k", b"aka ", b"zzzz"):
        assert sum(p(ctx + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_quality_separates(spark):
    rng = random.Random(4)
    good = [(i, text(rng, "aa" if i % 2 else "cc", rng.randrange(20, 90)), "aa" if i % 2 else "cc") for i in range(120)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text(rng, "aa", 40).upper().split()), "aa") for i in range(20)]
    df = edges.docs(spark, good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80)] + [(1000, 0, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    for limit in (kneser_ney.MAX_SENT_ROWS, 10):
        q = kneser_ney.train(df, labels, max_sent_rows=limit)
        out = {r.doc_id: r.accepted for r in kneser_ney.assess(df, q).collect()}
        assert sum(out[i] for i, *_ in good) >= 117 and not any(out[i] for i, *_ in junk)
        kept = kneser_ney.keep_good(df, q)
        assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, ok in out.items() if ok}


def test_quality_edges(spark):
    df = edges.docs(spark, edges.ROWS)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    q = kneser_ney.train(df, labels)
    rows = kneser_ney.assess(df, q).collect()
    assert len(rows) == len(edges.ROWS)
    assert all(not r.accepted for r in rows if r.doc_id in (3, 4)) and all(math.isfinite(r.perplexity) for r in rows)
    assert next(r for r in rows if r.doc_id == 1).accepted
    none = df.where("false")
    q = kneser_ney.train(none, labels.where("false"))
    assert kneser_ney.assess(none, q).collect() == []
    assert kneser_ney.keep_good(df, q).count() == len([r for r in edges.ROWS if r[1]])  # nothing trusted, nothing rejected


@pytest.mark.parametrize("dims, depth", [(2, 4), (3, 3)])
def test_hilbert_curve_is_continuous(dims, depth):
    axes = np.meshgrid(*[np.arange(1 << depth)] * dims, indexing="ij")
    points = np.stack([a.ravel() for a in axes], 1)
    key = packing.hilbert(points, depth)
    assert sorted(key.tolist()) == list(range(len(points)))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def packs_by_brute_force(keys, capacity):
    out, at = [], 0
    for _, doc, n in sorted((k, i, n) for i, n, k in keys):
        done = 0
        while done < n:
            take = min(n - done, capacity - at % capacity)
            out.append((at // capacity, doc, done, done + take))
            at, done = at + take, done + take
    return out


def test_packing_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.choice(list(SYLLABLES)), rng.randrange(0, 120))) for i in range(150)]
    rows += [r[:2] for r in edges.ROWS if r[0] is None or r[0] > 2] + [(5000, rows[3][1]), (5000, rows[3][1])]
    df = edges.docs(spark, rows)
    keys = [(r.doc_id, r.n_words, r.curve_key) for r in packing.curve(df).collect()]
    assert sorted((i, n) for i, n, _ in keys) == sorted((i, len(words_of(t))) for i, t in rows if i is not None and words_of(t))
    out = packing.pack(df, capacity=256).collect()
    assert sorted((r.pack_id, r.doc_id, r.start_word, r.end_word) for r in out) == sorted(packs_by_brute_force(keys, 256))
    full = Counter()
    for r in out:
        full[r.pack_id] += r.end_word - r.start_word
    assert all(v == 256 for k, v in full.items() if k != max(full))
    for k in full:
        own = sorted((r for r in out if r.pack_id == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(1, len(own) + 1)) and [r.curve_key for r in own] == sorted(r.curve_key for r in own)
    assert packing.pack(df.where("false")).collect() == []


def test_packing_puts_like_documents_together(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, list(SYLLABLES)[i % 3], 60)) for i in range(300)]
    by = defaultdict(list)
    for r in packing.pack(edges.docs(spark, rows), capacity=600).collect():
        by[r.pack_id].append(r.doc_id % 3)
    same = np.mean([a == b for v in by.values() for i, a in enumerate(v) for b in v[:i]])
    assert same > 0.45  # a third by chance


def test_hash_tree_against_sql(spark):
    df = edges.docs(spark, [(i,) + r[1:] for i, r in enumerate(edges.ROWS * 20)] + edges.ROWS)
    got = sorted(hash_tree.assign(df).collect(), key=str)
    documents = df.select("doc_id").toPandas().astype("Int64")  # noqa: F841
    want = duckdb.sql(hash_tree.assign_sql()).fetchall()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert all((r.shard is None) == (r.doc_id is None) for r in got)
    assert hash_tree.assign(df.where("false")).collect() == []


def test_hash_tree_weights_and_movement(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    N = hash_tree.Node
    tree = lambda w: N("root", (N("a", (N("a0", (N("a00", (), 1), N("a01", (), w))), N("a1", (N("a10", (), 2),)))), N("b", (N("b0", (N("b00", (), 4), N("b01", (), 0))),))))
    before = {r.doc_id: r for r in hash_tree.assign(ids, tree(1)).collect()}
    share = Counter(r.shard for r in before.values())
    for shard, weight in (("a00", 1), ("a01", 1), ("a10", 2), ("b00", 4)):
        assert abs(share[shard] / 6000 - weight / 8) < 0.03
    assert share["b01"] == 0
    for r in hash_tree.assign(ids, tree(3)).collect():
        old = before[r.doc_id]
        if r.region != old.region:  # at each level, what moves, moves to the child that grew
            assert r.region == "a"
        elif r.rack != old.rack:
            assert r.rack == "a0"
        elif r.shard != old.shard:
            assert r.shard == "a01"
    with pytest.raises(ValueError):
        hash_tree.assign(ids, N("r", (N("x", (), 0),)))


def neighbours_by_brute_force(x, ids, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d[ids[:, None] == ids[None]] = np.inf
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (row[j], ids[j]))[:k]] for i, row in zip(ids.tolist(), d, strict=True)}


@pytest.mark.parametrize("leaf", [2048, 64])
def test_neighbours_recall(spark, leaf, monkeypatch):
    monkeypatch.setattr(rp_forest, "LEAF", leaf)
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((12, 16))[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = neighbours_by_brute_force(x.astype(float), np.arange(900), 10)
    got = defaultdict(list)
    for r in rp_forest.neighbours(df).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbour_id)
    assert set(got) == set(range(900)) and all(len(v) == len(set(v)) == 10 for v in got.values())
    recall = sum(len(set(want[i]) & set(got[i])) for i in want) / 9000
    assert recall == 1 if leaf > 900 else recall >= 0.9


def test_asked_neighbours_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "LEAF", 64)
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((12, 16))[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))).astype(np.float32)
    x[100:400] = x[100]  # a third of all vectors is one
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = {large: sorted(tuple(r) for r in rp_forest.neighbours(df, ask=F.col("vec_id") % 20 == 0, large=large).collect()) for large in (rp_forest.LARGE, 30)}
    assert rows[30] == rows[rp_forest.LARGE]  # blocks of a leaf lose nothing
    want, got = neighbours_by_brute_force(x.astype(float), np.arange(900), 10), defaultdict(list)
    for i, j, *_ in rows[30]:
        got[i].append(j)
    assert set(got) == set(range(0, 900, 20)) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(want[i]) & set(got[i])) for i in got) / (10 * len(got)) >= 0.9


def test_large_leaves_lose_no_neighbour(monkeypatch):
    monkeypatch.setattr(rp_forest, "LARGE", 200)
    monkeypatch.setattr(rp_forest, "LEAF", 50)
    x = np.random.default_rng(9).standard_normal((650, 8)).astype(np.float32)
    x[300:310] = x[5]
    _, found = rp_forest.nearest(x, x, np.arange(650), np.arange(650), 5)
    assert {i: f.tolist() for i, f in enumerate(found)} == neighbours_by_brute_force(x.astype(float), np.arange(650), 5)


def test_splits_are_fitted_on_the_whole_table(spark, monkeypatch):
    class Seen(Exception):
        pass

    def forest(sample, *_):
        raise Seen(sample)

    monkeypatch.setattr(rp_forest, "Forest", forest)
    with pytest.raises(Seen) as e:
        rp_forest.neighbours(spark.range(0, 4000, 1, 16).selectExpr("id as vec_id", "array(float(id), 0f) as embedding"))
    part = (e.value.args[0][:, 0] // 250).astype(int)
    assert len(part) == 48 and len(set(part)) >= 12 and (part >= 8).sum() >= 12


def test_neighbours_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [0.0, 0.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("embedding", "vec_id", "1 as rank", "2 as cell", "3 as v", "4 as d", "5 as neighbour_id")
    got = sorted((r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in rp_forest.neighbours(df).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 1, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 1.0)]
    assert rp_forest.neighbours(df.where("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.01")), reason="no tables")
def test_registered_neighbours_recall(spark):
    """op10 on the whole table of vectors, against brute force."""
    sf = SF.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = defaultdict(set)
    for r in queries.op10_neighbours(spark, sf).collect():
        got[r.vec_id].add(r.neighbour_id)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    want = neighbours_by_brute_force(x, ids, 10)
    assert sum(len(set(want[i]) & got[i]) for i in got) / (10 * len(got)) >= 0.9


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    f, d = language_id.FILTERS, language_id.DIM
    p = {"emb": rng.standard_normal((256, d)), "out": rng.standard_normal((3 * f, 4)), "out_bias": rng.standard_normal(4)}
    for w in language_id.WIDTHS:
        p[f"k{w}"], p[f"b{w}"] = rng.standard_normal((w * d, f)) * 0.3, rng.standard_normal(f)
    x, y = rng.integers(0, 256, (5, language_id.WINDOW)), rng.integers(0, 4, 5)

    def loss():
        h = []
        for w in language_id.WIDTHS:
            e = p["emb"][x]
            z = sum(e[:, j : language_id.WINDOW - w + 1 + j] @ p[f"k{w}"][j * d : (j + 1) * d] for j in range(w)) + p[f"b{w}"]
            h.append(np.maximum(z.max(1), 0))
        return -np.log(language_id.softmax(np.concatenate(h, 1) @ p["out"] + p["out_bias"])[np.arange(5), y]).mean()

    for name, grad in language_id._grads(p, x, y).items():
        some = np.argwhere(np.abs(grad) > 1e-4)
        for at in map(tuple, some[rng.integers(0, len(some), 6)]):
            before = p[name][at]
            p[name][at] = before + 1e-5
            up = loss()
            p[name][at] = before - 1e-5
            down = loss()
            p[name][at] = before
            assert grad[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_trained_on_a_bounded_draw_of_a_sorted_table(spark):
    """A table sorted by language: the draw of ``train`` learns them all, as one run after another does."""
    rng = random.Random(12)
    rows = [(i, text(rng, x, rng.randrange(20, 60)), x) for i, x in enumerate(sorted(rng.choice(list(SYLLABLES)) for _ in range(600)))]
    df = edges.docs(spark, rows).repartition(6, "lang")
    net = language_id.train(df, fit_rows=90)
    out = {r.doc_id: r.language for r in language_id.identify(df, net).collect()}
    assert net.labels == ["aa", "bb", "cc", "und"] and sum(out[i] == x for i, _, x in rows) >= 0.95 * len(rows)
    assert all(np.array_equal(a, b) for a, b in ((net.emb, language_id.train(df, fit_rows=90).emb),))


def test_accepted_by_brute_force(spark):
    """Thresholds and decisions, from models of either half counted in plain Python."""
    rng = random.Random(14)
    rows = [(i, text(rng, "aa" if i % 2 else "cc", rng.randrange(5, 40)) + (" §§ ¤¤ µµ" if i % 11 == 0 else ""), "aa" if i % 2 else "cc") for i in range(90)]
    df = edges.docs(spark, [*rows, (200, text(rng, "bb", 20), "bb"), (201, "", "aa"), (202, None, "cc"), (203, text(rng, "aa", 30), None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    fold = {r.doc_id: r.m for r in df.where("doc_id < 60").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("m")).collect()}
    texts = {i: (t, x) for i, t, x in rows}
    of = [kn_by_brute_force([texts[i][0] for i in sorted(fold) if fold[i] == m])[0] for m in (0, 1)]
    whole = kn_by_brute_force([texts[i][0] for i in sorted(fold)])[0]
    held = {i: (-of[1 - fold[i]](texts[i][0]), len(texts[i][0].encode()), texts[i][1]) for i in fold}
    ratio = lambda v: sum(x[0] for x in v) / sum(x[1] for x in v)
    mean = {x: ratio([v for v in held.values() if v[2] == x]) for x in ("aa", "cc")} | {None: ratio(list(held.values()))}
    ppl = lambda nll, n, x: math.exp((nll + 300 * mean.get(x, mean[None])) / (n + 300))
    quantile = lambda v: sorted(v)[math.ceil(0.985 * len(v)) - 1]
    limit = {x: quantile([ppl(*v) for v in held.values() if v[2] == x]) for x in ("aa", "cc")} | {None: quantile([ppl(*v) for v in held.values()])}
    got = {r.doc_id: r for r in kneser_ney.assess(df, kneser_ney.train(df, labels)).collect()}
    for r in df.collect():
        n = len((r.text or "").encode())
        x = ppl(-whole(r.text or ""), n, r.lang)
        assert got[r.doc_id].perplexity == pytest.approx(x, rel=1e-3) and got[r.doc_id].threshold == pytest.approx(limit.get(r.lang, limit[None]), rel=1e-3)
        if abs(x / limit.get(r.lang, limit[None]) - 1) > 2e-3:
            assert got[r.doc_id].accepted == (n > 0 and x <= limit.get(r.lang, limit[None]))
