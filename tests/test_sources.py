import json

import pytest

from nuqta.operators.fuzzy import native_distance, substring_distances
from nuqta.schemas import MissingColumns
from nuqta.sources import SourceError, load_morphology, load_verses, load_word_map, with_position
from nuqta.streaming import debounce


def write(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_load_verses(spark, tmp_path):
    p = write(tmp_path / "v.json", [{"gid": 2, "uthmani": "ب", "standard": "ب", "sura_id": 1}, {"gid": 1, "uthmani": "ا", "standard": "ا"}])
    rows = load_verses(spark, p).orderBy("_pos").collect()
    assert [(r.gid, r.sura_id) for r in rows] == [(2, 1), (1, None)]


def test_load_morphology(spark, tmp_path):
    p = write(tmp_path / "m.json", [{"gid": 1, "lemmas": ["ا"], "roots": []}, None, {"gid": "x", "lemmas": ["ب"]}, {"lemmas": ["ب"]}, {"gid": 1, "lemmas": ["ج"], "roots": ["د"]}])
    assert [(r.gid, r.lemmas, r.roots) for r in load_morphology(spark, p).collect()] == [(1, ["ج"], ["د"])]


def test_load_word_map(spark, tmp_path):
    p = write(tmp_path / "w.json", {"ا": {"lemma": "ب"}, "ت": {"lemma": "ث", "root": "ج"}})
    assert sorted(tuple(r) for r in load_word_map(spark, p).collect()) == [("ا", "ب", None), ("ت", "ث", "ج")]


def test_missing(spark, tmp_path):
    for load in (load_verses, load_morphology, load_word_map):
        with pytest.raises(SourceError, match="does not exist"):
            load(spark, str(tmp_path / "none.json"))
    with pytest.raises(MissingColumns, match="uthmani"):
        with_position(spark.createDataFrame([(1, "ا")], "gid long, standard string"))


def brute(p, t):
    best = len(p)
    for a in range(len(t) + 1):
        for b in range(a, len(t) + 1):
            s, prev = t[a:b], list(range(b - a + 1))
            for i, x in enumerate(p, 1):
                cur = [i]
                for j, y in enumerate(s, 1):
                    cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
                prev = cur
            best = min(best, prev[-1])
    return best


def test_substring_distance(spark):
    words = ["", "ا", "الحمد", "والحمدلله", "حمدان", "xyz", "دمحلا"]
    tokens = ["الحند", "حمد", "ا", "لله"]
    pairs = [(t, w) for t in tokens for w in words]
    want = [brute(t, w) for t, w in pairs]
    assert substring_distances([t for t, _ in pairs], [w for _, w in pairs]).tolist() == want
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(pairs)], "i int, t string, w string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.orderBy("i").select(native_distance(F.col("t"), F.col("w"))).collect()] == want


def test_debounce(spark):
    rows = [("u", "2024-01-01 00:00:00.000", "ا"), ("u", "2024-01-01 00:00:00.200", "اب"), ("u", "2024-01-01 00:00:01.000", "ابت"), ("v", "2024-01-01 00:00:00.100", "س")]
    df = spark.createDataFrame(rows, "user string, ts string, query string").selectExpr("user", "cast(ts as timestamp) ts", "query")
    assert sorted((r.user, r.query) for r in debounce(df).collect()) == [("u", "اب"), ("u", "ابت"), ("v", "س")]


def test_search_stream(spark, tmp_path):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    import corpora

    from nuqta.streaming import search_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "الله"), (2, "xyz")], "qid long, query string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, query string").parquet(str(tmp_path / "in"))
    got = []
    q = search_stream(stream, corpora.mock(spark), lambda page, n: got.extend((r.qid, r.gid) for r in page.orderBy("rank").collect()), checkpoint=str(tmp_path / "ck"), fuzzy=False)
    q.processAllAvailable()
    q.stop()
    assert got == [(1, 1), (1, 2)]
