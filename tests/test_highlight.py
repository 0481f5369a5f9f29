import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from corpora import UTHMANI  # noqa: E402

from nuqta.operators.highlight import highlight, overlap_ranges, parts, word_ranges  # noqa: E402

CASES = [
    (0, ["الله"], [(7, 14)]),
    (0, ["الله", "الرحمن"], [(7, 14), (15, 27)]),
    (0, ["الرح", "الرحمن"], [(15, 27), (28, 38)]),
    (1, ["الحمد", "ا ل ه"], [(0, 9)]),
    (1, ["العالمين"], [(24, 37)]),
    (1, ["لله"], [(10, 17)]),
    (2, ["الرحمن", "الرحيم"], [(0, 12), (13, 23)]),
    (0, [], []),
    (0, ["ـ", "abc"], []),
    (0, None, []),
]


def frame(spark):
    rows = [(i, UTHMANI[v], t, {"الله": "exact", "الرحمن": "none"}) for i, (v, t, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "i int, uthmani string, matchedTokens array<string>, tokenTypes map<string,string>")


def test_golden_ranges(spark):
    got = {r.i: r for r in highlight(frame(spark)).collect()}
    for i, (v, t, want) in enumerate(CASES):
        assert [(x.start, x.end) for x in got[i].ranges] == want, (i, t)
        assert [x[:2] for x in overlap_ranges(UTHMANI[v], t)] == want
    assert {x.token for x in got[2].ranges} == {"الرح"}
    assert [x.matchType for x in got[1].ranges] == ["exact", "fuzzy"]  # none shows as fuzzy


def test_plain_equals_general(spark):
    rows = frame(spark).where("i <> 3").withColumn("r", word_ranges("uthmani", "matchedTokens", "tokenTypes")).collect()
    for r in rows:
        assert [tuple(x) for x in r.r] == overlap_ranges(r.uthmani, r.matchedTokens or [], r.tokenTypes)


def test_ta_marbuta_and_spaces(spark):
    assert overlap_ranges("قال رحمه الله", ["رحمة"]) == [(4, 8, "رحمة", "fuzzy")]
    assert overlap_ranges("س ا ل ه ص", ["ا ل ه", "ص"]) == [(2, 7, "ا ل ه", "fuzzy"), (8, 9, "ص", "fuzzy")]


def test_parts_cover_the_text(spark):
    df = highlight(frame(spark)).withColumn("p", parts("uthmani", "ranges"))
    for r in df.collect():
        assert "".join(x.text for x in r.p) == r.uthmani
        assert [x.matchType for x in r.p if x.matchType] == [x.matchType for x in r.ranges]
    none = spark.createDataFrame([("", None)], "uthmani string, ranges array<struct<start:int,end:int,token:string,matchType:string>>")
    assert [tuple(x) for x in none.select(parts("uthmani", "ranges")).first()[0]] == [("", None)]
