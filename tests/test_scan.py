"""One pass over a corpus of its own words gives what the layers give."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import __spark_entry__ as entry
from nuqta.operators import scan
from nuqta.operators.corpus import Corpus
from nuqta.operators.layers import linguistic_hits, simple_search
from nuqta.plans.derived import corpus_at, corpus_of, to_arabic
from nuqta.plans.queries import ASKED, MISSPELT
from nuqta.plans.search import counts_batch, scored, search_batch
from nuqta.schemas import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "onther the menten. of the-onther,  menten\tof of the\r\nonther thetion. tioner  \t of "),
    (2, "The Onther ONTHER; on-ther onther's the (of) and of-and\n\n12 34! . ungen mentens menten-ungen ungenmenten."),
    (3, ""),
    (4, None),
    (5, "ٱonther ontherَ ـonther onther﻿menten café the. onthxr tiqner ungzn onthir thetion and of and \U0001d400onther onthxr"),
    (6, "theti ontherungen  and the of. ---- - -- a-b-c-d aoiy ayow onth. onther  the\tmenten"),
    (None, "onther"),
]


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    if os.path.isdir(SF):
        docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id between 10 and 16").select("doc_id", "text"))
    own = corpus_of(docs)
    plain = Corpus(own.verses, own.morphology, own.word_map).persist()
    yield own, plain
    plain.unpersist()


@pytest.fixture(scope="module")
def asked(spark):
    more = ["the onthxr", "onthxr onthxr", "cafe of", "a-b", "menten ungen", "aoiy"]
    return spark.createDataFrame([(i, to_arabic(t)) for i, t in ASKED] + [(100 + i, to_arabic(t)) for i, t in enumerate(MISSPELT + more)] + [(300, None), (301, "")], QUERIES)


def plain_rows(df):
    return sorted((repr(r.asDict(True)) for r in df.collect()))


@pytest.mark.parametrize("layers", [{"fuzzy": False}, {}, {"lemma": False, "fuzzy": False}, {"root": False}, {"lemma": False, "root": False, "fuzzy": False}])
def test_scored(spark, both, asked, layers):
    own, plain = both
    want, got = plain_rows(scored(asked, plain, **layers)), plain_rows(scored(asked, own, **layers))
    assert len(want) > 20 and got == want


def test_pages_and_counts(spark, both, asked):
    own, plain = both
    assert plain_rows(search_batch(asked, own, page=2, limit=3)) == plain_rows(search_batch(asked, plain, page=2, limit=3).select("qid", "rank", *[c for c in search_batch(asked, own).columns if c not in ("qid", "rank")]))
    assert plain_rows(counts_batch(asked, own)) == plain_rows(counts_batch(asked, plain))


def test_words_and_hits(spark, both, asked):
    own, plain = both
    tokens = scan.query_tokens(asked)
    for name in ("verse_word_roots", "vocabulary", "raw_vocabulary", "entries"):
        want = getattr(plain, name)
        assert plain_rows(getattr(own, name).select(*want.columns)) == plain_rows(want), name
    for on in ({}, {"root": False}, {"lemma": False}):
        assert plain_rows(scan.scan_hits(tokens, own, **on)) == plain_rows(linguistic_hits(tokens, plain, **on).select("token", "gid", "rank"))
    want = simple_search(plain, asked)
    assert plain_rows(scan.scan_simple(asked, own).select(*want.columns)) == plain_rows(want)


def test_too_much_to_hold_takes_the_layers(spark, both, asked, monkeypatch):
    own, plain = both
    monkeypatch.setattr(scan, "SETTLED", 3)
    assert scan.scan_queries(asked, own) is None and scan.scan_hits(scan.query_tokens(asked), own) is None
    assert plain_rows(scored(asked, own, fuzzy=False)) == plain_rows(scored(asked, plain, fuzzy=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_query_stores_no_corpus(spark):
    assert corpus_at(spark, SF).folder is None
    for name in ("normalize_arabic", "contains_all_tokens", "tokenize_verses", "simple_search", "score_exact", "search_counts", "token_types"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "nuqta-corpus" not in plan and len(plan) < 40_000, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_all_layers_score_fuzzy_matches(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select qid, gid, \"matchScore\" from ({entry.oracle_sql()['score_all_layers']})").fetchall()
    got = entry.queries()["score_all_layers"](spark, SF)
    exact = {(r.qid, r.gid) for r in entry.queries()["match_type_fold"](spark, SF).collect()}
    assert sorted(tuple(r) for r in got.select("qid", "gid", "matchScore").collect()) == sorted(want)
    assert {(q, g) for q, g, _ in want} - exact
