"""Passes over documents give what the columns of the derived corpus give, without deriving it
by expressions."""

import random

import pytest
from pyspark.sql import functions as F

from nuqta.functions.normalize import normalize_arabic, tokenize
from nuqta.operators import scan
from nuqta.operators.corpus import Corpus
from nuqta.operators.fuzzy import FuzzyOptions, fuzzy_words
from nuqta.plans.derived import corpus_of, standard_texts, to_arabic

TEXTS = [
    "of the-onther,  menten\tof\r\nThe Menten. tioner  \t of ", "...a..b.\n\n.", "", ".", " x ", "É café ß µ ÿ. A-b c", "İstanbul ΑΣ.Α \U0001d400onther. on-ther",
    "ٱonther ontherَ ـonther﻿menten \r the. a\tb  c", "menten-ungen ungenmenten aoiy. mentenungen", "".join(random.Random(1).choices("ab eyt-.\n\r\t ٱى", k=3000)),
]


@pytest.fixture(scope="module")
def own(spark):
    return corpus_of(spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "the"), (99, None)], "doc_id long, text string"))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def derives_nothing(df):
    """The texts go to the workers as they are."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp" not in plan and "translate" not in plan and "lower(" not in plan


def test_workers_cut_the_verses(own):
    want = {r.gid: r.standard for r in own.verses.select("gid", "standard").collect()}
    assert want == {(d << 32) + n: x for d, text in enumerate(TEXTS) for n, x in enumerate(standard_texts(text))}


def test_word_roots(own):
    """F22"""
    got = scan.scan_word_roots(own)
    derives_nothing(got)
    assert rows(got) == rows(Corpus(own.verses, own.morphology, own.word_map).verse_word_roots.where("word_lemma is not null").select(*got.columns))


def test_near_words(spark, own):
    """F3"""
    tokens, options = [to_arabic(x) for x in ("onthxr", "ungzn", "th", "the")], FuzzyOptions()
    tokens = [r.t for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(normalize_arabic("t").alias("t")).collect()]
    got = scan.scan_near(tokens, own, options)
    derives_nothing(got)
    want = fuzzy_words(spark.createDataFrame([(t,) for t in tokens], "token string"), own.vocabulary.select(F.col("norm_word").alias("word")), options)
    assert rows(got) == rows(want) and got.count() > 5


def test_tokens(own):
    """F21"""
    got = scan.scan_tokens(own)
    derives_nothing(got)
    assert rows(got) == rows(own.verses.select("gid", F.posexplode(tokenize(normalize_arabic("standard"))).alias("tpos", "token")))


def test_normal_forms(own):
    """F8"""
    got = scan.scan_normal(own)
    derives_nothing(got)
    assert rows(got) == rows(own.verses.select("gid", normalize_arabic("uthmani").alias("norm")))


def test_searches_derive_nothing(spark, own):
    """F2, F5, F18, F19 and those that score"""
    asked = spark.createDataFrame([(1, to_arabic("the")), (2, to_arabic("menten of"))], "qid long, query string")
    for df in (scan.scan_simple(asked, own).select("qid", "gid", "standard"), scan.scan_hits(scan.query_tokens(asked), own, root=False), scan.scan_queries(asked, own), scan.scan_types(asked, own)):
        derives_nothing(df)


def test_pages_keep_only_their_first_rows(spark, own):
    """F13, F14, F16"""
    asked = spark.createDataFrame([(1, to_arabic("the")), (2, to_arabic("e"))], "qid long, query string")
    every = sorted((r.qid, -r.matchScore, r.layer, tuple(r.tie)) for r in scan.scan_queries(asked, own).collect())
    for n in (1, 3):
        want = [r for q in (1, 2) for r in [x for x in every if x[0] == q][:n]]
        got = sorted((r.qid, -r.matchScore, r.layer, tuple(r.tie)) for r in scan.scan_page(asked, own, n).collect())
        assert set(want) <= set(got) <= set(every) and [r for q in (1, 2) for r in [x for x in got if x[0] == q][:n]] == want


def test_scores_make_no_ranges(spark, own):
    """where only scores are asked for, words at the best score are counted, not located."""
    asked = spark.createDataFrame([(1, to_arabic("onthxr")), (2, to_arabic("the")), (3, to_arabic("ungzn menten"))], "qid long, query string")
    full, slim = (scan.scan_queries(asked, own, fuzzy=FuzzyOptions(), strings=on).collect() for on in (True, False))
    of = lambda rows: sorted((r.qid, r.gid, r.layer, r.matchScore, r.matchType, r.advanced, repr(r.tie)) for r in rows)
    assert of(full) == of(slim) and any(r.matchType == "fuzzy" and r.fuzzyMatches for r in full)
    assert all(r.fuzzyMatches is None and r.matchedTokens is None for r in slim)
