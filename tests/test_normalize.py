import pytest
from pyspark.sql import functions as F

from nuqta.functions import clean_field_query, clean_query, contains_all_tokens, normalize_arabic, register, remove_tashkeel, strip_word, tokenize

BASMALA = "بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ"


def run(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f("s")).collect()]


def test_remove_tashkeel(spark):
    got = run(spark, remove_tashkeel, BASMALA, "الحمد لله", "", "فَتْحَةٌ ضَمَّةٌ كَسْرَةٌ", None)
    assert got == ["بسم الله الرحمن الرحيم", "الحمد لله", "", "فتحة ضمة كسرة", None]


def test_remove_tashkeel_keeps_some_signs_and_drops_extended_digits(spark):
    assert run(spark, remove_tashkeel, "ا۝۞۩", "ا۵") == ["ا۝۞۩", "ا"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("أإآٱ", "ا" * 4),
        ("ؤئ", "ء" * 2),
        ("موسى", "موسي"),
        ("بـــســـم", "بسم"),
        ("الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ", "الحمد لله رب العالمين"),
        ("ا ب", "ا ب"),
        ("﻿ ا \r\n ب 　", "ا ب"),
        ("ا-ب", "ا-ب"),
        ("رحمة", "رحمة"),
        ("یکگ abc 123", ""),
        (None, ""),
        ("", ""),
    ],
)
def test_normalize(spark, given, wanted):
    assert run(spark, normalize_arabic, given) == [wanted]


def test_normalize_is_idempotent(spark):
    texts = [BASMALA, "إن أن ؤئى ـ-\n\nا", " ا  ب"]
    once = run(spark, normalize_arabic, *texts)
    assert run(spark, normalize_arabic, *once) == once


def test_query_cleaners_differ_on_wasl_alef(spark):
    q = "ٱللَّهِ"
    assert run(spark, clean_query, q) == ["لله"]
    assert run(spark, clean_field_query, q) == ["الله"]


def test_hyphen_goes_from_queries_and_words(spark):
    assert run(spark, clean_query, "ا-ب") == ["اب"]
    assert run(spark, clean_field_query, "ا-ب") == ["اب"]
    assert run(spark, strip_word, "ا-ب٣") == ["اب"]


def test_tokenize(spark):
    assert run(spark, tokenize, "", " ا ب", "ا ب ج") == [[""], ["", "ا", "ب"], ["ا", "ب", "ج"]]


def test_contains_all_tokens(spark):
    df = spark.createDataFrame([(BASMALA, "الرحمن الله"), (BASMALA, "نور"), (BASMALA, ""), (None, "نور")], "v string, q string")
    assert [r[0] for r in df.select(contains_all_tokens("v", "q")).collect()] == [True, False, False, False]


def test_sql_functions_agree(spark):
    register(spark)
    texts = [BASMALA, "إن أن ؤئى ـ-\n\nا", " ا  ب", "", None, "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(normalize_arabic("s"), F.expr("normalize_arabic(s)"), remove_tashkeel("s"), F.expr("remove_tashkeel(s)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)
    assert spark.sql(f"select contains_all_tokens('{BASMALA}', 'الله')").first()[0]
    assert [tuple(r) for r in spark.sql("select * from tokenize_query('بسم  الله')").collect()] == [(0, "بسم"), (1, "الله")]
    assert [tuple(r) for r in spark.sql("select * from tokenize_query('')").collect()] == []
