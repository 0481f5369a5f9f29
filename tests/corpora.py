"""Small corpora with known results."""

from nuqta.operators.corpus import Corpus

UTHMANI = ["بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ", "ٱلْحَمْدُ لِلَّهِ رَبِّ ٱلْعَٰلَمِينَ", "ٱلرَّحْمَٰنِ ٱلرَّحِيمِ"]
STANDARD = ["بسم الله الرحمن الرحيم", "الحمد لله رب العالمين", "الرحمن الرحيم"]
MORPHOLOGY = [
    (1, ["بسم", "الله", "الرحمن", "الرحيم"], ["ب س م", "ا ل ه", "ر ح م", "ر ح م"]),
    (2, ["الحمد", "لله", "رب", "العالمين"], ["ح م د", "ا ل ه", "ر ب ب", "ع ل م"]),
    (3, ["الرحمن", "الرحيم"], ["ر ح م", "ر ح م"]),
]
WORDS = [("الله", "الله", "ا ل ه"), ("الرحمن", "الرحمن", "ر ح م"), ("الحمد", "الحمد", "ح م د")]


def corpus(spark, verses, morphology=(), words=()):
    """verses: (gid, standard) or (gid, standard, uthmani), in order."""
    v = spark.createDataFrame([(g, x[0], (x[1:] or x)[0], i, "extra") for i, (g, *x) in enumerate(verses)], "gid long, standard string, uthmani string, _pos long, rank string")
    m = spark.createDataFrame(list(morphology), "gid long, lemmas array<string>, roots array<string>")
    w = spark.createDataFrame(list(words), "token string, lemma string, root string")
    return Corpus.of(v, m, w)


def mock(spark):
    return corpus(spark, [(i + 1, s, u) for i, (s, u) in enumerate(zip(STANDARD, UTHMANI, strict=True))], MORPHOLOGY, WORDS)
