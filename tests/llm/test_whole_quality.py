"""Outliers of sources and languages that are too small to be fitted alone."""

import random

from parterre.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(seed, n, mark=""):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "el", "or", "té", "ish", "um"]) for _ in range(rng.randrange(1, 4))) + mark for _ in range(n))


def rejected(spark, rows):
    return {r.doc_id for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA), min_rows=20).collect() if not r.kept}


def test_small_sources_beside_large_ones(spark):
    """Junk is the norm of its own small source or language, but not of what stands around it."""
    rows = [(k, plain(k, 60 + k % 50), lang, source) for k, (lang, source) in enumerate(
        (lang, source) for lang in ("en", "de") for source in ("s", "t") for _ in range(40))]
    junk = [(1000 + k, plain(k, 80, "$$%"), "en", "small") for k in range(3)] + [(1010, plain(9, 80, "$$%"), "en", "one")]
    junk += [(1020 + k, plain(k, 80, "$$%"), "xx", "s") for k in range(3)]
    fine = [(2000 + k, plain(500 + k, 80), "en", "small2") for k in range(3)] + [(2010, plain(510, 80), "xx", "t")]
    assert rejected(spark, rows + junk + fine) == {i for i, *_ in junk}


def test_null_source_is_not_its_whole_language(spark):
    """A large null source full of signs is judged by itself, other sources by theirs."""
    rows = [(k, plain(k, 60 + k % 50), "en", "s") for k in range(60)]
    signs = [(100 + k, plain(k, 60 + k % 50, "$$%"), "en", None) for k in range(60)]
    small = [(200 + k, plain(k, 80), "en", "u") for k in range(3)]
    assert not rejected(spark, rows + signs + small) & {i for i, *_ in rows + signs}


def test_moderate_outliers(spark):
    """A fifth of the characters are signs, three tenths of the lines repeat, or a text is many times as long: all far from their group."""
    rows = [(k, plain(k, 60 + k % 50), "en", "s") for k in range(100)]
    words = plain(900, 80).split()
    signs = " ".join(w + "$" * round(len(w) / 4) for w in words)
    lines = "\n".join([*(plain(910 + k, 12) for k in range(7)), *[plain(909, 4)] * 4])
    odd = [(200, signs, "en", "s"), (201, lines, "en", "s"), (202, plain(950, 1200), "en", "s")]
    assert rejected(spark, rows + odd) == {200, 201, 202}
