"""Trained operators: gradients, held-out accuracy, rules, and what happens without labels."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from parterre.llm import lang_id, toxicity, urls
from parterre.llm.common import fold_remainder

PARTS = {"xx": ["an", "er", "the", "ing", "ed"], "yy": ["ció", "osa", "rra", "lle", "ñe"]}
INSULTS = ["badword", "nasty", "vilest"]


def make_text(rng, lang, n, insults=0):
    words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(insults):
        words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        lang = rng.choice(["xx", "yy"])
        toxic = int(rng.random() < 0.3)
        rows.append((k, make_text(rng, lang, rng.randrange(20, 80), 2 * toxic), lang, toxic))
    rows += [(1000, None, "xx", 0), (1001, "", "yy", 1), (1002, "12 !! 34", None, None), (1003, "é", None, None), (None, "the anering", None, None),
             (1004, "the " * 30000, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model = lang_id.Model(["a", "b"], lang_id.Direction(rng, 4), lang_id.Direction(rng, 4), rng.normal(0, 0.5, (9, 2)))
    for layer in (model.forward, model.backward):
        for name in layer.NAMES:
            setattr(layer, name, getattr(layer, name).astype(np.float64))
    data, mask = model.padded([b"abc", b"hello", b"z"])
    labels = np.array([0, 1, 1])
    for value, grad in model.step(data, mask, labels)[1]:
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = value[at], 1e-3
        value[at] = kept + step
        high = model.step(data, mask, labels)[0]
        value[at] = kept - step
        low = model.step(data, mask, labels)[0]
        value[at] = kept
        assert grad[at] == pytest.approx((high - low) / (2 * step), rel=1e-3)


def test_language_id(corpus):
    found = lang_id.language_id(corpus, keep=("doc_id", "lang")).collect()
    assert len(found) == 406
    by_id = {r.doc_id: r for r in found}
    assert {(by_id[k].lang_pred, by_id[k].score) for k in (1000, 1001, 1002)} == {("und", 0.0)}
    assert by_id[1003].lang_pred in ("xx", "yy") and by_id[None].lang_pred == "xx" and by_id[1004].lang_pred == "xx"
    held = [r for r in found if r.lang and r.doc_id < 400]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    unknown = lang_id.language_id(corpus.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}
    assert lang_id.language_id(corpus.limit(0)).count() == 0


def test_toxicity(corpus):
    labels = corpus.select("doc_id", "toxic").where("toxic is not null")
    found = toxicity.toxicity(corpus.drop("toxic"), labels).join(corpus.select("doc_id", "toxic"), "doc_id").where("doc_id < 400").withColumn(
        "held_out", fold_remainder(F.col("doc_id")) == 1).collect()
    held = [r for r in found if r.held_out]
    assert sum((r.score >= 0.7) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    odd = {r.doc_id: r.score for r in toxicity.toxicity(corpus.drop("toxic"), labels).where("doc_id >= 1000").collect()}
    assert odd[1000] == odd[1001] == odd[1002] and all(0 <= s <= 1 for s in odd.values())
    assert {r.score for r in toxicity.toxicity(corpus, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(corpus.limit(0), labels).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = next(rest[:k] for k in range(len(rest) + 1) if k == len(rest) or rest[k] in "/?#")
    path = rest[len(host):]
    path = next(path[:k] for k in range(len(path) + 1) if k == len(path) or path[k] in "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    given = [None, "", "no scheme.org/", "http://org/", "http://org", "https://A.B.example.ORG/es/x?y=http://z", "http://example.org/en/1",
             "http://example.org/en/2#1", "http://notexample.org/es/", "http://xorg/", "http://com/fr/", "HTTP://a.com/de/?a=1&b=2", "http://a.com/FR/",
             "x://y://com/de/", "http://É.org/", "http://", "http://a.net/" + "q" * 5000, "http://a.net/1", "http://a.net/1"]
    given += [f"http://h{k}.com/{'fr' if k % 2 else 'de'}/{k}" for k in range(40)]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(given)], "page_id long, url string, host string, probability string")
    found = {r.page_id: r for r in urls.url_filter(pages).collect()}
    for k, url in enumerate(given):
        host, path, rule, verdict = plain_rule(url)
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert found[k].verdict == verdict if verdict else found[k].verdict in ("allow", "block")
    assert found[17].block_score == found[18].block_score
    assert urls.url_filter(pages.limit(0)).count() == 0
    one_kind = pages.where("url like 'http://org%' or url like '%net%'")
    assert {r.verdict for r in urls.url_filter(one_kind).collect()} == {"allow"}


def test_trees_learn_from_the_labelled(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        bad = k % 2
        tail = "".join(rng.choice("0123456789") for _ in range(14)) if bad else rng.choice(["news", "about", "story"])
        rows.append((k, f"http://h{k % 17}.com/{'de' if bad else 'fr'}/{tail}", bad, True))
        rows.append((1000 + k, f"http://h{k % 17}.net/xx/{tail}", bad, False))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int, ruled boolean")
    found = urls.url_filter(pages, keep=("page_id", "bad", "ruled")).where("not ruled").collect()
    assert sum((r.verdict == "block") == bool(r.bad) for r in found) >= 0.95 * len(found)


def test_toxicity_training_holds_numbers_not_words():
    """What the driver holds beside the texts: some bytes for each word of the sample."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ba", "de", "fi", "go") for b in "aeioulmnrst" for c in ("kan", "lor", "mit", "pes", "rud", "sto", "tam", "ven")]
    texts = [" ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(1500)) for _ in range(300)]
    tracemalloc.start()
    model = toxicity.train([t + " vile" for t in texts[:150]], texts[150:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"\nvile\n" in model.toxic and peak < 20e6
