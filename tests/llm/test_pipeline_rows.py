"""Every stage on its own, on rows that are odd in each way at once."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from parterre.llm.common import store, table
from tests.llm.test_registered import FOLDER, pytestmark  # noqa: F401

PLAIN = "The river runs past the old mill and the boats lie still in the quiet morning light of the harbour town. "


def odd_docs(spark):
    """Null ids, texts, languages and sources, repeated rows and ids, empty and very long texts, personal data, a benchmark item."""
    item = table(spark, FOLDER, "benchmark").where("text is not null").orderBy("item_id").first().text
    rows = [(1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN, None, None), (3, None, "en", "a"), (3, None, "en", "a"), (4, "", "de", "b"),
            (None, "A text of its own without any id, told by nobody in particular to nobody else.", "en", None), (None, None, None, None),
            (5, "Different words under one id, the first of the two that share it today.", "fr", "c"),
            (5, "Another content with the same id, which stays beside the first one here.", "fr", "c"),
            (6, " ".join(f"word{k} runs" for k in range(40_000)), "en", "a"), (7, "w" * 300_000, "en", "a"),
            (8, f"Please write to ann@example.com or call +49 30 1234567 about entry {8}, she said.", "en", "a"), (9, item, "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # further columns under names that operators use themselves
    return frame.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("z").alias(c) for c in ("key", "kept", "score", "base", "pair", "a")])


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_on_odd_rows(spark, name):
    docs = store(odd_docs(spark), "test-odd")
    found = store(dict(P.STAGES)[name](spark, docs, FOLDER), "test-odd-out")
    ids = sorted(str(r.doc_id) for r in found.select("doc_id").collect())
    every = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    if name != "bpe_encoding":
        assert found.columns == P.COLUMNS
    if name == "toxicity":
        assert set(every) == set(ids)
    if name == "ngram_join":  # one of the copies, and one of the rows that are equal in all
        assert sorted(set(every) - set(ids)) == ["2"] and ids.count("1") == 1 and ids.count("5") == 2 and ids.count("None") == 2
    if name == "benchmark_decontamination":
        assert sorted(set(every) - set(ids)) == ["9"] and len(ids) == len(every) - 1
    if name == "pii":
        assert ids == every
        changed = {r.doc_id: r.text for r in found.collect()}
        assert changed[8] == "Please write to <email> or call <phone> about entry 8, she said." and changed[1] == PLAIN and changed[3] is None
    if name == "bpe_encoding":
        assert ids == every and found.where("doc_id in (3, 4)").agg(F.sum("n_tokens")).first()[0] == 0
        assert found.where("doc_id = 7").first().n_tokens > 1000
