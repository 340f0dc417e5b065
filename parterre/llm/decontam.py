"""Benchmark decontamination by a positional inverted index over the training texts.

``build_index`` writes one posting (term, document, position) for every word of
the corpus that the benchmark knows. ``contamination`` looks up each test window
by its rarest terms: their posting lists, shifted by the term's offset in the
item, meet in the same (document, start) only where the terms stand at the right
distances. What is left is compared word by word, so phrase matches are exact.
``near_matches`` reports proximity instead: rare terms of one item close together.

Words are runs of letters and digits, A-Z lower-cased. A window is ``window``
consecutive words of an item; a shorter item is one window. Null and wordless
texts have no words: such documents get zeros, such items match nothing. Items
that repeat an id count as one; an item without an id marks words but is not
counted. Repeated documents get a row each. A text is taken apart within one
task; its postings are dealt out by term and start. Only the needed columns are read, so others may have
any name. An empty table of documents gives no rows, an empty benchmark zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parterre.llm.common import ascii_lower, let, matches, row_key, store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Rarest terms of a window whose posting lists are intersected.
ANCHORS = 3


def words(text: Column) -> Column:
    return matches(ascii_lower(F.coalesce(text, F.lit(""))), WORD)


def item_table(benchmark: DataFrame) -> DataFrame:
    """Distinct items with a key of their own: (item, item_id, words)."""
    return benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct().select(
        F.sha2(F.to_json(F.struct("item_id", "words")), 256).alias("item"), "item_id", "words")


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The stored postings (key, pos, term) of the benchmark's terms; ``docs`` has ``key`` and ``text``."""
    terms = store(items.select(F.explode("words").alias("term")).distinct(), "decontam-terms")
    tokens = docs.select("key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return store(tokens.join(terms, "term"), "decontam-postings")


def anchor_table(items: DataFrame, postings: DataFrame, window: int, anchors: int) -> DataFrame:
    """(item, w, offs): the offsets of the rarest terms of each window, without windows that hold an unseen term."""
    seen = postings.groupBy("term").agg(F.count("*").alias("n"))
    offsets = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("off", "term"))
    ranked = offsets.join(seen, "term", "left").groupBy("item", "size").agg(
        F.array_sort(F.collect_list(F.struct("off", "n"))).alias("offs"))
    span = F.least(F.col("size"), F.lit(window))
    windows = ranked.select("item", "offs", span.alias("span"), F.explode(F.sequence(F.lit(0), F.col("size") - span)).alias("w"))
    part = F.slice("offs", F.col("w") + 1, F.col("span"))
    rare = F.transform(F.slice(F.array_sort(F.transform(part, lambda x: F.struct(x["n"], x["off"]))), 1, anchors), lambda x: x["off"])
    return windows.where(~F.exists(part, lambda x: x["n"].isNull())).select("item", "w", "span", F.array_distinct(rare).alias("offs"))


def phrase_candidates(items: DataFrame, postings: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(key, item, diag, starts): where all rarest terms of a window meet; ``diag`` is the position of the item's first word."""
    wanted = store(anchor_table(items, postings, window, anchors), "decontam-anchors")
    terms = items.select("item", F.posexplode("words").alias("off", "term"))
    lookups = store(wanted.select("item", F.explode("offs").alias("off")).distinct().join(terms, ["item", "off"]), "decontam-lookups")
    met = postings.join(lookups, "term").groupBy("key", "item", (F.col("pos") - F.col("off")).alias("diag")).agg(
        F.collect_set("off").alias("found"))
    whole = met.join(wanted.select("item", "w", "span", F.col("offs").alias("rare")), "item").where(
        (F.col("diag") + F.col("w") >= 0) & (F.size(F.array_except("rare", "found")) == 0))
    return whole.groupBy("key", "item", "diag").agg(F.collect_list(F.struct("w", "span")).alias("starts"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS,
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and, per document, n_words, n_hit, n_items, items (sorted ids) and contaminated."""
    keyed = docs.select(F.struct(*keep).alias("kept"), "text", row_key(docs).alias("key"))
    items = store(item_table(benchmark), "decontam-items")
    postings = build_index(keyed.select("key", "text"), items)
    found = phrase_candidates(items, postings, window, anchors)
    per_doc = store(found.join(items, "item").groupBy("key").agg(
        F.collect_set(F.struct("diag", "starts", "item_id", F.col("words").alias("item_words"))).alias("found")), "decontam-found")
    # always by key: the found ones grow with the documents
    judged = keyed.join(per_doc.hint("merge"), "key", "left").select("kept", let(words(F.col("text")), _judge).alias("_j")).select(
        "kept.*", "_j.*")
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _judge(doc_words: Column) -> Column:
    """Compare each candidate window with the document's words; count what the true ones cover."""
    exact = F.transform("found", lambda c: F.struct(c["item_id"].alias("item_id"), F.transform(
        F.filter(c["starts"], lambda s: F.slice(doc_words, c["diag"] + s["w"] + 1, s["span"]) == F.slice(c["item_words"], s["w"] + 1, s["span"])),
        lambda s: F.sequence(c["diag"] + s["w"], c["diag"] + s["w"] + s["span"] - 1)).alias("hits")))
    true = F.filter(F.coalesce(exact, F.array().cast("array<struct<item_id:string,hits:array<array<int>>>>")),
                    lambda c: F.size(c["hits"]) > 0)
    return let(true, lambda t: let(
        F.array_sort(F.array_distinct(F.filter(F.transform(t, lambda c: c["item_id"].cast("string")), lambda i: i.isNotNull()))),
        lambda ids: F.struct(
            F.size(doc_words).cast("long").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.flatten(F.transform(t, lambda c: c["hits"]))))).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"), ids.alias("items"))))


def near_matches(items: DataFrame, postings: DataFrame, within: int = 30, least: int = 5, rarest: int = 8) -> DataFrame:
    """(key, item, n_terms): at least ``least`` of an item's ``rarest`` terms within ``within`` consecutive positions.

    Each such stretch can begin at one of the terms, so a window over sorted positions meets all of them.
    """
    seen = postings.groupBy("term").agg(F.count("*").alias("n"))
    rare = items.select("item", F.explode(F.array_distinct("words")).alias("term")).join(seen, "term").groupBy("item").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, rarest).alias("rare"))
    terms = store(rare.select("item", F.explode("rare.term").alias("term")), "decontam-near")
    ahead = Window.partitionBy("key", "item").orderBy("pos").rangeBetween(0, within - 1)
    placed = postings.join(terms, "term").select("key", "item", F.size(F.collect_set("term").over(ahead)).alias("n_terms"))
    return placed.where(F.col("n_terms") >= least).groupBy("key", "item").agg(F.max("n_terms").alias("n_terms"))
