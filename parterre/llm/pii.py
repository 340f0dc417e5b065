"""Personal data: fixed patterns, and contexts bootstrapped from what they find.

The fixed patterns give the seed entities. An occurrence is a seed or another
token with a digit in it, together with the words beside it (of a very long word
the 40 characters nearest). A pattern is a kind and the neighbouring word on one
side, or those on both; in each round the graph of
patterns and instances is scored: a pattern by the share of its instances that
are known (times the logarithm of their number), an instance by its best
patterns. Instances that enough confident patterns agree on become known, and
confident patterns of the last round mark the new spans. All of it is grouped
counts over the occurrences, which hold no text.

Spans are (kind, start, end) in code points, end exclusive. Null text counts as
empty. Patterns are judged on distinct instances, so repeated documents add
nothing; equal texts get equal spans, whatever their id, and rows that repeat an
id are judged each. A text is held whole in one task; patterns are linear in its length,
and each token with a digit costs one more pass over it for the words beside it. Only the ``keep`` columns and the text are read, so others may
have any name. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import NOT_SPACE, SPACE, ascii_lower, let, row_key, store

KINDS = ("email", "ip", "card", "phone")
#: A run of the same class is taken whole (no stretch of it is tried twice), which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A whole token with a digit in it: begun at its first character only, and never tried twice.
TOKEN = rf"(?<!{NOT_SPACE})[^0-9\x20\x09-\x0D]*+[0-9]{NOT_SPACE}*+"
#: Fewest known instances of a pattern, its least share of known ones, fewest confident patterns of a new instance, rounds.
SUPPORT, CONFIDENCE, AGREE, ROUNDS = 5, 0.6, 2, 3


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for k in range(20):  # the last digit counts once, the one before it twice, and so on
        d = F.substring(padded, 20 - k, 1).cast("int")
        total = total + (d if k % 2 == 0 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]+", "")
    if kind == "ip":
        return found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Matches whose places are added up one after the other; of more, so many at a time.
_STEP = 1000


def _located(text: Column, pattern: str) -> Column:
    """Matches with their places: (found, start). What lies between them gives the distances.

    An array that grows match by match is copied each time, so the matches are taken in blocks whose starts are known beforehand.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern), lambda x: F.length(x))
    nothing = F.array().cast("array<struct<found:string,start:int>>")
    total = lambda values: F.aggregate(values, F.lit(0), lambda n, x: n + x)

    def placed(v, offset, k):
        last = F.least(F.size(v["f"]), (k + 1) * _STEP) - 1
        return F.aggregate(
            F.sequence(k * _STEP, last), F.struct(offset.alias("at"), nothing.alias("out")),
            lambda a, i: F.struct(
                (a["at"] + F.get(v["b"], i) + F.length(F.get(v["f"], i))).alias("at"),
                F.concat(a["out"], F.array(F.struct(F.get(v["f"], i).alias("found"), (a["at"] + F.get(v["b"], i)).alias("start")))).alias("out")),
            lambda a: a["out"])

    def blocks(v):
        numbers = F.sequence(F.lit(0), F.floor((F.size(v["f"]) - 1) / _STEP).cast("int"))
        sizes = F.transform(numbers, lambda k: total(F.slice(v["b"], k * _STEP + 1, F.lit(_STEP))) + total(
            F.transform(F.slice(v["f"], k * _STEP + 1, F.lit(_STEP)), lambda x: F.length(x))))
        return let(sizes, lambda s: F.flatten(F.transform(numbers, lambda k: placed(v, total(F.slice(s, F.lit(1), k)), k))))

    return let(F.struct(found.alias("f"), between.alias("b")), blocks)


def _places(text: Column, pattern: str, needs: str) -> Column:
    none = F.array().cast("array<struct<found:string,start:int>>")
    hit = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    return F.when(hit & text.rlike(pattern), _located(text, pattern)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds: an array of (kind, start, end), unordered."""
    def of_kind(kind: str) -> Column:
        valid = F.filter(_places(text, PATTERNS[kind], NEEDS[kind]), lambda m: _valid(kind, m["found"]))
        return F.transform(valid, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["found"])).alias("end")))

    return F.concat(*map(of_kind, KINDS))


def _occurrences(found: DataFrame) -> DataFrame:
    """(key, kind or null, start, end, instance, left, right) of base spans and other tokens with digits."""
    text = F.coalesce("text", F.lit(""))
    base = F.col("base")
    tokens = F.transform(_places(text, TOKEN, "[0-9]"), lambda m: F.struct(
        F.lit(None).cast("string").alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["found"])).alias("end")))
    free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    # the words beside a span are taken before the spans become rows, which would each carry the whole text
    beside = lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("instance"),
        ascii_lower(F.regexp_extract(F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), s["start"] - F.greatest(s["start"] - 40, F.lit(0))),
                                     rf"({NOT_SPACE}+){SPACE}*$", 1)).alias("left"),
        ascii_lower(F.regexp_extract(F.substring(text, s["end"] + 1, F.lit(40)), rf"^{SPACE}*({NOT_SPACE}+)", 1)).alias("right"))
    return found.select("key", F.explode(F.transform(F.concat(base, free), beside)).alias("s")).select("key", "s.*")


def _pattern_rows(occurrences: DataFrame) -> DataFrame:
    """Each occurrence under its patterns: the word to its left, the one to its right, and both."""
    def side(name, value):
        return F.struct(F.lit(name).alias("side"), value.alias("words"))

    sides = F.array(side("left", F.col("left")), side("right", F.col("right")), side("both", F.concat_ws(" _ ", "left", "right")))
    return occurrences.select("*", F.explode(F.filter(sides, lambda x: x["words"] != "")).alias("p")).select(
        *occurrences.columns, "p.side", "p.words")


def confident_patterns(occurrences: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, agree: int = AGREE,
                       rounds: int = ROUNDS) -> DataFrame:
    """(side, words, kind, score) after the last round."""
    cells = store(_pattern_rows(occurrences).groupBy("side", "words", "instance").agg(F.max("kind").alias("kind")), "pii-graph")
    known = cells.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind"))
    patterns = None
    for _ in range(rounds):
        # what is known by now counts, found or seed; contexts without enough of it are left out of this round only
        by_kind = store(cells.drop("kind").join(known, "instance").groupBy("side", "words", "kind").agg(
            F.countDistinct("instance").alias("n_known")).where(F.col("n_known") >= support), "pii-supported")
        near = cells.drop("kind").join(by_kind.select("side", "words").distinct(), ["side", "words"])
        total = near.groupBy("side", "words").agg(F.countDistinct("instance").alias("n_all"))
        patterns = store(by_kind.join(total, ["side", "words"]).where(F.col("n_known") >= confidence * F.col("n_all")).select(
            "side", "words", "kind", (F.col("n_known") / F.col("n_all") * F.log2(F.col("n_known") + 1)).alias("score")), "pii-patterns")
        votes = cells.drop("kind").join(patterns.withColumnRenamed("kind", "voted"), ["side", "words"]).join(known, "instance", "left_anti")
        new = votes.groupBy("instance", "voted").agg(F.countDistinct("side", "words").alias("n"), F.sum("score").alias("score")).where(
            F.col("n") >= agree).groupBy("instance").agg(F.max_by("voted", F.struct("score", "voted")).alias("kind"))
        known = store(known.unionByName(new), "pii-known")
    return patterns


def personal_data(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, agree: int = AGREE,
                  rounds: int = ROUNDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, and ``base`` and ``spans``: arrays of (start, rank, end, kind) in order, rank being the kind's place."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    ordered = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    keyed = docs.select(F.struct(*keep).alias("kept"), "text", row_key(docs).alias("key"))
    # the occurrences of a text hang on its digits and seeds alone; texts without any have none
    relevant = F.col("text").contains("@") | F.col("text").rlike("[0-9]")
    found = keyed.where(relevant).select("key", "text", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    occurrences = store(_occurrences(found), "pii-occurrences")
    patterns = confident_patterns(occurrences, support, confidence, agree, rounds)
    fresh = _pattern_rows(occurrences.where("kind is null").drop("kind")).join(patterns, ["side", "words"])
    chosen = fresh.groupBy("key", "start", "end", "kind").agg(
        F.countDistinct("side", "words").alias("n"), F.sum("score").alias("score")).where(F.col("n") >= agree).groupBy(
        "key", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    seeds = occurrences.where("kind is not null").select("key", "kind", "start", "end", F.lit(True).alias("is_base"))
    every = seeds.unionByName(chosen.select("key", "kind", "start", "end", F.lit(False).alias("is_base"))).distinct()
    per_doc = every.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", "is_base")).alias("all")).select(
        "key", ordered(F.filter("all", lambda s: s["is_base"])).alias("base"), ordered(F.col("all")).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return keyed.drop("text").join(per_doc.hint("merge"), "key", "left").select(
        "kept.*", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        skip = s["start"] < a["at"]  # inside what is replaced already
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(skip, a["out"]).otherwise(F.concat(a["out"], F.array(
                F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))))).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))))
