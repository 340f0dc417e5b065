"""The operators on documents against plain versions, with the awkward rows among the ordinary ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parterre.llm import bpe_chunks, decontam, licenses, ngram_join, pii, quality, token_files
from parterre.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept int, score string, n string, a int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(["an", "el", "or", "té", "ish", "um"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def texts():
    """(doc_id, text): ordinary ones, copies, near copies, and all that could be odd."""
    base = words_of(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    # a long text of one word is one shingle, the same however long
    long = " ".join(words_of(7, 4000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, " ".join(base)), (7, " ".join(base)),
        (8, " ".join(near).upper()), (9, long), (10, "a b c d e f g h " * 40), (11, "日本語 text 😀 with’s odd chars\x00\x85"),
        (12, "reach me at ann.b@mail.example.com or +1 (319) 555-5132, from 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111."),
        (13, "+" * 50 + "1.2.3.4.5.6.7.8 x@y.z_w@v.u 4111-1111-1111-1112 0000 00 +12345678 <|endoftext|> it's"),
        (14, "x" * 20000), (15, "1" * 20000), (None, "no id but words in it"), (6, " ".join(base)), (6, "another text with this id"),
        (16, "Line one\n\nLine one\nLine two | $ & %\n \nLine two | $ & %"), (17, " ".join(words_of(3, 300))),
        (18, " ".join(words_of(3, 300)[:290])), (19, "Released under the MIT License.\nSomething else here and there."),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "k", 1, "x", "y", 2) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- n-gram join


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return Counter((i, len(sets[k]), ids.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_join_equals_all_pairs(docs, none):
    assert rows_of(ngram_join.components(docs), "doc_id", "n_shingles", "component_id") == plain_components(texts())
    assert ngram_join.components(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_join_of_crowded_shingles(spark, seed, monkeypatch):
    """Groups of near copies that chain, share passages and need blocks and the search across components."""
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        text = words_of(10 * seed + g, 60)
        for _ in range(14):
            if rng.random() < 0.7:
                text = list(text)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = "w" + str(rng.randrange(50))
            rows.append((len(rows), " ".join(text[: rng.choice([60, 60, 55, 45])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(ngram_join.components(df), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_tree_bound_never_loses_a_pair():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(pool[rng.integers(0, 1 + 13 * k, 13 * k)]) for k in range(1, 60)]
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(sizes, np.array([ngram_join.point(s) for s in sets]), 80)
    fine = [ngram_join.fine_point(s) for s in sets]
    for i, x in enumerate(sets):
        found = set(tree.near(i)[0].tolist())
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert ngram_join.fine_bound(fine[i], fine[j], len(x), len(y)) >= both
            if i != j and 100 * both >= 80 * (len(x) + len(y) - both):
                assert j in found


# --- personal data

SEEDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(SEEDS.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans(docs, none):
    want = Counter((i, plain_spans(t or "")) for i, t in texts())
    assert rows_of(pii.personal_data(docs).select("doc_id", pii.span_text(F.col("base")).alias("spans")), "doc_id", "spans") == want
    assert pii.personal_data(none).count() == 0


def test_contexts_find_identifiers_that_no_pattern_knows(spark):
    known = [(k, f"please contact agent ann{k}@mail.example.com today about {w}") for k, w in enumerate(words_of(5, 30))]
    unseen = [(100 + k, f"please contact agent ann{k}(at)mail{k} today about it") for k in range(3)]
    other = [(200 + k, f"the number {k}x{k} was {k}y in all") for k in range(40)]
    found = pii.personal_data(spark.createDataFrame(known + unseen + other, "doc_id long, text string")).select(
        "doc_id", pii.span_text(F.col("base")).alias("base"), pii.span_text(F.col("spans")).alias("spans")).collect()
    by_id = {r.doc_id: r for r in found}
    for i, text in unseen:
        at = text.index("ann")
        assert by_id[i].base == "" and by_id[i].spans == f"email:{at}:{text.index(' today')}"
    assert all(r.spans == r.base for r in found if not 100 <= r.doc_id < 200)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a.b@c.de or 10.0.0.1!"), (2, None), (3, "nothing")], "doc_id long, text string")
    found = pii.personal_data(df, keep=("doc_id", "text"))
    texts_ = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert texts_ == {1: "é mail <email> or <ip>!", 2: None, 3: "nothing"}


# --- encoding


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoding_equals_the_library(docs, none):
    tok = library()
    want = Counter()
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), tok.decode(ids, skip_special_tokens=False)] += 1
    encoded = bpe_chunks.encode_documents(docs, tokenizer_path())
    decoded = bpe_chunks.decode_documents(encoded, tokenizer_path(), digest=True)
    assert rows_of(decoded, "doc_id", "n_tokens", "ids_sha256", "decoded") == want
    assert bpe_chunks.encode_documents(none, tokenizer_path()).count() == 0


def test_shared_chunks_are_reused_and_repaired(spark, monkeypatch):
    passage = " ".join(words_of(11, 900))
    rows = [(k, f"{' '.join(words_of(k, 30))} it{'!' * k} {passage[k:]} end{k}") for k in range(6)] + [(9, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tok = library()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_chunks.encode_documents(df, tokenizer_path()).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_token_files_round_trip(docs, none):
    tok = library()
    files = token_files.write_token_files(docs, tokenizer_path(), end_id=0, block_ids=200)
    read = token_files.read_token_files(files, with_ids=True).orderBy("start").collect()
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in texts())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in read) == want
    at = 0
    for r in read:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in read]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    asked = token_files.fetch(files, [4, 17, 12345]).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in asked} == {
        i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts() if i in (4, 17)}
    assert token_files.read_token_files(token_files.write_token_files(none, tokenizer_path())).count() == 0


def test_perfect_hash():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    index = token_files.PerfectHash.build(hashes)
    assert sorted(index.slots(hashes).tolist()) == list(range(len(hashes)))


def test_pairs_across_components_are_given_once_for_a_group():
    """Shingles with nearly the same sets: what is made follows the pairs, not the shingles they share."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400, np.uint64)
    sets = [np.unique(np.append(base[:390], rng.integers(0, 2**63, 8, np.uint64))) for _ in range(20)]
    fine = [ngram_join.fine_point(s) for s in sets]
    rows = [(7, 0, -1, k, k, 0, 0, 0, 0, 0, 0, f) for k, f in enumerate(fine)]
    for token in range(30):  # each without another set
        rows += [(7, 0, token, k, k, ngram_join.point(s), len(s), k, 0, 0, 0, None) for k, s in enumerate(sets) if k != token % 20]
    names = ["group", "cell", "token", "a", "b", "point", "size", "c", "own", "i", "j", "fine"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at: at + 37])], names) for at in range(20, len(rows), 37)]
    first = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows[:20]))[:-1]), pa.array(fine, pa.binary())], names)
    batches = [first, *(b.set_column(11, "fine", pa.nulls(b.num_rows, pa.binary())) for b in batches)]
    for best in (True, False):
        made = [r for b in ngram_join._search_across(80, best)(batches) for r in b.to_pylist() if r["open"] is None]
        assert {(r["a1"], r["a2"]) for r in made} == {(i, j) for i in range(20) for j in range(i + 1, 20)} and len(made) == 190


@pytest.mark.parametrize("together", [ngram_join.TOGETHER, 5_000])
def test_sets_that_nearly_link_are_compared_and_not_listed_in_pairs(spark, together, monkeypatch):
    """A passage whose documents are just too different: what the search makes follows the sets it is given, not their
    pairs. Those that link are found, also where the sets are verified in parts."""
    passage = words_of(21, 200)
    rows = [(k, " ".join([*passage, *(f"own{k}x{n}" for n in range(27))])) for k in range(90)]
    rows += [(100 + k, rows[k][1].rsplit(" ", 4)[0]) for k in range(0, 90, 9)]
    made, names = {}, iter(range(1000))
    store = ngram_join.store

    def counted(df, name):
        made[name, next(names)] = out = store(df, name)
        return out

    monkeypatch.setattr(ngram_join, "TOGETHER", together, raising=False)
    monkeypatch.setattr(ngram_join, "store", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(ngram_join.components(df), "doc_id", "n_shingles", "component_id") == plain_components(rows)
    dealt = sum(df.count() for (name, _), df in made.items() if name == "join-dealt")
    after = [df.count() for (name, k), df in made.items() if k > next(x for n, x in made if n == "join-dealt") and name != "join-dealt"]
    assert dealt > 0 and max(after) <= dealt


def test_a_forest_joins_what_any_link_joins():
    """Fewer links than sets; blocks and shares have the pairs between them only."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 400, np.uint64)
    sets = [np.unique(np.append(base[:360], rng.integers(0, 2**63, 40, np.uint64))) for _ in range(12)]  # 0.818 all
    sets += [np.unique(np.append(base[:350], rng.integers(0, 2**63, 50, np.uint64))) for _ in range(12)]  # 0.778 all
    names = ["group", "cell", "part", "a", "b", "c", "own", "share", "shingles"]

    def links(cell, part, own, share, c=range(24)):
        columns = [[1] * 24, [cell] * 24, [part] * 24, range(24), range(24), c, own, share]
        batch = pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int64()) for x in columns), pa.array([x.tobytes() for x in sets], pa.binary())], names)
        return [(r["a1"], r["a2"]) for b in ngram_join._forest(80)([batch.slice(0, 7), batch.slice(7)]) for r in b.to_pylist()]

    alone, odd = [0] * 24, [k % 2 for k in range(24)]
    linked = lambda i, j: ngram_join._similar(sets[i], sets[j], 80)
    reach = {i for i in range(24) if any(linked(i, j) for j in range(24) if i != j)}
    for cell, part, own, share in ((0, 0, alone, alone), (1, 0, odd, alone), (0, 1, alone, odd)):
        found = links(cell, part, own, share)
        assert all(linked(i, j) for i, j in found) and len(found) == len(reach) - 1 and {x for pair in found for x in pair} == reach
        assert all(i % 2 != j % 2 for i, j in found) or not (cell or part)
    assert links(0, 0, alone, alone, [5] * 24) == []


def test_a_shingle_that_tasks_repeat_loses_no_pair():
    """Rows of one class that fill a batch: the class after them still meets those before them."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 100, np.uint64)
    point = ngram_join.point(base)
    batch = lambda keys: pa.RecordBatch.from_arrays([pa.array([5 << 24 | 100] * len(keys)), pa.array(keys), pa.array(keys), pa.array([point] * len(keys))],
                                                    ["slot", "a", "b", "point"])
    made = [r for b in ngram_join._search(80)([batch([1] + [2] * 900), batch([2, 3])]) for r in b.to_pylist()]
    assert {(r["a1"] if "a1" in r else r["a"], r["a2"]) for r in made if r["a2"] is not None} == {(1, 2), (1, 3), (2, 3)}


# --- decontamination, quality, licences


def plain_contamination(rows, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall((t or "").translate(LOWER))
    out = Counter()
    for i, text in rows:
        w = cut(text)
        hit, found = set(), set()
        for item, t in items:
            v = cut(t)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p: p + n] == v[k: k + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = tuple(sorted(str(x) for x in found if x is not None))
        out[i, len(w), len(hit), names, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination(spark, docs, none):
    base = words_of(1, 120)
    items = [(1, " ".join(base[20:45])), (2, "One"), (3, None), (10, " ".join(base[40:52]) + " other words"), (11, "a b c d e f g h " * 3),
             (None, " ".join(base[70:90])), (12, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, benchmark).withColumn("names", F.array_join("items", ",")).collect()
    have = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got)
    assert have == plain_contamination(texts(), items)
    assert decontam.contamination(none, benchmark).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, benchmark.limit(0)).collect()} == {0}


def test_near_matches(spark):
    items = decontam.item_table(spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "epsilon so delta and gamma of beta by alpha"), (2, "alpha " + "x " * 80 + "beta gamma")], "key long, text string")
    found = decontam.near_matches(items, decontam.build_index(docs, items), within=30, least=5)
    assert [(r.key, r.n_terms) for r in found.collect()] == [(1, 5)]


def test_near_matches_find_every_span_up_to_the_limit(spark):
    names = "alpha beta gamma delta epsilon".split()
    items = decontam.item_table(spark.createDataFrame([(1, " ".join(names))], "item_id long, text string"))
    rng, rows, spans = random.Random(4), [(0, None), (1, "")], {}
    for key in range(2, 40):
        at = [10, 16, 22, 28, 35] if key == 2 else sorted(rng.sample(range(60), 5))
        line = ["x"] * 70
        for place, name in zip(at, names):
            line[place] = name
        rows.append((key, " ".join(line)))
        spans[key] = at[-1] - at[0] + 1
    docs = spark.createDataFrame(rows, "key long, text string")
    found = decontam.near_matches(items, decontam.build_index(docs, items), within=30, least=5)
    assert {r.key for r in found.collect()} == {k for k, span in spans.items() if span <= 30}


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if seen[tuple(w[k: k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_and_outliers(spark, docs, none):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(quality.quality_rules(docs), "doc_id", *columns) == Counter((i, *plain_counts(t)) for i, t in texts())
    assert quality.quality_rules(none).count() == 0
    clean = [(k, " ".join(words_of(k, 60 + k)), "en", "s") for k in range(60)]
    odd = [(100 + k, " ".join(x + "$$%" for x in words_of(k, 80)), "en", "s") for k in range(4)]
    judged = quality.quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string"), min_rows=20)
    assert {r.doc_id for r in judged.collect() if not r.kept} == {100, 101, 102, 103}


def test_licenses(docs, none):
    found = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (found[19].licenses, found[19].best_license, found[19].best_dice) == ("MIT", "MIT", 1.0)
    assert all(r.licenses == "" and r.best_dice is None for i, r in found.items() if i != 19)
    assert licenses.license_scan(docs).count() == len(texts())
    assert licenses.license_scan(none).count() == 0
