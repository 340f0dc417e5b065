"""Alignment against a plain version by the libraries, and joins of fragments in any order."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from parterre.llm import alignment as A
from parterre.llm.queries import tokenizer_path
from parterre.llm.tokens import byte_tokens

PATHS = (tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def plain(texts):
    """[n_a, n_b, n_groups, n_links, n_best, count_sum, sha] of each text, by byte spans of every token."""
    tokenizers = A.Tokenizers(*PATHS)
    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_lib.encode_special_tokens = True
    rows, total = [], Counter()
    for text in texts:
        spans = [[], []]
        if text:
            ids = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            for side, known in enumerate((tokenizers.bytes_a, tokenizers.bytes_b)):
                at = 0
                for k in ids[side]:
                    spans[side].append((at, at + len(known[k]), k))
                    at += len(known[k])
            if any(b"".join(known[k] for k in ids[side]) != (" " + text).encode()
                   for side, known in enumerate((tokenizers.bytes_a, tokenizers.bytes_b))):
                spans = [[], []]
        cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        of_group = lambda side, low, high: [s for s in spans[side] if low < s[1] <= high]
        groups = [[of_group(side, low, high) for side in (0, 1)] for low, high in zip([0, *cuts], cuts)]
        pairs = Counter((x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1])
        written = ";".join("|".join(",".join(str(s[2]) for s in side) for side in g) for g in groups)
        rows.append((len(spans[0]), len(spans[1]), len(groups), pairs, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
        total += pairs
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, n_groups, sum(pairs.values()), sum(n for p, n in pairs.items() if total[p] == most[p[1]]),
             sum(n * total[p] for p, n in pairs.items()), sha) for n_a, n_b, n_groups, pairs, sha in rows]


def made_up(rng, n):
    parts = ["word", "Straße", "naïve", "don't", "  ", "\n", "\t ", "漢字", "🙂", "0x1F", "<|endoftext|>", "<s>", "...", " ", "　 x", "é", "a  b", "x ", " y", "Ⅷ", " ", "\x00", "ﬁ"]
    return "".join(rng.choice([" ", " ", " ", ""]) + (rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choices("abcdeflmnorst", k=rng.randint(1, 12)))) for _ in range(n))


def test_alignment_equals_a_plain_one(spark):
    rng = random.Random(2)
    texts = [made_up(rng, rng.randint(1, 60)) for _ in range(60)] + ["", None, " ", "  ", "x▁y", "plain", "plain", "z" * 700, "q " * 300]
    texts += [made_up(rng, 700) for _ in range(3)] + [made_up(rng, 400) + "▁" + made_up(rng, 200), ("ab" * 150 + " ") * 4]
    docs = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, key string, part int").repartition(3)
    found = A.aligned(frame, *PATHS, range_bytes=300, context=120).collect()
    want = Counter((d[0], *row) for d, row in zip(docs, plain(texts)))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found) == want


def test_alignment_of_nothing(spark):
    assert A.aligned(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_stretches_are_encoded_as_in_their_text():
    rng = random.Random(5)
    stretches = A.Stretches(A.Tokenizers(*PATHS))
    for _ in range(200):
        text = " " + made_up(rng, 40)
        whole = stretches.tokenizers.encode(text)
        (fragment, _) = A.range_fragment(stretches, text, 0, len(text.encode()))
        if whole is None:
            assert fragment is None
        else:
            written, n_groups, links = A.closed_groups(*[[k for k, _ in side] for side in whole], *[[n for _, n in side] for side in whole])
            assert (";".join(fragment.closed), fragment.n_groups, fragment.n_links) == (written, n_groups, len(links))


def test_fragments_join_in_any_order():
    rng = random.Random(9)
    for _ in range(100):
        size = rng.randint(1, 60)
        sides = []
        for _ in range(2):
            ends = sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))})
            sides.append([(rng.randint(0, 9), y - x) for x, y in zip([0, *ends], ends)])
        whole = A.fragment_of(*sides)
        edges = sorted(rng.sample(range(1, size), min(size - 1, rng.randint(0, 9))))
        parts = [A.fragment_of(*sides, low, high) for low, high in zip([0, *edges], [*edges, size])]
        joined: list = []
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k: k + 2] = [A.Fragment.of_json(parts[k].join(parts[k + 1], lambda a, b: joined.extend(A.links(a, b))).to_json())]
        assert (";".join(parts[0].closed), parts[0].n_groups, parts[0].n_links, parts[0].suffix) == (
            ";".join(whole.closed), whole.n_groups, whole.n_links, ([], []))
