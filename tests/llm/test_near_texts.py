"""Near-duplicate texts of the pipeline against planted pairs and brute force over shingle sets."""

import random

import corpus_pipeline
import pytest
from test_texts import plain_fp

from lotwise.llm import near_texts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_planted_pairs(spark):
    """Pairs of similarity 0.8 to 0.95 are found, though most fingerprints differ in over 4 bits; texts that only
    share what they repeat stay."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    made = []
    for k in range(60):
        base = [word() for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(10, 190), 1 + k % 4):
            other[at] = word()
        made += [" ".join(base), " ".join(other)]
    repeated = "over and over it says this line " * 60
    made += [repeated + " ".join(word() for _ in range(40)) for _ in range(2)]
    assert sum((plain_fp(a) ^ plain_fp(b)).bit_count() > 4 for a, b in zip(made[:120:2], made[1:120:2])) > 20
    assert (plain_fp(made[-1]) ^ plain_fp(made[-2])).bit_count() <= 4
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert kept == {*range(0, 120, 2), 120, 121} == {made.index(made[g]) for g in groups(made)}


@pytest.mark.parametrize("block", [256, 4])
def test_large_groups(spark, block):
    """Chains and balls of near texts, in one task or with a head and blocks."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    made = []
    for length in (1, 20):
        text = [word() for _ in range(90)]
        for _ in range(length):
            made.append(" ".join(text))
            for at in rng.sample(range(90), 1):
                text[at] = word()
    core = [word() for _ in range(90)]
    made += [" ".join([word(), *core[:-1], word()]) for _ in range(15)]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    want = {min(j for j, h in enumerate(groups(made)) if h == g) for g in groups(made)}
    assert {r["doc"] for r in near_texts.one_of_each(frame, block=block).collect()} == want
