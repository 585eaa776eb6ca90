"""Conversation repair, block anchors and whitening against brute force."""

import heapq
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lotwise.llm import block_anchors, shared_keys, turn_repair, whitening

SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """conv -> results, by a search for the cheapest path over (place, state)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        own = by[c]
        r, x = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = {1: "", 2: "".join(q for q in x if q not in ".!?")}.get(k, x)
        own += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c, own in by.items():
        own.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(), q[2].encode()))
        faults, seen = [], set()
        for _, r, x in own:
            s = x.rstrip(SPACES)
            faults.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else None)
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        heap, done = [(0, "", 0, "e", ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(own) and state in "ea":
                break
            to = "a" if state == "u" else "u"
            name = {"u": "user:", "a": "assistant:"}[to]
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, name)))
            if i < len(own):
                _, r, x = own[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
                if faults[i] in (None, "truncated"):
                    extra = 3 if faults[i] else 0
                    for s in {to} | ({"s"} if state == "e" else set()):
                        if r[:1] == s:
                            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, s, (*lines, f"{r}:{x}")))
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, to, (*lines, name + x)))
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))
    return out


def talks(seed=7, n=60):
    """Rows of conversations with nulls, ties of turn, repeated rows, odd roles and a long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(40 if c == 5 else rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Usher", "ua"])
            rows.append((c, rng.choice([t, t, t, t, t + 1, t * 2, None]), role, rng.choice(["Hi.", "Yes!", "no end", "", "  ", None, "a.\n", "é?", "x. y"])))
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize("segment", [512, 4, 1])
def test_repair(spark, segment):
    rows = talks()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as conv", "2 as n", "3 as part", "4 as alive").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damage(frame), segment).collect()}
    assert got == plain_repair(rows)


def test_repair_edges(spark):
    """No rows after damage, all turns deleted, equally cheap edits."""
    rows = [(1, 0, "user", "Hi."), (2, 0, "system", "Be nice."), (3, 0, "assistant", ""), (4, 0, "tool", "x")]
    alive = [(*r, r[0] != 1) for r in rows]
    got = {r[0]: tuple(r)[6:] for r in turn_repair.repair(spark.createDataFrame(alive, "conv bigint, turn bigint, role string, text string, alive boolean")).collect()}
    assert got == {1: (0, "", ""), 2: (4, "D", ""), 3: (4, "D", ""), 4: (4, "D", "")}


def plain_windows(texts, w):
    """(n_words, n_removed, kept) of each text, every window compared."""
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for x in words:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g).decode()))
    return out


def passages(seed, w):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(6 if w < 10 else 40)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(5)]
    texts = [None, "", " \n", "a", "x y z " * 100]
    for _ in range(50):
        t = []
        for _ in range(rng.randint(0, 6)):
            t += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.3:
                p = rng.choice(shared)
                t += p[rng.randrange(len(p)) :]
        texts.append((" " if rng.random() < 0.7 else "\n\t").join(t))
    return [*texts, texts[9]]


@pytest.mark.parametrize("w, chunk", [(35, 4 << 20), (35, 300), (6, 300), (5, 2000), (2, 4 << 20)])
def test_blocks(spark, monkeypatch, w, chunk):
    """Windows of even and odd length, in one chunk and in many."""
    monkeypatch.setattr(block_anchors, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(shared_keys, "PART_KEYS", 500)
    texts = passages(w + chunk, w)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc"]: r for r in block_anchors.remove_repeats(frame, w).collect()}
    want = plain_windows(texts, w)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(len(texts))] == want
    for i, t in enumerate(texts):  # spans are maximal and hold what is gone
        spans, words = got[i]["spans"], (t or "").encode().split()
        assert all(a["stop"] < b["start"] for a, b in zip(spans, spans[1:]))
        gone = {j for s in spans for j in range(s["start"], s["stop"])}
        assert " ".join(x.decode() for j, x in enumerate(words) if j not in gone) == want[i][2]


def test_long_texts_in_pieces(monkeypatch):
    """Hashes do not depend on how many bytes are hashed at once."""
    raw = " ".join(f"w{i * i % 97}" for i in range(900)).encode()
    whole = block_anchors.Words(raw).hashes(18)
    monkeypatch.setattr(block_anchors, "PIECE_BYTES", 100)
    assert (block_anchors.Words(raw).hashes(18) == whole).all() and len(whole) == 883


@pytest.mark.parametrize("width", [1, 2])
def test_packed_keys(width):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, (1 << (shared_keys.BITS if width == 1 else 64)) - 1, (5000, width), dtype=np.uint64) & ~np.uint64(3)
    keys, times, which = shared_keys.distinct(np.concatenate((keys, keys[:50])))
    assert (times > 1).sum() == 50 and len(which) == 5050
    codes = rng.integers(0, 4, len(keys))
    for some in (keys, keys[:1], keys[[0, -1]]):
        back, code = shared_keys.unpacked(shared_keys.packed(some, codes[: len(some)]), width)
        assert (back == some).all() and (code == codes[: len(some)]).all()
    parts = [(p, k) for p, _, k in shared_keys.dealt(9, keys, codes, 7)]
    assert [p for p, _ in parts] == list(range(7)) and (np.concatenate([shared_keys.unpacked(k, width)[0] for _, k in parts]) == keys).all()


def plain_whitening(vectors):
    """Exact covariance by fractions; eigh and projections in float64."""
    ok = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in ok)
    ok = [(i, x + [0] * (width - len(x))) for i, x in ok]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(width)]
    centred = [[Fraction(n * x[j] - sums[j], n) for j in range(width)] for x in fit]
    cov = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(width)] for a in range(width)])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:4]
    dev = [sum((n * x[j] - sums[j]) ** 2 for j in range(width)) for _, x in ok]
    w = (np.array([x for _, x in ok]) - np.array([float(Fraction(s, n)) for s in sums])) @ v[:, order] / np.sqrt(e[order])
    return [i for i, _ in ok], n, dev, w, e[order] / np.trace(cov)


def check_whitening(rows, vectors):
    ids, n, dev, w, share = plain_whitening(vectors)
    got = defaultdict(list)
    for r in rows:
        got[r[1]].append(r)
    for k in range(w.shape[1]):
        mine = got[k + 1]
        assert Counter((r[0], int(r[3])) for r in mine) == Counter(zip(ids, dev)) and all(r[2] == n for r in mine)
        have = np.array([r[4] for r in sorted(mine, key=lambda r: (str(r[0]), r[3], abs(r[4])))])
        want = np.array([x for _, _, x in sorted(zip(map(str, ids), dev, w[:, k]), key=lambda r: (r[0], r[1], abs(r[2])))])
        assert np.allclose(have, want, atol=1e-7) or np.allclose(have, -want, atol=1e-7)
        assert all(abs(r[5] - share[k]) < 1e-9 and r[6] < 1e-4 for r in mine)
    assert len(got) == w.shape[1]


def test_whitening(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(200)] + [(7, [0.5] * 6)] * 3 + [(201, None), (202, [None] * 6), (203, [float("nan")] * 6), (204, [float("-inf")] + [0.0] * 5), (None, [-0.0, 1.0, 2.0])]
    frame = spark.createDataFrame(vectors, "vec_id int, embedding array<double>").selectExpr("*", "1 as x", "2 as vec", "3 as component").repartition(4)
    check_whitening([tuple(r) for r in whitening.whiten(frame).collect()], vectors)


def test_large_entries_are_exact(spark):
    """Sums beyond 2**64: residues and fractions give the same deviations, and eigenvalues to double precision."""
    rng = random.Random(5)
    vectors = [(i, [float(rng.randrange(-(1 << 40), 1 << 40)), float(rng.randrange(1 << 20)), 1e6 + i]) for i in range(50)]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id int, embedding array<double>")).collect()
    _, _, dev, _, share = plain_whitening(vectors)
    assert sorted(int(r[3]) for r in rows if r[1] == 1) == sorted(dev) and abs(rows[0][5] - share[0]) < 1e-12


def test_residues():
    assert all(p < 1 << 21 for p in whitening.primes(1 << 100))
    for x in (0, -1, 7**25, -(9**30)):
        moduli = whitening.primes(2 * abs(x) + 1)
        assert whitening.remainders([np.array([x % p]) for p in moduli], moduli)[0] == x


def test_whitening_without_variance(spark):
    """One vector, or a dimension that never changes: null coordinates, nothing explained."""
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 2, "vec_id int, embedding array<float>")).collect()
    assert [(r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id int, embedding array<float>")).collect()
    assert [(r[1], r[4] is None, r[5]) for r in rows] == [(1, False, 1.0), (2, True, 0.0)] * 2
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id int, embedding array<float>")).collect() == []


