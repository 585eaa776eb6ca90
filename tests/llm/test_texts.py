"""Operators on texts against brute force over the same rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lotwise.llm import packing, piece_codec, quality_model, quality_rules, secret_scan, simhash, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(frame, *cols):
    return Counter(tuple(r[c] for c in cols) for r in frame.collect())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain_fp(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, radius=4):
    """Index of the component of each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, none):
    fps = [plain_fp(r[1]) for r in rows]
    comp = components(fps)
    least = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    want = Counter((r[0], f - (1 << 64) if f >> 63 else f, least[c]) for r, f, c in zip(rows, fps, comp))
    assert bag(simhash.near_duplicates(docs), "doc", "fp", "component") == want
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("radius", [2, 4])
def test_covering_masks(radius):
    rng = np.random.default_rng(3)
    for family in (0, 1):
        m = [x & (1 << 64) - 1 for x in simhash.masks(radius, family)]
        assert len(m) == 2 ** (radius + 1) - 1 and all(20 < x.bit_count() < 44 for x in m)
        for _ in range(3000):
            d = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(x & d == 0 for x in m)


def test_simhash_large_buckets(spark):
    """A ball of near fingerprints, with buckets so small that all families and the blocks are needed."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**62))
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 2**62, 50)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = [(r["src"], r["dst"]) for r in simhash.links(frame, bucket=4).collect()]
    u = [f & (1 << 64) - 1 for f in fps]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges) or edges
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(at[a])] = find(at[b])
    want, got = components(u), [find(i) for i in range(len(fps))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def base_spans(t):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, docs, rows, none):
    said = lambda s: ",".join(f"{x['kind']}:{x['start']}:{x['stop']}" for x in s)
    got = secret_scan.scan(docs).collect()
    want = Counter((r[0], ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(r[1] or ""))) for r in rows)
    assert Counter((r["doc"], said(r["base"])) for r in got) == want
    assert all({*map(str, r["base"])} <= {*map(str, r["spans"])} for r in got)
    assert secret_scan.scan(none).collect() == []
    key = "Zx9Qw3Lk7Vb2Nm5Rt8Yp4Hj6"
    frame = spark.createDataFrame([(1, f"the credential is {key} here"), (2, "the credential is your_password_here_username ok"), (3, f"we saw {key} today")], "doc_id int, text string")
    found = {r["doc"]: (said(r["spans"]), r["clean"]) for r in secret_scan.scan(frame).collect()}
    assert found == {1: (f"novel:18:{18 + len(key)}", "the credential is [SECRET] here"), 2: ("", "the credential is your_password_here_username ok"), 3: ("", f"we saw {key} today")}


def removed(texts, length):
    """Brute force: every byte of a string of ``length`` bytes that starts twice."""
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out.append((len(d), int(gone.sum()), len(edges) // 2, sha(bytes(np.frombuffer(d, np.uint8)[~gone]))))
    return out


@pytest.mark.parametrize("length", [64, 200])
def test_suffix_dedup(docs, rows, none, length):
    out = suffix_dedup.remove_repeats(docs, length)
    got = Counter((r["doc"], r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in out.collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], length)))
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_suffix_dedup_small_alphabet(spark):
    rng = np.random.default_rng(0)
    made = ["".join(rng.choice(list("ab"), 40)) * int(rng.integers(1, 12)) + "".join(rng.choice(list("abc"), int(rng.integers(0, 300)))) for _ in range(40)]
    made += [made[3][50:] + made[5][:260], made[7][13:400] + "zz" + made[7][:300]]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")
    got = {r["doc"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert [got[i] for i in range(len(made))] == removed(made, 200)


@pytest.mark.parametrize("length", [9, 64, 200])
def test_plain_refinement_finds_the_same_places(docs, none, length):
    """Every place sorted by bucket pointers, against the runs that the operator works on and brute force."""
    plain = bag(suffix_dedup.refined_places(docs, length), "doc_key", "text_key", "at")
    assert max(plain.values(), default=1) == 1
    if length > suffix_dedup.Q:
        _, spans = suffix_dedup.repeated_spans(docs, length)
        assert {(r["doc_key"], r["text_key"], at) for r in spans.collect() for at in range(r["first"], r["last"] + 1)} == plain.keys()
    seen, keyed = Counter(), suffix_dedup._keyed(docs, "doc_id", "text").collect()
    strings = [(r["doc_key"], r["text_key"], at, r["text"].encode()[at : at + length]) for r in keyed for at in range(len(r["text"].encode()) - length + 1)]
    seen.update(x[3] for x in strings)
    assert {x[:3] for x in strings if seen[x[3]] > 1} == plain.keys()
    assert suffix_dedup.refined_places(none, length).collect() == []


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    out = packing.pack(docs, window=64).orderBy("sequence_id", "offset").collect()
    at, stream = 0, []
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["sequence_id"], r["offset"]) == divmod(at, 64) and len(ids) == r["length"] > 0 and r["offset"] + r["length"] <= 64
        stream.append((r["doc"], r["start"], ids, r["doc_tokens"]))
        at += len(ids)
    got, i = Counter(), 0
    while i < len(stream):
        doc, start, ids, n = stream[i]
        assert start == 0
        i += 1
        while len(ids) < n:
            assert stream[i][0] == doc and stream[i][1] == len(ids)
            ids = ids + stream[i][2]
            i += 1
        got[(doc, tuple(ids))] += 1
    assert got == want and packing.pack(none).collect() == []


def test_chunk_encoder():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkEncoder(packing.tokenizer_path())
    own.cache.most = 3
    odd = ["It's WE'LL don't", "Éa!!! ÇA; x'y", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0w", "İstanbul ΣΑΣ Σ", "e\u0301 \u0301a", "1234 a1b2 ½²", "ﬁ \u2028 \u200b", "***a###", "()", ""]
    odd += [own.between, f"a {own.between.upper()}! b"] * (len(own.between) > 0)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(odd[:-2])] == [tok.encode(x, add_special_tokens=False).ids for x in odd[:-2]]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(odd)] == [tok.encode(x, add_special_tokens=False).ids for x in odd]


def test_pieces(docs, rows, none):
    codec = piece_codec.PieceCodec(piece_codec.model_path())
    want = Counter((r[0], tuple(codec.library.encode(r[1] or "", add_eos=True)), r[1] or "") for r in rows)
    got = Counter((r["doc"], tuple(r["ids"]), r["decoded"]) for r in piece_codec.encode_decode(docs).collect())
    assert {(a, b) for a, b, _ in got.elements()} == {(a, b) for a, b, _ in want.elements()} and sum(got.values()) == sum(want.values())
    codec.chunks.most = codec.parts.most = 3
    odd = ["", " ", "  ", " a  b ", "a\nb\tc", "▁x", "é\0z", "😀 \U0001f9ff", "\u200b", "</s><s>", "\n", " \n \n", "x ▁ y▁", "\ufffdq", "<0x41>", "▁" * 20 + "q", "  \n\n   z", *(r[1] or "" for r in rows)]
    for x in odd:
        ids = np.frombuffer(codec.encode(x), "<i4")
        assert ids.tolist() == codec.library.encode(x, add_eos=True) and codec.decode(ids) == codec.library.decode(ids.tolist())
    for ids in ([3 + 0xC3, 2], [3 + 0xF0, 3 + 0x9F, 300], [1, 0, 5000], [28705, 300]):
        assert codec.decode(np.array(ids)) == codec.library.decode(ids)
    assert piece_codec.encode_decode(none).collect() == []


def plain_counts(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_quality_rules(docs, rows, none):
    out = quality_rules.filtered(docs).collect()
    got = Counter((r["doc"], *(r[c] for c in quality_rules.COUNTS[:5]), r["base_failed"]) for r in out)
    want = Counter()
    for r in rows:
        c = plain_counts(r[1] or "")
        want[(r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want and not any(r["base_failed"] and r["kept"] for r in out)
    assert quality_rules.filtered(none).collect() == []


def test_quality_rules_adapt(spark):
    """A source full of signs keeps its usual documents; elsewhere the same share of signs fails."""
    rng = np.random.default_rng(2)
    text = lambda k: " ".join(f"word{rng.integers(1e6)}" + "#" * int(rng.poisson(k)) for _ in range(60))
    rows = [(i, text(1.0), "en", "code") for i in range(150)] + [(1000 + i, text(0), "en", "news") for i in range(150)] + [(5000, text(1.0), "en", "news"), (5001, text(12), "en", "code")]
    kept = {r["doc"]: r["kept"] for r in quality_rules.filtered(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert not kept[5000] and not kept[5001] and sum(kept.values()) >= 298


def test_quality_model(spark, docs, rows, none):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    model = quality_model.fit(*tables)
    out = quality_model.score(tables[0], model).join(tables[1].withColumnRenamed("doc_id", "doc"), "doc").filter(quality_model.fold("doc") == 0)
    own = [(r["score"], r["quality"]) for r in out.collect()]
    assert len(own) > 50 and sum((s >= 0.3) == q for s, q in own) / len(own) >= 0.97
    scored = quality_model.score(docs, model, keep=("lang", "n")).collect()
    assert Counter(r["doc"] for r in scored) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_model.score(none, model).collect() == []
    assert quality_model.score(docs, quality_model.fit(docs, tables[1].limit(0))).count() == len(rows)


def test_gradients():
    rng = np.random.default_rng(0)
    f, starts, y = rng.normal(size=(7, quality_model.N_FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0, 1])
    w = {k: rng.normal(0, 0.3, n) for k, n in {"W": (f.shape[1], 4), "b": 4, "V": (4, 3), "U": (4, 3), "w": 3, "c": 4}.items()} | {"d": np.array(0.1)}
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := quality_model.forward(f, starts, w)["p"], 1 - p)))
    g = quality_model.gradients(f, starts, y, w, 0.0)
    for k in w:
        flat, i = w[k].reshape(-1), 0
        was, got = flat[i], []
        for step in (1e-5, -1e-5):
            flat[i] = was + step
            got.append(loss())
        flat[i] = was
        assert abs((got[0] - got[1]) / 2e-5 - g[k].reshape(-1)[i]) < 1e-6


def test_crc_of_pieces(docs):
    out = packing.pieces(docs).join(packing.pack(docs).withColumnRenamed("doc", "doc_id"), ["sequence_id", "offset"])
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out.select("ids", F.col("ids_crc32")).collect())
