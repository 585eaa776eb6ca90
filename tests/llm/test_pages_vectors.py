"""Archives, url rules and vectors against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import topk, url_filter, warc
from lotwise.session import fresh_path


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    big = "é" * 600
    body = [None, "", "small", "small", big, big, big, "y" * 999, "y" * 999, "WARC/1.1\r\n" * 200, "\x1f\u008b\x08 not a member"]
    body += ["".join(rng.choice("abc <>\r\n") for _ in range(rng.randint(0, 3000))) for _ in range(30)]
    hosts = ["a.example.com", "EXAMPLE.com", "notexample.com", "example.net", "x.y.org", "com", "org.uk", "b.net"]
    paths = ["/en/7", "/en/70?x=1", "/en/6#f", "/de/8", "/de/9", "/es/", "/es", "", "?en/", "/EN/7"]
    urls = [None, "", "no scheme.com/en/7", "http://", "https://Example.COM/en/7/a?b#c", "http://com/en/", "x://y://z/de/8"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(100)]
    rows = [(i, urls[i % len(urls)], body[i % len(body)]) for i in range(107)] + [(None, "http://a.com/en/1", big), (4, "http://b.com", big), (3, None, None)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as digest", "3 as n").repartition(3)


def test_archives(spark, pages):
    rows, frame = pages
    path = fresh_path(spark, "test")
    assert warc.write_archives(frame, path, archive_bytes=20_000) == len(rows)
    got = Counter()
    for r in warc.read_archives(spark, path).collect():
        assert r["reason"] is None
        got[(r["record_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"])] += 1
        assert r["type"] == "revisit" or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        data, top = (h or "").encode(), largest[h or ""]
        again = len(data) >= 1000 and i != top
        want[(f"<urn:page:{'null' if i is None else i}>", len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", f"<urn:page:{top}>" if again else None)] += 1
    assert got == want
    empty = fresh_path(spark, "test")
    assert warc.write_archives(frame.limit(0), empty) == 0 and warc.read_archives(spark, empty).collect() == []


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    made = [warc.record(str(i), f"http://a/{i}", (f"page {i} WARC/1.1\r\n" * (i + 1)).encode()) for i in range(12)]
    parts = [warc.member(m) if packed else m for m in made]
    clean = b"".join(parts)
    assert [x.start for x in warc.salvage(clean)] == [sum(map(len, parts[:i])) for i in range(12)]
    rng = random.Random(1)
    for _ in range(60):
        at = sorted(rng.sample(range(12), 2))
        bad = list(parts)
        for k in at:
            p = bytearray(bad[k])
            how = rng.randrange(4)
            if how == 0:
                p[rng.randrange(len(p) // 2, len(p) - 8)] ^= 0x15
            elif how == 1:
                del p[: rng.randrange(1, len(p))]
            elif how == 2:
                del p[rng.randrange(1, len(p)) :]
            else:
                p[0:0] = b"\x1f\x8b\x08garbage WARC/1.0\r\nx"
            bad[k] = bytes(p)
        data = b"".join(bad)
        out = list(warc.salvage(data))
        gaps = [x for x in out if isinstance(x, warc.Gap)]
        kept = {x.fields["warc-record-id"] for x in out if isinstance(x, warc.Record)}
        assert {f"<urn:page:{i}>" for i in range(12) if i not in at} <= kept
        edges = sorted((x.start, x.stop) for x in out)
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:])) and len(gaps) <= 4
    assert [type(x) for x in warc.salvage(b"junk")] == [warc.Gap] and list(warc.salvage(b"")) == []


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_urls(spark, pages):
    rows, frame = pages
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = Counter(tuple(r) for r in url_filter.judge(frame, rules).collect())
    assert got == Counter((i, *plain_verdict(u)) for i, u, _ in rows)
    assert Counter(tuple(r) for r in url_filter.judge(frame, rules, most_bytes=3).collect()) == got  # a list in parts
    assert url_filter.judge(frame.limit(0), rules).collect() == []
    named = frame.withColumnRenamed("url", "the url.of")
    assert Counter(tuple(r) for r in url_filter.judge(named, rules, url_col="the url.of").collect()) == got
    assert {r["verdict"] for r in url_filter.judge(frame, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 30_000, 7).selectExpr("concat('k', id) as key")
    own = url_filter.Cascade(listed, universe)
    out = universe.withColumn("hit", own.holds(universe["key"])).collect()
    assert all(r["hit"] == (int(r["key"][1:]) % 7 == 0) for r in out) and len(own.levels) > 2 and own.size < 20_000


def plain_top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, v) in enumerate(ok):
        if i % every == 0:
            top = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(ok) if b != a)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(top))
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "QUERY_BYTES", 800)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.2, 1, 3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)] + [(450, rows[7][1]), (500, None), (550, [1.0, None] * 6), (600, [float("nan")] * 12), (650, [float("inf")] * 12), (None, rows[1][1]), (50, rows[2][1]), (700, rows[3][1][:5])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "2 as rank").repartition(3)
    assert Counter(tuple(r) for r in topk.top_k(frame).collect()) == plain_top(rows)
    assert Counter(tuple(r) for r in topk.top_k(frame.limit(3), every=1).collect()).total() in (6, 4, 2, 0)
    assert topk.top_k(frame.limit(0)).collect() == []


def exact_top(rows, k=5, every=50):
    """Scores of whole-number vectors in Python's integers, beyond 64 bits cut to a long."""
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = Counter()
    for a, (i, v) in enumerate(own):
        if i % every == 0:
            top = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(own) if b != a)[:k]
            out.update((i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(top))
    return out


def test_top_k_of_large_components(spark, monkeypatch):
    """Components of any finite size; vectors without components score 0."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(8)
    for scales in ([1e3, 1.2e7, 3e7], [1e8, 1e12], [1e150, 1e300, 1.0]):
        rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice(scales)]) for i in range(120)]
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
        assert Counter(tuple(r) for r in topk.top_k(frame).collect()) == exact_top(rows)
    hollow = [(i, []) for i in range(0, 100, 10)]
    frame = spark.createDataFrame(hollow, "vec_id bigint, embedding array<double>")
    assert Counter(tuple(r) for r in topk.top_k(frame).collect()) == exact_top(hollow)
    assert topk.top_k(spark.createDataFrame([(50, [1e308])], "vec_id bigint, embedding array<double>")).collect() == []
