"""Salvage within gzip members that hold several records."""

import io
import random

import pytest

from lotwise.llm import warc

RNG = random.Random(3)
MADE = [warc.record(str(i), f"http://a/{i}", RNG.randbytes(400)) for i in range(12)]


def kept(data):
    return [x.fields["warc-record-id"][10:-1] for x in warc.salvage(data) if isinstance(x, warc.Record)]


def reasons(data):
    return [x.reason for x in warc.salvage(data) if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("after", [b"", warc.member(MADE[11])])
def test_damaged_record_of_a_member(after):
    bad = bytearray(MADE[4])
    bad[-40] ^= 1
    data = warc.member(b"".join([*MADE[:4], bytes(bad), *MADE[5:8]])) + after
    assert kept(data) == ["0", "1", "2", "3", "5", "6", "7"] + ["11"] * bool(after)
    assert len(reasons(data)) == 1 and "block digest" in reasons(data)[0]


def test_truncated_stream():
    whole = warc.member(b"".join(MADE))
    data = whole[: len(whole) * 2 // 3]
    assert kept(data) == [str(i) for i in range(len(kept(data)))] and 6 <= len(kept(data)) <= 8
    assert "member cut short" in reasons(data)[-1]


def test_checksum_and_next_member():
    whole = bytearray(warc.member(b"".join(MADE[:6])))
    whole[-6] ^= 1
    assert kept(bytes(whole) + warc.member(MADE[7])) == ["0", "1", "2", "3", "4", "5", "7"]
    cut = warc.member(b"".join(MADE[:6]))
    cut = cut[: len(cut) // 2]
    assert kept(cut + warc.member(MADE[7]))[-1] == "7" and kept(cut + warc.member(MADE[7]))[:2] == ["0", "1"]


@pytest.mark.parametrize("packed", [True, False])
def test_pages_read_as_the_whole(monkeypatch, packed):
    """An archive in small pages gives what it gives as a whole, damaged or not."""
    monkeypatch.setattr(warc.Pages, "PAGE", 97)
    parts = [warc.member(m) if packed else m for m in MADE]
    broken = bytearray(b"".join(parts))
    for at in RNG.sample(range(len(broken)), 4):
        broken[at] ^= 0x55
    for data in (b"".join(parts), bytes(broken), b"junk" + bytes(broken[: len(broken) // 2]), b""):
        assert list(warc.salvage(warc.Pages(io.BytesIO(data), len(data)))) == list(warc.salvage(data))
    pages = warc.Pages(io.BytesIO(data := bytes(broken)), len(data))
    for _ in range(200):
        a, b = sorted(RNG.sample(range(len(data) + 5), 2))
        assert pages[a:b] == data[a:b] and pages.find(data[a : a + 5], max(0, a - 300)) == data.find(data[a : a + 5], max(0, a - 300))
    assert len(pages.pages) <= warc.Pages.KEPT


def test_lost_archives_are_an_error(spark, tmp_path, monkeypatch):
    """Only another attempt's finished archives excuse a move that fails."""
    frame = spark.createDataFrame([(1, "http://a", "x")], "page_id bigint, url string, html string")
    assert warc.write_archives(frame, f"file://{tmp_path}/a") == 1
    assert warc.read_archives(spark, f"file://{tmp_path}/a").count() == 1
    (tmp_path / "b").mkdir(mode=0o755)
    for i in range(8):
        (tmp_path / "b" / f"part-{i:06d}").mkdir()
        (tmp_path / "b" / f"part-{i:06d}" / "other.warc.gz").write_bytes(warc.member(MADE[0]))
    assert warc.write_archives(frame.coalesce(1), f"file://{tmp_path}/b") == 1
    assert warc.read_archives(spark, f"file://{tmp_path}/b").filter("record_id is not null").count() == 8
    assert not [p for p in (tmp_path / "b").iterdir() if p.name.startswith("_tmp")]


@pytest.mark.parametrize("line", [b"WARC/1.0\r\n", b"A: WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n"])
def test_damage_takes_linear_time(line):
    """Version lines without a record behind them: each byte is looked at a few times, however many there are, and the
    record behind them is found."""
    import time

    took = []
    for size in (1 << 20, 4 << 20):
        data = line * (size // len(line)) + b"\r\nxx" + MADE[3]
        began = time.process_time()
        assert kept(data) == ["3"]
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.05) and took[1] < 8


def test_large_fields_and_members(monkeypatch):
    """Fields beyond the bound are no record; a member beyond it gives what comes first, and a gap."""
    long = MADE[1].replace(b"WARC-Date", b"X: " + b"y" * (1 << 17) + b"\r\nWARC-Date", 1)
    assert kept(MADE[0] + long + MADE[2]) == ["0", "2"]
    wide = MADE[1].replace(b"WARC-Date", b"X: " + b"y" * 30_000 + b"\r\nWARC-Date", 1)
    assert kept(MADE[0] + wide + MADE[2]) == ["0", "1", "2"]
    monkeypatch.setattr(warc, "MEMBER_BYTES", 2500)
    data = warc.member(b"".join(MADE[:9])) + warc.member(MADE[10])
    assert kept(data)[:2] == ["0", "1"] and kept(data)[-1] == "10" and "member too large" in " ".join(reasons(data))
