"""WARC writer and salvage reader.

The writer makes one gzip member a record, in archives of bounded size below the folder that all executors share;
payloads seen before become revisit records. The reader checks every record (member CRC, version line, fields,
length, terminator, digests). Where a check fails it searches for the next place at which a member or a version line
begins a record that passes, goes on from there, and reports the bytes between as a quarantined gap. An archive is
read in pages, so a task holds a few of them and one member's content, however large the archive is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import column, table
from lotwise.operators.skew import hot_keys, skew_join
from lotwise.session import fresh_path, written

#: Payloads below this many bytes are always stored in full.
REVISIT_BYTES = 1000
#: An archive is closed when it has this many bytes, so that a reading task holds few bytes at once.
ARCHIVE_BYTES = 32 << 20
#: A record's fields have so many bytes at most, and a member's content; what is longer is quarantined.
HEAD_BYTES, MEMBER_BYTES = 1 << 16, 1 << 30
MAGIC, VERSION, BREAK = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD, VERSION_LINE = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n"), re.compile(rb"WARC/1\.\d\r\n")


class Record(NamedTuple):
    start: int
    stop: int
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    start: int
    stop: int
    reason: str


class Broken(ValueError):
    """A check failed. No record begins before ``until``, if that is known."""

    def __init__(self, why: str, until: int = 0):
        super().__init__(why)
        self.until = until


class Pages:
    """An archive as bytes that are read where they are asked for; KEPT pages stay in memory."""

    PAGE, KEPT = 4 << 20, 4

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size
        self.pages: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def page(self, i: int) -> bytes:
        if i not in self.pages:
            self.file.seek(i * self.PAGE)
            self.pages[i] = self.file.read(self.PAGE)
            if len(self.pages) > self.KEPT:
                self.pages.popitem(last=False)
        self.pages.move_to_end(i)
        return self.pages[i]

    def __getitem__(self, where: slice) -> bytes:
        at, stop, _ = where.indices(self.size)
        if at >= stop:
            return b""
        first, last = at // self.PAGE, (stop - 1) // self.PAGE
        whole = self.page(first) if first == last else b"".join(map(self.page, range(first, last + 1)))
        return whole[at - first * self.PAGE : stop - first * self.PAGE]

    def startswith(self, what: bytes, at: int) -> bool:
        return self[at : at + len(what)] == what

    def find(self, what: bytes, at: int) -> int:
        while at < self.size:
            stop = (at // self.PAGE + 1) * self.PAGE + len(what) - 1  # what begins in this page may end in the next
            if (i := self[at:stop].find(what)) >= 0:
                return at + i
            at = stop - len(what) + 1
        return -1


Data = bytes | Pages


class Next:
    """Where member and version lines begin ahead; what was found is kept until it is passed."""

    def __init__(self, data: Data):
        self.data, self.known = data, {MAGIC: -1, VERSION: -1}

    def after(self, at: int, until: int = 0) -> int:
        """The first such place behind ``at``, or the end; version lines before ``until`` are passed over."""
        for what, i in self.known.items():
            start = max(at + 1, until if what == VERSION else 0)
            if i < start:
                found = self.data.find(what, start)
                self.known[what] = found if found >= 0 else len(self.data)
        return min(self.known.values())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str, url: str, payload: bytes, refers_to: str | None = None, hexdigest: str | None = None) -> bytes:
    """One record with its terminator: a response with an HTTP block, or, with ``refers_to``, a revisit that has the
    block's head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url),
        "WARC-Payload-Digest": digest(payload) if hexdigest is None else "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode(),
        "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    } | ({"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE} if refers_to else {})
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + BREAK + block + BREAK + BREAK


def member(data: bytes, level: int = 4) -> bytes:
    """``data`` as a gzip member of its own."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def fields_at(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Named fields up to the empty line, and where the line ends."""
    out = {}
    while data[at : at + 2] != BREAK:
        if not (m := FIELD.match(data, at)):
            raise Broken("field", at)
        out[m[1].decode("latin-1").lower()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()
    return out, at + 2


def head_at(data: Data, at: int) -> tuple[dict[str, str], int]:
    """The fields behind the version line at ``at`` and where they end. Few bytes are looked at first, as most version
    lines among damaged bytes have no fields behind them; HEAD_BYTES at most.

    A line that is no field breaks the head of every version line above it, as their fields are the same lines: none of
    them begins a record, and the search need not look at them again."""
    for size in (1 << 10, HEAD_BYTES):
        head = data[at : at + size]
        try:
            fields, stop = fields_at(head, 10)
        except Broken as e:
            if size < HEAD_BYTES and head.find(BREAK, e.until) < 0:
                continue  # the line may only be cut
            raise Broken("field", at + e.until) from None
        return fields, at + stop
    raise Broken("field")


def parse(data: Data, at: int) -> Record:
    """The record whose version line is at ``at``."""
    if not VERSION_LINE.match(data[at : at + 10]):
        raise Broken("version line")
    fields, body = head_at(data, at)
    if not {"warc-type", "warc-record-id", "content-length"} <= fields.keys() or not fields["content-length"].isdigit():
        raise Broken("missing field")
    stop = body + int(fields["content-length"])
    if stop + 4 > len(data) or data[stop : stop + 4] != BREAK + BREAK:
        raise Broken("length")
    block = data[body:stop]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != digest(block):
        raise Broken("block digest")
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        line = block.find(BREAK)
        if line < 0 or not block.startswith(b"HTTP/"):
            raise Broken("status line")
        try:
            http, rest = fields_at(block, line + 2)
        except Broken:
            raise Broken("field") from None
        payload = block[rest:]
    if fields["warc-type"] == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != digest(payload):
        raise Broken("payload digest")
    return Record(at, stop + 4, fields, http, payload)


def inflate(data: Data, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, where the member ends, and what is wrong with it ("" if nothing):
    of a damaged or truncated member, the content before the error and where its bytes were no longer read; of one with
    more than MEMBER_BYTES of content those, as if the rest were damaged."""
    z, out, pos, room = zlib.decompressobj(31), [], at, MEMBER_BYTES
    while not z.eof:
        if pos >= len(data):
            return b"".join(out), len(data), "member cut short"
        before = z.copy()
        try:
            out.append(z.decompress(data[pos : pos + step], room + 1))
            room -= len(out[-1])
            if room < 0:
                out[-1] = out[-1][: room + len(out[-1])]
                return b"".join(out), min(pos + step, len(data)), "member too large"
        except zlib.error:  # the bytes of this step one by one, up to the error
            for i in range(pos, min(pos + step, len(data))):
                try:
                    out.append(before.decompress(data[i : i + 1]))
                except zlib.error:
                    return b"".join(out), i, "member"
            return b"".join(out), min(pos + step, len(data)), "member"
        pos += step
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def records_in(data: bytes) -> Iterator[Record | Gap]:
    """All records of uncompressed content that pass every check, and the gaps between them."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            one = parse(data, at)
        except Broken as e:
            if bad is None:
                bad, why = at, str(e)
            ahead = data.find(VERSION, max(at + 1, e.until))
            at = ahead if ahead >= 0 else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield one
        at = one.stop
    if bad is not None:
        yield Gap(bad, len(data), why)


def next_start(data: Data, at: int, end: int) -> int:
    """The first place after ``at`` and before ``end`` at which a record or a member with one begins, or ``end``."""
    ahead = Next(data)
    while (at := ahead.after(at)) < end:
        found = records_in(inflate(data, at)[0]) if data.startswith(MAGIC, at) else records_in_place(data, at)
        if any(isinstance(x, Record) for x in found):
            return at
    return end


def records_in_place(data: Data, at: int) -> list[Record]:
    """The record whose version line is at ``at``, if it passes."""
    try:
        return [parse(data, at)]
    except Broken:
        return []


def salvage(data: Data) -> Iterator[Record | Gap]:
    """All records of an archive that pass every check, compressed or not, and the gaps between them.

    A record of a gzip member has the member's start and stop. Records are searched for within the content of a member
    too, also in what comes before an error of its own; a gap inside a member is empty, lies at the member's stop and
    says where in the content it is. A damaged member stops where the next record or member begins in it, or else
    where its bytes were no longer read; a gap, maybe empty, follows it."""
    at, bad, why, ahead = 0, None, "", Next(data)
    while at < len(data):
        found: list[Record | Gap] = []
        wrong, reason, end, until = "", "", at, 0
        if data.startswith(MAGIC, at):
            content, end, wrong = inflate(data, at)
            inner = list(records_in(content))
            if any(isinstance(x, Record) for x in inner):
                end = next_start(data, at, end) if wrong else end
                found = [x._replace(start=at, stop=end) if isinstance(x, Record) else Gap(end, end, f"{x.reason} in the content at {x.start} to {x.stop}") for x in inner]
            else:
                reason = wrong or next((x.reason for x in inner), "empty member")
        else:
            try:
                found = [parse(data, at)]
                end = found[0].stop
            except Broken as e:
                reason, until = str(e), e.until
        if not found:
            if bad is None:
                bad, why = at, reason
            at = ahead.after(at, until)
            continue
        if bad is not None:
            yield Gap(bad, at, why)
        yield from found
        at = end
        bad, why = (end, wrong) if wrong else (None, "")
    if bad is not None:
        yield Gap(bad, len(data), why)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write a record for every row below ``path`` (a URI that pyarrow can write to) and return how many.

    Among rows with equal payloads of REVISIT_BYTES or more, those with the largest id are responses and the others
    revisit it. Nulls: a null payload is empty; a null url is empty; a row with a null id is written as page ``null``
    and revisits an equal payload that has an id. Rows that repeat an id each get a record. A task's archives appear
    at once, when all are complete; a task that runs twice leaves one set.
    """
    payload = F.coalesce(column(payload_col), F.lit(""))
    rows = pages.select(column(id_col).cast("string").alias("page"), column(id_col).alias("__id"), F.coalesce(column(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    size = F.octet_length("payload")
    same = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("largest"), F.max(size).alias("size")).filter("n > 1"), "payloads")
    total = same.agg(F.sum("n")).first()[0] or 0
    large = same.filter(F.col("size") >= REVISIT_BYTES).select("digest", "largest")
    joined = skew_join(rows, large, ["digest"], "left", hot=hot_keys(same, ["digest"], "n", total))
    refers = F.when(F.col("largest").isNotNull() & ~F.col("__id").eqNullSafe(F.col("largest")), F.col("largest").cast("string"))

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)  # also where no task has rows

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        temp, final = f"{root}/_tmp-{task.taskAttemptId()}", f"{root}/part-{task.partitionId():06d}"
        n, k, size, out = 0, 0, 0, None
        store.create_dir(temp, recursive=True)
        for batch in batches:
            for page, url, body, hexdigest, to in zip(*batch.columns, strict=True):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        out.close()
                    out, size, k = store.open_output_stream(f"{temp}/{k:05d}.warc.gz", compression=None), 0, k + 1
                data = member(record(page.as_py() or "null", url.as_py(), body.as_py().encode(), to.as_py(), hexdigest.as_py()))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
        try:
            store.move(temp, final)
        except OSError:
            if store.get_file_info(final).type == fs.FileType.NotFound:
                raise
            store.delete_dir(temp)  # another attempt's archives are there already
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = joined.select("page", "url", "payload", "digest", refers.alias("refers")).mapInArrow(write, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0


ENTRY = "path string, start bigint, stop bigint, reason string, type string, record_id string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record and every gap of the archives below ``path`` (ENTRY; a gap has a reason and no record columns).

    payload_bytes and payload_digest (lower-case hex) are those of the full payload, for revisits too, as their HTTP
    head and digest field state. An archive is read from its start to its end by one task, as only that tells a member
    from bytes within another that look like one; pages of it are in memory, and a member's content (MEMBER_BYTES at most). Empty
    archives give no rows. ``path`` is a URI that pyarrow can read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in ENTRY.split(", "))])
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_file(at) as file:
                    rows, size = [], 0
                    for x in salvage(Pages(file, length)):
                        rows.append(entry(name, x, with_payload))
                        size += len(rows[-1]["payload"] or b"")
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "length").mapInArrow(read, ENTRY)


def entry(path: str, x: Record | Gap, with_payload: bool) -> dict:
    out: dict = dict.fromkeys(f.split()[0] for f in ENTRY.split(", ")) | {"path": path, "start": x.start, "stop": x.stop}
    if isinstance(x, Gap):
        return out | {"reason": x.reason}
    f, said = x.fields, x.fields.get("warc-payload-digest", "")
    length = x.http.get("content-length", "") if f["warc-type"] == "revisit" else ""
    known = base64.b32decode(said[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", said) else hashlib.sha1(x.payload).hexdigest()
    return out | {"type": f["warc-type"], "record_id": f["warc-record-id"], "url": f.get("warc-target-uri"), "payload_bytes": int(length) if length.isdigit() else len(x.payload), "payload_digest": known, "refers_to": f.get("warc-refers-to"), "payload": x.payload if with_payload else None}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    out = read_archives(spark, path, with_payload=False).filter(F.col("reason").isNull())
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
