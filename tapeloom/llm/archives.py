"""Legacy ARC archives and their conversion to WARC.

An ARC file is a row of gzip members, one a record: a header line, a block of as many bytes as the line's last field
declares, a line end. Its first record (``filedesc:``) names the version, and with it the fields of the header lines:

    version 1   url ip date mime length
    version 2   url ip date mime status checksum location offset filename length

``convert`` gives every record an identifier (from file name and offset, so a repeated task makes the same one), an ISO
timestamp, a type and SHA-1 digests of block and payload, and writes gzip members of WARC/1.1. ``filedesc`` becomes
``warcinfo``, a block with an HTTP status line ``response``, any other block ``resource``. Of captures with equal payloads
one stays, the others become ``revisit`` records: HTTP head, digest and length of the payload, and what they refer to.

Files are written by Spark's text writer, one row a file and the file's last zero byte as the line separator, so they go to
any store that Spark knows and a lost task's files vanish with it. A file is closed at ``ROLL`` compressed bytes; only one
record at a time is held unpacked.

Nulls: a null block is an empty one, a null address ``unknown:``, a null time the year 1970; captures without the ordering
field come first. Repeated captures are records of their own; equal ordering values are told apart by identifier. An empty
table gives no records. A header line with too few fields, or whose length is no number, gives a record of type ``unknown``
that ``convert`` leaves out; a block shorter than declared keeps what is there and is marked ``WARC-Truncated``. Other
columns of the captures are not read.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.session import cut_lineage

#: Compressed bytes from which on a file is closed; unpacked bytes of rows that a task hands on at a time.
ROLL = 8 << 20
TOGETHER = 8 << 20
# fixed values: the field names of both versions, as the formats define them
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Length of the full payload in a revisit, which holds the HTTP head alone.
FULL = "X-Payload-Length"


def member(raw: bytes) -> bytes:
    return zlib.compress(raw, 1, wbits=31)


def members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and unpacked bytes of each gzip member; one that breaks off gives what is left of it."""
    view, at = memoryview(raw), 0
    while at < len(view):
        one, parts, end = zlib.decompressobj(wbits=31), [], at
        while not one.eof and end < len(view):
            parts.append(one.decompress(view[end:end + 65536]))
            end = min(len(view), end + 65536)
        yield at, b"".join(parts)
        at = end - len(one.unused_data)


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(block.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n")]
    at, n = min(((a, n) for a, n in ends if a >= 0), default=(len(block), 0))
    return block[:at + n], block[at + n:]


def field(head: bytes, name: str) -> str | None:
    """Value of a header field in lines of ``name: value``."""
    want = name.lower().encode()
    for line in head.split(b"\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == want:
            return value.strip().decode("utf-8", "replace")
    return None


def number(text: str | None) -> int | None:
    t = (text or "").lstrip("-")
    return int(text) if t.isascii() and t.isdigit() and len(t) < 19 else None


def iso_time(digits: str) -> str:
    """WARC date of an ARC date of 4 to 14 digits; what is missing is the earliest."""
    if not (digits.isascii() and digits.isdigit() and 4 <= len(digits) <= 14):
        digits = "1970"
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(raw: bytes) -> Iterator[dict]:
    """Records of one ARC file: offset, version, kind, the header's fields and the block."""
    version = 1
    for at, record in members(raw):
        line, _, rest = record.lstrip(b"\r\n").partition(b"\n")
        if not line:
            continue
        if line.startswith(b"filedesc:"):  # its own header line has the fields of version 1
            version = 2 if rest[:1] == b"2" else 1
            names = FIELDS[1].split()
        else:
            names = FIELDS[version].split()
        cut = line.rstrip(b"\r").decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        got = dict(zip(names, cut)) if len(cut) == len(names) else {}
        length = number(got.get("Archive-length"))
        if length is None or length < 0:
            yield {"offset": at, "version": version, "kind": "unknown", "fields": got, "block": b"", "truncated": False}
            continue
        block = rest[:length]
        kind = "warcinfo" if line.startswith(b"filedesc:") else "response" if block.startswith(b"HTTP/") else "resource"
        yield {"offset": at, "version": version, "kind": kind, "fields": got, "block": block, "truncated": len(block) < length}


def in_files(records: Iterator[bytes], first: bytes) -> Iterator[bytes]:
    """Contents of files that each begin with ``first``, without the last byte, which the writer adds."""
    last = member(b"")[:-1]  # of an empty member, as the writer ends each file by a zero byte
    parts, size = [member(first)], 0
    for r in records:
        parts.append(member(r))
        size += len(parts[-1])
        if size >= ROLL:
            yield b"".join([*parts, last])
            parts, size = [member(first)], 0
    if len(parts) > 1:
        yield b"".join([*parts, last])


def write_files(df: DataFrame, pack, path: str) -> None:
    """``pack`` makes file contents of Arrow batches; each row that it yields becomes a file."""
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for content in pack(batches):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])

    out = df.mapInArrow(rows, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def write_arc(captures: DataFrame, path: str, version: int) -> None:
    """Archives of ``captures`` (url, date, mime, block) in either version; dates are 14 digits."""
    about = f"{version} 0 tapeloom\n{FIELDS[version]}\n\n".encode()

    def pack(batches: Iterator) -> Iterator[bytes]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for url, date, mime, block in zip(*(batch.column(i) for i in range(4))):
                    block, date = block.as_py() or b"", date.as_py() or "19700101000000"
                    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url.as_py() or "unknown:")
                    head = f"{url} 0.0.0.0 {date} {mime.as_py() or 'application/octet-stream'}"
                    if version == 2:
                        status = block[9:12].decode("latin-1") if block.startswith(b"HTTP/") else "0"
                        head += f" {status} {hashlib.md5(block).hexdigest()} - 0 -"
                    yield f"{head} {len(block)}\n".encode() + block + b"\n"

        yield from in_files(records(), f"filedesc://tapeloom.arc 0.0.0.0 19700101000000 text/plain {len(about)}\n".encode() + about + b"\n")

    write_files(captures.select("url", "date", "mime", F.col("block").cast("binary")), pack, path)


PARSED = "record_id string, version int, kind string, url string, ip string, date string, mime string, truncated boolean, head binary, payload binary, payload_bytes long, key binary, rank long"


def parsed(spark: SparkSession, arcs: str, rank: str, bodies: bool) -> DataFrame:
    """Records of all ARC files below a path; ``rank`` names the HTTP field whose number orders captures."""
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in PARSED.split(", ")]
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, PARSED.split(", "))])
        made, size = [], 0
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                for r in parse_arc(content.as_py()):
                    head, payload = payload_of(r["block"]) if r["kind"] == "response" else (b"", r["block"])
                    f = r["fields"]
                    made.append((
                        f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.as_py()}#{r['offset']}')}>", r["version"], r["kind"], f.get("URL"), f.get("IP-address"), iso_time(f.get("Archive-date", "")), f.get("Content-type"), r["truncated"],
                        head if bodies else None, payload if bodies else None, len(payload), hashlib.sha256(payload).digest(), number(field(head, rank)),
                    ))
                    size += len(r["block"]) if bodies else 200
                    if size >= TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made), schema)], schema=schema)
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made), schema)], schema=schema)

    return files(spark, arcs).mapInArrow(rows, PARSED)


def as_warc(r: dict) -> bytes:
    """Bytes of one WARC record; ``to`` is the capture that a revisit refers to."""
    revisit = r["to"] is not None
    info = f"converted-from: ARC/{r['version']}\r\nformat: WARC File Format 1.1\r\n".encode()
    block = info if r["kind"] == "warcinfo" else r["head"] if revisit else r["head"] + r["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['kind']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}"]
    if r["kind"] != "warcinfo":
        lines += [f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest'] if revisit else base32_sha1(r['payload'])}"]
    if revisit:
        lines += [f"WARC-Refers-To: {r['to']['record_id']}", f"WARC-Refers-To-Target-URI: {r['to']['url']}", f"WARC-Refers-To-Date: {r['to']['date']}", f"WARC-Profile: {PROFILE}", f"{FULL}: {r['payload_bytes']}"]
    if r["truncated"]:
        lines.append("WARC-Truncated: length")
    mime = "application/warc-fields" if r["kind"] == "warcinfo" else "application/http; msgtype=response" if r["kind"] == "response" else r["mime"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arcs: str, warcs: str, rank: str, least: int = 0) -> None:
    """WARC files of all ARC files below a path.

    Captures are parsed twice: for the SHA-256 of their payloads, of which those that recur are kept as a table with the
    capture of the largest ``rank``, and for the bodies, which meet that table. Spark broadcasts it while it is small. Payloads
    of fewer than ``least`` bytes are never revisits.
    """
    seen = parsed(spark, arcs, rank, bodies=False).where((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    first = F.max(F.struct("rank", "record_id", "url", "date"))
    again = cut_lineage(seen.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("key", "first"))
    records = parsed(spark, arcs, rank, bodies=True).where("kind <> 'unknown'")
    revisit = (F.col("kind") == "response") & (F.col("payload_bytes") >= least) & (F.col("first.record_id") != F.col("record_id"))
    told = records.join(again, "key", "left").withColumn("to", F.when(revisit, F.col("first")))
    told = told.withColumn("sha1", F.when(revisit, F.unhex(F.sha1("payload")))).withColumn("payload", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload"))).drop("first", "key", "rank")

    def pack(batches: Iterator) -> Iterator[bytes]:
        def made() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    if r["kind"] != "warcinfo":  # every file gets one of its own
                        yield as_warc(r | {"digest": base64.b32encode(r["sha1"]).decode() if r["sha1"] else None})

        about = {"kind": "warcinfo", "version": "1 and 2", "to": None, "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, warcs)}>", "date": iso_time(""), "truncated": False}
        yield from in_files(made(), as_warc(about))

    write_files(told, pack, warcs)


RECORD = "record_id string, type string, date string, target_uri string, payload_digest string, refers_to string, payload_bytes long, intact boolean, head binary, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below a path. ``payload_bytes`` is that of the full payload; ``intact`` says that block and payload match their digests."""
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])
        made, size = [], 0
        for batch in batches:
            for content in batch.column(1):
                for _, raw in members(content.as_py()):
                    if not raw:
                        continue
                    top, _, rest = raw.partition(b"\r\n\r\n")
                    of = {}
                    for line in top.split(b"\r\n")[1:]:
                        k, _, v = line.decode().partition(":")
                        of[k.lower()] = v.strip()
                    block = rest[:int(of["content-length"])]
                    head, payload = payload_of(block)
                    revisit, digest = of["warc-type"] == "revisit", of.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    intact = of.get("warc-block-digest") == f"sha1:{base32_sha1(block)}" and (revisit or digest is None or digest == base32_sha1(payload))
                    made.append((of["warc-record-id"], of["warc-type"], of["warc-date"], of.get("warc-target-uri"), digest, of.get("warc-refers-to"), int(of[FULL.lower()]) if revisit else len(payload), intact, head, None if revisit else payload))
                    size += len(raw)
                    if size >= TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made), schema)], schema=schema)
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made), schema)], schema=schema)

    return files(spark, path).mapInArrow(rows, RECORD)
