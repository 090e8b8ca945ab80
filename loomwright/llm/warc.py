"""Legacy archives: ARC version 1 and 2 files, converted to WARC.

An ARC file begins with a ``filedesc`` record whose body names the version and
the fields of the header lines; every record is one header line, whose last
field declares the length, and that many bytes.  Conversion synthesises what
WARC needs: record identifiers (name-based UUIDs, so that a repeated task gives
the same), ISO timestamps, record types (warcinfo, response, resource, revisit)
and SHA-1 digests of block and payload.

Files are written by tasks, one or more per partition, each record its own gzip
member, under names no two attempts share.  A manifest, written by Spark's own
committer when all tasks are done, names the files that count; what a lost
attempt leaves is never read.  Payloads aren't shuffled: duplicates are decided
on digests (partial aggregation, then a salted join, so that a payload that a
third of all records share stays spread), and each ARC file is converted where
its decisions arrive.

Defined cases: a null html is an empty payload; a null url is ``urn:unknown``;
blanks in a url are %20; a null page_id is carried as null, counts as less than
any other, and never refers to itself; rows that repeat the largest page_id of
their payload are all responses; an empty table gives archives without records.
An ARC record shorter than its header declares raises.  Where a header line
doesn't parse, ``arc_records`` goes on at the next line that does and whose
record ends where another header (or the file) begins, so that a line of a
payload isn't taken for one; each such place is counted in ``damage``, and a
conversion warns of it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import warnings
import zlib

import pyarrow as pa

from . import core

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
DATE = "20240101000000"
ROLL = 128 << 20
MANIFEST = "file string, records long, bytes long"
RECORD = "file string, position long, url string, date string, mime string, source_id long, record_id string, payload_bytes long, payload_digest string"


def filesystem(path: str):
    import pyarrow.fs as pf

    if "://" in path or path.startswith("file:"):
        return pf.FileSystem.from_uri(path)
    return pf.LocalFileSystem(), path


class Files:
    """Gzip members appended to files of bounded size, which are closed one after another."""

    def __init__(self, folder: str, suffix: str, roll: int = ROLL):
        self.folder, self.suffix, self.roll = folder.rstrip("/"), suffix, roll
        self.fs, self.base = filesystem(self.folder)
        self.fs.create_dir(self.base, recursive=True)
        self.out, self.done = None, []

    def add(self, record: bytes, head=None) -> None:
        if self.out is not None and self.bytes >= self.roll:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
            self.bytes = self.records = 0
            if head:
                self._put(head(self.name))
        self._put(record)
        self.records += 1

    def _put(self, record: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.bytes += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.bytes))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        names, records, size = zip(*self.done, strict=True) if self.done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([f"{self.folder}/{n}" for n in names], pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["file", "records", "bytes"])


def _line(stream) -> bytes:
    return stream.readline()


def open_archive(path: str):
    """A stream of the archive's bytes, unpacked if it is gzipped (all members)."""
    import gzip

    fs, p = filesystem(path)
    raw = fs.open_input_stream(p, compression=None)
    data = io.BufferedReader(raw)
    return gzip.GzipFile(fileobj=data) if data.peek(2)[:2] == b"\x1f\x8b" else data


# ---- ARC


def arc_head(name: str, version: int) -> bytes:
    body = f"{version} 0 loomwright\n{' '.join(FIELDS[version])}\n".encode()
    common = f"filedesc://{name} 0.0.0.0 {DATE} text/plain"
    line = f"{common} {len(body)}" if version == 1 else f"{common} 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def arc_record(url: str, ip: str, date: str, mime: str, content: bytes, version: int, status: int = 200, name: str = "-") -> bytes:
    url = re.sub(r"\s", "%20", url) if url else "urn:unknown"
    checksum = base64.b32encode(hashlib.sha1(content).digest()).decode()
    line = f"{url} {ip} {date} {mime} {len(content)}" if version == 1 else f"{url} {ip} {date} {mime} {status} {checksum} - 0 {name} {len(content)}"
    return line.encode() + b"\n" + content + b"\n"


def _header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """The fields of a header line, from the right, as only a url may hold blanks; None if it isn't one."""
    parts = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[0]:
        return None
    h = dict(zip(fields, parts, strict=True))
    return h if h["Archive-length"].isdecimal() and re.fullmatch(r"\d{8,17}", h["Archive-date"]) else None


class _Back:
    """A stream that takes bytes back."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def push(self, data: bytes):
        self.held = data + self.held

    def read(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out + self.stream.read(n - len(out)) if len(out) < n else out

    def readline(self) -> bytes:
        at = self.held.find(b"\n") + 1
        if at:
            out, self.held = self.held[:at], self.held[at:]
            return out
        out, self.held = self.held, b""
        return out + _line(self.stream)


def arc_records(stream, damage: list | None = None):
    """(header fields, content, version) of the records of an ARC file, the filedesc first; ``damage`` gets each line that should be a header."""
    stream = _Back(stream)
    version, fields, lost = 1, FIELDS[1], False

    def parsed(line):
        described = line.startswith(b"filedesc://")
        for f in ([FIELDS[2], FIELDS[1]] if described else [fields]):
            if (h := _header(line, f)) and (not described or f is FIELDS[1] or h["Result-code"].isdecimal()):
                return h
        return None

    while line := stream.readline():
        if not line.strip():
            continue
        h = parsed(line)
        if h is None:
            if not lost and damage is not None:
                damage.append(line[:200])
            lost = True
            continue
        size = int(h["Archive-length"])
        content = stream.read(size)
        if lost:  # is it a header? then its record ends before another one, or with the file
            end = stream.readline()
            after = stream.readline() if end in (b"\n", b"\r\n") else b""
            stream.push(end + after)
            if len(content) < size or (end not in (b"", b"\n", b"\r\n")) or (after and parsed(after) is None):
                stream.push(content)
                continue
            lost = False
        if len(content) < size:
            raise ValueError(f"the record of {h['URL'][:200]} has {len(content)} of {size} bytes")
        if line.startswith(b"filedesc://"):
            lines = content.split(b"\n")
            first = lines[0].split()
            version = int(first[0]) if first and first[0].isdigit() else 1
            named = lines[1].decode("utf-8", "replace").split() if len(lines) > 1 else []
            fields = named if "Archive-length" in named and "Archive-date" in named else FIELDS.get(version, FIELDS[1])
        yield h, content, version


def http_split(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); no head where the content isn't an HTTP message."""
    if content.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (at := content.find(mark)) >= 0:
                return content[: at + len(mark)], content[at + len(mark) :]
    return b"", content


def http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("latin-1").strip() if m else None


def write_arc(pages, path: str, date: str = DATE):
    """pages (page_id, url, html) as ARC files, of version 1 and 2 in turn; the manifest's DataFrame."""
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        task = TaskContext.get()
        version = 1 + (task.partitionId() if task else 0) % 2
        files = Files(f"{path}/data", ".arc.gz")
        for batch, buf, off in core.chunks(batches, "html"):
            raw = buf.tobytes()
            for i, url, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                mark = f"X-Source-Id: {i}\r\n" if i is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {b - a}\r\n{mark}\r\n"
                files.add(arc_record(url, "0.0.0.0", date, "text/html", head.encode() + raw[a:b], version), lambda name: arc_head(name, version))
        yield files.manifest()

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return rows.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _describe(h, content):
    head, payload = http_split(content)
    digest = hashlib.sha1(payload).hexdigest()
    source = http_field(head, b"X-Source-Id")
    source = int(source) if source and re.fullmatch(r"-?\d+", source) else None
    record = uuid.uuid5(uuid.NAMESPACE_URL, f"{h['URL']} {h['Archive-date']} {source} {digest}")
    return head, payload, digest, source, f"<urn:uuid:{record}>"


def read_arc(manifest):
    """What duplicates are decided on, per ARC record: place, identity, length and digest."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, damage = [], []
                with open_archive(path) as stream:
                    for n, (h, content, _) in enumerate(arc_records(stream, damage)):
                        if not h["URL"].startswith("filedesc://"):
                            _, payload, digest, source, record = _describe(h, content)
                            rows.append((path, n, h["URL"], h["Archive-date"], h["Content-type"], source, record, len(payload), digest))
                if damage:
                    warnings.warn(f"{path}: {len(damage)} damaged places, the first {damage[0]!r}", stacklevel=1)
                schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("source_id", pa.int64()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    return manifest.mapInArrow(run, RECORD)


def duplicates(records, least: int = 1000, salt: int = 16):
    """Each record with the record it revisits (refers_id, refers_record), or nulls."""
    from pyspark.sql import functions as F

    best = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(F.struct("source_id", "record_id")).alias("best"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "best")
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    side = records.withColumn("salt", F.pmod(F.xxhash64("file", "position"), F.lit(salt)).cast("int"))
    out = side.join(salted, ["payload_digest", "salt"], "left")
    other = F.col("best.source_id").isNotNull() & ~F.col("source_id").eqNullSafe(F.col("best.source_id"))
    return out.select("file", "position", F.when(other, F.col("best.source_id")).alias("refers_id"), F.when(other, F.col("best.record_id")).alias("refers_record"))


# ---- WARC


def warc_date(date: str) -> str:
    d = (date + "00000000")[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, record_id: str, date: str, block: bytes, fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {warc_date(date)}", *(f"{k}: {v}" for k, v in fields if v is not None), f"WARC-Block-Digest: {sha1_field(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    block = b"software: loomwright\r\nformat: WARC File Format 1.1\r\nconformsTo: ARC conversion\r\n"
    return warc_record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", DATE, block, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")])


def converted(h, content, refers_id=None, refers_record=None) -> bytes:
    """The WARC record of an ARC record: a revisit where it refers to another, else a response or a resource."""
    head, payload, digest, source, record = _describe(h, content)
    fields = [("WARC-Target-URI", h["URL"]), ("WARC-IP-Address", h["IP-address"]), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("WARC-Source-Id", source), ("WARC-Payload-Length", len(payload))]
    if refers_record is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_record), ("WARC-Refers-To-Source-Id", refers_id), ("Content-Type", "application/http; msgtype=response")]
        return warc_record("revisit", record, h["Archive-date"], head, fields + more)
    if head:
        return warc_record("response", record, h["Archive-date"], content, [*fields, ("Content-Type", "application/http; msgtype=response")])
    return warc_record("resource", record, h["Archive-date"], content, [*fields, ("Content-Type", h["Content-type"])])


def convert(decisions, path: str):
    """ARC files to WARC files, by (file, position, refers_id, refers_record); the manifest's DataFrame."""

    def each(table: pa.Table) -> pa.Table:
        refer = {p: (i, r) for p, i, r in zip(*(table.column(c).to_pylist() for c in ("position", "refers_id", "refers_record")), strict=True)}
        files = Files(f"{path}/data", ".warc.gz")
        with open_archive(table.column("file")[0].as_py()) as stream:
            for n, (h, content, _) in enumerate(arc_records(stream)):
                if n in refer:
                    files.add(converted(h, content, *refer[n]), warc_info)
        return pa.Table.from_batches([files.manifest()])

    # As many tasks as files, up to the shuffle's partitions: the decisions are few, the files aren't.
    spread = decisions.repartition(core.partitions(decisions.sparkSession), "file")
    spread.groupBy("file").applyInArrow(each, MANIFEST).write.parquet(f"{path}/manifest")
    return decisions.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def warc_records(stream):
    """(version line, fields, block) of the records of a WARC file."""
    while line := _line(stream):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (x := _line(stream)).strip():
            k, _, v = x.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield line.strip().decode(), fields, stream.read(int(fields["content-length"]))


def read_warc(manifest):
    """One row per response, resource or revisit record; stored payloads are checked against their digests."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_archive(path) as stream:
                    for _, f, block in warc_records(stream):
                        if f["warc-type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex()
                        size = int(f["warc-payload-length"])
                        if f["warc-type"] != "revisit":
                            payload = http_split(block)[1]
                            if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                                raise ValueError(f"{path}: {f['warc-record-id']} is damaged")
                        rows.append([int(x) if (x := f.get("warc-source-id")) else None, size, digest, f["warc-type"], int(x) if (x := f.get("warc-refers-to-source-id")) else None, f["warc-record-id"], f["warc-date"]])
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names=names)

    return manifest.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string")


def _spread(manifest):
    """A file per task, as far as there are partitions."""
    return manifest.repartition(core.partitions(manifest.sparkSession), "file")


def archive(pages, path: str, least: int = 1000):
    """pages to ARC, ARC to WARC with revisits, and the WARC files read back."""
    arcs = write_arc(pages, f"{path}/arc")
    warcs = convert(duplicates(read_arc(_spread(arcs)), least), f"{path}/warc")
    return read_warc(_spread(warcs))


QUERY = "op1_arc_to_warc"


def query(spark, sf_dir):
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), core.shared_dir(spark))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM p LEFT JOIN b USING (payload_digest)
"""
