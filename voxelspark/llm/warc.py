"""WARC archives: a writer with identical-payload revisits, and a reader that splits archives by byte range.

Every record is a gzip member of its own. A reading task owns the records that start inside its range: it
looks for gzip magic, accepts a place only if what is decoded there starts like a WARC header, then goes
on from member to member until one starts beyond the range. Records of any type and writer are read; a damaged
one becomes a row that says so, and reading goes on at the next place that holds a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import noted, shared_dir, written

MIN_REVISIT = 1000
SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
PIECE = 1 << 16
#: An archive that has grown to so many bytes is closed and the next one begun.
ARCHIVE_BYTES = 1 << 30
#: So many groups of equal payloads are broadcast (about 100 bytes each; counted); beyond, payloads are shuffled to meet them.
BROADCAST_GROUPS = 200_000


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def plan_records(df: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(page_id, payload, digest, record_type, refers_to): which rows become revisits.

    Of equal payloads of at least MIN_REVISIT bytes that with the largest key is the response. Groups are
    counted by digest first; those of two or more, one row each, are broadcast if they are few enough, so
    payloads stay where they lie; beyond, rows are shuffled by digest and adaptive execution splits a hot
    group. A null payload is an empty one. Rows with an equal key and payload are all responses; a group
    whose keys are all null has responses only. Other columns are not carried.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("page_id"), body.alias("payload"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    groups = written(
        df.select(F.col(key).alias("k"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).alias("n"))
        .where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("k").alias("first"), F.count("*").alias("c"))
        .where("c > 1").select("digest", "first")
    )
    few = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    joined = joined if few else joined.sortWithinPartitions("digest", "page_id")  # a task that runs again writes alike
    revisit = F.col("first").isNotNull() & ((F.col("page_id") < F.col("first")) | F.col("page_id").isNull())
    return joined.select(
        "page_id", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_bytes(page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the response's head only; its length is the full payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records, archives of about archive_bytes from each task; returns (path, bytes, records), written by then.

    A task writes under a name of its own and moves an archive to ``part-<partition>-<number>`` when it is whole, so a
    task that is run again, or twice at once, leaves whole archives. An empty partition leaves none.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        store, base = _open(folder)
        out, own, size, records, number = None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{partition:06d}-{number:04d}.warc.gz"
            store.move(own, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    own = f"{base}/.{uuid.uuid4().hex}"
                    out, size, records = store.open_output_stream(own), 0, 0
                got = record_bytes(row["page_id"], row["payload"].encode(), row["digest"], row["refers_to"], row["record_type"] == "revisit")
                out.write(got)
                size, records = size + len(got), records + 1
                if size >= archive_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    manifest = planned.mapInArrow(write, "path string, bytes long, records long")
    return written(manifest)


class _Member:
    """A decompressing reader of one gzip member that starts at a place of a file; ``at`` is its end once it is read."""

    def __init__(self, file, at: int, end: int):
        self.file, self.at, self.end = file, at, end
        self.engine, self.ready, self.pending = zlib.decompressobj(31), b"", b""

    def more(self, most: int = 0) -> bool:
        """Decode on, by ``most`` bytes (0: a piece of the file); False at the member's or the file's end."""
        if self.engine.eof or not (self.pending or self.at < self.end):
            return False
        if not self.pending:
            self.pending = self.file.read_at(min(PIECE, self.end - self.at), self.at)
            self.at += len(self.pending)
        self.ready += self.engine.decompress(self.pending, most)
        self.pending = self.engine.unconsumed_tail
        self.at -= len(self.engine.unused_data)
        return True

    def head(self) -> bytes | None:
        """What is decoded so far, if it starts with a record's header; damage behind the header does not matter."""
        while b"\r\n\r\n" not in self.ready and len(self.ready) < PIECE and self.more(128):
            if len(self.ready) >= 10 and not self.ready.startswith(b"WARC/1."):
                return None
        return self.ready if self.ready.startswith(b"WARC/1.") and b"\r\n\r\n" in self.ready else None

    def whole(self) -> bytes:
        parts = [self.ready]
        self.ready = b""
        while self.more():
            parts.append(self.ready)
            self.ready = b""
        return b"".join(parts)


def first_record(file, start: int, end: int, size: int) -> int | None:
    """The first place in [start, end) where a record's member starts: magic, then a decoded header."""
    at = start
    while at < end:
        piece = file.read_at(min(PIECE, end - at) + len(MAGIC) - 1, at)
        found = piece.find(MAGIC)
        while found >= 0 and at + found < end:
            try:
                if _Member(file, at + found, size).head():
                    return at + found
            except zlib.error:
                pass
            found = piece.find(MAGIC, found + 1)
        at += PIECE
    return None


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += f" {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdecimal() else None


def _hex(digest: str | None) -> str | None:
    """A stated SHA-1 in bare lower-case hex, whether it came in hex or in base 32; None for anything else."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """(fields of the first record, what follows it). Payload: the block, of HTTP messages their body; of a revisit none.

    A revisit's digest and size are those its headers state of the payload it repeats, else null; all others are
    measured. ``error`` says what is damaged: no length, an early end, a payload that its digest contradicts.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    said = _fields(head)
    kind = said.get("warc-type", "").lower() or None
    length = _number(said.get("content-length"))
    block, after = (rest, b"") if length is None else (rest[:length], rest[length:].lstrip(b"\r\n"))
    error = "no length" if length is None else "ends early" if len(block) < length else None
    payload, size = block, None
    if said.get("content-type", "").lower().startswith("application/http"):
        message, _, payload = block.partition(b"\r\n\r\n")
        size = _number(_fields(message).get("content-length"))
    stated = _hex(said.get("warc-payload-digest"))
    if kind == "revisit":
        digest, payload = stated, None
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if error is None and stated not in (None, digest):
            error = "payload differs from its digest"
    return {
        "record_id": said.get("warc-record-id", "").strip("<>") or None, "record_type": kind, "target": said.get("warc-target-uri"), "date": said.get("warc-date"),
        "payload_bytes": size, "payload_digest": digest, "refers_to": said.get("warc-refers-to", "").strip("<>") or None, "error": error, "payload": payload,
    }, after


RECORD = "path string, start long, record_id string, record_type string, target string, date string, payload_bytes long, payload_digest string, refers_to string, error string"
_DAMAGED = dict.fromkeys(x.split()[0] for x in f"{RECORD}, payload binary".split(", "))


def records_in(file, path: str, start: int, end: int, size: int) -> Iterator[dict]:
    """The records whose members start in [start, end) of a file. Damage costs one row; the next record is sought behind it."""
    at = first_record(file, start, end, size)
    while at is not None and at < end:
        place = {"path": path, "start": at}
        try:
            member = _Member(file, at, size)
            rest = member.whole()
            while rest.startswith(b"WARC/1."):  # a member may hold several
                got, rest = parse_record(rest)
                if not member.engine.eof:
                    got["error"] = got["error"] or "ends early"
                yield place | got
            following = member.at if member.engine.eof else size
        except zlib.error:
            yield _DAMAGED | place | {"error": "not to be decompressed"}
            following = at + 1
        at = first_record(file, following, end, size)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of the archives (path, bytes), read by byte ranges of split_bytes: columns RECORD, and payload if asked for.

    Ranges are dealt out evenly, whatever the archives' sizes; each record is read by the task in whose
    range it starts. Memory: a record and a piece of a file. An empty table of files gives no record.
    """
    schema = RECORD + ", payload binary" * payload
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4))
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for got in records_in(file, row["path"], row["start"], min(row["start"] + split_bytes, row["bytes"]), row["bytes"]):
                        held += len(got["payload"] or b"")
                        rows.append({k: got[k] for k in arrow.names})
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges.mapInArrow(read, schema)


def page_number(column: str) -> Column:
    """The page in a name ``urn:page:<number>``; null for ``urn:page:null`` and for any other name."""
    return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def round_trip(df: DataFrame, key: str = "page_id", payload: str = "html", folder: str | None = None) -> DataFrame:
    """Write each row as a record into archives in the shared folder, then read them back (digest columns); damage is an error."""
    spark: SparkSession = df.sparkSession
    folder = folder or noted(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    rows = read_archives(write_archives(plan_records(df, key, payload), folder), payload=False)
    whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), "path")).cast("string"))
    return rows.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), page_number("refers_to").alias("refers_to"))
