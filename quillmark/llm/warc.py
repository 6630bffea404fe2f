"""WARC archives: a writer with one gzip member a record, and a splittable reader.

``write_archives`` lets each task write files of its own to the shared folder; what counts is the manifest of the
tasks that succeeded, so files of lost or repeated attempts are never read. ``read_archives`` deals byte ranges of
those files to tasks. A task looks for the gzip magic in its range, takes a candidate for a member only if it
inflates to a WARC version line, and owns the records that start inside its range, to whose ends it reads on.
Equal payloads of LEAST bytes or more are stored once: the record with the largest page_id is the response, the
others are revisits that refer to it and state its digest and length.

Defined results: null html is an empty payload; a null url leaves its header out and control characters in a url
are percent-encoded; of a group whose page_ids are all null, or that tie for the largest, each is a response;
repeated rows are a record each; an empty table writes nothing and reads as an empty table; extra columns are
ignored. A damaged member is passed over and the search goes on behind its start; ``whole`` compares the number of
records with the manifest and raises if some are missing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import materialise, new_path, scratch, small_batches, table

LEAST = 1000
MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
RANGES = 32
FILE_BYTES = 64 << 20
_STEP = 1 << 18
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of each row."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    groups = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("many")).where("many > 1").select(F.col("digest").alias("d2"), F.col("n").alias("n2"), "top")
    joined = rows.join(groups, (rows["digest"] == F.col("d2")) & (rows["n"] == F.col("n2")), "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:x-page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict | None:
    """The RECORD fields of an inflated member; None if it is not a whole record or its payload differs from its digest.

    Records of other writers are records too: of any type, with ids of any form (page_id is null then), with or without
    a payload digest and an HTTP Content-Length. The payload of a response is what follows its HTTP header, that of
    records without one their block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if colon}
    kind, length = fields.get("warc-type"), fields.get("content-length", "")
    if not kind or not length.isdigit() or len(rest) < int(length):
        return None
    payload, told = rest[: int(length)], None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        told = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    digest = _digest(fields.get("warc-payload-digest"))
    if kind == "revisit":
        return _row(fields, kind, told, digest, None)
    actual = hashlib.sha1(payload).hexdigest()
    if digest not in (None, actual):
        return None
    return _row(fields, kind, len(payload), actual, payload)


def _digest(value: str | None) -> str | None:
    """The hex form of a SHA-1 digest in base 32 or hex; None for none and other kinds."""
    name, _, body = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", body):
        return body.lower()
    return base64.b32decode(body.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", body) else None


def _row(fields: dict, kind: str, n: int | None, digest: str | None, payload: bytes | None) -> dict:
    own = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?[0-9]{1,18})>", fields.get(x, ""))) else None
    return {"page_id": own("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": own("warc-refers-to"), "payload_bytes": n, "payload_digest": digest, "payload": payload}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as .warc.gz files under folder and returns the manifest: path, bytes, records."""
    small_batches(records.sparkSession)

    def run(batches):
        out = path = None
        size = count = 0
        rows = []
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs, at = _open(folder)
                    fs.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size, count = fs.open_output_stream(f"{at}/{name}", compression=None), f"{folder}/{name}", 0, 0
                data = record_bytes(**r)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    rows.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            rows.append((path, size, count))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), r)) for r in rows], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return materialise(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def members(source, start: int, end: int):
    """(position, inflated bytes) of the gzip members that start in [start, end) of a seekable file and hold a WARC record."""
    at = start
    while at < end:
        source.seek(at)
        head = source.read(min(_STEP, end + len(MAGIC) - 1 - at))
        found = head.find(MAGIC)
        if found < 0:
            at += max(1, len(head) - len(MAGIC) + 1) if head else end - at
            continue
        at += found
        source.seek(at)
        inflater, parts, got, good = zlib.decompressobj(31), [], 0, True
        while good and not inflater.eof:
            data = source.read(_STEP)
            if not data:
                good = False
                break
            try:
                part = inflater.decompress(data, 0 if got else 64)
                if not got:
                    good = part.startswith(b"WARC/1.")
                    part += inflater.decompress(inflater.unconsumed_tail) if good else b""
            except zlib.error:
                good = False
                break
            got += len(data)
            parts.append(part)
        if not good:
            at += 1
            continue
        yield at, b"".join(parts)
        at += got - len(inflater.unused_data)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RECORD rows of all archives of the manifest."""
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])))

    def run(batches):
        for b in batches:
            for s in b.to_pylist():
                fs, at = _open(s["path"])
                rows, held = [], 0
                with fs.open_input_file(at) as source:
                    for _, data in members(source, s["start"], min(s["bytes"], s["start"] + split_bytes)):
                        if (row := parse_record(data)) is not None:
                            rows.append(row)
                            held += len(data)
                        if held > _STEP * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    # A given number of partitions, since adaptive execution would gather these small rows into few tasks; up to
    # RANGES ranges a task once every core has some.
    n, parallel = splits.count(), manifest.sparkSession.sparkContext.defaultParallelism
    return splits.repartition(max(1, min(n, max(4 * parallel, n // RANGES))), "path", "start").mapInArrow(run, RECORD)


def whole(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records, if they are as many as the manifest says; raises if archives lost or damaged some."""
    wanted = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if (found := records.count()) != wanted:
        raise RuntimeError(f"{found} records were read of {wanted} written")
    return records


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        manifest = write_archives(plan_records(table(spark, sf_dir, "pages")), new_path(spark, "warc"))
        found = read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return whole(materialise(found, "warc-records", keep=True), manifest)


OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""
