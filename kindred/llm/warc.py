"""WARC archives in Zstandard with an embedded dictionary.

Each archive starts with a skippable frame (0x184D2A5D) that holds, compressed, a dictionary built from
all records of that archive; then every record is a frame of its own, so records can be read one by one
and small ones still share what they have in common. Pages whose payload another page has already are
written as revisits. A task gathers about `roll` bytes of records before it writes an archive, whatever the input.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import partition_id, partitions, scratch, settled, small, table, written
from kindred.llm.tokenfiles import opened

MAGIC = 0x184D2A5D
#: Payloads below this many bytes are always archived as they are.
LEAST = 100
ROLL, DICT_BYTES, LEVEL = 16 << 20, 64 << 10, 3
#: Bytes of repeated digests and their ids that are broadcast; beyond, payloads meet them by digest.
BROADCAST = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record; a revisit if `refers_to` names the page that has the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's type, page_id, url, payload (None for revisits), payload_bytes, digest and refers_to; checks the digest."""
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines)
    http, payload = rest[: int(field["Content-Length"])].split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    out = {"type": field["WARC-Type"], "page_id": field["WARC-Record-ID"][10:-1] or None, "url": field.get("WARC-Target-URI"), "payload": None, "payload_bytes": size, "digest": field["WARC-Payload-Digest"][7:], "refers_to": None}
    if out["type"] == "revisit":
        return out | {"refers_to": field["WARC-Refers-To"][10:-1]}
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != out["digest"]:
        raise ValueError(f"page {out['page_id']}: the payload doesn't match its digest")
    return out | {"payload": payload}


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive. Too few or too small records for a dictionary: none is embedded."""
    out, made = [], None
    try:
        made = zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, records)) // 16)), records, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        pass
    if made is not None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(made.as_bytes())
        out.append(struct.pack("<II", MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True) if made else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    return b"".join(out + [c.compress(r) for r in records])


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    at, d = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        (n,) = struct.unpack_from("<I", data, 4)
        at = 8 + n
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:at])))
    while at < len(data):
        one, parts = d.decompressobj(), []
        while not one.eof:
            piece = data[at : at + (1 << 14)]
            if not piece:
                raise ValueError("the archive is cut off")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def roles(pages: DataFrame, id_col: str, payload: str, broadcast: int = BROADCAST) -> DataFrame:
    """pages with digest and refers_to (null for responses).

    Repeated digests are found from (digest, id) alone. They and their smallest ids are broadcast if they have at most
    `broadcast` bytes, so payloads stay where they are read; otherwise they are joined, and the join's left side can be split.
    """
    p = pages.withColumn("digest", F.sha2(payload, 256))
    same = p.where(F.octet_length(payload) >= LEAST).groupBy("digest").agg(F.min(id_col).alias("low"), F.count("*").alias("n")).where("n > 1").select("digest", "low")
    same = written(same, "repeated")
    held = same.agg(F.sum(64 + F.coalesce(F.octet_length(F.col("low").cast("string")), F.lit(0)))).first()[0] or 0
    later = (F.octet_length(payload) >= LEAST) & F.col("low").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) > F.col("low")))
    return p.join(F.broadcast(same) if held <= broadcast else same.hint("shuffle_hash"), "digest", "left").withColumn("refers_to", F.when(later, F.col("low"))).drop("low")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL) -> DataFrame:
    """Write every row of `pages` below `folder`; the archives' manifest (path, n_records, n_bytes).

    Of rows with equal payloads of at least LEAST bytes, those with the smallest id are responses and the others
    revisits of it; where no row of them has an id, all are responses. Null html is an empty payload, null urls have
    no target, null ids an empty name. Archives count once their task's manifest rows are committed; other columns are ignored.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    make = lambda: roles(src, "id", "payload").select(F.col("id").cast("string").alias("id"), "payload", "url", "digest", F.col("refers_to").cast("string").alias("refers_to")).mapInArrow(run, "path string, n_records long, n_bytes long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def put() -> pa.RecordBatch:
            path, data = f"{folder}/pages-{partition_id():06d}-{uuid.uuid4().hex}.warc.zst", archive(held)
            with opened(path, "w") as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "n_records", "n_bytes"])

        for b in small(batches):
            for key, payload, url, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                held.append(record(key, url, payload, digest, refers))
                size += len(held[-1])
                if size >= roll:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return settled(pages.sparkSession, make, "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id string, url, record_type, payload binary, payload_bytes, payload_digest, refers_to string) of every record."""
    names = ("page_id", "url", "type", "payload", "payload_bytes", "digest", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=list(names))

        for b in batches:
            for path in b.column(0).to_pylist():
                with opened(path, "r") as f:
                    data = f.read()
                rows, size = [], 0
                for r in map(parse, records(data)):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id string, url string, type string, payload binary, payload_bytes long, digest string, refers_to string"
    n = max(1, min(manifest.count(), 4 * partitions(manifest.sparkSession)))
    return manifest.select("path").repartition(n).mapInArrow(run, schema).withColumnsRenamed({"type": "record_type", "digest": "payload_digest"})


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    out = read_warc(write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc")))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: DuckDB twin.
ORACLE = f"""
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages),
named AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} AND low IS DISTINCT FROM page_id THEN low END AS refers_to FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM named
"""
