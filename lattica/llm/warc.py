"""WARC archives, index first: offset, length, URL and digest per record, then coalesced sorted byte-range reads."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.store import save, scratch

#: Payloads below this many bytes are always stored whole.
LEAST_REVISIT = 1000
SALTS = 16
INDEX = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
])
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def clean(value: object) -> str:
    """A header value on one line."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member: WARC/1.1 header, block and two line ends. A revisit has an empty block."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest} {url}'.encode('utf-8', 'surrogatepass')).digest())}>",
        f"WARC-Target-URI: {clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {clean(page_id)}",
        f"X-Has-URI: {int(url is not None)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, compresslevel=1, mtime=0)


def parse(data: bytes) -> tuple:
    """The RECORD row of one decompressed record; a response's payload is checked against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not at the start of a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size, kind, digest = int(h["Content-Length"]), h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = rest[:size] if kind == "response" else None
    if kind == "response" and (len(payload) != int(h["X-Payload-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record of page {h['X-Page-ID']} is damaged")
    page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page")
    url = h["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n") if h["X-Has-URI"] == "1" else None
    return int(page) if page else None, url, kind, int(refers) if refers else None, int(h["X-Payload-Length"]), digest, payload


def revisits(pages: DataFrame) -> DataFrame:
    """(of, with, refers_to): page_id, digest and the response's page_id of the pages whose payload an equal one with a larger page_id stores.

    Only ids and digests are shuffled. Groups are counted with map-side combining; the group's row is replicated over
    ``SALTS`` keys and its members dealt over them, so that a payload with a third of all pages meets in no one task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= LEAST_REVISIT)
    groups = small.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    groups = groups.select("digest", "size", "refers_to", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = small.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(groups, ["digest", "size", "salt"]).where("page_id is null or page_id < refers_to")
    return again.select(F.col("page_id").alias("of"), F.col("digest").alias("with"), "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, block_bytes: int = 4 << 20) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) into .warc.gz files under ``folder`` and returns the index.

    Each attempt of a task writes a file of its own name; only files of attempts that succeed are named in the index,
    which is written as Parquet before it is returned, so lost executors and retried tasks leave a whole archive.
    Null html is an empty payload; rows of equal page_id and payload at the largest id are all responses.
    """
    again = revisits(pages)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # A page that revisits nothing has nothing to look up: the join carries html once, dealt by page_id, which is no hot key.
    same_page = source["page_id"].eqNullSafe(again["of"]) & (F.sha1(F.coalesce(source["html"], F.lit("")).cast("binary")) == again["with"])
    joined = source.join(again, same_page, "left").select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull())
    joined = joined.toDF("page_id", "url", "html", "refers_to", "again")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        out = name = None
        at = 0
        for part in parts:
            rows = []
            for page_id, url, html, refers_to, again_ in zip(part["page_id"], part["url"], part["html"], part["refers_to"], part["again"], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=block_bytes)
                payload = (html if isinstance(html, str) else "").encode("utf-8", "surrogatepass")
                page = None if pd.isna(page_id) else int(page_id)
                same = bool(again_) and len(payload) >= LEAST_REVISIT
                kind, digest, url = "revisit" if same else "response", hashlib.sha1(payload).hexdigest(), url if isinstance(url, str) else None
                data = record(page, url, payload, digest, kind, int(refers_to) if same else None)
                out.write(data)
                rows.append((page, name, at, len(data), url, digest, kind))
                at += len(data)
            frame = pd.DataFrame(rows, columns=INDEX.names)
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return save(joined.mapInPandas(run, INDEX), "warc-index")


def ranges(frame: pd.DataFrame, gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Coalesces sorted records of a file whose gap is at most ``gap`` into reads of at most ``most`` bytes (one record at least)."""
    file, start, end, inside = None, 0, 0, []
    for f, o, n in zip(frame["file"], frame["offset"], frame["length"], strict=True):
        if inside and f == file and o - end <= gap and max(end, o + n) - start <= most:
            end = max(end, o + n)
            inside.append((o, n))
            continue
        if inside:
            yield file, start, end, inside
        file, start, end, inside = f, o, o + n, [(o, n)]
    if inside:
        yield file, start, end, inside


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` (or any selection of its rows) names, one RECORD row each.

    The selection is dealt by ranges of (file, offset), so each task reads neighbouring bytes in order; memory holds one
    coalesced read at a time.
    """
    chosen = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        name = source = None
        for part in parts:
            for file, start, end, inside in ranges(part, gap, most):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                data = memoryview(source.read_at(end - start, start))
                rows = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inside]
                frame = pd.DataFrame(rows, columns=RECORD.names)
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    return chosen.mapInPandas(run, RECORD)


def contract(pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes them, reads every record back; revisits keep the digest and size of the full payload.

    Payloads count as equal when their SHA-1 and their size are. A null html is an empty payload; rows that repeat a page
    each give a record; an empty table gives none; other columns are left out, whatever their names.
    """
    folder = scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
