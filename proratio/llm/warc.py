"""Deterministic sharded WARC archives: written from tasks, committed by name, read back with digests checked.

Pages are sorted by page_id. Every ``SHARD`` records begin a shard, so the same pages
give the same shards on any cluster; in a shard a file is closed once its compressed
size reaches ``ROLL``. Headers, record ids and digests are made anew from the page,
each record is a gzip member of its own, and a payload seen before becomes a revisit.
A task writes under a temporary name and renames when the file is whole; a repeated
task writes the same bytes to the same name. The manifest of all files is stored last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proratio.llm.common import new_path, ranked, stored, text_of

SHARD = 5_000
ROLL = 16 << 20
#: Bytes of an archive given to the decompressor at first; most records end within them.
PIECE = 4 << 10
#: The time all records bear: archives of the same pages are equal.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers],
             f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 6, mtime=0)


def _page_headers(page_id, url, digest: str, size: int) -> list[tuple[str, str]]:
    """A null id or url has no header; control characters in a url are percent-encoded."""
    uri = None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)
    return [("WARC-Record-ID", _record_id(page_id, digest)), *([("WARC-Target-URI", uri)] if uri is not None else []),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", "" if page_id is None else str(page_id)), ("Payload-Length", str(size)),
            ("Content-Type", "application/http; msgtype=response")]


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(page_id, url, payload: bytes, digest: str) -> bytes:
    return _record("response", _page_headers(page_id, url, digest, len(payload)), _http(len(payload)) + payload)


def revisit(page_id, url, digest: str, size: int, first: int) -> bytes:
    return _record("revisit", [*_page_headers(page_id, url, digest, size), ("WARC-Profile", PROFILE),
                               ("WARC-Refers-To", _record_id(first, digest)), ("Refers-To-Page-Id", str(first))], _http(size))


def members(pages: DataFrame, whole: bool = True) -> DataFrame:
    """One compressed response record per page: page_id, url, digest, size, member. Null html is an empty payload.

    Without ``whole`` the records themselves are left out.
    """
    def make(batches):
        for batch in batches:
            ids, urls, texts = (batch.column(i).to_pylist() for i in range(3))
            digests, sizes, made = [], [], []
            for page_id, url, text in zip(ids, urls, texts):
                payload = text.encode("utf-8", "surrogatepass")
                digests.append(_base32(hashlib.sha1(payload).digest()))
                sizes.append(len(payload))
                made.append(response(page_id, url, payload, digests[-1]) if whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())],
                                             ["page_id", "url", "digest", "size", "member"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html"))
    return source.mapInArrow(make, "page_id long, url string, digest string, size long, member binary")


def _write(folder: str, roll: int):
    """A task: rows of whole shards in order, to files; yields a manifest row per file."""
    def task(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        done, out = [], None

        def begin(shard, number):
            name = f"pages-{shard:08d}-{number:05d}.warc.gz"
            out = {"shard": shard, "number": number, "name": name, "temp": f"{base}/_{uuid.uuid4().hex}-{name}", "records": 0, "bytes": 0, "sha": hashlib.sha1()}
            out["stream"] = store.open_output_stream(out["temp"], compression=None)
            put(out, _record("warcinfo", [("WARC-Record-ID", _record_id(name, "")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            return out

        def put(out, data):
            out["stream"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)

        def end(out):
            out["stream"].close()
            final = f"{base}/{out['name']}"
            # An earlier attempt of this task may have left the same file.
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(out["temp"], final)
            done.append((out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))

        marked = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    marked = r
                    continue
                if out and (out["shard"] != r["shard"] or out["bytes"] >= roll):
                    end(out)
                    out = begin(r["shard"], out["number"] + 1 if out["shard"] == r["shard"] else 0)
                out = out or begin(r["shard"], 0)
                same = marked and (marked["page_id"], marked["digest"]) == (r["page_id"], r["digest"])
                put(out, revisit(r["page_id"], r["url"], r["digest"], r["size"], marked["first"]) if same else r["member"])
                out["records"] += 1
        if out:
            end(out)
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         ["file", "records", "bytes", "sha1"])

    return task


def write(pages: DataFrame, folder: str, least: int = 0, shard: int = SHARD, roll: int = ROLL) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) to ``folder``, a new one; returns the stored manifest.

    Of records with equal payloads of at least ``least`` bytes the one with the
    smallest page_id is a response and others revisit it; rows that share that id are
    all responses. A row without an id revisits where another has one.
    """
    # Digests first, and stored; records are made on the way to their shard, so they lie on disk only there and in the files.
    narrow = stored(members(pages, whole=False).drop("member"), "digests")
    firsts = narrow.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Stored, so that the join below may deal out the rows of one payload.
    firsts = stored(firsts.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "firsts")
    again = narrow.join(firsts, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    # One number per ``shard`` records.
    borders = ranked(narrow.select("page_id"), ["page_id"]).filter((F.col("rank") % shard == 0) & F.col("page_id").isNotNull())
    borders = np.array(sorted({r["page_id"] for r in borders.select("page_id").collect()}), np.int64)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        found = np.searchsorted(borders, ids.fillna(0).astype("int64"), side="right")
        return pd.Series(np.where(known, found, 0))

    rows = members(pages).withColumn("kind", F.lit(1)).withColumn("first", F.lit(None).cast("long")).unionByName(
        again.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # A null id sorts as itself; pandas would make long ids with nulls floats, so nulls go in as the smallest.
    rows = rows.withColumn("shard", F.when(F.col("page_id").isNull(), F.lit(0).cast("long")).otherwise(shard_of(F.coalesce("page_id", F.lit(0).cast("long")))))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    rows = rows.select("shard", "page_id", "digest", "kind", "size", "url", "first", "member")
    manifest = f"{folder}/manifest"
    _make(folder)
    rows.mapInArrow(_write(folder, roll), "file string, records long, bytes long, sha1 string").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def _make(folder: str) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)


def _parse(content: bytes):
    """Records of a file, one gzip member at a time: (headers, block).

    A member is fed in pieces, the first ``PIECE`` bytes and each twice the last: the decompressor copies
    what lies behind a member's end, which would be the rest of the file for each of its records.
    """
    view, at = memoryview(content), 0
    while at < len(view):
        member, size, parts = zlib.decompressobj(31), PIECE, []
        while not member.eof:
            if at == len(view):
                raise ValueError("a record breaks off")
            piece = view[at:at + size]
            parts.append(member.decompress(piece))
            at, size = at + len(piece), 2 * size
        at -= len(member.unused_data)
        data = b"".join(parts)
        head, block = data.split(b"\r\n\r\n", 1)
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield headers, block[:int(headers["Content-Length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Fails if the files are not those of the manifest, or a digest does not fit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(folder)
    want = spark.read.parquet(f"{folder}/manifest").agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    have = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if tuple(want) != tuple(have):
        raise ValueError(f"{folder}: manifest names {tuple(want)} files and bytes, found {tuple(have)}")

    def parse(batches):
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in _parse(content.as_py()):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["Payload-Length"])
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    if kind == "response" and (_base32(hashlib.sha1(payload).digest()), len(payload)) != (digest, size):
                        raise ValueError(f"digest of page {headers['Page-Id']} does not fit")
                    first = headers.get("Refers-To-Page-Id")
                    rows.append((int(headers["Page-Id"]) if headers["Page-Id"] else None, headers.get("WARC-Target-URI"), payload if kind == "response" else None,
                                 size, digest, kind, int(first) if first else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("content").mapInArrow(parse, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder of archives and read them back; payloads are checked, not returned."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
