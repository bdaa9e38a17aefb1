"""WARC archives with a two-level capture index.

Writing: each task writes its records, one gzip member each, to a file of its own in the shared
folder and returns one index line per record: key (URL with its host reversed), page, file,
offset, length, type, digest. A task that is run again writes another file; only the lines of the
run that counts are kept, so a file without lines is never read.

Index: the lines are sorted by key over all files and cut into blocks of BLOCK_LINES, each block
compressed; the blocks lie one after another in index files, and the directory keeps a single row
per block: first and last key, file, offset, length. A search finds the blocks of a key by binary
search in the directory, finds its lines by binary search in each block, and fetches the records
by range reads. Keys are strings in the order of their code points, in Spark and Python alike.

Of records with equal payloads of at least `least_bytes` bytes, that of the smallest page_id is a
response; the others are revisits that refer to it and store no payload.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ordered import numbered
from spanloom.runtime import materialize, scratch_root

BLOCK_LINES = 1_000
RECORDS_PER_READ = 256
# Rows of the directory that are searched at once: each stands for a block of lines.
DIRECTORY_ROWS = 200_000

_LINES = "key string, page_id long, type string, digest string, file string, offset long, length long"
_FIELDS = ("key", "page_id", "type", "digest", "file", "offset", "length")


def capture_key(url: Column) -> Column:
    """Host labels in reverse, a closing bracket, then the rest: com,example,www)/path?query.
    Lower-case (A-Z) host without port; a url without :// is its own key."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^:]*://([^/?#]*)", 1), r"(^.*@)|(:[0-9]*$)", "")
    turned = F.array_join(F.reverse(F.split(F.translate(host, upper, lower), r"\.")), ",")
    rest = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(host != "", F.concat(turned, F.lit(")"), rest)).otherwise(url), F.lit(""))


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def warc_record(url: str | None, page: int | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.insert(3, f"WARC-Refers-To: {_urn(refers_to)}")
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """WARC headers, payload as stored (empty for a revisit), length of the full payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, length


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to, revisit. The digests and ids are grouped, not
    the payloads; each page then meets its own row again by id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    narrow = rows.select("page_id", digest.alias("digest"), F.octet_length("payload").alias("bytes")).distinct()
    narrow = materialize(narrow.where(F.col("page_id").isNotNull()), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    later = narrow.where(F.col("bytes") >= least_bytes).join(first, "digest").where(F.col("page_id") > F.col("first"))
    later = later.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to"))
    joined = rows.join(later, (rows["page_id"] == later["__id"]) & (digest == later["__digest"]), "left")
    return joined.select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html) to files in `folder`, which all
    executors share, and return the stored index lines.

    A null html is an empty payload; a null url has an empty target and key; a row with a null id
    is always a response; repeated rows of one page have a record each, of one type. An empty
    table writes no file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        store, path = _place(folder)
        for batch in batches:
            lines: list[tuple] = []
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{file}", compression=None)
                member = warc_record(row["url"], row["page_id"], row["payload"], row["refers_to"], row["revisit"], date)
                out.write(member)
                kind = "revisit" if row["revisit"] else "response"
                lines.append((row["key"], row["page_id"], kind, _sha1(row["payload"]), file, offset, len(member)))
                offset += len(member)
            if lines:
                columns = list(zip(*lines, strict=True))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(_FIELDS))
        if out is not None:
            out.close()

    rows = with_record_types(pages, least_bytes).withColumn("key", capture_key(F.col("url")))
    return materialize(rows.mapInArrow(write, _LINES), "capture-lines")


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the index lines by key, write them in compressed blocks to `folder`, and return the
    stored directory: first_key, last_key, file, offset, length, n_lines per block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, offset, held = f"{uuid.uuid4().hex}.cdx", None, 0, []
        store, path = _place(folder)

        def block(rows: list[dict]) -> pa.RecordBatch:
            nonlocal out, offset
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{file}", compression=None)
            body = zlib.compress("\n".join(json.dumps([r[f] for f in _FIELDS]) for r in rows).encode())
            out.write(body)
            row = {"first_key": rows[0]["key"], "last_key": rows[-1]["key"], "file": file, "offset": offset, "length": len(body), "n_lines": len(rows)}
            offset += len(body)
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            held.extend(batch.to_pylist())
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield block(held)
        if out is not None:
            out.close()

    ordered = lines.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    schema = "first_key string, last_key string, file string, offset long, length long, n_lines long"
    return materialize(ordered.mapInArrow(pack, schema), "directory")


def _ranges(store: pafs.FileSystem, path: str, wanted: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """Range reads in the given order; a file stays open while it is in use."""
    name, handle = None, None
    for file, offset, length in wanted:
        if file != name:
            if handle is not None:
                handle.close()
            name, handle = file, store.open_input_file(f"{path}/{file}")
        yield handle.read_at(length, offset)
    if handle is not None:
        handle.close()


def _block_lines(store: pafs.FileSystem, path: str, file: str, offset: int, length: int) -> list[list]:
    (body,) = _ranges(store, path, [(file, offset, length)])
    return [json.loads(x) for x in zlib.decompress(body).decode().split("\n")]


_RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_records(store: pafs.FileSystem, path: str, lines: list[list], payloads: bool) -> Iterator[pa.RecordBatch]:
    lines = sorted(lines, key=lambda x: (x[4], x[5]))
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for lo in range(0, len(lines), RECORDS_PER_READ):
        part, rows = lines[lo : lo + RECORDS_PER_READ], []
        for line, member in zip(part, _ranges(store, path, [tuple(x[4:7]) for x in part]), strict=True):
            fields, payload, length = read_record(member)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (len(payload) != length or _sha1(payload) != digest):
                raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {line[4]} at {line[5]}")
            body = payload if payloads and fields["WARC-Type"] == "response" else None
            rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], body, length, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_archive(directory: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records, block by block of the index: each block and each record by a range read.
    Responses are checked against their digest. payload is null for revisits, and if not asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_records(store, path, _block_lines(store, path, row["file"], row["offset"], row["length"]), payloads)

    return directory.repartition("file", "offset").mapInArrow(read, _RECORDS)


def _find_blocks(keys: DataFrame, part: pa.Table) -> DataFrame:
    """(file, offset, length, key): the blocks of a part of the directory that can hold each key,
    by binary search among their sorted first and last keys."""
    blocks = {c: part.column(c).to_pylist() for c in ("first_key", "last_key", "file", "offset", "length")}
    shared: Broadcast = keys.sparkSession.sparkContext.broadcast(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                # A key that fills several blocks lies in all that end with it or begin with it.
                lo, hi = bisect.bisect_left(d["last_key"], key), bisect.bisect_right(d["first_key"], key)
                found += [(d["file"][n], d["offset"][n], d["length"][n], key) for n in range(lo, hi)]
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "offset", "length", "key"])

    return keys.mapInArrow(search, "file string, offset long, length long, key string")


def find_captures(directory: DataFrame, folder: str, keys: DataFrame, payloads: bool = True, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """The records whose capture key is one of `keys` (key), each once. The directory is searched in parts
    of at most `directory_rows` rows, each sent to all tasks; the keys then go to the blocks that
    can hold them, a block is read once and searched, and what is found is fetched by range reads.
    Null keys find nothing."""
    spark = directory.sparkSession
    asked = keys.select("key").where(F.col("key").isNotNull()).distinct()
    parts = max(1, -(-directory.count() // directory_rows))
    if parts > 1:
        asked, directory = materialize(asked, "asked"), materialize(numbered(directory, [F.col(c) for c in ("first_key", "last_key", "file", "offset")], "n"), "directory-order")
    hits = None
    for p in range(parts):
        part = directory if parts == 1 else directory.where((F.col("n") >= p * directory_rows) & (F.col("n") < (p + 1) * directory_rows))
        held = part.orderBy("first_key", "last_key", "file", "offset").toArrow()
        if held.num_rows:
            some = asked if parts == 1 else asked.where((F.col("key") >= held.column("first_key")[0].as_py()) & (F.col("key") <= held.column("last_key")[-1].as_py()))
            own = _find_blocks(some, held)
            hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        return spark.createDataFrame([], _RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, path), at, lines, have, found = _place(folder), None, [], [], []
        for batch in batches:
            for file, offset, length, key in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "key")), strict=True):
                if (file, offset) != at:
                    if found:
                        yield from _read_records(store, path, found, payloads)
                    at, found = (file, offset), []
                    lines = _block_lines(store, path, file, offset, length)
                    have = [x[0] for x in lines]
                found += lines[bisect.bisect_left(have, key) : bisect.bisect_right(have, key)]
        if found:
            yield from _read_records(store, path, found, payloads)

    dealt = hits.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(read, _RECORDS)


def look_up(directory: DataFrame, folder: str, keys: list[str], payloads: bool = True) -> DataFrame:
    """The records whose capture key is one of `keys`, a stated list."""
    asked = directory.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return find_captures(directory, folder, asked, payloads)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive in the shared folder."""
    return f"{scratch_root(spark)}/spanloom/archive-{uuid.uuid4().hex}"
