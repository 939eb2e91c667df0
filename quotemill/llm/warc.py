"""WARC archives with an index that is written first and read first.

Writing: payload digests are counted per digest; of the records with one payload that with the largest page id is the
``response``, all others are ``revisit`` records without payload that name it.  Each task writes archive files of
records that are compressed one by one, and returns an index row for each record: file, offset, length, URL,
digest.  File names are new for every attempt and the index, which Spark commits as a whole, names only files of
attempts that counted, so a lost executor leaves at most an unnamed file behind.

Reading: the wanted index rows are sorted by file and offset; neighbouring byte ranges of a file are joined into
one read of bounded size, and every record is cut out of it, unpacked and parsed.

Archives go to a folder that all executors share, reached with ``pyarrow.fs`` (file:, s3:, gs:, hdfs:); a plain path is
one of Spark's default file system, for the archives as for the index.

Defined results: a null payload is empty; a null URL is written as ``urn:page:<id>``.  Rows without id keep the empty
id in the archive, can be revisits, and are the response only if none of their group has an id.  Rows that repeat the
largest id of a group are all responses.  Other input columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import only
from quotemill.session import qualified, scratch

ROLL_BYTES = 256 << 20  # an archive file is closed when it is this long
READ_BYTES = 8 << 20  # longest joined read
GAP_BYTES = 64 << 10  # unwanted bytes between two wanted records that a joined read may take along
MIN_REVISIT = 0  # payloads shorter than this are always responses

_INDEX = pa.schema([("id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("type", pa.string())])
_INDEX_SQL = "id long, url string, file string, offset long, length long, digest string, payload_bytes long, type string"
_RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()),
                     ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_RECORD_SQL = "id long, url string, type string, refers_to long, digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack(page: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str) -> tuple[bytes, str]:
    """One record, compressed on its own, and its payload digest.  A revisit has the digest and size but no payload."""
    digest, revisit = base32_sha1(payload), refers_to is not None
    name = "" if page is None else str(page)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Target-URI", (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", when),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest}')}>"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", name),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    block = b"" if revisit else payload
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush(), digest


def unpack(record: bytes) -> dict:
    """Fields and payload of one compressed record."""
    raw = zlib.decompress(record, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length does not fit its content")
    payload = rest[:size]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError("the payload does not have the digest that its record names")
    return fields | {"payload": payload}


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if ":" in folder else (pa.fs.LocalFileSystem(), folder)


def _writer(folder: str, roll: int, when: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = r["payload"] or b""
                    record, digest = pack(r["id"], r["url"], payload, r["refers_to"], when)
                    out.write(record)
                    rows.append({"id": r["id"], "url": r["url"], "file": name, "offset": at, "length": len(record), "digest": digest,
                                 "payload_bytes": len(payload), "type": "response" if r["refers_to"] is None else "revisit"})
                    at += len(record)
                yield pa.RecordBatch.from_pylist(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None,
          when: str = "2024-01-01T00:00:00Z", roll: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Write one record per row; returns the folder of the archives and their index, itself a written table.

    The join that finds revisits carries a row per payload that occurs twice; its other side may hold many copies of
    one payload, which adaptive execution splits.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch(spark, "warc"))
    rows = only(pages, id=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), "url", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("key", F.sha1("payload"))
    twice = keyed.groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    joined = keyed.join(twice.hint("shuffle_hash"), "key", "left")
    repeats = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.length("payload") >= MIN_REVISIT)
    ready = joined.select("id", "url", "payload", F.when(repeats, F.col("first")).alias("refers_to"))
    ready.mapInArrow(_writer(f"{folder}/archives", roll, when), _INDEX_SQL).write.parquet(f"{folder}/index")
    return folder, spark.read.schema(_INDEX_SQL).parquet(f"{folder}/index")


def _reader(folder: str, most: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        file, name = None, None

        def flush(group: list[tuple[int, int]]) -> Iterator[bytes]:
            begin = group[0][0]
            file.seek(begin)
            block = file.read(max(o + n for o, n in group) - begin)
            for o, n in group:
                yield block[o - begin : o - begin + n]

        try:
            for batch in batches:
                wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
                rows, at, size = [], 0, 0
                while at < len(wanted):
                    if wanted[at][0] != name:
                        if file is not None:
                            file.close()
                        name = wanted[at][0]
                        file = store.open_input_file(f"{base}/{name}")
                    begin = end = wanted[at][1]
                    group = []
                    while at < len(wanted) and wanted[at][0] == name and wanted[at][1] <= end + gap and (
                        not group or wanted[at][1] + wanted[at][2] - begin <= most
                    ):
                        group.append(wanted[at][1:])
                        end = max(end, sum(wanted[at][1:]))
                        at += 1
                    for record in flush(group):
                        r = unpack(record)
                        refers = r.get("X-Refers-To-Page")
                        rows.append({
                            "id": int(r["X-Page-ID"]) if r["X-Page-ID"] else None, "url": r["WARC-Target-URI"], "type": r["WARC-Type"],
                            "refers_to": int(refers) if refers is not None else None,
                            "digest": r["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "payload_bytes": int(r["X-Payload-Length"]),
                            "payload": None if r["WARC-Type"] == "revisit" else r["payload"],
                        })
                        size += len(r["payload"])
                        if size >= most:  # records of any size, but few bytes at a time
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
        finally:
            if file is not None:
                file.close()

    return run


def read(folder: str, selected: DataFrame, most: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records of the selected index rows: id, url, type, refers_to, digest, payload_bytes, payload (null for revisits).

    Rows are dealt by file and offset range, so a task reads a stretch of few files from front to back.
    """
    places = selected.select("file", "offset", "length")
    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(_reader(f"{qualified(selected.sparkSession, folder)}/archives", most, gap), _RECORD_SQL)
