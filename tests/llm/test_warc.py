import gzip
import hashlib

import pytest

from quotemill.llm import warc as W
from quotemill.llm.common import prepare

PAGES = "page_id long, url string, html string, digest string"
ROWS = [(1, "http://a/", "<p>é</p>", "x"), (2, "http://b/", "<p>é</p>", "x"), (3, None, None, "x"), (4, "http://c/\r\nX: y", "", "x"), (5, "http://d/", "z" * 300_000, "x"),
        (6, None, "WARC/1.1\r\n\r\nnot a record\r\n\r\n", "x"), (None, "http://e/", "<p>é</p>", "x"), (None, "http://f/", "alone", "x"), (7, "http://g/", "same", "x"), (7, "http://g/", "same", "x")]


@pytest.fixture(scope="module")
def written(spark):
    pages = prepare(spark).createDataFrame(ROWS, PAGES)
    folder, index = W.write(pages.repartition(3), roll=2000)
    return folder, index


def test_every_page_comes_back(written):
    folder, index = written
    got = {}
    for r in W.read(folder, index).collect():
        got.setdefault(r.id, []).append(r)
    first = {}
    for i, _, html, _ in ROWS:
        if i is not None:
            first[html or ""] = max(i, first.get(html or "", i))
    for i, _, html, _ in ROWS:
        raw = (html or "").encode()
        digest = W.base32_sha1(raw)
        r = next(r for r in got[i] if r.digest == digest)
        assert r.payload_bytes == len(raw) and digest.isupper() and len(digest) == 32
        refers = first.get(html or "")
        revisit = refers is not None and refers != i
        assert (r.type, r.refers_to) == (("revisit", refers) if revisit else ("response", None))
        assert r.payload == (None if revisit else raw)
    assert sum(map(len, got.values())) == len(ROWS)


def test_index_tells_where_each_record_is(written):
    folder, index = written
    rows = index.collect()
    assert len({r.file for r in rows}) > 1  # rolled
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file, []).append(r)
    path = folder.removeprefix("file://")
    for name, part in by_file.items():
        with open(f"{path}/archives/{name}", "rb") as f:
            raw = f.read()
        part.sort(key=lambda r: r.offset)
        assert part[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(part, part[1:]))
        assert part[-1].offset + part[-1].length == len(raw)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        for r in part:
            assert W.unpack(raw[r.offset : r.offset + r.length])["WARC-Payload-Digest"] == f"sha1:{r.digest}"


def test_selected_records_only_and_reads_of_any_size(written):
    folder, index = written
    some = index.filter("id IN (1, 5, 6)")
    for most, gap in ((1, 0), (10_000, 0), (W.READ_BYTES, 1 << 30)):
        assert sorted(r.id for r in W.read(folder, some, most, gap).collect()) == [1, 5, 6]


def test_a_damaged_record_is_noticed():
    record, _ = W.pack(1, "http://a/", b"payload", None, "2024-01-01T00:00:00Z")
    bad = gzip.compress(gzip.decompress(record).replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(ValueError):
        W.unpack(bad)
    assert W.unpack(record)["payload"] == b"payload" and W.base32_sha1(b"") == __import__("base64").b32encode(hashlib.sha1(b"").digest()).decode()


def test_empty_table(spark):
    folder, index = W.write(spark.createDataFrame([], PAGES))
    assert index.count() == 0 and W.read(folder, index).count() == 0


def test_large_records_come_in_small_batches(spark):
    """Records of a megabyte each, with a budget of two: batches stay small however many records one asks for."""
    pages = prepare(spark).range(12).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('x', id, ' '), 300000) AS html")
    folder, index = W.write(pages.coalesce(1))
    assert folder.startswith("file:")
    near = index.select("file", "offset", "length").coalesce(1).sortWithinPartitions("file", "offset").toArrow().to_batches()
    sizes = [b.column(6).nbytes for b in W._reader(f"{folder}/archives", 2 << 20, 0)(iter(near))]
    assert len(sizes) >= 5 and max(sizes) < 4 << 20
    assert W.read(folder, index).selectExpr("sum(payload_bytes) AS n").first().n == sum(300000 * (2 + len(str(i))) for i in range(12))
