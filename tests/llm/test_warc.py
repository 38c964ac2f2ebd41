import hashlib
import io

import pytest

from tidebook.llm import warc


def plain(rows):
    first = {}
    for page_id, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(page_id, first.get(data, page_id))
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        again = to is not None and page_id is not None and page_id != to
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert got(warc.round_trip(pages)) == plain([(r.page_id, r.html) for r in pages.collect()])


def test_odd_rows(spark):
    long = "<p>é</p>\r\n\r\n" * 40
    rows = [(1, "u", None), (2, None, ""), (3, "a b\r\nX: y", long), (2, "u", long), (2, "u", long), (9, "ü", long), (None, "u", long), (5, "u", "short"), (6, "u", "short"), (7, "u", "z" * 3_000_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, size string")
    assert got(warc.round_trip(table)) == plain([(r[0], r[2]) for r in rows])
    assert warc.round_trip(table.limit(0)).count() == 0


def test_archive_bytes():
    records = [warc.record(i, "u", b"<html>%d</html>" % i * 50, "d", 1, None, False) for i in range(300)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    assert list(warc.frames(io.BytesIO(data))) == records
    assert len(data) < sum(map(len, records)) / 4
    assert list(warc.frames(io.BytesIO(warc.archive(records[:1])))) == records[:1]


def test_object_store_names_of_spark_are_known():
    pytest.importorskip("pyarrow.fs")
    try:
        disk, path = warc._place("s3a://bucket/shared/warc")
    except Exception as e:  # a build without the store says so, and not that the name is unknown
        assert "Unrecognized filesystem" not in str(e)
    else:
        assert path == "bucket/shared/warc"
