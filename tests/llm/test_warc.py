import gzip
import hashlib
import io

from quern.llm import warc


def plain(pages, min_bytes=100):
    first = {}
    for page, html in sorted(pages, key=lambda x: x[0]):
        first.setdefault((html or "").encode(), page)
    out = {}
    for page, html in pages:
        data = (html or "").encode()
        again = len(data) >= min_bytes and first[data] != page
        out[page] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None)
    return out


def test_query_against_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = warc.op1_warc(spark, sf).collect()
    assert {r.page_id: tuple(r)[1:5] for r in rows} == plain(pages) and len(rows) == len(pages)


def test_copies_odd_rows_and_small_archives(spark):
    texts = [None, "", "é" * 50, "é" * 50, "é" * 49, "é" * 49, "WARC/1.1\r\n\r\n" * 20, "x" * 300_000, "x" * 300_000]
    pages = [(100 - i, texts[i % len(texts)]) for i in range(60)]
    frame = spark.createDataFrame([(p, None if p % 7 == 0 else f"http://x/{p}\r\nX: y", h, "other") for p, h in pages], "page_id long, url string, html string, archive string").repartition(3)
    for max_bytes in (1, 200_000, 64 << 20):
        made, uri = warc.archive_pages(frame, max_bytes=max_bytes)
        rows = warc.read_archives(made, uri).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == plain(pages) and len(rows) == len(pages)
    made, uri = warc.archive_pages(frame.limit(0))
    assert warc.read_archives(made, uri).count() == 0


def test_equal_ids(spark):
    frame = spark.createDataFrame([(1, "u", "y" * 200), (1, "u", "y" * 200), (None, "u", "y" * 200)], "page_id long, url string, html string")
    made, uri = warc.archive_pages(frame)
    rows = warc.read_archives(made, uri).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [("1", "response", None), ("1", "revisit", 1), ("None", "revisit", 1)]


def test_inflater_reads_one_stream_and_many_members():
    records = [warc.record("response", i, "u", b"p" * (i * 1000), "d", i * 1000) for i in range(50)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        stream = io.BufferedReader(warc.Inflater(io.BytesIO(data), 777))
        found = []
        while (r := warc.read_record(stream)) is not None:
            found.append(r[0]["warc-page-id"])
        assert found == [str(i) for i in range(50)]


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    cursor = con.execute(warc.SQL)
    names = [d[0] for d in cursor.description]
    frame = warc.op1_warc(spark, sf)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(tuple(r) for r in frame.select(*names).collect()) == sorted(cursor.fetchall())
