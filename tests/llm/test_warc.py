import base64
import hashlib

from tillroll.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, value string"
HTML = [
    "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x" * 40, "", "", None, "a WARC/1.1 b WARC/1.1", "x" * 40,
    "é WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9999\r\n\r\n", "\r\n\r\n", "WARC/1.1", "y" * 100_000,
    # a whole false record, as it would stand in an archive
    "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nHTTP\r\n\r\n\r\n\r\n",
]


def pages(spark):
    rows = [(i, f"http://e.example/{i}\r\nWARC-Type: forged", h, "c", "c") for i, h in enumerate(HTML)]
    return spark.createDataFrame([*rows, rows[1], (None, None, "x" * 40, None, None), (None, None, "alone", None, None)], PAGES)


def expected():
    body = [h or "" for h in HTML]
    out = []
    for i, h in enumerate(body):
        holder = max(j for j, x in enumerate(body) if x == h)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((f"<urn:page:{i}>", "response" if holder == i else "revisit", "" if holder == i else f"<urn:page:{holder}>",
                    len(h.encode()), digest, h if holder == i else None))
    x = base64.b32encode(hashlib.sha1(b"x" * 40).digest()).decode()
    alone = base64.b32encode(hashlib.sha1(b"alone").digest()).decode()
    return sorted([*out, out[1], ("<urn:page:null>", "revisit", "<urn:page:6>", 40, x, None),
                   ("<urn:page:null>", "response", "", 5, alone, "alone")], key=str)


def rows(found):
    return sorted(((r["record_id"], r["record_type"], r["refers_id"], r["payload_bytes"], r["digest"] or r["named_digest"], r["payload"])
                   for r in found.collect()), key=str)


def test_round_trip_rejects_magic_in_payloads(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages(spark).coalesce(1), path)
    assert rows(warc.read(spark, path)) == expected()


def test_every_split_size_gives_the_same_records(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages(spark).repartition(2), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    saved = [spark.conf.get(n) for n in names]
    try:
        for size in ("331", "4000"):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "1")
            assert rows(warc.read(spark, path)) == expected()
    finally:
        for n, v in zip(names, saved):
            spark.conf.set(n, v)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


def test_splits_may_change_between_the_scans(spark, tmp_path):
    """Executors that come or go change the splits: here they do between the scans of one read."""
    path = str(tmp_path / "archive")
    warc.write(pages(spark).repartition(2), path)
    name = "spark.sql.files.maxPartitionBytes"
    cost = "spark.sql.files.openCostInBytes"
    saved = [(n, spark.conf.get(n)) for n in (name, cost)]
    try:
        found = warc.read(spark, path)
        spark.conf.set(name, "331")
        spark.conf.set(cost, "1")
        assert rows(found) == expected()
    finally:
        for n, v in saved:
            spark.conf.set(n, v)
