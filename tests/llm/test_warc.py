import gzip
import hashlib
import random

import pytest

from tracelake.llm import warc

PAGES = "page_id long, url string, html string"


def pages(seed=1, n=40):
    rng = random.Random(seed)
    bodies = ["", "x" * 99, "y" * 100, "é" * 50, "long " * 4000, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\nHTTP/1.1 200 OK\r\n\r\n", "a\r\n\r\n\n\nfiledesc://x 1 2 3\n"]
    bodies += ["".join(rng.choices("abc<>\r\n é", k=rng.randint(0, 400))) for _ in range(10)]
    rows = [(k, rng.choice([f"http://h/{k}", f"http://h/a b/{k}\n", None, "http://é/ü"]), rng.choice(bodies)) for k in range(n)]
    return rows + [(100, "u", None), (None, "u", "y" * 100), (None, None, None), rows[3], rows[3]]


def brute(rows):
    low = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            low[b] = min(low.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i > low[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low[b] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("records", [3, 2000])
def test_round_trip(spark, records):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES + ", path string, payload string")
    back = warc.archive(warc.arcs_of(df, file_records=records)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == brute(rows)
    assert all(r.sound and r.date == "2026-01-01T00:00:00Z" for r in back)


def test_arc_files_of_both_versions_from_disk(spark, tmp_path):
    rows = [(str(k), f"http://h/{k}", (f"page {k} " * 20).encode()) for k in range(5)] + [(None, "http://bin/", b"\xff\xfe\x00" * 50)]
    (tmp_path / "one.arc").write_bytes(warc.arc_file("one.arc", "1", rows[:3], "20010203040506"))
    parts = warc.arc_file("two.arc", "2", rows[3:], "20010203")
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(parts[:200]) + gzip.compress(parts[200:]))
    arcs = spark.read.format("binaryFile").load(str(tmp_path))
    records = {r.url: r for r in warc.convert(arcs).collect()}
    assert len(records) == 6 and len({r.record_id for r in records.values()}) == 6
    assert bytes(records["http://bin/"].payload) == rows[5][2] and records["http://h/4"].date == "2001-02-03T00:00:00Z"
    assert records["http://h/0"].date == "2001-02-03T04:05:06Z" and records["http://h/0"].head.startswith(b"HTTP/1.1 200 OK\r\n")
    back = {r.url: r for r in warc.archive(arcs).collect()}
    assert back["http://bin/"].sound and back["http://bin/"].payload_digest == hashlib.sha256(rows[5][2]).hexdigest()


def test_headers_of_old_crawlers():
    about = b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://a 0.0.0.0 19970101000000 text/plain %d\n" % len(about) + about + b"\nhttp://h/a b 1.2.3.4 199701020304 text/html 5\nhello\n\n"
    ((fields, doc),) = list(warc.arc_records(data))
    assert fields["URL"] == "http://h/a%20b" and fields["IP-address"] == "1.2.3.4" and doc == b"hello"
    assert warc._date(fields["Archive-date"]) == "1997-01-02T03:04:00Z" and warc._date("x") == "1970-01-01T00:00:00Z"
    for broken in (data[:-6], b"http://h 1 2 3 1\na\n", data.replace(b"text/html 5", b"text/html 500")):
        with pytest.raises(ValueError):
            list(warc.arc_records(broken))


def test_empty_table(spark):
    assert warc.archive(warc.arcs_of(spark.createDataFrame([], PAGES))).count() == 0
