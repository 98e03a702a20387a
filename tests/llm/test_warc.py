"""Archives: what is written comes back, in order, with revisits where payloads are equal."""

import gzip
import hashlib
import io
import random

import pytest

from fleetlens.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def pages():
    draw = random.Random(6)
    large = "<p>é" + "x" * 1200
    html = [None, "", "small", "small", large, large, large, "\r\n\r\nWARC/1.0\r\n" * 90, "y" * 999, "y" * 999, "z" * 1000, "z" * 1000]
    html += ["".join(draw.choices("ab\r\n ", k=draw.randint(0, 3000))) for _ in range(60)]
    urls = [f"http://{'www.' * (i % 2)}h{i % 4}.example.com:80{i % 3}/p{i % 7}?q={i}" for i in range(len(html))]
    urls[3:6] = [None, "not a url \r\nX: y", "http://[bad"]
    return [(i, u, h, "d", 1) for i, (u, h) in enumerate(zip(urls, html, strict=True))]


def test_round_trip(spark):
    rows = pages()
    got = warc.archived(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(r.page_id for r in got) == [r[0] for r in rows]
    payloads = {i: (h or "").encode() for i, _, h, *_ in rows}
    for r in got:
        own = payloads[r.page_id]
        last = max(i for i, p in payloads.items() if p == own)
        again = len(own) >= 1000 and last != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(own), hashlib.sha1(own).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last) if again else ("response", None))
    order = [(r.url_key, r.captured) for r in got]
    assert order == sorted(order)


def test_records_are_where_the_index_says(spark, tmp_path):
    path = str(tmp_path / "archives")
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    for entry in warc.read_runs(spark, path).where("record_type = 'response'").collect():
        with gzip.open(entry.run.removeprefix("file:"), "rb") as file:
            raw = file.read()[entry.offset :]
        assert raw.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n")
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert rest.partition(b"\r\n\r\n")[2].startswith((rows[int(entry.id)][2] or "").encode())


def test_broken_archives_are_reported():
    whole = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = gzip.compress(whole) + gzip.compress(whole)
    assert [(o, b) for o, _, b in warc.records(two)] == [(0, b"abc"), (len(whole), b"abc")]
    for broken in (whole[:-6], whole.replace(b"3", b"2"), whole.replace(b"/1.0", b"/9")):
        with pytest.raises(ValueError):
            list(warc.records(gzip.compress(broken)))


def test_loser_tree_merges():
    draw = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = []
        for r in range(k):
            made = [(draw.choice("abc"), str(draw.randrange(5)), str(draw.randrange(99)), f"r{r}", f"f{r}", i) for i in range(draw.randrange(9))]
            runs.append(sorted(made, key=warc._order))
        want = sorted((e for r in runs for e in r), key=warc._order)
        assert [warc._order(e) for e in warc.LoserTree(runs)] == [warc._order(e) for e in want]


def test_url_keys():
    assert warc.url_key("HTTP://www.Shop.Example.com/A?b=C") == "com,example,shop)/a?b=c"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key("urn:x-page:5") == "urn:x-page:5"


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
    got = warc.archived(spark.createDataFrame([("a/b c", None, None), (None, "http://h/", "x")], "page_id string, url string, html string"))
    assert {(r.page_id, r.payload_bytes) for r in got.collect()} == {("a/b c", 0), (None, 1)}


def test_pages_without_time_or_name(spark):
    """A null time, ids that are null or empty, and the same page twice."""
    rows = [("", "http://h/1", "a", None), (None, "http://h/2", "b", "2024-01-02 03:04:05"), ("x", None, None, None), ("x", None, None, None), ("%3E é", "http://h/3", "c" * 1000, None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, at string").selectExpr("*", "cast(at AS timestamp) AS captured")
    got = warc.archived(df, captured=df["captured"]).collect()
    assert sorted(((r.page_id, r.payload_bytes) for r in got), key=str) == sorted([("", 1), (None, 1), ("x", 0), ("x", 0), ("%3E é", 1000)], key=str)
    assert all(r.captured for r in got) and "2024-01-02T03:04:05Z" in {r.captured for r in got}


def test_members_and_small_reads():
    whole = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"

    class Slow(io.BytesIO):
        def read(self, n):
            return super().read(min(n, 5))

    archive = b"".join(gzip.compress(whole * n) for n in (1, 3, 2))
    assert [o for o, _, _ in warc.records(Slow(archive))] == [i * len(whole) for i in range(6)]
