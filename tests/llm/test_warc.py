import hashlib

from netloom.llm import warc


def test_keys():
    assert warc.key_of("http://www.A.org/x?y#z") == "org,a,www)/x?y#z"
    assert warc.key_of("https://u@a.b:80") == "b,a:80)/"
    assert warc.key_of("") == ")/" and " " not in warc.key_of("http://a b/\n")


def test_round_trip_and_lookup(spark):
    big = "é" * 700
    rows = [
        (1, "http://a.org/1", big, "x"), (2, "http://a.org/2", big, "x"), (3, "http://b.org/\r\nX: y", "small", "x"),
        (4, "http://b.org/", "small", "x"), (5, None, None, "x"), (6, "http://a.org/1", "", "x"), (None, "http://c.org", big, "x"),
        (2, "http://a.org/2", big, "x"), (7, "http://long.org/", "w " * 200_000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    directory = warc.archive(spark, pages)
    read = warc.read_archives(directory).collect()
    assert len(read) == len(rows)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in read)
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        back = html == big and page != 2
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if back else "response", str(2 if back else None)))
    assert got == sorted(want)
    found = warc.lookup(directory, ["http://a.org/1", "http://none.org/"]).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "revisit"), (6, "response")]
    assert warc.read_archives(warc.archive(spark, pages.limit(0))).count() == 0


def test_lookup_over_many_blocks(spark, tmp_path):
    pages = spark.range(500).selectExpr(
        "id AS page_id", "concat('http://h', id % 7, '.org/', id % 100) AS url", "cast(id AS string) AS html"
    )
    captures = warc.write_archives(pages, f"{tmp_path}/a")
    directory = warc.write_index(captures, f"{tmp_path}/i", lines=11)
    for n in (0, 13, 99):
        url = f"http://h{n % 7}.org/{n}"
        want = sorted(i for i in range(500) if i % 7 == n % 7 and i % 100 == n)
        assert sorted(r.page_id for r in warc.lookup(directory, [url]).collect()) == want
    assert [bytes(r.payload).decode() for r in warc.lookup(directory, ["http://h1.org/1"]).collect()][0].isdigit()
