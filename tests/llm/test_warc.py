"""Archives: exact round trips, record kinds, and faults that must be noticed."""

from __future__ import annotations

import hashlib
import random
import tempfile

import pytest

from ledgerscope.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(4)
    rows = [(i, f"http://h{i}/\r\nx", "é\r\n\r\n" * rng.randrange(0, 300) + str(i)) for i in range(40)]
    rows += [(100 + i, None, rows[i % 5][2]) for i in range(20)]
    rows += [(200, "u", None), (201, "u", ""), (202, "u", "tiny"), (203, "u", "tiny"), (204, "u", "x" * 99), (205, "u", "x" * 99), (206, "u", "y" * 100),
             (207, "u", "y" * 100), (208, "u", "0\r\n\r\nWARC/1.1\r\n" * 9000), (208, "u", "0\r\n\r\nWARC/1.1\r\n" * 9000), (209, "u", "0\r\n\r\nWARC/1.1\r\n" * 9000),
             (None, "u", "no id " * 50), (None, "u", "no id " * 50), (210, "u", "no id " * 50)]
    return rows


def expected(rows):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            first[b] = min(first.get(b, page), page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        owner = first.get(b)
        again = owner is not None and page is not None and owner != page
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("segment", [700, warc.SEGMENT_BYTES])
def test_round_trip(spark, segment):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    rows = pages()
    warc.write(spark.createDataFrame(rows, SCHEMA), path, segment=segment, per_archive=7)
    assert sorted(str(tuple(r)) for r in warc.pages_read(spark, path).collect()) == expected(rows)
    whole = warc.responses(warc.read(spark, path)).collect()
    texts = {(html or "").encode() for _, _, html in rows}
    assert {bytes(r["payload"]) for r in whole} == texts
    if segment == 700:
        found = warc.read(spark, path)
        assert found.where("type = 'continuation'").count() > 50
        with pytest.raises(Exception, match="segments are missing"):
            warc.responses(found.where("number != 3")).collect()


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.pages_read(spark, path).count() == 0


def test_framing_and_records():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        assert warc.unchunked(warc.chunked(b"z" * n)) == b"z" * n
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    one = warc.records(1, "u", b"p" * 500, None)[0]
    with pytest.raises(ValueError):
        warc.parse(one + b"\r\n")
