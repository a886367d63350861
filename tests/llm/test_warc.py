import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import types as T

from stayrate.llm import warc

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)


def _b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_normalised_members_stand_alone():
    blocks = [b"", b"x" * 300_000, b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 10]
    heads = [[("WARC-Type", "response"), ("WARC-Record-ID", str(i))] for i in range(len(blocks))]
    wholes = [warc.record(h, b) for h, b in zip(heads, blocks)]
    stream = gzip.compress(b"".join(wholes), mtime=0)
    data, index = warc.normalise(stream)
    assert [data[s : s + n] for s, n, _ in index] == [warc.gzip_member(w) for w in wholes]
    assert gzip.decompress(data) == b"".join(wholes)
    # Many members, and a second pass, give the same.
    assert warc.normalise(data)[0] == data


def test_damage_is_an_error():
    stream = gzip.compress(warc.record([("WARC-Type", "response")], b"abc" * 1000))
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise(stream[:-20])
    with pytest.raises(ValueError):
        list(warc.records(iter([b"no record\r\n\r\n"])))


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, least):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same")]
    rows += [(7, "u", None), (8, "u", ""), (None, "u", ""), (9, "u", "é\r\n\r\nWARC/1.1")]
    rows += [(4, "d", "twice"), (4, "d", "twice"), (10, "l", "long " * 100_000), (11, "t", "ab")]
    rows += [(12, "t", "ab")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    found = warc.archive_round_trip(pages, revisit_bytes=least, archive_bytes=1000).collect()
    assert len(found) == len(rows)
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    for text, ids in groups.items():
        own = [r for r in found if r.payload_digest == _b32(text)]
        assert len(own) == len(ids)
        assert {r.payload_bytes for r in own} == {len(text.encode())}
        responses = [r for r in own if r.record_type == "response"]
        if len(text.encode()) < least:
            assert len(responses) == len(ids)
        else:
            best = max(i for i in ids if i is not None)
            assert [r.page_id for r in responses] == [best]
            assert all(r.refers_to == best for r in own if r.record_type == "revisit")
        assert all(bytes(r.payload) == text.encode() and r.refers_to is None for r in responses)


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_groups_are_of_equal_content(spark):
    rows = [(1, "u", "same", "x", "y"), (2, "u", "same", "x", "y"), (3, "u", None, "x", "y")]
    pages = spark.createDataFrame(rows, PAGES)
    planned, written = warc.planned_records(pages, "page_id", "url", "html", 0)
    found = {r.id: bytes(r.content) for r in written.collect()}
    assert found == {i: hashlib.sha256((t or "").encode()).digest() for i, _, t, *_ in rows}
    kinds = {r.id: (r.kind, r.refers_to, r.payload) for r in planned.collect()}
    assert kinds == {
        1: ("revisit", 2, None),
        2: ("response", None, b"same"),
        3: ("response", None, b""),
    }
