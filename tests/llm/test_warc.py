"""Archives read back by the streaming reader, by gzip itself, and after damage."""

import gzip
import io
import random

import pytest

from plumbline.functions.columns import scratch
from plumbline.llm import warc


def pages():
    rng = random.Random(6)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("<p>é漢\r\n\x00 a") for _ in range(rng.choice([1, 5, 900])))) for i in range(60)]
    rows += [(100 + i, None, rows[3][2]) for i in range(9)] + [(-4, "http://x y\r\nEvil: 1", rows[5][2]), (201, "u", None), (200, "u", ""), (300, "u", "z" * 700_000), (None, "u", rows[5][2]), (None, "u", "alone"), (7, "again", rows[7][2])]
    return rows


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "") if len(raw) >= least else None
        to = None if to == i else to
        out.append((i, len(raw), warc.digest(raw), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,file_bytes", [(0, 1 << 30), (100, 500)])
def test_round_trip(spark, least, file_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id bigint, url string, html string, sha1 string, payload binary").repartition(4)
    path = scratch(spark, "warc")
    warc.write(df, path, least_bytes=least, file_bytes=file_bytes)
    got = warc.read(spark, path).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows, least)
    by = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert all(bytes(r["payload"]) == by[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert {r["url"] for r in got if r["page_id"] == -4} == {"http://x%20y%0D%0AEvil:%201"}
    files = [r["file"] for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert (len(files) > 20) == (file_bytes == 500)


def test_every_member_is_one_record():
    raws = [warc.record(1, "u", b"abc"), warc.record(2, "u", b"abc", 1), warc.record(None, None, b"")]
    stream = b"".join(map(warc.member, raws))
    assert gzip.decompress(stream) == b"".join(raws)
    found = list(warc.records(io.BytesIO(stream)))
    assert [f["WARC-Type"] for f, _ in found] == ["response", "revisit", "response"]
    assert [warc.content(*f) for f in found] == [(3, b"abc"), (3, None), (0, b"")]


def test_damage_is_found():
    good = warc.record(1, "u", b"abcdef")
    for bad in (good.replace(b"abcdef", b"abcdeg"), good[:-2], good + b"x", b"HTTP" + good):
        with pytest.raises(warc.Damaged):
            list(warc.records(io.BytesIO(warc.member(bad))))
    with pytest.raises(warc.Damaged):
        list(warc.records(io.BytesIO(warc.member(good)[:-9])))


def test_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    stream = b"".join(warc.member(warc.record(i, "u", b"p" * i * 50)) for i in range(20))
    assert [len(warc.content(*f)[1]) for f in warc.records(io.BytesIO(stream))] == [50 * i for i in range(20)]


def test_no_pages(spark):
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
