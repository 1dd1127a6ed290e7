"""Repeated rows of pages longer than a segment, with and without an id."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import warc

LONG = "<p>" + "y" * 600_000


@pytest.mark.parametrize("rows", [
    [(7, "u", LONG)] * 3 + [(9, "v", LONG), (8, "w", LONG + "z")],
    [(None, "u", LONG)] * 3,
    [(7, "u", LONG), (7, "u", LONG + "z"), (7, "v", LONG), (9, "x", LONG + "z")],
])
def test_warc_repeated_long_pages(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = [(str(k), len(t), hashlib.sha256(t.encode()).hexdigest(), "revisit" if k == 9 else "response", 7 if k == 9 else None) for k, _, t in rows]
    assert got == sorted(want)
    folder = str(tmp_path / "w")
    warc.write(warc.typed(pages), folder)
    whole = warc.payloads(warc.reassembled(warc.read(spark, folder))).select("record_id", "refers_to", F.col("digest")).collect()
    ids = {r["record_id"]: r["digest"] for r in whole}
    assert len(ids) == len(rows) and all(ids[r["refers_to"]] == r["digest"] for r in whole if r["refers_to"])


def test_segments_keep_any_bytes(spark, tmp_path):
    import os

    data = os.urandom(700_000)
    pages = spark.createDataFrame([(1, "u", data), (2, "v", b"\xff" * 50)], "page_id long, url string, html binary")
    folder = str(tmp_path / "w")
    warc.write(warc.typed(pages), folder)
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.payloads(warc.reassembled(warc.read(spark, folder))).collect()}
    assert got == {"<urn:page:1>": data, "<urn:page:2>": b"\xff" * 50}
