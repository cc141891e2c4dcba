import base64
import hashlib
import os

from scriptloom.llm import common, warc
from scriptloom.llm.common import new_folder

PAGES = [(1, "http://a/%41?\r\nx", "hello"), (2, None, "hello"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (None, "u", "hello"), (2, "u", "hello"), (7, "u", "ä\r\n\r\nWARC/1.1")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, html string").selectExpr("record_id", "url", "cast(html as binary) payload", "9 as bundle", "8 as frame")


def test_round_trip_random_access_and_revisits(spark):
    index = warc.write_bundles(warc.mark_revisits(pages(spark, PAGES)), new_folder(spark, "w"), frame_bytes=1000)
    rows = warc.read_bundles(index.select("bundle").distinct()).collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    want = []
    first = {"hello": 1, "": 3, PAGES[4][2]: 5, PAGES[7][2]: 7}
    for i, _, h in PAGES:
        p = (h or "").encode()
        f = first[h or ""]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    assert got == sorted(want, key=repr)
    for r in index.collect():
        reader = warc.BundleReader(r.bundle)
        assert reader.record(r.frame, r.frame_offset)["record_id"] == r.record_id
        reader.close()
    assert {r.url for r in rows if r.record_id == 1} == {"http://a/%41?\r\nx"}


def test_threshold_and_empty(spark):
    marked = warc.mark_revisits(pages(spark, PAGES), min_revisit_bytes=1).collect()
    assert {r.refers_to for r in marked if r.record_id in (3, 4)} == {None}
    index = warc.write_bundles(warc.mark_revisits(pages(spark, [])), new_folder(spark, "w"))
    assert index.count() == 0
    assert warc.read_bundles(index.select("bundle").distinct()).count() == 0


def test_working_tables_go(spark, tmp_path):
    with common.working():
        kept = common.settled(spark, "kept", lambda: common.written(spark.range(3), "inner"))
        files = kept.inputFiles()
        assert kept.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    out = common.settled(spark, "result", lambda: common.written(spark.range(5), "inner"))
    assert out.count() == 5
