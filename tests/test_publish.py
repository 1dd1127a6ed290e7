"""Published versions, documents written in parallel, pages without a URL."""

import json
import threading

import pytest

from weftline.plans import build
from weftline.functions import pages
from weftline.sources import codecs, readers
from weftline.sources.publish import Late, Published


def test_a_late_writer_is_told_and_a_lost_one_leaves_nothing_undone(spark, tmp_path):
    table = Published(spark, f"file://{tmp_path}/t")
    assert table.current() is None
    with pytest.raises(LookupError):
        table.read()
    one, two, three = (table.write(spark.range(n)) for n in (1, 2, 3))
    table.publish(one, None)
    with pytest.raises(Late):
        table.publish(two, None)
    assert table.read().count() == 1
    table.publish(two, one)
    # A writer that is lost between its claim and the pointer.
    assert table.files.put(f"_after-{two}", three.encode(), overwrite=False)
    assert table.current() == three and table.read().count() == 3
    assert table.replace(lambda last: last.where("id > 0")).count() == 2
    assert table.files.get("_current") == table.current()


def test_readers_always_find_a_version_between_two_writers(spark, tmp_path):
    table = Published(spark, f"file://{tmp_path}/t")
    table.replace(lambda _: spark.range(1))
    found, failed, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                found.append(table.read().count())
            except Exception as e:  # whatever it is, the test is to show it
                failed.append(e)

    def write():
        for _ in range(3):
            table.replace(lambda last: spark.range(last.count() + 1), tries=50)

    reader, writers = threading.Thread(target=read), [threading.Thread(target=write) for _ in range(2)]
    for x in (reader, *writers):
        x.start()
    for x in writers:
        x.join()
    done.set()
    reader.join()
    assert not failed and table.read().count() == 7 and set(found) <= set(range(1, 8))


def test_objects_are_overwritten_in_place(spark, tmp_path):
    o = readers.Objects(spark, f"file://{tmp_path}")
    for data in (b"one", b"", b"three"):
        o.write("a/b", data)
        assert o.read("a/b") == data
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["b"]


@pytest.mark.parametrize("kind", ["json", "xml", "flat"])
def test_documents_are_written_in_parts(spark, tmp_path, kind):
    rows = [{"k": i, "t": 'a "b" & <c>\n', "in": {"x": [i, None], "e": {}}} for i in range(40)]
    for n in (0, 1, 40):
        df = spark.createDataFrame([(i * 3, json.dumps(r)) for i, r in enumerate(rows[:n])], "_ord long, doc string").repartition(5)
        path = tmp_path / f"{kind}{n}"
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            codecs.write_document(df, str(path), kind, "A & B", ["k", "t"])
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        files = sorted(path.glob("part-*"))
        assert n < 40 or len([f for f in files if f.stat().st_size]) > 1
        assert "".join(f.read_text() for f in files) == codecs._made(kind, json.loads(json.dumps(rows[:n]), parse_int=float), "A & B", ["k", "t"]) + "\n"


def test_pages_without_a_url_are_not_one_page(spark):
    words = lambda seed: "<p>" + " ".join(f"word{seed}x{i} makes a plain sentence here." for i in range(60)) + "</p>"
    rows = [(0, None, words(0)), (1, None, words(1)), (2, None, words(2)), (3, "http://a.com/x", words(3)), (4, "http://b.com/", words(4)), (5, "http://A.com/x/", words(5))]
    got = build.cleaned(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert sorted(r["page_id"] for r in got.select("page_id").collect()) == [0, 1, 2, 3, 4]


def test_content_is_measured_in_bytes():
    text = json.dumps({"name": "日本語" * 30}, ensure_ascii=False)
    assert len(text) < 200 <= len(text.encode()) and pages._has_content(text)
    assert not pages._has_content(json.dumps({"name": "x" * 90}))
