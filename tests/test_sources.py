import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from scrivora.operators.crawl import outcomes, progress
from scrivora.operators.numbering import number_rows
from scrivora.sources import articles as art
from scrivora.sources import dumps
from scrivora.sources.pages import parse_pages, read_page

DUMP = '<doc id="7" url="https://x.org/7" title="T">body</doc><doc id="8" url="https://x.org/8" title="U">has <b> tag</doc><doc id="99999999999" url="http://x.org/9" title="V">big</doc>'
PAGE = '<h1 id="firstHeading">T</h1><div class="mw-parser-output"><p>a <b>b</b></p><p> </p><div><p>nested</p></div><script>"</p>"</script><p>c</p></div>'


def test_dump(spark, table, tmp_path):
    assert rows(dumps.parse_dump(table([(DUMP,), (None,), ("",)], "value string"))) == [(0, "V", "http://x.org/9", "big"), (7, "T", "https://x.org/7", "body")]
    (tmp_path / "AA").mkdir()
    (tmp_path / "AA" / "wiki_00").write_text(DUMP)
    assert dumps.read_dumps(spark, [str(tmp_path / "A*" / "*")]).count() == 2
    (tmp_path / "AB").mkdir()
    (tmp_path / "AB" / "wiki_01").write_bytes(DUMP.encode() + b"\xff\xfe")
    assert rows(dumps.dump_files(spark, [str(tmp_path / "A*" / "*")])) == [("AA", "wiki_00", True, 2), ("AB", "wiki_01", False, 0)]
    assert dumps.read_dumps(spark, [str(tmp_path / "A*" / "*")]).count() == 2


def test_page():
    assert read_page(PAGE) == ("T", "a b\nc")
    assert read_page("") == read_page(None) == (None, "")
    assert read_page("<div class=mw-parser-output><p>x<p>y</div>") == (None, "x\ny")


def test_pages(spark, table):
    pages = table([(1, "u1", PAGE, 9), (2, "u2", "<p>none</p>", 9), (3, None, None, 9)], "id long, url string, html string, title int")
    assert rows(parse_pages(pages)) == [(1, "u1", "T", "a b\nc")]


def test_words(spark, table, tmp_path):
    (tmp_path / "w.txt").write_text("the \n\nThe\nthe\n")
    assert rows(dumps.read_words(spark, str(tmp_path / "w.txt"))) == [("The",), ("the",)]


def test_json(spark, table):
    lines = table([('{"query": "a", "limit": 5}',), ("no json",), (None,)], "value string")
    assert [tuple(r) for r in dumps.parse_requests(lines).collect()] == [("a", 5, None, None), (None,) * 4, (None,) * 4]
    body = json.dumps({"query": {"pages": {"1": {"title": "A", "extract": "x"}, "2": {"title": "B", "extract": ""}, "3": {"title": "C"}}}})
    assert rows(dumps.parse_extracts(table([(body,), ("{}",)], "value string"))) == [("A", "x")]
    titles = json.dumps({"query": {"allpages": [{"pageid": 1, "title": "A"}, {"pageid": 2, "title": "B"}]}})
    assert rows(dumps.parse_titles(table([(titles,)], "value string"))) == [("A",), ("B",)]
    assert dumps.resume(10, 10) == 0 and dumps.resume(4, 10) == 10_006
    assert dumps.as_json(table([(1, None)], "a int, b string")).head()[0] == '{"a":1,"b":null}'


def test_first_and_new(spark, table):
    got = art.first_per_key(table([(3, "u"), (1, "u"), (1, "u"), (2, None), (4, None), (None, "w")], "id long, url string"), "url")
    assert rows(got) == [(1, "u"), (2, None), (4, None), (None, "w")]
    stored = table([(1, "u"), (5, None)], "id long, url string")
    assert rows(art.new_rows(stored, table([(7, "u"), (8, "v"), (9, "v"), (10, None)], "id long, url string"), "url")) == [(8, "v"), (10, None)]


def test_append_new(spark, table, tmp_path):
    path = str(tmp_path / "articles")
    arriving = table([(1, "t", "u", "x"), (2, "t", "u", "y"), (3, "s", "v", "z")], "id long, title string, url string, text string")
    assert art.append_new(spark, path, arriving, "url") == 2
    assert art.append_new(spark, path, arriving, "url") == 0
    assert not art.create_if_missing(spark, path)
    assert rows(art.scan_articles(spark, path).select("id")) == [(1,), (3,)]


def test_filters(spark, table):
    df = table([(1, "t", "x" * 149), (2, None, "x" * 150), (3, "t", ""), (4, "", "x" * 151), (5, "t", None)], "id long, title string, text string")
    assert rows(art.long_enough(df).select("id")) == [(2,), (4,)]
    assert rows(art.complete(df).select("id")) == [(1,), (4,)]
    assert rows(art.with_content(df, "text").select("id")) == [(1,), (2,), (4,)]


def test_numbers(spark, table):
    df = table([(i * 7 % 101,) for i in range(101)] + [(None,)], "x int")
    got = number_rows(df, ["x"], partitions=5).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(102)) and [r["x"] for r in got] == [None, *range(101)]
    assert number_rows(df.limit(0), ["x"]).count() == 0


def test_crawl(spark, table):
    import datetime as dt

    at = [dt.datetime(2026, 1, 1, 0, 0, s) for s in (0, 10)]
    log = table([(1, "saved", at[0]), (1, "saved", at[0]), (2, "timeout", at[1])], "fetch_id long, outcome string, fetched_at timestamp_ntz")
    assert rows(outcomes(log)) == [("saved", 1), ("timeout", 1)]
    assert tuple(progress(log, 4).head()) == (2, 1, 50.0, 10.0, 0.2, "00:00:10")
    assert tuple(progress(log.limit(0), 4).head()) == (0, 0, 0.0, 0.0, 0.0, "00:00:00")


def test_stream(spark, table, tmp_path):
    from scrivora.streaming.ingest import PAGES, ingest_pages, outcome_counts, page_stream

    source, target = str(tmp_path / "pages"), str(tmp_path / "articles")
    table([(1, "u1", PAGE), (2, "u1", PAGE), (3, "u2", "<p>no</p>")], PAGES).write.parquet(source)
    for i in range(2):
        ingest_pages(page_stream(spark, source), target, str(tmp_path / f"c{i}")).awaitTermination()
    assert rows(art.scan_articles(spark, target)) == [(1, "T", "u1", "a b\nc")]

    log = str(tmp_path / "log")
    spark.sql("select 1L as fetch_id, 'saved' as outcome, timestamp'2026-01-01 00:10:00' as fetched_at union all select 1L, 'saved', timestamp'2026-01-01 00:10:00'").write.parquet(log)
    stream = outcome_counts(spark.readStream.schema(spark.read.parquet(log).schema).parquet(log))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n"] for r in spark.table("counts").collect()] == [1]


def test_database_source_needs_driver(spark):
    with pytest.raises(Exception):
        art.scan_database(spark, "jdbc:sqlite:/nowhere.db").count()
    assert os.sep and F is not None
