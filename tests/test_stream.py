import datetime as dt

import pytest

from pyspark.sql import functions as F

from factweave.sources import readers
from factweave.streaming import events


def test_follow_and_first_closing(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "k", str(i)) for i in range(5)]
    spark.createDataFrame(rows, events.EVENT).write.parquet(log)
    got = []
    events.follow(spark, log, lambda df, n: got.extend(r.seq for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(got) == list(range(5))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.STATE_STORE)
    closings = spark.readStream.schema(events.EVENT).parquet(log).select(F.lit("e1").alias("edge"), F.col("seq"), (F.lit(dt.datetime(2024, 2, 1)) - F.expr("make_dt_interval(0, 0, cast(seq as int))")).alias("at"), F.col("data").alias("by"))
    q = events.first_closings(closings).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.seq, r.by) for r in spark.table("closed").collect()] == [(0, "0")]  # the first by seq, though its time is the latest


def test_versions_and_live_page(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.STATE_STORE)
    log, t = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    schema = "seq long, uri string, id string, at timestamp"
    pages = []
    for n, rows in enumerate(([(1, "u", "a", t), (2, "v", "x", t), (3, "u", "b", t)], [(4, "u", "c", t), (5, "v", "x", t)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).parquet(log)
        name = f"versions{n}"
        events.current_versions(stream).writeStream.foreachBatch(lambda df, i: pages.extend((r.old, r.by) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted(pages) == [("a", "b"), ("b", "c")]
    shown = []
    events.live_page(spark.readStream.schema(schema).parquet(log), lambda df: f"<p>{df.count()}</p>", shown.append, str(tmp_path / "cp2"), once=True).awaitTermination()
    assert shown == ["<p>5</p>"]


def test_transcripts(spark):
    raw = '{"message": {"role": "user", "content": "hi"}}\nnot json\n{bad\n{"type": "assistant", "content": [{"text": "yo"}]}\n{"role": "tool", "content": "no"}'
    raw += '\n{"role": "User", "content": "no"}\n{"role": "user", "content": [{"type": "tool_use", "text": "no"}, {"type": "input_text", "text": "a"}, "b", {"type": "text"}]}\n{"content": "bare"}\n{"type": "human", "text": "said"}\n{"message": {"content": "in"}, "role": "tool", "type": "ai"}'
    df = spark.createDataFrame([("u", raw), ("v", "plain"), ("w", '{"role": "tool", "content": "x"}')], "uri string, raw string")
    want = "user: hi\n\nassistant: yo\n\nuser: a\nb\n\nbare\n\nhuman: said\n\nai: in"
    assert {r.uri: r.text for r in readers.transcripts(df).collect()} == {"u": want, "v": "plain", "w": '{"role": "tool", "content": "x"}'}


def test_folder(spark, tmp_path):
    top = tmp_path / ".hidden parent" / "notes"
    for name, body in {"a.md": "# A", "sub/b.HTML": "<title>T</title><p>x &eacute;</p>", ".git/c.md": "no", "node_modules/d.md": "no", "e.bin": "no", "f.py": "pass", "blank.txt": " \n", ".g.md": "no", "log.jsonl": '{"role": "user", "content": "hi"}', "noext": "no"}.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (top / "bad.txt").write_bytes(b"caf\xe9 ok")
    (top / "big.txt").write_text("x" * 2_000_001)
    got = {r.title: r.text for r in readers.folder(spark, str(top)).collect()}
    assert got == {"a.md": "# A", "b.HTML": "T x é", "f.py": "pass", "log.jsonl": "user: hi", "bad.txt": "caf\ufffd ok"}
    assert [r.title for r in readers.folder(spark, str(top / "noext")).collect()] == ["noext"]
    (top / "p.pdf").write_bytes(b"%PDF")
    with pytest.raises(readers.MissingPrerequisite):
        readers.folder(spark, str(top))


def test_pages_and_text(spark):
    pages = spark.createDataFrame([("http://a", "<title> A &amp; b </title><p>x</p>"), ("http://b", "<p>y</p>"), ("http://c", None)], "url string, html string")
    assert {r.uri: (r.title, r.text) for r in readers.pages(pages).collect()} == {"http://a": ("A & b", "A & b x"), "http://b": ("http://b", "y")}
    with pytest.raises(readers.NetworkOff):
        readers.fetched(pages)
    import hashlib
    import io

    row = readers.inline(spark, "abc").first()
    assert (row.uri, row.title) == ("text:" + hashlib.sha256(b"abc").hexdigest()[:12], "pasted text")
    assert readers.lines_in(spark, io.StringIO("hello")).first().text == "hello"


def test_relations(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"edges": [{"source": "A", "relation": "likes", "target": "B", "confidence": 3, "from_type": "Some  Kind"}, {"source": "A"}], "triples": [{"node_1": "x", "node_2": "X"}, {"node_1": "p", "source": "q", "node_2": "r", "edge": "d", "chunk_id": "s#1"}]}')
    rows = readers.relations(spark, str(p)).orderBy("seq").collect()
    two = "a relation needs two different concepts (from, to)"
    assert [(r.source, r.relation, r.target, r.confidence, r.skipped) for r in rows] == [("a", "likes", "b", 1.0, None), ("a", "related_to", None, None, two), ("x", "related_to", "x", None, two), ("p", "related_to", "r", None, None)]
    assert rows[0].source_type == "some_kind" and (rows[3].description, rows[3].chunk) == ("d", "s#1")
    reply = lambda text: spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("j"))
    assert readers.checked_triples(reply('{"items": [{"from": "a", "to": "b"}, 3]}')).count() == 1 and readers.checked_triples(reply("[]")).count() == 0
    for bad in ('{"x": 1}', '[{"from": "a"}]', "3"):
        with pytest.raises(ValueError):
            readers.checked_triples(reply(bad))
