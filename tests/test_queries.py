"""Queries of the registry do their whole job, on small tables."""

import json

from pyspark.sql import functions as F

from factweave.operators import debate, ingest
from factweave.plans import registry
from factweave.sources import sinks


def put(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_cooccurrence_keeps_rare_pairs(spark, tmp_path):
    put(spark.createDataFrame([(1, "Solar grid. " * 7 + "Rare lithium."), (2, "Lithium grid.")], "doc_id long, text string"), tmp_path, "documents")
    got = {(r.a, r.b): (r.weight, r.docs) for r in registry.text_cooccurrence(spark, str(tmp_path)).collect()}
    assert got == {("grid", "solar"): (21.0, 1), ("lithium", "rare"): (3.0, 1), ("grid", "lithium"): (3.0, 1)}


def test_contradictions_of_all_events(spark, tmp_path):
    put(spark.createDataFrame([(1, 3, "click", 5.0), (2, 23, "error", 15.0), (3, 3, "view", 6.0), (4, 3, "click", 27.0), (5, 3, "click", 22.0), (6, 4, "click", 15.0), (7, 3, "view", 80.0)], "event_id long, user_id long, event_type string, value double"), tmp_path, "events")
    got = {tuple(sorted((r.edge_a, r.edge_b))) for r in registry.contradictions(spark, str(tmp_path)).collect()}
    assert got == {("e-1", "e-2"), ("e-2", "e-3"), ("e-4", "e-5")}


def test_negated_descriptions_are_candidates(spark):
    rows = [("a", "x", "y", "uses", "it uses it"), ("b", "y", "x", "uses", "it does not use it"), ("c", "x", "y", "needs", "never"), ("d", "x", "y", "uses", None), ("e", "x", "z", "uses", "cannot")]
    edges = spark.createDataFrame([(*r, i, None, "stated") for i, r in enumerate(rows)], "id string, source string, target string, relation string, description string, valid_from int, valid_to int, method string")
    # d has no description, so it doesn't oppose the negated one
    assert {(r.edge_a, r.edge_b) for r in debate.candidates(edges).collect()} == {("a", "b")}


def test_a_limit_keeps_the_first_candidates(spark):
    rows = [(f"e{i:03d}", "x", f"y{i % 3}", ("increases", "reduces", "uses")[i % 7 % 3], ("", "it is not", "it is")[i % 5 % 3], f"{i * 7 % 50:03d}", None, "stated") for i in range(90)]
    edges = spark.createDataFrame(rows, "id string, source string, target string, relation string, description string, valid_from string, valid_to string, method string")
    every = [tuple(r) for r in debate.candidates(edges).orderBy("x", "y", "at_a", "edge_a", "at_b", "edge_b").collect()]
    for limit in (1, 7, 40):
        assert [tuple(r) for r in debate.candidates(edges, limit).collect()] == every[:limit]
    counted = debate.opposed_counts(edges).collect()
    assert sum(r.left * r.right for r in counted) == len(every)


def test_exports_hold_all_nodes_and_edges(spark, tmp_path):
    put(spark.createDataFrame([(0, "EUROPE")], "r_regionkey int, r_name string"), tmp_path, "region")
    put(spark.createDataFrame([(7, "FRANCE", 0)], "n_nationkey int, n_name string, n_regionkey int"), tmp_path, "nation")
    put(spark.createDataFrame([(1, "Ann & Co", 7)], "c_custkey int, c_name string, c_nationkey int"), tmp_path, "customer")
    put(spark.createDataFrame([(2, "Parts", 7)], "s_suppkey int, s_name string, s_nationkey int"), tmp_path, "supplier")
    d, ids = str(tmp_path), {"region:0", "nation:7", "customer:1", "supplier:2"}
    links = {("customer:1", "located_in", "nation:7"), ("supplier:2", "located_in", "nation:7"), ("nation:7", "part_of", "region:0")}
    found = [(r.group, json.loads(r.element)["data"]) for r in registry.cytoscape(spark, d).collect()]
    assert {x["id"] for g, x in found if g == "nodes"} == ids and {(x["source"], x["relation"], x["target"]) for g, x in found if g == "edges"} == links
    lines = [r.line for r in registry.graphml(spark, d).collect()]
    assert len(lines) == 2 + 4 + 3 and sum("<graphml" in x for x in lines) == sum("</graphml>" in x for x in lines) == 1
    assert '    <node id="customer:1">\n      <data key="n_label">Ann &amp; Co</data>\n      <data key="n_type">customer</data>\n    </node>' in lines
    notes = {r.path: r.body for r in registry.vault(spark, d).collect()}
    assert set(notes) == {f"Concepts/{x}.md" for x in ("EUROPE", "FRANCE", "Ann & Co", "Parts")}
    assert "- → *part of* [[EUROPE]]" in notes["Concepts/FRANCE.md"] and "- ← *located in* [[Parts]]" in notes["Concepts/FRANCE.md"]


def test_sinks_of_odd_values(spark, tmp_path):
    import xml.dom.minidom

    nodes = spark.createDataFrame([('a "b"', "A <&> 'b'", "concept", "x\ny", 0, 2, 1.5, 0.25), ("c", 'a:B/"c"', "term", None, 1, 1, 0.5, 0.0), ("d", "A b  c", "term", "", 1, 0, 0.0, 0.0), ("e", "??", "term", "", 1, 0, 0.0, 0.0)], "id string, label string, type string, summary string, community int, degree int, strength double, betweenness double")
    edges = spark.createDataFrame([("e-1", 'a "b"', "c", "part_of", "so, \"it\" is", 1.0, 0.5, None, "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "me"), ("e-2", "c", "d", "uses", "", 2.0, None, "k#1", "2024-01-02T00:00:00Z", None, "")], "id string, source string, target string, relation string, description string, weight double, confidence double, chunk_id string, valid_from string, valid_to string, agent string")
    near = spark.createDataFrame([("c", "d", 3), ('a "b"', "c", 1)], "a string, b string, shared long")
    doc = "\n".join(r.line for r in sinks.graphml(nodes, edges, near, 'g "1"').orderBy("part", "line").collect())
    parsed = xml.dom.minidom.parseString(doc.encode())
    assert {n.getAttribute("id") for n in parsed.getElementsByTagName("node")} == {'a "b"', "c", "d", "e"} and {e.getAttribute("id") for e in parsed.getElementsByTagName("edge")} == {"e-1", "e-2", "p-0", "p-1"}
    assert {k.getAttribute("id"): k.getAttribute("attr.type") for k in parsed.getElementsByTagName("key")}["n_betweenness"] == "double"
    sinks.csv(edges, near, str(tmp_path / "csv"))
    import csv
    import glob

    rows = [r for f in glob.glob(str(tmp_path / "csv/*.csv")) for r in csv.reader(open(f, newline=""))]
    assert ["node_1", "node_2", "edge", "relation", "weight", "confidence", "chunk_id", "agent", "valid_from", "valid_to"] in rows
    assert ['a "b"', "c", 'so, "it" is', "part_of", "1.0", "0.5", "", "me", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"] in rows and ["c", "d", "contextual proximity", "contextual_proximity", "3", "", "", "", "", ""] in rows
    names = {r.id: r.name for r in sinks.file_names(nodes.select("id", "label")).collect()}
    assert names == {'a "b"': "A & 'b'", "c": "a B c", "d": "A b c (2)", "e": "untitled"}
    topics = spark.createDataFrame([(0, "First", 1, "All of it."), (1, "Second", 3, "")], "id int, label string, size int, summary string")
    quotes = spark.createDataFrame([("c", 1, "words", "Notes")], "id string, place int, excerpt string, source string")
    gaps = spark.createDataFrame([(1, "First", "Second", 0.75, 'a "b"', "c")], "place int, topic_a string, topic_b string, score double, bridge_a string, bridge_b string")
    notes = {r.path: r.body for r in sinks.vault(nodes, edges, topics, quotes, gaps).collect()}
    assert "~~(closed 2024-02-01)~~ `0.50`" in notes["Concepts/A & 'b'.md"] and "> words\n> — Notes" in notes["Concepts/a B c.md"] and 'topic: "[[Second]]"' in notes["Concepts/a B c.md"]
    assert notes["Topics/Second.md"].endswith("- [[a B c]]\n- [[A b c (2)]]\n- [[untitled]]\n") and "Start from [[A & 'b']] and [[a B c]]." in notes["Gaps.md"]
    value = {"graph": "g", "topics": [{"id": 0, "label": "First"}, {"id": 1, "label": "Second"}], "nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()]}
    board = json.loads(sinks.canvas(value, names))
    assert [x["type"] for x in board["nodes"]] == ["group", "group", "file", "file", "file", "file"] and [(x["fromNode"], x["label"]) for x in board["edges"]] == [(sinks.card_id("c"), "uses")]
    assert (board["nodes"][1]["x"], board["nodes"][2]["x"], board["nodes"][2]["y"]) == (1100, 390, 350)
    page = sinks.page(value | {"time": {"marks": []}, "evil": "</script><script>x"}, "T & t")
    assert "</script><script>x" not in page and "T &amp; t" in page and "://" not in page.replace("http://www.w3.org/2000/svg", "")


def test_word_network_of_odd_words(spark):
    """The network by pair is the edges by chunk summed up: rare words go, keys count, and no row for each chunk and pair is shuffled."""
    rows = [("1", "s", "Cat's tail and cat tail. Solar grid lithium. " * 3 + "Rare unicorn grid. " + "filler text here. " * 300), ("2", "s", "Lithium grid unicorn; cats' tail."), ("3", "t", "Rare once. Only here."), ("4", None, "Nobody wrote this."), ("5", "t", None), ("6", "u", "")]
    parts = spark.createDataFrame(rows, "id string, source_id string, text string")
    for least in (None, 1, 2, 3, 5):
        want = ingest.cooccurrence(parts, least)[1].groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("chunks"))
        found = ingest.network(parts, least)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = registry.ingest.network(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" in plan and plan.count("RepartitionByExpression") == 1


def test_cut_references_are_as_in_the_sql(spark, tmp_path):
    import duckdb

    titles = ["a &quot;b&quot; &quot", "c &copy", "d &middot", "e &amp", "f &am", "g &", "h &amp;copy; &ampcopy; &quotx; &ampx &copy;", "&quo"]
    rows = [(i, f"<title>{t}</title><p>{t}</p><div>{t} tail</div>") for i, t in enumerate(titles)] + [(90, None), (91, "<p>no title &quot")]
    put(spark.createDataFrame(rows, "page_id long, html string"), tmp_path, "pages")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_titles", "page_text"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = duck.execute(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
