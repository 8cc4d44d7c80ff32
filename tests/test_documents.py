import datetime as dt

import pytest

from factweave.plans import documents as D


@pytest.fixture
def g(spark):
    t = dt.datetime(2024, 1, 1)
    edges = [("e1", "solar", "grid", "supports", "feeds it", 1.0, 0.9, "stated", t, None), ("e2", "grid", "storage", "needs", None, 1.0, None, "stated", t, None), ("e3", "coal", "grid", "contradicts", None, 1.0, 0.0, "stated", t, t + dt.timedelta(9)), ("e4", "storage", "lithium", "uses", None, 1.0, 0.7, "stated", t, None), ("e5", "cats", "dogs", "like", None, 1.0, 0.7, "stated", t, None)]
    nodes = [(x, x.title(), "concept", f"About {x}." if x == "grid" else "") for x in ("solar", "grid", "storage", "coal", "lithium", "cats", "dogs")]
    chunks = [("s#0", "s", "The grid takes solar power and storage helps the grid."), ("s#1", "s", "Cats and dogs.")]
    mentions = [("grid", "s#0", 2), ("solar", "s#0", 1), ("storage", "s#0", 1), ("cats", "s#1", 1), ("dogs", "s#1", 1)]
    return D.Graph(
        spark.createDataFrame(nodes, "id string, label string, type string, summary string"),
        spark.createDataFrame(edges, "id string, source string, target string, relation string, description string, weight double, confidence double, method string, valid_from timestamp, valid_to timestamp"),
        spark.createDataFrame(mentions, "node_id string, chunk_id string, count int"),
        spark.createDataFrame(chunks, "id string, source_id string, text string"),
        spark.createDataFrame([("s", "u", "Notes")], "id string, uri string, title string"),
    )


def test_between_and_path(g):
    assert D.between(g, "solar", "grid")["verdict"] == "linked directly"
    assert D.between(g, "solar", "cats")["verdict"].startswith("no connection")
    rows = D.explain_path(g, ["solar", "grid", "storage", "lithium"]).collect()
    assert [(r.shared, r.relations) for r in rows] == [(1, ["solar supports grid"]), (1, ["grid needs storage"]), (0, ["storage uses lithium"])]


def test_evidence_and_context(g):
    found = D.evidence(g, "grid")
    assert [r.id for r in found["supporting"].collect()] == ["e1"] and [r.id for r in found["contradicting"].collect()] == ["e3"]
    assert found["passages"].first().title == "Notes"
    items = D.context(g, "How does the grid use solar?").collect()
    assert [r.n for r in items] == list(range(1, len(items) + 1)) and [r.kind for r in items][0] == "concept" and items[-1].kind == "passage"
    assert sum(len(r.text) for r in D.context(g, "grid solar", budget=60).collect()) <= 60


def test_overview(g):
    out = D.analyze(g)
    assert {r.node for r in out["most_influential"].limit(2).collect()} == {"grid", "storage"} and out["diversity"] in ("biased", "focused", "diversified", "dispersed")
    assert out["topics"].count() == 2 and out["size"]["nodes"] == 7
    doc = D.graph_data(g, concept="solar", depth=1)
    assert {r.id for r in doc["nodes"].collect()} == {"solar", "grid", "storage"} and {r.id for r in doc["edges"].collect()} == {"e1", "e2"}


def test_contradictions_and_time(g, spark):
    found = D.contradictions(g, "grid")
    assert [r.id for r in found["superseded"].collect()] == ["e3"] and found["explicit"].count() == 0 and found["recorded"] is None
    told = D.timeline(g, "grid")
    assert (told["current"], told["closed"]) == (2, 1) and [r.event for r in told["entries"].collect()] == ["first seen", "relation added", "relation added", "relation added", "relation closed"]
    shown = D.show(g, "grid")
    assert [(r.direction, r.id) for r in shown["relations"].orderBy("direction", "place").collect()] == [("in", "e1"), ("out", "e2")] and shown["degree"] == 2
    assert D.evidence(g, "e-x")["supporting"].count() == 0
    assert {tuple(r) for r in D.same_concepts(g.edges.union(g.edges.limit(1).selectExpr("'e9'", "*").drop("id")), 5).collect()} <= {("e1", "e9"), ("e9", "e1")}


def test_search_and_names(g):
    from factweave.operators import retrieval

    rows = {r.id: r for r in retrieval.search(g.nodes, g.chunks, g.mentions, g.edges, "the grid").collect()}
    assert rows["grid"].matched == ["passage", "summary"] and rows["grid"].degree == 2 and rows["storage"].matched == ["passage"]
    first = retrieval.passages(g.chunks, g.sources, "grid").first()
    assert (first.chunk, first.source) == ("s#0", "Notes") and "[grid]" in first.snippet
    assert retrieval.resolve_one(g.nodes, g.edges, " Solar ") == "solar" and retrieval.resolve_one(g.nodes, g.edges, "lith") == "lithium"
    with pytest.raises(retrieval.NotFound) as error:
        retrieval.resolve_one(g.nodes, g.edges, "grids and dogs")
    assert error.value.suggestions == ["dogs"]
    assert {r.name: (r.id, r.how) for r in retrieval.resolve(g.nodes, g.nodes.sparkSession.createDataFrame([("DOGS",), ("lith",), ("o",), ("zzz",), ("",)], "name string")).collect()} == {"DOGS": ("dogs", "exact"), "lith": ("lithium", "part")}


def test_exports(g, tmp_path):
    import json

    for fmt in D.FORMATS:
        D.export(g, fmt, str(tmp_path / fmt))
    spark = g.nodes.sparkSession
    doc = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert doc["counts"] == {"nodes": 7, "edges": 5, "proximity": 4, "topics": 2} and not doc["truncated"] and len(doc["time"]["marks"]) == 2
    assert {n["id"]: len(n["passages"]) for n in doc["nodes"]}["grid"] == 1
    assert {r.path for r in spark.read.parquet(str(tmp_path / "obsidian")).collect()} >= {"Concepts/Grid.md", "Topics map.canvas"}
    page = D.visualize(g, question="How does solar connect to lithium?")
    assert '"lens": "path"' in page and '"to": "lithium"' in page
    assert D.graph_data(g, max_nodes=3)["truncated"]
