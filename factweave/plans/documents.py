"""Answers composed of operators: an overview, what lies between two concepts, evidence, a context to cite from, the graph as one document.

A graph is a `Graph` of tables: nodes(id, label, type, summary), edges(id, source, target, relation, description, weight, confidence, method, chunk_id, valid_from, valid_to),
mentions(node_id, chunk_id, count), chunks(id, source_id, text), sources(id, uri, title), and, where there are any, conflicts(id, edge_a, edge_b, verdict, reason, created_at) and reports(id, members, title, summary,
findings). `stored` gives the one of a `Store`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import excerpt, squeezed
from factweave.operators import debate, graph, retrieval, temporal, view
from factweave.operators.store import FORMAT, Store
from factweave.plans import router
from factweave.plans.storage import settle
from factweave.sources import sinks


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame
    chunks: DataFrame
    sources: DataFrame
    conflicts: DataFrame | None = None
    reports: DataFrame | None = None
    near: DataFrame | None = None  # mentions that count for nearness, where these aren't all
    name: str = "graph"

    def now(self, at: Column | None = None) -> DataFrame:
        return temporal.edges_of(self.edges, at=at)

    def pairs(self, at: Column | None = None, near: bool = True, relations: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
        """The weighted view at a time. Relations and types choose edges; nearness counts mentions of chosen concepts in passages that were read for their meaning."""
        mentions = (self.mentions if self.near is None else self.near) if near else None
        return settle(view.build_view(self.now(at), mentions, self.nodes, relations, types))

    def resolve(self, name: str) -> str:
        return retrieval.resolve_one(self.nodes, self.edges, name)


def stored(store: Store) -> Graph:
    """The graph of a store, its folds written once."""
    tables = {t: settle(getattr(store, t)(), t) for t in ("nodes", "edges", "mentions", "chunks", "sources", "conflicts", "reports")}
    return Graph(**tables, near=settle(store.reading_chunks(), "near"), name=store.name)


def centrality(pairs: DataFrame) -> DataFrame:
    """(node, degree, strength, degree_norm, betweenness)."""
    between = graph.betweenness(pairs).withColumn("betweenness", F.round("betweenness", 4))
    return view.degrees(pairs).withColumn("strength", F.round("strength", 2)).join(between, "node")


def topics(labels: DataFrame, cent: DataFrame, members: int = 12) -> DataFrame:
    """(label, size, title, members): groups of two and more, named by their three strongest members."""
    order = Window.partitionBy("label").orderBy(F.col("strength").desc(), "node")
    ranked = labels.join(cent, "node").withColumn("r", F.row_number().over(order))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    kept = ranked.filter(F.col("r") <= members).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "node"))).alias("m"))
    named = kept.withColumn("members", F.transform("m", lambda x: x["node"]))
    return size.filter("size > 1").join(named, "label").select("label", "size", F.array_join(F.slice("members", 1, 3), ", ").alias("title"), "members")


def group(g: Graph, pairs: DataFrame, method: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """(node, label) of all concepts; those without links are groups of their own, the last ones."""
    nodes = g.nodes.select(F.col("id").alias("node"))
    if method == "girvan-newman":
        return settle(graph.girvan_newman(pairs, nodes=nodes))
    if method != "louvain":
        raise ValueError(f'unknown method "{method}": use louvain or girvan-newman')
    return settle(graph.louvain(pairs, resolution, nodes=nodes))


def reported(g: Graph, labels: DataFrame) -> DataFrame:
    """(label, report, title, summary, findings): the saved report that has most in common with a group, from one half on."""
    if g.reports is None:
        return labels.select("label", F.lit(None).cast("string").alias("report"), F.lit(None).cast("string").alias("report_title"), F.lit(None).cast("string").alias("report_summary"), F.lit(None).cast("array<string>").alias("findings")).limit(0)
    members = g.reports.select(F.col("id").alias("report"), F.explode("members").alias("node"))
    told = g.reports.select(F.col("id").alias("report"), F.col("title").alias("report_title"), F.col("summary").alias("report_summary"), "findings")
    return view.match_groups(labels, members).join(told, "report").drop("jaccard")


def diversity_of(pairs: DataFrame, labels: DataFrame) -> dict:
    """state, modularity and the largest topic's share."""
    q = view.modularity(pairs, labels).first().q or 0.0
    sizes = labels.groupBy("label").count().filter("count > 1").agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    share = sizes.most / sizes.all if sizes.all else 1.0
    return {"state": view.diversity(q, share), "modularity": q, "top_topic_share": round(share, 3)}


def communities(g: Graph, at: Column | None = None, method: str = "louvain", resolution: float = 1.0, members: int = 12, near: bool = True) -> dict:
    """Topics with their strongest members and reports, how many concepts stand alone, and the state of diversity."""
    pairs = g.pairs(at, near)
    labels = group(g, pairs, method, resolution)
    cent = settle(centrality(pairs))
    found = topics(labels, cent, members).join(reported(g, labels), "label", "left")
    alone = labels.groupBy("label").count().filter("count = 1").count()
    return {"communities": found, "isolated": alone, "diversity": diversity_of(pairs, labels)}


def named_gaps(pairs: DataFrame, labels: DataFrame, cent: DataFrame, top: int) -> DataFrame:
    """structural_gaps with both topics' names."""
    found = view.structural_gaps(pairs, labels, top=top, centrality=cent)
    names = topics(labels, cent).select("label", "title")
    for x in "ab":
        found = found.join(names.select(F.col("label").alias(f"l{x}"), F.col("title").alias(f"topic_{x}")), f"l{x}", "left")
    return found


def analyze(g: Graph, at: Column | None = None, top: int = 10, near: bool = True) -> dict[str, DataFrame | str | dict]:
    """The size, the most central concepts, bridges, topics, gaps and the state of diversity."""
    pairs = g.pairs(at, near)
    labels, cent = group(g, pairs), settle(centrality(pairs))
    known = cent.join(labels, "node")
    spread = diversity_of(pairs, labels)
    return {
        "size": {"nodes": g.nodes.count(), "edges": g.now(at).count(), "linked_pairs": pairs.count()},
        "most_influential": known.orderBy(F.col("betweenness").desc(), F.col("degree").desc(), "node").limit(top),
        "most_connected": known.orderBy(F.col("strength").desc(), "node").limit(top),
        "bridges": view.bridges(pairs, labels).join(cent.filter("betweenness > 0"), "node").orderBy(F.col("betweenness").desc(), F.col("degree").desc(), "node").limit(top).select("node", "foreign"),
        "topics": topics(labels, cent).orderBy("label").limit(top),
        "gaps": named_gaps(pairs, labels, cent, 3),
        "diversity": spread["state"], "spread": spread,
    }


def gaps(g: Graph, at: Column | None = None, top: int = 5) -> DataFrame:
    """The largest gaps with their topics' names and the concepts that could bridge them."""
    pairs = g.pairs(at)
    return named_gaps(pairs, group(g, pairs), settle(centrality(pairs)), top)


def between(g: Graph, a: str, b: str, at: Column | None = None) -> dict:
    """How far apart two concepts are: hops, a common topic, both topics' names, shared neighbours, the shortest way and a verdict."""
    pairs = g.pairs(at)
    far = graph.hops(pairs, a).filter(F.col("node") == b).first()
    labels = group(g, pairs)
    own = {r.node: r.label for r in labels.filter(F.col("node").isin(a, b)).collect()}
    same = a in own and own.get(a) == own.get(b)
    titles = {r.label: r.title for r in topics(labels, settle(centrality(pairs))).filter(F.col("label").isin(*own.values())).collect()} if own else {}
    direct = g.now(at).filter(((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a)))
    if not direct.isEmpty():
        verdict = "linked directly"
    elif far is None:
        verdict = "no connection at all: a true gap"
    elif same:
        verdict = "close, in the same topic"
    else:
        verdict = "far apart, in different topics: a gap worth exploring" if far.hops >= 3 else "close, but in different topics"
    way = graph.shortest_path(pairs, a, b) if far is not None else []
    return {"hops": far and far.hops, "same_topic": same, "topics": [titles.get(own.get(x), x if x in own else None) for x in (a, b)], "verdict": verdict, "shared": view.shared_neighbours(pairs, a, b).orderBy("node").limit(20), "direct": direct, "path": way}


def show(g: Graph, node: str, at: Column | None = None, limit: int = 50) -> dict:
    """A concept: its row, relations either way with their sources' titles, neighbours and the passages that mention it most."""
    found = debate.show(g.now(at), node, limit, g.sources if "source_id" in g.edges.columns else None)
    own = debate.viewed(g.now(at), node)
    one = g.nodes.filter(F.col("id") == node)
    return {
        "node": one.first(), "relations": found, "degree": own.select("other").distinct().count(), "neighbours": own.select("other").distinct().orderBy("other").limit(limit),
        "mentions": passages(g, one.select(F.col("id").alias("node_id"), "label"), 5, 280),
    }


def timeline(g: Graph, node: str) -> dict:
    """All that was ever said about a concept in order of time, and how many of its relations are open and closed."""
    created = g.nodes.filter(F.col("id") == node).select(F.col("created_at").alias("at")) if "created_at" in g.nodes.columns else None
    own = temporal.edges_of(g.edges, node, closed=True)
    return {"entries": temporal.timeline(g.edges, node, g.conflicts, created), "current": own.filter("valid_to is null").count(), "closed": own.filter("valid_to is not null").count()}


def contradictions(g: Graph, node: str | None = None, at: Column | None = None, limit: int = 50) -> dict[str, DataFrame]:
    """Where the graph disagrees: relations that say so, recorded judgements, opposed pairs that nobody has judged yet, and closed relations."""
    now = temporal.edges_of(g.edges, node, at)
    ever = temporal.edges_of(g.edges, node, closed=True)
    order = ("valid_from", "id")
    found = debate.candidates(now if at is None else now.withColumn("valid_to", F.lit(None).cast(now.schema["valid_to"].dataType)), limit)
    recorded = g.conflicts
    if recorded is not None:
        found = debate.unreviewed(found, recorded)
        if node is not None:
            ids = ever.select("id")
            recorded = recorded.join(ids.withColumnRenamed("id", "edge_a"), "edge_a", "left_semi").unionByName(recorded.join(ids.withColumnRenamed("id", "edge_b"), "edge_b", "left_semi")).dropDuplicates(["id"])
        recorded = recorded.orderBy("created_at", "id").limit(limit)
    return {"explicit": now.filter(F.col("relation").isin(*debate.CONTRA)).orderBy(*order).limit(limit), "recorded": recorded, "candidates": found, "superseded": ever.filter("valid_to is not null").orderBy(*order).limit(limit)}


def same_concepts(edges: DataFrame, limit: int) -> DataFrame:
    """(edge_a, edge_b) of any two current relations with descriptions between the same two concepts, in order of the pair and of time: what to judge where nothing looks opposed."""
    said = edges.filter("valid_to is null and method <> 'cooccurrence' and coalesce(description, '') <> ''").select("id", "valid_from", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"))
    # of a pair's edges the first limit + 1 give all of the first `limit` pairs
    few = said.withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("valid_from", "id"))).filter(F.col("r") <= limit + 1)
    one, two = (few.select("x", "y", F.col("r").alias(f"r{k}"), F.col("id").alias(f"edge_{k}")) for k in "ab")
    return one.join(two, ["x", "y"]).filter("ra < rb").orderBy("x", "y", "ra", "rb").limit(limit).select("edge_a", "edge_b")


def paths(g: Graph, a: str, b: str, k: int = 3, at: Column | None = None) -> list[dict]:
    """Up to k ways between two concepts, each with its nodes, hops and explained steps."""
    pairs = g.pairs(at)
    return [{"nodes": p, "hops": len(p) - 1, "steps": explain_path(g, p, at)} for p in graph.alternative_paths(pairs, a, b, k)]


def explain_path(g: Graph, path: list[str], at: Column | None = None) -> DataFrame:
    """(step, a, b, relations, shared): up to three relations of each step of a path and the passages that its ends share."""
    spark = g.nodes.sparkSession
    steps = spark.createDataFrame([(i, x, y, *sorted((x, y))) for i, (x, y) in enumerate(zip(path, path[1:], strict=False))], "step int, a string, b string, lo string, hi string")
    typed = g.now(at).withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")}).join(F.broadcast(steps), ["lo", "hi"])
    typed = typed.withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy("valid_from", "id"))).filter("r <= 3").groupBy("step").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "relation", "target"))).alias("relations"))
    near = view.proximity(g.mentions if g.near is None else g.near).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "shared")
    return steps.join(typed, "step", "left").join(near, ["lo", "hi"], "left").select("step", "a", "b", "relations", F.coalesce("shared", F.lit(0)).alias("shared")).orderBy("step")


def passages(g: Graph, nodes: DataFrame, k: int = 10, width: int = 400) -> DataFrame:
    """(node_id, chunk_id, title, excerpt): passages that mention nodes(node_id) most, around the label where nodes have one, else around the id."""
    named = nodes if "label" in nodes.columns else nodes.withColumn("label", F.col("node_id"))
    top = retrieval.top_passages(g.mentions.join(named.select("node_id"), "node_id", "left_semi"), k)
    told = top.join(g.chunks.select(F.col("id").alias("chunk_id"), "source_id", "text"), "chunk_id").join(g.sources.select(F.col("id").alias("source_id"), "title"), "source_id", "left")
    return told.join(named, "node_id").select("node_id", "chunk_id", "source_id", "title", excerpt(F.col("text"), F.col("label"), width).alias("excerpt"), "place")


def evidence(g: Graph, target: str) -> dict:
    """What supports and what contradicts a concept, closed relations too, with its passages and their sources; of an edge's id its row, quote, passage, source and recorded conflicts."""
    if target.startswith("e-") and (edge := g.edges.filter(F.col("id") == target).first()) is not None:
        find = lambda df, id: None if id is None else df.filter(F.col("id") == id).first()
        row = edge.asDict()
        chunk = find(g.chunks, row.get("chunk_id"))
        source = find(g.sources, row.get("source_id") or (chunk and chunk.source_id))
        judged = None if g.conflicts is None else g.conflicts.filter((F.col("edge_a") == target) | (F.col("edge_b") == target))
        return {"edge": edge, "quote": row.get("evidence") or None, "passage": chunk and chunk.text, "source": source, "conflicts": judged}
    own = temporal.edges_of(g.edges, target, closed=True).withColumn("side", debate.side(F.col("relation")))
    one = g.nodes.sparkSession.createDataFrame([(target,)], "node_id string")
    told = settle(passages(g, one))
    from_ = told.select(F.col("source_id").alias("id")).distinct().join(g.sources.select("id", "title", "uri"), "id")
    return {"supporting": own.filter("side = 'for'"), "contradicting": own.filter("side = 'against'"), "passages": told, "sources": from_}


def context(g: Graph, query: str, budget: int = 12_000, at: Column | None = None, seeds: int = 5) -> DataFrame:
    """(n, kind, ref, text) to answer a question from: summaries of the concepts that search finds, up to twelve relations of each, six passages and the reports of the concepts' topics, in this
    order, as far as they fit. The items offered are bounded (seeds, 12 for each seed, 6, a report for each seed), so they are packed in one row."""
    found = retrieval.search(g.nodes, g.chunks, g.mentions, g.edges, query, seeds)
    rank = F.col("score") + 0.05 * F.least("degree", F.lit(20))
    hit = settle(found.withColumn("place", F.row_number().over(Window.orderBy(rank.desc(), "id"))).select("id", "place"))
    seed = F.broadcast(hit)
    item = lambda kind, order, ref, text: (F.lit(kind).alias("kind"), F.struct(*[c.cast("int").alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), ref.alias("ref"), text.alias("text"))
    summaries = g.nodes.join(seed, "id").filter("summary <> ''").select(*item("concept", (F.lit(0), F.col("place"), F.lit(0)), F.col("id"), F.format_string("%s (%s): %s", "label", "type", "summary")))
    ends = g.now(at).filter("method <> 'cooccurrence'").withColumn("end", F.explode(F.array("source", "target"))).join(seed.select(F.col("id").alias("end"), "place"), "end")
    ends = ends.withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy(debate.sure(F.col("confidence")).desc(), "id"))).filter("r <= 12")
    ends = ends.withColumn("first", F.row_number().over(Window.partitionBy("id").orderBy("place"))).filter("first = 1")
    line = F.concat(F.concat_ws(" ", "source", F.concat(F.lit("--"), "relation", F.lit("-->")), "target"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""), F.when(F.col("confidence").isNotNull(), F.format_string(" (confidence %.2f)", "confidence")).otherwise(""))
    relations = ends.select(*item("relation", (F.lit(1), F.col("place"), F.col("r")), F.col("id"), line))
    ranked = retrieval.ranked_passages(g.chunks, query).filter("rank < 6")
    told = g.chunks.join(F.broadcast(ranked.withColumnRenamed("chunk_id", "id")), "id").join(g.sources.select(F.col("id").alias("source_id"), "title"), "source_id", "left")
    quoted = told.select(*item("passage", (F.lit(2), F.col("rank"), F.lit(0)), F.col("id"), F.concat(F.lit("From "), F.coalesce("title", F.lit("")), F.lit(": "), F.substring(squeezed(F.col("text")), 1, 1200))))
    if g.reports is not None and not g.reports.isEmpty():
        labels = group(g, g.pairs(at))
        near = labels.join(seed.select(F.col("id").alias("node")), "node", "left_semi").select("label").distinct()
        topics_ = reported(g, labels).join(near, "label", "left_semi")
        quoted = quoted.unionByName(topics_.select(*item("report", (F.lit(3), F.col("label"), F.lit(0)), F.col("report"), F.concat(F.lit('Topic "'), "report_title", F.lit('": '), "report_summary"))))
    offered = summaries.unionByName(relations).unionByName(quoted).agg(F.array_sort(F.collect_list(F.struct("o", "kind", "ref", "text"))).alias("items"))
    return offered.select(F.posexplode(retrieval.pack(F.col("items"), budget)).alias("n", "x")).select((F.col("n") + 1).alias("n"), "x.kind", "x.ref", "x.text")


def cited(items: DataFrame) -> str:
    """The numbered text of a context."""
    return "\n".join(f"[{r.n}] {r.text}" for r in items.orderBy("n").collect())


#: Characters of a quote that a document's edge holds, and colours of topics.
QUOTE = 300
COLOURS = ("#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#76b7b2", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#86bcb6", "#d37295", "#8cd17d", "#499894", "#f1ce63", "#a0cbe8", "#ffbe7d")
ALONE = "#9aa0a6"


def graph_data(g: Graph, at: Column | None = None, concept: str | None = None, depth: int = 2, max_nodes: int = 1500, near: bool = True, quotes: int = 3) -> dict:
    """The document that exports start from: nodes with centrality, topic and first sight; edges, also closed ones, that had begun by then; near pairs, topics, gaps, quotes and times. Of larger graphs the strongest
    `max_nodes` nodes, and `truncated` says so."""
    pairs = g.pairs(at, near)
    labels, cent = group(g, pairs), settle(centrality(pairs))
    inside = labels.select("node")
    if concept is not None:
        one = g.nodes.sparkSession.createDataFrame([(concept,)], "node string")
        inside = graph.hops(pairs, concept, depth + 1).select("node").unionByName(one).distinct()
    known = labels.join(inside, "node", "left_semi").join(cent, "node", "left").fillna(0, ["degree", "strength", "degree_norm", "betweenness"])
    kept = settle(known.orderBy(F.col("strength").desc(), "node").limit(max_nodes + 1))
    truncated = kept.count() > max_nodes
    kept = kept.orderBy(F.col("strength").desc(), "node").limit(max_nodes)
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    colour = F.when(F.col("size") > 1, F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("community") % len(COLOURS) + 1).cast("int"))).otherwise(ALONE)
    rows = g.nodes.join(kept.withColumnRenamed("node", "id").withColumnRenamed("label", "community"), "id").join(size.withColumnRenamed("label", "community"), "community").withColumn("color", colour).drop("size")
    nodes = settle(rows.join(temporal.first_seen(g.edges).withColumnRenamed("node", "id"), "id", "left"))
    begun = g.edges if at is None else g.edges.filter(F.col("valid_from") <= at)
    ends = lambda df, x, y: df.join(nodes.select(F.col("id").alias(x)), x, "left_semi").join(nodes.select(F.col("id").alias(y)), y, "left_semi")
    edges = ends(begun, "source", "target")
    if "evidence" in edges.columns:
        edges = edges.withColumn("evidence", F.substring(F.coalesce("evidence", F.lit("")), 1, QUOTE))
    edges = settle(edges)
    rank = topics(labels, cent).join(reported(g, labels), "label", "left")
    named = rank.select(F.col("label").alias("id"), F.coalesce("report_title", "title").alias("label"), "size", F.coalesce("report_summary", F.lit("")).alias("summary"))
    return {
        "nodes": nodes, "edges": edges, "proximity": ends(view.proximity(g.mentions if g.near is None else g.near), "a", "b"), "topics": named, "gaps": named_gaps(pairs, labels, cent, 5),
        "quotes": passages(g, nodes.select(F.col("id").alias("node_id"), "label"), quotes, 280), "marks": temporal.time_marks(edges), "range": temporal.time_range(edges), "truncated": truncated, "spread": diversity_of(pairs, labels),
    }


def as_dict(g: Graph, data: dict, concept: str | None = None, at: str | None = None) -> dict:
    """graph_data as one value: for graphs within its `max_nodes`, since it passes through the driver."""
    plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    said: dict[str, list] = {}
    for r in data["quotes"].orderBy("node_id", "place").collect():
        said.setdefault(r.node_id, []).append({"source": r.title, "chunk": r.chunk_id, "excerpt": r.excerpt})
    nodes = [{**n, "passages": said.get(n["id"], [])} for n in plain(data["nodes"].orderBy("id"))]
    edges, near, topics_ = plain(data["edges"].orderBy("valid_from", "id")), plain(data["proximity"].orderBy("a", "b")), plain(data["topics"].orderBy("id"))
    times = data["range"].first()
    return {
        "format": FORMAT, "graph": g.name, "as_of": at, "focus": concept, "truncated": data["truncated"], "counts": {"nodes": len(nodes), "edges": len(edges), "proximity": len(near), "topics": len(topics_)},
        "nodes": nodes, "edges": edges, "proximity": [{"source": x["a"], "target": x["b"], "count": x["shared"]} for x in near], "topics": topics_, "gaps": plain(data["gaps"]), "diversity": data["spread"],
        "time": {"first": times["first"], "last": times["last"], "marks": [r.at for r in data["marks"].orderBy("at").collect()]},
    }


FORMATS = ("json", "cytoscape", "graphml", "csv", "obsidian", "canvas")


def export(g: Graph, fmt: str, path: str, at: Column | None = None, concept: str | None = None, depth: int = 2) -> None:
    """Writes the graph for other tools into the folder `path`, of any store that Spark can write: elements, lines, rows or notes in as many files as tasks, documents as one line of text."""
    if fmt not in FORMATS:
        raise ValueError(f'unknown format "{fmt}": use one of {", ".join(FORMATS)}')
    data = graph_data(g, at, concept, depth, max_nodes=100_000, quotes=5)
    quoted = data["quotes"].select(F.col("node_id").alias("id"), "place", "excerpt", F.col("title").alias("source"))
    spark = g.nodes.sparkSession
    one = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    if fmt == "cytoscape":
        sinks.cytoscape(data["nodes"], data["edges"], data["proximity"]).write.json(path)
    elif fmt == "graphml":
        sinks.write_lines(sinks.graphml(data["nodes"], data["edges"], data["proximity"], g.name), path)
    elif fmt == "csv":
        sinks.csv(data["edges"], data["proximity"], path)
    elif fmt == "obsidian":
        gaps_ = data["gaps"].select(F.row_number().over(Window.orderBy(F.col("score").desc(), "la", "lb")).alias("place"), "topic_a", "topic_b", "score", F.get("bridge_a", F.lit(0)).alias("bridge_a"), F.get("bridge_b", F.lit(0)).alias("bridge_b"))
        notes = sinks.vault(data["nodes"], data["edges"], data["topics"], quoted, gaps_)
        names = {r.id: r.name for r in sinks.file_names(data["nodes"].select("id", "label")).collect()}
        board = spark.createDataFrame([("Topics map.canvas", sinks.canvas(as_dict(g, data, concept), names))], "path string, body string")
        notes.unionByName(board).write.parquet(path)
    else:
        doc = as_dict(g, data, concept)
        one(sinks.canvas(doc) if fmt == "canvas" else sinks.embedded(doc))


def visualize(g: Graph, title: str | None = None, question: str | None = None, max_nodes: int = 1500, **choices) -> str:
    """A self-contained page of the graph; with a question or a lens it opens on the view that answers it."""
    plan = None
    if choices.get("view") and not question and not choices.get("lens"):
        choices["lens"] = router.lens_for_view(choices["view"], choices.get("concept"))
    if question or choices.get("lens"):
        plan = router.choose(g.nodes, g.edges, question, **choices)
    data = graph_data(g, max_nodes=max_nodes)
    doc = as_dict(g, data)
    if plan and any(x and x not in {n["id"] for n in doc["nodes"]} for x in (plan["concept"], plan["to"])):
        doc = as_dict(g, graph_data(g, concept=plan["concept"], max_nodes=max_nodes), plan["concept"])
    return sinks.page(doc | ({"open": plan} if plan else {}), title)


def stats(store: Store) -> dict:
    """Counts, concepts by type, the 30 most used relations of open edges (ties by name), and the last event."""
    kinds = store.nodes().groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type").collect()
    used = relation_counts(store.edges().filter("valid_to is null")).collect()
    return {"graph": store.name, "path": store.path, "created_at": store.meta("created_at"), **store.counts().first().asDict(), "node_types": {r.type: r.n for r in kinds}, "relations": {r.relation: r.n for r in used}, "last_event": store.last_event()}


def relation_counts(edges: DataFrame, top: int = 30) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "relation").limit(top)
