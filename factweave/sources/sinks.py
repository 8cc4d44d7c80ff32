"""Sinks: the graph document, Cytoscape, GraphML, CSV, a vault of notes, a canvas and a page that needs nothing else.

Tables that any number of rows may have (elements, lines, notes) are made row by row; documents that are one value (the graph document, the canvas, the page) are for graphs of a stated number of nodes
(`max_nodes` of the document that they start from).

Columns used: nodes(id, label, type, summary, community, degree, strength, betweenness), edges(id, source, target, relation, description, weight, confidence, valid_from, valid_to, agent, chunk_id),
near(a, b, shared), topics(id, label, size, summary), quotes(id, place, excerpt, source), gaps(place, topic_a, topic_b, score, bridge_a, bridge_b). Columns that a table hasn't count as null.
"""

from __future__ import annotations

import json
import math
from hashlib import sha1

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.plans.storage import numbered

#: GraphML keys with their types, and the columns of the table of relations.
NODE_KEYS = {"label": "string", "type": "string", "community": "int", "degree": "int", "strength": "double", "betweenness": "double", "summary": "string"}
EDGE_KEYS = {"relation": "string", "description": "string", "weight": "double", "confidence": "double", "valid_from": "string", "valid_to": "string", "agent": "string"}
CSV_COLUMNS = ("node_1", "node_2", "edge", "relation", "weight", "confidence", "chunk_id", "agent", "valid_from", "valid_to")
#: Signs that file names can't have, and their length.
BAD_SIGNS, NAME_CHARS = r'[\\/:*?"<>|#^\[\]]', 120
#: Fixed values of the canvas: topics, cards of each, and links at most; a group's place and size, a card's size, and how far cards are from the middle.
TOPICS, CARDS, LINKS = 8, 12, 400
STEP, GROUP, CARD, RING = (1100, 900), (1000, 800), (220, 100), 300


def have(df: DataFrame, names: tuple[str, ...], kind: str = "string") -> DataFrame:
    """df with those of the columns that it lacks as nulls."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast(kind))
    return df


def near_rows(near: DataFrame) -> DataFrame:
    """(i, a, b, shared) of near pairs, numbered from 0 in order of a and b."""
    return numbered(near.select("a", "b", "shared"), ["a", "b"]).withColumnRenamed("seq", "i")


def cytoscape(nodes: DataFrame, edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(group, element): nodes without their passages, edges, and near pairs as edges p-0, p-1, ..., an element as JSON in each row."""
    shown = [c for c in nodes.columns if c != "passages"]
    out = nodes.select(F.lit("nodes").alias("group"), F.to_json(F.struct(F.struct(*shown).alias("data"))).alias("element"))
    out = out.unionByName(edges.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.struct(*edges.columns).alias("data"))).alias("element")))
    if near is not None:
        data = F.struct(F.concat(F.lit("p-"), F.col("i").cast("string")).alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), F.lit("contextual_proximity").alias("relation"), F.col("shared").alias("weight"))
        out = out.unionByName(near_rows(near).select(F.lit("edges").alias("group"), F.to_json(F.struct(data.alias("data"))).alias("element")))
    return out


def xml(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def attribute(text: Column) -> Column:
    """A quoted attribute value: in double quotes, unless only these stand in it."""
    safe = xml(text)
    for sign, name in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))
    double, single = F.contains(safe, F.lit('"')), F.contains(safe, F.lit("'"))
    wrap = lambda q, x: F.concat(F.lit(q), x, F.lit(q))
    return F.when(double & ~single, wrap("'", safe)).otherwise(wrap('"', F.replace(safe, F.lit('"'), F.lit("&quot;"))))


def _data(df: DataFrame, keys: dict[str, str], mark: str) -> Column:
    """<data> lines of the keys that aren't null or empty."""
    cells = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat(F.lit(f'      <data key="{mark}_{k}">'), xml(F.col(k).cast("string")), F.lit("</data>"))) for k in keys]
    return F.concat_ws("\n", *cells)


def graphml(nodes: DataFrame, edges: DataFrame, near: DataFrame | None = None, name: str = "graph") -> DataFrame:
    """(part, line) of a directed GraphML document with typed keys: head, nodes, edges, near pairs as edges, tail. A line holds one element."""
    nodes, edges = have(nodes, tuple(NODE_KEYS)), have(edges, ("id", *EDGE_KEYS))
    spark = nodes.sparkSession
    keys = [f'  <key id="{mark}_{k}" for="{kind}" attr.name="{k}" attr.type="{t}"/>' for mark, kind, table in (("n", "node", NODE_KEYS), ("e", "edge", EDGE_KEYS)) for k, t in table.items()]
    head = spark.createDataFrame([(0, "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys]), name)], "part int, line string, name string")
    head = head.select("part", F.concat("line", F.lit("\n  <graph id="), attribute(F.col("name")), F.lit(' edgedefault="directed">')).alias("line"))
    element = lambda what, inner, *a: F.concat_ws("\n", F.concat(F.lit(f"    <{what} "), F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), attribute(v)) for k, v in a]), F.lit(">")), F.nullif(inner, F.lit("")), F.lit(f"    </{what}>"))
    out = head.unionByName(nodes.select(F.lit(1).alias("part"), element("node", _data(nodes, NODE_KEYS, "n"), ("id", F.col("id"))).alias("line")))
    ids = [("id", F.coalesce("id", F.concat_ws("|", "source", "relation", "target"))), ("source", F.col("source")), ("target", F.col("target"))]
    out = out.unionByName(edges.select(F.lit(2).alias("part"), element("edge", _data(edges, EDGE_KEYS, "e"), *ids).alias("line")))
    if near is not None:
        line = F.concat(F.lit('    <edge id="p-'), F.col("i").cast("string"), F.lit('" source='), attribute(F.col("a")), F.lit(" target="), attribute(F.col("b")), F.lit('><data key="e_relation">contextual_proximity</data><data key="e_weight">'), F.col("shared").cast("string"), F.lit("</data></edge>"))
        out = out.unionByName(near_rows(near).select(F.lit(3).alias("part"), line.alias("line")))
    return out.unionByName(spark.createDataFrame([(4, "  </graph>\n</graphml>")], "part int, line string"))


def write_lines(parts: DataFrame, path: str) -> None:
    parts.orderBy("part", "line").select("line").write.text(path)


def relation_table(edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """CSV_COLUMNS of relations, then of near pairs as `contextual_proximity`."""
    e = have(edges, ("description", "chunk_id", "agent", "valid_from", "valid_to"))
    text = lambda c: F.col(c).cast("string")
    of = {"node_1": "source", "node_2": "target", "edge": "description"}
    rows = have(e, ("weight", "confidence"), "double").select(*[text(of.get(c, c)).alias(c) for c in CSV_COLUMNS])
    if near is None:
        return rows
    given = {"node_1": F.col("a"), "node_2": F.col("b"), "edge": F.lit("contextual proximity"), "relation": F.lit("contextual_proximity"), "weight": text("shared")}
    return rows.unionByName(near.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS]))


def csv(edges: DataFrame, near: DataFrame | None, path: str) -> None:
    relation_table(edges, near).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def file_names(labels: DataFrame) -> DataFrame:
    """(id, name) of labels(id, label, place): without signs that file names can't have, blanks squeezed; names that are equal in any case get a number in order of place (of id, where there is none)."""
    clean = F.substring(F.regexp_replace(F.btrim(F.regexp_replace("label", BAD_SIGNS, " ")), r"(?U)\s+", " "), 1, NAME_CHARS)
    order = "place" if "place" in labels.columns else "id"
    named = labels.select("id", F.col(order).alias("place"), F.coalesce(F.nullif(clean, F.lit("")), F.lit("untitled")).alias("name"))
    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("place"))
    return named.withColumn("n", n).select("id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("name"))


def relation_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(id, lines): each concept's relations as lines of its note, those that go out before those that come in."""
    e = have(have(edges, ("id", "description", "valid_from", "valid_to")), ("confidence",), "double")
    side = lambda own, other, arrow, n: e.select(F.col(own).alias("own"), F.col(other).alias("other"), F.lit(arrow).alias("arrow"), F.lit(n).alias("n"), "relation", "description", "confidence", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), F.col("id").alias("edge"))
    ends = side("source", "target", "→", 0).unionByName(side("target", "source", "←", 1)).join(names.select(F.col("id").alias("other"), "name"), "other", "left")
    line = F.concat(
        F.lit("- "), "arrow", F.lit(" *"), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit("* [["), F.coalesce("name", "other"), F.lit("]]"),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(""),
        F.when(F.coalesce("valid_to", F.lit("")) != "", F.concat(F.lit(" ~~(closed "), F.substring("valid_to", 1, 10), F.lit(")~~"))).otherwise(""),
        F.when(F.col("confidence").isNotNull(), F.concat(F.lit(" `"), F.format_string("%.2f", "confidence"), F.lit("`"))).otherwise(""),
    )
    listed = F.array_sort(F.collect_list(F.struct("n", "valid_from", "edge", line.alias("line"))))
    return ends.groupBy(F.col("own").alias("id")).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))


def vault(nodes: DataFrame, edges: DataFrame, topics: DataFrame | None = None, quotes: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """(path, body): a note for each concept with its topic, relations either way and quotes, a note for each topic with its concepts, and one for the gaps."""
    n = have(have(nodes, ("summary",)), ("community", "degree", "strength", "betweenness"), "double")
    names = file_names(n.select("id", "label"))
    block = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n\n"))).otherwise("")
    if topics is None:
        topics = n.sparkSession.createDataFrame([], "id int, label string, size int, summary string")
    titled = topics.join(file_names(topics.select("id", "label")).withColumnRenamed("name", "topic"), "id").select(F.col("id").alias("community"), "topic", F.col("label").alias("topic_label"), "size", F.col("summary").alias("topic_summary"))
    rows = n.join(names, "id").join(relation_lines(edges, names), "id", "left").join(titled.select("community", "topic"), "community", "left")
    if quotes is not None:
        said = quotes.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("> "), "excerpt", F.lit("\n> — "), F.coalesce("source", F.lit(""))).alias("q")))), lambda x: x["q"]), "\n\n").alias("quotes"))
        rows = rows.join(said, "id", "left")
    rows = have(rows, ("quotes",))
    plain = lambda c, zero: F.coalesce(F.col(c).cast("string"), F.lit(zero))
    front = F.concat(F.lit("---\ntype: "), "type", F.lit("\ndegree: "), plain("degree", "0"), F.lit("\nbetweenness: "), plain("betweenness", "0"), F.when(F.col("topic").isNotNull(), F.concat(F.lit('\ntopic: "[['), "topic", F.lit(']]"'))).otherwise(""), F.lit("\ntags: [factweave/"), "type", F.lit("]\n---\n\n# "), "label", F.lit("\n\n"))
    body = F.concat(front, F.when(F.coalesce("summary", F.lit("")) != "", F.concat("summary", F.lit("\n\n"))).otherwise(""), block("Relations", F.col("lines")), block("Evidence", F.col("quotes")))
    out = rows.select(F.concat(F.lit("Concepts/"), "name", F.lit(".md")).alias("path"), body.alias("body"))
    inside = n.join(names, "id").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce(F.col("strength").cast("double"), F.lit(0.0))).alias("s"), "id", F.concat(F.lit("- [["), "name", F.lit("]]")).alias("l")))), lambda x: x["l"]), "\n").alias("members"))
    head = F.concat(F.lit("---\ntype: topic\nsize: "), F.col("size").cast("string"), F.lit("\n---\n\n# "), "topic_label", F.lit("\n\n"), F.when(F.coalesce("topic_summary", F.lit("")) != "", F.concat("topic_summary", F.lit("\n\n"))).otherwise(""), F.lit("## Concepts\n\n"))
    out = out.unionByName(titled.join(inside, "community", "left").select(F.concat(F.lit("Topics/"), "topic", F.lit(".md")).alias("path"), F.concat(head, F.coalesce("members", F.lit("")), F.lit("\n")).alias("body")))
    if gaps is None:
        return out
    linked = gaps.join(names.select(F.col("id").alias("bridge_a"), F.col("name").alias("na")), "bridge_a", "left").join(names.select(F.col("id").alias("bridge_b"), F.col("name").alias("nb")), "bridge_b", "left")
    each = F.concat(F.lit("## "), "topic_a", F.lit("  ↔  "), "topic_b", F.lit("\n\nGap score "), F.col("score").cast("string"), F.lit(". What would connect "), "bridge_a", F.lit(" and "), "bridge_b", F.lit("?\n\nStart from [["), F.coalesce("na", "bridge_a"), F.lit("]] and [["), F.coalesce("nb", "bridge_b"), F.lit("]].\n"))
    note = linked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", each.alias("e")))), lambda x: x["e"]), "\n").alias("e"))
    return out.unionByName(note.select(F.lit("Gaps.md").alias("path"), F.concat(F.lit("# Gaps\n\nPairs of developed topics with little between them.\n\n"), "e").alias("body")))


def card_id(node: str) -> str:
    return "n" + sha1(node.encode()).hexdigest()[:12]


def canvas(doc: dict, names: dict[str, str] | None = None) -> str:
    """JSON Canvas of a graph document: its first topics as groups on a grid, each one's strongest concepts as cards around the first, and arrows between the cards for open relations. With names, cards are files."""
    topics = doc["topics"][:TOPICS] or [{"id": None, "label": doc["graph"]}]
    across = math.ceil(math.sqrt(len(topics)))
    groups, cards, placed = [], [], set()
    for i, topic in enumerate(topics):
        left, top = i % across * STEP[0], i // across * STEP[1]
        groups.append({"id": f"g{i}", "type": "group", "label": topic["label"], "x": left, "y": top, "width": GROUP[0], "height": GROUP[1], "color": str(i % 6 + 1)})
        own = sorted((n for n in doc["nodes"] if topic["id"] is None or n["community"] == topic["id"]), key=lambda n: -(n.get("strength") or 0))[:CARDS]
        for j, n in enumerate(own):
            turn, far = 2 * math.pi * j / len(own), RING if j else 0
            text = f"**{n['label']}**\n{n['type']}" + (f"\n\n{n['summary'][:160]}" if n.get("summary") else "")
            body = {"type": "file", "file": f"Concepts/{names[n['id']]}.md"} if names else {"type": "text", "text": text}
            cards.append({"id": card_id(n["id"]), "x": round(left + GROUP[0] / 2 + far * math.cos(turn) - CARD[0] / 2), "y": round(top + GROUP[1] / 2 + far * math.sin(turn) - CARD[1] / 2), "width": CARD[0], "height": CARD[1], **body})
            placed.add(n["id"])
    links = [{"id": e["id"], "fromNode": card_id(e["source"]), "toNode": card_id(e["target"]), "label": e["relation"].replace("_", " ")} for e in doc["edges"] if not e["valid_to"] and {e["source"], e["target"]} <= placed]
    return json.dumps({"nodes": groups + cards, "edges": links[:LINKS]}, indent=1, ensure_ascii=False)


def embedded(value) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(value, ensure_ascii=False, default=str).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'; script-src 'unsafe-inline'; connect-src 'self'"><title>@title@</title><style>
body{margin:0;font:14px system-ui,sans-serif;display:flex;height:100vh}svg{flex:1;background:#fafafa}aside{width:22em;overflow:auto;padding:1em;border-left:1px solid #ddd}
line{stroke:#bbb}line.closed{stroke-dasharray:4}circle{cursor:pointer}text{font-size:10px;pointer-events:none}input{width:100%}
</style></head><body><svg viewBox="-500 -500 1000 1000"></svg><aside><h1>@title@</h1><p id="why"></p><input type="range" id="time"><p id="when"></p><div id="about"></div></aside>
<script type="application/json" id="graph">@data@</script><script>
const doc = JSON.parse(document.getElementById("graph").textContent), svg = document.querySelector("svg"), make = (n, a, p) => { const e = document.createElementNS("http://www.w3.org/2000/svg", n); for (const k in a) e.setAttribute(k, a[k]); p.append(e); return e };
const at = {}, groups = {}; doc.nodes.forEach(n => (groups[n.community] ||= []).push(n));
Object.values(groups).forEach((g, i, all) => { const a = 2 * Math.PI * i / all.length, x = all.length > 1 ? 300 * Math.cos(a) : 0, y = all.length > 1 ? 300 * Math.sin(a) : 0; g.forEach((n, j) => { const b = 2.4 * j, r = 14 * Math.sqrt(j); at[n.id] = [x + r * Math.cos(b), y + r * Math.sin(b)] }) });
const lines = doc.edges.filter(e => at[e.source] && at[e.target]).map(e => [e, make("line", {x1: at[e.source][0], y1: at[e.source][1], x2: at[e.target][0], y2: at[e.target][1]}, svg)]);
const about = document.getElementById("about"), put = (tag, text) => { const e = document.createElement(tag); e.textContent = text; about.append(e) };
doc.nodes.forEach(n => { const c = make("circle", {cx: at[n.id][0], cy: at[n.id][1], r: 3 + Math.sqrt(n.degree || 0), fill: n.color || "#777"}, svg); make("text", {x: at[n.id][0] + 6, y: at[n.id][1]}, svg).textContent = n.label;
  c.onclick = () => { about.replaceChildren(); put("h2", n.label); put("p", n.summary || ""); doc.edges.filter(e => e.source === n.id || e.target === n.id).forEach(e => put("p", `${e.source} ${e.relation} ${e.target}: ${e.description || ""}`)); (n.passages || []).forEach(p => put("blockquote", p.excerpt)) } });
const marks = doc.time.marks, slider = document.getElementById("time"); slider.max = Math.max(0, marks.length - 1); slider.value = slider.max;
const show = () => { const t = marks[slider.value]; document.getElementById("when").textContent = t || ""; lines.forEach(([e, l]) => { const on = !t || e.valid_from <= t, shut = e.valid_to && (!t || e.valid_to <= t); l.style.display = on && (!shut || doc.open?.closed) ? "" : "none"; l.setAttribute("class", shut ? "closed" : "") }) };
if (doc.live) setInterval(async () => { const r = await fetch(`/api/events?since=${doc.last_event}`); if ((await r.json()).events?.length) location.reload() }, 2000);
slider.oninput = show; show(); document.getElementById("why").textContent = doc.open?.why || "";
</script></body></html>
"""


def page(doc: dict, title: str | None = None) -> str:
    """A page that shows a graph document and asks nothing of the network."""
    from html import escape

    return PAGE.replace("@title@", escape(title or doc["graph"])).replace("@data@", embedded(doc))
