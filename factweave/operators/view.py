"""The weighted view of a graph without directions, and its measures. Pairs are (a, b, weight) with a < b; both() lists them from either end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.keys import truthy
from factweave.plans.storage import spread

#: How much a stated relation weighs, and the largest number of concepts of a passage that counts as nearness.
STATED, CROWD = 4.0, 40


def relation_pairs(edges: DataFrame) -> DataFrame:
    """Edges' weights by pair: the window score of co-occurrence, else four times the confidence (1 where it is missing or zero)."""
    scale = F.when(F.col("method") == "cooccurrence", F.col("weight")).otherwise(STATED * truthy(F.col("confidence"), 1.0))
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), scale.alias("weight"))
    return spread(pairs, "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def proximity(mentions: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b, shared) of concepts mentioned in the same chunk, for chunks with 2 to `crowd` concepts. The limit bounds each chunk's pairs, so they are
    made inside its own array."""
    each = spread(mentions.select("chunk_id", "node_id"), "chunk_id").distinct()
    sized = each.filter("chunk_id is not null and node_id is not null").withColumn("n", F.count("*").over(Window.partitionBy("chunk_id"))).filter(f"n between 2 and {crowd}")
    groups = sized.groupBy("chunk_id").agg(F.array_sort(F.collect_list("node_id")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.lit(crowd)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return spread(groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b"), "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def chosen(edges: DataFrame, nodes: DataFrame | None = None, relations: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Edges of these relations, and only those whose ends are both among nodes(id, type) of these types."""
    found = edges if not relations else edges.filter(F.col("relation").isin(*relations))
    if nodes is None:
        return found
    kept = nodes if not types else nodes.filter(F.col("type").isin(*types))
    for end in ("source", "target"):
        found = found.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    return found


def build_view(edges: DataFrame, mentions: DataFrame | None = None, nodes: DataFrame | None = None, relations: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(a, b, weight) of edges, and of nearness where mentions(chunk_id, node_id) are given; choosing relations leaves nearness out."""
    pairs = relation_pairs(chosen(edges, nodes, relations, types))
    if mentions is None or relations:
        return pairs
    if nodes is not None:
        kept = nodes if not types else nodes.filter(F.col("type").isin(*types))
        mentions = mentions.join(kept.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    pairs = pairs.unionByName(proximity(mentions).select("a", "b", F.col("shared").cast("double").alias("weight")))
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def both(pairs: DataFrame) -> DataFrame:
    """(x, y, weight) from either end."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "weight"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))).alias("e")).select("e.*")


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree, strength, degree_norm)."""
    each = both(pairs).groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    top = each.agg(F.max("degree").alias("top"))
    return each.join(F.broadcast(top)).withColumn("degree_norm", F.round(F.col("degree") / F.col("top"), 4)).drop("top")


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges, each edge counted."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, q: weight inside groups less what their strengths predict. labels(node, label)."""
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    marked = pairs.join(la, "a").join(lb, "b")
    inside = marked.groupBy(F.col("la").alias("label")).agg(F.sum(F.when(F.col("la") == F.col("lb"), 2 * F.col("weight")).otherwise(0.0)).alias("inside"))
    total = both(pairs).join(labels.withColumnRenamed("node", "x"), "x").groupBy("label").agg(F.sum("weight").alias("total"))
    m2 = pairs.agg((2 * F.sum("weight")).alias("m2"))
    return total.join(inside, "label", "left").join(F.broadcast(m2)).agg(F.round(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m2") - F.pow(F.col("total") / F.col("m2"), 2)), 4).alias("q"))


def diversity(q: float, share: float) -> str:
    """The state of a graph from its modularity and its largest topic's share."""
    if q < 0.2 or share > 0.6:
        return "biased"
    return "focused" if q < 0.4 else "diversified" if q < 0.65 else "dispersed"


def community_links(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(la, lb, observed) between different groups."""
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    return pairs.join(la, "a").join(lb, "b").filter("la <> lb").groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(F.sum("weight").alias("observed"))


def structural_gaps(pairs: DataFrame, labels: DataFrame, top: int = 5, least: int = 3, groups: int = 12, centrality: DataFrame | None = None) -> DataFrame:
    """(la, lb, score, observed, expected, smaller) of the largest groups with at most half the links that their strengths predict, and with centrality(node, betweenness, degree) each side's three most central
    members as `bridge_a` and `bridge_b`. Groups are named in order of size, then of their first member; at most `groups` of them are compared, which bounds the pairs."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    strength = both(pairs).join(labels.withColumnRenamed("node", "x"), "x").groupBy("label").agg(F.sum("weight").alias("volume"))
    known = sizes.join(strength, "label").filter(F.col("size") >= least).orderBy(F.col("size").desc(), "first").limit(groups)
    m2 = pairs.agg((2 * F.sum("weight")).alias("m2"))
    one, two = (known.select(F.col("label").alias(f"l{x}"), F.col("size").alias(f"size_{x}"), F.col("volume").alias(f"volume_{x}")) for x in "ab")
    met = one.join(F.broadcast(two), F.col("la") < F.col("lb")).join(F.broadcast(m2)).join(community_links(pairs, labels), ["la", "lb"], "left")
    expected = F.col("volume_a") * F.col("volume_b") / F.col("m2")
    scored = met.withColumn("expected", expected).withColumn("observed", F.coalesce("observed", F.lit(0.0))).withColumn("raw", F.greatest(F.lit(0.0), 1 - F.col("observed") / F.col("expected"))).filter("expected > 0 and raw >= 0.5")
    out = scored.select("la", "lb", F.round("raw", 3).alias("score"), F.round("observed", 2).alias("observed"), F.round("expected", 2).alias("expected"), F.least("size_a", "size_b").alias("smaller"))
    order = ((-F.col("score") * F.log(2 + F.col("smaller"))), "la", "lb")
    first = out.orderBy(*order).limit(top)
    if centrality is None:
        return first
    rank = Window.partitionBy("label").orderBy(F.col("betweenness").desc(), F.col("degree").desc(), "node")
    best = labels.join(centrality, "node").withColumn("r", F.row_number().over(rank)).filter("r <= 3").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("best"))
    for x in "ab":
        first = first.join(best.select(F.col("label").alias(f"l{x}"), F.col("best").alias(f"bridge_{x}")), f"l{x}", "left")
    return first.orderBy(*order)


def bridges(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, foreign): nodes with neighbours in other groups than their own."""
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "xy")
    return both(pairs).join(la, "x").join(lb, "y").filter("lx <> ly").groupBy(F.col("x").alias("node")).agg(F.countDistinct("ly").alias("foreign"))


def match_groups(groups: DataFrame, reports: DataFrame) -> DataFrame:
    """(label, report, jaccard): for each group(label, node) the report(report, node) with most in common, from one half on; the first of equals."""
    size = lambda df, key: df.groupBy(key).agg(F.count("*").alias(f"n_{key}"))
    common = groups.join(reports, "node").groupBy("label", "report").agg(F.count("*").alias("n"))
    scored = common.join(size(groups, "label"), "label").join(size(reports, "report"), "report").withColumn("jaccard", F.col("n") / (F.col("n_label") + F.col("n_report") - F.col("n"))).filter("jaccard >= 0.5")
    first = Window.partitionBy("label").orderBy(F.col("jaccard").desc(), "report")
    return scored.withColumn("r", F.row_number().over(first)).filter("r = 1").select("label", "report", "jaccard")


def shared_neighbours(pairs: DataFrame, a, b) -> DataFrame:
    ends = both(pairs)
    return ends.filter(F.col("x") == a).select(F.col("y").alias("node")).intersect(ends.filter(F.col("x") == b).select(F.col("y").alias("node")))
