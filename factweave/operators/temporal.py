"""Time: as-of reads, closing of edges, first sight, marks and timelines. Edges have valid_from and valid_to; a null valid_to is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(edges: DataFrame, at: Column) -> DataFrame:
    """Edges with valid_from <= at < valid_to. Nodes and mentions have no time."""
    return edges.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def current(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("valid_to").isNull())


def edges_of(edges: DataFrame, node: str | None = None, at: Column | None = None, closed: bool = False) -> DataFrame:
    """Edges of a node; an as-of time goes before the choice to include closed ones."""
    found = edges if node is None else edges.filter((F.col("source") == node) | (F.col("target") == node))
    return as_of(found, at) if at is not None else found if closed else current(found)


def fold_edges(facts: DataFrame) -> DataFrame:
    """Current edges from append-only facts(id, seq, weight, ...): the first assertion of an id gives its values, all add their weights."""
    rest = [c for c in facts.columns if c not in ("id", "seq", "weight")]
    return facts.groupBy("id").agg(F.sum("weight").alias("weight"), F.min_by(F.struct(*rest), "seq").alias("first")).select("id", "weight", "first.*")


def supersede(edges: DataFrame, closings: DataFrame) -> DataFrame:
    """Edges closed by closings(edge, seq, at, by): the first closing of an edge wins, and closed edges stay as they are."""
    first = closings.groupBy(F.col("edge").alias("id")).agg(F.min_by("at", "seq").alias("closed_at"), F.min_by("by", "seq").alias("closed_by"))
    open_ = F.col("valid_to").isNull() & F.col("closed_at").isNotNull()
    return edges.join(first, "id", "left").withColumns({"valid_to": F.when(open_, F.col("closed_at")).otherwise(F.col("valid_to")), "invalidated_by": F.when(open_, F.concat(F.lit("edge:"), "closed_by"))}).drop("closed_at", "closed_by")


def replay(steps: DataFrame) -> DataFrame:
    """Edges of a dated journal(id, at, source, relation, target, supersedes): a step ends the one it names when it begins."""
    ends = steps.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min("at").alias("valid_to"), F.min_by("id", "at").alias("by"))
    return steps.join(ends, "id", "left").withColumnRenamed("at", "valid_from").withColumn("invalidated_by", F.when(F.col("by").isNotNull(), F.concat(F.lit("edge:"), "by"))).drop("by", "supersedes")


def first_seen(edges: DataFrame) -> DataFrame:
    """(node, first_seen) over all edges, closed ones too."""
    return edges.select(F.explode(F.array("source", "target")).alias("node"), "valid_from").groupBy("node").agg(F.min("valid_from").alias("first_seen"))


def time_range(edges: DataFrame) -> DataFrame:
    """One row: the first and the last time at which something begins or ends."""
    return edges.select(F.explode(F.array("valid_from", "valid_to")).alias("at")).agg(F.min("at").alias("first"), F.max("at").alias("last"))


def time_marks(edges: DataFrame, last: int = 400) -> DataFrame:
    """The last distinct times at which something begins or ends."""
    return edges.select(F.explode(F.array("valid_from", "valid_to")).alias("at")).filter("at is not null").distinct().orderBy(F.col("at").desc()).limit(last)


def timeline(edges: DataFrame, node: str, conflicts: DataFrame | None = None, created: DataFrame | None = None) -> DataFrame:
    """(at, event, relation, source, target, id) of a concept, in order of time: first seen (its own `created`(at), or an earlier relation), relations added and closed, and conflicts(id, edge_a, edge_b, created_at)
    in which one of its relations stands."""
    own = edges_of(edges, node, closed=True)
    what = ["relation", "source", "target", "id"]
    added, closed = own.select(F.col("valid_from").alias("at"), F.lit("relation added").alias("event"), *what), own.filter("valid_to is not null").select(F.col("valid_to").alias("at"), F.lit("relation closed").alias("event"), *what)
    seen = own.agg(F.min("valid_from").alias("at")).select("at", F.lit("first seen").alias("event"), *[F.lit(None).cast("string").alias(c) for c in what])
    if created is not None:
        seen = seen.unionByName(created.select("at", F.lit("first seen").alias("event"), *[F.lit(None).cast("string").alias(c) for c in what])).groupBy("event").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in what]).select(*seen.columns)
    out = seen.unionByName(added).unionByName(closed)
    if conflicts is not None:
        ids = own.select("id").distinct()
        ours = conflicts.join(ids.withColumnRenamed("id", "edge_a"), "edge_a", "left_semi").unionByName(conflicts.join(ids.withColumnRenamed("id", "edge_b"), "edge_b", "left_semi")).dropDuplicates(["id"])
        out = out.unionByName(ours.select(F.col("created_at").alias("at"), F.lit("conflict recorded").alias("event"), F.col("verdict").alias("relation"), F.col("edge_a").alias("source"), F.col("edge_b").alias("target"), "id"))
    return out.orderBy("at", "event", "id")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count_if(F.col("valid_to").isNotNull()).alias("closed"), F.countDistinct("relation").alias("relations"))


def versions(sources: DataFrame) -> DataFrame:
    """The state of sources(uri, sha, at): unchanged where a text was there before under any uri, replaced where a later text has the uri, else current."""
    by_sha, by_uri = Window.partitionBy("sha").orderBy("at"), Window.partitionBy("uri").orderBy(F.col("at").desc())
    return sources.withColumns({"copy": F.row_number().over(by_sha) - 1, "version": F.row_number().over(by_uri)}).withColumn("state", F.when(F.col("copy") > 0, "unchanged").when(F.col("version") > 1, "replaced").otherwise("current"))
