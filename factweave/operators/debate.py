"""Debate: evidence for and against a concept, candidates for contradictions, and conflicts already recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relations that support, that contradict, that oppose each other, and words that negate.
SUPPORT = ("supports", "confirms", "evidence_for", "supported_by", "demonstrates", "shows", "validates")
CONTRA = ("contradicts", "refutes", "disputes", "conflicts_with", "undermines", "challenges", "evidence_against", "contradicted_by")
OPPOSITES = (
    (("supports", "confirms", "validates"), CONTRA),
    (("increases", "raises", "improves", "enables", "causes", "promotes"), ("decreases", "reduces", "lowers", "worsens", "prevents", "blocks", "inhibits")),
    (("is", "is_a", "includes", "has"), ("is_not", "excludes", "lacks")),
)
NEGATIONS = (" not ", " no ", " never ", "n't ", " without ", " fails to ", " cannot ")


def negated(description: Column) -> Column:
    text = F.concat(F.lit(" "), F.lower(F.coalesce(description, F.lit(""))), F.lit(" "))
    out = F.lit(False)
    for n in NEGATIONS:
        out = out | F.contains(text, F.lit(n))
    return out


def opposed(ra: Column, rb: Column) -> Column:
    out = F.lit(False)
    for left, right in OPPOSITES:
        out = out | (ra.isin(*left) & rb.isin(*right)) | (rb.isin(*left) & ra.isin(*right))
    return out


def side(relation: Column) -> Column:
    """for, against, or null."""
    return F.when(relation.isin(*SUPPORT), "for").when(relation.isin(*CONTRA), "against")


def sides(edges: DataFrame) -> DataFrame:
    """(target, supports, contradicts) over all edges."""
    s = side(F.col("relation"))
    return edges.groupBy("target").agg(F.count_if(s == "for").alias("supports"), F.count_if(s == "against").alias("contradicts")).filter("supports + contradicts > 0")


#: Ways in which two relations can oppose each other: rows of OPPOSITES, and one description negated.
WAYS = len(OPPOSITES) + 1


def sided(edges: DataFrame) -> DataFrame:
    """Current stated edges by (x, y, c, s): their two concepts, a way to oppose and their side in it. Edges without a description aren't negated nor its opposite."""
    now = edges.filter("valid_to is null and method <> 'cooccurrence'").select("id", "relation", "description", "valid_from", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"))
    classes = [F.struct(F.lit(f"{i}").alias("c"), F.lit(s).alias("s"), F.col("relation").isin(*names).alias("m")) for i, both in enumerate(OPPOSITES) for s, names in zip("lr", both, strict=True)]
    neg = F.struct(F.concat(F.lit("="), "relation").alias("c"), F.when(negated(F.col("description")), "l").otherwise("r").alias("s"), (F.coalesce("description", F.lit("")) != "").alias("m"))
    return now.withColumn("k", F.explode(F.filter(F.array(*classes, neg), lambda k: k["m"]))).select("id", "relation", "valid_from", "x", "y", "k.c", "k.s")


def candidates(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(edge_a, edge_b, relation_a, relation_b) of current stated edges on the same two concepts that oppose each other, in order of the pair and (valid_from, id). Only opposed
    classes meet: edges are joined on the pair and on the way they oppose, so agreeing edges of a popular pair never do.

    With a limit an edge meets only the first `limit` edges of the other side: of the first `limit` candidates in order each is among these, as a pair's own candidates come in order of both. So a pair of concepts
    with n edges gives n times `limit` rows at most; `opposed_counts` tells how many there are."""
    rows = sided(edges)
    if limit is not None:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("x", "y", "c", "s").orderBy("valid_from", "id"))).filter(F.col("r") <= limit).drop("r")
    left, right = (rows.filter(F.col("s") == s).select("x", "y", "c", F.struct("valid_from", "id", "relation").alias(s)) for s in "lr")
    met = left.join(right, ["x", "y", "c"]).select("x", "y", F.least("l", "r").alias("p"), F.greatest("l", "r").alias("q")).filter("p.id <> q.id").distinct()
    out = met.select("x", "y", F.col("p.id").alias("edge_a"), F.col("q.id").alias("edge_b"), F.col("p.relation").alias("relation_a"), F.col("q.relation").alias("relation_b"), F.col("p.valid_from").alias("at_a"), F.col("q.valid_from").alias("at_b"))
    return out if limit is None else out.orderBy("x", "y", "at_a", "edge_a", "at_b", "edge_b").limit(limit)


def opposed_counts(edges: DataFrame) -> DataFrame:
    """(x, y, c, left, right): how many edges of a pair stand on either side of each way to oppose; left times right of them oppose each other. One row for any number of edges."""
    return sided(edges).groupBy("x", "y", "c").agg(F.count_if(F.col("s") == "l").alias("left"), F.count_if(F.col("s") == "r").alias("right")).filter("left > 0 and right > 0")


def unreviewed(found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Candidates without those that conflicts(edge_a, edge_b) has in either order; apply a limit to the candidates before this."""
    known = conflicts.select(F.least("edge_a", "edge_b").alias("p"), F.greatest("edge_a", "edge_b").alias("q")).distinct()
    return found.withColumns({"p": F.least("edge_a", "edge_b"), "q": F.greatest("edge_a", "edge_b")}).join(known, ["p", "q"], "left_anti").drop("p", "q")


def sure(confidence: Column) -> Column:
    """A confidence to rank by: 0.5 where it is missing or zero."""
    return F.when(confidence.isNull() | (confidence == 0), 0.5).otherwise(confidence)


def viewed(edges: DataFrame, node: str, sources: DataFrame | None = None) -> DataFrame:
    """A concept's edges with direction, the other end, and the title of the source that they come from."""
    own = edges.filter((F.col("source") == node) | (F.col("target") == node)).withColumn("direction", F.when(F.col("source") == node, "out").otherwise("in"))
    own = own.withColumn("other", F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")))
    if sources is None:
        return own
    return own.join(sources.select(F.col("id").alias("source_id"), F.col("title").alias("from_source")), "source_id", "left")


def show(edges: DataFrame, node: str, limit: int = 50, sources: DataFrame | None = None) -> DataFrame:
    """A concept's relations in either direction, most confident first, up to `limit` each. Ties go by relation, then by when they began."""
    first = [F.col(c) for c in ("valid_from", "id") if c in edges.columns]
    order = Window.partitionBy("direction").orderBy(sure(F.col("confidence")).desc(), "relation", *first)
    return viewed(edges, node, sources).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
