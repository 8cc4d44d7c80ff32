"""Mixing sources to target weights by temperature (DataFrame functions only).

A source's weight is its share of all words to the power of an exponent, normalised. The exponent is the largest of two that bisection finds in [0, 1]: the one whose
weights have `entropy` times the largest possible entropy, and the one at which no source is repeated more than `repeats` times. Each source then has a budget of words: its weight
times `budget` times all words.

A budget is realised as whole passes over the source and a part of one more pass, taken in the order of a block permutation: documents fall
into about sqrt(n) blocks by a hash, blocks are ordered by a hash of source, pass and block, documents in a block by a hash of their own. Only the cut is computed, as three
numbers for each source: the block in which the budget ends and the last document in it. Whether a document is taken follows from its own hashes and these numbers, so texts are never
shuffled and the largest window over a source has sqrt(n) rows.

Edge cases: null and empty texts have no words, and go with their source's cut; a null source is a source of its own; a source without words has weight 0
and is taken as often as whole passes of weightless sources ask: once; rows with the same doc_id share a decision; null doc_ids hash as ''; an empty table gives no rows; other columns are kept by `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.util import SPACES, materialise

SPACE = r"[\x20\x09-\x0D]+"
ENTROPY, REPEATS, BUDGET, SEED = 0.95, 2.0, 1.0, "mix"
#: Levels of bisection that one query answers, and queries.
LEVELS, ROUNDS = 6, 6
#: Sources whose three numbers are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    full = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(full == "", 0).otherwise(F.size(F.split(full, SPACE))).cast("long")


def source_key(source: Column) -> Column:
    """'=' and the source; a null source, which is one of its own, is '-'."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", source_key(F.col("source")).alias("source"), n_words(F.col("text")).alias("n_tokens"), hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))


def bisect(shares: DataFrame, meets: Column) -> float:
    """The smallest exponent in [0, 1] that meets the (monotone) condition on entropy h and repetition r, to 2^-36. Each query evaluates all
    midpoints that the next LEVELS steps of bisection could ask for; its result is one row for each."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        n = 1 << LEVELS
        grid = [lo + (hi - lo) * i / n for i in range(1, n)]
        each = shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("x")).groupBy("x").agg(F.sum(F.pow("p", F.col("x"))).alias("z"), F.sum(F.pow("p", F.col("x")) * F.log("p")).alias("s"), F.max(F.pow("p", F.col("x") - 1)).alias("m"))
        met = {r.x for r in each.select("x", (F.log("z") - F.col("x") * F.col("s") / F.col("z")).alias("h"), (F.col("m") / F.col("z")).alias("r")).filter(meets).collect()}
        first = next((i for i, x in enumerate(grid, 1) if x in met), n)
        lo, hi = lo + (hi - lo) * (first - 1) / n, lo + (hi - lo) * first / n
    return hi


def weights(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> tuple[DataFrame, float]:
    """sources(source, tokens, docs) with share and weight, and the exponent."""
    total, n = sources.filter("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    shares = sources.withColumn("p", F.col("tokens") / F.lit(float(total or 1)))
    some = materialise(shares.filter("p > 0").select("p"), "shares")
    power = 1.0
    if n > 1:
        power = max(bisect(some, F.col("h") <= entropy * math.log(n)), bisect(some, F.col("r") * budget <= repeats))
    z = some.agg(F.sum(F.pow("p", F.lit(power)))).first()[0] or 1.0
    return shares.withColumn("weight", F.when(F.col("p") > 0, F.pow("p", F.lit(power)) / z).otherwise(0.0)).withColumn("tokens_out", F.floor(F.col("weight") * F.lit(float(total or 0)) * budget).cast("long")), power


def order(source: Column, passes: Column, what: Column) -> Column:
    return hash60(F.concat_ws(":", F.lit(SEED), source, passes.cast("string"), what.cast("string")))


def placed(rows: DataFrame) -> DataFrame:
    """Adds block_at and doc_at, the places of a row's block and of the row in its block, in the pass that the budget ends in."""
    block = F.pmod(F.col("key"), F.col("blocks"))
    return rows.withColumn("block_at", order(F.col("source"), F.col("passes"), block)).withColumn("doc_at", order(F.col("source"), F.col("passes"), F.col("key")))


def plan(found: DataFrame, **targets) -> DataFrame:
    """(source, weight, blocks, passes, last_block, last_doc) for found = sized(docs), materialised."""
    sources = materialise(found.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    goal, _ = weights(sources, **targets)
    goal = goal.withColumns({"blocks": F.ceil(F.sqrt("docs")).cast("long"), "passes": F.when(F.col("tokens") > 0, F.floor(F.col("tokens_out") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(1).cast("long")})
    goal = goal.withColumn("left", F.when(F.col("tokens") > 0, F.col("tokens_out") - F.col("passes") * F.col("tokens")).otherwise(0))
    goal = materialise(goal.select("source", "weight", "blocks", "passes", "left"), "goal")
    at = placed(joined(found, goal))
    # the block in which the rest ends: the first whose running sum is over it; sqrt(n) blocks for each source
    blocks = at.groupBy("source", "left", "block_at").agg(F.sum("n_tokens").alias("n"))
    run = blocks.selectExpr("*", "sum(n) over (partition by source order by block_at) as upto")
    cut = run.filter("upto > left").groupBy("source").agg(F.min("block_at").alias("last_block"), F.min(F.struct("block_at", (F.col("left") - F.col("upto") + F.col("n")).alias("room")))["room"].alias("room"))
    cut = materialise(cut, "cut")
    # the last document in it; rows at the same place are taken together or not at all
    inside = joined(at, cut).filter("block_at = last_block").selectExpr("source", "doc_at", "room", "sum(n_tokens) over (partition by source order by doc_at) as upto")
    last = inside.filter("upto <= room").groupBy("source").agg(F.max("doc_at").alias("last_doc"))
    return materialise(goal.join(cut.select("source", "last_block"), "source", "left").join(last, "source", "left"), "plan")


def joined(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """A row's source is looked up in a table of sources: broadcast while that has a bounded number of rows."""
    return rows.join(F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source, "source")


def copies() -> Column:
    """How often a row is taken: the whole passes, and once more up to the cut."""
    more = (F.col("block_at") < F.col("last_block")) | ((F.col("block_at") == F.col("last_block")) & (F.col("doc_at") <= F.coalesce("last_doc", F.lit(-1))))
    return (F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")).alias("copies")


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The rows of docs, all columns, each as often as it is taken."""
    cuts = plan(materialise(sized(docs), "sized"), **targets)
    # the table's own columns stay under one name, so that none clashes with those made here
    rows = docs.select(F.struct("*").alias("row")).withColumns({"source": source_key(F.col("row.source")), "key": hash60(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))})
    out = placed(joined(rows, cuts)).select("row", copies()).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sized")
    at = placed(joined(found, plan(found)))
    return at.select("doc_id", F.when(F.col("source") != "-", F.substring("source", 2, 1 << 30)).alias("source"), "n_tokens", F.round("weight", 6).alias("weight"), copies(), "block_at", "doc_at")


#: Twenty-odd sources: bisection by a recursive query, windows over whole sources.
OP3_SQL = f"""
with recursive d as (
  select doc_id, coalesce('=' || source, '-') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents
), s as (
  select source, sum(n_tokens)::bigint as tokens, count(*) as docs from d group by source
), t as (
  select sum(tokens)::double as total, count(*) as n from s where tokens > 0
), p as (
  select tokens / total as p from s, t where tokens > 0
), step as (
  select 0 as i, 0.0::double as lo_h, 1.0::double as hi_h, 0.0::double as lo_r, 1.0::double as hi_r
  union all
  select i + 1,
    case when h <= {ENTROPY} * (select ln(n) from t) then lo_h else mid_h end, case when h <= {ENTROPY} * (select ln(n) from t) then mid_h else hi_h end,
    case when r * {BUDGET} <= {REPEATS} then lo_r else mid_r end, case when r * {BUDGET} <= {REPEATS} then mid_r else hi_r end
  from (
    select *, (select ln(sum(pow(p, mid_h))) - mid_h * sum(pow(p, mid_h) * ln(p)) / sum(pow(p, mid_h)) from p) as h,
      (select max(pow(p, mid_r - 1)) / sum(pow(p, mid_r)) from p) as r
    from (select *, (lo_h + hi_h) / 2 as mid_h, (lo_r + hi_r) / 2 as mid_r from step where i < {LEVELS * ROUNDS})
  )
), x as (
  select greatest(hi_h, hi_r) as x from step where i = {LEVELS * ROUNDS}
), w as (
  select source, tokens, ceil(sqrt(docs))::bigint as blocks, case when tokens > 0 then pow(tokens / total, x) / (select sum(pow(p, x)) from p) else 0 end as weight, total from s, t, x
), g as (
  select source, weight, blocks, tokens, floor(weight * total * {BUDGET})::bigint as goal from w
), q as (
  select *, case when tokens > 0 then goal // tokens else 1 end as passes, case when tokens > 0 then goal % tokens else 0 end as rest from g
), a as (
  select d.*, weight, passes, rest,
    ('0x' || substr(md5('{SEED}:' || source || ':' || passes || ':' || (key % blocks)), 1, 15))::bigint as block_at,
    ('0x' || substr(md5('{SEED}:' || source || ':' || passes || ':' || key), 1, 15))::bigint as doc_at
  from d join q using (source)
), u as (
  select *, sum(n_tokens) over (partition by source order by block_at, doc_at) as upto from a
)
select doc_id, case when source <> '-' then substr(source, 2) end as source, n_tokens, round(weight, 6) as weight, (passes + (upto <= rest)::bigint)::bigint as copies, block_at, doc_at from u
"""
