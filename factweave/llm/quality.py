"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base features come from whole texts. On top of the base rules, each rule (symbol rate, repeated-line rate, repeated-word
rate, mean word length) gets a cutoff for each stratum (language): labelled good documents of a holdout vote on a grid of
cutoffs from lenient to strict; a cutoff is certified while the exact binomial tail P(Bin(n, alpha) <= k) for its k false
rejections among n stays at or under delta / (strata x rules) (fixed-sequence testing in a rule, Bonferroni over rules and strata). alpha is the share of a
stratum's good documents that all rules together may reject, dealt out evenly among the rules. Of the certified cutoffs the one with the largest gain wins: bad documents
rejected less `COST` times the good ones; a rule without a gain rejects nothing. Strata without enough labels certify nothing
and so reject nothing beyond the base rules.

Edge cases: a null or empty text has no words (all counts 0, base_failed true); null doc_id or lang are kept as they are, a null
lang is the stratum 'und'; repeated rows each give a row; an empty table gives no rows; columns other than doc_id, text, lang are ignored;
labels that are null don't vote; a doc_id votes once however many label rows and documents have it, with the largest of its documents' values (by language, then rule), and not at all if its
labels disagree. The bound takes the labelled documents as independent: near copies under different doc_ids vote each, so label a corpus after near-duplicates are gone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.util import SPACES, materialise

SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
#: Bad documents that one good document's rejection must at least bring.
COST = 10
RULES = ("symbol_rate", "dup_line_rate", "repeat_rate", "long_words", "short_words")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column, n: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the array w of n words."""
    window = 5

    def covered(h: Column) -> Column:
        """Positions of repeated windows cover up to `window` words each; overlaps count once."""
        # the sorted (hash, position) pairs put equal windows side by side
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(
            F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"])),
            lambda p: F.coalesce(F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(window), F.get(p, i + 1) - x), F.lit(window)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
        ))

    # windows of 1, 2 and 4 words are hashed in passes; a window of five words is its first four and its last one
    each = F.transform(w, lambda x: F.xxhash64(x))
    pair = lambda a, by: F.zip_with(a, F.slice(a, by + 1, n), lambda x, y: F.xxhash64(x, y))
    hashes = let(each, lambda a: let(pair(a, 1), lambda c: let(pair(c, 2), lambda b: F.slice(F.zip_with(b, F.slice(a, 5, n), lambda x, y: F.xxhash64(x, y)), 1, n - 4))))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(found)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    full = F.btrim(t, F.lit(SPACES))
    symbols = t
    for x in SYMBOLS:
        symbols = F.replace(symbols, F.lit(x), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # one let per text: the word array is made once for all that needs it
    by_words = let(F.split(full, SPACE), lambda a: let(F.when(full == "", F.lit(0)).otherwise(F.size(a)), lambda n: F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join(a, "")).cast("long").alias("word_chars"), repeat_words(a, n).alias("n_repeat_words"))))
    out = docs.select(
        "doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), by_words.alias("w"),
        (F.length(t) - F.length(symbols)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return out.select("doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates(df: DataFrame) -> DataFrame:
    """The rules' values in steps of a thousandth, higher being worse."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    step = lambda x: F.least(F.lit(1000), F.floor(x)).cast("int")
    return df.withColumns({
        "symbol_rate": step(1000 * F.col("n_symbols") / chars),
        "dup_line_rate": step(1000 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeat_rate": step(1000 * F.col("n_repeat_words") / words),
        "long_words": step(20 * F.col("word_chars") / words),
        "short_words": step(1000 / F.greatest(F.col("word_chars") / words, F.lit(1.0))),
    })


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from 20 on; below, the sum itself."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    small, total = F.lit(0.0), 0.0
    for i in range(2, 20):
        total += math.log(i)
        small = F.when(n == i, F.lit(total)).otherwise(small)
    return F.when(n >= 20, series).otherwise(small)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding. Up to the mean the terms are summed downward from the one at k, over it those above k are summed upward and taken from 1, each by its ratio
    to the one before; 14 standard deviations away they are under e^-90 of the first, so about sqrt(n) terms are made whatever k is."""
    q = 1.0 - p
    low, far = k <= n * F.lit(p), F.ceil(14 * F.sqrt(n * F.lit(p * q)) + 50).cast("long")
    first = F.when(low, k).otherwise(k + 1)
    at = F.exp(log_factorial(n) - log_factorial(first) - log_factorial(n - first) + first * F.lit(math.log(p)) + (n - first) * F.lit(math.log(q)))
    one, none = F.lit(1).cast("long"), F.array().cast("array<long>")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(ratio):
        def step(a: Column, i: Column) -> Column:
            t = a["t"] * ratio(i)
            return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

        return step

    down = F.aggregate(F.when(k >= 1, F.sequence(k, F.greatest(one, k - far), -one)).otherwise(none), start, add(lambda i: i / (n - i + 1) * F.lit(q / p)), lambda a: a["s"])
    up = F.aggregate(F.when(k + 2 <= n, F.sequence(k + 2, F.least(n, k + far), one)).otherwise(none), start, add(lambda i: (n - i + 1) / i * F.lit(p / q)), lambda a: a["s"])
    return F.when(k >= n, F.lit(1.0)).when(low, F.least(F.lit(1.0), at * down)).otherwise(F.greatest(F.lit(0.0), 1 - at * up))


def certify(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(lang, rule, cutoff): documents with a value over the cutoff are rejected. labelled: lang, good (0/1) and the rules' columns."""
    long = labelled.select("lang", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x")).select("lang", "good", "x.rule", "x.v")
    # at most 1001 steps for each rule and language from here on, however many documents there are
    steps = long.groupBy("lang", "rule", "v").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    by = "partition by lang, rule"
    steps = steps.selectExpr(
        "lang", "rule", "v as cutoff",
        f"coalesce(sum(good) over ({by} order by v desc rows between unbounded preceding and 1 preceding), 0) as k",
        f"coalesce(sum(bad) over ({by} order by v desc rows between unbounded preceding and 1 preceding), 0) as caught",
        f"sum(good) over ({by}) as n",
    )
    tests = steps.select("lang").distinct().agg((F.count("*") * len(RULES)).alias("m"))
    tested = steps.join(F.broadcast(tests)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES))).withColumn("ok", F.col("p") <= F.lit(delta) / F.col("m"))
    # in order from lenient to strict, all tests up to the cutoff must hold; the one with the largest gain stays
    passed = tested.selectExpr("*", f"min(ok) over ({by} order by cutoff desc) as held").filter(f"held and caught > {COST} * k")
    best = passed.selectExpr("*", f"row_number() over ({by} order by caught - {COST} * k desc, cutoff desc) as r").filter("r = 1")
    return best.select("lang", "rule", "cutoff", "k", "n", "caught", "p")


def rules_from(features_: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs from the labelled documents among those with features; only documents that pass the base rules vote."""
    votes = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("good"), F.max("quality").alias("most")).filter("good = most")
    each = rates(features_.filter(~base_failed())).join(votes, "doc_id").groupBy("doc_id").agg(F.max(F.struct("lang", "good", *RULES)).alias("v"))
    return certify(each.select("v.*"), alpha, delta)


def apply_rules(features_: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed, kept and the first rule that rejects. cutoffs: a row for each language and rule at most, so it is small;
    it is pivoted to a row for each language."""
    wide = cutoffs.groupBy("lang").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    x = rates(features_).join(wide, "lang", "left").withColumn("base_failed", base_failed())
    reason = F.coalesce(F.when(F.col("base_failed"), "base"), *[F.when(F.col(r) > F.col(f"cut_{r}"), r) for r in RULES])
    return x.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Features, base rules and certified cutoffs for every row of docs."""
    found = materialise(features(docs), "quality")
    cutoffs = materialise(rules_from(found, labels, alpha, delta), "cutoffs")
    return apply_rules(found, cutoffs)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")
