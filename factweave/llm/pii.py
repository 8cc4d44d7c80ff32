"""Personal data by weak supervision (DataFrame functions on the path of all rows).

Candidates are the base patterns' spans and looser forms of the same four kinds: spelled-out addresses, IPv6, digit groups of a card's length and national phone numbers.
Five labelers vote on each candidate (1 yes, -1 no, 0 abstains): the base pattern, a validity check, a gazetteer, words of context
before the span, and the span's surroundings. Expectation-maximisation estimates each labeler's reliability for each kind from the counts of vote
patterns (at most 4 * 3^5, however large the corpus). A logistic classifier is then fitted to its soft labels. It doesn't see the votes, only traits of the span and of its context in a few
values each (length, signs inside, share of digits, what stands before and after it, context words near it), each for its kind, again from counts (at most 4 * 3^5 * 2304 rows, of which
text fills some hundreds). A candidate that no base span overlaps becomes a span if the classifier gives it over one half; base spans always stay.

Edge cases: null and empty texts have no spans; null doc_ids are kept; repeated rows each give a row; very long digit runs and words are matched in linear time
(possessive quantifiers); of overlapping added spans of one kind the first stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.quality import let
from factweave.llm.util import materialise

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no run of characters is tried from each of its places.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # a run starts where no digit, or digit and sign, is before it; runs of fewer than 13 digits never pass and need no place
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|0?[0-9]{2,4})[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
}
#: Each match of a kind's patterns holds one of these, so a text without them has no candidate of the kind.
QUICK = {"email": r"@|[\[({ ]dot[\])} ]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|[0-9)][ ./-][0-9]{3}"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TAILS = "com org net edu gov int info biz io de fr es it uk eu ch at nl be us ca mx ar br"
#: Context words by kind, in English, German, French and Spanish; and words that tell against all kinds.
CONTEXT = {
    "email": r"e-?mail|mail|correo|courriel|contact|kontakt|contacto|write to|reach|schreib",
    "ip": r"\bip\b|address|host|server|client|login|connect|adresse|servidor",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|payment|paid",
    "phone": r"phone|tel\b|tel[.:]|call|fax|mobile|cell|telefon|t[eé]l[eé]|anruf|llam|appel",
}
AGAINST = r"isbn|issn|\bdoi\b|version|\bv\.|order|invoice|serial|section|chapter|page|build"
HIT = "struct<s:bigint,e:bigint,hit:string,before:string,after:string>"
#: Characters of context on either side of a span, up to the neighbouring matches of its pattern.
CONTEXT_CHARS = 80
VOTES = ("pattern", "valid", "gazetteer", "context", "around")
#: Features of a span and what is around it, with the number of their values: length, signs inside, digits' share, what is before and after it, context words near it.
TRAITS = {"long": 4, "signs": 3, "digit": 4, "ahead": 4, "behind": 4, "near": 3}


def running(lengths: Column, block: int = 256) -> Column:
    """Sums of array<bigint> lengths up to and with each entry: within blocks first, then over the blocks, so that no long array is built entry by entry."""
    none = F.array().cast("array<bigint>")
    state = "struct<s:bigint,out:array<bigint>>"
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out")).cast(state)
    plain = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("s"), none.alias("out")).cast(state), step, lambda a: a["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda i: plain(F.slice(lengths, i * block + 1, F.lit(block))))
    by_block = let(blocks, lambda w: let(plain(F.transform(w, lambda x: F.element_at(x, -1))), lambda t: F.flatten(F.transform(w, lambda x, i: F.transform(x, lambda y: y + F.when(i > 0, F.get(t, i - 1)).otherwise(0))))))
    return F.when(F.size(lengths) == 0, none).otherwise(F.when(F.size(lengths) <= block, plain(lengths)).otherwise(by_block))


def hits(t: Column, pattern: str) -> Column:
    """(s, e, hit, before, after) of a pattern's matches, in code points: the pieces between matches and the matches themselves add up. The context comes from these pieces, as
    looking it up by its place would walk through the text for each match."""
    none = F.array().cast(f"array<{HIT}>")

    def placed(h: Column) -> Column:
        ends = lambda p: running(F.transform(h, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long")))
        pieces = lambda p: let(ends(p), lambda e: F.transform(h, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("s"), F.get(e, i).alias("e"), x.alias("hit"), F.substring(F.get(p, i), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), F.substring(F.get(p, i + 1), 1, CONTEXT_CHARS).alias("after"))))
        return F.when(F.size(h) == 0, none).otherwise(let(F.split(t, pattern, -1), pieces))

    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), placed)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    """What the contract asks of a base match."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(hit), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def sign(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0).cast("int")


def votes(kind: str, c: Column, base: Column) -> list[Column]:
    """One column for each labeler."""
    hit, before = c["hit"], F.lower(F.substring(c["before"], -40, 40))
    beside = F.substring(c["after"], 1, 1)
    d = digits(hit)
    checks = {
        "email": (F.lower(hit).rlike(r"(?:\.|dot[\])}]? ?)[a-z]{2,10}$"), None),
        "ip": (hit.contains(":") | valid("ip", hit), None),
        "card": (F.call_function("luhn_check", d) & F.length(d).between(13, 19), None),
        "phone": (F.length(d).between(9, 15), None),
    }
    lists = {
        "email": sign(F.lower(hit).rlike(rf"[^a-z](?:{TAILS.replace(' ', '|')})$"), F.lit(False)),
        "ip": sign(hit.rlike(r"^(?:1?[0-9]?[1-9]|1?[1-9]0|2[01][0-9]|22[0-3])\."), hit.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\.")),
        "card": sign(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), d.rlike("^[0189]")),
        "phone": sign(hit.rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|7|8[1246]|9[0-9])"), F.lit(False)),
    }
    return [
        sign(base), sign(*checks[kind]), lists[kind],
        sign(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)),
        # letters or digits right after the span: a part of something longer
        sign(F.lit(False), beside.rlike(r"[A-Za-z0-9_=/]")),
    ]


def traits(kind: str, c: Column) -> list[Column]:
    """One small number for each of TRAITS."""
    hit = c["hit"]
    place = lambda x, *bounds: sum((x > b).cast("int") for b in bounds)
    around = F.lower(F.concat(c["before"], F.lit(" "), c["after"]))
    sort = lambda x: F.when(x == "", 0).when(x.rlike(r"[A-Za-z0-9_]"), 1).when(x.rlike(r"\s"), 2).otherwise(3)
    ahead, behind = F.substring(c["before"], -1, 1), F.substring(c["after"], 1, 1)
    return [
        place(F.length(hit), 10, 15, 25), place(F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), 1, 4), place(4 * F.length(digits(hit)) / F.greatest(F.length(hit), F.lit(1)), 0.5, 2, 3.5),
        sort(ahead), sort(behind), F.when(around.rlike(AGAINST), 2).when(around.rlike(CONTEXT[kind]), 1).otherwise(0),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands: (kind, k, s, e, base, five votes, six traits) of each row of docs(doc_id, text)."""
    t = F.col("t")

    def of(kind: str) -> Column:
        k = KINDS.index(kind)

        def made(c: Column, base: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e"), base.alias("base"), *[v.alias(n) for n, v in zip(VOTES, votes(kind, c, base), strict=True)], *[v.cast("int").alias(n) for n, v in zip(TRAITS, traits(kind, c), strict=True)])

        strict = F.transform(hits(t, BASE[kind]), lambda c: made(c, valid(kind, c["hit"])))
        if kind == "card":  # as for phone numbers, a failed match is a candidate only at the right length
            strict = F.filter(strict, lambda x: (x["e"] - x["s"]).between(13, 40))
        found = strict if kind not in LOOSE else F.concat(strict, F.transform(hits(t, LOOSE[kind]), lambda c: made(c, F.lit(False))))
        return F.when(t.rlike(QUICK[kind]), found).otherwise(F.filter(F.array(made(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), F.lit("").alias("hit"), F.lit("").alias("before"), F.lit("").alias("after")), F.lit(False))), lambda x: F.lit(False)))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.concat(*[of(k) for k in KINDS]).alias("cands"))


# --- reliabilities and the classifier, from counts -----------------------------------------------------------------------------


def em(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """P(personal data) of each vote pattern: labelers vote independently given the truth, each with its own rates of 1, 0 and -1.
    Starts from the share of yes among the votes cast."""
    soft = {v: (sum(x > 0 for x in v) + 0.5) / (sum(x != 0 for x in v) + 1) for v in counts}
    for _ in range(rounds):
        rates, share = [], sum(soft[v] * n for v, n in counts.items()) / sum(counts.values())
        share = min(0.99, max(0.01, share))
        for j in range(len(VOTES)):
            table = {}
            for y in (0, 1):
                mass = {x: 1.0 for x in (-1, 0, 1)}
                for v, n in counts.items():
                    mass[v[j]] += n * (soft[v] if y else 1 - soft[v])
                for x in mass:
                    table[y, x] = mass[x] / sum(mass.values())
            rates.append(table)
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(r[1, x] / r[0, x]) for r, x in zip(rates, v, strict=True))
            soft[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return soft


def places(kind: str, values: tuple) -> list[int]:
    """Which of a span's weights count: one for its kind and one for each trait's value in this kind."""
    base = KINDS.index(kind) * (1 + sum(TRAITS.values()))
    out, at = [base], base + 1
    for v, n in zip(values, TRAITS.values(), strict=True):
        out.append(at + v)
        at += n
    return out


def logistic(rows: list[tuple[list[int], float, int]], rounds: int = 200, l2: float = 0.01) -> list[float]:
    """Weights of a logistic regression on soft labels with counts; rare rows weigh as much as common ones by square roots."""
    w = [0.0] * (len(KINDS) * (1 + sum(TRAITS.values())))
    total = sum(math.sqrt(n) for _, _, n in rows) or 1.0
    for _ in range(rounds):
        g = [-l2 * x for x in w]
        for at, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in at)))))
            for i in at:
                g[i] += math.sqrt(n) / total * (y - p)
        w = [a + 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(cands: DataFrame) -> list[float]:
    """Classifier weights from the counts of (kind, votes, traits)."""
    counted = cands.select(F.explode("cands").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in (*VOTES, *TRAITS)]).count().collect()
    rows: dict[tuple, list[float]] = {}
    for kind in KINDS:
        of = [(tuple(r)[1 : 1 + len(VOTES)], tuple(r)[1 + len(VOTES) : -1], r["count"]) for r in counted if r.kind == kind]
        counts: dict[tuple, int] = {}
        for v, _, n in of:
            counts[v] = counts.get(v, 0) + n
        soft = em(counts) if counts else {}
        for v, x, n in of:
            sums = rows.setdefault((kind, x), [0.0, 0])
            sums[0] += soft[v] * n
            sums[1] += n
    return logistic([(places(*k), y / n, n) for k, (y, n) in sorted(rows.items())])


def scored(c: Column, weights: list[float]) -> Column:
    """The log-odds of a candidate: its weights are looked up by kind and value."""
    table = F.array(*map(F.lit, weights))
    base = c["k"] * (1 + sum(TRAITS.values()))
    total, at = F.get(table, base), 1
    for name, n in TRAITS.items():
        total = total + F.get(table, base + at + c[name])
        at += n
    return total


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans) and spans (base and added), each array<struct<k,s,e,kind>> in order, for each row of docs(doc_id, text)."""
    cands = materialise(candidates(docs), "candidates")
    weights = fit(cands)
    span = lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))
    base = F.sort_array(F.transform(F.filter("cands", lambda c: c["base"]), span))

    def added(b: Column) -> Column:
        more = F.filter("cands", lambda c: ~c["base"] & (scored(c, weights) > 0) & ~F.exists(b, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])))
        more = F.sort_array(F.transform(more, span))
        return let(more, lambda m: F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["k"] != x["k"]) | (F.get(m, i - 1)["e"] <= x["s"])))

    return cands.withColumn("base", base).select("doc_id", "base", let(F.col("base"), lambda b: F.sort_array(F.concat(b, added(b)))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
