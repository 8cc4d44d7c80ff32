import math
import re
from collections import Counter

from pyspark.sql import functions as F

from factweave.llm import quality

TEXTS = ["", None, " \n ", "a b c d e a b c d e f", "x " * 30, "one two three\none two three\n\n\none two three\nz", "#a $b % & <| > *", "é ü " * 3 + "\x0b q", "p q r s t u v w x y p q r s t", "a b c d e f g a b c d e h b c d e f"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_features(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id int, text string, lang string")
    for r in quality.features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id])


def test_binomial_tail(spark):
    cases = [(0, 300), (2, 100), (5, 700), (40, 3000), (0, 0), (3, 12), (11, 12), (12, 12), (0, 1), (19, 1950), (100, 3000), (10, 1000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for k, n, p in df.collect():
        assert abs(p - min(1, sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)))) < 1e-9


def test_certified_cutoff(spark):
    docs = [(i, ("w%d " * 12) % tuple(range(i, i + 12)) + "#" * (60 if i % 4 == 0 else 0), "en") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    out = quality.quality(spark, df, labels)
    assert out.filter(~F.col("kept") & (F.col("doc_id") % 4 != 0)).count() == 0
    assert out.filter(F.col("kept") & (F.col("doc_id") % 4 == 0)).count() == 0
    none = quality.quality(spark, df.filter("doc_id < 40"), labels.filter("doc_id < 40"))
    assert none.filter("kept").count() == 40  # too few labels certify nothing


def test_repeated_labels_vote_once(spark):
    docs = spark.createDataFrame([(i, ("w%d " * 12) % tuple(range(i, i + 12)) + "#" * (60 if i % 2 else 0), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    many = labels.crossJoin(spark.range(60)).drop("id")
    found = quality.features(docs.crossJoin(spark.range(3)).drop("id"))
    assert quality.rules_from(found, many).count() == 0
    certified = quality.rules_from(quality.features(docs), many, alpha=0.99, delta=0.9999)
    assert {r.n for r in certified.collect()} <= {20}
    both = quality.rules_from(found, labels.union(labels.selectExpr("doc_id", "1 - quality")), alpha=0.99, delta=0.9999)
    assert both.count() == 0  # labels that disagree don't vote


def selected(rows, alpha, delta):
    """Plain fixed-sequence selection: rows of (lang, good, values by rule)."""
    langs, out = {r[0] for r in rows}, {}
    a, level = alpha / len(quality.RULES), delta / (len(langs) * len(quality.RULES))
    for lang in langs:
        for j, rule in enumerate(quality.RULES):
            of = [(r[2][j], r[1]) for r in rows if r[0] == lang]
            n, best = sum(g for _, g in of), None
            for cut in sorted({v for v, _ in of}, reverse=True):
                k, caught = sum(g for v, g in of if v > cut), sum(1 - g for v, g in of if v > cut)
                if sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)) > level:
                    break
                if caught > quality.COST * k and (best is None or caught - quality.COST * k > best[0]):
                    best = (caught - quality.COST * k, cut, k, n)
            if best:
                out[lang, rule] = best[1:]
    return out


def test_selection_against_plain(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(900):
        good = int(r.random() < 0.7)
        rows.append((r.choice(["en", "en", "de"]), good, [r.randint(0, 20) if good or r.random() < 0.4 else r.randint(15, 40) for _ in quality.RULES]))
    df = spark.createDataFrame([(x, g, *v) for x, g, v in rows], "lang string, good long, " + ", ".join(f"{x} int" for x in quality.RULES))
    got = {(x.lang, x.rule): (x.cutoff, x.k, x.n) for x in quality.certify(df, 0.2, 0.2).collect()}
    assert got == selected(rows, 0.2, 0.2) and got


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, quality int")
    out = quality.quality(spark, odd, labels)
    assert out.count() == 11 and out.filter("kept is null or base_failed is null").count() == 0
    assert quality.quality(spark, empty, labels).count() == 0
