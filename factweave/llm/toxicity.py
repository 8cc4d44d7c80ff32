"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of two lexicons learned from labelled texts (whole words and word beginnings), of words found only after
undoing obfuscation (look-alike digits and signs, inner punctuation, stretched or spaced letters), nearness of second-person words, capitals, punctuation and symbols.

Training takes about `sample` labelled documents, chosen by a hash of doc_id; the lexicons keep at most `LEXICON` entries of either kind. Another hash deals the sample into five parts, each measured with lexicons that the other four taught. The trees grow
on four of them, the fifth calibrates. So neither trees nor calibration see words that were learned from their own texts; what scores other texts are the lexicons of all five. Where a part has fewer than 20 texts or
only one kind of label, everything takes the whole sample.

Edge cases: null, empty or blank texts have all features 0 and get the score that calibration gives these; null doc_ids aren't held out and never train;
null labels don't train; without any label, or with labels of one kind only, the score is the share of toxic labels (0 if none); repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.langid import held_out
from factweave.llm.util import coded, materialise, ship, slices, sums, words

SAMPLE, LEXICON, PREFIX, FOLDS = 20_000, 3_000, 4, 5
#: Second-person words of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes tus".split())
#: Signs that stand for letters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
FEATURES = ("log_words", "lexicon", "lexicon_rate", "beginning", "beginning_rate", "disguised", "disguised_rate", "second_rate", "near_second", "capital_words", "capital_letters", "exclaims", "punctuation", "symbols", "mixed_rate", "log_word_length", "most_in_20")

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
STRETCHED = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    return EDGES.sub("", word).lower()


def undone(word: str) -> str:
    """The word without look-alikes, inner signs and stretched letters; signs at its ends stay letters only where they look like one."""
    w = word.lower().strip(".,;:?\"'()[]{}")
    if any(c.isalpha() for c in w):
        w = w.translate(LOOKALIKE)
    return STRETCHED.sub(r"\1", INNER.sub("", w))


#: Kinds of signs in a word, as patterns that are counted.
LETTER, CAPITAL, DIGIT, EXCLAIM, POINT = r"\pL", r"\p{Lu}", r"\p{Nd}", "[!?]", r"""[.,;:!?'"()\-]"""
AROUND = r"^[^\pL\pN]+|[^\pL\pN]+$"
#: Only such words can be disguised: with something but letters inside, three equal letters in a row, or letters of which this isn't told quickly.
ODD = r"\pL[^\pL]|[^\pL]\pL|[^\x00-\xff]|" + "|".join(f"{c}{{3}}" for c in map(chr, range(0x61, 0x100)) if c.isalpha())


@dataclass
class Lexicons:
    words: frozenset = frozenset()
    beginnings: frozenset = frozenset()

    def flags(self, words: pa.Array) -> np.ndarray:
        """A row for each word: hit, beginning, disguised, second, capital word, letters, capitals, exclamation marks, punctuation, symbols, mixed, length, single letter. All but the
        disguised words by Arrow's string kernels."""
        count = lambda pattern, x=words: pc.count_substring_regex(x, pattern).to_numpy().astype(np.int64)
        inner = pc.replace_substring_regex(words, AROUND, "")
        p = pc.utf8_lower(inner)
        among = lambda x, known: pc.is_in(x, value_set=pa.array(sorted(known), pa.string())).to_numpy(zero_copy_only=False)
        hit, long = among(p, self.words), pc.utf8_length(p).to_numpy()
        beginning = (long >= PREFIX) & among(pc.utf8_slice_codeunits(p, 0, PREFIX), self.beginnings)
        letters, capitals, points = count(LETTER), count(CAPITAL), count(POINT)
        length = pc.utf8_length(words).to_numpy().astype(np.int64)
        disguised = np.zeros(len(words), bool)
        if self.words:
            lower = pc.utf8_lower(words)
            ask = np.flatnonzero(~hit & (long > 0) & pc.match_substring_regex(lower, ODD).to_numpy(zero_copy_only=False))
            for i, w, x in zip(ask.tolist(), words.take(pa.array(ask)).to_pylist(), p.take(pa.array(ask)).to_pylist(), strict=True):
                u = undone(w.rstrip("*#$%&"))
                disguised[i] = u != x and len(u) > 2 and u in self.words
        return np.stack([
            hit, beginning, disguised, among(p, SECOND), (letters > 1) & (capitals == letters), letters, capitals, count(EXCLAIM), points, length - letters - count(DIGIT) - points,
            (letters > 0) & (count(r"[^\pL'’\-]", inner) > 0), length, (long == 1) & (letters == 1),
        ], axis=1).astype(np.float64)


def spaced(unique: pa.Array, codes: np.ndarray, single: np.ndarray, offsets: np.ndarray, lex: Lexicons) -> np.ndarray:
    """For each text, the lexicon words spelled with a space after each letter, at least four letters."""
    out = np.zeros(len(offsets) - 1)
    s = np.flatnonzero(single)
    if len(s) < 4:
        return out
    text = np.searchsorted(offsets, s, side="right")
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(text) != 0), [True]]))
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        if z - a >= 4:
            joined = "".join(plain(unique[int(codes[i])].as_py()) for i in s[a:z])
            out[text[a] - 1] += any(joined[i:j] in lex.words for i in range(len(joined) - 3) for j in range(i + 4, min(len(joined), i + 20) + 1))
    return out


def measure(texts: pa.Array, lex: Lexicons) -> np.ndarray:
    """A row of FEATURES for each text."""
    flat, offsets = words(texts)
    codes, unique = coded(flat)
    table = lex.flags(unique)
    each = table[codes]
    total = sums(each, offsets)
    n = np.diff(offsets).astype(float)
    per = np.maximum(n, 1)
    hit, beginning, disguised, second, capital, letters, capitals, exclaims, punctuation, symbols, mixed, length, _ = total.T
    disguised = disguised + spaced(unique, codes, each[:, 12] > 0, offsets, lex)
    # hits with a second-person word within three words, and the most hits in 20 words; windows don't cross texts
    any_hit = (each[:, 0] + each[:, 1] + each[:, 2]) > 0
    text = np.repeat(np.arange(len(n)), np.diff(offsets))
    near, at, you = np.zeros(len(n)), np.flatnonzero(any_hit), np.flatnonzero(each[:, 3])
    if len(at) and len(you):
        i = np.searchsorted(you, at)
        close = np.zeros(len(at), bool)
        for j in (i - 1, i):
            o = you[np.clip(j, 0, len(you) - 1)]
            close |= (np.abs(o - at) <= 3) & (text[o] == text[at])
        near = np.bincount(text[at[close]], minlength=len(n)).astype(float)
    most = np.zeros(len(n))
    if len(at):
        z = np.minimum(np.searchsorted(at, at + 20), np.searchsorted(at, offsets[text[at] + 1]))
        np.maximum.at(most, text[at], z - np.arange(len(at)))
    return np.stack([np.log1p(n), np.log1p(hit), hit / per, np.log1p(beginning), beginning / per, np.log1p(disguised), disguised / per, second / per, near, capital / per, capitals / np.maximum(letters, 1), exclaims / per, punctuation / per, symbols / per, mixed / per, np.log1p(length / per), most], axis=1)


# --- trees -------------------------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of one depth, each as its split features, cut values and leaves; scores are log-odds."""

    start: float
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0, least: float = 5.0) -> Trees:
    """Newton boosting on binned features; a node without a gain sends all rows left."""
    cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, bins)[1:-1]), np.quantile(c[c > c.min()], np.linspace(0, 1, bins)[:-1]) if (c > c.min()).any() else c[:1], c[:1] * 0 + c.min()])) for c in x.T]
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    raw, features, cutoffs, leaves = np.full(len(x), start), [], [], []
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first = 2**level - 1
            local = node - first
            gains = np.full((2**level, x.shape[1], width), -np.inf)
            for k in range(x.shape[1]):
                at = local * width + binned[:, k]
                gs, hs = (np.bincount(at, v, 2**level * width).reshape(-1, width) for v in (g, h))
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gains[:, k] = np.where((hl >= least / 4) & (ht - hl >= least / 4), gain, -np.inf)
            for j in range(2**level):
                k, b = np.unravel_index(gains[j].argmax(), gains[j].shape)
                if gains[j, k, b] > 1e-6:
                    f[first + j], c[first + j] = k, cuts[k][b] if b < len(cuts[k]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
        leaf = rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + l2)
        raw += leaf[node - inner]
        features.append(f), cutoffs.append(c), leaves.append(leaf)
    return Trees(start, np.array(features), np.array(cutoffs), np.array(leaves))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, rising shares), for interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    return xs, np.repeat([(b[0] + 0.5 * score.size**-1) / (b[1] + score.size**-1) for b in blocks], 2)


@dataclass
class Model:
    lexicons: Lexicons
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.ys[0])
        raw = self.trees.raw(measure(texts, self.lexicons))
        # calibrated shares are flat in stretches; a trace of the raw score keeps the trees' order within these
        return np.clip(0.999 * np.interp(raw, self.xs, self.ys) + 0.001 / (1 + np.exp(-raw)), 0, 1)


# --- training ----------------------------------------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of about `sample` rows outside the held-out fold."""
    votes = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, votes.count()))
    votes = materialise(votes.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(round(1_000_000 * share))), "votes")
    return materialise(docs.select("doc_id", "text").join(F.broadcast(votes), "doc_id"), "labelled")


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, toxic texts and other texts by part) that have each word or beginning, for each slice of texts."""
    for b in slices(batches):
        flat, offsets = words(b.column("text"))
        codes, unique = coded(flat)
        toxic, part = b.column("toxic").to_numpy(), b.column("part").to_numpy()
        forms = [plain(w) for w in unique.to_pylist()]
        text = np.repeat(np.arange(len(toxic)), np.diff(offsets))
        for kind, each in (("word", forms), ("beginning", [w[:PREFIX] if len(w) >= PREFIX else "" for w in forms])):
            index: dict[str, int] = {}
            own = np.array([index.setdefault(w, len(index)) for w in each], np.int64)
            pairs = np.unique(text * len(index) + own[codes]) if len(own) else np.zeros(0, np.int64)
            t, w = pairs // max(1, len(index)), pairs % max(1, len(index))
            counts = {f"{name}{k}": pa.array(np.bincount(w[(toxic[t] == v) & (part[t] == k)], minlength=len(index)), pa.int64()) for v, name in ((1, "yes"), (0, "no")) for k in range(FOLDS)}
            yield pa.RecordBatch.from_pydict({"kind": [kind] * len(index), "token": list(index), **counts})


def learn_lexicons(rows: DataFrame, least: int = 5) -> list[Lexicons]:
    """For each of FOLDS the lexicons of all other folds, and last those of all: words and beginnings at least ten times as common in toxic texts as in others and four standard errors over them. The driver gets
    the entries that one of these has; what it gets is bounded by the sample."""
    each = [f"{c}{k}" for c in ("yes", "no") for k in range(FOLDS)]
    texts = rows.groupBy("part").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).collect()
    size = {f"{c}{r.part}": r[c] for r in texts for c in ("yes", "no")}
    counts = rows.mapInArrow(tokens, f"kind string, token string, {', '.join(f'{c} long' for c in each)}").filter("token <> ''").groupBy("kind", "token").agg(*[F.sum(c).alias(c) for c in each])
    passing = []
    for left_out in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != left_out]
        yes, no = (sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")) for c in ("yes", "no"))
        all_yes, all_no = (sum(size.get(f"{c}{k}", 0) for k in folds) for c in ("yes", "no"))
        odds = F.log((yes + 0.5) / (all_yes + 1)) - F.log((no + 0.5) / (all_no + 1))
        good = (yes >= least) & (odds > float(np.log(10))) & (odds > 4 * F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)))
        passing.append(F.when(good, odds * F.sqrt(yes)))
    found = counts.select("kind", "token", F.array(*passing).alias("rank")).filter(F.exists("rank", lambda x: x.isNotNull())).collect()
    out = []
    for i in range(FOLDS + 1):
        best = {kind: sorted((-r["rank"][i], r.token) for r in found if r.kind == kind and r["rank"][i] is not None)[:LEXICON] for kind in ("word", "beginning")}
        out.append(Lexicons(*(frozenset(t for _, t in best[kind]) for kind in ("word", "beginning"))))
    return out


def featurise(lexicons: list[Lexicons]):
    """Each text measured with the lexicons that its part asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            part = b.column("part").to_numpy()
            for k in np.unique(part).tolist():
                own = b.filter(pa.array(part == k))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), own.column("part"), pa.array(list(measure(own.column("text"), lexicons[k])), pa.list_(pa.float64()))], ["doc_id", "toxic", "part", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    rows = labelled(docs, labels, sample).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    sizes = [(r.toxic, r.n) for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).groupBy("part").agg(F.countDistinct("toxic").alias("toxic"), F.sum("n").alias("n")).collect()]
    whole = len(sizes) < FOLDS or any(kinds < 2 or n < 20 for kinds, n in sizes)
    lexicons = learn_lexicons(rows.withColumn("part", F.lit(0)) if whole else rows)
    if whole:
        rows, lexicons = rows.withColumn("part", F.lit(0)), lexicons[-1:] * (FOLDS + 1)
    got = sorted(rows.mapInArrow(featurise(lexicons), "doc_id long, toxic int, part int, x array<double>").collect(), key=lambda r: (r.doc_id, r.toxic, r.x))
    x, y, part = np.array([r.x for r in got]), np.array([r.toxic for r in got], float), np.array([r.part for r in got])
    if not len(y) or y.min() == y.max():
        return Model(lexicons[-1], None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    grown, rest = (part == part, part == part) if whole else (part < FOLDS - 1, part == FOLDS - 1)
    trees = grow(x[grown], y[grown])
    return Model(lexicons[-1], trees, *isotonic(trees.raw(x[rest]), y[rest]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
