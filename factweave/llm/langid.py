"""Language identification of mixed texts.

The range of code points that a word is written in narrows the candidate languages to those seen in that script; each candidate scores the word by its character
trigrams (log-likelihood against the mean of all languages); Viterbi over a text's words, with a penalty for each switch, gives spans of
languages. A text's language is the one with most letters, its score the share of these letters.

Training takes at most `per_language` texts of at most `max_chars` characters for each language, the first in the order of a hash of doc_id (ties by doc_id; rows that repeat a doc_id
count on their own).

Edge cases: a null text or one without any letter is 'und' with score 0; null doc_ids aren't held out and never train; words in a script that no
language was seen in stay without a language, and a text of such words alone gets the first language with score 0; without any labelled row
all texts are 'und'; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.util import coded, materialise, ship, slices, sums, words

BINS = 1 << 16
SWITCH, OUT_OF_SCRIPT, CAP = np.float32(8.0), np.float32(-12.0), np.float32(10.0)
#: First and last code points of scripts, by name; what is in none of them is 'other'.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = ["none", "other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]

_tables: dict[str, np.ndarray] = {}


def script_table() -> np.ndarray:
    """For each code point: 0 if it is no letter, else its script's index in NAMES."""
    if "script" not in _tables:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        t = letter.astype(np.uint8)
        for name, a, z in SCRIPTS:
            t[a : z + 1] = np.where(letter[a : z + 1], NAMES.index(name), 0)
        _tables["script"] = t
    return _tables["script"]


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray  # BINS x languages: log-likelihood less the mean over languages
    scripts: np.ndarray  # scripts x languages: whether the language is written in the script


def grams(unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words: trigram bins in a row and where each word's start; the number of letters and the script of most letters."""
    text = "".join(x for w in pc.utf8_lower(unique).to_pylist() for x in (" ", w))
    cp = np.frombuffer((text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = script_table()[cp]
    starts = np.flatnonzero(cp == 32)  # words hold no blanks
    c = np.where(kind > 0, cp, np.uint32(32)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = c.copy()
        h[1:] += c[:-1] * np.uint64(0x9E3779B97F4A7C15)
        h[:-1] += c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    gram = (h >> np.uint64(48)).astype(np.int64)
    letter = kind > 0
    count = np.add.reduceat(letter.astype(np.int64), starts[:-1]) if len(unique) else np.zeros(0, np.int64)
    script = np.zeros(len(unique), np.int64)
    many = np.zeros(len(unique), np.int64)
    for s in np.unique(kind[letter]):
        n = np.add.reduceat((kind == s).astype(np.int64), starts[:-1])
        script, many = np.where(n > many, s, script), np.maximum(many, n)
    return gram[letter], np.concatenate([[0], np.cumsum(count)]), count, script


def train_model(languages: list[str], texts: list[str]) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    counts = np.full((BINS, len(names)), 0.0)
    letters = np.zeros((len(NAMES), len(names)))
    for k, name in enumerate(names):
        flat, _ = words(pa.array([t for t, x in zip(texts, languages, strict=True) if x == name], pa.string()))
        codes, unique = coded(flat)
        if not len(unique):
            continue
        often = np.bincount(codes, minlength=len(unique)).astype(float)
        gram, at, n, script = grams(unique)
        counts[:, k] = np.bincount(gram, np.repeat(often, n), BINS)
        letters[:, k] = np.bincount(script, often * n, len(NAMES))
    # bins that no language has seen say nothing: all get the mean
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BINS)
    logs = np.log(share)
    seen = letters >= 0.01 * np.maximum(1, letters.sum(axis=0))
    return Model(names, np.where(counts.sum(axis=1, keepdims=True) > 0, logs - logs.mean(axis=1, keepdims=True), 0).astype(np.float32), seen)


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def training_rows(docs: DataFrame, per_language: int, max_chars: int) -> DataFrame:
    """(lang, text) of the sample. A language's count of texts gives the share of hash values below which its first ones surely lie, so only a little more than the sample is ranked,
    whatever the number of texts and tasks."""
    ranked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    fit = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2) & F.length("text").between(1, max_chars))
    need = per_language + 8 * per_language**0.5 + 32
    below = F.broadcast(materialise(fit.groupBy("lang").agg((F.lit(float(1 << 40)) * need / F.count("*")).alias("below")), "shares"))
    few = fit.select("doc_id", "lang", ranked.alias("h")).join(below, "lang").filter("h < below")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    return fit.join(F.broadcast(materialise(chosen, "sample")), ["doc_id", "lang"], "left_semi").select("lang", "text")


def fit(docs: DataFrame, per_language: int = 400, max_chars: int = 20_000) -> Model:
    rows = training_rows(docs, per_language, max_chars).collect()
    return train_model([r.lang for r in rows], [r.text for r in rows])


def viterbi(score: np.ndarray, offsets: np.ndarray, switch: np.float32 = SWITCH) -> np.ndarray:
    """The best language for each word of each text: all texts advance by one word at a time, longest texts first."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    begin, n = offsets[:-1][order], n[order]
    state_type = np.min_scalar_type(max(1, score.shape[1] - 1))
    out = np.zeros(len(score), state_type)
    if not len(n) or not n[0]:
        return out
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
    stay, best = np.empty(score.shape, bool), np.empty(len(score), state_type)
    v = score[begin].copy() if n[-1] else np.where((n > 0)[:, None], score[np.minimum(begin, len(score) - 1)], 0)
    for t in range(1, n[0]):
        k = active[t]
        at, w = begin[:k] + t, v[:k]
        to = w.argmax(axis=1)
        top = w[np.arange(k), to][:, None]
        best[at], stay[at] = to, w >= top - switch
        v[:k] = np.maximum(w, top - switch) - top + score[at]
    state = v.argmax(axis=1)  # of each text's last word
    for t in range(n[0] - 1, 0, -1):
        k = active[t]
        at, s = begin[:k] + t, state[:k]
        out[at] = s
        state[:k] = np.where(stay[at, s], s, best[at])
    k = active[0]
    out[begin[:k]] = state[:k]
    return out


def identify_batch(texts: pa.Array, m: Model) -> tuple[list, np.ndarray, tuple]:
    flat, offsets = words(texts)
    codes, unique = coded(flat)
    k = len(m.languages)
    if not k or not len(unique):
        return ["und"] * len(texts), np.zeros(len(texts)), (np.zeros(len(flat), np.uint8), np.zeros(len(flat), bool), offsets)
    gram, at, letters, script = grams(unique)
    score = sums(m.trigrams[gram], at).astype(np.float32)
    # no single word outweighs a switch by much
    score = np.clip(score, -CAP, CAP)
    fits = m.scripts[script]
    known = fits.any(axis=1) & (letters > 0)
    score = np.where(known[:, None], np.where(fits, score, OUT_OF_SCRIPT), np.float32(0))
    path = viterbi(score[codes], offsets)
    weight = np.zeros((len(flat), k), np.float32)
    weight[np.arange(len(flat)), path] = (letters * known)[codes]
    by, total = sums(weight, offsets), sums(letters[codes], offsets)
    best = by.argmax(axis=1)
    share = by[np.arange(len(by)), best] / np.maximum(total, 1)
    names = [m.languages[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
    return names, np.where(total > 0, share, 0.0), (path, known[codes], offsets)


def spans_of(path: np.ndarray, known: np.ndarray, offsets: np.ndarray, languages: list[str]) -> list[list[dict]]:
    """Stretches of words (first, end exclusive) of one language for each text; words without letters go with what is before them."""
    out = []
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        p = path[a:z]
        if not languages or not known[a:z].any():
            out.append([])
            continue
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
        out.append([{"first": int(x), "end": int(y), "lang": languages[p[x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)])
    return out


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=2 << 20):
            names, score, found = identify_batch(b.column("text"), shared.value)
            cols = {"doc_id": b.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())}
            if spans:
                cols["spans"] = pa.array(spans_of(*found, shared.value.languages), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double" + ", spans array<struct<first:int,end:int,lang:string>>" * spans)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns, whose text has a language that takes `least` of its letters or more. The text goes through Python once, with
    the row's other columns beside it."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=2 << 20):
            names, score, _ = identify_batch(b.column("text"), shared.value)
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
