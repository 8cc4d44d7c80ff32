"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and runs of white space become one blank. An item of n characters has an error budget of k = max(1, n * `errors` / 100) edits; cut into k + 1
pieces, at least one piece is found unchanged in any passage within the budget. An Aho-Corasick automaton finds all pieces in one
pass over a text; each hit gives a window, and Myers' bit-parallel distance decides whether the item lies in it within k edits. Windows of one item that overlap are tried as one.

Items of fewer than `SHORT` characters have too little text for edits: they must stand in a text as they are, between blanks or its ends.

The items go to all tasks in blocks of `MAX_ITEM_BYTES`. A benchmark of several blocks is worked through one block after another: each block's hits are written before the next block is sent, so
neither the driver nor a worker holds more than one.

Edge cases: null or blank texts match nothing; null and blank items match nothing; items that repeat are reported under
each id; null ids are kept in documents and ignored in items; repeated rows each give a row; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.util import materialise, ship, slices

ERRORS, SHORT, MAX_ITEM_BYTES = 6, 24, 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, errors: int = ERRORS) -> int:
    return max(1, n * errors // 100)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


class Myers:
    """Smallest edit distance of a pattern to any stretch of a text, in one integer per text character whatever the pattern's length."""

    def __init__(self, pattern: str):
        self.n, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str, enough: int) -> int:
        """The smallest distance; stops early once it is `enough` or less."""
        full, last = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score, best = full, 0, self.n, self.n
        get = self.masks.get
        for c in text:
            eq = get(c, 0)
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            up, down = minus | (full & ~(d | plus)), plus & d
            if up & last:
                score += 1
            elif down & last:
                score -= 1
                if score < best:
                    best = score
                    if best <= enough:
                        return best
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(x | up)), up & x
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors: int = ERRORS):
        import ahocorasick

        found: dict[str, list[int]] = {}
        for i, text in items:
            t = normal(text)
            if i is not None and t:
                found.setdefault(t, []).append(i)
        self.texts, self.ids = list(found), list(found.values())
        self.k = [budget(len(t), errors) for t in self.texts]
        self.myers = [Myers(t) for t in self.texts]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.texts):
            if len(t) < SHORT:  # place -1: the whole item with the blanks around it
                where.setdefault(f" {t} ", []).append((n, -1))
                continue
            for at, p in pieces(t, self.k[n]):
                where.setdefault(p, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for p, places in where.items():
            self.automaton.add_word(p, (len(p), places))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance bound met) of all items in the text."""
        t = normal(text)
        if not self.texts or not t:
            return []
        windows: dict[int, list[list[int]]] = {}
        whole: set[int] = set()
        t = f" {t} "
        for end, (size, places) in self.automaton.iter(t):
            for n, at in places:
                if at < 0:
                    whole.add(n)
                    continue
                k = self.k[n]
                lo = max(0, end + 1 - size - at - k)
                hi = min(len(t), lo + len(self.texts[n]) + 2 * k)
                own = windows.setdefault(n, [])
                # hits come in order of their ends, so windows of one item come nearly in order too
                if own and lo <= own[-1][1] and hi >= own[-1][0]:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        out = [(i, 0) for n in whole for i in self.ids[n]]
        for n, own in windows.items():
            k, best = self.k[n], self.k[n] + 1
            for lo, hi in own:
                w = t[lo:hi]
                best = min(best, 0 if self.texts[n] in w else self.myers[n].distance(w, k))
                if best <= k:
                    break
            if best <= k:
                out += [(i, best) for i in self.ids[n]]
        return sorted(out)


def item_blocks(benchmark: DataFrame, errors: int) -> Iterator[Matcher]:
    """Matchers over blocks of items of a bounded size; the items stream through the driver block by block."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size >= MAX_ITEM_BYTES:
            yield Matcher(block, errors)
            block, size = [], 0
    yield Matcher(block, errors)


def by_blocks(benchmark: DataFrame, errors: int) -> Iterator[tuple[object, bool]]:
    """Each block's matcher, shared with all tasks until the next one is asked for, and whether it is the only one."""
    spark = benchmark.sparkSession
    ship(spark)
    blocks = item_blocks(benchmark, errors)
    now, after = next(blocks), next(blocks, None)
    only = after is None
    while now is not None:
        shared = spark.sparkContext.broadcast(now)
        yield shared, only
        if not only:
            shared.unpersist()
        now, after = after, next(blocks, None)


def hits(shared, all_rows: bool):
    """(doc_id, text's hash, items) of rows, or of those with items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            items = [sorted({i for i, _ in shared.value.matches(t)}) for t in b.column("text").to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "h", "items"])
            yield out if all_rows else out.filter(pa.array([bool(x) for x in items], pa.bool_()))

    return run


def find(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """doc_id and items (ids of the items found, ascending) for each row of docs(doc_id, text)."""
    rows, found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")), []
    for shared, only in by_blocks(benchmark, errors):
        each = rows.mapInArrow(hits(shared, only), "doc_id long, h long, items array<long>")
        if only:
            return each.select("doc_id", "items")
        found.append(materialise(each.distinct(), "hits"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h"))
    joined = rows.select("doc_id", "h").alias("d").join(every.alias("f"), same, "left")
    return joined.select("d.doc_id", F.coalesce("f.items", F.array().cast("array<long>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """The rows of docs, all columns, in which no item is found; with several blocks what one leaves is written for the next."""

    def free_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array([not shared.value.matches(t) for t in b.column("text").to_pylist()], pa.bool_()))

        return run

    for shared, only in by_blocks(benchmark, errors):
        docs = docs.mapInArrow(free_of(shared), docs.schema)
        docs = docs if only else materialise(docs, "clean")
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.size("items").cast("long").alias("n_items"), (F.size("items") > 0).alias("contaminated"))
