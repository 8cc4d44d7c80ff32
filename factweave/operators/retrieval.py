"""Retrieval: an inverted index with BM25, search over concepts and passages, resolving names, and packing a context."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.keys import KEY_SIGNS, node_key
from factweave.functions.text import STOP_WORDS

#: Fixed values of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"


class NotFound(ValueError):
    code = "not_found"

    def __init__(self, kind: str, name: str, suggestions: list[str]):
        super().__init__(f'There is no {kind} "{name}"' + (f"; perhaps: {', '.join(suggestions)}" if suggestions else ""))
        self.suggestions = suggestions


def index(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(term, key, tf, size)."""
    terms = texts.select(key, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("t"))
    return terms.select(key, F.size("t").alias("size"), F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def query_terms(query: str) -> list[str]:
    """Words of a question's key longer than a letter that aren't stop-words; all of them if none is left."""
    found = [w for w in plain_key(query).split() if len(w) > 1]
    return [w for w in found if w not in STOP_WORDS] or found


def plain_key(label: str) -> str:
    """node_key of one name."""
    return re.sub(r"\s+", " ", str(label)).strip().lower().strip(KEY_SIGNS)


def phrases(terms: list[str]) -> list[list[str]]:
    """What the index holds for each term: its runs of letters and digits, which stand side by side in a text that has the term."""
    return [p for t in terms if (p := re.findall(r"[^\W_]+", t))]


def _places(phrase: list[str]) -> Column:
    """The words of `_w` at which a phrase begins."""
    first, n, whole = F.lit(phrase[0]), len(phrase), F.array(*map(F.lit, phrase))
    if n == 1:
        return F.filter("_w", lambda w: w == first)
    return F.filter("_w", lambda w, at: (w == first) & (F.slice(F.col("_w"), at + 1, F.lit(n)) == whole))


def bm25(texts: DataFrame, terms: list[str], key: str = "id", text: str = "text") -> DataFrame:
    """(key, score) of texts(key, text) with any of the terms. Each text is cut into words once and only counts leave it: no list of all words is shuffled. Texts without a word count in the
    number and mean length too."""
    asked = phrases(terms)
    said = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = texts.select(F.col(key), said.alias("_w")).withColumn("_size", F.size("_w"))
    for i, p in enumerate(asked):
        rows = rows.withColumn(f"_t{i}", F.size(_places(p)))
    counts = [f"_t{i}" for i in range(len(asked))]
    rows = rows.select(key, "_size", *counts)
    if not asked:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    known = rows.agg(F.count("*").alias("_n"), F.avg("_size").alias("_mean"), *[F.count_if(F.col(c) > 0).alias(f"{c}_df") for c in counts])
    hit = rows.filter(" or ".join(f"{c} > 0" for c in counts)).join(F.broadcast(known))
    total = F.lit(0.0)
    for c in counts:
        idf = F.greatest(F.log((F.col("_n") - F.col(f"{c}_df") + 0.5) / (F.col(f"{c}_df") + 0.5)), F.lit(LEAST_IDF))
        total = total + F.when(F.col(c) > 0, idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("_size") / F.col("_mean")))).otherwise(0.0)
    return hit.select(key, total.alias("score"))


def snippet(text: Column, terms: list[str], words: int = 24) -> Column:
    """About `words` words of a text around the first of the terms, which stand in brackets; dots where it goes on. White space squeezed."""
    flat = F.split(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")
    hit = lambda w: F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")) == t) if terms else F.lit(False)
    first = F.coalesce(F.nullif(F.array_position(F.transform(flat, hit), True), F.lit(0)), F.lit(1))
    start = F.greatest(F.lit(1).cast("long"), first - words // 3)
    body = F.array_join(F.transform(F.slice(flat, start.cast("int"), words), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(F.when(start > 1, "... ").otherwise(""), body, F.when(start - 1 + words < F.size(flat), " ...").otherwise(""))


def ranked_passages(chunks: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(chunk_id, rank) of the first k chunks(id, text) for a question, from rank 0 on; where no term is left, of those that hold the question as it is."""
    terms = query_terms(query)
    if terms:
        best = bm25(chunks.select("id", "text"), terms).orderBy(F.col("score").desc(), "id").limit(k)
    else:
        best = chunks.filter(F.contains(F.lower("text"), F.lit(query.lower()))).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(k)
    return best.select(F.col("id").alias("chunk_id"), (F.row_number().over(Window.orderBy(F.col("score").desc(), "id")) - 1).alias("rank"))


def open_degrees(edges: DataFrame) -> DataFrame:
    return edges.filter("valid_to is null").select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def search(nodes: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, label, type, summary, degree, score, matched) of concepts: 3 for the name, 2 for part of it, 1 for the first 50 by words of label and summary, 0.5 / (1 + rank) for each of the first 20 passages that
    mention it; ranked with 0.05 for each of up to 20 relations. `matched` says which of these counted."""
    terms, q = query_terms(query), node_key(F.lit(query))
    named = nodes.select("id", F.when(F.col("id") == q, 3.0).when(F.contains("id", q), 2.0).alias("s"), F.lit("name").alias("why")).filter("s is not null")
    by_words = bm25(nodes.select("id", F.concat_ws(" ", "label", "summary").alias("text")), terms).orderBy(F.col("score").desc(), "id").limit(50).select("id", F.lit(1.0).alias("s"), F.lit("summary").alias("why"))
    told = mentions.join(F.broadcast(ranked_passages(chunks, query)), "chunk_id").select(F.col("node_id").alias("id"), (0.5 / (1 + F.col("rank"))).alias("s"), F.lit("passage").alias("why"))
    total = named.unionByName(by_words).unionByName(told).groupBy("id").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("why")).alias("matched")).join(open_degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = F.col("score") + 0.05 * F.least("degree", F.lit(20))
    found = total.join(nodes.select("id", "label", "type", "summary"), "id").withColumn("order", order).orderBy(F.col("order").desc(), "id").limit(limit)
    return found.select("id", "label", "type", "summary", "degree", F.round("score", 3).alias("score"), "matched")


def passages(chunks: DataFrame, sources: DataFrame, query: str, shown: int = 8) -> DataFrame:
    """(rank, chunk, source, uri, snippet) of the first passages for a question."""
    best = ranked_passages(chunks, query).filter(F.col("rank") < shown)
    told = chunks.join(F.broadcast(best), chunks.id == best.chunk_id).join(sources.select(F.col("id").alias("source_id"), "title", "uri"), "source_id", "left")
    return told.select("rank", F.col("chunk_id").alias("chunk"), F.coalesce("title", F.lit("")).alias("source"), F.coalesce("uri", F.lit("")).alias("uri"), snippet(F.col("text"), query_terms(query)).alias("snippet"))


def degrees_of(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found(id, ...) with deg, how many edges, closed ones too, end in it."""
    n = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    return found.join(n, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))


def resolve_one(nodes: DataFrame, edges: DataFrame, name: str, like: int = 8) -> str:
    """The concept of a name: its exact key, else the only one that holds it, else of the most connected that do the only one with it as first or last word. Otherwise an error with suggestions."""
    key = plain_key(name)
    ids = nodes.select("id")
    if not ids.filter(F.col("id") == key).isEmpty():
        return key
    near = [r.id for r in degrees_of(ids.filter(F.contains("id", F.lit(key))), edges).orderBy(F.col("deg").desc(), F.length("id"), "id").limit(like).collect()]
    if len(near) == 1:
        return near[0]
    edge = [x for x in near if x.startswith(key + " ") or x.endswith(" " + key)]
    if len(edge) == 1:
        return edge[0]
    if not near:
        for w in (w for w in key.split() if len(w) > 2):
            near += [r.id for r in ids.filter(F.contains("id", F.lit(w))).orderBy("id").limit(5).collect()]
    raise NotFound("concept", name, list(dict.fromkeys(near))[:like])


def grams(text: Column, n: Column) -> Column:
    """All stretches of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, how): each name's concept by its exact key, else the only one that contains it, else the only one with it as first or last word. Concepts are found through an index of their stretches of
    three characters (as many as a shorter name has): a name looks under its rarest one only."""
    keyed = names.select("name", node_key(F.col("name")).alias("k")).filter("k <> ''").distinct()
    exact = keyed.join(nodes.select("id"), F.col("k") == F.col("id")).select("name", "id", F.lit("exact").alias("how"), F.lit(0).alias("step"))
    own = keyed.withColumn("n", F.least(F.length("k"), F.lit(3)))
    sizes = own.select("n").distinct()
    under = nodes.select("id").join(F.broadcast(sizes)).select("id", F.explode(F.array_distinct(grams(F.col("id"), F.col("n")))).alias("gram"))
    asked = own.select("name", "k", F.explode(F.array_distinct(grams(F.col("k"), F.col("n")))).alias("gram"))
    often = under.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "gram", "left").groupBy("name", "k").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), F.col("gram"))).alias("gram"))
    near = under.join(rarest, "gram").filter(F.contains("id", "k")).withColumn("edge", F.startswith("id", F.concat("k", F.lit(" "))) | F.endswith("id", F.concat(F.lit(" "), "k")))
    one = near.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.count_if("edge").alias("n_edge"), F.min(F.when(F.col("edge"), F.col("id"))).alias("id_edge"))
    part = one.filter("n = 1").select("name", "id", F.lit("part").alias("how"), F.lit(1).alias("step"))
    word = one.filter("n_edge = 1").select("name", F.col("id_edge").alias("id"), F.lit("word").alias("how"), F.lit(2).alias("step"))
    return exact.unionByName(part).unionByName(word).groupBy("name").agg(F.min_by(F.struct("id", "how"), "step").alias("x")).select("name", "x.*")


def top_passages(mentions: DataFrame, k: int = 5) -> DataFrame:
    """Each concept's chunks with most mentions, k at most."""
    order = Window.partitionBy("node_id").orderBy(F.col("count").desc(), "chunk_id")
    return mentions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def pack(items: Column, budget: int) -> Column:
    """Of items array<struct<text,...>> those that fit, in order: one too long is left out and later ones may still fit. Counts the texts only."""
    state = F.struct(F.lit(0).alias("used"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    take = lambda a, x: F.when(a["used"] + F.length(x["text"]) <= budget, F.struct((a["used"] + F.length(x["text"])).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return F.aggregate(items, state, take, lambda a: a["kept"])


def pack_all(items: DataFrame, group: str, key: str, size: Column, budget: int) -> DataFrame:
    """(group, kept): of any number of items what `pack` keeps, by their sizes in order of key; groups that keep nothing have an empty array. Items without a size
    never fit; of equal keys the smaller item comes first. Each map task first drops what can't fit: an item fits only if it and those before it that are no larger fit together
    (had one of these not fitted, then less than its size was left). So a few items of a group and task are shuffled, and one task folds them."""

    def fold(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun, now, used, least, taken = False, None, 0, 0, []
            for b in batches:
                fits, rows = [], []
                for i, (g, n) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    first = not begun or g != now
                    if first:
                        begun, now, used, least, taken = True, g, 0, budget + 1, []
                    ok = n is not None and n < least
                    if ok and last:
                        ok = used + n <= budget
                        used += n * ok
                    elif ok:
                        ok = n == 0 or sum(taken[: bisect_right(taken, n)]) + n <= budget
                        if not ok:
                            least = n
                        elif n:
                            insort(taken, n)
                    if ok or first:
                        fits.append(ok)
                        rows.append(i)
                if rows:
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(fits, pa.bool_())], ["g", "k", "n", "fits"])

        return run

    each = items.select(F.col(group).alias("g"), F.col(key).alias("k"), size.cast("long").alias("n"))
    schema = f"g {each.schema['g'].dataType.simpleString()}, k {each.schema['k'].dataType.simpleString()}, n long, fits boolean"
    few = each.sortWithinPartitions("g", "k", "n").mapInArrow(fold(False), schema).select("g", "k", F.when(F.col("fits"), F.col("n")).alias("n"))
    done = few.repartition("g").sortWithinPartitions("g", "k", "n").mapInArrow(fold(True), schema)
    return done.groupBy(F.col("g").alias(group)).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("k", "n")))), lambda x: x["k"]).alias("kept"))
