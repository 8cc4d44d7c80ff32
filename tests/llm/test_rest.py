import random
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest

from factweave.llm import decontam, mixing, sharding
from factweave.llm.queries import ORACLE_SQL
from factweave.plans import storage


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_decontamination(spark, corpus, odd, empty, monkeypatch):
    df, rows = corpus
    r = random.Random(1)
    items = [(i, rows[i][1][:150]) for i in range(0, 12, 2)] + [(90, "short"), (92, " Z z "), (91, None), (93, "  "), (None, "no id for this one here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = []
    for n, edits in enumerate((0, 3, 8, 9, 30)):
        t = list(items[0][1])
        for at in r.sample(range(len(t)), edits):
            t[at] = r.choice(["Q", "", t[at] + "q"])
        edited.append((500 + n, f"{rows[50][1]} {''.join(t).upper()} {rows[51][1]}", "en", "a"))
    edited += [(600, "a Short story, z\tZ", "en", "a"), (601, "short", "en", "a"), (602, "shorter z zz", "en", "a")]
    all_rows = rows + edited
    got = {x.doc_id: x["items"] for x in decontam.find(df.union(spark.createDataFrame(edited, df.schema)), bench).collect()}
    kept = [(i, decontam.normal(t)) for i, t in items if i is not None and decontam.normal(t)]
    there = lambda item, t: f" {item} " in f" {t} " if len(item) < decontam.SHORT else distance(item, t) <= decontam.budget(len(item))
    for i, text, *_ in all_rows[:40] + edited:
        t = decontam.normal(text)
        assert got[i] == sorted(k for k, item in kept if there(item, t))
    one = [r.doc_id for r in decontam.clean(df.union(spark.createDataFrame(edited, df.schema)), bench).select("doc_id").collect()]
    monkeypatch.setattr(decontam, "MAX_ITEM_BYTES", 200)  # several blocks give the same
    again = {x.doc_id: x["items"] for x in decontam.find(df.union(spark.createDataFrame(edited, df.schema)), bench).collect()}
    assert again == got
    assert sorted(one) == sorted(r.doc_id for r in decontam.clean(df.union(spark.createDataFrame(edited, df.schema)), bench).select("doc_id").collect()) == sorted(i for i, x in got.items() if not x)
    assert decontam.find(odd, bench).count() == 11
    assert decontam.clean(odd, bench).count() == 11 and decontam.clean(odd, bench.limit(0)).columns == odd.columns
    assert decontam.find(empty, bench).count() == 0


@pytest.mark.parametrize("name", ["op3_mixing", "op5_extendible_sharding"])
def test_sql(spark, corpus, name, tmp_path):
    df, rows = corpus
    df.withColumn("source", mixing.F.when(mixing.F.col("doc_id") % 3 > 0, "hot").when(mixing.F.col("doc_id") % 9 == 0, "").when(mixing.F.col("doc_id") % 9 == 3, mixing.F.lit(None)).otherwise(mixing.F.col("source"))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {"op3_mixing": mixing.op3_mixing, "op5_extendible_sharding": sharding.op5_extendible_sharding}[name](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL[name]).df()
    assert sorted(map(tuple, got[sorted(got)].astype(str).values.tolist())) == sorted(map(tuple, want[sorted(want)].astype(str).values.tolist()))


def test_mixing_budget(spark, odd, empty):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), None, "hot" if i % 10 else f"s{i % 50}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    found = mixing.sized(docs)
    plan = {r.source: r for r in mixing.plan(found, repeats=3.0).collect()}
    out = mixing.mix(docs, repeats=3.0)
    total = found.agg(mixing.F.sum("n_tokens")).first()[0]
    for r in out.groupBy("source").agg(mixing.F.sum(mixing.n_words(mixing.F.col("text"))).alias("n")).collect():
        assert 0 <= plan["=" + r.source].weight * total - r.n <= 8  # short of the budget by less than a document
    assert max(r.n for r in out.groupBy("doc_id").agg(mixing.F.count("*").alias("n")).collect()) <= 3
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0
    apart = spark.createDataFrame([(i, "w w", None, "" if i % 2 else None) for i in range(6)], "doc_id long, text string, lang string, source string")
    assert {r.source: r.docs for r in mixing.sized(apart).groupBy("source").agg(mixing.F.count("*").alias("docs")).collect()} == {"=": 3, "-": 3}


def test_sharding_limits(spark, corpus, odd, empty, tmp_path):
    df, _ = corpus
    got = sharding.assign(df, 3000).collect()
    assert len(got) == 240 and len({r.shard for r in got}) > 20 and all(r.fits for r in got)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    assert all(sizes[r.shard] == r.shard_bytes <= 3000 for r in got)
    # prefix-free, and no two sibling shards would fit in one
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)
    assert all(sizes[s] + sizes.get(s[:-1] + "10"[int(s[-1])], 10**9) > 3000 for s in sizes if s)
    assert sharding.assign(odd, 1000).count() == 11 and sharding.assign(empty).count() == 0
    sharding.write_shards(df, str(tmp_path / "x"), 3000)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 240


def test_pipeline(spark, corpus, tmp_path):
    from tests.llm.test_neardup import brute

    df, rows = corpus
    df.selectExpr("*", "cast(length(text) as bigint) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, rows[7][1][:120])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{n}"))
        docs = spark.read.parquet(str(tmp_path / f"out{n}"))
        assert n == 4 or docs.columns == columns
        ids.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert ids[0] == [r[0] for r in rows]
    assert ids[1] == [i for i, (_, c) in brute(rows, 5).items() if i == c]
    assert 7 not in ids[2] and set(ids[1]) - set(ids[2]) <= {7}
    assert ids[4] == ids[3] and set(ids[3]) <= set(ids[2])
    # a run leaves the token stage's input and its segments behind, and nothing of the stages before
    left = Path(storage.shared_dir(spark).removeprefix("file://")) / "factweave"
    there = set(left.iterdir())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(left.iterdir()) - there) == ["source-mixing", "tokens"]
