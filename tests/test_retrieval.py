import random

from pyspark.sql import functions as F

from factweave.operators import retrieval
from factweave.plans import registry


def test_pack_all_offers_every_item(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "b", None]), r.choice([None, "", "x" * r.randint(1, 12), "y" * r.randint(1, 90), "z" * 9, "w" * 40])) for i in range(600)] + [(1000 + i, "long", "x" * 300) for i in range(3)]
    # after twenty that nearly fill the budget only a late short one still fits
    rows += [(2000 + i, "late", "x" * (9 if i < 20 else 3000)) for i in range(40)] + [(2040, "late", "x" * 12)]
    want, used = {g: [] for _, g, _ in rows}, dict.fromkeys({g for _, g, _ in rows}, 0)
    for i, g, t in rows:
        if t is not None and used[g] + len(t) <= 200:
            want[g].append(i)
            used[g] += len(t)
    assert want["late"][-1] == 2040 and want["long"] == []
    r.shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
        got = {x.source: x.kept for x in retrieval.pack_all(df, "source", "doc_id", F.length("text"), 200).collect()}
        assert got == want
    assert retrieval.pack_all(df.limit(0), "source", "doc_id", F.length("text"), 200).count() == 0
    # the query: the 21st document of a source fits
    spark.createDataFrame([(i, "x" * 500, "s") for i in range(30)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.context_packing(spark, str(tmp_path)).first().kept == ",".join(map(str, range(24)))
