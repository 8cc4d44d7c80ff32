"""Very long texts, repeated rows, clashing columns and empty tables, for all operators over documents and for the pipeline."""

import corpus_pipeline
import pytest

from factweave.llm import decontam, mixing, neardup, pii, quality, sharding, tokenbin
from tests.llm.test_neardup import brute

WORDS = " ".join(f"w{i}" for i in range(120_000))
LONG = [(1, WORDS, "en", "a"), (2, WORDS + " tail", "en", "a"), (3, "x" * 2_000_000, "en", "a"), (4, "one\n" * 150_000, "de", "b"), (5, "short text of some words", "de", "b"), (5, "short text of some words", "de", "b"), (6, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def long(spark):
    """With columns named as the operators name their own."""
    extra = "id int, key int, label int, n int, n_words int, copies int, shard int, start int, items int, kept int, set int, h int, place int, cluster int, value int, row int"
    return spark.createDataFrame([(*r, *range(16)) for r in LONG], f"{SCHEMA}, {extra}")


def test_near_duplicates(long):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(long, 2).collect()}
    assert got == {(i, n, c) for i, (n, c) in brute(LONG, 2).items()} and neardup.near_duplicates(long, 2).count() == 7
    kept = neardup.keep_first(long)
    assert kept.columns == long.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 5, 6]


def test_quality(spark, long):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality(spark, long, labels).collect()}
    assert out[1].n_words == 120_000 and out[1].n_repeat_words == 0 and not out[1].base_failed
    assert out[4].n_repeat_words == out[4].n_words == 150_000 and out[4].n_dup_lines == 149_999 and out[4].base_failed and out[3].word_chars == 2_000_000
    assert quality.quality(spark, long, labels).count() == 7


def test_mixing_and_sharding(long, empty):
    out = mixing.mix(long)
    assert out.columns == long.columns and {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, 5, 6}
    placed = sharding.assign(long, 100_000).collect()
    assert len(placed) == 7 and {r.doc_id for r in placed if not r.fits} == {1, 2, 3, 4}  # texts over the limit have shards of their own
    assert mixing.mix(empty).count() == 0 and sharding.assign(empty).count() == 0


def test_personal_data(spark, long, empty):
    rows = spark.createDataFrame([(1, WORDS + " a@b.cd", "k"), (2, "9 " * 200_000, "k"), (2, "9 " * 200_000, "k"), (3, "+" * 300_000 + "@" * 300_000 + "1.1." * 100_000, "k")], "doc_id long, text string, hit string")
    got = {r.doc_id: r.base for r in pii.find(rows).collect()}
    assert [(x.kind, x.s, x.e) for x in got[1]] == [("email", len(WORDS) + 1, len(WORDS) + 7)] and got[2] == [] and len(got[3]) == 50_000 and pii.find(long).count() == 7


def test_decontamination(spark, long, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70_000, 70_040))), (2, "one one one"), (3, "x" * 400), (None, None)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.find(long, bench).collect()}
    assert got == {1: [1], 2: [1], 3: [3], 4: [2], 5: [], 6: []} and decontam.clean(long, bench).columns == long.columns
    assert decontam.find(empty, bench.limit(0)).count() == 0


def test_token_ids(long, empty):
    pytest.importorskip("public_tokenizers")
    got = tokenbin.token_output(long.sparkSession, long).collect()
    assert len(got) == 7 and sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 5, 6]
    by = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(by, by[1:], strict=False)) and {r.n_tokens for r in got if r.doc_id == 6} == {1}


def test_pipeline_on_odd_tables(spark, odd, empty, long, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, table in enumerate((odd, empty, long)):
        docs = table
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"t{i}-{n}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            assert n == 4 or docs.columns == table.columns
            assert i or n > 2 or docs.count() > 0  # mixing may leave out single documents that are larger than the budget of their source
        assert i != 1 or docs.count() == 0
