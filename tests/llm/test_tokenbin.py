import zlib

import numpy as np
import pytest

from factweave.llm import tokenbin


def test_segments_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        counts = r.integers(1, 90, n)
        ids = r.integers(0, 60_000, int(counts.sum())).astype("<u2")
        keys = np.sort(r.integers(-(1 << 62), 1 << 62, n)) if n % 2 else np.sort(r.integers(-5, 40, n))
        nulls = np.arange(n) < n // 3
        s = tokenbin.Segment(tokenbin.pack(np.where(nulls, 0, keys), nulls, counts, ids))
        ends = np.cumsum(counts).tolist()
        assert [s.bounds(i) for i in range(n)] == list(zip([0, *ends[:-1]], ends, strict=True)) if n else s.n == 0
        assert [s.doc_id(i) for i in range(n)] == [None if z else k for k, z in zip(keys.tolist(), nulls, strict=True)]
        assert (s.ids == ids).all() and all((s.document(i) == ids[a:b]).all() for i, (a, b) in enumerate(map(s.bounds, range(n))))


def test_boundaries_are_near_their_bound():
    n = 5000
    counts = np.random.default_rng(3).integers(1, 2000, n)
    size = len(tokenbin.pack_rising(np.cumsum(counts)))
    assert 8 * size <= n * (2 + np.log2(counts.sum() / n) + 1) + 8 * 200


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(sorted(set(pre_tokenizers.ByteLevel.alphabet())))}, merges=[]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "bytes.json"))
    enc = tokenbin.Encoder(str(tmp_path / "bytes.json"))
    assert not enc.by_words
    texts = ["Two  Words", "", None, " a\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokenbin.token_output(spark, rows, tokenizer=str(tmp_path / "bytes.json"), end_id=7).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 7], "<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_whole_text_ids(spark, corpus, odd, empty, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    assert tokenbin.encoder(public.path("word_bpe_49k.json")).by_words
    df, rows = corpus
    hard = [(900, "It's WE'RE l'été İstanbul ß! a,b.c #tag $$ ½ 12.5 <|endoftext|> x<|endoftext|>y ΣΑΣ", None, None), (901, "naïve—co-op… 漢字   nbsp", None, None)]
    path = str(tmp_path / "t")
    tokenbin.write(df.union(spark.createDataFrame(hard, df.schema)), path, segment_ids=500)
    got = {r.doc_id: r for r in tokenbin.read(spark, path).collect()}
    start = 0
    for i, text, *_ in sorted(rows + hard):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenbin.export(spark, path, str(tmp_path / "files")) > 4
    assert sorted((r.doc_id is None, r.n_tokens) for r in tokenbin.token_output(spark, odd.filter("doc_id is null or doc_id < 5")).collect())[0] == (False, 1)
    assert tokenbin.token_output(spark, empty).collect() == []
