from factweave.llm import neardup


def sets(rows, size):
    out = {}
    for i, t, *_ in rows:
        w = [x for x in (t or "").lower().split() if x]
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def brute(rows, size, percent=80):
    s = sets(rows, size)
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def test_against_all_pairs(corpus):
    df, rows = corpus
    for size in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size).collect()}
        assert got == brute(rows, size)
    kept = {r.doc_id for r in neardup.keep_first(df, 5).collect()}
    assert kept == {i for i, (_, c) in brute(rows, 5).items() if i == c}


def test_odd_rows(odd, empty):
    got = neardup.near_duplicates(odd, 2).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[6].component_id == 5 and not by[6].kept
    assert by[None].component_id is None and by[None].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1
    assert neardup.near_duplicates(empty).collect() == []
    assert set(neardup.keep_first(odd, 2).columns) == set(odd.columns)


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.id: r.label for r in neardup.components(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
