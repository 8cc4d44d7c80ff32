import numpy as np
import pyarrow as pa

from factweave.llm import html_extract, langid, toxicity


def test_language_accuracy(spark, corpus, odd, empty):
    df, rows = corpus
    model = langid.fit(df)
    lang = {i: x for i, _, x, _ in rows}
    got = langid.identify(df, model).withColumn("held", langid.held_out(langid.F.col("doc_id"), 4, 2)).filter("held").collect()
    assert len(got) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)
    by = {r.doc_id: r for r in langid.identify(odd, model, spans=True).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[8].lang_pred == "und" and by[8].score == 0
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_spans_and_viterbi(corpus):
    _, rows = corpus
    m = langid.train_model([r[2] for r in rows], [r[1] for r in rows])
    en, de = (next(r[1] for r in rows if r[2] == x).split()[:20] for x in ("en", "de"))
    _, _, found = langid.identify_batch(pa.array([" ".join(en + de + en)]), m)
    spans = langid.spans_of(*found, m.languages)[0]
    assert [s["lang"] for s in spans] == ["en", "de", "en"] and abs(spans[1]["first"] - 20) <= 2
    score = np.random.default_rng(2).normal(size=(40, 3)).astype(np.float32)
    offsets = np.array([0, 0, 7, 8, 25, 40])
    path = langid.viterbi(score, offsets, np.float32(1.0))
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):  # the best path's value, by plain dynamic programming
        if a == z:
            continue
        v = score[a].astype(float)
        for t in range(a + 1, z):
            v = np.maximum(v, v.max() - 1.0) + score[t]
        value = score[a, path[a]] + sum(score[t, path[t]] - (path[t] != path[t - 1]) for t in range(a + 1, z))
        assert abs(value - v.max()) < 1e-4


def test_toxicity(spark, corpus, odd, empty):
    df, rows = corpus
    bad = [(1000 + i, f"{t} you {w} {t[:40]}", x, s) for (i, t, x, s), w in zip(rows[:120], ["gromlak", "vilnuk", "dreckwurm"] * 40, strict=False)]
    docs = df.union(spark.createDataFrame(bad, df.schema))
    labels = spark.createDataFrame([(r[0], 0) for r in rows] + [(r[0], 1) for r in bad], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"), 5, 0)).filter("held").collect()
    assert sum((r.score >= 0.5) == (r.doc_id >= 1000) for r in got) >= 0.95 * len(got)
    masked = model.score(pa.array([f"{rows[0][1]} you gr0mlak g.r.o.m.l.a.k", rows[0][1]]))
    assert masked[0] > masked[1]
    out = toxicity.score(odd, model).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(odd, toxicity.fit(empty, labels.limit(0))).filter("score <> 0").count() == 0


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(y) >= -1e-12).all() and (np.diff(x) >= 0).all()


def test_pages(spark):
    m = html_extract.default_model()
    wrong = runs = 0
    for page in html_extract.labelled_pages(60, seed=123):
        want = [t for t in html_extract.Tree(page).text if t and t.startswith(html_extract.MARK)]
        got = m.text(page.replace(html_extract.MARK, "")).split("\n")
        want = [t.replace(html_extract.MARK, "") for t in want]
        wrong, runs = wrong + len(set(want) ^ set(got)), runs + len(want)
    assert wrong <= 0.02 * runs
    odd = ["", "<", "<!-- open", "<p>a &amp; b<p>c", "<script>x</script>", "<div" * 200, "plain words only in here.", None]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").selectExpr("page_id", "cast(null as string) as url", "html")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[0] == got[4] == got[7] == "" and got[3] == "a & b\nc"


#: Pages written apart from the generator's layouts, with what a reader would call their text.
PAGES = [
    ("""<html><head><title>T</title>stray text<meta charset=utf-8></head><body class="home-page"><div id="top-bar"><a href=/>Home</a> <a href=/a>About</a> <a href=/b>Blog</a></div>
     <div class="wrapper"><div class="post-content"><h1>A walk in the hills</h1><p>We left early, before the sun was up, and took the long way round.</p><p hidden>Not shown to anyone at all, this line.</p>
     <div style="color:red; display: none">Nor is this sentence, which is hidden.</div><figure><img src=x><figcaption>The ridge at dawn, seen from the north.</figcaption></figure>
     <p>By noon <span style="visibility:hidden">secret </span>we had reached the top &amp; rested.</p></div><div class="related-posts"><h3>Read more</h3><ul><li><a href=1>Lakes</a><li><a href=2>Rivers</a></ul></div></div>
     <div class="site-footer"><p>&copy; 2024 Hills Ltd.</p></div></body></html>""",
     "A walk in the hills\nWe left early, before the sun was up, and took the long way round.\nThe ridge at dawn, seen from the north.\nBy noon we had reached the top & rested."),
    ("""<body><header><h2>Daily News</h2><nav><ul><li><a href=#>World</a></li><li><a href=#>Sport</a></li></ul></nav></header><main><article><h1>Rates rise again</h1><p>The bank raised its rate on Tuesday, the third time this year.</p>
     <blockquote><p>It was needed, the governor said.</p></blockquote><ul><li>Loans cost more.</li><li>Savings earn more.</li></ul><table><tr><th>Year</th><td>Rate</td></tr></table></article>
     <section class="comments"><h3>3 comments</h3><div class="comment"><p>I do not agree with this at all, sorry.</p></div></section></main><aside class="sidebar"><p>Subscribe to our newsletter for more stories.</p></aside>
     <footer><p>Imprint and privacy.</p></footer></body>""",
     "Rates rise again\nThe bank raised its rate on Tuesday, the third time this year.\nIt was needed, the governor said.\nLoans cost more.\nSavings earn more.\nYear\nRate"),
    ("""<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article><p>First paragraph, without any heading.</section></div></nav><p>Second one after stray ends.
     <div class="ad">Buy now, cheap.</div><p data-hidden="hidden" title="the hidden gem">Third one stays.</article><form class="search"><label>Search the site</label><input></form>""",
     "First paragraph, without any heading.\nSecond one after stray ends.\nThird one stays."),
]


def test_pages_written_by_hand():
    m = html_extract.default_model()
    for page, want in PAGES:
        assert m.text(page) == want


def test_long_and_broken_pages_take_linear_time(spark, empty):
    import time

    def took(n):
        began = time.time()
        html_extract.Tree("<div>" * n + "</section>" * n)
        html_extract.Tree("<b>" * n + "</i>" * n + "<svg>" * n + "</select>" * n)
        return time.time() - began

    took(1000)
    assert took(40_000) < 25 * max(took(4_000), 0.02)
    long = "<article>" + "<p>A sentence of some words here.</p>" * 30_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", long, "k"), (1, "u", long, "k"), (None, None, "<p>Only this one sentence here.</p>", "k")], "page_id long, url string, html string, text string")
    got = html_extract.extract(rows).collect()
    assert all(r.text.count("\n") == 29_999 for r in got if r.page_id == 1)
    assert len(got) == 3 and html_extract.extract(rows.limit(0)).count() == 0


def test_toxicity_parts_do_not_leak(spark):
    """Random words that only single texts share teach nothing: held-out texts of random labels get scores near the base rate."""
    import random

    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(r.random() < 0.3)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    score = model.score(pa.array([t for _, t in rows]))
    assert abs(score.mean() - 0.3) < 0.1 and score.max() < 0.75


def test_flags_against_plain():
    """The Arrow kernels against one word at a time."""
    lex = toxicity.Lexicons(frozenset({"gromlak", "idiot", "schön"}), frozenset({"grom", "idio"}))
    words = ["gromlak", "GROMLAK!!", "g.r.o.m.l.a.k", "gr0mlak", "grooomlak", "schön", "sch0n", "...", "a", "you", "YOU", "it's", "x-y", "12", "a1b", "idiots,", "(idiot)", "é", "ÉÉ", "#$%", "don’t", "1d10t*", "漢字", "ﬁx"]
    got = lex.flags(pa.array(words))
    for w, row in zip(words, got, strict=True):
        p, letters, capitals = toxicity.plain(w), sum(c.isalpha() for c in w), sum(c.isupper() for c in w)
        inner, points = toxicity.EDGES.sub("", w), sum(c in ".,;:!?'\"-()" for c in w)
        u = toxicity.undone(w.rstrip("*#$%&"))
        want = [p in lex.words, len(p) >= 4 and p[:4] in lex.beginnings, p not in lex.words and p != "" and u != p and len(u) > 2 and u in lex.words, p in toxicity.SECOND, letters > 1 and capitals == letters, letters, capitals, w.count("!") + w.count("?"), points, len(w) - letters - sum(c.isdigit() for c in w) - points, bool(letters) and any(not c.isalpha() and c not in "'’-" for c in inner), len(w), len(p) == 1 and letters == 1]
        assert row.tolist() == [float(x) for x in want], w


def test_very_long_texts_and_clashing_columns(spark, odd):
    model = langid.train_model(["en", "de"], ["the and of to in is it you that " * 50, "der die und das ist nicht ein ich zu " * 50])
    long = spark.createDataFrame([(1, "the and of " * 200_000 + "der die das " * 10, "k", 1.0), (1, "der die das", "k", 1.0), (None, None, "k", 1.0)], "doc_id long, text string, score string, spans double")
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(long, model).collect()}
    assert got[1, "en"] > 0.9 and got[1, "de"] == 1 and got[None, "und"] == 0
    assert langid.keep_identified(long, model).columns == long.columns and langid.keep_identified(long, model).count() == 2
    assert langid.keep_identified(long.limit(0), model).count() == 0


def test_language_ties_and_many_languages():
    m = langid.train_model(["b", "a"], ["same words here"] * 2)
    names, score, _ = langid.identify_batch(pa.array(["same words"]), m)
    assert names == ["a"] and score[0] == 1  # of equal languages the first by name
    score = np.random.default_rng(1).normal(size=(50, 300)).astype(np.float32)
    path = langid.viterbi(score, np.array([0, 50]), np.float32(0.0))
    assert (path == score.argmax(axis=1)).all() and path.max() > 255


def test_silent_elements_end_with_their_parents():
    runs = lambda page: [t for t in html_extract.Tree(page).text if t]
    article = "<article><h1>Title of it</h1><p>A first sentence here.</p><p>Another.</p></article>"
    want = ["Title of it", "A first sentence here.", "Another."]
    assert runs('<form><datalist><option value="a"><option value="b">B</datalist></form>' + article) == want
    for name in ("button", "svg", "object", "canvas", "audio", "video", "select", "option", "noscript", "template"):
        assert runs(f"<body><{name} class=x>Gone" + article + "</body>") == want == runs(f"<div><{name}>Gone</div>" + article)
        assert runs(f"<body><{name}>Gone<b>too</b></{name}>" + article + f"<{name}><div><p>x</p></div></{name}>") == want
        assert runs(f"<p>One <{name}><div>gone</div></{name}> two.</p>") == ["One two."]
        assert runs(f"<p><a href=#><{name}>gone</a> stays.</p>")[-1:] == ["stays."]
    assert runs("<p>See <math><mi>x</mi><mo>=</mo><mn>1</mn></math> there.</p>") == ["See x = 1 there."]
    assert runs("<script>if (a < b) '<p>no</p>'</script><p>yes</p><textarea><p>no</p></textarea><svg><title>no</title><text>no</text></svg>") == ["yes"]
    m = html_extract.default_model()
    assert m.text('<form class=search><input><datalist><option value="a"><option value="b"></datalist></form>' + article) == "\n".join(want)


def test_marginals_are_exact():
    """Against the sum over all states of a small tree."""
    from itertools import product

    m = html_extract.default_model()
    tree = html_extract.Tree("<div><p>Some words.</p><nav>menu</nav></div>")
    own = [1 / (1 + np.exp(-sum(m.node.get(f, 0.0) for f in fs))) for fs in tree.features()]
    n, mass = len(own), np.zeros((len(own), 2))
    for s in product((0, 1), repeat=n):
        p = (m.prior if s[0] else 1 - m.prior) * np.prod([own[i] if s[i] else 1 - own[i] for i in range(n)])
        for i in range(1, n):
            e = m.edge[html_extract.KINDS.get(tree.tag[i], "box")][s[tree.parent[i]]]
            p *= e if s[i] else 1 - e
        for i in range(n):
            mass[i, s[i]] += p
    assert np.allclose(m.marginals(tree), mass[:, 1] / mass.sum(axis=1), atol=1e-6)


def plain_word(m, word):
    """A word's scores by language and its number of letters, one character at a time; None for words that no language is known for."""
    c = [32, *(ord(x) if x.isalpha() else 32 for x in word.lower()), 32]
    mask, bins, seen = (1 << 64) - 1, [], {}
    for i in range(1, len(c) - 1):
        if c[i] != 32:
            h = (c[i] + c[i - 1] * 0x9E3779B97F4A7C15 + c[i + 1] * 0xC2B2AE3D27D4EB4F) & mask
            bins.append((((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & mask) >> 48)
            script = langid.script_table()[c[i]]
            seen[script] = seen.get(script, 0) + 1
    if not bins:
        return None, 0
    most = min((s for s in seen if seen[s] == max(seen.values())), default=0)
    fits = m.scripts[most]
    if not fits.any():
        return None, len(bins)
    total = np.clip(m.trigrams[bins].astype(float).sum(axis=0), -langid.CAP, langid.CAP)
    return np.where(fits, total, langid.OUT_OF_SCRIPT), len(bins)


def test_word_scores_and_languages_against_plain(corpus):
    _, rows = corpus
    m = langid.train_model([r[2] for r in rows] + ["ru"], [r[1] for r in rows] + ["это не так просто как мы думали " * 30])
    texts = [r[1] for r in rows[:12]] + [f"{rows[0][1][:120]} {rows[1][1][:120]} это не так", "漢字 only here", "12 -- ...", "x9 ü-z", ""]
    names, score, _ = langid.identify_batch(pa.array(texts), m)
    for t, name, s in zip(texts, names, score, strict=True):
        found = [plain_word(m, w) for w in t.split()]
        each = [np.zeros(len(m.languages)) if v is None else v for v, _ in found]
        if not sum(n for _, n in found):
            assert (name, s) == ("und", 0)
            continue
        # the best path by trying each state for each word, with what each switch costs
        best, back = each[0], []
        for v in each[1:]:
            step = best[:, None] - langid.SWITCH * (1 - np.eye(len(best)))
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + v
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        letters = np.zeros(len(m.languages))
        for k, (v, n) in zip(reversed(path), found, strict=True):
            letters[k] += n * (v is not None)
        total = sum(n for _, n in found)
        # where two paths are equal but for rounding, a word at a border may go either way
        assert name == m.languages[letters.argmax()] and abs(s - letters.max() / total) < 0.02
