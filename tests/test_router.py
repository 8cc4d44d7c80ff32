import pytest

from factweave.operators.retrieval import NotFound
from factweave.plans import router

EDGES = [("claim: sleep improves memory", "memory"), ("claim: sleep improves memory", "sleep"), ("caffeine", "sleep"), ("caffeine", "alertness"), ("memory", "learning"), ("old claim", "sleep")]


@pytest.fixture(scope="module")
def graph(spark):
    ids = sorted({x for e in EDGES for x in e} | {"main street"})
    nodes = spark.createDataFrame([(x, "term" if x == "alertness" else "concept") for x in ids], "id string, type string").cache()
    edges = spark.createDataFrame([(a, b, None) for a, b in EDGES], "source string, target string, valid_to string").cache()
    return nodes, edges


@pytest.mark.parametrize(
    ("question", "lens", "concept", "to"),
    [
        ("How is caffeine connected to memory?", "path", "caffeine", "memory"),
        ("What lies between caffeine and learning?", "path", "caffeine", "learning"),
        ("Where does the material disagree?", "contradictions", None, None),
        ("What is the evidence that sleep improves memory?", "evidence", "claim: sleep improves memory", None),
        ("What backs or contradicts caffeine?", "evidence", "caffeine", None),
        ("How has sleep changed over time?", "history", "sleep", None),
        ("What is missing between caffeine and learning?", "gaps", "caffeine", "learning"),
        ("Where are the gaps?", "gaps", None, None),
        ("Give me an overview of the main topics", "overview", None, None),
        ("What is related to caffeine?", "concept", "caffeine", None),
        ("caffeine", "concept", "caffeine", None),
        ('Show me "lear"', "concept", "learning", None),
        ("What did we believe about sleep as of 2024-03-01?", "history", "sleep", None),
        ("What are the topics of alertness, with gaps missing?", "gaps", None, None),
    ],
)
def test_questions(graph, question, lens, concept, to):
    plan = router.choose(*graph, question)
    assert (plan["lens"], plan["concept"], plan["to"], plan["view"]) == (lens, concept, to, router.VIEW_FOR[lens])
    assert len(plan["alternatives"]) <= 3 and plan["why"] and plan["description"] == router.LENSES[lens]


def test_times_and_closed_relations(graph):
    plan = router.choose(*graph, "What did we think about sleep as of 2024-03-01?")
    assert plan["as_of"] == "2024-03-01T00:00:00Z" and plan["closed"]
    assert router.choose(*graph, "sleep in 2024")["as_of"] is None
    assert router.choose(*graph, "sleep 2024-03-01", as_of="2023-01-01T05:00:00Z")["as_of"] == "2023-01-01T05:00:00Z"
    assert not router.choose(*graph, "What backs caffeine?")["closed"]


@pytest.mark.parametrize(
    ("question", "said", "lenses"),
    [
        ("caffeine and learning", "What do you want to see about", ["path", "concept", "concept"]),
        ("How is caffeine connected?", "connects to what", ["path"]),
        ("Is there evidence?", "Which concept should the evidence view", ["evidence"]),
        ("Where are conflicts and gaps?", "two things", ["contradictions", "gaps"]),
        ("streets", "What are you trying", ["overview", "gaps", "history", "contradictions", "concept", "concept"]),
        ("tell me of improves", "Which of these", ["concept", "overview"]),
        ("hello", "What are you trying", ["overview", "gaps", "history", "contradictions", "concept", "concept"]),
        ('What about "lerning"?', "couldn't find", ["overview"]),
        ("When did caffeine, memory and learning change?", "names 3 concepts", ["history"] * 3 + ["path"]),
        ("How are caffeine, memory and learning connected?", "Which two", ["path"] * 3),
    ],
)
def test_questions_back(graph, question, said, lenses):
    with pytest.raises(router.NeedsClarification) as error:
        router.choose(*graph, question)
    got = [c["lens"] for c in error.value.choices]
    assert said in error.value.question and set(got) == set(lenses) and (len(got) == len(lenses) or len(set(lenses)) == 1)


def test_explicit_choices(graph):
    assert router.choose(*graph, lens="path", concept="caffeine", to="memory")["to"] == "memory"
    assert router.choose(*graph, lens="overview")["concept"] is None and router.choose(*graph, "sleep", view="map")["view"] == "map"
    assert [router.lens_for_view(v, c) for v, c in (("map", None), ("map", "x"), ("matrix", None), ("steps", None))] == ["overview", "concept", "gaps", "path"]
    for bad in (lambda: router.choose(*graph, lens="x"), lambda: router.choose(*graph, view="x"), lambda: router.lens_for_view("x")):
        with pytest.raises(router.Unknown):
            bad()
    with pytest.raises(NotFound):
        router.choose(*graph, lens="concept", concept="nothing like it")


def test_longest_names_win(graph):
    text = router.normal("Does “sleep improves memory” hold? Sleep improves memory, they say.")
    assert [(c, k) for _, c, k in sorted(router.named(graph[0], router.normal("sleep improves memory and caffeine")))] == [("claim: sleep improves memory", "concept"), ("caffeine", "concept")]
    assert text == " does sleep improves memory hold sleep improves memory they say "
