import pytest

#: Odd rows: nulls, empty and blank texts, repeats, and a table's own columns with names that operators use inside.
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "word", "en", "b"), (5, "same text here for all of us", "en", "b"), (6, "same text here for all of us", "de", None), (6, "same text here for all of us", "de", None), (None, "a text without an id", "en", "a"), (7, "x" * 300_000, "en", "a"), (8, "12345 ### !!!", None, "a"), (9, "y z " * 50_000, "fr", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", 1.0, "l") for r in ODD], SCHEMA + ", id int, key string, weight double, label string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def corpus(spark):
    """Invented prose in two languages with near copies, and labels."""
    import random

    r = random.Random(5)
    stems = {"en": "the and ing tion er ly wh sh ou ea".split(), "de": "sch ung heit ich ein ver der pf zu äu".split()}

    def word(lang):
        return "".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3)))

    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        if i % 6 == 5:
            w = rows[-1][1].split(" ")
            for _ in range(r.choice((0, 1, 3, 8, 14))):
                w[r.randrange(len(w))] = word(lang)
            rows.append((i, " ".join(w), rows[-1][2], "s0"))
        else:
            rows.append((i, " ".join(word(lang) for _ in range(r.randint(30, 120))), lang, f"s{i % 4}"))
    return spark.createDataFrame(rows, SCHEMA), rows
