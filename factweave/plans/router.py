"""From a question to a view of a graph: what it asks for, the time it speaks of, the concepts that it names; or a question back where it doesn't say enough.

A question is read by fixed patterns (intents, in order), then concepts are looked up: its stretches of words are a small table that concepts join, so no list of all concepts passes through the driver. What
is still open is settled by `RULES`, one after another: each looks at the reading and either changes it or asks back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.retrieval import NotFound, open_degrees, resolve_one
from factweave.operators.store import stamp_of

#: Lenses with what they show, how many concepts each needs, and the view that shows it.
LENSES = {
    "overview": "the whole map: topics, central concepts and gaps",
    "concept": "one concept and its neighbourhood",
    "path": "how two concepts connect",
    "evidence": "what backs a claim, and what argues against it",
    "contradictions": "where the graph disagrees with itself",
    "history": "what changed over time, with closed relations shown",
    "gaps": "topics that should be linked but barely are",
}
NEEDS = {"path": 2, "evidence": 1, "concept": 1}
VIEW_FOR = {"overview": "rhythm", "concept": "map", "path": "steps", "evidence": "argument", "contradictions": "argument", "history": "timeline", "gaps": "matrix"}
LENS_FOR = {"timeline": "history", "argument": "contradictions", "matrix": "gaps", "rhythm": "overview", "steps": "path"}
VIEWS = ("map", *LENS_FOR)
#: What words show each intent, in order; what is a question for neighbours and no path; dates; quoted names; starts of labels that nobody says.
INTENTS = {
    "path": r"\bhow (?:does|do|is|are|did)\b.*\b(?:relate[sd]?|connect(?:s|ed)?|link(?:s|ed)?|lead(?:s)? to|affect(?:s|ed)?)\b|\bbetween\b.+\band\b|\bpath\b|\bconnection\b|\brelationship\b",
    "contradictions": r"\b(?:contradict\w*|disagree\w*|conflict\w*|inconsisten\w*|tensions?|disput\w*|at odds)\b",
    "evidence": r"\b(?:evidence|backs?|backed|backing|supports?|supported|supporting|proves?|proof|sources?|cites?|citations?|justif\w*|why (?:do|should) (?:we|i) (?:believe|trust)|is (?:it|this|that) true)\b",
    "history": r"\b(?:when|changed?|changes|changing|over time|history|historical|timeline|evolv\w*|used to|replaced|superseded|as of|back then|believe[ds]?|thought)\b",
    "gaps": r"\b(?:gaps?|missing|blind ?spots?|unexplored|under-?studied|overlooked|disconnected|not connected)\b",
    "overview": r"\b(?:overview|big picture|topics?|themes?|what is (?:this|it) about|landscape|summar\w*|whole graph|everything)\b",
}
NEIGHBOURS = r"\bwhat(?:'s| is| are)? (?:related|connected|linked) to\b|\bwhat (?:relates|connects|links) to\b"
DATE = r"\b(\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?z?)?)\b"
QUOTED = r"[\"“]([^\"”]+)[\"”]"
PREFIX = r"^(?:claim|finding|decision|question|review[^:]*|evidence|hypothesis):\s*"
#: Words that name no concept.
COMMON = frozenset("""
a about all an and any are at been between by can could did does find for from give graph has have here how in into is it its kind look main make many me more most much my need of on or our over part really see
should show some stuff tell than that the them then there they thing things this time to us use used view want was way we were what when where which who why will with worth would you your
""".split())
#: Characters before which an unquoted name is placed after every quoted one.
AFTER_QUOTED = 10_000


class NeedsClarification(ValueError):
    """The question to put to the person, and for each answer the arguments of `choose`."""

    code = "needs_clarification"

    def __init__(self, question: str, choices: list[dict], understood: dict):
        super().__init__(question)
        self.question, self.choices, self.understood = question, choices, understood


class Unknown(ValueError):
    code = "usage"


@dataclass
class Reading:
    """What a question says, as far as it is understood."""

    question: str
    intents: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)
    as_of: str | None = None
    lens: str | None = None
    given: bool = False  # whether concepts were named apart from the question
    unclear: list[NotFound] = field(default_factory=list)

    @property
    def understood(self) -> dict:
        return {"intents": list(self.intents), "concepts": list(self.concepts), "as_of": self.as_of}


def lens_for_view(view: str, concept: str | None = None) -> str:
    if view not in VIEWS:
        raise Unknown(f'Unknown view "{view}": use one of {", ".join(VIEWS)}')
    return LENS_FOR.get(view) or ("concept" if concept else "overview")


def normal(text: str) -> str:
    """Lower case, no punctuation, single blanks, a blank at either end."""
    bare = re.sub(r"\.(?=\s|$)", " ", re.sub(r"[?!,;()\[\]“”\"]", " ", text.lower().replace("’", "'")))
    return f" {' '.join(bare.split())} "


def intent_words() -> set[str]:
    return {w for pattern in INTENTS.values() for w in re.findall(r"[a-z]{3,}", pattern)}


def intents_of(text: str) -> list[str]:
    found = [name for name, pattern in INTENTS.items() if re.search(pattern, text)]
    drop = {"path"} if re.search(NEIGHBOURS, text) or "gaps" in found else set()
    return [x for x in found if x not in drop]


def named(nodes: DataFrame, text: str) -> list[tuple[int, str, str]]:
    """(place, concept, type) of concepts that stand in a normal text as whole words, under their label or without its prefix: longer ones first, none over another."""
    words = text.split()
    said = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    skip = COMMON | intent_words()
    said = sorted(x for x in said if len(x) >= 3 and x not in skip)
    if not said:
        return []
    spans = nodes.sparkSession.createDataFrame([(x,) for x in said], "said string")
    forms = nodes.select("id", "type", F.explode(F.array_distinct(F.array("id", F.regexp_replace("id", PREFIX, "")))).alias("said"))
    rows = sorted((-len(r.said), r.id, r.said != r.id, r.said, r.type) for r in forms.join(F.broadcast(spans), "said").collect())
    taken, out = [], []
    for _, concept, _, form, kind in rows:
        at = text.find(f" {form} ")
        end = at + len(form) + 1
        if at >= 0 and all(end <= a or z <= at for a, z in taken):
            taken.append((at, end))
            out.append((at, concept, kind))
    return out


def most_connected(edges: DataFrame, k: int, terms: list[str] | None = None) -> DataFrame:
    """(id, n): the k concepts with most open relations; with terms, of those whose labels have one of them as a word, shorter labels first among equals."""
    degree = open_degrees(edges).withColumnRenamed("degree", "n")
    if terms is None:
        return degree.orderBy(F.col("n").desc(), "id").limit(k)
    word = "|".join(re.escape(t) for t in terms)
    hit = F.col("id").rlike(rf"(?:^|[\s:-])(?:{word})(?:$|[\s-])") if terms else F.lit(False)
    return degree.filter(hit).orderBy(F.col("n").desc(), F.length("id"), "id").limit(k)


def connected(edges: DataFrame, k: int, terms: list[str] | None = None) -> list[str]:
    return [r.id for r in most_connected(edges, k, terms).collect()]


def read_question(nodes: DataFrame, edges: DataFrame, question: str, concept: str | None, to: str | None, as_of: str | None) -> Reading:
    text = normal(question)
    date = re.search(DATE, text)
    when = as_of or (date and date[1].upper().replace(" ", "T"))
    r = Reading(question, intents_of(text), as_of=when and stamp_of(nodes.sparkSession, when))
    quoted: list[tuple[int, str]] = []
    for m in re.finditer(QUOTED, question):
        try:
            quoted.append((question.find(m[1]), resolve_one(nodes, edges, m[1])))
        except NotFound as error:
            error.name = m[1]
            r.unclear.append(error)
    rest = named(nodes, normal(re.sub(QUOTED, " ", question))) if question else []
    places = sorted([*quoted, *((AFTER_QUOTED + at, x) for at, x, _ in rest)])
    found = list(dict.fromkeys(x for _, x in places))
    # a common word of a word network is no subject of a question for the whole
    weak = {x for _, x, kind in rest if kind == "term"} - {x for _, x in quoted}
    if r.intents and set(r.intents) <= {"overview", "gaps"} and " between " not in text:
        found = [x for x in found if x not in weak]
    given = [resolve_one(nodes, edges, x) for x in (concept, to) if x]
    r.concepts, r.given = given or found, bool(given)
    return r


def choice(lens: str, label: str, concept: str | None = None, to: str | None = None, as_of: str | None = None) -> dict:
    return {"lens": lens, "label": label, "concept": concept, "to": to, "as_of": as_of}


# --- rules -------------------------------------------------------------------------------------------------------------------


def ask_for_unknown_name(r: Reading, nodes: DataFrame, edges: DataFrame) -> None:
    if not r.unclear:
        return
    first = r.unclear[0]
    want = r.lens or next((x for x in r.intents if x not in ("history", "overview")), "concept")
    choices = []
    for s in first.suggestions[:5]:
        if want == "path" and r.concepts:
            choices.append(choice("path", f"“{s}” and “{r.concepts[0]}”", s, r.concepts[0], r.as_of))
        else:
            choices.append(choice(want if NEEDS.get(want, 0) < 2 else "concept", f"“{s}”", s, None, r.as_of))
    raise NeedsClarification(f"I couldn't find “{first.name}” in this graph. Which concept did you mean?", choices or [choice("overview", "show the whole map instead", as_of=r.as_of)], r.understood)


def choose_lens(r: Reading, nodes: DataFrame, edges: DataFrame) -> None:
    if r.lens:
        return
    if r.concepts and {"evidence", "contradictions"} <= set(r.intents):
        r.intents.remove("contradictions")
    # beside another intent these two only say how to show it
    main = [x for x in r.intents if len(r.intents) == 1 or x not in ("history", "overview")]
    if len(main) > 1:
        choices = [choice(x, LENSES[x], None if x == "gaps" or not r.concepts else r.concepts[0], r.concepts[1] if x == "path" and len(r.concepts) > 1 else None, r.as_of) for x in main]
        raise NeedsClarification("That asks two things. Which do you want to see first?", choices, r.understood)
    if main == ["overview"] and r.concepts:
        main = []
    r.lens = main[0] if main else "history" if "history" in r.intents else "concept" if len(r.concepts) == 1 else None


def ask_about_two(r: Reading, nodes: DataFrame, edges: DataFrame) -> None:
    if r.lens or len(r.concepts) < 2:
        return
    a, b = r.concepts[:2]
    raise NeedsClarification(f"What do you want to see about “{a}” and “{b}”?", [choice("path", f"how “{a}” connects to “{b}”", a, b, r.as_of), *(choice("concept", f"“{x}” and its neighbourhood", x, None, r.as_of) for x in (a, b))], r.understood)


def ask_what_is_meant(r: Reading, nodes: DataFrame, edges: DataFrame) -> None:
    if r.lens:
        return
    skip = COMMON | intent_words()
    near = connected(edges, 5, [w for w in re.findall(r"[a-z0-9][a-z0-9.\-]{2,}", r.question.lower()) if w not in skip])
    if near:
        raise NeedsClarification("Which of these do you mean? I couldn't match the question to one concept.", [*(choice("concept", f"“{x}”", x, None, r.as_of) for x in near), choice("overview", "none of these: show the big picture", as_of=r.as_of)], r.understood)
    whole = [choice("overview", "the big picture: topics and central concepts", as_of=r.as_of), choice("gaps", "what is missing between topics", as_of=r.as_of), choice("history", "what changed over time"), choice("contradictions", "where the material disagrees", as_of=r.as_of)]
    raise NeedsClarification("What are you trying to find out? I couldn't tell from the question.", [*whole, *(choice("concept", f"one concept, for example “{x}”", x, None, r.as_of) for x in connected(edges, 2))], r.understood)


def ask_for_missing(r: Reading, nodes: DataFrame, edges: DataFrame) -> None:
    if len(r.concepts) >= NEEDS.get(r.lens, 0):
        return
    others = [x for x in connected(edges, 6) if x not in r.concepts]
    if r.lens == "path" and r.concepts:
        a = r.concepts[0]
        raise NeedsClarification(f"How “{a}” connects to what? Name the second concept.", [choice("path", f"“{a}” and “{x}”", a, x, r.as_of) for x in others[:4]], r.understood)
    after = [*others[1:], None]
    raise NeedsClarification(f"Which concept should the {r.lens} view be about?", [choice(r.lens, f"“{x}”", x, y if r.lens == "path" else None, r.as_of) for x, y in list(zip(others, after, strict=True))[:4]], r.understood)


def ask_for_fewer(r: Reading, nodes: DataFrame, edges: DataFrame) -> None:
    n = len(r.concepts)
    if r.lens in ("path", "gaps") and n > 2:
        first = r.concepts[:4]
        pairs = [(a, b) for i, a in enumerate(first) for b in first[i + 1 :]]
        raise NeedsClarification("Which two concepts do you mean?", [choice(r.lens, f"“{a}” and “{b}”", a, b, r.as_of) for a, b in pairs[:5]], r.understood)
    if r.lens in ("evidence", "concept", "history", "contradictions") and n > 1 and not r.given:
        each = [choice(r.lens, f"“{x}”", x, None, r.as_of) for x in r.concepts[:5]]
        raise NeedsClarification(f"The question names {n} concepts. Which one should the view be about?", [*each, choice("path", f"how “{r.concepts[0]}” connects to “{r.concepts[1]}”", *r.concepts[:2], r.as_of)], r.understood)


RULES: tuple[Callable[[Reading, DataFrame, DataFrame], None], ...] = (ask_for_unknown_name, choose_lens, ask_about_two, ask_what_is_meant, ask_for_missing, ask_for_fewer)


def why(lens: str, concept: str | None, to: str | None, as_of: str | None) -> str:
    when = f" as it stood on {as_of[:10]}" if as_of else ""
    about = f" about “{concept}”" if concept else ""
    return {
        "overview": f"The whole map{when}: its topics, its most central concepts and the gaps between topics.",
        "concept": f"“{concept}” and what is linked to it{when}.",
        "path": f"The steps from “{concept}” to “{to}”{when}.",
        "evidence": f"What backs “{concept}” and what argues against it{when}, with the passages.",
        "contradictions": f"Where the graph disagrees{about or ' with itself'}{when}, closed relations too.",
        "history": f"What was said{about} over time{when}, closed relations too.",
        "gaps": f"How far “{concept}” and “{to}” are apart{when}." if concept and to else f"Topics that should be linked but barely are{when}.",
    }[lens]


def alternatives(lens: str, concepts: list[str], as_of: str | None) -> list[dict]:
    """Up to three other views of the same concepts."""
    out = []
    if concepts:
        out += [choice("evidence", f"what backs “{concepts[0]}”", concepts[0], None, as_of)] * (lens != "evidence") + [choice("history", f"how “{concepts[0]}” changed over time", concepts[0])] * (lens != "history")
    if len(concepts) > 1 and lens not in ("path", "gaps"):
        out.append(choice("path", f"how “{concepts[0]}” connects to “{concepts[1]}”", *concepts[:2]))
    if lens != "overview":
        out.append(choice("overview", "the whole map", as_of=as_of))
    return out[:3]


def choose(nodes: DataFrame, edges: DataFrame, question: str | None = None, lens: str | None = None, concept: str | None = None, to: str | None = None, as_of: str | None = None, view: str | None = None) -> dict:
    """lens, view, concept, to, as_of, closed (whether closed relations are shown), why, alternatives and what was understood, for a question or explicit choices over nodes(id, type) and
    edges(source, target, valid_to). Raises NeedsClarification where the question doesn't say enough."""
    if lens is not None and lens not in LENSES:
        raise Unknown(f'Unknown lens "{lens}": use one of {", ".join(LENSES)}')
    if view is not None and view not in VIEWS:
        raise Unknown(f'Unknown view "{view}": use one of {", ".join(VIEWS)}')
    r = read_question(nodes, edges, (question or "").strip(), concept, to, as_of)
    r.lens = lens
    for rule in RULES:
        rule(r, nodes, edges)
    places = {"overview": 0, "path": 2, "gaps": 2}.get(r.lens, 1)
    first, second = ([*r.concepts[:places], None, None])[:2]
    return {
        "lens": r.lens, "view": view or VIEW_FOR[r.lens], "concept": first, "to": second, "as_of": r.as_of, "closed": r.lens in ("history", "contradictions") or "history" in r.intents,
        "question": r.question or None, "why": why(r.lens, first, second, r.as_of), "alternatives": alternatives(r.lens, [x for x in (first, second) if x] or r.concepts, r.as_of),
        "understood": r.understood, "description": LENSES[r.lens],
    }
