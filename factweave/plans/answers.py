"""Answers that a model writes: each is a document of the graph, a prompt made of it, and what becomes of the reply. `host_task` gives the same material to a caller that is itself the model."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factweave.operators import view
from factweave.operators.retrieval import NotFound
from factweave.operators.store import Store, StoreError, stamp_of
from factweave.plans import documents as D
from factweave.plans.models import Complete, ask_json, route

ASK = "Answer the question from the numbered context and nothing else. After each statement put the numbers that it rests on in square brackets, such as [2] or [3][5]. Where the context doesn't answer, say what is missing; where it disagrees with itself, say so. Be short and plain."
REPORT = 'You get the concepts and relations of one topic of a graph. Reply with JSON only: {"title": "a short name", "summary": "two or three plain sentences", "findings": ["up to five statements that the relations support"]}'
QUESTIONS = 'You get pairs of topics of a graph that have hardly any links. Propose questions whose answers would link them. Reply with JSON only: [{"gap": 0, "question": "...", "why": "one sentence", "bridges": ["a concept of the first topic", "a concept of the second"]}]'
RECONCILE = 'You get pairs of statements about the same two concepts. Say of each pair whether it contradicts, supersedes (and whether "a" or "b" is the newer one) or is compatible. Reply with JSON only: [{"pair": 0, "verdict": "contradicts, supersedes or compatible", "newer": "a, b or null", "reason": "one sentence"}]'
VERDICTS = ("contradicts", "supersedes", "compatible")


class NothingThere(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def ask(store: Store, question: str, complete: Complete | None = None, budget: int = 12_000, as_of: str | None = None) -> dict:
    """An answer with the context items that it cites."""
    complete = route(complete, without="`context` gives the same numbered material.")
    items = D.context(D.stored(store), question, budget, _time(store, as_of)).orderBy("n").collect()
    if not items:
        raise NothingThere("no_context", "Nothing in the graph matches this question")
    text = "\n".join(f"[{r.n}] {r.text}" for r in items)
    answer = complete(ASK, f"Context:\n{text}\n\nQuestion: {question}").strip()
    used = {int(n) for n in re.findall(r"\[(\d+)\]", answer)}
    return {"question": question, "answer": answer, "citations": [r.asDict() for r in items if r.n in used], "context_size": len(text)}


def report(store: Store, complete: Complete | None = None, top: int = 5, as_of: str | None = None, save: bool = True) -> list[dict]:
    """Titles, summaries and findings of the largest topics of three concepts and more; saved, they name the topics from then on."""
    complete, at = route(complete, without="`communities` lists each topic's concepts."), _time(store, as_of)
    g = D.stored(store)
    pairs = g.pairs(at)
    labels, cent = D.group(g, pairs), D.settle(D.centrality(pairs))
    near = D.settle(view.proximity(g.near))
    out, rows = [], []
    for t in D.topics(labels, cent, 25).filter("size >= 3").orderBy("label").limit(top).collect():
        said = g.now(at).filter(F.col("source").isin(*t.members) & F.col("target").isin(*t.members) & (F.col("method") != "cooccurrence")).orderBy("valid_from", "id").limit(80).collect()
        lines = [f"{e.source} --{e.relation}--> {e.target}: {e.description}" for e in said]
        if len(lines) < 3:
            both = near.filter(F.col("a").isin(*t.members) & F.col("b").isin(*t.members)).orderBy(F.col("shared").desc(), "a", "b").limit(20).collect()
            lines += [f"{p.a} and {p.b} stand together in {p.shared} passages" for p in both]
        reply = ask_json(complete, REPORT, f"Concepts: {', '.join(t.members)}\n\nRelations:\n" + "\n".join(lines), _report)
        every = [r.node for r in labels.filter(F.col("label") == t.label).collect()]
        rows.append((every, reply["title"], reply["summary"], reply["findings"]))
        out.append({"community": t.label, "size": t["size"], "top": t.members[:8], **reply})
    if save and rows:
        store.record_reports(store.spark.createDataFrame(rows, "members array<string>, title string, summary string, findings array<string>"), "factweave:report")
    return out


def questions(store: Store, complete: Complete | None = None, between: tuple[str, str] | None = None, top: int = 3, per_gap: int = 2, save: bool = False, as_of: str | None = None) -> list[dict]:
    """Questions whose answers would bridge the largest gaps, or the one between two concepts. Saved, each is a concept of type question that bridges those it names."""
    complete, g = route(complete, without="`gaps` lists each gap and the concepts beside it."), D.stored(store)
    if between:
        a, b = (g.resolve(x) for x in between)
        found = [(*D.between(g, a, b, _time(store, as_of))["topics"], [a], [b])]
    else:
        found = [(r.topic_a, r.topic_b, r.bridge_a, r.bridge_b) for r in D.gaps(g, _time(store, as_of), top).collect()]
    if not found:
        raise NothingThere("no_gaps", "The graph has no structural gaps to ask about")
    prompt = "\n".join(f"Gap {i}: [{ta}] with {', '.join(a)}, and [{tb}] with {', '.join(b)}" for i, (ta, tb, a, b) in enumerate(found))
    asked = ask_json(complete, QUESTIONS, f"{prompt}\n\nGive {per_gap} questions for each gap.", _questions)
    if save:
        for q in asked:
            for name in (q.get("bridges") or [])[:2]:
                try:
                    store.relate(q["question"], "bridges", g.resolve(name), description=q.get("why") or "", source_type="question", agent="factweave:questions")
                except (NotFound, StoreError):  # a name that the model made up bridges nothing
                    continue
    return asked


def reconcile(store: Store, complete: Complete | None = None, concept: str | None = None, limit: int = 20, apply: bool = True) -> list[dict]:
    """Judgements of opposed pairs, or where none looks opposed of any two relations of the same concepts: recorded, and the older of two is closed where one supersedes the other."""
    complete, g = route(complete, without="`contradictions` lists the pairs."), D.stored(store)
    focus = g.resolve(concept) if concept else None
    found = D.contradictions(g, focus, limit=limit)["candidates"].select("edge_a", "edge_b").collect()
    if not found:
        found = D.same_concepts(D.temporal.edges_of(g.edges, focus), limit).collect()
    if not found:
        return []
    ids = {x for r in found for x in (r.edge_a, r.edge_b)}
    by = {r.id: r for r in g.edges.filter(F.col("id").isin(*ids)).collect()}
    say = lambda e: f"{e.source} {e.relation} {e.target}: {e.description} [added {e.valid_from}]"
    prompt = "\n".join(f"Pair {i}: (a) {say(by[r.edge_a])}\n        (b) {say(by[r.edge_b])}" for i, r in enumerate(found))
    judged, rows, closings = [], [], []
    for v in ask_json(complete, RECONCILE, prompt, _verdicts):
        n = v.get("pair")
        if not isinstance(n, int) or not 0 <= n < len(found):
            continue
        a, b = found[n].edge_a, found[n].edge_b
        rows.append((a, b, v["verdict"], v.get("reason") or ""))
        item = {"a": a, "b": b, "verdict": v["verdict"], "reason": v.get("reason") or ""}
        if v["verdict"] == "supersedes" and v.get("newer") in ("a", "b"):
            item["closed"], new = (b, a) if v["newer"] == "a" else (a, b)
            if apply and by[item["closed"]].valid_to is None and item["closed"] not in {x for x, _, _ in closings}:
                closings.append((item["closed"], new, v.get("reason") or ""))
        judged.append(item)
    if apply and rows:
        store.record_conflicts(store.spark.createDataFrame(rows, "edge_a string, edge_b string, verdict string, reason string"), "factweave:reconcile")
        if closings:
            store.supersede(store.spark.createDataFrame(closings, "edge string, by string, reason string"), agent="factweave:reconcile")
    return judged


def host_task(store: Store, capability: str = "ask", question: str = "", between: tuple[str, str] | None = None, concept: str | None = None, as_of: str | None = None, budget: int = 12_000) -> dict:
    """What to do and the material to do it with; no model is asked."""
    g, at = D.stored(store), _time(store, as_of)
    if capability == "ask":
        return {"task": ASK, "question": question, "context": D.context(g, question, budget, at)}
    if capability == "report":
        return {"task": REPORT, "communities": D.communities(g, at)["communities"]}
    if capability == "questions":
        return {"task": QUESTIONS, "gaps": D.between(g, *(g.resolve(x) for x in between), at) if between else D.gaps(g, at)}
    if capability == "reconcile":
        return {"task": RECONCILE, "contradictions": D.contradictions(g, g.resolve(concept) if concept else None, at)}
    raise NothingThere("usage", f'"{capability}" has no host task: use ask, report, questions or reconcile')


def _time(store: Store, as_of: str | None):
    return None if as_of is None else F.lit(stamp_of(store.spark, as_of))


def _report(v) -> dict:
    if not isinstance(v, dict) or not v.get("title") or not v.get("summary"):
        raise ValueError("expected an object with title, summary and findings")
    return {"title": str(v["title"]), "summary": str(v["summary"]), "findings": [str(x) for x in v.get("findings") or []][:5]}


def _listed(v, key: str) -> list:
    v = v.get(key, []) if isinstance(v, dict) else v
    if not isinstance(v, list) or not all(isinstance(x, dict) for x in v):
        raise ValueError(f"expected a list of {key}")
    return v


def _questions(v) -> list:
    found = _listed(v, "questions")
    if not all(x.get("question") for x in found):
        raise ValueError("each item needs a question")
    return found


def _verdicts(v) -> list:
    found = _listed(v, "verdicts")
    if not all(x.get("verdict") in VERDICTS for x in found):
        raise ValueError("each verdict must be one of " + ", ".join(VERDICTS))
    return found
