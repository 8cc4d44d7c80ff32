"""Model-backed operators through a hook complete(system, prompt) -> str: reading JSON replies, asking with one repair, and batches of prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Complete = Callable[[str, str], str]
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


class ReplyInvalid(ValueError):
    code = "reply_invalid"


def extract_json(reply: str):
    """The first JSON value in a reply: fenced blocks first, then from the first bracket to the last one."""
    tries = [*FENCE.findall(reply)]
    starts = [i for i in (reply.find("{"), reply.find("[")) if i >= 0]
    if starts:
        tries.append(reply[min(starts) : max(reply.rfind("}"), reply.rfind("]")) + 1])
    for text in tries:
        try:
            return json.loads(text)
        except ValueError:
            continue
    raise ReplyInvalid("no JSON in the reply")


def ask_json(complete: Complete, system: str, prompt: str, check: Callable = lambda x: x):
    """A checked JSON reply; the error goes back once."""
    reply = complete(system, prompt)
    try:
        return check(extract_json(reply))
    except ValueError as error:
        try:
            return check(extract_json(complete(system, f"{prompt}\n\nThe last reply could not be used: {error}. Reply with JSON only.")))
        except ValueError as again:
            raise ReplyInvalid(str(again)) from again


#: What a model is asked for: relations of a passage.
EXTRACT = """Read the passage between the backticks and list the relations between concepts that it states or clearly implies. Reply with a JSON list and nothing else. Each item is an object:
{"node_1": "a concept", "node_1_type": "concept, claim, person, place, method or event", "node_2": "another concept", "node_2_type": "as above", "relation": "a short verb phrase, such as supports or depends_on",
"edge": "one sentence that states the relation", "confidence": 0.0 to 1.0, "evidence": "the words of the passage that show it"}. Use the same name for the same concept throughout, in the singular, and leave out
what the passage doesn't say."""


def usable_triples(value) -> list[dict]:
    """A reply's list of relations, bare or in an object as triples, relations, edges or items. No list, or one without any usable item though it has some, is an error."""
    from factweave.operators.retrieval import plain_key

    if isinstance(value, dict):
        value = next((value[k] for k in ("triples", "relations", "edges", "items") if isinstance(value.get(k), list)), value)
    if not isinstance(value, list):
        raise ValueError("expected a JSON list of relations")
    ends = lambda x: [next((x[k] for k in names if x.get(k)), "") for names in (("node_1", "from", "subject", "source"), ("node_2", "to", "object", "target"))]
    keys = [[plain_key(e) for e in ends(x)] if isinstance(x, dict) else ["", ""] for x in value]
    good = [x for x, (a, b) in zip(value, keys, strict=True) if a and b and a != b]
    if value and not good:
        raise ValueError("no relation in the list has two different concepts")
    return good


def command(line: list[str], timeout: float = 300) -> Complete:
    """A hook that runs an external command: the system text and the prompt on its standard input, the reply from its standard output."""
    import subprocess

    def complete(system: str, prompt: str) -> str:
        done = subprocess.run(line, input=f"{system}\n\n{prompt}", capture_output=True, text=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(done.stderr.strip()[-500:] or f"the command ended with {done.returncode}")
        return done.stdout

    return complete


class NoModel(ValueError):
    code = "missing_prerequisite"


def route(complete: Complete | None = None, line: list[str] | None = None, without: str = "") -> Complete:
    """The hook to ask: one that is given, else an external command; without either an error that says how to go on without a model."""
    if complete is not None:
        return complete
    if line:
        return command(line)
    raise NoModel(f"This needs a model: give a complete(system, prompt) hook or a command. {without}".strip())


def complete_all(prompts: DataFrame, complete: Complete, system: str, check: Callable = lambda x: x) -> DataFrame:
    """(id, ok, reply, error) for prompts(id, prompt): a failed call fails its row alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, prompt in zip(p["id"], p["prompt"], strict=True):
                try:
                    rows.append((i, True, json.dumps(ask_json(complete, system, prompt, check)), None))
                except Exception as error:  # noqa: BLE001 - whatever a hook raises belongs to its row
                    rows.append((i, False, None, str(error)))
            yield pd.DataFrame(rows, columns=["id", "ok", "reply", "error"])

    return prompts.select("id", "prompt").mapInPandas(run, "id string, ok boolean, reply string, error string")
