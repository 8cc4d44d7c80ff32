"""What callers outside of Spark use: each capability by name with JSON arguments, as a command line, as JSON-RPC tools over standard input and output, and as a live page over HTTP.

A capability is a function over a `Store` with annotated arguments; its schema is read off these. Results are plain values: of tables the first `ROWS` rows, and `more` where there are others.
"""

from __future__ import annotations

import inspect
import json
import sys
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import UnionType
from typing import Any, get_args, get_type_hints
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factweave.operators import retrieval
from factweave.operators.store import EVENT_KINDS, FORMAT, METHODS, Store, list_graphs, stamp_of
from factweave.plans import answers, models, router
from factweave.plans import documents as D
from factweave.sources import readers, sinks

ROWS = 1000
#: Exit codes by kind of error; 1 for any other.
EXIT = {"usage": 2, "missing_argument": 2, "invalid_input": 3, "needs_clarification": 3, "not_found": 4, "graph_not_found": 4, "already_closed": 4, "no_context": 4, "no_gaps": 4, "missing_prerequisite": 5, "graph_too_large": 6, "model_call_failed": 7, "reply_invalid": 7}
INTERRUPTED = 130
PROTOCOL, NAME = "2024-11-05", "factweave"


def plain(value: Any) -> Any:
    """Tables, rows and what holds them as JSON values."""
    if isinstance(value, DataFrame):
        rows = value.limit(ROWS + 1).collect()
        found = [r.asDict(recursive=True) for r in rows[:ROWS]]
        return found if len(rows) <= ROWS else {"rows": found, "more": True}
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


CAPABILITIES: dict[str, Callable] = {}


def capability(f: Callable) -> Callable:
    CAPABILITIES[f.__name__.rstrip("_")] = f
    return f


def _at(store: Store, as_of: str | None):
    return None if as_of is None else F.lit(stamp_of(store.spark, as_of))


def _counted(store: Store, change: Callable[[], Any]) -> dict:
    """What a change gives, with how many concepts and relations it added."""
    total = lambda: store.counts().first()
    before = total()
    found = change()
    after = total()
    added = {"nodes_added": after.nodes - before.nodes, "edges_added": after.edges + after.closed_edges - before.edges - before.closed_edges}
    return {"graph": store.name, **(plain(found) if isinstance(found, dict) else {"result": plain(found)}), **added, "totals": {"nodes": after.nodes, "edges": after.edges}}


def _parsed(store: Store, value: Any) -> DataFrame:
    return store.spark.createDataFrame([(json.dumps(value),)], "v string").select(F.parse_json("v").alias("j"))


@capability
def ingest(store: Store, text: str | None = None, path: str | None = None, uri: str = "", title: str = "", method: str = "agent", agent: str = "", session: str = "", at: str | None = None, max_chunks: int | None = None, min_count: int | None = None, force: bool = False, command: list | None = None) -> dict:
    """Read a text, a file or a folder into the graph. With method agent the chunks come back with the prompt to extract relations by, for `add`."""
    docs = readers.inline(store.spark, text, uri, title) if text is not None else readers.folder(store.spark, path or "")
    hook = models.route(None, command, "Method agent gives the chunks and the prompt.") if method == "llm" else None

    def change() -> dict:
        report = store.ingest(docs, method, agent, session, at, max_chunks=max_chunks, min_count=min_count, force=force, complete=hook)
        return {"sources": report.orderBy("place"), **(agent_task(store, report) if method == "agent" else {})}

    return _counted(store, change)


def agent_task(store: Store, report: DataFrame) -> dict:
    """The chunks of all sources of an ingest report, also of those that were read before, and the prompt."""
    chunks = store.chunks().join(report.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return {"task": {"system": models.EXTRACT, "chunks": chunks.orderBy("source_id", "idx").select("id", "text")}}


@capability
def add(store: Store, payload: dict, agent: str = "", session: str = "", at: str | None = None) -> dict:
    """Load concepts and relations: {nodes, edges, triples, supersede, source}, or a list of relations."""
    body = {"edges": payload} if isinstance(payload, list) else payload
    raw = _parsed(store, body)
    nodes = [x if isinstance(x, dict) else {"label": x} for x in body.get("nodes") or []]
    rows = [(i, x.get("label"), x.get("type"), x.get("summary"), {str(k): str(v) for k, v in (x.get("attrs") or {}).items()}) for i, x in enumerate(nodes)]
    named = store.spark.createDataFrame(rows, "seq long, label string, type string, summary string, attrs map<string,string>") if rows else None
    close = [(x["edge"], x.get("by"), x.get("reason") or "") for x in body.get("supersede") or []]
    closings = store.spark.createDataFrame(close, "edge string, by string, reason string") if close else None
    return _counted(store, lambda: {"skipped": store.add(readers.relation_items(readers.payload(raw)), named, closings, body.get("agent") or agent, body.get("session") or session, at, body.get("source"))})


@capability
def relate(store: Store, source: str, relation: str, target: str, description: str = "", confidence: float | None = None, source_type: str | None = None, target_type: str | None = None, evidence: str = "", agent: str = "", session: str = "", valid_from: str | None = None, supersedes: str | None = None) -> dict:
    """Add one relation, in place of another from its beginning on with `supersedes`."""
    return {"edge": store.one("edges", store.relate(source, relation, target, description, confidence, source_type, target_type, evidence, agent, session, valid_from, supersedes))}


@capability
def supersede(store: Store, edge: str, by: str | None = None, reason: str = "", at: str | None = None, agent: str = "") -> dict:
    """Close a relation; it stays in the history."""
    store.supersede(store.spark.createDataFrame([(edge, by, reason)], "edge string, by string, reason string"), at, agent)
    return {"edge": store.one("edges", edge)}


@capability
def search(store: Store, query: str, limit: int = 10) -> dict:
    """Find concepts by name, summary and the passages that mention them."""
    g = D.stored(store)
    return {"query": query, "nodes": retrieval.search(g.nodes, g.chunks, g.mentions, g.edges, query, limit), "passages": retrieval.passages(g.chunks, g.sources, query).orderBy("rank")}


@capability
def show(store: Store, concept: str, as_of: str | None = None, limit: int = 50) -> dict:
    """One concept: its relations either way, neighbours and mentions."""
    g = D.stored(store)
    return D.show(g, g.resolve(concept), _at(store, as_of), limit)


@capability
def path(store: Store, source: str, target: str, k: int = 3, as_of: str | None = None) -> dict:
    """How two concepts connect, step by step."""
    g = D.stored(store)
    a, b = g.resolve(source), g.resolve(target)
    found = D.paths(g, a, b, k, _at(store, as_of))
    return {"from": a, "to": b, "connected": bool(found), "paths": found}


@capability
def timeline(store: Store, concept: str) -> dict:
    """All that was said about a concept, in order of time."""
    g = D.stored(store)
    return D.timeline(g, g.resolve(concept))


@capability
def evidence(store: Store, target: str) -> dict:
    """What backs a concept or an edge, and what argues against it."""
    g = D.stored(store)
    return D.evidence(g, target if target.startswith("e-") and store.one("edges", target) else g.resolve(target))


@capability
def contradictions(store: Store, concept: str | None = None, as_of: str | None = None, limit: int = 50) -> dict:
    """Where the graph disagrees with itself."""
    g = D.stored(store)
    return D.contradictions(g, g.resolve(concept) if concept else None, _at(store, as_of), limit)


@capability
def communities(store: Store, method: str = "louvain", resolution: float = 1.0, as_of: str | None = None) -> dict:
    """Topics with their strongest concepts."""
    return D.communities(D.stored(store), _at(store, as_of), method, resolution)


@capability
def analyze(store: Store, top: int = 10, as_of: str | None = None) -> dict:
    """An overview: central concepts, bridges, topics, gaps, diversity."""
    return D.analyze(D.stored(store), _at(store, as_of), top)


@capability
def gaps(store: Store, between: list | None = None, top: int = 5, as_of: str | None = None) -> dict:
    """Topics with little between them, or how far two concepts are apart."""
    g = D.stored(store)
    return D.between(g, *(g.resolve(x) for x in between), _at(store, as_of)) if between else {"gaps": D.gaps(g, _at(store, as_of), top)}


@capability
def context(store: Store, query: str, budget: int = 12_000, as_of: str | None = None) -> dict:
    """Numbered material to answer a question from."""
    items = D.context(D.stored(store), query, budget, _at(store, as_of))
    return {"query": query, "citations": items, "text": D.cited(items)}


def _model(name: str, ask: Callable) -> Callable:
    """A capability that a model answers: by a command, or without one as a task for the caller."""

    def run(store: Store, question: str = "", concept: str | None = None, between: list | None = None, command: list | None = None, save: bool = True) -> dict:
        pair = tuple(between) if between else None
        return {name: ask(store, models.command(command), question, concept, pair, save)} if command else answers.host_task(store, name, question, pair, concept)

    run.__name__, run.__doc__ = name, f"The model's part of `{name}`: by an external command, or as a task with its material for a caller that is itself the model."
    return capability(run)


_model("ask", lambda store, hook, question, concept, between, save: answers.ask(store, question, hook))
_model("report", lambda store, hook, question, concept, between, save: answers.report(store, hook, save=save))
_model("questions", lambda store, hook, question, concept, between, save: answers.questions(store, hook, between, save=save))
_model("reconcile", lambda store, hook, question, concept, between, save: answers.reconcile(store, hook, concept, apply=save))


@capability
def view(store: Store, question: str | None = None, lens: str | None = None, concept: str | None = None, to: str | None = None, as_of: str | None = None, view: str | None = None) -> dict:
    """The view that answers a question."""
    return router.choose(store.nodes(), store.edges(), question, lens, concept, to, as_of, view)


@capability
def visualize(store: Store, out: str, question: str | None = None, lens: str | None = None, concept: str | None = None, to: str | None = None, as_of: str | None = None, view: str | None = None, title: str | None = None) -> dict:
    """Write a self-contained page into a file of this machine."""
    chosen = {k: v for k, v in {"lens": lens, "concept": concept, "to": to, "as_of": as_of, "view": view}.items() if v is not None}
    page = D.visualize(D.stored(store), title, question, **chosen)
    with open(out, "w", encoding="utf-8") as f:
        f.write(page)
    return {"path": out, "bytes": len(page.encode())}


@capability
def export(store: Store, format: str, out: str, concept: str | None = None, as_of: str | None = None) -> dict:
    """Write the graph for other tools."""
    D.export(D.stored(store), format, out, _at(store, as_of), concept)
    return {"format": format, "path": out}


@capability
def events(store: Store, since: int = 0, limit: int = 200) -> dict:
    """The change log after an event."""
    rows = store.events().filter(F.col("seq") > since).orderBy("seq").limit(limit).collect()
    return {"events": [{"seq": r.seq, "at": r.at, "kind": r.kind, **json.loads(r.data)} for r in rows], "last": rows[-1].seq if rows else since}


@capability
def stats(store: Store) -> dict:
    """Counts, types, relations, and where the graph is."""
    return D.stats(store)


@capability
def manifest(store: Store | None = None) -> dict:
    """What this engine offers."""
    return {"name": NAME, "format": FORMAT, "capabilities": tools(), "methods": list(METHODS), "events": list(EVENT_KINDS), "exports": list(D.FORMATS), "lenses": router.LENSES, "views": list(router.VIEWS)}


@capability
def doctor(store: Store) -> dict:
    """Whether what the engine needs is there."""
    spark = store.spark

    def pdf() -> bool:
        try:
            import pypdf  # noqa: F401
        except ImportError:
            return False
        return True

    return {"spark": spark.version, "python": sys.version.split()[0], "graph": store.path, "format": store.meta("format"), "shared_folder": spark.conf.get("spark.checkpoint.dir", None), "pdf": pdf(), "last_event": store.last_event()}


# --- envelopes and tools -----------------------------------------------------------------------------------------------------


def described(error: BaseException) -> dict:
    code = "interrupted" if isinstance(error, KeyboardInterrupt) else getattr(error, "code", None) or {FileNotFoundError: "not_found", TypeError: "usage", ValueError: "invalid_input"}.get(type(error), "internal")
    more = {k: v for k in ("suggestions", "choices", "understood") if (v := getattr(error, k, None))}
    return {"code": code, "message": str(error), **more, **getattr(error, "more", {})}


def envelope(name: str, store: Store | None, arguments: dict) -> tuple[dict, int]:
    """{ok, command, result} or {ok, command, error}, and an exit code."""
    try:
        if name not in CAPABILITIES:
            raise router.Unknown(f'Unknown command "{name}": use one of {", ".join(CAPABILITIES)}')
        return {"ok": True, "command": name, "result": plain(CAPABILITIES[name](store, **arguments))}, 0
    except BaseException as error:  # noqa: BLE001 - each failure is reported the same way
        told = described(error)
        return {"ok": False, "command": name, "error": told}, INTERRUPTED if isinstance(error, KeyboardInterrupt) else EXIT.get(told["code"], 1)


def tools() -> list[dict]:
    """Name, description and JSON schema of each capability."""
    kinds = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array"}
    out = []
    for name, f in CAPABILITIES.items():
        hints, needed, properties = get_type_hints(f), [], {}
        for p in list(inspect.signature(f).parameters.values())[1:]:
            hint = hints[p.name]
            hint = next((x for x in get_args(hint) if x is not type(None)), hint) if isinstance(hint, UnionType) else hint
            properties[p.name] = {"type": kinds[hint]}
            if p.default is inspect.Parameter.empty:
                needed.append(p.name)
        out.append({"name": f"{NAME}_{name}", "description": (f.__doc__ or "").split("\n")[0], "inputSchema": {"type": "object", "properties": properties, "required": needed}})
    return out


def handle(message: dict, store: Store) -> dict | None:
    """The reply to a JSON-RPC message, none to a notification. A tool's failure is a result that says so; only what isn't understood is a protocol error."""
    if message.get("id") is None:
        return None
    reply = lambda key, value: {"jsonrpc": "2.0", "id": message["id"], key: value}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply("result", {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": FORMAT}})
    if method == "ping":
        return reply("result", {})
    if method == "tools/list":
        return reply("result", {"tools": tools()})
    if method == "tools/call":
        name = str(params.get("name", "")).removeprefix(f"{NAME}_")
        if name not in CAPABILITIES:
            return reply("error", {"code": -32602, "message": f"Unknown tool {name}"})
        done, _ = envelope(name, store, params.get("arguments") or {})
        body = done["result"] if done["ok"] else {"error": done["error"]}
        text = [{"type": "text", "text": json.dumps(body, ensure_ascii=False, default=str)}]
        return reply("result", {"content": text, "structuredContent": body if isinstance(body, dict) else {"items": body}} if done["ok"] else {"isError": True, "content": text})
    return reply("error", {"code": -32601, "message": f"Unknown method {method}"})


def serve_lines(store: Store, source=sys.stdin, sink=sys.stdout) -> None:
    """JSON-RPC, a message a line."""
    for line in source:
        if not line.strip():
            continue
        try:
            answer = handle(json.loads(line), store)
        except ValueError as error:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False, default=str), file=sink, flush=True)


def live_server(store: Store, port: int = 0, max_nodes: int = 1500) -> ThreadingHTTPServer:
    """A server on this machine alone: the page at /, its document at /api/graph, the change log at /api/events?since=N. The page asks for events every two seconds and loads itself anew when there are any."""
    busy = threading.Lock()

    def document(query: dict) -> dict:
        g = D.stored(store)
        concept = g.resolve(query["concept"]) if query.get("concept") else None
        return D.as_dict(g, D.graph_data(g, concept=concept, max_nodes=max_nodes), concept) | {"last_event": store.last_event()}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def do_GET(self) -> None:  # noqa: N802 - the interface's name
            at = urlparse(self.path)
            query = {k: v[-1] for k, v in parse_qs(at.query).items()}
            status, kind = 200, "application/json"
            try:
                with busy:
                    if at.path == "/":
                        body, kind = sinks.page(document(query) | {"live": True}), "text/html; charset=utf-8"
                    elif at.path == "/api/graph":
                        body = json.dumps(document(query), ensure_ascii=False, default=str)
                    elif at.path == "/api/events":
                        body = json.dumps(events(store, int(query.get("since") or 0)), ensure_ascii=False)
                    else:
                        status, body = 404, '{"error": "not found"}'
            except Exception as error:  # noqa: BLE001 - the page learns of it and the server goes on
                status, body = 500, json.dumps({"error": described(error)}, default=str)
            raw = body.encode()
            self.send_response(status)
            for k, v in (("Content-Type", kind), ("Cache-Control", "no-store"), ("Content-Length", str(len(raw)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """`GRAPH COMMAND [JSON arguments]`, `HOME graphs`, or `GRAPH tools` for JSON-RPC; prints one JSON envelope."""
    if len(argv) < 2:
        print(json.dumps({"ok": False, "command": None, "error": {"code": "usage", "message": "give a graph's folder and a command"}}))
        return EXIT["usage"]
    spark = spark or SparkSession.builder.getOrCreate()
    folder, name, *rest = argv
    try:
        if name == "graphs":
            done, code = {"ok": True, "command": name, "result": list_graphs(spark, folder)}, 0
        else:
            store = Store(spark, folder, create=name in ("ingest", "add", "relate", "tools"))
            if name == "tools":
                serve_lines(store)
                return 0
            done, code = envelope(name, store, json.loads(rest[0]) if rest else {})
    except Exception as error:  # noqa: BLE001 - as in envelope
        done = {"ok": False, "command": name, "error": described(error)}
        code = EXIT.get(done["error"]["code"], 1)
    print(json.dumps(done, ensure_ascii=False, default=str))
    return code
