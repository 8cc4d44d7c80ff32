import io
import json
import threading
from urllib.error import HTTPError
from urllib.request import urlopen

import pytest

from factweave import surface
from factweave.operators.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("home") / "graphs" / "g"))
    done, code = surface.envelope("ingest", s, {"text": "Solar feeds the grid. The grid needs storage.", "title": "Notes", "at": "2024-01-01"})
    assert code == 0 and done["result"]["sources"][0]["status"] == "added" and done["result"]["nodes_added"] == 0
    chunk = done["result"]["task"]["chunks"][0]["id"]
    edges = [{"from": "Solar", "to": "Grid", "relation": "feeds", "chunk": chunk}, {"from": "Grid", "to": "Storage", "relation": "needs", "description": "It needs it.", "chunk": chunk}, {"from": "x"}]
    done, code = surface.envelope("add", s, {"payload": {"nodes": ["Wind"], "edges": edges}})
    assert code == 0 and (done["result"]["nodes_added"], done["result"]["edges_added"], len(done["result"]["skipped"])) == (4, 2, 1)
    return s


def test_every_capability_has_a_schema(store):
    tools = {t["name"].removeprefix("factweave_"): t["inputSchema"] for t in surface.tools()}
    assert set(tools) == set(surface.CAPABILITIES) and len(tools) >= 23 and tools["relate"]["required"] == ["source", "relation", "target"] and tools["gaps"]["properties"]["between"] == {"type": "array"}


def test_reading(store, tmp_path):
    ask = lambda name, **a: surface.envelope(name, store, a)
    assert ask("search", query="solar")[0]["result"]["nodes"][0]["id"] == "solar"
    assert ask("show", concept="GRID")[0]["result"]["degree"] == 2
    found = ask("path", source="solar", target="storage")[0]["result"]
    assert found["connected"] and found["paths"][0]["hops"] in (1, 2)
    assert [e["kind"] for e in ask("events", since=0, limit=2)[0]["result"]["events"]] == ["source_added", "node_added"]
    assert ask("context", query="grid")[0]["result"]["text"].startswith("[1] ")
    assert ask("reconcile")[0]["result"]["contradictions"]["candidates"] == [] and ask("view", question="How is solar connected to storage?")[0]["result"]["lens"] == "path"
    assert ask("manifest")[0]["result"]["format"] and ask("doctor")[0]["result"]["last_event"] > 0
    done, code = ask("show", concept="nothing")
    assert code == 4 and done["error"]["code"] == "not_found"
    assert ask("view", question="grid and solar")[1] == 3 and ask("nonsense")[1] == 2 and ask("show")[1] == 2
    for table in json.loads(json.dumps(ask("timeline", concept="grid")[0], default=str))["result"]["entries"]:
        assert table["at"].endswith("Z")


def test_tools_over_lines(store):
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "factweave_stats"}}, {"id": 4, "method": "tools/call", "params": {"name": "factweave_show", "arguments": {"concept": "zzz"}}}, {"id": 5, "method": "tools/call", "params": {"name": "x"}}, {"id": 6, "method": "x"}]
    out = io.StringIO()
    surface.serve_lines(store, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nnot json\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and got[3]["result"]["structuredContent"]["nodes"] == 4 and got[4]["result"]["isError"]
    assert (got[5]["error"]["code"], got[6]["error"]["code"], got[None]["error"]["code"]) == (-32602, -32601, -32700)


def test_live_page(store):
    server = surface.live_server(store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert len(json.load(urlopen(f"{at}/api/events?since=1"))["events"]) == store.last_event() - 1
        assert '"live": true' in urlopen(at + "/").read().decode()
        with pytest.raises(HTTPError) as error:
            urlopen(at + "/x")
        assert error.value.code == 404
    finally:
        server.shutdown()


def test_command_line(spark, store, capsys):
    home = store.path.rsplit("/graphs/", 1)[0]
    assert surface.main([home, "graphs"], spark) == 0 and json.loads(capsys.readouterr().out)["result"][0]["name"] == "g"
    assert surface.main([store.path, "relate", '{"source": "sun", "relation": "lights", "target": "sea"}'], spark) == 0
    assert surface.main([home + "/none", "stats"], spark) == 4 and surface.main([home], spark) == 2
