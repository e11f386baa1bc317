import hashlib
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from skeinlake import client, service
from skeinlake.functions import tokenizer
from skeinlake.plans.api import Engine


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    folder, files = tmp_path_factory.mktemp("w"), tmp_path_factory.mktemp("files")
    (files / "a.txt").write_text("Rex chases Tom. Tom fears Rex.")
    engine = Engine(spark, str(folder), "chunk", "chunk")
    engine.index(str(files))
    keys = spark.createDataFrame([(hashlib.sha256(b"secret").hexdigest(),)], "key_hash string")
    server = service.make_server(engine, service.Sessions(keys, open_access=True))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def call(url, body=None, method=None, **headers):
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data=data, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service(served):
    assert call(served + "/auth/methods") == (200, ["NONE", "TOKEN"])
    assert call(served + "/dataSource")[0] == call(served + "/retrieval", {})[0] == 401
    assert call(served + "/nowhere")[0] == 404
    for method, headers in (("TOKEN", {}), ("TOKEN", {"Authorization": "Bearer wrong' OR 1=1"}), ("KERBEROS", {})):
        assert not call(f"{served}/auth?authMethod={method}", {}, **headers)[1]["success"]
    token = call(f"{served}/auth?authMethod=TOKEN", {}, Authorization="Bearer secret")[1]["token"]
    assert call(f"{served}/auth?authMethod=NONE", {})[1]["success"]
    for path in ("/dataSource", "/embedding/info", "/retrieval/info", "/security/requirements"):
        assert call(served + path, token=token)[0] == 200
    request = {"latestUserPrompt": "Rex chases Tom", "latestUserPromptType": "text", "parameters": {"confidence_cutoff": "0.0"}, "maxMatches": 1}
    status, rows = call(served + "/retrieval", request, token=token)
    assert status == 200 and len(rows) == 1 and "Rex" in rows[0]["matchedContent"]
    assert call(served + "/retrieval", {"latestUserPrompt": "x", "latestUserPromptType": "image"}, token=token)[0] == 422


def test_sessions_expire():
    s = service.Sessions(open_access=True, seconds=-1)
    assert not s.valid(s.open("NONE", None)["token"]) and not s.valid(None)
    assert s.methods() == ["NONE"] and not s.open("TOKEN", "Bearer x")["success"]


class Model(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, body):
        text = (body.get("prompt") or body.get("messages", [{}])[-1].get("content", ""))[:20]
        data = {
            "/api/generate": {"response": f"g:{text}"}, "/api/chat": {"message": {"content": f"c:{text}"}}, "/api/embed": {"embeddings": [[1.0, 2.0]] * len(body.get("input", []))},
            "/api/tags": {"models": [{"name": "m"}]}, "/models": {"data": [{"id": "m"}]}, "/chat/completions": {"choices": [{"message": {"content": f"o:{text}"}}]},
            "/embeddings": {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body.get("input", []))))]},
        }.get(self.path)
        raw = json.dumps(data).encode()
        self.send_response(200 if data else 404)
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        self.answer({})

    def do_POST(self):
        self.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))


def test_client(spark, tmp_path):
    from skeinlake.sources.tables import Warehouse

    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    local, other = client.ModelClient(url, "m"), client.ModelClient(url, "m", "openai", "key")
    assert local.generate("hello") == "g:hello" and other.generate("hello", "system") == "o:hello"
    assert local.chat(client.create_chat("hi", "s", [{"role": "user", "content": "before"}])) == "c:hi"
    assert local.models() == other.models() == ["m"]
    assert local.encode(["a", "b"]) == [[1.0, 2.0]] * 2 and other.encode(["a", "b"]) == [[0.0], [1.0]]
    assert local.summarize("text") == "g:text" and local.extract("text") == "g:text"
    assert client.probe_model(local)[0] and not client.probe_model(client.ModelClient("http://127.0.0.1:9", "m", timeout=2))[0]
    assert client.probe_tables(Warehouse(spark, str(tmp_path / "w"))) == (True, "written and read")
    server.shutdown()


def test_token_ids(spark):
    def load():
        return tokenizer.TokenIds(lambda t: [ord(c) % 7 for c in t], 7, max_tokens=3)

    df = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    got = [r.ids for r in df.select(tokenizer.token_ids(df.text, load).alias("ids")).collect()]
    assert got == [["6", "0"], [], []]
    assert load().fits("abc") and not load().fits("abcd") and load().vocabulary()["6"] == 6
