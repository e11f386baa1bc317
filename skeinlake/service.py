"""Retrieval over HTTP: capability routes, sessions and ``POST /retrieval``.

``POST /auth?authMethod=NONE`` opens a session where that is allowed; ``authMethod=TOKEN`` opens one for a bearer key whose
SHA-256 is in the table of keys. All other routes but ``/auth/methods`` need the session's token in the header ``token``.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, functions as F

from skeinlake.plans.api import Engine, retrieve

SESSION_SECONDS = 24 * 3600
MAX_BODY = 1 << 20


class Sessions:
    """Session tokens that expire, and keys kept as hashes in ``keys(key_hash)``."""

    def __init__(self, keys: DataFrame | None = None, open_access: bool = False, seconds: float = SESSION_SECONDS):
        self.keys, self.open_access, self.seconds = keys, open_access, seconds
        self._until: dict[str, float] = {}
        self._lock = threading.Lock()

    def methods(self) -> list[str]:
        return ["NONE"] * self.open_access + ["TOKEN"] * (self.keys is not None)

    def open(self, method: str, authorization: str | None) -> dict[str, Any]:
        failed = lambda why: {"success": False, "token": "", "message": why}
        if method not in self.methods():
            return failed("unknown method of authorization")
        if method == "TOKEN":
            if not (authorization or "").startswith("Bearer "):
                return failed("a bearer token is needed")
            digest = hashlib.sha256(authorization.removeprefix("Bearer ").encode()).hexdigest()
            if self.keys.where(F.col("key_hash") == F.lit(digest)).isEmpty():
                return failed("invalid token")
        token, now = str(uuid.uuid4()), time.time()
        with self._lock:
            self._until = {t: u for t, u in self._until.items() if u > now} | {token: now + self.seconds}
        return {"success": True, "token": token, "message": ""}

    def valid(self, token: str | None) -> bool:
        return self._until.get(token or "", 0) > time.time()


def capabilities(engine: Engine, name: str, description: str) -> dict[str, Any]:
    """What the information routes say."""
    settings = vars(engine.retrieval_config) if engine.retrieval_config else {}
    return {
        "/dataSource": {"name": name, "description": description},
        "/embedding/info": [{"embeddingType": type(engine.embedder).__name__, "usedWhen": "index and query"}],
        "/retrieval/info": [{"id": engine.retriever, "name": engine.retriever, "parametersDescription": {k: f"default {v!r}" for k, v in settings.items()}}],
        "/security/requirements": {"allowedProviderType": "ANY"},
    }


def make_server(engine: Engine, sessions: Sessions, host: str = "127.0.0.1", port: int = 0, name: str = "skeinlake", description: str = "") -> ThreadingHTTPServer:
    """A server that is not running yet; ``port`` 0 takes a free one."""
    routes = capabilities(engine, name, description)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: Any) -> None:
            pass

        def reply(self, status: int, body: Any) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            if status == 401:
                self.send_header("WWW-Authenticate", "Bearer")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            path = urlsplit(self.path).path
            if path == "/auth/methods":
                self.reply(200, sessions.methods())
            elif path not in routes:
                self.reply(404, {"detail": "Not Found"})
            elif not sessions.valid(self.headers.get("token")):
                self.reply(401, {"detail": "Invalid Token"})
            else:
                self.reply(200, routes[path])

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                return self.reply(413, {"detail": "Request too long"})
            body = self.rfile.read(size)
            if url.path == "/auth":
                method = parse_qs(url.query).get("authMethod", [""])[0]
                return self.reply(200, sessions.open(method, self.headers.get("Authorization")))
            if url.path != "/retrieval":
                return self.reply(404, {"detail": "Not Found"})
            if not sessions.valid(self.headers.get("token")):
                return self.reply(401, {"detail": "Invalid Token"})
            try:
                rows = retrieve(engine, json.loads(body))
            except (ValueError, KeyError, TypeError) as e:
                return self.reply(422, {"detail": str(e)})
            return self.reply(200, [r.asDict(recursive=True) for r in rows.collect()])

    return ThreadingHTTPServer((host, port), Handler)
