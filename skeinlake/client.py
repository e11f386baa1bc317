"""A model server over HTTP behind the protocols of ``providers``, and probes of what an engine needs.

Two wire forms: ``local`` (``/api/generate``, ``/api/chat``, ``/api/embed``, ``/api/tags``) and ``openai``
(``/chat/completions``, ``/embeddings``, ``/models``). A client holds no connection, so it travels to executors.
"""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass, field
from typing import Any

from skeinlake.providers import create_chat

TRIPLES = "List the relations that the text states as a JSON array of objects with the keys From, To and Relation."
SUMMARY = 'Summarise the text. Answer with a JSON object with the keys "label" (a short title) and "description".'
JUDGE = 'Say what the text tells about the question. Answer with a JSON object with the keys "information" and "confidence" (0 to 100).'
ANSWER = "Answer the question from the given texts alone."
SQL = "Write one SQL query that answers the question over these tables. Answer with the query alone."


@dataclass
class ModelClient:
    base_url: str
    model: str
    form: str = "local"
    api_key: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    timeout: float = 120.0
    dims: int = 0

    def _call(self, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.base_url.rstrip("/") + path, data=data, headers=headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.loads(reply.read())

    def chat(self, history: list[dict[str, str]], format: dict[str, Any] | None = None) -> str:
        """The answer to a list of messages; ``format`` is a JSON schema, which only local servers take."""
        if self.form == "openai":
            return self._call("/chat/completions", {"model": self.model, "messages": history, **self.options})["choices"][0]["message"]["content"]
        body = {"model": self.model, "messages": history, "stream": False, "options": self.options} | ({"format": format} if format else {})
        return self._call("/api/chat", body)["message"]["content"]

    def generate(self, prompt: str, system: str = "", format: dict[str, Any] | None = None) -> str:
        if self.form == "openai":
            return self.chat(create_chat(prompt, system))
        body = {"model": self.model, "prompt": prompt, "system": system, "stream": False, "options": self.options} | ({"format": format} if format else {})
        return self._call("/api/generate", body)["response"]

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self.form == "openai":
            got = self._call("/embeddings", {"model": self.model, "input": list(texts)})["data"]
            return [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]
        return self._call("/api/embed", {"model": self.model, "input": list(texts)})["embeddings"]

    def models(self) -> list[str]:
        if self.form == "openai":
            return [x["id"] for x in self._call("/models")["data"]]
        return [x["name"] for x in self._call("/api/tags")["models"]]

    # the protocols of ``providers``

    def extract(self, text: str) -> str:
        return self.generate(text, TRIPLES)

    def summarize(self, text: str) -> str:
        return self.generate(text, SUMMARY)

    def judge(self, prompt: str, block: str) -> str:
        return self.generate(f"Question: {prompt}\n\n{block}", JUDGE)

    def answer(self, prompt: str, contexts: list[str]) -> str:
        return self.generate("\n\n".join([*contexts, f"Question: {prompt}"]), ANSWER)

    def translate(self, prompt: str, schema: str, examples: tuple[str, ...]) -> str:
        return self.generate("\n\n".join([schema, *examples, f"Question: {prompt}"]), SQL)


def probe_model(client: ModelClient) -> tuple[bool, str]:
    """Whether the model answers a small prompt, and its answer or the error."""
    try:
        return True, client.generate("Answer with the word ready.")
    except Exception as e:
        return False, f"{type(e).__name__}: {e}"


def probe_tables(tables) -> tuple[bool, str]:
    """Whether a warehouse can be written to and read."""
    try:
        tables.write("__probe", tables.spark.range(1))
        return tables.read("__probe").count() == 1, "written and read"
    except Exception as e:
        return False, f"{type(e).__name__}: {e}"
    finally:
        tables.drop("__probe")
