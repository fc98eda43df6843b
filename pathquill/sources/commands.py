"""Text commands and HTTP-like requests over a database, without a socket.

A command is ``<key> <command> <collection> ...``; every answer line starts with its key. What does not begin
with a known command is a query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import EngineError, NotFoundError, PatchError, QueryParseError
from .database import Database

KEY_LENGTH = 36
COMMANDS = ("info", "get", "set", "add", "del", "patch", "idx", "rmi", "rmc", "query", "explain")


def answers(df: DataFrame):
    if df.columns == ["count"]:
        yield None, str(df.first()["count"])
    else:
        for r in df.toLocalIterator():
            yield r.id, r.doc


class Session:
    def __init__(self, db: Database):
        self.db = db

    def command(self, line: str) -> list[str]:
        """The answer's lines."""
        key, _, rest = line.strip().partition(" ")
        if not key or len(key) > KEY_LENGTH:
            return [f"{key[:KEY_LENGTH]} ERROR: a key has 1 to {KEY_LENGTH} characters"]
        try:
            return self._answer(key, rest.strip())
        except (EngineError, ValueError) as e:
            return [f"{key} ERROR: {e}"]

    def _answer(self, key: str, text: str) -> list[str]:
        word, _, rest = text.partition(" ")
        if word not in COMMANDS:
            return self._query(key, None, text)
        if word == "info":
            return [f"{key}\t{json.dumps(self.db.info())}"]
        name, _, rest = rest.strip().partition(" ")
        rest = rest.strip()
        if word in ("query", "explain"):
            if word == "explain":
                return [f"{key}\t{line}" for line in self.db.explain(rest, name).split("\n")] + [key]
            return self._query(key, name, rest)
        if word == "rmc":
            self.db.remove_collection(name)
            return [key]
        if word in ("idx", "rmi"):
            mode, _, path = rest.partition(" ")
            kind, _, unique = mode.partition("+")
            if word == "idx":
                self.db.ensure_index(name, path.strip(), kind, unique == "unique")
            else:
                self.db.remove_index(name, path.strip(), kind)
            return [key]
        if word == "add":
            return [f"{key}\t{self.db.put(name, json.loads(rest))}"]
        id, _, body = rest.partition(" ")
        if word == "get":
            return [f"{key}\t{id}\t{json.dumps(self.db.get(name, int(id)), ensure_ascii=False)}"]
        if word == "del":
            self.db.delete(name, int(id))
        elif word == "set":
            self.db.put(name, json.loads(body), int(id))
        else:
            self.db.patch(name, int(id), json.loads(body))
        return [f"{key}\t{id}"]

    def _query(self, key: str, name: str | None, text: str) -> list[str]:
        out = []
        for id, doc in answers(self.db.query(text, name)):
            if id is None:
                return [f"{key}\t{doc}"]
            out.append(f"{key}\t{id}\t{doc}")
        return [*out, key]


@dataclass
class Response:
    """Status, headers and text; a query's text comes in ``chunks``, one for each document as it is fetched."""

    status: int
    text: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    chunks: Iterator[str] | None = None

    @property
    def body(self) -> str:
        """The whole text, gathered."""
        if self.chunks is not None:
            self.text, self.chunks = self.text + "".join(self.chunks), None
        return self.text


class Requests:
    """The REST surface: documents under ``/collection/id``, queries posted to ``/``."""

    def __init__(self, db: Database, token: str | None = None, anonymous_read: bool = False):
        self.db, self.token, self.anonymous_read = db, token, anonymous_read

    def handle(self, method: str, path: str, body: str = "", headers: dict[str, str] | None = None) -> Response:
        headers = headers or {}
        anonymous = False
        if self.token:
            given = headers.get("X-Access-Token")
            if given is None and self.anonymous_read and (method in ("GET", "HEAD") or (method == "POST" and path == "/")):
                anonymous = True
            elif given != self.token:
                return Response(401 if given is None else 403)
        try:
            return self._route(method, [p for p in path.split("/") if p], body, headers, anonymous)
        except NotFoundError as e:
            return Response(404, str(e))
        except (QueryParseError, PatchError, ValueError) as e:
            return Response(400, str(e))
        except EngineError as e:
            return Response(500, str(e))

    def _route(self, method: str, parts: list[str], body: str, headers: dict, anonymous: bool) -> Response:
        if not parts:
            if method == "OPTIONS":
                return Response(200, json.dumps(self.db.info()), {"Allow": "GET, HEAD, POST, PUT, PATCH, DELETE, OPTIONS"})
            return self._query(body, headers, anonymous) if method == "POST" else Response(400)
        if len(parts) == 1:
            return Response(200, str(self.db.put(parts[0], json.loads(body)))) if method == "POST" else Response(400)
        name, id = parts[0], int(parts[1])
        if method in ("GET", "HEAD"):
            text = json.dumps(self.db.get(name, id), indent=1, ensure_ascii=False)
            return Response(200, text if method == "GET" else "", {"Content-Length": str(len(text.encode())), "Content-Type": "application/json"})
        if method == "PUT":
            self.db.put(name, json.loads(body), id)
        elif method == "PATCH":
            self.db.patch(name, id, json.loads(body))
        elif method == "DELETE":
            self.db.delete(name, id)
        else:
            return Response(400)
        return Response(200)

    def _query(self, text: str, headers: dict, anonymous: bool) -> Response:
        q = self.db.prepare(text)
        if anonymous and (q.has_apply or q.has_delete):
            return Response(403)
        shown = f"{self.db.explain(q)}\n--------------------" if headers.get("X-Hints") == "explain" else ""
        chunks = (doc if id is None else f"\r\n{id}\t{doc}" for id, doc in answers(self.db.query(q)))
        return Response(200, shown, chunks=chunks)
