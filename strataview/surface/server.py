"""Serving the tools by the Model Context Protocol: JSON-RPC over standard streams or HTTP.

Over streams each line is one message. Over HTTP a message is posted to ``/mcp`` and answered
with JSON; no session is kept and no stream is opened by the server. With a verifier, a
request without a valid bearer token is answered 401 before anything is read, and its tools
are those of the caller that it names. Messages are answered one at a time on either way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import IO, Any

from ..errors import StrataError
from ..operators.governance import Principal
from .auth import AuthError, Verifier
from .tools import Tool, call

VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, INVALID, UNKNOWN, PARAMS = -32700, -32600, -32601, -32602
MOST = 4 << 20  # bytes of one request
Offer = Callable[[Principal | None], Mapping[str, Tool]]


def answer(name: str, available: Mapping[str, Tool], message: Any) -> dict[str, Any] | None:
    """The reply to one message; None where it asks for none."""
    wrong = lambda code, text, of=None: {"jsonrpc": "2.0", "id": of, "error": {"code": code, "message": text}}
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return wrong(INVALID, "not a JSON-RPC 2.0 request")
    if "id" not in message:
        return None  # a notification
    method, params, of = message["method"], message.get("params") or {}, message["id"]
    if not isinstance(params, dict):
        return wrong(PARAMS, "params must be an object", of)
    good = lambda result: {"jsonrpc": "2.0", "id": of, "result": result}
    if method == "initialize":
        asked = params.get("protocolVersion")
        writable = any(t.startswith("run_") for t in available)
        return good({
            "protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": name, "version": "0.1"},
            "instructions": "Typed objects and declared links under the deployment's policies. " + ("Actions take dryRun." if writable else "Read only: no action is exposed."),
        })
    if method == "ping":
        return good({})
    if method == "tools/list":
        return good({"tools": [{"name": t.name, "description": t.description, "inputSchema": t.schema} for t in available.values()]})
    if method == "tools/call":
        if not isinstance(params.get("name"), str) or not isinstance(params.get("arguments", {}), (dict, type(None))):
            return wrong(PARAMS, "a call has a name and an object of arguments", of)
        text, bad = call(available, params["name"], params.get("arguments"))
        return good({"content": [{"type": "text", "text": text}], "isError": bad})
    return wrong(UNKNOWN, f"no method '{method}'", of)


def replies(name: str, available: Mapping[str, Tool], text: str | bytes) -> str | None:
    """The replies to a message, or a batch of them, as JSON."""
    try:
        message = json.loads(text)
    except ValueError as e:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": f"not JSON: {e}"}})
    if isinstance(message, list) and message:
        found = [a for m in message if (a := answer(name, available, m)) is not None]
        return json.dumps(found, ensure_ascii=False) if found else None
    found = answer(name, available, message)
    return None if found is None else json.dumps(found, ensure_ascii=False)


def serve_stdio(name: str, available: Mapping[str, Tool], source: IO[str], sink: IO[str]) -> int:
    """Answer every line until the source ends; the number of lines read."""
    n = 0
    for line in source:
        if line.strip():
            n += 1
            if (text := replies(name, available, line)) is not None:
                sink.write(text + "\n")
                sink.flush()
    return n


def http_server(name: str, offer: Offer, host: str, port: int, verifier: Verifier | None = None) -> HTTPServer:
    """A server that isn't running yet; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _send(self, status: int, text: str = "", **headers: str) -> None:
            body = text.encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(body)), **headers}.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body)

        def _caller(self) -> Principal | None:
            if verifier is None:
                return None
            scheme, _, token = (self.headers.get("Authorization") or "").partition(" ")
            if scheme.lower() != "bearer" or not token:
                raise AuthError("a bearer token is needed")
            return verifier.verify(token.strip())

        def do_POST(self) -> None:
            self.close_connection = True
            if self.path.split("?")[0].rstrip("/") != "/mcp":
                return self._send(404)
            try:
                caller = self._caller()
            except AuthError as e:
                return self._send(401, json.dumps({"error": str(e)}), WWW_Authenticate='Bearer error="invalid_token"')
            try:
                size = int(self.headers.get("Content-Length") or -1)
            except ValueError:
                size = -1
            if not 0 <= size <= MOST:
                return self._send(411 if size < 0 else 413)
            body = self.rfile.read(size)
            try:
                available = offer(caller)
            except StrataError as e:
                return self._send(403, json.dumps({"error": str(e)}))
            text = replies(name, available, body)
            self._send(202) if text is None else self._send(200, text)

        def do_GET(self) -> None:
            self.close_connection = True
            self._send(405, Allow="POST")

        do_DELETE = do_PUT = do_GET

        def log_message(self, *_: Any) -> None:
            pass

    return HTTPServer((host, port), Handler)
