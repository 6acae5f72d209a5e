"""JSON-RPC 2.0, a line each over stdio or a body each over HTTP."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from weftline.service.format import render
from weftline.service.tools import Tools

NAME, VERSION, MOST = "weftline", "0.1", 20 << 20


def _error(request_id: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": request_id, "error": {"code": code, "message": message}}


def handle(tools: Tools, line: str) -> dict | None:
    """The answer to one request; None to a notification."""
    try:
        request = json.loads(line)
        method, request_id = request["method"], request.get("id")
    except (ValueError, KeyError, TypeError, AttributeError):
        return _error(None, -32700, "parse error")
    if "id" not in request:
        return None
    params = request.get("params") or {}
    try:
        if method == "initialize":
            result: Any = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": VERSION}, "instructions": tools.help({})["help"]}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": tools.listing()}
        elif method == "tools/call":
            name, args = params.get("name", ""), params.get("arguments") or {}
            if name not in tools.table:
                return _error(request_id, -32603, f"unknown tool {name}")
            result = {"content": [{"type": "text", "text": render(name, tools.call(name, args), args)}]}
        else:
            return _error(request_id, -32603, f"unknown method {method}")
    except Exception as e:  # the loop goes on after a failed request
        return _error(request_id, -32603, str(e)[:1000])
    return {"jsonrpc": "2.0", "id": request_id, "result": result}


def serve_stdio(tools: Tools, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer requests until the input ends."""
    for line in source:
        if line.strip() and (answer := handle(tools, line)) is not None:
            sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
            sink.flush()


def http_server(tools: Tools, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server: GET tells what it is, POST answers a request, 202 a notification."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict | None) -> None:
            data = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send(200, {"name": NAME, "version": VERSION}) if self.path in ("/", "/rpc") else self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path not in ("/", "/rpc"):
                return self._send(404, {"error": "not found"})
            if not 0 < size <= MOST:
                return self._send(400, {"error": "no body, or too large"})
            answer = handle(tools, self.rfile.read(size).decode("utf-8", "replace"))
            return self._send(202, None) if answer is None else self._send(200, answer)

        def do_PUT(self) -> None:
            self._send(405, {"error": "method not allowed"})

        do_DELETE = do_PATCH = do_PUT

        def log_message(self, *_: Any) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)
