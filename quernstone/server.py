"""The requests over HTTP: python -m quernstone.server [--root FOLDER] [--port PORT]."""

from __future__ import annotations

import argparse
import json
import re
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from quernstone.api import Api, Reply
from quernstone.engine import Engine
from quernstone.problems import QueryError, problems_json
from quernstone.session import session


def route(api: Api, method: str, path: str, body: bytes, wait: bool = True) -> Reply:
    """The reply to a request; with wait=False a query's id comes at once and the client polls it."""

    def given() -> Any:
        return api.parse(body)

    plain = {
        ("GET", "/tables"): api.get_tables,
        ("GET", "/queries"): api.get_queries,
        ("GET", "/system/info"): api.system_info,
        ("PUT", "/table"): lambda: api.put_table(given()),
        ("POST", "/query"): lambda: api.post_query(given(), wait),
    }
    keyed = {
        ("GET", "table"): api.get_table,
        ("DELETE", "table"): api.delete_table,
        ("GET", "query"): api.get_query,
        ("GET", "result"): lambda key: api.get_result(key, given() if body.strip() else None, stream=True),
        ("GET", "error"): api.get_error,
    }
    path = path.split("?")[0]
    if (method, path) in plain:
        return plain[method, path]()
    found = re.fullmatch(r"/(\w+)/(.*)", path)
    if found and (method, found[1]) in keyed:
        return keyed[method, found[1]](found[2])
    return 404, {"message": f"No route {method} {path}"}


def serve(api: Api, port: int = 8080, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """A server that isn't running yet: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                wait = "respond-async" not in (self.headers.get("Prefer") or "")
                status, reply = route(api, self.command, self.path, body, wait)
            except QueryError as error:
                status, reply = (404 if self.path.startswith("/result/") else 400), problems_json(error.problems)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            if isinstance(reply, Iterator):  # its length isn't known: it ends with the connection
                self.end_headers()
                for piece in reply:
                    self.wfile.write(piece.encode())
                return
            data = b"" if reply == "" else json.dumps(reply, ensure_ascii=False).encode()
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--root", default="quernstone-data")
    parser.add_argument("--port", type=int, default=8080)
    parser.add_argument("--data", default="", help="folder for rows that all executors share; by default the root")
    given = parser.parse_args()
    serve(Api(Engine(session(), given.root, data=given.data)), given.port).serve_forever()


if __name__ == "__main__":
    main()
