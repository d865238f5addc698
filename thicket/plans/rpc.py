"""JSON-RPC over lines: ``search_ast`` and ``lookup_symbol`` on the same DataFrames."""

from __future__ import annotations

import json
from typing import IO

from pyspark.sql import DataFrame

from thicket.operators import search, symbols
from thicket.schema import EngineError

# Error codes of the protocol.
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32600, -32601, -32602, -32603

_FOUND = ["file_path", "start_line", "start_col", "end_line", "end_col", "capture_name", "matched_text"]


class Server:
    """Answers requests over a table of files and, where there is one, a table of symbols."""

    def __init__(self, files: DataFrame, table: DataFrame | None = None) -> None:
        self.files, self.symbols = files, table

    def handle(self, line: str) -> str:
        """The answer to one line."""
        try:
            request = json.loads(line)
        except ValueError as e:
            return self._error(None, PARSE_ERROR, str(e))
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return self._error(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "not a request of version 2.0")
        number, params = request.get("id"), request.get("params")
        method = {"search_ast": self._search, "lookup_symbol": self._lookup}.get(request["method"])
        if method is None:
            return self._error(number, NO_METHOD, f"no method {request['method']}")
        argument = params.get("query" if method == self._search else "name") if isinstance(params, dict) else None
        if not isinstance(argument, str) or not argument.strip():
            return self._error(number, BAD_PARAMS, "the argument is missing or empty")
        try:
            return json.dumps({"jsonrpc": "2.0", "id": number, "result": method(argument)}, ensure_ascii=False)
        except EngineError as e:
            return self._error(number, FAILED, str(e))

    def _search(self, query: str) -> list[dict]:
        return [json.loads(x) for x in search.in_order(search.search(self.files, [query])).select(*_FOUND).toJSON().collect()]

    def _lookup(self, name: str) -> list[dict]:
        if self.symbols is None:
            raise EngineError("there is no symbol table")
        found = symbols.exact_else_contains(self.symbols, name)
        return [json.loads(x) for x in found.orderBy("path", "start_line", "start_col", "name").toJSON().collect()]

    @staticmethod
    def _error(number, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}})


def serve(server: Server, lines: IO[str], out: IO[str]) -> None:
    """Answer each line in turn."""
    for line in lines:
        if line.strip():
            out.write(server.handle(line) + "\n")
            out.flush()
