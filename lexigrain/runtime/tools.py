"""Named tools over office files: argument checks, dispatch with error codes, kept results, and a line protocol on top."""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import documents
from lexigrain.operators.selection import rows_spec
from lexigrain.plans.query import Aggregate, Condition, Query
from lexigrain.runtime.metrics import Admission, Cancelled, Results
from lexigrain.runtime.session import Density, Session

#: Characters of a reply; more is kept and read in pieces.
REPLY_CHARS = 12_000
AGGREGATES = ["sum", "count", "avg", "min", "max"]

# Schemas of arguments: JSON Schema, without anything that isn't named.
_TEXT, _COUNT, _FLAG = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
_SOURCE = {"path": _TEXT, "document_id": _TEXT}
_READ = {**_SOURCE, "density": {"type": "string", "enum": [d.value for d in Density]}, "whole_document": _FLAG}
_PLACE = {"type": "object", "properties": {"column": _TEXT, "op": {"type": "string", "enum": ["eq", "contains", "gt", "lt"]}, "value": {}}, "required": ["column"], "additionalProperties": False}
_AGGREGATE = {"type": "object", "properties": {"column": _TEXT, "op": {"type": "string", "enum": AGGREGATES}, "as": _TEXT}, "required": ["column"], "additionalProperties": False}
_ORDER = {"type": "object", "properties": {"column": _TEXT, "direction": {"type": "string", "enum": ["asc", "desc"]}}, "required": ["column"], "additionalProperties": False}
_RESOURCE = {**_SOURCE, "kind": _TEXT, "resource_id": _TEXT, "rows": _TEXT, "aggregate": {"type": "string", "enum": AGGREGATES}, "aggregate_column": {}}


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    properties: dict[str, Any]
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> dict[str, Any]:
        return {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}


TOOLS = {
    t.name: t
    for t in (
        Tool("get_runtime_info", "What is open and how much is kept.", {}),
        Tool("inspect_document", "Sheets, pages or slides of a file.", {**_SOURCE, "full_parse": _FLAG}),
        Tool("read_docx", "Pages of a word document, three from the first unless said otherwise.", {**_READ, "page_start": _COUNT, "page_end": _COUNT}),
        Tool("read_pptx", "Slides of a deck, three from the first unless said otherwise.", {**_READ, "slide_start": _COUNT, "slide_end": _COUNT}),
        Tool("read_xlsx", "A sheet's first 500 cells to the end of their row, or an exact range.", {**_SOURCE, "density": _READ["density"], "sheet": _TEXT, "range_spec": _TEXT}),
        Tool("list_document_resources", "Images, charts, tables and pivots of a file.", _SOURCE),
        Tool("read_resource", "The bytes of an image or media file, kept as a result.", {**_SOURCE, "kind": {"type": "string", "enum": ["image", "media"]}, "resource_id": _TEXT}, ("kind", "resource_id")),
        Tool("render_docx_resource", "A chart, diagram or table of a word document; a table's rows and an aggregate of a column by its header.", {**_RESOURCE, "columns": {"type": "array", "items": _TEXT}}, ("kind", "resource_id")),
        Tool("render_pptx_resource", "A chart, diagram or table of a deck; columns count from 0.", {**_RESOURCE, "columns": {"type": "array", "items": {"type": "integer", "minimum": 0}}}, ("kind", "resource_id")),
        Tool("render_xlsx_resource", "A chart, a pivot table or the text of a picture of a workbook.", {**_SOURCE, "kind": _TEXT, "resource_id": _TEXT}, ("kind", "resource_id")),
        Tool("find_xlsx_cells", "Cells whose value, formula, comment or link holds a text, and defined names.", {**_SOURCE, "query": {"type": "string"}, "kind": {"type": "string", "enum": ["value", "formula", "comment", "hyperlink", "definedName"]}, "limit": _COUNT}, ("query",)),
        Tool("find_document_text", "Paragraphs and cells that hold a text, with places and excerpts.", {**_SOURCE, "query": {"type": "string", "minLength": 1, "maxLength": 4000}, "case_sensitive": _FLAG, "offset": {"type": "integer", "minimum": 0}, "limit": {"type": "integer", "minimum": 1, "maximum": 200}, "context": {"type": "integer", "minimum": 0, "maximum": 4000}, "include_headers_footers": _FLAG}, ("query",)),
        Tool("query_xlsx_data", "Filter, group, aggregate and sort a table or range of a workbook.", {**_SOURCE, "table_id": _TEXT, "sheet": _TEXT, "range_spec": _TEXT, "header_row": _COUNT, "select": {"type": "array", "items": _TEXT}, "where": {"type": "array", "items": _PLACE}, "group_by": {"type": "array", "items": _TEXT}, "aggregates": {"type": "array", "items": _AGGREGATE}, "order_by": {"type": "array", "items": _ORDER}, "limit": _COUNT}),
        Tool("read_result", "A piece of a kept result.", {"result_id": _TEXT, "offset": {"type": "integer", "minimum": 0}, "length": _COUNT}, ("result_id",)),
        Tool("release_document", "Closes a file and drops what is kept of it.", _SOURCE),
    )
}


def check(schema: dict[str, Any], value: Any, where: str = "arguments") -> None:
    """ValueError where a value isn't what its schema says: types, names, bounds, choices."""
    kinds = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or kind == "integer" and isinstance(value, bool)):
        raise ValueError(f"{where} isn't of type {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{where} is one of {', '.join(schema['enum'])}")
    if kind == "string" and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 1 << 30):
        raise ValueError(f"{where} is too short or too long")
    if kind == "integer" and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        raise ValueError(f"{where} is out of its bounds")
    if kind == "array":
        for n, item in enumerate(value):
            check(schema["items"], item, f"{where}[{n}]")
    if kind == "object" and "properties" in schema:
        if unknown := value.keys() - schema["properties"].keys():
            raise ValueError(f"{where} has no {sorted(unknown)[0]!r}")
        for name in schema.get("required", ()):
            if name not in value:
                raise ValueError(f"{where} needs {name!r}")
        for name, item in value.items():
            check(schema["properties"][name], item, f"{where}.{name}")


class Runtime:
    """Opens files under allowed folders, one session for each, and answers calls of TOOLS."""

    def __init__(self, spark: SparkSession, roots: list[str], admission: Admission | None = None, results: Results | None = None):
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots]
        self.admission, self.results = admission or Admission(), results or Results()
        self.sessions: dict[str, Session] = {}
        self.locks: dict[str, threading.Lock] = {}

    def execute(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """`{ok, data}` or `{ok: false, error: {code, message}}`; nothing is raised."""
        try:
            tool = TOOLS[name]
        except KeyError:
            return self._error("UNKNOWN_TOOL", f"no tool {name!r}")
        try:
            check(tool.schema, arguments)
            self._expire()
            if "path" in tool.properties:
                if ("path" in arguments) == ("document_id" in arguments):
                    raise ValueError("either path or document_id is needed")
                key = self._open(arguments)
                with self.locks[key]:
                    return {"ok": True, "data": {"document_id": key, **getattr(self, "_" + name)(self.sessions[key], arguments)}}
            return {"ok": True, "data": getattr(self, "_" + name)(arguments)}
        except PermissionError as e:
            return self._error("PATH_NOT_ALLOWED", str(e))
        except FileNotFoundError as e:
            return self._error("DOCUMENT_NOT_FOUND", str(e))
        except KeyError as e:
            return self._error("NOT_FOUND", str(e.args[0] if e.args else e))
        except MemoryError as e:
            return self._error("MEMORY_LIMIT", str(e))
        except Cancelled as e:
            return self._error("CANCELLED", str(e))
        except ValueError as e:
            return self._error("INVALID_ARGUMENTS", str(e))

    @staticmethod
    def _error(code: str, message: str) -> dict[str, Any]:
        return {"ok": False, "data": {}, "error": {"code": code, "message": message}}

    def _expire(self) -> None:
        for key in self.admission.expired():
            self._close(key)
        self.results.expire()

    def _close(self, key: str) -> None:
        if key in self.sessions:
            self.sessions.pop(key).close()
        self.results.release(key)

    def _open(self, arguments: dict[str, Any]) -> str:
        if key := arguments.get("document_id"):
            if key not in self.sessions:
                raise KeyError(f"no document {key!r}")
            self.admission.touch(key)
            return key
        path = arguments["path"]
        if ".." in path.split("/") or not any(path.startswith(r + "/") for r in self.roots):
            raise PermissionError(f"{path} is outside the allowed folders")
        try:
            file = self.spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("revision")).limit(1).collect()
        except Exception as e:  # noqa: BLE001  a missing path is told by Spark in several ways
            raise FileNotFoundError(path) from e
        if not file:
            raise FileNotFoundError(path)
        key = f"doc-{file[0]['revision'][:16]}"
        if key not in self.sessions:
            for old in self.admission.admit(key, (1 << 20) + 12 * file[0]["length"]):
                self._close(old)
            self.sessions[key] = Session(self.spark, path)
            self.locks[key] = threading.Lock()
        self.admission.touch(key)
        return key

    def _text(self, session_key: str, text: str) -> dict[str, Any]:
        if len(text) <= REPLY_CHARS:
            return {"text": text}
        key = self.results.put(text, session_key)
        return {"text": text[:REPLY_CHARS], "result_id": key, "next_offset": REPLY_CHARS, "total": len(text)}

    def _key(self, session: Session) -> str:
        return next(k for k, s in self.sessions.items() if s is session)

    def _reading(self, session: Session, form: str, rendered: Callable[[], DataFrame]) -> dict[str, Any]:
        if session.form != form:
            raise ValueError(f"the file is no {form}")
        rows = rendered().collect()  # one document
        return self._text(self._key(session), rows[0]["rendered"] if rows else "")

    @staticmethod
    def _rows(df: DataFrame, most: int = 1000) -> list[dict]:
        return [json.loads(r) for r in df.limit(most).toJSON().collect()]

    def _get_runtime_info(self, _: dict) -> dict[str, Any]:
        return {"roots": self.roots, "documents": sorted(self.sessions), "held_bytes": sum(self.admission.held.values()), "results": len(self.results.held), "reply_chars": REPLY_CHARS}

    def _inspect_document(self, session: Session, a: dict) -> dict[str, Any]:
        out = {"format": session.form, "about": self._rows(session.describe())}
        return {**out, "report": session.report()} if a.get("full_parse") else out

    def _read_docx(self, session: Session, a: dict) -> dict[str, Any]:
        start = None if a.get("whole_document") else a.get("page_start", 1)
        span = a["page_end"] - start + 1 if start and "page_end" in a else None
        return self._reading(session, "docx", lambda: session.render(a.get("density", "structural"), start=start, span=span))

    def _read_pptx(self, session: Session, a: dict) -> dict[str, Any]:
        start = None if a.get("whole_document") else a.get("slide_start", 1)
        span = a["slide_end"] - start + 1 if start and "slide_end" in a else None
        return self._reading(session, "pptx", lambda: session.render(a.get("density", "structural"), start=start, span=span))

    def _read_xlsx(self, session: Session, a: dict) -> dict[str, Any]:
        if "range_spec" in a and "sheet" not in a:
            raise ValueError("a range needs a sheet")
        names = [r["name"] for r in session.entity("xlsx_sheets").where("kind = 'worksheet'").orderBy("ord").collect()] if session.form == "xlsx" else []
        sheet = a.get("sheet") or (names[0] if names else None)
        return {**self._reading(session, "xlsx", lambda: session.render(a.get("density", "structural"), sheet, a.get("range_spec"))), "sheets": names}

    def _list_document_resources(self, session: Session, _: dict) -> dict[str, Any]:
        return {"resources": self._rows(session.resources())}

    def _read_resource(self, session: Session, a: dict) -> dict[str, Any]:
        data = session.read_resource(a["kind"], a["resource_id"])
        return {"result_id": self.results.put(data, self._key(session)), "total": len(data)}

    def _render(self, session: Session, a: dict, form: str) -> dict[str, Any]:
        if session.form != form:
            raise ValueError(f"the file is no {form}")
        found = session.render_resource(a["kind"], a["resource_id"])
        if a["kind"] in ("table", "tables") and "aggregate" in a:
            return {"value": aggregate_column(found, form, a["aggregate"], a["aggregate_column"], a.get("rows"))}
        if a["kind"] in ("table", "tables"):
            found = table_part(found, form, a.get("rows"), a.get("columns"))
        return {"rows": self._rows(found)}

    def _render_docx_resource(self, session: Session, a: dict) -> dict[str, Any]:
        return self._render(session, a, "docx")

    def _render_pptx_resource(self, session: Session, a: dict) -> dict[str, Any]:
        return self._render(session, a, "pptx")

    def _render_xlsx_resource(self, session: Session, a: dict) -> dict[str, Any]:
        return self._render(session, a, "xlsx")

    def _find_xlsx_cells(self, session: Session, a: dict) -> dict[str, Any]:
        return {"cells": self._rows(session.find_cells(a["query"], a.get("kind"), a.get("limit", 50)))}

    def _find_document_text(self, session: Session, a: dict) -> dict[str, Any]:
        limit, offset = a.get("limit", 20), a.get("offset", 0)
        found = session.find_text(a["query"], not a.get("case_sensitive", True), a.get("context", 80), offset, limit, a.get("include_headers_footers", False))
        rows = self._rows(found.orderBy("doc_id", "rank", "ord").select("locator", "excerpt", "match_at", "has_more"))
        return {"matches": rows, "next_offset": offset + limit if rows and rows[0]["has_more"] else None}

    def _query_xlsx_data(self, session: Session, a: dict) -> dict[str, Any]:
        query = Query(
            where=[Condition(w["column"], w.get("op", "eq"), w.get("value")) for w in a.get("where", ())],
            group_by=a.get("group_by", ()),
            aggregates=[Aggregate(x.get("op", "sum"), x["column"], x.get("as", "")) for x in a.get("aggregates", ())],
            select=a.get("select", ()),
            order_by=[(o["column"], o.get("direction") == "desc") for o in a.get("order_by", ())],
            limit=a.get("limit", 100),
        )
        return {"rows": self._rows(session.query(query, **{k: a[k] for k in ("table_id", "sheet", "range_spec", "header_row") if k in a}))}

    def _read_result(self, a: dict) -> dict[str, Any]:
        got = self.results.read(a["result_id"], a.get("offset", 0), a.get("length", REPLY_CHARS))
        piece = got.pop("piece")
        return {**got, **({"text": piece} if isinstance(piece, str) else {"bytes": piece.hex()})}

    def _release_document(self, session: Session, _: dict) -> dict[str, Any]:
        key = self._key(session)
        self.admission.release(key)
        self._close(key)
        return {"released": key}


def table_part(cells: DataFrame, form: str, rows: str | None, columns: list | None) -> DataFrame:
    """Rows (`2-5`, from 1) and columns of a table: by header text in word documents, by number from 0 in decks."""
    out = cells
    if columns is not None:
        if form == "docx":
            heads = cells.where((F.col("row") == 0) & F.col("text").isin(columns)).groupBy("doc_id", "table_id", "text").agg(F.min(F.struct("col", "col_span")).alias("h"))
            spans = heads.select("doc_id", "table_id", F.explode(F.sequence(F.col("h.col"), F.col("h.col") + F.col("h.col_span") - 1)).alias("col")).distinct()
            out = out.join(spans, ["doc_id", "table_id", "col"], "left_semi")
        else:
            out = out.where(F.col("col").isin(columns))
    if rows is not None:
        first, last = rows_spec(rows)
        out = out.where(F.col("row").between(first - 1, last - 1))
    return out.orderBy("row", "col")


def aggregate_column(cells: DataFrame, form: str, op: str, column: str | int, rows: str | None) -> float:
    """An aggregate over the numbers of a column: below the header in word documents, of the rows chosen in decks; 0 where there are none."""
    if form == "docx":
        head = cells.where((F.col("row") == 0) & (F.col("text") == column)).agg(F.min("col")).first()[0]
        if head is None:
            raise ValueError(f"no column {column!r}")
        own = cells.where((F.col("row") > 0) & (F.col("col") == head))
    else:
        own = table_part(cells, form, rows, [column])
    value = F.trim("text").try_cast("double")
    made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[op](value)
    return float(own.agg(F.coalesce(made.cast("double"), F.lit(0.0))).first()[0])


def serve(runtime: Runtime, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """JSON-RPC over lines: initialize, tools/list, tools/call; other methods are refused, notifications get no answer."""
    for line in source:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
        except ValueError:
            sink.write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}) + "\n")
            continue
        if "id" not in asked:
            continue
        method, params, out = asked.get("method"), asked.get("params") or {}, {"jsonrpc": "2.0", "id": asked["id"]}
        if method == "initialize":
            out["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lexigrain", "version": "1"}}
        elif method == "tools/list":
            out["result"] = {"tools": [{"name": t.name, "description": t.about, "inputSchema": t.schema} for t in TOOLS.values()]}
        elif method == "tools/call":
            told = runtime.execute(params.get("name", ""), params.get("arguments") or {})
            out["result"] = {"content": [{"type": "text", "text": json.dumps(told, ensure_ascii=False)}], "isError": not told["ok"]}
        else:
            out["error"] = {"code": -32601, "message": f"no method {method!r}"}
        sink.write(json.dumps(out, ensure_ascii=False) + "\n")
        sink.flush()


__all__ = ["TOOLS", "Runtime", "Tool", "aggregate_column", "check", "documents", "serve", "table_part"]
