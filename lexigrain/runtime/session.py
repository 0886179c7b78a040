"""Office files opened once: entities by name, readings, searches, queries, resources, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import documents, sheets
from lexigrain.operators.search import field_search, find_text
from lexigrain.plans.query import Query
from lexigrain.runtime.metrics import Metrics
from lexigrain.sources.office import ENTITIES, parse_files


class Density(str, Enum):
    """How much a reading tells: text only, structure too, or looks and review context as well."""

    PLAIN = "plain"
    STRUCTURAL = "structural"
    SEMANTIC = "semantic"


class Revisions(str, Enum):
    FINAL = "final"
    ORIGINAL = "original"
    REVIEW = "review"


#: Kinds of resources by either number of their name.
RESOURCE_KINDS = {name: kind for kind in ("image", "media", "chart", "table", "smartart", "pivot_table") for name in (kind, kind + "s")}
#: What each density reads of cells.
DENSITY_COLUMNS = {"plain": ["doc_id", "sheet", "row", "col", "text", "comment", "hyperlink", "rowspan", "colspan", "shadow", "blank"], "structural": ["doc_id", "sheet", "row", "col", "ref", "text", "raw", "type", "formula", "formula_type", "formula_range", "rowspan", "colspan", "shadow", "hyperlink", "comment", "blank"], "semantic": []}
#: Pages or slides of a reading that names no end.
DEFAULT_SPAN = 3


class Session:
    """Files of one format, read once: an entity is parsed when it is first asked for, and kept until ``close``."""

    def __init__(self, spark: SparkSession, path: str | None = None, files: DataFrame | None = None, form: str | None = None, metrics: Metrics | None = None):
        if (path is None) == (files is None):
            raise ValueError("either a path or a table of files is needed")
        self.form = form or (path.rsplit(".", 1)[-1].lower() if path else None)
        if self.form not in ("xlsx", "docx", "pptx"):
            raise ValueError("sessions read xlsx, docx and pptx files")
        self.files = files if files is not None else spark.read.format("binaryFile").load(path).select("path", "content")
        self.spark, self.metrics, self.held = spark, metrics or Metrics(), {}

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def entity(self, name: str) -> DataFrame:
        """An entity's rows; ValueError for one that isn't of this format."""
        if name != "warnings" and ENTITIES.get(name, ("?",))[0] not in ("", self.form):
            raise ValueError(f"no entity {name!r} in {self.form} files")
        if name not in self.held:
            with self.metrics.stage(name):
                self.held[name] = parse_files(self.files, name).persist()
        return self.held[name]

    def close(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held = {}

    def render(self, density: str = "structural", sheet: str | None = None, range_spec: str | None = None, start: int | None = None, span: int | None = None) -> DataFrame:
        """doc_id, rendered. Sheets and ranges select in workbooks; ``start`` (-1 the last) and ``span`` pages or slides."""
        density = Density(density).value
        if range_spec is not None and sheet is None:
            raise ValueError("a range needs a sheet")
        with self.metrics.stage("render"):
            if self.form == "xlsx":
                return self._workbook(density, sheet, range_spec)
            return (self._writing if self.form == "docx" else self._deck)(density, start, span)

    def _workbook(self, density: str, sheet: str | None, range_spec: str | None) -> DataFrame:
        cells, names = self.entity("xlsx_cells"), self.entity("xlsx_sheets")
        budget = sheets.CELL_BUDGET
        if sheet is not None:
            cells, names = sheets.in_sheet(cells, names, sheet), names.where(F.col("name") == sheet)
        if range_spec is not None:
            cells, budget = sheets.in_range(cells, range_spec), 1 << 60  # a range is exact
        if columns := DENSITY_COLUMNS[density]:
            cells = cells.select(*columns)
        if density == "plain":
            return sheets.plain_workbook(cells, names, self.entity("xlsx_ranges"), budget)
        return sheets.xml_workbook(cells, names, budget, density)

    @staticmethod
    def _window(df: DataFrame, number: str, start: int | None, span: int | None) -> DataFrame:
        if start is None:
            return df
        if start == 0 or start < -1 or (span or 1) < 1:
            raise ValueError("pages and slides count from 1, -1 is the last")
        if start == -1:
            last = df.groupBy("doc_id").agg(F.max(number).alias("__last"))
            return df.join(last, "doc_id").where(F.col(number) == F.col("__last")).drop("__last")
        return df.where(F.col(number).between(start, start + (span or DEFAULT_SPAN) - 1))

    def _writing(self, density: str, start: int | None, span: int | None) -> DataFrame:
        blocks = self._window(self.entity("docx_blocks"), "page", start, span)
        if density == "plain":
            return documents.plain_documents(blocks, self.entity("docx_notes"))
        return documents.xml_documents(blocks, self.entity("docx_table_cells"), density)

    def _deck(self, density: str, start: int | None, span: int | None) -> DataFrame:
        slides = self._window(self.entity("pptx_slides"), "n", start, span)
        keep = lambda name: self.entity(name).join(slides.select("doc_id", "n"), ["doc_id", "n"], "left_semi")
        if density == "plain":
            return documents.plain_decks(slides, keep("pptx_shapes"), self.entity("pptx_sections"), keep("pptx_comments"))
        return documents.xml_decks(slides, keep("pptx_paragraphs"), keep("pptx_table_cells"), density)

    def iter_render(self, density: str = "plain") -> Iterator[tuple[str, str]]:
        """(document, piece) in reading order: sheets, pages or slides, brought over one at a time."""
        if self.form == "xlsx":
            parts = sheets.plain_sheets(self.entity("xlsx_cells"), self.entity("xlsx_sheets"), self.entity("xlsx_ranges")).orderBy("doc_id", "ord")
        elif self.form == "docx":
            parts = self.entity("docx_blocks").select("doc_id", "ord", F.col("text").alias("rendered")).orderBy("doc_id", "ord")
        else:
            parts = self.entity("pptx_shapes").where("text <> ''").select("doc_id", "n", "ord", F.col("text").alias("rendered")).orderBy("doc_id", "n", "ord")
        yield from ((r["doc_id"], r["rendered"]) for r in parts.toLocalIterator())

    def units(self, headers: bool = False) -> DataFrame:
        """The text units that searches look in, with locators."""
        if self.form == "xlsx":
            found = documents.sheet_units(self.entity("xlsx_cells"), self.entity("xlsx_sheets"))
        elif self.form == "docx":
            found = documents.word_units(self.entity("docx_blocks"), self.entity("docx_table_cells"), self.entity("docx_notes"), self.entity("docx_objects"), headers)
        else:
            found = documents.deck_units(self.entity("pptx_paragraphs"), self.entity("pptx_table_cells"), self.entity("pptx_slides"), self.entity("pptx_comments"))
        return documents.locator(found)

    def find_text(self, query: str, ignore_case: bool = False, context: int = 80, offset: int = 0, limit: int = 20, headers: bool = False) -> DataFrame:
        units = self.units(headers).withColumn("__group", F.coalesce(F.concat_ws("|", "doc_id", "grp"), F.lit("")))
        units = units.withColumn("__group", F.when(F.col("grp").isNull(), F.concat_ws("|", "doc_id", "rank", F.col("ord").cast("string"))).otherwise(F.col("__group")))
        return find_text(units, query, ignore_case, context, "__group", ["doc_id", "rank", "ord"], offset, limit).drop("__group")

    def find_cells(self, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
        """Cells whose value, formula, comment or link (in this order, or of one kind) holds the text; ``limit`` of them, all for 0."""
        fields = {"value": "text", "formula": "formula", "comment": "comment", "hyperlink": "hyperlink"}
        if kind == "definedName":
            names = self.entity("xlsx_names")
            return names.where(F.col("name").contains(query) | F.col("refers_to").contains(query)).dropDuplicates(["doc_id", "name"])
        found = field_search(self.entity("xlsx_cells"), query, [fields[kind]] if kind else list(fields.values()))
        found = found.orderBy("doc_id", "sheet", "row", "col")
        return found.limit(limit) if limit > 0 else found

    def query(self, query: Query, **source) -> DataFrame:
        """The query over a table or range of the session's workbook."""
        return sheets.query_workbook(self.entity("xlsx_cells"), query, self.entity("xlsx_tables"), self.entity("xlsx_sheets"), **source)

    def describe(self) -> DataFrame:
        """What one needs to find one's way: sheets, pages or slides, and how many of what there is; no cells are read of workbooks."""
        if self.form == "xlsx":
            return self.entity("xlsx_sheets").groupBy("doc_id").agg(F.count("*").alias("sheets"), F.sort_array(F.collect_list(F.struct("ord", "name", "state", "kind"))).alias("parts"))
        if self.form == "docx":
            return self.entity("docx_blocks").groupBy("doc_id").agg(F.max("page_end").alias("pages"), F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("type") == "table").alias("tables"), F.count("*").alias("blocks"))
        return self.entity("pptx_slides").groupBy("doc_id").agg(F.max("n").alias("slides"), F.count_if(F.col("hidden")).alias("hidden"), F.count_if(F.col("notes").isNotNull()).alias("with_notes"))

    def resources(self) -> DataFrame:
        """The documents' images, charts, tables and pivots; no cells and no strings are read of workbooks."""
        if self.form == "xlsx":
            return documents.resource_catalog(self.entity("xlsx_drawings"), self.entity("xlsx_tables"), None, self.entity("xlsx_pivots"))
        return documents.resource_catalog(self.entity("docx_objects" if self.form == "docx" else "pptx_objects"), None, self.entity("charts"))

    def read_resource(self, kind: str, resource_id: str) -> bytes:
        """The bytes of an image or media file; KeyError where there is none."""
        kind = RESOURCE_KINDS.get(kind, kind)
        found = self.resources().where(F.col("kind").isin(kind, "picture" if kind == "image" else kind) & (F.col("id") == resource_id))
        parts = self.entity("parts").select("doc_id", F.col("name").alias("target"), "content")
        rows = found.join(parts, ["doc_id", "target"]).limit(1).collect()
        if not rows:
            raise KeyError(f"no {kind} {resource_id!r}")
        return bytes(rows[0]["content"])

    def render_resource(self, kind: str, resource_id: str) -> DataFrame:
        """A chart's points, a diagram's text, a table's cells, a pivot's axes, or the text that a picture draws."""
        kind = RESOURCE_KINDS.get(kind, kind)
        if kind == "chart":
            return documents.chart_points(self.entity("charts").where(F.col("part").endswith(f"/{resource_id}.xml")))
        if kind in ("smartart", "diagram"):
            return documents.diagram_text(self.entity("diagram_nodes"), self.entity("diagram_links"))
        if kind == "image-text":
            return self.entity("emf_texts")
        if kind == "pivot_table" and self.form == "xlsx":
            return sheets.pivot_fields(self.entity("xlsx_pivots"), self.entity("xlsx_pivot_caches")).where(F.col("id") == resource_id)
        if kind == "table" and self.form == "docx":
            return self.entity("docx_table_cells").where(F.col("table_id") == resource_id)
        if kind == "table" and self.form == "pptx":
            return self.entity("pptx_table_cells")
        raise ValueError(f"{self.form} files have no {kind}")

    def report(self) -> dict:
        """Warnings of files that can't be read, and how long what took."""
        found = self.entity("warnings").select("doc_id", "message").distinct().limit(1000).collect()
        return {"warnings": [r.asDict() for r in found], **self.metrics.report()}


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Files at a path with what identifies their revision: time, length and digest of the content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", "modificationTime", "length", F.sha2("content", 256).alias("revision"))


def parse(spark: SparkSession, path: str, density: str = "structural", **selection) -> dict:
    """One file as one result: its text with format, density, resources and warnings."""
    with Session(spark, path) as session:
        made = documents.envelope(session.render(density, **selection), session.form, density, session.resources(), session.entity("warnings")).collect()
        return json.loads(made[0]["json"]) if made else {"text": "", "warnings": [r["message"] for r in session.entity("warnings").collect()]}
