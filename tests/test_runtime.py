"""Sessions, tools, kept results, admission, metrics and image text providers."""

import io
import json
import struct

import pytest

from lexigrain.operators import ocr, sheets
from lexigrain.plans import samples
from lexigrain.plans.query import Aggregate, Query
from lexigrain.runtime import metrics, session, tools
from lexigrain.sources import emf, making
from lexigrain.streaming import arrivals

ROWS = [{"region": 1, "r": 1, "k": k, "name": n} for k, n in ((3, "CANADA"), (17, "PERU"), (24, "UNITED STATES"), (1, "ARGENTINA"))]
PIXEL = b"\x89PNG\r\n\x1a\nrest"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    (path / "atlas.xlsx").write_bytes(samples.atlas_of_region(ROWS))
    (path / "ledger.xlsx").write_bytes(samples.ledger([{"k": k, "nation": k % 3} for k in range(1, 30)]))
    (path / "report.docx").write_bytes(samples.report(ROWS))
    (path / "talk.pptx").write_bytes(samples.talk(ROWS))
    (path / "broken.docx").write_bytes(samples.report(ROWS)[:700])
    return str(path)


def test_session_of_a_workbook(spark, folder):
    with session.Session(spark, f"{folder}/ledger.xlsx") as s:
        assert s.describe().first()["sheets"] == 2
        text = s.render("plain").first()["rendered"]
        assert text.startswith("density=plain format=xlsx\n<sheet name=Data>\n[Table ledger A1:E30]\nkey\tcode\t\tnation\tamount\n1\t1.0\t\t1\t1.50\n")
        assert '<cell>1.50</cell>' in s.render("structural", "Data", "E2:E3").first()["rendered"]
        found = s.query(Query(group_by=["nation"], aggregates=[Aggregate("count", "key", "n")]), table_id="table-0").collect()
        assert sorted(tuple(r) for r in found) == [("0", "9"), ("1", "10"), ("2", "10")]
        assert [r["ref"] for r in s.find_cells("29").collect()] == ["A30"]
        assert s.find_text("1.50", limit=2).where("has_more").count() == 2
        assert list(s.iter_render("plain"))[1][1] == "<sheet name=Other>\nx\n"
        assert {"xlsx_cells", "render"} <= s.report()["stages_ms"].keys()
        for bad in (lambda: s.render("loud"), lambda: s.render(range_spec="A1"), lambda: s.entity("docx_blocks"), lambda: s.render(sheet="Gone")):
            with pytest.raises(ValueError):
                bad()


def test_sessions_of_stories(spark, folder):
    with session.Session(spark, f"{folder}/report.docx") as s:
        assert s.describe().first()["pages"] == 4
        assert "PERU" in s.render("plain", start=2, span=1).first()["rendered"] and "CANADA" not in s.render("plain", start=2, span=1).first()["rendered"]
        assert s.find_text("boxed").count() == 1 and s.find_text("the end").first()["locator"]["source"] == "endnote"
        assert s.render_resource("table", "table-0").count() == 10
    with session.Session(spark, f"{folder}/talk.pptx") as s:
        assert s.describe().first()["slides"] == 4 and s.render("plain", start=-1).first()["rendered"].count("=== Slide") == 1
        assert s.find_text("wide").count() == 4 and s.resources().count() == 0
    with session.Session(spark, f"{folder}/broken.docx") as s:
        assert s.report()["warnings"] and s.render("plain").count() == 0
    told = session.parse(spark, f"{folder}/report.docx", "plain")
    assert told["format"] == "docx" and told["media_type"] == "text/plain" and "CANADA [fn1: key 3]" in told["text"]
    assert session.snapshot(spark, folder).select("revision").distinct().count() == 5


def test_resources(spark, tmp_path):
    body = '<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" name="Picture 1" descr="a dot"/><a:graphic><a:graphicData><a:blip r:embed="i"/></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    (tmp_path / "p.docx").write_bytes(making.document(body, {"word/media/i.png": PIXEL}, [("i", "image", "media/i.png")]))
    with session.Session(spark, str(tmp_path / "p.docx")) as s:
        assert [(r["kind"], r["id"], r["label"]) for r in s.resources().collect()] == [("image", "image1", "a dot")]
        assert s.read_resource("images", "image1") == PIXEL
        with pytest.raises(KeyError):
            s.read_resource("image", "image2")
        seen = []
        read = lambda: lambda data: ocr.OcrResult("ok", "dot", (("dot", 0.9),))
        found = ocr.recognise_shown(s.entity("docx_objects"), s.entity("parts"), read).collect()
        assert [(r["ocr_text"], r["ocr_confidence"]) for r in found] == [("dot", 0.9)] and not seen
        assert ocr.recognise_shown(s.entity("docx_objects"), s.entity("parts"), read, 3).first()["ocr_status"] == "error"


def test_tools(spark, folder):
    runtime = tools.Runtime(spark, [folder])
    call = lambda name, **a: runtime.execute(name, a)
    got = call("query_xlsx_data", path=f"{folder}/ledger.xlsx", table_id="table-0", group_by=["code"], aggregates=[{"column": "nation", "op": "max", "as": "top"}], order_by=[{"column": "top"}, {"column": "code", "direction": "desc"}])
    assert got["ok"] and [r["code"] for r in got["data"]["rows"]] == ["4", "3", "2", "1.0", "0.0"][: len(got["data"]["rows"])] and {r["top"] for r in got["data"]["rows"]} == {"2"}
    key = got["data"]["document_id"]
    assert call("read_xlsx", document_id=key)["data"]["sheets"] == ["Data", "Other"]
    assert call("find_xlsx_cells", document_id=key, query="code")["data"]["cells"][0]["ref"] == "B1"
    assert call("find_document_text", document_id=key, query="0.50", limit=1)["data"]["next_offset"] == 1
    assert call("read_pptx", path=f"{folder}/talk.pptx", density="plain", slide_start=2, slide_end=2)["data"]["text"].count("===") == 2
    word = call("render_docx_resource", path=f"{folder}/report.docx", kind="table", resource_id="table-0", aggregate="sum", aggregate_column="key")
    assert word["data"]["value"] == 45.0
    part = call("render_docx_resource", path=f"{folder}/report.docx", kind="table", resource_id="table-0", rows="2-3", columns=["nation"])
    assert [r["text"] for r in part["data"]["rows"]] == ["CANADA", "PERU"]
    assert call("inspect_document", path=f"{folder}/talk.pptx")["data"]["about"][0]["slides"] == 4
    assert call("list_document_resources", path=f"{folder}/atlas.xlsx")["ok"] and call("get_runtime_info")["data"]["documents"]
    codes = {
        "UNKNOWN_TOOL": ("no_tool", {}), "INVALID_ARGUMENTS": ("read_docx", {"path": f"{folder}/talk.pptx"}), "PATH_NOT_ALLOWED": ("read_docx", {"path": "/etc/a.docx"}),
        "DOCUMENT_NOT_FOUND": ("read_docx", {"path": f"{folder}/none.docx"}), "NOT_FOUND": ("read_result", {"result_id": "result-9"}),
    }
    for code, (name, arguments) in codes.items():
        assert runtime.execute(name, arguments)["error"]["code"] == code
    for name, arguments in (("read_docx", {"path": "x", "document_id": "y"}), ("find_document_text", {"path": "x", "query": ""}), ("read_xlsx", {"path": "x", "more": 1}), ("find_xlsx_cells", {"path": "x", "query": "y", "limit": 0})):
        assert runtime.execute(name, arguments)["error"]["code"] == "INVALID_ARGUMENTS"
    assert call("release_document", document_id=key)["ok"] and not call("read_xlsx", document_id=key)["ok"]
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_runtime_info"}}, {"jsonrpc": "2.0", "id": 4, "method": "else"}]
    sink = io.StringIO()
    tools.serve(runtime, io.StringIO("\n".join(map(json.dumps, lines)) + "\nno json\n"), sink)
    said = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [m.get("id") for m in said] == [1, 2, 3, 4, None] and len(said[1]["result"]["tools"]) == 15 and not said[2]["result"]["isError"] and said[3]["error"]["code"] == -32601


def test_kept_results_and_admission():
    kept = metrics.Results(most_bytes=10)
    a = kept.put("abcdef", "d")
    assert kept.read(a, 2, 3) == {"piece": "cde", "total": 6, "next_offset": 5}
    b = kept.put(b"12345678")
    with pytest.raises(KeyError):
        kept.read(a)
    assert kept.read(b, 6)["piece"] == b"78" and kept.read(b, 6)["next_offset"] is None
    with pytest.raises(ValueError):
        kept.put("x" * 11)
    room = metrics.Admission(100, 2)
    assert room.admit("a", 60) == [] and room.admit("b", 30) == [] and room.admit("c", 30) == ["a"] and room.expired(0) == ["b", "c"]
    with pytest.raises(MemoryError):
        room.admit("d", 101)
    assert metrics.session_bytes(10, [100, 200], 1 << 30) == (1 << 20) + 10 * 1024 + 600 + 2400 + (8 << 20)


def test_metrics_and_stopping(spark):
    told = []
    m = metrics.Metrics(told.append)
    with m.stage("read"):
        df = m.counted(spark.range(7), "rows")
        assert df.count() == 7
    assert told == ["read"] and m.report()["counters"] == {"rows": 7} and m.report()["total_ms"] >= m.report()["stages_ms"]["read"]
    with metrics.Control(spark, "a tag") as control:
        control.checkpoint("one")
        control.stop()
        with pytest.raises(metrics.Cancelled):
            control.checkpoint("two")


def test_word_scores():
    table = "level\tconf\ttext\n5\t96.5\tHello\n5\t-1\t\n5\tx\ty\n5\t50\tyou"
    assert ocr.word_scores(table) == (("Hello", 0.965), ("you", 0.5)) and ocr.word_scores("") == ()
    assert ocr.OcrResult("ok", "", ocr.word_scores(table)).confidence == pytest.approx((5 * 0.965 + 3 * 0.5) / 8)
    answers = iter([None, {"text": "hi", "scores": [("hi", 1.0)]}])
    assert ocr.remote(lambda data: "job", lambda job: next(answers), 3, 0)()(b"").text == "hi"
    assert ocr.remote(lambda data: "job", lambda job: None, 2, 0)()(b"").status == "error"


def test_metafile_text():
    header = struct.pack("<II", 1, 88) + bytes(32) + b" EMF" + bytes(44)
    words = "Größe".encode("utf-16-le")
    record = struct.pack("<II", 84, 8 + 68 + 12) + bytes(36) + struct.pack("<II", 5, 76) + bytes(24) + words + bytes(2)
    assert emf.drawn(header + record + struct.pack("<II", 14, 20) + bytes(12)) == ["Größe"]
    with pytest.raises(ValueError):
        emf.drawn(b"none")


def test_streams_of_rows(spark):
    rows = spark.createDataFrame([("d", 3, "c"), ("d", 1, "a")], "doc string, row int, text string")
    notes = spark.createDataFrame([("d", 2, "n"), ("d", 3, "m")], "doc string, row int, note string")
    assert [(r["row"], r["text"], r["note"]) for r in arrivals.merged_by_row(rows, notes, ["doc"]).collect()] == [(1, "a", None), (2, None, "n"), (3, "c", "m")]
    assert [r["text"] for r in arrivals.first_rows(rows, ["row"], 1)] == ["a"] and list(arrivals.pieces(rows, ["row"], "text")) == ["a", "c"]


def test_ranges():
    assert sheets.area("10:20") == (10, 1, 20, 16_384) and sheets.area("$B$2:C3") == (2, 2, 3, 3) and sheets.area("b2") == (2, 2, 2, 2)
    for bad in ("B2:A1", "A0", "XFE1", "A1:A1048577", "A:B", "Sheet!A1", ""):
        with pytest.raises(ValueError):
            sheets.area(bad)


def test_many_rectangles_over_many_cells(spark):
    import random

    rng = random.Random(2)
    boxes = []
    for _ in range(60):
        top, left = rng.randint(1, 300), rng.randint(1, 30)
        boxes.append(("d", top, left, top + rng.choice([0, 1, 7, 200]), left + rng.choice([0, 3, 40])))
    cells = [("d", rng.randint(1, 400), rng.randint(1, 60)) for _ in range(800)]
    c, b = spark.createDataFrame(cells, "doc string, row int, col int"), spark.createDataFrame(boxes, "doc string, top int, left int, bottom int, right int")
    want = sorted((r, k, *x[1:]) for _, r, k in cells for x in boxes if x[1] <= r <= x[3] and x[2] <= k <= x[4])
    assert sorted((r["row"], r["col"], r["top"], r["left"], r["bottom"], r["right"]) for r in sheets.covering(c, b, ["doc"]).collect()) == want
    assert sheets.covering(c, b, ["doc"], "left_anti").count() == len(cells) - sum(any(x[1] <= r <= x[3] and x[2] <= k <= x[4] for x in boxes) for _, r, k in cells)
    assert sheets.covering(c, b.limit(0), ["doc"]).count() == 0
