"""Office entity tables from small packages made here."""

import io
import zipfile

import pytest

from lexigrain.sources import office
from lexigrain.sources.package import Package, PackageError, resolve_target, safe_name

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


def links(*items):
    inner = "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"{mode}/>' for i, kind, target, mode in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"[Content_Types].xml": TYPES, **parts}.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    ns = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{REL}"'
    return package({
        "_rels/.rels": links(("r1", "officeDocument", "xl/workbook.xml", "")),
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Data" sheetId="1" r:id="r1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="r9"/></sheets><definedNames><definedName name="Total">Data!$C$4</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": links(("r1", "worksheet", "worksheets/sheet1.xml", ""), ("r2", "sharedStrings", "sharedStrings.xml", ""), ("r3", "styles", "/xl/styles.xml", "")),
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Region</t></si><si><r><t>Ea</t></r><r><t>st</t></r><rPh><t>x</t></rPh></si><si><t>a_x000D_b</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c t="inlineStr"><is><t>Rep</t></is></c></row>'
        '<row><c t="s"><v>1</v></c><c s="1"><v>0.256</v></c><c s="2"><v>44927</v></c><c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c></row>'
        '<row r="4"><c r="C4"><f t="shared" si="0" ref="C4:C5">A4*$B$1</f><v>3</v></c></row><row r="5"><c r="C5"><f t="shared" si="0"/><v>4</v></c><c r="D5" t="s"><v>99</v></c><c r="E5"/></row></sheetData>'
        '<mergeCells><mergeCell ref="A1:B1"/></mergeCells><hyperlinks><hyperlink ref="A2" r:id="r1" location="x"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": links(("r1", "hyperlink", "http://a.example/", ' TargetMode="External"'), ("r2", "comments", "../comments1.xml", ""), ("r3", "table", "../tables/table1.xml", "")),
        "xl/comments1.xml": f'<comments {ns}><commentList><comment ref="A2"><text><t>see this</t></text></comment></commentList></comments>',
        "xl/tables/table1.xml": f'<table {ns} displayName="sales" ref="A1:B2"><tableColumns><tableColumn name="Region"/><tableColumn name="Rep"/></tableColumns></table>',
    })


def writing():
    ns = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="{REL}"'
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda text, level: p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>')
    return package({
        "_rels/.rels": links(("r1", "officeDocument", "word/document.xml", "")),
        "word/document.xml": f"<w:document {ns}><w:body>" + p("Title", '<w:pStyle w:val="H"/>') + item("one", 0) + item("sub", 1) + item("sub again", 1) + item("two", 0) + item("sub new", 1)
        + '<w:p><w:r><w:br w:type="page"/><w:t>next page</w:t></w:r></w:p><w:p/>'
        + "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></w:p>"
        + "<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:tc></w:tr>"
        + "".join(f'<w:tr><w:tc><w:tcPr><w:vMerge{v}/></w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{n}</w:t></w:r></w:p></w:tc></w:tr>' for v, t, n in ((' w:val="restart"', "A", 1), ("", "", 2)))
        + "</w:tbl></w:body></w:document>",
        "word/_rels/document.xml.rels": links(("r1", "styles", "styles.xml", ""), ("r2", "numbering", "numbering.xml", ""), ("r3", "comments", "comments.xml", "")),
        "word/styles.xml": f'<w:styles {ns}><w:style w:styleId="B"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="H"><w:basedOn w:val="B"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {ns}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/comments.xml": f'<w:comments {ns}><w:comment w:id="7" w:author="Ann"><w:p><w:r><w:t>fine</w:t></w:r></w:p></w:comment></w:comments>',
    })


def deck():
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{REL}"'
    shape = '<p:sp><p:nvSpPr><p:cNvPr id="2" name="Body"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="5" y="6"/><a:ext cx="7" cy="8"/></a:xfrm></p:spPr><p:txBody>{}</p:txBody></p:sp>'
    listed = '<a:p><a:pPr><a:buAutoNum type="alphaLcParenR"/></a:pPr><a:r><a:t>{}</a:t></a:r></a:p>'
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda inside, more="": f"<p:sld {ns}{more}><p:cSld><p:spTree>{inside}</p:spTree></p:cSld></p:sld>"
    return package({
        "_rels/.rels": links(("r1", "officeDocument", "ppt/presentation.xml", "")),
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": links(("r1", "slide", "slides/slide1.xml", ""), ("r2", "slide", "slides/slide2.xml", "")),
        "ppt/slides/slide1.xml": slide(table, ' show="0"'),
        "ppt/slides/slide2.xml": slide(shape.format(listed.format("first") + listed.format("second"))),
    })


def figures():
    ns = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram"'
    cache = lambda tag, *items: f"<c:{tag}><c:strCache>" + "".join(f'<c:pt idx="{k}"><c:v>{v}</c:v></c:pt>' for k, v in items) + f"</c:strCache></c:{tag}>"
    word = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    node = lambda i, t: f'<dgm:pt modelId="{i}"><dgm:t>{word(t) if t else ""}</dgm:t></dgm:pt>'
    series = "<c:ser>" + cache("tx", (0, "Sales")) + cache("cat", (0, "Q1"), (2, "Q3")) + cache("val", (0, "1"), (1, "2"), (1, "5")) + "</c:ser>"
    levels = '<c:ser><c:cat><c:multiLvlStrRef><c:lvl><c:pt idx="0"><c:v>Jan</c:v></c:pt></c:lvl><c:lvl><c:pt idx="0"><c:v>2024</c:v></c:pt></c:lvl></c:multiLvlStrRef></c:cat></c:ser>'
    return package({
        "_rels/.rels": links(("r1", "officeDocument", "ppt/presentation.xml", "")),
        "ppt/presentation.xml": "<x/>",
        "ppt/charts/chart1.xml": f'<c:chartSpace {ns}><c:chart><c:title><c:tx><c:rich>{word("Total")}</c:rich></c:tx></c:title><c:plotArea><c:barChart>{series}</c:barChart><c:lineChart>{levels}</c:lineChart><c:valAx><c:axId val="7"/></c:valAx></c:plotArea></c:chart></c:chartSpace>',
        "ppt/diagrams/data1.xml": f'<dgm:dataModel {ns}><dgm:ptLst>{node("a", "Start")}{node("b", "")}{node("c", "")}</dgm:ptLst><dgm:cxnLst><dgm:cxn modelId="1" srcId="a" destId="b"/><dgm:cxn modelId="2" type="presOf" srcId="a" destId="zz"/></dgm:cxnLst></dgm:dataModel>',
    })


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("office")
    for name, data in (("a.xlsx", workbook()), ("b.docx", writing()), ("c.pptx", deck()), ("d.zip", figures()), ("bad.docx", b"not a zip"), ("empty.xlsx", package({}))):
        (path / name).write_bytes(data)
    return str(path)


def rows(spark, folder, entity, *order):
    return [r.asDict() for r in office.read_office(spark, folder, entity).orderBy(*order).collect()]


def test_cells(spark, folder):
    cells = {r["ref"]: r for r in rows(spark, folder, "xlsx_cells", "row", "col")}
    shown = {k: r["text"] for k, r in cells.items()}
    assert shown == {"A1": "Region", "B1": "Rep", "A2": "East", "B2": "25.6%", "C2": "1/1/2023", "D2": "TRUE", "E2": "#DIV/0!", "C4": "3", "C5": "4", "D5": "", "E5": None}
    assert (cells["A1"]["colspan"], cells["B1"]["shadow"], cells["C5"]["formula"]) == (2, True, "A5*$B$1")
    assert (cells["A2"]["hyperlink"], cells["A2"]["comment"]) == ("http://a.example/#x", "see this")


def test_workbook_catalogs(spark, folder):
    assert [(r["name"], r["state"], r["kind"]) for r in rows(spark, folder, "xlsx_sheets", "ord")] == [("Data", "visible", "worksheet"), ("Gone", "hidden", "missing")]
    assert [(r["id"], r["name"], r["columns"]) for r in rows(spark, folder, "xlsx_tables", "id")] == [("table-0", "sales", ["Region", "Rep"])]
    assert [r["refers_to"] for r in rows(spark, folder, "xlsx_names", "name")] == ["Data!$C$4"]


def test_blocks(spark, folder):
    blocks = rows(spark, folder, "docx_blocks", "ord")
    assert [(r["type"], r["text"], r["label"], r["page"]) for r in blocks] == [
        ("heading", "Title", None, 1), ("paragraph", "one", "I.", 1), ("paragraph", "sub", "I.a", 1), ("paragraph", "sub again", "I.b", 1), ("paragraph", "two", "II.", 1), ("paragraph", "sub new", "II.a", 1),
        ("paragraph", "next page", None, 2), ("paragraph", "new$x$", None, 2), ("table", "Head\nA\t1\n\t2", None, 2),
    ]
    assert blocks[0]["level"] == 1


def test_table_cells_and_notes(spark, folder):
    cells = rows(spark, folder, "docx_table_cells", "row", "col")
    assert [(r["row"], r["col"], r["row_span"], r["col_span"], r["text"], r["is_header"]) for r in cells] == [(0, 0, 1, 2, "Head", True), (1, 0, 2, 1, "A", False), (1, 1, 1, 1, "1", False), (2, 1, 1, 1, "2", False)]
    assert [(r["kind"], r["id"], r["author"], r["text"]) for r in rows(spark, folder, "docx_notes", "id")] == [("comment", "7", "Ann", "fine")]


def test_slides(spark, folder):
    assert [(r["n"], r["hidden"], r["part"]) for r in rows(spark, folder, "pptx_slides", "n")] == [(1, False, "ppt/slides/slide2.xml"), (2, True, "ppt/slides/slide1.xml")]
    assert [(r["n"], r["type"], r["text"], r["x"]) for r in rows(spark, folder, "pptx_shapes", "n", "ord")] == [(1, "text", "a) first\nb) second", 5), (2, "table", "k\tv", None)]


def test_packages(spark, folder):
    assert {r["doc_id"].rsplit("/", 1)[1] for r in rows(spark, folder, "warnings", "doc_id")} == {"bad.docx", "empty.xlsx"}
    assert {"xl/workbook.xml", "word/document.xml"} <= {r["name"] for r in rows(spark, folder, "package_entries", "name")}
    assert any(r["external"] and r["target"] == "http://a.example/" for r in rows(spark, folder, "relationships", "id"))
    with pytest.raises(ValueError):
        office.read_office(spark, folder, "nothing")


@pytest.mark.parametrize("name", ["../a", "/a", "C:\\a", "a/../../b"])
def test_unsafe_names(name):
    assert not safe_name(name)
    with pytest.raises(PackageError):
        Package(package({name: "x"}))


def test_refused_packages():
    with pytest.raises(PackageError):
        Package(package({"a": "0" * 20_000_000}))  # packed too tightly
    with pytest.raises(PackageError):
        Package(package({"A.xml": "x", "a.xml": "y"}))
    assert resolve_target("xl/worksheets/sheet1.xml", "../tables/t.xml") == "xl/tables/t.xml"
    assert resolve_target("xl/a.xml", "/xl/b.xml") == "xl/b.xml"


def test_charts_and_diagrams(spark, folder):
    series = rows(spark, folder, "charts", "series")
    assert [(r["type"], r["plot"], r["title"], r["name"], r["categories"], r["values"]) for r in series] == [("combination", "barChart", "Total", "Sales", ["Q1", "", "Q3"], ["1", "5"]), ("combination", "lineChart", "Total", None, ["2024 / Jan"], [])]
    assert series[0]["axes"] == {"7": ""}
    assert [(r["node"], r["text"]) for r in rows(spark, folder, "diagram_nodes", "node")] == [(1, "Start"), (2, "")]
    assert [(r["kind"], r["from_node"], r["to_node"]) for r in rows(spark, folder, "diagram_links", "kind")] == [("parOf", 1, 2), ("presOf", 1, None)]
