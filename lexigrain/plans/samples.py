"""Office files that the queries make from the tables, and what their SQL has in common. Tasks import this module; it registers nothing."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.sources import making
from lexigrain.sources.making import grid, paragraph

NATIONS = "n as (select n_regionkey::integer as region, n_nationkey::integer as k, trim(n_name) as name, row_number() over (partition by n_regionkey order by n_nationkey) as pos, count(*) over (partition by n_regionkey) as size from nation)"


def nations(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("int").alias("region"), F.col("n_nationkey").cast("int").alias("k"), F.trim("n_name").alias("name"))


def region_of(name: str = "doc_id") -> Column:
    return F.regexp_extract(name, r"(\d+)\.\w+$", 1).cast("int")


def ledger(rows: list[dict]) -> bytes:
    """All suppliers in one sheet, their codes spelled in four ways."""
    spell = {0: lambda c: f"00{c}", 1: lambda c: f"{c}.0", 2: lambda c: f" {c} ", 3: str}
    body = [["key", "code", "", "nation", "amount"]] + [[r["k"], spell[r["k"] % 4](r["k"] % 5), None, r["nation"], f"{r['k'] % 7}.50"] for r in rows]
    part = f'<table {making.SHEET} displayName="ledger" ref="A1:E{len(body)}"><tableColumns>' + "".join(f'<tableColumn name="{n}"/>' for n in ("key", "code", " ", "nation", "amount")) + "</tableColumns></table>"
    return making.workbook([("Data", body), ("Other", [["x"]])], sheet_links={1: [("t1", "table", "../tables/table1.xml")]}, parts={"xl/tables/table1.xml": part})


S = making.SHEET


def atlas(rows: list[dict]) -> bytes:
    """A region's nations with merges, links, hidden columns, formulas, comments, rules, a pivot and drawings."""
    n = len(rows)
    body = [["name", "key", "twice", "note"]] + [[r["name"], r["k"], f'<c r="C{i}"><f>B{i}*2</f><v>{2 * r["k"]}</v></c>', None] for i, r in enumerate(rows, 2)]
    body.append([f'<c r="A{n + 2}" cm="1"><f t="array" ref="A{n + 2}:A{n + 4}">UNIQUE(A2:A4)</f><v>1</v></c>', f'<c r="B{n + 2}"><f t="dataTable" ref="B{n + 2}:C{n + 3}" dt2D="1" dtr="1" r1="B2" r2="C2"/><v>5</v></c>', 6])
    body.append([2, 7, 8])
    body.append([3])
    tail = (
        '<sheetProtection sheet="1" objects="1"/><mergeCells><mergeCell ref="A1:B1"/></mergeCells>'
        '<conditionalFormatting sqref="B2:B9"><cfRule type="cellIs" operator="greaterThan" priority="2"><formula>10</formula><extLst><ext><x14:id xmlns:x14="http://schemas.microsoft.com/office/spreadsheetml/2009/9/main">{AB}</x14:id></ext></extLst></cfRule><cfRule type="expression" priority="1"><formula>A1=1</formula></cfRule></conditionalFormatting>'
        '<dataValidations><dataValidation type="whole" sqref="B2:B9" allowBlank="1"><formula1>1</formula1><formula2>99</formula2></dataValidation><dataValidation type="list" sqref="A2 A3"><formula1>"a,b"</formula1></dataValidation></dataValidations>'
        '<hyperlinks><hyperlink ref="A2" r:id="h1" location="top"/></hyperlinks>'
        '<autoFilter ref="A1:C9"><filterColumn colId="1"><customFilters and="1"><customFilter operator="greaterThan" val="3"/><customFilter operator="lessThan" val="20"/></customFilters></filterColumn><filterColumn colId="0"><filters blank="1"><filter val="x"/></filters></filterColumn></autoFilter>'
        '<extLst><ext><x14:conditionalFormattings xmlns:x14="http://schemas.microsoft.com/office/spreadsheetml/2009/9/main" xmlns:xm="http://schemas.microsoft.com/office/excel/2006/main"><x14:conditionalFormatting><x14:cfRule type="dataBar" id="{ab}"><x14:dataBar><x14:cfvo type="min"/><x14:cfvo type="num"><xm:f>50</xm:f></x14:cfvo></x14:dataBar></x14:cfRule><xm:sqref>B2:B9</xm:sqref></x14:conditionalFormatting></x14:conditionalFormattings></ext></extLst>'
    )
    sheet = making.workbook([("Atlas", body)], tails={1: tail}, sheet_links={1: [("h1", "hyperlink", "http://a.example/", True), ("c1", "comments", "../comments1.xml"), ("t1", "threadedComment", "../threadedComments/t1.xml"), ("p1", "pivotTable", "../pivotTables/pivot1.xml"), ("d1", "drawing", "../drawings/drawing1.xml")]}, book=f'<definedNames><definedName name="Rate">Atlas!$B$2</definedName><definedName name="Tax">Rate*0.2</definedName><definedName name="Total">Tax+Base</definedName><definedName name="Base">Atlas!$B$3</definedName><definedName name="Alone">5</definedName></definedNames><pivotCaches><pivotCache cacheId="{rows[0]["region"]}" r:id="pc"/><pivotCache cacheId="77" r:id="pc"/><pivotCache cacheId="77" r:id="pc"/></pivotCaches>', book_links=[("pc", "pivotCacheDefinition", "pivotCache/cache1.xml"), ("md", "sheetMetadata", "metadata.xml"), ("st", "styles", "styles.xml")], parts={
        "xl/comments1.xml": f'<comments {S}><authors><author>Ann</author></authors><commentList><comment ref="D2" authorId="0"><text><t>see {escape(rows[0]["name"])}</t></text></comment></commentList></comments>',
        "xl/persons/person.xml": '<personList xmlns="http://schemas.microsoft.com/office/spreadsheetml/2018/threadedcomments"><person displayName="Ann" id="P1"/></personList>',
        "xl/threadedComments/t1.xml": '<ThreadedComments xmlns="http://schemas.microsoft.com/office/spreadsheetml/2018/threadedcomments">' + "".join(f'<threadedComment ref="B{2 + i // 2}" id="T{r["k"]}" personId="P1" done="{i % 2}"' + (f' parentId="T{rows[i - 1]["k"]}"' if i % 2 else ' parentId="T999"' if i == 2 else "") + f'><text>{escape(r["name"])}</text></threadedComment>' for i, r in enumerate(rows)) + "</ThreadedComments>",
        "xl/pivotCache/cache1.xml": f'<pivotCacheDefinition {S} recordCount="{n}"><cacheSource><worksheetSource ref="A1:C9" sheet="Atlas"/></cacheSource><cacheFields><cacheField name="name"/><cacheField name="key"/></cacheFields></pivotCacheDefinition>',
        "xl/pivotTables/pivot1.xml": f'<pivotTableDefinition {S} name="P{rows[0]["region"]}" cacheId="{rows[0]["region"]}"><location ref="F1:G9"/><rowFields><field x="0"/></rowFields><colFields><field x="-2"/></colFields><dataFields><dataField name="Sum of key" fld="1"/></dataFields></pivotTableDefinition>',
        "xl/metadata.xml": f'<metadata {S} xmlns:xda="http://schemas.microsoft.com/office/spreadsheetml/2017/dynamicarray"><metadataTypes><metadataType name="XLDAPR"/></metadataTypes><futureMetadata name="XLDAPR"><bk><extLst><ext><xda:dynamicArrayProperties fDynamic="1"/></ext></extLst></bk></futureMetadata><cellMetadata><bk><rc t="1" v="0"/></bk></cellMetadata></metadata>',
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="0.0"/></numFmts><fonts><font/><font><b/><color rgb="FFFF0000"/></font></fonts><fills><fill/><fill><patternFill patternType="solid"><fgColor theme="4" tint="0.5"/></patternFill></fill></fills><cellXfs><xf/><xf numFmtId="164" fontId="1" fillId="1"><protection locked="0"/></xf><xf numFmtId="44"/></cellXfs></styleSheet>',
        "xl/drawings/drawing1.xml": '<xdr:wsDr xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><xdr:twoCellAnchor><xdr:from><xdr:col>5</xdr:col><xdr:row>1</xdr:row></xdr:from><xdr:to><xdr:col>7</xdr:col><xdr:row>4</xdr:row></xdr:to><xdr:grpSp><xdr:nvGrpSpPr><xdr:cNvPr id="10" name="Group 1"/></xdr:nvGrpSpPr><xdr:sp><xdr:nvSpPr><xdr:cNvPr id="11" name="Box" descr="a box"/></xdr:nvSpPr><xdr:txBody><a:p><a:r><a:t>boxed</a:t></a:r></a:p></xdr:txBody></xdr:sp></xdr:grpSp></xdr:twoCellAnchor><xdr:twoCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:row>20</xdr:row></xdr:from><xdr:cxnSp><xdr:nvCxnSpPr><xdr:cNvPr id="12" name="Line"/><xdr:cNvCxnSpPr><a:stCxn id="11" idx="0"/><a:endCxn id="13" idx="0"/></xdr:cNvCxnSpPr></xdr:nvCxnSpPr></xdr:cxnSp></xdr:twoCellAnchor><xdr:twoCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:row>30</xdr:row></xdr:from><xdr:sp><xdr:nvSpPr><xdr:cNvPr id="13" name="End"/></xdr:nvSpPr></xdr:sp></xdr:twoCellAnchor><xdr:twoCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:row>40</xdr:row></xdr:from><xdr:sp><xdr:nvSpPr><xdr:cNvPr id="14" name="Far"/></xdr:nvSpPr></xdr:sp></xdr:twoCellAnchor></xdr:wsDr>',
    })
    return sheet


def atlas_of_region(rows: list[dict]) -> bytes:
    return atlas([{**r, "region": r["r"]} for r in rows])


def report(rows: list[dict]) -> bytes:
    """A region's nations: a heading, a paragraph with notes each on its own page, controls, a compatibility block, a table."""
    note = lambda kind, n: f'<w:r><w:{kind}Reference w:id="{n}"/></w:r>'
    body = paragraph(f"Region {rows[0]['r']}", '<w:pStyle w:val="H2"/>')
    for i, r in enumerate(rows):
        turn = '<w:r><w:br w:type="page"/></w:r>' if i else ""
        body += f"<w:p>{turn}<w:r><w:t>{escape(r['name'])}</w:t></w:r>{note('footnote', i + 1)}{note('endnote', 1) if i < 2 else ''}</w:p>"
    body += f'<w:sdt><w:sdtPr><w:alias w:val="Notes"/><w:lock w:val="sdtLocked"/></w:sdtPr><w:sdtContent>{paragraph("first of two")}{paragraph("second of two")}</w:sdtContent></w:sdt>'
    box = "<w:r><w:drawing><wp:inline><wp:docPr id=\"1\" name=\"Text Box 1\" descr=\"a box\"/><a:graphic><a:graphicData><wps:wsp><wps:txbx><w:txbxContent>" + paragraph("boxed") + "</w:txbxContent></wps:txbx></wps:wsp></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>"
    body += f'<w:p><w:r><w:t>around </w:t></w:r><mc:AlternateContent><mc:Choice Requires="wps">{box}</mc:Choice><mc:Fallback><w:r><w:t>fallback</w:t></w:r></mc:Fallback></mc:AlternateContent><mc:AlternateContent><mc:Choice Requires="unknown"><w:r><w:t>lost</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>kept</w:t></w:r></mc:Fallback></mc:AlternateContent><w:bookmarkStart w:id="1" w:name="here"/><w:bookmarkStart w:id="2" w:name="unused"/></w:p>'
    body += '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> REF here \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:rPr><w:b/><w:color w:val="auto" w:themeColor="accent1"/></w:rPr><w:t>see there</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    body += grid([["nation", "key"], *([r["name"], str(r["k"])] for r in rows)])
    notes = "".join(f'<w:footnote w:id="{i + 1}">{paragraph("key " + str(r["k"]))}</w:footnote>' for i, r in enumerate(rows))
    styles = '<w:style w:type="paragraph" w:styleId="H1"><w:pPr><w:outlineLvl w:val="1"/></w:pPr><w:rPr><w:b/><w:color w:val="112233"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H2"><w:basedOn w:val="H1"/><w:rPr><w:i/><w:color w:val="445566"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="C1"><w:basedOn w:val="C2"/></w:style><w:style w:type="paragraph" w:styleId="C2"><w:basedOn w:val="C1"/></w:style><w:style w:type="table" w:styleId="T"><w:rPr><w:i/></w:rPr><w:tblStylePr w:type="firstRow"><w:rPr><w:b/></w:rPr></w:tblStylePr><w:tblStylePr w:type="band2Horz"><w:rPr><w:i w:val="0"/></w:rPr></w:tblStylePr></w:style>'
    return making.document(
        body,
        parts={"word/styles.xml": f"<w:styles {making.WORD}>{styles}</w:styles>", "word/footnotes.xml": f"<w:footnotes {making.WORD}>{notes}</w:footnotes>", "word/endnotes.xml": f'<w:endnotes {making.WORD}><w:endnote w:id="1">{paragraph("the end")}</w:endnote></w:endnotes>', "word/comments.xml": f'<w:comments {making.WORD}><w:comment w:id="3" w:author="Ann">{paragraph("well said")}</w:comment></w:comments>'},
        own_links=[("s", "styles", "styles.xml"), ("f", "footnotes", "footnotes.xml"), ("e", "endnotes", "endnotes.xml"), ("c", "comments", "comments.xml")],
    )


def talk(rows: list[dict]) -> bytes:
    """A region's nations, a slide each: a title, a list, a table with merges, a group, a link, notes; comments and sections."""
    slides, slide_links, ids = [], {}, "".join(f'<p14:sldId id="{256 + i}"/>' for i in range(2))
    for i, r in enumerate(rows, 1):
        title = making.text_shape(2, "Title 1", [r["name"]], None, '<p:ph type="title"/>')
        auto = '<a:p><a:pPr><a:buAutoNum type="romanUcPeriod"/></a:pPr><a:r><a:t>{}</a:t></a:r></a:p>'
        text = making.text_shape(3, "List", [auto.format("key"), auto.format(r["k"])], (100, 500, 40, 10))
        merged = making.table_shape(4, [['<a:tc gridSpan="2"><a:txBody><a:p><a:r><a:t>wide</a:t></a:r></a:p></a:txBody></a:tc>', '<a:tc hMerge="1"><a:txBody><a:p/></a:txBody></a:tc>'], [str(r["k"]), "x"]])
        group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="5" name="Group"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="1000" y="100"/><a:ext cx="200" cy="200"/><a:chOff x="0" y="0"/><a:chExt cx="100" cy="100"/></a:xfrm></p:grpSpPr>{making.text_shape(6, "Inner", ["inside"], (10, 20, 30, 40))}</p:grpSp>'
        line = '<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="7" name="Line"/><p:cNvCxnSpPr><a:stCxn id="3" idx="0"/><a:endCxn id="99" idx="0"/></p:cNvCxnSpPr></p:nvCxnSpPr><p:spPr/></p:cxnSp>'
        jump = f'<p:sp><p:nvSpPr><p:cNvPr id="8" name="Next"><a:hlinkClick r:id="{"j" if i == 1 else ""}" action="ppaction://{"hlinksldjump" if i == 1 else "hlinkshowjump?jump=nextslide"}"/></p:cNvPr></p:nvSpPr><p:spPr/></p:sp>'
        slides.append(title + text + merged + group + line + jump)
        slide_links[i] = [("l", "slideLayout", "../slideLayouts/layout1.xml"), ("c", "comments", f"../comments/comment{i}.xml"), *([("j", "slide", f"slide{len(rows)}.xml")] if i == 1 else [])]
    comments = {f"ppt/comments/comment{i}.xml": f'<p:cmLst {making.SLIDE}><p:cm authorId="0" dt="2024-01-01" idx="{i}"><p:text>on {escape(r["name"])}</p:text></p:cm></p:cmLst>' for i, r in enumerate(rows, 1)}
    layout = making.text_shape(2, "Title", [], (7, 8, 9, 10), '<p:ph type="title"/>')
    parts = {**comments, "ppt/commentAuthors.xml": f'<p:cmAuthorLst {making.SLIDE}><p:cmAuthor id="0" name="Bo"/></p:cmAuthorLst>', "ppt/slideLayouts/layout1.xml": f"<p:sldLayout {making.SLIDE}><p:cSld><p:spTree>{layout}</p:spTree></p:cSld></p:sldLayout>", "ppt/slideLayouts/_rels/layout1.xml.rels": making.links(("m", "slideMaster", "../slideMasters/master1.xml")), "ppt/slideMasters/master1.xml": f"<p:sldMaster {making.SLIDE}><p:cSld><p:spTree/></p:cSld></p:sldMaster>"}
    sections = f'<p:extLst><p:ext><p14:sectionLst xmlns:p14="http://schemas.microsoft.com/office/powerpoint/2010/main"><p14:section name="Opening"><p14:sldIdLst>{ids}</p14:sldIdLst></p14:section></p14:sectionLst></p:ext></p:extLst>'
    return making.deck(slides, notes={1: f"about {rows[0]['name']}"}, parts=parts, slide_links=slide_links, more=sections)


