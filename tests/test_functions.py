"""Scalar functions: formats, numerals, references, colors, equations."""

import pytest

from lexigrain.functions import colors, equations, number_format, numbering, references

FORMATS = [
    ("1234.5", "#,##0.00", "1,234.50"), ("-1234.5", "#,##0.00_);(#,##0.00)", "(1,234.50)"), ("1234.5", "¥#,##0", "¥1,235"), ("0.256", "0.0%", "25.6%"),
    ("12345", "0.00E+00", "1.23E+04"), ("12345", "##0.0E+0", "12.3E+3"), ("0.25", "# ?/?", "1/4"), ("1.5", "# ?/?", "1 1/2"), ("0.3", "# ?/8", "2/8"),
    ("60", "yyyy/m/d", "1900/2/29"), ("59", "yyyy/m/d", "1900/2/28"), ("61", "yyyy/m/d", "1900/3/1"), ("1", "yyyy/m/d", "1900/1/1"),
    ("44927", "dddd, mmmm d", "Sunday, January 1"), ("44927.52083", "m/d/yyyy h:mm", "1/1/2023 12:30"), ("0.5", "h:mm AM/PM", "12:00 PM"), ("0", "h AM/PM", "12 AM"), ("1.5", "[h]:mm", "36:00"), ("0.5", "h:mm:ss.0", "12:00:00.0"),
    ("44927", '0" days"', "44927 days"), ("abc", "@", "abc"), ("1234567", "#,##0,", "1,235"), ("0", "0;-0;zero", "zero"), ("5", '[>=100]"big";"small"', "small"),
    ("2.675", "0.00", "2.68"), ("5", "000", "005"), ("123456789012", "General", "1.23457E+11"), ("1234.5", "General", "1234.5"), ("0.1", "0", "0"), ("-0.4", "0", "0"), ("x", "0.00", "x"),
]


@pytest.mark.parametrize(("raw", "code", "shown"), FORMATS)
def test_display(raw, code, shown):
    assert number_format.format_value(raw, code) == shown


def test_other_date_system():
    assert number_format.format_value("0", "yyyy/m/d", True) == "1904/1/1"


def test_section_color():
    assert number_format.section_color("-1", "0;[Red]0") == "#FF0000"
    assert number_format.section_color("1", "0;[Red]0") is None


def test_numerals():
    assert [numbering.roman(n) for n in (1, 4, 1994, 3999)] == ["I", "IV", "MCMXCIV", "MMMCMXCIX"]
    assert [numbering.bijective(n) for n in (1, 26, 27, 53)] == ["a", "z", "aa", "ba"]
    assert [numbering.repeated(n) for n in (1, 26, 27, 53, 781)] == ["a", "z", "aa", "aaa", "781"]
    assert [numbering.format_number(n, "ordinalText") for n in (1, 12, 20, 21, 103)] == ["First", "Twelfth", "Twentieth", "Twenty-first", "One hundred third"]
    assert [numbering.chinese(n) for n in (0, 10, 15, 105, 1010, 10_203, 120_000)] == ["零", "十", "十五", "一百零五", "一千零一十", "一万零二百零三", "十二万"]
    # above what a format can write nothing is shown
    assert numbering.format_number(70_000, "hex") == "" and numbering.format_number(3, "no such") == "3"
    assert numbering.auto_number(3, "romanUcParenBoth") == "(III)"
    assert numbering.fill_template("%1.%2%%", [3, 2], ["upperRoman", "lowerLetter"]) == "III.b%"
    assert numbering.fill_template("%1.%2", [3, 2], ["upperRoman", "lowerLetter"], legal=True) == "3.2"


@pytest.mark.parametrize(("name", "n", "want"), [
    ("chineseCountingThousand", 10_050, "一万〇五十"), ("taiwaneseCountingThousand", 1_010, "一千零一十"), ("chineseLegalSimplified", 12_345, "壹萬贰仟叁佰肆拾伍"), ("japaneseCounting", 1_105, "千一百五"), ("japaneseLegal", 21, "弐拾壱"),
    ("koreanCounting", 12_345, "만이천삼백사십오"), ("koreanLegal", 21, "스물하나"), ("hebrew1", 115, "קטו"), ("hebrew2", 23, "\u200fאת"), ("ideographZodiacTraditional", 61, "甲子"), ("thaiCounting", 121, "หนึ่งร้อยยี่สิบเอ็ด"), ("vietnameseCounting", 21, "Hai mươi mốt"), ("chicago", 5, "**"), ("decimalEnclosedCircleChinese", 11, "11"),
])
def test_word_formats(name, n, want):
    assert numbering.format_number(n, name) == want


def test_languages_and_patterns():
    assert [numbering.format_number(n, "cardinalText", "es-ES") for n in (21, 100, 1_999, 31_021)] == ["Veintiuno", "Cien", "Mil novecientos noventa y nueve", "Treinta y un mil veintiuno"]
    assert [numbering.format_number(n, "ordinalText", "de") for n in (1, 3, 19, 21, 101)] == ["Erste", "Dritte", "Neunzehnte", "Einundzwanzigste", "Einhunderterste"]
    assert (numbering.format_number(1, "ordinal", "fr"), numbering.format_number(29, "lowerLetter", "nb")) == ("1er", "å")
    assert [numbering.custom_number(7, p) for p in ("(001)", "Art. I", "ｱ", "xyz", "a0")] == ["(007)", "Art. VII", "ｷ", None, None]
    assert [numbering.auto_number(27, s) for s in ("alphaLcParenRight", "arabicDbPeriod", "hebrew2Minus", "circleNumDbPlain")] == ["aa)", "２７．", "27", "27"]


def test_chinese_numbers_and_edit_forms():
    assert [number_format.chinese_value(v, 1) for v in ("0", "10", "10010", "100000001", "-2.5")] == ["○", "一十", "一万○一十", "一亿○一", "-二.五"]
    assert number_format.chinese_value("12345", 2) == "壹万贰仟叁佰肆拾伍"
    told = [("1500", "#,##0.00"), ("0.25", "0%"), ("44927", "yyyy/m/d"), ("1e16", "0"), ("0.1234567890123456", "0"), ("-0.50", "General"), ("x", "0")]
    assert [number_format.formula_bar(*t) for t in told] == ["1500", None, None, None, None, "-0.5", None]
    assert [number_format.built_in_code(n) for n in (5, 44, 14, 999)] == ["$#,##0_);($#,##0)", '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', "m/d/yyyy", "General"] and number_format.built_in_code(31, "zh_CN") == 'yyyy"年"m"月"d"日"'


def test_colors_and_fields():
    from lexigrain.functions import text_marks

    assert colors.spreadsheet_color({"indexed": "10"}) == "#FF0000" and colors.spreadsheet_color({"theme": "1"}) == "#000000" and colors.spreadsheet_color({"rgb": "FF00FF00", "tint": "0.5"}) == "#80FF80" and colors.spreadsheet_color({"auto": "1"}) is None
    assert colors.word_color("auto") is None and colors.word_color("ff0000") == "#FF0000" and colors.word_color("x", "text1") == "#000000"
    assert text_marks.field(' HYPERLINK "a \\"b\\" c" \\l "x" ') == {"kind": "hyperlink", "href": 'a "b" c', "anchor": "x"} and text_marks.field("PAGE") is None and text_marks.field("REF b \\h") == {"kind": "reference", "anchor": "b"}
    for bad in ('REF "open', "REF a b", "REF a \\z", "HYPERLINK \\l"):
        with pytest.raises(ValueError):
            text_marks.field(bad)


def test_native_numerals(spark):
    n = spark.range(1, 4000)
    for r in n.select("id", numbering.roman_column(n["id"]), numbering.repeated_column(n["id"]), numbering.ordinal_column(n["id"])).collect():
        assert tuple(r)[1:] == (numbering.roman(r["id"]), numbering.repeated(r["id"]), numbering.ordinal(r["id"]))


def test_native_letters(spark):
    n = spark.range(1, 16_385)
    lettered = n.select("id", references.column_letters(n["id"]).alias("l"))
    for r in lettered.select("id", "l", references.column_number(lettered["l"]).alias("back")).collect():
        assert r["l"] == references.letters_of(r["id"]) and r["back"] == r["id"] == references.number_of(r["l"])


@pytest.mark.parametrize(("formula", "rows", "columns", "want"), [
    ("SUM(A1:$B$2)+C3*\"A1\"", 1, 1, "SUM(B2:$B$2)+D4*\"A1\""), ("'My A1'!A1+Sheet1!B$2", 2, 0, "'My A1'!A3+Sheet1!B$2"), ("A1", -1, 0, "#REF!"),
    ("LOG10(A1)+A:B+1:2", 1, 1, "LOG10(B2)+B:C+2:3"), ("Table1[A1]+name_A1", 1, 1, "Table1[A1]+name_A1"), ("XFD1", 0, 1, "#REF!"),
])
def test_shifted_formulas(formula, rows, columns, want):
    assert references.shift_formula(formula, rows, columns) == want


def test_ranges():
    assert references.parse_range("B2:D10") == (2, 2, 10, 4) and references.parse_range("10:20") == (10, 1, 20, 16_384) and references.parse_range("c3") == (3, 3, 3, 3)
    for bad in ("D4:A1", "XFE1", "A0", "hello", "A1048577"):
        with pytest.raises(ValueError):
            references.parse_range(bad)
    assert references.formula_areas('SUM($A$1:B2)+A1+"C3"') == ["A1", "B2"]


def test_colors():
    assert colors.resolve("scheme", "accent1", [("lumMod", 0.75)]) == "#2F5597"
    assert colors.resolve("scheme", "tx1") == "#000000" and colors.resolve("preset", "red") == "#FF0000" and colors.resolve("scheme", "none") is None
    assert colors.resolve("srgb", "808080", [("shade", 0.5)]) == "#404040" and colors.with_tint("FFFFFF", -0.5) == "808080"


M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
run_ = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"


@pytest.mark.parametrize(("inside", "latex"), [
    (f"<m:f><m:num>{run_('a')}</m:num><m:den>{run_('b')}</m:den></m:f>", r"\frac{a}{b}"),
    (f"<m:rad><m:deg>{run_('3')}</m:deg><m:e>{run_('x')}</m:e></m:rad>", r"\sqrt[3]{x}"),
    (f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{run_("i")}</m:sub><m:sup>{run_("n")}</m:sup><m:e>{run_("i")}</m:e></m:nary>', r"\sum_{i}^{n} i"),
    (f"<m:d><m:e>{run_('x')}</m:e></m:d>", r"\left(x\right)"),
    (f"<m:m><m:mr><m:e>{run_('a')}</m:e><m:e>{run_('b')}</m:e></m:mr><m:mr><m:e>{run_('c')}</m:e><m:e>{run_('d')}</m:e></m:mr></m:m>", r"\begin{matrix}a & b \\ c & d\end{matrix}"),
    (f"<m:func><m:fName>{run_('sin')}</m:fName><m:e>{run_('α')}</m:e></m:func>", r"\sin \alpha"),
    (f"<m:sSubSup><m:e>{run_('x')}</m:e><m:sub>{run_('1')}</m:sub><m:sup>{run_('2')}</m:sup></m:sSubSup>", "{x}_{1}^{2}"),
])
def test_equations(inside, latex):
    assert equations.to_latex(f"<m:oMath {M}>{inside}</m:oMath>") == latex


def test_broken_equation():
    assert equations.to_latex("<m:oMath") == ""
