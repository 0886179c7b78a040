"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions import colors, equations, number_format, numbering, references
from lexigrain.plans.registry import query, table


@query("q_a1_coordinates", """
with n as (select p_partkey, p_partkey % 16384 + 1 as c from part)
select p_partkey, case when c > 702 then chr(65 + (c - 703) // 676 % 26) else '' end || case when c > 26 then chr((65 + (c - 27) // 26 % 26)::integer) else '' end || chr((65 + (c - 1) % 26)::integer) as letters, c::integer as back from n""".replace("chr(65 + (c - 703) // 676 % 26)", "chr((65 + (c - 703) // 676 % 26)::integer)"))
def q_a1_coordinates(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 16384 + 1).alias("c"))
    lettered = n.select("p_partkey", references.column_letters(F.col("c")).alias("letters"))
    return lettered.withColumn("back", references.column_number(F.col("letters")))


_ROMAN_SQL = "||".join(f"['', {', '.join(repr(w) for w in words)}][(k // {place} % 10)::integer + 1]" for place, words in ((10, ["X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]), (1, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])))


@query("q_number_sequences", f"""
with n as (select n_nationkey + 1 as k from nation)
select k, {_ROMAN_SQL} as roman, repeat(chr((97 + (k - 1) % 26)::integer), ((k - 1) // 26 + 1)::integer) as letters,
  k || case when k % 100 between 11 and 13 then 'th' when k % 10 = 1 then 'st' when k % 10 = 2 then 'nd' when k % 10 = 3 then 'rd' else 'th' end as ordinal, lpad(k::varchar, 2, '0') as padded from n""")
def q_number_sequences(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    return n.select("k", numbering.roman_column(F.col("k")).alias("roman"), numbering.repeated_column(F.col("k")).alias("letters"), numbering.ordinal_column(F.col("k")).alias("ordinal"), F.lpad(F.col("k").cast("string"), 2, "0").alias("padded"))


@query("q_format_fastpath", "select o_orderkey, format('{:,.2f}', o_totalprice) as shown from orders")
def q_format_fastpath(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", number_format.thousands(F.col("o_totalprice")).alias("shown"))


@query("q_excel_serial_date", "select o_orderkey, (o_orderdate::date - date '1899-12-30')::integer as serial, year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) as shown from orders")
def q_excel_serial_date(spark, sf_dir):
    serial = table(spark, sf_dir, "orders").select("o_orderkey", number_format.serial_date(F.col("o_orderdate").cast("date")).alias("serial"))
    return serial.withColumn("shown", number_format.formatted(F.col("serial").cast("string"), "yyyy/m/d"))


@query("q_format_full", "select p_partkey, case when p_size >= 25 then '(big ' || p_size || ')' else p_size || '.0%' end as shown from part")
def q_format_full(spark, sf_dir):
    raw = F.when(F.col("p_size") >= 25, F.col("p_size")).otherwise(F.col("p_size") / 100).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", number_format.formatted(raw, '[>=25]"(big "0")";0.0%').alias("shown"))


#: Formats that SQL can write, by how they count: letters in turn, letters as far as they go, digits for digits, letters repeated.
_FAMILIES = {
    "cycled": {"aiueoFullWidth": numbering.AIUEO, "aiueo": numbering.AIUEO_HALF, "irohaFullWidth": numbering.IROHA[:-1], "ganada": numbering.GANADA, "chosung": numbering.CHOSUNG},
    "bounded": {"ideographTraditional": numbering.STEMS, "ideographZodiac": numbering.BRANCHES, "decimalEnclosedCircle": numbering.spans((0x2460, 0x2473)), "decimalEnclosedParen": numbering.spans((0x2474, 0x2487)), "decimalEnclosedFullstop": numbering.spans((0x2488, 0x249B))},
    "digits": {"decimal": "0123456789", "decimalFullWidth": "０１２３４５６７８９", "hindiNumbers": "०१२३४५६७८९", "thaiNumbers": "๐๑๒๓๔๕๖๗๘๙", "ideographDigital": "〇一二三四五六七八九", "taiwaneseDigital": "○一二三四五六七八九", "koreanDigital": "영일이삼사오육칠팔구"},
    "repeated": {"lowerLetter": "abcdefghijklmnopqrstuvwxyz", "russianLower": numbering.RUSSIAN, "arabicAlpha": "", "chicago": "*†‡§"},
}
_FAMILIES["repeated"].pop("arabicAlpha")
_FAMILY_SQL = ", ".join(f"('{name}', '{family}', '{letters}')" for family, formats in _FAMILIES.items() for name, letters in formats.items())


@query("q_numbering_full", f"""
with n as (select n_nationkey + 1 as k from nation)
select k, format, case family when 'cycled' then substr(l, ((k - 1) % length(l) + 1)::integer, 1) when 'bounded' then case when k <= length(l) then substr(l, k::integer, 1) else k::varchar end
  when 'digits' then translate(k::varchar, '0123456789', l) else repeat(substr(l, ((k - 1) % length(l) + 1)::integer, 1), ((k - 1) // length(l) + 1)::integer) end as label
from n, (values {_FAMILY_SQL}) f(format, family, l)""")
def q_numbering_full(spark, sf_dir):
    names = F.array(*(F.lit(name) for formats in _FAMILIES.values() for name in formats))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"), F.explode(names).alias("format"))
    return n.withColumn("label", references.string_udf(lambda k, f: numbering.format_number(int(k), f), F.col("k").cast("string"), F.col("format")))


@query("q_formula_shift", "select s_suppkey, 'SUM(A' || (1 + s_suppkey % 7) || ':$B$2)*C' || (3 + s_suppkey % 7) as shifted from supplier")
def q_formula_shift(spark, sf_dir):
    rows = (F.col("s_suppkey") % 7).cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", references.string_udf(lambda r: references.shift_formula("SUM(A1:$B$2)*C3", int(r), 0), rows).alias("shifted"))


_SCRIPT = '<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:f><m:num><m:r><m:t>{}</m:t></m:r></m:num><m:den><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:den></m:f></m:oMath>'


@query("q_equation_latex", "select r_regionkey, '\\frac{' || r_regionkey || '}{{x}^{2}}' as latex from region")
def q_equation_latex(spark, sf_dir):
    head, tail = _SCRIPT.split("{}")
    xml = F.concat(F.lit(head), F.col("r_regionkey").cast("string"), F.lit(tail))
    return table(spark, sf_dir, "region").select("r_regionkey", references.string_udf(equations.to_latex, xml).alias("latex"))


@query("q_color_resolve", """
with s as (select r_regionkey * 20 + 12 as share, slot, step from region, (values ('lt1', 'lumMod'), ('bg1', 'shade'), ('dk1', 'lumOff'), ('tx1', 'tint')) v(slot, step))
select share, slot, step, '#' || repeat(lpad(upper(to_hex(round(255 * case when step = 'tint' then 100 - share else share end / 100.0)::integer)), 2, '0'), 3) as color from s""")
def q_color_resolve(spark, sf_dir):
    cases = F.array(*(F.struct(F.lit(a).alias("slot"), F.lit(b).alias("step")) for a, b in (("lt1", "lumMod"), ("bg1", "shade"), ("dk1", "lumOff"), ("tx1", "tint"))))
    shares = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 20 + 12).alias("share"), F.explode(cases).alias("c"))
    color = references.string_udf(lambda slot, step, share: colors.resolve("scheme", slot, [(step, int(share) / 100)]), F.col("c.slot"), F.col("c.step"), F.col("share").cast("string"))
    return shares.select("share", "c.slot", "c.step", color.alias("color"))
