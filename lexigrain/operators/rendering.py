"""Plain text and XML made from ordered rows, with native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_text(text: Column, attribute: bool = False) -> Column:
    """Text with the characters escaped that XML needs; carriage returns as references, others that XML forbids dropped."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")] + [('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")] * attribute
    for plain, escaped in pairs:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def element(tag: str, attributes: dict[str, Column], inside: Column | None = None) -> Column:
    """An element with sorted attributes; names take - for _, null ones are left out, booleans are lower case."""
    parts = [F.lit("<" + tag)]
    for name in sorted(attributes):
        value = attributes[name]
        parts.append(F.coalesce(F.concat(F.lit(f' {name.replace("_", "-")}="'), xml_text(value.cast("string"), True), F.lit('"')), F.lit("")))
    if inside is None:
        return F.concat(*parts, F.lit("/>"))
    return F.concat(*parts, F.lit(">"), inside, F.lit(f"</{tag}>"))


def joined(df: DataFrame, keys: list[str], order: list[str], part: Column, between: str, name: str) -> DataFrame:
    """Each group's parts in order as one text; a group is one document's rows."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, part.alias("__part"))))
    grouped = df.groupBy(*keys).agg(ordered.alias("__parts"))
    return grouped.select(*keys, F.array_join(F.transform("__parts", lambda p: p["__part"]), between).alias(name))


def marked_pages(df: DataFrame, keys: list[str], page: str, order: list[str], text: str, header: dict[str, Column]) -> DataFrame:
    """Plain text of each group: a line of sorted key=value, then pages behind ``<page=N>`` lines.

    A text line that looks like a marker is escaped by a backslash.
    """
    safe = F.regexp_replace(F.col(text), r"(?m)^(\\*<page=\d+>)$", r"\\$1")
    paged = joined(df, [*keys, page], order, safe, "\n", "__page")
    body = joined(paged, keys, [page], F.concat(F.lit("<page="), F.col(page).cast("string"), F.lit(">\n"), F.col("__page")), "\n", "__body")
    line = F.concat_ws(" ", *(F.concat(F.lit(k + "="), header[k].cast("string")) for k in sorted(header)))
    return body.select(*keys, F.concat(line, F.lit("\n"), "__body").alias("rendered"))


def check_plain(rendered: str) -> list[int]:
    """The page numbers of a plain text; ValueError where its header or the order of its pages is wrong."""
    head, _, body = rendered.partition("\n")
    names = [x.partition("=")[0] for x in head.split(" ")]
    if "=" not in head or names != sorted(names):
        raise ValueError("the first line has sorted key=value fields")
    pages = [int(n) for n in re.findall(r"(?m)^<page=(\d+)>$", body)]
    if any(b <= a for a, b in zip(pages, pages[1:])):
        raise ValueError("page markers increase")
    return pages


def query_result(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """A query's rows as one XML table: headers of the columns that some row has, then the rows in order.

    It is for the limited result of a query, which one task writes.
    """
    present = df.agg(*(F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in columns)).first()
    shown = [c for c in columns if present[c]]
    cells = F.concat(*(F.coalesce(element("td", {}, xml_text(F.col(c).cast("string"))), F.lit("<td/>")) for c in shown)) if shown else F.lit("")
    rows = joined(df, [], [row], element("tr", {}, cells), "", "rows")
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in shown) + "</tr>"
    return rows.select(F.concat(F.lit("<workbook><query><table>" + head), "rows", F.lit("</table></query></workbook>")).alias("rendered"))
