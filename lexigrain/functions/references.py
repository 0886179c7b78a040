"""Cell references: letters, A1 ranges, and formulas that hold them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The grid's last row and column.
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384


def column_letters(number: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to XFD; null outside the grid. Native."""
    n = number.cast("int")
    third, second, first = (n - 703) / 676, (n - 27) / 26, n - 1
    letter = lambda x: F.char((F.pmod(F.floor(x), F.lit(26)) + 65).cast("int"))
    text = F.concat(F.when(n > 702, letter(third)).otherwise(""), F.when(n > 26, letter(second)).otherwise(""), letter(first))
    return F.when((n >= 1) & (n <= LAST_COLUMN), text)


def column_number(letters: Column) -> Column:
    """A -> 1, XFD -> 16384; null for other text. Native."""
    upper = F.upper(letters)
    digits = F.transform(F.split(upper, ""), lambda c: F.ascii(c) - 64)
    n = F.aggregate(digits, F.lit(0), lambda a, x: a * 26 + x)
    return F.when(upper.rlike("^[A-Z]{1,3}$") & (n <= LAST_COLUMN), n)


def letters_of(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def number_of(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def parse_range(text: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of `A1:H20`, `10:20` (whole rows) or one cell.

    ValueError where it is none, is out of the grid, or runs backwards.
    """
    if m := re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", text):
        out = int(m[1]), 1, int(m[2]), LAST_COLUMN
    elif m := re.fullmatch(r"\s*([A-Za-z]{1,3})(\d+)(?:\s*:\s*([A-Za-z]{1,3})(\d+))?\s*", text):
        out = int(m[2]), number_of(m[1]), int(m[4] or m[2]), number_of(m[3] or m[1])
    else:
        raise ValueError(f"{text!r} is no range like A1:H20, 10:20 or A1")
    if not (1 <= out[0] <= out[2] <= LAST_ROW and 1 <= out[1] <= out[3] <= LAST_COLUMN):
        raise ValueError(f"{text!r} is out of the grid or runs backwards")
    return out


#: Text, quoted sheets and brackets, which stay as they are, or a reference.
_PIECE = re.compile(
    r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'!?|\[[^\]]*\]"
    r"|(?<![A-Za-z0-9_.\\])(?:(\$?)([A-Za-z]{1,3})(\$?)(\d{1,7})(?![A-Za-z0-9_.(!])|(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})(?![A-Za-z0-9_.(!])|(\$?)(\d{1,7}):(\$?)(\d{1,7})(?![A-Za-z0-9_.(!]))"
)


def shift_formula(formula: str, rows: int, columns: int) -> str:
    """The formula as it reads so many rows and columns further on.

    Relative parts move, parts after ``$`` stay; text, brackets and quoted sheet
    names are left alone; what leaves the grid is ``#REF!``.
    """

    def column(fixed: str, letters: str) -> str | None:
        n = number_of(letters) + (0 if fixed else columns)
        return fixed + letters_of(n) if 1 <= n <= LAST_COLUMN else None

    def row(fixed: str, digits: str) -> str | None:
        n = int(digits) + (0 if fixed else rows)
        return f"{fixed}{n}" if 1 <= n <= LAST_ROW else None

    def moved(m: re.Match) -> str:
        if m[2]:
            if number_of(m[2]) > LAST_COLUMN:
                return m[0]
            parts, join = (column(m[1], m[2]), row(m[3], m[4])), ""
        elif m[6]:
            parts, join = (column(m[5], m[6]), column(m[7], m[8])), ":"
        elif m[10]:
            parts, join = (row(m[9], m[10]), row(m[11], m[12])), ":"
        else:
            return m[0]
        return "#REF!" if None in parts else join.join(parts)

    return _PIECE.sub(moved, formula)


def formula_areas(formula: str) -> list[str]:
    """The cell and whole-row or whole-column references in a formula, without ``$``, in order, each once."""
    out: list[str] = []
    for m in _PIECE.finditer(formula):
        if m[2] or m[6] or m[10]:
            area = m[0].replace("$", "").upper()
            if area not in out:
                out.append(area)
    return out


def string_udf(function: Callable[..., str | None], *columns: Column) -> Column:
    """A Python function of texts over Arrow batches, computed once for each distinct tuple in a batch; null in, null out."""
    @F.pandas_udf("string")
    def apply(rows: pd.DataFrame) -> pd.Series:
        known: dict[tuple, str | None] = {}
        out = []
        for row in zip(*(rows[c] for c in rows)):
            if row not in known:
                known[row] = None if any(v is None or v != v for v in row) else function(*row)
            out.append(known[row])
        return pd.Series(out, dtype=object)

    return apply(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))))
