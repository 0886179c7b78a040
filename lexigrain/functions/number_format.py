"""Spreadsheet display formats: a number and a format code give the text that is shown.

A code is compiled once into sections of tokens; values are Python decimals, so
rounding is half up on what the cell says, not on a binary neighbour.
"""

from __future__ import annotations

import datetime
import functools
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.references import string_udf

# Built-in formats by id.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00",
    5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
    59: "t0", 60: "t0.00", 61: "t#,##0", 62: "t#,##0.00", 67: "t0%", 68: "t0.00%", 69: "t# ?/?", 70: "t# ??/??",
    71: "ว/ด/ปปปป", 72: "ว-ดดด-ปป", 73: "ว-ดดด", 74: "ดดด-ปป", 75: "ช:นน", 76: "ช:นน:ทท", 77: "ว/ด/ปปปป ช:นน", 78: "นน:ทท", 79: "[ช]:นน:ทท", 80: "นน:ทท.0", 81: "d/m/bb",
}
# Built-in formats that depend on the language, as they are in Simplified Chinese.
BUILT_IN_CHINESE = {
    14: "yyyy/m/d", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "yyyy/m/d h:mm",
    27: 'yyyy"年"m"月"', 28: 'm"月"d"日"', 29: 'm"月"d"日"', 30: "m-d-yy", 31: 'yyyy"年"m"月"d"日"', 32: 'h"时"mm"分"', 33: 'h"时"mm"分"ss"秒"', 34: '上午/下午 h"时"mm"分"', 35: '上午/下午 h"时"mm"分"ss"秒"', 36: 'yyyy"年"m"月"',
    50: 'yyyy"年"m"月"', 51: 'm"月"d"日"', 52: 'yyyy"年"m"月"', 53: 'm"月"d"日"', 54: 'm"月"d"日"', 55: '上午/下午 h"时"mm"分"', 56: '上午/下午 h"时"mm"分"ss"秒"', 57: 'yyyy"年"m"月"', 58: 'm"月"d"日"',
}
# Numerals of the three number styles of Simplified Chinese, and their units.
CHINESE_DIGITS = {1: "○一二三四五六七八九", 2: "零壹贰叁肆伍陆柒捌玖", 3: "０１２３４５６７８９"}
CHINESE_UNITS = {1: "十百千", 2: "拾佰仟", 3: "十百千"}
CHINESE_GROUPS = ("", "万", "亿", "兆")


def built_in_code(number: int, locale: str = "en-US") -> str:
    """The code of a built-in format; languages that aren't known have the standard ones."""
    if locale.replace("_", "-").lower() == "zh-cn" and number in BUILT_IN_CHINESE:
        return BUILT_IN_CHINESE[number]
    return BUILT_IN.get(number, "General")


def chinese_count(value: int, style: int) -> str:
    """A whole number below 10 ** 16 with positional units: groups of four digits, a zero where places are left out."""
    digits, units = CHINESE_DIGITS[style], CHINESE_UNITS[style]
    if not value:
        return digits[0]
    if not 0 < value < 10**16:
        raise ValueError("counted are numbers from 0 to 10 ** 16")
    shown = str(value)
    shown = shown.zfill(-(-len(shown) // 4) * 4)
    out, gap = "", False
    for a in range(0, len(shown), 4):
        group = shown[a : a + 4]
        for place, digit in enumerate(group):
            if digit == "0":
                gap = bool(out)
                continue
            out += (digits[0] if gap else "") + digits[int(digit)] + (units[2 - place] if place < 3 else "")
            gap = False
        if group.strip("0"):
            out += CHINESE_GROUPS[(len(shown) - a) // 4 - 1]
            gap = False if group[3] != "0" else gap and False
    return out


def chinese_value(raw: str, style: int) -> str:
    """A number as `General` with a Chinese number style shows it; a fraction digit by digit, a sign in front."""
    value = Decimal(raw)
    size = abs(value)
    out = chinese_count(int(size), style)
    if size != size.to_integral_value():
        out += "." + format(size, "f").partition(".")[2].rstrip("0").translate(str.maketrans("0123456789", CHINESE_DIGITS[style]))
    return ("-" if value < 0 else "") + out


def formula_bar(raw: str, code: str) -> str | None:
    """What an editor shows of a number, whatever its format: its plain digits, 15 at most, from 1e-9 to 1e15.

    Null for dates, percentages and formats with letters of their own, whose edit
    form isn't the number.
    """
    try:
        value = Decimal(raw)
        section = choose(compile_code(code), value)[0]
        if not value.is_finite() or not code or section.is_date or any(t == "%" and k != "text" for k, t in section.tokens):
            return None
        if abs(value) >= Decimal("1e15") or 0 < abs(value) < Decimal("1e-9") or len(value.normalize().as_tuple().digits) > 15:
            return None
        text = format(value, "f")
        return "0" if not value else text.rstrip("0").rstrip(".") if "." in text else text
    except (ArithmeticError, ValueError, IndexError):
        return None
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
COLORS = {"black": "#000000", "red": "#FF0000", "green": "#00FF00", "blue": "#0000FF", "yellow": "#FFFF00", "magenta": "#FF00FF", "cyan": "#00FFFF", "white": "#FFFFFF"}

_TOKEN = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[([^\]]*)\]|(AM/PM|A/P|am/pm|a/p)|(General)|([yY]+|[mM]+|[dD]+|[hH]+|[sS]+)|([Ee][+-])|(\.0+(?=[^0#?]*$)|[0#?.,/%@])|(.)', re.S)


class Section:
    """Tokens (kind, text) of one section, its condition and color."""

    def __init__(self, code: str):
        self.tokens: list[tuple[str, str]] = []
        self.condition: tuple[str, Decimal] | None = None
        self.color: str | None = None
        self.elapsed = False
        for m in _TOKEN.finditer(code):
            text = m[0]
            if m[1] is not None:
                self.tokens.append(("text", m[1]))
            elif m[2]:
                self.tokens.append(("text", m[2]))
            elif m[3]:
                self.tokens.append(("text", " "))
            elif m[4]:
                pass
            elif m[5] is not None:
                self._bracket(m[5])
            elif m[6]:
                self.tokens.append(("half", text))
            elif m[7]:
                self.tokens.append(("general", text))
            elif m[8]:
                self.tokens.append(("date", text.lower()))
            elif m[9]:
                self.tokens.append(("power", text))
            elif m[10]:
                if text.startswith(".0") or text == ".":
                    self.tokens += [("digit", c) for c in text]
                else:
                    self.tokens.append(("digit" if text in "0#?.,/" else "mark", text))
            else:
                self.tokens.append(("text", text))
        kinds = {k for k, _ in self.tokens}
        self.is_date = "date" in kinds or "half" in kinds
        self.is_text = ("mark", "@") in self.tokens
        self.percent = sum(t == ("mark", "%") for t in self.tokens)
        if not self.is_date:
            self.tokens = [("text", t) if k == "date" else (k, t) for k, t in self.tokens]

    def _bracket(self, inside: str) -> None:
        low = inside.lower()
        if m := re.fullmatch(r"(<=|>=|<>|=|<|>)\s*(-?[\d.]+)", inside):
            self.condition = m[1], Decimal(m[2])
        elif low in COLORS:
            self.color = COLORS[low]
        elif re.fullmatch(r"h+|m+|s+", low):
            self.tokens.append(("date", f"[{low}]"))
            self.elapsed = True
        elif inside.startswith("$"):
            self.tokens.append(("text", inside[1:].split("-")[0]))

    def holds(self, value: Decimal) -> bool:
        op, bound = self.condition
        return {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound, "=": value == bound, "<>": value != bound}[op]


def split_sections(code: str) -> list[str]:
    """At semicolons outside quotes, brackets and escapes; four at most."""
    parts, now = [], ""
    for m in re.finditer(r'"[^"]*"|\\.|\[[^\]]*\]|;|.', code, re.S):
        if m[0] == ";":
            parts.append(now)
            now = ""
        else:
            now += m[0]
    return [*parts, now][:4]


@functools.lru_cache(maxsize=4096)
def compile_code(code: str) -> tuple[Section, ...]:
    return tuple(Section(c) for c in split_sections(code))


def choose(sections: tuple[Section, ...], value: Decimal) -> tuple[Section, Decimal]:
    """The section for a number, and the number it shows."""
    numeric = list(sections[:3])
    if any(s.condition for s in numeric):
        for s in numeric:
            if s.condition is None or s.holds(value):
                return s, abs(value) if s.condition and value < 0 and s is not numeric[0] else value
        return numeric[-1], value
    if value < 0 and len(sections) > 1:
        return sections[1], abs(value)
    if value == 0 and len(sections) > 2:
        return sections[2], value
    return sections[0], value


def general(value: Decimal) -> str:
    """Eleven significant digits at most, in scientific form where those don't show it."""
    if value == 0:
        return "0"
    size = abs(value)
    if size >= Decimal(10) ** 11 or size < Decimal("1e-9"):
        mantissa, power = f"{value:.5E}".split("E")
        return f"{mantissa.rstrip('0').rstrip('.')}E{power[0]}{power[1:].zfill(2)}"
    places = max(0, 10 - max(0, size.adjusted())) if size >= 1 else 9
    text = f"{value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _fill(pattern: str, digits: str, from_left: bool) -> str:
    """Digits in a pattern of 0 # ?; unfilled places are 0, nothing, or a space."""
    blank = {"0": "0", "#": "", "?": " "}
    if from_left:
        kept = digits.rstrip("0")
        return "".join(kept[i] if i < len(kept) else blank[p] for i, p in enumerate(pattern))
    digits = digits.lstrip("0")
    extra = max(0, len(digits) - len(pattern))
    rest = digits[extra:].rjust(len(pattern), "\0")
    return digits[:extra] + "".join(blank[p] if d == "\0" else d for p, d in zip(pattern, rest))


def _number(section: Section, value: Decimal) -> str:
    tokens = section.tokens
    places = [i for i, (k, _) in enumerate(tokens) if k == "digit"]
    if not places:
        return "".join(general(abs(value)) if k == "general" else t for k, t in tokens if k != "power")
    text = "".join(tokens[i][1] for i in places)
    if "/" in text and any(c in text.split("/")[0] for c in "0#?"):
        return _fraction(section, value)
    whole, _, part = text.partition(".")
    scale = len(whole) - len(whole.rstrip(","))
    if not part:
        whole = whole.rstrip(",")
    else:
        scale = len(part) - len(part.rstrip(","))
    part = part.replace(",", "").replace(".", "")
    group = "," in whole
    whole = whole.replace(",", "")
    value = abs(value) * Decimal(100) ** section.percent / Decimal(1000) ** scale
    power_at = next((i for i, (k, _) in enumerate(tokens) if k == "power"), None)
    power_text = ""
    if power_at is not None:
        mantissa = [c for i in places if i < power_at for c in tokens[i][1]]
        whole, _, part = "".join(mantissa).replace(",", "").partition(".")
        step = max(1, len(whole))
        power = (value.adjusted() // step * step if step > 1 else value.adjusted()) if value else 0
        shown = value.scaleb(-power).quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_UP)
        if shown >= Decimal(10) ** step:
            power += step
            shown = value.scaleb(-power).quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_UP)
        value = shown
        sign = "-" if power < 0 else "+" if tokens[power_at][1][1] == "+" else ""
        width = sum(1 for i in places if i > power_at)
        power_text = f"E{sign}{str(abs(power)).zfill(width)}"
    value = value.quantize(Decimal(1).scaleb(-len(part)), ROUND_HALF_UP)
    left, _, right = f"{value:f}".partition(".")
    left, right = _fill(whole, left, False), _fill(part, right.ljust(len(part), "0"), True)
    if group:
        body = left.lstrip(" ")
        left = left[: len(left) - len(body)] + re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", body)
    shown = left + ("." + right if "." in text.split("E")[0] and (part or text.endswith(".")) else "")
    out, done = [], False
    for i, (k, t) in enumerate(tokens):
        if k == "digit":
            if not done:
                out.append(shown)
                done = True
        elif k == "power":
            out.append(power_text)
        elif k == "general":
            out.append(general(value))
        else:
            out.append(t)
    return "".join(out)


def _fraction(section: Section, value: Decimal) -> str:
    tokens = section.tokens
    text = "".join(t if k == "digit" else " " if t == " " else "" for k, t in tokens)
    head, _, below = text.partition("/")
    head, below = head.strip(), below.strip()
    with_whole = " " in head
    over = head.split(" ")[-1]
    size = abs(value)
    whole = int(size) if with_whole else 0
    rest = Fraction(size) - whole
    below_digits = "".join(t for k, t in tokens[next(i for i, x in enumerate(tokens) if x == ("digit", "/")) + 1 :] if t.strip())
    if below_digits.isdigit() and int(below_digits):
        bottom = int(below_digits)
        top = int((Decimal(rest.numerator) / Decimal(rest.denominator) * bottom).quantize(Decimal(1), ROUND_HALF_UP))
    else:
        near = rest.limit_denominator(10 ** len(below) - 1)
        top, bottom = near.numerator, near.denominator
    if with_whole and top == bottom:
        whole, top = whole + 1, 0
    if with_whole and top == 0:
        return str(whole)
    part = f"{str(top).rjust(len(over) if over.startswith('?') else 0)}/{str(bottom).ljust(len(below) if below.startswith('?') else 0)}".strip()
    return f"{whole} {part}" if with_whole and whole else part


def serial_parts(value: Decimal, date_1904: bool = False) -> tuple[int, int, int, int, Decimal, int, Decimal]:
    """(year, month, day, weekday from Monday, seconds in the day, whole days, serial) of a serial date.

    In the 1900 system serial 60 is 29 February 1900, a day that never was.
    """
    milliseconds = (value * 86_400_000).quantize(Decimal(1), ROUND_HALF_UP)
    days, rest = divmod(int(milliseconds), 86_400_000)
    seconds = Decimal(rest) / 1000
    if date_1904:
        day = datetime.date(1904, 1, 1) + datetime.timedelta(days)
    elif days == 60:
        return 1900, 2, 29, 2, seconds, days, value
    else:
        day = datetime.date(1899, 12, 31 if 0 < days < 60 else 30) + datetime.timedelta(days) if days != 0 else datetime.date(1899, 12, 31)
    weekday = day.weekday() if date_1904 or days > 60 else (days + 5) % 7
    return day.year, day.month, day.day, weekday, seconds, days, value


def _date(section: Section, value: Decimal, date_1904: bool) -> str:
    tokens = section.tokens
    half = any(k == "half" for k, _ in tokens)
    fraction = max((len(t) for k, t in [("digit", "".join(t for k, t in tokens if k == "digit"))] if t.startswith(".")), default=0)
    places = max(0, fraction - 1)
    seconds_exact = value * 86_400
    year, month, day, weekday, seconds, days, _ = serial_parts(value, date_1904)
    shown = seconds.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    if shown >= 86_400 and any(k == "date" and t.strip("[]")[0] in "hs" for k, t in tokens):
        year, month, day, weekday, seconds, days, _ = serial_parts(Decimal(days + 1), date_1904)
        shown = Decimal(0)
    whole = int(shown)
    hour, minute, second = whole // 3600, whole // 60 % 60, whole % 60
    total = (abs(seconds_exact)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    out = []
    dates = [i for i, (k, _) in enumerate(tokens) if k == "date"]
    dotted = False
    for i, (k, t) in enumerate(tokens):
        if k == "half":
            short = len(t) == 3
            out.append(("P" if hour >= 12 else "A") if short else ("PM" if hour >= 12 else "AM"))
        elif k == "digit":
            if t == ".":
                out.append(f"{shown % 1:.{places}f}"[1:] if places else ".")
                dotted = True
            elif not dotted:
                out.append(t)
        elif k != "date":
            out.append(t)
        elif t.startswith("["):
            n = int(total) // {"h": 3600, "m": 60, "s": 1}[t[1]]
            out.append(str(n).zfill(len(t) - 2))
        else:
            c, n = t[0], len(t)
            place = dates.index(i)
            before = tokens[dates[place - 1]][1].strip("[]")[0] if place else ""
            after = tokens[dates[place + 1]][1].strip("[]")[0] if place + 1 < len(dates) else ""
            if c == "m" and n <= 2 and (before == "h" or after == "s"):
                out.append(str(minute).zfill(n))
            elif c == "y":
                out.append(f"{year % 100:02d}" if n <= 2 else str(year))
            elif c == "m":
                out.append(str(month).zfill(n) if n <= 2 else MONTHS[month - 1][:3] if n == 3 else MONTHS[month - 1][0] if n == 5 else MONTHS[month - 1])
            elif c == "d":
                out.append(str(day).zfill(n) if n <= 2 else DAYS[weekday][:3] if n == 3 else DAYS[weekday])
            elif c == "h":
                shown_hour = (hour + 11) % 12 + 1 if half else hour
                out.append(str(shown_hour).zfill(min(n, 2)))
            else:
                out.append(str(second).zfill(min(n, 2)))
    return "".join(out)


def format_value(raw: str, code: str, date_1904: bool = False) -> str:
    """The text shown for a cell's stored text; the stored text itself where it can't be formatted."""
    try:
        sections = compile_code(code)
        try:
            value = Decimal(raw)
            if not value.is_finite():
                return raw
        except InvalidOperation:
            section = sections[3] if len(sections) > 3 else next((s for s in sections if s.is_text), None)
            return "".join(raw if t == "@" else t for _, t in section.tokens) if section else raw
        section, shown = choose(sections, value)
        if section.is_date:
            return raw if value < 0 and not date_1904 and not section.elapsed else ("-" if value < 0 else "") + _date(section, abs(value) if value < 0 else value, date_1904)
        if section.is_text and not any(k in ("digit", "general") for k, _ in section.tokens):
            return "".join(general(value) if t == "@" else t for _, t in section.tokens)
        text = _number(section, shown)
        return "-" + text if shown < 0 and re.search(r"[1-9]", text) else text
    except (ArithmeticError, ValueError, IndexError, OverflowError):
        return raw


def section_color(raw: str, code: str) -> str | None:
    """The color of the section a number is shown by."""
    try:
        return choose(compile_code(code), Decimal(raw))[0].color
    except (ArithmeticError, ValueError):
        return None


def formatted(raw: Column, code: Column | str) -> Column:
    """``format_value`` over columns, by Arrow batches; nulls stay null."""
    return string_udf(format_value, raw, F.lit(code) if isinstance(code, str) else code)


def thousands(value: Column, places: int = 2) -> Column:
    """`#,##0.00` and its like, native: for decimals, rounded half up."""
    return F.format_number(F.round(value, places), places)


def serial_date(day: Column) -> Column:
    """The 1900-system serial number of a date or timestamp, native; dates from March 1900 on."""
    return F.datediff(day, F.lit("1899-12-30").cast("date"))
