"""Numbers as list labels: numerals, letters, words, and label templates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals, Chinese digits and units, English number words.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
CHINESE_DIGITS = "〇一二三四五六七八九"
CHINESE_LEGAL_DIGITS = "零壹贰叁肆伍陆柒捌玖"
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
STEMS = "甲乙丙丁戊己庚辛壬癸"
BRANCHES = "子丑寅卯辰巳午未申酉戌亥"
IROHA = "イロハニホヘトチリヌルヲワカヨタレソツネナラムウヰノオクヤマケフコエテアサキユメミシヱヒモセスン"
AIUEO = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン"
GANADA = "가나다라마바사아자차카타파하"
CHOSUNG = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
CHICAGO = "*†‡§"
RUSSIAN = "абвгдежзиклмнопрстуфхцчшщыэюя"
DIGIT_ZERO = {"decimalFullWidth": 0xFF10, "hindiNumbers": 0x0966, "thaiNumbers": 0x0E50}


# Alphabets and digits of further word formats.
AIUEO_HALF = "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜｦﾝ"
IROHA_HALF = "ｲﾛﾊﾆﾎﾍﾄﾁﾘﾇﾙｦﾜｶﾖﾀﾚｿﾂﾈﾅﾗﾑｳヰﾉｵｸﾔﾏｹﾌｺｴﾃｱｻｷﾕﾒﾐｼヱﾋﾓｾｽﾝ"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשת"
HEBREW_HUNDREDS = "קרשתךםןףץ"
ABJAD = "أبجدهوزحطيكلمنسعفصقرشتثخذضظغ"
ARABIC_ALPHA = "أبتثجحخدذرزسشصضطظعغفقكلمنهوي"
KOREAN_NATIVE = ("하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉".split(), "열 스물 서른 마흔 쉰 예순 일흔 여든 아흔".split())
JAPANESE_LEGAL = "〇壱弐参四伍六七八九"
TRADITIONAL_LEGAL = "零壹貳叁肆伍陸柒捌玖"
NORDIC = "abcdefghijklmnopqrstuvwxyzæøå"
SPANISH_ONES = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
SPANISH_TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
SPANISH_HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
GERMAN_ONES = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
GERMAN_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
THAI_ONES = "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า".split()
THAI_PLACES = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]
VIETNAMESE_ONES = "không một hai ba bốn năm sáu bảy tám chín".split()


def roman(n: int) -> str:
    out = ""
    for value, letters in ROMAN:
        out += letters * (n // value)
        n %= value
    return out


def bijective(n: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """1 -> a, 26 -> z, 27 -> aa, 28 -> ab: as drawing lists count."""
    out = ""
    while n:
        n, r = divmod(n - 1, len(letters))
        out = letters[r] + out
    return out


def repeated(n: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """1 -> a, 27 -> aa, 28 -> bb, 53 -> aaa: as word lists count; plain digits beyond 30 rounds."""
    times, at = divmod(n - 1, len(letters))
    return letters[at] * (times + 1) if times < 30 else str(n)


def cycled(n: int, letters: str) -> str:
    return letters[(n - 1) % len(letters)]


def cardinal(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 2] + ("-" + ONES[n % 10] if n % 10 else "")
    for size, name in ((1_000_000, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            return f"{cardinal(n // size)} {name}" + (f" {cardinal(rest)}" if rest else "")
    raise AssertionError


def ordinal_word(n: int) -> str:
    head, sep, last = re.fullmatch(r"(.*?)([ -]?)([a-z]+)", cardinal(n)).groups()
    return head + sep + (ORDINAL.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def ordinal(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def chinese(n: int, digits: str = "零一二三四五六七八九", units: str = "十百千", short_ten: bool = True) -> str:
    """Chinese counting below 10**8; ``short_ten`` writes 10 to 19 without the leading one."""
    if n == 0:
        return digits[0]

    def four(m: int) -> str:
        out, gap = "", False
        for place in (3, 2, 1, 0):
            d = m // 10**place % 10
            if d:
                out += (digits[0] if gap and out else "") + digits[d] + (units[place - 1] if place else "")
                gap = False
            else:
                gap = True
        return out

    high, low = divmod(n, 10_000)
    out = four(high) + "万" if high else ""
    if low:
        out += (digits[0] if high and low < 1000 else "") + four(low)
    return out[1:] if short_ten and (10 <= n < 20 or 10 <= high < 20) else out


def myriads(n: int, digits: str, units: str, large: str, zero: str = "", drop_one: str = "", between: str = "always") -> str:
    """East Asian counting by groups of four places below ``large``.

    ``zero`` stands where places inside a group are left out. ``drop_one``: units
    in front of which a leading one isn't said. ``between``: whether a zero parts
    the groups where the lower one has fewer than four places: always, never, or
    ``odd`` (only if the number doesn't end in 0).
    """
    if not n:
        return digits[0]

    def group(m: int, drops: str) -> str:
        out, gap = "", False
        for place in (3, 2, 1, 0):
            digit, unit = m // 10**place % 10, units[place - 1] if place else ""
            if not digit:
                gap = bool(out)
                continue
            said = "" if digit == 1 and not out and unit and unit in drops else digits[digit]
            out += (zero if gap else "") + said + unit
            gap = False
        return out

    high, low = divmod(n, 10_000)
    if not high:
        return group(low, drop_one)
    out = group(high, drop_one if n < 100_000 or drop_one != units[0] else "") + large
    if low:
        out += zero if zero and low < 1000 and (between == "always" or between == "odd" and n % 10) else ""
        out += group(low, drop_one)
    return out


def korean(n: int) -> str:
    shown = myriads(n, "영일이삼사오육칠팔구", "십백천", "만", "", "십백천")
    return shown[1:] if 10_000 <= n < 20_000 and shown.startswith("일만") else shown


def korean_legal(n: int) -> str:
    ones, tens = KOREAN_NATIVE
    return ("" if n < 10 else tens[n // 10 - 1]) + ("" if n % 10 == 0 else ones[n % 10 - 1]) if n < 100 else korean(n)


def chinese_counting(n: int, zero: str = "○") -> str:
    """Up to 99 with tens, above digit by digit."""
    digits = zero + "一二三四五六七八九"
    return myriads(n, digits, "十百千", "万", "", "十") if n < 100 else "".join(digits[int(c)] for c in str(n))


def japanese_legal(n: int) -> str:
    high, low = divmod(n, 10**8)
    out = myriads(high, JAPANESE_LEGAL, "拾百阡", "萬") + "億" if high else ""
    return out + (myriads(low, JAPANESE_LEGAL, "拾百阡", "萬") if low or not high else "")


def sexagenary(n: int) -> str:
    return STEMS[(n - 1) % 10] + BRANCHES[(n - 1) % 12]


def hebrew_numeral(n: int) -> str:
    """Thousands first, then letters by value; 15 and 16 as nine and six, nine and seven."""
    out = hebrew_numeral(n // 1000) if n >= 1000 else ""
    n %= 1000
    if n >= 100:
        out += HEBREW_HUNDREDS[n // 100 - 1]
        n %= 100
    if n in (15, 16):
        return out + HEBREW[8] + HEBREW[n - 10]
    return out + ("" if n < 10 else HEBREW[n // 10 + 8]) + ("" if n % 10 == 0 else HEBREW[n % 10 - 1])


def hebrew_letters(n: int) -> str:
    times, at = divmod(n - 1, len(HEBREW))
    return "\u200f" + HEBREW[at] + HEBREW[-1] * times


def long_repeated(n: int, letters) -> str:
    """As ``repeated``, without a limit of rounds."""
    times, at = divmod(n - 1, len(letters))
    return letters[at] * (times + 1)


def spanish(n: int) -> str:
    if n < 30:
        return SPANISH_ONES[n]
    if n < 100:
        return SPANISH_TENS[n // 10 - 3] + (f" y {SPANISH_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return "cien" if n == 100 else SPANISH_HUNDREDS[n // 100 - 1] + (f" {spanish(n % 100)}" if n % 100 else "")
    head = spanish(n // 1000)
    head = re.sub(r"veintiuno$", "veintiún", head)
    head = re.sub(r"\buno$", "un", head)
    return ("mil" if n < 2000 else head + " mil") + (f" {spanish(n % 1000)}" if n % 1000 else "")


def german(n: int, last: bool = True) -> str:
    if n < 20:
        return "ein" if n == 1 and not last else GERMAN_ONES[n]
    if n < 100:
        return (german(n % 10, False) + "und" if n % 10 else "") + GERMAN_TENS[n // 10 - 2]
    size, word = (1000, "tausend") if n >= 1000 else (100, "hundert")
    return german(n // size, False) + word + (german(n % size) if n % size else "")


def german_ordinal(n: int) -> str:
    stem = german(n)
    for plain, made in (("eins", "erste"), ("drei", "dritte"), ("sieben", "siebte"), ("acht", "achte")):
        if stem.endswith(plain) and n % 100 in (1, 3, 7, 8):
            return stem[: -len(plain)] + made
    return stem + ("te" if 0 < n % 100 < 20 else "ste")


def thai(n: int) -> str:
    if n >= 1_000_000:
        return thai(n // 1_000_000) + "ล้าน" + (thai(n % 1_000_000) if n % 1_000_000 else "")
    if n < 10:
        return THAI_ONES[n]
    out = ""
    for place in range(5, -1, -1):
        digit = n // 10**place % 10
        if not digit:
            continue
        said = "ยี่" if place == 1 and digit == 2 else "" if place == 1 and digit == 1 else "เอ็ด" if place == 0 and digit == 1 else THAI_ONES[digit]
        out += said + THAI_PLACES[place]
    return out


def vietnamese(n: int) -> str:
    for size, word in ((10**9, "tỷ"), (10**6, "triệu"), (1000, "nghìn")):
        if n >= size:
            head, rest = divmod(n, size)
            return f"{vietnamese(head)} {word}" + (f" {_vietnamese_rest(rest)}" if rest else "")
    if n >= 100:
        rest = n % 100
        return f"{VIETNAMESE_ONES[n // 100]} trăm" + ("" if not rest else f" lẻ {VIETNAMESE_ONES[rest]}" if rest < 10 else " " + vietnamese(rest))
    if n < 10:
        return VIETNAMESE_ONES[n]
    head = "mười" if n < 20 else VIETNAMESE_ONES[n // 10] + " mươi"
    last = {0: "", 1: " mốt" if n > 20 else " một", 5: " lăm"}.get(n % 10, " " + VIETNAMESE_ONES[n % 10])
    return head + last


def _vietnamese_rest(n: int) -> str:
    return f"không trăm {vietnamese(n) if n >= 10 else 'lẻ ' + vietnamese(n)}" if n < 100 else vietnamese(n)


def circled(n: int) -> str:
    return chr(0x2460 + n - 1) if 1 <= n <= 20 else str(n)


def digits_from(zero: int) -> Callable[[int], str]:
    return lambda n: "".join(chr(zero + int(c)) for c in str(n))


def spans(*parts: tuple[int, int]) -> str:
    return "".join(chr(c) for a, z in parts for c in range(a, z + 1))


def enclosed(first: int, last: int) -> Callable[[int], str]:
    return lambda n: chr(first + n - 1) if n <= last else str(n)


def bounded(letters: str) -> Callable[[int], str]:
    return lambda n: letters[n - 1] if n <= len(letters) else str(n)


def spelled(digits: str) -> Callable[[int], str]:
    return lambda n: "".join(digits[int(c)] for c in str(n))


#: Formats by name; a name that isn't here counts in plain digits.
FORMATS: dict[str, Callable[[int], str]] = {
    **dict.fromkeys(("decimal", "decimalHalfWidth", "bahtText", "dollarText", "custom"), str),
    "decimalZero": lambda n: f"{n:02d}",
    "upperRoman": roman,
    "lowerRoman": lambda n: roman(n).lower(),
    "upperLetter": lambda n: repeated(n).upper(),
    "lowerLetter": repeated,
    "ordinal": ordinal,
    "cardinalText": lambda n: cardinal(n).capitalize(),
    "ordinalText": lambda n: ordinal_word(n).capitalize(),
    "hex": lambda n: f"{n:X}",
    "numberInDash": lambda n: f"- {n} -",
    "decimalEnclosedCircle": enclosed(0x2460, 20),
    "decimalEnclosedCircleChinese": enclosed(0x2460, 10),
    "decimalEnclosedParen": enclosed(0x2474, 20),
    "decimalEnclosedFullstop": enclosed(0x2488, 20),
    "ideographEnclosedCircle": lambda n: f"({chr(0x3220 + n - 1)})" if n <= 10 else str(n),
    "chicago": lambda n: CHICAGO[(n - 1) % 4] * ((n - 1) // 4 + 1) if n <= 116 else "",
    "russianLower": lambda n: long_repeated(n, RUSSIAN),
    "russianUpper": lambda n: long_repeated(n, RUSSIAN.upper()),
    "ideographTraditional": bounded(STEMS),
    "ideographZodiac": bounded(BRANCHES),
    "ideographZodiacTraditional": sexagenary,
    "aiueo": lambda n: cycled(n, AIUEO_HALF),
    "aiueoFullWidth": lambda n: cycled(n, AIUEO),
    "iroha": lambda n: cycled(n, IROHA_HALF),
    "irohaFullWidth": lambda n: cycled(n, IROHA[:-1]),
    "ganada": lambda n: cycled(n, GANADA),
    "chosung": lambda n: cycled(n, CHOSUNG),
    "chineseCounting": chinese_counting,
    "chineseCountingThousand": lambda n: myriads(n, "〇一二三四五六七八九", "十百千", "万", "〇", "十"),
    "chineseLegalSimplified": lambda n: myriads(n, CHINESE_LEGAL_DIGITS, "拾佰仟", "萬", "零"),
    "ideographLegalTraditional": lambda n: myriads(n, TRADITIONAL_LEGAL, "拾佰仟", "萬", "零"),
    "taiwaneseCounting": lambda n: chinese_counting(n),
    "taiwaneseCountingThousand": lambda n: myriads(n, "零一二三四五六七八九", "十百千", "萬", "零", "十百千"[:1], "odd"),
    "taiwaneseDigital": spelled("○一二三四五六七八九"),
    "ideographDigital": spelled(CHINESE_DIGITS),
    "japaneseDigitalTenThousand": spelled(CHINESE_DIGITS),
    "japaneseCounting": lambda n: myriads(n, CHINESE_DIGITS, "十百千", "万", "", "十百千"),
    "japaneseLegal": japanese_legal,
    "koreanCounting": korean,
    "koreanLegal": korean_legal,
    "koreanDigital": spelled("영일이삼사오육칠팔구"),
    "koreanDigital2": spelled("零一二三四五六七八九"),
    "hebrew1": hebrew_numeral,
    "hebrew2": hebrew_letters,
    "arabicAbjad": lambda n: "\u200c" + long_repeated(n, ABJAD),
    "arabicAlpha": lambda n: long_repeated(n, ARABIC_ALPHA) + "\u200c",
    "hindiConsonants": lambda n: long_repeated(n, [*spans((0x0905, 0x0914)), "अं", "अः"]),
    "hindiVowels": lambda n: long_repeated(n, spans((0x0915, 0x0939))),
    "thaiLetters": lambda n: long_repeated(n, "กขค" + spans((0x0E07, 0x0E23)) + "ล" + spans((0x0E27, 0x0E2E))),
    "thaiCounting": thai,
    "vietnameseCounting": lambda n: vietnamese(n).capitalize(),
    "bullet": lambda n: "•",
    "none": lambda n: "",
    "decimalFullWidth2": digits_from(0xFF10),
    **{name: digits_from(zero) for name, zero in DIGIT_ZERO.items()},
}
#: Largest numbers of formats that have one; above them nothing is shown.
LIMITED = "cardinalText chineseCountingThousand chineseLegalSimplified ideographLegalTraditional japaneseCounting koreanCounting ordinalText taiwaneseCountingThousand upperRoman lowerRoman thaiCounting vietnameseCounting".split()
LIMITS = {**dict.fromkeys(LIMITED, 999_999), "hex": 65_535, "japaneseDigitalTenThousand": 9_999, "koreanLegal": 9_999_999}
MOST = 217_483_647


def format_number(n: int, name: str, language: str | None = None, pattern: str | None = None) -> str:
    """A list number in a word format: plain digits where the format is unknown or the number below 1, nothing above what it can write.

    ``language``: whose letters, ordinals and words are used where the format
    leaves that open (Norwegian letters, French ordinals, Spanish and German
    words). ``pattern``: a custom format (``custom_number``), which wins.
    """
    if n > MOST or n > LIMITS.get(name, MOST):
        return ""
    if pattern and (made := custom_number(n, pattern, language)) is not None:
        return made
    if n < 1:
        return FORMATS[name](1) if name in ("bullet", "none") else str(n)
    base = (language or "").replace("_", "-").split("-")[0].lower()
    if base in ("nb", "nn", "no") and name in ("lowerLetter", "upperLetter"):
        shown = repeated(n, NORDIC)
        return shown.upper() if name == "upperLetter" else shown
    if base == "fr" and name == "ordinal":
        return f"{n}er" if n == 1 else f"{n}e"
    if base == "es" and name == "cardinalText":
        return spanish(n).capitalize()
    if base == "de" and name == "ordinalText":
        return german_ordinal(n).capitalize()
    return FORMATS.get(name, str)(n)


def custom_number(n: int, pattern: str, language: str | None = None) -> str | None:
    """A number in a custom pattern: its first run of `0`/`1` (padded digits), `A`, `a`, `I` or `i`, with what stands around it; null where there is none."""
    if pattern in ("ア", "ｱ"):
        return cycled(n, AIUEO if pattern == "ア" else AIUEO_HALF)
    for m in re.finditer(r"[A-Za-z0-9]+", pattern):
        token = m[0]
        kind = token[0] if len(set(token)) == 1 and token[0] in "AaIi" else "1" if set(token) <= set("01") and "1" in token else None
        if kind is None:
            if set(token) <= set("01AaIi"):
                return None
            continue
        shown = {"1": lambda: str(n).zfill(len(token)), "A": lambda: format_number(n, "upperLetter", language), "a": lambda: format_number(n, "lowerLetter", language), "I": lambda: roman(n), "i": lambda: roman(n).lower()}[kind]()  # noqa: B023
        return pattern[: m.start()] + shown + pattern[m.end() :]
    return None


# Endings of drawing auto-number schemes, and what is counted.
_SCHEME_KINDS = {"alphaLc": bijective, "alphaUc": lambda n: bijective(n).upper(), "romanLc": lambda n: roman(n).lower(), "romanUc": roman, "arabic": str}
_SCHEME_ENDS = {"ParenBoth": "({})", "ParenRight": "{})", "ParenR": "{})", "Period": "{}.", "Plain": "{}"}
_SCHEME_PLAIN = ("arabic1Minus", "arabic2Minus", "hebrew2Minus")


def auto_number(n: int, scheme: str) -> str:
    """Drawing list labels such as `alphaLcParenR`; `1.` for a scheme that isn't known."""
    m = re.fullmatch(r"(alphaLc|alphaUc|romanLc|romanUc|arabic)(ParenBoth|ParenRight|ParenR|Period|Plain)", scheme)
    if m:
        return _SCHEME_ENDS[m[2]].format(_SCHEME_KINDS[m[1]](n))
    if scheme == "circleNumDbPlain":
        return circled(n) if n <= 10 else str(n)
    if scheme in ("arabicDbPlain", "arabicDbPeriod"):
        return digits_from(0xFF10)(n) + ("．" if scheme == "arabicDbPeriod" else "")
    if scheme in _SCHEME_PLAIN:
        return str(n)
    return f"{n}."


def fill_template(template: str, numbers: list[int], formats: list[str], legal: bool = False) -> str:
    """`%1.%2` with each level's number in its format; `%%` is a percent sign; legal style counts in digits."""

    def put(m: re.Match) -> str:
        if m[1] == "%":
            return "%"
        k = int(m[1]) - 1
        return format_number(numbers[k], "decimal" if legal else formats[k]) if k < len(numbers) else ""

    return re.sub(r"%([1-9%])", put, template)


# ---------------------------------------------------------------- native columns


def roman_column(n: Column) -> Column:
    """Roman numerals of 1 to 3,999 by place tables, without Python; null outside."""
    out = []
    for place, (one, five, ten) in ((1000, ("M", "", "")), (100, ("C", "D", "M")), (10, ("X", "L", "C")), (1, ("I", "V", "X"))):
        words = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        digit = (F.floor(n / place) % 10).cast("int")
        out.append(F.element_at(F.array(*map(F.lit, words)), digit + 1))
    return F.when((n >= 1) & (n <= 3999), F.concat(*out))


def repeated_column(n: Column) -> Column:
    """The letters of ``repeated``, without Python."""
    at = F.pmod(n - 1, F.lit(26)).cast("int")
    times = (F.floor((n - 1) / 26) + 1).cast("int")
    return F.when(times <= 30, F.repeat(F.char(at + 97), times)).otherwise(n.cast("string"))


def ordinal_column(n: Column) -> Column:
    last = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), last)
