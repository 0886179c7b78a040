"""Equations of office documents (OMML) as LaTeX."""

from __future__ import annotations

import xml.etree.ElementTree as ET

# The namespace, and LaTeX names of characters.
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
SUMS = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}
ACCENTS = {"̂": r"\hat", "̃": r"\tilde", "̅": r"\bar", "̇": r"\dot", "̈": r"\ddot", "⃗": r"\vec", "̌": r"\check"}
SYMBOLS = {"α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "φ": r"\phi", "ω": r"\omega", "Δ": r"\Delta", "Σ": r"\Sigma", "Ω": r"\Omega", "∞": r"\infty", "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "±": r"\pm", "×": r"\times", "·": r"\cdot", "→": r"\to", "∂": r"\partial", "∈": r"\in"}
FUNCTIONS = frozenset("sin cos tan cot sec csc log ln exp lim max min sup inf det gcd".split())
DELIMITERS = {"{": r"\{", "}": r"\}", "⟨": r"\langle", "⟩": r"\rangle", "‖": r"\|", "": "."}


def _child(node: ET.Element, name: str) -> ET.Element | None:
    return node.find(MATH + name)


def _value(node: ET.Element, *path: str, default: str = "") -> str:
    """The value of a property below the node; the default where it isn't there."""
    for name in path:
        node = None if node is None else _child(node, name)
    return default if node is None else node.get(MATH + "val", default)


def _text(text: str) -> str:
    out = ""
    for c in text:
        word = SYMBOLS.get(c)
        out += word + " " if word else "\\" + c if c in "#$%&_{}" else c
    return out


class Writer:
    """Writes nodes; an element without a rule of its own gives what is inside it."""

    def of(self, node: ET.Element | None) -> str:
        if node is None:
            return ""
        rule = getattr(self, "_" + node.tag.removeprefix(MATH), None) if node.tag.startswith(MATH) else None
        return rule(node) if rule else self.inside(node)

    def inside(self, node: ET.Element) -> str:
        return "".join(self.of(c) for c in node if not c.tag.endswith("Pr"))

    def part(self, node: ET.Element, name: str) -> str:
        found = _child(node, name)
        return "" if found is None else self.inside(found).strip()

    def _t(self, node):
        return _text(node.text or "")

    def _f(self, node):
        top, below = self.part(node, "num"), self.part(node, "den")
        kind = _value(node, "fPr", "type", default="bar")
        return f"{{{top}}}/{{{below}}}" if kind == "lin" else rf"\binom{{{top}}}{{{below}}}" if kind == "noBar" else rf"\frac{{{top}}}{{{below}}}"

    def _rad(self, node):
        degree = self.part(node, "deg")
        return rf"\sqrt[{degree}]{{{self.part(node, 'e')}}}" if degree else rf"\sqrt{{{self.part(node, 'e')}}}"

    def _sSup(self, node):
        return f"{{{self.part(node, 'e')}}}^{{{self.part(node, 'sup')}}}"

    def _sSub(self, node):
        return f"{{{self.part(node, 'e')}}}_{{{self.part(node, 'sub')}}}"

    def _sSubSup(self, node):
        return f"{{{self.part(node, 'e')}}}_{{{self.part(node, 'sub')}}}^{{{self.part(node, 'sup')}}}"

    def _sPre(self, node):
        return f"{{}}_{{{self.part(node, 'sub')}}}^{{{self.part(node, 'sup')}}}{{{self.part(node, 'e')}}}"

    def _nary(self, node):
        sign = _value(node, "naryPr", "chr", default="∫")
        low, high = self.part(node, "sub"), self.part(node, "sup")
        return SUMS.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f" {self.part(node, 'e')}"

    def _d(self, node):
        left, right = _value(node, "dPr", "begChr", default="("), _value(node, "dPr", "endChr", default=")")
        between = _value(node, "dPr", "sepChr", default="|")
        parts = [self.inside(e).strip() for e in node.findall(MATH + "e")]
        return rf"\left{DELIMITERS.get(left, left)}{between.join(parts)}\right{DELIMITERS.get(right, right)}"

    def _acc(self, node):
        return f"{ACCENTS.get(_value(node, 'accPr', 'chr', default=chr(0x302)), chr(92) + 'hat')}{{{self.part(node, 'e')}}}"

    def _bar(self, node):
        return rf"\{'overline' if _value(node, 'barPr', 'pos', default='bot') == 'top' else 'underline'}{{{self.part(node, 'e')}}}"

    def _func(self, node):
        name = self.part(node, "fName")
        return ("\\" + name if name in FUNCTIONS else name) + f" {self.part(node, 'e')}"

    def _limLow(self, node):
        base = self.part(node, "e")
        return ("\\" + base if base in FUNCTIONS else base) + f"_{{{self.part(node, 'lim')}}}"

    def _limUpp(self, node):
        return f"{self.part(node, 'e')}^{{{self.part(node, 'lim')}}}"

    def _m(self, node):
        rows = [" & ".join(self.inside(e).strip() for e in r.findall(MATH + "e")) for r in node.findall(MATH + "mr")]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"

    def _eqArr(self, node):
        return r"\begin{aligned}" + r" \\ ".join(self.inside(e).strip() for e in node.findall(MATH + "e")) + r"\end{aligned}"

    def _borderBox(self, node):
        return rf"\boxed{{{self.part(node, 'e')}}}"


def to_latex(xml: str) -> str:
    """The LaTeX of an equation's XML; empty for XML that isn't well formed."""
    try:
        return Writer().of(ET.fromstring(xml)).strip()
    except ET.ParseError:
        return ""
