"""Equations from placed characters and rules to LaTeX.

A formula is a tree: a rule splits what lies around it into a fraction or covers the body of a root, a large operator has
limits, and what is left on a line is a row whose members may be scripts of the one before. The tree is built from the
widest rule down, each part being read as a formula of its own, and printed at the end. Trees can't be said with joins;
each formula is a small group and is read on its own with ``applyInPandas``. What has no known form stays as it is and is
reported, so that nothing is invented.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby
from statistics import median_low

from pyspark.sql import DataFrame

# LaTeX of characters.
LATEX = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta",
    "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu", "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho",
    "σ": r"\sigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\phi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma", "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega",
    "ϕ": r"\varphi", "ϵ": r"\varepsilon", "ϑ": r"\vartheta",
    "+": "+", "−": "-", "–": "-", "±": r"\pm", "∓": r"\mp", "×": r"\times", "÷": r"\div", "·": r"\cdot", "∙": r"\cdot", "⋅": r"\cdot",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "∼": r"\sim", "∝": r"\propto",
    "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊆": r"\subseteq", "∩": r"\cap", "∪": r"\cup", "∀": r"\forall", "∃": r"\exists",
    "→": r"\to", "←": r"\leftarrow", "⇒": r"\Rightarrow", "⇔": r"\Leftrightarrow",
    "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∮": r"\oint", "√": r"\surd", "∂": r"\partial", "∇": r"\nabla", "∞": r"\infty",
    "…": r"\ldots", "⋯": r"\cdots", "′": "'", "°": r"^{\circ}", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℚ": r"\mathbb{Q}", "ℝ": r"\mathbb{R}",
    "%": r"\%", "&": r"\&", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "$": r"\$",
}
# Characters that are scripts by themselves.
RAISED = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁺": "+", "⁻": "-", "⁼": "=", "⁽": "(", "⁾": ")", "ⁿ": "n", "ⁱ": "i"}
LOWERED = {"₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4", "₅": "5", "₆": "6", "₇": "7", "₈": "8", "₉": "9", "₊": "+", "₋": "-", "₌": "=", "₍": "(", "₎": ")", "ₐ": "a", "ₑ": "e", "ₒ": "o", "ₓ": "x", "ₙ": "n", "ᵢ": "i", "ⱼ": "j"}
WITH_LIMITS = frozenset("∑∏")
INTEGRALS = frozenset("∫∬∮")
TAG = re.compile(r"(?P<formula>.*=.*\S)\s+\((?P<number>\d{1,3}(?:\.\d+)?)\)")

SCHEMA = "latex string, unmapped array<string>, structures array<string>"

Rule = tuple[float, float, float]  # x0, x1, y


@dataclass
class Glyph:
    """A character in its place; ``base`` is the y of its base line."""

    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    base: float
    size: float


@dataclass
class Node:
    """A part of a formula: a character, or a construction with rows of further nodes."""

    kind: str  # glyph, fraction, root or limits
    x0: float
    y0: float
    x1: float
    y1: float
    base: float
    size: float
    text: str = ""
    rows: list[list[Node]] = field(default_factory=list)

    @property
    def centre(self) -> tuple[float, float]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    @classmethod
    def around(cls, kind: str, members: list[Node], rows: list[list[Node]], base: float, size: float, text: str = "") -> Node:
        return cls(kind, min(n.x0 for n in members), min(n.y0 for n in members), max(n.x1 for n in members), max(n.y1 for n in members), base, size, text, rows)


def usual_size(nodes: list) -> float:
    """The commonest size, to half a point; of equals the larger."""
    counts = Counter(round(2 * n.size) / 2 for n in nodes if n.text.strip() or getattr(n, "rows", None))
    return max(counts, key=lambda s: (counts[s], s), default=1.0)


def stacked(nodes: list[Node], edge: float, size: float, upwards: bool) -> list[Node]:
    """The nodes that stand over an edge, or hang under it, without a gap of more than a line."""
    out = []
    for n in sorted(nodes, key=lambda n: -n.y1 if upwards else n.y0):
        if (edge - n.y1 if upwards else n.y0 - edge) > size:
            break
        out.append(n)
        edge = min(edge, n.y0) if upwards else max(edge, n.y1)
    return out


def tree(nodes: list[Node], rules: list[Rule]) -> list[Node]:
    """A row of nodes, from left to right, in which rules and large operators have become constructions."""
    size = usual_size(nodes)
    waiting = sorted(rules, key=lambda r: r[0] - r[1])
    while waiting:
        (x0, x1, y), *waiting = waiting
        column = [n for n in nodes if x0 - size / 6 <= n.centre[0] <= x1 + size / 6]
        under = stacked([n for n in column if n.centre[1] > y], y, size, upwards=False)
        over = stacked([n for n in column if n.centre[1] < y], y, size, upwards=True)
        signs = [n for n in nodes if n.text == "√" and n.kind == "glyph" and abs(n.x1 - x0) < size / 2 and n.y0 - size < y < n.centre[1]]
        if signs and (body := [n for n in under if n is not signs[0]]):
            gone, parts = [signs[0], *body], [body]
        elif over and under:
            gone, parts = over + under, [over, under]
        else:
            continue

        def inside(rule: Rule, part: list[Node]) -> bool:
            return min(n.x0 for n in part) - size / 6 <= rule[0] and rule[1] <= max(n.x1 for n in part) + size / 6 and min(n.y0 for n in part) <= rule[2] <= max(n.y1 for n in part)

        rows = [tree(part, [r for r in waiting if inside(r, part)]) for part in parts]
        waiting = [r for r in waiting if not any(inside(r, part) for part in parts)]
        base = signs[0].base if len(parts) == 1 else y + size / 3
        nodes = [n for n in nodes if n not in gone] + [Node.around("root" if len(parts) == 1 else "fraction", gone, rows, base, size)]
    for sign in [n for n in nodes if n.kind == "glyph" and n.text in WITH_LIMITS]:
        third = (sign.y1 - sign.y0) / 3
        column = [n for n in nodes if n.size < sign.size and sign.x0 - sign.size / 6 <= n.centre[0] <= sign.x1 + sign.size / 6]
        under = stacked([n for n in column if n.centre[1] > sign.y1 - third], sign.y1, sign.size, upwards=False)
        over = stacked([n for n in column if n.centre[1] < sign.y0 + third], sign.y0, sign.size, upwards=True)
        if under or over:
            gone = [sign, *under, *over]
            nodes = [n for n in nodes if n not in gone] + [Node.around("limits", gone, [tree(under, []), tree(over, [])], sign.base, sign.size, sign.text)]
    return sorted(nodes, key=lambda n: n.x0)


class Printer:
    """Writes rows of nodes, and notes what it met."""

    def __init__(self) -> None:
        self.unmapped: set[str] = set()
        self.structures: set[str] = set()

    def character(self, char: str) -> str:
        if char in INTEGRALS:
            self.structures.add("integral")
        known = LATEX.get(char)
        if known is None:
            if not char.isascii():
                self.unmapped.add(char)
            return char
        return f"{known} " if known[1:].isalpha() and known[0] == "\\" else known

    def node(self, n: Node) -> str:
        if n.kind == "glyph":
            return self.character(RAISED.get(n.text) or LOWERED.get(n.text) or n.text) if len(n.text) == 1 else n.text
        self.structures.add({"root": "radical"}.get(n.kind, n.kind))
        parts = [self.row(r) for r in n.rows]
        if n.kind == "limits":
            return " " + self.character(n.text).strip() + "".join(f"{mark}{{{p}}}" for mark, p in zip("_^", parts, strict=True) if p) + " "
        return f" \\{ {'root': 'sqrt', 'fraction': 'frac'}[n.kind] }" + "".join(f"{{{p}}}" for p in parts) + " "

    def row(self, nodes: list[Node]) -> str:
        out = ""
        levels = self.levels(self.inline_roots(nodes))
        for level, run in groupby(levels, key=lambda x: x[0]):
            text = "".join(self.node(n) if n is not None else " " for _, n in run)
            if level:
                self.structures.add("scripts")
                out = f"{out.rstrip()}{'^' if level > 0 else '_'}{{{' '.join(text.split())}}}"
            else:
                out += text
        return " ".join(out.split())

    @staticmethod
    def levels(nodes: list[Node]) -> list[tuple[int, Node | None]]:
        """Each node with 1, 0 or -1: raised, on the line, lowered. None stands for a space."""
        visible = [n for n in nodes if n.text.strip() or n.rows]
        if not visible:
            return []
        size = max(usual_size(visible), visible[0].size)  # a row doesn't begin with a script
        line = median_low([n.base for n in visible if n.size >= 0.9 * size] or [n.base for n in visible])
        out: list[tuple[int, Node | None]] = []
        end = None  # where the text that a script may follow ends
        for n in nodes:
            if n not in visible:
                out.append((0, None))
                continue
            shift, level = (line - n.base) / size, 0
            if n.text in RAISED or n.text in LOWERED:
                level = 1 if n.text in RAISED else -1
            elif n.kind == "glyph" and end is not None and n.x0 - end <= size / 2:
                small = n.size <= 0.85 * size
                level = 1 if shift >= (0.2 if small else 0.4) else -1 if -shift >= (0.1 if small else 0.4) else 0
            out.append((level, n))
            end = n.x1
        return out

    @staticmethod
    def inline_roots(nodes: list[Node]) -> list[Node]:
        """A root sign without a rule takes the bracket or the run of letters and digits behind it."""
        out, at = [], 0
        while at < len(nodes):
            n, body, end = nodes[at], [], at + 1
            if n.kind == "glyph" and n.text == "√":
                if end < len(nodes) and nodes[end].text == "(":
                    close = next((k for k in range(end + 1, len(nodes)) if nodes[k].text in ("(", ")")), None)
                    if close is not None and nodes[close].text == ")":
                        body, end = nodes[end + 1 : close], close + 1
                else:
                    while end < len(nodes) and (nodes[end].text.isalnum() and nodes[end].text.isascii() or nodes[end].text == "."):
                        end += 1
                    body = nodes[at + 1 : end]
            out.append(Node.around("root", [n, *body], [body], n.base, n.size) if body else n)
            at = end if body else at + 1
        return out


def read(chars: list[Glyph], rules: list[Rule]) -> tuple[str | None, list[str], list[str]]:
    """LaTeX, characters without a known form, and the constructions met; null LaTeX without visible characters."""
    if not any(c.text.strip() for c in chars):
        return None, [], []
    printer = Printer()
    text = printer.row(tree([Node("glyph", c.x0, c.y0, c.x1, c.y1, c.base, c.size, c.text) for c in chars], rules))
    tagged = TAG.fullmatch(text)
    if tagged:
        text = f"{tagged['formula']} \\tag{{{tagged['number']}}}"
    return text or None, sorted(printer.unmapped), sorted(printer.structures)


def latex(chars: DataFrame, key: str) -> DataFrame:
    """(key, latex, unmapped, structures) of formulas; chars: key, text, x0, y0, x1, y1, base, size; a rule's text is null.

    A formula without visible characters has null LaTeX.
    """
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        named = rows.rename(columns={"size": "size_"})
        glyphs = [Glyph(r.text, r.x0, r.y0, r.x1, r.y1, r.base, r.size_) for r in named.itertuples() if isinstance(r.text, str)]
        rules = [(r.x0, r.x1, r.y0) for r in named.itertuples() if not isinstance(r.text, str)]
        return pd.DataFrame([(rows[key].iloc[0], *read(glyphs, rules))], columns=[key, "latex", "unmapped", "structures"])

    return chars.groupBy(key).applyInPandas(one, f"{key} {chars.schema[key].dataType.simpleString()}, {SCHEMA}")
