"""Text functions with a small state: inline Markdown, formulas, misread Japanese, classes of characters. Arrow-batched."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.BooleanType()) for c in "bold italic mono sup sub".split()), T.StructField("link", T.StringType())]))
MARK = re.compile(r"\\([!-/:-@\[-`{-~])|(`+)(.+?)\2(?!`)|!\[([^\]]*)\]\(([^)\s]*)[^)]*\)|\[((?:[^\[\]]|\[[^\]]*\])*)\]\(<?([^)\s>]*)>?[^)]*\)|<(sup|sub)>(.*?)</\8>|<(https?:[^>\s]+)>|(\*{1,3}|_{1,3})", re.S)
WIDE = re.compile("[　-ヿ㐀-䶿一-鿿＀-￯]")


def inline_spans(text: str) -> list[tuple]:
    """(text, bold, italic, mono, sup, sub, link) of inline Markdown, neighbours of one style merged; a line's end is a space, but none between Japanese characters."""
    out: list[list] = []

    def put(t: str, bold: bool, italic: bool, mono: bool = False, script: str = "", link: str | None = None) -> None:
        style = [bold, italic, mono, script == "sup", script == "sub", link]
        if t and out and out[-1][1:] == style:
            out[-1][0] += t
        elif t:
            out.append([t, *style])

    def walk(s: str, bold: bool, italic: bool, script: str, link: str | None) -> None:
        open_, at = [], 0
        for m in MARK.finditer(s):
            put(html.unescape(s[at : m.start()]), bold, italic, False, script, link)
            at = m.end()
            if m[1]:
                put(m[1], bold, italic, False, script, link)
            elif m[2]:
                put(m[3].strip() if m[3].strip() else m[3], bold, italic, True, script, link)
            elif m[5] is not None:
                put(m[4], bold, italic, False, script, link)
            elif m[7] is not None:
                walk(m[6], bold, italic, script, m[7])
            elif m[8]:
                walk(m[9], bold, italic, m[8], link)
            elif m[10]:
                put(m[10], bold, italic, False, script, m[10])
            else:
                c, n, before, after = m[11][0], len(m[11]), s[m.start() - 1 : m.start()], s[at : at + 1]
                inner = c == "_" and before.isalnum() and after.isalnum()
                while open_ and open_[-1][0] == c and n >= len(open_[-1]) and before and not before.isspace() and not inner:
                    n -= len(open_.pop())
                if n and after and not after.isspace() and not inner and c in s[at:]:
                    open_ += [c * 2] * (n >= 2) + [c] * (n % 2)
                elif n:
                    put(c * n, bold, italic, False, script, link)
                bold, italic = any(len(x) == 2 for x in open_), any(len(x) == 1 for x in open_)
        put(html.unescape(s[at:]), bold, italic, False, script, link)

    walk(re.sub(r"[ \t]*\n[ \t]*", _line_end, text.strip("\n")), False, False, "", None)
    return [tuple(x) for x in out]


def _line_end(m: re.Match) -> str:
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    return "" if WIDE.match(before) and WIDE.match(after) else " "


#: Names of LaTeX that stand for a character; fixed values of the public notation.
SYMBOLS = dict(zip("alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega Gamma Delta Theta Lambda Pi Sigma Phi Omega times cdot pm leq geq neq approx infty sum int prod partial nabla to in".split(), "αβγδϵθλμπρστϕωΓΔΘΛΠΣΦΩ×⋅±≤≥≠≈∞∑∫∏∂∇→∈", strict=True))
TOKEN = re.compile(r"\\([A-Za-z]+)|\\(.)|([0-9]+(?:\.[0-9]+)?)|([A-Za-z])|([{}^_])|(\s+)|(.)", re.S)


def mathml_text(latex: str) -> str | None:
    """MathML of a formula of names, numbers, fractions, roots and scripts; null for what else LaTeX has."""
    tokens = [m for m in TOKEN.finditer(latex) if not m[6]]
    at = 0

    def group() -> str:
        nonlocal at
        if at < len(tokens) and tokens[at][5] == "{":
            at += 1
            out = row("}")
            if at >= len(tokens):
                raise ValueError("a brace is open")
            at += 1
            return out
        return one()

    def one() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("something is missing")
        m = tokens[at]
        at += 1
        if m[1] == "frac":
            return f"<mfrac>{group()}{group()}</mfrac>"
        if m[1] == "sqrt":
            return f"<msqrt>{group()}</msqrt>"
        if m[1] in ("mathrm", "text", "operatorname"):
            return group()
        if m[1]:
            if m[1] not in SYMBOLS:
                raise ValueError(m[1])
            c = SYMBOLS[m[1]]
            return f"<mi>{c}</mi>" if c.isalpha() else f"<mo>{c}</mo>"
        if m[2]:
            return "<mspace/>" if m[2] in ",;:! " else f"<mo>{html.escape(m[2])}</mo>"
        if m[3]:
            return f"<mn>{m[3]}</mn>"
        if m[4]:
            return f"<mi>{m[4]}</mi>"
        if m[5]:
            if m[5] == "{":
                at -= 1
                return group()
            raise ValueError(m[5])
        return f"<mo>{html.escape(m[7])}</mo>"

    def row(end: str = "") -> str:
        nonlocal at
        parts: list[str] = []
        while at < len(tokens) and tokens[at][5] != (end or "}"):
            if tokens[at][5] in ("^", "_"):
                scripts = {}
                base = parts.pop() if parts else "<mrow></mrow>"
                while at < len(tokens) and tokens[at][5] in ("^", "_") and tokens[at][5] not in scripts:
                    key = tokens[at][5]
                    at += 1
                    scripts[key] = group()
                tag = "msubsup" if len(scripts) == 2 else "msup" if "^" in scripts else "msub"
                parts.append(f"<{tag}>{base}{''.join(scripts[k] for k in ('_', '^') if k in scripts)}</{tag}>")
            else:
                parts.append(one())
        return f"<mrow>{''.join(parts)}</mrow>"

    try:
        body = row()
        if at < len(tokens):
            return None
    except ValueError:
        return None
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML">{body}</math>'


#: Kanji that look like katakana or the long-vowel mark, and brackets that recognition confuses with letters. Fixed values.
LOOKALIKES, BRACKETS = "卜一口工力夕二八", "【［「〔"
KANJI, HIRAGANA, KATAKANA = "一-鿿㐀-䶿豈-﫿", "ぁ-ゖ", "ァ-ヺー"
MISREAD = [
    re.compile(f"(?<=[{KATAKANA}])[{LOOKALIKES}](?![{KANJI}])"),  # a kanji in a word of katakana
    re.compile(f"(?<=[{KANJI}])(?!ー)[{KATAKANA}](?=[{KANJI}])"),  # one katakana between kanji
    re.compile(f"[{BRACKETS}](?=[A-Za-z0-9]{{1,2}}(?![A-Za-z0-9]{{1}}[A-Za-z0-9])[{KANJI}])|(?<=[{KANJI}])(?!【)[{BRACKETS}](?=[A-Za-z])"),  # a bracket glued to letters and kanji
    re.compile(f"(?<=[{KANJI}{HIRAGANA}])[A-Za-z]{{1,3}}(?=[{KANJI}{HIRAGANA}])"),  # a few Latin letters between Japanese ones
]


def japanese_counts(text: str, common: frozenset[str] | None = None) -> tuple[int, int]:
    """(Japanese characters, suspicious ones): four patterns of misreading, and, with ``common`` (the kanji in use), kanji beyond it."""
    t = "".join(text.split())
    n = len(re.findall(f"[{KANJI}{HIRAGANA}{KATAKANA}]", t))
    bad = sum(len(p.findall(t)) for p in MISREAD)
    return n, bad + (sum(c not in common for c in re.findall(f"[{KANJI}]", t)) if common is not None else 0)


CLASSES = re.compile(r"(\s+)|([A-Za-z0-9]+)|([぀-ゟ]+)|([゠-ヿ]+)|([一-鿿]+)|((?:(?![A-Za-z0-9぀-ゟ゠-ヿ一-鿿])[^\W_])+)|((?:[^\w\s]|_)+)")


def word_at(text: str, at: int) -> str:
    """The run of characters of one class (white space, ASCII letters and digits, hiragana, katakana, kanji, other letters, other marks) around a place."""
    at = min(at, len(text) - 1)
    return next((m[0] for m in CLASSES.finditer(text) if m.start() <= at < m.end()), "") if text else ""


def byte_pieces(tokens: list[str]) -> str:
    """The text of byte-level tokens: printed bytes stand for themselves, the others for the letters from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    return bytes(back[c] for t in tokens for c in t if c in back).decode("utf-8", "replace")


def _over(f, kind):
    def each(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    each.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, kind)


mathml = _over(mathml_text, T.StringType())
decoded_pieces = _over(lambda x: byte_pieces(list(x)), T.StringType())


def spans_column(name: str):
    fields = ("text", "bold", "italic", "mono", "sup", "sub", "link")
    return _over(lambda t: [dict(zip(fields, s, strict=True)) for s in inline_spans(t)], SPAN)(name)


def _japanese(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([japanese_counts(t or "") for t in s], columns=["chars", "bad"])


japanese = F.pandas_udf(_japanese, T.StructType([T.StructField("chars", T.IntegerType()), T.StructField("bad", T.IntegerType())]))


def _words_at(t: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([word_at(a or "", int(b)) for a, b in zip(t, k, strict=True)], dtype=object)


selected_word = F.pandas_udf(_words_at, T.StringType())
