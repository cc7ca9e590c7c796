"""Text functions that SQL has not: normal forms, accents, hashes, encodings. Arrow-batched, never row by row through Python objects of Spark."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spacing accents and their combining marks; fixed values.
COMBINING = {"´": "́", "`": "̀", "¨": "̈", "ˆ": "̂", "˜": "̃", "ˇ": "̌", "¸": "̧", "˚": "̊", "¯": "̄", "˘": "̆", "˙": "̇", "˛": "̨", "˝": "̋"}
ACCENT = re.compile("([" + "".join(c for c in COMBINING if c != "`") + r"])([^\W\d_])")
DROPPED = re.compile("[" + "".join(COMBINING) + "̀-ͯ]")


def fix_accents_text(t: str) -> str:
    """An accent before its letter goes onto it; backquotes stay."""
    if t.isascii() or not any(c in t for c in COMBINING):
        return t
    return unicodedata.normalize("NFC", ACCENT.sub(lambda m: m[2] + COMBINING[m[1]], t))


def fnv1a_text(t: str) -> str:
    """64-bit FNV-1a of the text in UTF-8, in hex."""
    h = 0xCBF29CE484222325
    for b in t.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a_texts(texts: list[str]) -> list[str]:
    """:func:`fnv1a_text` of many texts, a byte of all of them at a time; the few that are long one by one."""
    coded = [t.encode() for t in texts]
    order = sorted((k for k, b in enumerate(coded) if len(b) <= 4096), key=lambda k: -len(coded[k]))
    out = [fnv1a_text(t) if len(b) > 4096 else "" for t, b in zip(texts, coded, strict=True)]
    sizes = np.array([len(coded[k]) for k in order], dtype=np.int64)
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(coded[k] for k in order), dtype=np.uint8)
    h = np.full(len(order), 0xCBF29CE484222325, dtype=np.uint64)
    left = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts of more bytes than this
    for i, n in enumerate(left):
        h[:n] = (h[:n] ^ data[starts[:n] + i]) * np.uint64(0x100000001B3)
    for k, x in zip(order, h.tolist(), strict=True):
        out[k] = f"{x:016x}"
    return out


class _Bare(dict):
    """Characters without accents, each worked out once."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)) if c < 0x250 or 0x1E00 <= c <= 0x1EFF else chr(c)
        return self[c]


BARE = _Bare()


def strip_accents_text(t: str) -> str:
    """Accents off Latin letters alone."""
    return t if t.isascii() else t.translate(BARE)


WORD = re.compile(r"[^\W_]+")


def norm_text(t: str, cased: bool = False) -> str:
    """For matching: character references are read ("&amp_" is one, too), then NFKC, folded unless ``cased``, without accents; what is left are words of letters and digits, one space apart."""
    read = unicodedata.normalize("NFKC", html.unescape(t.replace("&amp_", "&")) if "&" in t else t)
    bare = strip_accents_text(read if cased else read.casefold())
    return " ".join(WORD.findall(bare.replace("ß", "ss")))


def decode_bytes(b: bytes) -> str:
    """By byte-order mark, else UTF-8, else Shift_JIS; line ends become newlines."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if b.startswith(mark):
            text = b[len(mark) :].decode(name, "replace")
            break
    else:
        try:
            text = b.decode()
        except UnicodeDecodeError:
            text = b.decode("cp932", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


#: Characters of which print has runs of any length; fixed values.
RUNS = set(".…‥・-—―─－=_*□■ー〃 　")
#: Shorter runs never count.
RUN = re.compile(r"(?s)(.)\1\1+")


def degeneracy_text(t: str) -> int:
    """How far a reading is stuck: characters beyond the longest run that print has, zeros after a comma beyond three, words three times running."""
    excess = 0
    for m in RUN.finditer(t):
        c, n = m[1], len(m[0])
        limit = None if c in RUNS else 7 if c == "0" else 3 if "一" <= c <= "鿿" else 4 if "぀" <= c <= "ヿ" else 5
        if limit and n >= limit:
            excess += n + 1 - limit
    if ",0000" in t:
        excess += sum(len(m[1]) - 3 for m in re.finditer(r"(?<=[0-9]),(?!,)(0{4,})(?![0-9])", t))
    words = t.split()
    return excess + sum([sum(map(str.isalpha, a)) >= 2 for a, b, c in zip(words, words[1:], words[2:], strict=False) if a == b == c])


def _piece(run: str) -> list[tuple[str, str]]:
    """(kind, piece) of a half-width run in vertical text: 'tcy' side by side in one cell, 'up' upright one by one, '' on its side."""
    def alnum(s: str) -> str:
        return "tcy" if len(s) <= 2 else "up" if len(s) <= 4 and not re.search("[a-z]", s) else ""

    out: list[tuple[str, str]] = []
    for m in re.finditer(r"[A-Za-z0-9]+(?:[.,:/\-'+_=&][A-Za-z0-9]+)*|[!?]+|.", run):
        s = m[0]
        if s[0].isalnum():
            unit = re.fullmatch(r"([0-9]+)([A-Za-z]+)", s)
            if unit and alnum(unit[1]) and alnum(unit[2]):
                out += [(alnum(unit[1]), unit[1]), (alnum(unit[2]), unit[2])]
                continue
            kind = alnum(s) if s.isalnum() else ""
        elif s[0] in "!?":
            kind = "tcy" if len(s) <= 2 else ""
        else:
            after = bool(out) and out[-1][0] == "" and out[-1][1][-1:].isalnum()
            kind = "tcy" if s in "%*#&@+/\\$^|" and not after else ""
        if out and not kind and not out[-1][0]:
            out[-1] = ("", out[-1][1] + s)
        else:
            out.append((kind, s))
    return out


#: Pieces are words, which come again.
_kinds = lru_cache(20000)(lambda s: tuple(_piece(s)))
PHRASE, SPECIAL = re.compile(r"[!-~]+(?: +[!-~]+)*|[^!-~]+"), re.compile('[&<>"]')
ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def vertical_html_text(t: str) -> str:
    """Text as HTML for vertical writing: half-width runs that should stand upright are wrapped; phrases with spaces are not."""
    esc = lambda s: s.translate(ESCAPES) if SPECIAL.search(s) else s
    out = []
    for s in PHRASE.findall(t):
        if not "!" <= s[0] <= "~" or " " in s:
            out.append(esc(s))
        else:
            out += [f'<span class="{k}">{esc(x)}</span>' if k else esc(x) for k, x in _kinds(s)]
    return "".join(out)


def tidy_latex_text(t: str) -> str:
    """LaTeX without needless spaces; eight spacing commands running are no formula."""
    if re.search(r"(?:\\(?:quad|qquad|,|;|:|!|\s)\s*){8,}", t):
        return ""
    t = re.sub(r"\s+", " ", t.strip())
    return re.sub(r"(?<!\\) ?([{}^_=+\-(),]) ?", r"\1", t)


def split_equation_number_text(t: str) -> tuple[str, str | None]:
    """(body, number) of a formula that ends in a number in brackets after space."""
    m = re.search(r"^(.*?)(?:\\q?quad|\s|~|\;)+\(([0-9A-Za-z.]{1,6})\)\s*$", t, re.S)
    return (m[1].strip(), m[2]) if m and re.search("[0-9]", m[2]) else (t, None)


def text_pattern(t: str, size: int = 40) -> list[float]:
    """Run-length code of a text's classes: C letters, D digits, S space, P others; each run is class * 8 + min(length, 7), padded with 0."""
    classes = {"C": 1, "D": 2, "S": 3, "P": 4}
    kinds = "".join("D" if c.isdigit() else "C" if c.isalpha() else "S" if c.isspace() else "P" for c in t)
    codes = [float(classes[m[0][0]] * 8 + min(7, len(m[0]))) for m in re.finditer(r"(.)\1*", kinds)][:size]
    return codes + [0.0] * (size - len(codes))


def _texts(f, kind: T.DataType = T.StringType()):
    def over(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    over.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, kind)


def _columns(f, kind: T.DataType = T.StringType()):
    """Of a function over many texts at once; nulls stay."""

    def over(s: pd.Series) -> pd.Series:
        some = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[some] = f(s[some].tolist())
        return out

    over.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, kind)


nfc = _texts(lambda t: unicodedata.normalize("NFC", t))
nfkc = _texts(lambda t: unicodedata.normalize("NFKC", t))
fix_accents = _texts(fix_accents_text)
fnv1a = _columns(fnv1a_texts)
strip_accents = _texts(strip_accents_text)
normalized = _texts(norm_text)
plain = _texts(lambda t: unicodedata.normalize("NFKC", DROPPED.sub("", t)))
decoded = _texts(lambda b: decode_bytes(bytes(b)))
degeneracy = _texts(degeneracy_text, T.IntegerType())
vertical_html = _texts(vertical_html_text)
tidy_latex = _texts(tidy_latex_text)
layout_pattern = _texts(text_pattern, T.ArrayType(T.DoubleType()))
