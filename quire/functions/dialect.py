"""SQL expressions in two spellings, Spark's and DuckDB's.

Text functions of this library are written once against this small interface. Spark's spelling runs inside whole-stage
code generation (no Python in the data path); DuckDB's serves as the oracle. Patterns keep to what both regex engines
know: no look-around, no back references, no quotes (``\\x27``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out, for the engines' own classes differ.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same for Spark's trim.
SPACES = r"\t\n\u000B\u000C\r \u0085\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"
#: Chinese and Japanese letters, full-width forms and punctuation.
CJK = r"\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"


class Spark:
    """Spark SQL."""

    name = "spark"

    def lit(self, text: str) -> str:
        return "r'" + text.replace(WS, r"\p{IsWhite_Space}") + "'"  # the same characters, looked up in one table in place of a chain of ranges

    def strip(self, t: str, left: bool = True, right: bool = True) -> str:
        """Without the white space at its ends."""
        return f"trim({'BOTH' if left and right else 'LEADING' if left else 'TRAILING'} '{SPACES}' FROM {t})"

    def last_word(self, t: str, some: bool = True, spaced: bool = True) -> str:
        """The last run of other characters than white space; empty if there is none. The pattern goes to the end and back, for one that looks on from every character takes the square of a word's length."""
        return self.first(t, f"^(?s:.*[{WS}])?([^{WS}]+)[{WS}]*$", 1)

    def has(self, t: str, pattern: str) -> str:
        return f"rlike({t}, {self.lit(pattern)})"

    def replace(self, t: str, pattern: str, by: str = "") -> str:
        by = by.replace("\\1", "$1").replace("\\2", "$2")
        return f"regexp_replace({t}, {self.lit(pattern)}, {self.lit(by)})"

    def first(self, t: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({t}, {self.lit(pattern)}, {group})"

    def all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.lit(pattern)}, 0)"

    def count(self, t: str, pattern: str) -> str:
        return f"regexp_count({t}, {self.lit(pattern)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def where(self, a: str, f: Callable[[str], str]) -> str:
        return f"filter({a}, x -> {f('x')})"

    def each(self, a: str, f: Callable[[str], str]) -> str:
        return f"transform({a}, x -> {f('x')})"

    def item(self, a: str, i: int) -> str:
        return f"element_at({a}, {i})" if i < 0 else f"get({a}, {i - 1})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.lit(by)})"

    def starts(self, t: str, p: str) -> str:
        return f"startswith({t}, {self.lit(p)})"

    def characters(self, t: str) -> str:
        return self.all(t, "(?s).")

    def common(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def big(self, t: str) -> str:
        return f"try_cast({t} AS BIGINT)"

    def steps(self, n: str) -> str:
        """1 to n; empty for n < 1."""
        return f"(CASE WHEN {n} < 1 THEN cast(array() AS array<int>) ELSE sequence(1, cast({n} AS int)) END)"

    def bytes(self, t: str) -> str:
        return f"octet_length({t})"

    def let(self, value: str, f: Callable[[str], str], name: str = "it") -> str:
        """A value that is named, and so worked out once, however often it is used."""
        return f"get(transform(array({value}), {name} -> {f(name)}), 0)"


class Duck(Spark):
    """DuckDB."""

    name = "duck"

    def lit(self, text: str) -> str:
        return "'" + text + "'"

    def strip(self, t: str, left: bool = True, right: bool = True) -> str:
        return self.replace(t, "|".join([f"^[{WS}]+"] * left + [f"[{WS}]+$"] * right))

    def last_word(self, t: str, some: bool = True, spaced: bool = True) -> str:
        word = f"[^{WS}]{'+' if some else '*'}"
        return self.first(t, f"({word})[{WS}]*$", 1) if spaced else self.first(t, f"{word}$")

    def has(self, t: str, pattern: str) -> str:
        return f"regexp_matches({t}, {self.lit(pattern)})"

    def replace(self, t: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({t}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.lit(pattern)})"

    def count(self, t: str, pattern: str) -> str:
        return f"len({self.all(t, pattern)})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def where(self, a: str, f: Callable[[str], str]) -> str:
        return f"list_filter({a}, lambda x: {f('x')})"

    def each(self, a: str, f: Callable[[str], str]) -> str:
        return f"list_transform({a}, lambda x: {f('x')})"

    def item(self, a: str, i: int) -> str:
        return f"({a})[{i}]"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, {self.lit(by)})"

    def starts(self, t: str, p: str) -> str:
        return f"starts_with({t}, {self.lit(p)})"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def steps(self, n: str) -> str:
        return f"range(1, cast({n} AS BIGINT) + 1)"

    def bytes(self, t: str) -> str:
        return f"octet_length(encode({t}))"

    def let(self, value: str, f: Callable[[str], str], name: str = "it") -> str:
        return f"(list_transform([{value}], lambda {name}: {f(name)}))[1]"


SPARK, DUCK = Spark(), Duck()
Rule = Callable[[Spark, str], str]


def column(rule: Rule, name: str) -> Column:
    """A rule over a column, as a Spark column."""
    return F.expr(rule(SPARK, name))


def alternatives(texts: list[str]) -> str:
    """A pattern for any of the texts."""
    special = set(".()[]{}*+?|^$\\/&")
    return "(?:" + "|".join("".join("\\" + c if c in special and c not in "/&" else "\\x27" if c == "'" else c for c in t) for t in texts) + ")"
