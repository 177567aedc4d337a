"""The text rules are written once over these building blocks and rendered for Spark SQL and for DuckDB.

Patterns hold no single quote (write \\x27). Lengths count code points in both.
"""

from __future__ import annotations

import re


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class SparkSql:
    name = "spark"

    def lit(self, s: str) -> str:
        return "r'" + s + "'"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def has(self, c: str, p: str) -> str:
        return f"rlike({c}, {self.lit(p)})"

    def sub(self, c: str, p: str, r: str = "") -> str:
        return f"regexp_replace({c}, {self.lit(p)}, {self.lit(r)})"

    def part(self, c: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({c}, {self.lit(p)}, {g})"

    def octets(self, c: str) -> str:
        return f"octet_length({c})"

    def chars(self, c: str) -> str:
        return f"split({c}, '')"

    def fold(self, xs: str, start: str, body: str) -> str:
        return f"aggregate({xs}, {start}, (st, ch) -> {body})"

    def array(self, xs: str) -> str:
        return f"array({xs})"

    def first(self, xs: str, cond: str) -> str:
        return f"get(filter({xs}, k -> {cond}), 0)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"


class DuckSql(SparkSql):
    name = "duckdb"

    def lit(self, s: str) -> str:
        return quoted(s)

    text = lit

    def has(self, c: str, p: str) -> str:
        return f"regexp_matches({c}, {quoted(p)})"

    def sub(self, c: str, p: str, r: str = "") -> str:
        return f"regexp_replace({c}, {quoted(p)}, {quoted(re.sub(r'\$(\d)', r'\\\1', r))}, 'g')"

    def octets(self, c: str) -> str:
        return f"strlen({c})"

    def chars(self, c: str) -> str:
        return f"string_split({c}, '')"

    def fold(self, xs: str, start: str, body: str) -> str:
        return f"list_reduce({xs}, lambda st, ch: {body}, {start})"

    def array(self, xs: str) -> str:
        return f"[{xs}]"

    def first(self, xs: str, cond: str) -> str:
        return f"list_filter({xs}, lambda k: {cond})[1]"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"


SPARK, DUCK = SparkSql(), DuckSql()
