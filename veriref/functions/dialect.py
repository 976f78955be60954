"""SQL expressions that two engines read: Spark, which runs them, and DuckDB, which checks them."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Spark:
    """Expressions for Spark SQL."""

    name = "spark"

    def pattern(self, p: str) -> str:
        return "r" + ('"' + p + '"' if "'" in p else "'" + p + "'")

    def replace(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.pattern(r)})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def extract_all(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def matches(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)}, -1)"

    def mapped(self, xs: str, v: str, body: str) -> str:
        return f"transform({xs}, {v} -> {body})"

    def kept(self, xs: str, v: str, body: str) -> str:
        return f"filter({xs}, {v} -> {body})"

    def exists(self, xs: str, v: str, body: str) -> str:
        return f"exists({xs}, {v} -> {body})"

    def item(self, xs: str, i: str | int) -> str:
        return f"try_element_at({xs}, cast({i} as int))"

    def last(self, xs: str) -> str:
        return f"try_element_at({xs}, -1)"

    def size(self, xs: str) -> str:
        return f"cast(size({xs}) as bigint)"

    def joined(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {quoted(sep)})"

    def distinct(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def ordered(self, xs: str) -> str:
        return f"array_sort({xs})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def number(self, x: str) -> str:
        return f"try_cast({x} as bigint)"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"


class Duck(Spark):
    """Expressions for DuckDB."""

    name = "duck"

    def pattern(self, p: str) -> str:
        return quoted(p)

    def replace(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {quoted(p)}, {quoted(r.replace('$', chr(92)))}, 'g')"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {quoted(p)}, {group})"

    def extract_all(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {quoted(p)}, {group})"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {quoted(p)})"

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {quoted(p)})"

    def mapped(self, xs: str, v: str, body: str) -> str:
        return f"list_transform({xs}, lambda {v}: {body})"

    def kept(self, xs: str, v: str, body: str) -> str:
        return f"list_filter({xs}, lambda {v}: {body})"

    def exists(self, xs: str, v: str, body: str) -> str:
        return f"(len(list_filter({xs}, lambda {v}: {body})) > 0)"

    def item(self, xs: str, i: str | int) -> str:
        return f"list_extract({xs}, {i})"

    def last(self, xs: str) -> str:
        return f"list_extract({xs}, -1)"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def joined(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, {quoted(sep)})"

    def distinct(self, xs: str) -> str:
        # Order doesn't matter where this is used: the results are sorted or counted.
        return f"list_distinct({xs})"

    def ordered(self, xs: str) -> str:
        return f"list_sort({xs})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def number(self, x: str) -> str:
        return f"try_cast({x} as bigint)"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"


SPARK, DUCK = Spark(), Duck()


def div(d: Spark, a: str, b: str | int) -> str:
    return f"({a} // {b})" if isinstance(d, Duck) else f"({a} div {b})"
