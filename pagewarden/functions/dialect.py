"""Expressions as SQL text for two engines. Operators use Spark's; the same expression in DuckDB's
dialect serves as an oracle. Patterns keep to what Java's and RE2's regular expressions share."""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    def lit(self, pattern: str) -> str:
        assert "'" not in pattern
        return f"r'{pattern}'"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rep(self, x, pattern, to=""):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.text(to)})"

    def ext(self, x, pattern, group=1):
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def all(self, x, pattern, group=1):
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def has(self, x, pattern):
        return f"({x} RLIKE {self.lit(pattern)})"

    def split(self, x, pattern):
        return f"split({x}, {self.lit(pattern)}, -1)"

    def keep(self, xs, v, e):
        return f"filter({xs}, {v} -> {e})"

    def map(self, xs, v, e):
        return f"transform({xs}, {v} -> {e})"

    def size(self, xs):
        return f"size({xs})"

    def first(self, xs):
        return f"get({xs}, 0)"

    def last(self, xs):
        return f"get({xs}, size({xs}) - 1)"

    def zip(self, a, b):
        return f"transform(arrays_zip({a}, {b}), z -> struct(z.`0` AS a, z.`1` AS b))"

    def left(self, v):
        return f"{v}.a"

    def right(self, v):
        return f"{v}.b"

    def join(self, xs, by):
        return f"array_join({xs}, {self.text(by)})"

    def sort(self, xs):
        return f"array_sort({xs})"

    def distinct(self, xs):
        return f"array_distinct({xs})"

    def octets(self, x):
        return f"octet_length({x})"

    def hash(self, x):
        return f"cast(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def bits(self, a, b):
        return f"({a} & {b})"

    def explode(self, table, cols, xs, name):
        """Rows of a table, once for each item of an array."""
        return f"SELECT {cols}, {name} FROM {table} LATERAL VIEW explode({xs}) _e AS {name}"


class Duck(Spark):
    """DuckDB."""

    def lit(self, pattern):
        assert "'" not in pattern
        return f"'{pattern}'"

    def text(self, value):
        return "'" + value.replace("'", "''") + "'"

    def rep(self, x, pattern, to=""):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.text(to)}, 'g')"

    def has(self, x, pattern):
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def split(self, x, pattern):
        return f"string_split_regex({x}, {self.lit(pattern)})"

    def keep(self, xs, v, e):
        return f"list_filter({xs}, lambda {v}: {e})"

    def map(self, xs, v, e):
        return f"list_transform({xs}, lambda {v}: {e})"

    def size(self, xs):
        return f"len({xs})"

    def first(self, xs):
        return f"({xs})[1]"

    def last(self, xs):
        return f"({xs})[-1]"

    def zip(self, a, b):
        return f"list_transform(list_zip({a}, {b}), lambda z: {{'a': z[1], 'b': z[2]}})"

    def join(self, xs, by):
        return f"array_to_string({xs}, {self.text(by)})"

    def sort(self, xs):
        return f"list_sort({xs})"

    def distinct(self, xs):
        return f"list_distinct({xs})"

    def octets(self, x):
        return f"octet_length(encode({x}))"

    def hash(self, x):
        return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def explode(self, table, cols, xs, name):
        return f"SELECT {cols}, unnest({xs}) AS {name} FROM {table}"


SPARK, DUCK = Spark(), Duck()
