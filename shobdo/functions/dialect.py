"""Array and text expressions as SQL of two engines: Spark's, which the operators run, and DuckDB's, which checks them.

An expression is built once from the methods below; variables of lambdas are named by depth, indexes count from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_names = count()


def _var(prefix: str) -> str:
    return f"{prefix}{next(_names)}"


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def double(self, x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    def array(self, items: list[str]) -> str:
        return "array(" + ",".join(self.lit(x) for x in items) + ")"

    def each(self, a: str, f: Callable[[str, str], str]) -> str:
        x, i = _var("x"), _var("i")
        return f"transform({a}, ({x},{i}) -> {f(x, i)})"

    def keep(self, a: str, f: Callable[[str], str]) -> str:
        x = _var("x")
        return f"filter({a}, {x} -> {f(x)})"

    def fold(self, a: str, start: str, f: Callable[[str, str], str]) -> str:
        acc, x = _var("a"), _var("x")
        return f"aggregate({a}, {start}, ({acc},{x}) -> {f(acc, x)})"

    def get(self, a: str, i: str) -> str:
        return f"get({a}, CAST({i} AS INT))"

    def cut(self, a: str, start: str, n: str) -> str:
        """n items from index start."""
        return f"slice({a}, CAST(({start})+1 AS INT), CAST({n} AS INT))"

    def one(self, x: str) -> str:
        return f"array({x})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def sort(self, a: str) -> str:
        return f"sort_array({a})"

    def most(self, a: str) -> str:
        return f"array_max({a})"

    def index(self, a: str, x: str) -> str:
        """Index of x from 0, -1 if none."""
        return f"CAST(array_position({a}, {x}) - 1 AS INT)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def zip(self, a: str, b: str, f: Callable[[str, str], str]) -> str:
        x, y = _var("x"), _var("y")
        return f"zip_with({a}, {b}, ({x},{y}) -> {f(x, y)})"

    def join(self, a: str) -> str:
        return f"array_join({a}, '')"

    def find_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def like(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.lit(pattern)})"

    def sub(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)})"

    def group(self, s: str, pattern: str, k: int) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {k})"

    def occurrences(self, s: str, pattern: str) -> str:
        return f"regexp_count({s}, {self.lit(pattern)})"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def bits(self, s: str) -> str:
        """The first 52 bits of an md5 in hex, in [0, 1)."""
        return f"(CAST(conv(substring({s}, 1, 13), 16, 10) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"

    def nfc_bengali(self, s: str) -> str:
        """NFC after an edit of NFC text: only the two composed vowel signs can arise."""
        e = "ে"
        return f"replace(replace({s}, {self.lit(e + chr(0x9BE))}, {self.lit(chr(0x9CB))}), {self.lit(e + chr(0x9D7))}, {self.lit(chr(0x9CC))})"

    unit_sep = "char(31)"


class Duck(Spark):
    name = "duckdb"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def array(self, items: list[str]) -> str:
        return "[" + ",".join(self.lit(x) for x in items) + "]"

    def each(self, a, f):
        x, i = _var("x"), _var("i")
        return f"list_transform({a}, lambda {x}, {i}: {f(x, f'({i}-1)')})"

    def keep(self, a, f):
        x = _var("x")
        return f"list_filter({a}, lambda {x}: {f(x)})"

    def fold(self, a, start, f):
        acc, x = _var("a"), _var("x")
        return f"list_reduce({a}, lambda {acc}, {x}: {f(acc, x)}, {start})"

    def get(self, a, i):
        return f"({a})[CAST(({i})+1 AS BIGINT)]"

    def cut(self, a, start, n):
        return f"({a})[CAST(({start})+1 AS BIGINT):CAST(({start})+({n}) AS BIGINT)]"

    def one(self, x):
        return f"[{x}]"

    def size(self, a):
        return f"CAST(len({a}) AS INT)"

    def sort(self, a):
        return f"list_sort({a})"

    def most(self, a):
        return f"list_max({a})"

    def index(self, a, x):
        return f"CAST(coalesce(list_position({a}, {x}), 0) - 1 AS INT)"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def zip(self, a, b, f):
        i = _var("i")
        return f"list_transform(range(0, len({a})), lambda {i}: {f(f'({a})[{i}+1]', f'({b})[{i}+1]')})"

    def join(self, a):
        return f"array_to_string({a}, '')"

    def find_all(self, s, pattern):
        return f"regexp_extract_all({s}, {self.lit(pattern)})"

    def like(self, s, pattern):
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def sub(self, s, pattern, to):
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def occurrences(self, s, pattern):
        return f"CAST(len(regexp_extract_all({s}, {self.lit(pattern)})) AS INT)"

    def sha256(self, s):
        return f"sha256({s})"

    def bits(self, s):
        return f"(CAST(('0x'||substr({s}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"

    def nfc_bengali(self, s):
        return f"nfc_normalize({s})"

    unit_sep = "chr(31)"


SPARK, DUCK = Spark(), Duck()
Steps = list[tuple[str, str]]


def nested(source: str, steps: Steps, columns: str) -> str:
    """SQL that adds the steps' columns one after another to a source query, then selects."""
    sql = source
    for name, expr in steps:
        sql = f"SELECT *, {expr} AS {name} FROM ({sql})"
    return f"SELECT {columns} FROM ({sql})"


def bound(steps: Steps, outputs: list[str]) -> str:
    """One Spark expression, a struct of the outputs, in which each step is evaluated once a row.

    Chained projections would be merged and a step inlined into the lambdas that use it, once an element.
    """
    body = "named_struct(" + ", ".join(f"'{o}', {o}" for o in outputs) + ")"
    for name, expr in reversed(steps):
        body = f"get(transform(array({expr}), {name} -> {body}), 0)"
    return body


def staged(df: DataFrame, steps: Steps) -> DataFrame:
    """The rows with one column a step, each evaluated once a row.

    A generator of one row parts the projections, which would otherwise be merged; long chains as one expression (see
    bound) cost more with every level, because array functions derive their types from their lambdas again and again.
    """
    for name, expr in steps:
        df = df.select("*", F.inline(F.array(F.struct(F.expr(expr).alias(name)))))
    return df
