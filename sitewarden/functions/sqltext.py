"""SQL text that engine and checks share, with what differs between dialects in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


class Dialect:
    """Writes the few functions that Spark SQL and DuckDB name or quote differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        if self.spark:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + value.replace("'", "''") + "'"

    def match(self, x: str, pattern: str) -> str:
        return f"{'rlike' if self.spark else 'regexp_matches'}({x}, {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}{'' if self.spark else ", 'g'"})"

    def fn(self, args: str, body: str) -> str:
        """A lambda."""
        return f"{args if args.isidentifier() else f'({args})'} -> {body}" if self.spark else f"lambda {args}: {body}"

    def filter(self, x: str, args: str, body: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({x}, {self.fn(args, body)})"

    def transform(self, x: str, args: str, body: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({x}, {self.fn(args, body)})"

    def sort(self, x: str) -> str:
        return f"{'array_sort' if self.spark else 'list_sort'}({x})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.text(by)})" if self.spark else f"string_split({x}, {self.text(by)})"

    def join(self, x: str, by: str) -> str:
        return f"{'array_join' if self.spark else 'array_to_string'}({x}, {self.text(by)})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def double(self, x: float) -> str:
        return f"CAST({x} AS DOUBLE)"

    def found(self, x: str, words: tuple[str, ...]) -> str:
        """The words that x holds, in order."""
        return self.filter(self.array([self.text(w) for w in words]), "w", f"contains({x}, w)")


SPARK, DUCK = Dialect(True), Dialect(False)


def cases(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END" if pairs else default


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value in the plan and computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
