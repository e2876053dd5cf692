"""Which columns of a query can be held in a lower floating-point format while its result keeps so many digits."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.errors import ArithmeticException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import FORMATS, by_precision, quantize_columns, within_digits
from .lineage import cut
from .search import FAIL, PASS, UNRESOLVED, Search


def split_parts(items: Sequence, n: int) -> list[list]:
    """n contiguous parts: the last len % n of them hold one item more than the others."""
    least, longer = divmod(len(items), n)
    first = n - longer
    short = [list(items[least * i : least * (i + 1)]) for i in range(first)]
    rest, each = items[least * first :], least + 1
    return short + [list(rest[each * i : each * (i + 1)]) for i in range(longer)]


def largest_passing(items: Sequence, passes: Callable[[frozenset], bool]) -> list:
    """A 1-maximal subset that passes: no single further item can be added. The empty set must pass."""
    chosen, rest, n = frozenset(), list(items), 2
    if rest and passes(frozenset(rest)):
        return list(items)
    while rest:
        n = min(n, len(rest))
        for part in split_parts(rest, n):
            if passes(chosen | frozenset(part)):
                chosen |= frozenset(part)
                rest = [x for x in rest if x not in chosen]
                n = max(2, n - 1)
                break
        else:
            if n >= len(rest):
                break
            n = min(len(rest), 2 * n)
    return [x for x in items if x in chosen]


@dataclass
class Tuning:
    formats: dict[str, str]
    runs: int = 0
    rejected: int = 0
    seconds: float = 0.0
    tried: dict = field(default_factory=dict)

    def by_format(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for c, f in self.formats.items():
            out.setdefault(f, set()).add(c)
        return out


def reference_result(source: DataFrame, query: Callable[[DataFrame], DataFrame], keys: Sequence[str], check: Sequence[str]) -> DataFrame:
    """The result in double, computed once."""
    return cut(query(source).select(*keys, *[F.col(c).alias(f"__ref_{c}") for c in check]))


def digits_kept(source: DataFrame, query: Callable[[DataFrame], DataFrame], assigned: dict[str, str], exact: DataFrame, keys: Sequence[str], check: Sequence[str], formats: dict = FORMATS, custom: Callable[[str, str], Column] | None = None) -> list[bool]:
    """Whether the result keeps 1, 2, ... 16 digits with columns held in the assigned formats: one job that returns one row."""
    held = source.withColumns({c: custom(c, f) for c, f in assigned.items()}) if custom else quantize_columns(source, assigned, formats)
    both = query(held).join(exact, list(keys), "full_outer")
    good = [reduce(and_, [within_digits(f"__ref_{c}", c, d) for c in check]) for d in range(1, 17)]
    return list(both.agg(*[F.coalesce(F.bool_and(g), F.lit(True)) for g in good]).first())


def tune(source: DataFrame, query: Callable[[DataFrame], DataFrame], columns: Sequence[str], keys: Sequence[str], check: Sequence[str], digits: int, letters: str = "bsd", formats: dict = FORMATS, custom: Callable[[str, str], Column] | None = None, reference: DataFrame | None = None, results: dict | None = None, monotone: bool = False, **hooks) -> Tuning:
    """Formats by column. query maps a table to a result with key columns and columns to check.

    All columns start in the highest format. A pass over two neighbouring formats, the highest first, lowers all of its columns if that
    keeps the digits, else a maximal subset. Each candidate is one Spark job that returns one row: whether it keeps 1, 2, ... 16 digits.
    Outcomes are remembered; calls for other digits may share results, and the reference result. monotone spares the jobs of candidates that lie within
    a tested set that passed or around one that failed; hooks are those of search.Search.
    """
    order = by_precision(letters, formats)
    found = Tuning({c: order[-1] for c in columns})
    exact = reference if reference is not None else reference_result(source, query, keys, check)
    began = time.perf_counter()
    results = {} if results is None else results

    def passes(assigned: dict[str, str]) -> bool:
        mark = frozenset(assigned.items())
        if mark not in found.tried:
            if mark not in results:
                results[mark] = digits_kept(source, query, assigned, exact, keys, check, formats, custom)
            found.tried[mark] = results[mark][digits - 1]
            found.runs += 1
            found.rejected += not found.tried[mark]
        return found.tried[mark]

    for high, low in zip(order[::-1], order[-2::-1]):
        movable = [c for c in columns if found.formats[c] == high]
        keeps = lambda s: not s or passes(found.formats | dict.fromkeys(s, low))  # noqa: B023, E731
        if monotone or hooks:
            lowered = list(Search(lambda s: PASS if keeps(s) else FAIL, monotone=monotone, **hooks).largest_passing(movable))  # noqa: B023
        else:
            lowered = largest_passing(movable, keeps)
        if not lowered:
            break
        found.formats |= dict.fromkeys(lowered, low)
    found.seconds = time.perf_counter() - began
    return found


def breaking_columns(source: DataFrame, query: Callable[[DataFrame], DataFrame], columns: Sequence[str], keys: Sequence[str], check: Sequence[str], digits: int, low: str, formats: dict = FORMATS, **hooks) -> tuple[DataFrame, Search]:
    """(column, beside) and the search: a smallest difference between columns that can be held in the format `low` and such that can't. column is what breaks the
    result when it is lowered beside the others. A candidate whose job fails (an overflow) is unresolved. Outcomes are taken to be monotone."""
    exact = reference_result(source, query, keys, check)

    def test(lowered: frozenset) -> str:
        try:
            kept = digits_kept(source, query, dict.fromkeys(sorted(lowered), low), exact, keys, check, formats)
        except ArithmeticException:
            return UNRESOLVED
        return PASS if kept[digits - 1] else FAIL

    search = Search(test, monotone=True, **hooks)
    passing, failing = search.difference(list(columns))
    rows = [(c, sorted(passing)) for c in sorted(failing - passing)]
    return source.sparkSession.createDataFrame(rows, "column string, beside array<string>"), search


def sweep(source: DataFrame, query, columns, keys, check, digits: Sequence[int], letters: str = "bsd") -> DataFrame:
    """(digits, column, format, runs) for each number of digits."""
    rows, results, reference = [], {}, reference_result(source, query, keys, check)
    for d in digits:
        t = tune(source, query, columns, keys, check, d, letters, reference=reference, results=results)
        rows += [(d, c, f, t.runs) for c, f in t.formats.items()]
    return source.sparkSession.createDataFrame(rows, "digits int, column string, format string, runs int")


def format_counts(settings: DataFrame) -> DataFrame:
    """(keys, format, n) from settings (keys..., settings map<format, array<column>>): how many columns are held in each format."""
    keys = [c for c in settings.columns if c != "settings"]
    return settings.select(*keys, F.explode("settings").alias("format", "columns")).groupBy(*keys, "format").agg(F.sum(F.size("columns")).alias("n"))


def runtime_summary(runtimes: DataFrame) -> DataFrame:
    """Digits and seconds, and their average as the row of a null: a rollup."""
    return runtimes.rollup("digits").agg(F.avg("seconds").alias("seconds"))


def counts_by_format(counts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """A column for each format from (keys, format, n), 0 where a setting has none: the layout of a summary. letters: the formats, in order."""
    keys = [c for c in counts.columns if c not in ("format", "n")]
    return counts.groupBy(*keys).pivot("format", list(letters)).agg(F.sum("n")).na.fill(0, list(letters))


def folder_summary(spark, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """Folder, the name of the folder that holds a row's file, and the rows of all CSV files with a header under the paths (globs)."""
    rows = spark.read.csv(paths, header=True, schema=schema)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(F.url_decode(folder).alias("Folder"), "*")
