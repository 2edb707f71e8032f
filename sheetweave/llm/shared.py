"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.scratch import kept as shelve  # noqa: F401  written once to the folder that driver and executors share
from sheetweave.scratch import kept_at as shelve_at  # noqa: F401
from sheetweave.scratch import remove, scope  # noqa: F401

#: ASCII white space (space, tab to carriage return) in the syntax of java.util.regex.
SPACE = r"[\x20\x09-\x0D]+"


def give_back() -> None:
    """Memory that was freed goes back to the system, where the C library offers that: drivers and Python workers live on
    after what they did for one step, and share their machine with the steps that follow."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives back what it freed when the task ends."""

    def to_the_end(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return to_the_end


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Tables written inside pass `rows` rows at a time to Python: for rows that hold whole texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pieces(batches: Iterator, rows: int = 1_000) -> Iterator:
    """The batches or arrays of a task in slices, where what is made of a row is large; what was freed is given back at the end."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)
    give_back()


def steady(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df in an order that a rerun of lost tasks repeats, for work that numbers rows by their place: what
    comes out of a shuffle may come in another order and is written first; what is read from files comes as it lies there."""
    some = df.select(*[column(df, n) for n in dict.fromkeys(names)])
    return shelve(some) if "Exchange" in some._jdf.queryExecution().executedPlan().toString() else some


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name starting with `wanted` that df does not have, so that an input's own columns never clash."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    """A reference by exact name, also where the name holds dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def text_bytes(col: Column) -> Column:
    """UTF-8 bytes of a text, null as empty. Bytes cross to Python without being decoded."""
    return F.coalesce(col, F.lit("")).cast("binary")


def let(value: Column, body) -> Column:
    """Bind a column expression once inside an expression; without it the optimizer may inline it into every lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(col: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null gives none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE, -1), "")


def n_words(col: Column) -> Column:
    return F.size(words(col)).cast("long")
