"""Small helpers for array work inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside nested lambdas.

    Without the binding the optimizer may inline an expression into a lambda and so
    evaluate it once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(items: Column, test: Callable[[Column], Column]) -> Column:
    """0-based positions of the items that pass ``test``, ascending."""
    return F.transform(
        F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), test(x).alias("hit"))), lambda p: p["hit"]),
        lambda p: p["i"],
    )


def first_position(items: Column, test: Callable[..., Column]) -> Column:
    """1-based position of the first item that passes ``test``; 0 when there is none."""
    return F.coalesce(F.array_position(F.transform(items, test), True), F.lit(0)).cast("int")


def runs(items: Column, starts: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """Cut ``items`` at the 0-based ``starts`` and build one value per run.

    ``build`` receives the run's start, its length and its ordinal.
    """
    return let(F.size(items), lambda n: let(starts, lambda marks: F.transform(
        marks, lambda s, k: build(s, F.coalesce(F.get(marks, k + 1), n) - s, k))))


def inline_rows(df: DataFrame, array: str | Column, *keep: str, key: str) -> DataFrame:
    """One row per struct of ``array``; ``key`` is a field that is never NULL.

    The outer form keeps the optimizer from deriving a size filter on the array, which it
    would push below the projection and so evaluate the whole array expression twice.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(key).isNotNull())


def numbered_rows(df: DataFrame, array: str | Column, *keep: str, names: tuple[str, str]) -> DataFrame:
    """One row per array element with its 0-based position."""
    return df.select(*keep, F.posexplode_outer(array).alias(*names)).where(F.col(names[0]).isNotNull())
