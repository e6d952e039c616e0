"""Running values over an ordered long table without one task per key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which fails when
one document holds a large share of all rows. Here a key's ordered rows are cut into tiles
of bounded size: a window runs inside each tile, one summary row per tile is scanned per
key (thousands of times fewer rows), and the carried value is joined back on (key, tile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import by_key

TILE_ROWS = 4096


def tile_of(index: str | Column, rows: int = TILE_ROWS) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return F.floor(c / rows).cast("long")


def running(df: DataFrame, keys: list[str], order: list[str], tile: Column, *, sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Add running sums and last-non-NULL values.

    ``tile`` must be monotone in ``order`` within a key and bound the rows per tile.
    With ``inclusive=False`` the current row does not count.
    """
    sums, lasts = sums or {}, lasts or {}
    tiled = df.withColumn("_tile", tile)
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(*frame)
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local = tiled.withColumns(
        {f"_in_{n}": F.sum(c).over(inside) for n, c in sums.items()}
        | {f"_in_{n}": F.last(c, ignorenulls=True).over(inside) for n, c in lasts.items()})
    per_tile = tiled.groupBy(*keys, "_tile").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), position)).alias(n) for n, c in lasts.items()])
    carried = per_tile.select(
        *keys, "_tile",
        *[F.sum(n).over(before).alias(f"_up_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_up_{n}") for n in lasts])
    joined = local.join(by_key(carried), [*keys, "_tile"], "left")
    zero = F.lit(0)
    values = {n: F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_up_{n}", zero) for n in sums}
    values |= {n: F.coalesce(f"_in_{n}", f"_up_{n}") for n in lasts}
    return joined.withColumns(values).drop("_tile", *[f"_{p}_{n}" for p in ("in", "up") for n in values])
