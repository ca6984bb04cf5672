"""Grid reshaping.

Wide grid rows are ``[time, y, x, var1, var2, ...]``; long rows are
``[time, y, x, variable, value]``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import CELL


def keep_known(df: DataFrame, vocabulary: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keep key columns and variables of a fixed vocabulary."""
    return df.select(*keys, *[c for c in df.columns if c in vocabulary and c not in keys])


def complete_cells(df: DataFrame, values: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """drop every cell with a missing value in any variable at any time.

    One grouped aggregate finds bad cells (partial aggregation handles a hot
    cell); a left-anti join against that list removes them.
    """
    any_null = F.max(F.greatest(*[F.col(v).isNull().cast("int") for v in values])
                     if len(values) > 1 else F.col(values[0]).isNull().cast("int"))
    bad = df.groupBy(*cell).agg(any_null.alias("__bad")).where(F.col("__bad") == 1).select(*cell)
    return df.join(bad, list(cell), "left_anti")


def stack(df: DataFrame, values: Sequence[str], name: str = "features") -> DataFrame:
    """variables -> one feature array per row, in the given order."""
    keep = [c for c in df.columns if c not in values]
    return df.select(*keep, F.array(*[F.col(v).cast("double") for v in values]).alias(name))


def to_long(df: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """F13/F14 long form: one row per (keys, variable)."""
    return df.unpivot(list(keys), list(values), "variable", "value")


def pivot_levels(df: DataFrame, variables: Sequence[str], levels: Sequence[int],
                 keys: Sequence[str] = ("time", *CELL), level: str = "level",
                 skip_absent: bool = False) -> DataFrame:
    """Long pressure-level rows -> wide ``var_level`` columns, one row
    per key.

    The level filter is pushed to the scan. The levels are those asked for: a
    level missing from the data gives an all-missing column. On request
    (``skip_absent``) it gets no column, at the price of a scan that lists the
    levels present.
    """
    d = df.where(F.col(level).isin(list(levels)))
    if skip_absent:
        present = {r[0] for r in d.select(level).distinct().collect()}   # at most the levels asked for
        levels = [lv for lv in levels if lv in present]
    aggs = [F.max(F.when(F.col(level) == lv, F.col(v))).alias(f"{v}_{lv}")
            for v in variables for lv in levels]
    return d.groupBy(*keys).agg(*aggs)


def tiles(df: DataFrame, tile_size: int, row: str = "y", col: str = "x",
          pad: bool = False, cval: float = 0.0, value: str | None = None,
          tile: int | None = None) -> DataFrame:
    """F16: give every pixel ``(tile_id, tile_row, tile_col)`` for square tiles
    numbered row-major from the top-left pixel.

    ``row``/``col`` are integer pixel positions. Without padding, an extent
    not divisible by ``tile_size`` raises; with padding the grid is centred
    in the next multiple and the pad pixels carry ``cval``.
    """
    ext = df.agg(F.min(row).alias("r0"), F.max(row).alias("r1"),
                 F.min(col).alias("c0"), F.max(col).alias("c1")).first()
    nr, nc = ext["r1"] - ext["r0"] + 1, ext["c1"] - ext["c0"] + 1
    r0, c0 = ext["r0"], ext["c0"]
    if not pad and (nr % tile_size or nc % tile_size):
        raise ValueError(f"grid of {nr} x {nc} pixels is not divisible by tile size {tile_size}")
    pr = (-nr) % tile_size if pad else 0
    pc = (-nc) % tile_size if pad else 0
    d = df
    if pad and (pr or pc):
        if value is None:
            raise ValueError("padding needs the value column to fill")
        # every padded pixel position, built per row by ``sequence`` (distributed)
        rows = df.sparkSession.range(r0 - pr // 2, r0 + nr + (pr - pr // 2)).select(F.col("id").alias(row))
        full = rows.select(row, F.explode(F.sequence(F.lit(c0 - pc // 2),
                                                     F.lit(c0 + nc + (pc - pc // 2) - 1))).alias(col))
        d = full.join(df, [row, col], "left").withColumn(value, F.coalesce(F.col(value), F.lit(cval)))
    top, left = r0 - pr // 2, c0 - pc // 2
    ncols = (nc + pc) // tile_size
    rr, cc = F.col(row) - F.lit(top), F.col(col) - F.lit(left)
    out = d.withColumns({
        "tile_id": (F.floor(rr / tile_size) * ncols + F.floor(cc / tile_size)).cast("long"),
        "tile_row": F.pmod(rr, F.lit(tile_size)).cast("int"),
        "tile_col": F.pmod(cc, F.lit(tile_size)).cast("int"),
    })
    return out if tile is None else out.where(F.col("tile_id") == tile)


def samples(df: DataFrame, values: Sequence[str], tile_size: int, target: str | None = None,
            time: str = "time", row: str = "y", col: str = "x") -> DataFrame:
    """training samples per (time, tile): a ``(vars, rows, cols)``
    float tensor as nested arrays, target zeros when absent.

    Every tile has ``tile_size**2`` pixels; a pixel without a row is missing.
    Grouping by tile bounds every group by that number, however large the
    grid is.
    """
    t = tiles(df, tile_size, row, col)
    place = F.col("tile_row") * tile_size + F.col("tile_col")
    y = F.col(target).cast("float") if target else F.lit(0.0).cast("float")
    pixel = F.struct(place.alias("at"), F.struct(*[F.col(v).cast("float").alias(v) for v in values], y.alias("__y")).alias("px"))
    g = t.groupBy(time, "tile_id").agg(F.map_from_entries(F.collect_list(pixel)).alias("px"))
    span = F.sequence(F.lit(0), F.lit(tile_size - 1))

    def plane(v):
        return F.transform(span, lambda r: F.transform(span, lambda c: F.try_element_at("px", r * tile_size + c)[v]))
    zero = F.transform(span, lambda r: F.transform(span, lambda c: F.lit(0.0).cast("float")))
    return g.select(time, "tile_id", F.array(*[plane(v) for v in values]).alias("x_sample"),
                    (plane("__y") if target else zero).alias("y_sample"))


def sample_set(df: DataFrame, values: Sequence[str], tile_size: int, target: str | None = None,
               scaling: str | Sequence[str] = "minmax", anomalies: bool = True, time: str = "time", row: str = "y",
               col: str = "x") -> DataFrame:
    """The sample data set: optionally whole-period anomalies (X6 with the
    population standard deviation), then ``minmax`` or ``standard`` scaling,
    each of a variable over time, y and x together; cut into tiles (F15). The
    target is not scaled. With several scalings a sample has the planes of all
    variables for each of them, in the order given."""
    from .scale import minmax, standardize
    d = standardize(df, values, ddof=0) if anomalies else df
    planes = []
    for kind in [scaling] if isinstance(scaling, str) else scaling:
        scaled = {f"__{kind}_{v}": F.col(v) for v in values}
        d = d.withColumns(scaled)
        d = minmax(d, list(scaled)) if kind == "minmax" else standardize(d, list(scaled))
        planes += scaled
    return samples(d, planes, tile_size, target, time, row, col)


def stack_maps(maps: Sequence[DataFrame], dim: str = "number") -> DataFrame:
    """stack result maps on a new index axis."""
    parts = [m.withColumn(dim, F.lit(i)) for i, m in enumerate(maps)]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
