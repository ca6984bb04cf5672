"""Per-cell linear models in Spark's own algebra (M1, M3-M6).

Each cell has its own ridge regression of the target on the features. The model
needs no rows in one place: one aggregate gives the moments of each cell (means
and centred sums of products, merged from partial ones), and the coefficients
follow from them by a Cholesky factorisation written with higher-order
functions. A search over many parameter sets solves each cell once for each
set, and takes the validation error from the moments of the validation rows: the data
are read once, whatever the number of trials.

Defined results: a cell with a missing feature or target in any training row
has no model, and its predictions are missing (M4); a singular system has no
model; a row with a missing feature has a missing prediction; ``penalty``
is added to the diagonal of the centred sums of products, the intercept is not
penalised.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import CELL
from .split import best_trial

ROW = "array<double>"


# ----------------------------------------------------------------- moments


def moments(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """``(*by, rows, n, m, s)`` by group: number of rows and of whole rows, means of the
    features and the target, and their centred sums of products (all over whole rows)."""
    cols = [*features, target]
    value = {c: F.col(c).cast("double") for c in cols}
    whole = reduce(lambda a, b: a & b, [value[c].isNotNull() & ~F.isnan(value[c]) for c in cols])
    d = df.select(*by, whole.alias("__whole"), *[F.when(whole, value[c]).alias(f"__{k}") for k, c in enumerate(cols)])
    n = F.count(F.when(F.col("__whole"), 1))
    pair = lambda i, j: n * F.covar_pop(f"__{min(i, j)}", f"__{max(i, j)}")
    k = range(len(cols))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), n.alias("n"), F.array(*[F.avg(f"__{i}") for i in k]).alias("m"),
        F.array(*[F.array(*[pair(i, j) for j in k]) for i in k]).alias("s"))


# ----------------------------------------------------------------- algebra on arrays


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(a: Column, i: Column | int, j: Column | int | None = None) -> Column:
    one = F.get(a, i if isinstance(i, Column) else F.lit(i))
    return one if j is None else at(one, j)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, over the shorter of both."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def first(n: Column) -> Column:
    """0 … n-1; none for n = 0."""
    return F.slice(F.sequence(F.lit(0), n), F.lit(1), n)


def cholesky(a: Column, k: Column) -> Column:
    """Rows of the lower factor of the leading ``k`` by ``k`` part of ``a``; entries are missing from a pivot on that is not positive."""
    def row(done: Column, i: Column) -> Column:
        left = F.aggregate(first(i), F.array().cast(ROW), lambda r, j: F.concat(r, F.array(F.try_divide(at(a, i, j) - dot(r, at(done, j)), at(done, j, j)))))
        pivot = lambda r: at(a, i, i) - dot(r, r)
        whole = lambda r: F.concat(r, F.array(F.when(pivot(r) > 1e-12 * at(a, i, i), F.sqrt(pivot(r)))))
        return F.concat(done, F.array(let(left, whole)))

    return F.aggregate(first(k), F.array().cast(f"array<{ROW}>"), row)


def solve(a: Column, b: Column, k: Column) -> Column:
    """Solution of the leading ``k`` by ``k`` part of the symmetric system ``a x = b``."""
    def with_factor(low: Column) -> Column:
        forward = F.aggregate(first(k), F.array().cast(ROW), lambda z, i: F.concat(z, F.array(F.try_divide(at(b, i) - dot(z, at(low, i)), at(low, i, i)))))

        def backward(z: Column) -> Column:
            below = lambda x, i: F.transform(x, lambda _, q: at(low, i + 1 + q, i))
            return F.aggregate(F.reverse(first(k)), F.array().cast(ROW), lambda x, i: F.concat(
                F.array(F.try_divide(at(z, i) - dot(below(x, i), x), at(low, i, i))), x))

        return let(forward, backward)

    return let(cholesky(a, k), with_factor)


def coefficients(penalty: Column, k: Column, p: int, m: str = "m", s: str = "s") -> Column:
    """``coef`` and ``intercept`` of the first ``k`` of ``p`` features, from the moments; missing for a singular system."""
    mean, sums = F.col(m), F.col(s)
    ridged = F.transform(sums, lambda r, i: F.transform(r, lambda v, j: F.when(i == j, v + penalty).otherwise(v)))
    beta = let(ridged, lambda a: solve(a, at(sums, p), k))
    whole = lambda b: F.when(~F.exists(b, lambda x: x.isNull()), b)
    return let(let(beta, whole), lambda b: F.struct(b.alias("coef"), (at(mean, p) - dot(b, mean)).alias("intercept")))


# ----------------------------------------------------------------- models


def fit(train: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0, cell: Sequence[str] = CELL) -> DataFrame:
    """M1: ``(*cell, n, coef, intercept)``; ``coef`` is missing where the cell is incomplete (F11) or its system singular."""
    p = len(features)
    got = coefficients(F.lit(float(penalty)), F.lit(p), p)
    model = moments(train, features, target, cell).withColumn("b", F.when((F.col("rows") == F.col("n")) & (F.col("n") > 0), got))
    return model.select(*cell, "n", "b.coef", "b.intercept")


def predict(df: DataFrame, features: Sequence[str], model: DataFrame, cell: Sequence[str] = CELL, name: str = "prediction") -> DataFrame:
    """``df`` with the prediction of its cell's model."""
    terms = [F.get("coef", F.lit(i)) * F.col(f).cast("double") for i, f in enumerate(features)]
    out = df.join(model.select(*cell, "coef", "intercept"), list(cell), "left")
    return out.withColumn(name, reduce(lambda a, b: a + b, terms, F.col("intercept"))).select(*df.columns, name)


def full_grid(predictions: DataFrame, cells: DataFrame, values: Sequence[str], time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """M4: all cells at every day from the first to the last one predicted; what is not predicted is missing."""
    ends = predictions.select(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    days = cells.select(*cell).distinct().withColumn("__e", ends).where("__e.lo is not null")
    grid = days.select(*cell, F.explode(F.sequence("__e.lo", "__e.hi", F.expr("interval 1 day"))).alias(time))
    return grid.join(predictions.select(time, *cell, *values), [time, *cell], "left").select(time, *cell, *values)


def cell_scores(predictions: DataFrame, target: str, cell: Sequence[str] = CELL, prediction: str = "prediction") -> DataFrame:
    """M3: R², RMSE and number of valid pairs by cell; no row for a cell without a valid pair."""
    o, e = F.col(target), F.col(target) - F.col(prediction)
    both = predictions.where(o.isNotNull() & F.col(prediction).isNotNull())
    sums = both.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("res"), (F.var_pop(o) * F.count(o)).alias("tot"))
    r2 = F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).when(F.col("res") == 0, 1.0).otherwise(0.0)
    return sums.select(*cell, "n", r2.alias("r2"), F.sqrt(F.col("res") / F.col("n")).alias("rmse"))


# ----------------------------------------------------------------- search


#: Multiplier of the mixing steps; small enough for products of 32-bit numbers to stay in 64 bits.
MIX = 73244475


def uniform(trial: Column, k: int, seed: int) -> Column:
    """A number in [0, 1) from whole-numbered arithmetic alone: the same in any engine and on any retry."""
    x = (trial.cast("long") * 1000003 + k * 7919 + seed) % 4294967296
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * MIX) % 4294967296
    return x.bitwiseXOR(F.shiftright(x, 16)) / F.lit(4294967296.0)


def draws(trial: Column, space: dict[str, tuple], seed: int = 42) -> dict[str, Column]:
    """M6: the parameters of a trial. A space has ``("log", lo, hi)``, ``("choice", values)`` or ``("int", lo, hi)`` (ends included) for each name."""
    out = {}
    for k, (name, (kind, *args)) in enumerate(space.items()):
        u = uniform(trial, k, seed)
        if kind == "log":
            out[name] = F.exp(u * (log(args[1]) - log(args[0])) + log(args[0]))
        elif kind == "choice":
            out[name] = F.get(F.array(*[F.lit(v) for v in args[0]]), F.floor(u * len(args[0])).cast("int"))
        elif kind == "int":
            out[name] = (F.floor(u * (args[1] - args[0] + 1)) + args[0]).cast("int")
        else:
            raise ValueError(f"unknown draw {kind!r}")
    return out


def search(df: DataFrame, features: Sequence[str], target: str, n_trials: int = 50, space: dict[str, tuple] | None = None,
           split: str = "split", cell: Sequence[str] = CELL, seed: int = 42) -> DataFrame:
    """M5: ``(trial, penalty, columns, min_rows, cells, rmse)``: the mean over cells of the validation RMSE of each trial.

    ``columns`` is the number of leading features used; cells with fewer than
    ``min_rows`` training rows are left out of a trial. Incomplete cells have no score.
    """
    p = len(features)
    space = space or {"penalty": ("log", 1e-3, 10.0), "columns": ("choice", list(range(1, p + 1))), "min_rows": ("int", 1, 30)}
    both = moments(df, features, target, [*cell, split])
    pick = lambda name, c: F.max(F.when(F.col(split) == name, F.col(c)))
    wide = both.groupBy(*cell).agg(*[pick(name, c).alias(f"{name}_{c}") for name in ("train", "valid") for c in ("rows", "n", "m", "s")])
    wide = wide.where("train_n > 0 and train_n = train_rows and valid_n > 0")
    each = wide.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1)))).withColumns(draws(F.col("trial"), space, seed))
    each = each.where(F.col("train_n") >= F.col("min_rows"))
    each = each.withColumn("b", coefficients(F.col("penalty"), F.col("columns"), p, "train_m", "train_s"))
    m, s, b = F.col("valid_m"), F.col("valid_s"), F.col("b.coef")
    off = at(m, p) - F.col("b.intercept") - dot(b, m)
    spread = at(s, p, p) - 2 * dot(b, at(s, p)) + dot(F.transform(b, lambda _, i: dot(b, at(s, i))), b)
    rmse = F.sqrt(F.greatest(off * off + spread / F.col("valid_n"), F.lit(0.0)))
    scored = each.where("b.coef is not null").withColumn("rmse", rmse)
    return scored.groupBy("trial", *space).agg(F.count(F.lit(1)).alias("cells"), F.avg("rmse").alias("rmse"))


def tuned(df: DataFrame, features: Sequence[str], target: str, **options) -> DataFrame:
    """The best trial of :func:`search`."""
    return best_trial(search(df, features, target, **options))
