"""Exact interpolated quantiles without gathering a group in one task.

The built-in `percentile` keeps every distinct value of a group in one buffer, so
one huge group (or no grouping at all) ends on one task. Here three narrow passes
find the wanted ranks, and only the second and third shuffle, a few rows each:

1. a mergeable sketch brackets every wanted rank;
2. values are counted below, above and in equal-width slots inside the bracket,
   which gives each slot's exact rank range;
3. only values in the slot around a rank are counted one by one and ordered.

The sketch decides how much work is left, never the result: a rank outside its
bracket is found in the slot below or above it.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import as_local_row, staged

ACCURACY = 10_000
SLOTS = 4096


def _beside(data: DataFrame, state: DataFrame, keys) -> DataFrame:
    """Rows with their key's `_w`; without keys the state is one row, read as a scalar.

    The state is computed here: kept as a constant row, or staged as a table of one
    row per key, so that the plan of the next pass does not contain this one again.
    """
    if not keys:
        state = as_local_row(state)
        return data.select("_v", state.select("_w").scalar().alias("_w"))
    state = staged(state, "quantiles")
    state = state.toDF(*[f"_k_{c}" if c in keys else c for c in state.columns])
    on = [data[k].eqNullSafe(state[f"_k_{k}"]) for k in keys]
    return data.join(state, on).select(*keys, "_v", "_w")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys=()) -> DataFrame:
    """One row per key with `n` and one column per named probability.

    Linear interpolation between the two neighbouring ranks. NULL and NaN values
    are ignored; a key with no value at all does not appear. The input is read three
    times, the first two when this is called, so stage it first when it is costly to
    recompute.
    """
    keys = list(keys)
    wanted = sorted(set(probs.values()))
    number = F.col(value).cast("double")
    data = df.select(*keys, number.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")

    slack = 2 / ACCURACY
    grid = F.array(*[F.lit(b) for p in wanted for b in (max(p - slack, 0.0), min(p + slack, 1.0))])
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", grid, ACCURACY).alias("_q")
    )
    targets = F.array(
        *[
            F.expr(
                f"named_struct('i', {i}, 'n', _n, 'lo', _q[{2 * i}], 'hi', _q[{2 * i + 1}],"
                f" 'r0', CAST(floor((_n - 1) * {p!r}D) AS BIGINT), 'r1', CAST(ceil((_n - 1) * {p!r}D) AS BIGINT))"
            )
            for i, p in enumerate(wanted)
        ]
    )
    bracketed = _beside(data, sketch.where("_n > 0").select(*keys, targets.alias("_w")), keys)

    rank = ["i", "n", "r0", "r1"]
    slot = F.expr(
        f"CASE WHEN _v < lo THEN -1 WHEN _v > hi THEN {SLOTS} WHEN hi > lo THEN"
        f" CAST(least(floor((_v - lo) / (hi - lo) * {SLOTS}), {SLOTS - 1}) AS INT) ELSE 0 END"
    )
    slots = (
        bracketed.select(*keys, "_v", F.inline("_w"))
        .groupBy(*keys, *rank, slot.alias("_slot"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
    )
    below = F.sum("_c").over(
        Window.partitionBy(*keys, "i").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    around = slots.withColumn("upto", below).where("upto > r0 AND upto - _c <= r1")
    # One or two slots per probability.
    chosen = around.groupBy(*keys).agg(
        F.collect_list(F.struct(*rank, (F.col("upto") - F.col("_c")).alias("before"), "a", "b")).alias("_w")
    )
    inside = _beside(data, chosen, keys).select(*keys, "_v", F.inline(F.expr("filter(_w, s -> _v BETWEEN s.a AND s.b)")))

    counted = inside.groupBy(*keys, *rank, "before", "_v").agg(F.count("*").alias("_c"))
    running = F.col("before") + F.sum("_c").over(
        Window.partitionBy(*keys, "i", "before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = counted.withColumn("upto", running).where("upto > r0 AND upto - _c <= r1")

    def at(i: int, r: str) -> Column:
        return F.max(F.expr(f"CASE WHEN i = {i} AND upto > {r} AND upto - _c <= {r} THEN _v END"))

    def quantile(p: float) -> Column:
        i = wanted.index(p)
        low, high = at(i, "r0"), at(i, "r1")
        part = F.max(F.expr(f"CASE WHEN i = {i} THEN (n - 1) * {p!r}D - r0 END"))
        return low + (high - low) * part

    return placed.groupBy(*keys).agg(
        F.max("n").alias("n"), *[quantile(p).alias(name) for name, p in probs.items()]
    )


def exact_median(df: DataFrame, value: str, keys=(), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, keys)
