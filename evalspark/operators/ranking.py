"""Top-k, selection by exact rank, and ordered scans that stay balanced under any key skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, shuffle_width

SMALL_K = 1000  # spark.sql.optimizer.windowGroupLimitThreshold: below it ranks are pruned map-side


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key, for any k.

    Up to SMALL_K Spark prunes each map task to k rows per key before the shuffle. Beyond, the rows of a key are first
    cut to k within each input partition, so that no task sorts a whole hot key, and then ranked; same result.
    """
    if k > SMALL_K:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        cut = df.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.row_number().over(part))
        df = cut.filter(F.col("_place") <= k).drop("_part", "_place")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of a whole table, for any n.

    Up to SMALL_K each task keeps n rows and the driver's merge is small. Beyond, rows are numbered over range slices, so
    no task takes them all; same result.
    """
    if n <= SMALL_K:
        return df.orderBy(*order).limit(n)
    return numbered(df, [], list(order), "_place").filter(F.col("_place") <= n).drop("_place")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, tuple[float, Column]],
    accuracy: int = 200_000,
) -> DataFrame:
    """Exact order statistics per key without sorting a whole key in one task.

    ``ranks`` maps an output name to (fraction, zero-based rank as an expression over ``n``).
    A sketch brackets every wanted rank; only values inside the bracket are ranked exactly,
    after equal values were merged into counts. Groups too small for the bracket keep all values.
    """
    eps = 4.0 / accuracy
    small = int(4 / eps)
    names = list(ranks)
    probes: list[float] = []
    for name in names:
        p = ranks[name][0]
        probes += [max(0.0, p - eps), min(1.0, p + eps)]
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    stats = data.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", probes, accuracy).alias("_probe"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(name).alias("stat"),
                ranks[name][1].cast("long").alias("r"),
                F.when(F.col("n") <= small, F.col("_min")).otherwise(F.col("_probe")[2 * i]).alias("lo"),
                F.when(F.col("n") <= small, F.col("_max")).otherwise(F.col("_probe")[2 * i + 1]).alias("hi"),
            )
            for i, name in enumerate(names)
        ]
    )
    bounds = stats.select(*keys, "n", brackets.alias("_b"))
    joined = _attach(data, bounds, keys)
    piece = joined.select(*keys, "n", "_v", F.explode("_b").alias("b")).filter(F.col("_v") <= F.col("b.hi"))
    # one row per (key, stat, value inside the bracket); everything below it is one null bin
    bins = piece.groupBy(
        *keys, "n", F.col("b.stat").alias("stat"), F.col("b.r").alias("_r"),
        F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "stat").orderBy(F.col("_v").asc_nulls_first())
    reached = bins.withColumn("_cum", F.sum("_c").over(w)).filter(F.col("_cum") > F.col("_r"))
    found = reached.groupBy(*keys, "stat", "n").agg(F.min_by("_v", "_cum").alias("_v"))
    if not keys:
        found = found.withColumn("_all", F.lit(1))
    out = found.groupBy(*(keys or ["_all"]), "n").agg(
        *[F.max(F.when(F.col("stat") == name, F.col("_v"))).alias(name) for name in names]
    )
    return out.drop("_all")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row through a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_one", packed).select("*", "_one.*").drop("_one")


def _attach(data: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-key facts to every row; with no keys the facts are one row."""
    return data.join(small, list(keys)) if keys else with_scalars(data, small)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles: index round-half-even(p/100 * (n-1)) of the sorted values."""
    ranks = {
        name: (p / 100.0, F.rint(F.lit(p / 100.0) * (F.col("n") - 1)))
        for name, p in percents.items()
    }
    return values_at_ranks(df, keys, value, ranks)


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median with the mean of the two middle values for even counts."""
    both = values_at_ranks(
        df, keys, value,
        {"_lo": (0.5, F.floor((F.col("n") - 1) / 2)), "_hi": (0.5, F.floor(F.col("n") / 2))},
    )
    return both.withColumn(name, (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")


def lowest_per_key(df: DataFrame, keys: Sequence[str], order: str, quota) -> DataFrame:
    """The ``quota`` rows of each key with the lowest value of a distinct order column.

    ``quota`` is a number or a DataFrame (keys, quota). A cutoff per key comes from exact rank
    selection, so no key is ever sorted as a whole.
    """
    if isinstance(quota, int):
        cut = _cutoffs(df, keys, order, F.lit(quota))
    else:
        cut = _cutoffs(df, keys, order, None, quota)
    return df.join(cut, list(keys)).filter(F.col(order) <= F.col("_cut")).drop("_cut")


def _cutoffs(df, keys, order, quota, table=None) -> DataFrame:
    """Value of rank quota-1 per key, found by narrowing a value histogram twice."""
    span = df.groupBy(*keys).agg(F.count(order).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    span = span.join(table, list(keys)) if table is not None else span.withColumn("quota", quota)
    span = span.filter(F.col("quota") > 0).withColumn("_r", F.least("quota", "_n") - 1)
    current = span.select(*keys, "_lo", "_hi", "_r")
    bins = 65536.0
    for _ in range(2):
        width = (F.col("_hi").cast("double") - F.col("_lo").cast("double")) / bins
        cell = F.when(width <= 0, F.lit(0)).otherwise(F.floor((F.col(order).cast("double") - F.col("_lo").cast("double")) / width))
        cells = (
            df.join(current, list(keys))
            .filter((F.col(order) >= F.col("_lo")) & (F.col(order) <= F.col("_hi")))
            .groupBy(*keys, "_r", cell.alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
        )
        w = Window.partitionBy(*keys).orderBy("_cell")
        hit = cells.withColumn("_cum", F.sum("_c").over(w)).filter(F.col("_cum") > F.col("_r"))
        hit = hit.groupBy(*keys, "_r").agg(F.min_by(F.struct("_lo", "_hi", "_c", "_cum"), "_cell").alias("h"))
        current = hit.select(
            *keys, F.col("h._lo").alias("_lo"), F.col("h._hi").alias("_hi"),
            (F.col("_r") - (F.col("h._cum") - F.col("h._c"))).alias("_r"),
        )
    rest = df.join(current, list(keys)).filter((F.col(order) >= F.col("_lo")) & (F.col(order) <= F.col("_hi")))
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        rest.withColumn("_k", F.row_number().over(w) - 1)
        .filter(F.col("_k") == F.col("_r"))
        .select(*keys, F.col(order).alias("_cut"))
    )


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut the table into balanced slices that are contiguous in (keys, order).

    Range partitioning samples the sort key, so a key with a third of all rows spreads over a
    third of the slices. The result is checkpointed because the sampled bounds are not repeatable.
    """
    width = shuffle_width(df.sparkSession)
    return durable(df.repartitionByRange(width, *keys, *order).withColumn("_slice", F.spark_partition_id()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """row_number() over (partition by keys order by order) for keys of any size."""
    s = sliced(df, keys, order)
    sizes = s.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        s.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_slice")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """lag(value, 1) per key for keys of any size: local lag, then a carry across slice borders."""
    s = sliced(df, keys, order)
    row = F.struct(*values)
    last = s.groupBy(*keys, "_slice").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    borders = last.select(
        *keys, "_slice", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    out = (
        s.withColumn("_prev", F.lag(row).over(local))
        .join(borders, [*keys, "_slice"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
    )
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_prev.{v}"))
    return out.drop("_prev", "_carry", "_slice")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Largest value strictly before the row, per key, for keys of any size."""
    s = sliced(df, keys, order)
    tops = s.groupBy(*keys, "_slice").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_slice", F.max("_top").over(earlier).alias("_carry"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        s.withColumn("_local", F.max(value).over(local))
        .join(carry, [*keys, "_slice"])
        .withColumn(name, F.greatest("_local", "_carry"))
        .drop("_local", "_carry", "_slice")
    )
