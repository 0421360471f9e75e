"""Ranks and cumulative counts that never sort one whole group in one task.

A window over a key sorts each key's rows in a single task, which fails when one
key holds a large share of the table.  The functions here cut every group into
ordered slices, rank inside slices and add the sizes of the earlier slices.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.functions.columns import hash_fraction, hash_order
from strandkit.session import reliable_checkpoint, shuffle_width

# Least number of slices of a group, and the rows a slice should hold beyond it.
SLICES = 64
SLICE_ROWS = 1_000_000
# Spark's own bound of a group limit inside map tasks.
MAP_SIDE_LIMIT = 1000


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group, by a total order.  ``n`` is a constant, so Spark limits every
    group inside the map tasks before the shuffle, up to ``MAP_SIDE_LIMIT`` rows.  For more, slices
    of a group by a hash of its rows are cut to ``n`` first: the last step sorts ``SLICES`` x ``n`` rows
    of a group at most, however large it is."""
    if n > MAP_SIDE_LIMIT:
        hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*hashed), F.lit(SLICES)))
        inside = F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(*order))
        df = sliced.withColumn("__in", inside).filter(F.col("__in") <= n).drop("__slice", "__in")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    position: Column,
    ties: list[Column],
    rank: str = "group_rank",
    size: str = "group_size",
    slices: int | None = None,
) -> DataFrame:
    """Exact rank and group size for an order that starts with ``position`` in [0, 1).

    The position picks the slice, so a group of any size spreads over ``slices``
    tasks.  Positions made from hashes are uniform and give equal slices.  Unless
    ``slices`` is given, their number grows with the rows of the table.
    """
    if slices is None:
        rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        width = F.greatest(F.lit(SLICES), F.ceil(rows / SLICE_ROWS)).cast("long")
    else:
        width = F.lit(slices).cast("long")
    sliced = df.withColumn("__pos", position).withColumn(
        "__slice", F.least(F.floor(F.col("__pos") * width), width - 1)
    )
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "__slice",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(whole).alias(size),
    )
    inner = W.partitionBy(*keys, "__slice").orderBy(F.col("__pos"), *ties)
    ranked = sliced.withColumn("__in", F.row_number().over(inner))
    return (
        _null_safe_join(ranked, offsets, [*keys, "__slice"])
        .withColumn(rank, F.col("__offset") + F.col("__in"))
        .drop("__pos", "__slice", "__in", "__offset")
    )


def random_rank_in_group(
    df: DataFrame, keys: list[str], id_cols: list[str], seed: int, slices: int | None = None, **names: str
) -> DataFrame:
    """``rank_in_group`` in the order of md5(seed | id)."""
    ids = [F.col(c) for c in id_cols]
    return rank_in_group(
        df, keys, hash_fraction(seed, *ids), [hash_order(seed, *ids), *ids], slices=slices, **names
    )


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position of each row in a total order, without a single-task sort.

    Rows are range-partitioned and sorted; the row index inside each partition is
    read from ``monotonically_increasing_id`` and shifted by the sizes of the
    earlier partitions.  The checkpoint fixes the partitioning between both uses.
    """
    bits = 33
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = reliable_checkpoint(
        df.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("__mid", bits).cast("int")
    inside = F.col("__mid").bitwiseAND(F.lit((1 << bits) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: bounded by the shuffle width.
    offsets = sizes.select(
        "__part",
        F.coalesce(
            F.sum("__n").over(
                W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("__offset"),
    )
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + inside + 1)
        .drop("__mid", "__part", "__offset")
    )


def slice_bounds(df: DataFrame, values: list[str]) -> list[list[float]]:
    """Approximate quantiles that cut each column into slices, in one pass.

    They only balance the slices; ranks computed with them are exact."""
    width = shuffle_width(df.sparkSession)
    marks = [i / width for i in range(1, width)]
    if not marks:
        return [[] for _ in values]
    row = df.agg(*[F.percentile_approx(F.col(v).cast("double"), marks, 20 * width) for v in values]).first()
    return [sorted(set(b or [])) for b in row]


def cumulative_before(
    df: DataFrame, by: list[str], value: str, weights: list[str], bounds: list[float] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds ``<w>_before``: the sum of each weight over smaller values in the group,
    and ``<w>_total``.  ``df`` must hold each (group, value) once.  ``source`` may
    give the rows behind ``df``: slice sums then need no shuffle of all values."""
    splits = [float("-inf"), *(slice_bounds(df, [value])[0] if bounds is None else bounds), float("inf")]

    def cut(table: DataFrame) -> DataFrame:
        as_double = table.withColumn("__v", F.col(value).cast("double"))
        if len(splits) <= 2:
            return as_double.withColumn("__slice", F.lit(0))
        placed = Bucketizer(splits=splits, inputCol="__v", outputCol="__b").transform(as_double)
        return placed.withColumn("__slice", F.col("__b").cast("int")).drop("__b")

    sliced = cut(df)
    inner = W.partitionBy(*by, "__slice").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = outer.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    behind = sliced if source is None else cut(source)
    sums = behind.groupBy(*by, "__slice").agg(*[F.sum(w).alias(f"__s_{w}") for w in weights])
    offsets = sums.select(
        *by, "__slice",
        *[F.coalesce(F.sum(f"__s_{w}").over(before), F.lit(0)).alias(f"__o_{w}") for w in weights],
        *[F.sum(f"__s_{w}").over(outer).alias(f"{w}_total") for w in weights],
    )
    out = sliced.select(
        "*", *[F.coalesce(F.sum(w).over(inner), F.lit(0)).alias(f"__i_{w}") for w in weights]
    )
    out = _null_safe_join(out, offsets, [*by, "__slice"])
    for w in weights:
        out = out.withColumn(f"{w}_before", F.col(f"__i_{w}") + F.col(f"__o_{w}"))
    return out.drop("__v", "__slice", *[f"__{x}_{w}" for x in "io" for w in weights])


def average_ranks(df: DataFrame, by: list[str], value: str, rank: str) -> DataFrame:
    """Table (by, value, rank, n): the mean 1-based rank of each distinct value."""
    return ranks_from(df, by, value, rank, None)


def ranks_from(df: DataFrame, by: list[str], value: str, rank: str, bounds: list[float] | None) -> DataFrame:
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    rows = df.select(*by, value, F.lit(1).alias("n"))
    ranked = cumulative_before(counts, by, value, ["n"], bounds, rows)
    return ranked.select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(rank))


def group_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry.

    The built-in exact percentile holds all values of a group in one task; here
    cumulative counts of distinct values locate the two neighbouring ranks.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    counts = rows.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative_before(counts, by, "__x", ["n"], None, rows.withColumn("n", F.lit(1)))
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")
    picks = []
    for name, p in quantiles.items():
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda r: (first <= r) & (r < last)
        part = place - low
        picks.append(F.sum(
            F.when(holds(low), F.col("__x") * (1 - part)).otherwise(0.0)
            + F.when(holds(high), F.col("__x") * part).otherwise(0.0)
        ).alias(name))
    return ranked.groupBy(*by).agg(*picks)


def _as_number(df: DataFrame, column: str) -> Column:
    """A number that never falls when the column grows; slices need no more."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp_ntz":
        c = F.col(column)
        days = F.unix_date(F.to_date(c)).cast("double")
        return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if kind == "date":
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def number_in_order(
    df: DataFrame, by: list[str], order: list[str], number: str = "row_number", previous: dict[str, str] | None = None
) -> DataFrame:
    """1-based row number per group in the given order, and values of the previous row.

    The first order column (a number or a time) cuts each group into slices.
    ``previous`` maps new columns to the columns they are read from; the last row
    of a slice is handed on through a table with one row per group and slice.
    """
    previous = previous or {}
    keyed = df.withColumn("__o", _as_number(df, order[0]))
    bounds = slice_bounds(keyed, ["__o"])[0]
    splits = [float("-inf"), *bounds, float("inf")]
    if bounds:
        keyed = Bucketizer(splits=splits, inputCol="__o", outputCol="__b").transform(keyed)
        keyed = keyed.withColumn("__slice", F.col("__b").cast("int")).drop("__b")
    else:
        keyed = keyed.withColumn("__slice", F.lit(0))
    key = F.struct(*order)
    slices = keyed.groupBy(*by, "__slice").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.max_by(source, key).alias(f"__last_{out}") for out, source in previous.items()],
    )
    across = W.partitionBy(*by).orderBy("__slice")
    starts = slices.select(
        *by, "__slice",
        F.coalesce(F.sum("__n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
        *[F.lag(f"__last_{out}").over(across).alias(f"__prev_{out}") for out in previous],
    )
    inner = W.partitionBy(*by, "__slice").orderBy(*order)
    placed = keyed.select(
        "*", F.row_number().over(inner).alias("__in"),
        *[F.lag(source).over(inner).alias(f"__lag_{out}") for out, source in previous.items()],
    )
    joined = _null_safe_join(placed, starts, [*by, "__slice"])
    return joined.select(
        *df.columns, (F.col("__offset") + F.col("__in")).alias(number),
        *[F.when(F.col("__in") > 1, F.col(f"__lag_{out}")).otherwise(F.col(f"__prev_{out}")).alias(out) for out in previous],
    )
