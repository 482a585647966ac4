"""Ordered work on bounded pieces, and exact order statistics without a full sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint

# Rows handed to one grouped kernel call.
PIECE_ROWS = 65_536


def pieces(df: DataFrame, halo: Column | int = 0, size: int = PIECE_ROWS) -> DataFrame:
    """Cut each series into pieces of ``size`` positions, each with the ``halo`` rows before it.

    A row goes to its own piece (``core``) and, near the end of it, also to the next one.
    Kernels grouped on ``(…, piece)`` then see every lag they need in a bounded group.
    """
    halo = F.lit(halo) if isinstance(halo, int) else halo
    own = F.floor(F.col("pos") / size)
    reach = F.floor((F.col("pos") + halo) / size)
    return df.withColumn("piece", F.explode(F.sequence(own, reach))).withColumn(
        "core", F.col("piece") == F.floor(F.col("pos") / size)
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions before a CPU-heavy kernel.

    Adaptive execution merges small partitions by their bytes; a few megabytes of series can
    be hours of fitting, and a fixed number of partitions keeps them apart.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):  # cores are known and fixed
        parts = min(parts, 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def _binary(size: Column) -> tuple[Column, Column]:
    """Exponent and fraction (0 to below 1) of a positive double, exactly; zero and infinity have fraction 0.

    The logarithm may be rounded up to the next integer just below a power of two, and down just above: powers of
    two themselves are exact, so comparing with them sets the exponent right.
    """
    finite = (size > 0) & (size < F.lit(float("inf")))
    some = F.when(finite, size).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(some)).cast("double")
    exponent = (
        guess
        - F.when(F.pow(F.lit(2.0), guess) > some, F.lit(1.0)).otherwise(F.lit(0.0))
        + F.when(F.pow(F.lit(2.0), guess + 1) <= some, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    fraction = some / F.pow(F.lit(2.0), exponent) - 1
    return F.when(size == F.lit(float("inf")), F.lit(1024.0)).otherwise(exponent), fraction


def coarse(value: Column) -> Column:
    """A monotone, coarse key of a double: sign, exponent and 13 bits of mantissa."""
    size = F.abs(value)
    exponent, fraction = _binary(size)
    key = (exponent + 1100) * 16384 + F.floor(fraction * 8192)
    return F.when(size == 0, F.lit(0)).when(value > 0, key).otherwise(-key).cast("bigint")


def _digit(value: Column, level: int) -> Column:
    """The ``level``-th group of 13 mantissa bits below :func:`coarse`; monotone among values that agree above it."""
    size = F.abs(value)
    _, fraction = _binary(size)
    digit = F.pmod(F.floor(fraction * F.lit(8192.0 ** (level + 1))), F.lit(8192))
    return F.when(size == 0, F.lit(0)).when(value > 0, digit).otherwise(8191 - digit).cast("bigint")


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], weight: Column | None = None
) -> DataFrame:
    """The values at the given 1-based ranks per group, exactly.

    ``ranks`` maps output names to expressions over ``_n``, the group's row count. Equal
    values are counted before anything is ordered. A coarse histogram finds the bucket of each rank, a finer one inside
    that bucket the next, and once more; what is ordered in the end agrees in 39 mantissa bits, so a column of
    values close together does not end in one bucket. Ranks outside ``1..n`` give NULL; a group with no
    rank inside has no row. ``_n`` is returned too.
    """
    by = list(by)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    v = F.col("_v")
    # Written once: every level reads it. What is wanted is one row per group and rank.
    counted = checkpoint(
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(total.alias("_c"))
        .withColumns({"_b0": coarse(v), "_b1": _digit(v, 1), "_b2": _digit(v, 2)})
    )
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), e.cast("bigint").alias("rank")) for k, e in ranks.items()]))
    wanted = (
        counted.groupBy(*by).agg(F.sum("_c").alias("_n")).withColumn("_r", asked)
        .select(*by, "_n", F.col("_r.name").alias("_name"), F.col("_r.rank").alias("_rank"))
        .where(F.col("_rank").between(1, F.col("_n")))
    )
    path, left = list(by), counted
    for key in ("_b0", "_b1", "_b2", "_v"):
        running = Window.partitionBy(*path).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = left if key == "_v" else left.groupBy(*path, key).agg(F.sum("_c").alias("_c"))
        upto = counts.select(*path, key, "_c", F.sum("_c").over(running).alias("_upto"))
        hit = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
        wanted = upto.join(wanted, path).where(hit).select(
            *path, key, "_n", "_name", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")
        )
        path.append(key)
        if key != "_v":
            wanted = checkpoint(wanted)
            left = counted.join(wanted.select(*path).distinct(), path, "left_semi")
    return wanted.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, v)).alias(k) for k in ranks], F.first("_n").alias("_n"))


def exact_quantile(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    q: float,
    name: str,
    weight: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantile per group.

    ``bounded`` says that a group's distinct values fit in one task (see the panel module);
    then it is a single aggregate, else the search of :func:`order_statistics`.
    """
    if bounded:
        count = F.lit(1) if weight is None else weight
        return df.groupBy(*by).agg(F.percentile(value, F.lit(q), count).alias(name)).where(F.col(name).isNotNull())
    place = F.lit(q) * (F.col("_n") - 1)
    ranks = {"_lo": F.floor(place) + 1, "_hi": F.ceil(place) + 1}
    fraction = place - F.floor(place)
    return order_statistics(df, by, value, ranks, weight).select(
        *by, (F.col("_lo") + fraction * (F.col("_hi") - F.col("_lo"))).alias(name)
    )
