"""Exact order statistics per key by distributed selection.

Equal values are collapsed first (map-side combine). A key with at most `VALUES` different values is ranked by a window. Of the
others a coarse value bucket tells which bucket holds the wanted rank; a bucket with very many different values is narrowed until few
are left, and only these are ranked. No key with more is sorted as a whole, and what is broadcast is a row for each rank of such a
key, of which there are at most one in `VALUES` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplog.session import join_small, materialize

# Different values that are ranked in one task, and parts into which a range with more is cut.
VALUES = 1_000_000
PARTS = 1024


def _value_bucket(value: Column) -> Column:
    """Monotone bucket of a double: about 90 buckets per power of ten, mirrored for negatives."""
    size = F.floor(F.log1p(F.abs(value) * F.lit(1000.0)) * F.lit(40.0))
    return F.when(value < 0, -size - 1).otherwise(size).cast("bigint")


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per key with the value at each 0-based rank. Rank expressions may use `n`, the key's row count."""
    distinct = materialize(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "distinct-values"
    )
    crowded = materialize(distinct.groupBy(*keys).agg(F.count("*").alias("_values")).filter(F.col("_values") > VALUES).select(*keys), "crowded-keys")
    if crowded.isEmpty():
        return _ranked(distinct, keys, ranks)
    crowded = F.broadcast(crowded)
    few = _ranked(distinct.join(crowded, keys, "left_anti"), keys, ranks)
    return few.unionByName(_selected(distinct.join(crowded, keys, "left_semi"), keys, ranks))


def _ranked(distinct: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """at_ranks of keys with few different values (_v with their counts _c)."""
    by_key = Window.partitionBy(*keys)
    upto = F.sum("_c").over(by_key.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = distinct.withColumn("n", F.sum("_c").over(by_key)).withColumn("_upto", upto)
    at = {name: (rank.cast("bigint") < F.col("_upto")) & (rank.cast("bigint") >= F.col("_upto") - F.col("_c")) for name, rank in ranks.items()}
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(here, F.col("_v"))).alias(name) for name, here in at.items()])


def _selected(distinct: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """at_ranks of keys with many different values."""
    distinct = distinct.withColumn("_b", _value_bucket(F.col("_v")))
    per_bucket = distinct.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        per_bucket.withColumn("n", F.sum("_bc").over(by_key))
        .withColumn("_hi", F.sum("_bc").over(running))
        .withColumn("_lo", F.col("_hi") - F.col("_bc"))
    )
    for name, rank in ranks.items():
        located = located.withColumn(f"_r_{name}", rank.cast("bigint"))
    wanted = None
    for name in ranks:
        inside = (F.col(f"_r_{name}") >= F.col("_lo")) & (F.col(f"_r_{name}") < F.col("_hi"))
        wanted = inside if wanted is None else wanted | inside
    names = [F.when((F.col(f"_r_{r}") >= F.col("_lo")) & (F.col(f"_r_{r}") < F.col("_hi")), F.struct(F.lit(r).alias("name"), F.col(f"_r_{r}").alias("rank"))) for r in ranks]
    each = located.filter(wanted).select(*keys, "n", "_b", "_lo", F.explode(F.array_compact(F.array(*names))).alias("_t"))
    ends = distinct.groupBy(*keys, "_b").agg(F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.count("*").alias("_values"))
    targets = each.join(ends, [*keys, "_b"]).select(*keys, "n", F.col("_t.name").alias("_name"), F.col("_t.rank").alias("_rank"), "_lo", "_from", "_to", "_values")
    ranked = _narrowed(distinct.drop("_b"), materialize(targets, "targets"), keys)
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == r, F.col("_v"))).alias(r) for r in ranks])


def _narrowed(distinct: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, _name, _v: the value at each target's rank.

    A target is a range of a key's values with the number of rows below it. Ranges with more than `VALUES` different values are cut in
    `PARTS` and the part with the rank is kept, until all ranges are small; only then are values ranked. Counts are combined
    before they move, and a key's values are spread over tasks by the value.
    """
    by = [*keys, "_name"]
    while (targets.agg(F.max("_values").alias("m")).first()["m"] or 0) > VALUES:
        share = (F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        part = F.least(F.lit(PARTS - 1), F.floor(share * PARTS)).cast("int")
        large = targets.filter(F.col("_values") > VALUES)
        parts = _inside(distinct, large, keys).groupBy(*by, part.alias("_part")).agg(
            F.sum("_c").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_more")
        )
        below = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
        placed = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(below), F.lit(0))).join(large, by)
        start = F.col("_lo") + F.col("_before")
        kept = placed.filter((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_rows"))).select(
            *keys, "n", "_name", "_rank", start.alias("_lo"), F.col("_low").alias("_from"), F.col("_high").alias("_to"), F.col("_more").alias("_values")
        )
        targets = materialize(targets.filter(F.col("_values") <= VALUES).unionByName(kept), "targets")
    inner = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = _inside(distinct, targets, keys).withColumn("_upto", F.col("_lo") + F.sum("_c").over(inner))
    return rows.filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))).select(*keys, "n", "_name", "_v")


def _inside(distinct: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the targets of their key in whose range they lie."""
    return join_small(distinct, targets, keys, spread=["_v"]).filter(F.col("_v").between(F.col("_from"), F.col("_to")))


def exact_total(value: str) -> Column:
    """Sum of doubles as decimals of 18 places, which does not depend on row order; a plain sum where one does not fit."""
    fitting = F.col(value).try_cast("decimal(38,18)")
    plain = F.sum(value).cast("double")
    return F.when(F.count(value) == F.count(fitting), F.coalesce(F.try_sum(fitting).cast("double"), plain)).otherwise(plain)


def latency_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, median, p95, max and total per key.

    p95 is the value at 0-based position min(n-1, floor(0.95 n)), which differs from a standard percentile when
    0.95 n is whole. Totals do not depend on row order.
    """
    df = materialize(df.select(*keys, value), "values")
    n = F.col("n")
    ranks = at_ranks(
        df, keys, value,
        {
            "_mid_lo": F.floor((n - 1) / 2),
            "_mid_hi": F.floor(n / 2),
            "p95": F.least(n - 1, F.floor(n * F.lit(0.95))),
        },
    )
    totals = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(value).alias("max"),
        exact_total(value).alias("total"),
    )
    return ranks.join(totals.hint("merge"), keys).select(  # both sides have a row for each key
        *keys,
        F.col("n").alias("count"),
        ((F.col("_mid_lo") + F.col("_mid_hi")) / 2).alias("median"),
        "p95", "max", "total",
    )
