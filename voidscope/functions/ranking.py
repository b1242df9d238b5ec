"""Exact row numbers, splits and medians that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voidscope.session import stage


def number_rows(df: DataFrame, by: list[str], order_by: list[str], name: str) -> DataFrame:
    """0-based position of each row among rows with equal ``by``, in ``order_by`` order.

    A range shuffle on ``by + order_by`` spreads a large group over many partitions; the row count of
    every earlier run of the same group is then added to the position inside the partition. Only the
    (partition, group) run table goes through a window.
    """
    keys = by + order_by
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "ranked",
    )
    runs = placed.groupBy("_part", *by).agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_len")
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # staged, so that its size is known before the join: below the threshold the rows are not shuffled again
    runs = stage(runs.withColumn("_before", F.coalesce(F.sum("_len").over(earlier), F.lit(0))).drop("_len"), "runs")
    return (
        placed.join(runs, ["_part", *by])
        .withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before"))
        .drop("_part", "_pos", "_first", "_before")
    )


def smallest_flag(df: DataFrame, key: Column, ties: list[str], how_many: int, name: str) -> DataFrame:
    """Flag exactly the ``how_many`` rows with the smallest hexadecimal ``key``.

    The first four hex digits give 65,536 buckets. Their counts tell which bucket the cut falls in, and
    only that bucket's rows are sorted.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 4))
    counts = keyed.groupBy("_bucket").count()
    before = F.coalesce(
        F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    cut = (
        counts.withColumn("_before", before)
        .filter((F.col("_before") < how_many) & (F.col("_before") + F.col("count") >= how_many))
        .first()
    )
    if cut is None:
        return df.withColumn(name, F.lit(how_many > 0))
    inside = keyed.filter(F.col("_bucket") == cut["_bucket"])
    last = (
        inside.select("_key", *ties)
        .orderBy("_key", *ties)
        .limit(how_many - cut["_before"])
        .orderBy(F.desc("_key"), *[F.desc(t) for t in ties])
        .first()
    )
    order = F.struct("_key", *ties)
    bound = F.struct(*[F.lit(last[c]).cast(keyed.schema[c].dataType) for c in ["_key", *ties]])
    return keyed.withColumn(name, order <= bound).drop("_key", "_bucket")


def exact_medians(df: DataFrame, columns: list[str], bins: int = 4096) -> dict[str, float]:
    """Exact medians (midpoint for an even count) of many columns by repeated histograms.

    Every round bins the values still in question, keeps the one bin holding the wanted rank and
    narrows to that bin's own minimum and maximum. The driver reads one small row per column and rank.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_c")).select("_c.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    spans = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    ).collect()
    open_ranks = {}
    found: dict[tuple[str, int], float] = {}
    for row in spans:
        if row["lo"] == float("-inf") or row["hi"] == float("inf"):
            raise ValueError(f"column {row['feature']} holds an infinite value, so it has no finite median scale")
        for side, rank in enumerate(((row["n"] - 1) // 2, row["n"] // 2)):
            open_ranks[row["feature"], side] = (row["lo"], row["hi"], rank)
    while open_ranks:
        for key, (lo, hi, _) in list(open_ranks.items()):
            if lo == hi:
                found[key] = lo
                del open_ranks[key]
        if not open_ranks:
            break
        targets = long.sparkSession.createDataFrame(
            [(f, s, lo, hi, k) for (f, s), (lo, hi, k) in open_ranks.items()],
            "feature string, side int, lo double, hi double, k long",
        )
        place = F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)
        counts = (
            long.join(F.broadcast(targets), "feature")  # at most two rows per column
            .filter(F.col("value").between(F.col("lo"), F.col("hi")))
            .groupBy("feature", "side", "k", F.least(place, F.lit(bins - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        )
        upto = Window.partitionBy("feature", "side").orderBy("bin")
        chosen = (
            counts.withColumn("through", F.sum("n").over(upto))
            .filter((F.col("through") > F.col("k")) & (F.col("through") - F.col("n") <= F.col("k")))
            .collect()
        )
        before = dict(open_ranks)
        for row in chosen:
            open_ranks[row["feature"], row["side"]] = (
                row["lo"], row["hi"], row["k"] - (row["through"] - row["n"]))
        stuck = [feature for (feature, side), state in open_ranks.items() if state == before[feature, side]]
        if stuck:  # a bin that holds its whole range: its two ends differ by less than a bin can tell
            raise ArithmeticError(f"no progress on the median of {', '.join(sorted(set(stuck)))}")
    return {c: (found[c, 0] + found[c, 1]) / 2 for c in columns if (c, 0) in found}
