"""Helpers that keep jobs distributed when one key holds a large share of the rows.

* ``stage`` cuts lineage with a table written to the shared checkpoint folder.
* ``attach`` joins a small table: broadcast only after its size was counted, salted shuffle otherwise.
* ``scan`` runs ordered prefix sums and lags over a group of any size, block by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

BROADCAST_ROWS = 200_000
SALTS = 32
MOST_TASKS = 50_000  # of one shuffle; beyond that a task takes several rows
SCAN_BLOCK = 1 << 20
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, where it may be unset, a folder of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/") + "/checkpoints"


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    The result has no lineage to recompute when executors are lost, and Spark knows its exact size. Tables of
    one application lie in one folder, which can go once its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxelloom-stage/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(staged: DataFrame) -> None:
    """Deletes a table of ``stage`` once nothing that is still to run reads it."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_out(rows: DataFrame, *keys: str, per_task: int = 1, weight: Column | None = None) -> DataFrame:
    """Deals small rows that are about to grow over tasks by their number, or by the sum of a ``weight``.

    Adaptive execution merges partitions by their size before they grow, unless their number is given.
    """
    total = rows.count() if weight is None else rows.agg(F.sum(weight)).first()[0] or 0
    tasks = min(MOST_TASKS, -(-total // per_task))
    return rows.repartition(max(1, tasks), *keys)


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are split over ``salts`` partitions.

    ``small`` (unique on ``on``) is repeated per salt; ``big`` rows pick a salt from ``spread``. Spark's estimate
    of ``small`` leaves the repeats out, so that it might gather them all at the driver: hence the hint.
    """
    salt = F.array(*[F.lit(i) for i in range(salts)])
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(salt))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has few enough rows to be broadcast; tasks pass on counts, not rows."""
    return df.count() <= limit


def attach(
    cells: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
    how: str = "inner", limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Joins a catalogue-like table (unique on ``on``) to cells without shuffling them if it is small."""
    if is_small(small, limit):
        return cells.join(F.broadcast(small), list(on), how)
    return salted_join(cells, small, on, spread, how)


def lookup(cells: DataFrame, wanted: DataFrame, key: Sequence[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Cells (unique on ``key``) with one of the wanted keys; these are broadcast only after they were counted."""
    if is_small(wanted, limit):
        wanted = F.broadcast(wanted)
    return cells.join(wanted, list(key), "left_semi")


def scan(
    df: DataFrame, keys: Sequence[str], pos: str,
    sums: Mapping[str, Column] | None = None, lags: Mapping[str, Column] | None = None,
    block: int = SCAN_BLOCK,
) -> DataFrame:
    """Running sums (inclusive) and previous-row values per key, ordered by the integer ``pos``.

    A group is cut into blocks of ``block`` positions. Windows run inside a block; what a block hands to
    the next one is a single row, so no task sorts a whole group.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    keys = list(keys)
    blk = [*keys, "_blk"]
    rows = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)).cast("bigint"))
    for name, expr in [*sums.items(), *lags.items()]:
        rows = rows.withColumn(f"_in_{name}", expr)

    inner = W.partitionBy(*blk).orderBy(pos)
    local = rows.withColumns({
        **{f"_loc_{n}": F.sum(f"_in_{n}").over(inner.rowsBetween(W.unboundedPreceding, 0)) for n in sums},
        **{f"_loc_{n}": F.lag(f"_in_{n}").over(inner) for n in lags},
        "_first": F.row_number().over(inner) == 1,
    })
    outer = W.partitionBy(*keys).orderBy("_blk")
    carry = rows.groupBy(*blk).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums],
        *[F.max_by(f"_in_{n}", F.col(pos)).alias(f"_tot_{n}") for n in lags],
    ).select(
        *blk,
        *[F.sum(f"_tot_{n}").over(outer.rowsBetween(W.unboundedPreceding, -1)).alias(f"_car_{n}") for n in sums],
        *[F.lag(f"_tot_{n}").over(outer).alias(f"_car_{n}") for n in lags],
    )
    out = local.join(carry, blk)
    return out.select(
        *df.columns,
        *[(F.col(f"_loc_{n}") + F.coalesce(F.col(f"_car_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.when(F.col("_first"), F.col(f"_car_{n}")).otherwise(F.col(f"_loc_{n}")).alias(n) for n in lags],
    )


def with_order(df: DataFrame, order: Sequence[str | Column], name: str = "_pos") -> DataFrame:
    """Adds a position that grows along a global sort; use with ``scan(..., block=ORDER_BLOCK)``.

    The sorted rows are staged, since a second evaluation could cut the ranges elsewhere.
    """
    return stage(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


ORDER_BLOCK = 1 << _PARTITION_BITS
