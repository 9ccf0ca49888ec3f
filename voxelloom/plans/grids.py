"""Grids, masks and requests derived from the driver's tables.

``events`` and ``orders`` have dense keys 0..n-1, which serve as linear voxel indices. Extents are
20 x 25 x n/500 and 30 x 50 x n/1500; spacing is (0.5, 0.5, 2.0).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.color import roi_color

# name -> (table, key, value expression, nx, ny)
GRIDS = {
    "events": ("events", "event_id", "value", 20, 25),
    "orders": ("orders", "o_orderkey", "o_totalprice", 30, 50),
}
EVENT_CLASS = """case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                 when 'signup' then 4 else 0 end"""
ORDER_CLASS = "cast(substring(o_orderpriority, 1, 1) as int) % 5"


class Grids:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _coords(key: str, nx: int, ny: int) -> list[str]:
        return [
            f"cast({key} div {nx * ny} as int) as z",
            f"cast(({key} div {nx}) % {ny} as int) as y",
            f"cast({key} % {nx} as int) as x",
        ]

    @cached_property
    def voxels(self) -> DataFrame:
        parts = []
        for name, (table, key, value, nx, ny) in GRIDS.items():
            parts.append(self.table(table).selectExpr(
                f"'{name}' as volume_id", *self._coords(key, nx, ny), f"cast(round({value} * 100) as int) as v"))
        return parts[0].unionByName(parts[1])

    @cached_property
    def volumes(self) -> DataFrame:
        """The catalogue: one global aggregate per table gives its one row, as part of the plan that asks for it."""
        rows = []
        for name, (table, key, value, nx, ny) in GRIDS.items():
            v = F.expr(f"cast(round({value} * 100) as int)")
            found = self.table(table).agg(F.count(F.lit(1)).alias("n"), F.min(v).cast("double").alias("vmin"),
                                          F.max(v).cast("double").alias("vmax"))
            rows.append(found.selectExpr(
                f"'{name}' as volume_id", f"{nx} as nx", f"{ny} as ny", f"cast(n div {nx * ny} as int) as nz",
                "'uint16' as data_type", "0.5D as sx", "0.5D as sy", "2.0D as sz", "'little-endian' as byte_order",
                "false as is_rgb", "vmin", "vmax", f"'{table}' as description"))
        return rows[0].unionByName(rows[1])

    @cached_property
    def mask(self) -> DataFrame:
        events = self.table("events").selectExpr(
            "'m_type' as mask_id", *self._coords("event_id", 20, 25), f"{EVENT_CLASS} as class_id")
        orders = self.table("orders").selectExpr(
            "'m_prio' as mask_id", *self._coords("o_orderkey", 30, 50), f"{ORDER_CLASS} as class_id")
        return events.unionByName(orders).where("class_id <> 0")

    @cached_property
    def masks(self) -> DataFrame:
        return self.volumes.selectExpr(
            "case volume_id when 'events' then 'm_type' else 'm_prio' end as mask_id", "volume_id",
            "'uint8' as class_data_type", "0 as fill_value", "64 as chunk_size")

    @cached_property
    def rois(self) -> DataFrame:
        """One region per class in use; class 3 is hidden, class 2 locked."""
        used = self.mask.groupBy("mask_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
        return used.select(
            "mask_id", F.concat(F.lit("roi-"), F.col("class_id").cast("string")).alias("roi_id"), "class_id",
            F.concat(F.lit("ROI "), F.col("class_id").cast("string")).alias("name"),
            roi_color(F.col("class_id") - 1).alias("color_hex"), (F.col("class_id") != 3).alias("visible"),
            (F.col("class_id") == 2).alias("locked"), F.col("class_id").alias("ordinal"))

    @cached_property
    def points(self) -> DataFrame:
        """One probe per customer, some of them outside the grid."""
        return self.table("customer").selectExpr(
            "c_custkey as point_id", "'m_type' as mask_id", "'events' as volume_id", "cast(c_nationkey as int) as z",
            "cast((c_custkey div 23) % 27 - 1 as int) as y", "cast(c_custkey % 23 - 1 as int) as x")

    @cached_property
    def rects(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey as rect_id", "'events' as volume_id", "cast(s_nationkey as int) as idx",
            "cast(s_suppkey % 20 as double) as x1", "cast((s_suppkey * 7) % 25 as double) as y1",
            "cast((s_suppkey * 3) % 23 as double) as x2", "cast((s_suppkey * 11) % 29 as double) as y2")

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as sample_id", "'orders' as volume_id", "cast(p_size - 1 as int) as idx",
            "cast(p_partkey % 331 as double) / 10 - 1 as px", "cast(p_partkey % 523 as double) / 10 - 1 as py")

    @cached_property
    def strokes(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "'m_type' as mask_id", "c_custkey as seq",
            "case c_custkey % 3 when 0 then 'xy' when 1 then 'xz' else 'yz' end as axis", "cast(c_nationkey as int) as idx",
            "cast(c_custkey % 33 as double) as u", "cast((c_custkey div 7) % 29 as double) as v",
            "cast(c_nationkey % 4 as int) as radius", "cast(c_custkey % 5 as int) as class_id",
            "cast(c_custkey % 2 as int) as slice_radius")

    @cached_property
    def edit_volumes(self) -> DataFrame:
        return self.volumes.where("volume_id = 'events'").selectExpr(
            "'edit' as volume_id", "20 as nx", "25 as ny", "1 as nz", "sx", "sy", "sz")

    @cached_property
    def edit_masks(self) -> DataFrame:
        return self.edit_volumes.selectExpr("'m_edit' as mask_id", "volume_id", "'uint8' as class_data_type", "0 as fill_value")

    @cached_property
    def edit_log(self) -> DataFrame:
        """One write per event on a 20 x 25 slice; four events form an operation."""
        return self.table("events").selectExpr(
            "'m_edit' as mask_id", "event_id as seq", "event_id div 4 as op_id",
            "case when (event_id div 4) % 7 = 0 then null else concat('k', cast(event_id div 12 as string)) end as merge_key",
            "0 as z", "cast(((event_id * 7919) % 500) div 20 as int) as y", "cast((event_id * 7919) % 20 as int) as x",
            f"{EVENT_CLASS} as after_class")

    @cached_property
    def no_mask(self) -> DataFrame:
        return self.mask.where("false")
