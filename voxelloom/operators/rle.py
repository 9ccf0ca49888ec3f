"""Run-length encodings of masks, built from sparse rows and decoded back to them.

A run is found inside blocks of the linear index and joined across block borders, so no task orders a whole
volume; tiles are bounded by their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import dbl
from ..model import coords_of_linear, linear_index
from ..scale import SCAN_BLOCK, attach, scan, spread_out, stage

BINARY_ENCODING = "binary-rle-v1"
LABEL_ENCODING = "label-rle-v1"
TILES_FORMAT = "viewer-segmentation-tiles-v1"
MIN_TILE = 8
TILE = 64
EXPAND_ROWS = 1 << 18  # positions that a task writes out, about


def islands(cells: DataFrame, keys: Sequence[str], pos: str = "linear", block: int = SCAN_BLOCK) -> DataFrame:
    """Maximal runs (keys, st, len) of consecutive positions; positions are distinct within a key.

    Only runs that touch a block border, at most two per block, meet again to be joined.
    """
    keys = list(keys)
    blk = [*keys, "_blk"]
    rows = cells.select(*keys, F.col(pos).cast("bigint").alias("_p")).withColumn(
        "_blk", F.expr(f"_p div {block}"))
    order = W.partitionBy(*blk).orderBy("_p")
    runs = rows.withColumn("_g", F.col("_p") - F.row_number().over(order)).groupBy(*blk, "_g").agg(
        F.min("_p").alias("st"), F.count(F.lit(1)).alias("len")).drop("_blk", "_g")
    runs = stage(runs)  # far fewer than cells, and read more than once below
    edge = (F.col("st") % block == 0) | ((F.col("st") + F.col("len")) % block == 0)
    along = W.partitionBy(*keys).orderBy("st")
    joined = runs.where(edge).withColumn(
        "_new", F.when(F.lag(F.col("st") + F.col("len")).over(along) == F.col("st"), 0).otherwise(1))
    joined = joined.withColumn("_g", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "_g").agg(
        F.min("st").alias("st"), F.sum("len").alias("len")).drop("_g")
    return runs.where(~edge).unionByName(joined)


def rle_binary(mask: DataFrame, masks: DataFrame, volumes: DataFrame, classes: DataFrame,
               block: int = SCAN_BLOCK) -> DataFrame:
    """Alternating runs of wanted classes (mask_id, class_id): (mask_id, class_id, run_no, bit, st, len).

    The class that fills the background is encoded from the rows that differ from it.
    """
    key = ["mask_id", "class_id"]
    grids = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select(
        "mask_id", "fill_value", "nx", "ny", (F.col("nx").cast("bigint") * F.col("ny") * F.col("nz")).alias("total"))
    # One row per class, staged, since it is joined several times.
    want = stage(classes.select(*key).join(grids, "mask_id").withColumn("_on", F.when(
        F.col("class_id") == F.col("fill_value"), 0).otherwise(1)))
    # A row serves its own class; for the background, of which a mask has one, every row marks a gap.
    own = attach(mask, want.where("_on = 1"), key, ["z", "y", "x"])
    gaps = attach(mask.drop("class_id"), want.where("_on = 0"), ["mask_id"], ["z", "y", "x"])
    rows = own.unionByName(gaps)
    marks = islands(rows.select(*key, linear_index().alias("linear")), key, block=block)
    found = scan(marks, key, "st", {"_k": F.lit(1), "_z": (F.col("st") > 0).cast("int")},
                 {"_prev": F.col("st") + F.col("len")}, block)
    found = stage(attach(found, want.select(*key, "_on", "total"), key, ["st"]))
    gap = F.coalesce("_prev", F.lit(0))
    number = F.col("_k") + F.col("_z")

    def run(no: Column, bit: Column, st: Column, length: Column) -> Column:
        return F.struct(no.cast("bigint").alias("run_no"), bit.cast("int").alias("bit"),
                        st.cast("bigint").alias("st"), length.cast("bigint").alias("len"))

    pieces = found.select(*key, F.explode(F.array(
        run(number, F.col("_on"), F.col("st"), F.col("len")),
        run(number - 1, 1 - F.col("_on"), gap, F.col("st") - gap))).alias("r"))
    ends = found.groupBy(*key).agg(F.max(number).alias("_n"), F.max(F.col("st") + F.col("len")).alias("_end"))
    tail = want.join(ends, key, "left").select(*key, run(
        F.coalesce("_n", F.lit(0)) + 1, 1 - F.col("_on"), F.coalesce("_end", F.lit(0)),
        F.col("total") - F.coalesce("_end", F.lit(0))).alias("r"))
    return pieces.unionByName(tail).select(*key, "r.*").where(F.col("len") > 0)


def rle_header(runs: DataFrame) -> DataFrame:
    """Totals of each run list: (mask_id, class_id, total_voxels, one_count, starts_with)."""
    return runs.groupBy("mask_id", "class_id").agg(
        F.sum("len").alias("total_voxels"),
        F.sum(F.when(F.col("bit") == 1, F.col("len")).otherwise(0)).alias("one_count"),
        F.max(F.when(F.col("st") == 0, F.col("bit"))).alias("starts_with"))


def expand_runs(runs: DataFrame, keep: Sequence[str], chunk: int = 1 << 16) -> DataFrame:
    """One row per position of each run (st, len); long runs are cut up and spread before they grow.

    Tasks are as many as the positions ask for: short runs, however many, share one.
    """
    runs = stage(runs.select(*keep, "st", "len"))
    cut = runs.select(*keep, "st", "len", F.explode(F.expr(f"sequence(st, st + len - 1, cast({chunk} as bigint))")).alias("_from"))
    cut = cut.withColumn("_to", F.least(F.col("_from") + chunk, F.col("st") + F.col("len")) - 1).drop("st", "len")
    weight = F.col("_to") - F.col("_from") + 1
    return spread_out(cut, *keep, "_from", per_task=EXPAND_ROWS, weight=weight).select(*keep, F.explode(F.expr("sequence(_from, _to)")).alias("linear"))


def rle_binary_decode(runs: DataFrame, headers: DataFrame, keys: Sequence[str],
                      block: int = SCAN_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Positions of 1-bits and the refused run lists.

    ``runs`` (keys, run_no, length) alternate from ``starts_with`` of ``headers`` (keys, total_voxels,
    starts_with); a run without length only flips the bit. A list is refused unless its runs reach
    total_voxels exactly; what follows that point is ignored.
    """
    keys = list(keys)
    clean = runs.withColumn("length", F.greatest(F.lit(0), F.floor(F.coalesce("length", F.lit(0)))).cast("bigint"))
    ends = stage(scan(clean, keys, "run_no", {"_end": F.col("length")}, block=block))
    headers = stage(headers)
    at = attach(ends, headers.select(*keys, "total_voxels", "starts_with"), keys, ["run_no"])
    reached = at.groupBy(*keys).agg(F.max((F.col("_end") == F.col("total_voxels")).cast("int")).alias("_ok"),
                                    F.max("_end").alias("_sum"))
    judged = stage(headers.join(reached, keys, "left").withColumn(
        "_ok", (F.col("total_voxels") <= 0) | (F.coalesce("_ok", F.lit(0)) == 1)))
    refused = judged.where(~F.col("_ok")).select(*keys, "total_voxels", F.coalesce("_sum", F.lit(0)).alias("run_sum"))
    on = at.withColumn("st", F.col("_end") - F.col("length")).where(
        (F.col("length") > 0) & (F.col("_end") <= F.col("total_voxels"))
        & ((F.col("starts_with") + F.col("run_no") - 1) % 2 == 1))
    on = attach(on, judged.where("_ok").select(*keys), keys, ["run_no"], "left_semi")
    return expand_runs(on.select(*keys, "st", F.col("length").alias("len")), keys), refused


def tile_runs(mask: DataFrame, masks: DataFrame, volumes: DataFrame, chunk: int = TILE) -> DataFrame:
    """Label runs of every tile with a non-zero voxel, in tile-local linear order, zeros included.

    Rows (mask_id, cz, cy, cx, size_z, size_y, size_x, run_no, value, len). All windows share the tile as
    partition, hence one shuffle. Masks with another fill value than 0 are expanded by ``dense_rows`` first.
    """
    cs = max(MIN_TILE, int(chunk))
    grids = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select("mask_id", "nx", "ny", "nz")
    at = attach(mask.where(F.col("class_id") != 0), grids, ["mask_id"], ["z", "y", "x"])
    for c in ("z", "y", "x"):
        at = at.withColumn(f"c{c}", F.expr(f"cast({c} div {cs} as int)")).withColumn(
            f"size_{c}", F.expr(f"cast(least({cs}, n{c} - ({c} div {cs}) * {cs}) as int)"))
    tile = ["mask_id", "cz", "cy", "cx", "size_z", "size_y", "size_x"]
    at = at.select(*tile, "class_id", F.expr(
        f"cast(x % {cs} + (y % {cs}) * size_x + (z % {cs}) * size_x * size_y as bigint)").alias("_p"))
    order = W.partitionBy(*tile).orderBy("_p")
    same = (F.lag("_p").over(order) == F.col("_p") - 1) & (F.lag("class_id").over(order) == F.col("class_id"))
    runs = at.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn(
        "_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*tile, "_g").agg(
        F.min("_p").alias("_st"), F.count(F.lit(1)).alias("_len"), F.first("class_id").alias("_value"))
    by_run = W.partitionBy(*tile).orderBy("_st")
    before = F.col("_st") - F.coalesce(F.lag(F.col("_st") + F.col("_len")).over(by_run), F.lit(0))
    final = F.lead("_st").over(by_run).isNull()
    volume = (F.col("size_z") * F.col("size_y") * F.col("size_x")).cast("bigint")
    after = F.when(final, volume - F.col("_st") - F.col("_len")).otherwise(F.lit(0))
    shaped = runs.withColumns({"_before": before, "_after": after}).select(*tile, F.explode(F.array(
        F.struct((F.col("_st") - F.col("_before")).alias("st"), F.lit(0).alias("value"), F.col("_before").alias("len")),
        F.struct(F.col("_st").alias("st"), F.col("_value").alias("value"), F.col("_len").alias("len")),
        F.struct((F.col("_st") + F.col("_len")).alias("st"), F.lit(0).alias("value"), F.col("_after").alias("len")))).alias("r"))
    shaped = shaped.select(*tile, "r.*").where(F.col("len") > 0)
    number = F.row_number().over(W.partitionBy(*tile).orderBy("st"))
    return shaped.select(*tile, number.alias("run_no"), F.col("value").cast("int").alias("value"),
                         F.col("len").cast("bigint").alias("len"))


def dense_rows(mask: DataFrame, masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Mask rows for every voxel of masks whose fill value is not 0; other masks stay sparse."""
    filled = masks.where(F.col("fill_value") != 0).join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id")
    rows = filled.select("mask_id", "fill_value", "nx", "ny", F.explode(F.expr("sequence(0, nz - 1)")).alias("z"))
    rows = rows.withColumn("y", F.explode(F.expr("sequence(0, ny - 1)")))
    rows = spread_out(rows, "mask_id", "z", "y", per_task=1024)
    rows = rows.select("mask_id", "z", "y", F.explode(F.expr("sequence(0, nx - 1)")).alias("x"), "fill_value")
    return mask.join(rows, ["mask_id", "z", "y", "x"], "full_outer").select(
        "mask_id", "z", "y", "x", F.coalesce("class_id", "fill_value").cast("int").alias("class_id"))


def rle_label(rows: DataFrame, keys: Sequence[str], pos: str, value: str, block: int = SCAN_BLOCK) -> DataFrame:
    """(value, length) runs of a dense sequence of labels: (keys, st, value, len)."""
    keys = list(keys)
    flagged = scan(rows.select(*keys, F.col(pos).alias("_p"), F.col(value).alias("_v")), keys, "_p",
                   lags={"_before": F.col("_v")}, block=block)
    starts = flagged.where(F.col("_before").isNull() | (F.col("_before") != F.col("_v")))
    starts = stage(starts.select(*keys, F.col("_p").alias("st"), F.col("_v").alias("value")))
    sizes = stage(rows.groupBy(*keys).agg((F.max(pos) + 1).alias("_all")))
    # The next start is the previous one when positions are read backwards.
    turned = attach(starts, sizes, keys, ["st"])
    turned = turned.withColumn("_back", F.col("_all") - F.col("st"))
    ended = scan(turned, keys, "_back", lags={"_next": F.col("st")}, block=block)
    return ended.select(*keys, "st", "value", (F.coalesce("_next", "_all") - F.col("st")).alias("len"))


def pack_tiles(runs: DataFrame) -> DataFrame:
    """One row per tile with its run arrays; a tile holds at most size_z * size_y * size_x runs."""
    tile = ["mask_id", "cz", "cy", "cx", "size_z", "size_y", "size_x"]
    packed = runs.groupBy(*tile).agg(
        F.array_sort(F.collect_list(F.struct("run_no", "value", "len"))).alias("_r"),
        F.sum("len").alias("total_voxels"),
        F.sum(F.when(F.col("value") != 0, F.col("len")).otherwise(0)).alias("nonzero_voxels"))
    return packed.select(*tile, "total_voxels", "nonzero_voxels",
                         F.col("_r.value").alias("values"), F.col("_r.len").alias("lengths"))


def tiles_restore(tiles: DataFrame, masks: DataFrame, volumes: DataFrame, chunk: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Mask rows of packed tiles and the refused tiles; a ``chunk`` column of the tiles wins over the argument.

    Runs must add up to total_voxels, and that to the product of the tile's size. Zeros and voxels outside
    the grid are left out; runs without length are skipped.
    """
    tile = ["mask_id", "cz", "cy", "cx"]
    cs = F.col("_cs")
    side = F.greatest(F.lit(MIN_TILE), F.floor("chunk")) if "chunk" in tiles.columns else F.lit(max(MIN_TILE, int(chunk)))
    tiles = tiles.withColumn("_cs", side.cast("int"))
    head = [*tile, "_cs", "size_z", "size_y", "size_x", "total_voxels"]
    n = F.least(F.size("values"), F.size("lengths"))
    pairs = F.slice(F.arrays_zip("values", "lengths"), F.lit(1), n)
    runs = tiles.select(*head, F.posexplode_outer(pairs).alias("_i", "_r")).select(
        *head, "_i", F.greatest(F.lit(0), F.floor(F.coalesce("_r.values", F.lit(0)))).cast("int").alias("value"),
        F.greatest(F.lit(0), F.floor(F.coalesce("_r.lengths", F.lit(0)))).cast("bigint").alias("len"))
    order = W.partitionBy(*tile).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*tile)
    runs = runs.withColumn("_end", F.sum("len").over(order))
    reached = F.max((F.col("_end") == F.col("total_voxels")).cast("int")).over(whole)
    product = F.col("size_z").cast("bigint") * F.col("size_y") * F.col("size_x")
    runs = runs.withColumn("_ok", ((reached == 1) | (F.col("total_voxels") == 0)) & (product == F.col("total_voxels")))
    refused = runs.where(~F.col("_ok")).groupBy(*tile).agg(
        F.max("total_voxels").alias("total_voxels"), F.max("_end").alias("run_sum"), F.max(product).alias("expected"))
    good = runs.where(F.col("_ok") & (F.col("value") != 0) & (F.col("len") > 0) & (F.col("_end") <= F.col("total_voxels")))
    cells = good.withColumn("_p", F.explode(F.expr("sequence(_end - len, _end - 1)")))
    cells = cells.select(
        "mask_id", "value",
        (F.col("cz") * cs + F.expr("_p div (size_x * size_y)")).cast("int").alias("z"),
        (F.col("cy") * cs + F.expr("(_p div size_x) % size_y")).cast("int").alias("y"),
        (F.col("cx") * cs + F.expr("_p % size_x")).cast("int").alias("x"))
    grids = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select("mask_id", "nx", "ny", "nz")
    inside = attach(cells, grids, ["mask_id"], ["z", "y", "x"]).where(
        F.col("z").between(0, F.col("nz") - 1) & F.col("y").between(0, F.col("ny") - 1) & F.col("x").between(0, F.col("nx") - 1))
    return inside.select("mask_id", "z", "y", "x", F.col("value").alias("class_id")), refused


def positions_to_voxels(positions: DataFrame, masks: DataFrame, volumes: DataFrame) -> DataFrame:
    grids = masks.join(volumes.select("volume_id", "nx", "ny"), "volume_id").select("mask_id", "nx", "ny")
    return coords_of_linear(attach(positions, grids, ["mask_id"], ["linear"])).drop("nx", "ny")


def check_total(headers: DataFrame, volumes: DataFrame) -> DataFrame:
    """Headers whose declared total differs from the grid's voxel count."""
    grid = volumes.select("volume_id", (dbl("nx") * dbl("ny") * dbl("nz")).cast("bigint").alias("_all"))
    return headers.join(grid, "volume_id").where(F.col("total_voxels") != F.col("_all")).drop("_all")
