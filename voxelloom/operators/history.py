"""Command logs in which do, undo and redo are mixed: what each command acts on, and the mask that results.

Rows are (mask_id, seq, kind), ``kind`` one of do, undo, redo. A new operation empties what can be redone; with a
``depth`` the oldest operation can no longer be undone once there are more. Every ``do`` counts as an operation that
changes something, so merge strokes and drop empty ones first (``edits.merge_strokes``).

State after a command is two numbers: how many operations can be undone, d, and how many of these and the undone ones
there are, t; an undo lowers d down to 0, a redo raises it up to t, a do sets t to d + 1. Up to its first do a block of
commands walks between fixed barriers, so its effect is a clamped shift for each t; from then on it depends on d alone.
Both are tabulated for all starting numbers at once, so blocks are summed up in parallel; a scan over one row per
block gives each its start, and blocks are replayed in parallel. No task sees a whole log.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..model import MASK_KEY
from ..scale import ORDER_BLOCK, SCAN_BLOCK, scan, stage, with_order
from .mask import Written, set_voxels

BLOCK = 8192
DO, UNDO, REDO = 1, -1, 0
CODES = {"do": DO, "undo": UNDO, "redo": REDO}
_LISTS = ("shift", "low", "high", "d", "t", "dropped")
_SUMMARY = "mask_id string, blk bigint, has_do boolean, " + ", ".join(f"{c} array<int>" for c in _LISTS)


def summary(codes: np.ndarray, depth: int | None) -> dict[str, np.ndarray | bool]:
    """Effect of a block of commands for every start.

    ``shift``, ``low`` and ``high``, by t: before the first do, d becomes clamp(d + shift, low, high). ``d``, ``t`` and
    ``dropped`` by the d that the first do finds. Without a depth the last entry stands for all greater numbers, of which
    the barriers are out of reach: entries then grow with the start.
    """
    dos = np.flatnonzero(codes == DO)
    first = int(dos[0]) if len(dos) else len(codes)
    # A barrier further away than a block has steps towards it is out of reach.
    most = max(first, int((codes == UNDO).sum())) + 1 if depth is None else depth
    t = np.arange(most + 1, dtype=np.int64)
    shift, low, high = np.zeros_like(t), np.zeros_like(t), t.copy()
    for code in codes[:first].tolist():
        step = -1 if code == UNDO else 1
        shift += step
        low, high = np.clip(low + step, 0, t), np.clip(high + step, 0, t)
    d, top, dropped = t.copy(), t.copy(), np.zeros_like(t)
    for code in codes[first:].tolist():
        if code == DO:
            d = d + 1
            if depth is not None:
                over = d > depth
                d, dropped = np.where(over, depth, d), dropped + over
            top = d
        elif code == UNDO:
            d = np.maximum(d - 1, 0)
        else:
            d = np.minimum(d + 1, top)
    out = {"shift": shift, "low": low, "high": high, "d": d, "t": top, "dropped": dropped}
    if depth is None:
        for some, slopes in ((("shift", "low", "high"), (0, 0, 1)), (("d", "t", "dropped"), (1, 1, 0))):
            bent = [np.flatnonzero(np.diff(out[c]) != slope) for c, slope in zip(some, slopes)]
            keep = max((int(b[-1]) + 2 for b in bent if len(b)), default=1)
            out.update({c: out[c][:keep] for c in some})
    return {**out, "has_do": bool(len(dos))}


def after(block: dict, d: int, t: int, dropped: int) -> tuple[int, int, int]:
    """State behind a block that starts at (d, t, dropped)."""
    def at(name: str, i: int, slope: int = 0) -> int:
        last = len(block[name]) - 1
        return int(block[name][min(i, last)]) + slope * max(0, i - last)
    d = min(max(d + at("shift", t), at("low", t)), at("high", t, 1))
    return (at("d", d, 1), at("t", d, 1), dropped + at("dropped", d)) if block["has_do"] else (d, t, dropped)


def _summaries(depth: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = summary(part.sort_values("_pos")["code"].to_numpy(np.int64), depth)
        return pd.DataFrame({"mask_id": [part["mask_id"].iloc[0]], "blk": [part["blk"].iloc[0]], "has_do": [found["has_do"]],
                             **{c: [found[c].astype(np.int32)] for c in _LISTS}})
    return run


def _starts(parts: pd.DataFrame) -> pd.DataFrame:
    """The state before each block; one row per block of a mask."""
    rows, state = [], (0, 0, 0)
    for block in parts.sort_values("blk").to_dict("records"):
        rows.append((block["mask_id"], block["blk"], *state))
        state = after(block, *state)
    return pd.DataFrame(rows, columns=["mask_id", "blk", "d", "t", "dropped"])


def _replay(depth: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        d, t, dropped = (int(part[c].iloc[0]) for c in ("d", "t", "dropped"))
        levels = []
        for code in part["code"].tolist():
            if code == DO:
                d += 1
                if depth is not None and d > depth:
                    d, dropped = depth, dropped + 1
                t = d
                levels.append(dropped + d)
            elif code == UNDO:
                levels.append(dropped + d if d else None)
                d = max(d - 1, 0)
            else:
                levels.append(dropped + d + 1 if d < t else None)
                d = min(d + 1, t)
        return pd.DataFrame({"mask_id": part["mask_id"], "seq": part["seq"], "_pos": part["_pos"], "code": part["code"],
                             "level": pd.array(levels, dtype="Int64")})
    return run


def match(commands: DataFrame, depth: int | None = None, block: int = BLOCK) -> DataFrame:
    """(mask_id, seq, kind, level, op_seq) of every command.

    ``op_seq`` is the ``seq`` of the operation that it does, takes back or repeats, ``level`` its place in the history counted
    from the first; both are null for an undo or redo that finds nothing.
    """
    code = F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in CODES.items()]).alias("code")
    ordered = with_order(commands.select("mask_id", "seq", code).where("code is not null"), ["mask_id", "seq"], "_at")
    one = F.lit(1).cast("bigint")
    rows = stage(scan(ordered, ["mask_id"], "_at", {"_pos": one}, block=ORDER_BLOCK).drop("_at").withColumn(
        "blk", F.floor(F.col("_pos") / block)))
    key = ["mask_id", "blk"]
    sums = rows.groupBy(*key).applyInPandas(_summaries(depth), _SUMMARY)
    starts = stage(sums.groupBy("mask_id").applyInPandas(_starts, "mask_id string, blk bigint, d bigint, t bigint, dropped bigint"))
    played = rows.join(starts, key).groupBy(*key).applyInPandas(
        _replay(depth), "mask_id string, seq bigint, _pos bigint, code int, level bigint")
    # The operation at a level is the last one done there: the do's of a level are numbered, a command takes the latest.
    done = F.when(F.col("code") == DO, 1).otherwise(0).cast("bigint")
    hit = stage(scan(stage(played.where("level is not null")), ["mask_id", "level"], "_pos", {"_nth": done}, block=SCAN_BLOCK))
    dos = hit.where(F.col("code") == DO).select("mask_id", "level", "_nth", F.col("seq").alias("op_seq"))
    found = hit.join(dos, ["mask_id", "level", "_nth"]).select("mask_id", "seq", "level", "op_seq")
    return commands.select("mask_id", "seq", "kind").join(found, ["mask_id", "seq"], "left").select(
        "mask_id", "seq", "kind", "level", "op_seq")


def live(matched: DataFrame) -> DataFrame:
    """(mask_id, op_seq) of the operations in effect at the end: those whose last command is no undo."""
    last = matched.where("op_seq is not null").groupBy("mask_id", "op_seq").agg(F.max_by("kind", "seq").alias("_last"))
    return last.where(F.col("_last") != "undo").select("mask_id", "op_seq")


def replay(commands: DataFrame, changes: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame,
           depth: int | None = None, block: int = BLOCK) -> Written:
    """The mask after a command log; ``changes`` (mask_id, op_seq, z, y, x, after_class) are what its operations write.

    Only operations in effect write; a voxel takes the latest of them.
    """
    ops = stage(live(match(commands, depth, block)))
    writes = changes.join(ops, ["mask_id", "op_seq"], "left_semi")
    return set_voxels(mask, masks, volumes, writes.select(
        *MASK_KEY, F.col("op_seq").alias("seq"), F.col("after_class").alias("class_id")))
