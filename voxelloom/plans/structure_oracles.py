"""SQL of the queries in ``structure_queries``."""

from __future__ import annotations

from . import source_oracles  # noqa: F401  the SQL that some queries share
from .oracles import ORACLES, oracle

oracle("volume_source", "vox", """SELECT volume_id, z, y, x, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM vox
  WHERE volume_id = 'events' AND z BETWEEN 3 AND 9 AND x < 15 OR volume_id = 'orders' AND z IN (0, 2, 3) AND y >= 10""")


def _history(depth: int | None, rest: str) -> str:
    most = depth or 1 << 40
    turn = "event_id * 7919 // 37 % 10"
    return f"""
WITH RECURSIVE cmd AS MATERIALIZED (
  SELECT event_id % 16 AS m, event_id // 16 AS pos, event_id AS seq,
         CASE WHEN {turn} < 5 THEN 'do' WHEN {turn} < 8 THEN 'undo' ELSE 'redo' END AS kind FROM events),
walk AS (
  SELECT m, -1::BIGINT AS pos, NULL::BIGINT AS seq, '' AS kind, 0::BIGINT AS d, 0::BIGINT AS t, 0::BIGINT AS gone, []::BIGINT[] AS stack,
         NULL::BIGINT AS level, NULL::BIGINT AS op_seq FROM cmd GROUP BY m
  UNION ALL
  SELECT w.m, c.pos, c.seq, c.kind,
         CASE c.kind WHEN 'do' THEN least(d + 1, {most}) WHEN 'undo' THEN greatest(d - 1, 0) ELSE least(d + 1, t) END,
         CASE c.kind WHEN 'do' THEN least(d + 1, {most}) ELSE t END,
         gone + CASE WHEN c.kind = 'do' AND d = {most} THEN 1 ELSE 0 END,
         CASE c.kind WHEN 'do' THEN list_concat(stack[CASE WHEN d = {most} THEN 2 ELSE 1 END:d], [c.seq]) ELSE stack END,
         CASE WHEN c.kind = 'do' THEN gone + d + 1 WHEN c.kind = 'undo' AND d > 0 THEN gone + d WHEN c.kind = 'redo' AND d < t THEN gone + d + 1 END,
         CASE WHEN c.kind = 'do' THEN c.seq WHEN c.kind = 'undo' AND d > 0 THEN stack[d] WHEN c.kind = 'redo' AND d < t THEN stack[d + 1] END
  FROM walk w JOIN cmd c ON c.m = w.m AND c.pos = w.pos + 1)
{rest}"""


ORACLES["history_match"] = _history(20, "SELECT 'm_' || m AS mask_id, seq, kind, level, op_seq FROM walk WHERE pos >= 0")
ORACLES["history_mask"] = _history(None, """, ops AS (
  SELECT m, op_seq FROM walk WHERE op_seq IS NOT NULL GROUP BY ALL HAVING arg_max(kind, seq) <> 'undo'),
last AS (
  SELECT m, (event_id * 7919) % 500 AS lin, arg_max(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
         WHEN 'signup' THEN 4 ELSE 0 END, event_id) AS c FROM ops JOIN events ON event_id = op_seq GROUP BY ALL)
SELECT 'm_' || m AS mask_id, 0 AS z, CAST(lin // 20 AS INT) AS y, CAST(lin % 20 AS INT) AS x, c AS class_id FROM last WHERE c <> 0""")

# ---- brick tree ------------------------------------------------------------------------------

CODE = " + ".join(f"((({c} >> {i}) & 1) << {3 * i + k})" for i in range(16) for k, c in enumerate(("x // 8", "y // 8", "z // 8")))
oracle("tree_levels", "vox", f""", b AS MATERIALIZED (
  SELECT volume_id, CAST({CODE} AS BIGINT) AS code, MIN(v) AS lo, MAX(v) AS hi, greatest(MAX(x), MAX(y), MAX(z)) // 8 AS far FROM vox GROUP BY 1, 2),
l AS (SELECT UNNEST(range(17)) AS level)
SELECT volume_id, CAST(level AS INT) AS level, code >> CAST(3 * level AS BIGINT) AS code, CAST(MIN(lo) AS DOUBLE) AS vmin, CAST(MAX(hi) AS DOUBLE) AS vmax,
       COUNT(*) AS bricks FROM b, l WHERE level = 0 OR (SELECT MAX(far) FROM b) >= 1 << (level - 1) GROUP BY 1, 2, 3""")
ORACLES["project_visible_tree"] = ORACLES["project_visible"].replace(
    "THEN v END), 0) AS v", "THEN CAST(v AS DOUBLE) END), 0) AS v")
oracle("threshold_tree", "vox", "SELECT volume_id, z, y, x, CAST(v AS DOUBLE) AS v FROM vox WHERE v BETWEEN 49000 AND 1000000")

# ---- streams ---------------------------------------------------------------------------------

ORACLES["stream_voxel_state"] = ORACLES["stream_edits_on_mask"]
ORACLES["stream_voxel_stats"] = ORACLES["stream_stats"]

# ---- co-located bricks, merged rays, run sets ------------------------------------------------

ORACLES["roi_stats_colocated"] = ORACLES["roi_stats"]
ORACLES["composite_bricks"] = ORACLES["composite_z"]
for _name, _holds in (("union", "a OR b"), ("difference", "a AND NOT b"), ("intersection", "a AND b")):
    oracle(f"runs_{_name}", "vox dense", f""", m AS (
  SELECT d.mask_id, d.lin, d.class_id = 1 AS a, v > 5000 AS b FROM dense d JOIN vox ON vox.volume_id = d.volume_id AND vox.lin = d.lin),
r AS (SELECT mask_id, lin, lin - ROW_NUMBER() OVER (PARTITION BY mask_id ORDER BY lin) AS grp FROM m WHERE {_holds})
SELECT mask_id, MIN(lin) AS st, COUNT(*) AS len FROM r GROUP BY mask_id, grp""")
ORACLES["rect_range_indexed"] = ORACLES["rect_range"]

# ---- sketches, pyramid upkeep ----------------------------------------------------------------

ORACLES["percentiles_sketched"] = ORACLES["percentiles"]
ORACLES["percentiles_brick_range"] = ORACLES["percentiles"].replace("FROM vox GROUP BY 1", "FROM vox WHERE z < 16 AND y BETWEEN 8 AND 23 GROUP BY 1")
ORACLES["pyramid_upkeep"] = ORACLES["pyramid"].replace("WITH vox AS (", "WITH vox0 AS (", 1).replace(",\nvol AS (", """,
chg AS (
  SELECT 'events' AS volume_id, event_id % 3 AS z, event_id % 7 AS y, event_id // 7 % 23 AS x, arg_max(event_id, (event_id % 2, event_id)) AS n
  FROM events GROUP BY ALL),
vox AS (SELECT o.volume_id, o.z, o.y, o.x, COALESCE(CAST(n AS DOUBLE), CAST(v AS DOUBLE)) AS v FROM vox0 o LEFT JOIN chg USING (volume_id, z, y, x)),
vol AS (""", 1)
