"""The registered queries in plain SQL over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

CTES = {
    "vox": """
  SELECT 'events' AS volume_id, CAST(event_id // 500 AS INT) AS z, CAST((event_id // 20) % 25 AS INT) AS y,
         CAST(event_id % 20 AS INT) AS x, CAST(ROUND(value * 100) AS INT) AS v, event_id AS lin FROM events
  UNION ALL
  SELECT 'orders', CAST(o_orderkey // 1500 AS INT), CAST((o_orderkey // 30) % 50 AS INT),
         CAST(o_orderkey % 30 AS INT), CAST(ROUND(o_totalprice * 100) AS INT), o_orderkey FROM orders""",
    "vol": """
  SELECT 'events' AS volume_id, 20 AS nx, 25 AS ny, CAST(COUNT(*) // 500 AS INT) AS nz,
         CAST(MIN(CAST(ROUND(value * 100) AS INT)) AS DOUBLE) AS vmin, CAST(MAX(CAST(ROUND(value * 100) AS INT)) AS DOUBLE) AS vmax FROM events
  UNION ALL
  SELECT 'orders', 30, 50, CAST(COUNT(*) // 1500 AS INT), CAST(MIN(CAST(ROUND(o_totalprice * 100) AS INT)) AS DOUBLE),
         CAST(MAX(CAST(ROUND(o_totalprice * 100) AS INT)) AS DOUBLE) FROM orders""",
    "dense": """
  SELECT 'm_type' AS mask_id, 'events' AS volume_id, CAST(event_id // 500 AS INT) AS z, CAST((event_id // 20) % 25 AS INT) AS y,
         CAST(event_id % 20 AS INT) AS x, event_id AS lin,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS class_id FROM events
  UNION ALL
  SELECT 'm_prio', 'orders', CAST(o_orderkey // 1500 AS INT), CAST((o_orderkey // 30) % 50 AS INT),
         CAST(o_orderkey % 30 AS INT), o_orderkey, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) % 5 FROM orders""",
    "roi": """
  SELECT DISTINCT mask_id, 'roi-' || class_id AS roi_id, class_id, 'ROI ' || class_id AS name,
         CASE class_id WHEN 1 THEN '#ff4d4f' WHEN 2 THEN '#ff9f1a' WHEN 3 THEN '#ffd60a' ELSE '#52c41a' END AS color_hex,
         class_id <> 3 AS visible, class_id = 2 AS locked, class_id AS ordinal FROM dense WHERE class_id <> 0""",
    "pts": """
  SELECT c_custkey AS point_id, 'm_type' AS mask_id, 'events' AS volume_id, CAST(c_nationkey AS INT) AS z,
         CAST((c_custkey // 23) % 27 - 1 AS INT) AS y, CAST(c_custkey % 23 - 1 AS INT) AS x FROM customer""",
    "smp": """
  SELECT p_partkey AS sample_id, 'orders' AS volume_id, CAST(p_size - 1 AS INT) AS idx,
         CAST(p_partkey % 331 AS DOUBLE) / 10 - 1 AS px, CAST(p_partkey % 523 AS DOUBLE) / 10 - 1 AS py FROM part""",
    # D1 corners of 4 x 4 x 4 blocks
    "low": """
  SELECT volume_id, z // 4 AS z, y // 4 AS y, x // 4 AS x, AVG(CAST(v AS DOUBLE)) AS v FROM vox JOIN vol USING (volume_id)
  WHERE (x % 4 IN (0, 3) OR x = nx - 1) AND (y % 4 IN (0, 3) OR y = ny - 1) AND (z % 4 IN (0, 3) OR z = nz - 1)
  GROUP BY 1, 2, 3, 4""",
    # voxels touched by brush strokes, and the mask after all of them
    "stroke": """
  SELECT c_custkey AS seq, c_custkey % 3 AS ax, CAST(c_nationkey AS INT) AS idx, CAST(c_custkey % 33 AS INT) AS cu,
         CAST((c_custkey // 7) % 29 AS INT) AS cv, GREATEST(1, c_nationkey % 4) AS r, CAST(c_custkey % 5 AS INT) AS after_class,
         CAST(c_custkey % 2 AS INT) AS sr FROM customer""",
    "stamp": """
  SELECT 'm_type' AS mask_id, seq, z, y, x, after_class FROM (
    SELECT seq, after_class,
           CASE ax WHEN 0 THEN f ELSE v END AS z, CASE ax WHEN 0 THEN v WHEN 1 THEN f ELSE u END AS y,
           CASE ax WHEN 2 THEN f ELSE u END AS x
    FROM (SELECT seq, ax, after_class, idx + ds.i AS f, cu + du.i AS u, cv + dv.i AS v
          FROM stroke, (SELECT CAST(UNNEST(RANGE(-1, 2)) AS INT) i) ds, (SELECT CAST(UNNEST(RANGE(-3, 4)) AS INT) i) du,
               (SELECT CAST(UNNEST(RANGE(-3, 4)) AS INT) i) dv
          WHERE ABS(ds.i) <= sr AND du.i * du.i + dv.i * dv.i <= r * r)) q
  JOIN vol ON volume_id = 'events' WHERE x BETWEEN 0 AND nx - 1 AND y BETWEEN 0 AND ny - 1 AND z BETWEEN 0 AND nz - 1""",
    "painted": """
  SELECT d.mask_id, d.volume_id, d.z, d.y, d.x, d.class_id AS before_class, COALESCE(s.a, d.class_id) AS class_id
  FROM dense d LEFT JOIN (SELECT mask_id, z, y, x, MAX_BY(after_class, seq) a FROM stamp GROUP BY ALL) s
    ON d.mask_id = s.mask_id AND d.z = s.z AND d.y = s.y AND d.x = s.x""",
    "elog": """
  SELECT event_id AS seq, event_id // 4 AS op_id,
         CASE WHEN (event_id // 4) % 7 = 0 THEN NULL ELSE 'k' || (event_id // 12) END AS mk, (event_id * 7919) % 500 AS lin,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS a FROM events""",
    "chg": """
  SELECT * FROM (SELECT *, COALESCE(LAG(a) OVER (PARTITION BY lin ORDER BY seq), 0) AS b FROM elog) WHERE a <> b""",
    "ops": """
  SELECT op_id, SUM(CASE WHEN mk = pk THEN 0 ELSE 1 END) OVER (ORDER BY op_id) AS stroke
  FROM (SELECT op_id, mk, LAG(mk) OVER (ORDER BY op_id) pk FROM (SELECT DISTINCT op_id, mk FROM chg))""",
    "strk": """
  SELECT stroke, lin, MIN_BY(b, seq) AS b, MAX_BY(a, seq) AS a, MIN(seq) AS s0, MAX(seq) AS s1
  FROM chg JOIN ops USING (op_id) GROUP BY stroke, lin""",
    # histogram of every xy slice, and the three-class split
    "h": """
  SELECT volume_id, z, lo, hi, CAST(FLOOR((v - lo) * (CAST(255 AS DOUBLE) / (hi - lo))) AS INT) AS b, COUNT(*) AS n
  FROM vox JOIN (SELECT volume_id, z, CAST(MIN(v) AS DOUBLE) lo, CAST(MAX(v) AS DOUBLE) hi FROM vox GROUP BY ALL) USING (volume_id, z)
  WHERE hi > lo GROUP BY ALL""",
    "hk": """
  SELECT volume_id, z, lo, hi, b, CAST(SUM(n) OVER w AS DOUBLE) / SUM(n) OVER p AS w, CAST(SUM(b * n) OVER w AS DOUBLE) / SUM(n) OVER p AS m,
         CAST(SUM(b * n) OVER p AS DOUBLE) / SUM(n) OVER p AS mt
  FROM h WINDOW p AS (PARTITION BY volume_id, z), w AS (PARTITION BY volume_id, z ORDER BY b)""",
    "split": """
  SELECT volume_id, z, t1, t2, lo + CAST(t1 + 1 AS DOUBLE) / 256 * (hi - lo) AS lower, lo + CAST(t2 + 1 AS DOUBLE) / 256 * (hi - lo) AS upper
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id, z ORDER BY ROUND(score, 9) DESC, t1, t2) rn FROM (
    SELECT a.volume_id, a.z, a.lo, a.hi, a.b t1, c.b t2, a.w * POWER(a.m / a.w - a.mt, 2)
      + (c.w - a.w) * POWER((c.m - a.m) / (c.w - a.w) - a.mt, 2) + (1 - c.w) * POWER((a.mt - c.m) / (1 - c.w) - a.mt, 2) score
    FROM hk a JOIN hk c ON a.volume_id = c.volume_id AND a.z = c.z AND a.b < c.b
    WHERE a.w > 1e-8 AND c.w - a.w > 1e-8 AND 1 - c.w > 1e-8)) WHERE rn = 1""",
    "win": """
  SELECT q.volume_id, q.z, lower IS NOT NULL AS found,
         CASE WHEN lower IS NULL THEN p01 ELSE lo END lo_0, CASE WHEN lower IS NULL THEN p80 ELSE lower + ov END hi_0,
         CASE WHEN lower IS NULL THEN p20 ELSE lower - ov END lo_1, CASE WHEN lower IS NULL THEN p80 ELSE upper + ov END hi_1,
         CASE WHEN lower IS NULL THEN p50 ELSE upper - ov END lo_2, CASE WHEN lower IS NULL THEN p99 ELSE hi END hi_2
  FROM (SELECT volume_id, z, CAST(MIN(v) AS DOUBLE) lo, CAST(MAX(v) AS DOUBLE) hi,
               CAST(0.05 AS DOUBLE) * GREATEST(CAST(1e-6 AS DOUBLE), CAST(MAX(v) - MIN(v) AS DOUBLE)) ov,
               QUANTILE_CONT(v, 0.01) p01, QUANTILE_CONT(v, 0.2) p20, QUANTILE_CONT(v, 0.5) p50, QUANTILE_CONT(v, 0.8) p80,
               QUANTILE_CONT(v, 0.99) p99 FROM vox GROUP BY ALL) q
  LEFT JOIN split s ON q.volume_id = s.volume_id AND q.z = s.z""",
    # Grayscale ramp: linear between its stops, 256 entries
    "ramp": """
  SELECT i, CAST(FLOOR(c0 + (c1 - c0) * (t - p0) / (p1 - p0) + 0.5) AS INT) AS c, CAST(FLOOR(a0 + (a1 - a0) * (t - p0) / (p1 - p0) + 0.5) AS INT) AS a
  FROM (SELECT i, CAST(i AS DOUBLE) / 255 t FROM (SELECT CAST(UNNEST(RANGE(256)) AS INT) i)) JOIN (VALUES
    (CAST(0 AS DOUBLE), CAST(0.1 AS DOUBLE), 0, 25, 0, 10), (0.1, 0.5, 25, 128, 10, 128), (0.5, 1.0, 128, 255, 128, 255)) s(p0, p1, c0, c1, a0, a1)
    ON t BETWEEN p0 AND p1 QUALIFY ROW_NUMBER() OVER (PARTITION BY i ORDER BY p0) = 1""",
    "lit": """
  SELECT volume_id, z, y, x, (c0.c * (1 - f) + c1.c * f) / 255 AS c, (c0.a * (1 - f) + c1.a * f) / 255 AS a
  FROM (SELECT volume_id, z, y, x, t - FLOOR(t) f, GREATEST(0, CAST(FLOOR(t) AS INT)) i0, LEAST(255, CAST(FLOOR(t) AS INT) + 1) i1
        FROM (SELECT *, LEAST(CAST(1 AS DOUBLE), CAST(v AS DOUBLE) / 50000) * 256 - CAST(0.5 AS DOUBLE) t FROM vox))
  JOIN ramp c0 ON c0.i = i0 JOIN ramp c1 ON c1.i = i1""",
    "comp": """
  SELECT volume_id, y, x, SUM(tr * a * c) AS c, SUM(tr * a) AS alpha FROM (
    SELECT *, CASE WHEN COALESCE(MAX(a) OVER f, 0) >= 1 THEN 0 ELSE
      EXP(COALESCE(SUM(CASE WHEN a < 1 THEN LN(1 - a) ELSE 0 END) OVER f, 0)) END tr
    FROM lit WINDOW f AS (PARTITION BY volume_id, y, x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE 1 - tr < 0.95 GROUP BY ALL""",
    "pal": """
  SELECT mask_id, class_id, r, g, b, a FROM roi JOIN (VALUES
    (1, CAST(255 AS DOUBLE) / 255, CAST(77 AS DOUBLE) / 255, CAST(79 AS DOUBLE) / 255), (2, CAST(255 AS DOUBLE) / 255, CAST(159 AS DOUBLE) / 255, CAST(26 AS DOUBLE) / 255),
    (3, CAST(255 AS DOUBLE) / 255, CAST(214 AS DOUBLE) / 255, CAST(10 AS DOUBLE) / 255), (4, CAST(82 AS DOUBLE) / 255, CAST(196 AS DOUBLE) / 255, CAST(26 AS DOUBLE) / 255))
    k(class_id, r, g, b) USING (class_id), LATERAL (SELECT CASE WHEN visible THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END a)""",
    "coarse": """
  SELECT volume_id, nx, ny, nz, CAST(CEIL(nx / 3.0) AS INT) tx, CAST(CEIL(ny / 4.0) AS INT) ty, CAST(CEIL(nz / 2.0) AS INT) tz FROM vol""",
    # runs of every wanted class by a dense scan
    "marks": """
  SELECT k.mask_id, k.class_id, d.lin, CASE WHEN d.class_id = k.class_id THEN 1 ELSE 0 END AS bit
  FROM dense d JOIN (SELECT mask_id, UNNEST([0, 1, 2, 3, 4, 9]) AS class_id FROM (SELECT DISTINCT mask_id FROM dense)) k USING (mask_id)""",
    "runs": """
  SELECT mask_id, class_id, bit, MIN(lin) AS st, COUNT(*) AS len, ROW_NUMBER() OVER (PARTITION BY mask_id, class_id ORDER BY MIN(lin)) AS run_no
  FROM (SELECT *, SUM(CASE WHEN bit = pb THEN 0 ELSE 1 END) OVER (PARTITION BY mask_id, class_id ORDER BY lin) gr
        FROM (SELECT *, LAG(bit) OVER (PARTITION BY mask_id, class_id ORDER BY lin) pb FROM marks))
  GROUP BY mask_id, class_id, bit, gr""",
}
RECURSIVE = "WITH RECURSIVE "


def _sql(uses: str, body: str, recursive: bool = False) -> str:
    names = uses.split()
    if not names:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body


def oracle(name: str, uses: str, body: str) -> None:
    ORACLES[name] = _sql(uses, body)


SIZE_MB = "ROUND(CAST(CAST(nx AS BIGINT) * ny * nz * 2 AS DOUBLE) / 1048576, 2)"
oracle("volume_info", "vol", f"""SELECT volume_id, nx, ny, nz, 'uint16' AS data_type, CAST(0.5 AS DOUBLE) AS sx, CAST(0.5 AS DOUBLE) AS sy,
  CAST(2.0 AS DOUBLE) AS sz, vmin, vmax, CAST(nx AS BIGINT) * ny * nz AS total_voxels, CAST(nx AS BIGINT) * ny * nz * 2 AS total_bytes,
  {SIZE_MB} AS size_mb, nz = 1 AS single_slice FROM vol""")
oracle("min_max", "vox", "SELECT volume_id, CAST(MIN(v) AS DOUBLE) AS vmin, CAST(MAX(v) AS DOUBLE) AS vmax FROM vox GROUP BY 1")
oracle("with_range", "vol", """SELECT volume_id, CASE volume_id WHEN 'events' THEN CAST(5 AS DOUBLE) ELSE vmin END AS vmin,
  CASE volume_id WHEN 'events' THEN CAST(7000 AS DOUBLE) ELSE vmax END AS vmax FROM vol""")
oracle("slice_bounds", "vol", """SELECT volume_id, 'xy' AS axis, nz AS slices, nz // 2 AS center, nz - 1 AS last FROM vol
  UNION ALL SELECT volume_id, 'xz', ny, ny // 2, ny - 1 FROM vol UNION ALL SELECT volume_id, 'yz', nx, nx // 2, nx - 1 FROM vol""")
oracle("slice_range", "vol", """SELECT volume_id, axis, CAST(n // 2 + d AS INT) AS idx FROM (SELECT volume_id, 'xy' AS axis, nz AS n FROM vol
  UNION ALL SELECT volume_id, 'xz', ny FROM vol UNION ALL SELECT volume_id, 'yz', nx FROM vol), (SELECT UNNEST(RANGE(-3, 4)) d)
  WHERE n // 2 + d BETWEEN 0 AND n - 1""")
oracle("value_at", "vox pts", """SELECT point_id, p.volume_id, p.z, p.y, p.x, v FROM pts p
  LEFT JOIN vox USING (volume_id, z, y, x)""")
oracle("value_at_lowres", "vox vol low pts", """SELECT point_id, p.volume_id, p.z, p.y, p.x, ROUND(l.v, 6) AS v FROM pts p JOIN vol USING (volume_id)
  LEFT JOIN low l ON l.volume_id = p.volume_id AND p.x BETWEEN 0 AND nx - 1 AND p.y BETWEEN 0 AND ny - 1 AND p.z BETWEEN 0 AND nz - 1
    AND l.x = p.x // 4 AND l.y = LEAST(CEIL(ny / 4.0) - 1, p.y // 4) AND l.z = LEAST(CEIL(nz / 4.0) - 1, p.z // 4)""")
oracle("probe_points", "vox dense pts", """SELECT point_id, p.mask_id, p.z, p.y, p.x, CAST(v AS BIGINT) AS value, COALESCE(class_id, 0) AS class_id FROM pts p
  LEFT JOIN vox ON vox.volume_id = p.volume_id AND vox.z = p.z AND vox.y = p.y AND vox.x = p.x
  LEFT JOIN dense d ON d.mask_id = p.mask_id AND d.z = p.z AND d.y = p.y AND d.x = p.x""")
oracle("pyramid_plan", "vol", """SELECT volume_id, level, factor, lnx, lny, lnz, bytes, fits, level = FIRST_VALUE(CASE WHEN fits THEN level END)
    OVER (PARTITION BY volume_id ORDER BY CASE WHEN fits THEN rank ELSE 9 END) AS chosen FROM (
  SELECT *, bytes <= 402653184 AND GREATEST(lnx, lny, lnz) <= 2048 AND (level <> 'mid' OR (nx > 1 AND ny > 1 AND nz > 1)) AS fits FROM (
    SELECT *, CAST(CEIL((CAST(lnx AS DOUBLE) * lny * lnz * 2 + CEIL(lnx / 8.0) * CEIL(lny / 8.0) * CEIL(lnz / 8.0) * 4) * CAST(1.15 AS DOUBLE)) AS BIGINT) AS bytes
    FROM (SELECT *, CAST(CEIL(nx / CAST(factor AS DOUBLE)) AS INT) lnx, CAST(CEIL(ny / CAST(factor AS DOUBLE)) AS INT) lny,
            CAST(CEIL(nz / CAST(factor AS DOUBLE)) AS INT) lnz
          FROM vol, (VALUES (0, 'low', 4), (1, 'mid', 2), (2, 'full', 1)) l(rank, level, factor))))""")
BRICKS = """SELECT volume_id, z // 8 AS bz, y // 8 AS "by", x // 8 AS bx, MIN(v) AS vmin, MAX(v) AS vmax, COUNT(*) AS n FROM vox GROUP BY 1, 2, 3, 4"""
oracle("brick_minmax", "vox", BRICKS)
oracle("bricks_hit", "vox", BRICKS + " HAVING MAX(v) >= 48000")

for _axis, _f, _v, _u, _n in (("xy", "z", "y", "x", "nz"), ("xz", "y", "z", "x", "ny"), ("yz", "x", "z", "y", "nx")):
    oracle(f"slice_{_axis}", "vox vol", f"""SELECT volume_id, '{_axis}' AS axis, vox.{_f} AS idx, vox.{_v} AS v, vox.{_u} AS u, vox.v AS value
      FROM vox JOIN vol USING (volume_id) WHERE vox.{_f} = {_n} // 2""")
oracle("lowres_slice", "vox vol low", """SELECT volume_id, 'xz' AS axis, ny // 2 AS idx, vox.z AS v, vox.x AS u, ROUND(low.v, 6) AS value FROM vox JOIN vol USING (volume_id)
  JOIN low USING (volume_id) WHERE vox.y = ny // 2
   AND low.x = LEAST(vox.x // CAST(FLOOR(nx / CEIL(nx / 4.0) + 0.5) AS INT), CEIL(nx / 4.0) - 1)
   AND low.y = LEAST((ny // 2) // CAST(FLOOR(nx / CEIL(nx / 4.0) + 0.5) AS INT), CEIL(ny / 4.0) - 1)
   AND low.z = LEAST(vox.z // CAST(FLOOR(nx / CEIL(nx / 4.0) + 0.5) AS INT), CEIL(nz / 4.0) - 1)""")
oracle("window_level", "vox vol", """SELECT volume_id, z, y, x, ROUND(t, 6) AS level, ROUND(POWER(t, CAST(2.2 AS DOUBLE)), 6) AS corrected FROM (
  SELECT volume_id, z, y, x, GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), (v - vmin) / GREATEST(vmax * CAST(0.5 AS DOUBLE) - vmin, CAST(0.001 AS DOUBLE)))) t
  FROM vox JOIN vol USING (volume_id))""")
oracle("bilinear_sample", "vox vol smp", """SELECT sample_id, volume_id, idx, ROUND((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy, 6) AS value FROM (
  SELECT sample_id, volume_id, idx, nx, ny, FLOOR(px) x0, FLOOR(py) y0, px - FLOOR(px) fx, py - FLOOR(py) fy FROM (
    SELECT sample_id, volume_id, idx, nx, ny, GREATEST(CAST(0 AS DOUBLE), LEAST(nx - CAST(1.001 AS DOUBLE), px)) px, GREATEST(CAST(0 AS DOUBLE), LEAST(ny - CAST(1.001 AS DOUBLE), py)) py
    FROM smp JOIN vol USING (volume_id))) s
  JOIN vox a ON a.volume_id = s.volume_id AND a.z = idx AND a.x = x0 AND a.y = y0
  JOIN vox b ON b.volume_id = s.volume_id AND b.z = idx AND b.x = LEAST(x0 + 1, nx - 1) AND b.y = y0
  JOIN vox c ON c.volume_id = s.volume_id AND c.z = idx AND c.x = x0 AND c.y = LEAST(y0 + 1, ny - 1)
  JOIN vox d ON d.volume_id = s.volume_id AND d.z = idx AND d.x = LEAST(x0 + 1, nx - 1) AND d.y = LEAST(y0 + 1, ny - 1)""".replace(
    "SELECT sample_id, volume_id, idx, ROUND", "SELECT sample_id, s.volume_id, idx, ROUND", 1))
oracle("rotate_slice", "vox vol", """SELECT volume_id, z AS idx, x AS v, ny - 1 - y AS u, ny AS w, nx AS h, v AS value FROM vox JOIN vol USING (volume_id)""")
oracle("slice_to_voxel", "vol smp", """SELECT sample_id, volume_id, CAST(GREATEST(0, LEAST(nz - 1, FLOOR(py))) AS INT) AS z, idx AS y,
  CAST(GREATEST(0, LEAST(nx - 1, FLOOR(px))) AS INT) AS x FROM smp JOIN vol USING (volume_id)""")
oracle("tf_lookup", "vox", """, st(p0, p1, r0, r1, g0, g1, b0, b1, a0, a1) AS (VALUES
  (CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE), 0, 30, 0, 0, 0, 0, 0, 10), (0.2, 0.4, 30, 180, 0, 30, 0, 0, 10, 60), (0.4, 0.6, 180, 255, 30, 130, 0, 0, 60, 120),
  (0.6, 0.8, 255, 255, 130, 220, 0, 80, 120, 180), (0.8, 1.0, 255, 255, 220, 255, 80, 200, 180, 255)),
lut AS (SELECT i, FLOOR(r0 + (r1 - r0) * ((t - p0) / (p1 - p0)) + 0.5) r, FLOOR(g0 + (g1 - g0) * ((t - p0) / (p1 - p0)) + 0.5) g,
    FLOOR(b0 + (b1 - b0) * ((t - p0) / (p1 - p0)) + 0.5) b, FLOOR(a0 + (a1 - a0) * ((t - p0) / (p1 - p0)) + 0.5) a
  FROM (SELECT i, CAST(i AS DOUBLE) / 255 t FROM (SELECT CAST(UNNEST(RANGE(256)) AS INT) i)) JOIN st ON t BETWEEN p0 AND p1
  QUALIFY ROW_NUMBER() OVER (PARTITION BY i ORDER BY p0) = 1)
SELECT volume_id, z, y, x, ROUND((c0.r * (1 - f) + c1.r * f) / 255, 6) AS r, ROUND((c0.g * (1 - f) + c1.g * f) / 255, 6) AS g,
  ROUND((c0.b * (1 - f) + c1.b * f) / 255, 6) AS b, ROUND((c0.a * (1 - f) + c1.a * f) / 255, 6) AS a
FROM (SELECT volume_id, z, y, x, t - FLOOR(t) f, GREATEST(0, CAST(FLOOR(t) AS INT)) i0, LEAST(255, CAST(FLOOR(t) AS INT) + 1) i1
      FROM (SELECT *, LEAST(CAST(1 AS DOUBLE), CAST(v AS DOUBLE) / 50000) * 256 - CAST(0.5 AS DOUBLE) t FROM vox))
JOIN lut c0 ON c0.i = i0 JOIN lut c1 ON c1.i = i1""")
oracle("gradient", "vox", """SELECT volume_id, z, y, x,
  CAST(COALESCE(LEAD(v) OVER wx, v) - COALESCE(LAG(v) OVER wx, v) AS DOUBLE) * 0.5 AS gx,
  CAST(COALESCE(LEAD(v) OVER wy, v) - COALESCE(LAG(v) OVER wy, v) AS DOUBLE) * 0.5 AS gy,
  CAST(COALESCE(LEAD(v) OVER wz, v) - COALESCE(LAG(v) OVER wz, v) AS DOUBLE) * 0.5 AS gz
  FROM vox WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y), wz AS (PARTITION BY volume_id, y, x ORDER BY z)""")
PALETTE = """SELECT m.mask_id, CAST(m.class_id AS INT) AS class_id, ROUND(COALESCE(p.r, {r}), 6) AS r, ROUND(COALESCE(p.g, {g}), 6) AS g, ROUND(COALESCE(p.b, {b}), 6) AS b,
  CASE WHEN m.class_id = 0 THEN CAST(0 AS DOUBLE) ELSE COALESCE({a}, CAST(1 AS DOUBLE)) END AS a
  FROM (SELECT mask_id, UNNEST(RANGE(256)) AS class_id FROM (SELECT DISTINCT mask_id FROM dense)) m LEFT JOIN pal p USING (mask_id, class_id)"""
oracle("mask_palette", "dense roi pal", PALETTE.format(r="CAST(0.2 AS DOUBLE)", g="CAST(0.4 AS DOUBLE)", b="CAST(0.6 AS DOUBLE)", a="p.a"))
oracle("mask_palette_active", "dense roi pal", PALETTE.format(
    r="CAST(1 AS DOUBLE)", g="CAST(0 AS DOUBLE)", b="CAST(0 AS DOUBLE)", a="CASE WHEN p.class_id = 1 THEN p.a WHEN p.class_id IS NOT NULL THEN CAST(0 AS DOUBLE) END"))
oracle("overlay_blend", "vox dense roi pal", """SELECT mask_id, volume_id, z AS idx, y AS v, x AS u, ROUND(t * (1 - k) + COALESCE(r, 0) * k, 6) AS r, ROUND(t * (1 - k) + COALESCE(g, 0) * k, 6) AS g,
  ROUND(t * (1 - k) + COALESCE(b, 0) * k, 6) AS b FROM (
  SELECT d.mask_id, vox.volume_id, vox.z, vox.y, vox.x, LEAST(CAST(1 AS DOUBLE), CAST(vox.v AS DOUBLE) / 50000) t, COALESCE(CAST(0.4 AS DOUBLE) * pal.a, 0) k, pal.r, pal.g, pal.b
  FROM vox JOIN dense d ON d.volume_id = vox.volume_id AND d.lin = vox.lin LEFT JOIN pal ON pal.mask_id = d.mask_id AND pal.class_id = d.class_id)""")
oracle("hex_colors", "", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '#' END || SUBSTR(MD5(text), 1, 6) || CASE WHEN doc_id % 5 = 0 THEN 'Z' ELSE '' END s,
    SUBSTR(MD5(text), 1, 6) d, doc_id % 5 <> 0 ok FROM documents)
SELECT doc_id, CASE WHEN ok THEN '#' || d END AS code, ROUND(CASE WHEN ok THEN CAST(CAST('0x' || SUBSTR(d, 1, 2) AS INT) AS DOUBLE) / 255 ELSE 1 END, 6) AS r,
  ROUND(CASE WHEN ok THEN CAST(CAST('0x' || SUBSTR(d, 3, 2) AS INT) AS DOUBLE) / 255 ELSE 0 END, 6) AS g,
  ROUND(CASE WHEN ok THEN CAST(CAST('0x' || SUBSTR(d, 5, 2) AS INT) AS DOUBLE) / 255 ELSE 0 END, 6) AS b,
  ['#ff4d4f', '#ff9f1a', '#ffd60a', '#52c41a', '#16c79a', '#36cfc9', '#40a9ff', '#597ef7', '#9254de', '#eb2f96'][CAST(doc_id % 10 AS INT) + 1] AS palette FROM t""")
oracle("encoder_features", "vox h hk split win", "SELECT volume_id, 'xy' AS axis, z AS idx, y AS v, x AS u, " + ", ".join(
    f"ROUND((GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), (v - lo_{k}) / GREATEST(CAST(1e-6 AS DOUBLE), hi_{k} - lo_{k}))) - CAST({m} AS DOUBLE)) / CAST({s} AS DOUBLE), 6) AS c{k}"
    for k, (m, s) in enumerate(((0.485, 0.229), (0.456, 0.224), (0.406, 0.225)))) + " FROM vox JOIN win USING (volume_id, z)")

for _name, _v, _u in (("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y")):
    oracle(f"project_{_name}", "vox", f"""SELECT volume_id, vox.{_v} AS row, vox.{_u} AS col, MAX(vox.v) AS vmax, MIN(vox.v) AS vmin, ROUND(AVG(vox.v), 6) AS vavg
      FROM vox GROUP BY 1, 2, 3""")
oracle("project_visible", "vox", """SELECT volume_id, y AS row, x AS col, COALESCE(MAX(CASE WHEN top >= 48000 THEN v END), 0) AS vmax,
  COALESCE(MIN(CASE WHEN top >= 48000 THEN v END), 0) AS vmin, ROUND(COALESCE(AVG(CASE WHEN top >= 48000 THEN v END), 0), 6) AS vavg
  FROM (SELECT *, MAX(v) OVER (PARTITION BY volume_id, z // 8, y // 8, x // 8) top FROM vox) GROUP BY 1, 2, 3""")
oracle("composite_z", "vox ramp lit comp", """SELECT volume_id, y AS row, x AS col, ROUND(c, 6) AS r, ROUND(c, 6) AS g, ROUND(c, 6) AS b, ROUND(alpha, 6) AS alpha FROM comp""")
oracle("composite_mask", "vox ramp lit comp dense roi pal", """, mk AS (SELECT d.mask_id, d.z, d.y, d.x, pal.r, pal.g, pal.b, pal.a * 0.25 a FROM dense d JOIN pal USING (mask_id, class_id)),
ov AS (SELECT mask_id, y, x, SUM(tr * a * r) r, SUM(tr * a * g) g, SUM(tr * a * b) b, SUM(tr * a) a FROM (SELECT *, EXP(COALESCE(SUM(LN(1 - a)) OVER
  (PARTITION BY mask_id, y, x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) tr FROM mk) WHERE 1 - tr < 0.95 GROUP BY ALL)
SELECT p.mask_id, c.volume_id, c.y AS row, c.x AS col, ROUND(c.c * (1 - COALESCE(a, 0)) + COALESCE(r, 0) * COALESCE(a, 0), 6) AS r,
  ROUND(c.c * (1 - COALESCE(a, 0)) + COALESCE(g, 0) * COALESCE(a, 0), 6) AS g, ROUND(c.c * (1 - COALESCE(a, 0)) + COALESCE(b, 0) * COALESCE(a, 0), 6) AS b
FROM comp c JOIN (SELECT DISTINCT mask_id, volume_id FROM dense) p USING (volume_id) LEFT JOIN ov USING (mask_id, y, x)""")

HIST = """hist AS (SELECT b.volume_id, CAST(b.bin AS INT) AS bin, COALESCE(n, 0) AS n, vmin, vmax FROM (SELECT volume_id, vmin, vmax, UNNEST(RANGE(256)) AS bin FROM vol) b LEFT JOIN (
  SELECT volume_id, GREATEST(0, LEAST(255, CAST(FLOOR((v - vmin) / (vmax - vmin) * 255) AS INT))) bin, COUNT(*) n FROM vox JOIN vol USING (volume_id) WHERE vmax > vmin GROUP BY 1, 2) q
  ON q.volume_id = b.volume_id AND q.bin = b.bin)"""
oracle("histogram256", "vox vol", f", {HIST} SELECT volume_id, bin, n FROM hist")
oracle("histogram_display", "vox vol", f""", {HIST} SELECT volume_id, bin, n, ROUND(LN(n + 1) / MAX(LN(n + 1)) OVER (PARTITION BY volume_id), 6) AS height,
  vmin + CAST(bin AS DOUBLE) / 255 * (vmax - vmin) BETWEEN 10000 AND 20000000 AS in_window FROM hist""")
oracle("sample_systematic", "vox vol", """SELECT volume_id, lin AS linear, v FROM vox JOIN (
  SELECT volume_id, CAST(FLOOR(CAST(i AS DOUBLE) * ((CAST(nx * ny * nz AS DOUBLE) - 1) / 776)) AS BIGINT) lin FROM vol, (SELECT UNNEST(RANGE(777)) i)) USING (volume_id, lin)""")
oracle("otsu_binary", "vox h", """, k AS (SELECT volume_id, z, lo, hi, b, CAST(SUM(n) OVER r AS DOUBLE) w0, CAST(SUM(b * n) OVER r AS DOUBLE) s0,
  CAST(SUM(n) OVER p AS DOUBLE) w, CAST(SUM(b * n) OVER p AS DOUBLE) s FROM h WINDOW p AS (PARTITION BY volume_id, z), r AS (PARTITION BY volume_id, z ORDER BY b))
SELECT volume_id, 'xy' AS axis, z AS idx, b AS bin, ROUND(lo + CAST(b + 1 AS DOUBLE) / 256 * (hi - lo), 6) AS threshold FROM k WHERE w0 < w
QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id, z ORDER BY ROUND(w0 * (w - w0) * POWER(s0 / w0 - (s - s0) / (w - w0), 2), 6) DESC, b) = 1""")
oracle("otsu_multi3", "vox h hk split", "SELECT volume_id, 'xy' AS axis, z AS idx, t1, t2, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper FROM split")
ORACLES["otsu_multi3_strict"] = _sql("vox h hk split", "SELECT volume_id, 'xz' AS axis, z AS idx, t1, t2, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper FROM split").replace(
    "WITH vox AS (", "WITH vox0 AS (", 1).replace(",\nh AS (", ",\nvox AS (SELECT volume_id, y AS z, z AS y, x, v, lin FROM vox0),\nh AS (", 1)
oracle("percentiles", "vox", " UNION ALL ".join(
    f"SELECT volume_id, CAST({q} AS DOUBLE) AS q, ROUND(QUANTILE_CONT(v, {q}), 6) AS value FROM vox GROUP BY 1" for q in (0.01, 0.2, 0.5, 0.8, 0.99)))
oracle("pseudo_rgb_windows", "vox h hk split win", "SELECT volume_id, 'xy' AS axis, z AS idx, found AS from_thresholds, " + ", ".join(
    f"ROUND({p}_{k}, 6) AS {p}_{k}" for k in range(3) for p in ("lo", "hi")) + " FROM win")
oracle("rect_range", "vox vol", """SELECT rect_id, r.volume_id, idx, MIN(v) AS vmin, MAX(v) AS vmax FROM (
  SELECT s_suppkey AS rect_id, 'events' AS volume_id, CAST(s_nationkey AS INT) AS idx, LEAST(nx - 1, LEAST(s_suppkey % 20, (s_suppkey * 3) % 23)) u0,
    LEAST(nx - 1, GREATEST(s_suppkey % 20, (s_suppkey * 3) % 23)) u1, LEAST(ny - 1, LEAST((s_suppkey * 7) % 25, (s_suppkey * 11) % 29)) v0,
    LEAST(ny - 1, GREATEST((s_suppkey * 7) % 25, (s_suppkey * 11) % 29)) v1 FROM supplier JOIN vol ON vol.volume_id = 'events') r
  JOIN vox ON vox.volume_id = r.volume_id AND vox.z = idx AND x BETWEEN u0 AND u1 AND y BETWEEN v0 AND v1 WHERE u1 > u0 AND v1 > v0
  GROUP BY 1, 2, 3 HAVING MAX(v) > MIN(v)""")
oracle("auto_tolerance", "vox", """SELECT volume_id, z, ROUND(CASE WHEN hi > lo THEN LEAST(64, GREATEST(CAST(1e-6 AS DOUBLE), (hi - lo) * CAST(0.05 AS DOUBLE))) ELSE 0 END, 6) AS tolerance
  FROM (SELECT volume_id, z, CAST(MIN(v) AS DOUBLE) lo, CAST(MAX(v) AS DOUBLE) hi FROM vox GROUP BY 1, 2)""")

STATS = """CAST(COUNT(*) AS BIGINT) AS voxels, ROUND(COUNT(*) * CAST(0.5 AS DOUBLE), 6) AS volume, ROUND(CAST(SUM(v) AS DOUBLE) / COUNT(*), 6) AS mean,
  ROUND(SQRT(GREATEST(0, SUM(CAST(v AS DOUBLE) * v) / COUNT(*) - POWER(CAST(SUM(v) AS DOUBLE) / COUNT(*), 2))), 3) AS std"""
oracle("roi_stats", "vox dense", f"SELECT d.mask_id, 'roi-' || d.class_id AS roi_id, d.class_id, {STATS} FROM dense d JOIN vox ON vox.volume_id = d.volume_id AND vox.lin = d.lin WHERE d.class_id > 0 GROUP BY d.mask_id, d.class_id")
oracle("roi_stats_delta", "vox vol dense stroke stamp painted", f"""SELECT d.mask_id, d.class_id, {STATS} FROM painted d JOIN vox ON vox.volume_id = d.volume_id AND vox.z = d.z AND vox.y = d.y AND vox.x = d.x
  WHERE d.class_id > 0 GROUP BY d.mask_id, d.class_id""")
oracle("class_counts", "dense", "SELECT mask_id, class_id, COUNT(*) AS n FROM dense GROUP BY 1, 2")
oracle("nonzero_count", "dense", "SELECT mask_id, COUNT(*) FILTER (class_id <> 0) AS nonzero FROM dense GROUP BY 1")

oracle("z_decimate", "vox", "SELECT volume_id, CAST(z // 4 AS INT) AS z, y, x, v FROM vox WHERE z % 4 = 0")
for _k in (2, 4):
    oracle(f"downsample{_k}", "vox vol", f"""SELECT volume_id, z // {_k} AS z, y // {_k} AS y, x // {_k} AS x, ROUND(AVG(CAST(v AS DOUBLE)), 6) AS v FROM vox JOIN vol USING (volume_id)
      WHERE (x % {_k} IN (0, {_k - 1}) OR x = nx - 1) AND (y % {_k} IN (0, {_k - 1}) OR y = ny - 1) AND (z % {_k} IN (0, {_k - 1}) OR z = nz - 1) GROUP BY 1, 2, 3, 4""")
oracle("downsample_box", "vox", "SELECT volume_id, z // 4 AS z, y // 4 AS y, x // 4 AS x, ROUND(AVG(CAST(v AS DOUBLE)), 6) AS v FROM vox GROUP BY 1, 2, 3, 4")
oracle("pyramid", "vox vol low", """SELECT 'low' AS level, volume_id, z, y, x, ROUND(v, 6) AS v FROM low UNION ALL
  SELECT 'mid', volume_id, z // 2, y // 2, x // 2, ROUND(AVG(CAST(v AS DOUBLE)), 6) FROM vox JOIN vol USING (volume_id) GROUP BY ALL
  UNION ALL SELECT 'full', volume_id, z, y, x, CAST(v AS DOUBLE) FROM vox""")
LABEL_AXIS = "{a} AS (SELECT volume_id, CAST(i AS INT) AS i, i * {n} // {t} AS s, GREATEST(i * {n} // {t} + 1, (i + 1) * {n} // {t}) AS e FROM coarse, LATERAL (SELECT UNNEST(RANGE({t})) i))"
oracle("label_downsample", "vol dense coarse", ", " + ", ".join(LABEL_AXIS.format(a=f"r{c}", n=f"n{c}", t=f"t{c}") for c in "zyx") + """
SELECT mask_id, z, y, x, class_id FROM (SELECT mask_id, rz.i AS z, ry.i AS y, rx.i AS x, class_id, COUNT(*) n, MAX(lin) l FROM dense d
  JOIN rz ON rz.volume_id = d.volume_id AND d.z >= rz.s AND d.z < rz.e JOIN ry ON ry.volume_id = d.volume_id AND d.y >= ry.s AND d.y < ry.e
  JOIN rx ON rx.volume_id = d.volume_id AND d.x >= rx.s AND d.x < rx.e WHERE class_id > 0 GROUP BY ALL)
QUALIFY ROW_NUMBER() OVER (PARTITION BY mask_id, z, y, x ORDER BY n DESC, l) = 1""")
oracle("label_scatter", "vol dense coarse", """SELECT mask_id, CAST(z * tz // nz AS INT) AS z, CAST(y * ty // ny AS INT) AS y, CAST(x * tx // nx AS INT) AS x, MAX(class_id) AS class_id
  FROM dense JOIN coarse USING (volume_id) WHERE class_id > 0 GROUP BY 1, 2, 3, 4""")
oracle("label_upsample", "vol dense", """SELECT d.mask_id, d.z, CAST(iy AS INT) AS y, CAST(ix AS INT) AS x, d.class_id FROM
  (SELECT volume_id, nx, ny, UNNEST(RANGE(nx * 2)) AS ix FROM vol) a JOIN (SELECT volume_id, UNNEST(RANGE(ny + 7)) AS iy FROM vol) b USING (volume_id)
  JOIN dense d ON d.volume_id = a.volume_id AND d.x = ix * nx // (nx * 2) AND d.y = iy * ny // (ny + 7) WHERE class_id > 0""")
oracle("resize_nearest", "vox vol", """SELECT a.volume_id, vox.z AS idx, CAST(iy AS INT) AS v, CAST(ix AS INT) AS u, vox.v AS value FROM
  (SELECT volume_id, nx, ny, UNNEST(RANGE(24)) AS ix FROM vol) a JOIN (SELECT volume_id, UNNEST(RANGE(33)) AS iy FROM vol) b USING (volume_id)
  JOIN vox ON vox.volume_id = a.volume_id AND vox.x = ix * nx // 24 AND vox.y = iy * ny // 33""")

oracle("threshold_slice", "vox", "SELECT volume_id, 'xy' AS axis, z AS idx, y AS v, x AS u FROM vox WHERE v BETWEEN 2500 AND 20000000")
oracle("threshold_apply", "vox vol", """SELECT volume_id, z, y, x FROM vox JOIN vol USING (volume_id) WHERE v BETWEEN 2500 AND 20000000
  AND (ABS(z - nz // 2) <= 1 OR ABS(y - ny // 2) <= 1 OR ABS(x - nx // 2) <= 1)""")
ORACLES["region_grow"] = _sql("vox vol", """, seed AS (SELECT volume_id, z, y AS sy, x AS sx, v AS sv, CAST(0.15 AS DOUBLE) * vmax AS tol FROM vox JOIN vol USING (volume_id)
  WHERE y = ny // 2 AND x = nx // 2), cand AS (SELECT vox.volume_id, z, y, x FROM vox JOIN seed USING (volume_id, z) WHERE ABS(v - sv) <= tol),
r AS (SELECT volume_id, z, sy AS y, sx AS x FROM seed UNION SELECT c.volume_id, c.z, c.y, c.x FROM r JOIN cand c
  ON c.volume_id = r.volume_id AND c.z = r.z AND ABS(c.x - r.x) <= 1 AND ABS(c.y - r.y) <= 1)
SELECT volume_id, 'xy' AS axis, z AS idx, y AS v, x AS u FROM r""", True)
ORACLES["region_grow_slices"] = _sql("vox vol", """, seed AS (SELECT volume_id, y, z AS sz, x AS sx, v AS sv, CAST(0.2 AS DOUBLE) * vmax AS tol FROM vox JOIN vol USING (volume_id)
  WHERE z = nz // 2 AND x = nx // 2 AND ABS(y - ny // 2) <= 3), cand AS (SELECT vox.volume_id, y, z, x FROM vox JOIN seed USING (volume_id, y) WHERE ABS(v - sv) <= tol),
r AS (SELECT volume_id, y, sz AS z, sx AS x FROM seed UNION SELECT c.volume_id, c.y, c.z, c.x FROM r JOIN cand c
  ON c.volume_id = r.volume_id AND c.y = r.y AND ABS(c.x - r.x) <= 1 AND ABS(c.z - r.z) <= 1)
SELECT volume_id, 'xz' AS axis, y AS idx, z AS v, x AS u FROM r""", True)
ORACLES["connected_components"] = _sql("vox vol", """, cand AS (SELECT volume_id, z, y, x, y * nx + x AS c FROM vox JOIN vol USING (volume_id) WHERE v BETWEEN 3000 AND 15000000),
e AS (SELECT a.volume_id, a.z, a.c, b.c AS o FROM cand a JOIN cand b ON a.volume_id = b.volume_id AND a.z = b.z AND ABS(a.x - b.x) <= 1 AND ABS(a.y - b.y) <= 1),
r AS (SELECT volume_id, z, c, c AS label FROM cand UNION SELECT e.volume_id, e.z, e.o, r.label FROM r JOIN e ON e.volume_id = r.volume_id AND e.z = r.z AND e.c = r.c AND e.o > r.label)
SELECT cand.volume_id, 'xy' AS axis, cand.z AS idx, y AS v, x AS u, CAST(MIN(label) AS BIGINT) AS label FROM r JOIN cand USING (volume_id, z, c) GROUP BY ALL""", True)
ORACLES["drop_small_islands"] = _sql("vox vol", """, cand AS (SELECT volume_id, z, y, x, y * nx + x AS c FROM vox JOIN vol USING (volume_id) WHERE v BETWEEN 2000 AND 20000000),
e AS (SELECT a.volume_id, a.z, a.c, b.c AS o FROM cand a JOIN cand b ON a.volume_id = b.volume_id AND a.z = b.z AND ABS(a.x - b.x) + ABS(a.y - b.y) = 1),
r AS (SELECT volume_id, z, c, c AS label FROM cand UNION SELECT e.volume_id, e.z, e.o, r.label FROM r JOIN e ON e.volume_id = r.volume_id AND e.z = r.z AND e.c = r.c AND e.o > r.label),
m AS (SELECT volume_id, z, c, MIN(label) AS label FROM r GROUP BY ALL)
SELECT m.volume_id, 'xy' AS axis, m.z AS idx, y AS v, x AS u FROM m JOIN cand USING (volume_id, z, c) QUALIFY COUNT(*) OVER (PARTITION BY m.volume_id, m.z, label) >= 12""", True)
oracle("brush_stamp", "vol stroke stamp", "SELECT mask_id, seq, z, y, x, after_class FROM stamp")
oracle("decode_mask_logits", "", """WITH best AS (SELECT vec_id // 8 AS slice_id, embedding FROM embeddings QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id // 8 ORDER BY label DESC, vec_id) = 1)
SELECT slice_id, CAST(iy AS INT) AS v, CAST(ix AS INT) AS u FROM best, (SELECT UNNEST(RANGE(20)) ix), (SELECT UNNEST(RANGE(25)) iy)
WHERE embedding[CAST((iy * 8 // 25) * 8 + ix * 8 // 20 AS INT) + 1] > 0""")

oracle("mask_at", "dense pts", """SELECT point_id, p.mask_id, p.z, p.y, p.x, COALESCE(class_id, 0) AS class_id FROM pts p
  LEFT JOIN dense d ON d.mask_id = p.mask_id AND d.z = p.z AND d.y = p.y AND d.x = p.x""")
UPDATED = """, up AS (SELECT mask_id, z, y, x, MAX_BY(CAST(GREATEST(0, point_id % 7 - 1) AS INT), point_id) AS a FROM pts GROUP BY ALL),
nw AS (SELECT d.mask_id, d.z, d.y, d.x, d.class_id AS b, COALESCE(a, class_id) AS a FROM dense d LEFT JOIN up ON up.mask_id = d.mask_id AND up.z = d.z AND up.y = d.y AND up.x = d.x)
"""
oracle("set_voxels", "dense pts", UPDATED + "SELECT mask_id, z, y, x, a AS class_id FROM nw WHERE a <> 0")
oracle("set_voxels_changes", "dense pts", UPDATED + "SELECT mask_id, z, y, x, b AS before_class, a AS after_class FROM nw WHERE a <> b")
oracle("mask_slice", "dense", "SELECT mask_id, 'yz' AS axis, x AS idx, z AS v, y AS u, class_id FROM dense WHERE x = 7")
oracle("voxels_of_class", "dense", "SELECT mask_id, z, y, x, lin AS linear FROM dense WHERE class_id = 2")
oracle("remap_class", "dense", "SELECT mask_id, z, y, x, CASE WHEN class_id = 2 THEN 4 ELSE class_id END AS class_id FROM dense WHERE class_id <> 0")
oracle("remap_fill", "dense", "SELECT mask_id, CASE WHEN class_id = 0 THEN 9 ELSE class_id END AS class_id, COUNT(*) AS n FROM dense GROUP BY 1, 2")
oracle("remap_counts", "dense", "SELECT mask_id, class_id AS source, COUNT(*) AS changed FROM dense WHERE class_id IN (0, 1, 4, 7) GROUP BY 1, 2")
oracle("used_class_ids", "dense", "SELECT DISTINCT mask_id, class_id FROM dense WHERE class_id > 0")
oracle("fill_mask", "dense", "SELECT mask_id, 6 AS class_id, COUNT(*) AS n FROM dense GROUP BY 1")
oracle("write_selection", "vox dense", """SELECT d.mask_id, d.lin AS linear, d.class_id AS before_class FROM dense d JOIN vox ON vox.volume_id = d.volume_id AND vox.lin = d.lin
  WHERE v BETWEEN 2500 AND 20000000 AND class_id <> 5""")
oracle("restore_selection", "dense", "SELECT mask_id, z, y, x, class_id FROM dense WHERE class_id <> 0")
oracle("apply_bits", "dense", """SELECT mask_id, z, y, x, CASE WHEN mask_id = 'm_type' AND user_id % 3 <> 0 THEN 3 ELSE class_id END AS class_id
  FROM dense LEFT JOIN events ON mask_id = 'm_type' AND event_id = lin WHERE class_id <> 0 OR (mask_id = 'm_type' AND user_id % 3 <> 0)""")
oracle("only_class", "dense", "SELECT mask_id, z, y, x, class_id FROM dense WHERE class_id = 1")
oracle("ensure_mask", "vol dense", """SELECT mask_id, 0 AS fill_value, nx AS gx, ny AS gy, nz AS gz, mask_id <> 'm_prio' AS kept,
  CASE WHEN mask_id = 'm_prio' THEN 0 ELSE COUNT(*) FILTER (class_id <> 0) END AS rows FROM dense JOIN vol USING (volume_id) GROUP BY mask_id, nx, ny, nz""")
SET_OP = "SELECT mask_id, z, y, x FROM dense WHERE class_id = 1 {op} SELECT d.mask_id, d.z, d.y, d.x FROM dense d JOIN vox ON vox.volume_id = d.volume_id AND vox.lin = d.lin WHERE v > 5000"
for _name, _op in (("union", "UNION"), ("difference", "EXCEPT"), ("intersection", "INTERSECT")):
    oracle(f"mask_{_name}", "vox dense", SET_OP.format(op=_op))

oracle("next_class_id", "dense", """SELECT mask_id, CAST(MIN(i) AS INT) AS next_class_id FROM (SELECT mask_id, UNNEST(RANGE(1, 256)) i FROM (SELECT DISTINCT mask_id FROM dense)) s
  WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.mask_id = s.mask_id AND d.class_id = s.i AND d.class_id NOT IN (0, 3)) GROUP BY 1""")
oracle("add_roi", "dense roi", """SELECT mask_id, 'roi-' || (top + nth) AS roi_id, CAST(i AS INT) AS class_id, 'ROI ' || (top + nth) AS name,
  ['#ff4d4f', '#ff9f1a', '#ffd60a', '#52c41a', '#16c79a', '#36cfc9', '#40a9ff', '#597ef7', '#9254de', '#eb2f96'][CAST((top + nth - 1) % 10 AS INT) + 1] AS color_hex,
  TRUE AS visible, FALSE AS locked, CAST(top + nth AS INT) AS ordinal FROM (
  SELECT s.mask_id, i, ROW_NUMBER() OVER (PARTITION BY s.mask_id ORDER BY i) nth, (SELECT MAX(ordinal) FROM roi r WHERE r.mask_id = s.mask_id AND r.class_id <> 2) top
  FROM (SELECT mask_id, UNNEST(RANGE(1, 256)) i FROM (SELECT DISTINCT mask_id FROM dense)) s
  WHERE NOT EXISTS (SELECT 1 FROM roi r WHERE r.mask_id = s.mask_id AND r.class_id = s.i AND r.class_id <> 2)) WHERE nth <= 3""")
oracle("find_roi", "dense roi", "SELECT mask_id, roi_id, class_id, name, color_hex, visible, locked, ordinal FROM roi WHERE class_id = 3")
oracle("delete_roi", "dense", """SELECT mask_id, CASE WHEN class_id = 1 THEN 0 ELSE class_id END AS class_id, COUNT(*) AS n, 'roi-2' AS active_roi_id FROM dense GROUP BY 1, 2""")
oracle("duplicate_roi", "dense roi", """SELECT mask_id, roi_id, class_id, name, color_hex, CASE WHEN class_id = 2 THEN 0 ELSE (SELECT COUNT(*) FROM dense d WHERE d.mask_id = roi.mask_id AND d.class_id = roi.class_id) END AS n FROM roi
  UNION ALL SELECT mask_id, 'roi-5', 5, name || ' Copy', color_hex, (SELECT COUNT(*) FROM dense d WHERE d.mask_id = roi.mask_id AND d.class_id = 2) FROM roi WHERE class_id = 2""")

oracle("rle_binary_runs", "dense marks runs", "SELECT mask_id, class_id, run_no, bit, st, len FROM runs")
oracle("rle_binary_header", "dense marks runs", """SELECT mask_id, class_id, CAST(SUM(len) AS BIGINT) AS total_voxels, CAST(COALESCE(SUM(len) FILTER (bit = 1), 0) AS BIGINT) AS one_count,
  MAX(bit) FILTER (run_no = 1) AS starts_with FROM runs GROUP BY 1, 2""")
oracle("rle_binary_roundtrip", "dense", "SELECT mask_id, z, y, x, class_id FROM dense WHERE class_id <> 0")
oracle("rle_decode_refused", "dense", """SELECT k.mask_id, k.class_id, COUNT(*) + 1 AS total_voxels, COUNT(*) AS run_sum FROM dense d
  JOIN (SELECT DISTINCT mask_id, class_id FROM dense WHERE class_id IN (1, 3)) k USING (mask_id) GROUP BY 1, 2""")
oracle("rle_label_runs", "", """WITH d AS (SELECT event_id AS lin, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 ELSE 0 END v FROM events)
SELECT 'm_type' AS mask_id, MIN(lin) AS st, v AS value, COUNT(*) AS len FROM (SELECT *, SUM(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (ORDER BY lin) g
  FROM (SELECT *, LAG(v) OVER (ORDER BY lin) p FROM d)) GROUP BY g, v""")
oracle("rle_label_tiles", "vol dense", """, t AS (SELECT mask_id, z // 16 AS cz, y // 16 AS cy, x // 16 AS cx, LEAST(16, nz - z // 16 * 16) AS size_z, LEAST(16, ny - y // 16 * 16) AS size_y,
  LEAST(16, nx - x // 16 * 16) AS size_x, z % 16 AS lz, y % 16 AS ly, x % 16 AS lx, class_id FROM dense JOIN vol USING (volume_id)),
p AS (SELECT *, lx + ly * size_x + lz * size_x * size_y AS l, MAX(class_id) OVER (PARTITION BY mask_id, cz, cy, cx) top FROM t),
q AS (SELECT *, SUM(CASE WHEN class_id = pc THEN 0 ELSE 1 END) OVER (PARTITION BY mask_id, cz, cy, cx ORDER BY l) g
  FROM (SELECT *, LAG(class_id) OVER (PARTITION BY mask_id, cz, cy, cx ORDER BY l) pc FROM p WHERE top > 0))
SELECT mask_id, cz, cy, cx, CAST(size_z AS INT) AS size_z, CAST(size_y AS INT) AS size_y, CAST(size_x AS INT) AS size_x, CAST(g AS INT) AS run_no, class_id AS value, COUNT(*) AS len
FROM q GROUP BY ALL""")
oracle("tiles_roundtrip", "dense", "SELECT mask_id, z, y, x, class_id FROM dense WHERE class_id <> 0")
oracle("tiles_refused", "vol dense", """SELECT mask_id, z // 8 AS cz, y // 8 AS cy, x // 8 AS cx, COUNT(*) + 1 AS total_voxels, COUNT(*) AS run_sum, COUNT(*) AS expected
  FROM dense WHERE (x // 8) % 2 = 1 GROUP BY 1, 2, 3, 4 HAVING MAX(class_id) > 0""")

YX = "0 AS z, CAST(lin // 20 AS INT) AS y, CAST(lin % 20 AS INT) AS x"
oracle("effective_edits", "elog chg", f"SELECT 'm_edit' AS mask_id, seq, {YX}, b AS before_class, a AS after_class FROM chg")
oracle("apply_edits", "elog", f"SELECT 'm_edit' AS mask_id, {YX}, c AS class_id FROM (SELECT lin, MAX_BY(a, seq) c FROM elog GROUP BY 1) WHERE c <> 0")
oracle("merge_strokes", "elog chg ops strk", f"SELECT 'm_edit' AS mask_id, CAST(stroke AS BIGINT) AS stroke, {YX}, b AS before_class, a AS after_class, s0 AS seq_first, s1 AS seq_last FROM strk")
LAST = """, cur AS (SELECT lin, MAX_BY(a, seq) c FROM elog GROUP BY 1), op AS (SELECT stroke, MAX(CASE WHEN a <> b THEN 1 ELSE 0 END) mv, ROW_NUMBER() OVER (ORDER BY stroke DESC) rk FROM strk GROUP BY 1),
un AS (SELECT lin, MIN_BY(b, stroke) c FROM strk JOIN op USING (stroke) WHERE rk <= 50 GROUP BY 1)"""
oracle("undo_strokes", "elog chg ops strk", LAST + f"SELECT 'm_edit' AS mask_id, {YX}, COALESCE(un.c, cur.c) AS class_id FROM cur LEFT JOIN un USING (lin) WHERE COALESCE(un.c, cur.c) <> 0")
oracle("redo_strokes", "elog chg ops strk", LAST + f""", ag AS (SELECT stroke FROM op WHERE rk <= 50 AND mv = 1 QUALIFY ROW_NUMBER() OVER (ORDER BY stroke) <= 20),
re AS (SELECT lin, MAX_BY(a, stroke) c FROM strk JOIN ag USING (stroke) GROUP BY 1)
SELECT 'm_edit' AS mask_id, {YX}, COALESCE(re.c, un.c, cur.c) AS class_id FROM cur LEFT JOIN un USING (lin) LEFT JOIN re USING (lin) WHERE COALESCE(re.c, un.c, cur.c) <> 0""")
oracle("dirty_slices", "vol dense stroke stamp painted", """, c AS (SELECT * FROM painted WHERE class_id <> before_class)
SELECT DISTINCT mask_id, 'xy' AS axis, z AS idx FROM c UNION SELECT mask_id, 'xz', y FROM c UNION SELECT mask_id, 'yz', x FROM c""")
oracle("add_roi_with_class", "", """WITH RECURSIVE c AS (SELECT p_partkey AS nth, p_size AS cls, 'roi-' || (p_partkey % 60) AS id, p_name FROM part),
r AS (SELECT CAST(-1 AS BIGINT) AS nth, CAST([] AS INT[]) AS cl, CAST([] AS VARCHAR[]) AS ids, FALSE AS ok
  UNION ALL SELECT c.nth, CASE WHEN good THEN LIST_APPEND(cl, cls) ELSE cl END, CASE WHEN good THEN LIST_APPEND(ids, id) ELSE ids END, good
  FROM r JOIN c ON c.nth = r.nth + 1, LATERAL (SELECT NOT LIST_CONTAINS(cl, cls) AND NOT LIST_CONTAINS(ids, id) AS good))
SELECT 'm_type' AS mask_id, id AS roi_id, cls AS class_id, p_name AS name,
  ['#ff4d4f', '#ff9f1a', '#ffd60a', '#52c41a', '#16c79a', '#36cfc9', '#40a9ff', '#597ef7', '#9254de', '#eb2f96'][CAST((LEN(cl) - 1) % 10 AS INT) + 1] AS color_hex,
  cls > 10 AS visible, FALSE AS locked, CAST(LEN(cl) AS INT) AS ordinal FROM r JOIN c USING (nth) WHERE ok""")
