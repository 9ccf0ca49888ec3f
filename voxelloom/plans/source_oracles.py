"""SQL for the queries on sources, sinks and streams."""

from __future__ import annotations

from .oracles import STATS, oracle

EXT = "['.raw', '.RAW', '.json', '.raw.volumeinfo', '.dat', '.nii', '.nii.gz', '.dcm', '.tif', '.PNG', '.txt'][CAST(doc_id % 11 AS INT) + 1]"
LISTING = f"""WITH f AS (SELECT 'dir' || doc_id % 7 AS selection, doc_id AS no, 'scan' || (doc_id // 5) % 23 AS base, {EXT} AS ext, doc_id % 11 AS k FROM documents),
p AS (SELECT *, selection || '/' || base || ext AS path FROM f),
pr AS (SELECT selection, base, MAX_BY(path, no) FILTER (k <= 1) AS raw, MAX_BY(path, no) FILTER (k = 2) AS js, MIN_BY(path, no) FILTER (k IN (3, 4)) AS ot FROM p WHERE k <= 4 GROUP BY 1, 2)
"""
oracle("group_files", "", LISTING + """SELECT selection, '3d-raw' AS type, base AS name, raw AS path, COALESCE(js, ot) AS metadata_path FROM pr WHERE raw IS NOT NULL AND COALESCE(js, ot) IS NOT NULL
UNION ALL SELECT selection, CASE WHEN k <= 6 THEN 'nifti' WHEN k = 7 THEN 'dicom' WHEN k = 8 THEN 'tiff' ELSE '2d-image' END,
  CASE WHEN k = 7 THEN 'DICOM series (' || COUNT(*) FILTER (k = 7) OVER (PARTITION BY selection) || ' files)' ELSE base || ext END, path, NULL FROM p WHERE k BETWEEN 5 AND 9""")
oracle("unpaired_files", "", LISTING + """SELECT selection, base, CASE WHEN raw IS NULL THEN 'metadata without RAW' ELSE 'RAW without metadata' END AS problem
FROM pr WHERE raw IS NULL OR COALESCE(js, ot) IS NULL""")

NAME = "'p' || p_partkey || '{}' AS path"
ND = "CAST(NULL AS {}) AS {}"
MJ = f"""SELECT {NAME.format('.json')}, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS nx, CASE WHEN p_partkey % 9 <> 0 THEN p_size + 1 END AS ny,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 11 AS INT) END AS nz, ['uint8', 'uint16', 'float32', 'int16'][CAST(p_partkey % 4 AS INT) + 1] AS data_type,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sx, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sy,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) / 10 ELSE CAST(1 AS DOUBLE) END AS sz, {ND.format('VARCHAR', 'byte_order')}, p_size = 3 AS is_rgb,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(-5 AS DOUBLE) END AS vmin, CASE WHEN p_partkey % 3 = 0 THEN CAST(70.5 AS DOUBLE) END AS vmax, p_name AS description,
  {ND.format('VARCHAR', 'error')} FROM part"""
MV = f"""SELECT {NAME.format('.raw.volumeinfo')}, p_size AS nx, p_size + 1 AS ny, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 11 AS INT) END AS nz,
  CASE p_partkey % 4 WHEN 3 THEN 'uint16' WHEN 0 THEN 'float32' ELSE 'uint8' END AS data_type, CAST(GREATEST(1, p_partkey % 3) AS DOUBLE) AS sx, CAST(0.25 AS DOUBLE) AS sy,
  CAST(1 AS DOUBLE) AS sz, 'little-endian' AS byte_order, {ND.format('BOOLEAN', 'is_rgb')}, CAST(p_size AS DOUBLE) AS vmin, {ND.format('DOUBLE', 'vmax')}, 'a=b' AS description,
  CASE WHEN p_partkey % 9 = 0 THEN 'missing or invalid SizeX/SizeY/SizeZ' END AS error FROM part"""
MD = f"""SELECT {NAME.format('.dat')}, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS nx, CASE WHEN p_partkey % 9 <> 0 THEN p_size + 1 END AS ny,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 11 AS INT) END AS nz, ['uint8', 'uint16', 'float32', NULL][CAST(p_partkey % 4 AS INT) + 1] AS data_type,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) END AS sx, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sy,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sz, {ND.format('VARCHAR', 'byte_order')}, {ND.format('BOOLEAN', 'is_rgb')},
  {ND.format('DOUBLE', 'vmin')}, {ND.format('DOUBLE', 'vmax')}, {ND.format('VARCHAR', 'description')},
  CASE WHEN p_partkey % 9 = 0 THEN 'missing or invalid Resolution' WHEN p_partkey % 4 = 3 THEN 'unsupported format: INT' END AS error FROM part"""
oracle("meta_json", "", MJ)
oracle("meta_volumeinfo", "", MV)
oracle("meta_dat", "", MD)
oracle("validate_meta", "", f"""SELECT path, nx, ny, nz, data_type, CASE WHEN error IS NOT NULL THEN error WHEN nx IS NULL OR ny IS NULL OR nz IS NULL THEN 'dimensions must have 3 elements'
  WHEN nx <= 0 OR ny <= 0 OR nz <= 0 THEN 'dimensions must be positive' WHEN data_type IS NULL THEN 'data type is missing'
  WHEN data_type NOT IN ('uint8', 'uint16', 'float32') THEN 'invalid data type ' || data_type END AS reject_reason FROM ({MJ} UNION ALL {MV} UNION ALL {MD})""")
oracle("meta_range", "", f"SELECT path, vmin, vmax FROM ({MJ})")

oracle("raw_slabs", "vox", "SELECT volume_id, z, y, x, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM vox")
oracle("raw_slab_plan", "vol", """SELECT volume_id, CAST(z0 AS BIGINT) * nx * ny * 2 AS offset, CAST(z0 AS INT) AS z0, CAST(LEAST(st, nz - z0) AS INT) AS slices FROM (
  SELECT *, GREATEST(1, 8192 // (nx * ny * 2)) AS st FROM vol) v, LATERAL (SELECT UNNEST(RANGE(3, nz, st)) AS z0)""")
FILE = "volume_id || '/' || PRINTF('%06d', z)"
oracle("dicom_headers", "vox vol", f"""SELECT DISTINCT {FILE} || '.dcm' AS path, ny AS rows, nx AS cols, 16 AS bits_allocated, z + 1 AS instance_no, CAST(-2.0 * z AS DOUBLE) AS position_z,
  CAST(2 AS DOUBLE) AS slope, CAST(-1024 AS DOUBLE) AS intercept, CAST(nx * ny * 2 AS BIGINT) AS pixel_length, CAST(NULL AS VARCHAR) AS skip_reason FROM vox JOIN vol USING (volume_id)""")
oracle("dicom_voxels", "vox vol", "SELECT volume_id, nz - 1 - z AS z, y, x, CAST((v % 65536) * 2 - 1024 AS DOUBLE) AS v FROM vox JOIN vol USING (volume_id)")
oracle("dicom_frames", "vox vol", "SELECT volume_id, greatest(nz - 3 * (z // 3 + 1), 0) + z % 3 AS z, y, x, CAST((v % 65536) * 2 - 1024 AS DOUBLE) AS v FROM vox JOIN vol USING (volume_id)")
oracle("dicom_volume_spacing", "vol", """SELECT volume_id AS series_id, CAST(0.25 AS DOUBLE) AS sx, CAST(0.5 AS DOUBLE) AS sy, CASE WHEN nz > 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sz FROM vol""")
HEADS = """WITH h AS (SELECT o_custkey AS s, o_orderkey AS f, CASE WHEN o_custkey % 4 = 3 AND o_orderkey % 2 = 1 THEN NULL ELSE o_totalprice END AS p,
  CASE WHEN o_custkey % 8 = 7 AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 97 END AS i FROM orders),
g AS (SELECT *, COUNT(p) OVER w = COUNT(*) OVER w AS ap, COUNT(i) OVER w = COUNT(*) OVER w AS ai FROM h WINDOW w AS (PARTITION BY s)),
k AS (SELECT *, CASE WHEN ap AND s % 4 = 0 THEN -p WHEN ap THEN p WHEN ai THEN i ELSE f END AS key FROM g)
"""
oracle("series_order", "", HEADS + "SELECT s AS series_id, f AS file_no, CAST(ROW_NUMBER() OVER (PARTITION BY s ORDER BY key, f) - 1 AS INT) AS z FROM k")
oracle("series_spacing", "", HEADS + """SELECT s AS series_id, CASE WHEN s % 3 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sx, CASE WHEN s % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sy,
  ROUND(COALESCE(NULLIF(COALESCE(d, CASE WHEN s % 5 = 0 THEN CAST(1.5 AS DOUBLE) WHEN s % 2 = 1 THEN CAST(2 AS DOUBLE) END), 0), 1), 6) AS sz
FROM (SELECT DISTINCT s FROM h) LEFT JOIN (SELECT s, AVG(ABS(p - q)) AS d FROM (SELECT s, p, LAG(p) OVER (PARTITION BY s ORDER BY key, f) AS q FROM k WHERE p IS NOT NULL) WHERE q IS NOT NULL GROUP BY 1) USING (s)""")
oracle("dicom_consistency", "", """SELECT o_custkey AS series_id, COUNT(DISTINCT o_custkey % 3 = 0 AND o_orderkey % 5 = 0) AS shapes FROM orders GROUP BY 1 HAVING shapes > 1""")
oracle("dicom_admit", "", """SELECT o_orderkey AS file_no, CASE WHEN o_orderkey % 7 = 0 THEN 'encapsulated pixel data' WHEN o_orderkey % 5 = 0 THEN 'not an image' WHEN o_orderkey % 11 = 0 THEN 'not monochrome'
  WHEN o_orderkey % 13 = 0 THEN 'pixel data not found' WHEN 500 + o_orderkey % 1000 > 1400 THEN 'pixel data extends beyond file' WHEN o_orderkey % 3 = 2 THEN 'unsupported bits allocated' END AS skip_reason FROM orders""")
oracle("nifti_voxels", "vox", f"""SELECT {FILE} || CASE WHEN z % 3 = 1 THEN '.nii.gz' ELSE '.nii' END AS volume_id, 0 AS z, y, x, v * CAST(0.5 AS DOUBLE) + 3 AS v FROM vox""")
oracle("nifti_headers", "vox vol", f"""SELECT DISTINCT {FILE} || CASE WHEN z % 3 = 1 THEN '.nii.gz' ELSE '.nii' END AS path, z % 3 = 1 AS gzip, CASE WHEN z % 3 = 2 THEN '>i4' ELSE '<i4' END AS kind, nx, ny, 1 AS nz,
  CAST(0.5 AS DOUBLE) AS sx, CAST(0.5 AS DOUBLE) AS sy, CAST(2 AS DOUBLE) AS sz, CAST(352 AS BIGINT) AS offset, CAST(0.5 AS DOUBLE) AS slope, CAST(3 AS DOUBLE) AS intercept, 'NIfTI' AS description FROM vox JOIN vol USING (volume_id)""")

oracle("nifti_time", "vox vol", """SELECT volume_id || '/' || PRINTF('%06d', z // 4) || '.nii' || CASE WHEN LEAST(4, nz - z // 4 * 4) > 1 THEN '#' || (z % 4) ELSE '' END AS volume_id,
  0 AS z, y, x, v * CAST(0.5 AS DOUBLE) + 3 AS v FROM vox JOIN vol USING (volume_id)""")

PIX = """WITH px AS (SELECT 'img' || event_id // 500 AS path, event_id // 500 AS z, CAST((event_id // 20) % 25 AS INT) AS y, CAST(event_id % 20 AS INT) AS x, CAST(ROUND(value * 100) AS INT) AS v FROM events),
p AS (SELECT path, z, y, x, v % 256 AS r, CASE WHEN z % 2 = 0 THEN v % 256 ELSE v // 256 END AS g, CASE WHEN z % 2 = 0 THEN v % 256 ELSE (v * 7) % 256 END AS b FROM px),
s AS (SELECT path, BOOL_AND(r = g AND r = b) AS is_gray FROM p GROUP BY 1)
"""
oracle("is_grayscale", "", PIX + "SELECT path, BOOL_AND(r = g AND r = b) AS is_gray, 20 AS nx, 25 AS ny FROM p GROUP BY 1")
oracle("image_to_voxels", "", PIX + """SELECT path AS volume_id, c AS z, y, x, CAST([r, g, b][c + 1] AS DOUBLE) AS v FROM p JOIN s USING (path), (VALUES (0), (1), (2)) k(c) WHERE NOT is_gray OR c = 0""")
oracle("channel_labels", "", PIX + """SELECT path AS volume_id, c AS z, CASE WHEN NOT is_gray THEN ['Red', 'Green', 'Blue'][c + 1] END AS label, is_gray AS single_slice FROM s, (VALUES (0), (1), (2)) k(c) WHERE NOT is_gray OR c = 0""")
oracle("rgb_to_gray", "", PIX + "SELECT path, y, x, ROUND(r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE), 6) AS gray FROM p")
oracle("natural_sort_stack", "", """SELECT stack_id, name, CAST(ROW_NUMBER() OVER (PARTITION BY stack_id ORDER BY n, e) - 1 AS INT) AS z FROM (SELECT 'stack' || p_size AS stack_id, (p_partkey * 7919) % 100003 AS n,
  CASE WHEN p_partkey % 3 = 0 THEN '.tif' ELSE '.tiff' END AS e, CASE WHEN p_partkey % 2 = 0 THEN 'Slice' ELSE 'slice' END || (p_partkey * 7919) % 100003 || CASE WHEN p_partkey % 3 = 0 THEN '.TIF' ELSE '.tiff' END AS name FROM part)""")
PAGES = """WITH p AS (SELECT o_custkey AS s, o_orderkey AS n, CASE WHEN o_custkey % 6 = 0 AND o_orderkey % 4 = 0 THEN 99 ELSE 100 END AS w FROM orders),
q AS (SELECT *, FIRST_VALUE(w) OVER (PARTITION BY s ORDER BY n) AS fw, CAST(ROW_NUMBER() OVER (PARTITION BY s ORDER BY n) - 1 AS INT) AS z, COUNT(*) OVER (PARTITION BY s) AS nz FROM p)
"""
oracle("stack_pages", "", PAGES + """SELECT s AS stack_id, n AS page_no, z, CASE WHEN s % 2 = 0 AND s % 5 <> 0 THEN 'uint16' ELSE 'uint8' END AS data_type, nz FROM q
WHERE s NOT IN (SELECT s FROM q WHERE w <> fw)""")
oracle("stack_refused", "", PAGES + "SELECT s AS stack_id, MIN(n) AS page_no, COUNT(*) AS pages FROM q WHERE w <> fw GROUP BY 1")
oracle("stack_problems", "", PAGES + """SELECT s AS stack_id, CASE WHEN s % 5 = 0 THEN 'unsupported format in first slice' ELSE 'dimension mismatch' END AS reject_reason, MIN(z) AS first_z, COUNT(*) AS slices
FROM q WHERE s % 5 = 0 OR w <> fw GROUP BY 1, 2""")
oracle("page_voxels", "vox", """SELECT z % 2 AS volume_id, z // 2 AS z, y, x, CAST(CASE WHEN z % 2 = 0 THEN v ELSE v % 256 END AS DOUBLE) AS v FROM vox WHERE volume_id = 'events'""")

oracle("export_roi_json", "vol dense roi marks runs", """, k AS (SELECT r.mask_id, r.roi_id, r.class_id, r.name, r.color_hex, nx, ny, nz FROM roi r JOIN vol ON vol.volume_id = CASE r.mask_id WHEN 'm_type' THEN 'events' ELSE 'orders' END),
hd AS (SELECT mask_id, class_id, CAST(SUM(len) AS BIGINT) t, CAST(SUM(len) FILTER (bit = 1) AS BIGINT) o, MAX(bit) FILTER (run_no = 1) s FROM runs GROUP BY 1, 2)
SELECT mask_id, roi_id, CAST(0 AS BIGINT) AS part_no, '{"format":"viewer-roi-mask-v1","name":"' || name || '","colorHex":"' || color_hex || '","classId":' || class_id || ',"dimensions":[' || nx || ',' || ny || ',' || nz
  || '],"spacing":[0.5,0.5,2.0],"voxelCount":' || o || ',"mask":{"encoding":"binary-rle-v1","totalVoxels":' || t || ',"oneCount":' || o || ',"startsWith":' || s || ',"runs":[' AS text FROM k JOIN hd USING (mask_id, class_id)
UNION ALL SELECT mask_id, roi_id, 4611686018427387904, ']}}' FROM k
UNION ALL SELECT k.mask_id, k.roi_id, (run_no - 1) // 512 + 1, CASE WHEN (run_no - 1) // 512 > 0 THEN ',' ELSE '' END || STRING_AGG(CAST(len AS VARCHAR), ',' ORDER BY run_no)
  FROM runs JOIN k USING (mask_id, class_id) GROUP BY k.mask_id, k.roi_id, (run_no - 1) // 512""")
# Class 1 is taken; the four documents get classes 2 to 5 and overwrite the old voxels of class 1.
oracle("import_roi_mask", "dense", "SELECT mask_id, z, y, x, class_id + 1 AS class_id FROM dense WHERE class_id > 0")
oracle("import_roi_registry", "dense roi", """SELECT mask_id, roi_id, class_id, name, color_hex, visible, locked, ordinal FROM roi WHERE class_id = 1
  UNION ALL SELECT mask_id, 'roi-' || (class_id + 1), class_id + 1, name, color_hex, TRUE, FALSE, ordinal + 1 FROM roi""")
oracle("import_roi_refused", "dense roi", "SELECT mask_id, 100 + class_id AS doc_no, 'unsupported ROI file format' AS reject_reason FROM roi")
oracle("export_package", "vol dense roi", """, t AS (SELECT mask_id, z // 16 AS cz, y // 16 AS cy, x // 16 AS cx, LEAST(16, nz - z // 16 * 16) AS sz, LEAST(16, ny - y // 16 * 16) AS sy,
  LEAST(16, nx - x // 16 * 16) AS sx, z % 16 AS lz, y % 16 AS ly, x % 16 AS lx, class_id, CAST(CEIL(nx / 16.0) AS BIGINT) AS ax, CAST(CEIL(ny / 16.0) AS BIGINT) AS ay FROM dense JOIN vol USING (volume_id)),
p AS (SELECT *, lx + ly * sx + lz * sx * sy AS l, MAX(class_id) OVER (PARTITION BY mask_id, cz, cy, cx) AS top FROM t),
q AS (SELECT *, SUM(CASE WHEN class_id = pc THEN 0 ELSE 1 END) OVER (PARTITION BY mask_id, cz, cy, cx ORDER BY l) AS g
  FROM (SELECT *, LAG(class_id) OVER (PARTITION BY mask_id, cz, cy, cx ORDER BY l) AS pc FROM p WHERE top > 0)),
u AS (SELECT mask_id, cx + cy * ax + cz * ax * ay + 1 AS part_no, cx, cy, cz, sx, sy, sz, g, class_id AS v, COUNT(*) AS n FROM q GROUP BY ALL),
w AS (SELECT mask_id, part_no, '{"coord":[' || cx || ',' || cy || ',' || cz || '],"size":[' || sx || ',' || sy || ',' || sz || '],"data":{"encoding":"label-rle-v1","totalVoxels":' || SUM(n) || ',"nonZeroVoxels":'
  || COALESCE(SUM(n) FILTER (v <> 0), 0) || ',"values":[' || STRING_AGG(CAST(v AS VARCHAR), ',' ORDER BY g) || '],"lengths":[' || STRING_AGG(CAST(n AS VARCHAR), ',' ORDER BY g) || ']}}' AS text
  FROM u GROUP BY mask_id, part_no, cx, cy, cz, sx, sy, sz)
SELECT mask_id, part_no, CASE WHEN part_no > MIN(part_no) OVER (PARTITION BY mask_id) THEN ',' ELSE '' END || text AS text FROM w
UNION ALL SELECT DISTINCT mask_id, 0, '{"format":"viewer-segmentation-package-v1","dimensions":[' || nx || ',' || ny || ',' || nz || '],"spacing":[0.5,0.5,2.0],"classDataType":"uint8","chunkSize":16,"tiles":['
  FROM dense JOIN vol USING (volume_id)
UNION ALL SELECT mask_id, 4611686018427387904, '],"rois":[' || STRING_AGG('{"id":"' || roi_id || '","classId":' || class_id || ',"name":"' || name || '","colorHex":"' || color_hex || '","visible":' || visible
  || ',"locked":' || locked || '}', ',' ORDER BY ordinal) || ']}' FROM roi GROUP BY 1""")
oracle("import_package_mask", "dense", "SELECT mask_id, z, y, x, class_id FROM dense WHERE class_id <> 0")
oracle("import_package_registry", "dense roi", """SELECT mask_id, roi_id, class_id, name, color_hex, visible OR mask_id = 'm_prio' AS visible, locked AND mask_id = 'm_type' AS locked, ordinal FROM roi""")
oracle("bricks_roundtrip", "vox", "SELECT volume_id, z, y, x, CAST(v AS DOUBLE) AS v FROM vox WHERE y BETWEEN 5 AND 20 AND x BETWEEN 0 AND 9")

oracle("stream_edits", "elog", "SELECT 'm_edit' AS mask_id, 0 AS z, CAST(lin // 20 AS INT) AS y, CAST(lin % 20 AS INT) AS x, c AS class_id FROM (SELECT lin, MAX_BY(a, seq) c FROM elog GROUP BY 1) WHERE c <> 0")
oracle("stream_edits_on_mask", "dense", """, e AS (SELECT (event_id * 7919) % 500 AS lin, MAX_BY(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END, event_id) AS c
  FROM events WHERE event_id % 10 <> 0 GROUP BY 1),
m AS (SELECT d.*, c FROM e JOIN dense d ON d.mask_id = 'm_type' AND d.lin = e.lin WHERE c <> d.class_id)
SELECT mask_id, z, y, x, class_id, CAST(-1 AS BIGINT) AS n FROM m UNION ALL SELECT mask_id, z, y, x, c, 1 FROM m""")
oracle("stream_stats", "vox elog", f"""SELECT 'm_edit' AS mask_id, c AS class_id, {STATS} FROM (
  SELECT seq // 500 * 500 + seq * 7919 % 500 // 3 AS lin, MAX_BY(a, seq) c FROM elog GROUP BY 1) e JOIN vox ON volume_id = 'events' AND vox.lin = e.lin
  WHERE c <> 0 GROUP BY c""")
oracle("stream_slabs", "", """SELECT event_type AS volume_id, MAX(user_id) + 1 AS slabs, COUNT(DISTINCT user_id) AS seen, COUNT(DISTINCT user_id) >= MAX(user_id) + 1 AS complete FROM events GROUP BY 1""")
oracle("best_available", "vox vol low", """SELECT volume_id, 'xy' AS axis, vox.z AS idx, vox.y AS v, vox.x AS u, CAST(vox.v AS DOUBLE) AS value, FALSE AS is_low_res FROM vox JOIN vol USING (volume_id)
  WHERE volume_id = 'events' AND vox.z = nz // 2
UNION ALL SELECT vox.volume_id, 'xy', vox.z, vox.y, vox.x, ROUND(low.v, 6), TRUE FROM vox JOIN vol USING (volume_id) JOIN low ON low.volume_id = vox.volume_id
   AND low.x = LEAST(vox.x // CAST(FLOOR(nx / CEIL(nx / 4.0) + 0.5) AS INT), CEIL(nx / 4.0) - 1) AND low.y = LEAST(vox.y // CAST(FLOOR(nx / CEIL(nx / 4.0) + 0.5) AS INT), CEIL(ny / 4.0) - 1)
   AND low.z = LEAST((nz // 2) // CAST(FLOOR(nx / CEIL(nx / 4.0) + 0.5) AS INT), CEIL(nz / 4.0) - 1) WHERE vox.volume_id = 'orders' AND vox.z = nz // 2""")
