import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import measure, rle
from voxelloom.plans.files import dicom_bytes, nifti_bytes
from voxelloom.sources import bricks, dicom, exchange, files, images, meta, nifti, raw, slabs


def array_of(voxels):
    rows = voxels.collect()
    out = np.full(tuple(max(r[c] for r in rows) + 1 for c in "zyx"), np.nan)
    for r in rows:
        out[r.z, r.y, r.x] = r.v
    assert len(rows) == out.size
    return out


def test_grouping_rules(spark):
    names = ["a.raw", "a.dat", "a.raw.volumeinfo", "a.json", "b.RAW", "b.raw.volumeinfo", "b.dat", "c.raw", "d.json", "e.nii.gz",
             "f.DCM", "g.dcm", "h.TIFF", "i.webp", "j.txt", "noext"]
    df = spark.createDataFrame([("s", i, f"s/{n}") for i, n in enumerate(names)], "selection string, file_no int, path string")
    groups, unpaired = files.group_files(df)
    got = sorted((r.type, r.name, r.path, r.metadata_path or "") for r in groups.collect())
    assert got == sorted([
        ("3d-raw", "a", "s/a.raw", "s/a.json"), ("3d-raw", "b", "s/b.RAW", "s/b.raw.volumeinfo"), ("nifti", "e.nii.gz", "s/e.nii.gz", ""),
        ("dicom", "DICOM series (2 files)", "s/f.DCM", ""), ("dicom", "DICOM series (2 files)", "s/g.dcm", ""),
        ("tiff", "h.TIFF", "s/h.TIFF", ""), ("2d-image", "i.webp", "s/i.webp", "")])
    assert sorted((r.base, r.problem) for r in unpaired.collect()) == [("c", "RAW without metadata"), ("d", "metadata without RAW")]


def test_metadata_edge_cases(spark):
    texts = [
        ("1.json", "{broken"), ("2.json", '{"dimensions": [2, 3], "dataType": "uint8"}'), ("3.json", '{"dimensions": [2, 3, 4]}'),
        ("4.json", '{"dimensions": [2, 3, 4], "dataType": "FLOAT", "spacing": [1, 2, 3], "byteOrder": "big-endian"}'),
        ("5.raw.volumeinfo", "[Volume]\r\nSizeX=2\r\nSizeY= 3 \r\nSizeZ=4\r\n[Volume]\r\nVoxelSizeX=abc\r\nVoxelSizeZ=.5\r\n[End]\r\nDatatype=uint8\r\n"),
        ("6.dat", "Resolution: 2 x 3 4\nFormat: ushort\nspacing: 0 2\n"), ("7.dat", "Resolution: 2 3\nFormat: UCHAR\n"),
    ]
    df = spark.createDataFrame(texts, "path string, text string")
    got = {r.path[0]: r for r in meta.validate_meta(meta.load_meta(df)).collect()}
    assert [bool(got[k].reject_reason) for k in "1234567"] == [True, True, True, False, False, False, True]
    assert (got["4"].data_type, got["4"].sz, got["4"].byte_order) == ("float32", 3.0, "big-endian")
    assert (got["5"].data_type, got["5"].nx, got["5"].ny, got["5"].sx, got["5"].sz) == ("uint16", 2, 3, 1.0, 0.5)
    assert (got["6"].data_type, got["6"].sx, got["6"].sy, got["6"].sz) == ("uint16", 1.0, 2.0, 1.0)


def test_raw_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60000, (5, 3, 4)).astype("<u2")
    (tmp_path / "a b.raw").write_bytes(a.tobytes() + b"tail")
    (tmp_path / "a b.json").write_text(json.dumps({"dimensions": [4, 3, 5], "dataType": "uint16"}))
    b = rng.random((2, 2, 2)).astype(">f4")
    (tmp_path / "b.raw").write_bytes(b.tobytes())
    (tmp_path / "b.json").write_text(json.dumps({"dimensions": [2, 2, 2], "dataType": "float32", "byteOrder": "big-endian"}))
    (tmp_path / "short.raw").write_bytes(b"12")
    (tmp_path / "short.dat").write_text("Resolution: 2 2 2\nFormat: BYTE\n")
    (tmp_path / "lost.raw").write_bytes(b"1")
    volumes, refused = raw.catalogue(spark, str(tmp_path))
    volumes = volumes.cache()
    print([tuple(r) for r in refused.collect()])
    assert sorted(r.path.rsplit("/", 1)[1] for r in refused.collect()) == ["lost", "short.raw"]
    voxels = raw.read_raw(volumes).cache()
    assert np.array_equal(array_of(voxels.where(F.col("volume_id").endswith("/a b"))), a)
    assert np.array_equal(array_of(voxels.where(F.col("volume_id").endswith("/b"))), b.astype(float))
    part = raw.read_raw(volumes, 2, 3).where(F.col("volume_id").endswith("/a b"))
    assert sorted({r.z for r in part.collect()}) == [2, 3]


@pytest.mark.parametrize("code,kind", [(2, "u1"), (4, "i2"), (8, "i4"), (16, "f4"), (64, "f8"), (256, "i1"), (512, "u2"), (768, "u4"), (128, "rgb")])
def test_nifti_types(spark, tmp_path, code, kind):
    rng = np.random.default_rng(code)
    order = "<" if code % 16 else ">"
    if kind == "rgb":
        grid = rng.integers(0, 255, (2, 3, 4, 3)).astype("u1")
        want = grid @ np.array([0.299, 0.587, 0.114])
    else:
        grid = rng.integers(0, 100, (2, 3, 4)).astype(order + kind)
        want = grid.astype(float)
    (tmp_path / "a.nii").write_bytes(nifti_bytes(grid, code, order, slope=2.0, intercept=1.0))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti_bytes(grid, code, order, slope=float("nan"), intercept=float("nan"), dim4=3, pixdim=(0, -1, 0, 3))))
    heads = nifti.decode_headers(files.list_files(spark, str(tmp_path))).cache()
    v = nifti.read_nifti(heads)
    np.testing.assert_allclose(array_of(v.where(F.col("volume_id").endswith("a.nii"))), want * 2 + 1)
    np.testing.assert_allclose(array_of(v.where(F.col("volume_id").endswith(".gz"))), want)
    spacing = {r.description: (r.sx, r.sy, r.sz) for r in nifti.volumes_of(heads).collect()}
    assert spacing == {"NIfTI": (0.5, 0.5, 2.0), "NIfTI (first volume)": (1.0, 1.0, 3.0)}


def test_nifti_time_points(spark, tmp_path):
    grid = np.random.default_rng(7).integers(0, 100, (6, 2, 3, 4)).astype("<i2")  # 3 times 2 volumes of 2 slices
    data = bytearray(nifti_bytes(grid[0], 4, "<", dim4=3) + grid[1:].tobytes())
    struct.pack_into("<h", data, 40, 5)
    struct.pack_into("<h", data, 50, 2)
    (tmp_path / "a.nii").write_bytes(bytes(data))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(bytes(data)))
    (tmp_path / "c.nii").write_bytes(b"bad")
    heads = nifti.decode_headers(files.list_files(spark, str(tmp_path)))
    every = nifti.time_points(heads)
    assert every.count() == 13 and every.columns == heads.columns
    v = nifti.read_nifti(every).cache()
    for t in range(6):
        for name in ("a.nii", "b.nii.gz"):
            np.testing.assert_array_equal(array_of(v.where(F.col("volume_id").endswith(f"{name}#{t}"))), grid[t])
    np.testing.assert_array_equal(array_of(nifti.read_nifti(heads.where(F.col("path").endswith("a.nii")))), grid[0])


def test_nifti_refusals():
    good = nifti_bytes(np.zeros((1, 1, 1), "u1"), 2)
    assert nifti.decode_header(b"x")["reject_reason"] == "invalid NIfTI header"
    assert "datatype" in nifti.decode_header(nifti_bytes(np.zeros((1, 1, 1), "u1"), 1024))["reject_reason"]
    assert "dimensions" in nifti.decode_header(good[:46] + b"\0\0" + good[48:])["reject_reason"]


def test_dicom_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    grids = rng.integers(0, 4000, (4, 3, 5))
    for i, g in enumerate(grids):
        (tmp_path / f"{i}.dcm").write_bytes(dicom_bytes(g, 10.0 - 3 * i, i, i % 3))
    bad = {
        "c": dicom_bytes(grids[0], 0, 9, syntax="1.2.840.10008.1.2.4.70"), "d": dicom_bytes(grids[0], 0, 9, syntax="1.2.840.10008.1.2.2"),
        "e": dicom_bytes(grids[0], 0, 9, samples=3), "f": dicom_bytes(grids[0], 0, 9)[:-4], "g": dicom_bytes(grids[0], 0, 9, bits=32), "h": b"no dicom"}
    for name, data in bad.items():
        (tmp_path / f"{name}.dcm").write_bytes(data)
    content = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    heads = dicom.admit(dicom.decode_headers(content)).cache()
    skipped = {r.path[-5]: r.skip_reason for r in heads.where("skip_reason is not null").collect()}
    assert sorted(skipped) == sorted(bad) and skipped["d"] == "big-endian transfer syntax" and skipped["f"] == "pixel data extends beyond file"
    good = heads.where("skip_reason is null").select("*", F.lit("s").alias("series_id"), F.col("path").alias("file_no"))
    ordered = dicom.series_order(good)
    np.testing.assert_allclose(array_of(dicom.read_dicom(ordered)), grids[::-1] * 2.0 - 1024)
    assert dicom.series_spacing(ordered).first()[1:] == (0.25, 0.5, 3.0)
    assert dicom.consistency(good).count() == 0


def test_dicom_headers_by_path_read_no_pixels(spark, tmp_path, monkeypatch):
    grid = np.random.default_rng(8).integers(0, 4000, (1, 300, 200))[0]
    whole = dicom_bytes(grid, 10.0, 1)
    cases = {"a": whole, "b": dicom_bytes(grid, 0, 9, syntax="1.2.840.10008.1.2.4.70"), "c": whole[:-4], "d": b"no dicom", "e": b"", "f": whole[:140]}
    for name, data in cases.items():
        (tmp_path / f"{name}.dcm").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    by_path = dicom.admit(dicom.decode_headers(files.select("path"))).orderBy("path").collect()
    assert by_path == dicom.admit(dicom.decode_headers(files.select("path", "content"))).orderBy("path").collect()
    # The window grows from any size to the same header.
    for window in (1, 140, 200, 333):
        monkeypatch.setattr(dicom, "WINDOW", window)
        for name, data in cases.items():
            assert dicom.read_header(str(tmp_path / f"{name}.dcm")) == dicom.decode_header(data)
    taken = []
    monkeypatch.setattr(dicom, "WINDOW", 1024)
    decode = dicom.decode_header
    monkeypatch.setattr(dicom, "decode_header", lambda data, size: (taken.append(len(data)), decode(data, size))[1])
    dicom.read_header(str(tmp_path / "a.dcm"))
    assert sum(taken) < len(whole) // 10


def test_dicom_multiframe_signed_and_nested(spark, tmp_path):
    frames = np.random.default_rng(2).integers(-500, 500, (3, 2, 4))
    (tmp_path / "m.dcm").write_bytes(dicom_bytes(frames, 0, 1, frames=3, slope=0, intercept=5, signed=1, dtype="<i2"))
    # A sequence of undefined length with a nested item of undefined length before the image tags.
    seq = struct.pack("<HH2sHI", 8, 0x1140, b"SQ", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + (
        struct.pack("<HH2sH", 0x28, 0x10, b"US", 2) + b"\x63\0") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    plain = dicom_bytes(frames[0] + 500, 0, 1, 2)
    head = dicom.decode_header(seq + plain)
    assert (head["rows"], head["cols"], head["pixel_length"]) == (2, 4, 16)
    content = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    heads = dicom.admit(dicom.decode_headers(content)).select("*", F.lit("s").alias("series_id"), F.lit(0).alias("file_no"))
    np.testing.assert_allclose(array_of(dicom.read_dicom(dicom.series_order(heads))), frames + 5.0)


def test_dicom_several_multiframe_files_and_mixed_sizes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    one, two, three = (rng.integers(0, 500, (n, 2, 4)) for n in (3, 1, 5))
    for name, frames, no in (("b", two, 2), ("a", one, 1), ("c", three, 3)):
        (tmp_path / f"{name}.dcm").write_bytes(dicom_bytes(frames, 0, no, no, frames=len(frames), slope=0, intercept=0))
    content = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    heads = dicom.admit(dicom.decode_headers(content)).select("*", F.lit("s").alias("series_id"), F.col("path").alias("file_no"))
    ordered = dicom.series_order(heads.withColumn("position", F.lit(None).cast("array<double>")))
    want = np.concatenate([one, two, three])
    np.testing.assert_allclose(array_of(dicom.read_dicom(ordered)), want)
    np.testing.assert_allclose(array_of(dicom.read_dicom(ordered, content)), want)
    monkeypatch.setattr(slabs, "SLAB_BYTES", 40)  # two frames
    assert dicom.pixel_slabs(dicom.with_frames(ordered)).count() == 6
    np.testing.assert_allclose(array_of(dicom.read_dicom(ordered)), want)
    mixed = ordered.withColumn("rows", F.when(F.col("frames") == 1, 1).otherwise(F.col("rows")))
    assert dicom.read_dicom(mixed).count() == 0
    assert {r.skip_reason for r in dicom.with_frames(mixed).collect()} == {"slices of the series differ in size"}


def test_small_rows_are_spread_before_they_grow(spark):
    grid = spark.sql("select 'v' volume_id, 'none' path, cast(null as binary) content, false gzip, 0L offset, '<u2' kind, 5120 nx, "
                     "5120 ny, 400 nz, 2L bpv, 1.0D slope, 0.0D intercept")
    plan = slabs.plan_slabs(grid)
    assert plan.count() == 400 and plan.rdd.getNumPartitions() == 400


def png(rgb):
    h, w, _ = rgb.shape
    raw_ = b"".join(b"\0" + rgb[y].astype("u1").tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw_)) + chunk(b"IEND", b"")


def test_images_from_files(spark, tmp_path):
    colour = np.random.default_rng(3).integers(0, 255, (3, 5, 3))
    grey = np.repeat(colour[:, :, :1], 3, axis=2)
    (tmp_path / "c.png").write_bytes(png(colour))
    (tmp_path / "g.png").write_bytes(png(grey))
    pixels = images.image_pixels(images.read_images(spark, str(tmp_path))).cache()
    shapes = images.is_grayscale(pixels).cache()
    v = images.image_to_voxels(pixels, shapes)
    np.testing.assert_array_equal(array_of(v.where(F.col("volume_id").endswith("c.png"))), colour.transpose(2, 0, 1))
    np.testing.assert_array_equal(array_of(v.where(F.col("volume_id").endswith("g.png"))), grey[None, :, :, 0])
    assert sorted((r.nz, r.is_rgb) for r in images.image_volumes(shapes).collect()) == [(1, False), (3, True)]


def test_natural_order(spark):
    names = ["img10.tif", "IMG2.tif", "img1.TIFF", "img02b.tif", "notes.txt", "img002.tif"]
    df = spark.createDataFrame([("s", n) for n in names], "stack_id string, name string")
    got = [r.name for r in images.natural_sort_stack(df).orderBy("z").collect()]
    assert got == ["img1.TIFF", "IMG2.tif", "img002.tif", "img02b.tif", "img10.tif"]


def test_bricks_prune_the_scan(spark, grid, tmp_path):
    a = np.random.default_rng(5).integers(0, 100, (9, 10, 11)).astype(float)
    voxels, volumes = grid(a=a, b=a * 2)
    bricks.write_bricks(voxels, volumes, str(tmp_path), 4)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = bricks.read_bricks(spark, str(tmp_path), ["a"], 4, display_min=50, y=(5, 6))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(by,1)" in plan and "GreaterThanOrEqual(vmax,50.0)" in plan
    got = bricks.voxels_of(bricks.read_bricks(spark, str(tmp_path), ["a"], 4, y=(5, 6)), 4, y=(5, 6)).collect()
    assert len(got) == 9 * 2 * 11 and all(r.v == a[r.z, r.y, r.x] for r in got)


def test_fragments_on_disk_join_to_json(spark, grid, labels, tmp_path):
    a = np.random.default_rng(6).integers(0, 3, (3, 4, 5))
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a)
    rois = spark.createDataFrame([("m", f"roi-{c}", c, f"R {c}", "#00ff00", True, False, c) for c in (1, 2)],
                                 "mask_id string, roi_id string, class_id int, name string, color_hex string, visible boolean, locked boolean, ordinal int")
    parts = exchange.export_roi_json(mask, masks, volumes, rois, runs_per_part=4)
    exchange.write_fragments(parts, ["mask_id", "roi_id"], str(tmp_path / "rois"))
    for c in (1, 2):
        folder = tmp_path / "rois" / "mask_id=m" / f"roi_id=roi-{c}"
        doc = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
        bits = np.concatenate([np.full(n, (doc["mask"]["startsWith"] + i) % 2) for i, n in enumerate(doc["mask"]["runs"])])
        assert np.array_equal(bits, (a.ravel() == c).astype(int)) and doc["mask"]["oneCount"] == (a == c).sum() == doc["voxelCount"]
        assert (doc["format"], doc["dimensions"], doc["spacing"], doc["colorHex"]) == ("viewer-roi-mask-v1", [5, 4, 3], [0.5, 0.5, 2.0], "#00ff00")
    package = exchange.export_package(mask, masks, volumes, rois, 8)
    text = exchange.documents(package, ["mask_id"])[0].first().text
    doc = json.loads(text)
    assert len(doc["tiles"]) == 1 and doc["tiles"][0]["size"] == [5, 4, 3] and [r["id"] for r in doc["rois"]] == ["roi-1", "roi-2"]
    assert exchange.documents(package, ["mask_id"], limit=10)[1].count() == 1

    bad = [json.dumps({**doc, "dimensions": [1, 1, 1]}), "[]", json.dumps({**doc, "tiles": [{**doc["tiles"][0], "size": [5, 4, 2]}]})]
    ids = spark.createDataFrame([(f"m{i}", "a", "uint8", 0, 64) for i in range(4)], masks.schema)
    docs = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate([text, *bad])], "mask_id string, text string")
    rows, registry, refused = exchange.import_package(docs, ids, volumes)
    assert sorted((r.mask_id, r.reject_reason) for r in refused.collect()) == [
        ("m1", "dimensions do not match"), ("m2", "unsupported package format"), ("m3", "tiles do not add up")]
    assert rows.count() == (a > 0).sum() and {r.mask_id for r in rows.collect()} == {"m0"}
    assert sorted(r.roi_id for r in registry.collect()) == ["roi-1", "roi-2"]


def test_fragments_are_imported_without_joining_them(spark, grid, labels):
    a = np.random.default_rng(7).integers(0, 3, (3, 9, 10))
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a)
    rois = spark.createDataFrame([("m", f"roi-{c}", c, f"R {c}", "#00ff00", True, False, c) for c in (1, 2)],
                                 "mask_id string, roi_id string, class_id int, name string, color_hex string, visible boolean, locked boolean, ordinal int")
    parts = exchange.export_roi_json(mask, masks, volumes, rois, runs_per_part=4).withColumn(
        "doc_no", F.substring("roi_id", 5, 1).cast("int")).drop("roi_id")
    assert parts.count() > 10
    lost = parts.where("part_no <> 2").withColumn("doc_no", F.col("doc_no") + 10)
    open_ended = parts.where("part_no < 100000").withColumn("doc_no", F.col("doc_no") + 20)
    wrong = parts.withColumns({"doc_no": F.col("doc_no") + 30, "text": F.when(F.col("part_no") == 3, ",1,x").otherwise(F.col("text"))})
    everything = parts.unionByName(lost).unionByName(open_ended).unionByName(wrong)
    written, registry, refused = exchange.import_roi_fragments(everything, mask.limit(0), masks, volumes, rois.limit(0))
    assert {(r.z, r.y, r.x): r.class_id for r in written.mask.collect()} == {tuple(map(int, p)): int(a[tuple(p)]) for p in np.argwhere(a > 0)}
    assert sorted((r.class_id, r.name) for r in registry.collect()) == [(1, "R 1"), (2, "R 2")]
    assert sorted((r.doc_no, r.reject_reason) for r in refused.collect()) == [
        *[(n, "runs do not add up") for n in (11, 12)], *[(n, "unsupported ROI file format") for n in (21, 22, 31, 32)]]

    package = exchange.export_package(mask, masks, volumes, rois, 8)
    ids = spark.createDataFrame([(f"m{i}", "a", "uint8", 0, 64) for i in range(3)], masks.schema)
    several = package.withColumn("mask_id", F.lit("m0")).unionByName(package.where("part_no < 100000").withColumn("mask_id", F.lit("m1"))).unionByName(
        package.withColumns({"mask_id": F.lit("m2"), "text": F.when(F.col("part_no") == 1, "{").otherwise(F.col("text"))}))
    rows, registry, refused = exchange.import_package_fragments(several, ids, volumes)
    assert sorted((r.mask_id, r.reject_reason) for r in refused.collect()) == [(f"m{i}", "unsupported package format") for i in (1, 2)]
    assert {(r.mask_id, r.z, r.y, r.x): r.class_id for r in rows.collect()} == {("m0", *map(int, p)): int(a[tuple(p)]) for p in np.argwhere(a > 0)}
    assert sorted(r.roi_id for r in registry.collect()) == ["roi-1", "roi-2"]


def test_filled_mask_exports_its_background(spark, grid, labels):
    a = np.random.default_rng(8).integers(0, 3, (2, 9, 9))
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a, fill=2)
    dense = rle.dense_rows(mask, masks, volumes)
    counts = {r.class_id: r["count"] for r in dense.groupBy("class_id").count().collect()}
    assert counts == {c: int((a == c).sum()) for c in range(3)}
    assert {(r.class_id, r.n) for r in measure.class_counts(mask, masks, volumes).collect()} == set(counts.items())
