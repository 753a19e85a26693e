import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemspark.functions import geometry as geo
from stemspark.functions import labels
from stemspark.operators import clouds, fits, grid, joins, nms, sampling
from stemspark.plans import archive, browse, convert, detect, index, notes
from stemspark.sources import buffers, documents, las, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_like_the_viewer(spark):
    got = one(spark, *(geo.js_round(F.lit(x), d).alias(f"c{i}") for i, (x, d) in enumerate([(-2.5, 0), (2.5, 0), (0.125, 2), (2.675, 2), (1.005, 2), (math.nan, 2), (math.inf, 2)])), geo.js_round(F.lit(None).cast("double"), 2).alias("n"))
    assert list(got) == [-2.0, 3.0, 0.13, 2.68, 1.0, None, None, None]
    assert one(spark, geo.js_round_all(F.array(F.lit(0.1234567)), 6).alias("a"))["a"] == [0.123457]


def test_circle_through_three_points(spark):
    c = one(spark, geo.circumcircle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0)).alias("c"), geo.circumcircle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("flat"))
    assert c["flat"] is None and (round(c["c"]["x"], 12), round(c["c"]["y"], 12), round(c["c"]["r"], 12)) == (0.0, 0.0, 1.0)


@settings(deadline=None, max_examples=30)
@given(st.integers(0, 10**6), st.floats(0.03, 0.3))
def test_array_circles_agree_with_known_ones(seed, r):
    rng = np.random.default_rng(seed)
    t, c = rng.random(40) * 2 * math.pi, rng.normal(size=2)
    xy = c + r * np.stack([np.cos(t), np.sin(t)], 1)
    centre, radius = fits.circle_of(xy)
    assert np.allclose(centre, c, atol=1e-6) and abs(radius - r) < 1e-6
    centres, radii = fits.circles_through(xy[[[0, 13, 27]]])
    assert np.isnan(radii[0]) or np.allclose(centres[0], c, atol=1e-3) or np.ptp(t[[0, 13, 27]]) < 0.1


def test_moment_circle_needs_three_points(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0)], "k int, x double, y double")
    assert all(r["r"] is None for r in fits.circle_from_moments(rows, ["k"]).collect())


def test_plane_basis_is_orthogonal(spark):
    for axis in ([0.1, 0.2, 0.97], [0.0, 0.99, 0.1]):
        a = [F.lit(v / np.linalg.norm(axis)) for v in axis]
        u, v = geo.plane_basis(a)
        d = one(spark, *(geo.dot(p, q).alias(f"d{i}") for i, (p, q) in enumerate([(a, u), (a, v), (u, v), (u, u), (v, v)])))
        assert np.allclose(list(d), [0, 0, 0, 1, 1], atol=1e-12)


def test_axis_flip_and_ground(spark):
    down = one(spark, geo.ground_point(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0)), F.lit(1.3)).alias("g"))["g"]
    assert np.allclose(down, [1.0, 2.0, 1.7])
    x, y, z = (c for c in one(spark, *(c.alias(f"c{i}") for i, c in enumerate(geo.axis_point(F.lit(0.1), F.lit(1.0), F.lit(0.2), F.lit(2.0), F.lit(-6.0), F.lit(1.0))))))
    assert np.allclose([x, y, z], [1.1, 2.2, -5.0])
    b = one(spark, *geo.prior_bounds(F.lit(0.1)), geo.step_for(F.lit(67177038), F.lit(3000000)).alias("step"))
    assert np.allclose(list(b), [0.058, 0.15, 0.075, 23])


def test_local_maxima_settle_ties_greedily(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0), (0, 2, 5.0), (9, 9, 4.0), (9, 8, 3.0), (5, 5, 0.0)], "iy int, ix int, score double")
    assert sorted((r["iy"], r["ix"]) for r in grid.local_maxima(cells, 1).collect()) == [(0, 0), (0, 2), (9, 9)]


def test_smoothing_keeps_the_sum(spark):
    h = spark.createDataFrame([(0, 0, 0, 3), (0, 7, 9, 2), (1, 4, 4, 1)], "band int, iy int, ix int, n long")
    sums = {r["band"]: r["s"] for r in grid.smoothed(h, 8, 10).groupBy("band").agg(F.sum("v").alias("s")).collect()}
    assert np.allclose([sums[0], sums[1]], [5, 1])


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if all(math.hypot(r[1] - k[1], r[2] - k[2]) >= max(0.2, 0.72 * (r[3] + k[3])) for k in kept):
            kept.append(r)
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("seed", range(3))
def test_suppression_equals_the_sequential_pass(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.random() * 2), float(rng.random() * 2), float(rng.random() * 0.34), float(rng.integers(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, cx double, cy double, r double, quality double")
    assert sorted(r["id"] for r in nms.suppress(df).collect()) == greedy(rows)


def test_owner_is_the_nearest_ties_to_the_smaller(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0)], "iy int, ix int, cell_x double, cell_y double")
    seeds = spark.createDataFrame([(2, 0.5, 0.0), (1, -0.5, 0.0)], "seed_id int, seed_x double, seed_y double")
    for reach in (None, 2.0):
        assert {(r["ix"], r["owner"]) for r in joins.nearest_owner(cells, seeds, reach=reach).collect()} == {(0, 1), (1, 2)}


def test_strict_lookup_names_what_is_missing(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="2 .missing"):
        joins.strict_lookup(left, right, "k")
    with pytest.raises(ValueError, match="1 .ambiguous"):
        joins.strict_lookup(left.where("k = 1"), right.union(right), "k")


def test_samples(spark):
    p = spark.range(10).withColumnRenamed("id", "point_index")
    assert [r[0] for r in sampling.budget_sample(p, 10, 4).orderBy("point_index").collect()] == [0, 3, 6, 9]
    assert sampling.budget_sample(p, 10, None).count() == 10
    with pytest.raises(ValueError):
        sampling.budget_sample(p, 10, 0)


def test_labels_with_missing_values(spark):
    rows = spark.createDataFrame([("TREE_1", None, None, None, None, None, None), ("TREE_2", "READY_FOR_FIELD_USE", None, "STANDARD_DBH_1_30", True, None, "CURRENT_PROTOCOL_FINAL"), ("TREE_3", "CHECK_ON_SITE", True, None, None, None, None), ("X", "OTHER", False, None, False, 3.0, None)], "tree_id string, field_aid_status string, operationally_excluded boolean, measurement_kind string, field_aid_is_current_protocol_final boolean, field_aid_dbh_cm double, field_aid_source string").withColumn("legacy_measurement_rule", F.lit(None).cast("string"))
    got = rows.select(labels.status_label().alias("s"), labels.status_class().alias("c"), labels.badge_class().alias("b"), labels.dot_class().alias("d"), labels.diameter_label().alias("l"), labels.short_id().alias("i"), labels.status_text().alias("t"), labels.kind_text().alias("k"), labels.diameter_note().alias("n")).collect()
    assert [r["s"] for r in got] == [labels.UNKNOWN_STATUS, labels.FINAL_LABEL, labels.EXCLUDED_LABEL, "OTHER"]
    assert [r["c"] for r in got] == ["none", "ready", "excluded", "none"] and [r["b"] for r in got] == ["review", "", "provisional", "review"]
    assert [r["i"] for r in got] == ["1", "2", "3", "X"] and got[3]["l"] == "DBH estimate" and [r["d"] for r in got] == ["", "final", "", ""]


def test_text_formats(spark):
    r = one(spark, labels.grouped_number(F.lit(1234.5), 2).alias("a"), labels.grouped_number(F.lit(1200.0), 0).alias("b"), labels.grouped_number(F.lit(0.1), 3).alias("c"), labels.fixed(F.lit(2.0), 2).alias("d"), labels.fixed(F.lit(None).cast("double"), 2).alias("e"), labels.hex_color(F.lit(255)).alias("f"), labels.utc_stamp(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("g"), labels.safe_path(F.lit("//a/b.json")).alias("h"), labels.safe_path(F.lit("/a/../../b")).alias("i"), labels.optional_text(F.lit("  x ")).alias("j"), labels.link_tree(F.lit("https://h/p?tree=TREE%5F1")).alias("k"), labels.grouped_number(F.lit(1000.0), 2).alias("l"))
    assert list(r) == ["1,234.5", "1,200", "0.1", "2.00", "—", "0000ff", "20260102T030405Z", "a/b.json", None, "x", "TREE_1", "1,000"]
    q = spark.createDataFrame([(["a", "b", "c", "d"], "TREE 1"), (None, "T")], "qa_reason_codes array<string>, tree_id string").select(labels.top_reasons().alias("q"), labels.query_link("v").alias("u")).collect()
    assert [tuple(x) for x in q] == [("a · b · c", "v?tree=TREE+1"), ("—", "v?tree=T")]


# Sources and sinks


def las_file(path, n, fmt=2, padding=0, most=65535, seed=0):
    rng = np.random.default_rng(seed)
    raw, rgb = rng.integers(-50_000, 50_000, (n, 3)).astype(np.int32), rng.integers(0, most + 1, (n, 3)).astype(np.uint16)
    if n:
        rgb[0, 0] = most
    las.write_las(str(path), raw, rgb, (0.001,) * 3, (100.0, 200.0, -5.0), fmt, padding)
    return raw, rgb


@pytest.mark.parametrize("fmt,padding,n", [(2, 0, 1000), (3, 4, 257), (2, 3, 1), (2, 0, 0)])
def test_las_round_trip(spark, tmp_path, fmt, padding, n):
    raw, rgb = las_file(tmp_path / "a.las", n, fmt, padding)
    rows = las.read_las(spark, str(tmp_path / "a.las"), partition_rows=300).orderBy("point_index").collect()
    assert len(rows) == n
    for r, p, c in zip(rows, raw, rgb, strict=True):
        assert (r["x"], r["y"], r["z"]) == (p[0] * 0.001 + 100.0, p[1] * 0.001 + 200.0, p[2] * 0.001 - 5.0) and (r["r"], r["g"], r["b"]) == tuple(c)


def test_las_pruning_window_and_stride(spark, tmp_path):
    raw, _ = las_file(tmp_path / "a.las", 1000)
    some = las.read_las(spark, str(tmp_path / "a.las"), ["point_index", "x"], step=7, window=(80.0, 120.0, 190.0, 210.0), partition_rows=128)
    x, y = raw[:, 0] * 0.001 + 100.0, raw[:, 1] * 0.001 + 200.0
    want = [i for i in range(0, 1000, 7) if 80 <= x[i] < 120 and 190 <= y[i] < 210]
    assert sorted(r["point_index"] for r in some.collect()) == want and some.columns == ["point_index", "x"]


def test_las_rejects(spark, tmp_path):
    (tmp_path / "bad.las").write_bytes(b"nope" + bytes(300))
    with pytest.raises(ValueError, match="not a LAS"):
        las.checked_header(str(tmp_path / "bad.las"))
    las_file(tmp_path / "f.las", 2)
    data = bytearray((tmp_path / "f.las").read_bytes())
    data[104] = 7
    (tmp_path / "f.las").write_bytes(data)
    with pytest.raises(ValueError, match="format 7"):
        las.checked_header(str(tmp_path / "f.las"))
    data[104], data[105] = 2, 25
    (tmp_path / "f.las").write_bytes(data)
    with pytest.raises(ValueError, match="too short"):
        las.checked_header(str(tmp_path / "f.las"))
    with pytest.raises(ValueError):
        convert.sample_las(spark, str(tmp_path / "f.las"), 0)


@pytest.mark.parametrize("n,most", [(10, 255), (10, 256), (4, 65535), (1, 255)])
def test_conversion(spark, tmp_path, n, most):
    raw, rgb = las_file(tmp_path / "a.las", n, most=most)
    done = convert.convert(spark, str(tmp_path / "a.las"), str(tmp_path / "out"), max_points=4, buffers=True)
    step = max(1, -(-n // 4))
    keep = np.arange(0, n, step)
    xyz = raw[keep] * 0.001 + np.array([100.0, 200.0, -5.0])
    want = (xyz - (xyz.min(0) + xyz.max(0)) / 2).astype("<f4")
    rows = done.orderBy("point_index").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in rows], want, atol=1e-6)
    colour = rgb[keep] >> 8 if rgb[keep].max() > 255 else rgb[keep]
    assert [[r["r"], r["g"], r["b"]] for r in rows] == colour.tolist()
    meta = json.loads((tmp_path / "out/metadata.json").read_text())
    assert (meta["points"], meta["samplingStride"], meta["sourcePointCount"]) == (len(keep), step, n)
    back = buffers.read_cloud(spark, str(tmp_path / "out/positions-*.glbin"), str(tmp_path / "out/colors.glbin")).orderBy("point_index").collect()
    assert np.array_equal(np.array([[r["x"], r["y"], r["z"]] for r in back]), want.astype(float)) and [[r["r"], r["g"], r["b"]] for r in back] == colour.tolist()
    position = documents.attribute(documents.read_document(spark, str(tmp_path / "out/metadata.json"), documents.METADATA), "position").first()
    assert position["bufferView"]["byteLength"] == 12 * len(keep)


def test_archive_is_idempotent(spark, tmp_path):
    las_file(tmp_path / "a.las", 500)
    row = archive.archive(spark, str(tmp_path / "a.las"), str(tmp_path / "out"), preview_points=100, least_free=0).first()
    assert row["pointCount"] == 500 and row["previewDecimationStep"] == 5
    assert spark.read.parquet(str(tmp_path / "out/full")).count() == 500 and spark.read.parquet(str(tmp_path / "out/preview")).count() == 100
    before = (tmp_path / "out/source-info.json").stat().st_mtime_ns
    archive.archive(spark, str(tmp_path / "a.las"), str(tmp_path / "out"), preview_points=50, least_free=0)
    assert (tmp_path / "out/source-info.json").stat().st_mtime_ns == before and spark.read.parquet(str(tmp_path / "out/preview")).count() == 100
    with pytest.raises(OSError):
        archive.require_space(spark, str(tmp_path), 1 << 60)
    assert sinks.publish_checksum(str(tmp_path / "a.las")) == row["sourceSha256"]
    assert documents.required_count(spark.createDataFrame([('{"summary":{"num_points":5}}',)], "json string")) == 5
    with pytest.raises(ValueError):
        documents.required_count(spark.createDataFrame([('{"summary":{}}',)], "json string"))


def test_notes(spark, tmp_path):
    path = str(tmp_path / "notes")
    new = lambda *rows: spark.createDataFrame(rows, "title string, content string")
    with pytest.raises(ValueError):
        notes.append(spark, path, new(("ok", None), ("  ", "x")))
    assert [tuple(r)[:3] for r in notes.append(spark, path, new((" a ", None), ("b", " c "))).collect()] == [(1, "a", ""), (2, "b", "c")]
    notes.append(spark, path, new(("d", "e")))
    assert [r["id"] for r in notes.newest(spark.read.parquet(path), 2).collect()][0] in (2, 3) and notes.newest(spark.read.parquet(path)).count() == 3


# Index and browsing


def write_index(root, records, markings, bom=False):
    (root / "markings").mkdir(exist_ok=True)
    (root / "m.json").write_text(("﻿" if bom else "") + json.dumps({"records": records}), encoding="utf-8")
    for name, m in markings.items():
        (root / "markings" / name).write_text(json.dumps(m))


PLANE = {"center_xyz": [1.0, 2.0, 3.0], "basis_u": [1.0, 0.0, 0.0], "basis_v": [0.0, 1.0, 0.0]}
CIRCLE = {"center": [0.1, 0.2], "radius_m": 0.1234567, "ellipse": {"valid": False, "center": [9, 9]}}


def records():
    r = lambda i, **k: {"tree_id": f"TREE_{i:04d}", "marking_url": f"/markings/{i}.json", "field_aid_status": "READY_FOR_FIELD_USE", "field_aid_circumference_cm": 10.005} | k
    return [r(2), r(1, operationally_excluded=True), r(3, field_aid_status="NO_ESTIMATE", operationally_excluded=False), r(4, qa_reason_codes=["a"], point_count=7), r(5, field_aid_circumference_cm=None)]


MARKINGS = {"1.json": {"measurement_plane": PLANE, "fit": CIRCLE}, "2.json": {"measurement_plane": PLANE, "fit": CIRCLE, "display_points_xyz": [[1, 2, 3]]}, "3.json": {"measurement_plane": PLANE, "field_aid_fit": CIRCLE}, "4.json": {"measurement_plane": {"center_xyz": [0, 0, 0]}, "fit": CIRCLE}, "5.json": {"measurement_plane": PLANE, "fit": {"center": None}}}


def test_index(spark, tmp_path):
    write_index(tmp_path, records(), MARKINGS, bom=True)
    done = index.publish(spark, str(tmp_path / "m.json"), str(tmp_path), str(tmp_path / "out"))
    rows = {r["tree_id"]: r for r in done.collect()}
    assert [rows[f"TREE_000{i}"]["renderable"] for i in (1, 2, 3, 4, 5)] == [False, True, False, False, False]
    assert rows["TREE_0002"]["field_aid_circumference_cm"] == 10.01 and rows["TREE_0002"]["fit"]["radius_m"] == 0.123457 and rows["TREE_0002"]["fit"]["ellipse"] is None
    assert rows["TREE_0002"]["plane"]["axis_direction"] == [0.0, 0.0, 1.0] and rows["TREE_0004"]["plane"] is None and rows["TREE_0005"]["fit"] is None
    assert rows["TREE_0004"]["qa_reason_codes"] == ["a"] and rows["TREE_0001"]["qa_reason_codes"] == [] and rows["TREE_0001"]["point_count"] == 0
    doc = json.loads((tmp_path / "out/viewer-index.json").read_text())
    assert [r["tree_id"][-1] for r in doc["records"]] == ["2", "1", "3", "4", "5"] and doc["viewer_summary"] == {"record_count": 5, "renderable_ring_count": 1, "marker_only_count": 4}
    assert doc["records"][0]["legacy_circumference_cm"] is None and "legacy_circumference_cm" in doc["records"][0]
    assert [r["tree_id"] for r in browse.listing(done, "READY", " tree_").collect()] == ["TREE_0002", "TREE_0004", "TREE_0005"]
    assert browse.listing(done, "FIELD_READY", facets=browse.REVIEW_FACETS).count() == 4 and browse.listing(done, "nonsense").count() == 5
    assert browse.selected(done, "tree_0004").first()["tree_id"] == "TREE_0004" and browse.selected(done, "tree_0004", any_case=False).first()["tree_id"] == "TREE_0002" and browse.selected(done, None).first()["tree_id"] == "TREE_0002"
    ring = browse.outlines(done, 96, closed=True).where("tree_id = 'TREE_0002'").orderBy("i").collect()
    assert len(ring) == 97 and np.allclose([ring[0][c] for c in "xyz"], [ring[96][c] for c in "xyz"]) and browse.disc(done).where("tree_id = 'TREE_0002'").count() == 81


def test_index_is_all_or_nothing(spark, tmp_path):
    write_index(tmp_path, [*records(), {"tree_id": "A", "marking_url": "/markings/none.json"}, {"tree_id": "B"}, {"tree_id": "C", "marking_url": "/../x.json"}], MARKINGS)
    with pytest.raises(ValueError, match="A: no marking; B: no marking_url; C: unsafe"):
        index.publish(spark, str(tmp_path / "m.json"), str(tmp_path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    (tmp_path / "bad.json").write_text('{"records": null}')
    with pytest.raises(Exception, match="records must be an array"):
        documents.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_kpis_and_coordinates(spark):
    s = spark.createDataFrame([(26, 3, None)], "a int, b int, c int")
    assert tuple(browse.kpis(s, "a", "b", "c").first()) == (26, 3, 23)
    assert one(spark, browse.largest_coordinate(F.array(F.array(F.lit(1.0), F.lit(-3.0)), F.array(F.lit(2.0)))).alias("m"))["m"] == 3.0


# Clouds


def test_crown_and_ground(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(4000) * 2, rng.random(4000)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    m = clouds.crown_metrics(df, ["k"]).first()
    assert abs(m["hull_area"] - 2) < 0.2 and abs(m["spread_x"] - 1.96) < 0.05
    ground = spark.createDataFrame([(float(a), float(b), float(1 + 0.1 * a - 0.2 * b + (5.0 if i % 50 == 0 else 0.0))) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)) * 2)], "x double, y double, z double")
    p = clouds.ground_plane(ground, 0.0, 0.0, 0.5, 4.0)
    assert abs(p["z"] - 1) < 0.05 and abs(p["slope_x"] - 0.1) < 0.02 and abs(p["slope_y"] + 0.2) < 0.02
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (9, 9), (8, 9)], "ix long, iy long")
    assert sorted(map(tuple, clouds.largest_component(cells).collect())) == [(0, 0), (1, 1), (2, 1)]


def forest(seed=3):
    rng = np.random.default_rng(seed)
    stems = [(10.0, -5.0, 0.06, 0.0), (14.0, -8.0, 0.09, 0.05), (20.0, -12.0, 0.11, 0.0), (26.0, -2.0, 0.07, -0.04), (33.0, -15.0, 0.05, 0.02)]
    rows = []
    for cx, cy, r, lean in stems:
        h, t = rng.random(6000) * 2.5, rng.random(6000) * 2 * math.pi
        rows.append(np.stack([cx + lean * h + r * np.cos(t), cy + r * np.sin(t), -6.68 + h], 1) + rng.normal(size=(6000, 3)) * 0.002)
        g = rng.uniform(-1, 1, (900, 2))
        rows.append(np.stack([cx + g[:, 0], cy + g[:, 1], -6.68 + rng.normal(size=900) * 0.01], 1))
    stub = rng.random(1500)
    rows.append(np.stack([38 + 0.06 * np.cos(stub * 40), 0 + 0.06 * np.sin(stub * 40), -6.68 + stub * 0.6], 1))
    rows.append(np.stack([rng.uniform(5, 45, 6000), rng.uniform(-25, 5, 6000), -6.68 + rng.random(6000) * 2.4], 1))
    return stems, np.concatenate(rows)


def test_detection_finds_the_known_stems(spark):
    stems, p = forest()
    cloud = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "point_index long, x double, y double, z double")
    found = detect.detect(spark, cloud).collect()
    assert len(found) == len(stems) and [r["tree_id"] for r in found] == [1, 2, 3, 4, 5]
    for r, (cx, cy, radius, lean) in zip(found, sorted(stems, key=lambda s: -s[1]), strict=True):
        assert abs(r["r"] - radius) < 0.005 and abs(r["cy"] - cy) < 0.02 and abs(r["cx"] - (cx + lean * 1.3)) < 0.03
        assert r["measurement_z"] == round(r["ground"] + 1.3, 3) and r["confidence"] == "high"


# Published invariants: counts and sums that any right run over the published data must keep


@pytest.fixture(scope="module")
def published(spark):
    """118 records with the published statuses: 41 ready, 67 to check, 2 without an estimate, 8 excluded."""
    status = ["READY_FOR_FIELD_USE"] * 41 + ["CHECK_ON_SITE"] * 67 + ["NO_ESTIMATE"] * 2 + ["EXCLUDED_CONFIRMED_WRONG"] * 8
    rows = []
    for i, s in enumerate(status):
        accepted = i < 26 or i in (110, 111, 112)  # 29 legacy records, of which 3 are excluded
        final = 26 <= i < 30  # 2 standard and 2 prop-root
        kind = "PROP_ROOT_PLUS_030" if i in (28, 29, 41, 42) else "STANDARD_DBH_1_30" if i in (26, 27) else None
        rule = ("STANDARD_1_30" if i < 18 else "ADAPTIVE_IRREGULAR_ZONE_PLUS_030") if accepted else None
        rows.append((i, f"TREE_{i:04d}", s, i >= 110, "FINAL_LIDAR_ESTIMATE" if final else "NEEDS_LIDAR_REVIEW", kind, "ACCEPTED" if accepted else None, rule, None if i >= 108 else 30.0, i < 108))
    return spark.createDataFrame(rows, "record_index long, tree_id string, field_aid_status string, operationally_excluded boolean, acceptance_status string, measurement_kind string, legacy_full_resolution_status string, legacy_measurement_rule string, field_aid_circumference_cm double, renderable boolean")


def test_statuses_partition_the_records(published):
    n = {r["facet"]: r["n"] for r in browse.facet_counts(published).collect()}
    assert n["READY"] + n["CHECK"] + n["NO_ESTIMATE"] + n["EXCLUDED"] == n["ALL"] == 118 and (n["READY"], n["CHECK"], n["NO_ESTIMATE"], n["EXCLUDED"]) == (41, 67, 2, 8)
    assert n["LEGACY"] == 29 - 3 and n["FINAL"] == 4 and n["PROP_ROOT"] == 4 and n["MEASURED"] <= n["READY"] + n["CHECK"]
    review = {r["facet"]: r["n"] for r in browse.facet_counts(published, browse.REVIEW_FACETS).collect()}
    assert review["HAS_ESTIMATE"] == 108 and review["LEGACY_STANDARD"] + review["LEGACY_ADAPTIVE"] == 26
    ids = lambda df: sorted(r["tree_id"] for r in df.collect())
    assert len(ids(browse.in_both(published, "PROP_ROOT", "READY"))) == 2 == len(ids(browse.in_both(published, "PROP_ROOT", "CHECK")))
    assert ids(browse.only_in(published, "FINAL", "READY")) == [] == ids(browse.only_in(published, "LEGACY", "READY"))  # both within the ready ones
    counts = index.status_counts(published, "acceptance_status").first()[0]
    assert sum(counts.values()) == 118 and index.summary(published).first()["record_count"] == 118
    listed = [r["tree_id"] for r in index.ids_where(published, labels.equals("field_aid_status", "CHECK_ON_SITE")).orderBy("pos").collect()]
    assert listed == sorted(set(listed)) and len(listed) == 67


def test_published_sizes(spark, tmp_path):
    points, budget = 67_177_038, 3_000_000
    step = one(spark, geo.step_for(F.lit(points), F.lit(budget)).alias("s"))["s"]
    kept = -(-points // step)
    assert (step, kept, 12 * kept, 4 * kept) == (23, 2_920_741, 35_048_892, 11_682_964)
    assert len(las.las_bytes(np.zeros((5, 3), np.int32), np.zeros((5, 3), np.uint16), (1, 1, 1), (0, 0, 0))) == 227 + 26 * 5 and 227 + 26 * points == 1_746_603_215
    r = one(spark, geo.circumference(F.lit(0.1117)).alias("c"), geo.dbh_cm(F.lit(0.1117)).alias("d"))
    assert abs(r["c"] - 0.702) < 5e-4 and abs(r["d"] - 22.34) < 1e-9
    las_file(tmp_path / "a.las", 90)
    done = convert.convert(spark, str(tmp_path / "a.las"), str(tmp_path / "out"), 90, buffers=True)
    box = done.agg(*(f(c) for c in "xyz" for f in (F.min, F.max))).first()
    assert all(abs(box[2 * k] + box[2 * k + 1]) < 1e-4 for k in range(3))  # recentred
    meta = documents.read_document(spark, str(tmp_path / "out/metadata.json"), documents.METADATA)
    position = documents.attribute(meta, "position").first()
    assert position["bufferView"]["uri"].endswith("00.glbin") and position["bufferView"]["byteLength"] == sum((tmp_path / f"out/positions-0{k}.glbin").stat().st_size for k in range(3))
    assert documents.total_bytes(meta).first()["n_bytes"] == 16 * 90 and buffers.read_positions(spark, str(tmp_path / "out/positions-*.glbin")).count() == 90


# What fails, what stays, and what reaches the reader


def test_filters_reach_the_point_reader(spark, tmp_path):
    raw, _ = las_file(tmp_path / "a.las", 1000)
    some = las.read_las(spark, str(tmp_path / "a.las"), partition_rows=100).where("point_index >= 730 AND point_index < 790 AND x > 100 AND z < 0")
    assert some.rdd.getNumPartitions() == 1  # eight of ten ranges can't hold such an index
    x, z = raw[:, 0] * 0.001 + 100.0, raw[:, 2] * 0.001 - 5.0
    assert sorted(r["point_index"] for r in some.collect()) == [i for i in range(730, 790) if x[i] > 100 and z[i] < 0]
    assert las.read_las(spark, str(tmp_path / "a.las")).where("point_index > 5000").count() == 0


def test_what_a_crashed_job_left_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.publish(spark.range(5), path) and not sinks.publish(spark.range(9), path) and spark.read.parquet(path).count() == 5
    (tmp_path / "t/_SUCCESS").unlink()
    assert sinks.publish(spark.range(9), path) and spark.read.parquet(path).count() == 9


def test_two_writers_of_notes(spark, tmp_path):
    path, new = str(tmp_path / "notes"), spark.createDataFrame([("a", None)], "title string, content string")
    notes.append(spark, path, new)
    with notes.locked(spark, path), pytest.raises(RuntimeError, match="written to"):
        notes.append(spark, path, new)
    assert [r["id"] for r in notes.append(spark, path, new).collect()] == [2]


def test_paths_links_and_stamps(spark):
    paths = {"/a/../b": "b", "/a/./b//c": "a/b/c", "/..": None, "/a/..": None, "": None, "/a/../../b/c": None}
    got = one(spark, *(labels.safe_path(F.lit(p)).alias(f"p{k}") for k, p in enumerate(paths)), labels.safe_path(F.lit(None).cast("string")).alias("n"))
    assert list(got) == [*paths.values(), None]
    r = one(spark, labels.link_tree(F.lit("https://h/?tree=%zz")).alias("a"), labels.decoded_path(F.lit("/%2e%2e/x")).alias("b"), labels.decoded_path(F.lit("/a%2Fb+c")).alias("c"))
    assert list(r) == [None, None, "a/b+c"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Bangkok")
        assert one(spark, labels.utc_stamp(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("s"))["s"] == "20260101T200405Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_the_message_of_a_failed_build_has_all_failures(spark, tmp_path):
    write_index(tmp_path, [{"tree_id": f"T{k}"} for k in range(30)], MARKINGS)
    with pytest.raises(ValueError, match="30 of the records.*T0: no marking_url.*T29: no marking_url"):
        index.publish(spark, str(tmp_path / "m.json"), str(tmp_path), str(tmp_path / "out"))


def test_numbering_spans_ranges(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)] + [(5,)] * 3, "k int")
    got = [(r["k"], r["n"]) for r in sampling.numbered(rows, ["k"], "n").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(1, 1004)) and [k for k, _ in got] == sorted(k for k, _ in got)
    assert sampling.numbered(rows.where("k < 0"), ["k"], "n").collect() == []


def test_alignment_by_the_first_point(spark):
    full = spark.createDataFrame([(0, 10.0, 20.0, 30.0), (1, 11.0, 22.0, 33.0)], "point_index long, x double, y double, z double")
    assert sorted(tuple(r) for r in clouds.aligned(clouds.recentred(full), full).collect()) == [(0, 10.0, 20.0, 30.0), (1, 11.0, 22.0, 33.0)]


def test_nearest_in_blocks(spark):
    from stemspark.operators import vectors

    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 5))
    v[7] = v[60]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(200, None)], "k long, v array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(2) + np.diag([np.inf] * 90)
    for block in (13, 4096):
        got = {r["query_id"]: (r["nearest_id"], r["distance"]) for r in vectors.nearest_in_blocks(df.where("k % 3 = 0"), df, "k", "v", block).collect()}
        assert set(got) == set(range(0, 90, 3)) and all(got[k][0] == d[k].argmin() and abs(got[k][1] - math.sqrt(d[k].min())) < 1e-9 for k in got)


def test_discovery_takes_the_named_file_or_the_first(tmp_path):
    for name in ("b.las", "a.las"):
        las_file(tmp_path / name, 3)
    assert archive.discover(str(tmp_path)).endswith("a.las") and archive.discover(str(tmp_path / "b*.las")).endswith("b.las") and archive.discover(str(tmp_path), str(tmp_path / "b.las")).endswith("b.las")
    with pytest.raises(FileNotFoundError):
        archive.discover(str(tmp_path / "c*.las"))
