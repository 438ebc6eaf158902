"""Invariants, edge cases and files of the drawing operators."""

import hashlib
import io
import json
import math
import random
import struct
import tarfile
import tracemalloc
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import dims, geometry, svg, text
from plumbline.functions.pathboxes import path_boxes
from plumbline.operators import annotate, decode, losses, routing, samples, stats, targets
from plumbline.plans import catalog
from plumbline.sources import files, images, legacy
from plumbline.streaming import build, totals
from tests.conftest import SF


def boxes(spark, rows):
    return spark.createDataFrame(rows, "scene_id long, ord int, sid int, iid int, x0 double, y0 double, x1 double, y1 double")


def test_stuff_stays_apart_or_merges_by_class(spark):
    rows = [(1, 0, 1, -1, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, -1, 20.0, 20.0, 40.0, 40.0), (1, 2, 5, 7, 0.0, 0.0, 9.0, 9.0), (1, 3, 5, 7, 50.0, 1.0, 60.0, 9.0), (1, 4, 36, 1, 0.0, 0.0, 50.0, 50.0)]
    by_path = {(r.sid, r.ord): r for r in annotate.annotated(boxes(spark, rows), 100, 100, 100.0, 100.0).collect()}
    assert set(by_path) == {(1, 0), (1, 1), (5, 2), (36, 4)}
    assert by_path[5, 2].px1 == 60 and by_path[36, 4].class_name == "class_36" and by_path[36, 4].class_id == -1
    merged = {r.sid: r for r in annotate.annotated(boxes(spark, rows), 100, 100, 100.0, 100.0, "by_class").collect()}
    assert set(merged) == {1, 5} and merged[1].px1 == 40


def test_least_size_and_truncation(spark):
    rows = [(1, 0, 1, -1, 0.0, 0.0, 8.0, 8.0), (1, 1, 1, -1, 0.0, 0.0, 7.99, 8.0), (1, 2, 1, -1, -0.9, -3.0, 20.0, 200.0)]
    found = {r.ord: r for r in annotate.annotated(boxes(spark, rows), 100, 100, 100.0, 100.0).collect()}
    assert set(found) == {0, 2} and (found[2].px0, found[2].py0, found[2].py1) == (0, 0, 100)


def test_unknown_modes_and_splits_are_errors(spark):
    with pytest.raises(ValueError):
        annotate.annotated(boxes(spark, []), 1, 1, 1.0, 1.0, "other")
    with pytest.raises(ValueError):
        dims.source_dirs("validation")
    with pytest.raises(ValueError):
        geometry.output_grid(510, 8)
    assert geometry.output_grid(512, 8) == 64 and dims.source_dirs("train") == ("train_set_1", "train_set_2")


def test_target_invariants(spark):
    heat = catalog._heat(spark, SF)
    centres = targets.centre_cells(catalog._centres(spark, SF))
    at = centres.join(heat, list(targets.KEYS), "left")
    assert at.where("heat is null or heat <> 1").count() == 0
    assert centres.where("dx < 0 or dx >= 1 or dy < 0 or dy >= 1 or w <= 0 or h <= 0").count() == 0
    assert heat.where("x < 0 or x > 63 or y < 0 or y > 63 or heat <= 0 or heat > 1").count() == 0


def test_full_width_box_ends_at_the_last_input_pixel(spark):
    one = annotate.annotated(boxes(spark, [(1, 0, 1, 1, 0.0, 0.0, 100.0, 100.0)]), 100, 100, 100.0, 100.0)
    row = targets.projected(one, 100, 100).first()
    assert (row.ix0, row.ix1) == (0.0, 511.0)
    back = decode.boxes(targets.centre_cells(targets.projected(one, 100, 100))).first()
    assert math.isclose(back.x1, 511.0) and math.isclose(back.x0, 0.0)


def test_collision_keeps_the_later_of_equal_areas_and_both_boxes(spark):
    rows = [(1, 0, 1, 1, 10.0, 10.0, 30.0, 30.0), (1, 1, 1, 2, 10.0, 10.0, 30.0, 30.0)]
    centres = targets.projected(annotate.annotated(boxes(spark, rows), 100, 100, 100.0, 100.0), 100, 100)
    won = targets.centre_cells(centres).collect()
    assert [(r.ord, r.n_centres) for r in won] == [(1, 2)]
    assert len(targets.kept_boxes(centres).first().boxes) == 2


def test_cells_of_samples_that_batches_cut_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(None if s == 3 else s, c, i, int(x), int(y), int(r), float(w), float(w) / 2, 0.25, 0.5) for s in range(5) for c in range(3) for i, (x, y, r, w) in enumerate(zip(*rng.integers(0, 64, (2, 40)), rng.integers(1, 9, 40), rng.integers(1, 30, 40)))]
    rows += [(9, 0, i, 5, 63, 1 + i % 4, 3.0, 4.0, 0.5, 0.5) for i in range(300)]
    centres = spark.createDataFrame(rows, "scene_id long, class_id int, ord int, x int, y int, radius int, w double, h double, dx double, dy double")
    heat, won = {}, {}
    for s, c, i, x, y, r, w, h, _, _ in rows:
        for gy in range(-r, r + 1):
            for gx in range(-r, r + 1):
                if 0 <= x + gx < 64 and 0 <= y + gy < 64:
                    v = math.exp(-(gx * gx + gy * gy) / (2 * max(r / 3, 0.5) ** 2))
                    heat[s, c, y + gy, x + gx] = max(v, heat.get((s, c, y + gy, x + gx), 0))
        won[s, c, y, x] = max((w * h, i, w), won.get((s, c, y, x), (0, 0, 0)))
    with_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7", lambda: check_cells(centres, heat, won))


def with_conf(spark, key, value, run):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        run()
    finally:
        spark.conf.set(key, before)


def check_cells(centres, heat, won):
    found = targets.target_cells(centres).collect()
    assert len(found) == len(heat) and all(math.isclose(r.heat, heat[r.scene_id, r.class_id, r.y, r.x], rel_tol=1e-12) for r in found)
    assert {(r.scene_id, r.class_id, r.y, r.x): r.w for r in found if r.mask} == {k: v[2] for k, v in won.items()}
    assert all(r.w is None and r.dx is None for r in found if not r.mask)
    assert {tuple(r) for r in targets.heat_cells(centres).collect()} == {(r.scene_id, r.class_id, r.y, r.x, r.heat) for r in found}
    scored = targets.target_cells(centres).select(*targets.KEYS, F.col("heat").alias("score"))
    near = lambda k: [heat.get((*k[:2], k[2] + i, k[3] + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    score = {(r.scene_id, r.class_id, r.y, r.x): r.heat for r in found}
    heat.update(score)
    peaks = {k for k, v in score.items() if v == max(near(k))}
    for together in (True, False):
        assert {(r.scene_id, r.class_id, r.y, r.x) for r in decode.local_maxima(scored, together=together).collect()} == peaks


def test_cells_are_not_sent_or_sorted(spark):
    for query in ("local_maxima", "heatmap_target", "class_best_score", "focal_loss", "total_loss"):
        plan = catalog.QUERIES[query](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        # What is above the pass that makes cells: sums and ranks of whole samples or classes only.
        above = plan[: plan.rindex("MapInArrow")]
        assert "Window" not in above and "SortMergeJoin" not in above and "Expand" not in above and "Generate" not in plan


def test_maxima_match_a_dense_filter(spark):
    rng = np.random.default_rng(3)
    grid = np.where(rng.random((64, 64)) < 0.2, np.round(rng.random((64, 64)), 1), 0)
    cells = spark.createDataFrame([(1, 0, y, x, float(grid[y, x])) for y, x in np.argwhere(grid).tolist()], "scene_id long, class_id int, y int, x int, score double")
    padded = np.pad(grid, 1, constant_values=-np.inf)
    best = np.max([padded[i : i + 64, j : j + 64] for i in range(3) for j in range(3)], axis=0)
    expected = {(y, x) for y, x in zip(*np.nonzero((grid == best) & (grid > 0)))}
    assert {(r.y, r.x) for r in decode.local_maxima(cells).collect()} == expected


def test_ends_of_rows_are_no_neighbours(spark):
    rows = [(1, 0, 5, 63, 0.5), (1, 0, 6, 0, 0.9), (1, 0, 8, 0, 0.4), (1, 0, 6, 63, 0.6), (1, 1, 5, 62, 0.1), (2, 0, 5, 62, 0.2)]
    cells = spark.createDataFrame(rows, "scene_id long, class_id int, y int, x int, score double")
    kept = {(r.scene_id, r.class_id, r.y, r.x) for r in decode.local_maxima(cells).collect()}
    assert kept == {(1, 0, 6, 0), (1, 0, 8, 0), (1, 0, 6, 63), (1, 1, 5, 62), (2, 0, 5, 62)}


def test_focal_loss_from_listed_cells_equals_the_dense_one(spark):
    rng = np.random.default_rng(5)
    target, score = np.zeros((64, 64)), np.zeros((64, 64))
    for y, x in rng.integers(0, 64, (40, 2)):
        target[y, x], score[y, x] = round(float(rng.random()), 3), float(rng.random())
    target[3, 4], score[3, 4] = 1.0, 0.7
    listed = [(1, 0, y, x, float(score[y, x]), float(target[y, x])) for y, x in np.argwhere((target > 0) | (score > 0)).tolist()]
    cells = spark.createDataFrame(listed, "scene_id long, class_id int, y int, x int, score double, heat double").withColumn("b", F.lit(1))
    p = np.clip(score, 1e-4, 1 - 1e-4)
    dense = -(np.where(target == 1, np.log(p) * (1 - p) ** 2, np.log(1 - p) * p**2 * (1 - target) ** 4)).sum() / (target == 1).sum()
    assert math.isclose(losses.focal(losses.focal_sums(cells, ["b"]), ["b"]).first().focal, dense, rel_tol=1e-9)
    none = cells.withColumn("heat", F.lit(0.0))
    mean = -(np.log(1 - p) * p**2).mean()
    assert math.isclose(losses.focal(losses.focal_sums(none, ["b"]), ["b"]).first().focal, mean, rel_tol=1e-9)


def test_draws_follow_the_weights(spark):
    rows = spark.createDataFrame([(i, 0 if i < 900 else 1) for i in range(1000)], "idx long, class_id int")
    share = samples.weighted_draws(rows).where("class_id = 1").count() / 1000
    assert abs(share - 10 / 40) < 0.05
    assert samples.weighted_draws(rows).count() == 1000


def test_draws_by_given_weights(spark, monkeypatch):
    """Frequencies follow the weights, however uneven; heavy samples are dealt in pieces; nothing without a weight is drawn."""
    for block in (65_536, 50):
        monkeypatch.setattr(samples, "RANK_BLOCK", block)
        weights = {i: (0.0 if i % 11 == 0 else None if i % 13 == 0 else 400.0 if i == 5 else 1.0 + i % 3) for i in range(600)}
        rows = spark.createDataFrame(list(weights.items()), "idx long, weight double").repartition(3)
        found = samples.draws_by_weight(rows, 20_000).collect()
        assert sorted(r.draw for r in found) == list(range(20_000))
        counts, total = Counter(r.pick for r in found), sum(w or 0 for w in weights.values())
        assert all(weights[i] for i in counts)
        for group in ([5], [i for i in weights if i % 3 == 0 and i != 5], [i for i in weights if i % 3 == 2 and i != 5]):
            share = sum(weights[i] or 0 for i in group) / total
            assert sum(counts[i] for i in group) == pytest.approx(20_000 * share, abs=5 * math.sqrt(20_000 * share))
    assert samples.draws_by_weight(rows.where("idx % 11 = 0")).count() == 0 and samples.draws_by_weight(rows.limit(0)).count() == 0
    assert samples.draws_by_weight(rows.where("idx = 5"), 7).count() == 7


def test_hot_classes_go_to_several_tasks(spark):
    rows = [(i, 3 if i % 2 else i % 5 + 10, [float(i), 1.0]) for i in range(2000)] + [(5000, 99, [1.0, 1.0]), (5001, None, [1.0, 1.0]), (5002, 3, None)]
    data = spark.createDataFrame(rows, "sample_id long, class_id int, values array<double>").repartition(4)
    kernels = routing.kernels_of(spark.createDataFrame([(c, [float(c), 2.0]) for c in (3, 10, 11, 12, 13, 14)], "class_id int, values array<double>"))
    kernel = lambda x, w: {"out": x @ w, "group": np.full(len(x), len(x))}
    found = {r.sample_id: r for r in routing.by_class(data, kernels, kernel, "out double, group long", group_rows=150).collect()}
    assert len(found) == len(rows) and all(found[i].out is None for i in (5000, 5001, 5002))
    assert all(found[i].out == i * c + 2 for i, c, _ in rows[:2000])
    # Half of all rows have class 3: dealt by hash into parts of about the size asked for.
    assert max(found[i].group for i, c, _ in rows[:2000] if c == 3) < 250
    every = routing.by_every_class(data, kernels, kernel, "out double, group long").collect()
    assert {(r.sample_id, r.class_id): r.out for r in every} == {(i, c): v[0] * c + 2 for i, _, v in rows if v for c in kernels}
    with pytest.raises(ValueError, match="classes"):
        routing.kernels_of(spark.range(1001).selectExpr("id as class_id", "array(1.0) as values"))


def test_totals_follow_a_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(f"set_{i % 3 % 2}", None if i % 10 == 0 else i % 4) for i in range(2400)] + [(None, 5)]
    listener = totals.ProgressLines()
    spark.streams.addListener(listener)
    for part in range(3):
        spark.createDataFrame(rows[part::3] if part < 2 else rows[2::3], "source_dir string, n long").repartition(3).write.parquet(f"{source}/{part}")
        # Every run starts anew from what the last one left.
        totals.follow(spark, source, target, state).awaitTermination()
    totals.follow(spark, source, target, state).awaitTermination()
    written = spark.read.parquet(target)
    expected = {(d, sum(a == d and n is not None for a, n in rows), sum(a == d and n is None for a, n in rows), sum(n or 0 for a, n in rows if a == d)) for d in ("set_0", "set_1")}
    assert {tuple(r) for r in totals.latest(written).collect()} == expected
    # A line whenever a multiple of 500 is passed, once.
    lines = [(r.source_dir, r.line) for r in written.where("line is not null").collect()]
    assert sorted(lines) == sorted(set(lines)) and max(n for d, n in lines if d == "set_0") == 1000
    spark.streams.removeListener(listener)
    assert sum("rows" in line for line in listener.lines) == 3


def test_index_is_gapless_on_any_blocks(spark):
    rows = spark.range(100).withColumn("block", F.col("id") % 7)
    found = samples.with_index(rows, ["block"], ["id"]).orderBy("block", "id").collect()
    assert [r.idx for r in found] == list(range(100))


GOLDEN = {
    "M 0 0 L 10 5": (0, 0, 10, 5),
    "m 1 1 l 2 2 -5 0": (-2, 1, 3, 3),
    "M0,0 A 5 5 0 0 1 10 0": (0, -5, 10, 0),
    "M0,0 A 5 5 0 0 0 10 0": (0, 0, 10, 5),
    "M 0 0 C 0 10 10 10 10 0": (0, 0, 10, 7.5),
    "M 0 0 C 0 10 10 10 10 0 S 20 -10 20 0": (0, -7.5, 20, 7.5),
    "M 1 1 q 5 10 10 0 t 10 0": (1, -4, 21, 6),
    "M0 0 h5 v-3 z": (0, -3, 5, 0),
}


@pytest.mark.parametrize("d", GOLDEN)
def test_path_boxes(d):
    assert svg.path_box(d) == pytest.approx(GOLDEN[d], abs=1e-9)


@pytest.mark.parametrize("d", ["", None, "M 0 0", "x", "L 1 1", "M 1", "M 0 0 C 1 1"])
def test_paths_without_a_box(d):
    assert svg.path_box(d) is None


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=6))
def test_polyline_boxes(points):
    box = svg.path_box("M " + " L ".join(f"{x} {y}" for x, y in points))
    xs, ys = zip(*points)
    assert box == (min(xs), min(ys), max(xs), max(ys))


def random_path(draw, segments, wrong):
    """Path data of all commands, numbers written in all ways, now and then one that cannot be read."""
    number = lambda: draw.choice([str(draw.randint(-50, 50)), f"{draw.uniform(-90, 90):.3f}", f".{draw.randint(0, 99)}", f"{draw.randint(1, 9)}.", f"{draw.uniform(-9, 9):.2e}", "+3", "1e1"])
    out = []
    for i in range(segments):
        command = "M" if i == 0 and draw.random() < 0.97 else draw.choice("MLHVCSQTAZ")
        size = svg.ARGUMENTS[command]
        numbers = [draw.choice("01") if command == "A" and k % 7 in (3, 4) else number() for k in range(size * draw.choice([1, 1, 2, 3]))]
        text = draw.choice([command, command.lower()])
        for k, n in enumerate(numbers[: -1 if draw.random() < wrong else None]):
            text += (draw.choice([" ", ",", ", "]) if k and not (n[0] in "+-" and draw.random() < 0.5) else "") + n
        out.append(text + (draw.choice(["x", "é", "e5", "-", "1e", ".", "..5", "--1", "2e3e4"]) if draw.random() < wrong / 2 else ""))
    return draw.choice(["", " "]).join(out)


def test_boxes_of_many_paths_equal_those_one_by_one():
    draw = random.Random(4)
    many = [random_path(draw, draw.randint(0, 9), 0.02) for _ in range(3000)] + [random_path(draw, 200, 0) for _ in range(4)] + ["", None, "M 0 0", "M 0 0z", "1 2", "M1.5.5.5e1.5L0 0", *GOLDEN]
    plain = [svg.path_box(d) for d in many]
    found = path_boxes(many)
    assert 0.1 < sum(p is None for p in plain) / len(plain) < 0.5
    for d, p, box in zip(many, plain, found.tolist()):
        assert math.isnan(box[0]) if p is None else box == pytest.approx(p, rel=1e-6, abs=1e-6), d
    # Few paths at a time go on one by one, and a path by itself is the same as among others.
    for d, box in list(zip(many, found))[::40]:
        assert np.array_equal(path_boxes([d])[0], box, equal_nan=True)
    lines = [f"M {draw.uniform(0, 99)} {draw.uniform(0, 99)} L {draw.uniform(0, 99)} {draw.uniform(0, 99)}" for _ in range(500)]
    assert path_boxes(lines).tolist() == [list(svg.path_box(d)) for d in lines]
    assert path_boxes([]).shape == (0, 4) and np.isnan(path_boxes(["", None])).all()


def test_long_drawings_are_read_in_parts(monkeypatch):
    path = b'<g><path d="M 0 0 L 1 1" semantic-id="%d" instance-id="2"/></g>'
    long = b'<svg viewBox="0 0 5 5">' + b"".join(path % (i % 30) for i in range(400_000)) + b"</svg>"
    tracemalloc.start()
    n = sum(len(part) for part in svg.elements_of(memoryview(long)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and len(long) > 24_000_000 and peak < 16_000_000
    # In parts or whole: the same elements, and none where the end is missing.
    short = b'<?xml version="1.0"?><svg viewBox="0 0 5 5"><!-- x --><g><g>' + path % 3 + b"<path/></g>" + path % 4 + b'</g><a:b xmlns:a="u" d="z" semantic-id="5" a:d="no"/></svg>'
    whole = [row for part in svg.elements_of(short) for row in part]
    assert [(r[0], r[2], r[4]) for r in whole] == [(4, "3", "0 0 5 5"), (7, "4", "0 0 5 5"), (8, "5", "0 0 5 5")]
    monkeypatch.setattr(svg, "PART_BYTES", 7)
    assert [row for part in svg.elements_of(short) for row in part] == whole
    for broken in (short[:-3], short + b"<", short.replace(b"</g>", b"", 1), b"<svg>&no;</svg>", b""):
        assert list(svg.elements_of(broken)) == []


def test_elements(spark):
    drawing = '<svg viewBox="10 10 50 50"><g><path d="M0 0L1 1" semantic-id="3" instance-id=""/><path d="M0 0L1 1"/><rect semantic-id="4"/><path d="M0 0L2 2" semantic-id="x"/><path d="M0 0L2 2" semantic-id="5" instance-id="9"/></g></svg>'
    docs = spark.createDataFrame([(1, drawing), (2, "<svg><path"), (3, None)], "scene_id long, svg string")
    assert [(r.scene_id, r.ord, r.sid, r.iid) for r in svg.elements(docs).collect()] == [(1, 2, 3, -1), (1, 6, 5, 9)]
    w, h = svg.view_size(F.col("v"))
    sizes = spark.createDataFrame([(svg.view_box(drawing),), ("0 0",), (None,)], "v string").select(w.alias("w"), h.alias("h")).collect()
    assert [tuple(r) for r in sizes] == [(50.0, 50.0), (100.0, 100.0), (100.0, 100.0)]


def test_word_ids(spark):
    words = ["Find a wall", "", " x ", "w " * 40]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")

    def ids(t):
        found = [int(hashlib.md5(w.encode()).hexdigest(), 16) % 31_999 + 1 for w in t.lower().split()][:32]
        return found + [0] * (32 - len(found))

    assert {r.i: r.ids for r in df.select("i", text.word_ids(F.col("t")).alias("ids")).collect()} == {i: ids(w) for i, w in enumerate(words)}


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_files(spark, tmp_path):
    (tmp_path / "set/sub").mkdir(parents=True)
    (tmp_path / "set/a.png").write_bytes(png(40, 30))
    (tmp_path / "set/sub/b.png").write_bytes(b"no image")
    with zipfile.ZipFile(tmp_path / "set/c.zip", "w") as z:
        z.writestr("m/x.txt", "hello")
    with tarfile.open(tmp_path / "set/d.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    (tmp_path / "set/e.zip").write_bytes(b"PK\x03\x04broken")
    folder = str(tmp_path / "set")
    assert files.listing(spark, folder, ".png").count() == 1
    found = files.located(files.listing(spark, folder, ".png", recursive=True))
    w, h = files.png_size(F.col("content"))
    assert {(r.stem, r.source_dir, r.w, r.h) for r in found.select("stem", "source_dir", w.alias("w"), h.alias("h")).collect()} == {("a", "set", 40, 30), ("b", "sub", None, None)}
    archives = files.listing(spark, folder, ".zip").union(files.listing(spark, folder, ".gz"))
    assert {(r.member, bytes(r.bytes)) for r in files.members(archives).collect()} == {("m/x.txt", b"hello"), ("y.txt", b"ok")}
    kinds = archives.select(files.file_format(F.col("content")).alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["gz", "zip", "zip"]


def drawn_png(pixels):
    """An image file of an array of height, width and channels: 1, 3 or, with transparency, 4."""
    h, w, c = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))) + chunk(b"IEND", b"")


def test_images_are_read_resized_and_overlaid(spark, tmp_path):
    rng = np.random.default_rng(5)
    drawn = {"grey": rng.integers(0, 256, (6, 9, 1), np.uint8), "rgb": rng.integers(0, 256, (4, 5, 3), np.uint8), "rgba": rng.integers(0, 256, (3, 3, 4), np.uint8)}
    for name, pixels in drawn.items():
        (tmp_path / f"{name}.png").write_bytes(drawn_png(pixels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = images.images(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"(\w+)\.png$", 1)).drop("path")
    found = {r.name: images.rgb(bytes(r.pixels), r.width, r.height, r.channels) for r in rows.collect()}
    assert set(found) == set(drawn)
    for name, pixels in drawn.items():
        assert (found[name] == (np.repeat(pixels, 3, 2) if name == "grey" else pixels[:, :, :3])).all()
    out = {r.name: np.array(r["values"]).reshape(3, 8, 8) for r in images.normalised(rows, 8).collect()}
    for name, values in out.items():
        assert np.allclose(values, images.resized(found[name], 8).transpose(2, 0, 1) / 127.5 - 1, atol=1e-6)
    heat = spark.createDataFrame([("rgb", 0, 0, 1.0), ("rgb", 1, 1, 0.5)], "name string, y int, x int, heat double")
    laid = {r.name: np.frombuffer(bytes(r.overlay), np.uint8).reshape(8, 8, 3) for r in images.overlaid(rows, heat, "name", 8, 2).collect()}
    assert (laid["grey"] == images.resized(found["grey"], 8)).all()
    base, corner = images.resized(found["rgb"], 8)[0, 0].astype(float), laid["rgb"][0, 0]
    assert (corner == np.floor(base * (85 / 255) + np.array([255, 0, 0]) * (170 / 255) + 0.5)).all()
    none = rows.withColumn("pixels", F.lit(None).cast("binary"))
    assert images.normalised(none, 8).count() == 0


def test_resizing():
    same = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (images.resized(same, 4) == same).all()
    assert (images.resized(np.full((7, 3, 3), 9, np.uint8), 5) == 9).all()
    row = np.array([0, 0, 100, 100], np.uint8).reshape(1, 4, 1).repeat(3, 2)
    # Halved: weights .75, .75, .25 of 1.75 at the ends; doubled: quarter steps.
    assert images.resized(row, 2)[0, :, 0].tolist() == [14, 86]
    assert images.resized(row[:, 1:3], 4)[0, :, 0].tolist() == [0, 25, 75, 100]


def test_legacy_metadata(spark, tmp_path):
    made = {"dataset": "d", "samples": [{"idx": i, "image_path": f"{i}.jpg", "kind": "ab"[i % 3 == 0], "note": None, "box": {"w": i}, "n": i} for i in range(9)]}
    (tmp_path / "metadata.json").write_text(json.dumps(made, indent=2))
    rows = legacy.read_samples(spark, str(tmp_path / "metadata.json"))
    assert rows.count() == 9
    assert {tuple(r) for r in legacy.label_counts(rows).collect()} == {("kind", "a", 6, "█" * 20), ("kind", "b", 3, "█" * 10)}
    assert {r.box for r in legacy.coerced(rows).collect()} == {f'{{"w":{i}}}' for i in range(9)}
    assert legacy.label_counts(rows.select("idx", "image_path", "n")).count() == 0


def test_pending_downloads(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    found = spark.createDataFrame([("a", 20_000), ("b", 10_000)], "name string, length long")
    assert {r.name for r in files.to_download(manifest, found).collect()} == {"b", "c"}


def test_incremental_build_does_each_drawing_once(spark, tmp_path):
    source, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))
    docs = catalog.svg_documents(spark, SF)
    docs.where("scene_id % 2 = 0").write.parquet(source)
    build.run_incrementally(spark, source, target, done, 1024, 768).awaitTermination()
    first = spark.read.parquet(target).count()
    docs.where("scene_id % 2 = 1").write.mode("append").parquet(source)
    build.run_incrementally(spark, source, target, done, 1024, 768).awaitTermination()
    both = spark.read.parquet(target)
    assert 0 < first < both.count() == catalog.QUERIES["instance_union"](spark, SF).count()


def test_the_last_version_of_a_drawing_counts(spark, tmp_path):
    path = '<svg><path d="M 0 0 L {0} {0}" semantic-id="1" instance-id="1"/></svg>'
    rows = [(1, path.format(20), 1), (1, path.format(60), 3), (1, path.format(40), 2), (2, path.format(30), None), (2, path.format(50), 0), (3, None, 5)]
    source, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))
    spark.createDataFrame(rows, "scene_id long, svg string, version long").repartition(4).write.parquet(source)
    build.run_incrementally(spark, source, target, done, 100, 100, version="version").awaitTermination()
    assert {(r.scene_id, r.px1) for r in spark.read.parquet(target).collect()} == {(1, 60), (2, 50)}
    found = build.last_versions(spark.createDataFrame(rows, "scene_id long, svg string, version long")).collect()
    assert {(r.scene_id, r.svg) for r in found} == {(1, path.format(60)), (2, path.format(50)), (3, None)}


def test_running_means_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(stats, "SCENE_BLOCK", 7)
    rows = [(r, i, None if i % 9 == 0 else float(i % 5)) for r in ("a", None) for i in range(50)]
    found = {(r.run, r.step): r.mean_loss for r in stats.running_mean(spark.createDataFrame([x for x in rows if x[0]], "run string, step long, loss double"), ["run"], 4).collect()}
    assert set(found) == {("a", i) for i in range(0, 50, 4)} and found["a", 0] is None
    for i in range(4, 50, 4):
        seen = [x for r, k, x in rows if r == "a" and k <= i and x is not None]
        assert found["a", i] == pytest.approx(sum(seen) / len(seen))


def test_each_drawing_has_its_own_view_and_image(spark, tmp_path):
    path = '<path d="M 5 5 L 25 45" semantic-id="1" instance-id="1"/>'
    views = {1: 'viewBox="0 0 100 100"', 2: 'viewBox="10 10 50 50"', 3: "", 4: 'viewBox="0 0"', 5: 'viewBox="0 0 0 0"', 6: 'viewBox="0 0 50 100"'}
    docs = spark.createDataFrame([(i, f"<svg {v}>{path}</svg>") for i, v in views.items()], build.DOCS)

    def pixels(df):
        return {r.scene_id: (r.px0, r.py0, r.px1, r.py1) for r in df.collect()}

    plain = (50, 100, 250, 900)
    assert pixels(build.annotated(docs, 1000, 2000)) == {1: plain, 2: (100, 200, 500, 1800), 3: plain, 4: plain, 6: (100, 100, 500, 900)}
    sizes = spark.createDataFrame([(1, 100, 200), (2, 100, 100), (3, None, 100)], "scene_id long, width int, height int")
    source, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))
    docs.write.parquet(source)
    build.run_incrementally(spark, source, target, done, 1000, 2000, sizes=sizes).awaitTermination()
    assert pixels(spark.read.parquet(target)) == {1: (5, 10, 25, 90), 2: (10, 10, 50, 90)}


def window_keys(df):
    """The keys by which each window of a plan deals its rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.findall(r"[a-z_]+(?=#)", keys) for keys in re.findall(r"^[\s:+-]*Window \[.*\], \[([^\]]*)\], \[[^\]]*\]$", plan, re.M)]


def test_ranks_and_sums_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(samples, "RANK_BLOCK", 10, raising=False)
    monkeypatch.setattr(stats, "SCENE_BLOCK", 10, raising=False)
    rows = [(i, i * 7 % 40 % 3) for i in range(200)]
    drawn = samples.weighted_draws(spark.createDataFrame(rows, "idx long, class_id int").repartition(3))
    assert ["class_id", "_block"] in window_keys(drawn)
    of_class = dict(rows)
    found = drawn.collect()
    assert sorted(r.draw for r in found) == list(range(200)) and all(of_class[r.pick] == r.class_id for r in found)
    positions = samples.with_index(spark.createDataFrame(rows, "idx long, class_id int").withColumn("b", F.expr("idx div 10")), ["b"], ["idx"], "rank", apart=("class_id",))
    members = {c: [i for i, k in rows if k == c] for c in range(3)}
    assert all(members[r.class_id][r.rank] == r.idx for r in positions.collect())

    scenes = [(d, s, n) for d in ("a", "b", None) for s, n in [(None, 4), *((i * 3, i % 5 or None) for i in range(-30, 60))]] + [("c", 1, None), ("c", 40, None), ("c", 90, 2)]
    out = stats.progress(spark.createDataFrame(scenes, "source_dir string, scene_id long, n long").repartition(4))
    assert ["source_dir", "_block"] in window_keys(out)
    expected, totals = set(), {}
    for d, s, n in sorted(scenes, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        total, done = totals.get(d, (None, 0))
        totals[d] = (total if n is None else (total or 0) + n, done + 1)
        expected.add((d, s, *totals[d]))
    assert {tuple(r) for r in out.collect()} == expected
