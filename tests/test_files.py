"""Files written and read: metadata beside drawings, the sample index, records, archives, image files."""

import io
import json
import os
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import svg
from plumbline.functions.dims import CLASS_IDS
from plumbline.operators import samples
from plumbline.plans import catalog
from plumbline.sources import archives, files, folders, images, records, sink
from tests.conftest import SF
from tests.test_drawings import drawn_png, png

BOX = '<path d="M 10 10 L 60 60" semantic-id="{sid}" instance-id="{iid}"/>'


def drawing(*paths, view="0 0 100 100"):
    return f'<svg viewBox="{view}"><g>{"".join(BOX.format(sid=s, iid=i) for s, i in paths)}</g></svg>'


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names if not n.endswith(".crc")}


@pytest.fixture
def scans(tmp_path):
    """Two folders of the train split; none of the test split."""
    made = {
        "train_set_1/a.svg": drawing((1, 1), (5, 2), (36, 3)), "train_set_1/a-1.svg": drawing((2, 1)), "train_set_2/b.svg": drawing((1, 1), (1, 2)),
        "train_set_1/empty.svg": "<svg><g/></svg>", "train_set_1/broken.svg": "<svg><path", "train_set_1/nopath.svg": '<svg><path d="" semantic-id="1"/></svg>',
        "train_set_1/small.svg": drawing((1, 1), view="0 0 9000 9000"), "train_set_1/lonely.svg": drawing((1, 1)), "elsewhere/c.svg": drawing((1, 1)),
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
        if "lonely" not in name:
            (tmp_path / name.replace(".svg", ".png")).write_bytes(png(200, 100))
    return tmp_path


def test_metadata_is_written_beside_drawings_once(spark, scans):
    before = tree(scans)
    folders.annotate_folders(spark, f"file:{scans}")
    after = tree(scans)
    new = {k: json.loads(v) for k, v in after.items() if k not in before}
    # None without a usable path, without an image, or outside the source folders; an empty list where all boxes are small.
    assert set(new) == {f"train_set_1/{n}_meta.json" for n in ("a", "a-1", "small")} | {"train_set_2/b_meta.json"}
    assert new["train_set_1/small_meta.json"] == {"image_size": [200, 100], "svg_viewbox": [0, 0, 9000, 9000], "num_instances": 0, "instances": []}
    a = new["train_set_1/a_meta.json"]
    assert a["num_instances"] == 3 and a["instances"][0] == {"class": "wall", "class_id": CLASS_IDS["wall"], "instance_id": 1, "bbox_px": [20, 10, 120, 60]}
    assert [(i["class"], i["class_id"]) for i in a["instances"]][2] == ("class_36", -1)
    assert b" " not in after["train_set_1/a_meta.json"] and all(after[k] == v for k, v in before.items())
    (scans / "train_set_2/b_meta.json").write_text("{}")
    os.remove(scans / "train_set_1/a_meta.json")
    folders.annotate_folders(spark, f"file:{scans}")
    again = tree(scans)
    assert again.pop("train_set_2/b_meta.json") == b"{}" and all(again[k] == after[k] for k in again) and len(again) == len(after) - 1


def test_metadata_by_class_needs_no_image(spark, scans):
    folders.annotate_folders(spark, str(scans), "by_class", default_size=1000)
    lonely = json.loads((scans / "train_set_1/lonely_meta.json").read_text())
    assert lonely["image_size"] == [1000, 1000] and lonely["instances"][0]["bbox_px"] == [100, 100, 600, 600]
    assert [i["class"] for i in json.loads((scans / "train_set_1/a_meta.json").read_text())["instances"]] == ["wall", "window"]


def test_sample_index(spark, scans):
    folders.annotate_folders(spark, str(scans))
    found = [tuple(r) for r in folders.sample_index(spark, str(scans), "train").orderBy("idx").collect()]
    placed = [(("train_set_1", "a-1"), "door_single"), (("train_set_1", "a"), "wall"), (("train_set_1", "a"), "window"), (("train_set_2", "b"), "wall")]
    # By folder, then path ("a-1.png" before "a.png"), then class name; unknown classes and images without instances have no sample.
    assert found == [(i, *place, name, CLASS_IDS[name]) for i, (place, name) in enumerate(placed)]
    with pytest.raises(ValueError, match="no samples"):
        folders.sample_index(spark, str(scans), "test")
    with pytest.raises(ValueError, match="unknown split"):
        folders.sample_index(spark, str(scans), "validation")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drawings_are_parsed_and_measured_in_one_pass(spark):
    texts = [drawing((1, 1), (5, 2), (36, 3)), "<svg><path", None, '<svg viewBox="0 0 7 9"><path d="" semantic-id="1"/><path d="M 1 2 L 3 4" semantic-id="x"/><path d="M 1 2 L 3 4" semantic-id="2"/></svg>', drawing(*[(2, 1)] * 30_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "scene_id int, svg string").coalesce(1)
    found = svg.boxed_paths(svg.boxed(docs, keep=("scene_id",)), "scene_id")
    apart = svg.with_boxes(svg.elements(docs, view=True)).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, apart.collect())) and found.count() == 30_004
    sized = docs.withColumns({"source_dir": F.lit("a"), "stem": F.col("scene_id").cast("string"), "width": F.lit(9), "height": F.lit(9)})
    assert plan_of(folders.sidecars(sized)).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan_of(folders.sidecars(sized))


def test_names_of_scenes_are_told_once_a_scene(spark):
    grouped = None
    for line in plan_of(files.paired(*catalog.drawing_files(spark, SF))).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        grouped = None if grouped is not None and depth <= grouped else grouped
        assert grouped is None or "regexp" not in line
        grouped = depth if grouped is None and line.lstrip(" :+-").startswith("Aggregate") else grouped


def test_first_samples_and_empty_indexes(spark):
    rows = spark.range(5).withColumnRenamed("id", "idx")
    assert [samples.first_samples(rows, n).count() for n in (0, -1, 3, 9)] == [5, 5, 3, 5]
    assert samples.required(rows).count() == 5
    with pytest.raises(ValueError, match="no samples"):
        samples.required(rows.limit(0))


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("a"), (F.col("id") * 37 % 1000).alias("b")).repartition(5)
    found = samples.ordinals(rows, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.idx)] == sorted((r.a, r.b) for r in found) and sorted(r.idx for r in found) == list(range(1000))
    assert samples.ordinals(rows.limit(0), "a", "b").count() == 0


def test_a_failed_task_leaves_no_part_of_a_file(spark, tmp_path):
    root = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise("whole").cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        sink.write_files(rows.repartition(4), str(root))
    there = tree(root)
    assert set(there.values()) <= {b"whole"} and not any("_writing" in name for name in there)
    sink.write_files(rows.where("id <> 33"), str(root))
    assert len(tree(root)) == 39


def test_files_of_several_rows_and_existing_ones(spark, tmp_path):
    parts = [("x/a", 3, b"def"), ("x/a", 0, b"abc"), ("x/a", 6, b"g"), ("y", 0, None), (None, 0, b"lost")]
    rows = spark.createDataFrame(parts, "path string, offset long, content binary").repartition(3)
    sink.write_files(rows, str(tmp_path))
    assert tree(tmp_path) == {"x/a": b"abcdefg", "y": b""}
    other = spark.createDataFrame([("y", b"new")], "path string, content binary")
    sink.write_files(other, str(tmp_path))
    assert tree(tmp_path)["y"] == b""
    sink.write_files(other, str(tmp_path), "replace")
    assert tree(tmp_path)["y"] == b"new"
    with pytest.raises(Exception, match="keep or replace"):
        sink.write_files(other, str(tmp_path), "other")
    assert tree(tmp_path)["y"] == b"new"


# -- records ----------------------------------------------------------------

COLUMNS = "id long, image binary"


def add_records(spark, folder, batch, ids):
    image = F.when(F.col("id") % 3 != 0, F.col("id").cast("string").cast("binary"))
    rows = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("image", image)
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"{folder}/batch={batch:04}")


def test_records_are_numbered_once_whenever_they_come(spark, tmp_path):
    source, target, done = (str(tmp_path / n) for n in ("in", "out", "done"))

    def run():
        stream = records.record_stream(spark, source, COLUMNS).writeStream.format("parquet").option("checkpointLocation", done).trigger(availableNow=True).start(target)
        stream.awaitTermination()
        return {(r.ordinal, r.id) for r in spark.read.parquet(target).collect()}

    expected, ids = set(), []
    for batch in range(3):
        new = list(range(batch * 50, batch * 50 + 40))
        add_records(spark, source, batch, new)
        ids += [i for i in new if i % 3]
        expected = set(enumerate(ids))
        # Each run is a restart from the checkpoint.
        assert run() == expected
    assert run() == expected
    assert {(r.ordinal, r.id) for r in records.records(spark, source, COLUMNS).collect()} == expected
    assert records.records(spark, source, COLUMNS).where("image is null").count() == 0
    assert records.records(spark, str(tmp_path / "none"), COLUMNS).count() == 0
    # A file that comes before those already read would change their numbers.
    add_records(spark, source + "/batch=0000", 0, [1])
    add_records(spark, source, 9, [1])
    with pytest.raises(Exception, match="files came or went"):
        run()


def test_row_groups_are_read_apart(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = list(range(1000))
    table = pa.table({"id": ids, "image": pa.array([None if i % 5 == 0 or 300 <= i < 400 else str(i).encode() for i in ids], pa.binary())})
    os.makedirs(tmp_path / "r")
    pq.write_table(table, tmp_path / "r/a.parquet", row_group_size=100)
    pq.write_table(table, tmp_path / "r/b.parquet", row_group_size=100, write_statistics=False)
    found = records.records(spark, str(tmp_path / "r"), COLUMNS)
    kept = [i for i in ids if i % 5 and not 300 <= i < 400]
    assert [(r.ordinal, r.id) for r in found.orderBy("ordinal").collect()] == list(enumerate(kept * 2))
    # The row group without an image is no task.
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 18


# -- archives ---------------------------------------------------------------


def tar_bytes(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    members = {f"m/{i:04}.bin": rng.bytes(int(rng.integers(0, 400))) for i in range(1000)}
    members["m/empty"] = b""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m/", b"")
        for name, content in members.items():
            z.writestr(name, content)
    rows = archives.contents(spark, str(tmp_path), partMembers=100, rangeBytes=128)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 11
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.member, r.offset)):
        assert r.offset == len(found.get(r.member, b"")) and r.error is None and r.size == len(members[r.member]) and len(r.content) <= 128
        found[r.member] = found.get(r.member, b"") + bytes(r.content)
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert found == {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()} == members


def test_small_archives_share_a_task(spark, tmp_path):
    for i in range(30):
        with zipfile.ZipFile(tmp_path / f"{i:02}.zip", "w") as z:
            for k in range(5):
                z.writestr(f"{k}", f"{i} {k}")
    rows = archives.contents(spark, str(tmp_path), partMembers=20)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert {(r.archive, r.member, bytes(r.content)) for r in rows.collect()} == {(f"{i:02}.zip", f"{k}", f"{i} {k}".encode()) for i in range(30) for k in range(5)}


def test_ingest_goes_on_after_failures_and_does_nothing_twice(spark, tmp_path):
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips/a.zip", "w") as z:
        for name, content in {"s/x.svg": "<svg/>", "s/y.svg": "", "../out.txt": "no"}.items():
            z.writestr(name, content)
    damaged = bytearray((tmp_path / "zips/a.zip").read_bytes())
    damaged[damaged.index(b"<svg/>")] ^= 1
    (tmp_path / "zips/bad-member.zip").write_bytes(bytes(damaged))
    (tmp_path / "zips/b.tar.gz").write_bytes(tar_bytes({"t/1.png": b"1", "t/2.png": b"22"}))
    (tmp_path / "zips/c.tar.xz").write_bytes(tar_bytes({"3": b"333"}, "w:xz"))
    (tmp_path / "zips/d.zip").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "zips/e.gz").write_bytes(tar_bytes({f"{i}": os.urandom(5000) for i in range(9)})[:20_000])
    (tmp_path / "full").mkdir()
    (tmp_path / "full/keep").write_text("mine")
    (tmp_path / "zips/full.tar").write_bytes(tar_bytes({"other": b"x"}, "w"))
    report = {r.target: r for r in archives.ingest(spark, f"file:{tmp_path}").collect()}
    assert {k: (r.members, r.failures) for k, r in report.items() if k != "e"} == {"a": (2, 1), "bad-member": (1, 2), "b": (2, 0), "c": (1, 0), "d": (0, 1)}
    assert report["e"].failures == 1 and 0 < report["e"].members < 9 and report["d"].error
    there = tree(tmp_path)
    assert there["a/s/x.svg"] == b"<svg/>" and there["b/t/2.png"] == b"22" and there["c/3"] == b"333" and "full/other" not in there and not os.path.exists(tmp_path.parent / "out.txt")
    counts = {r.folder: r.n_files for r in archives.inventory(spark, f"file:{tmp_path}").collect()}
    assert counts == {"a": 2, "bad-member": 1, "b": 2, "c": 1, "e": report["e"].members, "full": 1}
    again = {r.target for r in archives.ingest(spark, f"file:{tmp_path}").collect()}
    assert again == {"d"} and tree(tmp_path) == there


def test_archives_that_are_unpacked_are_not_opened_again(spark, tmp_path):
    (tmp_path / "zips").mkdir()
    for i in range(40):
        with zipfile.ZipFile(tmp_path / f"zips/{i}.zip", "w") as z:
            z.writestr("m", os.urandom(5000) if i == 7 else b"1")
    assert archives.ingest(spark, str(tmp_path), rangeBytes=1000).count() == 40 and os.path.getsize(tmp_path / "7/m") == 5000
    assert archives.pieces_to_do(spark, str(tmp_path)).count() == 0
    (tmp_path / "3/m").unlink()
    assert [r.archive for r in archives.pieces_to_do(spark, str(tmp_path)).collect()] == ["3.zip"]
    # Folders are many and small: tasks do not grow with them.
    assert archives.inventory(spark, str(tmp_path)).rdd.getNumPartitions() == 4 and archives.inventory(spark, str(tmp_path)).count() == 40


def test_no_archives(spark, tmp_path):
    assert archives.contents(spark, str(tmp_path)).count() == 0 and archives.ingest(spark, str(tmp_path)).count() == 0 and archives.inventory(spark, str(tmp_path)).count() == 0


# -- image files ------------------------------------------------------------


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_file(pixels, colour, filters, depth=8, extra=b""):
    """A PNG file whose rows are filtered as told; pixels: height x bytes of a row."""
    h, across = pixels.shape
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines, above = [], np.zeros(across, int)
    for y in range(h):
        row, kind = pixels[y].astype(int), filters[y % len(filters)]
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]])[:across] for v in (row, above))
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, near][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    width = across // step * (8 // depth)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_image_files_of_all_filters(colour):
    rng = np.random.default_rng(colour)
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    pixels = rng.integers(0, 256, (11, 7 * step), np.uint8)
    extra = chunk(b"PLTE", bytes(range(256)) * 3) + chunk(b"tRNS", bytes([0, 128])) if colour == 3 else b""
    width, height, channels, found, palette = images.png_pixels(png_file(pixels, colour, [0, 1, 2, 3, 4], extra=extra))
    assert (width, height, channels, found) == (7, 11, step, pixels.tobytes())
    assert (palette is None) == (colour != 3) and (palette is None or list(palette[:12]) == [0, 1, 2, 0, 3, 4, 5, 128, 6, 7, 8, 255])


def test_images_over_white(spark, tmp_path):
    rng = np.random.default_rng(9)
    grey_alpha, packed = rng.integers(0, 256, (5, 6), np.uint8), rng.integers(0, 256, (3, 2), np.uint8)
    made = {
        "rgba": drawn_png(rng.integers(0, 256, (4, 3, 4), np.uint8)), "rgb": drawn_png(rng.integers(0, 256, (4, 3, 3), np.uint8)), "grey": drawn_png(rng.integers(0, 256, (4, 3, 1), np.uint8)),
        "la": png_file(grey_alpha, 4, [4, 3]), "bits": png_file(packed, 3, [1], 2, chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", bytes([255, 0, 100]))), "bad": b"no image", "cut": drawn_png(np.zeros((4, 3, 3), np.uint8))[:45],
    }
    for name, content in made.items():
        (tmp_path / f"{name}.png").write_bytes(content)
    rows = images.png_images(files.listing(spark, str(tmp_path), ".png")).withColumn("name", F.regexp_extract("path", r"(\w+)\.png$", 1))
    found = {r.name: r for r in images.composited(rows).collect()}
    assert set(found) == {"rgba", "rgb", "grey", "la", "bits"}
    for r in rows.collect():
        values = np.frombuffer(bytes(r.pixels), np.uint8).reshape(-1, r.channels)
        if r.palette is not None:
            values = np.frombuffer(bytes(r.palette), np.uint8).reshape(-1, 4)[values[:, 0]]
        colour, alpha = (values[:, :-1], values[:, -1:] / 255) if values.shape[1] in (2, 4) else (values, 1.0)
        plain = np.broadcast_to(np.floor(255 * (1 - alpha) + colour * alpha + 0.5 + 1e-9), (len(values), 3) if colour.shape[1] == 1 else colour.shape)
        assert found[r.name].channels == 3 and np.array_equal(np.frombuffer(bytes(found[r.name].pixels), np.uint8).reshape(-1, 3), plain)
    two_bits = [(v >> s) & 3 for v in packed[0] for s in (6, 4, 2, 0)]
    assert list(next(r for r in rows.collect() if r.name == "bits").pixels[:8]) == two_bits
    assert images.composited(rows.withColumn("pixels", F.lit(None).cast("binary"))).count() == 0


def test_empty_drawings_are_annotated_too(spark):
    rows = {r.scene_id: r for r in catalog.query_annotate_files(spark, SF).collect()}
    scenes = {r.scene_id for r in catalog.paths(spark, SF).select("scene_id").distinct().collect()}
    assert set(rows) == {s for s in scenes if s % 11} and len({s for s in rows if s % 7 == 0}) > 0
    assert all((rows[s].num_instances, rows[s].area) == (0, 0) for s in rows if s % 7 == 0)
