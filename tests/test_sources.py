"""Sources, sinks and streams on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lumenmesh.sources import obj, records
from lumenmesh.streaming import logs

OBJ = """# a square and a triangle
v 0 0 0
v 1 0 0
v 1 1 0
v 0 1 0
vt 0 0
vt 1 0
vt 1 1
vt 0 1
usemtl red

f 1/1 2/2 3/3 4/4
usemtl blue
f 1/1 3/3 4/4
"""


def test_obj_round_trip(spark, tmp_path):
    (tmp_path / "a.obj").write_text(OBJ)
    m = obj.read_obj(spark, str(tmp_path / "a.obj"))
    faces = sorted((r.fid, r.v, r.material) for r in m["faces"].collect())
    assert faces == [(1, [1, 2, 3], "red"), (2, [1, 3, 4], "red"), (3, [1, 3, 4], "blue")]
    obj.write_obj(obj.obj_lines(m["vertices"], m["texcoords"], m["faces"]), tmp_path / "out")
    again = obj.read_obj(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[1:] for r in again["vertices"].collect()) == sorted(tuple(r)[1:] for r in m["vertices"].collect())
    assert [(r.fid, r.v) for r in sorted(again["faces"].collect())] == [f[:2] for f in faces]


def test_obj_without_texture_index(spark):
    lines = spark.createDataFrame([("f", 1, "v 0 0 0"), ("f", 2, "f 1 2 3")], "file string, line int, text string")
    with pytest.raises(Exception, match="texture index"):
        obj.parse_lines(lines)["faces"].collect()


def test_poses_of_both_forms(spark):
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    texts = [("a", json.dumps({"poses": [eye, eye], "frame_indices": [3, 7]})), ("b", json.dumps({"poses": [eye, eye], "frame_indices": [3]})), ("d", "broken"),
             ("c", json.dumps([{"transform_matrix": eye, "frame_name": "img_00012.jpg"}, {"transform_matrix": eye, "frame_index": 5}, {"transform_matrix": eye, "frame_name": "x"}]))]
    got = sorted((r.file, r.pos, r.frame) for r in records.poses(spark.createDataFrame(texts, "file string, text string")).collect())
    assert got == [("a", 0, 3), ("a", 1, 7), ("b", 0, 0), ("b", 1, 1), ("c", 0, 12), ("c", 1, 5), ("c", 2, 2)]


def test_tolerant_records(spark):
    texts = spark.createDataFrame([
        ("i", '{"fx":1,"fy":2,"cx":3,"cy":4,"image_width":10}'), ("j", '{"fx":1,"fy":2,"cx":3}'), ("k", "[]"), ("m", None), ("n", '{"fx":1,"fy":2,"cx":3,"cy":4,"image_width":11}'),
    ], "file string, text string")
    assert [tuple(r) for r in records.intrinsics(texts, 10, 20).collect()] == [("i", 1.0, 2.0, 3.0, 4.0)]
    frames = spark.createDataFrame([("f", '{"saved_frames":[{"saved_index":0,"source_frame_index":0},{"saved_index":1},{"saved_index":0,"source_frame_index":9}]}')], "file string, text string")
    assert [tuple(r) for r in records.saved_frames(frames).collect()] == [("f", 0, 9)]
    view = {"mask_path": "m/1.png", "camera": {"fx": 1, "fy": 1, "cx": 1, "cy": 1, "extrinsic": [[1.0]]}}
    hull = spark.createDataFrame([("/d/x.json", json.dumps({"views": [view, {"mask_path": "no camera"}]})), ("/d/y.json", json.dumps([view]))], "file string, text string")
    assert sorted((r.file, r.mask_path) for r in records.hull_views(hull).collect()) == [("/d/x.json", "/d/m/1.png"), ("/d/y.json", "/d/m/1.png")]
    clicks = spark.createDataFrame([("c", '{"object":{"click_points":[[0.1,0.2],[0.3,0.4]],"click_labels":[1,0]},"ground":{"click_points":[]}}')], "file string, text string")
    assert [(r.mode, r.pos, r.x, r.label) for r in records.saved_clicks(clicks).collect()] == [("object", 0, 0.1, 1), ("object", 1, 0.3, 0)]


def test_gpu_rows(spark):
    lines = spark.createDataFrame([("0, A, 100, N/A",), ("1, B, 100, 50",), ("2, C, 100, 50",)], "value string")
    assert tuple(records.freest_gpu(records.gpu_rows(lines)).first()) == (1, 50.0)


def test_reconstruction_files(spark, tmp_path):
    rows = [(7, (1.0, 0, 0, 0), (1.0, 2.0, 3.0), 1, b"b.jpg", 2), (9, (0.0, 0, 0, 1.0), (0.0, 1.0, 0.0), 1, b"a.jpg", 0)]
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + b"".join(struct.pack("<I7dI", i, *q, *t, c) + n + b"\0" + struct.pack("<Q", k) + b"\0" * 24 * k for i, q, t, c, n, k in rows))
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<IiQQ3d", 1, 0, 64, 48, 50.0, 32.0, 24.0) + struct.pack("<IiQQ4d", 2, 1, 64, 48, 50.0, 51.0, 32.0, 24.0))
    images = records.reconstruction(spark, str(tmp_path / "images.bin"), "images")
    poses = sorted((r.view, r.name, r.c) for r in records.image_poses(images).collect())
    assert [(v, n) for v, n, _ in poses] == [(0, "a.jpg"), (1, "b.jpg")] and poses[1][2] == [-1.0, -2.0, -3.0] and poses[0][2] == [0.0, 1.0, 0.0]
    cameras = records.reconstruction(spark, str(tmp_path / "cameras.bin"), "cameras")
    assert tuple(records.dominant_camera(images, cameras).first()) == (1, 2, 64, 48, 50.0, 50.0, 32.0, 24.0)


def test_frames_by_name_or_place(spark):
    listing = spark.createDataFrame([("/x/00003.png",), ("/x/a.png",), ("/x/b.png",)], "path string")
    wanted = spark.createDataFrame([(3,), (1,), (9,)], "idx long")
    assert {r.idx: r.path for r in records.resolve_frames(wanted, listing).collect()} == {3: "/x/00003.png", 1: "/x/a.png", 9: None}


def test_artefact_listing(spark, tmp_path):
    (tmp_path / "a.PLY").write_bytes(b"x" * 1048576)
    (tmp_path / "b.txt").write_text("x")
    assert [(r.path.rsplit("/", 1)[1], r.mb) for r in records.artefacts(spark, str(tmp_path), [".ply"]).collect()] == [("a.PLY", 1.0)]


@pytest.fixture()
def stream(spark, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(str(source))
    return events, logs.read_events(spark, str(source), files=1), tmp_path


def test_windows_stream_equals_batch(spark, stream):
    events, live, tmp = stream
    sink = logs.idempotent_sink(str(tmp / "out"))
    logs.run_once(logs.windowed(live, "1 day", late="365 days"), sink, str(tmp / "cp"), "update")
    logs.run_once(logs.windowed(live, "1 day", late="365 days"), sink, str(tmp / "cp"), "update")  # nothing new
    last = spark.read.parquet(str(tmp / "out")).groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_progress_states(spark, stream):
    events, live, tmp = stream
    logs.run_once(logs.progress_states(live), logs.idempotent_sink(str(tmp / "out")), str(tmp / "cp"), "update")
    rows = spark.read.parquet(str(tmp / "out")).groupBy("user_id").agg(F.max("updates").alias("updates"), F.max("percent").alias("percent"))
    want = events.groupBy("user_id").agg(F.count("*").alias("updates"), F.max(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "value"))).alias("percent"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_deduplication_and_sessions(spark, stream):
    events, live, tmp = stream
    logs.run_once(logs.deduplicated(live.unionByName(live), "365 days"), logs.idempotent_sink(str(tmp / "once")), str(tmp / "cp"))
    assert spark.read.parquet(str(tmp / "once")).count() == events.count()
    assert logs.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_ply_round_trip(spark, tmp_path):
    from lumenmesh.sources import ply

    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<3f3B", i, 2 * i, 0.5, 255, 0, 51 * i) for i in range(4)) + struct.pack("<B4i", 4, 0, 1, 2, 3)
    (tmp_path / "a.ply").write_bytes(head + body)
    vertices, faces = ply.read_ply(spark, str(tmp_path / "a.ply"))
    assert sorted((r.vid, r.x, r.y, r.r, round(r.b, 3)) for r in vertices.collect()) == [(i, float(i), 2.0 * i, 1.0, round(0.2 * i, 3)) for i in range(4)]
    assert sorted(tuple(r)[1:] for r in faces.collect()) == [(0, 0, 1, 2), (1, 0, 2, 3)]
    ply.write_ply(ply.ply_lines(vertices, faces), tmp_path / "out")
    again, triangles = ply.read_ply(spark, str(next((tmp_path / "out").glob("part-*"))))
    assert sorted(tuple(r)[1:5] for r in again.collect()) == sorted(tuple(r)[1:5] for r in vertices.collect())
    assert sorted(tuple(r)[1:] for r in triangles.collect()) == [(0, 0, 1, 2), (1, 0, 2, 3)]
