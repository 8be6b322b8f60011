"""Tables that live from scan to scan, files, scopes, selections and reports on small cases."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import difference_map as D, kernels as K
from kindred.functions.expression import compile_expression
from kindred.operators import review, scope, selection
from kindred.plans import settings as S
from kindred.sources import cache, media, store


def test_saves_keep_what_they_do_not_touch(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, size long"
    cache.save(spark.createDataFrame([(f"i{k}", k) for k in range(200)], schema), path)
    cache.save(spark.createDataFrame([("i7", -7), ("new", 1)], schema), path)
    expected = sorted([(f"i{k}", k if k != 7 else -7) for k in range(200)] + [("new", 1)])
    assert sorted(map(tuple, store.load(spark, path).select("id", "size").collect())) == expected
    assert spark.read.parquet(path).count() == 201  # old versions are gone
    store.save(spark.createDataFrame([], schema), path, deleted=spark.createDataFrame([("i3",)], "id string"))
    assert store.load(spark, path).count() == 200 and store.load(spark, path).filter("id = 'i3'").count() == 0
    # a version that was written but never named by the manifest changes nothing
    spark.createDataFrame([("ghost", 1, 5)], "id string, size long, shard int").write.partitionBy("shard").parquet(f"{path}/version=99")
    assert store.load(spark, path).count() == 200
    shard = next(iter(store.manifest(spark, path)["shards"].items()))
    import shutil

    shutil.rmtree(f"{path}/version={shard[1]}/shard={shard[0]}")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)


def test_a_batch_is_written_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, size long"
    for batch, size in ((0, 1), (1, 2), (1, 99), (0, 77)):
        store.save(spark.createDataFrame([("a", size)], schema), path, batch=batch)
    assert store.load(spark, path).first().size == 2
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
    assert store.load(spark, str(tmp_path / "none"), spark.createDataFrame([], schema).schema).count() == 0


def test_results_settings_and_logs_persist(spark, tmp_path):
    rows = spark.createDataFrame([("a1", "n", "mp4", 1, 0.5), ("../x", "n", "mp4", 1, 0.1), ("b", "x/y", "mp4", 2, 0.2)], "id string, name string, ext string, group_id long, d double")
    for _ in range(2):
        store.save_results(rows, str(tmp_path / "r"))
    assert [r.id for r in store.load_results(spark, str(tmp_path / "r"), rows.schema).collect()] == ["a1"]
    assert len([n for n in os.listdir(tmp_path / "r") if n.startswith("results-")]) == 1
    store.save_settings(spark, str(tmp_path / "s.json"), {"percent": 91})
    assert S.normalised(store.load_settings(spark, str(tmp_path / "s.json"))).percent == 91 and store.load_settings(spark, str(tmp_path / "no.json")) == {}
    log = spark.createDataFrame([("2020-01-02 03:04:05", "warn", "b"), ("2020-01-01 03:04:05", "info", "a")], "time string, level string, message string").withColumn("time", F.col("time").cast("timestamp"))
    store.write_log(log, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["2020-01-01 03:04:05 INFO a", "2020-01-02 03:04:05 WARN b"]


def test_dense_timelines_of_changed_files_do_not_count(spark, tmp_path):
    path = str(tmp_path / "d")
    for failed in (True, False):
        store.write_dense(spark.createDataFrame([("a", 1, 2, failed)], "id string, size long, mtime long, failed boolean"), path)
    items = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("b", 1, 2)], "id string, size long, mtime long")
    got = {(r.id, r.mtime): (r.found, r.failed) for r in store.read_dense(spark.read.parquet(path), items).collect()}
    assert got == {("a", 2): (True, False), ("a", 3): (False, None), ("b", 2): (False, None)}


def test_file_columns_and_hashes(spark, tmp_path):
    data = bytes(range(256)) * 600
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(data)
    (tmp_path / "f" / "y.bin").write_bytes(b"small")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    got = {os.path.basename(r.path): r.size for r in store.file_columns(files).collect()}
    assert got == {"x.bin": len(data), "y.bin": 5}
    words = lambda b: sum(struct.unpack(f"<{len(b) // 8}Q", b))
    expected = (len(data) + words(data[:65536]) + words(data[-65536:])) % 2**64
    assert {r.h for r in files.select(K.content_hash("content").alias("h")).collect()} == {None, f"{expected:016x}"}


def tiff():
    head = b"MM\0*" + struct.pack(">I", 8)
    entries = struct.pack(">HHII", 0x0132, 2, 20, 62) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(">HHII", 0x011A, 5, 1, 82) + struct.pack(">HHII", 0x8769, 4, 1, 90)
    main = struct.pack(">H", 4) + entries + struct.pack(">I", 0)
    values = b"2019:01:02 03:04:05\0" + struct.pack(">II", 72, 1)
    sub = struct.pack(">H", 1) + struct.pack(">HHII", 0x9003, 2, 20, 90 + 18) + struct.pack(">I", 0) + b"1999:12:31 23:59:58\0"
    return head + main + values + sub


def test_exif_wherever_it_stands(spark):
    t = tiff()
    app = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    riff = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    files = {
        "jpeg": b"\xff\xd8" + app(0xE0, b"JFIF\0" + b"x" * 60000) * 6 + app(0xE1, b"http://xmp") + app(0xE1, b"Exif\0\0" + t) + b"\xff\xda",
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"eXIf junk" * 9) + chunk(b"eXIf", t),
        "webp": b"RIFF\0\0\0\0WEBP" + riff(b"VP8 ", b"EXIFx") + riff(b"EXIF", t),
        "tiff": t, "none": b"\xff\xd8" + app(0xE0, b"JFIF\0") + b"\xff\xda" + app(0xE1, b"Exif\0\0" + t), "cut": t[:40], "junk": b"zz",
    }
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()], "n string, c binary")
    got = {r.n: (str(r.d), r.t) for r in df.select("n", media.exif_date(F.col("c")).alias("d"), media.exif_tags("c").alias("t")).collect()}
    for n in ("jpeg", "png", "webp", "tiff"):
        assert got[n][0] == "1999-12-31 23:59:58" and got[n][1][0x0112] == "6" and got[n][1][0x011A] == "72/1"
    assert all(got[n][0] == "None" for n in ("none", "cut", "junk"))


def test_folders_of_any_depth(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(300)], "id long, parent long")
    assert scope.folder_closure(chain).count() == 300 * 301 // 2
    with pytest.raises(ValueError):
        scope.folder_closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))
    orphan = spark.createDataFrame([("a", "A", "gone"), ("b", "B", "a")], "id string, name string, parent string")
    assert sorted(map(tuple, scope.folder_paths(orphan).collect())) == [("a", "A", 0), ("b", "A/B", 1)]
    with pytest.raises(ValueError):
        scope.smart_folders(chain.selectExpr("*", "'x' AS name", "'r' AS rule"))


#: The knobs of the profiles: percent, mirrored, black, white, partial clips, AI, AI partials.
KNOBS = {"exact_and_near": (98, 0, 0, 0, 0, 0, 0), "edited_and_altered": (92, 1, 1, 1, 0, 0, 0), "ai_scan": (92, 1, 1, 1, 0, 1, 1), "deep_clean": (92, 1, 1, 1, 1, 1, 1)}


def test_all_knobs_of_all_profiles():
    for name, values in KNOBS.items():
        s = S.with_profile(S.ScanSettings(), name)
        assert tuple(getattr(s, k) for k in S.KNOBS) == values and S.active_profile(s) == name
    assert S.match_settings(S.with_profile(S.ScanSettings(), "ai_scan")).use_ai
    assert [S.workers(c) for c in (1, 2, 4, 8, 16)] == [1, 1, 3, 6, 13] and S.workers(8, 3) == 3


def test_walk_of_decisions(spark):
    assert selection.walk_steps(["keepLeft", "keepRight", "keepLeft"], 4) == ([1, 0, 3], (-1, -1))
    assert selection.walk_steps(["skip", "skip"], 4)[1] == (-1, -1) and selection.walk_steps([], 1)[1] == (-1, -1)
    import random

    rng = random.Random(1)
    rows, told, expected = [], [], {}
    for g in range(40):
        n, steps = rng.randint(1, 7), [rng.choice(["keepLeft", "keepRight", "skip"]) for _ in range(rng.randint(1, 7))]
        rows += [(g, 100 * g + k) for k in range(n)]
        told += [(g, k, d) for k, d in enumerate(steps)]
        checked, (left, right) = selection.walk_steps(steps, n)
        expected[g] = ([100 * g + c for c in checked], None if left < 0 else 100 * g + left, None if right < 0 else 100 * g + right)
    got = selection.walk(spark.createDataFrame(rows, "group_id long, idx long"), spark.createDataFrame(told, "group_id long, step int, decision string"))
    assert {r.group_id: (r.checked, r.left, r.right) for r in got.collect()} == expected


def test_keeper_by_larger_size_and_undo(spark):
    df = spark.createDataFrame([(1, 0, 5, False), (1, 1, 9, False)], "group_id int, idx long, size int, checked boolean")
    assert [r.idx for r in selection.keepers(df, [selection.LARGER]).filter("keeper").collect()] == [1]
    undo = selection.Undo(2)
    one = undo.apply(df, df.withColumn("checked", F.lit(True)))
    two = undo.apply(one, selection.clear(one))
    assert two.filter("checked").count() == 0 and undo.undo(two).filter("checked").count() == 2 and undo.undo(one) is df and undo.undo(df) is df


def test_identical_rows_that_are_hidden(spark):
    rows = [(1, 0, "a", False), (1, 1, "a", True), (1, 2, "a", False), (1, 3, "b", True), (1, 4, "b", True)]
    df = spark.createDataFrame(rows, "group_id int, idx long, f string, visible boolean")
    assert {r.idx for r in selection.check_identical(df, ["f"]).filter("checked").collect()} == {1}


def test_reports(spark):
    rows = spark.createDataFrame([(1, 0, "<a>", "p/x", 5, True, 1.0), (1, 1, "b", "p\"y", 7, True, 2.0), (2, 2, "c", "q", 9, False, 3.0)], "group_id long, idx long, name string, path string, size long, checked boolean, similarity double")
    page = "".join(review.html_report(rows, "T&T"))
    assert "&lt;a&gt;" in page and page.count("<h2>") == 2 and page.count("class=checked") == 2 and "T&amp;T" in page
    more = {c: F.lit("v") for c in review.CSV_COLUMNS if c not in rows.columns}
    order = review.ordered_groups(rows.withColumns({"created": F.lit(1), "duration": F.lit(1)}))
    lines = [r.line for r in review.csv_report(rows.withColumns(more), order).orderBy("place", "idx").collect()]
    assert lines[0].startswith('﻿"group_id","name"') and lines[2].split(",")[:4] == ['"1"', '"b"', '"v"', '"p""y"'] and len(lines) == 4


def test_expression_members(spark):
    df = spark.createDataFrame([(1, "ab12", 3661.25, 1)], "id int, name string, duration double, flags int").withColumn("created", F.lit("2020-01-01 00:00:01").cast("timestamp"))
    one = lambda text: df.filter(compile_expression(text, df.dtypes, item=True)).count()
    assert one('Regex.Match(Name, "[0-9]+").Value == "12" && Regex.Match(Name, "z").Success == false')
    assert one("item.Duration.Hours == 1 && Duration.Minutes == 1 && Duration.Seconds == 1 && Duration.Milliseconds == 250")
    assert one("DateCreated.Ticks == 15778368010000000 && IsFlipped && !IsAiMatched")


def test_difference_regions(spark):
    y, x = np.mgrid[0:64, 0:64]
    base = ((x // 8 + y // 8) % 2) * 100.0 + 50
    logo = base.copy()
    logo[41:55, 41:55] = 400
    df = spark.createDataFrame([(base.ravel().tolist(), logo.ravel().tolist(), 64, 64, 0.5), (base.ravel().tolist(), base.ravel().tolist(), 64, 64, 0.5)], "a array<double>, b array<double>, w int, h int, s double")
    r = [x.r for x in df.select(D.differing_regions("a", "b", "w", "h", "s").alias("r")).collect()]
    assert len(r[0].regions) == 1 and abs(r[0].regions[0].x * 64 - 40) <= 8 and r[1].coverage == 0 and r[1].regions == []
    assert D.analysis_size(3840, 2160) == (384, 216) and D.analysis_size(300, 200) == (300, 200)
    assert D.shrink(np.array([[0, 50, 100, 200], [0, 50, 100, 200], [0, 0, 50, 50], [0, 0, 50, 50]]), 2, 2).tolist() == [[25, 150], [0, 50]]


def test_model_input():
    rgb = np.zeros((2, 2, 2, 3), np.uint8)
    t = K.tensor(rgb)
    assert t.shape == (2, 3, 2, 2) and abs(t[0, 0, 0, 0] + 0.485 / 0.229) < 1e-6
    v = K.first_token(np.stack([np.full((5, 4), 2.0), np.zeros((5, 4))]))
    assert np.allclose(v, [[0.5] * 4, [0] * 4])
