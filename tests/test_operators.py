"""Grouping, selection, expressions, results, cache and streams on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions.expression import ExpressionError, compile_expression, tokens
from kindred.operators import grouping, pairs, results, scope, selection
from kindred.sources import cache, media, store


def test_representatives_gate_merges():
    out = grouping.replay_edges([(0, 1, 0.1, 0), (1, 2, 0.1, 0)], lambda x, y: abs(x - y) <= 1)
    assert [(r[1], r[4]) for r in out] == [(0, True), (1, False)]
    out = grouping.replay_edges([(0, 1, 0.1, 0), (2, 3, 0.1, 1), (1, 3, 0.1, 0)], lambda x, y: True)
    assert {r[0] for r in out} == {0} and dict((r[1], r[3]) for r in out) == {0: 0, 1: 0, 2: 0, 3: 1}


def test_star_is_pruned():
    links = {(0, 2), (0, 3), (2, 3), (0, 1)}
    kept, gone = grouping.prune_by_majority([0, 1, 2, 3], lambda a, b: (a, b) in links or (b, a) in links)
    assert (kept, gone) == ([0, 2, 3], [1])


def test_groups_that_span_more_than_the_duration_gate(spark):
    """Verdicts inside a component come from frames: a chain of durations, and random frames, against a plain replay."""
    rng = random.Random(3)
    bases = [[rng.randrange(256) for _ in range(1024)] for _ in range(3)]
    rows = [(k, round(100 * 1.18**k), bases[0]) for k in range(6)]
    for k in range(6, 46):
        px = list(rng.choice(bases[1:]))
        for i in rng.sample(range(1024), rng.randint(0, 200)):
            px[i] = rng.randrange(256)
        rows.append((k, rng.randrange(100, 200), px))
    gap = {(x, y): sum(abs(p - q) for p, q in zip(px, qx, strict=True)) / 1024 / 256 for x, _, px in rows for y, _, qx in rows}
    length = {x: n for x, n, _ in rows}
    edges = [(x, y, d, 0) for (x, y), d in sorted(gap.items()) if x < y and d <= 0.04 and abs(length[x] - length[y]) <= 0.2 * min(length[x], length[y])]
    assert any(d <= 0.04 and x < y and (x, y, d, 0) not in edges for (x, y), d in gap.items())
    similar = lambda x, y: gap[x, y] <= 0.04
    e, items = spark.createDataFrame(edges, "a long, b long, diff double, flags int"), spark.createDataFrame(rows, "id long, duration long, px array<int>")

    out = grouping.replay_edges(edges, similar)
    rep = {r[0]: r[1] for r in out if r[4]}
    got = [tuple(r) for r in grouping.representative_groups(e, items, 0.04).collect()]
    assert sorted(got) == sorted((rep[g], *r) for g, *r in out) and {r[1] for r in got if r[0] == 0} == set(range(6))

    parts = {}
    for r in grouping.components(e).collect():
        parts.setdefault(r.component, []).append(r.node)
    expected = sorted((min(g), x) for p in parts.values() for g in grouping.split_group(sorted(p), similar) for x in g)
    got = sorted(map(tuple, grouping.daisy_split(e, items, 0.04).collect()))
    assert got == expected and {x for g, x in got if g == 0} == set(range(6))


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    lab = {x: x for e in edges for x in e}
    for _ in lab:
        for a, b in edges:
            lab[a] = lab[b] = min(lab[a], lab[b])
    got = {r.node: r.component for r in grouping.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == lab


def test_keeper_ties(spark):
    rows = [(1, 0, 60.2, 100, 9), (1, 1, 60.0, 200, 5), (1, 2, 30.0, 900, 1)]
    df = spark.createDataFrame(rows, "group_id int, idx long, duration double, frame_size int, size int")
    some = [c for c in selection.CRITERIA if c.column in ("duration", "frame_size", "size")]
    assert [r.idx for r in selection.keepers(df, some).filter("keeper").collect()] == [1]
    assert [c.column for c in selection.resolve_criteria(["size", "nope", "size"], ("fps",))][:2] == ["size", "duration"]


def test_tags_all_of_nothing(spark):
    df = spark.createDataFrame([(["A", "b"],)], "t array<string>")
    r = df.select(scope.has_tags(F.col("t"), ["a"], False).alias("x"), scope.has_tags(F.col("t"), ["a", "B"], True).alias("y"), scope.has_tags(F.col("t"), [], True).alias("z")).first()
    assert (r.x, r.y, r.z) == (True, True, False)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("Size > 10 && !Name.StartsWith(\"a\")", [2]),
        ("Name.Contains('B', true) || size / 0 > 1", [2]),
        ("Tags.Contains(\"X\") ? true : Regex.IsMatch(Name, \"^b\")", [1, 2]),
        ("string.IsNullOrEmpty(Note) && Math.Max(Size, 7) == 20", [2]),
        ("Name + 1 == \"a1\" && Name.Length == 1 && Tags.Count > 0", [1]),
        ("Name.Substring(0, 1).ToUpper() == \"B\"", [2]),
    ],
)
def test_expressions(spark, source, expected):
    df = spark.createDataFrame([(1, "a", 5, ["x"], None), (2, "b", 20, [], "")], "id int, name string, size int, tags array<string>, note string")
    assert [r.id for r in df.filter(compile_expression(source, df.dtypes)).orderBy("id").collect()] == expected


@pytest.mark.parametrize("bad", ["", "Size = 3", "Size >", "Nope > 1", "Size", "Name.Nope()", "(Size > 1"])
def test_bad_expressions(bad):
    with pytest.raises(ExpressionError):
        compile_expression(bad, [("size", "int"), ("name", "string")])


def test_tokens():
    assert tokens('a >= 1.5m && b == @"c""d"') == [("id", "a"), ("op", ">="), ("num", "1.5"), ("op", "&&"), ("id", "b"), ("op", "=="), ("str", 'c"d')]


def test_merge_plan(spark):
    rows = [("g", 1, ["Anime", "Fav"], 3, "mine", ""), ("g", 2, ["Fav", "Clip"], 5, "theirs", "u")]
    df = spark.createDataFrame(rows, "group_id string, idx int, tags array<string>, rating int, note string, url string")
    r = results.merge_plan(df).first()
    assert (r.tags, r.rating, r.note, r.url, r.keeper) == (["Anime", "Fav", "Clip"], 5, "mine\n\ntheirs", "u", 1)
    assert results.merge_plan(df, note_limit=6).first().note == "mine"


def test_labels(spark):
    r = spark.range(1).select(results.duration_label(F.lit(-13)).alias("a"), results.duration_label(F.lit(3725)).alias("b"), results.percent_label(F.lit(80), F.lit(100)).alias("c")).first()
    assert tuple(r) == ("-13s", "+1h02m05s", "-20%")


def test_sliding_window_finds_a_clip(spark):
    rng = random.Random(1)
    melody = [rng.getrandbits(32) for _ in range(60)]
    df = spark.createDataFrame([(1, 2, melody, melody[20:35]), (1, 3, melody, [])], "source long, clip long, long_fp array<long>, short_fp array<long>")
    assert [(r.similarity, r.offset) for r in pairs.sliding_window(df, 0.8).orderBy("clip").collect()] == [(1.0, 20), (0.0, 0)]


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8])
def test_sliding_window_equals_a_plain_one(spark, monkeypatch, least):
    """Leaving hopeless offsets early and working in pieces changes nothing."""
    monkeypatch.setattr(pairs, "AT_ONCE", 64)
    rng = random.Random(int(least * 10))
    rows = []
    for k in range(60):
        a = [rng.getrandbits(32) for _ in range(rng.randint(1, 60))]
        o = rng.randrange(len(a))
        b = [x if rng.random() < 0.8 else rng.getrandbits(32) for x in a[o : o + rng.randint(1, 30)]] if k % 3 else [0] * rng.randint(0, 5)
        rows.append((k, k, a if k % 5 else a + a, b))
    got = {r.source: (r.similarity, r.offset) for r in pairs.sliding_window(spark.createDataFrame(rows, "source long, clip long, long_fp array<long>, short_fp array<long>"), least).collect()}
    for k, _, a, b in rows:
        sims = [sum(32 - (x ^ y).bit_count() for x, y in zip(a[o:], b)) / (32.0 * len(b)) for o in range(len(a) - len(b) + 1)] if b else []
        top = max(sims, default=0.0)
        assert got[k] == ((top, sims.index(top)) if sims and top >= least and top > 0 else (0.0, 0))


def test_cache_round_trip(spark, tmp_path):
    frame = bytes(range(256)) * 4
    df = spark.createDataFrame([("a1", "n", "mp4", 5, 7, 0, {"0.5": frame})], "id string, name string, ext string, size long, mtime long, flags int, gray map<string,binary>")
    cache.export_json(df, str(tmp_path / "out"))
    with open(tmp_path / "out" / "bad.json", "w") as f:
        f.write('{"id":"../x","name":"n","ext":"mp4","size":1}\n{"id":"b","name":"","ext":"mp4","size":1}\n{"id":"c","name":"n","ext":"mp4","size":1,"gray":{"0":"AAAA"}}\nnot json\n')
    good, bad = cache.import_json(spark, str(tmp_path / "out"))
    assert [(r.id, bytes(r.gray["0.5"])) for r in good.collect()] == [("a1", frame)] and bad.count() == 4
    cache.save(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_probe_and_streams(spark):
    text = '{"format":{"duration":"61.9","bit_rate":"900"},"streams":[{"index":0,"codec_type":"video","width":10,"height":10,"r_frame_rate":"30000/1001","disposition":{"attached_pic":1}},{"index":1,"codec_type":"video","width":4,"height":4,"r_frame_rate":"0/0"},{"index":2,"codec_type":"audio","channels":2,"tags":{"language":"UND"}}]}'
    r = spark.createDataFrame([(text,)], ["t"]).select(media.media_info(F.col("t")).alias("m")).select("m.duration", media.video_stream(F.col("m.streams")).alias("v"), media.audio_stream(F.col("m.streams")).alias("a"), "m.streams").first()
    assert (r.duration, r.v["index"], r.v.fps, r.streams[0].bit_rate, r.a.language) == (61, 1, -1.0, 900, "")


def test_exif_date(spark):
    import struct

    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0132, 2, 20, 26) + struct.pack("<I", 0) + b"2020:05:06 07:08:09\0"
    df = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff),), (bytearray(b"zzz"),)], "c binary")
    assert [str(r.d) for r in df.select(media.exif_date(F.col("c")).alias("d")).collect()] == ["2020-05-06 07:08:09", "None"]


def test_stream_upsert(spark, tmp_path):
    from kindred.streaming.incremental import read_items, upsert_stream

    schema = spark.createDataFrame([], "id string, size long, mtime long").schema
    for rows in ([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(read_items(spark, str(tmp_path / "in"), schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(tuple(r) for r in store.load(spark, str(tmp_path / "t"), schema).collect()) == [("a", 2, 2), ("b", 1, 1)]
    # a table that was lost isn't replaced by the next batch alone
    import shutil

    shutil.rmtree(tmp_path / "t")
    spark.createDataFrame([("c", 1, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="there is no table"):
        upsert_stream(read_items(spark, str(tmp_path / "in"), schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
