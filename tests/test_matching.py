"""Verdicts of several positions, their gates, partial matches and groups: boundaries that the domain fixes, and plain versions."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import audio, kernels as K
from kindred.operators import building, cells, grouping, matching, pairs, partials
from kindred.operators.matching import MatchSettings

SCHEMA = "id long, is_image boolean, duration double, frames array<array<int>>, ph array<long>, emb array<array<int>>, emb_valid array<boolean>, folders array<string>, size long, dev string, ino string"


def item(i, frames, ph=None, image=False, duration=10.0, emb=None, valid=None, folders=(), size=1, dev="d", ino=""):
    n = len(frames)
    return (i, image, duration, frames, ph or [0] * n, emb or [[0] * 4] * n, valid or [False] * n, list(folders), size, dev, ino)


def found(spark, rows, s):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ph_flip", F.col("ph"))
    return {(r.a, r.b): (round(r.difference, 6), r.flags) for r in matching.matches(df, s).collect()}


def fill(v, n=1024):
    return [v] * n


PLAIN = dict(flipped=False, ignore_black=False, ignore_white=False)


def test_single_precision_threshold_of_frames(spark):
    """100 against 110 differ by 0.0390625; at 96 % the limit is the single-precision value of 1 - 0.96."""
    rows = [item(1, [fill(100)]), item(2, [fill(110)]), item(3, [fill(111)])]
    assert found(spark, rows, MatchSettings(percent=96, **PLAIN)) == {(1, 2): (0.039062, 0), (2, 3): (0.003906, 0)}


def test_black_frames_never_match_when_masked(spark):
    rows = [item(1, [fill(0)]), item(2, [fill(0)])]
    assert found(spark, rows, MatchSettings(flipped=False)) == {} and found(spark, rows, MatchSettings(**PLAIN)) == {(1, 2): (0.0, 0)}


MAX = -1  # all 64 bits


@pytest.mark.parametrize(
    "a, b, quorum, percent, expected",
    [
        ([MAX, 7, 7, 7], [0, 7, 7, 7], 0.6, 90, 0.25),
        ([0, MAX, 0, MAX, 0], [0, 0, 0, 0, MAX], 0.6, 90, None),
        ([0, MAX, 0, MAX, 0], [0, 0, 0, 0, MAX], 0.4, 90, 0.6),
        ([0, 0], [0, 0xFFFF], 0.75, 90, None),
        ([0, 0], [0, 0xFFFF], 0.5, 90, 0.125),
        ([0b111111], [0], 0.6, 90, 0.09375),
        ([0b1111111], [0], 0.6, 90, None),
    ],
)
def test_quorum_of_hashes(spark, a, b, quorum, percent, expected):
    n = len(a)
    rows = [item(1, [fill(0)] * n, a), item(2, [fill(255)] * n, b)]
    got = found(spark, rows, MatchSettings(positions=n, percent=percent, use_phash=True, quorum=quorum, **PLAIN))
    assert got == ({} if expected is None else {(1, 2): (expected, 0)})


def test_combined_flags(spark):
    same, other = [fill(50)], [fill(250)]
    s = MatchSettings(percent=90, combine=True, **PLAIN)
    rows = [item(1, same, [0]), item(2, same, [0]), item(3, same, [MAX]), item(4, other, [0])]
    assert {k: v[1] for k, v in found(spark, rows, s).items()} == {(1, 2): 24, (1, 3): 8, (2, 3): 8, (1, 4): 16, (2, 4): 16}


def test_images_are_judged_by_frames_only(spark):
    rows = [item(1, [fill(50)], [0], image=True, duration=0.0), item(2, [fill(52)], [MAX], image=True, duration=0.0), item(3, [fill(50)], [0], duration=0.0)]
    assert found(spark, rows, MatchSettings(percent=95, use_phash=True, **PLAIN)) == {(1, 2): (0.007812, 0)}
    assert found(spark, rows, MatchSettings(percent=95, combine=True, **PLAIN)) == {(1, 2): (0.007812, 8)}


def test_mirrored_wins_only_if_it_is_nearer(spark):
    ramp = [x * 8 for _ in range(32) for x in range(32)]
    back = [(31 - x) * 8 for _ in range(32) for x in range(32)]
    s = MatchSettings(percent=95, ignore_black=False, ignore_white=False)
    assert found(spark, [item(1, [ramp]), item(2, [back]), item(3, [ramp])], s) == {(1, 2): (0.0, 1), (2, 3): (0.0, 1), (1, 3): (0.0, 0)}
    assert found(spark, [item(1, [fill(9)]), item(2, [fill(9)])], s) == {(1, 2): (0.0, 0)}


def test_ai_union_and_abstention(spark):
    unit = [127, 0, 0, 0]
    near = [125, 22, 0, 0]
    s = MatchSettings(positions=3, percent=99, use_ai=True, ai_percent=94, **PLAIN)
    frames, others = [fill(10)] * 3, [fill(200)] * 3
    rows = [item(1, frames, emb=[unit] * 3, valid=[True] * 3), item(2, others, emb=[near] * 3, valid=[True, True, False]), item(3, others, emb=[near] * 3, valid=[True, False, False])]
    got = found(spark, rows, s)
    assert set(got) == {(1, 2), (2, 3)} and got[1, 2][1] == K.AI_MATCHED and got[2, 3] == (0.0, 0)


def test_gates(spark):
    f = [fill(5)]
    rows = [item(1, f, duration=100.0, folders=["A\\b/C/"], size=7, ino="x"), item(2, f, duration=120.0, folders=["z/B/c"], size=7, ino="x"), item(3, f, duration=121.0, folders=["q"], size=7, ino="x"), item(4, f, duration=100.0, folders=["b/c"], size=7, ino="x")]
    every = {(1, 2), (1, 4), (2, 3), (2, 4)}  # 100 against 121: the smaller tolerance is 20
    assert set(found(spark, rows, MatchSettings(**PLAIN))) == every
    assert set(found(spark, rows, MatchSettings(folder_mode="same", folder_depth=2, **PLAIN))) == {(1, 2), (1, 4), (2, 4)}
    assert set(found(spark, rows, MatchSettings(folder_mode="different", folder_depth=2, **PLAIN))) == {(2, 3)}
    assert set(found(spark, rows, MatchSettings(exclude_hard_links=True, **PLAIN))) == every - {(1, 4)}


@pytest.mark.parametrize("percent, least, most", [(20, 0, 0), (20, 5, 0), (20, 5, 30), (0, 3, 0), (0, 0, 8), (2, 40, 0), (0, 0, 0)])
def test_candidates_lose_no_pair(spark, percent, least, most):
    rng = random.Random(percent + least)
    s = MatchSettings(tolerance_percent=percent, tolerance_least=least, tolerance_most=most, **PLAIN)
    rows = [(i, i % 9 == 0, 0.0 if i % 9 == 0 else float(rng.randrange(0, 2000) // rng.choice([1, 7, 40])), i % 3 == 0) for i in range(160)]
    got = {(r.x, r.y) for r in matching.candidate_pairs(spark.createDataFrame(rows, "id long, is_image boolean, duration double, in_scope boolean"), s).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    tolerance = spark.createDataFrame(rows, "id long, is_image boolean, duration double, in_scope boolean").select("id", K.duration_tolerance(F.col("duration"), percent, least, most).alias("t")).collect()
    t = {r.id: r.t for r in tolerance}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[3] or b[3]) and (a[1] or abs(a[2] - b[2]) <= min(t[a[0]], t[b[0]]))}


def test_a_hot_duration_meets_block_by_block(spark, monkeypatch):
    """With blocks far smaller than a band every pair still comes once, from any band and block, and ids that repeat or miss meet no one of their own."""
    monkeypatch.setattr(matching, "BLOCK", 4)
    rows = [(i, i % 5 == 0, None if i == 41 else 10.0 if i % 3 else 10.0 + i / 4) for i in range(60)] + [(7, False, 10.5), (None, False, 10.0)]
    s = MatchSettings(tolerance_percent=20)
    got = [(r.x, r.y) for r in matching.candidate_pairs(spark.createDataFrame(rows, "id long, is_image boolean, duration double"), s).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()]
    known = [r for r in rows if r[0] is not None]
    near = lambda p, q: p[1] == q[1] and (p[1] or None not in (p[2], q[2]) and abs(p[2] - q[2]) <= min(p[2], q[2]) * 0.2)
    assert sorted(got) == sorted((p[0], q[0]) for p in known for q in known if p[0] < q[0] and near(p, q))


def test_measures_are_computed_once_for_a_pair(spark):
    """No measure moves into the join's condition, and none is written out once more for the filter on the verdict."""
    s = MatchSettings(combine=True, use_ai=True)
    items = spark.createDataFrame([item(1, [fill(9, 16)]), item(2, [fill(8, 16)])], SCHEMA).withColumn("ph_flip", F.col("ph"))
    lines = matching.matches(items, s)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [x for x in lines if "zip_with(" in x]
    assert len(made) == 1 and "Generate inline" in made[0]


@pytest.mark.parametrize("kind", [dict(), dict(use_phash=True, flipped=True), dict(combine=True, flipped=True, use_ai=True, ai_percent=20, folder_mode="same", exclude_hard_links=True), dict(tolerance_percent=0, tolerance_most=9, folder_mode="different", flipped=True)])
def test_cells_decide_as_the_columns_do(spark, monkeypatch, kind):
    monkeypatch.setattr(pairs, "BLOCK", 9)
    rng = random.Random(5)
    rows = []
    for i in range(90):
        image, n = i % 6 == 0, 1 if i % 6 == 0 else 3
        frames = [[min(255, max(0, rng.choice([90, 140]) + rng.randrange(-40, 41))) for _ in range(16)] for _ in range(n)]
        ino, duration = str(rng.randrange(3)) if i % 4 else "", 0.0 if image else float(rng.choice([50, 58, 66, 75]))
        rows.append((*item(i, frames, [rng.getrandbits(8) for _ in range(n)], image, duration, [[rng.randrange(-90, 91) for _ in range(4)] for _ in range(n)], [rng.random() < 0.7 for _ in range(n)], [f"x/{rng.randrange(2)}"], rng.randrange(2), "d", ino), [rng.getrandbits(8) for _ in range(n)]))
    s = MatchSettings(**{"positions": 3, "percent": 87, "flipped": False, "ignore_black": False, "ignore_white": False, **kind})
    df = matching.with_mirrored(spark.createDataFrame(rows, SCHEMA + ", ph_flip array<long>"))
    found = matching.matches(df, s)
    assert "compare(" in found._jdf.queryExecution().optimizedPlan().toString()
    rows_of = lambda x: sorted((r.a, r.b, r.difference, r.flags) for r in x.collect())
    assert rows_of(found) == rows_of(matching.judged(matching.candidate_pairs(df, s), s)) and rows_of(found)


def mixed_items(n=90):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        image, k = i % 6 == 0, 1 if i % 6 == 0 else 3
        frames = [[min(255, max(0, rng.choice([90, 140]) + rng.randrange(-40, 41))) for _ in range(16)] for _ in range(k)]
        folders = [f"x/{rng.randrange(2)}"] + ["y/2"] * (i % 7 == 0)
        rows.append((*item(i, frames, [rng.getrandbits(8) for _ in range(k)], image, 0.0 if image else float(rng.choice([50, 58, 66, 75])), [[rng.randrange(-90, 91) for _ in range(4)] for _ in range(k)], [rng.random() < 0.7 for _ in range(k)], folders, rng.randrange(2), "d", str(rng.randrange(3)) if i % 4 else ""), [rng.getrandbits(8) for _ in range(k)]))
    return rows


def test_tally_returns_counts_from_cells(spark, monkeypatch):
    """No match leaves a task, and the counts are those of the matches."""
    monkeypatch.setattr(pairs, "BLOCK", 9)
    s = MatchSettings(positions=3, percent=87, combine=True, **PLAIN)
    df = spark.createDataFrame(mixed_items(), SCHEMA + ", ph_flip array<long>")
    told = matching.tally(df, s)
    assert "difference" not in told._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[0]
    flags = [r.flags for r in matching.matches(df, s).collect()]
    assert tuple(told.first()) == tuple(flags.count(f) for f in (24, 8, 16)) and all(told.first())
    assert tuple(matching.tally(df.limit(0), s).first()) == (0, 0, 0)


@pytest.mark.parametrize("kind", [dict(combine=True, flipped=True, use_ai=True, ai_percent=20, folder_mode="same", exclude_hard_links=True), dict(flipped=False), dict(use_phash=True, folder_mode="different", flipped=False)])
def test_pairs_are_explained_by_cells_as_by_the_columns(spark, monkeypatch, kind):
    """Every candidate pair comes once, from arrays, with what ``explain`` says of it."""
    monkeypatch.setattr(pairs, "BLOCK", 9)
    s = MatchSettings(**{"positions": 3, "percent": 87, "ignore_black": False, "ignore_white": False, **kind})
    df = spark.createDataFrame(mixed_items(), SCHEMA + ", ph_flip array<long>")
    told = matching.diagnosed(df, s)
    assert "compare(" in told._jdf.queryExecution().optimizedPlan().toString()
    rows_of = lambda x: sorted(map(tuple, x.collect()))
    got = rows_of(told)
    monkeypatch.setattr(matching, "_by_cells", lambda *a: None)
    plain = matching.diagnosed(df, s)
    assert got == rows_of(plain) and len({r[:2] for r in got}) == len(got) > 100 and [t for _, t in told.dtypes] == [t for _, t in plain.dtypes]


def test_rows_leave_a_cell_in_pieces(spark, monkeypatch):
    """A hot duration, of which all pairs match: a task holds some tiles of rows, not those of all its pairs."""
    s = MatchSettings(**PLAIN)
    df = spark.createDataFrame([item(i, [fill(9, 16)]) for i in range(300)], SCHEMA)
    tile, at_once, sizes = cells.TILE, cells.AT_ONCE, []
    monkeypatch.setattr(cells, "TILE", 16)
    monkeypatch.setattr(cells, "AT_ONCE", 100)
    table = pa.table({"id": range(300), "duration": [10.0] * 300, "tolerance": [2.0] * 300, "scoped": [True] * 300, "role": [cells.BOTH] * 300, "px": [bytes([9] * 16)] * 300, "pixels": [16] * 300})
    for batch in cells._Cell(table, s, False, 1, False, cells.FOUND).batches():
        sizes.append(batch.num_rows)
    assert max(sizes) <= 100 and sum(sizes) == 300 * 299 // 2
    monkeypatch.setattr(cells, "TILE", tile)
    monkeypatch.setattr(cells, "AT_ONCE", at_once)
    assert matching.matches(df, s).count() == 300 * 299 // 2


def test_rounding_of_floats_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(20000), -rng.random(20000), rng.integers(-16384, 16385, 20000) / 16384, rng.random(2000) * 1e-6, [0.0, -0.0, 1.0, -1.0, 0.0078125, -0.0078125, -1e-9, 5e-7]]).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in x], "x float")
    got = df.select(K.round6(F.col("x")).alias("a"), F.round(F.col("x").cast("double"), 6).alias("b")).collect()
    assert all(r.a == r.b and str(r.a) == str(r.b) for r in got)


def test_edges_of_groups_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    items = spark.createDataFrame([item(i, [fill(9, 16)]) for i in range(4)], SCHEMA).withColumn("ph_flip", F.col("ph"))
    edges = spark.createDataFrame([(0, 1, 0.0, 0), (1, 2, 0.0, 0), (2, 3, 0.0, 0)], "a long, b long, difference float, flags int")
    got = building.matched_groups(edges.mapInPandas(look, edges.schema), items, MatchSettings(**PLAIN)).collect()
    assert {(r.group_id, r.idx) for r in got} == {(0, i) for i in range(4)} and seen.value == 3


def test_large_components_are_folded(spark, monkeypatch):
    """A chain of more members than a group may have to be split: its links are one component, but the first item doesn't like the third."""
    monkeypatch.setattr(building, "MOST_MEMBERS", 3)
    df = spark.createDataFrame([item(i, [fill(9 + 20 * i, 16)]) for i in range(6)], SCHEMA).withColumn("ph_flip", F.col("ph"))
    s = MatchSettings(percent=91, **PLAIN)
    got = {(r.group_id, r.idx, r.is_rep) for r in building.matched_groups(matching.matches(df, s), df, s).collect()}
    assert got == {(0, 0, True), (0, 1, False), (2, 2, True), (2, 3, False), (4, 4, True), (4, 5, False)}


@pytest.mark.parametrize("more", [{}, {"flipped": False, "percent": 80}, {"use_phash": True}, {"combine": True, "quorum": 0.75}, {"use_ai": True, "ai_percent": 30}, {"ignore_black": True, "ignore_white": True}])
def test_rows_of_verdicts_are_those_of_pairs(more):
    rng = np.random.default_rng(8)
    n, s = 60, MatchSettings(**({"positions": 2, "percent": 84, "flipped": True, "ignore_black": False, "ignore_white": False} | more))
    base = rng.integers(0, 256, (6, 2, 16))
    frames = [np.clip(base[rng.integers(6)] + rng.integers(-60, 61, (2, 16)), 0, 255) for _ in range(n)]
    frames = [f.reshape(2, 4, 4)[:, :, ::-1].reshape(2, 16) if rng.random() < 0.3 else f for f in frames]
    image = rng.random(n) < 0.4
    cut = lambda values: [v[: 1 if k else 2].tolist() for v, k in zip(values, image)]
    members = pd.DataFrame({"id": rng.permutation(n) * 7, "is_image": image, "frames": cut(frames), "emb": cut(rng.integers(-127, 128, (n, 2, 4))), "emb_valid": cut(rng.random((n, 2)) < 0.8)})
    members["ph"], members["ph_flip"] = cut(rng.integers(0, 1 << 10, (n, 2))), cut(rng.integers(0, 1 << 10, (n, 2)))
    snaps = building.Snapshots(members, s)
    want = np.array([[snaps._similar(x, y) for y in range(n)] for x in range(n)])
    assert np.array_equal(np.array([snaps.row(x) for x in range(n)]), want) and want.sum() > n
    assert np.array_equal(snaps.row(3, np.arange(10, 30)), want[3, 10:30])
    # items in another form are taken one by one
    members.at[0, "frames"] = members.at[0, "frames"] * 2 if image[0] else members.at[0, "frames"]
    odd = building.Snapshots(members, s)
    assert np.array_equal(np.array([odd.row(x) for x in range(n)]), want)


@pytest.mark.parametrize("image,flipped", [(True, True), (False, True), (False, False)])
def test_bound_leaves_few_pairs_and_loses_none(monkeypatch, image, flipped):
    rng = np.random.default_rng(2)
    n, positions = 700, 1 if image else 4
    px = np.clip(rng.normal(128, 50, (n, positions, 16)), 0, 255).astype(np.uint8)
    px[::9] = np.clip(px[3::9][: len(px[::9])].astype(int) + rng.integers(-40, 41, px[::9].shape), 0, 255)
    px[::18] = px[::18].reshape(-1, positions, 4, 4)[..., ::-1].reshape(-1, positions, 16)
    s = MatchSettings(positions=4, percent=88, ignore_black=False, ignore_white=False, flipped=flipped)
    table = pa.table({"id": range(n), "duration": [10.0] * n, "tolerance": [2.0] * n, "scoped": [True] * n, "role": [cells.BOTH] * n, "px": [x.tobytes() for x in px], "pixels": [16] * n})
    rows = lambda: sorted((r["a"], r["b"], r["difference"], r["flags"]) for b in cells._Cell(table, s, image, positions, False, cells.FOUND).batches() for r in b.to_pylist())
    compared = []
    whole, some = cells._Cell._gaps, cells._Cell._gaps_of
    monkeypatch.setattr(cells._Cell, "_gaps", lambda self, f, x, y: (compared.append(len(x) * len(y)), whole(self, f, x, y))[1])
    monkeypatch.setattr(cells._Cell, "_gaps_of", lambda self, f, p, q: (compared.append(len(p)), some(self, f, p, q))[1])
    got, few = rows(), sum(compared)
    monkeypatch.setattr(cells._Cell, "_bounds", lambda self, px: None)
    compared.clear()
    assert rows() == got and len(got) > 20 and few < sum(compared) / 8


def test_explanation_agrees_with_matches(spark):
    rows = [item(1, [fill(5)], folders=["a"]), item(2, [fill(6)], folders=["a"]), item(3, [fill(200)], image=True, duration=0.0), item(4, [], folders=["a"])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ph_flip", F.col("ph"))
    s = MatchSettings(percent=98, ignore_black=False, ignore_white=False)
    r = matching.explain_pair(df, 1, 2, s).first()
    assert (r.match, r.problem, r.duration_ok, r.folder_ok, r.dark_a, round(r.frame_differences[0], 6)) == (True, None, True, True, [True], 0.003906)
    assert [matching.explain_pair(df, 1, i, s).first().problem for i in (3, 4)] == ["kinds", "frames"]
    assert set(found(spark, rows[:3], s)) == {(1, 2)}


def test_frame_hashes_of_mirrored_frames(spark):
    rng = np.random.default_rng(4)
    frames = rng.integers(0, 256, (3, 1024))
    df = spark.createDataFrame([(1, [f.tolist() for f in frames])], "id long, frames array<array<int>>")
    r = matching.with_mirrored(df, hashed=True).first()
    mirror = frames.reshape(3, 32, 32)[:, :, ::-1].reshape(3, -1)
    assert r.frames_flip == mirror.tolist() and r.ph_flip == K.phash_bits(mirror).tolist()


# Groups


def reference_split(n, links):
    """Majority pruning and splitting, step by step over sets."""

    def prune(nodes):
        alive, gone = list(nodes), []
        while alive:
            degree = [sum(y in links[x] for y in alive) for x in alive]
            k = degree.index(min(degree))
            if degree[k] >= len(alive) // 2:
                break
            gone.append(alive.pop(k))
        return alive, gone

    if n < 3:
        return [list(range(n))]
    kept, gone = prune(range(n))
    out, left = [kept] if len(kept) > 1 else [], list(gone)
    while left:
        part, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            for y in gone:
                if y in left and y in links[x] and y not in part:
                    part.add(y)
                    todo.append(y)
        left = [x for x in left if x not in part]
        stay, _ = prune(sorted(part))
        if len(stay) > 1:
            out.append(stay)
    return out


def test_split_of_random_graphs():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 16)
        p = rng.choice([0.15, 0.3, 0.5, 0.8])
        links = {x: set() for x in range(n)}
        for x in range(n):
            for y in range(x):
                if rng.random() < p:
                    links[x].add(y)
                    links[y].add(x)
        assert grouping.split_group(list(range(n)), lambda a, b: b in links[a]) == reference_split(n, links)


def test_components_of_a_long_chain(spark):
    """More rounds than any fixed number: a chain in a bad order, and a star."""
    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r.node: r.component for r in grouping.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000 + k: 1000 for k in range(300)}


def test_large_components_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(grouping, "MATRIX_BYTES", 20)
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "a long, b long")
    items = spark.createDataFrame([(k, [k * 20] * 1024) for k in [*range(10), 20, 21]], "id long, px array<int>")
    got = {(r.group_id, r.idx) for r in grouping.daisy_split(edges, items, 0.1).collect()}
    assert got == {(0, k) for k in range(10)} | {(20, 20), (20, 21)}


@pytest.mark.parametrize("hot", [1000, 2])
def test_hamming_pairs_lose_none(spark, monkeypatch, hot):
    monkeypatch.setattr(pairs, "HOT_SLICE", hot)
    rng = random.Random(hot)
    rows = [(i, rng.getrandbits(16)) for i in range(60)] + [(100 + i, rng.getrandbits(64) - (1 << 63)) for i in range(20)]
    rows += [(200 + i, rows[i][1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(63))) for i in range(30)]
    rows = [(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in rows]
    got = {(r.a, r.b): r.distance for r in pairs.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), 3).collect()}
    rep = {}
    for i, h in sorted(rows):
        rep.setdefault(h, i)
    gap = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert got == {(min(rep[x], rep[y]), max(rep[x], rep[y])): gap(x, y) for x in rep for y in rep if x != y and gap(x, y) <= 3} and got


@pytest.mark.parametrize("masked, mirrored", [(False, False), (True, False), (False, True)])
def test_frame_pairs_against_all_pairs(spark, monkeypatch, masked, mirrored):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (4, 1024))
    px = np.clip(base[rng.integers(0, 4, 50)] + rng.integers(-12, 13, (50, 1024)) * rng.integers(0, 2, (50, 1)), 0, 255)
    if mirrored:
        px[::2] = px[::2].reshape(-1, 32, 32)[:, :, ::-1].reshape(-1, 1024)
    rows = [(i, int(rng.integers(50, 140)) if i % 7 else 0, px[i].tolist()) for i in range(50)]
    got = {(r.a, r.b): round(r.diff, 6) for r in pairs.frame_pairs(spark.createDataFrame(rows, "id long, duration long, px array<int>"), 20, 0.02, mirrored, masked).collect()}
    expected = {}
    for i, d, _ in rows:
        for j, e, _ in rows:
            if i < j and abs(d - e) <= 0.2 * min(d, e):
                # pairs of neighbouring bands are compared from the lower band's side; a mirrored difference is the same either way
                a = px[i].reshape(32, 32)[:, ::-1].ravel() if mirrored else px[i]
                use = (a > 32) & (a < 240) & (px[j] > 32) & (px[j] < 240) if masked else np.ones(1024, bool)
                diff = np.abs(a - px[j])[use].sum() / use.sum() / 256
                if diff <= 0.02:
                    expected[i, j] = round(float(diff), 6)
    assert got == expected and got


@pytest.mark.parametrize("masked, letters", [(False, False), (True, False), (False, True), (True, True)])
def test_frame_bound_loses_no_pair(monkeypatch, masked, letters):
    monkeypatch.setattr(pairs._Bound, "FEW", 0)
    rng = np.random.default_rng(3)
    base = rng.choice([32, 97, 101, 105, 110, 114, 116, 117], (300, 1024), p=[0.16] + [0.12] * 7) if letters else rng.integers(0, 256, (300, 1024))
    noise = rng.integers(-1, 2, (300, 1024)) * rng.integers(0, 14, (300, 1))
    px = np.clip(np.concatenate([base, np.clip(base + noise, 0, 255)]), 0, 255).astype(np.uint8)
    bound = pairs._Bound(px[:400], px, np.arange(200, 600), 0.02, masked)
    assert not bound.all
    got = set(zip(*(v.tolist() for v in bound.left(px[200:])), strict=True))
    for i in range(400):
        near = np.flatnonzero(pairs._difference(np.repeat(px[i : i + 1], 400, axis=0), px[200:], masked) <= 0.02)
        assert {(i, int(j)) for j in near} <= got
    assert len(got) < 400 * 400 / 4


def test_frames_are_shuffled_a_few_times_only():
    """Each frame goes once into each cell; the old cells had a copy of each frame for every block of two bands."""
    rng = np.random.default_rng(1)
    bands, counts = np.unique(np.floor(rng.normal(600, 60, 500_000)).astype(int), return_counts=True)
    sizes = list(zip(bands.tolist(), counts.tolist(), strict=True))
    placed, cells = pairs._cells(sizes, 17)
    rows = {}
    for (_, first, parts), (_, n) in zip(placed, sizes, strict=True):
        for p in range(parts):
            rows[first + p] = rows.get(first + p, 0) + n / parts
    assert sum(rows[b] for b, _, _ in cells) < 8 * 500_000
    assert max(sum(rows[b] for b, c, _ in cells if c == cell) for cell in {c for _, c, _ in cells}) <= 2 * (pairs.OTHER_ROWS + pairs.MOST_ROWS)


def test_blocks_of_frames_are_larger_than_those_of_items():
    """A frame weighs more than its pairs cost: of as many rows, fewer copies; a task still holds a bounded number of frames, and no two bands that can meet miss each other."""
    rng = np.random.default_rng(1)
    bands, counts = np.unique(np.floor(rng.normal(600, 60, 500_000)).astype(int), return_counts=True)
    sizes = list(zip(bands.tolist(), counts.tolist(), strict=True))
    copies = []
    for how in ((), pairs.FRAMES):
        placed, cells = pairs._cells(sizes, 17, *how)
        rows, of = {}, {}
        for (k, first, parts), (_, n) in zip(placed, sizes, strict=True):
            for p in range(parts):
                rows[first + p] = rows.get(first + p, 0) + n / parts
                of.setdefault(k, set()).add(first + p)
        copies.append(sum(rows[b] for b, _, _ in cells))
        assert max(sum(rows[b] for b, c, _ in cells if c == cell) for cell in {c for _, c, _ in cells}) <= pairs.FRAMES[1] + pairs.FRAMES[2]
        held = {}
        for b, c, role in cells:
            held.setdefault(c, []).append((b, role))
        met = {frozenset((x, y)) for each in held.values() for x, r in each if r != pairs.RIGHT for y, _ in each}
        assert all(frozenset((x, y)) in met for k in of for h in range(k, k + 18) if h in of for x in of[k] for y in of[h] if x != y)
    assert copies[1] < 0.75 * copies[0]


# Partial matches


def test_dense_offset(spark):
    """A clip that holds slots 10 to 17 of a source of 40 lies at 50 seconds; another one nowhere."""
    rng = np.random.default_rng(3)
    unit = lambda n: [(np.round(v / np.linalg.norm(v) * 127)).astype(int).tolist() for v in rng.standard_normal((n, 384))]
    source, other = unit(40), unit(8)
    rows = [(1, k, 5, e, k != 3) for k, e in enumerate(source)] + [(2, k, 5, e, True) for k, e in enumerate(source[10:18])] + [(3, k, 5, e, True) for k, e in enumerate(other)]
    t = spark.createDataFrame(rows, "id long, slot int, interval int, emb array<int>, valid boolean")
    met = spark.createDataFrame([(1, 2), (1, 3)], "source long, clip long")
    got = partials.dense_matches(t, met, 0.89).collect()
    assert [(r.source, r.clip, r.offset, r.hits) for r in got] == [(1, 2, 50.0, 8)] and got[0].similarity > 0.99


def test_clips_are_assigned_and_verified(spark):
    m = spark.createDataFrame([(1, 3, 0.9, 1.0), (0, 3, 0.9, 2.0), (1, 4, 0.9, 3.0)], "source long, clip long, similarity double, offset double")
    assert sorted((r.source, r.clip) for r in grouping.assign_clips(m).collect()) == [(0, 3), (1, 4)]
    v = spark.createDataFrame([(0, 3, False), (1, 3, True), (1, 4, True)], "source long, clip long, passes boolean")
    assert sorted((r.source, r.clip) for r in partials.verified_clips(m, v).collect()) == [(1, 3), (1, 4)]


def test_audio_feed_is_independent_of_chunks(spark):
    rng = np.random.default_rng(8)
    pcm = (np.sin(np.arange(11025 * 7) * 0.1) * 9000 + rng.normal(0, 500, 11025 * 7)).astype("<i2")
    whole = audio.fingerprint(pcm)
    feed = audio.Feed()
    for part in np.split(pcm, sorted(rng.integers(0, len(pcm), 40))):
        feed.feed(part)
    assert (feed.finish() == whole).all() and len(whole) >= 6
    cuts = [0, 100, 30000, 30001, len(pcm)]
    df = spark.createDataFrame([(5, k, bytearray(pcm[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "id long, part int, pcm binary").repartition(3)
    assert audio.fingerprints(df).first().fp == whole.astype(int).tolist()
    assert len(audio.Feed().finish()) == 0


@pytest.mark.parametrize("slots", [2048, 5])
def test_dense_votes_count_every_hit(spark, monkeypatch, slots):
    """As the votes over a row for each hit, of which no row is made."""
    monkeypatch.setattr(partials, "SLOTS", slots)
    rng = np.random.default_rng(slots)
    rows = [(i, k, 5, rng.integers(-60, 61, 16).tolist(), bool(rng.random() < 0.9)) for i in range(4) for k in range(23)]
    t = spark.createDataFrame(rows, "id long, slot long, interval int, emb array<int>, valid boolean")
    met = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "source long, clip long")
    hits = partials.frame_hits(t, met, 0.3, K.signature_bound(0.3, 16))
    plain = audio.offset_votes(hits, partials.OFFSET_TOLERANCE, partials.LEAST_HITS)
    shown = lambda df: sorted((r.source, r.clip, round(r.similarity, 9), r.offset, r.hits) for r in df.collect())
    out = partials.dense_matches(t, met, 0.3)
    assert shown(out) == shown(plain) and shown(out)
    assert "words" not in out._jdf.queryExecution().optimizedPlan().toString() and "count(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_split_of_groups_whose_links_are_not_all_held():
    """Rows that aren't held are found again, as often as they are needed, with the result of a whole matrix."""
    rng = np.random.default_rng(12)
    for _ in range(150):
        n = int(rng.integers(1, 40))
        matrix = np.triu(rng.random((n, n)) < rng.choice([0.1, 0.25, 0.5, 0.8]), 1)
        matrix |= matrix.T
        for held in (1, 5, 64):
            links = grouping.Links(n, lambda k: matrix[k, k + 1 :], lambda k, low: matrix[low:k, k], held)  # noqa: B023
            assert links.bits.nbytes <= held * (held + 7) and (np.array([links.row(k) for k in range(n)]) == matrix).all()
            assert grouping.split_links(links.degree, links.row, held) == grouping.split_matrix(matrix)


def test_components_of_any_size_are_split(spark, monkeypatch):
    """A chain among copies, with links for three members held: split like a small one, and no budget leaves it whole."""
    assert grouping.MATRIX_BYTES == float("inf")
    monkeypatch.setattr(grouping, "HELD", 3)
    value = {k: k // 2 * 20 for k in range(40)} | {100 + k: 300 for k in range(5)}
    edges = spark.createDataFrame([(k, k + 1) for k in range(39)] + [(100, 100 + k) for k in range(1, 5)], "a long, b long")
    items = spark.createDataFrame([(k, [v] * 1024) for k, v in value.items()], "id long, px array<int>")
    similar = lambda a, b: abs(value[a] - value[b]) / 256 <= 0.1
    expected = {(min(g), x) for part in (range(40), range(100, 105)) for g in grouping.split_group(list(part), similar) for x in g}
    assert {(r.group_id, r.idx) for r in grouping.daisy_split(edges, items, 0.1).collect()} == expected
    assert len({g for g, _ in expected}) > 2 and (100, 104) in expected


@pytest.mark.parametrize("more", [{}, {"use_phash": True}])
def test_groups_of_any_size_are_split(spark, monkeypatch, more):
    """Twelve items that their first likes: with links for three held, split like a group whose links are all at hand."""
    s = MatchSettings(**({"percent": 91, "flipped": True, "ignore_black": False, "ignore_white": False} | more))
    rng = np.random.default_rng(4)
    rows = [item(0, [fill(100, 16)], ph=[0])] + [item(k, [fill(100 + 20 * (-1) ** k + int(rng.integers(-2, 3)), 16)], ph=[int(rng.integers(32)) << 4 * (k % 3)]) for k in range(1, 12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ph_flip", F.col("ph").cast("array<long>") if not more else F.transform("ph", lambda h: F.shiftright(h, 1)))
    edges = spark.createDataFrame([(0, k, 0.0, 0) for k in range(1, 12)], "a long, b long, difference float, flags int")
    snaps = building.Snapshots(df.toPandas(), s)
    group = [m[1] for m in grouping.replay_edges([(0, k, 0.0, 0) for k in range(1, 12)], snaps.similar)]
    matrix = np.array([[x != y and snaps.similar(min(x, y), max(x, y)) for y in group] for x in group])
    expected = {(min(group[k] for k in part), group[k]) for part in grouping.split_matrix(matrix) for k in part}
    for most in (3, 32_768):
        monkeypatch.setattr(building, "MOST_MEMBERS", most)
        assert {(r.group_id, r.idx) for r in building.matched_groups(edges, df, s).collect()} == expected
    assert expected != {(0, k) for k in group} and len(group) > 8
    rows = np.array([snaps.row(x, first=False) for x in range(12)])
    assert (rows == np.array([[snaps._similar(y, x) for y in range(12)] for x in range(12)])).all()
