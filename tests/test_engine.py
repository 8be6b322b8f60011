"""Groups by the matcher, and the engine's commands, on a small library."""

import random

import pytest
from pyspark.sql import functions as F

from kindred import engine
from kindred.operators import building, grouping, matching
from kindred.operators.matching import MatchSettings
from kindred.plans import settings as S
from tests.test_matching import SCHEMA, fill, item, reference_split


@pytest.mark.parametrize("kind", [dict(), dict(use_phash=True), dict(combine=True, use_ai=True, ai_percent=90)])
def test_groups_against_a_plain_replay(spark, kind):
    """Verdicts of all pairs, without gates, decide representatives and majorities; the columns' verdict is the measure."""
    rng = random.Random(7)
    rows = []
    for i in range(40):
        shades = [rng.choice([20, 24, 28, 120, 124]) + rng.randrange(3) for _ in range(2)]
        frames = [[min(255, max(0, s + rng.randrange(4) + (4 * (x % 4) if i % 5 == 0 else 0))) for x in range(16)] for s in shades]
        rows.append(item(i, frames, [rng.getrandbits(2), rng.getrandbits(2)], duration=float(rng.choice([50, 58, 66, 75])), emb=[[rng.randrange(-60, 61) for _ in range(4)] for _ in range(2)], valid=[True, rng.random() < 0.5]))
    s = MatchSettings(positions=2, percent=98.5, quorum=1.0, ignore_black=False, ignore_white=False, flipped=True, **kind)
    df = matching.with_mirrored(spark.createDataFrame(rows, SCHEMA).withColumn("ph_flip", F.col("ph")))
    edges = matching.matches(df, s)
    whole = lambda n: df.select(F.struct(*df.columns).alias(n))
    like = {(r.x, r.y) for r in whole("a").join(whole("b")).filter("a.id <> b.id").withColumn("r", matching.verdict(F.col("a"), F.col("b"), s)["result"]).filter("r.match").select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    listed = sorted((r.a, r.b, r.difference, r.flags) for r in edges.collect())
    assert any((r[0], r[1]) not in {e[:2] for e in listed} for r in like if r[0] < r[1])  # gates left pairs out
    groups = {}
    for g, i, *rest in grouping.replay_edges(listed, lambda x, y: (x, y) in like):
        groups.setdefault(g, []).append((i, *rest))
    expected = set()
    for ms in groups.values():
        links = {p: {q for q in range(len(ms)) if p != q and (ms[min(p, q)][0], ms[max(p, q)][0]) in like} for p in range(len(ms))}
        for part in reference_split(len(ms), links):
            expected |= {(min(ms[k][0] for k in part), ms[k][0], round(ms[k][1], 5), ms[k][2], ms[k][3]) for k in part}
    got = {(r.group_id, r.idx, round(r.difference, 5), r.flags, r.is_rep) for r in building.matched_groups(edges, df, s).collect()}
    assert got == expected and len({r[0] for r in got}) > 2


def test_engine_commands(spark, tmp_path):
    def entry(i, shade, name="n", flags=0, duration=10.0):
        return (i, name, "mp4", 5, 6, "h", flags, False, duration, [fill(shade)], [0], [[0] * 4], [False], ["f"], "d", "")

    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    e = engine.Engine(spark, str(tmp_path / "lib"), S.normalised({"percent": 96, "ignore_black_pixels": False, "ignore_white_pixels": False, "compare_horizontally_flipped": False}))
    assert e.entries().count() == 0 and e.ping()
    fresh = spark.createDataFrame([entry(1, 100), entry(2, 101), entry(3, 200), entry(4, 201), entry(5, 202, flags=2), entry(6, 9, name="zebra")], engine.ENTRY)
    groups = lambda: sorted({r.id for r in rows} for rows in _by_group(e.compare()))
    found = e.scan(fresh, ids(1, 2, 3, 4, 5, 6))
    assert sorted((r.group_id, r.id) for r in found.collect()) == [(1, 1), (1, 2), (2, 3), (2, 4)]
    assert e.not_a_match_add([1, 2, 9]) == 1 and groups() == [{3, 4}]
    assert e.not_a_match_prune(ids(1, 2)) == 1 and len(groups()) == 2
    e.db_exclude(ids(4))
    assert groups() == [{1, 2}] and {r.id for r in e.db_excluded().collect()} == {4, 5}
    e.db_exclude(ids(4, 5), False)
    assert {frozenset(g) for g in groups()} == {frozenset({1, 2}), frozenset({3, 4, 5})}
    e.scan(spark.createDataFrame([entry(7, 55)], engine.ENTRY), ids(1, 3, 4, 5, 6, 7), remember_deleted=True)
    assert groups() == [{3, 4, 5}] and e.db_stats().first().tombstones == 1
    e.db_restore_deleted(ids(2))
    e.db_clear_entries(ids(3))
    assert {frozenset(g) for g in groups()} == {frozenset({1, 2}), frozenset({4, 5})}
    assert [r.id for r in e.db_list("ZEB").collect()] == ["6"] and e.diagnose(1, 2).first().match
    e.db_cleanup(ids(1, 2, 6))
    assert {r.id for r in e.entries().collect()} == {1, 2, 6}
    rows = spark.createDataFrame([("a1", "n", "mp4", 1)], "id string, name string, ext string, group_id long")
    e.results_save(rows)
    assert e.results_load(rows.schema).count() == 1 and {"scan", "compare", "diagnose", "db_list", "results_save", "logs"} <= set(e.commands())
    e.db_clear()
    assert e.entries().count() == 0 and e.logs()


def _by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, []).append(r)
    return out.values()


def test_presets():
    p = engine.Presets(2, 3)
    for n in "abc":
        p.save(n, n.upper())
    for v in (1, 2, 1, 3, 4):
        p.used(v)
    assert p.top() == ["c", "b"] and p.get("a") == "A" and p.history() == [4, 3, 1]
