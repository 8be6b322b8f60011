"""Registered queries against plain versions over whole tables and whole texts."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from kindred.operators import pairs, partials, scope
from kindred.plans import catalogue
from tests.oracle import duck_rows

FOLDER = "/root/testdata/sf0.001"


def simhash(text):
    total = [0] * 64
    for w in text.split():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        total = [t + (1 if h >> (63 - i) & 1 else -1) for i, t in enumerate(total)]
    return sum(1 << (63 - i) for i, t in enumerate(total) if t > 0)


def expected_hamming(rows):
    h = sorted((i, simhash(t or "")) for i, t in rows)
    return sorted((a, b, (x ^ y).bit_count()) for k, (a, x) in enumerate(h) for b, y in h[k + 1 :] if (x ^ y).bit_count() <= 3)


def all_pairs(spark, folder):
    """Every pair of documents that pairs of classes and their members stand for; the links that are told must be as many."""
    classes, links = {}, {}
    for r in catalogue.QUERIES["hamming_links"](spark, folder).collect():
        classes.setdefault(r.class_id, []).append(r.id)
        links[r.id] = r.links
    out = [(x, y, 0) for m in classes.values() for x in m for y in m if x < y]
    for a, b, n in catalogue.QUERIES["hamming_pairs"](spark, folder).collect():
        out += [(min(x, y), max(x, y), n) for x in classes[a] for y in classes[b]]
    told = defaultdict(int)
    for x, y, _ in out:
        told[x] += 1
        told[y] += 1
    assert all(links[i] == told[i] for i in links)
    return sorted(out)


def test_hamming_pairs_of_whole_texts(spark, tmp_path):
    body = " ".join(f"word{k % 90}" for k in range(400))
    rows = [(1, body), (2, "Xord0" + body[5:]), (3, "word0 wo" + " other" * 300), (4, "word0 wo" + " again" * 300), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = all_pairs(spark, str(tmp_path))
    assert got == expected_hamming(rows)
    assert {g[:2] for g in got} == {(1, 2), (5, 6)}  # an early change is found, a common beginning is none


def test_hamming_pairs_of_the_tables(spark):
    _, rows = duck_rows("SELECT doc_id, text FROM documents", FOLDER)
    got = all_pairs(spark, FOLDER)
    assert got == expected_hamming([(r["doc_id"], r["text"]) for r in rows])


def test_folder_closure_of_all_parts(spark, tmp_path):
    spark.range(1, 1201).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["folder_closure"](spark, str(tmp_path)).collect()))
    assert got == sorted((k >> depth, k, depth) for k in range(1, 1201) for depth in range(k.bit_length()))


def test_folder_closure_of_over_a_million_rows(spark):
    folders = spark.range(1, 80_001).selectExpr("id", "CASE WHEN id >= 2 THEN id div 2 END AS parent")
    assert scope.folder_closure(folders).count() == sum(k.bit_length() for k in range(1, 80_001))


def test_not_a_match_keeps_large_groups(spark):
    _, rows = duck_rows("SELECT o_custkey AS g, o_orderkey AS k FROM orders WHERE o_custkey IS NOT NULL", FOLDER)
    groups, sets = defaultdict(list), defaultdict(set)
    for r in rows:
        groups[r["g"]].append(r["k"])
        if r["g"] // 3 % 2 == 0:
            sets[r["g"] // 3].add(r["k"])
    expected = {g: sorted(ks) for g, ks in groups.items() if len(ks) >= 2 and not any(s.issuperset(ks) for s in sets.values())}
    assert any(len(ks) > 12 for ks in expected.values())
    assert {r.group_id: r.ids for r in catalogue.QUERIES["not_a_match"](spark, FOLDER).collect()} == expected


def frame(text):
    n = len(text)
    return [sum(map(ord, text[k * n // 1024 : max((k + 1) * n // 1024, k * n // 1024 + 1)])) % 256 if n else 0 for k in range(1024)]


def test_frames_hold_the_whole_text(spark, tmp_path):
    body = " ".join(f"word{k % 90}" for k in range(900))
    rows = [(1, body), (2, body[:-3] + "xyz"), (3, body[:2000] + "other " * 500), (4, ""), (5, None), (6, "é" * 3)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.px for r in catalogue.items(spark, str(tmp_path)).collect()}
    assert got == {i: frame(t or "") for i, t in rows} and got[1] != got[2]


def test_audio_partials_of_whole_texts(spark, tmp_path):
    """Clips inside long texts against a plain version of the same rule: a shared run, the length's share, the best offset."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    long = [rng.choice(words) for _ in range(900)]
    clip = long[700:880]
    noisy = [w if k % 9 else rng.choice(words) for k, w in enumerate(clip)]
    rows = [(1, long, "en"), (2, clip, "en"), (3, noisy, "en"), (4, clip, "fr"), (5, long[:880], "en"), (6, long[:50], "en"), (7, [rng.choice(words) for _ in range(300)], "en"), (8, [], "en"), (9, clip[:90] + long[:90], "en")]
    spark.createDataFrame([(i, " ".join(w), g, "s", 0) for i, w, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    code = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    expected = []
    for i, a, g in rows:
        for j, b, h in rows:
            if i == j or g != h or not len(a) * 0.1 <= len(b) < len(a) * 0.95 or not {tuple(a[k : k + 4]) for k in range(len(a) - 3)} & {tuple(b[k : k + 4]) for k in range(len(b) - 3)}:
                continue
            sims = [sum(32 - (code(x) ^ code(y)).bit_count() for x, y in zip(a[o:], b)) / 32 / len(b) for o in range(len(a) - len(b) + 1)]
            if max(sims) >= 0.8:
                expected.append((i, j, round(max(sims), 6), sims.index(max(sims))))
    got = sorted(map(tuple, catalogue.QUERIES["audio_sliding_window"](spark, str(tmp_path)).collect()))
    assert got == expected and {(1, 2), (1, 3), (5, 2)} <= {g[:2] for g in got}


def test_fingerprints_are_shuffled_for_blocks_not_for_pairs(spark, monkeypatch):
    """Forty copies make a thousand pairs; several blocks of them meet, give what the pairs alone give, and no join carries fingerprints."""
    rng = random.Random(3)
    long = [rng.getrandbits(32) for _ in range(400)]
    rows = [(i, [x if rng.random() < 0.9 else rng.getrandbits(32) for x in long[: 400 - 9 * i]], i % 2) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, fp array<long>, folder int").withColumn("clip_ok", F.lit(True))
    monkeypatch.setattr(partials, "LEAST_WORDS", 1500)
    for key in (["folder"], None):
        found = partials.audio_candidates(items, 0.1, key=key)
        both = found.join(items.select(F.col("id").alias("source"), F.col("fp").alias("long_fp")), "source").join(items.select(F.col("id").alias("clip"), F.col("fp").alias("short_fp")), "clip")
        expected = sorted(map(tuple, pairs.sliding_window(both, 0.8).filter("similarity > 0").collect()))
        df = partials.audio_partials(items, 0.1, 0.8, key)
        assert sorted(map(tuple, df.collect())) == expected and len(expected) > 100
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "long_fp" not in plan


def test_phash_quorum_against_all_pairs(spark):
    import numpy as np

    from kindred.functions import kernels as K

    _, rows = duck_rows("SELECT doc_id, coalesce(text, '') AS text FROM documents", FOLDER)
    hashes = {}
    for r in rows:
        t = r["text"]
        thirds = [frame(t[len(t) * k // 3 : len(t) * (k + 1) // 3]) for k in range(3)]
        hashes[r["doc_id"]] = tuple(K.phash_bits(np.array(thirds)).view(np.uint64).tolist())
    rep = {}
    for i in sorted(hashes):
        rep.setdefault(hashes[i], i)
    expected = [(rep[h], i, 0.0) for i, h in hashes.items() if rep[h] != i]
    reps = sorted(rep.values())
    for n, a in enumerate(reps):
        for b in reps[n + 1 :]:
            gaps = [(x ^ y).bit_count() for x, y in zip(hashes[a], hashes[b])]
            if sum(g <= 5 for g in gaps) >= 2:
                expected.append((a, b, round(sum(gaps) / 192, 6)))
    got = sorted((a, b, round(d, 5)) for a, b, d in catalogue.QUERIES["phash_quorum"](spark, FOLDER).collect())
    assert got == sorted((a, b, round(d, 5)) for a, b, d in expected) and got


def _against_all_pairs(spark, rows, least):
    """audio_partials of rows (id, fp) against best offsets of all pairs, word by word."""
    items = spark.createDataFrame(rows, "id long, fp array<long>").withColumn("clip_ok", F.col("id") != 3)
    expected = []
    for i, a in rows:
        for j, b in rows:
            if j != 3 and len(a) * 0.1 <= len(b) < len(a) * 0.95 and any(a) and any(b):
                sims = [sum(32 - (x ^ y).bit_count() for x, y in zip(a[o:], b)) / (32 * len(b)) for o in range(len(a) - len(b) + 1)]
                if max(sims) >= least and max(sims) > 0:
                    expected.append((i, j, max(sims), sims.index(max(sims))))
    assert sorted(map(tuple, partials.audio_partials(items, 0.1, least).collect())) == sorted(expected)
    return {e[:2] for e in expected}


def test_clips_without_a_run_of_equal_seconds_are_found(spark):
    """Every third second differs, or each in a few bits: no four equal seconds in a row, and still alike; clips of one second, too."""
    rng = random.Random(8)
    long = [rng.getrandbits(32) for _ in range(300)]
    third = [x if k % 3 else rng.getrandbits(32) for k, x in enumerate(long[40:160])]
    bits = [x ^ sum(1 << b for b in rng.sample(range(32), 5)) for x in long[100:190]]
    rows = [(1, long), (2, third), (3, long[:100]), (4, bits), (5, long[7:12]), (6, long[9:10]), (7, [0] * 50), (8, [rng.getrandbits(32) for _ in range(70)])]
    assert {(1, 2), (1, 4), (5, 6)} <= _against_all_pairs(spark, rows, 0.8)
    _against_all_pairs(spark, rows, 0.45)


def test_clips_with_many_common_runs_keep_all_partners(spark):
    """The rarest runs of the clip are in other items than its source, which shares the commonest ones only."""
    rng = random.Random(6)
    word = lambda: rng.getrandbits(32)
    common, rare = [word() for _ in range(62)], [word() for _ in range(35)]
    clip, source = common + rare, [word() for _ in range(6)] + common + [word() for _ in range(60)]
    rows = [(1, source), (2, clip)] + [(10 + k, common + [word()]) for k in range(12)] + [(30 + k, rare + [word()]) for k in range(4)]
    assert (1, 2) in _against_all_pairs(spark, rows, 0.8)


def test_bound_of_alignments_loses_none():
    """Random, near and periodic fingerprints of all lengths, with bits as unlike as allowed and in single bits only, at several similarities."""
    import numpy as np

    rng = np.random.default_rng(2)
    word = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    longs = [word(n) for n in (1, 2, 9, 40, 131, 400, 900)] + [np.tile(word(3), 60), np.zeros(100, np.uint32), word(200) & 0xFFFF]
    shorts = []
    for x in longs:
        for share in (0.1, 0.3, 0.7, 0.9):
            n = max(1, int(len(x) * share))
            o = rng.integers(len(x) - n + 1)
            for flips in (0, 6, 7, 12):
                noise = np.array([sum(1 << int(b) for b in rng.choice(32, flips, False)) for _ in range(n)], np.uint32)
                shorts.append(x[o : o + n] ^ noise)
            shorts.append(x[o : o + n] ^ np.uint32(0x3F))
    for least in (0.3, 0.55, 0.8, 0.8125, 0.95, 1.0):
        left = [p for x, y in pairs.may_align(longs, shorts, 0.1, 0.95, least) for p in zip(x.tolist(), y.tolist())]
        gate = {(a, b) for a, x in enumerate(longs) for b, y in enumerate(shorts) if 0.1 * len(x) <= len(y) < 0.95 * len(x)}
        alike = {(a, b) for a, b in gate if pairs.best_offset(longs[a], shorts[b], least)[0] > 0}
        assert len(set(left)) == len(left) and alike <= set(left) <= gate and alike
        assert least < 0.8 or len(left) < len(alike) + 0.2 * len(gate)
