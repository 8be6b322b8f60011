"""Kernels at the boundaries that their domain fixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import audio, difference_map as D, kernels as K


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_mean_difference_and_mask(spark):
    df = one(spark, a=[0] * 1024, b=[255] * 1024, c=[100] * 1024, d=[110] * 1024)
    r = df.select(K.mean_difference(F.col("a"), F.col("b")).alias("x"), K.mean_difference(F.col("c"), F.col("d")).alias("y"), K.masked_difference(F.col("a"), F.col("b")).alias("z"), K.masked_difference(F.col("c"), F.col("d")).alias("w")).first()
    assert (r.x, r.y, r.z, r.w) == (255 / 256, 0.0390625, None, 0.0390625)


@pytest.mark.parametrize("dark, expected", [(79, False), (80, True)])
def test_dark_boundary(spark, dark, expected):
    assert one(spark, p=[32] * dark + [33] * (100 - dark)).select(K.is_dark(F.col("p")).alias("d")).first().d is expected


def test_flip_twice_is_identity(spark):
    px = np.random.default_rng(0).integers(0, 256, 1024).tolist()
    r = one(spark, p=px).select(K.flip(F.col("p")).alias("f"), K.flip(K.flip(F.col("p"))).alias("g")).first()
    assert r.g == px and r.f == np.array(px).reshape(32, 32)[:, ::-1].ravel().tolist()


def test_phash_budget_and_hash(spark):
    assert (K.max_bits(0.9, True), K.max_bits(0.9, False), K.max_bits(0.92, True)) == (6, 6, 5)
    with pytest.raises(ValueError):
        K.max_bits(1.5, True)
    frames = np.random.default_rng(1).integers(0, 256, (20, 1024))
    n, k = np.arange(32), np.arange(1, 9)
    for frame, bits in zip(frames, K.phash_bits(frames).view(np.uint64), strict=True):
        c = np.cos(np.pi * (2 * n + 1)[None] * k[:, None] / 64)
        ac = (c @ frame.reshape(32, 32) @ c.T).ravel()
        full = sum(1 << i for i in range(64) if ac[i] > np.median(ac))
        assert bin(full ^ int(bits)).count("1") <= 2


def test_quorum(spark):
    df = one(spark, a=[0, 0], b=[0, 0xFFFF])
    r = df.select(K.quorum_matches(F.col("a"), F.col("b"), 6, 0.5).alias("half"), K.quorum_matches(F.col("a"), F.col("b"), 6, 0.75).alias("most")).first()
    assert r.half.matches and not r.most.matches and r.half.difference == 0.125


def test_tolerance_folder_wildcard(spark):
    df = one(spark, d=100.0, p="A\\b/C/", t="x\nY.mp4")
    r = df.select(
        K.duration_tolerance(F.col("d"), 20, 5, 10).alias("a"), K.duration_tolerance(F.col("d"), 0, 5, 10).alias("b"), K.folder_suffix(F.col("p"), 2).alias("c"), K.folder_suffix(F.col("p"), 4).alias("e"),
        F.col("t").rlike(K.wildcard_pattern("x*y.MP?")).alias("w"), F.col("t").rlike(K.wildcard_pattern("y*")).alias("v"),
    ).first()
    assert (r.a, r.b, r.c, r.e, r.w, r.v) == (10.0, 10.0, "b/c", "/a/b/c", True, False)


def test_duration_and_hdr(spark):
    df = spark.createDataFrame([("1:02:03.9",), ("12.7",), ("-3",), ("x",)], ["t"])
    assert [r.s for r in df.select(K.parse_duration(F.col("t")).alias("s")).collect()] == [3723, 12, 0, None]
    h = one(spark, a=["DOVI configuration record"], b=["HDR10+ metadata"], c=[""]).select(*(K.hdr_format(F.lit("smpte2084"), F.col(x)).alias(x) for x in "abc"), K.hdr_format(F.lit("arib-std-b67"), F.col("c")).alias("d")).first()
    assert tuple(h) == ("Dolby Vision", "HDR10+", "HDR10", "HLG")


def test_signature(spark):
    r = one(spark, q=[-1] + [1] * 62 + [-5]).select(K.sign_signature(F.col("q")).alias("s")).first()
    assert r.s & 1 and r.s < 0 and bin(r.s & (2**64 - 1)).count("1") == 2


def test_audio_fingerprint_of_silence_and_tone():
    assert not audio.fingerprint(np.zeros(11025 * 4)).any()
    t = np.arange(11025 * 6) / 11025
    tone = np.concatenate([np.sin(2 * np.pi * f * t[:11025]) for f in (220, 330, 440, 550, 660, 880)])
    assert audio.fingerprint(tone).any() and (audio.fingerprint(tone) == audio.fingerprint(tone)).all()
    assert audio.majority(np.array([1, 3, 2], np.uint32)) == 3


def test_difference_map():
    y, x = np.mgrid[0:64, 0:64]
    base = ((x // 8 + y // 8) % 2) * 100.0 + 50
    assert not D.difference_mask(base, base * 1.5 + 10, 0.5).any()
    logo = base.copy()
    logo[40:56, 40:56] = 255 - logo[40:56, 40:56]
    logo[41:55, 41:55] = 400
    (box,) = D.regions(D.difference_mask(base, logo, 0.5))
    assert abs(box[0] * 64 - 40) <= 8 and abs(box[1] * 64 - 40) <= 8
    assert not D.difference_mask(np.zeros((8, 8)), np.ones((8, 8)), 1).any()
