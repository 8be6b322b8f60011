"""Settings, profiles, scopes and display rules."""

from pyspark.sql import functions as F

from kindred.functions import display
from kindred.plans import settings as S


def test_normalisation():
    s = S.normalised({"percent": 140, "thumbnails": 0, "ai_percent": float("nan"), "nope": 1, "use_phash": "yes", "scope_tags": ["a"], "include_images": False})
    assert (s.percent, s.thumbnails, s.ai_percent, s.use_phash, s.scope_tags, s.include_images) == (100, 1, 50, False, ("a",), False)


def test_profiles():
    s = S.ScanSettings()
    assert S.active_profile(s) == "edited_and_altered"
    own = S.normalised({"percent": 77})
    back = S.with_profile(S.with_profile(own, "deep_clean"), "custom")
    assert S.active_profile(own) == "custom" and S.active_profile(S.with_profile(own, "deep_clean")) == "deep_clean" and back.percent == 77


def test_library_scopes():
    a = S.with_library(S.normalised({"scope_mode": "tags", "scope_tags": ["x"]}), "A")
    b = S.with_library(a, "B")
    assert (a.scope_mode, b.scope_mode, S.with_library(b, "A").scope_tags) == ("tags", "library", ("x",))


def test_display(spark):
    r = spark.range(1).select(
        display.span_label(F.lit(90061000)).alias("a"), display.span_label(F.lit(65000)).alias("b"), display.library_key(F.lit("C:\\\\My pics.library\\\\")).alias("c"),
        display.arguments(F.lit("-vf \"scale 2\" 'a b' x")).alias("d"), display.kilobits(F.lit(2500)).alias("e"), display.display_language(F.lit(" DEU ")).alias("f"),
    ).first()
    assert (r.a, r.b, r.d, r.e, r.f) == ("1d 1h", "1m 5s", ["-vf", "scale 2", "a b", "x"], 2, "GER") and r.c.startswith("My pics-") and len(r.c) == 16
    assert len(display.sample_positions(3)) == 3 and abs(display.sample_positions(3)[1] - 0.5) < 1e-6
