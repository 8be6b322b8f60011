"""Scan settings: typed defaults, normalisation, profiles, and scopes kept for each library.

Settings that only concern a user interface or the running of media tools have no counterpart here.
"""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

from kindred.operators.matching import MatchSettings


@dataclass(frozen=True)
class ScanSettings:
    """The defaults of the domain."""

    scope_mode: str = "library"
    scope_folder_ids: tuple[str, ...] = ()
    scope_tags: tuple[str, ...] = ()
    scope_tags_match_all: bool = False
    include_sub_directories: bool = True
    exclude_folder_ids: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    scope_library_key: str = ""
    library_scopes: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()
    include_images: bool = True
    include_videos: bool = True
    folder_match_mode: str = "none"
    same_folder_depth: int = 1
    percent: float = 92
    use_phash: bool = False
    combine_gray_phash: bool = False
    phash_sample_ratio_percent: float = 60
    compare_horizontally_flipped: bool = True
    ignore_black_pixels: bool = True
    ignore_white_pixels: bool = True
    thumbnails: int = 1
    max_sampling_duration_seconds: float = 0
    percent_duration_difference: float = 20
    duration_difference_min_seconds: float = 0
    duration_difference_max_seconds: float = 0
    use_exif_creation_date: bool = False
    exclude_hard_links: bool = False
    filter_by_file_size: bool = False
    minimum_file_size: int = 0
    maximum_file_size: int = 999_999_999
    file_path_contains_texts: tuple[str, ...] = ()
    file_path_not_contains_texts: tuple[str, ...] = ()
    remember_deleted_content: bool = False
    enable_partial_clip_detection: bool = False
    partial_clip_min_ratio_percent: float = 10
    partial_clip_similarity_threshold_percent: float = 80
    partial_clip_require_visual_match: bool = True
    partial_clip_visual_threshold_percent: float = 85
    use_ai_matching: bool = False
    ai_percent: float = 94
    enable_ai_partial_detection: bool = False
    ai_partial_hit_percent: float = 89
    quality_criteria_order: tuple[str, ...] = ("duration", "frame_size", "bit_rate", "fps", "bits_per_pixel", "audio_bit_rate", "size")
    quality_criteria_disabled: tuple[str, ...] = ()
    results_sort_mode: str = "wasted_space"
    results_sort_descending: bool = True
    custom_knobs: tuple[tuple[str, object], ...] = ()


#: Ranges of the numbers that have one.
RANGES = {"thumbnails": (1, 64), "percent": (0, 100), "same_folder_depth": (1, 64), "phash_sample_ratio_percent": (1, 100), "ai_percent": (50, 100), "ai_partial_hit_percent": (70, 99)}
KNOBS = ("percent", "compare_horizontally_flipped", "ignore_black_pixels", "ignore_white_pixels", "enable_partial_clip_detection", "use_ai_matching", "enable_ai_partial_detection")
#: The knobs of each profile.
PROFILES = {
    "exact_and_near": {
        "percent": 98,
        "compare_horizontally_flipped": False,
        "ignore_black_pixels": False,
        "ignore_white_pixels": False,
        "enable_partial_clip_detection": False,
        "use_ai_matching": False,
        "enable_ai_partial_detection": False,
    },
    "edited_and_altered": {
        "percent": 92,
        "compare_horizontally_flipped": True,
        "ignore_black_pixels": True,
        "ignore_white_pixels": True,
        "enable_partial_clip_detection": False,
        "use_ai_matching": False,
        "enable_ai_partial_detection": False,
    },
    "ai_scan": {
        "percent": 92,
        "compare_horizontally_flipped": True,
        "ignore_black_pixels": True,
        "ignore_white_pixels": True,
        "enable_partial_clip_detection": False,
        "use_ai_matching": True,
        "enable_ai_partial_detection": True,
    },
    "deep_clean": {
        "percent": 92,
        "compare_horizontally_flipped": True,
        "ignore_black_pixels": True,
        "ignore_white_pixels": True,
        "enable_partial_clip_detection": True,
        "use_ai_matching": True,
        "enable_ai_partial_detection": True,
    },
}
SCOPE_KEYS = ("scope_mode", "scope_folder_ids", "scope_tags", "scope_tags_match_all", "exclude_folder_ids", "exclude_tags")


def normalised(saved: dict) -> ScanSettings:
    """Settings from saved values: unknown names and wrong types are dropped, numbers are brought into their ranges."""
    kept = {}
    for f in dataclasses.fields(ScanSettings):
        if f.name not in saved:
            continue
        v = saved[f.name]
        if isinstance(f.default, tuple):
            if isinstance(v, (list, tuple)):
                kept[f.name] = tuple(v)
        elif isinstance(f.default, bool) or isinstance(v, bool):
            if isinstance(f.default, bool) and isinstance(v, bool):
                kept[f.name] = v
        elif isinstance(f.default, (int, float)):
            if isinstance(v, (int, float)):
                kept[f.name] = v
        elif isinstance(v, type(f.default)):
            kept[f.name] = v
    for name, (lo, hi) in RANGES.items():
        if name in kept:
            v = float(kept[name])
            v = min(hi, max(lo, v)) if math.isfinite(v) else lo
            kept[name] = math.floor(v + 0.5) if name in ("thumbnails", "same_folder_depth") else v
    return ScanSettings(**kept)


def active_profile(s: ScanSettings) -> str:
    knobs = {k: getattr(s, k) for k in KNOBS}
    return next((name for name, values in PROFILES.items() if values == knobs), "custom")


def with_profile(s: ScanSettings, name: str) -> ScanSettings:
    """Settings with a profile's knobs; leaving a custom state keeps its knobs, which "custom" brings back."""
    if name == "custom":
        return dataclasses.replace(s, **dict(s.custom_knobs))
    kept = tuple((k, getattr(s, k)) for k in KNOBS) if active_profile(s) == "custom" else s.custom_knobs
    return dataclasses.replace(s, custom_knobs=kept, **PROFILES[name])


def with_library(s: ScanSettings, key: str) -> ScanSettings:
    """Settings with the scope of another library: the present scope is parked under its own library."""
    if s.scope_library_key in ("", key):
        return dataclasses.replace(s, scope_library_key=key)
    scopes = dict(s.library_scopes) | {s.scope_library_key: tuple((k, getattr(s, k)) for k in SCOPE_KEYS)}
    fresh = {k: getattr(ScanSettings(), k) for k in SCOPE_KEYS} | dict(scopes.pop(key, ()))
    return dataclasses.replace(s, scope_library_key=key, library_scopes=tuple(scopes.items()), **fresh)


def match_settings(s: ScanSettings) -> MatchSettings:
    """What of the settings decides a match."""
    return MatchSettings(
        positions=s.thumbnails, percent=s.percent, use_phash=s.use_phash, combine=s.combine_gray_phash, quorum=s.phash_sample_ratio_percent / 100, flipped=s.compare_horizontally_flipped, ignore_black=s.ignore_black_pixels,
        ignore_white=s.ignore_white_pixels, use_ai=s.use_ai_matching, ai_percent=s.ai_percent, folder_mode=s.folder_match_mode, folder_depth=s.same_folder_depth, exclude_hard_links=s.exclude_hard_links,
        tolerance_percent=s.percent_duration_difference, tolerance_least=s.duration_difference_min_seconds, tolerance_most=s.duration_difference_max_seconds,
    )


def workers(cores: int, wanted: int = 0) -> int:
    """Tasks at once on a machine: four fifths of its cores, some left to others, unless a number is wanted."""
    reserve = 2 if cores >= 8 else 1 if cores >= 2 else 0
    return wanted if wanted > 0 else max(1, min(cores - reserve, math.ceil(0.8 * cores)))
