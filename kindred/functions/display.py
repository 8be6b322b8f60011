"""Values as people read them, and small rules of media: languages, rates, sample times, chips, error classes."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.kernels import hdr_rank

#: ISO 639-2 terminological codes and their bibliographic forms.
TERM_TO_BIB = {
    "sqi": "alb", "hye": "arm", "eus": "baq", "mya": "bur", "zho": "chi", "ces": "cze", "nld": "dut", "fra": "fre", "kat": "geo", "deu": "ger",
    "ell": "gre", "isl": "ice", "mkd": "mac", "mri": "mao", "msa": "may", "fas": "per", "ron": "rum", "slk": "slo", "bod": "tib", "cym": "wel",
}
#: Kinds of file extensions.
IMAGES = ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp", "heic", "heif", "avif", "jfif", "tif"]
VIDEOS = ["mp4", "wmv", "avi", "mkv", "flv", "mov", "mpg", "mpeg", "m4v", "asf", "f4v", "webm", "divx", "m2t", "m2ts", "vob", "ts", "mts", "3gp", "ogv", "rm", "rmvb", "mxf", "hevc", "av1", "vp8", "vp9", "3g2", "dv", "qt", "wtv"]
#: Phrases of decoder messages and their class, in order of precedence.
ERROR_PHRASES = [
    ("hw", ["lacking required capabilities", "hwaccel initiali", "failed setup for format", "no device available for decoder", "hwaccel transfer data failed", "cannot load nvcuda", "cannot load libcuda", "cannot load cuda", "hw_device_ctx", "device creation failed"]),
    ("codec", ["decoder not found", "unknown decoder", "no decoder for", "codec not currently supported"]),
    ("corrupt", ["moov atom not found", "invalid data found when processing input", "invalid nal unit size", "error splitting the input into nal units", "could not find codec parameters", "non-existing pps", "non-existing sps", "error while decoding", "partial file", "truncat"]),
    ("access", ["permission denied", "no such file or directory", "operation not permitted", "protocol not found"]),
    ("hw", ["generic error in an external library"]),
]


def display_language(tag: Column) -> Column:
    """The bibliographic code of a language tag in capitals; undetermined and missing as empty."""
    t = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in TERM_TO_BIB.items() for x in pair))
    return F.when(t == "und", "").otherwise(F.upper(F.coalesce(known[t], t)))


def join_languages(streams: Column, kind: str, untagged_too: bool = False) -> Column:
    """The languages of the streams (kind, language) of one kind, "?" for none; empty if none of them is tagged."""
    codes = F.transform(F.filter(streams, lambda s: F.lower(s["kind"]) == kind), lambda s: display_language(s["language"]))
    shown = F.array_join(F.transform(codes, lambda c: F.when(c == "", "?").otherwise(c)), ", ")
    return F.when(F.lit(untagged_too) | F.exists(codes, lambda c: c != ""), shown).otherwise("")


def kilobits(bits: Column) -> Column:
    """Bits in thousands, half-even."""
    return F.bround(F.coalesce(bits, F.lit(0)) / 1000).cast("long")


def bytes_label(n: Column, largest: str = "PB") -> Column:
    """0 B, 1.5 KB, 2.0 GB ..., in units up to the largest."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    steps = F.when(n == 0, "0 B")
    for i, unit in reversed(list(enumerate(units[: units.index(largest) + 1]))):
        steps = steps.when(F.lit(i == 0) | (n >= 1024**i), F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(" " + unit)))
    return steps


def clock(seconds: Column) -> Column:
    """0:42, 20:26, 1:02:03."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def span_label(milliseconds: Column) -> Column:
    """The two largest units of a time span: 2d 3h, 4h 5m, 6m 7s, 8s."""
    s = F.greatest(F.lit(0), F.floor(milliseconds / 1000 + 0.5)).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when((d > 0) & (h > 0), F.format_string("%dd %dh", d, h)).when(d > 0, F.format_string("%dd", d)).when((h > 0) & (m > 0), F.format_string("%dh %dm", h, m)).when(h > 0, F.format_string("%dh", h))
        .when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def sample_positions(count: int) -> list[float]:
    """Positions k / (count + 1), summed in single precision."""
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    out, at, step = [], 0.0, single(1 / (count + 1))
    for _ in range(count):
        at = single(at + step)
        out.append(at)
    return out


def sample_second(duration: Column, position: Column, most: float = 0) -> Column:
    return (F.least(duration, F.lit(float(most))) if most > 0 else duration) * position


def dense_times(duration: Column, most: int = 400) -> Column:
    """The times at which a timeline is sampled: one for each interval, ``most`` at most."""
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(duration / dense_interval(duration)).cast("int")))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * dense_interval(duration))


def dense_interval(duration: Column) -> Column:
    """Seconds between frames of a dense timeline: a sixtieth from 5 to 15, but never more than 400 frames."""
    return F.greatest(F.least(F.greatest(duration / 60, F.lit(5.0)), F.lit(15.0)), duration / 400)


def visual_sample_times(source: Column, clip: Column, fingerprint: Column, offset: Column) -> Column:
    """Times inside a clip at which a partial match is looked at, none near the ends."""
    window = F.least(clip, source - offset)
    window = F.when(fingerprint > 0, F.least(window, fingerprint)).otherwise(window)
    shares = F.when(window >= 9, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).when(window >= 3, F.array(F.lit(0.33), F.lit(0.66))).when(window > 0, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))
    return F.filter(F.transform(shares, lambda x: x * window), lambda t: (t < clip - 0.1) & (offset + t < source - 0.1))


def error_class(message: Column) -> Column:
    """The class of a decoder's message by the first phrase list that it meets."""
    t = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, phrases in ERROR_PHRASES:
        any_of = F.lit(False)
        for p in phrases:
            any_of = any_of | F.contains(t, F.lit(p))
        out = out.when(any_of, name)
    return out.otherwise("unknown")


def judge(value: Column, other: Column) -> Column:
    """better, worse or neutral against the other's value; neutral if there is none."""
    return F.when(other.isNull() | (value == other), "neutral").when(value > other, "better").otherwise("worse")


def hdr_chip(hdr: Column, other: Column) -> Column:
    """better, worse or neutral by the rank of HDR formats."""
    return judge(hdr_rank(F.coalesce(hdr, F.lit(""))), F.when(other.isNotNull(), hdr_rank(other)))


def library_key(path: Column) -> Column:
    """A readable name and a short hash of a library's path."""
    clean = F.regexp_replace(path, r"(.)[\\/]+$", "$1")
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(clean, r"([^\\/]*)$", 1), r"(?i)\.library$", ""), r"[^A-Za-z0-9_\- ]+", "_")
    return F.concat(F.coalesce(F.nullif(F.substring(name, 1, 40), F.lit("")), F.lit("library")), F.lit("-"), F.substring(F.sha1(F.lower(clean)), 1, 8))


def arguments(text: Column) -> Column:
    """The words of an argument line; quotes group words."""
    found = F.regexp_extract_all(text, F.lit("\"[^\"]*\"|'[^']*'|\\S+"), 0)
    return F.transform(found, lambda w: F.when(w.rlike("^(\"[^\"]*\"|'[^']*')$"), F.substring(w, F.lit(2), F.length(w) - 2)).otherwise(w))
