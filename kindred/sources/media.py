"""Media metadata from probe output: streams, durations, bit rates, languages; dates from EXIF."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.kernels import hdr_format, language_tag, parse_duration

_PROBE = """struct<format:struct<duration:string,bit_rate:string>,streams:array<struct<index:int,codec_name:string,codec_type:string,width:int,height:int,
r_frame_rate:string,bit_rate:string,sample_rate:string,channels:int,color_transfer:string,tags:struct<language:string>,
disposition:struct<attached_pic:int>,side_data_list:array<struct<side_data_type:string>>>>>"""


def frame_rate(text: Column) -> Column:
    """num/den as a single-precision number, -1 if there is none."""
    n, d = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(F.when((d != 0) & (n >= 0), (n / d).cast("float")), F.lit(-1.0).cast("float"))


def media_info(probe_json: Column) -> Column:
    """struct<duration, streams> from a probe's JSON; the container's bit rate goes to the first stream if none has one."""
    p = F.from_json(probe_json, _PROBE)
    streams = F.coalesce(p["streams"], F.array().cast("array<struct<index:int,codec_name:string,codec_type:string,width:int,height:int,r_frame_rate:string,bit_rate:string,sample_rate:string,channels:int,color_transfer:string,tags:struct<language:string>,disposition:struct<attached_pic:int>,side_data_list:array<struct<side_data_type:string>>>>"))
    known = F.exists(streams, lambda s: s["bit_rate"].try_cast("long").isNotNull())

    def stream(s: Column, i: Column) -> Column:
        rate = F.coalesce(s["bit_rate"].try_cast("long"), F.when(~known & (i == 0), p["format"]["bit_rate"].try_cast("long")), F.lit(0))
        return F.struct(
            s["index"].alias("index"), s["codec_name"].alias("codec"), s["codec_type"].alias("kind"), F.coalesce(s["width"], F.lit(0)).alias("width"), F.coalesce(s["height"], F.lit(0)).alias("height"),
            frame_rate(s["r_frame_rate"]).alias("fps"), rate.alias("bit_rate"), F.coalesce(s["sample_rate"].try_cast("int"), F.lit(0)).alias("sample_rate"), F.coalesce(s["channels"], F.lit(0)).alias("channels"),
            hdr_format(s["color_transfer"], F.coalesce(F.transform(s["side_data_list"], lambda x: x["side_data_type"]), F.array().cast("array<string>"))).alias("hdr"),
            language_tag(s["tags"]["language"]).alias("language"), (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 1).alias("is_cover"),
        )

    return F.struct(parse_duration(p["format"]["duration"]).alias("duration"), F.transform(streams, stream).alias("streams"))


def video_stream(streams: Column) -> Column:
    """The video stream with the most pixels, cover art only where there is no other; the first of equals."""
    videos = F.filter(streams, lambda s: s["kind"] == "video")
    real = F.filter(videos, lambda s: ~s["is_cover"])
    pool = F.when(F.size(real) > 0, real).otherwise(videos)
    most = F.array_max(F.transform(pool, lambda s: s["width"] * s["height"]))
    return F.get(F.filter(pool, lambda s: s["width"] * s["height"] == most), F.lit(0))


def audio_stream(streams: Column) -> Column:
    """The audio stream with the most channels; the first of equals."""
    audio = F.filter(streams, lambda s: s["kind"] == "audio")
    return F.get(F.filter(audio, lambda s: s["channels"] == F.array_max(F.transform(audio, lambda x: x["channels"]))), F.lit(0))


#: Kinds of values of a tag, by number: (bytes, form).
_KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II")}


def _directory(blob: bytes, order: str, at: int) -> dict[int, object]:
    """The tags of a directory: texts, numbers, fractions (as "n/d"); other kinds are left out."""
    out = {}
    for i in range(struct.unpack_from(order + "H", blob, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
        if kind not in _KINDS:
            continue
        size, form = _KINDS[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            place = struct.unpack_from(order + "I", blob, place)[0]
        if place + size * count > len(blob):
            continue
        if kind == 2:
            out[tag] = blob[place : place + count].split(b"\0")[0].decode("ascii", "replace")
        elif kind == 5:
            pairs = [struct.unpack_from(order + "II", blob, place + 8 * k) for k in range(count)]
            out[tag] = ", ".join(f"{n}/{d}" for n, d in pairs)
        else:
            values = struct.unpack_from(f"{order}{count}{form}", blob, place)
            out[tag] = values[0] if len(values) == 1 else ", ".join(map(str, values))
    return out


def tiff_tags(blob: bytes) -> dict[int, object]:
    """All tags of a TIFF block's first directory and of its Exif directory."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None:
        return {}
    try:
        main = _directory(blob, order, struct.unpack_from(order + "I", blob, 4)[0])
        return main | (_directory(blob, order, main[0x8769]) if isinstance(main.get(0x8769), int) else {})
    except struct.error:
        return {}


def _tiff_date(blob: bytes) -> str | None:
    """DateTimeOriginal, else DateTime, of a TIFF block."""
    tags = tiff_tags(blob)
    found = tags.get(0x9003) or tags.get(0x0132)
    return found if isinstance(found, str) else None


def exif_block(content: bytes) -> bytes | None:
    """The TIFF block of a JPEG, PNG, WebP or TIFF file, wherever in the file its segment or chunk stands."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            mark = content[at + 1]
            if mark == 0xFF:  # padding
                at += 1
                continue
            if mark in (0xDA, 0xD9):  # the picture itself, or its end
                return None
            size = struct.unpack_from(">H", content, at + 2)[0]
            if mark == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":  # a segment that tells no length goes to the end
                return content[at + 10 : at + 2 + size if size >= 8 else len(content)]
            if size < 2:
                return None
            at += 2 + size
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack_from(">I", content, at)[0], content[at + 4 : at + 8]
            if kind == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(content):
            kind, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
            if kind == b"EXIF":
                block = content[at + 8 : at + 8 + size]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + size + size % 2
    return None


@F.pandas_udf(T.MapType(T.IntegerType(), T.StringType()))
def exif_tags(content: pd.Series) -> pd.Series:
    """All EXIF tags of each file's bytes, by number."""
    return pd.Series([{k: str(v) for k, v in tiff_tags(b).items()} if c is not None and (b := exif_block(bytes(c))) else {} for c in content], dtype=object)


def container_tags(probe_json: Column) -> Column:
    """All tags of a probe's container, by lower-case name."""
    tags = F.coalesce(F.from_json(probe_json, "struct<format:struct<tags:map<string,string>>>")["format"]["tags"], F.create_map().cast("map<string,string>"))
    return F.transform_keys(tags, lambda k, v: F.lower(k))


def creation_time(probe_json: Column) -> Column:
    """When a container was made, by its tag; null if there is none or it is no time."""
    return F.try_to_timestamp(F.try_element_at(container_tags(probe_json), F.lit("creation_time")))


@F.pandas_udf(T.StringType())
def exif_date_text(content: pd.Series) -> pd.Series:
    """The raw EXIF date of each file's bytes."""
    return pd.Series([_tiff_date(b) if c is not None and (b := exif_block(bytes(c))) else None for c in content], dtype=object)


def exif_date(content: Column) -> Column:
    """When a picture was taken; null for what is no date from 1800 on."""
    t = F.try_to_timestamp(exif_date_text(content), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.when(F.year(t) >= 1800, t)
