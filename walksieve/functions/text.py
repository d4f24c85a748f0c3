"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one dash, no outer dashes."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def join_present(sep: str, *parts: Column) -> Column:
    """The non-empty parts, joined."""
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])


def face_name(pano_idx: Column, yaw: Column) -> Column:
    return F.format_string("y%03d_%05d.jpg", yaw.cast("int"), pano_idx.cast("int"))


def neighbour_name(pano_idx: Column, yaw: Column) -> Column:
    return F.format_string("n%05d_y%03d.jpg", pano_idx.cast("int"), yaw.cast("int"))


def fixed(value: Column, places: int) -> Column:
    """`value` with that many decimals, rounded by its exact binary value, ties to even.

    `format_string` rounds the shortest decimal form up instead, which differs
    on values such as 0.125. NULL stays NULL.
    """
    size, unit, one = F.abs(value), 10 ** places, F.lit(2 ** 62)
    whole = F.floor(size).cast("long")
    # the fraction in units of 2^-62 is a whole number
    bits = ((size - whole) * float(2 ** 62)).cast("long").cast("decimal(20,0)")
    scaled = bits * F.lit(unit).cast("decimal(6,0)")
    low = F.floor(scaled / one.cast("decimal(20,0)")).cast("long")
    over = scaled - low.cast("decimal(10,0)") * one.cast("decimal(20,0)")
    half = F.lit(2 ** 61).cast("decimal(20,0)")
    up = (over > half) | ((over == half) & (low % 2 == 1))
    total = whole * unit + low + up.cast("long")
    tail = F.lpad((total % unit).cast("string"), places, "0")
    sign = F.when((value < 0) & (total > 0), "-").otherwise("")
    return F.concat(sign, F.floor(total / unit).cast("string"), F.lit("."), tail)


def export_name(prefix: Column, t_sec: Column, yaw: Column) -> Column:
    stamp = F.lpad(fixed(t_sec, 1), 6, "0")
    return F.concat(prefix, F.lit("_t"), stamp, F.lit("_y"),
                    F.format_string("%03d", yaw.cast("int")), F.lit(".jpg"))


def shot_stamp(name: Column) -> Column:
    """``YYYY-MM-DDTHH:MM`` from a camera file name, or ''."""
    # fixed pattern: the stamp in the camera's file names
    found = "VID_([0-9]{4})([0-9]{2})([0-9]{2})_([0-9]{2})([0-9]{2})[0-9]{2}_"
    part = [F.regexp_extract(name, found, i) for i in range(1, 6)]
    stamp = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2],
                     F.lit("T"), part[3], F.lit(":"), part[4])
    return F.when(part[0] != "", stamp).otherwise(F.lit(""))


def backbone_label(name: Column) -> Column:
    """A readable name for a backbone; other names pass through."""
    found = r"vit_(base|small|large)_patch(\d+)_(\w+?)[._]"
    size, patch, family = (F.regexp_extract(name, found, i) for i in (1, 2, 3))
    sizes = (F.when(size == "base", "B").when(size == "small", "S")
             .when(size == "large", "L"))
    families = (F.when(family == "dinov3", "DINOv3").when(family == "dinov2", "DINOv2")
                .when(family == "clip", "CLIP").otherwise(family))
    return F.when(size != "", F.concat(families, F.lit(" ViT-"), sizes, F.lit("/"), patch)) \
        .otherwise(name)


def segmenter_label(name: Column) -> Column:
    """A readable name for a segmentation model; other names pass through."""
    size = F.regexp_extract(name, r"segformer-(b\d)-finetuned-ade", 1)
    return (F.when(size != "", F.concat(F.lit("SegFormer-"), F.upper(size), F.lit(" · ADE20K")))
            .when(name.contains("mask2former"), "Mask2Former-L · ADE20K")
            .when(name.contains("oneformer"), "OneFormer-L · ADE20K")
            .when(name.contains("grounding-dino"), "Grounding DINO + SAM · your classes")
            .otherwise(name))


def clock_text(seconds: Column) -> Column:
    """m:ss."""
    whole = F.round(F.coalesce(seconds, F.lit(0.0))).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"),
                    F.format_string("%02d", whole % 60))
