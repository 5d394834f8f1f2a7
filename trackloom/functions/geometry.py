"""Scalar functions as column expressions: boxes, headings, zones, letterboxing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def heading(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360); 0 without displacement."""
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))


def heading_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def inverse_score(value: Column, limit: float) -> Column:
    """1 at zero, 0 at the limit and beyond; 0 for a limit that is not positive."""
    if limit <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - value / limit))


def zone_id(cx: Column, cy: Column, grid: int = 4) -> Column:
    """cell_row_col; clamped above only, so a centroid left of the frame gives a negative cell."""
    cell = lambda c: F.least((c * grid).cast("int"), F.lit(grid - 1))
    return F.concat(F.lit("cell_"), cell(cy).cast("string"), F.lit("_"), cell(cx).cast("string"))


def iou(a: tuple, b: tuple) -> Column:
    """Boxes as (x1, y1, x2, y2) columns; 0 when they are disjoint or empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    both = w * h
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [((x1 + x2) / 2).alias("xc"), ((y1 + y2) / 2).alias("yc"), (x2 - x1).alias("w"), (y2 - y1).alias("h")]


def letterbox(width: Column, height: Column, size: int = 1280) -> dict[str, Column]:
    """Scale, resized size (rounded half to even) and pads of a letterboxed frame."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w, h = F.bround(width * scale, 0).cast("int"), F.bround(height * scale, 0).cast("int")
    pad_w, pad_h = size - w, size - h
    return {
        "scale": scale, "new_width": w, "new_height": h,
        "pad_left": F.floor(pad_w / 2).cast("int"), "pad_right": F.ceil(pad_w / 2).cast("int"),
        "pad_top": F.floor(pad_h / 2).cast("int"), "pad_bottom": F.ceil(pad_h / 2).cast("int"),
    }


def unletterbox(x: Column, pad: Column, scale: Column, limit: Column) -> Column:
    """A letterbox coordinate in the original frame, clamped to it."""
    return F.greatest(F.lit(0.0), F.least(limit.cast("double"), (x - pad) / scale))


def overlay_boxes(rows: DataFrame, width: int, height: int, size: int = 1280) -> DataFrame:
    """(track_id, px1, py1, px2, py2, label): normalised boxes as whole pixels of the original frame, for drawing.

    Boxes were normalised by the frame's size in letterbox pixels, so that is undone first.
    """
    lb = letterbox(F.lit(width), F.lit(height), size)

    def pixel(c: str, full: int, pad: Column) -> Column:
        at = F.bround((F.col(c) * full - pad) / lb["scale"], 0)
        return F.greatest(F.lit(0), F.least(F.lit(full - 1), at.cast("int"))).alias(f"p{c}")

    boxes = [pixel(c, full, lb[pad]) for c, full, pad in (("x1", width, "pad_left"), ("y1", height, "pad_top"), ("x2", width, "pad_left"), ("y2", height, "pad_top"))]
    label = F.concat(F.coalesce("class_name", F.lit("object")), F.lit(" #"), F.coalesce(F.col("track_id").cast("string"), F.lit("?")))
    return rows.select("track_id", *boxes, label.alias("label"))


def speed_of(rows: DataFrame) -> Column:
    """A track's speed: ``speed_px_per_frame``, else ``speed``, else 0; columns that are absent count as null."""
    return F.coalesce(*(F.col(c).cast("double") for c in ("speed_px_per_frame", "speed") if c in rows.columns), F.lit(0.0))


def clip_start(frame: Column, fps: float = 30.0, lead: float = 1.5) -> Column:
    """Seconds at which a clip around a frame starts."""
    return F.greatest(F.lit(0.0), frame / fps - lead)


def clip_frames(center: Column, radius: int) -> Column:
    return F.sequence(F.greatest(F.lit(0), center - radius), center + radius)
