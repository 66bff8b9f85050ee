"""Source maps: arrays of (start, end, origin) in bytes, and where an offset or a range comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_boxes(a: Column, b: Column) -> Column:
    """The smallest box around both; sizes are not negative."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right = F.greatest(a["x"] + a["width"], b["x"] + b["width"])
    bottom = F.greatest(a["y"] + a["height"], b["y"] + b["height"])
    zero = F.lit(0).cast("float")
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(right - x, zero).alias("width"), F.greatest(bottom - y, zero).alias("height"))


def resolve(segments: Column, offset: Column) -> Column:
    """Origin of an offset: of the segment that holds it, else of the last; null if there is none."""
    inside = F.get(F.filter(segments, lambda s: (s["start"] <= offset) & (offset < s["end"])), F.lit(0))
    return F.coalesce(inside["origin"], F.try_element_at(segments, F.lit(-1))["origin"])


def resolve_range(segments: Column, start: Column, end: Column) -> Column:
    """Origin of a range: of its first segment; on a page, the box around its segments on that page."""
    hit = F.filter(segments, lambda s: (s["start"] < end) & (s["end"] > start))

    def of(found: Column) -> Column:
        first = F.get(found, F.lit(0))["origin"]
        boxes = F.transform(F.filter(found, lambda s: (s["origin"]["page"] == first["page"]) & s["origin"]["bbox"].isNotNull()), lambda s: s["origin"]["bbox"])
        box = F.aggregate(boxes, F.get(boxes, F.lit(0)), merge_boxes)
        page = F.struct(first["origin_type"].alias("origin_type"), first["line"].alias("line"), first["col"].alias("col"), first["page"].alias("page"), box.alias("bbox"))
        return F.when(F.size(found) == 0, resolve(segments, start)).when(first["origin_type"] == "PdfPage", page).otherwise(first)

    return F.get(F.transform(F.array(hit), of), F.lit(0))
