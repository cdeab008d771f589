"""Boxes on pages: overlaps, suppression and reading order."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def area(b: Column) -> Column:
    return F.greatest(F.get(b, 2) - F.get(b, 0), F.lit(0.0)) * F.greatest(F.get(b, 3) - F.get(b, 1), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(F.get(a, 2), F.get(b, 2)) - F.greatest(F.get(a, 0), F.get(b, 0))
    h = F.least(F.get(a, 3), F.get(b, 3)) - F.greatest(F.get(a, 1), F.get(b, 1))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def _iou(a: list[float], b: list[float]) -> float:
    both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def suppress(boxes: DataFrame, most: float = 0.45) -> DataFrame:
    """Greedy suppression by score within page and label: a box goes if a better one that stays overlaps it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for i in pdf.sort_values(["score", "box_id"], ascending=[False, True], kind="stable").index:
            if all(_iou(pdf.at[i, "bbox"], pdf.at[j, "bbox"]) <= most for j in kept):
                kept.append(i)
        return pdf.loc[kept]

    return boxes.groupBy("page_id", "label").applyInPandas(run, boxes.schema)


def drop_nested(boxes: DataFrame, share: float = 0.8) -> DataFrame:
    """Without boxes that lie inside a larger one of their label on their page."""
    a, b = boxes.alias("a"), boxes.select("page_id", "label", F.col("box_id").alias("other"), F.col("bbox").alias("outer_box")).alias("b")
    inside = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.label") == F.col("b.label")) & (F.col("box_id") != F.col("other")) & (area(F.col("outer_box")) > area(F.col("bbox"))) & (intersection(F.col("bbox"), F.col("outer_box")) >= share * area(F.col("bbox")))
    return a.join(b, inside, "left_anti")


def _blank_band(spans: list[tuple[float, float]], gap: float) -> float | None:
    """The middle of the widest band of at least ``gap`` that no span covers."""
    spans = sorted(spans)
    reach = list(accumulate((end for _, end in spans), max))
    widest = max(((start - r, -k) for k, (r, (start, _)) in enumerate(zip(reach, spans[1:], strict=False))), default=(0.0, 0))
    if widest[0] < gap or widest[0] <= 0:
        return None
    k = -widest[1]
    return (reach[k] + spans[k + 1][0]) / 2


def reading_order(boxes: list[list[float]], gap: float = 6.0) -> list[int]:
    """Indexes in reading order: a region is cut at its widest empty column, else at its widest empty row, and each half is read by itself;
    one that cannot be cut is read by top (to a tenth) and left."""
    order: list[int] = []
    regions = [list(range(len(boxes)))]
    while regions:
        region = regions.pop()
        for axis in (0, 1):
            middle = _blank_band([(boxes[i][axis], boxes[i][axis + 2]) for i in region], gap) if len(region) > 1 else None
            if middle is not None:
                regions += [[i for i in region if boxes[i][axis] >= middle], [i for i in region if boxes[i][axis] < middle]]
                break
        else:
            order += sorted(region, key=lambda i: (round(boxes[i][1], 1), boxes[i][0], i))
    return order


def read_pages(boxes: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``place``: the reading order of the boxes of each page, from zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {i: k for k, i in enumerate(reading_order([list(b) for b in pdf["bbox"]]))}
        return pdf.assign(place=[place[i] for i in range(len(pdf))])

    return boxes.groupBy(*keys).applyInPandas(run, T.StructType([*boxes.schema.fields, T.StructField("place", T.IntegerType())]))


def covered_share(box: list[float], others: list[list[float]]) -> float:
    """Share of a box that the union of others covers: by the cells of the grid that all their edges make."""
    x0, y0, x1, y1 = box
    if x1 <= x0 or y1 <= y0:
        return 1.0
    inside = np.array([[max(a, x0), max(b, y0), min(c, x1), min(d, y1)] for a, b, c, d in others], float).reshape(-1, 4)
    xs, ys = (np.unique(np.concatenate([[lo, hi], inside[:, axis], inside[:, axis + 2]]).clip(lo, hi)) for axis, lo, hi in ((0, x0, x1), (1, y0, y1)))
    cells = np.zeros((len(xs) - 1, len(ys) - 1), bool)
    for a, b, c, d in inside:
        cells |= ((xs[:-1] >= a) & (xs[1:] <= c))[:, None] & ((ys[:-1] >= b) & (ys[1:] <= d))[None]
    return float((cells * np.diff(xs)[:, None] * np.diff(ys)[None]).sum() / ((x1 - x0) * (y1 - y0)))


def largest_font(regions: DataFrame, spans: DataFrame, share: float = 0.5) -> DataFrame:
    """``page_id, region_id, font_size``: the largest font of the spans (``page_id, bbox, font_size``) that lie in a region by ``share`` of their area."""
    r = regions.select("page_id", "region_id", F.col("bbox").alias("region"))
    met = r.join(spans, "page_id").where(intersection(F.col("bbox"), F.col("region")) >= share * area(F.col("bbox")))
    return met.groupBy("page_id", "region_id").agg(F.max("font_size").alias("font_size"))


def words_in(regions: DataFrame, words: DataFrame) -> DataFrame:
    """``page_id, region_id, text``: the words (``page_id, block, line, word_no, bbox, text``) whose middle lies in a region, line by line."""
    x, y = ((F.get("bbox", a) + F.get("bbox", a + 2)) / 2 for a in (0, 1))
    r = regions.select("page_id", "region_id", F.col("bbox").alias("region"))
    met = r.join(words, "page_id").where(x.between(F.get("region", 0), F.get("region", 2)) & y.between(F.get("region", 1), F.get("region", 3)))
    lines = met.groupBy("page_id", "region_id", "block", "line").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    lines = lines.select("page_id", "region_id", "block", "line", F.array_join("w.text", " ").alias("text"))
    whole = lines.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("l"))
    return whole.select("page_id", "region_id", F.array_join("l.text", "\n").alias("text"))


# ---------------------------------------------------------------- structure of tables

#: Labels of the boxes of a table's structure.
ROWS = ("table row", "table column header", "table projected row header")
COLUMN, HEADER = "table column", "table column header"


def align_boxes(boxes: list[dict]) -> list[dict]:
    """Rows (and headers) drawn out to the table's left and right, columns to its top and bottom: to the outermost of up to four boxes, of more to
    the mean (rows) or median (columns); no box gets smaller."""
    out = [b | {"bbox": list(b["bbox"])} for b in boxes]
    for chosen, axis, middle in (([b for b in out if "row" in b["label"] or "header" in b["label"]], 0, np.mean), ([b for b in out if b["label"] == COLUMN], 1, np.median)):
        if chosen:
            low, high = ([b["bbox"][axis + o] for b in chosen] for o in (0, 2))
            low, high = (min(low), max(high)) if len(chosen) <= 4 else (float(middle(low)), float(middle(high)))
            for b in chosen:
                b["bbox"][axis], b["bbox"][axis + 2] = min(b["bbox"][axis], low), max(b["bbox"][axis + 2], high)
    return out


def bands(boxes: list[dict], labels: tuple[str, ...], axis: int) -> list[tuple[float, float]]:
    """The boxes' extents along an axis as bands in order. Extents are folded from the lowest edge on: what is common to the last band and the next extent, if it
    makes more than half of either, joins the two."""

    def fold(done: list[tuple[float, float]], extent: tuple[float, float]) -> list[tuple[float, float]]:
        low, high = done[-1] if done else (math.inf, -math.inf)
        common = min(high, extent[1]) - max(low, extent[0])
        if common > 0 and 2 * common > min(high - low, extent[1] - extent[0]):
            return [*done[:-1], (min(low, extent[0]), max(high, extent[1]))]
        return [*done, extent]

    return reduce(fold, sorted((b["bbox"][axis], b["bbox"][axis + 2]) for b in boxes if b["label"] in labels), [])


def apart(columns: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Neighbouring columns that overlap meet in the middle of the overlap."""
    out = [list(c) for c in columns]
    for left, right in zip(out, out[1:], strict=False):
        if left[1] > right[0]:
            left[1] = right[0] = (left[1] + right[0]) / 2
    return [(a, b) for a, b in out]


def header_rows(boxes: list[dict], rows: list[tuple[float, float]]) -> int:
    """How many rows from the top are header: those of which a header box and the row have more than half of the lower one in common."""
    heads = np.array([(b["bbox"][1], b["bbox"][3]) for b in boxes if b["label"] == HEADER], float).reshape(-1, 1, 2)
    bodies = np.array(rows, float).reshape(1, -1, 2)
    common = np.minimum(heads[..., 1], bodies[..., 1]) - np.maximum(heads[..., 0], bodies[..., 0])
    lower = np.minimum(heads[..., 1] - heads[..., 0], bodies[..., 1] - bodies[..., 0])
    inside = ((common > 0) & (2 * common > lower)).any(axis=0)
    return int(np.argmin(np.append(inside, False)))


def grid_markdown(grid: list[list[str]], n_header: int) -> str:
    """A grid as Markdown; several header rows become one, none a blank one."""
    width = max(map(len, grid), default=0)
    if not grid:
        return ""
    clean = [[" ".join(c.split()).replace("|", "\\|") for c in row] + [""] * (width - len(row)) for row in grid]
    n_header = min(max(n_header, 0), len(clean))
    header = [" ".join(c for c in column if c) for column in zip(*clean[:n_header], strict=True)] if n_header else [""] * width
    return "\n".join("| " + " | ".join(row) + " |" for row in (header, ["---"] * width, *clean[n_header:]))


def table_from_structure(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """``table_id, markdown, n_rows, n_columns, n_cells`` of structure boxes (``table_id, label, bbox``) and words (``table_id, word_no, bbox, text``);
    fewer than two rows or columns are no table."""

    def run(key: tuple, b: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        found = align_boxes(b.to_dict("records"))
        rows, columns = bands(found, ROWS, 1), apart(bands(found, (COLUMN,), 0))
        if min(len(rows), len(columns)) < 2:
            return pd.DataFrame([{"table_id": key[0], "markdown": "", "n_rows": len(rows), "n_columns": len(columns), "n_cells": 0}])
        grid = [[[] for _ in columns] for _ in rows]
        for word in w.sort_values("word_no").to_dict("records"):
            x, y = ((word["bbox"][a] + word["bbox"][a + 2]) / 2 for a in (0, 1))
            r, c = (next((k for k, (lo, hi) in enumerate(those) if lo <= at < hi), None) for those, at in ((rows, y), (columns, x)))
            if r is not None and c is not None:
                grid[r][c].append(word["text"])
        texts = [[" ".join(cell) for cell in row] for row in grid]
        return pd.DataFrame([{"table_id": key[0], "markdown": grid_markdown(texts, header_rows(found, rows)), "n_rows": len(rows), "n_columns": len(columns), "n_cells": sum(bool(c) for row in texts for c in row)}])

    kind = boxes.schema["table_id"].dataType.simpleString()
    return boxes.groupBy("table_id").cogroup(words.groupBy("table_id")).applyInPandas(run, f"table_id {kind}, markdown string, n_rows int, n_columns int, n_cells int").where("n_rows + n_columns > 0")
