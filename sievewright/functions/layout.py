"""Reading order of the lines of a page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How wide a gutter between columns and between blocks must be more than, in pixels.
COLUMN_GUTTER, BLOCK_GUTTER = 20, 12


def _cuts(part: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of boxes by part, for every part at once: the order along an axis within the parts, and for each place of it
    whether it lies behind its part's widest gutter, the last of equals; parts without a gutter have nothing behind."""
    order = np.lexsort((low, part))
    of, low, high = part[order], low[order], high[order]
    # the furthest edge so far within a part: whole numbers, so that parts do not blur into each other
    edges, rank = np.unique(high, return_inverse=True)
    furthest = edges[np.maximum.accumulate(rank + of * len(edges)) - of * len(edges)]
    gap = np.full(len(of), -np.inf)
    gap[1:] = np.where(of[1:] == of[:-1], low[1:] - furthest[:-1], -np.inf)
    gap[~(gap > least)] = -np.inf
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[first, len(of)])
    widest = np.repeat(np.maximum.reduceat(gap, first), size)
    place = np.arange(len(of))
    at = np.maximum.reduceat(np.where((gap == widest) & (gap > -np.inf), place, -1), first)
    return order, (place >= np.repeat(at, size)) & np.repeat(at >= 0, size)


def _order(page: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The places of boxes (x0, y0, x1, y1), sorted by page, in reading order within their pages. All pages are cut at once:
    a part is a number that grows in reading order, and a cut gives what lies behind it the next one."""
    x0, y0, x1, y1 = boxes.T
    part = np.unique(page, return_inverse=True)[1]
    waiting = np.arange(len(page))
    while len(waiting):
        now = part[waiting]
        behind = np.zeros(len(now), bool)
        for low, high, least in ((x0, x1, COLUMN_GUTTER), (y0, y1, BLOCK_GUTTER)):
            order, later = _cuts(now, low[waiting], high[waiting], least)
            uncut = ~np.isin(now[order], now[behind])
            behind[order] |= later & uncut
        cut = np.isin(now, now[behind])
        doubled = part * 2
        doubled[waiting] += behind
        part = np.unique(doubled, return_inverse=True)[1]
        waiting = waiting[cut]
    return np.lexsort((x0, y0, part))


def reading_order(boxes: Column) -> Column:
    """Indices of the boxes of a page, an array of [x0, y0, x1, y1], in reading order: columns parted by
    gutters from left to right, blocks from top to bottom, lines by their top and left edges. A page
    without boxes has none; a page without a list has null."""

    def ordered(pages: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False)
        page, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        flat = pc.list_flatten(pc.list_flatten(pages)).to_numpy(zero_copy_only=False)
        found = _order(page, flat.reshape(-1, 4).astype(float)) if len(page) else page
        places = pa.array((found - first[page]).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), places, mask=pages.is_null())

    return F.arrow_udf(ordered, "array<int>")(boxes)
