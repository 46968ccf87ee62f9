"""Words of a page whose boxes cover each other, through a grid instead of all pairs, for a batch of pages at a time."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Width of a cell and of the page; a cell is as high as the page's words on average, so on crowded pages, too, a word meets its neighbours only.
CELL, SIDE = 50.0, 1000.0
#: Pairs that are compared at a time.
PAIRS = 1_000_000


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _page_of(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as `n` says, and a count from 0 within it."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _cells(page: np.ndarray, box: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First and last column and row of the cells of each box; what lies beyond the page counts to its border."""
    low, tall = np.array([0.0, SIDE]), high[page]
    x0, x1 = (np.floor(np.clip(v, *low) / CELL) for v in (box[0], box[2]))
    y0, y1 = (np.floor(np.clip(v, *low) / tall) for v in (box[1], box[3]))
    return np.array([x0, y0, x1, y1]).astype(np.int64)


def covered_words(base: list[pa.Array], extra: list[pa.Array], idx: pa.Array, limit: float) -> np.ndarray:
    """Which words of a further pass are covered by a base word, or by an earlier word of their own pass that is not covered itself.

    `base` and `extra` are xmin, ymin, xmax, ymax of the words of each page, `idx` gives the order of the extra words. Covered is what shares more than
    `limit` of the smaller box. Boxes without area cover nothing.
    """
    n_base = len(pages := _page_of(base[0]))
    page = np.concatenate([pages, _page_of(extra[0])])
    box = np.array([np.concatenate([_flat(b), _flat(e)]) for b, e in zip(base, extra)], float)
    # Words of one page and number are one: extra words are numbered in their order from 0, base words stay below.
    names, named = np.unique(page[n_base:] * 2**33 + _flat(idx).astype(np.int64), return_inverse=True)
    word = np.concatenate([np.full(n_base, -1), named])
    covered = np.zeros(len(names), bool)
    some = np.flatnonzero(np.isfinite(box).all(axis=0) & (box[2] > box[0]) & (box[3] > box[1]))
    if not len(some):
        return covered[named]
    some = some[np.argsort(word[some], kind="stable")]
    page, box, word = page[some], box[:, some], word[some]
    height = np.clip(box[3], 0, SIDE) - np.clip(box[1], 0, SIDE)
    count = np.bincount(page)
    high = np.maximum(np.bincount(page, height) / np.maximum(count, 1), SIDE / np.maximum(count, 1))
    cells = _cells(page, box, high)
    wide = cells[2] - cells[0] + 1
    of, k = _spread(wide * (cells[3] - cells[1] + 1))
    columns, rows = int(SIDE / CELL) + 1, int(cells[3].max()) + 1
    col, row = cells[0][of] + k % wide[of], cells[1][of] + k // wide[of]
    key = (page[of] * rows + row) * columns + col
    by_key = np.argsort(key, kind="stable")
    ordered = key[by_key]
    # Extra words in their order, each with all its cells.
    later = np.flatnonzero(word[of] >= 0)
    low, n = np.searchsorted(ordered, key[later]), np.searchsorted(ordered, key[later], side="right")
    n -= low
    area = (box[2] - box[0]) * (box[3] - box[1])
    ends = np.cumsum(n)
    starts = np.flatnonzero(np.diff(word[of[later]], prepend=-2))
    begin = 0
    while begin < len(later):
        # Whole words, of about so many pairs.
        stop = np.searchsorted(ends, ends[begin] - n[begin] + PAIRS, side="right")
        at = np.searchsorted(starts, max(stop, begin + 1))
        stop = starts[at] if at < len(starts) else len(later)
        i, k = _spread(n[begin:stop])
        cell = later[begin + i]
        a, b = of[cell], of[by_key[low[begin + i] + k]]
        # A pair counts once, in the first cell that both have.
        once = (word[b] < word[a]) & (col[cell] == np.maximum(cells[0][a], cells[0][b])) & (row[cell] == np.maximum(cells[1][a], cells[1][b]))
        a, b = a[once], b[once]
        shared = (np.maximum(0, np.minimum(box[2][a], box[2][b]) - np.maximum(box[0][a], box[0][b]))
                  * np.maximum(0, np.minimum(box[3][a], box[3][b]) - np.maximum(box[1][a], box[1][b])))
        hit = shared / np.maximum(1.0, np.minimum(area[a], area[b])) > limit
        a, b = word[a[hit]], word[b[hit]]
        covered[a[b < 0]] = True
        open_ = (b >= 0) & ~covered[a]
        open_[open_] = ~covered[b[open_]]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            if not covered[y]:
                covered[x] = True
        begin = stop
    return covered[named]
