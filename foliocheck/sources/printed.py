"""Places of printed words in page texts, found for a batch of pages at a time. A text that is null has no words."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from foliocheck.sources import seeds

WORD = "struct<word_idx:int,str:string,xmin:double,ymin:double,xmax:double,ymax:double,text_start:int,text_end:int>"
_FIELDS = ["word_idx", "str", "xmin", "ymin", "xmax", "ymax", "text_start", "text_end"]


def _say(data: np.ndarray, at: np.ndarray, length: np.ndarray, text: bytes, whole: bool) -> np.ndarray:
    """Which lines are `text`, or begin with it."""
    hit = length == len(text) if whole else length >= len(text)
    where = np.flatnonzero(hit)
    hit[where] = (data[at[where][:, None] + np.arange(len(text))] == np.frombuffer(text, np.uint8)).all(axis=1)
    return hit


def _exercise(behind: np.ndarray, unknown: np.ndarray) -> pa.StructArray:
    """The printed letter exercise behind texts of so many characters, one after the other."""
    texts = [t for t, _, _ in seeds.EXERCISE]
    size = np.array([len(t) for t in texts])
    start = (behind[:, None] + 1 + np.concatenate([[0], np.cumsum(size[:-1] + 1)])).ravel()
    x, y, size = (np.tile(v, len(behind)) for v in (np.array([x for _, x, _ in seeds.EXERCISE], float), np.array([y for _, _, y in seeds.EXERCISE], float), size))
    start, stop = (pa.array(v.astype(np.int32), mask=np.repeat(unknown, len(texts))) for v in (start, start + size))
    return pa.StructArray.from_arrays([start, pa.array(texts * len(behind), pa.string()), *map(pa.array, (x, y, x + 8.0 * size, y + 12.0)), start, stop], _FIELDS)


def place_words(text: pa.Array, top: pa.Array, contents: pa.Array, exercise: pa.Array) -> pa.Array:
    """The words of each text with their boxes and offsets in code points, in order.

    `top` is the height of the first row, `contents` says whether lines two and three are rows of a contents page, whose first and last words stand
    at the edges, and `exercise` whether the letter exercise follows. Crowded pages get a smaller line pitch instead of losing rows. Lines and words are found in the bytes of all texts at once, so the
    work is linear in them.
    """
    n = len(text)
    gone, text = np.asarray(text.is_null()), text.cast(pa.string()).fill_null("")
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + n + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    begin, end, size = bounds[:-1], bounds[1:], len(data)

    def before(marks: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(marks)])
    is_line, is_blank = data == 10, data == 32
    chars, line_ends, blanks = before((data & 0xC0) != 0x80), before(is_line), before(is_blank)
    # Words: bytes between blanks, line ends and the bounds of texts.
    inside = ~(is_line | is_blank)
    edge = np.zeros(size + 1, bool)
    edge[bounds] = True
    head = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))
    tail = inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))
    first, last = np.flatnonzero(head[:size]), np.flatnonzero(tail[:size]) + 1
    page = np.searchsorted(end, first, side="right")
    # Lines of all texts: they begin with a text and behind each line end.
    lines = np.unique(np.concatenate([begin, np.flatnonzero(is_line) + 1]))
    lines_end = np.concatenate([lines[1:], [size]])
    ended = np.zeros(len(lines), bool)
    some = lines_end > lines
    ended[some] = is_line[lines_end[some] - 1]
    length = lines_end - lines - ended
    large = _say(data, lines, length, b"Chapter ", False)
    for line in seeds.LARGE_LINES:
        large |= _say(data, lines, length, line.encode(), True)
    line = np.searchsorted(lines, first, side="right") - 1
    at = lines[line]

    n_chars, n_lines = chars[end] - chars[begin], line_ends[end] - line_ends[begin] + 1
    y0 = np.asarray(top.cast(pa.float64()), np.float64)
    pitch = np.minimum(seeds.LINE_PITCH, (940.0 - y0) / (n_lines + n_chars // seeds.ROW_CHARS + 1))[page]
    line_no = line_ends[at] - line_ends[begin[page]]
    start, off = chars[first] - chars[begin[page]], chars[first] - chars[at]
    line_start, width = start - off, chars[last] - chars[first]
    row = line_no + line_start // seeds.ROW_CHARS + off // seeds.ROW_CHARS
    height = np.minimum(12.0, pitch * 2 / 3) * np.where(large[line], 2, 1)
    turn, turns = blanks[first] - blanks[at], blanks[lines_end[line]] - blanks[at] + 1
    listed = np.asarray(contents, bool)[page] & ((line_no == 1) | (line_no == 2))
    x = np.where(~listed, 60.0 + 7.5 * (off % seeds.ROW_CHARS), np.where(turn == 0, 60.0, np.where(turn == turns - 1, 760.0, 120.0 + 7.5 * off)))
    y = y0[page] + pitch * row
    letters = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(letters), pa.py_buffer(np.ascontiguousarray(data[inside])))
    ints = start.astype(np.int32)
    struct = pa.StructArray.from_arrays(
        [pa.array(ints), words, *map(pa.array, (x, y, np.minimum(1000.0, x + 7.5 * width), y + height)), pa.array(ints), pa.array((start + width).astype(np.int32))], _FIELDS)
    also = np.flatnonzero(np.asarray(exercise, bool))
    if len(also):
        page = np.concatenate([page, np.repeat(also, len(seeds.EXERCISE))])
        struct = pa.concat_arrays([struct, _exercise(n_chars[also], gone[also])]).take(pa.array(np.argsort(page, kind="stable")))
    counts = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(counts), struct)
