"""Encoded route text to line columns.

Decoding runs over whole Arrow batches with NumPy: no loop over rows or characters. Higher-order SQL
functions can express the same, at about twenty times the cost per route.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from linkspark.functions.lines import LINE_TYPE, from_numpy

# --- fixed values: text alphabet starts at '?', five bits per character, bit six says that more follow ---
FIRST, LAST, CONTINUES, BITS = 63, 126, 32, 5
# 12 groups of five bits are 60 bits; a coordinate of 180 degrees takes 6 groups at five decimals
LONGEST_NUMBER = 12


def decode_batch(texts: pa.Array, precision: int) -> pa.Array:
    """Lines of encoded texts; NULL when undecodable or shorter than two points."""
    present = texts.is_valid().to_numpy(zero_copy_only=False)
    filled = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int32)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n_rows = len(sizes)
    if not len(raw):
        return from_numpy(np.zeros(0), np.zeros(0), np.zeros(n_rows, np.int64), np.zeros(n_rows, bool))

    code = raw.astype(np.int64) - FIRST
    final = code < CONTINUES
    # a number starts at a row's first character and after every final character
    starts = np.empty(len(raw), bool)
    starts[0] = True
    starts[1:] = final[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(starts)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    digits = (code & (CONTINUES - 1)) << (BITS * np.minimum(place, LONGEST_NUMBER - 1))
    value = np.add.reduceat(digits, first)
    delta = (value >> 1) ^ -(value & 1)

    number_row = row[first]
    numbers = np.bincount(number_row, minlength=n_rows)
    foreign = np.bincount(row, (raw < FIRST) | (raw > LAST) | (place >= LONGEST_NUMBER), n_rows) > 0
    ends_open = np.zeros(n_rows, bool)
    filled_rows = sizes > 0
    ends_open[filled_rows] = ~final[(offsets[1:] - offsets[0] - 1)[filled_rows]]
    valid = present & filled_rows & ~foreign & ~ends_open & (numbers >= 4) & (numbers % 2 == 0)

    pairs = delta[valid[number_row]].reshape(-1, 2)
    counts = np.where(valid, numbers // 2, 0)
    running = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(pairs, axis=0)])
    before = np.repeat(running[np.cumsum(counts) - counts], counts, axis=0)
    absolute = (running[1:] - before) / 10.0**precision
    return from_numpy(absolute[:, 1], absolute[:, 0], counts, valid)


def decode(encoded: Column, precision: int = 5, pinned: bool = False) -> Column:
    """Line column of an encoded text column, x = longitude.

    ``pinned`` keeps filters on the line above the decoding; pushed below it they would decode twice.
    """

    @arrow_udf(LINE_TYPE)
    def decode_polyline(texts: pa.Array) -> pa.Array:
        return decode_batch(texts, precision)

    return (decode_polyline.asNondeterministic() if pinned else decode_polyline)(encoded)
