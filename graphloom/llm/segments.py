"""Cutting texts before white-space runs, where vocabularies can't merge across.

A tokenizer that never joins a character that isn't white space with white space behind it
gives a text the tokens of its segments, one after another. Whether a vocabulary is such is
looked up in its entries, not assumed: `cut_bytes` keeps the white space that qualifies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before which a text may be cut.
CUTS = " \n\t"
#: Bytes of text that are cut at once (a single text may have more).
SLICE = 4 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def cut_bytes(entries: Iterable[str]) -> bytes:
    """The white space c such that no entry has c behind another character, white space of c's own run aside."""
    left = set(CUTS)
    for entry in entries:
        for a, b in zip(entry, entry[1:], strict=False):
            if b in left and not (a == b or (b == " " and a.isspace())):
                left.discard(b)
    return "".join(c for c in CUTS if c in left).encode()


def segments(texts: pa.Array, cuts: bytes) -> tuple[pa.Array, np.ndarray]:
    """Segments of ' ' + text for each text, one after another, and how many each has; null and empty texts have none."""
    texts = pc.fill_null(texts, "")
    some = pc.greater(pc.binary_length(texts), 0)
    raw = pc.binary_join_element_wise(" ", texts.filter(some).cast(pa.string()), "")
    n = np.zeros(len(texts), np.int64)
    if not len(raw):
        return pa.array([], pa.string()), n
    if raw.offset:
        raw = pa.concat_arrays([raw])
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    b = np.frombuffer(raw.buffers()[2], np.uint8)[: ends[-1]]
    may = np.zeros(256, bool)
    may[list(cuts)] = True
    at = np.flatnonzero(may[b[1:]] & ~_BLANK[b[:-1]]) + 1
    at = at[~_wide_blank(b, at - 1)]
    here = np.zeros(len(b) + 1, bool)
    here[at] = True
    here[ends] = True
    bounds = np.flatnonzero(here).astype(np.int32)
    n[some.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(bounds, ends))
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), raw.buffers()[2]]), n


def _wide_blank(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each place is white space of several bytes (U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000), or U+2581, which stands for a space."""
    out = np.zeros(len(at), bool)
    wide = np.flatnonzero(b[at] >= 0x80)
    z = b[at[wide]].astype(np.int64)
    y = b[np.maximum(at[wide] - 1, 0)].astype(np.int64)
    x = b[np.maximum(at[wide] - 2, 0)].astype(np.int64)
    two, three = y << 8 | z, x << 16 | y << 8 | z
    out[wide] = np.isin(two, [0xC285, 0xC2A0]) | np.isin(three, [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE29681, 0xE38080])
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have so many bytes at most, or one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def joined(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `at` of flat, whose runs have these sizes, one after another; and where each begins and the last ends."""
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])], ends
