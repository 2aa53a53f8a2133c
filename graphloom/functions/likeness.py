"""Token-sort similarity of many names at once, on arrays: exact, in the memory of one chunk of names against another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.functions.records import token_sort_similarity

#: Names of each side that are compared at a time, pairs that are aligned at a time, and bins for letters.
LEFT, RIGHT, PAIRS, BINS = 512, 1_024, 32_768, 128


def _spell(names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names with their words in order: (texts, all code points, the text of each, lengths)."""
    texts = [" ".join(sorted(t.split())) for t in names]
    n = np.array([len(t) for t in texts], np.int64)
    return texts, np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(n)), n), n


def _rows(letters: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
    """Letters of texts one behind the other as a matrix of a row for each place, short texts filled up."""
    out = np.full((len(n), int(n.max(initial=0))), pad, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = letters
    return np.ascontiguousarray(out.T)


def _aligned(i: np.ndarray, j: np.ndarray, masks: np.ndarray, full: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What the texts i lack of their longest common subsequences with the texts j: a bit for each letter, a step for each of j's."""
    flat, base, all_ = masks.ravel(), i * masks.shape[1], full[i]
    row = all_.copy()
    for place in places:
        hit = row & flat.take(base + place.take(j))
        row = ((row + hit) | (row - hit)) & all_
    return np.bitwise_count(row).astype(np.int64)


def alike(xs: list[str], ys: list[str], bar: np.ndarray, more: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of all pairs whose similarity, and more(i, j) if given, may reach bar[i]; a caller may raise it meanwhile.

    Two names have at most as many letters in order in common as they have in any order. That number is the
    product of two matrices with a column for each letter's first, second, ... copy; only pairs for which it is
    enough are aligned. Names go by length, so a long one costs only those that it could be like.
    """
    (xt, xc, xo, n), (yt, yc, yo, m) = _spell(xs), _spell(ys)
    letters, codes = np.unique(np.concatenate([xc, yc]), return_inverse=True)
    xc, yc = codes[: len(xc)], codes[len(xc) :]
    bins = max(1, min(BINS, len(letters)))
    count = lambda of, c, rows: np.bincount(of * bins + c % bins, minlength=rows * bins).reshape(rows, bins)
    cx, cy = count(xo, xc, len(n)), count(yo, yc, len(m))
    xstart, ystart = np.cumsum(n) - n, np.cumsum(m) - m
    spelt = lambda c, start, size, at: c[np.concatenate([np.arange(a, a + k) for a, k in zip(start[at], size[at], strict=True)])]
    by_x, by_y = np.argsort(n, kind="stable"), np.argsort(m, kind="stable")
    for a in range(0, len(n), LEFT):
        i = by_x[a : a + LEFT]
        short = n[i] <= 64
        masks = np.zeros((len(i), len(letters) + 1), np.uint64)
        for p, place in enumerate(_rows(spelt(xc, xstart, n, i), n[i], len(letters))[:64]):
            masks[np.arange(len(i)), place] |= np.uint64(1 << p)
        masks[:, -1] = 0
        full = np.array([(1 << min(int(k), 64)) - 1 for k in n[i]], np.uint64)
        for b in range(0, len(m), RIGHT):
            j = by_y[b : b + RIGHT]
            need = bar[i][:, None] if more is None else bar[i][:, None] - more(i, j)
            if 2 * min(n[i[-1]], m[j[-1]]) < need.min() * (n[i[0]] + m[j[0]]) - 1e-6:
                continue
            limit = need.astype(np.float32) * ((n[i][:, None] + m[j]).astype(np.float32) / 2) - np.float32(1e-3)
            most = np.minimum(cx[i].max(axis=0), cy[j].max(axis=0))
            letter = np.repeat(np.arange(bins), most)
            copy = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most)
            shared = (cx[i][:, letter] > copy).astype(np.float32) @ (cy[j][:, letter] > copy).astype(np.float32).T
            u, v = np.nonzero(shared >= limit)
            if not len(u):
                continue
            common = np.zeros(len(u), np.int64)
            places = _rows(spelt(yc, ystart, m, j), m[j], len(letters))
            at = np.flatnonzero(short[u])
            for s in range(0, len(at), PAIRS):
                k = at[s : s + PAIRS]
                common[k] = n[i][u[k]] - _aligned(u[k], v[k], masks, full, places)
            total = n[i][u] + m[j][v]
            score = np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
            for k in np.flatnonzero(~short[u]):
                score[k] = token_sort_similarity(xt[i[u[k]]], yt[j[v[k]]])
            yield i[u], j[v], score


def ten_thousandths(score: np.ndarray) -> np.ndarray:
    """Scores in units of 0.0001, halves up by their decimal digits, as Spark rounds."""
    k = score * 1e4 + 0.5
    out = np.floor(k).astype(np.int64)
    for at in np.flatnonzero(np.abs(k - np.rint(k)) < 1e-6):
        out[at] = int(Decimal(repr(float(score[at]))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def all_alike(least: float) -> Callable:
    """For a part of a block's names on each side: block, x, y, score of all pairs that score `least` or more."""

    def part(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, found = left["x"].to_pylist(), right["y"].to_pylist(), [(np.array([], np.int64),) * 2 + (np.array([], float),)]
        for i, j, score in alike(x, y, np.full(len(x), least)):
            at = score >= least
            found.append((i[at], j[at], score[at]))
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"block": left["block"].take(pa.array(i)), "x": left["x"].take(pa.array(i)), "y": right["y"].take(pa.array(j)), "score": score})

    return part


def best_alike(least: float, top: int, birth: float, nationality: float) -> Callable:
    """For a part of a block's names on each side, left(block, x, _b, _c) and right(block, y, _b, _c, id): the `top` ids and their scores of each row.

    The score is the similarity and what an equal, known _b and _c add, at most 1, rounded to four digits; equal scores go by id.
    An id may come with several names: then a row keeps as many more.
    """

    def part(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("id", "ascending")], null_placement="at_start"))
        x, y = left["x"].to_pylist(), right["y"].to_pylist()
        keep = top * max(c["counts"] for c in pc.value_counts(right["id"]).to_pylist())
        marks = []
        for c, premium in (("_b", birth), ("_c", nationality)):
            codes = {v: k for k, v in enumerate(dict.fromkeys(right[c].to_pylist())) if v != ""}
            marks.append((np.array([codes.get(v, -1) for v in left[c].to_pylist()]), np.array([codes.get(v, -2) for v in right[c].to_pylist()]), premium))
        marks = [(p, q, premium) for p, q, premium in marks if premium and np.isin(p, q).any()]

        def more(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return sum(premium * (p[i][:, None] == q[j]) for p, q, premium in marks)

        def best(i: np.ndarray, j: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.argsort((i * 10_001 + 10_000 - units) * len(y) + j)
            i, j, units = i[at], j[at], units[at]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            low = nth == keep - 1
            bar[i[low]] = np.maximum(bar[i[low]], units[low] / 1e4 - 6e-5)  # what may still be among the best
            return i[nth < keep], j[nth < keep], units[nth < keep]

        bar = np.full(len(x), least - 6e-5)
        none = np.array([], np.int64)
        found = [(none, none, none)]
        for i, j, score in alike(x, y, bar, more if marks else None):
            for p, q, premium in marks:
                score = score + np.where(p[i] == q[j], premium, 0.0)
            units = ten_thousandths(np.minimum(score, 1.0))
            at = (units / 1e4 >= least) & (units / 1e4 >= bar[i])
            found.append(best(i[at], j[at], units[at]))
        i, j, units = best(*(np.concatenate(c) for c in zip(*found, strict=True)))
        i, j = pa.array(i), pa.array(j)
        return pa.table({**{c: left[c].take(i) for c in ("block", "x", "_b", "_c")}, "id": right["id"].take(j), "score": units / 1e4})

    return part
