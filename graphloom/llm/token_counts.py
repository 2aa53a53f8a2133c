"""Edit-aware token counts.

A document keeps its pre-tokens in the leaves of a segment tree whose nodes hold the
sums of characters and tokens below. An edit finds its leaf by the character sums,
takes the touched pre-tokens and the context on which their boundaries depend, cuts
this region anew until a boundary meets an old one, and updates the sums on the path.
Trees are kept as the lengths and counts of their pre-tokens, from which they are made
again without cutting or encoding a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import kept_columns, materialize, unpacked

#: Pre-tokens in a leaf when a tree is built; read behind an edit at first; whose counts a worker keeps.
LEAF, AHEAD, CACHED = 64, 8, 300_000

#: Personal data and their placeholders (fixed values): the edits of `redactions`.
REDACTED = (
    ("<EMAIL>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("<PHONE>", r"\+?\d[\d ().-]{7,17}\d"),
)
_REDACTED = regex.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(REDACTED)))


class Counter:
    """Pre-tokens and token counts of a byte-level BPE."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.seen.get(token)
        if n is None:
            if len(self.seen) > CACHED:
                self.seen.clear()
            n = self.seen[token] = len(self.encoding.encode_ordinary(token))
        return n


class DocumentCount:
    """A document's pre-token segment tree, and with it the text and the token count.

    kept is a tree of the text that pack gave: with it nothing is cut or encoded again.
    """

    def __init__(self, text: str, counter: Counter, kept: bytes | None = None):
        self.counter, self.recounted = counter, 0
        if kept is None:
            tokens = counter.pattern.findall(text)
            self._build(tokens, self._counted(tokens))
            return
        kind = "<u4" if kept[:1] == b"4" else "<u2"
        lengths, costs = np.frombuffer(kept, kind, offset=1).reshape(2, -1)
        ends = np.cumsum(lengths, dtype=np.int64).tolist()
        if (ends[-1] if ends else 0) != len(text):
            raise ValueError(f"a tree of {ends[-1] if ends else 0} characters for a text of {len(text)}")
        self._build([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], costs.tolist())

    def pack(self) -> bytes:
        """Lengths and counts of the pre-tokens, for the next time."""
        rows = [[len(t) for leaf in self.leaves for t in leaf], [c for leaf in self.costs for c in leaf]]
        wide = max(map(max, rows), default=0) > 65_535 if rows[0] else False
        return (b"4" if wide else b"2") + np.array(rows, "<u4" if wide else "<u2").tobytes()

    @property
    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)

    @property
    def n_tokens(self) -> int:
        return self.counts[1]

    def _counted(self, tokens: list[str]) -> list[int]:
        seen, count = self.counter.seen, self.counter.count
        return [seen[t] if t in seen else count(t) for t in tokens]

    def _build(self, tokens: list[str], costs: list[int]) -> None:
        self.leaves = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.costs = [costs[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.counts = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.leaves)):
            self._sum(k)
        for node in range(self.size - 1, 0, -1):
            self._join(node)

    def _sum(self, k: int) -> None:
        self.chars[self.size + k] = sum(map(len, self.leaves[k]))
        self.counts[self.size + k] = sum(self.costs[k])

    def _join(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.counts[node] = self.counts[2 * node] + self.counts[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf and place of the pre-token that holds character `at`, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        k = min(node - self.size, len(self.leaves) - 1)
        start = start if k == node - self.size else start - self.chars[self.size + k]
        for i, token in enumerate(self.leaves[k]):
            if at < start + len(token):
                return k, i, start
            start += len(token)
        return k, len(self.leaves[k]), start

    def _before(self, k: int, i: int) -> tuple[int, int] | None:
        """The place of the pre-token before place i of leaf k."""
        while not i:
            if not k:
                return None
            k -= 1
            i = len(self.leaves[k])
        return k, i - 1

    def _from(self, k: int, i: int) -> Iterator[tuple[str, int, int]]:
        """The pre-tokens from a place on, each with the place behind it."""
        while k < len(self.leaves):
            for j in range(i, len(self.leaves[k])):
                yield self.leaves[k][j], k, j + 1
            k, i = k + 1, 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of characters start to end of the present text. Reads the region and its context alone."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"edit {start}:{end} is outside a text of {self.chars[1]}")
        k, i, at = self._find(start)
        # Context before: a pre-token's end can hang on two characters behind it ('re), and
        # the split of white space on what follows the whole run.
        back = 2
        while (place := self._before(k, i)) and (back or self.leaves[place[0]][place[1]][-1].isspace()):
            k, i = place
            at -= len(self.leaves[k][i])
            back = max(0, back - 1)
        place = self._before(k, i)
        behind = self.leaves[place[0]][place[1]] if place else ""
        # Cut from there until a boundary behind the edit is an old one too.
        following = self._from(k, i)
        old, ends, far = [], {}, at  # ends: where old pre-tokens behind the edit end, and the places behind them
        if at >= end:
            ends[at] = (k, i)
        want, more = AHEAD, True
        while True:
            while more and (far < end or want):
                token, in_leaf, behind_it = next(following, ("", -1, 0))
                if in_leaf < 0:
                    more = False
                    break
                old.append(token)
                far += len(token)
                if far >= end:
                    ends[far] = (in_leaf, behind_it)
                    want -= 1
            piece = "".join(old)
            piece = behind + piece[: start - at] + new + piece[end - at :]
            shift, done = at - len(behind) - (len(new) - (end - start)), len(behind) + start - at + len(new)
            fresh: list[str] = []
            stop = None
            for m in self.counter.pattern.finditer(piece, len(behind)):
                if more and m.end() == len(piece):
                    break  # what follows may belong to it
                fresh.append(m.group())
                if m.end() >= done and m.end() + shift in ends:
                    stop = ends[m.end() + shift]
                    break
            if stop is None and more:
                want = len(old)  # read on, twice as far
                continue
            break
        if stop is None:
            stop = len(self.leaves) - 1, len(self.leaves[-1])
        self.recounted += len(fresh)
        last, behind_it = stop
        tail, tail_costs = self.leaves[last][behind_it:], self.costs[last][behind_it:]
        self.leaves[k] = self.leaves[k][:i] + fresh + (tail if last == k else [])
        self.costs[k] = self.costs[k][:i] + self._counted(fresh) + (tail_costs if last == k else [])
        for j in range(k + 1, last + 1):
            self.leaves[j], self.costs[j] = (tail, tail_costs) if j == last else ([], [])
        if len(self.leaves[k]) > 4 * LEAF:
            self._build([t for leaf in self.leaves for t in leaf], [c for leaf in self.costs for c in leaf])
            return
        nodes = set()
        for j in range(k, last + 1):
            self._sum(j)
            nodes.add((self.size + j) // 2)
        while nodes and 0 not in nodes:
            for node in nodes:
                self._join(node)
            nodes = {node // 2 for node in nodes}


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put placeholders for personal data, last first."""
    found = [(m.start(), m.end(), REDACTED[int(m.lastgroup[1:])][0]) for m in _REDACTED.finditer(text)]
    return found[::-1]


Edit = tuple[int | None, int | None, str | None]


def edited_counts(rows: Iterable[tuple[str | None, list[Edit] | None, bytes | None]], counter: Counter, state: bool = False) -> Iterator[tuple]:
    """(tokens before, edits made, tokens after, pre-tokens counted again, error, and text and tree if `state`); edits None: the redactions."""
    for text, edits, kept in rows:
        error = None
        try:
            doc = DocumentCount(text or "", counter, kept)
        except ValueError as wrong:
            doc, error = DocumentCount(text or "", counter), str(wrong)
        before, made = doc.n_tokens, 0
        for n, (start, end, new) in enumerate(redactions(text or "") if edits is None else edits):
            try:
                if start is None or end is None or new is None:
                    raise ValueError("edit without start, end or text")
                doc.edit(start, end, new)
                made += 1
            except ValueError as wrong:
                error = error or f"{n}: {wrong}"
        yield (before, made, doc.n_tokens, doc.recounted, error, *((doc.text, doc.pack()) if state else ()))


_OUTPUTS = ("n_tokens", "n_edits", "n_tokens_edited", "n_recounted", "error")
_STATE = ("text_edited", "tree")


def token_counts(docs: DataFrame, ranks: str, pattern: str, edits: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",), tree: str | None = None, state: bool = False) -> DataFrame:
    """keep columns, n_tokens, n_edits, n_tokens_edited, n_recounted and error for each row of docs.

    ranks: a tiktoken file; pattern: its pre-token pattern. edits(doc_id, seq, start,
    end, new) are applied in order of seq, each to the text that the ones before left;
    without them, personal data are replaced by placeholders. With state, text_edited and
    the document's tree are returned too; given to a later call as the column `tree` beside
    that text, they spare it all but the regions that its edits touch.

    The documents stay where they are unless edits are given, which then join by doc_id.
    Null and empty texts have no tokens. An edit outside its text, or without a start, end
    or new text, is left out, and so is a tree that doesn't fit; error tells the first such
    fault, with the edit's place. Repeated rows of docs are counted each, and each gets the
    edits of its doc_id; edits of one seq go by start, end and text; rows without doc_id have
    none. An empty table gives no rows. A kept column named like an output gives way to it.
    """
    outputs = _OUTPUTS + (_STATE if state else ())
    kept_tree = F.col(f"`{tree}`") if tree else F.lit(None).cast("binary")
    df = docs.select(kept_columns(keep, outputs), F.col("doc_id") if edits is not None else F.lit(None).alias("doc_id"), F.col("text"), kept_tree.alias("tree"))
    if edits is not None:
        lists = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("edits"))
        lists = materialize(lists, "edits")  # both sides of the join are exchanged as they are, so many rows of a doc_id can be split
        df = df.join(lists, F.col("doc_id") == F.col("of"), "left").select("kept", "text", "tree", F.expr("coalesce(edits, array())").alias("edits"))
    else:
        df = df.select("kept", "text", "tree")
    given = edits is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.string(), pa.binary()] if state else [])
        for batch in batches:
            texts, trees = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lists = [[(e["start"], e["end"], e["new"]) for e in row] for row in batch.column(3).to_pylist()] if given else [None] * len(texts)
            out = list(zip(*edited_counts(zip(texts, lists, trees, strict=True), counter, state), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["kept", *outputs])

    kind = df.schema["kept"].dataType.simpleString()
    more = ", text_edited string, tree binary" if state else ""
    return df.mapInArrow(run, f"kept {kind}, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_recounted bigint, error string{more}").select(*unpacked(keep, outputs), *outputs)
