"""Aligning the tokens of two vocabularies, each distinct segment once.

Texts are cut before white-space runs where neither vocabulary merges across, so both have a
token end there. Documents are coded in blocks: a block's distinct segments, and the places of
its documents' segments among them. Segments are dealt by a hash and meet their equals of all
other blocks, are tokenised and aligned once, and go back to the blocks that named them, which
compose their documents. How many documents link two ids is summed over blocks and joined back.

An aligned segment is a run of 32-bit words, a token each, in the order of the groups: an id and,
in the upper bits, what follows it (0: the next token of the same side, 1: the other side, 2: the
next group).
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_batches, discard, kept_columns, kept_in_worker, materialize, release_kept, unpacked
from graphloom.llm.pieces import PieceEncoder
from graphloom.llm.segments import cut_bytes, joined, segments, slices

#: Bytes of text in a block (a single text may have more), and rows that Python is handed at once for one.
BLOCK, BLOCK_ROWS = 8 << 20, 50_000
#: Rows of blocks that Python is handed at once to compose documents.
COMPOSED_ROWS = 64
#: Documents composed at once by their segments, and segments that a worker keeps aligned in each of two generations.
SOME, KEPT = 400_000, 100_000
ID = (1 << 30) - 1


class ByteTokens:
    """A byte-level vocabulary of the tokenizers library, on segments."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or made.get("normalizer"):
            raise ValueError(f"{path}: only byte-level vocabularies with their own pattern, without a normaliser or prefix")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        table = [b""] * size
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            table[i] = bytes(_BYTE.get(c, 0) for c in entry)
        self.byte_sizes = np.array([len(x) for x in table], np.int64)
        self.flat_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.cuts = cut_bytes(x.decode("utf-8", "replace") for x in table)

    def ids(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte: itself if it shows, else those from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_BYTE = _byte_signs()


class Aligner:
    """Segments to words of tokens."""

    def __init__(self, a: str, b: str, kept: int = KEPT):
        self.a, self.code = ByteTokens(a), PieceEncoder(b)
        self.cuts = bytes(c for c in self.a.cuts if c in self.code.pieces.cuts)
        self.kept, self.known, self.older = kept, {}, {}

    def words(self, some: list[str]) -> list[bytes]:
        """Words of each segment; empty for one whose tokens don't give back its bytes."""
        if len(self.known) > self.kept:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        if older:
            known.update([(s, older[s]) for s in some if s in older and s not in known])
        fresh = [s for s in some if s not in known]
        passing: dict[str, bytes] = {}
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            words, sizes = self._aligned(part)
            raw, ends = words.tobytes(), np.concatenate([[0], 4 * np.cumsum(sizes)]).tolist()
            for s, x, y in zip(part, ends, ends[1:], strict=False):
                (known if len(s) <= 64 else passing)[s] = raw[x:y]
        return [known[s] if s in known else passing[s] for s in some]

    def _aligned(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [s.encode() for s in some]
        text, length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        a, n_a = self.a.ids(some)
        b, n_b = self.code.merged(some)
        b = b.astype(np.int64)
        good = np.ones(len(some), bool)
        for side, ids, n in ((self.a, a, n_a), (self.code.pieces, b, n_b)):
            good &= _spelled(side.flat_bytes, side.byte_sizes, ids, n, text, length)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, length = n_a * good, n_b * good, length * good
        # Where tokens end, over all segments; a segment's end is one of both sides.
        end_a, end_b = np.cumsum(self.a.byte_sizes[a]), np.cumsum(self.code.pieces.byte_sizes[b])
        both = np.intersect1d(end_a, end_b, assume_unique=False)
        ids = np.concatenate([a, b])
        group = np.concatenate([np.searchsorted(both, end_a), np.searchsorted(both, end_b)])
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(2 * group + side, kind="stable")
        ids, group, side = ids[order], group[order], side[order]
        follows = np.where(np.diff(group, append=-1) != 0, 2, np.where(np.diff(side, append=0) != 0, 1, 0))
        return (ids | follows << 30).astype(np.uint32), n_a + n_b


def _spelled(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, n: np.ndarray, text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of each segment's ids are those of its text."""
    told, ends = joined(flat, sizes, ids)
    ends = ends[np.concatenate([[0], np.cumsum(n)])]
    good = np.diff(ends) == length
    starts = ends[:-1]
    at = np.flatnonzero(good)
    x, _ = joined(text, length, at)
    y = told[np.repeat(starts[at] - (np.cumsum(length[at]) - length[at]), length[at]) + np.arange(len(x))]
    wrong = np.repeat(at, length[at])[x != y]
    good[wrong] = False
    return good


@kept_in_worker
def aligner(a: str, b: str) -> Aligner:
    """A worker's aligner: its segments outlive a task."""
    return Aligner(a, b)


def _pack(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x, "<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), "<u4")


# Blocks: a row for the documents, and one for each bucket of distinct segments


def _coded(a: str, b: str, buckets: int, most: int, kept: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kept", pa.list_(kept)), ("n", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = aligner(a, b).cuts
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, 1, most):
                cut, n = segments(some.column(1), cuts)
                coded = cut.dictionary_encode()
                found = coded.dictionary.to_pylist()
                bucket = np.array([zlib.crc32(s.encode()) % buckets for s in found], np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                sizes = np.bincount(bucket, minlength=buckets)
                in_order, at, rows = coded.dictionary.take(pa.array(order)), 0, []
                for k in np.flatnonzero(sizes).tolist():
                    part = in_order.slice(at, int(sizes[k]))
                    at += int(sizes[k])
                    lengths = pc.binary_length(part).to_numpy(zero_copy_only=False)
                    rows.append((k, np.concatenate([[len(part)], lengths]), b"".join(x.encode() for x in part.to_pylist())))
                out = [{"block": block, "bucket": k, "kept": None, "n": None, "data": _with_text(head, text)} for k, head, text in rows]
                codes = place[coded.indices.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_pylist(out, schema)
                docs = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([buckets], pa.int32()), docs, pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([_pack(codes)], pa.binary())], schema=schema)
                block += 1

    return run


def _with_text(head: np.ndarray, text: bytes) -> bytes:
    packed = _pack(head)
    return len(packed).to_bytes(8, "little") + packed + len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(text, asbytes=True)


def _texts(data: bytes) -> list[str]:
    k = 8 + int.from_bytes(data[:8], "little")
    lengths = _unpack(data[8:k])[1:].astype(np.int64)
    text = pa.Codec("zstd").decompress(data[k + 8 :], int.from_bytes(data[k : k + 8], "little"), asbytes=True)
    ends = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [text[x:y].decode() for x, y in zip(ends, ends[1:], strict=False)]


def _align(a: str, b: str):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b)
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = align.words(_texts(data))
                sizes = np.array([len(w) // 4 for w in words], np.uint32)
                packed = _pack(np.concatenate([[len(words)], sizes, np.frombuffer(b"".join(words), "<u4")]))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    return run


class _Segments:
    """What a block's distinct segments have: counts, groups as text, links."""

    def __init__(self, packed: list[bytes]):
        parts = [_unpack(x) for x in packed]
        sizes = np.concatenate([[], *(x[1 : 1 + x[0]] for x in parts)]).astype(np.int64)
        words = np.concatenate([np.zeros(0, np.uint32), *(x[1 + x[0] :] for x in parts)])
        del parts, packed
        self.good = sizes > 0
        self.text = self._texts(words, sizes)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        follows = words >> 30
        ends = follows == 2
        group = np.cumsum(ends, dtype=np.int32) - ends
        of_group = of[ends]
        side = np.cumsum(follows == 1, dtype=np.int32) - (follows == 1) - group == 1
        del follows, ends
        self.n_a = np.bincount(of[~side], minlength=len(sizes))
        self.n_b = np.bincount(of[side], minlength=len(sizes))
        self.n_groups = np.bincount(of_group, minlength=len(sizes))
        del of
        # Distinct ids of each group and side with their numbers: each meets each of the other side.
        words &= ID
        left, right = (_counted(group[k], words[k]) for k in (~side, side))
        del group, side, words
        first = np.searchsorted(right[0], left[0])
        many = np.searchsorted(right[0], left[0], side="right") - first
        at = np.repeat(np.arange(len(left[0])), many)
        to = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(at))
        self.weight = left[2][at] * right[2][to]
        self.links = np.bincount(of_group[left[0][at]], minlength=len(sizes)) if len(at) else np.zeros(len(sizes), np.int64)
        keys = left[1][at] << 32 | right[1][to]
        del at, to, left, right
        pairs, code = np.unique(keys, return_inverse=True)
        self.code, self.a, self.b = code.astype(np.int32), pairs >> 32, pairs & 0xFFFFFFFF

    @staticmethod
    def _texts(words: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        kinds, which = np.unique(words, return_inverse=True)
        signs = [b"%d%b" % (w & ID, b",|;"[w >> 30 : (w >> 30) + 1]) for w in kinds.tolist()]
        which, cut = which.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return [b"".join([signs[k] for k in which[x:y].tolist()]) for x, y in zip(cut, cut[1:], strict=False)]


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, n = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


_STATS = ("n_a", "n_b", "n_groups", "n_links")
_COMPOSED = f"block long, {{kept}}, {', '.join(f'{c} array<long>' for c in _STATS)}, sha array<string>, links binary, a array<int>, b array<int>, holders array<int>"


def _compose(buckets: int, some: int, kept: pa.DataType):
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema([("block", pa.int64()), ("kept", pa.list_(kept)), *((c, longs) for c in _STATS), ("sha", pa.list_(pa.string())), ("links", pa.binary()), ("a", ints), ("b", ints), ("holders", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()  # what the stages before keep isn't used here
        packed: list[bytes] = []
        for batch in batches:
            block, bucket, docs, n, data = (batch.column(c) for c in range(5))
            for k in range(batch.num_rows):
                if bucket[k].as_py() < buckets:
                    packed.append(data[k].as_py())
                    continue
                out = _documents(_Segments(packed), np.array(n[k].as_py(), np.int64), _unpack(data[k].as_py()).astype(np.int64), some)
                packed = []
                kinds = [x.type for x in schema][2:]
                yield pa.RecordBatch.from_arrays([block.slice(k, 1), docs.slice(k, 1), *(pa.array([x], t) for x, t in zip(out, kinds, strict=True))], schema=schema)

    return run


def _documents(s: _Segments, n: np.ndarray, codes: np.ndarray, some: int) -> tuple:
    """Counts, digests and packed links of a block's documents; the block's pairs and how many documents hold each."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    lost = np.bincount(of[~s.good[codes]], minlength=len(n)) > 0
    there = (n > 0) & ~lost
    stats = [(np.bincount(of, weights=x[codes], minlength=len(n)) * there).astype(np.int64) for x in (s.n_a, s.n_b, s.n_groups)]
    cut, sha = bounds.tolist(), []
    for k, good in enumerate(there.tolist()):
        sha.append(hashlib.sha256(b"".join([s.text[c] for c in codes[cut[k] : cut[k + 1]].tolist()])[:-1]).hexdigest() if good else "")
    # Links by document and pair, some documents at a time.
    start = np.cumsum(s.links) - s.links
    per_doc, pairs, weights = np.zeros(len(n), np.int64), [], []
    n_links, holders, at = np.zeros(len(n), np.int64), np.zeros(len(s.a), np.int64), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + some, side="right")) - 1)
        mine = slice(bounds[at], bounds[to])
        keep = there[of[mine]]
        keys, times = np.unique(of[mine][keep] * len(s.good) + codes[mine][keep], return_counts=True)
        doc, code = np.divmod(keys, max(1, len(s.good)))
        links = s.links[code]
        place = np.repeat(start[code] - (np.cumsum(links) - links), links) + np.arange(links.sum())
        keys, which = np.unique(np.repeat(doc, links) * len(s.a) + s.code[place], return_inverse=True)
        total = np.bincount(which, weights=np.repeat(times, links) * s.weight[place], minlength=len(keys)).astype(np.int64)
        doc, code = np.divmod(keys, max(1, len(s.a)))
        per_doc += np.bincount(doc, minlength=len(n))
        n_links += np.bincount(doc, weights=total, minlength=len(n)).astype(np.int64)
        holders += np.bincount(code, minlength=len(s.a))
        pairs.append(code)
        weights.append(total)
        at = to
    steps = np.diff(np.concatenate([np.zeros(1, np.int64), *pairs])) % (1 << 32)
    packed = _pack(np.concatenate([[len(n)], per_doc, steps, *weights]))
    return *(x.tolist() for x in (*stats, n_links)), sha, packed, s.a, s.b, holders


def _finish(kept: pa.DataType):
    """A block's pairs, in order, then its documents."""
    schema = pa.schema([("kept", kept), *((c, pa.int64()) for c in (*_STATS, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            code, count, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            at = 0
            for k in [*np.flatnonzero(code < 0).tolist(), batch.num_rows]:
                if k > at:
                    held.append((count[at:k], best[at:k]))
                if k == batch.num_rows:
                    break
                counts, bests = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]).astype(np.int64) for i in (0, 1))
                held, at = [], k + 1
                packed = _unpack(batch.column("links")[k].as_py()).astype(np.int64)
                n = int(packed[0])
                per_doc = packed[1 : 1 + n]
                step, weight = np.split(packed[1 + n :], 2)
                # Differences of places, wrapped where they fall: their sums are right in 32 bits.
                place = (np.cumsum(step) % (1 << 32)) if len(step) else step
                of = np.repeat(np.arange(n), per_doc)
                sums = [np.bincount(of, weights=weight * x[place], minlength=n).astype(np.int64) for x in (bests, counts)]
                columns = [batch.column(c)[k].values for c in ("kept", *_STATS)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in sums), batch.column("sha")[k].values], schema=schema)

    return run


_OUTPUTS = (*_STATS, "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, a: str, b: str, keep: tuple[str, ...] = ("doc_id",), buckets: int | None = None, block: int = BLOCK, some: int = SOME) -> DataFrame:
    """keep columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row's text.

    a: a byte-level vocabulary of the tokenizers library, which gets ' ' + text; b: a
    sentencepiece file of the merge type, which puts its own space in front. Groups lie
    between the places where tokens of both end; all pairs of an a and a b token of a group are
    linked. A pair of ids counts the rows of docs that hold it linked; n_best are the links whose
    count is the highest of their a id, count_sum sums the counts over links.

    Null and empty texts, and those that either vocabulary doesn't give back byte by byte, have no
    tokens: zeros and an empty digest. Repeated rows are rows of their own, equal texts have equal
    numbers. An empty table gives no rows. A kept column named like an output gives way to it;
    other columns have no part.

    Distinct segments are dealt to `buckets` (the shuffle partitions, if not told); a task holds a
    block (so many bytes of text, or one text), `some` places of segments of documents that are
    composed at once, and at most 2 * KEPT aligned segments.
    """
    spark = docs.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = docs.select(kept_columns(keep, _OUTPUTS), F.col("text").cast("string").alias("text"))
    kind = df.schema["kept"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kept = to_arrow_type(df.schema["kept"].dataType)
    with arrow_batches(spark, BLOCK_ROWS):
        blocks = materialize(df.mapInArrow(_coded(a, b, buckets, block, kept), f"block long, bucket int, kept array<{kind}>, n array<long>, data binary"), "alignment-blocks")
    asked = blocks.where(F.col("bucket") < buckets).select("block", "bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    aligned = materialize(asked.mapInArrow(_align(a, b), "block long, bucket int, data binary"), "alignment-segments")
    told = blocks.where(F.col("bucket") == buckets).unionByName(aligned, allowMissingColumns=True).select("block", "bucket", "kept", "n", "data")
    told = told.repartition("block").sortWithinPartitions("block", "bucket")
    with arrow_batches(spark, COMPOSED_ROWS):
        composed = materialize(told.mapInArrow(_compose(buckets, some, kept), _COMPOSED.format(kept=f"kept array<{kind}>")), "alignment-documents")
    discard(blocks, aligned)
    pairs = composed.select("block", F.posexplode(F.arrays_zip("a", "b", "holders")).alias("code", "p")).select("block", "code", "p.a", "p.b", "p.holders")
    counts = pairs.groupBy("a", "b").agg(F.sum("holders").alias("count"))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long"))  # an id meets at most the other vocabulary
    counts = materialize(counts, "alignment-counts")
    c = counts.select(F.col("a").alias("x"), F.col("b").alias("y"), "count", "best")
    found = pairs.join(c, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("block", "code", "count", "best")
    rest = composed.select("block", F.lit(-1).alias("code"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("best"), "kept", *_STATS, "sha", "links")
    out = rest.unionByName(found, allowMissingColumns=True).select("block", "code", "count", "best", "kept", *_STATS, "sha", "links")
    out = out.repartition("block").sortWithinPartitions("block", F.col("code") < 0, "code")
    longs = ", ".join(f"{c} long" for c in _OUTPUTS[:-1])
    return out.mapInArrow(_finish(kept), f"kept {kind}, {longs}, groups_sha256 string").select(*unpacked(keep, _OUTPUTS), *_OUTPUTS)
