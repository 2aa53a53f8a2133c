"""Repeated-passage removal by a distributed merge sort of suffixes.

Every byte that lies in a 200-byte string found elsewhere is removed. Sorting all
suffixes of the corpus is not needed for that: a minimizer rule picks anchors, so
that any two equal strings of 200 bytes hold an anchor at the same place, and only
suffixes at anchors whose first 64 bytes are found again (by hash) are sorted.

* Long runs of a short period (one byte again and again, say) have an anchor a period. All of a run's
  bytes repeat one period on, so its span is told at once, and only the anchors of its first strings
  and of those that leave it are kept: each text still has all anchors of the first of equal strings.
* Runs: each task sorts its suffixes and front-codes them: a suffix is the length of
  the prefix that it shares with the one before, and the rest.
* Exchange: runs are cut at the same bounds everywhere. The order's first key is the
  hash of a suffix's first 64 bytes, which makes equal ranges equally full.
  Suffixes that are equal with all that matters before them repeat whatever else there
  is: a run tells their spans at once and keeps one of them, without its places, so the
  copies of a passage never meet in one task.
* Merge: a loser tree that keeps, with each loser, the prefix it shares with the last
  winner. Unequal lengths decide a match without reading a byte, and equal ones go on
  behind the shared prefix; what a run's front-coding tells is never compared again.
* The merged order, with the prefixes shared by neighbours, and the order of the bytes
  before the anchors tell for each anchor which 200-byte strings around it repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_batches, discard, materialize

#: Bytes of a repeated string; of an anchor's own string; windows of the minimizer.
LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Window starts handled at once; suffixes in a run; suffixes resolved at once; rows handed to Python at once.
SEGMENT, RUN, BLOCK, BATCH = 262_144, 40_000, 20_000, 256
#: Periods whose runs are told at once, in texts of so many bytes; shorter texts have few anchors whatever they hold.
PERIOD, LONG = 32, 16_384
#: Suffixes that a range of the merge holds on average; the number of ranges follows their count.
RANGE = 25_000

_rng = np.random.default_rng(0xA9C)
_CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int) -> np.ndarray:
    if name not in _powers:
        x = np.full(SEGMENT + 2 * LENGTH, base, np.uint64)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name]


def gram_hashes(a: np.ndarray, k: int = GRAM) -> np.ndarray:
    """64-bit hash of the k bytes from each place of a, by content alone."""
    n = len(a)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[a] * _power("inverse", _INVERSE)[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _power("base", _BASE)[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def spread(h: np.ndarray) -> np.ndarray:
    """The hashes of anchors are small, being least in a window; these are even."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)


def _sliding(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each w neighbours: prefixes and suffixes of blocks."""
    n = len(h)
    x = np.full(-(-n // w) * w, np.uint64(2**64 - 1) if pick is np.minimum else np.uint64(0))
    x[:n] = h
    x = x.reshape(-1, w)
    ahead = pick.accumulate(x, axis=1).ravel()
    back = pick.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def stretches(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, d): maximal runs of a with period d <= PERIOD and at least LENGTH + d bytes, each byte of which lies in a repeated string."""
    found = []
    for d in range(1, min(PERIOD, len(a) - LENGTH) + 1):
        some = a[:-d:64] == a[d::64]  # LENGTH equal places in a row hold three of every 64th
        if not (some[2:] & some[1:-1] & some[:-2]).any():
            continue
        ends = np.flatnonzero(np.diff((a[:-d] == a[d:]).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        found += [(s, e + d, d) for s, e in ends[ends[:, 1] - ends[:, 0] >= LENGTH].tolist()]
    return found


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the strings that are least in a window of some 200-byte string; ties all count, but those within a long run of a short period."""
    a = np.frombuffer(text, np.uint8)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(a) - LENGTH + 1, SEGMENT):
        h = gram_hashes(a[at : at + SEGMENT + LENGTH - 1])
        least = _sliding(h, WINDOW, np.minimum)
        padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
        chosen = np.flatnonzero(_sliding(padded, WINDOW, np.maximum) == h)
        if len(a) >= LONG:
            keep = np.ones(len(chosen), bool)
            for s, e, d in stretches(a[at : at + SEGMENT + LENGTH - 1]):  # the same string is found d bytes before
                keep &= (chosen < s + 2 * d + WINDOW) | (chosen > e - LENGTH)
            chosen = chosen[keep]
        places.append(chosen + at)
        hashes.append(h[chosen])
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            ids, out = some.column(0).to_numpy(), [anchors(t) for t in some.column(1).cast(pa.binary()).to_pylist()]
            columns = np.concatenate([h for _, h in out]).view(np.int64), np.repeat(ids, [len(p) for p, _ in out]), np.concatenate([p for p, _ in out])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32())], names=["key", "cid", "pos"])


# ---- runs: (suffix, left, members); a suffix is the hash and LENGTH bytes from the anchor,
# left the bytes before it in reverse, a member a text's digest and the anchor's place


def _shared(rows: list[bytes]) -> np.ndarray:
    """Length of the prefix that each row shares with the one before (0 for the first)."""
    if not rows:
        return np.zeros(0, np.int64)
    wide = max(1, max(map(len, rows)))
    m = np.frombuffer(b"".join([r.ljust(wide, b"\0") for r in rows]), np.uint8).reshape(len(rows), wide)
    lengths = np.array([len(r) for r in rows])
    differs = m[1:] != m[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    return np.concatenate([[0], np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))])


def encode_run(entries: list[tuple[bytes, bytes, list[tuple[bytes, int]]]]) -> bytes:
    """Front-coded bytes of sorted entries."""
    suffixes = [e[0] for e in entries]
    shared = _shared(suffixes)
    rests = [s[k:] for s, k in zip(suffixes, shared.tolist(), strict=True)]
    digests: dict[bytes, int] = {}
    members = [(digests.setdefault(d, len(digests)), p) for e in entries for d, p in e[2]]
    parts = [
        struct.pack("<III", len(entries), len(digests), len(members)),
        shared.astype("<u2").tobytes(),
        np.array([len(r) for r in rests], "<u2").tobytes(),
        np.array([len(e[1]) for e in entries], "<u2").tobytes(),
        np.array([len(e[2]) for e in entries], "<u4").tobytes(),
        np.array(members, "<u4").tobytes(),
        *digests,
        *rests,
        *[e[1] for e in entries],
    ]
    return b"".join(parts)


def decode_run(data: bytes) -> Iterator[tuple[int, bytes, bytes, list[tuple[bytes, int]]]]:
    """(prefix shared with the one before, suffix, left, members) of each entry."""
    n, n_digests, n_members = struct.unpack_from("<III", data)
    at = 12

    def array(kind: str, count: int) -> list:
        nonlocal at
        out = np.frombuffer(data, kind, count, at).tolist()
        at += count * np.dtype(kind).itemsize
        return out

    shared, rests, lefts, counts = array("<u2", n), array("<u2", n), array("<u2", n), array("<u4", n)
    members = array("<u4", 2 * n_members)
    digests = [data[at + 32 * i : at + 32 * i + 32] for i in range(n_digests)]
    at += 32 * n_digests
    left_at, m, suffix = at + sum(rests), 0, b""
    for i in range(n):
        suffix = suffix[: shared[i]] + data[at : at + rests[i]]
        at += rests[i]
        mine = [(digests[members[2 * j]], members[2 * j + 1]) for j in range(m, m + counts[i])]
        m += counts[i]
        yield shared[i], suffix, data[left_at : left_at + lefts[i]], mine
        left_at += lefts[i]


def _differ(a: bytes, b: bytes, at: int) -> int:
    """First place from `at` where a and b differ, or where one ends."""
    end = min(len(a), len(b))
    while at < end:
        step = min(at + 16, end)
        if a[at:step] != b[at:step]:
            while a[at] == b[at]:
                at += 1
            return at
        at = step
    return end


def merge_runs(runs: list[Iterator[tuple[int, bytes, bytes, list]]]) -> Iterator[tuple[int, bytes, bytes, list]]:
    """All entries in order, with the prefix shared with the one before, by a loser tree.

    heads: each run's entry; known: the prefix that it shares with the last winner.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    runs = runs + [iter(())] * (k - len(runs))
    ended = (0, None, b"", [])
    heads = [next(r, ended) for r in runs]
    known = [0 if h[1] is not None else -1 for h in heads]

    def match(s: int, t: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser learns what it shares with the winner."""
        a, b = known[s], known[t]
        if a != b:
            return (s, t) if a > b else (t, s)
        if a < 0:
            return s, t
        x, y = heads[s], heads[t]
        d = _differ(x[1], y[1], a)
        p, q = x[1][d : d + 1], y[1][d : d + 1]
        if p < q or p == q and x[2] <= y[2]:
            known[t] = d
            return s, t
        known[s] = d
        return t, s

    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = match(play(2 * node), play(2 * node + 1))
        return winner

    winner = play(1)
    while known[winner] >= 0:
        head = heads[winner]
        yield known[winner], head[1], head[2], head[3]
        new = heads[winner] = next(runs[winner], ended)
        known[winner] = new[0] if new[1] is not None else -1
        node = (winner + k) // 2
        while node:
            t = losers[node]
            if known[winner] > known[t]:
                pass
            elif known[winner] < known[t]:
                winner, losers[node] = t, winner
            else:
                winner, losers[node] = match(winner, t)
            node //= 2


def resolve(shared: list[int], suffixes: list[bytes], lefts: list[bytes], several: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of whole groups, the most and the least bytes before the anchor at which a repeated string starts (-1: none).

    The string that starts o bytes before the anchor repeats if another entry shares o
    bytes to the left and the rest to the right: both are runs in the sorted orders.
    """
    n = len(suffixes)
    right = np.array(shared) - 8
    right_size, left_size = np.array([len(s) - 8 for s in suffixes]), np.array([len(x) for x in lefts])
    order = sorted(range(n), key=lefts.__getitem__)
    left, place = _shared([lefts[i] for i in order]), np.empty(n, np.int64)
    place[order] = np.arange(n)
    several = np.array(several)
    most, least = np.full(n, -1), np.full(n, -1)
    for o in range(WINDOW):
        rows = np.flatnonzero((left_size >= o) & (right_size >= LENGTH - o))
        code = (right < LENGTH - o).cumsum()[rows] * (n + 1) + (left < o).cumsum()[place[rows]]
        by = np.argsort(code, kind="stable")
        same = code[by][1:] == code[by][:-1]
        found = several[rows]
        found[by[1:]] |= same
        found[by[:-1]] |= same
        at = rows[found]
        most[at] = o
        at = at[least[at] < 0]
        least[at] = o
    return most, least


def own_span(suffix: bytes, left: bytes, pos: int) -> tuple[int, int] | None:
    """Start and end of the bytes around an anchor that an equal suffix with equal bytes before it repeats."""
    most, least = min(len(left), WINDOW - 1), max(0, LENGTH - (len(suffix) - 8))
    return (pos - most, pos - least + LENGTH) if least <= most else None


def repeated_spans(runs: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, end) of the repeated bytes around the anchors of one range's runs.

    An entry without members stands for several equal ones whose spans are told already.
    """
    shared: list[int] = []
    suffixes: list[bytes] = []
    lefts: list[bytes] = []
    members: list[list] = []

    def flush() -> Iterator[tuple[bytes, int, int]]:
        most, least = resolve(shared, suffixes, lefts, [not m for m in members])
        for i in np.flatnonzero(most >= 0).tolist():
            for digest, pos in members[i]:
                yield digest, pos - int(most[i]), pos - int(least[i]) + LENGTH
        for x in (shared, suffixes, lefts, members):
            x.clear()

    for h, suffix, left, mine in merge_runs([decode_run(r) for r in runs]):
        if suffixes and h == len(suffix) == len(suffixes[-1]) and left == lefts[-1]:
            for digest, pos in members[-1] + mine:
                if span := own_span(suffix, left, pos):
                    yield digest, *span
            members[-1] = []
            continue
        if len(suffixes) >= BLOCK and h < 8 + GRAM:  # a group is never cut
            yield from flush()
        shared.append(h)
        suffixes.append(suffix)
        lefts.append(left)
        members.append(mine)
    if suffixes:
        yield from flush()


def _runs(n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes, int]] = []
        periodic: dict[bytes, list[tuple[int, int]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort()
            ranges: dict[int, list] = {}
            told = dict(periodic)
            periodic.clear()
            for (suffix, left), equal in groupby(held, key=itemgetter(0, 1)):
                members = [(digest, pos) for _, _, digest, pos in equal]
                if len(members) > 1:
                    for digest, pos in members:
                        if span := own_span(suffix, left, pos):
                            told.setdefault(digest, []).append(span)
                    members = []
                ranges.setdefault(int.from_bytes(suffix[:8], "big") * n_ranges >> 64, []).append((suffix, left, members))
            held.clear()
            rows = [(part, encode_run(entries), None, None) for part, entries in ranges.items()]
            rows += [(int.from_bytes(d[:4], "big") % n_ranges, None, d, [x for span in union(spans) for x in span]) for d, spans in told.items()]
            for some in [rows[i : i + 64] for i in range(0, len(rows), 64)]:
                columns = zip(zip(*some, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["part", "run", "digest", "spans"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                for row, (digest, text) in enumerate(zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                    at = some.column(2)[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.sort(at[at + GRAM <= len(text)])
                    if not len(at):
                        continue
                    keys = np.concatenate([gram_hashes(np.frombuffer(text, np.uint8, min(SEGMENT + GRAM, len(text) - s), s))[at[(at >= s) & (at < s + SEGMENT)] - s] for s in range(0, int(at[-1]) + 1, SEGMENT)])
                    if len(text) >= LONG:
                        whole = np.frombuffer(text, np.uint8)
                        spans = [(b + s, b + e) for b in range(0, len(text) - LENGTH + 1, SEGMENT) for s, e, _ in stretches(whole[b : b + SEGMENT + LENGTH - 1])]
                        if spans:
                            periodic[digest] = union(spans)
                    raw = spread(keys).astype(">u8").tobytes()
                    for i, p in enumerate(at.tolist()):
                        held.append((raw[8 * i : 8 * i + 8] + text[p : p + LENGTH], text[max(0, p - WINDOW + 1) : p][::-1], digest, p))
                        if len(held) >= RUN:
                            yield from flush()
        if held or periodic:
            yield from flush()

    return run


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    found: dict[bytes, list[tuple[int, int]]] = {}
    told = frame[frame["run"].isna()]
    for digest, flat in zip(told["digest"], told["spans"], strict=True):
        found.setdefault(digest, []).extend(zip(flat[::2].tolist(), flat[1::2].tolist(), strict=True))
    for digest, start, end in repeated_spans(list(frame["run"].dropna())):
        found.setdefault(digest, []).append((start, end))
    rows = [(d, s, e) for d, spans in found.items() for s, e in union(spans)]
    return pd.DataFrame(rows, columns=["digest", "start", "end"])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans that cover the same bytes."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"digest": pa.binary(), "_removed": pa.int64(), "_cuts": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "_sha": pa.string()}
    for batch in batches:
        rows = []
        for digest, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans = union([(x["start"], x["end"]) for x in spans])
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            rows.append((digest, sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for each row of docs(doc_id, text).

    Texts are UTF-8 bytes, null ones empty. A byte is removed if a LENGTH-byte string
    over it starts anywhere else too, in the same text (overlaps count) or another;
    spans are the removed runs. Rows with equal texts are told apart by their number
    only, so copies of a text of LENGTH bytes are removed whole, and the text is sorted
    once. Shorter texts have no such string. Ties, repeated rows and null doc_ids change
    nothing.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    base = materialize(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "suffix")

    # Anchors whose strings are found at two places at least. A cid is a text; should two
    # texts share one, each gets the other's places too, where sorting finds what it finds.
    long = texts.where(F.octet_length("text") >= LENGTH).withColumn("cid", F.xxhash64("digest"))
    found = long.select("cid", "text").mapInArrow(_anchor_rows, "key bigint, cid bigint, pos int")
    place = F.xxhash64("cid", "pos")
    # written, so that both sides of the join are exchanged as they are and a common passage's key can be split
    again = materialize(found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"), "suffix")
    places = found.join(again, "key", "left_semi").groupBy("cid").agg(F.collect_set("pos").alias("places"))
    sorted_texts = long.join(places.withColumnRenamed("cid", "_cid"), F.col("cid") == F.col("_cid")).dropDuplicates(["cid", "digest"]).select("digest", "text", "places")
    with arrow_batches(spark, BATCH):
        sorted_texts = materialize(sorted_texts, "suffix")

    n_suffixes = sorted_texts.agg(F.sum(F.size("places").cast("long"))).first()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_suffixes // RANGE))
    runs = sorted_texts.mapInArrow(_runs(n_ranges), "part int, run binary, digest binary, spans array<bigint>").repartition(n_ranges, "part")
    spans = runs.groupBy("part").applyInPandas(_merge, "digest binary, start bigint, end bigint")
    spans = spans.groupBy(F.col("digest").alias("_digest")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    cut = sorted_texts.join(spans, F.col("digest") == F.col("_digest")).select("digest", "text", "_spans")
    with arrow_batches(spark, BATCH):
        cut = materialize(cut.mapInArrow(_cut, "digest binary, _removed bigint, _cuts array<struct<start: bigint, end: bigint>>, _sha string"), "suffix")
    discard(again, sorted_texts)

    # A row for each text that copies or cuts say something of, written: the rows of a text with many copies then
    # meet it in one join, whose exchanged sides can be split.
    copied = base.where(F.col("n_bytes") >= LENGTH).groupBy(F.col("digest").alias("_copied")).agg(F.count("*").alias("_times")).where("_times > 1")
    told = cut.join(copied, F.col("digest") == F.col("_copied"), "full").select(F.coalesce("digest", "_copied").alias("_digest"), F.col("_times").isNotNull().alias("_whole"), "_removed", "_cuts", "_sha")
    told = materialize(told, "suffix")
    discard(cut)
    whole = F.coalesce("_whole", F.lit(False))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return (
        base.join(told, F.col("digest") == F.col("_digest"), "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("_cuts", none)).alias("spans"),
            F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("_sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
        )
        .select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
    )
