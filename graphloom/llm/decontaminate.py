"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. The text is read from one
window end to the next: the block of two words at the window end looks up its
shift; a block that no pattern holds lets the search jump nearly a whole window.
Where the shift is zero, the block's bucket and the first word select the
patterns, and a direct comparison confirms them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import kept_columns, release_kept, scratch, unpacked

WINDOW = 10
#: Benchmark text (bytes) that one search table may hold; more text makes more tables.
BLOCK_BYTES = 2_000_000
#: Search tables that a worker keeps; beyond, bytes of documents that it holds while it goes through them.
KEPT_TABLES, HELD_BYTES = 4, 64_000_000

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search table for word patterns; patterns of one length share a table."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        by_length: dict[int, dict] = {}
        for p in patterns:
            by_length.setdefault(len(p), {})[p] = None
        self.classes = [self._class(m, list(ps)) for m, ps in sorted(by_length.items()) if m]

    @staticmethod
    def _class(m: int, patterns: list[tuple[bytes, ...]]):
        b = min(2, m)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict[bytes, list]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                block = p[end - b : end]
                shift[block] = min(shift.get(block, m), m - end)
            buckets.setdefault(p[m - b :], {}).setdefault(p[0], []).append(p)
        return m, b, shift, buckets

    def find(self, text: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of each occurrence."""
        n = len(text)
        for m, b, shift, buckets in self.classes:
            end, far = m, m - b + 1
            while end <= n:
                block = tuple(text[end - b : end])
                step = shift.get(block)
                if step is None:
                    end += far
                elif step:
                    end += step
                else:
                    start = end - m
                    for p in buckets[block].get(text[start], ()):
                        if tuple(text[start:end]) == p:
                            yield start, p
                    end += 1


def windows(item_words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """The item's windows; an item of fewer words, but not none, is one window."""
    if item_words:
        for i in range(max(1, len(item_words) - size + 1)):
            yield tuple(item_words[i : i + size])


Rows = list[tuple[str, bytes]]


class Table:
    """One block's search table, and which items own each window."""

    def __init__(self, rows: Rows, size: int):
        self.owners: dict[tuple, list[str]] = {}
        for item, text in rows:
            for w in set(windows(words(text), size)):
                self.owners.setdefault(w, []).append(item)
        self.search = WuManber(self.owners)

    def add(self, text: list[bytes], spans: set[tuple[int, int]], items: set[str]) -> None:
        for start, p in self.search.find(text):
            spans.add((start, start + len(p)))
            items.update(self.owners[p])


def _tables(given: Rows | None, folder: str, n_blocks: int, size: int):
    """A function that gives the tables one by one; few are kept, many are made again from the folder, so that a worker holds one."""

    def load(k: int) -> Table:
        if given is not None:
            return Table(given, size)
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = f"{root}/block={k}"
        if fs.get_file_info(part).type == pyarrow.fs.FileType.NotFound:
            return Table([], size)
        rows = pyarrow.parquet.read_table(part, filesystem=fs, columns=["item_id", "text"], partitioning=None)
        return Table(list(zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), strict=True)), size)

    if n_blocks <= KEPT_TABLES:
        kept = [load(k) for k in range(n_blocks)]
        return lambda: iter(kept)
    return lambda: (load(k) for k in range(n_blocks))


def _runs(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in runs of about n_bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= n_bytes:
            yield held
            held, n = [], 0
    if held:
        yield held


def _search(given: Rows | None, folder: str, n_blocks: int, size: int):
    """Function for mapInArrow: (kept, text) to kept, n_words, n_hit, spans (flat), items and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        tables = _tables(given, folder, n_blocks, size)
        for held in _runs(batches, HELD_BYTES if n_blocks > KEPT_TABLES else 0):
            texts = [t for batch in held for t in batch.column(1).cast(pa.binary()).to_pylist()]
            spans: list[set] = [set() for _ in texts]
            items: list[set] = [set() for _ in texts]
            for table in tables():
                for text, s, i in zip(texts, spans, items, strict=True):
                    table.add(words(text), s, i)
            at = 0
            for batch in held:
                n = batch.num_rows
                rows = [_counted(*x) for x in zip(texts[at : at + n], spans[at : at + n], items[at : at + n], strict=True)]
                at += n
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["kept", *_FOUND])

    return run


_FOUND = ("n_words", "n_hit", "spans", "items", "items_sha256")


def _counted(text: bytes | None, spans: set[tuple[int, int]], items: set[str]) -> tuple[int, int, list[int], list[str], str]:
    total, done, ordered, named = 0, 0, sorted(spans), sorted(items)
    for s, e in ordered:
        total += max(0, e - max(s, done))
        done = max(done, e)
    return len(words(text)), total, [x for s in ordered for x in s], named, hashlib.sha256(",".join(named).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document row: keep columns, n_words, n_hit, n_items, items_sha256, contaminated, spans (flat starts and ends), items.

    docs(text, ...), benchmark(item_id, text). Search runs where the documents are, in one
    pass whatever the benchmark's size: nothing is shuffled. The benchmark is cut into blocks
    of about block_bytes of text (one item may be larger), whose number follows its measured
    size. One block goes with the tasks; more are written to the shared folder, and a worker
    reads them in turn for each run of documents, holding one search table (or a few).

    Null or empty texts have no words and no hits; null or empty items match nothing, nor do
    items without id; repeated items count once by id; repeated documents give a row each;
    an empty table of either kind is none found. A kept column named like an output gives
    way to it; other columns, whatever their names, have no part.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n_bytes = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // block_bytes))
    given, folder = None, ""
    if n_blocks == 1:
        given = [(r[0], r[1].encode()) for r in bench.collect()]  # block_bytes of text at most
    else:
        folder = scratch(spark, "benchmark")
        dealt = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
        dealt.repartition(min(n_blocks, 1_000), "block").write.partitionBy("block").parquet(folder)
    state = docs.select(kept_columns(keep, _OUTPUTS), F.col("text"))
    kind = state.schema["kept"].dataType.simpleString()
    found = state.mapInArrow(_search(given, folder, n_blocks, size), f"kept {kind}, n_words bigint, n_hit bigint, spans array<bigint>, items array<string>, items_sha256 string")
    return found.select(*unpacked(keep, _OUTPUTS), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")


_OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, columns as they were, whatever their names.

    Null and empty texts have none and stay; rows are judged one by one, so repeated rows
    stay or go together; an empty table stays empty, and an empty benchmark removes nothing.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = contamination(packed, benchmark, keep=("row",), **options)
    return found.where("NOT contaminated").select("row.*")


_A = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_A} AS w FROM documents),
b AS (SELECT item_id, {_A} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least({WINDOW}, n) AS m, array_to_string(l, ' ') AS s
      FROM (SELECT item_id, n, len(l) AS m, l FROM (SELECT item_id, n, list(w) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l
            FROM (SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS i FROM b))) WHERE m = least({WINDOW}, n)),
g AS (SELECT doc_id, m, i, array_to_string(l[1:m], ' ') AS s
      FROM (SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l
            FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d)), (SELECT DISTINCT m FROM p) AS k WHERE len(l) >= m),
h AS (SELECT doc_id, item_id, i, p.m FROM g JOIN p ON g.m = p.m AND g.s = p.s),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
