"""MinHash near-duplicates: universal hash minima, banding, verification, components.

1. Each text's shingle set gets a digest, many hash minima, band keys and a sketch of
   one bit a minimum. Texts with one set are a class, and its least doc_id goes on.
2. The representatives that share a band key are a bucket. Each bucket's most frequented
   member (the one whose buckets are fullest, such as the original of many copies) is
   its hub, and all members are held against it.
3. Pairs whose sketches agree enough are verified on the full shingle sets; verified
   pairs make components by large-star and small-star.
4. What is left in a bucket from different components is held against each other in
   the same way, so no link between buckets' members goes untested. Copies of one text
   are in one component by then, and their pairs are never formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, release_kept
from graphloom.llm.components import components

#: Rows and bands: at a similarity of 0.8, 48 bands of 6 minima all miss once in two million.
BANDS, ROWS = 48, 6
SKETCH_BITS = 256
SIMILARITY, SHINGLE_WORDS = 80, 5
CACHED = 300_000
_SEED = 0x5EED

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n functions x -> (a x + b mod 2^64) div 2^32, strongly universal for 32-bit x."""
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words; fewer words, but not none, are one run."""
    if len(words) <= k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class Signer:
    def __init__(self, k: int, bands: int = BANDS, rows: int = ROWS):
        self.k, self.bands, self.rows = k, bands, rows
        self.a, self.b = _universal(max(bands * rows, SKETCH_BITS))
        self.seen: dict[bytes, int] = {}
        self.row_keys = _mixed(np.arange(1, rows + 1, dtype=np.uint64) * _MIX)
        self.band_keys = np.arange(1, bands + 1, dtype=np.uint64) * _MIX

    def shingle_hashes(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        seen, fresh = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > CACHED:
            seen.clear()
        hashes = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = fresh(w)
            hashes.append(h)
        x = np.array(hashes, np.uint64)
        n = max(1, len(x) - self.k + 1)
        k = min(self.k, len(x))
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = _mixed(out * _MIX + x[i : i + n])
        return np.unique(out)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = hashes >> np.uint64(32)
        least = np.full(len(self.a), np.uint64(2**64 - 1))
        for i in range(0, len(x), 512):  # a block stays in the cache, however long the text
            block = self.a[:, None] * x[None, i : i + 512]
            block += self.b[:, None]
            np.minimum(least, block.min(axis=1), out=least)
        return least >> np.uint64(32)

    def sign(self, text: bytes | None) -> tuple[int, bytes | None, list[int], list[int]]:
        """Set size, set digest, band keys, sketch."""
        words = text.lower().split() if text else []
        if not words:
            return 0, None, [], []
        hashes = self.shingle_hashes(words)
        m = self.minima(hashes)
        rows = m[: self.bands * self.rows].reshape(self.bands, self.rows)
        keys = _mixed((_mixed(rows + self.row_keys) * self.row_keys).sum(axis=1, dtype=np.uint64) ^ self.band_keys)
        bits = (_mixed(m[:SKETCH_BITS] + _MIX) & np.uint64(1)).astype(np.uint8)
        digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
        return len(hashes), digest, keys.view(np.int64).tolist(), np.packbits(bits).view("<i8").tolist()


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        signer = Signer(k, bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out = list(zip(*map(signer.sign, some.column(1).cast(pa.binary()).to_pylist()), strict=True))
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return run


def _bits(some: set[tuple[bytes, ...]]) -> list[int]:
    """A set's Bloom filter of SKETCH_BITS bits and one hash, as signed 64-bit words."""
    x = 0
    for t in some:
        x |= 1 << xxhash.xxh3_64_intdigest(b" ".join(t)) % SKETCH_BITS
    return np.frombuffer(x.to_bytes(SKETCH_BITS // 8, "little"), "<i8").tolist()


def _verify(k: int, percent: int):
    """Pairs (u, v, text_u, text_v) on their full sets: whether they are similar, and how v's differs from u's.

    added and removed are what v has beyond u and lacks of it, as a number and filters.
    """
    words = [f"{c}{i}" for c in "ar" for i in range(SKETCH_BITS // 64)]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_()), ("added", pa.int64()), *((w, pa.int64()) for w in words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        last: tuple[int | None, set] = (None, set())
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for u, v, a, b in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.binary()).to_pylist(), some.column(3).cast(pa.binary()).to_pylist(), strict=True):
                    if last[0] != u:
                        last = (u, shingles(a.lower().split(), k))
                    other = shingles(b.lower().split(), k)
                    added = other - last[1]
                    both = len(other) - len(added)
                    linked = 100 * both >= percent * (len(last[1]) + len(other) - both)
                    rows.append((u, v, linked, len(added), *_bits(added), *_bits(last[1] - other)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)

    return run, f"u bigint, v bigint, linked boolean, added bigint, {', '.join(f'{w} bigint' for w in words)}"


def _far_bits(percent: int) -> int:
    """Sketch bits in which similar sets differ at most, up to seven standard deviations: at 80 percent, more with a chance of 1e-10."""
    p = (1 - percent / 100) / 2
    return int(SKETCH_BITS * p + 7 * (SKETCH_BITS * p * (1 - p)) ** 0.5 + 1)


def _agree(a: str, b: str, percent: int) -> str:
    """SQL condition on sketches and set sizes of a and b that similar sets meet."""
    bits = " + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(SKETCH_BITS // 64))
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {bits} <= {_far_bits(percent)}"


def _may_share(percent: int) -> str:
    """SQL condition that similar sets a and b meet, from how they differ from one hub.

    They share what of the hub neither lacks, and what both added. A filter's bits count
    elements at least once: the union of what is lacking has as many elements as bits or
    more, and what a added and b has no bit for isn't b's.
    """
    words = range(SKETCH_BITS // 64)
    gone = " + ".join(f"bit_count(a.r{i} | b.r{i})" for i in words)
    only_a, only_b = (" + ".join(f"bit_count({x}.a{i} & ~{y}.a{i})" for i in words) for x, y in ("ab", "ba"))
    most = f"a.hub_n - ({gone}) + least(a.added - ({only_a}), b.added - ({only_b}))"
    return f"coalesce({100 + percent} * ({most}) >= {percent} * (a.n + b.n), true)"


def classes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text).

    Words are lower-cased (A-Z) runs without ASCII white space. Sets are linked where
    100 * intersection >= percent * union, and a component's id is its least doc_id. A text
    of fewer words than a shingle is one shingle; texts without words, null ones
    included, have empty sets and are linked with nothing. Rows without doc_id are linked
    with nothing too and have no component_id. Rows that share a doc_id are one node of the
    graph, each a row of the result. An empty table gives no rows; other columns have no part.

    What joins on a bucket, a hub or a text's digest is written before it is exchanged, so
    that adaptive execution can split the rows of a hot key.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialize(docs.mapInArrow(_sign(shingle_words, bands, rows), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>"), "minhash")
    one = F.xxhash64("digest")
    signed = every.where("doc_id IS NOT NULL")
    if not signed.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo < hi").isEmpty():
        none = every.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
        return _by_row(docs.where("doc_id IS NOT NULL"), shingle_words, percent, bands, rows).unionByName(none)
    same = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = materialize(same, "minhash")
    reps = signed.join(same.select(F.col("digest").alias("_d"), "rep"), (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["doc_id"])
    sketch = [f"s{i}" for i in range(SKETCH_BITS // 64)]
    reps = materialize(reps.select("doc_id", F.col("n_shingles").alias("n"), *[F.col("sketch")[i].alias(s) for i, s in enumerate(sketch)], "bands"), "minhash")

    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    full = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "minhash")
    members = materialize(keys.join(full, "key"), "minhash")
    discard(full)
    weight = materialize(members.groupBy("doc_id").agg(F.sum("size").alias("weight")), "minhash")
    buckets, members = members, materialize(members.drop("size").join(weight, "doc_id").join(reps.drop("bands"), "doc_id"), "minhash")
    discard(buckets, reps)
    texts = materialize(docs.join(weight.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "minhash")
    hubs = members.groupBy("key").agg(F.max_by(F.struct("doc_id", "n", *sketch), F.struct("weight", -F.col("doc_id"))).alias("h")).select(F.col("key").alias("_key"), "h.*")
    hubs = materialize(hubs, "minhash")
    pairs = members.alias("a").join(hubs.alias("b"), F.expr(f"a.key = b._key AND a.doc_id <> b.doc_id AND {_agree('a', 'b', percent)}"))
    held = _compared(pairs.selectExpr("b.doc_id AS u", "a.doc_id AS v"), texts, shingle_words, percent)
    edges = held.where("linked").select("u", "v")
    found = materialize(components(edges), "minhash")

    # What shares a bucket but no component yet
    left = members.join(found, F.col("doc_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component", "weight")
    left = apart = materialize(left, "minhash")
    mixed = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    mixed = materialize(mixed.join(hubs.select(F.col("_key").alias("key"), F.col("doc_id").alias("hub"), F.col("n").alias("hub_n")), "key"), "minhash")
    left = left.join(mixed, "key")
    left = left.join(held.drop("linked"), (F.col("hub") == F.col("u")) & (F.col("doc_id") == F.col("v")), "left").drop("u", "v")
    own = F.col("doc_id") == F.col("hub")  # the hub adds nothing and lacks nothing
    left = left.withColumns({c: F.when(own, F.lit(0)).otherwise(F.col(c)).cast("long") for c in held.columns[3:]})
    left = materialize(left, "minhash")
    discard(apart, mixed)
    pairs = left.alias("a").join(left.alias("b"), F.expr(f"a.key = b.key AND a.c < b.c AND {_agree('a', 'b', percent)} AND {_may_share(percent)}"))
    rest = _compared(pairs.selectExpr("a.doc_id AS u", "b.doc_id AS v"), texts, shingle_words, percent)
    more = rest.where("linked")
    if not more.isEmpty():
        found = materialize(components(edges.unionByName(more.select("u", "v"))), "minhash")
    discard(members, weight, texts, hubs, held, left, rest)

    ids = same.join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("_d"), F.coalesce("component", "rep").alias("component_id"))
    found = every.join(ids, F.col("digest") == F.col("_d"), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _by_row(docs: DataFrame, *options) -> DataFrame:
    """classes where a doc_id has different sets: each row is a node first, then the rows of a doc_id are one."""
    nodes = materialize(docs.withColumn("node", F.monotonically_increasing_id()), "minhash")
    found = classes(nodes.select(F.col("node").alias("doc_id"), "text"), *options).withColumnsRenamed({"doc_id": "node", "component_id": "c"})
    found = materialize(found.join(nodes.select("node", "doc_id"), "node"), "minhash")
    least = found.groupBy("doc_id").agg(F.min("c").alias("u"))
    joined = materialize(components(found.join(least, "doc_id").select("u", F.col("c").alias("v"))), "minhash").withColumnRenamed("node", "c")
    found = found.join(joined, "c", "left").withColumn("c", F.coalesce("component", "c"))
    ids = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "c").select("doc_id", "n_shingles", "component_id")


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The candidate pairs (u, v) on their full sets, written; only their texts move."""
    run, schema = _verify(k, percent)
    pairs = materialize(pairs.distinct(), "minhash")
    first = pairs.join(texts.withColumnsRenamed({"doc_id": "_v", "text": "text_v"}), F.col("v") == F.col("_v")).select("u", "v", "text_v")
    both = first.join(texts.withColumnsRenamed({"doc_id": "_u", "text": "text_u"}), F.col("u") == F.col("_u")).select("u", "v", "text_u", "text_v")
    found = materialize(both.mapInArrow(run, schema), "minhash")
    discard(pairs)
    return found


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the least doc_id; columns as they were.

    Rows that share a doc_id stay or go together; rows without doc_id stay.
    """
    kept = classes(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.where("doc_id IS NULL"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+')"
#: For sets of 2-word shingles.
ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents),
u AS (SELECT doc_id, n, i, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM (SELECT doc_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS i FROM d)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN w ELSE w || ' ' || x END AS s FROM u WHERE n = 1 OR x IS NOT NULL),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT s.doc_id, s.s, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.s) AS k FROM s JOIN c USING (doc_id) JOIN (SELECT s, count(*) AS df FROM s GROUP BY s) AS f ON s.s = f.s),
x AS MATERIALIZED (SELECT doc_id, s FROM o WHERE k <= n - ({SIMILARITY} * n + 99) // 100 + 1),
q AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.s = b.s AND a.doc_id < b.doc_id),
p AS (SELECT a, b, count(*) AS shared FROM q JOIN s AS y ON y.doc_id = a JOIN s AS z ON z.doc_id = b AND y.s = z.s GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c AS x ON x.doc_id = a JOIN c AS y ON y.doc_id = b WHERE 100 * shared >= {SIMILARITY} * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN c USING (doc_id) JOIN m USING (doc_id)
"""
