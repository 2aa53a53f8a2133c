"""Token ids in fixed-width bit-packed files, written in doc_id order.

File format (little-endian), one file for each range of documents:

    magic "GLT1" | bits u32 | block u32 | n_docs u64 | n_ids u64
    doc_ids   i64[n_docs]
    starts    u64[n_docs + 1]    first id of each document, within the file
    offsets   u64[n_blocks + 1]  first byte of each block of `block` ids, within the data
    data      each block's ids in `bits` bits each, least significant bit first

An id range is read from its blocks alone, and a block is unpacked by numpy at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_batches, kept_in_worker, scratch

MAGIC, HEAD = b"GLT1", struct.Struct("<4sIIQQ")
#: Stands for no doc_id in a file.
NO_ID = -(2**63)
#: Ids in a block; ids in a file, beyond which the next document opens a new one.
BLOCK, FILE_IDS = 65_536, 2_000_000
#: Words whose ids a worker keeps in each of two generations; bytes of text that it encodes at once; rows handed to it at once.
PARTS, SLICE, BATCH = 700_000, 8_000_000, 3_000
#: ASCII punctuation that a pre-token pattern takes in one piece (the apostrophe opens contractions).
CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def width(vocabulary: int) -> int:
    """The least bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def encode_file(doc_ids: list[int], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    blocks = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(x) for x in blocks], out=offsets[1:])
    head = HEAD.pack(MAGIC, bits, block, len(ids), len(flat))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to a file that encode_file made; f is a seekable binary file."""

    def __init__(self, f):
        self.f = f
        magic, self.bits, self.block, self.n_docs, self.n_ids = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: it begins with {magic!r}")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self._at(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.starts = np.frombuffer(self._at(at, 8 * self.n_docs + 8), "<u8").astype(np.int64)
        at += 8 * self.n_docs + 8
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self._at(at, 8 * n_blocks + 8), "<u8").astype(np.int64)
        self.data = at + 8 * n_blocks + 8

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; reads the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self._at(self.data + int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            part = data[int(self.offsets[k] - self.offsets[first]) : int(self.offsets[k + 1] - self.offsets[first])]
            out.append(unpack(part, self.bits, min(self.block, self.n_ids - k * self.block)))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, block by block."""
        lo, held = 0, np.zeros(0, np.uint32)
        for k in range(self.n_docs):
            a, b = int(self.starts[k]), int(self.starts[k + 1])
            if b > lo + len(held):
                to = min(self.n_ids, -(-b // self.block) * self.block)
                held = np.concatenate([held[a - lo :], self.ids(lo + len(held), to)])
                lo = a
            yield int(self.doc_ids[k]), a, held[a - lo : b - lo]


def _letters_and_closing(word: str) -> tuple[str, ...]:
    body = word.rstrip(CLOSING)
    return (body, word[len(body) :]) if len(body) < len(word) and body.isalpha() and body.lower().isalpha() else (word,)


def _pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces of words, which of them make up the words in order, and how many each word has.

    Letters and the punctuation that closes them are two pieces, as the tokenizer encodes
    them alone; any other word is one. ASCII words, in lower case, are cut all at once.
    """
    low = pc.ascii_lower(words)
    body = pc.ascii_rtrim(low, CLOSING)
    plain = pc.string_is_ascii(words)
    two = pc.and_(plain, pc.and_(pc.ascii_is_alpha(body), pc.less(pc.binary_length(body), pc.binary_length(low))))
    closing = pc.replace_substring_regex(low.filter(two), "^[a-z]+", "")
    others = [_letters_and_closing(w) for w in words.filter(pc.invert(plain)).to_pylist()]
    first = pc.replace_with_mask(pc.if_else(two, body, low), pc.invert(plain), pa.array([x[0] for x in others], words.type))
    coded = pa.concat_arrays([first, closing, pa.array([x[1] for x in others if len(x) == 2], words.type)]).dictionary_encode()
    n = np.where(two.to_numpy(zero_copy_only=False), 2, 1)
    rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    n[rest] = [len(x) for x in others]
    at = np.cumsum(n) - n
    cut = n == 2
    cut[rest] = False
    order, index = np.empty(int(n.sum()), np.int64), coded.indices.to_numpy(zero_copy_only=False)
    order[at] = index[: len(n)]
    order[np.concatenate([at[cut], at[rest[n[rest] == 2]]]) + 1] = index[len(n) :]
    return coded.dictionary, order, n


def _joined(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `at` of ids, whose runs have these sizes, one after another; and where each begins and the last ends."""
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of whole texts, for lower-casing tokenizers that drop white space and encode what lies between alone.

    The words between ASCII white space, without the punctuation that closes them, go
    through the tokenizer once; a text's ids are its words' ids in order. Any other
    tokenizer encodes texts whole.
    """

    def __init__(self, path: str, kept_words: int = PARTS):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lowers = any(x.get("type") == "Lowercase" for x in (made.get("normalizer") or {}).get("normalizers") or [])
        self.by_word = lowers and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert"))
        self.kept_words = kept_words
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was kept before; a word that is used again moves on

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.frombuffer(x, "<u4") for x in self._raw(texts.to_pylist())]
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pieces, order, n = _pieces(coded.dictionary)
        raw = self._known(pieces.to_pylist())
        ids, ends = _joined(np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64), order)
        sizes = np.diff(ends[np.concatenate([[0], np.cumsum(n)])])  # of words
        flat, ends = _joined(ids, sizes, coded.indices.to_numpy(zero_copy_only=False))
        bounds = ends[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        if len(self.parts) > self.kept_words:
            self.older, self.parts = self.parts, {}
        parts, older = self.parts, self.older
        unknown = [p for p in pieces if p not in parts]
        if older:
            parts.update([(p, older[p]) for p in unknown if p in older])
            unknown = [p for p in unknown if p not in older]
        for i in range(0, len(unknown), 10_000):
            some = unknown[i : i + 10_000]
            parts.update(zip(some, self._raw(some), strict=True))
        return [parts[p] for p in pieces]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have SLICE bytes at most, or one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


@kept_in_worker
def encoder(path: str, kept_words: int = PARTS) -> WordEncoder:
    """A worker's encoder: its words outlive a task."""
    return WordEncoder(path, kept_words)


def _write(folder: str, tokenizer: str, end_id: int, bits: int, file_ids: int, block: int, kept_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        encode, end = encoder(tokenizer, kept_words), np.array([end_id], "<u4")
        held: tuple[list[int], list[np.ndarray]] = ([], [])
        n, seq, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, seq
            name = f"{root}/{uuid.uuid4().hex}.glt"  # each attempt has its own; the manifest names what counts
            with fs.open_output_stream(name) as f:
                f.write(encode_file(*held, bits, block))
            row = {"part": [part], "seq": [seq], "name": [name], "n_ids": [n]}
            held, n, seq = ([], []), 0, seq + 1
            return pa.RecordBatch.from_pydict(row, pa.schema({"part": pa.int32(), "seq": pa.int64(), "name": pa.string(), "n_ids": pa.int64()}))

        for batch in batches:
            for some in _slices(batch, 1):
                part = some.column(2)[0].as_py()
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    held[0].append(doc_id)
                    held[1].append(np.append(ids, end))
                    n += len(ids) + 1
                    if n >= file_ids:
                        yield flush()
        if held[0]:
            yield flush()

    return run


def _read(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for frame in frames:
            for name, base in zip(frame["name"], frame["base"], strict=True):
                with fs.open_input_file(name) as f:
                    rows = [(d, base + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in TokenFile(f).documents()]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, file_ids: int = FILE_IDS, block: int = BLOCK, kept_words: int = PARTS, path: str | None = None) -> tuple[str, DataFrame]:
    """Write docs(doc_id, text) as token files; (folder, manifest).

    They go to a new folder at the URI `path` that all executors can write; without it, to
    scratch space that goes with this process.

    The texts are dealt and sorted by doc_id, then by text, so that the files' order
    is that of the documents; repeated rows are written each. A task holds a file's
    ids at most. The manifest (part, seq, name, n_ids, base: ids of all files before)
    is a written table; a task that is run again leaves a file that it doesn't name.
    Null texts are empty; rows without doc_id come first, as NO_ID in the files. An empty
    table writes no file; other columns have no part. A worker keeps the ids of at most 2 * kept_words words (and those of one slice).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = path.rstrip("/") if path else scratch(spark, "tokens")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/data")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = width(Tokenizer.from_file(tokenizer).get_vocab_size())
    dealt = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    files = dealt.mapInArrow(_write(f"{folder}/data", tokenizer, end_id, bits, file_ids, block, kept_words), "part int, seq bigint, name string, n_ids bigint")
    with arrow_batches(spark, BATCH):
        files.write.parquet(f"{folder}/written")
    files = spark.read.schema("part int, seq bigint, name string, n_ids bigint").parquet(f"{folder}/written")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return folder, files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = manifest.select("name", "base").repartition(parts, "name")
    found = named.mapInPandas(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def token_output(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    folder, manifest = write_tokens(docs, tokenizer, end_id, **options)
    return read_tokens(docs.sparkSession, folder, manifest)
