"""SentencePiece vocabularies of the merge type: encoding by agendas, decoding.

A segment's symbols are its characters at first. An agenda holds its pairs of adjacent
symbols whose concatenation is a piece, ordered by the piece's score, then by place; the
first pair is merged, its neighbours' pairs are looked up anew, and so on until the agenda
is empty. Short segments go through together: a row of an array is a segment, and a round
merges the first pair of every row's agenda. Long ones have a heap each. What each gives is
compared with the sentencepiece library, an Arrow batch at a time.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import kept_columns, kept_in_worker, unpacked
from graphloom.llm.segments import cut_bytes, joined, segments, slices

#: Characters of a segment that goes through in arrays; segments of that many characters whose ids a worker keeps in each of two generations.
SHORT, KEPT = 48, 300_000
#: Rows of an array.
ROWS = 20_000
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


class Pieces:
    """A model file's pieces, the symbols that merging can give, and the pairs that merge.

    Only what this encoder follows exactly is taken: merge type, byte fallback, no
    normalisation but the white-space sign, and no user-defined or unused pieces.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only merge-type vocabularies with byte fallback")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only texts as they are, with the space sign in front")
        if kinds & {proto.ModelProto.SentencePiece.USER_DEFINED, proto.ModelProto.SentencePiece.UNUSED}:
            raise ValueError(f"{path}: user-defined and unused pieces aren't known here")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == proto.ModelProto.SentencePiece.NORMAL}
        scores = np.array([p.score for p in model.pieces])
        self.size, self.begin, self.end = len(model.pieces), self.library.bos_id(), self.library.eos_id()
        self.byte_ids = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        # Symbols: pieces by id, then characters of pieces that aren't pieces alone.
        self.symbols = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            self.symbols[c] = self.size + len(self.symbols) - len(normal)
        self.n_symbols = self.size + len(self.symbols) - len(normal)
        # Pairs of symbols that make a piece; equal scores have one rank, so that the place decides.
        ranks = np.unique(-scores, return_inverse=True)[1]
        pairs = sorted((self.symbols[p[:k]] * self.n_symbols + self.symbols[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols)
        self.pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([i for _, i in pairs] + [0], np.int64)
        self.ranks = np.append(ranks[self.merged[:-1]], _NONE).astype(np.int32)
        # Ids of symbols: a piece's own, or the bytes of a character that is none.
        others = sorted((s, c) for c, s in self.symbols.items() if s >= self.size)
        self.runs = [np.arange(self.size, dtype=np.uint32), *(self.byte_ids[list(c.encode())] for _, c in others)]
        self.run_sizes = np.array([1] * self.size + [len(c.encode()) for _, c in others], np.int64)
        self.of_char = np.full(0x110000, -1, np.int64)
        for c, s in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        self.cuts = cut_bytes(p.replace(SPACE, " ") for p in normal)
        # Bytes that an id stands for.
        known = {i: p.replace(SPACE, " ").encode() for p, i in normal.items()}
        known |= {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        known[self.library.unk_id()] = model.trainer_spec.unk_surface.encode()
        self.id_bytes = [known.get(i, b"") for i in range(self.size)]
        self.flat_bytes = np.frombuffer(b"".join(self.id_bytes), np.uint8)
        self.byte_sizes = np.array([len(x) for x in self.id_bytes], np.int64)
        self.is_byte = np.isin(np.arange(self.size), self.byte_ids)

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs and the symbols they merge into; _NONE for pairs that don't."""
        keys = left * self.n_symbols + right
        at = np.searchsorted(self.pairs, keys)
        hit = (self.pairs[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    # Agendas

    def _rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge every row of an array of symbols (-1: none that merges, -2: no symbol) by its agenda."""
        out, live, rows = symbols, np.arange(len(symbols)), symbols
        rank, into = self.found(rows[:, :-1], rows[:, 1:])
        while rank.shape[1]:
            first = rank.argmin(1)  # the leftmost of the best
            going = rank[np.arange(len(rank)), first] < _NONE
            if not going.all():
                out[live[~going], : rows.shape[1]] = rows[~going]
                out[live[~going], rows.shape[1] :] = -2
                live, rows, rank, into, first = live[going], rows[going], rank[going], into[going], first[going]
            if not len(live):
                return out
            r, width = np.arange(len(rows)), rows.shape[1] - 1
            # Close the gap that a merge leaves: a row is one symbol and one pair shorter.
            column = np.arange(width)[None, :]
            moved = np.take_along_axis(rows, column + (column > first[:, None]), 1)
            moved[r, first] = into[r, first]
            column = column[:, : width - 1]
            step = column + (column >= first[:, None])
            rank, into, rows = np.take_along_axis(rank, step, 1), np.take_along_axis(into, step, 1), moved
            for k, ok in ((first - 1, first > 0), (first, first < width - 1)):
                a, b = r[ok], k[ok]
                rank[a, b], into[a, b] = self.found(rows[a, b], rows[a, b + 1])
        out[live, : rows.shape[1]], out[live, rows.shape[1] :] = rows, -2
        return out

    def _long(self, symbols: list[int]) -> list[int]:
        """Merge one row of any length, with a heap as agenda."""
        n = len(symbols)
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], -3

        def pair(a: int, b: int) -> tuple[int, int] | None:
            if symbols[a] < 0 or symbols[b] < 0:
                return None
            return self._pair.get(symbols[a] * self.n_symbols + symbols[b])

        agenda = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pair(i, i + 1))]
        heapq.heapify(agenda)
        while agenda:
            _, a, left, right, into = heapq.heappop(agenda)
            b = after[a]
            if symbols[a] != left or b < 0 or symbols[b] != right:
                continue  # one of them has been merged since
            symbols[a], symbols[b] = into, gone
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y >= 0 and (p := pair(x, y)):
                    heapq.heappush(agenda, (p[0], x, symbols[x], symbols[y], p[1]))
        return [s for s in symbols if s != gone]

    @property
    def _pair(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.pairs[:-1].tolist(), zip(self.ranks[:-1].tolist(), self.merged[:-1].tolist(), strict=True), strict=True))
        return self._pairs

    def segment_ids(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after another, and how many each has. A segment begins with the space that stands for the sign, or is cut at `cuts`."""
        sizes = np.array([len(s) for s in some], np.int64)
        points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        symbols = self.of_char[points]
        # Characters of no piece merge with nothing; they are told apart again once merging is done.
        left, n = symbols.copy(), sizes.copy()
        lost = np.flatnonzero(symbols < 0)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 1]
        short = order[: np.searchsorted(sizes[order], SHORT, side="right")]
        for group in (short[i : i + ROWS] for i in range(0, len(short), ROWS)):
            wide = int(sizes[group[-1]])
            column = np.arange(wide)[None, :]
            inside = column < sizes[group][:, None]
            rows = np.where(inside, symbols[np.minimum(starts[group][:, None] + column, len(symbols) - 1)], -2)
            rows = self._rows(rows)
            n[group] = (rows != -2).sum(1)
            inside = column < n[group][:, None]
            left[(starts[group][:, None] + column)[inside]] = rows[inside]
        for i in order[len(short) :].tolist():
            row = self._long(symbols[starts[i] : starts[i] + sizes[i]].tolist())
            left[starts[i] : starts[i] + len(row)] = row
            n[i] = len(row)
        flat = joined_prefixes(left, starts, n)
        # Symbols to ids; the lost characters, in order, are the symbols still at -1.
        runs, run_sizes = self.runs, self.run_sizes
        if len(lost):
            kinds, which = np.unique(points[lost], return_inverse=True)
            raw = [chr(c).encode("utf-8") for c in kinds.tolist()]
            flat = flat.copy()
            flat[flat < 0] = self.n_symbols + which
            runs = [*runs, *(self.byte_ids[list(x)] for x in raw)]
            run_sizes = np.concatenate([run_sizes, [len(x) for x in raw]])
        ids, ends = joined(np.concatenate(runs), run_sizes, flat)
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(n)])])

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids have none, one space sign at the front goes, and byte ids that aren't UTF-8 become U+FFFD each."""
        return self.decode_many(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].decode()

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of runs of ids, which begin and end at bounds."""
        flat, ends = joined(self.flat_bytes, self.byte_sizes, ids)
        raw, ends = flat.tobytes(), ends[bounds].tolist()
        whole = True
        try:
            raw.decode()
        except UnicodeDecodeError:
            whole = False
        out = []
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            run = ids[bounds[k] : bounds[k + 1]]
            if not whole:
                out.append(self._decode_bytes(run))
                continue
            lead = raw[a : a + 1] == b" " and self._sign_first(run)
            out.append(raw[a + lead : b])
        return out

    def _sign_first(self, run: np.ndarray) -> bool:
        told = run[self.byte_sizes[run] > 0]
        return len(told) > 0 and not self.is_byte[told[0]] and told[0] != self.library.unk_id()

    def _decode_bytes(self, run: np.ndarray) -> bytes:
        out, held = [], b""
        for i in [*run.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                held += self.id_bytes[i]
                continue
            while held:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(held[:k].decode())
                        held = held[k:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    held = held[1:]
            if i >= 0:
                out.append(self.id_bytes[i].decode())
        text = "".join(out)
        return (text[1:] if text[:1] == " " and self._sign_first(run) else text).encode()


def joined_prefixes(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n values of each run, one after another."""
    ends = np.cumsum(n)
    return flat[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class PieceEncoder:
    """Ids of whole texts: distinct segments are merged once, checked with the library, and kept."""

    def __init__(self, path: str, check: str = "segments", kept: int = KEPT):
        if check not in ("segments", "texts", "none"):
            raise ValueError(f"check {check}: segments, texts or none")
        self.pieces, self.check, self.kept = Pieces(path), check, kept
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was kept before; a segment that is met again moves on

    def _compare(self, some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Raise if the library gives other ids: it puts the space sign in front, which a segment has already, or, cut at other white space, hasn't."""
        sign = self.pieces.symbols[SPACE]
        told = self.pieces.library.encode([s[1:] if s[:1] == " " else s for s in some], num_threads=1)
        theirs = [i for s, t in zip(some, told, strict=True) for i in ([sign] if s == " " else t if s[:1] == " " else t[1:])]
        if len(theirs) == len(ids) and (np.array(theirs, np.uint32) == ids).all():
            return
        for s, t, o in zip(some, told, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            if s != " " and (t if s[:1] == " " else t[1:]) != o.tolist():
                raise RuntimeError(f"segment {s[:80]!r}: {o.tolist()[:40]}, but the library gives {t[:40]}")

    def merged(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, checked, one after another, and how many each has."""
        ids, sizes = self.pieces.segment_ids(some)
        if self.check != "none":
            self._compare(some, ids, sizes)
        return ids, sizes

    def segment_ids(self, some: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each segment."""
        if len(self.known) > self.kept:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        if older:
            known.update([(s, older[s]) for s in some if s in older and s not in known])
        fresh = [s for s in some if s not in known]
        passing: dict[str, bytes] = {}
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            ids, sizes = self.merged(part)
            raw, ends = ids.tobytes(), np.concatenate([[0], 4 * np.cumsum(sizes)]).tolist()
            for s, a, b in zip(part, ends, ends[1:], strict=False):
                (known if len(s) <= SHORT else passing)[s] = raw[a:b]
        return [known[s] if s in known else passing[s] for s in some]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with the begin and end ids, one text after another, and where each begins and the last ends."""
        cut, n = segments(texts, self.pieces.cuts)
        coded = cut.dictionary_encode()
        raw = self.segment_ids(coded.dictionary.to_pylist())
        marks = np.array([self.pieces.begin, self.pieces.end], np.uint32)
        ids = np.frombuffer(b"".join([*raw, marks.tobytes()]), np.uint32)
        sizes = np.array([*(len(x) // 4 for x in raw), 1, 1], np.int64)
        # The order of segments, with the marks as two more of them around each text.
        order = coded.indices.to_numpy(zero_copy_only=False)
        at = np.cumsum(n + 2)
        runs = np.full(int(at[-1]) if len(at) else 0, len(raw), np.int64)
        runs[at - 1] = len(raw) + 1
        inner = np.ones(len(runs), bool)
        inner[at - 1] = inner[at - n - 2] = False
        runs[inner] = order
        flat, ends = joined(ids, sizes, runs)
        bounds = ends[np.concatenate([[0], at])]
        if self.check == "texts":
            told = self.pieces.library.encode([t or "" for t in texts.to_pylist()], num_threads=1, add_bos=True, add_eos=True)
            for k, t in enumerate(told):
                if flat[bounds[k] : bounds[k + 1]].tolist() != t:
                    raise RuntimeError(f"text {k} of a batch: the library gives other ids")
        return flat, bounds


@kept_in_worker
def encoder(path: str, check: str = "segments", kept: int = KEPT) -> PieceEncoder:
    """A worker's encoder: its segments outlive a task."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return PieceEncoder(path, check, kept)


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, check: str = "segments", kept: int = KEPT) -> DataFrame:
    """keep columns and ids (binary: little-endian unsigned 32-bit, with the begin and end ids) of each row's text; with `decoded`, also the text that the ids give back.

    model: a sentencepiece file of the merge type with byte fallback. The rows stay where
    they are: no shuffle, and a worker holds SLICE bytes of text (or one text) and at most
    2 * kept segments of SHORT characters. check: `segments` holds each distinct segment that
    a worker meets against the library, `texts` whole texts too, `none` nothing; a difference
    is an error.

    Null and empty texts have the begin and end ids alone, and decode to the empty text.
    Repeated rows are encoded each; equal texts have equal ids. An empty table gives no rows. A kept
    column named like an output gives way to it; other columns have no part.
    """
    outputs = ("ids", "decoded") if decoded else ("ids",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model, check, kept)
        for batch in batches:
            for some in slices(batch, 1):
                ids, bounds = code(some.column(1))
                raw, ends = ids.tobytes(), (4 * bounds).tolist()
                out = [pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())]
                if decoded:
                    out.append(pa.array(code.pieces.decode_many(ids.astype(np.int64), bounds), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([some.column(0), *out], names=["kept", *outputs])

    df = docs.select(kept_columns(keep, outputs), F.col("text").cast("string").alias("text"))
    kind = df.schema["kept"].dataType.simpleString()
    return df.mapInArrow(run, f"kept {kind}, ids binary{', decoded string' if decoded else ''}").select(*unpacked(keep, outputs), *outputs)


def decode(rows: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and decoded: the text of each row's ids, in the form that `encode` gives.

    Control ids stand for nothing, the unknown id for its sign; null ids give null. An id
    outside the vocabulary, or bytes that aren't whole ids, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model).pieces
        for batch in batches:
            for some in slices(batch, 1):
                raw = some.column(1).to_pylist()
                ids = np.frombuffer(b"".join(x or b"" for x in raw), "<u4").astype(np.int64)
                if len(ids) and ids.max() >= pieces.size:
                    raise ValueError(f"id {ids.max()} in a vocabulary of {pieces.size}")
                bounds = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in raw])])
                texts = [None if x is None else t for x, t in zip(raw, pieces.decode_many(ids, bounds), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["kept", "decoded"])

    df = rows.select(kept_columns(keep, ("decoded",)), "ids")
    kind = df.schema["kept"].dataType.simpleString()
    return df.mapInArrow(run, f"kept {kind}, decoded string").select(*unpacked(keep, ("decoded",)), "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what `encode` gives with `decoded`."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
