"""Merge-type SentencePiece vocabularies held against the library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from graphloom.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*" \n\t\r  aetsnodheil.,;:!()'\"<>▁é漢字🙂　 \xa0\x85\x1c\x00ﬁ", "the", "  ", "tion", "<s>", "</s>", "<unk>", "<0x0A>", "▁▁", "\r\n", ");\r", "한국", "é"]


def odd_texts(n: int) -> list[str | None]:
    r = random.Random(11)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 2, 5, 20, 100, 400]))) for _ in range(n)]
    return [*made, None, "", " ", "  ", "▁", "\n", "a" * 5_000, "the" * 2_000, " " * 3_000, "字" * 1_000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_cuts_are_looked_up():
    assert pieces.cut_bytes(["the", "  x", "a\tb", "\n\n"]) == b" \n"
    assert pieces.cut_bytes(["a b"]) == b"\n\t"


def test_ids_and_texts_equal_the_library(library):
    code, texts = pieces.PieceEncoder(MODEL, kept=500), odd_texts(1_500)
    for i in range(0, len(texts), 250):
        some = texts[i : i + 250]
        ids, bounds = code(pa.array(some, pa.string()))
        own = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        assert own == [library.encode(t or "", add_bos=True, add_eos=True) for t in some]
        assert [x.decode() for x in code.pieces.decode_many(ids.astype(np.int64), bounds)] == library.decode(own)


def test_long_and_short_agendas_agree(monkeypatch):
    p, texts = pieces.Pieces(MODEL), [" " + t.replace("▁", " ") for t in odd_texts(300) if t and t.isprintable()]
    want = [x.tolist() for x in p.segment_ids(texts)]
    monkeypatch.setattr(pieces, "SHORT", 1)  # every segment has a heap
    assert [x.tolist() for x in p.segment_ids(texts)] == want


def test_any_ids_decode_as_the_library_does(library):
    p, r = pieces.Pieces(MODEL), random.Random(5)
    for _ in range(2_000):
        ids = [r.choice([r.randrange(32_000), r.randrange(3, 259), 0, 1, 2]) for _ in range(r.randrange(9))]
        assert p.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_a_wrong_segment_is_an_error():
    code = pieces.PieceEncoder(MODEL)
    code.pieces.ranks = code.pieces.ranks[::-1].copy()
    with pytest.raises(RuntimeError, match="library"):
        code(pa.array(["internationally standardised"], pa.string()))


def test_query_and_odd_rows(spark, library, tmp_path):
    texts = odd_texts(60)
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_sentencepiece"](spark, str(tmp_path)).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((repr(None if i == 3 else i // 2), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    both = pieces.encode(docs, MODEL, keep=("doc_id", "text", "ids"), decoded=True, check="texts")
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and dict(both.dtypes)["ids"] == "binary"
    again = pieces.decode(both.withColumnRenamed("decoded", "was"), MODEL, keep=("was",))
    assert again.where("NOT was <=> decoded").count() == 0 and again.count() == len(texts)
    assert pieces.encode(docs.where("false"), MODEL).count() == 0
