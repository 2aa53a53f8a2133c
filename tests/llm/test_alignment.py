"""Alignment of two vocabularies held against whole texts and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from graphloom.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*" \n\t\r  aetsnodheil.,;:!()'\"<>é漢字🙂　 \xa0\x85\x1c\x00ﬁ’…", "the ", "  ", "tion", "<s>", "<|endoftext|>", "don't ", "\r\n", ");\r", "한국", "é", " ’ ", " 12345 "]


def tokens(text: str | None):
    """The ids and ends of both sides over ' ' + text, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a, tokens.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        tokens.a.encode_special_tokens = True
        signs = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        signs |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in signs)}
        tokens.bytes_a = {i: bytes(signs[c] for c in t) for t, i in tokens.a.get_vocab(with_added_tokens=False).items()}
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    bytes_a = [tokens.bytes_a[i] for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if tokens.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tokens.b.id_to_piece(i)]]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None

    def ends(parts: list[bytes]) -> list[int]:
        out = [0]
        for x in parts:
            out.append(out[-1] + len(x))
        return out[1:]

    return a, ends(bytes_a), b, ends(bytes_b)


def plain(texts: list[str | None]) -> list[tuple]:
    groups, held = [], Counter()
    for text in texts:
        found, made = tokens(text), []
        if found:
            a, ends_a, b, ends_b = found
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = i, j
                while i < len(a) and ends_a[i] <= end:
                    i += 1
                while j < len(b) and ends_b[j] <= end:
                    j += 1
                made.append((a[x:i], b[y:j]))
        groups.append(made)
        held.update({(p, q) for x, y in made for p in x for q in y})
    best: dict[int, int] = {}
    for (p, _), n in held.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for made in groups:
        links = [(p, q) for x, y in made for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made)
        sha = hashlib.sha256(text.encode()).hexdigest() if made else ""
        out.append((sum(len(x) for x, _ in made), sum(len(y) for _, y in made), len(made), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), sha))
    return out


def odd_texts(n: int) -> list[str | None]:
    r = random.Random(12)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 2, 5, 20, 100, 300]))) for _ in range(n)]
    return [*made, *made[:20], None, "", " ", "  ", "▁", "a ▁ b", "\n", "a" * 2_000, "the" * 1_000, " " * 1_500, "字" * 500]


@pytest.mark.parametrize("sizes", [(2_000, 50), (30_000, 200), None])
def test_query_equals_plain_loops(spark, tmp_path, monkeypatch, sizes):
    """Small blocks meet in many buckets; and a run of a thousand equal letters is one group."""
    if sizes:
        whole = token_alignment.align
        monkeypatch.setattr(token_alignment, "align", lambda *a: whole(*a, block=sizes[0], some=sizes[1], buckets=7))
    texts = odd_texts(250)
    docs = spark.createDataFrame([(None if i == 3 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(repr(r[0]), *r[1:]) for r in queries.QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()}
    assert got == {(repr(None if i == 3 else i), *x) for i, x in enumerate(plain(texts))}


def test_kept_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y")], "doc_id long, text string, n_a string")
    out = token_alignment.align(docs, A, B, keep=("doc_id", "text", "n_a"))
    assert out.columns == ["doc_id", "text", *token_alignment._OUTPUTS]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", *x) for x in plain(["a b", "a b"])]
    assert token_alignment.align(docs.where("false"), A, B).count() == 0


def test_both_vocabularies_are_looked_at():
    aligner = token_alignment.Aligner(A, B)
    assert aligner.cuts == b" \n\t"
