"""The pipeline's stages on a small table, each held against a plain answer."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from graphloom.llm import decontaminate, mixing  # noqa: E402


def test_stages(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = {i: "the cat and the dog of a house in it " + " ".join(rng.choices(words, k=30)) if i % 4 else f"BUY## NOW$$ CHEAP%% DEAL&& WIN** FREE## x{i}" for i in range(240)}
    texts |= {241: texts[1], 242: texts[2].upper(), 243: texts[3] + " end"}
    passage = " ".join(texts[5].split()[12:38])
    texts |= {245: "the cat and a dog of the house in it " + passage + " and the rest of it"}
    source = {i: "small" if i % 5 < 2 else "large" for i in texts}
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    put([(i, t, "en", source[i], len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int", "labels")
    put([("b", passage)], "item_id string, text string", "benchmark")

    got, columns, write = [], [], corpus_pipeline.materialize

    def seen(df, tag):
        out = write(df, tag)
        got.append(Counter(r.doc_id for r in out.select("doc_id").collect()))
        columns.append(out.columns)
        return out

    monkeypatch.setattr(corpus_pipeline, "materialize", seen)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert columns[:4] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4 and result.count() == sum(got[4].values())

    good = [i for i in texts if not texts[i].startswith("BUY")]
    assert got[0] == Counter(good)
    kept = [d for d, (_, c) in brute.near_components({i: texts[i] for i in good}, 5).items() if d == c]
    assert got[1] == Counter(kept) and not {241, 242, 243} & set(kept)
    item = passage.lower().split()
    windows = [f" {' '.join(item[i : i + decontaminate.WINDOW])} " for i in range(len(item) - decontaminate.WINDOW + 1)]
    clean = [i for i in kept if not any(w in f" {texts[i].lower()} " for w in windows)]
    assert got[2] == Counter(clean) and not {5, 245} & set(clean)
    size = {i: len(texts[i].split()) + 1 for i in clean}
    whole = Counter()
    for i in clean:
        whole[source[i]] += size[i]
    most = whole["large"] / whole["small"]
    assert 1 < most < 2  # so the exponent goes to 0, and the small source's quota to the large one's tokens
    quota = int(whole["small"] * most ** (1 - 2.0**-mixing.STEPS))
    mixed = Counter(clean)
    at = whole["small"]
    for i in sorted((i for i in clean if source[i] == "small"), key=lambda i: hashlib.md5(f"{mixing.SEED}:1:{i}".encode()).hexdigest()):
        at += size[i]
        mixed[i] += at <= quota
    assert got[3] == mixed and max(mixed.values()) == 2
    assert got[4] == mixed


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    put([], "doc_id long, quality int, toxic int", "labels")
    put([(None, "a b"), ("x", None)], "item_id string, text string", "benchmark")
    text = " ".join(f"word{i}" for i in range(40))
    odd = [(None, None, None, None, None), (None, None, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, 1), (3, "", "en", "s", 0), (4, " \n ", "en", "s", 0), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(odd, schema)
    for c in ("row", "kept", "at", "score", "n_words", "words", "_t", "_kept", "drawn", "times", "component_id", "part"):
        docs = docs.withColumn(c, docs["n_chars"])
    names = docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "odd")
        ids.append(Counter(r.doc_id for r in docs.collect()))
        assert name == "token output" or docs.columns == names
    whole = Counter([None] * 3 + [1, 1, 2, 3, 4])
    assert ids[0] == whole  # without labels all have one score
    assert ids[1] == ids[2] == Counter([None] * 3 + [1, 1, 3, 4])
    assert ids[3] >= ids[2] and ids[4] == ids[3]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
