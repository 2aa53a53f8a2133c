"""The training-data operators against plain answers, and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser
from io import BytesIO
from pathlib import Path

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, decontaminate, html_extract, mixing, near_duplicates, quality_classifier, quality_rules, queries, sharding, suffix_dedup, token_counts, token_files

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string"


def rows(texts):
    return [(i, t, "en", "src0" if i % 3 else "src1", len(t or ""), 1, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out = [None, "", " \n\t", "Word", "word", prose(80)]
    base, passage = prose(120), prose(60)
    out += [base, base, base.upper()]
    for _ in range(12):
        words = base.split()
        words[rng.randrange(120)] = "new" + str(rng.random())
        out.append(" ".join(words))
    out += [prose(30) + " " + passage + " " + prose(30) for _ in range(4)] + ["ab" * 400, prose(5000), "x" * 199, "x" * 199, "line\nline\nline\n\n" + prose(9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.classes(docs, shingle_words=k).collect()}
    assert got == brute.near_components(dict(enumerate(texts)), k)


def test_near_duplicates_of_a_doc_id_with_two_texts(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(str(rng.random()) for _ in range(40)) for _ in range(4))
    table = [(1, c), (2, a), (3, b), (9, a), (9, b), (9, b + " x"), (4, c), (4, ""), (5, None), (6, d), (6, d), (7, "")]
    got = near_duplicates.classes(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 2), (4, 1), (4, 1), (5, 5), (6, 6), (6, 6), (7, 7), (9, 2), (9, 2), (9, 2)]
    assert sorted(r.n_shingles for r in got if r.doc_id in (4, 9)) == [0, 36, 36, 36, 37]


def test_sketches_miss_less_than_bands():
    most, n = near_duplicates._far_bits(80), near_duplicates.SKETCH_BITS
    sketch = sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(most + 1, n + 1))
    assert sketch < (1 - 0.8**near_duplicates.ROWS) ** near_duplicates.BANDS / 100


def test_representatives_keep_columns(docs, texts):
    kept = near_duplicates.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute.near_components(dict(enumerate(texts)), 5).items() if d == c}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys((3, 4, 5, 9), 3), 7: 7, 8: 7, **{100 + i: 100 for i in range(41)}}


def test_suffix_dedup(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


def test_suffix_runs_merge_in_order():
    rng = random.Random(2)
    runs = [sorted((b"k" * 8 + bytes(rng.choices(b"ab", k=rng.randint(0, 12))), bytes(rng.choices(b"cd", k=3)), [(bytes([r]) * 32, i)]) for i in range(rng.randint(0, 40))) for r in range(5)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.decode_run(suffix_dedup.encode_run(r)) for r in runs]))
    assert [(s, x) for _, s, x, _ in merged] == sorted((s, x) for r in runs for s, x, _ in r)
    for (_, a, _, _), (h, b, _, _) in zip(merged, merged[1:], strict=False):
        assert h == next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def test_decontamination(spark, docs, texts):
    bench = spark.createDataFrame([("b1", " ".join(texts[5].split()[7:30])), ("b2", "WORD"), ("b3", None), ("b4", "!!"), ("b1", " ".join(texts[5].split()[7:30]))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == len(texts) and got[0].n_words == 0 and not got[1].contaminated
    assert got[5].n_hit >= 23 and got[5]["items"] == ["b1"]
    assert got[3].n_hit == got[4].n_hit == 1 and got[3]["items"] == ["b2"]
    kept = decontaminate.KEPT_TABLES
    few = decontaminate.contamination(docs, bench, block_bytes=10).drop("spans").exceptAll(decontaminate.contamination(docs, bench).drop("spans"))
    assert few.isEmpty()
    many = spark.createDataFrame([(f"m{i}", " ".join(texts[5].split()[i : i + 12])) for i in range(12)], "item_id string, text string")
    n = many.agg(F.sum(F.octet_length("text"))).first()[0]
    one, blocks = (decontaminate.contamination(docs, many, block_bytes=b) for b in (n, n // (kept + 3)))
    assert one.exceptAll(blocks).isEmpty() and blocks.exceptAll(one).isEmpty() and one.where("contaminated").count() > 0
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() and decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_wu_manber_finds_all():
    rng = random.Random(4)
    for _ in range(200):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(40)]
        patterns = {tuple(rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 5))) for _ in range(6)}
        want = sorted((i, p) for p in patterns for i in range(41 - len(p)) if tuple(text[i : i + len(p)]) == p)
        assert sorted(decontaminate.WuManber(patterns).find(text)) == want


def test_quality_rules(docs, texts):
    got = {r.doc_id: r for r in quality_rules.with_rules(docs).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    for d, t in enumerate(texts):
        w = (t or "").split()
        grams = list(zip(w, w[1:], w[2:], strict=False))
        assert got[d].n_words == len(w) and got[d].word_chars == sum(map(len, w))
        assert got[d].n_repeat_words == len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}) if len(w) < 500 else True
    assert got[len(texts) - 1].n_dup_lines == 2


def test_sharding(docs, texts):
    got = sharding.shard_by_bytes(docs).collect()
    sizes = [0] * 16
    for shard in range(16):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.doc_id for r in mine] == sorted(r.doc_id for r in mine)
        sizes[shard] = sum(r.size for r in mine)
    assert len(got) == len(texts)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 1 for r in got)


def test_classifier(spark):
    good, bad = "the cat and the dog of a house in it", "BUY## NOW$$ CHEAP%% DEAL&& WIN** FREE##"
    data = [(i, f"{good if i % 4 else bad} x{i} {i}") for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = docs.where("doc_id < 400").select("doc_id", F.expr("if(doc_id % 4 = 0, 0, 1)").alias("quality"))
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in got if r.doc_id < 400)
    assert quality_classifier.classify(docs, labels.limit(0)).count() == 402


def test_token_counts(spark, docs, texts):
    counter = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    whole = lambda t: len(counter.encoding.encode_ordinary(t))
    rng = random.Random(9)
    for round_ in range(400):
        text = "".join(rng.choices(["a", " ", "\n", "'", "re", "ll", "12", ".", "é", "   ", "word "], k=rng.choice([rng.randint(0, 60), rng.randint(0, 900)])))
        d = token_counts.DocumentCount(text, counter)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 3, 9, 200])), "".join(rng.choices(["b", " ", "'", "s", "\n\n", "x y "], k=rng.choice([0, 1, 4, 300 if round_ % 40 == 0 else 2])))
            d.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert d.text == text and d.n_tokens == whole(text)
            assert [t for leaf in d.leaves for t in leaf] == counter.pattern.findall(text)
            again = token_counts.DocumentCount(text, counter, d.pack())
            assert again.n_tokens == d.n_tokens
    edits = spark.createDataFrame([(5, 1, 0, 4, "mail me"), (5, 2, 0, 0, "x@y.zz "), (6, 1, 0, 10**6, "far"), (6, 2, 0, 2, "ok"), (7, 1, None, 2, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq int, start int, end int, new string")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, edits).collect()}
    assert got[5].n_edits == 2 and got[5].n_tokens_edited == whole("x@y.zz mail me" + texts[5][4:]) and got[5].error is None
    assert got[6].n_edits == 1 and got[6].n_tokens_edited == whole("ok" + texts[6][2:]) and got[6].error.startswith("0: edit 0:1000000")
    assert got[7].n_edits == 0 and got[7].n_tokens_edited == got[7].n_tokens == whole(texts[7]) and "without" in got[7].error
    assert got[0].n_tokens == 0 and len(got) == len(texts)


def test_token_counts_of_the_registered_query(spark, tmp_path, texts):
    """Redactions of whole texts, against encoding both texts whole."""
    counter = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    whole = lambda t: len(counter.encoding.encode_ordinary(t))
    mixed = [*texts, "Call +1 (663) 555-6869 or a.b@c.example.org, +44 20 7946 0958.", "x@y.zz" * 3, " ".join(f"p{i}@q{i}.org and 555 010{i % 10} 77 {i}" for i in range(400))]
    spark.createDataFrame(rows(mixed), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    kinds = dict(token_counts.REDACTED)
    either = "|".join(f"(?:{p})" for p in kinds.values())
    for i, t in enumerate(mixed):
        names = re.findall(either, t or "")
        redacted = re.sub(either, lambda m: "<EMAIL>" if "@" in m.group() else "<PHONE>", t or "")
        assert (got[i].n_tokens, got[i].n_edits, got[i].n_tokens_edited, got[i].error) == (whole(t or ""), len(names), whole(redacted), None), i


def test_kept_trees(spark):
    counter = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    long = "some words, and more of them. " * 3000
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, "short", "z")], "doc_id long, text string, error string")
    call = lambda d, e, **o: token_counts.token_counts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, e, **o)
    first = spark.createDataFrame([(1, 1, 500, 510, "X")], "doc_id long, seq int, start int, end int, new string")
    kept = call(docs, first, keep=("doc_id", "error"), state=True).withColumnsRenamed({"text_edited": "text"})
    assert kept.columns == ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted", "error", "text", "tree"]
    second = spark.createDataFrame([(1, 1, 80000, 80001, "Y"), (2, 1, 0, 0, "new")], first.schema)
    got = {r.doc_id: r for r in call(kept, second, tree="tree", state=True).collect()}
    now = long[:500] + "X" + long[510:]
    assert got[1].n_tokens == len(counter.encoding.encode_ordinary(now)) and got[1].text_edited == now[:80000] + "Y" + now[80001:]
    assert got[1].n_tokens_edited == len(counter.encoding.encode_ordinary(got[1].text_edited)) and got[1].n_recounted < 20
    assert got[2].text_edited == "new" and got[2].n_tokens_edited == 1 and got[3].n_edits == 0 and got[3].error is None
    wrong = call(kept.withColumn("text", F.concat("text", F.lit("!"))), second, tree="tree").where("doc_id = 1").first()
    assert wrong.error.startswith("a tree of") and wrong.n_edits == 1


def test_classifier_in_columns_and_numpy(spark):
    """The compiled score equals the rules in numpy; rows that were held out are ranked by label."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]

    def text(good):
        n = rng.randint(20, 120)
        words = rng.choices(vocabulary if good or rng.random() < 0.3 else vocabulary[:12], k=n)
        words = [w if good or rng.random() < 0.7 else w.upper() + rng.choice("#$%!") for w in words]
        return " ".join(["the of and to a in is that"] * (rng.randint(1, 3) if good else rng.randint(0, 1)) + words)

    label = {i: int(rng.random() < 0.6) for i in range(700)}
    docs = spark.createDataFrame([(i, text(y)) for i, y in label.items()] + [(700, None), (701, " \n"), (702, "|" * 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if rng.random() > 0.05 else 1 - y) for i, y in label.items()], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    assert model.rules
    names = list(quality_classifier.STATISTICS)
    stats = {r.doc_id: np.array([[float(r[n]) for n in names]]) for r in quality_classifier.with_statistics(docs).collect()}
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    for i, x in stats.items():
        held = quality_classifier._holds([rule for rule, _ in model.rules], x, names)[0]
        z = model.intercept + sum(w for (_, w), h in zip(model.rules, held, strict=True) if h)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), i
    for i in (0, 5, 700, 701):  # statistics against plain ones
        t = dict((r.doc_id, r.text) for r in docs.where(f"doc_id = {i}").collect())[i] or ""
        w = t.split()
        assert stats[i][0][names.index("words")] == len(w) and stats[i][0][names.index("distinct")] == pytest.approx(len(set(w)) / max(1, len(w)))
        assert stats[i][0][names.index("capitals")] == pytest.approx(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) / max(1, len(t)))
    out = [i for i in label if got[i].held_out]
    good, bad = ([got[i].score for i in out if label[i] == y] for y in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    learnt = {i for i in label if zlib.crc32(str(i).encode()) % 5}  # labels of held out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin([i for i in label if i not in learnt]), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, flipped) == model


def test_kept_columns_named_like_outputs(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "k", "t")], "doc_id long, text string, n_words int, _t string, _w string")
    keep = ("doc_id", "n_words", "_t", "_w")
    assert quality_rules.with_rules(docs, keep=keep).first().asDict()["n_words"] == 2 and quality_rules.with_rules(docs, keep=keep).columns[:3] == ["doc_id", "_t", "_w"]
    assert quality_classifier.with_statistics(docs, keep).first()["words"] == 2 and decontaminate.contamination(docs, docs.selectExpr("'b' AS item_id", "text"), keep=keep).first()["n_words"] == 2
    page = docs.selectExpr("'<p>Hi</p>' AS html", "'u' AS text", "1 AS page_id")
    assert html_extract.extract(page, keep=("page_id", "text", "html")).first().asDict() == {"page_id": 1, "html": "<p>Hi</p>", "text": "Hi", "n_chars": 2}


def test_html():
    page = "<html><head><title>T</title><script>var a='</p><p>no';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head&amp;line</h1><p>One  <b>two</b>\nthree<br>four<p>Er.</p><div id=comments>Me too</div></article><footer>&copy;</footer>"
    assert html_extract.main_text(page) == "Head&line\n\nOne two three four\n\nEr."
    plain = "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div>" + "<p>" + "A long line of running text. " * 5 + "<p>And more of it here, at some length.</div><footer>End</footer>"
    assert html_extract.main_text(plain).startswith("A long line") and html_extract.main_text(plain).endswith("length.")
    assert [html_extract.main_text(x) for x in (None, "", "<p", "<!-- x", "<script>a")] == [""] * 5


def test_html_layout_classes():
    body = "<p>" + "A long line of running text. " * 5 + "</p><p>Its end.</p>"
    text = ("A long line of running text. " * 5).strip() + "\n\nIts end."
    for tag in ("div class='layout has-sidebar'", "div class='post no-comments'", "div id='content-widget'", "form action=x", "div class=widget"):
        page = f"<body><{tag}><article>{body}</article><div class='site-footer'>Buy</div><div class=sidebar>Links</div></{tag.split()[0]}></body>"
        assert html_extract.main_text(page) == text, tag
        assert html_extract.main_text(page.replace("article>", "div>")) == text, tag
    # Still boilerplate: beside an article, hidden, or with text outside
    for tag in ("div class='post-comments'", "div class=comments", "aside", "form", "div hidden", "div class='ad-slot'"):
        for around in ("<article>{}</article>", "<div>{}</div>"):
            assert html_extract.main_text(f"{around.format(body)}<{tag}><p>{'Noise and more noise. ' * 20}</p></{tag.split()[0]}>") == text, tag


def test_html_short_pieces_beside_boilerplate():
    long, share, ad = "A long line of running text. " * 5, "<div class=share>Share</div>", "<div class=ad>Buy</div>"
    want = f"Title\n\n{long.strip()}\n\nShort closing line."
    article = f"<h1>{{}}</h1>{share}<p>{long}</p>{ad}<p>Short closing line.</p>"
    menu = "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><span>Site name</span></div>"
    for title in ("Title", "<a href=x>Title</a>"):
        for page in (f"<div>{article}</div>", f"<body>{article}</body>", f"<body>{menu}{share}<div>{article}</div>{ad}<div><p>Other</p></div></body>"):
            assert html_extract.main_text(page.format(title)) == want, page
    between = f"<div><p>{long}</p></div>{ad}<div>Between.</div>{ad}<div><p>{long}</p></div>"
    assert html_extract.main_text(between) == f"{long.strip()}\n\nBetween.\n\n{long.strip()}"


def test_html_articles_beside_the_text():
    long = ("A long line of running text. " * 5).strip()
    body = f"<div><p>{long}</p><p>{long}</p><p>Its end.</p></div>"
    want = f"{long}\n\n{long}\n\nIts end."
    comments = "<div><article class='comment'><p>I liked this very much.</p></article></div>" * 3
    assert html_extract.main_text(body + comments) == want
    # Cards have no name of boilerplate: the text stays whole
    assert html_extract.main_text(body + "<div class=ad>Buy</div>" + "<div><article class='card'><h2>Another story</h2><p>Short.</p></article></div>" * 3).startswith(want)
    # The article still confines where it is the strongest, or where nothing else surges
    for article in (f"<article>{body}</article>", f"<main><article class='post'>{body}</article></main>"):
        assert html_extract.main_text(f"<div><p>{long}</p></div>{article}<div>Else</div>") == want
    assert html_extract.main_text("<div>Some words</div><article><p>Short.</p></article>") == "Short."


class _Article(HTMLParser):
    """The text of a simple page by another way: everything but what its elements say is none of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.out = [""], 0

    def handle_starttag(self, tag, attrs):
        off = tag in ("head", "nav", "footer", "script", "style", "aside", "form") or tag == "div" and dict(attrs).get("class") in ("ad", "comments")
        if self.out:
            self.out += tag not in ("br", "meta", "img", "p", "li")  # these may be left open
        elif off:
            self.out = 1
        elif tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "a", "em", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.out:
            self.out -= tag not in ("br", "p", "li")
        elif tag not in ("b", "i", "a", "em", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if not self.out:
            self.blocks[-1] += data


def _by_parser(html):
    parser = _Article()
    parser.feed(html or "")
    return "\n\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


def test_html_pages_against_a_parser():
    """Whole pages, as they are and without elements that say where the article is."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdeéñß", k=rng.randint(2, 9))) for _ in range(80)]
    prose = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randint(a, b))).capitalize() + "."
    for k in range(60):
        menu = "".join(f"<li><a href=/{i}>{prose(1, 2)}</a></li>" for i in range(rng.randint(2, 8)))
        parts = [f"<h1>{prose(3, 9)}</h1>"]
        for i in range(rng.randint(2, 7)):
            parts.append(f"<p>{prose(25, 60)}<br>&amp; <i>{prose(2, 5)}</i></p>" if i % 3 else f"<p>{prose(30, 70)}")
            if rng.random() < 0.2:
                parts.append(f"<div class=ad>{prose(3, 8)}</div>")
        page = f"<html><head><title>{prose(3, 6)}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><div class=ad>{prose(4, 9)}</div><article>{''.join(parts)}</article><!-- x --><footer>&copy; {prose(4, 9)}</footer><script>var a='<p>';</script></body></html>"
        want = _by_parser(page)
        for other in (page, page.replace("article>", "main>"), page.replace("article>", "div>"), page.replace("<article>", "<section id=story>").replace("</article>", "</section>")):
            assert html_extract.main_text(other) == want, (k, other)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_html_given_pages(size):
    """All pages of the given tables: as a parser reads them, and the same without article elements."""
    import pyarrow.parquet as pq

    path = Path("/root/testdata") / size / "pages.parquet"
    if not path.exists():
        pytest.skip("no given tables here")
    for html in pq.read_table(path).column("html").to_pylist():
        text = html_extract.main_text(html)
        assert text == _by_parser(html) and text
        assert html_extract.main_text(re.sub("(</?)(article|main)\\b", "\\1div", html)) == text


def test_html_whole_articles_of_odd_names():
    long = ("A long line of running text. " * 5).strip()
    body, want = f"<h1>Head</h1><p>{long}</p><p>{long}</p><p>Its end.</p>", f"Head\n\n{long}\n\n{long}\n\nIts end."
    for open_, close in (("<div class='social-science-article'>", "</div>"), ("<article class='social-science-article'>", "</article>"), ("<div class='post related-post'>", "</div>"), ("<form id=aspnetForm action=x><div>", "</div></form>"), ("<main>", "</main>")):
        assert html_extract.main_text(f"<body>{open_}{body}{close}</body>") == want, open_


def test_html_quoted_angle_brackets():
    tags = ("<div data-t=\"a > b\">", "<div data-t='a > b' id=x>", "<div data-t='<b>c</b>'>", "<div title=\"never closed>", "<div title='it\"s > \"' >")
    for tag in tags:
        page = f"<div id=page><article><p>First.</p>{tag}Second.</div><p>Rest.</p></article></div><p>Else \"quoted\".</p>"
        assert html_extract.main_text(page) == "First.\n\nSecond.\n\nRest.", tag
    assert html_extract.main_text("<article><p class=\"a>One.</p><p class=\"b\">Two.</p></article>") == "One.\n\nTwo."
    assert html_extract.main_text("<article><p>One.</p><div class='ad' data-t='a > b'>Buy</div><p>Two.</p></article>") == "One.\n\nTwo."
    assert len(html_extract.main_text("<p title=\"" * 20000 + "x")) < 300000  # in linear time


def test_token_files(docs, texts):
    got = sorted(token_files.token_output(docs, P.path("word_bpe_49k.json"), 2, file_ids=50, block=7).collect())
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_in_pieces():
    import pyarrow as pa
    from tokenizers import Tokenizer

    words = ["Hello,", "HELLO", "it's", "don't!", "'", "...", "a1,", "x-y.", "Straße!", "İstanbul.", "naïve", "日本語。", "Δ,,", "ªb)", "ǅ:", "\u200b,", "e\u0301.", "[SEP]", "🙂!", "a" * 5000 + "!?"]
    given = [*words, " ".join(words), "\t".join(reversed(words)), "", None, " \x0b\x0c ", "a\x1cb\x85c\u00a0d.", *(a + b for a in words for b in words)]
    encode, tokenizer = token_files.WordEncoder(P.path("word_bpe_49k.json"), 5), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for _ in range(3):  # words are kept, moved on and forgotten
        for kind in (pa.string(), pa.large_string()):
            got = encode(pa.array(given, kind))
            for g, t in zip(got, given, strict=True):
                assert g.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert [x.tolist() for x in encode(pa.array([None, ""], pa.string()))] == [[], []] and encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 2**bits, n).astype(np.uint32) for n in (0, 5, 100, 1)]
    f = token_files.TokenFile(BytesIO(token_files.encode_file([4, 5, 6, 7], ids, bits, block=16)))
    assert all((a[2] == b).all() for a, b in zip(f.documents(), ids, strict=True))
    assert (f.ids(20, 50) == np.concatenate(ids)[20:50]).all()


def test_mixing(docs, texts):
    got = mixing.mix(docs, max_repeats=1.5, block_tokens=100).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.n_tokens
    whole = {}
    for i, t in enumerate(texts):
        s = "src0" if i % 3 else "src1"
        whole[s] = whole.get(s, 0) + len((t or "").split()) + 1
    assert all(whole[s] <= by[s] <= 1.5 * whole[s] for s in whole)
    for b in {r.block for r in got}:
        assert sorted(r.position for r in got if r.block == b) == list(range(1, 1 + sum(r.block == b for r in got)))
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_repeated_rows_and_names(spark):
    table = [(1, "a b", "s", 1), (1, "a b", "s", 2), (2, "c d", "s", 3), (None, "e", None, 4), (None, None, None, 5)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, `_copy` int")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("at", "row", "drawn", "times", "_n", "_doc", "_source", "_key", "_bucket")])
    for options in ({"max_repeats": 1.0}, {"max_repeats": 3.0}):
        drawn = mixing.mix(docs, **options)
        got = mixing.mixed_documents(docs, **options)
        assert got.columns == docs.columns and got.count() == drawn.count()
        assert {r["_copy"] for r in got.collect()} == {1, 2, 3, 4, 5}
    assert mixing.mixed_documents(docs, max_repeats=1.0).count() == 5


def test_mixing_by_entropy_and_budget(spark):
    docs = spark.createDataFrame([(i, "w " * 9, "abc"[min(2, i // 40)]) for i in range(120 + 200)], "doc_id long, text string, source string")
    share = lambda rows: {s: sum(r.n_tokens for r in rows if r.source == s) / sum(r.n_tokens for r in rows) for s in "abc"}
    got = mixing.mix(docs, max_repeats=None, entropy=math.log(3) - 1e-6, budget_tokens=1200).collect()
    assert sum(r.n_tokens for r in got) <= 1200 and all(abs(x - 1 / 3) < 0.02 for x in share(got).values())
    weights = {r.source: r.weight for r in got}
    assert sum(weights.values()) == pytest.approx(1) and -sum(w * math.log(w) for w in weights.values()) >= math.log(3) - 1e-6
    low = mixing.mix(docs, max_repeats=None, entropy=0.1).collect()  # less than the corpus has: shares stay
    assert {r.source: round(r.weight, 6) for r in low} == {"a": 0.125, "b": 0.125, "c": 0.75}
    twice = mixing.mix(docs, max_repeats=2.0, budget_tokens=6400, block_tokens=500).collect()
    assert all(sum(r.n_tokens for r in twice if r.source == s) <= r_weight * 6400 + 1e-6 for s, r_weight in {r.source: r.weight for r in twice}.items())
    assert {r.block for r in twice} == set(range(13)) and max(sum(r.n_tokens for r in twice if r.block == b) for b in range(13)) <= 500 + 30
    with pytest.raises(ValueError):
        mixing.mix(docs, max_repeats=None, entropy=1.0, budget_tokens=10**9)
    with pytest.raises(ValueError):
        mixing.mix(docs, max_repeats=None)


def test_rows_without_doc_id_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    table = [(None, long), (None, long), (None, None), (3, long), (3, long), (7, long + " more"), (8, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string").select("*", F.lit(1).alias("size"), F.lit("x").alias("key"))
    got = [tuple(r) for r in near_duplicates.classes(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, 56, None), (None, 56, None), (None, 0, None), (3, 56, 3), (3, 56, 3), (7, 57, 3), (8, 0, 8)], key=repr)
    assert near_duplicates.representatives(docs).count() == 6
    rows = token_files.token_output(docs, P.path("word_bpe_49k.json"), 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, None, 3, 3, 7, 8] and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    cut = suffix_dedup.remove_repeats(docs).collect()
    assert len(cut) == 7 and sum(r.n_bytes == r.n_removed for r in cut if r.n_bytes) == 4
    assert sharding.shard_by_bytes(docs).count() == 7 and sorted(r.slot for r in sharding.shard_by_bytes(docs, 1).collect()) == list(range(7))
    assert quality_rules.with_rules(docs).count() == 7 and decontaminate.contamination(docs, docs.selectExpr("'b' AS item_id", "text")).count() == 7
    assert token_counts.token_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 7


def test_near_copies_of_a_hub(spark):
    """Many near copies of one text, copies of copies that are too far from it, and texts that share much but too little."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(120):
        words = base[:]
        for _ in range(rng.choice([1, 2, 14, 16, 18])):
            words[rng.randrange(150)] = f"n{rng.random()}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.classes(docs, shingle_words=k).collect()}
        assert got == brute.near_components(texts, k)


def test_empty_tables(none):
    assert near_duplicates.classes(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert sharding.shard_by_bytes(none).count() == 0
    assert quality_classifier.classify(none, none.selectExpr("doc_id", "size AS quality")).count() == 0 and quality_classifier.accepted(none, none.selectExpr("doc_id", "size AS quality")).count() == 0
    assert html_extract.extract(none.selectExpr("doc_id AS page_id", "text AS url", "text AS html")).count() == 0
    assert mixing.mixed_documents(none).count() == 0 and near_duplicates.representatives(none).count() == 0 and components.components(none.selectExpr("doc_id AS u", "doc_id AS v")).count() == 0
    assert quality_rules.with_rules(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert token_files.token_output(none, P.path("word_bpe_49k.json"), 2).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_suffix_ranges_of_many_small_runs(monkeypatch):
    """Copies told by runs, by the merge and by other contexts, in one process."""
    monkeypatch.setattr(suffix_dedup, "RUN", 9)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4)
    rng = random.Random(8)
    passage = bytes(rng.choices(b"abc", k=700))
    noise = lambda n: bytes(rng.choices(b"xyz", k=n))
    texts = [noise(rng.randint(0, 90)) + passage[rng.randint(0, 150) : rng.randint(380, 700)] + noise(rng.randint(0, 90)) for _ in range(25)]
    texts += [passage + passage[:300], b"q" * 900, noise(500)]
    places = [suffix_dedup.anchors(t)[0].tolist() for t in texts]
    digests = [bytes([i]) * 32 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["digest", "text", "places"])
    frame = pd.concat(b.to_pandas() for b in suffix_dedup._runs(5)(iter([batch])))
    spans = {d: [] for d in digests}
    for _, part in frame.groupby("part"):
        for r in suffix_dedup._merge(part).itertuples():
            spans[r.digest].append((r.start, r.end))
    got = [sum(e - s for s, e in suffix_dedup.union(spans[d])) for d in digests]
    assert got == [n for _, n, _, _ in brute.repeats([t.decode() for t in texts])]


def test_texts_beyond_a_segment_and_a_block(spark):
    rng = random.Random(14)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, at = noise(500), suffix_dedup.SEGMENT - 250
    texts = [noise(at) + passage + noise(20_000), noise(30) + passage, noise(suffix_dedup.SEGMENT + 300) + passage[:260]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows_ = sorted(token_files.token_output(docs, P.path("word_bpe_49k.json"), 2).collect())
    assert max(r.n_tokens for r in rows_) > token_files.BLOCK
    for r, t in zip(rows_, texts, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_of_repeated_rows_and_ties(spark):
    table = [(1, "same")] * 40 + [(None, "same")] * 5 + [(2, None)] * 20 + [(3, "x" * 2000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(table, "doc_id long, text string").repartition(4), 4).collect()
    assert len(got) == 66 and sorted((r.doc_id or 0) for r in got) == sorted((d or 0) for d, _ in table)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    order = [r.doc_id or 0 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order) and all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_mixing_ties(spark):
    docs = spark.createDataFrame([(i, "w", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    first, again = ([tuple(r) for r in mixing.mix(d, block_tokens=20).orderBy("block", "position").collect()] for d in (docs, docs.repartition(7)))
    assert first == again and len({r[0] for r in first}) == 60


def test_suffix_runs_of_a_short_period(monkeypatch):
    """Long runs have few anchors and lose no byte, alone, side by side, cut by segments and found in other texts."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    texts = [
        noise(50) + "x" * 900 + noise(60),
        noise(300) + "x" * 200 + noise(30),  # found in the run alone
        noise(300) + "x" * 199 + noise(30),
        "ab" * 700 + noise(20) + "ba" * 130,
        noise(20) + "a" + "ba" * 100 + noise(70),
        "xyz" * 500 + "x" * 700 + "xyz" * 80,
        ("0123456789" * 4)[:31] * 40 + noise(9),
        ("0123456789" * 4)[:31] * 6 + "0123456789" * 3,
        "q" * 337,
        "w" * 200,
        "x" * 3000 + "y" + "x" * 3000,
    ]
    monkeypatch.setattr(suffix_dedup, "LONG", 0)
    monkeypatch.setattr(suffix_dedup, "RUN", 25)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 512)
    suffix_dedup._powers.clear()
    raw = [t.encode() for t in texts]
    digests = [hashlib.sha256(b).digest() for b in raw]
    places = [suffix_dedup.anchors(b)[0].tolist() for b in raw]
    batch = pa.RecordBatch.from_arrays([pa.array(digests), pa.array(texts), pa.array(places, pa.list_(pa.int32()))], names=["digest", "text", "places"])
    frame = pd.concat(b.to_pandas() for b in suffix_dedup._runs(3)(iter([batch])))
    spans = {d: [] for d in digests}
    for _, part in frame.groupby("part"):
        for r in suffix_dedup._merge(part).itertuples():
            spans[r.digest].append((r.start, r.end))
    got = [(sum(e - s for s, e in suffix_dedup.union(spans[d])), len(suffix_dedup.union(spans[d]))) for d in digests]
    suffix_dedup._powers.clear()
    assert got == [r[1:3] for r in brute.repeats(texts)]


def test_suffix_anchors_of_one_byte():
    """A million equal bytes have a few thousand anchors; their span is told by the text alone."""
    text = b"=" * 1_000_000
    places, _ = suffix_dedup.anchors(text)
    assert len(places) < 3000
    batch = pa.RecordBatch.from_arrays([pa.array([b"d" * 32]), pa.array([text.decode()]), pa.array([places.tolist()], pa.list_(pa.int32()))], names=["digest", "text", "places"])
    frame = pd.concat(b.to_pandas() for b in suffix_dedup._runs(2)(iter([batch])))
    assert [x for r in frame["spans"].dropna() for x in r] == [0, 1_000_000]


def test_html_tags_without_a_start():
    """Tags that close or end nothing cost the same however deep they stand."""
    deep, body = "<b>" * 20_000, "<p>" + "Words of an article that go on for a while. " * 9 + "</p>"
    began = time.process_time()
    html_extract._tree(deep + "</i>" * 20_000 + "<p><div>" + deep + "<p></p>" * 20_000 + body)
    assert time.process_time() - began < 5
