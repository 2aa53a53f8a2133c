"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Small trees over text statistics are grown on labelled rows; each path from a root is
a rule, a conjunction of thresholds. A lasso logistic fit gives most rules the weight
zero. The others become one Spark expression, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import kept_columns, unpacked
from graphloom.llm.quality_rules import _BLANK, STOP_WORDS

#: Labelled rows that a fit uses at most (those whose id hashes are least).
SAMPLE = 20_000
TREES, DEPTH, BINS, SEED = 40, 3, 32, 11
PENALTIES = (0.03, 0.01, 0.003, 0.001)
CUT = 0.3

_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
#: Statistics of a text _t with words _w and lines _l.
STATISTICS = {
    "words": "cast(size(_w) as double)",
    "word_length": "length(array_join(_w, '')) / greatest(1, size(_w))",
    "symbols": "regexp_count(_t, '[#*$%&<>]') / greatest(1, size(_w))",
    "bars": "regexp_count(_t, '[|]') / greatest(1, size(_w))",
    "bangs": "regexp_count(_t, '[!?]') / greatest(1, size(_w))",
    "capitals": "regexp_count(_t, '[A-Z]') / greatest(1, length(_t))",
    "digits": "regexp_count(_t, '[0-9]') / greatest(1, length(_t))",
    "stops": f"size(filter(_w, w -> lower(w) IN ({_STOP}))) / greatest(1, size(_w))",
    "distinct": "size(array_distinct(_w)) / greatest(1, size(_w))",
    "repeated_lines": "(size(_l) - size(array_distinct(_l))) / greatest(1, size(_l))",
    "line_words": "size(_w) / greatest(1, size(_l))",
}

_OUTPUTS = ("score", "predicted", *STATISTICS)

Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, from the statistics' columns."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, op, at in rule:
                holds = holds & ((F.col(name) <= F.lit(at)) if op == "<=" else (F.col(name) > F.lit(at)))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and the STATISTICS of each row of docs(text, ...).

    Null and empty texts have no words and lines: all their statistics are 0. A kept column
    named like a statistic, a score or a prediction gives way to it; other columns have no part.
    """
    df = docs.select(kept_columns(keep, _OUTPUTS), F.expr("coalesce(text, '')").alias("_t"))
    df = df.withColumn("_w", F.expr("filter(split(_t, '[ \\\\t-\\\\r]+'), w -> w != '')"))
    df = df.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), l -> trim(BOTH {_BLANK} FROM l) != '')"))
    return df.select(*unpacked(keep, _OUTPUTS), *[F.expr(e).alias(n) for n, e in STATISTICS.items()])


def _grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, hessian: np.ndarray, names: list[str], rng: np.random.Generator) -> list[Rule]:
    """Rules of one tree: every node but the root is a path. Gains are of a second-order fit."""
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        if len(path) == DEPTH or len(rows) < 20:
            return
        g, h = target[rows], hessian[rows]
        whole = g.sum() ** 2 / (h.sum() + 1)
        best = (1e-6, None, None)
        for f in rng.permutation(len(names))[: max(3, 2 * len(names) // 3)]:
            at = np.searchsorted(cuts[f], x[rows, f], side="left")
            gs = np.bincount(at, g, len(cuts[f]) + 1).cumsum()[:-1]
            hs = np.bincount(at, h, len(cuts[f]) + 1).cumsum()[:-1]
            ns = np.bincount(at, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < 5) | (ns > len(rows) - 5)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, cuts[f][gain.argmax()])
        if best[1] is not None:
            left = x[rows, best[1]] <= best[2]
            split(rows[left], (*path, (names[best[1]], "<=", float(best[2]))))
            split(rows[~left], (*path, (names[best[1]], ">", float(best[2]))))

    split(rng.choice(len(x), min(len(x), max(200, len(x) // 2)), replace=False), ())
    return rules


def _holds(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for name, op, at in rule:
            v = x[:, names.index(name)]
            out[:, j] &= (v <= at) if op == "<=" else (v > at)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression under an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    mean, scale = r.mean(axis=0), np.maximum(r.std(axis=0), 0.02)
    z = (r - mean) / scale
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y) / n
        w2 = v - step * (z.T @ e)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = c - step * e.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / scale
    return float(b - w @ mean), w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """An ensemble for statistics x and labels y (0 or 1), in memory.

    Without rows, or with one label only, it has no rules, and its score is the label's share
    (one of each is added). Equal rows and ties weigh as often as they are there.
    """
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.round(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"), 6)) for f in range(len(names))]
    for f in range(len(names)):  # the rare class needs cuts where it lives
        rare = x[y == (y.mean() < 0.5), f]
        cuts[f] = np.unique(np.concatenate([cuts[f], np.round(np.quantile(rare, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"), 6)]))
    rules: dict[Rule, None] = {}
    z = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grown = _grow(x, cuts, y - p, p * (1 - p), names, rng)
        rules.update(dict.fromkeys(grown))
        inner = {r[:k] for r in grown for k in range(1, len(r))}
        leaves = [r for r in grown if r not in inner]
        for rule, at in zip(leaves, _holds(leaves, x, names).T, strict=True):
            z[at] += 0.3 * (y - p)[at].sum() / ((p * (1 - p))[at].sum() + 1)
    held = _holds(list(rules), x, names)
    # rules that hold for the same rows, or for all others, are one
    _, first = np.unique(np.packbits(held ^ held[:1], axis=0), axis=1, return_index=True)
    chosen = [list(rules)[j] for j in sorted(first)]
    r = _holds(chosen, x, names).astype(float)
    test = np.arange(len(y)) % 4 == 0

    def loss(penalty: float) -> float:
        b, w = _lasso(r[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(r[test] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    b, w = _lasso(r, y, min(PENALTIES, key=loss))
    return RuleEnsemble(b, tuple((rule, float(v)) for rule, v in zip(chosen, w, strict=True) if abs(v) > 1e-3))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Learn `label` from labels(doc_id, label), without the rows that are held out.

    Held out are rows whose CRC-32 of the doc_id as text is a multiple of 5. Statistics
    are computed for `sample` labelled rows at most, those whose id hashes are least. Labels
    that are null, or of no document or a null doc_id, teach nothing; a doc_id with several
    labels or rows counts with each pair of them.
    """
    order = [F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.col("doc_id"), F.col("_y")]
    known = labels.select("doc_id", F.col(label).cast("double").alias("_y")).where("_y IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    known = known.orderBy(*order).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `sample` rows at most
    rows = with_statistics(rows, keep=("doc_id", "_y")).orderBy(*order, *STATISTICS).limit(sample).collect()
    names = list(STATISTICS)
    x = np.array([[float(r[n]) for n in names] for r in rows]).reshape(-1, len(names))
    return fit_rules(x, np.array([float(r["_y"]) for r in rows]), names)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: RuleEnsemble, cut: float = CUT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, score and predicted for each row of docs(text, ...): one projection.

    Null and empty texts have the statistics of a text without words, and a score.
    Equal texts get equal scores; no other column has a part in them. A kept column named
    like an output or a statistic gives way to it; an empty table gives no rows.
    """
    scored = with_statistics(docs, keep).select(*[F.col(f"`{c}`") for c in keep if c not in _OUTPUTS], model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows, score all: doc_id, held_out, score, predicted. A null doc_id is not held out."""
    model = fit(docs, labels, **options)
    return score(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier predicts to be of label 1, columns as they were, whatever their names.

    Null and empty texts are judged like others; rows with equal texts stay or go together;
    an empty table stays empty. Without labels all have one score, and stay.
    """
    model = fit(docs, labels, **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return score(packed, model, keep=("row",)).where("predicted = 1").select("row.*")
