"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised: alpha 1 keeps
the shares, alpha 0 makes all sources equal. The exponent is bisected to the least
that keeps every source within a repetition limit, or to the greatest that reaches
an entropy. Each source then contributes its token quota: whole epochs, every one in
an order of its own, and of the last as many documents as the quota pays for. The
sources' streams advance together through blocks, and each block is permuted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

MAX_REPEATS, BLOCK_TOKENS, SEED = 2.0, 1_000_000, 7
#: Times that a budget or an entropy may repeat a source.
MAX_EPOCHS = 10_000
#: Bisection: steps, and steps that one job looks ahead.
STEPS, AHEAD = 20, 4
#: Documents of a source whose running sum one task takes, at least; more where a source has more than their square.
BUCKET_ROWS = 250


def _bisect(totals: DataFrame, all_tokens: int, max_tokens: int, max_repeats: float | None, entropy: float | None) -> float:
    """Alpha in [0, 1], a multiple of 2 ** -STEPS."""

    def measure(alphas: list[float]) -> list[float]:
        if entropy is None:  # the repetitions of the smallest source against the largest's
            columns = [F.max(F.pow(F.lit(float(max_tokens)) / F.col("_tokens"), F.lit(1 - a))) for a in alphas]
        else:  # of w = p^a / Z: log Z - a * sum(p^a log p) / Z
            p = F.col("_tokens") / F.lit(float(all_tokens))
            columns = [F.log(F.sum(F.pow(p, F.lit(a)))) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / F.sum(F.pow(p, F.lit(a))) for a in alphas]
        return list(totals.agg(*[c.alias(f"m{i}") for i, c in enumerate(columns)]).first())

    lo, hi = 0.0, 1.0  # repetitions: hi holds; entropy: lo is the best there is
    for _ in range(STEPS // AHEAD):
        n = 2**AHEAD
        inner = [lo + (hi - lo) * k / n for k in range(1, n)]
        holds = dict(zip(inner, measure(inner), strict=True))
        for _ in range(AHEAD):
            mid = (lo + hi) / 2
            if entropy is None:
                lo, hi = (lo, mid) if holds[mid] <= max_repeats else (mid, hi)
            else:
                lo, hi = (mid, hi) if holds[mid] >= entropy else (lo, mid)
    return hi if entropy is None else lo


def _base(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(rows(doc_id, source, text, at) without texts, with token counts; whether a doc_id is repeated), computed once."""
    n_tokens = F.expr("cast(regexp_count(coalesce(text, ''), '[^ \\\\t-\\\\r]+') + 1 as bigint)")
    base = materialize(rows.select("doc_id", "source", n_tokens.alias("n_tokens"), "at"), "mix")
    return base, not base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _mix(base: DataFrame, repeated: bool, max_repeats: float | None, entropy: float | None, budget_tokens: int | None, block_tokens: int, seed: int) -> DataFrame:
    """The columns of mix, and at, for rows of _base."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    if max_repeats is not None and max_repeats < 1:
        raise ValueError("max_repeats is 1 at least")
    totals = materialize(base.groupBy("source").agg(F.sum("n_tokens").alias("_tokens"), F.count("*").alias("_rows")), "mix")
    all_tokens, max_tokens, max_rows, least = totals.agg(F.sum("_tokens"), F.max("_tokens"), F.max("_rows"), F.min("_tokens")).first()
    columns = ["doc_id", "source", "n_tokens", "epoch", "block", "position", "weight", "at"]
    if not all_tokens:
        return base.limit(0).selectExpr("doc_id", "source", "n_tokens", "0 AS epoch", "0L AS block", "0 AS position", "0D AS weight", "at")
    alpha = 1.0 if least == max_tokens and entropy is None else _bisect(totals, all_tokens, max_tokens, max_repeats, entropy)
    powers = totals.agg(F.sum(F.pow(F.col("_tokens") / F.lit(float(all_tokens)), F.lit(alpha)))).first()[0]
    weight = F.pow(F.col("_tokens") / F.lit(float(all_tokens)), F.lit(alpha)) / F.lit(powers)
    if budget_tokens is None:
        quota = F.floor(F.col("_tokens") * F.pow(F.lit(float(max_tokens)) / F.col("_tokens"), F.lit(1 - alpha)))
    else:
        quota = F.floor(weight * F.lit(float(budget_tokens)))
    # a bucket's rows, and a source's buckets, stay near the root of its rows
    buckets = F.expr(f"cast(ceil(_rows / {max(BUCKET_ROWS, math.isqrt(max_rows))}) as bigint)")
    quotas = totals.select(F.col("source").alias("_source"), "_tokens", weight.alias("weight"), quota.cast("long").alias("_quota"), buckets.alias("_buckets"))
    total, epochs = quotas.agg(F.sum("_quota"), F.max(F.expr("(_quota - 1) div _tokens + 1"))).first()
    if epochs > MAX_EPOCHS:
        raise ValueError(f"a source would be repeated {epochs} times, more than {MAX_EPOCHS}: lower budget_tokens or entropy")
    n_blocks = max(1, -(-total // block_tokens))
    apart = ["at"] if repeated else []  # else rows of one doc_id would all be in one bucket
    copies = (
        base.join(quotas, F.col("source").eqNullSafe(F.col("_source")))
        .where("_quota > 0")
        .withColumn("epoch", F.explode(F.expr("sequence(0, cast((_quota - 1) div _tokens as int))")))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id", *apart)))
        .withColumn("_bucket", F.expr(f"cast(conv(substr(_key, 1, 8), 16, 10) as bigint) * _buckets div {1 << 32}"))
    )
    sums = copies.groupBy("source", "epoch", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    offsets = sums.select(  # `_buckets` rows for each source and epoch
        F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("_bucket").alias("_b"), F.expr("coalesce(sum(_sum) OVER (PARTITION BY source, epoch ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("_offset")
    )
    inside = F.expr("sum(n_tokens) OVER (PARTITION BY source, epoch, _bucket ORDER BY _key, n_tokens, at ROWS UNBOUNDED PRECEDING)")
    placed = (
        copies.withColumn("_inside", inside)
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_end", F.expr("epoch * _tokens + _offset + _inside"))
        .where("_end <= _quota")
        .withColumn("block", F.expr(f"cast(least({n_blocks - 1}, floor((_end - n_tokens) / _quota * {n_blocks})) as bigint)"))
    )
    return placed.withColumn("position", F.expr("row_number() OVER (PARTITION BY block ORDER BY _key, n_tokens, source, at)")).select(*columns)


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixture's copies: doc_id, source, n_tokens, epoch, block, position, weight.

    docs(doc_id, text, source). n_tokens is the words between ASCII white space plus an
    end token, so that no document is free. Without budget_tokens the source that
    is repeated least (the largest) is taken once, hence all documents at least once
    and none more than ceil(max_repeats) times. With it, weight times budget is each
    source's quota. A quota is never exceeded; a mixture that would repeat a source more
    than MAX_EPOCHS times is a ValueError. A null source is a source of its own;
    null and empty texts count one token; an empty table mixes to no rows. Rows that
    share a doc_id (null ones too) are documents each, told apart by their place in the
    input; ties in the order are broken by it. Other columns, whatever their names, have
    no part. Texts stay in the scan; a source's running sums are taken in buckets of the
    permutation, whatever its share of the rows.
    """
    base, repeated = _base(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("at")))
    return _mix(base, repeated, max_repeats, entropy, budget_tokens, block_tokens, seed).drop("at")


def mixed_documents(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixture as rows of docs, each as often as it was drawn; columns as they were, whatever their names.

    Rows are drawn one by one: of rows that share a doc_id, or are equal, each has copies
    of its own. They are then numbered in a written table; with unique doc_ids the rows
    are only read. Nulls, empty texts and empty tables are as in mix.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text", F.monotonically_increasing_id().alias("at"))
    base, repeated = _base(packed)
    key = "at" if repeated else "doc_id"
    if repeated:
        packed = materialize(packed, "mix")
        base, _ = _base(packed)
    drawn = _mix(base, repeated, max_repeats, entropy, budget_tokens, block_tokens, seed).groupBy(F.col(key).alias("drawn")).agg(F.count("*").alias("times"))
    out = packed.select("row", key).join(drawn, F.col(key).eqNullSafe(F.col("drawn")))
    return out.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
t AS MATERIALIZED (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
k AS (SELECT CAST(max(tokens) AS DOUBLE) / CAST(min(tokens) AS DOUBLE) AS most FROM t),
b AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
      UNION ALL
      SELECT step + 1, CASE WHEN pow(most, 1 - (lo + hi) / 2) <= {MAX_REPEATS} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(most, 1 - (lo + hi) / 2) <= {MAX_REPEATS} THEN (lo + hi) / 2 ELSE hi END
      FROM b, k WHERE step < {STEPS}),
a AS (SELECT CASE WHEN most = 1 THEN 1 ELSE hi END AS alpha FROM b, k WHERE step = {STEPS}),
w AS (SELECT source, tokens, pow(tokens / CAST(sum(tokens) OVER () AS DOUBLE), alpha) AS p,
      CAST(floor(tokens * pow(CAST(max(tokens) OVER () AS DOUBLE) / tokens, 1 - alpha)) AS BIGINT) AS quota FROM t, a),
q AS (SELECT source, tokens, quota, p / sum(p) OVER () AS weight, CAST(ceil(CAST(sum(quota) OVER () AS DOUBLE) / {BLOCK_TOKENS}) AS BIGINT) AS blocks FROM w),
e AS (SELECT d.*, tokens, quota, weight, blocks, unnest(range(0, (quota - 1) // tokens + 1)) AS epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT *, md5('{SEED}:' || epoch || coalesce(':' || doc_id, '')) AS key FROM e),
c AS (SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) AS e FROM h),
l AS (SELECT *, CAST(least(blocks - 1, floor(CAST(e - n_tokens AS DOUBLE) / quota * blocks)) AS BIGINT) AS block FROM c WHERE e <= quota)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, CAST(row_number() OVER (PARTITION BY block ORDER BY key, n_tokens, source) AS INTEGER) AS position, round(weight, 9) AS weight FROM l
"""
