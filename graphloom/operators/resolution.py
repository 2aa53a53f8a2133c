"""Entity resolution: keys, candidates, gates and merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import likeness
from graphloom.operators.lineage import cut

# Gates on a fact's confidence; candidate threshold and count; premiums for equal birth dates and nationalities.
ACCEPTED, REVIEW = 0.85, 0.50
CANDIDATE, CANDIDATES = 0.5, 5
BIRTH, NATION = 0.07, 0.03
# What merges two records and what a person should look at; the same of a cascade, and the confidence that a judge needs.
MERGE_RECORD, REVIEW_RECORD = 0.92, 0.70
AUTO, NEAR, JUDGED = 0.93, 0.75, 0.7
#: Names of a block that one part of the comparison holds.
BLOCK_ROWS = 5_000
#: The similarity from which on names may meet by an index, and how many pairs as arrays cost as much as one that it brings together.
INDEXED, ROW_COST = 0.85, 64
#: What str.split takes for blanks, too: the words that are compared are the ones that are put in order.
BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def confidence_gate(confidence: Column) -> Column:
    return F.when(confidence >= ACCEPTED, "accepted").when(confidence >= REVIEW, "in_review").otherwise("rejected")


def sorted_words(name: Column) -> Column:
    """What token-sort similarity compares: a name's words in lower case, in order."""
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower(name), BLANKS, " ")), " ")), " ")


def _with(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def _in_parts(x: DataFrame, y: DataFrame, block_rows: int, compare: Callable, schema: str) -> DataFrame:
    """compare(key, left, right) for each pair of parts of about block_rows rows of x(block, ..) and y(block, ..), all pairs of a block in one of them."""
    parts = lambda df, name: df.groupBy(F.col("block").alias("block")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    n = parts(x, "_n").join(parts(y, "_m"), "block")
    meeting = ("block", "_p", "_q")
    deal = lambda df, mine, its, other, all_: df.join(n, "block").withColumn(mine, F.pmod(F.xxhash64(*df.columns), its).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_) - 1))).select(*meeting, *df.columns[1:])
    # Few bytes make much work here, so the number of tasks is told: some for each core, as each starts a worker's run.
    spark = x.sparkSession
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    a, b = (df.repartition(tasks, *meeting).groupBy(*meeting) for df in (deal(x, "_p", F.col("_n"), "_q", "_m"), deal(y, "_q", F.col("_m"), "_p", "_n")))
    return a.cogroup(b).applyInArrow(compare, schema)


def name_scores(left: DataFrame, right: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """block, x, y, score: the names of left(block, x) and right(block, y) whose token-sort similarity is `least` or more.

    Names meet by an index where that leaves few enough. Otherwise a block's distinct names are cut into parts
    of about block_rows on both sides, and each two parts are compared as arrays (see likeness.alike):
    however large a block, no task holds it.
    """
    x = left.select(F.col("block").alias("block"), sorted_words(F.col("x")).alias("x")).where("x <> ''").distinct()
    y = right.select(F.col("block").alias("block"), sorted_words(F.col("y")).alias("y")).where("y <> ''").distinct()
    scores = _indexed_scores(x, y, least)
    return scores if scores is not None else _in_parts(x, y, block_rows, likeness.all_alike(least), f"block {dict(x.dtypes)['block']}, x string, y string, score double")


def _indexed_scores(x: DataFrame, y: DataFrame, least: float) -> DataFrame | None:
    """name_scores of distinct x(block, x) and y(block, y) by their pieces, unless these are in so many names that arrays are quicker."""
    from graphloom.functions.records import token_sort_ratio

    if least < INDEXED:
        return None
    a, b = _pieces(x, y, least)
    many = lambda df, name, *of: df.groupBy(*(F.col(c).alias(c) for c in of)).agg(F.count("*").alias(name))
    product = F.sum(F.col("_n").cast("double") * F.col("_m")).alias("n")
    met, all_ = (many(p, "_n", *of).join(many(q, "_m", *of), [*of]).agg(product) for p, q, of in ((a, b, ("block", "g")), (x, y, ("block",))))
    met, all_ = (r["n"] or 0 for r in met.unionAll(all_).collect())
    if met * ROW_COST > all_:
        return None
    return name_candidates(x, y, least).select("block", "x", "y", token_sort_ratio("x", "y").alias("score")).where(F.col("score") >= least)


def _pieces(x: DataFrame, y: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(block, x, g of all that could be a piece of a name like x; block, y, g of y's pieces)."""
    r = least / (2 - least)
    size = lambda m: F.floor(m / (F.floor(2 * m * (1 - least) / least + 1e-9) + 1)).cast("int")
    n, m = F.length("x"), F.length("y")
    sizes = F.array_distinct(F.transform(F.sequence(F.ceil(n * r - 1e-9), F.floor(n / r + 1e-9)), size))
    a = x.select("block", "x", F.explode(sizes).alias("_q")).where(n >= F.col("_q"))
    a = a.select("block", "x", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("_q") + 1), lambda i: F.substring(F.col("x"), i, F.col("_q"))))).alias("g"))
    b = y.withColumn("_q", size(m))
    b = b.select("block", "y", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor(m / F.col("_q")) - 1), lambda i: F.substring(F.col("y"), (i * F.col("_q") + 1).cast("int"), F.col("_q"))))).alias("g"))
    return a, b


def name_candidates(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """block, x, y: a superset of the pairs of x(block, x) and y(block, y) with a similarity of `least` or more, far smaller than all pairs.

    Names of n and m letters that are so alike have L >= least * (n + m) / 2 of them in common, in order, and
    n is at most m * (2 - least) / least. So at most d = 2 * m * (1 - least) / least letters go or come between them. Each
    spoils one piece at most of y, cut into d + 1 pieces or more: one of them is in x as it is. Below INDEXED, where pieces are too short to
    tell names apart, the pairs are found by comparing.
    """
    if least < INDEXED:
        return name_scores(x, y, least).select("block", "x", "y")
    a, b = _pieces(x, y, least)
    n, m = F.length("x"), F.length("y")
    return a.join(b, ["block", "g"]).where(2 * F.least(n, m) >= F.lit(least) * (n + m) - 1e-9).select("block", "x", "y").distinct()


def fuzzy_candidates(mentions: DataFrame, registry: DataFrame, least: float = CANDIDATE, top: int = CANDIDATES, birth: float = BIRTH, nationality: float = NATION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """mention, id, score, rank: the top scored_candidates of each mention; equal scores rank by id.

    Mentions that are told alike are compared once, with the first `top` of the entities that are told alike, and each
    two parts of a type keep their best alone: pairs that come to nothing are never rows.
    """
    m, named, birth, nationality = _sides(mentions, registry, birth, nationality)
    asked = m.select(F.col("block").alias("block"), "x", "_b", "_c").distinct()
    same = Window.partitionBy("block", "y", "_b", "_c").orderBy("id")
    theirs = named.select(F.col("block").alias("block"), "y", "_b", "_c", "id").distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= top).drop("_n")
    kinds = dict(m.dtypes) | dict(named.dtypes)
    scores = _indexed_scores(asked.select(F.col("block").alias("block"), "x").distinct(), theirs.select(F.col("block").alias("block"), "y").distinct(), least - birth - nationality - 6e-5)
    found = _scored(asked, theirs, scores, least, birth, nationality) if scores is not None else _in_parts(asked, theirs, block_rows, likeness.best_alike(least, top, birth, nationality), f"block {kinds['block']}, x string, _b string, _c string, id {kinds['id']}, score double")
    order = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "id"))
    like = ("block", "x", "_b", "_c")
    found = found.groupBy(*like, "id").agg(F.max("score").alias("score")).withColumn("_n", order(*like)).where(F.col("_n") <= top).drop("_n")
    best = m.join(found, [*like]).groupBy("mention", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", order("mention")).where(F.col("rank") <= top)


def _sides(mentions: DataFrame, registry: DataFrame, birth: float, nationality: float) -> tuple[DataFrame, DataFrame, float, float]:
    """(mention, block, x, _b, _c of mentions; id, block, y, _b, _c of all names of entities; the premiums that pairs can have)."""
    both = lambda c: c in mentions.columns and c in registry.columns
    birth, nationality = (p if both(c) else 0.0 for c, p in (("birth", birth), ("nationality", nationality)))
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("birth", "_b"), ("nationality", "_c"))]
    m = _with(mentions, birth="string", nationality="string").select("mention", F.col("type").alias("block"), sorted_words(F.col("name")).alias("x"), *told)
    r = _with(registry, birth="string", nationality="string", aliases="array<string>")
    named = r.select("id", F.col("type").alias("block"), *told, F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n"))
    return m.where("x <> ''"), named.select("id", "block", "_b", "_c", sorted_words(F.col("_n")).alias("y")).where("y <> ''"), birth, nationality


def scored_candidates(mentions: DataFrame, registry: DataFrame, least: float, birth: float = BIRTH, nationality: float = NATION) -> DataFrame:
    """mention, id, score: the entities of each mention's type that score `least` or more.

    mentions(mention, type, name) and registry(id, type, name; aliases), both with birth and
    nationality if known. The score is the best token-sort similarity to the name or an
    alias, with a premium for each of the two that is equal and known, at most 1.
    """
    m, named, birth, nationality = _sides(mentions, registry, birth, nationality)
    scores = name_scores(m.select("block", "x"), named.select("block", "y"), least - birth - nationality - 6e-5)
    return _scored(m, named, scores, least, birth, nationality).groupBy("mention", "id").agg(F.max("score").alias("score"))


def _scored(m: DataFrame, named: DataFrame, scores: DataFrame, least: float, birth: float, nationality: float) -> DataFrame:
    """m's columns, id, score: those of m and named (see _sides) whose names are in scores, with their premiums."""
    found = m.join(scores, ["block", "x"]).join(named.withColumnsRenamed({"_b": "_birth", "_c": "_nation"}), ["block", "y"])
    more = lambda a, b, c: F.when((F.col(a) != "") & (F.col(a) == F.col(b)), F.lit(c)).otherwise(F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), F.col("score") + more("_b", "_birth", birth) + more("_c", "_nation", nationality)), 4)
    return found.select(*m.columns, "id", score.alias("score")).where(F.col("score") >= least)


def resolve_records(records: DataFrame, existing: DataFrame) -> DataFrame:
    """record, action, id, score: merge into an entity, create, or leave to a review.

    records(record, label) and existing(id, label), both with passport_number, national_id,
    date_of_birth and nationality if known. An equal passport, else an equal national id, is
    a match for certain; then names decide with premiums for birth and nationality.
    """
    known = dict.fromkeys(("passport_number", "national_id", "date_of_birth", "nationality"), "string")
    r, e = _with(records, **known), _with(existing, **known)
    exact = None
    for order, column in enumerate(("passport_number", "national_id")):
        given = e.where(F.col(column) != "").groupBy(F.col(column).alias("_v")).agg(F.min("id").alias("id"))
        hit = r.join(given, F.col(column) == F.col("_v")).select("record", F.lit(order).alias("_o"), "id")
        exact = hit if exact is None else exact.unionByName(hit)
    exact = exact.groupBy("record").agg(F.min_by("id", "_o").alias("_exact"))
    # A premium that no pair can have would let all names be looked for that much further down.
    told = [F.col(c).alias(a) for c, a in (("date_of_birth", "birth"), ("nationality", "nationality")) if c in records.columns and c in existing.columns]
    named = lambda df, key: df.select(F.col(key).alias("mention" if key == "record" else "id"), F.lit("").alias("type"), F.coalesce("label", F.lit("")).alias("name"), *told)
    unsure = r.join(exact, "record", "left_anti")
    best = fuzzy_candidates(named(unsure, "record"), named(e, "id"), REVIEW_RECORD, 1, 0.10, 0.05).select(F.col("mention").alias("record"), "id", "score")
    found = r.select("record").join(exact, "record", "left").join(best, "record", "left")
    sure = F.col("_exact").isNotNull()
    action = F.when(sure | (F.col("score") >= MERGE_RECORD), "merge").when(F.col("score") >= REVIEW_RECORD, "review").otherwise("create")
    return found.select("record", action.alias("action"), F.when(sure, F.col("_exact")).when(F.col("score") >= MERGE_RECORD, F.col("id")).alias("id"), F.when(sure, F.lit(1.0)).otherwise(F.col("score")).alias("score"))


def cascade(mentions: DataFrame, registry: DataFrame, similar: DataFrame | None = None, adjudicate: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0) -> DataFrame:
    """mention, id, method, score: equal key, else a near-equal name, else what a judge confirms of the three best; the rest is new.

    mentions and registry as for fuzzy_candidates, with a key if known. similar(mention, id,
    score) are similarities of embeddings (see nearest); adjudicate takes (mention, id,
    score) and returns them with same and confidence. Without a judge, nothing near merges.
    Names below `least` are no candidates. Names decide from AUTO on, and a judge is asked about mentions whose best
    name, or some embedding, is NEAR: so only those mentions' names are looked for below that.
    """
    m, r = _with(mentions, key="string"), _with(registry, key="string")
    keyed = m.join(r.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")), "key").select("mention", "id", F.lit("deterministic").alias("method"), F.lit(1.0).alias("score"))
    open_ = m.join(keyed.select("mention"), "mention", "left_anti")
    if adjudicate is None:
        near = cut(fuzzy_candidates(open_, r, max(least, AUTO), 3))
    else:
        worth = fuzzy_candidates(open_, r, max(least, NEAR), 1).select("mention")
        if similar is not None:
            worth = worth.unionByName(similar.where(F.col("score") >= NEAR).select("mention"))
        near = cut(fuzzy_candidates(open_.join(worth.distinct(), "mention", "left_semi"), r, least, 3))
    first = near.where("rank = 1")
    done = keyed.unionByName(first.where(F.col("score") >= AUTO).select("mention", "id", F.lit("fuzzy").alias("method"), "score"))
    if adjudicate is not None:
        asked = near.join(first.where(F.col("score") < AUTO).select("mention", F.col("score").alias("_best")), "mention")
        if similar is not None:
            asked = asked.join(similar.select("mention", "id", F.col("score").alias("_s")), ["mention", "id"], "left")
        else:
            asked = asked.withColumn("_s", F.lit(None).cast("double"))
        asked = asked.select("mention", "id", "rank", F.greatest("_best", F.coalesce("_s", F.lit(0.0))).alias("score")).where(F.col("score") >= NEAR)
        said = adjudicate(asked.select("mention", "id", "score")).where("same").where(F.col("confidence") >= JUDGED).select("mention", "id", "confidence")
        yes = asked.join(said, ["mention", "id"]).groupBy("mention").agg(F.min_by(F.struct("id", F.greatest("score", "confidence").alias("score")), "rank").alias("_y"))
        done = done.unionByName(yes.select("mention", "_y.id", F.lit("embedding+llm").alias("method"), "_y.score"))
    new = m.join(done.select("mention"), "mention", "left_anti").select("mention", F.lit(None).cast(dict(r.dtypes)["id"]).alias("id"), F.lit("new").alias("method"), F.lit(1.0).alias("score"))
    return done.unionByName(new)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by order."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*")


def shared_identifier_pairs(holders: DataFrame, max_fanout: int) -> DataFrame:
    """holders(connector, tag, person): RELATED_TO proposals between all holders of an identifier with at most max_fanout of them.

    wide_identifier_members has the holders of the others.
    """
    from graphloom.operators.projection import shared_reasons

    pairs = shared_reasons(holders, max_fanout).join(holders.select("connector", "tag").distinct(), "connector")
    return pairs.select("p1", "p2", F.concat(F.lit("shares_"), F.lower("tag")).alias("label"), F.lit(0.65).alias("confidence")).distinct()


def wide_identifier_members(holders: DataFrame, max_fanout: int) -> DataFrame:
    """connector, label, representative, person: every holder of an identifier with more than max_fanout of them.

    The representative is the least holder. Any two rows of a connector and label are a
    pair that shared_identifier_pairs leaves out; rows grow with the holders.
    """
    h = holders.select("connector", "tag", "person").distinct()
    wide = h.groupBy("connector").agg(F.countDistinct("person").alias("n"), F.min("person").alias("representative")).where(F.col("n") > max_fanout)
    return h.join(wide, "connector").select("connector", F.concat(F.lit("shares_"), F.lower("tag")).alias("label"), "representative", "person").distinct()


#: Pivots of a vector join, and rows that meet a block of queries in one task.
PIVOTS, SLICE_ROWS = 32, 50_000


def nearest(queries: DataFrame, rows: DataFrame, top: int, block: int = 2048, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query, id, score, rank: the top cosine neighbours of queries(id, vector) among rows(id, vector), themselves left out.

    At most `block` queries go to the rows, which stay where they are: one pass, a matrix product
    an Arrow batch. More of them meet the rows in the shuffle (`_nearest_by_cells`), whatever their number.
    Vectors without length score 0; null ones are left out. Equal scores rank by id. Vectors of
    both sides have one length; ids of each side are distinct.
    """
    spark = rows.sparkSession
    asked = queries.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    vectors = rows.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["id"]
    few = asked.limit(block + 1).collect()
    if not few:
        return spark.createDataFrame([], f"query {kind}, id {kind}, score double, rank int")
    if len(few) <= block:
        found = vectors.mapInArrow(_top_rows([r.id for r in few], np.array([r.vector for r in few]), top), f"query {kind}, id {kind}, score double")
    else:
        found = _nearest_by_cells(asked, vectors, top, block, slice_rows, kind)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _nearest_by_cells(asked: DataFrame, vectors: DataFrame, top: int, block: int, slice_rows: int, kind: str) -> DataFrame:
    """Candidates (query, id, score) of each query, its top among them, in a plan of fixed size.

    Both sides belong to the nearest of PIVOTS rows (those of the least id hashes). What a cell of queries
    needs is bounded by distances between unit vectors: its `top` neighbours are no further than some
    rows that are known by their distance to their pivot, so a row goes to that cell only if the triangle through both
    pivots lets it be as near. Cells of many queries are cut into blocks, cells of many rows into slices; a task
    holds one block and a batch of rows. Only the pivots and, for each cell, its size, radius and least distances pass the driver.
    """
    spark = vectors.sparkSession
    pivots = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vector").collect()
    if not pivots:
        return spark.createDataFrame([], f"query {kind}, id {kind}, score double")
    p = _unit(np.array([r.vector for r in pivots]))
    p = p[p.any(1)] if p.any() else p[:1]
    asked = cut(asked.mapInArrow(_cells(p), f"id {kind}, vector array<double>, cell int, far double"))
    theirs = cut(vectors.mapInArrow(_cells(p), f"id {kind}, vector array<double>, cell int, far double"))
    cells = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    # The least distances of each cell: a batch's first, then the first of those. One more, as a query may be among the rows.
    some = theirs.where(F.col("cell") < len(p)).select("cell", "far").mapInArrow(_least(top + 1), "cell int, far double")
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("k") <= top + 1)
    least = [(r.cell, r.far) for r in ranked.select("cell", "far").collect()]
    total = theirs.count()
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    reach, blocks = {}, {}
    for r in cells:
        blocks[r.cell] = -(-r.n // block)
        if r.cell == len(p):  # without length: all rows are alike to them
            reach[r.cell] = [-1.0] * (len(p) + 1)
            continue
        bounds = sorted(r.radius + between[r.cell, j] + d for j, d in least)
        bound = bounds[top] if len(bounds) > top else 4.0
        reach[r.cell] = [*(between[r.cell] - r.radius - bound - 1e-6).tolist(), -1.0]  # a row of cell j goes there if it is that far from its pivot
    slices = max(1, -(-total // slice_rows))
    cell, deal = F.col("cell"), F.xxhash64("id")
    count = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    q = asked.select(cell, F.pmod(deal, count[cell]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("side"), "id", "vector")
    limits = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(n).alias("n"), F.array(*[F.lit(float(x)) for x in reach[i]]).alias("least")) for i, n in blocks.items()])
    goes = F.filter(limits, lambda c: F.col("far") >= c["least"][F.col("cell")])
    each = F.flatten(F.transform(goes, lambda c: F.transform(F.sequence(F.lit(0), c["n"] - 1), lambda b: F.struct(c["cell"].alias("cell"), b.alias("block")))))
    r = theirs.select(F.explode(each).alias("to"), F.pmod(deal, F.lit(slices)).cast("int").alias("slice"), "id", "vector")
    r = r.select("to.cell", F.col("to.block").cast("int").alias("block"), "slice", F.lit(1).alias("side"), "id", "vector")
    met = q.unionByName(r).repartition("cell", "block", "slice").sortWithinPartitions("cell", "block", "slice", "side")
    return met.mapInArrow(_met(top), f"query {kind}, id {kind}, score double")


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False))


def _cells(pivots: np.ndarray):
    """Each vector's nearest pivot, and how far it is; vectors without length have a cell of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1)))
            square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
            cell = square.argmin(1)
            far = np.sqrt(np.maximum(0, square[np.arange(len(x)), cell]))
            none = ~x.any(1)
            cell[none], far[none] = len(pivots), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "vector", "cell", "far"])

    return run


def _least(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((far, cell))
            cell, far = cell[order], far[order]
            place = np.arange(len(cell)) - np.searchsorted(cell, cell)
            yield pa.RecordBatch.from_arrays([pa.array(cell[place < n], pa.int32()), pa.array(far[place < n])], names=["cell", "far"])

    return run


#: Candidates of a block that a task holds before it keeps the best of each query.
HELD = 500_000


def _met(top: int):
    """Blocks of queries, each followed by the rows that it meets: a block's best, by score and id, once all its rows have come."""

    def best(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        t = t.take(pc.sort_indices(t, [("query", "ascending"), ("score", "descending"), ("id", "ascending")]))
        of = t["query"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = np.arange(len(of)) - np.searchsorted(of, of)
        return t.filter(pa.array(place < top)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, meets, parts = None, [], [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                part, now = batch.slice(a, b - a), tuple(keys[a][:3])
                if now != key:
                    if parts:
                        yield from best(parts)
                    key, ids, held, meets, parts = now, [], [], None, []
                if keys[a][3] == 0:
                    ids += part.column(4).to_pylist()
                    held.append(_matrix(part.column(5)))
                elif ids:
                    if meets is None:
                        meets = _top_rows(ids, np.concatenate(held), top)
                    parts += meets(iter([part.select([4, 5])]))
                    if sum(x.num_rows for x in parts) > HELD:
                        parts = best(parts)
        if parts:
            yield from best(parts)

    return run


def _top_rows(ids: list, vectors: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _unit(vectors)
        for batch in batches:
            if not batch.num_rows:
                continue
            theirs = batch.column(0).to_pylist()
            scores = asked @ _unit(_matrix(batch.column(1))).T
            at = {x: i for i, x in enumerate(theirs)}
            for q, x in enumerate(ids):  # a query is no neighbour of its own
                if x in at:
                    scores[q, [i for i, y in enumerate(theirs) if y == x]] = -np.inf
            k = min(top, len(theirs))
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            q, i = np.nonzero((scores >= least) & np.isfinite(scores))  # ties stay until the ranking
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in q], batch.schema.field(0).type), batch.column(0).take(pa.array(i)), pa.array(scores[q, i])], names=["query", "id", "score"])

    return run
