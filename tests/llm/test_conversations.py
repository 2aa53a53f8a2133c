"""Conversation repair held against plain recursion over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from graphloom.llm import conversations as C
from graphloom.llm import queries

BLANK = " \t\n\x0b\f\r"


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def answer(rows: list[tuple]) -> tuple:
    """Counts, cost, audit and digest of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        told = text.rstrip(BLANK)
        kinds.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[2][:1] or " " for r in rows]

    @lru_cache(maxsize=None)
    def best(k: int, got: str) -> tuple | None:
        """(cost, letters, rows) from row k on, after initials that can be followed as `got` can."""
        found = []
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", got):
            found.append((0, "", ()))
        for x, name in (("u", "user"), ("a", "assistant")):
            if re.fullmatch("s?(ua)*u?", got + x):
                more = inserted(k, got + x)
                if more:
                    found.append((5 + more[0], "I" + more[1], ((name, ""), *more[2])))
        if k < len(rows):
            found += consumed(k, got)
        return min(found, key=lambda f: f[:2], default=None)

    def short(got: str) -> str:
        """A prefix that may go on in the same ways."""
        return got if len(got) < 4 else got[:1] * (got[0] == "s") + ("ua" if got[-1] == "a" else "uau")

    def inserted(k: int, got: str, left: int = 2):
        """After an insert: at most two more of them make sense."""
        found = []
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", got):
            found.append((0, "", ()))
        if left:
            for x, name in (("u", "user"), ("a", "assistant")):
                if re.fullmatch("s?(ua)*u?", got + x):
                    more = inserted(k, got + x, left - 1)
                    if more:
                        found.append((5 + more[0], "I" + more[1], ((name, ""), *more[2])))
        if k < len(rows):
            found += consumed(k, got)
        return min(found, key=lambda f: f[:2], default=None)

    def consumed(k: int, got: str) -> list[tuple]:
        found = []
        options = [("D", 2, "", ())]
        if kinds[k] not in ("blank", "duplicate"):
            late = 5 * (kinds[k] == "truncated")
            options.append(("K", late, first[k], (rows[k][2:],)))
            options += [("R", 1 + late, x, ((name, rows[k][3]),)) for x, name in (("u", "user"), ("a", "assistant"))]
        for letter, cost, x, row in options:
            if re.fullmatch("s?(ua)*u?", got + x):
                more = best(k + 1, short(got + x))
                if more:
                    found.append((cost + more[0], letter + more[1], row + more[2]))
        return found

    for k in range(len(rows), 0, -1):  # from the end, so that no recursion is deep
        for got in ("", "s", "u", "su", "ua", "sua", "uau", "suau"):
            best(k, got)
    cost, audit, left = best(0, "")
    turns = {r[1] for r in rows if r[1] is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(kinds.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
    )


def answers(rows: list[tuple]) -> set[tuple]:
    return {(c, *answer(damage([r for r in rows if r[0] == c]))) for c in {r[0] for r in rows}}


def made(n: int, seed: int = 3, longest: int = 9) -> list[tuple]:
    r, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", "", " \n", "Well. ", "So!", "a b", None, "\x1c"]
    for c in range(n):
        turn = 0
        for _ in range(r.randrange(1, longest)):
            turn += r.choice([0, 1, 1, 1, 1, 2])
            rows.append((None if c == 5 else c, None if r.random() < 0.04 else turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umbrella"]), r.choice(texts) if r.random() < 0.5 else f"{r.random()}."))
    return rows


KIND = "conv_id long, turn long, role string, text string"


def query(spark, rows, tmp_path) -> list[tuple]:
    spark.createDataFrame(rows, KIND).withColumn("part", C.F.lit("x")).withColumn("audit", C.F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return [tuple(x) for x in queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).select("conv_id", *C._COUNTS, "audit", "repaired_sha256").collect()]


@pytest.mark.parametrize("partitions", ["1", "23"])
def test_query_equals_recursion(spark, tmp_path, partitions):
    """Few partitions hold whole conversations, many cut them into pieces."""
    rows = made(150)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = query(spark, rows, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == answers(rows)


def test_a_conversation_over_all_partitions(spark, tmp_path):
    """Most rows in one conversation, many of them equal: cut anywhere, with one answer."""
    r = random.Random(8)
    rows = [(7, i // 3, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"{i}.", f"{i}", ""])) for i in range(600)]
    rows += [(7, 50, "user", "Again.")] * 40 + made(20, 4)
    rows = [x for x in rows if x[0] != 7 or x[1] is not None]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = query(spark, rows, tmp_path)
        pieces = C.repair(C.damaged(spark.createDataFrame(rows, KIND)))
        assert pieces.where("conv_id = 7").count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == answers(rows)


def test_no_rows_and_dropped_conversations(spark, tmp_path):
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert query(spark, [(gone, 0, "user", "Hi.")], tmp_path) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert query(spark, [], tmp_path) == []


def test_states_stay_few():
    automaton, r = C.Automaton(), random.Random(2)
    automaton.scan(bytes(r.randrange(9) for _ in range(200_000)), automaton.unit)
    automaton.scan(bytes(r.randrange(9) for _ in range(200_000)), automaton.end)
    assert len(automaton.vectors) < 2_000
