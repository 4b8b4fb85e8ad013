"""Repaired conversations against a brute-force version."""

import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from tests.llm import brute

from deskline.llm import turn_repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, sizes):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]
    words = ["One.", "Two!", "three", "", " \t", None, "four?\n", "Five. ", "é."]
    rows = []
    for conv, size in sizes.items():
        for k in range(size):
            turn = rng.choice([k, k, k, k + 2, None, k // 2])
            text = rng.choice(words)
            rows.append((conv, turn, rng.choice(roles) if rng.random() < 0.5 else roles[k % 2], f"{k} {text}" if text and rng.random() < 0.7 else text))
    rng.shuffle(rows)
    return rows


def check(spark, rows, partitions=None):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", part int")
    got = turn_repair.digests(turn_repair.repaired(turn_repair.damaged(df), partitions)).collect()
    want = brute.damage(rows)
    assert len(got) == len(want) and {r["conv_id"] for r in got} == set(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == brute.repair(want[r["conv_id"]]), r["conv_id"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    check(spark, conversations(seed, {i: rng.randint(1, 12) for i in [*range(60), None]}))


def test_conversations_over_many_tasks(spark):
    """Long ones, one with most of the rows, cut into pieces; null conv_id among them."""
    rows = conversations(7, {None: 90, 1: 2, 2: 400, 3: 1, 4: 75})
    check(spark, rows, 23)


def test_divide_and_conquer_equals_the_plain_walk():
    rng = random.Random(3)
    for _ in range(20):
        codes = [rng.choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(rng.randint(65, 700))]
        whole, state = turn_repair._walk(codes, 0, len(codes), 0, turn_repair.ACCEPT)
        assert turn_repair.audit(codes, 0, len(codes), 0, turn_repair.ACCEPT) == (whole, state)


def test_dropped_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", True), (2, None, None, None, False)], SCHEMA + ", gone boolean")
    got = {r["conv_id"]: r for r in turn_repair.digests(turn_repair.repaired(df)).collect()}
    assert tuple(got[1][c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", brute.sha(""))
    assert tuple(got[2][c] for c in COLUMNS) == (0, 1, 0, 0, 0, 2, "D", brute.sha(""))
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.digests(turn_repair.repaired(turn_repair.damaged(empty))).collect() == []


def test_repaired_text(spark):
    rows = [(1, 1, "system", "s."), (1, 2, "user", "q?"), (1, 3, "user", "r."), (1, 4, "assistant", "cut"), (1, 5, "user", " ")]
    [got] = turn_repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (got["audit"], got["cost"], got["text"]) == ("KKRDD", 5, "system:s.\nuser:q?\nassistant:r.")


def test_piece_of_rows_where_nothing_else_has_imported_compute(monkeypatch):
    columns = {"gone": [False, True, False], "place": [2, 1, 0], "turn": [1, 0, 0], "role": ["user", "s", "system"], "text": ["a.", "b", "c"], "seen": [False] * 3}
    table = pa.table(columns)
    monkeypatch.delattr(pa, "compute")
    rows, _, faults = turn_repair._piece(table)
    assert rows == [(0, "system", "c"), (1, "user", "a.")] and faults == ["truncated", ""]
