"""Least-cost repair of the turn structure of conversations.

Rows of a conversation, in order of turn (nulls first; of one turn by role, then
text), become a sequence of roles `(s?(ua)+)?` by edits of single rows: D deletes
one (2; blank rows and repeats of an earlier row have to go), I inserts an empty
turn (5), K keeps a row, R gives it the role that fits (1); a row kept or
re-roled that does not end a sentence costs 5 more.  Of the cheapest edits those
count whose initials, in order, come first as ASCII text.

There are four states: nothing yet, after system, after user, after assistant.
Hirschberg's divide and conquer: the cost vector of the first half from the
front and that of the second half from the back meet in the middle; the left
half is solved towards all states through which a cheapest way leads, so that
its least audit picks the crossing, and the right half goes on from there.  Only
vectors of four numbers are kept per level.

Conversations are laid out by range of (conv_id, turn, ...), so one that holds a
large share of all rows lies over many tasks.  Every task repairs the
conversations that lie wholly inside it.  Its first and last one may go on next
door: their pieces are reduced to 4 x 4 cost matrices (with the order of the
audits behind them), a few rows per conversation are chained to fix in which state
each piece begins and ends, and then each piece is repaired on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskline.session import cut

SPACE = " \t\n\x0b\x0c\r"
STATES = range(4)  # nothing, after s, after u, after a
INSERTED = (2, 2, 3, 2)  # the state after an inserted turn
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
NEVER = 1 << 40
ACCEPT = [0, 2 * INSERT, INSERT, 0]  # cost of ending in a state
BLOCK = 64  # rows solved with a vector per row

Vector = list[int]


def _kept(state: int, initial: str) -> int | None:
    """The state after keeping a row with that initial, None if it does not fit."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return None if state == 2 else 2
    return 3 if initial == "a" and state == 2 else None


def _steps(code: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row: (letter, cost, next state), in letter order."""
    initial, must_go, cut_off = "suao"[code & 3], code & 4, code & 8
    more = CUT_OFF if cut_off else 0
    out = []
    for state in STATES:
        ways = [("D", DELETE, state)]
        if not must_go:
            if (to := _kept(state, initial)) is not None:
                ways.append(("K", more, to))
            ways.append(("R", REROLE + more, INSERTED[state]))
        out.append(ways)
    return out


STEPS = [_steps(code) for code in range(16)]


def _with_inserts(back: Vector) -> Vector:
    a, b = min(back[2], INSERT + back[3]), min(back[3], INSERT + back[2])
    return [min(back[0], INSERT + a), min(back[1], INSERT + a), a, b]


def _before(code: int, back: Vector) -> Vector:
    """Costs to the end from before a row, by the costs from after it."""
    return _with_inserts([min(cost + back[to] for _, cost, to in ways) for ways in STEPS[code]])


def backward(codes: Sequence[int], low: int, high: int, end: Vector) -> Vector:
    for i in range(high - 1, low - 1, -1):
        end = _before(codes[i], end)
    return end


def forward(codes: Sequence[int], low: int, high: int, state: int) -> Vector:
    """Costs of having each state right after row high - 1."""
    costs = [NEVER] * 4
    costs[state] = 0
    for i in range(low, high):
        at = list(costs)
        for s in (0, 1, 2, 3, 2):
            at[INSERTED[s]] = min(at[INSERTED[s]], at[s] + INSERT)
        costs = [NEVER] * 4
        for s, ways in enumerate(STEPS[codes[i]]):
            for _, cost, to in ways:
                costs[to] = min(costs[to], at[s] + cost)
    return costs


def audit(codes: Sequence[int], low: int, high: int, state: int, end: Vector) -> tuple[str, int]:
    """The least audit of the cheapest edits of rows low:high from `state`, and the state after them.

    `end` has the cost that each state still has after the rows.
    """
    if high - low <= BLOCK:
        return _walk(codes, low, high, state, end)
    middle = (low + high) // 2
    front, back = forward(codes, low, middle, state), backward(codes, middle, high, end)
    best = min(f + b for f, b in zip(front, back, strict=True))
    crossing = [b if f + b == best else NEVER for f, b in zip(front, back, strict=True)]
    left, state = audit(codes, low, middle, state, crossing)
    right, state = audit(codes, middle, high, state, end)
    return left + right, state


def _walk(codes: Sequence[int], low: int, high: int, state: int, end: Vector) -> tuple[str, int]:
    back = [end]
    for i in range(high - 1, low - 1, -1):
        back.append(_before(codes[i], back[-1]))
    back.reverse()
    out = []
    for i in range(low, high):
        here, after = back[i - low], back[i - low + 1]
        while True:
            ways = [*STEPS[codes[i]][state], ("I", INSERT, -1)]
            letter, _, to = min(w for w in ways if w[1] + (here[INSERTED[state]] if w[2] < 0 else after[w[2]]) == here[state])
            out.append(letter)
            if to >= 0:
                state = to
                break
            state = INSERTED[state]
    return "".join(out), state


def closing(state: int) -> str:
    """The inserts that end a conversation in that state."""
    return "I" * (ACCEPT[state] // INSERT)


def edited(edits: str, rows: Sequence[tuple[str, str]], state: int) -> list[str]:
    """The lines `role:text` that the edits make of (role, text) rows."""
    out, row = [], iter(rows)
    for letter in edits:
        if letter == "I":
            state = INSERTED[state]
            out.append(("user:", "assistant:")[state - 2])
            continue
        role, text = next(row)
        if letter == "K":
            state = _kept(state, role[:1])
        elif letter == "R":
            state = INSERTED[state]
            role = ("user", "assistant")[state - 2]
        if letter != "D":
            out.append(f"{role}:{text}")
    return out


def _code(role: str, text: str, seen: bool) -> tuple[int, str]:
    """The kind of a row as a number, and its first fault."""
    stripped = text.strip(SPACE)
    fault = "blank" if not stripped else "duplicate" if seen else "" if stripped[-1] in ".!?" else "truncated"
    initial = "sua".find(role[:1]) if role else 3
    return (initial if initial >= 0 else 3) + 4 * (fault in ("blank", "duplicate")) + 8 * (fault == "truncated"), fault


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: Sequence[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def mended(rows: Sequence[tuple]) -> dict:
    """One whole conversation: rows (turn, role, text) in order."""
    seen, codes, faults = set(), [], []
    for _, role, text in rows:
        code, fault = _code(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(code)
        faults.append(fault)
    edits, state = audit(codes, 0, len(codes), 0, ACCEPT)
    edits += closing(state)
    found = {name: faults.count(name) for name in ("blank", "duplicate", "truncated")}
    found |= {"gaps": _gaps([r[0] for r in rows]), "illegal": _illegal([r[1][:1] for r in rows])}
    cost = backward(codes, 0, len(codes), ACCEPT)[0]
    return found | {"cost": cost, "audit": edits, "text": "\n".join(edited(edits, [r[1:] for r in rows], 0))}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of conv_id and turn; `gone` marks dropped ones.

    A null counts as one space in the checksum, the role and the text.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("_fate"),
    )
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_fate") == 0).alias("gone"),
        F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return out.drop("_copy")


def repaired(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The repair of every conversation of `conv_id, turn, role, text` rows.

    Output per conversation: `conv_id, part, parts, gaps, blank, duplicate, truncated,
    illegal, cost, audit, text`; text has the repaired turns, `role:text`, a line each.
    A conversation that lies over several tasks has several rows, `part` 0 to
    `parts - 1`, whose audits and texts follow one another; the numbers then stand
    in part 0.  A part without text has null there.

    An optional column `gone` marks rows to leave out: their conversation is kept,
    with zeros, an empty audit and null text when it has no other row.  A null
    role or text counts as one space, a null conv_id is a conversation of its own;
    null turns come first.  Repeated rows are faults (`duplicate`).
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    given = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"),
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    place = [*order, F.substring("text", 1, 100).asc()]  # range bounds hold no whole texts
    laid = given.repartitionByRange(partitions, *place) if partitions else given.repartitionByRange(*place)
    schema = T.StructType([given.schema["conv_id"]])
    for name in ("piece", "place", "turn", *_COUNTS):
        schema = schema.add(name, "long")
    schema = schema.add("role", "string").add("text", "string").add("audit", "string").add("gone", "boolean")
    arrow = to_arrow_schema(schema)
    done = cut(laid.sortWithinPartitions(*order, "text").mapInArrow(lambda b: _by_conversation(b, arrow), schema), "repaired")
    whole = done.where(F.col("piece").isNull())
    columns = ["conv_id", "part", "parts", *_COUNTS, "audit", "text"]
    one = whole.withColumns({"part": F.lit(0).cast("long"), "parts": F.lit(1).cast("long")}).select(*columns)
    return one.unionByName(_pieced(done.where(F.col("piece").isNotNull()), schema["conv_id"]).select(*columns))


def _by_conversation(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per conversation; the rows of the task's first and last one as they are."""
    piece = TaskContext.get().partitionId()
    out: list[dict] = []
    held: list[tuple] = []
    name, first = None, True

    def as_rows() -> None:
        for place, (turn, role, text, gone) in enumerate(held):
            out.append({"conv_id": name, "piece": piece, "place": place, "turn": turn, "role": role, "text": text, "gone": gone})

    for batch in batches:
        for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")], strict=True):
            if held and conv != name:
                if first:
                    as_rows()
                else:
                    there = [r[:3] for r in held if not r[3]]
                    out.append({"conv_id": name} | mended(there) | ({} if there else {"text": None}))
                held, first = [], False
            name = conv
            held.append(tuple(row))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
    as_rows()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _pieced(rows: DataFrame, conv_field: T.StructField) -> DataFrame:
    """Conversations whose pieces lie in several tasks."""
    rows = rows.select(F.struct("conv_id").alias("conv"), "piece", "place", "turn", "role", "text", "gone")
    digest = [F.xxhash64("role", "text").alias("h1"), F.crc32(F.concat("role", "text").cast("binary")).alias("h2"), F.length("text").alias("h3")]
    there = rows.where(~F.col("gone"))
    first = there.groupBy("conv", *digest).agg(F.min(F.struct("piece", "place")).alias("first"))
    hashed = rows.select("*", *digest).join(first, ["conv", "h1", "h2", "h3"], "left")
    flagged = hashed.select(
        "conv", "piece", "place", "turn", "role", "text", "gone", (F.struct("piece", "place") > F.col("first")).alias("seen")
    )
    flagged = cut(flagged, "pieces")
    conv = T.StructField("conv", T.StructType([conv_field]))
    summary = T.StructType([conv]).add("piece", "long")
    for name in ("rows", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"):
        summary = summary.add(name, "long")
    summary = summary.add("head", "string").add("tail", "string").add("costs", T.ArrayType(T.LongType())).add("ranks", T.ArrayType(T.LongType()))
    chain = T.StructType([conv])
    for name in ("piece", "part", "parts", "start", "end", *_COUNTS):
        chain = chain.add(name, "long")
    to_summary, to_chain = to_arrow_schema(summary), to_arrow_schema(chain)
    # A piece is a part of one task's rows; the chain of a conversation has a row per piece.
    small = flagged.groupBy("conv", "piece").applyInArrow(lambda t: _summed(t, to_summary), summary)
    chained = cut(small.groupBy("conv").applyInArrow(lambda t: _chained(t, to_chain), chain), "chain")
    result = T.StructType([conv]).add("piece", "long").add("audit", "string").add("text", "string")
    to_result = to_arrow_schema(result)
    ends = chained.select("conv", "piece", "start", "end", (F.col("part") == F.col("parts") - 1).alias("is_last"))
    texts = flagged.join(ends, ["conv", "piece"]).groupBy("conv", "piece").applyInArrow(lambda t: _solved(t, to_result), result)
    return chained.join(texts, ["conv", "piece"]).select("conv.conv_id", *[c for c in chain.names if c != "conv"], "audit", "text")


def _piece(table: pa.Table) -> tuple[list[tuple], list[int], list[str]]:
    """(turn, role, text) rows of a piece in order, their codes and faults."""
    table = table.filter(pc.invert(table["gone"])).sort_by("place")
    rows = list(zip(*[table[c].to_pylist() for c in ("turn", "role", "text")], strict=True))
    kinds = [_code(role, text, bool(seen)) for (_, role, text), seen in zip(rows, table["seen"].to_pylist(), strict=True)]
    return rows, [c for c, _ in kinds], [f for _, f in kinds]


def _towards(state: int) -> Vector:
    return [0 if s == state else NEVER for s in STATES]


def _summed(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Cost from each state to each, and the rank of the audits from one state."""
    rows, codes, faults = _piece(table)
    costs, ranks = [], []
    for start in STATES:
        to = forward(codes, 0, len(codes), start)
        ways = [audit(codes, 0, len(codes), start, _towards(s))[0] if to[s] < NEVER else "~" for s in STATES]
        costs += to
        ranks += [sorted(ways).index(w) for w in ways]
    known = [r[0] for r in rows if r[0] is not None]
    out = {"conv": table["conv"][0].as_py(), "piece": table["piece"][0].as_py(), "rows": len(rows), "illegal": _illegal([r[1][:1] for r in rows])}
    out |= {name: faults.count(name) for name in ("blank", "duplicate", "truncated")}
    out |= {"low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known))}
    out |= {"head": rows[0][1][:1] if rows else None, "tail": rows[-1][1][:1] if rows else None, "costs": costs, "ranks": ranks}
    return pa.Table.from_pylist([out], schema=schema)


def _chained(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """In which state each piece of a conversation begins and ends, and the conversation's numbers."""
    pieces = table.sort_by("piece").to_pylist()
    ends = [ACCEPT]
    for p in reversed(pieces[1:]):
        relaxed = [min(p["costs"][4 * s + t] + ends[-1][t] for t in STATES) for s in STATES]
        ends.append(relaxed)
    ends.reverse()
    out, state, cost = [], 0, 0
    for part, (p, end) in enumerate(zip(pieces, ends, strict=True)):
        _, _, to = min((p["costs"][4 * state + t] + end[t], p["ranks"][4 * state + t], t) for t in STATES)
        cost += p["costs"][4 * state + to]
        out.append({"conv": p["conv"], "piece": p["piece"], "part": part, "parts": len(pieces), "start": state, "end": to} | dict.fromkeys(_COUNTS, 0))
        state = to
    total = {name: sum(p[name] for p in pieces) for name in ("blank", "duplicate", "truncated", "illegal")}
    filled = [p for p in pieces if p["rows"]]
    total["illegal"] += sum(_illegal([a["tail"], b["head"]]) for a, b in zip(filled, filled[1:], strict=False))
    timed = [p for p in filled if p["low"] is not None]
    shared = sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
    span = timed[-1]["high"] - timed[0]["low"] + 1 - sum(p["turns"] for p in timed) + shared if timed else 0
    out[0] |= total | {"gaps": span, "cost": cost + ACCEPT[state]}
    return pa.Table.from_pylist(out, schema=schema)


def _solved(table: pa.Table, schema: pa.Schema) -> pa.Table:
    rows, codes, _ = _piece(table)
    start, end = table["start"][0].as_py(), table["end"][0].as_py()
    edits, state = audit(codes, 0, len(codes), start, _towards(end))
    edits += closing(state) if table["is_last"][0].as_py() else ""
    lines = edited(edits, [r[1:] for r in rows], start)
    out = {"conv": table["conv"][0].as_py(), "piece": table["piece"][0].as_py(), "audit": edits, "text": "\n".join(lines) if lines else None}
    return pa.Table.from_pylist([out], schema=schema)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`: its numbers, whole audit, and the text's `repaired_sha256`."""
    columns = ["conv_id", *_COUNTS, "audit"]
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("repaired_sha256")
    schema = T.StructType([parts.schema["conv_id"]])
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    arrow = to_arrow_schema(schema)
    # The text of a conversation in parts goes through a running hash, part by part.
    several = parts.where("parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    folded = several.mapInArrow(lambda batches: _folded(batches, arrow), schema)
    return parts.where("parts = 1").select(*columns, sha).unionByName(folded)


def _folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, sha, begun = None, hashlib.sha256(), False
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if row["part"] == 0:
                if now:
                    done.append(now | {"audit": "".join(now["audit"]), "repaired_sha256": sha.hexdigest()})
                now, sha, begun = {n: row[n] for n in ("conv_id", *_COUNTS)} | {"audit": []}, hashlib.sha256(), False
            now["audit"].append(row["audit"])
            if row["text"] is not None:
                sha.update((b"\n" if begun else b"") + row["text"].encode())
                begun = True
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if now:
        yield pa.RecordBatch.from_pylist([now | {"audit": "".join(now["audit"]), "repaired_sha256": sha.hexdigest()}], schema=schema)
