"""Repair of conversations: faults by turn, and the cheapest edits that give the roles their order.

Roles have to read system?, then user and assistant in turn, user first and assistant last,
or nothing at all. Edits are Keep, Rerole (to user or assistant), Delete and Insert (an empty
turn of user or assistant). Blank turns and turns whose role and text came before must go;
keeping one that breaks off costs extra. Of all cheapest repairs that whose letters are least
is taken.

Method: turns and states of the roles' order make a layered graph, an edit being an arc.
Minimum costs from the start (forward) and to the end (backward) tell the tight arcs, which
are those of all optimal repairs. A set of states, the frontier, then walks the layers: at each
step it takes the least letter among its tight arcs.

Scale: turns are dealt by ranges of conversation and turn, so a conversation with a third of
all turns spreads over many tasks. Tasks cut their turns into chunks of at most CHUNK turns,
one table row each. For conversations of several chunks, each chunk is first summed up as a
matrix: for each state before and after it the least cost, and the order of their least letters.
Such matrices compose, within a task's share first and then over the shares, so that each chunk
learns its forward costs and frontier on entry and its backward costs on exit. All chunks are
then repaired apart from each other. Copies of one turn are a row with a count throughout.

Only digests() reads a conversation in one task, as a digest needs all of its bytes in order; it
streams them.

Null roles and texts are one blank, a null conversation is the one named by a blank; turns without a
number come first. Ties of turn are settled by role and by the text's MD5; equal rows are
alike. A role is known by its first letter; an empty role has none and can't be kept. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, dropped, slices, written

CHUNK, CHUNK_BYTES = 256, 1 << 20  # most turns of a chunk, and the bytes of text from which on it ends
INF = 1 << 60
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5  # costs of edits, and of keeping a turn that breaks off

#: The roles' order: state -> what a role's first letter leads to; states 0 and 3 may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: state -> the role that an inserted or changed turn takes there, and where it leads to.
PUTS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
STATES = range(len(STEPS))
ENDINGS = [0, 2 * INSERT, INSERT, 0]  # what it costs to end in a state
INSERTS = (0, 2, 1, 0)  # and how many inserts

BLANKS = " \t\n\v\f\r"


def arcs(kind: str) -> tuple[list[tuple[str, int, int]], ...]:
    """For each state the (letter, cost, next state) that take in a turn of a kind: its first letter ('-': none that fits, 'x': it must go) and '!' if it breaks off."""
    initial, extra = kind[0], BROKEN if kind.endswith("!") else 0
    out = []
    for s in STATES:
        found = [("D", DELETE, s)]
        if initial != "x":
            if initial in STEPS[s]:
                found.append(("K", extra, STEPS[s][initial]))
            found.append(("R", REROLE + extra, PUTS[s][1]))
        out.append(found)
    return tuple(out)


ARCS = {k: arcs(k) for k in ("s", "u", "a", "-", "x", "s!", "u!", "a!", "-!")}

Matrix = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]  # least cost, and order of the least letters, by state before and state after


@lru_cache(maxsize=None)
def step_matrix(kind: str) -> Matrix:
    """A turn's matrix; inserts stand before the turn."""
    costs, orders = [], []
    for s in STATES:
        ways: dict[int, tuple[int, str]] = {}
        at, paid, letters = s, 0, ""
        for _ in range(3):
            for letter, cost, t in ARCS[kind][at]:
                way = (paid + cost, letters + letter)
                ways[t] = min(ways.get(t, way), way)
            at, paid, letters = PUTS[at][1], paid + INSERT, letters + "I"
        by_letters = sorted(ways, key=lambda t: ways[t][1])
        costs.append(tuple(ways[t][0] if t in ways else INF for t in STATES))
        orders.append(tuple(by_letters.index(t) if t in ways else len(STEPS) for t in STATES))
    return tuple(costs), tuple(orders)


@lru_cache(maxsize=1 << 16)
def composed(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of a, then b."""
    costs, orders = [], []
    for s in STATES:
        row, rank = [], []
        for t in STATES:
            paid, order, m = min((a[0][s][m] + b[0][m][t], a[1][s][m], m) for m in STATES)
            row.append(min(INF, paid))
            rank.append((order, b[1][m][t], t) if paid < INF else (len(STEPS),))
        places = sorted(r for r in rank if len(r) > 1)
        costs.append(tuple(row))
        orders.append(tuple(places.index(r) if len(r) > 1 else len(STEPS) for r in rank))
    return tuple(costs), tuple(orders)


def power(kind: str, n: int) -> Matrix:
    """The matrix of n turns of a kind."""
    out, base = None, step_matrix(kind)
    while n:
        if n & 1:
            out = base if out is None else composed(out, base)
        base, n = composed(base, base), n >> 1
    return out


def before(matrix: Matrix, after: list[int]) -> list[int]:
    """Costs to the end before a matrix, from those after it."""
    return [min(min(INF, c + x) for c, x in zip(row, after)) for row in matrix[0]]


def onward(matrix: Matrix, costs: list[int], state: int, after: list[int]) -> tuple[list[int], int]:
    """Forward costs and the frontier's state after a matrix."""
    return [min(min(INF, costs[s] + matrix[0][s][t]) for s in STATES) for t in STATES], min(STATES, key=lambda t: (matrix[0][state][t] + after[t], matrix[1][state][t]))


def kinds_of(role: str, text: str, first: bool, copies: int) -> list[tuple[str, int]]:
    """(kind, how many) for copies of a turn, the first of which may be new."""
    end = text.rstrip(BLANKS)[-1:]
    if not end or not first:
        return [("x", copies)]
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return [(initial + ("" if end in ".!?" else "!"), 1)] + ([("x", copies - 1)] if copies > 1 else [])


def edits(kinds: list[tuple[str, int]], costs: list[int], state: int, after: list[int], last: bool) -> tuple[str, list[tuple[str, int, str]]]:
    """Letters of the least optimal repair of a chunk of (kind, how many; many only of those that must go), and (letter, turn's place or -1, role) of the turns it leaves."""
    layers = [list(costs)]
    for kind, n in kinds:
        now = layers[-1]
        for s in (0, 1, 2, 3, 2, 3):
            now[PUTS[s][1]] = min(now[PUTS[s][1]], now[s] + INSERT)
        new = [INF] * len(STEPS)
        for s in STATES:
            for _, cost, t in ARCS[kind][s]:
                new[t] = min(new[t], now[s] + n * cost)
        layers.append(new)
    total = min(c + x for c, x in zip(layers[-1], after))
    back = [list(after)]
    for kind, n in reversed(kinds):
        old = [min(n * cost + back[-1][t] for _, cost, t in ARCS[kind][s]) for s in STATES]
        for s in (3, 2, 1, 0, 3, 2):
            old[s] = min(old[s], INSERT + old[PUTS[s][1]])
        back.append(old)
    back.reverse()
    frontier, letters, left = {state}, [], []
    for i, (kind, n) in enumerate(kinds):
        while True:
            tight = [(letter, t, s) for s in frontier for letter, cost, t in ARCS[kind][s] if layers[i][s] + n * cost + back[i + 1][t] == total]
            tight += [("I", PUTS[s][1], s) for s in frontier if layers[i][s] + INSERT + back[i][PUTS[s][1]] == total]
            letter = min(tight)[0]
            frontier = {t for x, t, _ in tight if x == letter}
            s = min(s for x, _, s in tight if x == letter)  # letters tell states apart, so there is one
            letters.append(letter if letter == "I" else n * letter)
            if letter in "IR":
                left.append((letter, -1 if letter == "I" else i, PUTS[s][0]))
            elif letter == "K":
                left.append((letter, i, ""))
            if letter != "I":
                break
    if last:
        s = min(frontier, key=lambda s: (ENDINGS[s], s))
        for _ in range(INSERTS[s]):
            letters.append("I")
            left.append(("I", -1, PUTS[s][0]))
            s = PUTS[s][1]
    return "".join(letters), left


TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("first", pa.bool_()), ("copies", pa.int64())])
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
CHUNKS = pa.schema([("conversation", pa.string()), ("part", pa.int64()), ("ord", pa.int64()), ("open", pa.bool_()), ("matrix", pa.list_(pa.int64())), *[(c, pa.int64()) for c in COUNTS], ("first_initial", pa.string()), ("last_initial", pa.string()), ("least_turn", pa.int64()), ("most_turn", pa.int64()), ("held", pa.list_(TURN))])
CHUNKS_DDL = "conversation string, part long, ord long, open boolean, matrix array<bigint>, blank long, duplicate long, truncated long, illegal long, turns long, first_initial string, last_initial string, least_turn long, most_turn long, held array<struct<turn:bigint,role:string,text:string,first:boolean,copies:bigint>>"
LEGAL = ("su", "ua", "au")


def flat(m: Matrix) -> list[int]:
    return [x for half in m for row in half for x in row]


def unflat(x: list[int]) -> Matrix:
    n = len(STEPS)
    rows = [tuple(int(v) for v in x[i : i + n]) for i in range(0, 2 * n * n, n)]
    return tuple(rows[:n]), tuple(rows[n:])


def chunk_of(conversation: str, part: int, ord_: int, is_open: bool, held: list[dict]) -> dict:
    """A chunk of consecutive turns with its counts, and its matrix if the conversation may go on elsewhere."""
    out = dict.fromkeys(COUNTS, 0) | {"conversation": conversation, "part": part, "ord": ord_, "open": is_open, "held": held, "matrix": None}
    matrix, initial = None, None
    for t in held:
        for kind, n in kinds_of(t["role"], t["text"], t["first"], t["copies"]):
            if is_open:
                matrix = power(kind, n) if matrix is None else composed(matrix, power(kind, n))
            out["blank" if not t["text"].strip(BLANKS) else "duplicate" if kind == "x" else "truncated"] += n if kind == "x" or kind.endswith("!") else 0
        now = t["role"][:1]
        out["illegal"] += t["copies"] - 1 + (initial is not None and initial + now not in LEGAL)
        initial = now
    if matrix:
        out["matrix"] = flat(matrix)
    turns = [t["turn"] for t in held if t["turn"] is not None]
    out["turns"] = len(set(turns))
    return out | {"first_initial": held[0]["role"][:1], "last_initial": initial, "least_turn": turns[0] if turns else None, "most_turn": turns[-1] if turns else None}


def cut(most: int):
    """Turns in order as chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, ord_, held, size, ready, edge = TaskContext.get().partitionId(), None, 0, [], 0, [], True
        for batch in (piece for whole in batches for piece in slices(whole, "text", CHUNK_BYTES)):
            for t in batch.to_pylist():
                if held and (t["conversation"] != now or len(held) == most or size >= CHUNK_BYTES):
                    more = t["conversation"] == now
                    ready.append(chunk_of(now, part, ord_, edge or more or ord_ > 0, held))
                    edge = edge and more
                    ord_, held, size = ord_ + 1 if more else 0, [], 0
                now = t.pop("conversation")
                held.append(t)
                size += len(t["text"])
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=CHUNKS)
                ready = []
        if held:
            yield pa.RecordBatch.from_pylist([chunk_of(now, part, ord_, True, held)], schema=CHUNKS)

    return run


def shares(chunks: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a task's share of a conversation."""
    chunks = chunks.sort_values("ord")
    out = None
    for m in chunks["matrix"]:
        out = unflat(m) if out is None else composed(out, unflat(m))
    return pd.DataFrame({"conversation": [chunks["conversation"].iloc[0]], "part": [chunks["part"].iloc[0]], "matrix": [flat(out)]})


def passed(keys: list[str]):
    """Rows with a matrix each, in order, and what holds before and after all of them -> what holds before and after each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys[-1]).reset_index(drop=True)
        matrices = [unflat(m) for m in rows["matrix"]]
        afters = [[int(x) for x in rows["after"].iloc[0]]]
        for m in reversed(matrices):
            afters.append(before(m, afters[-1]))
        afters.reverse()
        costs, state, out = [int(x) for x in rows["costs"].iloc[0]], int(rows["state"].iloc[0]), []
        for m, after in zip(matrices, afters[1:]):
            out.append((costs, state, after))
            costs, state = onward(m, costs, state, after)
        told = pd.DataFrame(out, columns=["costs", "state", "after"])
        return pd.concat([rows[["conversation", *keys]], told, pd.Series([*[False] * (len(rows) - 1), True], name="last") & rows["last"]], axis=1)

    return run


def few(batches: Iterator[pa.RecordBatch], n: int = 32) -> Iterator[pa.RecordBatch]:
    """Chunks a few at a time, as one may hold CHUNK_BYTES of text."""
    return (b.slice(lo, n) for b in batches for lo in range(0, b.num_rows, n))


TOLD = "costs array<bigint>, state long, after array<bigint>, last boolean"
START = [0, INF, INF, INF]


def repaired(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each chunk of a conversation (part, ord: its place): edits (letters), cost, left (role and text of the turns that stay), and the faults of its turns.

    turns has conversation, turn, role and text.
    """
    rows = turns.select(F.coalesce(F.col("conversation").cast("string"), F.lit(" ")).alias("conversation"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    runs = rows.groupBy("conversation", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("md5", F.md5(F.col("text").cast("binary")))
    firsts = runs.groupBy("conversation", "role", "md5").agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("start"))
    runs = runs.join(firsts.hint("merge"), ["conversation", "role", "md5"]).withColumn("first", F.col("turn").eqNullSafe(F.col("start.turn")))
    ordered = runs.repartitionByRange("conversation", "turn", "role", "md5").sortWithinPartitions("conversation", "turn", "role", "md5")
    chunks, one = written(ordered.select("conversation", "turn", "role", "text", "first", "copies").mapInArrow(cut(chunk), CHUNKS_DDL), "chunks")

    # conversations of several chunks: what holds before and after each
    several = chunks.where("open").groupBy("conversation").agg(F.count("*").alias("n")).where("n > 1").select("conversation")
    slim, two = written(chunks.where("open").select("conversation", "part", "ord", "matrix").join(several.hint("merge"), "conversation"), "slim")
    by_share = slim.groupBy("conversation", "part").applyInPandas(shares, "conversation string, part long, matrix array<bigint>")
    numbers = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    whole = by_share.withColumns({"costs": numbers(START), "state": F.lit(0).cast("long"), "after": numbers(ENDINGS), "last": F.lit(True)})
    by_share = whole.groupBy("conversation").applyInPandas(passed(["part"]), f"conversation string, part long, {TOLD}")
    told = slim.join(by_share.hint("merge"), ["conversation", "part"]).groupBy("conversation", "part").applyInPandas(passed(["part", "ord"]), f"conversation string, part long, ord long, {TOLD}")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            out = []
            for c in batch.select(["held", "costs", "state", "after", "last"]).to_pylist():
                kinds = [(kind, n, i) for i, t in enumerate(c["held"]) for kind, n in kinds_of(t["role"], t["text"], t["first"], t["copies"])]
                costs, state, after = (START, 0, ENDINGS) if c["costs"] is None else (c["costs"], c["state"], c["after"])
                letters, left = edits([k[:2] for k in kinds], costs, state, after, c["last"] is not False)
                held = [c["held"][kinds[i][2]] if i >= 0 else None for _, i, _ in left]
                paid = INSERT * letters.count("I") + DELETE * letters.count("D") + REROLE * letters.count("R") + BROKEN * sum(i >= 0 and kinds[i][0].endswith("!") for _, i, _ in left)
                out.append((letters, paid, [{"role": role or t["role"], "text": t["text"] if t else ""} for (_, _, role), t in zip(left, held)]))
            cols = list(zip(*out)) if out else [[]] * 3
            fixed = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*[column(batch, n) for n in PASSED], *fixed], [*PASSED, "edits", "cost", "left"])

    joined = chunks.join(told.hint("merge"), ["conversation", "part", "ord"], "left")
    kinds = dict(chunks.dtypes)
    out, _ = written(joined.mapInArrow(mend, ", ".join(f"{n} {kinds[n]}" for n in PASSED) + ", edits string, cost long, left array<struct<role:string,text:string>>"), "repaired")
    dropped(turns.sparkSession, one, two)
    return out


PASSED = ["conversation", "part", "ord", *COUNTS, "first_initial", "last_initial", "least_turn", "most_turn"]


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of repaired(): gaps, faults, cost, audit (all letters) and the SHA-256 of what is left, as role:text lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, sums, audit, digest, lines, last = None, [], {}, [], None, 0, None

        def done() -> dict:
            n = sums.pop("turns")
            gaps = sums.pop("most") - sums.pop("least") + 1 - n if n else 0
            return {"conversation": now, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | {k: v for k, v in sums.items() if k not in ("most", "least")}

        for batch in few(batches):
            for c in batch.to_pylist():
                if digest is None or c["conversation"] != now:
                    if digest is not None:
                        ready.append(done())
                    now, sums, audit, digest, lines, last = c["conversation"], dict.fromkeys([*COUNTS, "cost"], 0) | {"least": None, "most": None}, [], hashlib.sha256(), 0, None
                for k in (*COUNTS, "cost"):
                    sums[k] += c[k]
                sums["illegal"] += last is not None and last + c["first_initial"] not in LEGAL
                if c["least_turn"] is not None:
                    sums["turns"] -= sums["most"] == c["least_turn"]
                    sums["least"] = c["least_turn"] if sums["least"] is None else sums["least"]
                    sums["most"] = c["most_turn"]
                last = c["last_initial"]
                audit.append(c["edits"])
                for t in c["left"]:
                    digest.update((b"\n" if lines else b"") + f"{t['role']}:{t['text']}".encode())
                    lines += 1
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=DIGESTS)
                ready = []
        if digest is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=DIGESTS)

    ordered = repaired.repartition("conversation").sortWithinPartitions("conversation", "part", "ord")
    return ordered.mapInArrow(run, "conversation string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


DIGESTS = pa.schema([("conversation", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
