"""Repairs against a plain search that carries whole strings, in one chunk and in many."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from evidentia.llm import conversations, queries

BLANKS = " \t\n\v\f\r"


def plain(rows):
    """(conversation, turn, role, text) -> the digests of each conversation."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[" " if c is None else str(c)].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for c, held in by.items():
        held.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        seen, blank, copies, broken, ways = set(), 0, 0, 0, {0: (0, "", ())}
        put = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
        keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

        def padded(ways):
            todo = list(ways.items())
            while todo:
                s, (cost, audit, left) = todo.pop()
                role, t = put[s]
                way = (cost + 5, audit + "I", (*left, f"{role}:"))
                if t not in ways or way < ways[t]:
                    ways[t] = way
                    todo.append((t, way))

        for turn, role, text in held:
            is_blank, is_copy = not text.strip(BLANKS), (role, text) in seen
            seen.add((role, text))
            is_broken = not is_blank and not is_copy and text.strip(BLANKS)[-1] not in ".!?"
            blank, copies, broken = blank + is_blank, copies + (is_copy and not is_blank), broken + is_broken
            new = {}

            def offer(t, way, new=new):
                new[t] = min(new.get(t, way), way)

            # inserts before each turn; a state keeps several ways apart by their letters alone
            options = []
            for s, way in ways.items():
                at = s
                for _ in range(3):
                    options.append((at, way))
                    way = (way[0] + 5, way[1] + "I", (*way[2], f"{put[at][0]}:"))
                    at = put[at][1]
            for s, (cost, audit, left) in options:
                offer(s, (cost + 2, audit + "D", left))
                if not is_blank and not is_copy:
                    extra = 5 * is_broken
                    if (s, role[:1]) in keep:
                        offer(keep[s, role[:1]], (cost + extra, audit + "K", (*left, f"{role}:{text}")))
                    offer(put[s][1], (cost + extra + 1, audit + "R", (*left, f"{put[s][0]}:{text}")))
            ways = new
        padded(ways)
        cost, audit, left = min(ways[s] for s in (0, 3) if s in ways)
        turns = [t[0] for t in held if t[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, copies, broken, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, chunk, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conversation long, turn long, role string, text string, edits string").repartition(parts)
    names = ("conversation", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(tuple(r[n] for n in names) for r in conversations.digests(conversations.repaired(df, chunk)).collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Why?", "and so", "", " \n", None, "é. ", "Go."]
    out = []
    for c in range(40):
        for t in range(rnd.randint(1, 9)):
            text = rnd.choice(texts)
            out.append((c, rnd.choice([t, t, t + 1, None]), rnd.choice(roles), text if rnd.random() < 0.4 or text is None else f"{rnd.randint(0, 99)} {text}"))
    for t in range(120):  # a long one
        out.append((99, t, rnd.choice(roles), rnd.choice([f"{t}.", f"{t}", "Same.", ""])))
    out += [(98, 5, "user", "Hello.")] * 40 + [(98, 6, "assistant", "Yes.")] + [(None, None, None, None), (97, 1, "system", "Only.")]
    return out


def test_equals_a_plain_search(spark, rows):
    want = plain(rows)
    assert found(spark, rows, 256) == want
    assert found(spark, rows, 7) == want  # long ones spread over chunks and tasks
    assert found(spark, rows, 1) == want


def test_matrices_compose():
    rnd = random.Random(5)
    kinds = sorted(conversations.ARCS)
    for _ in range(50):
        a, b, c = (conversations.step_matrix(rnd.choice(kinds)) for _ in range(3))
        assert conversations.composed(conversations.composed(a, b), c) == conversations.composed(a, conversations.composed(b, c))
    assert conversations.power("x", 5) == conversations.composed(conversations.power("x", 2), conversations.power("x", 3))


def test_empty_table(spark):
    assert found(spark, [], 5) == []


def damaged_plainly(rows):
    out, text_of = [], lambda v: " " if v is None else str(v)
    for c, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        fault = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        out += [(c, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def test_op11_equals_a_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.execute(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    want = {r[0]: r[1:] for r in plain(damaged_plainly(rows))}
    got = {str(r.conv_id): (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op11_conversations(spark, sf).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {str(c): want.get(str(c), nothing) for c in {r[0] for r in rows}}
