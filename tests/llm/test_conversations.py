"""Conversation repair against a shortest-path search, and its tables against the full CYK."""

import heapq
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from civlens.llm import conversations as C

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, idx int, symbols string, cost int, audit string"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def shortest(rows, faults):
    """Dijkstra over (rows used, state of the roles), by cost and then by the edits."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, lines
        if (i, q) in done:
            continue
        done.add((i, q))
        put = lambda c, e, j, ch, line: heapq.heappush(heap, (cost + c, audit + e, i + j, moves[q, ch], (*lines, line)))  # noqa: E731, B023
        for ch, name in (("u", "user"), ("a", "assistant")):
            if (q, ch) in moves:
                put(2, "I", 0, ch, f"{name}:")
        if i < len(rows):
            role, text = rows[i]
            cut = int(faults[i] == "truncated")
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, lines))
            if faults[i] not in ("blank", "duplicate"):
                if (q, role[:1]) in moves:
                    put(cut, "K", 1, role[:1], f"{role}:{text}")
                for ch, name in (("u", "user"), ("a", "assistant")):
                    if (q, ch) in moves:
                        put(2 + cut, "R", 1, ch, f"{name}:{text}")


def brute(table):
    convs = {c: [] for c, *_ in table}
    for conv, turn, role, text in damage(table):
        convs[conv].append((turn, role, text))
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        turns = [t for t, *_ in rows if t is not None]
        seen, faults = set(), []
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = shortest([r[1:] for r in rows], faults)
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            sha256("\n".join(lines).encode()).hexdigest(),
        )


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def run(spark, rows):
    table = spark.createDataFrame([(*r, 7, "x", 7, "KKK") for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in C.repaired(table, C.damaged(table)).select(*COLUMNS).collect()]


def test_odd_rows_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["Fine.", "Also fine!", "cut off", "", " \n\t", None, "What?", "漢字。", "é \x85", "No. \n"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    rows = [
        (conv, rng.choice([None, *range(n)]) if odd else turn, rng.choice(roles), rng.choice(texts))
        for conv in [None, *range(120)]
        for n, odd in [(rng.randint(1, 9), rng.random() < 0.3)]
        for turn in range(n)
    ]
    rows += [(500, t, "user", "same text.") for t in range(40)] + [(501, 1, "user", "one row.")] * 30
    rows += [(502, 1, "user", "long " * 50_000 + "."), (502, 2, "assistant", "x" * 200_000), (503, -9, "user", "a."), (503, 9, "user", "b.")]
    got, want = by_id(run(spark, rows)), by_id(brute(rows))
    assert len(got) == len(want) == len({r[0] for r in rows})
    assert got == want


def test_conversation_over_many_chunks(spark):
    rng = random.Random(2)
    n = 3 * C.CHUNK + 17
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, n)}{rng.choice(['.', '.', ''])}") for t in range(n)]
    rows += [(2, t, "user", "hm.") for t in range(50)]
    assert by_id(run(spark, rows)) == by_id(brute(rows))


def test_all_rows_dropped_and_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "a.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert run(spark, []) == []


def full_cyk(symbols):
    """The table over all spans and all splits."""
    n, cell = len(symbols), {}
    for i, s in enumerate(symbols):
        cell[i, i + 1] = C.row_table(s)
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            j = i + length
            ways = [C.combine(cell[i, k], cell[k, j]) for k in range(i + 1, j)]
            cell[i, j] = tuple(C.least(w[x] for w in ways) for x in range(16))
    return cell[0, n]


@pytest.mark.parametrize("seed", range(40))
def test_one_split_gives_the_full_table(seed):
    rng = random.Random(seed)
    symbols = "".join(rng.choices(C.FINE + C.TRUNCATED + C.BLANK + C.DUPLICATE, k=rng.randint(1, 11)))
    assert C.span_table(symbols) == full_cyk(symbols)


def test_copies_of_a_whole_table(spark):
    got = [tuple(r) for r in C.op11_conversations(spark, "/root/testdata/sf0.01").select(*COLUMNS).collect()]
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = list(brute([tuple(r) for r in table.collect()]))
    assert by_id(got) == by_id(want)
    sizes = defaultdict(int)
    for r in got:
        sizes[len(r[7])] += 1
    assert len(sizes) > 3
