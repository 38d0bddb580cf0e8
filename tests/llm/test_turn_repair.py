import hashlib
import re
import zlib

import numpy as np
import pytest

from seqlab.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, block string, late int, _row string"
NEXT = {0: 2, 1: 2, 3: 2, 2: 3}
NAMES = {2: "user", 3: "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """Forward search that keeps the least (cost, audit) of each state; rows are (role, text, gone, cut)."""
    best = {0: (0, "", ())}

    def put(to, s, c, a, r):
        if s not in to or (c, a) < to[s][:2]:
            to[s] = (c, a, r)

    def inserted(v):
        out = dict(v)
        for _ in range(3):
            for s, (c, a, r) in list(out.items()):
                put(out, NEXT[s], c + 5, a + "I", (*r, NAMES[NEXT[s]] + ":"))
        return out

    for role, text, gone, cut in rows:
        new = {}
        for s, (c, a, r) in inserted(best).items():
            put(new, s, c + 2, a + "D", r)
            if gone:
                continue
            keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(s)
            if keep:
                put(new, keep, c + 5 * cut, a + "K", (*r, f"{role}:{text}"))
            put(new, NEXT[s], c + 1 + 5 * cut, a + "R", (*r, f"{NAMES[NEXT[s]]}:{text}"))
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def brute(rows, hurt=True):
    ids = {r[0] for r in rows}
    rows = damage(rows) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked) if own else (0, "", ())
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", 1, "x") for r in rows], SCHEMA)


def got(spark, rows, **how):
    return sorted(map(tuple, R.repaired(frame(spark, rows), **how).collect()), key=str)


def some_rows(rng, n, conv):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ux"], ["Yes.", "cut", "", None, " \n", "Why? ", "é!"]
    p = [0.4, 0.35, 0.1, 0.05, 0.04, 0.03, 0.03]
    return [(conv, i, rng.choice(roles, p=p), f"{i} " * int(rng.random() < 0.8) + str(rng.choice(texts[:2])) if rng.random() < 0.8 else rng.choice(texts)) for i in range(n)]


def test_chains_of_chunks_against_a_plain_search(spark):
    rng = np.random.default_rng(3)
    rows = [r for c in range(30) for r in some_rows(rng, int(rng.integers(1, 12)), c)] + some_rows(rng, 400, 99)
    rows += [(None, None, "user", "no place."), (None, 3, "assistant", "b."), (7, 2, "user", "2 again."), (50, 9, None, None), (51, None, "user", None)]
    # stretches over which vectors never come together: all cut short, all of one role, all the same
    rows += [(100, i, "user", f"{i} cut short") for i in range(90)] + [(101, i, "user", f"{i}.") for i in range(91)]
    rows += [(102, i, "assistant", "Same.") for i in range(80)] + [(103, i, "user", "x" * 5000 + f"{i}.") for i in range(6)]
    assert got(spark, rows, block_rows=7, block_bytes=4000) == brute(rows)
    assert got(spark, rows, damage=False) == brute(rows, False)


def test_defined_cases(spark):
    assert got(spark, []) == []
    gone = [(c, t) for c in range(60) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    rows = [(c, t, "user", "Dropped.") for c, t in gone]
    assert got(spark, rows) == brute(rows) and got(spark, rows)[0][7] == ""


def test_steps_differ_by_constants_only():
    steps, rng = R.Steps(), np.random.default_rng(1)
    codes = bytes(rng.integers(0, 9, 300).tolist())
    one, _, _ = R.costs_back(steps, codes, R.ACCEPT)
    two, _, run = R.costs_back(steps, codes, R.ACCEPT, [steps.shapes[x] for x in R.costs_back(steps, codes, R.FLAT)[0]])
    assert one == two and run < 60
