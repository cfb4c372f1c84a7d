"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from matchloom.llm import conversations

SPACE = " \t\n\v\f\r"


def brute(turns):
    """Cheapest cost and least audit by a grammar automaton, insertions tried everywhere."""
    best = {("^"): (0, "")}

    def closure(ways):
        grown = True
        while grown:
            grown = False
            for state, (cost, audit) in list(ways.items()):
                for letter in "ua":
                    if (state, letter) in (("^", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                        way = cost + 3, audit + "I"
                        if letter not in ways or way < ways[letter]:
                            ways[letter], grown = way, True
        return ways
    best = closure(best)
    for t in turns:
        new = {}

        def offer(state, way):
            if state not in new or way < new[state]:
                new[state] = way
        for state, (cost, audit) in best.items():
            offer(state, (cost + 4, audit + "D"))
            if t != "x":
                extra = 3 if t.isupper() else 0
                for letter in "sua":
                    if (state, letter) in (("^", "s"), ("^", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                        if t.lower() == letter:
                            offer(letter, (cost + extra, audit + "K"))
                        elif letter != "s":
                            offer(letter, (cost + extra + 3, audit + "R"))
        best = closure(new)
    return min(best[e] for e in "^a" if e in best)


@lru_cache(maxsize=None)
def all_audits(turns, state="^", budget=16):
    """Every (cost, audit) within the budget, by plain recursion."""
    out = {(0, "")} if not turns and state in "^a" else set()
    steps = [(("^", "u"), "u"), (("s", "u"), "u"), (("u", "a"), "a"), (("a", "u"), "u")]
    if budget >= 3:
        out |= {(c + 3, "I" + a) for (s, _), e in steps if s == state for c, a in all_audits(turns, e, budget - 3)}
    if turns:
        t, rest = turns[0], turns[1:]
        if budget >= 4:
            out |= {(c + 4, "D" + a) for c, a in all_audits(rest, state, budget - 4)}
        if t != "x":
            for (s, _), e in [*steps, (("^", "s"), "s")]:
                cost = (3 if t.isupper() else 0) + (0 if t.lower() == e else 3)
                if s == state and cost <= budget and (t.lower() == e or e != "s"):
                    out |= {(c + cost, ("K" if t.lower() == e else "R") + a) for c, a in all_audits(rest, e, budget - cost)}
    return frozenset(out)


def test_alignment_against_search():
    rng = random.Random(3)
    for _ in range(300):
        turns = "".join(rng.choice("suauauaUAxoO") for _ in range(rng.randrange(5)))
        want = min(all_audits(turns))
        assert conversations.repair(turns) == want == brute(turns), turns
    for size in (10, 23, 24, 25, 60, 130):
        for _ in range(8):
            turns = "".join(rng.choice("suauauauauaUAxo") for _ in range(size))
            assert conversations.repair(turns) == brute(turns), turns


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] + "\0" + r[2]))
        seen, letters, counts = set(), "", {"x": 0, "d": 0, "t": 0}
        for _, role, text in kept:
            bare = text.strip(SPACE)
            head = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not bare:
                counts["x"] += 1
                letters += "x"
            elif (role, text) in seen:
                counts["d"] += 1
                letters += "x"
            elif bare[-1] not in ".!?":
                counts["t"] += 1
                letters += head.upper()
            else:
                letters += head
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        heads = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
        cost, audit = brute(letters)
        size, lines, at = len(audit) - audit.count("D"), [], 0
        for edit in audit:
            name = "assistant" if (len(lines) + size % 2) % 2 else "user"
            if edit == "I":
                lines.append(f"{name}:")
                continue
            _, role, text = kept[at]
            at += 1
            if edit != "D":
                lines.append(f"{role if edit == 'K' else name}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["x"], counts["d"], counts["t"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def sample():
    rng = random.Random(5)
    rows, words = [], ["Yes.", "No!", "why", "tell me more.", "", "  ", "a\nb?", "end. "]
    for conv in range(150):
        for turn in range(rng.randrange(9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.9 else rng.choice(["system", "tool", "", None, "usr"])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice([*words, f"text {turn}.", f"text {turn}", None])))
    rows += [(500, t, "user", f"only {t}.") for t in range(40)] + [(501, t % 7, "assistant", "same.") for t in range(60)]
    rows += [(None, t, ("user", "assistant")[t % 2], f"no id {t % 5}.") for t in range(30)] + [(502, None, None, None)] * 3
    rows += [(600, t, ("user", "assistant")[(t + t // 50) % 2], f"hot {t % 300}{'.' if t % 9 else ''}") for t in range(900)]
    return rows + [(503, 3, "user", "long " * 20_000 + "."), (503, 4, "assistant", "fine.")]


@pytest.mark.parametrize("piece", [conversations.PIECE, 7])
def test_rows_against_plain_version(spark, piece):
    rows = sample()
    df = spark.createDataFrame([(t, x, r, c, 1) for c, t, r, x in rows], "turn int, text string, role string, conv_id long, CONV string").repartition(9)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repaired(df, piece).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    wrong = [c for c in want if got[c] != want[c]]
    assert not wrong, [(c, got[c], want[c]) for c in wrong[:3]]


def test_conversations_over_partitions(spark):
    """One conversation holds a third of all rows and copies; partitions cut conversations."""
    rows = [(7, t // 3, ("user", "assistant")[t % 2], f"turn {t % 2000} of a long one.") for t in range(3000)]
    rows += [(8, 1, "user", "copy.")] * 500 + [(c, t, ("user", "assistant")[t % 2], f"x{t}.") for c in range(20, 520) for t in range(6)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        got = {r.conv_id: tuple(r)[1:] for r in conversations.repaired(df, 64).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == expected(rows)


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repaired(spark.createDataFrame([], schema)).collect() == []
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = conversations.repaired(spark.createDataFrame([(1, turn, "user", "gone.")], schema)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
