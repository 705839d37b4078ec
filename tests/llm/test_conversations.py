"""Conversation repair against a plain edit search."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tidewatch.llm.conversations import CUT_OFF, DELETE, FINE, INSERT, LAST_INSERTS, MUST_GO, REROLE, STATES, OP11_SQL, TRUNCATED, op11_repair, plans, repair_conversations

WHITE = " \t\n\v\f\r"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def search(initials, kinds):
    """Least (cost, audit) of edits by letters, from each state at the end backwards; audits are compared whole."""
    m = len(kinds)
    best = {(m, s): (INSERT * n, "I" * n) for s, n in LAST_INSERTS.items()}
    for j in range(m - 1, -1, -1):
        here = {}
        for s in STATES:
            ways = [(best[j + 1, s][0] + DELETE, "D" + best[j + 1, s][1])]
            if kinds[j] != MUST_GO:
                more = TRUNCATED if kinds[j] == CUT_OFF else 0
                for r, letter, cost in [(initials[j], "K", 0), ("u", "R", REROLE), ("a", "R", REROLE)]:
                    if (s, r) in NEXT:
                        after = best[j + 1, r]
                        ways.append((after[0] + cost + more, letter + after[1]))
            here[s] = min(ways)
        for _ in range(3):
            for s in STATES:
                for r in "ua":
                    if (s, r) in NEXT:
                        here[s] = min(here[s], (here[r][0] + INSERT, "I" + here[r][1]))
        best |= {(j, s): v for s, v in here.items()}
    return best[0, "0"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = "".join(c for c in text if c not in ".!?")
        if how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain(rows, damaging=True):
    after, out = damage(rows) if damaging else rows, []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, kinds, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(WHITE)[-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append(CUT_OFF if fault == "truncated" else MUST_GO if fault else FINE)
            if fault:
                counts[fault] += 1
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = search(initials, kinds)
        lines, state, i = [], "0", 0
        for letter in audit:
            if letter in "IR":
                state = "a" if state == "u" else "u"
                lines.append(("user:" if state == "u" else "assistant:") + (own[i][3] if letter == "R" else ""))
            elif letter == "K":
                state = initials[i]
                lines.append(f"{own[i][2]}:{own[i][3]}")
            i += letter != "I"
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_plans_equal_search():
    rng = random.Random(1)
    for _ in range(4000):
        n = rng.randrange(0, 9)
        initials, kinds = [rng.choice("suuaax") for _ in range(n)], [rng.choice([FINE, FINE, FINE, CUT_OFF, MUST_GO]) for _ in range(n)]
        assert plans(initials, kinds, [1] * n)["0"] == search(initials, kinds)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in op11_repair(spark, sf).select(*COLUMNS).collect()), key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_odd_rows_and_long_conversations(spark, tmp_path, hot):
    rng = random.Random(4)
    texts = ["", " ", "\t\n", "yes", "yes.", "Is it? ", "no!\x0b", "one\ntwo.", "é", "", None, "x" * 5000 + "."] + [f"{i}." for i in range(40)]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    if hot:
        rows += [(99, t, rng.choice(roles[:5]), rng.choice(texts + [f"turn {t}."] * 60)) for t in range(3000)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, n int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op11_repair(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)
    assert got == plain(rows)
    if not hot:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall(), key=str)


def test_parts(spark):
    """A conversation over several parts: with tiny shuffle partitions that are not put together."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {n: spark.conf.get(n, None) for n in names}
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}!"])) for t in range(200)] + [(2, t, "user", f"{t}.") for t in range(40)] + [(3, 0, "assistant", "")]
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
        got = sorted((tuple(r) for r in repair_conversations(df).select(*COLUMNS).collect()), key=str)
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert got == plain(rows, damaging=False)


def test_empty(spark):
    assert repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, n int")).collect() == []
