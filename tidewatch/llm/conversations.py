"""Conversation structure repair: cheapest edits that make roles alternate, by a retained-subsequence DP."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

WHITE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, CUT_OFF, MUST_GO = 0, 1, 2
FAR = 1 << 60
STATES = "0sua"  # of an output so far: nothing, or the initial of its last role
INSERTS = {("0", "s"): 0, ("0", "u"): 0, ("0", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
LAST_INSERTS = {"0": 0, "s": 2, "u": 1, "a": 0}
NAMES = {"u": "user", "a": "assistant"}
CHUNK = 1 << 20


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows as damaged by the hash of their key, n times each. Rows that are dropped are missing; nulls of the
    other columns are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), how.alias("how")).where("how <> 0")
    changed = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """rows, equal ones as one of which n is the sum, with `at`, their place in the order of all (conversation, turn, role, text), and `part`: a
    saved table, sorted by ranges, so that a conversation of any length is dealt over as many tasks as its rows need. A part is what
    one task had of it. Null turns come first."""
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    ranged = equal.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return saved(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, part, at, turn, initial, kind, n, blank, duplicate, truncated) of rows in order, without their texts.

    A row's copies come right after it. Where a role and text was seen before is known from the first place of its 128-bit hash, of which only those
    that are there twice are joined."""
    plain = F.rtrim(F.col("text"), F.lit(WHITE))
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    light = rows.select("conv_id", "part", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "n", (plain == "").alias("empty"), (~F.right(plain, F.lit(1)).isin(".", "!", "?")).alias("open"), *hashes)
    firsts = light.groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    both = light.join(firsts.withColumnsRenamed({"conv_id": "c", "h1": "g1", "h2": "g2"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    seen = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    kind = F.when(F.col("empty") | seen, MUST_GO).when(F.col("open"), CUT_OFF).otherwise(FINE)
    both = both.withColumns({"kind": kind, "blank": F.when(F.col("empty"), F.col("n")).otherwise(0), "duplicate": F.when(F.col("empty"), 0).when(seen, F.col("n")).otherwise(F.col("n") - 1), "truncated": (kind == CUT_OFF).cast("long")})
    return both.select("conv_id", "part", "at", "turn", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x").alias("initial"), "kind", "n", "blank", "duplicate", "truncated")


def plans(initials: list[str], kinds: list[int], copies: list[int], target: str | None = None, begin: str = STATES) -> dict[str, tuple[int, str]]:
    """For each state in which rows may begin: the least cost and its ASCII-least audit, with the output ending in the target state; without a target
    the output is whole and closed by inserts.

    Which row is retained next, as what, is chosen from the end on. With prefix sums of deletions, what a retained row costs beyond
    all later deletions does not depend on the row retained before it but for the inserts between their roles, so a running minimum
    for each state prices all gaps. Of equal ones the later row is taken (its audit goes on with D), and of one row's the
    ASCII-least letters; two audits of as many rows are never one the other's beginning."""
    m = len(kinds)
    gone = [0] * (m + 1)
    for j in range(m):
        gone[j + 1] = gone[j] + DELETE * copies[j]
    low: dict[str, tuple] = {}
    for r in STATES:
        closing = LAST_INSERTS[r] if target is None else 0 if r == target else None
        low[r] = (FAR, m, "", "", None) if closing is None else (gone[m] + INSERT * closing, m, "I" * closing, "", None)
    for j in range(m - 1, -1, -1):
        if kinds[j] == MUST_GO:
            continue
        own = DELETE * (copies[j] - 1) + (TRUNCATED if kinds[j] == CUT_OFF else 0) + gone[j] - gone[j + 1]
        retained = []
        if initials[j] != "x":
            retained.append((low[initials[j]][0] + own, "K", initials[j]))
        retained += [(low[r][0] + own + REROLE, "R", r) for r in "ua" if r != initials[j]]
        new = {}
        for r, best in low.items():
            for cost, letter, to in retained:
                inserts = INSERTS.get((r, to))
                if inserts is None or cost >= FAR:
                    continue
                said = "I" * inserts + letter
                cost += INSERT * inserts
                if cost < best[0] or cost == best[0] and best[1] == j and said < best[2]:
                    best = (cost, j, said, to, low[to])
            new[r] = best
        low = new
    out = {}
    for r in begin:
        if low[r][0] >= FAR:
            continue
        audit, at, step = [], 0, low[r]
        while True:
            _, j, said, _, following = step
            audit.append("D" * sum(copies[at:j]) + said)
            if following is None:
                break
            audit.append("D" * (copies[j] - 1))
            at, step = j + 1, following
        out[r] = (low[r][0], "".join(audit))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of equal keys that follow one another, over batches."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(r)
    if rows:
        yield now, rows


PLAN = "part bigint, many boolean, begin string, finish string, cost bigint, audit string, illegal bigint, first string, last string"


def part_plans(light: DataFrame) -> DataFrame:
    """The plan of each conversation that is in one part, and for the others their parts' plans from each state to each."""
    spread = light.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("conv_id").alias("c"), F.lit(True).alias("many"))
    # a part has two conversations at most that go on beyond it, so these are fewer than parts
    marked = light.join(F.broadcast(spread), F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", "part", "at", "initial", "kind", "n", F.coalesce("many", F.lit(False)).alias("many"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (conversation, part), rows in _groups(batches, ("conv_id", "part")):
            initials, kinds, copies = ([r[c] for r in rows] for c in ("initial", "kind", "n"))
            pairs = {"su", "ua", "au"}
            illegal = sum(copies) - len(rows) + sum(a + b not in pairs for a, b in zip(initials, initials[1:], strict=False))
            shared = {"conv_id": conversation, "part": part, "many": rows[0]["many"], "illegal": illegal, "first": initials[0], "last": initials[-1]}
            for target in STATES if rows[0]["many"] else [None]:
                for begin, (cost, audit) in plans(initials, kinds, copies, target, STATES if target else "0").items():
                    out.append(shared | {"begin": begin, "finish": target, "cost": cost, "audit": audit})
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = _schema(light, PLAN)
    dealt = marked.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    return dealt.mapInArrow(run, _spark(light, PLAN))


def _spark(df: DataFrame, rest: str) -> T.StructType:
    return T.StructType([df.schema["conv_id"], *T._parse_datatype_string(rest)])


def _schema(df: DataFrame, rest: str) -> pa.Schema:
    """Arrow's schema of conv_id and the rest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_spark(df, rest))


def chosen(parts: DataFrame) -> DataFrame:
    """The plans of conversations in several parts: of each part the one that lies on the cheapest way from nothing to a closed output, ASCII-least audits
    where ways cost the same. A conversation has as many rows here as parts and pairs of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_,), rows in _groups(batches, ("conv_id",)):
            steps: dict[int, dict[tuple[str, str], dict]] = {}
            for r in rows:
                steps.setdefault(r["part"], {})[r["begin"], r["finish"]] = r
            order = sorted(steps)
            rest = {s: INSERT * n for s, n in LAST_INSERTS.items()}
            ways = []
            for part in reversed(order):
                way: dict[str, tuple[int, str, str]] = {}
                for (begin, finish), r in steps[part].items():
                    closing = LAST_INSERTS[finish] if part == order[-1] else 0
                    if rest.get(finish, FAR) < FAR:
                        way[begin] = min(way.get(begin, (FAR, "", "")), (r["cost"] + rest[finish], r["audit"] + "I" * closing, finish))
                ways.append(way)
                rest = {s: w[0] for s, w in way.items()}
            state, last, out = "0", None, []
            for part, way in zip(order, reversed(ways), strict=True):
                _, audit, finish = way[state]
                r = steps[part][state, finish]
                cost = r["cost"] + (INSERT * LAST_INSERTS[finish] if part == order[-1] else 0)
                crossing = int(last is not None and last + r["first"] not in ("su", "ua", "au"))
                out.append(r | {"audit": audit, "cost": cost, "illegal": r["illegal"] + crossing})
                state, last = finish, r["last"]
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = _schema(parts, PLAN)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, _spark(parts, PLAN))


class Repair:
    """One conversation's part as it is read: its lines are hashed, or gathered where other parts go on with it."""

    def __init__(self, conversation: object, part: int, many: bool, state: str, audit: str) -> None:
        self.at, self.state, self.audit, self.many = 0, state, audit, many
        self.shared = {"conv_id": conversation, "part": part}
        self.lines, self.pieces, self.digest, self.begun = bytearray(), 0, hashlib.sha256(), False

    def _turn(self) -> str:
        self.state = "a" if self.state == "u" else "u"
        return NAMES[self.state]

    def _add(self, line: str) -> None:
        if self.many:
            self.lines += line.encode() + b"\n"
        else:
            self.digest.update((b"\n" if self.begun else b"") + line.encode())
        self.begun = True

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add(f"{self._turn()}:")
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        self.inserts()
        letter = self.audit[self.at]
        if letter == "K":
            self.state = role[:1]
            self._add(f"{role}:{text}")
        elif letter == "R":
            self._add(f"{self._turn()}:{text}")
        self.at += n

    def piece(self, done: bool) -> list[dict]:
        if done:
            self.inserts()
        if not self.many:
            return [self.shared | {"piece": 0, "lines": None, "sha256": self.digest.hexdigest()}] if done else []
        if not done and len(self.lines) < CHUNK:
            return []
        out = [self.shared | {"piece": self.pieces, "lines": bytes(self.lines), "sha256": None}]
        self.lines, self.pieces = bytearray(), self.pieces + 1
        return out


PIECE = "part bigint, piece bigint, lines binary, sha256 string"


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, part, piece, lines, sha256): a conversation's repaired rows as lines `role:text`, in pieces of about CHUNK bytes; or, if one part has all of
    it, their hash. A part's plan is read before its rows, and each text by itself."""
    head = plan.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), F.col("begin").alias("role"), F.col("audit").alias("text"), F.col("many").cast("long").alias("n"))
    body = rows.select("conv_id", "part", "at", "role", "text", F.col("n").cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        for b in batches:
            out: list[dict] = []
            for conversation, part, at, role, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at < 0:
                    out += now.piece(done=True) if now else []
                    now = Repair(conversation, part, bool(n), role, text)
                else:
                    now.row(role, text, n)
                    out += now.piece(done=False)
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist(now.piece(done=True), schema)

    schema = _schema(rows, PIECE)
    dealt = head.unionByName(body).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    return dealt.mapInArrow(run, _spark(rows, PIECE))


def whole(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, sha256) of conversations in several parts: audits joined, pieces hashed one after the other, as the hash is defined."""
    rest = "audit string, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, begun = None, [], hashlib.sha256(), False
        for b in batches:
            out = []
            for conversation, lines, said in zip(*(b.column(c).to_pylist() for c in ("conv_id", "lines", "audit")), strict=True):
                if now is None or now[0] != conversation:
                    out += [{"conv_id": now[0], "audit": "".join(audit), "sha256": digest.hexdigest()}] if now else []
                    now, audit, digest, begun = (conversation,), [], hashlib.sha256(), False
                audit.append(said or "")
                if lines:
                    digest.update((b"\n" if begun else b"") + lines[:-1])
                    begun = True
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([{"conv_id": now[0], "audit": "".join(audit), "sha256": digest.hexdigest()}], schema)

    schema = _schema(pieces, rest)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(run, _spark(pieces, rest))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations (conv_id, turn, role, text, n), n being how
    often a row is there.

    Order: turn (nulls first), role, text; equal rows follow one another. Conversations may be of any length: a plan is made for each part of one
    that a task has, from each state to each, and parts' plans are then chained. Null keys are one conversation; empty in, empty out."""
    ordered = in_order(rows)
    light = saved(faults(ordered))
    parts = saved(part_plans(light))
    plan = saved(parts.where("not many").unionByName(chosen(parts.where("many"))))
    pieces = saved(repaired(ordered, plan))
    said = pieces.where("sha256 is null").join(plan.where("many").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "audit"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("piece") == 0), "left")
    joined = whole(said.select("conv_id", "part", "piece", "lines", "audit"))
    single = pieces.where("sha256 is not null").select("conv_id", "sha256").join(plan.where("not many").select(F.col("conv_id").alias("c"), "audit"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    turns = light.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    sums = plan.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    out = turns
    for other in (sums, single.unionByName(joined).withColumnRenamed("sha256", "repaired_sha256")):
        out = out.join(other.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its rows' hashes and repaired; one of which nothing was left is empty."""
    df = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(df))
    every = df.select(F.col("conv_id").alias("c")).distinct()
    out = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("c").alias("conv_id"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _plus(x: str, cost: int | str, letter: str) -> str:
    """SQL of a cost and audit, written as one string, after another edit."""
    return f"printf('%012d', CAST(left({x}, 12) AS BIGINT) + {cost}) || '{letter}' || substr({x}, 13)"


def _edits(state: str, to: str, keeps: tuple[str, ...]) -> str:
    """SQL of the least of deleting a row, keeping it in one of its own roles, and reroling it to what a state asks for."""
    more = f"CASE kind WHEN {CUT_OFF} THEN {TRUNCATED} ELSE 0 END"
    kept = ", ".join(f"CASE WHEN kind < {MUST_GO} AND initial = '{k}' THEN {_plus(f'b{k}', more, 'K')} END" for k in keeps)
    return f"least({_plus(state, DELETE, 'D')}, {kept}, CASE WHEN kind < {MUST_GO} THEN {_plus(f'b{to}', f'({REROLE} + {more})', 'R')} END)"


OP11_SQL = f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, x: list_reduce(list_prepend(xor(h, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda g, _z: CASE WHEN g % 2 = 1 THEN xor(g >> 1, CAST(3988292384 AS BIGINT)) ELSE g >> 1 END)), CAST(4294967295 AS BIGINT)) % 20 AS how FROM src),
dmg AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE how > 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
ord AS MATERIALIZED (SELECT c, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS closed FROM dmg JOIN ids ON dmg.conv_id IS NOT DISTINCT FROM ids.conv_id),
flt AS MATERIALIZED (SELECT *, CASE WHEN blank OR dup THEN {MUST_GO} WHEN NOT closed THEN {CUT_OFF} ELSE {FINE} END AS kind FROM (SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS dup, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM ord)),
dp AS (SELECT c, max(i) AS i, printf('%012d', 0) AS b0, printf('%012d', {2 * INSERT}) || 'II' AS bs, printf('%012d', {INSERT}) || 'I' AS bu, printf('%012d', 0) AS ba FROM flt GROUP BY 1
UNION ALL SELECT c, i, least(h0, {_plus("g", INSERT, "I")}), least(hs, {_plus("g", INSERT, "I")}), g, least(ha, {_plus("hu", INSERT, "I")}) FROM (
  SELECT *, least(hu, {_plus("ha", INSERT, "I")}) AS g FROM (
    SELECT dp.c, dp.i - 1 AS i, {_edits("b0", "u", ("s", "u"))} AS h0, {_edits("bs", "u", ("u",))} AS hs, {_edits("bu", "a", ("a",))} AS hu, {_edits("ba", "u", ("u",))} AS ha FROM dp JOIN flt ON flt.c = dp.c AND flt.i = dp.i))),
pln AS (SELECT c, CAST(left(b0, 12) AS BIGINT) AS cost, substr(b0, 13) AS audit FROM dp WHERE i = 0),
ltr AS (SELECT c, unnest(string_split(audit, '')) AS l, unnest(range(1, length(audit) + 1)) AS p FROM pln WHERE audit <> ''),
pos AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS o FROM ltr WINDOW w AS (PARTITION BY c ORDER BY p)),
lin AS (SELECT pos.c, p, l, o, role, text, bool_or(o = 1 AND l = 'K' AND initial = 's') OVER (PARTITION BY pos.c) AS s FROM pos LEFT JOIN flt ON flt.c = pos.c AND flt.i = pos.i),
txt AS (SELECT c, string_agg(CASE WHEN l = 'K' THEN role ELSE CASE WHEN (o - CASE WHEN s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body FROM lin WHERE l <> 'D' GROUP BY 1),
cnt AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (kind = {CUT_OFF}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN cnt ON cnt.c = ids.c LEFT JOIN pln ON pln.c = ids.c LEFT JOIN txt ON txt.c = ids.c"""
