"""Repair of conversation structure by alignment to the grammar ``(s?(ua)+)?``.

The turns of a conversation are a string of role initials, and so is every
conversation the grammar allows; of each length there is at most one. The turns
are aligned to every feasible length by Wagner and Fischer's table of edit costs,
within Ukkonen's band: a cell counts only if the deletions and insertions that
lead there and on cost no more than the best alignment so far. Backtracing gives
the edits, and of equally cheap ones over all lengths the ASCII-least audit.

Rows are sorted by conversation and turn over range partitions, so a conversation
may span some. The conversations that lie inside of a partition are repaired as
the sorted rows stream by. Those at its borders, at most two a partition, are cut
into pieces; a piece is aligned to the strings that lead from any grammar state to
any other, and the cheapest chain of pieces is their alignment. (Two audits of the
same rows, states and cost are never a beginning of each other, as what follows
would cost something; so the least of each piece is enough.) Longer conversations
within a partition go through the same pieces in memory.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.llm.common import pick, saved

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\v\f\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
#: Last letter written: none yet, system, user, assistant.
STATES = "^sua"
#: Turns in one alignment; beyond, pieces are chained. Rows of a border conversation in one piece record.
LONGEST = 24
PIECE = 4096
PREFIX = 64
FLUSH = 8_192


def target(start: str, end: str, length: int) -> str | None:
    """The string of this length that leads from one state to the other, if there is one."""
    if not length:
        return "" if start == end else None
    if end == "s":
        return "s" if start == "^" and length == 1 else None
    if end == "^":
        return None
    line = ("ua" * length)[-length:] if end == "a" else ("au" * length)[-length:]
    if start == "^":
        return line if line[0] == "u" else "s" + line[1:] if length > 1 else None
    return line if line[0] == ("a" if start == "u" else "u") else None


def table(turns: str, line: str, before: int, after: int) -> list[dict[int, int]]:
    """Costs from each cell (turns read, letters written) to the end, within the band.

    ``before`` is how many letters the writing may lag behind the turns that may
    stay, ``after`` how many it may be ahead.
    """
    live = [0]
    for t in turns:
        live.append(live[-1] + (t != "x"))
    size = len(line)
    cells: list[dict[int, int]] = [{} for _ in range(len(turns) + 1)]
    for i in range(len(turns), -1, -1):
        row, below = cells[i], cells[i + 1] if i < len(turns) else {}
        for j in range(min(size, live[i] + after), max(0, live[i] - before) - 1, -1):
            best = 0 if i == len(turns) and j == size else None
            options = [row[j + 1] + INSERT] if j + 1 in row and line[j] != "s" else []
            if j in below:
                options.append(below[j] + DELETE)
            if j + 1 in below and (cost := keep(turns[i], line[j])) is not None:
                options.append(below[j + 1] + cost)
            if options:
                best = min(options) if best is None else min(best, *options)
            if best is not None:
                row[j] = best
    return cells


def keep(turn: str, letter: str) -> int | None:
    """Cost of writing a letter for a turn: x has to go, capitals are truncated."""
    if turn == "x":
        return None
    cost = TRUNCATED if turn.isupper() else 0
    if turn.lower() == letter:
        return cost
    return None if letter == "s" else cost + REROLE


def backtrace(turns: str, line: str, cells: list[dict[int, int]]) -> str:
    """The ASCII-least of the cheapest edits."""
    i, j, out = 0, 0, []
    while i < len(turns) or j < len(line):
        here = cells[i][j]
        if i < len(turns) and cells[i + 1].get(j) == here - DELETE:
            out.append("D")
            i += 1
        elif j < len(line) and line[j] != "s" and cells[i].get(j + 1) == here - INSERT:
            out.append("I")
            j += 1
        else:
            out.append("K" if turns[i].lower() == line[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


@lru_cache(maxsize=100_000)
def align(turns: str, start: str = "^", end: str = "a") -> tuple[int, str] | None:
    """Cheapest cost and least audit over all lengths that lead from ``start`` to ``end``."""
    gone = turns.count("x")
    stay, found = len(turns) - gone, None
    least = lambda n: DELETE * gone + (INSERT * (n - stay) if n > stay else DELETE * (stay - n))
    for size in sorted(range(stay + (DELETE * stay + 9) // INSERT + 1), key=least):
        if found and least(size) > found[0]:
            break
        line = target(start, end, size)
        if line is None:
            continue
        before, after = stay, size
        if found:  # a deletions and a + size - stay insertions must not cost more than the incumbent
            before = (found[0] - DELETE * gone - INSERT * (size - stay)) // (DELETE + INSERT)
            after = before + size - stay
        if before < 0 or after < 0:
            continue
        cells = table(turns, line, before, after)
        cost = cells[0].get(0)
        if cost is not None and (not found or cost <= found[0]):
            audit = backtrace(turns, line, cells)
            found = min(found, (cost, audit)) if found else (cost, audit)
    return found


def step(ways: dict[str, tuple[int, str]], piece) -> dict[str, tuple[int, str]]:
    """Best ways to each state after one more piece; ``piece(start, end)`` is its alignment."""
    out: dict[str, tuple[int, str]] = {}
    for start, (cost, audit) in ways.items():
        for end in STATES:
            if (more := piece(start, end)) is not None:
                way = cost + more[0], audit + more[1]
                out[end] = min(out.get(end, way), way)
    return out


def walk(turns: str, start: str = "^") -> dict[str, tuple[int, str]]:
    ways = {start: (0, "")}
    for at in range(0, len(turns), LONGEST):
        ways = step(ways, lambda s, e, part=turns[at:at + LONGEST]: align(part, s, e))
    return ways


def repair(turns: str) -> tuple[int, str]:
    if len(turns) <= LONGEST:
        return min(x for x in (align(turns, "^", "^"), align(turns, "^", "a")) if x)
    return min(way for end, way in walk(turns).items() if end in "^a")


class Digest:
    """The repaired conversation, fed with rows in order: its SHA-256 alone is kept."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.written = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2
        self.sha = hashlib.sha256()

    def write(self, line: str) -> None:
        self.sha.update(("\n" + line if self.written else line).encode())
        self.written += 1

    def role(self) -> str:
        return "assistant" if (self.written + self.odd) % 2 else "user"

    def inserts(self) -> None:
        while self.audit.startswith("I", self.at):
            self.write(f"{self.role()}:")
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self.write(f"{role if edit == 'K' else self.role()}:{text}")

    def close(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


class Facts:
    """Counts of a stretch of rows in order, and its turns as letters."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.letters: list[str] = []

    def add(self, turn, role: str, text: str, n: int, seen: bool) -> None:
        if not n:
            return
        bare, head = text.strip(SPACE), role[:1]
        if self.last is not None and self.last + head not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.first, self.last = head if self.first is None else self.first, head
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if not bare:
            self.blank += n
            self.letters.append("x" * n)
            return
        self.duplicate += n - (not seen)
        letter = "x"
        if not seen:
            cut = not bare.endswith(ENDS)
            self.truncated += cut
            letter = head if head in ("s", "u", "a") else "o"
            letter = letter.upper() if cut else letter
        self.letters.append(letter + "x" * (n - 1))

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def flat(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def streams(batches, names: list[str]):
    """Rows of sorted batches, as tuples of the named columns."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
ROW = "turn long, role string, text string, n long, part int, pos long"
EMPTY = (None,) * 8


def inside(schema: pa.Schema):
    """Sorted rows of a range partition to results, and the rows of its first and last conversation as they are."""
    def solve(conv, rows: list[tuple]) -> tuple:
        facts, seen = Facts(), set()
        for turn, role, text, n, _ in rows:
            facts.add(turn, role, text, n, (role, text) in seen)
            seen.add((role, text))
        cost, audit = repair("".join(facts.letters))
        digest = Digest(audit)
        for _, role, text, n, _ in rows:
            digest.row(role, text, n)
        return (conv, facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, digest.close(), *(None,) * 6)

    def run(batches):
        part = TaskContext.get().partitionId()
        out, rows, conv, first, pos = [], [], None, None, 0
        for c, turn, role, text, n in streams(batches, ["conv_id", "turn", "role", "text", "n"]):
            if first is None or c != conv:
                if rows:
                    out.append(solve(conv, rows))
                    rows = []
                conv, first = c, first is None
            if first:
                out.append((c, *EMPTY, turn, role, text, n, part, pos))
            else:
                rows.append((turn, role, text, n, pos))
            pos += 1
            if len(out) >= FLUSH:
                yield flat(out, schema)
                out = []
        out += [(conv, *EMPTY, *row[:4], part, row[4]) for row in rows]
        yield flat(out, schema)
    return run


PIECES = ("blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, "
          "cost array<long>, audit array<string>")


def pieces(schema: pa.Schema):
    """Sorted rows to one record per piece: counts, and the alignment from each state to each state."""
    def record(key, facts: Facts) -> tuple:
        turns, cost, audit = "".join(facts.letters), [], []
        for start in STATES:
            ways = walk(turns, start)
            cost += [ways.get(e, (None, None))[0] for e in STATES]
            audit += [ways.get(e, (None, None))[1] for e in STATES]
        return (*key, facts.blank, facts.duplicate, facts.truncated, facts.illegal, facts.turns, facts.low, facts.high, facts.first, facts.last, cost, audit)

    def run(batches):
        facts, key = None, None
        for conv, part, piece, turn, role, text, n, seen in streams(batches, ["conv_id", "part", "piece", "turn", "role", "text", "n", "seen"]):
            if facts is None or (conv, part, piece) != key:
                if facts:
                    yield flat([record(key, facts)], schema)
                facts, key = Facts(), (conv, part, piece)
            facts.add(turn, role, text, n, seen)
        if facts:
            yield flat([record(key, facts)], schema)
    return run


def chained(schema: pa.Schema):
    """Piece records of a conversation in order to its result, but for the hash."""
    def close(conv, total: list[int], low, high, turns: int, ways) -> tuple:
        cost, audit = min(way for end, way in ways.items() if end in "^a")
        return (conv, high - low + 1 - turns if turns else 0, *total, cost, audit)

    def run(batches):
        here, names = None, ["conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "cost", "audit"]
        for conv, *counts, turns, low, high, first, last, cost, audit in streams(batches, names):
            if here is None or here[0] != conv:
                if here:
                    yield flat([close(*here)], schema)
                here, tail = [conv, [0, 0, 0, 0], None, None, 0, {"^": (0, "")}], None
            here[1] = [a + b for a, b in zip(here[1], counts)]
            if first is not None:
                here[1][3] += tail is not None and tail + first not in LEGAL
                tail = last
            if turns:
                here[4] += turns - (low == here[3])
                here[2], here[3] = low if here[2] is None else here[2], high
            at = lambda s, e: 4 * STATES.index(s) + STATES.index(e)
            here[5] = step(here[5], lambda s, e: None if cost[at(s, e)] is None else (cost[at(s, e)], audit[at(s, e)]))
        if here:
            yield flat([close(*here)], schema)
    return run


def hashed(schema: pa.Schema):
    """A conversation's audit, then its rows in order, to the hash of what the audit makes of them."""
    def run(batches):
        digest, conv = None, None
        for c, audit, role, text, n in streams(batches, ["conv_id", "audit", "role", "text", "n"]):
            if audit is not None:
                if digest:
                    yield flat([(conv, digest.close())], schema)
                digest, conv = Digest(audit), c
            else:
                digest.row(role, text, n)
        if digest:
            yield flat([(conv, digest.close())], schema)
    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) after damage, equal ones counted; a dropped row leaves its conversation with n 0."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")), F.lit(20))
    rows = rows.withColumn("kind", kind).withColumn("text", F.coalesce("text", F.lit(" "))).withColumn("role", F.coalesce("role", F.lit(" ")))
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def repaired(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text is one space, a null turn comes first, a null conv_id is a
    conversation of its own. Turns of one number are in order of role and text; equal
    rows are all there, each but the first a duplicate. Initials other than s, u and a,
    and empty roles, are no letter of the grammar. A conversation whose rows the damage
    drops gives zeros, an empty audit and the hash of the empty string. A conversation
    may be longer than a task holds; only its audit is one value. An empty table gives
    no rows. Other columns are not read.
    """
    rows = damaged(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "place", "role", "text"]
    # range bounds hold a beginning of role and text, never a whole text
    rows = rows.withColumn("place", F.substring(F.concat("role", F.lit("\0"), "text"), 1, PREFIX))
    rows = rows.repartitionByRange("conv_id", "turn", "place").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n")

    def stage(df: DataFrame, make, schema: str) -> DataFrame:
        spec = f"conv_id {kind}, {schema}"
        empty = df.sparkSession.createDataFrame([], spec)
        return df.mapInArrow(make(to_arrow_schema(empty.schema)), spec)

    done = saved(stage(rows, inside, f"{RESULT}, {ROW}"), "conversations")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole, rest = done.filter("part IS NULL").select(*names), done.filter("part IS NOT NULL").select("conv_id", "turn", "role", "text", "n", "part", "pos")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rest = rest.withColumn("said", said)
    first = rest.filter("n > 0").groupBy("conv_id", "said").agg(F.min(F.struct("part", "pos")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "at")
    marked = rest.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    marked = marked.withColumn("seen", F.coalesce(F.struct("part", "pos") > F.col("at"), F.lit(False)))
    marked = marked.withColumn("piece", F.floor(F.col("pos") / piece)).select("conv_id", "part", "piece", "pos", "turn", "role", "text", "n", "seen")
    marked = marked.repartition("conv_id", "part", "piece").sortWithinPartitions("conv_id", "part", "piece", "pos")
    records = stage(marked, pieces, f"part int, piece long, {PIECES}")
    records = records.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    ends = saved(stage(records, chained, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "chains")
    lines = ends.select("conv_id", "audit", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("pos"))
    lines = lines.unionByName(rest.select("conv_id", "part", "pos", "role", "text", "n"), allowMissingColumns=True)
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    sums = stage(lines, hashed, "repaired_sha256 string").withColumnRenamed("conv_id", "c")
    border = ends.join(sums, F.col("conv_id").eqNullSafe(F.col("c"))).select(*names)
    return whole.unionByName(border)
