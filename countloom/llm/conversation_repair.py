"""Conversations brought back to alternating turns by the cheapest edits; edit lists are linked nodes that share prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import arrow_rows, columns_of, stash

BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5  # costs; CUT is added for a truncated row that is not deleted
#: States of the repaired prefix: empty, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a row whose role the edit may choose
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Strings as nodes: each holds a letter and its parent, so that strings with a common prefix share its nodes.

    ``up[j][node]`` is the ancestor 2**j letters before (node 0, the empty string, where there is none), and every node
    has the rolling hash of its whole string. Two strings are compared by a search for their longest common prefix over
    the ancestors' hashes. Prefixes that hash alike are verified letter by letter, up to a node they share or a pair that
    was verified before; if they differ, the strings are compared in full.
    """

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]
        self._same: set[tuple[int, int]] = set()

    def add(self, node: int, letter: str) -> int:
        new, depth = len(self.letter), self.depth[node] + 1
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % self.prime)
        self.up[0].append(node)
        for j in range(1, len(self.up)):
            self.up[j].append(self.up[j - 1][self.up[j - 1][new]])
        while 1 << len(self.up) <= depth:  # no earlier node is that deep
            top = self.up[-1]
            self.up.append([0] * new + [top[top[new]]])
        return new

    def _lift(self, node: int, depth: int) -> int:
        j, more = 0, self.depth[node] - depth
        while more:
            if more & 1:
                node = self.up[j][node]
            more >>= 1
            j += 1
        return node

    def _verified(self, a: int, b: int) -> bool:
        seen = []
        while a != b and (a, b) not in self._same:
            if self.letter[a] != self.letter[b]:
                return False
            seen.append((a, b))
            a, b = self.up[0][a], self.up[0][b]
        self._same.update(seen)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's in code-point order; a proper prefix comes first."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, depth), self._lift(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._verified(x, y):
                return self.depth[a] < self.depth[b]
            return self.spell(a) < self.spell(b)
        for j in range(len(self.up) - 1, -1, -1):
            p, q = self.up[j][x], self.up[j][y]
            if self.hash[p] != self.hash[q]:
                x, y = p, q
        if self._verified(self.up[0][x], self.up[0][y]):
            return self.letter[x] < self.letter[y]
        return self.spell(a) < self.spell(b)

    def spell(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[0][node]
        return "".join(reversed(out))


class Repair:
    """The cheapest edits from one state to every state over the rows fed so far, of equal costs the least edit list."""

    def __init__(self, start: int = START):
        self.audits = Audits()
        self.cells: list[tuple[int, int] | None] = [None] * 4
        self.cells[start] = (0, 0)
        self._insert(self.cells)

    def _offer(self, cells: list, state: int, cost: int, node: int, letter: str) -> bool:
        had = cells[state]
        if had is None or cost < had[0]:
            cells[state] = (cost, self.audits.add(node, letter))
            return True
        if cost == had[0]:
            new = self.audits.add(node, letter)
            if self.audits.less(new, had[1]):
                cells[state] = (cost, new)
                return True
        return False

    def _insert(self, cells: list) -> None:
        again = True
        while again:
            again = False
            for state in range(4):
                if cells[state] is not None:
                    cost, node = cells[state]
                    had = cells[NEXT[state]]
                    if (had is None or cost + INSERT <= had[0]) and self._offer(cells, NEXT[state], cost + INSERT, node, "I"):
                        again = True

    def feed(self, initial: str, must_go: bool, truncated: bool) -> None:
        after: list[tuple[int, int] | None] = [None] * 4
        extra = CUT if truncated else 0
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node = cell
            self._offer(after, state, cost + DELETE, node, "D")
            if not must_go:
                kept = KEEPS.get((state, initial))
                if kept is not None:
                    self._offer(after, kept, cost + extra, node, "K")
                self._offer(after, NEXT[state], cost + REROLE + extra, node, "R")
        self._insert(after)
        self.cells = after

    def results(self) -> list[tuple[int, str] | None]:
        return [c and (c[0], self.audits.spell(c[1])) for c in self.cells]


def joined(fragments: list[list[list[tuple[int, str] | None]]]) -> tuple[int, str]:
    """(cost, edit list) of a conversation given as consecutive fragments; each has results by (state before, state after).

    Only the pieces since two lists parted are compared, so a long conversation's lists are not put together at each step.
    """
    cells: list = [None] * 4  # (cost, (parent, piece))
    cells[START] = (0, None)
    for table in fragments:
        after: list = [None] * 4
        for before, cell in enumerate(cells):
            for state in range(4) if cell is not None and table[before] is not None else ():
                piece = table[before][state]
                if piece is not None:
                    new = (cell[0] + piece[0], (cell[1], piece[1]))
                    if after[state] is None or new[0] < after[state][0] or new[0] == after[state][0] and _before(new[1], after[state][1]):
                        after[state] = new
        cells = after
    best = None
    for state in (START, ASSISTANT):
        cell = cells[state]
        if cell is not None and (best is None or cell[0] < best[0] or cell[0] == best[0] and _before(cell[1], best[1])):
            best = cell
    pieces, node = [], best[1]
    while node is not None:
        pieces.append(node[1])
        node = node[0]
    return best[0], "".join(reversed(pieces))


def _before(a, b) -> bool:
    """Whether list a comes before b; both are chains (parent, piece) of one length."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _fragments(id_type: pa.DataType, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: dict | None = None
        first = True
        done: list[dict] = []

        def close() -> None:
            nonlocal first
            found = [r and r.results() for r in now.pop("repairs")]
            now["costs"] = [[c[0] if c else None for c in f] if f else None for f in found]
            now["audits"] = [[c[1] if c else None for c in f] if f else None for f in found]
            done.append(now)
            first = False

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        close()
                    # Only a task's first conversation can have begun in an earlier task.
                    starts = range(4) if first else (START,)
                    now = {"conv_id": row["conv_id"], "part": part, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": row["initial"], "turns": 0, "low": None, "high": None}
                    now["repairs"] = [Repair(s) if s in starts else None for s in range(4)]
                    now["tail"] = None
                turn = row["turn"]
                if turn is not None and turn != now["high"]:
                    now["turns"] += 1
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                for k in range(row["copies"]):
                    fault = "blank" if row["blank"] else "duplicate" if k or not row["is_first"] else "truncated" if row["cut"] else None
                    if fault:
                        now[fault] += 1
                    if now["tail"] is not None and now["tail"] + row["initial"] not in LEGAL:
                        now["illegal"] += 1
                    now["tail"] = row["initial"]
                    for r in now["repairs"]:
                        if r:
                            r.feed(row["initial"], fault in ("blank", "duplicate"), fault == "truncated")
            if len(done) >= 5000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def _sum_up(conv_id, fragments: list[dict]) -> dict:
    out = {"conv_id": conv_id, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    if not fragments:
        return out
    for k in ("blank", "duplicate", "truncated", "illegal"):
        out[k] = sum(f[k] for f in fragments)
    turns, high, low = 0, None, None
    for f in fragments:
        if f["turns"]:
            turns += f["turns"] - (f["low"] == high)
            low, high = f["low"] if low is None else low, f["high"]
    out["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(fragments, fragments[1:]))
    if turns:
        out["gaps"] = (high - low + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63)
    tables = [[[(c, a) if c is not None else None for c, a in zip(costs, audits)] if costs is not None else None for costs, audits in zip(f["costs"], f["audits"])] for f in fragments]
    out["cost"], out["audit"] = joined(tables)
    return out


class _Rewrite:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _emit(self, row: str) -> None:
        self.sha.update(("\n" + row if self.any else row).encode("utf-8", "surrogatepass"))
        self.any = True

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._emit(ROLES[self.state] + ":")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = NEXT[self.state]
            self._emit(f"{ROLES[self.state]}:{text}")
        elif letter == "K":
            self.state = KEEPS[self.state, role[:1]]
            self._emit(f"{role}:{text}")


def _results(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        fragments: list[dict] = []
        conv_id, open_, result, rewrite = None, False, None, None

        def settle() -> None:
            nonlocal result, rewrite
            if result is None:
                result = _sum_up(conv_id, fragments)
                rewrite = _Rewrite(result["audit"])

        def close() -> None:
            nonlocal result
            settle()
            rewrite.inserts()
            done.append(result | {"repaired_sha256": rewrite.sha.hexdigest()})
            result = None
            fragments.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if not open_ or row["conv_id"] != conv_id:
                    if open_:
                        close()
                    conv_id, open_ = row["conv_id"], True
                if row["fragment"] is not None:
                    fragments.append(row["fragment"])
                elif row["text"] is not None:
                    settle()
                    for _ in range(row["copies"]):
                        rewrite.row(row["role"], row["text"])
            if len(done) >= 5000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        if open_:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage chosen by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it (copies = 2), 4 makes its role user. A
    null conv_id or turn counts as one space in the key and stays null in the row; a null role or text is one space.
    """
    c = columns_of(conversations, "conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("long"))
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return c.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _digest():
    """Names role and text; equal rows of a conversation are found and ordered by it."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


def repair(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row per conversation of ``all_ids``: faults, the cheapest edits and the hash of the repaired rows.

    ``rows`` has (conv_id, turn, role, text, copies), with no null role or text; ``all_ids`` has conv_id, repeats
    allowed. Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by their digest, so a repeated row stands next to its copy. A
    null conv_id is a conversation of its own. A conversation without rows gets zeros, the empty audit and the empty
    string's hash. Gaps wrap at 64 bits. A role's initial is its first character; an empty role has none and fits nowhere.

    1. Rows without their texts (flags, initial, digest) are counted, so copies are one row, and dealt out in ranges of
       (conversation, turn): a long conversation is cut over many tasks.
    2. Each task solves its stretch of a conversation. A stretch that may continue an earlier task's is solved from all
       four states, so stretches can be joined afterwards.
    3. A conversation's stretches and then its texts, in order, stream through one task, which joins the former, and
       hashes the latter one at a time, as SHA-256 must read them in order. That task holds the edit letters of one
       conversation, never its texts.
    """
    spark = rows.sparkSession
    bare = F.rtrim("text", F.lit(BLANKS))
    lean = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), _digest().alias("digest"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "copies")
    lean = stash(lean.groupBy("conv_id", "turn", "initial", "digest", "blank", "cut").agg(F.sum("copies").alias("copies")), "turns")
    early = lean.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("_early"))
    marked = lean.join(early, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    marked = marked.select(*lean.columns, F.col("turn").eqNullSafe(F.col("_early.turn")).alias("is_first"))
    ordered = marked.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")

    id_type = dict(rows.dtypes)["conv_id"]
    table = "part int, blank long, duplicate long, truncated long, illegal long, head string, tail string, turns long, low long, high long, costs array<array<long>>, audits array<array<string>>"
    arrow_id = spark.createDataFrame([], f"conv_id {id_type}").toArrow().schema.field("conv_id").type
    several = lambda kind: pa.list_(pa.list_(kind))
    names = [("conv_id", arrow_id), ("part", pa.int32()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()), *[(n, pa.int64()) for n in ("turns", "low", "high")], ("costs", several(pa.int64())), ("audits", several(pa.string()))]
    fragments = stash(ordered.mapInArrow(_fragments(arrow_id, pa.schema(names)), f"conv_id {id_type}, {table}"), "stretches")

    held = fragments.select("conv_id", F.lit(0).alias("kind"), "part", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("digest"), F.struct(*[c for c in fragments.columns if c != "conv_id"]).alias("fragment"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    nothing = lambda name: F.lit(None).cast(held.schema[name].dataType).alias(name)
    texts = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("part"), "turn", _digest().alias("digest"), nothing("fragment"), "role", "text", "copies")
    ids = all_ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(-1).alias("part"), *[nothing(n) for n in ("turn", "digest", "fragment", "role", "text")], F.lit(0).alias("copies"))
    stream = ids.unionByName(held).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "turn", "digest")
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", arrow_id), *[(n, pa.int64()) for n in longs], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = stream.select("conv_id", "fragment", "role", "text", "copies").mapInArrow(_results(schema), f"conv_id {id_type}, {', '.join(f'{n} long' for n in longs)}, audit string, repaired_sha256 string")
    with arrow_rows(spark, 1000):
        return stash(out, "repairs")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the rows after ``damaged``, for every conversation of the table; further columns are ignored."""
    ids = columns_of(conversations, "conv_id")
    return repair(damaged(conversations), ids)
