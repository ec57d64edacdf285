"""Conversation structure repair: cheapest edits that make the roles of a conversation legal, by lazy weighted determinisation.

A legal conversation's role initials read (s?(ua)+)?. Keeping a row costs nothing, another role (user or assistant) RE_ROLE, deleting DELETE,
inserting an empty user or assistant row INSERT; a truncated row that isn't deleted costs TRUNCATED more. Blank and repeated rows are deleted.

The automaton of legal initials has four states: nothing yet, after s, after u, after a. What each state still costs up to the end, less the least
of them, is a vector; vectors are the states of a weighted deterministic automaton, made when first met and kept in a transition table (the
differences are bounded by a few edits, so there are few). A scan of a conversation by that table, from its last row to its first,
gives the costs; the trace goes back over the scan along arcs that are tight (step and rest add up to the cost), at each step the one
with the least letter. As the scan began at the end, the trace meets the rows in order, so the audit is the least in ASCII.

Rows equal in conversation, turn, role and text are one row with a count, whose copies are repeats. A conversation of at most LONG rows and
LONG_BYTES of text is repaired whole, in a stream over sorted rows. Longer ones are dealt by ranges of rows to blocks: each block gives the costs
between any two states, a row for each block is folded from the last to the first, then each block tells where its trace leads from each
state, which is folded from first to last, and blocks are traced apart. Only the audit and the digest of a conversation, one cell each,
are put together in order, in a stream.

Null conv_id, turn, role and text read as one space; rows without conv_id are one conversation. Rows are taken by turn (nulls first), then
role and text. A conversation without rows has no edits, an empty audit and the digest of an empty text. Empty input gives no
rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dolomite.llm.common import released, small_or_shuffled, written

RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LONG, LONG_BYTES = 10_000, 16 << 20
#: Pairs of initials that may follow each other.
LEGAL = frozenset({"su", "ua", "au"})
SPACE = r"\x20\x09-\x0D"

#: States of the automaton, and where an initial leads (none: it can't come here).
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: What an inserted or re-roled row must be in each state.
WANTED = ("user", "user", "assistant", "user")
FAR = 1 << 40
#: Kinds of rows: blank, repeated, then two for each of the initials s, u, a and others, as they are and truncated.
BLANK, REPEATED, FIRST = 0, 1, 2
INITIALS = ("s", "u", "a", "")


class Determinised:
    """The weighted deterministic automaton, as far as it has been met, with its tight arcs."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, tuple[str, ...], str | None, int]] = {}
        self.end = self.state((0, FAR, FAR, 0), close=True)[0]

    def state(self, costs, close: bool = False) -> tuple[int, int]:
        """The number of a vector of costs, and the least that was taken from it."""
        costs = self.closed(costs) if close else tuple(min(c, FAR) for c in costs)
        low = min(costs)
        vector = tuple(c - low if c < FAR else FAR for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (FIRST + 2 * len(INITIALS)))
        return self.number[vector], low

    @staticmethod
    def after_insert(q: int) -> int:
        return LEADS[WANTED[q][0]][q]

    def closed(self, costs) -> tuple[int, ...]:
        """With rows inserted before."""
        out = list(costs)
        for _ in range(2):
            out = [min(c, INSERT + out[self.after_insert(q)], FAR) for q, c in enumerate(out)]
        return tuple(out)

    @staticmethod
    def choices(kind: int, q: int) -> list[tuple[str, int, int, bool]]:
        """letter, cost, next state, whether the row is re-roled, in the order of the letters; insertion apart."""
        out = [("D", DELETE, q, False)]
        if kind >= FIRST:
            initial, late = INITIALS[(kind - FIRST) // 2], TRUNCATED * ((kind - FIRST) % 2)
            if initial and LEADS[initial][q] is not None:
                out.append(("K", late, LEADS[initial][q], False))
            out.append(("R", RE_ROLE + late, Determinised.after_insert(q), True))
        return out

    def before(self, at: int, kind: int) -> tuple[int, ...]:
        """Costs before a row of the kind, from those behind it."""
        vector = self.vectors[at]
        return self.closed([min(cost + vector[to] for _, cost, to, _ in self.choices(kind, q)) for q in range(4)])

    def step(self, at: int, kind: int) -> tuple[int, int]:
        got = self.table[at][kind]
        if got is None:
            got = self.table[at][kind] = self.state(self.before(at, kind))
        return got

    def scan(self, kinds: list[int], copies: list[int], at: int) -> tuple[list[int], int]:
        """From the last row to the first: the automaton's state behind each row, then the one before the first, and the cost."""
        behind, total, table = [at], 0, self.table
        for k in range(len(kinds) - 1, -1, -1):
            kind = kinds[k]
            got = table[at][kind]
            if got is None:
                got = self.step(at, kind)
            at = got[0]
            total += got[1] + DELETE * (copies[k] - 1)
            behind.append(at)
        behind.reverse()
        return behind, total

    def arc(self, at: int, kind: int, q: int) -> tuple[str, tuple[str, ...], str | None, int]:
        """letters, inserted roles, new role, next state, of the tight arcs from q over a row of the kind; at: the state behind the row."""
        key = (at, kind, q)
        if key not in self.arcs:
            here, behind, letters, put = self.before(at, kind), self.vectors[at], "", []
            while True:
                options = {letter: (cost + behind[to] == here[q], to, other) for letter, cost, to, other in self.choices(kind, q)}
                options["I"] = (INSERT + here[self.after_insert(q)] == here[q], self.after_insert(q), False)
                letter = min(x for x, (tight, _, _) in options.items() if tight)
                letters += letter
                if letter == "I":
                    put.append(WANTED[q])
                    q = options["I"][1]
                    continue
                self.arcs[key] = (letters, tuple(put), WANTED[q] if options[letter][2] else None, options[letter][1])
                break
        return self.arcs[key]

    def finish(self, q: int) -> tuple[str, ...]:
        """Roles inserted behind the last row."""
        out = []
        while q not in (EMPTY, ASSISTANT):
            out.append(WANTED[q])
            q = self.after_insert(q)
        return tuple(out)


@lru_cache(maxsize=1)
def automaton() -> Determinised:
    return Determinised()


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, n: rows after damage by the CRC-32 of conv_id:turn modulo 20 (module queries names the contract); n: copies."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(text_of(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_of(turn_col).alias("named"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    fault = F.crc32(F.concat_ws(":", "conv", "named").cast("binary")) % 20
    rows = plain.withColumn("fault", fault).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, n of undamaged rows, nulls as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(text_of(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), F.lit(1).alias("n"))


def faulted(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, n), equal ones summed, with kind."""
    once = written(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n")).withColumn("digest", F.sha2("text", 256)), "turns")
    again = once.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").drop("turns")
    seen = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn"))
    initial: Column = F.substring("role", 1, 1)
    of_initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    kind = F.when(~F.col("text").rlike(rf"[^{SPACE}]"), BLANK).when(seen, REPEATED).otherwise(FIRST + 2 * of_initial + F.when(whole, 0).otherwise(1))
    found = once.join(small_or_shuffled(written(again, "repeated-turns")), ["conv", "role", "digest"], "left")
    return found.select("conv", "turn", "role", "text", "n", kind.cast("int").alias("kind"))


ACTS = "conv string, block int, place long, turn long, initial string, kind int, n long, letters string, inserted array<string>, role string, text string, after array<string>"


def runs(batches, *columns: str) -> Iterator[tuple[tuple, list[list]]]:
    """(conv, block) and the lists of the columns, for each run of rows of one conversation and block."""
    key, held = None, [[] for _ in columns]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist(), strict=True))
        lists = [batch.column(c).to_pylist() for c in columns]
        a = 0
        for z in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]:
            if keys[a] != key:
                if key is not None:
                    yield key, held
                key, held = keys[a], [[] for _ in columns]
            for own, more in zip(held, lists, strict=True):
                own += more[a:z]
            a = z
    if key is not None:
        yield key, held


def acted(batches):
    """Each row's edits. Rows sorted by conversation, block and place; `behind`: costs behind the block (null: it ends the conversation), `start`: its first state."""
    auto, out, size = automaton(), {x.split()[0]: [] for x in ACTS.split(", ")}, 0

    def batch():
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
        return pa.RecordBatch.from_arrays([pa.array(out[x.split()[0]], kinds[x.split()[1]]) for x in ACTS.split(", ")], [x.split()[0] for x in ACTS.split(", ")])

    for (conv, block), (turn, role, text, n, kind, behind, start) in runs(batches, "turn", "role", "text", "n", "kind", "behind", "start"):
        at = auto.end if behind[0] is None else auto.state(behind[0])[0]
        states, _ = auto.scan(kind, n, at)
        q = start[0]
        for k, what in enumerate(kind):
            letters, put, other, q = auto.arc(states[k + 1], what, q)
            deleted = letters[-1] == "D"
            last = auto.finish(q) if behind[0] is None and k + 1 == len(kind) else ()
            row = (conv, block, k, turn[k], role[k][:1], what, n[k], letters + "D" * (n[k] - 1) + "I" * len(last), list(put), None if deleted else other or role[k], "" if deleted else text[k], list(last))
            for held, x in zip(out.values(), row, strict=True):
                held.append(x)
            size += len(text[k])
        if size > 1 << 20 or len(out["conv"]) > 5000:
            yield batch()
            for held in out.values():
                held.clear()
            size = 0
    yield batch()
    released()


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reported(batches):
    """A row for each conversation of acted rows, in order."""
    rows: list[tuple] = []
    state: dict = {}

    def close():
        if state:
            low, high = state["low"], state["high"]
            gaps = 0 if low is None else high - low + 1 - state["turns"]
            rows.append((state["conv"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["cost"], "".join(state["audit"]), state["hash"].hexdigest()))

    def line(role: str, text: str) -> None:
        state["hash"].update((("\n" if state["lines"] else "") + f"{role}:{text}").encode())
        state["lines"] += 1

    def batch():
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 7, 8) else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in REPORT.split(", ")])

    for b in batches:
        for conv, turn, initial, kind, n, letters, put, role, text, after in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "initial", "kind", "n", "letters", "inserted", "role", "text", "after")), strict=True):
            if state.get("conv") != conv:
                close()
                state = dict(conv=conv, low=None, high=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit=[], hash=hashlib.sha256(), lines=0, before=None)
            if turn is not None and turn != state["high"]:
                state["low"] = turn if state["low"] is None else state["low"]
                state["high"], state["turns"] = turn, state["turns"] + 1
            late = kind >= FIRST and (kind - FIRST) % 2
            state["blank"] += n if kind == BLANK else 0
            state["duplicate"] += n if kind == REPEATED else n - 1 if kind != BLANK else 0
            state["truncated"] += late
            state["illegal"] += n - 1 + (state["before"] is not None and state["before"] + initial not in LEGAL)
            state["before"] = initial
            state["cost"] += DELETE * letters.count("D") + INSERT * letters.count("I") + RE_ROLE * letters.count("R") + (TRUNCATED if late and role is not None else 0)
            state["audit"].append(letters)
            for x in put:
                line(x, "")
            if role is not None:
                line(role, text)
            for x in after:
                line(x, "")
        if len(rows) > 5000:
            yield batch()
            rows = []
    close()
    yield batch()


def matrices(batches):
    """conv, block, costs: of each block, from each state before it to each behind it."""
    auto = automaton()
    for (conv, block), (n, kind) in runs(batches, "n", "kind"):
        out = np.empty((4, 4), np.int64)
        for q in range(4):
            states, total = auto.scan(kind, n, auto.state([0 if x == q else FAR for x in range(4)])[0])
            out[:, q] = [min(c + total, FAR) for c in auto.vectors[states[0]]]
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([block], pa.int32()), pa.array([out.ravel().tolist()])], ["conv", "block", "costs"])


def ends(batches):
    """conv, block, ends: where the trace of each block leads from each state."""
    auto = automaton()
    for (conv, block), (n, kind, behind) in runs(batches, "n", "kind", "behind"):
        states, _ = auto.scan(kind, n, auto.end if behind[0] is None else auto.state(behind[0])[0])
        to = []
        for q in range(4):
            if auto.vectors[states[0]][q] < FAR:
                for k, what in enumerate(kind):
                    q = auto.arc(states[k + 1], what, q)[3]
            to.append(q)
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([block], pa.int32()), pa.array([to])], ["conv", "block", "ends"])


def behind_blocks(part: pa.Table) -> pa.Table:
    """The costs behind each block of one conversation, from a row of costs for each block."""
    part = part.sort_by("block")
    auto = automaton()
    vector, out = np.array(auto.vectors[auto.end]), [None]
    for costs in part.column("costs").to_pylist()[:0:-1]:
        vector = np.minimum((np.array(costs).reshape(4, 4) + vector[None, :]).min(1), FAR)
        vector = vector - vector.min()
        out.append(vector.tolist())
    return pa.table({"conv": part.column("conv"), "block": part.column("block"), "behind": pa.array(out[::-1], pa.list_(pa.int64()))})


def starts(part: pa.Table) -> pa.Table:
    part = part.sort_by("block")
    q, out = EMPTY, []
    for to in part.column("ends").to_pylist():
        out.append(q)
        q = to[q]
    return pa.table({"conv": part.column("conv"), "block": part.column("block"), "behind": part.column("behind"), "start": pa.array(out, pa.int32())})


def in_blocks(rows: DataFrame, long: int, long_bytes: int) -> DataFrame:
    """Acted rows of long conversations, block by block."""
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = 1 + max(-(-count // long), -(-size // long_bytes))
    order = ["conv", "turn", "role"]
    dealt = rows.repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    dealt = written(dealt.withColumn("block", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "long-conversations")

    def sorted_runs(df: DataFrame) -> DataFrame:
        return df.repartition("conv", "block").sortWithinPartitions("conv", "block", "place")

    narrow = dealt.select("conv", "block", "place", "n", "kind")
    costs = sorted_runs(narrow).mapInArrow(matrices, "conv string, block int, costs array<long>")
    behind = written(costs.groupBy("conv").applyInArrow(behind_blocks, "conv string, block int, behind array<long>"), "behind-blocks")
    led = sorted_runs(narrow.join(small_or_shuffled(behind), ["conv", "block"])).mapInArrow(ends, "conv string, block int, ends array<long>")
    placed = written(led.join(behind, ["conv", "block"]).groupBy("conv").applyInArrow(starts, "conv string, block int, behind array<long>, start int"), "block-starts")
    return written(sorted_runs(dealt.join(small_or_shuffled(placed), ["conv", "block"])).mapInArrow(acted, ACTS), "long-edits")


def edits(rows: DataFrame, long: int = LONG, long_bytes: int = LONG_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Acted rows of (conv, turn, role, text, n): in order within partitions, each conversation in one; and those of long conversations, if any."""
    found = written(faulted(rows), "faults")
    sizes = found.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    large = written(sizes.where((F.col("rows") > long) | (F.col("bytes") > long_bytes)).select("conv"), "long-conversations-named")
    few = found
    if not large.isEmpty():
        few = found.join(small_or_shuffled(large), "conv", "left_anti")
    few = few.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    whole = few.select("*", F.lit(0).alias("block"), F.lit(None).cast("array<long>").alias("behind"), F.lit(EMPTY).alias("start")).mapInArrow(acted, ACTS)
    return whole, None if large.isEmpty() else in_blocks(found.join(small_or_shuffled(large), "conv"), long, long_bytes)


def repaired(rows: DataFrame, **options) -> DataFrame:
    """conv, block, place, line, role, text: the repaired conversations of rows (conv, turn, role, text, n), in the order of the three numbers."""
    made, long = edits(rows, **options)
    made = made if long is None else made.unionByName(long)
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("role").isNotNull(), F.array(F.struct("role", "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    lines = made.select("conv", "block", "place", F.posexplode(F.concat(empty("inserted"), own, empty("after"))).alias("line", "x"))
    return lines.select("conv", "block", "place", "line", "x.role", "x.text")


def report(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **options) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged first."""
    made, long = edits(damaged(rows, id_col, turn_col, role_col, text_col), **options)
    out = made.mapInArrow(reported, REPORT)
    if long is not None:
        out = out.unionByName(long.repartition("conv").sortWithinPartitions("conv", "block", "place").mapInArrow(reported, REPORT))
    out = written(out, "repairs")
    every = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.coalesce(F.col(id_col).cast("string"), F.lit(" ")).alias("conv")).distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(out, "conv", "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
