"""Conversation repair and vector codes against plain versions, in blocks and whole, and their edges."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dolomite.llm import codebook, conversation, queries

SPACE = " \t\n\v\f\r"


def best_edits(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[str]]:
    """cost, audit and lines of rows (role, text, gone, late) by a forward search over whole strings."""
    now = {"": (0, "", [])}

    def insert(now):
        for _ in range(3):
            for q, (cost, audit, lines) in list(now.items()):
                to = "a" if q == "u" else "u"
                new = (cost + 3, audit + "I", [*lines, {"a": "assistant:", "u": "user:"}[to]])
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        return now

    for role, text, gone, late in rows:
        then: dict = {}
        for q, (cost, audit, lines) in insert(now).items():
            choices = [(q, 4, "D", [])]
            if not gone:
                to = "a" if q == "u" else "u"
                choices.append((to, 3 + 3 * late, "R", [{"a": "assistant:", "u": "user:"}[to] + text]))
                if (role[:1], q) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                    choices.append((role[:1], 3 * late, "K", [f"{role}:{text}"]))
            for to, more, letter, line in choices:
                new = (cost + more, audit + letter, [*lines, *line])
                if to not in then or new[:2] < then[to][:2]:
                    then[to] = new
        now = then
    return min((x for q, x in insert(now).items() if q in ("", "a")), key=lambda x: x[:2])


def plain(rows) -> dict:
    """The report of rows (conv_id, turn, role, text)."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        of = by[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        of += [] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, of in by.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in of:
            bare = text.strip(SPACE)
            what = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if what is not None:
                counts[what] += 1
            judged.append((role, text, what in (0, 1), what == 2))
        told = [t for t, _, _ in of if t is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, lines = best_edits(judged)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def told(frame) -> dict:
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def talk(seed: int, convs: int, most: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sage", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, 0]), role, rng.choice(["Yes.", "No", "é?", "", " \t", None, f"t{turn}.", f"t{rng.random()}", "end!\n", "x. ", "x "])))
    return rows


ROWS = "conv_id long, turn long, role string, text string"


def test_repairs_equal_the_plain_search(spark):
    rows = [*talk(1, 250, 9), *[(1000 + k, t, r, x) for k, (t, r, x) in enumerate([(None, None, None), (3, "user", "only")])]]
    assert told(conversation.report(spark.createDataFrame(rows, ROWS).repartition(3))) == plain(rows)


def test_long_conversations_in_blocks(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(230)] + [(8, None, "user", f"{k % 40}.") for k in range(90)] + talk(2, 20, 4)
    frame = spark.createDataFrame([(c + 100 if c < 7 and k >= 320 else c, *r) for k, (c, *r) in enumerate(rows)], ROWS).repartition(4)
    whole = told(conversation.report(frame))
    assert whole == plain([tuple(r) for r in frame.collect()])
    assert told(conversation.report(frame, long=25)) == whole


def test_repaired_turns_are_legal(spark):
    rows = spark.createDataFrame(talk(3, 40, 7), ROWS)
    by = defaultdict(list)
    for r in conversation.repaired(conversation.turns(rows)).collect():
        by[r.conv].append((r.block, r.place, r.line, r.role))
    for lines in by.values():
        initials = "".join(role[:1] for *_, role in sorted(lines))
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)


def test_repair_edges(spark):
    schema = f"{ROWS}, kind int, n int, conv string, letters string, block int"
    assert conversation.report(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None, None), (None, 1, "user", "a."), (5, 0, "user", "x" * 300_000 + "."), (5, 1, "assistant", "y" * 300_000)]
    assert told(conversation.report(spark.createDataFrame([(*r, 9, 9, "c", "z", 1) for r in rows], schema))) == plain(rows)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert told(conversation.report(spark.createDataFrame([(gone, 0, "user", "a.")], ROWS))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def lloyd(rows) -> dict:
    """vec_id -> (code, error, label_error, digest), with Python's integers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return {}
    w = len(kept[0][2]) // 16
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:64]] for p in range(16)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(2):
        for p in range(16):
            of = defaultdict(list)
            for _, _, v in kept:
                of[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else c for k, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for i, lab, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        by[lab] += out[-1][2]
    return sorted((str(i), code, error, by[lab], digest) for i, code, error, lab in out)


def coded(frame):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect())


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n, d, spread", [(300, 32, 1.0), (20, 16, 0.02), (150, 48, 3000.0)])
def test_codes_equal_plain_lloyd(spark, n, d, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i * 37 % 1000), [float(x) for x in rng.normal(0, spread, d).astype(np.float32)], [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(rows[0][0], rows[0][1], 7), (None, rows[1][1], 1), (3000, None, 1), (3001, [*rows[1][1][1:], None], 1), (3002, [float("nan")] + rows[1][1][1:], 1), (3003, [float("-inf")] + rows[1][1][1:], None), (3004, rows[2][1], None), (3005, [], 1)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert coded(codebook.report(frame)) == lloyd(rows)


def test_only_changed_parts_are_shuffled(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 16)], 0) for i in range(200)], VECTORS)
    kept = codebook.vectors_of(rows, 16, 256, "vec_id", "embedding", "label")
    books, now = codebook.trained(kept)
    sums = np.zeros((16, 64, 1), np.int64)
    total = {(r.part, r.entry): r for r in codebook.summed(codebook.moved_sums(now, books.shape, True), 1).collect()}
    assert sum(r.n for r in total.values()) == 200 * 16
    moved = codebook.moved_sums(now, books.shape, False).collect()
    changed = sum(sum(a != b for a, b in zip(r.codes, r.before, strict=True)) for r in now.where("before is not null").collect())
    assert sum(r.n for r in moved) == 0 and 0 < sum(r.n for r in moved if r.n > 0) <= changed < 200 * 16 and sums.sum() == 0


def test_code_edges(spark):
    schema = f"{VECTORS}, codes string, error int, vector int"
    assert codebook.report(spark.createDataFrame([], schema)).collect() == []
    assert codebook.report(spark.createDataFrame([(1, None, 1, "", 1, 1)], schema)).collect() == []
    one = [float(x) for x in range(16)]
    got = codebook.report(spark.createDataFrame([(1, one, None, "x", 1, 1), (2, one[:15], 1, "x", 1, 1), (3, one + one, 1, "x", 1, 1)], schema)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(1, "00" * 16, 0, 0)]
    with pytest.raises(Exception, match="beyond"):
        codebook.report(spark.createDataFrame([(1, [1e30] * 16, 1, "", 1, 1)], schema)).collect()
    codes, books = codebook.encoded(spark.createDataFrame([(1, one, None, "x", 1, 1), (2, one, 4, "x", 1, 1)], schema))
    assert [r.vector for r in codebook.decoded(codes, books).collect()] == [[256 * x for x in range(16)]] * 2


def test_queries_read_whole_tables(spark, tmp_path):
    rows = talk(9, 30, 6)
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(queries.op12_conversations(spark, str(tmp_path))) == plain(rows)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)], i % 3) for i in range(80)]
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert coded(queries.op13_codebook(spark, str(tmp_path))) == lloyd(vectors)
