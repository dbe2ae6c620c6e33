"""Repair of turns, fill-in-middle and exact dedup against brute force, with nulls, ties, repeats, long and empty input."""

from __future__ import annotations

import heapq
import random
import re
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import content_dedup, fill_middle, turn_repair

BLANK = re.compile(r"[\x20\x09-\x0D]")


# Turns


def brute_audit(turns):
    """Least (cost, audit) over all edit sequences, by a search of (role initials so far) with a regular expression at the end."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        if (i, out) in done or not re.fullmatch("s?(ua)*u?", out):
            continue
        done.add((i, out))
        for letter in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + letter))
        if i < len(turns):
            initial, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if not gone:
                for letter in "ua":
                    heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, out + letter))
                heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, out + initial))


def coded(turns):
    letters = {"s": turn_repair.S, "u": turn_repair.U, "a": turn_repair.A}
    return bytes(letters.get(x, 0) + turn_repair.MUST_GO * gone + turn_repair.IS_TRUNCATED * cut for x, gone, cut in turns)


def test_cost_and_audit_equal_search():
    r = random.Random(5)
    for _ in range(1500):
        turns = [(r.choice("suuaax"), r.random() < 0.2, r.random() < 0.25) for _ in range(r.randint(0, 7))]
        assert turn_repair.cheapest(coded(turns)) == brute_audit(turns), turns


def test_audits_of_long_conversations_take_linear_time():
    r = random.Random(6)

    def timed(n):
        turns = coded([(r.choice("suuaax"), r.random() < 0.1, r.random() < 0.1) for _ in range(n)])
        began = time.perf_counter()
        cost, audit = turn_repair.cheapest(turns)
        assert len(audit.replace("I", "")) == n and cost > n
        return time.perf_counter() - began

    timed(5_000)
    assert timed(80_000) < 3.0 * timed(40_000) + 0.5


def brute_damage(rows):
    out = []
    spaced = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        x = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        out += [(conv, turn, "user" if x == 4 else role, text)] * {0: 0, 3: 2}.get(x, 1)
    return out


def brute_repair(rows):
    """conv_id -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = lambda r: sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], said(r)))
        turns, seen, counts = [], set(), [0, 0, 0]
        for _, _, role, text in own:
            solid = BLANK.sub("", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1] or "-", fault in (0, 1), fault == 2))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
        cost, audit = brute_audit(turns)
        it, texts, letters = iter(own), [], audit.replace("D", "")
        for edit in audit:
            row = next(it) if edit != "I" else None
            if edit != "D":
                name = ("user", "assistant")[(len(texts) - len(letters) % 2) % 2]
                texts.append(f"{row[2] if edit == 'K' else name}:{row[3] if row else ''}")
        out[conv] = (gaps, *counts, illegal, cost, audit, "\n".join(texts))
    return out


CHATS = "conv_id long, turn long, role string, text string, seen string"


def chats(r):
    rows = []
    for c in range(60):
        for t in range(r.randint(0, 7)):
            rows.append((c, r.choice([t, t, t, None, t + 3]), r.choice(["system", "user", "user", "assistant", "assistant", "", "tool", None]), r.choice(["Hello.", "So?", "cut", " \t", "", "é!\n", None, "Hello."]), "z"))
    rows += rows[:9] + [(99, None, None, None, "z"), (None, 1, "user", "x" * 100_000 + ".", "z"), (None, None, "assistant", "y.", "z")]
    rows += [(100, t % 5, "user", "Same.", "z") for t in range(8)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force(spark, seed):
    rows = chats(random.Random(seed))
    hurt = turn_repair.damaged(spark.createDataFrame(rows, CHATS))
    assert sorted(map(tuple, hurt.collect()), key=repr) == sorted(brute_damage([r[:4] for r in rows]), key=repr)
    plans = turn_repair.plans(hurt).collect()
    turns = turn_repair.repaired(hurt, turn_repair.plans(hurt))
    texts = {x["conv_id"]: x["sha256"] for x in turn_repair.digests(turns).collect()}
    expected = brute_repair(brute_damage([r[:4] for r in rows]))
    assert len(plans) == len(expected)
    for p in plans:
        *counts, text = expected[p["conv_id"]]
        assert tuple(p)[1:] == tuple(counts), p
        assert texts.get(p["conv_id"], sha256(b"").hexdigest()) == sha256(text.encode()).hexdigest()


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CHATS)
    assert turn_repair.plans(turn_repair.damaged(none)).count() == 0
    assert turn_repair.repaired(none, turn_repair.plans(none)).count() == 0


# Fill in the middle

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s:.)"}


def brute_units(text, unit):
    if unit == "word":  # leading blanks are a unit of their own
        return re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    return re.findall(UNITS[unit], text)


def texts(r):
    bits = ["\n", "\n\n", "a", "é", "漢", "😀", " ", "\t", "word", "<P", ">", "<", "\r\n", "x" * 50]
    return ["", "\n", "\n\n\n", "a", "a\n", "\na", "<P>", "a<M>b", " a b", "😀" * 3] + ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(300)]


@pytest.mark.parametrize("unit", list(UNITS))
def test_every_cut(unit):
    for text in texts(random.Random(7)):
        data = np.frombuffer(text.encode(), np.uint8)
        runs, units = fill_middle.encoded(data, unit), brute_units(text, unit)
        assert runs.n == len(units), (text, unit)
        assert [runs.cut(k) for k in range(runs.n + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)], (text, unit)


@pytest.mark.parametrize("unit", list(UNITS))
def test_fill_in_middle(spark, unit):
    rows = [(i, t, i) for i, t in enumerate(texts(random.Random(8)))] + [(3, None, 0), (None, "one\ntwo\nthree", 0), (None, "one\ntwo\nthree", 0), (-5, "line é\n" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    made = fill_middle.fill_in_middle(df, unit=unit)
    found = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    expected = []
    for i, text, _ in rows:
        text, h = text or "", sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        units = brute_units(text, unit)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
            expected.append((i, len(units), "plain", None, None, text, text))
        elif h[3] % 100 < 50:
            expected.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            expected.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert fill_middle.fill_in_middle(df.limit(0), unit=unit).count() == 0
    assert {x["form"] for x in fill_middle.fill_in_middle(df, percent=0).select("form").collect()} == {"plain"}


# Exact dedup


def brute_groups(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(BLANK.sub("", text or ""), []).append((i, text or ""))
    out = []
    for norm, own in groups.items():
        own.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, own[0][0], len(own), k == 0, sha256(norm.encode()).hexdigest()) for k, (i, _) in enumerate(own)]
    return sorted(out, key=repr)


def test_exact_groups(spark):
    r = random.Random(9)
    bits = ["a", "b", " ", "\n", "\t", "\x0b\x0c\r", "é", "\x1f", "\xa0"]
    rows = [(r.choice([i, i, i, None, 5]), "".join(r.choice(bits) for _ in range(r.randint(0, 4))) if r.random() > 0.05 else None) for i in range(600)]
    # A third of all rows are one text, some of them repeated rows; two long texts differ in their last character.
    rows += [(i // 3, "hot text" + " " * r.randint(0, 2)) for i in range(700)] + [(1, "x" * 200_000 + "y"), (2, "x" * 200_000 + "z"), (3, "x" * 200_000 + "z"), (None, " ")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "n", "hash") for x in rows], "doc_id long, text string, row string, first string")
    found = sorted(map(tuple, content_dedup.exact_groups(df).collect()), key=repr)
    assert found == brute_groups(rows)
    assert content_dedup.exact_groups(df.limit(0)).count() == 0
    kept = content_dedup.without_copies(df)
    assert kept.columns == df.columns and kept.count() == len({BLANK.sub("", t or "") for _, t in rows})
