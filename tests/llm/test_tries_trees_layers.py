"""Exact dedup, hard negatives and conversation repair against brute force, with nulls, ties, repeated rows, clashing columns
and empty tables."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import conversation_repair, exact_dedup, hard_negatives

# --- exact dedup


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a" * 5000, "a" * 4000, "Ünï", "hot"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([*texts, "ab" * rng.randrange(300), "p" * 200 + "q" * rng.randrange(30), *["hot"] * 4])) for _ in range(1500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize(("keep", "budget"), [("smallest", 10**8), ("largest", 3000), ("largest", 1)])
def test_exact_duplicates(copies, keep, budget):
    rows, docs = copies
    got = exact_dedup.exact_duplicates(docs.withColumn("sha", F.lit(1)).withColumn("rows", F.lit(1)), keep=keep, budget=budget).collect()
    groups, want, named = defaultdict(list), Counter(), {}
    for i, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        named[hashlib.sha256(t.encode()).hexdigest()] = k = (min if keep == "smallest" else max)(known, default=None)
        want.update((i, k, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert want == Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(named) and all(r.doc_id == named[r.text_sha256] for r in kept)


def test_drop_duplicates(spark, copies):
    rows, docs = copies
    left = exact_dedup.drop_duplicates(docs.withColumn("text_sha", F.col("doc_id")), keep="smallest")
    assert left.columns == ["doc_id", "text", "text_sha"]
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in rows})
    lowered = exact_dedup.drop_duplicates(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string"), normalise=F.lower)
    assert [tuple(r) for r in lowered.collect()] == [(1, "A")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_trie_gives_up_subtrees():
    rng = random.Random(2)
    trie, lost, keys = exact_dedup.PatriciaTrie(), Counter(), Counter()
    for _ in range(3000):
        key = b"x" * rng.randrange(3) + bytes(rng.choice(b"abc") for _ in range(rng.randrange(6)))
        keys[key] += 1
        if not trie.insert(key, [7, 1, 1]):
            lost[key] += 1
        elif trie.size > 20_000 and trie.count > 1:
            for k, e in trie.give_up():
                lost[k] += e[2]
            assert trie.count > 0
    here = {k: e[2] for k, e in trie.entries()}
    assert not set(here) & set(lost) and Counter(here) + lost == keys and lost
    assert trie.count == len(here)


# --- hard negatives


def mined(rows, anchors, k=5, low=80, high=100):
    rows = sorted({r for r in rows if None not in r[:3] and None not in r[2]})
    out = []
    for i, label, v in rows:
        if i not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            near = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(i, j, n + 1, s[1], -p, -s[0]) for n, s in enumerate(near)]
    return Counter(out)


@pytest.mark.parametrize(("leaf", "tree", "block"), [(128, 32_768, 20_000), (4, 50, 7)])
def test_hard_negatives(spark, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 1, 2, None]), tuple(rng.randrange(-6, 9) for _ in range(4))) for i in range(300)]
    rows += [(300 + i, r[1], r[2]) for i, r in enumerate(rows[:60])]  # ties
    rows += rows[:40] + [(None, 1, (1, 2, 3, 4)), (900, 1, None), (901, 1, (1, None, 3, 4)), (902, 0, ()), (903, 1, (3, 1)), (900, 2, (5, 5, 5, 5, 1))]
    anchors = {*range(0, 360, 10), 900, 902, 903}
    d = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x")).repartition(5)
    got = hard_negatives.hard_negatives(d, F.col("vec_id").isin(*anchors), block=block).collect()
    assert got and mined(rows, anchors) == Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_hard_negatives_odd(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives.hard_negatives(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1, [1, 2]), (1, 2, [3, 4])], "vec_id long, label int, vector array<long>")
    assert hard_negatives.hard_negatives(one, F.lit(True)).count() == 0  # no positives
    e = spark.createDataFrame([(0, 1, [0.5, -0.001]), (1, 1, [float("nan"), 1.0]), (2, 1, [None, 1.0]), (3, 1, None), (4, 1, [float("inf")])], "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: r.vector for r in hard_negatives.whole_numbers(e).collect()} == {0: [128, -1], 1: None, 2: None, 3: None, 4: None}


def test_ball_tree_bounds():
    points = np.random.default_rng(4).integers(-50, 50, (3000, 8)).astype(float)
    t = hard_negatives.BallTree(points)
    assert sorted(t.order) == list(range(3000))
    for (low, high, _), c, r in zip(t.spans, t.centres, t.radii):
        assert np.sqrt(((points[t.order[low:high]] - c) ** 2).sum(axis=1)).max() <= r + 1e-9


# --- conversation repair

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (role, text) in order. Best-first over edits, by cost and audit: the first that ends well is the answer."""
    seen, codes = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANK)
        codes.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (cost, audit, i, state) in done:
            continue
        done.add((cost, audit, i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, turns, codes
        put = lambda c, letter, j, role, text: (role[:1] and (state, role[:1]) in step) and heapq.heappush(heap, (cost + c, audit + letter, j, step[state, role[:1]], (*turns, f"{role}:{text}")))
        for role in ("user", "assistant"):
            put(3, "I", i, role, "")
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, turns))
            if codes[i] in ("", "truncated"):
                late = 3 if codes[i] else 0
                put(late, "K", i + 1, *rows[i])
                for role in ("user", "assistant"):
                    put(3 + late, "R", i + 1, role, rows[i][1])


def reported(rows):
    """What repair_report gives for one conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, audit, turns, codes = cheapest([r[1:] for r in rows])
    known = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return (gaps, *(codes.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    rows = []
    for c in [None, *range(120)]:
        for _ in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"])
            rows.append((c, rng.choice([None, *range(6)]), role, rng.choice(["Yes.", "No", "so?", "Yes.", "", None, " \t", "open ", "done! "])))
    return rows + rows[:30]


@pytest.mark.parametrize("segment", [65_536, 1, 2])
def test_repair(spark, monkeypatch, talks, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    monkeypatch.setattr(conversation_repair, "COPIES", 2 if segment == 2 else 1024)
    d = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("seg", F.lit(1)).withColumn("audit", F.lit("x")).repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(d).collect()}
    groups = defaultdict(list)
    for c, *rest in talks:
        groups[c].append(rest)
    assert got == {c: reported(rows) for c, rows in groups.items()}


def test_repaired_turns(spark, talks):
    d = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    lines = defaultdict(list)
    for r in conversation_repair.repair_conversations(d).orderBy("conv_id", "seg", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    want = {r.conv_id: r.repaired_sha256 for r in conversation_repair.repair_report(d).collect()}
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == sha for c, sha in want.items())
    assert conversation_repair.repair_report(d.limit(0)).count() == 0 and conversation_repair.repair_conversations(d.limit(0)).count() == 0


def test_long_conversation(spark, monkeypatch):
    """One conversation over many segments and tasks costs what a plain pass over it finds."""
    rng = random.Random(8)
    rows = [(rng.choice(["user", "assistant", "system"]), f"{i}{rng.choice(['.', '', '!'])}") for i in range(3000)]
    codes = bytes({"system": 1, "user": 2, "assistant": 3}[r] + (0 if t[-1] in ".!" else 4) for r, t in rows)
    found = conversation_repair.all_layers(codes, list(conversation_repair.AT_END), conversation_repair._Steps())
    best = {s: c for s, c in zip(["", "s", "u", "a"], conversation_repair.AT_END)}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    for r, t in reversed(rows):
        late = 0 if t[-1] in ".!" else 3
        now = {s: min([best[s] + 4] + [best[to] + (late if role == r[0] else 3 + late) for (f, role), to in step.items() if f == s and (role == r[0] or role != "s")]) for s in best}
        for _ in range(2):
            now = {s: min([now[s]] + [now[to] + 3 for (f, role), to in step.items() if f == s and role != "s"]) for s in best}
        best = now
    assert conversation_repair._costs(*found[0]) == [best[s] for s in ("", "s", "u", "a")]
    audit, _, cost = conversation_repair.follow(codes, found, 0, True)
    assert cost == best[""]
    monkeypatch.setattr(conversation_repair, "SEGMENT", 100)
    d = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string").repartition(4)
    got = conversation_repair.repair_report(d).collect()
    assert [(r.cost, r.audit) for r in got] == [(cost, audit)]


def test_op13(spark, tmp_path, talks):
    rows = talks + [(500, i, "user", "Hello.") for i in range(40) if zlib.crc32(f"500:{i}".encode()) % 20 == 0]  # all dropped
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        own = groups[c]
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        own += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: reported(own) if own else none for c, own in groups.items()} and got[500] == none
