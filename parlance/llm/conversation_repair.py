"""Cheapest repair of conversations to turns of the form (system? (user assistant)+)?, by bit-parallel cost layers.

Turns are edited in order: Keep (free, if the role fits), Rerole to user or assistant (3), Delete (4; the only edit of blank
and of repeated turns) and Insert of an empty user or assistant turn anywhere (3). A truncated turn that stays costs 3 more.

A layer is the set of grammar states from which the turns still to come can be repaired at a given cost or less: four bits.
All layers of a place in a conversation are one number, four bits a layer, counted from the cheapest layer that isn't empty, so
that an edit of cost c is a shift by 4 c bits, and a step over one turn a few shifts and masks. Steps go from the last turn to
the first; the first layer that has the start state gives the cost. From the start the layers are then followed forward,
each time by the least letter (D, I, K, R) that keeps to the cost, which makes the least of the cheapest audits.

A conversation may be of any length. Turns are sorted over the cluster by conversation and turn, and what a conversation
has in one task is a segment (SEGMENT turns or TEXT characters at most). 1. Each segment's transfer costs, from each state
before it to each behind it, are found by layers. 2. A scan from a conversation's last segment to its first makes of them the
costs behind each segment. 3. Each segment follows its layers from each state before it. 4. A scan from the first to
the last tells which state that is. Scans see 16 numbers for up to 65 536 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents

#: Turns and characters of a segment, repeated rows in one record, and turns that a task follows.
SEGMENT, TEXT, COPIES, SHARE = 65_536, 4_000_000, 1024, 50_000
KEEP_LATE, REROLE, DELETE, INSERT = 3, 3, 4, 3

#: Grammar states: nothing yet, after system, after user, after assistant; the first and the last accept.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the role that may be inserted, and the states after system, user and assistant (-1: not allowed).
INSERTED = "uuau"
AFTER = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NAMES = {"u": "user", "a": "assistant"}
#: Costs behind the last turn: of the inserts that are needed there.
AT_END = (0, 2 * INSERT, INSERT, 0)

LAYERS = 32  # the costs of two states differ by less, or one has none
EACH = sum(1 << 4 * d for d in range(LAYERS))
ALL = 15 * EACH
#: A turn's code: what it is for the grammar (0 other, 1 to 3 system, user, assistant), 4 if truncated; or this, if it must go.
GONE = 8


def _pack(costs: list[int | None]) -> tuple[int, int]:
    """Layers and the cost of the first from costs by state (None: no way)."""
    least = min(c for c in costs if c is not None)
    layers = 0
    for state, c in enumerate(costs):
        if c is not None:
            layers |= EACH << 4 * (c - least) + state & ALL  # in its layer and all above
    return layers, least


def _costs(layers: int, base: int) -> list[int | None]:
    """The cost by state: the first layer that has it."""
    out: list[int | None] = []
    for state in range(4):
        own = layers >> state & EACH
        out.append(base + ((own & -own).bit_length() - 1) // 4 if own else None)
    return out


def _by_role(layers: int, role: str) -> int:
    """Layers before a turn of this role."""
    if role == "s":
        return layers >> SYSTEM & EACH
    if role == "u":
        return (layers >> USER & EACH) * (1 << NOTHING | 1 << SYSTEM | 1 << ASSISTANT)
    return (layers >> ASSISTANT & EACH) << USER


def _step(layers: int, code: int) -> tuple[int, int]:
    """Layers before a turn, and how much the cost of the first one grows, from those behind it."""
    now = layers << 4 * DELETE
    if code != GONE:
        late = KEEP_LATE if code & 4 else 0
        if code & 3:
            now |= _by_role(layers, "?sua"[code & 3]) << 4 * late
        now |= (_by_role(layers, "u") | _by_role(layers, "a")) << 4 * (REROLE + late)
    while (more := now | (_by_role(now, "u") | _by_role(now, "a")) << 4 * INSERT) & ALL != now & ALL:
        now = more
    grown = 0
    while not now >> 4 * grown & 15:
        grown += 1
    top = (now >> 4 * (LAYERS - 1)) & 15  # layers beyond the last one have what that has
    now = now & ALL
    now = (now >> 4 * grown) | sum(top << 4 * (LAYERS - 1 - k) for k in range(grown))
    return now, grown


class _Steps(dict):
    """_step, remembered: conversations come to few different layers."""

    def __missing__(self, key: tuple[int, int]) -> tuple[int, int]:
        if len(self) > 100_000:  # bounds the worker's memory
            self.clear()
        self[key] = x = _step(*key)
        return x


def transfer(codes: bytes, steps: dict) -> list[int]:
    """Costs from each state before the turns to each behind them, row by row; -1: no way."""
    out = [[-1] * 4 for _ in range(4)]
    for target in range(4):
        layers, base = _pack([0 if s == target else None for s in range(4)])
        for c in reversed(codes):
            layers, grown = steps[layers, c]
            base += grown
        for state, cost in enumerate(_costs(layers, base)):
            if cost is not None:
                out[state][target] = cost
    return [x for row in out for x in row]


def all_layers(codes: bytes, behind: list[int], steps: dict) -> list[tuple[int, int]]:
    """Layers and first costs before each turn, and behind the last."""
    found = [_pack(behind)]
    for c in reversed(codes):
        layers, grown = steps[found[-1][0], c]
        found.append((layers, found[-1][1] + grown))
    return found[::-1]


def follow(codes: bytes, found: list[tuple[int, int]], state: int, last: bool) -> tuple[str, int, int]:
    """The least of the cheapest audits from state, the state behind it and its cost. last: nothing follows, so what is missing
    at the end is inserted."""
    audit: list[str] = []
    cost_at = lambda i, s: _costs(*found[i])[s]
    memo: dict = {}
    spent = 0
    for i, code in enumerate(codes):
        while True:
            key = (found[i][0], found[i][1] - found[i + 1][1], found[i + 1][0], code, state)
            if (x := memo.get(key)) is None:
                here = cost_at(i, state)
                late = KEEP_LATE if code != GONE and code & 4 else 0
                role = "?sua"[code & 3] if code != GONE else "?"
                wanted = INSERTED[state]
                after = AFTER[wanted][state]
                options = [("D", state, DELETE, i + 1), ("I", after, INSERT, i)]
                if code != GONE:
                    if role != "?" and AFTER[role][state] >= 0:
                        options.append(("K", AFTER[role][state], late, i + 1))
                    options.append(("R", after, REROLE + late, i + 1))
                x = next((letter, to, cost, at - i) for letter, to, cost, at in options if (rest := cost_at(at, to)) is not None and rest + cost == here)
                memo[key] = x
            letter, state, cost, moved = x
            audit.append(letter)
            spent += cost
            if moved:
                break
    if last:
        while state not in (NOTHING, ASSISTANT):
            audit.append("I")
            spent += INSERT
            state = AFTER[INSERTED[state]][state]
    return "".join(audit), state, spent


_SEGMENTS = "conv string, seg long, codes binary, roles array<string>, texts array<string>, first string, last string, illegal long, transfer array<long>"
LEGAL = {"su", "ua", "au"}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a sorted partition's turns. Only turns that may stay have their role and text in the arrays."""
    steps, number = _Steps(), TaskContext.get().partitionId() << 32
    waiting: list[dict] = []
    conv, codes, roles, texts, first, last, illegal, size = None, bytearray(), [], [], "", "", 0, 0

    def close() -> None:
        nonlocal number, codes, roles, texts, illegal, size
        if codes:
            waiting.append({"conv": conv, "seg": number, "codes": bytes(codes), "roles": roles, "texts": texts, "first": first, "last": last, "illegal": illegal, "transfer": transfer(codes, steps)})
            number += 1
        codes, roles, texts, illegal, size = bytearray(), [], [], 0, 0

    schema = pa.schema(
        [("conv", pa.string()), ("seg", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("transfer", pa.list_(pa.int64()))]
    )
    for b in batches:
        for c, role, text, code, copies in zip(*(b[x].to_pylist() for x in ("conv", "role", "text", "code", "copies")), strict=True):
            if c != conv or len(codes) >= SEGMENT or size > TEXT:
                close()
                conv = c
            initial = role[:1]
            if codes:
                illegal += last + initial not in LEGAL
            else:
                first = initial
            illegal += (copies - 1) * (initial + initial not in LEGAL)
            last = initial
            codes.append(code)
            codes += bytes([GONE]) * (copies - 1)  # the copies repeat the first
            if code != GONE:
                roles.append(role)
                texts.append(text)
                size += len(text)
        if len(waiting) > 500:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting.clear()
    close()
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _scan(df: DataFrame, columns: list[str], backward: bool, visit: Callable, schema: str, out: pa.Schema) -> DataFrame:
    """A pass over each conversation's segments in order, or against it: visit(state, row) gives the next state and a row; state is
    None at a conversation's start. Memory is one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["conv"] != conv:
                    conv, state = r["conv"], None
                state, row = visit(state, r)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, out)

    order = F.desc("seg") if backward else F.asc("seg")
    return df.select(*columns).repartition("conv").sortWithinPartitions("conv", order).mapInArrow(run, schema)


def _costs_behind(behind: list[int] | None, r: dict) -> tuple[list[int], dict]:
    last = behind is None
    if last:
        behind = list(AT_END)
    t = r["transfer"]
    before = [min(t[4 * s + q] + behind[q] for q in range(4) if t[4 * s + q] >= 0) for s in range(4)]
    least = min(before)
    return [x - least for x in before], {"conv": r["conv"], "seg": r["seg"], "behind": behind, "is_last": last}


def _state_before(carried: tuple | None, r: dict) -> tuple[tuple, dict]:
    state, last = carried or (NOTHING, None)
    seam = last is not None and last + r["first"] not in LEGAL
    return (r["states"][state], r["last"]), {"conv": r["conv"], "seg": r["seg"], "state": state, "illegal": r["illegal"] + seam}


_FOLLOWED = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("states", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = _Steps()
    for b in batches:
        rows = []
        for r in b.to_pylist():
            found = all_layers(r["codes"], r["behind"], steps)
            ways = [follow(r["codes"], found, s, r["is_last"]) for s in range(4)]
            rows.append({k: r[k] for k in ("conv", "seg", "first", "last", "illegal")} | {"audits": [w[0] for w in ways], "states": [w[1] for w in ways], "costs": [w[2] for w in ways]})
        yield pa.RecordBatch.from_pylist(rows, _FOLLOWED)


_REPAIRED = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])))])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            state, audit = r["state"], r["audits"][r["state"]]
            turns, place, own = [], 0, zip(r["roles"], r["texts"], strict=True)
            for letter in audit:
                role, text = INSERTED[state], ""
                if letter != "I":
                    live = r["codes"][place] != GONE
                    place += 1
                    if live:
                        known, text = next(own)
                    if letter == "D":
                        continue
                    if letter == "K":
                        role = known[:1]
                turns.append({"role": known if letter == "K" else NAMES[role], "text": text, "edit": letter})
                state = AFTER[role][state]
            rows.append({"conv": r["conv"], "seg": r["seg"], "audit": audit, "cost": r["costs"][r["state"]], "illegal": r["illegal"], "turns": turns})
        yield pa.RecordBatch.from_pylist(rows, _REPAIRED)


def _known(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv (as text; a null is told from all others), turn, role, text: nulls but the turn's are one space."""
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(name.alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))


SPACES = " \t\n\x0b\x0c\r"


def _judged(known: DataFrame) -> DataFrame:
    """Distinct turns with their copies, fault (null, blank, duplicate, truncated: the first that holds) and code."""
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    turns = known.withColumn("digest", digest).groupBy("conv", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    turns = cut(turns, "turns")
    # Turns that say what an earlier one said: by their keys alone, counted before they are sent.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    thin = turns.select("conv", "role", "digest", order.alias("order"))
    first = thin.groupBy("conv", "role", "digest").agg(F.min("order").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = thin.join(first, ["conv", "role", "digest"]).where(F.col("order") > F.col("least"))
    again = again.select(F.col("conv").alias("c"), F.col("order.at").alias("at"), F.col("role").alias("r"), F.col("digest").alias("x"), F.lit(True).alias("again"))
    same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("at")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("x"))
    found = turns.join(again, same, "left").select("conv", "turn", "role", "text", "copies", "again")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    group = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).otherwise(group + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return found.withColumn("fault", fault).withColumn("code", code).drop("again")


def repair_segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Repaired segments and faults by conversation.

    Segments: conv, seg (their order in a conversation), audit (a letter for each edit), cost, illegal (neighbours of roles that
    don't follow each other, before the repair; a seam counts for the later segment), turns (role, text, edit) without deleted ones.
    Faults: conv, gaps (numbers that are missing between the least and the greatest), blank, duplicate, truncated.
    conv is "=" and the conversation's id, or empty for a null id.

    Order: by turn number, nulls first, then by role and text. A null role or text is one space, so a null text is
    blank and a null role fits nowhere. Repeated rows are duplicates of the first. Role names count by their first letter,
    and a kept turn keeps its name. No rows give empty tables. Other columns are not read.
    """
    judged = _judged(_known(turns, conv, turn, role, text))
    judged = cut(judged, "judged")
    n = lambda fault, each: F.sum(F.when(F.col("fault") == fault, F.lit(1) if each else F.col("copies")).otherwise(0))
    # Copies of a turn beyond the first are duplicates, unless it is blank.
    extra = F.sum(F.when(F.coalesce("fault", F.lit("")).isin("", "truncated"), F.col("copies") - 1).otherwise(0))
    by_turn = judged.groupBy("conv", "turn").agg(n("blank", False).alias("b"), (n("duplicate", False) + extra).alias("d"), n("truncated", True).alias("t"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    faults = by_turn.groupBy("conv").agg(gaps.alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))

    # A row that is there very often is split, so that no record is longer than a segment.
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))
    split = judged.select("conv", "turn", "role", "text", "code", "copies", parts.alias("part"))
    code = F.when(F.col("part") == 0, F.col("code")).otherwise(GONE).cast("int")
    split = split.select("conv", "turn", "role", "text", "part", code.alias("code"), F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES).cast("int").alias("copies"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "part"]
    segments = cut(split.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, _SEGMENTS), "segments")

    behind = _scan(segments, ["conv", "seg", "transfer"], True, _costs_behind, "conv string, seg long, behind array<long>, is_last boolean", pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("behind", pa.list_(pa.int64())), ("is_last", pa.bool_())]))
    # Numbered partitions: by their bytes, a byte for each turn, Spark would join them up to few.
    turns_known = segments.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns_known // SHARE)
    dealt = lambda d: d.repartition(parts, "conv", "seg")
    ways = dealt(segments.select("conv", "seg", "codes", "first", "last", "illegal")).join(dealt(behind), ["conv", "seg"]).select("conv", "seg", "codes", "behind", "is_last", "first", "last", "illegal")
    ways = cut(ways.mapInArrow(_follow, "conv string, seg long, states array<long>, audits array<string>, costs array<long>, first string, last string, illegal long"), "audits")
    states = _scan(ways, ["conv", "seg", "states", "first", "last", "illegal"], False, _state_before, "conv string, seg long, state long, illegal long", pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("state", pa.int64()), ("illegal", pa.int64())]))
    whole = dealt(segments.select("conv", "seg", "codes", "roles", "texts")).join(dealt(ways.select("conv", "seg", "audits", "costs")), ["conv", "seg"]).join(dealt(states), ["conv", "seg"])
    repaired = whole.mapInArrow(_render, "conv string, seg long, audit string, cost long, illegal long, turns array<struct<role: string, text: string, edit: string>>")
    return repaired, faults


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seg, place, role, text, edit: the turns of the repaired conversations, in the order of seg and place. See
    repair_segments for what counts as what."""
    kind = turns.schema[conv].dataType
    repaired, _ = repair_segments(turns, conv, turn, role, text)
    each = repaired.select("conv", "seg", F.posexplode("turns").alias("place", "t"))
    return each.select(_id(kind).alias("conv_id"), "seg", "place", "t.role", "t.text", "t.edit")


def _id(kind):
    return F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)


_DIGESTS = pa.schema([("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of rows sorted by conversation and segment; texts go through the hash as they come."""
    conv, sha, audit, illegal, cost, lines = None, None, [], 0, 0, 0
    done: list[dict] = []

    def close() -> None:
        if conv is not None:
            done.append({"conv": conv, "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != conv:
                close()
                conv, sha, audit, illegal, cost, lines = r["conv"], hashlib.sha256(), [], 0, 0, 0
            audit.append(r["audit"])
            illegal, cost = illegal + r["illegal"], cost + r["cost"]
            for t in r["turns"]:
                sha.update(f"{chr(10) if lines else ''}{t['role']}:{t['text']}".encode())
                lines += 1
        if len(done) > 5000:
            yield pa.RecordBatch.from_pylist(done, _DIGESTS)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, _DIGESTS)


def repair_report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text` lines): a row for each
    conversation. One hash over a conversation has to see it in order: a conversation's repaired turns stream through
    one task, which keeps the hash's state and the audit alone."""
    kind = turns.schema[conv].dataType
    repaired, faults = repair_segments(turns, conv, turn, role, text)
    digests = repaired.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_digests, "conv string, illegal long, cost long, audit string, repaired_sha256 string")
    return faults.join(digests, "conv").select(_id(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that the query plants, by CRC-32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes
    `.!?` out of it, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind")
    d = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations")
    report = repair_report(damage(turns)).withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct()
    joined = every.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
