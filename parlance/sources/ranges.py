"""Entries of one large JSON object's lists, read by byte ranges.

Spark reads the file as text that ends at closing braces, so every task gets a range of bytes, from any store, and a record
never ends inside an escape: a range begins either inside a string or not. 1. For both cases each range tells what it does
to the open brackets: how many it closes, where the last separator stands at the level that is then on top, and which it leaves
open. 2. These are composed over the ranges in order (a row for each), which gives the true state at the start of each. 3. With it,
tasks cut out entries; those that cross ranges come as pieces and are put together by their place. What lies outside of the lists
is small and goes to the driver.

Inside a range numpy finds quotes, brackets and commas; Python handles entries, not bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA, CLOSE = 34, 92, 44, b"}"
STEP = np.zeros(256, np.int64)
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1
STRUCTURE = STEP != 0
STRUCTURE[COMMA] = True
#: Bytes outside of an object's lists and objects that are read: a conversation's name and id, not its content.
ENVELOPE = 1 << 20


class BracketError(ValueError):
    """Quotes or brackets don't match, or there is too much outside of them."""


class Level(NamedTuple):
    """An open bracket: where it was opened, where its last separator (or itself) stands, how many separators it has had."""

    opened: int
    separator: int
    n: int


class Effect(NamedTuple):
    """What bytes do to open brackets: closes so many, has so many separators (the last one at this place) in what is then on top, and
    leaves these open."""

    closes: int
    separators: int
    last: int
    opens: tuple[Level, ...]


NOTHING = Effect(0, 0, -1, ())


def then(a: Effect, b: Effect) -> Effect:
    """The effect of a's bytes and then b's."""
    left = list(a.opens[: len(a.opens) - b.closes]) if b.closes <= len(a.opens) else []
    if left:
        left[-1] = _marked(left[-1], b)
        return Effect(a.closes, a.separators, a.last, (*left, *b.opens))
    beyond = b.closes - len(a.opens)
    if beyond:  # what a has marked is closed again
        return Effect(a.closes + beyond, b.separators, b.last, b.opens)
    return Effect(a.closes, a.separators + b.separators, max(a.last, b.last), b.opens)


def _marked(level: Level, by: Effect) -> Level:
    return Level(level.opened, by.last, level.n + by.separators) if by.separators else level


def apply(stack: tuple[Level, ...], effect: Effect) -> tuple[Level, ...]:
    if effect.closes > len(stack):
        raise BracketError("more brackets are closed than opened")
    left = list(stack[: len(stack) - effect.closes])
    if left:
        left[-1] = _marked(left[-1], effect)
    return (*left, *effect.opens)


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of brackets and commas outside of strings, and whether a string is open at the end. data starts at no escape."""
    quotes = np.flatnonzero(data == QUOTE)
    escaped = quotes[(quotes > 0) & (data[quotes - 1] == BACKSLASH)]
    if len(escaped):
        false = []
        for q in escaped.tolist():
            n = q
            while n and data[n - 1] == BACKSLASH:
                n -= 1
            if (q - n) % 2:
                false.append(q)
        quotes = np.setdiff1d(quotes, false, assume_unique=True)
    marks = np.flatnonzero(STRUCTURE[data])
    within = (np.searchsorted(quotes, marks) + inside) % 2 == 1
    return marks[~within], bool((len(quotes) + inside) % 2)


def effect(data: np.ndarray, marks: np.ndarray, base: int) -> Effect:
    """Of the marks (see structure) of data, whose first byte is at base."""
    if not len(marks):
        return NOTHING
    step = STEP[data[marks]]
    depth = np.cumsum(step)
    low = min(0, int(depth.min()))
    commas = step == 0
    own = np.flatnonzero(commas & (depth == low))
    opens = []
    for level in range(low + 1, int(depth[-1]) + 1):
        at = int(np.flatnonzero((step == 1) & (depth == level))[-1])
        inner = at + np.flatnonzero(commas[at:] & (depth[at:] == level))
        opens.append(Level(base + int(marks[at]), base + int(marks[inner[-1] if len(inner) else at]), len(inner)))
    return Effect(-low, len(own), base + int(marks[own[-1]]) if len(own) else -1, tuple(opens))


_CLOSING = Effect(1, 0, -1, ())
_RECORDS = ["start", "size", "value"]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """start (of the range), size (of the file), value: what stands before each closing brace, in order within a range."""
    lines = spark.read.option("lineSep", CLOSE.decode()).text(path)
    return lines.select(F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, file size, bytes, whether the range ends with them), by batch. All bytes but a range's last brace are there."""
    held: tuple[int, int, bytes] | None = None
    for b in batches:
        starts = b["start"].to_numpy()
        ends = [*(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)]
        low = 0
        for high in ends:
            if high == low:
                continue
            data = CLOSE.join(b["value"][low:high].to_pylist())
            start, size = int(starts[low]), b["size"][low].as_py()
            if held:
                yield (*held[:2], held[2] + CLOSE if held[0] == start else held[2], held[0] != start)
            held = (start, size, data)
            low = high
    if held:
        yield (*held, True)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its bytes (without the last brace), and as JSON, for both cases, its effect and whether a string is open then."""
    state, n = [(NOTHING, False), (NOTHING, True)], 0
    for start, size, data, last in _by_range(batches):
        array = np.frombuffer(data, np.uint8)
        for case, (so_far, inside) in enumerate(state):
            marks, open_ = structure(array, inside)
            state[case] = (then(so_far, effect(array, marks, n)), open_)
        n += len(data)
        if last:
            yield pa.RecordBatch.from_pydict({"start": [start], "size": [size], "bytes": [n], "cases": [json.dumps(state)]})
            state, n = [(NOTHING, False), (NOTHING, True)], 0


class Range(NamedTuple):
    """The state at a range's start: its first byte, whether it is inside a string, the open brackets; whether a brace follows its bytes."""

    base: int
    inside: bool
    stack: tuple[Level, ...]
    brace: bool


def _moved(e: list, base: int) -> Effect:
    closes, separators, last, opens = e
    return Effect(closes, separators, base + last if separators else -1, tuple(Level(base + o, base + s, n) for o, s, n in opens))


def scan(rows: list) -> tuple[dict[int, Range], set[int]]:
    """The state at the start of each range, from the summaries of all, and the ranges that see the outermost level."""
    rows = sorted(rows, key=lambda r: r["start"])
    found, outer, base, inside, stack = {}, set(), 0, False, ()
    total = sum(r["bytes"] + 1 for r in rows)
    for i, r in enumerate(rows):
        brace = i < len(rows) - 1 or total == r["size"]
        found[r["start"]] = Range(base, inside, stack, brace)
        e, now = json.loads(r["cases"])[inside]
        if len(stack) - e[0] - (brace and not now) < 2:  # a brace may close one more, which is seen once too often at most
            outer.add(r["start"])
        stack, inside = apply(stack, _moved(e, base)), now
        if brace and not inside:
            stack = apply(stack, _CLOSING)
        base += r["bytes"] + brace
    if stack or inside:
        raise BracketError("a bracket or string is left open")
    return found, outer


def _walk(batches: Iterator[pa.RecordBatch], ranges: dict[int, Range]) -> Iterator[tuple]:
    """For each piece of a range: its bytes, their place, marks and depth behind each mark, and the state before it; None behind each range."""
    state: Range | None = None
    for start, _, data, last in _by_range(batches):
        state = state or ranges[start]
        if last and state.brace:
            data += CLOSE
        array = np.frombuffer(data, np.uint8)
        marks, inside = structure(array, state.inside)
        depth = len(state.stack) + np.cumsum(STEP[array[marks]])
        yield data, array, marks, depth, state
        state = Range(state.base + len(data), inside, apply(state.stack, effect(array, marks, state.base)), state.brace)
        if last:
            yield None
            state = None


def _envelope(ranges: dict[int, Range]):
    """place, value: what stands outside of inner brackets; inner ones are there as the place of the opening bracket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _walk(batches, ranges):
            if piece is None:
                continue
            data, array, marks, depth, state = piece
            # Pieces between changes of depth from below 2 to 2 and back.
            step = STEP[array[marks]]
            places, values, kept, at = [], [], len(state.stack) < 2, 0
            for i in np.flatnonzero(((step == 1) & (depth == 2)) | ((step == -1) & (depth == 1))).tolist():
                place = int(marks[i])
                if step[i] == 1:
                    if kept:
                        places.append(state.base + at)
                        values.append(data[at : place + 1] + (b"%d" % (state.base + place) if array[place] == 91 else b""))
                    kept = False
                else:
                    kept, at = True, place
            if kept:
                places.append(state.base + at)
                values.append(data[at:])
            if sum(map(len, values)) > ENVELOPE:
                raise BracketError(f"more than {ENVELOPE} bytes outside of lists")
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int64()), "value": pa.array(values, pa.binary())})

    return run


def _cut_out(ranges: dict[int, Range], opened: int):
    """Entries of the list that opens there: place in the list, where the bytes stand, bytes, and whether they are the whole entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pending, whole, since = -1, [], True, 0  # place -1: not in the list
        fresh = True
        for piece in _walk(batches, ranges):
            places, offsets, values, wholes = [], [], [], []
            if piece is None:
                if place >= 0:
                    places, offsets, values, wholes = [place], [since], [b"".join(pending)], [False]
                place, pending, fresh = -1, [], True
            else:
                data, array, marks, depth, state = piece
                if fresh:
                    level = state.stack[1] if len(state.stack) > 1 else None
                    place = level.n if level and level.opened == opened else -1
                    pending, whole, since, fresh = [], False, state.base, False
                step, at = STEP[array[marks]], 0
                for i in np.flatnonzero(((step == 1) & (depth == 2)) | ((step == 0) & (depth == 2)) | ((step == -1) & (depth == 1))).tolist():
                    mark = int(marks[i])
                    if place >= 0:
                        pending.append(data[at:mark])
                        places.append(place)
                        offsets.append(since)
                        values.append(b"".join(pending))
                        wholes.append(whole)
                    if step[i] == 1:
                        place = 0 if state.base + mark == opened else -1
                    elif place >= 0:
                        place = place + 1 if step[i] == 0 else -1
                    at, pending, whole, since = mark + 1, [], True, state.base + mark + 1
                if place >= 0:
                    pending.append(data[at:])
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int64()), "offset": pa.array(offsets, pa.int64()), "raw": pa.array(values, pa.binary()), "whole": pa.array(wholes, pa.bool_())})

    return run


class Ranges:
    """One JSON object's file: its envelope, and the entries of its lists.

    The envelope is the object with each list as [where it opens] and each inner object empty; what is no object, or no JSON so far,
    raises ValueError (BracketError, JSONDecodeError). Entries aren't parsed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.records = _records(spark, path)
        rows = self.records.mapInArrow(_summaries, "start long, size long, bytes long, cases string").collect()  # a row for each range
        self.ranges, outer = scan(rows)
        seen = self.records.where(F.col("start").isin(*outer)).mapInArrow(_envelope(self.ranges), "place long, value binary").collect() if outer else []
        text = b"".join(r["value"] for r in sorted(seen, key=lambda r: r["place"])).decode("utf-8-sig")
        self.envelope = json.loads(text)

    def entries(self, name: str) -> DataFrame:
        """place, raw: the entries of the list of this name as text, in no order. An empty list has none."""
        cut = self.records.mapInArrow(_cut_out(self.ranges, self.envelope[name][0]), "place long, offset long, raw binary, whole boolean")
        pieces = cut.where("not whole").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("offset", "raw"))).alias("p"))  # an entry's, from few ranges
        joined = pieces.select("place", F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["raw"])).alias("raw"))
        every = cut.where("whole").select("place", "raw").union(joined).select("place", F.trim(F.col("raw").cast("string"), F.lit(" \t\r\n")).alias("raw"))
        return every.where((F.col("place") > 0) | (F.col("raw") != ""))
