"""Hard negatives by branch-and-bound over ball trees.

Rows are dealt to tasks by their content, and each task packs them into ball trees: a node is a range of points with a
centre and a radius. The inner product of an anchor with any point of a node is within radius times the anchor's length
of its product with the centre, so a node is bounded above and below: it is left when all of it lies outside the window of
scores, or strictly beneath the anchor's current kth. Trees are built once and written; one pass over them finds the
positives of a block of anchors, a second the negatives in the windows that the positives' scores set.

Anchors come in blocks of ANCHORS, which tasks get whole (20 000 vectors, whatever the number of rows); their best k rows
go on from tree to tree of a task, so that a task sends k rows for an anchor and not k for a tree.

Components are whole numbers, and products are sums of doubles that stay below 2^53, so scores are exact; where they
could not, the job ends with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents

#: Anchors in a block, rows in a tree, points in a leaf.
ANCHORS, TREE, LEAF = 20_000, 32_768, 128
EXACT = 1 << 53


class BallTree:
    """Points in the order of the tree, and its nodes: from, to, left child (-1: a leaf; the right one follows), centre, radius."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, centres, radii = [[0, len(points), -1]], [], []
        at = 0
        while at < len(spans):
            low, high, _ = spans[at]
            own = self.order[low:high]
            p = points[own]
            centre = p.mean(axis=0)
            apart = np.sqrt(((p - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(apart.max())
            if high - low > LEAF:
                first = p[apart.argmax()]
                second = p[((p - first) ** 2).sum(axis=1).argmax()]
                middle = (high - low) // 2
                self.order[low:high] = own[np.argpartition(p @ (second - first), middle)]
                spans[at][2] = len(spans)
                spans += [[low, low + middle, -1], [low + middle, high, -1]]
            at += 1
        self.spans, self.centres, self.radii = np.array(spans), np.stack(centres), np.array(radii)


_TREES = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("points", pa.binary()), ("width", pa.int32()), ("spans", pa.binary()), ("centres", pa.binary()), ("radii", pa.binary())])
_TREES_SQL = "ids binary, labels binary, points binary, width int, spans binary, centres binary, radii binary"


def _padded(vectors: list, width: int) -> np.ndarray:
    """Vectors of another length are filled up with zeros."""
    if all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of at most TREE rows."""

    def tree(rows: pa.Table) -> pa.RecordBatch:
        vectors = rows["vector"].to_pylist()
        points = _padded(vectors, max(map(len, vectors)))
        t = BallTree(points.astype(np.float64))
        labels = rows["label"].to_numpy()[t.order]
        most = int(np.abs(points).max(initial=0))
        small = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        parts = [rows["vec_id"].to_numpy()[t.order], labels, points[t.order].astype(small)]
        row = [*(x.tobytes() for x in parts), points.shape[1], *(x.tobytes() for x in (t.spans, t.centres, t.radii))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TREES, strict=True)], schema=_TREES)

    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += len(b)
        while n >= TREE:
            rows = pa.Table.from_batches(waiting)
            yield tree(rows[:TREE])
            waiting, n = rows[TREE:].to_batches(), n - TREE
    if n:
        yield tree(pa.Table.from_batches(waiting))


class _Best:
    """The k best rows of each query: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores.max(axis=1) >= np.maximum(self.scores[which, -1], np.finfo(np.float64).min)
        which, scores = which[some], scores[some]
        if len(which):
            k = self.scores.shape[1]
            both = np.concatenate((self.scores[which], scores), axis=1)
            all_ids = np.concatenate((self.ids[which], np.broadcast_to(ids, scores.shape)), axis=1)
            best = np.lexsort((all_ids, -both), axis=1)[:, :k]
            self.scores[which], self.ids[which] = np.take_along_axis(both, best, 1), np.take_along_axis(all_ids, best, 1)


class _Search:
    """Branch-and-bound of one block of queries. low, high: windows of scores; same: whether labels must agree or differ."""

    def __init__(self, vectors: list, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.vectors, self.ids, self.labels, self.low, self.high, self.same = vectors, ids, labels, low, high, same
        self.best, self.width = _Best(len(ids), k), -1

    def _fit(self, width: int) -> None:
        """Queries at the trees' width: components beyond either's length meet zeros."""
        if width != self.width:
            self.q = _padded([v[:width] for v in self.vectors], width)
            self.real = self.q.astype(np.float64)
            self.length, self.width = np.sqrt((self.real**2).sum(axis=1)), width

    def run(self, tree: dict) -> None:
        width = tree["width"]
        self._fit(width)
        self.spans = np.frombuffer(tree["spans"], np.int64).reshape(-1, 3)
        self.radii = np.frombuffer(tree["radii"])
        self.centres = np.frombuffer(tree["centres"]).reshape(len(self.radii), width)
        n = len(tree["ids"]) // 8
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(tree["points"]) // (n * width) if width else 8]
        self.points = np.frombuffer(tree["points"], kind).reshape(n, width)
        self.own, self.own_labels = np.frombuffer(tree["ids"], np.int64), np.frombuffer(tree["labels"], np.int64)
        most = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        if most(self.points) * most(self.q) * max(width, 1) >= EXACT:
            raise OverflowError("scores must stay below 2^53: scale the components down")
        self._visit(0, np.arange(len(self.ids)), self.real @ self.centres[0])

    def _visit(self, node: int, queries: np.ndarray, products: np.ndarray) -> None:
        # A little is added for what doubles round off.
        around = self.radii[node] * self.length[queries] * (1 + 1e-9) + np.abs(products) * 1e-9 + 1e-3
        live = (products + around >= np.maximum(self.low[queries], self.best.scores[queries, -1])) & (products - around <= self.high[queries])
        queries, products = queries[live], products[live]
        if not len(queries):
            return
        low, high, left = self.spans[node]
        if left < 0:
            scores = self.real[queries] @ self.points[low:high].T.astype(np.float64)
            fits = (self.own_labels[low:high] == self.labels[queries][:, None]) == self.same
            fits &= (self.own[low:high] != self.ids[queries][:, None]) & (scores >= self.low[queries][:, None]) & (scores <= self.high[queries][:, None])
            self.best.take(queries, np.where(fits, scores, -np.inf), self.own[low:high])
            return
        # Each query goes to the child with the greater product first.
        near = self.real[queries] @ self.centres[left : left + 2].T
        first = near[:, 0] >= near[:, 1]
        self._visit(left, queries[first], near[first, 0])
        self._visit(left + 1, queries, near[:, 1])
        self._visit(left, queries[~first], near[~first, 0])


def _searched(block) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*block.value)
        for b in batches:
            for tree in b.to_pylist():
                search.run(tree)
        query, place = np.nonzero(search.best.scores > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(search.best.scores[query, place].astype(np.int64)), pa.array(search.best.ids[query, place])], names=["query", "score", "vec_id"]
        )

    return run


def _pass(trees: DataFrame, k: int, vectors: list, ids, labels, low, high, same: bool) -> DataFrame:
    """(query: its place, rank from 1, vec_id, score): the k best of each query among all trees."""
    block = trees.sparkSession.sparkContext.broadcast((vectors, np.array(ids, np.int64), np.array(labels, np.int64), np.array(low, np.float64), np.array(high, np.float64), same, k))
    found = trees.mapInArrow(_searched(block), "query long, score long, vec_id long")
    # A rank with a bound: Spark keeps k rows of a query in each task before the shuffle.
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label (whole numbers), vector (array of whole numbers). anchors: a condition on rows. The positives of an
    anchor are the first rows with its label and another id; for each, the negatives are the first rows of another label
    with a score from low to high percent of the positive's. First: by higher score (inner product with the anchor), then
    by smaller id.

    Rows without id, label or vector, or with a null component, take no part. Repeated rows (id, label and vector) are one.
    A vector that is shorter than another counts as filled with zeros. A positive score below zero has an empty window
    where low is under high. No anchors, positives or negatives give no rows. Other columns are not read.
    """
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), anchors.alias("anchor"))
    d = d.where("vec_id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)")
    # Copies are told by all they hold, so they meet, combined first, in the task that makes a tree of them.
    d = d.groupBy("vec_id", "label", "vector").agg(F.bool_or(F.coalesce("anchor", F.lit(False))).alias("anchor"))
    d = cut(d, "vectors")
    trees = cut(d.select("vec_id", "label", "vector").mapInArrow(_grow, _TREES_SQL), "trees")
    asked = d.where("anchor")
    blocks = max(1, -(-asked.count() // block))
    answers = []
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == i).orderBy("vec_id", "label", "vector").collect()
        ids, labels, vectors = ([r[c] for r in mine] for c in ("vec_id", "label", "vector"))
        everything = [-math.inf] * len(ids), [math.inf] * len(ids)
        found = _pass(trees, positives, vectors, ids, labels, *everything, True).collect() if mine else []  # a block's times positives
        windows = [(r["query"], r["score"], -(-low * r["score"] // 100), high * r["score"] // 100) for r in found]
        # Positives of one score have one window.
        wanted = sorted({w for w in windows if w[2] <= w[3]})
        if not wanted:
            continue
        at = [w[0] for w in wanted]
        near = _pass(trees, negatives, [vectors[a] for a in at], [ids[a] for a in at], [labels[a] for a in at], [w[2] for w in wanted], [w[3] for w in wanted], False)
        place = {w[:2]: n for n, w in enumerate(wanted)}
        known = [(place[r["query"], r["score"]], ids[r["query"]], r["vec_id"], r["score"]) for r in found if (r["query"], r["score"]) in place]
        pairs = rows.sparkSession.createDataFrame(known, "query long, anchor_id long, positive_id long, positive_score long")
        answers.append(cut(pairs.join(near.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}), "query"), "negatives"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not answers:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = answers[0]
    for a in answers[1:]:
        whole = whole.unionByName(a)
    return whole.select(*names)


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector: components times scale, rounded down. Rows with a null or non-finite component lose their vector."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return embeddings.select("vec_id", "label", F.when(finite, F.transform(x, lambda v: F.floor(v * scale))).alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(documents(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5
"""
