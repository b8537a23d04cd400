"""Near-duplicate join on word shingles, exact at its threshold, by count vectors.

A document is the set of its 5-word shingles' 64-bit hashes. Shingles are hashed into groups and a
document's counts per group are its point: two sets share at most the sum of the coordinates' minima, so
R-tree nodes and pairs below the needed overlap are left without looking at the sets. Points of long texts
crowd together, so one tree over a corpus would open most of its nodes; the points are therefore first dealt
to blocks that lose no pair: the first shingles of each set, in one order for all (prefix filter; two sets
that reach the threshold share one of those). Shingles of many documents come last in that order.

1. Equal sets are one class. 2. In each block an R-tree finds pairs that pass the bound; those that connect
something new make families. Blocks with the same least member meet in one task, where most blocks turn out to be
connected already. 3. In each family, with its texts at hand, an R-tree of finer points and then the sets
themselves decide. 4. Links are resolved by distributed union-find. Large blocks and families are worked on as
pairs of tiles.

Links inside a component that follow from others are not all computed; no link that joins anything is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, free_name, maybe_among
from parlance.llm.components import connected_components

SHINGLE = 5
#: Groups of a count vector: for sets of up to 512, and at most; between, one for every 4 to 8 shingles.
GROUPS, MOST_GROUPS = 64, 4096
#: A shingle in the prefixes of more documents than this comes late in the order; so many such are known.
FREQUENT, KNOWN_FREQUENT = 128, 500_000
#: A set is kept with its prefix and one in so many more of its shingles, in case some of the prefix come late.
SPARE = 10
#: Members of a block or family in one tile, and rows that one task's share of blocks aims at.
TILE, SHARE = 1024, 40_000
#: Families' members that a task's share aims at.
FAMILY_SHARE = 400
FAN_OUT = 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:  # bounds the worker's memory
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _word_hashes() -> _WordHashes:
    return _WordHashes()


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words, A-Z lowered; a text of fewer words is one shingle, without
    words there is none."""
    split = (text or b"").lower().split()
    words = np.fromiter(map(_word_hashes().__getitem__, split), np.uint64, len(split))
    if not len(words):
        return words
    n = min(SHINGLE, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _MULTIPLIERS[k]
    found = _mixed(total)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def prefix_size(n: int, percent: int) -> int:
    """Of so many members of a set of n, in one order for all, a set with enough overlap must have one."""
    return n - -(-percent * n // 100) + 1


def _are_late(hashes: np.ndarray, late: np.ndarray) -> np.ndarray:
    if not len(late):
        return np.zeros(len(hashes), bool)
    return late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes


def prefix(known: np.ndarray, is_late: np.ndarray, n: int, percent: int) -> np.ndarray | None:
    """The first of a set of n in the order of hashes, late ones after all others. known: the set's least hashes; None
    if they don't tell."""
    size = prefix_size(n, percent)
    if not is_late[:size].any():
        return known[:size]
    early = known[~is_late]
    if len(early) < size and len(known) < n:
        return None
    return np.concatenate((early, known[is_late]))[:size]


def groups_for(n: int) -> int:
    """A power of 2, so that points of different lengths can be folded to the same groups."""
    return min(MOST_GROUPS, max(GROUPS, 1 << max(0, (n - 1).bit_length() - 3)))


def counts(ordered: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((ordered & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2")


def _class(ordered: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ordered.tobytes())


def _describe(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, points, least = [], [], [], []
            for t in b["text"].cast(pa.binary()).to_pylist():
                s = shingles(t)
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
                points.append(counts(s, groups_for(len(s))).tobytes())
                least.append(s[: prefix_size(len(s), percent) + len(s) // SPARE].copy().view(np.int64))  # a view would keep the whole set
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["row"], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(points, pa.binary()), pa.array(least, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_shingles", "cls", "point", "least"],
            )

    return run


def _prefixes(percent: int, late):
    """prefix of each class; null where the least shingles don't tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b["least"]
            ends, hashes = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            is_late = _are_late(hashes, late.value)
            found = [prefix(hashes[i:j], is_late[i:j], n, percent) for i, j, n in zip(ends[:-1].tolist(), ends[1:].tolist(), b["n_shingles"].to_pylist(), strict=True)]
            found = [None if x is None else x.view(np.int64) for x in found]
            yield pa.RecordBatch.from_arrays([b["alias"], b["row"], b["n_shingles"], b["point"], pa.array(found, pa.list_(pa.int64()))], names=["alias", "row", "n_shingles", "point", "prefix"])

    return run


def _prefixes_of_texts(percent: int, late):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, found = [], []
            for t in b["text"].cast(pa.binary()).to_pylist():
                s = shingles(t)
                cls.append(_class(s))
                found.append(prefix(s, _are_late(s, late.value), len(s), percent).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["alias"], pa.array(cls, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["alias", "cls", "prefix"])

    return run


def _enough(overlap, a, b, percent: int):
    """overlap / union reaches percent, where union = a + b - overlap; for numbers, arrays and columns."""
    return (100 + percent) * overlap >= percent * (a + b)


class CountVectorRTree:
    """Points packed into nodes by size and coordinates; a node knows its largest coordinates and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes))
        self.levels = [(points[self.order].astype(np.int32), sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FAN_OUT:
            top, least, most = self.levels[-1]
            starts = np.arange(0, len(least), FAN_OUT)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places (in the given order) of all points whose bound reaches the threshold."""
        found = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            fits = (100 * most[found] >= percent * size) & (100 * size >= percent * least[found])
            found = found[fits]
            bound = np.minimum(top[found], point).sum(axis=1)
            # A node's bound is against its least size; no set of a node shares more than that.
            found = found[_enough(bound, size, least[found], percent)]
            if depth:
                found = (found[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                found = found[found < len(self.levels[depth - 1][1])]
        return self.order[found]


class _Sets:
    """Union-find within a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _bounded_pairs(points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each place, the later places whose bound with it reaches the threshold."""
    tree = CountVectorRTree(points, sizes)
    for i in range(len(sizes) - 1):
        near = tree.search(points[i], sizes[i], percent)
        if len(near := near[near > i]):
            yield i, near


def _connect_blocks(percent: int):
    """Pairs that pass the bound and connect the members of a share's blocks."""

    def run(blocks: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        members = members.drop_duplicates("member").sort_values("member", ignore_index=True)
        alias, sizes = members["member"].to_numpy(), members["n_shingles"].to_numpy()
        points = [np.frombuffer(x, "<u2").astype(np.int32) for x in members["point"]]
        groups = np.array([len(x) for x in points])
        sets, out, seen = _Sets(len(alias)), [], set()
        blocks = blocks.sort_values(["token", "low", "high"], kind="stable")
        place = np.searchsorted(alias, blocks["alias"].to_numpy())
        keys = blocks[["token", "low", "high"]].to_numpy()
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for block in np.split(place, ends):
            block = np.unique(block)
            if len({sets.find(i) for i in block.tolist()}) < 2 or (mark := block.tobytes()) in seen:
                continue
            seen.add(mark)
            # Sizes of a pair differ by a quarter at most, so their numbers of groups are equal or neighbours.
            for g in np.unique(groups[block]):
                some = block[(groups[block] == g) | (groups[block] == 2 * g)]
                if len({sets.find(i) for i in some.tolist()}) > 1:
                    folded = np.stack([points[i].reshape(-1, g).sum(axis=0) for i in some])
                    for i, near in _bounded_pairs(folded, sizes[some], percent):
                        for j in near.tolist():
                            if sets.join(int(some[i]), int(some[j])):
                                out.append((alias[some[i]], alias[some[j]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _verify_families(percent: int):
    """Links of a share's families, decided by their sets; those that follow from others are left out."""

    def run(share: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, family in share.groupby(["family", "low", "high"], sort=False):
            cls = family["cls"].to_list()
            known = [shingles(t.encode()) for t in family["text"]]
            sizes = np.array([len(s) for s in known])
            groups = 1 << int(np.clip(np.ceil(np.log2(sizes.mean())) + 1, 6, 12))
            points = np.stack([counts(s, groups) for s in known]).astype(np.int32)
            sets = _Sets(len(cls))
            for i, near in _bounded_pairs(points, sizes, percent):
                for j in near.tolist():
                    if sets.find(i) != sets.find(j) and _enough(len(np.intersect1d(known[i], known[j], assume_unique=True)), sizes[i], sizes[j], percent):
                        sets.join(i, j)
                        out.append((cls[i], cls[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _rep_texts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest = [_class(shingles(t)) for t in b["text"].cast(pa.binary()).to_pylist()]
            same = [x == y for x, y in zip(digest, b["cls"].to_pylist(), strict=True)]
            yield b.select(["cls", "text"]).filter(pa.array(same, pa.bool_()))

    return run


def _tiled(df: DataFrame, rows: str, member: str) -> DataFrame:
    """Adds low and high: every two of a group's members meet in one pair of tiles. rows: the group's size."""
    d = df.withColumn("tiles", F.ceil(F.col(rows) / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int"))
    d = d.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return d.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("tiles", "tile", "other")


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, its own included) for each row of docs.

    Documents link when their shingle sets' Jaccard similarity is percent / 100 or more (percent: 50 to 100). Null, empty and wordless
    texts have no shingles and link with nothing; each is its own component. Rows with a null id take part, but
    give no component its id. Repeated rows fall into one component. Other columns are not read.
    """
    return _grouped(docs, percent, key, text, frequent).select("doc_id", "n_shingles", "component_id")


def _row_key(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text))


def _grouped(docs: DataFrame, percent: int, key: str, text: str, frequent: int = FREQUENT) -> DataFrame:
    """near_duplicates with row (hash of key and text) and component (a class; null for a text without words)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100: points of sets that differ more in size do not meet")
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), _row_key(key, text).alias("row"))
    described = cut(d.mapInArrow(_describe(percent), "doc_id long, row long, n_shingles long, cls binary, point binary, least array<long>"), "described")
    valid = described.where("cls is not null")
    size = F.expr(f"CAST(n_shingles - ({percent} * n_shingles + 99) div 100 + 1 AS INT)")
    often = valid.select(F.explode(F.slice("least", 1, size)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frequent)
    # Only the order of shingles hangs on these, not the result. As Arrow they are 8 bytes each on the driver.
    late = often.orderBy(F.desc("n"), "token").limit(KNOWN_FREQUENT).select("token").toArrow()["token"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(np.sort(late))

    # An alias of 8 bytes names a class while candidates are sought; two classes of one alias would only meet once more.
    alias = F.xxhash64("cls").alias("alias")
    unique = valid.select(alias, "row", "n_shingles", "point", "least").dropDuplicates(["alias"])  # copies meet nowhere twice
    unique = cut(unique.mapInArrow(_prefixes(percent, shared), "alias long, row long, n_shingles long, point binary, prefix array<long>"), "classes")
    tokens = unique.select("alias", F.explode("prefix").alias("token"))
    untold = unique.where("prefix is null").select("alias", F.col("row").alias("r"))
    if not untold.isEmpty():  # too many of their least shingles come late: their texts tell
        texts = maybe_among(d.select("row", "text"), "row", untold, "r").join(untold, F.col("row") == F.col("r")).select("alias", "text")
        told = texts.mapInArrow(_prefixes_of_texts(percent, shared), "alias long, cls binary, prefix array<long>").where(F.col("alias") == F.xxhash64("cls"))
        tokens = tokens.union(cut(told.dropDuplicates(["alias"]).select("alias", F.explode("prefix").alias("token")), "told"))
    met = tokens.groupBy("token").agg(F.min("alias").alias("least"), F.max("alias").alias("most"), F.count(F.lit(1)).alias("rows")).where("least <> most").drop("most")
    met = cut(met, "met")
    blocks = maybe_among(tokens, "token", met, "token").join(met, "token")
    # Blocks meet by their least member; of members with very many rows, by some of its tokens.
    large = blocks.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("salts")).where("salts > 1").orderBy(F.desc("salts"), "least").limit(100_000)
    dealt = blocks.join(F.broadcast(large.withColumnRenamed("least", "l")), F.col("least") == F.col("l"), "left")
    shares = F.pmod(F.xxhash64("least", F.pmod("token", F.coalesce("salts", F.lit(1)))), F.lit(1 << 20))
    dealt = cut(_tiled(dealt.select("token", "alias", "rows", shares.alias("share")), "rows", "alias").select("share", "token", "low", "high", "alias"), "blocks")
    points = unique.drop("prefix", "row")
    members = dealt.select(F.col("share").alias("at"), F.col("alias").alias("member")).distinct().join(points.withColumnRenamed("alias", "member"), "member")
    # Shares are grouped once more, so that a task's call handles many.
    calls = max(200, min(20_000, dealt.count() // SHARE))
    # Partitions are numbered: small ones, joined up by size, would make few and long tasks.
    blocks_by_call = dealt.withColumn("call", F.pmod("share", F.lit(calls))).repartition(calls, "call").groupBy("call")
    members_by_call = members.withColumn("call", F.pmod("at", F.lit(calls))).repartition(calls, "call").groupBy("call")
    connected = blocks_by_call.cogroup(members_by_call).applyInPandas(_connect_blocks(percent), "a long, b long")
    families = cut(connected_components(connected, "a", "b").withColumnRenamed("component", "family"), "families")

    classes = valid.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    members = cut(classes.withColumn("node", F.xxhash64("cls")).join(families, "node").select("cls", "rep", "family"), "members")
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    near = maybe_among(d, "doc_id", members, "rep")  # other texts aren't shuffled
    texts = near.join(members.select("cls", "rep"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "text")
    # An id may stand for several texts: the one of the class is meant, one row of it.
    texts = texts.mapInArrow(_rep_texts(), "cls binary, text string").dropDuplicates(["cls"])
    placed = _tiled(members.join(size, "family"), "rows", "cls").join(texts, "cls")
    count = members.count()
    shares = max(200, count // FAMILY_SHARE)
    share = F.pmod(F.xxhash64("family", "low", "high"), F.lit(shares))
    links = placed.select(share.alias("share"), "family", "low", "high", "cls", "text").repartition(min(shares, 20_000), "share").groupBy("share").applyInPandas(_verify_families(percent), "a binary, b binary")
    found = connected_components(links, "a", "b")

    top = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    ids = top.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = top.join(ids, "component").select("cls", "component", "component_id")
    joined = described.select("doc_id", "row", "n_shingles", "cls").join(answer, "cls", "left")
    return joined.select("doc_id", "row", "n_shingles", "component", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the least id, a null id last, and of several texts under that id the
    one with the least hash; of its repeated rows one. Rows whose text has no words all stay."""
    groups = _grouped(docs, percent, key, text).where("n_shingles > 0")
    row, kept, has = free_name(docs, "row_key"), free_name(docs, "kept_row"), free_name(docs, "has_words")
    least = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias(kept))
    d = docs.withColumn(row, _row_key(key, text)).withColumn(has, F.coalesce(F.col(text), F.lit("")).rlike(r"[^ \x09-\x0D]"))
    stay = d.where(F.col(has)).join(least, F.col(row) == F.col(kept), "left_semi").dropDuplicates([row])
    return d.where(~F.col(has)).unionByName(stay).drop(row, has)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def near_duplicates_sql(table: str = "documents") -> str:
    """DuckDB SQL for the same rows over a table or subquery of distinct ids."""
    return f"""
WITH RECURSIVE n_d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {table}),
n_s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM n_d WHERE len(ws) > 0)),
n_n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM n_s GROUP BY doc_id),
n_e AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM n_s x JOIN n_s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n_n p ON p.doc_id = x.doc_id JOIN n_n q ON q.doc_id = y.doc_id
        GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
n_r AS (SELECT doc_id AS a, doc_id AS b FROM n_d UNION SELECT n_r.a, n_e.b FROM n_r JOIN n_e ON n_r.b = n_e.a)
SELECT n_d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM n_d LEFT JOIN n_n ON n_n.doc_id = n_d.doc_id JOIN (SELECT a, min(b) AS c FROM n_r GROUP BY a) g ON g.a = n_d.doc_id
"""
