"""Exact duplicates by Patricia tries over whole byte strings.

1. Map side: each task inserts its texts into a compressed radix trie, whose terminal nodes count rows and know the
   identifier that owns the text. Copies meet here, so a text that makes a third of the corpus is sent once a task.
2. What is left is dealt by length and content hash and inserted into a trie for each partition. Bytes alone decide: texts
   of one length and hash are told apart by their paths.
3. A trie that outgrows its budget gives up its heaviest subtree: the texts under that prefix, and all that arrive for it
   later, leave the task as rows of a table in the shared folder, from which the next round deals them anew. So a text's
   rows are settled in one place, no task holds more than its budget (and one text), and nothing is kept on a
   machine's own disk.
4. Owners are joined back to the documents by SHA-256. Texts of at least one row in 10 000 are broadcast (10 000 rows
   at most, whatever the corpus), so that their copies don't meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, free_name

#: Bytes that a task's trie may take, and bytes of text that a partition aims at.
BUDGET, PARTITION = 128_000_000, 32_000_000
#: What a node takes besides its label.
NODE = 300
#: A text with one row in so many is broadcast when owners are joined back.
SHARE = 10_000


class _Node:
    __slots__ = ("children", "entry", "gone", "label")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.entry: list | None = None  # owner, rows with that identifier, rows
        self.gone = False  # a subtree that was given up


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by halves of byte comparisons."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings with owners. keep: "smallest" or "largest" identifier; null is behind all others."""

    def __init__(self, keep: str = "smallest"):
        self.largest = keep == "largest"
        self.root = _Node(b"")
        self.size = self.count = 0

    def _merge(self, mine: list, entry: list) -> None:
        mine[2] += entry[2]
        if mine[0] == entry[0]:
            mine[1] += entry[1]
        elif mine[0] is None or (entry[0] is not None and (entry[0] > mine[0]) == self.largest):
            mine[0], mine[1] = entry[0], entry[1]

    def insert(self, key: bytes, entry: list) -> bool:
        """False: key belongs to a subtree that was given up, and isn't inserted."""
        node, at = self.root, 0
        while not node.gone:
            if at == len(key):
                if node.entry:
                    self._merge(node.entry, entry)
                else:
                    node.entry = entry
                    self.count += 1
                return True
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = leaf = _Node(key[at:])
                leaf.entry = entry
                self.size += len(leaf.label) + NODE
                self.count += 1
                return True
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, key, at)
            middle = _Node(label[:n])
            middle.children[label[n]] = child
            child.label = label[n:]
            node.children[key[at]] = middle
            self.size += NODE
            node, at = middle, at + n
        return False

    def entries(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.entry:
                yield prefix, node.entry
            stack += [(c, prefix + c.label) for c in node.children.values()]

    def _weighed(self) -> dict[int, tuple[int, int]]:
        """Bytes and entries below each node."""
        found, order, stack = {}, [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        for node in reversed(order):
            below = [found[id(c)] for c in node.children.values()]
            found[id(node)] = len(node.label) + NODE + sum(w for w, _ in below), bool(node.entry) + sum(n for _, n in below)
        return found

    def give_up(self) -> list[tuple[bytes, list]]:
        """Detaches the heaviest subtree of less than half of all and returns its entries. Of several, at least one stays."""
        found = self._weighed()
        total, entries = found[id(self.root)]
        node, prefix = self.root, b""
        below = [self.root]
        while below and (node is self.root or 2 * found[id(node)][0] > total or found[id(node)][1] == entries):
            below = [c for c in node.children.values() if found[id(c)][1]]
            if below:
                node = max(below, key=lambda c: found[id(c)])
                prefix += node.label
        lost = list(self.entries(node, prefix))
        self.size -= found[id(node)][0]
        self.count -= len(lost)
        node.children, node.entry, node.gone = {}, None, True
        return lost


_COMBINED = pa.schema([("text", pa.binary()), ("owner", pa.int64()), ("owner_rows", pa.int64()), ("rows", pa.int64())])


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    some, n = [], 0
    for r in rows:
        some.append(r)
        n += size(r) + 64
        if n > most:
            yield _table(some, schema)
            some, n = [], 0
    if some:
        yield _table(some, schema)


def _combine(keep: str, budget: int):
    """Map side: (text, owner, owner_rows, rows) for the distinct texts of a task, as far as its budget holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(keep)
        flat = lambda t: ((k, *e) for k, e in t.entries())
        for b in batches:
            for key, owner in zip(b["text"].to_pylist(), b["doc_id"].to_pylist(), strict=True):
                trie.insert(key, [owner, 1, 1])
                if trie.size > budget:
                    yield from _batches(flat(trie), _COMBINED, lambda r: len(r[0]))
                    trie = PatriciaTrie(keep)
        yield from _batches(flat(trie), _COMBINED, lambda r: len(r[0]))

    return run


_OWNED = pa.schema([("text", pa.binary()), ("sha", pa.string()), ("owner", pa.int64()), ("owner_rows", pa.int64()), ("rows", pa.int64())])


def _own(keep: str, budget: int):
    """A trie for each partition: its terminals as SHA-256, what belongs to subtrees that it gave up as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, lost = PatriciaTrie(keep), []
        size = lambda r: len(r[0] or b"")
        for b in batches:
            for key, *entry in zip(*(b[c].to_pylist() for c in ("text", "owner", "owner_rows", "rows")), strict=True):
                if not trie.insert(key, entry):
                    lost.append((key, None, *entry))
                elif trie.size > budget and trie.count > 1:  # one text alone stays, so each round settles some
                    yield from _batches(((k, None, *e) for k, e in trie.give_up()), _OWNED, size)
            if lost:
                yield from _batches(iter(lost), _OWNED, size)
                lost = []
        yield from _batches(((None, hashlib.sha256(k).hexdigest(), *e) for k, e in trie.entries()), _OWNED, size)

    return run


def _owners(d: DataFrame, keep: str, partitions: int, budget: int) -> DataFrame:
    """(sha, owner, owner_rows, rows) for each distinct text of d (doc_id, text as binary)."""
    combined = d.mapInArrow(_combine(keep, budget), "text binary, owner long, owner_rows long, rows long")
    done = []
    while True:
        bucket = F.xxhash64(F.length("text"), F.xxhash64("text"), F.lit(len(done)))
        dealt = combined.repartition(partitions, bucket).select("text", "owner", "owner_rows", "rows")
        owned = cut(dealt.mapInArrow(_own(keep, budget), "text binary, sha string, owner long, owner_rows long, rows long"), "owners")
        done.append(owned.where("sha is not null").drop("text"))
        combined = owned.where("sha is null").drop("sha")
        if combined.isEmpty():
            break
    found = done[0]
    for x in done[1:]:
        found = found.union(x)
    return found


def _content(docs: DataFrame, text: str, normalise: Callable[[Column], Column] | None) -> Column:
    column = F.coalesce(F.col(text), F.lit(""))
    return normalise(column) if normalise else column


def text_owners(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, budget: int = BUDGET, size: int | None = None
) -> DataFrame:
    """(sha, owner, owner_rows, rows): each distinct text's SHA-256, the identifier that keeps it, how many rows have that
    identifier with that text, and how many rows have the text. size: bytes of all texts (None: they are counted first)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    content = _content(docs, text, normalise)
    if size is None:
        size = docs.agg(F.sum(F.octet_length(content))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    return _owners(docs.select(F.col(key).cast("long").alias("doc_id"), content.cast("binary").alias("text")), keep, partitions, budget)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, budget: int = BUDGET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Texts are equal when their bytes are, after normalise (a function of a column; None: as they are). A null text is an
    empty one. keep: of equal texts the row with the smallest or the largest identifier is kept; a null identifier comes
    after all others (a group of nulls has keep_id null). Of repeated rows with the kept identifier one is kept. An empty
    table gives an empty one; other columns are not read. An identifier with several texts is judged for each.
    """
    content = _content(docs, text, normalise)
    keyed = cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.sha2(content.cast("binary"), 256).alias("text_sha256"), F.octet_length(content).alias("size"), F.monotonically_increasing_id().alias("row")), "keyed")
    size = keyed.agg(F.sum("size")).first()[0] or 0
    owners = cut(text_owners(docs, key, text, keep, normalise, budget, size), "text-owners")
    state = owners.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.max("owner_rows")).first()
    total, ties = state[0], (state[1] or 0) > 1
    o = owners.select("sha", F.col("owner").alias("keep_id"), "owner_rows", F.col("rows").alias("group_size"))
    hot = F.broadcast(o.where((F.col("group_size") > 1) & (F.col("group_size") * SHARE >= total)))
    same = F.col("text_sha256") == F.col("sha")
    joined = keyed.join(hot, same).union(keyed.join(hot.select("sha"), same, "left_anti").join(o, same))
    named = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not ties:
        return joined.withColumn("kept", named).select(*result)
    joined = cut(joined.drop("sha"), "joined")
    tied = named & (F.col("owner_rows") > 1)
    first = joined.where(tied).groupBy("text_sha256").agg(F.min("row").alias("first")).select(F.col("text_sha256").alias("sha"), "first")
    # Rows other than the first one of a tie: all that aren't among the few first ones.
    kept = joined.where(tied).join(first, (F.col("row") == F.col("first")) & same).withColumn("kept", F.lit(True))
    rest = joined.where(tied).join(first, F.col("row") == F.col("first"), "left_anti").withColumn("kept", F.lit(False))
    return joined.where(~tied).withColumn("kept", named).select(*result).union(kept.select(*result)).union(rest.select(*result))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs without the rows that exact_duplicates does not keep; all columns stay as they are."""
    owners = cut(text_owners(docs, key, text, keep, normalise), "text-owners")
    sha, owned, owner, many = (free_name(docs, n) for n in ("text_sha", "owned_sha", "owner_id", "owner_rows"))
    o = owners.select(F.col("sha").alias(owned), F.col("owner").alias(owner), F.col("owner_rows").alias(many))
    d = docs.withColumn(sha, F.sha2(_content(docs, text, normalise).cast("binary"), 256))
    # By identifier too: the many copies of a hot text have many, so they aren't dealt to one task.
    kept = d.join(o, (F.col(sha) == F.col(owned)) & F.col(key).cast("long").eqNullSafe(F.col(owner)))
    return kept.where(F.col(many) == 1).unionByName(kept.where(F.col(many) > 1).dropDuplicates([sha])).select(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
