"""A stored index for governed search: which messages have a term, and where.

Postings are rows (term, chat, message, positions) of the current versions of visible messages, kept in the order of term, chat and message, so
that a query's terms are found by the files' own statistics, and the messages of a very common term lie in many files. A message that
changes gets postings of a later generation, and a row in unposted (chat, message, generation) hides the earlier ones, so an
edit or an erasure writes its own messages alone; compacting folds them in. Erasures that aren't in the index yet hide messages
when a query is answered, as in search.

A text's rank is bounded by its rarest term: no more shortest stretches than terms hold one occurrence of it, and none is worth more than the
weight. A query's best texts by that bound are ranked first, and only texts whose bound reaches the last of them are looked
at further: positions of all others are not sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import cover_density, normalize_query, search_tokens
from parlance.operators.governance import ACTIVE, visible, without_tombstones
from parlance.operators.search import _terms

KEY = ["chat_id", "message_id"]
ABOUT = ["user_id", "captured_at", "content_hash"]
WEIGHT = 0.1
#: Up to so many asked terms are named in the scan of the postings; more are found by the join alone.
NAMED = 1000


def postings(messages: DataFrame, generation: int = 0, analyzer: str = "simple", stop_words: list[str] | None = None) -> DataFrame:
    """term, chat_id, message_id, positions (ascending), generation, and what a query needs to know of the message. messages: their
    current version (see versions.current_versions). Messages that may not be shown have none."""
    tokens = _terms(search_tokens(F.col("text"), F.col("caption")), analyzer, stop_words or [])
    at = visible(messages).select(*KEY, *ABOUT, F.posexplode(tokens).alias("pos", "term"))
    found = at.groupBy("term", *KEY, *ABOUT).agg(F.array_sort(F.collect_list("pos")).alias("positions"))  # of one message
    return found.select("term", *KEY, *ABOUT, "positions", F.lit(generation).cast("long").alias("generation"))


def in_order(rows: DataFrame) -> DataFrame:
    """Postings as they are stored."""
    order = ["term", *KEY]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def unposted(messages: DataFrame, generation: int) -> DataFrame:
    """Rows that hide the postings of messages before a generation."""
    return messages.select(*KEY).distinct().withColumn("generation", F.lit(generation).cast("long"))


def valid(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    """Postings that no later generation hides."""
    last = hidden.groupBy(*KEY).agg(F.max("generation").alias("_last"))
    return rows.join(last, KEY, "left").where(F.col("_last").isNull() | (F.col("generation") >= F.col("_last"))).drop("_last")


def search_postings(rows: DataFrame, hidden: DataFrame, queries: DataFrame, tombstones: DataFrame, limit: int = 3, analyzer: str = "simple", stop_words: list[str] | None = None) -> DataFrame:
    """The same as search.search, from postings and what hides them."""
    if limit < 1:
        raise ValueError("limit must be positive")
    terms = queries.select("query_id", F.col("chat_id").alias("q_chat"), F.array_distinct(_terms(search_tokens(normalize_query(F.col("query"))), analyzer, stop_words or [])).alias("terms"))
    wanted = terms.select("query_id", "q_chat", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("idx", "q_term"))
    named = [r["q_term"] for r in wanted.select("q_term").distinct().limit(NAMED + 1).collect()]
    asked = rows.where(F.col("term").isin(*named)) if len(named) <= NAMED else rows
    met = asked.join(wanted, (F.col("term") == F.col("q_term")) & (F.col("chat_id") == F.col("q_chat")))
    met = without_tombstones(valid(met, hidden), tombstones, ACTIVE)
    key = ["query_id", "n_terms", *KEY, "user_id", "captured_at"]
    bounds = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.min(F.size("positions")).alias("rarest")).where("met = n_terms")
    bounds = bounds.withColumn("bound", WEIGHT * F.col("n_terms") * F.col("rarest"))
    best = lambda rank: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(rank), F.desc("captured_at"), F.desc("message_id")))

    def ranked(some: DataFrame) -> DataFrame:
        some = some.select(F.col("query_id").alias("_q"), *[F.col(c).alias(f"_{c}") for c in KEY])
        own = met.join(some, (F.col("query_id") == F.col("_q")) & (F.col("chat_id") == F.col("_chat_id")) & (F.col("message_id") == F.col("_message_id")), "left_semi")
        events = F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("idx").alias("term"))))))  # of one message
        return own.groupBy(*key).agg(events.alias("events")).withColumn("rank", F.round(cover_density(F.col("events"), F.col("n_terms"), WEIGHT), 6))

    first = bounds.withColumn("place", best("bound")).where(F.col("place") <= limit)
    last = ranked(first).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= limit, F.min("rank")).otherwise(0.0).alias("last")).withColumnRenamed("query_id", "_query")
    near = bounds.join(last, F.col("query_id") == F.col("_query")).where(F.col("bound") >= F.col("last") - 1e-6)
    found = ranked(near).withColumn("place", best("rank"))
    return found.where(F.col("place") <= limit).select("query_id", *KEY, "user_id", "rank", "place")


def update_index(log, changed: DataFrame, analyzer: str = "simple", stop_words: list[str] | None = None) -> None:
    """One commit on a table log: the postings of changed messages (as they are now; those that may not be shown any more have none)
    take the place of their earlier ones. The first commit makes the index."""

    def make(tables):
        generation = log.version() + 1
        return {}, {"postings": in_order(postings(changed, generation, analyzer, stop_words)), "unposted": unposted(changed, generation)}, None

    log.change(make, {"index": "update"})


def compact_index(log) -> None:
    """One commit: postings without hidden ones, in one order, and nothing hidden."""
    log.change(lambda t: ({"postings": in_order(valid(t["postings"], t["unposted"])), "unposted": t["unposted"].limit(0)}, {}, None), {"index": "compact"})


def search_index(log, queries: DataFrame, tombstones: DataFrame, limit: int = 3, analyzer: str = "simple", stop_words: list[str] | None = None) -> DataFrame:
    """search.search from the newest index of a table log."""
    tables = log.tables()
    return search_postings(tables["postings"], tables["unposted"], queries, tombstones, limit, analyzer, stop_words)
