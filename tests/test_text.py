"""Hashes of entities, cover density and snippets, against plain Python."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import community, search


def digest(text, entities):
    kept = sorted(entities, key=lambda e: (e.get("offset", 0), e.get("length", 0), e.get("type", "")))
    return hashlib.sha256(json.dumps(["chv1", text, "", "text", kept], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


ENTITIES = [
    [{"type": "text_link", "offset": 0, "length": 3, "url": "https://e.org/?a=\"1\"&b"}],
    [{"type": "text_link", "offset": 0, "length": 3, "url": "https://e.org/2"}],
    [{"type": "text_mention", "offset": 4, "length": 2, "user": {"id": 7, "is_bot": False, "first_name": "Ünal", "username": "u"}}, {"type": "pre", "offset": 0, "length": 3, "language": "python"}],
    [{"type": "custom_emoji", "offset": 1, "length": 2, "custom_emoji_id": "53"}, {"type": "bold", "offset": 1, "length": 2}, {"type": "bold", "offset": 0, "length": 9}],
    [],
]


def test_entity_hashes(spark):
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(ENTITIES)], "i int, e string")
    none = F.lit(None).cast("string")
    fields = "offset:int,length:int,type:string,url:string,language:string,custom_emoji_id:string,user:struct<id:bigint,is_bot:boolean,first_name:string,username:string,last_name:string>"
    for kind in ("array<variant>", f"array<struct<{fields}>>"):
        got = rows.select("i", T.content_hash(F.lit("hi"), none, none, F.from_json("e", kind)).alias("h")).collect()
        assert {r.i: r.h for r in got} == {i: digest("hi", e) for i, e in enumerate(ENTITIES)}
    merged = rows.select("i", F.transform(T.merge_entities(F.from_json("e", "array<variant>"), F.from_json(F.lit('[{"type":"bold","offset":1,"length":2,"url":"late"}]'), "array<variant>")), lambda v: F.to_json(v)).alias("m")).collect()
    assert [len(r.m) for r in sorted(merged, key=lambda r: r.i)] == [2, 2, 3, 3, 1] and "late" not in "".join(merged[3].m)


def test_canonical_json(spark):
    values = [{"b": [1, {"z": None, "a": "é\n\"", "A": [True, []]}], "a": 1.5}, [], {}, "x", 3, [[1], [2, {"k": {"l": {}}}]]]
    got = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, v string").select("i", T.canonical_json(F.parse_json("v")).alias("c")).collect()

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        return [clean(x) for x in v] if isinstance(v, list) else v

    assert {r.i: r.c for r in got} == {i: json.dumps(clean(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, v in enumerate(values)}
    with pytest.raises(Exception, match="nested deeper"):
        spark.range(1).select(T.canonical_json(F.parse_json(F.lit("[" * 9 + "]" * 9)))).collect()


def test_merge_json(spark):
    from parlance.operators import ingest

    rows = [('{"b": {"y": null, "x": [1, {"k": "é\\n"}]}, "a": 1}', '{"c": true, "a": null}'), (None, '{"a": {}}'), ("", None), ('{"z": 0.5, "a": []}', "")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", ingest.merge_json(F.col("a"), F.col("b")).alias("m")).collect()
    want = {i: json.dumps((json.loads(a) if a else {}) | (json.loads(b) if b else {}), sort_keys=True, ensure_ascii=False) for i, (a, b) in enumerate(rows)}
    assert {r.i: r.m for r in got} == want


def covers(terms_at, n):
    """Minimal stretches of (pos, term) with all n terms, by trying all."""
    found = []
    for i, (first, _) in enumerate(terms_at):
        for j in range(i, len(terms_at)):
            if len({t for _, t in terms_at[i : j + 1]}) == n:
                if len({t for _, t in terms_at[i + 1 : j + 1]}) < n:
                    found.append((first, terms_at[j][0], j - i + 1))
                break
    return found


def test_cover_density(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        n = rng.randrange(1, 4)
        rows.append((i, n, [(p, rng.randrange(n)) for p in sorted(rng.sample(range(40), rng.randrange(0, 15)))]))
    got = spark.createDataFrame(rows, "i int, n int, e array<struct<pos:int,term:int>>").select("i", T.cover_density(F.col("e"), F.col("n")).alias("rank")).collect()
    want = {i: sum(0.1 / (1 + (b - a) - (hits - 1)) for a, b, hits in covers(e, n)) for i, n, e in rows}
    assert all(abs(r["rank"] - want[r.i]) < 1e-9 for r in got) and sum(v > 0 for v in want.values()) > 20


def snippet(text, terms, most, least, short):
    words = [w for w in re.split(r"\s+", text) if w]
    own = [re.sub(r"[\W_]+", "", w.lower()) for w in words]
    here = [t for t in dict.fromkeys(terms) if t in own]
    found = covers([(i, here.index(w)) for i, w in enumerate(own) if w in here], len(here)) if here else []
    ranked = sorted((b - a + 1 > most, 0 if b - a + 1 > most else -hits, b - a + 1, a) for a, b, hits in found)
    first, size = (ranked[0][3], min(ranked[0][2], most)) if ranked else (0, least)
    end = min(max(first + size, first + least), len(words))
    begin = max(min(first, end - least), 0)
    while end - begin > least and len(words[end - 1]) <= short and own[end - 1] not in here:
        end -= 1
    while end - begin > least and len(words[begin]) <= short and own[begin] not in here:
        begin += 1
    return " ".join(f"<b>{w}</b>" if o in here else w for w, o in list(zip(words, own))[begin:end])


@pytest.mark.parametrize(("most", "least", "short"), [(35, 10, 2), (6, 3, 2), (1, 1, 0)])
def test_headline(spark, most, least, short):
    rng = random.Random(most)
    rows = [(i, " ".join(rng.choice(["Cat,", "dog", "a", "of", "house", "(dog)", "bird!", "to", "x"]) for _ in range(rng.randrange(0, 40))), rng.sample(["cat", "dog", "bird", "none"], rng.randrange(1, 4))) for i in range(80)]
    got = spark.createDataFrame(rows, "i int, t string, q array<string>").select("i", T.headline(F.col("t"), F.col("q"), most, least, short).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: snippet(t, q, most, least, short) for i, t, q in rows}
    with pytest.raises(ValueError):
        T.headline(F.col("t"), F.col("q"), 0)


def test_snippets_of_query(spark):
    from parlance.plans import archive

    sf = "/root/testdata/sf0.001"
    asked = {i: q.lower().split() for i, _, q in archive.ASKED}
    texts = {r.message_id: r.text for r in archive.table(spark, sf, "messages").select("message_id", "text").collect()}
    rows = archive.QUERIES["search_snippets"](spark, sf).collect()
    assert rows and all(r.snippet == snippet(texts[r.message_id], asked[r.query_id], 35, 10, 2) for r in rows)
    escaped = [r.snippet.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("&lt;b&gt;", "<b>").replace("&lt;/b&gt;", "</b>") for r in rows]
    assert [r.html for r in rows] == escaped


def test_numbered(spark):
    d = spark.createDataFrame([(k,) for k in (5, -3, 40, 17, 18)], "k long")
    assert {r.k: r.n for r in community.numbered(d, "k", "n", 10).collect()} == {-3: 1, 5: 2, 17: 3, 18: 4, 40: 5}
    assert community.numbered(d.limit(0), "k", "n").count() == 0


def test_stem_computes_each_step_once(spark):
    plan = spark.range(1).select(T.russian_stem(F.concat(F.lit("новостями"), F.col("id").cast("string")))).where("id >= 0")._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 30  # 566 when each step was written out


def test_search_deals_no_text_by_chat(spark):
    """A chat may hold most of a corpus: its texts stay in the tasks that read them."""
    messages = spark.range(10).selectExpr("0L AS chat_id", "id AS message_id", "id AS user_id", "'The text' AS text", "'' AS caption", "'normal' AS memory_policy", "false AS is_redacted", "id AS captured_at", "'h' AS content_hash")
    queries = spark.createDataFrame([(1, 0, "the"), (2, 0, " The "), (3, 0, ""), (4, 1, "the")], "query_id long, chat_id long, query string")
    gone = spark.createDataFrame([("message:0:9", "completed")], "tombstone_key string, status string")
    found = search.search(messages, queries, gone)
    assert sorted((r.query_id, r.message_id, r.place) for r in found.collect()) == [(q, 9 - p, p) for q in (1, 2) for p in (3, 2, 1)]
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x or "ShuffledHashJoin" in x]
    assert not [x for x in dealt if "Join [chat_id#" in x or "Join [term#" in x]
