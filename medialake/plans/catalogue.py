"""Registered queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from ..functions import scalars as X
from ..functions import text as T
from ..operators import channels as ch
from ..operators import coverage as cov
from ..operators import fts, index, intervals, ordered, phrases, query, retrieval, stats, store, threads, transcript
from ..sources import exports, raw
from ..streaming import jobs
from ..work import spread, work_path
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


def fixed(x: str) -> str:
    """One decimal of the exact value; printf takes the even one of two that are equally near, and here the larger counts."""
    return f"CASE WHEN ({x}) * 4 % 4 = 1 THEN CAST(floor({x}) AS BIGINT) || '.3' ELSE printf('%.1f', {x}) END"


VIDEO = """(SELECT o_orderkey AS video_id, o_custkey AS channel_id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS upload_date, o_totalprice AS view_count,
  o_orderstatus AS availability, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS detail_at, o_orderkey % 3600 AS duration_s FROM orders)"""
STORED = "(SELECT count(*) FROM lineitem WHERE l_orderkey = v.video_id)"


@registered(f"""SELECT v.video_id, v.channel_id, v.upload_date, v.view_count, {STORED} AS stored_comments FROM {VIDEO} v
    WHERE upload_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND lower(title) LIKE '%urgent%' AND duration_s >= 60
    ORDER BY upload_date DESC NULLS LAST, video_id LIMIT 25 OFFSET 5""")
def video_page_newest(spark, d):
    q = query.VideoQuery(match="URGENT", since="1996-01-01", until="2000-12-31", min_duration=60, offset=5)
    return query.video_page(t.videos(spark, d), t.comments(spark, d), q).select("video_id", "channel_id", "upload_date", "view_count", "stored_comments")


@registered(f"""SELECT count(*) AS total FROM {VIDEO} v WHERE upload_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND lower(title) LIKE '%urgent%' AND duration_s >= 60""")
def video_page_total(spark, d):
    q = query.VideoQuery(match="URGENT", since="1996-01-01", until="2000-12-31", min_duration=60)
    return query.videos(t.videos(spark, d), t.comments(spark, d), q).agg(F.count("*").alias("total"))


@registered(f"SELECT video_id, view_count FROM {VIDEO} v WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = v.video_id) ORDER BY view_count DESC NULLS LAST, video_id LIMIT 100")
def video_with_comments(spark, d):
    rows = query.videos(t.videos(spark, d), t.comments(spark, d), query.VideoQuery(with_comments=True))
    return query.ordered(rows, query.VIDEO_ORDERS, "views", "video_id").limit(100).select("video_id", "view_count")


@registered(f"SELECT video_id FROM {VIDEO} v WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = v.video_id)")
def video_without_comments(spark, d):
    return t.videos(spark, d).join(t.comments(spark, d), "video_id", "left_anti").select("video_id")


@registered(f"SELECT video_id, {STORED} AS stored_comments FROM {VIDEO} v")
def video_stored_comment_counts(spark, d):
    return query.stored_comment_counts(t.videos(spark, d), t.comments(spark, d)).select("video_id", "stored_comments")


@registered("""SELECT l_orderkey AS video_id, l_linenumber AS line, l_quantity AS like_count FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)""")
def comments_of_channel(spark, d):
    return query.comments(t.comments(spark, d), t.videos(spark, d), query.CommentQuery(channel_id=7)).select("video_id", "line", "like_count")


KEYED = "(SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS comment_id, l_quantity AS like_count, l_shipdate AS published_at FROM lineitem)"


def _keyed(spark, d):
    parts = [F.col(c).cast("string") for c in ("video_id", "line", "author_id", "author_part")]
    return t.comments(spark, d).withColumn("comment_id", F.concat_ws(".", *parts)).withColumn("parent_id", F.lit(None).cast("string"))


def _page(order: str, sql_order: str, name: str) -> None:
    @registered(f"SELECT comment_id, row_number() OVER (ORDER BY {sql_order}, comment_id) AS place FROM {KEYED} c WHERE like_count >= 40 ORDER BY {sql_order}, comment_id LIMIT 50", name)
    def run(spark, d):
        page = query.comment_page(_keyed(spark, d), t.videos(spark, d), query.CommentQuery(min_likes=40, order=order, limit=50))
        return page.select("comment_id", F.row_number().over(W.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"))  # a page of 50


_page("likes", "like_count DESC NULLS LAST", "comment_min_likes_top")
_page("oldest", "published_at ASC NULLS FIRST", "comments_oldest_page")
_page("newest", "published_at DESC NULLS LAST", "comments_newest_page")


def _videos(order: str, sql_order: str, name: str) -> None:
    @registered(f"SELECT video_id, row_number() OVER (ORDER BY {sql_order}, video_id) AS place FROM (SELECT *, video_id % 97 AS comment_count, CASE WHEN video_id % 5 > 0 THEN video_id % 1009 END AS catalog_rank FROM {VIDEO} v) ORDER BY {sql_order}, video_id LIMIT 60", name)
    def run(spark, d):
        rows = t.videos(spark, d).withColumn("comment_count", F.col("video_id") % 97).withColumn("catalog_rank", F.when(F.col("video_id") % 5 > 0, F.col("video_id") % 1009))
        page = query.ordered(rows, query.VIDEO_ORDERS, order, "video_id").limit(60)
        return page.select("video_id", F.row_number().over(W.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"))


_videos("oldest", "upload_date ASC NULLS LAST", "videos_oldest")
_videos("comments", "comment_count DESC NULLS LAST", "videos_most_commented")
_videos("catalog", "catalog_rank ASC NULLS LAST", "videos_in_catalogue_order")


@registered(f"SELECT channel_id, count(*) AS videos, count(detail_at) AS detailed FROM {VIDEO} v GROUP BY channel_id")
def catalog_counts(spark, d):
    return query.catalogue_counts(t.videos(spark, d))


@registered("""SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
    count(*) FILTER (event_type = 'signup') AS signup FROM events""")
def state_pivot(spark, d):
    return stats.state_counts(t.read(spark, d, "events"), "event_type", ["click", "error", "purchase", "signup"])


@registered("""SELECT o_orderkey AS video_id FROM orders LEFT JOIN labels ON doc_id = o_orderkey WHERE quality IS NULL AND (o_orderstatus IS NULL OR o_orderstatus NOT IN ('P', 'F'))
    ORDER BY o_orderkey LIMIT 200""")
def pending_queue(spark, d):
    known = t.read(spark, d, "labels").select(F.col("doc_id").alias("video_id"), F.lit(True).alias("seen"))
    video = t.videos(spark, d).drop("detail_at").join(known, "video_id", "left").withColumn("detail_at", F.col("seen"))
    return query.pending_details(video, ["P", "F"], 200).select("video_id")


@registered("""SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3600 = 0 THEN NULL ELSE o_orderkey % 3600 END < 600 OR (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END) < DATE '1997-01-01' AS excluded FROM orders""")
def three_valued_exclusion(spark, d):
    video = t.videos(spark, d)
    known = video.withColumn("duration_s", F.when(F.col("video_id") % 4 != 0, F.col("duration_s"))).withColumn("upload_date", F.when(F.col("video_id") % 3 != 0, F.col("upload_date")))
    return known.select("video_id", query.excluded(600, "1997-01-01").alias("excluded"))


@registered("""SELECT CAST(conv_id AS VARCHAR) || '.0' AS root_id, count(*) FILTER (turn > 0) AS replies FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0) GROUP BY conv_id
    UNION ALL SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), 0 FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0)""")
def thread_assembly(spark, d):
    return threads.assemble(t.threaded(spark, d)).select("root_id", F.size("replies").cast("long").alias("replies"))


@registered("""SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS comment_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations c
    WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0)""")
def thread_reply_order(spark, d):
    found = threads.assemble(t.threaded(spark, d)).select(F.posexplode("replies").alias("place", "r"))
    return found.select("r.comment_id", F.col("place").cast("long").alias("place"))


@registered("""SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS comment_id FROM conversations c WHERE turn > 0 AND NOT EXISTS
    (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0 AND r.conv_id % 5 <> 0)""")
def orphan_replies(spark, d):
    capped = t.threaded(spark, d).filter("turn > 0 OR conv_id % 5 <> 0")  # as a capped extraction would leave it
    return threads.with_roots(capped).filter("is_orphan").select("comment_id")


@registered("""WITH k AS (SELECT item_id AS video_id FROM benchmark), l AS (SELECT doc_id AS video_id, source AS tab FROM documents)
    SELECT video_id, tab FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.video_id = l.video_id)""")
def new_uploads(spark, d):
    listed = t.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("source").alias("tab"), F.lit(0).alias("tab_order"), F.col("doc_id").alias("position"))
    return ch.new_uploads(listed, t.read(spark, d, "benchmark").select(F.col("item_id").alias("video_id"))).select("video_id", "tab")


LISTINGS = "(SELECT c_nationkey AS channel_id, c_mktsegment AS tab, o_orderkey % 500 AS video_id, o_orderkey AS position, ascii(c_mktsegment) AS tab_order FROM orders JOIN customer ON c_custkey = o_custkey)"


@registered(f"""SELECT channel_id, video_id, arg_min(tab, (tab_order, position)) AS tab, array_to_string(list_sort(list_distinct(list(tab))), ',') AS also_in_tabs,
    row_number() OVER (PARTITION BY channel_id ORDER BY min((tab_order, position)), video_id) - 1 AS catalog_rank FROM {LISTINGS} GROUP BY channel_id, video_id""")
def tab_ownership(spark, d):
    o, c = t.read(spark, d, "orders"), t.read(spark, d, "customer")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("channel_id"), F.col("c_mktsegment").alias("tab"), (F.col("o_orderkey") % 500).alias("video_id"), F.col("o_orderkey").alias("position"), F.ascii("c_mktsegment").alias("tab_order")
    )
    owned = ch.union_tabs(rows)
    return owned.select("channel_id", "video_id", "tab", F.array_join(F.array_sort(F.array_append("also_in_tabs", F.col("tab"))), ",").alias("also_in_tabs"), "catalog_rank")


BATCH = "(SELECT l_orderkey || '-' || l_linenumber AS comment_id, l_quantity AS like_count, l_partkey AS author_id, l_suppkey * 1000000 + l_partkey AS seq FROM lineitem)"


@registered(f"""SELECT coalesce(b.comment_id, o.comment_id) AS comment_id, coalesce(b.like_count, o.like_count) AS like_count, coalesce(o.author_id, b.author_id) AS author_id
    FROM (SELECT comment_id, arg_max(like_count, seq) AS like_count, arg_min(author_id, seq) AS author_id FROM {BATCH} GROUP BY comment_id) b
    FULL JOIN (SELECT comment_id, min(like_count) - 1 AS like_count, -1 AS author_id FROM (SELECT * FROM {BATCH} UNION ALL SELECT 'old-' || comment_id, like_count, author_id, seq FROM {BATCH}) WHERE right(comment_id, 1) IN ('1', '3') GROUP BY 1) o
    ON b.comment_id = o.comment_id""")
def latest_upsert(spark, d):
    rows = t.read(spark, d, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("comment_id"), F.col("l_quantity").alias("like_count"), F.col("l_partkey").alias("author_id"),
        (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("seq"),
    )
    both = rows.unionByName(rows.withColumn("comment_id", F.concat(F.lit("old-"), "comment_id")))
    known = both.filter(F.substring("comment_id", -1, 1).isin("1", "3")).groupBy("comment_id").agg((F.min("like_count") - 1).alias("like_count")).withColumn("author_id", F.lit(-1).cast(rows.schema["author_id"].dataType))
    return store.upsert(known, rows, "comment_id", "seq", ["like_count"])


@registered("""SELECT 'channel' AS t, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL
    SELECT 'video', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL
    SELECT 'comment', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def cascade_delete(spark, d):
    left = store.delete_channel(t.channels(spark, d), t.videos(spark, d), t.comments(spark, d), lambda: F.col("tab") == "BUILDING")
    out = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, rows in zip(("channel", "video", "comment"), left)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@registered("SELECT count(*) AS before, count(*) FILTER (role <> 'system') AS after, count(*) FILTER (role = 'system') AS removed FROM conversations")
def author_erasure_counts(spark, d):
    rows = t.threaded(spark, d).withColumn("author_id", F.lit(None).cast("string"))
    return store.prune_counts(rows, store.delete_author(rows, "system"))


RECEIPTS = """(WITH h AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS target_id, coalesce(n, 0) AS have,
      CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN coalesce(n, 0) ELSE 4 END AS expected, o_orderkey % 3 = 1 AS exhausted,
      CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 4 <> 0 END AS ran, CASE WHEN o_orderkey % 5 = 0 THEN 3 END AS cap, o_orderkey % 7 = 0 AS timeout, o_orderdate AS seen FROM orders LEFT JOIN h ON k = o_orderkey),
    b AS (SELECT *, coalesce(cap IS NOT NULL AND have >= cap, FALSE) AS bound FROM a),
    c AS (SELECT *, NOT bound AND expected IS NOT NULL AND CASE WHEN exhausted THEN coalesce(ran, TRUE) ELSE have >= expected END AS complete FROM b)
    SELECT target_id, have, expected, complete, CASE WHEN complete THEN 'COMPLETE' WHEN timeout THEN 'TIMEOUT' WHEN bound THEN 'CAP_REACHED' ELSE 'SOURCE_SILENT' END AS reason,
      CASE WHEN complete THEN 'complete' WHEN timeout THEN 'failed' ELSE 'partial' END AS state, CASE WHEN complete THEN seen + INTERVAL 7 DAY END AS stale_after FROM c)"""


@registered(f"SELECT target_id, have, complete, reason, state FROM {RECEIPTS} r")
def receipt_coverage(spark, d):
    return cov.receipts(t.attempts(spark, d)).select("target_id", "have", "complete", "reason", "state")


@registered(f"""SELECT target_id, have, (SELECT count(*) FROM lineitem WHERE l_orderkey = target_id AND l_linenumber < 5) AS stored, 'PARTIAL_ERROR' AS reason FROM {RECEIPTS} r
    WHERE have <> (SELECT count(*) FROM lineitem WHERE l_orderkey = target_id AND l_linenumber < 5)""")
def receipt_verify_mismatch(spark, d):
    stored = t.comments(spark, d).filter("line < 5").groupBy(F.col("video_id").alias("target_id")).agg(F.count("*").alias("n"))
    return cov.verify(cov.receipts(t.attempts(spark, d)), stored).select("target_id", "have", "stored", "reason")


@registered(f"""SELECT count(*) FILTER (complete) AS complete, count(*) FILTER (NOT complete) AS incomplete, count(*) FILTER (complete AND stale_after < TIMESTAMP '2000-01-01') AS stale FROM {RECEIPTS} r""")
def coverage_summary(spark, d):
    return cov.summary(cov.receipts(t.attempts(spark, d)), F.lit("2000-01-01").cast("timestamp"))


SENTENCE = f"""'Coverage: ' || CAST(have AS VARCHAR) || CASE WHEN expected IS NULL THEN ' comments' ELSE ' of ' || CASE WHEN target_id % 3 = 0 THEN 'about ' ELSE '' END || CAST(expected AS VARCHAR) || ' comments' ||
    CASE WHEN expected > 0 THEN ' (' || {fixed('have / expected::DOUBLE * 100')} || '%)' ELSE '' END END || ' for ' || CAST(target_id AS VARCHAR) || '.'"""


@registered(f"SELECT target_id, {SENTENCE} AS sentence FROM {RECEIPTS} r")
def coverage_sentences(spark, d):
    return cov.receipts(t.attempts(spark, d)).select("target_id", cov.sentence().alias("sentence"))


@registered(f"""SELECT target_id, {SENTENCE} || chr(10) || CASE WHEN complete THEN 'COMPLETE — complete, harvested ' || strftime(stale_after - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.000Z') || '.' || chr(10) ||
      'Re-check after ' || strftime(stale_after, '%Y-%m-%dT%H:%M:%S.000Z') || ' (this can change upstream).'
    ELSE 'INCOMPLETE — ' || CASE reason WHEN 'CAP_REACHED' THEN 'stopped by the requested cap' WHEN 'TIMEOUT' THEN 'timed out' ELSE 'YouTube states no total, so exhaustion cannot be proven' END ||
      CASE WHEN target_id % 2 = 0 AND target_id % 5 = 0 THEN ', sorted by "top" (a biased prefix, not a random sample)' ELSE '' END || '.' || chr(10) || 'Do not describe this as the full comment history.' ||
      CASE WHEN target_id % 11 = 0 THEN chr(10) || 'a note' ELSE '' END END AS words FROM {RECEIPTS} r""")
def coverage_texts(spark, d):
    rows = cov.receipts(t.attempts(spark, d)).withColumn("sort_applied", F.when(F.col("target_id") % 2 == 0, "top")).withColumn("note", F.when(F.col("target_id") % 11 == 0, "a note"))
    return rows.select("target_id", cov.text().alias("words"))


@registered("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS uploads FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def uploads_per_month(spark, d):
    return stats.uploads_per_month(t.videos(spark, d))


@registered(f"SELECT channel_id, min(upload_date) AS first_upload, max(upload_date) AS last_upload FROM {VIDEO} v GROUP BY channel_id")
def first_last_upload(spark, d):
    return t.videos(spark, d).groupBy("channel_id").agg(F.min("upload_date").alias("first_upload"), F.max("upload_date").alias("last_upload"))


@registered("""SELECT source, count(*) AS videos, CAST(sum(n_chars // 5) AS BIGINT) AS words, CAST(coalesce(floor(median(CASE WHEN n_chars // 5 > 0 AND doc_id % 900 > 0 THEN (n_chars // 5) / ((doc_id % 900) / 60.0::DOUBLE) END) + 0.5), 0) AS BIGINT) AS words_per_minute
    FROM documents GROUP BY source""")
def median_rate(spark, d):
    rows = t.read(spark, d, "documents").select(F.col("source").alias("channel_id"), F.expr("n_chars div 5").alias("word_count"), (F.col("doc_id") % 900).alias("duration_s"), F.lit("indexed").alias("state"), F.lit(None).cast("date").alias("upload_date"))
    return stats.corpus_stats(rows).select(F.col("channel_id").alias("source"), "videos", "words", F.col("words_per_minute").cast("long").alias("words_per_minute"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND x NOT IN (" + STOP + "))"


@registered(f"SELECT w AS token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents) GROUP BY w")
def token_counts(spark, d):
    rows = spread(t.read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens("text")).alias("token"))
    per = rows.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def bm25_sql(terms: list[str], tail: str, corpus: str | None = None, toks: str | None = None, source: str = "documents", key: str = "doc_id") -> str:
    part = f"PARTITION BY {corpus}" if corpus else ""
    distinct = list(dict.fromkeys(terms))
    tf = ", ".join(f"length(list_filter(w, lambda x: x = '{x}')) AS tf{i}" for i, x in enumerate(distinct))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) OVER ({part}) AS df{i}" for i in range(len(distinct)))
    score = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) ELSE 0::DOUBLE END" for i in map(distinct.index, terms)
    )
    first = "CASE " + " ".join(f"WHEN tf{distinct.index(x)} > 0 THEN {i}" for i, x in enumerate(terms)) + " END"
    extra = f", {corpus}" if corpus else ""
    return f"""WITH a AS (SELECT {key}{extra}, {toks or TOKENS.format('text')} AS w FROM {source}), b AS (SELECT {key}{extra}, length(w) AS len, {tf} FROM a),
      c AS (SELECT *, count(*) OVER ({part}) AS n, avg(len) OVER ({part}) AS mean, {df} FROM b), s AS (SELECT {key}{extra}, {score} AS score, {first} AS first_term FROM c WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(distinct)))}) {tail}"""


ASKED = "Nicht ordering the passage und threshold licensed license"
TERMS = retrieval.query_terms(ASKED)



@registered(bm25_sql(TERMS, "SELECT doc_id, round(z, 3) AS score FROM (SELECT doc_id, score AS z, first_term FROM s ORDER BY s.score DESC, first_term, doc_id LIMIT 10)"))
def bm25_search(spark, d):
    return retrieval.top(retrieval.search_index(t.index(spark, d, "ranked"), ASKED), 10)


@registered(bm25_sql(TERMS, "SELECT doc_id, round(z, 3) AS score FROM (SELECT doc_id, score AS z, first_term FROM s ORDER BY s.score DESC, first_term, doc_id LIMIT 10)"))
def bm25_scan(spark, d):
    return retrieval.top(retrieval.search(t.read(spark, d, "documents"), ASKED), 10)


@registered(bm25_sql(TERMS, "SELECT doc_id, round(z, 3) AS score FROM (SELECT doc_id, score AS z, first_term FROM s ORDER BY s.score DESC, first_term, doc_id LIMIT 10 OFFSET 10)"))
def bm25_page_two(spark, d):
    return retrieval.top(retrieval.search_index(t.index(spark, d, "ranked"), ASKED), 10, 10)


@registered(bm25_sql(TERMS, "SELECT count(*) AS total FROM s"))
def bm25_total(spark, d):
    return retrieval.search_index(t.index(spark, d, "ranked"), ASKED).agg(F.count("*").alias("total"))


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN lang || ' passage ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 9 <> 4)"


@registered(bm25_sql(TERMS, "SELECT doc_id, round(z, 3) AS score FROM (SELECT doc_id, score AS z, first_term FROM s ORDER BY s.score DESC, first_term, doc_id LIMIT 200)", source=CHANGED))
def index_after_changes(spark, d):
    """All documents are indexed, then some are replaced and some deleted."""
    docs = t.read(spark, d, "documents").select("doc_id", "text", "lang")
    replaced = docs.filter("doc_id % 10 = 3").withColumn("text", F.concat("lang", F.lit(" passage "), F.coalesce("text", F.lit(""))))
    kept = index.build(docs, work_path(spark, "index-changed")).add(replaced).delete(docs.filter("doc_id % 9 = 4"))
    return retrieval.top(retrieval.search_index(kept, ASKED), 200)


TITLED = f"(SELECT doc_id, text, p_name FROM documents JOIN part ON p_partkey = doc_id + 1)"
WEIGHTED = f"list_concat(list_concat({TOKENS.format('p_name')}, {TOKENS.format('p_name')}), {TOKENS.format('text')})"


@registered(bm25_sql(["part", "und"], "SELECT doc_id, round(z, 3) AS score FROM (SELECT doc_id, score AS z, first_term FROM s ORDER BY s.score DESC, first_term, doc_id LIMIT 10)", toks=WEIGHTED, source=TITLED))
def bm25_title_weight(spark, d):
    docs = t.read(spark, d, "documents").join(t.read(spark, d, "part"), F.col("p_partkey") == F.col("doc_id") + 1)
    return retrieval.top(retrieval.search(docs, "part und", T.weighted_tokens("p_name", "text")), 10)


@registered(bm25_sql(TERMS, """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, first_term, doc_id) AS rank FROM s)
    SELECT doc_id, source, round(z, 3) AS score, rank FROM (SELECT doc_id, source, score AS z, rank FROM r WHERE rank <= 5 ORDER BY rank, r.score DESC, source LIMIT 20)""", corpus="source"))
def ask_many_fused(spark, d):
    found = retrieval.search_index(t.index(spark, d, "by_source"), ASKED)
    return retrieval.fused(found, "source", 5, 20).select("doc_id", "source", "score", F.col("rank").cast("long").alias("rank"))


@registered("""WITH a AS (SELECT doc_id, text, least(nullif(strpos(lower(text), 'licensed'), 0), nullif(strpos(lower(text), 'und'), 0)) - 1 AS p FROM documents),
    b AS (SELECT doc_id, text, p, greatest(p - 120, 0) AS f, least(p + 120, length(text)) AS e FROM a)
    SELECT doc_id, CASE WHEN p IS NULL THEN trim(substr(text, 1, 240), ' ') ELSE CASE WHEN f > 0 THEN '…' ELSE '' END || trim(substr(text, f + 1, e - f), ' ') || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS excerpt FROM b""")
def excerpt(spark, d):
    return t.read(spark, d, "documents").select("doc_id", T.excerpt("text", ["licensed", "und"]).alias("excerpt"))


PHRASE_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}'']+'), lambda x: x <> '')"


@registered(f"""WITH w AS (SELECT doc_id, {PHRASE_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, length(w) - 1), lambda i: w[i:i+2])) AS g FROM w WHERE length(w) >= 3)
    SELECT array_to_string(g, ' ') AS phrase, count(DISTINCT doc_id) AS video_count, count(*) AS occurrences FROM g WHERE length(list_filter(g, lambda x: x NOT IN ({STOP}))) > 0 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def phrase_3gram(spark, d):
    return phrases.count_phrases(t.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "text"), range(3, 4), 3)


# a phrase can only be contained in one of as many videos, so the most frequent ones are compared among themselves
@registered(f"""WITH w AS (SELECT doc_id, {PHRASE_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, n, unnest(list_transform(range(1, length(w) - n + 2), lambda i: w[i:i + n - 1])) AS g FROM w, (SELECT unnest(range(3, 7)) AS n) WHERE length(w) >= n),
    c AS (SELECT array_to_string(g, ' ') AS phrase, count(DISTINCT doc_id) AS video_count, count(*) AS occurrences FROM g WHERE length(list_filter(g[1:3], lambda x: x NOT IN ({STOP}))) > 0 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
    f AS (SELECT * FROM c WHERE video_count >= (SELECT min(video_count) FROM (SELECT video_count FROM c ORDER BY video_count DESC LIMIT 2000)))
    SELECT * FROM f p WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.phrase <> p.phrase AND o.video_count >= p.video_count AND contains(o.phrase, p.phrase)) ORDER BY video_count DESC, occurrences DESC, phrase LIMIT 20""")
def phrase_ranked(spark, d):
    return phrases.most_frequent(t.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "text"))


@registered("""WITH s AS (SELECT conv_id, turn, text, concat_ws(' ', text, lead(text, 1) OVER w, lead(text, 2) OVER w) AS hay FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn FROM s WHERE strpos(lower(hay), '. th') > 0 AND strpos(lower(hay), '. th') - 1 <= length(text)""")
def phrase_match_lookahead(spark, d):
    rows = t.read(spark, d, "conversations")
    return transcript.find_phrase(rows, ". TH", key="conv_id", order="turn").select("conv_id", "turn")


SPANS = "(SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + value * 100 AS e FROM events)"


def _spans(spark, d):
    return t.read(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("start"), (F.col("ts").cast("timestamp").cast("double") + F.col("value") * 100).alias("end"))


@registered(f"""WITH o AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {SPANS} x)
    SELECT user_id, round(sum(greatest(0, e - greatest(s, coalesce(r, s)))), 2) AS covered FROM o GROUP BY user_id""")
def interval_union(spark, d):
    return intervals.covered_length(_spans(spark, d), "user_id").withColumn("covered", F.round("covered", 2))


@registered(f"SELECT user_id, event_id FROM {SPANS} x WHERE e > epoch(TIMESTAMP '2024-01-10') AND s < epoch(TIMESTAMP '2024-01-12')")
def interval_slice(spark, d):
    low, high = (F.lit(x).cast("timestamp").cast("double") for x in ("2024-01-10", "2024-01-12"))
    return intervals.overlapping(_spans(spark, d), low, high).select("user_id", "event_id")


@registered(f"""SELECT h.event_id AS hit_id, r.event_id FROM {SPANS} h JOIN {SPANS} r ON r.user_id = h.user_id AND r.e > h.s - 3600 AND r.s < h.e + 3600 AND r.event_id <> h.event_id
    WHERE h.event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def context_join(spark, d):
    rows = _spans(spark, d)
    bought = t.read(spark, d, "events").filter("event_type = 'purchase'").select("event_id")
    return intervals.context(rows.join(bought, "event_id", "left_semi"), rows, "user_id", 3600, "event_id").select("hit_id", "event_id")


@registered("""SELECT e.event_id, c.chapter FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, event_id AS chapter FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_chapter(spark, d):
    rows = t.read(spark, d, "events")
    marks = rows.filter("event_type = 'view'").select("user_id", F.col("ts").alias("mark_at"), F.col("event_id").alias("chapter"))
    return intervals.as_of(rows.filter("event_type = 'click'"), marks, "user_id", "ts", "mark_at", "chapter").select("event_id", "chapter")


@registered("""WITH a AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
    SELECT user_id, min(event_id) AS ord, max(epoch(ts) + 5) AS "end", event_type AS text, epoch(ts) AS start FROM a WHERE p IS NULL OR p <> event_type GROUP BY user_id, ts, event_type""")
def rolling_dedupe(spark, d):
    rows = t.read(spark, d, "events").withColumn("o", F.row_number().over(W.partitionBy("user_id").orderBy("ts")))
    cues = rows.select(F.col("user_id").alias("video_id"), F.col("event_id"), F.col("o").alias("ord"), F.col("ts").cast("timestamp").cast("double").alias("start"), (F.col("ts").cast("timestamp").cast("double") + 5).alias("end"), F.col("event_type").alias("text"))
    found = transcript.rolling_dedupe(cues)
    return found.join(cues.select("video_id", "ord", "event_id"), ["video_id", "ord"]).select(F.col("video_id").alias("user_id"), F.col("event_id").alias("ord"), "start", "end", "text")


@registered(f"""WITH o AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {SPANS} x)
    SELECT 'all' AS key, round(sum(greatest(0, e - greatest(s, coalesce(r, s)))), 2) AS covered FROM o""")
def interval_union_one_key(spark, d):
    """All spans under one key, which every core takes a range of."""
    rows = _spans(spark, d).select(F.lit("all").alias("key"), "start", "end")
    return intervals.covered_length(rows, "key", one_task=0).withColumn("covered", F.round("covered", 2))


@registered("""SELECT e.event_id, c.chapter FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT ts, max(event_id) AS chapter FROM events WHERE event_type = 'view' GROUP BY ts) c ON e.ts >= c.ts""")
def asof_one_key(spark, d):
    """Each click with the last view of anybody."""
    rows = t.read(spark, d, "events").withColumn("key", F.lit("all"))
    marks = rows.filter("event_type = 'view'").select("key", F.col("ts").alias("mark_at"), F.col("event_id").alias("chapter"))
    return intervals.as_of(rows.filter("event_type = 'click'"), marks, "key", "ts", "mark_at", "chapter", one_task=0).select("event_id", "chapter")


@registered("""WITH a AS (SELECT event_id, event_type, event_id // 3 AS start, lag(event_type) OVER (ORDER BY event_id) AS p FROM events)
    SELECT min(event_id) AS ord, start::DOUBLE AS start, max_by(start + 5, event_id)::DOUBLE AS "end", string_agg(event_type, ' ' ORDER BY event_id) AS text FROM a WHERE p IS NULL OR p <> event_type GROUP BY start""")
def dedupe_one_key(spark, d):
    """The whole log as one rolling caption track, three lines a second."""
    start = F.expr("event_id div 3").cast("double")
    cues = t.read(spark, d, "events").select(F.lit("all").alias("video_id"), F.col("event_id").alias("ord"), start.alias("start"), (start + 5).alias("end"), F.col("event_type").alias("text"))
    return transcript.rolling_dedupe(cues, one_task=0).select("ord", "start", "end", "text")


@registered("SELECT l_returnflag AS key, count(*) AS n, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def exact_medians(spark, d):
    rows = t.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_extendedprice").cast("double").alias("price"))
    return ordered.medians(rows, "key", "price")


@registered("""WITH RECURSIVE h AS (SELECT user_id, floor(epoch(ts) / 3600) * 3600 AS start, round(sum(value), 2) AS value FROM events GROUP BY 1, 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, start) AS k FROM h),
    r(user_id, k, chosen) AS (SELECT user_id, 1, [{'start': start, 'value': value}] FROM s WHERE k = 1 UNION ALL
      SELECT s.user_id, s.k, CASE WHEN length(chosen) < 5 AND length(list_filter(chosen, lambda c: abs(s.start - c.start) < 3 * 3600)) = 0 THEN list_append(chosen, {'start': s.start, 'value': s.value}) ELSE chosen END
      FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1),
    e AS (SELECT user_id, chosen, k, max(k) OVER (PARTITION BY user_id) AS last FROM r)
    SELECT user_id, CAST(rank - 1 AS INTEGER) AS rank, chosen[rank].start AS start, chosen[rank].value AS value FROM (SELECT user_id, chosen, unnest(range(1, length(chosen) + 1)) AS rank FROM e WHERE k = last)""")
def peak_picking(spark, d):
    hour = F.floor(F.col("ts").cast("timestamp").cast("double") / 3600)
    heat = t.read(spark, d, "events").groupBy("user_id", hour.alias("h")).agg(F.round(F.sum("value"), 2).alias("value"))
    rows = heat.groupBy("user_id").agg(F.collect_list(F.struct((F.col("h") * 3600).cast("double").alias("start"), ((F.col("h") + 1) * 3600).cast("double").alias("end"), "value")).alias("heatmap"))
    return rows.select("user_id", F.posexplode(intervals.peaks("heatmap", 5)).alias("rank", "p")).select("user_id", "rank", "p.start", "p.value")


@registered("""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn * 10.0::DOUBLE AS st, turn * 10.0::DOUBLE + 9 - turn % 4 * 3 AS en, coalesce(text, '') AS text FROM conversations),
    r AS (SELECT conv_id, k, st, en, text, 0 AS p, length(text) + 1 AS chars FROM s WHERE k = 1 UNION ALL
      SELECT conv_id, k, st, en, text, p + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN 0 ELSE chars END + length(text) + 1 FROM
        (SELECT s.*, r.p, r.chars, r.chars >= 1200 OR (r.chars >= 800 AND s.st - r.en >= 2) AS cut FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)),
    g AS (SELECT conv_id, p, min(st) AS start, max_by(en, k) AS "end", trim(regexp_replace(string_agg(text, ' ' ORDER BY k), '\\s+', ' ', 'g')) AS text FROM r GROUP BY conv_id, p)
    SELECT conv_id AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS INTEGER) AS ord, start, "end", text FROM g WHERE text <> ''""")
def chunk_passages(spark, d):
    turn = F.col("turn")
    rows = t.read(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), turn.alias("ord"), (turn * 10.0).alias("start"), (turn * 10.0 + 9 - turn % 4 * 3).alias("end"), "text")
    return transcript.passages(rows)


FTS_TOKENS = "list_filter(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _fts(name: str, asked: str, condition: str) -> None:
    @registered(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {FTS_TOKENS} AS w FROM conversations) WHERE {condition}", name)
    def run(spark, d):
        return fts.search(t.read(spark, d, "conversations"), asked).select("conv_id", "turn")


_fts("fts_boolean", "(and OR in) AND the NOT under dass", "(list_contains(w, 'and') OR list_contains(w, 'in')) AND list_contains(w, 'the') AND NOT (list_contains(w, 'under') AND list_contains(w, 'dass'))")
_fts("fts_phrase", '"of the"', "strpos(' ' || array_to_string(w, ' ') || ' ', ' of the ') > 0")
_fts("fts_prefix", "thon* AND NOTHING OR thon*", "length(list_filter(w, lambda x: starts_with(x, 'thon'))) > 0")
_fts("fts_folded", "UEBER OR ción* OR für", "list_contains(w, 'ueber') OR list_contains(w, 'fur') OR length(list_filter(w, lambda x: starts_with(x, 'cion'))) > 0")


@registered("""SELECT event_id, CASE WHEN v >= 3600 THEN printf('%d:%02d:%02d', v // 3600, v % 3600 // 60, v % 60) ELSE printf('%d:%02d', v // 60, v % 60) END AS shown,
    printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS srt, 'https://www.youtube.com/watch?v=' || event_id || '&t=' || v || 's' AS link
    FROM (SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS v, CAST(floor(value * 20 * 1000 + 0.5) AS BIGINT) AS m FROM events)""")
def timestamp_format(spark, d):
    at = F.col("value") * 20
    return t.read(spark, d, "events").select("event_id", X.format_timestamp(at).alias("shown"), X.subtitle_timestamp(at).alias("srt"), X.deep_link(F.col("event_id").cast("string"), at).alias("link"))


@registered("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_compact, CAST(o_orderdate AS DATE) AS from_dashed, NULL::DATE AS from_short FROM orders")
def compact_dates(spark, d):
    rows = t.read(spark, d, "orders")
    return rows.select("o_orderkey", X.upload_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("from_compact"), X.upload_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("from_dashed"), X.upload_date(F.date_format("o_orderdate", "yyyyMM")).alias("from_short"))


@registered("""SELECT page_id, CASE WHEN regexp_extract(url, '^https?://([^/?#:@]+)', 1) IN ('tionsh.example.net', 'm.tiontion.example.com') THEN regexp_replace(url, '^http://', 'https://') END AS allowed FROM pages""")
def host_allowlist(spark, d):
    return t.read(spark, d, "pages").select("page_id", X.allowed_url("url", ["tionsh.example.net", "m.tiontion.example.com"]).alias("allowed"))


@registered("SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4) AS prefix, count(*) AS n FROM documents GROUP BY 1")
def hash_prefix(spark, d):
    return t.read(spark, d, "documents").groupBy(X.hash_prefix(F.col("doc_id").cast("string")).alias("prefix")).agg(F.count("*").alias("n"))


@registered("""SELECT doc_id, CASE WHEN lang = source THEN lang ELSE lang || ',' || source END || ',Kept' AS merged, array_to_string(list_filter([lang, source, 'Kept'], lambda x: lower(x) NOT IN ('kept', 'en')), ',') AS left_over FROM documents""")
def tags_array_ops(spark, d):
    tags = F.array("lang", "source")
    rows = t.read(spark, d, "documents").select("doc_id", tags.alias("tags"), F.concat(tags, F.array(F.lit("Kept"))).alias("more"))
    return rows.select("doc_id", F.array_join(X.merge_tags("tags", F.array(F.lit("Kept"))), ",").alias("merged"), F.array_join(X.remove_tags("more", ["KEPT", "EN"]), ",").alias("left_over"))


@registered("""SELECT doc_id, CASE WHEN substr(c, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || c ELSE c END AS cell FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || text AS c FROM documents)""")
def csv_defuse(spark, d):
    sign = F.when(F.col("doc_id") % 4 == 0, "=").when(F.col("doc_id") % 4 == 1, "-").when(F.col("doc_id") % 4 == 2, "@").otherwise("")
    return t.read(spark, d, "documents").select("doc_id", exports.defused(F.concat(sign, F.col("text"))).alias("cell"))


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props(spark, d):
    lines = t.read(spark, d, "events").select(F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","props":'), F.col("props"), F.lit("}")).alias("value"))
    return raw.ndjson_lines(lines, "id string, props struct<k:long>").select(F.col("id").cast("long").alias("event_id"), "props.k").filter("k IS NOT NULL")


@registered("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages FROM documents WHERE lang <> 'fr-orig' GROUP BY source")
def caption_inventory(spark, d):
    rows = t.read(spark, d, "documents").groupBy("source").agg(F.collect_list("lang").alias("langs"))
    return rows.select("source", F.array_join(raw.caption_inventory(F.concat("langs", F.array(F.lit("fr-orig")))), ",").alias("languages"))


@registered("""SELECT source AS tab, count(*) AS images, count(*) FILTER (quality = 1) AS saved, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS pending, CAST(coalesce(sum(n_chars) FILTER (quality = 1), 0) AS BIGINT) AS bytes
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def stats_by_group(spark, d):
    rows = t.read(spark, d, "documents").join(t.read(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "saved").when(F.col("quality") == 0, "failed")
    return stats.image_stats(rows.select(F.col("source").alias("tab"), state.alias("state"), F.col("n_chars").alias("bytes")))


@registered("SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def rate_window(spark, d):
    return jobs.request_rate(t.read(spark, d, "events"))


@registered("""WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, s""")
def session_gap(spark, d):
    return jobs.sessions(t.read(spark, d, "events"))


@registered("""SELECT doc_id, regexp_replace(replace(replace(regexp_replace(text, '([\\\\|`\\[\\]])', '\\\\\\1', 'g'), '<', '&lt;'), '>', '&gt;'), '\\r\\n|\\r|\\n', ' ', 'g') AS line FROM documents""")
def markdown_cells(spark, d):
    return t.read(spark, d, "documents").select("doc_id", exports.markdown_cell(F.col("text")).alias("line"))


@registered(f"""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN regexp_replace({fixed('n / 1000000::DOUBLE')}, '\\.0$', '') || 'M' WHEN n >= 1000 THEN regexp_replace({fixed('n / 1000::DOUBLE')}, '\\.0$', '') || 'K' ELSE CAST(n AS VARCHAR) END AS shown
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 50)) AS BIGINT) AS n FROM orders)""")
def count_format(spark, d):
    n = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 50)).cast("long")
    rows = t.read(spark, d, "orders").select("o_orderkey", n.alias("n"))
    return rows.select("o_orderkey", X.format_count("n").alias("shown"))


@registered("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'PRIVATE' WHEN 'P' THEN 'AGE_GATED' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'LIVE_NOT_ENDED' END END AS code FROM orders")
def playability_codes(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "private").when(F.col("o_orderstatus") == "P", "needs_auth")
    live = F.when(F.col("o_orderkey") % 2 == 0, "is_upcoming").otherwise("is_live")
    return t.read(spark, d, "orders").select("o_orderkey", status.alias("a"), live.alias("l")).select("o_orderkey", X.playability("a", "l").alias("code"))


@registered("SELECT doc_id, length(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS chars FROM documents")
def word_counts(spark, d):
    return t.read(spark, d, "documents").select("doc_id", T.word_count("text").cast("long").alias("words"), F.length(T.collapse_blanks("text")).cast("long").alias("chars"))


@registered("""SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS comment_id, row_number() OVER (ORDER BY turn > 0, turn) AS place FROM conversations WHERE conv_id = 3""")
def thread_page(spark, d):
    page = query.comment_page(t.threaded(spark, d), t.videos(spark, d), query.CommentQuery(thread="3.0", limit=200))
    return page.select("comment_id", F.row_number().over(W.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"))


@registered("SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS comment_id FROM conversations WHERE turn = 0")
def top_level_comments(spark, d):
    return query.comments(t.threaded(spark, d), t.videos(spark, d), query.CommentQuery(top_level_only=True)).select("comment_id")


@registered(f"""SELECT target_id, reason FROM (SELECT target_id, reason, complete FROM {RECEIPTS} r ORDER BY finished_at DESC NULLS LAST, target_id LIMIT 200 OFFSET 50) WHERE NOT complete""".replace("stale_after FROM c)", "stale_after, seen AS finished_at FROM c)"))
def receipt_listing(spark, d):
    rows = cov.receipts(t.attempts(spark, d)).withColumn("finished_at", F.col("harvested_at"))
    return query.receipts_page(rows, "comments", incomplete_only=True, limit=200, offset=50).select("target_id", "reason")


@registered(f"""WITH p AS (SELECT video_id FROM {VIDEO} v ORDER BY view_count DESC NULLS LAST, video_id LIMIT 25) SELECT target_id, complete, reason FROM {RECEIPTS} r WHERE target_id IN (SELECT video_id FROM p)""")
def page_receipts(spark, d):
    page = query.ordered(t.videos(spark, d), query.VIDEO_ORDERS, "views", "video_id").limit(25)
    receipts = cov.receipts(t.attempts(spark, d)).withColumn("target_id", F.col("target_id").cast("string"))
    return query.with_receipts(page, receipts, "video_id", "comments").select(F.col("target_id").cast("long").alias("target_id"), "complete", "reason")


@registered("""WITH p AS (SELECT doc_id, source, n_chars // 10 AS n FROM documents), c AS (SELECT *, CASE WHEN n <= 2000 THEN n ELSE 0 END AS counted FROM p),
    s AS (SELECT *, sum(counted) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM c) SELECT doc_id, CASE WHEN n > 2000 THEN 'TOO_LARGE' WHEN total > 100000 THEN 'CORPUS_FULL' ELSE 'indexed' END AS state FROM s""")
def passage_limits(spark, d):
    rows = t.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("source").alias("channel_id"), F.col("doc_id").alias("ord"), F.expr("n_chars div 10").alias("passages"))
    return transcript.size_guards(rows).select(F.col("video_id").alias("doc_id"), "state")


@registered("""SELECT coalesce(s.video_id, l.video_id) AS video_id, CASE WHEN s.state IS NULL THEN 'pending' WHEN s.state = 'indexed' AND p.doc_id IS NULL THEN 'pending' ELSE s.state END AS state
    FROM (SELECT doc_id AS video_id, CASE quality WHEN 1 THEN 'indexed' ELSE 'failed' END AS state FROM labels) s FULL JOIN (SELECT doc_id AS video_id FROM documents) l ON s.video_id = l.video_id
    LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000) p ON p.doc_id = coalesce(s.video_id, l.video_id)""")
def reconcile_states(spark, d):
    docs = t.read(spark, d, "documents")
    states = t.read(spark, d, "labels").select(F.col("doc_id").alias("video_id"), F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("state"))
    held = docs.filter("n_chars > 1000").select(F.col("doc_id").alias("video_id"))
    return ch.reconcile(states, held, docs.select(F.col("doc_id").alias("video_id")))


@registered("SELECT c_custkey AS channel_id FROM customer WHERE lower(c_name) = 'customer#000000042'")
def channel_lookup(spark, d):
    rows = t.channels(spark, d).select("channel_id", F.col("channel_id").cast("string").alias("id"), "name")
    named = rows.select(F.col("id").alias("channel_id"), F.lit(None).cast("string").alias("handle"), "name", F.lit(None).cast("string").alias("channel_url"))
    return ch.resolve_channel(named, " Customer#000000042/ ").select(F.col("channel_id").cast("long").alias("channel_id"))


NAMES_ASKED = """(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '/' WHEN 1 THEN 'https://example.org/@c' || o_custkey || '/videos' WHEN 2 THEN o_orderpriority
    WHEN 3 THEN 'c' || o_custkey || '.' WHEN 4 THEN '@C' || o_custkey END AS name FROM orders)"""
ALIAS_KEYS = """(SELECT c_custkey AS id, unnest(['id-' || c_custkey, '@c' || c_custkey, 'c' || c_custkey, lower(c_name), lower(c_mktsegment)]) AS k FROM customer)"""


@registered(f"""WITH w AS (SELECT o_orderkey, unnest([rtrim(lower(trim(name)), '/'), lower(regexp_extract(name, '@[\\w.-]+')), lower(substr(regexp_extract(name, '@[\\w.-]+'), 2))]) AS k FROM {NAMES_ASKED} a),
    m AS (SELECT o_orderkey, count(DISTINCT id) AS n, min(id) AS id FROM w JOIN {ALIAS_KEYS} x USING (k) WHERE k <> '' GROUP BY 1)
    SELECT o.o_orderkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS channel_id FROM orders o LEFT JOIN m USING (o_orderkey)""")
def channels_resolved(spark, d):
    """Five spellings of the orders' customers, the status of each, looked up in one join."""
    who, own = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    spelt = F.when(own == 0, F.concat(F.lit(" Customer#"), F.lpad(who, 9, "0"), F.lit("/"))).when(own == 1, F.concat(F.lit("https://example.org/@c"), who, F.lit("/videos"))).when(own == 2, F.col("o_orderpriority"))
    spelt = spelt.when(own == 3, F.concat(F.lit("c"), who, F.lit("."))).otherwise(F.concat(F.lit("@C"), who))
    asked = t.read(spark, d, "orders").select("o_orderkey", spelt.alias("name"))
    key = F.col("c_custkey").cast("string")
    channel = t.read(spark, d, "customer").select(F.concat(F.lit("ID-"), key).alias("channel_id"), F.concat(F.lit("@c"), key).alias("handle"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("channel_url"))
    return ch.resolve_channels(channel, asked).select("o_orderkey", "status", F.substring("channel_id", 4, 20).cast("long").alias("channel_id"))


@registered("SELECT doc_id, 'intro' AS category, (doc_id % 50)::DOUBLE AS start, (doc_id % 50 + 2)::DOUBLE AS \"end\", doc_id % 9 AS votes FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 2 = 0")
def segments_of_videos(spark, d):
    """Even documents' segments from the answers of all but each third, of which each eleventh is also filed wrongly."""
    k = F.col("doc_id")
    rows = t.read(spark, d, "documents")
    part = F.struct(F.lit("intro").alias("category"), F.array((k % 50).cast("double"), (k % 50 + 2).cast("double")).alias("segment"), (k % 9).cast("int").alias("votes"))
    prefix = F.substring(F.sha2(k.cast("string"), 256), 1, raw.PREFIX_DIGITS)
    answers = rows.filter(k % 3 != 1).select(F.upper(prefix).alias("prefix"), k.cast("string").alias("videoID"), F.array(part).alias("segments"))
    wrong = rows.filter(k % 11 == 0).select(F.reverse(F.concat(prefix, F.lit("x"))).alias("prefix"), k.cast("string").alias("videoID"), F.array(part).alias("segments"))
    found = raw.segments_by_prefix(rows.filter(k % 2 == 0), answers.unionByName(wrong), "doc_id")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "category", "start", "end", F.col("votes").cast("long").alias("votes"))


@registered("""SELECT o_orderkey AS video_id, coalesce(q, o_totalprice) AS view_count, o_orderpriority AS title FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) ON l_orderkey = o_orderkey""")
def detail_update(spark, d):
    details = t.comments(spark, d).filter("line = 2").groupBy("video_id").agg(F.max("like_count").alias("view_count")).withColumn("title", F.lit(None).cast("string"))
    return store.update_details(t.videos(spark, d), details, ["view_count", "title"]).select("video_id", "view_count", "title")


@registered("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN m < 60 AND s < 60 THEN h * 3600 + m * 60 + s END WHEN 1 THEN CASE WHEN m < 60 AND s < 60 THEN m * 60 + s END ELSE m + 0.5::DOUBLE END AS seconds
    FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 5 AS h, CAST(floor(value) AS BIGINT) % 75 AS m, (event_id % 70) + 0.5::DOUBLE AS s FROM events)""")
def timestamp_parse(spark, d):
    h, m, s = F.floor("value").cast("long") % 5, F.floor("value").cast("long") % 75, F.col("event_id") % 70
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.format_string("%02d:%02d:%02d.5", h, m, s)).when(kind == 1, F.format_string("%d:%d.5", m, s)).otherwise(F.format_string("%d.5", m))
    return t.read(spark, d, "events").select("event_id", X.parse_timestamp(text).alias("seconds"))


@registered("""SELECT doc_id, CASE WHEN hard >= n THEN substr(text, f + 1) ELSE substr(text, f + 1, (CASE WHEN soft > f THEN soft ELSE hard END) - f) END AS part, hard < n AS truncated FROM
    (SELECT doc_id, text, n, f, hard, hard + 1 - nullif(strpos(reverse(substr(text, 1, hard + 1)), ' '), 0) AS soft FROM (SELECT doc_id, text, length(text) AS n, least(100, length(text)) AS f, least(100, length(text)) + 200 AS hard FROM documents))""")
def text_windows(spark, d):
    w = T.text_window("text", 100, 200)
    return t.read(spark, d, "documents").select("doc_id", w["text"].alias("part"), w["truncated"].alias("truncated"))


@registered("""SELECT conv_id, string_agg(CAST(turn + 1 AS VARCHAR) || chr(10) || printf('%02d:%02d:%02d,000', turn * 10 // 3600, turn * 10 // 60 % 60, turn * 10 % 60) || ' --> ' || printf('%02d:%02d:%02d,000', (turn * 10 + 9) // 3600, (turn * 10 + 9) // 60 % 60, (turn * 10 + 9) % 60)
    || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS srt FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING count(*) = max(turn) + 1""")
def subtitle_files(spark, d):
    c = t.read(spark, d, "conversations").filter("text IS NOT NULL")
    whole = c.groupBy("conv_id").agg((F.count("*") == F.max("turn") + 1).alias("whole")).filter("whole")
    rows = c.join(whole, "conv_id", "left_semi").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("ord"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 9).alias("end"), "text")
    return exports.subtitles(rows).select(F.col("video_id").alias("conv_id"), F.col("text").alias("srt"))


@registered("""SELECT c_custkey, '"' || replace(c_name, '"', '""') || ',"' AS quoted FROM customer""")
def csv_quoting(spark, d):
    rows = t.read(spark, d, "customer")
    cell = rows.select("c_custkey", F.concat("c_name", F.lit(",")).alias("name"))
    lines = exports.csv_lines(cell).select(F.split("line", ",", 2).alias("p"))
    return lines.select(F.col("p")[0].cast("long").alias("c_custkey"), F.col("p")[1].alias("quoted"))


@registered("""SELECT o_orderkey, CASE WHEN NOT (e <= s OR (dur > 0 AND s >= dur)) THEN CASE WHEN dur > 0 THEN least(e, dur) ELSE e END END AS clipped FROM
    (SELECT o_orderkey, (o_orderkey % 50)::DOUBLE AS s, (o_orderkey % 70)::DOUBLE AS e, (o_orderkey % 3 * 20)::DOUBLE AS dur FROM orders)""")
def range_clamp(spark, d):
    part = lambda m: (F.col("o_orderkey") % m).cast("double")
    return t.read(spark, d, "orders").select("o_orderkey", X.clamp_range(part(50), part(70), part(3) * 20)["end"].alias("clipped"))
