"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import uuid

from jobs import channel_report, passages

from ..work import shared_dir
from .catalogue import registered

BLANKS = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
UNITS = "length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"


def _folder(spark, name: str) -> str:
    """A folder of the job's own, which stays."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


@registered(f"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS w
      FROM documents WHERE doc_id IS NOT NULL),
    u AS (SELECT doc_id, unnest(range(1, length(w) + 1)) AS k, unnest(w) AS text FROM d),
    s AS (SELECT doc_id, k, {UNITS} + 1 AS chars, text FROM u),
    r AS (SELECT doc_id, k, 0 AS p, chars FROM s WHERE k = 1 UNION ALL
      SELECT r.doc_id, s.k, CASE WHEN r.chars >= 1200 THEN p + 1 ELSE p END, CASE WHEN r.chars >= 1200 THEN 0 ELSE r.chars END + s.chars FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1),
    g AS (SELECT doc_id, p, trim(regexp_replace(string_agg(text, ' ' ORDER BY k), '{BLANKS}', ' ', 'g')) AS text FROM r JOIN s USING (doc_id, k) GROUP BY doc_id, p)
    SELECT doc_id, source, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS ord, CAST(length(string_split(text, ' ')) AS INTEGER) AS n_words, text FROM g JOIN d USING (doc_id) WHERE text <> ''""")
def job1_passages(spark, d):
    folder = _folder(spark, "passages")  # a stream takes a folder or a pattern, and the table may be a single file
    for _ in range(2):
        passages.refresh(spark, f"{d}/documents.parque[t]", f"{folder}/output", f"{folder}/checkpoint")
    return passages.current(spark, f"{folder}/output")


@registered("""WITH v AS (SELECT o_orderkey AS id, o_custkey AS channel_id, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS views, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS have FROM orders),
    a AS (SELECT *, CASE WHEN id % 3 = 2 THEN NULL WHEN id % 3 = 1 THEN have ELSE 4 END AS expected, CASE WHEN id % 3 = 1 THEN id % 4 <> 0 END AS ran, coalesce(id % 5 = 0 AND have >= 3, FALSE) AS bound FROM v),
    c AS (SELECT *, NOT bound AND expected IS NOT NULL AND CASE WHEN id % 3 = 1 THEN coalesce(ran, TRUE) ELSE have >= expected END AS done FROM a),
    m AS (SELECT strftime(day, '%Y-%m') AS month, sum(views) AS month_views FROM v WHERE day IS NOT NULL GROUP BY 1),
    g AS (SELECT strftime(day, '%Y-%m') AS month, channel_id, count(*) AS videos, sum(views) AS views, CAST(sum(have) AS BIGINT) AS stored_comments, max(have) AS most_comments,
      count(*) FILTER (done) AS complete, count(*) FILTER (NOT done AND id % 7 <> 0) AS partial, count(*) FILTER (NOT done AND id % 7 = 0) AS failed, count(*) FILTER (NOT done AND id % 7 <> 0 AND bound) AS capped,
      arg_max(id, (coalesce(views, -1), -id)) AS best_video, min(day) AS first_upload, max(day) AS last_upload FROM c WHERE day IS NOT NULL GROUP BY 1, 2)
    SELECT channel_id, c_name AS name, videos, views::DOUBLE AS views, views::DOUBLE / month_views::DOUBLE AS share, stored_comments, most_comments, complete, partial, failed, capped, best_video, first_upload, last_upload, month
    FROM g JOIN m USING (month) LEFT JOIN customer ON c_custkey = channel_id""")
def job2_channel_report(spark, d):
    folder = _folder(spark, "channel-report")
    for _ in range(2):
        channel_report.run(spark, d, folder)
    return channel_report.read(spark, folder)
