"""DuckDB SQL for the operators that SQL can express.

Left out: token ids (2, 5, 12), the byte windows of 3 (too slow on whole tables), the class model (6) and the label
model (10). tests/llm compares those with brute force."""

from __future__ import annotations

from .licenses import BASE, MENTION, RARE_WORDS, SLACK, TEMPLATES, WORDS_A_POSTING, firm
from .near_dedup import SIMILARITY

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def sharding_sql(limit: int) -> str:
    own = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""
WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
      CAST('0x' || substr(md5({own}), 1, 8) || substr(md5({own} || '/' || md5(coalesce(text, ''))), 1, 7) AS BIGINT) AS hash FROM documents),
  b AS (SELECT depth, hash >> (60 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(hash) AS a, max(hash) AS z
    FROM h, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) GROUP BY ALL),
  f AS (SELECT h.doc_id, h.hash, h.n_bytes, min(depth) AS depth FROM h JOIN b ON b.prefix = h.hash >> (60 - b.depth) WHERE shard_bytes <= {limit} OR a = z GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(hash >> (60 - f.depth)), 60, '0'), f.depth) END AS shard, f.depth, shard_docs, shard_bytes, shard_bytes <= {limit} AS fits
FROM f JOIN b ON b.depth = f.depth AND b.prefix = f.hash >> (60 - f.depth)"""


def licenses_sql() -> str:
    phrase = lambda p: "' " + "  ".join(p.split()) + " '"
    at = lambda words, i: " AND ".join(f"w[{i} + {k}] = '{x}'" for k, x in enumerate(words, 1))
    listed = lambda own: "[" + ", ".join(f"'{x}'" for x in own) + "]"
    parts = []
    for label, p in BASE.items():
        parts.append(f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, w, unnest(range(0, length(w))) AS i FROM d WHERE contains(t, {phrase(p)})) WHERE {at(p.split(), 'i')}")
    key = lambda k, place: f"{{'place': {place}, 'words': {listed(k.split())}, 'firm': CAST({firm(k)} AS BIGINT[])}}"
    templates = ", ".join(f"({n}, '{t.label}', {listed(t.words)}, [{', '.join(key(k, a) for k, a in zip(t.keys, t.places))}])" for n, t in enumerate(TEMPLATES))
    near = f"range({-SLACK}, {SLACK + 1})"
    here = "s + k.place + d + i"
    stands = f"""length(list_filter(k.firm, lambda i: {here} >= 0 AND w[{here} + 1] = k.words[i + 1])) = length(k.firm)
        AND length(list_filter(range(0, length(k.words)), lambda i: {here} >= 0 AND w[{here} + 1] = k.words[i + 1])) >= length(k.words) - 1"""
    return f"""
WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
  p AS ({' UNION ALL '.join(parts)}),
  g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
  t(tid, label, words, keys) AS (VALUES {templates}),
  df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM d) GROUP BY word),
  own AS (SELECT tid, 0 AS kind, 0 AS place, greatest({RARE_WORDS}, length(words) // {WORDS_A_POSTING}) AS most, words FROM t UNION ALL SELECT tid, 1, keys[1].place, {RARE_WORDS}, keys[1].words FROM t),
  spelt AS (SELECT tid, kind, place, most, word, min(k) AS k FROM (SELECT tid, kind, place, most, unnest(words) AS word, unnest(range(0, length(words))) AS k FROM own) GROUP BY ALL),
  ranked AS (SELECT tid, word, place + k AS at_, most, row_number() OVER (PARTITION BY tid, kind ORDER BY coalesce(n, 0), k) AS nth
    FROM spelt LEFT JOIN df USING (word)),
  rare AS (SELECT DISTINCT tid, word, at_ FROM ranked WHERE nth <= most),
  hits AS (SELECT DISTINCT doc_id, tid, word, i - at_ AS s FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, length(w))) AS i FROM d) JOIN rare USING (word)),
  c AS (SELECT DISTINCT a.doc_id, a.tid, a.s FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.tid = b.tid AND a.word <> b.word AND abs(a.s - b.s) <= {SLACK}),
  met AS (SELECT doc_id, label, length(list_filter(range(0, length(words)), lambda i: length(list_filter({near}, lambda d: s + i + d >= 0 AND w[s + i + d + 1] = words[i + 1])) > 0)) / length(words)::DOUBLE AS share
    FROM c JOIN d USING (doc_id) JOIN t USING (tid) WHERE length(list_filter(keys, lambda k: length(list_filter({near}, lambda d: {stands})) > 0)) = length(keys)),
  m AS (SELECT doc_id, list(DISTINCT label) AS own, max(share) AS share FROM met GROUP BY doc_id)
SELECT d.doc_id, length(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(labels, [])))), ',') AS labels, greatest(CASE WHEN n_base > 0 THEN {MENTION}::DOUBLE ELSE 0.0::DOUBLE END, coalesce(share, 0.0)) AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)"""


CONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least(length(w), 10) AS size, array_to_string(w[i:i + least(length(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, length(w) - least(length(w), 10) + 2)) AS i FROM b WHERE length(w) > 0)),
  d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM
    (SELECT doc_id, w, size, unnest(range(1, length(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE length(w) >= size)),
  hits AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
  covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, length(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(length(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def url_filters_sql(entries: list[tuple[str, str, str, str]]) -> str:
    values = ", ".join(f"('{a}', '{p}', TIMESTAMP '{day}', '{action}')" for a, p, day, action in entries)
    return f"""
WITH e(list, pattern, at_, action) AS (VALUES {values}),
  s AS (SELECT list, pattern, at_, bool_or(action = 'remove') AS gone FROM e GROUP BY ALL),
  iv AS (SELECT list, pattern, at_ AS active_from, lead(at_) OVER (PARTITION BY list, pattern ORDER BY at_) AS active_to, gone FROM s),
  p AS (SELECT page_id, url, to_timestamp(1704067200 + page_id * 7919 % 525600 * 60) AT TIME ZONE 'UTC' AS fetched_at, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
      lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path FROM pages),
  m AS (SELECT page_id, list, active_from FROM p JOIN iv ON NOT gone AND fetched_at >= active_from AND (active_to IS NULL OR fetched_at < active_to)
      AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND (host || rtrim(path, '/') || '/') LIKE pattern || '/%'))),
  g AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, max(active_from) AS since FROM m GROUP BY page_id)
SELECT p.page_id, url, fetched_at, host, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists, since AS active_since FROM p LEFT JOIN g USING (page_id)"""


NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  g AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN length(w) = 0 THEN [] WHEN length(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, length(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d) GROUP BY ALL),
  n AS (SELECT doc_id, sum(c) AS n FROM g GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= {SIMILARITY} * (x.n + y.n - common)),
  reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.z FROM reach r JOIN (SELECT a AS y, b AS z FROM links UNION ALL SELECT b, a FROM links) l ON l.y = r.y)
SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY x"""


MIXING = """
WITH d AS (SELECT doc_id, source, length(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
      CAST('0x' || substr(md5('7/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15) AS BIGINT) AS turn FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
  -- sources in the order in which they reach twice their size; ``cut`` and ``free`` are what those before it hold and the weights from it on
  o AS (SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS cut, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free, sum(source_size) OVER () AS total
    FROM s WINDOW w AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT cut, free, total FROM o WHERE (3 * total - 2 * cut) * weight <= 4 * source_size * free ORDER BY cut, free DESC LIMIT 1),
  t AS (SELECT o.source, o.source_size, CASE WHEN (3 * f.total - 2 * f.cut) * o.weight > 4 * o.source_size * f.free THEN (2 * o.source_size)::DOUBLE
      ELSE ((3 * f.total - 2 * f.cut) * o.weight)::BIGINT::DOUBLE / (2 * f.free)::BIGINT::DOUBLE END AS target FROM o, f),
  b AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS flow, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE flow // source_size * size + greatest(0, least(flow % source_size - before, size)) END::BIGINT AS taken FROM b)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, taken, taken // greatest(size, 1) AS copies, taken % greatest(size, 1) AS rest FROM r"""


def oracles(shard_bytes: int, entries: list[tuple[str, str, str, str]]) -> dict[str, str]:
    return {
        "op1_sharding": sharding_sql(shard_bytes), "op4_licenses": licenses_sql(), "op7_decontamination": CONTAMINATION, "op8_url_filters": url_filters_sql(entries), "op9_near_dedup": NEAR, "op11_mixing": MIXING,
    }
