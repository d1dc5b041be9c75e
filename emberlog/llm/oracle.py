"""DuckDB SQL for the operators that SQL can express, written from the definitions.

Without: ``op4`` (its added spans come from a trained model), ``op6`` and ``op11`` (a tokenizer), ``op7``
(drawn by hashes), ``op9`` and ``pipeline`` (trained models); those are tested against brute force.
"""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, width: int) -> str:
    """(key, s): distinct shingles; a shorter text has its whole sequence."""
    words = _WORDS.format(_LOWER.format("text"))
    return f"""
      SELECT DISTINCT {key}, s FROM (
        SELECT {key}, unnest(CASE WHEN len(w) >= {width}
                 THEN list_transform(range(1, len(w) - {width} + 2),
                                     lambda i: array_to_string(w[i:i + {width} - 1], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, {words} AS w FROM {table}))"""


def _reach(links: str, nodes: str) -> str:
    """``links`` (a, b, both ways) and everything reachable from each node by them."""
    return f"""
      links AS ({links}),
      reach AS (SELECT a, b FROM links UNION
                SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
      least AS (SELECT node, least(node, coalesce(min(b), node)) AS component
                FROM ({nodes}) LEFT JOIN reach ON a = node GROUP BY node)"""


OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), {_reach('''
  SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y
    ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98''', 'SELECT vec_id AS node FROM v')}
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links,
       component AS component_id, node = component AS kept
FROM least"""

OP2 = f"""
WITH RECURSIVE sets AS ({_shingles("documents", "doc_id", 4)}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets AS x JOIN sets AS y
             ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
{_reach('''
  SELECT a, b FROM common JOIN sizes AS p ON p.doc_id = a JOIN sizes AS q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)''', 'SELECT doc_id AS node FROM documents')}
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id
FROM least LEFT JOIN sizes ON doc_id = node"""

OP3 = f"""
WITH docs AS ({_shingles("documents", "doc_id", 5)}),
items AS ({_shingles("benchmark", "item_id", 5)}),
wanted AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_common, any_value(n_item) AS n_item
FROM docs JOIN items USING (s) JOIN wanted USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- 500 bytes and the 99 after them at a time: places in a long string are slow to reach
parts AS (SELECT doc_id, b, len(h) // 2 - 500 * b AS n, substr(h, 1000 * b + 1, 1198) AS h
          FROM (SELECT *, unnest(range((len(h) + 998) // 1000)) AS b FROM d)),
bytes AS (
  SELECT doc_id, 500 * b + unnest(range(least(n, 500))) AS p,
         unnest(list_transform(range(least(n, 500)), lambda p: substr(h, 2 * p + 1, 2))) AS c
  FROM parts),
windows AS (
  SELECT doc_id, 500 * b + unnest(range(least(n - 99, 500))) AS p,
         unnest(list_transform(range(least(n - 99, 500)),
                               lambda p: md5(substr(h, 2 * p + 1, 200)))) AS k
  FROM parts WHERE n >= 100),
firsts AS (SELECT k, min((doc_id, p)) AS f FROM windows GROUP BY k),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (k) WHERE f < (doc_id, p)),
marked AS (
  SELECT bytes.doc_id, bytes.p, c,
         coalesce(bytes.p - max(gone.p) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.p) < 100,
                  false) AS r
  FROM bytes LEFT JOIN gone ON gone.doc_id = bytes.doc_id AND gone.p = bytes.p
), spans AS (
  SELECT *, r AND NOT coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins
  FROM marked
), done AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (r) AS removed, count(*) FILTER (begins) AS spans,
         coalesce(string_agg(c, '' ORDER BY p) FILTER (NOT r), '') AS kept
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(removed, 0) AS n_removed,
       coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN done ON done.doc_id = d.doc_id"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM words
            WHERE p + 49 <= len(w)),
firsts AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (k) WHERE f < doc_id),
marked AS (
  SELECT words.doc_id, words.p, w[words.p] AS word,
         coalesce(words.p - max(gone.p) OVER (PARTITION BY words.doc_id ORDER BY words.p) < 50,
                  false) AS r
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
), done AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (r) AS removed,
         string_agg(word, ' ' ORDER BY p) FILTER (NOT r) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done ON done.doc_id = d.doc_id"""

OP10 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, p, l[p] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM d)),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT keyed.*, coalesce(f < doc_id, false) AS r FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT r), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP12 = r"""
WITH RECURSIVE crc_table AS (  -- the table of the reflected polynomial 0xEDB88320
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
words AS (
  SELECT 'd' AS side, doc_id, unnest(w) AS word FROM (
    SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT 'b', item_id, unnest(w) FROM (
    SELECT item_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
hashed AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] ||
           list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), crc_table),
found AS (SELECT side, doc_id, bucket FROM words JOIN hashed USING (word)),
uses AS (
  SELECT b.bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM (SELECT unnest(range(10000)) AS bucket) AS b LEFT JOIN found ON found.bucket = b.bucket
  GROUP BY b.bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(
    CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
    / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE)))::BIGINT AS gain
  FROM uses),
weights AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total
  FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents AS d LEFT JOIN weights USING (doc_id)),
summed AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM summed)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed""".replace("{lower}", _LOWER.format("coalesce(text, '')"))

OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         {_WORDS.format("text")} AS w,
         min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY coalesce(text, '')) AS f
  FROM documents),
failing AS (
  SELECT part,
         (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
         (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT AS c,
         regexp_matches(text, '[#$%&*|]')::INT AS d,
         (coalesce(doc_id, 9223372036854775807) > f)::INT AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM d),
counts AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS flags, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [v.l, w.l, x.l, y.l, z.l] AS o, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters AS v, letters AS w, letters AS x, letters AS y, letters AS z
  WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31
    AND len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (
  SELECT array_to_string(o, '') AS filter_order, s::INT AS step, bits[s] AS bit,
         coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM (SELECT *, unnest(range(1, 6)) AS s FROM orders)),
reports AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (flags & (before | bit) = 0) AS kept,
         sum(n) FILTER (flags & before = 0 AND flags & bit <> 0) AS removed,
         sum(n) FILTER (flags & before <> 0 AND flags & bit <> 0) AS redundant,
         sum(n) FILTER (flags = bit) AS unique_fails,
         sum(good) FILTER (flags & before = 0 AND flags & bit <> 0) AS good_lost,
         sum(toxic) FILTER (flags & before = 0 AND flags & bit <> 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step,
       {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in (
           "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM reports"""

LLM_ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": OP1,
    "op2_ngram_jaccard": OP2,
    "op3_decontamination": OP3,
    "op5_suffix_dedup": OP5,
    "op8_substring_dedup": OP8,
    "op10_line_dedup": OP10,
    "op12_importance_resampling": OP12,
    "op13_filter_audit": OP13,
}
