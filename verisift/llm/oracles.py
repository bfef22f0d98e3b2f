"""SQL for the operators whose results SQL can express."""

from __future__ import annotations

from verisift.llm import divergence as d

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

_WORD = r"[^\x20\x09-\x0D]"
_VOCABULARY = ", ".join(f"('{lang}', [{', '.join(repr(w) for w in words)}])" for lang, words in d.COMMON_WORDS.items())


def _without(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


DIVERGENCE_SQL = rf"""
WITH v AS (SELECT * FROM (VALUES {_VOCABULARY}) AS vv(lang, vocabulary)),
t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT t.*, vocabulary, regexp_extract_all(t, '{_WORD}+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t LEFT JOIN v ON v.lang = t.lang),
windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) AS x WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT place) AS n FROM again, unnest(range(i, i + 8)) AS u(place) GROUP BY rid),
b AS (SELECT w.*, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST({_without('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        {_without('[\\p{Ll}]+')} AS lower_, {_without('[\\p{Lu}]+')} AS upper_, {_without('[\\p{Nd}]+')} AS digit_,
        {_without('[.,;:!?''"()-]+')} AS punct_,
        list_filter(words, lambda x: list_contains(vocabulary, x)) AS hits
      FROM w LEFT JOIN covered USING (rid)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        [lower_, upper_, digit_, punct_, n_symbols, length(t) - word_chars,
         greatest(length(t) - (lower_ + upper_ + digit_ + punct_ + n_symbols + length(t) - word_chars), 0)] AS classes,
        list_append(list_transform(vocabulary, lambda x: len(list_filter(hits, lambda y: y = x))), n_words - len(hits)) AS commons FROM b),
sides AS (SELECT rid, lang, 'class' AS kind, classes AS counts, base_failed, n_words FROM m
  UNION ALL SELECT rid, lang, 'word', commons, base_failed, n_words FROM m WHERE vocabulary IS NOT NULL),
long AS (SELECT rid, lang, kind, i, counts[i] / list_sum(counts) AS p, base_failed FROM sides, unnest(range(1, len(counts) + 1)) AS u(i)
  WHERE n_words >= {d.MIN_WORDS}),
reference AS (SELECT lang, kind, i, avg(p) AS q FROM long WHERE NOT base_failed GROUP BY ALL HAVING count(*) >= {d.MIN_DOCUMENTS}),
apart AS (SELECT rid, long.kind AS kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS far
  FROM long JOIN reference ON long.lang IS NOT DISTINCT FROM reference.lang AND long.kind = reference.kind AND long.i = reference.i GROUP BY rid, long.kind),
words AS (SELECT m.rid, lang, base_failed, far, floor(log2(n_words)) AS size FROM apart JOIN m USING (rid) WHERE kind = 'word'),
bins AS (SELECT lang, size, floor(1000 * far) AS bin, count(*) AS n FROM words WHERE NOT base_failed GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, size ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, size) AS total FROM bins),
middle AS (SELECT lang, size, min(bin) FILTER (WHERE 2 * upto >= total) AS mid, min(bin) FILTER (WHERE 10 * upto >= total) AS low
  FROM ranked GROUP BY lang, size HAVING max(total) >= {d.MIN_DOCUMENTS}),
limits AS (SELECT lang, size, mid + {d.SPREADS} * greatest(mid - low, {d.LEAST_STEP}) + 1 AS most FROM middle),
nearest AS (SELECT rid, far, arg_max(most, limits.size) AS most
  FROM words JOIN limits ON limits.lang IS NOT DISTINCT FROM words.lang AND limits.size <= words.size GROUP BY rid, far),
strange AS (SELECT rid FROM apart WHERE kind = 'class' AND far > {d.MAX_CLASS_DISTANCE}
  UNION SELECT rid FROM nearest WHERE far > most / 1000)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM strange WHERE strange.rid = m.rid) AS kept FROM m"""


SOURCE_AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, CAST(coalesce(n.n, 0) AS HUGEINT) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER s + 2 * count(*) OVER s) AS p,
             1 + 1000000000 * (total + 2) // (sum(total) OVER s + 2 * count(*) OVER s) AS q
      FROM c WINDOW s AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10"""


TRIE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
             {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
             lambda i: [CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM c),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda x, y:
             xor(xor(x, y) >> 1, 3988292384::UBIGINT * (xor(x, y) & 1))), 4294967295::UBIGINT) % 4 AS h FROM bits),
r AS (SELECT c.conv_id, list_concat(coalesce(o.turns[1:h], []), c.turns[h + 1:]) AS turns
      FROM c JOIN h ON h.conv_id = c.conv_id LEFT JOIN c AS o ON o.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, len(turns) AS size, d AS depth, CASE WHEN d > 0 THEN turns[1:d] ELSE [] END AS path,
             CASE WHEN d > 1 THEN turns[1:d - 1] ELSE [] END AS above FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT path, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
      FROM m GROUP BY path),
k AS (SELECT above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE
             (n_convs - 1) * len(regexp_extract_all(n.path[depth].text, '[^\x20\x09-\x0D]+')) END AS own
      FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT CASE WHEN d > 0 THEN path[1:d] ELSE [] END AS path, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
      FROM f, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN n AS p ON f.depth > 0 AND p.path = f.above"""


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.rid = a JOIN n AS y ON y.rid = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c ON c.rid = d.rid LEFT JOIN n ON n.rid = d.rid"""
