"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from . import disclosure, importance, licences, spelling, url_rules

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = ", ".join(f"({t.no}, '{t.label}', {t.words}, {t.need}, {t.length}, {t.apart}::VARCHAR[], {t.longer}::VARCHAR[][])"
                  for t in licences.template_sets())

LICENSES = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS low,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS MATERIALIZED (
  SELECT doc_id, low, len(w) AS n_words,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS p0,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS p1,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS p2
  FROM words),
templates(no, label, t, need, length, apart, longer) AS (VALUES {_ROWS}),
lines AS MATERIALIZED (SELECT doc_id, w, string_split(low, chr(10)) AS l FROM words JOIN places USING (doc_id, low)),
whole AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(b, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b
  FROM (SELECT doc_id, unnest(l) AS b FROM lines)),
numbered AS MATERIALIZED (
  SELECT doc_id, w, flatten(list_transform(l, lambda b, i: list_transform(regexp_extract_all(b, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: i))) AS line
  FROM lines WHERE len(l) > 1),
wrapped AS (
  SELECT doc_id, no, list_distinct(w[s + 1:s + length]) AS b FROM (
    SELECT doc_id, w, line, no, length, unnest(range(len(w) - length + 1)) AS s FROM numbered, templates
    WHERE len(list_intersect(w, t)) >= need) WHERE line[s + 1] < line[s + length]),
blocks AS (
  SELECT doc_id, no, b FROM wrapped UNION ALL SELECT doc_id, no, b FROM whole, templates WHERE len(b) >= need),
met AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(len(list_intersect(b, t)) / len(t)) AS share
  FROM blocks JOIN templates USING (no) WHERE len(list_intersect(b, t)) >= need AND list_has_all(b, apart)
    AND len(list_filter(longer, lambda more: list_has_all(b, more))) = 0 GROUP BY doc_id),
base AS (
  SELECT doc_id, n_words, list_concat(p0, list_concat(p1, p2)) AS p,
         list_concat(CASE WHEN len(p0) > 0 THEN ['cc-by'] ELSE [] END,
           list_concat(CASE WHEN len(p1) > 0 THEN ['gpl'] ELSE [] END, CASE WHEN len(p2) > 0 THEN ['reserved'] ELSE [] END)) AS own
  FROM places)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN met USING (doc_id)
"""

# The plain patterns; the operator uses equal ones that do not backtrack.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {i} AS no, generate_subscripts(h, 1) AS i, unnest(h) AS hit, "
    f"unnest(list_transform(g[1:len(h)], lambda x: length(x))) AS gap FROM (SELECT doc_id, "
    f"regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM d) WHERE len(h) > 0"
    for i, (k, p) in enumerate(_PLAIN.items()))

DISCLOSURE = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS MATERIALIZED (
  SELECT doc_id, kind, no, hit, stop - length(hit) AS start, stop, regexp_replace(hit, '[^0-9]', '', 'g') AS dig FROM (
    SELECT *, sum(gap + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM ({_HITS}))),
spans AS MATERIALIZED (
  SELECT doc_id, kind, no, hit, start::BIGINT AS start, stop::BIGINT AS stop, kind || ':' || hit AS entity FROM hits WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda x: CAST(x AS HUGEINT))) <= 255
    WHEN 'phone' THEN length(dig) BETWEEN 9 AND 15
    ELSE length(dig) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(dig)), lambda i:
      CASE WHEN i % 2 = 0 THEN CAST(dig[length(dig) - i] AS INT)
           ELSE CAST(dig[length(dig) - i] AS INT) * 2 - CASE WHEN CAST(dig[length(dig) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    END),
words AS MATERIALIZED (
  SELECT doc_id, i - 1 AS no, term, (stop - length(term))::BIGINT AS start, stop::BIGINT AS stop FROM (
    SELECT *, sum(gap + length(term)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, generate_subscripts(h, 1) AS i, unnest(h) AS term, unnest(list_transform(g[1:len(h)], lambda x: length(x))) AS gap FROM (
        SELECT doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS h, string_split_regex(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g
        FROM (SELECT doc_id, translate(text, '{_UP}', '{_LOW}') AS low FROM d WHERE doc_id IN (SELECT doc_id FROM spans))) WHERE len(h) > 0))),
placed AS MATERIALIZED (
  SELECT s.doc_id, s.entity, s.start, s.stop, count(w.no) FILTER (w.start < s.start) AS before, count(w.no) FILTER (w.start < s.stop) AS behind
  FROM spans s LEFT JOIN words w ON w.doc_id = s.doc_id GROUP BY ALL),
clear AS MATERIALIZED (
  SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id AND w.start < s.stop AND w.stop > s.start)),
met AS MATERIALIZED (
  SELECT DISTINCT c.doc_id, no, term, entity FROM clear c JOIN placed p ON c.doc_id = p.doc_id
    AND (no BETWEEN before - {disclosure.WINDOW} AND before - 1 OR no BETWEEN behind AND behind + {disclosure.WINDOW} - 1)),
pairs AS (
  SELECT entity, term, count(DISTINCT doc_id) AS n_both FROM met GROUP BY ALL HAVING count(DISTINCT doc_id) >= {disclosure.SUPPORT}),
counts AS (
  SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct(regexp_extract_all(
    translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM d) GROUP BY term),
holders AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM spans GROUP BY entity),
flagged AS (
  SELECT entity, term FROM pairs JOIN counts USING (term) JOIN holders USING (entity), (SELECT count(*)::DOUBLE AS total FROM d)
  WHERE log2(total / n_entity) > 0 AND log2(n_both * total / (n_entity * n_docs)) >= {disclosure.SHARE} * log2(total / n_entity)),
every AS (
  SELECT doc_id, kind, no, start, stop FROM spans UNION ALL
  SELECT DISTINCT c.doc_id, 'term', 4, c.start, c.stop FROM clear c JOIN met m ON c.doc_id = m.doc_id AND c.no = m.no
    JOIN flagged f ON f.entity = m.entity AND f.term = m.term),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (kind <> 'term') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(b.spans, '') AS spans
FROM d LEFT JOIN by_doc b USING (doc_id)
"""


_GIVEN = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in url_rules.RULES)


def _tokens(kind: str, text: str) -> str:
    return (f"list_transform(regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), '{url_rules.PARTS[kind]}'), lambda w: '{kind}:' || "
            "CASE WHEN regexp_full_match(w, '[0-9]+') THEN w[1] || repeat('#', length(w) - 1) ELSE w END)")


URL_RULES = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
rules(rule, own, start, says) AS (VALUES {_GIVEN}),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS given
  FROM parts JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id),
urls AS MATERIALIZED (
  SELECT page_id, host, path, rule, given, list_sort(list_distinct(list_concat({_tokens('h', 'host')},
         list_concat({_tokens('p', 'path')}, {_tokens('q', 'query')})))) AS tokens
  FROM parts LEFT JOIN fits USING (page_id)),
labelled AS MATERIALIZED (
  SELECT row_number() OVER () AS no, * FROM (SELECT DISTINCT host, path, tokens, given FROM urls WHERE given IS NOT NULL)),
sums AS (
  SELECT greatest({url_rules.LEAST}, ceil({url_rules.SUPPORT} * count(*)))::BIGINT AS need,
         count(*) FILTER (given = 'block') / count(*) AS share FROM labelled),
spread AS MATERIALIZED (SELECT no, given, unnest(tokens) AS token FROM labelled),
useful AS (
  SELECT token, -abs(count(*) FILTER (given = 'block') / count(*) - any_value(share)) AS rank FROM spread, sums
  GROUP BY token HAVING count(*) >= any_value(need) ORDER BY count(*) DESC, token LIMIT {url_rules.TOKENS}),
sets AS MATERIALIZED (
  SELECT no, given, list_sort(list(token ORDER BY rank, token)[1:{url_rules.ITEMS}]) AS items
  FROM spread JOIN useful USING (token) GROUP BY no, given),
combined AS (
  SELECT given, list_filter(items, lambda t, i: (bits >> (i - 1)) & 1 = 1) AS items
  FROM (SELECT given, items, unnest(range(1, 1 << len(items))) AS bits FROM sets)),
freqs AS (
  SELECT items, says AS verdict, n_own AS freq, n_own / n AS confidence FROM (
    SELECT items, count(*) AS n, count(*) FILTER (given = 'block') AS n_block FROM combined GROUP BY items),
    LATERAL (VALUES ('block', n_block), ('allow', n - n_block)) AS v(says, n_own)),
mined AS MATERIALIZED (
  SELECT items, verdict, freq, confidence FROM freqs, sums WHERE freq >= need AND confidence >= {url_rules.CONFIDENCE}),
kept AS MATERIALIZED (
  SELECT * FROM mined m WHERE NOT EXISTS (
    SELECT 1 FROM mined s WHERE s.verdict = m.verdict AND len(s.items) < len(m.items) AND list_has_all(m.items, s.items)
      AND s.confidence >= m.confidence)
  ORDER BY confidence DESC, freq DESC, len(items), array_to_string(items, ' '), verdict LIMIT {url_rules.MOST_RULES}),
hits AS (
  SELECT page_id, array_to_string(items, ' ') AS mined, verdict, confidence FROM urls JOIN kept ON list_has_all(tokens, items)
  WHERE given IS NULL
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, freq DESC, len(items), array_to_string(items, ' '), verdict) = 1)
SELECT page_id, host, path, rule, coalesce(given, verdict, 'allow') AS verdict, mined, confidence
FROM urls LEFT JOIN hits USING (page_id)
"""


def _crc_table() -> list[int]:
    """Remainders of the 256 bytes by the reflected polynomial 0xEDB88320."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def _crc32(text: str) -> str:
    pair = "strpos('0123456789ABCDEF', {h}[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', {h}[2 * i + 2]) - 17".format(h=f"hex(encode({text}))")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen({text})), lambda i: ({pair})::BIGINT)), "
            f"lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[xor(c, b) % 256 + 1])), 4294967295)")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESAMPLING = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT w, {_crc32('w')} % {importance.BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
own AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN buckets USING (w) GROUP BY bucket),
other AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN buckets USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM own) + {importance.BUCKETS})
           / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM other) + {importance.BUCKETS}))))::BIGINT AS gain
  FROM own LEFT JOIN other USING (bucket)),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
hashed AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         list_reduce(list_concat([0::BIGINT], list_transform(range(8), lambda i: (strpos('0123456789abcdef',
           sha256('{importance.SEED}' || doc_id)[i + 1]) - 1)::BIGINT)), lambda a, x: a * 16 + x)::DOUBLE AS h
  FROM d LEFT JOIN weights USING (doc_id)),
scores AS MATERIALIZED (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM hashed),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM scores
  WHERE n_features >= {importance.WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.SHARE} * total // 100 THEN rank END AS rank
FROM scores LEFT JOIN ranks USING (doc_id)
"""

SPELLING = rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[a-z\x{{00C0}}-\x{{00FF}}]{{{spelling.SHORTEST},}}')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM runs),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {spelling.DROPPED} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(n) >= {spelling.LEAST}),
gaps AS MATERIALIZED (
  SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'n': -near_n, 'form': near}}) AS best FROM pairs GROUP BY word),
named AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.n >= {spelling.RATIO} * n THEN best.form END AS form,
         CASE WHEN -best.n >= {spelling.RATIO} * n THEN -best.n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS root FROM named WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN named f ON f.word = c.root AND f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN named f ON f.word = c.root AND f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM named LEFT JOIN last USING (word)
"""

ORACLES = {"op3_license_scan": LICENSES, "op6_disclosure_scan": DISCLOSURE, "op8_exact_dedup": EXACT_DEDUP,
           "op11_url_rules": URL_RULES, "op12_importance_resampling": RESAMPLING, "op13_spelling_variants": SPELLING}
