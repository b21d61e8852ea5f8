"""DuckDB counterparts of the registered queries that SQL can express."""

from __future__ import annotations

from quire.llm.chat import END, START
from quire.llm.fingerprint import DENSE_BITS, LANES, SPARSE_BITS
from quire.llm.jobs import RULES
from quire.llm.url_trust import LINKS

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH said AS (
  SELECT conv_id, CAST(coalesce(floor(turn / 64), -1) AS BIGINT) AS part, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|im_', '<|_im_') AS body
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'),
drawn AS (
  SELECT conv_id, perspective, part, speaker = perspective AS own, body || '{END}' AS body,
         CASE WHEN speaker = 'system' THEN '{START}system' WHEN speaker = perspective THEN '{START}assistant'
              ELSE '{START}user name=' || regexp_replace(speaker, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') END || chr(10) AS head,
         row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, body) AS i
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS place
  FROM drawn),
parts AS (
  SELECT conv_id, perspective, part, CAST(0 AS BIGINT) AS slice, string_agg(head || body || chr(10), '' ORDER BY i) AS text,
         coalesce(string_agg(CASE WHEN own THEN CAST(place AS BIGINT) || '-' || CAST(place + length(body) AS BIGINT) END, ',' ORDER BY i), '') AS mask,
         count(*) AS n_messages, CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
         CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_loss_chars
  FROM placed GROUP BY ALL)
SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY part
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
FROM parts"""

_WORDS = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, 10 AS n, array_to_string(w[i:i + 9], ' ') AS said
  FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM item WHERE len(w) >= 10)
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM item WHERE len(w) BETWEEN 1 AND 9),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM starts) JOIN windows USING (n, said)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _op7(rounds: int = 15, damping: float = 0.85, threshold: float = 0.5, parent_weight: float = 0.1) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), -len(r[2]), r[1], r[2]))
    fits = "(host = '{1}' OR ends_with(host, '.{1}')) AND starts_with(path, '{2}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits.format(*r)} THEN '{value(r)}'" for r in ordered) + " END"
    links = LINKS.replace("'", "''")
    ranks = ["r0 AS MATERIALIZED (SELECT kind, host, start AS mass FROM seeds)"]
    for i in range(rounds):
        ranks.append(f"""r{i + 1} AS MATERIALIZED (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT e.kind, e.dst AS host, r.mass * e.share * {damping} AS mass FROM r{i} r JOIN shares e ON e.kind = r.kind AND e.src = r.host
    UNION ALL SELECT kind, host, start * (1 - {damping}) FROM seeds) GROUP BY kind, host)""")
    return f"""
WITH named AS MATERIALIZED (
  SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, html, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS said FROM named),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM named),
kin AS (SELECT DISTINCT array_to_string(labels[i:], '.') AS src, array_to_string(labels[i + 1:], '.') AS dst
        FROM (SELECT labels, unnest(range(1, len(labels) - 1)) AS i FROM hosts WHERE len(labels) > 2)),
raw AS (
  SELECT host AS src, {LOWER.format("regexp_extract(url, '//([^/?#]*)', 1)")} AS dst, 1.0::DOUBLE AS weight
  FROM (SELECT host, unnest(regexp_extract_all(html, '{links}', 1)) AS url FROM ruled)
  UNION ALL SELECT src, dst, {parent_weight}::DOUBLE FROM kin UNION ALL SELECT dst, src, {parent_weight}::DOUBLE FROM kin),
edges AS (SELECT src, dst, sum(weight) AS weight FROM raw WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
two AS (SELECT 'good' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'bad', dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM two),
counted AS (SELECT host, count(*) FILTER (said = 'allow')::DOUBLE AS good, count(*) FILTER (said = 'block')::DOUBLE AS bad FROM ruled WHERE host <> '' GROUP BY host),
start AS (SELECT 'good' AS kind, host, good AS mass FROM counted WHERE good > 0 UNION ALL SELECT 'bad', host, bad FROM counted WHERE bad > 0),
seeds AS MATERIALIZED (SELECT kind, host, mass / sum(mass) OVER (PARTITION BY kind) AS start FROM start),
{", ".join(ranks)},
ranks AS (SELECT host, round(bad / (good + bad), 9) AS share FROM (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'good'), 0) AS good, coalesce(sum(mass) FILTER (kind = 'bad'), 0) AS bad FROM r{rounds} GROUP BY host)
  WHERE good + bad > 0)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(share, 0) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN ranks USING (host)"""


OP8 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

OP9 = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
follows AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS follow FROM base),
edits AS (SELECT *, length(text) AS n, left(text, length(text) - length(text) // 4) || left(follow, length(text) // 4) AS edited FROM follows),
kinds AS (
  SELECT doc_id, 'own' AS kind, text FROM edits UNION ALL SELECT doc_id, 'changed', edited FROM edits
  UNION ALL SELECT doc_id, 'following', follow FROM edits),
pieces AS (
  SELECT doc_id, kind, md5(trim(p)) AS h
  FROM (SELECT doc_id, kind, unnest(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) AS p FROM kinds) WHERE trim(p) <> ''),
numbers AS (
  SELECT doc_id, kind, ('0x' || h[1:2])::BIGINT % {LANES} AS lane, ('0x' || h[3:10])::BIGINT AS value, ('0x' || h[11:21])::BIGINT AS a,
         ('0x' || h[22:32])::BIGINT AS b
  FROM pieces),
sparse AS (SELECT doc_id, kind, lane, (sum(value) % {1 << SPARSE_BITS})::BIGINT AS v FROM numbers GROUP BY ALL),
dense AS (SELECT doc_id, kind, (sum(a) % {1 << DENSE_BITS})::BIGINT AS a, (sum(b) % {1 << DENSE_BITS})::BIGINT AS b FROM numbers GROUP BY ALL),
every AS (SELECT doc_id, kind, l.lane, coalesce(v, 0) AS v FROM kinds CROSS JOIN (SELECT unnest(range({LANES})) AS lane) l LEFT JOIN sparse USING (doc_id, kind, lane)),
vectors AS MATERIALIZED (
  SELECT doc_id, kind, coalesce(any_value(a), 0) AS a, coalesce(any_value(b), 0) AS b, list(v ORDER BY lane) AS lanes
  FROM every LEFT JOIN dense USING (doc_id, kind) GROUP BY doc_id, kind),
texts AS (
  SELECT *, lpad(lower(to_hex(a)), 11, '0') || lpad(lower(to_hex(b)), 11, '0') ||
         array_to_string(list_transform(lanes, lambda x: lpad(lower(to_hex(x)), 8, '0')), '') AS said FROM vectors),
near AS (
  SELECT o.doc_id, x.kind, x.said, o.said AS own,
         CASE WHEN o.said = x.said THEN 1.0::DOUBLE ELSE round(
           len(list_filter(range(1, {LANES + 1}), lambda i: o.lanes[i] = x.lanes[i] AND o.lanes[i] <> 0))::DOUBLE
           / greatest(len(list_filter(range(1, {LANES + 1}), lambda i: o.lanes[i] <> 0 OR x.lanes[i] <> 0)), 1), 9) END AS likeness
  FROM texts o JOIN texts x USING (doc_id) WHERE o.kind = 'own' AND x.kind <> 'own')
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, c.own AS fingerprint, c.said AS edited_fingerprint,
       c.likeness AS near_edited, f.likeness AS near_next
FROM edits e JOIN near c ON c.doc_id = e.doc_id AND c.kind = 'changed' JOIN near f ON f.doc_id = e.doc_id AND f.kind = 'following'"""

OP10 = f"""
WITH rows AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, url, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM rows),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest),
keyed AS (
  SELECT *, array_to_string(list_reverse(string_split({LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '.')), ',') || ')' ||
         {LOWER.format("regexp_extract(url, '://[^/?#]*([^#]*)', 1)")} AS k
  FROM sized LEFT JOIN firsts USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, row_number() OVER (ORDER BY k, page_id) - 1 AS position
FROM keyed"""

SQL = {
    "op1_chat_rotation": OP1, "op3_suffix_automaton": OP3, "op7_url_trust": _op7(), "op8_jaccard_join": OP8,
    "op9_multiset_hash": OP9, "op10_warc_index": OP10,
}
