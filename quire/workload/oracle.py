"""DuckDB counterparts of the registered queries, over the same whole tables."""

from __future__ import annotations

from quire.functions.analysis import ENGLISH_STOP_WORDS
from quire.schemas import BOOK_ALIASES, BOOK_NAMES
from quire.workload.stem_sql import STEMS
from quire.workload.views import CITATION_FORMS, MTIME, PATH_SHAPES

_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
_TRIM_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

DOCS = "docs AS (SELECT *, cast(substr(source, 4) AS INT) AS no FROM documents)"

LIBRARY = (
    DOCS
    + """,
library AS (
  SELECT source_type, doc_id AS source_id,
    CASE WHEN source_type <> 'scriptures' THEN source || ' ' || doc_id END AS title,
    CASE WHEN source_type = 'scriptures' THEN source || ' ' || doc_id || ':1' END AS reference,
    text AS content,
    CASE source_type
      WHEN 'scriptures' THEN 'eng/scriptures/bofm/' || source || '/' || doc_id || '.md'
      WHEN 'talks' THEN 'eng/general-conference/' || (no + 2000) || '/' || month || '/' || doc_id || '.md'
      WHEN 'manuals' THEN 'eng/manual/' || source || '/' || doc_id || '.md'
      WHEN 'books' THEN '/data/books/' || source || '/' || doc_id || '.md'
      ELSE '/data/gospel-library/eng/scriptures/tg/' || doc_id || '.md' END AS file_path,
    CASE WHEN source_type = 'talks' THEN 'Speaker ' || source END AS speaker,
    CASE WHEN source_type = 'talks' THEN no + 2000 END AS year,
    CASE WHEN source_type = 'talks' THEN month END AS month,
    CASE WHEN source_type = 'study_aids' THEN 'tg' END AS aid_type,
    CASE WHEN source_type = 'study_aids' THEN doc_id::VARCHAR END AS slug
  FROM (SELECT *, CASE WHEN n_chars % 2 = 0 THEN '04' ELSE '10' END AS month,
          ['scriptures', 'talks', 'manuals', 'books', 'study_aids'][no % 5 + 1] AS source_type FROM docs))"""
)

CARDS = "title, reference, snippet, file_path, speaker, year, month, aid_type, slug"
ORDINAL = "list_position(['scriptures', 'talks', 'manuals', 'books', 'study_aids'], source_type)"


def snippet(text: str) -> str:
    whole = f"trim({text}, {_TRIM_SET})"
    return f"CASE WHEN length({whole}) <= 240 THEN {whole} ELSE substr({whole}, 1, 240) || '…' END"


def tokens(text: str) -> str:
    return f"unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'))"


TERMS = f""",
postings AS (
  SELECT source_type, source_id, term, count(*)::INT AS tf,
         (sum(count(*)) OVER (PARTITION BY source_type, source_id))::INT AS doc_len
  FROM (SELECT source_type, source_id,
          {tokens("CASE WHEN source_type = 'scriptures' THEN content ELSE title || ' ' || content END")} AS term
        FROM library)
  WHERE term <> '' AND term NOT IN ({_STOP})
  GROUP BY source_type, source_id, term),
cards AS (
  SELECT source_type, source_id, title, reference, file_path, speaker, year, month, aid_type, slug,
    CASE WHEN source_type = 'scriptures' THEN content ELSE {snippet('content')} END AS snippet
  FROM library),
asked AS (
  SELECT DISTINCT query_id, term
  FROM (SELECT item_id AS query_id, {tokens('text')} AS term FROM benchmark)
  WHERE term <> '' AND term NOT IN ({_STOP})),
needed AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id)"""

# The same postings and questions under the stems of their terms.
STEMMED = (
    TERMS.replace("postings AS (", "plain_postings AS (", 1).replace("asked AS (", "plain_asked AS (", 1).split("needed AS (")[0].rstrip().rstrip(",")
    + """,
words AS (SELECT term FROM plain_postings UNION SELECT term FROM plain_asked)"""
    + STEMS
    + """,
postings AS (SELECT source_type, source_id, stem AS term, sum(tf)::INT AS tf, doc_len
  FROM plain_postings JOIN stems USING (term) GROUP BY source_type, source_id, stem, doc_len),
asked AS (SELECT DISTINCT query_id, stem AS term FROM plain_asked JOIN stems USING (term)),
needed AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id)"""
)

# Queries of the hottest terms, with limits and source lists of their own.
HOT = f""",
hot AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS i FROM postings GROUP BY term QUALIFY i <= 60),
hot_asked AS (
  SELECT i AS query_id, term FROM hot
  UNION SELECT a.i, b.term FROM hot a JOIN hot b ON b.i = a.i + CASE a.i % 3 WHEN 1 THEN 1 WHEN 2 THEN 7 END),
hot_scored AS (
  SELECT query_id, source_type, source_id, round(sum(1 + ln(tf)), 6) AS score
  FROM postings JOIN hot_asked USING (term)
  JOIN (SELECT query_id, count(*) AS n FROM hot_asked GROUP BY query_id) USING (query_id)
  WHERE query_id % 5 <> 4 OR source_type IN ('talks', 'books')
  GROUP BY query_id, source_type, source_id, n HAVING count(*) = n)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ORDINAL}, source_id)::INT AS rank,
    source_type, source_id, score FROM hot_scored)
WHERE rank <= [3, 20, 100, 20, 20, 20][query_id % 6 + 1]"""

_KEPT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND t NOT IN (" + _STOP + "))"
# The first three terms of each passage, as a phrase.
PHRASES = f""",
doc_tokens AS (SELECT source_type, source_id,
    {_KEPT.format("CASE WHEN source_type = 'scriptures' THEN content ELSE title || ' ' || content END")} AS w FROM library),
phrases AS (SELECT item_id AS query_id, {_KEPT.format('text')}[1:3] AS q FROM benchmark),
places AS (
  SELECT source_type, source_id, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT source_type, source_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_tokens, (SELECT DISTINCT len(q) AS n FROM phrases WHERE len(q) > 0))),
phrase_hits AS (
  SELECT query_id, source_type, source_id, count(*)::INT AS n_found, round(1 + ln(count(*)), 6) AS score
  FROM places JOIN phrases ON said = array_to_string(q, ' ') GROUP BY ALL)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ORDINAL}, source_id)::INT AS rank,
    source_type, source_id, n_found, score FROM phrase_hits) WHERE rank <= 20"""

LOG_TF = "1 + ln(tf)"
BM25 = "idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))"
BM25_STATS = """,
totals AS (SELECT (SELECT count(*) FROM library) AS n_docs,
  (SELECT sum(tf) FROM postings) / (SELECT count(*) FROM library) AS mean_len),
idfs AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, mean_len
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals)"""


def keyword_hits(name: str, ranker: str, limit: int = 20) -> str:
    """CTEs ``<name>``: query_id, rank, source_type, source_id, score."""
    weighted = "JOIN idfs USING (term)" if ranker == "bm25" else ""
    return f""",
{name}_scored AS (
  SELECT query_id, source_type, source_id, round(sum({BM25 if ranker == 'bm25' else LOG_TF}), 6) AS score
  FROM postings JOIN asked USING (term) {weighted} JOIN needed USING (query_id)
  GROUP BY query_id, source_type, source_id, n HAVING count(*) = n),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, {ORDINAL}, source_id)::INT AS rank FROM {name}_scored)
  WHERE rank <= {limit})"""


def keyword_search(ranker: str) -> str:
    stats = BM25_STATS if ranker == "bm25" else ""
    return (
        "WITH " + LIBRARY + TERMS + stats + keyword_hits("kw", ranker)
        + f"\nSELECT query_id, rank, source_type, source_id, score, {CARDS} FROM kw JOIN cards USING (source_type, source_id)"
    )



# --- vectors -----------------------------------------------------------------

VECTORS = f""",
vectors AS (
  SELECT coalesce(source_type, 'scriptures') AS source_type, vec_id AS source_id, 'paragraph' AS layer,
    {snippet("coalesce(content, '')")} AS snippet, embedding::DOUBLE[] AS v
  FROM embeddings LEFT JOIN library ON library.source_id = vec_id),
own_cards AS (SELECT source_type, source_id, title, reference, file_path, speaker, year, month, aid_type, slug
  FROM library)"""
CENTROIDS = """,
asking AS (
  SELECT label::BIGINT AS query_id, list(mean::FLOAT ORDER BY pos)::DOUBLE[] AS q, 10 AS lim,
    CASE WHEN label % 2 = 1 THEN ['talks', 'books'] END AS sources
  FROM (SELECT label, pos, avg(x) AS mean
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos)
  GROUP BY label)"""
EVERY = """,
asking AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, 10 AS lim, NULL::VARCHAR[] AS sources FROM embeddings)"""
CELL_PAIRS = f""",
keyed AS (SELECT *, md5(({ORDINAL} - 1) || '/' || source_id || '/' || layer) AS key FROM vectors),
pivots AS (SELECT v AS p, row_number() OVER (ORDER BY key) AS cell FROM keyed
  QUALIFY cell <= (SELECT least(1024, greatest(16, floor(sqrt(count(*))))) FROM keyed)),
placed AS (SELECT source_type, source_id, cell FROM vectors, pivots
  QUALIFY row_number() OVER (PARTITION BY source_type, source_id
    ORDER BY round(list_cosine_similarity(v, p), 9) DESC, cell) = 1),
probed AS (SELECT query_id, cell FROM asking, pivots
  QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY round(list_cosine_similarity(q, p), 9) DESC, cell) <= 16),
visited AS (SELECT query_id, source_type, source_id FROM placed JOIN probed USING (cell))"""


def nearest(extra: str = "", allowed: str = "sources IS NULL OR list_contains(sources, source_type)") -> str:
    return f""",
scored AS (
  SELECT query_id, lim, source_type, source_id, layer, snippet, round(list_cosine_similarity(q, v), 6) AS score
  FROM asking CROSS JOIN vectors {extra} WHERE {allowed}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, {ORDINAL}, source_id, layer)::INT AS rank FROM scored)"""


ENRICHED = f"""
SELECT query_id, rank, source_type, source_id, score, {CARDS}, layer
FROM near LEFT JOIN own_cards USING (source_type, source_id) WHERE rank <= lim"""
OVERFETCH = f""",
fetched AS (SELECT near.* FROM near JOIN asking USING (query_id)
  WHERE rank <= 4 * near.lim AND (sources IS NULL OR list_contains(sources, source_type))),
kept AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM fetched)
SELECT query_id, rank, source_type, source_id, score, {CARDS}, layer
FROM kept LEFT JOIN own_cards USING (source_type, source_id) WHERE rank <= lim"""


# --- fusion ----------------------------------------------------------------------


def fused(first: str, second: str) -> str:
    """Fuse two ranked CTEs that carry the card columns; rows with ``fuse`` false keep their score."""
    return f""",
listed AS (SELECT *, 0 AS list FROM {first} UNION ALL BY NAME SELECT *, 1 AS list FROM {second}),
summed AS (
  SELECT query_id, source_type, source_id,
    CASE WHEN fuse THEN round(sum(1.0::DOUBLE / (60 + rank)), 12) ELSE first(score ORDER BY list, rank) END AS score,
    {", ".join(f"arg_min_null({c}, list * 1000 + rank) AS {c}" for c in CARDS.split(", "))}
  FROM listed GROUP BY query_id, source_type, source_id, fuse)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, {ORDINAL}, source_id)::INT AS rank, source_type, source_id, score, {CARDS} FROM summed)
WHERE rank <= 20"""


def clean(text: str) -> str:
    """Inline markup removed, white space collapsed."""
    bare = f"regexp_replace({text}, '<sup>\\[[^\\]]+\\]\\(#fn-[^)]+\\)</sup>', '', 'g')"
    bare = f"regexp_replace({bare}, '<sup>[^<]+</sup>', '', 'g')"
    bare = f"regexp_replace({bare}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


CHUNKS = f""",
cut AS (
  SELECT source_type, source_id,
    list_filter(list_transform(string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10)),
      lambda p: {clean('p')}), lambda p: p <> '') AS parts
  FROM library),
chunks AS (
  SELECT source_type, source_id,
    CASE WHEN pos = 1 THEN 'paragraph' ELSE 'paragraph_' || (pos - 1) END || CASE WHEN piece = 0 THEN '' ELSE '+' || piece END AS layer,
    substr(part, piece * 2000 + 1, 2000) AS content
  FROM (SELECT *, unnest(range((length(part) - 1) // 2000 + 1)) AS piece
    FROM (SELECT source_type, source_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut)))"""


# Chunks of the documents to embed before and after a revision, and what a run over it does.
REVISED = (
    CHUNKS
    + """,
poor AS (SELECT doc_id FROM labels WHERE quality = 0),
drafts AS (
  SELECT source_type, source_id, CASE WHEN poor.doc_id IS NOT NULL THEN 'Draft ' || content ELSE content END AS content
  FROM library LEFT JOIN poor ON poor.doc_id = source_id WHERE source_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT source_type, -source_id - 1, content FROM library JOIN poor ON doc_id = source_id)"""
    + CHUNKS.replace("cut AS (", "draft_cut AS (").replace("FROM library)", "FROM drafts)")
    .replace("chunks AS (", "draft_chunks AS (").replace("FROM cut)", "FROM draft_cut)")
    + """,
now_texts AS (
  SELECT * FROM chunks WHERE source_type NOT IN ('scriptures', 'study_aids')
  UNION ALL SELECT source_type, source_id, 'verse', content FROM library WHERE source_type = 'scriptures' AND content <> ''),
old_texts AS (
  SELECT * FROM draft_chunks WHERE source_type NOT IN ('scriptures', 'study_aids')
  UNION ALL SELECT source_type, source_id, 'verse', content FROM drafts WHERE source_type = 'scriptures' AND content <> ''),
told AS (
  SELECT source_type, source_id, CASE WHEN d.content IS NULL THEN 'new' WHEN l.content IS NULL THEN 'vanished'
    WHEN d.content <> l.content THEN 'changed' END AS outcome
  FROM (SELECT * FROM library WHERE content <> '') l FULL JOIN (SELECT * FROM drafts WHERE content <> '') d USING (source_type, source_id)
  WHERE source_type <> 'study_aids'),
redone AS (
  SELECT n.source_type, CASE WHEN o.content IS NULL THEN 'embedded' ELSE 'kept' END AS outcome
  FROM now_texts n JOIN told USING (source_type, source_id) LEFT JOIN old_texts o USING (source_type, source_id, layer, content)
  WHERE outcome IN ('new', 'changed'))
SELECT source_type, outcome, count(*) AS n FROM told WHERE outcome IS NOT NULL GROUP BY ALL
UNION ALL SELECT source_type, outcome, count(*) FROM redone GROUP BY ALL
UNION ALL SELECT source_type, 'stored', count(*) FROM now_texts GROUP BY ALL
UNION ALL SELECT source_type, 'characters', sum(length(content))::BIGINT FROM now_texts GROUP BY ALL"""
)


def hashed(name: str, keys: str, rows: str) -> str:
    """CTE ``<name>``: (keys, pos, x), the non-zero components of the hashed word vectors of ``rows``."""
    return f""",
{name}_sums AS (
  SELECT {keys}, ('0x' || substr(h, 1, 7))::INT % 64 AS pos, sum(CASE WHEN substr(h, 8, 1) < '8' THEN 1 ELSE -1 END) AS s
  FROM (SELECT {keys}, md5(term) AS h FROM (SELECT {keys}, {tokens('content')} AS term FROM {rows}) WHERE term <> '')
  GROUP BY {keys}, pos),
{name} AS (
  SELECT {keys}, pos, (s / sqrt(sum(s * s) OVER (PARTITION BY {keys})))::FLOAT AS x FROM {name}_sums WHERE s <> 0)"""


HYBRID = (
    hashed("chunk_vec", "source_type, source_id, layer", "(SELECT * FROM chunks WHERE source_type <> 'study_aids')")
    + hashed("query_vec", "item_id", "(SELECT item_id, text AS content FROM benchmark)")
    + f""",
chunk_len AS (SELECT source_type, source_id, layer, sqrt(sum(x::DOUBLE * x)) AS len FROM chunk_vec GROUP BY ALL),
query_len AS (SELECT item_id, sqrt(sum(x::DOUBLE * x)) AS qlen FROM query_vec GROUP BY ALL),
dots AS (SELECT item_id, source_type, source_id, layer, sum(c.x::DOUBLE * q.x) AS dot
  FROM chunk_vec c JOIN query_vec q USING (pos) GROUP BY ALL),
sem AS (
  SELECT * FROM (
    SELECT item_id AS query_id, source_type, source_id, layer, round(coalesce(dot, 0) / len / qlen, 6) AS score,
      row_number() OVER (PARTITION BY item_id
        ORDER BY round(coalesce(dot, 0) / len / qlen, 6) DESC, {ORDINAL}, source_id, layer)::INT AS rank
    FROM chunk_len CROSS JOIN query_len LEFT JOIN dots USING (item_id, source_type, source_id, layer))
  WHERE rank <= 20),
sem_cards AS (
  SELECT query_id, rank, sem.source_type, sem.source_id, score, true AS fuse,
    library.* EXCLUDE (source_type, source_id, content), {snippet('chunks.content')} AS snippet
  FROM sem JOIN chunks USING (source_type, source_id, layer) JOIN library USING (source_type, source_id)),
kw_cards AS (
  SELECT query_id, rank, kw.source_type, kw.source_id, score, query_id IN (SELECT item_id FROM query_len) AS fuse,
    cards.* EXCLUDE (source_type, source_id)
  FROM kw JOIN cards USING (source_type, source_id))"""
)
RRF = "".join(
    f""",
{name}_cards AS (SELECT query_id, rank, source_type, source_id, score, true AS fuse, {CARDS}
  FROM {name} JOIN cards USING (source_type, source_id))"""
    for name in ("kw", "bm")
)

URL = """CASE WHEN contains(file_path, '/books/') OR starts_with(file_path, 'books/')
    OR NOT regexp_matches(page, '^[^/]+/.') THEN ''
  ELSE 'https://www.churchofjesuschrist.org/study/' || regexp_replace(page, '^[^/]+/', '') || '?lang=' || split_part(page, '/', 1) END"""

# --- lookups ---------------------------------------------------------------------

VERSES = (
    DOCS
    + """,
verses AS (
  SELECT doc_id * 1000000 + verse AS id, lang AS volume, source AS book, doc_id::INT AS chapter, verse::INT AS verse,
    source || ' ' || doc_id || ':' || verse AS reference, text, source || '/' || doc_id AS file_path
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
          generate_subscripts(string_split(text, chr(10)), 1) AS verse FROM documents)),
chapters AS (SELECT doc_id AS id, lang AS volume, source AS book, doc_id::INT AS chapter,
    'Chapter ' || doc_id AS title, text AS full_content, source || '/' || doc_id AS file_path FROM documents)"""
)
_FORMS = ", ".join(f"'{form}'" for form in CITATION_FORMS)
RESOLVED = f""",
cited AS (
  SELECT doc_id * {len(CITATION_FORMS)} + k - 1 AS request_id,
    replace(replace(form, '{{b}}', upper(source)), '{{c}}', doc_id::VARCHAR) AS citation
  FROM (SELECT doc_id, source, unnest([{_FORMS}]) AS form, generate_subscripts([{_FORMS}], 1) AS k FROM documents)),
spelt AS (SELECT DISTINCT source AS alias, source AS book FROM documents)"""


def resolve() -> str:
    """CTE ``resolved`` from ``cited`` and ``spelt``."""
    folded = "replace(replace(lower(trim(citation)), 'doctrine and covenants', 'dc'), 'd&c', 'dc')"
    return f""",
parts AS (
  SELECT request_id, citation, regexp_extract(folded, '^(.*?)\\s+(\\S+)$', 1) AS name,
    regexp_extract(folded, '^(.*?)\\s+(\\S+)$', 2) AS last
  FROM (SELECT *, {folded} AS folded FROM cited)),
numbers AS (
  SELECT request_id, citation, name,
    try_cast(regexp_extract(last, '^([0-9]+)', 1) AS INT) AS chapter,
    contains(last, ':') AS versed,
    try_cast(regexp_extract(last, ':([0-9]+)', 1) AS INT) AS verse,
    try_cast(regexp_extract(last, ':[^-]+-([0-9]+)', 1) AS INT) AS end_verse
  FROM parts),
judged AS (
  SELECT numbers.*, book, book IS NOT NULL AND coalesce(chapter > 0, false)
    AND (NOT versed OR coalesce(verse > 0, false)) AS ok
  FROM numbers LEFT JOIN spelt ON alias = name),
resolved AS (
  SELECT request_id, citation, CASE WHEN ok THEN book END AS book, CASE WHEN ok THEN chapter END AS chapter,
    CASE WHEN ok THEN verse END AS verse, CASE WHEN ok AND end_verse > 0 THEN end_verse END AS end_verse, ok
  FROM judged),
fitting AS (
  SELECT *, coalesce(end_verse, verse) AS hi, CASE WHEN end_verse IS NULL THEN 'verse' ELSE 'range' END AS shape
  FROM resolved WHERE ok AND verse IS NOT NULL AND coalesce(end_verse, verse) BETWEEN verse AND verse + 49),
found_verses AS (
  SELECT f.request_id, f.shape, v.* FROM fitting f
  JOIN verses v ON v.book = f.book AND v.chapter = f.chapter AND v.verse BETWEEN f.verse AND f.hi),
found_chapters AS (
  SELECT r.request_id, 'chapter' AS shape, c.* FROM resolved r JOIN chapters c USING (book, chapter)
  WHERE ok AND r.verse IS NULL)"""


PASSAGES = """,
found AS (SELECT * EXCLUDE (shape) FROM found_verses UNION ALL BY NAME SELECT * EXCLUDE (shape) FROM found_chapters)
SELECT r.request_id,
  CASE WHEN NOT ok THEN 'unparseable' WHEN end_verse < r.verse THEN 'bad_order'
    WHEN end_verse - r.verse + 1 > 50 THEN 'too_long' WHEN id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
  CASE WHEN ok THEN CASE WHEN r.verse IS NULL THEN 'chapter' WHEN end_verse IS NULL THEN 'verse' ELSE 'range' END END AS shape,
  id, volume, f.book, f.chapter, f.verse, reference, text, title, full_content, file_path
FROM resolved r LEFT JOIN found f USING (request_id)"""

NAMES = (
    DOCS
    + ", names(k, book, display) AS (VALUES "
    + ", ".join(f"({i}, '{slug}', '{name}')" for i, (slug, name) in enumerate(BOOK_NAMES.items()))
    + f", ({len(BOOK_NAMES)}, 'nowhere', 'nowhere')"
    + f"""),
composed AS (SELECT doc_id AS request_id, book, no + 1 AS chapter, n_chars::INT AS verse,
    display || ' ' || (no + 1) || ':' || n_chars AS reference
  FROM docs JOIN names ON k = doc_id % {len(BOOK_NAMES) + 1})"""
)
SPELT = (
    """,
cited AS (SELECT request_id, reference AS citation FROM composed),
spelt(alias, book) AS (VALUES """
    + ", ".join(f"('{a}', '{b}')" for a, b in sorted(({s: s for s in BOOK_ALIASES.values()} | BOOK_ALIASES).items()))
    + """),
verses AS (SELECT 0 AS id, '' AS book, 0 AS chapter, 0 AS verse),
chapters AS (SELECT 0 AS id, '' AS book, 0 AS chapter)"""
)

# --- files -----------------------------------------------------------------------

_SCRIPTURE_TEXT = (
    "'# Chapter ' || doc_id || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), "
    "lambda l, i: '**' || i || '.** ' || l || '<sup>[a](#fn-1)</sup>  [see  here](../x.md)<sup>b</sup>'), chr(10))"
)
_TALK_TEXT = (
    "'# Talk ' || doc_id || chr(10) || chr(10) || '🎧 [Listen to Audio](https://a/' || doc_id || '.mp3)' || chr(10) || chr(10)"
    " || '# Talk ' || doc_id || chr(10) || chr(10) || '(See ' || doc_id || '.)' || chr(10) || chr(10)"
    " || CASE WHEN n_chars % 9 = 0 THEN '' ELSE 'By *Elder* [' || source || '](../s.md)' || chr(10) || chr(10) END"
    " || replace(text, chr(10), chr(10) || chr(10))"
)
_SHAPES = ", ".join(f"'{shape}'" for shape in PATH_SHAPES)

SCRIPTURE_FILES = (
    DOCS
    + f""",
files AS (SELECT doc_id, source, 'eng/scriptures/bofm/' || source || '/' || doc_id || '.md' AS path,
  {_SCRIPTURE_TEXT} AS content FROM docs)"""
)
TALKS = (
    DOCS
    + f""",
files AS (SELECT doc_id, source, no + 2000 AS year, CASE WHEN n_chars % 2 = 0 THEN '04' ELSE '10' END AS month,
  'eng/general-conference/' || (no + 2000) || CASE WHEN n_chars % 2 = 0 THEN '/04/' ELSE '/10/' END || doc_id || '.md' AS path,
  string_split({_TALK_TEXT}, chr(10)) AS lines FROM docs),
marks AS (SELECT *, list_transform(lines, lambda l: trim(l, {_TRIM_SET})) AS bare FROM files),
titled AS (SELECT *, list_position(list_transform(bare, lambda l: starts_with(l, '# ')), true) AS title_at FROM marks),
noted AS (SELECT *,
  list_position(list_transform(bare, lambda l, i: i > title_at AND NOT (l = '' OR starts_with(l, '🎧')
    OR starts_with(l, '[Listen to Audio') OR starts_with(l, '# ')
    OR (starts_with(l, '(') AND ends_with(l, ')')))), true) AS speaker_at,
  list_position(list_transform(bare, lambda l, i: i > title_at AND l <> ''), true) AS raw_at FROM titled),
heard AS (SELECT *, coalesce({clean('bare[speaker_at]')}, '') AS candidate FROM noted),
spoken AS (SELECT *, CASE WHEN lower(candidate[1:3]) = 'by ' AND strlen(candidate) > 3 THEN trim(candidate[4:]) ELSE candidate END AS speaker
  FROM heard),
talks AS (
  SELECT doc_id, source, year, month, path AS file_path, path AS rel_path, trim(bare[title_at][3:]) AS title, speaker,
    array_to_string(lines[CASE WHEN speaker <> '' THEN speaker_at ELSE title_at END + 1:], chr(10)) AS content,
    coalesce(bare[raw_at], '') AS raw_first_line,
    speaker = '' OR contains(speaker, 'Listen to Audio') OR strlen(speaker) > 200 AS suspicious
  FROM spoken),
old_talks AS (
  SELECT doc_id AS id, file_path, 'q' || quality AS titsw_dominant,
    CASE WHEN quality = 1 THEN '*Elder* ' || source ELSE 'nobody' END AS speaker
  FROM talks JOIN labels USING (doc_id))"""
)
BACKFILL = """,
statuses AS (
  SELECT id, file_path, t.speaker, CASE WHEN suspicious THEN 'failed' WHEN t.speaker = o.speaker THEN 'unchanged'
    ELSE 'changed' END AS status
  FROM old_talks o JOIN talks t USING (file_path))"""
MIXED = (
    DOCS
    + f""",
files AS (SELECT doc_id, text AS content, strlen(text)::BIGINT AS size,
  replace(replace([{_SHAPES}][no % {len(PATH_SHAPES)} + 1], '{{s}}', source), '{{d}}', doc_id::VARCHAR) AS rel_path FROM docs),
cut AS (SELECT *, string_split(rel_path, '/') AS p FROM files),
kinds AS (SELECT *, CASE
  WHEN p[2] = 'scriptures' AND p[3] IN ('tg', 'bd', 'gs', 'jst') AND len(p) >= 4 THEN 'study_aids'
  WHEN p[2] = 'scriptures' AND p[3] IN ('ot', 'nt', 'bofm', 'dc-testament', 'pgp') AND len(p) >= 5
    AND regexp_full_match(p[5], '[+-]?[0-9]+\\.md') THEN 'scriptures'
  WHEN p[2] = 'general-conference' AND len(p) >= 5 AND regexp_full_match(p[3], '[+-]?[0-9]+') THEN 'talks'
  WHEN p[2] = 'manual' AND len(p) >= 4 THEN 'manuals' END AS content_type FROM cut),
routed AS (SELECT doc_id, rel_path, size, content_type,
  CASE WHEN content_type = 'scriptures' THEN p[3] END AS volume,
  CASE WHEN content_type = 'scriptures' THEN p[4] END AS book,
  CASE WHEN content_type = 'scriptures' THEN replace(p[5], '.md', '')::INT END AS chapter,
  CASE WHEN content_type = 'talks' THEN p[3]::INT END AS year,
  CASE WHEN content_type = 'talks' THEN p[4] END AS month,
  CASE WHEN content_type = 'manuals' THEN p[3] END AS collection,
  NULL::VARCHAR AS section,
  CASE WHEN content_type = 'study_aids' THEN p[3] END AS aid_type,
  CASE WHEN content_type = 'study_aids' THEN replace(array_to_string(p[4:], '/'), '.md', '') END AS slug,
  CASE WHEN content_type IS NOT NULL THEN 'routed' WHEN len(p) < 3
    OR p[2] IN ('scriptures', 'general-conference', 'manual') THEN 'ignored' ELSE 'skipped' END AS outcome
  FROM kinds),
manifest AS (SELECT doc_id, rel_path AS file_path, size + toxic AS file_size,
  CASE WHEN quality = 1 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '{MTIME}' END AS file_mtime
  FROM files JOIN labels USING (doc_id)),
diff AS (SELECT rel_path AS path, content_type, TIMESTAMP '{MTIME}' AS mtime, size,
  CASE WHEN m.doc_id IS NULL THEN 'new' WHEN file_mtime <> TIMESTAMP '{MTIME}' OR file_size <> size THEN 'modified'
    ELSE 'unchanged' END AS outcome
  FROM routed r LEFT JOIN manifest m USING (doc_id) WHERE r.outcome = 'routed')"""
)
def upserted(columns: str) -> str:
    """All documents over the labelled ones, keyed by path; the carried address survives."""
    return (
        "WITH " + DOCS
        + f"\nSELECT 'p/' || doc_id AS file_path, {columns}, 'u' || quality AS source_url FROM docs LEFT JOIN labels USING (doc_id)"
    )


TREE = (
    MIXED.replace("text AS content, strlen(text)::BIGINT AS size", "CASE WHEN <chapter> THEN <verses> ELSE <talk> END AS content, strlen(content)::BIGINT AS size")
    .replace("<chapter>", f"contains([{_SHAPES}][no % {len(PATH_SHAPES)} + 1], '/scriptures/')")
    .replace("<verses>", _SCRIPTURE_TEXT)
    .replace("<talk>", _TALK_TEXT)
)
TREE_VERSES = f""",
marked AS (SELECT doc_id, volume, book, chapter, unnest(string_split(content, chr(10))) AS line
  FROM routed JOIN files USING (doc_id) WHERE content_type = 'scriptures'),
tree_verses AS (
  SELECT volume, book, chapter, verse, book || ' ' || chapter || ':' || verse AS reference, text
  FROM (SELECT *, try_cast(regexp_extract(line, '^\\*\\*(\\d+)\\.\\*\\*\\s*(.+)', 1) AS INT) AS verse,
    {clean("regexp_extract(line, '^\\*\\*(\\d+)\\.\\*\\*\\s*(.+)', 2)")} AS text FROM marked)
  WHERE verse IS NOT NULL AND text <> '')"""

# The verses of the tree after the second ingest: a line more where a poor document was changed.
LATER_VERSES = TREE_VERSES.replace(
    "FROM routed JOIN files USING (doc_id) WHERE content_type = 'scriptures'",
    "FROM routed JOIN files USING (doc_id) WHERE content_type = 'scriptures' "
    "UNION ALL SELECT doc_id, volume, book, chapter, '**9999.** More' FROM changes JOIN routed USING (doc_id) WHERE content_type = 'scriptures' AND kind = 'changed'",
)
CHANGES = """,
changes AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'new' WHEN quality = 0 THEN 'changed' ELSE 'unchanged' END AS kind
  FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"""
SQL: dict[str, str] = {
    "ingest_incremental": "WITH " + TREE + CHANGES + LATER_VERSES + """
SELECT coalesce(content_type, 'none') AS content_type,
  CASE WHEN outcome <> 'routed' THEN outcome WHEN kind = 'unchanged' THEN kind ELSE 'indexed' END AS outcome, count(*) AS n
  FROM routed JOIN changes USING (doc_id) GROUP BY 1, 2
UNION ALL SELECT CASE content_type WHEN 'scriptures' THEN 'chapters' ELSE content_type END, 'rows', count(*)
  FROM routed JOIN changes USING (doc_id) WHERE content_type IS NOT NULL AND kind <> 'unchanged' GROUP BY 1
UNION ALL SELECT 'scriptures', 'rows', count(*) FROM tree_verses v
  WHERE chapter IN (SELECT doc_id FROM changes WHERE kind <> 'unchanged')
UNION ALL SELECT 'scriptures', 'stored', count(*) FROM tree_verses
UNION ALL SELECT 'scriptures', 'characters', sum(length(text))::BIGINT FROM tree_verses""",
    "listings_kept": "WITH " + TREE + CHANGES + LATER_VERSES + """,
live AS (SELECT * FROM routed WHERE content_type IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
live_verses AS (SELECT * FROM tree_verses WHERE chapter NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT 'volumes' AS listing, volume AS key, count(*) AS n FROM live_verses GROUP BY volume
UNION ALL SELECT 'books of volume', volume, count(DISTINCT book) FROM live_verses GROUP BY volume
UNION ALL SELECT 'sessions', year || '/' || month, count(*) FROM live WHERE content_type = 'talks' GROUP BY year, month
UNION ALL SELECT 'manuals', collection, count(*) FROM live WHERE content_type = 'manuals' GROUP BY collection
UNION ALL SELECT 'study aids', aid_type, count(*) FROM live WHERE content_type = 'study_aids' GROUP BY aid_type
UNION ALL SELECT 'tables', name, coalesce(n, 0) FROM (SELECT unnest(['scriptures', 'chapters', 'talks', 'manuals', 'books', 'study_aids', 'embeddings']) AS name)
  LEFT JOIN (SELECT 'scriptures' AS name, count(*) AS n FROM live_verses
    UNION ALL SELECT CASE content_type WHEN 'scriptures' THEN 'chapters' ELSE content_type END, count(*) FROM live GROUP BY 1) USING (name)""",
    "backfill_stored": "WITH " + TALKS + f""",
stored AS (SELECT t.*, coalesce(poor, false) AS poor FROM talks t JOIN docs USING (doc_id)
  LEFT JOIN (SELECT doc_id, true AS poor FROM labels WHERE quality = 0 GROUP BY doc_id) USING (doc_id)
  WHERE no % {len(PATH_SHAPES)} = 1),
checked AS (SELECT CASE WHEN suspicious THEN 'failed' WHEN poor THEN 'changed' ELSE 'unchanged' END AS status FROM stored)
SELECT status AS name, count(*) AS n FROM checked GROUP BY status
UNION ALL SELECT 'total', count(*) FROM checked
UNION ALL SELECT CASE WHEN suspicious AND poor THEN 'nobody' ELSE speaker END, count(*) FROM stored GROUP BY 1""",
    "search_postings": "WITH " + LIBRARY + TERMS + keyword_hits("kw", "log_tf")
    + "\nSELECT query_id, rank, source_type, source_id, score FROM kw",
    "postings_incremental": "WITH " + LIBRARY + TERMS + "\nSELECT source_type, source_id, term, tf, doc_len FROM postings",
    "search_phrases": "WITH " + LIBRARY + PHRASES,
    "keyword_top_k": "WITH " + LIBRARY + TERMS + HOT,
    "scan_corpus": "WITH " + TREE + "\nSELECT rel_path, size, content FROM files",
    "ingest_summary": "WITH " + TREE + TREE_VERSES + """
SELECT coalesce(content_type, 'none') AS content_type,
  CASE WHEN outcome = 'routed' THEN 'indexed' ELSE outcome END AS outcome, count(*) AS n FROM routed GROUP BY 1, 2
UNION ALL SELECT CASE content_type WHEN 'scriptures' THEN 'chapters' ELSE content_type END, 'rows', count(*)
  FROM routed WHERE content_type IS NOT NULL GROUP BY 1
UNION ALL SELECT 'scriptures', 'rows', count(*) FROM tree_verses""",
    "ingest_stream": "WITH " + TREE + TREE_VERSES + "\nSELECT * FROM tree_verses",
    "build_postings": "WITH " + LIBRARY + TERMS + "\nSELECT source_type, source_id, term, tf, doc_len FROM postings",
    "stem_vocabulary": "WITH " + LIBRARY + STEMMED + "\nSELECT term, stem FROM stems WHERE term IN (SELECT term FROM plain_postings)",
    "build_postings_stemmed": "WITH " + LIBRARY + STEMMED + "\nSELECT source_type, source_id, term, tf, doc_len FROM postings",
    "search_postings_stemmed": "WITH " + LIBRARY + STEMMED + keyword_hits("kw", "log_tf")
    + "\nSELECT query_id, rank, source_type, source_id, score FROM kw",
    "keyword_search_stemmed": "WITH " + LIBRARY + STEMMED + keyword_hits("kw", "log_tf")
    + f"\nSELECT query_id, rank, source_type, source_id, score, {CARDS} FROM kw JOIN cards USING (source_type, source_id)",
    "keyword_search": keyword_search("log_tf"),
    "keyword_search_bm25": keyword_search("bm25"),
    "keyword_search_sources": (
        "WITH " + LIBRARY.replace("FROM docs))", "FROM docs) WHERE source_type IN ('talks', 'study_aids'))") + TERMS
        + keyword_hits("kw", "log_tf", 3)
        + f"\nSELECT query_id, rank, source_type, source_id, score, {CARDS} FROM kw JOIN cards USING (source_type, source_id)"
    ),
    "semantic_search": "WITH " + LIBRARY + VECTORS + CENTROIDS + nearest() + ENRICHED,
    "semantic_search_overfetch": "WITH " + LIBRARY + VECTORS + CENTROIDS + nearest(allowed="true") + OVERFETCH,
    "semantic_search_batch": "WITH " + LIBRARY + VECTORS + EVERY + nearest() + ENRICHED,
    "semantic_search_approx": (
        "WITH " + LIBRARY + VECTORS + EVERY + CELL_PAIRS
        + nearest("JOIN visited USING (query_id, source_type, source_id)") + ENRICHED
    ),
    "model_census": "SELECT 'driver' AS model, len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY ALL",
    "rrf_merge": (
        "WITH " + LIBRARY + TERMS + BM25_STATS + keyword_hits("kw", "log_tf") + keyword_hits("bm", "bm25") + RRF
        + fused("kw_cards", "bm_cards")
    ),
    "hybrid_search": (
        "WITH " + LIBRARY + TERMS + keyword_hits("kw", "log_tf") + CHUNKS + HYBRID + fused("kw_cards", "sem_cards")
    ),
    "decorate_links": (
        "WITH " + LIBRARY
        + f""",
paged AS (SELECT source_id, file_path, regexp_replace(CASE WHEN contains(file_path, 'gospel-library/')
    THEN split_part(file_path, 'gospel-library/', 2) ELSE regexp_replace(file_path, '^/', '') END, '\\.md$', '') AS page FROM library),
linked AS (SELECT source_id, file_path, {URL} AS url FROM paged)
SELECT source_id, file_path, url AS web_url, 'both' AS mode FROM linked
UNION ALL SELECT source_id, '', url, 'web' FROM linked
UNION ALL SELECT source_id, file_path, '', 'fs' FROM linked"""
    ),
    "list_volumes": "WITH " + VERSES
    + "\nSELECT volume, count(DISTINCT book) AS books, count(*) AS verses FROM verses GROUP BY volume ORDER BY volume",
    "list_sessions": """SELECT year(o_orderdate)::INT AS year, strftime(o_orderdate, '%m') AS month, count(*) AS talks
FROM orders GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 50""",
    "list_manual_collections": """SELECT source AS collection, count(*) AS pages
FROM documents GROUP BY source ORDER BY source LIMIT 200""",
    "list_book_collections": "SELECT lang AS collection, count(*) AS sections FROM documents GROUP BY lang ORDER BY lang",
    "list_study_aids": "WITH " + DOCS
    + "\nSELECT ['tg', 'bd', 'gs', 'jst'][no % 4 + 1] AS aid_type, count(*) AS entries FROM docs GROUP BY 1 ORDER BY 1",
    "corpus_stats": """SELECT 'scriptures' AS "table", sum(len(string_split(text, chr(10))))::BIGINT AS n FROM documents
UNION ALL SELECT 'chapters', count(*) FROM documents UNION ALL SELECT 'talks', count(*) FROM orders
UNION ALL SELECT 'manuals', count(*) FROM pages UNION ALL SELECT 'books', count(*) FROM conversations
UNION ALL SELECT 'study_aids', 0 UNION ALL SELECT 'embeddings', count(*) FROM embeddings""",
    "resolve_citations": "WITH " + VERSES + RESOLVED + resolve() + "\nSELECT * FROM resolved",
    "resolve_book_names": "WITH " + NAMES + SPELT + resolve() + "\nSELECT * FROM resolved",
    "compose_reference": "WITH " + NAMES + "\nSELECT * FROM composed",
    "get_verse": "WITH " + VERSES + RESOLVED + resolve() + "\nSELECT * FROM found_verses WHERE shape = 'verse'",
    "get_verse_range": "WITH " + VERSES + RESOLVED + resolve() + "\nSELECT * FROM found_verses WHERE shape = 'range'",
    "get_chapter": "WITH " + VERSES + RESOLVED + resolve() + "\nSELECT * FROM found_chapters",
    "get_passages": "WITH " + VERSES + RESOLVED + resolve() + PASSAGES,
    "get_by_id": (
        "WITH " + LIBRARY
        + """,
requests AS (SELECT source_id * 2 AS request_id, source_type, source_id FROM library
  UNION ALL SELECT source_id * 2 + 1, 'talks', source_id FROM library)
SELECT request_id, r.source_type, r.source_id, CASE WHEN l.source_id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
  aid_type, CASE r.source_type WHEN 'manuals' THEN split_part(file_path, '/', 3) WHEN 'books' THEN split_part(file_path, '/', 4) END AS collection,
  CASE WHEN r.source_type <> 'scriptures' THEN content END AS content,
  CASE WHEN l.source_type = 'scriptures' THEN l.source_id::INT END AS chapter,
  CASE WHEN l.source_type = 'scriptures' THEN split_part(file_path, '/', 4) END AS book,
  file_path, month, reference, CASE WHEN l.source_type = 'books' THEN 's' END AS section, slug, speaker,
  CASE WHEN l.source_type = 'scriptures' THEN content END AS text, title,
  CASE WHEN l.source_type = 'scriptures' THEN 1 END AS verse, CASE WHEN l.source_type = 'scriptures' THEN 'bofm' END AS volume, year
FROM requests r LEFT JOIN library l USING (source_type, source_id)"""
    ),
    "cross_references": """WITH targets AS (
  SELECT DISTINCT o_orderkey AS request_id, 'parts' AS target_volume, 'part' AS target_book,
    l_partkey::INT AS target_chapter, CASE WHEN l_linestatus <> 'F' THEN l_linenumber END AS target_verse,
    nullif(l_returnflag, 'N') AS reference_type
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber BETWEEN 1 AND 7),
shown AS (SELECT p_partkey AS target_chapter, p_size % 7 + 1 AS target_verse, min(p_name) AS shown FROM part GROUP BY ALL)
SELECT targets.*, coalesce(shown, 'part ' || target_chapter || coalesce(':' || target_verse, '')) AS reference
FROM targets LEFT JOIN shown USING (target_chapter, target_verse)""",
    "cross_references_hot": """WITH edges AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS chapter, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_linenumber END AS verse,
    l_partkey::INT AS target_chapter, CASE WHEN l_linestatus <> 'F' THEN l_linenumber END AS target_verse, nullif(l_returnflag, 'N') AS reference_type
  FROM lineitem),
asked AS (
  SELECT o_orderkey AS request_id, o_orderkey AS chapter, unnest(range(1, 8)) AS verse FROM orders
  UNION ALL SELECT o_orderkey, 0, 1 FROM orders WHERE o_orderkey % 1500 = 1),
targets AS (
  SELECT DISTINCT request_id, 'parts' AS target_volume, 'part' AS target_book, target_chapter, target_verse, reference_type
  FROM edges JOIN asked USING (chapter, verse)),
shown AS (SELECT p_partkey AS target_chapter, p_size % 7 + 1 AS target_verse, min(p_name) AS shown FROM part GROUP BY ALL)
SELECT targets.*, coalesce(shown, 'part ' || target_chapter || coalesce(':' || target_verse, '')) AS reference
FROM targets LEFT JOIN shown USING (target_chapter, target_verse)""",
    "route_files": "WITH " + MIXED + "\nSELECT * FROM routed",
    "extract_verses": (
        "WITH " + SCRIPTURE_FILES
        + f""",
marked AS (SELECT doc_id, source, path, unnest(string_split(content, chr(10))) AS line FROM files)
SELECT 'bofm' AS volume, source AS book, doc_id::INT AS chapter, verse, source || ' ' || doc_id || ':' || verse AS reference,
  text, path AS file_path
FROM (SELECT *, try_cast(regexp_extract(line, '^\\*\\*(\\d+)\\.\\*\\*\\s*(.+)', 1) AS INT) AS verse,
    {clean("regexp_extract(line, '^\\*\\*(\\d+)\\.\\*\\*\\s*(.+)', 2)")} AS text FROM marked)
WHERE verse IS NOT NULL AND text <> ''"""
    ),
    "extract_chapters": "WITH " + SCRIPTURE_FILES + """
SELECT 'bofm' AS volume, source AS book, doc_id::INT AS chapter, 'Chapter ' || doc_id AS title,
  content AS full_content, path AS file_path FROM files""",
    "first_headings": "WITH " + MIXED + """,
headed AS (SELECT doc_id, rel_path, CASE WHEN length(content) % 2 = 0
  THEN 'intro' || chr(10) || '#  On ' || doc_id || ' ' || chr(10) || content ELSE content END AS content FROM files),
firsts AS (SELECT *, list_filter(string_split(content, chr(10)), lambda l: starts_with(l, '# '))[1] AS line FROM headed)
SELECT doc_id, coalesce(nullif(trim(line[3:]), ''), replace(split_part(rel_path, '/', -1), '.md', '')) AS title FROM firsts""",
    "parse_talk_header": "WITH " + TALKS
    + "\nSELECT year, month, rel_path, file_path, title, speaker, content, raw_first_line, suspicious FROM talks",
    "quarantine_speakers": "WITH " + TALKS
    + "\nSELECT rel_path, raw_first_line, speaker AS fallback_value FROM talks WHERE suspicious",
    "backfill_speakers": "WITH " + TALKS + BACKFILL + "\nSELECT id, file_path, speaker FROM statuses WHERE status = 'changed'",
    "backfill_summary": "WITH " + TALKS + BACKFILL
    + "\nSELECT status, count(*) AS n FROM statuses GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM statuses",
    "chunk_paragraphs": "WITH " + LIBRARY + CHUNKS + "\nSELECT * FROM chunks",
    "manifest_diff": "WITH " + MIXED + "\nSELECT * FROM diff",
    "index_run_summary": "WITH " + MIXED + """
SELECT coalesce(r.content_type, 'none') AS content_type,
  CASE WHEN r.outcome <> 'routed' THEN r.outcome WHEN d.outcome = 'unchanged' THEN 'unchanged' ELSE 'indexed' END AS outcome,
  count(*) AS n
FROM routed r LEFT JOIN diff d ON path = rel_path GROUP BY 1, 2""",
    "manifest_upsert": "WITH " + MIXED + f""",
changed AS (SELECT * FROM diff WHERE outcome <> 'unchanged')
SELECT coalesce(path, file_path) AS file_path, CASE WHEN path IS NULL THEN 'old' ELSE c.content_type END AS content_type,
  CASE WHEN path IS NULL THEN TIMESTAMP '{MTIME}' ELSE TIMESTAMP '2024-07-01' END AS indexed_at,
  coalesce(mtime, file_mtime) AS file_mtime, coalesce(size, file_size) AS file_size,
  CASE WHEN path IS NULL THEN 1 ELSE 7 END::INT AS record_count
FROM manifest m FULL JOIN changed c ON path = file_path""",
    "upsert_talks": "WITH " + TALKS + """
SELECT year, month, t.speaker, title, content, file_path, titsw_dominant FROM talks t LEFT JOIN old_talks o USING (file_path)""",
    "upsert_chapters": """SELECT lang AS volume, source AS book, doc_id::INT AS chapter, 'Chapter ' || doc_id || ' from a/1' AS title,
  text AS full_content, 'a/1' || source || '/' || doc_id AS file_path, 'q' || quality AS enrichment_summary
FROM documents LEFT JOIN labels USING (doc_id)""",
    "upsert_verses": "WITH " + VERSES
    + "\nSELECT v.* EXCLUDE (id), 'u' || quality AS source_url FROM verses v LEFT JOIN labels ON doc_id = chapter",
    "upsert_manuals": upserted("'manual' AS content_type, source AS collection_id, 'T ' || doc_id AS title, text AS content").replace(
        "'manual' AS content_type", "CASE WHEN quality IS NULL THEN 'manual' ELSE 'old' END AS content_type"
    ),
    "upsert_books": upserted("source AS collection, lang AS section, 'T ' || doc_id AS title, text AS content"),
    "upsert_study_aids": upserted("'tg' AS aid_type, source AS slug, 'T ' || doc_id AS title, text AS content"),
    "embeddings_insert_if_absent": "WITH " + LIBRARY + CHUNKS + VECTORS + """
SELECT * FROM chunks ANTI JOIN vectors USING (source_type, source_id, layer) WHERE layer = 'paragraph'""",
    "pending_embeddings": "WITH " + LIBRARY + CHUNKS + VECTORS + """
SELECT * FROM chunks ANTI JOIN vectors USING (source_type, source_id, layer)""",
    "embed_changed": "WITH " + LIBRARY + REVISED,
    "pending_verses": "WITH " + VERSES + """
SELECT 'scriptures' AS source_type, id AS source_id, 'verse' AS layer, text AS content FROM verses
WHERE text <> '' AND id NOT IN (SELECT vec_id * 1000000 + 1 FROM embeddings)""",
    "embed_chunks": "WITH " + LIBRARY + CHUNKS
    + hashed("chunk_vec", "source_type, source_id, layer", "(SELECT * FROM chunks WHERE source_type <> 'study_aids')")
    + "\nSELECT source_type, source_id, layer, 'hash-64' AS model, pos::INT AS pos, round(x::DOUBLE, 6) AS x FROM chunk_vec",
}
