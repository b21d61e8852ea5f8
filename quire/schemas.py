"""Table schemas, source order and the fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source types in the order in which equal scores are listed.
SOURCE_TYPES = ("scriptures", "talks", "manuals", "books", "study_aids")
# Sub-volumes that are scripture and those that are study aids.
SCRIPTURE_VOLUMES = ("ot", "nt", "bofm", "dc-testament", "pgp")
STUDY_AID_TYPES = ("tg", "bd", "gs", "jst")
# Which sources get vectors, and at which layer.
EMBEDDED_SOURCES = ("scriptures", "talks", "manuals", "books")
VERSE_LAYER = "verse"
PARAGRAPH_LAYER = "paragraph"
# Result limits and lookup limits.
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
SNIPPET_CHARS = 240
CHUNK_CHARS = 2000
MAX_RANGE_VERSES = 50
RRF_K = 60
OVERFETCH = 4
SESSIONS_LISTED = 50
COLLECTIONS_LISTED = 200


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(columns: str) -> T.StructType:
    # read here, because Spark's own DDL reader needs a running session
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FILES = _schema("path string, rel_path string, mtime timestamp, size bigint, content string")

SCRIPTURES = _schema(
    "id bigint, volume string, book string, chapter int, verse int, reference string, "
    "text string, file_path string, source_url string"
)
CHAPTERS = _schema(
    "id bigint, volume string, book string, chapter int, title string, full_content string, "
    "file_path string, source_url string, enrichment_summary string, enrichment_keywords string, "
    "enrichment_key_verse string, enrichment_christ_types string, enrichment_connections string, "
    "enrichment_model string, enrichment_raw_output string"
)
TALKS = _schema(
    "id bigint, year int, month string, session string, speaker string, title string, "
    "content string, file_path string, source_url string, titsw_dominant string, "
    "titsw_mode string, titsw_pattern string, titsw_teach int, titsw_help int, titsw_love int, "
    "titsw_spirit int, titsw_doctrine int, titsw_invite int, titsw_summary string, "
    "titsw_key_quote string, titsw_keywords string, titsw_reasoning string, "
    "titsw_raw_output string, titsw_model string"
)
MANUALS = _schema(
    "id bigint, content_type string, collection_id string, section string, title string, "
    "content string, file_path string, source_url string"
)
BOOKS = _schema(
    "id bigint, collection string, section string, title string, content string, "
    "file_path string, source_url string"
)
STUDY_AIDS = _schema(
    "id bigint, aid_type string, slug string, title string, content string, "
    "file_path string, source_url string"
)
CROSS_REFERENCES = _schema(
    "source_volume string, source_book string, source_chapter int, source_verse int, "
    "target_volume string, target_book string, target_chapter int, target_verse int, "
    "reference_type string"
)
EMBEDDINGS = _schema(
    "source_type string, source_id bigint, layer string, content string, "
    "embedding array<float>, model string"
)
EMBEDDED_DOCUMENTS = _schema("source_type string, source_id bigint, digest string, model string")
MANIFEST = _schema(
    "file_path string, content_type string, indexed_at timestamp, file_mtime timestamp, "
    "file_size bigint, record_count int"
)
SPEAKER_QUARANTINE = _schema(
    "logged_at timestamp, rel_path string, raw_first_line string, fallback_value string"
)
EMBEDDING_FAILURES = _schema(
    "source_type string, source_id bigint, layer string, content string, model string, error string"
)

TABLES = {
    "scriptures": SCRIPTURES,
    "chapters": CHAPTERS,
    "talks": TALKS,
    "manuals": MANUALS,
    "books": BOOKS,
    "study_aids": STUDY_AIDS,
    "cross_references": CROSS_REFERENCES,
    "embeddings": EMBEDDINGS,
    "embedded_documents": EMBEDDED_DOCUMENTS,
    "index_metadata": MANIFEST,
    "speaker_quarantine": SPEAKER_QUARANTINE,
    "embedding_failures": EMBEDDING_FAILURES,
}
# Tables counted by the corpus overview, in listing order.
COUNTED_TABLES = ("scriptures", "chapters", "talks", "manuals", "books", "study_aids", "embeddings")

# Columns that describe a hit, whatever its source; absent ones are null.
CARD_COLUMNS = (
    "title", "reference", "snippet", "file_path", "speaker", "year", "month", "aid_type", "slug",
)
HIT_COLUMNS = (
    "query_id", "rank", "source_type", "source_id", "title", "reference", "snippet", "file_path",
    "web_url", "score", "speaker", "year", "month", "aid_type", "slug",
)

# Display names of book slugs; a slug not listed shows as itself.
BOOK_NAMES = {
    "1-ne": "1 Nephi",
    "2-ne": "2 Nephi",
    "jacob": "Jacob",
    "enos": "Enos",
    "jarom": "Jarom",
    "omni": "Omni",
    "w-of-m": "Words of Mormon",
    "mosiah": "Mosiah",
    "alma": "Alma",
    "hel": "Helaman",
    "3-ne": "3 Nephi",
    "4-ne": "4 Nephi",
    "morm": "Mormon",
    "ether": "Ether",
    "moro": "Moroni",
    "dc": "D&C",
    "od": "Official Declaration",
    "moses": "Moses",
    "abr": "Abraham",
    "js-m": "JS—Matthew",
    "js-h": "Joseph Smith—History",
    "a-of-f": "Articles of Faith",
    "gen": "Genesis",
    "ex": "Exodus",
    "lev": "Leviticus",
    "num": "Numbers",
    "deut": "Deuteronomy",
    "ps": "Psalms",
    "isa": "Isaiah",
    "mal": "Malachi",
    "matt": "Matthew",
    "mark": "Mark",
    "luke": "Luke",
    "john": "John",
    "acts": "Acts",
    "rom": "Romans",
    "rev": "Revelation",
}

# Spellings of book names in citations and the slug they mean.
BOOK_ALIASES = {
    "genesis": "gen",
    "exodus": "ex",
    "leviticus": "lev",
    "numbers": "num",
    "deuteronomy": "deut",
    "joshua": "josh",
    "judges": "judg",
    "ruth": "ruth",
    "1 samuel": "1-sam",
    "2 samuel": "2-sam",
    "1 kings": "1-kgs",
    "2 kings": "2-kgs",
    "1 chronicles": "1-chr",
    "2 chronicles": "2-chr",
    "ezra": "ezra",
    "nehemiah": "neh",
    "esther": "esth",
    "job": "job",
    "psalms": "ps",
    "psalm": "ps",
    "proverbs": "prov",
    "ecclesiastes": "eccl",
    "song of solomon": "song",
    "isaiah": "isa",
    "jeremiah": "jer",
    "lamentations": "lam",
    "ezekiel": "ezek",
    "daniel": "dan",
    "hosea": "hosea",
    "joel": "joel",
    "amos": "amos",
    "obadiah": "obad",
    "jonah": "jonah",
    "micah": "micah",
    "nahum": "nahum",
    "habakkuk": "hab",
    "zephaniah": "zeph",
    "haggai": "hag",
    "zechariah": "zech",
    "malachi": "mal",
    "matthew": "matt",
    "mark": "mark",
    "luke": "luke",
    "john": "john",
    "acts": "acts",
    "romans": "rom",
    "1 corinthians": "1-cor",
    "2 corinthians": "2-cor",
    "galatians": "gal",
    "ephesians": "eph",
    "philippians": "philip",
    "colossians": "col",
    "1 thessalonians": "1-thes",
    "2 thessalonians": "2-thes",
    "1 timothy": "1-tim",
    "2 timothy": "2-tim",
    "titus": "titus",
    "philemon": "philem",
    "hebrews": "heb",
    "james": "james",
    "1 peter": "1-pet",
    "2 peter": "2-pet",
    "1 john": "1-jn",
    "2 john": "2-jn",
    "3 john": "3-jn",
    "jude": "jude",
    "revelation": "rev",
    "revelations": "rev",
    "1 nephi": "1-ne",
    "2 nephi": "2-ne",
    "jacob": "jacob",
    "enos": "enos",
    "jarom": "jarom",
    "omni": "omni",
    "words of mormon": "w-of-m",
    "mosiah": "mosiah",
    "alma": "alma",
    "helaman": "hel",
    "3 nephi": "3-ne",
    "4 nephi": "4-ne",
    "mormon": "morm",
    "ether": "ether",
    "moroni": "moro",
    "dc": "dc",
    "moses": "moses",
    "abraham": "abr",
    "js matthew": "js-m",
    "js history": "js-h",
    "joseph smith matthew": "js-m",
    "joseph smith history": "js-h",
    "articles of faith": "a-of-f",
}


def book_names(spark: SparkSession) -> DataFrame:
    """(book, display_name): fixed size, safe to broadcast."""
    return spark.createDataFrame(list(BOOK_NAMES.items()), "book string, display_name string")


def book_aliases(spark: SparkSession) -> DataFrame:
    """(alias, book): every spelling, and every slug as a spelling of itself."""
    spellings = {slug: slug for slug in BOOK_ALIASES.values()} | BOOK_ALIASES
    return spark.createDataFrame(sorted(spellings.items()), "alias string, book string")


def source_ordinal(source_type: Column | str) -> Column:
    """Position of a source type in listing order; unknown types sort last."""
    col = F.col(source_type) if isinstance(source_type, str) else source_type
    position = F.array_position(F.array(*[F.lit(s) for s in SOURCE_TYPES]), col).cast("int")
    return F.when(position > 0, position - 1).otherwise(len(SOURCE_TYPES))


def check_sources(sources: list[str] | tuple[str, ...] | None) -> list[str]:
    """Names to search: all five when none are given; a misspelt name is an error."""
    if not sources:
        return list(SOURCE_TYPES)
    unknown = sorted(set(sources) - set(SOURCE_TYPES))
    if unknown:
        raise ValueError(f"unknown sources {unknown}; choose from {list(SOURCE_TYPES)}")
    return list(sources)


def normalised_limit(limit: Column | int | None) -> Column:
    """Limits outside 1..100, and missing ones, mean 20."""
    col = limit if isinstance(limit, Column) else F.lit(limit).cast("int")
    return F.when(col.between(1, MAX_LIMIT), col).otherwise(DEFAULT_LIMIT)


def surrogate_id(*keys: str) -> Column:
    """Stable id of a row from its natural key."""
    return F.xxhash64(*[F.col(k) for k in keys])
