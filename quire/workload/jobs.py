"""The registered queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.analysis import ENGLISH, PLAIN, Analyzer
from quire.functions.stem_steps import stems
from quire.functions.text import first_heading, path_stem
from quire.operators import blocks, catalog, embed, extract, fusion, keyword, lookup, phrases, segments, semantic, trained, upsert
from quire.schemas import BOOK_NAMES, EMBEDDED_SOURCES, STUDY_AID_TYPES, TABLES
from quire.plans.ingest import backfill_stored_speakers, ingest
from quire.plans.ingest import embed_changed as refresh_vectors
from quire.session import materialise, scratch_path
from quire.sources import corpus
from quire.sources.tables import StateTables
from quire.streaming import ingest as stream
from quire.workload import views as v

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}


def job(fn: Job) -> Job:
    JOBS[fn.__name__] = fn
    return fn


# --- keyword search ------------------------------------------------------------


def term_index(spark: SparkSession, sf_dir: str, analyzer: Analyzer = PLAIN) -> DataFrame:
    return materialise(keyword.build_term_index(v.library(spark, sf_dir), analyzer), "term-index")


@job
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.build_postings(v.library(spark, sf_dir))


@job
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(v.passages(spark, sf_dir), term_index(spark, sf_dir))


@job
def keyword_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(v.passages(spark, sf_dir), term_index(spark, sf_dir), ranker="bm25")


@job
def keyword_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources only, three hits per query, in the form for batches too large to broadcast."""
    queries = v.passages(spark, sf_dir).withColumn("limit", F.lit(3))
    return keyword.keyword_search(
        queries, term_index(spark, sf_dir), sources=["talks", "study_aids"], in_row_terms=0
    )


@job
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from a postings table stored by term."""
    stored = keyword.write_postings(
        keyword.build_postings(v.library(spark, sf_dir)), scratch_path(spark, "postings")
    )
    return keyword.search_postings(v.passages(spark, sf_dir), stored)


@job
def postings_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after three batches and a compaction between them: drafts, their revision with deletions, late documents."""
    kept = segments.SegmentedPostings(spark, scratch_path(spark, "segments"), parts=16)
    drafts, library = v.draft_library(spark, sf_dir), v.library(spark, sf_dir)
    kept.apply(drafts)
    revised = library.join(v.table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    kept.apply(revised, drafts.filter("source_id < 0"))
    kept.compact()
    kept.apply(library.join(v.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source_id")), "source_id", "left_semi"))
    return kept.live().drop("term_part")


@job
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three terms of every benchmark passage as a phrase, in every document."""
    said = F.array_join(F.slice(PLAIN.tokens(F.col("query")), 1, 3), " ")
    positions = materialise(phrases.build_positions(v.library(spark, sf_dir)), "positions")
    return phrases.search_phrases(v.passages(spark, sf_dir).withColumn("query", said), positions)


@job
def keyword_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of the hottest terms, limits 3, 20 and 100 and such out of range, from blocks with early end."""
    postings = materialise(keyword.build_postings(v.library(spark, sf_dir)), "postings")
    index = blocks.write_block_index(postings, scratch_path(spark, "block-index"), parts=32)
    return blocks.search_blocks(v.hot_queries(postings), index)


@job
def keyword_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(
        v.passages(spark, sf_dir), term_index(spark, sf_dir, ENGLISH), analyzer=ENGLISH
    )


@job
def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term of the library with its stem."""
    return stems(keyword.build_postings(v.library(spark, sf_dir)).select("term").distinct())


@job
def build_postings_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain postings joined with the stemmed vocabulary."""
    return keyword.stemmed_postings(materialise(keyword.build_postings(v.library(spark, sf_dir)), "postings"))


@job
def search_postings_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed search from postings that were stemmed through the vocabulary and stored by term."""
    postings = materialise(keyword.build_postings(v.library(spark, sf_dir)), "postings")
    stored = keyword.write_postings(keyword.stemmed_postings(postings), scratch_path(spark, "postings"))
    return keyword.search_postings(v.passages(spark, sf_dir), stored, analyzer=ENGLISH)


# --- semantic search -----------------------------------------------------------


@job
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_search(
        v.centroids(spark, sf_dir), v.vectors(spark, sf_dir), v.library(spark, sf_dir), model="driver"
    )


@job
def semantic_search_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_search_overfetch(
        v.centroids(spark, sf_dir), v.vectors(spark, sf_dir), v.library(spark, sf_dir)
    )


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a stored table, for searches that pass over them several times."""
    return materialise(v.vectors(spark, sf_dir), "vectors")


@job
def semantic_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query, in blocks of 4,096 queries."""
    return semantic.semantic_search(
        v.every_vector(spark, sf_dir), vector_table(spark, sf_dir), v.library(spark, sf_dir), shared=False, block_floats=64 * 4096
    )


@job
def semantic_search_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_search_approx(
        v.every_vector(spark, sf_dir), vector_table(spark, sf_dir), v.library(spark, sf_dir)
    )


@job
def semantic_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query, through fitted cells and codes, with exact scores for a tenth of the rows at most."""
    index = trained.build(v.vectors(spark, sf_dir))
    return trained.search(
        v.every_vector(spark, sf_dir), index, v.library(spark, sf_dir), most=max(10, min(trained.CANDIDATES, index.n // 10))
    )


@job
def model_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.model_census(v.vectors(spark, sf_dir))


# --- fusion ----------------------------------------------------------------------


@job
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = term_index(spark, sf_dir), v.passages(spark, sf_dir)
    return fusion.rrf_merge(
        keyword.keyword_search(queries, index), keyword.keyword_search(queries, index, ranker="bm25")
    )


def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = extract.chunk_paragraphs(
        v.paragraphs(spark, sf_dir).filter(F.col("source_type").isin(*embed.EMBEDDED_SOURCES))
    )
    return embed.embedded(embed.embed_chunks(chunks, embed.hashing_embedder(), "hash-64", dim=64))


@job
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vector for every passage."""
    queries = materialise(embed.embed_queries(v.passages(spark, sf_dir), embed.hashing_embedder()), "queries")
    found = keyword.keyword_search(queries, term_index(spark, sf_dir))
    near = semantic.semantic_search(
        queries, materialise(text_embeddings(spark, sf_dir), "text-vectors"), v.library(spark, sf_dir), model="hash-64"
    )
    return fusion.hybrid_merge(queries, found, near)


@job
def decorate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.library(spark, sf_dir).select("source_id", "file_path")
    modes = [fusion.decorate_links(rows, m).withColumn("mode", F.lit(m)) for m in fusion.LINK_MODES]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


# --- listings --------------------------------------------------------------------


@job
def list_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_volumes(v.verses(spark, sf_dir))


@job
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    return catalog.list_sessions(
        orders.select(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MM").alias("month"))
    )


@job
def list_manual_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_manual_collections(
        v.documents(spark, sf_dir).select(F.col("source").alias("collection_id"))
    )


@job
def list_book_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_book_collections(v.documents(spark, sf_dir).select(F.col("lang").alias("collection")))


@job
def list_study_aids(spark: SparkSession, sf_dir: str) -> DataFrame:
    aid = F.get(F.array(*[F.lit(a) for a in STUDY_AID_TYPES]), F.col("no") % 4)
    return catalog.list_study_aids(v.documents(spark, sf_dir).select(aid.alias("aid_type")))


@job
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.corpus_stats(
        {
            "scriptures": v.verses(spark, sf_dir),
            "chapters": v.chapters(spark, sf_dir),
            "talks": v.table(spark, sf_dir, "orders"),
            "manuals": v.table(spark, sf_dir, "pages"),
            "books": v.table(spark, sf_dir, "conversations"),
            "embeddings": v.table(spark, sf_dir, "embeddings"),
        }
    )


@job
def listings_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing from the counts beside the tables, after files were ingested, changed, and pruned (those of toxic documents)."""
    state, root = scratch_path(spark, "state"), scratch_path(spark, "tree")
    ingest(spark, state, v.write_tree(v.first_tree_files(spark, sf_dir), root))
    ingest(spark, state, v.write_tree(v.later_tree_files(spark, sf_dir), root))
    toxic = v.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    v.remove_files(v.tree_files(spark, sf_dir, with_id=True).join(toxic, "doc_id", "left_semi"), root)
    ingest(spark, state, root, prune=True)
    counts = StateTables(spark, state).all_counts()
    volumes = catalog.kept_listing(counts, "scriptures")
    parts = [
        volumes.select(F.lit("volumes").alias("listing"), F.col("volume").alias("key"), F.col("verses").alias("n")),
        volumes.select(F.lit("books of volume"), "volume", "books"),
        catalog.kept_listing(counts, "talks").select(F.lit("sessions"), F.concat_ws("/", "year", "month"), "talks"),
        catalog.kept_listing(counts, "manuals").select(F.lit("manuals"), "collection", "pages"),
        catalog.kept_listing(counts, "study_aids").select(F.lit("study aids"), "aid_type", "entries"),
        catalog.kept_listing(counts).select(F.lit("tables"), "table", "n"),
    ]
    return reduce(DataFrame.union, parts)


# --- lookups ---------------------------------------------------------------------


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolve_citations(v.citations(spark, sf_dir), v.source_aliases(spark, sf_dir))


@job
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)


@job
def resolve_book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations under display names, resolved with the built-in spellings."""
    cited = book_rows(spark, sf_dir)
    return lookup.resolve_citations(cited.select("request_id", F.col("reference").alias("citation")))


def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = F.array(*[F.lit(b) for b in BOOK_NAMES], F.lit("nowhere"))
    docs = v.documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"),
        F.get(slugs, (F.col("doc_id") % (len(BOOK_NAMES) + 1)).cast("int")).alias("book"),
        (F.col("no") + 1).alias("chapter"),
        F.col("n_chars").cast("int").alias("verse"),
    )
    return extract.compose_reference(docs)


@job
def compose_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_rows(spark, sf_dir)


@job
def get_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = resolved(spark, sf_dir).filter(F.col("end_verse").isNull())
    return lookup.get_verses(asked, v.verses(spark, sf_dir))


@job
def get_verse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = resolved(spark, sf_dir).filter(F.col("end_verse").isNotNull())
    return lookup.get_verses(asked, v.verses(spark, sf_dir))


@job
def get_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_chapters(resolved(spark, sf_dir), v.chapters(spark, sf_dir))


@job
def get_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_passages(materialise(resolved(spark, sf_dir), "resolved"), v.verses(spark, sf_dir), v.chapters(spark, sf_dir))


@job
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its type and number, once under its own type and once as a talk."""
    rows = v.library(spark, sf_dir).withColumn("id", F.col("source_id"))
    words = F.split("file_path", "/")
    tables = {
        "scriptures": rows.select(
            "id", F.lit("bofm").alias("volume"), F.get(words, F.lit(3)).alias("book"),
            F.col("id").cast("int").alias("chapter"), F.lit(1).alias("verse"), "reference",
            F.col("content").alias("text"), "file_path", "source_type",
        ),
        "talks": rows,
        "manuals": rows.withColumn("collection_id", F.get(words, F.lit(2))),
        "books": rows.withColumn("collection", F.get(words, F.lit(3))).withColumn("section", F.lit("s")),
        "study_aids": rows,
    }
    tables = {k: t.filter(F.col("source_type") == k) for k, t in tables.items()}
    own = rows.select((F.col("id") * 2).alias("request_id"), "source_type", "source_id")
    other = rows.select((F.col("id") * 2 + 1).alias("request_id"), F.lit("talks").alias("source_type"), "source_id")
    return lookup.get_by_id(own.unionByName(other), tables)


@job
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.cross_references(
        v.order_verses(spark, sf_dir), v.line_edges(spark, sf_dir), v.part_verses(spark, sf_dir)
    )


@job
def cross_references_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a third of the edges on one verse, which every 1500th order asks for as well."""
    return lookup.cross_references(
        v.hot_order_verses(spark, sf_dir), v.hot_line_edges(spark, sf_dir), v.part_verses(spark, sf_dir)
    )


# --- extraction --------------------------------------------------------------------


def tree(spark: SparkSession, sf_dir: str) -> str:
    return v.write_tree(v.tree_files(spark, sf_dir), scratch_path(spark, "tree"))


@job
def scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file of the mixed tree, and listed again."""
    return corpus.scan_corpus(spark, tree(spark, sf_dir)).select("rel_path", "size", "content")


@job
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and rows per content type of a first batch ingest of that tree."""
    return ingest(spark, scratch_path(spark, "state"), tree(spark, sf_dir))


@job
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses stored by the streaming ingest of that tree."""
    state = scratch_path(spark, "state")
    query = stream.ingest_stream(spark, state, scratch_path(spark, "progress"), tree(spark, sf_dir), files_per_batch=5000)
    query.awaitTermination()
    return StateTables(spark, state).read("scriptures").select(
        "volume", "book", "chapter", "verse", "reference", "text"
    )


@job
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of a second ingest, after files were added to the tree and others changed, and the verses stored then."""
    state, root = scratch_path(spark, "state"), scratch_path(spark, "tree")
    ingest(spark, state, v.write_tree(v.first_tree_files(spark, sf_dir), root))
    summary = ingest(spark, state, v.write_tree(v.later_tree_files(spark, sf_dir), root))
    stored = StateTables(spark, state).read("scriptures")
    sizes = stored.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).select(
        F.lit("scriptures").alias("content_type"), F.explode(F.create_map(F.lit("stored"), "n", F.lit("characters"), "size")).alias("outcome", "n")
    )
    return summary.unionByName(sizes)


@job
def backfill_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored talks, some under a wrong name, after their speakers were read again from their own files."""
    state, root = scratch_path(spark, "state"), tree(spark, sf_dir)
    ingest(spark, state, root)
    tables = StateTables(spark, state)
    poor = v.table(spark, sf_dir, "labels").filter("quality = 0").select(F.concat("doc_id", F.lit(".md")).alias("name"))
    talks = tables.read("talks").withColumn("name", F.element_at(F.split("file_path", "/"), -1))
    wrong = talks.join(poor, "name", "left_semi").drop("name").withColumn("speaker", F.lit("nobody"))
    tables.merge("talks", materialise(wrong.drop("id"), "wrong"), "file_path", ["speaker"])
    counts = backfill_stored_speakers(spark, state, root).select(F.col("status").alias("name"), F.col("n"))
    after = tables.read("talks").groupBy(F.col("speaker").alias("name")).agg(F.count("*").alias("n"))
    return counts.unionByName(after)


@job
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.route_files(v.mixed_files(spark, sf_dir)).drop("content", "mtime", "path")


@job
def extract_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_verses(corpus.route_files(v.scripture_files(spark, sf_dir))).drop("line_no")


@job
def extract_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_chapters(corpus.route_files(v.scripture_files(spark, sf_dir)))


@job
def first_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading of every file, half of the tree having none: the base name stands in."""
    files = v.mixed_files(spark, sf_dir).select(
        "doc_id", "path",
        F.when(F.length("content") % 2 == 0, F.concat(F.lit("intro\n#  On "), "doc_id", F.lit(" \n"), "content"))
        .otherwise(F.col("content")).alias("content"),
    )
    return files.select("doc_id", first_heading(F.col("content"), path_stem(F.col("path"))).alias("title"))


@job
def parse_talk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_talks(corpus.route_files(v.talk_files(spark, sf_dir)))


@job
def quarantine_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = extract.extract_talks(corpus.route_files(v.talk_files(spark, sf_dir)))
    return extract.quarantine_speakers(talks, F.lit(v.MTIME).cast("timestamp")).drop("logged_at")


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored talks against the tree; talks of the labelled documents without a file are missing."""
    return extract.backfill_speakers(v.old_talks(spark, sf_dir), v.talk_files(spark, sf_dir))


@job
def backfill_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.backfill_updates(backfill(spark, sf_dir))


@job
def backfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.backfill_summary(backfill(spark, sf_dir))


@job
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.chunk_paragraphs(v.paragraphs(spark, sf_dir))


# --- manifest and upserts ------------------------------------------------------------


def routed_and_diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    routed = corpus.route_files(v.mixed_files(spark, sf_dir))
    known = routed.filter(F.col("outcome") == "routed")
    return routed, corpus.manifest_diff(known, v.old_manifest(spark, sf_dir))


@job
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_and_diff(spark, sf_dir)[1]


@job
def index_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_run_summary(*routed_and_diff(spark, sf_dir))


@job
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = corpus.changed_files(routed_and_diff(spark, sf_dir)[1]).withColumn("record_count", F.lit(7))
    rows = corpus.manifest_rows(changed, F.lit("2024-07-01").cast("timestamp"))
    return upsert.upsert_table("index_metadata", v.old_manifest(spark, sf_dir), rows)


@job
def upsert_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = materialise(extract.extract_talks(corpus.route_files(v.talk_files(spark, sf_dir))), "talks")
    return upsert.upsert_table("talks", v.old_talks(spark, sf_dir), talks).drop("id")


@job
def upsert_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter arrives under two paths; the later path wins, enrichment survives."""
    fresh = v.chapters(spark, sf_dir).select(
        "volume", "book", "chapter", "title", "full_content",
        F.explode(F.array(F.lit("a/0"), F.lit("a/1"))).alias("prefix"), "file_path",
    )
    incoming = fresh.select(
        "volume", "book", "chapter", F.concat("title", F.lit(" from "), "prefix").alias("title"),
        "full_content", F.concat("prefix", "file_path").alias("file_path"),
    )
    labels = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    existing = v.chapters(spark, sf_dir).join(labels, "id").select(
        "id", "volume", "book", "chapter", F.lit("old").alias("title"), F.lit("old").alias("full_content"),
        F.lit("old").alias("file_path"), F.concat(F.lit("q"), "quality").alias("enrichment_summary"),
    )
    return upsert.upsert_table("chapters", existing, incoming).drop("id")


@job
def upsert_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses of every chapter over those stored for the labelled documents under another text."""
    incoming = v.verses(spark, sf_dir).drop("id")
    labels = v.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("chapter"), "quality")
    existing = v.verses(spark, sf_dir).join(labels, "chapter").select(
        "id", "volume", "book", "chapter", "verse", F.lit("old").alias("reference"), F.lit("old").alias("text"),
        F.lit("old").alias("file_path"), F.concat(F.lit("u"), "quality").alias("source_url"),
    )
    return upsert.upsert_table("scriptures", existing, incoming).drop("id")


def _upsert_documents(spark: SparkSession, sf_dir: str, name: str, columns: dict) -> DataFrame:
    """Upsert all documents into one of the tables keyed by file path."""
    docs = v.documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("p/"), "doc_id").alias("file_path"), *[c.alias(n) for n, c in columns.items()]
    )
    labels = v.table(spark, sf_dir, "labels").select("doc_id", "quality")
    existing = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "file_path",
        *[F.lit("old").alias(n) for n in columns],
        F.concat(F.lit("u"), "quality").alias("source_url"),
    )
    return upsert.upsert_table(name, existing, docs.drop("doc_id")).drop("id")


@job
def upsert_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "content_type": F.lit("manual"), "collection_id": F.col("source"),
        "title": F.concat(F.lit("T "), "doc_id"), "content": F.col("text"),
    }
    return _upsert_documents(spark, sf_dir, "manuals", columns)


@job
def upsert_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "collection": F.col("source"), "section": F.col("lang"),
        "title": F.concat(F.lit("T "), "doc_id"), "content": F.col("text"),
    }
    return _upsert_documents(spark, sf_dir, "books", columns)


@job
def upsert_study_aids(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "aid_type": F.lit("tg"), "slug": F.col("source"),
        "title": F.concat(F.lit("T "), "doc_id"), "content": F.col("text"),
    }
    return _upsert_documents(spark, sf_dir, "study_aids", columns)


# --- embeddings ----------------------------------------------------------------------


def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First paragraphs of the documents that have a stored vector."""
    return v.vectors(spark, sf_dir)


@job
def embeddings_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All first paragraphs, each in two copies, against the stored vectors: the lower copy of new ones is added."""
    chunks = extract.chunk_paragraphs(v.paragraphs(spark, sf_dir)).filter(F.col("layer") == "paragraph")
    copies = F.explode(F.array(F.concat("content", F.lit(" ")), F.col("content")))
    return embed.new_embeddings(stored_embeddings(spark, sf_dir), chunks.withColumn("content", copies))


@job
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.pending_embeddings(
        extract.chunk_paragraphs(v.paragraphs(spark, sf_dir)), stored_embeddings(spark, sf_dir)
    )


@job
def pending_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses without a vector, when every stored vector belongs to the first verse of its document."""
    stored = v.table(spark, sf_dir, "embeddings").select(
        F.lit("scriptures").alias("source_type"),
        (F.col("vec_id") * 1_000_000 + 1).alias("source_id"),
        F.lit("verse").alias("layer"),
    )
    return embed.pending_embeddings(extract.verse_chunks(v.verses(spark, sf_dir)), stored)


def keep_library(state: StateTables, documents: DataFrame) -> None:
    """Store documents as the rows of the state tables: verses whole, lines of others as paragraphs."""
    for name in EMBEDDED_SOURCES:
        rows = documents.filter(F.col("source_type") == name).withColumn("chapter", F.col("source_id").cast("int"))
        named = rows.withColumn("id", F.col("source_id")).withColumn("text", F.col("content"))
        named = named.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
        fields = TABLES[name].fields
        state.replace(name, named.select(*[(F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]))


@job
def embed_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run did after documents were revised, came and went, and the vectors stored then."""
    state = StateTables(spark, scratch_path(spark, "state"))
    for documents in (v.draft_library(spark, sf_dir), v.library(spark, sf_dir)):
        keep_library(state, documents)
        did = refresh_vectors(spark, state.root, embed.hashing_embedder(), "hash-64", 64)
    stored = state.read("embeddings").groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("size"))
    return did.unionByName(
        stored.select("source_type", F.explode(F.create_map(F.lit("stored"), "n", F.lit("characters"), "size")).alias("outcome", "n"))
    )


@job
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero components of every chunk vector."""
    return text_embeddings(spark, sf_dir).select(
        "source_type", "source_id", "layer", "model", F.posexplode("embedding").alias("pos", "x")
    ).filter(F.col("x") != 0).withColumn("x", F.round(F.col("x").cast("double"), 6))
