"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, word beginnings, word
pairs), one of the target text and one of all raw text, give every document
a log importance weight: how much likelier its n-grams are as target text. A
third model, of labelled toxic documents, takes from the weight what the worst
passage of a document, of fixed length, says for toxic text. A Gumbel draw is
added and the top k are kept. Its scale is small against the weights: it
settles the order of documents near the cut and little else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Store, add_columns, fresh

BITS = 18
BEGINNING = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Settings:
    """``prior``: pseudo-count of either model for a bucket. ``dead_zone``: log ratios above minus
    this are no evidence against a document. ``sharpness``: log weight for one unit
    of evidence; the Gumbel draw has unit scale. ``keep_target``: share of the labelled target
    documents that the default k keeps, down to ``least_target`` where more than ``most_toxic`` of the toxic ones would pass. ``most_labels``: bound of the labelled sample. ``passage``: words
    of a passage that is held against the toxic model. ``harm_zone``: log ratios below this do not speak for toxic
    text. ``harm``: evidence against a document for one unit of its worst passage's sum."""

    prior: float = 3.0
    dead_zone: float = 0.7
    sharpness: float = 100.0
    keep_target: float = 0.985
    most_labels: int = 40_000
    least_target: float = 0.975
    most_toxic: float = 0.03
    passage: int = 30
    harm_zone: float = 0.5
    harm: float = 0.15


def ngrams(text: bytes | None, known: dict[bytes, tuple[int, int]], most: int = 1 << 16) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text."""
    found = (text or b"").lower().split()
    pairs = []
    for word in found:
        pair = known.get(word)
        if pair is None:
            if len(known) >= most:
                known.clear()
            pair = known[word] = (xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(b"^" + word[:BEGINNING]))
        pairs.append(pair)
    if not pairs:
        return np.empty(0, dtype=np.int64)
    hashed = np.array(pairs, dtype=np.uint64)
    whole = hashed[:, 0]
    every = np.concatenate([whole, hashed[:, 1], whole[:-1] * _MIX + whole[1:]])
    return (((every ^ (every >> np.uint64(32))) * _END) >> np.uint64(64 - BITS)).astype(np.int64)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def labelled_sample(labels: DataFrame, good: Column, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of at most ``most`` labelled documents (lowest hashes first), whether each is target text, and whether toxic."""
    toxic = F.col("toxic") == 1 if "toxic" in labels.columns else F.lit(False)
    rows = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"), F.max(toxic.cast("int")).alias("toxic"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas().sort_values("doc_id")
    return picked["doc_id"].to_numpy(np.int64), picked["good"].fillna(0).to_numpy(bool), picked["toxic"].fillna(0).to_numpy(bool)


def fit(docs: DataFrame, target_ids: np.ndarray, toxic_ids: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Two rows: log ratio of the target to the raw model for every bucket, and of the toxic to the raw one.

    One pass over all documents: each task adds up its documents' n-grams, and
    the buckets are summed in Spark, so what reaches the driver is three numbers
    a bucket and the count of documents. Raw counts cover the whole corpus. The toxic model
    counts documents, not n-grams: a word that one of them repeats is no sign.
    """
    size = 1 << BITS
    sent = docs.sparkSession.sparkContext.broadcast((target_ids, toxic_ids))
    names = ["bucket", "raw", "target", "docs", "toxic"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place holds the number of documents.
        known, sums = {}, np.zeros((4, size + 1), np.int64)
        wanted, harmful = (set(x.tolist()) for x in sent.value)

        def add(kind: tuple[bool, bool], found: list[np.ndarray]) -> None:
            every = np.bincount(np.concatenate([np.empty(0, np.int64), *found]), minlength=size + 1)
            once = np.bincount(np.concatenate([np.empty(0, np.int64), *map(np.unique, found)]), minlength=size + 1)
            once[size] = len(found)
            sums[0] += every
            sums[1] += every * kind[0]
            sums[2] += once
            sums[3] += once * kind[1]

        held: dict[tuple[bool, bool], list[np.ndarray]] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, "text"), strict=True):
                found = ngrams(text, known)
                if len(found):
                    kind = (doc_id in wanted, doc_id in harmful)
                    held.setdefault(kind, []).append(found)
                    if len(held[kind]) == 500:
                        add(kind, held.pop(kind))
        for kind, found in held.items():
            add(kind, found)
        used = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(x[used]) for x in sums]], names)

    counts = docs.select("doc_id", "text").mapInArrow(count, ", ".join(f"{n} bigint" for n in names))
    counts = counts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]]).toPandas()
    sums = np.zeros((4, size + 1))
    for row, n in zip(sums, names[1:], strict=True):
        row[counts["bucket"]] = counts[n]
    raw, target, seen, toxic = sums[:, :size]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    usual = seen * (sums[3, size] / max(1.0, sums[2, size]))
    prior = settings.prior
    return np.log(np.stack([(target + prior) / (expected + prior), (toxic + prior) / (usual + prior)])).astype(np.float32)


def worst_passage(ratios: np.ndarray, words: int) -> float:
    """Greatest sum of ``ratios`` (laid out as by ``ngrams``) over a passage of ``words`` words; a shorter text is one passage."""
    n = (len(ratios) + 1) // 3
    each = ratios[:n] + ratios[n : 2 * n]
    each[:-1] += ratios[2 * n :]
    sums = np.concatenate([np.zeros(1), np.cumsum(each)])
    size = min(words, n)
    return float((sums[size:] - sums[:-size]).max())


def score(docs: DataFrame, ratios: np.ndarray, settings: Settings = Settings(), name: str = "log_weight") -> DataFrame:
    """Append the log importance weight; null for a document without words.

    The log ratios of a document's n-grams, cut at the dead zone, are summed
    and divided by the root of their number, so that long documents are not
    rejected for their length; the mean ratio, where negative, is added. The
    worst passage's evidence for toxic text is taken off: its length is fixed, so a
    long document does not dilute it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = sent.value, {}
        for batch in batches:
            weights = []
            for text in _texts(batch, "text"):
                found = ngrams(text, known)
                if not len(found):
                    weights.append(None)
                    continue
                r, toxic = table[:, found].astype(np.float64)
                harm = worst_passage(np.maximum(toxic - settings.harm_zone, 0), settings.passage)
                bad = np.minimum(r + settings.dead_zone, 0).sum() / np.sqrt(len(r))
                weights.append(round(float(settings.sharpness * (bad + 5 * min(r.mean(), 0.0) - settings.harm * harm)), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], [*batch.schema.names, name])

    return add_columns(docs, [T.StructField(name, T.DoubleType())], run)


def gumbel(seed: int) -> Column:
    """A Gumbel draw that depends on the document's id alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), 11)
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def kth_largest(keys: DataFrame, key: str, k: int, buckets: int = 4096, most: int = 50_000) -> float:
    """The k-th largest of a stored column: histograms close in until at most ``most`` values are left.

    When one value fills the last histogram, that value is it.
    """
    rows = keys.filter(F.col(key).isNotNull())
    low, high = rows.agg(F.min(key), F.max(key)).first()
    left, rest = rows.count(), k
    while left > most and low < high:
        width = (high - low) / buckets
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(buckets - 1))
        inside = rows.filter(F.col(key).between(low, high))
        counts = inside.groupBy(place.alias("b")).agg(F.count("*"), F.min(key), F.max(key)).orderBy(F.desc("b")).collect()
        for _, n, least, greatest in counts:
            if rest <= n:
                low, high, fewer = least, greatest, n
                break
            rest -= n
        if fewer == left:
            break
        left = fewer
    if low == high:
        return low
    inside = rows.filter(F.col(key).between(low, high)).select(key).orderBy(F.desc(key))
    return inside.limit(rest).agg(F.min(key)).first()[0]


def joint_cut(good: np.ndarray, toxic: np.ndarray, settings: Settings = Settings()) -> float | None:
    """The cut that keeps the share ``keep_target`` of the ``good`` keys, raised until at most ``most_toxic`` of the
    ``toxic`` ones pass, as far as ``least_target`` of the good ones stay."""
    if not len(good):
        return None
    cut, highest = (float(np.quantile(good, 1 - share)) for share in (settings.keep_target, settings.least_target))
    allowed = int(settings.most_toxic * len(toxic))
    if len(toxic) > allowed:
        cut = max(cut, min(highest, float(np.nextafter(np.sort(toxic)[-1 - allowed], np.inf))))
    return cut


def resample(
    docs: DataFrame, labels: DataFrame, good: Column, k: int | None = None, seed: int = 7, settings: Settings = Settings()
) -> tuple[DataFrame, np.ndarray, float | None]:
    """(doc_id, log_weight, key, selected) of every document, the model, and the least key kept.

    ``good`` says of a row of ``labels`` (doc_id, ...) whether its document is
    target text. k is the sample's size; by default it is the number of
    documents whose key reaches the cut that the labelled target and the labelled toxic documents that were
    held out of the fit set together (``joint_cut``). A ``labels``
    column ``toxic`` (1) names the toxic ones; without it there is no toxic model. Documents without words (null, empty, blank) are never
    selected. Rows that repeat an id share its draw; keys that tie at the cut
    are all kept. Without labelled target documents nothing is known: every
    ratio is even and all documents with words stay.
    """
    store = Store(docs.sparkSession, "importance")
    ids, is_good, is_toxic = labelled_sample(labels, good, settings.most_labels)
    # A quarter of the sample is not fitted on: it shows what unseen target and toxic text scores.
    apart = (ids.astype(np.uint64) * _MIX >> np.uint64(62)) == 0
    part = lambda kind, side: kind & side if (kind & side).any() else kind
    fitted, held = part(is_good, ~apart), part(is_good, apart)
    harmful, unseen = part(is_toxic, ~apart), part(is_toxic, apart)
    ratios = fit(docs, ids[fitted], ids[harmful], settings) if is_good.any() else np.zeros((2, 1 << BITS), np.float32)
    scored = score(docs.select("doc_id", "text"), ratios, settings).select("doc_id", "log_weight")
    scored = store.save(scored.withColumn("key", F.col("log_weight") + gumbel(seed)), "keys")
    cut: float | None = None
    if k is None and is_good.any():
        rows = [(int(i), bool(g)) for i, g, h in zip(ids, held, held | unseen, strict=True) if h]
        wanted = docs.sparkSession.createDataFrame(rows, "doc_id bigint, good boolean")
        known = scored.filter("key is not null").join(wanted, "doc_id").groupBy("doc_id", "good").agg(F.min("key").alias("key")).toPandas()
        is_held = known["good"].to_numpy(bool)
        least = joint_cut(known["key"].to_numpy()[is_held], known["key"].to_numpy()[~is_held], settings)
        k = scored.filter(F.col("key") >= least).count() if least is not None else None
    if k:
        cut = kth_largest(scored, "key", k)
    chosen = F.col("key").isNotNull() & (F.lit(True) if cut is None else F.col("key") >= cut)
    return scored.withColumn("selected", chosen), ratios, cut


def keep(docs: DataFrame, labels: DataFrame, good: Column, seed: int = 7, settings: Settings = Settings()) -> DataFrame:
    """The selected rows of ``docs``, in its own columns, whatever their names."""
    _, ratios, cut = resample(docs, labels, good, None, seed, settings)
    (weight,) = fresh(docs, "log_weight")
    scored = score(docs, ratios, settings, weight)
    chosen = F.col(weight).isNotNull()
    if cut is not None:
        chosen &= F.col(weight) + gumbel(seed) >= cut
    return scored.filter(chosen).select([F.col(f"`{c}`") for c in docs.columns])
