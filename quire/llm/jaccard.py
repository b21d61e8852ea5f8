"""Exact Jaccard join of shingle sets by partitioning the universe.

Shingle hashes are cut into segments, ranges of the hash space, whose number
depends on a band of set sizes. Two sets within the allowed difference H
that are laid over more than H segments agree in one of them (pigeonhole).
Each set therefore emits one signature per segment; bands of small sets may
use half as many segments and allow one deletion in each instead. Signatures
that are frequent cost most, so each set skips a number of them that the
surplus of segments allows. Candidates are verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store, fresh, row_key

_ROLL, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_FALSE_MATCH_COST = 100
_KNOWN = 1 << 16
STAR_ROUNDS = 6
FEW = 24
#: A class settles under a signature when it differs from the hub by at most so many times what similar sets can.
REACH = 4
#: Signatures are settled pair by pair as soon as they hold so many classes on average, as a class sees it.
DIRECT = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _END
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` - 1 elements; ``segments`` to lay them over, ``spare`` of
    which a set may skip, ``deletions`` whether one element may be missing in each."""

    number: int
    low: int
    high: int
    segments: int
    spare: int
    deletions: bool


@dataclass
class Plan:
    """Bands for a similarity of ``percent`` / 100, made as sizes come up."""

    percent: int
    bands: list[Band] = field(default_factory=list)

    @property
    def growth(self) -> float:
        """High over low end of a band: similar sets then lie in the same band or in neighbouring ones."""
        return max(1.25, 100 / self.percent)

    def band(self, size: int) -> Band:
        while not self.bands or self.bands[-1].high <= size:
            low = self.bands[-1].high if self.bands else 1
            high = max(low + 1, int(low * self.growth))
            self.bands.append(self._allocate(len(self.bands), low, high))
        return next(b for b in reversed(self.bands) if b.low <= size)

    def _allocate(self, number: int, low: int, high: int) -> Band:
        """Signatures to emit plus the cost of segments that agree by chance (with hardly any element) decide."""
        differ = (100 - self.percent) * 2 * (high - 1) // (100 + self.percent)
        if not differ:
            return Band(number, low, high, 0, 0, False)
        size = (low * high) ** 0.5
        spare = np.unique(np.geomspace(1, differ + 1, 64).astype(np.int64))
        exact = differ + 1 + spare
        # empty segments, and about as many with one common element, agree by chance: a set skips
        # ``spare`` of them, and what is left over is bounded by the tail of a Poisson count
        chance = 2 * exact * np.exp(-size / exact)
        over = np.where(chance < spare, np.exp(spare - chance + spare * np.log(chance / spare)), 1.0)
        exact_cost = exact + _FALSE_MATCH_COST * chance * over
        best = int(np.argmin(exact_cost))
        halved = -(-(differ + 1) // 2)
        halved_cost = halved + size + _FALSE_MATCH_COST * halved * np.exp(-size / halved) * (1 + size / halved)
        if halved_cost < exact_cost[best]:
            return Band(number, low, high, halved, 0, True)
        return Band(number, low, high, int(exact[best]), int(spare[best]), False)

    def uses(self, size: int) -> list[Band]:
        """The set's own band, and the next one if a similar set can lie there."""
        own = self.band(size)
        after = self.band(own.high)
        return [own, after] if size * 100 // self.percent >= own.high else [own]


def signatures(items: np.ndarray, plan: Plan) -> np.ndarray:
    """Signatures of a sorted set of hashes; their low six bits are the band."""
    out = []
    tokens = _mix(items * _ROLL)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens, dtype=np.uint64)])
    for band in plan.uses(len(items)):
        m = band.segments
        if not m:
            continue
        bounds = np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)
        starts = np.concatenate([[0], np.searchsorted(items, bounds), [len(items)]])
        counts = np.diff(starts)
        contents = sums[starts[1:]] - sums[starts[:-1]]
        places = np.arange(m)
        if band.deletions:
            places = np.concatenate([places, np.repeat(places, counts)])
            contents = np.concatenate([contents, contents[places[m:]] - tokens])
            counts = np.concatenate([counts, counts[places[m:]] - 1])
        where = (np.uint64(band.number) << np.uint64(32)) + places.astype(np.uint64)
        found = _mix(_mix(contents + where * _ROLL) + counts.astype(np.uint64) * _END)
        out.append((found & ~np.uint64(63)) | np.uint64(band.number & 63))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; word hashes are kept, up to a bound."""

    def __init__(self, width: int, most: int = 1 << 16):
        self.width, self.most = width, most
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z only, and white space is 20 and 09 to 0D
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) >= self.most:
            self.known.clear()
        known = self.known
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        rolled = np.full(n, width, np.uint64)
        for i in range(width):
            rolled = _mix(rolled * _ROLL + hashed[i : i + n])
        return np.unique(rolled)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _some(texts: list[bytes | None], most: int = 1 << 22) -> Iterator[list[bytes | None]]:
    """``texts`` in turn, at most about ``most`` bytes of them at once."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= most or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, held = i + 1, 0


def profile(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """(k, doc_id, n, name, cls, sigs): row key, size, 128-bit name and 64-bit class of each document's set, and its signatures.

    A task gives the signatures of a class once, not again for its copies (it knows the last ``_KNOWN`` classes), so
    a crowd of copies counts under its signatures as often as there are tasks.
    """
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    names = ["k", "doc_id", "n", "name", "cls", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, plan, seen = Shingler(width), Plan(percent), set()
        for batch in batches:
            at = 0
            for texts in _some(_texts(batch.column(2))):
                rows = []
                for key, doc_id, text in zip(batch.column(0)[at:].to_pylist(), batch.column(1)[at:].to_pylist(), texts, strict=False):
                    items = shingle(text)
                    if not len(items):
                        rows.append((key, doc_id, 0, None, None, []))
                        continue
                    name, cls = _names(items, seed)
                    rows.append((key, doc_id, len(items), name, cls, [] if cls in seen else signatures(items, plan).view(np.int64)))
                    if len(seen) >= _KNOWN:
                        seen.clear()
                    seen.add(cls)
                at += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "k binary, doc_id bigint, n bigint, name binary, cls bigint, sigs array<bigint>")


def _names(items: np.ndarray, seed: int) -> tuple[bytes, int]:
    digest = hashlib.blake2b(items.tobytes(), digest_size=24, salt=seed.to_bytes(8, "little")).digest()
    return digest[:16], int.from_bytes(digest[16:], "little", signed=True)


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in 4 to 8 places an element, as 64-bit words."""
    places = max(256, 1 << (4 * len(items) - 1).bit_length())
    odd = np.bincount((_mix(items) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets: each of its elements turns one parity."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.unpackbits((x ^ y).view(np.uint8)).sum())


def _sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(cls, size, bits, items) of documents: ``bits`` is the set's sketch."""
    words = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int32(), words, words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for texts in _some(_texts(batch.column(0)), 1 << 20):
                some = [(_names(x, seed)[1], len(x), sketch(x), x.view(np.int64)) for x in map(shingle, texts) if len(x)]
                if some:
                    columns = [pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["cls", "size", "bits", "items"])

    return docs.select("text").mapInArrow(run, "cls bigint, size int, bits array<bigint>, items array<bigint>")


def components(edges: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """``labels`` (cls, comp) with the components that ``edges`` (a, b; ends are comps) join made one.

    Each round every component points to its smallest neighbour, if smaller than
    itself, pointers are shortened once, and the edges are relabelled; hubs cost no
    more than their edges, as minima are taken before the shuffle.
    """
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a")
        further = point.select(F.col("a").alias("b"), F.col("b").alias("c"))
        point = store.save(point.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("to")), f"point{turn}")
        renamed = lambda df, c: df.join(point.withColumnRenamed("a", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = store.save(renamed(labels, "comp"), f"labels{turn}")
        edges = renamed(renamed(edges, "a"), "b").filter("a <> b").select("a", "b").distinct()
        edges = store.save(edges, f"edges{turn}")
    return labels


def _with_sets(pairs: DataFrame, sets: DataFrame, column: str, store: Store) -> tuple[DataFrame, DataFrame]:
    """Stored ``pairs`` with ``column`` of hub and class as x and y, and the hubs' rows, for dropping.

    ``sets`` lies in buckets of its key and is not shuffled. The hubs' rows are stored
    apart, once each, so that adaptive execution can split the pairs of a hot hub.
    """
    one = sets.select(F.col("cls").alias("hub"), F.col("size").alias("hub_size"), F.col(column).alias("x"))
    hubs = store.save(pairs.select("hub").distinct().join(one, "hub"), "hubs")
    return pairs.select("hub", "cls").join(sets.select("cls", "size", F.col(column).alias("y")), "cls").join(hubs, "hub"), hubs


def _outline(pairs: DataFrame) -> DataFrame:
    """Pairs (hub, cls, hub_size, size) with ``least``, what they differ by at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([v.values.to_numpy() for v in batch.column(name)] for name in ("x", "y"))
            least = pa.array([least_difference(a, b) for a, b in zip(x, y, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("hub", "cls", "hub_size", "size")], least], ["hub", "cls", "hub_size", "size", "least"])

    rows = pairs.select("hub", "cls", "hub_size", "size", "x", "y")
    return rows.mapInArrow(run, "hub bigint, cls bigint, hub_size int, size int, least int")


def _most(size: Column, percent: int) -> Column:
    """What a set of so many elements can differ by from a similar one."""
    return F.floor((100 - percent) * size / percent).cast("int")


def _limit(size: Column, percent: int, reach: int) -> Column:
    """Greatest difference from a hub of a set whose similar set, of any size, lies within ``reach`` times its own ``_most``."""
    return reach * _most(F.floor(100 * size / percent), percent) + _most(size, percent)


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, store: Store, name: str, reach: int = 0) -> DataFrame:
    """Pairs (hub, cls) with ``differ``, the size of their symmetric difference, ``linked`` and the difference
    ``most`` that a set similar to cls can have; with ``reach``, ``diff`` is the difference where it may matter.

    Sketches come first: pairs that they tell apart keep ``differ`` as a lower bound, and their sets are not read.
    """
    most = _most(F.col("size"), percent)
    far = (100 + percent) * F.col("least") > (100 - percent) * (F.col("hub_size") + F.col("size"))
    limit = _limit(F.col("size"), percent, reach)
    if reach:
        far &= F.col("least") > limit
    pairs = store.save(pairs, f"pairs-{name}")
    sketched, hubs = _with_sets(pairs, sets, "bits", store)
    outlined = store.save(_outline(sketched).withColumn("far", far), f"outlined-{name}")
    store.drop(hubs)
    joined, hubs = _with_sets(outlined.filter(~F.col("far")), sets, "items", store)
    joined = joined.withColumn("both", F.size(F.array_intersect("x", "y")))
    union = F.col("hub_size") + F.col("size") - F.col("both")
    joined = joined.withColumns({"differ": union - F.col("both"), "linked": 100 * F.col("both") >= percent * union, "most": most})
    none = F.lit(None).cast("array<bigint>")
    diff = F.when(F.col("differ") <= limit, F.array_union(F.array_except("x", "y"), F.array_except("y", "x"))) if reach else none
    near = joined.select("hub", "cls", "differ", "linked", "most", diff.alias("diff"))
    apart = outlined.filter("far").select("hub", "cls", F.col("least").alias("differ"), F.lit(False).alias("linked"), most.alias("most"), none.alias("diff"))
    met = store.save(near.unionByName(apart), name)
    store.drop(pairs, outlined, hubs)
    store.release()
    return met


def link(docs: DataFrame, width: int = 5, percent: int = 80, store: Store | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII white space; a text of fewer
    words than ``width`` is one shingle; without words, or null, a document has
    none and stands alone. Documents link when their shingle sets share at least
    ``percent`` of their union; component_id is the smallest doc_id within reach.
    Every row is a document, also those that share an id; null ids are passed over by
    the smallest, so it is null only where all ids within reach are. Columns besides doc_id and
    text are not read; an empty table has no rows.
    """
    labelled = _labelled(docs, width, percent, store or Store(docs.sparkSession, "jaccard"))
    return labelled.select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, width: int, percent: int, store: Store) -> DataFrame:
    """(k, doc_id, n_shingles, comp, component_id): a row per document; ``comp`` is null where it has no words.

    Documents with equal sets are one class from the start (named by 128 bits; the
    64-bit class ids are checked for collisions and drawn anew if there are
    any). Pairs of classes that share a signature are settled by ``_connect``
    in rounds that are linear in the size of a group, and no link is lost.
    """
    docs = docs.select("doc_id", "text")
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("head")
    for seed in range(8):
        rows = store.save(profile(docs, width, percent, seed), "profiles")
        classes = rows.filter("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first"), F.first("n").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"), head
        )
        classes = store.save(classes.withColumn("k", F.col("head.k")).drop("head"), "classes")
        if classes.filter("low <> high").isEmpty():
            break
    shared = _shared_signatures(rows, percent, store)
    plain = store.save(rows.select("k", "doc_id", F.col("n").alias("n_shingles"), "cls"), "sizes")
    store.drop(rows)
    store.release()
    labels = classes.join(shared.select("cls").distinct(), "cls").select("cls", "n", F.col("cls").alias("comp"))
    heads = labels.select("cls").join(classes, "cls").select(F.col("k").alias("head"))
    keyed = docs.withColumn("head", row_key(F.col("doc_id"), F.col("text")))
    sets = _sets(keyed.join(heads, "head", "left_semi"), width, seed).dropDuplicates(["cls"])
    sets = store.save_buckets(sets, "sets", "cls")
    store.release()
    labels = _connect(shared, store.save(labels, "labels"), sets, percent, store)
    store.drop_buckets()
    labels = labels.select("cls", "comp")
    named = classes.join(labels, "cls").groupBy("comp").agg(F.min("first").alias("component_id"))
    found = classes.select("cls", "first").join(labels, "cls", "left").join(named, "comp", "left")
    alone = F.col("comp").isNull()
    found = found.select("cls", F.coalesce("comp", "cls").alias("comp"), F.when(alone, F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    found = store.save(found, "components")
    empty = plain.filter("cls is null").select("k", "doc_id", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return plain.filter("cls is not null").join(found, "cls").select("k", "doc_id", "n_shingles", "comp", "component_id").unionByName(empty)


def _shared_signatures(rows: DataFrame, percent: int, store: Store) -> DataFrame:
    """(sig, cls, weight, probe): signatures that different classes share, where at least one of them probes.

    Of a set's signatures in a band the ``spare`` most frequent ones are not probed; they
    are still found by others' probes. ``weight`` counts the classes met by a class.
    """
    each = rows.filter("cls is not null").select(F.explode("sigs").alias("sig"), "cls")
    here = Window.partitionBy("sig")
    met = each.withColumns({"low": F.min("cls").over(here), "high": F.max("cls").over(here)}).filter("low <> high")
    all_met = met = store.save(met.select("sig", "cls").distinct(), "met")
    store.release()
    sizes = met.groupBy("sig").agg(F.count("*").alias("times"))
    met = met.join(sizes, "sig")
    plan = Plan(percent)
    plan.band(1 << 30)
    spare = F.lit([b.spare for b in plan.bands[:64]])
    band = F.col("sig").bitwiseAND(F.lit(63)).cast("int")
    dear = F.row_number().over(Window.partitionBy("cls", band).orderBy(F.desc("times"), "sig"))
    met = met.withColumn("probe", dear > F.get(spare, band))
    met = met.withColumn("weight", F.sum("times").over(Window.partitionBy("cls")))
    met = store.save(met, "probes")
    probed = met.filter("probe").select("sig").distinct()
    kept = store.save(met.join(probed, "sig", "left_semi").select("sig", "cls", "weight", "probe"), "shared")
    store.drop(all_met, met)
    return kept


def _connect(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, store: Store) -> DataFrame:
    """Final labels (cls, n, comp) of the classes in ``shared``.

    In a round, signatures that still join different components of at most ``FEW``
    classes are settled pair by pair; pairs that were compared before, or whose sizes rule a
    link out, are left away. Of larger signatures all classes are compared with one
    of them, the hub. A class whose difference from the hub is small (``REACH``
    times what two similar sets can differ) needs no comparison with the
    others: a similar one lies in the hub's neighbourhood too, and their
    differences from the hub then share elements. Those elements, the rarest
    first and as many as the prefix filter asks for, become signatures of the
    next round; classes far from the hub stay under their signature. So thousands of
    variants of one text do not cost a comparison a pair. What ``STAR_ROUNDS``
    leave is compared pair by pair, and before that as soon as a row of ``live`` meets ``DIRECT`` others
    at most, on average: further rounds would compare more than is left. The first round compares with hubs only.
    """
    live, tested = shared, None
    for turn in range(STAR_ROUNDS + 1):
        live = store.save(_unsettled(live.join(labels, "cls")), f"live{turn}")
        store.release()
        if live.isEmpty():
            break
        if turn:
            last = turn == STAR_ROUNDS or turn > 1 and live.agg(F.avg("members")).first()[0] <= DIRECT
            few = live if last else live.filter(F.col("members") <= FEW)
            other = few.select("sig", *[F.col(c).alias(f"other_{c}") for c in ("cls", "comp", "probe", "n", "weight")])
            alike = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
            alike &= (100 + percent) * _apart("weight", "other_weight") <= (100 - percent) * (F.col("n") + F.col("other_n"))
            pairs = few.join(other, "sig").filter(alike & F.expr("cls < other_cls and comp <> other_comp and (probe or other_probe)"))
            pairs = pairs.select("cls", F.col("other_cls").alias("hub")).distinct().join(tested, ["cls", "hub"], "left_anti")
            met = _compare(pairs, sets, percent, store, f"direct{turn}")
            labels = components(_links(met, labels, store), labels, store)
            if last:
                break
            tested = tested.unionByName(met.select("cls", "hub"))
            live = live.filter(F.col("members") > FEW)
        hub = F.max(F.struct("probe", "weight", "cls", "n")).alias("hub")
        columns = ["sig", "cls", "weight", "probe", "n", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n")]
        starred = live.join(live.groupBy("sig").agg(hub), "sig").select(columns)
        starred = store.save(starred.filter("cls <> hub"), f"starred{turn}")
        alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
        # at first only links count, and sizes rule some out
        pairs = (starred if turn else starred.filter(alike)).select("hub", "cls").distinct()
        met = _compare(pairs, sets, percent, store, f"met{turn}", REACH if turn else 0)
        labels = components(_links(met, labels, store), labels, store)
        seen = met.select(F.least("hub", "cls").alias("cls"), F.greatest("hub", "cls").alias("hub"))
        tested = seen if tested is None else tested.unionByName(seen)
        if turn == 0:
            live = starred.select("sig", "cls", "weight", "probe")
            continue
        far = met.filter(F.col("differ") > REACH * F.col("most")).select("hub", "cls")
        far = starred.join(far, ["hub", "cls"], "left_semi").select("sig", "cls", "weight", "probe")
        live = far.unionByName(_differences(met, labels, percent, store))
    return labels


def _apart(weight: str, other: str) -> Column:
    """Lower bound of what two classes under one signature differ by.

    Under a signature from differences, weights are the negative differences from the same hub.
    """
    both = (F.col(weight) < 0) & (F.col(other) < 0)
    return F.when(both, F.abs(F.col(weight) - F.col(other))).otherwise(0)


def _links(met: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """Edges (a, b) between the components of linked pairs."""
    edges = met.filter("linked").select("hub", "cls")
    edges = edges.join(labels.select(F.col("cls").alias("hub"), F.col("comp").alias("a")), "hub")
    edges = edges.join(labels.select("cls", F.col("comp").alias("b")), "cls")
    return store.save(edges.filter("a <> b").select("a", "b").distinct(), "links")


def _differences(met: DataFrame, labels: DataFrame, percent: int, store: Store) -> DataFrame:
    """Signatures (hub, element) of classes near a hub: elements of the prefix of their difference from it.

    Let x and y be similar, in different components, with differences dx and
    dy from the hub. One of them is not linked to the hub, say y, and then dx
    and dy share more than |dx| p / (100 + p) elements, and at least
    |dy| less what similar sets can differ. Either set's prefix follows. Of two differences
    the one that is not greater shares all but half of what similar sets can differ, so the first
    elements of its prefix suffice: these probe, and the others are only found.
    """
    near = met.filter("diff is not null").join(labels.select("cls", "comp"), "cls")
    mixed = near.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    near = near.join(mixed.select("hub"), "hub", "left_semi")
    rows = store.save(near.select("hub", "cls", "differ", "linked", "most", F.explode("diff").alias("e")), "differences")
    times = rows.groupBy("hub", "e").agg(F.count("*").alias("times"))
    rows = rows.join(times, ["hub", "e"])
    rank = F.row_number().over(Window.partitionBy("hub", "cls").orderBy("times", "e"))
    prefix = F.when(F.col("linked"), F.col("differ") - F.floor(F.col("differ") * percent / (100 + percent)))
    prefix = prefix.otherwise(F.least("differ", F.col("most") + 1))
    chosen = rows.withColumn("rank", rank).filter((F.col("rank") <= prefix) & (F.col("times") > 1))
    probe = F.col("rank") <= F.floor(F.col("most") / 2) + 1
    return chosen.select(F.xxhash64("hub", "e").alias("sig"), "cls", (-F.col("differ")).cast("long").alias("weight"), probe.alias("probe"))


def _unsettled(rows: DataFrame) -> DataFrame:
    """Rows of signatures that still join different components, with a probe among them; ``members`` counts them."""
    open_sigs = rows.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("probe").alias("any"), F.count("*").alias("members")
    )
    return rows.join(open_sigs.filter("low <> high and any").select("sig", "members"), "sig")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, store: Store | None = None) -> DataFrame:
    """``docs`` without all but one row of each group of linked documents.

    The row with the smallest doc_id stays (nulls last), of several the one with the smallest row
    key; of rows that repeat id and text one stays, chosen by a hash of all columns. Rows
    without words stay all. Rows are told apart by id and text, not by id alone.
    """
    store = store or Store(docs.sparkSession, "representatives")
    linked = store.save(_labelled(docs, width, percent, store).filter("comp is not null").select("k", "doc_id", "comp"), "labelled")
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("head")
    heads = linked.groupBy("comp").agg(head).select("comp", F.col("head.k").alias("head"))
    marked = linked.groupBy("k", "comp").agg(F.count("*").alias("times")).join(heads, "comp")
    marked = store.save(marked.filter("k <> head or times > 1").select("k", (F.col("k") != F.col("head")).alias("gone")), "marked")
    key, gone, place, mix = fresh(docs, "k", "gone", "place", "mix")
    keyed = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    marked = marked.withColumnsRenamed({"k": key, "gone": gone})
    single = keyed.join(marked.select(key), key, "left_anti").select(docs.columns)
    repeated = keyed.join(marked.filter(~F.col(gone)).select(key), key, "left_semi")
    repeated = repeated.withColumn(mix, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    one = repeated.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(mix)))
    return single.unionByName(one.filter(F.col(place) == 1).select(docs.columns))
