"""Jaccard join of word n-gram sets through prefix trees.

Sets are stored in one global order: rare n-grams first, as a 64-bit key made of a
frequency level (from a counting sketch over all texts) and the n-gram's hash.

1. Equal sets collapse into classes; only class representatives are compared.
2. Two sets over the threshold share a key among their rarest few (the prefix), so
   the prefixes cut the corpus into blocks. Within each block everyone is first
   paired with one leader, which is linear in the block, and verified links are
   turned into components.
3. Blocks of more than two that still hold several components pair the sets of different
   components, and only those that were not compared before. Every pair over the threshold is therefore either
   verified or already inside one component, so no link between components is lost
   and no group is expanded into all its pairs.
4. Pairs whose counts of n-grams by hash class rule out enough overlap go no further.
5. Verification puts bounded chunks of candidate sets, read from the frequent end,
   into a prefix tree. A query walks the tree: overlaps along a shared path are
   counted once, and a subtree is left as soon as the misses so far rule out
   every size it could still reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import SHARE, fold, share
from barloom.llm.components import connected_components
from barloom.llm.words import batch_word_hashes, mix, shingle_set, text_slices
from barloom.session import materialize

SKETCH_BITS = 22
BLOOM_BITS = 23
CHUNK_SETS = 256
CLASSES = 64
STEP = 64


# --- sizes ---------------------------------------------------------------------
class Threshold:
    """Jaccard >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int = 100):
        if not 0 < num <= den:
            raise ValueError("the threshold lies in (0, 1]")
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least intersection of linked sets of these sizes."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def least_partner(self, n):
        return -((-self.num * n) // self.den)

    def prefix(self, n):
        return n - self.least_partner(n) + 1


# --- the global order ------------------------------------------------------------
def _sketch_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def ordered_keys(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Ascending keys: 6 bits of frequency level, then 58 bits of the hash."""
    level = levels[_sketch_slot(hashes)].astype(np.uint64)
    return np.sort((level << np.uint64(58)) | (hashes >> np.uint64(6)))


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """Two levels per doubling of the count, piece by piece."""
    levels = np.empty(len(counts), dtype=np.uint8)
    for at in range(0, len(counts), 1 << 16):
        piece = np.maximum(counts[at : at + (1 << 16)], 1)
        levels[at : at + len(piece)] = np.minimum(63, np.floor(2 * np.log2(piece)))
    return levels


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """Size, digest and counts by hash class of every set, and each task's share of the counting sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for frame in text_slices(frames):
            sizes, digests, counted = [], [], []
            for words in batch_word_hashes(frame["text"]):
                keys = shingle_set(words, width)
                sizes.append(len(keys))
                digests.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest() if len(keys) else None)
                np.add.at(counts, _sketch_slot(keys), 1)
                counted.append(np.bincount((keys >> np.uint64(58)).astype(np.int64), minlength=CLASSES))
            yield pd.DataFrame(
                {"doc": frame["doc"], "n": sizes, "digest": digests, "classes": counted, "part": None, "data": None}
            )
        columns = ["doc", "n", "digest", "classes", "part", "data"]
        yield share(counts).assign(doc=None, n=None, digest=None, classes=None)[columns]

    return docs.mapInPandas(run, f"doc bigint, n bigint, digest binary, classes array<int>, {SHARE}")


def _add_capped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a > ~b, np.uint32(0xFFFFFFFF), a + b)


def _levels(profile: DataFrame) -> np.ndarray:
    return fold(profile.where("part is not null"), np.uint32, 1 << SKETCH_BITS, _add_capped, finish=frequency_levels)


# --- blocks ----------------------------------------------------------------------
def _prefixes(docs: DataFrame, width: int, limit: Threshold, levels) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(frames):
            keys, ids, sizes, places = [], [], [], []
            for doc, words in zip(frame["doc"].to_numpy(), batch_word_hashes(frame["text"])):
                ordered = ordered_keys(shingle_set(words, width), levels.value)
                if not len(ordered):
                    continue
                head = limit.prefix(len(ordered))
                keys.append(ordered[:head].view(np.int64))
                ids.append(np.full(head, doc))
                sizes.append(np.full(head, len(ordered), dtype=np.int32))
                places.append(np.arange(head, dtype=np.int32))
            if keys:
                yield pd.DataFrame(
                    {
                        "key": np.concatenate(keys),
                        "doc": np.concatenate(ids),
                        "n": np.concatenate(sizes),
                        "place": np.concatenate(places),
                    }
                )

    return docs.mapInPandas(run, "key bigint, doc bigint, n int, place int")


def _may_link(a, b, reach, limit: Threshold):
    """Sizes fit, and ``reach`` common keys are enough."""
    need = F.ceil(F.lit(limit.num) * (a + b) / (limit.num + limit.den))
    return (a * limit.num <= b * limit.den) & (b * limit.num <= a * limit.den) & (reach >= need)


def _leader_pairs(blocks: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
    """(query, target): everyone in a block against the block's leader of like size, if they may link.

    A block of two is settled by its one pair, whatever the sizes.
    """
    band = F.floor(F.log(F.col("n").cast("double")) * 8)
    band = F.when(F.col("members") == 2, -1).otherwise(band).alias("band")
    rows = blocks.select("key", band, "doc", "n", (F.col("n") - F.col("place")).alias("reach"))
    leaders = rows.groupBy("key", "band").agg(
        F.min(F.struct("doc", "n", "reach")).alias("leader"), F.count(F.lit(1)).alias("members")
    )
    both = F.least("reach", F.col("leader.reach"))
    pairs = (
        rows.join(leaders.where("members > 1").drop("members"), ["key", "band"])
        .where(F.col("doc") != F.col("leader.doc"))
        .where(_may_link(F.col("n"), F.col("leader.n"), both, limit))
        .select(F.col("leader.doc").alias("query"), F.col("doc").alias("target"))
        .distinct()
    )
    for end in ("query", "target"):
        names = classes.select(F.col("doc").alias(end), F.col("rep"))
        pairs = pairs.join(names, end).drop(end).withColumnRenamed("rep", end)
    return pairs.where("query != target").select("query", "target").distinct()


def _plausible(pairs: DataFrame, sizes: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs whose sets may share enough: no more than the smaller count of each hash class."""
    for end in ("query", "target"):
        own = sizes.select(F.col("doc").alias(end), F.col("n").alias(f"{end}_n"), F.col("classes").alias(f"{end}_classes"))
        pairs = pairs.join(own, end)
    least = F.zip_with("query_classes", "target_classes", lambda a, b: F.least(a, b))
    most = F.aggregate(least, F.lit(0), lambda a, b: a + b)
    need = F.ceil(F.lit(limit.num) * (F.col("query_n") + F.col("target_n")) / (limit.num + limit.den))
    kept = pairs.where(most >= need)
    return kept.drop(*[f"{end}_{c}" for end in ("query", "target") for c in ("n", "classes")]).distinct()


def _cross_pairs(blocks: DataFrame, labels: DataFrame, limit: Threshold) -> DataFrame:
    """(query, target, place) of representatives that share a block, may link and lie in different components.

    Components of a block meet first, by the range of their members' sizes; members
    of a component never meet each other. ``place`` is the target's component.
    """
    members = blocks.join(labels, "doc").select(
        "key", "doc", "n", (F.col("n") - F.col("place")).alias("reach"), "component"
    )
    inside = members.groupBy("key", "component").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("reach")
    )
    one, two = inside.alias("one"), inside.alias("two")
    need = F.ceil(F.lit(limit.num) * (F.col("one.lo") + F.col("two.lo")) / (limit.num + limit.den))
    meet = one.join(
        two,
        (F.col("one.key") == F.col("two.key"))
        & (F.col("one.component") < F.col("two.component"))
        & (F.col("one.lo") * limit.num <= F.col("two.hi") * limit.den)
        & (F.col("two.lo") * limit.num <= F.col("one.hi") * limit.den)
        & (F.least("one.reach", "two.reach") >= need),
    ).select(
        F.col("one.key").alias("key"),
        F.col("one.component").alias("left_component"),
        F.col("two.component").alias("right_component"),
    )
    left = members.select(
        "key", F.col("component").alias("left_component"), F.col("doc").alias("query"),
        F.col("n").alias("a"), F.col("reach").alias("left_reach"),
    )
    right = members.select(
        "key", F.col("component").alias("right_component"), F.col("doc").alias("target"),
        F.col("n").alias("b"), F.col("reach").alias("right_reach"),
    )
    both = F.least("left_reach", "right_reach")
    return (
        meet.join(left, ["key", "left_component"])
        .join(right, ["key", "right_component"])
        .where(_may_link(F.col("a"), F.col("b"), both, limit))
        .select("query", "target", F.col("right_component").alias("place"))
        .distinct()
    )


# --- verification ------------------------------------------------------------------
class PrefixTree:
    """Ordered sets as root-to-leaf paths; frequent keys stand near the root.

    The paths lie next to each other in lexicographic order together with the
    length each shares with the one before, which is a depth-first walk of the tree.
    """

    def __init__(self, sets: list[np.ndarray]):
        paths = [s[::-1] for s in sets]
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])
        self.shared = [0]
        for before, path in zip(self.paths, self.paths[1:]):
            m = min(len(before), len(path))
            differ = np.flatnonzero(before[:m] != path[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def search(self, query: np.ndarray, limit: Threshold) -> list[tuple[int, int]]:
        """(index of the set, overlap) of every set linked with ``query`` (ascending keys)."""
        n = len(query)
        low, high = limit.least_partner(n), n * limit.den // limit.num
        fits = self.sizes[(self.sizes >= low) & (self.sizes <= high)]
        if not len(fits):
            return []
        largest, smallest = int(fits.max()), int(fits.min())
        path_misses = largest - limit.overlap(n, largest)
        query_misses = n - limit.overlap(n, smallest)
        found = []
        overlap = np.zeros(int(self.sizes.max()) + 1, dtype=np.int64)
        known, dead = 0, None
        for at, (path, shared) in enumerate(zip(self.paths, self.shared)):
            known = min(known, shared)
            if dead is not None and shared >= dead:
                continue
            dead = None
            while known < len(path):
                piece = path[known : known + STEP]
                place = np.searchsorted(query, piece)
                hit = (place < n) & (query[np.minimum(place, n - 1)] == piece)
                overlap[known + 1 : known + 1 + len(piece)] = overlap[known] + np.cumsum(hit)
                known += len(piece)
                passed = n - int(place[-1]) - int(hit[-1])
                have = int(overlap[known])
                if known - have > path_misses or passed - have > query_misses:
                    dead = known
                    break
            else:
                size = len(path)
                if low <= size <= high and overlap[size] >= limit.overlap(n, size):
                    found.append((self.order[at], int(overlap[size])))
        return found


def _bloom_slots(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1))
    size = np.uint64((1 << BLOOM_BITS) - 1)
    return [((h >> np.uint64(s)) & size).astype(np.int64) for s in (0, 20, 40)]


def _bloom(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that lets every given id pass (and, if it is full, others too)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for frame in frames:
            for slots in _bloom_slots(frame["doc"].to_numpy()):
                bits[slots] = True
        yield share(np.packbits(bits))

    shares = ids.select("doc").mapInPandas(run, SHARE)
    return fold(shares, np.uint8, (1 << BLOOM_BITS) // 8, np.bitwise_or)


def _sets_of(docs: DataFrame, width: int, levels, wanted: DataFrame) -> DataFrame:
    """Ordered sets of (at least) the wanted documents."""
    passes = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(frames):
            keep = np.ones(len(frame), dtype=bool)
            for slots in _bloom_slots(frame["doc"].to_numpy()):
                keep &= (passes.value[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool)
            frame = frame[keep]
            sets = [
                ordered_keys(shingle_set(words, width), levels.value).tobytes()
                for words in batch_word_hashes(frame["text"])
            ]
            yield pd.DataFrame({"doc": frame["doc"].to_numpy(), "keys": sets})

    return docs.mapInPandas(run, "doc bigint, keys binary")


def _walk(limit: Threshold):
    """Rows arrive sorted by chunk, targets before queries; one tree is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, ids, sets, tree = None, [], [], None
        for frame in frames:
            out = []
            for at, doc, is_query, keys in zip(frame["chunk"], frame["doc"], frame["is_query"], frame["keys"]):
                if at != chunk:
                    chunk, ids, sets, tree = at, [], [], None
                values = np.frombuffer(keys, dtype=np.uint64)
                if not is_query:
                    ids.append(doc)
                    sets.append(values)
                    continue
                tree = tree or PrefixTree(sets)
                out += [(doc, ids[i], o) for i, o in tree.search(values, limit) if ids[i] != doc]
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "overlap"])

    return run


def verify_pairs(docs: DataFrame, pairs: DataFrame, group: str, width: int, limit: Threshold, levels) -> DataFrame:
    """Links (a, b, overlap) among candidate pairs (query, target, ``group``).

    Targets of one group are dealt over chunks of about ``CHUNK_SETS``; a query goes
    to the chunks that hold a candidate of it.
    """
    targets = pairs.select(F.col(group).alias("g"), F.col("target")).distinct()
    many = targets.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).alias("chunks"))
    dealt = pairs.select(F.col(group).alias("g"), "query", "target").join(many, "g")
    chunk = F.xxhash64("g", F.pmod(F.xxhash64("target"), F.col("chunks")))
    dealt = materialize(dealt.select(chunk.alias("chunk"), "query", "target"), "dealt")
    roles = (
        dealt.select("chunk", F.col("target").alias("doc"), F.lit(False).alias("is_query"))
        .unionByName(dealt.select("chunk", F.col("query").alias("doc"), F.lit(True).alias("is_query")))
        .distinct()
    )
    wanted = roles.select("doc").distinct()
    sets = _sets_of(docs, width, levels, wanted)
    placed = roles.join(sets, "doc").select("chunk", "is_query", "doc", "keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = placed.repartition(parts, "chunk").sortWithinPartitions("chunk", "is_query")
    return ready.mapInPandas(_walk(limit), "a bigint, b bigint, overlap bigint")


# --- the join ------------------------------------------------------------------------
def link_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    num: int = 90,
    den: int = 100,
) -> DataFrame:
    """Size of every document's n-gram set and the component its links put it in.

    Returns one row (``id_col``, n_shingles, component_id) per input row. Two
    documents link when ``den`` * intersection >= ``num`` * union of their sets of
    ``width``-word n-grams; a shorter text is one n-gram as a whole. Null and
    empty texts have size 0 and link with nothing. Rows with a null id keep a null
    component and link with nothing. Rows that repeat an id are the same document,
    whose set is that of each of its rows: their links are pooled. Other columns are ignored.
    An empty table gives an empty result. Any size of a group of copies is complete.
    """
    spark = docs.sparkSession
    limit = Threshold(num, den)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    named = texts.where("doc is not null")
    profile = materialize(_profile(named, width), "profile")
    levels = spark.sparkContext.broadcast(_levels(profile))
    sizes = profile.where("part is null").select("doc", "n", "digest", "classes")
    reps = sizes.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"))
    classes = materialize(sizes.where("n > 0").join(reps, "digest").select("doc", "rep").distinct(), "classes")

    rows = materialize(_prefixes(named, width, limit, levels), "prefixes")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = materialize(rows.join(shared, "key"), "blocks")

    known = classes.where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    pairs = materialize(_leader_pairs(blocks, classes, limit), "leader-pairs")
    likely = materialize(_plausible(pairs, sizes, limit), "likely-pairs")
    if not likely.isEmpty():
        checked = materialize(verify_pairs(named, likely, "query", width, limit, levels), "links")
        known = known.unionByName(checked.select("a", "b"))
    labels = connected_components(known, "a", "b")
    found = labels.withColumnRenamed("node", "doc")
    of_rep = classes.where("doc = rep").select("doc").join(found, "doc", "left")
    of_rep = of_rep.select("doc", F.coalesce("component", "doc").alias("component"))
    done = pairs.select(F.least("query", "target").alias("x"), F.greatest("query", "target").alias("y"))
    rest = _cross_pairs(blocks.where("members > 2"), of_rep, limit)
    tested = (F.least("query", "target") == F.col("x")) & (F.greatest("query", "target") == F.col("y"))
    rest = materialize(_plausible(rest.join(done, tested, "left_anti"), sizes, limit), "cross-pairs")
    if not rest.isEmpty():
        checked = materialize(verify_pairs(named, rest, "place", width, limit, levels), "links")
        # What is linked already hangs on its component, so only the new links take rounds.
        known = found.select(F.col("doc").alias("a"), F.col("component").alias("b"))
        labels = connected_components(known.unionByName(checked.select("a", "b")), "a", "b")
    return (
        sizes.select("doc", "n")
        .join(labels.withColumnRenamed("node", "doc"), "doc", "left")
        .select(
            F.col("doc").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "doc").alias("component_id"),
        )
        .unionByName(_unnamed(texts, width, id_col))
    )


def _unnamed(texts: DataFrame, width: int, id_col: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(frames):
            sizes = [len(shingle_set(w, width)) for w in batch_word_hashes(frame["text"])]
            yield pd.DataFrame({"doc": None, "n": sizes, "c": None})

    rows = texts.where("doc is null").mapInPandas(run, "doc bigint, n bigint, c bigint")
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
