"""Near-duplicate vectors through inverted lists of product-quantised residuals.

Coarse centroids and subspace codebooks are fitted on a bounded sample; every
vector is then put into the list of its nearest centroid, as its vector, the codes
of its residual and the norm of its coding error. A query visits every list that could hold a
neighbour. There it reads asymmetric distances from lookup tables; since the true
distance is at least the table's distance minus the coding error, no neighbour is ruled
out by the codes. What remains is compared by exact cosine in double precision.

Lists are cut into blocks of bounded size, so a crowded list is shared by many tasks.
Links are counted per query and joined into local spanning stars where they are found;
pairs are never listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.sampling import collect_sample
from barloom.session import materialize

#: Vectors that the centroids and codebooks are fitted on, chosen by a hash.
SAMPLE_VECTORS = 20_000
MOST_LISTS = 8192
SUBSPACE_DIMS = 4
CODES = 256
ROUNDS = 8
BLOCK_VECTORS = 1024
QUERY_STEP = 256
PAIR_STEP = 1 << 15
#: How the offsets of neighbours spread is measured on so many sample vectors around a centroid,
#: along the planes to so many nearest centroids; this many deviations are allowed for.
AROUND_VECTORS = 64
AROUND_LISTS = 16
DEVIATIONS = 4.0
#: Sample vectors whose true neighbours in the sample are looked up to check the allowance.
CHECKED_VECTORS = 2048
#: The tables are single floats; distances near the radius are off by less than this.
TABLE_ERROR = 1e-4


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    half = (centers**2).sum(axis=1) / 2
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = np.argmin(half - points[at : at + 4096] @ centers.T, axis=1)
    return out


def _fit_centers(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(points, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        used = counts > 0
        centers[used] = sums[used] / counts[used, None]
        if (~used).any():
            centers[~used] = points[rng.choice(len(points), size=int((~used).sum()))]
    return centers


def _slack(sample: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Per list, the share of a neighbour's offset that may point towards another list.

    Vectors may vary along few directions, and along others elsewhere. So the offsets of the sample vectors
    around each centroid are projected on the directions to the next centroids; ``DEVIATIONS`` root mean squares of
    the widest are allowed for, and never less than offsets without preferred directions need. With 1, the
    bound holds whatever the offset.
    """
    squares = (centers**2).sum(axis=1)
    squared = (sample**2).sum(axis=1)
    out = np.ones(len(centers))
    for a, center in enumerate(centers):
        near = squared - 2 * sample @ center
        around = sample[np.argpartition(near, AROUND_VECTORS)[:AROUND_VECTORS]] if len(sample) > AROUND_VECTORS else sample
        offsets = around - around.mean(axis=0)
        lengths = np.linalg.norm(offsets, axis=1)
        offsets = offsets[lengths > 1e-6] / lengths[lengths > 1e-6, None]
        apart = squares - 2 * centers @ center
        towards = centers[np.argsort(apart)[1 : AROUND_LISTS + 1]] - center
        towards = towards / np.maximum(np.linalg.norm(towards, axis=1, keepdims=True), 1e-12)
        if len(offsets) >= 2 and len(towards):
            out[a] = DEVIATIONS * math.sqrt(((offsets @ towards.T) ** 2).mean(axis=0).max())
    return np.clip(out, min(1.0, DEVIATIONS / math.sqrt(sample.shape[1])), 1.0)


@dataclass
class Quantizer:
    centers: np.ndarray
    books: np.ndarray  # (subspace, code, dimension)
    radius: float
    slack: np.ndarray  # per list

    @property
    def dims(self) -> int:
        return self.centers.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, cosine: float) -> Quantizer:
        centers = _fit_centers(sample, lists, 1)
        rest = _fold(sample - centers[_nearest(sample, centers)])
        books = [_fit_centers(rest[:, m], CODES, 2 + m) for m in range(rest.shape[1])]
        books = [np.concatenate([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books]
        fitted = cls(centers, np.stack(books), math.sqrt(2 - 2 * cosine), _slack(sample, centers))
        fitted.slack = np.minimum(1.0, np.maximum(fitted.slack, fitted._needed(sample, cosine)))
        return fitted

    def _needed(self, sample: np.ndarray, cosine: float) -> float:
        """The largest slack that the links of some sample vectors to all others need."""
        asked, own, most = sample[:CHECKED_VECTORS], _nearest(sample, self.centers), 0.0
        for at in range(0, len(asked), QUERY_STEP):
            units = asked[at : at + QUERY_STEP]
            x, y = np.nonzero(units @ sample.T >= cosine)
            gap, apart = self._planes(units, own[at : at + QUERY_STEP])
            away = own[y] != own[at + x]
            x, lists = x[away], own[y[away]]
            need = gap[x, lists] / np.maximum(2 * self.radius * apart[x, lists], 1e-12)
            most = max(most, need.max(initial=0.0))
        return most

    def _planes(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list): how much nearer the own centroid is, in squares, and how far the two are apart."""
        c = self.centers
        squares = (c**2).sum(axis=1)
        d = squares - 2 * units @ c.T
        gap = d - np.take_along_axis(d, own[:, None], axis=1)
        apart = np.sqrt(np.maximum(0, squares + squares[own][:, None] - 2 * c[own] @ c.T))
        return gap, apart

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, norm of the coding error)."""
        own = _nearest(units, self.centers)
        rest = _fold(units - self.centers[own])
        codes = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(rest.shape[1])], axis=1)
        read = self.books[np.arange(codes.shape[1]), codes]
        error = np.sqrt(((rest - read) ** 2).sum(axis=(1, 2)))
        return own, codes.astype(np.uint8), error

    def probes(self, units: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(vector, list) mask of the lists to visit.

        A neighbour in list c lies beyond the plane between c and the query's own
        centroid, so the query is within ``radius`` of that plane. A neighbour's offset
        points along one of these directions by ``slack`` of its length at most; see ``_slack``.
        """
        gap, apart = self._planes(units, own)
        return gap <= 2 * self.radius * self.slack[own][:, None] * apart + 1e-9

    def tables(self, units: np.ndarray) -> np.ndarray:
        """(subspace, query, code): minus twice the products with the codebooks."""
        parts = _fold(units).transpose(1, 0, 2).astype(np.float32)
        return np.matmul(parts, self.books.transpose(0, 2, 1).astype(np.float32)) * np.float32(-2)

    def norms(self, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of the vectors that the codes stand for."""
        read = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)
        read = read[:, : self.centers.shape[1]] + self.centers[of_list]
        return (read**2).sum(axis=1)

    def distances(self, units: np.ndarray, tables: np.ndarray, of_list: int, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances (query, member) to what the codes stand for, read from the tables."""
        near = (1 - 2 * units @ self.centers[of_list])[:, None] + norms[None, :]
        for m in range(codes.shape[1]):
            near += tables[m][:, codes[:, m]]
        return near


def _fold(points: np.ndarray) -> np.ndarray:
    """(vector, subspace, dimension), padded with zeros."""
    missing = -points.shape[1] % SUBSPACE_DIMS
    return np.pad(points, ((0, 0), (0, missing))).reshape(len(points), -1, SUBSPACE_DIMS)


def _units(rows, dims: int) -> np.ndarray:
    """Unit vectors in double precision; each row holds single or double floats."""
    points = np.stack([np.frombuffer(r, dtype=np.float32 if len(r) == 4 * dims else np.float64) for r in rows])
    points = points.astype(np.float64)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _valid(vectors: DataFrame) -> DataFrame:
    """Vectors of finite components and positive norm, with a digest that equal vectors share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for vec, values in zip(frame["vec"], frame["embedding"]):
                if values is None or pd.isna(vec) or not len(values):
                    continue
                data = np.asarray([np.nan if v is None else v for v in values], dtype=np.float64) + 0.0
                if np.isfinite(data).all() and 0 < np.linalg.norm(data) < np.inf:
                    digest = hashlib.blake2b(data.tobytes(), digest_size=16).digest()
                    with np.errstate(over="ignore", under="ignore"):
                        single = data.astype(np.float32)
                    raw = single if (single == data).all() else data
                    out.append((vec, len(data), digest, raw.tobytes()))
            yield pd.DataFrame(out, columns=["vec", "dims", "digest", "data"])

    return vectors.mapInPandas(run, "vec bigint, dims int, digest binary, data binary")


def _lists(classes: DataFrame, shared) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                units = _units(frame["data"], shared.value.dims)
                own, codes, error = shared.value.encode(units)
                yield frame.assign(list=own, codes=[c.tobytes() for c in codes], error=error)

    schema = "rep bigint, weight bigint, data binary, list int, codes binary, error double"
    return classes.mapInPandas(run, schema)


def _visits(listed: DataFrame, shared) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), QUERY_STEP):
                part = frame.iloc[at : at + QUERY_STEP]
                units = _units(part["data"], shared.value.dims)
                mask = shared.value.probes(units, part["list"].to_numpy())
                query, target = np.nonzero(mask)
                yield pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy()[query],
                        "list": target,
                        "data": part["data"].to_numpy()[query],
                    }
                )

    return listed.select("rep", "list", "data").mapInPandas(run, "rep bigint, list int, data binary")


def _stars(linked: np.ndarray, queries: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """A star per local component of the links between queries (rows) and members (columns)."""
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    if not rows.any():
        return []
    linked, queries, members = linked[np.ix_(rows, columns)], queries[rows], members[columns]
    top = np.iinfo(np.int64).max
    row_label, column_label = queries.copy(), members.copy()
    while True:
        new_rows = np.minimum(row_label, np.where(linked, column_label[None, :], top).min(axis=1))
        new_columns = np.minimum(column_label, np.where(linked, new_rows[:, None], top).min(axis=0))
        if (new_rows == row_label).all() and (new_columns == column_label).all():
            break
        row_label, column_label = new_rows, new_columns
    nodes, labels = np.concatenate((queries, members)), np.concatenate((row_label, column_label))
    return [(int(a), int(b)) for a, b in zip(nodes, labels) if a != b]


def _search(shared, cosine: float):
    """Rows come sorted by block, members before queries; one block is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantizer: Quantizer = shared.value
        block, held, member = None, [], None

        def compare(part: pd.DataFrame) -> pd.DataFrame:
            units = _units(part["data"], quantizer.dims)
            queries = part["rep"].to_numpy()
            reps, weights, points, codes, norms, reach, of_list = member
            linked = np.zeros((len(queries), len(reps)), dtype=bool)
            near = quantizer.distances(units, quantizer.tables(units), of_list, codes, norms)
            a, b = np.nonzero((near <= reach**2) & (queries[:, None] != reps[None, :]))
            for at in range(0, len(a), PAIR_STEP):
                x, y = a[at : at + PAIR_STEP], b[at : at + PAIR_STEP]
                hit = np.einsum("ij,ij->i", units[x], points[y]) >= cosine
                linked[x[hit], y[hit]] = True
            counts = linked @ weights
            some = np.flatnonzero(counts)
            stars = _stars(linked, queries, reps)
            return pd.DataFrame(
                {
                    "a": np.concatenate((queries[some], np.array([s[0] for s in stars], dtype=np.int64))),
                    "b": pd.array([None] * len(some) + [s[1] for s in stars], dtype="Int64"),
                    "links": np.concatenate((counts[some], np.zeros(len(stars), dtype=np.int64))),
                }
            )

        for frame in frames:
            for key, rows in frame.groupby("block", sort=False):
                if key != block:
                    block, held, member = key, [], None
                own = rows[~rows["is_query"]]
                if len(own):
                    held.append(own)
                asked = rows[rows["is_query"]]
                if not len(asked):
                    continue
                if member is None:
                    whole = pd.concat(held)
                    codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in whole["codes"]])
                    of_list = int(whole["list"].iloc[0])
                    member = (
                        whole["rep"].to_numpy(),
                        whole["weight"].to_numpy().astype(np.int64),
                        _units(whole["data"], quantizer.dims),
                        codes,
                        quantizer.norms(of_list, codes),
                        quantizer.radius + whole["error"].to_numpy() + TABLE_ERROR,
                        of_list,
                    )
                for at in range(0, len(asked), QUERY_STEP):
                    found = compare(asked.iloc[at : at + QUERY_STEP])
                    if len(found):
                        yield found

    return run


def link_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.95,
) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) of every row.

    Two vectors link when their cosine, in double precision, is ``cosine`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    that links reach, and ``kept`` marks it. Vectors that are null, empty, zero, or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths.
    Rows without an id link with nothing, have no component and are kept. Repeated
    rows are vectors of their own that share an id. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("bigint").alias("vec"), F.col(vector_col).alias("embedding"))
    valid = materialize(_valid(given), "vectors")
    grouped = valid.groupBy("digest").agg(
        F.min("vec").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("dims").alias("dims"), F.first("data").alias("data")
    )
    classes = materialize(grouped, "vector-classes")
    found = None
    for dims, count in sorted((r.dims, r.n) for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()):
        part = _link_classes(classes.where(F.col("dims") == dims).select("rep", "weight", "data"), dims, count, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, links bigint")
    found = materialize(found, "vector-links")
    copies = valid.join(classes.select("digest", "rep", "weight"), "digest").select("vec", "rep", "weight")
    edges = copies.select(F.col("vec").alias("a"), F.col("rep").alias("b")).unionByName(
        found.where("b is not null").select("a", "b")
    )
    labels = connected_components(edges, "a", "b")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = copies.join(counts, "rep", "left").select(
        F.col("vec").alias("copy"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")
    )
    linked = linked.groupBy("copy").agg(F.max("n").alias("n"))
    return (
        given.select("vec")
        .join(linked, F.col("vec") == F.col("copy"), "left")
        .join(labels, F.col("vec") == F.col("node"), "left")
        .select(
            F.col("vec").alias(id_col),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec").alias("component_id"),
            F.coalesce(F.col("vec") == F.coalesce("component", "vec"), F.lit(True)).alias("kept"),
        )
    )


def _link_classes(classes: DataFrame, dims: int, count: int, cosine: float) -> DataFrame:
    """(a, b, links): counts of linked rows where b is null, edges of components where it is not."""
    spark = classes.sparkSession
    sample = collect_sample(classes.select("rep", "data"), SAMPLE_VECTORS, "rep")
    lists = max(1, min(MOST_LISTS, round(2 * math.sqrt(count)), len(sample)))
    shared = spark.sparkContext.broadcast(Quantizer.fit(_units([bytes(r.data) for r in sample], dims), lists, cosine))
    listed = materialize(_lists(classes, shared), "inverted-lists")
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    members = listed.join(F.broadcast(sizes), "list").select(
        F.concat_ws("/", "list", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block"),
        F.lit(False).alias("is_query"), "rep", "weight", "data", "list", "codes", "error",
    )
    visits = _visits(listed, shared).join(F.broadcast(sizes), "list")
    visits = visits.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = visits.select(
        F.concat_ws("/", "list", "n").alias("block"), F.lit(True).alias("is_query"), "rep",
        F.lit(0).cast("bigint").alias("weight"), "data", "list",
        F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = members.unionByName(queries).repartition(parts, "block").sortWithinPartitions("block", "is_query")
    return placed.mapInPandas(_search(shared, cosine), "a bigint, b bigint, links bigint")
