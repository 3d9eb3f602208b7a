"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Centres come from a bounded sample. A vector is at home in the cell of its
nearest centre, and a guest in each cell whose border it is near: two vectors
at the least cosine lie at most a chord apart, so if a border runs between them
one of the two is within half of that chord of it. Comparing each cell's home
vectors with one another and with its guests therefore finds every pair; no
pair depends on luck, and guests are never compared with guests. A task holds
one bounded block of home vectors while guests stream past it, and gives counts
and stars, never pairs. Products are taken in single precision; what they leave
in doubt is decided in doubles.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.blocks import meetings
from crestline.llm.common import written
from crestline.llm.components import connected_components


@dataclass(frozen=True)
class Cells:
    """least: the cosine of a link. sample: vectors that the centres are fitted on, at most.

    per_cell: vectors that a cell should hold; there are at most sample / 16
    centres. A cell with more than block vectors at home is compared block by
    block, and more than guests guests of a block are dealt out to several
    tasks.
    """

    least: float = 0.95
    sample: int = 65_536
    per_cell: int = 2_000
    rounds: int = 10
    block: int = 4_096
    guests: int = 65_536
    seed: int = 7


def as_doubles(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors from their bytes, of singles or doubles."""
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), dtype="<f4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(r, dtype="<f4" if len(r) == 4 * dim else "<f8") for r in raw]).astype(np.float64)


def at_length_one(vectors: np.ndarray) -> np.ndarray:
    """vectors, none of them zero, at length 1; those whose squares would overflow or vanish are scaled first."""
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = np.where((peak > 1e140) | (peak < 1e-140), vectors / peak, vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def readable(rows: DataFrame) -> DataFrame:
    """id, dim, digest (of the vector), raw (its components, as singles where these hold them); digest is null where nothing can link."""

    def run(batches):
        for batch in batches:
            dims, digests, raws = [], [], []
            for x in batch.column(1).to_pylist():
                v = np.array(x, dtype="<f8") if x and None not in x else np.zeros(0)
                single = v.astype("<f4") if len(v) and np.abs(v).max() < 3e38 else v
                raw = (single if (single == v).all() else v).tobytes()
                links = len(v) and np.isfinite(v).all() and v.any()
                dims.append(len(v))
                raws.append(raw if links else None)
                digests.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if links else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["id", "dim", "digest", "raw"])

    return rows.mapInArrow(run, "id long, dim int, digest binary, raw binary")


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k unit centres of unit vectors; an empty cell starts anew at the vector that its centre serves worst."""
    rng = np.random.default_rng(seed)
    centres = vectors[np.sort(rng.choice(len(vectors), size=min(k, len(vectors)), replace=False))].copy()
    of, best = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    for _ in range(rounds):
        for lo in range(0, len(vectors), 2048):
            near = vectors[lo : lo + 2048] @ centres.T
            of[lo : lo + 2048], best[lo : lo + 2048] = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, vectors)
        worst = iter(np.argsort(best, kind="stable"))
        for c in np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9):
            sums[c] = vectors[next(worst)]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return np.unique(centres, axis=0)


def fit_centres(classes: DataFrame, n: int, how: Cells) -> np.ndarray:
    """Centres for the commonest length, fitted on a sample that the smallest hashes of the vectors make up."""
    rows = classes.select("dim", "raw").orderBy(F.xxhash64("digest", F.lit(how.seed)), "digest").limit(how.sample).toArrow()
    dims, raw = rows.column("dim").to_pylist(), rows.column("raw").to_pylist()
    if not dims:
        return np.zeros((0, 0))
    common = max(set(dims), key=lambda d: (dims.count(d), d))
    sample = at_length_one(as_doubles([r for r, d in zip(raw, dims, strict=True) if d == common], common))
    k = max(1, min(math.ceil(n / how.per_cell), how.sample // 16, len(sample)))
    return spherical_kmeans(sample, k, how.rounds, how.seed)


def places(units: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and for each vector and cell whether it is a guest there."""
    reach = math.sqrt(2 - 2 * least) / 2 + 1e-9
    near = units @ centres.T
    home = near.argmax(axis=1)
    short = near[np.arange(len(units)), home][:, None] - near
    # The distance to the border between two centres is the difference of the cosines over that of the centres.
    gap = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0))
    guest = short <= reach * gap
    guest[np.arange(len(units)), home] = False
    return home, guest


def _placed(batch: pa.RecordBatch, dim: int, raw: int, centres: np.ndarray, least: float):
    """(rows, home, guest) of a batch's vectors of the centres' length, in bounded parts."""
    dims = batch.column(dim).to_numpy()
    fits = np.flatnonzero(dims == centres.shape[1]) if centres.size else np.zeros(0, dtype=np.int64)
    most = max(1, min(1024, 8_000_000 // max(1, len(centres))))
    for lo in range(0, len(fits), most):
        rows = fits[lo : lo + most]
        yield rows, *places(at_length_one(as_doubles(batch.column(raw).take(pa.array(rows)).to_pylist(), centres.shape[1])), centres, least)


def cell_sizes(classes: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """cell, homes, visits: how many vectors each cell has at home and as guests. Vectors of another length than the centres' have a cell by their length."""

    def run(batches):
        homes, visits = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
        other: dict[int, int] = {}
        for batch in batches:
            for _, home, guest in _placed(batch, 0, 1, centres, least):
                homes += np.bincount(home, minlength=len(centres))
                visits += guest.sum(axis=0)
            dims, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            for d, c in zip(dims.tolist(), n.tolist(), strict=True):
                if not centres.size or d != centres.shape[1]:
                    other[-1 - d] = other.get(-1 - d, 0) + c
        cells = [*range(len(centres)), *other]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([*homes.tolist(), *other.values()], pa.int64()), pa.array([*visits.tolist(), *[0] * len(other)], pa.int64())], names=["cell", "homes", "visits"])

    counted = classes.select("dim", "raw").mapInArrow(run, "cell long, homes long, visits long")
    return counted.groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).where("homes > 0")


def in_cells(classes: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """A row for each vector and cell in which it is at home or a guest: cell, home, visits (the cells in which a vector at home here is a guest), and its own columns."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            own = -1 - dims.astype(np.int64)
            visits: list = [b""] * len(dims)
            row, cell = [], []
            for rows, home, guest in _placed(batch, 2, 3, centres, least):
                own[rows] = home
                for i, g in zip(rows.tolist(), guest, strict=True):
                    visits[i] = np.flatnonzero(g).astype("<i4").tobytes()
                a, c = guest.nonzero()
                row.append(rows[a])
                cell.append(c)
            for at, of, seen in ((np.arange(len(dims)), own, visits), *((r, c, None) for r, c in zip(row, cell, strict=True))):
                if len(at):
                    taken = batch.take(pa.array(at))
                    shown = pa.array(seen, pa.binary()) if seen is not None else pa.nulls(len(at), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(own[at], pa.int64()), shown, *(taken.column(k) for k in (0, 1, 2, 3, 4))], names=["cell", "home", "visits", "id", "n", "dim", "raw", "digest"])

    return classes.select("id", "n", "dim", "raw", "digest").mapInArrow(run, "cell long, home long, visits binary, id long, n long, dim int, raw binary, digest binary")


def dealt_out(cells: DataFrame, sizes: DataFrame, how: Cells) -> DataFrame:
    """cells with p (a block of the cell's home vectors), g (a part of its guests) and guest.

    A vector at home is in its own block with each part of the guests, and a
    guest of the cell's blocks before its own; a guest meets each block once.
    """
    zero_to = lambda n: F.sequence(F.lit(0), n - 1)
    sized = sizes.select("cell", F.ceil(F.col("homes") / how.block).cast("int").alias("blocks"), F.ceil((F.col("visits") + F.col("homes")) / how.guests).cast("int").alias("parts"))
    rows = cells.join(sized, "cell")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("blocks")).cast("int")).withColumn("part", F.pmod(F.xxhash64("digest", F.lit(2)), F.col("parts")).cast("int"))
    place = lambda p, g, guest: F.struct(p.alias("p"), g.alias("g"), F.lit(guest).alias("guest"))
    at_home = F.transform(zero_to(F.col("parts")), lambda g: place(F.col("mine"), g, 0))
    passing = F.transform(F.filter(zero_to(F.col("blocks")), lambda p: (F.col("cell") != F.col("home")) | (p < F.col("mine"))), lambda p: place(p, F.col("part"), 1))
    places_of = F.when(F.col("cell") == F.col("home"), F.concat(at_home, passing)).otherwise(passing)
    return rows.withColumn("place", F.explode(places_of)).select("cell", "place.p", "place.g", "place.guest", "home", "visits", "id", "n", "dim", "raw", "digest")


class Block:
    """One block of a cell's home vectors: how many links each has, and how they hang together, as guests come by."""

    def __init__(self, rows: pa.RecordBatch, n_centres: int, least: float):
        self.cell, self.dim, self.least = rows.column(0)[0].as_py(), rows.column(8)[0].as_py(), least
        self.ids, self.n, self.digests = rows.column(6).to_numpy(), rows.column(7).to_numpy(), rows.column(10).to_pylist()
        self.units = at_length_one(as_doubles(rows.column(9).to_pylist(), self.dim))
        self.singles = self.units.astype(np.float32)
        self.visits = np.zeros((len(self.ids), n_centres), dtype=bool)
        for i, seen in enumerate(rows.column(5).to_pylist()):
            self.visits[i, np.frombuffer(seen, dtype="<i4")] = True
        self.count = np.zeros(len(self.ids), dtype=np.int64)
        self.label = np.arange(len(self.ids), dtype=np.int32)
        #: What single precision may be off by, for each of two vectors of this length and their product.
        self.margin = (self.dim + 16) * 2.4e-7

    def linked(self, units: np.ndarray) -> np.ndarray:
        near = self.singles @ units.astype(np.float32).T
        linked = near >= self.least
        i, j = (np.abs(near - np.float32(self.least)) <= self.margin).nonzero()
        for lo in range(0, len(i), 16_384):
            a, b = i[lo : lo + 16_384], j[lo : lo + 16_384]
            linked[a, b] = np.einsum("ij,ij->i", self.units[a], units[b]) >= self.least
        return linked

    def among_themselves(self) -> None:
        for lo in range(0, len(self.ids), 1024):
            linked = self.linked(self.units[lo : lo + 1024])
            linked[np.arange(lo, lo + linked.shape[1]), np.arange(linked.shape[1])] = False
            self._join(linked, self.n[lo : lo + 1024], lo)

    def meet(self, rows: pa.RecordBatch) -> tuple | None:
        """digest, id, links and the smallest home vector reached, of the guests that link."""
        home, n = rows.column(4).to_numpy(), rows.column(7).to_numpy()
        linked = self.linked(at_length_one(as_doubles(rows.column(9).to_pylist(), self.dim)))
        # A guest from another cell, and a vector of here that is a guest there, meet in both; the smaller cell counts them.
        twice = np.flatnonzero((home >= 0) & (home < self.cell))
        if len(twice):
            linked[:, twice] &= ~self.visits[:, home[twice]]
        found = self._join(linked, n)
        if found is None:
            return None
        at, links, roots = found
        taken = rows.take(pa.array(at))
        return taken.column(10), taken.column(6), pa.array(links, pa.int64()), pa.array(self.ids[roots], pa.int64())

    def _join(self, linked: np.ndarray, n: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Counts the links and joins what they link; with first, the columns are the home vectors from there on."""
        rows, at = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(rows):
            return None
        if first is not None:
            rows = np.union1d(rows, first + at)
        linked = linked[np.ix_(rows, at)]
        weights = linked.astype(np.float64)
        self.count[rows] += (weights @ n[at]).astype(np.int64)
        links = (self.n[rows] @ weights).astype(np.int64)
        if first is not None:
            linked[np.searchsorted(rows, first + at), np.arange(len(at))] = True
        label, none = self.label, np.int32(len(self.ids))
        while True:  # the smallest row number spreads along the links, and takes the rows with the same label along
            own = label[rows]
            of_guest = np.where(linked, own[:, None], none).min(axis=0)
            new = np.where(linked, of_guest[None], none).min(axis=1)
            if (new == own).all():
                return at, links, of_guest
            np.minimum.at(label, own, new)
            label[rows] = np.minimum(label[rows], new)
            while (label[label] != label).any():
                label[:] = label[label]

    def found(self) -> tuple:
        at = np.flatnonzero(self.count)
        return pa.array([self.digests[i] for i in at], pa.binary()), pa.array(self.ids[at], pa.int64()), pa.array(self.count[at], pa.int64()), pa.array(self.ids[self.label[at]], pa.int64())


def _compared(cells: DataFrame, n_centres: int, least: float, tasks: int) -> DataFrame:
    """digest, id, n_links, b (an id that it hangs together with), for each block and vector that has links there."""

    def run(batches):
        block = None
        for what, rows in meetings(batches, 3, 3, 1024):
            got = None
            if what == "open":
                block = Block(rows, n_centres, least)
                if rows.column(2)[0].as_py() == 0:
                    block.among_themselves()
            elif what == "guests":
                got = block.meet(rows)
            else:
                got = block.found()
            if got is not None and len(got[0]):
                yield pa.RecordBatch.from_arrays(list(got), names=["digest", "id", "n_links", "b"])

    return cells.repartition(tasks, "cell", "p", "g").sortWithinPartitions("cell", "p", "g", "guest").mapInArrow(run, "digest binary, id long, n_links long, b long")


def near_duplicate_vectors(rows: DataFrame, how: Cells | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Two vectors are linked if their cosine, in doubles, is at least how.least;
    lengths have to be equal. n_links counts the other rows linked with this
    one, component_id is the smallest id that links reach, kept says whether
    that is the row's own. A vector that is null, empty, zero or holds a null
    or non-finite component links with nothing, nor does a row with a null id:
    it is kept, and its component_id is null. Equal vectors are one class and
    compared once; rows that share an id count as rows but hang together.
    """
    how = how or Cells()
    vectors = written(readable(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))), "vectors")
    linkable = vectors.where("id is not null and digest is not null")
    classes = written(linkable.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "classes")
    centres = fit_centres(classes, classes.count(), how)
    sizes = written(cell_sizes(classes, centres, how.least), "sizes")
    tasks = sizes.agg(F.sum(F.ceil(F.col("homes") / how.block) * F.ceil((F.col("visits") + F.col("homes")) / how.guests))).first()[0]
    found = written(_compared(dealt_out(in_cells(classes, centres, how.least), sizes, how), len(centres), how.least, max(1, min(int(tasks or 1), 8_192))), "found")
    counts = found.groupBy("digest").agg(F.sum("n_links").alias("n_links"))
    # The classes of an id that has several vectors hang together.
    several = linkable.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("id")
    of_class = linkable.join(several, "id", "left_semi").join(classes.select("digest", F.col("id").alias("rep")), "digest").select("id", "rep")
    least = of_class.groupBy("id").agg(F.min("rep").alias("b"))
    twins = of_class.join(least, "id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    components = connected_components(found.select(F.col("id").alias("a"), "b").unionByName(twins)).withColumnRenamed("node", "id")
    named = classes.join(components, "id", "left").join(counts, "digest", "left").select("digest", F.coalesce("component", "id").alias("component"), (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("links"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast("long")
    out = vectors.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
