"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

On unit vectors the largest cosine is the least Euclidean distance, so each of ``TABLES`` tables hashes a vector by
``floor((a_i . v + b_i) / w)`` for Gaussian a_i. A query visits, besides its own bucket, the buckets that differ by
one in some places, in the order of the estimated chance that a neighbour fell there (the sum of squared distances to the
bucket borders crossed). The candidates of all tables are merged and ranked by the exact cosine of the given vectors.

Calibration: for at most ``TRIALS`` sampled vectors the distance to the k-th neighbour among all rows is measured exactly, in one
pass. Its quantiles ``LEVELS`` are the radii of the levels of the search. A level's bucket width follows its radius, and its number of probes is
the least whose simulated chance to visit a neighbour at that radius is ``TARGET``; a level that can't reach it is left out. A query is
answered by the first level that finds k neighbours within its radius; one that no level answers, such as an isolated
vector's, is compared with all rows. So every query gets min(k, candidates) rows, whatever the density around it.

All vectors are indexed. They lie in blocks by hash of the id, each with its own sorted tables, whose size, not the
table's, sets the number of hashes: the chance to find a neighbour is the same at any number of rows. A bucket or a group of
equal vectors of any size is spread evenly. Queries go to the blocks (few blocks are doubled for several groups of queries), which send back their
nearest few.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no part.
Rows with the query's own id are no candidates; an id that repeats is found once, with its best row, and searched once, with its
least vector; ties go to the smaller id; null ids take no part; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import hash_place, least_placed, staged

TABLES, TRIALS, TARGET, WIDTH = 16, 200, 0.85, 1.8
#: Radii of the levels, as quantiles of the distance to the k-th neighbour.
LEVELS = (0.6, 0.95)
LEAST_PROBES, MOST_PROBES = 64, 1024
#: Blocks: BLOCKS of them with no fewer than the first and no more than the second number of vectors; more for more rows. Tasks of a level.
BLOCKS, BLOCK_ROWS, TASKS = 4, (1024, 1 << 17), 16
#: Scores in single precision choose whom to score exactly; they are off by much less.
MARGIN = 1e-4
SEED = 11


@dataclass(frozen=True)
class Index:
    """Hash functions and visiting order, the same in every task."""

    a: np.ndarray  # TABLES * hashes rows
    b: np.ndarray
    mix: np.ndarray  # odd multipliers that fold the parts of a key
    sets: np.ndarray  # perturbations as sorted border places, -1 for none
    probes: int

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and offsets inside them: rows x tables x hashes."""
        f = (unit @ self.a.T + self.b).reshape(len(unit), TABLES, -1)
        cell = np.floor(f)
        return cell.astype(np.int64), f - cell

    def keys(self, cell: np.ndarray) -> np.ndarray:
        return (cell * self.mix).sum(axis=2)

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """Keys of the buckets to visit, best first by set: rows x tables x probes."""
        cell, offset = self.place(unit)
        return self.keys(cell)[:, :, None] + _steps(offset, self.sets, self.probes, self.mix)


def _borders(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances to the 2 m borders in ascending order, with the hash and the direction of each.

    The two borders of one hash stand at places j and 2 m - 1 - j.
    """
    both = np.concatenate((offset**2, (1 - offset) ** 2), axis=-1)
    order = np.argsort(both, axis=-1, kind="stable")
    m = offset.shape[-1]
    return np.take_along_axis(both, order, -1), order % m, np.where(order < m, -1, 1)


def _choice(score: np.ndarray, sets: np.ndarray, probes: int) -> np.ndarray:
    """Indices of the ``probes`` sets with the least sums of squared distances, in that order."""
    total = (score[..., np.maximum(sets, 0)] * (sets >= 0)).sum(axis=-1)
    if probes < total.shape[-1]:
        least = np.argpartition(total, probes, axis=-1)[..., :probes]
    else:
        least = np.broadcast_to(np.arange(total.shape[-1]), total.shape)
    return np.take_along_axis(least, np.argsort(np.take_along_axis(total, least, -1), axis=-1, kind="stable"), -1)


def _steps(offset: np.ndarray, sets: np.ndarray, probes: int, mix: np.ndarray) -> np.ndarray:
    score, order, sign = _borders(offset)
    chosen = sets[_choice(score, sets, probes)]
    step = np.take_along_axis(np.broadcast_to(mix, offset.shape), order, -1) * sign
    step = np.concatenate((step, np.zeros((*step.shape[:-1], 1), np.int64)), axis=-1)  # place -1: no step
    flat = chosen.reshape(*chosen.shape[:-2], -1)
    return np.take_along_axis(step, np.where(flat < 0, step.shape[-1] - 1, flat), -1).reshape(chosen.shape).sum(axis=-1)


def visiting_order(m: int, count: int) -> np.ndarray:
    """The first ``count`` sets of border places by expected score, the empty one first; rows padded with -1.

    The expected squared distance of the j-th of 2 m sorted borders is a known function of j; sets grow from the least
    by shifting or extending their last place.
    """
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = m + 1 - j
    z = np.concatenate((near, 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))))
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < count:
        s, places = heapq.heappop(heap)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s + z[last + 1], (*places, last + 1)))
            heapq.heappush(heap, (s - z[last] + z[last + 1], (*places[:-1], last + 1)))
        if not any(2 * m - 1 - p in places for p in places):
            out.append(places)
    sets = np.full((len(out), max(map(len, out), default=0) or 1), -1)
    for row, places in enumerate(out):
        sets[row, : len(places)] = places
    return sets


def _success(m: int, noise: float, probes: int, sets: np.ndarray, rng) -> float:
    """Chance that one of the tables visits a neighbour's bucket, from 400 simulated offsets."""
    offset = rng.random((400, 1, m))
    mix = rng.integers(1, 1 << 62, m) * 2 + 1
    cell = np.floor(offset + rng.normal(0, noise, offset.shape)).astype(np.int64)
    hit = ((cell * mix).sum(axis=2)[:, :, None] == _steps(offset, sets, probes, mix)).any(axis=2).mean()
    return 1 - (1 - hit) ** TABLES


def fit(radius: float, size: int, rows: int) -> Index | None:
    """Hash functions for blocks of ``rows`` vectors of this length; None if no number of probes reaches ``TARGET``."""
    rng = np.random.default_rng(SEED)
    m = max(4, round(0.7 * np.log2(max(2, rows))))
    probes, sets = LEAST_PROBES, visiting_order(m, 2 * LEAST_PROBES)
    while _success(m, 1 / WIDTH, probes, sets, rng) < TARGET:
        probes *= 2
        if probes > MOST_PROBES:
            return None
        sets = visiting_order(m, 2 * probes)
    a = rng.normal(size=(TABLES * m, size)) / (WIDTH * radius)
    return Index(a, rng.random(TABLES * m), (rng.integers(1, 1 << 62, m) * 2 + 1).astype(np.int64), sets, min(probes, len(sets)))


class Block:
    """The vectors of a block with sorted tables; without an index every vector is a candidate."""

    def __init__(self, index: Index | None, ids: np.ndarray, vectors: np.ndarray):
        self.index, self.ids, self.vectors = index, ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / self.norms[:, None]
        self.single = unit.astype(np.float32)
        if index:
            keys = index.keys(index.place(unit)[0]) if len(ids) else np.zeros((0, TABLES), np.int64)
            self.order = np.argsort(keys, axis=0, kind="stable")
            self.keys = np.take_along_axis(keys, self.order, 0)

    def candidates(self, visits: np.ndarray) -> np.ndarray:
        found = np.zeros(len(self.ids), bool)
        for t in range(TABLES):
            lo = np.searchsorted(self.keys[:, t], visits[t], "left")
            n = np.searchsorted(self.keys[:, t], visits[t], "right") - lo
            lo, n = lo[n > 0], n[n > 0]
            found[self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), t]] = True
        return found

    def nearest(self, query_id: int, query: np.ndarray, rough: np.ndarray, found: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact cosines of the ``k`` nearest candidates, each id once; ``rough`` are all cosines in single precision."""
        own = self.ids != query_id
        at = np.flatnonzero(own if found is None else found & own)
        if len(at) > k:
            least = np.partition(rough[at], len(at) - k)[len(at) - k]
            close = at[rough[at] >= least - MARGIN]
            if len(np.unique(self.ids[close])) >= k:
                at = close
        # Row sums, not a matrix product: equal vectors must get equal scores wherever they stand.
        score = (self.vectors[at] * query).sum(axis=1) / (self.norms[at] * np.sqrt((query * query).sum()))
        order = np.lexsort((self.ids[at], -score))
        _, first = np.unique(self.ids[at][order], return_index=True)
        order = order[np.sort(first)[:k]]
        return self.ids[at][order], score[order]


_HITS = "query_id long, vec_id long, score double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def _answers(block: Block, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple]:
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    rough = unit.astype(np.float32) @ block.single.T
    visits = block.index.visits(unit) if block.index else [None] * len(ids)
    out = []
    for q, v, r, p in zip(ids, vectors, rough, visits):
        found = None if p is None else block.candidates(p)
        out += [(q, *hit) for hit in zip(*block.nearest(q, v, r, found, k))]
    return out


def _search(index: Index | None, k: int):
    def run(batches):
        block = at = None
        held = []
        for b in batches:
            # Runs of one task and kind; rows of kind 0 fill a block, rows of kind 1 search it.
            number, kind = b.column("task").to_numpy(), b.column("kind").to_numpy()
            cut = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(number)]):
                if lo == hi:
                    continue
                if kind[lo] == 0:
                    if number[lo] != at:
                        held, block, at = [], None, number[lo]
                    held.append(b.slice(lo, hi - lo))
                elif number[lo] == at:
                    block = block or Block(index, *_rows(held))
                    for start in range(lo, hi, 64):
                        yield _batch(_answers(block, *_rows([b.slice(start, min(64, hi - start))]), k))

    return run


def _rows(batches) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches)
    ids = t.column("vec_id").to_numpy()
    return ids, t.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def far_neighbours(rows: DataFrame, trials: list, k: int) -> np.ndarray:
    """Exact distance of each trial row to its k-th neighbour among all rows (ids of their own), in one pass over them."""
    ids, vectors = np.array([r.vec_id for r in trials]), np.array([r.vector for r in trials])
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches):
        held: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                for q, i, score in _answers(Block(None, *_rows([b])), *shared.value, k):
                    held.setdefault(int(q), []).append((-score, i))
            held = {q: sorted(set(xs))[:k] for q, xs in held.items()}
        yield _batch([(q, i, -score) for q, xs in held.items() for score, i in xs])

    best = _best(rows.select("vec_id", "vector").mapInArrow(scan, _HITS), k).where(F.col("rank") == k).select("score").collect()
    return np.sqrt(np.maximum(2 - 2 * np.array([r.score for r in best], float), 0))


def _level(rows: DataFrame, queries: DataFrame, index: Index | None, blocks: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of some queries against all rows, by one index or by comparison with every row."""
    slices = max(1, -(-TASKS // blocks))
    shared = rows.sparkSession.sparkContext.broadcast(index)  # of fixed size
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block, group = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(slices))
    stored = rows.select(every(slices).alias("s"), block.alias("b"), "vec_id", "vector")
    stored = stored.select((F.col("b") * slices + F.col("s")).alias("task"), F.lit(0).alias("kind"), "vec_id", "vector")
    sent = queries.select(every(blocks).alias("b"), group.alias("s"), "vec_id", "vector")
    sent = sent.select((F.col("b") * slices + F.col("s")).alias("task"), F.lit(1).alias("kind"), "vec_id", "vector")
    laid = stored.unionByName(sent).repartition("task").sortWithinPartitions("task", "kind")
    return staged(_best(laid.mapInArrow(lambda batches: _search(shared.value, k)(batches), _HITS), k), "hits")


def search(vectors: DataFrame, every: int, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    rows = _valid(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, count = sizes["size"], sizes["count"]
    rows = rows.where(F.size("vector") == size)
    blocks = max(min(BLOCKS, -(-count // BLOCK_ROWS[0])), -(-count // BLOCK_ROWS[1]))
    far = far_neighbours(rows, least_placed(rows, hash_place(F.col("vec_id")), "vec_id", TRIALS, count).collect(), k)
    radii = [max(float(r), 1e-3) for r in np.quantile(far, LEVELS)] if len(far) else []
    radii = [r for r, wider in zip(radii, [*radii[1:], np.inf]) if wider > 1.1 * r]  # levels of nearly one radius are one
    left = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    out = []
    for radius in radii:
        index = fit(radius, size, -(-count // blocks))
        if index is None:
            continue
        found = _level(rows, left, index, blocks, k)
        done = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        done = done.where((F.col("n") == k) & (F.col("least") >= 1 - radius * radius / 2)).select("query_id")
        out.append(found.join(done, "query_id", "left_semi"))
        left = staged(left.join(done, left["vec_id"] == done["query_id"], "left_anti"), "queries")
        if left.isEmpty():
            break
    else:
        out.append(_level(rows, left, None, blocks, k))
    return reduce(DataFrame.unionByName, out)
