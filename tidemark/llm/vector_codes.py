"""Product codes of vectors, assigned by Orchard search.

Each component becomes ``floor(SCALE * x)``; vectors are cut into ``PARTS`` equal consecutive parts, each position with a
codebook of its own that starts as that part of the ``ENTRIES`` least vector ids. Every round assigns all parts to their
nearest entries and replaces an entry by the componentwise floored mean of its parts; entries without parts stay.

Orchard search: every entry holds the list of all entries in ascending distance from it. A part walks the list of its present
entry, passes over marked entries, and jumps to the list of an entry that is nearer (at equal distance: of lower index).
Once an entry on the list is more than twice as far from the present entry as the part is, none behind it can be nearer or
as near, so the search is exact. The parts of a batch walk together as arrays. All arithmetic is in integers.

A round is one pass over the rows: tasks send sums and counts per entry (``PARTS * ENTRIES`` lines of fixed size), Spark adds
them, and the driver keeps the codebooks, whose size doesn't depend on the rows. Labels that hold more than one
``HEAVY``-th of all rows, fewer than ``HEAVY`` of them, get their sums by a broadcast, the others by an ordinary join.

Rows take no part if their vector is null, holds null or non-finite components or components of ``most_component`` or more
(their squares would pass 64 bits), or is not as long as most vectors are (of lengths that the parts divide; ties: the
shorter). Null ids are coded but start no entry; equal ids count as rows of their own, in the order of their vectors. With
fewer rows than entries the codebooks are shorter. Null labels are one label. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels above one HEAVY-th of the rows are broadcast; there are fewer than HEAVY of them.
HEAVY = 64


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position; ``scale`` turns components into integers."""

    entries: np.ndarray
    scale: int

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def most_component(length: int, scale: int = SCALE) -> float:
    """Components below this bound keep every sum of squared differences of a vector within 64 bits."""
    return (isqrt((1 << 62) // max(1, length)) // 2) / scale


class Orchard:
    """One codebook with the distance-sorted list of every entry."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gaps = ((book[:, None] - book[None]) ** 2).sum(2)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        # a list ends where gap > 4 * distance (all squared): the same as a quarter, rounded up, beyond the distance
        self.quarter = np.take_along_axis(-(-gaps // 4), self.lists, 1)
        self.by_sum = np.argsort(book.sum(1), kind="stable")
        self.sums = book.sum(1)[self.by_sum]
        self.measured = 0

    def _gap(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.measured += len(points)
        away = points - self.book[entry]
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point; ties go to the lower index."""
        k = len(self.book)
        at = self.by_sum[np.minimum(np.searchsorted(self.sums, points.sum(1)), k - 1)]
        best = self._gap(points, at)
        marked = np.zeros((len(points), k), bool)
        marked[np.arange(len(points)), at] = True
        place = np.zeros(len(points), np.int64)
        live = np.arange(len(points))
        while len(live):
            live = live[place[live] < k]
            live = live[self.quarter[at[live], place[live]] <= best[live]]
            other = self.lists[at[live], place[live]]
            place[live] += 1
            fresh = ~marked[live, other]
            point, other = live[fresh], other[fresh]
            marked[point, other] = True
            gap = self._gap(points[point], other)
            better = (gap < best[point]) | ((gap == best[point]) & (other < at[point]))
            jump = point[better]
            at[jump], best[jump], place[jump] = other[better], gap[better], 0
        return at, best


def common_length(vectors: DataFrame, vector: str, parts: int) -> int | None:
    """The length most vectors have, of those that the parts divide."""
    length = F.size(F.col(vector))
    row = vectors.where(F.col(vector).isNotNull() & (length > 0) & (length % parts == 0)).groupBy(length.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row and row["n"]


def _usable(vector: Column, length: int, scale: int) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(most_component(length, scale)), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & (F.size(vector) == length) & good


def _matrix(batch: pa.RecordBatch, books: Codebooks) -> np.ndarray:
    """(rows, parts, width) integers of a batch of usable vectors."""
    flat = batch.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * books.scale).astype(np.int64).reshape(batch.num_rows, books.entries.shape[0], -1)


def _rows(vectors: DataFrame, vector: str, length: int, scale: int, *others: str) -> DataFrame:
    return vectors.where(_usable(F.col(vector), length, scale)).select(*[F.col(c) for c in others], F.col(vector).alias("v"))


def _round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one assignment of all rows."""
    parts, entries, width = books.entries.shape

    def sums(batches):
        search = [Orchard(b) for b in books.entries]
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            x = _matrix(b, books)
            for p in range(parts):
                at, _ = search[p].nearest(x[:, p])
                np.add.at(total[p, :, :width], at, x[:, p])
                total[p, :, width] += np.bincount(at, minlength=entries)
        slot = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(total.reshape(-1)[slot], pa.int64())], names=["slot", "total"])

    total = np.zeros(parts * entries * (width + 1), object)
    for row in rows.mapInArrow(sums, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
        total[row["slot"]] = row["total"]
    total = total.reshape(parts, entries, width + 1)
    new = books.entries.copy()
    for p, e in zip(*np.nonzero(total[:, :, width])):
        new[p, e] = [s // total[p, e, width] for s in total[p, e, :width]]
    return Codebooks(new, books.scale)


def fit(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks after the given rounds over all rows; None without a usable row."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    length = common_length(vectors, vector, parts)
    if length is None:
        return None
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * scale)).alias("v")
    seeds = _rows(vectors, vector, length, scale, vec_id).where(F.col(vec_id).isNotNull()).select(vec_id, whole).orderBy(vec_id, "v").limit(entries)
    start = np.array([r["v"] for r in seeds.collect()], np.int64)
    if not len(start):
        return None
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy(), scale)
    rows = _rows(vectors, vector, length, scale)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every usable row."""
    parts = books.entries.shape[0]

    def codes(batches):
        search = [Orchard(b) for b in books.entries]
        for b in batches:
            x = _matrix(b, books)
            found = [search[p].nearest(x[:, p]) for p in range(parts)]
            text = np.stack([at for at, _ in found], 1).astype(np.uint8).tobytes().hex()
            step = 2 * parts
            code = [text[i : i + step] for i in range(0, len(text), step)]
            error = sum(gap for _, gap in found)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    rows = _rows(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x"), F.col(label).alias("label")), "x", books.length, books.scale, "vec_id", "label")
    fields = [rows.schema["vec_id"], rows.schema["label"], *T.StructType.fromDDL("code string, error long").fields]
    return rows.mapInArrow(codes, T.StructType(fields))


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """The rows with ``vector``: the entries their codes name, as components (null or unfit code: null)."""
    parts, entries, _ = books.entries.shape
    table = F.lit([[(e / books.scale).tolist() for e in part] for part in books.entries])
    at = [F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    fit = F.col(code).rlike(f"^[0-9a-f]{{{2 * parts}}}$") & (F.greatest(*at, F.lit(0)) < entries)
    return codes.withColumn("vector", F.when(fit, F.concat(*[F.get(F.get(table, F.lit(p)), i) for p, i in enumerate(at)])))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Written codes with ``label_error``: the errors of all rows of a label added up."""
    rows = coded.count()
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    totals = staged(totals.select(F.col("label").alias("l"), "label_error", (F.col("n") * HEAVY > rows).alias("heavy")), "code-labels")
    heavy, light = totals.where("heavy").drop("heavy"), totals.where("NOT heavy").drop("heavy")
    same = F.col("label").eqNullSafe(F.col("l"))
    most = coded.join(F.broadcast(heavy), same, "left")
    rest = most.where("label_error IS NULL").drop("l", "label_error")
    return most.where("label_error IS NOT NULL").drop("l").unionByName(rest.join(light, same).drop("l"))


def digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): fits the codebooks on all rows and codes every row."""
    books = fit(vectors)
    if books is None:
        return vectors.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in _DIGEST])
    coded = staged(encode(vectors, books), "vector-codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_DIGEST = (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))


def _sql() -> str:
    """The contract in SQL: every distance of every round is computed."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(
            f"a{k} AS MATERIALIZED (SELECT r, part, CAST(min(gap * {ENTRIES} + entry) AS BIGINT) AS m FROM (SELECT x.r, c.part, c.entry, "
            f"sum((x.v - c.v) * (x.v - c.v)) AS gap FROM x JOIN c{k} c USING (i) GROUP BY ALL) GROUP BY ALL)"
        )
        if k < ROUNDS:
            rounds.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.v) AS v FROM c{k} c LEFT JOIN "
                f"(SELECT a.m % {ENTRIES} AS entry, x.i, sum(x.v) AS s, count(*) AS n FROM x JOIN a{k} a ON a.r = x.r AND a.part = x.part GROUP BY ALL) t USING (entry, i))"
            )
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
width AS (SELECT len(embedding) // {PARTS} AS w FROM kept GROUP BY len(embedding) ORDER BY count(*) DESC, 1 LIMIT 1),
flat AS (SELECT r, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM kept),
x AS MATERIALIZED (SELECT r, i, i // w AS part, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS v FROM flat, width),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, i, v FROM x WHERE r <= {ENTRIES}),
{", ".join(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""


DIGESTS_SQL = _sql()
