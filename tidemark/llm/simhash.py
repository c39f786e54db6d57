"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

A document's fingerprint sums the bits of the hashes of its word shingles. Copies share a fingerprint, so groups of copies
cost one code. The distinct codes form one index in Gray order (``gray_index``), cut into bins of about ``BIN_CODES`` consecutive
codes, which are its nodes at that level: for each the bits that all its codes share are factored out. The upper levels,
over the bins, are searched first: pairs of bins whose shared patterns differ in too many bits are dropped with all their
codes. Each pair that is left goes to a task, which builds the lower levels over its two bins and prunes on.

In Gray order n bins share about log2 n leading bits, and a bin meets those within two of these: about half the squared
logarithm of n of them, whatever the corpus looks like. The upper levels (three numbers a bin) are held by the
driver and the list of pairs is broadcast: some hundred bytes for every ``BIN_CODES`` codes.

Nulls, empty texts and texts without words have fingerprint 0 and are linked like any other; rows that repeat an id
are separate rows with that id; an empty table gives an empty result; further columns are ignored by ``fingerprints``
and ``components_of`` and kept by ``keep_representatives``. A null id is the largest id: a component takes it only
when no row has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, staged, utf8
from tidemark.llm.components import components
from tidemark.llm.gray_index import Tree, close_between, close_pairs, least_labels, tree_pairs

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Codes of a bin, and the least number of bins of no fewer than FEW_CODES codes: their pairs are the tasks.
BIN_CODES, LEAST_BINS, FEW_CODES = 1 << 15, 16, 1 << 10
NULL_ID = (1 << 63) - 1


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 of every shingle, repeats included; fewer words than ``size``: the whole sequence; none: empty."""
    words = text.lower().split()  # bytes: lower-cases A-Z only and splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def _with_fingerprints(docs: DataFrame, name: str, text: str) -> DataFrame:
    """All columns, and the fingerprint as a long column ``name``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for b in batches:
            prints = [simhash(shingle_hashes(t)) for t in utf8(b, text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.int64())], names=[*b.schema.names, name])

    return map_batches(docs, run, schema)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code): one row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _with_fingerprints(rows, "code", "text").drop("text")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _gray_rank(code: Column) -> Column:
    x = code
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(_signed(1 << 63)))  # unsigned order


def _stars(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    """The links within a bin, or between two, as stars; codes are in Gray order."""
    codes = a if b is None else np.concatenate((a, b))
    label = np.arange(len(codes))
    pairs = close_pairs(a, np.array([len(a)]), MAX_BITS) if b is None else close_between(a, b, MAX_BITS)
    for i, j in pairs:
        j = j if b is None else j + len(a)
        label = least_labels(len(codes), np.concatenate((np.arange(len(label)), i)), np.concatenate((label, j)))
    moved = label != np.arange(len(label))
    signed = codes.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])


def _pair_links(batches):
    """Stars over the links of the pairs of bins of one task; a pair is whole in a task."""

    def of(held):
        t = pa.Table.from_batches(held)
        side, code = t.column("side").to_numpy(), t.column("code").to_numpy().view(np.uint64)
        right = code[side == 1]
        return _stars(code[side == 0], right if len(right) else None)

    held: list[pa.RecordBatch] = []
    for b in batches:
        pair = b.column("pair").to_numpy()
        cut = np.flatnonzero(pair[1:] != pair[:-1]) + 1
        for lo, hi in zip([0, *cut], [*cut, len(pair)]):
            if lo == hi:
                continue
            if held and held[0].column("pair")[0].as_py() != pair[lo]:
                yield of(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield of(held)


def bin_pairs(ands: np.ndarray, ors: np.ndarray, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """The pairs of bins, each with itself too, whose shared bits differ in no more than MAX_BITS places."""
    tree = Tree(ands, ors)
    return [x for i, j in tree_pairs(tree, tree, MAX_BITS, seen) for x in zip(i.tolist(), j.tolist())]


def code_links(codes: DataFrame) -> DataFrame:
    """(a, b): links between distinct codes within MAX_BITS bits, enough to connect every such pair.

    ``codes`` has one row per distinct ``code``. Each task turns the links of its bins into stars, so a cube of
    near copies yields one row per code and task instead of all its pairs.
    """
    ranked = codes.select("code", _gray_rank(F.col("code")).alias("rank"))
    count = ranked.count()
    bins = max(-(-count // BIN_CODES), min(LEAST_BINS, -(-count // FEW_CODES)))
    cuts = [F.lit(i / bins) for i in range(1, bins)]
    edges = ranked.agg(F.percentile_approx("rank", F.array(*cuts), F.lit(20 * bins)).alias("e")).first()["e"] if cuts else []
    shared = codes.sparkSession.sparkContext.broadcast(np.array(edges or [], np.int64))

    def place(batches):
        for b in batches:
            at = np.searchsorted(shared.value, b.column("rank").to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([b.column("code"), b.column("rank"), pa.array(at, pa.int64())], names=["code", "rank", "bin"])

    binned = staged(ranked.mapInArrow(place, "code long, rank long, bin long"), "code-bins")
    found = sorted(binned.groupBy("bin").agg(F.bit_and("code"), F.bit_or("code")).collect())
    number = [r[0] for r in found]
    pairs = bin_pairs(*(np.array([r[k] for r in found], np.int64).view(np.uint64) for k in (1, 2)))
    sides = [(number[i], n, 0) for n, (i, j) in enumerate(pairs)] + [(number[j], n, 1) for n, (i, j) in enumerate(pairs) if i != j]
    sides = codes.sparkSession.createDataFrame(sides, "bin long, pair long, side int")
    laid = binned.join(F.broadcast(sides), "bin").select("pair", "side", "rank", "code")
    return laid.repartition("pair").sortWithinPartitions("pair", "side", "rank").mapInArrow(_pair_links, "a long, b long")


def components_of(prints: DataFrame) -> DataFrame:
    """(code, component_id): for every distinct code the smallest doc_id reachable over links of codes."""
    ids = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    codes = staged(prints.groupBy("code").agg(F.min(ids).alias("least")), "codes")
    roots = components(code_links(codes.select("code"))).withColumnRenamed("node", "code")
    rooted = codes.join(roots, "code", "left").select("code", F.coalesce("root", "code").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("code", "root").join(least, "root").select("code", "component_id")
    return found.withColumn("component_id", F.when(F.col("component_id") != NULL_ID, F.col("component_id")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``."""
    prints = staged(fingerprints(docs, doc_id, text), "prints")
    return prints.join(components_of(prints), "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: of the rows with its smallest id, the one with the least code.

    Rows equal in id and code beyond the first go as well.
    """
    code, key = "__code", "__key"
    while {code, key} & set(docs.columns):
        code, key = code + "_", key + "_"
    rows = staged(_with_fingerprints(docs, code, text).withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))), "fingerprinted")
    prints = rows.select(F.col(key).alias("doc_id"), F.col(code).alias("code"))
    found = prints.join(components_of(prints), "code")
    best = found.groupBy(F.coalesce("component_id", F.lit(NULL_ID))).agg(F.min(F.struct("doc_id", "code")).alias("m"))
    best = best.select(F.col("m.doc_id").alias(key), F.col("m.code").alias(code))
    return rows.join(best, [key, code], "left_semi").dropDuplicates([key, code]).select(*docs.columns)
