"""Hierarchical packing of tokenised documents into windows of several lengths.

A task encodes its documents (ids of the word-end BPE vocabulary, then the end id) and packs them in blocks of about
``BLOCK_TOKENS`` ids, each on its own:

1. *Route.* Whole longest windows are cut off a long document; what is left goes to the shortest tier that holds it.
2. *Pack each tier*, longest first: a window of the tier opens with its longest open piece.
3. *Fill the gap* of a window from shorter tiers, the longest fitting piece first. When none fits, the head of the
   longest open piece closes the gap; its tail is routed anew. Only the last window of a block can run out of pieces: it
   is cut into windows of powers of two. Tiers are powers of two too, so no window is padded.
4. *Balance step groups.* Windows go to groups of about ``GROUP_TOKENS`` ids, longest and costliest first, each to the group
   with the fewest ids and, among equals, the least attention cost (sum of squared piece lengths).

Blocks depend on nothing but the rows of their partition, so nothing is shuffled, no document is a hot spot, memory is
bounded by a block and the longest document, and a lost task is repeated alone. Window and group numbers start with the
number of the partition.

A null text counts as empty and is the end id alone; repeated and null document ids are documents of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import Encoder, Vocabulary, numbered, shared_file

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
BLOCK_TOKENS, GROUP_TOKENS = 1 << 20, 1 << 16
#: Numbers of windows and groups: partition times NUMBERS plus a count.
NUMBERS = 1 << 40

#: A piece: document of the block, ids of that document before it, length.
Piece = tuple[int, int, int]


class Pool:
    """Open pieces by length, the last one in first out."""

    def __init__(self, pieces: Iterable[Piece] = ()):
        self.lengths: list[int] = []
        self.held: defaultdict[int, list[Piece]] = defaultdict(list)
        for p in pieces:
            self.add(p)

    def add(self, piece: Piece) -> None:
        if not self.held[piece[2]]:
            insort(self.lengths, piece[2])
        self.held[piece[2]].append(piece)

    def _pop(self, at: int) -> Piece:
        length = self.lengths[at]
        piece = self.held[length].pop()
        if not self.held[length]:
            del self.lengths[at]
        return piece

    def longest(self, most: int) -> Piece | None:
        """The longest piece of no more than ``most`` ids."""
        at = bisect_right(self.lengths, most) - 1
        return self._pop(at) if at >= 0 else None

    def __bool__(self) -> bool:
        return bool(self.lengths)


def _fill(window: list[Piece], gap: int, pool: Pool) -> int:
    """Adds pieces to a window until its gap is closed or nothing is left; the gap that stays."""
    while gap and pool:
        piece = pool.longest(gap)
        if piece is None:
            doc, start, length = pool.longest(pool.lengths[-1])
            piece = (doc, start, gap)
            pool.add((doc, start + gap, length - gap))
        window.append(piece)
        gap -= piece[2]
    return gap


def _powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """A window cut into windows whose lengths are powers of two."""
    left = sum(p[2] for p in window)
    queue = window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part: list[Piece] = []
        while room:
            doc, start, length = queue.pop()
            take = min(room, length)
            part.append((doc, start, take))
            if take < length:
                queue.append((doc, start + take, length - take))
            room -= take
        yield part


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Windows of a block of documents of these lengths; every one is as long as a power of two."""
    top = tiers[-1]
    windows: list[list[Piece]] = []
    pool = Pool()
    for doc, n in enumerate(lengths):
        whole = n // top * top
        windows += [[(doc, start, top)] for start in range(0, whole, top)]
        if n > whole:
            pool.add((doc, whole, n - whole))
    for shorter, tier in zip((*tiers[-2::-1], 0), tiers[::-1]):
        while pool and pool.lengths[-1] > shorter:
            first = pool.longest(tier)
            window = [first]
            if _fill(window, tier - first[2], pool):
                windows += _powers(window)
            else:
                windows.append(window)
    return windows


def step_groups(windows: list[list[Piece]], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """The group of each window."""
    size = [sum(p[2] for p in w) for w in windows]
    cost = [sum(p[2] ** 2 for p in w) for w in windows]
    groups = [(0, 0, g) for g in range(max(1, round(sum(size) / group_tokens)))]
    out = [0] * len(windows)
    for w in sorted(range(len(windows)), key=lambda w: (-size[w], -cost[w], w)):
        tokens, spent, g = groups[0]
        out[w] = g
        heapq.heapreplace(groups, (tokens + size[w], spent + cost[w], g))
    return out


def _check(tiers: tuple[int, ...]) -> None:
    if not tiers or list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers are ascending powers of two")


def pack(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group, ids): one row per piece.

    ``window`` is the length of the piece's sequence; ``ids`` are left out unless ``with_ids``.
    """
    _check(tiers)
    file = shared_file(docs, path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    numbers = T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long")
    schema = T.StructType([rows.schema["doc_id"], *numbers.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        encoder = Encoder(Vocabulary(file.value))
        base = TaskContext.get().partitionId() * NUMBERS
        sequences = groups = base

        def flush(names: list, data: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
            nonlocal sequences, groups
            windows = pack_block([len(x) // 4 for x in data], tiers)
            group = step_groups(windows, group_tokens)
            doc, numbers, ids = [], [], []
            for number, window in enumerate(windows):
                at, size = 0, sum(p[2] for p in window)
                for d, start, length in window:
                    piece = data[d][4 * start : 4 * (start + length)]
                    doc.append(d)
                    numbers.append((start, length, crc32(piece), len(data[d]) // 4, sequences + number, at, size, groups + group[number]))
                    if with_ids:
                        ids.append(piece)
                    at += length
            sequences += len(windows)
            groups += max(group, default=-1) + 1
            columns = [pa.array([names[d] for d in doc], kind), *map(pa.array, np.array(numbers, np.int64).T)]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([x[1] for x in numbers])))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        names, data, held, kind = [], [], 0, None
        for b, texts in numbered(batches, encoder):
            kind = b.column("doc_id").type
            for name, at in zip(b.column("doc_id").to_pylist(), texts):
                names.append(name)
                data.append(np.append(encoder.ids_of(at), end_id).astype("<u4").tobytes())
                held += len(data[-1]) // 4
                if held >= block_tokens:
                    yield flush(names, data, kind)
                    names, data, held = [], [], 0
        if data:
            yield flush(names, data, kind)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs, path, with_ids=False)
