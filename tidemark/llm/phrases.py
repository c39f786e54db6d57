"""Phrase collocations from a weighted de Bruijn graph of words.

Texts lose their capitals A-Z, fall into pieces at ``[.,;:!?`` and line ends ``]`` and the pieces into words at blanks and tabs;
everything is counted per language. Every word position gives one gram: its word and up to three more, shorter only where
the piece ends. The graph's edges are the grams of four words, from the node of their first three words to that of their
last three; the shorter grams are piece-end corrections. Grams are added up once, by task and then by Spark; all shorter
counts follow from flow: a node counts what leaves it plus the pieces that end in it, a pair what its nodes count plus the
pieces that end in it, a word likewise.

Nodes through which one edge's whole flow passes into one other edge are unary; edges joined by such nodes are compacted into
paths by pointer doubling, in as many rounds as the logarithm of the longest path. Paths stand for all their
edges and inner nodes: they cover the phrases of three words, as nodes cover those of two, so that the rule on longer
candidates reads a row a word.

A phrase counts only from ``least`` occurrences on, and so do its parts; so a position's gram ends early where it would become
surely rarer. A first pass adds all grams of one to four words into hashed counters (no counter is below the true count, so
no phrase is lost): one for every ``BYTES_PER_COUNTER`` bytes of text or more, up to 2^``SKETCH_BITS``; a counter is a byte in a task (compressed when
sent), a bit when broadcast. Where the counters are too few for the input they exclude less and the shuffle carries up to all grams; results
don't change.

Null texts are empty, a null language is ``und``; repeated rows count again; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import slices_by_bytes, staged

LEAST, TOP, MOST_WORDS = 30, 2000, 4
#: A phrase goes if a longer candidate around it has COVER hundredths of its occurrences or more.
COVER = 80
SCALE = 2_000_000
#: Counters: at least 2^16, at most 2^SKETCH_BITS; bytes of text for each; counters in one row of the reduction.
SKETCH_BITS, BYTES_PER_COUNTER, CHUNK = 27, 16, 1 << 16
#: Bytes of text whose words are numbered together.
GROUP_BYTES = 16 << 20
#: Parts of one word, which many phrases share, are dealt over so many tasks.
SALTS = 16
#: The separators of pieces and of words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

#: No byte of UTF-8: stands for a piece's end.
_END = b"\xff"
_WORDS = [f"w{i}" for i in range(1, MOST_WORDS + 1)]


def _byte_table() -> bytes:
    table = bytearray(bytes(range(256)).lower())
    for b in PIECE_ENDS:
        table[b] = _END[0]
    return bytes(table)


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Group:
    """Some texts of one language: the number of the word at each position, 0 at piece ends."""

    def __init__(self, lang: str, texts: list[bytes], table: bytes):
        numbers = _Numbers({_END: 0})
        flat = _END.join([*texts, b""]).translate(table).replace(_END, b" \xff ").split()
        self.at = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        self.words = list(numbers)
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def buckets(self, bits: int) -> list[np.ndarray]:
        """The counter of each word, then of the gram of two, three and four words that starts at each position."""
        shift = np.uint64(64 - bits)
        each = self.hashes[self.at]
        out, gram = [(self.hashes >> shift).astype(np.int64)], each
        for k in range(1, MOST_WORDS):
            gram = (gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + (each[k:] ^ (each[k:] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((gram >> shift).astype(np.int64))
        return out

    def count_into(self, counters: np.ndarray, bits: int) -> None:
        """Adds all grams to the counters, which stop at their greatest value."""
        words, *longer = self.buckets(bits)
        word, place = np.unique(words[1:], return_inverse=True)
        times = np.bincount(place, np.bincount(self.at, minlength=len(words))[1:], len(word)).astype(np.int64)
        inside, parts = self.at > 0, [(word, times)]
        for k, bucket in enumerate(longer, 1):
            inside = inside[:-1] & (self.at[k:] > 0)
            parts.append(np.unique(bucket[inside], return_counts=True))
        for bucket, n in parts:
            counters[bucket] = np.minimum(counters[bucket] + n, np.iinfo(counters.dtype).max)

    def grams(self, common: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct grams, as the numbers of their words (0: none), and their occurrences."""
        words, *longer = self.buckets(bits)
        known = _bit(common, words)
        known[0] = False
        go = known[self.at]  # positions whose gram of this many words, and all within it, may be common
        reach = go.astype(np.int64)
        for bucket in longer:
            go = go[:-1] & go[1:]
            go[go] = _bit(common, bucket[go])
            reach[: len(go)] += go
        alone = np.bincount(self.at[reach == 1], minlength=len(words))
        single = np.flatnonzero(alone)
        at = np.flatnonzero(reach > 1)
        column = [np.where(reach[at] > k, self.at[np.minimum(at + k, len(self.at) - 1)], 0) for k in range(MOST_WORDS)]
        head, h = np.unique((column[0] << 32) | column[1], return_inverse=True)
        tail, t = np.unique((column[2] << 32) | column[3], return_inverse=True)
        both, n = np.unique((h << 32) | t, return_counts=True)
        head, tail, low = head[both >> 32], tail[both & 0xFFFFFFFF], 0xFFFFFFFF
        none = np.zeros(len(single), np.int64)
        merged = [np.append(single, head >> 32), *(np.append(none, c) for c in (head & low, tail >> 32, tail & low))]
        return merged, np.append(alone[single], n)


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _groups(batches) -> Iterator[tuple[str, _Group]]:
    table = _byte_table()
    for whole in batches:
        for b in slices_by_bytes(whole, "text", GROUP_BYTES):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, mine in texts.items():
                yield lang, _Group(lang, mine, table)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _common(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """One bit for each counter: set unless all its words and pairs are surely rarer than ``least``."""
    size = min(CHUNK, 1 << bits)

    def count(batches):
        counters = np.zeros(1 << bits, np.uint8)
        for _, group in _groups(batches):
            group.count_into(counters, bits)
        used = np.flatnonzero(counters.reshape(-1, size).any(1))
        for i in range(0, len(used), 16):
            part = used[i : i + 16]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([zlib.compress(counters[c * size : (c + 1) * size].tobytes(), 1) for c in part], pa.binary())], names=["chunk", "counters"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("counters").to_pylist()):
                held = total.setdefault(chunk, np.zeros(size, np.uint16))
                np.minimum(held + np.frombuffer(zlib.decompress(data), np.uint8), 255, out=held)
        bits = [np.packbits(x >= min(least, 255), bitorder="little").tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.mapInArrow(count, "chunk int, counters binary").repartition("chunk").mapInArrow(add, "chunk int, bits binary").toLocalIterator():
        out[r["chunk"] * size // 8 : (r["chunk"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def edges(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1, w2, w3, w4, n): edges, piece-end corrections (later words null), and a language's words (all words null)."""
    rows = _rows(docs, text, lang)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SKETCH_BITS, max(16, (volume // BYTES_PER_COUNTER).bit_length()))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, least, bits))

    def emit(batches):
        for language, group in _groups(batches):
            grams, n = group.grams(common.value, bits)
            words = pa.array([None, *group.words[1:]], pa.binary()).view(pa.string())
            columns = [words.take(pa.array(np.append(c, 0))) for c in grams]
            n = np.append(n, np.count_nonzero(group.at))
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), *columns, pa.array(n, pa.int64())], names=["lang", *_WORDS, "n"])

    return rows.mapInArrow(emit, f"lang string, {', '.join(f'{w} string' for w in _WORDS)}, n long").groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))


def counts(graph: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, n) of all phrases with ``least`` occurrences, from the written edges by flow."""
    known = graph.where("w1 IS NOT NULL")
    flow, out = known.where("w4 IS NOT NULL"), []
    for size in range(MOST_WORDS, 0, -1):
        key = ["lang", *_WORDS[:size]]
        if size < MOST_WORDS:
            ends = known.where(F.col(_WORDS[size - 1]).isNotNull() & F.col(_WORDS[size]).isNull())
            flow = staged(flow.select(*key, "n").unionByName(ends.select(*key, "n")).groupBy(*key).agg(F.sum("n").alias("n")), f"phrase-flow-{size}")
        out.append(flow.where(F.col("n") >= least).select("lang", F.concat_ws(" ", *_WORDS[:size]).alias("phrase"), F.lit(size).alias("size"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _first(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def paths(frequent: DataFrame) -> DataFrame:
    """(lang, words, n): maximal paths through unary nodes; an edge that meets none is a path of four words."""
    p = F.col("phrase")
    node = frequent.where(F.col("size") == MOST_WORDS - 1).select("lang", F.col("phrase").alias("node"), "n")
    edge = frequent.where(F.col("size") == MOST_WORDS).select("lang", "phrase", "n", _first(p, MOST_WORDS - 1).alias("from"), _first(p, 1 - MOST_WORDS).alias("to"))
    into = edge.select("lang", F.col("to").alias("node"), "n", F.col("phrase").alias("before"))
    out = edge.select("lang", F.col("from").alias("node"), "n", F.col("phrase").alias("edge"))
    links = node.join(into, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", "edge", "before")
    start = edge.select("lang", F.col("phrase").alias("edge"), "n").join(links, ["lang", "edge"], "left")
    step = staged(start.select("lang", "edge", "n", F.coalesce("before", "edge").alias("head"), F.col("before").isNotNull().cast("int").alias("away")), "phrase-links")
    while True:
        on = step.select("lang", F.col("edge").alias("head"), F.col("head").alias("beyond"), F.col("away").alias("more"))
        jump = step.join(on, ["lang", "head"])
        moved = (F.col("more") > 0).alias("moved")
        step = staged(jump.select("lang", "edge", "n", F.col("beyond").alias("head"), (F.col("away") + F.col("more")).alias("away"), moved), "phrase-links")
        if step.where("moved").isEmpty():
            break
    chain = step.groupBy("lang", "head", "n").agg(F.array_sort(F.collect_list(F.struct("away", _first(F.col("edge"), -1).alias("word")))).alias("chain"))
    rest = F.transform(F.slice("chain", F.lit(2), F.size("chain")), lambda x: x["word"])
    return chain.select("lang", F.concat(F.split("head", " "), rest).alias("words"), "n")


def _covers(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, cover): the most occurrences of a longer candidate around a phrase.

    A pair within a candidate of four words lies within one of three, which is at least as frequent.
    """
    width = MOST_WORDS - 1
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (width - 1)), lambda i: F.array_join(F.slice("words", i, width), " "))
    three = paths(frequent).select("lang", F.explode(windows).alias("phrase"), "n")
    p = F.col("phrase")
    two = frequent.where("size = 3").select("lang", F.explode(F.array(_first(p, 2), _first(p, -2))).alias("phrase"), "n")
    return three.unionByName(two).groupBy("lang", "phrase").agg(F.max("n").alias("cover"))


def _wide(c) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, l, r, score) of the candidates that no longer one covers, by their lowest cut."""
    free = F.col("cover").isNull() | (_wide("cover") * 100 < _wide("n") * COVER)
    candidates = frequent.where("size > 1").join(_covers(frequent), ["lang", "phrase"], "left").where(free)
    size, p, salt = F.col("size"), F.col("phrase"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cut = candidates.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    rest = F.expr("substring_index(phrase, ' ', k - size)")
    cut = cut.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left_part"), rest.alias("right_part"), salt.alias("salt"), "size")
    single = F.when(size == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    parts = frequent.where(size < MOST_WORDS).select(F.col("lang"), p.alias("part"), F.col("n").alias("part_n"), F.explode(single).alias("part_salt"))
    for side, name, words in (("left_part", "l", F.col("k")), ("right_part", "r", size - F.col("k"))):
        part = parts.select("lang", F.col("part").alias(side), F.col("part_n").alias(name), "part_salt")
        cut = cut.withColumn("part_salt", F.when(words == 1, F.col("salt")).otherwise(0)).join(part, ["lang", side, "part_salt"]).drop("part_salt")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = cut.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    graph = staged(edges(docs, least, text, lang), "phrase-graph")
    found = scored(staged(counts(graph, least), "phrase-counts"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = graph.where("w1 IS NULL").select("lang", "n")
    return best.join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


MINE_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents WHERE text IS NOT NULL),
words AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda w: w <> '') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, g, unnest(list_transform(range(1, len(ws) - g + 2), lambda i: array_to_string(ws[i : i + g - 1], ' '))) AS phrase FROM words, range(1, {MOST_WORDS + 1}) t(g)),
f AS MATERIALIZED (SELECT lang, g, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
inner_of AS (SELECT lang, a, unnest(list_concat(list_transform(range(1, 3), lambda i: array_to_string(string_split(phrase, ' ')[i : i + g - 2], ' ')),
    list_transform(range(1, CASE WHEN g = 4 THEN 4 ELSE 1 END), lambda i: array_to_string(string_split(phrase, ' ')[i : i + 1], ' ')))) AS phrase FROM f WHERE g > 2),
covered AS (SELECT lang, phrase, max(a) AS cover FROM inner_of GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1 : g], ' ') AS y
  FROM f LEFT JOIN covered USING (lang, phrase), range(1, 4) t(k) WHERE g > 1 AND k < g AND (cover IS NULL OR 100::HUGEINT * cover < {COVER}::HUGEINT * a)),
scores AS (SELECT c.lang, c.phrase, c.a, c.k, p.a AS l, q.a AS r, CAST({SCALE}::HUGEINT * c.a // (p.a::HUGEINT + q.a) AS BIGINT) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.x JOIN f q ON q.lang = c.lang AND q.phrase = c.y),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""
