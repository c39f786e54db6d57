"""Byte-pair encoding and decoding with a pair occurrence index.

Each task lists the distinct words it hasn't seen of ``LEARN_BYTES`` of text, and maps every adjacent symbol pair to all positions
where it occurs. The pairs with a rank are taken in ascending rank; all positions of a pair are merged at once and
only the lists of the pairs beside a merge change. No word and no normal form reaches over white space, so a text is
cut there, and the ids of each piece are kept for the task's later batches.

The vocabulary file (``tokenizers`` JSON: BPE with a word-end suffix, byte-level symbols, no decoder) is read on the
driver and broadcast; its size is fixed. Special tokens in a text are cut out before anything else, as that library
does. A null text counts as empty and has no ids; repeated rows stay repeated; an empty table gives an empty result;
further columns are ignored. Unknown ids are an error in ``decode``, nulls among them are skipped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, slices_by_bytes

#: Pieces kept per task with their ids; beyond that the memo starts anew.
MEMO_PIECES = 1_000_000
#: Pairs of ids are packed into one number.
WIDE = 1 << 32
#: Bytes of text (one text at least) whose unseen pieces share one index: its cost per rank hardly grows with their number.
LEARN_BYTES = 16 << 20
#: White space of the vocabulary's patterns.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next free one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in seen:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """Ids, ranks and text rules of one vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or spec["decoder"] is not None or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word-end BPE vocabulary")
        ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.set_merges([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]])
        symbols = byte_symbols()
        self.plain = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + self.suffix] for s in symbols], np.int64)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.lines = regex.compile(self.words.pattern + r"|\n")
        self.gaps, self.separators = regex.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))

    def set_merges(self, merges: list[tuple[int, int, int]]) -> None:
        """Merges (left, right, new) in ascending rank, with their pairs as sorted numbers for look-up."""
        made: dict[int, int] = {}
        for rank, (_, _, new) in enumerate(merges):
            made[new] = rank
        if any(rank <= made.get(x, -1) for rank, pair in enumerate(merges) for x in pair[:2]):
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.merges = merges
        pairs = np.array([a * WIDE + b for a, b, _ in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order

    def pieces(self, text: str) -> list[str]:
        """A text cut at white space; the separators U+001C to U+001F, which only ``str.split`` takes for it, stay."""
        return [x for x in self.gaps.split(text) if x] if self.separators.search(text) else text.split()

    def split(self, text: str) -> list:
        """The words of a text; a special token among them is a tuple of itself."""
        if not self.is_special(text):
            return self.words.findall(self._plain(text))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.words.findall(self._plain(text[at : m.start()])), (m[0],)]
            at = m.end()
        return out + self.words.findall(self._plain(text[at:]))

    def is_special(self, piece: str) -> bool:
        return "<|" in piece and self.cut.search(piece) is not None

    def _plain(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return text.lower()

    def split_pieces(self, pieces: list[str]) -> list:
        """The words of all pieces, with a line end after each piece's."""
        out, plain = [], []
        for p in pieces:
            if self.is_special(p):
                out += [*self._lines(plain), *self.split(p), "\n"]
                plain = []
            else:
                plain.append(p)
        return out + self._lines(plain) if out else self._lines(plain)

    def _lines(self, pieces: list[str]) -> list[str]:
        return self.lines.findall(self._plain("".join([p + "\n" for p in pieces])))

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and where each word's end, by one pair occurrence index over all of them.

        The index maps a pair, by its rank, to arrays of the positions where it stood when it arose; those where it no
        longer stands are passed over. No merge can make a pair of a lower rank than its own (checked on loading), so
        each rank is taken once.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.plain[data]
        ends = np.cumsum(length)
        symbol[ends - 1] = self.last[data[ends - 1]]
        place = np.arange(len(data))
        after, before = place + 1, place - 1
        after[ends - 1], before[ends - length] = -1, -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Puts the pairs that start at the given positions into the index."""
            key = symbol[at] * WIDE + symbol[after[at]]
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            known = self.pairs[found] == key
            ranks, at = self.ranks[found[known]], at[known]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                if lo < hi:
                    rank = int(ranks[lo])
                    if rank not in where:
                        where[rank] = []
                        heapq.heappush(active, rank)
                    where[rank].append(at[lo:hi])

        add(place[after >= 0])
        while active:
            rank = heapq.heappop(active)
            first, second, new = self.merges[rank]
            held = where.pop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            nxt = after[at]
            stands = (symbol[at] == first) & (nxt >= 0) & (symbol[nxt] == second)
            at, nxt = at[stands], nxt[stands]
            if first == second and len(at) > 1:  # runs of one symbol: leftmost pairs first
                taken: set[int] = set()
                keep = [not (i in taken or taken.add(j)) for i, j in zip(at.tolist(), nxt.tolist())]
                at, nxt = at[keep], nxt[keep]
            if not len(at):
                continue
            far = after[nxt]
            symbol[at], symbol[nxt], after[at] = new, -1, far
            has = far >= 0
            before[far[has]] = at[has]
            prior = before[at]
            add(np.concatenate((prior[prior >= 0], at[has])))
        left = symbol >= 0
        counts = np.add.reduceat(left, ends - length) if len(words) else np.zeros(0, np.int64)
        return symbol[left], np.cumsum(counts)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        return [x.tolist() for x in np.split(*self.word_ids(words))[:-1]] if words else []

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids if i is not None)


class _Numbers(dict):
    """Strings numbered as they come, from ``first`` on."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.first = first

    def __missing__(self, key: str) -> int:
        self[key] = n = self.first + len(self)
        return n


class Encoder:
    """A vocabulary with the ids of the pieces of text met so far in a task.

    ``names`` gives further forms of the ids: for each, a table of strings by id; a piece is kept with its strings joined
    by blanks.
    """

    def __init__(self, vocabulary: Vocabulary, *names: dict[int, str]):
        self.vocabulary = vocabulary
        self.tables = []
        for strings in names:
            self.tables.append(np.full(max(strings) + 1, None, object))
            for i, x in strings.items():
                self.tables[-1][i] = x
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.forms: list[list[str]] = [[] for _ in self.tables]

    def number(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The pieces of each text by number; those not met before are encoded together."""
        if len(self.numbers) > MEMO_PIECES:
            self._forget()
        known = len(self.numbers)
        at = [np.fromiter(map(self.numbers.__getitem__, self.vocabulary.pieces(t)), np.int32) for t in texts]
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        return at

    def _learn(self, pieces: list[str]) -> None:
        v = self.vocabulary
        flat = v.split_pieces(pieces)
        words = _Numbers()
        words["\n"]
        for t in v.special:
            words[(t,)]
        fixed = len(words)
        at = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
        ids, stops = v.word_ids(list(islice(words, fixed, None)))
        length = np.concatenate(([0], np.ones(len(v.special), np.int64), np.diff(stops, prepend=0)))
        ids = np.concatenate((np.fromiter(v.special.values(), np.int64), ids))
        ends = np.cumsum(length)
        piece_ids = gather(ids, (ends - length)[at], length[at])
        piece_ends = np.cumsum(length[at])[at == 0]
        for table, form in zip(self.tables, self.forms):
            names, stop = table[piece_ids].tolist(), piece_ends.tolist()
            form += [" ".join(names[lo:hi]) for lo, hi in zip([0, *stop], stop)]
        self.starts = np.concatenate((self.starts, len(self.ids) + np.concatenate(([0], piece_ends[:-1]))))
        self.lengths = np.concatenate((self.lengths, np.diff(piece_ends, prepend=0)))
        self.ids = np.concatenate((self.ids, piece_ids))

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        return gather(self.ids, self.starts[at], self.lengths[at])

    def text_of(self, form: int, at: list[int]) -> str:
        return " ".join(map(self.forms[form].__getitem__, at))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def numbered(batches: Iterable[pa.RecordBatch], encoder: Encoder, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the pieces of their texts (null: empty) by number."""
    for whole in batches:
        for b in slices_by_bytes(whole, text, LEARN_BYTES):
            yield b, encoder.number(t or "" for t in b.column(text).to_pylist())


def shared_file(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text."""
    file = shared_file(docs, path)

    def run(batches):
        encoder = Encoder(Vocabulary(file.value))
        for b, texts in numbered(batches, encoder):
            made = [encoder.ids_of(at).astype(np.int32) for at in texts]
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), ids], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each list of ids, special tokens kept (null list: empty text)."""
    file = shared_file(encoded, path)

    def run(batches):
        vocabulary = Vocabulary(file.value)
        for b in batches:
            texts = [vocabulary.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return map_batches(rows, run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass and keeps only digests."""
    file = shared_file(docs, path)

    def run(batches):
        vocabulary = Vocabulary(file.value)
        encoder = Encoder(vocabulary, {i: str(i) for i in vocabulary.tokens}, vocabulary.tokens)
        sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        for b, texts in numbered(batches, encoder):
            made = []
            for at in texts:
                pieces = at.tolist()
                made.append((int(encoder.lengths[at].sum()), sha(encoder.text_of(0, pieces)), sha(encoder.text_of(1, pieces))))
            n, ids, decoded = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    return rows.mapInArrow(run, schema)
