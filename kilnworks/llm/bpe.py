"""Byte-level BPE: texts to ids and ids to texts, by the merges of a tokenizer's file.

A long word's bytes are a doubly linked list of symbols. A priority queue holds the adjacent pairs that merge, by rank
and then place; the best is taken until none is left, and entries whose symbols have changed since are skipped. A short
word's are two lists, of symbols and of the ranks of pairs, in which the least is looked up each time. Decoding
concatenates the vocabulary's strings. Everything happens in one pass of the rows' own tasks.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ._bytes import keep_in_worker, small

#: How byte-level files cut a text into words.
WORDS = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: A match that ends this far before the end of a slice does not change with what follows.
LOOKAHEAD = 4
#: Characters of a text that are cut into words at once, and bytes of words with their ids that a worker keeps (about, of each of two generations).
SLICE, CACHE_BYTES = 1 << 18, 64 << 20
#: Bytes of a word up to which looking up the least rank each time takes less than a queue, and the rank of pairs that do not merge.
SHORT, NEVER = 64, 1 << 31


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others by turns from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The vocabulary and merges of a byte-level file, with a bounded cache of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or made.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"]):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        letters = byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        vocabulary = model["vocab"]
        self.byte_ids = [vocabulary[letters[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.lefts, self.rights, self.results = ([vocabulary[x] for x in side] for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.rank_of = dict(zip(zip(self.lefts, self.rights), range(len(pairs)))).get
        # of each left symbol, the ranks by right symbol; of two bytes, the rank
        nothing: dict[int, int] = {}
        self.after = dict.fromkeys(vocabulary.values(), nothing)
        for rank, (a, b) in enumerate(zip(self.lefts, self.rights)):
            if self.after[a] is nothing:
                self.after[a] = {}
            self.after[a][b] = rank
        self.byte_ranks = [[self.after[a].get(b, NEVER) for b in self.byte_ids] for a in self.byte_ids]
        self.added = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.bytes_of = {i: bytes(bytes_of[c] for c in token) for token, i in vocabulary.items()} | {i: s.encode() for s, i in self.added.items()}
        # in the place of each id its string, and behind them an empty one
        self.strings = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 2)], pa.large_binary())
        self.cut = regex.compile(WORDS)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word. An entry of the queue holds the rank of a merge above the place of its left symbol."""
        ids = list(map(self.byte_ids.__getitem__, word))
        if len(ids) <= SHORT:
            return self._merge_short(word, ids)
        rank_of, lefts, rights, results = self.rank_of, self.lefts, self.rights, self.results
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [rank << 32 | i for i, rank in enumerate(map(rank_of, zip(ids, ids[1:]))) if rank is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] != lefts[rank] or j >= n or ids[j] != rights[rank]:
                continue  # stale: one of the two has become part of another symbol
            ids[i] = made = results[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of((made, ids[k]))) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of((ids[h], made))) is not None:
                heappush(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def _merge_short(self, word: bytes, ids: list[int]) -> list[int]:
        after, results, of_bytes = self.after, self.results, self.byte_ranks
        ranks = [of_bytes[a][b] for a, b in zip(word, word[1:])]
        while ranks and (rank := min(ranks)) < NEVER:
            i = ranks.index(rank)
            ids[i] = made = results[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(made, NEVER)
            if i < len(ranks):
                ranks[i] = after[made].get(ids[i + 1], NEVER)
        return ids

    def _missing(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("i", self.merge(word.encode("utf-8", "replace"))).tobytes()
        if len(word) <= 64:  # longer ones hardly come twice
            if self.size > CACHE_BYTES:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[word] = found
            self.size += 200 + len(word) + len(found)
        return found

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text, as 32-bit integers, a slice of the text at a time."""
        at = 0
        for special in chain(self.special.finditer(text), [None]):
            stop = special.start() if special else len(text)
            size = SLICE
            while at < stop:
                end = min(stop, at + size)
                words = self.cut.findall(text, at, end)
                if end < stop:
                    reached = end
                    while words and reached > end - LOOKAHEAD:
                        reached -= len(words.pop())
                    if not words:  # one word is longer than the slice
                        size *= 2
                        continue
                    end = reached
                young, missing = self.young, self._missing
                yield b"".join([young.get(w) or missing(w) for w in words])
                at, size = end, SLICE
            if special:
                yield array("i", [self.added[special.group()]]).tobytes()
                at = special.end()

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join(self.pieces(text))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings in turn; unknown ids give nothing, and bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")

    def decode_column(self, lists: pa.Array) -> pa.Array:
        """decode() of each list of a column; null for a null one."""
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        known = pa.array(np.where((ids >= 0) & (ids < len(self.strings)), ids, len(self.strings) - 1))
        joined = self.strings.take(known)
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
        cuts = np.frombuffer(joined.buffers()[1], np.int64)[ends] if len(joined) else ends
        if cuts[-1] < 1 << 31:
            texts = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(cuts.astype(np.int32)), joined.buffers()[2] or pa.py_buffer(b"")])
            try:
                texts.validate(full=True)
                return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            except pa.ArrowInvalid:  # some bytes are no UTF-8
                pass
        return pa.array([None if x.values is None else self.decode(x.values.to_pylist()) for x in lists], pa.string())


def merges(path: str) -> Merges:
    return keep_in_worker("bpe", path, lambda: Merges(path))


def _without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df other than these; column names are told apart as Spark does, without regard to case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", batch_rows: int = 256) -> DataFrame:
    """The other columns, and the ids of each whole text in place of the text, as the file's tokenizer gives them without special tokens of its own.

    Strings of added tokens in a text are those tokens. Null and empty texts give an empty list; repeated rows stay; a
    column that is named as the ids gives way to them; an empty table gives no rows. A long text is cut into words in
    slices, so that beside it and its ids little is held; a word costs n log n, however long it is.
    """
    others = _without(docs, text_col, ids_col)
    rows = docs.select(docs[text_col].cast("string").alias(ids_col), *(docs[c] for c in others))
    made = StructType([StructField(ids_col, ArrayType(IntegerType(), False), False), *rows.schema.fields[1:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(path)
        for batch in small(batches, batch_rows):
            coded = [b"".join(bpe.pieces(text.as_py() or "")) for text in batch.column(0)]
            offsets = np.zeros(len(coded) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
            ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], names=batch.schema.names)

    return rows.mapInArrow(run, made)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """The other columns, and the text of each list of ids beside it.

    Special tokens' strings are kept. A null list gives a null text, an empty one an empty text, and ids that the
    vocabulary lacks or that are null give nothing; a column that is named as the text gives way to it.
    """
    rows = coded.select(*_without(coded, text_col))
    made = StructType([*rows.schema.fields, StructField(text_col, StringType())])
    at = rows.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(path)
        for batch in small(batches, batch_rows):
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode_column(batch.column(at))], names=[*batch.schema.names, text_col])

    return rows.mapInArrow(run, made)
