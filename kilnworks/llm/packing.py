"""Cost-balanced packing of documents into fixed-length token sequences."""

from __future__ import annotations

import array
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._bytes import keep_in_worker
from .bpe import byte_letters

#: Bytes, about, of the tokenized words that a Python worker keeps, in each of two generations.
CACHE_BYTES = 64 << 20
#: A cut of words whose pieces are told without it where a word is letters, up to U+017F, and points and commas behind them:
#: NFC leaves those letters alone, and each but U+0130 has one lower-case letter.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of texts, about, whose words are taken together.
SLICE_BYTES = 1 << 23
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_cost", pa.float64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def works_by_word(path: str) -> bool:
    """Whether the tokenizer of this file lower-cases, cuts at every blank and drops it, so that words can be taken one by one."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = lambda part, inner: [] if not part else part[inner] if part["type"] == "Sequence" else [part]
    before, cut = steps(made.get("normalizer"), "normalizers"), steps(made.get("pre_tokenizer"), "pretokenizers")
    if made.get("post_processor") or [x["type"] for x in before] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cut] != ["Split", "ByteLevel"]:
        return False
    split = cut[0]
    words = split["behavior"] == "Removed" and split["invert"] and all(" " not in x for x in regex.findall(split["pattern"]["Regex"], "a b 's 1  ?! \u00e9 c"))
    return words and before[1]["pattern"] == {"Regex": "\\s+"} and before[1]["content"] == " " and not cut[1]["add_prefix_space"] and all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and x["content"].startswith("<|") for x in made["added_tokens"])


class WordTokens(dict):
    """Ids of a text as little-endian 32-bit bytes.

    Where the tokenizer drops white space and no rule of it reaches over a space (works_by_word), the ids of a text are
    those of its words in turn, each word tokenized once; else whole texts are tokenized. Special tokens' strings stay
    inside one word. Where the file cuts words as CUT does, a new word of common letters goes straight to the model,
    without the library's steps before it, which cost more than the merges. Words are kept in two generations of CACHE_BYTES: a full one becomes the old one, from which words
    that come again are taken over.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = works_by_word(path)
        with open(path, encoding="utf-8") as f:
            before = json.load(f)["pre_tokenizer"]
        self.model = self.tokenizer.model if self.by_word and before["pretokenizers"][0]["pattern"] == {"Regex": CUT} and not before["pretokenizers"][1]["use_regex"] else None
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def encoded(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word without blanks."""
        letters = word.rstrip(",.")
        if self.model is None or not letters.isalpha() or not letters.isascii() and (max(letters) > "\u017f" or "\u0130" in letters):
            return self.encoded(word)
        letters = letters.lower()
        # bytes as the letters that stand for them
        ids = [x.id for x in self.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters))]
        if word[-1] in ",.":
            ids += [x.id for x in self.model.tokenize(word[len(letters) :])]
        return array.array("I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.word(word.decode())
        if self.size > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[word] = found
        self.size += 170 + len(word) + len(found)  # two objects and a slot of the table
        return found

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self.encoded(text)
        words = text.encode("utf-8", "replace").replace(b"\n", b" ")
        if b"<|" not in words:  # special tokens are found before letters are lower-cased
            words = words.lower()
        return b"".join(map(self.__getitem__, words.split(b" ")))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """ids() of each text, null ones as empty; each different word of the column is looked up once."""
        if not self.by_word:
            yield from (self.encoded(text.as_py() or "") for text in texts)
            return
        texts = texts.fill_null("")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        found = pa.array([self[w] for w in words.dictionary.cast(pa.binary()).to_pylist()], pa.large_binary()).take(words.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist() if len(found) else [0] * (len(texts) + 1)
        data = memoryview(found.buffers()[2] or b"")
        yield from (data[a:b].tobytes() for a, b in zip(ends, ends[1:]))


def text_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in parts with about SLICE_BYTES bytes of texts (column 1), one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_tokens(path: str) -> WordTokens:
    return keep_in_worker("tokenizer", path, lambda: WordTokens(path))


def attention_cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then one for each power of two in what is left: no sequence needs padding."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack_lengths(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths, and each sequence's cost.

    Descending pieces go to the lowest-cost sequence with room. Only where none has room for the whole piece is it cut:
    the cheapest sequence with any room takes what it can and the rest is placed in turn. Sequences hold exactly the
    tokens there are.
    """
    room = np.array(capacities(sum(lengths), size), np.int64)
    cost = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        pieces.append((doc, start, length, seq, int(used[seq])))
        used[seq] += length
        room[seq] -= length
        cost[seq] += attention_cost(length, linear, quadratic)

    todo, full = [], 0
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= size:  # a full-length piece is a sequence of its own
            put(doc, start, size, full)
            full += 1
            start += size
        if length > start:
            todo.append((start - length, doc, start))
    heapq.heapify(todo)
    while todo:
        negative, doc, start = heapq.heappop(todo)
        length = -negative
        price = np.where(room >= length, cost, np.inf)
        chosen = int(price.argmin())
        if price[chosen] == np.inf:
            chosen = int(np.where(room > 0, cost, np.inf).argmin())
        taken = min(length, int(room[chosen]))
        put(doc, start, taken, chosen)
        if taken < length:
            heapq.heappush(todo, (taken - length, doc, start + taken))
    return pieces, cost.tolist()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, group_tokens: int = 1 << 22, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """Pack documents into sequences of `size` tokens, balancing estimated attention cost.

    One pass without a shuffle: a task tokenizes its rows and packs each group of about `group_tokens` tokens as soon
    as it is full, so memory is bounded by a group and the longest document. A group's last tokens go into sequences
    whose lengths are powers of two, so that no sequence has padding. sequence_id holds the task in its upper bits.

    A null text counts as empty and gives the end id alone. Repeated rows are packed as often as they occur; a null id
    stays null; other columns are not read; an empty table gives no rows. Ties of length go to the earlier row, ties of
    cost to the lower sequence.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_path)
        end = array.array("I", [end_id]).tobytes()
        next_id = TaskContext.get().partitionId() << 33
        group: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, tokens
            pieces, cost = pack_lengths([len(ids) // 4 for _, ids in group], size, linear, quadratic)
            for at in range(0, len(pieces), 8192):
                rows = [(group[d][0], s, n, zlib.crc32(memoryview(group[d][1])[4 * s : 4 * (s + n)]), len(group[d][1]) // 4, next_id + q, o, cost[q]) for d, s, n, q, o in pieces[at : at + 8192]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
            next_id += len(cost)
            group.clear()
            tokens = 0

        for batch in (part for whole in batches for part in text_parts(whole)):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.column(batch.column(1))):
                ids += end
                group.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= group_tokens:
                    yield from flush()
        if group:
            yield from flush()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES_DDL)
