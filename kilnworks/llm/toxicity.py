"""Toxicity scores of texts restored by a noisy-channel decoder."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, keep_in_worker, mix, small, span_hashes, text_slices, word_spans
from ._common import materialize, release
from .jaccard import shingle_sets

#: Symbols of the language model: 0 is a word's edge, 1 to 26 are a to z, 27 is any byte beyond ASCII.
SYMBOLS = 28
#: What a writer may put for a letter: fixed values of leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "%": "x"}
#: Costs of the channel, as negative log probabilities: a substitution, a letter written again, and a mark put between letters.
SUBSTITUTED, REPEATED, SPACED = 1.0, 0.5, 0.5
#: And a sign that stands for nothing, within a word and at its ends.
DROPPED_SIGN, DROPPED_END = 9.0, 0.1
#: The share of toxic texts among those with a feature that marks toxicity, and the share of features that do.
PURITY, PRIOR = 0.995, 1e-8
#: Longer words and runs are decoded in pieces of twice this length, each starting this far after the one before.
LONGEST = 64

#: How much dearer than the cheapest cut of a run into words one may be for its words to count.
SLACK = 6.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[128:] = 27
#: (letter, symbol, cost) that a letter or sign of ASCII may stand for.
_OPTIONS = {chr(c): [(chr(c), c - 96, 0.0)] for c in range(ord("a"), ord("z") + 1)}
_OPTIONS |= {sign: [(x, ord(x) - 96, SUBSTITUTED + (0.0 if len(letters) < 3 else 1.5)) for x in letters] for sign, letters in LEET.items()}
_MARKS = re.compile(f"[^a-z\x80-\xff{re.escape(''.join(LEET))}]+")
#: By code point, what folded() makes of a character: 0 leaves it, _GONE takes it away, any other byte takes its place.
_UNKNOWN, _GONE = 255, 254
_FOLD = np.full(0x110000, _UNKNOWN, np.uint8)


def _fold(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    if kind == "Cf":
        return _GONE  # soft hyphens, joiners and marks of direction have no width
    if kind[0] == "Z" or kind == "Cc":
        return ord(" ")
    if kind[0] in "PS":
        plain = "!" if c == "\u00a1" else unicodedata.normalize("NFKC", c)
        return ord(plain) if len(plain) == 1 and "!" <= plain <= "~" and not plain.isalnum() else ord("'")
    return 0


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with blanks, marks and signs beyond ASCII as single bytes of ASCII, and without characters of no width; letters stay."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return data, offsets
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x7F >> size)
    whole = np.ones(len(lead), bool)
    for i in (1, 2, 3):
        tail = padded[lead + i].astype(np.int64)
        code = np.where(i < size, code << 6 | tail & 0x3F, code)
        whole &= (i >= size) | (tail & 0xC0 == 0x80)
    lead, size, code = (x[whole & (code < len(_FOLD))] for x in (lead, size, code))
    new = np.unique(code[_FOLD[code] == _UNKNOWN])
    _FOLD[new] = [_fold(int(c)) for c in new]
    to = _FOLD[code]
    lead, size, to = (x[to > 0] for x in (lead, size, to))
    if not len(lead):
        return data, offsets
    data, keep = data.copy(), np.ones(len(data), bool)
    data[lead] = to
    keep[lead[to == _GONE]] = False
    for i in (1, 2, 3):
        keep[lead[i < size] + i] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class CharacterModel:
    """Negative log probabilities of a symbol after two others, with add-one smoothing by the shorter history."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        one = three.sum(axis=(0, 1)) + 1
        one /= one.sum()
        two = three.sum(axis=0) + 20 * one[None, :]
        two /= two.sum(axis=1, keepdims=True)
        three = three + 20 * two[None, :, :]
        self.counts = counts
        self.cost = -np.log(three / three.sum(axis=2, keepdims=True))
        self.table: list[list[list[float]]] = self.cost.tolist()
        self.known: dict[tuple[str, bool], str] = {}
        self.read: dict[tuple[bytes, bool], list[bytes]] = {}

    def __reduce__(self):
        return shared_model, (np.asarray(self.counts, np.int64).tobytes(),)

    def decode(self, word: str, edges: bool = False) -> str:
        """The likeliest letters for a disguised word: a Viterbi search over the lattice of what each character may stand for.

        States are the last two letters. A letter stands for itself or, after the same one, for a repetition; a sign for
        the letters it replaces; any other mark, and a sign too, for nothing where letters stand on both sides. Bytes
        beyond ASCII, one character each, stand for themselves. With edges a word may end before any character.
        """
        if (word, edges) in self.known:
            return self.known[word, edges]
        table, last = self.table, len(word) - 1
        # state: (letter before last, last letter) -> (cost, letters)
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        runs = [len(m.group()) for m in re.finditer(r"(.)\1*", word, re.S) for _ in m.group()] if re.search(r"(.)\1\1", word, re.S) else [1] * len(word)
        for i, c in enumerate(word):
            plain = "a" <= c <= "z"
            options = _OPTIONS.get(c) or ([(c, 27, 0.0)] if c >= "\x80" else [])
            if len(states) == 1 and runs[i] < 3 and not edges and (plain or c >= "\x80"):
                # nothing to choose: the one state goes on by the letter itself
                ((a, b), (cost, text)), (letter, s, _) = *states.items(), *options
                states = {(b, s): (cost + table[a][b][s], text + letter)}
                continue
            after: dict[tuple[int, int], tuple[float, str]] = {}
            if edges and i:
                ended = min(((cost + table[a][b][0], text) for (a, b), (cost, text) in states.items() if b), default=None)
                if ended and ((0, 0) not in states or ended < states[0, 0]):
                    states[0, 0] = ended
            sign = c in LEET
            left_out = None
            if not plain and c < "\x80":
                inner = 0 < i < last
                left_out = SPACED if inner and not sign else DROPPED_SIGN if inner or c.isdigit() or c in "@$" else DROPPED_END
            for (a, b), (cost, text) in states.items():
                row = table[a][b]
                offers = [((b, s), (cost + paid + row[s], text + letter)) for letter, s, paid in options]
                if i and b and runs[i] > 2 and ((plain and text[-1:] == c) or (sign and text[-1:] in LEET[c])):
                    offers.append(((a, b), (cost + REPEATED, text)))  # written again; twice is meant
                if left_out is not None:
                    offers.append(((a, b), (cost + left_out, text)))
                for key, offer in offers:
                    if key not in after or offer < after[key]:
                        after[key] = offer
            states = after
        best = min(((cost + table[a][b][0], text) for (a, b), (cost, text) in states.items()), default=(0.0, ""))[1]
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word, edges] = best
        return best

    def words_in(self, letters: str) -> list[tuple[int, int]]:
        """(start, stop) of the words of all ways to cut the letters that cost at most SLACK more than the cheapest."""
        s = np.array([ord(c) - 96 if c < "\x80" else 27 for c in letters])
        n, cost = len(s), self.cost
        if n < 2:
            return [(0, n)]
        inner = np.concatenate([[0, 0, 0], np.cumsum(cost[s[:-2], s[1:-1], s[2:]])])  # of the letters that follow two, up to each place
        word = np.full((n + 1, n + 1), np.inf)
        word[: n - 1, 2:] = np.where(np.arange(2, n + 1)[None, :] >= np.arange(2, n + 1)[:, None], (cost[0, 0, s[:-1]] + cost[0, s[:-1], s[1:]] - inner[2:])[:, None] + (inner[2:] + cost[s[:-1], s[1:], 0])[None, :], np.inf)
        word[np.arange(n), np.arange(1, n + 1)] = cost[0, 0, s] + cost[0, s, 0]
        to, after = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            to[j] = (to[:j] + word[:j, j]).min()
        for i in range(n - 1, -1, -1):
            after[i] = (after[i + 1 :] + word[i, i + 1 :]).min()
        return [(int(i), int(j)) for i, j in np.argwhere(to[:, None] + word + after[None, :] <= to[n] + SLACK)]

    def readings(self, word: bytes, edges: bool) -> list[bytes]:
        """A disguised word as one word and, with edges, the likely words in it; of a long one only those, from overlapping pieces.

        A character written more than four times in a long one counts four times. Words that a piece's ends cut are
        left to its neighbours.
        """
        if (word, edges) in self.read:
            return self.read[word, edges]
        text = word.decode("latin-1")
        if len(text) > LONGEST:
            text = re.sub(r"(.)\1{4,}", r"\1\1\1\1", text, flags=re.S)
        long = len(text) > LONGEST
        found = [] if long else [self.decode(text.replace(" ", ""))]
        for start in range(0, max(1, len(text) - LONGEST), LONGEST) if edges or long else ():
            stop = start + 2 * LONGEST
            parts = [self.decode(part, True) for part in text[start:stop].split(" ")]
            for at, letters in enumerate(parts):
                cut = (start > 0 and at == 0, stop < len(text) and at == len(parts) - 1)
                found += [letters[i:j] for i, j in self.words_in(letters) if not (cut[0] and i == 0 or cut[1] and j == len(letters))]
        if edges:  # marks may part words too
            found += [self.decode(w) for w in _MARKS.split(text) if 3 <= len(w) <= LONGEST and w != text and any(c in LEET for c in w)]
        if len(self.read) > 200_000:
            self.read.clear()
        out = [w.encode("latin-1") for w in dict.fromkeys(found) if w]
        if not long:
            self.read[word, edges] = out
        return out


def shared_model(counts: bytes) -> CharacterModel:
    """The model of these counts: one in a worker, whatever tasks it runs, so that words it has decoded stay known."""
    return keep_in_worker("characters", counts, lambda: CharacterModel(np.frombuffer(counts, np.int64)))


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all symbol trigrams within the words of all texts; SYMBOLS**3 numbers come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in small(batches):
            for _, data, offsets in text_slices(batch.column(0)):
                data, offsets = folded(data, offsets)
                # two edges stand between rows, so no trigram reaches over one
                s = np.zeros(len(data) + 2 * len(offsets), np.int64)
                s[np.arange(len(data)) + 2 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _SYMBOL[_LOWER[data]]
                before = np.concatenate([[0], s[:-1]])
                # a word's first letter follows two edges, whatever ended the word before
                older = np.where(before == 0, 0, np.concatenate([[0, 0], s[:-2]]))
                use = (s > 0) | (before > 0)
                total += np.bincount((older * SYMBOLS + before)[use] * SYMBOLS + s[use], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["at", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts


def suspicious(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes, bool]]:
    """(row, disguised word, whether it may be several) for blank-separated words that mix letters with signs or marks or repeat letters, and for runs of single characters, joined.

    A run keeps a blank where its characters stand further apart than elsewhere in it.
    """
    if not len(starts):
        return []
    upto = lambda marked: np.concatenate([[0], np.cumsum(marked)])
    letters, signs, wide, leads = upto(_LETTER[data] & (data < 128)), upto(_LEET[data]), upto(data >= 128), upto(data >= 0xC0)
    same = np.zeros(len(data) + 1, np.int64)
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
    same[1:] = np.cumsum(triple)
    n = stops - starts
    plain, odd, broad = letters[stops] - letters[starts], signs[stops] - signs[starts], wide[stops] - wide[starts]
    has = plain + leads[stops] - leads[starts]  # letters beyond ASCII count once
    inner = np.minimum(starts + 2, stops)
    thrice = same[stops] - same[inner] > 0
    last = (stops - 1).clip(0)
    trimmed = has + odd + ~_LETTER[data[last]]  # closing punctuation is no disguise
    marks = n - plain - odd - broad
    word = (plain >= 1) & (((odd >= 1) & (has + odd >= 3)) | ((has >= 3) & thrice) | ((has + odd >= 3) & (marks >= 2) & (marks >= has + odd - 2) & (trimmed > 0)))
    # marks that only close a word part nothing
    several = marks > ~(_LETTER | _LEET)[data[last]]
    held = data.tobytes()
    out = [(row, held[i:j], edges) for row, i, j, edges in zip(*(x[word].tolist() for x in (rows, starts, stops, several)))]
    single = (has + odd == 1) & (marks == 0) & (n == plain + odd + broad)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        cuts = np.flatnonzero(np.diff(rows[a:b])) + a + 1
        for x, y in zip([a, *cuts], [*cuts, b]):
            if y - x >= 3:
                gaps = starts[x + 1 : y] - stops[x : y - 1]
                apart = np.concatenate([[False], gaps > gaps.min()])
                out.append((int(rows[x]), b"".join(b" " * int(w) + data[i:j].tobytes() for i, j, w in zip(starts[x:y], stops[x:y], apart)), True))
    return out


def features(column: pa.Array, model: CharacterModel, kinds: tuple[int, ...] = (0, 4, 5, 6), explained: Lookup | None = None, restored: pa.Array | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows, feature hashes): every word of the restored text, and its first 4, 5 and 6 bytes.

    Words are runs of letters, also of those beyond ASCII. A disguised word gives the features of its restored letters
    besides those of its own parts, and one that may be several words those of its likeliest words too. kinds picks whole words (0) and beginnings; explained words give no beginnings.
    restored, if given, has the restored words of each row (restored_words) and saves decoding them.
    """
    for first, data, offsets in text_slices(column):
        data, offsets = folded(_LOWER[data], offsets)
        starts, stops, rows = word_spans(data, offsets, _BLANK)
        if restored is None:
            more = _decoded(model, data, starts, stops, rows)
        else:
            more = [(i, word) for i in range(len(offsets) - 1) for word in (restored[first + i].as_py() or b"").split()]
        parts = [(data, *word_spans(data, offsets, ~_LETTER))]
        if more:
            joined = np.frombuffer(b"".join(w for _, w in more), np.uint8)
            ends = np.cumsum([len(w) for _, w in more])
            parts.append((joined, np.concatenate([[0], ends[:-1]]), ends, np.array([r for r, _ in more])))
        at, hashes = [], []
        for bytes_, a, b, r in parts:
            if not len(a):
                continue
            whole = mix(span_hashes(bytes_, a, b) + U(0))
            other = np.ones(len(a), bool) if explained is None else ~explained.holds(whole)
            for k in kinds:
                own = (b - a > k) & other if k else slice(None)
                hashes.append(mix(span_hashes(bytes_, a[own], a[own] + k) + U(k)) if k else whole)
                at.append(r[own])
        if at:
            yield first, np.concatenate(at), np.concatenate(hashes)


def _decoded(model: CharacterModel, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    """(row, word) of all readings of the suspicious words."""
    return [(row, text) for row, word, edges in suspicious(data, starts, stops, rows) for text in model.readings(word, edges)]


def restored_words(model: CharacterModel):
    """Rows of text and toxic with restored: what the disguised words of each text are read as, between blanks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            words: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for first, data, offsets in text_slices(batch.column(0)):
                data, offsets = folded(_LOWER[data], offsets)
                for row, word in _decoded(model, data, *word_spans(data, offsets, _BLANK)):
                    words[first + row].append(word)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b" ".join(w) for w in words], pa.binary())], names=["text", "toxic", "restored"])

    return run


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


class Lookup:
    """Weights by feature hash, behind a bitmap that turns most features away."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(hashes & U(0xFFFFF)).astype(np.int64)] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        known = self.bitmap[(hashes & U(0xFFFFF)).astype(np.int64)]
        if known.any():
            known[known] = np.isin(hashes[known], self.hashes)
        return known

    def find(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (rows, places in the table) of the features that are known."""
        maybe = self.bitmap[(hashes & U(0xFFFFF)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        if not len(self.hashes) or not len(rows):
            return rows[:0], np.zeros(0, np.int64)
        place = np.searchsorted(self.hashes, hashes).clip(0, len(self.hashes) - 1)
        hit = self.hashes[place] == hashes
        rows, place = _distinct(rows[hit], place[hit].astype(np.uint64))
        return rows, place.astype(np.int64)


def _counts(model: CharacterModel, only: Lookup | None, kinds: tuple[int, ...], explained: Lookup | None):
    """Documents that have a feature, by label: all features of toxic documents, or the known ones of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, rows, hashes in features(batch.column(0), model, kinds, explained, batch.column(2)):
                if only is None:
                    keep = toxic[first + rows] == 1
                    rows, hashes = _distinct(rows[keep], hashes[keep])
                else:
                    rows, place = only.find(rows, hashes)
                    hashes = only.hashes[place]
                label = toxic[first + rows]
                found, at = np.unique(hashes, return_inverse=True)
                positive = np.bincount(at, label == 1, len(found)).astype(np.int64) if len(found) else np.zeros(0, np.int64)
                every = np.bincount(at, minlength=len(found)) if len(found) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(positive), pa.array(every - positive)], names=["feature", "positive", "negative"])

    return run


class ToxicityModel:
    """What score() needs: the character model, and -log(1 - p) of each feature and of a text without any.

    A text's score is a noisy or: the probability that at least one of its features marks it.
    """

    def __init__(self, characters: CharacterModel, lookup: Lookup, bias: float) -> None:
        self.characters, self.lookup, self.bias = characters, lookup, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample_rows: int = 20_000, min_docs: int = 5) -> ToxicityModel:
    """Fit on rows whose crc32(id as text) is no multiple of `folds`.

    The character model counts all documents. The classifier is fitted on at most sample_rows labelled ids, those of
    the smallest hashes (a broadcast of sample_rows pairs), near copies left out; of rows that share an id the smallest
    text is read. Its features are all that min_docs toxic rows of the sample hold at least, and that toxic rows hold
    more than four times as often as others. A label that is null or neither 0 nor 1, and rows whose labels disagree,
    are left out.
    """
    characters = CharacterModel(trigram_counts(docs, text_col))
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % folds != 0).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select("id", "toxic")
    chosen = materialize(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "toxicity-ids")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = materialize(texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    kept = unlike(rows)  # sample_rows pairs at most
    if not kept:
        return ToxicityModel(characters, Lookup(np.zeros(0, np.uint64), np.zeros(0)), 0.0)
    rows = rows.drop("toxic").join(F.broadcast(docs.sparkSession.createDataFrame(kept, "id long, toxic int")), "id").select("text", "toxic")
    # disguises are restored once and not in each of the four passes below
    rows = materialize(rows.mapInArrow(restored_words(characters), "text string, toxic int, restored binary"), "toxicity-restored")
    n1 = sum(toxic for _, toxic in kept)
    n0 = len(kept) - n1
    rate = min(0.5, max(1e-3, n1 / len(kept)))
    schema = "feature long, positive long, negative long"
    sums = (F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))

    def select(kinds: tuple[int, ...], explained: Lookup | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and weights of the features; two passes over the sample, so that only what toxic texts hold is counted."""
        frequent = rows.filter("toxic = 1").mapInArrow(_counts(characters, None, kinds, explained), schema).groupBy("feature").agg(*sums).filter(F.col("positive") >= min_docs).select("feature").toArrow()  # bounded by the sample
        first = Lookup(frequent.column(0).to_numpy().astype(np.int64).view(np.uint64), np.zeros(frequent.num_rows))
        p1, p0 = (F.col("positive") + 0.5) / (n1 + 1), (F.col("negative") + 0.5) / (n0 + 1)
        counted = rows.mapInArrow(_counts(characters, first, kinds, explained), schema).groupBy("feature").agg(*sums).filter((F.col("positive") >= min_docs) & (p1 > 4 * p0)).orderBy("feature").collect()  # bounded by the sample
        hashes = np.array([r["feature"] for r in counted], np.int64).view(np.uint64)
        return hashes, feature_weights(np.array([r["positive"] for r in counted], float), np.array([r["negative"] for r in counted], float), rate)

    hashes, weights = select((0,), None)
    # a beginning that only marking words make toxic is no evidence for others
    marking = Lookup(hashes[weights > np.log(2)], weights[weights > np.log(2)])
    more, heavier = select((4, 5, 6), marking)
    release(chosen, rows)
    return ToxicityModel(characters, Lookup(np.concatenate([hashes, more]), np.concatenate([weights, heavier])), -float(np.log1p(-rate / 10)))


def unlike(rows: DataFrame, sketches: int = 4) -> list[tuple[int, int]]:
    """(id, toxic) of the sample's rows (id, toxic, text; one for each id) without near copies: a word that many copies of one text hold is no evidence.

    A row goes that shares one of `sketches` least hashes of its three-word shingles with an earlier one of its label.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            least = [[int(mix(tokens ^ U(i + 1)).min()) & 0x7FFFFFFFFFFFFFFF for i in range(sketches)] if len(tokens) else [0] * sketches for tokens in shingle_sets(batch.column(2), 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.list_(pa.int64()))], names=["id", "toxic", "least"])

    seen: set[tuple[int, int, int]] = set()
    out = []
    for r in sorted(rows.select("id", "toxic", "text").mapInArrow(run, "id long, toxic int, least array<long>").collect()):
        own = {(r["toxic"], i, x) for i, x in enumerate(r["least"])}
        if not own & seen:
            out.append((r["id"], r["toxic"]))
        seen |= own
    return out


def feature_weights(positive: np.ndarray, negative: np.ndarray, rate: float) -> np.ndarray:
    """-log(1 - p) of each feature, p being the probability that it marks toxic texts rather than standing in some by chance.

    Bayes' rule over two cases: PURITY of the texts with a marking feature are toxic, and of those with any other the
    share that is toxic at all; a share PRIOR of features marks.
    """
    odds = np.log(PRIOR) + positive * np.log(PURITY / rate) + negative * np.log((1 - PURITY) / (1 - rate))
    return np.logaddexp(0, np.clip(odds, -30, 7))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; only the text makes the score.

    Disguises are restored at any length: long words and runs of single characters in overlapping pieces, with word
    edges where the character model puts them, so that a run may be cut wrongly. Blanks, marks and signs beyond ASCII
    count as those of ASCII; letters beyond ASCII stand for themselves, so look-alikes of a-z are not restored.

    Null and empty texts get the score of no features. A null id has a null held_out. Repeated rows give repeated
    results; other columns are not read; empty tables give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            z = np.full(batch.num_rows, model.bias)
            for first, rows, hashes in features(batch.column(1), model.characters):
                rows, place = model.lookup.find(rows, hashes)
                z += np.bincount(first + rows, model.lookup.weights[place], batch.num_rows)
            s = -np.expm1(-z)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    ident = docs[id_col].cast("long")
    rows = docs.select(ident.alias("doc_id"), docs[text_col].cast("string").alias("text"), (F.crc32(ident.cast("string").cast("binary")) % folds == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below 0.5, as they are; null texts stay."""
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            z = np.full(batch.num_rows, model.bias)
            for first, rows, hashes in features(batch.column(place), model.characters):
                rows, found = model.lookup.find(rows, hashes)
                z += np.bincount(first + rows, model.lookup.weights[found], batch.num_rows)
            yield batch.filter(pa.array(-np.expm1(-z) < 0.5))

    return docs.mapInArrow(run, docs.schema)
