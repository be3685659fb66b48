"""Source divergence, byte-level BPE and importance resampling against brute force and a library, with edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilnworks.llm import bpe, divergence, resampling
from kilnworks.llm.queries import BYTE_TOKENIZER, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, ids int, rank string, value int, item int, digest int, part string, score int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, parts=3):
    """Documents (id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y", 5) for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    rows = []
    for i in range(240):
        words = [rng.choice(vocabulary[: rng.choice([5, 30, 120])]) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", ", ", "\n", "7 "]).join(w.upper() if rng.random() < 0.1 else w for w in words), rng.choice(["en", "en", "en", "fr"]), "s0" if rng.random() < 0.4 else f"s{rng.randint(1, 4)}"))
    rows += [(300 + i, rows[0][1], "en", "s0") for i in range(90)]  # copies, a quarter of the rows
    rows += [(400, None, "en", "s1"), (401, "", "fr", "s9"), (402, "alone", None, None), (403, "x1Ⅷ²", "de", "s1"), (404, "x x x", "de", "s2"), (None, "no id", "en", "s2"), (5, rows[5][1], *rows[5][2:]), (405, "Tail " * 4000 + "a<|endoftext|>b  c\t\n ", "en", "s3")]
    return rows


# ---- source divergence


def brute_divergence(rows, min_docs=3, top=200, scale=10**9):
    found, groups = collections.defaultdict(collections.Counter), set()
    df = collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(AZ))
        found[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda count: {t: 1 + scale * (count[t] + 1) // (sum(count[x] for x in kept) + len(kept)) for t in kept}
        q = share(sum((found[lang, s] for s in sources), collections.Counter()))
        p = {s: share(found[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


@pytest.mark.parametrize(("broadcast_rows", "top", "block"), [(100_000, 200, 24 << 20), (0, 7, 2000)])
def test_divergence_against_brute_force(spark, corpus, monkeypatch, broadcast_rows, top, block):
    monkeypatch.setattr(divergence.partial_runs, "__defaults__", (block,))
    got = divergence.source_divergence(docs_of(spark, corpus), top=top, broadcast_rows=broadcast_rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_divergence(corpus, top=top)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(docs_of(spark, [])).count() == 0
    rows = [(1, "rare", "en", "a"), (2, None, "en", "b"), (3, "rare", "fr", "a")]
    assert {tuple(r) for r in divergence.source_divergence(docs_of(spark, rows)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_blocks_and_long_texts_count_alike():
    """However the texts are cut into blocks, the merged runs are the same, and a text counts once."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "Bb", "é", "ccc"]) + str(rng.randint(0, 9)) for _ in range(rng.choice([0, 3, 900]))) for _ in range(30)] + ["", "end"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 16, "source": ["s", "s", "t", ""] * 8, "text": texts})
    seen = []
    for most in (1 << 20, 3000, 400, 50):
        total = collections.Counter()
        for part in divergence.partial_runs([batch.slice(0, 10), batch.slice(10)], most):
            for r in part.to_pylist():
                total[r["lang"], r["term"], r["source"], "docs"] += r["docs"]
                total[r["lang"], r["term"], r["source"], "count"] += r["count"]
        seen.append(total)
    assert seen[0] and all(x == seen[0] for x in seen)


def test_sums_and_terms_are_emitted_in_pieces(monkeypatch):
    """Small bounds on what a scan holds change neither sums nor best terms."""
    rng = random.Random(5)
    rows = [("en", f"t{i:03}", f"s{j}", rng.randint(1, 10**9), 5, rng.randint(1, 10**9)) for i in range(60) for j in sorted(rng.sample(range(9), rng.randint(1, 9)))]
    batch = pa.RecordBatch.from_pydict(dict(zip(("lang", "term", "source", "p", "p0", "q"), map(list, zip(*rows)))))
    seen = []
    for pairs, held, size in ((1 << 20, 1 << 18, 1000), (7, 3, 11)):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        monkeypatch.setattr(divergence, "HELD", held)
        total = collections.Counter()
        for part in divergence.emit([batch.slice(at, size) for at in range(0, batch.num_rows, size)], 3):
            for r in part.to_pylist():
                total[r["part"], r["source"], r["item"]] += r["value"]
        seen.append(total)
    best = collections.defaultdict(list)
    for _, t, s, p, _, q in rows:
        if p > q:
            best[s].append((-((p - q) ** 2 // q), t))
    want = {("term", s, t): -v for s, x in best.items() for v, t in sorted(x)[:3]}
    for total in seen:
        assert {k: v for k, v in total.items() if k[0] == "pair"} == {k: v for k, v in seen[0].items() if k[0] == "pair"}
        assert {k: v for k, v in total.items() if k[0] == "term"} == want


# ---- byte-level BPE


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path(BYTE_TOKENIZER)
    return bpe.Merges(path), tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(both, monkeypatch):
    own, library = both
    rng = random.Random(1)
    letters = "abc XYZ'tsrevmld  \n\t\r\x1c\x1d\x1e\x1f\x85\xa0​᠎ 　éßñ漢字😀١²½Ⅷ_-.,!?́\x00\x0b"
    for slice_ in (1 << 18, 7):
        monkeypatch.setattr(bpe, "SLICE", slice_)
        for _ in range(2500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
            if rng.random() < 0.1:
                text += "<|endoftext|>" + text[:5] + "<|endoftext|"
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == ids, text
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    for _ in range(500):  # ids that no text gives
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_long_words(both):
    own, library = both
    for text in ("a" * 20000, " " * 30000, "ab" * 9000, "\n" * 999 + "x", "ä" * 7000):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_short_words_and_columns(both, monkeypatch):
    """Short words are merged without a queue, and texts are joined a column at a time; both as the library does it."""
    import pyarrow as pa

    own, library = both
    rng = random.Random(4)
    words = ["".join(rng.choices("aaabnerst hiouéß'", k=rng.randint(1, 80))) for _ in range(1500)]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    short = [w for w in words if len(w.encode()) <= bpe.SHORT]
    queued = bpe.Merges.merge
    with monkeypatch.context() as held:
        held.setattr(bpe, "heappop", None)
        merged = [queued(own, w.encode()) for w in short]
    with monkeypatch.context() as held:
        held.setattr(bpe, "SHORT", 0)
        assert [queued(own, w.encode()) for w in short] == merged
    assert [own.encode(w) for w in words] == want
    with monkeypatch.context() as held:
        held.setattr(bpe.Merges, "decode", None)
        lists = pa.array([None, [], *want, [None, 15496, 99999, -1], [50256]], pa.list_(pa.int32()))
        for at in (0, 1, 7):
            assert own.decode_column(lists.slice(at)).to_pylist() == [None, "", *words, "Hello", "<|endoftext|>"][at:]
        assert own.decode_column(lists.slice(0, 0)).to_pylist() == [] and own.decode_column(lists.slice(0, 1)).to_pylist() == [None]
    parts = [i for i, b in own.bytes_of.items() if b in ("é".encode()[:1], "é".encode()[1:])]
    split = [[parts[0]], [parts[1]], parts, parts[::-1], None, [rng.randrange(50257) for _ in range(40)]]  # characters cut between rows
    assert own.decode_column(pa.array(split, pa.list_(pa.int32()))).to_pylist() == [None if x is None else library.decode(x, skip_special_tokens=False) for x in split]


def test_bpe_cache_is_bounded(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    text = " ".join(f"word{i % 40}x{i}" for i in range(300))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(own.young) < 30 and len(own.old) < 30


def test_bpe_columns(spark, corpus, both):
    _, library = both
    path = tokenizer_path(BYTE_TOKENIZER)
    coded = bpe.encode(docs_of(spark, corpus), path)
    assert coded.columns == ["ids", "doc_id", "lang", "source", "rank", "value", "item", "digest", "part", "score"]
    back = bpe.decode(coded, path)
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["text"], r["rank"]) for r in back.collect())
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "", "x") for i, t, _, _ in corpus)
    assert got == want
    assert bpe.decode(bpe.encode(docs_of(spark, []), path), path).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [15496, None, 99999], "c")], "doc_id long, ids array<int>, TEXT string")
    assert {(r[0], r["text"]) for r in bpe.decode(odd, path).collect()} == {(1, None), (2, ""), (3, "Hello")}


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Merges(tokenizer_path())


# ---- importance resampling


def brute_resampling(rows, target, percent=5, min_words=20, seed=42):
    def runs(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text, _, _ in rows:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)}
    out = []
    for i, text, _, _ in rows:
        n, found = runs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in out)


def ranked(df):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


@pytest.mark.parametrize(("percent", "slice_"), [(5, 1 << 20), (60, 40), (100, 1 << 20), (0, 1 << 20)])
def test_resampling_against_brute_force(spark, corpus, monkeypatch, percent, slice_):
    monkeypatch.setattr(resampling, "SLICE", slice_)
    target = [corpus[3][1], corpus[4][1], None, ""]
    got = resampling.resample(docs_of(spark, corpus), spark.createDataFrame([(t, 1) for t in target], "text string, copies int"), percent=percent)
    assert ranked(got) == brute_resampling(corpus, target, percent=percent)


def test_resampling_of_nothing(spark, corpus):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of(spark, []), empty).count() == 0
    rows = corpus[:40]
    assert ranked(resampling.resample(docs_of(spark, rows), empty)) == brute_resampling(rows, [])


def test_resampling_ranks_ties_by_id(spark):
    """Rows of one id have one noise; their ranks go on, whatever the partitions."""
    rows = [(7, "a b c d e f g h i j k l m n o p q r s t u", "en", "s")] * 300 + [(8, "a b c d e f g h i j k l m n o p q r s t u", "en", "s")] * 300
    got = resampling.resample(docs_of(spark, rows, 7), spark.createDataFrame([("a b",)], "text string"), percent=50)
    assert ranked(got) == brute_resampling(rows, ["a b"], percent=50)


def test_hot_texts_meet_their_weight_in_parts(spark, monkeypatch):
    monkeypatch.setattr("kilnworks.llm._common.HOT_ROWS", 10)
    rows = [(i, "same words again and again " * 5, "en", "s") for i in range(200)] + [(1000 + i, f"other words {i} " * 9, "en", "s") for i in range(100)]
    got = resampling.resample(docs_of(spark, rows), spark.createDataFrame([("again",)], "text string"))
    assert ranked(got) == brute_resampling(rows, ["again"])
    drawn = resampling.drawn_documents(docs_of(spark, rows), got)
    assert drawn.count() == 15 and drawn.columns == docs_of(spark, rows).columns


def test_runs_go_on_over_slices(monkeypatch):
    text = ("Ab cd-ef 12 " * 30 + "é" * 50).encode()
    want = resampling.feature_buckets(text)
    for size in (1, 5, 13, 100):
        monkeypatch.setattr(resampling, "SLICE", size)
        n, found = resampling.feature_buckets(text)
        assert n == want[0] and np.array_equal(found, want[1])


def test_gains_round_down():
    gains = resampling.bucket_gains(np.array([3, 0], object), np.array([0, 3], object))
    assert gains.tolist() == [math.floor(1000 * math.log(1 / 4)), math.floor(1000 * math.log(4))]


def test_noise_of_a_null_id(spark):
    got = spark.range(1).select(resampling.noise(F.lit(None).cast("long"), 42)).first()[0]
    h = int(hashlib.sha256(b"42:").hexdigest()[:8], 16)
    assert got == math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
