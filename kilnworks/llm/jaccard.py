"""N-gram Jaccard join by signature trees."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U, keep_nothing, mix, small, span_hashes, text_slices, word_spans
from ._common import hottest, join_spread, materialize, release
from ._common import small as bounded
from .components import components

#: White space between words: blank, and tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: From this percentage on, linked sets agree in parts of about six tokens; below it single rare tokens tell more.
TIGHT = 88
#: Band b holds sizes from BAND**b to below BAND**(b + 1).
BAND = 1.5


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles of `words` words; with fewer words, of the whole sequence."""
    for _, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, stops, rows = word_spans(data, offsets, SEPARATOR)
        hashes = span_hashes(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
        total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for i in range(words):
            total = total * U(0xD6E8FEB86659FD93) + hashes[i : i + len(total)]
        whole = mix(total + U(words))
        ends = np.searchsorted(rows, np.arange(len(offsets) - 1), "right")
        at = 0
        for end in ends:
            if end - at >= words:
                yield np.unique(whole[at : end - words + 1])
            elif end > at:
                h = U(0)
                with np.errstate(over="ignore"):
                    for x in hashes[at:end]:
                        h = h * U(0xD6E8FEB86659FD93) + x
                yield mix(np.array([h + U(end - at)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at = end


def band_parts(band: int, percent: int) -> tuple[int, int]:
    """(into how many parts the tokens of this band's sets are dealt, how many of those may be empty).

    Linked sets of at most `top` tokens differ in (1 - t) / (1 + t) * 2 * top tokens at most, so they agree in all
    parts but as many. With one part more, and one for each part that may be empty, they agree in one with tokens.
    """
    top = int(np.ceil(BAND ** (band + 1))) - 1
    differ = 2 * top * (100 - percent) // (100 + percent)
    if not differ:
        return 1, 0
    spare = 0
    while True:  # one set in ten at most is dealt again, if its tokens fall as by chance
        parts = differ + 1 + spare
        empty = parts * math.exp(-(BAND**band) / parts)
        if spare >= differ or 1 - sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(spare + 1)) < 0.1:
            return parts, spare
        spare += 1


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which any two linked sets share at least one.

    Linked sets meet in the band of the larger; a set goes to every band its partners may be in. There it has a key
    for each part of its tokens. A set that leaves more parts empty than band_parts() allows agrees with a partner
    that does so too in empty parts perhaps, so it is dealt anew by another hash; after three deals, its first tokens
    in hash order are keys, one more than linked sets can differ in. So no key stands for the absence of tokens.
    """
    n = len(tokens)
    low = int(np.floor(np.log(n) / np.log(BAND) + 1e-9))
    high = int(np.floor(np.log(max(n, n * 100 // percent)) / np.log(BAND) + 1e-9))
    out = []
    for band in range(low, high + 1):
        parts, spare = band_parts(band, percent)
        for deal in range(4):
            salt = U(band << 8 | deal)
            if deal == 3:
                differ = 2 * (int(np.ceil(BAND ** (band + 1))) - 1) * (100 - percent) // (100 + percent)
                out.append(mix(np.sort(mix(tokens + salt))[: differ + 1] ^ U(0xA5A5A5A5A5A5A5A5)))
                break
            part = ((tokens if not deal else mix(tokens + salt)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            where = part[order]
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            sums = np.add.reduceat(mix(tokens[order] + salt), cuts)
            out.append(mix(sums + where[cuts].astype(np.uint64) * U(0x9E3779B97F4A7C15) + salt))
            if parts - len(cuts) <= spare:
                break
    return np.concatenate(out)


class SignatureTree:
    """Sets in nodes of `fan` children: each node has the OR of its sets' token bitmaps, their size range and how many tokens a bitmap can hide."""

    def __init__(self, sets: list[np.ndarray], bits: int, fan: int = 8) -> None:
        self.sets, self.fan = sets, fan
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((n, bits // 64), np.uint64)
        flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
        place = (flat >> U(20)) % U(bits)
        np.bitwise_or.at(maps, (np.repeat(np.arange(n), sizes), (place >> U(6)).astype(np.int64)), U(1) << (place & U(63)))
        hidden = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, hid = self.levels[-1]
            cuts = np.arange(0, len(m), fan)
            self.levels.append((np.bitwise_or.reduceat(m, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(hid, cuts)))

    def span(self, level: int, node: int) -> slice:
        width = self.fan**level
        return slice(node * width, min(len(self.sets), (node + 1) * width))


def possible(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold linked sets: by size ranges, and by the largest overlap that the bitmaps allow."""
    maps, lo, hi, hid = a
    maps2, lo2, hi2, hid2 = b
    common = np.bitwise_count(maps[:, None, :] & maps2[None, :, :]).sum(axis=2).astype(np.int64)
    overlap = np.minimum(np.minimum(common + hid[:, None], common + hid2[None, :]), np.minimum(hi[:, None], hi2[None, :]))
    fits = (100 * hi[:, None] >= percent * lo2[None, :]) & (100 * hi2[None, :] >= percent * lo[:, None])
    return fits & ((100 + percent) * overlap >= percent * (lo[:, None] + lo2[None, :]))


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, group: np.ndarray, percent: int, fan: int = 8) -> list[tuple[int, int]]:
    """Links that join groups of the sets left + right (right None: left with itself), found by dual traversal.

    group holds each set's group so far and is changed as links are found: node pairs whose sets are one group already
    need no look, so a family of near copies costs about a link for each member. All others are decided exactly.
    """
    most = max((len(s) for s in [*left, *(right or [])]), default=1)
    bits = min(1 << 16, max(256, 1 << int(8 * most - 1).bit_length()))
    one = SignatureTree(left, bits, fan)
    two = one if right is None else SignatureTree(right, bits, fan)
    shift = 0 if right is None else len(left)
    found: list[tuple[int, int]] = []
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)] if left and two.sets else []
    while stack:
        l1, n1, l2, n2 = stack.pop()
        s1, s2 = one.span(l1, n1), two.span(l2, n2)
        g1, g2 = group[s1], group[s2.start + shift : s2.stop + shift]
        if (g1 == g1[0]).all() and (g2 == g1[0]).all():
            continue
        if l1 == l2 == 0:
            i, j = n1, n2 + shift
            a, b = one.sets[n1], two.sets[n2]
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= percent * (len(a) + len(b) - common):
                group[group == group[j]] = group[i]
                found.append((i, j))
            continue
        # expand the higher node, or both
        d1, d2 = (l1 - 1 if l1 >= l2 else l1), (l2 - 1 if l2 >= l1 else l2)
        k1 = np.arange(n1 * fan, min(len(one.levels[d1][0]), (n1 + 1) * fan)) if d1 < l1 else np.array([n1])
        k2 = np.arange(n2 * fan, min(len(two.levels[d2][0]), (n2 + 1) * fan)) if d2 < l2 else np.array([n2])
        ok = possible(tuple(x[k1] for x in one.levels[d1]), tuple(x[k2] for x in two.levels[d2]), percent)
        if right is None and (l1, n1) == (l2, n2):
            ok = np.triu(ok, 1 if d1 == 0 else 0)
            pairs = sorted(zip(*np.nonzero(ok)), key=lambda p: -(p[1] - p[0]))  # equal nodes are looked at first
        else:
            pairs = zip(*np.nonzero(ok))
        stack += [(d1, int(k1[i]), d2, int(k2[j])) for i, j in pairs]
    return found


def _signatures(words: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in small(batches):
            sizes, first, second, keys = [], [], [], []
            known = batch.column(0).is_valid().to_pylist()
            for i, tokens in enumerate(shingle_sets(batch.column(1), words)):
                sizes.append(len(tokens))
                first.append(int(mix(tokens + U(1)).sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(tokens ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(block_keys(tokens, percent).view(np.int64) if percent >= TIGHT and len(tokens) and known[i] else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists], names=["doc_id", "n", "d1", "d2", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "tokens"])

    return run


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    table = table.combine_chunks()
    lists = table.column("tokens").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, int)
    names = [table.column(c).to_numpy().astype(np.int64) for c in ("node", "family", "part", "grouped")]
    return *names, np.split(flat, ends[:-1]) if len(lists) else []


def _cell(percent: int):
    """Within a cell: each family part with itself, and with the family's hubs that came along (part -1).

    Of every node that links, the smallest of its group in the cell; parted: whether the family goes on elsewhere,
    which `grouped` says here.
    """

    def run(table: pa.Table) -> pa.Table:
        node, family, part, grouped, sets = _read(table)
        u, v, parted = [], [], []
        order = np.lexsort((node, part, family))
        at = 0
        while at < len(order):
            stop = at
            while stop < len(order) and family[order[stop]] == family[order[at]]:
                stop += 1
            own = order[at:stop]
            # similar sets become neighbours in the tree: by their least token, then by size
            own = own[np.lexsort(([len(sets[i]) for i in own], [int(sets[i][0]) for i in own]))]
            group = np.arange(len(own))
            if tree_join([sets[i] for i in own], None, group, percent):
                names = node[own]
                least = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(least, group, names)
                linked = np.bincount(group, minlength=len(own))[group] > 1
                u.append(names[linked])
                v.append(least[group][linked])
                parted.append(np.full(int(linked.sum()), bool(grouped[own].any())))
            at = stop
        return pa.table({"u": pa.array(np.concatenate(u or [np.zeros(0, np.int64)])), "v": pa.array(np.concatenate(v or [np.zeros(0, np.int64)])), "parted": pa.array(np.concatenate(parted or [np.zeros(0, bool)]))})

    return run


def _cross(percent: int):
    """Rows of part -1 are a chunk of a family's strays, the others one part of it: the links between them, and among neither."""

    def run(table: pa.Table) -> pa.Table:
        node, _, part, grouped, sets = _read(table)
        stray, rest = np.flatnonzero(part == -1), np.flatnonzero(part != -1)
        both = np.concatenate([stray, rest])
        found = tree_join([sets[i] for i in stray], [sets[i] for i in rest], np.unique(grouped[both], return_inverse=True)[1].astype(np.int64), percent) if len(stray) and len(rest) else []
        return pa.table({"u": pa.array([node[both[i]] for i, _ in found], pa.int64()), "v": pa.array([node[both[j]] for _, j in found], pa.int64())})

    return run


def _families(keyed: DataFrame) -> DataFrame:
    """node and family of the nodes that share keys: each key hangs its nodes on the smallest, by a map-side aggregate."""
    shared = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).filter("hub <> last")
    shared = materialize(shared.select("key", "hub", "n"), "jaccard-shared")
    met = join_spread(keyed, shared.select("key", "hub"), ["key"], "node", hottest(shared, ["key"]))
    found = components(met.select(F.col("node").alias("u"), F.col("hub").alias("v")).filter("u <> v"), "jaccard-families").withColumnRenamed("component", "family")
    release(shared)
    return found


def _sized(families: DataFrame, part_sets: int, part_tokens: int) -> DataFrame:
    """node, family, n, part and parts of the families (node, family, n) with two nodes or more."""
    sizes = materialize(families.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens")).filter("size > 1"), "jaccard-sizes")
    parts = F.greatest(F.ceil(F.col("size") / part_sets), F.least(F.ceil(F.col("tokens") / part_tokens), "size")).alias("parts")
    met = join_spread(families, sizes.select("family", parts), ["family"], "node", hottest(sizes, ["family"], "size"))
    return met.select("node", "family", "n", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "parts")


def _frequent(words: int, kept: int = 4096):
    """Of each task, the tokens that more sets hold than one in `kept` of all occurrences, with counts that are at most that much too low.

    A Misra-Gries summary: of more than `kept` counters the largest stay, each less the largest of the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in small(batches, 256):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
            new, n = np.unique(np.concatenate([tokens[:0], *sets]), return_counts=True)
            tokens, counts = heaviest(np.concatenate([tokens, new]), np.concatenate([counts, n]), kept)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["token", "sets"])

    return run


def heaviest(tokens: np.ndarray, counts: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `kept` tokens with their counts, added up where a token comes twice, less that of the largest left out."""
    both, at = np.unique(tokens, return_inverse=True)
    total = np.bincount(at, counts, len(both)).astype(np.int64)
    if len(both) > kept:
        floor = np.partition(total, len(total) - kept - 1)[len(total) - kept - 1]
        both, total = both[total > floor], total[total > floor] - floor
    return both, total


def _by_rare_tokens(texts: DataFrame, words: int, percent: int, hot_tokens: int = 1000, hot_sets: int = 1000) -> DataFrame:
    """node and key, of texts (doc_id and text): each set's first tokens in the order of how many sets have them, as many as linked sets must share one of.

    Tokens that no other set has come first of all and give no key, so a set gives none unless nearly all of it is
    found elsewhere: passages that many sets share do not tie them together. Tokens are shuffled once, to be counted.
    The hot_tokens most frequent, if in hot_sets sets at least, take their counts from summaries of all sets instead,
    and stay where they are, so no other token has more than one in hot_tokens of all occurrences. Those counts may be
    too low, which only moves a token forward in an order that is the same for all sets.
    """
    sets = texts.mapInArrow(_sets(words), "node long, tokens array<long>")
    hot = texts.mapInArrow(_frequent(words), "token long, sets long").groupBy("token").agg(F.sum("sets").alias("often"))
    hot = materialize(hot.filter(F.col("often") >= hot_sets).orderBy(F.col("often").desc(), "token").limit(hot_tokens), "jaccard-hot")
    tokens = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    # hot tokens meet their counts where they are; only the others are shuffled, with nothing but what is needed
    often = tokens.join(F.broadcast(hot), "token").select("node", "n", "token", F.col("often").alias("sets"))
    others = tokens.join(F.broadcast(hot.select("token")), "token", "left_anti").select("node", "n", "token")
    seen = others.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("token"))).unionByName(often)
    common = seen.filter("sets > 1").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("common"))
    first = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.size("common"))
    return common.withColumn("first", F.greatest(F.lit(0), first).cast("int")).select("node", F.explode(F.expr("slice(common, 1, first)")).alias("c")).select("node", F.col("c.token").alias("key"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, part_sets: int = 1024, part_tokens: int = 1 << 22, hubs: int = 8, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id and n_texts (distinct sets in the component) of each row of docs.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. Equal sets are one node. Blocking
    loses no link: linked sets share a key (block_keys, or _by_rare_tokens where a link allows more difference), and
    what shares keys, directly or through others, is a family. A family is joined with itself by signature trees
    (tree_join). One of more than part_sets sets or part_tokens tokens is dealt into parts: each is joined with itself
    and with the family's first `hubs` sets; then the strays, all sets outside the family's largest group, are joined
    in chunks with every part. A pair left out has both sets in that group already, so components are exact and no task
    holds more than two parts.

    Words and letters: A-Z are lower-cased; words are runs without blanks, tabs to carriage returns. Fewer than `words`
    words make one shingle; no words, and null texts, an empty set that links with nothing. Rows with a null id link
    with nothing and have a null component. Rows that share an id are one document, linked with all that any of them
    links with. Other columns are not read; empty tables give no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = materialize(rows.mapInArrow(_signatures(words, percent), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "jaccard-keys")
    known = signed.filter("doc_id is not null and n > 0")
    reps = materialize(known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "jaccard-reps")
    texts_of = lambda ids: rows.join(bounded(ids.select(F.col("node").alias("doc_id")), broadcast_rows), "doc_id").select("doc_id", "text")
    nodes = reps.groupBy("node").agg(F.sum("n").alias("n"))
    if percent >= TIGHT:
        keyed = known.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    else:
        keyed = materialize(_by_rare_tokens(texts_of(materialize(nodes.select("node"), "jaccard-nodes")), words, percent), "jaccard-keys")
    families = _families(keyed)
    if percent < TIGHT:
        release(keyed)
    members = materialize(_sized(nodes.join(families, "node"), part_sets, part_tokens), "jaccard-members")
    sets = materialize(texts_of(members).mapInArrow(_sets(words), "node long, tokens array<long>"), "jaccard-sets")
    links = materialize(_dealt(members, sets, hubs, part_sets, part_tokens, broadcast_rows).groupBy("cell").applyInArrow(_cell(percent), "u long, v long, parted boolean"), "jaccard-links")
    # a family that was in one cell is done
    grouped = links.filter("not parted").select(F.col("u").alias("node"), F.col("v").alias("component"))
    parted = members.filter("parts > 1")
    if not parted.isEmpty():
        wide = links.filter("parted").select("u", "v")
        merged = components(wide, "jaccard-groups")
        more = _strays(parted, sets, merged, percent, part_sets, part_tokens, broadcast_rows)
        if more is not None:
            merged = components(wide.unionByName(more), "jaccard-groups")
        grouped = grouped.unionByName(merged)
    grouped = _with_own_texts(known, reps, grouped)
    named = reps.drop("rows").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "jaccard-named")
    texts = materialize(named.groupBy("component").agg(F.count(F.lit(1)).alias("n_texts")), "jaccard-texts")
    named = join_spread(named, texts, ["component"], "node", hottest(texts, ["component"], "n_texts")).select("d1", "d2", "n", "component", "n_texts")
    result = join_spread(signed.select("doc_id", "n", "d1", "d2"), named, ["d1", "d2", "n"], "doc_id", hottest(reps, ["d1", "d2", "n"], "rows"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    found = materialize(result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_texts", F.lit(1))).alias("n_texts")), "jaccard-found")
    release(signed, reps, members, sets, links)
    return found


def _with_own_texts(known: DataFrame, reps: DataFrame, grouped: DataFrame) -> DataFrame:
    """node and component, where the different texts of one id link its nodes."""
    several = known.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("least"), F.max(F.struct("d1", "d2", "n")).alias("most")).filter("least <> most").select("doc_id")
    several = materialize(several, "jaccard-several")
    if several.isEmpty():
        return grouped
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "d1", "d2", "n").distinct().join(reps, ["d1", "d2", "n"]).select("doc_id", "node")
    least = own.groupBy("doc_id").agg(F.min("node").alias("v"))
    edges = own.join(least, "doc_id").select(F.col("node").alias("u"), "v").unionByName(grouped.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(edges, "jaccard-groups")


def _dealt(members: DataFrame, sets: DataFrame, hubs: int, part_sets: int, part_tokens: int, broadcast_rows: int) -> DataFrame:
    """The sets of all families dealt into cells, with the hubs of families in several parts."""
    total = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = max(1, total[0] // part_sets, total[1] // part_tokens)
    parted = members.filter("parts > 1")
    lead = parted.select("family", "node", "parts").filter("part < 1").groupBy("family", "parts").agg(F.slice(F.sort_array(F.collect_set("node")), 1, hubs).alias("nodes"))
    lead = lead.select("family", F.explode("nodes").alias("node"), "parts")
    lead = sets.join(bounded(lead, broadcast_rows), "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.when(F.col("parts") > 1, F.xxhash64("family", "part")).otherwise(F.pmod(F.xxhash64("family"), F.lit(cells)))
    dealt = sets.join(bounded(members, broadcast_rows), "node").select(cell.alias("cell"), "node", "family", "part", (F.col("parts") > 1).cast("long").alias("grouped"), "tokens")
    return dealt.unionByName(lead.select(F.xxhash64("family", "part").alias("cell"), "node", "family", F.lit(-1).cast("long").alias("part"), F.lit(1).cast("long").alias("grouped"), "tokens"))


def _strays(parted: DataFrame, sets: DataFrame, grouped: DataFrame, percent: int, part_sets: int, part_tokens: int, broadcast_rows: int) -> DataFrame | None:
    """Links between the sets outside a large family's largest group and all of its sets; None where there are no such sets."""
    now = parted.select("node", "family", "part", "parts", "n").join(grouped, "node", "left").withColumn("grouped", F.coalesce("component", "node")).drop("component")
    groups = now.groupBy("family", "grouped").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    main = groups.groupBy("family").agg(F.max(F.struct("size", "grouped", "tokens")).alias("main"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
    chunks = F.ceil(F.greatest((F.col("size") - F.col("main.size")) / part_sets, (F.col("tokens") - F.col("main.tokens")) / part_tokens))
    main = materialize(main.select("family", F.col("main.grouped").alias("main"), chunks.alias("chunks")).filter("chunks > 0"), "jaccard-main")
    if main.isEmpty():
        return None
    now = materialize(now.drop("n").join(main, "family"), "jaccard-strays")
    now = sets.join(bounded(now, broadcast_rows), "node")
    stray = now.filter("grouped <> main").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")))
    stray = stray.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.xxhash64("family", "to", "chunk").alias("cell"), "node", "family", F.lit(-1).cast("long").alias("part"), "grouped", "tokens")
    rest = now.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(F.xxhash64("family", "part", "chunk").alias("cell"), "node", "family", "part", "grouped", "tokens")
    return materialize(stray.unionByName(rest).groupBy("cell").applyInArrow(_cross(percent), "u long, v long"), "jaccard-strays")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs without those linked, directly or through others, to a smaller id: one document of each group stays.

    Rows that share an id are one document: its different texts stay, or go, together; of rows that are equal in id and
    text the one with the smallest other columns stays. Rows with a null id, and texts without words, stay.
    """
    found = jaccard_components(docs, id_col, text_col, words, percent, broadcast_rows=broadcast_rows)
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "jaccard-gone")
    shared = materialize(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id"), "jaccard-shared")
    release(found)
    kept = docs.withColumn("_id", docs[id_col].cast("long")).join(bounded(gone, broadcast_rows), "_id", "left_anti")
    if shared.isEmpty():
        return kept.drop("_id")
    once = kept.join(bounded(shared, broadcast_rows), "_id", "left_anti").select(*docs.columns)
    text = F.col(text_col).cast("string")
    several = kept.join(bounded(shared, broadcast_rows), "_id", "left_semi").groupBy("_id", F.xxhash64(text).alias("_h"), F.octet_length(text).alias("_n")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.unionByName(several.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
