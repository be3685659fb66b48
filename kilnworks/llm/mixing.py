"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hottest, join_spread, materialize, release
from ._common import small as bounded

#: A row's place in its source has this many bits; it is dealt into 2 ** DIGIT parts at a time.
PLACE, DIGIT = 63, 10
LAST = (1 << PLACE) - 1


def word_count(text: Column) -> Column:
    """Words between white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


class Shares:
    """The sources' shares of all tokens (column t of a table with a row for each source, those without tokens left out)."""

    def __init__(self, sums: DataFrame) -> None:
        self.sums = sums.filter("t > 0")
        found = self.sums.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all"), F.min("t").alias("least"), F.max("t").alias("most")).first()
        self.total = found["all"]
        self.least, self.most = ((found[c] or 1) / max(1, self.total) for c in ("least", "most"))

    def moments(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sum of the shares raised to it, and the sum of those times the logarithms of the shares: one aggregate."""
        share = F.col("t") / F.lit(float(self.total))
        columns = [c for i, e in enumerate(exponents) for c in (F.sum(F.pow(share, F.lit(e))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(e)) * F.log(share)).alias(f"m{i}"))]
        found = self.sums.agg(*columns).first()
        return [(found[f"z{i}"], found[f"m{i}"]) for i in range(len(exponents))]

    def entropy(self, exponent: float, moments: tuple[float, float]) -> float:
        """Of the weights share ** exponent / sum."""
        whole, logs = moments
        return math.log(whole) - exponent * logs / whole

    def repetition(self, exponent: float, whole: float | None, budget: int | None) -> float:
        """The most often that a source's tokens are gone through: those of the smallest source, since exponents are at most 1."""
        if budget is None:  # the budget in which the largest source is gone through once
            return (self.most / self.least) ** (1 - exponent)
        return budget / self.total * self.least ** (exponent - 1) / whole


def fit_exponent(shares: Shares, target_entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None, steps: int = 60, halvings: int = 4) -> float:
    """The least exponent in [0, 1] that meets the limit, found by bisection: the flattest mix that is allowed.

    Entropy falls and repetition falls as the exponent rises. With target_entropy, the exponent whose mix has that
    entropy (clamped to [0, 1]). With max_repetition, the smallest exponent at which no source is repeated more often
    (1 where even the shares themselves exceed it); without a budget the covering budget of each mix is used. Where
    the limit needs sums over all sources, one pass over them serves several halvings.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    passes = target_entropy is not None or budget is not None

    def meets(exponents: list[float]) -> list[bool]:
        found = shares.moments(exponents) if passes else [(None, None)] * len(exponents)
        if target_entropy is not None:
            return [shares.entropy(e, m) <= target_entropy for e, m in zip(exponents, found)]
        return [shares.repetition(e, m[0], budget) <= max_repetition * (1 + 1e-12) for e, m in zip(exponents, found)]

    if meets([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    parts = 1 << halvings
    for _ in range(-(-steps // halvings)):
        tried = [low + (high - low) * i / parts for i in range(1, parts)]
        ok = [*meets(tried), True]
        first = ok.index(True)
        low, high = ([low, *tried][first], [*tried, high][first])
    return high


def _cuts(rows: DataFrame, cells: DataFrame, broadcast_rows: int) -> DataFrame:
    """_source, epoch and _upto, the last place taken, of each source and epoch whose budget ends inside a cell.

    cells: _source, epoch, _fine and _left, the tokens left for that cell. Its rows without their texts are written
    once; then each pass adds up the parts of the cell by the next digit of their places and goes on in the one where
    the budget ends, until it holds one place. No pass sorts more than 2 ** DIGIT rows of a source.
    """
    near = rows.select("_source", "_place", word_count(F.col("_text")).alias("_n"), F.shiftright("_place", PLACE - DIGIT).alias("_fine"))
    near = materialize(near.join(bounded(cells, broadcast_rows), ["_source", "_fine"]).select("_source", "epoch", "_place", "_n", "_left"), "mix-near")
    shift, first, done = PLACE - DIGIT, near, None
    while True:
        shift = max(0, shift - DIGIT)
        parts = near.groupBy("_source", "epoch", F.shiftright("_place", shift).alias("_part")).agg(F.sum("_n").alias("_n"), F.max("_left").alias("_left"), F.min("_place").alias("_low"), F.max("_place").alias("_upto"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source", "epoch").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = parts.withColumn("_left", F.col("_left") - before).filter("_left > 0").groupBy("_source", "epoch").agg(F.max(F.struct("_part", "_left", "_low", "_upto")).alias("end"))
        ends = materialize(ends.select("_source", "epoch", "end.*"), "mix-ends")
        settled = ends.filter(F.lit(shift == 0) | (F.col("_low") == F.col("_upto"))).select("_source", "epoch", "_upto")
        done = settled if done is None else done.unionByName(settled)
        open_ = ends.filter(F.lit(shift > 0) & (F.col("_low") < F.col("_upto"))).select("_source", "epoch", "_part", "_left")
        if open_.isEmpty():
            done = materialize(done, "mix-cuts")
            release(first)
            return done
        near = near.drop("_left").withColumn("_part", F.shiftright("_place", shift)).join(bounded(open_, broadcast_rows), ["_source", "epoch", "_part"]).select("_source", "epoch", "_place", "_n", "_left")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None,
    max_repetition: float | None = 2.0, budget: int | None = None, seed: int = 0, max_blocks: int = 1 << 16, broadcast_rows: int = 200_000,
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with epoch, mix_block and mix_tokens appended.

    A source's budget is its weight times the whole budget (by default the covering budget: every row is taken once at
    least). Its rows are dealt by a seeded hash into up to 1024 blocks, their number by the source's share; in each
    epoch the blocks are permuted anew, and taken in that order until the source's budget is spent; within the block
    where it ends, rows are taken in hash order while the tokens before them are below what is left. Prefix sums run
    over block sums, and over ever smaller parts of that one block (_cuts); no window holds a source's rows. Tables of
    sources and of blocks are broadcast up to broadcast_rows rows, and joined by a shuffle beyond.

    Null sources and the empty name are one source; null texts have no tokens, and are taken with the block they are
    in; sources without tokens are taken once. Repeated rows of one id and text share their place and are taken
    together, so they may exceed what is left by their own tokens. Input columns keep their names; the three appended
    ones take the place of columns of the same name. Empty tables give no rows.
    """
    kept = [c for c in docs.columns if c not in ("epoch", "mix_block", "mix_tokens")]
    source, text = F.coalesce(docs[source_col].cast("string"), F.lit("")), docs[text_col].cast("string")
    place = F.shiftrightunsigned(F.xxhash64(docs[id_col].cast("string"), text, F.lit(seed)), 64 - PLACE)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), source.alias("_source"), text.alias("_text"), place.alias("_place"))
    fine = materialize(rows.groupBy("_source", F.shiftright("_place", PLACE - DIGIT).alias("_fine")).agg(F.sum(word_count(F.col("_text"))).alias("_sum")), "mix-fine")
    sums = materialize(fine.groupBy("_source").agg(F.sum("_sum").alias("t")), "mix-sums")
    shares = Shares(sums)
    exponent = fit_exponent(shares, target_entropy, max_repetition if target_entropy is None else None, budget) if shares.total else 1.0
    norm = shares.moments([exponent])[0][0] if shares.total else 1.0
    total = float(max(1, shares.total))
    whole = total * norm * shares.most ** (1 - exponent) if budget is None else float(budget)
    own = F.round(F.pow(F.col("t") / total, F.lit(exponent)) / F.lit(norm) * F.lit(whole)).cast("long")
    bits = F.greatest(F.lit(0), F.least(F.lit(DIGIT), F.floor(F.log2(F.col("t") * F.lit(max_blocks / total))))).cast("int")
    sources = sums.select("_source", F.col("t").alias("_all"), F.when(F.col("t") > 0, F.greatest(own, "t") if budget is None else own).otherwise(0).alias("_budget"), F.coalesce(F.lit(PLACE) - bits, F.lit(PLACE)).alias("_shift"))
    sources = materialize(sources, "mix-sources")
    known = bounded(sources, broadcast_rows)
    blocks = fine.join(known, "_source").withColumn("mix_block", F.expr("shiftright(shiftleft(_fine, 53), _shift)")).groupBy("_source", "mix_block", "_all", "_budget", "_shift").agg(F.sum("_sum").alias("_sum"))
    epochs = F.when(F.col("_all") > 0, F.ceil(F.col("_budget") / F.col("_all"))).otherwise(1).cast("int")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(epochs, F.lit(1)))))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64("mix_block", "epoch", F.lit(seed)), "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_sum").over(order), F.lit(0)) - (F.col("epoch") - 1) * F.col("_all"))
    blocks = blocks.filter("_left > 0 or _all = 0" + (" or epoch = 1" if budget is None else "")).withColumn("_cut", F.col("_left") < F.col("_sum"))
    blocks = materialize(blocks.select("_source", "mix_block", "epoch", "_left", "_shift", "_cut"), "mix-blocks")
    taken = blocks.filter("not _cut").select("_source", "mix_block", "epoch", F.lit(LAST).alias("_upto"))
    cut = blocks.filter("_cut").select("_source", "mix_block", "epoch", "_left", "_shift")
    if not cut.isEmpty():
        inner = Window.partitionBy("_source", "epoch").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
        cells = fine.join(bounded(cut, broadcast_rows), "_source").filter(F.expr("shiftright(shiftleft(_fine, 53), _shift) = mix_block"))
        cells = cells.withColumn("_left", F.col("_left") - F.coalesce(F.sum("_sum").over(inner), F.lit(0))).filter("_left > 0").groupBy("_source", "epoch").agg(F.max(F.struct("_fine", "_left")).alias("end"))
        cells = materialize(cells.select("_source", "epoch", "end.*"), "mix-cells")
        taken = taken.unionByName(cut.join(_cuts(rows, cells, broadcast_rows), ["_source", "epoch"]).select("_source", "mix_block", "epoch", "_upto"))
        taken = materialize(taken, "mix-taken")
        release(cells)
    dealt = rows.join(known, "_source") if sources.count() <= broadcast_rows else join_spread(rows, sources, ["_source"], "_place", hottest(sources, ["_source"], "_all"))
    dealt = dealt.select("_source", F.expr("shiftright(_place, _shift)").alias("mix_block"), "_row", "_place", word_count(F.col("_text")).alias("mix_tokens"))
    block = ["_source", "mix_block"]
    if taken.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = dealt.join(F.broadcast(taken), block)
    else:  # a block of a dominant source may have more rows than one task should get
        sizes = dealt.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
        found = join_spread(dealt, taken, block, "_place", materialize(hottest(sizes, block), "mix-hot"))
    found = found.filter("_place <= _upto")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in kept], "epoch", "mix_block", "mix_tokens")
