"""Names of variables: what they mean, a character model with prototypes, and fuzzy matches.

Names are short, so a name's features are column expressions; models are tables of terms, and a name meets only the
labels, prototypes and aliases that share a term with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import join_terms, written

# Concepts with the patterns that show them, in a lower-case name with blanks for underscores.
CONCEPTS = {
    "direction_in": r"influent|inlet|入口|进口|进水|进料|入炉|入口侧",
    "direction_out": r"effluent|outlet|出口|出口侧|出水|出料|排出",
    "direction_upper": r"\bupper\b|上部|上段|上层|上压差",
    "direction_lower": r"\blower\b|下部|下段|下层|下压差",
    "direction_hot": r"\bhot\b|热风|热端|热侧",
    "direction_cold": r"\bcold\b|冷风|冷端|冷侧",
    "order_primary": r"primary|一次|\bpa\b",
    "order_secondary": r"secondary|二次|\bsa\b",
    "variant_a": r"(?:^|[^a-z])a(?:[^a-z]|$)|温度a|压力a",
    "variant_b": r"(?:^|[^a-z])b(?:[^a-z]|$)|温度b|压力b",
    "zone_1": r"zone[_\- ]?1|一区|一段|预热段|炉温1",
    "zone_2": r"zone[_\- ]?2|二区|二段|加热段|炉温2",
    "zone_3": r"zone[_\- ]?3|三区|三段|均热段|炉温3",
    "position_top": r"\btop\b|塔顶|顶部",
    "position_bottom": r"\bbottom\b|塔底|底部",
    "material_rawmeal": r"raw[_\- ]?meal|生料|raw[_\- ]?feed",
    "material_coal": r"coal|煤粉|煤量|喂煤",
    "kind_timestamp": r"timestamp|date[_\- ]?time|采集时间|时间戳",
    "measure_temp": r"temp(?:erature)?|\btt\b|温度|炉温",
    "measure_flow": r"flow|流量|风量",
    "measure_pressure": r"pressure|\bpt\b|压力|压强",
    "measure_pressure_drop": r"pressure[_\- ]?difference|pressure[_\- ]?drop|压差",
    "measure_level": r"level|液位|料位",
    "direction_lagging": r"lagging|滞后",
    "direction_leading": r"leading|超前",
    "measure_reactive_energy": r"reactive|无功",
    "measure_power_factor": r"power[_\- ]?factor|功率因数",
    "measure_energy_usage": r"usage[_\- ]?kwh|energy[_\- ]?consumption|用电量|能耗",
    "measure_carbon": r"co2|carbon|二氧化碳",
    "measure_frequency": r"frequency|频率|转速",
    "chem_ammonia": r"ammonia|nh3[_\-]?n|氨氮",
    "chem_cod": r"\bcod\b|化学需氧量",
}
# A number beside a quantity, a letter that tells twins apart, and what a name's core leaves out.
ORDINAL = r"(?:zone|temp|temperature|pressure|level|flow|tp|炉温|温度|压力|压差|液位|流量|周边|炉顶)[_\-\s#]*\d{1,2}|\d{1,2}\s*(?:号)?(?:区|段|层|点|通道|周边|炉顶|温度|压力|压差|液位|流量)"
VARIANT = r"(?:^|[_\-\s#.]|[温压])[ab](?:$|[_\-\s#.]|线|相|侧|温度|压力)|(?:温度|压力|流量)[ab]"
SYSTEMS = r"(?:dcs|plc|sis|rtu|hmi|apc)[_.#\-]*\d*"
PLACES = r"(?:装置\d+|[ab]线|\d+号机组|二期|主控|现场)"
CHANNELS = r"(?:测点(?:[_.#\-]*\d+)?|ch[_.#\-]*\d+)"
SEPARATORS = r"[^0-9a-z\x{4e00}-\x{9fff}]+"
NOISE = ("pv", "sp", "ai", "raw", "value", "meas")
# How often a feature of each kind counts.
TIMES = {"concept": 4, "ordinal": 6, "ordinal_pair": 3, "variant": 5, "variant_pair": 3, "concept_pair": 2}


def core(name: Column) -> Column:
    """A name without systems, places, channels, separators, noise words and bare numbers."""
    value = F.lower(name)
    for pattern in (SYSTEMS, PLACES, CHANNELS):
        value = F.regexp_replace(value, pattern, " ")
    kept = F.filter(F.split(value, SEPARATORS), lambda t: (t != "") & ~t.isin(*NOISE) & ~t.rlike(r"^\d+$"))
    return F.array_join(kept, "")


def _parts(name: str) -> dict[str, Column]:
    """What all features of a name come from: its core, concepts, ordinals and variants."""
    low = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    concepts = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(c)) for c, p in CONCEPTS.items()]))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(ORDINAL), 0), lambda m: F.regexp_extract(m, r"(\d{1,2})", 1).cast("int").cast("string"))
    letters = F.transform(F.regexp_extract_all(low, F.lit(VARIANT), 0), lambda m: F.regexp_extract(m, "([ab])", 1))
    return {"_core": core(F.col(name)), "_c": concepts, "_n": numbers, "_l": letters}


def alike(name: str) -> Column:
    """A text that is the same for names with the same features; no part holds a bar or a comma."""
    first, *lists = _parts(name).values()
    return F.concat_ws("|", first, *[F.concat_ws(",", x) for x in lists])


def name_features(names: DataFrame, name: str = "name") -> DataFrame:
    """name, term, tf of each name in a table of different names: runs of one to three characters of its core, concepts, ordinals, variants and their pairs."""
    rows = names.select(name, *[c.alias(k) for k, c in _parts(name).items()])
    said = lambda kind, term: F.struct(F.concat(F.lit(kind + ":"), term).alias("term"), F.lit(TIMES.get(kind, 1)).cast("long").alias("times"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.char_length("_core") - (n - 1)), lambda i: said(str(n), F.substr("_core", i, F.lit(n))))
    grams = [F.when(F.char_length("_core") >= n, runs(n)) for n in (1, 2, 3)]
    of = lambda c, kinds: F.filter(c, lambda x: F.substring_index(x, "_", 1).isin(*kinds))
    pairs = lambda kind, left, right: F.flatten(F.transform(right, lambda r: F.transform(left, lambda c: said(kind, F.concat(c, F.lit("+"), r)))))
    every = F.concat("_c", F.transform("_n", lambda x: F.concat(F.lit("ordinal_"), x)), F.transform("_l", lambda x: F.concat(F.lit("variant_"), x)))
    both = F.flatten(F.transform(every, lambda a: F.transform(F.filter(every, lambda b: a < b), lambda b: said("concept_pair", F.concat(a, F.lit("+"), b)))))
    found = F.concat(
        *[F.coalesce(g, F.array().cast("array<struct<term:string,times:bigint>>")) for g in grams], F.transform("_c", lambda c: said("concept", c)), F.transform("_n", lambda x: said("ordinal", x)), F.transform("_l", lambda x: said("variant", x)),
        pairs("ordinal_pair", of("_c", ("measure", "position", "direction")), F.col("_n")), pairs("variant_pair", of("_c", ("measure", "position")), F.col("_l")), both,
    )
    return rows.select(name, F.inline(found)).groupBy(name, "term").agg(F.sum("times").alias("tf"))


def _vectors(features: DataFrame, idf: DataFrame, name: str) -> DataFrame:
    """name, term, v of unit length: augmented frequency times idf over the terms that are kept; the greatest frequency is that of all terms."""
    most = features.groupBy(name).agg(F.max("tf").alias("_most"))
    known = features.join(F.broadcast(idf), "term").join(most, name).select(name, "term", ((0.5 + 0.5 * F.col("tf") / F.col("_most")) * F.col("idf")).alias("_v"))
    length = known.groupBy(name).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_length"))
    return known.join(length, name).select(name, "term", (F.col("_v") / F.col("_length")).alias("v"))


def fit_names(records: DataFrame, name: str, label: str, max_features: int = 6000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, idf), (term, label, centroid, most) and (label, prototype, term, w) of labelled names.

    A record is a name with its label, each as often as it stands there. The terms of the most records are kept,
    max_features at most, which bounds what is broadcast. A centroid is the unit mean of its records' vectors; a label has a
    prototype for each different core, the smallest name that has it. `most` is a term's greatest weight in any of them.
    """
    rows = records.filter(F.col(name).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(name).alias("name"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    features = name_features(rows.select("name").distinct())
    times = rows.groupBy("name").agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    df = features.join(times, "name").groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.orderBy(F.desc("df"), "term").limit(max_features).select("term", (F.ln((F.lit(1.0) + total) / (1 + F.col("df"))) + 1).alias("idf"))
    vectors = _vectors(features, idf, "name")
    mean = rows.join(vectors, "name").groupBy("label", "term").agg(F.sum(F.col("n") * F.col("v")).alias("_s"))
    length = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_length"))
    centroids = mean.join(length, "label").select("label", "term", (F.col("_s") / F.col("_length")).alias("centroid"))
    cores = rows.select("label", "name", core(F.col("name")).alias("_core")).filter("_core <> ''")
    chosen = cores.groupBy("label", "_core").agg(F.min("name").alias("name")).select("label", "name")
    prototypes = chosen.join(vectors, "name").select("label", F.col("name").alias("prototype"), "term", F.col("v").alias("w"))
    index = centroids.join(prototypes.groupBy("label", "term").agg(F.max("w").alias("most")), ["label", "term"], "left").fillna(0.0, ["most"])
    return idf, index, prototypes


def match_names(names: DataFrame, name: str, idf: DataFrame, index: DataFrame, prototypes: DataFrame, k: int = 5) -> DataFrame:
    """name, label, score and rank: each different name's k best labels, by the better of the centroid's and the best prototype's cosine.

    The index gives each label's centroid score and a bound of what its prototypes can reach. Only labels whose bound
    reaches the k-th best centroid score have their prototypes looked at; the result is the same as with all of them.
    Names with the same features have the same scores, so the smallest of them is looked at for all; they meet its labels
    by a broadcast of the HOT_TERMS features with the most names, the others by a shuffle.
    """
    different = names.select(F.col(name).alias("name")).filter("name is not null").distinct().repartition(names.sparkSession.sparkContext.defaultParallelism)
    different = written(different.withColumn("term", alike("name")), "names")
    asked = written(different.groupBy("term").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")), "asked")
    vectors = _vectors(name_features(asked.select("name")), idf, "name")
    hit = vectors.join(index, "term").groupBy("name", "label").agg(F.sum(F.col("v") * F.col("centroid")).alias("low"), F.sum(F.col("v") * F.col("most")).alias("bound"))
    by = Window.partitionBy("name")
    ranked = hit.withColumn("_n", F.row_number().over(by.orderBy(F.desc("low")))).withColumn("_kth", F.max(F.when(F.col("_n") == k, F.col("low"))).over(by))
    open_ = ranked.withColumn("_look", (F.col("bound") > F.col("low")) & (F.col("bound") >= F.coalesce(F.col("_kth"), F.lit(0.0)) - 1e-9))
    looked = open_.filter("_look").select("name", "label").join(vectors, "name").join(prototypes, ["label", "term"])
    best = looked.groupBy("name", "label", "prototype").agg(F.sum(F.col("v") * F.col("w")).alias("s")).groupBy("name", "label").agg(F.max("s").alias("best"))
    scored = open_.join(best, ["name", "label"], "left").select("name", "label", F.greatest("low", F.coalesce("best", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "label")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lists = best.groupBy("name").agg(F.collect_list(F.struct("label", "score", "rank")).alias("_best"))  # k labels
    return join_terms(different, written(asked.join(lists, "name").select("term", "n", "_best"), "asked-best"), "n").select("name", F.inline("_best"))


# ---- fuzzy matches


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a column of the table is one integer, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, 0 to 100; two empty strings are alike."""
    return 200 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """The shorter string against its best window of the longer one; windows may reach over either end. Of strings of one length, the better way round."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    best = max(indel(short, w) for w in windows)
    return max(best, *(indel(long, short[max(0, i) : i + n]) for i in range(1 - n, n))) if len(long) == n else best


def weighted_ratio(a: str, b: str) -> float:
    """0 to 100: the best of the indel ratio and, a little less, the ratios of sorted and of set tokens; of strings of very unlike length, of their partial forms."""
    if not a or not b:
        return 0.0
    x, y = a.split(), b.split()
    both, only_x, only_y = sorted(set(x) & set(y)), " ".join(sorted(set(x) - set(y))), " ".join(sorted(set(y) - set(x)))
    in_order = " ".join(sorted(x)), " ".join(sorted(y))
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = indel(a, b)
    if longer < 1.5:
        if both and not (only_x and only_y):
            return max(best, 95.0)
        common = len(" ".join(both))
        gap = 1 if common else 0
        left, right = common + gap + len(only_x), common + gap + len(only_y)
        away = len(only_x) + len(only_y) - 2 * subsequence(only_x, only_y)
        sets = [100 * (1 - away / (left + right))] if left + right else [0.0]
        if common:
            sets += [100 * (1 - (gap + len(only_x)) / (common + left)), 100 * (1 - (gap + len(only_y)) / (common + right))]
        return max(best, 0.95 * indel(*in_order), 0.95 * max(sets))
    scale = 0.9 if longer <= 8 else 0.6
    tokens = 100.0 if both else max(partial(*in_order), partial(only_x, only_y))
    return max(best, scale * partial(a, b), 0.95 * scale * tokens)


def _bigrams(df: DataFrame, name: str) -> DataFrame:
    """name, gram, n, length of each different name's bigrams, separators left out; a single character is a gram of its own."""
    compact = F.replace(name, F.lit("_"), F.lit(""))
    grams = F.when(F.char_length(compact) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(compact) - 1), lambda i: F.substr(compact, i, F.lit(2)))).otherwise(F.array(compact))
    counts = df.select(name).filter(F.col(name).isNotNull()).distinct().select(name, F.explode(grams).alias("gram")).filter("gram <> ''").groupBy(name, "gram").agg(F.count(F.lit(1)).alias("n"))
    length = counts.groupBy(name).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, name)


PAIRS_DDL = "name string, alias string, cosine double, ratio double"


def fuzzy_pairs(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, alias, cosine of bigram counts and weighted ratio of every different name and alias that share a bigram.

    names has a column name, aliases a column alias, both as normalised_header() gives them; nulls have no pair. Pairs
    come from a join by bigram, so the work follows what the two sides share.
    """
    left = _bigrams(names, "name")
    right = _bigrams(aliases, "alias").withColumnsRenamed({"n": "m", "length": "other"})
    pairs = left.join(right, "gram").groupBy("name", "alias").agg((F.sum(F.col("n") * F.col("m")) / F.max(F.col("length") * F.col("other"))).alias("cosine"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [weighted_ratio(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], names=["name", "alias", "cosine", "ratio"])

    return pairs.mapInArrow(run, PAIRS_DDL)


def fuzzy_match(names: DataFrame, aliases: DataFrame, sequence: float = 0.58) -> DataFrame:
    """name, alias and score of each different name's best alias: `sequence` parts weighted ratio, the rest bigrams; ties go to the smaller alias."""
    scored = fuzzy_pairs(names, aliases).withColumn("score", sequence * F.col("ratio") / 100 + (1 - sequence) * F.col("cosine"))
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "alias", "score"))
    return scored.groupBy("name").agg(best.alias("b")).select("name", "b.alias", "b.score")
