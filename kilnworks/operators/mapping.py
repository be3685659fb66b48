"""Mapping of raw columns to standard fields: headers, units, types, aliases, evidence and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.functions.numeric import clip, finite

#: How units are written, and their names.
UNIT_ALIASES = {
    "℃": "degC", "°c": "degC", "degc": "degC", "c": "degC", "°f": "degF", "degf": "degF", "k": "K", "pa": "Pa", "kpa": "kPa", "mpa": "MPa", "nm3/h": "Nm3/h", "nm³/h": "Nm3/h", "m3/h": "m3/h", "m³/h": "m3/h", "mw": "MW", "rpm": "rpm",
    "a": "A", "hz": "Hz", "mg/l": "mg/L", "ph": "pH", "m/min": "m/min", "m/s": "m/s", "mm": "mm", "t/h": "t/h", "kg/h": "kg/h", "%": "percent", "percent": "percent",
}
#: Fixed values: (from, to, factor, offset) of the six conversions, x * factor + offset.
CONVERSIONS = [("degF", "degC", 5.0 / 9.0, -32.0 * 5.0 / 9.0), ("K", "degC", 1.0, -273.15), ("kPa", "Pa", 1000.0, 0.0), ("MPa", "Pa", 1e6, 0.0), ("m/s", "m/min", 60.0, 0.0), ("kg/h", "t/h", 0.001, 0.0)]
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "y", "是", "有效"], ["0", "false", "no", "n", "否", "无效"]
#: Methods whose matches need no token evidence.
CURATED = ["alias", "normalized_alias", "learned_alias", "point_dictionary"]


def normalised_header(header: Column) -> Column:
    """Lower case, with runs of separators as one underscore and none at the ends."""
    joined = F.regexp_replace(F.lower(F.trim(header)), r"[\s\-./\\:()\[\]（）【】_]+", "_")
    return F.regexp_replace(joined, r"^_+|_+$", "")


def _alias_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])


def split_unit(header: Column) -> dict[str, Column]:
    """base and unit: the last bracketed known unit, else the longest known suffix after an underscore; single letters only in upper case."""
    text = F.trim(header)
    bracket = r"^(.*)[\[(（【]([^\])）】]+)[\])）】]([^\[(（【]*)$"
    inner = F.element_at(_alias_map(), F.lower(F.replace(F.trim(F.regexp_extract(text, bracket, 2)), F.lit(" "), F.lit(""))))
    outer = F.regexp_replace(F.concat(F.regexp_extract(text, bracket, 1), F.regexp_extract(text, bracket, 3)), r"^[ _\-]+|[ _\-]+$", "")
    base, unit = text, F.lit(None).cast("string")
    lowered = F.lower(text)
    for alias in sorted(UNIT_ALIASES, key=len):  # the last that is set is the longest
        suffix = F.endswith(text, F.lit("_" + alias.upper())) if len(alias) == 1 else F.endswith(lowered, F.lit("_" + alias))
        unit = F.when(suffix, F.lit(UNIT_ALIASES[alias])).otherwise(unit)
        base = F.when(suffix, F.expr("left(_h, greatest(0, char_length(_h) - {}))".format(len(alias) + 1))).otherwise(base)
    return {"base": F.when(inner.isNotNull(), outer).otherwise(base), "unit": F.coalesce(inner, unit)}


def conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSIONS, "source string, target string, factor double, shift double")


def coerce(raw: Column, kind: str) -> Column:
    """raw, a string, as the declared type, null where it cannot be: fractions are no integers, and booleans have a vocabulary."""
    text = F.trim(raw)
    if kind == "float":
        return finite(text.try_cast("double"))
    if kind == "integer":
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if kind == "datetime":
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw


def with_dates(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the column as timestamps: year first, unless more of its values can be read day first.

    The choice holds for the whole column: one aggregate counts, and one number comes to the driver.
    """
    first = F.try_to_timestamp(F.trim(column), F.lit("yyyy-MM-dd HH:mm:ss"))
    day = F.try_to_timestamp(F.trim(column), F.lit("dd/MM/yyyy"))
    day_first = rows.agg(F.count(day) > F.count(first)).first()[0]
    return rows.withColumn(name, day if day_first else first)


def with_derived_time(rows: DataFrame, origin: Column, elapsed: Column, seconds: int, name: str) -> DataFrame:
    """rows with origin and elapsed units as a time, if every value there is can be read and two are there at least; else nulls."""
    number = finite(elapsed.try_cast("double"))
    known = rows.agg(F.count(number).alias("read"), F.count(elapsed).alias("all")).first()
    whole = known["read"] == known["all"] and known["read"] >= 2
    time = F.timestamp_micros(F.unix_micros(origin) + F.round(number * seconds * 1_000_000).cast("long"))
    return rows.withColumn(name, time if whole else F.lit(None).cast("timestamp"))


def value_profile(rows: DataFrame, kind: str, low: float | None, high: float | None, order: str, value: str = "value", keys: Sequence[str] = ("field",), sample: int = 2000) -> DataFrame:
    """keys, missing_ratio, plausibility and anomaly_ratio of each field's first rows, taken as numbers."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= sample)
    x = finite(F.col(value).try_cast("double"))
    out = F.lit(0)
    if low is not None:
        out = out + F.count_if(x < low)
    if high is not None:
        out = out + F.count_if(x > high)
    have, valid = F.count(value), F.count(x)
    share = valid / F.nullif(have, F.lit(0))
    outside = out / F.greatest(valid, F.lit(1))
    fraction = F.coalesce(F.count_if(x != F.floor(x)) / F.nullif(valid, F.lit(0)), F.lit(0.0)) if kind == "integer" else F.lit(0.0)
    plausible = F.greatest(F.lit(0.0), share * (1 - outside) * (1 - fraction)) * F.when(F.coalesce(F.min(x) == F.max(x), F.lit(True)), 0.92).otherwise(1.0)
    return first.groupBy(*keys).agg(
        F.round(1 - have / F.count(F.lit(1)), 3).alias("missing_ratio"), F.round(F.coalesce(plausible, F.lit(0.0)), 3).alias("plausibility"), F.round(F.coalesce(F.least(F.lit(1.0), 1 - share + outside + fraction), F.lit(0.0)), 3).alias("anomaly_ratio"),
    )


def adjusted_confidence(score: Column, unit_conflict: Column, plausibility: Column, missing: Column, method: Column) -> Column:
    """Names nominate a field; units and values can lower what they say."""
    capped = F.when(unit_conflict, F.least(score, F.lit(0.58))).otherwise(score)
    scaled = capped * F.coalesce(0.72 + 0.28 * plausibility, F.lit(1.0))
    return F.when((missing >= 0.8) & ~method.isin(*CURATED), scaled * 0.72).otherwise(scaled)


def unique_alias(names: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Rows of names joined with the one standard of their key; keys that several standards share match none."""
    one = aliases.groupBy(key).agg(F.min("standard").alias("standard"), F.max("standard").alias("_other")).filter("standard = _other").drop("_other")
    return names.join(one, key, "left")


def one_for_each_target(matches: DataFrame, auto: float) -> DataFrame:
    """status: of the columns that match a standard the best, by gate, then manual, then confidence, is matched or up for review; the rest are duplicates."""
    w = Window.partitionBy("standard").orderBy(F.desc("gate"), F.desc(F.col("method") == "manual"), F.desc("confidence"), "raw")
    place = F.row_number().over(w)
    return matches.withColumn("status", F.when(F.col("standard").isNull(), "unmapped").when(place > 1, "duplicate").when((F.col("confidence") >= auto) & F.col("gate"), "matched").otherwise("review"))


#: Patterns of the words that tell what a name measures, where, and in which direction.
QUANTITIES = {"temperature": r"\b(temp|temperature)\b|温度|顶温|底温", "pressure": r"\b(pressure|press)\b|压力", "flow": r"\bflow\b|流量"}
LOCATIONS = {
    "reboiler_outlet": r"\breboiler\b|重沸器", "feed": r"\bfeed\b|进料", "column_top": r"\btop\b|塔顶", "column_bottom": r"\bbottom\b|塔底",
    "tray_6": r"\btray\s*6\b|\bsixth\s+tray\b|第六塔板",
}
DIRECTIONS = {
    "inlet": r"\b(feed|inlet)\b|进料|入口", "reflux": r"\breflux\b|回流", "recycle": r"\brecycle\b|再循环",
    "downstream": r"\bdownstream\b|\bnext\s+process\b|下游|后续流程", "outlet": r"\boutlet\b|出口|出料",
}
SETPOINT = r"\b(setpoint|sp|target)\b|设定"
OTHER_EQUIPMENT = r"\b(furnace|dryer|boiler|reactor)\b|高炉|干燥器|锅炉|反应器"
ANONYMOUS = r"^([uxy]\d*|(normalized|scaled|column|feature)[_ -]*\d+)$"
DIMENSIONS = ("quantity_type", "physical_role", "equipment_role", "measurement_location", "measurement_channel", "flow_direction")


def _only(found: Column) -> Column:
    """The one thing found, 'conflict' for several, null for none."""
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).when(F.size(found) > 1, "conflict")


def name_semantics(name: Column) -> dict[str, Column]:
    """The DIMENSIONS that the words of a name tell; null where it says nothing and 'conflict' where it says two things."""
    text = F.regexp_replace(F.lower(name), r"[_/.\-]+", " ")
    has = lambda pattern: text.rlike(f"(?U){pattern}")
    said = lambda words: F.array_compact(F.array(*[F.when(has(p), n) for n, p in words.items()]))
    quantity = _only(said(QUANTITIES))
    other_tray = F.exists(F.regexp_extract_all(text, F.lit(r"\btray\s*(\d+)\b"), F.lit(1)), lambda n: n != "6")
    places = F.concat(said(LOCATIONS), F.when(other_tray, F.array(F.lit("other_tray"))).otherwise(F.array().cast("array<string>")))
    ways = said(DIRECTIONS)
    direction = F.when((F.size(ways) == 2) & F.array_contains(ways, "downstream") & F.array_contains(ways, "outlet"), "downstream").otherwise(_only(ways))
    line = F.when((quantity == "flow") & (direction == "reflux"), "reflux_line").when((quantity == "flow") & (direction == "downstream"), "downstream_line")
    location = F.coalesce(_only(places), line)
    at_reboiler, at_feed = F.array_contains(places, "reboiler_outlet"), F.array_contains(places, "feed")
    equipment = F.when(has(OTHER_EQUIPMENT), "other_equipment").when(at_reboiler, "reboiler").when(at_feed, "feed_line").when(location.isNotNull(), "column")
    return {
        "quantity_type": quantity, "physical_role": F.when(quantity.isNotNull(), F.when(has(SETPOINT), "setpoint").otherwise("process_measurement")), "equipment_role": equipment,
        "measurement_location": location, "measurement_channel": _only(said({"a": r"\ba\b", "b": r"\bb\b"})), "flow_direction": direction,
    }


def physical_gates(observed: dict[str, Column], contract: dict[str, Column], trusted: Column, confidence: Column, unit_status: Column, threshold: float) -> dict[str, Column]:
    """The seven gates of a candidate against a field's contract (the DIMENSIONS it states; all null without one).

    A trusted method fills what the name does not say with the contract, and never overrules what it says.
    """
    stated = F.coalesce(*contract.values()).isNotNull()
    source = {k: F.when(trusted, F.coalesce(observed[k], contract[k])).otherwise(observed[k]) for k in DIMENSIONS}
    same = {k: F.coalesce(source[k] == contract[k], F.lit(False)) for k in DIMENSIONS}
    sure, free = confidence >= threshold, trusted & ~stated
    place = same["measurement_location"] & same["equipment_role"] & (contract["measurement_channel"].isNull() | same["measurement_channel"])
    flows = F.coalesce(contract["quantity_type"] == "flow", F.lit(False))
    return {
        "semantic_similarity": sure, "unit_compatible": unit_status.isin("consistent", "convertible") | (trusted & (unit_status == "not_declared")), "quantity_type": free | same["quantity_type"],
        "physical_role": free | same["physical_role"], "location": free | place, "direction": free | ~flows | same["flow_direction"],
        "source_confidence": trusted | (stated & sure & F.coalesce(source["equipment_role"] == "column", F.lit(False))),
    }


def all_of(gates: Sequence[Column]) -> Column:
    out = F.lit(True)
    for g in gates:
        out = out & g
    return out


def convertible(source: Column, target: Column) -> Column:
    """Whether the two units are one, or one of the conversions leads from the first to the second."""
    return F.coalesce((source == target) | F.struct(source, target).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b, _, _ in CONVERSIONS]), F.lit(False))


def acceptance_gates(c: dict[str, Column], threshold: float) -> dict[str, Column]:
    """The ten gates that a mapped column passes before it is accepted without review.

    c: raw, target, method, confidence, unit_status, expected_unit, scenario; defined (whether the target is a field of
    the scenario), field_unit, has_contract (of the scenario), contract_<dimension>; meta_source, meta_field,
    meta_scenario, meta_unit, meta_normalized, meta_restored, meta_<dimension> of what the source's documentation says;
    point_resolved, point_scene, point_field, point_unit of a point dictionary's entry. Nulls are things not stated.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    trusted, anonymous = c["method"].isin(*CURATED), yes(F.lower(F.trim(c["raw"])).rlike(ANONYMOUS))
    scoped = yes(c["meta_source"].isNotNull() & (c["meta_field"] == c["target"]) & (c["meta_scenario"] == c["scenario"]))
    defined, sure = yes(c["defined"]), c["confidence"] >= threshold
    identity = F.when(anonymous | (c["method"] == "normalization_mapping"), scoped).otherwise(defined & (trusted | (c["method"] == "manual") | sure))
    status = F.when(scoped & yes(c["meta_unit"] == c["expected_unit"]) & (c["unit_status"] == "not_declared"), "consistent").otherwise(c["unit_status"])
    unit = status.isin("consistent", "convertible") | (trusted & ~anonymous & (status == "not_declared"))
    restored = c["meta_unit"].isNotNull() & (yes(~c["meta_normalized"]) | yes(c["meta_restored"]))
    contract = {k: c[f"contract_{k}"] for k in DIMENSIONS}
    observed = name_semantics(c["raw"])
    bound = all_of(list(physical_gates(observed, contract, scoped | trusted, c["confidence"], status, threshold).values()))
    wanted = name_semantics(F.coalesce(c["target"], F.lit("")))
    loose = trusted & all_of([~yes(observed[k] != wanted[k]) for k in DIMENSIONS])
    point = yes(c["point_resolved"] & (c["point_scene"] == c["scenario"]) & (c["point_field"] == c["target"]) & (c["point_unit"].isNull() | convertible(c["point_unit"], c["expected_unit"])))
    agreed = all_of([~yes(c[f"meta_{k}"] != contract[k]) for k in DIMENSIONS]) & (c["meta_unit"].isNull() | convertible(c["meta_unit"], c["expected_unit"]))
    return {
        "metadata_consistency": agreed, "point_dictionary_binding": (c["method"] != "point_dictionary") | point, "candidate_exists": defined, "identity_basis": identity,
        "unit": unit & defined & yes(c["expected_unit"] == c["field_unit"]), "physical_semantics": F.when(c["target"].isNotNull() & yes(c["has_contract"]), bound).otherwise(loose), "source_confidence": sure,
        "provenance": ~anonymous | scoped, "normalization_metadata": ~(anonymous | yes(c["meta_normalized"])) | (scoped & restored), "scenario_compatibility": c["meta_scenario"].isNull() | yes(c["meta_scenario"] == c["scenario"]),
    }


def acceptance(gates: dict[str, Column], defined: Column) -> dict[str, Column]:
    """failures (names of the gates that fail, in order) and decision."""
    failures = F.concat_ws(" ", *[F.when(~g, name) for name, g in gates.items()])
    return {"failures": failures, "decision": F.when(failures == "", "AUTO_ACCEPT").when(F.coalesce(defined, F.lit(False)), "REVIEW_REQUIRED").otherwise("REJECT")}


def scenario_score(required: Column, support: Column, confidence: Column, evidence: Column, least: Column, keyword: Column, conflicts: Column, units: Column, abnormal: Column, missing: Column) -> Column:
    """Weighted evidence for a scenario less its conflicts, within 0 and 1; at most 0.42 with too little evidence."""
    plus = 0.47 * required + 0.18 * support + 0.22 * confidence + 0.08 * F.least(evidence / F.greatest(least, F.lit(1)), F.lit(1.0)) + 0.05 * F.least(keyword, F.lit(1))
    minus = 0.08 * conflicts + 0.07 * units + F.least(F.lit(0.12), 0.03 * abnormal + 0.02 * missing)
    return clip(F.when(evidence < least, F.least(plus - minus, F.lit(0.42))).otherwise(plus - minus), 0, 1)


def data_decision(ambiguous: Column, confidence: Column, coverage: Column, unit_risks: Column, reviews: Column, unconverted: Column, type_errors: Column, schema_failed: Column) -> Column:
    clean = (coverage == 1.0) & (unit_risks == 0) & (reviews == 0) & (unconverted == 0)
    return (
        F.when(ambiguous & ((confidence < 0.35) | (coverage < 0.5)), "reject").when(ambiguous, "review").when(clean & (type_errors == 0) & ~schema_failed, "ready").when(clean, "review")
        .when((confidence >= 0.45) & (coverage >= 0.5), "review").otherwise("reject")
    )
