"""Queries of column mapping. Their inputs are names made from the tables' values, so they grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.operators import mapping, names as naming

from .base import query, r6, table

#: Raw column names: brands, types and sizes of parts put together as plants name their tags, in both engines alike.
HEADERS = """H AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name || ' (K)' WHEN 1 THEN 'Top Temp [°C]' WHEN 2 THEN replace(p_brand, '#', '-') || '_pressure_kPa' WHEN 3 THEN 'PT_' || p_size || '.AV_0' WHEN 4 THEN ' Feed.Flow/' || p_size || '_kg/h ' WHEN 5 THEN 'TE_' || p_partkey WHEN 6 THEN 'upper_furnace_pressure_c' ELSE 'Motor_' || p_size || '_A' END AS header FROM part)"""


def headers(s: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    name = (
        F.when(k == 0, F.concat("p_name", F.lit(" (K)"))).when(k == 1, F.lit("Top Temp [°C]")).when(k == 2, F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("_pressure_kPa"))).when(k == 3, F.concat(F.lit("PT_"), size, F.lit(".AV_0")))
        .when(k == 4, F.concat(F.lit(" Feed.Flow/"), size, F.lit("_kg/h "))).when(k == 5, F.concat(F.lit("TE_"), F.col("p_partkey").cast("string"))).when(k == 6, F.lit("upper_furnace_pressure_c")).otherwise(F.concat(F.lit("Motor_"), size, F.lit("_A")))
    )
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), name.alias("header"))


NORM = r"regexp_replace(regexp_replace(lower(trim(header)), '[\s\-./\\:()\[\]（）【】_]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("q_hdr_normalize", f"WITH {HEADERS} SELECT id, {NORM} AS name FROM H")
def hdr_normalize(s: SparkSession, d: str) -> DataFrame:
    return headers(s, d).select("id", mapping.normalised_header(F.col("header")).alias("name"))


UNITS = "U AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{u}')" for a, u in mapping.UNIT_ALIASES.items()) + ") t(alias, unit))"
SPLIT = UNITS + r""", B AS (SELECT id, trim(header) AS t, regexp_extract(trim(header), '^(.*)[\[(（【]([^\])）】]+)[\])）】]([^\[(（【]*)$', 2) AS inside FROM H),
  X AS (SELECT B.*, u1.unit AS u1, (SELECT max_by((alias, U.unit), length(alias)) FROM U WHERE CASE WHEN length(alias) = 1 THEN ends_with(t, '_' || upper(alias)) ELSE ends_with(lower(t), '_' || alias) END) AS sfx FROM B LEFT JOIN U u1 ON u1.alias = replace(lower(trim(inside)), ' ', '')),
  R AS (SELECT id, CASE WHEN u1 IS NOT NULL THEN regexp_replace(regexp_replace(t, '^(.*)[\[(（【]([^\])）】]+)[\])）】]([^\[(（【]*)$', '\1\3'), '^[ _\-]+|[ _\-]+$', '', 'g') WHEN sfx IS NOT NULL THEN left(t, length(t) - length(sfx[1]) - 1) ELSE t END AS base, coalesce(u1, sfx[2]) AS unit FROM X)"""


def split_headers(s: SparkSession, d: str) -> DataFrame:
    h = headers(s, d).withColumn("_h", F.trim("header"))
    return h.select("id", *[c.alias(n) for n, c in mapping.split_unit(F.col("header")).items()])


@query("q_hdr_unit_split", f"WITH {HEADERS}, {SPLIT} SELECT id, base, unit FROM R")
def hdr_unit_split(s: SparkSession, d: str) -> DataFrame:
    return split_headers(s, d)


CONV = "C AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {f!r}, {o!r})" for a, b, f, o in mapping.CONVERSIONS) + ") t(source, target, factor, shift))"


@query("q_unit_convert", f"WITH {HEADERS}, {SPLIT}, {CONV}, V AS (SELECT R.id, unit, p_retailprice AS x FROM R JOIN part ON p_partkey = id) SELECT id, unit, target, round(coalesce(x * factor + shift, x), 6) AS value FROM V LEFT JOIN C ON unit = source")
def unit_convert(s: SparkSession, d: str) -> DataFrame:
    v = split_headers(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x")), "id")
    c = F.broadcast(mapping.conversions(s))  # six rows
    return v.join(c, F.col("unit") == F.col("source"), "left").select("id", "unit", "target", F.round(F.coalesce(F.col("x") * F.col("factor") + F.col("shift"), "x"), 6).alias("value"))


#: Messy cells, of which the kind follows from the key.
CELLS = "K AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_custkey || '.5' WHEN 2 THEN ' ' || o_custkey || ' ' WHEN 3 THEN 'x' WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN '是' ELSE 'No' END ELSE '1e400' END AS cell FROM orders)"


def cells(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    cell = F.when(k == 0, c).when(k == 1, F.concat(c, F.lit(".5"))).when(k == 2, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 3, "x").when(k == 4, None).when(k == 5, F.when(F.col("o_custkey") % 2 == 0, "是").otherwise("No")).otherwise("1e400")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), cell.alias("cell"))


FLOAT = "CASE WHEN isfinite(try_cast(trim(cell) AS DOUBLE)) THEN try_cast(trim(cell) AS DOUBLE) END"


@query("q_coerce_types", f"WITH {CELLS} SELECT id, {FLOAT} AS as_float, CASE WHEN {FLOAT} = floor({FLOAT}) THEN CAST({FLOAT} AS BIGINT) END AS as_integer, CASE WHEN lower(trim(cell)) IN ('1', 'true', 'yes', 'y', '是', '有效') THEN true WHEN lower(trim(cell)) IN ('0', 'false', 'no', 'n', '否', '无效') THEN false END AS as_boolean FROM K")
def coerce_types(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).select("id", *[mapping.coerce(F.col("cell"), k).alias(f"as_{k}") for k in ("float", "integer", "boolean")])


@query("q_coerce_dates", "WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS cell FROM orders) SELECT id, strftime(CASE WHEN count(try_strptime(cell, '%d/%m/%Y')) OVER () > count(try_strptime(cell, '%Y-%m-%d %H:%M:%S')) OVER () THEN try_strptime(cell, '%d/%m/%Y') ELSE try_strptime(cell, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d') AS day FROM k")
def coerce_dates(s: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    k = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(t, "dd/MM/yyyy")).alias("cell"))
    return mapping.with_dates(k, "cell", "t").select("id", F.date_format("t", "yyyy-MM-dd").alias("day"))


@query("q_derive_time", "SELECT l_orderkey, l_linenumber, CAST(epoch_us(TIMESTAMP '2024-01-01') + CAST(l_quantity * 3600000000 AS BIGINT) AS BIGINT) AS us FROM lineitem")
def derive_time(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = mapping.with_derived_time(rows, F.lit("2024-01-01").cast("timestamp"), F.col("l_quantity").cast("string"), 3600, "t")
    return t.select("l_orderkey", "l_linenumber", F.unix_micros("t").alias("us"))


@query("q_bounds_violations", "SELECT p_brand, count(*) FILTER (p_size < 5) AS below, count(*) FILTER (p_size > 45) AS above FROM part GROUP BY 1")
def bounds_violations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 5).alias("below"), F.count_if(F.col("p_size") > 45).alias("above"))


@query("q_schema_validate", f"WITH {CELLS} SELECT * FROM (SELECT 'cell' AS field, 'nullable' AS rule, count(*) FILTER (cell IS NULL) AS failures FROM K UNION ALL SELECT 'cell', 'dtype', count(*) FILTER (cell IS NOT NULL AND {FLOAT} IS NULL) FROM K UNION ALL SELECT 'cell', 'bounds', count(*) FILTER ({FLOAT} < 10 OR {FLOAT} > 1000) FROM K) WHERE failures > 0")
def schema_validate(s: SparkSession, d: str) -> DataFrame:
    x = mapping.coerce(F.col("cell"), "float")
    one = cells(s, d).agg(F.count_if(F.col("cell").isNull()).alias("nullable"), F.count_if(F.col("cell").isNotNull() & x.isNull()).alias("dtype"), F.count_if((x < 10) | (x > 1000)).alias("bounds"))
    return one.unpivot([], ["nullable", "dtype", "bounds"], "rule", "failures").filter("failures > 0").select(F.lit("cell").alias("field"), "rule", "failures")


@query("q_value_profile", f"WITH {CELLS}, f AS (SELECT id % 10 AS field, id, cell FROM K), t AS (SELECT field, {FLOAT} AS x, cell FROM f QUALIFY row_number() OVER (PARTITION BY field ORDER BY id) <= 2000), a AS (SELECT field, count(*) AS n, count(cell) AS have, count(x) AS valid, count(*) FILTER (x < 10) + count(*) FILTER (x > 1000) AS bad, count(*) FILTER (x <> floor(x)) AS frac, coalesce(min(x) = max(x), true) AS constant FROM t GROUP BY 1), b AS (SELECT *, valid / nullif(have, 0) AS share, bad / greatest(valid, 1) AS outside, coalesce(frac / nullif(valid, 0), 0) AS fr FROM a) SELECT field, round(1 - have / n, 3) AS missing_ratio, round(coalesce(greatest(0, share * (1 - outside) * (1 - fr)) * CASE WHEN constant THEN .92 ELSE 1 END, 0), 3) AS plausibility, round(coalesce(least(1, 1 - share + outside + fr), 0), 3) AS anomaly_ratio FROM b")
def value_profile(s: SparkSession, d: str) -> DataFrame:
    return mapping.value_profile(cells(s, d).withColumn("field", F.col("id") % 10), "integer", 10, 1000, "id", "cell")


#: Aliases of the standard fields, which are the nations' names.
ALIASES = "A AS (SELECT n_name AS standard, lower(n_name) AS alias FROM nation UNION ALL SELECT n_name, lower(n_name) || '_flow' FROM nation UNION ALL SELECT n_name, 'shared_' || n_regionkey FROM nation)"
NAMES = "N AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(n_name) || '_flow' WHEN 2 THEN 'shared_' || n_regionkey ELSE 'dcs_' || lower(n_name) || '_pv' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def aliases(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation")
    low = F.lower("n_name")
    return n.select(F.col("n_name").alias("standard"), F.explode(F.array(low, F.concat(low, F.lit("_flow")), F.concat(F.lit("shared_"), F.col("n_regionkey").cast("string")))).alias("alias"))


def names(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select("n_nationkey", F.lower("n_name").alias("low"), F.col("n_regionkey").cast("string").alias("r"))
    k = F.col("c_custkey") % 4
    c = table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select(F.col("c_custkey").alias("id"), F.when(k == 0, F.col("low")).when(k == 1, F.concat("low", F.lit("_flow"))).when(k == 2, F.concat(F.lit("shared_"), "r")).otherwise(F.concat(F.lit("dcs_"), "low", F.lit("_pv"))).alias("name"))


@query("q_alias_match", f"WITH {ALIASES}, {NAMES}, u AS (SELECT alias, min(standard) AS standard FROM A GROUP BY 1 HAVING count(DISTINCT standard) = 1) SELECT id, standard FROM N LEFT JOIN u ON name = alias")
def alias_match(s: SparkSession, d: str) -> DataFrame:
    return mapping.unique_alias(names(s, d).withColumnRenamed("name", "alias"), aliases(s, d), "alias").select("id", "standard")


@query("q_alias_compact", f"WITH {ALIASES}, {NAMES}, u AS (SELECT replace(alias, '_', '') AS k, min(standard) AS standard FROM A GROUP BY 1 HAVING count(DISTINCT standard) = 1) SELECT id, standard FROM N LEFT JOIN u ON replace(name, '_', '') = k")
def alias_compact(s: SparkSession, d: str) -> DataFrame:
    compact = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    return mapping.unique_alias(names(s, d).withColumn("k", compact("name")), aliases(s, d).withColumn("k", compact("alias")), "k").select("id", "standard")


@query("q_fuzzy_match")
def fuzzy_match(s: SparkSession, d: str) -> DataFrame:
    """Every different name's best alias, whatever is exact or not."""
    return naming.fuzzy_match(names(s, d), aliases(s, d)).select("name", "alias", *r6("score"))


CASES = ", ".join(f"('{c}', '{p}')" for c, p in naming.CONCEPTS.items())
NOISE = ", ".join(f"'{w}'" for w in naming.NOISE)


def _name_features_sql(source: str) -> str:
    """Features (name, term, tf) of the names of a relation."""
    t = naming.TIMES
    grams = " UNION ALL ".join(f"SELECT name, '{n}:' || unnest(list_transform(range(1, length(core) - {n} + 2), lambda i: substr(core, i, {n}))) AS term, 1 AS times FROM base WHERE length(core) >= {n}" for n in (1, 2, 3))
    return f"""base AS (SELECT name, replace(lower(name), '_', ' ') AS low, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(name), '{naming.SYSTEMS}', ' ', 'g'), '{naming.PLACES}', ' ', 'g'), '{naming.CHANNELS}', ' ', 'g'), '{naming.SEPARATORS}'), lambda x: x <> '' AND x NOT IN ({NOISE}) AND NOT regexp_full_match(x, '[0-9]+')), '') AS core FROM {source}),
  cc AS (SELECT name, concept AS c FROM base JOIN (VALUES {CASES}) t(concept, pattern) ON regexp_matches(low, pattern)),
  oo AS (SELECT name, CAST(CAST(regexp_extract(m, '([0-9]{{1,2}})', 1) AS INTEGER) AS VARCHAR) AS x FROM (SELECT name, unnest(regexp_extract_all(low, '{naming.ORDINAL}')) AS m FROM base)),
  vv AS (SELECT name, regexp_extract(m, '([ab])', 1) AS x FROM (SELECT name, unnest(regexp_extract_all(low, '{naming.VARIANT}')) AS m FROM base)),
  every AS (SELECT name, c FROM cc UNION ALL SELECT name, 'ordinal_' || x FROM oo UNION ALL SELECT name, 'variant_' || x FROM vv),
  said AS ({grams} UNION ALL SELECT name, 'concept:' || c, {t['concept']} FROM cc UNION ALL SELECT name, 'ordinal:' || x, {t['ordinal']} FROM oo UNION ALL SELECT name, 'variant:' || x, {t['variant']} FROM vv
    UNION ALL SELECT name, 'ordinal_pair:' || c || '+' || x, {t['ordinal_pair']} FROM cc JOIN oo USING (name) WHERE regexp_matches(c, '^(measure|position|direction)_')
    UNION ALL SELECT name, 'variant_pair:' || c || '+' || x, {t['variant_pair']} FROM cc JOIN vv USING (name) WHERE regexp_matches(c, '^(measure|position)_')
    UNION ALL SELECT a.name, 'concept_pair:' || a.c || '+' || b.c, {t['concept_pair']} FROM every a JOIN every b ON a.name = b.name AND a.c < b.c),
  F AS (SELECT name, term, CAST(sum(times) AS BIGINT) AS tf FROM said GROUP BY 1, 2)"""


LABELLED = "rec AS (SELECT p_name || '_' || p_type || CASE WHEN p_size % 5 = 0 THEN ' top temp ' || p_size ELSE '' END AS name, p_brand AS label, count(*) AS n FROM part GROUP BY 1, 2)"
CHAR_MODEL = f"""{HEADERS}, {LABELLED}, allnames AS (SELECT name FROM rec UNION SELECT header FROM H), {_name_features_sql("allnames")},
  tot AS (SELECT sum(n) AS total FROM rec), df AS (SELECT term, sum(n) AS df FROM F JOIN (SELECT name, sum(n) AS n FROM rec GROUP BY 1) USING (name) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6000),
  idf AS (SELECT term, ln((1.0 + total) / (1 + df)) + 1 AS idf FROM df, tot), most AS (SELECT name, max(tf) AS most FROM F GROUP BY 1),
  raw AS (SELECT F.name, F.term, (.5 + .5 * tf / most) * idf AS v FROM F JOIN idf USING (term) JOIN most USING (name)), vec AS (SELECT name, term, v / sqrt(sum(v * v) OVER (PARTITION BY name)) AS v FROM raw),
  mean AS (SELECT label, term, sum(n * v) AS c FROM rec JOIN vec USING (name) GROUP BY 1, 2), cen AS (SELECT label, term, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS c FROM mean),
  pro AS (SELECT label, min(rec.name) AS prototype FROM rec JOIN base USING (name) WHERE core <> '' GROUP BY label, core), q AS (SELECT DISTINCT header AS name FROM H),
  sc AS (SELECT q.name, label, sum(v * c) AS s FROM q JOIN vec USING (name) JOIN cen USING (term) GROUP BY 1, 2),
  sp AS (SELECT name, label, max(s) AS s FROM (SELECT q.name, pro.label, prototype, sum(a.v * b.v) AS s FROM q JOIN vec a ON a.name = q.name JOIN vec b ON a.term = b.term JOIN pro ON b.name = pro.prototype GROUP BY 1, 2, 3) GROUP BY 1, 2),
  al AS (SELECT name, label, greatest(sc.s, coalesce(sp.s, 0)) AS s FROM sc LEFT JOIN sp USING (name, label)), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY round(s, 9) DESC, label) AS INTEGER) AS rank FROM al)"""


def char_model(s: SparkSession, d: str) -> DataFrame:
    """Names of parts, labelled with their brands, teach a model by which headers are judged."""
    size = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" top temp "), F.col("p_size").cast("string"))).otherwise("")
    records = table(s, d, "part").select(F.concat("p_name", F.lit("_"), "p_type", size).alias("name"), F.col("p_brand").alias("label"))
    return naming.match_names(headers(s, d), "header", *naming.fit_names(records, "name", "label"))


@query("q_char_model", f"WITH {CHAR_MODEL} SELECT name, label, round(s, 6) AS score, rank FROM rk WHERE rank <= 5")
def char_model_query(s: SparkSession, d: str) -> DataFrame:
    return char_model(s, d).select("name", "label", *r6("score"), "rank")


CORE = "regexp_replace({}, '(^|_)(dcs|plc|scada|opc|tag|pv|av|val|value)(?=_|$)', '', 'g')"


@query("q_core_alias", f"WITH {ALIASES}, {NAMES}, u AS (SELECT trim({CORE.format('alias')}, '_') AS k, min(standard) AS standard FROM A GROUP BY 1 HAVING count(DISTINCT standard) = 1) SELECT id, standard, CAST(CASE WHEN standard IS NOT NULL THEN 0.96 END AS DOUBLE) AS confidence FROM (SELECT id, trim({CORE.format('name').replace('(?=_|$)', '(?=_|$)')}, '_') AS k FROM N) LEFT JOIN u USING (k)".replace("(?=_|$)', '', 'g')", "_|(^|_)(dcs|plc|scada|opc|tag|pv|av|val|value)$', '_', 'g')"))
def core_alias(s: SparkSession, d: str) -> DataFrame:
    """Names without the tokens that control systems add match their core."""
    noise = "dcs|plc|scada|opc|tag|pv|av|val|value"
    core = lambda c: F.regexp_replace(F.regexp_replace(c, f"(^|_)({noise})_|(^|_)({noise})$", "_"), "^_+|_+$", "")
    found = mapping.unique_alias(names(s, d).withColumn("k", core("name")), aliases(s, d).withColumn("k", core("alias")), "k")
    return found.select("id", "standard", F.when(F.col("standard").isNotNull(), 0.96).alias("confidence"))


@query("q_opaque_tag", f"WITH {HEADERS} SELECT id, regexp_matches(lower(trim(header)), '^[a-z]{{1,8}}_?[0-9]+([._#a-z0-9]*)$') AS opaque FROM H")
def opaque_tag(s: SparkSession, d: str) -> DataFrame:
    return headers(s, d).select("id", F.lower(F.trim("header")).rlike(r"^[a-z]{1,8}_?[0-9]+([._#a-z0-9]*)$").alias("opaque"))


@query("q_point_dict", f"WITH {HEADERS}, pd AS (SELECT 'TE_' || s_suppkey AS point, s_name AS standard FROM supplier) SELECT id, standard, CAST(CASE WHEN standard IS NOT NULL THEN 1.0 WHEN regexp_matches(header, '^(TE|PT|FT)_') THEN 0.35 ELSE 0 END AS DOUBLE) AS confidence FROM H LEFT JOIN pd ON header = point")
def point_dict(s: SparkSession, d: str) -> DataFrame:
    pd = table(s, d, "supplier").select(F.concat(F.lit("TE_"), F.col("s_suppkey").cast("string")).alias("header"), F.col("s_name").alias("standard"))
    return headers(s, d).join(pd, "header", "left").select("id", "standard", F.when(F.col("standard").isNotNull(), 1.0).when(F.col("header").rlike("^(TE|PT|FT)_"), 0.35).otherwise(0.0).alias("confidence"))


#: Candidate matches: a supplier's part stands for a column of a scenario, its numbers for evidence.
CAND = "M AS (SELECT l_orderkey * 10 + l_linenumber AS raw, l_suppkey % 6 AS scenario, l_partkey % 40 AS standard, CASE l_linenumber % 4 WHEN 0 THEN 'alias' WHEN 1 THEN 'manual' WHEN 2 THEN 'fuzzy' ELSE 'model' END AS method, 1 - l_discount * 4 AS score, l_returnflag = 'R' AS unit_conflict, l_quantity / 50 AS plausibility, l_tax * 11 AS missing, l_linestatus = 'O' AS gate FROM lineitem)"


def candidates(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("raw"), (F.col("l_suppkey") % 6).alias("scenario"), (F.col("l_partkey") % 40).alias("standard"), F.when(k == 0, "alias").when(k == 1, "manual").when(k == 2, "fuzzy").otherwise("model").alias("method"), (1 - F.col("l_discount") * 4).alias("score"), (F.col("l_returnflag") == "R").alias("unit_conflict"), (F.col("l_quantity") / 50).alias("plausibility"), (F.col("l_tax") * 11).alias("missing"), (F.col("l_linestatus") == "O").alias("gate"))


ADJ = "CASE WHEN missing >= .8 AND method <> 'alias' THEN .72 ELSE 1 END * CASE WHEN unit_conflict THEN least(score, .58) ELSE score END * (.72 + .28 * plausibility)"


@query("q_confidence_adjust", f"WITH {CAND} SELECT raw, round({ADJ}, 6) AS confidence FROM M")
def confidence_adjust(s: SparkSession, d: str) -> DataFrame:
    return adjusted(s, d).select("raw", *r6("confidence"))


def adjusted(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d)
    return c.withColumn("confidence", mapping.adjusted_confidence(*[F.col(x) for x in ("score", "unit_conflict", "plausibility", "missing", "method")]))


@query("q_dedupe_target", f"WITH {CAND}, c AS (SELECT *, round({ADJ}, 9) AS confidence FROM M), p AS (SELECT *, row_number() OVER (PARTITION BY scenario, standard ORDER BY gate DESC, (method = 'manual') DESC, confidence DESC, raw) AS place FROM c) SELECT raw, CASE WHEN place > 1 THEN 'duplicate' WHEN confidence >= .8 AND gate THEN 'matched' ELSE 'review' END AS status FROM p")
def dedupe_target(s: SparkSession, d: str) -> DataFrame:
    c = adjusted(s, d).withColumn("confidence", F.round("confidence", 9)).withColumn("standard", F.struct("scenario", "standard"))
    return mapping.one_for_each_target(c, 0.8).select("raw", "status")


#: The fields of a scenario, with the contract that three of them have: field, unit, quantity, role, equipment, location, channel, direction.
FIELDS = [
    ("top_temperature", "degC", "temperature", "process_measurement", "column", "column_top", None, None), ("feed_flow", "kg/h", "flow", "process_measurement", "feed_line", "feed", None, "inlet"),
    ("channel_b_pressure", "kPa", "pressure", "process_measurement", "column", "column_bottom", "b", None), ("motor_current", "A", None, None, None, None, None, None),
]
FIELD_DDL = "field string, field_unit string, " + ", ".join(f"contract_{k} string" for k in mapping.DIMENSIONS)
#: Mapped columns made from parts: names, methods and documents go through all their combinations.
MAPPED = """G AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Top Temp' WHEN 1 THEN 'feed_flow_inlet' WHEN 2 THEN 'bottom pressure B' WHEN 3 THEN 'x' || p_size % 10 WHEN 4 THEN 'scaled_' || p_size WHEN 5 THEN 'furnace top temperature' WHEN 6 THEN 'tray ' || p_size % 8 || ' temp setpoint' WHEN 7 THEN 'reflux.flow' ELSE 'Motor Current' END AS raw,
  CASE p_size % 5 WHEN 0 THEN 'top_temperature' WHEN 1 THEN 'feed_flow' WHEN 2 THEN 'channel_b_pressure' WHEN 3 THEN 'motor_current' ELSE 'unknown_field' END AS target,
  CASE p_partkey % 6 WHEN 0 THEN 'alias' WHEN 1 THEN 'manual' WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'point_dictionary' WHEN 4 THEN 'normalization_mapping' ELSE 'learned_alias' END AS method,
  (p_partkey % 25) / 20 AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'consistent' WHEN 1 THEN 'convertible' WHEN 2 THEN 'not_declared' ELSE 'conflict' END AS unit_status,
  CASE WHEN p_partkey % 7 < 3 THEN 'manual.pdf' END AS meta_source, p_partkey % 7 AS m, p_size % 3 AS z FROM part),
  FD AS (SELECT * FROM (VALUES ('top_temperature', 'degC', 'temperature', 'process_measurement', 'column', 'column_top', NULL, NULL), ('feed_flow', 'kg/h', 'flow', 'process_measurement', 'feed_line', 'feed', NULL, 'inlet'), ('channel_b_pressure', 'kPa', 'pressure', 'process_measurement', 'column', 'column_bottom', 'b', NULL), ('motor_current', 'A', NULL, NULL, NULL, NULL, NULL, NULL)) t(field, field_unit, cq, cr, ce, cl, cc, cd))"""


def mapped(s: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda x, names: F.element_at(F.array(*[n if isinstance(n, F.Column) else F.lit(n) for n in names]), (x + 1).cast("int"))
    text = lambda x: x.cast("int").cast("string")
    raw = pick(k % 9, ["Top Temp", "feed_flow_inlet", "bottom pressure B", F.concat(F.lit("x"), text(size % 10)), F.concat(F.lit("scaled_"), text(size)), "furnace top temperature", F.concat(F.lit("tray "), text(size % 8), F.lit(" temp setpoint")), "reflux.flow", "Motor Current"])
    rows = table(s, d, "part").select(
        k.alias("id"), raw.alias("raw"), pick(size % 5, ["top_temperature", "feed_flow", "channel_b_pressure", "motor_current", "unknown_field"]).alias("target"),
        pick(k % 6, ["alias", "manual", "fuzzy", "point_dictionary", "normalization_mapping", "learned_alias"]).alias("method"), ((k % 25) / 20).alias("confidence"),
        pick(k % 4, ["consistent", "convertible", "not_declared", "conflict"]).alias("unit_status"), F.when(k % 7 < 3, "manual.pdf").alias("meta_source"), (k % 7).alias("m"), (size % 3).alias("z"),
    )
    fields = F.broadcast(s.createDataFrame(FIELDS, FIELD_DDL))  # four fields
    return rows.join(fields, F.col("target") == F.col("field"), "left")


_RE = lambda p: f"regexp_matches(t, '{p}')"
_LIST = lambda words: "list_filter([" + ", ".join(f"CASE WHEN {_RE(p)} THEN '{n}' END" for n, p in words.items()) + "], lambda x: x IS NOT NULL)"
_ONE = lambda x: f"CASE len({x}) WHEN 0 THEN NULL WHEN 1 THEN {x}[1] ELSE 'conflict' END"


def said_sql(source: str, name: str, to: str) -> str:
    """CTEs that end in `to`: source's columns with q, r, e, l, c, d, the six things that its column `name` says."""
    return f"""{to}0 AS (SELECT *, regexp_replace(lower({name}), '[_/.\\-]+', ' ', 'g') AS t FROM {source}),
  {to}1 AS (SELECT *, {_LIST(mapping.QUANTITIES)} AS lq, list_concat({_LIST(mapping.LOCATIONS)}, CASE WHEN len(list_filter(regexp_extract_all(t, '\\btray\\s*(\\d+)\\b', 1), lambda x: x <> '6')) > 0 THEN ['other_tray'] ELSE [] END) AS ll, {_LIST(mapping.DIRECTIONS)} AS ld, {_LIST({"a": chr(92) + "ba" + chr(92) + "b", "b": chr(92) + "bb" + chr(92) + "b"})} AS lc FROM {to}0),
  {to}2 AS (SELECT *, {_ONE("lq")} AS q, CASE WHEN list_sort(ld) = ['downstream', 'outlet'] THEN 'downstream' ELSE {_ONE("ld")} END AS d, {_ONE("lc")} AS c FROM {to}1),
  {to}3 AS (SELECT *, coalesce({_ONE("ll")}, CASE WHEN q = 'flow' AND d = 'reflux' THEN 'reflux_line' WHEN q = 'flow' AND d = 'downstream' THEN 'downstream_line' END) AS l FROM {to}2),
  {to} AS (SELECT *, CASE WHEN q IS NOT NULL THEN CASE WHEN {_RE(mapping.SETPOINT)} THEN 'setpoint' ELSE 'process_measurement' END END AS r, CASE WHEN {_RE(mapping.OTHER_EQUIPMENT)} THEN 'other_equipment' WHEN list_contains(ll, 'reboiler_outlet') THEN 'reboiler' WHEN list_contains(ll, 'feed') THEN 'feed_line' WHEN l IS NOT NULL THEN 'column' END AS e FROM {to}3)"""


@query("q_name_semantics", f"WITH {MAPPED}, {said_sql('G', 'raw', 'N')} SELECT id, q AS quantity_type, r AS physical_role, e AS equipment_role, l AS measurement_location, c AS measurement_channel, d AS flow_direction FROM N")
def name_semantics(s: SparkSession, d: str) -> DataFrame:
    """What the words of a name say in all six dimensions."""
    return mapped(s, d).select("id", *[c.alias(k) for k, c in mapping.name_semantics(F.col("raw")).items()])


#: In SQL, a contract's gates: o. is what the name says, c* the contract, ok whether the method is trusted.
_SAME = {k: f"coalesce(CASE WHEN ok THEN coalesce({o}, {c}) ELSE {o} END = {c}, false)" for k, o, c in (("q", "q", "cq"), ("r", "r", "cr"), ("e", "e", "ce"), ("l", "l", "cl"), ("c", "c", "cc"), ("d", "d", "cd"))}
_STATED = "coalesce(cq, cr, ce, cl, cc, cd) IS NOT NULL"
_BOUND = f"""confidence >= .6 AND (status IN ('consistent', 'convertible') OR (ok AND status = 'not_declared')) AND ((ok AND NOT ({_STATED})) OR ({_SAME["q"]} AND {_SAME["r"]} AND {_SAME["l"]} AND {_SAME["e"]} AND (cc IS NULL OR {_SAME["c"]}) AND (coalesce(cq <> 'flow', true) OR {_SAME["d"]})))
  AND (ok OR ({_STATED} AND confidence >= .6 AND coalesce(e = 'column', false)))"""


@query("q_physical_gate", f"WITH {MAPPED}, J AS (SELECT G.*, FD.*, unit_status AS status, method IN ('alias', 'learned_alias', 'normalized_alias', 'point_dictionary') AS ok FROM G LEFT JOIN FD ON target = field), {said_sql('J', 'raw', 'N')} SELECT id, {_BOUND} AS passes, (ok AND NOT ({_STATED})) OR {_SAME['q']} AS quantity, (ok AND NOT ({_STATED})) OR coalesce(cq <> 'flow', true) OR {_SAME['d']} AS direction FROM N")
def physical_gate(s: SparkSession, d: str) -> DataFrame:
    """Candidates against the contracts of their fields."""
    rows = mapped(s, d)
    contract = {k: F.col(f"contract_{k}") for k in mapping.DIMENSIONS}
    gates = mapping.physical_gates(mapping.name_semantics(F.col("raw")), contract, F.col("method").isin(*mapping.CURATED), F.col("confidence"), F.col("unit_status"), 0.6)
    return rows.select("id", mapping.all_of(list(gates.values())).alias("passes"), gates["quantity_type"].alias("quantity"), gates["direction"].alias("direction"))


ACCEPT = f"""{MAPPED}, J AS (SELECT G.*, FD.*, CASE WHEN m < 3 THEN CASE WHEN z = 2 AND m = 1 THEN 'other' ELSE target END END AS meta_field, CASE WHEN m < 3 THEN CASE WHEN z = 1 AND m = 2 THEN 'other' ELSE 'column' END END AS meta_scenario, CASE WHEN m < 3 AND z < 2 THEN field_unit WHEN m < 3 THEN 'K' END AS meta_unit,
    CASE WHEN m < 3 THEN z = 0 END AS meta_normalized, m = 0 AS meta_restored, CASE WHEN m = 2 AND z = 0 THEN 'temperature' END AS meta_q, CASE WHEN m = 3 THEN 'mg/L' ELSE field_unit END AS expected, m < 5 AS point_resolved, CASE WHEN z = 0 THEN 'other' ELSE 'column' END AS point_scene FROM G LEFT JOIN FD ON target = field),
  K AS (SELECT *, coalesce(regexp_matches(lower(trim(raw)), '{mapping.ANONYMOUS}'), false) AS anon, coalesce(meta_source IS NOT NULL AND meta_field = target AND meta_scenario = 'column', false) AS scoped, method IN ('alias', 'learned_alias', 'normalized_alias', 'point_dictionary') AS trusted FROM J),
  L AS (SELECT *, scoped OR trusted AS ok, CASE WHEN scoped AND coalesce(meta_unit = expected, false) AND unit_status = 'not_declared' THEN 'consistent' ELSE unit_status END AS status FROM K), {said_sql("L", "raw", "N")},
  Y AS (SELECT *, coalesce(meta_unit = expected, false) OR coalesce((meta_unit, expected) IN (('degF', 'degC'), ('K', 'degC'), ('kPa', 'Pa'), ('MPa', 'Pa'), ('m/s', 'm/min'), ('kg/h', 't/h')), false) AS fits FROM N),
  Z AS (SELECT id, field, [CASE WHEN NOT (NOT coalesce(meta_q <> cq, false) AND (meta_unit IS NULL OR fits)) THEN 'metadata_consistency' END,
    CASE WHEN NOT (method <> 'point_dictionary' OR (point_resolved AND point_scene = 'column')) THEN 'point_dictionary_binding' END, CASE WHEN field IS NULL THEN 'candidate_exists' END,
    CASE WHEN NOT (CASE WHEN anon OR method = 'normalization_mapping' THEN scoped ELSE field IS NOT NULL AND (trusted OR method = 'manual' OR confidence >= .6) END) THEN 'identity_basis' END,
    CASE WHEN NOT ((status IN ('consistent', 'convertible') OR (trusted AND NOT anon AND status = 'not_declared')) AND field IS NOT NULL AND coalesce(expected = field_unit, false)) THEN 'unit' END,
    CASE WHEN NOT ({_BOUND}) THEN 'physical_semantics' END, CASE WHEN confidence < .6 THEN 'source_confidence' END, CASE WHEN anon AND NOT scoped THEN 'provenance' END,
    CASE WHEN (anon OR coalesce(meta_normalized, false)) AND NOT (scoped AND meta_unit IS NOT NULL AND (coalesce(NOT meta_normalized, false) OR meta_restored)) THEN 'normalization_metadata' END,
    CASE WHEN meta_scenario <> 'column' THEN 'scenario_compatibility' END] AS g FROM Y)"""


@query("q_acceptance_gate", f"WITH {ACCEPT} SELECT id, array_to_string(list_filter(g, lambda x: x IS NOT NULL), ' ') AS failures, CASE WHEN len(list_filter(g, lambda x: x IS NOT NULL)) = 0 THEN 'AUTO_ACCEPT' WHEN field IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE 'REJECT' END AS decision FROM Z")
def acceptance_gate(s: SparkSession, d: str) -> DataFrame:
    """All ten gates pass, or the names of those that do not and a review; candidates of no known field are rejected."""
    m, z, none = F.col("m"), F.col("z"), F.lit(None).cast("string")
    told = lambda x: F.when(m < 3, x)
    c = {k: F.col(k) for k in ("raw", "target", "method", "confidence", "unit_status", "field_unit", "meta_source", *(f"contract_{k}" for k in mapping.DIMENSIONS))}
    c |= {f"meta_{k}": none for k in mapping.DIMENSIONS}
    c |= {
        "scenario": F.lit("column"), "defined": F.col("field").isNotNull(), "has_contract": F.lit(True), "expected_unit": F.when(m == 3, "mg/L").otherwise(F.col("field_unit")),
        "meta_field": told(F.when((z == 2) & (m == 1), "other").otherwise(F.col("target"))), "meta_scenario": told(F.when((z == 1) & (m == 2), "other").otherwise("column")), "meta_unit": told(F.when(z < 2, F.col("field_unit")).otherwise("K")),
        "meta_normalized": told(z == 0), "meta_restored": m == 0, "meta_quantity_type": F.when((m == 2) & (z == 0), "temperature"),
        "point_resolved": m < 5, "point_scene": F.when(z == 0, "other").otherwise("column"), "point_field": F.col("target"), "point_unit": none,
    }
    rows = mapped(s, d)
    found = mapping.acceptance(mapping.acceptance_gates(c, 0.6), c["defined"])
    return rows.select("id", *[x.alias(k) for k, x in found.items()])


SCEN = CAND + f""", C AS (SELECT *, {ADJ} AS confidence FROM M), G AS (SELECT scenario, l_group, count(DISTINCT standard) FILTER (confidence >= .55 AND standard < 6) / 6 AS required, count(DISTINCT standard) FILTER (confidence >= .55 AND standard BETWEEN 6 AND 15) / 10 AS support, coalesce(avg(confidence) FILTER (confidence >= .55), 0) AS conf, count(DISTINCT standard) FILTER (confidence >= .55 AND standard < 16) AS evidence, count(*) FILTER (standard = 39 AND confidence >= .55) AS conflicts, count(*) FILTER (unit_conflict AND confidence >= .55) AS units, count(*) FILTER (plausibility < .2 AND confidence >= .55) AS abnormal, count(*) FILTER (missing >= .5 AND confidence >= .55) AS high_missing, count(*) FILTER (confidence >= .55) AS matched FROM (SELECT *, raw // 100000 AS l_group FROM C) GROUP BY 1, 2),
 S0 AS (SELECT *, .47 * required + .18 * support + .22 * conf + .08 * least(evidence / 4, 1) + .05 * CASE WHEN scenario < 2 THEN 1 ELSE 0 END - (.08 * conflicts + .07 * units + least(.12, .03 * abnormal + .02 * high_missing)) AS s FROM G), S1 AS (SELECT l_group, scenario, required, evidence, matched, conflicts + units > 0 AS conflict, round(least(greatest(CASE WHEN evidence < 4 THEN least(s, .42) ELSE s END, 0), 1), 3) AS score FROM S0)"""  # fmt: skip


def scenarios(s: SparkSession, d: str) -> DataFrame:
    c = adjusted(s, d).withColumn("l_group", F.floor(F.col("raw") / 100000).cast("long"))
    ok = F.col("confidence") >= 0.55
    fields = lambda cond: F.count_distinct(F.when(ok & cond, F.col("standard")))
    x = F.col("standard")
    g = c.groupBy("scenario", "l_group").agg((fields(x < 6) / 6).alias("required"), (fields(x.between(6, 15)) / 10).alias("support"), F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("conf"), fields(x < 16).alias("evidence"), F.count_if(ok & (x == 39)).alias("conflicts"), F.count_if(ok & F.col("unit_conflict")).alias("units"), F.count_if(ok & (F.col("plausibility") < 0.2)).alias("abnormal"), F.count_if(ok & (F.col("missing") >= 0.5)).alias("high_missing"), F.count_if(ok).alias("matched"))
    score = mapping.scenario_score(F.col("required"), F.col("support"), F.col("conf"), F.col("evidence"), F.lit(4), (F.col("scenario") < 2).cast("int"), F.col("conflicts"), F.col("units"), F.col("abnormal"), F.col("high_missing"))
    return g.select("l_group", "scenario", "required", "evidence", "matched", (F.col("conflicts") + F.col("units") > 0).alias("conflict"), F.round(score, 3).alias("score"))


@query("q_scenario_score", f"WITH {SCEN} SELECT l_group, scenario, score FROM S1")
def scenario_score(s: SparkSession, d: str) -> DataFrame:
    return scenarios(s, d).select("l_group", "scenario", "score")


DECIDE = SCEN + """, R1 AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next, lead(matched) OVER w AS next_matched FROM S1 WINDOW w AS (PARTITION BY l_group ORDER BY score DESC, scenario)), D1 AS (SELECT l_group, scenario, score, conflict, required, score - coalesce(next, 0) AS margin, score < .45 OR evidence < 4 OR required < .5 AS low, next IS NOT NULL AND (score - next < .12 OR next / greatest(score, 1e-9) >= .78) AND next >= .45 AND matched >= 3 AND next_matched >= 3 AS mixed FROM R1 WHERE place = 1)"""


def decided(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_group").orderBy(F.desc("score"), "scenario")
    r = scenarios(s, d).withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("next_matched", F.lead("matched").over(w)).filter("place = 1")
    score, nxt = F.col("score"), F.col("next")
    mixed = nxt.isNotNull() & ((score - nxt < 0.12) | (nxt / F.greatest(score, F.lit(1e-9)) >= 0.78)) & (nxt >= 0.45) & (F.col("matched") >= 3) & (F.col("next_matched") >= 3)
    return r.select("l_group", "scenario", "score", "conflict", "required", (score - F.coalesce(nxt, F.lit(0.0))).alias("margin"), ((score < 0.45) | (F.col("evidence") < 4) | (F.col("required") < 0.5)).alias("low"), mixed.alias("mixed"))


@query("q_scenario_decide", f"WITH {DECIDE} SELECT l_group, scenario, round(margin, 3) AS margin, CASE WHEN round(margin, 9) < .08 AND score >= .3 THEN 'ambiguous' WHEN low AND score < .3 THEN 'unknown' WHEN low THEN 'uncertain' WHEN mixed THEN 'ambiguous' WHEN conflict THEN 'uncertain' ELSE 'confirmed' END AS status, CASE WHEN low THEN 'reject' WHEN round(margin, 9) < .08 OR mixed OR conflict THEN 'review' ELSE 'accept' END AS decision FROM D1")
def scenario_decide(s: SparkSession, d: str) -> DataFrame:
    close = F.round("margin", 9) < 0.08
    status = F.when(close & (F.col("score") >= 0.3), "ambiguous").when(F.col("low") & (F.col("score") < 0.3), "unknown").when(F.col("low"), "uncertain").when(F.col("mixed"), "ambiguous").when(F.col("conflict"), "uncertain").otherwise("confirmed")
    return decided(s, d).select("l_group", "scenario", F.round("margin", 3).alias("margin"), status.alias("status"), F.when(F.col("low"), "reject").when(close | F.col("mixed") | F.col("conflict"), "review").otherwise("accept").alias("decision"))


@query("q_scenario_groups", f"WITH {CAND}, c AS (SELECT standard, scenario, round(max({ADJ}), 6) AS confidence FROM M GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS place, lead(confidence) OVER w AS next FROM c WINDOW w AS (PARTITION BY standard ORDER BY confidence DESC, scenario)) SELECT standard, scenario, confidence FROM r WHERE place = 1 AND (next IS NULL OR round(confidence - next, 9) >= .008)")
def scenario_groups(s: SparkSession, d: str) -> DataFrame:
    """Columns go to the scenario that leads clearly, and to none where two are close."""
    w = Window.partitionBy("standard").orderBy(F.desc("confidence"), "scenario")
    c = adjusted(s, d).groupBy("standard", "scenario").agg(F.round(F.max("confidence"), 6).alias("confidence"))
    r = c.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("confidence").over(w))
    return r.filter((F.col("place") == 1) & (F.col("next").isNull() | (F.round(F.col("confidence") - F.col("next"), 9) >= 0.008))).select("standard", "scenario", "confidence")


@query("q_data_decision", f"WITH {DECIDE}, x AS (SELECT *, (round(margin, 9) < .08 OR mixed OR low) AS ambiguous, l_group % 3 AS type_errors FROM D1) SELECT l_group, CASE WHEN ambiguous AND (score < .35 OR required < .5) THEN 'reject' WHEN ambiguous THEN 'review' WHEN required = 1 AND NOT conflict AND type_errors = 0 THEN 'ready' WHEN required = 1 AND NOT conflict THEN 'review' WHEN score >= .45 AND required >= .5 THEN 'review' ELSE 'reject' END AS decision FROM x")
def data_decision(s: SparkSession, d: str) -> DataFrame:
    x = decided(s, d)
    ambiguous = (F.round("margin", 9) < 0.08) | F.col("mixed") | F.col("low")
    return x.select("l_group", mapping.data_decision(ambiguous, F.col("score"), F.col("required"), F.col("conflict").cast("int"), F.lit(0), F.lit(0), F.col("l_group") % 3, F.lit(False)).alias("decision"))


@query("q_issue_union", f"WITH {CELLS} SELECT 'missing' AS issue, id FROM K WHERE cell IS NULL UNION ALL SELECT 'type', id FROM K WHERE cell IS NOT NULL AND {FLOAT} IS NULL UNION ALL SELECT 'range', id FROM K WHERE {FLOAT} > 1000")
def issue_union(s: SparkSession, d: str) -> DataFrame:
    """One scan: each row gives the issues it has."""
    x = mapping.coerce(F.col("cell"), "float")
    issues = F.array_compact(F.array(F.when(F.col("cell").isNull(), "missing"), F.when(F.col("cell").isNotNull() & x.isNull(), "type"), F.when(x > 1000, "range")))
    return cells(s, d).select(F.explode(issues).alias("issue"), "id")


@query("q_precheck", "SELECT c_mktsegment, count(*) AS n, CASE WHEN count(*) < 150 THEN 'ineligible' WHEN avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) > .12 THEN 'needs_review' ELSE 'eligible' END AS eligibility FROM customer GROUP BY 1")
def precheck(s: SparkSession, d: str) -> DataFrame:
    n, low = F.count(F.lit(1)), F.avg((F.col("c_acctbal") < 0).cast("double"))
    return table(s, d, "customer").groupBy("c_mktsegment").agg(n.alias("n"), F.when(n < 150, "ineligible").when(low > 0.12, "needs_review").otherwise("eligible").alias("eligibility"))


@query("q_missing_required", "SELECT n_name FROM nation WHERE n_regionkey < 3 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 3000)")
def missing_required(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").filter("n_regionkey < 3").join(table(s, d, "supplier").filter("s_acctbal > 3000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_name")
