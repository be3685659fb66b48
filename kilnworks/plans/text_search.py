"""Queries of text, retrieval and routing over documents, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.operators import text

from .base import query, r6, table

WORDS = "lower(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'))"
ITEMS = f"w AS (SELECT doc_id AS id, unnest(list_filter(string_split({WORDS}, ' '), lambda x: x <> '')) AS term FROM documents), c AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2)"
WEIGHTS = ITEMS + ", m AS (SELECT id, max(tf) AS most FROM c GROUP BY 1), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), t AS (SELECT c.id, c.term, (.5 + .5 * tf / most) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS weight FROM c JOIN m ON c.id = m.id JOIN d ON c.term = d.term)"


def words(column: str = "text"):
    return F.array_remove(F.split(F.lower(F.regexp_replace(column, "[^A-Za-z ]+", " ")), " "), "")


def texts(s: SparkSession, d: str) -> DataFrame:
    return text.spread(table(s, d, "documents")).filter("text is not null").select(F.col("doc_id").alias("id"), "text")


def weights(s: SparkSession, d: str) -> DataFrame:
    docs = texts(s, d).select("id", words().alias("words"))
    return text.tf_idf(text.row_counts(docs, F.col("words"), ["id"]), table(s, d, "documents").count())


GRAMS = " UNION ALL ".join(f"SELECT id, {n} AS n, unnest(list_transform(range(1, len(c) - {n} + 2), lambda i: {' || '.join(f'c[i + {k}]' for k in range(n))})) AS gram FROM t WHERE len(c) >= {n}" for n in (1, 2, 3))


@query("q_ngrams", f"WITH t AS (SELECT row_number() OVER () AS id, string_split(lower(text), '') AS c FROM documents), g AS ({GRAMS}) SELECT CAST(n AS BIGINT) AS n, gram, count(*) AS times, count(DISTINCT id) AS docs FROM g GROUP BY 1, 2")
def ngrams(s: SparkSession, d: str) -> DataFrame:
    """Runs of one to three characters of all documents: how often they stand, and in how many."""
    return text.ngram_counts(table(s, d, "documents"), F.lower("text"), (1, 2, 3))


@query("q_tfidf", f"WITH {WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM t")
def tfidf(s: SparkSession, d: str) -> DataFrame:
    return weights(s, d).select("id", "term", *r6("weight"))


@query("q_centroid", f"WITH {WEIGHTS}, y AS (SELECT doc_id AS id, min(toxic) AS label FROM labels WHERE toxic IS NOT NULL GROUP BY 1), a AS (SELECT label, term, sum(weight) AS weight FROM t JOIN y ON t.id = y.id GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(weight * weight)) AS length FROM a GROUP BY 1), k AS (SELECT a.label, term, weight / length AS w FROM a JOIN l ON a.label = l.label), n AS (SELECT id, sqrt(sum(weight * weight)) AS length FROM t GROUP BY 1) SELECT t.id, label, round(sum(weight * w) / any_value(n.length), 6) AS score FROM t JOIN k ON t.term = k.term JOIN n ON t.id = n.id GROUP BY 1, 2")
def centroid(s: SparkSession, d: str) -> DataFrame:
    """All documents against the centroids of the labelled ones."""
    labels = table(s, d, "labels").filter("toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("toxic").alias("label"))
    docs = text.with_labels(texts(s, d), labels, "id")
    return text.centroid_scores(text.word_counts(docs, F.col("text"), ["id", "label"]), table(s, d, "documents").count()).select("id", "label", *r6("score"))


RGRAMS = " UNION ALL ".join(f"SELECT id, label, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n}))) AS g FROM x WHERE length(t) >= {n}" for n in (2, 3, 4))
CLASSES = "('0-0', 0), ('0-1', 1), ('1-0', 2), ('1-1', 3)"


@query("q_linear_router", rf"""WITH y AS (SELECT doc_id, min(quality || '-' || toxic) AS label FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
  x AS (SELECT doc_id AS id, label, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents LEFT JOIN y USING (doc_id)), g AS ({RGRAMS}), c AS (SELECT id, label, g, count(*) AS tf FROM g GROUP BY ALL),
  k AS (SELECT * FROM (VALUES {CLASSES}) t(label, place)), n AS (SELECT label, count(*) AS n FROM x WHERE label IS NOT NULL GROUP BY 1), nn AS (SELECT sum(n) AS total FROM n),
  v AS (SELECT g, count(*) AS df FROM c WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY df DESC, g LIMIT 20000),
  m AS (SELECT v.g, k.label, coalesce(sum(tf), 0) AS n FROM v CROSS JOIN k LEFT JOIN c ON c.g = v.g AND c.label = k.label GROUP BY ALL), mm AS (SELECT label, sum(n) AS n FROM m GROUP BY 1),
  w AS (SELECT m.g, m.label, ln((m.n + 1.0) / (mm.n + (SELECT count(*) FROM v))) AS w FROM m JOIN mm USING (label)),
  f AS (SELECT c.id, c.g, (1 + ln(tf)) * (ln((1.0 + total) / (1 + df)) + 1) AS x FROM c JOIN v USING (g), nn), l AS (SELECT id, sqrt(sum(x * x)) AS len FROM f GROUP BY 1),
  d AS (SELECT f.id, w.label, sum(f.x * w.w) / any_value(l.len) AS dot FROM f JOIN w USING (g) JOIN l ON l.id = f.id GROUP BY ALL),
  z AS (SELECT x.id, n.label, ln(n.n / total) + 40 * coalesce(d.dot, 0) AS z FROM x CROSS JOIN n CROSS JOIN nn LEFT JOIN d ON d.id = x.id AND d.label = n.label),
  e AS (SELECT id, label, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z), r AS (SELECT id, sum(e) AS s, list((-round(e, 12), label, e) ORDER BY -round(e, 12), label) AS l FROM e GROUP BY 1),
  b AS (SELECT c.id, sum(CASE WHEN v.g IS NOT NULL THEN 1 ELSE 0 END) / count(*) AS coverage FROM c LEFT JOIN v USING (g) WHERE length(c.g) = 2 GROUP BY 1),
  o AS (SELECT r.id, l[1][2] AS label, l[1][3] / s AS p, l[1][3] / s - l[2][3] / s AS m, coalesce(b.coverage, 0) AS coverage FROM r LEFT JOIN b USING (id))
  SELECT id, label, round(p, 6) AS probability, round(m, 6) AS margin, round(CAST(coverage AS DOUBLE), 6) AS coverage, p >= .5 AND m >= .1 AND coverage >= .5 AS accepted, CASE WHEN p >= .5 AND m >= .1 AND coverage >= .5 THEN 'accepted' ELSE 'low_confidence' END AS reason FROM o""")
def linear_router(s: SparkSession, d: str) -> DataFrame:
    """All documents by a scorer learnt from the labelled ones; a class is a quality and a toxicity."""
    labels = table(s, d, "labels").filter("quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.concat_ws("-", "quality", "toxic")).alias("label"))
    docs = table(s, d, "documents")
    learnt = text.with_labels(text.spread(docs), labels, "doc_id", "inner").select("doc_id", "text", F.col("label").alias("class"))
    model, classes = text.fit_router(learnt, "text", "class")
    return text.route(docs, "doc_id", "text", model, classes, scale=40).select("id", "label", *r6("probability", "margin", "coverage"), "accepted", "reason")


PROTO = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id AS pid, label, e FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5)"
SCORED = PROTO + ", x AS (SELECT v.vec_id, p.label, max(list_cosine_similarity(v.e, p.e)) AS score FROM v, p WHERE v.vec_id <> p.pid GROUP BY 1, 2)"


def prototypes(s: SparkSession, d: str) -> DataFrame:
    """Five rows of every label, the first by id."""
    e = table(s, d, "embeddings")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("n <= 5").select(F.col("vec_id").alias("pid"), "label", F.col("embedding").alias("p"))


def proto_scores(s: SparkSession, d: str) -> DataFrame:
    """Every vector's best cosine with each label's prototypes, its own row left out."""
    q = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("q"))
    return text.prototype_scores(q, prototypes(s, d))


@query("q_softmax_gate", f"WITH {SCORED}, y AS (SELECT vec_id, label, 8 * score AS score FROM x), z AS (SELECT vec_id, arg_max(label, (score, label)) AS label, sum(exp(score)) AS z, list(exp(score) ORDER BY score DESC) AS l FROM y GROUP BY 1) SELECT vec_id, label, round(l[1] / z, 6) AS probability, round((l[1] - coalesce(l[2], 0)) / z, 6) AS margin, l[1] / z >= .3 AND (l[1] - coalesce(l[2], 0)) / z >= .1 AS accepted FROM z")
def softmax_gate(s: SparkSession, d: str) -> DataFrame:
    """A label for every vector, if its prototypes are clearly the nearest."""
    scores = proto_scores(s, d).withColumn("score", 8 * F.col("score"))
    return text.softmax_gate(scores, "vec_id", probability=0.3, margin=0.1).select("vec_id", "label", *r6("probability", "margin"), "accepted")


@query("q_embed_proto", f"WITH {SCORED} SELECT vec_id, label, round(score, 6) AS score FROM x")
def embed_proto(s: SparkSession, d: str) -> DataFrame:
    return proto_scores(s, d).select("vec_id", "label", *r6("score"))


@query("q_cross_argmax", f"WITH {PROTO}, c AS (SELECT vec_id, pid, list_dot_product(v.e, p.e) AS score FROM v, p WHERE v.vec_id <> p.pid) SELECT vec_id, arg_max(pid, (round(score, 9), -pid)) AS best, round(max(score), 6) AS score FROM c GROUP BY 1")
def cross_argmax(s: SparkSession, d: str) -> DataFrame:
    """The prototype with the largest inner product, of all labels."""
    q = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("q"))
    c = text.with_prototypes(q, prototypes(s, d)).filter("vec_id <> pid").select("vec_id", "pid", text.dot(F.col("q"), F.col("p")).alias("score"))
    return c.groupBy("vec_id").agg(F.max_by("pid", F.struct(F.round("score", 9), -F.col("pid"))).alias("best"), F.round(F.max("score"), 6).alias("score"))


@query("q_ensemble", "WITH x AS (SELECT vec_id, (1 + embedding[1]) / 2 AS c, (1 + embedding[2]) / 2 AS e FROM embeddings) SELECT vec_id, round(least(.8 * CAST(c AS DOUBLE) + .2 * CAST(e AS DOUBLE), CAST(c AS DOUBLE) + .05), 6) AS score FROM x")
def ensemble(s: SparkSession, d: str) -> DataFrame:
    """Four parts characters and one part embedding, at most a little above what the characters say."""
    c, e = ((1 + F.col("embedding")[i]) / 2 for i in (0, 1))
    c, e = c.cast("float").cast("double"), e.cast("float").cast("double")
    return table(s, d, "embeddings").select("vec_id", F.round(F.least(0.8 * c + 0.2 * e, c + 0.05), 6).alias("score"))


@query("q_lexical_search", "WITH p AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE lang = 'en'), s AS (SELECT id, CAST(place AS INTEGER) AS place, text, CAST(CASE WHEN contains(lower(text), 'license') THEN 14 ELSE 0 END + CASE WHEN contains(lower(text), 'the ') THEN 12 ELSE 0 END + CASE WHEN contains(lower(text), 'tion') THEN 12 ELSE 0 END AS INTEGER) AS points FROM p WHERE NOT contains(lower(text), 'password')) SELECT id, place, points, left(text, 900) AS excerpt FROM s WHERE points > 0 ORDER BY points DESC, id, place LIMIT 25")
def lexical_search(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("place", "text"))
    return text.lexical_search(p, ["license", "the ", "tion"], ["password"], 25)


@query("q_rule_score", "WITH h AS (SELECT doc_id, .8 AS confidence, CAST(contains(text, 'ing') AS INTEGER) + CAST(contains(text, 'ed') AS INTEGER) + CAST(contains(text, 'tion') AS INTEGER) AS hits FROM documents) SELECT doc_id, round(CAST(least(.98, confidence + .025 * (hits - 1)) AS DOUBLE), 6) AS score, least(.98, confidence + .025 * (hits - 1)) >= .84 AS routed FROM h WHERE hits > 0")
def rule_score(s: SparkSession, d: str) -> DataFrame:
    hits = sum((F.contains("text", F.lit(t)).cast("int") for t in ("ing", "ed", "tion")), F.lit(0))
    score = F.least(F.lit(0.98), F.round(0.8 + 0.025 * (F.col("hits") - 1), 9))
    return table(s, d, "documents").withColumn("hits", hits).filter("hits > 0").select("doc_id", F.round(score, 6).alias("score"), (score >= 0.84).alias("routed"))


@query("q_token_overlap", f"WITH a AS (SELECT doc_id, list_distinct(list_filter(string_split({WORDS}, ' '), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_intersect(t, ['the', 'of', 'and', 'in', 'thing'])) AS overlap FROM a")
def token_overlap(s: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("the", "of", "and", "in", "thing")))
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.size(F.array_intersect(words(), wanted)).cast("long").alias("overlap"))


@query("q_longest_alias", "WITH a AS (SELECT * FROM (VALUES ('the'), ('tion'), ('license'), ('er'), ('ation')) t(alias)) SELECT doc_id, arg_max(alias, (length(alias), alias)) AS alias FROM documents JOIN a ON contains(lower(text), alias) GROUP BY 1")
def longest_alias(s: SparkSession, d: str) -> DataFrame:
    """The longest of a fixed list's names that a text holds."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(a)), F.struct(F.lit(len(a)).alias("n"), F.lit(a).alias("alias"))) for a in ("the", "tion", "license", "er", "ation")]))
    return table(s, d, "documents").select("doc_id", F.array_max(found)["alias"].alias("alias")).filter("alias is not null")


@query("q_dep_closure", "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS node, p_size // 2 AS needs FROM part WHERE p_size // 2 > 0), r AS (SELECT node, needs FROM e UNION SELECT r.node, e.needs FROM r JOIN e ON r.needs = e.node) SELECT node, needs FROM r")
def dep_closure(s: SparkSession, d: str) -> DataFrame:
    edges = table(s, d, "part").select(F.col("p_size").alias("node"), F.floor(F.col("p_size") / 2).cast("int").alias("needs")).filter("needs > 0").distinct()
    return text.closure(edges)


@query("q_dep_order", "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS node, p_size // 2 AS needs FROM part WHERE p_size // 2 > 0), r AS (SELECT node, needs FROM e UNION SELECT r.node, e.needs FROM r JOIN e ON r.needs = e.node), x AS (SELECT node FROM r UNION SELECT needs FROM r) SELECT x.node, count(r.needs) AS place FROM x LEFT JOIN r ON x.node = r.node GROUP BY 1")
def dep_order(s: SparkSession, d: str) -> DataFrame:
    """An order in which everything comes after what it needs."""
    return text.dependency_order(dep_closure(s, d))


NAMES = "n AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, lower(a.n_name) AS x, lower(b.n_name) AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey), g AS (SELECT a, b, list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) AS gx, list_transform(range(1, length(y)), lambda i: substr(y, i, 2)) AS gy FROM n)"


def name_pairs(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select("n_nationkey", F.lower("n_name").alias("low"))
    x, y = n.select(F.col("n_nationkey").alias("a"), F.col("low").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("low").alias("y"))
    return x.join(F.broadcast(y), F.col("a") < F.col("b"))  # the dictionary: 25 names


@query("q_bigram_cosine", f"WITH {NAMES} SELECT a, b, round(list_sum(list_transform(list_distinct(gx), lambda g: len(list_filter(gx, lambda q: q = g)) * len(list_filter(gy, lambda q: q = g)))) / sqrt(CAST(list_sum(list_transform(list_distinct(gx), lambda g: len(list_filter(gx, lambda q: q = g)) ** 2)) * list_sum(list_transform(list_distinct(gy), lambda g: len(list_filter(gy, lambda q: q = g)) ** 2)) AS DOUBLE)), 6) AS similarity FROM g")
def bigram_cosine(s: SparkSession, d: str) -> DataFrame:
    return name_pairs(s, d).select("a", "b", F.round(text.bigram_cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("q_fuzzy_ratio")
def fuzzy_ratio(s: SparkSession, d: str) -> DataFrame:
    """Edit-distance ratios stand for the weighted ratio of a library that is not at hand; mixed with bigrams as names are matched."""
    x, y = F.col("x"), F.col("y")
    return name_pairs(s, d).select("a", "b", F.round(0.58 * text.token_ratio(x, y) / 100 + 0.42 * text.bigram_cosine(x, y), 6).alias("similarity"))


@query("q_turn_counts", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS longest FROM conversations GROUP BY 1")
def turn_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("longest"))


@query("q_event_log", "SELECT conv_id, turn, role FROM conversations WHERE turn > 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def event_log(s: SparkSession, d: str) -> DataFrame:
    """The next records of each log after a given one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").filter("turn > 1").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("conv_id", "turn", "role")


@query("q_props_json", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1")
def props_json(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
