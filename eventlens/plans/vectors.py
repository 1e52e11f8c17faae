"""Vector, split and classifier queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from eventlens import config
from eventlens.operators import series as S
from eventlens.operators import vectors as V
from eventlens.plans.distribution import r6, rounded
from eventlens.plans.registry import query
from eventlens.plans.sqlbase import lit
from eventlens.sources.adapters import table


def _emb(spark, d):
    return table(spark, d, "embeddings")


_CENT = """
coords AS (SELECT label < 5 AS pre, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
cent AS (SELECT CAST(dim AS INTEGER) AS dim, avg(v) FILTER (pre) AS a, avg(v) FILTER (NOT pre) AS b FROM coords GROUP BY 1)"""


@query("centroids_by_label", "ML2", sql=f"""
SELECT label AS "group", CAST(dim AS INTEGER) AS dim, {r6('avg(v)', 'value')}
FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2""")
def centroids_by_label(spark, d):
    return rounded(V.centroid_coordinates(V.centroids(_emb(spark, d), "embedding", F.col("label"))), "value")


@query("centroid_drift", "ML3", "SEM-12", sql=f"""WITH {_CENT}
SELECT {r6('sqrt(sum(pow(b - a, 2)))', 'l2_distance')}, {r6('1 - sum(a * b)', 'cosine_distance')}, {r6('sum(a * b)', 'cosine_similarity')},
       {r6('sum(a * b) / sqrt(sum(a * a) * sum(b * b))', 'true_cosine')} FROM cent""")
def centroid_drift(spark, d):
    out = V.centroid_drift(_emb(spark, d), "embedding", F.col("label") < 5)
    return rounded(out, "l2_distance", "cosine_distance", "cosine_similarity", "true_cosine")


@query("drift_dimensions", "ML3", "SR5", sql=f"""WITH {_CENT}
SELECT dim, {r6('b - a', 'drift')} FROM cent ORDER BY abs(b - a) DESC, dim LIMIT 10""")
def drift_dimensions(spark, d):
    return rounded(V.drift_dimensions(_emb(spark, d), "embedding", F.col("label") < 5), "drift")


_SPLIT = """
ranked AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS rk,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)"""


@query("stratified_split", "ML4", sql=f"""WITH {_SPLIT}
SELECT doc_id, quality, rk <= floor(n * 0.8) AS is_train FROM ranked""")
def stratified_split(spark, d):
    return V.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


_ESPLIT = """
r AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label < 5 ORDER BY md5('42|' || vec_id), vec_id) AS rk,
             count(*) OVER (PARTITION BY label < 5) AS n FROM embeddings),
x AS (SELECT vec_id, rk <= floor(n * 0.8) AS is_train, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM r),
st AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE is_train GROUP BY 1)"""


def _split_embeddings(spark, d):
    e = _emb(spark, d).withColumn("y", (F.col("label") >= 5).cast("int"))
    return V.stratified_split(e, "vec_id", "y")


@query("standardised_vectors", "ML5", "ML4", sql=f"""WITH {_ESPLIT}
SELECT vec_id, is_train, CAST(dim AS INTEGER) AS dim, {r6('CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END', 'value')} FROM x JOIN st USING (dim)""")
def standardised_vectors(spark, d):
    rows = _split_embeddings(spark, d)
    out = V.standardise(rows.where("is_train"), rows, "embedding")
    return rounded(out.select("vec_id", "is_train", F.posexplode("scaled").alias("dim", "value")), "value")


# A fixed score of the stored vectors, to check the metrics apart from the fit.
_SCORE = ("1 / (1 + exp(-2 * list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i * 37) % 64 - 31.5) / 32))))")


def _scored(spark, d):
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (((i + 1) * 37) % 64 - 31.5) / 32)
    z = F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b) * 2
    return _emb(spark, d).select("label", (1 / (1 + F.exp(-z))).alias("score"))


@query("score_auc", "ML7", "ML9", sql=f"""
WITH s AS (SELECT label >= 5 AS pos, {_SCORE} AS score FROM embeddings),
p AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc
      FROM s a, s b WHERE a.pos AND NOT b.pos)
SELECT {r6('auc', 'auc_roc')}, CASE WHEN auc > 0.8 THEN {lit(config.SEPARABILITY[0][1])} WHEN auc > 0.6 THEN {lit(config.SEPARABILITY[1][1])}
       ELSE {lit(config.SEPARABILITY_DEFAULT)} END AS interpretation FROM p""")
def score_auc(spark, d):
    out = V.auc(_scored(spark, d), "score", F.col("label") >= 5)
    return rounded(out.withColumn("interpretation", V.separability(F.col("auc_roc"))), "auc_roc")


@query("order_value_auc", "ML7", "ML9", "ST2", sql=f"""
WITH s AS (SELECT o_orderstatus AS status, o_orderpriority = '1-URGENT' AS pos,
                  rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS rk FROM orders),
a AS (SELECT status, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) AS auc FROM s GROUP BY 1)
SELECT status, {r6('auc', 'auc_roc')} FROM a""")
def order_value_auc(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice", "o_orderpriority")
    return rounded(V.auc(o, "o_totalprice", F.col("o_orderpriority") == "1-URGENT", ["status"]), "auc_roc")


@query("confusion_metrics", "ML8", sql=f"""
WITH s AS (SELECT label >= 5 AS pos, {_SCORE} > 0.5 AS said FROM embeddings),
c AS (SELECT count(*) FILTER (said AND pos) AS tp, count(*) FILTER (said AND NOT pos) AS fp,
             count(*) FILTER (NOT said AND pos) AS fn, count(*) FILTER (NOT said AND NOT pos) AS tn FROM s)
SELECT *, {r6('(tp + tn) / (tp + fp + fn + tn)::DOUBLE', 'accuracy')}, {r6('tp / (tp + fp)::DOUBLE', 'precision')},
       {r6('tp / (tp + fn)::DOUBLE', 'recall')}, {r6('2 * tp / (2 * tp + fp + fn)::DOUBLE', 'f1')} FROM c""")
def confusion_metrics(spark, d):
    out = V.confusion_metrics(_scored(spark, d), "score", F.col("label") >= 5)
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query("stacked_eras", "SO3", sql="""
SELECT vec_id, CAST(0 AS INTEGER) AS y FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label >= 5""")
def stacked_eras(spark, d):
    e = _emb(spark, d)
    return S.stack(e.where("label < 5"), e.where("label >= 5"), labels=[0, 1], label="y").select("vec_id", "y")


def _unit_sql(docs: str) -> str:
    """CTEs ending in ``unit``: doc_id, dim, value of the unit vectors of ``docs`` (doc_id, text)."""
    return f"""docs AS ({docs}),
terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')) AS term FROM docs),
tf AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 1024 AS dim, count(*) AS n FROM terms GROUP BY 1, 2),
idf AS (SELECT dim, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM tf GROUP BY 1),
raw AS (SELECT doc_id, dim, n * idf AS v FROM tf JOIN idf USING (dim)),
unit AS (SELECT doc_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM raw)"""


@query("message_vectors", "ML1", sql=f"""WITH {_unit_sql("SELECT doc_id, text FROM documents")}
SELECT doc_id, CAST(dim AS INTEGER) AS dim, {r6('value', 'value')} FROM unit WHERE value <> 0""")
def message_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = V.vectorise(docs, "text").select("doc_id", F.posexplode(vector_to_array("vector")).alias("dim", "value"))
    return rounded(out.where("value <> 0"), "value")


@query("encoded_messages", "ML1", sql=f"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS n FROM terms GROUP BY 1, 2)
SELECT doc_id, dim, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))), 4) + 0.0 AS value FROM tf""")
def encoded_messages(spark, d):
    """Vectors of a model that the encoder hook loads: hashed terms, which any engine repeats."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = V.vectorise(docs, "text", encoder=V.model_encoder("hashed-terms-64", lambda: V.hashed_terms(64)))
    values = out.select("doc_id", F.posexplode("vector").alias("dim", "value")).where("value <> 0")
    return rounded(values.withColumn("value", F.col("value").cast("double")), "value", digits=4)


@query("message_vector_drift", "ML1", "ML2", "ML3", sql=f"""WITH {_unit_sql("SELECT doc_id, text FROM documents JOIN labels USING (doc_id)")},
n AS (SELECT count(*) FILTER (quality = 0) AS a, count(*) FILTER (quality <> 0) AS b FROM documents JOIN labels USING (doc_id)),
c AS (SELECT dim, coalesce(sum(value) FILTER (quality = 0), 0) / any_value(a) AS pre, coalesce(sum(value) FILTER (quality <> 0), 0) / any_value(b) AS post
      FROM unit JOIN labels USING (doc_id), n GROUP BY 1)
SELECT {r6('sqrt(sum(pow(post - pre, 2)))', 'l2_distance')}, {r6('1 - sum(pre * post)', 'cosine_distance')}, {r6('sum(pre * post)', 'cosine_similarity')},
       {r6('sum(pre * post) / sqrt(sum(pre * pre) * sum(post * post))', 'true_cosine')} FROM c""")
def message_vector_drift(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    out = V.centroid_drift(V.vectorise(docs, "text"), "vector", F.col("quality") == 0)
    return rounded(out, "l2_distance", "cosine_distance", "cosine_similarity", "true_cosine")


@query("classifier_optimum", "ML6", sql="""
SELECT CAST(dim AS INTEGER) AS dim, 0.0::DOUBLE AS gradient FROM (SELECT unnest(range(-1, max(len(embedding)))) AS dim FROM embeddings)""")
def classifier_optimum(spark, d):
    """Gradient of the penalised loss at the fitted weights: zero in every dimension, to four digits."""
    e = _emb(spark, d).withColumn("y", (F.col("label") >= 5).cast("int"))
    model = V.fit_classifier(e, "embedding", "y")
    return V.loss_gradient(model, e, "embedding", "y").select("dim", (F.round("gradient", 4) + 0.0).alias("gradient"))


@query("era_classifier", "ML4", "ML5", "ML6", "ML7", "ML8", "ML9")
def era_classifier(spark, d):
    e = _emb(spark, d).withColumn("y", (F.col("label") >= 5).cast("int"))
    return V.era_classifier(e, "vec_id", "embedding", "y")


def _newton_sql(src: str, steps: int = 9) -> str:
    """CTEs ending in ``optimum`` (b, u, v): intercept and weights of the penalised logistic regression of y on x1, x2 in
    ``src``, by Newton steps whose 3 x 3 systems are solved by determinants."""
    ctes = ["w0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"]
    for i in range(steps):
        ctes.append(f"""p{i} AS (SELECT x1, x2, y, 1 / (1 + exp(-(b + u * x1 + v * x2))) AS p FROM {src}, w{i}),
m{i} AS (SELECT avg(p - y) AS g0, avg((p - y) * x1) AS g1, avg((p - y) * x2) AS g2, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * x1) AS h01,
  avg(p * (1 - p) * x2) AS h02, avg(p * (1 - p) * x1 * x1) AS h11, avg(p * (1 - p) * x1 * x2) AS h12, avg(p * (1 - p) * x2 * x2) AS h22, 1 / count(*)::DOUBLE AS l FROM p{i}),
s{i} AS (SELECT g0, g1 + l * u AS g1, g2 + l * v AS g2, h00, h01, h02, h11 + l AS h11, h12, h22 + l AS h22, b, u, v FROM m{i}, w{i}),
d{i} AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{i}),
w{i + 1} AS (SELECT b - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b,
  u - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS u,
  v - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS v FROM d{i})""")
    return ",\n".join([*ctes, f"optimum AS (SELECT * FROM w{steps})"])


@query("plane_classifier", "ML6", sql=f"""WITH flat AS (SELECT embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, CAST(label >= 5 AS INTEGER) AS y FROM embeddings),
{_newton_sql('flat')}
SELECT round(b, 4) + 0.0 AS intercept, round(u, 4) + 0.0 AS weight1, round(v, 4) + 0.0 AS weight2 FROM optimum""")
def plane_classifier(spark, d):
    """Weights of the classifier on two coordinates, which SQL finds by Newton's method."""
    e = _emb(spark, d).select(F.slice("embedding", 1, 2).alias("x"), (F.col("label") >= 5).cast("int").alias("y"))
    model = V.fit_classifier(e, "x", "y")
    weights = [float(w) for w in model.coefficients]
    # one row, as wide as the model
    fitted = e.agg(F.lit(float(model.intercept)).alias("intercept"), F.lit(weights[0]).alias("weight1"), F.lit(weights[1]).alias("weight2"))
    return rounded(fitted, "intercept", "weight1", "weight2", digits=4)


@query("plane_era_classifier", "ML4", "ML5", "ML6", "ML7", "ML8", "ML9", sql=f"""WITH
r AS (SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, CAST(label >= 5 AS INTEGER) AS y,
             row_number() OVER (PARTITION BY label >= 5 ORDER BY md5('42|' || vec_id), vec_id) AS rk, count(*) OVER (PARTITION BY label >= 5) AS n FROM embeddings),
s AS (SELECT *, rk <= floor(n * 0.8) AS is_train FROM r),
st AS (SELECT avg(e1) AS m1, stddev_pop(e1) AS s1, avg(e2) AS m2, stddev_pop(e2) AS s2 FROM s WHERE is_train),
z AS (SELECT y, is_train, (e1 - m1) / s1 AS x1, (e2 - m2) / s2 AS x2 FROM s, st),
train AS (SELECT * FROM z WHERE is_train),
{_newton_sql('train')},
held AS (SELECT y = 1 AS pos, 1 / (1 + exp(-(b + u * x1 + v * x2))) AS score FROM z, optimum WHERE NOT is_train),
a AS (SELECT sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM held p, held q WHERE p.pos AND NOT q.pos),
c AS (SELECT count(*) FILTER (score > 0.5 AND pos) AS tp, count(*) FILTER (score > 0.5 AND NOT pos) AS fp,
             count(*) FILTER (score <= 0.5 AND pos) AS fn, count(*) FILTER (score <= 0.5 AND NOT pos) AS tn FROM held)
SELECT {r6('auc', 'auc_roc')}, c.*, {r6('(tp + tn) / (tp + fp + fn + tn)::DOUBLE', 'accuracy')}, {r6('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)', '"precision"')},
       {r6('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)', 'recall')}, {r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)', 'f1')},
       CASE WHEN auc > 0.8 THEN {lit(config.SEPARABILITY[0][1])} WHEN auc > 0.6 THEN {lit(config.SEPARABILITY[1][1])} ELSE {lit(config.SEPARABILITY_DEFAULT)} END AS interpretation
FROM a, c""")
def plane_era_classifier(spark, d):
    """The whole chain on two coordinates: split, scaling, fit, and the metrics of the held-out rows."""
    e = _emb(spark, d).select("vec_id", F.slice("embedding", 1, 2).alias("x"), (F.col("label") >= 5).cast("int").alias("y"))
    return rounded(V.era_classifier(e, "vec_id", "x", "y"), "auc_roc", "accuracy", "precision", "recall", "f1")
