"""Queries on documents and labels: tokens, vocabularies, keyed tags, federated models, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.keyed import hmac_sha256_sql, key_of
from marlstone.functions.text import label
from marlstone.operators import metrics, model, vocabulary
from marlstone.operators.federated import written
from marlstone.sources.tables import spread, table

QUERIES: dict = {}
ORACLE: dict = {}
KEY = key_of(42)
FEATURES = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TOK = r"""
WITH w AS (SELECT doc_id, lang, regexp_replace(unnest(string_split_regex(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x85\xa0]+')), '^["''`“”‘’()\[\]{}<>;,]+|["''`“”‘’()\[\]{}<>;,]+$', '', 'g') AS p FROM documents),
t AS (SELECT doc_id, lang, unnest(CASE WHEN p LIKE '%=%' OR p LIKE '%:%' THEN [regexp_replace(p, '^[.,;]+|[.,;]+$', '', 'g')] ELSE string_split_regex(p, '[^a-z0-9]+') END) AS token FROM w WHERE p <> ''),
tf AS (SELECT doc_id, lang, token, count(*) AS tf FROM t WHERE length(token) >= 2 GROUP BY ALL)
"""


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.text_frequency(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), F.col("text"), "doc_id", "lang")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query(_TOK + "SELECT doc_id, token, tf FROM tf")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tf(spark, sf_dir).drop("lang")


@query(_TOK + "SELECT lang, token, count(*) AS df FROM tf GROUP BY lang, token")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.document_frequency(_tf(spark, sf_dir), "lang")


_VOC = (
    _TOK
    + f""", n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), d AS (SELECT lang, token, count(*) AS df FROM tf GROUP BY lang, token),
v AS (SELECT lang, token, df, row_number() OVER (PARTITION BY lang ORDER BY df DESC, encode(token)) - 1 AS position FROM d JOIN n USING (lang) WHERE df >= 2 AND df <= greatest(1, floor(0.5 * n)) QUALIFY position < {FEATURES})
"""
)


def _vocabulary(spark: SparkSession, sf_dir: str, tf: DataFrame | None = None) -> DataFrame:
    tf = tf if tf is not None else _tf(spark, sf_dir)
    return vocabulary.local_vocabulary(vocabulary.document_frequency(tf, "lang"), _documents(spark, sf_dir), FEATURES, 2, 0.5, "lang")


@query(_VOC + "SELECT lang, token, df, position FROM v")
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).drop("used_fallback").withColumn("position", F.col("position").cast("long"))


@query(_VOC + "SELECT doc_id, count(*) AS terms, round(sum(tf * (ln((1 + greatest(1, n)) / (1 + df)) + 1)), 4) AS weight FROM tf JOIN v USING (lang, token) JOIN n USING (lang) GROUP BY doc_id")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = written(_tf(spark, sf_dir), "tf")
    v = vocabulary.idf(_vocabulary(spark, sf_dir, tf), _documents(spark, sf_dir), "lang").select("lang", "token", "idf")
    own = tf.join(v, ["lang", "token"])
    return own.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("tf") * F.col("idf")), 4).alias("weight"))


_TAG = hmac_sha256_sql(KEY, "'text|' || token")


@query(_VOC + f"SELECT lang, token, {_TAG} AS tag FROM v")
def hmac_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.tagged(_vocabulary(spark, sf_dir), KEY, "text").select("lang", "token", "tag")


_AXIS = _VOC + f", g AS (SELECT lang, token, {_TAG} AS tag FROM v), x AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS gv_index FROM (SELECT DISTINCT tag FROM g))"


@query(_AXIS + " SELECT lang, token, gv_index FROM g JOIN x USING (tag)")
def global_vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary.tagged(_vocabulary(spark, sf_dir), KEY, "text")
    return vocabulary.index_vectors(v, vocabulary.global_axis(v)).select("lang", "token", "gv_index")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return l.select("doc_id", F.when(F.col("toxic") == 1, "Toxic").when(F.col("quality") == 1, " good ").otherwise("Poor").alias("label"), (F.col("doc_id") % 3).cast("string").alias("org"))


_LAB = "WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, CAST(doc_id % 3 AS VARCHAR) AS org FROM labels)"


@query(_LAB + " SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_index FROM (SELECT DISTINCT label FROM l)")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _labels(spark, sf_dir).withColumn("label", label(F.col("label")))
    return model.label_index(l).withColumn("label_index", F.col("label_index").cast("long"))


@query(_LAB + ", c AS (SELECT org, count(*) FILTER (label = 'toxic') AS p, count(*) FILTER (label <> 'toxic') AS q FROM l GROUP BY org) SELECT org, round(CASE WHEN p > 0 AND q > 0 THEN (p + q) / (2.0 * p) ELSE 1 END, 9) AS positive_weight, round(CASE WHEN p > 0 AND q > 0 THEN (p + q) / (2.0 * q) ELSE 1 END, 9) AS negative_weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = model.class_weights(_labels(spark, sf_dir), F.col("label") == "Toxic", "org")
    return w.select("org", *(F.round(c, 9).alias(c) for c in ("positive_weight", "negative_weight")))


@query(_LAB + ", r AS (SELECT *, row_number() OVER (PARTITION BY org, label ORDER BY sha256('42|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY org, label) AS n FROM l) SELECT doc_id, label, org, k <= greatest(1, least(n - 1, round(n * 0.2))) AS is_test FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _labels(spark, sf_dir).withColumn("label", label(F.col("label")))
    return model.stratified_split(l, "doc_id").select("doc_id", "label", "org", "is_test")


# Models with weights that both engines can make: the first digits of a hash.

_CLASSES = ("good", "poor", "toxic")


def _hashed(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6), 16, 10).cast("double") / 8388608.0 - 1.0


def _hashed_sql(*parts: str) -> str:
    return f"(CAST(('0x' || sha256(concat_ws('|', {', '.join(parts)}))[1:6]) AS INT) / 8388608.0 - 1.0)"


_SUBS = ("system", "network", "cross")
_LOGITS = (
    _AXIS
    + f""", s AS (SELECT unnest({list(_CLASSES)}) AS label, unnest([0, 1, 2]) AS label_index), u AS (SELECT unnest({list(_SUBS)}) AS subcategory),
f AS (SELECT doc_id, gv_index, tf FROM tf JOIN g USING (lang, token) JOIN x USING (tag)),
k AS (SELECT gv_index, label, subcategory, {_hashed_sql("gv_index", "label", "subcategory")} AS weight FROM x CROSS JOIN s CROSS JOIN u),
b AS (SELECT label, label_index, subcategory, {_hashed_sql("'bias'", "label", "subcategory")} AS bias FROM s CROSS JOIN u),
p AS (SELECT doc_id, label, subcategory, sum(tf * weight) AS dot FROM f JOIN k USING (gv_index) GROUP BY ALL),
z AS (SELECT doc_id, label, label_index, subcategory, coalesce(dot, 0) / 50 + bias AS logit FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN b LEFT JOIN p USING (doc_id, label, subcategory))
"""
)


class _State:
    """Features of all documents and hashed weights."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tf = written(_tf(spark, sf_dir), "tf")  # several tables are made of it
        own = vocabulary.tagged(_vocabulary(spark, sf_dir, tf), KEY, "text")
        own = written(vocabulary.index_vectors(own, vocabulary.global_axis(own)).select("lang", "token", "tag", "gv_index"), "vocabulary")
        self.axis = own.select("tag", "gv_index").distinct()
        index = own.select("lang", "token", "gv_index")
        subs = spark.createDataFrame([(c, s) for c in _CLASSES for s in _SUBS], "label string, subcategory string")
        names = [F.col("label"), F.col("subcategory")]
        self.features = tf.join(index, ["lang", "token"]).select("doc_id", "gv_index", (F.col("tf") / 50).alias("value"))  # of all subcategories
        self.weights = self.axis.select("gv_index").crossJoin(F.broadcast(subs)).withColumn("weight", _hashed(F.col("gv_index").cast("string"), *names))
        self.biases = subs.withColumn("bias", _hashed(F.lit("bias"), *names))
        self.rows = table(spark, sf_dir, "documents").select("doc_id").distinct()
        self.logits = model.logits(self.features, self.weights, self.biases, self.rows, "doc_id")


HIERARCHY = model.Hierarchy({c: _SUBS for c in _CLASSES}, {c: {"bias": float(k) / 4, "system": 0.5, "network": 1.0, "cross": 1.5} for k, c in enumerate(_CLASSES)})
_FUSED = _LOGITS + ", h AS (SELECT doc_id, label, label_index, sum(logit * CASE subcategory WHEN 'system' THEN 0.5 WHEN 'network' THEN 1.0 ELSE 1.5 END) + any_value(label_index) / 4 AS label_logit FROM z GROUP BY ALL), m AS (SELECT doc_id, max(label_logit) AS top FROM h GROUP BY doc_id), e AS (SELECT h.*, exp(label_logit - top) AS e FROM h JOIN m USING (doc_id)), q AS (SELECT doc_id, label, label_index, label_logit, e / sum(e) OVER (PARTITION BY doc_id) AS probability FROM e)"


@query(_LOGITS + "SELECT doc_id, label, subcategory, round(logit, 6) AS logit FROM z")
def sparse_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _State(spark, sf_dir).logits.withColumn("logit", F.round("logit", 6))


@query(_FUSED + "SELECT doc_id, label, round(label_logit, 6) AS label_logit, round(probability, 6) AS probability, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, label_index) = 1 AS is_predicted FROM q")
def logit_fusion_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = model.fused(_State(spark, sf_dir).logits, HIERARCHY, "doc_id")
    return f.select("doc_id", "label", F.round("label_logit", 6).alias("label_logit"), F.round("probability", 6).alias("probability"), "is_predicted")


_PREDICTED = _FUSED + ", r AS (SELECT doc_id, arg_max(label, (probability, -label_index)) AS predicted_label, max(probability) AS best FROM q GROUP BY doc_id)"


@query(_PREDICTED + " SELECT doc_id, predicted_label, round(best, 6) AS max_risk_probability, best >= 0.75 AS is_high_risk FROM r")
def high_risk_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.predictions(model.fused(_State(spark, sf_dir).logits, HIERARCHY, "doc_id"), 0.75, "doc_id")
    return p.select("doc_id", "predicted_label", F.round("max_risk_probability", 6).alias("max_risk_probability"), "is_high_risk")


@query(_PREDICTED + " SELECT doc_id, label, subcategory, tag, gv_index, round(tf / 50 * weight, 6) AS contribution, row_number() OVER (PARTITION BY doc_id, subcategory ORDER BY abs(tf / 50 * weight) DESC, tag) AS rank FROM f JOIN x USING (gv_index) JOIN r USING (doc_id) JOIN k USING (gv_index) WHERE k.label = r.predicted_label AND best >= 0.75 QUALIFY rank <= 5")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _State(spark, sf_dir)
    risky = model.predictions(model.fused(s.logits, HIERARCHY, "doc_id"), 0.75, "doc_id").where("is_high_risk")
    c = model.top_contributions(s.features, s.weights, s.axis, risky, "doc_id")
    return c.select("doc_id", "label", "subcategory", "tag", "gv_index", F.round("contribution", 6).alias("contribution"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH d AS (SELECT lang AS org, count(*) AS n FROM documents GROUP BY lang), i AS (SELECT unnest(range(0, 50)) AS gv_index),
w AS (SELECT gv_index, {_hashed_sql("'w0'", "gv_index")} AS w0 FROM i), o AS (SELECT org, n, gv_index, {_hashed_sql("org", "gv_index")} AS w FROM d CROSS JOIN i WHERE (gv_index + length(org) + ascii(org)) % 3 > 0),
t AS (SELECT sum(n) AS total FROM d)
SELECT gv_index, round(w0 + coalesce(sum(n * (w - w0)) / max(total), 0), 9) AS weight FROM w CROSS JOIN t LEFT JOIN o USING (gv_index) GROUP BY gv_index, w0"""
)
def fed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [F.lit("all").alias("label"), F.lit("text").alias("subcategory")]
    weights = spark.range(50).select(*names, F.col("id").alias("gv_index")).withColumn("weight", _hashed(F.lit("w0"), F.col("gv_index").cast("string")))
    org = F.col("lang")
    kept = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")), lambda k: (k + F.length(org) + F.ascii(org)) % 3 > 0)
    updates = _documents(spark, sf_dir).select(*names, org.alias("org"), F.col("n").alias("examples"), F.lit(0.0).alias("bias"), kept.alias("indexes")).withColumn("weights", F.transform("indexes", lambda k: _hashed(F.col("org"), k.cast("string"))))
    new, _ = model.averaged(weights, updates)
    return new.select("gv_index", F.round("weight", 9).alias("weight"))


@query()
def sgd_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of training by language on the labelled documents, and what every organisation's update says."""
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1)").dropDuplicates(["doc_id"]).select("doc_id", F.col("toxic").alias("y"))
    tf = written(_tf(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi"), "tf")
    n = tf.select("doc_id", "lang").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    own = vocabulary.local_vocabulary(vocabulary.document_frequency(tf, "lang"), n, FEATURES, 2, 0.95, "lang")
    own = vocabulary.idf(vocabulary.tagged(own, KEY, "text"), n, "lang")
    own = written(vocabulary.index_vectors(own, vocabulary.global_axis(own)), "vocabulary")
    axis = own.select("tag", "gv_index").distinct()
    index = own.select(F.lit("text").alias("subcategory"), F.col("lang").alias("org"), "gv_index", "idf")
    found = tf.join(own.select("lang", "token", "gv_index"), ["lang", "token"])
    lists = found.groupBy("doc_id", "lang").agg(F.sort_array(F.collect_list(F.struct("gv_index", F.col("tf").cast("double").alias("value")))).alias("features"))
    weight = model.class_weights(labels, F.col("y") == 1)
    examples = lists.join(labels, "doc_id").crossJoin(F.broadcast(weight)).select(F.lit("toxic").alias("label"), F.lit("text").alias("subcategory"), F.col("lang").alias("org"), F.col("doc_id").alias("row"), "y", "positive_weight", "negative_weight", "features")
    weights = axis.select(F.lit("toxic").alias("label"), F.lit("text").alias("subcategory"), "gv_index", model.initial_weight(42, F.lit("toxic"), F.lit("text"), "gv_index").alias("weight"))
    biases = spark.createDataFrame([("toxic", "text", 0.0)], "label string, subcategory string, bias double")
    examples = written(examples, "examples")
    first = written(model.train_round(examples, weights, biases, index), "updates")
    weights, biases = model.averaged(weights, first)
    return model.train_round(examples, weights, biases, index, round_index=1).select("org", "examples", "loss", "accuracy", "bias", "low", "high")


_CONF = "WITH l AS (SELECT CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS t, CASE WHEN toxic = 0 THEN 'yes' WHEN doc_id % 5 = 0 THEN 'maybe' ELSE 'no' END AS p FROM labels), c AS (SELECT unnest(['yes', 'no', 'maybe']) AS c), m AS (SELECT a.c AS t, b.c AS p, (SELECT count(*) FROM l WHERE l.t = a.c AND l.p = b.c) AS n FROM c a CROSS JOIN c b)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "yes").otherwise("no").alias("t"), F.when(F.col("toxic") == 0, "yes").when(F.col("doc_id") % 5 == 0, "maybe").otherwise("no").alias("p"))
    return metrics.confusion(l, "t", "p")


@query(_CONF + " SELECT t AS true_label, p AS predicted_label, n FROM m")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(
    _CONF
    + """, e AS (SELECT c AS label, (SELECT sum(n) FROM m WHERE t = c AND p = c) AS h, (SELECT sum(n) FROM m WHERE p = c) AS f, (SELECT sum(n) FROM m WHERE t = c) AS s FROM c),
r AS (SELECT label, s, h, CASE WHEN f = 0 THEN 0 ELSE h / f END AS precision, CASE WHEN s = 0 THEN 0 ELSE h / s END AS recall FROM e),
x AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r),
a AS (SELECT label, precision, recall, f1, s FROM x UNION ALL SELECT 'accuracy', sum(h) / sum(s), sum(h) / sum(s), sum(h) / sum(s), sum(s) FROM x UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(s) FROM x
  UNION ALL SELECT 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), sum(s) FROM x)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, s::BIGINT AS support FROM a"""
)
def prf1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.report(_matrix(spark, sf_dir))
    return r.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")
