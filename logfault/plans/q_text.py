"""Queries: templates, text terms and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C, vectors as V
from ..functions.measures import rounded
from ..operators import documents as D, embeddings as E, factors as X, templates as T
from ..sources import standin
from ..sources.readers import spread_scan
from ..sources.scratch import materialise
from .base import query
from .q_aggregates import model_faults
from .q_joins import plain_tails

_TEMPLATES = """
, tpl AS (SELECT event_type || ' | k <:NUM:> | <:*:>' AS template, count(*) AS size, min(event_id) AS first_row,
          row_number() OVER (ORDER BY min(event_id)) AS template_id FROM ev GROUP BY event_type)
"""


@query("h01_template_mining", _TEMPLATES + "SELECT template_id, template, size, first_row FROM tpl")
def template_mining(spark, folder):
    return T.mine_templates(standin.logs(spark, folder)).select("template_id", "template", "size", "first_row")


@query("h02_template_match", _TEMPLATES + """
SELECT row_id, CASE WHEN msg_lower LIKE 'view%' THEN 'None' ELSE CAST(template_id AS VARCHAR) END AS template_id,
       CASE WHEN msg_lower LIKE 'view%' THEN 'None' ELSE tpl.template END AS template
FROM plain_logs JOIN tpl ON tpl.template LIKE split_part(msg_lower, ' ', 1) || ' %'""")
def template_match(spark, folder):
    """Every log row against the mined templates, one of them withheld."""
    log = standin.logs(spark, folder)
    known = T.mine_templates(log).filter(F.col("first_token") != "view")
    return T.attach_templates(log, known).select("row_id", "template_id", "template")


@query("h03_template_size", _TEMPLATES + "SELECT CAST(template_id AS VARCHAR) AS template_id, size FROM tpl")
def template_size(spark, folder):
    log = standin.logs(spark, folder)
    matched = T.attach_templates(log, T.mine_templates(log))
    return matched.groupBy("template_id").agg(F.count(F.lit(1)).alias("size"))


@query("h04_words", """
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda t: t <> '') AS w FROM documents)""",
       base=False)
def words(spark, folder):
    docs = standin.table(spark, folder, "documents").select("doc_id", C.words("text").alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n_words"),
                       F.md5(F.array_join("w", " ")).alias("words"))


_TERMS = """
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents),
pos AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok),
gram AS (SELECT doc_id, t[i] AS term FROM pos
  UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM pos WHERE i + 1 <= len(t)
  UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FROM pos WHERE i + 2 <= len(t)),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM gram GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df, ln((1.0 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf
  FROM cnt GROUP BY term HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 50000),
uni AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2)
"""


def documents(spark, folder):
    return spread_scan(standin.table(spark, folder, "documents").select("doc_id", "text"))


def document_vocabulary(spark, folder):
    docs = documents(spark, folder)
    cut = {"min_df": 5, "max_features": 50_000}
    counts = D.term_counts(docs, ["doc_id"], "text", 1, 3, **cut)  # written: read twice or more
    return counts, D.vocabulary(counts, docs.count(), **cut)


@query("h05_ngrams", _TERMS + "SELECT doc_id, term, tf FROM cnt", base=False)
def ngrams(spark, folder):
    return D.term_counts(documents(spark, folder), ["doc_id"], "text", 1, 3)


@query("h06_vocabulary", _TERMS + "SELECT term, CAST(total AS BIGINT) AS total, df FROM vocab", base=False)
def vocabulary(spark, folder):
    return document_vocabulary(spark, folder)[1].select("term", "total", "df")


@query("h07_bag_of_words", _TERMS + "SELECT doc_id, term, tf FROM uni", base=False)
def bag_of_words(spark, folder):
    return D.term_counts(documents(spark, folder), ["doc_id"])


@query("h08_tfidf", _TERMS + """
, raw AS (SELECT doc_id, term, tf * idf AS w FROM cnt JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""", base=False)
def tfidf(spark, folder):
    counts, vocab = document_vocabulary(spark, folder)
    return D.tfidf(counts, vocab, ["doc_id"]).select("doc_id", "term", rounded("weight", 6).alias("weight"))


def _svd(spark, folder):
    docs = documents(spark, folder)
    counts, vocab = document_vocabulary(spark, folder)
    vocab = materialise(vocab, "vocabulary")
    components, singular = X.fit_svd(counts, vocab, ["doc_id"])
    return docs.select("doc_id"), counts, components, singular


@query("h09_truncated_svd")
def truncated_svd(spark, folder):
    """The coordinates of every text; ``h09_svd_audit`` holds the axes against the table."""
    docs, counts, components, _ = _svd(spark, folder)
    return X.project(counts, components, docs, ["doc_id"])


@query("h09_svd_audit", """
SELECT axis, 1.0 AS length, 0.0 AS off_other_axes, 0.0 AS off_singular_value FROM (SELECT unnest(range(0, 16)) AS axis)""", base=False)
def svd_audit(spark, folder):
    """Axes are orthonormal, and the coordinates on an axis have its singular value as their length."""
    docs, counts, components, singular = _svd(spark, folder)
    placed = X.project(counts, components, docs, ["doc_id"])
    known = F.array(*[F.lit(v) for v in singular])
    lengths = (placed.select(F.posexplode("tfv").alias("axis", "x")).groupBy("axis")
               .agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s")))
    axes = components.select("term", F.posexplode("v").alias("axis", "x"))
    other = axes.select("term", F.col("axis").alias("axis2"), F.col("x").alias("y"))
    products = (axes.join(other, "term").groupBy("axis", "axis2").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
                .groupBy("axis").agg(F.max(F.when(F.col("axis") == F.col("axis2"), F.col("p"))).alias("length"),
                                     F.max(F.when(F.col("axis") != F.col("axis2"), F.abs("p"))).alias("off")))
    return products.join(lengths, "axis").select(
        F.col("axis").cast("bigint").alias("axis"), F.round("length", 6).alias("length"), F.round("off", 6).alias("off_other_axes"),
        F.round(F.abs(F.col("s") / F.get(known, F.col("axis")) - 1), 6).alias("off_singular_value"))


@query("h10_word_embedding", """
, d AS (SELECT sn, ceil(epoch_us(time) / 1800000000.0) AS b, msg_lower, time, row_id,
        row_number() OVER (PARTITION BY sn, ceil(epoch_us(time) / 1800000000.0) ORDER BY time DESC, row_id DESC) AS back FROM plain_logs),
doc AS (SELECT string_split(string_agg(msg_lower, ' ' ORDER BY time, row_id), ' ') AS w FROM d WHERE back <= 20 GROUP BY sn, b),
pos AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM doc),
word AS (SELECT w[i] AS word FROM pos GROUP BY 1 HAVING count(*) >= 2),
pair AS (SELECT w[i] AS word, w[i + o] AS context FROM pos CROSS JOIN (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS o)
         WHERE i + o BETWEEN 1 AND len(w)),
n AS (SELECT word, context, count(*) AS n FROM pair WHERE word IN (SELECT word FROM word) AND context IN (SELECT word FROM word)
      GROUP BY 1, 2),
nw AS (SELECT word, sum(n) AS nw FROM n GROUP BY 1), nc AS (SELECT context, pow(sum(n), 0.75) AS nc FROM n GROUP BY 1),
m AS (SELECT word, context, ln(n * (SELECT sum(nc) FROM nc) / (nw * nc)) AS x FROM n JOIN nw USING (word) JOIN nc USING (context))
SELECT a.word, b.word AS other, round(coalesce(sum(p.x * q.x), 0), 4) + 0.0 AS product
FROM word a CROSS JOIN word b LEFT JOIN (SELECT * FROM m WHERE x > 0) p ON p.word = a.word
LEFT JOIN (SELECT * FROM m WHERE x > 0) q ON q.word = b.word AND q.context = p.context GROUP BY 1, 2""")
def word_embedding(spark, folder):
    """Inner products of all word vectors: with more axes than words they are those of the association table."""
    docs = D.bucket_documents(standin.logs(spark, folder), 1800, 20)
    vectors = materialise(E.fit_word_vectors(docs, C.words("text")), "vectors")
    flat = vectors.select("word", F.posexplode("vector").alias("axis", "x"))
    other = flat.select(F.col("word").alias("other"), "axis", F.col("x").alias("y"))
    products = flat.join(other, "axis").groupBy("word", "other").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    return products.select("word", "other", (F.round("p", 4) + 0.0).alias("product"))


SIZE = 64
_VECTORS = """
, words AS (SELECT DISTINCT unnest(string_split(msg_lower, ' ')) AS word FROM plain_logs),
wv AS (SELECT word, embedding AS v FROM words JOIN embeddings
       ON vec_id = CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 600),
dim AS (SELECT word, unnest(range(0, 64)) AS dim, CAST(unnest(v) AS DOUBLE) AS x FROM wv),
dims AS (SELECT unnest(range(0, 64)) AS dim),
ftok AS (SELECT fault_id, unnest(string_split(msg_lower, ' ')) AS word FROM t20),
fmean AS (SELECT fault_id, dim, avg(x) AS x FROM ftok JOIN dim USING (word) GROUP BY 1, 2),
fvec AS (SELECT f.fault_id, f.label, f.own_model, d.dim, coalesce(m.x, 0) AS x
         FROM faults f CROSS JOIN dims d LEFT JOIN fmean m ON m.fault_id = f.fault_id AND m.dim = d.dim)
"""


def word_vectors(spark, folder):
    tokens = standin.logs(spark, folder).select(F.explode(C.words("msg_lower")).alias("word")).distinct()
    return standin.word_vectors(spark, folder, tokens)


def long_form(df, key, vector):
    return (df.select(key, F.posexplode(vector).alias("dim", "x"))
            .select(key, F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x")))


def fault_vectors(spark, folder, tails=None):
    """Mean vectors of the tails, which are written as the operator reads them twice."""
    tails = materialise(plain_tails(spark, folder), "tails") if tails is None else tails
    return E.tail_mean_vectors(tails, ["fault_id"], word_vectors(spark, folder), SIZE)


@query("h11_mean_vector", _VECTORS + "SELECT fault_id, dim, round(x, 6) AS x FROM fvec")
def mean_vector(spark, folder):
    return long_form(fault_vectors(spark, folder), "fault_id", "vector")


@query("h12_tfidf_mean_vector", _VECTORS + """
, docs AS (SELECT sn, ceil(epoch_us(time) / 7200000000.0) AS b, regexp_extract_all(msg_lower, '[\\p{L}\\p{N}_]{2,}') AS t
           FROM plain_logs),
dt AS (SELECT DISTINCT sn, b, unnest(t) AS word FROM docs),
nd AS (SELECT count(*) AS n FROM (SELECT DISTINCT sn, b FROM docs)),
idf AS (SELECT word, ln((1.0 + (SELECT n FROM nd)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY word),
tf AS (SELECT fault_id, word, count(*) AS tf FROM
   (SELECT fault_id, unnest(regexp_extract_all(msg_lower, '[\\p{L}\\p{N}_]{2,}')) AS word FROM t20) GROUP BY 1, 2),
wt AS (SELECT k.fault_id, k.word, tf * idf AS w FROM ftok k JOIN tf USING (fault_id, word) JOIN idf USING (word)),
m AS (SELECT fault_id, dim, sum(w * x) / sum(w) AS x FROM wt JOIN dim USING (word) GROUP BY 1, 2)
SELECT f.fault_id, d.dim, round(coalesce(m.x, 0), 6) AS x
FROM faults f CROSS JOIN dims d LEFT JOIN m ON m.fault_id = f.fault_id AND m.dim = d.dim""")
def tfidf_mean_vector(spark, folder):
    vocab = E.unigram_vocabulary(standin.logs(spark, folder))
    df = E.tfidf_mean_vectors(plain_tails(spark, folder), ["fault_id"], E.tail_tokens(), E.tail_text(), vocab,
                              word_vectors(spark, folder), SIZE)
    return long_form(df, "fault_id", "weighted")


@query("h13_model_scoped_vector", """
, ftok AS (SELECT t.fault_id, f.own_model || '_' || unnest(string_split(msg_lower, ' ')) AS word
           FROM t20 t JOIN faults f USING (fault_id)),
words AS (SELECT DISTINCT word FROM ftok),
dim AS (SELECT word, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM words JOIN embeddings
       ON vec_id = CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 600),
m AS (SELECT fault_id, dim, avg(x) AS x FROM ftok JOIN dim USING (word) GROUP BY 1, 2)
SELECT f.fault_id, d.dim, round(coalesce(m.x, 0), 6) AS x
FROM faults f CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) d LEFT JOIN m ON m.fault_id = f.fault_id AND m.dim = d.dim""")
def model_scoped_vector(spark, folder):
    models = model_faults(spark, folder).select("fault_id", F.upper("server_model").alias("model"))
    tails = plain_tails(spark, folder).join(models, "fault_id")
    tokens = E.tail_tokens(prefix="model")
    known = standin.word_vectors(spark, folder, tails.select(F.explode(tokens).alias("word")).distinct())
    return long_form(E.mean_vectors(tails, ["fault_id"], tokens, known, SIZE), "fault_id", "vector")


@query("h13_model_scoped_svd")
def model_scoped_svd(spark, folder):
    """Truncated SVD of bucket documents whose words carry the model."""
    logs = standin.logs(spark, folder)
    scoped = logs.withColumn("msg_lower", F.array_join(C.prefix_words("msg_lower", "server_model"), " "))
    docs = D.bucket_documents(scoped, 1800, 20)
    counts = D.term_counts(docs, ["sn", "bucket"], "text", 1, 3)
    vocab = materialise(D.vocabulary(counts, docs.count()), "vocabulary")
    components, _ = X.fit_svd(counts, vocab, ["sn", "bucket"])
    tails = plain_tails(spark, folder).join(
        model_faults(spark, folder).select("fault_id", "server_model"), "fault_id")
    text = F.array_join(E.tail_tokens(prefix="server_model"), " ")
    asked = D.term_counts(tails.select("fault_id", text.alias("text")), ["fault_id"], "text", 1, 3)
    return X.project(asked, components, tails.select("fault_id"), ["fault_id"])


_CENTROIDS = _VECTORS + """
, lm AS (SELECT label, msg_lower, count(*) AS n FROM t20 GROUP BY 1, 2),
mtok AS (SELECT msg_lower, unnest(string_split(msg_lower, ' ')) AS word FROM (SELECT DISTINCT msg_lower FROM lm)),
mm AS (SELECT msg_lower, dim, avg(x) AS x FROM mtok JOIN dim USING (word) GROUP BY 1, 2),
cen AS (SELECT l.label, d.dim, sum(n * coalesce(mm.x, 0)) / sum(n) AS c FROM lm l CROSS JOIN dims d
        LEFT JOIN mm ON mm.msg_lower = l.msg_lower AND mm.dim = d.dim GROUP BY 1, 2),
mcen AS (SELECT own_model, dim, avg(x) AS c FROM fvec GROUP BY 1, 2)
"""


@query("h14_label_centroid", _CENTROIDS + "SELECT label, dim, round(c, 6) AS x FROM cen")
def label_centroid(spark, folder):
    centroids = E.label_centroids(plain_tails(spark, folder), word_vectors(spark, folder), SIZE)
    return long_form(centroids, "label", "centroid")


def _model_vectors(spark, folder, tails=None):
    models = model_faults(spark, folder).select("fault_id", "server_model")
    return fault_vectors(spark, folder, tails).join(models, "fault_id").select("fault_id", "label", "server_model", "vector")


@query("h15_model_centroid", _CENTROIDS + "SELECT own_model AS server_model, dim, round(c, 6) AS x FROM mcen")
def model_centroid(spark, folder):
    return long_form(E.weighted_mean(_model_vectors(spark, folder), ["server_model"], out="centroid"),
                     "server_model", "centroid")


@query("h16_cosine_to_centroids", _CENTROIDS + """
, s AS (SELECT f.fault_id, c.label, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS s
  FROM fvec f JOIN cen c ON c.dim = f.dim GROUP BY 1, 2),
m AS (SELECT fault_id, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS s
  FROM fvec f JOIN mcen c ON c.dim = f.dim AND c.own_model = f.own_model GROUP BY 1)
SELECT s.fault_id, round(max(s.s) FILTER (WHERE label = 0), 6) AS cos_sim_label0,
  round(max(s.s) FILTER (WHERE label = 1), 6) AS cos_sim_label1, round(max(s.s) FILTER (WHERE label = 2), 6) AS cos_sim_label2,
  round(max(s.s) FILTER (WHERE label = 3), 6) AS cos_sim_label3, round(max(m.s), 6) AS cos_sim_server_model
FROM s JOIN m USING (fault_id) GROUP BY s.fault_id""")
def cosine_to_centroids(spark, folder):
    tails = materialise(plain_tails(spark, folder), "tails")
    df = materialise(_model_vectors(spark, folder, tails), "vectors")
    labels = E.label_centroids(tails, word_vectors(spark, folder), SIZE)
    models = E.weighted_mean(df, ["server_model"], out="centroid")
    own = E.compare_to_groups(df, models, "server_model")
    return E.compare_to_labels(own, labels, ["fault_id", "cos_sim_server_model"]).select("fault_id", *[
        F.round(c, 6).alias(c) for c in [*(f"cos_sim_label{i}" for i in range(4)), "cos_sim_server_model"]])


@query("h17_other_distances", _CENTROIDS + """
, s AS (SELECT f.fault_id, c.label, sqrt(sum((x - c) * (x - c))) AS d, corr(x, c) AS p
  FROM fvec f JOIN cen c ON c.dim = f.dim GROUP BY 1, 2)
SELECT fault_id, """ + ", ".join(
    f"round(max(d) FILTER (WHERE label = {i}), 6) AS dist_label{i}, round(max(p) FILTER (WHERE label = {i}), 6) AS p_label{i}"
    for i in range(4)) + " FROM s GROUP BY fault_id")
def other_distances(spark, folder):
    tails = materialise(plain_tails(spark, folder), "tails")
    df = materialise(_model_vectors(spark, folder, tails), "vectors")
    labels = E.label_centroids(tails, word_vectors(spark, folder), SIZE)
    labels = materialise(labels, "centroids")
    far = E.compare_to_labels(df, labels, ["fault_id", "vector"], measure=V.euclidean, prefix="dist_label")
    near = E.compare_to_labels(far, labels, [c for c in far.columns if c != "vector"], measure=V.pearson, prefix="p_label")
    return near.select("fault_id", *[
        F.round(f"{name}_label{i}", 6).alias(f"{name}_label{i}") for i in range(4) for name in ("dist", "p")])


@query("h18_kmeans_distance")
def kmeans_distance(spark, folder):
    vectors = standin.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return X.cluster_distances(vectors, "v").drop("v")


@query("h19_topic_mixture")
def topic_mixture(spark, folder):
    counts, vocab = document_vocabulary(spark, folder)
    vocab = materialise(vocab, "vocabulary")
    scan = standin.table(spark, folder, "documents").select("doc_id", "text")
    docs = documents(spark, folder)
    vectors = X.tfidf_vectors(docs, vocab).select("doc_id", "tfidf")
    # Texts that are dealt out lie in an order of their own, without their ids.
    dealt = docs.rdd.getNumPartitions() != scan.rdd.getNumPartitions()
    mixed = X.topic_mixture(vectors, fit_on=X.tfidf_vectors(spread_scan(scan.select("text")), vocab) if dealt else None)
    return mixed.select("doc_id", "topics")


@query("h20_untailed_terms", """
, d AS (SELECT sn, CAST(ceil(epoch_us(time) / 1800000000.0) * 1800 AS BIGINT) AS bucket,
        string_agg(msg_lower, chr(10) ORDER BY time, row_id) AS text FROM plain_logs GROUP BY 1, 2),
tok AS (SELECT sn, bucket, regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}') AS t FROM d),
pos AS (SELECT sn, bucket, t, unnest(range(1, len(t) + 1)) AS i FROM tok)
SELECT sn, bucket, term, count(*) AS tf FROM (
  SELECT sn, bucket, t[i] AS term FROM pos
  UNION ALL SELECT sn, bucket, t[i] || ' ' || t[i + 1] FROM pos WHERE i + 1 <= len(t)
  UNION ALL SELECT sn, bucket, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FROM pos WHERE i + 2 <= len(t))
GROUP BY ALL""")
def untailed_terms(spark, folder):
    """N-gram counts of whole bucket documents, across line ends."""
    return D.line_term_counts(D.bucket_lines(standin.logs(spark, folder), 1800), ["sn", "bucket"])


@query("h20_untailed_svd")
def untailed_svd(spark, folder):
    lines = D.bucket_lines(standin.logs(spark, folder), 1800)
    counts = D.line_term_counts(lines, ["sn", "bucket"])
    n_docs = lines.select("sn", "bucket").distinct().count()
    vocab = materialise(D.vocabulary(counts, n_docs), "vocabulary")
    components, _ = X.fit_svd(counts, vocab, ["sn", "bucket"])
    tails = plain_tails(spark, folder)
    asked = D.term_counts(tails.select("fault_id", E.tail_text().alias("text")), ["fault_id"], "text", 1, 3)
    return X.project(asked, components, tails.select("fault_id"), ["fault_id"])
