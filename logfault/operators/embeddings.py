"""Vectors of texts: word means, weighted means, centroids and similarities."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..functions.cleaning import value_counts, vectoriser_tokens, words
from ..sources.scratch import materialise
from .documents import bucket_lines, line_term_counts, vocabulary
from .factors import leading_axes, on_axes
from .lookup import counted_broadcast, lookup
from .profiles import LABELS

SEED = 2022
#: Messages with a vector that are broadcast at most.
MAX_MESSAGES = 20_000


def cooccurrences(docs: DataFrame, tokens: Column, window: int = 3) -> DataFrame:
    """``word, context, n``: how often two tokens lie at most ``window`` places apart in a document.

    Both directions count. Pairs are made inside the row and combined on the
    map side.
    """
    placed = docs.select(tokens.alias("_t")).select(F.explode(F.transform("_t", lambda t, i: F.struct(
        t.alias("word"), F.concat(
            F.slice("_t", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))),
            F.slice("_t", i + 2, window)).alias("near")))).alias("p"))
    pairs = placed.select("p.word", F.explode("p.near").alias("context"))
    return pairs.groupBy("word", "context").agg(F.count(F.lit(1)).alias("n"))


def association(counts: DataFrame, words: DataFrame, contexts: DataFrame, smooth: float = 0.75) -> DataFrame:
    """``word, context, weight``: positive pointwise mutual information of co-occurrence counts.

    Of ``words`` against ``contexts`` (one column, distinct). Context counts
    are raised to ``smooth``, which lowers the weight of rare contexts. The
    sums are one number each per word and context.
    """
    kept = materialise(counts.join(words, "word").join(counted_broadcast(contexts), "context"), "pairs")
    by_word = kept.groupBy("word").agg(F.sum("n").alias("n_word"))
    by_context = kept.groupBy("context").agg(F.pow(F.sum("n"), F.lit(smooth)).alias("n_context"))
    total = by_context.agg(F.coalesce(F.sum("n_context"), F.lit(0.0))).first()[0]
    joined = kept.join(by_word, "word").join(counted_broadcast(by_context), "context")
    weight = F.ln(F.col("n") * F.lit(total) / (F.col("n_word") * F.col("n_context")))
    return joined.select("word", "context", weight.alias("weight")).filter("weight > 0")


def fit_word_vectors(docs: DataFrame, tokens: Column, size: int = 64, window: int = 3, min_count: int = 2,
                     seed: int = SEED, max_features: int = 50_000, smooth: float = 0.75, rounds: int = 8) -> DataFrame:
    """``word, vector`` from windowed co-occurrence counts.

    The table of words against contexts holds their positive pointwise mutual
    information and is factorised by subspace iteration; a word's vector is
    its row on the leading ``size`` axes, so inner products of vectors are
    those of the rows as far as ``size`` axes go. Every word with
    ``min_count`` occurrences gets a vector; the ``max_features`` most common
    of them (ties by alphabet) are contexts, and only tables of that size
    reach the driver. A word without an associated context has the zero
    vector.
    """
    counted = (docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") >= min_count))
    words = materialise(counted, "words")
    contexts = words.orderBy(F.col("n").desc(), "word").limit(max_features).select(F.col("word").alias("context"))
    weights = association(cooccurrences(docs, tokens, window), words.select("word"), contexts, smooth)
    names = [r[0] for r in contexts.orderBy("context").collect()]
    if not names:
        return words.select("word", F.array_repeat(F.lit(0.0), size).alias("vector"))
    numbered = docs.sparkSession.createDataFrame(list(enumerate(names)), "id int, context string")
    rows = weights.join(F.broadcast(numbered), "context").groupBy("word").agg(  # at most max_features rows
        F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("e"))
    rows = materialise(rows.select("word", F.col("e.id").alias("ids"), F.col("e.weight").alias("weights")), "rows")
    axes, _ = leading_axes(rows, len(names), size, rounds, seed=seed)
    placed = on_axes(rows, axes, "word", size)
    zero = F.array_repeat(F.lit(0.0), size)
    return words.select("word").join(placed, "word", "left").select("word", F.coalesce("vector", zero).alias("vector"))


def weighted_mean(df: DataFrame, keys: list[str], vector: str = "vector", weight: str | None = None,
                  out: str = "vector") -> DataFrame:
    """Mean vector per group, combined on the map side."""
    value = array_to_vector(F.col(vector))
    mean = Summarizer.mean(value, F.col(weight)) if weight else Summarizer.mean(value)
    return df.groupBy(*keys).agg(mean.alias("_mean")).select(*keys, vector_to_array("_mean").alias(out))


def _zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def mean_vectors(df: DataFrame, keys: list[str], tokens: Column, vectors: DataFrame, size: int,
                 out: str = "vector") -> DataFrame:
    """Mean over the known tokens of each row, with repeats; zeros if none.

    ``keys`` identify a row of ``df``. Repeats are counted inside the row, so
    each distinct token is joined once.
    """
    counted = (df.select(*keys, F.explode(value_counts(tokens)).alias("t"))
               .select(*keys, F.col("t.value").alias("word"), F.col("t.n").alias("n")))
    means = weighted_mean(counted.join(vectors, "word"), keys, "vector", "n", out)
    return df.join(means, keys, "left").withColumn(out, F.coalesce(out, _zeros(size)))


def tail_mean_vectors(tails: DataFrame, keys: list[str], vectors: DataFrame, size: int, tail: str = "tail",
                      field: str = "msg_lower", out: str = "vector") -> DataFrame:
    """:func:`mean_vectors` over the tokens of a tail's messages, message by message.

    Each distinct message meets the word vectors once; a fault then joins its
    few messages instead of its many words. Messages with very many faults
    are spread by :func:`lookup`.
    """
    messages = F.transform(F.col(tail), lambda row: row[field])
    counted = (tails.select(*keys, F.explode(value_counts(messages)).alias("m"))
               .select(*keys, F.col("m.value").alias("message"), F.col("m.n").alias("n")))
    seen = counted.groupBy("message").agg(F.count(F.lit(1)).alias("n_rows"))
    known = (seen.select("message", F.explode(value_counts(words("message"))).alias("t"))
             .select("message", F.col("t.value").alias("word"), F.col("t.n").alias("w")).join(vectors, "word"))
    value = array_to_vector(F.col("vector"))
    placed = known.groupBy("message").agg(Summarizer.mean(value, F.col("w").cast("double")).alias("_mean"), F.sum("w").alias("_words"))
    placed = materialise(seen.join(placed, "message").select("message", "n_rows", "_words", vector_to_array("_mean").alias("_mean")), "messages")
    if placed.limit(MAX_MESSAGES + 1).offset(MAX_MESSAGES).take(1):
        joined = lookup(counted, placed, "message", ["_words", "_mean"], weight="n_rows").filter("_words IS NOT NULL")
    else:
        joined = counted.join(F.broadcast(placed.drop("n_rows")), "message")
    means = weighted_mean(joined.withColumn("_w", (F.col("n") * F.col("_words")).cast("double")), keys, "_mean", "_w", out)
    return tails.join(means, keys, "left").withColumn(out, F.coalesce(out, _zeros(size)))


def tail_tokens(tail="tail", field: str = "msg_lower", prefix=None) -> Column:
    """White-space tokens of a tail's text, each behind ``<prefix>_`` if given."""
    tokens = F.flatten(F.transform(F.col(tail), lambda row: words(row[field])))
    if prefix is None:
        return tokens
    head = F.lower(F.col(prefix) if isinstance(prefix, str) else prefix)
    return F.transform(tokens, lambda t: F.concat(head, F.lit("_"), t))


def tail_text(tail="tail", field: str = "msg_lower") -> Column:
    return F.array_join(F.transform(F.col(tail), lambda row: row[field]), "\n")


def unigram_vocabulary(logs: DataFrame, seconds: int = 7_200) -> DataFrame:
    """Terms of the un-limited documents per server and time bucket."""
    lines = bucket_lines(logs, seconds)
    n_docs = lines.select("sn", "bucket").distinct().count()
    return vocabulary(line_term_counts(lines, ["sn", "bucket"], high=1), n_docs, 1, None)


def tfidf_mean_vectors(df: DataFrame, keys: list[str], tokens: Column, text: Column, vocab: DataFrame,
                       vectors: DataFrame, size: int, out: str = "weighted") -> DataFrame:
    """Mean over known tokens weighted by their TF-IDF in the row's text.

    The length of the TF-IDF vector cancels, so tf x idf is weight enough. A
    token that is no term of the vocabulary has weight 0.
    """
    counted = (df.select(*keys, tokens.alias("_words"),
                         F.map_from_entries(value_counts(vectoriser_tokens(text))).alias("_tf"))
               .select(*keys, "_tf", F.explode(value_counts(F.col("_words"))).alias("t"))
               .select(*keys, F.col("t.value").alias("word"), F.col("t.n").alias("n"),
                       F.try_element_at("_tf", F.col("t.value")).alias("tf"))
               .filter(F.col("tf").isNotNull()))
    weighted = (counted.join(vocab.select(F.col("term").alias("word"), "idf"), "word")
                .join(vectors, "word")
                .withColumn("w", F.col("n") * F.col("tf") * F.col("idf")))
    means = weighted_mean(weighted, keys, "vector", "w", out)
    return df.join(means, keys, "left").withColumn(out, F.coalesce(out, _zeros(size)))


def label_centroids(tails: DataFrame, vectors: DataFrame, size: int, n: int = 20,
                    field: str = "msg_lower") -> DataFrame:
    """Per label: message mean vectors weighted by the message's share of the
    label's tails."""
    rows = F.slice("tail", F.greatest(F.lit(1), F.size("tail") - (n - 1)), n)
    counts = (tails.select("label", F.explode(rows).alias("row"))
              .groupBy("label", F.col(f"row.{field}").alias("message")).agg(F.count(F.lit(1)).alias("n")))
    messages = mean_vectors(counts.select("message").distinct(), ["message"], words("message"), vectors, size)
    return weighted_mean(counts.join(messages, "message"), ["label"], "vector", "n", "centroid")


def compare_to_labels(df: DataFrame, centroids: DataFrame, keys: list[str], vector: str = "vector",
                      measure=V.cosine, prefix: str = "cos_sim_label", labels=LABELS) -> DataFrame:
    """One column per label with ``measure(vector, centroid)``.

    There is one centroid per label: they are one row, attached to every row.
    """
    one = centroids.agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "centroid"))).alias("_of"))
    scored = df.select(*keys, vector).crossJoin(F.broadcast(one))
    return scored.select(*keys, *[measure(F.col(vector), F.try_element_at("_of", F.lit(i))).alias(f"{prefix}{i}") for i in labels])


def compare_to_groups(df: DataFrame, centroids: DataFrame, group: str, vector: str = "vector",
                      measure=V.cosine, out: str = "cos_sim_server_model") -> DataFrame:
    """``measure`` to the centroid of the row's own group; null if it has none."""
    return (df.join(counted_broadcast(centroids), group, "left").withColumn(out, measure(vector, "centroid"))
            .drop("centroid"))
