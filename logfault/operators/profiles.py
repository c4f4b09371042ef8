"""Label, model and message profiles of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lookup import counted_broadcast

LABELS = (0, 1, 2, 3)
#: Profiles, of some fifty messages each, that are broadcast at most.
MAX_PROFILES = 20_000


def attach_model(faults: DataFrame, logs: DataFrame, missing: str = "MISSING") -> DataFrame:
    """Add the server's model; a server with two models doubles its faults."""
    models = logs.select("sn", "server_model").distinct()
    return (faults.join(models, "sn", "left")
            .withColumn("server_model", F.coalesce("server_model", F.lit(missing))))


def value_mix(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """Count and share of each value, over all rows or within groups."""
    within = within or []
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    if within:
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    whole = df.agg(F.count(F.lit(1)).alias("_rows"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select(value, "n", (F.col("n") / F.col("_rows")).alias("share"))


def label_shares(faults: DataFrame, fold: str | None = None, n_folds: int = 10) -> DataFrame:
    """Share of each model among the faults of a label.

    Columns ``server_model, label, label_model_cnt, label_cnt, share``. With
    ``fold`` (numbered 0 to ``n_folds - 1``) every fold's counts leave out its
    own rows, so the shares can be attached without leaking labels.
    """
    keys = ["server_model", "label"]
    if fold is None:
        counts = faults.groupBy(*keys).agg(F.count(F.lit(1)).alias("label_model_cnt"))
        by = ["label"]
    else:
        own = faults.groupBy(fold, *keys).agg(F.count(F.lit(1)).alias("_own"))
        whole = own.groupBy(*keys).agg(F.sum("_own").alias("_all"))
        every = whole.select(*keys, "_all", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias(fold))
        counts = (every.join(own, [fold, *keys], "left")
                  .select(fold, *keys, (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("label_model_cnt")))
        by = [fold, "label"]
    total = F.sum("label_model_cnt").over(Window.partitionBy(*by))
    return (counts.withColumn("label_cnt", total)
            .withColumn("share", F.when(total > 0, F.col("label_model_cnt") / total)))


def share_columns(shares: DataFrame, keys: list[str], prefix: str = "server_model_p",
                  labels=LABELS) -> DataFrame:
    """One row per key with a column per label, 0 where there is none."""
    return shares.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("label") == label, F.col("share"))), F.lit(0.0)).alias(f"{prefix}{label}")
        for label in labels])


def attach_shares(df: DataFrame, shares: DataFrame, model: Column | str,
                  prefix: str = "server_model_p", labels=LABELS, fold: str | None = None) -> DataFrame:
    """Join the label shares of the given model; 0 for an unknown model."""
    keys = ["server_model"] + ([fold] if fold else [])
    wide = share_columns(shares, keys, prefix, labels).withColumnRenamed("server_model", "_model")
    model = F.col(model) if isinstance(model, str) else model
    on = ["_model"] + ([fold] if fold else [])
    return (df.withColumn("_model", model).join(counted_broadcast(wide), on, "left").drop("_model")
            .fillna(0.0, [f"{prefix}{label}" for label in labels]))


def tail_values(tails: DataFrame, n: int, value: str, keys: list[str], distinct: bool) -> DataFrame:
    """One row per fault and (distinct) value of its last ``n`` logs."""
    values = F.transform(F.slice("tail", F.greatest(F.lit(1), F.size("tail") - (n - 1)), n),
                         lambda row: row[value])
    if distinct:
        values = F.array_distinct(values)
    return tails.select(*keys, F.explode(values).alias(value))


def top_messages(tails: DataFrame, by: list[str], n: int, keep: int, distinct: bool,
                 value: str = "msg_id") -> DataFrame:
    """The ``keep`` most common messages of each group; ties go to the smaller id.

    ``distinct`` counts the faults that hold a message, otherwise its rows.
    """
    counts = tail_values(tails, n, value, by, distinct).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col(value)))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= keep)


def profile_overlap(tails: DataFrame, top: DataFrame, by: list[str], n: int, keys: list[str],
                    labels=LABELS, value: str = "msg_id", prefix: str = "overlap_") -> DataFrame:
    """Share of each label's profile found in the fault's last ``n`` logs.

    ``by`` are the profile's keys besides the label. A profile holds at most
    ``keep`` messages, so it travels as a short array.
    """
    profiles = top.groupBy(*by, "label").agg(F.collect_list(value).alias("profile"))
    own = F.array_distinct(F.transform(
        F.slice("tail", F.greatest(F.lit(1), F.size("tail") - (n - 1)), n), lambda row: row[value]))
    asked = (tails.select(*keys, *[b for b in by if b not in keys], own.alias("own"),
                          F.explode(F.array(*[F.lit(label) for label in labels])).alias("label")))
    scored = (asked.join(counted_broadcast(profiles, MAX_PROFILES), [*by, "label"], "left")
              .withColumn("overlap", F.coalesce(
                  F.size(F.array_intersect("own", "profile")) / F.size("profile"), F.lit(0.0))))
    return scored.groupBy(*keys).agg(*[
        F.max(F.when(F.col("label") == label, F.col("overlap"))).alias(f"{prefix}{label}") for label in labels])


def coverage(tails_by_set: dict[str, DataFrame], n: int) -> DataFrame:
    """Mean tail length of each named fault set."""
    frames = [df.select(F.lit(name).alias("dataset"), F.least(F.col("pos"), F.lit(n)).alias("length"))
              for name, df in tails_by_set.items()]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked.groupBy("dataset").agg(F.avg("length").alias("mean_length"))
