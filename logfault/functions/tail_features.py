"""Feature columns over a fault's tail.

A tail is an ordered array of at most 50 structs (see
``operators.timeline.tail_arrays``) with ``time_ts``, ``msg_id``,
``template_id`` and ``msg_lower``. Everything here is a column expression on
that bounded array: no join, no shuffle, no Python function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .cleaning import safe_split, words
from .measures import ratio_or_null, ratio_or_zero
from .vectors import let, pearson, total

# Fixed values.
KEYWORDS = ("memory", "microcontroller", "processor", "system", "unknown")
HOUR = 3_600


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def field(tail, name: str) -> Column:
    return F.transform(_col(tail), lambda row: row[name])


def n_distinct(values: Column) -> Column:
    return F.size(F.array_distinct(F.array_compact(values)))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(F.transform(values, lambda x: x.cast("double"))) / F.size(values))


def _central(values: Column, power: int) -> Column:
    """Mean of the given power of the distance to the mean."""
    return let(_mean(values), lambda mean: _mean(
        F.transform(values, lambda x: F.pow(x - mean, F.lit(float(power))))))


def _std(values: Column) -> Column:
    return F.sqrt(_central(values, 2))


def _skewness(values: Column) -> Column:
    spread = _central(values, 2)
    return F.when(spread > 0, _central(values, 3) / F.pow(spread, F.lit(1.5)))


def _kurtosis(values: Column) -> Column:
    spread = _central(values, 2)
    return F.when(spread > 0, _central(values, 4) / (spread * spread) - 3)


def _from_end(values: Column, k: int) -> Column:
    """k-th entry counted from the end (1 is the last); null if there is none."""
    return F.when(F.size(values) >= k, F.get(values, F.size(values) - k))


def _parts(messages: Column, n: int) -> Column:
    return F.transform(messages, lambda text: safe_split(text, n))


def statistics(t20, t50, suffix: str = "tail20") -> list[Column]:
    """Counts of rows, messages, templates and message parts, and their shares.

    ``processor_nunique`` counts the messages that do *not* start with
    ``processor``; the name is kept.
    """
    t20, t50 = _col(t20), _col(t50)
    n20, n50 = F.size(t20), F.size(t50)
    msg20, msg50 = n_distinct(field(t20, "msg_id")), n_distinct(field(t50, "msg_id"))
    tpl20, tpl50 = n_distinct(field(t20, "template_id")), n_distinct(field(t50, "template_id"))
    others = F.filter(t20, lambda row: ~row["msg_lower"].startswith("processor"))
    parts = [n_distinct(_parts(field(t20, "msg_lower"), i)) for i in range(3)]
    columns = {
        "cnt": n20, "percent": ratio_or_zero(n20, n50),
        "msg_nunique": msg20, "template_nunique": tpl20,
        "msg_percent": ratio_or_zero(msg20, n20), "template_percent": ratio_or_zero(tpl20, n20),
        "template_to_msg_percent": ratio_or_zero(tpl20, msg20),
        "msg_to_msg_percent": ratio_or_zero(msg20, msg50),
        "template_to_template_percent": ratio_or_zero(tpl20, tpl50),
        "processor_nunique": n_distinct(field(others, "msg_id")),
    }
    for i, count in enumerate(parts):
        columns[f"msg_split_{i}_nunique"] = count
    for i, count in enumerate(parts):
        columns[f"msg_split_{i}_percent"] = ratio_or_zero(count, n20)
    return [expr.alias(f"{name}_{suffix}") for name, expr in columns.items()]


def ages(tail, fault_ts="fault_ts") -> Column:
    """Seconds from each row to the fault, oldest row first."""
    return F.transform(_col(tail), lambda row: _col(fault_ts) - row["time_ts"])


def differences(values: Column) -> Column:
    """Each entry less the one before it; one shorter than the input."""
    return F.when(F.size(values) > 1, F.transform(
        F.sequence(F.lit(1), F.size(values) - 1),
        lambda i: F.get(values, i) - F.get(values, i - 1))).otherwise(F.array().cast("array<bigint>"))


def gaps(tail) -> Column:
    """Seconds between neighbouring rows."""
    return differences(field(tail, "time_ts"))


def age_features(age, suffix: str = "tail20") -> list[Column]:
    """Age of the oldest, newest, 5th and 10th newest row, mean and spread."""
    age = _col(age)
    return [
        F.get(age, F.lit(0)).alias(f"first_time_span_{suffix}"),
        _from_end(age, 1).alias(f"second_span0_{suffix}"),
        _from_end(age, 5).alias(f"second_span5_{suffix}"),
        _from_end(age, 10).alias(f"second_span10_{suffix}"),
        _mean(age).alias(f"second_span_mean_{suffix}"),
    ]


def age_spread(age, suffix: str = "tail20") -> list[Column]:
    age = _col(age)
    return [_std(age).alias(f"second_span_std_{suffix}"),
            _kurtosis(age).alias(f"second_span_kurtosis_{suffix}"),
            _skewness(age).alias(f"second_span_skew_{suffix}")]


def gap_features(gap, suffix: str = "tail20") -> list[Column]:
    gap = _col(gap)
    return [_mean(gap).alias(f"time_diffs_avg_{suffix}"),
            F.array_max(gap).alias(f"time_diffs_max_{suffix}"),
            F.array_min(gap).alias(f"time_diffs_min_{suffix}"),
            _std(gap).alias(f"time_diffs_std_{suffix}")]


def gap_shape(gap, suffix: str = "tail20") -> list[Column]:
    gap = _col(gap)
    return [_kurtosis(gap).alias(f"time_diffs_kurtosis_{suffix}"),
            _skewness(gap).alias(f"time_diffs_skew_{suffix}")]


def span_features(age, suffix: str = "tail20") -> list[Column]:
    """Newest minus oldest time, and that over the age of the oldest row."""
    age = _col(age)
    span = F.get(age, F.lit(0)) - _from_end(age, 1)
    return [span.alias(f"max_time_diff_{suffix}"),
            ratio_or_null(span, F.get(age, F.lit(0))).alias(f"max_time_diff_div_first_time_span_{suffix}")]


def top_values(tail, name: str, prefix: str, k: int = 3, numeric: bool = True) -> list[Column]:
    """The ``k`` most frequent values and their shares of the tail.

    Equal counts: the larger id first (as a number where it is one).
    """
    tail = _col(tail)
    values = field(tail, name)
    counted = F.sort_array(F.transform(F.array_distinct(values), lambda v: F.struct(
        F.size(F.filter(values, lambda x: x == v)).alias("n"),
        (v if numeric else v.try_cast("bigint")).alias("order"),
        v.cast("string").alias("value"))), asc=False)
    out = []
    for i in range(k):
        entry = F.get(counted, F.lit(i))
        out += [F.coalesce(entry["value"], F.lit("NULL")).alias(f"{prefix}_appearance_{i + 1}"),
                F.coalesce(entry["n"] / F.size(tail), F.lit(0.0)).alias(f"{prefix}_appearance_{i + 1}_percent")]
    return out


def longest_run(tail, mode: str = "reference", name: str = "msg_id") -> list[Column]:
    """Longest stretch of one message.

    ``reference``: a run of one row counts 0, and the message returned is the
    last one of the tail. ``strict``: the true length, and the message of the
    (first) longest run.
    """
    values = field(tail, name)
    none = F.lit(None).cast("bigint")
    start = F.struct(none.alias("value"), F.lit(0).alias("run"), F.lit(0).alias("best"), none.alias("best_value"))
    shortest = 2 if mode == "reference" else 1

    def step(state, value):
        run = F.when(state["value"] == value, state["run"] + 1).otherwise(F.lit(1))
        longer = (run >= shortest) & (run > state["best"])
        return F.struct(value.cast("bigint").alias("value"), run.alias("run"),
                        F.when(longer, run).otherwise(state["best"]).alias("best"),
                        F.when(longer, value.cast("bigint")).otherwise(state["best_value"]).alias("best_value"))

    state = F.aggregate(values, start, step)
    message = state["value"] if mode == "reference" else state["best_value"]
    return [F.coalesce(message.cast("string"), F.lit("NULL")).alias("max_continuous_msg"),
            state["best"].alias("max_continuous_time")]


def last_ids(tail) -> list[Column]:
    """Last message and template id as strings, ``'NULL'`` without logs."""
    tail = _col(tail)
    last = F.get(tail, F.size(tail) - 1)
    return [F.coalesce(last["msg_id"].cast("string"), F.lit("NULL")).alias("last_msg_id"),
            F.coalesce(last["template_id"].cast("string"), F.lit("NULL")).alias("last_template_id")]


def last_template_frequency(tail) -> list[Column]:
    """Rows of the tail with the last row's template, and their share."""
    tail = _col(tail)
    values = field(tail, "template_id")
    last = F.get(values, F.size(values) - 1)
    count = F.when(F.size(tail) > 0, F.size(F.filter(values, lambda v: v == last)))
    return [count.alias("last_template_cnt"),
            ratio_or_null(count, F.size(tail)).alias("last_template_percent")]


def _rows_starting(tail, word: str) -> Column:
    return F.filter(_col(tail), lambda row: row["msg_lower"].startswith(word))


def keyword_spans(tail, fault_ts="fault_ts", keywords=KEYWORDS) -> list[Column]:
    """Seconds from the last row that starts with the keyword, and the mean."""
    out = []
    for word in keywords:
        hits = ages(_rows_starting(tail, word), fault_ts)
        out += [_from_end(hits, 1).alias(f"{word}_span_time"), _mean(hits).alias(f"{word}_mean_span_time")]
    return out


def text_measures(tail) -> list[Column]:
    """Words and letters of the tail's text, per row and per word."""
    tail = _col(tail)
    tokens = F.flatten(F.transform(tail, lambda row: words(row["msg_lower"])))
    letters = F.aggregate(F.transform(tokens, lambda t: F.length(t)), F.lit(0), lambda a, x: a + x)
    return [F.size(tokens).alias("total_word_cnt"),
            ratio_or_null(F.size(tokens), F.size(tail)).alias("mean_word_cnt_per_sentence"),
            ratio_or_null(letters, F.size(tail)).alias("mean_alphabet_cnt_per_sentence"),
            ratio_or_null(letters, F.size(tokens)).alias("mean_alphabet_cnt_per_word")]


# --- features of the gap sequence -------------------------------------------

def abs_energy(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v * v))


def _occurrences(values: Column, wanted) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted))


def benford_correlation(x: Column) -> Column:
    """Pearson correlation of leading-digit shares with Benford's law."""
    digits = F.transform(x, lambda v: F.substring(F.abs(v).cast("string"), 1, 1))
    shares = F.array(*[_occurrences(digits, str(k)) / F.size(x) for k in range(1, 10)])
    law = F.array(*[F.lit(math.log10(1 + 1 / k)) for k in range(1, 10)])
    return F.when(F.size(x) > 0, pearson(shares, law))


def count_above(x: Column, limit: int = HOUR) -> Column:
    return ratio_or_null(F.size(F.filter(x, lambda v: v >= limit)), F.size(x))


def count_above_mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, let(_mean(x), lambda mean: F.size(F.filter(x, lambda v: v > mean))))


def mean_abs_change(x: Column) -> Column:
    return _mean(F.transform(differences(x), lambda v: F.abs(v)))


def mean_change(x: Column) -> Column:
    return F.when(F.size(x) > 1, (_from_end(x, 1) - F.get(x, F.lit(0))) / (F.size(x) - 1))


def _repeats(x: Column) -> Column:
    return F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)))


def reoccurring_datapoints(x: Column) -> Column:
    repeated = F.aggregate(F.filter(_repeats(x), lambda c: c > 1), F.lit(0), lambda a, c: a + c)
    return ratio_or_null(repeated, F.size(x))


def reoccurring_values(x: Column) -> Column:
    return ratio_or_null(F.size(F.filter(_repeats(x), lambda c: c > 1)), F.size(F.array_distinct(x)))


def _close_pairs(x: Column, tolerance: Column, m: int) -> Column:
    """Ordered pairs of different positions whose ``m`` entries are all close."""
    positions = F.sequence(F.lit(0), F.size(x) - m)

    def close(i, j):
        test = F.abs(F.get(x, i) - F.get(x, j)) <= tolerance
        for k in range(1, m):
            test = test & (F.abs(F.get(x, i + k) - F.get(x, j + k)) <= tolerance)
        return test

    pairs = F.aggregate(positions, F.lit(0),
                        lambda acc, i: acc + F.size(F.filter(positions, lambda j: close(i, j))) - 1)
    return F.when(F.size(x) >= m, pairs).otherwise(F.lit(0))


def sample_entropy(x: Column, m: int = 2, r: float = 0.2) -> Column:
    """-ln(A / B), null when A or B is 0. Meant for the short gap lists of a tail."""
    def value(tolerance):
        longer, shorter = _close_pairs(x, tolerance, m + 1), _close_pairs(x, tolerance, m)
        return F.when((longer > 0) & (shorter > 0), -F.log(longer / shorter))
    return let(F.lit(r) * _std(x), value)


def gap_series(gap) -> list[Column]:
    """All sequence features of the gaps; null unless there is a gap."""
    x = _col(gap)
    return [
        abs_energy(x).alias("abs_energy"),
        benford_correlation(x).alias("benford_correlation"),
        count_above(x).alias("count_above"),
        count_above_mean(x).alias("count_above_mean"),
        mean_abs_change(x).alias("mean_abs_change"),
        mean_change(x).alias("mean_change"),
        reoccurring_datapoints(x).alias("percentage_of_reoccurring_datapoints_to_all_datapoints"),
        reoccurring_values(x).alias("percentage_of_reoccurring_values_to_all_values"),
        sample_entropy(x).alias("sample_entropy"),
    ]
