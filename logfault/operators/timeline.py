"""Point-in-time joins between faults and event logs.

Inputs: logs with ``sn, time, time_ts, row_id`` and any payload; moments with
``sn, fault_ts``. A log belongs to a moment when ``time_ts <= fault_ts`` in
whole seconds; rows are ordered by ``(time, row_id)``.

No step compares a moment with a server's history. Logs are counted per
second, the counts are summed along the time line in slots, and a moment's
rank then names its last rows by equality. A busy server is many slots, and a
busy second is cut to the rows a tail can reach before it is shuffled, so no
group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialise
from .ranking import last_per_group

SLOT_SECONDS = 1 << 19
MAX_BROADCAST_SERVERS = 500_000
MAX_BROADCAST_SECONDS = 1_000_000


def running_totals(logs: DataFrame, probes: DataFrame, measures: dict | None = None,
                   slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Totals along each server's time line.

    One row for each second that has logs or a probe (``sn, time_ts``):

    * ``n`` rows in the second, ``is_probe``
    * ``cum_n`` rows up to and including it, ``all_n`` rows of the server
    * ``cum_<measure>`` running sum of each extra measure (name to row value)
    * ``next_pos`` ``cum_n`` at the nearest probe from here on
    * ``next_log`` nearest second from here on that has logs

    A server's time is cut into slots. Rows are counted per second on the map
    side, a slot holds at most ``slot_seconds`` of these, and only one row per
    slot is ordered per server.
    """
    measures = {"n": F.lit(1), **(measures or {})}
    names = list(measures)
    points = (logs.select("sn", "time_ts", *[expr.alias(m) for m, expr in measures.items()],
                          F.lit(0).alias("is_probe"))
              .unionByName(probes.select("sn", "time_ts", *[F.lit(0).alias(m) for m in names],
                                         F.lit(1).alias("is_probe")))
              .withColumn("slot", F.floor(F.col("time_ts") / slot_seconds))
              .filter(F.col("sn").isNotNull() & F.col("slot").isNotNull())
              .groupBy("sn", "slot", "time_ts")
              .agg(*[F.sum(m).alias(m) for m in names], F.max("is_probe").alias("is_probe")))
    in_slot = Window.partitionBy("sn", "slot").orderBy("time_ts")
    so_far = in_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = in_slot.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    points = points.select("*", *[F.sum(m).over(so_far).alias(f"_in_{m}") for m in names])
    at_probe = F.when(F.col("is_probe") == 1, F.col("_in_n"))
    with_logs = F.when(F.col("n") > 0, F.col("time_ts"))

    of_server = Window.partitionBy("sn").orderBy("slot")
    before = of_server.rowsBetween(Window.unboundedPreceding, -1)
    after = of_server.rowsBetween(1, Window.unboundedFollowing)
    whole = of_server.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slots = (points.groupBy("sn", "slot")
             .agg(*[F.sum(m).alias(f"_sum_{m}") for m in names],
                  F.min(at_probe).alias("_probe"), F.min(with_logs).alias("_log"))
             .select("*", *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_start_{m}")
                            for m in names])
             .select("sn", "slot", *[f"_start_{m}" for m in names],
                     F.sum("_sum_n").over(whole).alias("all_n"),
                     F.min(F.col("_start_n") + F.col("_probe")).over(after).alias("_later_pos"),
                     F.min("_log").over(after).alias("_later_log")))
    return (points.select("*", F.min(at_probe).over(onward).alias("_next_in"),
                          F.min(with_logs).over(onward).alias("_next_log"))
            .join(slots, ["sn", "slot"])
            .select("sn", "time_ts", "n", "is_probe", "all_n",
                    *[(F.col(f"_start_{m}") + F.col(f"_in_{m}")).alias(f"cum_{m}") for m in names],
                    F.coalesce(F.col("_start_n") + F.col("_next_in"), "_later_pos").alias("next_pos"),
                    F.coalesce("_next_log", "_later_log").alias("next_log")))


def distinct_moments(faults: DataFrame) -> DataFrame:
    return faults.select("sn", "fault_ts").distinct()


def restrict_to_servers(logs: DataFrame, moments: DataFrame, until_last: bool = True) -> DataFrame:
    """Drop logs of servers without a moment and (``until_last``) logs after the last moment.

    Done at the scan by a broadcast when the counted number of servers is
    small; with more servers than that the logs are left as they are, which
    gives the same tails.
    """
    servers = moments.groupBy("sn").agg(F.max("fault_ts").alias("_last"))
    if len(servers.select("sn").limit(MAX_BROADCAST_SERVERS + 1).offset(MAX_BROADCAST_SERVERS).take(1)):
        return logs
    kept = logs.join(F.broadcast(servers), "sn")
    return (kept.filter(F.col("time_ts") <= F.col("_last")) if until_last else kept).drop("_last")


def _near_rows(logs: DataFrame, seconds: DataFrame, most: int) -> DataFrame:
    """Drop logs far from all ``seconds`` at the scan.

    The seconds are rounded until at most ``most`` of them are left, so what
    is broadcast has a bound at every size; rows kept too many go in the join
    that follows.
    """
    for step in (1, 1 << 6, 1 << 12, 1 << 18):
        rounded = seconds.select("sn", F.floor(F.col("time_ts") / step).alias("_near")).distinct()
        if not rounded.limit(most + 1).offset(most).take(1):
            return (logs.withColumn("_near", F.floor(F.col("time_ts") / step))
                    .join(F.broadcast(rounded), ["sn", "_near"], "left_semi").drop("_near"))
    return logs


def _as_probes(moments: DataFrame) -> DataFrame:
    return moments.select("sn", F.col("fault_ts").alias("time_ts"))


def tail_arrays(logs: DataFrame, faults: DataFrame, n: int = 50, payload=None,
                prefilter: bool = True, slot_seconds: int = SLOT_SECONDS,
                max_broadcast: int = MAX_BROADCAST_SECONDS, horizon: int | None = None) -> DataFrame:
    """Faults with their last ``n`` logs as an array, oldest first.

    Adds ``pos`` (all logs up to the fault) and ``tail``; every fault is kept
    and a fault without logs has an empty array. With ``horizon`` a tail only
    holds rows of the so many seconds up to the fault, both ends included;
    ``pos`` still counts all. Two passes over the log:

    1. Narrow: rows per second and their running totals. What is kept is a
       small table: ``pos`` of each moment, and the seconds that lie within
       the last ``n`` rows of some moment. It is written to shared storage,
       so both uses read one result.
    2. Wide: the rows of these seconds, at most ``n`` each, get their rank on
       the server's time line and are gathered in blocks of ``n`` ranks, each
       with the ``n`` ranks before it. A moment then finds its whole tail in
       the one block that holds ``pos``.
    """
    payload = [c for c in logs.columns if c != "sn"] if payload is None else list(payload)
    needed = list(dict.fromkeys(["time_ts", "time", "row_id"] + payload))
    logs = logs.select("sn", *needed)
    moments = distinct_moments(faults)
    if prefilter:
        logs = restrict_to_servers(logs, moments)
    near = (F.col("n") > 0) & (F.col("next_pos") - n < F.col("cum_n"))
    line = materialise(
        running_totals(logs, _as_probes(moments), slot_seconds=slot_seconds)
        .select("sn", "time_ts", "cum_n", (F.col("is_probe") == 1).alias("is_probe"),
                F.coalesce(near, F.lit(False)).alias("near"))
        .filter(F.col("is_probe") | F.col("near")), "timeline")
    positions = line.filter("is_probe").select("sn", F.col("time_ts").alias("fault_ts"), F.col("cum_n").alias("pos"))
    seconds = line.filter("near").select("sn", "time_ts", "cum_n")

    newest_first = [F.col("time").desc(), F.col("row_id").desc()]
    if seconds.count() <= max_broadcast:
        rows = last_per_group(logs.join(F.broadcast(seconds), ["sn", "time_ts"]),
                              ["sn", "time_ts"], newest_first, n, "_age")
    else:
        near_logs = _near_rows(logs, seconds, max_broadcast)
        rows = last_per_group(near_logs, ["sn", "time_ts"], newest_first, n, "_age").join(seconds, ["sn", "time_ts"])
    rank = F.col("cum_n") - F.col("_age") + 1
    blocks = (rows.select("sn", rank.alias("rank"), *needed)
              .withColumn("block", F.explode(F.sequence(F.floor((F.col("rank") - 1) / n),
                                                        F.floor((F.col("rank") + n - 2) / n))))
              .groupBy("sn", "block")
              .agg(F.sort_array(F.collect_list(F.struct("rank", *needed))).alias("rows")))
    asked = (faults.drop("pos", "tail").join(positions, ["sn", "fault_ts"], "left")
             .withColumn("pos", F.coalesce("pos", F.lit(0)))
             .withColumn("block", F.floor((F.col("pos") - 1) / n)))
    def near_fault(row):
        return F.lit(True) if horizon is None else F.col("fault_ts") - row["time_ts"] <= horizon

    tail = F.filter("rows", lambda row: (row["rank"] <= F.col("pos")) & (row["rank"] > F.col("pos") - n) & near_fault(row))
    return (asked.join(blocks, ["sn", "block"], "left")
            .withColumn("tail", F.coalesce(tail, F.array().cast(blocks.schema["rows"].dataType)))
            .drop("block", "rows"))


def tail_rows(logs: DataFrame, faults: DataFrame, n: int, payload=None, **options) -> DataFrame:
    """The last ``n`` logs of each fault as rows.

    Adds ``pos``, the log columns and ``back`` (1 is the newest); a fault
    without logs gives no row.
    """
    tails = tail_arrays(logs, faults, n, payload, **options)
    kept = tails.columns[:-1]
    return (tails.select(*kept, F.inline("tail"))
            .withColumn("back", F.col("pos") - F.col("rank") + 1).drop("rank"))


def last_n(tail, n: int):
    """Last ``n`` entries of an array, or all if it is shorter."""
    tail = F.col(tail) if isinstance(tail, str) else tail
    return F.slice(tail, F.greatest(F.lit(1), F.size(tail) - (n - 1)), F.lit(n))


def window_totals(logs: DataFrame, faults: DataFrame, spans: dict[str, int],
                  measures: dict | None = None, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Sums over ``fault_ts - span <= time_ts <= fault_ts``, both ends included.

    For each span ``name`` adds ``<name>_n`` and ``<name>_<measure>``, and
    ``pos`` for the total over all earlier logs. Differences of running
    totals, so the cost does not depend on how many logs a window holds.
    ``measures`` maps a name to the value of a row; integers or decimals if
    exact zeros matter.
    """
    names = ["n", *(measures or {})]
    moments = distinct_moments(faults)
    logs = restrict_to_servers(logs, moments)
    edges = {"_now": 0, **{name: -span - 1 for name, span in spans.items()}}
    points = moments.select("sn", "fault_ts", F.explode(F.array(*[
        F.struct(F.lit(name).alias("edge"), (F.col("fault_ts") + shift).alias("time_ts"))
        for name, shift in edges.items()])).alias("p")).select("sn", "fault_ts", "p.edge", "p.time_ts")
    line = running_totals(logs, points.select("sn", "time_ts"), measures, slot_seconds)
    found = points.join(line.filter(F.col("is_probe") == 1)
                        .select("sn", "time_ts", *[f"cum_{m}" for m in names]), ["sn", "time_ts"])

    def at(edge, m):
        return F.max(F.when(F.col("edge") == edge, F.col(f"cum_{m}")))

    columns = [at("_now", "n").alias("pos")]
    for name in spans:
        columns += [(at("_now", m) - at(name, m)).alias(f"{name}_{m}") for m in names]
    totals = found.groupBy("sn", "fault_ts").agg(*columns)
    return faults.drop("pos").join(totals, ["sn", "fault_ts"], "left")


def recent_count(events: DataFrame, faults: DataFrame, seconds: int, out: str) -> DataFrame:
    """Events of the same server in the ``seconds`` up to the fault; 0 if none."""
    counted = window_totals(events, faults, {"w": seconds})
    return counted.withColumn(out, F.coalesce("w_n", F.lit(0))).drop("w_n", "pos")


def latest_within(events: DataFrame, faults: DataFrame, seconds: int, payload) -> DataFrame:
    """The newest event up to the fault if it is at most ``seconds`` old, as
    the struct ``latest`` (null otherwise)."""
    tails = tail_arrays(events, faults, 1, payload)
    entry = F.get("tail", F.lit(0))
    return (tails.withColumn("latest", F.when(F.col("fault_ts") - entry["time_ts"] <= seconds, entry))
            .drop("tail", "pos"))


def look_ahead(logs: DataFrame, faults: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Logs at or after the fault: ``post_cnt`` and seconds to the first one
    (``post_span``, 0 if there is none)."""
    logs = restrict_to_servers(logs, distinct_moments(faults), until_last=False)
    line = running_totals(logs, _as_probes(faults), slot_seconds=slot_seconds)
    found = (line.filter(F.col("is_probe") == 1)
             .select("sn", F.col("time_ts").alias("fault_ts"),
                     (F.col("all_n") - F.col("cum_n") + F.col("n")).alias("post_cnt"),
                     (F.col("next_log") - F.col("time_ts")).alias("post_span")))
    return (faults.join(found, ["sn", "fault_ts"], "left")
            .fillna({"post_cnt": 0, "post_span": 0}))


RADIX = 8
LEVELS = 12
#: Block sizes made from one list.
LEVELS_AT_ONCE = 6


def _blocks_before(end, level: int):
    """The blocks of one size in the cover of all seconds before ``end``."""
    size = RADIX ** level
    digit = F.pmod(F.floor(end / size), F.lit(RADIX))
    first = F.floor(end / (size * RADIX)) * RADIX
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(RADIX - 2)), lambda j: j < digit),
                       lambda j: F.struct(F.lit(level).alias("level"), (first + j).alias("block")))


def _newest_by_block(logs: DataFrame, n: int) -> DataFrame:
    """``sn, level, block, row_id, time_ts``: the ``n`` newest arrivals of each block of each size.

    Rolled up: a few sizes at a time come from the cut lists of the largest
    block before them, so a busy server is a few rows after the first step.
    """
    newest = [F.col("row_id").desc()]
    cut = last_per_group(logs.select("sn", "time_ts", "row_id"), ["sn", "time_ts"], newest, n).drop("age_rank")
    lists = materialise(cut.select("sn", F.lit(0).alias("level"), F.col("time_ts").cast("long").alias("block"), "row_id", "time_ts"),
                        "blocks")
    found = [lists]
    for low in range(1, LEVELS, LEVELS_AT_ONCE):
        sizes = range(low, min(low + LEVELS_AT_ONCE, LEVELS))
        sized = F.explode(F.array(*[F.struct(F.lit(level).alias("level"),
                                             F.floor(F.col("time_ts") / RADIX ** level).alias("block"))
                                    for level in sizes]))
        lists = (lists.select("sn", "row_id", "time_ts", sized.alias("b"))
                 .select("sn", "b.level", "b.block", "row_id", "time_ts"))
        lists = materialise(last_per_group(lists, ["sn", "level", "block"], newest, n).drop("age_rank"), "blocks")
        found.append(lists)
        lists = lists.filter(F.col("level") == sizes[-1])
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def tail_by_arrival(logs: DataFrame, faults: DataFrame, n: int, payload) -> DataFrame:
    """Of the logs up to the fault second, the ``n`` that arrived last.

    Arrival order and time order may differ, so ranks on the timeline do not
    answer this. Time is cut into blocks of 1, 8, 64, ... seconds; each block
    keeps its ``n`` newest arrivals, and the time before a fault is a union of
    at most 7 blocks of each size. Only row ids move until the rows are known;
    the ``payload`` is joined to these at the end. One row per fault and log;
    faults without logs give none.
    """
    newest = F.col("row_id").desc()
    logs = restrict_to_servers(logs, distinct_moments(faults))
    cover = F.concat(*[_blocks_before(F.col("fault_ts") + 1, level) for level in range(LEVELS)])
    moments = (distinct_moments(faults).select("sn", "fault_ts", F.explode(cover).alias("c"))
               .select("sn", "fault_ts", "c.level", "c.block"))
    found = moments.join(_newest_by_block(logs, n), ["sn", "level", "block"])
    kept = last_per_group(found, ["sn", "fault_ts"], [newest], n, "back").drop("level", "block")
    if not payload:
        return faults.join(kept.drop("time_ts"), ["sn", "fault_ts"])
    kept = materialise(kept, "arrivals")
    near = _near_rows(logs.select("sn", "time_ts", "row_id", *payload), kept.select("sn", "time_ts"), MAX_BROADCAST_SECONDS)
    rows = kept.join(near, ["sn", "time_ts", "row_id"]).select("sn", "fault_ts", "row_id", *payload, "back")
    return faults.join(rows, ["sn", "fault_ts"])
