"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C, clock, measures as M
from ..sources import standin
from ..sources.readers import spread_scan
from .base import query

_SCORES = """
, scored AS (
  SELECT fault_id, label, [CAST((fault_id * 7) % 5 AS DOUBLE), (fault_id * 3) % 5, (fault_id * 11) % 5] AS p1,
         [CAST((fault_id * 13) % 7 AS DOUBLE), (fault_id * 5) % 7] AS p2 FROM faults)
"""


def scored_faults(spark, folder):
    """Faults with two made-up score vectors computed from the id."""
    i = F.col("fault_id")
    return standin.faults(spark, folder).select(
        "fault_id", "label",
        F.array(*[((i * a) % 5).cast("double") for a in (7, 3, 11)]).alias("p1"),
        F.array(*[((i * a) % 7).cast("double") for a in (13, 5)]).alias("p2"))


@query("c01_trim_lower", "SELECT row_id, msg_lower AS clean FROM plain_logs")
def trim_lower(spark, folder):
    padded = F.concat(F.lit(" \t"), F.upper("msg_lower"), F.lit("\n  "))
    return standin.logs(spark, folder).select("row_id", C.trim_lower(padded).alias("clean"))


# Raw message heads; each log row takes one of them by its id. Fixed values.
RAW_HEADS = (
    "A1 OEM record c0", "OEM record c0", "Temperature T1", "Memory DIMM071", "Fan F1", "Memory #0x11",
    "Drive Slot HDD3", "Drive Slot Disk4", "Drive Slot / Bay HDD1", "Drive Slot / Bay Disk2",
    "Drive Slot / Bay NVMeSSD9", "Drive Slot / Bay BP1", "Drive Slot / Bay Rear2", "Drive Slot / Bay Front7",
    "Drive Slot / Bay #0x81", "Power Supply PS1", "Drive Slot Front3", "Processor #0xfa", "Memory CPU0_C1",
    "Memory CPU1_D0", "Drive Slot #04", "Memory Mem_Ch2", "Power Supply #01", "System_Boot")
# Raw message ends: no part, one, two or three more parts. Fixed values.
RAW_ENDS = ("", " | Upper_Limit", " | Upper | Reading 80", " | Upper | Asserted | 80", " | Upper | Reading 80 | x")


def raw_messages(spark, folder):
    i = F.col("row_id")
    return spread_scan(standin.logs(spark, folder)).select("row_id", F.concat(
        F.get(F.array(*[F.lit(h) for h in RAW_HEADS]), (i % len(RAW_HEADS)).cast("int")),
        F.get(F.array(*[F.lit(e) for e in RAW_ENDS]), (F.floor(i / len(RAW_HEADS)) % len(RAW_ENDS)).cast("int")))
        .alias("msg"))


_RAW_SQL = """
, raw AS (SELECT row_id, lower([{heads}][CAST(row_id % {h} AS INTEGER) + 1] ||
                               [{ends}][CAST((row_id // {h}) % {e} AS INTEGER) + 1]) AS m FROM plain_logs),
p AS (SELECT row_id, m, string_split(m, ' | ') AS s FROM raw),
oem AS (SELECT row_id,
  CASE WHEN position('oem record' IN m) > 1 THEN 'hex | oem record hex | seq'
       WHEN m LIKE 'oem record%' AND len(s) > 1 THEN 'oem record | ' || s[2] || ' | seq'
       WHEN m LIKE 'temperature%' AND len(s) = 4 THEN s[1] || ' | ' || s[2] || ' | ' || s[3]
       WHEN m LIKE 'fan%' AND len(s) = 4 THEN 'fan | ' || s[2] || ' | ' || s[3]
       WHEN m LIKE 'memory dimm%' THEN 'memory dimm | ' || rest
       WHEN m LIKE 'memory #0x%' THEN 'memory hex | ' || rest
       WHEN regexp_matches(m, '^drive slot (/ bay )?(hdd|disk|nvmessd|bp|rear|front)') THEN
            regexp_extract(m, '^drive slot (/ bay )?(hdd|disk|nvmessd|bp|rear|front)') || ' | ' || rest
       WHEN m LIKE 'drive slot / bay #0x%' THEN 'drive slot / bay hex | ' || rest
       WHEN m LIKE 'power supply ps%' THEN 'power supply ps | ' || rest
       WHEN m LIKE 'processor #0x%' THEN 'processor hex | ' || rest
       WHEN regexp_matches(m, '^memory cpu[01]_') THEN substr(m, 1, 12) || 'hex | ' || rest
       WHEN m LIKE 'drive slot #0%' THEN 'drive slot hex | ' || rest
       WHEN regexp_matches(m, '^memory mem_ch') THEN 'memory mem_ch | ' || rest
       WHEN m LIKE 'power supply #0%' THEN 'power supply hex | ' || rest
       ELSE m END AS m
  FROM (SELECT *, array_to_string(s[2:], ' | ') AS rest FROM p)),
q AS (SELECT row_id, m, string_split(m, ' | ') AS s FROM oem)
SELECT row_id, replace(CASE
    WHEN m LIKE 'temperature%' AND s[3] LIKE 'reading%' THEN s[1] || ' | ' || s[2] || ' | seq'
    WHEN m LIKE 'fan%' AND s[3] LIKE 'reading%' THEN 'fan | ' || s[2] || ' | seq'
    ELSE m END, '_', ' ') AS msg_lower FROM q
""".format(heads=", ".join(f"'{h}'" for h in RAW_HEADS), ends=", ".join(f"'{e}'" for e in RAW_ENDS),
           h=len(RAW_HEADS), e=len(RAW_ENDS))


@query("c02_normalise", _RAW_SQL)
def normalise(spark, folder):
    return C.normalise_messages(raw_messages(spark, folder)).select("row_id", "msg_lower")


@query("c03_mask", """
SELECT row_id, 'dev <:ID:> at <:IP:> seq <:SEQ:>; raw <:SEQ:>; reg <:HEX:> n <:NUM:> x' || (row_id % 10)
    || ' executed cmd <:CMD:>' AS masked FROM plain_logs""")
def mask(spark, folder):
    i = F.col("row_id")
    two = F.lpad((i % 90 + 10).cast("string"), 2, "0")
    message = F.concat(
        F.lit("dev a0:b1:c2:"), two, F.lit(" at 10.0."), (i % 200).cast("string"), F.lit(".7 seq abcdef "),
        F.lpad((i % 1000000).cast("string"), 6, "0"), F.lit(" 00ff00; raw "),
        F.lpad((i % 10000).cast("string"), 4, "0"), F.lit(" ABCD 0011 EF01; reg 0x"), F.lower(F.hex(i)),
        F.lit(" n -"), i.cast("string"), F.lit(" x"), (i % 10).cast("string"),
        F.lit(' executed cmd "run '), i.cast("string"), F.lit('"'))
    return spread_scan(standin.logs(spark, folder)).select("row_id", C.mask(message).alias("masked"))


@query("c04_safe_split", """
SELECT row_id, trim(split_part(msg_lower, '|', 1)) AS p0, trim(split_part(msg_lower, '|', 2)) AS p1,
       trim(split_part(msg_lower, '|', 3)) AS p2, trim(split_part(msg_lower, '|', 4)) AS p3 FROM plain_logs""")
def safe_split(spark, folder):
    return standin.logs(spark, folder).select(
        "row_id", *[C.safe_split("msg_lower", n).alias(f"p{n}") for n in range(4)])


@query("c05_parse_timestamp", "SELECT row_id, epoch_us(time) AS time_us FROM plain_logs")
def parse_timestamp(spark, folder):
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return standin.logs(spark, folder).select("row_id", F.unix_micros(clock.parse_time(text)).alias("time_us"))


@query("c06_epoch_seconds", "SELECT row_id, time_ts AS seconds FROM plain_logs")
def epoch_seconds(spark, folder):
    return standin.logs(spark, folder).select("row_id", clock.epoch_seconds("time").alias("seconds"))


@query("c07_ceil_bucket", """
SELECT row_id, CAST(ceil(epoch_us(time) / 1800000000.0) * 1800 AS BIGINT) AS half_hour,
       CAST(ceil(epoch_us(time) / 7200000000.0) * 7200 AS BIGINT) AS two_hours FROM plain_logs""")
def ceil_bucket(spark, folder):
    return standin.logs(spark, folder).select(
        "row_id", F.unix_timestamp(clock.ceil_to_bucket("time", 1800)).alias("half_hour"),
        F.unix_timestamp(clock.ceil_to_bucket("time", 7200)).alias("two_hours"))


@query("c08_hour_weekday", """
SELECT fault_id, CAST(date_part('hour', fault_time) AS BIGINT) AS hour,
       CAST(date_part('isodow', fault_time) - 1 AS BIGINT) AS weekday FROM faults""")
def hour_weekday(spark, folder):
    return standin.faults(spark, folder).select(
        "fault_id", clock.hour_of_day("fault_time").cast("bigint").alias("hour"),
        clock.day_of_week("fault_time").cast("bigint").alias("weekday"))


@query("c09_first_word", """
SELECT row_id, split_part(msg_lower, ' ', 1) AS category FROM plain_logs""")
def first_word(spark, folder):
    return standin.logs(spark, folder).select("row_id", C.first_word("msg_lower").alias("category"))


@query("c10_prefix_predicate", """
SELECT row_id, starts_with(msg_lower, 'error') AS is_error,
       NOT starts_with(msg_lower, 'view') AND NOT starts_with(msg_lower, 'click') AS is_other FROM plain_logs""")
def prefix_predicate(spark, folder):
    msg = F.col("msg_lower")
    return standin.logs(spark, folder).select(
        "row_id", msg.startswith("error").alias("is_error"),
        (~msg.startswith("view") & ~msg.startswith("click")).alias("is_other"))


@query("c11_safe_ratio", """
SELECT row_id, round(CASE WHEN row_id % 7 > 0 THEN time_ts % 101 / (row_id % 7) ELSE 0 END, 6) AS or_zero,
       round(CASE WHEN row_id % 7 > 0 THEN time_ts % 101 / (row_id % 7) END, 6) AS or_null FROM plain_logs""")
def safe_ratio(spark, folder):
    a, b = F.col("time_ts") % 101, F.col("row_id") % 7
    return standin.logs(spark, folder).select(
        "row_id", F.round(M.ratio_or_zero(a, b), 6).alias("or_zero"),
        F.round(M.ratio_or_null(a, b), 6).alias("or_null"))


@query("c12_list_length", "SELECT row_id, CAST(row_id % 3 + 1 AS BIGINT) AS modules FROM venus")
def list_length(spark, folder):
    return standin.venus(spark, folder).select(
        "row_id", C.list_length("module").cast("bigint").alias("modules"))


@query("c13_prefix_words", """
SELECT row_id, array_to_string(list_transform(string_split(msg_lower, ' '),
       lambda t: server_model || '_' || t), ' ') AS words FROM plain_logs""")
def prefix_words(spark, folder):
    return standin.logs(spark, folder).select(
        "row_id", F.array_join(C.prefix_words("msg_lower", F.upper("server_model")), " ").alias("words"))


@query("c15_equal_width_bins", """
, x AS (SELECT event_id, value, (SELECT min(value) FROM ev) AS lo, (SELECT max(value) FROM ev) AS hi FROM ev)
SELECT event_id, CAST(CASE WHEN value <= lo THEN 0 ELSE
   least(9, greatest(0, ceil((value - lo) / ((hi - lo) / 10)) - 1)) END AS BIGINT) AS bin FROM x""")
def equal_width_bins(spark, folder):
    ev = standin.events(spark, folder)
    edges = ev.agg(F.min("value").alias("low"), F.max("value").alias("high"))  # one row
    return ev.crossJoin(F.broadcast(edges)).select(
        "event_id", M.equal_width_bin("value", "low", "high").cast("bigint").alias("bin"))


@query("c16_label_remap", """
SELECT fault_id, CASE label WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS stage_one FROM faults""")
def label_remap(spark, folder):
    return standin.faults(spark, folder).select("fault_id", M.stage_one_label("label").alias("stage_one"))


@query("c17_argmax", _SCORES + """
SELECT fault_id, CAST(CASE WHEN p1[1] >= p1[2] AND p1[1] >= p1[3] THEN 0 WHEN p1[2] >= p1[3] THEN 1 ELSE 2 END
       AS BIGINT) AS top FROM scored""")
def argmax(spark, folder):
    return scored_faults(spark, folder).select("fault_id", M.argmax("p1").cast("bigint").alias("top"))
