from pyspark.sql import functions as F

from logfault.functions import cleaning as C, clock, measures as M

NORMALISED = [
    ("A1 OEM record c0 | 00", "hex | oem record hex | seq"),
    ("OEM record c0 | 0012 | 77", "oem record | 0012 | seq"),
    ("OEM record c0", "oem record c0"),
    ("Temperature T1 | Upper | Asserted | 80", "temperature t1 | upper | asserted"),
    ("Temperature T1 | Upper | Reading 80", "temperature t1 | upper | seq"),
    ("Temperature T1 | Upper | Reading 80 | x", "temperature t1 | upper | seq"),
    ("Temperature T1", "temperature t1"),
    ("Memory DIMM071 | ECC | Asserted", "memory dimm | ecc | asserted"),
    ("Memory DIMM071", "memory dimm | "),
    ("Fan F1 | Low | Asserted | 5", "fan | low | asserted"),
    ("Fan F1 | Low | Reading 5", "fan | low | seq"),
    ("Fan F1 | Low", "fan f1 | low"),
    ("Memory #0x11 | ECC", "memory hex | ecc"),
    ("Drive Slot HDD1 | Present", "drive slot hdd | present"),
    ("Drive Slot Disk1 | Present", "drive slot disk | present"),
    ("Drive Slot / Bay HDD1 | Present", "drive slot / bay hdd | present"),
    ("Drive Slot / Bay Disk1 | Present", "drive slot / bay disk | present"),
    ("Drive Slot / Bay NVMeSSD1 | Present", "drive slot / bay nvmessd | present"),
    ("Drive Slot / Bay BP1 | Present", "drive slot / bay bp | present"),
    ("Drive Slot / Bay Rear1 | Present", "drive slot / bay rear | present"),
    ("Drive Slot / Bay Front1 | Present", "drive slot / bay front | present"),
    ("Drive Slot / Bay #0x81 | Present", "drive slot / bay hex | present"),
    ("Power Supply PS1 | AC lost", "power supply ps | ac lost"),
    ("Drive Slot Front1 | Present", "drive slot front | present"),
    ("Processor #0xfa | IERR", "processor hex | ierr"),
    ("Memory CPU0_C1 | ECC", "memory cpu0 hex | ecc"),
    ("Memory CPU1_C1 | ECC", "memory cpu1 hex | ecc"),
    ("Drive Slot #04 | Present", "drive slot hex | present"),
    ("Memory Mem_Ch1 | ECC", "memory mem ch | ecc"),
    ("Power Supply #02 | Failed", "power supply hex | failed"),
    ("System_Boot | Done", "system boot | done"),
    (" \t Plain text \n", "plain text"),
]

MASKED = [
    ("dimm 1 2 -3 | x4", "dimm <:NUM:> <:NUM:> <:NUM:> | x4"),
    ("at 10.0.0.12 ok", "at <:IP:> ok"),
    ("mac a0:b1:c2:d3 up", "mac <:ID:> up"),
    ("reg 0xFF0a set", "reg <:HEX:> set"),
    ("seq abcdef 012345 fedcba; end", "seq <:SEQ:>; end"),
    ('executed cmd "ls" done', "executed cmd <:CMD:> done"),
]


def _apply(spark, rows, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, msg string, want string")
    return [(r["got"], r["want"]) for r in expr(df).orderBy("i").collect()]


def test_normaliser_rules(spark):
    for got, want in _apply(spark, NORMALISED, lambda df: C.normalise_messages(df, "msg", "got")):
        assert got == want


def test_other_dialect(spark):
    rounds = ((C.PrefixRule("disk", head="drive"),),)
    df = spark.createDataFrame([("disk7 | bad",), ("fan F1 | x | y | z",)], "msg string")
    got = {r["got"] for r in C.normalise_messages(df, "msg", "got", rounds).collect()}
    assert got == {"drive | bad", "fan f1 | x | y | z"}


def test_masks(spark):
    for got, want in _apply(spark, MASKED, lambda df: df.withColumn("got", C.mask("msg"))):
        assert got == want


def test_parts_words_grams(spark):
    df = spark.createDataFrame([("a | b |",)], "m string")
    row = df.select(*[C.safe_split("m", i).alias(f"p{i}") for i in range(4)],
                    C.words(F.lit("  x\t y ")).alias("w"),
                    C.ngrams(C.vectoriser_tokens(F.lit("Ab c de fg")), 1, 3).alias("g"),
                    C.ngrams(C.vectoriser_tokens(F.lit("a")), 1, 3).alias("none"),
                    C.value_counts(F.array(*[F.lit(x) for x in "baab"])).alias("v")).first()
    assert (row.p0, row.p1, row.p2, row.p3) == ("a", "b", "", "")
    assert row.w == ["x", "y"]
    assert row.g == ["ab", "de", "fg", "ab de", "de fg", "ab de fg"]
    assert row.none == []
    assert [(x["value"], x["n"]) for x in row.v] == [("a", 2), ("b", 2)]


def test_time_and_bins(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:30:00' AS a, timestamp'2024-01-01 00:30:00.000001' AS b")
    row = df.select(F.unix_timestamp(clock.ceil_to_bucket("a", 1800)).alias("x"),
                    F.unix_timestamp(clock.ceil_to_bucket("b", 1800)).alias("y"),
                    clock.epoch_seconds("a").alias("s"), clock.day_of_week("a").alias("d")).first()
    assert (row.x, row.y, row.d) == (row.s, row.s + 1800, 0)
    values = spark.createDataFrame([(float(x),) for x in (0, 1, 1.5, 5, 10)], "x double")
    assert [r[0] for r in values.select(M.equal_width_bin("x", 0.0, 10.0)).collect()] == [0, 0, 1, 4, 9]
