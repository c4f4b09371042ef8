"""CSV quoting, stages from files, arrival order."""

import datetime

from logfault.sources import readers as R, schemas


def test_quotes_commas_and_line_breaks(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('sn,time,msg,server_model\n'
                    's1,2020-01-01 00:00:00,"executed cmd ""run a, b"" | done",sm1\n'
                    's2,2020-01-01 00:00:01,"two\nlines",sm2\n')
    rows = R.read_csv(spark, str(path), schemas.SYSTEM_LOG, multi_line=True).orderBy("sn").collect()
    assert [(r.msg, r.server_model) for r in rows] == [('executed cmd "run a, b" | done', "sm1"), ("two\nlines", "sm2")]


def test_written_csv_reads_back(spark, tmp_path):
    rows = [("s1", datetime.datetime(2020, 1, 1), 'a "b", c\\', "m"), ("s2", datetime.datetime(2020, 1, 2), "x\ny", "n")]
    df = spark.createDataFrame(rows, schemas.SYSTEM_LOG)
    R.write_table(df, str(tmp_path / "out"), "csv")
    back = R.read_csv(spark, str(tmp_path / "out"), schemas.SYSTEM_LOG, multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"a ""b"", c\\"' in text


def test_stage_from_files(spark, tmp_path):
    for n, name in enumerate(R.stage_sources("final_a")["logs"]):
        folder = tmp_path / ("final" if name.startswith("final_") else "first")
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.csv").write_text("sn,time,msg,server_model\n" + "".join(
            f"s{n},2020-01-0{d} 00:00:00,m{d},sm\n" for d in (2, 1)))
    log = R.read_stage(spark, str(tmp_path / "first"), "final_a", "logs", str(tmp_path / "final"))
    rows = log.collect()
    assert len(rows) == 8 and len({r.row_id for r in rows}) == 8
    for n in range(4):  # the arrival number follows the file
        assert [r.msg for r in sorted((r for r in rows if r.sn == f"s{n}"), key=lambda r: r.row_id)] == ["m2", "m1"]


def test_arrival_follows_source_file_and_line(spark, tmp_path):
    """Files of unequal size, many splits, several files per task: ids ascend by source, path and line."""
    sizes = {"a": {"p1": 10, "p2": 3000}, "b": {"p0": 700, "p3": 1}, "c": {"q": 9000}}
    for source, files in sizes.items():
        (tmp_path / source).mkdir()
        for name, n in files.items():
            (tmp_path / source / f"{name}.csv").write_text("sn,time,msg,server_model\n" + "".join(
                f"{source}{name},2020-01-01 00:00:00,{i},sm\n" for i in range(n)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for split in ("4k", "64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "16")
            scans = [R.read_csv(spark, str(tmp_path / s), schemas.SYSTEM_LOG) for s in ("c", "a", "b")]
            rows = sorted((r.row_id, r.sn, int(r.msg)) for r in R.arrival_order(scans).collect())
            want = [(s + f, i) for s in ("c", "a", "b") for f, n in sorted(sizes[s].items()) for i in range(n)]
            assert [r[1:] for r in rows] == want and len({r[0] for r in rows}) == len(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
