import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftmill.operators.timestamps import normalise_times

SITES = [("cn", "Asia/Shanghai", "ymd"), ("in", "Asia/Kolkata", "dmy"), ("de", "Europe/Berlin", "dmy"), ("ny", "America/New_York", "mdy"), ("ch", "America/Chicago", "mdy")]
CASES = [
    ("2024/5/3 5:18:08", "cn", "2024-05-02 21:18:08"),
    ("２０２４／５／３ ５：１８：０８", "cn", "2024-05-02 21:18:08"),
    ("  2024-05-03 05:18:08\n", "ny", "2024-05-03 09:18:08"),
    ("2024-05-03T05:18:08.9996", "de", "2024-05-03 03:18:08"),
    ("2024-05-03T05:18:08Z", None, "2024-05-03 05:18:08"),
    ("20240503T051808Z", "de", "2024-05-03 05:18:08"),
    ("20240503051808", "cn", "2024-05-02 21:18:08"),
    ("1714713488", None, "2024-05-03 05:18:08"),
    ("1714713488123", None, "2024-05-03 05:18:08"),
    ("1714713488123456", None, "2024-05-03 05:18:08"),
    ("2024-05-03 05:18:08.673 +08:00", None, "2024-05-02 21:18:08"),
    ("2024-09-05T07:07:15-0400", "cn", "2024-09-05 11:07:15"),
    ("Mon, 13 Jan 2025 15:44:38 +0000", None, "2025-01-13 15:44:38"),
    ("2023/12/2 1:37:39 GMT-5", None, "2023-12-02 06:37:39"),
    ("2025-12-15 05:37:09 CST", "cn", "2025-12-14 21:37:09"),
    ("2025-12-15 05:37:09 CST", "ch", "2025-12-15 11:37:09"),
    ("2025-06-15 05:37:09 CST", "ch", "2025-06-15 11:37:09"),
    ("2025-06-15 05:37:09 CDT", "ch", "2025-06-15 10:37:09"),
    ("2026/5/6 8:57:56 IST", "in", "2026-05-06 03:27:56"),
    ("2025-09-27T21:43:16[Europe/Berlin]", "de", "2025-09-27 19:43:16"),
    ("17.04.2025 19:28", "de", "2025-04-17 17:28:00"),
    ("5/4/2025 1:02:03", "in", "2025-04-04 19:32:03"),
    ("5/4/2025 1:02:03", "ny", "2025-05-04 05:02:03"),
    ("05/04/2025 12:02:03 AM", "ny", "2025-05-04 04:02:03"),
    ("Nov 6, 2024 12:26 PM", "ch", "2024-11-06 18:26:00"),
    ("04-Oct-2024 19:40:24", "in", "2024-10-04 14:10:24"),
    ("2024年11月15日 下午12:45:19", "cn", "2024-11-15 04:45:19"),
    ("2024年11月15日 上午12:45:19", "cn", "2024-11-14 16:45:19"),
    ("2024年5月26日 2时02分57秒", "cn", "2024-05-25 18:02:57"),
    ("23/12/10 3:27:19", "cn", "2023-12-09 19:27:19"),
    # Twice: the first of the two.
    ("2024-10-27 02:30:00", "de", "2024-10-27 00:30:00"),
    ("2024/11/3 1:15:00", "ny", "2024-11-03 05:15:00"),
    # Never, impossible, or nothing to go by.
    ("2024-03-31 02:30:00", "de", None),
    ("2023/2/30 11:59:49", "cn", None),
    ("2024-10-11 25:17:00", "cn", None),
    ("0000-00-00 00:00:00", "cn", None),
    ("2025/6/30 0:12:53", None, None),
    ("2025/6/30 0:12:53", "elsewhere", None),
    ("2025/6/30", "cn", None),
    ("18:58:50", "cn", None),
    ("稍后补录", "cn", None),
    ("", "cn", None),
    (None, "cn", None),
]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "site string, zone string, date_order string")


def told(rows):
    return {(r.raw, r.at): None if r.utc is None else r.utc.strftime("%Y-%m-%d %H:%M:%S") for r in rows.collect()}


def test_notations(spark, sites):
    rows = spark.createDataFrame([(r, s) for r, s, _ in CASES], "raw string, at string")
    got = told(normalise_times(rows, sites, "raw", "at", "utc"))
    assert got == {(r, s): w for r, s, w in CASES}


def test_session_zone_is_irrelevant(spark, sites):
    rows = spark.createDataFrame([(r, s) for r, s, _ in CASES], "raw string, at string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Phoenix")
    try:
        got = {(r.raw, r.at): r.t for r in normalise_times(rows, sites, "raw", "at", "utc").select("raw", "at", F.substring(F.col("utc").cast("string"), 1, 19).alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {(r, s): w for r, s, w in CASES}


def test_rows_stay_and_dictionary_grows(spark, sites, tmp_path):
    path = f"file://{tmp_path}/words"
    a = spark.createDataFrame([("2024/5/3 5:18:08", "cn", 1), ("2024/5/3 5:18:08", "cn", 1), ("x", None, None)], "raw string, at string, utc int")
    assert normalise_times(a, sites, "raw", "at", "utc", path).count() == 3
    held = spark.read.parquet(path).count()
    b = a.unionByName(spark.createDataFrame([("2024/5/4 5:18:08", "cn", 2)], a.schema))
    out = normalise_times(b, sites, "raw", "at", "utc", path)
    assert out.count() == 4 and out.where("utc is not null").count() == 3
    assert spark.read.parquet(path).count() == held + 1


def test_empty(spark, sites):
    rows = spark.createDataFrame([], "raw string, at string")
    assert normalise_times(rows, sites, "raw", "at", "utc").count() == 0


def test_a_hot_string_is_looked_up(spark, sites):
    from siftmill.operators.skew import lookup

    rows = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k")).where("k <> 'k3'")
    for how, want in (("inner", 300 - rows.where("k = 'k3'").count()), ("left", 300)):
        got = lookup(rows, table, ["k"], "n", F.col("id"), how, hot_rows=50)
        assert got.count() == want and got.where("v is not null and v <> upper(k)").count() == 0
    assert dt.date.today()


def test_a_dictionary_that_two_jobs_wrote_doubles_nothing(spark, sites, tmp_path):
    path = str(tmp_path / "words")
    rows = spark.createDataFrame([(1, "2024/1/2 03:04:05", "fab_sh"), (2, None, None)], "import_id bigint, scan_time string, site string")
    first = sorted(map(str, normalise_times(rows, sites, "scan_time", "site", "utc", path).collect()))
    held = spark.read.parquet(path)
    held.union(held).union(held).coalesce(1).write.mode("append").parquet(path)
    assert sorted(map(str, normalise_times(rows, sites, "scan_time", "site", "utc", path).collect())) == first and len(first) == 2


def test_a_broken_dictionary_is_seen(spark, sites, tmp_path):
    (tmp_path / "bad.parquet").write_text("no table")
    rows = spark.createDataFrame([(1, "2024/1/2 03:04:05", "fab_sh")], "import_id bigint, scan_time string, site string")
    with pytest.raises(Exception, match="(?i)parquet"):
        normalise_times(rows, sites, "scan_time", "site", "utc", str(tmp_path / "bad.parquet")).collect()


def test_second_run_parses_nothing(spark, small):
    from siftmill.plans.general import p6_twice

    one, two = p6_twice(spark, small).orderBy("run").collect()
    assert one.n_parsed > 0 and two.n_parsed == 0 and one.n_told == two.n_told > 0
