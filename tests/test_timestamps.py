import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillstone import timestamps as T

CASES = [
    ("2017-01-14T07:22:41.348862", "Europe/Berlin", "dmy", "2017-01-14T06:22:41.348862Z"), ("Dec 17 1993", None, None, "1993-12-17"), ("Feb. 1999", None, None, "1999-02"), ("7 de febrero de 1996", None, None, "1996-02-07"),
    ("2007-W09-3", None, None, "2007-02-28"), ("2014-221", None, None, "2014-08-09"), ("2014-366", None, None, None), ("20030107", None, None, "2003-01-07"), ("1347684270128250", None, None, "2012-09-15T04:44:30.128250Z"), ("1296900235", None, None, "2011-02-05T10:03:55.000000Z"),
    ("1286306097973", None, None, "2010-10-05T19:14:57.973000Z"), ("2021/05/15 12:52:29.254248 EAT", None, None, "2021-05-15T09:52:29.254248Z"), ("10/17/2012", None, "mdy", "2012-10-17"), ("10/17/2012", None, "dmy", None), ("05/06/2012", None, "mdy", "2012-05-06"), ("05/06/2012", None, "dmy", "2012-06-05"),
    ("٢٠٠٥-٠٧-١٨", None, None, "2005-07-18"), ("١٢ يناير ١٩٩٥", None, None, "1995-01-12"), (" 2022-10-21\t", None, None, "2022-10-21"), ("1996-07-23.", None, None, "1996-07-23"), ("2017-13-05", None, None, None), ("0000-00-00", None, None, None), ("31/31/2012", None, "dmy", None), ("2019-02-30", None, None, None),
    ("August 9, 2023 12:04:56.486084068 AM", "UTC", None, "2023-08-09T00:04:56.486084Z"), ("July 31, 2013 6:52:58,5 PM -04:00", None, None, "2013-07-31T22:52:58.500000Z"), ("2018-04-17T21:08:27 America/Denver", None, None, "2018-04-18T03:08:27.000000Z"), ("20220915T125230,297Africa/Nairobi", None, None, "2022-09-15T09:52:30.297000Z"),
    ("Thu, 27 Jan 2011 14:54 EST", None, None, "2011-01-27T19:54:00.000000Z"), ("2021-07-04T09:42:31.05 GMT-0400", None, None, "2021-07-04T13:42:31.050000Z"), ("2016-03-29 02:40:31 UTC+5:45", None, None, "2016-03-28T20:55:31.000000Z"), ("20201103T2136+00:00", None, None, "2020-11-03T21:36:00.000000Z"),
    # An hour that comes twice is the earlier instant; one that is skipped moves forward by the gap.
    ("2017-10-29 02:30", "Europe/Berlin", None, "2017-10-29T00:30:00.000000Z"), ("2017-03-26 02:30", "Europe/Berlin", None, "2017-03-26T01:30:00.000000Z"), ("2021-03-14T02:30", "America/New_York", None, "2021-03-14T07:30:00.000000Z"),
    ("2017-01-01 25:00", "UTC", None, None), ("2017-01-01 10:00 XYZ", "UTC", None, None), ("2001", None, None, "2001"), ("May 2023", None, None, "2023-05"), ("July, 2008", None, None, "2008-07"), ("08/2009", None, None, "2009-08"), ("13. januara 2014", None, None, "2014-01-13"), ("26 Mayıs 2010", None, None, "2010-05-26"),
    ("n.d.", None, None, None), ("-", None, None, None), ("", None, None, None), (None, None, None, None), ("9" * 100_000, None, None, None), ("2020-W53-7", None, None, "2021-01-03"), ("2021-W53-1", None, None, None), ("1969-12-31T23:59:59.9Z", None, None, "1969-12-31T23:59:59.900000Z"),
]


def _run(spark, rows, group="g"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, value string, zone string, o string, g string")
    out = T.parsed(df, "value", F.col("zone"), F.col("o"), F.col(group))
    return [r for r in out.orderBy("id").collect()]


def test_forms(spark):
    got = _run(spark, [(v, z, o, "g") for v, z, o, _ in CASES])
    assert [(r["value"], r["normal_form"]) for r in got] == [(v, w) for v, _, _, w in CASES]


def test_walls_against_zoneinfo(spark):
    rows, want = [], []
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Adelaide", "Asia/Kathmandu", "Africa/Lagos"):
        z = ZoneInfo(zone)
        at = datetime(2016, 1, 1)
        while at < datetime(2017, 1, 1):
            rows.append((at.strftime("%Y-%m-%d %H:%M"), zone, None, "g"))
            # fold 0 is the earlier instant, and counts a skipped wall time from the offset before the gap.
            want.append(at.replace(tzinfo=z).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:00.000000Z"))
            at += timedelta(hours=7, minutes=30)
    assert [r["normal_form"] for r in _run(spark, rows)] == want


def test_mixture_decides_without_declaration(spark):
    rows = [(f"{d}/{m}/2010", None, None, "dmy") for d in range(13, 29) for m in range(1, 4)] + [(f"{m}/{d}/2010", None, None, "mdy") for d in range(13, 29) for m in range(1, 4)]
    rows += [("03/04/2010", None, None, "dmy"), ("03/04/2010", None, None, "mdy"), ("03/04/2010", None, None, "lone"), ("04/04/2010", None, None, "lone"), ("03/04/2010", None, None, None)]
    got = _run(spark, rows)[-5:]
    assert [r["normal_form"] for r in got[:2]] == ["2010-04-03", "2010-03-04"] and not got[0]["ambiguous"] and not got[1]["ambiguous"] and got[0]["posterior"] > 0.9
    assert got[2]["ambiguous"] and not got[3]["ambiguous"] and got[4]["ambiguous"]


def test_em_against_plain_python(spark):
    both, only_d, only_m = 7, 5, 2
    w = 0.5
    for _ in range(T.ROUNDS):
        w = (1 + only_d + both * w) / (2 + both + only_d + only_m)
    rows = [(f"0{i + 1}/02/2010", None, None, "g") for i in range(both)] + [(f"{13 + i}/02/2010", None, None, "g") for i in range(only_d)] + [(f"02/{13 + i}/2010", None, None, "g") for i in range(only_m)]
    assert abs(_run(spark, rows)[0]["posterior"] - max(w, 1 - w)) < 1e-9


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("2001-02-03", 1, 2, 3)], "value string, normal_form int, Precision int, __v int")
    out = T.parsed(df, "value", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("g"))
    row = out.first()
    assert row["normal_form"] == "2001-02-03" and row["normal_form_in"] == 1 and row["Precision_in"] == 2 and row["__v"] == 3
    assert T.parsed(df.limit(0), "value", F.lit("UTC"), F.lit("dmy"), F.lit("g")).count() == 0


def test_repeated_rows_are_kept(spark):
    assert len(_run(spark, [("1 mai 2021", None, None, "g")] * 3)) == 3


def test_month_names_are_distinct():
    seen = {}
    for m, names in T.MONTHS.items():
        for n in names.split():
            assert seen.setdefault(n, m) == m, n


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_found(spark, sf):
    from quillstone.plans.timestamp_queries import p2_found

    df = p2_found(spark, f"/root/testdata/{sf}")
    assert df.columns == ["tbl", "row_key", "normal_form"]
    rows = df.collect()
    form = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d:\d\d\.\d{6}Z)?)?)?$")
    assert rows and all(form.match(r["normal_form"]) for r in rows)


def test_sources_without_a_declared_order(spark):
    from quillstone.plans import timestamp_queries as Q

    d = "/root/testdata/sf0.01"
    orders = Q.p2_orders(spark, d).where("day_order is not null and `both` + dmy + mdy >= 10").collect()
    assert len(orders) >= 3 and all((r["weight"] >= 0.5) == (r["day_order"] == "dmy") for r in orders)
    declared = {(r["tbl"], r["row_key"], r["value"]): r["normal_form"] for r in Q.p2_normalised(spark, d).where("normal_form is not null").collect()}
    fitted = {(r["tbl"], r["row_key"], r["value"]): r["normal_form"] for r in Q.p2_undeclared(spark, d).collect()}
    assert sum(fitted[k] == v for k, v in declared.items()) > 0.999 * len(declared)
    loose = Q.p2_unsourced(spark, d).where("ambiguous").collect()
    assert loose and all(r["posterior"] < T.SURE and r["other_day"] != r["normal_form"][:10] for r in loose)
