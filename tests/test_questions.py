import os
import random
import re
import subprocess
import sys
from datetime import UTC, date, datetime
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyflow.functions.scalars import two_decimals
from tallyflow.operators import graph
from tallyflow.params import Params, Period, from_config
from tallyflow.plans import questions, registry
from tallyflow.sources import rates as fx
from tallyflow.sources.sinks import write_csv
from tallyflow.sources.tables import read_banks_csv, read_transactions_csv
from tests.oracle import assert_same, small
from tests.verify import assert_result

_ZONED = ["q3_below_average", "q4_scatter_gather", "q5_converted_count", "csv_q5", "scalar_conversions"]
SCHEMA = "ts timestamp, from_bank int, account string, to_bank int, to_account string, amount_text string, amount double, payment_currency string, payment_format string"
P = Params()


def rows(spark, *changes):
    base = {"ts": datetime(2022, 9, 1, 0, 20), "from_bank": 1, "account": "A", "to_bank": 2, "to_account": "B", "amount_text": "1", "payment_currency": "US Dollar", "payment_format": "Cash"}
    made = []
    for c in changes:
        r = base | c
        r.setdefault("amount", float(r["amount_text"]))
        made.append(r)
    return spark.createDataFrame(made, SCHEMA)


def test_small_payments_keep_duplicates(spark):
    df = rows(spark, *({"amount_text": a} for a in ("49.99", "49.99", "50", "50.00")), {"amount_text": "10.00", "payment_currency": "Euro"})
    assert [tuple(r) for r in questions.q1(df, P).collect()] == [("A", "B", 49.99)] * 2


def test_largest_payment_ties_and_missing_names(spark):
    df = rows(spark, {"amount_text": "100"}, {"account": "B", "amount_text": "250.50"}, {"account": "C", "amount_text": "250.5"},
              {"from_bank": 2, "account": "D", "amount_text": "7.00"}, {"from_bank": 4, "account": "E", "amount_text": "9", "payment_currency": "Euro"})
    banks = spark.createDataFrame([(1, "Bank One"), (3, "Bank Three"), (4, "Bank Four")], "bank_id int, bank_name string")
    got = {(r.bank_name, r.account, r.amount_text) for r in questions.q2(df, banks, P).collect()}
    assert got == {("Bank One", "B", "250.50"), ("Unknown Bank", "D", "7.00")}


def test_below_average_bounds(spark):
    table = [("2022-09-01 00:00", "Wire", "100"), ("2022-09-05 23:59", "Wire", "300"), ("2022-09-06 00:00", "Wire", "1.99"), ("2022-09-06 00:00", "Wire", "2.00"),
             ("2022-09-14 23:59", "Wire", "0.50"), ("2022-09-15 00:00", "Wire", "0.10"), ("2022-09-07 10:00", "Cheque", "0.01")]
    df = rows(spark, *({"ts": datetime.fromisoformat(t), "payment_format": f, "amount_text": a} for t, f, a in table))
    assert sorted(r.amount for r in questions.q3(df, P).collect()) == [0.5, 1.99]


@pytest.mark.parametrize("prune", [True, False])
def test_scatter_gather_loops_and_repeats(spark, prune):
    edge = [("o", f"m{i}") for i in range(1, 6)] + [(f"m{i}", "d") for i in range(1, 6)] + [("o", "m1")]
    edge += [("p", f"n{i}") for i in range(1, 5)] + [(f"n{i}", "d2") for i in range(1, 5)] + [("p", "n4"), ("p", "n5"), ("p", "n6")]
    edge += [("x", "x"), ("x", "y")] + [("x", f"k{i}") for i in range(1, 5)] + [(f"k{i}", "y") for i in range(1, 5)]
    df = rows(spark, *({"account": a, "to_account": b, "to_bank": 1} for a, b in edge),
              {"account": "n5", "to_account": "d2", "to_bank": 1, "payment_currency": "Euro"}, {"account": "n6", "to_account": "d2", "to_bank": 1, "ts": datetime(2022, 9, 6)})
    assert {r.account for r in questions.q4(df, P, prune).collect()} == {"o", "x"}
    assert {(r.account, r.to_account) for r in graph.path_counts(graph.edges(df), graph.edges(df)).where("n >= 5").collect()} >= {("o", "d"), ("x", "y")}


def test_converted_count(spark):
    table = [("0.50", "US Dollar", "ACH", 1), ("1.00", "US Dollar", "Wire", 1), ("5", "Yuan", "ACH", 1), ("1.0", "Bitcoin", "Wire", 1), ("0.1", "US Dollar", "Cash", 1),
             ("0.1", "Unknown Coin", "ACH", 1), ("0.1", "Ruble", "ACH", 1), ("0.1", "US Dollar", "ACH", 6), ("0.99", "US Dollar", "Wire", 5)]
    df = rows(spark, *({"amount_text": a, "payment_currency": c, "payment_format": f, "ts": datetime(2022, 9, d)} for a, c, f, d in table))
    rates = fx.constant(spark, date(2022, 9, 1), 10, {"US Dollar": 1, "Yuan": 6.9, "Bitcoin": 19793.1, "Ruble": 0})
    assert questions.q5(df, rates, P).collect()[0][0] == 4
    assert questions.q5(df.where("false"), rates, P).collect()[0][0] == 0


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "t.csv").write_text("h,h,h,h,h,h,h,h,h,h\n2022/09/01 0:20,00070,A,1,B,9,x,49.90,US Dollar,ACH\n2022/09/01 00:20,x,A,1,B,9,x,1,US Dollar,ACH\n"
                                    "2022/09/01 00:20,1,A,1,B,9,x,abc,US Dollar,ACH\nbad,1,A,1,B,9,x,1,US Dollar,ACH\n2022/09/01 00:20,1,A,1,B,9,x,1,US Dollar\n")
    (tmp_path / "a.csv").write_text("h,h,h,h,h\nBank Z,0070,1,2,3\nBank Y,70,1,2,3\n")
    good, bad = read_transactions_csv(spark, str(tmp_path / "t.csv"))
    assert sorted((r.from_bank, r.amount_text, r.amount) for r in good.collect()) == [(1, "abc", None), (70, "49.90", 49.9)]
    assert sorted((r.reason, r.raw_ts, r.raw_from_bank) for r in bad.collect()) == [("amount", "2022/09/01 00:20", "1"), ("row", "2022/09/01 00:20", "1"), ("row", "2022/09/01 00:20", "x"), ("row", "bad", "1")]
    banks = read_banks_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in banks.collect()] == [(70, "Bank Y")]
    rates = fx.constant(spark, date(2022, 9, 1), 1, {"US Dollar": 1})
    paths = questions.run_all(good, banks, rates, P, str(tmp_path / "out"), bad)
    assert spark.read.option("header", True).csv(paths["quarantine"]).count() == 4
    assert spark.read.option("header", True).csv(paths["q1"]).collect()[0].amount == "49.90"
    assert spark.read.option("header", True).csv(paths["q2"]).collect()[0].bank_name == "Bank Y"
    assert spark.read.option("header", True).csv(paths["q5"]).collect()[0]["count"] == "0"
    assert write_csv("q4", questions.q4(good, P), str(tmp_path / "again"))


def test_fields_of_a_row(spark, tmp_path):
    (tmp_path / "t.csv").write_text("h,h,h,h,h,h,h,h,h,h,h\n2022/09/01 0:20,1,,1,B,9,x,5,,,0\n2022/09/01 0:20,1,A,1,B,9,x,,US Dollar,ACH\n2022/09/01 0:20,1,A,1\n2022/09/01 0:20,1,A,1,B,9,x,7,US Dollar,\n")
    good, bad = read_transactions_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(tuple(r)[2:] for r in good.collect()) == [("", 1, "B", "5", 5.0, "", ""), ("A", 1, "B", "", None, "US Dollar", "ACH"), ("A", 1, "B", "7", 7.0, "US Dollar", "")]
    assert sorted(r.reason for r in bad.collect()) == ["amount", "row"]
    assert questions.q1(good, P).count() == 1 and graph.edges(good).count() == 2


def test_all_results_against_expected(spark, tmp_path):
    lines = ["2022/09/01 0:20,1,o,1,m%d,9,x,10.50,US Dollar,ACH" % i for i in range(5)] + ["2022/09/02 0:20,1,m%d,2,d,9,x,0.50,US Dollar,Wire" % i for i in range(5)]
    lines += ["2022/09/07 0:20,3,z,1,y,9,x,0.01,US Dollar,ACH", "2022/09/03 0:20,4,w,1,y,9,x,n/a,US Dollar,ACH", "2022/09/03 10:00,4,w,1,y,9,x,900.129,US Dollar,Cash"]
    (tmp_path / "t.csv").write_text("\n".join(["h,h,h,h,h,h,h,h,h,h", *lines]))
    good, bad = read_transactions_csv(spark, str(tmp_path / "t.csv"))
    banks = spark.createDataFrame([(1, "One"), (4, "Four")], "bank_id int, bank_name string")
    rates = fx.constant(spark, date(2022, 9, 1), 9, {"US Dollar": 1})
    paths = questions.run_all(good, banks, rates, P, str(tmp_path / "out"), bad)
    assert_result("q1", [("o", f"m{i}", "10.5") for i in range(5)] + [(f"m{i}", "d", "0.5") for i in range(5)] + [("z", "y", "0.01")], paths["q1"])
    assert_result("q2", [("One", "o", "10.50"), ("Unknown Bank", "z", "0.01"), ("Four", "w", "900.13")], paths["q2"])
    assert_result("q3", [("z", "0.01")], paths["q3"])
    assert_result("q4", [("1", "o")], paths["q4"])
    assert_result("q5", [("5",)], paths["q5"])
    with pytest.raises(AssertionError):
        assert_result("q5", [("6",)], paths["q5"])


def test_hub_in_parts(spark):
    edge = [(1, f"o{i}", 1, "hub") for i in range(40)] + [(1, "hub", 1, f"d{i}") for i in range(3)] + [(1, "o1", 1, "m"), (1, "m", 1, "d1")]
    df = spark.createDataFrame(edge, "from_bank int, account string, to_bank int, to_account string")
    want = sorted(map(tuple, graph.path_counts(df, df).collect()))
    assert sorted(map(tuple, graph.path_counts(df, df, graph.hubs(df, 7)).collect())) == want and (1, "o1", 1, "d1", 2) in want and graph.hubs(df, 40) is None


def test_config():
    p = from_config({"MICRO_AMOUNT": "12.5", "FORMATS": "Wire,ACH,", "MIN_INTERMEDIARIES": "3", "GRAPH_PERIOD_START": "2022-09-01T00:00:00-03:00", "GRAPH_PERIOD_END": "2022-09-02T00:00:00.5Z"})
    assert (p.micro_amount, p.formats, p.min_intermediaries, p.currency) == (12.5, ("Wire", "ACH", ""), 3, "US Dollar")
    assert p.graph_period == Period(datetime(2022, 9, 1, 3, tzinfo=UTC), datetime(2022, 9, 2, 0, 0, 0, 500000)) and from_config({}) == P
    for bad in ({"X": "1"}, {"MICRO_AMOUNT": "x"}, {"GRAPH_PERIOD_START": "2022-09-01T00:00:00Z"}, {"GRAPH_PERIOD_START": "2022-09-01", "GRAPH_PERIOD_END": "2022-09-02T00:00:00Z"}):
        with pytest.raises(ValueError):
            from_config(bad)


@pytest.mark.parametrize(("machine", "session"), [("America/New_York", "Asia/Tokyo")])
def test_time_zones_do_not_matter(spark, machine, session):
    code = f"""
from pyspark.sql import SparkSession
from tallyflow.plans.registry import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "{session}").getOrCreate()
print("COUNTS", *[sorted(map(tuple, QUERIES[q](spark, "{small('sf0.01')}").collect())) for q in {_ZONED}], sep="|")
"""
    said = subprocess.run([sys.executable, "-c", code], env=os.environ | {"TZ": machine}, capture_output=True, text=True, timeout=200)
    want = [sorted(map(tuple, registry.QUERIES[q](spark, small("sf0.01")).collect())) for q in _ZONED]
    assert said.stdout.strip().split("COUNTS|")[-1] == "|".join(map(str, want)), said.stderr[-2000:]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, small()), registry.ORACLE_SQL[name], small())


@pytest.mark.parametrize("name", ["csv_q3", "csv_q4", "csv_q5", "submission", "stream_q3", "stream_q4_pairs", "stream_q5"])
def test_payments_right_after_a_period(spark, tmp_path, name):
    """Accounts of even numbers pay in the last instant of a period, the others within the same minute after it."""
    for path in Path(small()).iterdir():
        if path.name != "events.parquet":
            (tmp_path / path.name).symlink_to(path)
    rng = random.Random(3)
    times = [[f"2024-01-{day} 23:59:{s}" for day in ("05", "14")] for s in ("59.000000", "59.000001", "59.999999")]
    events = pd.DataFrame([(i, rng.choice(times[user % 2 and rng.randrange(1, 3)]), user, rng.choice(["view", "click", "purchase"]), rng.choice([0.01, 500.0]), f'{{"k": {rng.randrange(15)}}}')
                           for i in range(300) for user in [rng.randrange(15)]], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    events["ts"] = pd.to_datetime(events["ts"]).astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet", index=False)
    assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], str(tmp_path))


def test_partitioning_does_not_matter(spark):
    txn = registry._txn(spark, small())
    answers = [sorted(map(tuple, questions.q4(txn.repartition(n), registry.WIDE).collect())) for n in (1, 8, 50)]
    assert answers[0] == answers[1] == answers[2] and answers[0]


def test_neighbours_of_an_account_are_not_gathered_in_one_row(spark):
    df = registry.QUERIES["explode_intermediary"](spark, small("sf0.01"))
    assert_same(df, registry.ORACLE_SQL["explode_intermediary"], small("sf0.01"))
    assert not re.search("collect_|Exchange", df._jdf.queryExecution().toString())


def test_two_decimals(spark):
    numbers = [0.125, 0.375, 1.005, 2.675, 49.999, -0.5, 0.0, 1e9, 123456789.125, None]
    df = spark.createDataFrame([(n,) for n in numbers], "n double").select("n", two_decimals(F.col("n")).alias("text"))
    assert [r.text for r in df.collect()] == [None if n is None else "%.2f" % n for n in numbers]
