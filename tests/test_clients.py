import glob
import json
import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import graph
from tallyflow.params import Params
from tallyflow.plans import questions
from tallyflow.plans.clients import Cancelled, Clients
from tallyflow.plans.submission import IncompleteInput, Rows, read_once, submit
from tallyflow.sources import layout
from tallyflow.sources import rates as fx
from tallyflow.sources.shared import scope, shared_folder, written
from tallyflow.sources.tables import read_banks_csv, read_transactions_csv
from tests.test_streaming import HEAD, payments

P = Params(min_intermediaries=2)
RESULTS = ["q1", "q2", "q3", "q4", "q5", "quarantine"]
NO_ANSWER = "2022/12/01 0:20,1,A,1,B,x,y,1,Peso,Cash"


@pytest.fixture
def rates(spark):
    return fx.constant(spark, date(2022, 9, 1), 30, {"US Dollar": 1, "Euro": 2})


def put(folder, client, lines, banks):
    folder.mkdir(exist_ok=True)
    (folder / f"client_{client}_transactions.csv").write_text(HEAD + "".join(f"{line}\n" for line in lines))
    (folder / f"client_{client}_accounts.csv").write_text("h,h,h,h,h\n" + "".join(f"{n},{b},,,\n" for b, n in banks))
    return str(folder / f"client_{client}_transactions.csv"), str(folder / f"client_{client}_accounts.csv")


def result(folder):
    """Lines of a result's files without their headers."""
    return sorted(line for f in glob.glob(f"{folder}/part-*.csv") for line in open(f).read().splitlines()[1:])


def files(folder):
    return {f: open(f).read() for f in glob.glob(f"{folder}/**/part-*", recursive=True)}


def test_one_pass(spark, tmp_path, rates):
    lines = [*payments(random.Random(1), 120), "bad", "2022/09/01 0:20,x,A,1,B,x,y,1,US Dollar,ACH", NO_ANSWER]
    transactions, accounts = put(tmp_path / "in", "a", lines, [(0, "Zero"), (1, "One")])
    told = submit(spark, transactions, accounts, rates, P, str(tmp_path / "out"), declared=123)
    good, refused = read_transactions_csv(spark, transactions)
    questions.run_all(good, read_banks_csv(spark, accounts), rates, P, str(tmp_path / "other"), refused)
    for name in RESULTS:
        lines = result(f"{tmp_path}/out/{name}_result.csv")
        assert lines == result(f"{tmp_path}/other/{name}_result.csv") != [] and told[name] == len(lines)
    assert told == json.loads((tmp_path / "out/rows.json").read_text()) and (told["read"], told["bad"], told["accepted"]) == (123, 2, 121) and told["without_amount"] > 5
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {f"{n}_result.csv" for n in RESULTS} | {"rows.json"}


def test_the_input_is_scanned_once(spark, tmp_path, rates):
    transactions, _ = put(tmp_path / "in", "a", payments(random.Random(2), 50), [])
    with scope(spark, "once"):
        txn, refused, rows = read_once(spark, transactions, P)
        (tmp_path / "in/client_a_transactions.csv").unlink()
        assert rows.read == 50 and questions.q5(txn, rates, P).count() == 1 and refused.count() == rows.without_amount
        assert "PushedFilters: [IsNotNull(payment_currency)" in questions.q1(txn, P)._jdf.queryExecution().toString()


def test_a_cut_off_input_gives_no_result(spark, tmp_path, rates):
    lines = payments(random.Random(3), 30)
    transactions, accounts = put(tmp_path / "in", "a", lines, [])
    submit(spark, transactions, accounts, rates, P, str(tmp_path / "out"))
    before = files(tmp_path / "out")
    put(tmp_path / "in", "a", lines[:20], [])
    with pytest.raises(IncompleteInput, match="30 rows were declared, but 20 were read"):
        submit(spark, transactions, accounts, rates, P, str(tmp_path / "out"), declared=30)
    assert files(tmp_path / "out") == before
    with pytest.raises(IncompleteInput, match="5 rows were read, but 3 accepted and 1 refused"):
        Rows(5, 3, 0, 1).check(None)
    with pytest.raises(Exception, match="no such rate"):
        submit(spark, transactions, accounts, rates.withColumn("rate", F.raise_error(F.lit("no such rate")).cast("double")), P, str(tmp_path / "out"))
    assert files(tmp_path / "out") == before


def test_clients_in_one_run(spark, tmp_path, rates):
    made = {}
    for i, c in enumerate(["a", "b c", "none"]):
        made[c] = put(tmp_path / "in", c, payments(random.Random(i), 90) if c != "none" else [NO_ANSWER], [(0, f"Zero {c}"), (1, "One")][: 2 - i])
        submit(spark, *made[c], rates, P, str(tmp_path / c))
    run = lambda which="*": submit(spark, f"{tmp_path}/in/client_{which}_transactions.csv", f"{tmp_path}/in/client_{which}_accounts.csv", rates, P, str(tmp_path / "all"), by=("client_id",))
    run()
    for c in made:
        for name in RESULTS:
            assert result(f"{tmp_path}/all/{name}_result.csv/client_id={c}") == result(f"{tmp_path}/{c}/{name}_result.csv")
    before = files(tmp_path / "all")
    put(tmp_path / "in", "a", payments(random.Random(77), 40), [])
    run("a")
    after = files(tmp_path / "all")
    same = lambda f: "client_id=a/" not in f
    assert {f: t for f, t in before.items() if same(f)} == {f: t for f, t in after.items() if same(f)} and before != after


@pytest.mark.parametrize("hub", [10_000, 3])
def test_graphs_of_clients_do_not_meet(spark, hub):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.randrange(2), f"a{rng.randrange(5)}", rng.randrange(2), f"a{rng.randrange(5)}") for _ in range(80)]
    df = spark.createDataFrame(rows, "client string, from_bank int, account string, to_bank int, to_account string").distinct().cache()
    got = graph.scatter_gather(df, 3, hub=hub, by=("client",))
    alone = [(c, *r) for c in "xy" for r in graph.scatter_gather(df.where(F.col("client") == c).drop("client"), 3).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(alone) != []


def test_cancel(spark, tmp_path, rates):
    one, two = (put(tmp_path / "in", c, payments(random.Random(8), 60), []) for c in ("one", "two"))
    clients = Clients(spark)
    never = F.udf(lambda rate: time.sleep(600) or rate, "double")
    slow = clients.submit("one", *one, rates.coalesce(1).withColumn("rate", never("rate")), P, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="running"):
        clients.submit("one", *one, rates, P, str(tmp_path / "out"))
    quick = clients.submit("two", *two, rates, P, str(tmp_path / "out"))
    tables = lambda: set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/client-*"))
    for _ in range(600):
        if tables():
            break
        time.sleep(0.1)
    assert quick.result(timeout=60)["read"] == 60
    assert clients.cancel("one") and tables() == set() and not clients.cancel("one")
    with pytest.raises(Cancelled):
        slow.result(timeout=1)
    assert not glob.glob(f"{tmp_path}/out/one/*") and len(result(f"{tmp_path}/out/two/q5_result.csv")) == 1
    assert clients.submit("one", *one, rates, P, str(tmp_path / "out")).result(timeout=60)["read"] == 60  # the client may come back


def test_scope(spark):
    with pytest.raises(KeyError), scope(spark, "s") as path:
        table = written(spark.range(3).toDF("n"), "numbers")
        assert all(f"{path.rpartition('/')[2]}/numbers-" in f for f in table.inputFiles()) and table.count() == 3
        raise KeyError
    assert not glob.glob(path.removeprefix("file:"))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("Exchange ")


def test_layout(spark):
    rng = random.Random(4)
    edge = spark.createDataFrame([(rng.randrange(3), f"a{rng.randrange(20)}", rng.randrange(3), f"a{rng.randrange(20)}") for _ in range(300)], "from_bank int, account string, to_bank int, to_account string").distinct().cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        into, out = layout.edge_tables(edge, "layout_edges", 4)
        got = layout.path_counts(into, out)
        assert exchanges(got) == 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.path_counts(edge, edge).collect()))
        paid = edge.select("from_bank", "account", F.lit("1").alias("amount_text"), F.length("to_account").cast("double").alias("amount"))
        best = layout.largest_per_bank(layout.bucketed(paid, "layout_paid", ["from_bank"], 4, shuffled=False))
        assert exchanges(best) == 0 and best.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("layout_edges_in", "layout_edges_out", "layout_paid"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
