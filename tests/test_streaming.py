import random
from datetime import datetime, timedelta

import pytest

from tallyflow.operators import graph
from tallyflow.params import Params, Period
from tallyflow.plans import questions
from tallyflow.sources import rates as fx
from tallyflow.sources.commits import CommittedTable
from tallyflow.sources.tables import read_banks_csv, read_transactions_csv
from tallyflow.streaming import incremental
from tallyflow.streaming.below_average import q3_stream
from tallyflow.streaming.paths import PathCounts, q4_stream

P = Params()
HEAD = "h,h,h,h,h,h,h,h,h,h\n"
Q3 = "account string, amount double, amount_text string"


class Killed(Exception):
    pass


def payments(rng, n):
    """Lines of days 1 to 16 with 6 accounts; Cheque has no earlier payments."""
    lines = []
    for _ in range(n):
        day, how = rng.randrange(1, 17), rng.choice(["Wire", "ACH", "Cheque"])
        day = max(day, 6) if how == "Cheque" else day
        amount, currency = rng.choice(["100", "300.5", "1", "0.5", "2.5", "n/a", "0.01"]), rng.choice(["US Dollar"] * 4 + ["Euro"])
        lines.append(f"2022/09/{day:02d} {rng.randrange(24)}:{rng.randrange(60):02d},{rng.randrange(3)},a{rng.randrange(6)},{rng.randrange(2)},a{rng.randrange(6)},x,y,{amount},{currency},{how}")
    return lines


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.csv").write_text(HEAD + "".join(line + "\n" for line in lines))


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_counts_once(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "n long, text string")
    rows = lambda *n: spark.createDataFrame([(i, "x", i) for i in n], "n long, text string, more long")
    assert table.read().collect() == [] and table.last().collect() == [] and table.newest(["n"]).collect() == []
    assert table.write(rows(1, 2), 0, "s") and not table.write(rows(7), 0, "s")
    assert plain(table.read()) == [(1, "x", 0), (2, "x", 0)]
    with pytest.raises(ValueError):
        table.write(rows(1), 1, "another stream")
    rows(5).select("n", "text").write.parquet(table._data(1, "lost"))
    assert table.write(rows(2), 1, "s") and plain(table.read()) == [(1, "x", 0), (2, "x", 0), (2, "x", 1)]
    assert plain(table.last()) == [(2, "x")] and plain(table.newest(["n"])) == [(1, "x"), (2, "x")] and plain(table.read([1, 9])) == [(2, "x", 1)]
    table._commit(1, "zzz", "s")  # a second commit of a batch doesn't count
    assert table.write(rows(), 2, "s") and plain(table.read([1, 2])) == [(2, "x", 1)]
    table.sweep(before=1)
    assert {p.name for p in (tmp_path / "t/data/batch=1").iterdir()} == {f"attempt={table.commits()[1][0]}"} and not list((tmp_path / "t/data/batch=0").iterdir())


@pytest.mark.parametrize("before", [True, False])
def test_killed_around_a_commit(spark, tmp_path, monkeypatch, before):
    for i in range(3):
        put(tmp_path / "in", f"f{i}", [f"2022/09/01 0:20,7,A,1,B{i},9,x,{i + 1},US Dollar,ACH"])
    table, commit = CommittedTable(spark, str(tmp_path / "t"), "account string, to_account string, amount double"), CommittedTable._commit

    def dies(self, batch, attempt, owner):
        if batch == 0 or not before:
            commit(self, batch, attempt, owner)
        if batch == 1:
            raise Killed

    run = lambda: incremental.drain(incremental.q1_stream(incremental.read_csv_stream(spark, str(tmp_path / "in"), 1), P), table, "append", str(tmp_path / "c"))
    monkeypatch.setattr(CommittedTable, "_commit", dies)
    with pytest.raises(Exception, match="Killed"):
        run()
    assert sorted(table.commits()) == ([0] if before else [0, 1])
    monkeypatch.setattr(CommittedTable, "_commit", commit)
    run()
    for _ in range(2):
        assert plain(table.read().drop("batch")) == [("A", f"B{i}", i + 1.0) for i in range(3)]
        run()
    with pytest.raises(Exception, match="another stream"):
        incremental.drain(incremental.q1_stream(incremental.read_csv_stream(spark, str(tmp_path / "in"), 1), P), table, "append", str(tmp_path / "another"))


@pytest.mark.parametrize("seed", [1, 2])
def test_below_average_in_any_order(spark, tmp_path, seed):
    rng, source = random.Random(seed), tmp_path / "in"
    files = [payments(rng, 50) for _ in range(5)] + [["2022/12/01 0:20,1,late,1,b,x,y,0.01,US Dollar,Wire"]]
    rng.shuffle(files)
    table = CommittedTable(spark, str(tmp_path / "t"), Q3)
    run = lambda: incremental.drain(q3_stream(incremental.read_csv_stream(spark, str(source), 2), P, parts=3), table, "append", str(tmp_path / "c"))
    for i, lines in enumerate(files):
        put(source, f"f{i}", lines)
        if i in (2, 5):  # ends and goes on from the checkpoint
            run()
    assert table.read().count() == 0
    incremental.close(spark, str(source))
    run()
    wanted = plain(questions.q3(read_transactions_csv(spark, str(source))[0], P))
    assert plain(table.read().drop("batch")) == wanted and len(wanted) > 10
    run()
    assert plain(table.read().drop("batch")) == wanted


def test_below_average_with_lateness(spark, tmp_path):
    source, table = tmp_path / "in", CommittedTable(spark, str(tmp_path / "t"), Q3)
    run = lambda: incremental.drain(q3_stream(incremental.read_csv_stream(spark, str(source), 1), P, timedelta(days=1), parts=2), table, "append", str(tmp_path / "c"))
    pay = lambda day, account, amount: f"2022/09/{day} 0:20,1,{account},1,b,x,y,{amount},US Dollar,Wire"
    put(source, "a", [pay("01", "A", 300), pay("05", "B", 100), pay("06", "C", 1)])
    run()
    assert table.read().count() == 0  # a day isn't over
    put(source, "b", [pay("07", "D", 50)])
    run()
    assert plain(table.read().drop("batch")) == [("C", 1.0, "1")]
    put(source, "c", [pay("02", "late", 1), pay("08", "E", 1.99), pay("08", "F", 2)])  # the average stays 200
    run()
    assert [r.account for r in table.read().orderBy("batch").collect()] == ["C", "E"]


def test_paths_of_all_batches_so_far(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    make = lambda: spark.createDataFrame([(rng.randrange(2), f"a{rng.randrange(5)}", rng.randrange(2), f"a{rng.randrange(5)}") for _ in range(25)], "from_bank int, account string, to_bank int, to_account string")
    batches = [make().cache() for _ in range(5)]
    batches.insert(2, make().limit(0))
    counts, seen = PathCounts(spark, str(tmp_path / "p"), merge_every=2, hub=3), None
    for i, rows in enumerate(batches):
        if i == 3:  # killed between the edges and their paths
            monkeypatch.setattr(graph, "path_counts", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                counts.add(rows, i, "s")
            monkeypatch.undo()
        counts.add(rows, i, "s")
        seen = rows if seen is None else seen.unionByName(rows)
        edges = graph.edges(seen)
        wanted = plain(graph.path_counts(edges, edges))
        assert plain(counts.read()) == wanted
        counts.add(rows, i, "s")  # comes again
        assert plain(counts.read()) == wanted
    assert plain(counts.origins(4)) == sorted({r[:2] for r in wanted if r[4] >= 4})
    assert plain(counts.read(1)) == plain(PathCounts(spark, str(tmp_path / "p"), merge_every=99).read(1)) and len(counts.merged.commits()) == 3


def test_scatter_gather_stream(spark, tmp_path):
    rng, p = random.Random(5), Params(min_intermediaries=2)
    counts = PathCounts(spark, str(tmp_path / "p"))
    run = lambda: q4_stream(incremental.read_csv_stream(spark, str(tmp_path / "in"), 1), p, counts, str(tmp_path / "c"))
    for i in range(3):
        put(tmp_path / "in", f"f{i}", payments(rng, 60))
        if i:
            run()
    wanted = plain(questions.q4(read_transactions_csv(spark, str(tmp_path / "in"))[0], p))
    assert plain(counts.origins(2)) == wanted and wanted


@pytest.mark.parametrize("names_first", [True, False])
def test_names_and_maxima_in_any_order(spark, tmp_path, names_first):
    rng = random.Random(9)
    table = CommittedTable(spark, str(tmp_path / "t"), "from_bank int, bank_name string, account string, amount double, amount_text string")

    def names():
        put(tmp_path / "banks", "a", ["Zeta,1,,,", "Alpha,0001,,,", "No payments,77,,,", "Bad,x,,,"])

    def run():
        banks = incremental.read_banks_stream(spark, str(tmp_path / "banks"), 1)
        incremental.drain(incremental.q2_named_stream(incremental.read_csv_stream(spark, str(tmp_path / "in"), 1), banks, P), table, "update", str(tmp_path / "c"))

    (tmp_path / "banks").mkdir()
    if names_first:
        names()
    for i in range(2):
        put(tmp_path / "in", f"f{i}", payments(rng, 40))
        run()
    if not names_first:
        assert {r.bank_name for r in table.newest(["from_bank"]).collect()} == {"Unknown Bank"}
        names()
        run()
    wanted = questions.q2(read_transactions_csv(spark, str(tmp_path / "in"))[0], read_banks_csv(spark, str(tmp_path / "banks")), P)
    assert plain(table.newest(["from_bank"]).drop("from_bank")) == plain(wanted) and {r.bank_name for r in wanted.collect()} == {"Alpha", "Unknown Bank"}


def test_counts_and_settled_tables(spark, tmp_path):
    put(tmp_path / "in", "t", ["2022/09/01 0:20,7,A,1,B,9,x,0.90,US Dollar,ACH", "2022/09/01 0:20,7,B,1,B,9,x,80,US Dollar,ACH"])
    stream = lambda: incremental.read_csv_stream(spark, str(tmp_path / "in"))
    table, rates = CommittedTable(spark, str(tmp_path / "t5"), "count long"), fx.constant(spark, datetime(2022, 9, 1).date(), 9, {"US Dollar": 1})
    run = lambda: incremental.drain(incremental.q5_stream(stream(), rates, P), table, "complete", str(tmp_path / "c5"))
    run()
    once = incremental.settled(stream(), str(tmp_path / "kept"), str(tmp_path / "c"))
    assert once.count() == 2 and plain(table.last()) == [(1,)]
    put(tmp_path / "in", "u", ["2022/09/02 0:20,7,C,1,B,9,x,0.10,US Dollar,ACH"])
    run()
    assert plain(table.last()) == [(2,)] and incremental.settled(stream(), str(tmp_path / "kept"), str(tmp_path / "c")).count() == 3


def test_periods_that_overlap(spark, tmp_path):
    p = Params(average_period=Period(datetime(2022, 9, 5), datetime(2022, 9, 9, 23, 59, 59)), candidate_period=Period(datetime(2022, 9, 1), datetime(2022, 9, 14)))
    put(tmp_path / "in", "f", payments(random.Random(4), 150))
    incremental.close(spark, str(tmp_path / "in"))
    table = CommittedTable(spark, str(tmp_path / "t"), Q3)
    incremental.drain(q3_stream(incremental.read_csv_stream(spark, str(tmp_path / "in")), p, parts=2), table, "append", str(tmp_path / "c"))
    assert plain(table.read().drop("batch")) == plain(questions.q3(read_transactions_csv(spark, str(tmp_path / "in"))[0], p)) != []
