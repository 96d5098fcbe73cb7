import json
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tallyflow.sources import rates as fx

DAYS = [date(2022, 9, d) for d in (1, 2, 3)]


@pytest.fixture
def service():
    """(address, requests by day, answers by day as (status, body)); a day may have several answers, one after another."""
    asked, answers = Counter(), {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            day = parse_qs(urlparse(self.path).query)["date"][0]
            told = answers.get(day, [(200, json.dumps([{"quote": "EUR", "rate": int(day[-2:])}]))])
            status, body = told[min(asked[day], len(told) - 1)]
            asked[day] += 1
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rates", asked, answers
    server.shutdown()


def test_addresses_and_answers(spark):
    day = date(2022, 9, 2)
    assert fx.url_for("http://h/r?base=USD&date={date}", day) == "http://h/r?base=USD&date=2022-09-02"
    assert fx.url_for("http://h/r?base=USD", day) == "http://h/r?base=USD&date=2022-09-02"
    assert fx.url_for("http://h/r", day) == "http://h/r?date=2022-09-02"
    assert fx.url_for("http://h/r?date=1&base=USD", day) == "http://h/r?date=1&base=USD"
    bodies = ['[{"quote": "EUR", "rate": 0.9}, {"quote": "XXX", "rate": 3}]', '[{"quote": "EUR", "rate": 2}, {"quote": "JPY"}, {"quote": "EUR", "rate": 1.5}, {}]', "[]"]
    for body in bodies:
        table = fx.parsed(spark.createDataFrame([(day, body)], "rate_date date, body string"))
        assert sorted(map(tuple, table.collect())) == sorted(fx.parse(day, body))
    assert {c: r for _, c, r in fx.parse(day, bodies[1])} == {"Euro": 1.5, "Yen": 0.0, "US Dollar": 1.0, "Bitcoin": 199999.0}
    for body in ("oops", '{"quote": 1}', None, "[1]"):
        with pytest.raises(ValueError, match="2022-09-02"):
            fx.parse(day, body)
    for body in ("oops", None):
        with pytest.raises(Exception, match="bad answer for 2022-09-02"):
            fx.parsed(spark.createDataFrame([(day, body)], "rate_date date, body string")).collect()


def test_executors_ask_once_a_day(spark, service, monkeypatch):
    address, asked, _ = service
    monkeypatch.setattr(fx, "urlopen", lambda *a, **b: 1 / 0)  # the driver's; workers have their own
    table = fx.fetch(spark, address, [*DAYS, DAYS[0]])
    assert table.schema.simpleString() == "struct<rate_date:date,currency:string,rate:double>"
    got = {(r.rate_date, r.currency): r.rate for r in table.collect()}
    assert got[DAYS[1], "Euro"] == 2.0 and got[DAYS[0], "Bitcoin"] == 19793.1 and len(got) == 9
    assert table.count() == 9 and asked == {d.isoformat(): 1 for d in DAYS}
    assert fx.fetch(spark, address, []).count() == 0


def test_partitions_and_retries(spark, service):
    address, asked, answers = service
    answers["2022-09-02"] = [(503, ""), (429, ""), (200, "[]")]
    spark.dataSource.register(fx.RatesSource)
    read = lambda **options: spark.read.format("tallyflow_rates").options(url=address, days=",".join(map(str, DAYS)), wait="0.01", **options).load()
    assert read().rdd.getNumPartitions() == 3
    assert read().where("currency = 'US Dollar'").count() == 3 and asked["2022-09-02"] == 3


@pytest.mark.parametrize(("answer", "requests"), [((200, "oops"), 1), ((404, "[]"), 1), ((500, "[]"), 3)])
def test_a_bad_answer_fails_with_its_day(spark, service, answer, requests):
    address, asked, answers = service
    answers["2022-09-03"] = [answer]
    with pytest.raises(Exception, match="answer for 2022-09-03"):
        fx.fetch(spark, address, DAYS, retries="2", wait="0.01")
    assert asked["2022-09-03"] == requests
