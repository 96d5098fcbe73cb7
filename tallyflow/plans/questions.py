"""The five questions as DataFrame programs over canonical transactions.

``by`` are columns that tell clients apart, in transactions and banks alike: all are answered in one run, and
each as if it were alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators import aggregates, filters, graph, joins
from tallyflow.operators.aggregates import Keys
from tallyflow.params import Params
from tallyflow.sources.shared import release, written
from tallyflow.sources.sinks import write_csv
from tallyflow.sources.tables import CANONICAL


def q1(txn: DataFrame, p: Params, by: Keys = ()) -> DataFrame:
    """Small payments in one currency; duplicates stay."""
    return filters.below(filters.by_currency(txn, p.currency), "amount", p.micro_amount).select(*by, "account", "to_account", "amount")


def q2(txn: DataFrame, banks: DataFrame, p: Params, by: Keys = ()) -> DataFrame:
    """Largest payment of each bank, with the bank's name."""
    best = aggregates.largest_per_bank(filters.by_currency(txn, p.currency), by)
    return joins.with_bank_name(best, banks, p.unknown_bank, by).select(*by, "bank_name", "account", "amount", "amount_text")


def q3(txn: DataFrame, p: Params, by: Keys = ()) -> DataFrame:
    """Payments far below the earlier average of their format."""
    paid = filters.by_currency(txn, p.currency)
    averages = aggregates.average_by_format(filters.in_period(paid, p.average_period), by)
    candidates = filters.in_period(paid, p.candidate_period).where(~filters.inside(p.average_period))
    return joins.below_average(candidates, averages, p.average_divisor, by).select(*by, "account", "amount", "amount_text")


def q4(txn: DataFrame, p: Params, prune: bool = True, by: Keys = ()) -> DataFrame:
    """Origins of scatter-gather patterns.

    Jobs run while the result is built: the distinct edges are written, and vertices of very many edges are looked for among them.
    """
    usd = filters.in_period(filters.by_currency(txn, p.currency), p.graph_period)
    return graph.scatter_gather(written(graph.edges(usd, by), "edges"), p.min_intermediaries, prune, by=by)


def q5(txn: DataFrame, rates: DataFrame, p: Params, by: Keys = (), owners: DataFrame | None = None) -> DataFrame:
    """How many payments are worth less than a threshold in dollars; always one row, for each of the ``owners`` if ``by`` tells them apart."""
    wanted = filters.by_format(filters.in_period(txn, p.conversion_period), p.formats)
    return aggregates.row_count(filters.below(joins.with_usd(wanted, rates), "usd", p.converted_amount), by, owners)


def needed(p: Params) -> Column:
    """Whether any question looks at a row."""
    return (F.col("payment_currency") == p.currency) | (F.col("payment_format").isin(*p.formats) & filters.inside(p.conversion_period))


def questions(txn: DataFrame, banks: DataFrame, rates: DataFrame, p: Params, by: Keys = (), owners: DataFrame | None = None) -> dict[str, Callable[[], DataFrame]]:
    """All five by name; each is built when it is called."""
    return {"q1": lambda: q1(txn, p, by), "q2": lambda: q2(txn, banks, p, by), "q3": lambda: q3(txn, p, by), "q4": lambda: q4(txn, p, by=by), "q5": lambda: q5(txn, rates, p, by, owners)}


def run_all(txn: DataFrame, banks: DataFrame, rates: DataFrame, p: Params, folder: str, quarantined: DataFrame | None = None, by: Keys = (), owners: DataFrame | None = None) -> dict[str, str]:
    """All five, written as CSV, and beside them the rows that could not be read.

    ``txn`` is read once: the rows and columns that any question needs are written, and the questions read of
    that table what they need. ``submission.submit`` does so with files of clients, and counts their rows.
    """
    table = written(txn.where(needed(p)).select(*by, *CANONICAL), "needed")
    paths = {name: write_csv(name, ask(), folder, by) for name, ask in questions(table, banks, rates, p, by, owners).items()}
    if quarantined is not None:
        paths["quarantine"] = write_csv("quarantine", quarantined, folder, by)
    release(table)
    return paths
