"""Compares CSV results with expected ones: order doesn't matter, amounts may differ by a cent."""

import glob

import pandas as pd

# The columns of each result, as text or as a number.
COLUMNS = {
    "q1": {"account": str, "to_account": str, "amount": float},
    "q2": {"bank_name": str, "account": str, "amount": float},
    "q3": {"account": str, "amount": float},
    "q4": {"bank": str, "account": str},
    "q5": {"count": int},
}


def table(rows, name):
    """Rows of text as a sorted table of the result's columns."""
    kinds = COLUMNS[name]
    df = rows.rename(columns=lambda c: c.strip().lower())[list(kinds)].copy()
    for c, kind in kinds.items():
        df[c] = df[c].astype(str).str.strip() if kind is str else df[c].astype(kind)
    return df.sort_values(list(kinds)).reset_index(drop=True)


def assert_result(name, expected, path):
    """``path`` is a result's folder of part files, ``expected`` a list of rows."""
    parts = [pd.read_csv(p, dtype=str) for p in glob.glob(f"{path}/part-*.csv")]
    got = pd.concat(parts) if parts else pd.DataFrame(columns=list(COLUMNS[name]))
    want = pd.DataFrame(expected, columns=list(COLUMNS[name]), dtype=str)
    pd.testing.assert_frame_equal(table(want, name), table(got, name), check_exact=False, atol=1e-2)
