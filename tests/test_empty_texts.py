"""Queries over documents without a text, as large tables have them."""

import duckdb

import __spark_entry__ as entry
from tests.test_growth import plain, tables

#: Ids of fifty have no duration; texts that are plain, empty, blank, null, and of another length than noted.
DOCUMENTS = """select * from (values (1, 'one', 3), (2, '', 0), (3, '  ', 2), (4, null, 0), (5, null, null), (6, '', null), (7, 'seven', 0), (8, 'eight', -5),
  (50, '', 0), (100, 'c', 1), (150, null, 0), (25, repeat('x', 40), 40), (39, repeat('x', 40), 20), (9, '', 4)) t(doc_id, text, n_chars)"""
LABELS = "select * from (values (1, 1), (2, 0), (9, null), (77, 1)) t(doc_id, quality)"


def same_rows(spark, name, folder):
    """The query's rows, which are its SQL's, NaN like NaN."""
    got = entry.queries()[name](spark, folder)
    with duckdb.connect() as db:
        for table in ("documents", "labels"):
            db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
        found = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        want = sorted(repr(plain(r)) for r in found.fetchall())
    rows = sorted(repr(plain(r)) for r in got.select(*columns).collect())
    assert rows == want
    return rows


def test_corrections_of_empty_documents(spark, tmp_path):
    rows = same_rows(spark, "apply_corrections", tables(tmp_path, documents=DOCUMENTS, labels=LABELS))
    assert len(rows) == 14 and "(2, 'q0 ', True)" in rows and "(9, '', True)" in rows and "(4, None, True)" in rows


def test_speech_rates_of_empty_documents(spark, tmp_path):
    rows = same_rows(spark, "too_fast", tables(tmp_path, documents=DOCUMENTS, labels=LABELS))
    assert "(2, nan)" in rows and "(50, inf)" in rows and "(150, inf)" in rows and "(7, inf)" in rows and len(rows) == 7
