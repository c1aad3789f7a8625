import re

import pytest

from lectern.plans import catalogue

SF = "/root/testdata/sf0.001"
def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("score_by_source", {"doc_id", "text", "lang", "source"}),
        ("resolve_splits", {"o_orderkey", "o_custkey", "o_orderstatus"}),
        ("length_ratio", {"text", "source"}),
        ("duration_histogram", {"n_chars"}),
        ("html_escape", {"page_id", "html"}),
        ("argmin_argmax", {"event_id", "user_id", "value"}),
    ],
)
def test_scans_read_needed_columns_only(spark, name, columns):
    read = set(re.findall(r"(\w+):", "".join(re.findall(r"ReadSchema: struct<(.*?)>", plan(catalogue.QUERIES[name](spark, SF))))))
    assert read and read <= columns


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("retention_by_source", 1, 2), ("missing_tokens", 1, 2), ("loanword_dropped", 1, 1), ("text_stats", 1, 2), ("vn_shape", 1, 2), ("token_vocab_ge3", 1, 2), ("bootstrap_ci", 1, 2), ("bootstrap_delta", 1, 2)])
def test_scans_and_exchanges_are_bounded(spark, name, scans, exchanges):
    """Besides the exchange that deals a small table over all cores."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert text.count("FileScan parquet") == scans
    assert len(re.findall(r"Exchange (?:hash|single|range)", text)) <= exchanges


def test_filters_reach_the_scan(spark):
    text = plan(catalogue.duration_histogram(spark, SF))
    assert "PushedFilters: [IsNotNull(n_chars)" in text
