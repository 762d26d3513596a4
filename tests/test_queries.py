"""Registered queries against DuckDB. The short list runs by default; set
ALL_QUERIES=1 for every one of them, or use ``python -m checks.verify``."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks import queries_jobs
from checks.registry import QUERIES
from checks.verify import check, difference, duck, frame_of

SF_DIR = "/root/testdata/sf0.001"
SHORT = [
    "monthly_check", "flow_item_sku_sales", "seller_or_match", "compare_two_sided_month", "compare_by_source",
    "normalize_platform", "scan_csv", "parse_date", "query_audit", "header_detect",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else SHORT)
def test_query(spark, con, name):
    outcome, rows, _, _ = check(spark, con, name, SF_DIR)
    assert (outcome, rows > 0) == ("ok", True)


def test_flagship(spark):
    assert len(entry.entry(spark).columns) == 14


def test_same_name_files_are_written_by_several_tasks(spark, monkeypatch, folder):
    monkeypatch.setattr(queries_jobs, "new_folder", lambda *_: f"{folder}/names")
    query = QUERIES["same_name_files"]
    found = query.run(spark, SF_DIR).toPandas()
    assert difference(found, frame_of(duck(SF_DIR), query.oracle)) == ""
    names = {p.name: set() for p in Path(folder).rglob("*.csv")}
    for p in Path(folder).rglob("*.csv"):
        names[p.name].add(p.parent.name)
    assert len(names) > 1 and any(len(folders) > 1 for folders in names.values())


def test_lineitem_is_dealt_out_once_for_all_views(spark):
    """Views are written where they are made; only their input is shuffled to be dealt out."""
    from checks import data

    found = data.CheckData(spark, "/root/testdata/sf0.001/")
    names = ("date_cells", "number_cells")
    counts = [found.table(name).count() for name in names]
    assert counts == [found.table("lineitem").count()] * 2
    key = (spark.sparkContext.applicationId, found.sf_dir, "lineitem")
    assert key in data._KEPT and data._KEPT[key].count() == counts[0]
