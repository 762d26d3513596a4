from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import split_multi
from tallyframe.functions import dates, ids, numbers, text

DATES = [
    ("05/06/2026", "2026-06-05"), ("05/13/2026", "2026-05-13"), ("13/05/2026", "2026-05-13"),
    ("05-06-2026", "2026-05-06"), ("13-05-2026", "2026-05-13"), ("1.5.2026", "2026-01-05"),
    ("2026-05-06", "2026-05-06"), ("2026-13-05", "2026-05-13"), ("2026/5/6", "2026-05-06"),
    ("5/6/26", "2026-05-06"), ("5/6/99", "1999-05-06"), ("20260506", "2026-05-06"),
    ("06 May 2026", "2026-05-06"), ("May 6, 2026", "2026-05-06"), ("Sept 5, 2026", "2026-09-05"),
    ("September 6, 2026", "2026-09-06"), ("5-May-2026", "2026-05-05"), ("may 2026", "2026-05-01"),
    ("2026-05", "2026-05-01"), ("05/2026", "2026-05-01"), ("2026", "2026-01-01"),
    ("05/06/2026 00:00", "2026-05-06"), ("2026-05-06T10:00:00Z", "2026-05-06"),
    ("1/5/2026 3:04 PM", "2026-01-05"), ("2026-05-06 10:11:12.123", "2026-05-06"),
    ("01/05/2026 - 07/05/2026", "2026-05-01"), ("2026-05-01 ~ 2026-05-07", "2026-05-01"),
    ("  05/06/2026\n", "2026-06-05"), (" 2026-05-06", "2026-05-06"),
    ("46000", None), ("2026-02-30", None), ("2026-13", None), ("Total", None), ("", None),
    ("  ", None), (None, None), ("3/4", None), ("Mayo 2026", None),
]
NUMBERS = [
    ("1,234.5", "1234.5"), ("PHP 5821.12", "5821.12"), ("16%", "16"), ("-", "0"), ("", "0"),
    (None, "0"), ("-.", "0"), ("n/a", "0"), ("1e5", "15"), ("(100)", "100"), ("1.234,56", "1.23456"),
    ("-3.5", "-3.5"), (".5", "0.5"), ("5.", "5"), ("1-2", None), ("1.2.3", None), ("7-", None),
]
WEEKS = [
    (date(2026, 5, 3), "2026-04-28/2026-05-04"), (date(2026, 5, 4), "2026-04-28/2026-05-04"),
    (date(2026, 5, 5), "2026-05-05/2026-05-11"), (date(2026, 5, 11), "2026-05-05/2026-05-11"),
]


def evaluate(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}").orderBy("i")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


def test_parse_day(spark):
    got = evaluate(spark, [t for t, _ in DATES], "string", dates.parse_day)
    expected = [date.fromisoformat(d) if d else None for _, d in DATES]
    assert dict(zip([t for t, _ in DATES], got)) == dict(zip([t for t, _ in DATES], expected))


def test_parse_number(spark):
    got = evaluate(spark, [t for t, _ in NUMBERS], "string", numbers.parse_number)
    assert got == [None if v is None else Decimal(v) for _, v in NUMBERS]


def test_coerce(spark):
    got = evaluate(spark, ["12.5", " 7 ", "x", None, "PHP 1"], "string", numbers.coerce)
    assert got == [Decimal("12.5"), Decimal(7), 0, 0, 0]


def test_weeks_run_from_tuesday_to_monday(spark):
    got = evaluate(spark, [d for d, _ in WEEKS] + [None], "date", lambda c: dates.period_label(c, "week"))
    assert got[:-1] == [w for _, w in WEEKS]


def test_unknown_granularity():
    with pytest.raises(ValueError):
        dates.period_label(None, "year")


def test_date_range(spark):
    cells = ["01/05/2026 - 07/05/2026", "2026-05-01", None, "2026-05-01-2026-05-07", "12.34.5678.9.1"]
    assert evaluate(spark, cells, "string", dates.is_date_range) == [True, False, False, True, False]


def test_month_tag(spark):
    assert evaluate(spark, ["2026-05-01", "2026-05", "May?"], "string", dates.month_tag) == [
        "202605", "202605", "May_",
    ]


def test_clean_and_key(spark):
    cells = [" Gross \n Units Sold ", None, "Gross Sales (Local Currency)"]
    assert evaluate(spark, cells, "string", text.clean) == ["Gross Units Sold", "", cells[2]]
    assert evaluate(spark, cells, "string", text.name_key) == ["grossunitssold", "", "grosssaleslocalcurrency"]


def test_split(spark):
    value = "A.B.1\nA.B.2; A.B.3,,"
    assert split_multi(value) == ["A.B.1", "A.B.2", "A.B.3"]
    assert evaluate(spark, [value, None], "string", text.split_values) == [["A.B.1", "A.B.2", "A.B.3"], []]


def test_guess_from_file_name(spark):
    names = ["report_th.laz.100192131567_may.csv", "x.csv", "ID.TTK.9 (1).xlsx"]
    sellers = ["TH.LAZ.100192131567_MAY", "", "ID.TTK.9"]
    assert evaluate(spark, names, "string", text.guess_seller) == sellers
    assert evaluate(spark, sellers, "string", text.guess_marketplace) == ["LAZ", "AUTO", "TTK"]


def test_safe_key(spark):
    assert evaluate(spark, ["TH.SHP.1", "..", None, "a b/c"], "string", text.safe_key) == [
        "TH_SHP_1", "seller", "seller", "a_b_c",
    ]


def test_ids(spark):
    skus = ["TH.SHP.1.77", "TH.SHP.1.77.red", "TH.SHP.1", "TH", None]
    assert evaluate(spark, skus, "string", ids.seller_prefix) == [
        "TH.SHP.1", "TH.SHP.1", "TH.SHP.1", "TH..", "..",
    ]
    assert evaluate(spark, skus, "string", ids.parent) == ["TH.SHP.1", "TH.SHP.1.77", "TH.SHP", None, None]
    assert evaluate(spark, skus, "string", ids.with_ancestors)[1] == [
        "TH", "TH.SHP", "TH.SHP.1", "TH.SHP.1.77", "TH.SHP.1.77.red",
    ]


def test_seller_candidates_are_compiled_and_come_once(spark):
    """The prefix, the registered seller and all dot prefixes of the SKU, whatever its length, without a loop."""
    rows = [(0, "A.B.1.7", None), (1, "A.B.1.7.x.y", "A.B.1.7"), (2, "A.B", "A.B."), (3, None, "Z"), (4, "A..1.7", ""), (5, ".x", "")]
    c = F.col("c").alias("c")
    frame = spark.createDataFrame(rows, "n int, c string, r string").select("n", "r", ids.seller_prefix(c).alias("p"), ids.parent(c).alias("parent"))
    direct = [F.col("p"), F.col("r")]
    found = frame.withColumn("place", F.explode(ids.candidate_places(direct, F.col("parent"))))
    found = found.select("n", ids.seller_candidate(F.col("place"), direct, F.col("parent")).alias("s")).where("s is not null")
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    got = {n: sorted(r.s for r in found.collect() if r.n == n) for n in range(6)}
    assert got == {
        0: ["A", "A.B", "A.B.1"], 1: ["A", "A.B", "A.B.1", "A.B.1.7", "A.B.1.7.x"], 2: ["A", "A.B."], 3: ["..", "Z"],
        4: ["", "A", "A.", "A..1"], 5: ["", ".x."],
    }


@pytest.mark.parametrize(
    "left, right, tol_abs, tol_pct, expected",
    [
        ("10", "10", "0", "0", True), ("10", "10.01", "0", "0", False), ("10", "11", "1", "0", True),
        ("0", "0", "0", "0", True), ("0", "1", "0", "0.5", False), ("0", "1", "0", "1", True),
        ("40", "38", "0", "0.05", True), ("53", "50", "1", "0.05", False), ("53", "50", "2.5", "0", False),
    ],
)
def test_tolerance_on_wide_decimals(spark, left, right, tol_abs, tol_pct, expected):
    sides = (F.lit(v).cast("decimal(38,2)") for v in (left, right))
    limits = (F.lit(v).cast("decimal(18,9)") for v in (tol_abs, tol_pct))
    got = spark.range(1).select(numbers.within_tolerance(*sides, *limits)).first()[0]
    assert got is expected
