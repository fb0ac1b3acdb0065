from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillscope.functions import text as X
from tillscope.functions.money import money_tokens
from tillscope.operators.audit import audit
from tillscope.schemas import ParseConfig

TOKENS = {
    "1234.56": ["123.000", "4.560"], "1,234.56": ["1234.560"], "1,234": ["1.234"], "1,234,567": [], "QTY 5 100.00": ["5100.000"], "FARM 12": ["RM 12.000"],
    "100%": ["10.000"], "12.5%": ["12.000"], "(12.34)": ["-12.340"], "12.34-": ["-12.340"], "12/03/2024 9.50": ["9.500"], "7": [], "(12/03/2024) 5.00": ["5.000"],
    "RM 12/03/2024 8.20": ["8.200"], "1.1 2.2 33.00 4.40 5.50 6.60 7.70 8.80": ["33.000", "4.400", "5.500", "6.600", "7.700", "8.800"],
}


def tokens(spark, lines, **kw):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    show = F.transform(money_tokens(F.col("t"), **kw), lambda m: F.concat(F.coalesce(F.concat(m["currency"], F.lit(" ")), F.lit("")), m["value"].cast("string")))
    return [r[1] for r in d.select("i", show).orderBy("i").collect()]


def test_money_tokens(spark):
    assert tokens(spark, list(TOKENS)) == list(TOKENS.values())


def test_money_tokens_without_quirk(spark):
    assert tokens(spark, ["1234.56", "TOTAL 12,345.60"], compat=False) == [["1234.560"], ["12345.600"]]


def test_money_tokens_among_dates_words_and_marks(spark):
    golden = {
        "": [], "TAX 6 %": [], "TAX 6 % 0.90": ["0.900"], "ITEM 3 450 RM 12": ["3450.000", "RM 12.000"], "$ 7.5": ["$ 7.000"], "02 JAN 23 99.90": ["99.900"],
        "(4.20) 8.00-": ["-4.200", "-8.000"], "2024-01-02": [], "€1,200.50 99.90": ["€ 1200.500", "99.900"], "12/03/2024 RM 3": ["RM 3.000"], "450 1,200.50": ["450.000", "1200.500"],
    }
    assert tokens(spark, list(golden)) == list(golden.values())


def test_keywords(spark):
    d = spark.createDataFrame([(x,) for x in ("CABINET", "WIRELESS", "CASHIER", "PRIVATE", "SUB TOTAL", "BALANCE DUE", "BREAD")], "t string")
    got = {r[0]: r[1] for r in d.select("t", X.keywords(X.norm(F.col("t")))).collect()}
    assert got == {"CABINET": ["TOTAL"], "WIRELESS": ["DISCOUNT"], "CASHIER": ["PAID"], "PRIVATE": ["TAX"], "SUB TOTAL": ["TOTAL", "SUBTOTAL"], "BALANCE DUE": ["TOTAL", "CHANGE"], "BREAD": []}


@pytest.fixture(scope="module")
def audited(spark):
    d = spark.createDataFrame(
        [
            ("a", "SUBTOTAL 10.00\nTAX 1.00\nTOTAL 11.00\nPAID 20.00\nCHANGE 9.00\n", 1),
            ("b", "TOTAL 12.00\n", 2),
            ("c", None, 3),
            ("d", "ACME STORE\nRECEIPT\nTEL 12 34\n01/02/2024\nMILK 2.00\nMILK 2.00\nBREAD 3.50\nSUBTOTAL 9.00\nTAX 0.50\nGRAND TOTAL 30.00\n", 4),
            ("e", "", 5),
        ],
        "id string, text string, idx int",
    )
    return {r.id: r for r in audit(d).collect()}


def test_audit_consistent(audited):
    a = audited["a"]
    assert (a.item_count, a.subtotal, a.tax, a.total, a.paid, a.change) == (0, 10, 1, 11, 20, 9)
    assert [(c.name, c.passes, c.diff) for c in a.checks] == [("expected_total_vs_total", True, Decimal("0.00")), ("paid_minus_change_vs_total", True, Decimal("0.00"))]
    assert a.arithmetic_consistent is True and a.best_explanation == "expected_total_vs_total"
    assert a.all_amounts == ["1.00", "9.00", "10.00", "11.00", "20.00"] and a.company_lines == [] and len(a.payment_candidates) == 2 and len(a.total_candidates) == 5
    assert a.quality_score == 1.0 and len(a.semantic_checks) == 4 and a.semantic_checks[0].passed is True


def test_audit_insufficient_and_empty(audited):
    assert audited["b"].arithmetic_consistent is None and [c.passed for c in audited["b"].semantic_checks] == [None, None]
    for k in "ce":
        assert audited[k].lines == [] and audited[k].checks == [] and audited[k].quality_score == 0.0


def test_audit_inconsistent(audited):
    d = audited["d"]
    # Equal item lines each count; the header line is skipped, the name scan ends at the first amount.
    assert (d.item_count, d.item_sum, d.item_candidates) == (3, Decimal("7.500"), ["MILK 2.00", "BREAD 3.50"])
    assert d.company_lines == ["ACME STORE"] and d.date_candidates == ["01/02/2024"]
    assert d.arithmetic_consistent is False and d.best_explanation == "items_vs_subtotal" and d.semantic_checks[0].passed is False
    assert d.idx == 4  # a clashing extra column is kept


def test_policy_largest(spark):
    d = spark.createDataFrame([("x", "ITEM 9.00 2.00\nSUBTOTAL 9.00\n")], "id string, text string")
    assert audit(d, cfg=ParseConfig(amount_policy="largest")).first().item_sum == 9
    assert audit(d).first().item_sum == 2
