"""Rule cases retyped as rows (one rule per case on a base record)."""

from __future__ import annotations

import pytest

from builders import NOTICE_DDL, make, tables
from docaudit.operators.validate import validate


def run(spark, *docs, notices=None, block_size=4096):
    h, l = tables(spark, list(docs))
    n = spark.createDataFrame(notices, NOTICE_DDL) if notices else None
    v = validate(h, l, n, block_size=block_size, materialize=False)
    nested = {r.doc_key: r.validation for r in v.nested().collect()}
    return [nested[i] for i in range(len(docs))]


def codes(val):
    return [i.code for i in val.issues]


def test_clean_document_passes(spark):
    (v,) = run(spark, make())
    assert v.status == "pass" and v.review_required is False and v.issues == []


def test_line_amount_tolerance_boundary(spark):
    a, b = run(spark, make(line_items=[("Item", "2", "5", "10.01")]), make(line_items=[("Item", "2", "5", "10.02")]))
    assert "LINE_AMOUNT_MISMATCH" not in codes(a)
    issue = [i for i in b.issues if i.code == "LINE_AMOUNT_MISMATCH"][0]
    assert (issue.field, issue.expected, issue.actual) == ("line_items.0.amount", "10", "10.02")


def test_subtotal_and_total(spark):
    a, b = run(spark, make(subtotal="12", total="13"), make(total="99"))
    assert "SUBTOTAL_MISMATCH" in codes(a)
    t = [i for i in b.issues if i.code == "TOTAL_MISMATCH"][0]
    assert (t.expected, t.actual) == ("11", "99")


@pytest.mark.parametrize("value", ["2023-02-29", "08/13/2026", "2026-8-03", "not-a-date", "0000-01-01"])
def test_invalid_dates(spark, value):
    (v,) = run(spark, make(issue_date=value))
    assert "INVALID_DATE" in codes(v)


def test_dates_order(spark):
    a, b, c = run(
        spark,
        make(issue_date="2024-02-29"),
        make(issue_date="2026-08-13", due_date="2026-08-12"),
        make(document_type="purchase_order", document_id="PO-1", issue_date="2026-08-13", due_date=None,
             delivery_date="2026-08-12"),
    )
    assert codes(a) == []
    assert "DUE_BEFORE_ISSUE" in codes(b)
    assert codes(c) == ["DELIVERY_BEFORE_ISSUE"] and c.status == "warning" and c.review_required


@pytest.mark.parametrize("currency", [None, "XYZ", "usd"])
def test_unknown_currency(spark, currency):
    (v,) = run(spark, make(currency=currency))
    assert "UNKNOWN_CURRENCY" in codes(v)


def test_missing_identifier_and_no_lines(spark):
    (v,) = run(spark, make(document_id=None, line_items=[], subtotal=None, total=None))
    assert "MISSING_IDENTIFIER" in codes(v) and "NO_LINE_ITEMS" in codes(v)


def test_balanced_reversal_case_and_spacing(spark):
    lines = [("Service Fee", "1", "50", "50"), ("  service   FEE ", "1", "-50", "-50")]
    (v,) = run(spark, make(line_items=lines, subtotal="0", tax=None, total="0"))
    assert codes(v) == ["BALANCED_REVERSAL"] and v.status == "pass"
    i = v.issues[0]
    assert (i.field, i.expected, i.actual) == ("line_items.1", "line_items.0", "line_items.1")


def test_one_positive_two_reversals(spark):
    lines = [("Fee", "1", "50", "50"), ("Fee", "1", "-50", "-50"), ("Fee", "1", "-50", "-50")]
    (v,) = run(spark, make(line_items=lines, subtotal="-50", tax=None, total="-50"))
    assert codes(v).count("BALANCED_REVERSAL") == 1
    neg = [i for i in v.issues if i.code == "NEGATIVE_VALUE"]
    assert {i.field for i in neg} >= {"line_items.2.unit_price", "line_items.2.amount"}


def test_duplicate_adjacent_line(spark):
    (v,) = run(spark, make(line_items=[("Item", "2", "5", "10"), ("Item", "2.0", "5.00", "10")], subtotal="20", total="21"))
    assert "DUPLICATE_LINE" in codes(v)


def test_credit_note_profiles(spark):
    pos = make(document_type="credit_note", reference_document_id="INV-1")
    neg = make(document_type="credit_note", reference_document_id="INV-1",
               line_items=[("Item", "2", "-5", "-10")], subtotal="-10", discount="-1", tax="-1", total="-10")
    a, b = run(spark, pos, neg)
    assert a.status == "pass" and b.status == "pass"


@pytest.mark.parametrize("updates,actual", [({"total": "-11"}, "line_items.0.amount, subtotal, total"),
                                             ({"tax": "-1", "total": "9"}, "tax"),
                                             ({"discount": "-1", "total": "12"}, "discount")])
def test_credit_sign_inconsistency(spark, updates, actual):
    (v,) = run(spark, make(document_type="credit_note", reference_document_id="INV-1", **updates))
    assert codes(v) == ["CREDIT_SIGN_INCONSISTENCY"]
    assert v.issues[0].actual == actual


def test_credit_total_unverifiable(spark):
    (v,) = run(spark, make(document_type="credit_note", reference_document_id="INV-1", total=None))
    assert "CREDIT_TOTAL_UNVERIFIABLE" in codes(v)
    assert [i.actual for i in v.issues if i.code == "CREDIT_TOTAL_UNVERIFIABLE"] == ["total"]


def test_info_notice_visible_and_pass(spark):
    (v,) = run(spark, make(), notices=[(0, 0, "NO_NATIVE_TEXT", "info", "No native PDF text found", None)])
    assert codes(v) == ["NO_NATIVE_TEXT"] and v.status == "pass" and v.review_required is False


def test_scales_of_expected_text(spark):
    (v,) = run(spark, make(line_items=[("Item", "4", "12.50", "49.00")], subtotal="49.00", tax="1.5", total="60"))
    li = [i for i in v.issues if i.code == "LINE_AMOUNT_MISMATCH"][0]
    tot = [i for i in v.issues if i.code == "TOTAL_MISMATCH"][0]
    assert li.expected == "50.00" and tot.expected == "50.50"
