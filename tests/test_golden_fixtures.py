"""Golden: the 11 sample fixtures (values retyped as rows) reproduce the published summary.

Validating the ground truth (plus the one loader notice) must yield exactly
the manifest's expected issue codes, and the evaluation of identical outputs
must give: 11 processed / schema-valid, header 176/176, decimals 55/55,
lines TP 15, issues TP 4, no hallucinations.  Mutations reproduce the
evaluator cases (unexpected + missing code -> P = R = F1 = 0.75, etc.).
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from builders import HEADER_DDL, LINE_DDL, NOTICE_DDL
from docaudit import schema as S
from docaudit.operators import evaluate as E
from docaudit.operators.validate import validate

# Fixed test data: the records whose published totals must come out.
# id, format, layout, type, document_id, reference, vendor, customer, issue, due, delivery, currency,
# lines, subtotal, discount, tax, shipping, total, expected codes
FIXTURES = [
    ("credit_note_a", "text", "credit-note-compact", "credit_note", "CN-104", "INV-900", ("Beacon Services", None, None),
     "Rooman Labs", "2026-08-15", None, None, "USD", [("Service adjustment", "1", "100.00", "100.00")],
     "100.00", None, "8.00", None, "108.00", []),
    ("credit_note_b", "csv", "credit-note-records", "credit_note", "CN-205", "INV-901", ("Beacon Services", None, None),
     "Rooman Labs", "2026-08-16", None, None, "USD", [("Service adjustment", "1", "-100.00", "-100.00")],
     "-100.00", None, "-8.00", None, "-108.00", []),
    ("invoice_a", "pdf", "traditional-table", "invoice", "INV-20491", None,
     ("ACME Technologies Pvt Ltd", "GSTIN29ABCDE1234F1Z5", "Bengaluru, India"), "Rooman Labs", "2026-08-12",
     "2026-08-26", None, "INR", [("GPU Server", "2", "150000.00", "300000.00"), ("Support Plan", "1", "20000.00", "20000.00")],
     "320000.00", None, "57600.00", None, "377600.00", []),
    ("invoice_b", "image", "modern-two-column", "invoice", "NS-882", None, ("Northstar Design", None, None), None,
     "2026-08-11", None, None, "USD", [("Brand identity package", "1", "900.00", "900.00"), ("Print proofs", "3", "25.00", "75.00")],
     "975.00", "75.00", None, None, "900.00", []),
    ("invoice_c", "text", "compact-text", "invoice", None, None, ("Delta Office Supply", None, "Austin, TX"), None,
     "2026-08-10", None, None, "USD", [("Paper cartons", "4", "12.50", "50.00")], "50.00", None, None, None, "50.00",
     ["MISSING_IDENTIFIER"]),
    ("invoice_d", "pdf", "scanned-table", "invoice", "EP-140", None, ("Europa Parts", "DE123456789", "Berlin, Germany"),
     "Example Robotics", "2026-08-09", "2026-08-08", None, "EUR", [("Precision bearing", "5", "18.00", "90.00")],
     "90.00", None, None, "10.00", "100.00", ["DUE_BEFORE_ISSUE", "NO_NATIVE_TEXT"]),
    ("invoice_mismatch", "pdf", "table-mismatch", "invoice", "OC-404", None, ("Orbital Components", None, None),
     "Demo Manufacturing", "2026-08-13", None, None, "USD", [("Sensor array", "2", "125.00", "250.00")],
     "250.00", None, "25.00", None, "270.00", ["TOTAL_MISMATCH"]),
    ("purchase_order_a", "text", "purchase-order-table", "purchase_order", "PO-6021", None,
     ("Atlas Industrial Supply", None, "Denver, CO"), "Rooman Manufacturing", "2026-08-14", None, "2026-08-28", "USD",
     [("Control Module", "3", "40.00", "120.00")], "120.00", None, None, "15.00", "135.00", []),
    ("purchase_order_b", "xlsx", "multi-sheet-purchase-order", "purchase_order", "PO-7102", None,
     ("Meridian Components", None, "Toronto, Canada"), "Rooman Manufacturing", "2026-08-17", None, "2026-08-31", "CAD",
     [("Optical Sensor", "4", "75.00", "300.00")], "300.00", None, "39.00", None, "339.00", []),
    ("receipt_a", "image", "narrow-thermal", "receipt", "R-3019", None, ("Corner Cafe", None, "Seattle, WA"), None,
     "2026-08-13", None, None, "USD", [("Coffee", "2", "3.50", "7.00"), ("Bagel", "1", "4.00", "4.00")],
     "11.00", None, "0.88", None, "11.88", []),
    ("receipt_b", "pdf", "wide-retail", "receipt", "GM-7781", None, ("Green Mart", "GSTIN27EXAMPLE1Z2", "Pune, India"), None,
     "2026-08-12", None, None, "INR", [("Organic rice", "2", "210.00", "420.00"), ("Cooking oil", "1", "180.00", "180.00")],
     "600.00", "20.00", "29.00", None, "609.00", []),
]
NOTICES = [(5, 0, *S.NOTICE_NO_NATIVE_TEXT[:3], None)]  # invoice_d has no native PDF text


@pytest.fixture(scope="module")
def golden(spark):
    heads, lines, manifest = [], [], []
    for key, f in enumerate(FIXTURES):
        (_id, fmt, layout, typ, doc_id, ref, vendor, cust, issue, due, deliv, cur, lis, sub, disc, tax, ship, tot, codes) = f
        heads.append((key, typ, doc_id, ref, vendor, cust, issue, due, deliv, cur, sub, disc, tax, ship, tot))
        lines += [(key, i, typ, *li) for i, li in enumerate(lis)]
        manifest.append((key, fmt, layout, typ, codes))
    h = spark.createDataFrame(heads, HEADER_DDL)
    li = spark.createDataFrame(lines, LINE_DDL)
    n = spark.createDataFrame(NOTICES, NOTICE_DDL)
    m = spark.createDataFrame(manifest, "doc_key bigint, format string, layout string, document_type string, expected_codes array<string>")
    v = validate(h, li, n, materialize=False)
    codes = v.issues.select("doc_key", "code")
    return h, li, m, codes


def _inputs(h, li, m, codes, pred_headers=None):
    return E.EvalInputs(
        gold_headers=h.withColumn("schema_valid", F.lit(True)),
        gold_lines=li,
        pred_headers=pred_headers if pred_headers is not None else h.withColumn("schema_valid", F.lit(True)),
        pred_lines=li,
        pred_codes=codes,
        manifest=m,
    )


def test_rules_reproduce_expected_codes(golden):
    h, li, m, codes = golden
    got = {}
    for r in codes.collect():
        got.setdefault(r.doc_key, set()).add(r.code)
    for key, f in enumerate(FIXTURES):
        assert got.get(key, set()) == set(f[-1]), f[0]


def test_summary_numbers(golden):
    h, li, m, codes = golden
    inp = _inputs(h, li, m, codes)
    fx = E.fixtures(inp)
    rep = {(r.section, r.item): (r.numerator, r.denominator) for r in E.report(inp, fx).collect()}
    assert rep["processing", "processed"] == (11, 11) and rep["processing", "schema_valid"] == (11, 11)
    assert rep["header_exact_match", "matched"] == (176, 176)
    assert rep["decimal_accuracy", "matched"] == (55, 55)
    assert rep["line_items", "precision"] == (15, 15) and rep["line_items", "f1"] == (10_000, 10_000)
    assert rep["validation_detection", "recall"] == (4, 4) and rep["validation_detection", "f1"] == (10_000, 10_000)
    assert rep["hallucinations", "count"] == (0, None)
    assert rep["breakdown", "format=pdf processed"] == (4, 4)
    assert not any(section == "failures" for section, _ in rep)
    bd = {(r.dimension, r.grp): r.fixtures for r in E.breakdown(fx).collect()}
    assert {g: n for (d, g), n in bd.items() if d == "format"} == {"csv": 1, "image": 2, "pdf": 4, "text": 3, "xlsx": 1}
    assert {g: n for (d, g), n in bd.items() if d == "document_type"} == {
        "credit_note": 2, "invoice": 5, "purchase_order": 2, "receipt": 2}


def test_unexpected_and_missing_code(golden, spark):
    h, li, m, codes = golden
    # invoice_a gains invoice_c's code, invoice_c loses it
    mutated = codes.filter(F.col("doc_key") != 4).unionByName(
        spark.createDataFrame([(2, "MISSING_IDENTIFIER")], "doc_key bigint, code string"))
    inp = _inputs(h, li, m, mutated)
    r = E.issue_code_prf(inp, E.fixtures(inp)).collect()[0]
    assert (r.found, r.expected, r.predicted) == (3, 4, 4)
    assert (r.precision, r.recall, r.f1) == (0.75, 0.75, 0.75)


def test_missing_and_invalid_output(golden):
    h, li, m, codes = golden
    missing = _inputs(h, li, m, codes, h.filter(F.col("doc_key") != 4).withColumn("schema_valid", F.lit(True)))
    fx = E.fixtures(missing)
    assert E.processing_validity(fx).collect()[0].processed == 10
    r = E.issue_code_prf(missing, fx).collect()[0]
    assert (r.expected, r.false_negative, r.recall) == (4, 1, 0.75)
    assert [x.fixture for x in E.failures(fx).collect()] == [4]
    invalid = _inputs(h, li, m, codes, h.withColumn("schema_valid", F.col("doc_key") != 6))
    fx = E.fixtures(invalid)
    pv = E.processing_validity(fx).collect()[0]
    assert (pv.processed, pv.schema_valid) == (11, 10)
    r = E.issue_code_prf(invalid, fx).collect()[0]
    assert (r.expected, r.false_negative) == (4, 1)
