"""Steps whose cost must follow the rows, not the length of their expressions."""

from __future__ import annotations

import decimal
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from docaudit import session
from docaudit.functions.money import decimal_of, plain, product_differs, sum_differs
from docaudit.functions.text import json_string
from docaudit.operators import evaluate as E
from docaudit.operators import strict_json as J
from docaudit.operators.extract import replay_extract
from docaudit.operators.validate import prepare_lines, reversal_pairs, validate

LINES = "doc_key bigint, idx int, document_type string, description string, quantity string, unit_price string, amount string"


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_issue_candidates_are_made_once(spark, capsys):
    """No filter on the size of the candidates: it would compute all of them below the explode too."""
    headers = spark.createDataFrame([(1, "invoice")], "doc_key bigint, document_type string")
    lines = spark.createDataFrame(
        [(1, 0, "invoice", "x", "2", "3.00", "6.01"), (1, 1, "invoice", "x", "2", "3.00", "6.02"), (1, 2, "invoice", "x", None, "3.00", "6.02"),
         (1, 3, "invoice", "y", "2", "100000000000001000.005", "200000000000002000.03")], LINES)
    found = validate(headers, lines, codes=("LINE_AMOUNT_MISMATCH",)).issues
    plan = _plan(found, capsys)
    assert "size(filter(" not in plan and "inline(filter(" not in plan
    assert [tuple(r) for r in found.select("field", "expected", "actual").orderBy("field").collect()] == [
        ("line_items.1.amount", "6.00", "6.02"), ("line_items.3.amount", "200000000000002000.010", "200000000000002000.03")
    ]


def test_offsets_are_counted_for_documents_beyond_a_block_only(spark, capsys):
    rows = [(1, i, "invoice", "x", "1", "-1" if i % 2 else "1", "-1" if i % 2 else "1") for i in range(7)] + [(2, 0, "invoice", "x", "1", "1", "1"), (2, 1, "invoice", "x", "1", "-1", "-1")]
    pairs = reversal_pairs(prepare_lines(spark.createDataFrame(rows, LINES)), block_size=2)
    assert "LeftSemi" in _plan(pairs, capsys)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 1, 0), (1, 3, 2), (1, 5, 4), (2, 1, 0)]


def test_long_money_is_judged_as_in_python(spark):
    r, context = random.Random(5), decimal.Context(prec=120)

    def number(whole: int, places: int) -> str:
        digits = r.randint(0, places)
        text = str(r.randint(0, 10 ** r.randint(0, whole))) + ("." + "".join(r.choice("0123456789") for _ in range(digits)) if digits else "")
        return r.choice(("", "", "-")) + text

    rows = []
    for n in range(600):
        x, y = number(20, 15) if n % 2 else number(6, 4), number(5, 3)
        product = context.multiply(Decimal(x), Decimal(y))
        off = r.choice(("0", "0.01", "-0.01", "0.010001", "0.02", "0.0000000000001"))
        z = context.add(product, Decimal(off))
        rows.append((x, y, format(z, "f"), abs(context.subtract(product, z)) > Decimal("0.01")))
    df = spark.createDataFrame(rows, "x string, y string, z string, expected boolean")
    df = df.select("expected", *[plain(F.col(c)).alias(c) for c in "xyz"]).select("*", *[decimal_of(F.col(c)).alias(c + "d") for c in "xyz"])
    bound = F.lit("0.01").cast("decimal(18,6)")
    got = df.select("expected", sum_differs([(1, (F.col("x"), F.col("y"))), (-1, (F.col("z"),))], bound), product_differs(F.col("xd"), F.col("yd"), F.col("zd"), bound)).collect()
    assert all(found in (None, want) for want, *both in got for found in both)
    assert sum(row[1] is not None for row in got) > 550 and sum(row[2] is not None for row in got) > 250


def test_json_string(spark):
    texts = ["a]", "]", 'x"]]\\', "", "é\n", None]
    rows = spark.createDataFrame([(x,) for x in texts], "c string").select(json_string(F.col("c"))).collect()
    assert [r[0] for r in rows] == ['"a]"', '"]"', '"x\\"]]\\\\"', '""', '"é\\n"', "null"]


ITEM = {"description": "Item", "quantity": "2", "unit_price": "5", "amount": None}
RECORD = {
    "document_type": "invoice", "document_id": "A", "reference_document_id": None, "vendor": {"name": "V", "tax_id": None, "address": None},
    "customer_name": None, "issue_date": None, "due_date": None, "delivery_date": None, "currency": "USD", "line_items": [ITEM, ITEM],
    "subtotal": "10", "discount": None, "tax": "-1.50", "shipping": None, "total": "123456789012345678901.5",
}


def test_records_are_checked_without_a_shuffle(spark, capsys):
    """Also of rows that share a key, each has its own errors."""
    lacking, more = {k: v for k, v in ITEM.items() if k != "amount"}, ITEM | {"extra": "x"}
    value, form = "line_items.%d.quantity: value_error", "line_items.%d: model_type"
    cases = [
        ({}, "", True),
        ({"line_items": []}, "", True),
        ({"line_items": [ITEM] * 300}, "", True),
        ({"line_items": [ITEM, lacking]}, "line_items.1.amount: missing", False),
        ({"line_items": [ITEM, lacking, more]}, "line_items.1.amount: missing; line_items.2.extra: extra_forbidden", False),
        ({"line_items": [None]}, form % 0, False),
        ({"line_items": [ITEM, None, 5]}, f"{form % 1}; {form % 2}", False),
        ({"line_items": None}, "line_items: list_type", False),
        ({"line_items": [ITEM | {"quantity": 2}, ITEM, ITEM | {"quantity": "2\n3"}]}, f"{value % 0}; {value % 2}", False),
        ({"line_items": [{"unit_price": "5", "amount": 1, "b": 1, "a": 1}]},
         "line_items.0.description: missing; line_items.0.quantity: missing; line_items.0.amount: value_error; line_items.0.a: extra_forbidden; line_items.0.b: extra_forbidden", False),
        ({"vendor": None}, "vendor: model_type", False),
        ({"vendor": {"name": 5, "tax_id": None}}, "vendor.name: string_type; vendor.address: missing", False),
        ({"total": 5, "currency: STRING, customer_name": "x"}, "total: value_error; currency: STRING, customer_name: extra_forbidden", False),
        ({"total": "007", "document_type": None}, "document_type: literal_error; total: value_error", False),
    ]
    df = spark.createDataFrame([(i // 2, i, json.dumps(RECORD | c)) for i, (c, _, _) in enumerate(cases)], "doc_key long, i int, json string")
    parsed = J.parse_documents(df, materialize=False)
    plan = _plan(parsed.select("i", "schema_valid", "errors"), capsys)
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.i: r for r in parsed.select("i", "schema_valid", J.error_summary(F.col("errors")).alias("e"), "document").collect()}
    assert len(got) == len(cases)
    for i, (changes, errors, sound) in enumerate(cases):
        assert (got[i].e, got[i].schema_valid) == (errors, sound), i
        assert (got[i].document is not None) == sound
        if sound:
            assert [x.asDict() for x in got[i].document.line_items] == (RECORD | changes)["line_items"]
    # sound records pass the cheap test, so their fields are not looked at one by one
    quick = J.parsed_json(df, "json").select("i", J._quick_ok(F.col("_v"), J.document_spec()).alias("q")).collect()
    assert {r.i: r.q for r in quick} == {i: sound for i, (_, _, sound) in enumerate(cases)}


def test_rows_that_share_a_key_can_share_their_line_errors(spark):
    bad = RECORD | {"line_items": [ITEM, ITEM | {"quantity": 2}]}
    texts = [(1, bad), (1, bad | {"total": 1}), (1, RECORD), (2, bad), (3, RECORD), (1, RECORD | {"line_items": None})]
    df = spark.createDataFrame([(k, i, json.dumps(x)) for i, (k, x) in enumerate(texts)] + [(1, 6, "{")], "doc_key long, i int, json string")
    parsed = J.parse_documents(df, materialize=False, shared="doc_key").select("i", "schema_valid", J.error_summary(F.col("errors")).alias("e"))
    one = "line_items.1.quantity: value_error"
    two = f"{one}; {one}"
    assert sorted((r.i, r.schema_valid, r.e) for r in parsed.collect()) == [
        (0, False, two), (1, False, f"{two}; total: value_error"), (2, False, two), (3, False, one), (4, True, ""),
        (5, False, "line_items: list_type"), (6, False, "root: json_invalid"),
    ]


def test_replay_writes_its_outcome_once_without_the_text(spark):
    loaded = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "c.pdf"), (4, None)], "doc_key long, file_name string")
    answers = spark.createDataFrame([("a.pdf", json.dumps(RECORD)), ("a.json", "{"), ("b.json", "{")], "name string, json string")
    before = len(session._WRITTEN.get(spark.sparkContext.applicationId, []))
    out = replay_extract(loaded, answers)
    written = session._WRITTEN[spark.sparkContext.applicationId][before:]
    assert len(written) == 1 and "json" not in spark.read.parquet(written[0]).columns
    assert sorted(tuple(r) for r in out.select("doc_key", "outcome", "error").collect()) == [
        (1, "ok", None), (2, "schema_error", "stored answer is no valid record: root: json_invalid"), (3, "provider_error", "no stored answer for c.pdf"), (4, "provider_error", None)
    ]


def test_lines_are_shuffled_once_to_be_scored(spark, capsys):
    line = "doc_key bigint, idx int, description string, quantity string, unit_price string, amount string"
    gold = [(1, i, "x", "1", "1.0", None) for i in range(3)] + [(1, 3, None, None, None, "5"), (1, 4, "5", None, None, None), (2, 0, "x", "1", "1", "1"), (None, 0, "x", "1", "1", "1")]
    pred = [(1, 0, " X", "1.00", "1", None), (1, 1, "x", "1", None, "1"), (1, 2, "=5", None, None, None), (1, 3, None, None, "5", None), (2, 0, "y", "1", "1", "1"), (None, 0, "x", "1", "1", "1")]
    g, p = spark.createDataFrame(gold, line), spark.createDataFrame(pred, line)
    fx = spark.createDataFrame([(1, "compared"), (2, "invalid_output"), (None, "compared")], "doc_key bigint, branch string")
    scores = E.line_item_prf(E.EvalInputs(None, g, None, p, None, None), fx)
    plan = _plan(scores, capsys)
    assert plan.count("Exchange hashpartitioning(doc_key#") - plan.count("ReusedExchange") <= 3 and "FullOuter" not in plan
    assert tuple(scores.select("true_positive", "false_positive", "false_negative").first()) == (1, 3, 4)
