"""Retyped record builders for rule tests (base record: one invoice with one line)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docaudit import schema as S

HEADER_DDL = (
    "doc_key bigint, document_type string, document_id string, reference_document_id string, "
    "vendor struct<name:string,tax_id:string,address:string>, customer_name string, issue_date string, "
    "due_date string, delivery_date string, currency string, subtotal string, discount string, tax string, "
    "shipping string, total string"
)
LINE_DDL = "doc_key bigint, idx int, document_type string, description string, quantity string, unit_price string, amount string"
NOTICE_DDL = "doc_key bigint, pos int, code string, severity string, message string, field string"

BASE = {
    "document_type": "invoice",
    "document_id": "INV-1",
    "reference_document_id": None,
    "vendor": ("Vendor", None, None),
    "customer_name": None,
    "issue_date": "2024-02-29",
    "due_date": "2024-03-30",
    "delivery_date": None,
    "currency": "USD",
    "line_items": [("Item", "2", "5", "10")],
    "subtotal": "10",
    "discount": None,
    "tax": "1",
    "shipping": None,
    "total": "11",
}


def make(**updates):
    d = dict(BASE)
    d.update(updates)
    return d


def tables(spark: SparkSession, docs: list[dict]):
    heads, lines = [], []
    for key, d in enumerate(docs):
        heads.append((key, *[d[c] for c in S.HEADER_COLUMNS]))
        for i, li in enumerate(d["line_items"]):
            lines.append((key, i, d["document_type"], *li))
    return spark.createDataFrame(heads, HEADER_DDL), spark.createDataFrame(lines, LINE_DDL)
