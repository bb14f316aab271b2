"""Record shapes and fixed values of the document-record contract.

The tables below are *fixed values*: they must equal the record contract
exactly for results to match (codes, severities, messages, allowlists).
They are stated plainly, in natural order, in one place.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Document types, severities, statuses.
# ---------------------------------------------------------------------------
DOCUMENT_TYPES = ("invoice", "receipt", "purchase_order", "credit_note")
DOCUMENT_TYPES_V1 = ("invoice", "receipt")
SEVERITIES = ("info", "warning", "error")
STATUSES = ("pass", "warning", "fail")
SCHEMA_VERSION = "2.0"
SCHEMA_VERSION_V1 = "1.0"

# ---------------------------------------------------------------------------
# The 33 recognised ISO 4217 currency codes (case-sensitive).
# ---------------------------------------------------------------------------
KNOWN_CURRENCIES = (
    "AED", "AUD", "BDT", "BRL", "CAD", "CHF", "CNY", "CZK", "DKK", "EUR", "GBP",
    "HKD", "IDR", "ILS", "INR", "JPY", "KRW", "MXN", "MYR", "NOK", "NZD", "PHP",
    "PLN", "RUB", "SAR", "SEK", "SGD", "THB", "TRY", "TWD", "USD", "VND", "ZAR",
)

# ---------------------------------------------------------------------------
# Issue codes (v2), legacy v1 codes, loader notice codes.
# ---------------------------------------------------------------------------
ISSUE_CODES = (
    "LINE_AMOUNT_MISMATCH",
    "SUBTOTAL_MISMATCH",
    "TOTAL_MISMATCH",
    "INVALID_DATE",
    "DUE_BEFORE_ISSUE",
    "DELIVERY_BEFORE_ISSUE",
    "UNKNOWN_CURRENCY",
    "MISSING_IDENTIFIER",
    "MISSING_REFERENCE",
    "NO_LINE_ITEMS",
    "NEGATIVE_VALUE",
    "BALANCED_REVERSAL",
    "DUPLICATE_LINE",
    "CREDIT_SIGN_INCONSISTENCY",
    "CREDIT_TOTAL_UNVERIFIABLE",
)
ISSUE_CODES_V1 = (
    "LINE_AMOUNT_MISMATCH",
    "SUBTOTAL_MISMATCH",
    "TOTAL_MISMATCH",
    "INVALID_DATE",
    "DUE_BEFORE_ISSUE",
    "UNKNOWN_CURRENCY",
    "MISSING_IDENTIFIER",
    "NO_LINE_ITEMS",
    "NEGATIVE_VALUE",
    "BALANCED_REVERSAL",
    "DUPLICATE_LINE",
)
NOTICE_CODES = (
    "NO_NATIVE_TEXT",
    "CSV_DIALECT_FALLBACK",
    "XLSX_HIDDEN_SHEET_SKIPPED",
    "XLSX_FORMULA_PRESENT",
    "XLSX_FORMULA_CACHE_MISSING",
)

# ---------------------------------------------------------------------------
# Issue messages and expected-value texts.
# ---------------------------------------------------------------------------
MSG_INVALID_DATE = "Date must be a real calendar date in YYYY-MM-DD format"
MSG_DUE_BEFORE_ISSUE = "Due date precedes issue date"
MSG_DELIVERY_BEFORE_ISSUE = "Delivery date precedes issue date"
MSG_UNKNOWN_CURRENCY = "Currency is absent or is not a recognized ISO 4217 code"
MSG_MISSING_IDENTIFIER = "Document identifier is absent"
MSG_MISSING_REFERENCE = "Credit note does not identify the referenced document"
MSG_NO_LINE_ITEMS = "No line items were extracted"
MSG_BALANCED_REVERSAL = "Negative line exactly reverses a positive line"
MSG_LINE_AMOUNT_MISMATCH = "Quantity multiplied by unit price differs from line amount"
MSG_DUPLICATE_LINE = "Adjacent line item exactly duplicates the previous line"
MSG_NEGATIVE_VALUE = "Negative values are unsupported for this document type"
MSG_CREDIT_SIGN = "Credit-note monetary values do not form one supported sign profile"
MSG_CREDIT_NO_POLARITY = (
    "Credit-note polarity cannot be established from non-zero monetary values"
)
MSG_CREDIT_INCOMPLETE = (
    "Credit-note arithmetic cannot be fully verified because values are absent"
)
MSG_SUBTOTAL_MISMATCH = "Sum of line amounts differs from subtotal"
MSG_TOTAL_MISMATCH = "Subtotal minus discount plus tax and shipping differs from total"

EXPECTED_DATE = "YYYY-MM-DD"
EXPECTED_CURRENCY = "ISO 4217 code"
EXPECTED_NON_NEGATIVE = "non-negative"
EXPECTED_CREDIT_SIGN = "all non-zero values positive-magnitude or all negative-signed"
EXPECTED_CREDIT_COMPLETE = "line amounts, subtotal, and total"

# ---------------------------------------------------------------------------
# Loader notices (code, severity, message).
# ---------------------------------------------------------------------------
NOTICE_NO_NATIVE_TEXT = (
    "NO_NATIVE_TEXT", "info", "No native PDF text found; extraction uses rendered pages",
)
NOTICE_CSV_DIALECT_FALLBACK = (
    "CSV_DIALECT_FALLBACK", "warning",
    "CSV dialect could not be detected; comma delimiter was used",
)
NOTICE_XLSX_FORMULA_PRESENT = (
    "XLSX_FORMULA_PRESENT", "warning",
    "XLSX formulas are preserved as text and are not executed",
)
NOTICE_XLSX_FORMULA_CACHE_MISSING = (
    "XLSX_FORMULA_CACHE_MISSING", "warning", "One or more XLSX formulas have no cached value",
)
# The hidden-sheet notice message carries a count: "<n> hidden XLSX sheet(s) were skipped".
NOTICE_XLSX_HIDDEN_CODE = "XLSX_HIDDEN_SHEET_SKIPPED"
NOTICE_XLSX_HIDDEN_SUFFIX = " hidden XLSX sheet(s) were skipped"

# ---------------------------------------------------------------------------
# Outcome codes of a run.
# ---------------------------------------------------------------------------
EXIT_OK = 0
EXIT_REVIEW_REQUIRED = 2
EXIT_INPUT_ERROR = 3
EXIT_PROVIDER_ERROR = 4
EXIT_SCHEMA_ERROR = 5

# Header fields compared by the evaluator, then the vendor fields, then decimals.
HEADER_FIELDS = (
    "document_type",
    "document_id",
    "reference_document_id",
    "customer_name",
    "issue_date",
    "due_date",
    "delivery_date",
    "currency",
    "subtotal",
    "discount",
    "tax",
    "shipping",
    "total",
)
VENDOR_FIELDS = ("name", "tax_id", "address")
MONEY_FIELDS = ("subtotal", "discount", "tax", "shipping", "total")
LINE_FIELDS = ("description", "quantity", "unit_price", "amount")
LINE_MONEY_FIELDS = ("quantity", "unit_price", "amount")

# ---------------------------------------------------------------------------
# Spark shapes.  Money travels as its plain-decimal *string* (the record
# contract); operators derive decimal(18,6) values from it where they compute.
# ---------------------------------------------------------------------------
S = T.StringType()

VENDOR = T.StructType([T.StructField(f, S) for f in VENDOR_FIELDS])
LINE_ITEM = T.StructType([T.StructField(f, S) for f in LINE_FIELDS])
NOTICE = T.StructType(
    [
        T.StructField("code", S),
        T.StructField("severity", S),
        T.StructField("message", S),
        T.StructField("field", S),
    ]
)
ISSUE = T.StructType(
    [
        T.StructField("code", S),
        T.StructField("severity", S),
        T.StructField("message", S),
        T.StructField("field", S),
        T.StructField("expected", S),
        T.StructField("actual", S),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("document_type", S),
        T.StructField("document_id", S),
        T.StructField("reference_document_id", S),
        T.StructField("vendor", VENDOR),
        T.StructField("customer_name", S),
        T.StructField("issue_date", S),
        T.StructField("due_date", S),
        T.StructField("delivery_date", S),
        T.StructField("currency", S),
        T.StructField("line_items", T.ArrayType(LINE_ITEM)),
        T.StructField("subtotal", S),
        T.StructField("discount", S),
        T.StructField("tax", S),
        T.StructField("shipping", S),
        T.StructField("total", S),
    ]
)
SOURCE = T.StructType(
    [
        T.StructField("file_name", S),
        T.StructField("media_type", S),
        T.StructField("byte_count", T.LongType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("sheet_count", T.IntegerType()),
        T.StructField("sha256", S),
        T.StructField("notices", T.ArrayType(NOTICE)),
    ]
)
VALIDATION = T.StructType(
    [
        T.StructField("status", S),
        T.StructField("review_required", T.BooleanType()),
        T.StructField("issues", T.ArrayType(ISSUE)),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("schema_version", S),
        T.StructField("source", SOURCE),
        T.StructField("document", DOCUMENT),
        T.StructField("validation", VALIDATION),
    ]
)

# Header columns of the flat header table used by the operators.
HEADER_COLUMNS = (
    "document_type",
    "document_id",
    "reference_document_id",
    "vendor",
    "customer_name",
    "issue_date",
    "due_date",
    "delivery_date",
    "currency",
    "subtotal",
    "discount",
    "tax",
    "shipping",
    "total",
)
