"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the rule definitions, not generated from the Spark plans: plain
CTEs, brute-force window ranks, fixed money scales of the adapter (quantities
scale 0, prices and amounts scale 2).
"""

from __future__ import annotations

from docaudit import schema as S

_CURRENCIES = ", ".join(f"'{c}'" for c in S.KNOWN_CURRENCIES)

# --------------------------------------------------------------------------- adapter
ADAPTER = """
li AS (
  SELECT l.l_orderkey AS doc_key, l.l_partkey AS pk, l.l_quantity, p.p_name, p.p_retailprice,
         CASE WHEN l.l_partkey % 17 = 0 THEN 1 ELSE 0 END AS has_dup,
         CASE WHEN l.l_partkey % 10 = 0 THEN 1 ELSE 0 END AS has_rev,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey,
                            l.l_suppkey, l.l_extendedprice, l.l_quantity) AS rn
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
li2 AS (
  SELECT *,
         coalesce(sum(1 + has_dup + has_rev) OVER (PARTITION BY doc_key ORDER BY rn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_idx,
         CASE WHEN doc_key % 8 = 3 THEN -1 ELSE 1 END AS sgn,
         CAST(l_quantity AS DECIMAL(18,0)) AS q0,
         CAST(p_retailprice AS DECIMAL(18,2)) AS u0,
         CASE WHEN pk % 23 = 0 THEN CAST(0.02 AS DECIMAL(18,2))
              WHEN pk % 29 = 0 THEN CAST(0.01 AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS adj
  FROM li
),
base AS (
  SELECT doc_key, pk, first_idx, has_dup, has_rev,
         CASE WHEN (pk + doc_key) % 37 = 0 THEN NULL ELSE p_name END AS description,
         q0 AS q,
         CAST(u0 * sgn AS DECIMAL(18,2)) AS u,
         CASE WHEN (pk + doc_key) % 31 = 0 THEN NULL
              ELSE CAST((q0 * u0 + adj) * sgn AS DECIMAL(18,2)) END AS a
  FROM li2
),
doc_line AS (
  SELECT doc_key, CAST(first_idx AS INTEGER) AS idx, description, q, u, a FROM base
  UNION ALL
  SELECT doc_key, CAST(first_idx + 1 AS INTEGER), description, q, u, a FROM base WHERE has_dup = 1
  UNION ALL
  SELECT doc_key, CAST(first_idx + 1 + has_dup AS INTEGER), '  ' || upper(description), q, -u, -a
  FROM base WHERE has_rev = 1
),
line_sums AS (SELECT doc_key, sum(a) AS line_sum FROM doc_line GROUP BY doc_key),
hdr0 AS (
  SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS od, c.c_name, c.c_nationkey, n.n_name,
         CASE WHEN o.o_orderkey % 8 = 3 THEN -1 ELSE 1 END AS sgn,
         CAST(coalesce(s.line_sum, 0) AS DECIMAL(18,2)) AS line_sum
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN line_sums s ON s.doc_key = o.o_orderkey
),
hdr1 AS (
  SELECT *,
         CASE k % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'purchase_order'
              ELSE 'credit_note' END AS document_type,
         CASE WHEN k % 47 = 0 THEN NULL
              ELSE CAST(line_sum + CASE WHEN k % 19 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) END AS subtotal_d,
         CASE WHEN k % 6 = 0 THEN CAST(sgn * 10 AS DECIMAL(18,2)) END AS discount_d,
         CASE WHEN k % 5 <> 0 THEN CAST(sgn * CASE WHEN k % 53 = 0 THEN -8 ELSE 8 END AS DECIMAL(18,2))
              END AS tax_d,
         CAST(NULL AS DECIMAL(18,2)) AS shipping_d
  FROM hdr0
),
doc_header AS (
  SELECT k AS doc_key, document_type,
         CASE WHEN k % 11 = 0 THEN NULL ELSE 'DOC-' || CAST(k AS VARCHAR) END AS document_id,
         CASE WHEN document_type = 'credit_note' AND k % 3 <> 0 THEN 'DOC-' || CAST(k - 3 AS VARCHAR)
              END AS reference_document_id,
         n_name || ' Supplies' AS vendor_name,
         CASE WHEN k % 10 = 0 THEN NULL ELSE 'VAT-' || CAST(c_nationkey AS VARCHAR) END AS vendor_tax_id,
         CAST(NULL AS VARCHAR) AS vendor_address,
         c_name AS customer_name,
         CASE WHEN k % 13 = 0 THEN '2023-02-29' WHEN k % 43 = 0 THEN '2026-8-03'
              ELSE strftime(od, '%Y-%m-%d') END AS issue_date,
         CASE WHEN k % 7 = 0 THEN NULL
              ELSE strftime(od + CAST(k % 40 - 5 AS INTEGER), '%Y-%m-%d') END AS due_date,
         CASE WHEN document_type = 'purchase_order'
              THEN strftime(od + CAST(k % 30 - 3 AS INTEGER), '%Y-%m-%d') END AS delivery_date,
         CASE k % 9 WHEN 0 THEN 'EUR' WHEN 1 THEN 'INR' WHEN 2 THEN 'usd' WHEN 3 THEN NULL
              ELSE 'USD' END AS currency,
         subtotal_d, discount_d, tax_d, shipping_d,
         CAST(coalesce(subtotal_d, line_sum) - coalesce(discount_d, 0) + coalesce(tax_d, 0)
              + CASE WHEN k % 21 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS total_d
  FROM hdr1
)
"""

# --------------------------------------------------------------------------- rules
RULES = f"""
line_x AS (
  SELECT l.*, h.document_type = 'credit_note' AS is_credit,
         lower(trim(regexp_replace(l.description, '\\s+', ' ', 'g'))) AS nd
  FROM doc_line l JOIN doc_header h USING (doc_key)
),
elig AS (
  SELECT doc_key, idx, nd, abs(q) AS aq, abs(u) AS au, abs(a) AS aa, a < 0 AS neg,
         row_number() OVER (PARTITION BY doc_key, nd, abs(q), abs(u), abs(a), a < 0 ORDER BY idx) AS r
  FROM line_x WHERE description IS NOT NULL AND a IS NOT NULL AND a <> 0
),
pairs AS (
  SELECT n.doc_key, p.idx AS pos_idx, n.idx AS neg_idx
  FROM elig n JOIN elig p
    ON n.doc_key = p.doc_key AND n.nd = p.nd AND n.aq IS NOT DISTINCT FROM p.aq
   AND n.au IS NOT DISTINCT FROM p.au AND n.aa = p.aa AND n.r = p.r
  WHERE n.neg AND NOT p.neg
),
line_r AS (
  SELECT x.*, pn.neg_idx IS NOT NULL AS is_rev_neg,
         (pn.neg_idx IS NOT NULL OR pp.pos_idx IS NOT NULL) AS is_rev,
         lag(x.description) OVER w AS p_desc, lag(x.q) OVER w AS p_q, lag(x.u) OVER w AS p_u,
         lag(x.a) OVER w AS p_a, x.idx > 0 AS has_prev
  FROM line_x x
  LEFT JOIN pairs pn ON pn.doc_key = x.doc_key AND pn.neg_idx = x.idx
  LEFT JOIN pairs pp ON pp.doc_key = x.doc_key AND pp.pos_idx = x.idx
  WINDOW w AS (PARTITION BY x.doc_key ORDER BY x.idx)
),
lagg AS (
  SELECT doc_key, count(*) AS n_lines, count(*) FILTER (WHERE a IS NULL) AS n_amount_null,
         sum(a) AS amount_sum,
         count(*) FILTER (WHERE NOT is_rev AND a > 0) AS core_pos,
         count(*) FILTER (WHERE NOT is_rev AND a < 0) AS core_neg,
         string_agg(CASE WHEN NOT is_rev AND a IS NOT NULL AND a <> 0
                         THEN 'line_items.' || idx || '.amount' END, ', ' ORDER BY idx) AS core_fields
  FROM line_r GROUP BY doc_key
),
hx AS (
  SELECT h.*, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_amount_null, 0) AS n_amount_null,
         g.amount_sum, g.core_fields,
         h.document_type = 'credit_note' AS is_credit,
         coalesce(g.core_pos, 0) + CASE WHEN subtotal_d > 0 THEN 1 ELSE 0 END
           + CASE WHEN total_d > 0 THEN 1 ELSE 0 END AS n_pos,
         coalesce(g.core_neg, 0) + CASE WHEN subtotal_d < 0 THEN 1 ELSE 0 END
           + CASE WHEN total_d < 0 THEN 1 ELSE 0 END AS n_neg,
         CASE WHEN regexp_full_match(issue_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                   AND substr(issue_date, 1, 4) <> '0000' THEN try_cast(issue_date AS DATE) END AS issue_dt,
         CASE WHEN regexp_full_match(due_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                   AND substr(due_date, 1, 4) <> '0000' THEN try_cast(due_date AS DATE) END AS due_dt,
         CASE WHEN regexp_full_match(delivery_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                   AND substr(delivery_date, 1, 4) <> '0000' THEN try_cast(delivery_date AS DATE) END AS delivery_dt
  FROM doc_header h LEFT JOIN lagg g USING (doc_key)
),
hy AS (
  SELECT *,
         n_pos > 0 AND n_neg > 0 AS mixed,
         n_pos = 0 AND n_neg = 0 AS no_pol,
         concat_ws(', ',
           CASE WHEN discount_d IS NOT NULL AND discount_d <> 0 AND (discount_d > 0) <> (n_pos > 0) THEN 'discount' END,
           CASE WHEN tax_d IS NOT NULL AND tax_d <> 0 AND (tax_d > 0) <> (n_pos > 0) THEN 'tax' END,
           CASE WHEN shipping_d IS NOT NULL AND shipping_d <> 0 AND (shipping_d > 0) <> (n_pos > 0) THEN 'shipping' END
         ) AS contra,
         concat_ws(', ',
           CASE WHEN subtotal_d IS NULL THEN 'subtotal' END,
           CASE WHEN total_d IS NULL THEN 'total' END,
           CASE WHEN n_lines > 0 AND n_amount_null > 0 THEN 'line_items.amount' END) AS incomplete
  FROM hx
),
hz AS (
  SELECT *,
         NOT mixed AND NOT no_pol AND contra = '' AS consistent_known,
         (NOT is_credit) OR (NOT mixed AND NOT no_pol AND contra = '') AS can_check
  FROM hy
),
all_issues AS (
  SELECT doc_key, 1 AS g, -1 AS line_idx, 0 AS sub, 'INVALID_DATE' AS code, 'error' AS severity,
         'issue_date' AS field, 'YYYY-MM-DD' AS expected, issue_date AS actual
  FROM hz WHERE issue_date IS NOT NULL AND issue_date <> '' AND issue_dt IS NULL
  UNION ALL
  SELECT doc_key, 1, -1, 1, 'INVALID_DATE', 'error', 'due_date', 'YYYY-MM-DD', due_date
  FROM hz WHERE due_date IS NOT NULL AND due_date <> '' AND due_dt IS NULL
  UNION ALL
  SELECT doc_key, 1, -1, 2, 'INVALID_DATE', 'error', 'delivery_date', 'YYYY-MM-DD', delivery_date
  FROM hz WHERE delivery_date IS NOT NULL AND delivery_date <> '' AND delivery_dt IS NULL
  UNION ALL
  SELECT doc_key, 2, -1, 0, 'DUE_BEFORE_ISSUE', 'warning', 'due_date', issue_date, due_date
  FROM hz WHERE due_dt < issue_dt
  UNION ALL
  SELECT doc_key, 3, -1, 0, 'DELIVERY_BEFORE_ISSUE', 'warning', 'delivery_date', issue_date, delivery_date
  FROM hz WHERE delivery_dt < issue_dt
  UNION ALL
  SELECT doc_key, 4, -1, 0, 'UNKNOWN_CURRENCY', 'warning', 'currency', 'ISO 4217 code', currency
  FROM hz WHERE currency IS NULL OR currency NOT IN ({_CURRENCIES})
  UNION ALL
  SELECT doc_key, 5, -1, 0, 'MISSING_IDENTIFIER', 'warning', 'document_id', NULL, NULL
  FROM hz WHERE document_id IS NULL OR document_id = ''
  UNION ALL
  SELECT doc_key, 6, -1, 0, 'MISSING_REFERENCE', 'warning', 'reference_document_id', NULL, NULL
  FROM hz WHERE is_credit AND (reference_document_id IS NULL OR reference_document_id = '')
  UNION ALL
  SELECT doc_key, 7, -1, 0, 'NO_LINE_ITEMS', 'warning', 'line_items', NULL, NULL
  FROM hz WHERE n_lines = 0
  UNION ALL
  SELECT doc_key, 8, neg_idx, 0, 'BALANCED_REVERSAL', 'info', 'line_items.' || neg_idx,
         'line_items.' || pos_idx, 'line_items.' || neg_idx
  FROM pairs
  UNION ALL
  SELECT doc_key, 9, idx, 0, 'LINE_AMOUNT_MISMATCH', 'warning', 'line_items.' || idx || '.amount',
         CAST(q * u AS VARCHAR), CAST(a AS VARCHAR)
  FROM line_r WHERE q IS NOT NULL AND u IS NOT NULL AND a IS NOT NULL AND abs(q * u - a) > 0.01
  UNION ALL
  SELECT doc_key, 9, idx, 1, 'DUPLICATE_LINE', 'warning', 'line_items.' || idx, NULL, NULL
  FROM line_r WHERE has_prev AND description IS NOT DISTINCT FROM p_desc
    AND q IS NOT DISTINCT FROM p_q AND u IS NOT DISTINCT FROM p_u AND a IS NOT DISTINCT FROM p_a
  UNION ALL
  SELECT h.doc_key, 10, -1, v.sub, 'NEGATIVE_VALUE', 'error', v.field, 'non-negative', CAST(v.val AS VARCHAR)
  FROM hz h, (VALUES (0, 'subtotal'), (1, 'discount'), (2, 'tax'), (3, 'shipping'), (4, 'total')) v0(sub, field),
       LATERAL (SELECT v0.sub, v0.field,
                CASE v0.field WHEN 'subtotal' THEN h.subtotal_d WHEN 'discount' THEN h.discount_d
                              WHEN 'tax' THEN h.tax_d WHEN 'shipping' THEN h.shipping_d ELSE h.total_d END AS val) v
  WHERE NOT h.is_credit AND v.val < 0
  UNION ALL
  SELECT doc_key, 10, idx, 0, 'NEGATIVE_VALUE', 'error', 'line_items.' || idx || '.quantity', 'non-negative', CAST(q AS VARCHAR)
  FROM line_r WHERE NOT is_credit AND NOT is_rev_neg AND q < 0
  UNION ALL
  SELECT doc_key, 10, idx, 1, 'NEGATIVE_VALUE', 'error', 'line_items.' || idx || '.unit_price', 'non-negative', CAST(u AS VARCHAR)
  FROM line_r WHERE NOT is_credit AND NOT is_rev_neg AND u < 0
  UNION ALL
  SELECT doc_key, 10, idx, 2, 'NEGATIVE_VALUE', 'error', 'line_items.' || idx || '.amount', 'non-negative', CAST(a AS VARCHAR)
  FROM line_r WHERE NOT is_credit AND NOT is_rev_neg AND a < 0
  UNION ALL
  SELECT doc_key, 11, -1, 0, 'CREDIT_SIGN_INCONSISTENCY', 'error', 'document',
         'all non-zero values positive-magnitude or all negative-signed',
         CASE WHEN mixed THEN concat_ws(', ', core_fields,
                CASE WHEN subtotal_d <> 0 THEN 'subtotal' END, CASE WHEN total_d <> 0 THEN 'total' END)
              ELSE contra END
  FROM hz WHERE is_credit AND (mixed OR (NOT no_pol AND contra <> ''))
  UNION ALL
  SELECT doc_key, 11, -1, 0, 'CREDIT_TOTAL_UNVERIFIABLE', 'warning', 'document', NULL, NULL
  FROM hz WHERE is_credit AND no_pol
  UNION ALL
  SELECT doc_key, 11, -1, 1, 'CREDIT_TOTAL_UNVERIFIABLE', 'warning', 'document',
         'line amounts, subtotal, and total', incomplete
  FROM hz WHERE is_credit AND consistent_known AND incomplete <> ''
  UNION ALL
  SELECT doc_key, 12, -1, 0, 'SUBTOTAL_MISMATCH', 'error', 'subtotal',
         CAST(CAST(amount_sum AS DECIMAL(18,2)) AS VARCHAR), CAST(subtotal_d AS VARCHAR)
  FROM hz WHERE can_check AND subtotal_d IS NOT NULL AND n_lines > 0 AND n_amount_null = 0
    AND abs(amount_sum - subtotal_d) > 0.01
  UNION ALL
  SELECT doc_key, 13, -1, 0, 'TOTAL_MISMATCH', 'error', 'total',
         CAST(CAST(subtotal_d - coalesce(discount_d, 0) + coalesce(tax_d, 0) + coalesce(shipping_d, 0)
                   AS DECIMAL(18,2)) AS VARCHAR),
         CAST(total_d AS VARCHAR)
  FROM hz WHERE can_check AND subtotal_d IS NOT NULL AND total_d IS NOT NULL
    AND abs(subtotal_d - coalesce(discount_d, 0) + coalesce(tax_d, 0) + coalesce(shipping_d, 0) - total_d) > 0.01
),
doc_status AS (
  SELECT h.doc_key, h.document_type,
         CASE WHEN count(*) FILTER (WHERE i.severity = 'error') > 0 THEN 'fail'
              WHEN count(*) FILTER (WHERE i.severity = 'warning') > 0 THEN 'warning'
              ELSE 'pass' END AS status,
         count(*) FILTER (WHERE i.severity IN ('error', 'warning')) > 0 AS review_required
  FROM doc_header h LEFT JOIN all_issues i USING (doc_key)
  GROUP BY h.doc_key, h.document_type
)
"""


def with_rules(select: str) -> str:
    return "WITH " + ADAPTER.strip() + ",\n" + RULES.strip() + "\n" + select


def with_adapter(select: str, extra: str = "") -> str:
    body = ADAPTER.strip() + ("," + extra.strip() if extra.strip() else "")
    return "WITH " + body + "\n" + select


def _issues_of(codes: tuple[str, ...], cols: str) -> str:
    in_list = ", ".join(f"'{c}'" for c in codes)
    return with_rules(f"SELECT {cols} FROM all_issues WHERE code IN ({in_list})")


VALIDATION_SQL: dict[str, str] = {
    "issues_by_code": with_rules(
        "SELECT code, severity, count(*) AS n_issues, count(DISTINCT doc_key) AS n_docs "
        "FROM all_issues GROUP BY code, severity"
    ),
    "document_status": with_rules(
        "SELECT status, review_required, count(*) AS n_docs FROM doc_status GROUP BY status, review_required"
    ),
    "review_by_type": with_rules(
        "SELECT document_type, status, count(*) AS n_docs FROM doc_status GROUP BY document_type, status"
    ),
    "header_date_rules": _issues_of(
        ("INVALID_DATE", "DUE_BEFORE_ISSUE", "DELIVERY_BEFORE_ISSUE"),
        "doc_key, code, severity, field, expected, actual",
    ),
    "currency_rule": _issues_of(("UNKNOWN_CURRENCY",), "doc_key, code, field, expected, actual"),
    "identifier_rules": _issues_of(
        ("MISSING_IDENTIFIER", "MISSING_REFERENCE"), "doc_key, code, severity, field"
    ),
    "no_line_items": _issues_of(("NO_LINE_ITEMS",), "doc_key, code, field"),
    "line_amount_mismatch": _issues_of(
        ("LINE_AMOUNT_MISMATCH",), "doc_key, field, expected, actual"
    ),
    "duplicate_line": _issues_of(("DUPLICATE_LINE",), "doc_key, field"),
    "balanced_reversal": _issues_of(("BALANCED_REVERSAL",), "doc_key, field, expected, actual"),
    "negative_value": _issues_of(("NEGATIVE_VALUE",), "doc_key, field, expected, actual"),
    "credit_sign": _issues_of(
        ("CREDIT_SIGN_INCONSISTENCY", "CREDIT_TOTAL_UNVERIFIABLE"),
        "doc_key, code, severity, sub, expected, actual",
    ),
    "subtotal_mismatch": _issues_of(("SUBTOTAL_MISMATCH",), "doc_key, expected, actual"),
    "total_mismatch": _issues_of(("TOTAL_MISMATCH",), "doc_key, expected, actual"),
    "issue_order": with_rules(
        "SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY g, line_idx, sub) - 1 AS INTEGER) AS pos, "
        "code, field FROM all_issues"
    ),
}


# --------------------------------------------------------------------------- long money
_LONG_FACTOR = "CASE doc_key % 3 WHEN 0 THEN 100000000000001 WHEN 1 THEN 1.0000000000001 ELSE 1 END"


def _long(x: str) -> str:
    return f"CAST({x} * CAST({_LONG_FACTOR} AS DECIMAL(28,13)) AS DECIMAL(38,15))"


def _long_text(x: str, computed: bool = False) -> str:
    fine = f"CAST(CAST({x} AS DECIMAL(38,15)) AS VARCHAR)"
    if computed:
        fine = f"CASE WHEN {x} = 0 THEN '0E-15' ELSE {fine} END"
    return f"CASE WHEN doc_key % 3 = 1 THEN {fine} ELSE CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR) END"


_LONG_TABLES = (
    "long_header AS (SELECT * REPLACE (" + ", ".join(f"{_long(f)} AS {f}" for f in ("subtotal_d", "discount_d", "tax_d", "shipping_d", "total_d")) + ") FROM doc_header),\n"
    "long_line AS (SELECT doc_key, idx, description, q, " + ", ".join(f"{_long(f)} AS {f}" for f in ("u", "a")) + " FROM doc_line)"
)


def _long_rules() -> str:
    """The rules over the long tables; texts have 15 decimals where the factor is fine, else 2."""
    sql = rules_for("w_", "long_header", "long_line")
    total = "subtotal_d - coalesce(discount_d, 0) + coalesce(tax_d, 0) + coalesce(shipping_d, 0)"
    shown = {
        "CAST(q * u AS VARCHAR)": _long_text("(q * u)", True),
        "CAST(CAST(amount_sum AS DECIMAL(18,2)) AS VARCHAR)": _long_text("amount_sum", True),
        "CAST(CAST(" + total + "\n                   AS DECIMAL(18,2)) AS VARCHAR)": _long_text(f"({total})", True),
        "CAST(v.val AS VARCHAR)": _long_text("v.val"),
    } | {f"CAST({c} AS VARCHAR)": _long_text(c) for c in ("u", "a", "subtotal_d", "total_d")}
    for old, new in shown.items():
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


def _long_money_sql() -> dict[str, str]:
    codes = ("LINE_AMOUNT_MISMATCH", "DUPLICATE_LINE", "BALANCED_REVERSAL", "NEGATIVE_VALUE", "CREDIT_SIGN_INCONSISTENCY", "CREDIT_TOTAL_UNVERIFIABLE", "SUBTOTAL_MISMATCH", "TOTAL_MISMATCH")
    start = "WITH " + ADAPTER.strip() + ",\n" + _LONG_TABLES
    rules = start + ",\n" + _long_rules() + "\nSELECT doc_key, code, sub, field, expected, actual FROM w_all_issues WHERE code IN (" + ", ".join(f"'{c}'" for c in codes) + ")"

    def bumped(x: str, when: str) -> str:
        t = _long_text(x)
        return f"CASE WHEN {when} THEN CAST(left({t}, -1) || CAST((CAST(right({t}, 1) AS INTEGER) + 1) % 10 AS VARCHAR) AS DECIMAL(38,15)) ELSE {x} END"

    same = f"CASE WHEN total_d IS NOT DISTINCT FROM {bumped('total_d', 'doc_key % 23 = 0')} THEN 1 ELSE 0 END"
    scores = start + f""",
hm AS (SELECT sum({same}) AS s, count(*) AS n FROM long_header),
keyed AS (
  SELECT 'g' AS side, doc_key, {_norm('description')} AS nd, q, u, a FROM long_line
  UNION ALL
  SELECT 'p', doc_key, {_norm('description')}, q, u, {bumped('a', 'doc_key % 19 = 0 AND idx % 2 = 0')} FROM long_line
),
bag AS (
  SELECT count(*) FILTER (WHERE side = 'g') AS cg, count(*) FILTER (WHERE side = 'p') AS cp FROM keyed GROUP BY doc_key, nd, q, u, a
),
lines AS (SELECT sum(least(cg, cp)) AS tp, sum(cp - least(cg, cp)) AS fp, sum(cg - least(cg, cp)) AS fn FROM bag)
SELECT CAST(15 * n + s AS BIGINT) AS header_matched, CAST(16 * n AS BIGINT) AS header_compared,
       CAST(4 * n + s AS BIGINT) AS decimal_matched, CAST(5 * n AS BIGINT) AS decimal_compared,
       CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative
FROM hm, lines"""
    return {"long_money_rules": rules, "long_money_scores": scores}


def all_oracle_sql() -> dict[str, str]:
    from docaudit.plans.flagship import FLAGSHIP_SQL_SELECT

    out = dict(VALIDATION_SQL)
    out["flagship"] = with_rules(FLAGSHIP_SQL_SELECT)
    out.update(EVALUATION_SQL)
    out.update(JSON_SQL)
    out.update(SOURCE_SQL)
    out.update(EXTRACTION_SQL)
    out.update(VALUE_SQL)
    out.update(_long_money_sql())
    return out


# --------------------------------------------------------------------------- evaluation
_RULE_CTES = ("line_x", "elig", "pairs", "line_r", "lagg", "hx", "hy", "hz", "all_issues", "doc_status")


def rules_for(prefix: str, header: str, line: str) -> str:
    """The RULES CTEs renamed with ``prefix`` and reading ``header`` / ``line``."""
    import re

    sql = RULES
    for name in _RULE_CTES:
        sql = re.sub(rf"\b{name}\b", f"{prefix}{name}", sql)
    sql = re.sub(r"\bdoc_line\b", line, sql)
    sql = re.sub(r"\bdoc_header\b", header, sql)
    return sql.strip()


PAIR = """
pred_header AS (
  SELECT doc_key, document_type, document_id, reference_document_id, vendor_name, vendor_tax_id,
         vendor_address,
         CASE WHEN doc_key % 5 = 0 THEN '  ' || upper(customer_name) || ' ' ELSE customer_name END AS customer_name,
         issue_date,
         CASE WHEN doc_key % 14 = 0 THEN coalesce(due_date, '2099-12-31') ELSE due_date END AS due_date,
         delivery_date, currency, subtotal_d, discount_d, tax_d, shipping_d,
         CASE WHEN doc_key % 23 = 0 THEN total_d + 1 ELSE total_d END AS total_d,
         doc_key % 31 <> 0 AS schema_valid
  FROM doc_header WHERE doc_key % 29 <> 0
),
pred_line AS (
  SELECT doc_key, idx - CASE WHEN doc_key % 12 = 0 THEN 1 ELSE 0 END AS idx, description, q, u, a
  FROM doc_line WHERE doc_key % 29 <> 0 AND NOT (doc_key % 12 = 0 AND idx = 0)
  UNION ALL
  SELECT l.doc_key, CAST(c.n - CASE WHEN l.doc_key % 12 = 0 THEN 1 ELSE 0 END AS INTEGER), l.description, l.q, l.u, l.a
  FROM doc_line l JOIN (SELECT doc_key, count(*) AS n FROM doc_line GROUP BY doc_key) c USING (doc_key)
  WHERE l.doc_key % 18 = 0 AND l.idx = 0 AND l.doc_key % 29 <> 0
),
fx AS (
  SELECT g.doc_key,
         CASE g.doc_key % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' WHEN 3 THEN 'text'
              ELSE 'xlsx' END AS format,
         coalesce(o.o_orderpriority, 'unknown') AS layout,
         g.doc_key % 97 <> 0 AS gold_valid,
         CASE WHEN g.doc_key % 97 <> 0 THEN g.document_type END AS gold_type,
         CASE WHEN g.doc_key % 37 = 0 THEN CASE WHEN g.document_type <> 'receipt' THEN 'receipt' ELSE 'invoice' END
              ELSE g.document_type END AS manifest_type,
         CASE WHEN g.doc_key % 97 = 0 THEN 'gold_invalid'
              WHEN p.doc_key IS NULL THEN 'missing_output'
              WHEN NOT p.schema_valid THEN 'invalid_output'
              ELSE 'compared' END AS branch
  FROM doc_header g LEFT JOIN orders o ON o.o_orderkey = g.doc_key
  LEFT JOIN pred_header p USING (doc_key)
),
cmp AS (SELECT doc_key FROM fx WHERE branch = 'compared')
"""


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def _eq(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 1 ELSE 0 END"


_TEXT_FIELDS = ("document_type", "document_id", "reference_document_id", "customer_name",
                "issue_date", "due_date", "delivery_date", "currency",
                "vendor_name", "vendor_tax_id", "vendor_address")
_MONEY = ("subtotal_d", "discount_d", "tax_d", "shipping_d", "total_d")


def with_pair(select: str, codes: bool = False) -> str:
    parts = [ADAPTER.strip(), PAIR.strip()]
    if codes:
        parts.append(rules_for("g_", "doc_header", "doc_line"))
        parts.append(rules_for("p_", "pred_valid_header", "pred_valid_line"))
    sql = ",\n".join(parts)
    if codes:
        sql = sql.replace(
            "cmp AS (SELECT doc_key FROM fx WHERE branch = 'compared')",
            "cmp AS (SELECT doc_key FROM fx WHERE branch = 'compared'),\n"
            "pred_valid_header AS (SELECT * FROM pred_header WHERE schema_valid),\n"
            "pred_valid_line AS (SELECT * FROM pred_line WHERE doc_key IN (SELECT doc_key FROM pred_valid_header))",
        )
        # the prefixed rule blocks must come after the pred tables they read
    return "WITH " + sql + "\n" + select


_HEADER_MATCH_EXPR = " + ".join(
    [_eq(_norm(f"g.{f}"), _norm(f"p.{f}")) for f in _TEXT_FIELDS] + [_eq(f"g.{f}", f"p.{f}") for f in _MONEY]
)
_DECIMAL_MATCH_EXPR = " + ".join(_eq(f"g.{f}", f"p.{f}") for f in _MONEY)
_HEAD_HALLU = " + ".join(
    f"CASE WHEN g.{f} IS NULL AND p.{f} IS NOT NULL THEN 1 ELSE 0 END" for f in (*_TEXT_FIELDS, *_MONEY)
)
_LINE_HALLU = " + ".join(
    f"CASE WHEN g.{f} IS NULL AND p.{f} IS NOT NULL THEN 1 ELSE 0 END" for f in ("description", "q", "u", "a")
)


def _rates(tp: str, fp: str, fn: str) -> str:
    p = f"CASE WHEN {tp} + {fp} > 0 THEN round({tp} / ({tp} + {fp}), 4) ELSE 0.0 END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN round({tp} / ({tp} + {fn}), 4) ELSE 0.0 END"
    return (
        f"{p} AS precision, {r} AS recall, "
        f"CASE WHEN ({p}) + ({r}) > 0 THEN round(2 * ({p}) * ({r}) / (({p}) + ({r})), 4) ELSE 0.0 END AS f1"
    )


EVALUATION_SQL: dict[str, str] = {
    "eval_processing": with_pair(
        "SELECT count(*) AS fixture_count, "
        "count(*) FILTER (WHERE branch IN ('invalid_output', 'compared')) AS processed, "
        "count(*) FILTER (WHERE branch = 'compared') AS schema_valid FROM fx"
    ),
    "header_match": with_pair(
        f"SELECT CAST(coalesce(sum({_HEADER_MATCH_EXPR}), 0) AS BIGINT) AS header_matched, "
        f"CAST(count(*) * 16 AS BIGINT) AS header_compared, "
        f"CAST(coalesce(sum({_DECIMAL_MATCH_EXPR}), 0) AS BIGINT) AS decimal_matched, "
        f"CAST(count(*) * 5 AS BIGINT) AS decimal_compared "
        "FROM cmp JOIN doc_header g USING (doc_key) JOIN pred_header p USING (doc_key)"
    ),
    "hallucinations": with_pair(
        "SELECT CAST(sum(n) AS BIGINT) AS hallucination_count FROM ("
        f"SELECT coalesce(sum({_HEAD_HALLU}), 0) AS n FROM cmp JOIN doc_header g USING (doc_key) "
        "JOIN pred_header p USING (doc_key) "
        "UNION ALL "
        f"SELECT coalesce(sum({_LINE_HALLU}), 0) FROM doc_line g JOIN pred_line p USING (doc_key, idx) "
        "WHERE g.doc_key IN (SELECT doc_key FROM cmp))"
    ),
    "line_item_prf": with_pair(
        "SELECT CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, "
        f"CAST(fn AS BIGINT) AS false_negative, {_rates('tp', 'fp', 'fn')} FROM ("
        "SELECT coalesce(sum(least(cg, cp)), 0) AS tp, coalesce(sum(cp - least(cg, cp)), 0) AS fp, "
        "coalesce(sum(cg - least(cg, cp)), 0) AS fn FROM ("
        "SELECT doc_key, nd, q, u, a, count(*) FILTER (WHERE side = 'g') AS cg, "
        "count(*) FILTER (WHERE side = 'p') AS cp FROM ("
        f"SELECT 'g' AS side, doc_key, {_norm('description')} AS nd, q, u, a FROM doc_line "
        "WHERE doc_key IN (SELECT doc_key FROM cmp) UNION ALL "
        f"SELECT 'p', doc_key, {_norm('description')}, q, u, a FROM pred_line "
        "WHERE doc_key IN (SELECT doc_key FROM cmp)) x GROUP BY doc_key, nd, q, u, a) y) z"
    ),
    "issue_code_prf": with_pair(
        "SELECT CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive, "
        f"CAST(fn AS BIGINT) AS false_negative, {_rates('tp', 'fp', 'fn')}, "
        "CAST(tp AS BIGINT) AS found, CAST(tp + fn AS BIGINT) AS expected, CAST(tp + fp AS BIGINT) AS predicted FROM ("
        "SELECT count(*) FILTER (WHERE f.branch = 'compared' AND e.code IS NOT NULL AND a.code IS NOT NULL) AS tp, "
        "count(*) FILTER (WHERE f.branch = 'compared' AND e.code IS NULL AND a.code IS NOT NULL) AS fp, "
        "count(*) FILTER (WHERE f.branch IN ('compared', 'missing_output', 'invalid_output') "
        "  AND e.code IS NOT NULL AND (a.code IS NULL OR f.branch <> 'compared')) AS fn "
        "FROM (SELECT DISTINCT doc_key, code FROM g_all_issues) e "
        "FULL OUTER JOIN (SELECT DISTINCT doc_key, code FROM p_all_issues) a "
        "  ON e.doc_key = a.doc_key AND e.code = a.code "
        "JOIN fx f ON f.doc_key = coalesce(e.doc_key, a.doc_key)) s",
        codes=True,
    ),
    "eval_breakdown": with_pair(
        "SELECT 'format' AS dimension, format AS grp, count(*) AS fixtures, "
        "count(*) FILTER (WHERE branch IN ('invalid_output', 'compared')) AS processed, "
        "count(*) FILTER (WHERE branch = 'compared') AS schema_valid FROM fx GROUP BY format "
        "UNION ALL SELECT 'layout', layout, count(*), "
        "count(*) FILTER (WHERE branch IN ('invalid_output', 'compared')), "
        "count(*) FILTER (WHERE branch = 'compared') FROM fx GROUP BY layout "
        "UNION ALL SELECT 'document_type', gold_type, count(*), "
        "count(*) FILTER (WHERE branch IN ('invalid_output', 'compared')), "
        "count(*) FILTER (WHERE branch = 'compared') FROM fx WHERE gold_valid GROUP BY gold_type"
    ),
    "eval_failures": with_pair(
        "SELECT doc_key AS fixture, 0 AS o, 'invalid ground truth: total: value_error' AS error FROM fx WHERE branch = 'gold_invalid' "
        "UNION ALL SELECT doc_key, 1, 'manifest document_type mismatch: ''' || manifest_type || ''' != ''' "
        "|| gold_type || '''' FROM fx WHERE gold_valid AND manifest_type IS NOT NULL AND manifest_type <> gold_type "
        "UNION ALL SELECT doc_key, 2, CASE branch WHEN 'missing_output' THEN 'missing output' "
        "ELSE 'invalid output: root: json_invalid' END FROM fx WHERE branch IN ('missing_output', 'invalid_output')"
    ),
}


# --------------------------------------------------------------------------- strict JSON / migration
_LINE_COUNTS = "nl AS (SELECT doc_key, count(*) AS n_lines FROM doc_line GROUP BY doc_key)"

JSON_SQL: dict[str, str] = {
    "strict_json": with_adapter(
        "SELECT h.doc_key, errors = '' AS schema_valid, errors FROM (SELECT h.doc_key, "
        "CASE WHEN h.doc_key % 31 = 0 THEN 'root: json_invalid' ELSE concat_ws('; ', "
        "CASE WHEN h.doc_key % 53 = 5 THEN 'document_type: literal_error' END, "
        "CASE WHEN h.doc_key % 61 = 7 AND h.vendor_name IS NOT NULL THEN 'vendor.name: string_type' END, "
        "CASE WHEN h.doc_key % 41 = 2 OR h.doc_key % 73 = 10 THEN 'currency: missing' END, "
        "CASE WHEN h.doc_key % 59 = 6 AND coalesce(nl.n_lines, 0) > 0 THEN 'line_items.0.quantity: value_error' END, "
        "CASE WHEN h.doc_key % 47 = 4 THEN 'subtotal: value_error' END, "
        "CASE WHEN h.doc_key % 43 = 3 THEN 'total: value_error' END, "
        "CASE WHEN h.doc_key % 73 = 10 THEN 'aaa: extra_forbidden' END, "
        "CASE WHEN h.doc_key % 37 = 1 THEN 'notes: extra_forbidden' END) END AS errors "
        "FROM doc_header h LEFT JOIN nl USING (doc_key)) h",
        _LINE_COUNTS,
    ),
    "migrate_v1": with_adapter(
        "SELECT doc_key, ok AS schema_valid, ok AS migrated, "
        "CASE WHEN doc_key % 17 = 0 THEN 'document.delivery_date: extra_forbidden' "
        "WHEN doc_key % 13 = 0 THEN 'source.page_count: greater_than_equal' ELSE '' END AS errors, "
        "CASE WHEN ok THEN '2.0' END AS version_out, "
        "CASE WHEN ok THEN CAST(doc_key % 3 + 1 AS INTEGER) END AS page_count, "
        "CAST(NULL AS INTEGER) AS sheet_count, "
        "CASE WHEN ok THEN 0 END AS n_notices, CAST(NULL AS VARCHAR) AS delivery_date "
        "FROM (SELECT doc_key, doc_key % 17 <> 0 AND doc_key % 13 <> 0 AS ok FROM doc_header "
        "WHERE document_type IN ('invoice', 'receipt')) x"
    ),
    "revalidate": with_rules(
        "SELECT code, severity, count(*) AS n_issues, count(DISTINCT doc_key) AS n_docs FROM all_issues "
        "WHERE doc_key IN (SELECT doc_key FROM doc_header WHERE document_type IN ('invoice', 'receipt') "
        "AND doc_key % 17 <> 0 AND doc_key % 13 <> 0) GROUP BY code, severity"
    ),
}


# --------------------------------------------------------------------------- sources
_LABELS = "'Unsupported content; expected PDF, PNG, JPEG, UTF-8 TXT, UTF-8 CSV, XLSX'"
_PY_WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

ROUTE_SQL = f"""
WITH f AS (
  SELECT doc_id, text,
         'doc_' || doc_id || '.' || (['txt','csv','pdf','PNG','jpeg','xlsx','TXT','doc'])[doc_id % 8 + 1] AS file_name,
         (['txt','csv','pdf','png','jpeg','xlsx','txt','doc'])[doc_id % 8 + 1] AS ext,
         ([NULL, 'pdf', 'png', 'xlsx'])[(doc_id // 8) % 4 + 1] AS detected,
         CASE WHEN doc_id % 19 = 3 THEN 0 ELSE ([0, 5, 8, 4])[(doc_id // 8) % 4 + 1] + octet_length(encode(text))
              + CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 1 ELSE 0 END END AS bytes
  FROM documents
), g AS (
  SELECT *, CASE ext WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'csv' WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'png'
                     WHEN 'jpeg' THEN 'jpeg' WHEN 'xlsx' THEN 'xlsx' END AS declared FROM f
), h AS (
  SELECT *,
    CASE WHEN bytes = 0 THEN 'Input file is empty'
         WHEN bytes > 12000 THEN 'Input is ' || bytes || ' bytes; limit is 12000 bytes'
         WHEN detected IS NOT NULL AND declared IS DISTINCT FROM detected
           THEN upper(detected) || ' content requires a .' || detected || ' extension'
         WHEN detected IS NULL AND declared IN ('pdf', 'png', 'jpeg', 'xlsx')
           THEN upper(declared) || ' extension does not match the file content'
         WHEN detected IS NULL AND declared IS NULL THEN {_LABELS} END AS e1
  FROM g
), i AS (
  SELECT *, CASE WHEN e1 IS NULL THEN coalesce(detected, declared) END AS r1 FROM h
), j AS (
  SELECT *,
    CASE WHEN r1 IN ('text', 'csv') THEN
      CASE WHEN doc_id % 13 = 0 THEN (CASE r1 WHEN 'csv' THEN 'CSV input' ELSE 'Text input' END) || ' contains NUL bytes'
           WHEN doc_id % 17 = 0 THEN (CASE r1 WHEN 'csv' THEN 'CSV input' ELSE 'Text input' END) || ' is not valid UTF-8'
           WHEN regexp_replace(text, '{_PY_WS}+', '', 'g') = ''
             THEN (CASE r1 WHEN 'csv' THEN 'CSV input' ELSE 'Text input' END) || ' contains no visible content'
      END END AS e2
  FROM i
)
SELECT doc_id, file_name, CASE WHEN e2 IS NULL THEN r1 END AS route,
       CASE WHEN e1 IS NULL AND e2 IS NULL THEN
         CASE r1 WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg'
                 WHEN 'text' THEN 'text/plain; charset=utf-8' WHEN 'csv' THEN 'text/csv; charset=utf-8'
                 ELSE 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' END END AS media_type,
       CASE WHEN coalesce(e1, e2) IS NOT NULL THEN 3 END AS error_code,
       coalesce(e1, e2) AS error
FROM j
"""

PAGE_SQL = f"""
WITH p AS (
  SELECT conv_id AS file, turn, CASE WHEN conv_id % 6 = 0 THEN NULL ELSE text END AS t,
         greatest(1, ceil(abs(612 + (conv_id % 4) * 1000) * 2)) * greatest(1, ceil(abs(792 * (1 + conv_id % 3)) * 2)) AS px
  FROM conversations
), s AS (
  SELECT file, count(*) AS page_count, max(px) AS max_px,
         regexp_replace(string_agg(coalesce(t, ''), chr(10) || chr(12) || chr(10) ORDER BY turn),
                        '^{_PY_WS}+|{_PY_WS}+$', '', 'g') AS joined
  FROM p GROUP BY file
), f AS (
  SELECT a.file, coalesce(page_count, 0) AS page_count, max_px, joined
  FROM (SELECT conv_id AS file FROM conversations UNION SELECT doc_id FROM documents) a LEFT JOIN s USING (file)
), e AS (
  SELECT *, CASE WHEN page_count = 0 THEN 'PDF contains no pages'
                 WHEN page_count > 6 THEN 'PDF has ' || page_count || ' pages; limit is 6'
                 WHEN max_px > 25000000 THEN 'Projected PDF page exceeds max_image_pixels; lower render_dpi'
            END AS error FROM f
)
SELECT file, CASE WHEN error IS NULL THEN page_count END AS page_count,
       CASE WHEN error IS NULL AND joined <> '' THEN joined END AS text,
       CASE WHEN error IS NULL THEN CASE WHEN joined = '' THEN 1 ELSE 0 END END AS n_notices,
       error
FROM e
"""

CELLS_CTE = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                               l_extendedprice, l_quantity) AS n
  FROM lineitem
), base AS (
  SELECT 'wb-' || l_orderkey || '.xlsx' AS file, l_orderkey AS k, CAST(n % 2 + 1 AS INTEGER) AS sheet_idx,
         CAST((n + 1) // 2 AS INTEGER) AS row,
         CASE WHEN n % 2 + 1 = 2 AND l_orderkey % 7 = 0 THEN 'hidden' ELSE 'visible' END AS state,
         CASE WHEN n % 2 + 1 = 1 THEN 'Lines A' ELSE 'Lines B' END AS sheet,
         CAST(l_partkey AS VARCHAR) AS c1, CAST(CAST(l_quantity AS DECIMAL(18,0)) AS VARCHAR) AS c2,
         CASE WHEN l_orderkey % 11 = 0 THEN '#DIV/0!' ELSE l_returnflag END AS c3,
         l_orderkey % 11 = 0 AS c3_err,
         CASE WHEN l_orderkey % 3 = 0 THEN '=B' || CAST((n + 1) // 2 AS INTEGER) || '*2' END AS c4f,
         CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 9 <> 0 THEN CAST(CAST(l_quantity AS DECIMAL(18,0)) AS VARCHAR) END AS c4c,
         CASE WHEN l_orderkey % 4 = 0 THEN l_linestatus END AS c5
  FROM li
), lines AS (
  SELECT file, k, sheet_idx, row, state, sheet, c1, c2, c3, c4f, c4c,
         'row ' || row || ': [' || concat_ws(', ',
            '"' || c1 || '"', '"' || c2 || '"',
            CASE WHEN c3_err THEN '{"error": "' || c3 || '"}' ELSE '"' || c3 || '"' END,
            CASE WHEN c4f IS NOT NULL THEN '{"formula": "' || c4f || '", "cached_value": ' ||
                   coalesce('"' || c4c || '"', 'null') || '}'
                 WHEN c5 IS NOT NULL THEN 'null' END,
            CASE WHEN c5 IS NOT NULL THEN '"' || c5 || '"' END) || ']' AS line,
         CASE WHEN c5 IS NOT NULL THEN 5 WHEN c4f IS NOT NULL THEN 4 ELSE 3 END AS width,
         greatest(length(c1), length(c2), length(c3), coalesce(length(c4f), 0), coalesce(length(c4c), 0),
                  coalesce(length(c5), 0)) AS cell_chars
  FROM base
)
"""

_PREFIX_CHARS = len("XLSX visible sheets as JSON rows (formula text and cached values are labeled separately):\n")


def _cells_judged(columns: int, rows: int, cell: int, chars: int) -> str:
    """CTEs that judge every order's workbook by the four limits: ``judged``."""
    return CELLS_CTE.strip() + f""",
v AS (SELECT * FROM lines WHERE state = 'visible' AND k % 97 <> 0),
cellv AS (
  SELECT file, sheet_idx, row, unnest([1, 2, 3, 4, 5]) AS col,
         unnest([length(c1), length(c2), length(c3), greatest(length(c4f), length(c4c)), length(c5_)]) AS size
  FROM (SELECT v.*, CASE WHEN width = 5 THEN 'x' END AS c5_ FROM v) t
),
per_sheet AS (SELECT file, sheet_idx, any_value(sheet) AS sheet, max(row) AS rows, max(width) AS cols, max(cell_chars) AS cc FROM v GROUP BY file, sheet_idx),
steps AS (
  SELECT file, sheet_idx, 0 AS row, length('sheet ' || sheet_idx || ': "' || sheet || '"') + 1 AS chars FROM per_sheet
  UNION ALL SELECT file, sheet_idx, row, length(line) + 1 FROM v
),
running AS (SELECT *, {_PREFIX_CHARS} + sum(chars) OVER (PARTITION BY file ORDER BY sheet_idx, row) AS so_far FROM steps),
breaches AS (
  SELECT file, sheet_idx, 0 AS row, 0 AS step, 0 AS col, 'columns' AS broken, cols AS size FROM per_sheet WHERE cols > {columns}
  UNION ALL SELECT file, sheet_idx, 0, 1, 0, 'rows', NULL FROM (
    SELECT *, sum(rows) OVER (PARTITION BY file ORDER BY sheet_idx) AS through FROM per_sheet) t WHERE through > {rows}
  UNION ALL SELECT file, sheet_idx, row, CASE WHEN row = 0 THEN 2 ELSE 4 END, 0, 'canonical_chars', NULL FROM running WHERE so_far > {chars}
  UNION ALL SELECT file, sheet_idx, row, 3, col, 'cell_chars', size FROM cellv WHERE size > {cell}
),
first_breach AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY sheet_idx, row, step, col) AS r FROM breaches) t WHERE r = 1
),
st AS (SELECT file, sum(rows) AS n_rows, max(cols) AS max_cols, max(cc) AS max_cell_chars FROM per_sheet GROUP BY file),
lc AS (SELECT file, sum(length(line) + 1) AS line_chars FROM v GROUP BY file),
hc AS (SELECT file, sum(length('sheet ' || sheet_idx || ': "' || sheet || '"') + 1) AS heading_chars
       FROM (SELECT DISTINCT file, sheet_idx, sheet FROM v) GROUP BY file),
j AS (SELECT 'wb-' || o.o_orderkey || '.xlsx' AS file, o.o_orderkey AS k, st.n_rows, st.max_cols, st.max_cell_chars,
             {_PREFIX_CHARS} + lc.line_chars + hc.heading_chars AS canonical_chars, fb.broken,
             CASE WHEN fb.broken IN ('columns', 'cell_chars') THEN fb.sheet_idx END AS b_sheet,
             CASE WHEN fb.broken = 'cell_chars' THEN fb.row END AS b_row, CASE WHEN fb.broken = 'cell_chars' THEN fb.col END AS b_col, fb.size AS b_size,
             EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS has_lines
      FROM orders o LEFT JOIN st ON st.file = 'wb-' || o.o_orderkey || '.xlsx'
      LEFT JOIN lc ON lc.file = st.file LEFT JOIN hc ON hc.file = st.file
      LEFT JOIN first_breach fb ON fb.file = st.file),
judged AS (
  SELECT *, CASE WHEN k % 97 = 0 AND has_lines THEN 'decoding stopped'
      WHEN broken = 'columns' THEN 'limit columns is {columns}; found ' || b_size || ' at sheet ' || b_sheet
      WHEN broken = 'rows' THEN 'limit rows is {rows}; found ' || n_rows
      WHEN broken = 'cell_chars' THEN 'limit cell_chars is {cell}; found ' || b_size || ' at sheet ' || b_sheet || ' row ' || b_row || ' column ' || b_col
      WHEN broken = 'canonical_chars' THEN 'limit canonical_chars is {chars}; found ' || canonical_chars
      WHEN n_rows IS NULL THEN 'Input contains no logical rows' END AS error FROM j
)
"""


CELL_LIMITS_SQL = "WITH " + _cells_judged(4, 6, 5, 400) + """
SELECT file, CAST(n_rows AS BIGINT) AS n_rows, CAST(max_cols AS BIGINT) AS max_cols,
       CAST(max_cell_chars AS BIGINT) AS max_cell_chars, CAST(canonical_chars AS BIGINT) AS canonical_chars,
       broken AS broken_limit,
       b_sheet AS at_sheet, b_row AS at_row, b_col AS at_col,
       CAST(CASE broken WHEN 'rows' THEN n_rows WHEN 'canonical_chars' THEN canonical_chars ELSE b_size END AS BIGINT) AS at_size,
       CASE WHEN error IS NOT NULL THEN 3 END AS error_code, error
FROM judged
"""

CANONICAL_SQL = "WITH " + CELLS_CTE.strip() + "\nSELECT file, sheet_idx, row, line FROM lines WHERE state = 'visible'"

SHEET_NOTICES_SQL = "WITH " + CELLS_CTE.strip() + """,
sh AS (SELECT DISTINCT file, sheet_idx, state FROM lines WHERE k % 97 <> 0),
pf AS (SELECT file, count(*) AS sheet_count, count(*) FILTER (WHERE state <> 'visible') AS hidden_count FROM sh GROUP BY file),
fm AS (SELECT file, bool_or(c4f IS NOT NULL) AS fp, bool_or(c4f IS NOT NULL AND c4c IS NULL) AS cm
       FROM lines WHERE state = 'visible' AND k % 97 <> 0 GROUP BY file)
SELECT pf.file, CAST(sheet_count AS BIGINT) AS sheet_count, CAST(hidden_count AS BIGINT) AS hidden_count,
       concat_ws(',', CASE WHEN hidden_count > 0 THEN 'XLSX_HIDDEN_SHEET_SKIPPED' END,
                 CASE WHEN coalesce(fp, false) THEN 'XLSX_FORMULA_PRESENT' END,
                 CASE WHEN coalesce(cm, false) THEN 'XLSX_FORMULA_CACHE_MISSING' END) AS codes,
       CASE WHEN hidden_count = sheet_count THEN 'XLSX contains no visible worksheets' END AS error
FROM pf LEFT JOIN fm USING (file)
"""

ARCHIVE_SQL = """
WITH e AS (
  SELECT 'pkg-' || (p_partkey // 40) || '.xlsx' AS file,
         CASE WHEN p_partkey % 89 = 0 THEN '../xl/worksheets/sheet' || p_partkey || '.xml'
              WHEN p_partkey % 83 = 0 THEN 'xl/vbaProject.bin'
              WHEN p_partkey % 79 = 0 THEN 'xl/worksheets/dup.xml'
              ELSE 'xl/worksheets/sheet' || p_partkey || '.xml' END AS part,
         p_size * 1000 AS size, CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS flags
  FROM part WHERE p_size % 5 <> 0
  UNION ALL
  SELECT 'pkg-' || pkg || '.xlsx', '[Content_Types].xml', 1000, 0 FROM (SELECT DISTINCT p_partkey // 40 AS pkg FROM part)
  UNION ALL
  SELECT 'pkg-' || pkg || '.xlsx', 'xl/workbook.xml', 1000, 0 FROM (SELECT DISTINCT p_partkey // 40 AS pkg FROM part)
  WHERE pkg % 7 <> 3
), s AS (
  SELECT file, count(*) AS entries, count(DISTINCT part) AS distinct_names,
         bool_or(starts_with(part, '../')) AS unsafe, bool_or(flags % 2 = 1) AS encrypted, sum(size) AS uncompressed,
         bool_or(part = 'xl/workbook.xml') AS has_wb, bool_or(part = '[Content_Types].xml') AS has_ct,
         bool_or(contains(lower(part), 'vbaproject.bin')) AS active
  FROM e GROUP BY file
), r AS (
  SELECT *, CASE
    WHEN entries > 36 THEN ['Limit', 'XLSX has ' || entries || ' ZIP entries; limit is 36']
    WHEN entries <> distinct_names THEN ['Corrupt', 'XLSX contains duplicate ZIP part names']
    WHEN unsafe THEN ['Corrupt', 'XLSX contains an unsafe ZIP part name']
    WHEN encrypted THEN ['Unsupported', 'Encrypted XLSX ZIP entries are not supported']
    WHEN uncompressed > 850000 THEN ['Limit', 'XLSX declares ' || uncompressed || ' uncompressed bytes; limit is 850000']
    WHEN NOT has_ct OR NOT has_wb THEN ['Corrupt', 'XLSX is missing required package parts: ' ||
        concat_ws(', ', CASE WHEN NOT has_ct THEN '[Content_Types].xml' END, CASE WHEN NOT has_wb THEN 'xl/workbook.xml' END)]
    WHEN active THEN ['Unsupported', 'XLSX active content is not supported']
  END AS ek FROM s
)
SELECT file, CAST(entries AS BIGINT) AS entries, CAST(uncompressed AS BIGINT) AS uncompressed,
       ek[1] AS error_kind, ek[2] AS error, CASE WHEN ek IS NOT NULL THEN 3 END AS error_code
FROM r
"""

SOURCE_SQL: dict[str, str] = {
    "route_formats": ROUTE_SQL,
    "text_digest": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS byte_count, "
    "CASE WHEN regexp_replace(text, '" + _PY_WS + "+', '', 'g') <> '' THEN 1 END AS page_count, "
    "'text/plain; charset=utf-8' AS media_type FROM documents",
    "page_assembly": PAGE_SQL,
    "cell_limits": CELL_LIMITS_SQL,
    "canonical_rows": CANONICAL_SQL,
    "sheet_notices": SHEET_NOTICES_SQL,
    "archive_guard": ARCHIVE_SQL,
}


# --------------------------------------------------------------------------- extraction / jobs
_DAMAGED = (
    "(doc_key % 31 = 0 OR doc_key % 37 = 1 OR doc_key % 41 = 2 OR doc_key % 43 = 3 OR doc_key % 47 = 4 "
    "OR doc_key % 53 = 5 OR doc_key % 73 = 10 OR (doc_key % 59 = 6 AND coalesce(n_lines, 0) > 0) "
    "OR (doc_key % 61 = 7 AND vendor_name IS NOT NULL))"
)
_REPLAY = (
    "rp AS (SELECT h.doc_key, CASE WHEN h.doc_key % 29 = 0 THEN 'provider_error' "
    f"WHEN {_DAMAGED} THEN 'schema_error' ELSE 'ok' END AS outcome "
    "FROM doc_header h LEFT JOIN nl USING (doc_key))"
)

EXTRACTION_SQL: dict[str, str] = {
    "replay_extract": with_adapter(
        "SELECT doc_key, outcome, CASE outcome WHEN 'provider_error' THEN 4 WHEN 'schema_error' THEN 5 END AS exit_code FROM rp",
        _LINE_COUNTS + ",\n" + _REPLAY,
    ),
    "batch_summary": with_rules(
        "SELECT count(*) FILTER (WHERE outcome = 'ok') AS processed, count(*) FILTER (WHERE outcome <> 'ok') AS failed, "
        "CAST(coalesce(max(CASE outcome WHEN 'provider_error' THEN 4 WHEN 'schema_error' THEN 5 END), "
        "CASE WHEN bool_or(outcome = 'ok' AND s.review_required) THEN 2 ELSE 0 END) AS INTEGER) AS exit_code "
        "FROM rp LEFT JOIN doc_status s USING (doc_key)"
    ).replace("WITH ", "WITH " + "", 1),
    "request_parts": "SELECT doc_id, CASE WHEN text <> '' THEN 2 ELSE 1 END AS n_parts, "
    "CAST(length('Name: doc_' || doc_id || '.txt' || chr(10) || 'Type: text/plain; charset=utf-8' || chr(10) "
    "|| 'Write the record of this document as JSON.') + CASE WHEN text <> '' THEN length('TEXT:' || chr(10) || text) ELSE 0 END "
    "AS BIGINT) AS n_chars FROM documents",
}
# batch_summary needs the replay outcome next to the rules
EXTRACTION_SQL["batch_summary"] = EXTRACTION_SQL["batch_summary"].replace(
    "\nSELECT count(*) FILTER (WHERE outcome = 'ok')",
    ",\n" + _LINE_COUNTS + ",\n" + _REPLAY + "\nSELECT count(*) FILTER (WHERE outcome = 'ok')",
)


# --------------------------------------------------------------------------- value normalisation / grounding
_PRINTED = """
pr AS (
  SELECT h.*, CAST(o.o_orderdate AS DATE) AS od,
         CASE h.doc_key % 6
           WHEN 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%-d %b %Y')
           WHEN 1 THEN upper(strftime(CAST(o.o_orderdate AS DATE), '%b %-d, %Y'))
           WHEN 2 THEN strftime(CAST(o.o_orderdate AS DATE), '%B %-d, %Y')
           WHEN 3 THEN strftime(CAST(o.o_orderdate AS DATE), '%Y/%m/%d')
           WHEN 4 THEN strftime(CAST(o.o_orderdate AS DATE), '%d.%m.%Y')
           ELSE strftime(CAST(o.o_orderdate AS DATE), '%d/%m/%Y') END AS date_text
  FROM doc_header h JOIN orders o ON o.o_orderkey = h.doc_key
)
"""

VALUE_SQL: dict[str, str] = {
    "normalize_values": with_adapter(
        "SELECT doc_key, date_text, "
        "CASE WHEN doc_key % 6 = 5 AND day(od) <= 12 AND day(od) <> month(od) THEN NULL "
        "ELSE strftime(od, '%Y-%m-%d') END AS date_norm, "
        "upper(currency) AS currency_norm, "
        "CASE doc_key % 8 WHEN 0 THEN '$' || us WHEN 1 THEN translate(us, ',.', '.,') || ' EUR' "
        "WHEN 2 THEN '(' || format('{:,.2f}', abs(CAST(total_d AS DOUBLE))) || ')' WHEN 3 THEN 'USD ' || CAST(total_d AS VARCHAR) "
        "WHEN 4 THEN ' ' || translate(us, ',.', ' ,') || ' ' WHEN 5 THEN us || ' of 7' WHEN 6 THEN '1e5' "
        "ELSE 'total ' || us END AS total_text, "
        "CASE WHEN doc_key % 8 IN (5, 6, 7) THEN NULL WHEN doc_key % 8 = 2 THEN '-' || CAST(abs(total_d) AS VARCHAR) "
        "ELSE CAST(total_d AS VARCHAR) END AS total_norm "
        "FROM (SELECT *, format('{:,.2f}', CAST(total_d AS DOUBLE)) AS us FROM pr) pr",
        _PRINTED,
    ),
    "grounding_check": with_adapter(
        "SELECT doc_key, count(*) AS n_values, count(*) FILTER (WHERE found) AS n_grounded, "
        "coalesce(string_agg(CASE WHEN NOT found THEN field END, ',' ORDER BY field), '') AS ungrounded FROM ("
        "SELECT doc_key, field, value, contains(lower(txt), lower(value)) AS found FROM ("
        "SELECT doc_key, 'INVOICE ' || coalesce(document_id, '') || ' / Vendor: ' || upper(vendor_name) || "
        "' / Bill to: ' || coalesce(customer_name, '') || "
        "CASE WHEN doc_key % 10 <> 1 THEN ' / Currency: ' || coalesce(currency, '') ELSE '' END || "
        "' / Amount due: ' || CAST(total_d AS VARCHAR) AS txt, "
        "[('document_id', document_id), ('vendor_name', vendor_name), ('customer_name', customer_name), "
        "('currency', currency), ('total', CAST(total_d AS VARCHAR))] AS kv FROM pr) a, "
        "LATERAL (SELECT unnest(kv, recursive := true)) b(field, value) WHERE value IS NOT NULL) c GROUP BY doc_key",
        _PRINTED,
    ),
}


VALUE_SQL["normalize_source_dates"] = """
WITH d AS (
  SELECT o_orderkey AS doc_key, o_custkey AS source, CAST(o_orderdate AS DATE) AS od,
         o_custkey % 3 = 0 OR (o_custkey % 3 = 2 AND o_orderkey % 2 = 0) AS day_first
  FROM orders
),
t AS (
  SELECT *, CASE WHEN doc_key % 7 = 0 THEN strftime(od, '%-d ') || ['Marble', 'Decoy', 'Janus', 'Sep', 'Sept', 'Octobe'][1 + doc_key % 6] || strftime(od, ' %Y')
              WHEN day_first THEN strftime(od, '%d/%m/%Y') ELSE strftime(od, '%m/%d/%Y') END AS date_text,
         doc_key % 7 <> 0 AND day(od) > 12 AND day_first AS says_day, doc_key % 7 <> 0 AND day(od) > 12 AND NOT day_first AS says_month
  FROM d
),
p AS (SELECT *, bool_or(says_day) OVER w AS any_day, bool_or(says_month) OVER w AS any_month FROM t WINDOW w AS (PARTITION BY source))
SELECT doc_key, source, date_text,
       CASE WHEN doc_key % 7 = 0 THEN CASE doc_key % 6 WHEN 3 THEN 9 WHEN 4 THEN 9 WHEN 5 THEN 10 END END AS word_month,
       CASE WHEN doc_key % 7 = 0 THEN
              CASE WHEN doc_key % 6 < 3 THEN NULL
                   ELSE strftime(try_cast(strftime(od, '%Y-') || CASE WHEN doc_key % 6 = 5 THEN '10' ELSE '09' END || strftime(od, '-%d') AS DATE), '%Y-%m-%d') END
            WHEN day(od) > 12 OR day(od) = month(od) THEN strftime(od, '%Y-%m-%d')
            WHEN any_day AND any_month THEN NULL
            WHEN any_day THEN CASE WHEN day_first THEN strftime(od, '%Y-%m-%d') ELSE strftime(od, '%Y-%d-%m') END
            WHEN any_month THEN CASE WHEN day_first THEN strftime(od, '%Y-%d-%m') ELSE strftime(od, '%Y-%m-%d') END END AS date_norm
FROM p
"""


VALUE_SQL["envelope_roundtrip"] = with_rules(
    "SELECT s.doc_key, true AS schema_valid, s.status, CAST(count(i.code) AS INTEGER) AS n_issues, "
    "CAST(h.total_d AS VARCHAR) AS total FROM doc_status s JOIN doc_header h USING (doc_key) "
    "LEFT JOIN all_issues i USING (doc_key) GROUP BY s.doc_key, s.status, h.total_d"
)


SOURCE_SQL["canonical_text"] = "WITH " + _cells_judged(100, 10000, 4096, 450) + """,
parts AS (
  SELECT file, sheet_idx, 0 AS part, 0 AS row, 'sheet ' || sheet_idx || ': "' || any_value(sheet) || '"' AS line
  FROM v GROUP BY file, sheet_idx
  UNION ALL
  SELECT file, sheet_idx, 1, row, line FROM v
),
texts AS (
  SELECT file, 'XLSX visible sheets as JSON rows (formula text and cached values are labeled separately):' || chr(10)
         || string_agg(line || chr(10), '' ORDER BY sheet_idx, part, row) AS text
  FROM parts GROUP BY file
)
SELECT j.file, CASE WHEN j.error IS NULL THEN t.text END AS text,
       CASE WHEN j.error IS NOT NULL THEN 3 END AS error_code, j.error
FROM judged j LEFT JOIN texts t USING (file)
"""

SOURCE_SQL["package_metadata"] = """
SELECT 'meta-' || p_partkey || '.xlsx' AS file, ek[1] AS error_kind, ek[2] AS error, CASE WHEN ek IS NOT NULL THEN 3 END AS error_code
FROM (
  SELECT p_partkey, CASE
    WHEN p_partkey % 23 = 7 THEN ['Corrupt', 'XLSX package is corrupt']
    WHEN p_partkey % 17 = 4 THEN ['Unsupported', 'Encrypted XLSX ZIP entries are not supported']
    WHEN p_partkey % 5 = 2 THEN ['Corrupt', 'XLSX package is corrupt']
    WHEN p_partkey % 5 IN (1, 3) THEN ['Unsupported', 'XLSX active content is not supported']
    WHEN p_partkey % 11 = 5 THEN ['Corrupt', 'XLSX package is corrupt']
    WHEN p_partkey % 7 = 6 AND p_partkey % 11 <> 6 THEN ['Limit', 'XLSX has 24 sheets; limit is 20']
    WHEN p_partkey % 13 IN (3, 4) THEN ['Corrupt', 'XLSX package is corrupt']
    WHEN p_partkey % 13 = 1 THEN ['Unsupported', 'XLSX external relationships are not supported']
    WHEN p_partkey % 13 = 2 THEN ['Unsupported', 'XLSX active content is not supported']
    WHEN p_partkey % 19 = 6 THEN ['Corrupt', 'XLSX ZIP checksum failed for _rels/.rels']
  END AS ek FROM part
) t
"""


# --------------------------------------------------------------------------- whole report, stored notices, whole batch
def _report_sql() -> str:
    e = {k: f"({EVALUATION_SQL[k]}) t" for k in EVALUATION_SQL}

    def row(section: str, item: str, num: str, den: str, of: str) -> str:
        return f"SELECT '{section}' AS section, {item} AS item, CAST({num} AS BIGINT) AS numerator, CAST({den} AS BIGINT) AS denominator FROM {e[of]}"

    tp, fp, fn = "true_positive", "false_positive", "false_negative"
    rows = [
        row("processing", "'processed'", "processed", "fixture_count", "eval_processing"),
        row("processing", "'schema_valid'", "schema_valid", "fixture_count", "eval_processing"),
        row("header_exact_match", "'matched'", "header_matched", "header_compared", "header_match"),
        row("decimal_accuracy", "'matched'", "decimal_matched", "decimal_compared", "header_match"),
        row("hallucinations", "'count'", "hallucination_count", "NULL", "hallucinations"),
    ]
    for section, of in (("line_items", "line_item_prf"), ("validation_detection", "issue_code_prf")):
        rows += [
            row(section, "'precision'", tp, f"{tp} + {fp}", of),
            row(section, "'recall'", tp, f"{tp} + {fn}", of),
            row(section, "'f1'", "round(f1 * 10000)", "10000", of),
        ]
    for c in ("processed", "schema_valid"):
        rows.append(row("breakdown", f"dimension || '=' || grp || ' {c}'", c, "fixtures", "eval_breakdown"))
    rows.append(
        "SELECT 'failures', split_part(error, ':', 1), CAST(count(*) AS BIGINT), CAST(NULL AS BIGINT) "
        f"FROM {e['eval_failures']} GROUP BY split_part(error, ':', 1)"
    )
    return "\nUNION ALL\n".join(rows)


EVALUATION_SQL["eval_report"] = _report_sql()

JSON_SQL["revalidate_v2"] = with_rules(
    "SELECT code, severity, count(*) AS n_issues, count(DISTINCT doc_key) AS n_docs FROM ("
    "SELECT code, severity, doc_key FROM all_issues UNION ALL "
    f"SELECT '{S.NOTICE_NO_NATIVE_TEXT[0]}', '{S.NOTICE_NO_NATIVE_TEXT[1]}', doc_key FROM doc_header WHERE doc_key % 5 = 0 UNION ALL "
    f"SELECT '{S.NOTICE_XLSX_FORMULA_PRESENT[0]}', '{S.NOTICE_XLSX_FORMULA_PRESENT[1]}', doc_key FROM doc_header WHERE doc_key % 7 = 0"
    ") x GROUP BY code, severity"
)

EXTRACTION_SQL["repair_once"] = with_adapter(
    "SELECT doc_key, CAST(CASE WHEN bad AND NOT none THEN 2 ELSE 1 END AS INTEGER) AS attempts, "
    "CASE WHEN none THEN 'provider_error' WHEN NOT bad OR doc_key % 2 = 0 THEN 'ok' ELSE 'schema_error' END AS outcome, "
    "CASE WHEN none THEN 4 WHEN NOT bad OR doc_key % 2 = 0 THEN NULL ELSE 5 END AS exit_code "
    f"FROM (SELECT h.doc_key, h.doc_key % 29 = 0 AS none, {_DAMAGED} AS bad FROM doc_header h LEFT JOIN nl USING (doc_key)) x",
    _LINE_COUNTS,
)

EXTRACTION_SQL["extract_isolated"] = """
SELECT o_orderkey AS doc_key,
       CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 211 = 5 OR o_orderkey % 29 = 0 OR o_orderkey % 151 = 3 THEN NULL ELSE '{}' END AS json,
       CASE WHEN o_orderkey % 101 = 0 THEN 'extractor raised ValueError' WHEN o_orderkey % 211 = 5 THEN 'extractor gave another number of answers'
            WHEN o_orderkey % 151 = 3 THEN 'answer is no text' END AS call_error
FROM orders
"""

_MESSAGES = " ".join(
    f"WHEN '{code}' THEN '{text}'"
    for code, text in (
        ("INVALID_DATE", S.MSG_INVALID_DATE),
        ("DUE_BEFORE_ISSUE", S.MSG_DUE_BEFORE_ISSUE),
        ("DELIVERY_BEFORE_ISSUE", S.MSG_DELIVERY_BEFORE_ISSUE),
        ("UNKNOWN_CURRENCY", S.MSG_UNKNOWN_CURRENCY),
        ("MISSING_IDENTIFIER", S.MSG_MISSING_IDENTIFIER),
        ("MISSING_REFERENCE", S.MSG_MISSING_REFERENCE),
        ("NO_LINE_ITEMS", S.MSG_NO_LINE_ITEMS),
        ("BALANCED_REVERSAL", S.MSG_BALANCED_REVERSAL),
        ("LINE_AMOUNT_MISMATCH", S.MSG_LINE_AMOUNT_MISMATCH),
        ("DUPLICATE_LINE", S.MSG_DUPLICATE_LINE),
        ("NEGATIVE_VALUE", S.MSG_NEGATIVE_VALUE),
        ("CREDIT_SIGN_INCONSISTENCY", S.MSG_CREDIT_SIGN),
        ("SUBTOTAL_MISMATCH", S.MSG_SUBTOTAL_MISMATCH),
        ("TOTAL_MISMATCH", S.MSG_TOTAL_MISMATCH),
    )
)

EXTRACTION_SQL["batch_envelopes"] = with_rules(
    f"""SELECT path AS doc_key, page_count, sheet_count, n_notices, pos, code, severity, message, field, error_code FROM (
  SELECT f.path, f.page_count, f.sheet_count, f.n_notices, f.error_code, i.code, i.severity, i.field,
         CASE WHEN i.code IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY f.k ORDER BY i.g, i.line_idx, i.sub) - 1 AS INTEGER) END AS pos,
         CASE WHEN i.code = 'CREDIT_TOTAL_UNVERIFIABLE' THEN CASE i.sub WHEN 0 THEN '{S.MSG_CREDIT_NO_POLARITY}' ELSE '{S.MSG_CREDIT_INCOMPLETE}' END
              WHEN i.g = 14 THEN i.message ELSE CASE i.code {_MESSAGES} END END AS message
  FROM (
    SELECT *, CASE WHEN error_code IS NULL AND kind <> 'xlsx' THEN 1 END AS page_count,
           CASE WHEN error_code IS NULL AND kind = 'xlsx' THEN least(n, 2) END AS sheet_count,
           CASE WHEN error_code IS NULL THEN CASE WHEN kind = 'pdf' AND k % 4 = 0 OR kind = 'xlsx' AND k % 7 = 0 THEN 1 ELSE 0 END END AS n_notices
    FROM (
      SELECT k, 'in/wb-' || k || '.' || kind AS path, kind, n,
             CASE WHEN kind = 'pdf' AND k % 31 = 0 THEN 3
                  WHEN kind = 'xlsx' AND (n = 0 OR k % 97 = 0 OR (k % 7 = 0 AND n = 1)) THEN 3
                  WHEN k % 29 = 0 THEN 4 END AS error_code
      FROM (SELECT o_orderkey AS k, ['pdf', 'txt', 'xlsx'][o_orderkey % 3 + 1] AS kind, count(l_orderkey) AS n
            FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) a
    ) b
  ) f
  LEFT JOIN (
    SELECT doc_key, g, line_idx, sub, code, severity, field, NULL AS message FROM all_issues
    UNION ALL
    SELECT doc_key, 14, 0, 0, '{S.NOTICE_NO_NATIVE_TEXT[0]}', '{S.NOTICE_NO_NATIVE_TEXT[1]}', NULL, '{S.NOTICE_NO_NATIVE_TEXT[2]}'
    FROM doc_header WHERE doc_key % 3 = 0 AND doc_key % 4 = 0
    UNION ALL
    SELECT doc_key, 14, 0, 0, '{S.NOTICE_XLSX_HIDDEN_CODE}', 'warning', NULL, '1{S.NOTICE_XLSX_HIDDEN_SUFFIX}'
    FROM doc_header WHERE doc_key % 3 = 2 AND doc_key % 7 = 0
  ) i ON i.doc_key = f.k AND f.error_code IS NULL
) z"""
)

# the rows of batch_envelopes are one an issue, one an envelope without issues, one a failed file
_BATCH_ROWS = EXTRACTION_SQL["batch_envelopes"]
EXTRACTION_SQL["batch_resumed"] = f"""SELECT run, CASE run WHEN 'resumed' THEN asked ELSE 0 END AS asked, processed, failed,
       CAST(coalesce(worst, CASE WHEN processed + failed = 0 THEN 3 WHEN n_review > 0 THEN 2 ELSE 0 END) AS INTEGER) AS exit_code,
       processed AS n_envelopes, n_issues, n_review
FROM (
  SELECT count(*) FILTER (WHERE error_code IS NULL) AS processed, count(error_code) AS failed, max(error_code) AS worst,
         count(*) FILTER (WHERE error_code IS NULL OR error_code = 4) AS asked,
         CAST(coalesce(sum(issues), 0) AS BIGINT) AS n_issues, count(*) FILTER (WHERE serious > 0) AS n_review
  FROM (
    SELECT doc_key, max(error_code) AS error_code, count(code) AS issues, count(*) FILTER (WHERE severity IN ('error', 'warning')) AS serious
    FROM ({_BATCH_ROWS}) r GROUP BY doc_key
  ) d
) t, (VALUES ('resumed'), ('repeated')) v(run)"""
