"""Document tables derived from the driver's TPC-H-style tables.

One order becomes one business document (``doc_key = o_orderkey``); its
lineitems become line items.  Deterministic rules keyed on the order key
``k`` and part key ``pk`` plant every kind of defect the validation rules
look for, so the rule engine does real work over the whole tables:

* type by ``k % 4`` (invoice, receipt, purchase_order, credit_note);
  negative-signed credit notes when ``k % 8 == 3``;
* ``document_id`` null when ``k % 11 == 0``; credit-note reference when ``k % 3 != 0``;
* bad issue dates (``k % 13``: 2023-02-29, ``k % 43``: 2026-8-03); due date
  ``k % 40 - 5`` days after the order date, null when ``k % 7 == 0``;
  purchase-order delivery ``k % 30 - 3`` days after;
* currency by ``k % 9``: EUR, INR, ``usd``, null, else USD;
* line ``i`` at position ``4i``; an exact copy at ``4i+1`` when ``pk % 17 == 0``;
  a reversing copy (upper-case description with two leading spaces, negated
  price and amount) at ``4i+2`` when ``pk % 10 == 0``;
* description null when ``(pk+k) % 37 == 0``; amount off by 0.02 when
  ``pk % 23 == 0`` or 0.01 when ``pk % 29 == 0``; amount null when ``(pk+k) % 31 == 0``;
* subtotal null when ``k % 47 == 0`` and off by 5.00 when ``k % 19 == 0``;
  discount 10 when ``k % 6 == 0``; tax 8 when ``k % 5 != 0`` (sign flipped
  when ``k % 53 == 0``); total off by 1.00 when ``k % 21 == 0``.

Money is emitted as plain decimal strings (quantities scale 0, prices and
amounts scale 2).  Shuffles: the ranks of an order's lines (skew-safe, see
``sum_before``), one aggregate for the subtotal, and joins with ``part``,
``customer`` and ``nation``, whose strategy AQE picks by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.money import money_text
from docaudit.functions.ranks import sum_before
from docaudit.session import cut_lineage, read_table

DEC = "decimal(18,6)"


@dataclass
class DocumentTables:
    headers: DataFrame  # doc_key + header columns (money as strings)
    lines: DataFrame  # doc_key, idx, document_type, description, quantity, unit_price, amount


def _doc_type(k: Column) -> Column:
    m = k % 4
    return (
        F.when(m == 0, "invoice")
        .when(m == 1, "receipt")
        .when(m == 2, "purchase_order")
        .otherwise("credit_note")
    )


def _sign(k: Column) -> Column:
    return F.when(k % 8 == 3, F.lit(-1)).otherwise(F.lit(1))


def build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    k = F.col("l_orderkey")
    pk = F.col("l_partkey")
    sign = _sign(k)
    has_dup = (pk % 17 == 0).cast("int")
    has_rev = (pk % 10 == 0).cast("int")
    # first idx of this base line = lines (with copies) emitted by earlier base lines
    li = sum_before(
        li, "l_orderkey", "l_linenumber", ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"),
        1 + has_dup + has_rev, "first_idx",
    )
    base = li.join(part, F.col("l_partkey") == F.col("p_partkey"), "inner")
    q = F.col("l_quantity").cast(DEC)
    u = F.col("p_retailprice").cast("decimal(18,2)").cast(DEC)
    adjust = (
        F.when(pk % 23 == 0, F.lit(0.02).cast(DEC))
        .when(pk % 29 == 0, F.lit(0.01).cast(DEC))
        .otherwise(F.lit(0).cast(DEC))
    )
    amount = F.when((pk + k) % 31 == 0, F.lit(None).cast(DEC)).otherwise(q * u + adjust)
    desc = F.when((pk + k) % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name"))
    prepared = base.select(
        k.alias("doc_key"),
        "first_idx",
        has_dup.alias("has_dup"),
        has_rev.alias("has_rev"),
        desc.alias("description"),
        q.alias("q"),
        (u * sign).alias("u"),
        (amount * sign).alias("a"),
    )
    # variants: 0 = base, 1 = exact copy, 2 = reversing copy; nulls go after the explode, which is generated code then
    variants = F.array(F.lit(0), F.when(F.col("has_dup") == 1, 1), F.when(F.col("has_rev") == 1, 2))
    exploded = prepared.select("*", F.explode(variants).alias("variant")).filter(F.col("variant").isNotNull())
    rev = F.col("variant") == 2
    idx = F.col("first_idx") + F.when(F.col("variant") == 0, 0).when(
        F.col("variant") == 1, 1
    ).otherwise(1 + F.col("has_dup"))
    return exploded.select(
        F.col("doc_key"),
        idx.cast("int").alias("idx"),
        _doc_type(F.col("doc_key")).alias("document_type"),
        F.when(rev, F.concat(F.lit("  "), F.upper("description"))).otherwise(F.col("description")).alias(
            "description"
        ),
        money_text(F.col("q"), 0).alias("quantity"),
        money_text(F.when(rev, -F.col("u")).otherwise(F.col("u")), 2).alias("unit_price"),
        money_text(F.when(rev, -F.col("a")).otherwise(F.col("a")), 2).alias("amount"),
    )


def build_headers(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sums = lines.groupBy("doc_key").agg(F.sum(F.col("amount").cast(DEC)).alias("line_sum"))
    k = F.col("o_orderkey")
    sign = _sign(k)
    odate = F.to_date("o_orderdate")
    line_sum = F.coalesce(F.col("line_sum"), F.lit(0).cast(DEC))
    subtotal = F.when(k % 47 == 0, F.lit(None).cast(DEC)).otherwise(
        line_sum + F.when(k % 19 == 0, F.lit(5).cast(DEC)).otherwise(F.lit(0).cast(DEC))
    )
    discount = F.when(k % 6 == 0, (sign * 10).cast(DEC))
    tax = F.when(
        k % 5 != 0, (sign * F.when(k % 53 == 0, F.lit(-8)).otherwise(F.lit(8))).cast(DEC)
    )
    total = (
        F.coalesce(subtotal, line_sum)
        - F.coalesce(discount, F.lit(0).cast(DEC))
        + F.coalesce(tax, F.lit(0).cast(DEC))
        + F.when(k % 21 == 0, F.lit(1).cast(DEC)).otherwise(F.lit(0).cast(DEC))
    )
    doc_type = _doc_type(k)
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(sums, orders.o_orderkey == sums.doc_key, "left")
    )
    currency = F.when(k % 9 == 0, "EUR").when(k % 9 == 1, "INR").when(k % 9 == 2, "usd").when(
        k % 9 == 3, F.lit(None).cast("string")
    ).otherwise("USD")
    return joined.select(
        k.alias("doc_key"),
        doc_type.alias("document_type"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("DOC-"), k.cast("string"))
        ).alias("document_id"),
        F.when(
            (doc_type == "credit_note") & (k % 3 != 0), F.concat(F.lit("DOC-"), (k - 3).cast("string"))
        ).alias("reference_document_id"),
        F.struct(
            F.concat(F.col("n_name"), F.lit(" Supplies")).alias("name"),
            F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(
                F.concat(F.lit("VAT-"), F.col("c_nationkey").cast("string"))
            ).alias("tax_id"),
            F.lit(None).cast("string").alias("address"),
        ).alias("vendor"),
        F.col("c_name").alias("customer_name"),
        F.when(k % 13 == 0, F.lit("2023-02-29"))
        .when(k % 43 == 0, F.lit("2026-8-03"))
        .otherwise(F.date_format(odate, "yyyy-MM-dd"))
        .alias("issue_date"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(
            F.date_format(F.date_add(odate, (k % 40 - 5).cast("int")), "yyyy-MM-dd")
        ).alias("due_date"),
        F.when(
            doc_type == "purchase_order",
            F.date_format(F.date_add(odate, (k % 30 - 3).cast("int")), "yyyy-MM-dd"),
        ).alias("delivery_date"),
        currency.alias("currency"),
        money_text(subtotal, 2).alias("subtotal"),
        money_text(discount, 2).alias("discount"),
        money_text(tax, 2).alias("tax"),
        F.lit(None).cast("string").alias("shipping"),
        money_text(total, 2).alias("total"),
    )


def document_tables(spark: SparkSession, sf_dir: str, materialize: bool = True, headers: bool = True) -> DocumentTables:
    """Header and line tables.

    With ``materialize`` both are written once to the checkpoint folder for
    queries that read them in several branches; every call builds them anew
    from the input.  Without it nothing runs before the caller's action, and
    Catalyst drops the joins whose columns are not used.  ``headers=False`` leaves
    the headers unwritten: they come out of a join by document, so a caller that
    joins them by document once more needs no shuffle for it.
    """
    keep = cut_lineage if materialize else (lambda df, name: df)
    lines = keep(build_lines(spark, sf_dir), "doc_lines")
    heads = build_headers(spark, sf_dir, lines)
    return DocumentTables(headers=keep(heads, "doc_headers") if headers else heads, lines=lines)
