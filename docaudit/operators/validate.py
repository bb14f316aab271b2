"""Deterministic validation rules over document tables -> ordered issues + status.

Inputs (all money as plain-decimal strings):

* ``headers``: ``doc_key`` plus the header columns of the record
  (``document_type`` ... ``total``).  ``vendor`` and ``customer_name`` are
  not used by the rules.
* ``lines``: ``doc_key, idx`` (0-based list position), ``description,
  quantity, unit_price, amount`` and, ideally, ``document_type`` (carried
  from the record when it is flattened; joined from ``headers`` otherwise).
* ``notices`` (optional): ``doc_key, pos, code, severity, message, field``.

Plan shape (see ``explain``):

* date, currency and identifier rules are a plain projection of ``headers``;
* sums and signs come from one per-document aggregate of the lines (partial
  aggregation before the shuffle); reversal pairs only lower its counts, so
  lines are never joined with their roles as a whole;
* the previous-line rule is ``lag`` inside fixed-size idx blocks plus a join of
  the block borders, so a document with very many lines is spread over tasks; it
  shares its shuffle of the lines with the reversal pairs (``line_marks``);
* ``codes`` names the rules that are wanted: the others' branches are not built;
* reversal pairing ranks eligible lines within ``(doc_key, key, sign)`` using
  fixed-size idx blocks: a window over a block (bounded by ``block_size``
  rows) plus, in documents of several blocks, a prefix sum over per-block counts.
  The r-th negative line of a key pairs with the r-th positive line, which is
  exactly the first-in first-out queue of the record contract.

Issue order follows the record contract: ``(g, line_idx, sub)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit import schema as S
from docaudit.config import TOLERANCE
from docaudit.functions import limbs
from docaudit.functions.dates import is_canonical_date, parse_date
from docaudit.functions.money import above, below, decimal_of, decimal_text, plain, product_differs, product_text, scale_of, sum_differs
from docaudit.functions.text import normalize
from docaudit.session import cut_lineage

ISSUE_FIELDS = ("code", "severity", "message", "field", "expected", "actual")
ORDER_FIELDS = ("g", "line_idx", "sub")


@dataclass
class Validation:
    headers: DataFrame  # doc_key and more
    issues: DataFrame  # doc_key, g, line_idx, sub, code, severity, message, field, expected, actual

    @property
    def status(self) -> DataFrame:
        """doc_key, status, review_required, n_error, n_warning, n_info"""
        return document_status(self.headers, self.issues)

    def nested(self) -> DataFrame:
        """doc_key, validation struct<status, review_required, issues[]> in contract order."""
        return nested_validation(self.headers, self.issues)


#: A condition and the columns of the issue that holds where it does.
Candidate = tuple[Column, dict[str, Column]]


def _issue(
    g: int,
    line_idx: Column | int,
    sub: int,
    code: str,
    severity: str,
    message: str,
    field: Column | str | None,
    expected: Column | str | None = None,
    actual: Column | str | None = None,
) -> dict[str, Column]:
    def lit_or_col(v: Column | str | int | None, typ: str = "string") -> Column:
        if isinstance(v, Column):
            return v.cast(typ)
        return F.lit(v).cast(typ)

    return {
        "g": F.lit(g), "line_idx": lit_or_col(line_idx, "int"), "sub": F.lit(sub),
        "code": F.lit(code), "severity": F.lit(severity), "message": F.lit(message),
        "field": lit_or_col(field), "expected": lit_or_col(expected), "actual": lit_or_col(actual),
    }


def _different(left: Column, right: Column, tolerance: Decimal) -> Column:
    # not their difference: that of a sum of lines could lose its last digit
    bound = F.lit(tolerance).cast("decimal(18,6)")
    return (left > right + bound) | (left < right - bound)


def _collect_issues(df: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """One output row per candidate whose condition holds in a row.

    What is exploded is the numbers of the candidates, as they are; nulls go
    afterwards: of an array that is filtered first, Spark would also make a filter
    below, which computes every condition a second time, from the source columns.
    An issue's columns are made from its row afterwards, so a reader of codes
    alone makes no text.
    """
    holds = F.array(*[F.when(cond, F.lit(n)) for n, (cond, _) in enumerate(candidates)])
    each = df.select("*", F.explode(holds).alias("__n")).filter(F.col("__n").isNotNull())

    def column(name: str) -> Column:
        out = candidates[-1][1][name]
        for n in range(len(candidates) - 2, -1, -1):
            out = F.when(F.col("__n") == n, candidates[n][1][name]).otherwise(out)
        return out.alias(name)

    return each.select("doc_key", *[column(c) for c in ORDER_FIELDS + ISSUE_FIELDS])


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


# --------------------------------------------------------------------------- lines


def prepare_lines(lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Lines with their money as canonical text (q, u, a) and, where it fits, as decimal (qd, ud, ad)."""
    if "document_type" not in lines.columns:
        if headers is None:
            raise ValueError("lines need document_type, or pass headers to join it")
        lines = lines.join(headers.select("doc_key", "document_type"), "doc_key", "left")
    return lines.select(
        "doc_key",
        F.col("idx").cast("int").alias("idx"),
        (F.col("document_type") == "credit_note").alias("is_credit"),
        "description",
        "quantity",
        "unit_price",
        "amount",
        plain(F.col("quantity")).alias("q"),
        plain(F.col("unit_price")).alias("u"),
        plain(F.col("amount")).alias("a"),
    ).select("*", *[decimal_of(F.col(c)).alias(c + "d") for c in ("q", "u", "a")])


def _reversal_key(of: str = "") -> dict[str, Column]:
    """Key and sign of a line that a pair may hold, null for others; ``of`` is the struct that has the line's values, if any.

    The key is one text of the absolute numbers and the normalized description,
    nulls equal: no number is empty or holds a semicolon, and the free text comes last.
    """
    c = lambda name: F.col(f"{of}.{name}" if of else name)
    eligible = c("description").isNotNull() & (c("a") != "0")
    numbers = [F.concat(F.coalesce(F.ltrim(c(n), F.lit("-")), F.lit("")), F.lit(";")) for n in ("q", "u", "a")]
    return {"rk": F.when(eligible, F.concat(*numbers, normalize(c("description")))), "neg": F.when(eligible, below(c("a")))}


def _block(block_size: int) -> Column:
    return F.floor(F.col("idx") / F.lit(block_size)).cast("int")


def _reaching(prepared: DataFrame, block_size: int) -> DataFrame:
    """Documents with a second block: one in ``block_size`` lines at most, since places have no gaps."""
    return F.broadcast(prepared.filter(F.col("idx") >= block_size).select("doc_key").distinct())


def _pairs_across_blocks(prepared: DataFrame, block_size: int) -> DataFrame:
    """Reversal pairs of the documents that have several blocks.

    Ranks are exact and skew-safe: row_number inside a block (a window over at
    most ``block_size`` rows) plus the count of the group's rows in earlier blocks
    (a prefix sum over per-block counts).  Pairing is one aggregate on
    (doc_key, key, rank): each group holds at most one negative and one positive line.
    """
    rows = prepared.join(_reaching(prepared, block_size), "doc_key", "left_semi").withColumns(_reversal_key())
    eligible = rows.filter(F.col("rk").isNotNull()).select("doc_key", "idx", "rk", "neg", _block(block_size).alias("blk"))
    grp = ["doc_key", "rk", "neg"]
    within = eligible.withColumn(
        "r_in", F.row_number().over(Window.partitionBy(*grp, "blk").orderBy("idx"))
    )
    per_block = eligible.groupBy(*grp, "blk").agg(F.count(F.lit(1)).alias("n"))
    offsets = per_block.select(
        *grp,
        "blk",
        F.coalesce(
            F.sum("n").over(
                Window.partitionBy(*grp).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("off"),
    )
    # rows of the first block need no offset; only later blocks join their offsets
    first = within.filter(F.col("blk") == 0).select("doc_key", "rk", "neg", "idx", F.col("r_in").alias("rank"))
    later = within.filter(F.col("blk") > 0).join(offsets.filter(F.col("blk") > 0), grp + ["blk"]).select(
        "doc_key", "rk", "neg", "idx", (F.col("r_in") + F.col("off")).alias("rank")
    )
    ranked = first.unionByName(later)
    matched = (
        ranked.groupBy("doc_key", "rk", "rank")
        .agg(
            F.max(F.when(F.col("neg"), F.col("idx"))).alias("neg_idx"),
            F.max(F.when(~F.col("neg"), F.col("idx"))).alias("pos_idx"),
        )
        .filter(F.col("neg_idx").isNotNull() & F.col("pos_idx").isNotNull())
    )
    return matched.select("doc_key", "neg_idx", "pos_idx")


def line_marks(prepared: DataFrame, block_size: int = 4096, duplicates: bool = True) -> DataFrame:
    """(doc_key, idx, pos_idx, dup): lines that are the negative half of a balanced reversal, with the positive one, and lines that equal the line before (if ``duplicates``).

    The lines are shuffled once, by document and block of places; all windows lie
    inside a block, so a document with very many lines is spread over tasks.  Within
    a (doc_key, key, sign) group the r-th negative pairs with the r-th positive, in
    a document of one block without another shuffle.  Only blocks with both signs
    are ranked.  Documents with several blocks: see ``_pairs_across_blocks`` and,
    for the borders, ``_border_duplicates``.
    """
    of = ["doc_key", "blk"]
    value = F.struct("description", "q", "u", "a")  # all that is shuffled of a line beside its place
    rows = prepared.select("doc_key", "idx", value.alias("v"), _block(block_size).alias("blk"))
    dup = F.lit(False)
    if duplicates:
        before = Window.partitionBy(*of).orderBy("idx")
        rows = rows.withColumns({"p": F.lag("v").over(before), "p_idx": F.lag("idx").over(before)})
        dup = F.coalesce((F.col("p_idx") == F.col("idx") - 1) & F.col("v").eqNullSafe(F.col("p")), F.lit(False))
    rows = rows.select(*of, "idx", *[c.alias(n) for n, c in _reversal_key("v").items()], dup.alias("dup"))
    block = Window.partitionBy(*of)
    rows = rows.withColumns({"some_neg": F.max("neg").over(block), "all_neg": F.min("neg").over(block)})
    open_ = F.col("rk").isNotNull() & (F.col("blk") == 0) & F.col("some_neg") & ~F.col("all_neg")
    rows = rows.filter(F.col("dup") | open_).withColumn("rk", F.when(open_, F.col("rk"))).select(*of, "idx", "rk", "neg", "dup")
    several = _reaching(prepared, block_size).withColumn("several", F.lit(True))
    rows = rows.join(F.broadcast(several), "doc_key", "left").withColumn("rk", F.when(F.col("several").isNull(), F.col("rk")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*of, "rk", "neg").orderBy("idx")))
    partner = F.max(F.when(~F.col("neg"), F.col("idx"))).over(Window.partitionBy(*of, "rk", "rank"))
    rows = rows.withColumn("partner", partner)
    marks = rows.select("doc_key", "idx", F.when(F.col("rk").isNotNull() & F.col("neg"), F.col("partner")).alias("pos_idx"), "dup")
    across = _pairs_across_blocks(prepared, block_size).select("doc_key", F.col("neg_idx").alias("idx"), "pos_idx", F.lit(False).alias("dup"))
    out = marks.filter(F.col("dup") | F.col("pos_idx").isNotNull()).unionByName(across)
    if duplicates:
        out = out.unionByName(_border_duplicates(prepared, block_size).select("doc_key", "idx", F.lit(None).cast("int").alias("pos_idx"), F.lit(True).alias("dup")))
    return out


def _pairs_of(marks: DataFrame) -> DataFrame:
    return marks.filter(F.col("pos_idx").isNotNull()).select("doc_key", F.col("idx").alias("neg_idx"), "pos_idx")


def reversal_pairs(prepared: DataFrame, block_size: int = 4096) -> DataFrame:
    """(doc_key, neg_idx, pos_idx) of every balanced reversal.

    Key = (normalized description, |quantity|, |unit_price|, |amount|), nulls
    equal; description and a non-zero amount are required.
    """
    return _pairs_of(line_marks(prepared, block_size, duplicates=False))


def duplicate_lines(prepared: DataFrame, block_size: int = 4096) -> DataFrame:
    """(doc_key, idx) of lines that equal the line before: lag inside idx blocks, a join for their borders."""
    value = F.struct("description", "q", "u", "a")
    rows = prepared.select("doc_key", "idx", value.alias("v"), _block(block_size).alias("blk"))
    before = Window.partitionBy("doc_key", "blk").orderBy("idx")
    inside = rows.select(
        "doc_key", "idx", "v", F.lag("v").over(before).alias("p"), F.lag("idx").over(before).alias("p_idx")
    ).filter((F.col("p_idx") == F.col("idx") - 1) & F.col("v").eqNullSafe(F.col("p")))
    return inside.select("doc_key", "idx").unionByName(_border_duplicates(prepared, block_size))


def _border_duplicates(prepared: DataFrame, block_size: int) -> DataFrame:
    """(doc_key, idx) of the first lines of a block that equal the last line of the block before."""
    rows = prepared.select("doc_key", "idx", F.struct("description", "q", "u", "a").alias("v"))
    firsts = rows.filter((F.col("idx") > 0) & (F.col("idx") % block_size == 0)).select("doc_key", "idx", "v")
    lasts = rows.filter(F.col("idx") % block_size == block_size - 1).select(
        "doc_key", (F.col("idx") + 1).alias("idx"), F.col("v").alias("p")
    )
    borders = firsts.join(lasts, ["doc_key", "idx"]).filter(F.col("v").eqNullSafe(F.col("p")))
    return borders.select("doc_key", "idx")


def duplicate_issues(duplicates: DataFrame) -> DataFrame:
    i = F.col("idx")
    issue = _issue(
        9, i, 1, "DUPLICATE_LINE", "warning", S.MSG_DUPLICATE_LINE, F.concat(F.lit("line_items."), i.cast("string"))
    )
    return _collect_issues(duplicates, [(F.lit(True), issue)])


def amount_issues(prepared: DataFrame, tolerance: Decimal) -> DataFrame:
    """LINE_AMOUNT_MISMATCH: a projection of the lines."""
    q, u, a, i = F.col("q"), F.col("u"), F.col("a"), F.col("idx")
    qd, ud, ad = F.col("qd"), F.col("ud"), F.col("ad")
    fit = qd.isNotNull() & ud.isNotNull() & ad.isNotNull()
    exact = limbs.times(limbs.number("q"), limbs.number("u"))
    bound = F.lit(tolerance).cast("decimal(18,6)")
    differs = F.when(fit, product_differs(qd, ud, ad, bound)).otherwise(
        F.coalesce(
            sum_differs([(1, (q, u)), (-1, (a,))], bound),
            F.expr(limbs.exceeds(limbs.plus(exact, limbs.minus(limbs.number("a"))), tolerance)),
        )
    )
    scale = scale_of(F.col("quantity")) + scale_of(F.col("unit_price"))
    # judged in a projection of its own, so that the texts are made for the lines that are off only
    judged = prepared.select(
        "doc_key", "idx", "quantity", "unit_price", "amount", "q", "u", "qd", "ud",
        fit.alias("fit"), (q.isNotNull() & u.isNotNull() & a.isNotNull() & differs).alias("off"),
    )
    return _collect_issues(
        judged,
        [
            (
                F.col("off"),
                _issue(
                    9, i, 0, "LINE_AMOUNT_MISMATCH", "warning", S.MSG_LINE_AMOUNT_MISMATCH,
                    F.concat(F.lit("line_items."), i.cast("string"), F.lit(".amount")),
                    F.when(F.col("fit"), product_text(qd, ud, scale)).otherwise(F.expr(limbs.decimal_text(exact, f"{limbs.scale('quantity')} + {limbs.scale('unit_price')}"))),
                    F.col("amount"),
                ),
            )
        ],
    )


def negative_line_issues(prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """NEGATIVE_VALUE of lines: only lines with a negative value meet the reversal pairs."""
    values = (("quantity", "q"), ("unit_price", "u"), ("amount", "a"))
    any_below = F.lit(False)
    for _, c in values:
        any_below = any_below | F.coalesce(below(F.col(c)), F.lit(False))
    # the pairs grow with the lines, however small their written table looks: merged, never broadcast
    halves = pairs.select("doc_key", F.col("neg_idx").alias("idx")).hint("merge")
    rows = prepared.filter(~F.coalesce(F.col("is_credit"), F.lit(False)) & any_below).join(halves, ["doc_key", "idx"], "left_anti")
    i = F.col("idx")
    return _collect_issues(
        rows,
        [
            (
                below(F.col(c)),
                _issue(
                    10, i, sub, "NEGATIVE_VALUE", "error", S.MSG_NEGATIVE_VALUE,
                    F.concat(F.lit("line_items."), i.cast("string"), F.lit("." + name)),
                    S.EXPECTED_NON_NEGATIVE,
                    F.col(name),
                ),
            )
            for sub, (name, c) in enumerate(values)
        ],
    )


def pair_issues(pairs: DataFrame) -> DataFrame:
    """BALANCED_REVERSAL per negative half."""
    neg = F.concat(F.lit("line_items."), F.col("neg_idx").cast("string"))
    pos = F.concat(F.lit("line_items."), F.col("pos_idx").cast("string"))
    return pairs.select(
        "doc_key",
        F.lit(8).alias("g"),
        F.col("neg_idx").cast("int").alias("line_idx"),
        F.lit(0).alias("sub"),
        F.lit("BALANCED_REVERSAL").alias("code"),
        F.lit("info").alias("severity"),
        F.lit(S.MSG_BALANCED_REVERSAL).alias("message"),
        neg.alias("field"),
        pos.alias("expected"),
        neg.alias("actual"),
    )


def line_aggregates(prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document: counts, amount sum and scale, and signs of amounts outside reversal pairs.

    A pair has one positive and one negative amount, so it lowers both counts by
    one.  ``amount_sum`` has the amounts that a decimal holds, ``wide_sum`` the
    others as text (null if there are none).
    """
    a = F.col("a")
    sums = prepared.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(a.isNull()).alias("n_amount_null"),
        F.sum("ad").alias("amount_sum"),
        F.max(scale_of(F.col("amount"))).alias("amount_scale"),
        F.count_if(above(a)).alias("n_above"),
        F.count_if(below(a)).alias("n_below"),
    )
    paired = pairs.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_pairs"))
    n = F.coalesce(F.col("n_pairs"), F.lit(0))
    return sums.join(paired, "doc_key", "left").join(wide_sums(prepared), "doc_key", "left").select(
        "doc_key", "n_lines", "n_amount_null", "amount_sum", "wide_sum", "amount_scale",
        (F.col("n_above") - n).alias("core_pos"), (F.col("n_below") - n).alias("core_neg"),
    )


def wide_sums(prepared: DataFrame) -> DataFrame:
    """(doc_key, wide_sum): exact sum, as plain text, of the amounts that no decimal holds.

    Limbs are summed by place (partial aggregates); what is gathered for a
    document is one row a place, so as many as its longest amount has limbs.
    """
    # a canonical text that no decimal holds has 15 characters at least, so most lines need no more than their length
    wide = prepared.where((F.length("amount") >= 15) & F.col("a").isNotNull() & F.col("ad").isNull())
    by_place = wide.select("doc_key", F.inline(F.expr(limbs.places("a")))).groupBy("doc_key", "place").agg(F.sum("limb").alias("limb"))
    gathered = by_place.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("place", "limb"))).alias("sums"))
    return gathered.select("doc_key", F.expr(limbs.plain_text(limbs.of_places("sums"))).alias("wide_sum"))


# --------------------------------------------------------------------------- headers


def header_stage(headers: DataFrame, line_agg: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Documents with their line sums and what follows from both; ``keep`` gets the joined rows, before anything is derived from them."""
    joined = keep(headers.select("doc_key", "document_type", *S.MONEY_FIELDS).join(line_agg, "doc_key", "left"), "doc_stage")
    j = joined.select("*", *[plain(F.col(f)).alias(f"{f}_t") for f in S.MONEY_FIELDS])
    j = j.select("*", *[decimal_of(F.col(f"{f}_t")).alias(f"{f}_d") for f in S.MONEY_FIELDS])
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0))
    is_credit = F.col("document_type") == "credit_note"
    sub, tot = F.col("subtotal_t"), F.col("total_t")

    def flag(cond: Column) -> Column:
        return F.coalesce(cond.cast("int"), F.lit(0))

    n_pos = F.coalesce(F.col("core_pos"), F.lit(0)) + flag(above(sub)) + flag(above(tot))
    n_neg = F.coalesce(F.col("core_neg"), F.lit(0)) + flag(below(sub)) + flag(below(tot))
    mixed = (n_pos > 0) & (n_neg > 0)
    no_polarity = (n_pos == 0) & (n_neg == 0)
    positive = n_pos > 0
    contradictions = F.filter(
        F.array(
            *[
                F.when((F.col(f"{f}_t") != "0") & (above(F.col(f"{f}_t")) != positive), F.lit(f))
                for f in ("discount", "tax", "shipping")
            ]
        ),
        lambda x: x.isNotNull(),
    )
    contra_n = F.when(mixed | no_polarity, F.lit(0)).otherwise(F.size(contradictions))
    consistent = ~mixed & (contra_n == 0)
    profile_known = ~mixed & ~no_polarity
    incomplete = F.filter(
        F.array(
            F.when(sub.isNull(), F.lit("subtotal")),
            F.when(tot.isNull(), F.lit("total")),
            F.when((n_lines > 0) & (F.col("n_amount_null") > 0), F.lit("line_items.amount")),
        ),
        lambda x: x.isNotNull(),
    )
    can_check = ~is_credit | (consistent & profile_known)
    return j.select(
        "*",
        n_lines.alias("n_lines_"),
        is_credit.alias("is_credit"),
        mixed.alias("mixed"),
        no_polarity.alias("no_polarity"),
        F.when(mixed | no_polarity, F.array().cast("array<string>")).otherwise(contradictions).alias(
            "contradictions"
        ),
        consistent.alias("consistent"),
        profile_known.alias("profile_known"),
        incomplete.alias("incomplete"),
        can_check.alias("can_check"),
    )


def header_only_issues(headers: DataFrame, codes: frozenset[str] | None = None) -> DataFrame:
    """Rules that read the header alone: a projection, nothing joined."""
    c = F.col
    is_credit = c("document_type") == "credit_note"
    dates = [("issue_date", 0), ("due_date", 1), ("delivery_date", 2)]
    issue_d, due_d, deliv_d = (parse_date(c(f)) for f, _ in dates)
    candidates: list[Candidate] = []
    for f, sub in dates:
        candidates.append(
            (
                ~_blank(c(f)) & ~is_canonical_date(c(f)),
                _issue(1, -1, sub, "INVALID_DATE", "error", S.MSG_INVALID_DATE, f, S.EXPECTED_DATE, c(f)),
            )
        )
    candidates += [
        (
            issue_d.isNotNull() & due_d.isNotNull() & (due_d < issue_d),
            _issue(2, -1, 0, "DUE_BEFORE_ISSUE", "warning", S.MSG_DUE_BEFORE_ISSUE, "due_date",
                   c("issue_date"), c("due_date")),
        ),
        (
            issue_d.isNotNull() & deliv_d.isNotNull() & (deliv_d < issue_d),
            _issue(3, -1, 0, "DELIVERY_BEFORE_ISSUE", "warning", S.MSG_DELIVERY_BEFORE_ISSUE,
                   "delivery_date", c("issue_date"), c("delivery_date")),
        ),
        (
            c("currency").isNull() | ~c("currency").isin(*S.KNOWN_CURRENCIES),
            _issue(4, -1, 0, "UNKNOWN_CURRENCY", "warning", S.MSG_UNKNOWN_CURRENCY, "currency",
                   S.EXPECTED_CURRENCY, c("currency")),
        ),
        (
            _blank(c("document_id")),
            _issue(5, -1, 0, "MISSING_IDENTIFIER", "warning", S.MSG_MISSING_IDENTIFIER, "document_id"),
        ),
        (
            is_credit & _blank(c("reference_document_id")),
            _issue(6, -1, 0, "MISSING_REFERENCE", "warning", S.MSG_MISSING_REFERENCE,
                   "reference_document_id"),
        ),
    ]
    of = ["INVALID_DATE"] * 3 + ["DUE_BEFORE_ISSUE", "DELIVERY_BEFORE_ISSUE", "UNKNOWN_CURRENCY", "MISSING_IDENTIFIER", "MISSING_REFERENCE"]
    for sub, f in enumerate(S.MONEY_FIELDS):
        candidates.append(
            (
                ~F.coalesce(is_credit, F.lit(False)) & below(plain(c(f))),
                _issue(10, -1, sub, "NEGATIVE_VALUE", "error", S.MSG_NEGATIVE_VALUE, f,
                       S.EXPECTED_NON_NEGATIVE, c(f)),
            )
        )
        of.append("NEGATIVE_VALUE")
    return _collect_issues(headers, [x for x, code in zip(candidates, of) if codes is None or code in codes])


def header_issues(stage: DataFrame, tolerance: Decimal) -> DataFrame:
    """Rules that need the header and its lines' sums and signs."""
    c = F.col
    candidates: list[Candidate] = [
        (
            c("n_lines_") == 0,
            _issue(7, -1, 0, "NO_LINE_ITEMS", "warning", S.MSG_NO_LINE_ITEMS, "line_items"),
        ),
    ]
    # g=11: contradictions (non-mixed case; the mixed case is built in credit_sign_issues)
    candidates += [
        (
            c("is_credit") & ~c("mixed") & (F.size("contradictions") > 0),
            _issue(11, -1, 0, "CREDIT_SIGN_INCONSISTENCY", "error", S.MSG_CREDIT_SIGN, "document",
                   S.EXPECTED_CREDIT_SIGN, F.array_join("contradictions", ", ")),
        ),
        (
            c("is_credit") & c("no_polarity"),
            _issue(11, -1, 0, "CREDIT_TOTAL_UNVERIFIABLE", "warning", S.MSG_CREDIT_NO_POLARITY,
                   "document"),
        ),
        (
            c("is_credit") & c("consistent") & c("profile_known") & (F.size("incomplete") > 0),
            _issue(11, -1, 1, "CREDIT_TOTAL_UNVERIFIABLE", "warning", S.MSG_CREDIT_INCOMPLETE,
                   "document", S.EXPECTED_CREDIT_COMPLETE, F.array_join("incomplete", ", ")),
        ),
    ]
    sub, tot, zero = c("subtotal_t"), c("total_t"), F.lit(0).cast("decimal(18,6)")
    sub_d, tot_d = c("subtotal_d"), c("total_d")
    lines_fit = sub_d.isNotNull() & c("wide_sum").isNull()
    or_zero = lambda name: limbs.number(f"coalesce(string({name}), '0')")
    lines_exact = limbs.plus(or_zero("amount_sum"), or_zero("wide_sum"))
    bound, nothing = F.lit(tolerance).cast("decimal(18,6)"), F.lit("0")
    short_sum = F.when(c("amount_sum").isNull(), nothing).otherwise(plain(c("amount_sum").cast("string")))
    lines_differ = F.when(lines_fit, _different(c("amount_sum"), sub_d, tolerance)).otherwise(
        F.coalesce(
            sum_differs([(1, (short_sum,)), (1, (F.coalesce(c("wide_sum"), nothing),)), (-1, (sub,))], bound),
            F.expr(limbs.exceeds(limbs.plus(lines_exact, limbs.minus(limbs.number("subtotal_t"))), tolerance)),
        )
    )
    lines_scale = F.greatest(F.lit(0), c("amount_scale"))
    texts = [c(f"{f}_t") for f in ("discount", "tax", "shipping")]
    adjustments = [c(f"{f}_d") for f in ("discount", "tax", "shipping")]
    total_fits = sub_d.isNotNull() & tot_d.isNotNull()
    for text, adjustment in zip(texts, adjustments):
        total_fits = total_fits & (text.isNull() | adjustment.isNotNull())
    expected_total = (
        sub_d - F.coalesce(adjustments[0], zero) + F.coalesce(adjustments[1], zero)
        + F.coalesce(adjustments[2], zero)
    )
    total_exact = limbs.plus(limbs.number("subtotal_t"), limbs.minus(or_zero("discount_t")), or_zero("tax_t"), or_zero("shipping_t"))
    parts = [(sign, (F.coalesce(text, nothing),)) for sign, text in zip((-1, 1, 1), texts)]
    total_differs = F.when(total_fits, _different(expected_total, tot_d, tolerance)).otherwise(
        F.coalesce(
            sum_differs([(1, (sub,)), *parts, (-1, (tot,))], bound),
            F.expr(limbs.exceeds(limbs.plus(total_exact, limbs.minus(limbs.number("total_t"))), tolerance)),
        )
    )
    # a zero (or absent) adjustment is replaced by Decimal(0): it adds no scale
    total_scale = F.greatest(
        scale_of(c("subtotal")),
        *[F.when(t != "0", scale_of(c(f))).otherwise(F.lit(0)) for t, f in zip(texts, ("discount", "tax", "shipping"))],
    )
    exact_scale = ", ".join(f"if({f}_t <> '0', {limbs.scale(f)}, 0)" for f in ("discount", "tax", "shipping"))
    exact_scale = f"greatest({limbs.scale('subtotal')}, {exact_scale})"
    candidates += [
        (
            c("can_check") & sub.isNotNull() & (c("n_lines_") > 0) & (c("n_amount_null") == 0) & lines_differ,
            _issue(12, -1, 0, "SUBTOTAL_MISMATCH", "error", S.MSG_SUBTOTAL_MISMATCH, "subtotal",
                   F.when(lines_fit, decimal_text(c("amount_sum"), lines_scale)).otherwise(F.expr(limbs.decimal_text(lines_exact, "greatest(0, amount_scale)"))),
                   c("subtotal")),
        ),
        (
            c("can_check") & sub.isNotNull() & tot.isNotNull() & total_differs,
            _issue(13, -1, 0, "TOTAL_MISMATCH", "error", S.MSG_TOTAL_MISMATCH, "total",
                   F.when(total_fits, decimal_text(expected_total, total_scale)).otherwise(F.expr(limbs.decimal_text(total_exact, exact_scale))),
                   c("total")),
        ),
    ]
    return _collect_issues(stage, candidates)


def mixed_credit_issues(stage: DataFrame, prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """CREDIT_SIGN_INCONSISTENCY when non-zero core values carry both signs.

    ``actual`` lists every non-zero core field: line amounts (balanced pairs
    excluded) in list order, then subtotal and total.  Only the mixed credit
    notes are joined back to their lines.
    """
    mixed = stage.filter(F.col("is_credit") & F.col("mixed")).select(
        "doc_key",
        F.filter(
            F.array(
                F.when(F.col("subtotal_t") != "0", F.lit("subtotal")),
                F.when(F.col("total_t") != "0", F.lit("total")),
            ),
            lambda x: x.isNotNull(),
        ).alias("head_fields"),
    )
    halves = pairs.select("doc_key", F.explode(F.array("neg_idx", "pos_idx")).alias("idx")).hint("merge")
    core_lines = (
        prepared.filter(F.col("is_credit") & (F.col("a") != "0"))
        .select("doc_key", "idx")
        .join(mixed.select("doc_key"), "doc_key", "left_semi")
        .join(halves, ["doc_key", "idx"], "left_anti")
        .groupBy("doc_key")
        .agg(F.array_sort(F.collect_list("idx")).alias("idxs"))
    )
    fields = F.concat(
        F.transform(
            F.coalesce(F.col("idxs"), F.array().cast("array<int>")),
            lambda i: F.concat(F.lit("line_items."), i.cast("string"), F.lit(".amount")),
        ),
        F.col("head_fields"),
    )
    return mixed.join(core_lines, "doc_key", "left").select(
        "doc_key",
        F.lit(11).alias("g"),
        F.lit(-1).alias("line_idx"),
        F.lit(0).alias("sub"),
        F.lit("CREDIT_SIGN_INCONSISTENCY").alias("code"),
        F.lit("error").alias("severity"),
        F.lit(S.MSG_CREDIT_SIGN).alias("message"),
        F.lit("document").alias("field"),
        F.lit(S.EXPECTED_CREDIT_SIGN).alias("expected"),
        F.array_join(fields, ", ").alias("actual"),
    )


def notice_issues(notices: DataFrame) -> DataFrame:
    return notices.select(
        "doc_key",
        F.lit(14).alias("g"),
        F.col("pos").cast("int").alias("line_idx"),
        F.lit(0).alias("sub"),
        "code",
        "severity",
        "message",
        F.col("field").cast("string").alias("field"),
        F.lit(None).cast("string").alias("expected"),
        F.lit(None).cast("string").alias("actual"),
    )


def _severities() -> list[Column]:
    return [F.count_if(F.col("severity") == kind).alias(f"n_{kind}") for kind in ("error", "warning", "info")]


def _judged(headers: DataFrame, counted: DataFrame) -> DataFrame:
    """Every document with its counts (0 without issues), status and review flag."""
    j = headers.select("doc_key").join(counted, "doc_key", "left")
    n_err, n_warn, n_info = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_error", "n_warning", "n_info"))
    return j.withColumns(
        {
            "status": F.when(n_err > 0, "fail").when(n_warn > 0, "warning").otherwise("pass"),
            "review_required": (n_err > 0) | (n_warn > 0),
            "n_error": n_err, "n_warning": n_warn, "n_info": n_info,
        }
    )


def document_status(headers: DataFrame, issues: DataFrame) -> DataFrame:
    return _judged(headers, issues.groupBy("doc_key").agg(*_severities())).select(
        "doc_key", "status", "review_required", "n_error", "n_warning", "n_info"
    )


def nested_validation(headers: DataFrame, issues: DataFrame) -> DataFrame:
    """Status and ordered issue list of every document, from one aggregate of the issues."""
    counted = issues.groupBy("doc_key").agg(
        *_severities(),
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ORDER_FIELDS + ISSUE_FIELDS]))).alias("all_issues"),
    )
    issue_list = F.transform(
        F.coalesce(F.col("all_issues"), F.array()),
        lambda x: F.struct(*[x[c].alias(c) for c in ISSUE_FIELDS]),
    )
    return _judged(headers, counted).select(
        "doc_key",
        F.struct(
            F.col("status").alias("status"),
            F.col("review_required").alias("review_required"),
            issue_list.alias("issues"),
        ).alias("validation"),
    )


#: Rules by what they read.
HEADER_ONLY = frozenset(
    ("INVALID_DATE", "DUE_BEFORE_ISSUE", "DELIVERY_BEFORE_ISSUE", "UNKNOWN_CURRENCY", "MISSING_IDENTIFIER", "MISSING_REFERENCE", "NEGATIVE_VALUE")
)
NEEDS_PAIRS = frozenset(
    ("BALANCED_REVERSAL", "NEGATIVE_VALUE", "CREDIT_SIGN_INCONSISTENCY", "CREDIT_TOTAL_UNVERIFIABLE", "SUBTOTAL_MISMATCH", "TOTAL_MISMATCH")
)
#: Of these, what needs the pairs of credit notes alone.
CREDIT_PAIRS = frozenset(("CREDIT_SIGN_INCONSISTENCY", "CREDIT_TOTAL_UNVERIFIABLE", "SUBTOTAL_MISMATCH", "TOTAL_MISMATCH"))
NEEDS_SUMS = frozenset(
    ("NO_LINE_ITEMS", "CREDIT_SIGN_INCONSISTENCY", "CREDIT_TOTAL_UNVERIFIABLE", "SUBTOTAL_MISMATCH", "TOTAL_MISMATCH")
)


def validate(
    headers: DataFrame,
    lines: DataFrame,
    notices: DataFrame | None = None,
    tolerance: Decimal | str = TOLERANCE,
    block_size: int = 4096,
    materialize: bool = True,
    codes: tuple[str, ...] | None = None,
) -> Validation:
    """Validate every document; returns the issue table and per-document status.

    With ``codes`` only those rules are built, each from what it reads.
    ``materialize`` (default on) writes the line marks and the per-document stage
    once where more than two branches read them (all rules, or all of money),
    else nothing; filters and column choices still reach the inputs of every branch.
    """
    tolerance = Decimal(str(tolerance))
    want = None if codes is None else frozenset(codes)
    any_of = lambda group: want is None or bool(want & group)
    readers = [any_of(g) for g in (NEEDS_SUMS, *(frozenset((c,)) for c in ("CREDIT_SIGN_INCONSISTENCY", "BALANCED_REVERSAL", "DUPLICATE_LINE", "NEGATIVE_VALUE")))]
    keep = cut_lineage if materialize and sum(readers) > 2 else (lambda df, name: df)
    prepared = prepare_lines(lines, headers)
    parts: list[DataFrame] = []
    pairs = stage = duplicates = None
    if any_of(NEEDS_PAIRS):
        # core signs count for credit notes only
        of = prepared if want is None or want & (NEEDS_PAIRS - CREDIT_PAIRS) else prepared.where("is_credit")
        both = of is prepared and any_of(frozenset(("DUPLICATE_LINE",)))
        marks = keep(line_marks(of, block_size, both), "line_marks")
        pairs = _pairs_of(marks)
        if both:
            duplicates = marks.filter("dup").select("doc_key", "idx")
    if any_of(HEADER_ONLY):
        parts.append(header_only_issues(headers, want))
    if want == frozenset(("NO_LINE_ITEMS",)):
        none = headers.select("doc_key").join(lines.select("doc_key").distinct(), "doc_key", "left_anti")
        parts.append(_collect_issues(none, [(F.lit(True), _issue(7, -1, 0, "NO_LINE_ITEMS", "warning", S.MSG_NO_LINE_ITEMS, "line_items"))]))
    elif any_of(NEEDS_SUMS):
        stage = header_stage(headers, line_aggregates(prepared, pairs), keep)
        parts.append(header_issues(stage, tolerance))
    if any_of(frozenset(("CREDIT_SIGN_INCONSISTENCY",))):
        parts.append(mixed_credit_issues(stage, prepared, pairs))
    if any_of(frozenset(("BALANCED_REVERSAL",))):
        parts.append(pair_issues(pairs))
    if any_of(frozenset(("LINE_AMOUNT_MISMATCH",))):
        parts.append(amount_issues(prepared, tolerance))
    if any_of(frozenset(("DUPLICATE_LINE",))):
        parts.append(duplicate_issues(duplicate_lines(prepared, block_size) if duplicates is None else duplicates))
    if any_of(frozenset(("NEGATIVE_VALUE",))):
        parts.append(negative_line_issues(prepared, pairs))
    if notices is not None:
        parts.append(notice_issues(notices))
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    if want is not None:
        issues = issues.filter(F.col("code").isin(*codes))
    return Validation(headers=headers, issues=issues)
