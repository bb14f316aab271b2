"""Registered driver queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables (or tables Spark derives from them)
in full; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators.validate import Validation, validate
from docaudit.session import cut_lineage
from docaudit.sources.adapter import DocumentTables, build_headers, document_tables

Query = Callable[[SparkSession, str], DataFrame]


def _validated(spark: SparkSession, sf_dir: str) -> tuple[DocumentTables, Validation]:
    tables = document_tables(spark, sf_dir)
    return tables, validate(tables.headers, tables.lines)


def _issues(codes: tuple[str, ...], cols: tuple[str, ...], several: bool = False) -> Query:
    """Some rules only: built from what they read.  Lines that ``several`` branches read are written once, else nothing is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = document_tables(spark, sf_dir, materialize=False)
        headers, lines = tables.headers, tables.lines
        if several:
            lines = cut_lineage(lines, "doc_lines")
            headers = build_headers(spark, sf_dir, lines)
        return validate(headers, lines, codes=codes).issues.select(*cols)

    return run


def issues_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = _validated(spark, sf_dir)
    return v.issues.groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_distinct("doc_key").alias("n_docs")
    )


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = _validated(spark, sf_dir)
    return v.status.groupBy("status", "review_required").agg(F.count(F.lit(1)).alias("n_docs"))


def review_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = _validated(spark, sf_dir)
    return (
        v.status.join(t.headers.select("doc_key", "document_type"), "doc_key")
        .groupBy("document_type", "status")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = _validated(spark, sf_dir)
    nested = v.nested()
    return nested.select("doc_key", F.posexplode("validation.issues").alias("pos", "issue")).select(
        "doc_key", F.col("pos").cast("int").alias("pos"), "issue.code", "issue.field"
    )


#: Rules that compute with or compare money.
MONEY_CODES = (
    "LINE_AMOUNT_MISMATCH", "DUPLICATE_LINE", "BALANCED_REVERSAL", "NEGATIVE_VALUE", "CREDIT_SIGN_INCONSISTENCY",
    "CREDIT_TOTAL_UNVERIFIABLE", "SUBTOTAL_MISMATCH", "TOTAL_MISMATCH",
)


def long_money_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All money rules over documents whose amounts have up to 21 integer digits or 15 decimals."""
    from docaudit.sources.long_money import long_money_tables

    long = long_money_tables(document_tables(spark, sf_dir))
    return validate(long.headers, long.lines, codes=MONEY_CODES).issues.select("doc_key", "code", "sub", "field", "expected", "actual")


def long_money_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, decimal and line scores of long amounts that differ in closing zeros or in their last digit."""
    from docaudit.operators import evaluate as E
    from docaudit.sources.long_money import long_money_pair, long_money_tables

    inp = long_money_pair(long_money_tables(document_tables(spark, sf_dir)))
    fx = E.fixtures(inp)
    lines = E.line_item_prf(inp, fx).select("true_positive", "false_positive", "false_negative")
    return E.header_match(inp, fx).crossJoin(lines)  # one row each


VALIDATION_QUERIES: dict[str, Query] = {
    "long_money_rules": long_money_rules,
    "long_money_scores": long_money_scores,
    "issues_by_code": issues_by_code,
    "document_status": document_status,
    "review_by_type": review_by_type,
    "header_date_rules": _issues(
        ("INVALID_DATE", "DUE_BEFORE_ISSUE", "DELIVERY_BEFORE_ISSUE"),
        ("doc_key", "code", "severity", "field", "expected", "actual"),
    ),
    "currency_rule": _issues(("UNKNOWN_CURRENCY",), ("doc_key", "code", "field", "expected", "actual")),
    "identifier_rules": _issues(
        ("MISSING_IDENTIFIER", "MISSING_REFERENCE"), ("doc_key", "code", "severity", "field")
    ),
    "no_line_items": _issues(("NO_LINE_ITEMS",), ("doc_key", "code", "field")),
    "line_amount_mismatch": _issues(
        ("LINE_AMOUNT_MISMATCH",), ("doc_key", "field", "expected", "actual")
    ),
    "duplicate_line": _issues(("DUPLICATE_LINE",), ("doc_key", "field"), several=True),
    "balanced_reversal": _issues(("BALANCED_REVERSAL",), ("doc_key", "field", "expected", "actual"), several=True),
    "negative_value": _issues(("NEGATIVE_VALUE",), ("doc_key", "field", "expected", "actual"), several=True),
    "credit_sign": _issues(
        ("CREDIT_SIGN_INCONSISTENCY", "CREDIT_TOTAL_UNVERIFIABLE"),
        ("doc_key", "code", "severity", "sub", "expected", "actual"),
        several=True,
    ),
    "subtotal_mismatch": _issues(("SUBTOTAL_MISMATCH",), ("doc_key", "expected", "actual"), several=True),
    "total_mismatch": _issues(("TOTAL_MISMATCH",), ("doc_key", "expected", "actual"), several=True),
    "issue_order": issue_order,
}


def all_queries() -> dict[str, Query]:
    from docaudit.plans.flagship import flagship

    out: dict[str, Query] = {"flagship": flagship}
    out.update(VALIDATION_QUERIES)
    out.update(EVALUATION_QUERIES)
    out.update(JSON_QUERIES)
    out.update(SOURCE_QUERIES)
    out.update(EXTRACTION_QUERIES)
    out.update(VALUE_QUERIES)
    return out


# --------------------------------------------------------------------------- evaluation
def _eval(fn, with_codes: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from docaudit.operators import evaluate as E
        from docaudit.sources.pairs import evaluation_inputs

        inp = evaluation_inputs(spark, sf_dir, with_codes=with_codes)
        # one row per fixture, read by several branches: written once
        return fn(E, inp, cut_lineage(E.fixtures(inp), "fixtures"))

    return run


EVALUATION_QUERIES: dict[str, Query] = {
    "eval_processing": _eval(lambda E, inp, fx: E.processing_validity(fx)),
    "header_match": _eval(lambda E, inp, fx: E.header_match(inp, fx)),
    "hallucinations": _eval(lambda E, inp, fx: E.hallucinations(inp, fx)),
    "line_item_prf": _eval(lambda E, inp, fx: E.line_item_prf(inp, fx)),
    "issue_code_prf": _eval(lambda E, inp, fx: E.issue_code_prf(inp, fx), with_codes=True),
    "eval_breakdown": _eval(lambda E, inp, fx: E.breakdown(fx)),
    "eval_failures": _eval(lambda E, inp, fx: E.failures(fx)),
    "eval_report": _eval(lambda E, inp, fx: E.report(inp, fx), with_codes=True),
}


# --------------------------------------------------------------------------- strict JSON / migration
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.strict_json import error_summary, parse_documents
    from docaudit.sources.records import damaged_document_json

    # one branch reads it, so nothing is written; the texts are made by document, so sharing their errors moves nothing
    texts = damaged_document_json(document_tables(spark, sf_dir, headers=False))
    parsed = parse_documents(texts, materialize=False, shared="doc_key")
    return parsed.select("doc_key", "schema_valid", error_summary(F.col("errors")).alias("errors"))


def migrate_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.strict_json import error_summary, parse_envelopes
    from docaudit.sources.records import v1_envelope_json

    parsed = parse_envelopes(v1_envelope_json(document_tables(spark, sf_dir)))
    return parsed.select(
        "doc_key",
        "schema_valid",
        "migrated",
        error_summary(F.col("errors")).alias("errors"),
        F.col("envelope.schema_version").alias("version_out"),
        F.col("envelope.source.page_count").alias("page_count"),
        F.col("envelope.source.sheet_count").alias("sheet_count"),
        F.size("envelope.source.notices").alias("n_notices"),
        F.col("envelope.document.delivery_date").alias("delivery_date"),
    )


def revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """migrated/parsed envelopes -> rules rebuilt from document + notices (stored validation ignored)."""
    from docaudit.plans.jobs import revalidate_envelopes
    from docaudit.sources.records import v1_envelope_json

    result = revalidate_envelopes(v1_envelope_json(document_tables(spark, sf_dir)))
    return result.issues.groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_distinct("doc_key").alias("n_docs")
    )


def revalidate_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04/D16 over v2 envelopes of all types: stored validation is wrong on purpose, notices are planted."""
    from docaudit.operators.strict_json import nest_documents
    from docaudit.plans.jobs import build_envelopes, envelope_json, revalidate_envelopes
    from docaudit.sources.records import planted_sources, wrong_validation

    t = document_tables(spark, sf_dir)
    env = build_envelopes(nest_documents(t.headers, t.lines), planted_sources(t.headers), wrong_validation(t.headers))
    result = revalidate_envelopes(envelope_json(env))
    return result.issues.groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_distinct("doc_key").alias("n_docs")
    )


JSON_QUERIES: dict[str, Query] = {
    "revalidate_v2": revalidate_v2,
    "strict_json": strict_json,
    "migrate_v1": migrate_v1,
    "revalidate": revalidate,
}


# --------------------------------------------------------------------------- sources
from docaudit.config import Limits  # noqa: E402

ROUTE_LIMITS = Limits(max_file_bytes=12_000)
PAGE_LIMITS = Limits(max_pages=6)
CELL_LIMITS = Limits(max_tabular_rows=6, max_tabular_columns=4, max_cell_chars=5, max_tabular_chars=400)
CANONICAL_LIMITS = Limits(max_tabular_chars=450)
ARCHIVE_LIMITS = Limits(max_xlsx_zip_entries=36, max_xlsx_uncompressed_bytes=850_000)


def route_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.corpora import documents_as_files
    from docaudit.sources.files import route, text_guard

    guarded = text_guard(route(documents_as_files(spark, sf_dir), limits=ROUTE_LIMITS))
    return guarded.select("doc_id", "file_name", "route", "media_type", "error_code", "error")


def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.session import read_table
    from docaudit.sources.files import route, text_guard

    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    files = d.select(
        "doc_id",
        F.concat(F.lit("docs/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    ).withColumn("length", F.octet_length("content"))
    g = text_guard(route(files))
    return g.select("doc_id", "sha256", F.col("byte_count").cast("bigint").alias("byte_count"), "page_count", "media_type")


def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.session import read_table
    from docaudit.sources.corpora import conversation_pages
    from docaudit.sources.pages import assemble_pages

    pages = conversation_pages(spark, sf_dir)
    # every conversation is a file, and so is every document id: those without turns have no pages
    files = pages.select("file").unionByName(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file")))
    a = assemble_pages(pages, PAGE_LIMITS, files)
    return a.select(
        "file", F.col("page_count").cast("bigint").alias("page_count"), "text",
        F.size("notices").alias("n_notices"), "error",
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cell table, written once (it is the input of several branches)."""
    from docaudit.session import cut_lineage
    from docaudit.sources.corpora import lineitem_cells

    return cut_lineage(lineitem_cells(spark, sf_dir), "cells")


def cell_limits_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.corpora import order_files
    from docaudit.sources.tabular import cell_limits

    return cell_limits(_cells(spark, sf_dir), CELL_LIMITS, files=order_files(spark, sf_dir))


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.tabular import row_lines

    return row_lines(_cells(spark, sf_dir).filter(F.col("state") == "visible"))


def sheet_notices_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.tabular import sheet_notices

    n = sheet_notices(_cells(spark, sf_dir))
    return n.select(
        "file", "sheet_count", "hidden_count", F.array_join(F.transform("notices", lambda x: x["code"]), ",").alias("codes"),
        "error",
    )


def archive_guard_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.archive import archive_guard
    from docaudit.sources.corpora import part_inventory

    return archive_guard(part_inventory(spark, sf_dir), ARCHIVE_LIMITS)


def package_metadata_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.archive import archive_guard
    from docaudit.sources.corpora import package_parts

    return archive_guard(package_parts(spark, sf_dir)).select("file", "error_kind", "error", "error_code")


SOURCE_QUERIES: dict[str, Query] = {
    "package_metadata": package_metadata_q,
    "route_formats": route_formats,
    "text_digest": text_digest,
    "page_assembly": page_assembly,
    "cell_limits": cell_limits_q,
    "canonical_rows": canonical_rows,
    "sheet_notices": sheet_notices_q,
    "archive_guard": archive_guard_q,
}


# --------------------------------------------------------------------------- extraction / jobs
def _replay_inputs(spark: SparkSession, sf_dir: str):
    from docaudit.sources.records import damaged_document_json

    t = document_tables(spark, sf_dir, headers=False)
    k = F.col("doc_key")
    loaded = t.headers.select("doc_key", F.concat(F.lit("DOC-"), k.cast("string"), F.lit(".pdf")).alias("file_name"))
    responses = damaged_document_json(t).filter(k % 29 != 0).select(
        F.when(k % 2 == 0, F.concat(F.lit("DOC-"), k.cast("string"), F.lit(".pdf")))
        .otherwise(F.concat(F.lit("DOC-"), k.cast("string"), F.lit(".json"))).alias("name"),
        "json",
    )
    return loaded, responses


def replay_extract_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.extract import replay_extract

    loaded, responses = _replay_inputs(spark, sf_dir)
    return replay_extract(loaded, responses).select("doc_key", "outcome", "exit_code")


def batch_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.extract import replay_extract
    from docaudit.operators.strict_json import flatten_documents
    from docaudit.plans.jobs import batch_summary

    loaded, responses = _replay_inputs(spark, sf_dir)
    out = replay_extract(loaded, responses)
    headers, lines = flatten_documents(out.filter(F.col("outcome") == "ok"))
    v = validate(headers, lines)
    return batch_summary(out.select("doc_key", "exit_code"), v.status, strict=True)


def request_parts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.extract import request_parts
    from docaudit.session import read_table

    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_key"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit("text/plain; charset=utf-8").alias("media_type"),
        "text",
    )
    p = request_parts(d)
    return p.select(
        F.col("doc_key").alias("doc_id"),
        F.size("parts").alias("n_parts"),
        F.aggregate(F.transform("parts", lambda x: F.length(x["text"])), F.lit(0), lambda a, b: a + b).cast("bigint").alias("n_chars"),
    )


def stored_model(pdf):
    """A model for tests: the text holds a first answer and a good one, parted by U+001E; every second document is mended."""
    import pandas as pd

    from docaudit.operators.extract import REPAIR_PREFIX, TEXT_LABEL

    out = []
    for key, parts in zip(pdf["doc_key"], pdf["parts"]):
        texts = [p["text"] for p in parts if p["text"]]
        first, _, good = next((x for x in texts if x.startswith(TEXT_LABEL)), TEXT_LABEL)[len(TEXT_LABEL) :].partition("\x1e")
        again = any(x.startswith(REPAIR_PREFIX) for x in texts)
        out.append(None if key % 29 == 0 else good if again and key % 2 == 0 else first)
    return pd.Series(out, dtype=object)


def repair_once_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.extract import extract_with_repair
    from docaudit.session import find_package
    from docaudit.sources.records import damaged_document_json, document_json

    find_package(spark)
    t = document_tables(spark, sf_dir, headers=False)
    good = document_json(t).withColumnRenamed("json", "good")
    both = damaged_document_json(t).join(good, "doc_key")
    loaded = both.select(
        "doc_key",
        F.concat(F.lit("DOC-"), F.col("doc_key").cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit("text/plain; charset=utf-8").alias("media_type"),
        F.concat("json", F.lit("\x1e"), "good").alias("text"),
    )
    return extract_with_repair(loaded, stored_model).select("doc_key", "attempts", "outcome", "exit_code")


def faulty_model(pdf):
    """A model for tests that raises, answers too few documents or gives no text when certain documents are in its call."""
    import pandas as pd

    keys = pdf["doc_key"]
    if (keys % 101 == 0).any():
        raise ValueError("no such document")
    answers = pd.Series(["{}"] * len(pdf), dtype=object)
    answers[keys % 29 == 0] = None
    answers[keys % 151 == 3] = 7
    return answers[:-1] if (keys % 211 == 5).any() else answers


def extract_isolated_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose call fails, alone, are provider errors; all others of their batches have their answers."""
    from docaudit.operators.extract import extract_with, request_parts
    from docaudit.session import find_package

    find_package(spark)
    name = F.concat(F.lit("DOC-"), F.col("doc_key").cast("string"), F.lit(".txt"))
    headers = document_tables(spark, sf_dir, materialize=False).headers
    loaded = headers.select("doc_key", name.alias("file_name"), F.lit("text/plain").alias("media_type"), F.lit(None).cast("string").alias("text"))
    return extract_with(request_parts(loaded), faulty_model, batch_rows=64)


def batch_envelopes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, pages, cells and stored answers to envelopes; one row an issue, or one with the load or extraction error."""
    from docaudit.plans.jobs import run_batch
    from docaudit.sources.records import batch_inputs

    run = run_batch(**batch_inputs(spark, sf_dir, document_tables(spark, sf_dir)))
    env = run.envelopes.select(
        "doc_key",
        F.col("envelope.source.page_count").alias("page_count"),
        F.col("envelope.source.sheet_count").alias("sheet_count"),
        F.size("envelope.source.notices").alias("n_notices"),
        F.posexplode_outer("envelope.validation.issues").alias("pos", "i"),
    )
    done = env.select(
        "doc_key", "page_count", "sheet_count", "n_notices", F.col("pos").cast("int").alias("pos"), F.col("i.code").alias("code"),
        F.col("i.severity").alias("severity"), F.col("i.message").alias("message"), F.col("i.field").alias("field"),
        F.lit(None).cast("int").alias("error_code"),
    )
    failed = run.outcomes.filter(F.col("error_code").isNotNull()).select("doc_key", "error_code")
    return done.unionByName(failed, allowMissingColumns=True)


def batch_resumed_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a batch over all files that ended after one part of two, its continuation and a repetition; a row a run type with what it asked, its summary and its issues."""
    import uuid

    from docaudit.plans.jobs import routed_files
    from docaudit.plans.ledger import commit_part, run_resumable, settings_key
    from docaudit.session import cut_lineage, ensure_checkpoint_dir
    from docaudit.sources.records import batch_inputs

    b = batch_inputs(spark, sf_dir, document_tables(spark, sf_dir))
    files, pages, cells, answers = (cut_lineage(b[n], f"batch-{n}") for n in ("files", "pages", "cells", "responses"))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batches/{uuid.uuid4().hex}"
    first = routed_files(files).where(F.pmod(F.xxhash64("doc_key"), F.lit(2)) == 0)
    before = commit_part(first, answers, out, settings_key("stored answers"), pages=pages, cells=cells)
    go = lambda: run_resumable(files, answers, out, "stored answers", True, pages=pages, cells=cells, parts=2)
    found = None
    for name, earlier in (("resumed", before), ("repeated", 0)):
        run = go()
        issues = run.envelopes.agg(
            F.count(F.lit(1)).alias("n_envelopes"),
            F.coalesce(F.sum(F.size("envelope.validation.issues")), F.lit(0)).cast("long").alias("n_issues"),
            F.count_if(F.col("envelope.validation.review_required")).alias("n_review"),
        )
        asked = F.lit(earlier + run.asked).cast("long").alias("asked")
        row = run.summary.withColumn("run", F.lit(name)).join(issues.withColumn("run", F.lit(name)), "run").select("run", asked, "processed", "failed", "exit_code", "n_envelopes", "n_issues", "n_review")
        found = row if found is None else found.unionByName(row)
    return found


EXTRACTION_QUERIES: dict[str, Query] = {
    "batch_resumed": batch_resumed_q,
    "repair_once": repair_once_q,
    "extract_isolated": extract_isolated_q,
    "batch_envelopes": batch_envelopes_q,
    "replay_extract": replay_extract_q,
    "batch_summary": batch_summary_q,
    "request_parts": request_parts_q,
}


# --------------------------------------------------------------------------- value normalisation / grounding
DATE_FORMS = ("d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "dd/MM/yyyy")


def _printed(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    from docaudit.session import read_table

    t = document_tables(spark, sf_dir, materialize)
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_key"), F.to_date("o_orderdate").alias("od")
    )
    k = F.col("doc_key")
    form = k % 6
    printed = F.lit(None).cast("string")
    for i, pat in enumerate(DATE_FORMS):
        text = F.date_format("od", pat)
        if i == 1:
            text = F.upper(text)
        printed = F.when(form == i, text).otherwise(printed)
    return t.headers.join(orders, "doc_key").select(
        "doc_key", "od", printed.alias("date_text"), "currency", "total", "document_id", "customer_name",
        F.col("vendor.name").alias("vendor_name"),
    )


def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.functions.dates import normalize_currency, normalize_date, normalize_money

    p = _printed(spark, sf_dir, materialize=False)  # read once, so nothing is written
    total = F.col("total").cast("decimal(18,2)")
    us, form = F.format_number(total, 2), F.col("doc_key") % 8
    total_text = (
        F.when(form == 0, F.concat(F.lit("$"), us))
        .when(form == 1, F.concat(F.translate(us, ",.", ".,"), F.lit(" EUR")))
        .when(form == 2, F.concat(F.lit("("), F.format_number(F.abs(total), 2), F.lit(")")))
        .when(form == 3, F.concat(F.lit("USD "), F.col("total")))
        .when(form == 4, F.concat(F.lit(" "), F.translate(us, ",.", " ,"), F.lit(" ")))
        .when(form == 5, F.concat(us, F.lit(" of 7")))
        .when(form == 6, F.lit("1e5"))
        .otherwise(F.concat(F.lit("total "), us))
    )
    return p.select(
        "doc_key",
        "date_text",
        normalize_date(F.col("date_text")).alias("date_norm"),
        normalize_currency(F.concat(F.lit("\t"), F.col("currency"), F.lit(" \n"))).alias("currency_norm"),
        total_text.alias("total_text"),
        normalize_money(total_text).alias("total_norm"),
    )


def normalize_source_dates_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's slash dates read in the order that its other dates prove; words that are no month."""
    from docaudit.functions.dates import month_of, normalize_source_dates
    from docaudit.session import read_table

    k, c, od = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    words = F.array(*[F.lit(w) for w in ("Marble", "Decoy", "Janus", "Sep", "Sept", "Octobe")])
    word = F.element_at(words, (k % 6 + 1).cast("int"))
    day_first = (c % 3 == 0) | ((c % 3 == 2) & (k % 2 == 0))
    text = (
        F.when(k % 7 == 0, F.concat_ws(" ", F.date_format(od, "d"), word, F.date_format(od, "yyyy")))
        .when(day_first, F.date_format(od, "dd/MM/yyyy"))
        .otherwise(F.date_format(od, "MM/dd/yyyy"))
    )
    rows = read_table(spark, sf_dir, "orders").select(
        k.alias("doc_key"), c.alias("source"), text.alias("date_text"), F.when(k % 7 == 0, month_of(word)).alias("word_month")
    )
    return normalize_source_dates(rows, "source", "date_text", "date_norm")


def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.evaluate import grounding

    p = _printed(spark, sf_dir)
    k = F.col("doc_key")
    text = F.concat(
        F.lit("INVOICE "), F.coalesce(F.col("document_id"), F.lit("")),
        F.lit(" / Vendor: "), F.upper(F.col("vendor_name")),
        F.lit(" / Bill to: "), F.coalesce(F.col("customer_name"), F.lit("")),
        F.when(k % 10 != 1, F.concat(F.lit(" / Currency: "), F.coalesce(F.col("currency"), F.lit("")))).otherwise(F.lit("")),
        F.lit(" / Amount due: "), F.col("total"),
    )
    texts = p.select("doc_key", text.alias("text"))
    fields = ("document_id", "vendor_name", "customer_name", "currency", "total")
    values = p.select(
        "doc_key",
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])),
    )
    return grounding(values, texts)


VALUE_QUERIES: dict[str, Query] = {
    "normalize_values": normalize_values,
    "grounding_check": grounding_check,
    "normalize_source_dates": normalize_source_dates_q,
}


def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes written as JSON text, parsed back strictly."""
    from docaudit.operators.strict_json import nest_documents, parse_envelopes
    from docaudit.plans.jobs import build_envelopes, envelope_json

    t, v = _validated(spark, sf_dir)
    k = F.col("doc_key")
    sources = t.headers.select(
        "doc_key",
        F.struct(
            F.concat(F.lit("DOC-"), k.cast("string"), F.lit(".pdf")).alias("file_name"),
            F.lit("application/pdf").alias("media_type"),
            (k % 1000 + 100).alias("byte_count"),
            (k % 3 + 1).cast("int").alias("page_count"),
            F.lit(None).cast("int").alias("sheet_count"),
            F.sha2(k.cast("string"), 256).alias("sha256"),
            F.array().cast("array<struct<code:string,severity:string,message:string,field:string>>").alias("notices"),
        ).alias("source"),
    )
    env = build_envelopes(nest_documents(t.headers, t.lines), sources, v.nested())
    parsed = parse_envelopes(envelope_json(env), materialize=False)  # one branch reads it, so nothing is written
    return parsed.select(
        "doc_key",
        "schema_valid",
        F.col("envelope.validation.status").alias("status"),
        F.size("envelope.validation.issues").alias("n_issues"),
        F.col("envelope.document.total").alias("total"),
    )


VALUE_QUERIES["envelope_roundtrip"] = envelope_roundtrip


def canonical_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.sources.corpora import order_files
    from docaudit.sources.tabular import canonical_text

    return canonical_text(_cells(spark, sf_dir), CANONICAL_LIMITS, files=order_files(spark, sf_dir))


SOURCE_QUERIES["canonical_text"] = canonical_text_q
