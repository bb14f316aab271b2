"""Workbook package guard over a part inventory.

Part table: ``file, part, size, flags, crc_ok, xml, error`` -- one row per ZIP
entry, as a lister gives it; ``error`` marks a package that could not be
listed.  The rules are per-file aggregates, applied in the order the package
guard checks them; the first failing check names the error.  XML is read by
Spark's parser in permissive mode, so no part can stop the job: attributes with
their references resolved, comments, CDATA and nested elements apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import schema as S
from docaudit.config import DEFAULT_LIMITS, Limits

# ---------------------------------------------------------------------------
# Required parts, active-content markers (part names, content
# types, relationship type names).
# ---------------------------------------------------------------------------
REQUIRED_PARTS = ("[Content_Types].xml", "xl/workbook.xml")
ACTIVE_PART_MARKERS = (
    "vbaproject.bin",
    "xl/activex/",
    "xl/embeddings/",
    "xl/macrosheets/",
    "xl/dialogsheets/",
    "xl/connections.xml",
    "customui/",
)
ACTIVE_CONTENT_TYPE_MARKERS = (
    "macroenabled",
    "vbaproject",
    "activex",
    "oleobject",
    "macrosheet",
    "externallink",
    "connections",
    "customui",
)
ACTIVE_RELATIONSHIP_NAMES = (
    "vbaproject",
    "activexcontrol",
    "activexcontrolbinary",
    "oleobject",
    "package",
    "macrosheet",
    "xlmacrosheet",
    "intlmacrosheet",
    "externallink",
    "connections",
    "customui",
    "attachedtemplate",
)

# ---------------------------------------------------------------------------
# Error texts that callers compare.
# ---------------------------------------------------------------------------
CORRUPT = "XLSX package is corrupt"
DUPLICATE_NAMES = "XLSX contains duplicate ZIP part names"
UNSAFE_NAME = "XLSX contains an unsafe ZIP part name"
ENCRYPTED = "Encrypted XLSX ZIP entries are not supported"
ACTIVE = "XLSX active content is not supported"
EXTERNAL = "XLSX external relationships are not supported"

PART_SCHEMA = "file string, part string, size bigint, flags int, crc_ok boolean, xml string, error string"


#: What the guard reads of the three kinds of parts, by local names.
TYPES = "Override array<struct<_ContentType string>>, Default array<struct<_ContentType string>>"
RELATIONSHIPS = "Relationship array<struct<_TargetMode string, _Type string>>"
#: Every child element, as text.
CHILDREN = "xs_any array<string>"


def parsed(xml: Column, schema: str, local_names: bool = True) -> Column:
    """Struct of a part's root element; ``_bad`` holds the text if it is no XML."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": str(local_names).lower()}
    return F.from_xml(xml, f"{schema}, _bad string", options)


def malformed(xml: Column) -> Column:
    """Whether a text is no XML document with one root (null is unknown)."""
    body = F.regexp_replace(xml, r"\A\s*<\?xml\b.*?\?>", "")
    roots = parsed(F.concat(F.lit("<r>"), body, F.lit("</r>")), CHILDREN)["xs_any"]
    bad = parsed(xml, CHILDREN)["_bad"].isNotNull() | ~xml.rlike(r">\s*\z") | (F.size(F.coalesce(roots, F.array())) != 1)
    return F.when(xml.isNotNull(), bad)


def declared_sheets(xml: Column) -> Column:
    """Elements with the local name ``sheet`` in a namespace, at any depth below the root."""
    # as the parser writes the children out again: without comments, prefixes kept
    below = F.array_join(F.coalesce(parsed(xml, CHILDREN, local_names=False)["xs_any"], F.array()), "")
    default = F.regexp_replace(xml, r"(?s)<!--.*?-->", "").rlike(r"""\sxmlns\s*=\s*("[^"]|'[^'])""")
    prefixed = F.regexp_count(below, F.lit(r"<[\w.-]+:sheet[\s/>]"))
    return prefixed + F.when(default, F.regexp_count(below, F.lit(r"<sheet[\s/>]"))).otherwise(F.lit(0))


def _unsafe(part):
    norm = F.regexp_replace(part, r"\\", "/")
    return norm.startswith("/") | norm.rlike(r"(^|/)\.\.(/|$)")


def archive_guard(parts: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Per file: the first failing package check (``error``, ``error_code``) or null."""
    low = F.lower(F.col("part"))
    is_types, is_book, is_rels = low == "[content_types].xml", low == "xl/workbook.xml", low.endswith(".rels")
    sound = parts.withColumn("bad_xml", (is_types | is_book | is_rels) & F.coalesce(malformed(F.col("xml")), F.lit(False)))
    xml = F.when(~F.col("bad_xml"), F.col("xml"))
    types = parsed(F.when(is_types, xml), TYPES)
    declared = F.concat(*[F.coalesce(types[k]["_ContentType"], F.array().cast("array<string>")) for k in ("Override", "Default")])
    ct_active = is_types & F.exists(declared, lambda t: F.lower(t).rlike("|".join(ACTIVE_CONTENT_TYPE_MARKERS)))
    sheets = F.when(is_book, F.coalesce(declared_sheets(xml), F.lit(0)))
    links = parsed(F.when(is_rels, xml), RELATIONSHIPS)["Relationship"]
    rel_external = is_rels & F.exists(links, lambda r: F.lower(r["_TargetMode"]) == "external")
    rel_active = is_rels & F.exists(
        links,
        lambda r: F.element_at(F.split(F.regexp_replace(F.lower(r["_Type"]), "/+$", ""), "/"), -1).isin(*ACTIVE_RELATIONSHIP_NAMES),
    )
    marker = F.lit(False)
    for m in ACTIVE_PART_MARKERS:
        marker = marker | (F.instr(low, m) > 0)
    stats = sound.groupBy("file").agg(
        F.bool_or(F.col("error").isNotNull()).alias("corrupt"),
        F.bool_or(F.col("bad_xml") & is_types).alias("bad_types"),
        F.bool_or(F.col("bad_xml") & is_book).alias("bad_book"),
        F.bool_or(F.col("bad_xml") & is_rels).alias("bad_rels"),
        F.count("part").alias("entries"),
        F.count_distinct("part").alias("distinct_names"),
        F.bool_or(_unsafe(F.col("part"))).alias("unsafe"),
        F.bool_or((F.col("flags") % 2) == 1).alias("encrypted"),
        F.sum("size").alias("uncompressed"),
        F.array_sort(F.collect_set(F.when(F.col("part").isin(*REQUIRED_PARTS), F.col("part")))).alias("present_required"),
        F.bool_or(ct_active).alias("ct_active"),
        F.max(sheets).alias("declared_sheets"),
        F.bool_or(marker).alias("active_part"),
        F.bool_or(rel_external).alias("rel_external"),
        F.bool_or(rel_active).alias("rel_active"),
        F.min(F.when(~F.col("crc_ok"), F.col("part"))).alias("bad_crc_part"),
    )
    missing = F.array_except(F.array(*[F.lit(p) for p in sorted(REQUIRED_PARTS)]), F.col("present_required"))
    c = F.col
    unsupported = "Unsupported"
    checks = [
        (c("corrupt"), "Corrupt", F.lit(CORRUPT)),
        (c("entries") > limits.max_xlsx_zip_entries, "Limit",
         F.concat(F.lit("XLSX has "), c("entries").cast("string"), F.lit(f" ZIP entries; limit is {limits.max_xlsx_zip_entries}"))),
        (c("entries") != c("distinct_names"), "Corrupt", F.lit(DUPLICATE_NAMES)),
        (c("unsafe"), "Corrupt", F.lit(UNSAFE_NAME)),
        (c("encrypted"), unsupported, F.lit(ENCRYPTED)),
        (c("uncompressed") > limits.max_xlsx_uncompressed_bytes, "Limit",
         F.concat(F.lit("XLSX declares "), c("uncompressed").cast("string"),
                  F.lit(f" uncompressed bytes; limit is {limits.max_xlsx_uncompressed_bytes}"))),
        (F.size(missing) > 0, "Corrupt",
         F.concat(F.lit("XLSX is missing required package parts: "), F.array_join(missing, ", "))),
        (c("bad_types"), "Corrupt", F.lit(CORRUPT)),
        (c("ct_active"), unsupported, F.lit(ACTIVE)),
        (c("bad_book"), "Corrupt", F.lit(CORRUPT)),
        (F.coalesce(c("declared_sheets"), F.lit(0)) > limits.max_sheets, "Limit",
         F.concat(F.lit("XLSX has "), c("declared_sheets").cast("string"), F.lit(f" sheets; limit is {limits.max_sheets}"))),
        (c("active_part"), unsupported, F.lit(ACTIVE)),
        (c("bad_rels"), "Corrupt", F.lit(CORRUPT)),
        (c("rel_external"), unsupported, F.lit(EXTERNAL)),
        (c("rel_active"), unsupported, F.lit(ACTIVE)),
        (c("bad_crc_part").isNotNull(), "Corrupt", F.concat(F.lit("XLSX ZIP checksum failed for "), c("bad_crc_part"))),
    ]
    err = None
    kind = None
    for cond, k, msg in checks:
        cond = F.coalesce(cond, F.lit(False))
        err = F.when(cond, msg) if err is None else err.when(cond, msg)
        kind = F.when(cond, F.lit(k)) if kind is None else kind.when(cond, F.lit(k))
    return stats.select(
        "file",
        c("entries").cast("bigint").alias("entries"),
        c("uncompressed").cast("bigint").alias("uncompressed"),
        kind.alias("error_kind"),
        err.alias("error"),
        F.when(err.isNotNull(), F.lit(S.EXIT_INPUT_ERROR)).alias("error_code"),
    )
