"""Flagship query: documents per (document_type, status) with issue counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators.validate import validate
from docaudit.sources.adapter import document_tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = document_tables(spark, sf_dir)
    v = validate(tables.headers, tables.lines)
    return (
        v.status.join(tables.headers.select("doc_key", "document_type"), "doc_key")
        .groupBy("document_type", "status")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n_error").cast("bigint").alias("n_errors"),
            F.sum("n_warning").cast("bigint").alias("n_warnings"),
            F.sum("n_info").cast("bigint").alias("n_infos"),
        )
    )


FLAGSHIP_SQL_SELECT = """
SELECT s.document_type, s.status, count(*) AS n_docs,
       CAST(coalesce(sum(c.n_error), 0) AS BIGINT) AS n_errors,
       CAST(coalesce(sum(c.n_warning), 0) AS BIGINT) AS n_warnings,
       CAST(coalesce(sum(c.n_info), 0) AS BIGINT) AS n_infos
FROM doc_status s
LEFT JOIN (SELECT doc_key,
                  count(*) FILTER (WHERE severity = 'error') AS n_error,
                  count(*) FILTER (WHERE severity = 'warning') AS n_warning,
                  count(*) FILTER (WHERE severity = 'info') AS n_info
           FROM all_issues GROUP BY doc_key) c USING (doc_key)
GROUP BY s.document_type, s.status
"""
