"""What is written and shuffled: tables that several branches read are made once, texts that nothing reads again are not kept."""

from __future__ import annotations

import importlib
import json
import random
import re

from builders import make, tables
from pyspark.sql import functions as F

from docaudit.operators import validate as V


def kept(monkeypatch, *modules: str) -> dict[str, list[str]]:
    """Names and columns of the tables that these modules write from now on."""
    found: dict[str, list[str]] = {}
    for name in modules:
        module = importlib.import_module(name)
        write = module.cut_lineage

        def noted(df, as_name="stage", write=write):
            found[as_name] = df.columns
            return write(df, as_name)

        monkeypatch.setattr(module, "cut_lineage", noted)
    return found


def test_marks_are_pairs_and_duplicates_from_one_shuffle(spark, capsys):
    """The lines' values are dealt once, by document and block."""
    rng = random.Random(3)
    docs = [
        make(line_items=[(rng.choice(["A", "a ", None]), "1", rng.choice(["2", "-2"]), rng.choice(["2", "2.0", "-2", "0", None])) for _ in range(rng.randint(0, 12))])
        for _ in range(30)
    ]
    h, l = tables(spark, docs)
    for size in (4, 4096):
        prepared = V.prepare_lines(l, h)
        marks = V.line_marks(prepared, size)
        rows = marks.collect()
        assert sorted((r.doc_key, r.idx) for r in rows if r.dup) == sorted(tuple(r) for r in V.duplicate_lines(prepared, size).collect())
        assert sorted((r.doc_key, r.idx, r.pos_idx) for r in rows if r.pos_idx is not None) == sorted(tuple(r) for r in V.reversal_pairs(prepared, size).collect())
    V.line_marks(prepared, size).explain()
    dealt = re.findall(r"Exchange hashpartitioning\(doc_key#\w+, blk#\w+, \d+\)", capsys.readouterr().out)
    assert len(dealt) == 1


def test_rules_of_money_write_what_several_read(spark, monkeypatch):
    """F7 long_money_rules: every branch made the pairs and the sums anew."""
    h, l = tables(spark, [make(line_items=[("A", "1", "2", "2"), ("a", "1", "-2", "-2"), ("a", "1", "-2", "-2")], subtotal="0", total="1")])
    names = kept(monkeypatch, "docaudit.operators.validate")
    from docaudit.plans.queries import MONEY_CODES

    got = V.validate(h, l, codes=MONEY_CODES).issues.select("code", "field")
    assert sorted(names) == ["doc_stage", "line_marks"]
    assert not any(c.endswith(("_t", "_d")) for c in names["doc_stage"])
    assert {("BALANCED_REVERSAL", "line_items.1"), ("DUPLICATE_LINE", "line_items.2"), ("NEGATIVE_VALUE", "line_items.2.amount")} <= {tuple(r) for r in got.collect()}
    names.clear()
    V.validate(h, l, codes=("TOTAL_MISMATCH",))
    assert not names


def test_codes_alone_make_no_texts(spark, capsys):
    """A reader of codes or severities does not print what was expected."""
    h, l = tables(spark, [make(total="12", line_items=[("A", "2", "5", "11")])])
    issues = V.validate(h, l, materialize=False).issues
    issues.select("doc_key", "code", "severity").explain()
    assert "line_items." not in capsys.readouterr().out.replace("line_items.amount", "")
    assert {(r.code, r.expected, r.actual) for r in issues.collect()} == {
        ("LINE_AMOUNT_MISMATCH", "10", "11"), ("SUBTOTAL_MISMATCH", "11", "10"), ("TOTAL_MISMATCH", "11", "12")
    }


def test_predicted_lines_are_picked_once(spark, monkeypatch, tmp_path):
    """F5 eval_report, F8 issue_code_prf: the rules read lines that are written, of documents that have a valid output."""
    from docaudit.sources import pairs
    from docaudit.sources.adapter import DocumentTables

    h, l = tables(spark, [make() for _ in range(32)])
    spark.createDataFrame([(k, "1-URGENT") for k in range(32)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    monkeypatch.setattr(pairs, "validate", lambda headers, lines: seen.append(lines) or V.validate(headers, lines, materialize=False))
    pairs.evaluation_inputs(spark, str(tmp_path), DocumentTables(h, l))
    assert seen[1].inputFiles()
    assert {r.doc_key for r in seen[1].collect()} == set(range(32)) - {0, 12, 24, 29, 31}


def test_revalidation_keeps_no_text(spark, monkeypatch):
    """F3 revalidate_v2: the envelopes' text was written beside the envelopes."""
    from docaudit.plans.jobs import revalidate_envelopes

    names = kept(monkeypatch, "docaudit.plans.jobs", "docaudit.operators.strict_json")
    texts = spark.createDataFrame([(1, "{}"), (2, None)], "doc_key long, json string")
    again = revalidate_envelopes(texts)
    assert sorted(names) == ["parsed_envelopes"] and "json" not in names["parsed_envelopes"]
    assert again.parsed.where("schema_valid").count() == 0 and again.parsed.count() == 2


def test_round_trip_writes_no_parsed_envelopes(spark, monkeypatch):
    """F9 envelope_roundtrip: one branch reads them."""
    from docaudit.plans import queries as Q
    from docaudit.sources.adapter import DocumentTables

    h, l = tables(spark, [make(), make(total="12")])
    names = kept(monkeypatch, "docaudit.operators.strict_json")
    monkeypatch.setattr(Q, "_validated", lambda spark, sf_dir: (DocumentTables(h, l), V.validate(h, l, materialize=False)))
    rows = {tuple(r) for r in Q.envelope_roundtrip(spark, "").collect()}
    assert rows == {(0, True, "pass", 0, "11"), (1, True, "fail", 1, "12")}
    assert not names


def test_repair_writes_the_answers_once(spark, monkeypatch):
    """F4 repair_once: answers were written again with their records, those of the second call too."""
    from docaudit.operators.extract import extract_with_repair

    names = kept(monkeypatch, "docaudit.operators.extract", "docaudit.operators.strict_json")
    loaded = spark.createDataFrame([(i, f"f{i}.txt", "text/plain", "t") for i in range(3)], "doc_key long, file_name string, media_type string, text string")
    rows = extract_with_repair(loaded, lambda pdf: pdf["doc_key"].map(lambda k: None if k == 0 else json.dumps({"k": k}))).collect()
    assert {(r.doc_key, r.attempts, r.outcome) for r in rows} == {(0, 1, "provider_error"), (1, 2, "schema_error"), (2, 2, "schema_error")}
    assert sorted(names) == ["answers", "first-answers"] and "json" not in names["first-answers"]
