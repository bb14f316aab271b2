"""Incremental runs whose files wait for their decoders, against the batch job over the same files."""

import json
import time

from pyspark.sql import functions as F

from docaudit.plans.jobs import envelope_json, run_batch
from docaudit.sources.files import discover
from docaudit.streaming.incremental import TIMED_OUT, run_incremental

RECORD = {
    "document_type": "receipt", "document_id": "R-1", "reference_document_id": None, "vendor": {"name": None, "tax_id": None, "address": None},
    "customer_name": None, "issue_date": None, "due_date": None, "delivery_date": None, "currency": "USD", "line_items": [],
    "subtotal": None, "discount": None, "tax": None, "shipping": None, "total": "1",
}


def pages_of(spark, path, texts):
    rows = [(path, i + 1, 100.0, 100.0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file string, page_no int, width_pt double, height_pt double, native_text string")


def cells_of(spark, path, rows):
    found = [(path, 1, None, "visible", r, c, v, None, None, False) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    return spark.createDataFrame(found, "file string, sheet_idx int, sheet string, state string, row int, col int, value string, formula string, cached string, is_error boolean")


def line(folder, name, **what):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"pages": None, "cells": None} | what) + "\n")


def outcomes(spark, out):
    return {r.file_name: r for r in spark.read.parquet(f"{out}/outcomes").collect()}


def envelopes(spark, df):
    return {r.doc_key: json.loads(r.json) for r in envelope_json(df).collect()}


def test_late_and_early_decoders_give_the_batch_result(spark, tmp_path):
    inp, out, ck, done = (tmp_path / n for n in ("in", "out", "ck", "done"))
    inp.mkdir()
    done.mkdir()
    answers = spark.createDataFrame([(f"{n}.json", json.dumps(RECORD)) for n in ("a", "b", "c", "d")], "name string, json string")
    run = lambda: run_incremental(spark, str(inp), str(out), str(ck), responses=answers, decoded=str(done))
    (inp / "a.txt").write_bytes(b"plain text")
    (inp / "b.pdf").write_bytes(b"%PDF-1.7 body")
    (inp / "c.csv").write_bytes(b"x,y\n1,2\n")
    at = {n: f"file:{inp}/{n}" for n in ("a.txt", "b.pdf", "c.csv", "d.pdf")}
    # the line of d comes before its file
    pages_of(spark, at["d.pdf"], [None, ""]).write.parquet(str(tmp_path / "pages1"))
    line(done, "1.json", file=at["d.pdf"], pages=str(tmp_path / "pages1"))
    run()
    assert set(outcomes(spark, out)) == {"a.txt"}  # b and c are held
    pages_of(spark, at["b.pdf"], ["first", "second"]).write.parquet(str(tmp_path / "pages2"))
    cells_of(spark, at["c.csv"], [["x", "y"], ["1", "2"]]).write.parquet(str(tmp_path / "cells"))
    line(done, "2.json", file=at["b.pdf"], pages=str(tmp_path / "pages2"))
    (inp / "d.pdf").write_bytes(b"%PDF-1.7 scanned")
    run()  # a new query from the checkpoint: the state outlives the restart
    assert set(outcomes(spark, out)) == {"a.txt", "b.pdf", "d.pdf"}
    line(done, "3.json", file=at["c.csv"], cells=str(tmp_path / "cells"))
    run()
    run()  # nothing new
    got = spark.read.parquet(f"{out}/envelopes")
    assert got.count() == 4
    pages = spark.read.parquet(str(tmp_path / "pages1"), str(tmp_path / "pages2"))
    batch = run_batch(discover(spark, str(inp)), answers, pages=pages, cells=spark.read.parquet(str(tmp_path / "cells")))
    want = envelopes(spark, batch.envelopes)
    assert envelopes(spark, got.drop("epoch")) == want
    assert want[at["d.pdf"]]["source"]["notices"][0]["code"] == "NO_NATIVE_TEXT" and want[at["b.pdf"]]["source"]["page_count"] == 2
    assert {k: r.stage for k, r in outcomes(spark, out).items()} == {r.file_name: r.stage for r in batch.outcomes.collect()}


def test_a_file_that_is_never_decoded_is_an_error_row(spark, tmp_path):
    inp, out, ck, done = (tmp_path / n for n in ("in", "out", "ck", "done"))
    inp.mkdir()
    done.mkdir()
    answers = spark.createDataFrame([("b.json", json.dumps(RECORD))], "name string, json string")
    run = lambda: run_incremental(spark, str(inp), str(out), str(ck), responses=answers, decoded=str(done), wait="1 second")
    (inp / "b.pdf").write_bytes(b"%PDF-1.7 body")
    run()
    time.sleep(2)
    run()  # only the run's tick is new
    got = outcomes(spark, out)
    assert (got["b.pdf"].stage, got["b.pdf"].error_code, got["b.pdf"].error) == ("load", 3, TIMED_OUT)
    assert spark.read.parquet(f"{out}/outcomes").where(F.col("file_name") == "b.pdf").count() == 1


def test_undecoded_files_of_a_batch_are_input_errors(spark, tmp_path):
    answers = spark.createDataFrame([(f"{n}.json", json.dumps(RECORD)) for n in "abc"], "name string, json string")
    for name, body in (("a.txt", b"text"), ("b.pdf", b"%PDF-1.7 x"), ("c.csv", b"x,y\n")):
        (tmp_path / name).write_bytes(body)
    rows = {r.file_name: r for r in run_batch(discover(spark, str(tmp_path)), answers).outcomes.collect()}
    assert rows["a.txt"].error is None
    assert {rows[n].error for n in ("b.pdf", "c.csv")} == {"Input was not decoded"} and rows["b.pdf"].error_code == 3
