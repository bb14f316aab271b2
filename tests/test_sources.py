"""File sources on small files written to a temp folder."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from docaudit.config import Limits
from docaudit.operators.extract import extract_with_repair
from docaudit.sources.archive import PART_SCHEMA, archive_guard
from docaudit.sources.files import discover, route, text_guard
from docaudit.sources.tabular import CELL_SCHEMA, canonical_text, cell_limits, row_lines
from docaudit.streaming.incremental import run_incremental, write_epoch


def _write(d, name, data: bytes):
    p = d / name
    p.write_bytes(data)
    return p


def test_discover_route_and_guard(spark, tmp_path):
    _write(tmp_path, "a.txt", "hello\n".encode())
    _write(tmp_path, "b.TXT", b"   \n\t")
    _write(tmp_path, "c.pdf", b"not a pdf")
    _write(tmp_path, "d.txt", b"%PDF-1.7 fake")
    _write(tmp_path, "e.csv", b"a,b\x00")
    _write(tmp_path, "f.txt", b"\xff\xfe")
    _write(tmp_path, "g.docx", b"ignored")
    (tmp_path / "sub").mkdir()
    _write(tmp_path / "sub", "h.txt", b"nested is skipped")
    out = {r.file_name: r for r in text_guard(route(discover(spark, str(tmp_path)))).collect()}
    assert set(out) == {"a.txt", "b.TXT", "c.pdf", "d.txt", "e.csv", "f.txt"}
    assert out["a.txt"].route == "text" and out["a.txt"].error is None and out["a.txt"].byte_count == 6
    assert out["b.TXT"].error == "Text input contains no visible content"
    assert out["c.pdf"].error == "PDF extension does not match the file content"
    assert out["d.txt"].error == "PDF content requires a .pdf extension"
    assert out["e.csv"].error == "CSV input contains NUL bytes"
    assert out["f.txt"].error == "Text input is not valid UTF-8"
    import hashlib

    assert out["a.txt"].sha256 == hashlib.sha256(b"hello\n").hexdigest()


def test_size_guard_before_content(spark, tmp_path):
    _write(tmp_path, "big.txt", b"x" * 100)
    _write(tmp_path, "none.txt", b"")
    _write(tmp_path, "fine.txt", b"y")
    # above the source's own limit Spark fails as soon as a file's content is read
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50")
    try:
        out = {r.file_name: r for r in text_guard(route(discover(spark, str(tmp_path)), limits=Limits(max_file_bytes=50))).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert out["big.txt"].error == "Input is 100 bytes; limit is 50 bytes" and out["big.txt"].error_code == 3
    assert out["none.txt"].error == "Input file is empty"
    assert out["fine.txt"].error is None and out["fine.txt"].text == "y"


def test_nothing_found_is_an_input_error(spark, tmp_path):
    from docaudit.plans.jobs import run_batch

    (tmp_path / "empty").mkdir()
    none = spark.createDataFrame([], "name string, json string")
    for folder in (tmp_path / "empty", tmp_path / "absent"):
        s = run_batch(discover(spark, str(folder)), none).summary.collect()[0]
        assert (s.processed, s.failed, s.exit_code) == (0, 0, 3)


def _cells(spark, rows):
    """(file, sheet, row, col, value[, error]) rows of one visible sheet each."""
    full = [(f, sh, f"S{sh}", "visible", r, c, v, None, None, False, e[0] if e else None) for f, sh, r, c, v, *e in rows]
    return spark.createDataFrame(full, CELL_SCHEMA)


def test_canonical_rows(spark):
    cells = _cells(spark, [("a.csv", 1, 2, 1, "header"), ("a.csv", 1, 2, 2, "multi\nline"), ("a.csv", 1, 2, 3, "é"), ("a.csv", 1, 3, 1, "lines"), ("a.csv", 1, 3, 3, "x")])
    lines = {r.row: r.line for r in row_lines(cells, trim_trailing_nulls=False).collect()}
    assert lines[2] == 'row 2: ["header", "multi\\nline", "é"]'
    assert lines[3] == 'row 3: ["lines", null, "x"]'


def test_every_file_has_one_canonical_row(spark):
    cells = _cells(
        spark,
        [
            ("ok", 1, 1, 1, "a"), ("ok", 1, 3, 2, "b"), ("ok", 2, 12, 1, "c"),
            ("long", 1, 1, 1, "a"), ("long", 2, 2, 3, "x" * 9), ("wide", 1, 1, 7, "a"),
            ("broken", 1, 1, 1, "a"), ("broken", 1, 2, 1, "b", "ended inside a quote"),
        ],
    )
    files = spark.createDataFrame([(f,) for f in ("ok", "long", "wide", "broken", "nothing")], "file string")
    lim = Limits(max_tabular_columns=5, max_cell_chars=8)
    out = {r.file: r for r in canonical_text(cells, lim, files=files).collect()}
    assert len(out) == 5
    body = out["ok"].text.split("\n", 1)[1]
    assert body.startswith('sheet 1: "S1"\nrow 1: ["a"]\nrow 2: []\nrow 3: [null, "b"]\nsheet 2: "S2"\n') and body.endswith('row 12: ["c"]\n')
    assert out["ok"].error is None
    assert out["long"].error == "limit cell_chars is 8; found 9 at sheet 2 row 2 column 3" and out["long"].text is None
    assert out["wide"].error == "limit columns is 5; found 7 at sheet 1"
    assert out["broken"].error == "ended inside a quote" and out["nothing"].error == "Input contains no logical rows"
    assert all(out[f].error_code == 3 for f in ("long", "wide", "broken", "nothing"))
    sizes = {r.file: r.canonical_chars for r in cell_limits(cells, lim, files=files).collect()}
    assert sizes["ok"] == len(out["ok"].text)


def test_archive_guard(spark):
    ct = "<?xml version=\"1.0\"?><Types xmlns='u'><Default Extension='xml' ContentType='application/xml'/></Types>"
    wb = "<workbook xmlns='u'><sheets><sheet name='A'/></sheets></workbook>"
    ext = "<Relationships><Relationship Id='r1' Type='u/hyperlink' Target='http://e' TargetMode='External'/></Relationships>"
    base = [("[Content_Types].xml", 0, True, ct), ("xl/workbook.xml", 0, True, wb)]
    packages = {
        "ok": base, "nowb": base[:1], "macro": [*base, ("xl/vbaProject.bin", 0, True, None)], "ext": [*base, ("_rels/.rels", 0, True, ext)],
        "encrypted": [*base, ("x", 1, True, None)], "damaged": [*base, ("x", 0, False, None)],
        "badxml": [base[0], ("xl/workbook.xml", 0, True, "<workbook><a></workbook>")], "entity": [base[0], ("xl/workbook.xml", 0, True, "<a>&b;</a>")],
    }
    rows = [(f, part, 10, flags, ok, xml, None) for f, parts in packages.items() for part, flags, ok, xml in parts]
    rows.append(("unlisted", None, None, None, None, None, "not a package"))
    out = {r.file: r.error for r in archive_guard(spark.createDataFrame(rows, PART_SCHEMA)).collect()}
    assert out == {
        "ok": None, "nowb": "XLSX is missing required package parts: xl/workbook.xml", "macro": "XLSX active content is not supported",
        "ext": "XLSX external relationships are not supported", "encrypted": "Encrypted XLSX ZIP entries are not supported",
        "damaged": "XLSX ZIP checksum failed for x", "badxml": "XLSX package is corrupt", "entity": "XLSX package is corrupt",
        "unlisted": "XLSX package is corrupt",
    }


def test_package_parts_are_read_as_xml(spark):
    """References are resolved; comments, CDATA, nested elements and elements without a namespace do not count."""
    ct = '<Types xmlns="u"><Default ContentType="application/xml"/></Types>'
    wb = '<workbook xmlns="u"><sheets><sheet name="A"/></sheets></workbook>'
    rel = '<Relationships xmlns="r">{}</Relationships>'
    sheets = lambda n: "<sheet/>" * n
    active, external = "XLSX active content is not supported", "XLSX external relationships are not supported"
    cases = {  # (content types, workbook, relationships) and the error
        "fine": (ct, wb, rel.format('<Relationship Type="u/worksheet"/>'), None),
        "type_ref": ('<Types xmlns="u"><Override ContentType="application/&#109;acroEnabled"/></Types>', wb, None, active),
        "type_prefixed": ('<t:Types xmlns:t="u"><t:Default ContentType="x/vbaProject"/></t:Types>', wb, None, active),
        "type_comment": ('<Types xmlns="u"><!-- <Override ContentType="macroEnabled"/> --><Default ContentType="x"/></Types>', wb, None, None),
        "type_cdata": ('<Types xmlns="u"><![CDATA[<Override ContentType="macroEnabled"/>]]></Types>', wb, None, None),
        "mode_ref": (ct, wb, rel.format('<Relationship Type="u/a" TargetMode="&#69;xternal"/>'), external),
        "mode_case": (ct, wb, rel.format("<Relationship Type='u/a' TargetMode='EXTERNAL'/>"), external),
        "active_ref": (ct, wb, rel.format('<Relationship Type="u/&#111;leObject//"/>'), active),
        "second_link": (ct, wb, rel.format('<Relationship Type="u/a"/><Relationship Type="u/connections"/>'), active),
        "link_comment": (ct, wb, rel.format('<!-- <Relationship TargetMode="External"/> -->'), None),
        "no_links": (ct, wb, '<Relationships xmlns="r"/>', None),
        "two_roots": (ct, wb, '<Relationships xmlns="r"/><Relationships xmlns="r"/>', "XLSX package is corrupt"),
        "entity": ('<!DOCTYPE a [<!ENTITY e "macroEnabled">]><Types><Override ContentType="&e;"/></Types>', wb, None, "XLSX package is corrupt"),
        "sheets": (ct, f'<workbook xmlns="u"><sheets>{sheets(21)}</sheets></workbook>', None, "XLSX has 21 sheets; limit is 20"),
        "sheets_prefixed": (ct, f'<w:workbook xmlns:w="u"><w:sheets>{"<w:sheet/>" * 21}</w:sheets></w:workbook>', None, "XLSX has 21 sheets; limit is 20"),
        "sheets_deep": (ct, f'<workbook xmlns="u"><a><b>{sheets(21)}</b></a></workbook>', None, "XLSX has 21 sheets; limit is 20"),
        "sheets_comment": (ct, f'<workbook xmlns="u"><sheets><sheet/><!--{sheets(5000)}--></sheets></workbook>', None, None),
        "sheets_bare": (ct, f"<workbook><sheets>{sheets(21)}</sheets></workbook>", None, None),
        "sheets_like": (ct, f'<workbook xmlns="u">{"<sheets/><sheetView/>" * 21}</workbook>', None, None),
    }
    parts = ("[Content_Types].xml", "xl/workbook.xml", "_rels/.rels")
    rows = [(f, part, 10, 0, True, xml, None) for f, (*texts, _) in cases.items() for part, xml in zip(parts, texts)]
    out = {r.file: r.error for r in archive_guard(spark.createDataFrame(rows, PART_SCHEMA)).collect()}
    assert out == {f: c[3] for f, c in cases.items()}


def test_safe_names(spark):
    from docaudit.functions.text import safe_filename, safe_upload_name

    df = spark.createDataFrame([("a\\b\\c.pdf",), ("..",), (" \u0000",), ("x/ y.txt ",)], "n string")
    assert [r[0] for r in df.select(safe_upload_name(F.col("n"))).collect()] == ["c.pdf", "document", "document", "y.txt"]
    assert [r[0] for r in df.select(safe_filename(F.col("n"))).collect()][3] == "y.txt"


def test_words_that_are_no_month_give_no_date(spark):
    from docaudit.functions.dates import normalize_date, normalize_source_dates

    want = {
        "12 Marble 2026": None, "31 Decoy 2025": None, "Augustus 5, 2026": None, "5 Ma 2026": None, "5 May 2026": "2026-05-05", "SEPT 9, 2026": "2026-09-09",
        "30 february 2026": None, "29 Feb 2024": "2024-02-29", "9.8.2026": "2026-08-09", "2026/8/1": "2026-08-01", "2026-8-01": None, "13/08/2026": "2026-08-13",
        "08/13/2026": "2026-08-13", "07/08/2026": None, "08/08/2026": "2026-08-08", "13/13/2026": None, "  12   aug 2026 ": "2026-08-12", "": None, "2026": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.n for r in df.select("t", normalize_date(F.col("t")).alias("n")).collect()} == want
    rows = [("a", "13/08/2026"), ("a", "07/08/2026"), ("b", "08/13/2026"), ("b", "07/08/2026"), ("c", "13/08/2026"), ("c", "08/13/2026"), ("c", "07/08/2026"), (None, "07/08/2026"), (None, "13/08/2026"), ("d", "07/08/2026")]
    got = normalize_source_dates(spark.createDataFrame(rows, "s string, t string"), "s", "t", "n").collect()
    by = {(r.s, r.t): r.n for r in got}
    assert len(got) == len(rows)
    assert [by[s, "07/08/2026"] for s in ("a", "b", "c", "d", None)] == ["2026-08-07", "2026-07-08", None, None, None]


def test_money_forms(spark):
    from docaudit.functions.dates import normalize_money

    known = {
        "$1,234.00": "1234.00", "1.234,56": "1234.56", "(12.00)": "-12.00", "-€5": "-5", "EUR 7.5": "7.5", "12,5 EUR": "12.5", "1 234,56": "1234.56",
        "1e5": None, "EUR 5 of 7": None, "1,23.00": None, "--5": None, "(-5)": None, "": None, "total 4": None, None: None, "007": None,
    }
    df = spark.createDataFrame([(k,) for k in known], "s string")
    assert {r.s: r.m for r in df.select("s", normalize_money(F.col("s")).alias("m")).collect()} == known


def test_write_envelopes_last_path_wins(spark, tmp_path):
    from docaudit.plans.jobs import write_envelopes

    df = spark.createDataFrame([("in/a.txt", "{1}"), ("in/a.pdf", "{0}"), ("in/b.csv", "{2}")], "path string, json string")
    write_envelopes(df, str(tmp_path / "out"))
    write_envelopes(df, str(tmp_path / "out"))
    assert {(r.stem, r.json) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("a", "{1}"), ("b", "{2}")}


def test_limits_are_checked():
    import pytest

    for bad in ({"max_pages": 0}, {"max_pages": 101}, {"render_dpi": 71}, {"max_file_bytes": 0}, {"request_timeout_seconds": 601}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_checkpoint_folder_must_be_shared(monkeypatch):
    import pytest

    from docaudit import session

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: Fake.conf)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake)


def test_retried_epoch_is_not_doubled(spark, tmp_path):
    inp, out = tmp_path / "in", str(tmp_path / "out")
    inp.mkdir()
    _write(inp, "a.txt", b"first")
    batch = discover(spark, str(inp))
    write_epoch(batch, 3, out)
    write_epoch(batch, 3, out)
    assert [(r.file_name, r.epoch) for r in spark.read.parquet(out).collect()] == [("a.txt", 3)]


def test_incremental_processes_only_new_files(spark, tmp_path):
    inp, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    inp.mkdir()
    _write(inp, "a.txt", b"first")
    run_incremental(spark, str(inp), str(out), str(ck))
    _write(inp, "b.txt", b"second")
    _write(inp, "c.pdf", b"nope")
    run_incremental(spark, str(inp), str(out), str(ck))
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r.file_name for r in rows) == ["a.txt", "b.txt", "c.pdf"]
    assert len({r.epoch for r in rows}) == 2


def test_repair_once(spark, tmp_path):
    from docaudit.operators.extract import REPAIR_PREFIX

    log = tmp_path / "calls"
    good = json.dumps({
        "document_type": "receipt", "document_id": "R-1", "reference_document_id": None,
        "vendor": {"name": None, "tax_id": None, "address": None}, "customer_name": None,
        "issue_date": None, "due_date": None, "delivery_date": None, "currency": "USD",
        "line_items": [], "subtotal": None, "discount": None, "tax": None, "shipping": None, "total": "1",
    })
    bad = good.replace('"total": "1"', '"total": 1')

    def fake(pdf: pd.DataFrame) -> pd.Series:
        out = []
        for key, parts in zip(pdf["doc_key"], pdf["parts"]):
            repair = any(p["text"] and p["text"].startswith(REPAIR_PREFIX) for p in parts)
            with open(log, "a") as f:
                f.write(f"{key}\n")
            if key == 0:
                out.append(good)
            elif key == 1:
                out.append(good if repair else bad)
            elif key == 2:
                out.append(bad)
            else:
                out.append(None)
        return pd.Series(out)

    loaded = spark.createDataFrame(
        [(i, f"f{i}.txt", "text/plain; charset=utf-8", "t") for i in range(4)],
        "doc_key long, file_name string, media_type string, text string",
    )
    res = {r.doc_key: r for r in extract_with_repair(loaded, fake).collect()}
    assert (res[0].outcome, res[0].attempts) == ("ok", 1)
    assert (res[1].outcome, res[1].attempts) == ("ok", 2)
    assert (res[2].outcome, res[2].exit_code, res[2].error) == ("schema_error", 5, "total: value_error")
    assert (res[3].outcome, res[3].attempts) == ("provider_error", 1)
    # one call a document, two for those that a repair was asked for
    assert sorted(log.read_text().split()) == ["0", "1", "1", "2", "2", "3"]


def test_failing_calls_cost_only_their_own_documents():
    import time

    from docaudit.operators.extract import CALL_TIMED_OUT, NOT_TEXT, WRONG_COUNT, isolated

    calls = []

    def fn(pdf):
        keys = pdf["doc_key"].tolist()
        calls.append(keys)
        if 5 in keys or 11 in keys:
            raise KeyError("secret value")
        if 8 in keys:
            return pd.Series(["x"] * (len(keys) + 1))
        return pd.Series([None if k == 2 else 3.5 if k == 3 else float("nan") if k == 4 else f"a{k}" for k in keys], dtype=object)

    got = isolated(fn, pd.DataFrame({"doc_key": range(16)}))
    want = [(f"a{k}", None) for k in range(16)]
    want[2] = want[4] = (None, None)
    want[3] = (None, NOT_TEXT)
    want[5] = want[11] = (None, "extractor raised KeyError")
    want[8] = (None, WRONG_COUNT)
    assert got == want
    # halves: every good document is answered once, and no call holds more than the failing one's half
    assert [k for c in calls if not {5, 8, 11} & set(c) for k in c].__len__() == 13 and len(calls) < 2 * 3 * 5
    assert isolated(fn, pd.DataFrame({"doc_key": []})) == []

    def slow(pdf):
        if 1 in pdf["doc_key"].tolist():
            time.sleep(5)
        return pd.Series(["ok"] * len(pdf))

    began = time.time()
    assert isolated(slow, pd.DataFrame({"doc_key": range(4)}), seconds=0.3) == [("ok", None), (None, CALL_TIMED_OUT), ("ok", None), ("ok", None)]
    assert time.time() - began < 3


def test_a_raising_extractor_ends_in_provider_errors(spark):
    def fn(pdf):
        if (pdf["doc_key"] == 3).any():
            raise RuntimeError("boom")
        return pd.Series(["{}"] * len(pdf))

    loaded = spark.createDataFrame([(i, f"f{i}.txt", "text/plain; charset=utf-8", "t") for i in range(6)], "doc_key long, file_name string, media_type string, text string")
    res = {r.doc_key: r for r in extract_with_repair(loaded, fn).collect()}
    assert (res[3].outcome, res[3].exit_code, res[3].error, res[3].attempts) == ("provider_error", 4, "extractor raised RuntimeError", 1)
    assert all(res[k].outcome == "schema_error" and res[k].attempts == 2 for k in res if k != 3)


def test_run_batch_isolates_failures(spark, tmp_path):
    from docaudit.plans.jobs import run_batch

    good = json.dumps({
        "document_type": "invoice", "document_id": None, "reference_document_id": None,
        "vendor": {"name": "V", "tax_id": None, "address": None}, "customer_name": None,
        "issue_date": "2025-03-04", "due_date": None, "delivery_date": None, "currency": "GBP",
        "line_items": [{"description": "Ink", "quantity": "6", "unit_price": "3.25", "amount": "19.50"}],
        "subtotal": "19.50", "discount": None, "tax": None, "shipping": None, "total": "19.50",
    })
    _write(tmp_path, "ink.txt", b"Ink 6 x 3.25")
    _write(tmp_path, "other.txt", b"no response for me")
    _write(tmp_path, "bad.pdf", b"corrupt")
    responses = spark.createDataFrame([("ink.json", good)], "name string, json string")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    run = run_batch(files, responses, strict=True)
    out = {r.doc_key.rsplit("/", 1)[-1]: (r.stage, r.error_code) for r in run.outcomes.collect()}
    assert out == {"ink.txt": ("done", None), "other.txt": ("extract", 4), "bad.pdf": ("load", 3)}
    s = run.summary.collect()[0]
    assert (s.processed, s.failed, s.exit_code) == (1, 2, 4)
    env = run.envelopes.collect()[0].envelope
    assert env.validation.status == "warning" and [i.code for i in env.validation.issues] == ["MISSING_IDENTIFIER"]
    assert env.source.file_name == "ink.txt" and env.source.page_count == 1
