"""Normalisation, gates, deduplication, files and evidence."""

import base64
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hazlake.functions import numbers, text
from hazlake.operators.batch import accept_rows, match_headers, reject_rows
from hazlake.operators.evidence import evidence_files, evidence_records
from hazlake.operators.normalize import classify_rows, normalize
from hazlake.operators.quality import deduplicate, ingestion_report
from hazlake.sources.audit import audit_files, audit_uploads, list_files
from hazlake.sources.readers import read_folder
from hazlake.sources.stores import append_events, matrix_rows, read_metrics_document, read_store, write_metrics


def raw(spark, rows, columns):
    schema = ", ".join(f"`{c}` string" for c in columns) + ", row_index long"
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    return frame.withColumn("source_dataset", F.lit("t.csv"))


def test_normalisation(spark):
    names = ["Description", "Potential Accident Level", "Accident Level", "Critical Risk", "Industry Sector",
             "Employee or Third Party", "Local", "Countries", "Data", "Genre"]
    row = ("  High   pressure\r\nline burst café ", "Level IV", "Minor", "pressurized systems", "rig o'neil r&d",
           "third party", "  Local_05 ", " None", "2016-05-12", "male")
    r = normalize(raw(spark, [row], names)).first()
    assert r["cleaned_text"] == "High pressure line burst café"
    assert (r["severity_level"], r["severity_rank"], r["actual_accident_level"]) == ("IV", 4, "I")
    assert r["critical_risk"] == "Pressurized Systems & Lines" and r["industry_sector"] == "Rig O'Neil R&D"
    assert r["worker_type"] == "Contractor / Third Party" and r["gender"] == "Male"
    assert (r["location"], r["country"], r["incident_id"]) == ("Local_05", "Unknown", "t.csv:0")


def test_severity_oddities(spark):
    levels = ["vi", "level vi", "6", "4.0", "FATAL", None]
    rows = [("some long text", v) for v in levels]
    got = [r["severity_level"] for r in normalize(raw(spark, rows, ["text", "severity"])).orderBy("row_index").collect()]
    assert got == ["V", "I", "I", "I", "V", "I"]


def test_last_description_name_never_counts_alone(spark):
    rows = [("valid text here", None), (None, "only under the last name"), ("    ", "x"), ("ab", None)]
    frame = raw(spark, rows, ["Description", "Incident Description"])
    got = {r["row_index"]: r["row_status"] for r in classify_rows(frame.coalesce(1)).collect()}
    assert sorted(got.values()) == ["missing", "missing", "missing", "valid"]


def test_first_description_decides_validity(spark):
    frame = raw(spark, [("abc", "long enough text")], ["Description", "narrative"])
    assert classify_rows(frame).first()["row_status"] == "invalid"


def test_report_of_counts(spark):
    rows = [("Valid observation one with gas.", "IV"), ("Valid observation two.", "III"),
            ("Valid observation one with gas.", "II"), ("", "I"), (None, "I")]
    frame = raw(spark, rows, ["Description", "Potential Accident Level"])
    reports = normalize(frame)
    r = ingestion_report(frame, reports).first()
    assert (r["total_rows"], r["valid_rows"], r["duplicates"], r["missing_descriptions"]) == (5, 2, 1, 2)
    assert r["quality_score_percentage"] == 40.0 and r["severity_iv"] == 1 and r["severity_ii"] == 0
    kept = {x["cleaned_text"]: x["severity_level"] for x in deduplicate(reports).collect()}
    assert kept["Valid observation one with gas."] == "IV"


def test_batch_gate_and_headers(spark):
    frame = raw(spark, [("nan", "x"), ("abc", "y"), ("good text", None)], [" Narrative ", "Dept"])
    assert match_headers(frame.columns)["description"] == " Narrative "
    assert reject_rows(frame).count() == 2
    ok = accept_rows(frame).first()
    assert (ok["report_text"], ok["sector"], ok["gender"]) == ("good text", "Mining", "Male")
    with pytest.raises(ValueError):
        match_headers(["a", "b"])


def test_rounding_matches_python(spark):
    values = [12.25, 12.35, 0.125, 2.675, 1.005, 99.95, 33.333, 0.5, 1.5, 2.5, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        got = [r[0] for r in frame.select(numbers.round_even(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_text_helpers(spark):
    frame = spark.createDataFrame([(" Check BOP; LEL at 5 psi.  ",)], "t string")
    r = frame.select(
        text.expand_acronyms(F.col("t")).alias("a"), text.word_count(F.col("t")).alias("w"),
        text.excerpt(F.col("t"), 6).alias("e"), text.quote_join(F.array(*map(F.lit, "abcd"))).alias("q"),
        text.year_month(F.lit("seen 2024/07/01")).alias("p"),
    ).first()
    assert "blowout preventer; lower explosive limit at 5 psi pressure." in r["a"]
    assert (r["w"], r["e"], r["q"], r["p"]) == (6, "Check...", "'a', 'b', 'c'", "2024-07")


def _xlsx(path, rows):
    cells = "".join(
        f"<row r='{i}'>" + "".join(f"<c r='{chr(65 + j)}{i}' t='inlineStr'><is><t>{v}</t></is></c>" for j, v in enumerate(row)) + "</row>"
        for i, row in enumerate(rows, 1)
    )
    xml = f"<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>{cells}</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", xml)


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Description,Local\n"line one\nline two, quoted",Here\n"second row",N/A\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("Description,Local\nCafé spill seen,Ünit\n".encode("latin-1"))
    (tmp_path / "a2.csv").write_text("Description,Local\none more row,There\n")
    (tmp_path / "c.json").write_text(json.dumps({"reports": [{"Description": "from json"}, {"Description": "more json"}]}))
    (tmp_path / "d.json").write_text(json.dumps({"ALT-1": {"alert_status": "NEW"}}))
    (tmp_path / "e.json").write_text(json.dumps([{"other": 1}]))
    (tmp_path / "f.json").write_text("{broken")
    (tmp_path / "g.json").write_text("[]")
    (tmp_path / "alerts_store.json").write_text("{}")
    (tmp_path / "h.txt").write_text("no")
    _xlsx(tmp_path / "i.xlsx", [["Description", "Local"], ["from a sheet", "Plant"]])
    spark.createDataFrame([("from parquet",)], "text string").coalesce(1).toPandas().to_parquet(tmp_path / "j.parquet")
    audit = {r["file"]: (r["is_valid"], r["reason"]) for r in audit_files(spark, str(tmp_path)).collect()}
    assert sorted(f for f, v in audit.items() if v[0]) == ["a.csv", "a2.csv", "b.csv", "c.json", "i.xlsx", "j.parquet"]
    assert audit["d.json"][1].startswith("A store keyed by id") and "is a description" in audit["e.json"][1]
    assert "Not readable" in audit["f.json"][1] and "empty" in audit["g.json"][1] and "left out" in audit["alerts_store.json"][1]
    rows = {(r["source_dataset"], r["row_index"]): r for r in read_folder(spark, str(tmp_path)).collect()}
    assert len(rows) == 8 and rows["a2.csv", 0]["Local"] == "There"
    assert rows["a.csv", 0]["Description"] == "line one\nline two, quoted" and rows["a.csv", 1]["Local"] is None
    assert rows["b.csv", 0]["Description"] == "Café spill seen"
    assert rows["c.json", 1]["Description"] == "more json" and rows["i.xlsx", 0]["Local"] == "Plant"
    assert rows["j.parquet", 0]["text"] == "from parquet"
    guard = {r["file"]: r["is_valid"] for r in audit_uploads(list_files(spark, str(tmp_path)), max_bytes=30).collect()}
    assert not guard["a.csv"] and not guard["h.txt"] and guard["g.json"]


def test_stores_and_metrics(spark, tmp_path):
    from hazlake.schemas import ALERT

    (tmp_path / "s.json").write_text(json.dumps({"ALT-1": {"alert_id": "ALT-1", "risk_score": 80, "detected_precursors": ["a"]}}))
    r = read_store(spark, str(tmp_path / "s.json"), ALERT).first()
    assert (r["store_key"], r["risk_score"], r["detected_precursors"]) == ("ALT-1", 80, ["a"])
    (tmp_path / "m.json").write_text(json.dumps({"confusion_matrix": [[3, 1], [0, 2]]}, indent=1))
    cells = {(c["y_true"], c["y_pred"]): c["n"] for c in matrix_rows(read_metrics_document(spark, str(tmp_path / "m.json")), ("I", "II")).collect()}
    assert cells == {("I", "I"): 3, ("I", "II"): 1, ("II", "I"): 0, ("II", "II"): 2}
    events = spark.sql("SELECT 1 AS event_id, timestamp'2024-01-01 10:00:00' AS ts")
    append_events(events, str(tmp_path / "log"))
    append_events(events, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    write_metrics(events, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["event_id"] == 1


def test_evidence(spark, tmp_path):
    png = base64.b64encode(bytes.fromhex("89504E470D0A1A0A") + b"x" * 20).decode()
    rows = [("R1", f"data:image/png;base64,{png}", "p.png"), ("R2", "not base64!", None), ("R3", None, None),
            ("R4", base64.b64encode(b"plain text here").decode(), None), ("R5", png, None)]
    got = {r["report_id"]: r for r in evidence_records(spark.createDataFrame(rows, "report_id string, payload string, filename string")).collect()}
    assert got["R1"]["image_attached"] and got["R1"]["format"] == "PNG" and got["R1"]["file_size_bytes"] == 28
    assert got["R2"]["error_message"] == "The payload is not base64." and not got["R2"]["image_attached"]
    assert got["R3"]["error_message"] is None and not got["R3"]["image_attached"]
    assert "format" in got["R4"]["error_message"] and got["R5"]["original_filename"] == "evidence.png"
    (tmp_path / "REP-1_IMG-AB12.png").write_bytes(b"abc")
    (tmp_path / "REP-2_IMG-CD34.png").write_bytes(b"abcd")
    one = evidence_files(spark, str(tmp_path), "IMG-CD34").collect()
    assert [(r["image_id"], r["file_size_bytes"]) for r in one] == [("IMG-CD34", 4)]
