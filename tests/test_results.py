"""Stored results: files with headers of their own, retried runs, first errors."""

import os

from inkfold.sources import results


def put(path, text, mtime):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (mtime, mtime))


def test_files_with_their_own_headers(spark, tmp_path):
    put(tmp_path / "run=a/route=results/x.csv", 'file_id,score,q1,q2\n"s1","5.0","A","NR"\n\n"s2","NA","",\n"  ","","",""\n"s3","1"\n', 1000)
    put(tmp_path / "run=b/route=results/y.csv", '"file_id","q1","q2","CandidateNumber","note"\n"s4","NR","NR","12","a, ""b"""\n"s5","A","NR","x","",more\n', 2000)
    put(tmp_path / "run=a/route=errors/e1.csv", "file_id,score,q1\ns9,NA,\ns8,NA,NR\ns9,again,\n", 1500)
    put(tmp_path / "run=b/route=errors/e2.csv", "score,file_id,q1,q2\nNA,s8,NR,NR\nNA,s7,NR,NR\n", 2500)
    put(tmp_path / "run=b/_workers/route=errors/e3.csv", "file_id\nhidden\n", 100)
    records = results.read_records(spark, str(tmp_path))
    got = {r.record["file_id"]: r.record for r in records.where("file like '%route=results%'").collect()}
    assert got["s1"] == {"file_id": "s1", "score": "5.0", "q1": "A", "q2": "NR"} and got["s2"]["q1"] == "" and got["s3"] == {"file_id": "s3", "score": "1"}
    assert got["s4"]["note"] == 'a, "b"' and got["s5"] == {"file_id": "s5", "q1": "A", "q2": "NR", "CandidateNumber": "x", "note": ""} and len(got) == 5
    view = {r.file_id: r for r in results.stored_results(records, "[0-9]+").collect()}
    assert {k: r.status for k, r in view.items()} == {"s4": "ok", "s5": "ok", "s9": "failed", "s8": "failed", "s7": "failed"}
    assert view["s4"].qc_flags == ["HIGH_NR"] and view["s5"].qc_flags == ["BAD_CANDIDATE"] and view["s4"].responses == {"q1": "NR", "q2": "NR", "CandidateNumber": "12", "note": 'a, "b"'}
    assert view["s9"].score == "NA" and view["s8"].run == "a"  # the first by time and row
    assert view["s8"].nr_count == 1 and view["s7"].nr_count == 2 and view["s7"].qc_flags == ["HIGH_NR", "BAD_CANDIDATE"]  # by the header of the results
    only = {r.file_id: r for r in results.stored_results(records.where("file like '%errors%'")).collect()}
    assert set(only) == {"s7", "s8", "s9"} and only["s7"].nr_count == 1 and only["s7"].error_reason == results.FAILED


def test_retry_replaces_a_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", "results", "1.0", None), ("b", "errors", "NA", "")], "file_id string, route string, score string, q1 string")
    results.write_run(rows, str(tmp_path), "r1")
    results.write_run(rows.where("route = 'results'"), str(tmp_path), "r1")  # the retry has no errors
    results.write_run(rows, str(tmp_path), "r2")
    got = sorted((r.file.split("/run=")[1][:2], r.record["file_id"], r.record["q1"]) for r in results.read_records(spark, str(tmp_path)).collect())
    assert got == [("r1", "a", ""), ("r2", "a", ""), ("r2", "b", "")]


def test_import_reasons(spark):
    files = spark.createDataFrame([("a.PNG", 5), ("b.txt", 5), ("c", 5), ("d.jpg", 0), ("e.jpg", 500)], "path string, bytes long")
    got = {r.path: r.skipped for r in results.imported(files, "path", "bytes", [".png", ".jpg"], 100).collect()}
    assert got == {"a.PNG": None, "b.txt": "unsupported suffix .txt", "c": "unsupported suffix ", "d.jpg": "empty file", "e.jpg": "larger than 100 bytes"}
