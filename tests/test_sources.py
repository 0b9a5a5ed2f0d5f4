import json

import pytest

from threadloom.sources import files as S


def test_json_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 3}\nbroken\n{"id": "b", "n": 2}\n')
    rows = S.jsonl(spark, str(p), "id string, n int")
    assert sorted((r["id"], r["n"]) for r in rows.collect()) == [("a", 1), ("a", 3), ("b", 2)]
    assert {(r["id"], r["n"]) for r in S.last_records(rows, "id", "n").collect()} == {("a", 3), ("b", 2)}
    with pytest.raises(Exception):
        S.jsonl(spark, str(p), "id string, n int", strict=True).collect()


def test_nested_cases(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"id": "q", "dates": ["2024-01-01 00:00:00"], "sessions": [[{"role": "user"}, {"role": "assistant"}]]}]))
    got = S.turns(S.cases(spark, str(p), "id string, dates array<timestamp>, sessions array<array<struct<role:string>>>"), "id", "sessions", "dates").orderBy("turn_no").collect()
    assert [(r["turn_no"], r["turn"]["role"], r["at"].second) for r in got] == [(0, "user", 0), (1, "assistant", 1)]


def test_files_by_line_and_name(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "b.txt").write_text("two")
    rows = S.lines(spark, str(tmp_path / "a.txt"))
    assert [r["line"] for r in S.sliced(rows, 2, 2).orderBy("line_no").collect()] == ["two", "three"]
    assert [r["line_no"] for r in S.grep(rows, "^t").orderBy("line_no").collect()] == [2, 3]
    assert S.grep(rows, "^t", "count").first()["n"] == 2 and S.grep(rows, "^t", "files").count() == 1
    assert [r["path"].rsplit("/", 1)[1] for r in S.glob(spark, str(tmp_path), "*.txt").collect()] == ["a.txt"]


def test_results_are_ranked_anew(spark):
    df = spark.createDataFrame([("q", [(" A ", " u1 "), ("B", None), ("C", "u2")])], "q string, items array<struct<title:string,url:string>>")
    assert [tuple(r) for r in S.results(df, "q", "items").orderBy("rank").collect()] == [("q", 1, "A", "u1"), ("q", 2, "C", "u2")]


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    folder = f"file://{tmp_path}"
    S.publish(spark.range(3), folder, 3)
    with pytest.raises(ValueError):
        S.publish(spark.range(2), folder, 5)
    assert S.published(spark, folder).count() == 3
    a, b = S.report(spark.createDataFrame([("m", 1.0)], "name string, v double"), str(tmp_path / "r"))
    assert json.load(open(a)) == [{"name": "m", "v": 1.0}] and "| m | 1.0 |" in open(b).read()
