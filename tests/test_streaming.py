import json

from threadloom.streaming import outbox as O


def event(i, **more):
    return {"event_id": f"e{i}", "space": "s", "session_id": "a", "actor": "user", "content": f"text {i}", "occurred_at": "2024-01-01T00:00:00Z", "created_at": "2024-01-01T00:00:00Z"} | more


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_append_is_idempotent(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    ledger, check = f"file://{tmp_path}/ledger", f"file://{tmp_path}/check"
    put(arriving, "1.json", [event(1), event(2), event(9, content="text 1"), {"no": "event"}])
    O.append_stream(O.arriving(spark, str(arriving)), ledger, check).awaitTermination(120)
    put(arriving, "2.json", [event(2), event(3)])
    O.append_stream(O.arriving(spark, str(arriving)), ledger, check).awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(ledger).collect()) == ["e1", "e2", "e3"]
    # a lost checkpoint replays everything and changes nothing
    O.append_stream(O.arriving(spark, str(arriving)), ledger, check + "2").awaitTermination(120)
    assert spark.read.parquet(ledger).count() == 3


def test_windows_of_user_turns(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    put(arriving, "1.json", [event(i) for i in range(7)] + [event(50, actor="assistant"), event(60, session_id="b")])
    out = f"file://{tmp_path}/out"

    def run():
        q = O.turn_windows(O.arriving(spark, str(arriving)), 3).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert run() == [("a", 0, 1, 3), ("a", 1, 4, 6)]
    put(arriving, "2.json", [event(70), event(71)])
    assert run() == [("a", 0, 1, 3), ("a", 1, 4, 6), ("a", 2, 7, 9)]
