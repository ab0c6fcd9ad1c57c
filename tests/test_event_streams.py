"""Events of answers: written by a stream, read back whole, also after a task that failed half-way."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as E

SCHEMA = "session string, turn long, content string, chunks array<string>, cited array<string>"
ROWS = [
    ("a", 1, "  two  words\nand data: a line\n\nevent: x ", ["7", None, "9"], ["9"]),
    ("a", 2, "", None, None),
    ("b:c%/ü\n", 1, "ünï \"q\" \\ \t\r\n 数据", [], ["1", "1"]),
    ("b", 3, None, ["4"], ["4"]),
    ("long", 1, "word " * 50_000, [], []),
    (None, 1, "x", [], []),
    ("a", None, "x", [], []),
]


def _stream(spark, rows, files=3):
    root = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(f"{root}/in")
    return E.turn_events(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")), root


def _plain(rows):
    clean = lambda ids: [i for i in ids or [] if i is not None]
    return {(s, t): (c or "", clean(k), clean(d) if c is not None else [], "done" if c is not None else "error", True) for s, t, c, k, d in rows if s is not None and t is not None}


def _read(spark, path):
    rows = E.answers(E.read_events(spark, path)).collect()
    assert len({(r["session"], r["turn"]) for r in rows}) == len(rows)
    return {(r["session"], r["turn"]): (r["text"], r["chunks"], r["cited"], r["outcome"], r["whole"]) for r in rows}


def test_what_is_written_is_read_back(spark):
    stream, root = _stream(spark, ROWS)
    E.write_events(stream, f"{root}/out", f"{root}/state")
    assert _read(spark, f"{root}/out") == _plain(ROWS)
    E.write_events(stream, f"{root}/out", f"{root}/state")  # nothing new: nothing is added
    assert _read(spark, f"{root}/out") == _plain(ROWS)


def test_a_failed_task_leaves_no_event_twice(spark):
    rows = [("s", n, f"answer {n} of many words", [str(n)], []) for n in range(60)]
    stream, root = _stream(spark, rows, files=2)
    flag = f"{root}/failed"

    def fails_once(frames):
        for f in frames:
            for lo in range(0, len(f), 10):
                if lo >= 100 and not Path(flag).exists():
                    Path(flag).touch()
                    raise RuntimeError("lost half-way")
                yield f.iloc[lo : lo + 10]

    flaky = stream.mapInPandas(fails_once, stream.schema)
    with pytest.raises(Exception, match="lost half-way"):
        E.write_events(flaky, f"{root}/out", f"{root}/state")
    E.write_events(flaky, f"{root}/out", f"{root}/state")
    assert _read(spark, f"{root}/out") == _plain(rows)


def test_events_have_the_format_that_readers_expect(spark):
    got = E.turn_events(spark.createDataFrame([("s", 1, "hi you", ["3"], ["3"])], SCHEMA))
    block = E.event_block(*[F.col(c) for c in ("session", "turn", "seq", "event", "data")])
    assert [r[0] for r in got.orderBy("seq").select(block).collect()] == [
        'id: s:1:0\nevent: retrieval\ndata: {"chunk_ids":["3"]}',
        'id: s:1:1\nevent: token\ndata: {"text":"hi "}',
        'id: s:1:2\nevent: token\ndata: {"text":"you"}',
        'id: s:1:3\nevent: citation\ndata: {"chunk_id":"3"}',
        "id: s:1:4\nevent: done\ndata: {}",
    ]


def test_odd_lines(spark):
    blocks = ["data: 1", "event: a\nevent:b \ndata:{}\ndata: [2] \r", "event: heartbeat", "", ": a comment\nid: 5\ndata: x", "id: a%20b:2:7\ndata: y", None]
    got = E.parsed(spark.createDataFrame([(b,) for b in blocks], "value string")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, "message", "1"), (None, None, None, "b", "[2]"), (None, None, None, "message", "x"), ("a b", 2, 7, "message", "y")]


def test_broken_turns_and_going_on_after_the_last_event(spark):
    schema = "session string, turn long, seq int, event string, data string"
    token, end = '{"text":"x"}', "{}"
    rows = [
        ("ok", 1, 0, "heartbeat", end), ("ok", 1, 1, "heartbeat", end), ("ok", 1, 2, "retrieval", '{"chunk_ids":[]}'), ("ok", 1, 3, "token", token), ("ok", 1, 4, "done", end),
        ("gap", 1, 0, "retrieval", end), ("gap", 1, 2, "done", end),
        ("order", 1, 0, "token", token), ("order", 1, 1, "retrieval", end),
        ("twice", 1, 0, "retrieval", end), ("twice", 1, 0, "retrieval", end), ("twice", 1, 1, "done", end),
        ("ends", 1, 0, "done", end), ("ends", 1, 1, "error", end),
        ("other", 1, 0, "message", "not json"),
        ("open", 1, 0, "retrieval", end),
    ]
    ev = spark.createDataFrame(rows, schema)
    got = {r["session"]: (r["outcome"], r["whole"], r["n_events"]) for r in E.answers(ev).collect()}
    assert got == {"ok": ("done", True, 5), "gap": ("done", False, 2), "order": ("open", False, 2), "twice": ("done", False, 3), "ends": ("error", False, 2), "other": ("open", False, 1), "open": ("open", True, 1)}
    seen = spark.createDataFrame([("ok", 1, 1), ("ok", 1, 2), ("gap", 1, 9)], "session string, turn long, seq int")
    rest = E.after(ev.where("session IN ('ok', 'gap', 'open')"), seen).collect()
    assert sorted((r["session"], r["seq"]) for r in rest) == [("ok", 3), ("ok", 4), ("open", 0)]
    assert E.answers(ev.limit(0)).count() == 0
