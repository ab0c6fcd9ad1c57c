"""Changes folded at once give what making them one by one gives."""

import random

from tessera.operators import changes as C

BASE = "user string, id long, title string, n long"
LOG = "user string, id long, at long, op string, given array<string>, title string, n long, extra string"


def _one_by_one(base, log):
    rows = {r[:2]: list(r[2:]) for r in base}
    for user, i, at, op, given, title, n, _ in sorted((r for r in log if r[0] is not None and r[2] is not None), key=lambda r: r[2]):
        k = (user, i)
        if op == "create":
            rows[k] = [title, n]
        elif op == "update" and k in rows:
            rows[k] = [title if "title" in (given or []) else rows[k][0], n if "n" in (given or []) else rows[k][1]]
        elif op == "delete":
            rows.pop(k, None)
    return sorted((*k, *v) for k, v in rows.items())


def test_same_as_one_by_one(spark):
    rnd = random.Random(3)
    base = [(rnd.choice("ab"), i, f"t{i}", i) for i in range(40)]
    log = [(rnd.choice(["a", "b", None]) if rnd.random() < 0.9 else "c", rnd.randrange(60), at, rnd.choice(["create", "update", "update", "delete", "move"]), rnd.choice([None, [], ["title"], ["n"], ["n", "title", "extra"]]), f"x{at}", rnd.choice([None, at]), "e") for at in range(1500)]
    log += [("a", 3, None, "delete", None, None, None, None)]
    log += rnd.sample(log, 200)
    for part in (log, log[:60], []):
        got = C.changed(spark.createDataFrame(base, BASE), spark.createDataFrame(part, LOG).repartition(5), ["user", "id"])
        assert got.columns == ["user", "id", "title", "n"]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(_one_by_one(base, part), key=key)
    assert C.changed(spark.createDataFrame([], BASE), spark.createDataFrame([], LOG), ["user", "id"]).count() == 0


def test_todos(spark):
    todos = spark.createDataFrame([("a", 1, "one", "high", False, None), ("a", 2, "two", "low", True, 5), ("b", 3, "three", "low", True, 6), ("b", 4, "four", "low", True, 7)], "user string, id long, title string, priority string, completed boolean, completed_at long")
    log = [
        ("a", 1, 10, "update", ["completed"], None, None, True), ("a", 2, 11, "update", ["completed", "title"], "2", None, False), ("a", 3, 12, "delete", None, None, None, None), ("b", 3, 13, "update", ["completed_at", "priority"], None, "high", None),
        ("b", 4, 14, "delete", [], None, None, None), ("a", 5, 15, "create", None, "five", None, None), ("a", 6, 16, "create", None, "six", "low", True), ("a", 5, 17, "update", ["completed"], None, None, True), ("a", 5, 18, "update", ["completed"], None, None, None),
    ]
    got = C.changed_todos(todos, spark.createDataFrame(log, "user string, id long, at long, op string, given array<string>, title string, priority string, completed boolean"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "one", "high", True, 10), ("a", 2, "2", "low", False, None), ("a", 5, "five", "medium", False, None), ("a", 6, "six", "low", True, 16), ("b", 3, "three", "high", True, 6)]


def test_cards(spark):
    schema = "user string, id long, board long, lane string, title string, description string, document long, position double"
    cards = spark.createDataFrame([("a", 1, 1, "todo", "x", "", None, 0.0), ("a", 2, 1, "todo", "y", "", 7, 500.0), ("b", 3, 2, "todo", "z", "", None, 0.0)], schema)
    log = [
        ("a", 10, 1, "create", None, 1, "todo", "first", "d", None, 3.0), ("a", 11, 2, "create", None, 1, "todo", "second", None, 8, None), ("a", 12, 3, "create", None, 2, "todo", "not my board", None, None, None),
        ("a", 13, 4, "create", None, 1, "done", "alone", None, None, None), ("a", 14, 5, "create", None, 1, "todo", "soon gone", None, None, None), ("a", 14, 6, "delete", None, None, None, None, None, None, None),
        ("a", 2, 7, "update", ["lane", "position", "board"], 9, "done", None, None, None, 250.0), ("a", 3, 8, "delete", None, None, None, None, None, None, None), ("b", 3, 9, "update", ["title", "description", "lane"], None, None, None, "new", None, None),
        ("a", 13, 10, "update", ["position", "lane"], None, "todo", None, None, None, None),
    ]
    changes = spark.createDataFrame(log, "user string, id long, at long, op string, given array<string>, board long, lane string, title string, description string, document long, position double")
    got = C.changed_cards(cards, changes, spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "board long, user string"))
    assert got.columns == cards.columns
    assert {r["id"]: (r["user"], r["board"], r["lane"], r["title"], r["description"], r["document"], r["position"]) for r in got.collect()} == {
        1: ("a", 1, "todo", "x", "", None, 0.0), 2: ("a", 1, "done", "y", "", 7, 250.0), 3: ("b", 2, "todo", "z", "new", None, 0.0),
        10: ("a", 1, "todo", "first", "d", None, 1000.0), 11: ("a", 1, "todo", "second", None, 8, 2000.0), 13: ("a", 1, "todo", "alone", None, None, 3000.0),
    }
