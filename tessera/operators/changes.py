"""Tables after logs of changes: rows created, patched, moved and deleted, as boards and to-do lists are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered
from tessera.sources.scratch import stash

#: Between a column's last card and the next one.
GAP = 1000.0


def changed(base: DataFrame, changes: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """base after changes (keys, order, op, given, and any of base's other columns), as if each were made in turn.

    op `create` makes the row anew, with null for what the change does not have; `update` sets the columns that the array `given` names, and `delete` takes the row away. Updates and deletes of rows
    that are not there do nothing, so with the owner among the keys another's row is like a missing one. Changes with a null key, order or op, and other ops, do nothing; a null `given` names none. Of one
    key no two different changes may have the same order; repeated ones alter nothing. Changes are folded by one aggregation that starts before the shuffle, so a key with most of them is no task's burden.
    """
    fields = [c for c in base.columns if c not in keys]
    at = F.col(order)
    when = lambda op: F.when(F.col("op") == op, at)
    good = changes.where(at.isNotNull())
    for k in keys:
        good = good.where(F.col(k).isNotNull())
    of = {c: (F.col(c) if c in changes.columns else F.lit(None)).cast(base.schema[c].dataType) for c in fields}
    sets = lambda c: F.when((F.col("op") == "create") | (F.col("op") == "update") & F.array_contains("given", c), at)
    last = good.groupBy(*keys).agg(
        F.max(when("create")).alias("_made"),
        F.max(when("delete")).alias("_gone"),
        # a row that is made sets all columns, so what came before it, and what was done to a row that was gone, never counts
        *[F.max_by(F.struct(of[c].alias("v")), sets(c)).alias(f"_to_{n}") for n, c in enumerate(fields)],
    )
    rows = base.withColumn("_held", F.lit(True)).join(last, keys, "full_outer")
    live = F.when(F.col("_made").isNotNull(), F.col("_gone").isNull() | (F.col("_made") > F.col("_gone"))).otherwise(F.col("_gone").isNull() & F.col("_held"))
    value = lambda n, c: F.when(F.col(f"_to_{n}").isNotNull(), F.col(f"_to_{n}")["v"]).otherwise(F.col(c))
    return rows.where(live).select(*[F.col(c) if c in keys else value(fields.index(c), c).alias(c) for c in base.columns])


def changed_todos(todos: DataFrame, changes: DataFrame) -> DataFrame:
    """todos (user, id, title, priority, completed, completed_at) after their users' changes (user, id, at, op, given, title, priority, completed).

    A new to-do is of medium priority and open unless it says otherwise. When it is completed is never taken from a change: it is the change's time, and reopening clears it.
    """
    done = F.coalesce("completed", F.lit(False))
    sets = (F.col("op") == "create") | F.array_contains("given", "completed")
    made = F.col("op") == "create"
    rows = changes.select(
        "user", "id", "at", "op", "title",
        F.when(made, F.coalesce("priority", F.lit("medium"))).otherwise(F.col("priority")).alias("priority"),
        done.alias("completed"),
        F.when(sets & done, F.col("at")).alias("completed_at"),
        # completed_at goes with completed, and by itself cannot be given
        F.when(sets, F.array_union(F.array_except("given", F.array(F.lit("completed_at"))), F.array(F.lit("completed"), F.lit("completed_at")))).otherwise(F.array_except("given", F.array(F.lit("completed_at")))).alias("given"),
    )
    return changed(todos, rows, ["user", "id"])


def changed_cards(cards: DataFrame, changes: DataFrame, boards: DataFrame) -> DataFrame:
    """cards (user, id, board, lane, title, description, document, position) after their users' changes (user, id, at, op, given, and those columns).

    Cards are made only on boards (board, user) of the same user. Patches and moves set what they give, also `lane` and `position`, but no other board, and a lane or title that is null is not set. New cards that
    are still there and have no position stand at the end of their lane, GAP apart in the order of their making, behind all that the other changes leave there; the first of an empty lane is at 0.
    """
    own = boards.where("board IS NOT NULL").select("board", "user").distinct()
    made = changes.where("op = 'create'").join(own, ["board", "user"], "left_semi").withColumn("position", F.lit(None).cast("double"))
    fixed = F.concat(F.array(F.lit("board"), F.lit("user")), *[F.when(F.col(c).isNull(), F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in ("lane", "title", "position")])
    rest = changes.where("op <> 'create'").withColumn("given", F.array_except("given", fixed))
    folded = changed(cards.withColumn("made", F.lit(None).cast(changes.schema["at"].dataType)), made.unionByName(rest).withColumn("made", F.col("at")), ["user", "id"])
    rows = stash(folded, "cards")  # read for lanes' ends, for new cards and for the others
    lane = ["user", "board", "lane"]
    new = F.col("position").isNull() & F.col("made").isNotNull()
    ends = rows.where("position IS NOT NULL").groupBy(*lane).agg(F.max("position").alias("_end"))
    placed = numbered(rows.where(new), lane, [F.col("made").asc(), F.col("id").asc()], "_nth")
    same = [placed[c].eqNullSafe(ends[c]) for c in lane]
    start = F.coalesce(F.col("_end") + GAP, F.lit(0.0))
    placed = placed.join(ends, same, "left").select(*[(start + GAP * (F.col("_nth") - 1)).alias(c) if c == "position" else placed[c] for c in cards.columns])
    return rows.where(~new).select(*cards.columns).unionByName(placed)

