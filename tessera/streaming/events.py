"""Answers as event streams: events of a turn, their text files, and turns read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Events in the order in which a turn gives them; `error` stands in for what is left of a turn that fails.
ORDER = ("heartbeat", "retrieval", "token", "citation", "done", "error")

#: A blank line ends an event.
END = "\n\n"

#: Pieces of an answer: a word with the spaces behind it.
PIECE = "[^ ]+ *|^ +"

_ITEM = "struct<event: string, text: string, ids: array<string>>"


def turn_events(turns: DataFrame) -> DataFrame:
    """(session, turn, seq, event, data) of answers (session, turn, content, chunks, cited): what was retrieved, the text piece by piece, one event a citation, and the end.

    seq counts from 0 in each turn and data is JSON. chunks and cited are arrays of ids in order; null ones are empty, and null ids drop out. A null content is a turn that
    failed after its retrieval, an empty one has no pieces. Rows without a session or turn are left out. Rows are told apart by (session, turn), so repeated ones must be merged before.
    """
    empty = F.array().cast("array<string>")
    ids = lambda c: F.array_compact(F.coalesce(F.col(c).cast("array<string>"), empty))
    item = lambda kind, text=None, ids=None: F.struct(F.lit(kind).alias("event"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if ids is None else ids).cast("array<string>").alias("ids"))
    said = F.concat(
        F.transform(F.regexp_extract_all("content", F.lit(PIECE), F.lit(0)), lambda p: item("token", p)),
        F.transform(ids("cited"), lambda c: item("citation", c)),
        F.array(item("done")),
    )
    failed = F.array(item("error", F.lit("chat_turn_failed")))
    items = F.concat(F.array(item("retrieval", ids=ids("chunks"))).cast(f"array<{_ITEM}>"), F.when(F.col("content").isNull(), failed.cast(f"array<{_ITEM}>")).otherwise(said.cast(f"array<{_ITEM}>")))
    rows = turns.where("session IS NOT NULL AND turn IS NOT NULL").select("session", "turn", F.posexplode(items).alias("seq", "i"))
    data = (
        F.when(F.col("i.event") == "retrieval", F.to_json(F.struct(F.col("i.ids").alias("chunk_ids"))))
        .when(F.col("i.event") == "token", F.to_json(F.struct(F.col("i.text").alias("text"))))
        .when(F.col("i.event") == "citation", F.to_json(F.struct(F.col("i.text").alias("chunk_id"))))
        .when(F.col("i.event") == "error", F.to_json(F.struct(F.col("i.text").alias("code"))))
        .otherwise("{}")
    )
    return rows.select("session", "turn", "seq", F.col("i.event").alias("event"), data.alias("data"))


def event_block(session: Column, turn: Column, seq: Column, event: Column, data: Column) -> Column:
    """One event's lines without the blank one behind them. Its id is session:turn:seq, the session URL-encoded, so that a reader can go on after the last event it has seen."""
    name = F.concat_ws(":", F.url_encode(session.cast("string")), turn.cast("string"), seq.cast("string"))
    return F.concat(F.lit("id: "), name, F.lit("\nevent: "), event, F.lit("\ndata: "), data)


def write_events(events: DataFrame, path: str, state: str) -> None:
    """Append a stream of (session, turn, seq, event, data) to text files under path, to the end of what is there; state: the stream's checkpoint folder.

    A batch's files count once Spark has logged the whole batch under path, so readers see an event once, also where a task failed, was run twice, or the stream was started anew.
    """
    block = event_block(*[F.col(c) for c in ("session", "turn", "seq", "event", "data")])
    q = events.select(block.alias("value")).writeStream.format("text").option("path", path).option("lineSep", END).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def parsed(blocks: DataFrame, column: str = "value") -> DataFrame:
    """(session, turn, seq, event, data) of events' lines. The last line of a field counts; without a name it is a `message`, without data no event; other lines are passed over. Events with another kind of id, or none, have null session, turn and seq."""
    lines = F.split(F.col(column), "\n")

    def field(name: str) -> Column:
        last = F.try_element_at(F.filter(lines, lambda x: x.startswith(f"{name}:")), F.lit(-1))
        return F.btrim(F.substring(last, len(name) + 2, 1 << 30), F.lit(" \t\r"))

    rows = blocks.select(field("id").alias("id"), F.coalesce(field("event"), F.lit("message")).alias("event"), field("data").alias("data")).where("data <> ''")
    at = F.regexp_extract("id", r"^[^:]*:(\d{1,18}):(\d{1,9})$", 0)
    part = lambda n: F.when(at != "", F.split("id", ":")[n])
    return rows.select(F.try_url_decode(part(0)).alias("session"), part(1).cast("long").alias("turn"), part(2).cast("int").alias("seq"), "event", "data")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """parsed() events of the text files that write_events() left under path."""
    return parsed(spark.read.option("lineSep", END).text(path))


def after(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events that follow the last one a reader has seen of a turn: seen has a (session, turn, seq) a row; turns that are not named there are given whole."""
    last = seen.groupBy(F.col("session").cast("string").alias("session"), "turn").agg(F.max("seq").alias("_seen"))
    return events.join(last, ["session", "turn"], "left").where("_seen IS NULL OR seq > _seen").select("session", "turn", "seq", "event", "data")


def answers(events: DataFrame) -> DataFrame:
    """(session, turn, text, chunks, cited, n_events, outcome, whole) of read events: each turn put together again by seq, the only rows that are gathered.

    outcome: done, error, or open where neither has come. whole: nothing is missing or repeated, and the events come in ORDER with one retrieval and one end at most.
    """
    json = F.from_json("data", "text string, chunk_id string, chunk_ids array<string>")
    rank = F.coalesce(*[F.when(F.col("event") == e, n) for n, e in enumerate(ORDER)])
    rows = events.where("session IS NOT NULL").select("session", "turn", "seq", rank.alias("rank"), json.alias("j"))
    turns = rows.groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "rank", "j"))).alias("e"))
    of = lambda kind: F.filter("e", lambda x: x["rank"] == ORDER.index(kind))
    ranks, ends = F.transform("e", lambda x: x["rank"]), F.filter("e", lambda x: x["rank"] >= ORDER.index("done"))
    unbroken = F.transform("e", lambda x: x["seq"]) == F.sequence(F.lit(0), F.size("e") - 1)
    whole = unbroken & ~F.exists(ranks, lambda r: r.isNull()) & (ranks == F.array_sort(ranks)) & (F.size(of("retrieval")) <= 1) & (F.size(ends) <= 1)
    return turns.select(
        "session",
        "turn",
        F.array_join(F.transform(of("token"), lambda x: x["j"]["text"]), "").alias("text"),
        F.flatten(F.transform(of("retrieval"), lambda x: x["j"]["chunk_ids"])).alias("chunks"),
        F.transform(of("citation"), lambda x: x["j"]["chunk_id"]).alias("cited"),
        F.size("e").alias("n_events"),
        F.when(F.size(of("error")) > 0, "error").when(F.size(of("done")) > 0, "done").otherwise("open").alias("outcome"),
        F.coalesce(whole, F.lit(False)).alias("whole"),
    )
