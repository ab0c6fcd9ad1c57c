"""Sessions, citations, replay, prompt costs, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions import text as T

RECENT = 6


def session_previews(messages: DataFrame) -> DataFrame:
    """(session, preview, n_messages): the earliest user message, cut to 80 characters; null without one."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "content")))["content"]
    return messages.groupBy("session").agg(T.preview(first).alias("preview"), F.count("*").alias("n_messages"))


def recent(messages: DataFrame, n: int = RECENT) -> DataFrame:
    """Each session's last n messages with their place, oldest first."""
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.col("turn").desc(), F.col("content").desc()))
    rows = messages.withColumn("back", back).where(F.col("back") <= n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.col("back").desc()))).drop("back")


def with_question(messages: DataFrame) -> DataFrame:
    """Assistant messages with the user message before them (strictly earlier; '' without one)."""
    earlier = Window.partitionBy("session").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    asked = F.max(F.when(F.col("role") == "user", F.struct("turn", "content"))).over(earlier)["content"]
    return messages.withColumn("question", F.coalesce(asked, F.lit(""))).where(F.col("role") == "assistant")


def prompt_costs(messages: DataFrame) -> DataFrame:
    """(session, turn, tokens_in, tokens_out, cost) of each assistant message, its question as the input."""
    rows = with_question(messages).select("session", "turn", scalars.estimate_tokens(F.col("question")).alias("tokens_in"), scalars.estimate_tokens(F.col("content")).alias("tokens_out"))
    return rows.withColumn("cost", scalars.token_cost(F.col("tokens_in"), F.col("tokens_out")))


def citations(messages: DataFrame, allowed: Column) -> DataFrame:
    """(session, turn, chunk, place): ids that markers name and allowed (an array) holds, in order of first appearance."""
    ids = F.filter(T.citation_ids(F.col("content")), lambda x: F.array_contains(allowed, x))
    rows = messages.select("session", "turn", F.posexplode(ids).alias("place", "chunk"))
    return rows.select("session", "turn", "chunk", (F.col("place") + 1).alias("place"))


def export_numbers(cited: DataFrame) -> DataFrame:
    """(session, chunk, number): numbers by first appearance over a whole session, for the sources of an export."""
    first = cited.groupBy("session", "chunk").agg(F.min(F.struct("turn", "place")).alias("seen"))
    return first.select("session", "chunk", F.row_number().over(Window.partitionBy("session").orderBy("seen")).alias("number"))


def replay(cited: DataFrame, owner: DataFrame, sealed_owner: DataFrame) -> DataFrame:
    """(session, turn, documents): documents behind each message, open chunks first, else sealed ones; unknown ids drop out, and messages without any too."""
    open_ = owner.select("chunk", F.col("document").alias("d1"))
    hidden = sealed_owner.select("chunk", F.col("document").alias("d2")).join(open_.select("chunk"), "chunk", "left_anti")
    rows = cited.join(open_, "chunk", "left").join(hidden, "chunk", "left").withColumn("document", F.coalesce("d1", "d2"))
    return rows.where(F.col("document").isNotNull()).groupBy("session", "turn").agg(F.array_sort(F.collect_set("document")).alias("documents"))


def answer_segments(messages: DataFrame) -> DataFrame:
    """(session, turn, pos, kind, body): an answer's text and citations in order; a marker of several ids gives one citation each."""
    mark = T.CHUNK_MARK
    parts = F.arrays_zip(F.split("content", mark).alias("text"), F.transform(F.regexp_extract_all("content", F.lit(mark), F.lit(1)), lambda x: T.marker_ids(x)).alias("ids"))
    piece = lambda p: F.concat(
        F.when(F.coalesce(p["text"], F.lit("")) != "", F.array(F.struct(F.lit("text").alias("kind"), p["text"].alias("body")))).otherwise(F.array().cast("array<struct<kind:string,body:string>>")),
        F.transform(F.coalesce(p["ids"], F.array().cast("array<string>")), lambda i: F.struct(F.lit("citation").alias("kind"), i.alias("body"))),
    )
    rows = messages.select("session", "turn", F.posexplode(F.flatten(F.transform(parts, piece))).alias("pos", "s"))
    return rows.select("session", "turn", "pos", F.col("s.kind").alias("kind"), F.col("s.body").alias("body"))


def instructions(chunks: DataFrame, titles: DataFrame | None, header: str, none: str = "No relevant context was found for this question.") -> DataFrame:
    """(qid, prompt): header, then sources in order of their best chunk, each with its title and its chunks; without titles the chunks alone, in order.

    chunks: (qid, position, chunk, document, content), a null chunk where a question has none; titles: (document, title).
    """
    block = F.concat(F.lit("[[chunk:"), F.col("chunk").cast("string"), F.lit("]]\n"), F.col("content"))
    listed = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("position", block.alias("body")))))
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n")
    if titles is None:
        out = chunks.groupBy("qid").agg(listed.alias("parts"))
    else:
        named = chunks.join(titles.select("document", "title"), "document", "left").withColumn("title", F.coalesce("title", F.lit("Untitled document")))
        sources = named.groupBy("qid", "document").agg(F.min("position").alias("first"), F.first("title").alias("title"), listed.alias("parts"))
        section = F.concat(F.lit('### Source: "'), F.col("title"), F.lit('"\n'), joined(F.col("parts")))
        out = sources.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.size("parts") > 0, F.struct("first", section.alias("body"))))).alias("parts"))
    body = F.when(F.size("parts") > 0, joined(F.col("parts"))).otherwise(none)
    return out.select("qid", F.concat(F.lit(header + "\n\n"), body).alias("prompt"))


ITEMS = "struct<items: array<struct<title: string, description: string, source_chunk_id: string>>>"


def action_items(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document, place, title, description, chunk): to-dos of models' answers (document, raw), from the first brace to the last; without a title or with a chunk that is not the document's they drop out. chunks: (document, chunk)."""
    body = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    rows = answers.select("document", F.posexplode(F.from_json(body, ITEMS)["items"]).alias("place", "i"))
    rows = rows.select("document", "place", F.col("i.title").alias("title"), F.coalesce("i.description", F.lit("")).alias("description"), F.col("i.source_chunk_id").alias("chunk"))
    own = chunks.select("document", F.col("chunk").cast("string").alias("chunk")).distinct()
    return rows.where(F.coalesce("title", F.lit("")) != "").join(own, ["document", "chunk"], "left_semi").select("document", "place", "title", "description", "chunk")


def sse_text(line: Column) -> Column:
    """The text of one line of an event stream, if it is a text delta; else null."""
    payload = F.trim(F.substring(line, 6, 1 << 30))
    event = F.from_json(payload, "event_type string, delta struct<type: string, text: string>")
    good = line.startswith("data:") & (payload != "") & (payload != "[DONE]") & (event["event_type"] == "step.delta") & (event["delta"]["type"] == "text")
    return F.when(good, F.nullif(event["delta"]["text"], F.lit("")))


def export_markdown(messages: DataFrame, cited: DataFrame, titles: DataFrame, speakers: tuple[str, str] = ("You", "Assistant"), head: str = "Chat") -> DataFrame:
    """(session, markdown): a conversation under headings of who speaks, with numbered citations and its sources at the end.

    cited: as citations() gives; titles: (chunk, title). Numbers go by first appearance over the session; markers without a source vanish.
    """
    numbers = export_numbers(cited)
    by_session = numbers.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "number"))).alias("numbers"))
    rows = messages.join(by_session, "session", "left")
    parts = F.arrays_zip(F.split("content", T.CHUNK_MARK).alias("text"), F.transform(F.regexp_extract_all("content", F.lit(T.CHUNK_MARK), F.lit(1)), lambda x: T.marker_ids(x)).alias("ids"))
    known = lambda ids: F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.element_at("numbers", i)), lambda n: n.isNotNull())
    piece = lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.array_join(F.transform(known(p["ids"]), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    body = F.regexp_replace(F.array_join(F.transform(parts, piece), ""), r"^\s+|\s+$", "")
    who = F.when(F.col("role") == "user", speakers[0]).otherwise(speakers[1])
    said = rows.select("session", "turn", F.concat(F.lit("## "), who, F.lit("\n"), body, F.lit("\n")).alias("said"))
    talk = said.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda m: m["said"]), "\n").alias("talk"))
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]: "), F.coalesce("title", F.lit("Untitled document")))
    foot = numbers.join(titles.select("chunk", "title"), "chunk", "left").groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda m: m["line"]), "\n").alias("foot"))
    sources = F.coalesce(F.concat(F.lit("\n---\n\n**Sources**\n\n"), F.col("foot")), F.lit(""))
    return talk.join(foot, "session", "left").select("session", F.concat(F.lit(f"# {head}\n\n"), F.col("talk"), sources).alias("markdown"))
