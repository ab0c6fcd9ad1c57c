"""Text: tokens, guards, markers, titles, routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a vague question consists of.
GREETINGS = ["hi", "hello", "hey", "help", "anything", "something", "tell me anything", "tell me something", "tell me something interesting"]
GENERIC_WORDS = (
    "please can could you tell me about explain summarize describe it this that these them the document documents file files image images picture pictures "
    "diagram chart table topic topics stuff more what whats is are do does think know talk chat show give a an overview and or everything anything something "
    "interesting random some all my of"
).split()
# What a bare request consists of: perhaps a polite word, then a verb, then perhaps one of the things that name nothing.
POLITE = ["please", "can you", "could you"]
REQUESTS = ["explain", "summarize", "describe", "tell me about", "what is", "whats", "what about", "talk about", "chat about"]
NOTHING = ["it", "this", "that", "these", "them", "anything", "something", "the document", "the file", "the image", "the picture", "my documents", "my files"]
RERANK_CHARS, HISTORY_CHARS, CAPTURE_CHARS = 6000, 3000, 20_000
CHUNK_MARK = r"\[\[chunk:(.+?)\]\]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def phrase_pattern(words: Sequence[str]) -> str:
    """Matches, in lower-case text, neighbouring tokens (see tokens()) that are these words of letters; no list of tokens is made."""
    return r"(?<!\p{L})" + r"\P{L}+".join(words) + r"(?!\p{L})"


def term_count(text: Column, term: str) -> Column:
    """How often a token is the term; null for null."""
    return F.regexp_count(F.lower(text), F.lit(phrase_pattern([term])))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def preview(text: Column, n: int = 80) -> Column:
    """The first n characters, with an ellipsis only if there is more; null stays null."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def capture_title(title: Column, text: Column) -> Column:
    """The title given, unless blank; else the text's first 60 characters."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), preview(F.trim(text), 60))


def explicit_page(query: Column) -> Column:
    """The number of `page 12` or `p. 12`, the first of them; else null."""
    return F.nullif(F.regexp_extract(query, r"(?i)\b(?:page|p\.)\s*(\d{1,6})\b", 1), F.lit("")).cast("int")


def figure_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:figure|fig\.)\s*(\d+)\b"), F.lit(1)))


def use_hypothetical(query: Column) -> Column:
    """Short questions, at most eight words, are worth a hypothetical answer."""
    return F.size(words(query)) <= 8


def _without_first(text: Column, phrases: Sequence[str]) -> Column:
    """What follows the first words, if they are one of the phrases (the longest that fits); else null."""
    follows = lambda p: F.when(text == p, F.lit("")).when(text.startswith(p + " "), F.substring(text, len(p) + 2, 1 << 30))
    return F.coalesce(*[follows(p) for p in sorted(phrases, key=len, reverse=True)])


def bare_request(plain: Column) -> Column:
    """Whether lower-case text without punctuation asks for something, politely or not, and names nothing in particular."""
    asked = _without_first(F.coalesce(_without_first(plain, POLITE), plain), REQUESTS)
    return F.coalesce(asked.isin("", *NOTHING), F.lit(False))


def needs_clarification(query: Column, has_context: Column) -> Column:
    """Punctuation aside, a greeting is vague even with context. Without context so is a question of generic words alone, or a bare request. An empty question is not vague."""
    plain = F.trim(F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", ""))
    left = F.array_except(words(plain), F.array(*[F.lit(w) for w in GENERIC_WORDS]))
    return F.when(plain == "", False).when(plain.isin(GREETINGS), True).when(has_context, False).otherwise((F.size(left) == 0) | bare_request(plain))


def for_rerank(text: Column) -> Column:
    """A document's text as a reranker gets it."""
    return F.substring(text, 1, RERANK_CHARS)


def for_history(text: Column) -> Column:
    """A message as the history of a prompt has it."""
    return F.substring(text, 1, HISTORY_CHARS)


def marker_ids(inner: Column) -> Column:
    """The ids between a marker's brackets: one, or several of the malformed form `a], [chunk:b`; blanks drop out."""
    return F.filter(F.transform(F.split(inner, r"\]\s*,\s*\[chunk:"), lambda x: F.trim(x)), lambda x: x != "")


def citation_ids(text: Column) -> Column:
    """Ids of [[chunk:a]] markers and of malformed [[chunk:a], [chunk:b]] ones, in order, without blanks or repeats."""
    inner = F.regexp_extract_all(text, F.lit(CHUNK_MARK), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inner, lambda x: marker_ids(x))))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CHUNK_MARK, "")


def serialize_evidence(title: Column, heading: Column, page: Column, region: Column, content: Column, caption: Column | None = None) -> Column:
    """Five labelled lines for a reranker; empty counts as missing, and a caption stands in for missing content."""
    given = lambda c: F.nullif(c.cast("string"), F.lit(""))
    line = lambda name, c, default: F.concat(F.lit(f"{name}: "), F.coalesce(given(c), F.lit(default)))
    body = content if caption is None else F.coalesce(given(content), caption)
    return F.concat_ws("\n", line("Document", title, "Untitled"), line("Heading", heading, "Root"), line("Page", page, "n/a"), line("Region", region, "text"), line("Content", body, ""))


def joined_context(parts: list[Column]) -> Column:
    """Distinct non-empty parts in order, a blank line between."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))), "\n\n")


def route_class(path: Column, method: Column) -> Column:
    """A request's rate-limit class, null for what has no limit; the order of the rules matters."""
    return (
        F.when(~path.startswith("/api/v1/"), F.lit(None).cast("string"))
        .when(path.startswith("/api/v1/chat/"), "chat")
        .when(path.rlike("^/api/v1/documents/[^/]+/(seal|unlock|unseal)$"), "seal_unseal")
        .when((path == "/api/v1/documents/upload-init") & (method == "POST"), "upload")
        .when(path.startswith("/api/v1/graph"), "graph")
        .otherwise("general")
    )


def upload_problem(mime: Column, size: Column, title: Column) -> Column:
    """The first rule that an upload breaks, else null."""
    types = ["application/pdf", "image/png", "image/jpeg", "image/webp", "text/plain", "text/markdown"]
    return (
        F.when(~mime.isin(types), "unsupported_mime_type")
        .when(size > 52_428_800, "file_too_large")
        .when(F.length(F.trim(title)) == 0, "empty_title")
        .when(F.length(F.trim(title)) > 500, "title_too_long")
    )


def capture_problem(text: Column, title: Column) -> Column:
    """The first rule that a captured text breaks, else null; a missing title is none."""
    return (
        F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "empty_text")
        .when(F.length(text) > CAPTURE_CHARS, "text_too_long")
        .when(F.length(F.trim(title)) == 0, "empty_title")
        .when(F.length(F.trim(title)) > 500, "title_too_long")
    )


def extraction_source(source: Column, captured: Column, normalised: Column) -> Column:
    """The text that a document's extraction reads: a capture's own, else the normalised file's."""
    return F.when(source == "capture", captured).otherwise(normalised)


def safe_path(path: Column, user: Column, doc: Column) -> Column:
    """A storage path inside user/doc/ without a `..` segment."""
    return path.startswith(F.concat(user, F.lit("/"), doc, F.lit("/"))) & ~F.array_contains(F.split(path, "/"), "..")
