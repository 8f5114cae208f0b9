"""Listwise re-ranking prompts as arrays of (role, content), built per row from a query and its nested candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import passage

MAX_PASSAGE_WORDS = 300

# The wording of the published listwise prompt (fixed values; {n} and {q} stand for the number of passages and the query).
SYSTEM = "You are RankGPT, an intelligent assistant that can rank passages based on their relevancy to the query."
INTRO = "I will provide you with {n} passages, each indicated by number identifier []. \nRank the passages based on their relevance to query: {q}."
INTRO_COMPACT = "I will provide you with {n} passages, each indicated by number identifier [].\nRank the passages based on their relevance to query: {q}.\n\n"
READY = "Okay, please provide the passages."
RECEIVED = "Received passage [{i}]."
FINAL = (
    "Search Query: {q}. \nRank the {n} passages above based on their relevance to the search query. The passages should be listed in descending order using identifiers. "
    "The most relevant passages should be listed first. The output format should be [] > [], e.g., [1] > [2]. Only response the ranking results, do not say any word or explain."
)


def filled(template: str, **columns: Column) -> Column:
    """The template with its names in braces replaced by columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = {k: rest.find("{" + k + "}") for k in columns}
        name, place = min(((k, p) for k, p in at.items() if p >= 0), key=lambda x: x[1], default=(None, len(rest)))
        if place:
            parts.append(F.lit(rest[:place]))
        if name is None:
            break
        parts.append(columns[name])
        rest = rest[place + len(name) + 2 :]
    return F.concat(*parts)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def numbered(docs: Column, max_words: int) -> Column:
    return F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), passage(d["title"], d["text"], max_words)))


def paper_messages(query: Column, docs: Column, max_words: int = MAX_PASSAGE_WORDS) -> Column:
    """System, introduction and reply, a pair of turns for each passage, and the final instruction: 4 + 2 n messages."""
    n = F.size(docs).cast("string")
    turns = F.flatten(F.transform(numbered(docs, max_words), lambda p, i: F.array(message("user", p), message("assistant", filled(RECEIVED, i=(i + 1).cast("string"))))))
    head = F.array(message("system", F.lit(SYSTEM)), message("user", filled(INTRO, n=n, q=query)), message("assistant", F.lit(READY)))
    return F.concat(head, turns, F.array(message("user", filled(FINAL, n=n, q=query))))


def compact_messages(query: Column, docs: Column, max_words: int = MAX_PASSAGE_WORDS) -> Column:
    """System and one user turn that holds all passages."""
    n = F.size(docs).cast("string")
    body = F.concat(filled(INTRO_COMPACT, n=n, q=query), F.array_join(numbered(docs, max_words), "\n\n"), F.lit("\n\n"), filled(FINAL, n=n, q=query))
    return F.array(message("system", F.lit(SYSTEM)), message("user", body))


BUILDERS: dict[str, Callable[..., Column]] = {"paper": paper_messages, "compact": compact_messages}


def builder(name: str) -> Callable[..., Column]:
    if name not in BUILDERS:
        raise KeyError(f"unknown prompt {name!r}; there are {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name]
