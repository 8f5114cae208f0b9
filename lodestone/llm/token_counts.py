"""Greedy word-piece lengths by a linear longest-match automaton (operator 10).

The vocabulary is a trie. Each node has a failure link and the number of tokens popped when it is followed: where the text so far
can't be continued from a node, the tokens that greedy longest-match-first would have emitted are counted and reading goes
on from what is left, without reading a character twice or building a piece. A word costs time linear in its length.

Pieces are the entries of a tokenizer's vocabulary file, without their mark of a word's end: with it, the longest match at the
end of a word often leaves a bare mark that no piece covers. Words are what the file's own normalizer and pre-tokenizer
make of the text; counts of words are remembered per process. A word that no pieces cover is one unknown token.

Defined results: null and empty texts have no words and no tokens; strings of special tokens are ordinary text. Rows are counted
one by one and texts whole, however long, so repeated rows and null ids do not matter and nothing ties; with_counts adds one column and keeps the others, one of the same name
excepted, and the query reads doc_id and text alone. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.base import Memo, claim, doc_text, spread, table
from lodestone.llm.encoding import NO_SPACES, PATTERN, PIECES, PLAIN, SPACES, byte_letters, default_vocabulary

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")])


class Automaton:
    """Trie with failure links and popped-token counts. Node 0 starts a word, node rest continues one; pieces that begin with
    the continuation mark hang under the latter (one and the same node where there is no such mark)."""

    NOWHERE = -1

    def __init__(self, pieces: list[str], continuation: str = ""):
        self.next: list[dict[str, int]] = [{}]
        final: list[bool] = [False]
        self.rest = 0
        if continuation:
            self.next.append({})
            final.append(False)
            self.rest = 1
        for piece in pieces:
            at = self.rest if continuation and piece.startswith(continuation) else 0
            body = piece[len(continuation) :] if at else piece
            if not body:
                continue
            for c in body:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = self.next[at][c]
            final[at] = True
        self.fail = [self.NOWHERE] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque({0, self.rest})
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = self.rest, 1
                else:
                    z, count = self.fail[u], self.popped[u]
                    while z != self.NOWHERE and c not in self.next[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z != self.NOWHERE:
                        self.fail[v], self.popped[v] = self.next[z][c], count
                queue.append(v)

    def count(self, word: str) -> int:
        """Tokens of greedy longest-match-first, or -1 where no pieces cover the word."""
        u = tokens = 0
        for c in word:
            while c not in self.next[u]:
                if self.fail[u] == self.NOWHERE:
                    return -1
                tokens += self.popped[u]
                u = self.fail[u]
            u = self.next[u][c]
        while u not in (0, self.rest):
            if self.fail[u] == self.NOWHERE:
                return -1
            tokens += self.popped[u]
            u = self.fail[u]
        return tokens


class _Words(Memo):
    """A run of text without white space -> (words, tokens, unknown words)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._counts)
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        suffix = config["model"].get("end_of_word_suffix") or ""
        special = {t["content"] for t in config["added_tokens"]}
        pieces = sorted({p.removesuffix(suffix) for p in config["model"]["vocab"] if p not in special})
        self.automaton = Automaton(pieces, config["model"].get("continuing_subword_prefix") or "")
        self.plain = any(p.get("pattern", {}).get("Regex") == PATTERN for p in (config["pre_tokenizer"] or {}).get("pretokenizers", []))
        self.letters = byte_letters()
        self.counts = Memo(self.automaton.count)

    def words_of(self, run: str) -> list[str]:
        if self.plain and PLAIN(run):
            return ["".join([self.letters[b] for b in piece.encode()]) for piece in PIECES.findall(run.lower())]
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run))]

    def _counts(self, run: str) -> tuple[int, int, int]:
        counts = [self.counts[w] for w in self.words_of(run)]
        return len(counts), sum(map(abs, counts)), counts.count(-1)


@functools.cache
def known_words(path: str) -> _Words:
    return _Words(path)


def count_text(text: str | None, known: _Words) -> tuple[int, int, int]:
    text = text or ""
    runs = SPACES.split(text.strip(" \t\n\v\f\r")) if any(c in text for c in NO_SPACES) else text.split()
    found = list(map(known.__getitem__, runs)) if runs != [""] else []
    return tuple(map(sum, zip(*found, strict=True))) if found else (0, 0, 0)


def with_counts(docs: DataFrame, vocabulary: str | None = None, into: str = "__counts") -> DataFrame:
    """docs with a struct of n_words, n_tokens and n_unknown for each whole text."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = known_words(path)
        claim(known, known.counts)
        for texts in batches:
            rows = [count_text(t, known) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=COUNTS.names)

    return docs.withColumn(into, F.arrow_udf(count, COUNTS)("text"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(spread(doc_text(table(spark, sf_dir, "documents")))).select("doc_id", "__counts.*")
