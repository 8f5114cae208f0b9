"""Byte-level byte-pair encoding by a file of ranks, and decoding, without performing merges over the text.

A text is split by the vocabulary's pattern, and each match is encoded by itself. A match that is an entry as a whole is that entry. Of any
other, an automaton over the entries, their bytes as Latin-1 letters, gives the longest entry at a place. Entries are then laid from
the left, longest first: an entry may follow another if merging the bytes of the two, by the ranks, gives back just these two; what
merging says of a pair is remembered. Where none may follow, the last one laid is taken back and the next shorter one tried, and the place
is marked, as no other way leads there: the merges of a prefix have one last entry. So each place is left for good at
most once, and the work is linear in the match. Entries that merging their own bytes does not give can only be whole matches.

Defined results: null is an empty text. Empty texts have no ids and decode to no bytes. Strings of special tokens are ordinary text.
Texts are worked on whole, matches of any length included. Rows are handled one by one, so repeated rows and ids stay as they are, nothing
can tie, and an empty table gives an empty one. Columns of any name stay, but for those that the caller names for results. Decoding takes null for no ids, and
an id that the vocabulary lacks is an error."""

from __future__ import annotations

import array
import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lodestone.llm.base import ENTRY_BYTES, LONGEST, Memo, claim, columns_of, doc_text, spread, table

#: Bytes of each of the two tables of matches, and pairs of entries (some 35 MB), that a process remembers.
PIECE_BYTES, PAIRS = 40 << 20, 300_000
#: Rows whose ids are handed on at once.
SLICE_ROWS = 256
#: The letters, numbers and white space of Latin-1 as the pattern's classes have them (fixed values).
LETTERS, NUMBERS, SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
NONE = -1
#: Beyond all ranks.
NEVER = 1 << 40


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def latin(pattern: str) -> str:
    """The pattern for texts of Latin-1, its classes written out, which the faster of two libraries understands."""
    for inside, of in ((r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]"), (r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{NUMBERS}]"), (r"\s", f"[{SPACES}]"), (r"\S", f"[^{SPACES}]")):
        pattern = pattern.replace(inside, of)
    if r"\p" in pattern:
        raise ValueError("only patterns of letters, numbers and white space are supported")
    return pattern


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


def merges(part: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The merges by their definition, for a few bytes: the pair of the lowest rank first, the leftmost of equal ones. The pieces
    left, and the last pair that was merged."""
    pieces, last = [part[k : k + 1] for k in range(len(part))], None
    while len(pieces) > 1:
        rank, at = min((ranks.get(pieces[k] + pieces[k + 1], NEVER), k) for k in range(len(pieces) - 1))
        if rank == NEVER:
            break
        last = pieces[at], pieces[at + 1]
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces, last


class Pairs(dict):
    """left << 32 | right -> whether the right entry may follow the left one, remembered up to a number of pairs."""

    def __init__(self, entries: dict[int, bytes], ranks: dict[bytes, int], parts: dict[int, tuple[int, int]], most: int = PAIRS):
        self.entries, self.ranks, self.parts, self.most = entries, ranks, parts, most

    def __missing__(self, pair: int) -> bool:
        value = self.apart(pair >> 32, pair & 0xFFFFFFFF)
        if len(self) >= self.most:
            self.clear()
        self[pair] = value
        return value

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both never merges across their border. The merges that made the two are taken back, the
        latest first; at each time the pieces that face each other must not merge before the merge just taken back. Of equal ranks the
        leftmost goes first: the left entry's merge before one across, one across before the right entry's."""
        bound = NEVER
        while self.ranks.get(self.entries[left] + self.entries[right], NEVER) >= bound:
            of_left, of_right = self.parts.get(left), self.parts.get(right)
            if of_left and (not of_right or left > right):
                bound, left = left, of_left[1]
            elif of_right:
                bound, right = right + 1, of_right[0]
            else:
                return True
        return False


class Pieces(Memo):
    """A match -> its ids as little-endian 32-bit integers. When the table is full it becomes the former one, in which what is still in
    use is found, instead of being forgotten at once."""

    def __init__(self, make, most_bytes: int = PIECE_BYTES):
        super().__init__(make, most_bytes)
        self.former: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.former.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self.held += ENTRY_BYTES + len(key)
            if self.held > self.most:
                self.former = dict(self)
                self.clear()
                self.held = ENTRY_BYTES + len(key)
            self[key] = value
        return value

    def empty(self) -> None:
        super().empty()
        self.former = {}


class Encoder:
    """The entries of a file of ranks, with what is remembered of texts."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.ranks = read_ranks(path)
        self.entries = {rank: entry for entry, rank in self.ranks.items()}
        self.any, self.latin = regex.compile(pattern), re.compile(latin(pattern))
        reached: dict[str, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for entry, rank in self.ranks.items():
            left, last = merges(entry, self.ranks)
            if left == [entry]:
                reached[entry.decode("latin-1")] = rank
                if last:
                    parts[rank] = self.ranks[last[0]], self.ranks[last[1]]
                    if max(parts[rank]) > rank:
                        raise ValueError(f"{path}: entry {rank} is made of later ones")
        if not all(chr(k) in reached for k in range(256)):
            raise ValueError(f"{path}: a byte has no entry")
        trie = ahocorasick.Automaton()
        for letters, rank in reached.items():
            trie.add_word(letters, rank)
        self.on_path = trie.longest_prefix
        self.most, self.length = max(map(len, reached)), {rank: len(letters) for letters, rank in reached.items()}
        #: The longest entry that a path in the trie begins with, and that an entry begins with, itself left out.
        self.longest: dict[str, int] = {}
        for letters in sorted(reached):
            for n in range(1, len(letters) + 1):
                path_ = letters[:n]
                if path_ not in self.longest:
                    self.longest[path_] = reached.get(path_, self.longest.get(path_[:-1], NONE))
        self.shorter = {rank: self.longest.get(letters[:-1], NONE) for letters, rank in reached.items()}
        self.pairs = Pairs(self.entries, self.ranks, parts)
        self.pieces = Pieces(self._ids)

    def _ids(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return array.array("i", [whole] if whole is not None else self.laid(raw.decode("latin-1"))).tobytes()

    def first(self, letters: str, at: int) -> int:
        """The longest entry at a place: the trie gives the longest path, which may end short of an entry."""
        part = letters[at : at + self.most]
        return self.longest[part[: self.on_path(part)]]

    def laid(self, letters: str) -> list[int]:
        """The ids that merging gives for some bytes, one or more, written as Latin-1 letters."""
        length, shorter, pairs, first = self.length, self.shorter, self.pairs, self.first
        out: list[int] = []
        dead: set[int] = set()
        at, last, entry = 0, NONE, first(letters, 0)
        while True:
            end = at + length[entry]
            while last != NONE and not pairs[last << 32 | entry] or dead and end in dead:
                entry = shorter[entry]
                if entry == NONE:
                    break
                end = at + length[entry]
            if entry != NONE:
                out.append(entry)
                if end == len(letters):
                    return out
                at, last, entry = end, entry, first(letters, end)
            while entry == NONE:
                dead.add(at)
                entry = out.pop()
                at -= length[entry]
                last, entry = out[-1] if out else NONE, shorter[entry]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.findall(text)
        return self.latin.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def opened(path: str, pattern: str) -> Encoder:
    """The encoder of a file; called once a task, as the tables of other operators are emptied."""
    found = encoder(path, pattern)
    claim(found.pieces)
    return found


@functools.cache
def entries(path: str) -> dict[int, bytes]:
    return {rank: entry for entry, rank in read_ranks(path).items()}


def bytes_of(ids: list[int], entries: dict[int, bytes]) -> bytes:
    return b"".join(map(entries.__getitem__, ids))


def encoded(docs: DataFrame, into: str = "ids", back: str | None = None, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with the ids of each text, an array of integers, and where `back` names a column, with the bytes that these ids decode to."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    # The other columns go through as one, whatever they are named.
    named = dict(zip(docs.columns, columns_of(docs), strict=True))
    others = [F.lit(0).alias("none"), *[named[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text]]
    through = docs.select(F.struct(*others).alias("row"), named[text].alias("text"))
    schema = StructType([*through.schema, StructField("ids", ArrayType(IntegerType())), StructField("back", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                raw = [known.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in raw])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
                bytes_ = [bytes_of(memoryview(ids).cast("i").tolist(), known.entries) if back else None for ids in raw]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(bytes_, pa.binary())], names=schema.names)

    found = through.mapInArrow(run, schema)
    rows = [(F.col("text") if c == text else F.col("row").getField(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)]
    return found.select(*rows, F.col("ids").alias(into), *([F.col("back").alias(back)] if back else []))


def decoded(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the bytes that their ids stand for."""
    path = path or default_ranks()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = entries(path)
        for lists in batches:
            yield pa.array([bytes_of(found.values.to_numpy().tolist() if found.is_valid else [], known) for found in lists], pa.binary())

    return rows.withColumn(into, F.arrow_udf(run, "binary")(ids))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encoded(spread(doc_text(table(spark, sf_dir, "documents"))), back="decoded").drop("text")
    comma = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(comma.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
