"""Token ids of whole texts by a vocabulary file of the tokenizers library, at the speed of a table of words.

The tokenizer lower-cases, splits at white space and never merges across a split, so the ids of a text are the ids of its
words one after another. Words are remembered per process. A word of printable Latin-1 is split by the tokenizer's own
pre-tokenization pattern and its pieces go to the tokenizer's model; any other word goes through the whole tokenizer.
The strings of special tokens in a text give special ids, as the library has it by default.
"""

from __future__ import annotations

import array
import functools
import json
import re

from lodestone.llm.base import Memo, claim

#: The pre-tokenization pattern of the vocabulary file, its letter and number classes written out for Latin-1 after
#: lower-casing and composition (fixed values).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+").fullmatch
#: Characters of Latin-1 that are neither white space nor in PLAIN.
BEYOND = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\xad]").search
MARKS = ".,;:!?\"')(]}[{-"
#: The shape of the pattern that PIECES stands for; a file with another goes through the whole tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Words(Memo):
    """A run of text without white space -> its ids, little-endian. A piece of a run is itself a run of one piece, so runs and
    pieces share the table."""

    def __init__(self, path: str, most_bytes: int):
        from tokenizers import Tokenizer

        super().__init__(self._ids, most_bytes)
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        split = [p.get("pattern", {}).get("Regex") for p in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if PATTERN not in split:
            raise ValueError(f"{path}: only vocabularies with the pattern {PATTERN} are supported")
        self.marks = tuple({t["content"][:2] for t in config["added_tokens"]})
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isprintable() or PLAIN(word):
            # Most words are letters with or without marks behind them.
            letters = word.rstrip(MARKS)
            if letters.isalpha() and (letters is word or not self.marked(word)):
                return self._piece(word.lower()) if len(letters) == len(word) else self[letters.lower()] + self[word[len(letters) :]]
            if not self.marked(word):
                pieces = PIECES.findall(word.lower())
                return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
        return array.array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def marked(self, text: str) -> bool:
        """Whether the text may hold the string of a special token."""
        for mark in self.marks:
            if mark in text:
                return True
        return False


SPACES = re.compile(r"[ \t\n\v\f\r]+")
#: Bytes of the table of words: every other word of a text is a rare one, and each costs some microseconds.
WORD_BYTES = 64 << 20
#: Separators to str.split() that are no white space to the tokenizer.
NO_SPACES = "\x1c\x1d\x1e\x1f"


@functools.cache
def _words(path: str, most_bytes: int) -> _Words:
    return _Words(path, most_bytes)


def words(path: str, most_bytes: int = WORD_BYTES) -> _Words:
    """The table of a vocabulary file; most_bytes bounds it, and changes speed and memory only. Called once
    a task: the tables of other operators are emptied."""
    found = _words(path, most_bytes)
    claim(found)
    return found


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(text: str) -> bool:
    """Whether the text is Latin-1 of which PIECES knows every character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not BEYOND(text)


def encode(text: str | None, known: _Words) -> bytes:
    """Ids of the whole text as little-endian unsigned 32-bit integers.

    Plain Latin-1 texts are cut into pieces as they are, of which there are fewer different ones than runs. Where letters beyond
    Latin-1 or strings of special tokens are about, runs are looked up, and the tokenizer itself takes those it has to."""
    text = text or ""
    if _plain(text) and not known.marked(text):
        return b"".join(map(known.__getitem__, PIECES.findall(text.lower())))
    split = SPACES.split(text) if any(c in text for c in NO_SPACES) else text.split()
    return b"".join(map(known.__getitem__, split))
