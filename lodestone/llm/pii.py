"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 1).

The four base kinds (email, ip, card, phone) are found by their patterns in the whole text, leftmost and non-overlapping per
kind. The random field adds spans that no pattern has: it scores whole candidate segments of up to 16 tokens by features of
the segment as a whole (shape, digits, Luhn, key words before it, what touches it), and one dynamic program over
the tokens chooses boundaries and types together. Base spans are kept as they are; the field's spans never overlap them.

A token outside all spans scores 0, so segments that score no more can be left out of the lattice. Whether those without an
anchor (a digit, an @, the letters "dot", a word of LONG_RUN characters) score above 0 is read off the trained weights: the
best that their features can add up to is a bound (prunable). Where it holds, and with these weights it does, the lattice has only
segments with an anchor and runs in windows that contain them whole; else it runs over the whole text. Either way the spans are those
of one lattice over the whole text.

The field is trained here, by gradient ascent on the likelihood of sentences written by a seeded generator; it takes
some seconds once a process.

Defined results: a null or empty text has no spans. Rows are judged one by one, so null and repeated ids do not matter.
Texts are worked on whole, however long. Of segmentations with equal scores, one without a span wins, then the longer span, then the kind
that is listed first.
Empty tables give empty results. Offsets are code points, ends exclusive. The query reads doc_id and text alone; the stage keeps all
columns whatever their names.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.base import claim, columns_of, free_name, spread, table

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("secret", "iban")
MAX_TOKENS = 16
#: Words on either side of an anchor: more tokens than a segment, the cue words before it and the neighbours of its ends.
WINDOW = MAX_TOKENS + 8
LONG_RUN = 16
LONGEST_ADDRESS = 254

Span = tuple[str, int, int]

IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the local part reaches back to the last match at most, and holds no @ itself."""
    done = at = 0
    while (at := text.find("@", max(at, done))) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at += 1


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


# ---- the random field -------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"\w+|[^\w\s]")
ANCHOR = re.compile(rf"[0-9@]+|\w{{{LONG_RUN},}}|dot|DOT")
#: Runs that may be one secret in several tokens, as unique identifiers are, if they are long. Linear in the text: a match starts where
#: a word does, and gives nothing back.
HYPHENED = re.compile(r"(?<!\w)\w++(?:-\w++)++")
#: Words that announce a kind when they stand within four tokens before a segment (fixed values).
CUES = {
    "email": {"email", "mail", "contact", "write", "e"},
    "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "cell"},
    "secret": {"token", "password", "passwd", "pwd", "secret", "key", "apikey", "bearer", "credential"},
    "iban": {"iban", "account", "bank", "transfer"},
}
HEX = re.compile(r"[0-9a-fA-F]+\Z")
UNIQUE = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
GROUPS = re.compile(r"\(?[0-9]{2,4}\)?(?:[ ./-]?[0-9]{2,4}){1,4}\Z")
SPELLED = re.compile(r"[\w.+-]+ ?[\[(]?(?:at|AT)[\])]? ?[\w-]+(?: ?[\[(]?(?:dot|DOT)[\])]? ?\w+)+\Z")
DOTTED = re.compile(r"[0-9]{1,3}(?: ?(?:\.|dot|[\[(](?:\.|dot)[\])]) ?[0-9]{1,3}){3}\Z")


def iban_holds(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


FEATURES = (
    "bias", "one_token", "many_tokens", "spelled_address", "iban_shape", "iban_holds", "digit_groups", "dotted_numbers", "luhn", "long_number",
    "hex_run", "key_run", "mixed_run", "long_run", "hyphened_run", "unique_shape", "all_letters", "short_digits", "touches_word", "crosses_line", "ends_in_mark", "starts_in_mark", "has_at", "phone_digits", "quoted", "after_equals",
    *(f"cue_{k}" for k in KINDS),
)
PLACE = {name: i for i, name in enumerate(FEATURES)}


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, cues: list[int]) -> list[int]:
    """Features of the segment of tokens i..j-1 as a whole."""
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    names = ["bias", "one_token" if j == i + 1 else "many_tokens"]
    joined = s.replace(" ", "")
    digits = only_digits(s)
    if len(s) <= LONGEST_ADDRESS and ("at" in s or "AT" in s) and ("dot" in s or "DOT" in s) and SPELLED.match(s):
        names.append("spelled_address")
    if "@" in s:
        names.append("has_at")
    if digits:
        if IBAN.match(joined):
            names.append("iban_shape")
            if iban_holds(joined):
                names.append("iban_holds")
        if GROUPS.match(s):
            names.append("digit_groups")
            if 9 <= len(digits) <= 11:
                names.append("phone_digits")
        if DOTTED.match(s) and all(int(p) <= 255 for p in re.findall(r"[0-9]+", s)):
            names.append("dotted_numbers")
        if len(digits) >= 13 and len(digits) <= 19 and digits == re.sub(r"[ ./-]", "", s):
            names.append("long_number")
            if luhn(digits):
                names.append("luhn")
        if len(digits) <= 8 and digits == joined:
            names.append("short_digits")
    if j == i + 1:
        if len(s) >= LONG_RUN:
            names.append("long_run")
            letters = len(s) - len(digits)
            if letters and len(digits) * 8 >= len(s):
                names.append("mixed_run")
                if HEX.match(s):
                    names.append("hex_run")
                if s.isupper() and s.isascii():
                    names.append("key_run")
        if not digits:
            names.append("all_letters")
    elif digits and len(s) >= LONG_RUN and HYPHENED.fullmatch(s) and len(digits) * 8 >= len(s) and any(c.isalpha() for c in s):
        names.append("hyphened_run")
        if UNIQUE.match(s):
            names.append("unique_shape")
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        names.append("touches_word")
    if "\n" in s:
        names.append("crosses_line")
    if not s[-1].isalnum() and s[-1] != ")":
        names.append("ends_in_mark")
    if not s[0].isalnum() and s[0] not in "+(":
        names.append("starts_in_mark")
    if start and end < len(text) and text[start - 1] in "\"'" and text[end] in "\"'":
        names.append("quoted")
    before = text[max(0, start - 3) : start]
    if "=" in before or ":" in before:
        names.append("after_equals")
    return [PLACE[n] for n in names] + cues


def cues_before(lowered: list[str], i: int) -> list[int]:
    near = set(lowered[max(0, i - 4) : i])
    return [PLACE[f"cue_{k}"] for k, words in CUES.items() if near & words]


JOINERS = {"at", "dot", "@"}


def joinable(words: list[str], hyphened: list[bool]) -> list[bool]:
    """Whether a token may be one of several in a segment: digits, marks, capitals with digits (as in account numbers), parts of a
    long hyphened run with digits, and words that stand by an "at", a "dot" or an @, brackets between them or not."""
    n, hinge = len(words), [w == "." or w.lower() in JOINERS for w in words]
    out = []
    for k, w in enumerate(words):
        alone = hyphened[k] or not w.isalnum() or w.isdigit() or w == w.upper()
        beside = hinge[k] or (k > 0 and hinge[k - 1]) or (k + 1 < n and hinge[k + 1])
        beyond = (k > 1 and hinge[k - 2] and words[k - 1] in "[]()") or (k + 2 < n and hinge[k + 2] and words[k + 1] in "[]()")
        out.append(alone or beside or beyond)
    return out


def overlapping(tokens: list[tuple[int, int]], places: list[tuple[int, int]]) -> list[bool]:
    """Which tokens share a character with one of the places; both are sorted, and places don't overlap."""
    out, k = [False] * len(tokens), 0
    for n, (a, b) in enumerate(tokens):
        while k < len(places) and places[k][1] <= a:
            k += 1
        out[n] = k < len(places) and places[k][0] < b
    return out


def lattice(text: str, tokens: list[tuple[int, int]], blocked: list[bool], anchored: list[bool] | None = None) -> list[tuple[int, int, list[int]]]:
    """Candidate segments (first token, end token, features). None holds a blocked token; each starts at a word or an opening
    mark, and those of several tokens hold only such as can be joined. With anchored, each holds an anchored token."""
    words = [text[a:b] for a, b in tokens]
    runs = [m.span() for m in HYPHENED.finditer(text, tokens[0][0], tokens[-1][1]) if m.end() - m.start() >= LONG_RUN and DIGIT.search(m.group())] if tokens else []
    lowered, joins = [w.lower() for w in words], joinable(words, overlapping(tokens, runs))
    out = []
    for i in range(len(tokens)):
        first = text[tokens[i][0]]
        if blocked[i] or not (first.isalnum() or first in "+("):
            continue
        if anchored is not None and not (anchored[i] or joins[i]):
            continue  # it stands alone, and without an anchor
        cues, held = None, anchored is None
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if blocked[j - 1]:
                break
            if j > i + 1 and (tokens[j - 1][0] - tokens[j - 2][1] > 1 or not joins[j - 1] or not joins[i]):
                break  # a gap of more than one character ends every segment
            held = held or anchored[j - 1]
            if held:
                cues = cues_before(lowered, i) if cues is None else cues
                out.append((i, j, segment_features(text, tokens, i, j, cues)))
    return out


def dense(segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
    x = np.zeros((len(segments), len(FEATURES)))
    for row, (_, _, names) in enumerate(segments):
        x[row, names] = 1
    return x


def decode(n: int, segments: list[tuple[int, int, list[int]]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Semi-Markov Viterbi over n tokens: (first token, end token, kind) of the best segmentation."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ends: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, names in segments:
        scores = weights[:, names].sum(axis=1)
        kind = int(scores.argmax())
        if scores[kind] > 0:
            ends.setdefault(j, []).append((i, kind, float(scores[kind])))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, score in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def _generated(rng: random.Random) -> tuple[str, list[Span]]:
    """A sentence with its spans: filler words, entities with or without a cue, and look-alikes that are none."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    run = lambda n, of: "".join(rng.choice(of) for _ in range(n))

    def iban() -> str:
        body, country = number(18), rng.choice(["DE", "FR", "ES", "GB"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        s = f"{country}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def phone() -> str:
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(number(3), number(3), number(4))

    def secret() -> str:
        return rng.choice([lambda: run(rng.choice([18, 32, 40]), "0123456789abcdef"), lambda: "AKIA" + run(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), lambda: run(24, letters + "0123456789" + letters.upper())])()

    def hyphened() -> str:
        some = "0123456789abcdef"
        return rng.choice([lambda: "-".join(run(n, some) for n in (8, 4, 4, 4, 12)), lambda: rng.choice(["sk", "key", "tok", "ghp"]) + "-" + run(20, letters + "0123456789") + rng.choice(["", "-" + run(8, some)])])()

    def spelled() -> str:
        return rng.choice(["{} at {} dot {}", "{}[at]{}[dot]{}", "{} (at) {} (dot) {}"]).format(word(), word(), rng.choice(["com", "org", "net"]))

    parts, spans, at = [], [], 0

    def put(s: str, kind: str | None = None) -> None:
        nonlocal at
        if kind:
            spans.append((kind, at, at + len(s)))
        parts.append(s)
        at += len(s)

    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(2, 5)):
            put(word() + rng.choice(["", "", "", ",", "."]) + " ")
        kind = rng.choice(["secret", "secret", "iban", "phone", "email", "ip", "none", "none"])
        if kind == "secret":
            if rng.random() < 0.75:
                cue, mark = rng.choice(sorted(CUES["secret"])), rng.choice([' = "', "=", ": "])
                put(cue + mark)
                put(rng.choice([secret, secret, secret, hyphened, lambda: run(rng.randint(16, 28), letters), lambda: run(20, letters + letters.upper())])(), kind)
                put('"' if '"' in mark else "")
            else:
                put(rng.choice([secret, secret, hyphened])(), kind)
        elif kind == "phone":
            put(rng.choice(["call ", "phone ", "tel: ", "mobile "]))
            put(phone(), kind)
        elif kind == "email":
            put(rng.choice(["", "mail ", "contact "]))
            put(spelled(), kind)
        elif kind == "ip":
            put(rng.choice(["", "host "]))
            put(rng.choice([".", " . ", "[.]", " dot "]).join(str(rng.randint(0, 255)) for _ in range(4)) if rng.random() < 0.7 else "[.]".join(str(rng.randint(0, 255)) for _ in range(4)), kind)
        elif kind == "iban":
            put(rng.choice(["", "iban ", "account: "]))
            put(iban(), kind)
        elif rng.random() < 0.3:
            # Assigned or announced values that are no secrets: they are short.
            put(rng.choice(sorted(CUES["secret"] | CUES["phone"])) + rng.choice([' = "{}"', "={}", ": {}", ' "{}"']).format(rng.choice([word, lambda: word().upper() + " " + word().upper(), lambda: word().upper() + "-" + word().upper()])()))
        else:
            put(rng.choice([f"{number(4)}-{number(2)}-{number(2)}", f"version {number(1)}.{number(1)}", number(rng.randint(1, 8)), f"{number(3)} {number(3)} {number(4)}", number(16), f"at {word()}", f"{word()} at {word()} {word()}", f"{number(1)}.{number(1)}.{number(2)}", f"$ {number(3)}.{number(2)}", run(rng.randint(16, 24), letters), run(20, letters.upper()), "dot", f"{word()}-{word()}-{word()}-{word()}-{word()}", f"{word()}{word()}-{word()}{word()}-{number(4)}", f"{number(4)}-{number(2)}-{number(2)}-{word()}-{word()}{word()}", f"model {word()}-{number(2)}"]))
        put(rng.choice([" ", ". ", ", ", "\n"]))
    put(word())
    return "".join(parts), spans


def training_set(size: int = 220, seed: int = 11) -> list[tuple[int, list[tuple[int, int, list[int]]], np.ndarray, dict[tuple[int, int], int]]]:
    rng, out = random.Random(seed), []
    while len(out) < size:
        text, spans = _generated(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        segments = lattice(text, tokens, [False] * len(tokens))
        starts, ends = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
        gold = {(starts[a], ends[b]): KINDS.index(k) for k, a, b in spans if a in starts and b in ends}
        if len(gold) == len(spans) and set(gold) <= {(i, j) for i, j, _ in segments}:
            out.append((len(tokens), segments, dense(segments), gold))
    return out


def log_likelihood(n: int, segments, x: np.ndarray, gold, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the gold segmentation and its gradient, by the forward and backward sums of the semi-Markov lattice."""
    scores = x @ weights.T
    total = np.logaddexp.reduce(scores, axis=1)
    first, last = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(segments):
        by_end[j].append(k)
        by_start[i].append(k)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce(np.concatenate([[ahead[j - 1]], ahead[first[by_end[j]]] + total[by_end[j]]])) if by_end[j] else ahead[j - 1]
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce(np.concatenate([[behind[i + 1]], behind[last[by_start[i]]] + total[by_start[i]]])) if by_start[i] else behind[i + 1]
    chance = np.exp(ahead[first][:, None] + scores + behind[last][:, None] - ahead[n])
    wanted = np.zeros_like(scores)
    for k, (i, j, _) in enumerate(segments):
        if (i, j) in gold:
            wanted[k, gold[i, j]] = 1
    return float((wanted * scores).sum() - ahead[n]), (wanted - chance).T @ x


@functools.cache
def trained(rounds: int = 30, rate: float = 0.4, shrink: float = 1e-3, seed: int = 11) -> np.ndarray:
    """Weights (kind, feature), by Adagrad on the training sentences; the same for every process."""
    data, weights = training_set(seed=seed), np.zeros((len(KINDS), len(FEATURES)))
    weights[:, PLACE["bias"]] = -2
    seen = np.full_like(weights, 1e-2)
    for _ in range(rounds):
        for k in range(0, len(data), 20):
            gradient = sum(log_likelihood(*sentence, weights)[1] for sentence in data[k : k + 20]) - shrink * weights
            seen += gradient**2
            weights += rate * gradient / np.sqrt(seen)
    return weights


#: Features that a segment without an anchor can have: of one token, and of several.
PLAIN_FEATURES = ("touches_word", "crosses_line", "ends_in_mark", "starts_in_mark", "quoted", "after_equals", *(f"cue_{k}" for k in KINDS))


def prunable(weights: np.ndarray) -> bool:
    """Whether no segment without an anchor can score above 0. Such a segment has no digit, no @ and no "dot", so it always has the
    features of its first line below, and the most that the others can add is the sum of their positive weights."""
    more = np.maximum(weights[:, [PLACE[n] for n in PLAIN_FEATURES]], 0).sum(axis=1)
    always = (("bias", "one_token", "all_letters"), ("bias", "many_tokens"))
    return all(bool((weights[:, [PLACE[n] for n in names]].sum(axis=1) + more <= 0).all()) for names in always)


def field_spans(text: str, base: list[Span], weights: np.ndarray, pruned: bool | None = None) -> list[Span]:
    """Spans of the random field outside the base spans. pruned is prunable(weights), where it is known."""
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    if pruned is None:
        pruned = prunable(weights)
    anchors = [m.span() for m in ANCHOR.finditer(text)] if pruned else []
    if taken:
        anchors = [place for place, within in zip(anchors, overlapping(anchors, taken), strict=True) if not within]
    out: list[Span] = []
    for lo, hi in windows(text, anchors) if pruned else [(0, len(text))]:
        tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        segments = lattice(text, tokens, overlapping(tokens, taken), overlapping(tokens, anchors) if pruned else None)
        for i, j, kind in decode(len(tokens), segments, weights):
            out.append((KINDS[kind], tokens[i][0], tokens[j - 1][1]))
    return out


def windows(text: str, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """WINDOW words about each anchor, from space to space, those that meet as one. A word is a token at least."""
    if not anchors:
        return
    parts = text.split(" ")
    spaces = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) + np.arange(len(parts))  # the last is the text's end
    places = np.array(anchors)
    first = np.searchsorted(spaces, places[:, 0]) - WINDOW
    starts = np.where(first >= 0, spaces[np.maximum(first, 0)], 0).tolist()
    ends = spaces[np.minimum(np.searchsorted(spaces, places[:, 1]) + WINDOW, len(spaces) - 1)].tolist()
    lo, hi = starts[0], ends[0]
    for start, end in zip(starts, ends, strict=True):
        if start > hi:
            yield lo, hi
            lo = start
        hi = end
    yield lo, hi


def all_spans(text: str | None, weights: np.ndarray, pruned: bool | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind as listed, then by start."""
    text = text or ""
    base = base_spans(text)
    added = field_spans(text, base, weights, pruned)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


FOUND = T.StructType([T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("masked", T.StringType())])


def _found(weights: np.ndarray, with_text: bool):
    pruned = prunable(weights)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim()
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                base, spans = all_spans(text, weights, pruned)
                rows.append((joined(base), joined(spans), masked(text, spans) if with_text and text is not None else None))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=FOUND.names)

    return F.arrow_udf(find, FOUND)


def with_spans(docs: DataFrame, into: str = "__pii", with_text: bool = True) -> DataFrame:
    """docs with a struct of base spans, all spans and, with_text, the masked text."""
    return docs.withColumn(into, _found(trained(), with_text)("text"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), with_text=False).drop("text")

    def count(kind: str) -> Column:
        return F.size(F.filter(F.split("__pii.base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    n_spans = F.when(F.col("__pii.spans") == "", 0).otherwise(F.size(F.split("__pii.spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, n_spans, F.sha2(F.col("__pii.base").cast("binary"), 256).alias("base_sha256"), F.col("__pii.spans").alias("spans"))


def mask_stage(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; n_chars follows. Columns unchanged."""
    into = free_name(docs, "__pii")
    masked_text, kinds = F.col(f"{into}.masked"), dict(docs.dtypes)
    new = {"text": masked_text}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(masked_text.isNull(), F.col("n_chars")).otherwise(F.length(masked_text).cast(kinds["n_chars"]))
    return with_spans(docs, into).select(*[new[c].alias(c) if c in new else kept for c, kept in zip(docs.columns, columns_of(docs), strict=True)])
