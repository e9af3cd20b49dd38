"""Pages of keywords, links, menus, tags or product lines instead of sentences.

Method: a page is cut into lines, and lines into pieces at the ends of sentences. Every piece is reduced to a shape of
word counts, capitals, separators and links: what it is mostly made of, how many words it has (in powers of two), how
it is capitalised, and whether it has the closing mark of a sentence. The pieces of a page group by shape. Shapes are
sentences, neutral (logs, forms, record lines, sequences, references) or not sentences; a shape of bare short lines is
none of them by itself and counts as a list only if its group is large. A page is flagged if the `FEW` largest shapes
that aren't sentences hold more than `MORE_THAN` of its characters. There are no word lists: repetition is measured on the
page itself. A page is one row, so the stage is narrow: nothing is shuffled. All patterns are linear in the text.

Defined results: null, empty and blank texts aren't flagged. Whole texts are read. Equal texts get equal answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MORE_THAN = 0.5
#: Shapes that may dominate a flagged page together.
FEW = 4
#: Pieces before and after that count as near.
REACH = 3
#: Bare lines are a list from `LISTED` of them on, or `LISTED_LOW` if half of them begin in lower case, as headings and verses
#: don't; and only if at least half of them have at most `SHORT` words.
SHORT, LISTED, LISTED_LOW = 3, 6, 4
#: The shares of a piece's words and of its word pairs that it or near pieces repeat, from which it is repetition. Of pieces
#: without a closing mark a lower share of pairs is enough.
SAME_WORDS, SAME_PAIRS, OPEN_PAIRS = 0.9, 0.8, 0.5
#: Words of a window and the shares of different ones among them, below which a piece turns in circles: with a closing
#: mark from 8 words on, without one from 5.
WINDOW, CIRCLES, OPEN_CIRCLES = 24, (8, 0.65), (5, 0.68)
#: Copies of closed pieces from so many words on aren't repetition.
WHOLE = 8
#: Words of at most so many letters, of which running text has at least this share.
LITTLE, LITTLE_SHARE = 3, 0.15

LINE = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
CUT = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+|(?<=[。！？])[」』”）]*\s*")
CLOSERS = "\"'”»)]」』）"
ENDS = ".!?。！？…"
HOST = re.compile(r"(?:[\w-]++\.)++[^\W\d_]{2,}+[/?]")
MARKUP = re.compile(r"</?[a-z][a-z0-9]*+(?:\s[^<>]*+)?>")
PRICE = re.compile(r"(?:[$€£¥₽₩₹]|\b[A-Z]{3})\s?\d++[.,]\d\d\b|\b[A-Za-z]{2,7}-\d{2,}+\D{1,12}\d++[.,]\d\d\b")
CENTS = re.compile(r"\d[.,]\d\d\b")
TAG = re.compile(r"#\w")
BULLET = re.compile(r"(?:[-*•·–>]++|\(?\d{1,4}[.):])\s+")
REFERENCE = re.compile(r"\[\d+\]\s")
LOG = re.compile(r"\[?\d{4}[-/]\d\d[-/]\d\d[T ,]+\d\d:\d\d")
FORM = re.compile(r"[^\W\d_][\w ./()-]{0,28}[:：]\s*")
SEQUENCE = re.compile(r"(?:>\S.*|[ACGTUNacgtun]{15,}+\*?|[ACDEFGHIKLMNPQRSTVWYX*]{25,})$")
WORD = re.compile(r"[^\W_]++(?:['’][^\W_]++)*+")
SEPARATOR = re.compile(r"[|/»>•·;,、，；｜►→~_+#]|::|\s[-–—]\s|\s\s")
SENTENCE, NEUTRAL, OTHER, BARE = range(4)


def pieces(text: str) -> Iterator[str]:
    for line in LINE.split(text):
        line = line.strip()
        if not line:
            continue
        if "\t" in line or LOG.match(line) or REFERENCE.match(line):
            yield line
            continue
        at = 0
        bullet = BULLET.match(line)
        for m in CUT.finditer(line, bullet.end() if bullet else 0):
            if m.start() > at:
                yield line[at : m.end()].strip()
                at = m.end()
        if at < len(line):
            yield line[at:]


def is_link(token: str) -> bool:
    """A web address: two slashes before a name, 'www.', or a dotted name with a path."""
    if "//" in token:
        return len(token) > token.index("//") + 2
    if "." not in token:
        return False
    token = token.lstrip("\"'(<[=")
    return token.startswith("www.") or HOST.match(token) is not None


def _repeats(units: list[list]) -> list[float]:
    """Of every piece the share of its words or word pairs that occur before in it, or in the pieces near it."""
    again = [[False] * len(p) for p in units]
    for order in (range(len(units)), range(len(units) - 1, -1, -1)):
        seen: dict = {}
        for i in order:
            flags = again[i]
            for k, unit in enumerate(units[i]):
                last = seen.get(unit)
                if last is not None and (last != i or order.step > 0) and abs(last - i) <= REACH:
                    flags[k] = True
                seen[unit] = i
    return [sum(f) / len(f) if f else 0.0 for f in again]


def _near(shares: list[float]) -> list[bool]:
    """Whether a piece within `REACH` has a share of a half or more, so that its pairs may meet this piece's."""
    out = [False] * len(shares)
    for order in (range(len(shares)), range(len(shares) - 1, -1, -1)):
        last = None
        for i in order:
            if shares[i] >= 0.5:
                last = i
            out[i] = out[i] or (last is not None and abs(last - i) <= REACH)
    return out


def _circles(words: list[str], least: int, share: float) -> bool:
    """Whether few words make up the piece, window by window, so that long texts are judged as short ones."""
    n = len(words)
    if n < least:
        return False
    parts = max(1, n // WINDOW)
    return sum(len(set(words[n * i // parts : n * (i + 1) // parts])) for i in range(parts)) < share * n


def _whole(piece: str, words: list[str]) -> bool:
    """Whether a piece may be a sentence of its own: closed and of some length."""
    return len(words) >= WHOLE and piece.rstrip(CLOSERS)[-1:] in ENDS


def _shape(piece: str, words: list[str], same_words: float, same_pairs: float) -> tuple:
    """(class, what it is made of, words, capitals, closed) of a piece."""
    n, count = len(piece), len(words)
    body = piece.rstrip(CLOSERS)
    closed = body[-1:] in ENDS and body != ""
    size = count.bit_length()
    start = 2 if piece[:1].isupper() else 1 if piece[:1].islower() else 0

    def made(kind: int, of: str) -> tuple:
        return kind, of, size, start, closed

    if piece.count("\t") >= 2:
        return made(NEUTRAL, "record")
    if LOG.match(piece):
        return made(NEUTRAL, "log")
    if REFERENCE.match(piece):
        return made(NEUTRAL, "reference")
    if SEQUENCE.match(piece):
        return made(NEUTRAL, "sequence")
    if "<" in piece:
        marked = sum(map(len, MARKUP.findall(piece)))
        if marked > 0.25 * n or marked and not closed:
            return made(OTHER, "markup")
    if "//" in piece or "/" in piece or "www." in piece:
        links = [t for t in piece.split() if is_link(t)]
        linked = sum(map(len, links))
        if links and (linked > 0.5 * n or (not closed and (len(links) > 1 or linked > 0.25 * n))):
            return made(OTHER, "links")
    if "#" in piece:
        tags = len(TAG.findall(piece))
        if tags and (tags > 1 or count <= 3) and tags * 6 >= count:
            return made(OTHER, "tags")
    if CENTS.search(piece) and len(PRICE.findall(piece)) * 14 >= max(count, 1):
        return made(OTHER, "prices")
    if count >= 2 and same_pairs >= SAME_PAIRS or count >= 3 and same_words >= SAME_WORDS or _circles(words, *(CIRCLES if closed else OPEN_CIRCLES)):
        return made(OTHER, "repetition")
    if not closed and count >= 2 and same_pairs >= OPEN_PAIRS:
        return made(OTHER, "repetition")
    if closed:
        return made(SENTENCE, "sentence")
    bullet = BULLET.match(piece)
    inner = piece[bullet.end() :] if bullet else piece
    form = FORM.match(inner)
    values = inner[form.end() :] if form else inner
    parts = sum(1 for p in SEPARATOR.split(values) if p.strip())
    if parts >= 3 and count <= 6 * parts and not (form and parts < 3):
        return made(OTHER, "list")
    if form:
        return made(NEUTRAL, "form")
    if count >= 9 and start == 1 and parts < 2 and sum(1 for w in words if len(w) <= LITTLE) < LITTLE_SHARE * count:
        return made(OTHER, "keywords")
    if count <= 8:
        return made(BARE, "line")
    return made(SENTENCE, "open")


def page_shapes(text: str | None) -> dict[tuple, int]:
    """shape -> characters of a page."""
    if not text or text.isspace():
        return {}
    copies = Counter(pieces(text))
    page = list(copies)
    words = [WORD.findall(p.lower()) for p in page]
    # sentences that stand on the page several times don't make each other repetition, but copies of anything else do
    if len(page) < copies.total():
        page, words = map(list, zip(*((p, w) for p, w in zip(page, words) for _ in range(1 if _whole(p, w) else copies[p]))))
    total = sum(map(len, words))
    # where most words differ no piece can be repetition, which saves the pairs
    varied = total > 0 and len({w for ws in words for w in ws}) > 0.75 * total
    none = [0.0] * len(page)
    by_word = none if varied else _repeats(words)
    # half of a piece's pairs can't repeat where less than half of its words do
    by_pair = _repeats([list(zip(w, w[1:])) if r >= 0.5 or near else [] for w, r, near in zip(words, by_word, _near(by_word))]) if max(by_word, default=0.0) >= 0.5 else none
    chars: Counter = Counter()
    members: Counter = Counter()
    for piece, own, same_words, same_pairs in zip(page, words, by_word, by_pair):
        shape = _shape(piece, own, same_words, same_pairs)
        n = copies[piece] if _whole(piece, own) else 1
        chars[shape] += n * len(piece)
        members[shape] += n
    out: dict[tuple, int] = {}
    groups = [(shape, n) for shape, n in members.items() if shape[0] == BARE]
    bare = sum(n for _, n in groups)
    low = 2 * sum(n for shape, n in groups if shape[3] == 1) >= bare
    listed = bare >= (LISTED_LOW if low else LISTED) and 2 * sum(n for shape, n in groups if shape[2] <= SHORT.bit_length()) >= bare
    for shape, n in chars.items():
        out[(OTHER if listed else NEUTRAL, *shape[1:]) if shape[0] == BARE else shape] = n
    return out


def is_spam(text: str | None, more_than: float = MORE_THAN, few: int = FEW) -> bool:
    shapes = page_shapes(text)
    largest = sorted((n for shape, n in shapes.items() if shape[0] == OTHER), reverse=True)[:few]
    return sum(largest) > more_than * sum(shapes.values()) if shapes else False


def spam_pages(df: DataFrame, key: str, text: str, more_than: float = MORE_THAN) -> DataFrame:
    """key of every page whose characters are mostly in few shapes that aren't sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([is_spam(t, more_than) for t in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=[key])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}")
