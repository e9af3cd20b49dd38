"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

A token sequence is the merge result of its text exactly if every two neighbours are the merge result of theirs. So the
last token of each prefix of a word is unique: it is the token that ends there and is compatible with the last token of
the prefix before it. The transducer reads bytes and keeps, as its state, only what later bytes can still change: the
token before the last settled boundary and the bytes since. A boundary is settled once the token chains of all
positions at which a vocabulary token may still be under way run through it, so the lookahead is bounded by the longest
token. States and transitions are made when first met and kept (up to a limit, at which the table starts anew).
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import regex

#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters alone, where the standard engine will do.
ASCII_WORDS = r"""(?a:'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+)"""
ID_BYTES = array("i").itemsize
MOST_STATES = 200_000
NEVER = 1 << 60
MOST_WORDS = 300_000


class _State:
    __slots__ = ("active", "back", "bytes", "last", "next", "rest")

    def __init__(self, data: bytes, last: list[int], back: list[int], active: list[int]):
        self.bytes, self.last, self.back, self.active = data, last, back, active
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.rest: tuple[int, ...] | None = None  # output if the word ends here


class Transducer:
    """Words (byte strings without inner pre-token boundary) to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b))}
        self._fits: dict[tuple[int, int], bool] = {}
        self._spines: dict[int, tuple[list, list]] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = _State(b"", [-1], [0], [0])
        self.states = {(-1, b""): self.start}

    def _merge(self, data: bytes, down_to: int = 1) -> list[int]:
        """The defining procedure: merge the neighbours of lowest rank, the leftmost first, until none merge or few parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            pairs = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int) -> tuple[list, list]:
        """The outermost parts of a token on its left and on its right, from the single byte up to itself, each with the rank at which it merges into the next."""
        known = self._spines.get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = ([(data, NEVER)], [(data, NEVER)])
            else:
                first, last = self._merge(data, 2)
                low, high = self._spine(first)[0], self._spine(last)[1]
                known = ([*low[:-1], (low[-1][0], token), (data, NEVER)], [*high[:-1], (high[-1][0], token), (data, NEVER)])
            self._spines[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side in a merge result.

        Merges go by rising rank, as a token's parts have lower ranks than it. So the parts that meet at the boundary are
        followed in that order; the tokens fit unless two of them would merge before either goes into its own token.
        """
        if left < 0:
            return True
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 4 * MOST_STATES:
                self._fits.clear()
            before, after = self._spine(left)[1], self._spine(right)[0]
            i = j = 0
            known = True
            while True:
                (a, a_goes), (b, b_goes) = before[i], after[j]
                across = self.ranks.get(a + b)
                if across is not None and across < a_goes and across <= b_goes:
                    known = False
                    break
                if a_goes == b_goes == NEVER:
                    break
                if a_goes <= b_goes:
                    i += 1
                else:
                    j += 1
            self._fits[left, right] = known
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        data = state.bytes + bytes((byte,))
        n = len(data)
        found, start, active = None, 0, []
        for k in state.active:  # ascending, so the longest token comes first; just one fits
            tail = data[k:]
            if found is None:
                token = self.ranks.get(tail)
                if token is not None and self.fits(state.last[k], token):
                    found, start = token, k
            if tail in self.prefixes:
                active.append(k)
        if found is None:
            raise ValueError("the vocabulary lacks a byte or is not closed under its merges")
        active.append(n)
        last, back = [*state.last, found], [*state.back, start]
        settled = n
        if len(active) > 1:
            open_ = set(active)
            while len(open_) > 1:
                top = max(open_)
                open_.remove(top)
                open_.add(back[top])
            (settled,) = open_
        out, p = [], settled
        while p:
            out.append(last[p])
            p = back[p]
        key = (last[settled], data[settled:])
        then = self.states.get(key)
        if then is None:
            if len(self.states) >= MOST_STATES:
                self._reset()
            then = _State(data[settled:], last[settled:], [max(0, b - settled) for b in back[settled:]], [a - settled for a in active])
            self.states[key] = then
        made = state.next[byte] = (then, tuple(reversed(out)))
        return made

    def encode(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:  # a token is the merge result of its own bytes
            return (whole,)
        state, out = self.start, []
        for byte in word:
            known = state.next.get(byte)
            state, settled = known if known is not None else self._step(state, byte)
            if settled:
                out += settled
        if state.rest is None:
            rest, p = [], len(state.bytes)
            while p:
                rest.append(state.last[p])
                p = state.back[p]
            state.rest = tuple(reversed(rest))
        return (*out, *state.rest)


class _Words(dict):
    """Outputs of whole words as native 32-bit integers, so that frequent words take one lookup; starts anew at its limit."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        ids = array("i", self.transducer.encode(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.transducer = Transducer(ranks)
        self._cut = regex.compile(WORDS).findall
        self._cut_ascii = re.compile(ASCII_WORDS).findall
        self._words = _Words(self.transducer)

    def packed(self, text: str | None) -> bytes:
        """Token ids of a text as native 32-bit integers; of a null or empty text none."""
        if not text:
            return b""
        cut = self._cut_ascii if text.isascii() else self._cut
        return b"".join(map(self._words.__getitem__, cut(text)))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // ID_BYTES


class Utf8Machine:
    """Incremental UTF-8: bytes in, finished characters out; malformed runs become U+FFFD.

    The state is how many continuation bytes are due and the range the next one must lie in.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def _lead(self, b: int) -> str:
        self.low, self.high = 0x80, 0xBF
        if b < 0x80:
            return chr(b)
        if 0xC2 <= b <= 0xDF:
            self.due = 1
        elif 0xE0 <= b <= 0xEF:
            self.due = 2
            self.low, self.high = (0xA0, 0xBF) if b == 0xE0 else (0x80, 0x9F) if b == 0xED else (0x80, 0xBF)
        elif 0xF0 <= b <= 0xF4:
            self.due = 3
            self.low, self.high = (0x90, 0xBF) if b == 0xF0 else (0x80, 0x8F) if b == 0xF4 else (0x80, 0xBF)
        else:
            return "�"
        self.held = bytes((b,))
        return ""

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if not self.due:
                out.append(self._lead(b))
            elif self.low <= b <= self.high:
                self.held += bytes((b,))
                self.due -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.due:
                    out.append(self.held.decode("utf-8"))
            else:
                self.due = 0
                out.append("�")
                out.append(self._lead(b))
        return "".join(out)

    def close(self) -> str:
        due, self.due = self.due, 0
        return "�" if due else ""


class Decoder:
    """Token ids back to text, token by token; whole characters take a table, split ones the state machine."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [b""] * (max(ranks.values()) + 1)
        self.whole: list[str | None] = [None] * len(self.bytes)
        for data, i in ranks.items():
            self.bytes[i] = data
            try:
                self.whole[i] = data.decode("utf-8")
            except UnicodeDecodeError:
                pass

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Machine()
        for i in ids:
            text = self.whole[i] if not machine.due else None
            yield machine.feed(self.bytes[i]) if text is None else text
        yield machine.close()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file with one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_loaded: dict[str, Encoder] = {}


def encoder(path: str, data: Callable[[], bytes] | None = None) -> Encoder:
    """This process's encoder of a vocabulary; Python workers that are used again keep it. data gives the file's bytes where the path can't be read."""
    if path not in _loaded:
        _loaded[path] = Encoder(read_ranks(data() if data else Path(path).read_bytes()))
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """A vocabulary's file in the folder SVLATTICE_TOKENIZERS, by default /opt/tokenizers."""
    return os.path.join(os.environ.get("SVLATTICE_TOKENIZERS", "/opt/tokenizers"), f"{name}.tiktoken")
