"""Finite-state token counting: the BPE vocabulary compiled to a deterministic transducer.

The transducer reads the byte symbols of one pre-token. A state is a set of items: a trie node (the
token that is being read), the token before it, and how many tokens lie behind, relative to the
smallest of the items. A token may follow another only if the merge rules leave the two alone when
their characters are encoded together; exactly one split of each prefix satisfies that for all its
neighbours, so the set is deterministic. Each transition carries the tokens that it emits for
certain (the smallest count moves to the transition); the word's last symbol emits the rest.
States and transitions are compiled when first met and kept.

A pre-token's end resets the transducer, whatever the state. Text is cut into chunks, long pre-tokens between
any two bytes. A chunk's state map gives, for a state at its entry, the state at its exit and the tokens emitted
between: by a constant from its first reset on, before that by a table of entry states. The table is filled ahead
for the state that the bytes before the chunk lead to, and for others when they are met. Maps compose
associatively, and `scan` composes the maps of all chunks of a text as a balanced tree (a parallel prefix scan).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass

import regex

# White space of the vocabulary's normaliser, and its pre-token pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: The pre-token pattern for lower-case Latin-1, which NFC leaves as it is, and what is not of it (or an odd space).
LATIN_PRETOKEN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
NOT_LATIN = re.compile("[\x1c-\x1f\u0100-\U0010ffff]")
SPACE_RUN = re.compile(f"[{SPACES}]+")
#: Python's split() also splits on these, the vocabulary's normaliser does not.
ODD_SPACES = re.compile("[\x1c-\x1f]")
#: Runs and compiled states that a worker keeps before it starts anew.
MEMO_RUNS, MEMO_STATES = 250_000, 200_000
#: Characters of a chunk of text, bytes of a chunk of a pre-token, and the bytes before it that its entry state is guessed from.
CHUNK_CHARS, CHUNK_BYTES, WARM_BYTES = 4096, 1024, 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by the byte-level rule: printable Latin-1 stays, the rest follow from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else spare))
        spare += b not in keep
    return out


def pretokens(text: str) -> list[str]:
    """The normalised pre-tokens of a run without special strings."""
    if not NOT_LATIN.search(text):
        return LATIN_PRETOKEN.findall(text.lower())
    plain = unicodedata.normalize("NFC", text)
    low = plain.lower()
    if "\u03c2" in low:  # the vocabulary's lower-casing knows no final sigma
        low = "".join([c.lower() for c in plain])
    return [w for piece in SPACE_RUN.split(low) for w in PRETOKEN.findall(piece)]


class Transducer:
    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.chunk_chars, self.chunk_bytes = chunk_chars, chunk_bytes
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.mark = os.path.commonprefix(self.special)
        self.symbol = byte_symbols()
        # Tokens as symbol sequences; only those that the merges reach can be emitted.
        made = {a + b for a, b in self.rank}
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str] = [""]
        self.reach: dict[str, bool] = {}
        for t in [*made, *self.symbol, *(s + self.end for s in self.symbol)]:
            node = 0
            for s in self.symbols(t):
                nxt = self.trie[node].get(s)
                if nxt is None:
                    nxt = self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append("")
                node = nxt
            self.token[node] = t
        self.beside: dict[tuple[str, str], bool] = {}
        self.runs: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        start = frozenset({(0, "", 0)})
        self.state_id = {start: 0}
        self.states = [start]
        self.step: dict[int, int] = {}  # state and byte: next state and emitted tokens
        self.last: dict[int, int] = {}  # state and the word's last byte: emitted tokens

    def symbols(self, t: str) -> list[str]:
        """The symbols of a token text; the word's end belongs to its last symbol."""
        if self.end and t.endswith(self.end) and len(t) > len(self.end):
            body = t[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(t)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge rules applied in rank order."""
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            pair = (symbols[best[1]], symbols[best[1] + 1])
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def follows(self, a: str, b: str) -> bool:
        """b can stand after a in an encoding (a empty: b can begin one)."""
        found = self.beside.get((a, b))
        if found is None:
            found = self.merged(self.symbols(a) + self.symbols(b)) == ([a, b] if a else [b])
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            self.beside[a, b] = found
        return found

    def advance(self, state: frozenset, s: str) -> tuple[list[tuple[int, str, int]], str, int]:
        """The items after s, the token that then ends the prefix, and the tokens up to its end."""
        items, ended, count = [], "", -1
        for node, before, behind in state:
            nxt = self.trie[node].get(s)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t and count < 0 and self.follows(before, t):
                ended, count = t, behind + 1
            items.append((nxt, before, behind))
        return items, ended, count

    def compile_step(self, i: int, b: int) -> int:
        items, ended, count = self.advance(self.states[i], self.symbol[b])
        items = [x for x in items if self.trie[x[0]]] + [(0, ended, count)]
        emitted = min([x[2] for x in items])
        state = frozenset([(n, t, c - emitted) for n, t, c in items])
        j = self.state_id.setdefault(state, len(self.states))
        if j == len(self.states):
            self.states.append(state)
        self.step[i << 8 | b] = j << 8 | emitted
        return j << 8 | emitted

    def walk(self, i: int, data: bytes) -> tuple[int, int]:
        """The state after reading data from state i, and the tokens emitted."""
        step, total = self.step, 0
        for b in data:
            t = step.get(i << 8 | b)
            if t is None:
                t = self.compile_step(i, b)
            i = t >> 8
            total += t & 255
        return i, total

    def finish(self, i: int, data: bytes) -> int:
        """The tokens emitted from state i to the end of a pre-token of which data is the rest."""
        i, total = self.walk(i, data[:-1])
        key = i << 8 | data[-1]
        final = self.last.get(key)
        if final is None:
            final = self.last[key] = self.advance(self.states[i], self.symbol[data[-1]] + self.end)[2]
        return total + final

    def chunk(self, before: bytes, data: bytes, ends: bool) -> StateMap:
        """The state map of some bytes of a pre-token; ends: they are its last; before: those before them."""
        guess = self.walk(0, before)[0]
        m = StateMap(data, ends, 0, 0, {})
        self.applied(m, guess)
        return m

    def applied(self, m: StateMap, i: int) -> tuple[int, int]:
        """Exit state and tokens emitted for entry state i."""
        found = m.table.get(i)
        if found is None:
            found = (m.exit, self.finish(i, m.head) + m.count if m.head else m.count) if m.resets else self.walk(i, m.head)
            m.table[i] = found
        return found

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.resets:
            state, count = self.applied(b, a.exit)
            return StateMap(a.head, True, a.count + count, state, {i: (state, n + count) for i, (_, n) in a.table.items()})
        table = {}
        for i, (j, n) in a.table.items():
            k, more = self.applied(b, j)
            table[i] = (k, n + more)
        return StateMap(a.head + b.head, b.resets, b.count, b.exit, table)

    def scan(self, maps: list[StateMap]) -> StateMap:
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def word(self, text: str) -> int:
        """Tokens of one pre-token."""
        data, size = text.encode("utf-8"), self.chunk_bytes
        cuts = range(0, len(data), size)
        total = self.applied(self.scan([self.chunk(data[max(0, i - WARM_BYTES) : i], data[i : i + size], i + size >= len(data)) for i in cuts]), 0)[1]
        if len(self.states) > MEMO_STATES:
            self.restart()
        if len(text) <= 32:
            if len(self.words) > MEMO_RUNS:
                self.words.clear()
            self.words[text] = total
        return total

    def run(self, text: str) -> int:
        """Tokens of a run of text without white space."""
        found = self.runs.get(text)
        if found is None:
            parts = self.special_re.split(text) if self.mark in text else [text]
            found, words = len(parts) - 1, self.words
            for part in parts:
                for w in pretokens(part):
                    n = words.get(w)
                    found += self.word(w) if n is None else n
            if len(self.runs) > MEMO_RUNS:
                self.runs.clear()
            if len(text) <= 64:
                self.runs[text] = found
        return found

    def chunks(self, text: str) -> list[StateMap]:
        """The state maps of a text's chunks, cut at white space: each of them resets."""
        runs = [x for x in SPACE_RUN.split(text) if x] if ODD_SPACES.search(text) else text.split()
        get, run = self.runs.get, self.run
        out, total, chars = [], 0, 0
        for x in runs:
            n = get(x)
            total += run(x) if n is None else n
            chars += len(x) + 1
            if chars >= self.chunk_chars:
                out.append(StateMap(b"", True, total, 0, {}))
                total = chars = 0
        out.append(StateMap(b"", True, total, 0, {}))
        return out

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.applied(self.scan(self.chunks(text)), 0)[1]


@dataclass(frozen=True)
class StateMap:
    """What a chunk does: head: bytes read in the entry state; resets: a pre-token ends in it, the first one after head; count, exit: tokens after that and the state at the end; table: exit state and tokens of entry states met."""

    head: bytes
    resets: bool
    count: int
    exit: int
    table: dict[int, tuple[int, int]]
