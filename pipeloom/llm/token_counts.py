"""Token counts by a compiled finite-state transducer.

The vocabulary is a BPE with word ends: a text is put in NFC, white space is folded,
letters are lower-cased, a pattern cuts it into words, and the merges turn each word's
bytes, the last one marked as its end, into tokens.

The merges are compiled into a deterministic transducer. It rests on a property of BPE:
the encoding of a prefix is the encoding of a shorter prefix and one more token, and a
sequence of tokens is an encoding if and only if every two neighbours are. A state holds,
for each position from which a token may still be under way, the trie node reached since,
the last token before it, and how many tokens fewer than now had been emitted there. A
transition on a byte gives the next state and the (net) number of emitted tokens; so does
the one on a byte that ends the word. States and transitions are made when first needed
and kept, as many as a bound allows, like a lazy DFA of a pattern matcher.

The bytes of a text's words are cut into chunks of PIECE, at any byte. A chunk that begins
within a word has a map over several states, {state before: (state after, emitted tokens)}: over the
start state and those that the last bytes before the cut lead to from places of their own. A word's end
leads back to the start state, so what follows the first end in a chunk counts the same for all of
them. Maps compose by ``scan``, a parallel prefix in log2 steps; a state that a map should need but
doesn't have is run then, so counts are exact whatever was guessed.

Defined results: null and empty texts have no bytes and no tokens; the strings of special
tokens count as one token each, as the library takes them by default; rows are counted
each on its own; an empty table gives an empty table. Texts count whole, of any length: each is one step of
one task, a word of any length runs chunk by chunk. Only doc_id and text are looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
_END = "</w>"
_STATES, _WORDS = 400_000, 500_000
PIECE = 1024  # bytes of a chunk
BEHIND = 8  # bytes before a cut that its states are guessed from
#: The pattern of the vocabulary file, and the same for ASCII texts.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        letters = _byte_letters()
        self.inner = [vocab[x] for x in letters]  # token of a byte within a word, and at its end
        self.last = [vocab[x + _END] for x in letters]
        byte_of = {x: b for b, x in enumerate(letters)}
        self.symbols: dict[int, tuple[int, ...]] = {}
        #: Trie of all tokens over bytes: node -> {byte: node}; tokens by node, those at a word's end apart.
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.final: list[dict[int, int]] = [{}]
        for text, t in vocab.items():
            ends = text.endswith(_END) and text != _END
            data = [byte_of[x] for x in (text[: -len(_END)] if ends else text) if x in byte_of]
            if not data or len(data) != len(text) - ends * len(_END):
                continue
            node = 0
            for b in data[: len(data) - ends]:
                node = self.trie[node].setdefault(b, len(self.trie))
                if node == len(self.token):
                    self.trie.append({}), self.token.append(-1), self.final.append({})
            if ends:
                self.final[node][data[-1]] = t
            else:
                self.token[node] = t
            self.symbols[t] = tuple([*[self.inner[b] for b in data[: len(data) - ends]], *[self.last[data[-1]]] * ends])
        self.reset()
        self.fits: dict[tuple[int, int], bool] = {}

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.ends: list[dict[int, int]] = [{}]

    def encode(self, symbols: list[int]) -> list[int]:
        """Plain BPE, for two neighbouring tokens at a time."""
        while len(symbols) > 1:
            found = [(r[0], i, r[1]) for i in range(len(symbols) - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1])))]
            if not found:
                break
            _, i, t = min(found)
            symbols = [*symbols[:i], t, *symbols[i + 2 :]]
        return symbols

    def fit(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        if a < 0:
            return self.encode(list(self.symbols[b])) == [b]
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 4_000_000:
                self.fits.clear()
            ok = self.fits[a, b] = self.encode([*self.symbols[a], *self.symbols[b]]) == [a, b]
        return ok

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and emitted tokens for a byte that doesn't end the word."""
        moved, token, count = [], -1, 0
        for node, before, less in self.states[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            moved.append((child, before, less))
            t = self.token[child]
            if token < 0 and t >= 0 and self.fit(before, t):
                token, count = t, 1 - less
        if token < 0:
            raise ValueError(f"byte {byte} has no token")
        key = (*[(c, b, x + count) for c, b, x in moved if self.trie[c] or self.final[c]], (0, token, 0))
        to = self.ids.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key), self.next.append({}), self.ends.append({})
        self.next[state][byte] = (to, count)
        return to, count

    def end(self, state: int, byte: int) -> int:
        """Emitted tokens for the byte that ends the word."""
        for node, before, less in self.states[state]:
            t = self.final[node].get(byte)
            if t is not None and self.fit(before, t):
                self.ends[state][byte] = 1 - less
                return 1 - less
        raise ValueError(f"byte {byte} has no token at a word's end")

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """State and tokens after bytes within a word."""
        total, table = 0, self.next
        for b in data:
            to = table[state].get(b) or self.step(state, b)
            state = to[0]
            total += to[1]
        return state, total

    def count(self, word: str) -> int:
        """Tokens of a word."""
        data = word.encode()
        state, total = self.run(data[:-1])
        n = self.ends[state].get(data[-1])
        return total + (self.end(state, data[-1]) if n is None else n)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Words of a text and the number of special tokens in it."""
        if not any(s in text for s in self.specials):
            return _pieces(text), 0
        parts = re.split("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))), text)
        return [w for p in parts for w in _pieces(p)], len(parts) - 1


def _pieces(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower()) if "\x1c" > max(text, default="") or not re.search("[\x1c-\x1f]", text) else _PIECES.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    lower = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # the library lowers each letter by itself
    return _PIECES.findall(lower)


Map = dict[int, tuple[int, int]]


class Chunk:
    """Bytes of words side by side: the rest of a word that began before (if any), whole words, and the begin of one that goes on (if any)."""

    def __init__(self, machine: Transducer, rest: bytes | None, ends: bool, count: int, begin: bytes) -> None:
        self.machine, self.rest, self.ends, self.count, self.begin = machine, rest, ends, count, begin
        self.known: Map = {}

    def of(self, state: int) -> tuple[int, int]:
        """State after the chunk and tokens emitted in it, from a state before it."""
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self._run(state)
        return found

    def _run(self, state: int) -> tuple[int, int]:
        run, n = self.machine.run, 0
        if self.rest is not None:
            if not self.ends:
                return run(self.rest, state)
            state, n = run(self.rest[:-1], state)
            last = self.machine.ends[state].get(self.rest[-1])
            n += self.machine.end(state, self.rest[-1]) if last is None else last
        state, more = run(self.begin)
        return state, n + self.count + more


def chunks_of(words: list[str], counts: _Counts, size: int) -> list[Chunk]:
    """The words' bytes in chunks of so many (the last one of fewer), each with its map over the states guessed for it."""
    machine, out = counts.machine, []
    guesses = {0}

    def close(rest: bytes | None, ends: bool, n: int, begin: bytes) -> None:
        nonlocal guesses
        out.append(Chunk(machine, rest, ends, n, begin))
        for g in guesses:
            out[-1].of(g)
        before = begin or (b"" if ends or rest is None else rest)  # of a word that goes on
        guesses = {0, *(machine.run(before[-k:])[0] for k in range(1, min(BEHIND, len(before)) + 1))}

    rest: bytes | None = None  # of the word that was cut last
    n, room = 0, size
    for word in words:
        data = word.encode()
        if len(data) <= room:
            n += counts[word]
            room -= len(data)
            continue
        close(rest, True, n, data[:room])
        at = room
        while len(data) - at > size:
            close(data[at : at + size], False, 0, b"")
            at += size
        rest, n, room = data[at:], 0, size - (len(data) - at)
    close(rest, True, n, b"")
    return out


def scan(chunks: list[Chunk]) -> list[Map]:
    """Prefix composition of chunk maps from the start state, in log2(len) steps that each could run in parallel."""
    maps: list[Map] = [dict(c.known) for c in chunks]
    first = [0] * len(chunks)  # the first chunk that each map covers

    def through(i: int, lo: int, state: int, n: int) -> tuple[int, int]:
        """From a state before chunk lo through chunk i, a chunk at a time: for states that no map has."""
        for c in chunks[lo : i + 1]:
            state, more = c.of(state)
            n += more
        return state, n

    first = list(range(len(chunks)))
    width = 1
    while width < len(maps):
        joined: list[Map] = list(maps)
        for i in range(width, len(maps)):
            own = maps[i]
            joined[i] = {s: (own[t][0], n + own[t][1]) if t in own else through(i, first[i], t, n) for s, (t, n) in maps[i - width].items()}
        first = [first[i - width] if i >= width else first[i] for i in range(len(maps))]
        maps, width = joined, 2 * width
    return maps


class _Counts(dict):
    """Tokens of each word, kept for as many words as the bound allows."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word)
        if len(word) < 64:
            if len(self) > _WORDS:
                self.clear()
            self[word] = n
        return n


_machines: dict[str, _Counts] = {}


def counter(path: str) -> _Counts:
    """The compiled machine of a vocabulary file, made once in each process."""
    if path not in _machines:
        _machines[path] = _Counts(Transducer(path))
    return _machines[path]


def n_tokens(text: str, counts: _Counts) -> int:
    if len(counts.machine.states) > _STATES:
        counts.machine.reset()
    words, specials = counts.machine.pieces(text)
    return specials + scan(chunks_of(words, counts, PIECE))[-1][0][1]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. path: of the vocabulary on every machine; None: that of the installed package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path or vocabulary_path())
        for b in batches:
            texts = b.column("text")
            tokens = [n_tokens(t, counts) if (t := x.as_py()) else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
