"""Token counts by prefix dynamic programming over a word-ended BPE vocabulary.

The tokenizer splits a normalised text into pieces and merges each on its own. `Merges` fills a table for each
piece: entry i is the exact token count of its first i characters as a text. The table needs no encoding of
prefixes: a sequence of tokens is the encoding of its string if and only if each two neighbours stay apart when
they are merged alone, so the last token of every prefix follows from the last tokens of shorter ones. Each
prefix is settled once, in time linear in the piece.

A text's table is its pieces' tables and the running count at their ends. It gives the count of any prefix and the
longest prefix within a budget; nothing is encoded again. The query reads counts from the tables' ends, for which
filling a table stops at the token that ends the piece, and cuts at the limit from the whole table of the piece
that the cut falls into. The library serves only to normalise what is not plain text.

Special strings in a text count as their one token, as the library does by default. Null text counts as
empty (0 tokens). Repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigstrata.llm.common import Cache, map_texts

#: The pieces of the vocabulary's pre-tokenizer (fixed pattern of its file).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same in lower-case ASCII.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Outside these characters, normalisation is left to the library: elsewhere NFC changes nothing and
#: lower-casing goes character by character.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ňŊ-ž‐-‧]*")
LIMIT = 2048
MODEL = "word_bpe_49k.json"
#: Pairs of tokens whose verdict a worker holds.
PAIRS = 400_000
#: Bytes of the counts that a worker holds.
HELD = 128 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
    return [chr(rest.get(b, b)) for b in range(256)]


class Merges:
    """Tables of counts at every prefix of a piece, from the vocabulary's merges (in order of rank)."""

    NEVER = 1 << 40

    def __init__(self, vocabulary: dict[str, int], merges: list[Sequence[str]], suffix: str):
        self.size = 1 + max(vocabulary.values())
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (x, y) in enumerate(merges):
            a, b, t = vocabulary[x], vocabulary[y], vocabulary[x + y]
            self.rank.setdefault(a * self.size + b, r)
            self.made.setdefault(t, (a, b, r))
        self.lefts: dict[int, tuple] = {}
        self.rights: dict[int, tuple] = {}
        self.apart: dict[int, bool] = {}
        self.symbols = byte_symbols()
        #: by string: the token inside a piece, or -1 for what only begins tokens; and the token at the end of a piece
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for name, t in vocabulary.items():
            if not self.whole(t):
                continue
            body = name.removesuffix(suffix)
            if body != name:
                self.last[body] = t
                self.inner.setdefault(body, -1)
            else:
                self.inner[body] = t
            for i in range(1, len(body)):
                self.inner.setdefault(body[:i], -1)

    def whole(self, t: int) -> bool:
        """Whether merging a token's symbols gives the token."""
        if t not in self.made:
            return True
        a, b, _ = self.made[t]
        return self.whole(a) and self.whole(b) and not self._meet(a, b)

    def _edge(self, t: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens at one edge (0 left, 1 right) while t is merged, from its symbol to itself, and the rank that ends each."""
        held = (self.lefts, self.rights)[side]
        if t not in held:
            names, ends, now = [t], [self.NEVER], t
            while now in self.made:
                ends.append(self.made[now][2])
                now = self.made[now][side]
                names.append(now)
            held[t] = names[::-1], ends[::-1]
        return held[t]

    def _meet(self, a: int, b: int) -> bool:
        """Whether a merge reaches across the cut between a and b before both are whole."""
        left, left_end = self._edge(a, 1)
        right, right_end = self._edge(b, 0)
        i = j = 0
        while left_end[i] != self.NEVER or right_end[j] != self.NEVER:
            r = self.rank.get(left[i] * self.size + right[j])
            # of equal ranks the leftmost pair merges first: that inside a goes before the cut, that inside b after it
            if r is not None and r < left_end[i] and r <= right_end[j]:
                return True
            if left_end[i] <= right_end[j]:
                i += 1
            else:
                j += 1
        return False

    def stay_apart(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.apart[key] = key not in self.rank and not self._meet(a, b)
        return known

    def _symbols(self, piece: str) -> tuple[str, list[int] | None]:
        """The symbols of a piece, and where its characters end in them (None: each is one)."""
        if piece.isascii() and piece.isprintable():
            return piece, None
        data = piece.encode()
        return "".join([self.symbols[b] for b in data]), [i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]

    def total(self, piece: str) -> int:
        """The token count of a piece: the last entry of its table, which is filled as far as that needs."""
        s = self._symbols(piece)[0]
        if s in self.last:
            return 1
        n, find, known, size = len(s), self.inner.get, self.apart.get, self.size
        tail, count = [-1] * n, [0] * n
        for j in range(n):
            before, more = tail[j] * size, count[j] + 1
            for i in range(j + 1, n):
                x = find(s[j:i])
                if x is None:
                    break
                if x >= 0 and tail[i] < 0:
                    if not j:
                        tail[i], count[i] = x, more
                        continue
                    apart = known(before + x)
                    if apart or apart is None and self.stay_apart(tail[j], x):
                        tail[i], count[i] = x, more
            else:
                y = self.last.get(s[j:])
                if y is not None and self.stay_apart(tail[j], y):
                    return more
        raise ValueError(f"no encoding of {piece!r}")

    def table(self, piece: str) -> Sequence[int]:
        """Entry i: the token count of the first i characters of a piece."""
        s, ends = self._symbols(piece)
        n, find, at_end = len(s), self.inner.get, self.last.get
        tail, count, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for j in range(n):
            before, more = tail[j], count[j] + 1
            for i in range(j + 1, n + 1):
                t = s[j:i]
                x = find(t)
                if x is None:
                    break
                if x >= 0 and tail[i] < 0 and (not j or self.stay_apart(before, x)):
                    tail[i], count[i] = x, more
                if not closed[i]:
                    y = at_end(t)
                    if y is not None and (not j or self.stay_apart(before, y)):
                        closed[i] = more
        if ends:
            closed = [0, *[closed[i] for i in ends]]
        return bytes(closed) if n < 256 else array("q", closed)


class PrefixCounter:
    """Prefix tables of pieces and of texts; the counts of pieces are held, bounded by bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.marks = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = regex.compile("|".join(map(regex.escape, self.marks))) if self.marks else None
        self.totals: Cache = Cache(HELD)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: (part, whether it is one)."""
        if not self.marks or not any(m in text for m in self.marks):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, in order; a special string is a piece."""
        out: list[str] = []
        for part, special in self.segments(text):
            out += [part] if special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_PIECE.findall(text.lower())
        if not PLAIN.fullmatch(text):
            text = self.tokenizer.normalizer.normalize_str(text)
            return PIECE.findall(text) if PLAIN.fullmatch(text) else [text[a:b] for a, b in self._cuts(text)]
        return PIECE.findall(text.lower())

    def _cuts(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each piece of a normalised text; a character's bytes are not parted by the pattern."""
        return [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def within(self, piece: str) -> Sequence[int]:
        """Entry i: the exact token count of the first i characters of a piece, as a text of its own."""
        if piece in self.marks or (piece[0] == "'" and len(piece) > 1 and piece[1].isalpha()):
            # the beginnings of a special string or of a contraction fall into pieces of their own
            heads = [PIECE.findall(piece[:i]) for i in range(len(piece))]
            return [*[sum(map(self.merges.total, ps)) for ps in heads], self._count(piece)]
        return self.merges.table(piece)

    def _count(self, piece: str) -> int:
        n = 1 if piece in self.marks else self.merges.total(piece)
        if len(piece) <= self.totals.longest:
            self.totals.keep(piece, n)
        return n

    def total(self, pieces: list[str]) -> int:
        """The token count of a text's pieces."""
        held = self.totals
        new = [p for p in pieces if p not in held]
        here = {p: self._count(p) for p in dict.fromkeys(new)}
        if any(len(p) > self.totals.longest for p in here):
            return sum([held.get(p) or here[p] for p in pieces])
        return sum(map(held.__getitem__, pieces))

    def counts(self, pieces: list[str]) -> list[int]:
        held, count = self.totals.get, self._count
        return [held(p) or count(p) for p in pieces]

    def table(self, text: str) -> TextTable:
        """The prefix table of a text."""
        parts, spans, at = [], [], 0
        for part, special in self.segments(text):
            if special:
                spans.append((at, at + len(part), True))
            else:
                part = self.tokenizer.normalizer.normalize_str(part)
                spans += [(at + a, at + b, False) for a, b in self._cuts(part)]
            parts.append(part)
            at += len(part)
        return TextTable(self, "".join(parts), spans)


class TextTable:
    """Exact counts at every prefix of a normalised text, and the longest prefix within a budget."""

    def __init__(self, counter: PrefixCounter, text: str, spans: list[tuple[int, int, bool]]):
        self.counter, self.text, self.spans = counter, text, spans
        self.stops = [b for _, b, _ in spans]
        self.done = [0, *accumulate(counter.counts([text[a:b] for a, b, _ in spans]))]

    def _before(self, i: int) -> int:
        """The start of the piece that a cut inside piece i falls back to: for a special string that is cut, what stands
        before it joins with its beginning, back to the special string before it."""
        while i and not self.spans[i - 1][2]:
            i -= 1
        return i

    def _begun(self, i: int, chars: int) -> int:
        """The count of the first `chars` characters, of which the last lies inside piece i."""
        start, _, special = self.spans[i]
        if not special:
            return self.done[i] + self.counter.within(self.text[start : self.spans[i][1]])[chars - start]
        j = self._before(i)
        return self.done[j] + sum(self.counter.counts(PIECE.findall(self.text[self.spans[j][0] : chars])))

    def count_at(self, chars: int) -> int:
        """The token count of the first `chars` characters."""
        i = bisect_right(self.stops, chars)
        if i == len(self.spans) or chars <= self.spans[i][0]:
            return self.done[i]
        return self._begun(i, chars)

    def truncate(self, budget: int) -> int:
        """The most leading characters that fit in a budget of tokens."""
        i = bisect_right(self.done, budget) - 1  # pieces that fit whole
        if i == len(self.spans):
            return len(self.text)
        start, stop, special = self.spans[i]
        if special:
            return next((c for c in range(stop - 1, start, -1) if self._begun(i, c) <= budget), start)
        begun = self.counter.within(self.text[start:stop])
        return next((start + k for k in range(stop - start - 1, 0, -1) if self.done[i] + begun[k] <= budget), start)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("limit_chars", T.LongType()),
]


def _counting(path: str, limit: int):
    def count(texts: list) -> list:
        c = counter(path)
        c.totals.room()
        out: tuple[list, list, list] = ([], [], [])
        for t in texts:
            n = c.total(c.pieces(t)) if t else 0
            out[0].append(len(t.encode()) if t else 0)
            out[1].append(n)
            out[2].append(c.table(t).truncate(limit) if n > limit else None)
        return list(out)

    return count


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and limit_chars: the leading characters of the normalised text that fit in
    the limit, null where all do."""
    counted = map_texts(docs.select("doc_id", "text"), _counting(path, limit), FIELDS, keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")
