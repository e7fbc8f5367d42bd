"""Byte-level BPE helpers that run inside Spark tasks: pre-tokens, their ids and their prefix counts.

A text's tokens are the tokens of its pre-tokens, so both are looked up by pre-token in a table of
bounded size that each Python worker fills as it goes.
"""

from __future__ import annotations

import base64
import re
from array import array
from operator import sub

import numpy as np
import regex
import tiktoken

#: Entries that a worker's table holds at most; later pre-tokens are worked out each time.
TABLE_ROWS = 400_000
#: From this length on a pre-token is encoded by the prefix recurrence, whose time is linear.
LONG_PIECE = 400

# The white space of Unicode, and letters and numbers below U+0250.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBER = "0-9²³¹¼-¾"


def pattern(letter: str, number: str) -> str:
    """The published pre-token pattern over the given character classes."""
    return (
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+|"
        rf" ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


LATIN = re.compile(pattern(LATIN_LETTER, LATIN_NUMBER))
ANY = regex.compile(pattern(r"\p{L}", r"\p{N}"))
BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")
SPACES = re.compile(f"[{SPACE}]{{2,}}")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    return (ANY if BEYOND_LATIN.search(text) else LATIN).findall(text)


class Vocabulary:
    """Ranks of a byte-level BPE and what follows from them for single pre-tokens."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.encode_piece = self.encoding._core_bpe.encode_single_piece
        self._follows: dict[int, bool] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens' bytes as these two tokens."""
        key = a << 32 | b
        found = self._follows.get(key)
        if found is None:
            if len(self._follows) > 4 * TABLE_ROWS:
                self._follows.clear()
            found = self._follows[key] = self.encode_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def prefixes(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For each byte length of a pre-token: its number of tokens, and the last of them.

        count[i] = count[i - len(t)] + 1, where t is the one token that ends at i and that BPE
        leaves whole behind the last token of what precedes it.
        """
        rank, follows, longest = self.ranks.get, self._follows.get, self.longest
        count, last = [0], [-1]
        for i in range(1, len(piece) + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = rank(piece[j:i])
                if t is not None and (not j or (f := follows(last[j] << 32 | t)) or f is None and self.follows(last[j], t)):
                    count.append(count[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary has no token for a single byte")
        return count, last

    def ids(self, piece: bytes) -> list[int]:
        """The token ids of one pre-token."""
        if len(piece) < LONG_PIECE:
            return self.encode_piece(piece)
        out, i, last = [], len(piece), self.prefixes(piece)[1]
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]


class IdTable(dict):
    """Pre-token to the bytes of its ids, each in the least of 16 or 32 bits that holds the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.code, self.kind = ("H", "<u2") if max(vocabulary.ranks.values()) < 1 << 16 else ("I", "<u4")

    def __missing__(self, piece: str) -> bytes:
        found = array(self.code, self.vocabulary.ids(piece.encode())).tobytes()
        if len(self) < TABLE_ROWS and len(piece) < LONG_PIECE:
            self[piece] = found
        return found


class StepTable(dict):
    """Pre-token to the bytes of how its token count changes with each code point (16 bits each)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def counts(self, piece: str) -> list[int]:
        """The token count of each prefix of a pre-token, by code points."""
        if piece in CONTRACTIONS:  # a shorter prefix is a mark and a letter run, not one pre-token
            size = lambda x: sum(len(self.vocabulary.ids(p.encode())) for p in pieces(x))
            return [size(piece[:i]) for i in range(len(piece) + 1)]
        raw = piece.encode()
        count = self.vocabulary.prefixes(raw)[0]
        if len(raw) == len(piece):
            return count
        return [n for n, byte in zip(count, raw) if byte & 0xC0 != 0x80] + count[-1:]

    def __missing__(self, piece: str) -> bytes:
        count = self.counts(piece)
        found = array("h", map(sub, count[1:], count)).tobytes()
        if len(self) < TABLE_ROWS and len(piece) < LONG_PIECE:
            self[piece] = found
        return found


_VOCABULARIES: dict[str, Vocabulary] = {}
_TABLES: dict[tuple, dict] = {}


def table(kind: type, ranks_path: str):
    """This worker's table of the given kind."""
    if (kind, ranks_path) not in _TABLES:
        if ranks_path not in _VOCABULARIES:
            _VOCABULARIES[ranks_path] = Vocabulary(ranks_path)
        _TABLES[kind, ranks_path] = kind(_VOCABULARIES[ranks_path])
    return _TABLES[kind, ranks_path]


def cut(text: str, special: dict[str, int]) -> list[str]:
    """Ordinary text and special strings in turn, beginning and ending with (maybe empty) ordinary text.

    special: longest first, so that of two strings at one place the longer one is found.
    """
    if not any(word in text for word in special):
        return [text]
    return re.split(f"({'|'.join(map(re.escape, special))})", text)


def token_ids(text: str, ids: IdTable, special: dict[str, int]) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit numbers; special strings become their own ids."""
    out = []
    for i, part in enumerate(cut(text, special)):
        if i % 2:
            out.append(np.array([special[part]], "<u4"))
        else:
            out.append(np.frombuffer(b"".join(map(ids.__getitem__, pieces(part))), ids.kind).astype("<u4"))
    return np.concatenate(out)


def ordinary_counts(text: str, steps: StepTable) -> np.ndarray:
    """The token count of each prefix of a text in which special strings mean nothing."""
    delta = np.frombuffer(b"".join(map(steps.__getitem__, pieces(text))), "<i2").astype(np.int32)
    out = np.zeros(len(text) + 1, np.int32)
    np.cumsum(delta, out=out[1:])
    for run in SPACES.finditer(text):
        a, b = run.span()
        if b < len(text):  # the text splits the run's last blank off; a prefix that ends there keeps the run whole
            whole = np.frombuffer(steps[text[a:b]], "<i2")
            out[b] = out[a] + int(whole.sum())
    return out


def prefix_counts(text: str, steps: StepTable, special: dict[str, int]) -> np.ndarray:
    """The exact token count of each prefix of a whole text: index i has that of its first i code points."""
    parts, done, out = cut(text, special), 0, []
    for part, word in zip(parts[::2], [*parts[1::2], ""]):
        # A cut inside the special string leaves ordinary text behind what precedes it, in which a shorter one can stand.
        own = part + word[:-1]
        counts = prefix_counts(own, steps, special) if word and any(w in word[:-1] for w in special) else ordinary_counts(own, steps)
        out.append(counts + np.int32(done))
        done += int(counts[len(part)]) + 1
    return np.concatenate(out)
