"""Byte-level BPE, encoding in linear time by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 characters, and an Aho-Corasick automaton holds all tokens backwards: one pass
over a piece from its end finds the longest token that starts at every place. A sequence of tokens is what the merges give exactly if each two
neighbours, encoded alone, stay the two; so the encoder takes longest matches, tries the next shorter
prefix where a neighbour doesn't fit, and steps back where no prefix is left. Places given up once are
never tried again, and whether two tokens fit is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MEMO = 400_000
_LONGEST_MEMO = 64


class Codec:
    """Encoder and decoder for one file of ranks (base64 token, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in f if x.strip())}
        if any(chr(b) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.rank, self.split_text = ranks, regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.bytes = {i: t.encode("latin-1") for t, i in ranks.items()}
        self.find = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.find.add_word(t[::-1], i)
        self.find.make_automaton()
        self.shorter = {i: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None) for t, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.token):
            self._add(i, self.token[i])
        self.words, self.texts = _Memo(lambda w: " ".join(map(str, self.encode_piece(w.encode())))), _Memo(self._decode_ids)

    def _add(self, i: int, t: str) -> None:
        """Find the last merge that makes token ``i``: the halves that stay apart under earlier merges."""
        self.halves[i] = (i, i)
        for n in range(1, len(t)):
            a, b = self.rank.get(t[:n]), self.rank.get(t[n:])
            if a is not None and b is not None and a < i and b < i and self._apart(a, b):
                self.halves[i] = (a, b)
                self.merged[a, b] = i
                return

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before those inside them.

        Undoes the merges on both sides of the border, latest first. A merge of the two tokens that
        then touch happened if it is earlier than the merge undone last.
        """
        limit = float("inf")
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            left, right = self.halves[a][1], self.halves[b][0]
            if a > b or right == b:
                if left == a:
                    if right == b:
                        return True
                    limit, b = b + 1, right
                else:
                    limit, a = a, left
            else:
                limit, b = b + 1, right

    def _ok(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            got = self.fits[a, b] = self._apart(a, b)
        return got

    def _longest(self, text: str) -> list[int]:
        """The longest token that starts at each place; the automaton gives the longest of a place first."""
        out, left = [0] * len(text), len(text)
        for end, i in self.find.iter(text[::-1]):
            if len(text) - 1 - end < left:
                left = len(text) - 1 - end
                out[left] = i
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        text = data.decode("latin-1")
        if (one := self.rank.get(text)) is not None:
            return [one]
        longest = self._longest(text)
        out: list[int] = []
        at, dead, token = 0, set(), longest[0] if text else None
        while token is not None:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(self.token[token])
                if end not in dead and (last is None or self._ok(last, token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead.add(at)
                if last is None:
                    raise ValueError("no encoding")
                out.pop()
                at -= len(self.token[last])
                token = self.shorter[last]
                while token is None and out:  # nothing shorter here either
                    dead.add(at)
                    last = out.pop()
                    at -= len(self.token[last])
                    token = self.shorter[last]
                continue
            out.append(token)
            at = end
            token = longest[at] if at < len(text) else None
        return out

    def encode_pieces(self, text: str) -> list[str]:
        """Ids of each piece of the text, as decimals with spaces."""
        words = self.words
        return [words[p] if len(p) <= _LONGEST_MEMO else words.make(p) for p in self.split_text(text)]

    def encode(self, text: str) -> list[int]:
        return [int(x) for p in self.encode_pieces(text) for x in p.split()]

    def _decode_ids(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, map(int, ids.split())))

    def decode_pieces(self, pieces: list[str]) -> bytes:
        texts = self.texts
        return b"".join([texts[p] if len(p) <= 2 * _LONGEST_MEMO else texts.make(p) for p in pieces])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class _Memo(dict):
    """A memo that starts anew when full; only a cache, results don't depend on it."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        self[key] = got = self.make(key)
        return got


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file of ranks; each Python worker builds it once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids again, in one pass without a shuffle.

    Returns ``keep`` and n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256,
    and with ``with_ids`` the arrays ids and decoded. A null or empty text has no ids.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    extra = ", ids array<int>, decoded binary" if with_ids else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, a, b, ids, back = [], [], [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                pieces = c.encode_pieces(t or "")
                joined = " ".join(pieces)
                decoded = c.decode_pieces(pieces)
                n.append(joined.count(" ") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in joined.split()])
                    back.append(decoded)
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
