"""Packing token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. How many pieces have each length is all that
packing needs, and that is at most ``capacity`` numbers; so the plan is made on the driver, the same
for any number of documents. Per bin, the largest length left is placed and a bitset subset-sum over
the lengths available finds the fullest combination for the rest; the same combination is used as often
as the counts allow. Pieces then take their places by their rank among pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

CAPACITY = 4096
END_ID = 1
MEMO = 300_000
_TOGETHER = 500
#: Rows that one task ranks at most, as a target; the number of salts follows the number of pieces.
_RANKED = 100_000
#: What the tokenizer's normaliser takes for white space; str.split() also splits at these four controls.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = re.compile(r"[\x1c-\x1f]")
#: A character beyond plain texts: Latin letters, digits, spaces, commas and stops.
_BEYOND = re.compile(r"[^A-Za-z0-9 \n\t.,\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]")
#: Texts to split at white space alone: letters beyond Latin, whose case or form may depend on neighbours,
#: control characters, and commas or stops that stand by another mark.
_ODD = re.compile(r"[^\x00-\u024f]|[\x1c-\x1f\u0130]|[.,](?=[^\s\w]|_)|(?<=[^\s\w])[.,]|(?<=_)[.,]")
_PAIRS = (".,", ",.", "..", ",,")
#: A character beyond ASCII without controls and the letters of Latin-1 and Latin Extended-A; and the parts that the tokenizer cuts lower-case texts without one into.
_FOREIGN = re.compile(r"[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]")
_LETTERS = r"a-z\xdf-\xf6\xf8-\u012f\u0131-\u017f"
_UNITS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: How the vocabulary writes a byte: as the character of its number, or one from 256 on where that doesn't print.
_SHOWN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class WordTokenizer:
    """Ids of whole texts, word by word: the vocabulary drops white space and never merges across it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.bare = Tokenizer(self.library.model)  # for words that are as the normaliser would leave them, written in the vocabulary's characters
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def words(self, text: str) -> list[str]:
        """Parts of the text that have the same ids one by one: words, of plain texts without case, commas and stops apart, of Latin ones the tokenizer's own units."""
        if not (_ODD.search(text) if _BEYOND.search(text) else any(p in text for p in _PAIRS)):
            return text.lower().replace(",", " , ").replace(".", " . ").split()
        if not _FOREIGN.search(text):
            return _UNITS.findall(text.lower())
        if _CONTROLS.search(text):
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def learn(self, texts: list[list[str]]) -> None:
        """Put all these words into the memo. A full memo is set aside, and words still in use move over."""
        new = set().union(*texts).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.older, self.memo = self.memo, {}
            new = set().union(*texts)
        for w in new.intersection(self.older):
            self.memo[w] = self.older[w]
        rest = [w for w in new if w not in self.older]
        small, plain, odd = [], [], []
        for w in rest:
            if len(w) >= 100 or not w.isalpha():
                odd.append(w)
            elif w.islower() and (w.isascii() or not _BEYOND.search(w)):
                small.append(w)
            else:
                plain.append(w)
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN) for w in small]
        for library, words, given in ((self.bare, small, shown), (self.library, plain, plain)):
            parts = [" ".join(given[at : at + _TOGETHER]) for at in range(0, len(words), _TOGETHER)]
            for k, e in enumerate(library.encode_batch_fast(parts, add_special_tokens=False)):  # letters alone are one unit each, and the last id of a unit shows
                part = words[k * _TOGETHER : (k + 1) * _TOGETHER]
                ids = np.array(e.ids, dtype="<u4")
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(stops) != len(part):
                    odd += part
                    continue
                data, start = ids.tobytes(), 0
                for w, stop in zip(part, stops, strict=True):
                    self.memo[w] = data[start:stop]
                    start = stop
        for w, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, append the end id, and cut only what is longer than ``capacity``.

    Returns ``keep``, piece, start, length, ids_crc32, and with ``with_ids`` the ids. A null or empty
    text is the end id alone.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokenizer(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            at, size = 0, 0
            for i, x in enumerate(texts):  # so many texts at a time that their words stay few
                size += len(x or "")
                if size < 4_000_000 and i + 1 < len(texts):
                    continue
                words = [t.words(x or "") for x in texts[at : i + 1]]
                t.learn(words)
                for j, w in enumerate(words, at):
                    data = b"".join(map(t.memo.__getitem__, w)) + end
                    for k, s in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[s : s + 4 * capacity]
                        rows.append(j)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype="<i4"))
                at, size = i + 1, 0
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            columns = [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [*keep, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{head}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return kept.mapInArrow(run, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum that fits into ``room``.

    Bit s of the set says that sum s can be reached. ``lengths`` falls; a length may be used as often as
    it is there. Stops once ``room`` itself is reached; the sets before each length give the way back.
    """
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for n in lengths:
        if n > room:
            continue
        before.append((n, reach))
        left, step = min(counts[n], room // n), 1
        while left:  # binary parts of the number available
            take = min(step, left)
            reach |= (reach << (n * take)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for n, was in reversed(before):
        while not was >> total & 1:
            total -= n
            out[n] = out.get(n, 0) + 1
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how often, {length: how many}), until no piece is left."""
    counts = {n: c for n, c in counts.items() if c}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        rest = counts | {first: counts[first] - 1}
        use = fullest([n for n in lengths if rest[n]], rest, capacity - first)
        use[first] = use.get(first, 0) + 1
        times = min(counts[n] // k for n, k in use.items())
        out.append((times, use))
        for n, k in use.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
    return out


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a bin, first bin, offset of its first piece there)."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    number = 0
    for times, use in bins:
        offset = 0
        for n in sorted(use, reverse=True):
            out.setdefault(n, []).append((rank.get(n, 0), use[n], number, offset))
            rank[n] = rank.get(n, 0) + times * use[n]
            offset += n * use[n]
        number += times
    return {n: np.array(x, dtype=np.int64) for n, x in out.items()}


def pack(pieces: DataFrame, order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """Append sequence_id and offset to ``pieces``, which need a column length of 1 to ``capacity``.

    Ranks come from counts by (length, salt) and row numbers within them, so a length that most pieces
    share is dealt over many tasks. Rows that tie in ``order`` take places in any order.
    """
    total = pieces.count()
    salts = max(1, -(-total // _RANKED))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    by = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in by.groupBy("length").agg(F.sum("_n")).collect()}  # a row a length
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must be 1 to capacity")
    where = places(plan(counts, capacity))
    base = by.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_base"))
    row = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_row", row).join(base, ["length", "_salt"]).select(*pieces.columns, (F.col("_row") + F.col("_base")).alias("_rank"))
    names = pieces.columns
    at = names.index("length")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(length.size, dtype=np.int64), np.zeros(length.size, dtype=np.int64)
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                table = where[int(n)]
                first, many, number, begin = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1].T
                sequence[here] = number + (rank[here] - first) // many
                offset[here] = begin + (rank[here] - first) % many * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(put, f"{head}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents; see :func:`pieces` and :func:`pack`.

    Repeated rows are packed each. A null doc_id is kept as it is. No document gives no row.
    """
    cut = materialize(pieces(docs, path, keep=keep, capacity=capacity), "pieces")
    return pack(cut, (*keep, "piece"), capacity)
