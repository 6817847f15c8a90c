"""Packing token sequences into windows without padding, by minimum bin slack over remaining lengths.

Documents become pieces of at most ``capacity`` tokens, and how many pieces have each length is all that the plan
needs: at most ``capacity`` numbers, for any number of documents. For each window, a bitset subset-sum over the lengths that
remain picks the multiset that fills it closest to capacity, and walking the sets back gives how many of each length; the same
window is made as often as the counts allow. Where no multiset fits exactly, one more piece is cut in two: its head
closes the window and its tail remains for a later one. When less than a window remains, windows are powers of two, which need
no padding either. Pieces take their places by their rank among pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .packing import fullest

CAPACITY = 1024
END_ID = 0
#: Units that the memo holds at most, and bytes of them.
MEMO = 600_000
_MEMO_BYTES = 64 << 20
#: Bytes of text that are looked up at a time, and split at a time, as targets; and rows given out at a time.
_GROUP = 4 << 20
_SPLIT = 1 << 19
_OUT = 1000
_TOGETHER = 500
_RANKED = 100_000
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows up to the next: the tokenizer's units never reach from other characters into white space.
_CHUNKS = re.compile(rf"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: The classes of the tokenizer's own units, for texts without a character whose class another version of Unicode might see otherwise.
_LAST = 0x24F
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_DIGITS, _BLANKS = r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_BLANK = 2
_CLASS = np.array([next((k for k, c in enumerate((_LETTERS, _DIGITS, _BLANKS)) if re.match(f"[{c}]", chr(i))), 3) for i in range(_LAST + 1)], dtype=np.uint8)
#: How the vocabulary writes a byte: as the character of its number, or one from 256 on where that doesn't print.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)


def _bytes(column: pa.LargeStringArray | pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each starts in them, with the end. There may be no null."""
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _column(kind: pa.DataType, data: np.ndarray, at: np.ndarray) -> pa.Array:
    """What :func:`_bytes` takes apart."""
    return pa.Array.from_buffers(kind, at.size - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def _slices(column: pa.LargeStringArray) -> Iterator[pa.LargeStringArray]:
    """The column in parts that start ``_SPLIT`` bytes apart, or a text where that is longer."""
    at = _bytes(column)[1]
    ends = np.unique(np.append(np.searchsorted(at, np.arange(_SPLIT, at[-1], _SPLIT)), len(column)))
    return (column[a:b] for a, b in pairwise([0, *ends.tolist()]))


def _foreign(column: pa.LargeStringArray) -> np.ndarray:
    """Which texts hold a character beyond ``_LAST``."""
    data, at = _bytes(column)
    lead = np.flatnonzero(data >= 0xC9)
    lead = lead[(data[lead] > 0xC9) | (data[lead + 1] > 0x8F)]
    out = np.zeros(len(column), dtype=bool)
    out[np.searchsorted(at, lead, side="right") - 1] = True
    return out


def _units(column: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The tokenizer's own units of texts that aren't foreign, and how many each text has.

    A run of letters, of digits or of others, with a space before it, is a unit; so is white space, less its last character where
    something follows. An apostrophe alone, without a space before it, takes s, t, m, d, re, ve or ll along.
    """
    data, at = _bytes(column)
    n = data.size
    kind = np.take(_CLASS, data)
    lead = np.flatnonzero(data > 0xC0)
    kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    first = at[:-1][at[:-1] < at[1:]]
    start = np.ones(n, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    after = start & (kind != _BLANK)
    after[1:] &= kind[:-1] == _BLANK
    after[first] = False
    start[first] = True
    after = np.flatnonzero(after)  # where something follows white space
    start[after - 1 - (data[after - 1] >= 0x80)] = True
    start[after[data[after - 1] == ord(" ")]] = False
    ends = np.zeros(n + 3, dtype=bool)  # where a run or a text ends, for three bytes beyond the last too
    ends[:n] = start
    ends[n:] = True
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[start[quote] & ends[quote + 1] & (quote + 1 < n)]
    quote = quote[~np.isin(quote + 1, first)]
    next_, second = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
    two = ~ends[quote + 2] & ((second == ord("e")) & ((next_ == ord("r")) | (next_ == ord("v"))) | (second == ord("l")) & (next_ == ord("l")))
    one = np.isin(next_, np.frombuffer(b"stmd", np.uint8))
    ends[quote[one | two] + 1] = False
    ends[quote[one] + 2] = True
    ends[quote[two] + 3] = True
    starts = np.append(np.flatnonzero(ends[:n]), n)
    return _column(pa.large_string(), data, starts), np.diff(np.searchsorted(starts, at))


def _chunks(column: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The chunks of any texts, as :func:`_units`."""
    found = [_CHUNKS.findall(t) for t in column.to_pylist()]
    return pa.array(chain.from_iterable(found), pa.large_string()), np.array([len(x) for x in found])


class ByteTokenizer:
    """Ids of whole texts, unit by unit, with a bounded memo; new units go to the library many at a time.

    Units are told apart, numbered and looked up by Arrow, with the memo's as the first numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.bare = Tokenizer(self.library.model)  # for units written in the vocabulary's characters
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.type = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.memo = pa.array([], pa.large_string())
        self.known = pa.array([], pa.large_binary())
        self.seen = np.zeros(0, dtype=np.int64)

    def ids(self, texts: pa.Array | list[str]) -> list[bytes]:
        """For each text the ids one after the other, little-endian, ``type`` each."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column.validate(full=True)
        foreign = _foreign(column)
        out = [b""] * len(column)
        for among, split, learn in ((~foreign, _units, self._learn_units), (foreign, _chunks, self._learn_chunks)):
            rows = np.flatnonzero(among)
            if rows.size:
                units, counts = zip(*map(split, _slices(column.take(pa.array(rows)) if rows.size < len(column) else column)), strict=True)
                data, starts = _bytes(self._look_up(units, learn))
                starts = starts[np.append(0, np.cumsum(np.concatenate(counts)))].tolist()
                for i, a, b in zip(rows.tolist(), starts, starts[1:], strict=False):
                    out[i] = data[a:b].tobytes()
        return out

    def _look_up(self, units: tuple[pa.LargeStringArray, ...], learn: Callable[[pa.LargeStringArray], pa.LargeBinaryArray]) -> pa.LargeBinaryArray:
        held = len(self.memo)
        coded = pa.concat_arrays([self.memo, *units]).dictionary_encode()
        memo, codes = coded.dictionary, coded.indices[held:]
        if len(memo) > held:
            self.known = pa.concat_arrays([self.known, learn(memo[held:])])
        seen = np.bincount(codes.to_numpy(), minlength=len(memo))
        seen[:held] += self.seen
        self.memo, self.seen = memo, seen
        found = self.known.take(codes)
        if len(self.memo) > MEMO or self.memo.nbytes + self.known.nbytes > _MEMO_BYTES:
            self._forget()
        return found

    def _forget(self) -> None:
        """Leave what is seen least out of a full memo, down to a half at least."""
        size = np.diff(_bytes(self.memo)[1]) + np.diff(_bytes(self.known)[1]) + 16
        while (self.seen > 0).sum() > MEMO // 2 or size[self.seen > 0].sum() > _MEMO_BYTES // 2:
            self.seen //= 2
        kept = np.flatnonzero(self.seen)
        self.memo, self.known, self.seen = self.memo.take(pa.array(kept)), self.known.take(pa.array(kept)), self.seen[kept]

    def _learn_units(self, units: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of single units. The bytes that ids stand for tell where each unit ends."""
        data, at = _bytes(units)
        shown = np.full(data.size + len(units), ord(" "), dtype="<u4")
        shown[np.arange(data.size) + np.repeat(np.arange(len(units)), np.diff(at))] = _SHOWN[data]
        parts = [np.empty(0, dtype=self.type)]
        for a in range(0, len(units), _TOGETHER):
            b = min(a + _TOGETHER, len(units))
            part = shown[at[a] + a : at[b] + b].tobytes().decode("utf-32-le")
            parts.append(np.array(self.bare.encode_batch_fast([part], add_special_tokens=False)[0].ids, dtype=self.type))
        ids = np.concatenate(parts)
        reach = np.append(0, np.cumsum(self.sizes[ids]))
        ends = np.searchsorted(reach, at)
        if reach[-1] != at[-1] or not np.array_equal(reach[ends], at):
            raise ValueError("not a vocabulary of bytes")
        return _column(pa.large_binary(), ids, ids.itemsize * ends)

    def _learn_chunks(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        out = []
        for a in range(0, len(chunks), 10 * _TOGETHER):
            for e in self.library.encode_batch_fast(chunks[a : a + 10 * _TOGETHER].to_pylist(), add_special_tokens=False):
                out.append(np.array(e.ids, dtype=self.type).tobytes())
        return pa.array(out, pa.large_binary())


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def _crc(ids: bytes, kind: str) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype=kind).astype("<u4"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) by about ``_GROUP`` bytes of text; a single longer text is the last of its batch."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist(), 1):
            size += n
            if size >= _GROUP:
                yield from pa.Table.from_batches([*held, batch.slice(at, i - at)]).combine_chunks().to_batches()
                held, size, at = [], 0, i
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """Tokenize whole texts, append the end id, and cut what is longer than ``capacity`` into full pieces and a rest.

    Rows (row, start, length, ids_crc32, doc_tokens, ids): ``keep`` as a struct, and the ids as bytes, two or four each. A null
    or empty text is the end id alone.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep))).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        width, end = np.dtype(t.type).itemsize, np.array([END_ID], dtype=t.type).tobytes()
        for batch in _groups(batches):
            which, found = [], []
            for j, data in enumerate(t.ids(batch.column(1))):
                data += end
                for s in range(0, len(data), width * capacity):
                    part = data[s : s + width * capacity]
                    which.append(j)
                    found.append((s // width, len(part) // width, _crc(part, t.type), len(data) // width, part))
            for s in range(0, len(found), _OUT):
                columns = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*found[s : s + _OUT], strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which[s : s + _OUT], pa.int64())), *columns], ["row", *names])

    schema = T.StructType([rows.schema["row"], *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names)])
    return rows.mapInArrow(run, schema)


class _Supply:
    """What remains of one length: runs of pieces (length as a whole, place in the piece, first rank, how many)."""

    def __init__(self) -> None:
        self.runs: deque[tuple[int, int, int, int]] = deque()
        self.count = 0

    def add(self, whole: int, begin: int, rank: int, n: int) -> None:
        self.runs.append((whole, begin, rank, n))
        self.count += n

    def take(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.count -= n
        while n:
            whole, begin, rank, held = self.runs.popleft()
            some = min(n, held)
            if some < held:
                self.runs.appendleft((whole, begin, rank + some, held - some))
            yield whole, begin, rank, some
            n -= some


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, how many ranks, place in the piece, length, index of the first, pieces a window, first window, offset there).

    A rank may be in several rows, one for each part its piece is cut into; parts cover the piece. All windows are full, but for
    the last ones, whose lengths are falling powers of two.
    """
    supply: dict[int, _Supply] = {}
    put = lambda n, *run: supply.setdefault(n, _Supply()).add(*run)
    for n, c in counts.items():
        if c:
            put(n, n, 0, 0, c)
    total = sum(n * c for n, c in counts.items())
    out: dict[int, list] = {}
    window = 0
    while total:
        size = capacity if total >= capacity else 1 << total.bit_length() - 1
        left = {n: s.count for n, s in supply.items() if s.count}
        use = fullest(sorted(left, reverse=True), left, size) if max(left) > size else _with_longest(left, size)
        gap = size - sum(n * k for n, k in use.items())
        cut = max((n for n in left if left[n] > use.get(n, 0)), default=0) if gap else 0
        need = use | ({cut: use.get(cut, 0) + 1} if gap else {})
        times = min(min(left[n] // k for n, k in need.items()), total // size if size == capacity else 1)
        offset = 0
        for n in sorted(use, reverse=True):
            _lay(out, supply[n].take(times * use[n]), n, use[n], window, offset)
            offset += n * use[n]
        if gap:
            runs = list(supply[cut].take(times))
            _lay(out, iter(runs), gap, 1, window, offset)
            for whole, begin, rank, some in runs:
                put(cut - gap, whole, begin + gap, rank, some)
        window += times
        total -= times * size
    return {n: np.array(x, dtype=np.int64) for n, x in out.items()}


def _with_longest(left: dict[int, int], size: int) -> dict[int, int]:
    """The fullest window that holds a piece of the greatest length left."""
    first = max(left)
    rest = left | {first: left[first] - 1}
    use = fullest([n for n in sorted(rest, reverse=True) if rest[n]], rest, size - first)
    return use | {first: use.get(first, 0) + 1}


def _lay(out: dict[int, list], runs: Iterator[tuple[int, int, int, int]], length: int, many: int, window: int, offset: int) -> None:
    index = 0
    for whole, begin, rank, some in runs:
        out.setdefault(whole, []).append((rank, some, begin, length, index, many, window, offset))
        index += some


def _placed(table: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which ranks, place in the piece, length, window, offset) of the parts of pieces, a row of the plan at a time."""
    order = np.argsort(rank, kind="stable")
    ranks = rank[order]
    for first, some, begin, length, index, many, window, offset in table.tolist():
        lo, hi = np.searchsorted(ranks, [first, first + some])
        if lo == hi:
            continue
        i = index + ranks[lo:hi] - first
        same = np.ones(hi - lo, dtype=np.int64)
        yield order[lo:hi], begin * same, length * same, window + i // many, offset + i % many * length


def pack(cut: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Place the rows of :func:`pieces`: (row, start, length, ids_crc32, doc_tokens, sequence_id, offset), and with ``with_ids`` the ids as bytes.

    Ranks come from counts by (length, salt) and row numbers within them, so a length that most pieces share is dealt over many tasks.
    Ids stay in their table, but for those of pieces that are cut once more.
    """
    table = materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "windows-pieces")
    salts = max(1, -(-table.count() // _RANKED))
    salted = table.drop("ids").withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)))
    by = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by.groupBy("length").agg(F.sum("n")).collect()}  # a row a length
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must be 1 to capacity")
    where = plan(counts, capacity)
    base = by.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece")) - 1
    columns = ["row", "start", "ids_crc32", "doc_tokens", "piece", "length"]
    ranked = salted.withColumn("rank", rank).join(base, ["length", "salt"]).select(*columns, (F.col("rank") + F.col("base")).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                for which, *placed in _placed(where[int(n)], rank[here]):
                    kept = batch.take(pa.array(here[which])).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, placed)], [*columns, "begin", "part", "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in ("begin", "part", "sequence_id", "offset"))])
    placed = ranked.mapInArrow(put, schema)
    if not with_ids:
        placed = materialize(placed, "windows-placed")  # read twice
    ids = table.select("piece", "ids")
    out = placed.schema.fieldNames()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = dict(zip(batch.schema.names, batch.columns, strict=True))
            parts = []
            for data, n, begin, part in zip(got["ids"].to_pylist(), *(got[c].to_pylist() for c in ("length", "begin", "part")), strict=True):
                width = len(data) // n
                parts.append(data[width * begin : width * (begin + part)])
            got["ids_crc32"] = pa.array([_crc(d, f"<u{len(d) // k}") for d, k in zip(parts, got["part"].to_pylist(), strict=True)], pa.int64())
            got["ids"] = pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_arrays([got[c] for c in (*out, "ids")], [*out, "ids"])

    opened = T.StructType([*placed.schema.fields, T.StructField("ids", T.BinaryType())])
    some = placed if with_ids else placed.where("part < length")
    few = sum(int(t[t[:, 3] < n, 1].sum()) for n, t in where.items()) <= _RANKED  # parts of cut pieces, as planned
    if few and not with_ids:
        some = F.broadcast(some)
    parts = some.join(ids, "piece").select(*out, "ids").mapInArrow(cut_out, opened)
    whole = parts if with_ids else placed.where("part = length").unionByName(parts.drop("ids"))
    return whole.select("row", (F.col("start") + F.col("begin")).alias("start"), F.col("part").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def pack_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset; see :func:`pieces` and :func:`pack`.

    A null text is empty, and an empty one is the end id alone. Repeated rows are packed each, a null id is kept as it is, and ``keep`` may not name columns
    that are given out. No document gives no row.
    """
    packed = pack(pieces(docs, path, text, keep, capacity), capacity, with_ids)
    return packed.select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(keep)), *packed.columns[1:])
