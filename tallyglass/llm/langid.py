"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is the product of
its letters' vectors, each rotated by its place; a text is the sum of its trigrams, and a language the
sum of its texts. A text gets the language whose vector has the largest cosine with its own.

Sums are whole numbers, so the result doesn't depend on partitioning. Learning and predicting are each
one pass over the texts without a shuffle of text. Languages are a table of vectors; a pass takes
``TOGETHER`` of them along, so beyond that many there is a pass for each so many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

DIM = 1024
#: Languages that one pass over the texts compares with.
TOGETHER = 1024
UNKNOWN = "und"
#: Letters at which the bar of :func:`known` is half of a long text's.
SHORT = 8
_COLUMNS = 4096
_CELLS = 1 << 21


class Encoder:
    """Text to trigram counts and on to vectors; one per task."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter = np.zeros(0x110000, dtype=np.int32)  # code point -> 1, 2, ...; -1: not seen; 0: no letter
        self.letter[:] = [-1 if chr(c).isalpha() else 0 for c in range(0x110000)]
        self.vectors = np.ones((1, dim), dtype=np.int8)
        self.vectors[0] = self._random(0)

    def _random(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, self.dim, dtype=np.int8)
        return (2 * bits - 1).astype(np.int8)

    def symbols(self, text: str) -> np.ndarray:
        """Letter numbers of the lower-cased text; a run of anything else is one 0, also at both ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = self.letter[codes]
        if (new := np.unique(codes[got < 0])).size:
            self.letter[new] = np.arange(len(self.vectors), len(self.vectors) + new.size)
            self.vectors = np.concatenate([self.vectors, np.stack([self._random(int(c)) for c in new])])
            got = self.letter[codes]
        got = np.concatenate([[0], got, [0]]).astype(np.int64)
        return got[np.concatenate([[True], (got[1:] != 0) | (got[:-1] != 0)])]

    def grams(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Vectors of trigram keys (base ``n``)."""
        a, b, c = keys // (n * n), keys // n % n, keys % n
        out = np.roll(self.vectors, 2, axis=1)[a].astype(np.float32)
        out *= np.roll(self.vectors, 1, axis=1)[b]
        out *= self.vectors[c]
        return out

    def bundle(self, texts: list[str], group: np.ndarray, groups: int) -> np.ndarray:
        """Sum of the trigram vectors of the texts of each group, exact in double precision."""
        symbols = [self.symbols(t) for t in texts]
        n = len(self.vectors)
        keys = [(s[:-2] * n + s[1:-1]) * n + s[2:] for s in symbols]
        out = np.zeros((groups, self.dim))
        if not keys:
            return out
        rows = np.repeat(np.asarray(group, dtype=np.int64), [k.size for k in keys])
        keys = np.concatenate(keys)
        if n**3 <= 1 << 24:
            found = np.flatnonzero(np.bincount(keys, minlength=1))
            place = np.zeros(n**3, dtype=np.int32)
            place[found] = np.arange(found.size)
            column = place[keys].astype(np.int64)
        else:
            found, column = np.unique(keys, return_inverse=True)
        for at in range(0, found.size, _COLUMNS):
            part = found[at : at + _COLUMNS]
            here = slice(None) if found.size <= _COLUMNS else (column >= at) & (column < at + _COLUMNS)
            counts = np.bincount(rows[here] * part.size + (column[here] - at), minlength=groups * part.size)
            out += counts.reshape(groups, part.size).astype(np.float32) @ self.grams(n, part)
        return out


def _blocks(texts: list[str], most: int = 256, chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch with few texts and few characters; a long text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most or size + len(t) > chars):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> DataFrame:
    """Language prototypes (lang, v) from all rows with text and lang; rows with a null in either teach nothing."""
    small_batches(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(dim), {}
        give = lambda: [pa.RecordBatch.from_arrays([pa.array([x] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"]) for x, v in total.items()]
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _blocks(texts):
                names = sorted(set(langs[part]))
                number = {x: i for i, x in enumerate(names)}
                found = encoder.bundle(texts[part], np.array([number[x] for x in langs[part]]), len(names))
                for x, v in zip(names, found, strict=True):
                    total[x] = total.get(x, 0) + v.astype(np.int64)
            if len(total) > TOGETHER:
                yield from give()
                total.clear()
        yield from give()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    summed = rows.mapInArrow(sums, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    whole = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"))  # dim entries a language
    return materialize(whole.select("lang", "v.v"), "languages")


def predict(docs: DataFrame, prototypes: DataFrame, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (the cosine, at least 0) to ``docs``.

    A null text, a text without a letter, and any text when nothing was learned get ``und`` and 0.
    Equal cosines go to the first language by name. Columns of ``docs`` of those names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    out = docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = [r[0] for r in prototypes.select("lang").orderBy("lang").collect()]
    for at in range(0, len(names), TOGETHER):
        some = names[at : at + TOGETHER]
        learned = {r[0]: np.array(r[1], dtype=np.float64) for r in prototypes.where(F.col("lang").between(some[0], some[-1])).collect()}
        out = _nearer(materialize(out, "languages-so-far") if at else out, some, np.stack([learned[x] for x in some]), text)
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def _nearer(docs: DataFrame, names: list[str], known: np.ndarray, text: str) -> DataFrame:
    """``docs`` with lang_pred and score, where a language of ``names`` is nearer than the one so far, replaced."""
    dim = known.shape[1]
    known = known / np.maximum(np.sqrt((known**2).sum(1, keepdims=True)), 1e-300)
    fields = docs.columns
    at = fields.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dim)
        lettered = lambda t: bool(t) and bool((encoder.letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] != 0).any())
        for batch in batches:
            texts, got = batch.column(at).to_pylist(), batch.column(len(fields) - 2).to_pylist()
            scores = np.where([x == UNKNOWN for x in got], -np.inf, batch.column(len(fields) - 1).to_numpy())
            for part in _blocks([t or "" for t in texts]):
                rows = [i for i in range(part.start, part.stop) if lettered(texts[i])]
                if not rows:
                    continue
                found = encoder.bundle([texts[i] for i in rows], np.arange(len(rows)), len(rows))
                near = found @ known.T / np.maximum(np.sqrt((found**2).sum(1, keepdims=True)), 1e-300)
                for i, best, score in zip(rows, near.argmax(1).tolist(), near.max(1).tolist(), strict=True):
                    if score > scores[i]:
                        got[i], scores[i] = names[best], score
            scores = np.where([x == UNKNOWN for x in got], 0.0, scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(got, pa.string()), pa.array(scores)], fields)

    return docs.mapInArrow(label, docs.schema)


def known(text: str = "text", dim: int = DIM):
    """True for predicted rows that are like a known language: their score is above 3 / sqrt(dim) * n / (n + ``SHORT``), for a text of n letters.

    Cosines of unrelated texts have a standard deviation of 1 / sqrt(dim), whatever their length; those of a text in its own language grow with its letters, so the bar
    does as well, by one rule for all lengths.
    """
    letters = F.length(F.regexp_replace(F.col(text), r"\P{L}+", ""))
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 3 / dim**0.5 * letters / (letters + SHORT))


def held_out(doc_id: str = "doc_id"):
    """True for the documents kept from learning: crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, then label all of ``docs``; see :func:`predict`.

    A document with a null id teaches nothing. Repeated rows each count.
    """
    taught = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs, learn(taught))
