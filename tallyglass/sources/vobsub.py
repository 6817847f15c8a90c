"""Caption tracks: the text index as a DataFrame, subpicture units as nested rows, and a data source for pairs.

``read_vobsub`` reads .idx/.sub pairs from any file system of Spark's into one row per subpicture;
``spark.read.format("vobsub")`` reads those of a folder that executors can open, one task a pair.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.sequences import fill_end_times

CUES = (
    "file string, cue int, start_ms long, end_ms long, image struct<h:int,w:int,px:binary>, colors array<struct<r:int,g:int,b:int>>, "
    "alpha array<int>, x int, y int, forced boolean"
)
_STAMP = r"(-?)(\d+):(\d+):(\d+):(\d+)"


def index_rows(files: DataFrame) -> DataFrame:
    """Entries of index files given as rows (file, content): file, track_no, lang, stream_index, entry_no, ms, filepos.

    Delays add up until the next track starts; a malformed stamp is no entry; stamps before any track
    belong to track 0. Everything is built-in functions: a running sum over the lines of a file.
    """
    text = F.decode(F.col("content"), "ISO-8859-1") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    lines = files.select("file", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))
    lines = lines.where("line <> '' and not startswith(line, '#')")
    part = lambda rx, i: F.regexp_extract("line", rx, i)
    stamp = lambda rx: (((part(rx, 2).cast("long") * 60 + part(rx, 3).cast("long")) * 60 + part(rx, 4).cast("long")) * 1000 + part(rx, 5).cast("long")) * F.when(part(rx, 1) == "-", -1).otherwise(1)
    delay, at = rf"^delay:\s*{_STAMP}", rf"^timestamp:\s*{_STAMP},\s*filepos:\s*([0-9A-Fa-f]+)"
    track = r"^id:\s*(\w*),\s*index:\s*(\d+)"
    seen = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns(
        {
            "is_id": F.col("line").startswith("id:"), "is_track": F.col("line").rlike(track), "late": F.when(F.col("line").rlike(delay), stamp(delay)).otherwise(0),
            "own": F.when(F.col("line").rlike(at), stamp(at)), "pos": F.when(F.col("line").rlike(at), F.conv(part(at, 6), 16, 10).cast("long")),
        }
    )
    rows = rows.withColumns({"reset": F.sum(F.col("is_id").cast("int")).over(seen), "tracks": F.sum(F.col("is_track").cast("int")).over(seen)})
    within = Window.partitionBy("file", "reset").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("is_track"), c), ignorenulls=True).over(seen)
    rows = rows.withColumns({"offset": F.sum("late").over(within), "lang": F.coalesce(last(part(track, 1)), F.lit("")), "stream_index": F.coalesce(last(part(track, 2).cast("int")), F.lit(0))})
    rows = rows.where("own is not null").withColumn("track_no", F.greatest(F.col("tracks") - 1, F.lit(0)).cast("int"))
    entry = F.row_number().over(Window.partitionBy("file", "track_no").orderBy("line_no")) - 1
    return rows.select("file", "track_no", "lang", "stream_index", entry.alias("entry_no"), (F.col("own") + F.col("offset")).alias("ms"), F.col("pos").alias("filepos"))


@dataclass
class Track:
    lang: str
    stream: int
    entries: list[tuple[int, int]] = field(default_factory=list)


def parse_index(text: str) -> tuple[tuple[int, int], list[tuple[int, int, int]], list[Track]]:
    """Frame size, sixteen palette colours (padded with black) and tracks of an index text."""
    size, colors, tracks, shift = (720, 576), [], [], 0
    for line in filter(None, map(str.strip, text.splitlines())):
        name, _, rest = line.partition(":")
        stamp = re.match(_STAMP, rest.strip())
        ms = 0
        if stamp:
            hours, minutes, seconds, milli = map(int, stamp.groups()[1:])
            ms = (hours * 3600 + minutes * 60 + seconds) * 1000 + milli
            ms = -ms if stamp[1] else ms
        if name == "size":
            size = tuple(map(int, rest.strip().split("x")))
        elif name == "palette":
            colors = [tuple(bytes.fromhex(c.strip()[:6])) for c in rest.split(",")]
        elif name == "id":
            shift = 0
            if m := re.match(r"\s*(\w*),\s*index:\s*(\d+)", rest):
                tracks.append(Track(m[1], int(m[2])))
        elif name == "delay" and stamp:
            shift += ms
        elif name == "timestamp" and stamp and (m := re.search(r",\s*filepos:\s*([0-9A-Fa-f]+)", rest)):
            if not tracks:
                tracks.append(Track("", 0))
            tracks[-1].entries.append((ms + shift, int(m[1], 16)))
    return size, colors + [(0, 0, 0)] * (16 - len(colors)), tracks


def demux(data: bytes, at: int, stream: int) -> bytes | None:
    """The subpicture unit whose first packet is at or after ``at``: private stream 1, substream 0x20 + ``stream``.

    Follows start codes of a program stream, resynchronising byte by byte; a unit cut off by the end of
    the data is returned as far as it goes, none at all as None.
    """
    parts, have, want = [], 0, None
    while (at := data.find(b"\0\0\1", at)) >= 0 and at + 4 <= len(data):
        code = data[at + 3]
        if code == 0xBA and at + 14 <= len(data):
            at += 14 + (data[at + 13] & 7) if data[at + 4] >> 6 == 1 else 12
        elif code == 0xB9:
            at += 4
        elif code == 0xBA or at + 6 > len(data):
            break
        else:
            end = at + 6 + int.from_bytes(data[at + 4 : at + 6], "big")
            if code == 0xBD and at + 9 <= len(data):
                body = data[at + 9 + data[at + 8] : end]
                if body[:1] == bytes([0x20 + stream]):
                    parts.append(body[1:])
                    have += len(body) - 1
                    if want is None and len(body) >= 3:
                        want = int.from_bytes(body[1:3], "big")
                    if want is not None and have >= want:
                        return b"".join(parts)[:want]
            at = end
    return b"".join(parts) if want and have else None


def run_lengths(data: bytes, offset: int, width: int, rows: int) -> np.ndarray:
    """Decode one field of ``rows`` rows: codes of 1 to 4 nibbles are length * 4 + colour, length 0 goes to the row's end."""
    out = np.zeros((rows, width), dtype=np.uint8)
    nibbles = np.stack([np.frombuffer(data, np.uint8) >> 4, np.frombuffer(data, np.uint8) & 15], axis=1).ravel().tolist()
    limit, at = len(nibbles), 2 * offset
    nibbles += [0] * 4
    for y in range(rows):
        x = 0
        while x < width and at < limit:
            code, used = nibbles[at], 1
            while used < 4 and code < 1 << 2 * used:  # a leading zero pair asks for one more nibble
                code = code << 4 | nibbles[at + used]
                used += 1
            at += used
            length = code >> 2 or width - x
            out[y, x : x + length] = code & 3
            x += length
        at += at & 1
    return out


_SIZES = {0x00: 0, 0x01: 0, 0x02: 0, 0x03: 2, 0x04: 2, 0x05: 6, 0x06: 4}


def decode_unit(unit: bytes, palette: list[tuple[int, int, int]]) -> dict:
    """Image and attributes of a subpicture unit: h, w, px, colors, alpha, x, y, start, stop (ms), forced."""
    colors, alpha, area, fields = [0, 1, 2, 3], [0, 15, 15, 15], (0, -1, 0, -1), (0, 0)
    start, stop, forced, seen = 0, None, False, set()
    at = int.from_bytes(unit[2:4], "big")
    nibbles = lambda two: [two[1] & 15, two[1] >> 4, two[0] & 15, two[0] >> 4]
    while at not in seen and at + 4 <= len(unit):
        seen.add(at)
        ms = int.from_bytes(unit[at : at + 2], "big") * 1024 // 90
        p = at + 4
        while p < len(unit) and unit[p] <= 0x07:
            command = unit[p]
            size = int.from_bytes(unit[p + 1 : p + 3], "big") if command == 0x07 else _SIZES[command]
            rest = unit[p + 1 : p + 1 + size]
            if command < 0x02:
                start, forced = ms, forced or command == 0x00
            elif command == 0x02:
                stop = ms
            elif command == 0x03 and size == len(rest):
                colors = nibbles(rest)
            elif command == 0x04 and size == len(rest):
                alpha = nibbles(rest)
            elif command == 0x05 and size == len(rest):
                x, y = int.from_bytes(rest[:3], "big"), int.from_bytes(rest[3:], "big")
                area = (x >> 12, x & 0xFFF, y >> 12, y & 0xFFF)
            elif command == 0x06 and size == len(rest):
                fields = (int.from_bytes(rest[:2], "big"), int.from_bytes(rest[2:], "big"))
            p += 1 + size
        at = int.from_bytes(unit[at + 2 : at + 4], "big")
    w, h = max(area[1] - area[0] + 1, 0), max(area[3] - area[2] + 1, 0)
    image = np.zeros((h, w), dtype=np.uint8)
    if w and h:
        image[0::2] = run_lengths(unit, fields[0], w, (h + 1) // 2)
        image[1::2] = run_lengths(unit, fields[1], w, h // 2)
    return {"h": h, "w": w, "px": image.tobytes(), "colors": [palette[i] for i in colors], "alpha": alpha, "x": area[0], "y": area[2], "start": start, "stop": stop, "forced": forced}


def cues(name: str, index: bytes, data: bytes, track: int) -> Iterator[tuple]:
    """Rows of ``CUES`` for one track; units that can't be read leave holes in the numbers, ends may be null; no rows for a track that isn't there."""
    _, palette, tracks = parse_index(index.decode("latin-1"))
    if track >= len(tracks):
        return
    chosen = tracks[track]
    for number, (ms, place) in enumerate(chosen.entries):
        unit = demux(data, place, chosen.stream)
        if unit:
            u = decode_unit(unit, palette)
            yield (name, number, ms + u["start"], ms + u["stop"] if u["stop"] else None, (u["h"], u["w"], u["px"]), u["colors"], u["alpha"], u["x"], u["y"], u["forced"])


@dataclass
class _Pair(InputPartition):
    path: str


class VobSub(DataSource):
    """Option path: a file or folder that executors can open; option track: which track, from 0."""

    @classmethod
    def name(cls) -> str:
        return "vobsub"

    def schema(self) -> str:
        return CUES

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("vobsub")`` known to a session; :func:`read_vobsub` needs no registration and opens any file system."""
    spark.dataSource.register(VobSub)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.track = options["path"], int(options.get("track", 0))

    def partitions(self):
        if os.path.isdir(self.path):
            return [_Pair(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".idx")]
        return [_Pair(self.path)]

    def read(self, partition):
        base = partition.path[: -len(".idx")]
        if not os.path.isfile(base + ".sub"):
            raise FileNotFoundError(f"{base}.sub stands beside no index")
        with open(partition.path, "rb") as i, open(base + ".sub", "rb") as d:
            yield from cues(os.path.basename(partition.path), i.read(), d.read(), self.track)


def pair_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (base, idx, sub) of the index and picture files under ``path``, which any of Spark's file systems may hold; one is null where it is missing."""
    places = [path, path[: -len(".idx")] + ".sub"] if path.endswith(".idx") else [path]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{idx,sub}").load(places).select("path", "content")
    content = lambda end: F.first(F.when(F.col("path").endswith(end), F.col("content")), ignorenulls=True).alias(end[1:])
    return files.groupBy(F.regexp_replace("path", r"\.(idx|sub)$", "").alias("base")).agg(content(".idx"), content(".sub"))


def read_vobsub(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """Cues of all pairs at ``path``, with missing and overlong ends filled; a file without its partner gives none (see :func:`pair_files`)."""
    kinds = to_arrow_schema(T.StructType.fromDDL(CUES))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, index, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for row in cues(os.path.basename(base) + ".idx", index, data, track):
                    cue = dict(zip(kinds.names, row, strict=True))
                    cue["image"] = dict(zip(("h", "w", "px"), cue["image"], strict=True))
                    cue["colors"] = [dict(zip("rgb", c, strict=True)) for c in cue["colors"]]
                    rows.append(cue)
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    whole = pair_files(spark, path).where("idx is not null and sub is not null")
    return fill_end_times(whole.mapInArrow(decode, CUES), "file", ["cue"])
