"""Delimited text whose quoted fields hold line breaks, read by many tasks per file.

Spark splits a file at line breaks, so a split may begin inside a quoted field. Whether it
does depends on all text before it, which no task has. But a split maps the two ways it may
begin (inside quotes or at a record) to a way it ends, and these maps compose: a first pass
finds each split's map, the driver chains them, one small row per split, and a second pass
cuts each split's records, knowing how it begins. A record that runs over splits is put
together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ends_inside(line: str, inside: bool, sep: str, quote: str = '"') -> bool:
    """Whether a line that begins inside quotes, or else at a record, ends inside quotes.

    A field is quoted if its first character is the quote; two quotes stand for one. After the
    closing quote the field runs on to the next separator, and a quote in a field that does not
    begin with one is a character like any other.
    """
    if not inside and quote not in line:
        return False
    at, end = 0, len(line)
    while True:
        if not inside:
            if line.startswith(quote, at):
                at, inside = at + 1, True
            else:
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
        while True:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            break
        # The quote closes its field where a separator or the line's end follows it.
        at += 1
        if at >= end or line[at:] == "\r":
            return False
        if line.startswith(sep, at):
            at, inside = at + len(sep), False
            continue
        # Anything else behind it belongs to the field, which is still open.


#: Lines that are Python objects at once, and characters of records that wait to be sent on.
LINES_AT_ONCE, TEXT_AT_ONCE = 256, 4_000_000


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """The rows of the batches; of a batch, which may be large, only a few lines are copied at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, LINES_AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, LINES_AT_ONCE).columns))


@dataclass
class _Split:
    """What a split does for each way it may begin: does it end inside quotes, does a record begin in it?"""

    file: str
    start: int
    ends: list[bool]
    has_record: list[bool]


def _split_maps(sep: str):
    names = ["file", "start", "ends", "has_record"]

    def packed(split: _Split) -> pa.RecordBatch:
        flags = pa.list_(pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array([split.file]), pa.array([split.start]), pa.array([split.ends], flags),
             pa.array([split.has_record], flags)], names)

    def split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Split | None = None
        for file, start, line in _lines(batches):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    yield packed(now)
                now = _Split(file, start, [False, True], [False, False])
            for way in (0, 1):
                now.has_record[way] |= not now.ends[way]
                now.ends[way] = ends_inside(line, now.ends[way], sep)
        if now is not None:
            yield packed(now)

    return split_maps


def _chained(maps: list) -> tuple[dict[tuple[str, int], int], set[tuple[str, int]]]:
    """Splits that begin inside quotes, with the split in which that record begins; splits whose last record runs on."""
    begins: dict[tuple[str, int], int] = {}
    open_: set[tuple[str, int]] = set()
    inside, file, owner = False, None, 0
    for row in sorted(maps, key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            inside, file = False, row["file"]
        if inside:
            begins[file, row["start"]] = owner
            open_.add((file, owner))
        if row["has_record"][inside]:
            owner = row["start"]
        inside = row["ends"][inside]
    return begins, open_


def _records(sep: str, header: bool, chained):
    """Whole records with a null key; parts of records over several splits with the key of their first split."""
    names = ["file", "owner", "part", "text"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, open_ = chained.value
        out: list[tuple] = []
        now, inside, held, first, waiting = None, False, [], False, 0

        def closed(last: bool) -> None:
            """The lines held are a record; the last one of a split may run on, the first may have begun before."""
            if not held or now is None:
                return
            text = "\n".join(held)
            owner = begins.get(now) if first else (now[1] if last and now in open_ else None)
            if owner is None and first is False and header and now[1] == 0 and not seen:
                seen.append(True)
                return
            out.append((now[0] if owner is not None else None, owner, now[1], text))

        seen: list[bool] = []
        for file, start, line in _lines(batches):
            if now != (file, start):
                closed(last=True)
                now, held, seen = (file, start), [], []
                inside = first = now in begins
            if not inside and held:
                closed(last=False)
                held, first = [], False
            if waiting >= TEXT_AT_ONCE:
                yield _packed(out, names)
                out, waiting = [], 0
            held.append(line)
            waiting += len(line)
            inside = ends_inside(line, inside, sep)
        closed(last=True)
        yield _packed(out, names)

    return records


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = False,
    **options: str,
) -> DataFrame:
    """Records of the files under ``path``; a header is the first record of each file and is left out.

    What comes to the driver is two flags per split, and what goes to the tasks is a few bytes for
    each split that begins inside quotes: at most some hundred bytes for every
    ``spark.sql.files.maxPartitionBytes`` of input. Blank lines outside quotes are no records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))
    maps = lines.mapInArrow(
        _split_maps(sep), "file string, start long, ends array<boolean>, has_record array<boolean>").collect()
    chained = spark.sparkContext.broadcast(_chained(maps))
    found = lines.mapInArrow(_records(sep, header, chained), "file string, owner long, part long, text string")
    whole = found.where("owner IS NULL").select("text")
    if chained.value[0]:
        parts = F.sort_array(F.collect_list(F.struct("part", "text")))
        joined = found.where("owner IS NOT NULL").groupBy("file", "owner").agg(parts.alias("parts")).select(
            F.array_join(F.transform("parts", lambda p: p.text), "\n").alias("text"))
        whole = whole.unionByName(joined)
    given = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **options}
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    record = F.regexp_replace("text", "\r$", "")
    # Names may hold blanks and dots, which a schema in words cannot.
    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    parsed = whole.select(record.alias("text")).where("text <> ''").select(
        F.from_csv("text", F.lit(plain), given).alias("r"))
    return parsed.select(*[F.col("r")[f"c{i}"].alias(f.name) for i, f in enumerate(fields)])
