"""Messy delimited exports: encodings, delimiters, headers and provenance."""

from __future__ import annotations

import csv
import fnmatch
import io
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.functions.normalize import kpi_number
from opsframe.functions.text import base_name, blank_if_null, named
from opsframe.operators.quality import drop_blank_rows
from opsframe.session import ensure_checkpoints
from opsframe.sources.files import file_splits, filesystem, list_files

# Candidate delimiters in order of preference, encodings tried in order, characters judged for the delimiter.
DELIMITERS = [",", ";", "\t", "|"]
ENCODINGS = ["UTF-8", "GB18030", "BIG5"]
UNKNOWN = "unknown(replace)"
SAMPLE = 4096

SPLIT = 32 << 20  # fixed value: bytes of a file that one task reads at a time
PIECE = 1 << 20  # fixed value: bytes decoded at a time
ROWS = 10_000  # fixed value: rows per Arrow batch
_QUOTE, _LF, _CR = 34, 10, 13
_MAY_OPEN = np.isin(np.arange(256), [ord(c) for c in ',;\t|"\n\r'])
SCANNED = ("path string, size bigint, start bigint, stop bigint, quotes bigint, records0 bigint, records1 bigint, odd0 boolean, odd1 boolean, "
           "utf8 boolean, gb boolean, big5 boolean, head binary")


def any_case(pattern: str, name: str) -> bool:
    return fnmatch.fnmatch(name.lower(), pattern.lower())


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes, and of the line feeds outside quotes, when the data starts inside or outside of a quoted cell."""
    quotes, feeds = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _LF)
    return quotes, feeds[(np.searchsorted(quotes, feeds) + inside) % 2 == 0]


def _records(data: np.ndarray, feeds: np.ndarray, first: bool, length: int) -> int:
    """Records that start within the first ``length`` bytes and are not blank lines; the data may go on behind them."""
    starts = feeds + 1
    starts = np.concatenate([[0], starts]) if first else starts
    starts = starts[starts < length]
    nxt = data[starts]
    after = data[np.minimum(starts + 1, len(data) - 1)]
    blank = (nxt == _LF) | ((nxt == _CR) & (after == _LF) & (starts + 1 < len(data)))
    return int((~blank).sum())


def _odd(data: np.ndarray, quotes: np.ndarray, inside: bool, before: int) -> bool:
    """Whether a quote opens in the middle of a cell (then quotes do not simply alternate), or a carriage return stands alone."""
    opening = quotes[int(inside)::2]
    previous = np.where(opening > 0, data[np.maximum(opening - 1, 0)], before)
    if not _MAY_OPEN[previous].all():
        return True
    returns = np.flatnonzero(data[:-1] == _CR)
    alone = returns[data[returns + 1] != _LF]
    return bool(((np.searchsorted(quotes, alone) + inside) % 2 == 0).any())


def _read(stream, start: int, stop: int) -> bytes:
    stream.seek(start)
    return stream.read(max(0, stop - start))


def _to_next_line(stream, at: int, size: int) -> bytes:
    """Bytes from ``at`` through the next line feed, or to the end."""
    out = b""
    while at < size:
        piece = _read(stream, at, min(size, at + 65536))
        cut = piece.find(b"\n")
        if cut >= 0:
            return out + piece[:cut + 1]
        out, at = out + piece, at + len(piece)
    return out


def _decodes(data: bytes, charset: str) -> bool:
    try:
        data.decode(charset)
    except UnicodeDecodeError:
        return False
    return True


def _header_bytes(stream, size: int) -> bytes:
    """At least ``SAMPLE`` characters from the start of a file, and its first record that is not blank, whole."""
    length = 4 * SAMPLE
    while True:
        head = _read(stream, 0, min(size, length))
        data = np.frombuffer(head, np.uint8)
        _, feeds = _outside(data, False)
        starts = [0, *(feeds + 1).tolist()]
        if length >= size or any(head[a:b].strip(b" \t\r\n\xef\xbb\xbf") for a, b in zip(starts, starts[1:])):
            return head
        length *= 4


def scan_splits(splits: DataFrame, root: str) -> DataFrame:
    """What each byte range tells without knowing whether it starts inside a quoted cell: its quotes, the records that start in
    it in either case, which encodings its lines decode in, and at a file's start the bytes around its header."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(root)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as stream:
                    start, stop, size = row["start"], row["stop"], row["size"]
                    low = max(0, start - 1)
                    raw = _read(stream, low, min(size, stop + 2))
                    lead = start - low
                    mark = 3 if start == 0 and raw.startswith(b"\xef\xbb\xbf") else 0
                    data = np.frombuffer(raw, np.uint8)
                    before = int(data[0]) if lead else _LF
                    data, length = data[lead + mark:], stop - start - mark
                    own = data[:length]
                    quotes, feeds = _outside(own, False)
                    feeds = [feeds, _outside(own, True)[1]]
                    # a record that starts at the first byte belongs here if a line feed outside quotes stands before it
                    counts = [_records(data, f, start == 0 or (before == _LF and not k), length) if len(own) else 0
                              for k, f in enumerate(feeds)]
                    odd = [_odd(data, quotes, bool(k), before) if len(own) else False for k in (0, 1)]
                    # whole lines: from behind the first line feed to the one behind the end
                    text = raw[lead + mark:lead + stop - start]
                    if start and before != _LF:
                        cut = text.find(b"\n")
                        text = text[cut + 1:] if cut >= 0 else b""
                    if text and not text.endswith(b"\n"):
                        text += _to_next_line(stream, stop, size)
                    plain = text.isascii()
                    yield pa.RecordBatch.from_pylist([{
                        **row, "quotes": len(quotes), "records0": counts[0], "records1": counts[1], "odd0": odd[0], "odd1": odd[1],
                        "utf8": plain or _decodes(text, "utf-8"), "gb": plain or _decodes(text, "gb18030"), "big5": plain or _decodes(text, "big5"),
                        "head": _header_bytes(stream, size) if start == 0 else None}], schema)

    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SCANNED.split(", ")])
    return splits.mapInArrow(work, SCANNED)


def judge(head: bytes, charset: str, sep: str | None = None) -> tuple[str, str, list[str], int]:
    """Delimiter, header line, its cells, and the number of records through the header, from the start of a file.

    The first 4096 characters are judged together; where their lines do not agree, the header line alone decides.
    """
    text = head.decode("utf-8" if charset == UNKNOWN else charset, "replace").removeprefix("﻿")
    if sep is None:
        try:
            sep = csv.Sniffer().sniff(text[:SAMPLE], delimiters="".join(DELIMITERS)).delimiter
        except csv.Error:
            lines = [line for line in text.splitlines() if line.strip()]
            bare = "".join(lines[0].split('"')[::2]) if lines else ""
            sep = max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))
    csv.field_size_limit(sys.maxsize)
    source = io.StringIO(text, newline="")
    taken = []

    def lines():
        for line in source:
            taken.append(line)
            yield line

    seen = 0
    for cells in csv.reader(lines(), delimiter=sep):
        if cells and any(c.strip() for c in cells):
            return sep, "".join(taken).strip("\r\n"), [c.strip() for c in cells], seen + 1
        seen += bool(cells)
        taken.clear()
    return sep, "", [], seen


def _judged(scanned: DataFrame, encoding: str | None, sep: str | None) -> DataFrame:
    """One row per file: its encoding, delimiter, header line, header cells, and records through the header."""
    files = scanned.groupBy("path").agg(*[F.bool_and(c).alias(c) for c in ("utf8", "gb", "big5")], F.max("head").alias("head"))
    found = F.when(F.col("utf8"), "UTF-8").when(F.col("gb"), "GB18030").when(F.col("big5"), "BIG5").otherwise(UNKNOWN)
    files = files.select("path", (F.lit(encoding) if encoding else found).alias("encoding"), F.coalesce("head", F.lit(b"")).alias("head"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(head, charset, sep) for charset, head in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64())],
                names=["file", "encoding", "sep", "header", "cells", "through"])

    return files.mapInArrow(work, "file string, encoding string, sep string, header string, cells array<string>, through bigint")


def _scan(spark: SparkSession, path: str, pattern: str, recursive: bool, split: int) -> DataFrame:
    """Scanned byte ranges of the matching files; files in folders that begin with ``_`` or ``.``, and ``.`` files, stay out."""
    ensure_checkpoints(spark)
    files = list_files(spark, path, recursive, lambda n: n[0] not in "_.", lambda n: n[0] != "." and any_case(pattern, n))
    splits = file_splits(files, split).checkpoint()
    tasks = max(1, min(splits.count(), spark.sparkContext.defaultParallelism * 64))
    return scan_splits(splits.repartition(tasks), path)


def profile_files(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = False, split: int = SPLIT,
                  encoding: str | None = None, sep: str | None = None) -> DataFrame:
    """``file, encoding, sep, header, cells, through`` per export.

    Encodings are judged line by line within byte ranges and combined per file, so a large file is spread over many tasks
    and one small record per file remains.  None of the candidate encodings uses the line-feed byte inside a character.
    The delimiter is judged on the first 4096 characters.  The header is the first record that is not blank; ``through``
    counts the records up to and with it.
    """
    return _judged(_scan(spark, path, pattern, recursive, split), encoding, sep)


def _with_state(scanned: DataFrame) -> DataFrame:
    """Adds whether a byte range starts inside a quoted cell, and how many records start before it in its file.

    Quotes alternate, so the parity of all quotes before a range fixes its state.  Where a quote opens in the middle of a
    cell, or a carriage return ends a line, the file is read as one range.
    """
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("path")
    state = scanned.drop("head").withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    state = state.withColumns({"records": F.when(F.col("inside"), F.col("records1")).otherwise(F.col("records0")),
                               "odd": F.bool_or(F.when(F.col("inside"), F.col("odd1")).otherwise(F.col("odd0"))).over(whole_file)})
    state = state.withColumn("base", F.coalesce(F.sum("records").over(before), F.lit(0)))
    return state.filter(~F.col("odd") | (F.col("start") == 0)).select(
        "path", "size", "start", F.when(F.col("odd"), F.col("size")).otherwise(F.col("stop")).alias("stop"), "inside", "base")


def _own_lines(stream, row: Mapping, charset: str) -> Iterator[str]:
    """Lines of the records that start in a byte range, read on to the end of the last one.

    Text is decoded piece by piece between line feeds, so a range of any length takes little memory.
    """
    start, stop, size, inside = row["start"], row["stop"], row["size"], row["inside"]
    at = start
    if start and (inside or _read(stream, start - 1, start) != b"\n"):  # the range starts within another one's record
        while True:
            piece = _read(stream, at, min(stop, at + PIECE))
            quotes, feeds = _outside(np.frombuffer(piece, np.uint8), inside)
            if len(feeds):
                at += int(feeds[0]) + 1
                break
            inside ^= len(quotes) % 2 == 1
            at += len(piece)
            if at >= stop:
                return
        if at >= stop:
            return
        inside = False
    rest, step = b"", PIECE
    while at < size:
        piece = rest + _read(stream, at, min(size, at + step))
        base = at - len(rest)
        at = base + len(piece)
        quotes, feeds = _outside(np.frombuffer(piece, np.uint8), inside)
        over = feeds[base + feeds + 1 >= stop]  # the first border of records at or behind the range's end
        if len(over):
            yield from io.StringIO(piece[:int(over[0]) + 1].decode(charset, "replace"), newline="")
            return
        end = len(piece) if at >= size else piece.rfind(b"\n") + 1
        rest, step = piece[end:], PIECE if end else 2 * step  # a long line is looked at again with twice as much
        if end:
            inside ^= int(np.searchsorted(quotes, end)) % 2 == 1
            yield from io.StringIO(piece[:end].decode(charset, "replace"), newline="")


def read_exports(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = False,
                 alias: Mapping[str, str] | None = None, required: Sequence[str] = (), drop_blank: bool = True,
                 profile: DataFrame | None = None, encoding: str | None = None, sep: str | None = None,
                 with_path: bool = False, split: int = SPLIT) -> DataFrame:
    """All exports of a folder as one text table, with ``__source__`` (file name) and ``__row__`` (1-based).

    Files are read in byte ranges of ``split`` bytes, quoted line breaks included: a first pass counts quotes and records
    per range, running sums over a file's ranges tell where each starts, and every range is then cut into records alone.
    Columns are united by name in the order in which files (by name) first show them; rows are placed under them where
    they are read, so any number of different headers is one scan.  Files lacking a required column are left out
    (:func:`rejected_files` lists them).  What reaches the driver is each distinct header.

    Cells are taken by their place under the header: a repeated name becomes ``name_2``, an empty one ``_c`` and its
    place; short rows are padded, surplus cells ignored.  Files whose names begin with ``_`` are read at any depth; those
    that begin with ``.``, and folders that begin with either, are not (:func:`hidden_files` lists them).  ``with_path``
    adds ``__path__``, which tells files of one name in different folders apart.  A given ``encoding`` or ``sep`` replaces
    what was found.
    """
    alias = dict(alias or {})
    scanned = _scan(spark, path, pattern, recursive, split).checkpoint()
    prof = profile if profile is not None else _judged(scanned, encoding, sep)
    prof = prof.withColumn("encoding", F.lit(encoding)) if encoding else prof
    heads = prof.filter("header <> ''").groupBy("cells").agg(F.min("file").alias("first")).orderBy("first").collect()
    data: list[str] = []
    for r in heads:
        columns = header_columns(r["cells"], alias)
        if all(c in columns for c in required):
            data += [c for c in columns if c not in data]
    names = [*(data or required), "__source__", "__row__", *(["__path__"] if with_path else [])]
    schema = ", ".join(f"`{c.replace('`', '``')}` {'bigint' if c == '__row__' else 'string'}" for c in names)
    if not data:
        return spark.createDataFrame([], schema)
    ranges = _with_state(scanned).join(prof.filter("header <> ''").withColumnRenamed("file", "path"), "path")
    ranges = ranges.select("path", "size", "start", "stop", "inside", "base", "encoding", "sep", "cells", "through").checkpoint()
    tasks = max(1, min(ranges.count(), spark.sparkContext.defaultParallelism * 64))
    target = {c: i for i, c in enumerate(data)}
    typed = pa.schema([(c, pa.int64() if c == "__row__" else pa.string()) for c in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        system, _ = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                columns = header_columns(row["cells"], alias)
                if any(c not in columns for c in required):
                    continue
                charset = "utf-8" if row["encoding"] == UNKNOWN else row["encoding"]
                places = [target[c] for c in columns]
                source = row["path"].rsplit("/", 1)[-1]
                with system.open_input_file(row["path"]) as stream:
                    lines = _own_lines(stream, row, charset)
                    lines = _without_mark(lines) if row["start"] == 0 else lines
                    held: list[list] = []
                    number = row["base"] - row["through"]
                    for cells in csv.reader(lines, delimiter=row["sep"]):
                        if not cells:
                            continue
                        number += 1
                        if number < 1:
                            continue
                        out = [""] * len(data)
                        for place, cell in zip(places, cells):
                            out[place] = cell
                        held.append([*out, source, number, *([row["path"]] if with_path else [])])
                        if len(held) == ROWS:
                            yield _batch(held, typed)
                            held = []
                    if held:
                        yield _batch(held, typed)

    out = ranges.repartition(tasks).mapInArrow(work, schema)
    return drop_blank_rows(out, data) if drop_blank else out


def _without_mark(lines: Iterator[str]) -> Iterator[str]:
    first = next(lines, None)
    if first is not None:
        yield first.removeprefix("﻿")
        yield from lines


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def header_columns(cells: Sequence[str], alias: Mapping[str, str]) -> list[str]:
    """Names of a header's cells, each once."""
    return distinct_names([alias.get(h.strip(), h.strip()) for h in cells])


def distinct_names(names: Sequence[str]) -> list[str]:
    out: list[str] = []
    for place, name in enumerate(names):
        name, turn = name or f"_c{place}", 2
        free = name
        while free in out:
            free, turn = f"{name}_{turn}", turn + 1
        out.append(free)
    return out


def hidden_files(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """``file, reason`` of the matching files that are not read: names beginning with ``.``, and folders beginning with ``_`` or ``.``."""
    found = list_files(spark, path, recursive, take=lambda n: any_case(pattern, n.lstrip(".")) or any_case(pattern, n))
    parts = F.split("rel_path", "/")
    hidden_folder = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.rlike("^[_.]"))
    return found.filter(hidden_folder | F.element_at(parts, -1).startswith(".")).select(
        F.col("rel_path").alias("file"), F.when(hidden_folder, "所在文件夹以下划线或点开头，不会被读取").otherwise("文件名以点开头，不会被读取").alias("reason"))


def merge_exports(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name in first-seen order; cells a table lacks are empty text."""
    out = None
    for df in tables:
        part = df.select(*[blank_if_null(named(c)).alias(c) for c in df.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*[blank_if_null(named(c)).alias(c) for c in out.columns])


def alias_columns(df: DataFrame, alias: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: alias.get(c.strip(), c.strip()) for c in df.columns})


def rejected_files(profile: DataFrame, rows: DataFrame, amount: str, alias: Mapping[str, str] | None = None) -> DataFrame:
    """Files that deliver nothing, with the reason: no header, no amount column, or no usable amount.

    ``rows`` is the united table, read ``with_path`` where folders hold files of one name; only one usable-row count per file is compared with the file list.
    """
    names = F.col("cells")
    for old, new in (alias or {}).items():
        names = F.transform(names, lambda h, o=old, n=new: F.when(h == o, n).otherwise(h))
    whole = "__path__" in rows.columns  # else files are known by name alone
    files = profile.select(base_name("file").alias("file"), (F.col("file") if whole else base_name("file")).alias("_known"), names.alias("_names"), "header")
    cell = kpi_number(amount) if amount in rows.columns else F.lit(None)
    usable = rows.groupBy(F.col("__path__" if whole else "__source__").alias("_known")).agg(F.count(cell).alias("_usable"))
    joined = files.join(usable, "_known", "left")
    reason = (
        F.when(F.col("header") == "", "空文件")
        .when(~F.array_contains("_names", amount),
              F.concat(F.lit(f"缺列「{amount}」，现有列："), F.array_join("_names", "/")))
        .when(F.coalesce("_usable", F.lit(0)) == 0, "没有可用金额行")
    )
    return joined.select("file", reason.alias("reason")).filter("reason IS NOT NULL")


def read_history(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A snapshot log; a log that does not exist yet is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", "true").option("escape", '"') if fmt == "csv" else reader).load(path)
