"""Delimited logs with an unknown encoding, separator and header row.

Everything is settled for each file. One pass over all lines finds the encodings in which all of them can be
read, and for each likely separator how many lines agree on the number of cells; the first lines of the
files come from their first blocks. The data are then read once.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake import fixed_values as V

#: Separators that are tried besides the known ones when lines agree on them.
OTHER_SEPARATORS = ("|", "~", "^")
SEPARATORS = (*V.FILE_SEPARATORS, *OTHER_SEPARATORS)

# Spark's reader has no cp1251: its bytes are read one to one and then translated
_SPARK_ENCODING = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1251": "ISO-8859-1", "latin1": "ISO-8859-1"}
_HIGH_BYTES = bytes(range(128, 256))


def _readable(encoding: str) -> Column:
    """Whether a line can be decoded without loss."""
    if encoding.startswith("utf-8"):
        return F.is_valid_utf8("value")
    undefined = [bytes([b]) for b in _HIGH_BYTES if bytes([b]).decode(encoding, errors="replace") == "\ufffd"]
    out = F.lit(True)
    for byte in undefined:
        out = out & ~F.contains(F.col("value").cast("binary"), F.lit(byte))
    return out


@dataclass
class _File:
    name: str
    encodings: list[str]
    separators: list[tuple[str, int]]  # with the usual number of cells, those that most lines agree on first
    head: list[bytes]


def _files(spark: SparkSession, path: str, rows: int = 1) -> list[_File]:
    """What is known of every file with lines, by name, with its first ``rows`` lines."""
    # separators inside quotes don't count; bytes are compared, whatever the encoding
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = F.array(*[(F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(x), F.lit("")))).cast("int") for x in SEPARATORS])
    name = F.col("_metadata.file_path").alias("file")
    lines = spark.read.text(path).select(name, counts.alias("counts"), *[_readable(e).alias(e) for e in V.FILE_ENCODINGS])
    readable = [F.bool_and(f"`{e}`").alias(e) for e in V.FILE_ENCODINGS]
    shapes = lines.groupBy("file", "counts").agg(F.count(F.lit(1)).alias("n"), *readable)
    spread = shapes.select("file", "n", *[f"`{e}`" for e in V.FILE_ENCODINGS], F.posexplode("counts").alias("separator", "more"))
    agreed = spread.groupBy("file", "separator", "more").agg(F.sum("n").alias("n"), *readable)
    best = agreed.groupBy("file", "separator").agg(F.max(F.struct("n", "more")).alias("usual"), *readable)
    found: dict[str, dict] = {}
    for r in best.collect():  # one row per file and separator
        entry = found.setdefault(r.file, {"encodings": [e for e in V.FILE_ENCODINGS if r[e]], "usual": []})
        if r.usual.more:
            entry["usual"].append((-r.usual.n, -r.usual.more, r.separator))
    if not found:
        raise ValueError(f"no lines in {path}")
    heads = _heads(spark, path, rows)
    files = []
    for file in sorted(found):
        if not found[file]["encodings"]:
            raise ValueError(f"{file} is in none of {V.FILE_ENCODINGS}")
        files.append(_File(file, found[file]["encodings"], [(SEPARATORS[i], 1 - more) for _, more, i in sorted(found[file]["usual"])], heads[file]))
    return files


def _heads(spark: SparkSession, path: str, rows: int) -> dict[str, list[bytes]]:
    """The first lines of each file, as bytes, from its first split: ids grow by one along a split."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line")
    )
    tops = lines.groupBy("file").agg(F.min("id").alias("top"))
    first = lines.join(F.broadcast(tops), "file").where(F.col("id") < F.col("top") + rows)  # one row per file
    found = first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("lines")).collect()
    return {r.file: [bytes(x.line) for x in r.lines] for r in found}


def _cells(line: str, separator: str) -> list[str]:
    return [" ".join(cell.lstrip("﻿").split()) for cell in next(csv.reader([line], delimiter=separator), [])]


def _normalized(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cell, "﻿", ""), r"\s+", " "))


def _grouped(path: str, kinds: dict[str, tuple]) -> dict[tuple, str | list[str]]:
    """The files of each kind; the path itself if all are of one."""
    if len(set(kinds.values())) == 1:
        return {kind: path for kind in kinds.values()}
    out: dict[tuple, list[str]] = {}
    for file, kind in kinds.items():
        out.setdefault(kind, []).append(unquote(file))
    return out


def _header(file: _File, required: set[str]) -> tuple[str, str, tuple[str, ...]]:
    """(encoding, separator, header cells) of a file."""
    known = [x for x, _ in file.separators] + [x for x in V.FILE_SEPARATORS if x not in dict(file.separators)]
    for encoding in file.encodings:
        for separator in known:
            for line in file.head:
                cells = _cells(line.decode(encoding), separator)
                if required <= set(cells):
                    return encoding, separator, tuple(cells)
    raise ValueError(f"could not find the header row in {file.name}")


def read_with_header(spark: SparkSession, path: str, required, rows: int) -> DataFrame:
    """All-string frame under the files' own headers.

    A file's header is the first of its leading ``rows`` lines that holds all ``required`` names; a file without
    one raises. Separators are tried by the number of lines that agree on them. Files may differ in encoding, separator
    and order of columns; a column that a file lacks is null there. The files are read in parallel, and each drops its
    own lines up to its own header.
    """
    kinds = {f.name: _header(f, set(required)) for f in _files(spark, path, rows)}
    parts = [
        _below_header(spark, p, list(cells), separator, encoding, rows) for (encoding, separator, cells), p in _grouped(path, kinds).items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _raw(spark: SparkSession, path: str | list[str], width: int, separator: str, encoding: str) -> DataFrame:
    ddl = ", ".join(f"_c{i} string" for i in range(width))
    return (
        spark.read.schema(ddl)
        .option("sep", separator)
        .option("encoding", _SPARK_ENCODING[encoding])
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def in_cp1251(text: Column) -> Column:
    """A text as the bytes of cp1251, for files in that encoding."""
    return F.encode(F.translate(text, _HIGH_BYTES.decode("cp1251", errors="replace"), _HIGH_BYTES.decode("latin1")), "iso-8859-1")


def _decoded(cell: Column, encoding: str) -> Column:
    if encoding != "cp1251":
        return cell
    return F.translate(cell, _HIGH_BYTES.decode("latin1"), _HIGH_BYTES.decode("cp1251", errors="replace"))


def _below_header(spark, path, cells, separator, encoding, rows) -> DataFrame:
    # position inside a file: ids grow along a split, and only a file's first split holds its head
    raw = _raw(spark, path, len(cells), separator, encoding).select(
        *[_decoded(F.col(f"_c{i}"), encoding).alias(f"_c{i}") for i in range(len(cells))],
        F.col("_metadata.file_path").alias("_file"),
        (F.col("_metadata.file_block_start") == 0).alias("_first"),
        F.monotonically_increasing_id().alias("_id"),
    )
    here = F.array(*[F.coalesce(_normalized(F.col(f"_c{i}")), F.lit("")) for i in range(len(cells))])
    is_header = here == F.array(*[F.lit(c) for c in cells])
    heads = (
        raw.where("_first")
        .groupBy("_file")
        .agg(F.min("_id").alias("_top"), F.min(F.when(is_header, F.col("_id"))).alias("_header"))
        .withColumn(
            "_header",
            F.when(F.col("_header") - F.col("_top") < rows, F.col("_header")).otherwise(
                F.raise_error(F.concat(F.lit("no header row in "), F.col("_file"))).cast("bigint")
            ),
        )
    )
    data = raw.join(heads.select("_file", "_header"), "_file").where(~F.col("_first") | (F.col("_id") > F.col("_header")))
    return data.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(cells)])


def read_headerless(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string frame with assigned names, as many as the cells of each file's lines.

    The separator of a file is the one on which most of its lines agree that gives so many cells, or else the known one
    that splits its first line so; a file with neither raises.
    """
    kinds = {}
    for f in _files(spark, path):
        encoding = f.encodings[0]
        fitting = [x for x, n in f.separators if n == len(columns)]
        fitting += [x for x in V.FILE_SEPARATORS if len(_cells(f.head[0].decode(encoding), x)) == len(columns) > 1]
        if not fitting:
            raise ValueError(f"{f.name}: expected {len(columns)} columns")
        kinds[f.name] = (encoding, fitting[0])
    parts = [
        _raw(spark, p, len(columns), separator, encoding).select(*[_decoded(F.col(f"_c{i}"), encoding).alias(c) for i, c in enumerate(columns)])
        for (encoding, separator), p in _grouped(path, kinds).items()
    ]
    return reduce(DataFrame.unionByName, parts)
