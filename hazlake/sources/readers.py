"""Readers of report files. Every column comes back as text, with the file's name and row number."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hazlake.session import cut
from hazlake.sources.audit import WRAPPERS, audit_files, file_name

# Cell texts read as missing
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
OFFSET_ROWS = 500_000  # split offsets one task may hold


def blank_missing(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(F.col(f"`{c}`").isin(*MISSING), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
            if t == "string"
            else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def as_strings(df: DataFrame, keep: tuple[str, ...] = ("source_dataset", "row_index")) -> DataFrame:
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if name in keep:
            return c
        return (F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")).alias(name)

    return df.select(*[text(n, k) for n, k in df.dtypes])


def number_rows(df: DataFrame) -> DataFrame:
    """Row number within each file, counted over the splits the file was read in.

    Rows of a split are numbered where they are read; what is joined back is one offset per split. The numbered rows are
    written first: both sides of that join must see the same packing of files into tasks, also after a retry.
    """
    placed = cut(df.withColumns(
        {
            "_pid": F.spark_partition_id(),
            "_at": F.monotonically_increasing_id(),
            "_start": F.col("_metadata.file_block_start"),
        }
    ))
    splits = placed.groupBy("source_dataset", "_pid", "_start").agg(
        F.min("_at").alias("_low"), F.count("*").alias("_n")
    )
    before = Window.partitionBy("source_dataset").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "source_dataset", "_pid", "_start", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # a broadcast of checked size spares moving the rows; both joins give the same rows
    small = offsets.limit(OFFSET_ROWS + 1).count() <= OFFSET_ROWS
    joined = placed.join(F.broadcast(offsets) if small else offsets, ["source_dataset", "_pid", "_start"])
    return joined.withColumn("row_index", F.col("_at") - F.col("_low") + F.col("_before")).drop(
        "_pid", "_at", "_start", "_low", "_before"
    )


def csv_groups(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """Files that can be read together, as (encoding, paths): same first line, same encoding.

    A file is Latin-1 if one of its lines is not valid UTF-8. Lines are checked where they are
    read; a name, a header and a flag per file come back.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    files = lines.groupBy("path").agg(
        F.min_by(F.make_valid_utf8("value"), "at").alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    )
    groups: dict[tuple, list[str]] = {}
    for r in files.orderBy("path").collect():
        groups.setdefault((r["header"], r["utf8"]), []).append(r["path"])
    return [("UTF-8" if utf8 else "ISO-8859-1", members) for (_, utf8), members in groups.items()]


def read_csv(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """CSV files with a header, in UTF-8 or else in Latin-1.

    Files of one header are read together; different headers are stacked by name. Quoted line
    breaks need ``multi_line``; large files without them are split if it is off.
    """
    frames = []
    for encoding, members in csv_groups(spark, paths):
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        frame = reader.option("encoding", encoding).csv(members)
        numbered = number_rows(frame.withColumn("source_dataset", file_name(F.col("_metadata.file_path"))))
        frames.append(blank_missing(numbered.withColumnRenamed("_c0", "Unnamed: 0")))
    return stack(frames)


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    frame = spark.read.option("mergeSchema", True).parquet(*paths)
    numbered = frame.withColumns(
        {"source_dataset": file_name(F.col("_metadata.file_path")), "row_index": F.col("_metadata.row_index")}
    )
    return as_strings(numbered)


def read_json(spark: SparkSession, paths: list[str], unwrap: bool = True) -> DataFrame:
    """JSON files holding a list of objects, or an object around one (``unwrap``)."""
    texts = spark.read.text(paths, wholetext=True).withColumn("source_dataset", file_name(F.col("_metadata.file_path")))
    options = [F.when(F.col("value").rlike(r"^\s*\["), F.col("value"))]
    if unwrap:
        options = [F.when(F.get_json_object("value", f"$.{w}").rlike(r"^\s*\["), F.get_json_object("value", f"$.{w}")) for w in WRAPPERS] + options
    records = texts.select(
        "source_dataset",
        F.posexplode(F.from_json(F.coalesce(*options), "array<map<string,string>>")).alias("row_index", "record"),
    )
    # the header is the set of keys, a small thing next to the rows
    names = sorted(
        r[0] for r in records.select(F.explode(F.map_keys("record")).alias("k")).distinct().collect()
    )
    return records.select(
        *[F.col("record")[n].alias(n) for n in names], "source_dataset", F.col("row_index").cast("bigint")
    )


def _sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of an .xlsx file, as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in root.iter(f"{space}si")]
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        sheet = ElementTree.fromstring(book.read(sheets[0]))
    rows = []
    for row in sheet.iter(f"{space}row"):
        cells: dict[int, str | None] = {}
        for at, cell in enumerate(row.iter(f"{space}c")):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            column = at
            if letters:
                column = 0
                for ch in letters.group():
                    column = column * 26 + ord(ch) - 64
                column -= 1
            value = cell.find(f"{space}v")
            if cell.get("t") == "s" and value is not None:
                cells[column] = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                cells[column] = "".join(t.text or "" for t in cell.iter(f"{space}t"))
            else:
                cells[column] = value.text if value is not None else None
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def _explode_sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _sheet_rows(bytes(content))
            if len(rows) < 2:
                continue
            header = [h or f"Unnamed: {i}" for i, h in enumerate(rows[0])]
            records = [{h: v for h, v in zip(header, row) if v not in MISSING and v is not None} for row in rows[1:]]
            name = path.rsplit("/", 1)[-1]
            yield pd.DataFrame({"source_dataset": name, "row_index": range(len(records)), "record": records})


def read_xlsx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First sheet of each workbook; a workbook is one task's work, as it is one compressed file."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    records = files.mapInPandas(
        _explode_sheets, "source_dataset string, row_index bigint, record map<string,string>"
    )
    names = sorted(r[0] for r in records.select(F.explode(F.map_keys("record"))).distinct().collect())
    return records.select(*[F.col("record")[n].alias(n) for n in names], "source_dataset", "row_index")


def stack(frames: list[DataFrame]) -> DataFrame:
    """Tables one under the other, columns matched by name."""
    if not frames:
        raise FileNotFoundError("no report tables found")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


READERS = {".csv": read_csv, ".parquet": read_parquet, ".json": read_json, ".xlsx": read_xlsx}


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All report tables of a folder, stacked with their origin. Only file names reach the driver."""
    audit = audit_files(spark, folder).filter("is_valid")
    paths = sorted(r[0] for r in audit.select("path").collect())
    frames = []
    for ext, reader in READERS.items():
        own = [p for p in paths if p.endswith(ext)]
        if own:
            frames.append(reader(spark, own))
    return stack([as_strings(f) for f in frames])
