"""Records of CSV files of any size, read in splits: quotes, line breaks in cells and exact row numbers without a file in one task.

A line alone can't tell whether it begins inside a quoted cell.  So each line that has quotes
gets a step: where it leads from outside a cell, and where from inside.  Steps are put
together over blocks of lines, and then over the blocks; most lines have no quotes and lead
nowhere else.  A quote that opens a cell counts only if the next quotes can close it: they
are followed by a comma or the line's end.  If not, the cell ends with its line, and this row
alone is flawed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.scan import running
from tidelane.storage import Tables

#: A quoted cell, the beginning of one, and any cell; without ways back, so long lines cost their length.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_WHOLE = _OPEN + '"'
_CELL = rf'(?:{_WHOLE}|(?:[^",][^,]*+)?)'
#: What a line that begins inside a cell holds of it.
_REST = r'[^"]*+(?:""[^"]*+)*+'


def _starts(text: Column) -> Column:
    """A line that begins outside a cell: closed, open (its last cell is not closed) or broken (something follows a closing quote)."""
    return F.when(text.rlike(rf"\A{_CELL}(?:,{_CELL})*+\z"), "closed").when(text.rlike(rf"\A(?:{_CELL},)*+{_OPEN}\z"), "open").otherwise("broken")


def _goes_on(text: Column) -> Column:
    """A line that begins inside a cell: stay (all of it is that cell), close, reopen (another one is open at its end) or bad."""
    closed = rf'\A{_REST}"(?:,{_CELL}(?=,|\z))*+'
    return F.when(text.rlike(rf"\A{_REST}\z"), "stay").when(text.rlike(rf"{closed}\z"), "close").when(text.rlike(rf"{closed},{_OPEN}\z"), "reopen").otherwise("bad")


def cells_of(text: Column) -> Column:
    """The cells of a record; quotes that don't enclose a whole cell are part of it, an open one ends with the record."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(rf",({_WHOLE}(?=,|\z)|{_OPEN}\z|[^,]*+)"), F.lit(1))
    inside = lambda c: F.regexp_replace(c, '""', '"')
    return F.transform(
        raw,
        lambda c: F.when(c.rlike(rf"\A{_WHOLE}\z"), inside(F.substring(c, F.lit(2), F.length(c) - 2))).when(c.rlike(rf"\A{_OPEN}\z"), inside(F.substring(c, F.lit(2), F.length(c) - 1))).otherwise(c),
    )


def decode(content: bytes) -> tuple[str, bool]:
    """UTF-8, or Shift_JIS where that fails; whether it fell back.  A byte-order mark goes."""
    try:
        return content.decode("utf-8").removeprefix("﻿"), False
    except UnicodeDecodeError:
        return content.decode("cp932", "replace"), True


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in batches:
        yield own.assign(value=[v.decode("cp932", "replace") for v in own["value"]])


def _lines(spark: SparkSession, path: str, glob: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(path, line from 0, text) of all files, and (path, valid) of each: its bytes are UTF-8 throughout."""
    own = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    read = own.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.is_valid_utf8("value").alias("valid"), F.col("value").cast("binary").alias("value"))
    read = tables.keep("lines", read)
    files = tables.keep("files", read.groupBy("path").agg(F.min("valid").alias("valid")))
    # The lines of a split are numbered without gaps, so a count for each split gives every line its place in the file.
    splits = read.groupBy("path", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = tables.keep("splits", splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    placed = read.drop("valid").join(splits, ["path", "split"]).join(files, "path").select("path", (F.col("id") + F.col("shift")).alias("line"), "value", "valid")
    utf8 = placed.where("valid").select("path", "line", F.col("value").cast("string").alias("text"))
    other = placed.where("NOT valid").select("path", "line", "value").mapInPandas(_decoded, "path string, line long, value string").withColumnRenamed("value", "text")
    return utf8.unionByName(other).withColumn("text", F.when(F.col("line") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))), files


def _joins(lines: DataFrame, tables: Tables) -> DataFrame:
    """(path, line, first, many, flawed) of the lines that are part of a longer record, which begins at ``first``, or flawed."""
    quoted = lines.where(F.contains("text", F.lit('"'))).select("path", "line", _starts(F.col("text")).alias("starts"), _goes_on(F.col("text")).alias("goes_on"))
    quoted = tables.keep("quoted", quoted.withColumn("event", F.when(F.col("goes_on") != "stay", F.struct("line", "goes_on"))))
    ahead = running(quoted, "path", "line", {"then": ("min", "event")}, backwards=True, this_row=False)
    closes = F.coalesce(F.col("then.goes_on").isin("close", "reopen"), F.lit(False))
    outside = ((F.col("starts") == "open") & closes).cast("long")
    inside = ((F.col("goes_on") == "stay") | ((F.col("goes_on") == "reopen") & closes)).cast("long")
    steps = ahead.withColumns({"from_out": outside, "from_in": inside}).drop("event", "then")
    steps = tables.keep("steps", steps.withColumn("turn", ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("long")))
    turned = running(steps, "path", "line", {"turns": ("sum", "turn")})
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("line", F.col("from_out").alias("state"), "turns"))
    turned = tables.keep("turned", turned.withColumn("fixed", fixed))
    known = running(turned, "path", "line", {"last": ("max", "fixed")}, this_row=False)
    since = F.col("turns") - F.col("turn") - F.coalesce("last.turns", F.lit(0))
    state = known.withColumn("before", F.coalesce("last.state", F.lit(0)).bitwiseXOR(since % 2)).drop("last", "fixed", "turns", "turn")
    state = state.withColumn("after", F.when(F.col("before") == 0, F.col("from_out")).otherwise(F.col("from_in")))
    end = F.when((F.col("before") == 1) & (F.col("after") == 0), F.struct("line", (F.col("goes_on") == "reopen").alias("flawed")))
    state = tables.keep("state", state.withColumn("end", end))
    spans = running(state, "path", "line", {"close": ("min", "end")}, backwards=True, this_row=False).where("before = 0 AND after = 1")
    many = spans.select("path", F.explode(F.sequence("line", "close.line")).alias("line"), F.col("line").alias("first"), F.lit(True).alias("many"), F.col("close.flawed").alias("flawed"))
    alone = state.where("before = 0 AND after = 0 AND starts <> 'closed'").select("path", "line", F.col("line").alias("first"), F.lit(False).alias("many"), F.lit(True).alias("flawed"))
    return tables.keep("joins", many.unionByName(alone))


def read_records(spark: SparkSession, path: str, glob: str = "*.txt") -> tuple[DataFrame, DataFrame, Tables]:
    """Rows (path, row_no from 1, cells map by header, flawed) of the CSV files under ``path``, files (path, valid UTF-8), and the tables they read, for the caller to drop.

    The first line that is not empty is the header, trimmed; of columns with one name the first
    has it, others get their place attached.  Empty lines are skipped, line breaks within cells
    come out as ``\\n``.  ``flawed`` rows have more or fewer cells than the header, or quotes out of place.
    """
    tables = Tables(spark)
    lines, files = _lines(spark, path, glob, tables)
    joins = _joins(lines, tables)
    each = lines.join(joins, ["path", "line"], "left")
    single = each.where("coalesce(many, false) = false AND text <> ''").select("path", "line", "text", F.coalesce("flawed", F.lit(False)).alias("flawed"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))  # the lines of one record
    several = each.where("many").groupBy("path", F.col("first").alias("line")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.max("flawed").alias("flawed"))
    records = tables.keep("records", single.unionByName(several.select(single.columns)).withColumn("one", F.lit(1)))
    rows = running(records, "path", "line", {"number": ("sum", "one")}).select("path", (F.col("number") - 1).alias("row_no"), cells_of(F.col("text")).alias("own"), "flawed")
    rows = tables.keep("rows", rows)
    tables.drop("lines", "splits", "quoted", "steps", "turned", "state", "joins", "records")
    names = F.transform("own", lambda c: F.trim(F.regexp_replace(c, "﻿", "")))
    heads = rows.where("row_no = 0").select("path", names.alias("names"))
    heads = heads.select("path", F.transform("names", lambda c, i: F.when(F.array_position("names", c) == i + 1, c).otherwise(F.concat(c, F.lit("_"), i))).alias("names"))
    many = F.least(F.size("names"), F.size("own"))
    cells = F.map_from_arrays(F.slice("names", F.lit(1), many), F.slice("own", F.lit(1), many))
    wide = F.size("names") != F.size("own")
    return rows.where("row_no > 0").join(tables.keep("heads", heads), "path").select("path", "row_no", cells.alias("cells"), (F.col("flawed") | wide).alias("flawed")), files, tables
