"""Grid sources: delimited text sheets -> cell table, and a grid rendered
from the orders table (one sheet per order year, one column per day).

Line numbers are assigned without funnelling a file through one task: each
split of a file numbers its own lines, a per-split line count gives the
offset of every split inside its file (a table with one row per split), and
row_idx = split offset + position inside the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.sources import fixtures as fx
from vigil.sources.tables import read_table

# Input selection rules for the yearly workbooks.
GRID_SUFFIX = ".xlsx"
LOCK_PREFIX = "~$"
EXCLUDED_FILES = ("all_er_dataset.xlsx", "total_er.xlsx")


def select_inputs(names, suffix: str = GRID_SUFFIX, excluded=EXCLUDED_FILES) -> list[str]:
    """Matching names, no lock files, no excluded outputs, sorted; error if none."""
    out = sorted(n for n in names if n.lower().endswith(suffix) and not n.startswith(LOCK_PREFIX)
                 and n.lower() not in excluded)
    if not out:
        raise FileNotFoundError(f"no {suffix} inputs")
    return out


def sheet_lines(spark: SparkSession, folder: str, suffix: str = GRID_SUFFIX, excluded=EXCLUDED_FILES) -> DataFrame:
    """S8 in the scan: lines of the folder's sheets. The glob and the filter on the file name choose
    files before any is read; an error if none is left."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    name = F.col("_metadata.file_name")
    lines = (spark.read.option("pathGlobFilter", glob).text(folder)
             .where(~name.startswith(LOCK_PREFIX) & ~F.lower(name).isin(*excluded)))
    if lines.isEmpty():
        raise FileNotFoundError(f"no {suffix} inputs in {folder}")
    return lines


def read_text_grid(spark: SparkSession, paths, sep: str = ";") -> DataFrame:
    """Text sheets -> (source_file, row_idx, col_idx, cell)."""
    return text_grid(spark.read.text(paths), sep)


def text_grid(sheets: DataFrame, sep: str = ";") -> DataFrame:
    """S9 on lines of files (``value``, with the reader's ``_metadata``)."""
    lines = sheets.select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("_line"))
    blocks = lines.groupBy("source_file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    per_file = Window.partitionBy("source_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(per_file), F.lit(0)))
    numbered = lines.join(blocks.select("source_file", "_blk", "_off", "_m0"), ["source_file", "_blk"])
    row_idx = (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("int")
    return numbered.select("source_file", row_idx.alias("row_idx"),
                           F.posexplode(F.split("_line", _re_quote(sep), -1)).alias("col_idx", "cell"))


def _re_quote(sep: str) -> str:
    import re
    return re.escape(sep)


# Fixture layout of an orders sheet: row -> label of column 0. Rows 1 is left
# empty; row 2 holds the dates; row 3 is the anchor; row 9 is not in the
# dictionary.
ORDER_GRID_LABELS = (
    (0, "'Atenciones de urgencia ' || CAST(y AS STRING)"),
    (1, "''"),
    (2, "'FECHA'"),
    (3, "'  Total demanda '"),
    (4, "'Neumonía (J12–J18)'"),
    (5, "'Influenza (J09-J11)'"),
    (6, "'IRA alta (J00–J06)'"),
    (7, "'Crisis obstructiva bronquial (J40-J46)'"),
    (8, "'Cirugías de urgencia'"),
    (9, "'Otra fila'"),
)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
OVERFLOW_DAYS = 10  # the first days of a year are repeated at the end of the previous sheet


def _count_text(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN '-' ELSE CAST({c} AS STRING) END"


ORDER_GRID_VALUES = (
    (0, "''"),
    (1, "''"),
    (2, None),  # header cell, dialect specific
    (3, "CAST(n AS STRING)"),
    (4, _count_text("p1")),
    (5, _count_text("p2")),
    (6, "CAST(p3 AS STRING) || ',0'"),
    (7, _count_text("p4")),
    (8, _count_text("p5")),
    (9, "CAST(n AS STRING)"),
)


def header_cell(serial: str) -> str:
    return f"CASE WHEN day(d) = 1 THEN {fx.iso('d')} WHEN dayofyear(d) = 100 THEN 'x' ELSE {serial} END"


SERIAL_D_SPARK = "CAST(datediff(d, DATE'1899-12-30') AS STRING)"
SERIAL_D_DUCK = "CAST(date_diff('day', DATE '1899-12-30', d) AS STRING)"


def orders_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell table of yearly sheets rendered from orders: per day the number of
    orders and of each priority; every day of a year is a column of that
    year's sheet, and the first days also close the previous year's sheet."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"),
                                                    "o_orderpriority")
    daily = o.groupBy("d").agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.col("o_orderpriority") == p, 1)).alias(f"p{i + 1}") for i, p in enumerate(PRIORITIES)])
    own = daily.select("*", F.year("d").alias("y"), F.dayofyear("d").alias("col_idx"))
    prev = (daily.where(F.dayofyear("d") <= OVERFLOW_DAYS)
            .select("*", (F.year("d") - 1).alias("y"), (F.dayofyear("d") + 366).alias("col_idx")))
    placed = own.unionByName(prev)
    cells = [F.struct(F.lit(r).alias("row_idx"),
                      F.expr(header_cell(SERIAL_D_SPARK) if e is None else e).alias("cell"))
             for r, e in ORDER_GRID_VALUES]
    body = placed.select(F.concat(F.lit("ER_"), F.col("y").cast("string"), F.lit(".xlsx")).alias("source_file"),
                         "col_idx", F.explode(F.array(*cells)).alias("c"))
    body = body.select("source_file", "c.row_idx", "col_idx", "c.cell")
    years = daily.select(F.year("d").alias("y")).distinct()
    labels = [F.struct(F.lit(r).alias("row_idx"), F.expr(e).alias("cell")) for r, e in ORDER_GRID_LABELS]
    head = years.select(F.concat(F.lit("ER_"), F.col("y").cast("string"), F.lit(".xlsx")).alias("source_file"),
                        F.explode(F.array(*labels)).alias("c"))
    head = head.select("source_file", "c.row_idx", F.lit(0).alias("col_idx"), "c.cell")
    return head.unionByName(body)


def write_sheets(cells: DataFrame, folder: str, sep: str = ";") -> None:
    """A cell table as one text file per sheet, named as its source_file (the inverse of ``text_grid``).

    A sheet is one file, so its lines go to one task; a line is an array over the sheet's columns."""
    spark = cells.sparkSession
    last = cells.groupBy("source_file").agg(F.max("col_idx").alias("_last"))
    row = (cells.groupBy("source_file", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "cell"))).alias("_m"))
           .join(last, "source_file"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(""))), sep)
    parts = f"{folder}_parts"
    (row.select("source_file", "row_idx", line.alias("value")).repartition("source_file")
     .sortWithinPartitions("source_file", "row_idx").select("value", F.col("source_file").alias("sheet"))
     .write.partitionBy("sheet").text(parts))
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(folder))
    for found in fs.globStatus(hadoop.Path(f"{parts}/sheet=*/part-*")):      # a name per sheet
        fs.rename(found.getPath(), hadoop.Path(folder, found.getPath().getParent().getName().split("=", 1)[1]))
