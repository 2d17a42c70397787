"""Label-by-date grids (the yearly emergency-room sheets): cell table ->
tidy daily table with one column per known label (S9, O9, X6-X9, X17, J4-J6,
A14, A15, O3, O7).

Input is a cell table ``(source_file, row_idx, col_idx, cell)``; the whole
flow is one Spark plan for all files. Per-file facts (anchor row, header row)
are aggregates; the small sides (dictionary: fixed 40 rows; anchors: one row
per file; header dates: one row per file column) are joined by key and left
to AQE to broadcast when their measured size is small. The wide result is a
conditional aggregate (pivot) keyed by (file, date): one shuffle, no chain of
outer joins. Cross-file de-duplication is a ``min_by`` aggregate per date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.parse import (column_is_day_first, normalize_key, normalize_text, parse_excel_date, to_number_clean,
                                   year_from_filename)
from vigil.operators.dedup import first_per_key
from vigil.session import cut_lineage

# The label that marks the anchor row, the excluded date range
# (both ends included) and the label dictionary (normalised label -> column),
# in their original order.
ANCHOR_KEY = "TOTAL DEMANDA"
EXCLUDE_START = "2020-03-18"
EXCLUDE_END = "2021-09-30"
LABELS = (
    ("TOTAL DE ATENCIONES DE URGENCIA", "TOTAL_ATENCIONES_URGENCIA"),
    ("TOTAL DEMANDA", "TOTAL_DEMANDA"),
    ("SECCION 1 TOTAL ATENCIONES DE URGENCIA", "SECCION_1_TOTAL_ATENCIONES_URGENCIA"),
    ("TOTAL CAUSA SISTEMA RESPIRATORIO J00 J98", "RESP_TOTAL"),
    ("IRA ALTA J00 J06", "IRA_ALTA"),
    ("INFLUENZA J09 J11", "INFLUENZA"),
    ("NEUMONIA J12 J18", "NEUMONIA"),
    ("BRONQUITIS BRONQUIOLITIS AGUDA J20 J21", "BRONQUITIS_BRONQUIOLITIS_AGUDA"),
    ("CRISIS OBSTRUCTIVA BRONQUIAL J40 J46", "CRISIS_OBSTRUCTIVA_BRONQUIAL"),
    ("OTRA CAUSA RESPIRATORIA NO CONTENIDAS EN LAS CATEGORIAS ANTERIORES J22 J30 J39 J47 J60 J98",
     "OTRAS_CAUSAS_RESPIRATORIAS"),
    ("TOTAL ATENCIONES POR COVID 19 VIRUS NO IDENTIFICADO U07 2", "COVID_U07_2"),
    ("TOTAL ATENCIONES POR COVID 19 VIRUS IDENTIFICADO U07 1", "COVID_U07_1"),
    ("TOTAL ATENCIONES POR CAUSA SISTEMA CIRCULATORIO I00 I99", "TOTAL_CIRCULATORIO"),
    ("INFARTO AGUDO MIOCARDIO I21 I22", "INFARTO_AGUDO_MIOCARDIO"),
    ("ACCIDENTE VASCULAR ENCEFALICO I60 I66 I67 8 I67 9 I69", "ACCIDENTE_VASCULAR_ENCEFALICO"),
    ("CRISIS HIPERTENSIVA I10 X", "CRISIS_HIPERTENSIVA"),
    ("ARRITMIA GRAVE I44 I46 0 I46 9 I49", "ARRITMIA_GRAVE"),
    ("OTRAS CAUSAS CIRCULATORIAS NO CONTENIDAS EN LAS CATEGORIAS ANTERIORES I00 I09 I11 I15 I20 I23 I28 I30 "
     "I42 I50 I52 I67 0 I67 7 E I70 I99", "OTRAS_CAUSAS_CIRCULATORIAS"),
    ("TOTAL ATENCIONES POR TRAUMATISMOS Y ENVENENAMIENTOS S00 T98", "TOTAL_TRAUMATISMOS_ENVENENAMIENTOS"),
    ("LESIONES POR ACCIDENTES DEL TRANSITO CAUSA EXTERNA V01 V89", "LESIONES_TRANSITO"),
    ("LESIONES AUTOINFLINGIDAS INTENCIONALMENTE CAUSA EXTERNA X60 X84", "LESIONES_AUTOINFLIGIDAS"),
    ("LESIONES POR QUEMADURAS EXPOSICION AL HUMO FUEGO LLAMAS CONTACTO CON CALOR Y SUSTANCIAS CALIENTES "
     "CAUSA EXTERNA X00 X19", "LESIONES_QUEMADURAS"),
    ("LESIONES POR OTRAS CAUSAS EXTERNAS NO CONTENIDAS EN LAS CATEGORIAS ANTERIORES CAUSA EXTERNA V90 W99 "
     "X20 X59 X85 Y98", "LESIONES_OTRAS_CAUSAS_EXTERNAS"),
    ("TOTAL ATENCIONES POR CAUSA DE TRASTORNOS MENTALES F00 F99", "TOTAL_TRASTORNOS_MENTALES"),
    ("IDEACION SUICIDA R45 8", "IDEACION_SUICIDA"),
    ("TRASTORNOS MENTALES Y DEL COMPORTAMIENTO DEBIDOS AL USO DE SUSTANCIAS PSICOACTIVAS F10 F19",
     "TRASTORNOS_SUSTANCIAS_PSICOACTIVAS"),
    ("TRASTORNOS DEL HUMOR AFECTIVOS F30 F39", "TRASTORNOS_HUMOR"),
    ("TRASTORNOS NEUROTICOS TRASTORNOS RELACIONADOS CON EL ESTRES Y TRASTORNOS SOMATOMORFOS F40 F48",
     "TRASTORNOS_NEUROTICOS_ESTRES_SOMATOMORFOS"),
    ("OTROS TRASTORNOS MENTALES NO CONTENIDOS EN LAS CATEGORIAS ANTERIORES", "OTROS_TRASTORNOS_MENTALES"),
    ("TOTAL ATENCIONES POR DIARREA AGUDA A00 A09", "DIARREA_AGUDA"),
    ("TOTAL ATENCIONES POR OTRAS CAUSAS NO CONTENIDAS EN LAS CAUSAS ANTERIORES", "OTRAS_CAUSAS"),
    ("SECCION 2 TOTAL HOSPITALIZACIONES POR GRUPO DE CAUSA", "SECCION_2_TOTAL_HOSPITALIZACIONES"),
    ("CAUSAS SISTEMA RESPIRATORIO J00 J98", "HOSP_RESPIRATORIO"),
    ("POR COVID 19 VIRUS NO IDENTIFICADO U07 2", "HOSP_COVID_U07_2"),
    ("POR COVID 19 VIRUS IDENTIFICADO U07 1", "HOSP_COVID_U07_1"),
    ("CAUSAS SISTEMA CIRCULATORIO I00 I99", "HOSP_CIRCULATORIO"),
    ("CAUSAS POR TRAUMATISMOS Y ENVENENAMIENTOS S00 T98", "HOSP_TRAUMATISMOS_ENVENENAMIENTOS"),
    ("CAUSA POR TRASTORNOS MENTALES F00 F99", "HOSP_TRASTORNOS_MENTALES"),
    ("POR OTRAS CAUSAS NO CONTENIDAS EN LAS CAUSAS ANTERIORES", "HOSP_OTRAS_CAUSAS"),
    ("CIRUGIAS DE URGENCIA", "CIRUGIAS_URGENCIA"),
)


def label_dictionary(spark: SparkSession, labels=LABELS) -> DataFrame:
    """The fixed label dictionary as a tiny DataFrame (40 rows: safe to broadcast)."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(labels)],
                                 "label_key string, var_name string, var_pos int")


def nonempty_cells(cells: DataFrame) -> DataFrame:
    return cells.where(normalize_text("cell") != "")


def drop_empty(cells: DataFrame) -> DataFrame:
    """Drop rows and columns of a file whose cells are all empty."""
    ne = nonempty_cells(cells)
    rows = ne.select("source_file", "row_idx").distinct()
    cols = ne.select("source_file", "col_idx").distinct()
    return (cells.join(rows, ["source_file", "row_idx"], "left_semi")
            .join(cols, ["source_file", "col_idx"], "left_semi"))


def label_rows(cells: DataFrame) -> DataFrame:
    """(source_file, row_idx, row_pos, label_col, label): the non-empty rows of every file, numbered
    from 0, with the text in the file's label column, its first column that is not empty (S9).

    One aggregate over the cells; what comes out has one row per sheet row, and all facts about
    labels, anchors and headers are derived from it."""
    rows = (nonempty_cells(cells).groupBy("source_file", "row_idx")
            .agg(F.min("col_idx").alias("_first"), F.min_by("cell", "col_idx").alias("_cell")))
    per_file = Window.partitionBy("source_file")
    rows = rows.withColumn("label_col", F.min("_first").over(per_file)).withColumn(
        "row_pos", F.row_number().over(per_file.orderBy("row_idx")) - 1)
    return rows.select("source_file", "row_idx", "row_pos", "label_col",
                       F.when(F.col("_first") == F.col("label_col"), normalize_text("_cell")).otherwise("").alias("label"))


def anchors_of(rows: DataFrame, anchor_key: str = ANCHOR_KEY) -> DataFrame:
    """O9 from ``label_rows``: (source_file, anchor_row, header_row, label_col)."""
    per_file = Window.partitionBy("source_file")
    is_anchor = normalize_key("label") == F.lit(anchor_key)
    marked = rows.withColumn("anchor_row", F.min(F.when(is_anchor, F.col("row_idx"))).over(per_file))
    return (marked.where(F.col("anchor_row").isNotNull()).groupBy("source_file")
            .agg(F.first("anchor_row").alias("anchor_row"),
                 F.max(F.when(F.col("row_idx") < F.col("anchor_row"), F.col("row_idx"))).alias("header_row"),
                 F.first("label_col").alias("label_col")))


def anchors(cells: DataFrame, anchor_key: str = ANCHOR_KEY) -> DataFrame:
    """Per file the first row whose label normalises to the anchor key, and
    the header row = the nearest non-empty row above it (NULL when there is
    none: such a file is rejected rather than wrapped around)."""
    return anchors_of(label_rows(cells), anchor_key).drop("label_col")


def rejected_files(cells: DataFrame, anchor_table: DataFrame | None = None) -> DataFrame:
    """(source_file, reason) of the files the flow can't use: no anchor row, or nothing above it."""
    found = anchors(cells) if anchor_table is None else anchor_table
    return (cells.select("source_file").distinct().join(found, "source_file", "left")
            .where(F.col("header_row").isNull())
            .select("source_file", F.when(F.col("anchor_row").isNull(), "no anchor row")
                    .otherwise("no row above the anchor").alias("reason")))


def check_anchors(cells: DataFrame, anchor_table: DataFrame | None = None) -> None:
    """Strict mode: raise when a file is rejected, with their number (``rejected_files`` lists them all)."""
    bad = rejected_files(cells, anchor_table).agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} file(s) without a usable '{ANCHOR_KEY}' row, the first is {bad['first']}")


def header_dates(cells: DataFrame, anchor_table: DataFrame) -> DataFrame:
    """J6 source: (file, col_idx, FECHA) from the header row's cells (X6). Year-last dates of a
    header are all read in one order, the one that more of its cells fit."""
    heads = (cells.join(anchor_table, "source_file")
             .where((F.col("row_idx") == F.col("header_row")) & (F.col("col_idx") > _label_col(anchor_table)))
             .select("source_file", "col_idx", normalize_text("cell").alias("cell")))
    order = heads.groupBy("source_file").agg(column_is_day_first("cell").alias("_day_first"))
    return heads.join(order, "source_file").select(
        "source_file", "col_idx", parse_excel_date("cell", day_first=F.col("_day_first")).alias("FECHA"))


def _label_col(df: DataFrame):
    return F.col("label_col") if "label_col" in df.columns else F.lit(0)


def labeled_rows(rows: DataFrame, anchor_table: DataFrame, dictionary: DataFrame,
                 strict_ascii: bool = False) -> DataFrame:
    """J5 on ``label_rows``: rows from the header row down whose label is in the dictionary."""
    lab = (rows.join(anchor_table.select("source_file", "header_row"), "source_file")
           .where((F.col("row_idx") >= F.col("header_row")) & (F.col("label") != ""))
           .withColumn("label_key", normalize_key("label", strict_ascii)))
    return lab.join(F.broadcast(dictionary), "label_key")


def grid_values(cells: DataFrame, rows: DataFrame, dates: DataFrame) -> DataFrame:
    """A15 + J6: long (file, row, col, FECHA, var_name, value) with dated cells only; ``rows`` from
    ``labeled_rows``, ``dates`` from ``header_dates`` (columns right of the labels)."""
    return (cells.join(rows.select("source_file", "row_idx", "var_name", "var_pos"), ["source_file", "row_idx"])
            .join(dates, ["source_file", "col_idx"])
            .where(F.col("FECHA").isNotNull())
            .select("source_file", "row_idx", "col_idx", "FECHA", "var_name", "var_pos",
                    to_number_clean("cell").alias("value")))


def dated_values(spark: SparkSession, cells: DataFrame, strict: bool = False, strict_ascii: bool = False) -> DataFrame:
    """All known labels' dated values. The cells are read twice: once for the row table, once for
    the header and labelled rows, from which dates and values come."""
    rows = cut_lineage(label_rows(cells))
    anc = anchors_of(rows)
    if strict:
        check_anchors(cells, anc)
    named = labeled_rows(rows, anc, label_dictionary(spark), strict_ascii)
    wanted = named.select("source_file", "row_idx").unionByName(
        anc.select("source_file", F.col("header_row").alias("row_idx"))).distinct()
    used = cut_lineage(cells.join(wanted, ["source_file", "row_idx"], "left_semi"))
    return grid_values(used, named, header_dates(used, anc))


def exclude_range(df: DataFrame, date_col: str = "FECHA", start: str = EXCLUDE_START,
                  end: str = EXCLUDE_END) -> DataFrame:
    """Drop dates inside [start, end], both ends included."""
    d = F.col(date_col)
    return df.where(~d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def pivot_values(values: DataFrame, variables) -> DataFrame:
    """One row per (file, FECHA), one column per variable. A label
    seen twice in a file or a date seen twice takes its first (row, column)."""
    first = F.struct("row_idx", "col_idx")
    aggs = [F.min_by(F.when(F.col("var_name") == v, F.col("value")),
                     F.when(F.col("var_name") == v, first)).alias(v) for v in variables]
    keyed = values.groupBy("source_file", "FECHA")
    out = keyed.agg(*aggs) if aggs else keyed.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return out.withColumn("source_year", year_from_filename("source_file"))


def seen_variables(values: DataFrame) -> list[str]:
    """Variables present in the data, in order of first appearance (≤ 40
    names come back to the driver)."""
    rows = (values.groupBy("var_name").agg(F.min(F.struct("source_file", "row_idx")).alias("first"))
            .orderBy("first").collect())
    return [r.var_name for r in rows]


def consolidate(wide: DataFrame, variables) -> DataFrame:
    """O3 + O7 + X19: per FECHA the row of the smallest source file; columns
    FECHA, variables, source_file, source_year."""
    out = first_per_key(wide, ["FECHA"], ["source_file"])
    return out.select("FECHA", *variables, "source_file", "source_year")


def er_consolidated(spark: SparkSession, cells: DataFrame, variables=None,
                    start: str = EXCLUDE_START, end: str = EXCLUDE_END, strict: bool = False) -> DataFrame:
    """The whole grid flow for all files in one plan. Files without a usable anchor give no rows
    (``rejected_files`` lists them); with ``strict`` they are an error."""
    vals = exclude_range(dated_values(spark, cells, strict), "FECHA", start, end)
    if variables is None:
        vals = cut_lineage(vals)
    variables = list(variables) if variables is not None else seen_variables(vals)
    return consolidate(pivot_values(vals, variables), variables)


def consolidate_sheets(spark: SparkSession, folder: str, sink: str, variables=None, strict: bool = False) -> DataFrame:
    """S8 + S9 + O9 ... O3 + S16 as one job: a folder of sheets -> the consolidated table, sorted by day, at ``sink``,
    and the files that can't be used, with the reason, at ``<sink>_rejected``."""
    from vigil.plans.artefacts import write_table
    from vigil.sources.grid import sheet_lines, text_grid
    cells = cut_lineage(text_grid(sheet_lines(spark, folder)))
    write_table(rejected_files(cells), f"{sink}_rejected", ["source_file"])
    write_table(er_consolidated(spark, cells, variables, strict=strict), sink, ["FECHA"])
    return spark.read.parquet(sink)
