"""Text renderings of the given tables, as SQL expressions valid in both Spark
SQL and DuckDB (where a dialect differs, both forms are given).

They turn table values into the messy text the parsers and the grid reader
handle: two-digit-year dates, decimal commas, dashes, Excel serial dates,
accented labels. Every row of the source table is rendered; the key rules
only choose the rendering.
"""

from __future__ import annotations

# yyMMdd built from the date parts
_YY = "lpad(CAST(year({d}) % 100 AS STRING), 2, '0')"
_MM = "lpad(CAST(month({d}) AS STRING), 2, '0')"
_DD = "lpad(CAST(day({d}) AS STRING), 2, '0')"
_YYYY = "CAST(year({d}) AS STRING)"


def yymmdd(d: str) -> str:
    return f"{_YY.format(d=d)} || {_MM.format(d=d)} || {_DD.format(d=d)}"


def iso(d: str) -> str:
    return f"{_YYYY.format(d=d)} || '-' || {_MM.format(d=d)} || '-' || {_DD.format(d=d)}"


def comma_decimal(x: str) -> str:
    """Two-decimal number as text with a decimal comma (integer arithmetic only)."""
    return (f"CAST(CAST(floor({x}) AS BIGINT) AS STRING) || ',' || "
            f"lpad(CAST(CAST(round({x} * 100) AS BIGINT) % 100 AS STRING), 2, '0')")


def dot_decimal(x: str) -> str:
    """Two-decimal number as text with a decimal dot (integer arithmetic only)."""
    return (f"CAST(CAST(floor({x}) AS BIGINT) AS STRING) || '.' || "
            f"lpad(CAST(CAST(round({x} * 100) AS BIGINT) % 100 AS STRING), 2, '0')")


# Order dates as YYMMDD text in several spellings
ORDER_DATE_TEXT = f"""CASE o_orderkey % 10
  WHEN 1 THEN {_YY.format(d='o_orderdate')} || '/' || {_MM.format(d='o_orderdate')} || '/' || {_DD.format(d='o_orderdate')}
  WHEN 2 THEN {_YYYY.format(d='o_orderdate')} || {_MM.format(d='o_orderdate')} || {_DD.format(d='o_orderdate')}
  WHEN 3 THEN {_YY.format(d='o_orderdate')} || '0231'
  WHEN 4 THEN '  ' || {yymmdd('o_orderdate')} || ' '
  WHEN 5 THEN 'n/a'
  WHEN 6 THEN lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || {_MM.format(d='o_orderdate')} || {_DD.format(d='o_orderdate')}
  WHEN 7 THEN {_YY.format(d='o_orderdate')} || '13' || {_DD.format(d='o_orderdate')}
  ELSE {yymmdd('o_orderdate')} END"""

# Prices and quantities as messy number text
PRICE_TEXT = f"""CASE l_orderkey % 10
  WHEN 0 THEN {comma_decimal('l_extendedprice')}
  WHEN 1 THEN ' ' || {comma_decimal('l_extendedprice')} || ' '
  WHEN 2 THEN ''
  WHEN 3 THEN 'nan'
  WHEN 4 THEN 'None'
  WHEN 5 THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0') || '.5'
  WHEN 6 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || 'd'
  WHEN 7 THEN '-'
  WHEN 8 THEN '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',5'
  ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || 'e1' END"""

# Header cells as Excel serial numbers or ISO text
SERIAL_SPARK = "CAST(datediff(CAST(o_orderdate AS DATE), DATE'1899-12-30') AS STRING)"
SERIAL_DUCK = "CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS STRING)"


def excel_cell(serial: str) -> str:
    return f"""CASE o_orderkey % 5
  WHEN 0 THEN {serial}
  WHEN 1 THEN {iso('o_orderdate')}
  WHEN 2 THEN {serial} || '.75'
  WHEN 3 THEN 'TOTAL'
  ELSE {iso('o_orderdate')} || ' 00:00:00' END"""


# Labels built from part and nation names
LABEL_TEXT = """CASE p_partkey % 6
  WHEN 0 THEN '  Neumonía (' || p_type || ')  '
  WHEN 1 THEN lower(p_brand) || ' – Influenza J09–J11'
  WHEN 2 THEN p_type || '/' || p_brand || ';  crisis: obstrucción'
  WHEN 3 THEN 'Bronquitis, ' || p_name
  WHEN 4 THEN NULL
  ELSE 'Cirugías de urgencia ' || CAST(p_size AS STRING) END"""

FILE_NAME_TEXT = """CASE p_partkey % 4
  WHEN 0 THEN '/data/er/Urgencias_' || CAST(1995 + p_partkey % 40 AS STRING) || '.xlsx'
  WHEN 1 THEN 'report.' || CAST(1995 + p_partkey % 40 AS STRING)
  WHEN 2 THEN 'ER ' || CAST(1995 + p_partkey % 40 AS STRING) || ' v' || CAST(p_size AS STRING) || '.2021.xlsx'
  ELSE '.' || CAST(2000 + p_partkey % 30 AS STRING) END"""

CATEGORY_TEXT = """CASE p_partkey % 5
  WHEN 0 THEN '  Regular '
  WHEN 1 THEN 'ALERTA'
  WHEN 2 THEN NULL
  WHEN 3 THEN 'Pre' || lower(p_type)
  ELSE 'buena' END"""

# Order rows rendered as one text line of the clean dataset
SALVAGE_LINE = f"""CASE WHEN o_orderkey % 7 = 0 THEN 'x' || {iso('o_orderdate')} ELSE {iso('o_orderdate')} END
  || ',' || {dot_decimal('o_totalprice / 1000')} || ', ' || CAST(o_custkey % 200 AS STRING) || '.5'
  || ',' || CAST(o_custkey % 30 AS STRING) || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '7' END
  || ',' || '1013.' || CAST(o_orderkey % 10 AS STRING) || ',' || '-2.5' || ',' || CAST(o_orderkey % 360 AS STRING)
  || ',' || CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergencia' WHEN '2-HIGH' THEN 'alerta'
       WHEN '3-MEDIUM' THEN ' Regular' WHEN '4-NOT SPECIFIED' THEN 'preemergéncia' ELSE 'BUENA 2' END"""

# One variable file per supplier rows (all text columns)
VARIABLE_FILE_COLUMNS = {
    "FECHA ": yymmdd("l_shipdate"),
    "HORA": "lpad(CAST(l_linenumber AS STRING), 2, '0') || ':00'",
    "valor": f"CASE WHEN l_orderkey % 4 = 0 THEN 'NV' ELSE {comma_decimal('l_quantity * 3.5')} END",
    "valor_b": f"CASE WHEN l_orderkey % 3 = 0 THEN {comma_decimal('l_quantity * 3.5')} ELSE '' END",
    "vacia": "CAST(NULL AS STRING)",
}
