"""Oracle SQL per registered query name."""

from __future__ import annotations

from vigil.plans.oracle_sql import (VARS, calendar_from, daily_wide, event_panel_ctes, interpolated,
                                    left_on_calendar, lineitem_obs, panel_ctes, rounded_select, with_)
from vigil.sources.tables import EVENT_VARIABLES

K = ["series_id", "date"]
BASE = [f"obs AS ({lineitem_obs()})", f"daily AS ({daily_wide('obs')})"]
GAPPY = BASE + [f"cal AS ({calendar_from('daily')})", f"gappy AS ({left_on_calendar('cal', 'daily')})"]

SQL = {
    "daily_mean": with_(BASE, rounded_select("daily", K, VARS)),
    "daily_calendar": with_(GAPPY, rounded_select("gappy", K, VARS)),
    "interpolate_time": with_(GAPPY + [f"filled AS ({interpolated('gappy')})"],
                              rounded_select("filled", K, VARS)),
    "panel_inner_join": with_(event_panel_ctes(), rounded_select("epanel", K, list(EVENT_VARIABLES))),
    "clean_panel": with_(panel_ctes(), rounded_select(
        "clean", K, VARS, ["CAT", "CAT_24h", "CAT_48h", "CAT_72h"])),
}

# ---- parsers and text sources -------------------------------------------------
from vigil.plans import oracle_sql as o  # noqa: E402
from vigil.sources import fixtures as fx  # noqa: E402
from vigil.sources.delimited import SALVAGE_RE  # noqa: E402

_PRICE = f"(SELECT l_orderkey, l_linenumber, {fx.PRICE_TEXT} AS txt FROM lineitem)"
_LABELS = (f"(SELECT p_partkey, {fx.LABEL_TEXT} AS label, {fx.FILE_NAME_TEXT} AS file_name, "
           f"{fx.CATEGORY_TEXT} AS cat_text FROM part)")


def _salvage_sql() -> str:
    names = ["date", "PM25", "PM10", "temp", "hum", "pres", "wind", "winddir", "CAT"]
    ext = ", ".join(f"regexp_extract(line, '{SALVAGE_RE}', {i + 1}) AS {n}" for i, n in enumerate(names))
    nums = ", ".join(o.r6(o.to_number(n, comma=False), n) for n in names[1:8])
    return (f"WITH lines AS (SELECT o_orderkey, {fx.SALVAGE_LINE} AS line FROM orders), "
            f"parts AS (SELECT o_orderkey, {ext} FROM lines WHERE regexp_matches(line, '{SALVAGE_RE}')), "
            f"typed AS (SELECT o_orderkey, {o.iso_date('date')} AS date, {nums}, "
            f"{o.normalize_category('CAT')} AS CAT FROM parts), "
            f"ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY o_orderkey) AS rn "
            f"FROM typed WHERE date IS NOT NULL) "
            f"SELECT o_orderkey, date, PM25, PM10, temp, hum, pres, wind, winddir, CAT FROM ranked WHERE rn = 1")


def _varfile() -> str:
    cols = ", ".join(f'{e} AS "{n}"' for n, e in fx.VARIABLE_FILE_COLUMNS.items())
    return f"(SELECT l_suppkey AS series_id, {cols} FROM lineitem)"


def _scores(cols: list[str], score, extra: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS candidate, {i} AS position, CAST({score(c)} AS BIGINT) AS n FROM {_varfile()}"
        for i, c in enumerate(cols))
    return f"SELECT candidate, position, n, {extra} FROM ({parts})"


SQL.update({
    "parse_yymmdd": f"SELECT o_orderkey, txt, {o.yymmdd_date('txt')} AS date FROM "
                    f"(SELECT o_orderkey, {fx.ORDER_DATE_TEXT} AS txt FROM orders)",
    "parse_decimal_comma": f"SELECT l_orderkey, l_linenumber, txt, {o.r6(o.to_number('txt'), 'value')}, "
                           f"{o.r6(o.to_number('txt', comma=False), 'value_plain')} FROM {_PRICE}",
    "parse_dash_null": f"SELECT l_orderkey, l_linenumber, txt, "
                       f"{o.r6(o.to_number('txt', dash=True), 'value')} FROM {_PRICE}",
    "parse_excel_date": f"SELECT o_orderkey, cell, {o.excel_date('cell')} AS FECHA FROM "
                        f"(SELECT o_orderkey, {fx.excel_cell(fx.SERIAL_DUCK)} AS cell FROM orders)",
    "normalize_key": f"SELECT p_partkey, label, {o.normalize_key('label')} AS label_key FROM {_LABELS}",
    "normalize_text": f"SELECT p_partkey, {o.normalize_text('label')} AS label_text FROM {_LABELS}",
    "year_from_name": f"SELECT p_partkey, file_name, {o.year_from_name('file_name')} AS source_year FROM {_LABELS}",
    "category_normalize": f"SELECT p_partkey, {o.normalize_category('cat_text')} AS CAT FROM {_LABELS}",
    "salvage_line": _salvage_sql(),
    "drop_all_null_columns": _scores(list(fx.VARIABLE_FILE_COLUMNS), lambda c: f'count("{c}")',
                                     "CASE WHEN n > 0 THEN 1 ELSE 0 END AS kept"),
    "best_value_column": _scores(
        ["valor", "valor_b", "vacia"], lambda c: f'count({o.to_number(chr(34) + c + chr(34))})',
        "CASE WHEN row_number() OVER (ORDER BY n DESC, position) = 1 AND n > 0 THEN 1 ELSE 0 END AS is_best"),
    "variable_file_daily": (
        f"WITH f AS {_varfile()}, c AS (SELECT count({o.to_number('valor')}) AS a, "
        f"count({o.to_number('valor_b')}) AS b FROM f), "
        f"obs AS (SELECT series_id, {o.yymmdd_date(chr(34) + 'FECHA ' + chr(34))} AS date, "
        f"CASE WHEN c.a >= c.b THEN {o.to_number('valor')} ELSE {o.to_number('valor_b')} END AS v FROM f, c) "
        f"SELECT series_id, date, {o.r6('avg(v)', 'PM25')} FROM obs WHERE date IS NOT NULL GROUP BY 1, 2"),
})

# ---- panel quality, categories, features ---------------------------------------
from vigil.operators.features import BASE_NUMERIC, LAGS, ROLL_WINDOWS  # noqa: E402

PANEL = o.panel_ctes()
W = "PARTITION BY series_id ORDER BY date"


def _frame(w: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def _rolling_sql(stats, variables=VARS) -> list[str]:
    fn = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}
    out = []
    for w in ROLL_WINDOWS:
        for st in stats:
            for v in variables:
                out.append(o.r6(f"CASE WHEN count({v}) {_frame(w)} = {w} THEN {fn[st]}({v}) {_frame(w)} END",
                                f"{v}_{st}{w}"))
    return out


def _lags_sql(variables=VARS) -> list[str]:
    return [o.r6(f"lag({v}, {k}) OVER ({W})", f"{v}_lag{k}") for k in LAGS for v in variables]


def _diffs_sql(variables=VARS) -> list[str]:
    return [o.r6(f"{v} - lag({v}, {k}) OVER ({W})", f"{v}_diff{k}") for k in (1, 2) for v in variables]


def _prev_sql() -> list[str]:
    out = []
    for k in (1, 2, 3):
        out += [f"lag(CAT, {k}) OVER ({W}) AS CAT_lag{k}", f"lag(critical_now, {k}) OVER ({W}) AS critical_lag{k}"]
    return out


_CAL = {
    "year": "year(d)", "month": "month(d)", "dayofyear": "dayofyear(d)", "dayofweek": "isodow(d) - 1",
    "is_weekend": "CASE WHEN isodow(d) - 1 IN (5, 6) THEN 1 ELSE 0 END",
    "winter": "CASE WHEN month(d) IN (6, 7, 8) THEN 1 ELSE 0 END",
    "autumn": "CASE WHEN month(d) IN (3, 4, 5) THEN 1 ELSE 0 END",
    "spring": "CASE WHEN month(d) IN (9, 10, 11) THEN 1 ELSE 0 END",
    "summer": "CASE WHEN month(d) IN (12, 1, 2) THEN 1 ELSE 0 END",
}
_CYC = {"doy_sin": "sin(2 * pi() * dayofyear(d) / 365.25)", "doy_cos": "cos(2 * pi() * dayofyear(d) / 365.25)"}


def _cal_sql(names, src="date") -> list[str]:
    out = []
    for n in names:
        if n in _CAL:
            out.append(f"{_CAL[n].replace('(d)', f'({src})')} AS {n}")
        else:
            out.append(o.r6(_CYC[n].replace("(d)", f"({src})"), n))
    return out


TARGETED = PANEL + [f"tgt AS (SELECT *, lead(critical_now, 2) OVER ({W}) AS critical_t_plus_2 FROM "
                    f"(SELECT *, {o.critical_sql('CAT')} AS critical_now FROM clean))"]
_ORD = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)"
_ZS = " UNION ALL ".join(
    f"SELECT series_id, '{v}' AS feature, {o.r6(f'avg({v})', 'mean')}, "
    f"{o.r6(f'CASE WHEN stddev_pop({v}) = 0 THEN 1.0 ELSE stddev_pop({v}) END', 'std')} FROM clean GROUP BY series_id"
    for v in VARS)
_ZA = ", ".join(o.r6(f"({v} - avg({v}) OVER (PARTITION BY series_id)) / CASE WHEN stddev_pop({v}) OVER "
                     f"(PARTITION BY series_id) = 0 THEN 1.0 ELSE stddev_pop({v}) OVER (PARTITION BY series_id) END", v)
                for v in VARS)
_ALL_CAL = ["year", "month", "dayofyear", "dayofweek", "is_weekend", "winter", "autumn", "spring", "summer",
            "doy_sin", "doy_cos"]
_FEATS = ([f"series_id, date, {', '.join(o.r6(v, v) for v in VARS)}, CAT, CAT_24h, CAT_48h, CAT_72h, "
           f"critical_now, critical_t_plus_2"] + _cal_sql(_ALL_CAL) + _lags_sql()
          + _rolling_sql(("mean", "max", "min", "std")) + _diffs_sql() + _prev_sql())
_TRIM_CTES, _TRIM_LAST = o.trim_ctes("complete")

SQL.update({
    "quantile_bounds": with_(PANEL, f"SELECT series_id, {o.r6('quantile_cont(PM25, 0.01)', 'q_low')}, "
                                    f"{o.r6('quantile_cont(PM25, 0.99)', 'q_high')} FROM complete GROUP BY series_id"),
    "trim_one": with_(PANEL, rounded_select("trim0", K, VARS)),
    "trim_sequential": with_(PANEL, rounded_select(_TRIM_LAST, K, VARS)),
    "category": with_(PANEL, f"SELECT series_id, date, {o.r6('PM25', 'PM25')}, {o.category_sql('PM25')} AS CAT "
                             f"FROM complete"),
    "critical_flag": with_(PANEL, f"SELECT series_id, date, {o.critical_sql(o.category_sql('PM25'))} "
                                  f"AS critical_now FROM complete"),
    "future_category": with_(PANEL + [f"c2 AS MATERIALIZED (SELECT series_id, date, {o.category_sql('PM25')} AS CAT FROM {_TRIM_LAST})"],
                             o.future_join("c2", keep_missing=True)),
    "zscore_fit": with_(PANEL, _ZS),
    "zscore_apply": with_(PANEL, f"SELECT series_id, date, {_ZA}, CAT, CAT_24h, CAT_48h, CAT_72h FROM clean"),
    "coverage": with_(PANEL, "SELECT series_id, count(date) AS n_days, date_diff('day', min(date), max(date)) + 1 "
                             "AS span_days, " + o.r6("count(date) / (date_diff('day', min(date), max(date)) + 1)",
                                                    "coverage_ratio") + " FROM clean GROUP BY series_id"),
    "event_rate": with_(TARGETED, f"SELECT series_id, {o.r6('avg(critical_now)', 'event_rate')}, "
                                  f"count(critical_now) AS n FROM tgt GROUP BY series_id"),
    "date_span": with_(PANEL, "SELECT series_id, min(date) AS date_start, max(date) AS date_end FROM clean "
                              "GROUP BY series_id"),
    "calendar_features": f"SELECT o_orderkey, {', '.join(_cal_sql(['year', 'month', 'dayofyear', 'dayofweek', 'is_weekend']))} FROM {_ORD}",
    "season_flags": f"SELECT o_orderkey, {', '.join(_cal_sql(['winter', 'autumn', 'spring', 'summer']))} FROM {_ORD}",
    "cyclic_features": f"SELECT o_orderkey, {', '.join(_cal_sql(['doy_sin', 'doy_cos']))} FROM {_ORD}",
    "lags": with_(TARGETED, f"SELECT series_id, date, {', '.join(_lags_sql())} FROM tgt"),
    "rolling_mean": with_(TARGETED, f"SELECT series_id, date, {', '.join(_rolling_sql(['mean']))} FROM tgt"),
    "rolling_max": with_(TARGETED, f"SELECT series_id, date, {', '.join(_rolling_sql(['max']))} FROM tgt"),
    "rolling_min": with_(TARGETED, f"SELECT series_id, date, {', '.join(_rolling_sql(['min']))} FROM tgt"),
    "rolling_std": with_(TARGETED, f"SELECT series_id, date, {', '.join(_rolling_sql(['std']))} FROM tgt"),
    "diffs": with_(TARGETED, f"SELECT series_id, date, {', '.join(_diffs_sql())} FROM tgt"),
    "prev_category": with_(TARGETED, f"SELECT series_id, date, {', '.join(_prev_sql())} FROM tgt"),
    "target_rows": with_(TARGETED, "SELECT series_id, date, critical_now, critical_t_plus_2 FROM tgt"),
    "target_days": with_(PANEL + [f"cn AS MATERIALIZED (SELECT series_id, date, {o.critical_sql('CAT')} AS critical_now FROM clean)"],
                         "SELECT a.series_id, a.date, a.critical_now, b.critical_now AS critical_t_plus_2 FROM cn a "
                         "LEFT JOIN cn b ON a.series_id = b.series_id AND b.date = a.date + 2"),
    "feature_table": with_(TARGETED, f"SELECT * FROM (SELECT {', '.join(_FEATS)} FROM tgt) "
                                     f"WHERE critical_t_plus_2 IS NOT NULL"),
})

# ---- label-by-date grids ---------------------------------------------------------
from vigil.operators.grid import LABELS  # noqa: E402
from vigil.sources import grid as sg  # noqa: E402

_GV = ["TOTAL_DEMANDA", "NEUMONIA", "INFLUENZA", "IRA_ALTA", "CRISIS_OBSTRUCTIVA_BRONQUIAL", "CIRUGIAS_URGENCIA"]
_PR = ", ".join(f"count(CASE WHEN o_orderpriority = '{p}' THEN 1 END) AS p{i + 1}" for i, p in enumerate(sg.PRIORITIES))
_ROWS = "(VALUES " + ", ".join(f"({r})" for r, _ in sg.ORDER_GRID_LABELS) + ") r(row_idx)"
_BODY_CASE = "CASE r.row_idx " + " ".join(
    f"WHEN {r} THEN {sg.header_cell(sg.SERIAL_D_DUCK) if e is None else e}" for r, e in sg.ORDER_GRID_VALUES) + " END"
_HEAD_CASE = "CASE r.row_idx " + " ".join(f"WHEN {r} THEN {e}" for r, e in sg.ORDER_GRID_LABELS) + " END"
_DICT = "(VALUES " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(LABELS)) + ") t(label_key, var_name, var_pos)"
NT = o.normalize_text

GRID = [
    f"gdaily AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, {_PR} FROM orders GROUP BY 1)",
    "placed AS (SELECT d, n, p1, p2, p3, p4, p5, year(d) AS y, dayofyear(d) AS col_idx FROM gdaily UNION ALL "
    "SELECT d, n, p1, p2, p3, p4, p5, year(d) - 1 AS y, dayofyear(d) + 366 AS col_idx FROM gdaily "
    f"WHERE dayofyear(d) <= {sg.OVERFLOW_DAYS})",
    f"body AS (SELECT 'ER_' || CAST(y AS STRING) || '.xlsx' AS source_file, r.row_idx, col_idx, {_BODY_CASE} AS cell "
    f"FROM placed, {_ROWS})",
    f"head AS (SELECT 'ER_' || CAST(y AS STRING) || '.xlsx' AS source_file, r.row_idx, 0 AS col_idx, {_HEAD_CASE} AS cell "
    f"FROM (SELECT DISTINCT year(d) AS y FROM gdaily), {_ROWS})",
    "cells AS (SELECT * FROM head UNION ALL SELECT * FROM body)",
    f"ne AS (SELECT * FROM cells WHERE {NT('cell')} <> '')",
    f"anchor AS (SELECT source_file, min(row_idx) AS anchor_row FROM cells WHERE col_idx = 0 AND "
    f"{o.normalize_key('cell')} = 'TOTAL DEMANDA' GROUP BY 1)",
    "hdr AS (SELECT a.source_file, a.anchor_row, (SELECT max(ne.row_idx) FROM ne WHERE ne.source_file = a.source_file "
    "AND ne.row_idx < a.anchor_row) AS header_row FROM anchor a)",
    f"dates AS (SELECT c.source_file, c.col_idx, {o.excel_date(NT('c.cell'))} AS FECHA FROM cells c JOIN hdr h "
    "ON c.source_file = h.source_file AND c.row_idx = h.header_row WHERE c.col_idx >= 1)",
    f"dict AS (SELECT * FROM {_DICT})",
    f"labs AS (SELECT c.source_file, c.row_idx, {NT('c.cell')} AS label, {o.normalize_key('c.cell')} AS label_key "
    f"FROM cells c JOIN hdr h ON c.source_file = h.source_file WHERE c.col_idx = 0 AND c.row_idx >= h.header_row "
    f"AND {NT('c.cell')} <> '')",
    "grows AS (SELECT l.*, d.var_name, d.var_pos FROM labs l JOIN dict d ON l.label_key = d.label_key)",
    f"vals AS (SELECT b.source_file, b.row_idx, b.col_idx, dt.FECHA, r.var_name, {o.to_number('b.cell', dash=True)} "
    "AS value FROM cells b JOIN grows r ON b.source_file = r.source_file AND b.row_idx = r.row_idx JOIN dates dt "
    "ON b.source_file = dt.source_file AND b.col_idx = dt.col_idx WHERE b.col_idx >= 1 AND dt.FECHA IS NOT NULL)",
    "kept AS (SELECT * FROM vals WHERE NOT (FECHA BETWEEN DATE '2020-03-18' AND DATE '2021-09-30'))",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file, FECHA, var_name ORDER BY row_idx, col_idx) "
    "AS rn FROM kept)",
    "wide AS (SELECT source_file, FECHA, " + ", ".join(
        f"max(CASE WHEN var_name = '{v}' AND rn = 1 THEN value END) AS {v}" for v in _GV)
    + f", {o.year_from_name('source_file')} AS source_year FROM ranked GROUP BY source_file, FECHA)",
]
_WIDE_OUT = f"FECHA, {', '.join(o.r6(v, v) for v in _GV)}, source_file, source_year"

SQL.update({
    "grid_cells": with_(GRID, "SELECT c.* FROM cells c WHERE EXISTS (SELECT 1 FROM ne WHERE ne.source_file = "
                              "c.source_file AND ne.row_idx = c.row_idx) AND EXISTS (SELECT 1 FROM ne WHERE "
                              "ne.source_file = c.source_file AND ne.col_idx = c.col_idx)"),
    "grid_anchor": with_(GRID, "SELECT source_file, anchor_row, header_row FROM hdr"),
    "grid_header_join": with_(GRID, "SELECT b.source_file, b.row_idx, b.col_idx, dt.FECHA, b.cell FROM cells b "
                                    "JOIN hdr h ON b.source_file = h.source_file JOIN dates dt ON "
                                    "b.source_file = dt.source_file AND b.col_idx = dt.col_idx "
                                    "WHERE b.col_idx >= 1 AND b.row_idx > h.header_row"),
    "grid_dictionary": with_(GRID, "SELECT source_file, row_idx, label, label_key, var_name FROM grows"),
    "exclude_range": with_(GRID, f"SELECT source_file, row_idx, col_idx, FECHA, var_name, {o.r6('value', 'value')} "
                                 "FROM vals WHERE NOT (FECHA BETWEEN DATE '1995-03-18' AND DATE '1996-09-30')"),
    "grid_pivot": with_(GRID, f"SELECT {_WIDE_OUT} FROM wide"),
    "grid_consolidated": with_(GRID, f"SELECT {_WIDE_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY FECHA "
                                     "ORDER BY source_file) AS k FROM wide) WHERE k = 1"),
})

# ---- evaluation, CV folds, de-duplication ------------------------------------------
from vigil.operators.evaluate import threshold_grid  # noqa: E402

_G = threshold_grid()
_STEP = (_G[-1] - _G[0]) / (len(_G) - 1)
EV = [
    "ev AS (SELECT l_linestatus AS model, l_linenumber AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
    "l_discount * 5 + l_tax * 5 AS p FROM lineitem)",
    f"grid AS (SELECT range AS i, CASE WHEN range = {len(_G) - 1} THEN CAST('{_G[-1]!r}' AS DOUBLE) ELSE "
    f"range * CAST('{_STEP!r}' AS DOUBLE) + CAST('{_G[0]!r}' AS DOUBLE) END AS threshold FROM range({len(_G)}))",
    "cnt AS (SELECT model, fold, threshold, CAST(sum(CASE WHEN y = 1 AND p >= threshold THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
    "CAST(sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
    "CAST(sum(CASE WHEN y = 0 AND p < threshold THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
    "CAST(sum(CASE WHEN y = 1 AND p < threshold THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM ev, grid GROUP BY 1, 2, 3)",
    "m1 AS (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, "
    "CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END AS tnr FROM cnt)",
    "curve AS (SELECT model, fold, threshold, precision, recall, "
    "CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, "
    "CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (recall + tnr) / 2.0 WHEN tp + fn > 0 THEN recall "
    "WHEN tn + fp > 0 THEN tnr END AS balanced_acc FROM m1)",
    "feas AS (SELECT *, max(CASE WHEN recall >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY model, fold) AS anyf FROM curve)",
    "pick AS (SELECT * EXCLUDE (anyf, r) FROM (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY "
    "CASE WHEN anyf = 1 THEN precision ELSE f1 END DESC, CASE WHEN anyf = 1 THEN f1 ELSE balanced_acc END DESC, "
    "CASE WHEN anyf = 1 THEN balanced_acc ELSE recall END DESC, threshold) AS r FROM feas "
    "WHERE anyf = 0 OR recall >= 0.8) WHERE r = 1)",
    "ds AS (SELECT model, fold, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM ev GROUP BY 1, 2, 3)",
    "auc AS (SELECT model, fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(CAST(pos AS DOUBLE) * "
    "(CAST(coalesce(nb, 0) AS DOUBLE) + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc "
    "FROM (SELECT *, sum(neg) OVER (PARTITION BY model, fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND "
    "1 PRECEDING) AS nb FROM ds) GROUP BY 1, 2)",
    "ap AS (SELECT model, fold, CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0 THEN sum(CASE WHEN pos > 0 THEN "
    "(CAST(pos AS DOUBLE) / CAST(tot_pos AS DOUBLE)) * (CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE)) ELSE 0.0 END) END "
    "AS pr_auc FROM (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER (PARTITION BY model, fold) "
    "AS tot_pos, sum(neg) OVER (PARTITION BY model, fold) AS tot_neg FROM ds WINDOW w AS (PARTITION BY model, fold "
    "ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1, 2)",
    "br AS (SELECT model, fold, avg((p - y) * (p - y)) AS brier, count(*) AS n_test, avg(y) AS event_rate_test "
    "FROM ev GROUP BY 1, 2)",
    "pc AS (SELECT e.model, e.fold, CAST(sum(CASE WHEN y = 1 AND p >= k.threshold THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
    "CAST(sum(CASE WHEN y = 0 AND p >= k.threshold THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
    "CAST(sum(CASE WHEN y = 0 AND p < k.threshold THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
    "CAST(sum(CASE WHEN y = 1 AND p < k.threshold THEN 1 ELSE 0 END) AS DOUBLE) AS fn, k.threshold "
    "FROM ev e JOIN pick k ON e.model = k.model AND e.fold = k.fold GROUP BY 1, 2, k.threshold)",
    "pm AS (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, "
    "CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END AS tnr FROM pc)",
    "fm AS (SELECT b.model, b.fold, b.n_test, b.event_rate_test, a.roc_auc, q.pr_auc, b.brier, pm.precision, pm.recall, "
    "CASE WHEN pm.precision + pm.recall > 0 THEN 2.0 * pm.precision * pm.recall / (pm.precision + pm.recall) ELSE 0.0 END AS f1, "
    "CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (pm.recall + tnr) / 2.0 WHEN tp + fn > 0 THEN pm.recall "
    "WHEN tn + fp > 0 THEN tnr END AS balanced_acc, pm.threshold FROM br b JOIN auc a USING (model, fold) "
    "JOIN ap q USING (model, fold) JOIN pm USING (model, fold))",
    "summ AS (SELECT model, " + ", ".join(
        f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in
        ("roc_auc", "pr_auc", "brier", "precision", "recall", "f1", "balanced_acc", "threshold"))
    + ", avg(event_rate_test) AS event_rate_test_mean FROM fm GROUP BY model)",
]
_SUMM_COLS = [f"{m}_{s}" for m in ("roc_auc", "pr_auc", "brier", "precision", "recall", "f1", "balanced_acc",
                                   "threshold") for s in ("mean", "std")] + ["event_rate_test_mean"]
_CURVE = ["threshold", "precision", "recall", "f1", "balanced_acc"]
_FM = ["event_rate_test", "roc_auc", "pr_auc", "brier", "precision", "recall", "f1", "balanced_acc", "threshold"]

SQL.update({
    "threshold_curve": with_(EV, rounded_select("curve", ["model", "fold"], _CURVE)),
    "threshold_pick": with_(EV, rounded_select("pick", ["model", "fold"], _CURVE)),
    "roc_auc": with_(EV, rounded_select("auc", ["model", "fold"], ["roc_auc"])),
    "average_precision": with_(EV, rounded_select("ap", ["model", "fold"], ["pr_auc"])),
    "brier": with_(EV, rounded_select("br", ["model", "fold"], ["brier"])),
    "confusion_metrics": with_(EV, rounded_select("fm", ["model", "fold", "n_test"], _FM)),
    "cv_summary": with_(EV, rounded_select("summ", ["model"], _SUMM_COLS)),
    "best_model": with_(EV, rounded_select(
        "(SELECT * FROM summ ORDER BY recall_mean DESC NULLS LAST, pr_auc_mean DESC NULLS LAST, "
        "precision_mean DESC NULLS LAST, model LIMIT 1)", ["model"], _SUMM_COLS)),
    "cv_folds": with_(TARGETED + ["ft AS (SELECT series_id, date FROM tgt WHERE critical_t_plus_2 IS NOT NULL)"],
                      "SELECT series_id, date, pos, n, CASE WHEN sz > 0 AND pos >= n - 5 * sz THEN "
                      "CAST((pos - (n - 5 * sz)) // sz + 1 AS INTEGER) END AS test_fold FROM (SELECT *, n // 6 AS sz "
                      "FROM (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, "
                      "count(*) OVER (PARTITION BY series_id) AS n FROM ft))"),
    "dedup_first": "SELECT series_id, date, event_id, event_type, " + o.r6("value", "value") + " FROM (SELECT "
                   "user_id AS series_id, CAST(ts AS DATE) AS date, event_id, event_type, value, row_number() OVER "
                   "(PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS r FROM events) WHERE r = 1",
    "dedup_by_source": "SELECT date, source_file, o_orderkey, " + o.r6("o_totalprice", "o_totalprice") + " FROM ("
                       "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS source_file, o_orderkey, o_totalprice, "
                       "row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderpriority, o_orderkey) AS r "
                       "FROM orders) WHERE r = 1",
})

# ---- preparation, scoring input ------------------------------------------------------
from vigil.plans.registry import MEDIAN_INPUT, MODE_INPUT, SNAPSHOT_COLUMNS  # noqa: E402

_SNAP = ", ".join(f"{e} AS {n}" for n, e in SNAPSHOT_COLUMNS.items())
_SNAP_NUM = ", ".join(o.r6(o.to_number(n, comma=False), n) for n in SNAPSHOT_COLUMNS)
_VALID = " AND ".join(f"{o.to_number(n, comma=False)} IS NOT NULL" for n in SNAPSHOT_COLUMNS)
_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

SQL.update({
    "validate_snapshot": f"SELECT event_id, {_SNAP_NUM}, CASE WHEN {_VALID} THEN 1 ELSE 0 END AS valid FROM "
                         f"(SELECT event_id, {_SNAP} FROM events)",
    "median_impute": f"WITH t AS (SELECT l_orderkey, l_linenumber, {MEDIAN_INPUT} AS v FROM lineitem) "
                     f"SELECT l_orderkey, l_linenumber, {o.r6('coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t))', 'v_imputed')} FROM t",
    "mode_impute": f"WITH t AS (SELECT o_orderkey, {MODE_INPUT} AS v FROM orders) SELECT o_orderkey, "
                   "coalesce(v, (SELECT v FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) "
                   "AS v_imputed FROM t",
    "one_hot": "SELECT o_orderkey, " + ", ".join(
        f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS oh_{i}" for i, p in enumerate(_PRIOS)) + " FROM orders",
})

from vigil.plans.registry import STATED_INTERCEPT, STATED_MODEL, STATED_THRESHOLD  # noqa: E402

_MARGIN = " + ".join(f"({n} - {mean!r}::DOUBLE) / {std!r}::DOUBLE * {coef!r}::DOUBLE" for n, _, mean, std, coef in STATED_MODEL)
_STATED = (f"WITH s AS (SELECT event_id, {', '.join(f'{o.to_number(n, comma=False)} AS {n}' for n in SNAPSHOT_COLUMNS)} FROM "
           f"(SELECT event_id, {_SNAP} FROM events)), z AS (SELECT *, 1.0 / (1.0 + exp(-({_MARGIN} + {STATED_INTERCEPT!r}::DOUBLE))) "
           f"AS p FROM s WHERE {' AND '.join(f'{n} IS NOT NULL' for n in SNAPSHOT_COLUMNS)}) "
           f"SELECT event_id, {', '.join(o.r6(n, n) for n in SNAPSHOT_COLUMNS)}, {o.r6('p', 'predicted_probability_48h')}, "
           f"{o.r6(f'{STATED_THRESHOLD!r}::DOUBLE', 'decision_threshold')}, "
           f"CASE WHEN p >= {STATED_THRESHOLD!r}::DOUBLE THEN 1 ELSE 0 END AS critical_alert_48h FROM z")
_YEAR = "CAST(regexp_extract(source_file, '([0-9]{4})', 1) AS INTEGER)"
_CUT_GRID = GRID + [
    f"c2 AS (SELECT * FROM cells WHERE NOT ({_YEAR} % 2 = 0 AND {_YEAR} % 4 <> 0 AND row_idx = 3) AND NOT ({_YEAR} % 4 = 0 AND row_idx < 3))",
    f"a2 AS (SELECT source_file, min(row_idx) AS anchor_row FROM c2 WHERE col_idx = 0 AND {o.normalize_key('cell')} = 'TOTAL DEMANDA' GROUP BY 1)",
    f"n2 AS (SELECT DISTINCT c2.source_file FROM c2 JOIN a2 ON c2.source_file = a2.source_file WHERE c2.row_idx < a2.anchor_row AND {NT('c2.cell')} <> '')"]
SQL.update({
    "alerts_stated_model": _STATED,
    "alerts_stream_stated_model": _STATED,
    "scaler_table": SQL["zscore_fit"],
    "load_dataset": f"SELECT * EXCLUDE (o_orderkey) FROM ({SQL['salvage_line']})",
    "grid_consolidated_all_labels": SQL["grid_consolidated"],
    "grid_rejected": with_(_CUT_GRID, "SELECT f.source_file, CASE WHEN a2.anchor_row IS NULL THEN 'no anchor row' ELSE "
                                      "'no row above the anchor' END AS reason FROM (SELECT DISTINCT source_file FROM c2) f "
                                      "LEFT JOIN a2 ON f.source_file = a2.source_file WHERE f.source_file NOT IN (SELECT source_file FROM n2)"),
})


# ---- whole jobs ---------------------------------------------------------------------
from vigil.plans import job_queries as jq  # noqa: E402

_EV = list(EVENT_VARIABLES)
_EVENT_FEATS = ([f"series_id, date, {', '.join(o.r6(v, v) for v in _EV)}"] + _cal_sql(_ALL_CAL) + _lags_sql(_EV)
                + _rolling_sql(("mean", "max", "min", "std"), _EV) + _diffs_sql(_EV))
_SUMMARY = (
    "SELECT unnest(['selected_model', 'horizon_days', 'recall_target', 'n_features', 'n_rows_observed', "
    "'coverage_ratio_observed_vs_full_range', 'event_rate_now', 'n_rows_model', 'event_rate_target', 'date_start', "
    "'date_end', 'threshold']) AS item, unnest(['logit_balanced', printf('%.6f', 2.0), printf('%.6f', 0.8), printf('%.6f', 220.0), "
    "printf('%.6f', n), printf('%.6f', n / span), printf('%.6f', now), printf('%.6f', m), printf('%.6f', later), lo, hi, "
    "printf('%.6f', 0.4)]) AS value FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(span) AS DOUBLE) AS span FROM "
    "(SELECT count(*) AS n, max(date) - min(date) + 1 AS span FROM tgt GROUP BY series_id)), "
    "(SELECT avg(critical_now) AS now FROM tgt), (SELECT CAST(count(*) AS DOUBLE) AS m, avg(critical_t_plus_2) AS later, "
    "CAST(min(date) AS VARCHAR) AS lo, CAST(max(date) AS VARCHAR) AS hi FROM tgt WHERE critical_t_plus_2 IS NOT NULL)")

SQL.update({
    "feature_stream": with_(event_panel_ctes() + [f"efilled AS ({interpolated('epanel', _EV)})",
                                                  f"ecomplete AS MATERIALIZED ({o.complete_rows('efilled', _EV)})"],
                            f"SELECT {', '.join(_EVENT_FEATS)} FROM ecomplete"),
    "build_raw": SQL["clean_panel"],
    "bucketed_features": SQL["feature_table"],
    "consolidated_sink": SQL["grid_consolidated"],
    "column_date_order": f"SELECT o_orderkey, txt, CAST(CASE o_custkey % 3 WHEN 0 THEN try_strptime(txt, '%m/%d/%Y') "
                         f"WHEN 1 THEN try_strptime(txt, '%d/%m/%Y') ELSE try_strptime(txt, '%Y-%m-%d') END AS DATE) AS date "
                         f"FROM (SELECT o_orderkey, o_custkey, {jq.DATE_TEXT} AS txt FROM orders)",
    "run_summary": with_(TARGETED, _SUMMARY),
})
