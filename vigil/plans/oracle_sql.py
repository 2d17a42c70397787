"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written against the raw parquet views, with self-joins and
GROUP BY + JOIN where the Spark side uses windows, so the two sides share no
code path beyond the fixed derivation rules of the inputs.
"""

from __future__ import annotations

from vigil.functions.category import CATEGORY_CUTS, BASE_CATEGORY, CRITICAL_CATEGORIES
from vigil.operators.features import BASE_NUMERIC, LAGS, ROLL_WINDOWS
from vigil.sources.tables import EVENT_VARIABLES, LINEITEM_VARIABLES

VARS = list(BASE_NUMERIC)


ROUND_GUARD = "2.718281828e-9"


def r6(expr: str, name: str) -> str:
    """Rounded double on the guarded grid; ``+ 0.0`` folds a negative zero into zero."""
    return f"round(({expr}) + {ROUND_GUARD}, 6) + 0.0 AS {name}"


def lineitem_obs() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in LINEITEM_VARIABLES.items())
    return f"SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date, {cols} FROM lineitem"


def daily_wide(src: str = "obs", variables=VARS) -> str:
    aggs = ", ".join(f"avg({v}) AS {v}" for v in variables)
    return f"SELECT series_id, date, {aggs} FROM {src} WHERE date IS NOT NULL GROUP BY series_id, date"


def calendar_from(src: str = "daily") -> str:
    return (f"SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), "
            f"INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT series_id, min(date) AS lo, max(date) AS hi "
            f"FROM {src} GROUP BY series_id)")


def left_on_calendar(cal: str, daily: str, variables=VARS) -> str:
    cols = ", ".join(f"d.{v}" for v in variables)
    return (f"SELECT c.series_id, c.date, {cols} FROM {cal} c LEFT JOIN {daily} d "
            f"ON c.series_id = d.series_id AND c.date = d.date")


def interpolated(src: str, variables=VARS) -> str:
    w_prev = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_next = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    inner = []
    for v in variables:
        inner += [
            f"last_value(CASE WHEN {v} IS NOT NULL THEN date END IGNORE NULLS) {w_prev} AS {v}__pd",
            f"last_value({v} IGNORE NULLS) {w_prev} AS {v}__pv",
            f"first_value(CASE WHEN {v} IS NOT NULL THEN date END IGNORE NULLS) {w_next} AS {v}__nd",
            f"first_value({v} IGNORE NULLS) {w_next} AS {v}__nv",
        ]
    outer = []
    for v in variables:
        outer.append(
            f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN {v}__pd IS NULL THEN {v}__nv "
            f"WHEN {v}__nd IS NULL THEN {v}__pv "
            f"ELSE ({v}__nv - {v}__pv) / ({v}__nd - {v}__pd) * (date - {v}__pd) + {v}__pv END AS {v}")
    return (f"SELECT series_id, date, {', '.join(outer)} FROM "
            f"(SELECT *, {', '.join(inner)} FROM {src})")


def complete_rows(src: str, variables=VARS) -> str:
    cond = " AND ".join(f"{v} IS NOT NULL" for v in variables)
    return f"SELECT * FROM {src} WHERE {cond}"


def trim_ctes(first: str, variables=VARS, prefix: str = "trim") -> tuple[list[str], str]:
    """Sequential trimming as a chain of GROUP BY quantile + JOIN steps."""
    ctes, prev = [], first
    for i, v in enumerate(variables):
        name = f"{prefix}{i}"
        ctes.append(
            f"{name} AS MATERIALIZED (SELECT t.* FROM {prev} t JOIN (SELECT series_id, "
            f"quantile_cont({v}, 0.01) AS lo, quantile_cont({v}, 0.99) AS hi FROM {prev} GROUP BY series_id) q "
            f"ON t.series_id = q.series_id WHERE t.{v} >= q.lo AND t.{v} <= q.hi)")
        prev = name
    return ctes, prev


def category_sql(x: str, cuts=CATEGORY_CUTS, base: str = BASE_CATEGORY) -> str:
    whens = " ".join(f"WHEN {x} > {cut} THEN '{name}'" for cut, name in sorted(cuts, key=lambda t: -t[0]))
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{base}' END"


def critical_sql(c: str) -> str:
    names = ", ".join(f"'{n}'" for n in CRITICAL_CATEGORIES)
    return f"CASE WHEN {c} IN ({names}) THEN 1 ELSE 0 END"


def future_join(src: str, keep_missing: bool = False) -> str:
    joins, cols = [], []
    for k, name in ((1, "CAT_24h"), (2, "CAT_48h"), (3, "CAT_72h")):
        joins.append(f"LEFT JOIN {src} f{k} ON f{k}.series_id = p.series_id AND f{k}.date = p.date + {k}")
        cols.append(f"f{k}.CAT AS {name}")
    where = "" if keep_missing else " WHERE f1.CAT IS NOT NULL AND f2.CAT IS NOT NULL AND f3.CAT IS NOT NULL"
    return f"SELECT p.*, {', '.join(cols)} FROM {src} p {' '.join(joins)}{where}"


def panel_ctes(variables=VARS) -> list[str]:
    """CTEs up to ``clean`` (the raw clean dataset with future categories)."""
    ctes = [f"obs AS ({lineitem_obs()})",
            f"daily AS ({daily_wide('obs', variables)})",
            f"cal AS ({calendar_from('daily')})",
            f"gappy AS ({left_on_calendar('cal', 'daily', variables)})",
            f"filled AS ({interpolated('gappy', variables)})",
            f"complete AS MATERIALIZED ({complete_rows('filled', variables)})"]
    trims, last = trim_ctes("complete", variables)
    ctes += trims
    ctes.append(f"catd AS MATERIALIZED (SELECT *, {category_sql('PM25')} AS CAT FROM {last})")
    ctes.append(f"clean AS MATERIALIZED ({future_join('catd')})")
    return ctes


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def rounded_select(src: str, keys: list[str], doubles: list[str], others: list[str] = ()) -> str:
    cols = keys + [r6(v, v) for v in doubles] + list(others)
    return f"SELECT {', '.join(cols)} FROM {src}"


def event_panel_ctes(variables=EVENT_VARIABLES) -> list[str]:
    names = ", ".join(f"'{v}'" for v in variables)
    aggs = ", ".join(f"avg(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in variables)
    return [
        "eobs AS (SELECT user_id AS series_id, CAST(ts AS DATE) AS date, event_type AS variable, value "
        f"FROM events WHERE event_type IN ({names}))",
        f"edaily AS (SELECT series_id, date, {aggs} FROM eobs GROUP BY series_id, date)",
        "evb AS (SELECT series_id, variable, min(date) AS lo, max(date) AS hi FROM eobs GROUP BY 1, 2)",
        f"eb AS (SELECT series_id, max(lo) AS lo, min(hi) AS hi FROM evb GROUP BY series_id "
        f"HAVING count(*) = {len(variables)})",
        "ecal AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), "
        "INTERVAL 1 DAY)) AS DATE) AS date FROM eb WHERE lo <= hi)",
        f"epanel AS ({left_on_calendar('ecal', 'edaily', list(variables))})",
    ]


# ---- scalar parsers, DuckDB dialect -------------------------------------------

def _plain_number(s: str) -> str:
    """A double where the text has only a number's characters, or spells an infinity, and casts."""
    spelt = ", ".join(f"'{sign}{word}'" for sign in ("", "+", "-") for word in ("inf", "infinity"))
    return f"CASE WHEN regexp_matches({s}, '^[-+.0-9eE]+$') OR lower({s}) IN ({spelt}) THEN TRY_CAST({s} AS DOUBLE) END"


def strip_ws(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def to_number(s: str, comma: bool = True, dash: bool = False) -> str:
    t = strip_ws(f"CAST({s} AS VARCHAR)")
    missing = f"{t} IN ('', 'nan', 'None')" + (f" OR {t} = '-'" if dash else "")
    u = f"replace({t}, ',', '.')" if comma else t
    return f"CASE WHEN NOT ({missing}) THEN {_plain_number(u)} END"


def yymmdd_date(s: str) -> str:
    dg = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    iso = (f"(CASE WHEN CAST(substr({dg}, 1, 2) AS INTEGER) < 70 THEN '20' ELSE '19' END) || "
           f"substr({dg}, 1, 2) || '-' || substr({dg}, 3, 2) || '-' || substr({dg}, 5, 2)")
    return f"CASE WHEN length({dg}) = 6 THEN CAST(try_strptime({iso}, '%Y-%m-%d') AS DATE) END"


ISO_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d']"


def iso_date(s: str) -> str:
    return f"CAST(try_strptime({strip_ws(s)}, {ISO_FORMATS}) AS DATE)"


def excel_date(s: str) -> str:
    t = strip_ws(s)
    num = _plain_number(t)
    return (f"CASE WHEN ({num}) IS NOT NULL THEN CASE WHEN ({num}) BETWEEN -693593.0 AND 2958465.0 THEN "
            f"DATE '1899-12-30' + CAST(floor({num}) AS INTEGER) END ELSE {iso_date(t)} END")


def normalize_text(s: str) -> str:
    return f"coalesce({strip_ws(f'CAST({s} AS VARCHAR)')}, '')"


def normalize_key(s: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents({normalize_text(s)})), '[^A-Z0-9]+', ' ', 'g'))"


def year_from_name(s: str) -> str:
    base = f"regexp_extract({s}, '([^/]*)$', 1)"
    stem = (f"CASE WHEN regexp_matches({base}, '[^.].*\\.[^.]*$') THEN regexp_replace({base}, '\\.[^.]*$', '') "
            f"ELSE {base} END")
    return f"regexp_extract({stem}, '(20[0-9]{{2}})', 1)"


def normalize_category(s: str) -> str:
    return f"lower({strip_ws(s)})"
