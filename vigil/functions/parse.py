"""Text-to-value parsers (X1-X10) as Column expressions.

All parsers are null-safe, never throw under ANSI mode (``try_*`` forms) and
never let NaN through: a value that is not a finite/inf decimal becomes NULL.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.util import col_of

# Fixed values (must equal the source pipeline for identical results):
# two-digit years below 70 are 20yy, the rest 19yy; missing-value spellings.
YY_PIVOT = 70
MISSING_TOKENS = ("", "nan", "None")
DASH_TOKEN = "-"
EXCEL_EPOCH = "1899-12-30"

# A plain decimal as a float parser accepts it: optional sign, digits with an
# optional fraction (or a bare fraction), optional exponent; or an infinity.
DECIMAL_RE = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"

WHITESPACE = " \t\n\r\x0b\x0c"


def strip_ws(c) -> Column:
    """Trim all leading/trailing whitespace (not only spaces)."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def parse_date_yymmdd(c) -> Column:
    """Keep digits only; exactly 6 digits -> date with the 70 pivot; else NULL."""
    digits = F.regexp_replace(col_of(c), r"[^0-9]", "")
    yy = F.substring(digits, 1, 2).cast("int")
    century = F.when(yy < F.lit(YY_PIVOT), F.lit("20")).otherwise(F.lit("19"))
    iso = F.concat(century, F.substring(digits, 1, 2), F.lit("-"),
                   F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2))
    return F.when(F.length(digits) == 6, F.try_to_date(iso, "yyyy-MM-dd"))


def _guarded_double(s: Column) -> Column:
    return F.when(s.rlike(DECIMAL_RE), s.try_cast("double"))


def to_number(c, decimal_comma: bool = True, dash_is_null: bool = False) -> Column:
    """Trimmed text -> DOUBLE.

    ``""``, ``nan`` and ``None`` are missing; with ``decimal_comma`` every comma
    becomes a dot first (so ``1,234.5`` is NULL). Anything a strict float parser
    rejects (``1d``, ``0x1A``, ``1_000``, ``NaN``) is NULL.
    """
    s = strip_ws(col_of(c).cast("string"))
    missing = s.isin(*MISSING_TOKENS)
    if dash_is_null:
        missing = missing | (s == F.lit(DASH_TOKEN))
    if decimal_comma:
        s = F.replace(s, F.lit(","), F.lit("."))
    return F.when(~missing, _guarded_double(s))


def to_number_plain(c) -> Column:
    """Dot decimals only."""
    return to_number(c, decimal_comma=False)


def to_number_clean(c) -> Column:
    """Decimal comma, and a lone dash means missing."""
    return to_number(c, decimal_comma=True, dash_is_null=True)


DEFAULT_DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def _format_shape(fmt: str):
    """(length, character at position 11 or None) of text written in ``fmt``."""
    text = fmt.replace("'T'", "T").replace("yyyy", "0000")
    for tok in ("MM", "dd", "HH", "mm", "ss"):
        text = text.replace(tok, "00")
    return len(text), (text[10] if len(text) > 10 else None)


# Dates with other separators, times with fractions or a zone, and year-last dates.
_TIME_RE = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"
_YEAR_FIRST_RE = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME_RE
_YEAR_LAST_RE = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME_RE


def _made_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def year_last_counts(c) -> tuple[Column, Column]:
    """(month-first, day-first): whether a text is a year-last date when read in that order, as two conditions."""
    s = strip_ws(col_of(c).cast("string"))
    last = [F.regexp_extract(s, _YEAR_LAST_RE, i) for i in (1, 3, 4)]
    return _made_date(last[2], last[0], last[1]).isNotNull(), _made_date(last[2], last[1], last[0]).isNotNull()


def column_is_day_first(c) -> Column:
    """Aggregate (or window function): whether more of a column's texts are dates day first than month first.

    One order holds for a whole column: texts that only the other order can read are no dates of it."""
    month_first, day_first = year_last_counts(c)
    return F.count(F.when(day_first, 1)) > F.count(F.when(month_first, 1))


def to_date_iso(c, formats=DEFAULT_DATE_FORMATS, day_first: bool | Column | None = False) -> Column:
    """Date text -> DATE (time of day dropped), bad -> NULL.

    Each text is parsed only with the formats its length and separator can
    fit, so rows do not pay for a failed parse attempt per other format. Texts
    that fit none are taken apart: year first or last, ``-``, ``/`` or ``.``,
    with or without a time and a zone. A year-last date is month first unless
    ``day_first``; the other order is used where only that gives a date. With a
    Column as ``day_first`` (see ``column_is_day_first``) only the order it names is used."""
    s = strip_ws(col_of(c).cast("string"))
    expr = None
    for f in formats:
        n, sep = _format_shape(f)
        fits = F.length(s) == n
        if sep is not None:
            fits = fits & (F.substring(s, 11, 1) == F.lit(sep))
        fits = fits & (F.substring(s, 5, 1) == "-")
        parsed = F.try_to_timestamp(s, F.lit(f))
        expr = F.when(fits, parsed.cast("date")) if expr is None else expr.when(fits, parsed.cast("date"))
    y_first = [F.regexp_extract(s, _YEAR_FIRST_RE, i) for i in (1, 3, 4)]
    last = [F.regexp_extract(s, _YEAR_LAST_RE, i) for i in (1, 3, 4)]
    month_first, day_month = _made_date(last[2], last[0], last[1]), _made_date(last[2], last[1], last[0])
    if isinstance(day_first, Column):
        either = F.when(day_first, day_month).otherwise(month_first)
    else:
        either = F.coalesce(*((day_month, month_first) if day_first else (month_first, day_month)))
    return expr.when(s.rlike(_YEAR_FIRST_RE), _made_date(*y_first)).when(s.rlike(_YEAR_LAST_RE), either)


def parse_excel_date(c, formats=DEFAULT_DATE_FORMATS, day_first: bool | Column | None = False) -> Column:
    """Numeric cell -> 1899-12-30 + floor(n) days; else text date; day grain."""
    s = strip_ws(col_of(c).cast("string"))
    num = _guarded_double(s)
    in_range = num.between(-693593.0, 2958465.0)  # 0001-01-01 .. 9999-12-31
    serial = F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(num).cast("int"))
    return F.when(num.isNotNull(), F.when(in_range, serial)).otherwise(to_date_iso(s, formats, day_first))


def normalize_text(c) -> Column:
    """NULL -> '' else trimmed text."""
    return F.coalesce(strip_ws(col_of(c).cast("string")), F.lit(""))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str]:
    """ASCII folding built from the whole Unicode decomposition table (NFKD, keep ASCII).

    Returns the characters that fold to one, what they fold to, the marks that fold to nothing,
    and the ones that fold to several as text for ``str_to_map``.
    """
    src, dst, marks, several = [], [], [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        elif folded:
            several.append(f"{ch}{_OF}{folded}")
    return "".join(src), "".join(dst), "".join(marks), _AND.join(several)


_AND, _OF = "\x01", "\x02"


def fold_to_ascii(c, drop_other: bool = True) -> Column:
    """NFKD -> ASCII: accented and compatibility characters folded, combining marks dropped.

    Characters that stay non-ASCII are removed (``drop_other``, the strict
    ASCII-ignore behaviour) or turned into a space (a separator). ASCII text, the
    usual case, is passed through by one match.
    """
    src, dst, marks, several = _fold_tables()
    s = col_of(c)
    plain = F.translate(s, src + marks, dst)
    table = F.str_to_map(F.lit(several), F.lit(_AND), F.lit(_OF))       # a constant
    spelt = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    folded = F.when(plain.rlike(r"[^\x00-\x7F]"), spelt).otherwise(plain)
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "" if drop_other else " ")).otherwise(s)


def normalize_key(c, strict_ascii: bool = False) -> Column:
    """Accents stripped, upper case, every run of non [A-Z0-9] -> one space, trimmed.

    By default characters that do not fold to ASCII (e.g. en/em dashes) act as
    separators; ``strict_ascii=True`` removes them instead, as an ASCII-ignore
    encoder does (so ``J00–J98`` becomes ``J00J98``).
    """
    s = fold_to_ascii(normalize_text(c), drop_other=strict_ascii)
    s = F.regexp_replace(F.upper(s), r"[^A-Z0-9]+", " ")
    return F.trim(s)


def file_stem(c) -> Column:
    """Base name without its last extension (a leading dot is not an extension)."""
    base = F.regexp_extract(col_of(c), r"([^/]*)$", 1)
    return F.when(base.rlike(r"[^.].*\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def year_from_filename(c) -> Column:
    """First ``20dd`` in the file's base name without extension, else ''."""
    return F.regexp_extract(file_stem(c), r"(20[0-9]{2})", 1)


def normalize_category(c) -> Column:
    """Trimmed lower-case category text; NULL stays NULL."""
    return F.lower(strip_ws(col_of(c).cast("string")))
