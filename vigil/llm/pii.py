"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

What is found and validated: e-mail addresses, IPv4 addresses (octets up to 255), payment card
numbers (13-19 digits with a right Luhn digit), IBANs (mod-97, in their country's length), telephone numbers with an
international prefix or in 3-3-4 grouping, 3-2-4 grouped identity numbers, calendar dates of
1900-2099 (day and month of one or two digits), and the whole value after a key word such as ``token =``. A number that fails its check is left alone.

Each value is replaced by a keyed permutation within its own format: an unbalanced Feistel
network whose round function is SHA-256 of key, kind, round and the other half. Digits stay
digits and letters stay letters of their case; separators and lengths stay (a date with a one-digit day or month gets one
without leading zeros); card numbers get their
new Luhn digit and IBANs their new check digits; dates stay dates and addresses addresses. Equal
values get equal pseudonyms in all documents, whatever their separators or date format, and a
holder of the key can undo it (month-first dates excepted: their pseudonyms may read as day-first; the leading zeros of dates
written without them may come back).

Defined results: null text stays null; texts without such values come back as they are; rows are
kept one for one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "pseudonyms-1"            # default key of the registered query; pass a secret one in production

YEAR, MONTH, DAY = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# The length of an IBAN by country (registered ones, and those in use without registration).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban_of(length: int, countries: str) -> str:
    full, rest = divmod(length - 4, 4)
    return (rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{full}}}"
            + (rf" ?[A-Z0-9]{{{rest}}}" if rest else ""))


IBAN = "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())
KINDS = {
    "secret": r"(?i:(?<![a-z0-9])(?:token|secret|password|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
              r"[A-Za-z0-9_+/-]{16,})",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "ipv4": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "date": rf"(?<![\d/.-])(?:{YEAR}(?<sep>[/.-]){MONTH}\k<sep>{DAY}|(?:{DAY}(?<sepb>[/.-]){MONTH}|{MONTH}(?<sepc>[/.-]){DAY})"
            rf"(?:\k<sepb>|\k<sepc>){YEAR})(?![\d/-]|\.\d)",
    "phone": r"(?<![\d+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[.-]\d{4}"
             r"|\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\d)",
    "identity": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"
            r"(?![A-Za-z0-9])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?<sepd>[ -])\d{4}\k<sepd>\d{4}\k<sepd>\d{1,7}"
            r"|\d{4}(?<sepe>[ -])\d{6}\k<sepe>\d{5})(?!\d|\.\d)",
}
ANY = "|".join(KINDS.values())
FIRST_DAY, DAYS = "1900-01-01", 17 * 4297   # every day of 1900-2099


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where it stands inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(parts: list[Column], hex_digits: int = 12) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")


def _feistel(left: Column, right: Column, step: Callable, rounds: int, undo: bool) -> tuple[Column, Column]:
    """Alternate ``right = step(right, left, round)`` and ``left = step(left, right, round)``."""
    order = F.sequence(F.lit(rounds), F.lit(1)) if undo else F.sequence(F.lit(1), F.lit(rounds))

    def one(state: Column, r: Column) -> Column:
        odd = r % 2 == 1
        new_right = F.when(odd, step(state["r"], state["l"], r)).otherwise(state["r"])
        new_left = F.when(odd, state["l"]).otherwise(step(state["l"], state["r"], r))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    end = F.aggregate(order, F.struct(left.alias("l"), right.alias("r")), one)
    return end["l"], end["r"]


def permute_number(x: Column, a: int, b: int, kind: str, key: str = KEY, rounds: int = ROUNDS,
                   undo: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    sign = -1 if undo else 1
    size = {"l": a, "r": b}

    def step(own: Column, other: Column, r: Column) -> Column:
        f = _number([F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")])
        modulus = F.when(r % 2 == 1, F.lit(size["r"])).otherwise(F.lit(size["l"]))
        return F.pmod(own + sign * f % modulus, modulus).cast("long")

    left, right = _feistel(F.floor(x / b).cast("long"), F.pmod(x, F.lit(b)).cast("long"), step, rounds, undo)
    return left * b + right


def permute_text(s: Column, kind: str, key: str = KEY, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """A keyed permutation of the strings with the same places of digits and of letters.

    Letters move within the alphabet and keep their case, and case does not change how far.
    """
    sign = -1 if undo else 1

    def step(own: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.length(own).cast("string"),
                                    F.lower(other)).cast("binary"), 512)

        def turn(c: Column, i: Column, d: Column) -> Column:
            move = sign * F.conv(F.substr(d, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)

            def within(first: str, n: int) -> Column:
                return F.char(F.pmod(code - ord(first) + move, F.lit(n)) + ord(first))
            return (F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26))
                    .when(c.between("A", "Z"), within("A", 26)).otherwise(c))

        return let(digest, lambda d: F.array_join(F.transform(F.split(own, ""), lambda c, i: turn(c, i, d)), ""))

    half = F.floor(F.length(s) / 2).cast("int")
    left, right = _feistel(F.substr(s, F.lit(1), half), F.substr(s, half + 1), step, rounds, undo)
    return F.concat(left, right)


def refill(pattern: Column, digits: Column, of: str = "[^0-9]") -> Column:
    """``pattern`` with its characters outside ``of`` replaced, in order, by those of ``digits``."""
    chars = F.split(pattern, "")

    def put(state: Column, c: Column) -> Column:
        keep = c.rlike(f"^{of}$")
        return F.struct(F.when(keep, F.concat(state["out"], c))
                        .otherwise(F.concat(state["out"], F.substr(digits, state["at"], F.lit(1)))).alias("out"),
                        F.when(keep, state["at"]).otherwise(state["at"] + 1).alias("at"))

    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put)["out"]


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the last digit on; ``doubled_first``: the last digit given is a doubled one."""
    odd = 0 if doubled_first else 1

    def weigh(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == odd, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x)


def _only(s: Column, drop: str) -> Column:
    return F.regexp_replace(s, drop, "")


def _card(m: Column, key: str, undo: bool) -> Column:
    digits = _only(m, "[^0-9]")
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key, undo=undo)
    check = F.pmod(F.lit(10) - luhn_sum(body, True) % 10, F.lit(10)).cast("string")
    return F.when(luhn_sum(digits, False) % 10 == 0, refill(m, F.concat(body, check))).otherwise(m)


def _mod97(s: Column) -> Column:
    def add(state: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (state * 10 + c.try_cast("int")) % 97).otherwise(
            (state * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), add)


def _iban(m: Column, key: str, undo: bool) -> Column:
    plain = _only(m, " ")
    country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    valid = _mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1
    new = permute_text(body, "iban", key, undo=undo)
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid & F.length(plain).between(15, 34),
                  refill(m, F.concat(country, check, new), "[^A-Z0-9]")).otherwise(m)


def _ipv4(m: Column, key: str, undo: bool) -> Column:
    octet = F.split(m, r"\.")
    x = F.aggregate(octet, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    return let(permute_number(x, 65536, 65536, "ipv4", key, undo=undo), lambda y: F.concat_ws(
        ".", *[F.shiftright(y, by).bitwiseAND(F.lit(255)).cast("string") for by in (24, 16, 8, 0)]))


def _date(m: Column, key: str, undo: bool) -> Column:
    sep = F.regexp_extract(m, r"[/.-]", 0)
    part = F.split(m, r"[/.-]")
    year_first = F.length(part[0]) == 4
    def day(y, mo, d):
        return F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    iso, dmy, mdy = (day(part[0], part[1], part[2]), day(part[2], part[1], part[0]), day(part[2], part[0], part[1]))
    found = F.when(year_first, iso).otherwise(F.coalesce(dmy, mdy))
    layout = F.when(year_first, "ymd").when(dmy.isNotNull(), "dmy").otherwise("mdy")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(
        F.datediff(found, F.lit(FIRST_DAY).cast("date")).cast("long"), 17, DAYS // 17, "date", key, undo=undo).cast("int"))
    plain = F.when(m.rlike(r"(?<!\d)\d(?!\d)"), F.date_format(new, "yyyy-M-d")).otherwise(F.date_format(new, "yyyy-MM-dd"))
    text = let(F.split(plain, "-"), lambda p: F.when(
        layout == "ymd", F.concat_ws("-", p[0], p[1], p[2])).when(
        layout == "dmy", F.concat_ws("-", p[2], p[1], p[0])).otherwise(F.concat_ws("-", p[1], p[2], p[0])))
    return F.when(found.isNull(), m).otherwise(F.replace(text, F.lit("-"), sep))


def _phone(m: Column, key: str, undo: bool) -> Column:
    digits = _only(m, "[^0-9]")
    own = F.when(F.length(digits) >= 10, 10).otherwise(F.length(digits) - 1)    # the rest is the country's
    lead = F.substr(digits, F.lit(1), F.length(digits) - own)
    new = permute_text(F.substr(digits, F.length(digits) - own + 1), "phone", key, undo=undo)
    return F.when(F.length(digits).between(7, 15), refill(m, F.concat(lead, new))).otherwise(m)


def _identity(m: Column, key: str, undo: bool) -> Column:
    return refill(m, permute_text(_only(m, "-"), "identity", key, undo=undo))


def _email(m: Column, key: str, undo: bool) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), "email", key, undo=undo), F.lit("@"),
                    F.substring_index(m, "@", -1))


def _secret(m: Column, key: str, undo: bool) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/-]{16,}$", 0)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)),
                    permute_text(value, "secret", key, undo=undo))


HOW = {"secret": _secret, "email": _email, "ipv4": _ipv4, "date": _date, "phone": _phone, "identity": _identity,
       "iban": _iban, "card": _card}


def pseudonym(match: Column, key: str = KEY, undo: bool = False) -> Column:
    """The pseudonym of one match of ``ANY`` (``undo``: the value of a pseudonym)."""
    out = match
    for kind in reversed(HOW):
        out = F.when(match.rlike(f"^(?:{KINDS[kind]})$"), HOW[kind](match, key, undo)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with the personal data in ``column`` replaced; other columns as they are."""
    text = F.col(column)
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = F.transform(matches, lambda m: pseudonym(m, key, undo))
    between = F.split(text, ANY, -1)
    joined = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(between, 1, F.size(matches)), new,
                                                        lambda b, n: F.array(b, n))), ""),
                      F.element_at(between, -1))
    return docs.withColumn(column, F.when(text.rlike(ANY), joined).otherwise(text))
