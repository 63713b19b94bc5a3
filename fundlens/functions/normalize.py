"""Column expressions for cleaning and deriving register fields.

Every function here maps Columns to a Column and stays inside whole-stage codegen:
no Python UDF anywhere in the normalisation path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundlens import dims

# Python's str.strip() removes any Unicode whitespace; Spark's trim() only removes
# spaces. This pattern mirrors the former.
_EDGE_WS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
# The characters of that class; trimming them reads a text's ends only, the pattern all of it.
_WS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip all leading/trailing Unicode whitespace (H1)."""
    c = col_(c)
    # before a last U+0085 the pattern's ``$`` matches too
    return F.when(c.endswith("\u0085"), F.regexp_replace(c, _EDGE_WS, "")).otherwise(F.btrim(c, F.lit(_WS)))


def unwrap(c) -> Column:
    """Spreadsheet-wrapped cell ``="value"`` -> ``value`` after stripping.

    NULL stays NULL; a cell ``=""`` becomes the empty string.
    """
    s = py_strip(c)
    wrapped = s.startswith('="') & s.endswith('"')
    # '="' alone counts as wrapped (prefix and suffix overlap) and yields ''.
    return F.when(wrapped, s.substr(F.lit(3), F.greatest(F.length(s) - 3, F.lit(0)))).otherwise(s)


def missing_token_to_null(c) -> Column:
    """Whole-cell missing tokens (``NA``, ``nan``, ``null`` ...) become NULL at ingest."""
    c = col_(c)
    return F.when(c.isin(*dims.MISSING_TOKENS), F.lit(None).cast("string")).otherwise(c)


def parse_amount(c) -> Column:
    """Locale number ``1.234,56`` -> DECIMAL(28,2); blank/invalid -> 0 (B1).

    28 digits leave room for every amount of up to 26 integer digits and for the exact
    sum of 10^10 of them in Spark's widest decimal.
    """
    num = F.replace(F.replace(unwrap(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(num.try_cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))


def parse_date(c) -> Column:
    """Strict ``DD.MM.YYYY`` -> DATE; blank/invalid -> NULL (B2)."""
    s = unwrap(c)
    ok = s.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    return F.when(ok, F.try_to_date(s, "d.M.yyyy"))


def year_of_date_text(c) -> Column:
    """Year-only parse used by date audits: third dot-part as INT."""
    parts = F.split(unwrap(c), r"\.")
    return F.when(F.size(parts) == 3, F.element_at(parts, 3).try_cast("int"))


def decade(year_col) -> Column:
    """``year // 10 * 10``."""
    y = col_(year_col)
    return (F.floor(y / 10) * 10).cast("int")


def duration_months(start, end) -> Column:
    """Days between the dates / 30.44, clamped at 0; NULL if a date is missing."""
    s, e = col_(start), col_(end)
    raw = F.datediff(e, s) / F.lit(dims.DAYS_PER_MONTH)
    return F.when(s.isNotNull() & e.isNotNull(), F.greatest(raw, F.lit(0.0)))


def calendar_months(start, end) -> Column:
    """``(y2-y1)*12 + (m2-m1)``."""
    s, e = col_(start), col_(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def is_joint(c) -> Column:
    """Joint-project flag: NULL counts as joint, ``''``/whitespace/``'nan'`` do not."""
    c = col_(c)
    return F.coalesce((py_strip(c) != "") & (c != "nan"), F.lit(True))


def present(c) -> Column:
    """Group label shown in a result: not NULL, not ``''``, not the text ``'nan'``."""
    c = col_(c)
    return c.isNotNull() & (c != "") & (c != "nan")


def present_strict(c) -> Column:
    """As ``present`` and also not whitespace-only."""
    c = col_(c)
    return present(c) & (py_strip(c) != "")


def blank(c) -> Column:
    """NULL or empty or whitespace-only."""
    return F.coalesce(py_strip(col_(c)), F.lit("")) == ""


def not_domestic(country_col) -> Column:
    """Null-safe ``country != home`` — a missing country counts as international."""
    return ~col_(country_col).eqNullSafe(F.lit(dims.DOMESTIC_COUNTRY))


def label_or_code(label, code) -> Column:
    """Lookup result with fallback to the code."""
    return F.coalesce(col_(label), col_(code))


def text_or_code(text, code) -> Column:
    """Description unless blank/'nan', else the code."""
    t = col_(text)
    return F.when(present(t), t).otherwise(col_(code))


def money(c) -> Column:
    """Exact DECIMAL aggregate -> DOUBLE at the output edge."""
    return col_(c).cast("double")


def safe_ratio(num, den) -> Column:
    """NULL when the denominator is 0 or missing."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def iso_datetime(c) -> Column:
    """Date -> ``YYYY-MM-DDT00:00:00`` text (H7)."""
    return F.date_format(col_(c), "yyyy-MM-dd'T'HH:mm:ss")


def german_date_text(c) -> Column:
    """Date -> ``DD.MM.YYYY``."""
    return F.date_format(col_(c), "dd.MM.yyyy")


def german_number_text(c, decimals: int = 2) -> Column:
    """Number -> ``1.234,56``."""
    return F.translate(F.format_number(col_(c).cast("double"), decimals), ",.", ".,")


def thousands_text(c) -> Column:
    """Number -> ``1,234``."""
    return F.format_number(col_(c).cast("double"), 0)


def percent_text(c, decimals: int = 2) -> Column:
    """Percent value -> ``12.34%``."""
    return F.format_string(f"%.{decimals}f%%", col_(c).cast("double"))


def german_currency(c) -> Column:
    """Amount -> ``1.234 €`` with a no-break space, whole euros."""
    return F.concat(german_number_text(c, 0), F.lit("\u00a0€"))


def german_compact_number(c) -> Column:
    """Count -> its digits, grouped from five on; from a million on ``1,2 Mio.`` with a no-break space.

    Two significant digits below ten units, none after the comma from there on.
    """
    v = col_(c).cast("double")

    def short(unit, name):
        q = v / unit
        n = F.when(q < 9.95, F.regexp_replace(german_number_text(q, 1), ",0$", "")).otherwise(german_number_text(q, 0))
        return F.concat(n, F.lit("\u00a0" + name))

    return (F.when(v >= 999.5e9, short(1e12, "Bio.")).when(v >= 999.5e6, short(1e9, "Mrd."))
            .when(v >= 999500, short(1e6, "Mio.")).when(v >= 9999.5, german_number_text(v, 0))
            .otherwise(F.format_string("%.0f", v)))


def cut_text(c, n: int, missing: str = "N/A") -> Column:
    """The first n characters, ``missing`` for NULL or empty text."""
    c = col_(c)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(missing)).otherwise(F.substring(c, 1, n))


def compact_currency(c) -> Column:
    """``€1.2B``-style compact text: T/B/M with one decimal, K and below without; negative
    amounts are not abbreviated (H15)."""
    v = col_(c).cast("double")
    return (F.when(v >= 1e12, F.format_string("€%.1fT", v / 1e12))
            .when(v >= 1e9, F.format_string("€%.1fB", v / 1e9))
            .when(v >= 1e6, F.format_string("€%.1fM", v / 1e6))
            .when(v >= 1e3, F.format_string("€%.0fK", v / 1e3))
            .otherwise(F.format_string("€%.0f", v)))


def truncate_label(c, n: int) -> Column:
    """Cut to n characters and add ``...`` when longer."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def month_name(c) -> Column:
    """Month number -> short name, else the number as text."""
    m = col_(c)
    names = F.array(*[F.lit(x) for x in dims.MONTH_NAMES])
    return F.when((m >= 1) & (m <= 12), F.element_at(names, m)).otherwise(m.cast("string"))


def capitalize(c) -> Column:
    """First character upper-cased, rest lower-cased (H10) for single words."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))
