"""Column expressions used across the engine. All are built-in Spark
expressions (JVM side, whole-stage codegen); no Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters a report sheet name may not contain, its maximum
# length, and the note pattern that older report descriptions carry.
SHEET_FORBIDDEN = "[]:*?/\\"
SHEET_MAX_LEN = 31
MASKED_NOTE_PATTERN = r"(?s)此分組包含 \d+ 組被遮蔽資料.*?宅）"
MASKED_NOTE_TEMPLATE = "此分組包含 {n} 組被遮蔽資料（樣本數小於 3 筆）。（而未經篩選及遮蔽的本分組總計應為: {ref} 宅）"
DATASET_PREFIXES = {"稅電": "power", "所有權": "ownership", "稅籍": "tax"}
PERCENT_MARK = "(%)"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den as double; NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def ratio_or_zero(num: str | Column, den: str | Column) -> Column:
    """num / den, 0 when den is 0 (reference total-row average rule)."""
    n, d = col_(num).cast("double"), col_(den).cast("double")
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def ratio_inf(num: str | Column, den: str | Column, zero_over_zero: Column | None = None) -> Column:
    """num / den with float semantics of x/0: +-inf, and 0/0 -> ``zero_over_zero``
    (NULL by default)."""
    n, d = col_(num).cast("double"), col_(den).cast("double")
    z = zero_over_zero if zero_over_zero is not None else F.lit(None).cast("double")
    return (F.when(d.isNull() | n.isNull(), F.lit(None).cast("double"))
            .when(d != 0, n / d)
            .when(n > 0, F.lit(float("inf")))
            .when(n < 0, F.lit(float("-inf")))
            .otherwise(z))


def typed_value(dtype: T.DataType, value):
    """``value`` as the column's own type, exactly; None if no value of that
    type equals it (so the column can be compared as it is, and the comparison
    reaches the scan)."""
    if value is None:
        return None
    if isinstance(dtype, T.StringType):
        return str(value)
    try:
        if isinstance(dtype, (T.IntegralType, T.DecimalType)):
            number = Decimal(str(value).strip()) if not isinstance(value, bool) else Decimal(int(value))
            if not number.is_finite():
                return None
            if isinstance(dtype, T.DecimalType):
                return number if number == round(number, dtype.scale) else None
            whole = number == number.to_integral_value()
            return int(number) if whole and -(1 << 63) <= number < 1 << 63 else None
        if isinstance(dtype, T.NumericType):
            return float(value)
        if isinstance(dtype, T.DateType):
            return value if isinstance(value, date) and not isinstance(value, datetime) else date.fromisoformat(str(value))
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
        if isinstance(dtype, T.BooleanType):
            return {"true": True, "false": False}.get(str(value).lower())
    except (ValueError, InvalidOperation):
        return None
    return value


def coerce_filter_values(dtype: T.DataType, values: Sequence) -> list:
    """IN-list values in the column's type; those that cannot match are left
    out. In a list for a number column that holds some text that is no number,
    only the numbers count."""
    vals = list(values)
    if isinstance(dtype, T.NumericType):
        def number(v) -> bool:
            try:
                float(v)
                return True
            except (TypeError, ValueError):
                return False

        if not all(number(v) for v in vals):
            vals = [v for v in vals if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)]
    return [t for t in (typed_value(dtype, v) for v in vals) if t is not None]


def isin_coerced(c: str, dtype: T.DataType, values: Sequence) -> Column:
    vals = coerce_filter_values(dtype, values)
    return F.col(c).isin(vals) if vals else F.lit(False)


def equals_value(c: str, dtype: T.DataType, value) -> Column:
    """The column equals a value that may be kept as text ('2021' finds 2021)."""
    typed = typed_value(dtype, value)
    return F.col(c) == F.lit(typed) if typed is not None else F.lit(False)


def numeric_text(c: str | Column) -> Column:
    """True when the text is digits and dots (a 'numeric-looking' label)."""
    return col_(c).cast("string").rlike(r"^[0-9.]+$") & (F.regexp_replace(col_(c).cast("string"), r"\.", "") != "")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col_(path), "/"), -1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_extract(basename(path), r"^(.*?)(\.[^.]*)?$", 1)


def data_suffix(path: str | Column) -> Column:
    """What follows the last '/data/' of a path (either slash); NULL without it."""
    return F.nullif(F.regexp_extract(F.translate(col_(path), "\\", "/"), "^.*/data/(.*)$", 1), F.lit(""))


def dataset_prefix(name: str | Column) -> Column:
    """Text before '_coded' in a file name."""
    return F.substring_index(basename(name), "_coded", 1)


def dataset_type(name: str | Column) -> Column:
    """Dataset section routed by file-name prefix; NULL for unknown prefixes."""
    mapping = F.create_map(*[x for k, v in DATASET_PREFIXES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(mapping, dataset_prefix(name))


def sheet_name(chapter: str | Column, position: str | Column) -> Column:
    """Chapter without forbidden characters, at most 31 characters; one without
    any left becomes Report_<position>. Sheets of equal names are told apart by
    the report batch, which reports the later one as an error."""
    clean = F.trim(F.translate(F.coalesce(col_(chapter), F.lit("")), SHEET_FORBIDDEN, ""))
    return F.substring(F.when(clean != "", clean).otherwise(F.concat(F.lit("Report_"), col_(position).cast("string"))),
                       1, SHEET_MAX_LEN)


def strip_ws(c: str | Column) -> Column:
    """Remove leading / trailing whitespace of any kind (newlines included)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def strip_masked_note(desc: str | Column) -> Column:
    return strip_ws(F.regexp_replace(F.coalesce(col_(desc), F.lit("")), MASKED_NOTE_PATTERN, ""))


def fmt_count(c: str | Column) -> Column:
    return F.format_number(col_(c).cast("double"), 0)


def fmt_decimal(c: str | Column) -> Column:
    return F.format_number(col_(c).cast("double"), 2)


def fmt_percent(c: str | Column) -> Column:
    return F.concat(F.format_number(col_(c).cast("double") * 100, 2), F.lit("%"))


def format_class(name: str | Column) -> Column:
    """Display format of a report column chosen from its name."""
    n = col_(name)
    return (F.when(n.contains(PERCENT_MARK), F.lit("percent"))
            .when(n.contains("平均") | F.lower(n).contains("age"), F.lit("decimal2"))
            .otherwise(F.lit("integer")))


def epoch_text(ts: str | Column) -> Column:
    return F.date_format(col_(ts), "yyyy-MM-dd HH:mm:ss")


def all_not_null(cols: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def conj(preds: Iterable[Column]) -> Column:
    out = None
    for p in preds:
        out = p if out is None else (out & p)
    return out if out is not None else F.lit(True)
