"""Column functions for the ledgers' text conventions (all JVM-side built-ins).

Each function takes and returns a ``Column`` so it composes inside one
whole-stage-codegen span; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake import schemas as S

ColumnOrName = Column | str

MAX_SERIAL = 2958465  # 9999-12-31, the spreadsheet calendar's last day


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(value: ColumnOrName) -> Column:
    """A cell as a double, null if it is none. A slash, or a digit before a minus sign, is in no number: a
    date is told by that, as a cast that fails raises and catches an exception for each row."""
    c = _c(value)
    return F.when(~c.cast("string").rlike("/|[0-9]-"), c.try_cast("double"))


# F1 -------------------------------------------------------------------------
def parse_ledger_date(value: ColumnOrName, is_serial: ColumnOrName | None = None,
                      as_number: ColumnOrName | None = None) -> Column:
    """Ledger cell → date text.

    A numeric cell is a spreadsheet serial day number and becomes ``YYYY/MM/DD``;
    falsy cells (null, ``''``, 0) become null; other text passes unchanged.
    Serial numbers follow the spreadsheet calendar, which counts a 29 Feb 1900:
    serial 60 is that day, serials 1-59 are one day later than a plain day count
    from 1899-12-31 would suggest for later dates. The fraction (time of day) is
    dropped. Numbers outside 1..2958465 (9999-12-31) are not dates and give null;
    ``bad_serial`` tells them apart.

    ``value`` may be numeric (all rows serial) or text; with text, ``is_serial``
    (default: the text parses as a number) chooses the serial branch.
    ``as_number``: a column that holds ``number(value)``; it is used several times.
    """
    v = _c(value)
    as_num = number(v) if as_number is None else _c(as_number)
    serial = as_num if is_serial is None else F.when(_c(is_serial), as_num)
    day = F.when((serial >= 1) & (serial < MAX_SERIAL + 1), F.floor(serial)).cast("int")
    at = F.date_add(F.lit("1899-12-30").cast("date"), day + F.when(day < 60, 1).otherwise(0))
    from_serial = F.when(day == 60, F.lit("1900/02/29")).otherwise(F.date_format(at, "yyyy/MM/dd"))
    text = v.cast("string")
    falsy = v.isNull() | (text == "") | (as_num == 0)
    return F.when(falsy, F.lit(None).cast("string")).when(serial.isNotNull(), from_serial).otherwise(text)


def bad_serial(value: ColumnOrName, as_number: ColumnOrName | None = None) -> Column:
    """True for a number that is no serial day (0 and blank are empty cells, not bad ones)."""
    n = number(value) if as_number is None else _c(as_number)
    return F.coalesce((n != 0) & ((n < 1) | (n >= MAX_SERIAL + 1) | F.isnan(n)), F.lit(False))


# F2 -------------------------------------------------------------------------
def month_label(date_text: ColumnOrName) -> Column:
    """``YYYY-MM`` label of a ledger date.

    With a ``/``: the text before the first ``/`` plus the month token (leading
    digits of the next part, as an integer, 0 when it has none) padded to two.
    Without: the first seven characters. Null stays null.
    """
    d = _c(date_text)
    year = F.substring_index(d, "/", 1)
    rest = F.substring(d, F.instr(d, "/") + 1, 1 << 30)
    # integer reading of the month token: optional blanks and sign, then digits
    month_digits = F.trim(F.regexp_extract(rest, r"^ *[-+]?[0-9]+", 0))
    month = F.coalesce(month_digits.try_cast("bigint"), F.lit(0))
    return F.when(d.contains("/"), F.format_string("%s-%02d", year, month)).otherwise(F.substring(d, 1, 7))


# F3 -------------------------------------------------------------------------
def iso_date_text(date_text: ColumnOrName) -> Column:
    """Date text as ``YYYY-MM-DD`` for a date input field.

    Three ``/`` parts: year, month padded to 2, day cut to 2 characters then
    padded. Otherwise ``/`` becomes ``-`` and the first 10 characters are kept.
    Null or ``''`` gives ``''``.
    """
    d = _c(date_text)
    parts = F.split(d, "/")
    three = F.size(parts) == 3
    day = F.substring(F.get(parts, 2), 1, 2)
    slash = F.concat_ws("-", F.get(parts, 0), pad2(F.get(parts, 1)), pad2(day))
    other = F.substring(F.regexp_replace(d, "/", "-"), 1, 10)
    return F.when(d.isNull() | (d == ""), F.lit("")).when(three, slash).otherwise(other)


def pad2(c: Column) -> Column:
    """Left-pad to two characters with ``0``; longer text is kept whole (not cut)."""
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def to_ledger_date(date_text: ColumnOrName) -> Column:
    """Parsed DATE of ledger text in slash (padded or not) or ISO form; else null."""
    d = _c(date_text)
    return F.coalesce(F.try_to_date(d, "yyyy/M/d"), F.try_to_date(d, "yyyy-M-d"))


# F4 -------------------------------------------------------------------------
def trim_probability(p: ColumnOrName) -> Column:
    """Probability as text with one trailing ``.0`` removed; null and ``''`` kept."""
    return F.regexp_replace(_c(p).cast("string"), r"\.0\z", "")


# F5 -------------------------------------------------------------------------
def surname(name: ColumnOrName, mode: str = "ascii") -> Column:
    """First token of a person's name.

    ``ascii`` splits on U+0020 only (workload lookup); ``any`` splits on U+0020
    or the ideographic space U+3000 (employee delete). No space gives the whole
    name; a leading space gives ``''``.
    """
    n = _c(name)
    if mode == "ascii":
        return F.split_part(n, F.lit(" "), F.lit(1))
    if mode == "any":
        return F.get(F.split(n, "[ 　]"), 0)
    raise ValueError(f"unknown surname mode {mode!r}")


# F6 / F7 --------------------------------------------------------------------
def default_if_blank(c: ColumnOrName, default: str) -> Column:
    """Missing (null or ``''``) → ``default``."""
    col = _c(c)
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


# F8 / F9 / F10 --------------------------------------------------------------
def effective_amount(contract: ColumnOrName = "contract_amount",
                     estimate: ColumnOrName = "estimate_amount") -> Column:
    """Contract amount when present (0 included), else the estimate."""
    return F.coalesce(_c(contract), _c(estimate))


def count_if(cond: Column) -> Column:
    """Σ 1 where ``cond`` holds, 0 on empty input (an aggregate)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def sum_if(cond: Column, amount: ColumnOrName) -> Column:
    """Σ amount where ``cond`` holds, 0 on empty input (an aggregate)."""
    return F.coalesce(F.sum(F.when(cond, _c(amount)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def zero_if_null(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c), F.lit(0))


# Status classes (P2) ---------------------------------------------------------
def is_contracted(status: ColumnOrName = "status") -> Column:
    return _c(status) == S.STATUS_CONTRACTED


def is_lost(status: ColumnOrName = "status") -> Column:
    return _c(status) == S.STATUS_LOST


def is_pipeline(status: ColumnOrName = "status") -> Column:
    """Open deals: not contracted, lost or done. A null status is in no class."""
    return ~_c(status).isin(S.STATUS_CONTRACTED, S.STATUS_LOST, S.STATUS_DONE)


def is_paid(payment_status: ColumnOrName = "payment_status") -> Column:
    return _c(payment_status) == S.PAYMENT_PAID


def is_unpaid(payment_status: ColumnOrName = "payment_status") -> Column:
    """Any non-null state other than paid; null is neither paid nor unpaid."""
    return _c(payment_status) != S.PAYMENT_PAID
