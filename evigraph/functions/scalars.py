"""The interpreter's scalar library as Column expressions.

Indexes count from 0 and negative ones from the end; padding never truncates;
rounding is half up; missing elements are null. Each function takes Columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# arrays
def at(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def index_of(a: Column, x: Column) -> Column:
    return F.coalesce(F.array_position(a, x) - 1, F.lit(-1))


def last_index_of(a: Column, x: Column) -> Column:
    p = F.array_position(F.reverse(a), x)
    return F.when(p > 0, F.size(a) - p).otherwise(F.lit(-1)).cast("long")


def _bound(n: Column, i: int | None, default: Column) -> Column:
    if i is None:
        return default
    return F.least(n, F.lit(i)) if i >= 0 else F.greatest(n + i, F.lit(0))


def slice_(a: Column, start: int = 0, end: int | None = None) -> Column:
    n = F.size(a)
    lo, hi = _bound(n, start, F.lit(0)), _bound(n, end, n)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def splice(a: Column, start: int, count: int, *items: Column) -> Column:
    head = slice_(a, 0, start)
    return F.concat(head, F.array(*items) if items else F.slice(a, 1, 0), F.slice(a, F.size(head) + 1 + count, F.size(a)))


def with_(a: Column, i: int, v: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == (F.lit(i) if i >= 0 else F.size(a) + i), v).otherwise(x))


def fill(a: Column, v: Column, start: int = 0, end: int | None = None) -> Column:
    n = F.size(a)
    lo, hi = _bound(n, start, F.lit(0)), _bound(n, end, n)
    return F.transform(a, lambda x, k: F.when((k >= lo) & (k < hi), v).otherwise(x))


def copy_within(a: Column, target: int, start: int, end: int | None = None) -> Column:
    part = slice_(a, start, end)
    n = F.size(part)
    return F.transform(a, lambda x, k: F.when((k >= target) & (k < target + n), F.try_element_at(part, (k - target + 1).cast("int"))).otherwise(x))


def join(a: Column, sep: str) -> Column:
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep)


def find(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(a, f), F.lit(1))


def find_last(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(a, f), F.lit(-1))


def find_index(a: Column, f: Callable[[Column], Column]) -> Column:
    return (F.array_position(F.transform(a, f), True) - 1).cast("long")


def find_last_index(a: Column, f: Callable[[Column], Column]) -> Column:
    return last_index_of(F.transform(a, f), F.lit(True))


def reduce_right(a: Column, init: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.reverse(a), init, f)


# strings
def char_at(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1)


def string_at(s: Column, i: int) -> Column:
    k = F.lit(i) if i >= 0 else F.length(s) + i
    return F.when((k >= 0) & (k < F.length(s)), F.substr(s, k + 1, F.lit(1)))


def string_slice(s: Column, start: int, end: int | None = None) -> Column:
    n = F.length(s)
    lo, hi = _bound(n, start, F.lit(0)), _bound(n, end, n)
    return F.substr(s, lo + 1, F.greatest(hi - lo, F.lit(0)))


def substring(s: Column, a: int, b: int) -> Column:
    lo, hi = max(0, min(a, b)), max(0, a, b)
    return F.substring(s, lo + 1, hi - lo)


def string_index_of(s: Column, x: str) -> Column:
    return F.instr(s, x) - 1


def string_last_index_of(s: Column, x: Column) -> Column:
    at_ = F.instr(F.reverse(s), F.reverse(x))
    return F.when(at_ > 0, F.length(s) - at_ - F.length(x) + 1).otherwise(F.lit(-1))


def pad_start(s: Column, n: int, fill_: str = " ") -> Column:
    return F.lpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(fill_))


def pad_end(s: Column, n: int, fill_: str = " ") -> Column:
    return F.rpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(fill_))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def replace_first(s: Column, old: str, new: str) -> Column:
    at_ = F.instr(s, old)
    return F.when(at_ > 0, F.overlay(s, F.lit(new), at_, F.lit(len(old)))).otherwise(s)


def split(s: Column, sep: str, limit: int | None = None) -> Column:
    parts = F.split(s, "\\Q" + sep + "\\E", -1)
    return parts if limit is None else F.slice(parts, 1, limit)


def search(s: Column, pattern: str) -> Column:
    return F.regexp_instr(s, F.lit(pattern)) - 1


def escape(s: Column) -> Column:
    return F.concat(F.lit("\\Q"), s, F.lit("\\E"))


@F.pandas_udf(StringType())
def normalize_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def from_code_point(n: pd.Series) -> pd.Series:
    return n.map(lambda x: chr(int(x)), na_action="ignore")


# numbers
def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def clz32(x: Column) -> Column:
    """Leading zeros of the unsigned 32-bit value."""
    low = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low == 0, 32).otherwise(32 - F.length(F.bin(low)))


def imul(a: Column, b: Column) -> Column:
    """Signed 32-bit product: halves keep the 64-bit product from overflowing."""
    al, ah = a.cast("long").bitwiseAND(F.lit(0xFFFF)), F.shiftright(a.cast("long"), 16).bitwiseAND(F.lit(0xFFFF))
    low = b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    total = (al * low + F.shiftleft((ah * low).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total)


def fround(x: Column) -> Column:
    return x.cast("float").cast("double")


def is_integer(x: Column) -> Column:
    return is_finite(x) & (x == F.floor(x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_safe_integer(x: Column) -> Column:
    return is_integer(x) & (F.abs(x) <= 9007199254740991)


def parse_int(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("long")


def parse_float(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


# dates (milliseconds since the epoch)
def month(ts: Column) -> Column:
    return F.month(ts) - 1


def day(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def to_iso_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def set_part(ts: Column, **parts: Column) -> Column:
    """A timestamp with some of year, month (from 0), day, hour, minute and second replaced."""
    own = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}
    own |= {k: v + 1 if k == "month" else v for k, v in parts.items()}
    return F.make_timestamp(own["year"], own["month"], own["day"], own["hour"], own["minute"], own["second"])


# maps
def get_or(m: Column, k: Column, v: Column) -> Column:
    return F.coalesce(F.try_element_at(m, k), v)


def delete(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def put(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def query_params(url: Column) -> Column:
    return F.str_to_map(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))
