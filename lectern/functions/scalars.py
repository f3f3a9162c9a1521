"""Scalar functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: White space as Python has it, in a class of Java's patterns with (?U).
WHITE = r"[\s\x{1c}-\x{1f}]"


def clean_text(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U){WHITE}+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends. A run is met once, so long ones cost no more than their length."""
    return F.regexp_replace(c, rf"(?U)\A{WHITE}++|(?<!{WHITE}){WHITE}++\z", "")


def format_time(seconds: Column) -> Column:
    """MM:SS, minutes not rolling into hours."""
    s = F.greatest(F.lit(0), F.floor(F.when(F.isnan(seconds) | seconds.isNull(), 0.0).otherwise(seconds))).cast("long")
    return F.format_string("%02d:%02d", (s / 60).cast("long"), s % 60)


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5).cast("long")
    h, m, r = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def format_bytes(n: Column) -> Column:
    kib, mib, gib = 1024.0, 1024.0**2, 1024.0**3
    return F.when(n < mib, F.format_string("%.1f KB", n / kib)).when(n < gib, F.format_string("%.1f MB", n / mib)).otherwise(F.format_string("%.2f GB", n / gib))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def path_name(path: Column) -> Column:
    """The last part of a path between slashes; empty parts and dots that stand alone are none."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def suffix(name: Column) -> Column:
    """The last dot of a name and what follows it; empty if either side of it is."""
    return F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1)


def safe_filename(name: Column, fallback: str = "lecture") -> Column:
    """The last path part with only letters, digits and ._ - left, no double dots, no dots or spaces at its ends."""
    c = F.regexp_replace(path_name(name), r"[^A-Za-z0-9._ -]", "_")
    c = F.trim(F.replace(c, F.lit(".."), F.lit("_")), F.lit(" ."))
    return F.when(c == "", fallback).otherwise(c)


def fit_to_page(w: Column, h: Column, page_w: float = 842.0, page_h: float = 595.0, margin: float = 24.0) -> list[Column]:
    """x, y, width and height of an image scaled evenly to a page inside its margin and centred."""
    scale = F.least(F.lit(page_w - 2 * margin) / w, F.lit(page_h - 2 * margin) / h)
    return [(F.lit(page_w) - w * scale) / 2, (F.lit(page_h) - h * scale) / 2, w * scale, h * scale]


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(c: Column) -> Column:
    """Normal form C. Texts whose characters all lie below the combining marks are in it, and don't go to Python."""
    other = c.rlike(r"[^\x{0}-\x{2ff}]")
    return F.when(other, _compose(F.when(other, c))).otherwise(c)


#: Names that stand for devices.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def storage_filename(name: Column, fallback: str = "lecture", most: int = 180) -> Column:
    """A title as a file name: letters of any script stay, composed; unseen and control characters go; others that a file
    system refuses become underscores."""
    from .validation import UNSEEN

    c = F.regexp_replace(composed(F.coalesce(name, F.lit(""))), f"[{UNSEEN}]", "")
    c = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f]", "")
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.rtrim(F.when(c.isin(".", ".."), fallback).otherwise(c), F.lit(" ."))
    c = F.when(c == "", fallback).otherwise(c)
    stem = F.upper(F.regexp_replace(c, r"(?<=.)\.[^.]+$", ""))
    c = F.when(stem.isin(*DEVICES), F.concat(F.lit("_"), c)).otherwise(c)
    return F.when(F.length(c) > most, F.rtrim(F.substring(c, 1, most), F.lit(" ."))).otherwise(c)


def image_url(job: Column, path: Column) -> Column:
    return F.concat(F.lit("/jobs/"), job, F.lit("/slides/"), F.replace(F.url_encode(basename(path)), F.lit("+"), F.lit("%20")))


def ratio(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.concat(F.format_string("%.2f", c), F.lit("×")))


def preview(c: Column, most: int = 180) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def midpoint(start: Column, end: Column) -> Column:
    """The middle of a word; one that ends before it starts raises."""
    return F.when(end < start, F.raise_error(F.lit("a word ends before it starts"))).otherwise(start + (end - start) / 2)
