"""Predicates over columns that tell what is accepted, or why not."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import path_name, safe_filename, strip, suffix

#: Hosts of lecture pages.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "www.youtu.be")
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
#: Characters that are not seen, or turn the order of those that are.
UNSEEN = "\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff"
VIDEO_TYPES = (".mp4", ".webm", ".mov", ".mkv")


def is_job_id(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{8}\z")


def new_job_id() -> Column:
    """A random id of 32 bits; ids may meet, as the length is given."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def is_query(c: Column) -> Column:
    return F.length(strip(c)).between(1, 200)


def is_video_name(c: Column) -> Column:
    """Judged by the name as it would be stored."""
    return F.lower(suffix(safe_filename(c))).isin(*VIDEO_TYPES)


def _url_parts(c: Column) -> dict[str, Column]:
    """scheme, name, password, host, port and path of a URL by its generic syntax; a part that isn't there is empty.

    White space at the ends, control characters before it and line ends inside it don't count.
    """
    url = F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
    after = lambda pattern: F.regexp_extract(url, scheme + pattern, 2)
    authority = after(r"(?://([^/?#]*))?")
    who, where = F.regexp_extract(authority, r"(?s)\A(.*)@", 1), F.regexp_replace(authority, r"(?s)\A.*@", "")
    path = after(r"(?://[^/?#]*)?([^?#]*)")
    return {
        "scheme": F.lower(F.regexp_extract(url, scheme, 1)),
        "name": F.regexp_extract(who, r"(?s)\A([^:]*)", 1), "password": F.regexp_extract(who, r"(?s):(.*)\z", 1),
        "host": F.lower(F.regexp_extract(where, r"(?s)\A([^:]*)", 1)), "port": F.regexp_extract(where, r"(?s)\A[^:]*:(.*)\z", 1),
        "path": F.regexp_replace(path, r"(?s);[^/]*\z", ""),
    }


def url_fault(c: Column) -> Column:
    """Why a lecture URL is refused; null if it isn't."""
    u = _url_parts(c)
    return (
        F.when(u["scheme"] != "https", "scheme")
        .when(~u["host"].isin(*HOSTS), "host")
        .when((u["name"] != "") | (u["password"] != ""), "userinfo")
        .when(u["port"] != "", "port")
        .when(u["path"] == "", "path")
    )


def url_fault_strict(c: Column) -> Column:
    """As url_fault, where dots may end the host, and the path must name one video."""
    u = _url_parts(c)
    host, path = F.rtrim(u["host"], F.lit(".")), u["path"]
    one = F.when(host.isin(*SHORT_HOSTS), ~path.isin("", "/")).otherwise(path.startswith("/watch") | path.startswith("/shorts/") | path.startswith("/embed/"))
    return (
        F.when(u["scheme"] != "https", "scheme")
        .when((u["name"] != "") | (u["password"] != ""), "userinfo")
        .when(u["port"] != "", "port")
        .when(~host.isin(*HOSTS), "host")
        .when(~one, "video")
    )


def fps_ok(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0.1, 3.0)


def size_ok(n: Column) -> Column:
    """Bytes of an upload: some, and 4 GiB at most."""
    return (n > 0) & (n <= 4 << 30)


def is_slide_name(c: Column) -> Column:
    return c.rlike(r"(?i)^[A-Z0-9_.-]+\.jpg\z")


def is_image_name(c: Column) -> Column:
    return F.lower(suffix(path_name(c))).isin(".jpg", ".jpeg", ".png")


def source_fault(url: Column, video: Column) -> Column:
    """A job has one source: a URL that isn't blank, or a video."""
    by_url, by_video = strip(F.coalesce(url, F.lit(""))) != "", video.isNotNull()
    return F.when(by_url & by_video, "both").when(~by_url & ~by_video, "none")


def unseen_characters(c: Column, named: bool = False) -> Column:
    """The code points (U+XXXX, or U+XXXX (NAME)) of characters in UNSEEN, in order."""
    found = F.regexp_extract_all(c, F.lit(f"[{UNSEEN}]"), F.lit(0))
    names = F.create_map(*[F.lit(x) for k, v in unseen_names().items() for x in (k, v if named else v.partition(" ")[0])])
    return F.transform(found, lambda x: F.element_at(names, x))


def unseen_names() -> dict[str, str]:
    """Each character of UNSEEN with what it is called."""
    every = [ch for a, b in re.findall(r"(.)(?:-(.))?", UNSEEN) for ch in map(chr, range(ord(a), ord(b or a) + 1))]
    return {ch: f"U+{ord(ch):04X} ({unicodedata.name(ch, 'UNKNOWN')})" for ch in every}


def frame_budget_ok(duration: Column, fps: float = 3.0, most: int = 100_000) -> Column:
    return F.when(duration.isNull() | F.isnan(duration) | (duration <= 0), True).otherwise(F.ceil(duration * fps) <= most)
