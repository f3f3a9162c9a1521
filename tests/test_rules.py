"""Rules on names, URLs and white space, with the standard library as the judge."""

import random
import unicodedata
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import functions as F

from lectern.functions import scalars, validation
from lectern.plans.queries import NAMES, URLS


def values(spark, items, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").coalesce(1)
    return [tuple(r)[1:] for r in sorted(rows.select("i", *columns).collect())]


def accepted(url, strict):
    url = url.strip()
    try:
        u = urlparse(url)
        port = u.port
    except ValueError:
        return False
    host = (u.hostname or "").lower()
    host = host.rstrip(".") if strict else host
    if u.scheme != "https" or host not in validation.HOSTS or u.username or u.password or port is not None or not u.path:
        return False
    return not strict or (u.path != "/" if "youtu.be" in host else u.path.startswith(("/watch", "/shorts/", "/embed/")))


def test_urls_as_urlparse(spark):
    r = random.Random(1)
    parts = ["https:", "HTTPS:", "http:", "//", "/", "youtube.com", "youtu.be", "www.youtu.be", "M.youtube.com", ".", "/watch", "/shorts/", "@", ":", ":80", "u", "?", "#", ";", " ", "\t", "\n", " ", "|", "x"]
    urls = [*URLS, *("https://" + "".join(r.choices(parts[3:], k=r.randrange(1, 7))) for _ in range(600)), *("".join(r.choices(parts, k=r.randrange(1, 8))) for _ in range(400)), *("https://" + r.choice(parts[5:9]) + "".join(r.choices(["", "", ".", ":", "/watch", "/shorts/", "/", "x"], k=r.randrange(1, 5))) for _ in range(300))]
    got = values(spark, urls, validation.url_fault(F.col("x")).isNull(), validation.url_fault_strict(F.col("x")).isNull())
    want = [(accepted(u, False), accepted(u, True)) for u in urls]
    assert {u: (g, w) for u, g, w in zip(urls, got, want, strict=True) if g != w} == {}
    assert sum(a for a, _ in want) > 60 and sum(b for _, b in want) > 20


def test_names_as_pathlib(spark):
    r = random.Random(2)
    names = [*NAMES, *("".join(r.choices(["/", ".", "..", "a", " ", ".mp4", ".JPG", "\\", "é", "\n"], k=r.randrange(1, 7))) for _ in range(300))]
    got = values(spark, names, scalars.path_name(F.col("x")), scalars.suffix(scalars.path_name(F.col("x"))), validation.is_image_name(F.col("x")))
    for n, (name, end, image) in zip(names, got, strict=True):
        p = PurePosixPath(n)
        last = "" if p.name in ("", ".") else p.name
        at = last.rfind(".")
        assert (name, end) == (last, last[at:] if 0 < at < len(last) - 1 else ""), n
        assert image == (end.lower() in (".jpg", ".jpeg", ".png"))
    assert dict(zip(NAMES, values(spark, NAMES, validation.is_video_name(F.col("x"))), strict=True))["a.mp4 "] == (True,)
    assert dict(zip(NAMES, values(spark, NAMES, validation.is_video_name(F.col("x"))), strict=True))[".mp4"] == (False,)


def test_strip_as_python(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["", "x", "​", "  x\n\ty  ", " " * 100_000 + "x" + " " * 100_000 + "y" + "\t" * 100_000]
    texts = [*spaces, *(f"{c}a{c}b{c}" for c in spaces[:-1])]
    assert [g for (g,) in values(spark, texts, scalars.strip(F.col("x")))] == [t.strip() for t in texts]
    assert values(spark, ["\t\n", "\t" * 201 + "x", " ", "x" * 200, "x" * 201], validation.is_query(F.col("x"))) == [(False,), (True,), (False,), (True,), (False,)]


def test_composed_as_python(spark):
    texts = ["plain", "café", "café", "각", "ọ̈", "Ω", "", "́"]
    assert [g for (g,) in values(spark, texts, scalars.composed(F.col("x")))] == [unicodedata.normalize("NFC", t) for t in texts]
    assert values(spark, [None], scalars.composed(F.col("x"))) == [(None,)]


def test_unseen_names(spark):
    got = values(spark, ["a​b﻿", "", None], validation.unseen_characters(F.col("x"), named=True), validation.unseen_characters(F.col("x")))
    assert got[0] == (["U+200B (ZERO WIDTH SPACE)", "U+FEFF (ZERO WIDTH NO-BREAK SPACE)"], ["U+200B", "U+FEFF"]) and got[1] == ([], []) and got[2] == (None, None)
    assert len(validation.unseen_names()) == 27
