"""Text and hash scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_fragments(a: Column, b: Column) -> Column:
    """Two readings as one where one holds the other or they share two or more characters at the seam; else null."""
    most = F.least(F.length(a), F.length(b)) - 1
    shared = F.filter(F.when(most >= 2, F.sequence(most, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.endswith(a, F.substring(b, F.lit(1), k)))
    k = F.get(shared, F.lit(0))
    return F.when(a == "", b).when(F.contains(a, b), a).when(F.contains(b, a), b).when(k.isNotNull(), F.concat(a, F.substring(b, k + 1, F.length(b))))


def merge_text(a: Column, b: Column) -> Column:
    return F.coalesce(join_fragments(a, b), F.concat_ws(" ", a, b))


def ascii_label(text: Column) -> Column:
    """Signs of drawings spelt in ASCII; other characters beyond it become '?'."""
    for sign, plain in (("Ø", "D"), ("±", "+-"), ("°", "deg")):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def md5_mod_1000(text: Column) -> Column:
    """The md5 of a text, as a 128-bit number, modulo 1000 (2^64 leaves 616)."""
    h = F.md5(text.cast("binary"))
    half = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") % 1000
    return ((half(1) * 616 + half(17)) % 1000).cast("int")


def split_of(image_id: Column, train: int = 800, valid: int = 100) -> Column:
    r = md5_mod_1000(image_id)
    return F.when(r < train, "train").when(r < train + valid, "valid").otherwise("test")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


#: File name endings that can be read (fixed values).
SUPPORTED = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".pdf")
