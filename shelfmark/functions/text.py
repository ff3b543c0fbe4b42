"""Scalar functions of catalogs: folding, sort keys, path parts, texts for display, and list dates.

Paths and names are BINARY, for they need not be UTF-8. Byte-wise work is done on their ISO-8859-1
decoding, in which each byte is one character.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition, and what they fold to.
BASES = {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "ħ": "h", "Ħ": "h", "ŧ": "t", "Ŧ": "t", "ı": "i", "ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}
FILETIME_EPOCH = 11_644_473_600


@cache
def fold_char(c: str) -> str:
    return "".join(BASES.get(d) or d.lower() for d in unicodedata.normalize("NFD", c) if not unicodedata.category(d).startswith("M"))


def fold(text: str) -> str:
    """Accents and case gone; the needle's side of `folded`."""
    return text.lower() if text.isascii() else "".join(map(fold_char, text))


def fold_with_offsets(text: str) -> tuple[str, list[int]]:
    """The folded text, and the place in `text` of each of its characters."""
    parts = [fold_char(c) for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def highlights(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Merged ranges of `text` in which a folded term is found."""
    flat, at = fold_with_offsets(text)
    spans = []
    for t in filter(None, terms):
        i = flat.find(t)
        while i >= 0:
            spans.append((at[i], at[i + len(t) - 1] + 1))
            i = flat.find(t, i + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@cache
def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    """From Unicode's data: characters that fold to one or none (for translate, the dropped last), and the others."""
    one, gone, more = [], [], []
    for i in range(0x80, 0x110000):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        f = fold_char(c)
        if f == c:
            continue
        (gone if not f else one if len(f) == 1 else more).append((c, f))
    return "".join(c for c, _ in one + gone), "".join(f for _, f in one), more


def folded(text: Column) -> Column:
    """Native fold of a string column; Hangul syllables fold through `fold_udf` only."""
    source, target, more = _tables()
    for c, f in more:
        text = F.replace(text, F.lit(c), F.lit(f))
    return F.lower(F.translate(text, source, target))


def fold_udf(text: Column) -> Column:
    """The fold of any text, Hangul too, for ingest; an Arrow function."""
    return F.pandas_udf(lambda names: names.map(lambda x: None if x is None else fold(x)), "string")(text)


def bytes_of(text: Column) -> Column:
    """ISO-8859-1 decoding of a binary column: a character a byte."""
    return F.decode(text, "ISO-8859-1")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_key(path: Column) -> Column:
    """Orders paths by component: the separator is below every byte."""
    return F.replace(bytes_of(path), F.lit("/"), F.lit("\0"))


def parent_of(raw: Column) -> Column:
    """Parent of a path in byte form; null if it has none."""
    head = F.regexp_extract(raw, "(?s)^(.*)/[^/]*$", 1)
    return F.when((raw == "/") | ~raw.contains("/"), None).otherwise(F.when(head == "", "/").otherwise(head))


def name_of(raw: Column) -> Column:
    return F.when(raw == "/", raw).otherwise(F.regexp_extract(raw, "(?s)([^/]*)$", 1))


def within(path: Column, root: Column | str) -> Column:
    """path (byte form) is root or below it."""
    root = F.lit(root) if isinstance(root, str) else root
    return (root == "/") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def sort_extension(name: Column) -> Column:
    """After the last dot, lower-cased; none for a leading dot."""
    return ascii_lower(F.regexp_extract(name, r"(?s)^.+[.]([^.]*)$", 1))


def filter_extension(name: Column) -> Column:
    """After the last dot, a leading one too, lower-cased; null without a dot."""
    return F.when(name.contains("."), ascii_lower(F.substring_index(name, ".", -1)))


def natural_key(name_fold: Column) -> Column:
    """Names in natural order: each run of digits becomes its length and the digits without leading zeros."""

    def run(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        n = F.length(digits)
        head = F.when(n <= 8, n.cast("string")).otherwise(F.concat(F.lit("9"), F.char(F.least(n, F.lit(255)))))
        return F.when(x.rlike("^[0-9]"), F.concat(head, digits)).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(name_fold, F.lit("([0-9]+|[^0-9]+)"), 1), run), "")


def human_size(n: Column) -> Column:
    """B, KB, MB or GB with one decimal."""
    out = F.format_string("%.1f GB", n / 1024.0**3)
    for unit, size in (("MB", 1024.0**2), ("KB", 1024.0)):
        out = F.when(n < size * 1024, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def local_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def type_label(kind: Column, extension: Column) -> Column:
    file = F.when(extension == "", "File").otherwise(F.concat(F.upper(extension), F.lit(" file")))
    return F.when(kind == "folder", "Folder").when(kind == "link", "Link").when(kind == "file", file).otherwise("Other")


def filetime(seconds: Column) -> Column:
    return (seconds + FILETIME_EPOCH) * 10_000_000


def list_date(text: Column) -> Column:
    """Epoch seconds of a file list's date: ticks, or one of its text forms; null if it is none."""
    t = F.trim(text)
    ticks = F.when(t.rlike("^[+-]?[0-9]+$"), F.floor(t.try_cast("bigint") / 10_000_000) - FILETIME_EPOCH)
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(ticks, *[F.unix_seconds(F.try_to_timestamp(t, F.lit(f))) for f in forms])


def attributes(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.coalesce(F.when(t.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(t, 3, 8), 16, 10)).when(t.rlike("^[0-9]{1,10}$"), t).try_cast("bigint"), F.lit(0))


def mapped_path(path: Column, old: str, new: str) -> Column:
    """A listed path under `new` if it starts with `old` whatever its case and separators; null if not, or with . or .. parts."""
    path, old = F.replace(path, F.lit("\\"), F.lit("/")), old.replace("\\", "/").rstrip("/")
    rest = F.substring(path, F.lit(len(old) + 1), F.length(path))
    clean = F.regexp_replace(rest, "^/+", "")
    fits = (ascii_lower(F.substring(path, F.lit(1), F.lit(len(old)))) == old.lower()) if old else F.lit(True)
    fits &= ((rest == "") | rest.startswith("/")) & ~clean.rlike(r"(^|/)[.][.]?(/|$)")
    return F.when(fits, F.when(clean == "", new).otherwise(F.concat(F.lit(new.rstrip("/") + "/"), clean)))


def changed_case(text: str, how: str) -> str:
    """lower, upper, title (each word) or sentence (the first letter)."""
    if how in ("lower", "upper"):
        return getattr(text, how)()
    out, start = [], True
    for c in text:
        out.append(c.upper() if start and c.isalnum() else c.lower())
        if c.isalnum():
            start = False
        elif how == "title" and c != "'":
            start = True
    return "".join(out)


def invalid_name(name: Column) -> Column:
    """Why a name can't be a file's, or null."""
    return F.when(name.isin("", ".", ".."), "The new name is empty").when(name.contains("/") | name.contains("\0"), "A name cannot contain “/”").when(F.octet_length(name) > 255, "The new name is too long")


def location(path: Column, home: str) -> Column:
    """The folder a path (text) is in, the home folder written ~."""
    parent = F.coalesce(parent_of(path), F.lit(""))
    inside = F.lit(bool(home)) & ((parent == home) | parent.startswith(home.rstrip("/") + "/"))
    return F.when(inside, F.concat(F.lit("~"), F.substring(parent, F.lit(len(home.rstrip("/")) + 1), F.length(parent)))).otherwise(parent)
