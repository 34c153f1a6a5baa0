"""Names, titles and figures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to identify a set.
STOP_WORDS = [
    "part", "parts", "vol", "volume", "set", "the", "and", "for", "with", "data", "database", "db", "dataset", "datasets", "dump", "dumps", "files", "file",
    "update", "updated", "backup", "copy", "copies", "final", "full", "complete", "completa", "all", "new", "latest", "version", "ver", "users", "user",
    "accounts", "account", "records", "record", "list", "lists", "customers", "customer", "orders", "order", "master", "export", "exports", "info", "stuff",
    "batch", "items", "notes", "misc",
]
#: A dotted token: a host or a name with extensions.
DOTTED = r"([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+)"

# Marks of repeated uploads at the end of a name.
NUMBERED = r"[\s_]*\([0-9]+\)\s*$"
COPIED = r"(?i)[\s_]*(?:copy|backup|original|final|old)[\s_]*[0-9]*\s*$"


def fold(text: Column) -> Column:
    """NFKC and full case folding (ß as ss, final sigma as sigma), by the library that Spark brings along; ASCII text takes the short way."""
    text = F.coalesce(text, F.lit(""))
    plain = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    wide = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), plain, F.lit(True))
    return F.when(F.octet_length(text) > F.length(text), wide).otherwise(F.lower(text))


# What a name with one of these marks ends in; other names need no search for them.
MARKED = r"(?i)(?:\)|copy|backup|original|final|old)[\s_0-9\x{85}\x{2028}\x{2029}]*$"


def _peel(s: Column) -> Column:
    peeled = s
    for _ in range(3):
        peeled = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(peeled, NUMBERED, " "), COPIED, " "), r"\s+", " "))
    return F.when(s.rlike(MARKED), peeled).otherwise(F.trim(F.regexp_replace(s, r"\s+", " ")))


SEPARATORS = r"[\s_./()-]+"


def compare_base(s: Column) -> Column:
    """The base, folded already, without marks of repeated uploads, all separators as one space. What has no mark needs no other pass."""
    return F.trim(F.regexp_replace(F.when(s.rlike(MARKED), _peel(s)).otherwise(s), SEPARATORS, " "))


def significant_tokens(base: Column) -> Column:
    return F.filter(F.split(base, " "), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def display_name(name: Column, base: Column) -> Column:
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[A-Za-z0-9]{1,8}$", "")
    plain = lambda c: F.trim(F.regexp_replace(c, r"[\s_-]+", " "))
    peeled = _peel(plain(F.coalesce(F.nullif(base, F.lit("")), stem)))
    return F.substring(F.coalesce(F.nullif(peeled, F.lit("")), plain(stem)), 1, 120)


def human_size(n: Column) -> Column:
    """Bytes as a whole number, larger units with one decimal, up to TB."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024.0**k))
    return out.otherwise(F.format_string("%.1f TB", n / 1024.0**4))


def long_size(n: Column) -> Column:
    """Sizes with thousands separators, up to PB."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    out = F.when(n < 1024, F.format_string("%,d B", n.cast("long")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024.0 ** (k + 1), F.format_string(f"%,.1f {unit}", n / 1024.0**k))
    return out.otherwise(F.format_string("%,.1f PB", n / 1024.0**5))


def flag(code: Column) -> Column:
    """Regional indicators of a two-letter code, else a globe."""
    letter = lambda k: F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(F.lower(code), k, 1)) - 97 + 0xA6))), "UTF-8")
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.concat(letter(1), letter(2))).otherwise("\U0001f310")


def colour(title: Column) -> Column:
    """Sum of the code points modulo 9."""
    return F.aggregate(F.split(title, ""), F.lit(0), lambda a, c: a + F.ascii(c)) % 9


def safe_title(title: Column, longest: int = 100) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.trim(F.substring(plain, 1, longest)), F.lit("")), F.lit("Untitled"))


def eta(seconds: Column) -> Column:
    """Days, hours and minutes: 1d2h3m."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.concat(F.when(d > 0, F.concat(d.cast("string"), F.lit("d"))).otherwise(""), F.when((d > 0) | (h > 0), F.concat(h.cast("string"), F.lit("h"))).otherwise(""), m.cast("string"), F.lit("m"))


def bar(done: Column, total: Column, cells: int = 20) -> Column:
    n = F.when(total > 0, F.floor(done * cells / total)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(cells) - n))


def unresolvable(base: Column) -> Column:
    return (F.trim(base) == "") | F.trim(base).rlike(r"^part[\s_-]*[0-9]*$")


def stable_key(title: Column) -> Column:
    return -F.crc32(F.encode(title, "UTF-8"))
