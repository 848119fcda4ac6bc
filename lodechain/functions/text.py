"""Scalar functions over event fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registry root spellings, obfuscation markers, path and name rewrites.
REGISTRY = [(r"^\\registry\\machine", "hklm"), (r"^\\registry\\user\\[^\\]+", "hkcu"), (r"^hkey_local_machine", "hklm"), (r"^hkey_current_user", "hkcu")]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*map(blank_to_null, cols))


def normal(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def registry_path(c: Column) -> Column:
    out = F.lower(F.trim(c))
    for pattern, short in REGISTRY:
        out = F.regexp_replace(out, pattern, short)
    return out


def basename(c: Column, sep: str = "\\") -> Column:
    other = "/" if sep == "\\" else "\\"
    return F.substring_index(F.replace(c, F.lit(other), F.lit(sep)), sep, -1)


def to_int(c: Column) -> Column:
    """Integer of hexadecimal, decimal or fractional text; null for leading zeros and junk."""
    s = F.trim(c.cast("string"))
    return (
        F.when(s.rlike("^[+-]?0[xX][0-9a-fA-F]+$"), F.conv(F.regexp_replace(s, "^[+-]?0[xX]", ""), 16, 10).try_cast("bigint") * F.when(s.startswith("-"), -1).otherwise(1))
        .when(s.contains("."), s.try_cast("double").cast("bigint"))
        .when(s.rlike("^[+-]?(0+|[1-9][0-9]*)$"), s.try_cast("bigint"))
    )


def strip_markup(c: Column) -> Column:
    """Without tags and citation notes, white space squeezed."""
    out = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\(Citation:[^)]*\)", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(c: Column) -> Column:
    r"""Lower-case runs of [a-z0-9._\/] without outer dots, two characters or more."""
    parts = F.split(F.lower(c), r"[^a-z0-9._\\/]+")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), lambda t: F.length(t) >= 2)


def root(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def same_family(a: Column, b: Column) -> Column:
    return (a == b) | (root(a) == root(b))


def ip_class(c: Column) -> Column:
    """[internal_ip], [loopback], or [external_ip] for other dotted quads, by prefix; other values unchanged."""
    quad = c.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return F.when(c.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), "[internal_ip]").when(c.startswith("127.") | (c == "::1"), "[loopback]").when(quad, "[external_ip]").otherwise(c)


def mask_numbers(c: Column) -> Column:
    """Numbers of three to six digits become [PID], unless a letter, digit or slash stands before them, or one of these, a
    dot or a hyphen behind them."""
    return F.regexp_replace(c, r"(?U)(?<![/\\\w])\d{3,6}(?![/\\\w.-])", "[PID]")


def base64_run(c: Column) -> Column:
    """Whether the first long base64-like run decodes: its length without padding is not 1 modulo 4."""
    run = F.regexp_extract(c, r"[A-Za-z0-9+/]{40,}={0,2}", 0)
    return (run != "") & (F.length(F.rtrim(run, F.lit("="))) % 4 != 1)


def special_characters(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, ("^", "&", "|", "%", "`"))), lambda x: c.contains(x))


def message_pairs(c: Column) -> Column:
    """Key-value pairs of the lines below a message's first line; the last of equal keys wins."""
    lines = F.filter(F.slice(F.split(c, "\n"), 2, F.greatest(F.size(F.split(c, "\n")), F.lit(1))), lambda x: x.rlike(r"^\s*\w+\s*[=:]\s*.+"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^\s*(\w+)\s*[=:]\s*(.+)", 1).alias("key"), F.trim(F.regexp_extract(x, r"^\s*(\w+)\s*[=:]\s*(.+)", 2)).alias("value"))
    rows = F.transform(lines, pair)
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda s: s["key"] == r["key"]))
    return F.map_from_entries(last)


# IPv4 networks that are private, local, for documentation, multicast or reserved.
INNER_NETWORKS = ((0, 8), (10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24, 24), (192 << 24 | 2 << 8, 24), (192 << 24 | 168 << 16, 16), (198 << 24 | 18 << 16, 15), (198 << 24 | 51 << 16 | 100 << 8, 24), (203 << 24 | 113 << 8, 24), (224 << 24, 4), (240 << 24, 4))
INNER_V6 = r"(?i)^(::1?$|f[cdef]|fe[89ab]|2001:0?db8:)"


def external_ip(c: Column) -> Column:
    """Whether a text is an address outside private, loopback, link-local, multicast and reserved networks; a zone behind
    % does not count; false for what is no address."""
    bare = F.substring_index(F.trim(c), "%", 1)
    octets = F.transform(F.split(bare, r"\."), lambda o: o.try_cast("int"))
    quad = bare.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & F.forall(octets, lambda o: o <= 255)
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o)
    inner = F.lit(False)
    for base, bits in INNER_NETWORKS:
        inner = inner | number.between(base, base + (1 << (32 - bits)) - 1)
    v6 = bare.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$") & ~bare.rlike(INNER_V6)
    return F.coalesce(F.when(quad, ~inner).otherwise(v6), F.lit(False))


def json_fields(c: Column) -> Column:
    """A JSON list of {Field, Description} as text; a text that is no JSON as it is; other JSON as an empty text."""
    rows = F.from_json(c, "array<struct<Field:string,Description:string>>")
    parts = F.transform(rows, lambda r: F.concat_ws(": ", r["Field"], r["Description"]))
    return F.when(F.try_parse_json(c).isNull(), c).when(F.trim(c).startswith("["), F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "; ")).otherwise("")


def json_object(c: Column) -> Column:
    """The first {...} of a text, without code fences and trailing commas; null where that is no JSON."""
    bare = F.regexp_replace(c, r"```[A-Za-z]*", "")
    found = F.regexp_replace(F.regexp_extract(bare, r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def hash_vector(c: Column) -> Column:
    """16 numbers from a text's SHA-256: its first bytes scaled to [-1, 1], at unit length."""
    hexed = F.sha2(F.coalesce(c, F.lit("")), 256)
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / F.when(size > 0, size).otherwise(1.0))
