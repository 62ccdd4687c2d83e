"""Column expressions: names, text, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_name(full: Column) -> Column:
    return F.substring_index(full, ".", -1)


def package_of(full: Column) -> Column:
    """All before the last dot; (default) if there is none after the first character."""
    package = F.regexp_extract(full, r"^(.+)\.[^.]*$", 1)
    return F.when(package == "", F.lit("(default)")).otherwise(package)


def jni_name(cls: Column, method: Column) -> Column:
    return F.concat(F.lit("Java_"), F.replace(F.replace(cls, F.lit("_"), F.lit("_1")), F.lit("."), F.lit("_")), F.lit("_"), F.replace(method, F.lit("_"), F.lit("_1")))


def dotted(descriptor: Column) -> Column:
    """Lx/y; as x.y."""
    return F.replace(F.regexp_extract(descriptor, "^L(.*);$", 1), F.lit("/"), F.lit("."))


def descriptor(type_name: Column) -> Column:
    """A type's descriptor: primitives by letter, classes as Lx/y;, a [ for each dimension."""
    base = F.regexp_replace(type_name, r"(\[\])+$", "")
    dims = (F.length(type_name) - F.length(base)) / 2
    letter = F.lit(None).cast("string")
    for name, code in {"boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D", "void": "V"}.items():
        letter = F.when(base == name, F.lit(code)).otherwise(letter)
    return F.concat(F.repeat(F.lit("["), dims.cast("int")), F.coalesce(letter, F.concat(F.lit("L"), F.replace(base, F.lit("."), F.lit("/")), F.lit(";"))))


def occurrences(text: Column, marker: str) -> Column:
    """How often a marker stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def line_of(text: Column, position: Column) -> Column:
    """The number of the line, from 1, that a position (from 0) lies on."""
    before = F.substring(text, F.lit(1), position)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def hex_id(number: Column) -> Column:
    return F.format_string("0x%08x", number)


def parse_id(text: Column) -> Column:
    """A hexadecimal (0x...) or decimal number."""
    return F.when(text.startswith("0x"), F.conv(F.substring(text, 3, 16), 16, 10)).otherwise(text).cast("long")


def any_prefix(name: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (31) of a text of characters up to U+FFFF, as hexadecimal without leading zeros."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)).cast("long"))
    total = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(0xFFFFFFFF))
    return F.lower(F.hex(total))


def access_flags(mask: Column) -> Column:
    """The names of the access bits of a class that are set, in the order of the bits."""
    bits = {0x1: "public", 0x10: "final", 0x200: "interface", 0x400: "abstract", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum"}
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(bit) != 0, name) for bit, name in bits.items())))
