"""Application manifests as XML, and archive manifests and properties as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parse_id

#: Kinds of components; a provider is reached only if it says so.
KINDS = ["activity", "service", "receiver", "provider"]
IMPLICIT_BELOW = 31


def _nodes(path: str) -> Column:
    return F.expr(f"xpath(xml, '{path}')")


def _component(kind: str, why: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(why).alias("why"))


def _link(parts: list[str]):
    return lambda z: F.concat(z["scheme"], F.lit("://"), *(z[p] for p in parts[1:]))


def exported(manifests: DataFrame, key: str = "id") -> DataFrame:
    """key, kind, name, why: components that other applications reach: explicit, or with a filter, no attribute and a target version in 1 to 30."""
    sdk = F.expr("xpath_int(xml, '//uses-sdk/@targetSdkVersion')")
    found = []
    for kind in KINDS:
        ways = [("explicit", _nodes(f'//{kind}[@exported="true"]/@name'))]
        if kind != "provider":
            ways.append(("implicit", F.when(sdk.between(1, IMPLICIT_BELOW - 1), _nodes(f"//{kind}[not(@exported) and intent-filter]/@name"))))
        for why, names in ways:
            found.append(F.transform(F.coalesce(names, F.array().cast("array<string>")), _component(kind, why)))
    return manifests.select(key, F.explode(F.concat(*found)).alias("c")).select(key, "c.*")


def custom_permissions(manifests: DataFrame, key: str = "id") -> DataFrame:
    """key, name, level of every permission that a manifest declares; the level is in the lowest four bits, none is 0."""
    levelled = F.arrays_zip(_nodes("//permission[@name and @protectionLevel]/@name").alias("name"), _nodes("//permission[@name and @protectionLevel]/@protectionLevel").alias("level"))
    plain = F.transform(_nodes("//permission[@name and not(@protectionLevel)]/@name"), lambda n: F.struct(n.alias("name"), F.lit("0").alias("level")))
    own = manifests.select(key, F.explode(F.concat(levelled, plain)).alias("p")).select(key, "p.name", parse_id(F.col("p.level")).bitwiseAND(0xF).alias("bits"))
    bits = F.col("bits")
    return own.select(key, "name", F.when(bits == 0, "normal").when(bits == 1, "dangerous").when(bits == 2, "signature").otherwise("other").alias("level"))


def used_permissions(manifests: DataFrame, of: list[str], key: str = "id") -> DataFrame:
    """key, name: the permissions among some that a manifest asks for, each once."""
    return manifests.select(key, F.explode(F.array_distinct(_nodes("//uses-permission/@name"))).alias("name")).where(F.col("name").isin(of))


def deeplinks(manifests: DataFrame, key: str = "id") -> DataFrame:
    """key, link: scheme://host and path of every link that a filter takes; a missing host or path is empty."""
    found = []
    for test, parts in (("@scheme and @host and @path", ["scheme", "host", "path"]), ("@scheme and @host and not(@path)", ["scheme", "host"]), ("@scheme and not(@host)", ["scheme"])):
        zipped = F.arrays_zip(*(_nodes(f"//intent-filter/data[{test}]/@{p}").alias(p) for p in parts))
        found.append(F.transform(zipped, _link(parts)))
    return manifests.select(key, F.explode(F.concat(*found)).alias("link"))


def attributes(bodies: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """key, name, value of an archive's manifest; a line that begins with a space goes on the one before."""
    whole = F.regexp_replace(body, "\\r?\\n ", "")
    lines = bodies.select(key, F.explode(F.split(whole, "\\r?\\n", -1)).alias("line")).where(F.col("line").rlike("^[A-Za-z0-9_-]+: "))
    return lines.select(key, F.regexp_extract("line", "^([A-Za-z0-9_-]+): ", 1).alias("name"), F.regexp_extract("line", "(?s)^[A-Za-z0-9_-]+: (.*)$", 1).alias("value"))


def properties(lines: DataFrame, key: str = "class_id") -> DataFrame:
    """key, name, value of property files' lines (key, line_no, line); # and ! begin comments, of a repeated name the last counts."""
    own = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike("^[^#!=:][^=:]*[=:]"))
    own = own.select(key, "line_no", F.trim(F.regexp_extract("line", "^([^=:]+)[=:]", 1)).alias("name"), F.trim(F.regexp_extract("line", "(?s)^[^=:]+[=:](.*)$", 1)).alias("value"))
    return own.groupBy(key, "name").agg(F.max_by("value", "line_no").alias("value"))


def properties_summary(entries: DataFrame, key: str = "class_id", files: int = 10, names: int = 5) -> DataFrame:
    """key, n, sample: how many properties the first files have, and the first names of each."""
    first = entries.select(key).distinct().orderBy(key).limit(files)
    per = entries.join(first, key, "left_semi")
    return per.groupBy(key).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("name")), 1, names).alias("sample"))
