"""Reports: markdown, JSON, SARIF, DOT, script text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column) -> Column:
    """A value as a cell of a markdown table."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_rows(df: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """key, line: a table line for each row."""
    return df.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells)), F.lit(" |")).alias("line"))


def markdown(rows: DataFrame, key: str, header: list[str]) -> DataFrame:
    """One text: a header and the lines of markdown_rows in the order of key. A report is read by people: it is as small as they need."""
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header) + "\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "line"))), lambda r: r["line"]), "\n")).alias("report"))


def sarif_result(rule: Column, level: Column, message: Column, target: Column) -> Column:
    """A result object of SARIF 2.1.0 as JSON."""
    location = F.struct(F.struct(target.alias("fullyQualifiedName")).alias("logicalLocation"))
    return F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(location).alias("locations")))


def sarif_document(key: Column, results: Column, tool: str) -> Column:
    """A SARIF 2.1.0 document of one run as JSON; results is an array of the objects' JSON."""
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[{{"id":"annotation"}},{{"id":"bookmark"}}]}}}},"results":['
    artifact = F.to_json(F.struct(F.struct(key.alias("uri")).alias("location")))
    return F.concat(F.lit(head), F.array_join(results, ","), F.lit('],"artifacts":['), artifact, F.lit("]}]}"))


def dot_document(lines: DataFrame) -> DataFrame:
    """One text: a DOT graph of the lines (line) in their order."""
    return lines.agg(F.concat(F.lit("digraph G {\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n}")).alias("dot"))


def dot_text(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """line: the nodes (node) and edges (src, dst) of a DOT graph; the root's label is marked."""
    own = nodes.select(F.concat(F.lit('"'), dot_text(F.col("node")), F.lit('" [label="'), dot_text(F.col("node")), F.when(F.col("node") == root, F.lit(" (root)")).otherwise(F.lit("")), F.lit('"];')).alias("line"))
    return own.union(edges.select(F.concat(F.lit('"'), dot_text(F.col("src")), F.lit('" -> "'), dot_text(F.col("dst")), F.lit('";'))))


def hook_line(cls: Column, method: Column, args: Column) -> Column:
    """A line of a tracing script for a method, by its raw names; args is an array of types."""
    shown = F.array_join(F.transform(args, lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    return F.concat(F.lit("Java.use('"), cls, F.lit("')."), method, F.lit(".overload("), shown, F.lit(").implementation = trace;"))


def field_line(cls: Column, field: Column) -> Column:
    """A line of a tracing script that shows a static field."""
    return F.concat(F.lit("console.log(Java.use('"), cls, F.lit("')."), field, F.lit(".value);"))


def enum_line(package: Column) -> Column:
    """A line of a script that lists the loaded classes of a package."""
    return F.concat(F.lit("Java.enumerateLoadedClassesSync().filter(c => c.startsWith('"), package, F.lit(".')).forEach(c => console.log(c));"))
