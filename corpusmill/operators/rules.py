"""Rule tables against a corpus: security scans, sinks and sources, prefixes, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Rules of the scan: rule, category, severity, regular expression.
SECURITY_RULES = [
    ("hardcoded_secrets", "secrets", "high", r"token = \""),
    ("hardcoded_secrets", "secrets", "high", r"api_key"),
    ("hardcoded_secrets", "secrets", "high", r"password"),
    ("insecure_network", "network", "medium", r"http://"),
    ("insecure_network", "network", "medium", r"setHostnameVerifier"),
    ("insecure_crypto", "crypto", "high", r"MD5"),
    ("data_leakage", "secrets", "medium", r"[a-z0-9.]+@[a-z0-9]+\.example\.com"),
    ("license", "permissions", "medium", r"License"),
]
#: Fixed values. Terms of the application scan: rule, category, severity, where the term is looked for, term.
APP_RULES = [
    ("hardcoded_secrets", "secrets", "high", "code", "password"),
    ("hardcoded_secrets", "secrets", "high", "code", "secret"),
    ("hardcoded_secrets", "secrets", "high", "code", "api_key"),
    ("hardcoded_secrets", "secrets", "high", "code", "apikey"),
    ("hardcoded_secrets", "secrets", "high", "code", "Bearer "),
    ("hardcoded_secrets", "secrets", "high", "code", "-----BEGIN"),
    ("insecure_crypto", "crypto", "high", "class", "DES"),
    ("insecure_crypto", "crypto", "high", "class", "MD5"),
    ("insecure_crypto", "crypto", "high", "class", "SHA1"),
    ("insecure_crypto", "crypto", "high", "code", "ECB"),
    ("insecure_crypto", "crypto", "high", "code", "AES/ECB"),
    ("insecure_network", "network", "medium", "code", "http://"),
    ("insecure_network", "network", "medium", "class", "TrustManager"),
    ("insecure_network", "network", "medium", "class", "AllowAllHostnameVerifier"),
    ("insecure_network", "network", "medium", "code", "ALLOW_ALL_HOSTNAME_VERIFIER"),
    ("insecure_network", "network", "medium", "code", "setHostnameVerifier"),
    ("dangerous_apis", "permissions", "medium", "code", "Runtime.exec"),
    ("dangerous_apis", "permissions", "medium", "class", "ProcessBuilder"),
    ("dangerous_apis", "permissions", "medium", "class", "DexClassLoader"),
    ("dangerous_apis", "permissions", "medium", "class", "PathClassLoader"),
    ("dangerous_apis", "permissions", "medium", "class", "WebView"),
    ("dangerous_apis", "permissions", "medium", "code", "addJavascriptInterface"),
    ("dangerous_apis", "permissions", "medium", "code", "setJavaScriptEnabled"),
    ("data_leakage", "secrets", "medium", "code", "Log.d"),
    ("data_leakage", "secrets", "medium", "code", "Log.v"),
    ("data_leakage", "secrets", "medium", "class", "SharedPreferences"),
    ("data_leakage", "secrets", "medium", "code", "MODE_WORLD_READABLE"),
    ("data_leakage", "secrets", "medium", "code", "MODE_WORLD_WRITEABLE"),
]
#: What a scan may be narrowed to: all, or the rules of one category.
SCAN_TYPES = ("full", "secrets", "crypto", "network", "permissions")
#: Calls that end a flow, and call names that begin one, with their order.
SINKS = [("network", "high", "error.3"), ("storage", "medium", "purchase.7"), ("logging", "low", "view.1")]
SOURCES = [("user_input", 1, "click"), ("user_input", 2, "signup"), ("network_input", 3, "view.2")]
#: Name prefixes of known libraries; the longest one that fits counts.
SDK_PREFIXES = [("Source one", "src1"), ("Source ten to nineteen, English", "src1"), ("Source twelve", "src12."), ("Source twelve, English", "src12.en"), ("Source three", "src3."), ("Source five, German", "src5.de")]
LIBRARY_PREFIXES = ["src0.", "src1."]
THIRD_PARTY = ["src2.", "src4."]


def rule_table(spark, rules: list[tuple] = SECURITY_RULES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_no int, rule string, category string, severity string, pattern string")


def scan(lines: DataFrame, rules: list[tuple] = SECURITY_RULES) -> DataFrame:
    """class_id, line_no, line, rule_no, rule, category, severity: lines (class_id, line_no, line) that match a rule.

    The rules are a constant list, so they become one array of conditions on each line: a line is read once.
    """
    hit = F.array(*(F.when(F.col("line").rlike(r[3]), F.struct(F.lit(i).alias("rule_no"), *(F.lit(v).alias(n) for n, v in zip(("rule", "category", "severity"), r, strict=False)))) for i, r in enumerate(rules)))
    any_ = F.lit(False)
    for r in rules:
        any_ = any_ | F.col("line").rlike(r[3])
    out = lines.where(any_).select("class_id", "line_no", "line", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("hit"))
    return out.select("class_id", "line_no", "line", "hit.*")


def app_scan(classes: DataFrame, lines: DataFrame, scan_type: str = "full", rules: list[tuple] = APP_RULES) -> DataFrame:
    """rule_no, rule, category, severity, class_id, line_no: where a term stands, in either case; line 0 is the class's name.

    classes: class_id, full_name; lines: class_id, line_no, line. A text meets all terms in one pass.
    """
    if scan_type not in SCAN_TYPES:
        raise ValueError(f"scan type {scan_type}")

    def hits(rows: DataFrame, text: str, where: str, line_no: Column) -> DataFrame:
        found = [
            F.when(F.lower(text).contains(term.lower()), F.struct(F.lit(i).alias("rule_no"), F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity")))
            for i, (rule, category, severity, place, term) in enumerate(rules)
            if place == where and scan_type in ("full", category)
        ]
        out = rows.select("class_id", line_no.cast("int").alias("line_no"), F.explode(F.array_compact(F.array(*found, F.lit(None)))).alias("hit"))
        return out.select("hit.*", "class_id", "line_no")

    parts = [(classes, "full_name", "class", F.lit(0)), (lines, "line", "code", F.col("line_no"))]
    parts = [x for x in parts if any(r[3] == x[2] and scan_type in ("full", r[1]) for r in rules)]
    out = hits(*parts[0])
    for x in parts[1:]:
        out = out.union(hits(*x))
    return out


def context_of(line: Column, word: str) -> Column:
    """Where on a line a word stands: string_literal, comment, method_name, field_name, class_name or unknown."""
    return (
        F.when(line.rlike(f'"[^"]*{word}[^"]*"'), "string_literal").when(line.rlike(f"//.*{word}|/\\*.*{word}"), "comment")
        .when(line.rlike(f"{word}[A-Za-z0-9_]*\\("), "method_name").when(line.rlike(f"{word}[A-Za-z0-9_]* *="), "field_name")
        .when(line.rlike(f"class [A-Za-z0-9_]*{word}"), "class_name").otherwise("unknown")
    )


def findings(matches: DataFrame, per_pattern: int = 10, per_rule: int = 20) -> DataFrame:
    """Matches, at most per_pattern of each pattern, then per_rule of each rule, by class and line."""
    first = Window.partitionBy("rule_no").orderBy("class_id", "line_no")
    then = Window.partitionBy("rule").orderBy("rule_no", "class_id", "line_no")
    few = matches.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_pattern)
    return few.withColumn("n", F.row_number().over(then)).where(F.col("n") <= per_rule).drop("n")


def longest_prefix(names: DataFrame, name: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """names with sdk, the name of the longest prefix that fits (ties: the first listed), null if none does."""
    best = F.lit(None).cast("string")
    for label, p in sorted(reversed(prefixes), key=lambda x: len(x[1])):
        best = F.when(F.col(name).startswith(p), F.lit(label)).otherwise(best)
    return names.withColumn("sdk", best)


def obfuscation(names: DataFrame, simple: str) -> DataFrame:
    """classes, ratio of simple names of one or two characters, level: one row."""
    ratio = F.avg((F.length(simple) <= 2).cast("double"))
    level = F.when(ratio >= 0.5, "high").when(ratio >= 0.2, "medium").when(ratio > 0.05, "low").otherwise("none")
    return names.agg(F.count("*").alias("classes"), F.round(ratio, 3).alias("ratio"), level.alias("level"))


def source_of(label: Column, sources: list[tuple] = SOURCES) -> Column:
    """The type of the first source, in their order, that a label contains."""
    out = F.lit(None).cast("string")
    for kind, _, part in sorted(sources, key=lambda s: -s[1]):
        out = F.when(label.contains(part), F.lit(kind)).otherwise(out)
    return out


def sinks_of(calls: DataFrame, callee: str = "callee", sinks: list[tuple] = SINKS) -> DataFrame:
    """The calls of a sink, with its category and severity."""
    known = calls.sparkSession.createDataFrame(sinks, f"category string, severity string, {callee} string")
    return calls.join(F.broadcast(known), callee)


def priority(names: DataFrame, name: str, library: list[str] = LIBRARY_PREFIXES, third: list[str] = THIRD_PARTY) -> DataFrame:
    """name, priority: low for libraries, medium for third parties, high for the rest."""
    from ..functions.expr import any_prefix

    return names.select(F.col(name).alias("name"), F.when(any_prefix(F.col(name), library), "low").when(any_prefix(F.col(name), third), "medium").otherwise("high").alias("priority"))
