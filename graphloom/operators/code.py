"""Findings in source text and signatures: smells, patterns, conventions, metrics, signatures."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import write_table

#: Limits beyond which a symbol smells.
MAX_LINES, MAX_PARAMETERS, MAX_METHODS, MAX_NESTING, MAGIC_DIGITS = 50, 5, 20, 4, 3


def n_parameters(signature: Column) -> Column:
    """Parameters in the first parentheses after a receiver, if any; commas within brackets don't count."""
    inner = F.regexp_extract(F.regexp_replace(signature, r"^(func)\s*\([^)]*\)", "$1"), r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    flat = F.regexp_replace(inner, r"\([^()]*\)|\[[^\]]*\]|<[^>]*>|\{[^}]*\}", "")
    return F.when(F.trim(flat) == "", 0).otherwise(F.size(F.split(flat, ",")))


def nesting(code: Column) -> Column:
    """Greatest depth of braces."""
    steps = F.transform(F.regexp_extract_all(code, F.lit(r"[{}]"), 0), lambda c: F.when(c == "{", 1).otherwise(-1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")), lambda s: s["most"])


def smells(symbols: DataFrame) -> DataFrame:
    """``id, smell, value`` of ``id, name, kind, receiver, signature, start_line, end_line, code``: long functions, many parameters, god objects, deep nesting, swallowed errors, magic numbers and empty interfaces."""
    f = symbols.where("kind IN ('function', 'method')")
    lines = F.col("end_line") - F.col("start_line") + 1
    one = lambda name, cond, value, of=f: of.where(cond).select("id", F.lit(name).alias("smell"), value.cast("long").alias("value"))
    params = n_parameters(F.col("signature"))
    deep = nesting(F.col("code"))
    swallowed = F.regexp_count("code", F.lit(r"if\s+err\s*!=\s*nil\s*\{\s*\}|except[^:\n]*:\s*\n?\s*pass\b|catch\s*(\([^)]*\))?\s*\{\s*\}|_\s*=\s*\w+\([^)]*\)"))
    magic = F.regexp_count("code", F.lit(rf"(?<![\w.\"'])[0-9]{{{MAGIC_DIGITS},}}(?![\w.\"'])"))
    gods = symbols.where("kind = 'method' AND receiver IS NOT NULL").groupBy(F.col("receiver").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > MAX_METHODS)
    out = one("long_function", lines > MAX_LINES, lines)
    for part in (
        one("many_parameters", params > MAX_PARAMETERS, params),
        one("deep_nesting", deep > MAX_NESTING, deep),
        one("error_swallowing", swallowed > 0, swallowed),
        one("magic_number", magic > 0, magic),
        one("empty_interface", F.col("signature").rlike(r"interface\s*\{\s*\}") | (F.coalesce(F.regexp_extract("code", r"interface\s*\{([^}]*)\}", 1), F.lit("x")).rlike(r"^\s*$") & F.col("code").contains("interface")), F.lit(1), symbols.where("kind = 'interface'")),
        gods.select("id", F.lit("god_object").alias("smell"), F.col("n").alias("value")),
    ):
        out = out.unionByName(part)
    return out


def metrics(symbols: DataFrame) -> DataFrame:
    """``id, cyclomatic, cognitive, nesting, health``: cyclomatic is 1 for the function and 1 for every 7 lines, one more for a method, 50 at most."""
    lines = F.col("end_line") - F.col("start_line") + 1
    cyc = F.least(F.lit(50), 1 + F.floor(lines / 7) + (F.col("kind") == "method").cast("int"))
    deep = nesting(F.col("code"))
    m = symbols.where("kind IN ('function', 'method')").select("id", cyc.cast("long").alias("cyclomatic"), (cyc + deep).cast("long").alias("cognitive"), deep.cast("long").alias("nesting"), n_parameters(F.col("signature")).alias("p"), lines.alias("lines"))
    health = 100 - 2 * F.greatest(F.col("cyclomatic") - 10, F.lit(0)) - 5 * F.greatest(F.col("nesting") - MAX_NESTING, F.lit(0)) - 3 * F.greatest(F.col("p") - MAX_PARAMETERS, F.lit(0)) - F.when(F.col("lines") > MAX_LINES, 10).otherwise(0)
    return m.select("id", "cyclomatic", "cognitive", "nesting", F.least(F.greatest(health, F.lit(0)), F.lit(100)).cast("long").alias("health"))


def health_distribution(m: DataFrame) -> DataFrame:
    grade = F.when(F.col("health") >= 80, "good").when(F.col("health") >= 60, "fair").when(F.col("health") >= 40, "poor").otherwise("bad")
    return m.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


def scan_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``id, rule, severity, hits`` of ``id, text`` by a table ``rule, severity, pattern`` (regular expressions): a few rules, sent to every task."""
    return texts.join(F.broadcast(patterns), F.expr("text rlike pattern")).select("id", "rule", "severity", F.expr("regexp_count(text, pattern)").cast("long").alias("hits"))


def mark_suppressed(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings with ``suppressed``: those of a suppression's (``id, rule``)."""
    s = suppressions.select("id", "rule", F.lit(True).alias("suppressed"))
    return found.join(s, ["id", "rule"], "left").na.fill(False, ["suppressed"])


#: What stands between a name and its quoted value.
_IS = r"[\"']?\s*(?::=|=>|[:=])\s*"
#: Secrets (key formats of vendors and headers of key files are fixed values, public ones; the others ask for a name, a separator and a quoted value) and rules of dangerous code. A match is a finding: entropy and nearby words are not asked for.
SECRET_PATTERNS = [
    ("assigned_token", "high", r"(?i)\b(token|secret|password|api_key)\s*=\s*[\"'][^\"']{8,}[\"']"),
    ("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("email", "low", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
    ("sql_concatenation", "high", r"(?i)(select|insert|update|delete)\s[^\"'\n]*[\"']\s*\+"),
    ("shell_call", "medium", r"\b(os\.system|subprocess\.(call|run|Popen)|exec\.Command|child_process)\b"),
    ("dynamic_code", "high", r"\b(eval|exec)\s*\("),
    ("aws_access_key", "critical", r"AKIA[0-9A-Z]{16}"),
    ("stripe_key", "critical", r"sk_live_[0-9a-zA-Z]{24,}"),
    ("openai_key", "high", r"sk-[a-zA-Z0-9]{32,}"),
    ("github_token", "high", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("pgp_private_key", "critical", r"-----BEGIN PGP PRIVATE KEY BLOCK-----"),
    ("generic_api_key", "high", rf"(?i)\bapi[-_ ]?key\w*{_IS}[\"'][\w-]{{20,}}[\"']"),
    ("password", "high", rf"(?i)\b\w*(?:pass(?:word|wd|phrase)|pwd){_IS}[\"'][^\"'\n]{{8,}}[\"']"),
    ("database_url", "high", r"(?i)\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?)://[^\s:/@\"']+:[^\s/@\"']+@[\w.-]+"),
    ("jwt_secret", "high", rf"(?i)\b\w*(?:jwt|signing|secret)[-_ ]?(?:secret|key)\w*{_IS}[\"'][\w+/=.-]{{16,}}[\"']"),
]

ENTRY_PATTERNS = [
    ("go", "main", r"^main$"), ("go", "init", r"^init$"), ("go", "test", r"^(Test|Benchmark|Fuzz|Example)([A-Z_]|$)"), ("go", "handler", r"(Handler|ServeHTTP)$"),
    ("python", "main", r"^(main|__main__)$"), ("python", "test", r"^test_"), ("python", "view", r"(View|_view)$"),
    ("javascript", "main", r"^(main|default)$"), ("javascript", "handler", r"(Handler|Controller)$"), ("typescript", "main", r"^(main|default)$"), ("typescript", "handler", r"(Handler|Controller)$"),
]

NAME_PATTERNS = [
    ("singleton", r"(?i)(instance|singleton)$", 0.6), ("factory", r"^(New|Create|Make|new|create|make)_?[A-Z_]", 0.7), ("builder", r"(?i)builder$", 0.8), ("options", r"^With[A-Z]", 0.8),
    ("middleware", r"(?i)middleware$", 0.8), ("strategy", r"(?i)strategy$", 0.7), ("observer", r"(?i)(observer|listener|subscriber)$|^(On|Notify|Subscribe)[A-Z]", 0.6), ("repository", r"(?i)(repository|repo|store)$", 0.6),
]


def entry_points(symbols: DataFrame, patterns: list[tuple[str, str, str]] = ENTRY_PATTERNS) -> DataFrame:
    """``id, kind`` of symbols (``id, name, language``) whose name a pattern of their language fits."""
    p = F.broadcast(symbols.sparkSession.createDataFrame(patterns, "language string, entry string, pattern string"))
    return symbols.join(p, "language").where(F.expr("name rlike pattern")).select("id", F.col("entry").alias("kind")).distinct()


def design_patterns(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, pattern, confidence``: by name, a fifth surer if the structure agrees (something refers to, implements or calls the symbol)."""
    p = F.broadcast(symbols.sparkSession.createDataFrame(NAME_PATTERNS, "pattern string, regex string, base double"))
    used = edges.select(F.col("dst").alias("id")).distinct().withColumn("used", F.lit(0.2))
    hit = symbols.join(p, F.expr("name rlike regex")).select("id", "pattern", "base")
    return hit.join(used, "id", "left").select("id", "pattern", F.round(F.least(F.lit(1.0), F.col("base") + F.coalesce("used", F.lit(0.0))), 4).alias("confidence"))


def structural_patterns(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, pattern, evidence, confidence`` by what symbols (``id, name, kind, receiver, package, signature, returns``) are made of, not by their names alone.

    A factory makes a type of the project; a builder has two methods or more that give itself back, and one that builds; an option
    returns one; a singleton's accessor returns a type; a middleware takes and gives back a handler; a strategy is an interface that two
    types or more implement; an observer's subject has methods to subscribe and to notify; a repository has methods that read and that
    write. ``evidence`` is the number of these parts; more of them are surer, .95 at most.
    """
    types = symbols.where("kind IN ('struct', 'class', 'interface', 'type')").select(F.col("id").alias("tid"), F.col("name").alias("type"), "package")
    f = symbols.where("kind IN ('function', 'method')")
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("returns", F.lit("")), F.lit(r"[A-Za-z_]\w*"), 0)))
    made = f.select("id", "name", word.alias("type")).join(types.select("type").distinct(), "type", "left_semi")
    out = lambda df, pattern, n: df.groupBy("id").agg(n.cast("long").alias("evidence")).select("id", F.lit(pattern).alias("pattern"), "evidence")
    m = f.where("receiver IS NOT NULL").join(types.withColumnRenamed("type", "receiver"), ["receiver", "package"]).select(F.col("tid").alias("id"), "name", "receiver", F.coalesce("returns", F.lit("")).alias("back"))
    has = lambda regex: F.count_if(F.col("name").rlike(regex))
    both = m.groupBy("id").agg(
        F.count_if(F.col("back").contains(F.col("receiver"))).alias("fluent"), has(r"(?i)^build$").alias("builds"),
        has(r"(?i)^(subscribe|register|attach|on[A-Z_]|add_?\w*(listener|observer))").alias("subs"), has(r"(?i)^(notify|emit|publish|fire|dispatch)").alias("news"),
        has(r"(?i)^(get|find|list|load|fetch)").alias("reads"), has(r"(?i)^(save|create|insert|update|delete|store|put)").alias("writes"),
    )
    pick = lambda cond, pattern, n: both.where(cond).select("id", F.lit(pattern).alias("pattern"), F.expr(n).cast("long").alias("evidence"))
    handler = r"(?i)handler|middleware|func\s*\("
    parts = [
        out(made.where(F.col("name").rlike(r"^(New|Create|Make|new_|create_|make_)")), "factory", F.count("*")),
        out(made.where(F.col("name").rlike(r"(?i)^(get_?)?instance$|^default$")), "singleton", F.count("*")),
        out(f.where(F.col("name").rlike("^With[A-Z]") & F.coalesce(F.col("returns"), F.lit("")).rlike(r"Option|func")), "options", F.count("*")),
        out(f.where(F.col("returns").rlike(handler) & F.regexp_extract("signature", r"\(([^)]*)\)", 1).rlike(handler)), "middleware", F.count("*")),
        out(edges.where("etype = 'implements'").select(F.col("dst").alias("id"), "src"), "strategy", F.countDistinct("src")).where("evidence >= 2"),
        pick("fluent >= 2 AND builds > 0", "builder", "fluent + builds"), pick("subs > 0 AND news > 0", "observer", "subs + news"), pick("reads > 0 AND writes > 0", "repository", "reads + writes"),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.select("id", "pattern", "evidence", F.round(F.least(F.lit(0.95), 0.7 + 0.1 * F.col("evidence")), 4).alias("confidence"))


def conventions(symbols: DataFrame, imports: DataFrame, min_share: float = 0.3) -> DataFrame:
    """``kind, pattern, share`` beside those of naming: how errors are handled, files organised, tests written, symbols documented and modules imported, over all symbols and imports; patterns of ``min_share`` or more."""
    f = symbols.where("kind IN ('function', 'method')")
    code, returns = F.coalesce(F.col("code"), F.lit("")), F.coalesce(F.col("returns"), F.lit(""))

    def share(df: DataFrame, kind: str, **cases: Column) -> DataFrame:
        found = df.agg(*(F.avg(c.cast("int")).alias(n) for n, c in cases.items()))
        rows = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(n.replace("_", " ")).alias("pattern"), F.col(n).alias("share")) for n in cases))
        return found.select(F.explode(rows).alias("x")).select("x.*")

    test = F.col("name").rlike(r"^(Test|Benchmark|Fuzz|Example)[A-Z_]|^test_")
    per_file = symbols.groupBy("file_path").agg(F.count_if(F.col("kind").isin("struct", "class", "interface")).alias("types"), F.max(F.col("file_path").rlike(r"(_test\.\w+|(^|/)test_[^/]*|\.(test|spec)\.\w+)$")).alias("test"))
    parts = [
        share(f, "errors", returned=returns.rlike(r"\berror\b"), wrapped=code.rlike(r"%w|raise .* from |errors\.Wrap"), raised=code.rlike(r"\b(raise|throw|panic)\b"), caught=code.rlike(r"\b(except|catch|recover)\b")),
        share(per_file, "files", one_type_a_file=F.col("types") == 1, tests_beside=F.col("test")),
        share(f.where(test), "tests", table_driven=code.rlike(r"(?s)range\s+(tests|cases|tt)|parametrize|\.each\("), subtests=code.rlike(r"t\.Run\(|subTest\(|describe\(")),
        share(f.where("exported"), "documentation", documented=code.rlike(r"(?s)^[^\n]*:\s*\n\s*(\"{3}|'{3})|/\*\*|^\s*//")),
        share(imports, "imports", relative=F.col("is_relative"), aliased=F.col("alias").isNotNull(), wildcard=F.col("is_wildcard")),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.where(F.col("share") >= min_share).withColumn("share", F.round("share", 6))


def naming_conventions(symbols: DataFrame, min_share: float = 0.3) -> DataFrame:
    """``language, kind, style, share`` of the styles that at least ``min_share`` of the names of a kind have, over all symbols."""
    style = F.when(F.col("name").rlike(r"^[A-Z][A-Z0-9_]+$"), "UPPER").when(F.col("name").rlike(r"^[A-Z][A-Za-z0-9]*$"), "Pascal").when(F.col("name").rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake").when(F.col("name").rlike(r"^[a-z][A-Za-z0-9]*$"), "camel").otherwise("other")
    n = symbols.groupBy("language", "kind", style.alias("style")).agg(F.count("*").alias("n"))
    t = symbols.groupBy("language", "kind").agg(F.count("*").alias("t"))
    return n.join(t, ["language", "kind"]).select("language", "kind", "style", F.round(F.col("n") / F.col("t"), 6).alias("share")).where(F.col("share") >= min_share)


def config_usage(texts: DataFrame) -> DataFrame:
    """``key, uses, files`` of environment and configuration keys that texts (``id, text``) read."""
    keys = F.concat(F.regexp_extract_all("text", F.lit(r"(?:os\.Getenv|os\.environ\.get|getenv|process\.env)[(.\[]+[\"']?([A-Za-z_][A-Za-z0-9_]*)"), 1), F.regexp_extract_all("text", F.lit(r"(?:config|viper|settings)\.[Gg]et\w*\([\"']([\w.]+)[\"']"), 1))
    return texts.select("id", F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("uses"), F.countDistinct("id").alias("files"))


# --- signatures --------------------------------------------------------------


@dataclass(frozen=True)
class Signature:
    receiver: str
    parameters: tuple[tuple[str, str, bool], ...]
    returns: str


def split_top(text: str, mark: str = ",") -> list[str]:
    """Split at ``mark`` outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and depth and text[i - 1 : i + 1] not in ("->", "=>"):
            depth -= 1
        elif c == mark and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    out.append(text[at:].strip())
    return [x for x in out if x]


def _group(text: str, at: int) -> int:
    """The end of the bracketed group that starts at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += text[i] in "([{"
        depth -= text[i] in ")]}"
        if not depth:
            return i + 1
    return len(text)


def parse_signature(signature: str) -> Signature:
    """Receiver, parameters (name, type, has a default) and results of a Go, Python, JavaScript or TypeScript signature."""
    s = signature.strip()
    receiver = ""
    if m := re.match(r"func\s*\(", s):
        end = _group(s, m.end() - 1)
        receiver = s[m.end() : end - 1].split()[-1].lstrip("*") if s[m.end() : end - 1].split() else ""
        s = "func " + s[end:]
    at = s.find("(")
    if at < 0:
        return Signature(receiver, (), "")
    end = _group(s, at)
    params = []
    for p in split_top(s[at + 1 : end - 1]):
        default = "=" in p or p.endswith("?") or "?:" in p
        p = p.split("=")[0].strip()
        if ":" in p:
            name, kind = (x.strip() for x in p.split(":", 1))
        else:
            name, _, kind = p.partition(" ")
        params.append((name.rstrip("?"), kind.strip(), default or name.startswith(("*", "...")) or kind.startswith("...")))
    tail = s[end:].strip().rstrip("{:").strip()
    return Signature(receiver, tuple(params), re.sub(r"^(->|:|=>)\s*", "", tail).strip())


def breaking_changes(old: str, new: str) -> list[str]:
    """What callers would notice: added required and removed parameters, and changed types, results and receivers."""
    a, b = parse_signature(old), parse_signature(new)
    out = []
    if a.receiver != b.receiver:
        out.append("receiver changed")
    for x, y in zip(a.parameters, b.parameters, strict=False):
        if x[1] != y[1]:
            out.append(f"type of {y[0]} changed")
    out += [f"parameter {p[0]} removed" for p in a.parameters[len(b.parameters) :]]
    out += [f"required parameter {p[0]} added" for p in b.parameters[len(a.parameters) :] if not p[2]]
    if a.returns != b.returns:
        out.append("result changed")
    return out


def signature_changes(pairs: DataFrame) -> DataFrame:
    """``id, changes, breaking`` of ``id, old, new`` signatures, in Arrow batches."""
    @F.pandas_udf("array<string>")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([breaking_changes(a or "", b or "") for a, b in zip(old, new, strict=True)])

    return pairs.select("id", diff("old", "new").alias("changes")).withColumn("breaking", F.size("changes") > 0)


def satisfied_interfaces(types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``type, interface``: types (``type, language, method``) that have every method of an interface (``interface, language, method``); interfaces without methods are left out.

    Types that have an interface's rarest method, in one of its languages, are looked at; the rest of their methods is then tested as a set.
    """
    t = types.select("type", "language", "method").where("type IS NOT NULL AND language IS NOT NULL AND method IS NOT NULL")
    i = interfaces.select("interface", "language", "method").distinct()
    use = t.groupBy("language", "method").agg(F.count("*").alias("use"))
    need = i.join(use, ["language", "method"], "left").groupBy("interface", "method").agg(F.collect_set("language").alias("languages"), F.sum("use").alias("use"))
    # a method of no type has no use: nothing satisfies its interface
    need = need.groupBy("interface").agg(F.min_by("method", F.struct(F.coalesce("use", F.lit(0)), "method")).alias("method"), F.collect_list(F.struct("method", "languages")).alias("need"), F.count("*").alias("n"), F.count("method").alias("named"))
    need = write_table(need.where("n = named").drop("n", "named"), "interfaces-needed")
    first = need.select("interface", "method").join(i, ["interface", "method"])
    maybe = t.join(first, ["language", "method"]).where("type <> interface").select("type", "interface").distinct()
    own = t.groupBy("type").agg(F.collect_set(F.struct("language", "method")).alias("own"))
    has = F.forall("need", lambda x: F.exists(x["languages"], lambda k: F.array_contains("own", F.struct(k.alias("language"), x["method"].alias("method")))))
    return maybe.join(own, "type").join(need.select("interface", "need"), "interface").where(has).select("type", "interface")
