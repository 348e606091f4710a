"""Configuration issues in logs, and what pipeline code says about libraries, calls and credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import counted_small, has_long, top_per
from faultline.operators import classify as C, traces as TR
from faultline.rules import config as R


def _hits(line: Column, rules) -> Column:
    """Array of (ord, family, issue, name, extra) for every pattern found in the line."""
    items, n = [], 0
    for family, kinds in rules.items():
        for issue, patterns in kinds.items():
            for p in patterns:
                groups = p.count("(") - p.count("(?") - p.count(r"\(")
                name = X.extract(line, "(?i)" + p, 1) if groups > 0 else F.lit(None).cast("string")
                extra = X.extract(line, "(?i)" + p, 2) if groups > 1 else F.lit(None).cast("string")
                items.append(F.when(X.found(line, [p], True), F.struct(
                    F.lit(n).alias("ord"), F.lit(family).alias("family"), F.lit(issue).alias("issue"), name.alias("name"), extra.alias("extra"))))
                n += 1
    return F.array_compact(F.array(*items))


def _patterns(rules) -> list[str]:
    return [p for kinds in rules.values() for patterns in kinds.values() for p in patterns]


def config_issues(lines: DataFrame, families=tuple(R.CONFIG_ISSUES)) -> DataFrame:
    """One row per issue, with the stage and node of its line.

    Lines without a fixed text of the issues or of the stage and node forms neither hold an issue nor move its place; they
    go before the scan.
    """
    rules = {k: v for k, v in R.CONFIG_ISSUES.items() if k in families}
    may, moves = X.maybe_each(F.col("line"), [_patterns(rules), C.PLACE_FORMS])
    able = lines.withColumn("_may", may).withColumn("_moves", moves).filter("_may or _moves").drop("_moves")
    placed = C.place_lines(able, has_long(lines)).filter("_may").withColumn("h", F.explode(_hits(F.col("line"), rules)))
    return placed.select("build_id", "line_no", "stage", "node", "h.*")


def issue_rollup(issues: DataFrame) -> DataFrame:
    per = issues.groupBy("family", "issue", "name", "stage", "build_id").agg(F.count("*").alias("n"))
    return per.groupBy("family", "issue", "name", "stage").agg(F.count("*").alias("builds"), F.sum("n").alias("hits"))


def primary_config_issue(issues: DataFrame) -> DataFrame:
    first = issues.groupBy("build_id").agg(F.min(F.struct("ord", "line_no", "family", "issue")).alias("f"))
    out = F.lit(None).cast("string")
    for family, names in R.PRIMARY_ISSUE.items():
        inner = F.lit(names[""])
        for issue, name in names.items():
            inner = F.when(F.col("f.issue") == issue, name).otherwise(inner) if issue else inner
        out = F.when(F.col("f.family") == family, inner).otherwise(out)
    return first.select("build_id", out.alias("primary_issue"))


def available_labels(lines: DataFrame) -> DataFrame:
    labels = X.extract(F.col("line"), r"Available (?:labels|nodes?):\s*\[([^\]]+)\]")
    return lines.select("build_id", "line_no", labels.alias("labels")).filter("labels is not null").groupBy("build_id").agg(
        F.min_by("labels", "line_no").alias("labels")
    )


def tool_family(name: Column) -> Column:
    return F.coalesce(X.first_match(F.lower(name), R.TOOL_FAMILIES), F.lit("unknown"))


def version_inventory(lines: DataFrame, builds: DataFrame) -> DataFrame:
    found = [X.extract(F.col("line"), p) for p in R.VERSION_FORMS]
    per = lines.filter(F.coalesce(*found).isNotNull()).groupBy("build_id").agg(
        *[F.min_by(f, F.when(f.isNotNull(), F.col("line_no"))).alias(f"v{i}") for i, f in enumerate(found)]
    ).select("build_id", F.coalesce(*[f"v{i}" for i in range(len(found))]).alias("version"))
    return per.join(builds.select("build_id", "status"), "build_id").groupBy("version").agg(
        F.count("*").alias("builds"), F.round(F.avg(F.when(F.col("status") == "FAILURE", 1.0).otherwise(0.0)), 6).alias("failure_rate")
    )


GROOVY_RULES = {t: {"": ps} for t, ps in R.GROOVY_TYPES.items()}


def groovy_errors(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    sig = r"No signature of method:\s+(\S+)\.(\w+)\("
    rejected = r"(?:method|staticMethod)\s+(\S+)\s+(\w+)"
    # the patterns are tried one by one, on lines with a fixed text of one of them only
    able = lines.filter(X.maybe(line, [_patterns(GROOVY_RULES)]))
    hits = able.withColumn("h", F.explode(_hits(line, GROOVY_RULES)))
    kind = F.col("h.family")
    target = (
        F.when(kind == "missing_method", X.extract(line, sig, 1)).when(kind == "sandbox_rejection", X.extract(line, rejected, 1))
        .when(kind == "missing_property", X.extract(line, r"for class:\s*(\S+)", 1))
        .when(kind == "serialization", X.extract(line, r"NotSerializableException:\s*(\S+)", 1))
    )
    member = (
        F.when(kind == "missing_method", X.extract(line, sig, 2)).when(kind == "sandbox_rejection", X.extract(line, rejected, 2))
        .when(kind == "missing_property", X.extract(line, r"No such property:\s*(\w+)", 1))
    )
    return hits.select("build_id", "line_no", F.col("h.ord").alias("ord"), kind.alias("kind"), target.alias("target_class"), member.alias("member"))


def groovy_failure_type(errors: DataFrame) -> DataFrame:
    return errors.groupBy("build_id").agg(F.min_by("kind", "ord").alias("kind"))


# ---- source files -----------------------------------------------------------------------------

def every(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


NAME_AT_VERSION = r"['\"]([^'\"@]+)(?:@([^'\"]+))?['\"]"


def library_refs(sources: DataFrame) -> DataFrame:
    """Shared libraries a file declares, alone, in a list, or as a step; the default version is master."""
    c = F.col("content")
    texts = F.concat(
        every(c, r"@Library\s*\(\s*(['\"][^'\"]+['\"])\s*\)"),
        F.flatten(F.transform(every(c, r"@Library\s*\(\s*\[([^\]]+)\]\s*\)"), lambda t: F.regexp_extract_all(t, F.lit(r"(['\"][^'\"]+['\"])"), F.lit(1)))),
        every(c, r"library\s+(?:identifier:\s*)?(['\"][^'\"]+['\"])"),
    )
    rows = sources.select("repo", "path", "file_id", F.explode(F.array_distinct(texts)).alias("t"))
    return rows.select(
        "repo", "path", "file_id", X.extract(F.col("t"), NAME_AT_VERSION, 1).alias("library"),
        F.coalesce(X.extract(F.col("t"), NAME_AT_VERSION, 2), F.lit("master")).alias("version"),
    )


LOG_LIBRARY = (r"Loading library\s+([^@\s]+)@([^\s]+)", r"Attempting to resolve\s+([^@\s]+)@([^\s]+)")


def library_refs_in_log(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    name = F.coalesce(*[X.extract(line, p, 1) for p in LOG_LIBRARY])
    version = F.coalesce(*[X.extract(line, p, 2) for p in LOG_LIBRARY])
    return lines.select("build_id", "line_no", name.alias("library"), version.alias("version")).filter("library is not null").groupBy(
        "build_id", "library"
    ).agg(F.min_by("version", "line_no").alias("version"))


CALL_FORMS = (r"\b([a-z][a-zA-Z0-9_]*)\s*\(", r"\b([a-z][a-zA-Z0-9_]*)\s*\{")
#: What stands between brackets, with brackets in it up to three deep.
BRACKETED = r"[^()]*(?:\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\)[^()]*)*"
DEFINITION = r"def\s+(\w+)\s*\((" + BRACKETED + r")\)"
#: A file whose `call` is a global function with the file's name.
GLOBAL_FILE = r"(?:^|[/\\])vars[/\\](\w+)\.groovy$"
#: Calls on a line: f(a, b); f a, b; f { ... }.
SITE_BRACKETS = r"(?:^|[^\w.])([a-z]\w*)\s*\((" + BRACKETED + r")\)"
SITE_PLAIN = r"^\s*([a-z]\w*)[ \t]+([^={()\s][^(){\n]*(?:\([^()\n]*\)[^(){\n]*)*)(?:\{.*)?$"
SITE_CLOSURE = r"(?:^|[^\w.])([a-z]\w*)\s*\{"


def call_edges(sources: DataFrame) -> DataFrame:
    """Calls of functions that are not part of the pipeline language."""
    c = F.col("content")
    builtin = F.array(*[F.lit(b) for b in R.BUILTIN_CALLS])
    called = F.array_except(F.array_distinct(F.concat(*[every(c, p) for p in CALL_FORMS])), builtin)
    return sources.select("repo", "file_id", "path", F.explode(called).alias("callee"))


def definitions(sources: DataFrame) -> DataFrame:
    """Functions defined in files, with their parameters; `call` in a file of global functions goes by the file's name."""
    c = F.col("content")
    pairs = F.arrays_zip(every(c, DEFINITION, 1).alias("name"), every(c, DEFINITION, 2).alias("params"))
    rows = sources.select("repo", "file_id", "path", F.explode(pairs).alias("d"))
    name = F.when(F.col("d.name") == "call", X.extract(F.col("path"), GLOBAL_FILE))
    return rows.select("repo", "file_id", "path", F.coalesce(name, "d.name").alias("name"), split_args(F.col("d.params")).alias("params"))


def split_args(c: Column) -> Column:
    """Split at commas outside of brackets: a fold over the characters that counts the open brackets."""
    chars = F.split(F.regexp_replace(X.strip(c), r"\s+", " "), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    step = lambda acc, ch: F.struct(
        (acc["depth"] + F.when(ch.isin("(", "[", "<"), 1).when(ch.isin(")", "]", ">"), -1).otherwise(0)).alias("depth"),
        F.concat(acc["out"], F.when((ch == ",") & (acc["depth"] == 0), F.lit("\x01")).otherwise(ch)).alias("out"),
    )
    joined = F.aggregate(chars, start, step)["out"]
    return F.filter(F.transform(F.split(joined, "\x01"), lambda p: X.strip(p)), lambda p: p != "")


def call_sites(sources: DataFrame) -> DataFrame:
    """Calls with their argument lists: with brackets, as a step (`f a, b`, up to a closure) and with a closure alone (no
    arguments)."""
    line = F.col("line")
    lines = sources.select("repo", "file_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).filter(~line.contains("def "))
    zipped = lambda p, args: F.transform(F.arrays_zip(every(line, p, 1).alias("n"), args.alias("a")), lambda z: F.struct(z["n"].alias("name"), z["a"].alias("args")))
    closures = F.transform(every(line, SITE_CLOSURE, 1), lambda n: F.struct(n.alias("name"), F.lit("").alias("args")))
    found = F.concat(zipped(SITE_BRACKETS, every(line, SITE_BRACKETS, 2)), zipped(SITE_PLAIN, every(line, SITE_PLAIN, 2)), closures)
    rows = lines.select("repo", "file_id", "path", (F.col("pos") + 1).alias("line_no"), F.explode(found).alias("d"))
    return rows.filter(~F.col("d.name").isin(*R.BUILTIN_CALLS)).select(
        "repo", "file_id", "path", "line_no", F.col("d.name").alias("name"), split_args(F.col("d.args")).alias("args")
    )


NO_SIGNATURE = r"No signature of method:\s*(?:[\w$.]*\.)?(\w+)\s*\("


def missing_methods(lines: DataFrame) -> DataFrame:
    """Names of methods that logs report as called with arguments nobody defines."""
    return lines.select(X.extract(F.col("line"), NO_SIGNATURE).alias("name")).filter("name is not null").distinct()


def signature_mismatch(sites: DataFrame, defs: DataFrame, missing: DataFrame) -> DataFrame:
    """Calls whose number of arguments differs from the definition (argument_count), and calls with the right number of
    functions that logs report as missing (missing_method): there the types differ."""
    d = defs.select("repo", "name", F.col("path").alias("def_path"), "params")
    j = sites.join(d, ["repo", "name"]).join(missing.withColumn("reported", F.lit(True)), "name", "left")
    differs = F.size("args") != F.size("params")
    return j.withColumn("kind", F.when(differs, "argument_count").when(F.col("reported"), "missing_method")).filter("kind is not null").select(
        "repo", "name", "path", "line_no", "def_path", F.size("args").alias("given"), F.size("params").alias("defined"), "kind"
    )


def compare_parameters(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """Named arguments against declared names: required ones that are missing, and unknown ones."""
    word = lambda p: F.regexp_extract(F.split(p, "=")[0], r"(\w+)\s*$", 1)
    d = defs.select(
        "repo", "name", F.transform("params", word).alias("names"),
        F.transform(F.filter("params", lambda p: ~p.contains("=")), word).alias("required"),
    )
    named = F.transform(F.filter("args", lambda a: a.rlike(r"^\w+\s*:")), lambda a: F.regexp_extract(a, r"^(\w+)", 1))
    j = sites.withColumn("named", named).filter(F.size("named") > 0).join(d, ["repo", "name"])
    return j.select(
        "repo", "name", "path", "line_no", F.array_join(F.array_sort(F.array_except("required", "named")), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except("named", "names")), ",").alias("extra"),
    )


def credential_usage(sources: DataFrame) -> DataFrame:
    found = F.array_distinct(F.concat(*[every(F.col("content"), p) for p in R.CREDENTIAL_USES]))
    used = sources.select("repo", "path", "file_id", F.explode(found).alias("credential"))
    return used.groupBy("credential").agg(F.count("*").alias("files"))


def missing_credentials(usage: DataFrame, issues: DataFrame) -> DataFrame:
    """Credentials used in code whose absence logs report."""
    absent = issues.filter("family = 'credential' and issue = 'not_found'").select(F.col("name").alias("credential"), "build_id").distinct()
    return usage.join(absent.groupBy("credential").agg(F.count("*").alias("builds")), "credential")


def reach(edges: DataFrame, starts: DataFrame, depth: int, cut=None) -> DataFrame:
    """Nodes reached from start nodes with their smallest depth, level by level, without visiting twice.

    edges: repo, src, dst. starts: repo, start. Each level is one join and one anti join; `cut` stores a
    level, so that the lineage stays short and the walk ends with the first level that finds nothing.
    """
    seen = starts.select("repo", "start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    level = seen
    for i in range(1, depth + 1):
        step = level.select("repo", "start", F.col("node").alias("src")).join(edges, ["repo", "src"]).select("repo", "start", F.col("dst").alias("node")).distinct()
        level = step.join(seen.select("repo", "start", "node"), ["repo", "start", "node"], "left_anti").withColumn("depth", F.lit(i))
        if cut is not None:
            level = cut(level)
            if level.isEmpty():
                break
        seen = seen.unionByName(level)
    return seen


def call_graph(sources: DataFrame) -> DataFrame:
    """Edges between functions: a file that defines a function calls other functions."""
    defs = definitions(sources).select("repo", "file_id", F.col("name").alias("src"))
    calls = call_edges(sources).select("repo", "file_id", F.col("callee").alias("dst"))
    known = defs.select("repo", F.col("src").alias("dst")).distinct()
    return defs.join(calls, ["repo", "file_id"]).filter("src <> dst").join(known, ["repo", "dst"], "left_semi").select("repo", "src", "dst").distinct()


def import_graph(sources: DataFrame) -> DataFrame:
    """Edges between Java classes of one project: imports that share the first two parts of the package."""
    c = F.col("content")
    package = X.extract(c, r"(?m)^package\s+([\w.]+);")
    rows = sources.filter(F.col("path").endswith(".java")).select(
        "repo", F.concat_ws(".", package, F.regexp_extract("path", r"(\w+)\.java$", 1)).alias("src"), package.alias("package"),
        F.explode(every(c, r"(?m)^import\s+([\w.]+);")).alias("dst"),
    )
    prefix = F.substring_index("package", ".", 2)
    local = rows.filter(F.col("dst").startswith(prefix)).select("repo", "src", "dst")
    exists = sources.filter(F.col("path").endswith(".java")).select(
        "repo", F.concat_ws(".", package, F.regexp_extract("path", r"(\w+)\.java$", 1)).alias("dst")
    )
    return local.join(exists.distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst").distinct()


def global_functions(sources: DataFrame) -> DataFrame:
    """One row per name of a function in a file of global functions: the first path, of the first repository, counts."""
    defs = definitions(sources).filter(F.col("path").rlike(GLOBAL_FILE))
    first = F.min_by(F.struct("path", F.array_join("params", "|").alias("params")), F.struct("path", "repo", "file_id"))
    return defs.groupBy("name").agg(first.alias("f")).select("name", "f.path", "f.params")


SCRIPT_FRAME = r"at\s+Script\d+\.(\w+)\("


def library_functions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions of shared libraries that a log names, with file and parameters, and functions seen in script frames (file
    `unknown`, if no library defines them).

    Words of a line meet function names by equality, before they are made distinct. A word may be on most lines, so names are
    broadcast if a count shows that they are few.
    """
    words = lines.select("build_id", F.explode(F.array_distinct(every(F.col("line"), r"(\w+)"))).alias("name"))
    named = words.join(counted_small(functions.select("name").distinct()), "name", "left_semi").distinct()
    framed = lines.filter(F.col("line").rlike(SCRIPT_FRAME)).select("build_id", X.extract(F.col("line"), SCRIPT_FRAME).alias("name")).distinct()
    both = named.unionByName(framed).distinct().join(counted_small(functions), "name", "left")
    return both.select("build_id", "name", F.coalesce("path", F.lit("unknown")).alias("path"), F.coalesce("params", F.lit("")).alias("params"))


def root_cause_function(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """The library function of a build's first frame of library code that is no machinery and names one, in its class or as
    its method. Names meet the parts of the class name by equality."""
    frames = TR.decode_cps_frames(lines).filter("is_library and not machinery")
    parts = F.array_distinct(F.concat(F.split("class_name", r"\W+"), F.array("method")))
    named = frames.withColumn("name", F.explode(parts)).join(functions, "name")
    first = F.min_by(F.struct("name", "path", "params", "line_no", "method", "file", "src_line"), F.struct("line_no", "name"))
    return named.groupBy("build_id").agg(first.alias("f")).select("build_id", "f.*")
