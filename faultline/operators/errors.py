"""Error lines: matching, de-duplication, scoring and the choice of the primary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.functions import text as X
from faultline.functions.scan import attach_facts, layout, near, own, top_per, whole_keys, with_halo
from faultline.operators import classify as C
from faultline.rules import errors as R, shell

IGNORED = X.any_of(shell.NOISE_LINES)


def category_hits(line: Column, rules=R.CATEGORY_PATTERNS) -> Column:
    """Array of (ord, category) for every category of which a pattern is found."""
    items = [
        F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("category")))
        for i, (name, hit) in enumerate(zip(rules, X.found_each(line, list(rules.values()))))
    ]
    return F.array_compact(F.array(*items))


def pattern_of(line: Column, category: Column, rules=R.CATEGORY_PATTERNS) -> Column:
    """First pattern of the category that is found in the line; meant for hits only."""
    out = F.when(F.lit(False), F.lit(""))
    for name, patterns in rules.items():
        out = out.when(category == name, X.first_match(line, [(p, p) for p in patterns]))
    return out


def may_match(line: Column, rules=R.CATEGORY_PATTERNS) -> Column:
    """Whether a fixed text of the rules is there at all: a screen before `match_errors`, which asks for no line without one."""
    return X.maybe(line, rules.values())


def match_errors(lines: DataFrame, rules=R.CATEGORY_PATTERNS, ignore: str | None = None) -> DataFrame:
    """One row per (line, category); noise lines are skipped."""
    line = F.col("line")
    skip = line.rlike(IGNORED) if ignore is None else (line.rlike(IGNORED) | line.rlike(ignore))
    hits = lines.filter(may_match(line, rules)).filter(~skip).withColumn("hit", F.explode(category_hits(line, rules)))
    return hits.select(*lines.columns, F.col("hit.ord").alias("cat_ord"), F.col("hit.category").alias("category"))


def dedupe_errors(errors: DataFrame, newest: bool = True) -> DataFrame:
    """Lines of a category that are equal but for blanks around them count once; the aggregate combines before the shuffle."""
    keyed = errors.withColumn("key", X.strip(F.col("line")))
    pick = F.max if newest else F.min
    rest = [c for c in errors.columns if c not in ("build_id", "category", "line_no")]
    row = pick(F.struct("line_no", *rest)).alias("r")
    return keyed.groupBy("build_id", "category", "key").agg(row).select("build_id", "category", "r.*")


def errors_from_end(focus: DataFrame, limit: int | None = None) -> DataFrame:
    """Errors of the focus section, newest copy of each. With a limit, a report of the newest: a line's
    categories stay together once it is reached."""
    found = dedupe_errors(match_errors(focus.select("build_id", "line_no", "line")))
    if limit is None:
        return found
    w = W.partitionBy("build_id").orderBy(F.col("line_no").desc())
    return found.withColumn("rk", F.rank().over(w)).filter(F.col("rk") <= limit).drop("rk")


def parsed_errors(lines: DataFrame, custom: dict | None = None, cut=lambda df: df, facts: DataFrame | None = None) -> DataFrame:
    """All errors of a build, each once: the newest copy inside the focus section (origin `focus`), or else
    the oldest copy anywhere (origin `whole`).

    The log is matched once. The focus is then looked up for the hits alone, and one aggregate chooses the
    copy. Callers read the result several times, so `cut` may store it.
    """
    hits = match_errors(lines)
    if custom:
        hits = hits.unionByName(match_errors(lines, custom).withColumn("cat_ord", F.col("cat_ord") + 100))
    placed = attach_facts(hits, C.focus_facts(lines, facts=facts).select("build_id", "n_lines", "focus_from"), keep=True)
    inside = (F.col("line_no") >= F.col("focus_from")) & (F.col("cat_ord") < 100)
    row = F.struct("line_no", "line", "cat_ord")
    newest, oldest = F.max(F.when(inside, row)), F.min(row)
    kept = F.when(newest.isNotNull(), F.struct(F.lit("focus").alias("origin"), newest.alias("r"))).otherwise(
        F.struct(F.lit("whole").alias("origin"), oldest.alias("r"))
    )
    distinct = placed.groupBy(*whole_keys(lines), "category", X.strip(F.col("line")).alias("key")).agg(kept.alias("k"))
    return cut(distinct.select("build_id", "category", "k.origin", "k.r.*")).withColumn("severity", X.severity(F.col("line")))


def error_order() -> Column:
    """Position of an error in a build: those of the focus, newest first, then the others, oldest first."""
    return F.when(F.col("origin") == "focus", -F.col("line_no")).otherwise(F.col("line_no"))


def first_error(errors: DataFrame) -> DataFrame:
    order = F.struct(error_order(), F.col("cat_ord"))
    return errors.groupBy("build_id").agg(
        F.min_by("line_no", order).alias("parser_line"),
        F.min_by("line", order).alias("parser_text"),
        F.min_by("category", order).alias("parser_category"),
        F.count("*").alias("n_errors"),
    )


def around(points: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """Lines near given (build_id, at) points: the numbers are spelled out and joined exactly."""
    span = F.sequence(F.greatest(F.col("at") - before, F.lit(1)), F.col("at") + after)
    return points.withColumn("line_no", F.explode(span)).join(
        lines.select("build_id", "line_no", F.col("line").alias("near_line")), ["build_id", "line_no"]
    )


def around_point(points: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """The same for one point per build: it meets the lines of its build as a fact, and no line number is spelled out."""
    facts = points.withColumn("_upto", F.col("at") + after)
    near_lines = attach_facts(lines.withColumnRenamed("line", "near_line"), facts, "_upto")
    return near_lines.filter(F.col("line_no").between(F.col("at") - before, F.col("_upto"))).drop("_upto")


def context(points: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """Each (build_id, at) point with the lines near it as one list `c` of (line_no, near_line), in order.

    For points that are many: they lie among the lines of a chunk and a window reads the list, so lines are shuffled once
    and not once a point.
    """
    given = lines.select("build_id", "line_no", F.struct("line_no", F.col("line").alias("near_line")).alias("_near"))
    asked = points.select("build_id", F.col("at").alias("line_no"), F.struct(*[c for c in points.columns if c != "build_id"]).alias("_point"))
    rows = with_halo(given.unionByName(asked, allowMissingColumns=True), before, after)
    seen = rows.withColumn("c", F.collect_list("_near").over(near().rangeBetween(-before, after)))
    return own(seen).filter("_point is not null and size(c) > 0").select("build_id", "_point.*", "c")


def primary_category(errors: DataFrame) -> DataFrame:
    """Most frequent category; ties go by the fixed priority."""
    n = F.col("n")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in R.CATEGORY_PRIORITY]), F.col("category")), F.lit(0))
    rank = F.when(rank == 0, F.lit(99)).otherwise(rank)
    return (
        errors.groupBy("build_id", "category").agg(F.count("*").alias("n"))
        .groupBy("build_id")
        .agg(F.min_by("category", F.struct(-n, rank)).alias("primary_category"), F.sum("n").alias("errors"))
    )


def scm_weight(line: Column) -> Column:
    return X.best_weight(line, R.SCM_WEIGHTS, ignore_case=True)


def line_weight(line: Column) -> Column:
    return X.best_weight(line, R.LINE_WEIGHTS, ignore_case=True)


def weighed(lines: DataFrame) -> DataFrame:
    """Lines that can have a score, with both weights of their text."""
    line = F.col("line")
    return lines.withColumn("_weight", line_weight(line)).withColumn("_scm", scm_weight(line)).filter("_weight > 0 or _scm >= 7")


def score_lines(lines: DataFrame) -> DataFrame:
    """Weight of each line as the primary error; needs n_lines on the line, and takes the weights of its text from `weighed` if they are there."""
    line, n = F.col("line"), F.col("n_lines")
    known = "_weight" in lines.columns
    scm = F.col("_scm") if known else scm_weight(line)
    early = (F.col("line_no") - 1) / F.greatest(n - 1, F.lit(1)) < 0.35
    bonus = F.when((scm >= 7) & (n > 20), F.least(scm, F.lit(10)) + F.when(early, 4).otherwise(0)).otherwise(0)
    score = F.when(X.strip(line) == "", F.lit(0)).otherwise((F.col("_weight") if known else line_weight(line)) + bonus)
    return lines.withColumn("score", score).drop("_weight", "_scm")


def primary_line(lines: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Best line from the last stage on (else the last 200); without a hit the last line with text.

    Only lines with a weight of their own meet the facts of their build; the last line with text needs none.
    """
    facts, keys = C.focus_facts(lines, 200, facts), whole_keys(lines)
    inside = attach_facts(weighed(lines), facts, keep=True).filter(F.col("line_no") >= F.col("focus_from"))
    wanted = score_lines(inside).filter("score > 0")
    best = wanted.groupBy(*keys).agg(F.max(F.struct("score", "line_no", "line")).alias("best")).drop("_b")
    text = F.when(X.strip(F.col("line")) != "", F.struct("line_no", "line"))
    last = lines.groupBy(*keys).agg(F.max(text).alias("last")).drop("_b")
    return (
        last.join(facts, "build_id").join(best, "build_id", "left")
        .select("build_id", "n_lines", "last_stage", F.col("best.line_no").alias("best"), F.col("best.line").alias("best_text"),
                F.col("best.score").alias("score"), F.col("last.line_no").alias("last"), F.col("last.line").alias("last_text"))
        .select(
            "build_id", "n_lines", "last_stage",
            F.coalesce("best", "last").alias("finder_line"), F.coalesce("best_text", "last_text").alias("finder_text"),
            F.coalesce("score", F.lit(0)).alias("score"), F.col("best").isNotNull().alias("scored"),
        )
    )


def reconcile(primary: DataFrame, first: DataFrame) -> DataFrame:
    """Settle between the tail-focused line and the parser's first error."""
    d = primary.join(first, "build_id", "left")
    n, fl, pl = F.col("n_lines"), F.col("finder_line"), F.col("parser_line")
    scm = scm_weight(F.col("parser_text"))
    usable = F.col("scored") & pl.isNotNull()
    early = usable & (scm >= 9) & (pl - 1 < F.floor(n / 3)) & (fl - 1 >= F.floor(2 * n / 3))
    ahead = usable & (scm >= 7) & (pl < fl) & (fl - pl > F.greatest(F.lit(25), F.floor(n / 10)))
    close = F.abs(pl - fl) <= 2
    source = (
        F.when(early, "parser_early_scm").when(ahead, "parser_precedes_tail")
        .when(usable & ~close, "finder_with_note").otherwise("finder")
    )
    parsed = early | ahead
    note = (
        F.when(early, F.format_string("early checkout failure on line %d preferred to line %d", pl, fl))
        .when(ahead, F.format_string("checkout failure on line %d comes before line %d", pl, fl))
        .when(usable & ~close, F.format_string("first parsed error on line %d, focus on line %d", pl, fl))
        .otherwise("")
    )
    return (
        d.withColumn("parsed", F.coalesce(parsed, F.lit(False)))
        .withColumn("chosen_line", F.when(F.col("parsed"), pl).otherwise(fl))
        .withColumn("chosen_text", F.when(F.col("parsed"), F.col("parser_text")).otherwise(F.col("finder_text")))
        .withColumn("chosen_source", source)
        .withColumn("aligned", F.when(usable, ~ahead & close).otherwise(F.lit(True)))
        .withColumn("note", note)
        .drop("parsed")
    )


def chosen_lines(lines: DataFrame, cut=lambda df: df) -> DataFrame:
    facts = cut(C.build_facts(lines))
    return reconcile(primary_line(lines, facts), first_error(parsed_errors(lines, cut=cut, facts=facts)))


def error_type(line: Column) -> Column:
    low = F.lower(line)
    out = X.first_match(low, [(X.any_of(p), t) for t, p in R.ERROR_TYPES.items()])
    return F.coalesce(out, F.lit("unknown"))


def identifiers(line: Column) -> Column:
    """Sorted distinct identifiers of an error line."""
    found = [F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in (R.ID_QUOTED, *R.ID_AFTER_WORD, R.ID_CAPS)]
    noise = F.array(*[F.lit(w) for w in R.ID_NOISE])
    kept = F.filter(F.concat(*found), lambda x: (F.length(x) > 1) & ~F.array_contains(noise, F.upper(x)))
    return F.array_sort(F.array_distinct(kept))


def deep_identifiers(line: Column) -> Column:
    found = [F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in R.DEEP_IDS]
    found += [F.regexp_extract_all(line, F.lit(R.DEEP_OPTION), F.lit(g)) for g in (1, 2)]
    noise = F.array(*[F.lit(w) for w in R.DEEP_ID_NOISE])
    kept = F.filter(
        F.concat(*found),
        lambda x: (F.length(x) >= 3) & ~F.array_contains(noise, F.lower(x)) & ~x.rlike(r"^\d+$"),
    )
    return F.array_sort(F.array_distinct(kept))


def related_lines(lines: DataFrame, chosen: DataFrame, k: int = 10) -> DataFrame:
    """Nearest lines that name an identifier of the chosen line; ids travel as one array per build."""
    facts = (
        chosen.select("build_id", "n_lines", "chosen_line", identifiers(F.col("chosen_text")).alias("ids"))
        .filter(F.size("ids") > 0)
    )
    low = F.lower("line")
    hits = attach_facts(lines, facts).filter(
        (F.col("line_no") != F.col("chosen_line"))
        & F.exists("ids", lambda i: F.col("line").contains(i) | low.contains(F.lower(i)))
    )
    distance = F.abs(F.col("line_no") - F.col("chosen_line"))
    return top_per(hits, k, [distance, F.col("line_no")]).select("build_id", "chosen_line", "line_no", "line", "rn")


def deep_score(line: Column) -> Column:
    low, t = F.lower(line), X.strip(line)
    cause, raised, error = X.found_each(line, [[r"^\s*(Caused by|Exception|Error):"], [r"\w+Exception:"], [r"\w+Error:"]])
    points = (
        (low.contains("exception"), 50), (low.contains("error") & ~low.contains("error="), 30),
        (low.contains("failed"), 25), (low.contains("failure"), 25), (cause, 40), (raised, 45), (error, 40), (t.startswith("#"), -50),
        (line.contains("WARN") & ~line.contains("ERROR"), -20), (F.length(t) < 10, -30),
        (line.contains("at ") & line.contains("(") & line.contains(")"), -20),
    )
    total = F.lit(0)
    for cond, p in points:
        total = total + F.when(cond, F.lit(p)).otherwise(F.lit(0))
    return F.greatest(F.lit(0), total)


def deep_primary_line(lines: DataFrame, tail: int = 200) -> DataFrame:
    """Best deep score among the last lines of a build; the later line wins a tie."""
    # a score needs the line alone, so only lines that have one meet the facts of their build
    able = lines.withColumn("score", deep_score(F.col("line"))).filter("score > 0")
    keys = whole_keys(lines)
    near_end = attach_facts(able, C.line_count(lines, keys), keep=True)
    # the search stops short of the first line when the log is no longer than the tail
    scored = near_end.filter(F.col("line_no") > F.greatest(F.col("n_lines") - tail, F.lit(0)) + 1)
    order = F.struct("score", "line_no")
    return scored.groupBy(*keys).agg(
        F.max_by("line_no", order).alias("line_no"), F.max_by("line", order).alias("line"), F.max("score").alias("score"),
        F.first("n_lines").alias("n_lines"),
    ).drop("_b")


def deep_types(primary: DataFrame, lines: DataFrame) -> DataFrame:
    """Error type of the primary line with the evidence for it; context counts 20 less than the line."""
    # context is ten lines back to four lines ahead; a build has one point, which meets its lines as a fact
    points = primary.select("build_id", F.col("line_no").alias("at"), F.col("line").alias("at_line"), (F.col("line_no") + 4).alias("upto"))
    ctx = attach_facts(lines.withColumnRenamed("line", "near_line"), points, "upto").filter(F.col("line_no").between(F.col("at") - 10, F.col("upto")))
    flags = [F.max(hit).alias(f"c{i}") for i, hit in enumerate(X.found_each(F.col("near_line"), [p for _, _, p in R.DEEP_TYPES], True))]
    seen = ctx.groupBy("build_id", "at", "at_line").agg(*flags)
    scores, on_lines = [], X.found_each(F.col("at_line"), [p for _, _, p in R.DEEP_TYPES], True)
    for i, ((name, base, _), on_line) in enumerate(zip(R.DEEP_TYPES, on_lines)):
        score = F.when(on_line, F.lit(base)).when(F.col(f"c{i}"), F.lit(base - 20))
        where = F.when(on_line, F.lit("line")).otherwise(F.lit("context"))
        rank = F.when(on_line, F.lit(i)).otherwise(F.lit(100 + i))
        scores.append(F.when(score.isNotNull(), F.struct((-score).alias("neg"), rank.alias("rank"), F.lit(name).alias("type"), where.alias("seen"))))
    found = F.array_sort(F.array_compact(F.array(*scores)))
    return seen.withColumn("found", found).select(
        "build_id", F.col("at").alias("line_no"),
        F.coalesce(F.get("found", F.lit(0))["type"], F.lit("UNKNOWN")).alias("error_type"),
        F.coalesce(-F.get("found", F.lit(0))["neg"], F.lit(0)).alias("score"),
        F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["type"], f["seen"])), ",").alias("evidence"),
    )


def trace_identifiers(lines: DataFrame, primary: DataFrame, k: int = 5) -> DataFrame:
    """Definition line and use count of the first identifiers of the primary line."""
    facts = primary.select("build_id", "n_lines", F.slice(deep_identifiers(F.col("line")), 1, k).alias("ids")).filter(F.size("ids") > 0)
    hits = (
        attach_facts(lines, facts)
        .filter(F.exists("ids", lambda i: F.col("line").contains(i)))
        .withColumn("ident", F.explode("ids"))
        .filter(F.col("line").contains(F.col("ident")))
    )
    quoted = F.concat(F.lit(r"\Q"), F.col("ident"), F.lit(r"\E"))
    defines = F.expr("true") & (
        F.regexp_like("line", F.concat(quoted, F.lit(r"\s*=")))
        | F.regexp_like("line", F.concat(F.lit("--"), quoted, F.lit(r"[=\s]")))
        | F.regexp_like("line", F.concat(F.lit(r"export\s+"), quoted))
        | F.regexp_like("line", F.concat(quoted, F.lit(r":\s")))
    )
    return (
        hits.withColumn("defines", defines)
        .groupBy("build_id", "ident")
        .agg(
            F.min(F.when(F.col("defines"), F.col("line_no"))).alias("defined_at"),
            F.min_by(X.strip(F.col("line")), F.when(F.col("defines"), F.col("line_no"))).alias("definition"),
            F.count("*").alias("mentions"),
        )
        .withColumn("uses", F.col("mentions") - F.when(F.col("defined_at").isNotNull(), 1).otherwise(0))
        .drop("mentions")
    )


def is_pipeline_error(line: Column, rules=R.PIPELINE_ERRORS) -> Column:
    return X.found(line, rules, True)


# Exception forms of the investigation report, first one found wins.
EXCEPTION_FORMS = (
    ("exception", r"(\w+(?:\.\w+)*Exception):\s*(.+)"), ("error", r"(\w+(?:\.\w+)*Error):\s*(.+)"),
    ("jenkins_error", r"\[ERROR\]\s*(.+)"), ("error_line", r"ERROR:\s*(.+)"), ("build_failure", r"FAILURE:\s*(.+)"),
    ("build_failed", r"BUILD FAILED"), ("missing_method", r"groovy\.lang\.MissingMethodException:\s*(.+)"),
    ("missing_property", r"groovy\.lang\.MissingPropertyException:\s*(.+)"),
)


def extract_exceptions(lines: DataFrame, k: int = 20) -> DataFrame:
    """First k typed exception lines per build, with two lines of context on either side."""
    line = F.col("line")
    kind = X.first_match(line, [(p, t) for t, p in EXCEPTION_FORMS])
    message = F.coalesce(*[X.extract(line, p, 0) for _, p in EXCEPTION_FORMS])
    hits = lines.withColumn("kind", kind).filter("kind is not null").withColumn("message", message)
    first = top_per(hits, k, [F.col("line_no")]).select("build_id", F.col("line_no").alias("at"), "kind", "message")
    return (
        around(first, lines, 2, 2).groupBy("build_id", "at", "kind", "message")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "near_line"))).alias("ctx"))
        .select("build_id", F.col("at").alias("line_no"), "kind", "message", F.array_join("ctx.near_line", "\n").alias("context"))
    )
