"""From signals to a finding per build: gates, tiers, known failures, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import attach_facts, top_per
from faultline.operators import blame as BL, classify as C, errors as E, search as S, traces as TR
from faultline.rules import triage as R


def status_gate() -> Column:
    """Why a build is skipped; NULL if it is analysed."""
    s = F.col("status")
    return (
        F.when(F.col("building"), "in progress").when(s == "SUCCESS", "succeeded").when(s == "ABORTED", "aborted")
        .when(s == "UNSTABLE", "unstable").when(s.isNotNull() & (s != "FAILURE"), F.concat(F.lit("unexpected status: "), s))
    )


def canonical(category: Column) -> Column:
    up = F.upper(category)
    out = up
    for short, full in R.CATEGORY_ALIASES.items():
        out = F.when(up == short, full).otherwise(out)
    return out


def tier(category: Column) -> Column:
    dim = F.create_map(*[F.lit(x) for kv in R.TIERS.items() for x in kv])
    return F.coalesce(F.get(F.array(dim), F.lit(0))[canonical(category)], F.lit("unknown"))


def actionable(line: Column) -> Column:
    low = X.strip(F.lower(line))
    return (F.length(low) >= 5) & ~low.rlike(X.any_of(R.NOT_ACTIONABLE))


def needs_deep(category: Column, text: Column) -> Column:
    low = F.lower(text)
    named = F.exists(F.array(*[F.lit(t) for t in R.DEEP_TEXTS]), lambda t: low.contains(t))
    return category.isin(*R.DEEP_CATEGORIES) | F.coalesce(named, F.lit(False))


def known_failure_ord(text: Column) -> Column:
    """Position of the first known failure found in a text."""
    return X.first_match(F.lower(text), [(p, i) for i, (p, *_) in enumerate(R.KNOWN_FAILURES)], ignore_case=True)


def known_failure(ord_: Column) -> Column:
    """The known failure at a position, as a struct."""
    rows = F.array(*[
        F.struct(
            F.lit(tool).alias("tool"), F.lit(symptom).alias("symptom"), F.lit(conf).alias("confidence"),
            F.lit(cat).alias("category"), F.lit(retry).alias("retriable"),
        )
        for _, tool, symptom, conf, cat, retry in R.KNOWN_FAILURES
    ])
    return F.get(rows, ord_)


def failure_evidence(chosen: DataFrame, errors: DataFrame, inv: DataFrame, outputs: DataFrame) -> DataFrame:
    """Texts that may tell a known failure: the chosen line, five errors, output of the last commands."""
    lines5 = top_per(errors, 5, [E.error_order(), F.col("cat_ord")]).select("build_id", F.lit("error").alias("kind"), F.col("line").alias("text"))
    last5 = top_per(inv, 5, [F.col("cmd_line").desc()], out="age")
    bad = last5.filter("exit_code <> 0").groupBy("build_id").agg(F.min("age").alias("bad_age"))
    last5 = last5.join(bad, "build_id", "left").filter("bad_age is null or age <= bad_age")
    shown = last5.join(outputs.select("build_id", "cmd_line", "out_no", "output"), ["build_id", "cmd_line"])
    is_bad = F.col("age") == F.col("bad_age")
    plain = (F.col("out_no") <= 5) & F.lower("output").rlike(R.EVIDENCE_WORDS)
    kept = shown.filter(F.when(is_bad, F.col("out_no") <= 10).otherwise(plain))
    return (
        chosen.select("build_id", F.lit("line").alias("kind"), F.col("chosen_text").alias("text"))
        .unionByName(lines5)
        .unionByName(kept.select("build_id", F.lit("output").alias("kind"), F.col("output").alias("text")))
        .unionByName(last5.filter(is_bad).select("build_id", F.lit("command").alias("kind"), F.col("command").alias("text")))
    )


def known_failures(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("build_id").agg(F.min(known_failure_ord(F.col("text"))).alias("rule")).filter("rule is not null").select(
        "build_id", "rule", known_failure(F.col("rule")).alias("k")
    )


def merge_retriable(model: Column, known: Column, confidence: Column) -> Column:
    """Trust a sure known error, else both must allow a retry; without a known error the model decides."""
    return F.when(known.isNull(), model).when(confidence >= 0.75, known).otherwise(model & known)


def retry_policy(known: Column, confidence: Column) -> Column:
    return F.when(known.isNull(), "model_only").when(confidence >= 0.75, "kb_high_trust").otherwise("conservative_and")


# ---- model answers ----------------------------------------------------------------------------

def clean_markdown(c: Column) -> Column:
    for pattern, keep in R.MARKDOWN:
        c = F.regexp_replace(c, pattern, "$1" if keep else "")
    return X.strip(F.regexp_replace(c, r"\s+", " "))


def answer_category(text: Column) -> Column:
    """Category whose words occur most, weighted; ties go to the earlier list."""
    low = F.lower(text)
    scores = [
        F.struct(
            (-F.round(F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))) * weight, 6)).alias("neg"),
            F.lit(i).alias("i"), F.lit(name).alias("name"),
        )
        for i, (name, weight, words) in enumerate(R.ANSWER_CATEGORIES)
    ]
    best = F.array_min(F.array(*scores))
    return F.when(best["neg"] < 0, best["name"]).otherwise("UNKNOWN")


def _says(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(text).contains(w))


def answer_confidence(text: Column) -> Column:
    return F.when(_says(text, R.SURE), 0.80).when(_says(text, R.UNSURE), 0.55).when(_says(text, R.FAIRLY_SURE), 0.70).otherwise(0.65)


def answer_retriable(text: Column) -> Column:
    return _says(text, R.RETRY) & ~_says(text, R.NO_RETRY)


def answer_cause(text: Column) -> Column:
    t = X.strip(text)
    sections = [F.nullif(clean_markdown(X.extract(t, p)), F.lit("")) for p in R.CAUSE_SECTIONS]
    statements = [F.when(F.length(clean_markdown(X.extract(t, p))) > 20, clean_markdown(X.extract(t, p))) for p in R.CAUSE_STATEMENTS]
    body = F.regexp_replace(t, r"(?i)^(Here'?s?\s+(the|my)\s+)?(root cause\s+)?analysis[:\s]*\n*", "")
    body = F.regexp_replace(body, r"(?i)^(Based on|Looking at|After analyzing|I've analyzed)[^.]+\.\s*", "")
    paras = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: X.strip(p)), lambda p: (F.length(p) > 30) & ~p.startswith("#"))
    return X.strip(F.left(F.coalesce(*sections, *statements, clean_markdown(F.get(paras, F.lit(0))), F.left(clean_markdown(t), F.lit(500))), F.lit(600)))


def answer_fix(text: Column) -> Column:
    return F.left(F.coalesce(*[clean_markdown(X.extract(X.strip(text), p)) for p in R.FIX_FORMS], F.lit("")), F.lit(400))


ANSWER = "struct<root_cause:string,confidence:string,category:string,is_retriable:string,fix:string>"


def unit_number(c: Column) -> Column:
    """A confidence between 0 and 1 from a number, a share or a percentage."""
    n = F.regexp_extract(c, r"([0-9]*\.?[0-9]+)", 1).try_cast("double")
    n = F.when(c.contains("%") | (n > 1), n / 100).otherwise(n)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(n, F.lit(0.0))))


def normalize_responses(responses: DataFrame) -> DataFrame:
    """One typed row per answer, from its JSON part or else from its prose."""
    raw = F.col("raw_text")
    bare = F.regexp_replace(F.regexp_replace(X.strip(raw), r"^```\w*\n?", ""), r"\n?```$", "")
    part = F.coalesce(X.extract(bare, R.ANSWER_JSON, 0), bare)
    d = responses.withColumn("j", F.from_json(part, ANSWER))
    ok = F.col("j.root_cause").isNotNull()
    return d.select(
        "build_id", "iteration", ok.alias("is_json"),
        F.when(ok, F.col("j.root_cause")).otherwise(answer_cause(raw)).alias("root_cause"),
        F.round(F.when(ok, unit_number(F.col("j.confidence"))).otherwise(answer_confidence(raw)), 6).alias("confidence"),
        F.when(ok, F.coalesce("j.category", F.lit("UNKNOWN"))).otherwise(answer_category(raw)).alias("category"),
        F.when(ok, F.lower(F.coalesce("j.is_retriable", F.lit(""))).isin("true", "yes", "1")).otherwise(answer_retriable(raw)).alias("is_retriable"),
        F.when(ok, F.coalesce("j.fix", F.lit(""))).otherwise(answer_fix(raw)).alias("fix"),
    )


def response_profile(responses: DataFrame) -> DataFrame:
    t = F.col("raw_text")
    return responses.groupBy(answer_category(t).alias("category"), answer_retriable(t).alias("retriable")).agg(
        F.count("*").alias("n"), F.round(F.avg(answer_confidence(t)), 6).alias("avg_confidence")
    )


def best_iteration(answers: DataFrame, enough: float = 0.7, most: int = 3) -> DataFrame:
    """Most confident of the iterations up to the first that was sure enough; the earlier one on a tie."""
    first = answers.filter(F.col("iteration") <= most)
    stop = first.filter(F.col("confidence") >= enough).groupBy("build_id").agg(F.min("iteration").alias("stop"))
    kept = first.join(stop, "build_id", "left").filter("stop is null or iteration <= stop")
    cols = [c for c in answers.columns if c != "build_id"]
    best = F.max_by(F.struct(*cols), F.struct("confidence", -F.col("iteration"))).alias("b")
    return kept.groupBy("build_id").agg(best, F.count("*").alias("used")).select("build_id", "b.*", "used")


def boost(answers: DataFrame, known: DataFrame, kb: DataFrame) -> DataFrame:
    """Raise an answer's confidence to that of a known failure or known error; fill category and fix."""
    k = known.select("build_id", "k.*").select(
        "build_id", F.col("confidence").alias("k_conf"), F.col("category").alias("k_cat"), F.col("retriable").alias("k_retry")
    )
    d = answers.join(k, "build_id", "left").join(kb, "build_id", "left")
    c1 = F.greatest(F.col("confidence"), F.coalesce("k_conf", F.lit(0.0)))
    cat = F.when((F.col("category") == "UNKNOWN") & (F.col("k_conf") > F.col("confidence")), F.col("k_cat")).otherwise(F.col("category"))
    model = F.col("is_retriable") | F.coalesce("k_retry", F.lit(False))
    return d.select(
        "build_id", "iteration", "root_cause",
        F.greatest(c1, F.coalesce("kb_conf", F.lit(0.0))).alias("confidence"),
        F.when((cat == "UNKNOWN") & F.col("kb_cat").isNotNull(), F.col("kb_cat")).otherwise(cat).alias("category"),
        F.when((F.col("fix") == "") & F.col("kb_fix").isNotNull(), F.col("kb_fix")).otherwise(F.col("fix")).alias("fix"),
        merge_retriable(model, F.col("kb_retry"), F.col("kb_conf")).alias("retriable"),
        retry_policy(F.col("kb_retry"), F.col("kb_conf")).alias("policy"),
    )


def suggestion(cause: Column) -> Column:
    hit = X.first_match(F.lower(cause), R.SUGGESTIONS)
    return F.when(F.length(cause) > 10, F.coalesce(hit, F.lit("fix the reported error"))).otherwise("see the error details")


def calibrate(confidence: Column, strong: Column, candidates: Column, noise: Column) -> Column:
    c = F.when(strong, F.greatest(confidence, F.lit(0.78))).when(candidates, F.greatest(confidence, F.lit(0.55))).otherwise(confidence * 0.92)
    c = F.when(noise & ~candidates, F.least(c, F.lit(0.62))).otherwise(c)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def log_signs(lines: DataFrame) -> DataFrame:
    """Per build: strong checkout trouble, any signal line, any noise in the tail."""
    line = F.col("line")
    flagged = lines.groupBy("build_id").agg(
        F.max(line.rlike(R.STRONG_SCM)).alias("strong"), F.max(X.found(line, S.SIGNALS, True)).alias("candidates")
    )
    tail = S.partition_noise(S.tail_lines(lines)).groupBy("build_id").agg(F.max("noise").alias("noise"))
    return flagged.join(tail, "build_id")


def actionable_gate(errors: DataFrame, traces: DataFrame, stages: DataFrame, builds: DataFrame) -> DataFrame:
    """Builds with nothing to act on are skipped: no error that matters, no trace, no stage."""
    n = errors.groupBy("build_id").agg(F.count_if(actionable(F.col("line"))).alias("actionable"))
    t = traces.groupBy("build_id").agg(F.count("*").alias("traces"))
    return (
        builds.select("build_id").join(n, "build_id", "left").join(t, "build_id", "left").join(stages, "build_id", "left")
        .select(
            "build_id", F.coalesce("actionable", F.lit(0).cast("bigint")).alias("actionable"),
            F.coalesce("traces", F.lit(0).cast("bigint")).alias("traces"), "last_stage",
        )
        .withColumn("skip", (F.col("actionable") == 0) & (F.col("traces") == 0) & F.col("last_stage").isNull())
    )


def fallback_result(first: DataFrame, traces: DataFrame, category: DataFrame, stages: DataFrame) -> DataFrame:
    """A finding from the log alone: first error, else first trace, and what its category implies."""
    order = F.struct("line_no", "lang")
    t = traces.groupBy("build_id").agg(F.min_by(F.concat_ws(": ", "exception", "message"), order).alias("trace"))
    d = first.select("build_id", "parser_text").join(t, "build_id", "full").join(category, "build_id", "left").join(stages, "build_id", "left")
    cat = F.coalesce("primary_category", F.lit("UNKNOWN"))
    return d.select(
        "build_id", cat.alias("category"), tier(cat).alias("tier"), F.col("last_stage").alias("stage"),
        F.coalesce(F.left("parser_text", F.lit(500)), "trace").alias("primary_error"), F.lit(0.6).alias("confidence"),
        (tier(cat) == "external_system").alias("retriable"),
    )


def findings(lines: DataFrame, builds: DataFrame, cut=lambda df: df) -> DataFrame:
    """One row per build that is to be analysed: where, what, which command, and whether a retry helps.

    `cut` is applied to the frames that several branches share (errors, command lines, commands, chosen
    lines); a job over many builds passes a checkpoint there, so that the log is read once for each.
    """
    facts = cut(C.build_facts(lines))
    errors = E.parsed_errors(lines, cut=cut, facts=facts)
    chosen = cut(E.reconcile(E.primary_line(lines, facts), E.first_error(errors)))
    commands = cut(C.command_lines(lines))
    inv = cut(C.invocations_of(commands))
    tool = BL.failing_tool(lines, chosen, inv).select("build_id", F.col("tool").alias("failing_tool"), "via")
    known = known_failures(failure_evidence(chosen, errors, inv, C.command_output(commands)))
    category = E.primary_category(errors)
    gate = builds.withColumn("skip", status_gate()).filter("skip is null").select("build_id", "job", "number", "status", "ts")
    d = (
        gate.join(chosen, "build_id").join(category, "build_id", "left").join(tool, "build_id", "left").join(known, "build_id", "left")
    )
    cat = F.coalesce("primary_category", F.lit("UNKNOWN"))
    found = F.when(cat == "UNKNOWN", F.coalesce("k.category", F.lit("UNKNOWN"))).otherwise(cat)
    t = tier(found)
    return d.select(
        "build_id", "job", "number", "status", found.alias("category"), t.alias("tier"), F.col("last_stage").alias("stage"),
        F.col("chosen_line").alias("line_no"), F.left("chosen_text", F.lit(500)).alias("primary_error"), "chosen_source",
        E.error_type(F.col("chosen_text")).alias("error_type"), "failing_tool", "via", F.col("k.symptom").alias("symptom"),
        F.coalesce("k.confidence", F.lit(0.6)).alias("confidence"),
        F.coalesce("k.retriable", t == "external_system").alias("retriable"),
        needs_deep(found, F.col("chosen_text")).alias("needs_deep"), suggestion(F.col("chosen_text")).alias("fix"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
