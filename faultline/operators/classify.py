"""Line types, shell state, stages, methods and commands of console logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.functions import text as X
from faultline.functions.scan import BUILD, attach_facts, has_long, layout, near, own, scan, top_per, whole_keys, with_halo
from faultline.rules import shell

STAGE_LABEL = r"\[Pipeline\]\s*\{\s*\(([^)]+)\)"
STAGE_CALL = r"stage\s*\(\s*['\"]([^'\"]+)['\"]"
NODE_FORMS = (r"Running on\s+([^\s\n]+)", r"node\s*\(\s*['\"]([^'\"]+)['\"]", r"\[([^\]]+)\]\s+Running")
#: What moves the stage or the node of the lines after it.
PLACE_FORMS = (STAGE_LABEL, STAGE_CALL, *NODE_FORMS)
STAGE_HEADER = r"(?i)\[Pipeline\]\s*stage\s*$"
STAGE_END = r"(?i)\[Pipeline\]\s*//\s*stage\s*$"
LEGACY_STAGE = r"(?i)^\[Pipeline\]\s*\{\s*\((.*)\)\s*$"
NOT_A_LABEL = ("echo", "sh", "node", "script", "library", "tool", "properties", "parallel", "stage")
METHOD_PAIR = r"\d{2}:\d{2}:\d{2}\s+(\w+):\s*\1"
METHOD_STARTING = r"\[(\w+)\]\s*Starting"
METHOD_REPEAT = r"^\d{2}:\d{2}:\d{2}\s+(\S[^:]*?):\s*\1\s*$"
METHOD_FINISH = r"^(.+?)\s+:time-elapsed-seconds:\d+"


# ---- line types -------------------------------------------------------------------------------

def marker(line: Column, prefix: str | None = None) -> Column:
    """Type of a pipeline marker line, NULL for all other lines."""
    t = X.strip(line)
    rest = X.strip(F.substr(t, F.lit(11)))
    block = X.strip(F.substr(rest, F.lit(3)))
    kind = F.when(
        t.startswith("[Pipeline]"),
        F.when(rest.startswith("stage") | rest.startswith("{ ("), "pipeline_stage")
        .when(rest == "echo", "pipeline_echo")
        .when(rest == "sh", "pipeline_sh")
        .when(rest.startswith("//") & block.isin(*shell.WRAPPER_BLOCKS), "block_end")
        .when(rest.isin(*shell.WRAPPER_BLOCKS), "block_start")
        .otherwise("pipeline_step"),
    )
    return F.when(line.contains(prefix), "method_tag").otherwise(kind) if prefix else kind


def classify_markers(lines: DataFrame, prefix: str | None = None) -> DataFrame:
    return lines.withColumn("marker", marker(F.col("line"), prefix))


def typed_lines(lines: DataFrame, prefix: str | None = None, keys=("build_id",), long: bool | None = None, keep: bool = False) -> DataFrame:
    """Every line with its type; the shell state and the previous marker come from the lines before. `long` and `keep` as in `scan`."""
    m = F.col("marker")
    state = F.when(m == "pipeline_sh", True).when(m.isin("pipeline_step", "pipeline_stage", "pipeline_echo"), False)
    lined = scan(
        classify_markers(lines, prefix),
        {"in_sh": ("last", state, False), "before": ("last", F.coalesce(m, F.lit("")), False)},
        keys=keys, long=long, keep=keep,
    )
    line = F.col("line")
    kind = (
        F.when(m.isNotNull(), m)
        .when(F.col("before") == "pipeline_echo", "echo_output")
        .when(F.col("in_sh"), F.when(X.shell_command(line).isNotNull(), "shell_command").otherwise("shell_output"))
        .when(X.dollar_command(line).isNotNull(), "shell_command")
        .otherwise("other")
    )
    return lined.withColumn("in_sh", F.coalesce("in_sh", F.lit(False))).withColumn("line_type", kind).drop("before", "marker")


def context_labels(context: DataFrame) -> DataFrame:
    """Short labels for context lines; state starts afresh on either side of the error line."""
    t = X.strip(F.col("line"))
    rest = X.strip(F.substr(t, F.lit(11)))
    mark = F.when(
        t.startswith("[Pipeline]"),
        F.when(rest.startswith("stage") | rest.startswith("{ ("), "STAGE")
        .when(rest == "echo", "ECHO").when(rest == "sh", "SH").otherwise("STEP"),
    )
    # a side has a few dozen lines, so no chunks; marks are found before the window, which then needs no text
    lines_before = W.partitionBy("build_id", "side").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    out = (
        context.withColumn("mark", mark).withColumn("traced", t.rlike(r"^\d{2}:\d{2}:\d{2}\s+\+\s+(.+)"))
        .withColumn("inside", F.last(F.when(F.col("mark").isNotNull(), F.col("mark") == "SH"), ignorenulls=True).over(lines_before))
        .withColumn("before", F.last(F.coalesce("mark", F.lit(""))).over(lines_before))
    )
    label = (
        F.when(F.col("mark").isNotNull(), F.col("mark"))
        .when(F.col("before") == "ECHO", "ECHO_OUT")
        .when(F.col("inside"), F.when(F.col("traced"), "SHELL_CMD").otherwise("SHELL_OUT"))
    )
    return out.withColumn("label", label).drop("mark", "traced", "inside", "before")


# ---- stages -----------------------------------------------------------------------------------

def stage_label(fragment: Column) -> Column:
    """Stage name inside a marker: first to last bracket when braces are there, else bare brackets."""
    t = X.strip(fragment)
    inner = X.strip(F.regexp_extract(t, r"\((.*)\)", 1))
    bare = F.when(t.startswith("(") & t.endswith(")") & (F.length(t) >= 2), X.strip(F.regexp_extract(t, r"^\((.*)\)$", 1))).otherwise(t)
    return F.when(t.contains("{") & t.contains("(") & (inner != ""), inner).otherwise(bare)


def with_label(marks: DataFrame) -> DataFrame:
    """Adds to a pipeline marker's `tail` the stage name that it may hold after a header (`label`, NULL if it can hold none) and
    the one of its bracket form (`legacy`). Each part is worked out once and patterns run only where their bracket is there."""
    t, rest, is_legacy, name = F.col("_t"), F.col("_rest"), F.col("_legacy"), F.col("_name")
    marks = marks.withColumn("_t", X.strip(F.col("tail")))
    marks = marks.withColumn("_rest", X.strip(F.regexp_extract(t, r"(?i)^\[Pipeline\]\s*(.*)$", 1)))
    marks = marks.withColumn("_legacy", t.contains("(") & t.rlike(LEGACY_STAGE))
    marks = marks.withColumn("_name", stage_label(F.when(is_legacy, F.regexp_extract(t, LEGACY_STAGE, 1)).otherwise(rest)))
    word = F.lower(F.regexp_extract(rest, r"^(\S+)", 1))
    label = F.when((rest != "") & ~rest.startswith("//") & ~word.isin(*NOT_A_LABEL), F.nullif(name, F.lit("")))
    return marks.withColumn("label", label).withColumn("legacy", F.when(is_legacy, name)).drop("_t", "_rest", "_legacy", "_name")


def stage_markers(lines: DataFrame) -> DataFrame:
    """Stage starts: a header with a name on one of the next seven lines, or a lone bracket form."""
    tail = F.rtrim(F.substr(F.col("line"), F.instr("line", "[Pipeline]")))
    may_end = F.lower("tail").contains("stage")
    marks = (
        lines.filter(F.col("line").contains("[Pipeline]"))
        .select("build_id", "line_no", *layout(lines), tail.alias("tail"))
        .withColumn("is_header", may_end & F.col("tail").rlike(STAGE_HEADER))
        .withColumn("is_stop", F.col("is_header") | (may_end & F.col("tail").rlike(STAGE_END)))
    )
    marks = with_label(marks).drop("tail")
    long = has_long(lines)
    marks = scan(marks, {"after_header": ("last", F.col("is_header"), False)}, long=long, keep=True)
    ahead = near().rangeBetween(1, 7)
    # without a border to look over, the window takes the rows as the scan left them
    halo = with_halo(marks.drop("_b"), 0, 7) if long else marks.withColumnRenamed("_b", "_chunk").withColumn("_own", F.lit(True))
    seen = (
        halo
        .withColumn("stop_at", F.min(F.when(F.col("is_stop"), F.col("line_no"))).over(ahead))
        .withColumn(
            "name_at",
            F.min(F.when(F.col("label").isNotNull() & ~F.col("is_stop"), F.struct("line_no", "label"))).over(ahead),
        )
    )
    found = own(seen)
    named = F.col("name_at.line_no") < F.coalesce(F.col("stop_at"), F.lit(1 << 62))
    name = F.when(F.col("is_header"), F.when(named, F.col("name_at.label"))).when(
        ~F.coalesce("after_header", F.lit(False)), F.nullif("legacy", F.lit(""))
    )
    return (
        found.withColumn("stage", name)
        .filter("stage is not null")
        .select("build_id", "line_no", "stage", F.when(F.col("is_header"), "declared").otherwise("legacy").alias("form"))
    )


def stage_sequence(markers: DataFrame, long: bool | None = None) -> DataFrame:
    """Stage order per build; a repeated name is dropped only in the bracket form. `long` as in `scan`."""
    long = has_long(markers) if long is None else long
    seen = scan(markers, {"prev_stage": ("last", F.col("stage"), False)}, long=long, keep=True)
    kept = seen.filter((F.col("form") == "declared") | F.col("prev_stage").isNull() | (F.col("prev_stage") != F.col("stage")))
    return scan(kept, {"ord": ("sum", F.lit(1).cast("long"), True)}, long=long).select("build_id", "ord", "stage", "line_no")


def last_stage(markers: DataFrame) -> DataFrame:
    return markers.groupBy("build_id").agg(
        F.max_by("stage", "line_no").alias("last_stage"), F.max("line_no").alias("last_stage_line")
    )


def place_lines(lines: DataFrame, long: bool | None = None) -> DataFrame:
    """Stage and node of each line: the last marker at or before it. `long` as in `scan`."""
    line = F.col("line")
    specs = {
        "_s1": ("last", X.extract(line, STAGE_LABEL), True),
        "_s2": ("last", X.extract(line, STAGE_CALL), True),
    }
    specs |= {f"_n{i}": ("last", X.extract(line, p), True) for i, p in enumerate(NODE_FORMS)}
    out = scan(lines, specs, long=long)
    return (
        out.withColumn("stage", F.coalesce("_s1", "_s2"))
        .withColumn("node", F.coalesce("_n0", "_n1", "_n2"))
        .drop(*specs)
    )


def line_count(lines: DataFrame, keys=("build_id",)) -> DataFrame:
    return lines.groupBy(*keys).agg(F.max("line_no").alias("n_lines"))


def called_method(line: Column) -> Column:
    """Method whose start the line reports, in the two forms used by stage parsing."""
    return F.coalesce(X.extract(line, METHOD_PAIR), X.extract(line, METHOD_STARTING))


def stage_spans(lines: DataFrame) -> DataFrame:
    """Stages with first and last line, number of methods started and the last of them."""
    line = F.col("line")
    marks = (
        lines.withColumn("stage", X.extract(line, STAGE_LABEL))
        .withColumn("method", F.when(F.col("stage").isNull(), called_method(line)))
    )
    marks = scan(marks, {"start_line": ("last", F.when(F.col("stage").isNotNull(), F.col("line_no")), True)})
    # every line carries its stage start, so a stage is an aggregate over (build, start)
    return (
        marks.filter("start_line is not null")
        .groupBy("build_id", "start_line")
        .agg(
            F.max(F.when(F.col("stage").isNotNull(), F.col("stage"))).alias("stage"),
            F.max("line_no").alias("end_line"),
            F.count("method").alias("methods"),
            F.max_by("method", F.when(F.col("method").isNotNull(), F.col("line_no"))).alias("last_method"),
        )
    )


FAILURE_WORDS = r"error|exception|failed|failure"


def failed_stage(lines: DataFrame) -> DataFrame:
    """Stage around the last failing line; the last stage if that line is in none."""
    low = F.lower("line")
    bad = lines.groupBy("build_id").agg(
        F.max(F.when(low.rlike(FAILURE_WORDS) & ~low.contains("error=") & ~low.contains("onerror"), F.col("line_no"))).alias("error_line")
    )
    spans = stage_spans(lines).join(bad, "build_id", "left")
    inside = F.col("error_line").between(F.col("start_line"), F.col("end_line"))
    order = F.struct(F.coalesce(inside, F.lit(False)), F.col("start_line"))
    return spans.groupBy("build_id").agg(
        F.max_by("stage", order).alias("failed_stage"),
        F.max_by("start_line", order).alias("start_line"),
        F.max_by(F.when(inside, F.col("last_method")), order).alias("failed_method"),
        F.coalesce(F.max(inside), F.lit(False)).alias("contains_error"),
    )


# Forms that name a failing stage, first form with a hit wins.
FAILED_STAGE_FORMS = (
    r"\[Pipeline\]\s*\{\s*\(([^)]+)\)",
    r"Stage\s*['\"]([^'\"]+)['\"].*(?:FAILED|ERROR)",
    r">>>.*stage:\s*(\w+)",
    r"\[([A-Z][a-zA-Z\s]+)\]\s*(?:FAILED|ERROR)",
)


def failed_stage_by_form(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    found = [X.extract(line, p) for p in FAILED_STAGE_FORMS]
    return (
        lines.groupBy("build_id")
        .agg(*[F.max_by(f, F.when(f.isNotNull(), F.col("line_no"))).alias(f"f{i}") for i, f in enumerate(found)])
        .select("build_id", F.coalesce(*[f"f{i}" for i in range(len(found))]).alias("stage"))
        .filter("stage is not null")
    )


def build_facts(lines: DataFrame) -> DataFrame:
    """Per build: line count and last stage."""
    return line_count(lines).join(last_stage(stage_markers(lines)), "build_id", "left")


def focus_facts(lines: DataFrame, tail: int = 500, facts: DataFrame | None = None) -> DataFrame:
    """Per build: line count, last stage and the first line worth searching. `facts` are the `build_facts`, if the caller has them."""
    return (
        (build_facts(lines) if facts is None else facts)
        .withColumn("focus_from", F.coalesce("last_stage_line", F.greatest(F.col("n_lines") - tail + 1, F.lit(1))))
    )


def focus_section(lines: DataFrame, tail: int = 500, rows: DataFrame | None = None) -> DataFrame:
    """Lines from the last stage on, or the last `tail` lines of a build without stages. `rows` are those of the lines that the
    caller can use (all, if not given); only they are joined to the facts."""
    out = attach_facts(lines if rows is None else rows, focus_facts(lines, tail))
    return out.filter(F.col("line_no") >= F.col("focus_from"))


def sample_lines(lines: DataFrame, n: int, from_end: bool = False) -> DataFrame:
    if not from_end:
        return lines.filter(F.col("line_no") <= n)
    keys = whole_keys(lines)
    if layout(lines) and keys != BUILD:  # a chunk holds the build, and a window its lines as they lie
        sized = lines.withColumn("n_lines", F.max("line_no").over(W.partitionBy(*keys)))
    else:
        sized = attach_facts(lines, line_count(lines), keep=True)
    return sized.filter(F.col("line_no") > F.col("n_lines") - n).drop("n_lines")


# ---- methods ----------------------------------------------------------------------------------

def method_events(lines: DataFrame, prefix: str | None = None) -> DataFrame:
    """Starts and finishes of methods, by configured prefix or by the repeated-name form."""
    t = X.strip(F.col("line"))
    if prefix:
        started = X.strip(X.extract(t, r"(?i)\Q" + prefix + r"\E:\s*(.+)$"))
        started = F.when(~started.startswith("Finished"), started)
    else:
        started = X.strip(X.extract(t, METHOD_REPEAT))
    finished = X.strip(X.extract(t, METHOD_FINISH))
    return (
        lines.withColumn("started", started)
        .withColumn("finished", F.when(F.col("started").isNull(), finished))
        .filter("started is not null or finished is not null")
        .select(
            "build_id", "line_no",
            F.when(F.col("started").isNotNull(), "start").otherwise("finish").alias("event"),
            F.coalesce("started", "finished").alias("method"),
        )
        .withColumn("method_key", X.method_key(F.col("method")))
    )


def method_states(events: DataFrame) -> DataFrame:
    """Every method start with whether the same method ever finished in the build."""
    done = events.filter("event = 'finish'").select("build_id", "method_key").distinct().withColumn("done", F.lit(True))
    return (
        events.filter("event = 'start'")
        .join(done, ["build_id", "method_key"], "left")
        .select("build_id", "line_no", "method", "method_key", F.coalesce("done", F.lit(False)).alias("finished"))
    )


def failed_method(events: DataFrame) -> DataFrame:
    """Last start that never finished, else the last start."""
    order = F.struct(~F.col("finished"), F.col("line_no"))
    return method_states(events).groupBy("build_id").agg(
        F.max_by("method", order).alias("failed_method"),
        F.count_if(~F.col("finished")).alias("active"),
        F.count("*").alias("started"),
    )


# ---- commands ---------------------------------------------------------------------------------

def exit_number(line: Column, last_form_wins: bool = False) -> Column:
    forms = tuple(reversed(shell.EXIT_CODES)) if last_form_wins else shell.EXIT_CODES
    return X.first_number(line, forms)


def owned_lines(
    typed: DataFrame, closing=("pipeline_step", "pipeline_stage", "pipeline_echo"), loose: bool = True, keys=("build_id",), long: bool | None = None
) -> DataFrame:
    """Each line with the line number of the command it belongs to (0 or NULL for none), and the output lines of that command so far."""
    line, kind = F.col("line"), F.col("line_type")
    cmd = F.when(kind == "shell_command", X.shell_command(line))
    if loose:
        cmd = cmd.when(kind == "other", F.coalesce(X.shell_command(line), X.continued_command(line)))
    marked = typed.withColumn("command", cmd)
    edge = F.when(F.col("command").isNotNull(), F.col("line_no")).when(kind.isin(*closing), F.lit(0).cast("long"))
    is_output = F.when(kind == "shell_output", 1).otherwise(0)
    counted = scan(marked, {"owner": ("last", edge, True), "_outputs": ("sum", is_output, True)}, keys=keys, long=long, keep=True)
    # the lines of a command follow it without a gap, so its output is numbered from the count at the command itself
    upto = F.when(F.col("command").isNotNull(), F.col("_outputs"))
    numbered = scan(counted, {"_at_command": ("last", upto, True)}, keys=keys, long=long)
    return numbered.withColumn("out_no", F.col("_outputs") - F.col("_at_command")).drop("_outputs", "_at_command")


def command_output(owned: DataFrame, keys=("build_id",)) -> DataFrame:
    """All output lines of each command, numbered."""
    return owned.filter((F.col("line_type") == "shell_output") & (F.col("owner") > 0)).select(
        *keys, F.col("owner").alias("cmd_line"), "line_no", X.strip(F.col("line")).alias("output"), "out_no"
    )


BLAME_SIGNS = "|".join(s.replace("[", r"\[").replace("]", r"\]") for s in shell.BLAME_SIGNALS)
FINAL_SIGNS = "|".join(shell.FINAL_EXIT_SIGNALS)


def output_summary(outputs: DataFrame, keys=("build_id",), first_form: bool = False) -> DataFrame:
    """One row per command with what its output tells; only counts and flags, no text lists."""
    o = F.col("output")
    code = exit_number(o, last_form_wins=not first_form)
    return (
        outputs.withColumn("_code", code)
        .groupBy(*keys, "cmd_line")
        .agg(
            F.count("*").alias("n_out"),
            F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("out_no"))).alias("exit_code"),
            F.count_if(F.lower(o).rlike(BLAME_SIGNS)).alias("signals"),
            F.max(F.when(o.rlike(shell.EXIT_LINE), F.col("out_no"))).alias("exit_line_at"),
            F.max(o.rlike(X.any_of(shell.OUTPUT_FAILURE))).alias("output_failed"),
            F.max(o.rlike(FINAL_SIGNS)).alias("final_sign"),
        )
    )


def shell_invocations(owned: DataFrame) -> DataFrame:
    heads = owned.filter("command is not null").select("build_id", F.col("line_no").alias("cmd_line"), "command")
    return (
        heads.join(output_summary(command_output(owned)), ["build_id", "cmd_line"], "left")
        .withColumn("tool", X.tool_name(F.col("command")))
        .withColumn("form", F.lit("shell"))
    )


def tool_line(line: Column, rules=shell.TOOL_LINES) -> tuple[Column, Column]:
    """Tool and command of a line in one of the known tool forms."""
    tool = X.first_match(line, [(p, t) for t, p in rules], ignore_case=True)
    command = X.strip(F.coalesce(*[X.extract(line, "(?i)" + p) for _, p in rules]))
    return tool, command


def command_lines(lines: DataFrame, prefix: str | None = None, rules=shell.TOOL_LINES) -> DataFrame:
    """The lines that matter for commands: traced commands, their output, tool lines and exit codes."""
    long = has_long(lines)
    owned = owned_lines(typed_lines(lines, prefix, long=long, keep=True), long=long)
    free = (F.col("line_type") == "other") & F.col("command").isNull()
    output = (F.col("line_type") == "shell_output") & (F.col("owner") > 0)
    return (
        owned.withColumn("tool_form", F.when(free, tool_line(F.col("line"), rules)[0]))
        .withColumn("code", exit_number(F.col("line")))
        .filter(F.col("command").isNotNull() | output | F.col("tool_form").isNotNull() | F.col("code").isNotNull())
        .drop("in_sh")
    )


def known_tool_lines(cmd_lines: DataFrame, rules=shell.TOOL_LINES) -> DataFrame:
    """Tool commands outside shell steps, with the first exit code on the next ten lines."""
    few = cmd_lines.filter("tool_form is not null or code is not null").select("build_id", "line_no", "line", "tool_form", "code")
    after = F.min(F.when(F.col("code").isNotNull(), F.struct("line_no", "code"))).over(near().rangeBetween(1, 10))
    return (
        own(with_halo(few, 0, 10).withColumn("exit_code", after["code"]))
        .filter("tool_form is not null")
        .select(
            "build_id", F.col("line_no").alias("cmd_line"), tool_line(F.col("line"), rules)[1].alias("command"), "exit_code",
            F.col("tool_form").alias("tool"), F.lit("tool").alias("form"),
        )
    )


def invocations_of(cmd_lines: DataFrame, rules=shell.TOOL_LINES) -> DataFrame:
    return with_defaults(
        shell_invocations(cmd_lines).unionByName(known_tool_lines(cmd_lines, rules), allowMissingColumns=True)
    )


def invocations(lines: DataFrame, prefix: str | None = None, rules=shell.TOOL_LINES, cut=lambda df: df) -> DataFrame:
    """All commands of all builds: traced commands with their output, and known tool lines.

    `cut` may store the command lines, which three branches read.
    """
    return invocations_of(cut(command_lines(lines, prefix, rules)), rules)


def with_defaults(invocations: DataFrame) -> DataFrame:
    """Commands without output get zero counts and unset flags."""
    return invocations.na.fill({"n_out": 0, "signals": 0, "output_failed": False, "final_sign": False})


def step_status(exit_code: Column, failed: Column) -> Column:
    return (
        F.when(exit_code == 0, "success").when(exit_code.isNotNull(), "failed")
        .when(failed, "failed").otherwise("unknown")
    )


def method_window(lines: DataFrame, prefix: str) -> DataFrame:
    """Lines between the last start of the failed method and its first finish tag."""
    failed = failed_method(method_events(lines, prefix)).select("build_id", "failed_method")
    tagged = lines.filter(F.col("line").contains(prefix + ": "))
    f = tagged.join(failed, "build_id")
    begins = F.col("line").contains(F.concat(F.lit(prefix + ": "), F.col("failed_method"))) & ~F.col("line").contains("Finished")
    ends = F.col("line").contains(F.concat(F.lit(prefix + ": Finished "), F.col("failed_method")))
    f = f.withColumn("begins", begins).withColumn("ends", ends & ~begins)
    stop = f.groupBy("build_id").agg(F.min(F.when(F.col("ends"), F.col("line_no"))).alias("end_line"))
    start = (
        f.filter("begins").join(stop, "build_id")
        .filter("end_line is null or line_no < end_line")
        .groupBy("build_id", "failed_method", "end_line").agg(F.max("line_no").alias("start_line"))
    )
    facts = start.join(line_count(lines), "build_id").withColumn("end_line", F.coalesce("end_line", "n_lines"))
    return attach_facts(lines, facts).filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))


def method_trace(lines: DataFrame, prefix: str) -> DataFrame:
    """Commands run by the failed method, their status and which of them failed first."""
    window = method_window(lines, prefix).select("build_id", "line_no", "line", "failed_method")
    long = has_long(lines)
    owned = owned_lines(typed_lines(window, prefix, long=long, keep=True), closing=("pipeline_step", "pipeline_stage"), loose=False, long=long)
    out = output_summary(command_output(owned), first_form=True)
    steps = (
        owned.filter("command is not null")
        .select("build_id", F.col("line_no").alias("cmd_line"), "command", "failed_method")
        .join(out, ["build_id", "cmd_line"], "left")
        .withColumn("tool", X.tool_name(F.col("command")))
        .withColumn("status", step_status(F.col("exit_code"), F.coalesce("output_failed", F.lit(False))))
    )
    first = steps.filter("status = 'failed'").groupBy("build_id").agg(F.min("cmd_line").alias("first_failed"))
    return steps.join(first, "build_id", "left").select(
        "build_id", "failed_method", "cmd_line", "command", "tool", "exit_code", "status",
        (F.col("cmd_line") == F.col("first_failed")).alias("is_failure_point"),
    )


# Command starts whose output is kept as context.
CONTEXT_COMMANDS = tuple(
    rf"^\+?\s*({t}\s+\S+)"
    for t in ("aws", "az", "gcloud", "kubectl", "helm", "terraform", "docker", "npm", "yarn", "mvn", "gradle", "pip")
) + (r"^\+\s+(.+)", r"^\[INFO\]\s+Executing:\s+(.+)", r"^Running:\s+(.+)", r"^Executing:\s+(.+)")
CONTEXT_ERRORS = (
    r"(?i)error[:\s]", r"(?i)failed", r"(?i)exception", r"(?i)denied", r"(?i)forbidden", r"(?i)not found",
    r"(?i)unauthorized", r"(?i)invalid", r"(?i)missing", r"(?i)unable to", r"(?i)cannot", r"(?i)could not",
    r"\b4\d{2}\b", r"\b5\d{2}\b",
)
COMMANDS_RUN = (r"^\+\s*(.+)$", r"^\[.*?\]\s*\$\s*(.+)$", r"^>\s*(.+)$", r"(?i)Running:\s*(.+)$", r"(?i)Executing:\s*(.+)$")


def commands_executed(lines: DataFrame) -> DataFrame:
    cmd = X.strip(F.coalesce(*[X.extract(F.col("line"), p) for p in COMMANDS_RUN]))
    return lines.withColumn("command", cmd).filter(F.length("command") > 5).select("build_id", "line_no", "command")


# ---- stages in time ---------------------------------------------------------------------------

def execution_path(lines: DataFrame, chars: int = 5000) -> DataFrame:
    """Stage markers with the outcome shown in the next 5000 characters.

    Positions in characters are a running total; the next failing or passing line is the nearest mark
    after the stage, so each stage needs one value from a reverse scan and no pairs of lines.
    """
    line = F.col("line")
    bad, good = line.rlike("ERROR|FAILURE|FAILED"), line.rlike("SUCCESS|PASSED")
    marked = scan(
        lines.withColumn("stage", F.nullif(F.regexp_extract(line, STAGE_LABEL, 1), F.lit(""))),
        {"upto": ("sum", (F.length(line) + 1).cast("long"), True)},
    )
    few = marked.withColumn("bad", bad).withColumn("good", good).filter("stage is not null or bad or good")
    ahead = scan(
        few,
        {"bad_at": ("last", F.when(F.col("bad"), F.col("upto")), False), "good_at": ("last", F.when(F.col("good"), F.col("upto")), False)},
        reverse=True,
    )
    limit = F.col("upto") + chars
    status = F.when(F.col("bad_at") <= limit, "FAILURE").when(F.col("good_at") <= limit, "SUCCESS").otherwise("UNKNOWN")
    return ahead.filter("stage is not null").select("build_id", "line_no", "stage", status.alias("status"))


def stage_durations(lines: DataFrame) -> DataFrame:
    """Seconds between the first and last stamped line of each stage."""
    from faultline.operators.lines import clock_seconds

    label = F.nullif(F.regexp_extract("line", STAGE_LABEL, 1), F.lit(""))
    placed = scan(
        lines.withColumn("label", label).withColumn("sec", clock_seconds(F.col("line"))).filter("label is not null or sec is not null"),
        {
            "start_line": ("last", F.when(F.col("label").isNotNull(), F.col("line_no")), True),
            "stage": ("last", F.col("label"), True),
        },
    )
    return placed.filter("stage is not null and sec is not null").groupBy("build_id", "start_line", "stage").agg(
        (F.max("sec") - F.min("sec")).alias("seconds"), F.count("sec").alias("stamps")
    )
