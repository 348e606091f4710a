"""Stack traces: headers, frames, and whose code a frame is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import has_long, layout, scan, top_per
from faultline.operators import errors as E

AT_FRAME = r"^\s+at\s+.*"
JAVA_FRAME = r"\s+at\s+([\w.$<>]+)\(([^)]+)\)"
JS_FRAME = r"\s+at\s+(?:([\w.]+)\s+)?\(?([^)\s]+)\)?"
PY_FRAME = r"\s+File \"([^\"]+)\", line (\d+), in (\w+)"
JAVA_HEAD = r"([\w.]+(?:Exception|Error|Throwable)):\s*(.*)"
GROOVY_HEAD = (
    r"(groovy\.lang\.\w+(?:Exception|Error)|org\.jenkinsci\.plugins\.scriptsecurity\.\w+"
    r"|org\.codehaus\.groovy\.\w+(?:Exception|Error)):\s*(.*)"
)
CPS_HEAD = r"(?i)([\w.]+(?:Exception|Error)).*?(?:CPS|workflow).*?:\s*(.*)"
JS_HEAD = r"(\w+(?:Error|Exception)):\s*(.*)"
HEADS = (("java", JAVA_HEAD), ("groovy", GROOVY_HEAD), ("groovy_cps", CPS_HEAD), ("javascript", JS_HEAD))
PY_START = "Traceback (most recent call last):"
PY_HEAD = r"^(\w+(?:Error|Exception)):\s*(.*)"
FULL_FRAME = r"at\s+([\w.$]+)\.(\w+)\s*\(([^:]+):(\d+)\)"
SHORT_FRAME = r"at\s+([\w.$]+)\.(\w+)\s*\(([^)]+)\)"
LIBRARY_FILE = r"vars/\w+\.groovy|src/[\w/]+\.groovy"
CPS_FRAME = r"\s+at\s+([\w.$]+)\.([\w$<>]+)\(([^)]+)\)"

# Classes of the pipeline machinery and of its steps.
MACHINERY = (
    r"org\.jenkinsci\.plugins\.workflow\.cps\.CpsCallableInvocation", r"org\.jenkinsci\.plugins\.workflow\.cps\.CpsScript",
    r"org\.jenkinsci\.plugins\.workflow\.cps\.CpsThread", r"org\.jenkinsci\.plugins\.workflow\.cps\.CpsFlowExecution",
    r"org\.jenkinsci\.plugins\.workflow\.cps\.DSL", r"org\.jenkinsci\.plugins\.workflow\.cps\.CpsBodyExecution",
    r"com\.cloudbees\.groovy\.cps\.CpsTransformedInvocation", r"com\.cloudbees\.groovy\.cps\.Continuable",
    r"com\.cloudbees\.groovy\.cps\.impl\.", r"sun\.reflect\.", r"java\.lang\.reflect\.",
    r"org\.codehaus\.groovy\.runtime\.callsite\.",
)
STEP_CLASSES = (r"org\.jenkinsci\.plugins\.workflow\.steps\.", r"org\.jenkinsci\.plugins\.pipeline\.", r"hudson\.plugins\.")
# Frames left out of a report, and packages that are not the user's.
HIDDEN_FRAMES = (
    "WorkflowScript", "CpsThread", "CpsVmThread", "groovy.lang", "java.lang", "sun.reflect",
    "org.jenkinsci.plugins.workflow.cps", "com.cloudbees.groovy.cps",
)
FOREIGN_PACKAGES = ("org.", "com.cloudbees", "hudson.", "jenkins.")


def stack_traces(lines: DataFrame) -> DataFrame:
    """Traces of all languages: an exception line and the run of frames at it.

    A frame run is told by the number of the last line that is no frame, which is the header for `at`
    frames; Python's header follows its run.
    """
    line, n = F.col("line"), F.col("line_no")
    long = has_long(lines)
    # runs are told by numbers and marks alone; the texts of possible heads only are shuffled
    run = scan(lines.select("build_id", "line_no", *layout(lines), line.rlike(AT_FRAME).alias("at")), {"head_line": ("last", F.when(~F.col("at"), n), True)}, long=long)
    frames = run.filter(F.col("at") & F.col("head_line").isNotNull()).groupBy("build_id", "head_line").agg(F.count("*").alias("frames"))
    heads = lines.filter(X.maybe_any(line, [p for _, p in HEADS])).select("build_id", n.alias("head_line"), F.col("line").alias("head"))
    at_traces = frames.join(heads, ["build_id", "head_line"]).withColumn(
        "h",
        F.explode(F.array_compact(F.array(*[
            F.when(F.col("head").rlike(p), F.struct(
                F.lit(lang).alias("lang"), F.regexp_extract("head", p, 1).alias("exception"), X.strip(F.regexp_extract("head", p, 2)).alias("message")))
            for lang, p in HEADS
        ]))),
    ).select("build_id", F.col("head_line").alias("line_no"), "h.*", "frames")

    is_start, is_file = line.contains(PY_START), line.rlike(r"^\s+File ")
    # within a Python trace a file line and the code line below it alternate
    marks = lines.select(
        "build_id", "line_no", *layout(lines), is_start.alias("is_start"), is_file.alias("is_file"), line.rlike(r"^\s+\S").alias("inside"), F.when(line.rlike(PY_HEAD), line).alias("head"),
    )
    py = scan(marks, {"trace": ("last", F.when(F.col("is_start"), n), True)}, long=long, keep=True).filter("trace is not null")
    # a trace stops at the first line that is not inside it; a count of those lines tells what lies before it, in the same shuffle
    py = scan(py, {"stops": ("sum", F.when((n > F.col("trace")) & ~F.col("inside"), 1).otherwise(0), True)}, keys=["build_id", "trace"], long=long)
    python = (
        py.filter("stops <= 1").groupBy("build_id", "trace")
        .agg(
            F.min(F.when(F.col("stops") == 1, n)).alias("stop"),
            F.count_if(F.col("is_file") & (F.col("stops") == 0)).alias("frames"),
            F.min_by("head", F.when(F.col("stops") == 1, n)).alias("head"),
        )
        .filter(F.col("head").rlike(PY_HEAD) & (F.col("frames") > 0))
        .select(
            "build_id", F.col("trace").alias("line_no"), F.lit("python").alias("lang"), F.regexp_extract("head", PY_HEAD, 1).alias("exception"),
            X.strip(F.regexp_extract("head", PY_HEAD, 2)).alias("message"), "frames",
        )
    )
    panic = go_panics(lines)
    return at_traces.unionByName(python).unionByName(panic)


def go_panics(lines: DataFrame) -> DataFrame:
    """`panic: message`, an empty line, a goroutine line, then frames up to the next empty line."""
    n, line = F.col("line_no"), F.col("line")
    near = lines.filter(line.rlike("^panic:|panic:|goroutine") | (line == ""))
    seen = scan(
        near,
        {
            "p": ("last", F.when(line.contains("panic:"), n), False),
            "p_text": ("last", F.when(line.contains("panic:"), line), False),
        },
    )
    heads = seen.filter(line.rlike(r"goroutine.*:$") & (n == F.col("p") + 2)).select(
        "build_id", F.col("p").alias("line_no"), n.alias("g"), F.col("p_text")
    )
    blank = scan(
        near.drop("_b").filter(line == "").unionByName(heads.select("build_id", F.col("g").alias("line_no"), F.lit("goroutine").alias("line"))),
        {"next_blank": ("last", F.when(F.col("line") == "", n), False)},
        reverse=True,
    ).filter("line = 'goroutine'").select("build_id", F.col("line_no").alias("g"), "next_blank")
    return (
        heads.join(blank, ["build_id", "g"])
        .filter("next_blank > g + 1")
        .select(
            "build_id", "line_no", F.lit("go").alias("lang"), F.lit("Unknown").alias("exception"),
            X.strip(F.regexp_extract("p_text", r"panic:\s*(.*)", 1)).alias("message"), (F.col("next_blank") - F.col("g") - 1).alias("frames"),
        )
    )


def parse_frames(lines: DataFrame) -> DataFrame:
    """Method and place of every frame line, for the three languages whose frames can be read."""
    line = F.col("line")
    lang = F.when(line.rlike(JAVA_FRAME), "java").when(line.rlike(JS_FRAME), "javascript").when(line.rlike(PY_FRAME), "python")
    return (
        lines.withColumn("lang", lang).filter("lang is not null")
        .select(
            "build_id", "line_no", "lang",
            F.when(F.col("lang") == "java", F.regexp_extract(line, JAVA_FRAME, 1))
            .when(F.col("lang") == "python", F.regexp_extract(line, PY_FRAME, 3))
            .otherwise(F.coalesce(X.extract(line, JS_FRAME, 1), F.lit("anonymous"))).alias("method"),
            F.when(F.col("lang") == "java", F.regexp_extract(line, JAVA_FRAME, 2))
            .when(F.col("lang") == "python", F.concat_ws(":", F.regexp_extract(line, PY_FRAME, 1), F.regexp_extract(line, PY_FRAME, 2)))
            .otherwise(F.regexp_extract(line, JS_FRAME, 2)).alias("location"),
        )
    )


def frames_after(points: DataFrame, lines: DataFrame, reach: int = 49) -> DataFrame:
    """Frames behind an error line, up to the first line that belongs to no trace."""
    near = E.around(points.select("build_id", F.col("line_no").alias("at")), lines, 0, reach).filter("line_no > at")
    t = X.strip(F.col("near_line"))
    frame = t.rlike(FULL_FRAME) | t.rlike(SHORT_FRAME)
    stop = (t != "") & ~frame & ~t.startswith("at ") & ~t.startswith("...") & ~t.contains("Caused by")
    near = near.withColumn("t", t).withColumn("frame", frame)
    first = near.groupBy("build_id", "at").agg(F.min(F.when(stop, F.col("line_no"))).alias("stop"))
    full = F.col("t").rlike(FULL_FRAME)
    pick = lambda g: F.when(full, F.regexp_extract("t", FULL_FRAME, g)).otherwise(F.regexp_extract("t", SHORT_FRAME, g))
    return (
        near.join(first, ["build_id", "at"])
        .filter(F.col("frame") & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))))
        .select(
            "build_id", "at", "line_no", pick(1).alias("class_name"), pick(2).alias("method"), pick(3).alias("file"),
            X.extract(F.col("t"), FULL_FRAME, 4).try_cast("long").alias("src_line"), F.col("t").rlike(LIBRARY_FILE).alias("is_library"),
        )
    )


def decode_cps_frames(lines: DataFrame) -> DataFrame:
    """Frames with flags: pipeline machinery, pipeline step, shared library code."""
    line = F.col("line")
    cls, loc = F.regexp_extract(line, CPS_FRAME, 1), F.regexp_extract(line, CPS_FRAME, 3)
    f = lines.filter(line.rlike(CPS_FRAME)).select(
        "build_id", "line_no", cls.alias("class_name"), F.regexp_extract(line, CPS_FRAME, 2).alias("method"),
        F.coalesce(X.extract(loc, r"^(\S+):\d+"), F.lit("")).alias("file"), X.extract(loc, r"^\S+:(\d+)").try_cast("long").alias("src_line"),
    )
    c = F.col("class_name")
    return (
        f.withColumn("machinery", c.rlike(X.any_of(MACHINERY)))
        .withColumn("is_step", c.rlike(X.any_of(STEP_CLASSES)))
        .withColumn("is_library", c.contains(".vars.") | c.contains("WorkflowScript"))
        .withColumn("library", F.when(F.col("is_library"), X.extract(c, r"([\w-]+)\.vars\.\w+")))
    )


def user_frames(lines: DataFrame) -> DataFrame:
    """Frames worth showing: machinery is dropped, the user's own code is flagged."""
    form = r"at\s+([^\(]+)\(([^:]+):?(\d+)?\)"
    method = F.regexp_extract("line", form, 1)
    hidden, foreign = (X.any_of(s.replace(".", r"\.") for s in names) for names in (HIDDEN_FRAMES, FOREIGN_PACKAGES))
    return (
        lines.filter(F.col("line").rlike(form))
        .select("build_id", "line_no", method.alias("method"), F.regexp_extract("line", form, 2).alias("file"), X.extract(F.col("line"), form, 3).try_cast("long").alias("src_line"))
        .filter(~F.col("method").rlike(hidden))
        .withColumn("is_user_code", ~F.col("method").rlike(foreign))
    )
