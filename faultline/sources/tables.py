"""Logical tables derived from the supplied parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from faultline.rules import templates
from faultline.session import chunk_lines, dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """build_id, line_no (1-based), line: one console log per order."""
    return _chunked_lines(spark, sf_dir).drop("_b")


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines, stored once and dealt by build and chunk (`_b`, which `scan` knows): what is done per chunk shuffles no text."""
    return dealt(_chunked_lines(spark, sf_dir), ["build_id", "_b"], ["build_id", "_b", "line_no"])


def _chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines with their chunk.

    The line number of a fragment is a running total over the order's rows, which are narrow and meet in one ordered
    window. Then the rows are dealt by order and chunk, so the lines of a giant order are made and read in many tasks, while those of
    a chunk lie together and combine before they are shuffled.
    """
    frags = F.array(*[F.lit(t) for t in templates.FRAGMENTS])
    n = len(templates.FRAGMENTS)
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("build_id"),
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        ((F.col("l_orderkey") * templates.SPREAD_ORDER + F.col("l_linenumber") * templates.SPREAD_LINE) % n)
        .cast("int")
        .alias("k"),
    )
    sizes = F.array(*[F.lit(t.count("\n") + 1) for t in templates.FRAGMENTS])
    size = F.get(sizes, F.col("k")).cast("long")
    before = W.partitionBy("build_id").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    # dealt once more, chunk by chunk: a fixed partition count, as line work is heavy on CPU for few bytes, which coalescing by bytes ignores
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = lambda at: F.floor(at / F.lit(chunk_lines(spark))).cast("long")
    chunks = F.sequence(chunk(F.col("start")), chunk(F.col("start") + size - 1))  # a fragment over a border goes to both sides
    placed = placed.select("build_id", "start", "k", "l_partkey", "l_quantity", F.explode(chunks).alias("_b")).repartition(parts, "build_id", "_b")
    text = F.replace(F.get(frags, F.col("k")), F.lit("{p}"), F.col("l_partkey").cast("string"))
    text = F.replace(text, F.lit("{q}"), F.col("l_quantity").cast("long").cast("string"))
    spelled = placed.select("build_id", "_b", "start", F.posexplode(F.split(text, "\n", -1)).alias("step", "line"))
    return spelled.filter(chunk(F.col("start") + F.col("step")) == F.col("_b")).select(
        "build_id", (F.col("start") + F.col("step") + 1).alias("line_no"), "line", "_b"
    )


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: job, status, time and length of the build."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("build_id"),
        F.concat(F.lit("job-"), F.col("o_custkey")).alias("job"),
        F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderstatus") == "F", "FAILURE")
        .when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 7 == 0, "ABORTED").otherwise("SUCCESS"))
        .when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string"))
        .otherwise("UNSTABLE")
        .alias("status"),
        (F.col("o_orderkey") % 11 == 0).alias("building"),
        F.col("o_orderdate").alias("ts"),
        F.floor(F.col("o_totalprice") * 1000).cast("long").alias("duration_ms"),
    )


def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of a console-log search: host, source path, time and raw text."""
    return failure_events_of(read(spark, sf_dir, "events"))


def failure_events_of(e: DataFrame) -> DataFrame:
    """The same for any frame of events, a stream included."""
    src = F.concat(
        F.lit("job/team/job/p"), F.col("user_id"), F.lit("/"), F.col("event_id") % 50, F.lit("/console")
    )
    raw = (
        F.when(
            F.col("event_type") == "error",
            F.when(F.col("event_id") % 3 == 0, "Finished: FAILURE").otherwise(
                F.concat(F.lit("Finished: FAILURE, script returned exit code "), F.col("event_id") % 7)
            ),
        )
        .when(F.col("event_type") == "view", F.concat(F.lit("ERROR: step failed for "), F.col("user_id")))
        .when(F.col("event_type") == "purchase", F.lit("[INFO] Downloading artifact"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Exception: code "), F.floor(F.col("value")).cast("long")))
        .otherwise(F.concat(F.lit("Finished: "), F.when(F.col("event_id") % 2 == 0, "SUCCESS").otherwise("UNSTABLE")))
    )
    return e.select(
        "event_id", F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"), src.alias("src"), "ts", raw.alias("raw")
    )


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human feedback on analyses, from labelled documents."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("error_snippet"),
        F.upper("lang").alias("error_category"),
        F.col("source").alias("failed_stage"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m"), F.col("doc_id") % 5)).alias("failed_method"),
        F.expr("substring(text, 11)").alias("original_root_cause"),
        (F.col("doc_id") % 10 / 10.0).alias("original_confidence"),
        (F.col("quality") == 1).alias("was_correct"),
        F.when(F.col("quality") == 1, F.expr("substring(text, 11)")).otherwise(F.expr("substring(text, 31)")).alias("confirmed_root_cause"),
        F.when(F.col("toxic") == 0, F.expr("substring(text, 101)")).alias("confirmed_fix"),
        F.concat(F.lit("job-"), F.col("doc_id") % 20).alias("job_name"),
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training candidates: a user turn and the assistant turn that follows it."""
    c = read(spark, sf_dir, "conversations")
    ask = c.filter("role = 'user'")
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.element_at(F.array(*[F.lit(s) for s in ("feedback", "knowledge", "review")]), (F.col("conv_id") % 3 + 1).cast("int")).alias("source"),
        F.col("text").alias("error_snippet"),
        F.col("answer").alias("root_cause"),
        F.when(F.col("turn") % 4 == 0, F.col("answer")).otherwise(F.lit("")).alias("fix"),
        F.element_at(
            F.array(*[F.lit(s) for s in ("NETWORK", "TIMEOUT", "BUILD", "WEIRD", "UNKNOWN")]), (F.col("conv_id") % 5 + 1).cast("int")
        ).alias("category"),
        ((F.col("conv_id") % 13) / 10.0).alias("confidence"),
    )


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items with the model's verdict and, for some, the reviewer's own."""
    o = read(spark, sf_dir, "orders")
    reviewed = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("h"), F.col("o_custkey") % 5).alias("host"),
        F.concat(F.lit("job/p"), F.col("o_custkey")).alias("src"),
        F.col("o_orderkey").alias("job_id"),
        F.when(reviewed, "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"),
        F.concat(F.lit("ERROR: order "), F.col("o_orderkey"), F.lit(" failed with "), F.col("o_orderpriority")).alias("error_snippet"),
        F.concat(F.lit("cause "), F.col("o_orderpriority")).alias("ai_root_cause"),
        F.concat(F.lit("fix "), F.col("o_orderpriority")).alias("ai_fix"),
        F.col("o_orderpriority").alias("ai_category"),
        (F.col("o_orderkey") % 101 / 100.0).alias("ai_confidence"),
        F.when(reviewed & (F.col("o_orderkey") % 4 == 0), F.concat(F.lit("real cause "), F.col("o_custkey"))).alias("reviewer_root_cause"),
        F.when(reviewed & (F.col("o_orderkey") % 8 == 0), F.concat(F.lit("real fix "), F.col("o_custkey"))).alias("reviewer_fix"),
        F.col("o_orderdate").alias("created_at"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order; a customer is a repository."""
    o = read(spark, sf_dir, "orders")
    words = ("fix login", "upgrade database", "refactor auth", "docs only", "config update", "merge branch")
    return o.select(
        F.col("o_orderkey").alias("sha"),
        F.col("o_custkey").alias("repo"),
        F.concat(F.lit("dev"), F.col("o_orderkey") % 9).alias("author"),
        F.col("o_orderdate").alias("ts"),
        F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % len(words) + 1).cast("int")).alias("message"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files touched by a commit, one per lineitem row."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    dirs = ("src/main/", "config/", "vars/", "docs/", "Jenkinsfile.d/", "docker/")
    exts = (".java", ".groovy", ".yml", ".py", ".properties")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("sha"),
        F.concat(
            F.element_at(F.array(*[F.lit(d) for d in dirs]), (F.col("p_partkey") % len(dirs) + 1).cast("int")),
            F.lit("f"),
            F.col("p_partkey").cast("string"),
            F.element_at(F.array(*[F.lit(x) for x in exts]), (F.col("p_size") % len(exts) + 1).cast("int")),
        ).alias("path"),
        F.col("l_quantity").cast("long").alias("insertions"),
        F.floor(F.col("l_discount") * 100).cast("long").alias("deletions"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers: an assistant turn wrapped in one of the answer forms that occur."""
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    body = F.regexp_replace("text", r'["\\\n\r\t]', " ")
    form = (F.col("conv_id") + F.col("turn")) % 6
    score = (F.col("conv_id") * 7 + F.col("turn") * 13) % 100
    text = (
        F.when(form == 0, F.concat(F.lit('```json\n{"root_cause": "'), body, F.lit('", "confidence": "'), score, F.lit('%", "is_retriable": "yes", "category": "NETWORK", "fix": "restart agent"}\n```')))
        .when(form == 1, F.concat(F.lit('Sure: {"root_cause": "'), body, F.lit('", "confidence": 0.'), score, F.lit(', "is_retriable": false, "category": "TIMEOUT"}')))
        .when(form == 2, F.concat(F.lit("Root cause: connection refused by "), body, F.lit("\nFix: check the network\nI am fairly confident")))
        .when(form == 3, F.concat(F.lit("- timeout while waiting\n- "), body, F.lit("\nRecommended: increase the timeout")))
        .when(form == 4, F.concat(body, F.lit("\n\nnot retriable, credential missing, permission denied")))
        .otherwise(body)
    )
    return c.select(F.col("conv_id").alias("build_id"), (F.floor(F.col("turn") / 2) + 1).cast("long").alias("iteration"), F.col("turn"), text.alias("raw_text"))


# Fixed values of the derived knowledge base.
TOOL_NAMES = (
    "npm", "a2l", "kubectl", "mvn", "curl", "docker", "helm", "pytest", "printenv", "that", "der", "que", "make", "go", "terraform", "vault",
)
ERROR_RULES = (
    ("A2L_AUTH_FAILED", r"A2L_AUTH\w+", True), ("ERESOLVE", r"npm ERR!.*", True), ("HTTP503", r"HTTP/1.1 50\d", True),
    ("EOOM", r"out\s*of\s*memory", True), ("ROLLOUT", "rollout[", False), ("BADREV", r"any revision", True),
    ("EXIT1", r"exit code [1-9]", True), ("NOPERM", r"permission denied", True), ("NOCRED", "credentials entry", False),
)


def _pick(items, index):
    return F.get(F.array(*[F.lit(i) for i in items]), index.cast("int"))


def tool_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool definitions as several teams wrote them, one per supplier; names repeat."""
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    name = _pick(TOOL_NAMES, key % len(TOOL_NAMES))
    return s.select(
        key.alias("id"), name.alias("name"), _pick(("build", "deploy", "test", "infra"), key % 4).alias("category"),
        F.concat(F.lit("written by "), F.col("s_name"), F.repeat(F.lit("!"), (key % 5).cast("int"))).alias("description"),
        F.when(key % 3 == 0, F.concat(F.lit("https://docs/"), name, F.lit("/"), key)).alias("docs_url"),
        F.concat(F.col("s_name"), F.lit(".md")).alias("source_file"), (key % 10 / 10.0).alias("confidence"),
        F.concat(name, F.lit(" "), _pick(("install", "deploy", "run"), key % 3)).alias("command"),
        F.when(key % 2 == 0, F.concat(F.lit("regex:"), name, F.lit(r"\s+ERR"))).otherwise(F.concat(F.lit("["), name, F.lit("]"))).alias("signature"),
        F.when(key % 5 == 0, F.concat(name, F.lit("-cli"))).alias("alias"),
    )


def tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known errors of tools, one per part; codes repeat."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    n = key % len(ERROR_RULES)
    return p.select(
        key.alias("id"), _pick(TOOL_NAMES, key % len(TOOL_NAMES)).alias("tool"), _pick([r[0] for r in ERROR_RULES], n).alias("code"),
        _pick([r[1] for r in ERROR_RULES], n).alias("pattern"), _pick([r[2] for r in ERROR_RULES], n).alias("is_regex"),
        _pick(("NETWORK", "CREDENTIAL", "BUILD"), key % 3).alias("category"), F.col("p_name").alias("description"),
        F.when(F.col("p_size") % 4 > 0, F.col("p_type")).otherwise("").alias("fix"), (F.col("p_size") % 2 == 0).alias("retriable"),
        (F.lit(0.5) + key % 5 / 10.0).alias("confidence"),
    )


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test results of a build, one per lineitem row."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("build_id"), F.concat(F.lit("suite."), F.col("l_suppkey")).alias("class_name"),
        F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "PASSED").otherwise(
            F.when(F.col("l_linenumber") == 1, "SKIPPED").otherwise("REGRESSION")
        ).alias("status"),
    )
