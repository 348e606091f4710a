"""Shell steps of pipeline code, read as tokens: the commands in them, with line, enclosing method and variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X

# Tools looked for in shell steps.
SHELL_TOOLS = (
    "aws", "az", "gcloud", "kubectl", "helm", "docker", "terraform", "mvn", "mvnw", "gradle", "gradlew", "npm", "yarn", "pip", "pip3", "curl", "wget",
    "git", "make", "python", "python3", "java", "node", "ansible", "ansible-playbook", "packer", "vault",
)

STRING = r"""(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')"""
#: sh 'x', sh("x"), shell("x"), sh script: 'x', sh(returnStdout: true, script: 'x'); the text is the last string.
STEP_HEAD = rf"(?:shell|sh)\s*\(?\s*(?:\w+\s*:\s*(?:\w+|{STRING})\s*,\s*)*(?:script\s*:\s*)?"
STEP = rf"{STEP_HEAD}{STRING}"
METHOD = r"def\s+\w+\s*\("
#: Groovy text as tokens; comments and strings come whole, so that what stands in them is neither step nor bracket.
TOKEN = rf"//[^\n]*|/\*[\s\S]*?\*/|{STEP}|{STRING}|{METHOD}|[\w.$]+|[{{}}]|[^\w.$\"'/{{}}]+|[\s\S]"
GLOBAL_FILE = r"(?:^|[/\\])vars[/\\](\w+)\.groovy$"

#: What stands between brackets, with brackets in it up to two deep.
IN_BRACKETS = r"[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*"
INSERTED = rf"\$\({IN_BRACKETS}\)|`[^`]*`"
#: Shell text as tokens: insertions and quoted texts whole, then signs that end a command, then the rest.
SHELL_TOKEN = rf"{INSERTED}|'[^'\n]*'|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|>&|&>|\|\||&&|[;|&\n]|[^;|&\n`$'\">]+|[\s\S]"
ENDS = ("||", "&&", ";", "|", "&", "\n")
GOES_ON = r"\\\r?\n\s*"
COMMENT = r"(?m)^[ \t]*#.*$"
VARIABLE = r"\$\{?(\w+)\}?"
#: How deep insertions in insertions are read.
NESTED = 3


def shell_steps(sources: DataFrame) -> DataFrame:
    """One row per shell step: repo, file_id, path, src_line, method, body.

    The file is a fold over its tokens with the line, the depth of curly brackets and the method that is open. A
    method ends with the bracket that its body began with; closures only move the depth. `call` of a file of global
    functions goes by the file's name. Files without content have no steps.
    """
    kind = "struct<line:bigint,depth:int,method:string,floor:int,steps:array<struct<src_line:bigint,method:string,step:string>>>"
    start = F.from_json(F.lit('{"line":1,"depth":0,"floor":0,"steps":[]}'), kind)

    def step(state, token):
        opened = F.regexp_extract(token, r"^def\s+(\w+)\s*\($", 1)
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        ends = (token == "}") & (depth <= state["floor"])
        found = F.struct(state["line"].alias("src_line"), state["method"].alias("method"), token.alias("step"))
        return F.struct(
            (state["line"] + F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))).cast("bigint").alias("line"),
            depth.cast("int").alias("depth"),
            F.when(opened != "", opened).when(~ends, state["method"]).alias("method"),
            F.when(opened != "", depth).otherwise(state["floor"]).cast("int").alias("floor"),
            F.when(token.rlike(rf"^{STEP}$"), F.concat(state["steps"], F.array(found))).otherwise(state["steps"]).alias("steps"),
        )

    tokens = F.regexp_extract_all(F.col("content"), F.lit(TOKEN), F.lit(0))
    rows = sources.select("repo", "file_id", "path", F.inline(F.aggregate(tokens, start, step)["steps"]))
    file_name = F.regexp_extract("path", GLOBAL_FILE, 1)
    quoted = F.regexp_replace("step", rf"^{STEP_HEAD}", "")
    body = F.when(quoted.rlike(r"^(\"\"\"|''')"), F.substring(quoted, F.lit(4), F.length(quoted) - 6)).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )
    return rows.select(
        "repo", "file_id", "path", "src_line",
        F.when((F.col("method") == "call") & (file_name != ""), file_name).otherwise(F.col("method")).alias("method"), body.alias("body"),
    )


def command_parts(body: Column) -> Column:
    """Commands of a shell text: cut at line ends and separators outside quotes and insertions, without comment lines.

    A line that ends with a backslash goes on in the next one.
    """
    joined = F.regexp_replace(F.regexp_replace(body, GOES_ON, " "), COMMENT, "")
    tokens = F.regexp_extract_all(joined, F.lit(SHELL_TOKEN), F.lit(0))
    cut = F.transform(tokens, lambda t: F.when(t.isin(*ENDS), "\n").otherwise(F.replace(t, F.lit("\n"), F.lit(" "))))
    return F.filter(F.transform(F.split(F.array_join(cut, ""), "\n"), lambda p: X.strip(p)), lambda p: p != "")


def with_inserted(body: Column) -> Column:
    """The shell text and the texts inserted in it by $(...) and backticks, and those in them."""
    inside = lambda c: F.transform(
        F.regexp_extract_all(c, F.lit(INSERTED), F.lit(0)),
        lambda t: F.when(t.startswith("`"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.substring(t, F.lit(3), F.length(t) - 3)),
    )
    level, every = F.array(body), F.array(body)
    for _ in range(NESTED):
        level = F.flatten(F.transform(level, inside))
        every = F.concat(every, level)
    return every


def source_tool_usage(sources: DataFrame) -> DataFrame:
    """Commands inside shell steps with the tool they start with: repo, file_id, path, src_line, method, command, tool, variables.

    src_line is the line of the step. variables are those of the whole step, sorted. Commands of other tools are left
    out; a command that a step holds twice comes twice.
    """
    steps = shell_steps(sources).withColumn("variables", F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(VARIABLE), F.lit(1)))))
    texts = steps.withColumn("text", F.explode(with_inserted(F.col("body"))))
    rows = texts.withColumn("command", F.explode(command_parts(F.col("text")))).withColumn("tool", F.lower(X.tool_name(F.col("command"))))
    return rows.filter(F.col("tool").isin(*SHELL_TOOLS)).select("repo", "file_id", "path", "src_line", "method", "command", "tool", "variables")
