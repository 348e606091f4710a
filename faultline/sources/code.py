"""Source files and documentation texts derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.sources.tables import read

# Source files by kind; {k} is the part key, {a} and {b} are keys of other files of the same repository.
SOURCES = (
    ("vars/fn{k}.groovy", "@Library('shared-{k}@v{a}') _\ndef fn{k}(Map config, String name = 'x') {\n  sh 'kubectl apply -f app-{k}.yml && mvn -q verify -pl mod-{k}'\n  fn{a}(config)\n  fn{b}(config, name)\n  usernamePassword(credentialsId: 'CRED-{a}')\n}"),
    ("vars/fn{k}.groovy", "@Library(['core@1.{a}', 'tools']) _\ndef fn{k}(config) {\n  fn{a}(config)\n  runStep{b} { echo 'x' }\n  sh \"npm install pkg-{k}\"\n  string(credentialsId: 'CRED-{k}')\n}"),
    ("src/main/java/org/acme/Cls{k}.java", "package org.acme;\nimport org.acme.Cls{a};\nimport java.util.List;\n@ShellComponent(\"tool{k}\")\npublic class Cls{k} {\n  @ShellMethod(value = \"Deploys\", key = \"deploy-{k}\")\n  public void deploy(@ShellOption(help = \"h\", defaultValue = \"d\") String target) {\n    if (x) throw new AuthException(\"A2L_AUTH_FAILED: token {k} expired\");\n    System.exit(1);\n    String v = System.getenv(\"A2L_TOKEN\");\n    log.error(\"[A2L] failed\");\n  }\n}"),
    ("src/main/java/org/acme/Cls{k}.java", "package org.acme;\nimport org.acme.Cls{a};\nimport org.acme.Cls{b};\n@Command(name = \"cmd{k}\", description = \"runs\") // picocli\npublic class Cls{k} {\n  @Option(names = {\"--env\", \"-e\"}, description = \"env\", required = true)\n  String env;\n  static final String ERROR_CODE_{k} = \"E_{a}\";\n  void go() { throw new NetworkException(\"connect timeout ${HOST_{b}}\"); }\n}"),
    ("Jenkinsfile", "library 'pipeline@{a}'\npipeline {\n  stages {\n    fn{a}(env: 'prod', version: '1')\n    fn{b}(config, 'x', 'y')\n    deploy(env: 'prod', targets: pick(1, 2))\n    deploy config, 'x'\n    deploy {\n    }\n    run{a} 'x', [a: 1, b: 2], true\n    withCredentials([file(credentialsId: 'CRED-{b}')])\n  }\n}"),
    ("vars/deploy.groovy", "def call(Map config, List targets = [1, 2],\n    Closure body = pick(x, {b})) {\n  run{a}(config.name)\n  fn{b}(config, 'x')\n  sh(returnStdout: true, script: \"\"\"\n    # aws in a comment\n    docker build -t ${IMAGE} \\\n      . && ./mvnw -q verify -pl $(git describe v{a} | helm list)\n    kubectl get ns; VER=`make -s v{b}`\n  \"\"\")\n}"),
    ("vars/run{k}.groovy", "def call(String name, Map<String, List> opts) {\n  deploy(name, opts.get(1, 2), null)\n  helper{k}()\n  shell('curl -s \"http://h/{a};x\" | python3 -') // sh 'git gc'\n}\ndef helper{k}(Map args = [:]) {\n  run{a}('y', args)\n}"),
)
REPO_SIZE = 40


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part; the files of REPO_SIZE neighbouring parts form a repository."""
    k = F.col("p_partkey")
    first = F.floor(k / REPO_SIZE) * REPO_SIZE
    a, b = first + (k * 3 + 1) % REPO_SIZE, first + (k * 7 + 2) % REPO_SIZE
    i = (k % len(SOURCES)).cast("int")
    fill = lambda c: F.replace(
        F.replace(F.replace(c, F.lit("{k}"), k.cast("string")), F.lit("{a}"), a.cast("string")), F.lit("{b}"), b.cast("string")
    )
    return read(spark, sf_dir, "part").select(
        F.floor(k / REPO_SIZE).alias("repo"), k.alias("file_id"),
        fill(F.get(F.array(*[F.lit(p) for p, _ in SOURCES]), i)).alias("path"),
        fill(F.get(F.array(*[F.lit(c) for _, c in SOURCES]), i)).alias("content"),
    )


# Parts that make a prose document a documentation page; {k} is the document number.
DOC_FRAME = (
    "# Tool a2l {k}\n\n",
    "\n\n## Usage\n```bash\na2l deploy --cluster prod-{k}\n# note\nkubectl get pods\n```\nUse `npm install pkg-{k}` first.\n\n## Error Codes\n| A2L_AUTH_{k} | token expired |\n| TIMEOUT_ERR | too slow |\n\n## Environment\n- A2L_TOKEN: the token\n\n## Options\n--cluster: name required\n--dry-run: no change\n",
)


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documentation with the whole text of each document as its description."""
    d = read(spark, sf_dir, "documents")
    k = (F.col("doc_id") % 50).cast("string")
    body = F.regexp_replace(F.col("text"), r"\s+", " ")
    content = F.concat(F.replace(F.lit(DOC_FRAME[0]), F.lit("{k}"), k), body, F.replace(F.lit(DOC_FRAME[1]), F.lit("{k}"), k))
    return d.select("doc_id", F.col("source").alias("site"), content.alias("content"))
