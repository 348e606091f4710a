"""Shell steps of pipeline code on literal sources."""

import pytest

from faultline.operators import steps

DEPLOY = r'''// sh 'git comment'
/* sh "git
 block" */
def call(Map config) {
  def out = sh(returnStdout: true, label: 'a, b', script: "kubectl get -n $(cat ns | helm list) pods").trim()
  dir('x') {
    sh """
      # aws in a comment
      export A=1
      docker build -t ${IMAGE} \
        --pull . && ./mvnw -q verify
      echo 'a | aws b' ; VER=`git describe $(make -s version)`
    """
  }
  log.info("sh 'npm ci'")
}
def other() { shell('curl -s "http://h/a;b" 2>&1 | /usr/bin/python3 -') }
sh "terraform apply \"$HOME/x\""
flash 'yarn'
sh script: \'\'\'pip3 install a
Vault status\'\'\'
'''.replace(r"\'", "'")


@pytest.fixture(scope="module")
def used(spark):
    rows = [(1, 1, "vars/deploy.groovy", DEPLOY), (1, 2, "Jenkinsfile", None), (1, 3, "a.groovy", ""), (1, 4, "b.groovy", 'sh "unclosed\nsh \'\'\'open'), (1, 5, "c.groovy", "def call() { sh 'git x' }")]
    return steps.source_tool_usage(spark.createDataFrame(rows, "repo long, file_id long, path string, content string")).collect()


def test_every_form_of_a_step_is_read(used):
    got = sorted((r.src_line, r.method, r.tool, r.command) for r in used if r.file_id == 1 and r.method)
    assert got == sorted([
        (5, "deploy", "kubectl", "kubectl get -n $(cat ns | helm list) pods"), (5, "deploy", "helm", "helm list"),
        (7, "deploy", "docker", "docker build -t ${IMAGE}  --pull ."), (7, "deploy", "mvnw", "./mvnw -q verify"),
        (7, "deploy", "git", "git describe $(make -s version)"), (7, "deploy", "make", "make -s version"),
        (17, "other", "curl", 'curl -s "http://h/a;b" 2>&1'), (17, "other", "python3", "/usr/bin/python3 -"),
    ])


def test_steps_outside_of_methods(used):
    got = sorted((r.src_line, r.tool, r.command, r.variables) for r in used if r.file_id == 1 and r.method is None)
    assert got == [(18, "terraform", 'terraform apply \\"$HOME/x\\"', ["HOME"]), (20, "pip3", "pip3 install a", []), (20, "vault", "Vault status", [])]


def test_variables_of_the_step(used):
    assert {tuple(r.variables) for r in used if r.src_line == 7} == {("IMAGE",)}


def test_empty_open_and_plain_files(used):
    assert [(r.file_id, r.method, r.command) for r in used if r.file_id > 1] == [(5, "call", "git x")]


def test_long_files(spark):
    code = "def call() {\n" + "\n".join(f"  x{i}('a') {{ y }}\n  sh 'git fetch {i}'" for i in range(3000)) + "\n" + 'sh "echo ' + 'a\\\\"b ' * 3000 + '"\n}'
    got = steps.source_tool_usage(spark.createDataFrame([(1, 1, "vars/a.groovy", code)], "repo long, file_id long, path string, content string")).collect()
    assert len(got) == 3000 and {r.method for r in got} == {"a"} and max(r.src_line for r in got) == 6001
