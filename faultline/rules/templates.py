"""Console-log fragments from which the log table is derived.

The driver supplies no build logs, so every lineitem row becomes one fragment: an order is a build, and
{p} / {q} are the part key and the whole quantity. Both engines use the same text.
"""

FRAGMENTS = (
    "[Pipeline] stage\n[Pipeline] { (Build)\n[Pipeline] sh\n+ npm install pkg-{p}\nnpm ERR! code ERESOLVE\n[Pipeline] }\n[Pipeline] // stage",
    "[Pipeline] stage\n[Pipeline] { (Deploy)\n[Pipeline] sh\n+ a2l deploy --cluster prod-{p}\nA2L_AUTH_FAILED: Authentication token expired\nExit code: 1\n[Pipeline] }\n[Pipeline] // stage",
    "[Pipeline] stage\n[Pipeline] { (Test (QA))\n[Pipeline] sh\n+ pytest tests/t_{p}.py\nFAIL: test_case_{q}\nAssertionError: expected 1\n[Pipeline] }\n[Pipeline] // stage",
    "[Pipeline] stage\n[Pipeline] { (Checkout)\nfatal: Could not find any revision to build\n[Pipeline] // stage",
    "[Pipeline] sh\n+ mvn -q verify -pl mod-{p}\n[INFO] Downloading dep\n[INFO] BUILD SUCCESS\n[Pipeline] }",
    "[Pipeline] sh\n09:00:01 + kubectl rollout status deploy/app-{p}\nerror: timed out waiting for rollout\nscript returned exit code 1\n[Pipeline] }",
    "[Pipeline] withCredentials\nERROR: Could not find credentials entry with ID 'CRED-{p}'\n[Pipeline] // withCredentials",
    "09:00:{q}  step{q}: step{q}\n[Pipeline] echo\nworking on {p}\nstep{q} :time-elapsed-seconds:{q}",
    "groovy.lang.MissingMethodException: No signature of method: Lib.run{q}() is applicable\n\tat WorkflowScript.run(WorkflowScript:{q})\n\tat lib.vars.deploy.call(deploy.groovy:{q})\n\tat org.jenkinsci.plugins.workflow.cps.CpsScript.invoke(CpsScript.java:{q})\n[Pipeline] }",
    "java.lang.OutOfMemoryError: Java heap space\nno space left on device\nKilled by signal 9",
    "[Pipeline] sh\n+ curl -s https://host/{p}\nHTTP/1.1 503 Service Unavailable\nconnection refused\n{\"status\": 404, \"error\": \"gone\"}\n[Pipeline] }",
    "Downloading: artifact-{p}\nProgress: {q}\nChecking out branch b{q}\nWARN deprecated api",
    "Running on agent-{q} in /var/work/job\nJenkins ver. 2.4{q}\nThere are no nodes with the label 'linux-{q}'\nAvailable labels: [linux, mac-{q}]\nAgent 'agent-{q}' is offline",
    "Traceback (most recent call last):\n  File \"app/main_{q}.py\", line {q}, in run\n    value = load()\nValueError: bad value {p}\n",
    "flow: step{q}\n[Pipeline] sh\n10:00:02 $ docker pull img-{p}\n10:00:03   curl -fsSL https://repo/{p}\nError: failed to fetch service '{p}-svc'\nscript returned exit code {q}\n[Pipeline] }\nflow: Finished step{q}",
    "[Pipeline] sh\n+ printenv\nJENKINS_URL=https://ci/{q}\nAPI_TOKEN=abc{p}\nBUILD_NUMBER={q}\nWORKSPACE=/var/work/{p}\n[Pipeline] }",
    "Environment variable DB_URL_{q} is not set\nTool 'maven-{q}' not found\nExpected jdk version 17, got 11\nRequired plugin 'git-{q}' not installed\nNo such parameter 'REGION_{q}'\nFailed to apply JCasC configuration",
    "Loading library shared-{q}@v{q}\n$ docker run --name job-{p} img\nCalling deploy.run(\nTypeError: x is undefined\n    at load (/srv/app.js:{q}:5)\nRunning: build step {q}\nsome output failed with 500",
    "helm upgrade app-{q} ./chart\nUPGRADE FAILED: timed out\nexit status 2\n\n[Deploy Stage] FAILED\n> make all target-{q}\n[build] Starting",
    "hudson.AbortException: script returned exit code 1\nCaused by: java.io.IOException: Permission denied: /data/f{q}\n\tat hudson.plugins.git.Fetch.run(Fetch.java:{q})\nLABEL_{q}: x\nexport LABEL_{q}=1\nFinished: FAILURE",
)
SPREAD_ORDER = 7
SPREAD_LINE = 5
