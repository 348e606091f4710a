"""Shell and pipeline line forms. Fixed values that decide results."""

# A clock or ISO stamp, then a trace sign; or a trace sign at the start followed by a blank.
_CLOCK = r"\[?\d{2}:\d{2}:\d{2}[.\d]*\]?"
_ISO = r"\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*Z?\]"
TRACED_COMMAND = rf"^(?:{_CLOCK}\s+[+$]\s*|[+$]\s+|{_ISO}\s+[+$]\s*)(.+)"
DOLLAR_COMMAND = rf"^(?:{_CLOCK}\s+[$]\s*|[$]\s+|{_ISO}\s+[$]\s*)(.+)"
CONTINUATION = rf"^(?:\d{{2}}:\d{{2}}:\d{{2}}|{_ISO})\s+([a-zA-Z_/][a-zA-Z0-9_/.-]*(?:\s+.*)?)$"

# Commands that mark a script line as a command of its own.
KNOWN_COMMANDS = (
    "curl", "wget", "aws", "az", "gcloud", "kubectl", "helm", "docker",
    "terraform", "ansible", "mvn", "gradle", "npm", "yarn", "pip", "python",
    "java", "node", "ruby", "perl", "bash", "sh", "zsh", "cat", "echo",
    "grep", "sed", "awk", "find", "ls", "cd", "cp", "mv", "rm", "mkdir",
    "chmod", "chown", "tar", "gzip", "unzip", "zip", "ssh", "scp", "rsync",
    "git", "make", "cmake", "go", "cargo", "dotnet", "vault", "consul",
    "a2l", "p2l", "hiera", "puppet", "chef", "salt", "packer", "vagrant",
    "jq", "yq", "xargs", "tee", "head", "tail", "sort", "uniq", "wc",
    "env", "export", "set", "source", "eval", "exec", "test", "true", "false",
)

# Pipeline steps that wrap a block and leave the shell state alone.
WRAPPER_BLOCKS = (
    "withCredentials", "withDockerContainer", "withDockerRegistry", "withDockerServer",
    "withEnv", "withMaven", "withGradle", "withAnt", "withSonarQubeEnv", "withAWS",
    "withKubeConfig", "withVault", "dir", "node", "timestamps", "timeout", "retry", "lock",
    "parallel", "script", "catchError", "warnError", "container", "podTemplate", "sshagent",
)

# Exit code forms in order of preference, matched without case.
EXIT_CODES = (
    r"exit code[:\s]+(\d+)",
    r"returned (\d+)",
    r"exited with (\d+)",
    r"status[:\s]+(\d+)",
    r"rc=(\d+)",
    r"Return code[:\s]+(\d+)",
)

# Signs of failure in the output of a command.
OUTPUT_FAILURE = (
    r"(?i)^error:", r"(?i)Error:", r"(?i)FAILED", r"(?i)Exception", r"(?i)fatal:", r"(?i)cannot\s",
    r"(?i)invalid\s", r"(?i)not found", r"(?i)permission denied", r"(?i)access denied", r"(?i)unable to",
    r"(?i)failed to", r"ERRORMSG", r"ERRMSG", r"\[ERROR\]", r"\[FATAL\]",
)

# Tool command forms outside a shell step, first one wins, matched without case.
TOOL_LINES = (
    ("aws", r"^\s*\+?\s*(aws\s+.+)"),
    ("az", r"^\s*\+?\s*(az\s+.+)"),
    ("gcloud", r"^\s*\+?\s*(gcloud\s+.+)"),
    ("kubectl", r"^\s*\+?\s*(kubectl\s+.+)"),
    ("helm", r"^\s*\+?\s*(helm\s+.+)"),
    ("docker", r"^\s*\+?\s*(docker\s+.+)"),
    ("terraform", r"^\s*\+?\s*(terraform\s+.+)"),
    ("mvn", r"^\s*\+?\s*(mvn\s+.+|mvnw\s+.+)"),
    ("gradle", r"^\s*\+?\s*(gradle\s+.+|gradlew\s+.+|\./gradlew\s+.+)"),
    ("npm", r"^\s*\+?\s*(npm\s+.+)"),
    ("yarn", r"^\s*\+?\s*(yarn\s+.+)"),
    ("pip", r"^\s*\+?\s*(pip3?\s+.+)"),
    ("sh", r"^\s*\+\s*(sh\s+-c\s+.+|bash\s+-c\s+.+)"),
    ("bash", r"^\s*\+\s*(/bin/(?:ba)?sh\s+.+)"),
    ("curl", r"^\s*\+?\s*(curl\s+.+)"),
    ("wget", r"^\s*\+?\s*(wget\s+.+)"),
    ("p2l", r"^\s*\+?\s*(p2l\s+.+)"),
    ("a2l", r"^\s*\+?\s*(a2l\s+.+)"),
)

# Output signs counted when a command is blamed for an error line (lower case).
BLAME_SIGNALS = (
    "error:", "fatal:", "failed", "exception", "cannot ", "unable to", "not found", "denied",
    " rejected", "non-zero", "exit code", "returned exit", "build failure", "[error]", "[fatal]",
)
LONG_RUNNING = r"(?i)\b(mvnw?|gradle\w*|gradlew|npm|yarn|pnpm|make|cmake|ninja|bazel|buck)\b"
EXIT_LINE = r"(?i)(script returned exit code|returned exit code|exit code|finished:\s*failure)\s*[:\s]*(\d+)"

# Noise lines that are never errors.
NOISE_LINES = (r"^\s*$", r"^Downloading:", r"^Downloaded:", r"^Progress:", r"^\[INFO\]\s*Download", r"^\+\+\+", r"^---")

# Output signs for the command that gets a build's final exit code (case matters).
FINAL_EXIT_SIGNALS = (
    "error:", "Error:", "ERROR:", "FATAL:", "fatal:", "FAILED", "failed", "cannot", "unable to",
    "not found", "denied", "invalid", "Exception", "exception",
)
