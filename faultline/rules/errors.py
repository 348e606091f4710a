"""Error rules. Fixed values that decide results; order matters where a first hit wins."""

# Category and its patterns.
CATEGORY_PATTERNS = {
    "COMPILATION_ERROR": (
        r"(?i)cannot find symbol", r"(?i)compilation failed", r"(?i)build failed", r"(?i)syntax error",
        r"SyntaxError:", r"ModuleNotFoundError:", r"ImportError:", r"(?i)undefined reference",
        r"(?i)unresolved external symbol", r"error: .*\.java:\d+:", r"error TS\d+:", r"error\[E\d+\]:",
    ),
    "TEST_FAILURE": (
        r"(?i)test.*failed", r"(?i)tests? failed", r"AssertionError", r"(?i)assertion failed",
        r"Expected .* but got", r"expected:<.*> but was:<.*>", r"FAILED\s+\[", r"✗|✘|❌", r"pytest.*FAILED", r"FAIL:",
    ),
    "INFRASTRUCTURE": (
        r"(?i)out of memory", r"(?i)cannot allocate memory", r"(?i)no space left on device",
        r"(?i)disk quota exceeded", r"OOMKilled", r"(?i)killed by signal", r"(?i)segmentation fault",
        r"SIGSEGV", r"(?i)core dumped",
    ),
    "DEPENDENCY": (
        r"(?i)could not resolve dependencies", r"(?i)dependency .* not found", r"(?i)package .* not found",
        r"(?i)module .* not found", r"npm ERR!", r"yarn error", r"pip.*error", r"(?i)version conflict",
        r"(?i)incompatible version", r"ERESOLVE", r"(?i)failed to download",
    ),
    "CONFIGURATION": (
        r"(?i)missing required", r"(?i)configuration error", r"(?i)invalid.*config",
        r"(?i)environment variable.*not set", r"(?i)missing environment", r"(?i)file not found",
        r"FileNotFoundException", r"(?i)no such file or directory",
    ),
    "TIMEOUT": (
        r"(?i)timed? ?out", r"(?i)timeout exceeded", r"(?i)deadline exceeded", r"(?i)operation timed out",
        r"TimeoutError", r"TimeoutException",
    ),
    "NETWORK": (
        r"(?i)connection refused", r"(?i)connection reset", r"(?i)network unreachable", r"(?i)host not found",
        r"(?i)dns lookup failed", r"ECONNREFUSED", r"ECONNRESET", r"ETIMEDOUT", r"(?i)ssl.*error",
        r"(?i)certificate.*error",
    ),
    "PERMISSION": (
        r"(?i)permission denied", r"(?i)access denied", r"(?i)unauthorized", r"(?i)forbidden", r"EACCES",
        r"EPERM", r"401 Unauthorized", r"403 Forbidden",
    ),
    "RESOURCE": (
        r"(?i)resource .* not found", r"(?i)service unavailable", r"503 Service Unavailable", r"502 Bad Gateway",
        r"504 Gateway Timeout", r"(?i)database.*error", r"(?i)connection pool exhausted",
    ),
    "GROOVY_LIBRARY": (
        r"(?i)Unable to find source for class", r"(?i)Could not find shared library", r"(?i)Library.*not found",
        r"(?i)@Library.*does not exist", r"(?i)Branch .* not found", r"(?i)Unable to checkout revision",
        r"(?i)vars/\w+\.groovy.*not found",
    ),
    "GROOVY_CPS": (
        r"(?i)CpsCallableInvocation", r"(?i)CPS-transformed.*cannot be invoked",
        r"(?i)expected to call.*wound up catching", r"(?i)Continuation passing style",
        r"(?i)cannot be CPS transformed", r"(?i)CpsScript\.invokeMethod",
    ),
    "GROOVY_SANDBOX": (
        r"(?i)Scripts not permitted to use", r"(?i)RejectedAccessException", r"(?i)script-security sandbox",
        r"(?i)Administrator approval is required", r"(?i)Waiting for approval",
    ),
    "GROOVY_SERIALIZATION": (
        r"(?i)java\.io\.NotSerializableException", r"(?i)Unable to serialize", r"(?i)cannot be serialized",
        r"(?i)Expected to find a CPS-transformed",
    ),
    "CREDENTIAL_ERROR": (
        r"(?i)CredentialsNotFoundException", r"(?i)Could not find credentials", r"(?i)No credentials with id",
        r"(?i)Unable to find credentials", r"(?i)Credential.*not found", r"(?i)withCredentials.*failed",
    ),
    "AGENT_ERROR": (
        r"(?i)There are no nodes with the label", r"(?i)Still waiting for", r"(?i)Agent.*is offline",
        r"(?i)Node.*offline", r"(?i)Waiting for next available executor",
    ),
    "PLUGIN_ERROR": (
        r"(?i)Plugin.*not found", r"(?i)Required plugin.*not installed", r"(?i)No such DSL method",
        r"(?i)java\.lang\.NoClassDefFoundError.*plugin", r"(?i)Incompatible plugin version",
    ),
    "TOOL_ERROR": (
        r"^Error:\s+.+", r"^\[ERROR\]\s+.+", r"^ERROR:\s+.+", r"^error:\s+.+", r"(?i)An error occurred \(",
        r"(?i)ERROR:.*gcloud", r"(?i)az:.*error", r"(?i)UPGRADE FAILED", r"(?i)INSTALLATION FAILED",
        r"(?i)error:.*kubectl", r"(?i)cannot validate", r"(?i)Error:.*terraform", r"(?i)Error applying plan",
        r"(?i)error during connect", r"(?i)Error response from daemon", r"(?i)script returned exit code [1-9]",
        r"(?i)command not found", r"(?i)fatal:\s+.+", r"(?i)FATAL:\s+.+", r"(?i)exit status [1-9]",
        r"(?i)exited with code [1-9]", r"(?i)failed to execute", r"(?i)execution failed", r"(?i)command failed",
        r"(?i)unable to execute",
    ),
    "UNKNOWN": (r"(?i)Exception:", r"(?i)Error$"),
}

# Which category wins when two are equally frequent.
CATEGORY_PRIORITY = (
    "INFRASTRUCTURE", "GROOVY_LIBRARY", "GROOVY_CPS", "GROOVY_SANDBOX", "GROOVY_SERIALIZATION",
    "CREDENTIAL_ERROR", "AGENT_ERROR", "PLUGIN_ERROR", "COMPILATION_ERROR", "TEST_FAILURE", "DEPENDENCY",
    "CONFIGURATION", "NETWORK", "PERMISSION", "TIMEOUT", "RESOURCE", "TOOL_ERROR",
)

# Weight of a line as the primary error, matched without case; the highest counts.
LINE_WEIGHTS = (
    (r"^(?:ERROR|Error|error)[:\s]", 10), (r"\bFATAL[:\s]", 10), (r"\bFAILED[:\s]", 9), (r"\bException[:\s]", 8),
    (r"\bfailed\b", 7), (r"BUILD FAILURE", 9), (r"npm ERR!", 9), (r"\[ERROR\]", 8), (r"^\s+at\s+[\w.$]+\(", 6),
    (r"Caused by:", 7), (r"could not find", 7), (r"not found", 6), (r"permission denied", 8), (r"access denied", 8),
    (r"connection refused", 8), (r"timeout", 7), (r"timed out", 7),
)

# Weight of a checkout failure, matched without case.
SCM_WEIGHTS = (
    (r"couldn'?t find any revision", 10), (r"could not find any revision", 10), (r"gitexception", 10),
    (r"unable to checkout", 9), (r"checkout failed", 9), (r"fatal:.*(git|remote|repository)", 9),
    (r"hudson\.plugins\.git", 9), (r"revision.*not found", 8), (r"repository.*not found", 8),
    (r"authentication failed.*git", 7), (r"error fetching remote", 8),
)

# Type of an error line, matched in lower case, first type with a hit.
ERROR_TYPES = {
    "credential": (r"credential", r"cred\s+entry", r"secret", r"password", r"api[_-]?key", r"token", r"auth", r"login failed"),
    "network": (r"connection refused", r"connection reset", r"network", r"unreachable", r"dns", r"resolve", r"socket"),
    "timeout": (r"timeout", r"timed out", r"deadline exceeded"),
    "permission": (r"permission denied", r"access denied", r"forbidden", r"unauthorized", r"not authorized", r"403"),
    "not_found": (r"not found", r"no such", r"does not exist", r"missing", r"404", r"could not find"),
    "build_failure": (r"build failure", r"compilation error", r"compile error", r"syntax error", r"npm err", r"maven", r"gradle"),
    "test_failure": (r"test failed", r"tests failed", r"assertion", r"expected.*but", r"junit", r"pytest"),
    "configuration": (r"invalid config", r"configuration error", r"missing param", r"required parameter", r"invalid value"),
    "infrastructure": (r"out of memory", r"disk full", r"no space", r"oom", r"killed", r"resource", r"quota"),
}

# Type, base score and patterns of the deep search, matched without case.
DEEP_TYPES = (
    ("CREDENTIAL_NOT_FOUND", 100, (r"could not find cred", r"credential.*not found", r"no.*credential.*found")),
    ("CREDENTIAL_EXPIRED", 95, (r"credential.*expired", r"token.*expired")),
    ("CREDENTIAL_INVALID", 90, (r"invalid.*credential", r"authentication failed", r"access denied.*credential")),
    ("NETWORK_TIMEOUT", 100, (r"connection timed out", r"read timed out", r"timeout.*connect")),
    ("NETWORK_DNS", 95, (r"unknown host", r"could not resolve", r"dns.*failed")),
    ("NETWORK_CONNECTION_REFUSED", 90, (r"connection refused", r"connect.*refused")),
    ("PERMISSION_DENIED", 100, (r"permission denied", r"access denied", r"not authorized", r"forbidden")),
    ("FILE_NOT_FOUND", 95, (r"file not found", r"no such file", r"path.*not exist")),
    ("RESOURCE_NOT_FOUND", 90, (r"resource.*not found", r"404", r"does not exist")),
    ("METHOD_NOT_FOUND", 95, (r"MissingMethodException", r"no signature of method", r"method.*not found")),
    ("CPS_ERROR", 100, (r"CpsCallableInvocation", r"NonCPS", r"expected to call")),
    ("SERIALIZATION_ERROR", 95, (r"NotSerializableException", r"cannot serialize")),
    ("GROOVY_ERROR", 80, (r"groovy\.lang\.\w+Exception", r"MissingPropertyException")),
    ("COMPILATION_ERROR", 90, (r"compilation failed", r"compile error", r"syntax error")),
    ("DEPENDENCY_ERROR", 85, (r"dependency.*not found", r"could not resolve", r"module not found")),
    ("ENV_VAR_MISSING", 90, (r"environment variable.*not set", r"env.*is not defined", r"\$\{?\w+\}?\s*is\s*(null|empty|undefined)")),
    ("DISK_FULL", 100, (r"no space left", r"disk full")),
    ("MEMORY_ERROR", 95, (r"OutOfMemoryError", r"out of memory")),
    ("TEST_FAILURE", 80, (r"tests? failed", r"test.*failure", r"assertion.*failed")),
)

# Errors of the pipeline itself, matched without case.
PIPELINE_ERRORS = (
    r"Could not find credentials entry with ID", r"Credentials .+ not found", r"No such DSL method",
    r"java\.lang\.\w+Exception:", r"java\.io\.\w+Exception:", r"hudson\.\w+Exception:",
    r"org\.jenkinsci\.\w+Exception:", r"Timeout .+ exceeded", r"Script approval required",
    r"RejectedAccessException", r"CpsCallableInvocation", r"WorkflowScript:", r"groovy\.lang\.\w+Exception:",
    r"No signature of method", r"Cannot invoke method .+ on null", r"MissingPropertyException",
)
# The narrower set used when a failing tool is looked up.
ROUTER_ERRORS = (
    r"Could not find credentials entry with ID", r"Credentials .+ not found", r"No such DSL method",
    r"Timeout .+ exceeded", r"Script approval required", r"RejectedAccessException", r"CpsCallableInvocation",
    r"WorkflowScript:", r"No signature of method", r"Cannot invoke method .+ on null",
    r"MissingPropertyException", r"CredentialNotFoundException",
)

# What counts as an identifier in an error line, and what does not.
ID_QUOTED = r"['\"]([^'\"]+)['\"]"
ID_AFTER_WORD = (r"(?i)\bID\s+(\S+)",) + tuple(
    rf"(?i)\b{w}\s+['\"]?(\S+?)['\"]?(?:\s|$)" for w in ("name", "parameter", "secret", "credential", "service", "file", "path")
)
ID_CAPS = r"\b([A-Z][A-Z0-9_-]{2,})\b"
ID_NOISE = ("ERROR", "FAILED", "NOT", "FOUND", "THE", "WITH", "FOR", "AND", "BUT")
DEEP_IDS = (
    r"'([A-Za-z][A-Za-z0-9_-]{2,})'", r"\"([A-Za-z][A-Za-z0-9_-]{2,})\"",
    r"(?i)ID[:\s]+([A-Za-z][A-Za-z0-9_-]+)", r"(?i)name[:\s]+([A-Za-z][A-Za-z0-9_-]+)",
)
DEEP_OPTION = r"--(\w+)[=\s]+([^\s]+)"
DEEP_ID_NOISE = ("the", "and", "for", "not", "with", "from", "this", "that")
TOOL_IDS = (r"'([A-Za-z0-9_-]{4,})'", r"\"([A-Za-z0-9_-]{4,})\"", r"/([A-Za-z0-9_-]{4,})(?:\s|$|'|\")")
PATHS = r"(/[A-Za-z0-9._/-]+)"
URLS = r"(https?://[^\s<>\"]+)"
VARIABLES = (r"\$\{?([A-Z][A-Z0-9_]+)\}?", r"env\.([A-Z][A-Z0-9_]+)")
FINAL_EXIT = r"(?i)(?:exit code|exit status|exited with)\s*[:\s]*(\d+)"
FINAL_EXIT_TAIL = r"(?i)(?:exit code|exit status|exited with|returned)\s*[:\s]*(\d+)"
