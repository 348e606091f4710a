"""Fixed values for triage: tiers, known failures, noise, wording of model answers."""

# Tier of a category.
TIERS = {
    "CREDENTIAL_ERROR": "configuration", "CONFIGURATION": "configuration", "MISSING_PARAMETER": "configuration",
    "AGENT_ERROR": "configuration", "GROOVY_LIBRARY": "pipeline_misuse", "GROOVY_CPS": "pipeline_misuse",
    "GROOVY_SANDBOX": "pipeline_misuse", "GROOVY_SERIALIZATION": "pipeline_misuse", "PLUGIN_ERROR": "pipeline_misuse",
    "COMPILATION_ERROR": "pipeline_misuse", "NETWORK": "external_system", "TIMEOUT": "external_system",
    "INFRASTRUCTURE": "external_system", "RESOURCE": "external_system", "DEPENDENCY": "external_system",
    "TEST_FAILURE": "external_system", "UNKNOWN": "unknown",
}
# Short names of a model's answer for the categories above.
CATEGORY_ALIASES = {"CREDENTIAL": "CREDENTIAL_ERROR", "BUILD": "COMPILATION_ERROR", "TEST": "TEST_FAILURE"}

# Known failures in order, matched without case; the first one found counts.
# (pattern, tool, symptom, confidence, category, retriable)
KNOWN_FAILURES = (
    (r"progress deadline exceeded|timed out waiting for rollout", "kubectl rollout", "Deployment rollout timed out", 0.75, "INFRASTRUCTURE", True),
    (r"error: the server doesn't have a resource type|error: the server could not find the requested resource", "kubectl", "Kubernetes resource type not found", 0.85, "CONFIGURATION", False),
    (r"Unable to connect to the server|connection refused|no such host", "kubectl", "Cannot connect to Kubernetes cluster", 0.85, "NETWORK", True),
    (r"forbidden|cannot .* in the namespace|User .* cannot", "kubectl", "Kubernetes RBAC permission denied", 0.90, "PERMISSION", False),
    (r"Cannot connect to the Docker daemon|Is the docker daemon running", "docker", "Docker daemon not accessible", 0.90, "INFRASTRUCTURE", True),
    (r"denied: requested access to the resource is denied|unauthorized: authentication required", "docker push/pull", "Docker registry authentication failed", 0.90, "CREDENTIAL", True),
    (r"manifest .* not found|tag does not exist|pull access denied", "docker pull", "Docker image or tag not found", 0.90, "CONFIGURATION", False),
    (r"no space left on device", "docker/general", "Disk space exhausted", 0.95, "INFRASTRUCTURE", True),
    (r"UPGRADE FAILED|INSTALLATION FAILED|helm.*failed", "helm", "Helm release deployment failed", 0.75, "CONFIGURATION", False),
    (r"chart .* not found|failed to fetch chart", "helm", "Helm chart not accessible", 0.85, "CONFIGURATION", True),
    (r"Error acquiring the state lock|lock ID|ConditionalCheckFailedException", "terraform", "Terraform state lock conflict", 0.95, "INFRASTRUCTURE", True),
    (r"Provider .* not found|failed to query available provider packages", "terraform", "Terraform provider installation failed", 0.85, "CONFIGURATION", True),
    (r"Unable to locate credentials|NoCredentialProviders|ExpiredToken", "aws", "AWS credentials not available or expired", 0.90, "CREDENTIAL", True),
    (r"AccessDenied|not authorized to perform|UnauthorizedAccess", "aws", "AWS IAM permission denied", 0.90, "PERMISSION", False),
    (r"npm ERR! 404|package .* not found|ETARGET", "npm", "NPM package not found", 0.90, "CONFIGURATION", False),
    (r"EACCES|permission denied.*npm|EPERM", "npm", "NPM permission error", 0.85, "PERMISSION", False),
    (r"Could not resolve dependencies|Could not find artifact", "maven/gradle", "Build dependency resolution failed", 0.85, "CONFIGURATION", True),
    (r"Compilation failure|cannot find symbol|package .* does not exist", "maven/gradle", "Java compilation error", 0.80, "BUILD", False),
    (r"Permission denied \(publickey\)|Could not read from remote repository", "git", "Git SSH authentication failed", 0.90, "CREDENTIAL", False),
    (r"fatal: Authentication failed|403.*Forbidden|401.*Unauthorized", "git", "Git HTTPS authentication failed", 0.90, "CREDENTIAL", False),
)
EVIDENCE_WORDS = r"error|failed|timeout|denied"

# Error lines that call for no action, matched on the lower-cased line.
NOT_ACTIONABLE = (
    r"downloading:", r"downloaded:", r"progress[\s:]*\d", r"\[\d+/\d+\]", r"^\s*\d+%", r"checking out", r"cloning into",
    r"fetching", r"\[pipeline\]\s*(sh|stage|node|checkout)", r"\[pipeline\]\s*\{", r"\[pipeline\]\s*\}",
    r"^\s*\+\s*[\w-]+$", r"^\[info\]", r"^info:", r"build started", r"build finished", r"tests? (run|passed|skipped)",
    r"test suite", r"running \d+ test",
)

# What calls for the deeper search.
DEEP_CATEGORIES = ("GROOVY_LIBRARY", "GROOVY_CPS", "GROOVY_SANDBOX", "GROOVY_SERIALIZATION", "PLUGIN_ERROR")
DEEP_TEXTS = (
    "missingmethodexception", "missingpropertyexception", "missingclassexception", "nosuchmethoderror",
    "classnotfoundexception", "cannot resolve class", "unable to resolve class", "no signature of method",
    "no such property", "noncps", "notserializableexception", "cannot serialize",
)

# Words that tell the category of a prose answer, and the weight of each list.
ANSWER_CATEGORIES = (
    ("CREDENTIAL", 1.0, ("credential", "authentication", "password", "token", "secret", "api key", "login failed", "unauthorized", "401", "access token")),
    ("NETWORK", 1.0, ("network", "connection refused", "timeout", "unreachable", "dns", "socket", "etimedout", "econnrefused", "connection reset", "clone", "fetch failed", "dial tcp")),
    ("PERMISSION", 1.0, ("permission denied", "forbidden", "403", "access denied", "rbac", "not authorized", "cannot access")),
    ("INFRASTRUCTURE", 1.0, ("kubernetes", "k8s", "docker", "container", "pod", "deployment", "rollout", "node", "cluster", "oom", "memory", "cpu", "resource", "scheduling", "image pull", "crashloop")),
    ("CONFIGURATION", 0.9, ("configuration", "config", "yaml", "json", "invalid syntax", "missing parameter", "wrong value", "not found", "undefined", "environment variable", "env var")),
    ("BUILD", 1.0, ("build failed", "compile", "compilation", "maven", "gradle", "npm", "yarn", "dependency", "artifact", "package")),
    ("TEST", 1.0, ("test failed", "assertion", "expect", "junit", "pytest", "spec", "test case", "unit test", "integration test")),
)
SURE = ("the root cause is", "this is caused by", "the error is", "clearly", "definitely", "certainly", "the issue is", "failed because", "failed due to", "the problem is")
UNSURE = ("might be", "could be", "possibly", "uncertain", "not sure", "may be", "seems like", "perhaps")
FAIRLY_SURE = ("indicates", "suggests", "shows that", "points to", "likely", "probably", "appears to be")
RETRY = ("retry", "transient", "temporary", "intermittent", "try again", "rerun", "timeout", "timed out", "network", "connection", "flaky", "sporadic")
NO_RETRY = (
    "permanent", "fix required", "code change needed", "configuration change", "missing file", "invalid syntax", "wrong password",
    "invalid credential", "does not exist", "compilation error", "syntax error", "test failure",
)

# Where a prose answer states the cause, in order; the end of a part closes the match.
CAUSE_SECTIONS = (
    r"(?is)\*\*Summary\*\*[:\s]*\n?(.+?)(?:\n\n|\n\*\*|\n##|\z)", r"(?is)\*\*Root Cause(?:\s+Analysis)?\*\*[:\s]*\n?(.+?)(?:\n\n|\n\*\*|\n##|\z)",
    r"(?is)##\s*Summary[:\s]*\n?(.+?)(?:\n\n|\n##|\z)", r"(?is)##\s*Root Cause[:\s]*\n?(.+?)(?:\n\n|\n##|\z)",
    r"(?is)[-*]\s*(?:Root Cause|Summary|Issue|Problem)[:\s]+(.+?)(?:\n[-*]|\n\n|\z)",
    r"(?is)\d+[.)]\s*(?:Root Cause|Summary|Issue|Problem)[:\s]+(.+?)(?:\n\d+[.)]|\n\n|\z)",
)
CAUSE_STATEMENTS = (
    r"(?is)(?:The build failed|failed|error occurred)[:\s]+(?:because|due to)[:\s]*(.+?)(?:\.\s+This|\.\s+[A-Z][a-z]|\n\n|\z)",
    r"(?is)(?:Root cause|Primary cause|Main issue)[:\s]+(.+?)(?:\.\s+[A-Z]|\n\n|\z)",
    r"(?is)(?:The root cause is|The actual issue is|The problem is)[:\s]+(.+?)(?:\.\s+[A-Z]|\n\n|\z)",
)
FIX_FORMS = (
    r"(?is)\*\*(?:Fix|Solution|Recommendation|Resolution|How to fix)\*\*[:\s]*\n?(.+?)(?:\n\n|\n\*\*|\n##|\z)",
    r"(?is)##\s*(?:Fix|Solution|Recommendation)[:\s]*\n?(.+?)(?:\n\n|\n##|\z)",
    r"(?is)[-*]\s*(?:Fix|Solution|Recommendation)[:\s]+(.+?)(?:\n[-*]|\n\n|\z)",
    r"(?is)(?:To fix|To resolve|To solve|Solution:|Fix:|Recommendation:)[:\s]*(.+?)(?:\n\n|\z)",
)
ANSWER_JSON = r"(?s)\{[^{}]*\"root_cause\"[^{}]*\}"
# Markdown marks to drop, each with its replacement group.
MARKDOWN = ((r"\*\*([^*]+)\*\*", True), (r"\*([^*]+)\*", True), (r"__([^_]+)__", True), (r"_([^_]+)_", True),
            (r"(?m)^#+\s*", False), (r"(?m)^\s*[-*]\s+", False), (r"(?m)^\s*\d+[.)]\s+", False))

# Suggestion for a cause, first hit.
SUGGESTIONS = (
    (r"credential", "create the credential"), (r"nullpointerexception|null pointer", "add a null check"),
    (r"timeout", "increase the timeout"), (r"permission|access denied", "grant the permission"),
    (r"not found|404", "verify that the resource exists"),
)
STRONG_SCM = (
    r"(?i)(couldn'?t find any revision|could not find any revision|hudson\.plugins\.git|gitexception|unable to checkout"
    r"|checkout failed|fatal:\s*[^\n]*(git|remote|repository)|permission denied)"
)
