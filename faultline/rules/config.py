"""Configuration issues by family, and failures of pipeline code. Matched without case."""

# Family -> issue -> patterns; the families are in order of priority.
CONFIG_ISSUES = {
    "credential": {
        "not_found": (
            r"(?:CredentialsNotFoundException|Credentials not found).*?['\"]([^'\"]+)['\"]", r"Could not find credentials entry with ID ['\"]([^'\"]+)['\"]",
            r"No credentials with id ['\"]([^'\"]+)['\"]", r"Unable to find credentials with id ['\"]([^'\"]+)['\"]", r"Credential\s+['\"]([^'\"]+)['\"]\s+not found",
        ),
        "type_mismatch": (
            r"Expected credentials of type\s+(\w+)\s+but got\s+(\w+)", r"Cannot cast.*?Credentials.*?to\s+(\S+)", r"credentials\s+['\"]([^'\"]+)['\"]\s+.*?wrong type",
        ),
        "binding_failed": (r"withCredentials.*?failed.*?['\"]([^'\"]+)['\"]", r"Error binding credentials\s+['\"]([^'\"]+)['\"]"),
    },
    "env": {
        "not_set": (
            r"(?:Environment variable|env\.)\s*(\w+)\s*(?:is not set|not defined|is null|is empty)", r"\$(\w+)\s*(?:is undefined|not found)",
            r"Missing required environment variable[:\s]+(\w+)", r"env\.(\w+)\s+==\s+null", r"params\.(\w+)\s+==\s+null",
        ),
        "invalid_value": (r"Invalid value for\s+(\w+)", r"(\w+)\s+has invalid format", r"Failed to parse\s+(\w+)"),
    },
    "agent": {
        "no_match": (
            r"There are no nodes with the label ['\"]([^'\"]+)['\"]", r"Waiting for next available executor on ['\"]([^'\"]+)['\"]",
            r"Label ['\"]([^'\"]+)['\"]\s+(?:does not match|has no|is not)", r"(?:Still waiting|Pending).*?label\s+['\"]([^'\"]+)['\"]",
        ),
        "offline": (
            r"Agent\s+['\"]([^'\"]+)['\"]\s+is offline", r"(?:Node|Slave)\s+['\"]([^'\"]+)['\"]\s+(?:offline|disconnected)",
            r"Connection to\s+['\"]([^'\"]+)['\"]\s+(?:lost|failed)",
        ),
        "busy": (r"All executors on\s+['\"]([^'\"]+)['\"]\s+are busy", r"Waiting for\s+['\"]([^'\"]+)['\"]\s+to become available"),
    },
    "tool": {
        "not_found": (
            r"Tool\s+['\"]([^'\"]+)['\"]\s+not found", r"(?:Cannot find|Unable to locate)\s+(\w+)\s+installation", r"(\w+)\s+is not installed on this node",
            r"No tool named ['\"]([^'\"]+)['\"]", r"tool type ['\"]([^'\"]+)['\"]\s+not found",
        ),
        "version_mismatch": (r"Expected\s+(\w+)\s+version\s+([^\s,]+)", r"(\w+)\s+version\s+([^\s]+)\s+required", r"Incompatible\s+(\w+)\s+version"),
        "not_configured": (r"(\w+)\s+is not configured", r"Please configure\s+(\w+)\s+in", r"Tool\s+['\"]([^'\"]+)['\"]\s+is not configured"),
    },
    "plugin": {
        "missing": (
            r"(?:Plugin|Extension)\s+['\"]([^'\"]+)['\"]\s+(?:not found|missing|required)", r"Required plugin\s+['\"]([^'\"]+)['\"]\s+not installed",
            r"No such DSL method ['\"]([^'\"]+)['\"]\s+found", r"java\.lang\.NoClassDefFoundError.*?plugin",
        ),
        "version": (
            r"Plugin\s+['\"]([^'\"]+)['\"]\s+requires version\s+([^\s]+)", r"Incompatible plugin version.*?['\"]([^'\"]+)['\"]",
            r"Plugin\s+['\"]([^'\"]+)['\"]\s+([^\s]+)\s+is too old",
        ),
    },
    "param": {
        "missing": (
            r"(?:Parameter|param)\s+['\"]([^'\"]+)['\"]\s+(?:not provided|is required|missing)", r"No such parameter\s+['\"]([^'\"]+)['\"]",
            r"params\.(\w+)\s+(?:is null|not defined)", r"Required parameter\s+['\"]([^'\"]+)['\"]\s+not specified",
        ),
        "invalid": (r"Invalid (?:value for )?parameter\s+['\"]([^'\"]+)['\"]", r"Parameter\s+['\"]([^'\"]+)['\"]\s+(?:has wrong type|validation failed)"),
    },
    "jcasc": {
        "parse": (
            r"(?:JCasC|configuration-as-code).*?(?:parse|syntax|validation)\s+error", r"Failed to apply JCasC configuration", r"YAML parse error at\s+(.+)",
            r"io\.jenkins\.plugins\.casc\.ConfiguratorException",
        ),
        "invalid": (
            r"Unknown configuration key\s+['\"]([^'\"]+)['\"]", r"(?:Invalid|Unknown)\s+(?:property|field)\s+['\"]([^'\"]+)['\"]\s+in\s+(.+)",
            r"configurator.*?Cannot configure.*?['\"]([^'\"]+)['\"]",
        ),
    },
}

# Name of the primary issue by family and issue ('' stands for any other issue of the family).
PRIMARY_ISSUE = {
    "credential": {"not_found": "missing_credential", "type_mismatch": "wrong_credential_type", "": "invalid_credential"},
    "env": {"not_set": "missing_env_var", "": "invalid_env_var"},
    "agent": {"no_match": "wrong_agent_label", "offline": "agent_offline", "": "no_agent_available"},
    "tool": {"not_found": "missing_tool", "": "wrong_tool_version"},
    "plugin": {"missing": "plugin_missing", "": "plugin_version"},
    "param": {"missing": "missing_parameter", "": "invalid_parameter"},
    "jcasc": {"": "jcasc_error"},
}

# Family of a tool name, first hit.
TOOL_FAMILIES = (
    ("jdk|java|openjdk|oracle", "jdk"), ("maven|mvn", "maven"), ("gradle", "gradle"), ("node|npm|nodejs", "nodejs"), ("docker", "docker"),
    ("kubectl|kubernetes|k8s", "kubectl"), ("terraform|tf", "terraform"), ("ansible", "ansible"), ("python|pip", "python"),
    ("go|golang", "go"), (r"dotnet|\.net", "dotnet"),
)
VERSION_FORMS = (r"Jenkins ver\.\s+([^\s\n]+)", r"Running on Jenkins\s+([^\s\n]+)", r"jenkins/([0-9.]+)")

# Failure types of pipeline code in order of priority, then the rest; first type present wins.
GROOVY_TYPES = {
    "sandbox_rejection": (r"Scripts not permitted to use (?:method|staticMethod|new|field)\s+(.+)", r"RejectedAccessException:\s*(.+)", r"org\.jenkinsci\.plugins\.scriptsecurity\.sandbox\.RejectedAccessException", r"Scripts not permitted to use\s+(.+)"),
    "library_load": (r"Unable to find source for class\s+(.+)", r"@Library\s*\(\s*['\"](.+?)['\"]\s*\).*not found", r"Could not find shared library", r"ERROR: Could not resolve SCM from", r"Library\s+(.+)\s+does not exist", r"checkout .* failed"),
    "library_version": (r"Branch\s+(.+)\s+not found", r"Tag\s+(.+)\s+not found", r"Unable to checkout revision", r"pathspec '(.+)' did not match", r"Couldn't find any revision to build"),
    "cps_transformation": (r"CpsCallableInvocation.*expecting closure", r"expected to call.*but wound up catching", r"CPS-transformed.*cannot be invoked", r"cannot be CPS transformed", r"Continuation passing style"),
    "serialization": (r"java\.io\.NotSerializableException:\s*(.+)", r"Unable to serialize", r"cannot be serialized", r"Caused by: an exception which occurred", r"Expected to find a CPS-transformed"),
    "missing_method": (r"groovy\.lang\.MissingMethodException:\s*No signature of method:\s*(.+)", r"java\.lang\.NoSuchMethodError:\s*(.+)", r"No signature of method", r"MissingMethodException"),
    "missing_property": (r"groovy\.lang\.MissingPropertyException:\s*No such property:\s*(\w+)", r"MissingPropertyException:\s*(.+)", r"No such property:", r"Cannot get property\s+'(\w+)'"),
    "class_not_found": (r"java\.lang\.ClassNotFoundException:\s*(.+)", r"Unable to resolve class\s+(.+)", r"ClassNotFoundException", r"NoClassDefFoundError:\s*(.+)"),
    "compilation": (r"org\.codehaus\.groovy\.control\.MultipleCompilationErrorsException", r"startup failed:", r"BUG! exception in phase 'semantic analysis'", r"Compilation incomplete"),
    "syntax": (r"unexpected token:", r"expecting\s+'([^']+)'", r"SyntaxException:", r"unable to resolve class"),
    "null_pointer": (r"java\.lang\.NullPointerException", r"Cannot invoke method\s+(\w+)\s+on null object", r"Cannot get property\s+'(\w+)'\s+on null object"),
    "type_mismatch": (r"GroovyCastException:\s*(.+)", r"Cannot cast object\s+(.+)\s+to class", r"ClassCastException:\s*(.+)", r"Argument type mismatch"),
    "step_execution": (r"hudson\.AbortException:\s*(.+)", r"FlowInterruptedException", r"Step\s+'(.+)'\s+failed", r"Required context class\s+(.+)\s+is missing"),
    "script_approval": (r"Waiting for approval", r"Administrator approval is required", r"script-security sandbox"),
}

# Words that look like calls but belong to the pipeline language.
BUILTIN_CALLS = (
    "sh", "bat", "echo", "node", "stage", "parallel", "script", "dir", "checkout", "git", "input", "timeout", "retry", "sleep", "error",
    "archiveArtifacts", "stash", "unstash", "deleteDir", "fileExists", "readFile", "writeFile", "pwd", "isUnix", "tool", "withEnv",
    "withCredentials", "sshagent", "wrap", "timestamps", "ansiColor", "if", "else", "for", "while", "try", "catch", "finally", "def",
    "return", "new", "import", "package", "class", "interface",
)
# Forms in which code names a credential.
CREDENTIAL_USES = (
    r"usernamePassword\s*\([^)]*credentialsId:\s*['\"]([^'\"]+)['\"]", r"string\s*\([^)]*credentialsId:\s*['\"]([^'\"]+)['\"]",
    r"sshUserPrivateKey\s*\([^)]*credentialsId:\s*['\"]([^'\"]+)['\"]", r"usernameColonPassword\s*\([^)]*credentialsId:\s*['\"]([^'\"]+)['\"]",
    r"file\s*\([^)]*credentialsId:\s*['\"]([^'\"]+)['\"]", r"credentials\s*\(['\"]([^'\"]+)['\"]",
)
