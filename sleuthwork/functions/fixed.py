"""Lists, patterns and constants that decide results. Java regex dialect.

The patterns that read words are prefixed with ``(?U)`` where used, so that ``\\w`` is Unicode-wide.
"""

# Volatile fragments that normalisation removes, in this order.
VOLATILE = [
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", " "),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", " "),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", " "),
    (r"(?i)\b0x[0-9a-f]+\b", " "),
    (r"(?i)\b[0-9a-f]{16,}\b", " "),
    (r"\b[A-Za-z]:\\(?:[^\s:*?\"<>|\\]+\\)*", " "),
    (r"(?<![\w@.-])/(?:[\w.-]+/){2,}", " "),
    (r"\bfile://\S*", " "),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", " "),
    (r"(?i)\blocalhost:\d+\b", " localhost "),
    (r":\d+:\d+\b", " "),
    (r"(?i)\bline \d+\b", " "),
    (r"(?i)\bpid[= ]\d+\b", " "),
    (r"(?i)\btmp[\w-]{6,}\b", " "),
]

# Token shapes.
EXCEPTION = r"\b([A-Z][A-Za-z0-9]*(?:Error|Exception|Warning))\b"
ERROR_CODE = r"\b(E[A-Z]{3,}|ERR_[A-Z0-9_]+|[A-Z]{2,}_[A-Z0-9_]{2,})\b"
BACKTICK = r"`([^`\n]{1,80})`"
PACKAGE = r"(@[\w.-]+/[\w.-]+(?:/[\w.-]+)*|\bnode:[\w/]+)"
DUNDER = r"\b(__[A-Z][A-Z0-9_]*__)\b"
DOTTED = r"\b([a-zA-Z_$][\w$]*(?:\.[a-zA-Z_$][\w$]*)+)\b"
CAMEL = r"\b([a-z]+(?:[A-Z][a-z0-9]+)+)\b"
HYPHEN_MODULE = r"\b([a-z][a-z0-9]*(?:-[a-z0-9]+){1,4})\b"
HTTP_ROUTE = r"(?<!\w)(/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_@.:-]+)*)\b"
FRAME = r"(?m)^\s*at\s+([\w$.<>]+)"
FILE = r"\b([\w.-]+\.(?:ts|tsx|js|mjs|cjs|py|json|yaml|yml|toml))\b"
VERSIONISH = r"\b\d+\.\d+(?:\.\d+)?(?:[-.][\w.]+)?\b"
WORD = r"[A-Za-z_$][\w$.-]{1,}"
PLAIN_WORD = r"\b[A-Za-z][A-Za-z0-9]{5,}\b"

# Words that identify nothing on their own.
GENERIC_TOKENS = [
    "error", "errors", "failed", "failure", "failing", "exception", "startup", "start", "starts", "started", "starting", "config", "configuration", "plugin", "plugins",
    "windows", "linux", "macos", "darwin", "win32", "node", "nodejs", "npm", "pnpm", "yarn", "server", "client", "service", "services", "module", "modules", "package",
    "packages", "version", "versions", "install", "installed", "build", "builds", "run", "running", "test", "tests", "true", "false", "null", "undefined", "warning", "info",
    "debug", "trace", "stack", "code", "type", "types", "value", "values", "object", "function", "string", "number", "array", "file", "files", "path", "paths", "line",
    "column", "port", "host", "url", "http", "https", "request", "response", "timeout", "user", "users", "system", "process", "command", "commands", "output", "input",
    "log", "logs", "issue", "problem", "not-found", "no-such-file",
]

# Stated failure mechanisms and the patterns that state them (case-insensitive).
CAUSES = {
    "content_security_policy": [r"\bcontent[- ]security[- ]policy\b", r"\bcsp\b.*\b(block|refus|violat)", r"\brefused to (load|execute|connect)\b", r"\bviolates the following .*directive\b", r"\b(script|style|connect|img|font)-src\b"],
    "yaml_parse": [r"\bduplicate key\b", r"\bmapping values are not allowed\b", r"\bcould not find expected\b", r"\byaml(?:\.\w+)?\s*(parse|syntax|scanner|composer)\w*\s*error\b", r"\bwhile (parsing|scanning) a\b"],
    "dns_resolution": [r"\bgetaddrinfo\b", r"\bEAI_AGAIN\b", r"\bENOTFOUND\b", r"\bname resolution\b", r"\bdns\b.*\b(fail|error|timeout)"],
    "authentication": [r"\b401\b", r"\b403\b", r"\bunauthorized\b", r"\bforbidden\b", r"\binvalid_grant\b", r"\baccess denied\b", r"\bauthentication fail", r"\bbad credentials\b"],
    "disk_space": [r"\bENOSPC\b", r"\bno space left\b", r"\bdisk (is )?full\b", r"\bquota exceeded\b"],
    "port_binding": [r"\bEADDRINUSE\b", r"\baddress already in use\b", r"\bport is already allocated\b"],
    "tls_certificate": [r"\bunable to get local issuer\b", r"\bself[- ]signed certificate\b", r"\bcertificate (verify|validation) fail", r"\bSSL certificate problem\b", r"\bCERT_\w+\b"],
    "permission": [r"\bEACCES\b", r"\bEPERM\b", r"\bpermission denied\b", r"\boperation not permitted\b"],
    "network_connect": [r"\bECONNREFUSED\b", r"\bETIMEDOUT\b", r"\bECONNRESET\b", r"\bconnection refused\b", r"\bconnection timed out\b"],
    "out_of_memory": [r"\bheap out of memory\b", r"\bOOM\b", r"\bENOMEM\b", r"\ballocation failed\b"],
    "module_resolution": [r"\bMODULE_NOT_FOUND\b", r"\bERR_MODULE_NOT_FOUND\b", r"\bcannot find module\b", r"\bfailed to resolve (module|import|specifier)\b", r"\bresolveSync\b", r"\bERR_INVALID_ARG_TYPE\b"],
    "database": [r"\brelation \"\w+\" does not exist\b", r"\bdeadlock detected\b", r"\bREADONLY\b.*\breplica\b", r"\b(postgres|postgresql|mysql|sqlite|redis)\b.*\b(error|fail|refus)"],
    "version_conflict": [
        r"\bpeer\s+dep\w*\b[^.\n]{0,60}?\b(?:conflict\w*|mismatch\w*|unmet|unresolved|incompatible|invalid|missing|fail\w*|could\s*not\s+\w+|cannot\s+\w+)\b",
        r"\b(?:conflict\w*|mismatch\w*|unmet|unresolved|incompatible)\b[^.\n]{0,60}?\bpeer\s+dep\w*\b", r"\bERESOLVE\b", r"\bincompatible version\b", r"\bversion mismatch\b",
    ],
}

# Markers of absence, and words that carry no behaviour.
ABSENCE_MARKERS = ["no", "zero", "none", "not", "never", "empty", "missing", "without", "fails? to", "failed to", "did ?n[o']?t", "does ?n[o']?t", "unable to", "cannot", "can ?not", "blank", "nothing"]
BEHAVIOUR_STOP = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "from", "is", "are", "was", "were", "be", "been", "being", "it", "its", "this",
    "that", "these", "those", "there", "here", "any", "all", "some", "more", "most", "very", "just", "only", "also", "even", "still", "yet", "when", "while", "after", "before",
    "then", "than", "so", "if", "as", "my", "our", "your", "their", "his", "her", "i", "we", "you", "they", "he", "she", "get", "gets", "got", "have", "has", "had", "do",
    "does", "did", "can", "could", "will", "would", "should", "may", "might", "must", "up", "out", "off", "over", "under", "again", "back", "one", "two", "new", "old", "same",
    "other", "another", "issue", "problem", "error", "errors", "bug", "reason", "way", "thing", "case",
]

# Areas of a system.
COMPONENTS = [
    "loader", "client", "server", "host", "web", "cli", "plugin", "session", "agent", "sandbox", "gateway", "registry", "runtime", "bundle", "boot", "browser", "module",
    "manifest", "config", "preset", "persistence", "proxy", "terminal", "scheduler",
]

# What is redacted, in this order.
REDACTIONS = [
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", "<redacted:github-token>"),
    (r"\bsk-[A-Za-z0-9_-]{16,}", "<redacted:api-key>"),
    (r"\bxox[abps]-[A-Za-z0-9-]{10,}", "<redacted:slack-token>"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "<redacted:jwt>"),
    (r"(?i)\b(api[_-]?key|secret|password|passwd|token|authorization|cookie)\b\s*[:=]\s*['\"]?[^\s'\"]{6,}", "$1=<redacted>"),
    (r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<redacted:email>"),
    (r"(?i)\b[A-Za-z]:\\Users\\[^\\\s]+", r"C:\\Users\\<user>"),
    (r"(?i)/(?:home|Users)/[^/\s]+", "/home/<user>"),
]

# Directories every package has, and source suffixes.
GENERIC_PATH_DIRS = ["src", "lib", "dist", "build", "out", "bin", "tests", "test", "spec", "packages", "apps", "vendor", "node_modules", "internal"]
SOURCE_SUFFIXES = [".ts", ".tsx", ".js", ".mjs", ".cjs", ".jsx", ".py"]

# Retrieval thresholds and identity weights.
MIN_MATCHED_TOKENS, MIN_SCORE, MIN_COVERAGE, MAX_QUERY_TOKENS, RARE_DOC_FREQ = 2, 8.0, 0.20, 24, 2
CLASS_WEIGHTS = {"subject_package": 3.0, "subject_path": 2.5, "subject_module": 1.5, "subject_dependency": 0.75, "error": 3.0, "structural": 3.0, "behavior": 1.5, "component": 0.5}
MIN_IDENTITY_SCORE = 4.5

# Runtime and system bounds in text.
_RUNTIMES = r"node|nodejs|node\.js|python|deno|bun"
_NUMBER = r"\d+(?:\.\d+){0,2}"
RUNTIME_RANGE = rf"(?i)\b({_RUNTIMES})\s*(?:v|version)?\s*({_NUMBER})\s*(?:-|–|—|~|to|through)\s*({_NUMBER})"
RUNTIME_MIN = rf"(?i)\b({_RUNTIMES})\s*(?:>=|≥|at least)\s*({_NUMBER})"
RUNTIME_MAX = rf"(?i)\b({_RUNTIMES})\s*(?:<=|<|≤|below|before)\s*({_NUMBER})"
RUNTIME_POINT = rf"(?i)\b({_RUNTIMES})\s*(?:v|version)?\s*({_NUMBER})\b"
SYSTEMS = r"(?i)\b(windows|win32|linux|macos|darwin|ubuntu|wsl)\b"
SYSTEM_ALIASES = {"win32": "windows", "darwin": "macos", "ubuntu": "linux", "wsl": "linux"}
SEVERITY = ["direct_match", "compatible_unknown", "possible_contradiction", "unresolved_version", "hard_contradiction"]

# References in text.
REF_URL = r"(?i)https?://github\.com/([\w.-]+)/([\w.-]+)/(discussions|issues|pull|commit|commits|releases|compare)/([^\s)\]>,\"']+)"
REF_NUMBER = r"(?<![\w/&])#(\d{1,7})\b"
REF_SHA = r"(?<![\w/])(?<!0x)(?<!#)\b([0-9a-f]{7,40})\b(?![\w/])"
REF_VERSION = r"(?i)\b(?:in|since|as of|from|until|before|after|fixed in|released in|upgrade to|downgrade to)\s+((?:[a-z][\w.-]*[-@/])?v?\d+\.\d+(?:\.\d+)?(?:[-.][\w.]+)?)"
REF_KINDS = {"discussions": "discussion", "issues": "issue", "pull": "pull_request", "commit": "commit", "commits": "commit", "releases": "release", "compare": "compare"}

# The version of mined features.
FEATURE_EXTRACTOR_VERSION = 16

# File names and folders that name no place by themselves, and paths in prose.
GENERIC_BASENAMES = ["index.ts", "index.tsx", "index.js", "index.mjs", "index.cjs", "types.ts", "utils.ts", "util.ts", "main.ts", "main.js", "mod.ts", "package.json", "tsconfig.json", "readme.md", "__init__.py", "setup.py", "constants.ts", "helpers.ts"]
GENERIC_DIRS = ["src", "lib", "dist", "build", "tests", "test", "packages", "apps"]
PATH_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".go", ".java", ".c", ".cc", ".cpp", ".h"]
PATH_IN_TEXT = r"([\w.@-]+(?:[/\\][\w.@-]+)+\.[A-Za-z]{1,5}\b)"
FILE_IN_TEXT = r"(\b[\w.-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|rs|go)\b)"

# How many candidates, identity checks, references, incidents, releases with documents.
MAX_CANDIDATES, MAX_IDENTITY_CHECKS, MAX_REFERENCES, MAX_INCIDENTS, DOC_RELEASES = 8, 6, 500, 20, 8
HIGH_CONFIDENCE_SCORE = 12.0

# Word classes of predicates and names.
FAILURES = [
    "crash", "crashes", "crashed", "crashing", "fail", "fails", "failed", "failing", "throw", "throws", "threw", "thrown", "throwing", "error",
    "errors", "errored", "break", "breaks", "broke", "broken", "breaking", "hang", "hangs", "hung", "hanging", "panic", "panics", "panicked", "die",
    "dies", "died", "abort", "aborts", "aborted", "regress", "regresses", "regressed",
]
ACTIONS = [
    "load", "loads", "loaded", "loading", "preload", "preloads", "preloaded", "resolve", "resolves", "resolved", "start", "starts", "started", "boot",
    "boots", "booted", "mount", "mounts", "mounted", "render", "renders", "rendered", "respond", "responds", "responded", "return", "returns",
    "returned", "initialize", "initialise", "initializes", "initialised", "initialized", "connect", "connects", "connected", "compile", "compiles",
    "compiled", "build", "builds", "built", "install", "installs", "installed", "appear", "appears", "appeared", "run", "runs", "ran", "launch",
    "launches", "launched", "open", "opens", "opened", "apply", "applies", "applied", "register", "registers", "registered", "emit", "emits",
    "emitted", "find", "finds", "found", "work", "works", "worked", "come", "comes", "came", "show", "shows", "shown", "update", "updates", "updated",
]
HEALTHY = [
    "working", "works", "healthy", "ok", "okay", "fine", "stable", "passing", "passes", "green", "fixed", "resolved", "unaffected", "correct",
    "present", "available", "enabled", "up-to-date",
]
MODULE_NOUNS = [
    "adapter", "agent", "api", "bridge", "cache", "cli", "client", "config", "core", "daemon", "gateway", "harness", "index", "kit", "layer", "lib",
    "module", "package", "parser", "plugin", "preset", "provider", "proxy", "queue", "registry", "runtime", "sdk", "server", "service", "shim",
    "store", "tool", "ui", "util", "worker",
]
