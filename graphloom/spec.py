"""Fixed values of the specification.

Every list, pattern and number here has to equal the reference tool's for results to agree with it. They are stated as
they are, in their natural order; the logic that uses them is elsewhere and this library's own.
"""

# ---- files

LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx"}
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv",
    "env", ".env", "dist", "build", ".next", ".tox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "egg-info",
]
MAX_FILES = 5000
#: Git's own; the reference's constant ends otherwise, names no object, and fails on a first commit.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
LOC_SUFFIXES = [".py", ".js", ".ts", ".tsx"]
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".tsx", ".jsx"]

# ---- names

SECURITY_KEYWORDS = [
    "auth", "authenticate", "authorise", "authorize",
    "validate", "sanitize", "sanitise", "verify", "check",
    "guard", "protect", "rate_limit", "csrf", "xss", "escape",
    "hash", "encrypt", "permission", "require", "restrict",
]
GATE_KEYWORDS = [
    "check_permission", "has_permission", "is_authorized", "is_allowed",
    "authorize", "authorise", "authenticate", "can_access", "check_access",
    "check_auth", "require_permission", "verify", "validate", "ensure_",
]
SQL_EXECUTE = ["execute", "executescript", "executemany"]
WEAK_HASHES = ["md5", "sha1"]
OTHER_SINKS = [
    "eval", "exec", "popen", "system", "spawn", "fork", "compile",
    "loads", "load", "call", "run", "check_output", "Popen",
    "__import__", "getattr", "setattr",
]

# ---- comment boundaries in diffs: opener, closer, language, what it is

COMMENT_BOUNDARIES = [
    ('"""', '"""', "Python", "multiline string / docstring opener"),
    ("'''", "'''", "Python", "multiline string opener"),
    ("/*", "*/", "C-style", "block comment opener (JS/TS/Java/Go/C/C++)"),
    ("#=", "=#", "Julia", "block comment opener"),
    ("--[[", "]]", "Lua", "block comment opener"),
    ("=begin", "=end", "Ruby", "block comment opener"),
    ("<!--", "-->", "HTML/XML", "comment opener"),
]
EXECUTABLE = [
    r"(async\s+)?def\s+\w+",
    r"class\s+\w+",
    r"@\w[\w.]*",
    r"(from\s+\S+\s+)?import\s+\S+",
    r"\w[\w.]*\s*=[^=]",
    r"\w[\w.]*\s*\(",
    r"(return|raise|await|yield|with|for|while|if|elif|else|try)\b",
]
EXECUTABLE_BRACES = [
    r"function\s+\w*\s*\(",
    r"\b\w+\s*=>",
    r"\b(var|let|const)\s+\w+",
    r"\w[\w.]*\s*\(",
    r"\breturn\b",
]

# ---- authorship signals

SIGNAL_WEIGHTS = {
    "bulk_addition": 0.2,
    "boilerplate_density": 0.15,
    "uniform_style": 0.1,
    "complete_functions": 0.15,
    "missing_edge_cases": 0.15,
    "generated_comments": 0.1,
    "commit_message": 0.15,
}
BOILERPLATE_LINES = ["try:", "except:", "except Exception:", "except Exception as e:", "finally:", "raise", "pass"]
FUNCTION_START = r"^[\+\s]*(def |function |const \w+ = (?:async )?\(|class )"
DEFENSIVE_PATTERNS = [
    r"if\s+\w+\s*(is None|== None|is not None|!= None|\?\?)",
    r"if\s+(not\s+)?\w+\s*:",
    r"\.get\(",
    r"try\s*:",
    r"except\s+\w+",
    r"if\s+len\(",
    r"assert\s+",
    r"raise\s+\w+Error",
    r"timeout",
    r"max_retries",
]
RISKY_PATTERNS = [
    r"\[\w+\]",
    r"\.read\(",
    r"\.write\(",
    r"\.execute\(",
    r"requests?\.(get|post|put|delete)\(",
    r"open\(",
    r"json\.loads?\(",
    r"int\(|float\(",
]
COMMENT_PATTERNS = [
    r"#\s*-{3,}",
    r"//\s*-{3,}",
    r"#\s*TODO:?\s*(implement|add|fix|handle)",
    r"#\s*(Here'?s?|This|The following|Below)",
    r"#\s*\w+ function",
    r"#\s*Import",
    r"#\s*(Initialize|Setup|Configure|Create)\s+(the|a)\s+",
    r"\"\"\"[\s\S]{0,50}\.\s*\n\s*\n\s*(Args|Returns|Raises|Parameters|Example)",
]
MESSAGE_PATTERNS = [
    r"^(add|create|implement|update|fix|refactor)\s+\w+",
    r"Co-Authored-By:.*claude|copilot|cursor|ai|anthropic",
    r"generated|auto-generated|ai-generated",
    r"^Initial (commit|implementation|setup)",
]
MESSAGE_NAMES = r"claude|anthropic|copilot|cursor"

# ---- categories of findings

CATEGORY_NEEDLES = {
    "sql": ["sql injection", "sqli", "sql"],
    "command": ["command injection", "os command", "shell injection", "command execution", "rce"],
    "codeexec": ["code injection", "arbitrary code", "code execution", "eval(", "remote code"],
    "deserial": ["deserial", "pickle", "unsafe yaml", "yaml.load", "insecure deserialization", "object injection"],
    "injection": ["injection"],
    "auth": ["auth", "authz", "authn", "permission", "access control", "privilege", "authoriz"],
    "crypto": ["crypto", "secret", "weak hash", "md5", "sha1", "password storage", "weak cipher"],
    "xxe": ["xxe", "xml external", "external entit"],
    "ssti": ["ssti", "template injection", "server-side template"],
    "ssrf": ["ssrf", "server-side request"],
    "xss": ["xss", "cross-site script"],
    "path": ["path traversal", "directory traversal"],
    "race": ["race condition"],
}
INJECTION_FAMILY = ["sql", "command", "codeexec", "deserial", "xxe", "ssti"]
FINDING_LOCATION = r"\*\*Location:\*\*\s*`?([^\n:`]+):(\d+)"
FINDING_PLACE = r"([\w/._-]+\.(?:py|js|ts|tsx)):(\d+)"
