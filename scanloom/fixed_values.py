"""Fixed values. Every table here must hold exactly these entries for scan results to be right."""

EXTENSION_LANGUAGE = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".php": "php", ".phtml": "php", ".php3": "php", ".php4": "php", ".php5": "php",
    ".py": "python", ".pyw": "python",
    ".java": "java",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".cs": "csharp",
    ".go": "go",
    ".rb": "ruby",
    ".kt": "kotlin", ".kts": "kotlin",
    ".swift": "swift",
    ".scala": "scala",
    ".rs": "rust",
    ".sh": "bash", ".bash": "bash",
    ".ps1": "powershell", ".psm1": "powershell",
    ".sql": "sql",
    ".html": "html", ".htm": "html",
    ".css": "css",
    ".xml": "xml",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".tf": "terraform", ".tfvars": "terraform",
    ".dart": "dart",
}

# Language -> names under which rules may be filed for it, in lookup order.
LANGUAGE_KEYS = {
    "javascript": ["javascript", "js"],
    "typescript": ["javascript", "js", "typescript", "ts"],
    "php": ["php"],
    "python": ["python"],
    "java": ["java"],
    "c": ["c"],
    "cpp": ["cpp", "c++"],
    "csharp": ["csharp", "c#"],
    "go": ["go", "golang"],
    "ruby": ["ruby", "rb"],
    "kotlin": ["kotlin", "kt"],
    "swift": ["swift"],
    "scala": ["scala"],
    "rust": ["rust"],
    "bash": ["bash", "shell", "sh"],
    "powershell": ["powershell", "ps1"],
    "sql": ["sql"],
    "html": ["html"],
    "css": ["css"],
    "xml": ["xml"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "dockerfile": ["dockerfile"],
    "terraform": ["terraform", "tf"],
    "dart": ["dart"],
}

DOCKERFILE_NAMES = ["dockerfile", "dockerfile.dev", "dockerfile.prod", "containerfile"]

SKIP_DIRS = [
    ".git", "node_modules", "vendor", "__pycache__", ".venv", "venv",
    "env", ".env", "dist", "build", ".next", "target", "bin", "obj",
    ".gradle", ".idea", ".vscode", "coverage", ".pytest_cache",
]

# Content tests for files whose name says nothing, tried in this order: (regex, Java flags, language).
CONTENT_LANGUAGE = [
    (r"<\?php", "iu", "php"),
    (r"^FROM\s+\S+", "m", "dockerfile"),
    (r"(import\s+\w+|from\s+\w+|def\s+\w+|class\s+\w+:)", "", "python"),
    (r"(function|const|let|var|export|import)", "", "javascript"),
]

SEVERITY_WEIGHT = {"Critical": 10, "High": 5, "Medium": 2, "Low": 1}
SEVERITY_ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
UNKNOWN_SEVERITY_ORDER = 99

GRADE_FLOORS = [(95, "A+"), (85, "A"), (75, "B"), (60, "C"), (40, "D")]
LOWEST_GRADE = "F"

MATCH_TYPES = ["single-line", "multi-line", "secret", "dependency"]

MANIFEST_FILES = [
    "package.json", "requirements.txt", "requirements-dev.txt", "go.mod", "cargo.toml",
    "composer.json", "pom.xml", "build.gradle",
]

# Manifests for which a scan exists, by ecosystem.
MANIFEST_ECOSYSTEM = {
    "package.json": "npm",
    "requirements.txt": "pypi",
    "requirements-dev.txt": "pypi",
    "requirements-test.txt": "pypi",
    "go.mod": "go",
    "cargo.toml": "cargo",
}

ECOSYSTEM_RULE_PREFIX = {"npm": "DEP-NPM-", "pypi": "DEP-PY-", "go": "DEP-GO-", "cargo": "DEP-RUST-"}

UNPINNED_VERSIONS = ["*", "latest", "next", "canary", "", "x"]

DEPENDENCY_CWE = "CWE-1104"
DEPENDENCY_OWASP = "A06:2021 – Vulnerable and Outdated Components"

CUSTOM_RULE_DEFAULTS = {
    "id": "CUSTOM-000", "name": "Custom Rule", "category": "Custom", "severity": "Medium",
    "description": "", "remediation": "",
}

SCAN_TYPE_LABELS = {
    "single_file": "Single File",
    "multi_file": "Multi File",
    "zip": "ZIP Archive",
    "repository": "Repository",
    "text": "Code Snippet",
}

HISTORY_KEEP = 50
TREND_SCANS = 7
FIRST_FINDINGS = 20
TOP_LANGUAGES = 8

# Kinds of scan whose reports list the language rules' findings of all files before all other findings.
CODE_FIRST_SCANS = ["zip", "repository"]
