"""Line rules by language: what a line declares and under which name.

Each rule is (kind, pattern) with the name as the only group; the first rule of
a language that matches a line counts.  Patterns keep to what both Java's and
RE2's regular expressions understand, so the same table makes Spark columns and SQL.
"""

from __future__ import annotations

ID = r"([A-Za-z_$][A-Za-z0-9_$]*)"

_C = [
    ("macro", rf"^\s*#\s*define\s+{ID}"), ("struct", rf"^\s*(?:typedef\s+)?struct\s+{ID}"), ("enum", rf"^\s*(?:typedef\s+)?enum(?:\s+class)?\s+{ID}"), ("type", rf"^\s*typedef\s+.*[\s\*]{ID}\s*;"),
    ("function", rf"^(?:static\s+|inline\s+|extern\s+|const\s+|unsigned\s+|struct\s+)*[A-Za-z_][A-Za-z0-9_:<>]*[\s\*&]+{ID}\s*\([^;]*$"),
]
_CPP = [("namespace", rf"^\s*namespace\s+{ID}"), ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{ID}"), *_C]
_JVM = [("class", rf"^\s*(?:(?:public|private|protected|internal|abstract|final|static|sealed|partial|open|data)\s+)*class\s+{ID}"), ("interface", rf"^\s*(?:(?:public|private|protected|internal)\s+)*interface\s+{ID}"), ("enum", rf"^\s*(?:(?:public|private|protected|internal)\s+)*enum(?:\s+class)?\s+{ID}")]
_METHOD = ("method", rf"^\s*(?:public|private|protected|internal)\s+(?:(?:static|final|abstract|async|override|virtual|synchronized)\s+)*[A-Za-z_][A-Za-z0-9_<>\[\], ?]*\s+{ID}\s*\(")
_CONST = ("constant", rf"^\s*(?:(?:public|private|protected|internal)\s+)*(?:static\s+final|const|static\s+readonly)\s+[A-Za-z_][A-Za-z0-9_<>\[\]]*\s+{ID}\s*=")
_SCRIPT = [
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{ID}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{ID}"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{ID}"), ("type", rf"^\s*(?:export\s+)?type\s+{ID}\s*="),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{ID}"), ("function", rf"^(?:export\s+)?const\s+{ID}\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("constant", rf"^(?:export\s+)?const\s+{ID}\s*[:=]"),
]
_KEYED = ("section", r"^\s*\[+\s*([^\]]+?)\s*\]+")

LANGUAGES: dict[str, list[tuple[str, str]]] = {
    "python": [("class", rf"^class\s+{ID}"), ("method", rf"^\s+(?:async\s+)?def\s+{ID}"), ("function", rf"^(?:async\s+)?def\s+{ID}"), ("constant", r"^([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=")],
    "go": [("method", rf"^func\s+\([^)]*\)\s*{ID}"), ("function", rf"^func\s+{ID}"), ("struct", rf"^type\s+{ID}\s+struct"), ("interface", rf"^type\s+{ID}\s+interface"), ("type", rf"^type\s+{ID}"), ("constant", rf"^const\s+{ID}"), ("var", rf"^var\s+{ID}")],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{ID}"), ("struct", rf"^\s*(?:pub\s+)?struct\s+{ID}"), ("enum", rf"^\s*(?:pub\s+)?enum\s+{ID}"), ("trait", rf"^\s*(?:pub\s+)?trait\s+{ID}"), ("constant", rf"^\s*(?:pub\s+)?(?:const|static)\s+{ID}"), ("macro", rf"^\s*macro_rules!\s+{ID}"), ("type", rf"^\s*(?:pub\s+)?type\s+{ID}")],
    "java": [*_JVM, _CONST, _METHOD],
    "kotlin": [*_JVM, ("object", rf"^\s*(?:companion\s+)?object\s+{ID}"), ("function", rf"^\s*(?:(?:public|private|protected|internal|override|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[A-Za-z0-9_]+\.)?{ID}"), ("constant", rf"^\s*const\s+val\s+{ID}")],
    "csharp": [("namespace", r"^\s*namespace\s+([A-Za-z0-9_.]+)"), *_JVM, ("struct", rf"^\s*(?:(?:public|private|internal|readonly)\s+)*struct\s+{ID}"), _CONST, _METHOD],
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "c": _C,
    "cpp": _CPP,
    "cuda": [("kernel", rf"^\s*__global__\s+\w+\s+{ID}"), ("function", rf"^\s*__(?:device|host)__\s+\w+\s+{ID}"), *_CPP],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([A-Za-z_][A-Za-z0-9_.:]*)"), ("constant", r"^\s*local\s+([A-Z][A-Z0-9_]+)\s*=")],
    "shell": [("function", rf"^\s*(?:function\s+)?{ID}\s*\(\)"), ("function", rf"^\s*function\s+{ID}"), ("constant", r"^(?:export\s+|readonly\s+)?([A-Z][A-Z0-9_]+)=")],
    "sql": [("table", r"(?i)^\s*create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([A-Za-z0-9_.\"]+)"), ("view", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+([A-Za-z0-9_.\"]+)"), ("index", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([A-Za-z0-9_.\"]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([A-Za-z0-9_.\"]+)")],
    "cypher": [("constraint", rf"(?i)^\s*create\s+constraint\s+{ID}"), ("index", rf"(?i)^\s*create\s+(?:vector\s+|fulltext\s+)?index\s+{ID}"), ("label", rf"\(\s*[a-z0-9_]*\s*:\s*{ID}")],
    "graphql": [("type", rf"^\s*(?:extend\s+)?type\s+{ID}"), ("input", rf"^\s*input\s+{ID}"), ("enum", rf"^\s*enum\s+{ID}"), ("interface", rf"^\s*interface\s+{ID}"), ("scalar", rf"^\s*scalar\s+{ID}"), ("union", rf"^\s*union\s+{ID}")],
    "protobuf": [("message", rf"^\s*message\s+{ID}"), ("service", rf"^\s*service\s+{ID}"), ("enum", rf"^\s*enum\s+{ID}"), ("rpc", rf"^\s*rpc\s+{ID}")],
    "terraform": [("resource", r"^\s*resource\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("data", r"^\s*data\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("variable", r"^\s*variable\s+\"([^\"]+)\""), ("output", r"^\s*output\s+\"([^\"]+)\""), ("module", r"^\s*module\s+\"([^\"]+)\"")],
    "dockerfile": [("stage", r"(?i)^from\s+\S+\s+as\s+(\S+)"), ("image", r"(?i)^from\s+(\S+)"), ("argument", rf"(?i)^arg\s+{ID}"), ("variable", rf"(?i)^env\s+{ID}")],
    "makefile": [("constant", r"^([A-Z][A-Z0-9_]+)\s*[:?+]?="), ("target", r"^([A-Za-z0-9_.-]+)\s*:(?:[^=]|$)")],
    "ini": [_KEYED, ("key", r"^\s*([A-Za-z0-9_.-]+)\s*[=:]")],
    "toml": [_KEYED, ("key", r"^\s*([A-Za-z0-9_.\"-]+)\s*=")],
    "yaml": [("key", r"^([A-Za-z0-9_.-]+)\s*:")],
    "openapi": [("path", r"^\s{2}(/[^:\s]*)\s*:"), ("key", r"^([A-Za-z0-9_.-]+)\s*:")],
    "json": [("key", r"^\s{0,4}\"([^\"]+)\"\s*:")],
    "xml": [("element", r"^\s*<([A-Za-z_][A-Za-z0-9_.:-]*)")],
    "markdown": [("heading", r"^#{1,6}\s+(.+?)\s*$")],
    "css": [("selector", r"^\s*([.#]?[A-Za-z][A-Za-z0-9_-]*)[^{};]*\{")],
}
EXTENSIONS = {
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cu": "cuda", "lua": "lua", "sh": "shell", "bash": "shell", "sql": "sql", "cypher": "cypher", "graphql": "graphql", "proto": "protobuf", "tf": "terraform", "dockerfile": "dockerfile", "makefile": "makefile", "mk": "makefile", "ini": "ini", "cfg": "ini", "toml": "toml",
    "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "md": "markdown", "css": "css",
}
