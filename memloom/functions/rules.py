"""Rule tables for texts: all fixed values, as they must agree with stored results word for word."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CODE = [" class", "class ", " function", "function ", " method", "method ", " struct", "struct ", " interface", "interface ", " def ", "def ", "implementation of", "defined in", "definition of", "where is .* defined", "where is .* located", " source code", "signature", "parameters", "return type"]
CODE_EDGES = ["class", "function", "method", "struct", "interface"]
ARCHITECTURE = ["architecture", "design", "pattern", "structure", "overview", "module", "service", "component", "layer", "system", "workflow", "responsibility", "concern", "abstraction"]
RELATIONSHIP = ["relationship between", "interact", "dependency", "depends on", "calls", "invokes", "connects to", "linked to", "references", "uses", "imports", "requires", "communicates with", "coupling", "integration", "interface between", "how does .* connect", "how does .* interact", "what calls", "what uses", "what depends"]
DATA_FLOW = ["data flow", "data flows", "flows through", "passed to", "transforms", "transformation", "pipeline", "processing", "input", "output", "request", "response", "payload", "how is .* processed", "where does .* come from", "what happens to", "path of", "journey of", "state", "propagate", "dispatch", "emit", "publish", "subscribe", "event", "message", "queue"]
SYMBOL = ["where is", "find", "locate", "show me", "definition of", "implementation of", "what file", "which file", "in what file"]
SYMBOL_SHAPE = r"[A-Z][a-z]+[A-Z][a-z]+|[a-z]+_[a-z]+_[a-z]+"
#: type: (seeds, hops, vector weight, text weight, expansion)
HINTS = {"symbol_lookup": (30, 1, 0.85, 0.15, False), "code": (40, 1, 0.75, 0.25, True), "relationship": (60, 2, 0.6, 0.4, True), "data_flow": (50, 2, 0.65, 0.35, True), "architecture": (60, 2, 0.55, 0.45, True), "generic": (50, 2, 0.7, 0.3, True)}

SOFT_TEMPORAL = ["recent", "recently", "latest", "newest", "what changed", "what's new", "whats new", "updates to", "updated", "new changes", "latest changes", "recent changes"]

CONCERNS = {
    "authentication": ["auth", "login", "logout", "signin", "signout", "session", "token", "jwt", "oauth", "msal", "azure-ad", "passport"],
    "authorization": ["acl", "rbac", "permission", "role", "guard", "policy", "access-control", "authorize", "can-activate"],
    "error-handling": ["error", "exception", "filter", "catch", "handler", "fault", "failure", "recovery"],
    "validation": ["validat", "schema", "dto", "constraint", "sanitize", "class-validator", "joi", "zod"],
    "logging": ["logger", "logging", "log", "audit", "trace", "monitor"],
    "caching": ["cache", "redis", "memcache", "ttl", "invalidat"],
    "temporal": ["validfrom", "validto", "valid_from", "valid_to", "effectivedate", "effective_date", "expirationdate", "expiration_date", "startdate", "start_date", "enddate", "end_date", "createdat", "created_at", "updatedat", "updated_at", "deletedat", "deleted_at", "softdelete", "soft_delete", "paranoid", "temporal", "bitemporal", "versioned", "daterange", "date_range", "timerange", "time_range", "historiz", "audit_trail", "snapshot"],
}
CONFIG_PATHS = ["config", "settings", "options", "constants", "types", ".env", "conf", "yaml", "yml", "json", "toml"]

CONSTRAINTS = {
    "must": [(r"\bmust\b", 0.7), (r"\balways\b", 0.65), (r"\brequired\b", 0.75), (r"\bhave to\b", 0.65), (r"\bneed to ensure\b", 0.7), (r"\bmandatory\b", 0.8)],
    "must_not": [(r"\bnever\b", 0.75), (r"\bdon'?t\b", 0.55), (r"\bmust not\b", 0.8), (r"\bforbidden\b", 0.85), (r"\bavoid\b", 0.6), (r"\bcan'?t use\b", 0.65), (r"\bnot allowed\b", 0.75), (r"\bprohibited\b", 0.85)],
    "should": [(r"\bshould\b", 0.55), (r"\bprefer\b", 0.5), (r"\brecommended\b", 0.6), (r"\bbest practice\b", 0.65), (r"\bideally\b", 0.5)],
    "should_not": [(r"\bshould not\b", 0.6), (r"\btry to avoid\b", 0.55), (r"\bdiscouraged\b", 0.65), (r"\bshouldn'?t\b", 0.6)],
    "deadline": [(r"\bby\s+\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", 0.8), (r"\bbefore\s+\w+\s+\d{1,2}", 0.7), (r"\bdue\s+(date|by)\b", 0.75), (r"\bdeadline\b", 0.8), (r"\btarget date\b", 0.75)],
}

SOURCES = {
    "slack": r"slack://\S+|slack channel|slack message|in slack|from slack", "jira": r"jira://\S+|jira ticket|jira issue|in jira|from jira", "confluence": r"confluence://\S+|confluence page|confluence doc|in confluence",
    "github": r"github\.com/\S+|github issue|github pr|pull request", "gitlab": r"gitlab\.com/\S+", "notion": r"notion\.so/\S+|notion page|notion doc", "linear": r"linear\.app/\S+|linear issue|linear ticket", "asana": r"asana\.com/\S+",
    "trello": r"trello\.com/\S+", "google_docs": r"docs\.google\.com/\S+", "google_drive": r"drive\.google\.com/\S+", "dropbox": r"dropbox\.com/\S+", "figma": r"figma\.com/\S+",
}

RISK = ["error", "fail", "issue", "problem", "bug", "fix", "workaround", "hack", "todo", "deprecated"]
PROCESS = ["workflow", "process", "step", "guide", "howto", "readme", "doc", "procedure"]
CONCEPT = ["pattern", "architecture", "design", "concept", "abstract", "interface", "protocol"]

QUERY_STOP = "the a an is are what how why where when do does did can could should would to for in on at by with about this that these those".split()
KEYWORD_STOP = (
    "the a an and or but is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by from as into through that which who whom this these those it its they them their "
    "we us our you your he she him her his hers i me my not no yes if then else when where why how all each every both few more most other some such only own same so than too very just also now use used using"
).split()

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def contains_any(text: Column, values: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in values]), lambda v: text.contains(v))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def contains_any_sql(column: str, values: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(v)})" for v in values) + ")"

TRIGGERS = {
    "error_handling": ["try", "catch", "error", "exception", "throw", "panic", "recover"], "authentication": ["auth", "login", "logout", "token", "jwt", "session", "password"],
    "database": ["query", "select", "insert", "update", "delete", "transaction", "sql", "db."], "api": ["endpoint", "route", "handler", "request", "response", "http", "rest", "graphql"],
    "testing": ["test", "spec", "mock", "stub", "assert", "expect", "describe", "it("], "config": ["config", "env", "environment", "setting", "option", "flag"],
    "async": ["async", "await", "promise", "callback", "observable", "concurrent"], "security": ["encrypt", "decrypt", "hash", "salt", "sanitize", "escape", "xss", "csrf"],
}
VAGUE = ["thing", "things", "stuff", "something", "somehow", "somewhere", "sometime", "maybe", "probably", "might", "basically", "essentially", "generally", "etc", "whatever"]
PATH_SIGNS = [".go", ".py", ".ts", ".js", ".md", ".yaml", ".yml", ".json", "http://", "https://", "internal/", "cmd/"]
