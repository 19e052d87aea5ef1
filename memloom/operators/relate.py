"""Imports, inheritance and calls of source files, as the reference's tree queries name them, from text without comments."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from memloom.operators.parse import language_of, resolve

_STRING = r"""|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
_PYTHON = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<text>[A-Za-z]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|\w+""", re.S)
_BRACES = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/)" + _STRING, re.S)
_TICKS = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)", re.S)
# A quote alone is a lifetime in Rust, so only one character or an escape stands between two.
_RUST = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>r(\#*)".*?"\3|"(?:\\.|[^"\\])*"|'(?:\\[^'\n]+|[^'\\\n])')""", re.S)
_TOKENS = {"python": _PYTHON, "rust": _RUST, "go": _TICKS, "typescript": _TICKS, "javascript": _TICKS, "java": _BRACES, "c": _BRACES, "cpp": _BRACES}

_BLANK = re.compile(r"[^\n]")
_NESTED = {"python": re.compile(r"(?<!\{)\{([^{}]*)\}"), "typescript": re.compile(r"\$\{([^{}]*)\}")}
_NESTED["javascript"] = _NESTED["typescript"]


def _without(language: str, text: str) -> tuple[str, str]:
    """The text with comments blanked, and with strings blanked as well; positions stay.  Expressions in formatted strings stay code."""

    def cut(strings: bool):
        def one(m: re.Match) -> str:
            w = m[0]
            if m.lastgroup != "comment" and m["text"] is None:
                return w
            if m["comment"] is None:
                if not strings:
                    return w
                formatted = "f" in re.match("[A-Za-z]*", w)[0].lower() if language == "python" else w[0] == "`"
                if formatted and language in _NESTED:
                    out, at = [], 0
                    for n in _NESTED[language].finditer(w):
                        out += [_BLANK.sub(" ", w[at : n.start(1)]), w[n.start(1) : n.end(1)]]
                        at = n.end(1)
                    return "".join(out) + _BLANK.sub(" ", w[at:])
            return _BLANK.sub(" ", w)

        return one

    rule = _TOKENS[language]
    return rule.sub(cut(False), text), rule.sub(cut(True), text)


_IMPORT = {
    "python": re.compile(r"^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import\b|import[ \t]+([\w., \t]+))", re.M),
    "go": re.compile(r"^import\s*(?:\(([^)]*)\)|(?:[\w.]+[ \t]+)?([\"`][^\"`\n]+[\"`]))", re.M),
    "typescript": re.compile(r"^[ \t]*import\b(?!\s*[(.])[^;'\"]*?['\"]([^'\"\n]+)['\"]", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use\s+([^;]+);", re.M),
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", re.M),
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*(?:\"([^\"\n]+)\"|(<[^>\n]+>))", re.M),
}
_IMPORT |= {"javascript": _IMPORT["typescript"], "cpp": _IMPORT["c"]}


def _imports(language: str, text: str):
    """(position, path as written)"""
    for m in _IMPORT[language].finditer(text):
        if language == "python" and m[2]:
            for part in m[2].split(","):
                if part.split():
                    yield m.start(), part.split()[0]
        elif language == "go":
            for q in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", m[0]):
                yield m.start() + q.start(), q[1]
        elif language == "rust":
            use = re.sub(r"\s+", " ", m[1]).strip()
            yield m.start(), re.split(r"::\s*\{| as ", use)[0] if not use.startswith("{") else use
        else:
            yield m.start(), m[1] or m[2]


_CHILD = {
    "python": re.compile(r"^[ \t]*class\s+(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*:", re.M),
    "typescript": re.compile(r"\bclass\s+([\w$]+)(?:\s*<[^{}]*?>)?\s+extends\s+([\w$]+)(?![\w$.(])"),
    "java": re.compile(r"\bclass\s+(\w+)(?:\s*<[^{}]*?>)?\s+extends\s+(\w+)(?![\w.<])"),
    "cpp": re.compile(r"\b(?:class)\s+(?:\w+\s+)?(\w+)(?:\s+final)?\s*:(?!:)\s*([^{;]+)\{"),
}
_CHILD["javascript"] = _CHILD["typescript"]
_OFFERS = re.compile(r"\bclass\s+([\w$]+)\b([^{};]*?)\bimplements\s+([^{};]+)\{")
_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl(?:\s*<[^{}]*?>)?\s+!?(\w+)\s+for\s+(\w+)\s*(?=\{|where\b)", re.M)


def _top(text: str) -> list[str]:
    """Parts between the commas that no bracket holds."""
    parts, deep = [""], 0
    for c in text:
        deep += (c in "<([{") - (c in ">)]}")
        if c == "," and deep == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def _parents(language: str, code: str):
    """(position, relation, child, parent); only plain names are parents, as in the reference's queries."""
    if language in _CHILD:
        for m in _CHILD[language].finditer(code):
            parents = _top(m[2])
            if language == "cpp":
                parents = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", p) for p in parents]
            for p in parents:
                if re.fullmatch(r"[A-Za-z_$][\w$]*", p):
                    yield m.start(1), "EXTENDS", m[1], p
    if language in ("typescript", "javascript"):
        for m in _OFFERS.finditer(code):
            for p in _top(m[3]):
                if re.fullmatch(r"[A-Za-z_$][\w$]*", p):
                    yield m.start(1), "IMPLEMENTS", m[1], p
    if language == "rust":
        for m in _IMPL.finditer(code):
            yield m.start(1), "IMPLEMENTS", m[2], m[1]


_NAME = re.compile(r"(?<![\w$#])([A-Za-z_$][\w$]*)[ \t]*(<[\w\s,.\[\]|<>]*>)?\(")
_CONTROL = {
    "python": "and as assert async await case class def del elif else except for from global if import in is lambda nonlocal not or pass raise return while with yield",
    "go": "case chan const defer else for func go if import interface map package range return select struct switch type var",
    "typescript": "async await case catch constructor delete do else export extends for from function if import in instanceof let new of return super switch this throw typeof var void while with yield",
    "rust": "as async await box break crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while Fn FnMut FnOnce",
    "java": "assert case catch do else for if new return super switch synchronized this throw try while yield",
    "c": "alignof case do else for if return sizeof switch typeof while __attribute__ _Alignas _Alignof _Static_assert",
}
_CONTROL["javascript"] = _CONTROL["typescript"]
_CONTROL["cpp"] = _CONTROL["c"] + " alignas catch decltype delete explicit new noexcept operator requires static_assert throw this typeid"
_CONTROL = {k: frozenset(v.split()) for k, v in _CONTROL.items()}
_DECLARES = frozenset("def class function func fn struct enum interface trait record new union".split())
#: Words that may stand right before a call where otherwise a word before a name is its type.
_BEFORE_CALL = frozenset("return else throw case assert do yield co_return co_await co_yield and or not in".split())
_MEMBER = re.compile(r"(?:\.|->|::)\s*$")
_NEW = re.compile(r"\bnew\s+(?:[\w$]+\s*(?:\.|::)\s*)*$")
_MODIFIERS = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|abstract|readonly|declare)\s+|\*\s*)*$")
_TYPED = re.compile(r"^[ \t]*(?:(?!return\b|else\b|throw\b|case\b|delete\b|co_return\b)[\w:]+(?:\s*<[^;()=]*>)?(?:\s*\[\s*\])*[\s*&]+)*(?:(?!return\b)[\w:.]+\s*<[^;()=]*>\s*|(?!return\b)[\w.]+(?:\s*\[\s*\])+\s*)?(?:\w+::~?)*$")


def _closing(code: str) -> dict[int, int]:
    """Position of the closing one for each opening parenthesis."""
    at, stack = {}, []
    for m in re.finditer(r"[()]", code):
        if m[0] == "(":
            stack.append(m.start())
        elif stack:
            at[stack.pop()] = m.start()
    return at


def _blocks(code: str, head: str) -> list[tuple[int, int]]:
    """From the brace after ``head`` to the one that closes it."""
    out = []
    for m in re.finditer(head, code):
        deep = 1
        end = m.end()
        for b in re.finditer(r"[{}]", code[m.end() :]):
            deep += 1 if b[0] == "{" else -1
            if not deep:
                end = m.end() + b.start()
                break
        out.append((m.end(), end))
    return out


def _calls(language: str, code: str):
    """(position, callee): a name or member followed by arguments, unless the place declares it, makes an object or matches a pattern."""
    control, closing = _CONTROL[language], _closing(code)
    script = language in ("typescript", "javascript")
    if language in ("c", "cpp"):
        code = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.)*", lambda m: _BLANK.sub(" ", m[0]), code, flags=re.M | re.S)
    held = _blocks(code, r"\binterface\s*\{") if language == "go" else _blocks(code, r"\benum\s+\w+[^{};]*\{") if language == "rust" else _blocks(code, r"\binterface\s+[^{};]*\{") if script else []
    if language == "rust":
        code = re.sub(r"#!?\[[^\]]*\]", lambda m: _BLANK.sub(" ", m[0]), code)
    at = 0
    while m := _NAME.search(code, at):
        at = m.end(1)
        name, open_ = m[1], m.end() - 1
        if name in control or m[2] and not script:
            continue
        before = code[max(0, m.start() - 400) : m.start()]
        line = before[before.rfind("\n") + 1 :]
        after = code[closing[open_] + 1 : closing[open_] + 80].lstrip() if open_ in closing else ""
        member = bool(_MEMBER.search(before))
        word = re.search(r"([A-Za-z_$][\w$]*)\s*$", before)
        word = word[1] if word else ""
        if word in _DECLARES or _NEW.search(before) or any(a <= m.start() < b for a, b in held):
            continue
        if language == "python":
            if re.match(r"[ \t]*case\b[^:]*$", line):
                continue
        elif language == "go":
            if re.match(r"func\s*\([^)]*\)\s*$", line) or before.endswith("]"):
                continue
        elif script:
            if not member and _MODIFIERS.match(line) and after[:1] in ("{", ":") or word in ("get", "set", "async") and after[:1] == "{":
                continue
        elif language == "rust":
            if after.startswith(("=>", "|")) or re.match(r"if\b[^{};]*=>", after) or re.search(r"\blet\s+(?:[\w:&(,]|\s)*$", line) and re.match(r"\)*\s*=(?!=)", after):
                continue
        elif language == "java":
            if before.endswith("@") or re.search(r"@[\w.]*$", before) or not member and (word and word not in _BEFORE_CALL or after.startswith(("{", "throws")) or re.search(r"[>\]]\s*$", line) and not line.rstrip().endswith("->") and _TYPED.match(line)):
                continue
        else:
            if language == "c" and member or after.startswith(("{", "const", "noexcept", "override")) or not re.search(r"(?:\.|->)\s*$", before) and (word and word not in _BEFORE_CALL or line.strip() and not member and _TYPED.match(line)):
                continue
        yield m.start(1), name


def of_file(language: str, text: str) -> list[tuple[int, str, str | None, str]]:
    """(line, relation, source, target) of one file; ``source`` is the child's name where there is one."""
    if language not in _TOKENS:
        return []
    plain, code = _without(language, text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line = lambda p: bisect_right(starts, p)
    out = [(line(p), "IMPORTS", None, t) for p, t in _imports(language, plain)]
    out += [(line(p), kind, child, parent) for p, kind, child, parent in _parents(language, code)]
    return out + [(line(p), "CALLS", None, name) for p, name in _calls(language, code)]


def relations(files: DataFrame) -> DataFrame:
    """``(space_id, file_path, line, relation, source, target)``: IMPORTS, EXTENDS, IMPLEMENTS and CALLS, a row per place.

    The languages are those the reference has tree queries for, and JavaScript
    as TypeScript.  Its limit of 50 calls a file is not applied.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for space, path, lang, content in zip(pdf["space_id"], pdf["file_path"], pdf["language"], pdf["content"]):
                text = content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
                rows += [(space, path, *r) for r in of_file(lang, text)]
            yield pd.DataFrame(rows, columns=["space_id", "file_path", "line", "relation", "source", "target"])

    known = files.select("space_id", "file_path", language_of(F.col("file_path")).alias("language"), "content").where("content is not null").where(F.col("language").isin(*_TOKENS))
    return known.mapInPandas(run, "space_id string, file_path string, line int, relation string, source string, target string")


def resolve_imports(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Columns of ``resolve``: imports by the end of a path with declarations, x, x.ts or x/index.ts, at 0.8; the first path and its first line.

    Ends are whole path components, so './b' does not find 'ab.ts'.  Each end of
    a path is a row, so the suffix test becomes an equality.
    """
    first = names.groupBy("space_id", F.col("file_path").alias("found_in")).agg(F.min("line").alias("found_line"))
    parts = F.split("found_in", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_end = first.withColumn("end", F.explode(ends))
    clean = F.regexp_replace(F.regexp_replace("target", r"^\./", ""), r"^\.\./", "")
    asked = imports.select("space_id", "file_path", "line", "target").distinct().withColumn("end", F.explode(F.array(clean, F.concat(clean, F.lit(".ts")), F.concat(clean, F.lit("/index.ts")))))
    found = asked.join(by_end, ["space_id", "end"]).groupBy("space_id", "file_path", "line", "target").agg(F.min(F.struct("found_in", "found_line")).alias("f"))
    return found.select("space_id", "file_path", "line", "target", F.col("f.found_in").alias("found_in"), F.col("f.found_line").alias("found_line"), F.lit("import_suffix").alias("method"), F.lit(0.8).alias("confidence"))


def resolve_all(found: DataFrame, names: DataFrame) -> DataFrame:
    """``resolve`` for calls, parents and interfaces and ``resolve_imports`` for imports, with the relation."""
    key = ["space_id", "file_path", "line", "target"]
    others = found.where("relation <> 'IMPORTS'").select(*key, "relation").distinct()
    named = resolve(others.select(*key).distinct(), names).join(others, key)
    imports = resolve_imports(found.where("relation = 'IMPORTS'"), names).withColumn("relation", F.lit("IMPORTS"))
    return named.unionByName(imports)
