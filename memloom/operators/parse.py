"""Symbols, imports and calls of source files, and sections of pages, by line rules that stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from memloom.functions.languages import EXTENSIONS, LANGUAGES


def language_of(path: Column) -> Column:
    """By extension, or by the whole name for files without one; null if unknown."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    ext = F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]+)$", 1)).otherwise(name)
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def lines(files: DataFrame) -> DataFrame:
    """(space_id, file_path, language, line, text) of (space_id, file_path, content); byte-order marks and any line ends are taken off."""
    clean = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n")
    at = files.where("content is not null").select("space_id", "file_path", language_of(F.col("file_path")).alias("language"), F.posexplode(F.split(clean, "\n")).alias("line", "text"))
    return at.withColumn("line", F.col("line") + 1)


_DOC = re.compile(r"^\s*(//|#|\*|/\*|--)")
_EXPORT = {"typescript": re.compile(r"^\s*export\b"), "rust": re.compile(r"^\s*pub\b"), "java": re.compile(r"^\s*public\b")}
_EXPORT |= {"javascript": _EXPORT["typescript"], "csharp": _EXPORT["java"], "kotlin": _EXPORT["java"]}


def declarations(language: str, text: str) -> list[tuple[int, str, str, bool, bool]]:
    """(line, kind, name, exported, doc) of one file."""
    rules = [(kind, re.compile(p)) for kind, p in LANGUAGES.get(language, [])]
    out, before = [], ""
    for n, line in enumerate(text.split("\n"), 1):
        for kind, p in rules:
            m = p.search(line)
            if m and m[1]:
                name = m[1]
                exported = name[:1].isupper() if language == "go" else not name.startswith("_") if language == "python" else bool(_EXPORT[language].search(line)) if language in _EXPORT else True
                out.append((n, kind, name, exported, bool(_DOC.search(before))))
                break
            if m:
                break
        before = line
    return out


def symbols(files: DataFrame) -> DataFrame:
    """``(space_id, file_path, language, line, kind, name, exported, doc)``: what each line of a file declares.

    The rules of thirty languages in one generated function would be more than
    the JVM compiles, so files go to Python workers in Arrow batches and only
    declarations come back.  Files of unknown language or without content give
    nothing.  ``exported`` follows the language: an export or pub word, a capital
    in Go, no leading underscore in Python.  ``doc``: the line before is a comment.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for space, path, lang, content in zip(pdf["space_id"], pdf["file_path"], pdf["language"], pdf["content"]):
                text = content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
                rows += [(space, path, lang, *d) for d in declarations(lang, text)]
            yield pd.DataFrame(rows, columns=["space_id", "file_path", "language", "line", "kind", "name", "exported", "doc"])

    known = files.select("space_id", "file_path", language_of(F.col("file_path")).alias("language"), "content").where("language is not null and content is not null")
    return known.mapInPandas(run, "space_id string, file_path string, language string, line int, kind string, name string, exported boolean, doc boolean")


IMPORT = r"^\s*(?:import\s+.*from\s+['\"]([^'\"]+)['\"]|from\s+([\w.]+)\s+import|use\s+([\w:]+)|import\s+([\w.]+)\s*;|\"([\w./-]+)\"\s*$)"
CALL = r"(?:this|self|s)\.([A-Za-z_]\w*)\("


def relations(files: DataFrame) -> DataFrame:
    """``(space_id, file_path, line, relation, target)``: IMPORTS and CALLS by line."""
    x = lines(files)
    imports = x.select("space_id", "file_path", "line", F.lit("IMPORTS").alias("relation"), F.coalesce(*[F.nullif(F.regexp_extract("text", IMPORT, g), F.lit("")) for g in range(1, 6)]).alias("target")).where("target is not null")
    calls = x.select("space_id", "file_path", "line", F.lit("CALLS").alias("relation"), F.explode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("target"))
    return imports.unionByName(calls)


def resolve(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``(space_id, file_path, line, target, found_in, found_line, method, confidence)``: the best place a called name is declared.

    Same file 1.0, else a file below the same folder 0.9, else the only place in
    the space 0.5; among equals the first path and line.  Names that stay
    unresolved give no row.
    """
    folder = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    decl = names.select("space_id", F.col("name").alias("target"), F.col("file_path").alias("found_in"), F.col("line").alias("found_line"))
    once = decl.groupBy("space_id", "target").agg(F.count("*").alias("places"), F.min(F.struct("found_in", "found_line")).alias("first"))
    same = decl.groupBy("space_id", "target", "found_in").agg(F.min("found_line").alias("found_line"))
    c = calls.select("space_id", "file_path", "line", "target").withColumn("dir", folder(F.col("file_path")))
    in_file = c.join(same.withColumnRenamed("found_in", "file_path"), ["space_id", "target", "file_path"]).select("space_id", "file_path", "line", "target", F.col("file_path").alias("found_in"), "found_line", F.lit("same_file").alias("method"), F.lit(1.0).alias("confidence"))
    # Every folder above a declaration can be the caller's folder, so the prefix test becomes an equality.
    parts = F.split(folder(F.col("found_in")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = same.withColumn("dir", F.explode(above)).groupBy("space_id", "target", "dir").agg(F.min(F.struct("found_in", "found_line")).alias("f"))
    near = c.join(below, ["space_id", "target", "dir"]).select("space_id", "file_path", "line", "target", F.col("f.found_in").alias("found_in"), F.col("f.found_line").alias("found_line"), F.lit("same_package").alias("method"), F.lit(0.9).alias("confidence"))
    alone = c.join(once.where("places = 1"), ["space_id", "target"]).select("space_id", "file_path", "line", "target", F.col("first.found_in").alias("found_in"), F.col("first.found_line").alias("found_line"), F.lit("global_unique").alias("method"), F.lit(0.5).alias("confidence"))
    offers = in_file.unionByName(near).unionByName(alone)
    best = Window.partitionBy("space_id", "file_path", "line", "target").orderBy(F.desc("confidence"), "found_in", "found_line")
    return offers.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").distinct()


def specificity(kind: Column, name: Column, exported: Column, doc: Column) -> Column:
    caps = name.rlike("^[A-Z0-9_]{2,}$") & name.contains("_")
    return F.least(F.lit(1.0), 0.5 + F.when(kind == "constant", 0.2).otherwise(0.0) + F.when(caps, 0.15).otherwise(0.0) + F.when(exported, 0.1).otherwise(0.0) + F.when(doc, 0.1).otherwise(0.0))


_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def split_sections(text: str, whole_below: int = 2000, least: int = 100) -> list[tuple[str, str]]:
    """(heading, content) of a page: whole if short, else cut at second-level headings, small sections merged forward."""
    if len(text.split()) < whole_below:
        return [("", text.strip())]
    parts: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m and len(m[1]) >= 2:
            parts.append((m[2].strip(), []))
        else:
            parts[-1][1].append(line)
    rows = [(h, "\n".join(b).strip()) for h, b in parts]
    if not rows[0][0] and not parts[0][1]:
        rows = rows[1:]
    out: list[tuple[str, str]] = []
    carry = ("", "")
    for i, (h, body) in enumerate(rows):
        if carry != ("", ""):
            h = " / ".join(x for x in (carry[0], h) if x)
            body = "\n\n".join(x for x in (carry[1], body) if x)
            carry = ("", "")
        if len(body.split()) < least and i + 1 < len(rows):
            carry = (h, body)
        else:
            out.append((h, body))
    return out


def sections(pages: DataFrame, whole_below: int = 2000, least: int = 100) -> DataFrame:
    """``(id, section, heading, content)`` of (id, text); null and empty texts give nothing."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k, h, c) for i, t in zip(pdf["id"], pdf["text"]) if t and t.strip() for k, (h, c) in enumerate(split_sections(t.replace("\r\n", "\n"), whole_below, least))]
            yield pd.DataFrame(rows, columns=["id", "section", "heading", "content"])

    kind = dict(pages.dtypes)["id"]
    return pages.select("id", "text").mapInPandas(run, f"id {kind}, section int, heading string, content string")
