"""Generated, minified, vendored and data files among source code, by grammar inference.

Method: a file's tokens become two sequences, of shapes (names, numbers and
strings stand for their kind) and of words, and a Re-Pair grammar is inferred
over each.  Three of its figures decide:

- *reuse*: a grammar of one form repeated grows with the logarithm of the length,
  that of written code with about its square root.  Files whose shapes shrink
  below that are generated.  Phrases of comments and parts of paths that stand
  mostly in such files, in more than one repository, are the marks of their tools,
  and a file that bears one is generated too, however its code looks.
- *literals*: what the word grammar still writes of the literals in tables and
  split texts.  Near-incompressible literals that outweigh the rest are data.
- *sharing*: passages of words, and names of libraries in paths, that recur in
  other repositories.  Files made of the first, or lying in folders that hold
  the second, are vendored.

Minified code is told by its names of one letter and its long lines.  What tools
and people say in comments, names and folders is a supplement that can be turned
off, for collections too small to show a tool's marks (``tools``) and for copies
of which no second one is at hand (``copies``).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from memloom.llm.workers import batched
from memloom.sources.shared import materialize
from memloom.sources.small import enough_tasks, join_small

_OTHER = r"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?|[^\W\d]\w*|[^\w\s]"""
_TOKEN = re.compile(r"//[^\n]*|\#(?!\[|include|define|if|endif|pragma)[^\n]*|/\*.*?\*/|<!--.*?-->" + _OTHER, re.S)
_STYLE = re.compile(r"/\*.*?\*/" + _OTHER, re.S)  # of style sheets, where # begins a colour
COMMENT, TEXT, NUMBER, NAME, SIGN = range(5)
#: Words of several languages that stay themselves in the sequence of shapes.
KEYWORDS = frozenset("if else for while return func function def class struct enum import from package public private static final const let var type interface impl fn pub use new export async await try catch except raise throw in of range self this true false null None nil void int string bool go defer switch case break continue".split())
CONTROL = frozenset("if for while return def func function fn switch try".split())
_BETWEEN = frozenset(", + - : { } [ ] ( ) \\ .".split())
_CONSTANTS = frozenset("true false null None nil True False byte".split())

FORM = 4.6  # grammar size / sqrt(length) below which shapes repeat one form
LEAST_TOKENS = 60
TABLE = 8  # literals in a run that make a table
OPAQUE = 80  # characters of literals in a run that holds no blank
KEPT = 0.25  # share of a table's literals that the grammar must still write for it to be data and not a repeated form
BULK = 0.5  # what it writes of them, against that and everything else
MARK = 30  # tokens of a passage that tells a copy: shorter ones recur between strangers as idioms
SPREAD = 8  # windows in a row of which one is marked, so that MARK + SPREAD - 1 equal tokens always share a mark
PASSAGES, PART = 100, 0.6  # tokens, and share of a file's tokens, in passages of other repositories that make it a copy
TOOL_FILES, TOOL_SHARE = 3, 0.4  # files of repeated form with a sign, and their share of all files with it, that make it a tool's mark
SURE = 2.0  # natural logarithm by which the odds against chance must exceed the number of signs tried
LIBRARIES, FOREIGN = 2, 0.5  # different libraries in folders of a name, and their share of what it holds, that make it a foreign folder
WIDE, WIDE_STYLE = 200, 400  # characters of a line of minified code, of a minified style sheet
SHORT = 0.6  # share of names of one letter in minified code
BATCH_CHARS = 1 << 21  # characters of files whose grammars are inferred side by side


def repair(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over many sequences at once, a grammar for each.

    ``symbols`` are the sequences one after the other, ``owner`` (ascending) whose each
    symbol is.  Returns (start symbols, their owners, left, right, owner and uses of
    the rules); symbols from ``symbols.max() + 1`` on are rules in order, and no
    rule is used by two sequences.

    In each round a pair that occurs twice or more is replaced wherever it is
    more frequent than the pairs that overlap it, so every sequence makes many
    replacements of its locally most frequent pairs at once, and the number of
    rounds grows with the logarithm of the longest repetition.
    """
    s, o = np.array(symbols, np.int64), np.asarray(owner, np.int64)
    nxt = int(s.max()) + 1 if len(s) else 0
    rules: list[tuple[np.ndarray, ...]] = []
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(s) > 1:
        code = np.unique(s, return_inverse=True)[1].astype(np.int64)
        wide = int(code.max()) + 1
        key = (o[:-1] * wide + code[:-1]) * wide + code[1:]
        inner = o[1:] == o[:-1]
        # a a a: of a run every other pair counts, from its first on.
        same = np.r_[False, key[1:] == key[:-1]]
        free = inner & ((np.arange(len(key)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))) % 2 == 0)
        kinds, kind = np.unique(key, return_inverse=True)
        count = np.bincount(kind[free], minlength=len(kinds))
        # Ties of different pairs are broken by a fixed mixture of the pair.
        weight = (count << 32) | ((kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
        weight = np.where(free & (count[kind] >= 2), weight[kind], -1)
        if weight.max() < 0:
            break
        pick = (weight >= 0) & (weight > np.r_[-1, weight[:-1]]) & (weight > np.r_[weight[1:], -1])
        pick &= np.bincount(kind[pick], minlength=len(kinds))[kind] >= 2  # a pair whose other places all went to a neighbour stays
        # Where no pair was left with two places, the most frequent pair of the sequence takes all of its places.
        stuck = np.ones(int(o[-1]) + 1, bool)
        stuck[o[:-1][pick]] = False
        best = np.full(len(stuck), -1, np.int64)
        np.maximum.at(best, o[:-1], weight)
        pick |= (weight >= 0) & stuck[o[:-1]] & (weight == best[o[:-1]])
        place = np.flatnonzero(pick)
        used, first, to, n = np.unique(kind[place], return_index=True, return_inverse=True, return_counts=True)
        example = place[first]
        rules.append((s[example], s[example + 1], o[example], n))
        s[place] = nxt + to
        nxt += len(used)
        stay = np.ones(len(s), bool)
        stay[place + 1] = False
        # Sequences in which nothing stands twice are done.
        stay_on = (best >= 0)[o]
        if not stay_on.all():
            done.append((s[~stay_on], o[~stay_on]))
        s, o = s[stay & stay_on], o[stay & stay_on]
    done.append((s, o))
    s, o = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(o, kind="stable")
    left, right, whose, uses = (np.concatenate(x) for x in zip(*rules)) if rules else (np.zeros(0, np.int64),) * 4
    return s[order], o[order], left, right, whose, uses


def expanded(left: np.ndarray, right: np.ndarray, first: int) -> list[tuple[int, ...]]:
    """The terminals that each rule stands for."""
    whole: list[tuple[int, ...]] = []
    for a, b in zip(left.tolist(), right.tolist()):
        whole.append((whole[a - first] if a >= first else (a,)) + (whole[b - first] if b >= first else (b,)))
    return whole


#: What tools and people write about a file's origin, and how they name files and folders of it.
_TOOL = re.compile(
    r"(?i)\bdo not (?:edit|modify)\b.*\bgenerat|\bgenerated\b.*\bdo not (?:edit|modify)\b|\b(?:code|file|source) (?:was |is )?(?:auto(?:matically)?[- ]?)?(?:generated|created) (?:by|from|with|using)\b|\bthis file (?:is|was) (?:auto(?:matically)?[- ]?)?(?:generated|created)\b"
    r"|\bauto-?generated\b|@generated\b|-\*-\s*generated\s*-\*-|\bautomatically (?:generated|created|produced)\b|\bmachine[- ](?:written|generated)\b|\bautomatisch (?:erzeugt|generiert)\b|\bgénéré automatiquement\b|\bgenerado automáticamente\b|\bproduced by \w+ </auto"
)
_NOT_TOOL = re.compile(r"(?i)\b(?:not|never|n't|isn't|no longer)\s+(?:auto-?|automatically |machine[- ])?generated\b|\bby hand\b|\bchecks? (?:that|whether|if|for)\b|\bgenerates?\b|\b(?:skip|detect|ignore|exclude|find|list|remove|delete|filter)\w*\b.*\bgenerated\b|\bgenerated\b.*\b(?:skip|detect|ignore|exclude|filter)\w*\b|\btests?\b.*\bgenerated\b")
_TOOL_NAME = re.compile(r"(?i)(?:\.(?:pb|gen|generated|g|designer|pb2)\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|rs|cc|h)|_generated\.\w+|(?:^|/)zz_generated[^/]*|(?<=[a-z0-9])_gen\.\w+|_string\.go|outerclass\.java|grpc\.java)$")
_TOOL_DIR = re.compile(r"(?i)(?:^|/)(?:__generated__|autogen|auto-generated|generated|generated-src|generated-sources|gen)/")
_COPIED = re.compile(
    r"(?i)\bcopied (?:verbatim |unchanged |as is )?from (?:the )?\S+|\bpart of [\w.-]+, imported from\b|\bvendored from\b|\bbundled copy\b|\blocal copy, do not modify\b|\bupstream:\s*\S+|\bthird[- ]party (?:code|copy|source)\b|\b[\w.-]+ v?\d+(?:\.\d+)+ - copyright\b|\bcopyright \(c\) [^\n]*\ball rights reserved\b.*\bredistribution\b|^\W*!?\s*[\w.-]+ v\d+(?:\.\d+)+ \| \(c\)|@license\b"
)
_NOT_COPIED = re.compile(r"(?i)\binspired by\b|\brewritten\b|\bfrom scratch\b|\bchecks? (?:that|whether|if|for)\b|\bvendored (?:copies|files|code)\b.*\b(?:skip|ignor|exclud)|\bunlike\b")
_FOREIGN_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|_vendor|vendored|third[-_]?party|site-packages|dist-packages|externals?|extern|ext|deps|contrib|godeps|pods|carthage)/")
_RELEASE = re.compile(r"^([a-z][\w.]*?)[-@_]v?\d+(?:\.\d+)+$")
_STATED = re.compile(r"\b([a-z][\w-]+)(?: project)?(?: \(release| version| release|,? imported from its|@)? v?\d+(?:\.\d+)+\b")
_WORD = re.compile(r"[^\W_]+|[^\s\w]")
_OPENS = re.compile(r"^\W*?(?:[/*#!]|<!--)+(?=[^/*#!])|^\s+\*?")  # what makes a line a comment is no part of what it says
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+\d*|\d+|[._-]")

SCHEMA = (
    "grp string, path string, tokens long, control long, style boolean, shapes long, uses double, literal double, kept double, blob double, wide double, short_names double, comment double, "
    "says_tool boolean, says_copied boolean, foreign_dir boolean, folders array<string>, released array<string>, library array<string>, signs array<long>, marks array<long>, places array<int>, copy long"
)


def _kind(word: str) -> int:
    c = word[0]
    if c in "\"'`" and len(word) > 1:
        return TEXT
    if c in "0123456789":
        return NUMBER
    if c == "_" or c.isalpha() or c.isalnum():
        return NAME
    return COMMENT if len(word) > 1 else SIGN


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` in a row."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(1)).astype(np.int64)


def passages(told: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places in their sequences and owners of the marked windows of MARK tokens: the least of every SPREAD in a row, the same wherever the passage stands."""
    h = _windows(told, MARK)
    begin = np.flatnonzero(owner[: len(h)] == owner[MARK - 1 :])
    h, whose = h[begin], owner[begin]
    if not len(h):
        return h, begin, whose
    edge = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1], True])
    rows = np.lib.stride_tricks.sliding_window_view(h, SPREAD) if len(h) >= SPREAD else np.zeros((0, SPREAD), np.int64)
    full = np.flatnonzero(whose[: len(rows)] == whose[SPREAD - 1 :]) if len(rows) else np.zeros(0, np.int64)
    few = [x + int(h[x:y].argmin()) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()) if y - x < SPREAD]
    at = np.unique(np.r_[full + rows[full].argmin(1), np.array(few, np.int64)].astype(np.int64))
    start = np.searchsorted(owner, whose[at])
    return h[at], begin[at] - start, whose[at]


def tables(kind: np.ndarray, size: np.ndarray, blank: np.ndarray, goes_on: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which tokens stand in a run of literals with only punctuation, constants and keys between them: a table, or a text in pieces.

    A run counts from TABLE literals, or OPAQUE characters of literals without a
    blank; messages and docstrings, which stand alone, are no run.
    """
    literal = (kind == TEXT) | (kind == NUMBER)
    inside = literal | goes_on
    run = np.cumsum(~inside | np.r_[True, owner[1:] != owner[:-1]])  # a token that is in no run begins the next
    n = np.bincount(run[literal], minlength=int(run[-1]) + 1 if len(run) else 1)
    chars = np.bincount(run[literal], weights=size[literal], minlength=len(n))
    spaced = np.bincount(run[literal & blank], minlength=len(n)) > 0
    return inside & ((n >= TABLE) | ((chars >= OPAQUE) & ~spaced))[run]


def _signs(path: str, words: list[str], known: dict[str, int]) -> list[int]:
    """What may be a tool's mark: three words or signs of a comment in a row, folders, and neighbouring parts of the file's name."""
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    three = _windows(np.array([known[w] for w in words], np.uint64), 3).tolist()
    *folders, name = path.split("/")
    parts = ["^", *_NAME_PART.findall(name), "$"]
    ends = [f"{a}|{b}|{c}" for a, b, c in zip(parts, parts[1:], parts[2:])]
    return [*set(three), *{xxhash.xxh3_64_intdigest(x) >> 1 for x in [*(f"/{d.lower()}/" for d in folders), *ends]}]


def features(files: list[tuple[str, str]], tools: bool = True, copies: bool = True) -> list[dict]:
    """The figures of files (path, content), whose grammars are inferred side by side; ``tools`` and ``copies`` say which statements to look for."""
    book: dict[str, int] = defaultdict(count().__next__)
    streams, notes = [], []
    for path, content in files:
        text = content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        style = bool(re.search(r"(?i)\.(?:css|scss|less)$", path))
        words = (_STYLE if style else _TOKEN).findall(text)
        streams.append(np.fromiter(map(book.__getitem__, words), np.int64, len(words)))
        lines = text.split("\n")
        wide = max(map(len, lines))
        if wide >= WIDE:  # comments may be as long as they like
            wide = max((len(x) for x in lines if not x.lstrip().startswith(("//#", "/*", "//", "# "))), default=0)
        notes.append((style, wide, len(text)))
    vocabulary = list(book)
    kinds = np.array([_kind(w) for w in vocabulary], np.int8)
    lengths = np.array([len(w) for w in vocabulary], np.int64)
    spaced = np.array([" " in w for w in vocabulary], bool)
    keyword = np.array([w in KEYWORDS for w in vocabulary], bool)
    control = np.array([w in CONTROL for w in vocabulary], bool)
    between = np.array([w in _BETWEEN or w in _CONSTANTS for w in vocabulary], bool)
    colon = book.get(":", -1)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], np.uint64)
    shape_of = {}
    shape = np.array([shape_of.setdefault(w if k == SIGN or w in KEYWORDS else k, len(shape_of)) for k, w in zip(kinds.tolist(), vocabulary)], np.int64)
    m = len(files)
    said = [[vocabulary[c] for c in x[kinds[x] == COMMENT].tolist()] for x in streams]
    streams = [x[kinds[x] != COMMENT] for x in streams]
    sizes = np.array([len(x) for x in streams], np.int64)
    flat = np.concatenate(streams) if m else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(m), sizes)
    kind, size = kinds[flat], lengths[flat]

    def total(on: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner[on], weights=None if weight is None else weight[on], minlength=m)

    start, start_owner, _, _, rule_owner, uses = repair(shape[flat], owner)
    shapes = np.bincount(start_owner, minlength=m) + 2 * np.bincount(rule_owner, minlength=m)
    reuse = np.bincount(rule_owner, weights=uses, minlength=m) / np.maximum(1, np.bincount(rule_owner, minlength=m))
    literal = (kind == TEXT) | (kind == NUMBER)
    key = np.r_[(flat[1:] == colon) & (owner[1:] == owner[:-1]), False][: len(flat)]
    held = tables(kind, size, spaced[flat], between[flat] | ((kind == NAME) & ~keyword[flat] & key), owner)
    whole, rest = total(held & literal, size), total(~held, size)
    # The words of files that hold tables: each rule's literals are written once, however often it is used.
    asked = (whole > 0)[owner]
    fresh = np.zeros(m)
    if asked.any():
        first = int(flat[asked].max()) + 1
        s, so, left, right, ro, _ = repair(flat[asked], owner[asked])
        written, writer = np.concatenate([s, left, right]), np.concatenate([so, ro, ro])
        on = written < first
        written, writer = written[on], writer[on]
        bulk = np.unique(owner[held & literal] * len(vocabulary) + flat[held & literal])
        own = np.isin(writer * len(vocabulary) + written, bulk)
        fresh = np.bincount(writer[own], weights=lengths[written[own]], minlength=m)
    chars, n_literal, n_control = total(size > 0, size), total(literal, size), total(control[flat])
    named = (kind == NAME) & ~keyword[flat]
    names, short = total(named), total(named & (size == 1))
    marks, places, whose = passages(hashes[flat], owner)
    edge = np.searchsorted(whose, np.arange(m + 1))
    known: dict[str, int] = {}
    out = []
    for i, (path, _) in enumerate(files):
        style, wide, length = notes[i]
        comments, on = said[i], slice(edge[i], edge[i + 1])
        stated = [re.sub(r"\s+", " ", c) for block in comments for c in block.split("\n")]
        folders = path.lower().split("/")[:-1]
        n = int(sizes[i])
        out.append(
            {
                "tokens": n, "control": int(n_control[i]), "style": style, "shapes": int(shapes[i]), "uses": float(reuse[i]), "literal": n_literal[i] / max(1, chars[i]),
                "kept": min(1.0, fresh[i] / whole[i]) if whole[i] else 0.0, "blob": fresh[i] / (fresh[i] + rest[i]) if whole[i] else 0.0, "wide": float(wide), "short_names": short[i] / names[i] if names[i] else 0.0,
                "comment": sum(map(len, comments)) / max(1, length), "says_tool": tools and (bool(_TOOL_NAME.search(path) or _TOOL_DIR.search(path)) or any(_TOOL.search(c) and not _NOT_TOOL.search(c) for c in stated)),
                "says_copied": copies and any(_COPIED.search(c) and not _NOT_COPIED.search(c) for c in stated), "foreign_dir": copies and bool(_FOREIGN_DIR.search(path)),
                "folders": folders, "released": sorted({x[1] for x in map(_RELEASE.match, folders) if x}), "library": sorted({x for c in stated for x in _STATED.findall(c.lower())}),
                "signs": _signs(path, [w for c in stated for w in _WORD.findall(_OPENS.sub("", c.lower()))], known), "marks": marks[on].tolist(), "places": places[on].tolist(),
                "copy": xxhash.xxh3_64_intdigest(hashes[streams[i]].tobytes()) >> 1 if n >= LEAST_TOKENS else None,
            }
        )
    return out


def _measured(tools: bool, copies: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = pdf["path"].str.replace("\\", "/").tolist()
            texts = pdf["content"].fillna("").tolist()
            cut = np.cumsum([len(t) for t in texts]) // BATCH_CHARS if len(pdf) else np.zeros(0, np.int64)
            for k in np.unique(cut):
                at = np.flatnonzero(cut == k)
                rows = features([(paths[i], texts[i]) for i in at], tools, copies)
                yield pd.concat([pdf[["grp", "path"]].iloc[at].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return run


def _elsewhere(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that occur in more than one repository; rows are combined before they move."""
    return rows.groupBy(key).agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select(key)


def _tool_signs(files: DataFrame, form: Column) -> DataFrame:
    """The signs that stand mostly in files of repeated form, in more than one repository.

    Only signs of such files, a small part of all, are counted at all.
    """
    of_form = files.where(form).select("repo", F.explode("signs").alias("sign"))
    asked = of_form.groupBy("sign").agg(F.count("*").alias("formed"), F.min("repo").alias("a"), F.max("repo").alias("b")).where((F.col("formed") >= TOOL_FILES) & (F.col("a") != F.col("b"))).select("sign", "formed")
    asked = materialize(asked, "asked")
    n = join_small(files.select(F.explode("signs").alias("sign")), asked.select("sign"), "sign", "left_semi").groupBy("sign").agg(F.count("*").alias("n"))
    tried, (formed, number) = asked.count(), files.agg(F.count_if(form), F.count("*")).first()
    # Chernoff's bound on so many or more formed files with a sign that has nothing to do with form.
    expected = F.col("n") * F.lit(max(1, formed) / max(1, number))
    against = F.col("formed") * F.log(F.col("formed") / expected) - F.col("formed") + expected
    return n.join(asked, "sign").where((F.col("formed") >= TOOL_SHARE * F.col("n")) & (against >= SURE + math.log(max(1, tried)))).select("sign")


def _foreign(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of libraries, and names of folders that hold mostly libraries.

    A library is a name that stands before a release number in comments of more
    than one repository; folders of a repository's own parts have numbers as well.
    """
    libraries = materialize(_elsewhere(files.select("repo", F.explode("library").alias("name")), "name"), "libraries")
    bare = F.transform("folders", lambda x: F.regexp_replace(x, r"[-@_]v?\d+(\.\d+)+$", ""))
    steps = files.where(F.size("folders") > 1).select("repo", F.explode(F.arrays_zip(F.slice("folders", 1, F.size("folders") - 1).alias("folder"), F.slice(bare, 2, F.size("folders") - 1).alias("name"))).alias("s"))
    held = steps.select("repo", "s.folder", "s.name").distinct().groupBy("folder", "name").agg(F.count("*").alias("n"))
    marked = join_small(held, libraries.withColumn("known", F.lit(True)), "name")
    per = marked.groupBy("folder").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("of"), F.count("known").alias("kinds"))
    return libraries, materialize(per.where((F.col("kinds") >= LIBRARIES) & (F.col("of") >= FOREIGN * F.col("n"))).select("folder"), "foreign")


def file_origins(df: DataFrame, repository: str, path: str, content: str, tools: bool = True, copies: bool = True) -> DataFrame:
    """``(repository, path, generated, minified, vendored, data, hand_written, ...)``: a row per file, with the figures it rests on.

    ``df`` has the whole content of a file per row.  A file delivered again counts
    once; null repositories and paths are dropped; a null or empty content leaves
    the path to judge by.  Backslashes in paths, byte-order marks and any line
    ends are understood; the path comes back as it was given.  Marks of tools and
    libraries are learned from the files at hand, so a small collection shows
    fewer of them; ``tools`` and ``copies`` take, besides, the comments, names
    and folders that by common usage tell a tool's output and a copy.
    """
    rows = df.select(F.col(repository).alias("grp"), F.col(path).alias("path"), F.col(content).alias("content")).where("grp is not null and path is not null")
    # The features are a tenth of the content, so repeated files are dropped after measuring, not before.
    measured = enough_tasks(rows, "path").mapInPandas(batched(_measured(tools, copies)), SCHEMA).dropDuplicates(["grp", "path"])
    files = materialize(measured.withColumn("repo", F.xxhash64("grp")).withColumn("file", F.monotonically_increasing_id()), "files")
    style = F.col("style")
    data = (F.col("blob") >= BULK) & (F.col("kept") >= KEPT) & ~style
    minified = ((F.col("short_names") >= SHORT) & (F.col("wide") >= WIDE)) | (style & (F.col("wide") >= WIDE_STYLE))
    form = (F.col("tokens") >= LEAST_TOKENS) & (F.col("shapes") < FORM * F.sqrt("tokens")) & ~data & ~minified

    signs = materialize(_tool_signs(files, form), "signs")
    tools = join_small(files.select("file", F.explode("signs").alias("sign")), signs, "sign", "left_semi").select("file").distinct().withColumn("tool", F.lit(True))

    libraries, folders = _foreign(files)
    inside = join_small(files.select("file", F.explode("folders").alias("folder")), folders, "folder", "left_semi").select("file")
    released = join_small(files.select("file", F.explode("released").alias("name")), libraries, "name", "left_semi").select("file")
    placed = inside.unionByName(released).distinct().withColumn("placed", F.lit(True))

    marks = files.select("file", "repo", F.explode(F.arrays_zip("marks", "places")).alias("m")).select("file", "repo", F.col("m.marks").alias("mark"), F.col("m.places").alias("place"))
    known = materialize(_elsewhere(marks.select("repo", "mark"), "mark"), "passages")
    places = join_small(marks, known, "mark", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list("place")).alias("p"))  # as many as the file has
    step = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.size("p") - 1), lambda x, y: F.least(x - y, F.lit(MARK)))
    passed = places.select("file", F.aggregate(step, F.lit(MARK), lambda a, x: a + x).alias("passed"))
    # The whole sequence of words, comments aside, in more than one repository: a copy.
    copies = materialize(_elsewhere(files.where("copy is not null").select("repo", "copy"), "copy"), "copies").withColumn("copied", F.lit(True))

    told = join_small(files.drop("marks", "places", "signs"), copies, "copy")
    for extra in (tools, placed, passed):
        told = told.join(extra, "file", "left")
    told = told.fillna({"copied": False, "placed": False, "tool": False, "passed": 0}).withColumn("shared", F.when(F.col("tokens") > 0, F.col("passed") / F.col("tokens")).otherwise(0.0))
    generated = F.col("tool") | form
    vendored = F.col("placed") | F.col("copied") | ((F.col("passed") >= PASSAGES) & (F.col("shared") >= PART) & ~generated)  # one tool writes alike in many places
    if tools:
        generated = generated | F.col("says_tool")
    if copies:
        vendored = vendored | F.col("says_copied") | F.col("foreign_dir")
    out = told.select(
        F.col("grp").alias(repository), F.col("path").alias(path), generated.alias("generated"), minified.alias("minified"), vendored.alias("vendored"), data.alias("data"),
        "tokens", "shapes", "uses", "literal", "kept", "short_names", "shared",
    )
    return out.withColumn("hand_written", ~(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data")))
