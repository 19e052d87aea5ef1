import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memloom.llm.handwritten import FORM, expanded, features, file_origins, repair
from memloom.llm.stuffing import measure, passages, spam_scores


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=120), max_size=5))
def test_grammars_give_the_sequences_back(seqs):
    flat, owner = np.array([x for q in seqs for x in q], np.int64), np.repeat(np.arange(len(seqs)), [len(q) for q in seqs])
    start, whose, left, right, rule_owner, used = repair(flat, owner)
    first = int(flat.max()) + 1 if len(flat) else 0
    whole = dict(enumerate(expanded(left, right, first), first))
    assert (used >= 2).all()
    for k, seq in enumerate(seqs):
        mine = start[whose == k].tolist()
        assert [t for x in mine for t in (whole[x] if x >= first else (x,))] == seq
        seen = {}
        for i, p in enumerate(zip(mine[:-1], mine[1:])):  # no pair is left that could be replaced twice
            assert p not in seen or i - seen[p] < 2 or (p[0] == p[1])
            seen.setdefault(p, i)
    for k in range(len(seqs)):  # side by side or alone, the grammar is the same
        one = repair(flat[owner == k], owner[owner == k])
        assert len(one[0]) == (whose == k).sum() and len(one[2]) == (rule_owner == k).sum()


HAND = """import os

# Written by hand, not generated.
def load_config(path, limit=40):
    if not os.path.exists(path):
        raise ValueError("missing " + path)
    out = []
    for line in open(path):
        key, _, value = line.partition("=")
        if key.strip():
            out.append((key.strip(), value.strip()))
    return out[:limit]

# Checks that generated files are skipped: one line.
WEIGHTS = [0.5, 0.25, 0.125]
"""
GETTERS = "package x\n" + "".join(f'func (x *Rec) GetField{k}() string {{\n\tif x != nil {{\n\t\treturn x.Field{k}\n\t}}\n\treturn ""\n}}\n' for k in range(20))
MINI = "".join(f"function {a}({b},{c}){{return {b}.{c}({a})||{k}}}" for k, (a, b, c) in enumerate([("a", "b", "c"), ("d", "e", "f"), ("g", "h", "i")] * 20))
DATA = "table = [" + ", ".join(str(random.Random(1).randrange(10**6) + k) for k in range(300)) + "]\n"


def test_file_kinds(spark):
    rows = [
        ("r1", "src/hand.py", HAND), ("r1", "src/records.go", GETTERS), ("r1", "web/app.js", MINI), ("r1", "src/table.py", DATA), ("r1", "third_party\\lib\\a.go", "package a\nfunc F() {}\n"), ("r1", "src/a.pb.go", "package a\n"),
        ("r1", "src/gen.py", "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n"), ("r1", "pkg/vendor_portal.go", "package p\nfunc Portal() error {\n\treturn nil\n}\n"), ("r1", "lib/api-2.1/a.py", HAND + "\n"), ("r1", "lib/zlibx-2.1/a.py", HAND + "\n\n"),
        ("r1", "x/copy.c", "// Part of zlibx, imported from its 2.1.0 tag\nint f(void);\n"), ("r2", "y/copy.c", "﻿// Part of zlibx, imported from its 2.1.0 tag\r\nint f(void);\r\n"), ("r1", "css/site.css", "." + "}.".join(f"a{k}{{margin:{k}px;color:#aabbcc" for k in range(60)) + "}"),
        ("r1", "src/null.py", None), ("r1", "src/empty.py", ""), (None, "a.py", HAND), ("r1", None, HAND), ("r1", "src/hand.py", HAND),
    ]
    df = spark.createDataFrame(rows, "space_id string, file_path string, content string").withColumns({"tokens": F.lit("t"), "grp": F.lit(1), "path": F.lit(2)})
    got = {(r["space_id"], r["file_path"]): r for r in file_origins(df, "space_id", "file_path", "content").collect()}
    assert len(got) == 15
    hand = {k[1] for k, r in got.items() if r["hand_written"]}
    assert hand == {"src/hand.py", "pkg/vendor_portal.go", "lib/api-2.1/a.py", "src/null.py", "src/empty.py"}
    assert got["r1", "src/records.go"]["generated"] and got["r1", "web/app.js"]["minified"] and got["r1", "src/table.py"]["data"] and got["r1", "third_party\\lib\\a.go"]["vendored"] and got["r1", "css/site.css"]["minified"]
    assert file_origins(df.limit(0), "space_id", "file_path", "content").count() == 0


def test_same_file_in_two_repositories_is_a_copy(spark):
    other = HAND.replace("load_config", "read_pairs").replace("missing", "nothing at")
    rows = [("r1", "a/x.py", HAND), ("r2", "b/y.py", "# another comment\n" + HAND), ("r1", "c/z.py", other), ("r1", "c/again.py", other)]
    got = {r["file_path"]: r["vendored"] for r in file_origins(spark.createDataFrame(rows, "space_id string, file_path string, content string"), "space_id", "file_path", "content").collect()}
    assert got == {"a/x.py": True, "b/y.py": True, "c/z.py": False, "c/again.py": False}


LIBRARY = HAND + """
def merge_counts(left, right, weight=2):
    total = dict(left)
    for key, number in right.items():
        if key not in total:
            total[key] = 0
        total[key] += weight * number
    return {key: number for key, number in sorted(total.items()) if number > 0}

class Window:
    def __init__(self, size):
        self.size = size
        self.rows = []

    def push(self, row):
        self.rows.append(row)
        while len(self.rows) > self.size:
            self.rows.pop(0)
        return self
"""


def test_edited_copies_are_found(spark):
    edited = LIBRARY.replace("import os", "import os.path as os").replace("weight=2", "weight=3") + "\n\ndef local_helper(rows):\n    return [row.strip() for row in rows if row]\n"
    # Own code with one passage in common with the library: a few lines, not most of the file.
    own = "".join(f"def step_{a}({a}, {b}):\n    {a}.{b}({k})\n    return {b}[{a}:{k}]\n\n" for k, (a, b) in enumerate(zip("alpha beta gamma delta epsilon zeta eta theta iota".split(), "red green blue black white grey pink brown gold".split()))) + LIBRARY[LIBRARY.index("class Window") :]
    rows = [("r1", "a/lib.py", LIBRARY), ("r2", "b/copy.py", edited), ("r3", "c/own.py", own), ("r4", "d/one.py", HAND.replace("load_config", "other_name").replace("limit", "most"))]
    got = {r["file_path"]: (r["vendored"], r["shared"]) for r in file_origins(spark.createDataFrame(rows, "space_id string, file_path string, content string"), "space_id", "file_path", "content").collect()}
    assert {p for p, (v, _) in got.items() if v} == {"a/lib.py", "b/copy.py"}, got
    assert 0 < got["c/own.py"][1] < 0.6


def test_data_is_literals_that_no_rule_shortens(spark):
    dice = random.Random(4)
    text = "".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1200))
    accessor = "\n\ndef load_blob():\n    if not BLOB:\n        return None\n    return decode(BLOB)\n"
    pieces = " +\n    ".join(f'"{text[k : k + 70]}"' for k in range(0, 1190, 70))
    settings = "".join(f'{n}_ADDRESS = "https://{n.lower()}.example.org/{n.lower()}/service"\n' for n in ("MAIL", "QUEUE", "STORE", "INDEX", "AUTH", "CACHE", "AUDIT", "PROXY", "TRACE"))
    rows = [
        ("r1", "a/blob.py", f'BLOB = "{text}"{accessor}'), ("r1", "a/pieces.py", f"BLOB = ({pieces}){accessor}"), ("r1", "a/table.py", DATA + "\ndef pick(key):\n    return table[key]\n"), ("r1", "a/code.py", HAND + f'KEY = "{text[:100]}"\n'),
        ("r1", "a/settings.py", settings), ("r1", "a/ones.py", "table = [" + "1234567, " * 300 + "]\n"),
    ]
    got = {r["file_path"]: r for r in file_origins(spark.createDataFrame(rows, "space_id string, file_path string, content string"), "space_id", "file_path", "content").collect()}
    assert {p for p, r in got.items() if r["data"]} == {"a/blob.py", "a/pieces.py", "a/table.py"}
    assert {p for p, r in got.items() if r["hand_written"]} == {"a/code.py", "a/settings.py"} and got["a/ones.py"]["generated"]


def test_long_file_is_measured_whole():
    f = features([("a.py", DATA * 60)])[0]
    assert f["tokens"] > 30_000 and f["control"] == 0


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega sigma tau".split()


def _own(k: int) -> str:
    """Written code, unlike for each k."""
    dice = random.Random(k)
    pick = lambda: dice.choice(WORDS) + "_" + dice.choice(WORDS) + str(dice.randrange(99))
    forms = ["    {} = {}.get({}, {})\n", "    if not {}:\n        return {}\n", "    for {} in {}:\n        {}.append({})\n", "    {}({}[{}])\n", "    {} += len({}) - {}\n", "    raise {}({})\n", "    {} = [{} for {} in {} if {}]\n", "    while {} < {}:\n        {} += 1\n"]
    return f"def {pick()}({pick()}, {pick()}):\n" + "".join(f.format(*[pick() for _ in range(f.count("{}"))]) for f in (dice.choice(forms) for _ in range(14)))


def test_without_the_grammar_the_rows_are_lost(spark, monkeypatch):
    import memloom.llm.handwritten as H

    assert all(f["shapes"] >= FORM * f["tokens"] ** 0.5 for f in features([(f"{k}.py", _own(k)) for k in range(60)]))
    getters = lambda k: "".join(f'func (x *{WORDS[k]}) Get{w.title()}() string {{\n\tif x != nil {{\n\t\treturn x.{w}\n\t}}\n\treturn ""\n}}\n' for w in WORDS)
    # A tool that no list knows: its header and its file names are learned from the files whose form repeats.
    rows = [(f"r{k % 3}", f"src/{WORDS[k]}_frobbed.go", "// Frobbed out of the wire description\n" + getters(k)) for k in range(8)]
    rows += [(f"r{k % 3}", f"src/plain{k}.go", "// Frobbed out of the wire description\n" + _own(900 + k)) for k in range(4)]
    rows += [(f"r{k % 3}", f"lib/{WORDS[k]}_frobbed.py", _own(950 + k)) for k in range(3)]
    # Folders that hold what comments of several repositories name with a release.
    libraries = [("zlibx", "2.1.0"), ("tinyq", "0.4.2"), ("mdlex", "1.0.3")]
    rows += [(f"r{k // 3}", f"src/{n}{k}.py", f"# {n} {v} of the authors\n" + _own(700 + k)) for k, (n, v) in enumerate(libraries * 3)]
    rows += [(f"r{k % 3}", f"borrowed/{n}/part{k}.py", _own(800 + k)) for k, (n, _) in enumerate(libraries * 2)]
    rows += [("r1", "src/table.py", DATA), ("r2", "src/other.py", _own(5))]
    rows += [(f"r{k % 3}", f"src/own{k}.py", f"# Helpers of {WORDS[k % 14]}\n" + _own(100 + k)) for k in range(30)]
    df = spark.createDataFrame(rows, "space_id string, file_path string, content string")
    found = lambda: {r["file_path"] for r in file_origins(df, "space_id", "file_path", "content", tools=False, copies=False).where("not hand_written").collect()}
    made = {p for _, p, _ in rows if "frobbed" in p or "plain" in p}
    assert found() == made | {p for _, p, _ in rows if p.startswith("borrowed/")} | {"src/table.py"}
    monkeypatch.setattr(H, "FORM", 0.0)
    monkeypatch.setattr(H, "KEPT", 2.0)
    assert found() == {p for _, p, _ in rows if p.startswith("borrowed/")}


PROSE = [
    "The scheduler of the old cluster drains every queue before it stops, because a half written batch would be lost.", "Nobody noticed that the review took longer than planned, although the dashboard showed it for days.",
    "A warm cache answers most of the requests, and the rest goes to the store behind it.", "When the lock file is left over from a crash, remove it by hand after you checked the owner.", "Each of these settings can be changed while the service runs, except for the port.",
]
SPAM = [
    "cheap graph tool graph tool best graph tool memory server graph tool memory server online graph tool memory server graph tool " * 6,
    "\n".join(f"* [graph tool](http://site{k}.example/p?id={k})" for k in range(20)),
    " ".join(f"#graphtool #memory_server #best_graphtool #tool{k % 3}" for k in range(12)),
    "Our graph tool is the best graph tool, the graph tool that beats every graph tool. With graph tool your graph tool gets cheap graph tool results. " * 4,
    "\n".join(f"SKU AB{k} | graph tool | ${k}.99 | in stock" for k in range(20)),
]


def _prose(rnd: random.Random, k: int) -> str:
    return "\n".join(rnd.sample(PROSE, 4)) + f" {k}"


def test_shares(spark):
    rnd = random.Random(5)
    links = "- [a guide](http://a.example/x): " + PROSE[0] + "\n- [another](http://b.example/y): " + PROSE[1]
    cases = {**{f"spam{k}": s for k, s in enumerate(SPAM)}, **{f"prose{k}": p * 3 for k, p in enumerate(PROSE)}, "plain": "\n".join(PROSE * 2), "annotated": links, "tail": "\n".join(PROSE * 4) + "\n" + SPAM[1][:300]}
    cases |= {"doorway": "\n".join(f"Wissensgraph {w.title()}stadt" for w in WORDS * 2), "doorway zh": "\n".join(f"上下文窗口 {w.title()}" for w in WORDS * 2), "russian": "Планировщик очищает все очереди перед остановкой, потому что наполовину записанный пакет был бы потерян. Никто не заметил, что проверка заняла больше времени, чем ожидалось."}
    # A stray fence opens no code; a closed one does.
    cases |= {"stray fence": "```\n" + SPAM[3], "code": "```\n" + SPAM[3] + "\n```\n" + PROSE[0]}
    df = spark.createDataFrame([(f"k{k}", _prose(rnd, k)) for k in range(300)] + list(cases.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["share"] for r in spam_scores(df, "doc_id", "text").collect()}
    assert all(got[f"spam{k}"] > 0.8 for k in range(len(SPAM))), got
    assert all(got[f"prose{k}"] < 0.5 for k in range(len(PROSE)) if len(PROSE[k]) * 3 >= 400)
    assert got["plain"] < 0.1 and got["annotated"] < 0.1 and got["tail"] < 0.5 and got["russian"] < 0.5
    assert got["doorway"] > 0.8 and got["doorway zh"] > 0.8 and got["stray fence"] > 0.8 and got["code"] < 0.5
    # Without the distance nothing is judged: no limit is beyond reach, and no text is reported.
    assert spam_scores(df, "doc_id", "text", limit=float("inf")).where("is_spam").count() == 0


def test_passages_hold_the_whole_text():
    rnd = random.Random(9)
    for text in [*SPAM, *PROSE, "\n".join(_prose(rnd, k) for k in range(40)), "", " \n\t", "```\nx = 1\n```"]:
        parts, code = passages(text)
        assert sum(p[0] for p in parts) + code <= len(text) and all(p[1] <= p[0] for p in parts)
        assert sum(p[0] for p in parts) + code >= sum(len(x.strip()) for x in text.splitlines()) - text.count(". ") - text.count("! ")
    one, many = measure([PROSE[0] * 5]), measure([*SPAM, PROSE[0] * 5])
    assert np.allclose(one[0][1], many[-1][1]) and one[0][0] == many[-1][0]


def test_spam_scores(spark):
    rnd = random.Random(7)
    rows = [(k, "\n".join(rnd.sample(PROSE, 4)) + f" {k}") for k in range(120)] + [(1000 + k, s) for k, s in enumerate(SPAM)] + [(1100 + k, s) for k, s in enumerate(SPAM)]
    rows += [(2000, None), (2001, ""), (2002, "short"), (None, SPAM[0]), (1000, SPAM[0]), (2003, "\n".join(PROSE) + "\n" + SPAM[1][:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("de"), "x": F.lit(1), "share": F.lit("s")})
    out = spam_scores(df, "doc_id", "text").collect()
    assert {r["doc_id"] for r in out if r["is_spam"]} == {1000 + k for k in range(5)} | {1100 + k for k in range(5)}
    assert len(out) == len({r["doc_id"] for r in out}) == 131
    assert spam_scores(df.limit(0), "doc_id", "text").count() == 0
