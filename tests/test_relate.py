"""Relations by language, and their resolution."""

from memloom.operators import relate

SOURCES = {
    "a.py": ("import os, util.text as t\nfrom .base import Base\n\nclass Child(Base, meta.Other, metaclass=M):\n    def run(self, x):\n        # gone(x)\n        client.get(foo(x), 'lost(1)')\n        if (x):\n            rows.append(f'{kept(x)}')\n", [("IMPORTS", "os"), ("IMPORTS", "util.text"), ("IMPORTS", ".base"), ("EXTENDS", "Base"), ("CALLS", "get"), ("CALLS", "foo"), ("CALLS", "append"), ("CALLS", "kept")]),
    "a.ts": ("import { A,\n  B } from './lib/b';\nclass C extends A implements I, J<K> {\n  m(x: string): void {\n    if (x) { go(`${deep(x)}`); new D(x); this.n<T>(x); }\n  }\n}\n", [("IMPORTS", "./lib/b"), ("EXTENDS", "A"), ("IMPLEMENTS", "I"), ("CALLS", "go"), ("CALLS", "deep"), ("CALLS", "n")]),
    "a.go": ('package a\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype R interface {\n\tRead(p int) error\n}\nfunc (s *S) Run(a int) {\n\tfmt.Print(help([]byte(a)))\n}\n', [("IMPORTS", "fmt"), ("IMPORTS", "a/b"), ("CALLS", "Print"), ("CALLS", "help")]),
    "a.rs": ("use std::{fmt, io};\nuse a::b::C;\nimpl<T> Show for Row {\n    fn show(&self, c: &'static str) {\n        match x { Some(y) => put(y), None => Err::new(1) };\n        if let Some(z) = self.next() { drop(z) }\n    }\n}\n", [("IMPORTS", "std"), ("IMPORTS", "a::b::C"), ("IMPLEMENTS", "Show"), ("CALLS", "put"), ("CALLS", "new"), ("CALLS", "next"), ("CALLS", "drop")]),
    "A.java": ("import a.b.C;\nimport static d.*;\npublic class A extends B implements I {\n    public A(int x) { super(x); }\n    List<String> all(int x) throws E {\n        return pick(new C(x), this.size());\n    }\n    @Named(x)\n    abstract List<String> none(int x);\n}\n", [("IMPORTS", "a.b.C"), ("IMPORTS", "d"), ("EXTENDS", "B"), ("CALLS", "pick"), ("CALLS", "size")]),
    "a.c": ('#include <stdio.h>\n#include "x/y.h"\n#define TWICE(x) other(x)\nstatic int *f(int a);\nint main(void) {\n  while (f(1)) printf("g(2)");\n  return g(3);\n}\n', [("IMPORTS", "<stdio.h>"), ("IMPORTS", "x/y.h"), ("CALLS", "f"), ("CALLS", "printf"), ("CALLS", "g")]),
    "a.cpp": ("class D : public B, private std::C {\n  void m(int a) const;\n};\nvoid D::m(int a) const {\n  auto v = ns::make(a);\n  v->go(a);\n}\n", [("EXTENDS", "B"), ("CALLS", "make"), ("CALLS", "go")]),
}


def test_relations_by_language(spark):
    df = spark.createDataFrame([("s", f"x/{p}", t) for p, (t, _) in SOURCES.items()] + [("s", "x/null.py", None), ("s", "x/none.zzz", "f(1)")], "space_id string, file_path string, content string")
    got = {}
    for r in relate.relations(df).collect():
        got.setdefault(r["file_path"], []).append((r["relation"], r["target"]))
    assert {p: sorted(v) for p, v in got.items()} == {f"x/{p}": sorted(want) for p, (_, want) in SOURCES.items()}


def test_imports_by_path_suffix(spark):
    names = spark.createDataFrame([("s", "B", "lib/b.ts", 2), ("s", "B2", "lib/b.ts", 1), ("s", "X", "q/pack/index.ts", 4), ("s", "Y", "lib/ab.ts", 1), ("t", "Z", "c.ts", 1)], "space_id string, name string, file_path string, line int")
    found = spark.createDataFrame([("s", "m.ts", 1, "IMPORTS", None, "./b"), ("s", "m.ts", 2, "IMPORTS", None, "../pack"), ("s", "m.ts", 3, "IMPORTS", None, "./c"), ("s", "m.ts", 4, "CALLS", None, "X"), ("s", "m.ts", 5, "EXTENDS", "K", "Y")], "space_id string, file_path string, line int, relation string, source string, target string")
    got = {(r["line"], r["relation"], r["found_in"], r["found_line"], r["method"], r["confidence"]) for r in relate.resolve_all(found, names).collect()}
    assert got == {(1, "IMPORTS", "lib/b.ts", 1, "import_suffix", 0.8), (2, "IMPORTS", "q/pack/index.ts", 4, "import_suffix", 0.8), (4, "CALLS", "q/pack/index.ts", 4, "global_unique", 0.5), (5, "EXTENDS", "lib/ab.ts", 1, "global_unique", 0.5)}
