"""Front ends: snippets to the representation, and one algorithm in eight languages."""

import os
from collections import Counter

import pytest

from tallyforge import frontend

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
EXTENSIONS = ["py", "c", "cpp", "js", "ts", "java", "go", "rs"]


def read(path, source):
    return frontend.to_ir(frontend.language_of(path), source.encode())


def kinds(a, fn=None):
    return Counter(n[2] for n in a["nodes"] if fn is None or n[8] == fn)


@pytest.mark.parametrize("ext", EXTENSIONS)
def test_the_same_algorithm_counts_alike(ext):
    path = os.path.join(HERE, f"collatz.{ext}")
    with open(path, encoding="utf-8") as f:
        a = read(path, f.read())
    got = [{k: n for k, n in kinds(a, i).items() if k in ("branch", "else", "loop", "logical", "jump", "return", "call")} for i in range(3)]
    assert got == [{"loop": 1, "branch": 2, "else": 1, "jump": 1, "return": 1}, {"logical": 2, "return": 1}, {"branch": 1, "return": 2, "call": 1}]
    assert [(f[1], len(f[2]), f[8], f[9]) for f in a["functions"]] == [("steps_to_one", 2, 2, 5.0), ("inside", 3, 1, 1.0), ("digits", 1, 0, 2.0)]
    assert max(n[10] + 1 for n in a["nodes"] if n[2] in ("branch", "loop") and not n[12]) == 2
    assert kinds(a)["import"] == 1


def names(a, fn=0):
    return [p[0] for p in a["functions"][fn][2]]


def test_python_parameters_and_strings():
    a = read("a.py", 'def f(a, /, b: int = 1, *args, c, **kw):\n    "doc"\n    return f"v={g(a) if a else 0}!"\n')
    assert names(a) == ["a", "b", "args", "c", "kw"] and a["functions"][0][8] == 1
    assert kinds(a)["conditional"] == 1 and [n[3] for n in a["nodes"] if n[2] == "call"] == ["g"]
    assert [t[2] for t in a["tokens"] if t[1] == "literal"] == ["1", '"doc"', 'f"v=', "0", '!"']
    a = read("a.py", "x = (a and (b or c)) and d\n")
    assert [(n[3], n[13]) for n in a["nodes"] if n[2] == "logical"] == [("and", "assignment"), ("and", "expression"), ("or", "expression")]
    a = read("a.py", "# one\n\n# two\n# three\n@deco\ndef f(): pass\n")
    assert a["functions"][0][8] == 2
    a = read("a.py", "x = [i for i in y if i if i > 2]\nfor i in x:\n    pass\nelse:\n    pass\n")
    assert kinds(a)["branch"] == 2 and kinds(a)["loop"] == 2 and kinds(a)["else"] == 1
    a = read("a.py", "match x:\n    case 1: pass\n    case _ if y: pass\n")
    assert kinds(a)["case"] == 2 and kinds(a)["branch"] == 1


def test_javascript_and_typescript():
    a = read("a.ts", "const s = `x${a ? f() : g(() => 1)}y`;\n")
    assert kinds(a)["conditional"] == 1 and kinds(a)["call"] == 2 and len(a["functions"]) == 1
    assert [t[2] for t in a["tokens"] if t[1] == "literal"] == ["`x", "1", "y`"]
    a = read("a.js", "class A extends B { static async run(a, {b, c} = {}, ...d) { if (a) return 1; else if (b) return 2; else return 3 } get x() { return this.y ?? 0 } }\n")
    assert [f[1] for f in a["functions"]] == ["run", "x"] and names(a) == ["a", None, "d"]
    assert a["functions"][0][9] == 3
    a = read("a.ts", "export function f<T extends object>(this: Window, a?: string | null, b: Map<string, number[]> = new Map()): a is string { return (a as unknown as string) !== null && b!.size > 0 }\ninterface I { a: string; f(x: number): void }\ntype U = { a: 1 } | 'x';\nenum E { A, B }\n")
    assert names(a) == ["this", "a", "b"] and kinds(a)["logical"] == 1
    a = read("a.js", "const re = /a[/]b/g, f = async x => { await x; }; switch (re) { case 1: case 2: f(); break; default: g() }\ntry { h() } catch (e) { throw e } finally { i() }\nlabel: for (const k of ks) continue label\n")
    assert kinds(a)["case"] == 2 and kinds(a)["catch"] == 1 and kinds(a)["jump"] == 3 and kinds(a)["loop"] == 1


def test_jsx():
    a = read("a.jsx", "const App = (props) => <div>{props.x ? 1 : 2}</div>;\n")
    assert kinds(a)["conditional"] == 1 and len(a["functions"]) == 1 and kinds(a)["identifier"] == 4
    a = read("a.tsx", """import * as React from 'react';
export function List<T extends { id: string }>({ items, onPick }: Props<T>) {
  const pick = <U,>(u: U) => u;
  if (!items.length) return <p className="none" data-x='1'>Don't worry, it's empty &amp; fine</p>;
  return (
    <>
      {/* all of them */}
      <ul.Big {...rest} style={{ color: 'red' }} onClick={() => { if (a < b) onPick(a); }} hidden>
        {items.map((x: T) => x.id && <li key={x.id}><svg:path d="M0"/>{x.n > 1 ? <b>many</b> : 'one'}</li>)}
      </ul.Big>
    </>
  );
}
""")
    assert [f[1] for f in a["functions"]] == ["List", None, None, None]
    assert kinds(a)["branch"] == 2 and kinds(a)["conditional"] == 1 and kinds(a)["logical"] == 1 and kinds(a)["return"] == 2
    texts = [t[2] for t in a["tokens"]]
    assert "Don't worry, it's empty &amp; fine" in texts and "many" in texts and "/* all of them */" in texts and "data-x" in texts
    assert all(t[1] == "literal" for t in a["tokens"] if t[2] in ("'red'", '"M0"', "'1'", "'one'"))
    for name, source in (("a.ts", "const f = <T>(x: T) => <any>x;\n"), ("a.js", "for (let i = 0; i < n; i++) { a<b; x = a <c> (d) }\n"), ("a.tsx", "const f = <T extends object>(x: T): x is T => a < b;\n")):
        assert kinds(read(name, source))["function"] <= 1
    for broken in ("const a = <div>x;", "const a = <div x=>y</div>;", "const a = <div>{x</div>;"):
        with pytest.raises(frontend.ParseError):
            read("a.jsx", broken)


def test_java():
    a = read("A.java", "package p;\nimport java.util.*;\npublic class A<T> extends B implements C {\n  private final int x = 1;\n  A(int... n) { this.x = n[0]; }\n  @Override public <U> List<U> run(final Map<String, int[]> m, int k) throws E {\n    int r = switch (k) { case 1, 2 -> 3; default -> { yield 4; } };\n    Runnable q = () -> m.forEach((a, b) -> go(a));\n    for (String s : m.keySet()) if (s instanceof String t && !t.isEmpty()) continue;\n    return new ArrayList<U>() { public int size() { return 0; } };\n  }\n  enum E { X(1) { void f() {} }, Y; E() {} }\n}\n")
    assert [f[1] for f in a["functions"]] == ["A", "run", None, None, "size", "f", "E"]
    assert names(a, 1) == ["m", "k"] and kinds(a)["case"] == 1 and kinds(a)["import"] == 1


def test_c_and_cpp():
    a = read("a.c", "#include <a.h>\n#define N 3\nstatic int *f(void) { int a[N] = {1, 2}; char *s = \"a\" \"b\"; return (int *)a; }\nstruct s { int x; } v;\nint g(int (*cb)(int), char **argv);\nint g(int (*cb)(int), char **argv) { switch (*argv[0]) { case 'a': cb(1); default: break; case 'b': return 2; } do { } while (0); goto end; end: return sizeof(int); }\n")
    assert [f[1] for f in a["functions"]] == ["f", "g"] and names(a) == [] and names(a, 1) == ["cb", "argv"]
    assert kinds(a)["case"] == 2 and '"a" "b"' in [t[2] for t in a["tokens"]]
    a = read("a.cpp", "#include <vector>\nnamespace n { template <typename T> class A : public B<T> { public: A(int x) : x_(x), y_{1} {} ~A() override {} bool operator==(const A& o) const { return x_ == o.x_ and true; } private: int x_; }; }\nauto n::A<int>::run(std::vector<int>&& v, int k = 3) -> int { auto f = [&](auto q) mutable { return std::move(q); }; for (auto& x : v) { try { f(x); } catch (const std::exception& e) { throw; } } return new Foo(k) ? 1 : 0; }\n")
    assert [f[1] for f in a["functions"]] == ["A", "~A", "operator==", "run", None]
    assert names(a, 3) == ["v", "k"] and kinds(a)["catch"] == 1 and kinds(a)["logical"] == 1


def test_qualified_type_names_in_cpp():
    a = read("a.cpp", "int f() { std::size_t n = 0; std::int64_t m{1}; return n + m; }\n")
    assert kinds(a)["declaration"] == 2


def test_go():
    a = read("a.go", 'package p\nimport (\n\t"a"\n\tb "c"\n)\ntype T struct{ x int }\nfunc (t *T) f(a, b int, c ...string) (int, error) {\n\tx := map[string]int{"k": 1}\n\tif v, ok := x["k"]; ok && v > 0 {\n\t\treturn T{1}.x, nil\n\t} else if a > b {\n\t\tgo func() { defer t.g() }()\n\t} else {\n\t}\n\tswitch y := any(a).(type) {\n\tcase int, string:\n\t\t_ = y\n\tdefault:\n\t}\n\tfor i := range c {\n\t\ti++\n\t}\n\treturn 0, nil\n}\n')
    assert names(a) == ["t", "a", "b", "c"] and kinds(a)["import"] == 2
    assert kinds(a)["branch"] == 2 and kinds(a)["else"] == 1 and kinds(a)["case"] == 1 and len(a["functions"]) == 2


def test_rust():
    a = read("a.rs", "use std::fmt;\n#[derive(Debug)]\nstruct S<'a> { x: &'a str }\nimpl<'a> S<'a> {\n    /// Doc.\n    pub fn run<T: Into<String>>(&self, n: usize, (a, b): (i32, i32)) -> Result<Vec<T>, E> {\n        let v = vec![1, 2];\n        let c = |x: i32, y| x + y;\n        match n { 0 | 1 => return Err(e), k if k > 2 && true => { v.iter().map(|q| q * 2).sum::<i32>(); } _ => {} }\n        if let Some(z) = self.x.get(0)? { 1 } else { while let Some(w) = it.next() { break; } 2 };\n        Ok(S { x: \"a\" })\n    }\n}\n")
    assert [f[1] for f in a["functions"]] == ["run", None, None] and names(a)[1:] == ["n", None]
    assert kinds(a)["case"] == 3 and kinds(a)["loop"] == 1 and a["functions"][0][8] == 1


@pytest.mark.parametrize("path,source", [("a.py", "def f(:\n"), ("a.c", "int f( {\n"), ("a.js", "let = = 3;"), ("a.go", "package p\nfunc f() { if }\n"), ("a.rs", "fn f() { let x = ; }"), ("A.java", "class A { void f() { int x = ; } }"), ("a.ts", "const x = (1;")])
def test_errors_have_a_place(path, source):
    with pytest.raises(frontend.ParseError) as e:
        read(path, source)
    assert e.value.line >= 1


def test_extensions():
    assert frontend.language_of("a/b.tsx") == "tsx" and frontend.language_of("x.h") == "c" and frontend.language_of("x.PY") is None
    assert frontend.language_of(".py") is None and frontend.language_of("a.b/Makefile") is None


def test_long_ladder():
    source = "void f(int a) {\nif (a == 0) { }\n" + "".join(f"else if (a == {i}) {{ }}\n" for i in range(1, 20000)) + "}\n"
    a = read("a.c", source)
    assert a["functions"][0][9] == 20001.0 and max(n[10] for n in a["nodes"] if n[2] == "branch") == 0
