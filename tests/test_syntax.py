"""Facts of small sources, without Spark."""

import random

import pytest

from codeweft.functions import callgraph, facts
from codeweft.functions.lexicon import LANGUAGES
from codeweft.functions.tables import BUILTINS, language_of
from codeweft.syntax import parse
from codeweft.syntax.node import scan


def imports(text, language):
    return [x[:4] for x in facts.imports(parse(text, language), language)]


def functions(text, language):
    return {(f[5], f[0]): f for f in facts.functions(parse(text, language), language)}


def calls(text, language, file="f"):
    root = parse(text, language)
    g = callgraph.build(file, root, language, facts.imports(root, language))
    return [(c.caller, c.callee, [[n for n, _ in a] for a in c.args]) for c in g.calls]


@pytest.mark.parametrize("language", LANGUAGES)
def test_any_text_is_tokenised_without_loss_and_parsed(language):
    rng = random.Random(20)
    bits = ["def ", "class ", "{", "}", "(", ")", "[", "]", "'", '"', '"""', "`", "${", "/*", "*/", "//", "#", "\n", "  ", "x", "=", "=>", ":", ";", ",", ".", "import ", "func ", "new ", "<", ">", "@", "\\", "é", "1.5e", "/re/", "if ", "for ", "in ", "return "]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        assert "".join(t.text for t in scan(text, language)) == text
        root = parse(text, language)
        for n in root.walk():
            assert 0 <= n.start <= n.end <= len(text)
        facts.imports(root, language)
        facts.functions(root, language)
        g = callgraph.build("f", root, language, [])
        callgraph.traverse(g)
    deep = "(" * 5000 + "[" * 5000
    parse(deep, language)


def test_languages_by_path():
    assert [language_of(p) for p in ("a.py", "b/c.mjs", "d.JAVA", "go", "x.tar.go", "y.js/z")] == ["python", "javascript", None, None, "go", None]
    assert [len(BUILTINS[x]) for x in ("python", "javascript", "go", "java")] == [157, 37, 19, 29]


def test_python_imports():
    text = "import a.b, c as d\nfrom m import (x as y,\n  z)\nfrom . import r\nfrom q.w import *\nfrom __future__ import annotations\nif 1:\n    from ..p import s\n"
    assert imports(text, "python") == [("a.b", "", "a.b", False), ("c", "", "d", False), ("q.w", "", "", True), ("m", "x", "y", False), ("m", "z", "z", False), (".", "r", "r", False), ("..p", "s", "s", False)]


def test_javascript_imports():
    text = """
import def, { one, two as deux } from "m1";
import * as ns from 'm2'; import 'side';
const { b, k: v } = require("r1"), p = require('r2');
var skipped = require("r3"); let l = await import("dyn");
export { x } from "no";
"""
    assert imports(text, "javascript") == [("m1", "", "def", False), ("m2", "", "ns", False), ("dyn", "", "l", False), ("m1", "one", "one", False), ("m1", "two", "deux", False), ("r2", "", "p", False), ("r1", "k", "v", False), ("r1", "b", "b", False)]


def test_go_and_java_imports():
    text = 'package p\nimport "fmt"\nimport (\n\ta "x/y"\n\t_ "side"\n\t. "dot/d"\n\t`raw`\n)\n'
    assert imports(text, "go") == [('"fmt"', "", '"fmt"', False), ('"x/y"', "", "a", False), ('"side"', "", "", True), ('"dot/d"', "", "", True)]
    text = "package q; import a.b.C; import static a.b.D.e; import x.y.*; import Plain;"
    assert imports(text, "java") == [("a.b.C", "", "C", False), ("a.b.D.e", "", "e", False), ("x.y", "", "", True)]


def test_python_functions_and_classes():
    text = "class A(B, m.C, metaclass=M):\n    self.x = 1\n    def __init__(self, a, *b, c: int = 2, d=3): pass\n    @staticmethod\n    def s(): pass\n    @classmethod\n    def c(cls):\n        def inner(): pass\n    @abstractmethod\n    def t(self): ...\n@deco\n@mod.deco(1)\nasync def g(x: str) -> int: pass\n"
    f = functions(text, "python")
    assert f["A", "__init__"][1] == ["self", "a", "d=3"] and f["A", "__init__"][3] == "constructor"
    assert f["A", "s"][3] == "static_method" and f["A", "c"][3] == "method" and f["A", "inner"][3] == "method" and f["A", "t"][7]
    assert f["", "g"][3] == "async" and f["", "g"][6] == ["@deco"] and f["", "g"][9]
    ((name, bases, methods, fields, ctor, *_),) = facts.classes(parse(text, "python"), "python")
    assert (name, bases, methods, fields, ctor) == ("A", ["B", "m.C"], ["__init__"], ["self.x = 1"], "__init__")
    assert facts.inheritance(parse(text, "python"), "python") == [("A", "B", "inherits", 1), ("A", "m.C", "inherits", 1)]


def test_javascript_functions():
    text = "function a(x, y = 1, ...z) {}\nasync function b() {}\nconst c = (q) => q, e = function (n) {}, h = function named() {};\nd = z => { return z };\nclass K { constructor() {} async m() {} static s() {} get p() { return 1 } #q() {} @dec w() {} }\nfunction* gen() {}\n"
    f = functions(text, "javascript")
    assert {k: v[3] for k, v in f.items()} == {("", "a"): "function", ("", "b"): "async", ("", "c"): "arrow", ("", "d"): "arrow", ("", "named"): "function", ("K", "constructor"): "constructor", ("K", "m"): "async", ("K", "s"): "method", ("K", "p"): "method", ("K", "w"): "method"}
    assert f["", "a"][1] == ["x", "y = 1", "...z"]


def test_go_and_java_functions():
    f = functions("package p\nfunc Pub(a, b int) (int, error) { return 1, nil }\nfunc (t *T[K]) gen() {}\nfunc (t T) m() {}\nfunc ext()\n", "go")
    assert {k: (v[3], v[4]) for k, v in f.items()} == {("", "Pub"): ("function", "public"), ("T", "m"): ("method", "package")}
    text = 'public abstract class A<T> extends B implements I {\n @Anno(1) private static <X> int m(int a, String... b) throws E { return (int) f(a); }\n void m(long z) {}\n abstract void n();\n A() { super(); }\n int x = 1, y[];\n}\ninterface I { void q(); default void r() {} }\n'
    f = functions(text, "java")
    assert f["A", "m"][1] == ["long z"] and f["A", "m"][4] == "package" and ("A", "n") not in f and f["A", "A"][3] == "constructor" and f["", "r"][3] == "function"
    rows = facts.classes(parse(text, "java"), "java")
    assert rows[0][:6] == ("A", ["B"], ["m", "m", "n"], ["int x = 1, y[];"], "A", []) and rows[1][0] == "I" and rows[1][6]


def test_stripped_comments():
    text = '"""module"""\nx = "# kept"  # gone\ndef f():\n    \'\'\'doc\'\'\'\n    return {\n        "a":\n            "b"\n    }\n# end\n\n'
    assert facts.stripped(text, "python") == '\nx = "# kept"  \ndef f():\n    \n    return {\n        "a":\n            "b"\n    }\n'
    assert facts.stripped("a(); // x\n/* y */ b('//'); /re\\/*/.t\n", "javascript") == "a(); \n b('//'); /re\\/*/.t"


def test_python_calls():
    text = "import os\nfrom lib import K as kk, go\nclass C:\n    def __init__(self, n):\n        self.n = n\n    def m(self):\n        self.h(1)\n        go('x')\n    def h(self, v): pass\nc = C(2)\nc.m()\nx = 1 if c else 'two'\nprint(x, os.path)\nos.path.join(x)\nunknown(3)\n"
    got = calls(text, "python")
    assert ("f//C//m", "f//C//self//h", [["1"]]) in got and ("f//C//m", "lib//go", [["'x'"]]) in got or ("f//C//m", "go", [["'x'"]]) in got
    assert ("f", "f//C", [["2"]]) in got and ("f", "f//C//m", []) in got
    assert ("f//C", "f//C//__init__", []) in got and ("f//C//self//m", "f//C//m", []) in got
    assert ("f", "os//path//join", [["1", "f//C", "'two'"]]) in got
    assert not any(c[1].endswith("unknown") for c in got)


def test_java_calls():
    text = 'import java.util.List;\nclass A {\n void run() { int n = 5; String s = "q"; n = 7; List.of(n, s); a.b.C.go().then(2); new A().run(); helper(); }\n void helper() {}\n public static void main(String[] x) { A a = new A(); a.run(); }\n}\n'
    got = calls(text, "java")
    assert ("f//A//run", "java//util//List//of", [["5", "7"], ['"q"']]) in got
    assert ("f//A//run", "a//b//C//go", [["2"]]) in got and ("f", "f//A//main", []) in got
    assert ("f//A//main", "f//A//run", []) in got


def test_go_and_javascript_calls():
    got = calls('package p\nimport "net/http"\nfunc (s *S) M() { http.Get("u"); x := y(); x.Z() }\nfunc main() { helper(1) }\n', "go")
    assert ("f//S//M", "net//http//Get", [['"u"']]) in got and ("f//S//M", "f//S//M//x//Z", []) in got and ("f", "f//main", []) in got and ("f//main", "f//main//helper", [["1"]]) in got
    got = calls("const e = require('exp');\nclass K { constructor() { this.a(); } a() {} }\nconst k = new K(1);\nk.a(2);\nconst g = () => { e.x.y(z()); };\n", "javascript")
    assert ("f//K//constructor", "f//K//this//a", []) in got and ("f", "f//K//a", []) in got and ("f", "f//K", []) in got
    assert ("f//g", "exp//x//y", []) in got and not any(c[1].endswith("//z") for c in got)


def test_resolution_and_traversal():
    r = callgraph.resolve
    assert set(r({"A": ["B"], "B": ["C", "D"], "C": ["B"], "D": []}, "A")) == {"B", "D"}
    assert r({"A": ["B", "C"], "B": ["C"], "C": ["B"]}, "A") == ["B"]
    assert r({}, "x") == [] and r({"x": []}, "x") == ["x"]
    root = parse("def a():\n    b()\ndef b():\n    a()\nb()\n", "python")
    items, cut = callgraph.traverse(callgraph.build("f", root, "python", []))
    assert not cut and items[0].namespace == "f" and {i.namespace for i in items} >= {"f//a", "f//b"}
    assert callgraph.traverse(callgraph.build("f", root, "python", []), 2)[1]
