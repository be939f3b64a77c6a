import ast
import json
import random
import warnings

import pytest

from loomgraph.llm import sources as s
from loomgraph.llm.syntax import check

FILES = "file_id long, repository string, file_path string, content string, language string, line int"
JAVA = '''package a.b; import static java.util.List.*; import java.util.*;
@A(x = 1, y = {1, 2}) public sealed abstract class T<K extends Comparable<? super K> & Runnable, V> extends B<K, List<V>[]> implements I permits X {
  enum E implements I { A(1) { void f() {} }, B; E(int... x) {} }
  record P<T>(int x, @N List<T> y) { P { if (x < 0) throw new E(); } }
  @interface An { int v() default 1; String[] w() default {"a"}; }
  interface I { default void f() {} static int g() { return 1; } void h(); }
  private final Map<String, Map<Integer, List<? extends Number>>> m = new HashMap<>() {{ put("a", null); }}, n;
  public <R> R f(final int x, String... s) throws Exception {
    for (int i = 0, j = 1; i < 10 && j > 2; i++, j--) { if (i >> 2 > 1 || i >>> 3 >= 2) continue; i >>= 2; i >>>= 3; }
    for (var e : m.entrySet()) print(e.getKey() + 'x' + '\\n' + '\\u0041' + 0x1FL + 1e-3f + 1_000 + .5 + 0b10);
    Function<Integer, Integer> g = y -> y + 1; BiFunction<A, B, C> h = (a, b) -> a.f(b); Supplier<int[]> q = int[]::new;
    Object o = (Runnable & Serializable) () -> {}; int z = (int) -x; T.<String>foo().bar();
    if (o instanceof String str && str.length() > 1) {} else { }
    int k = switch (x) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E(); };
    try (var a = open(); Reader c = d) { } catch (A | B e) { } finally { }
    String tb = """
      hello "x" \\""" {
      """;
    return cond ? (a) : b; } }
'''
BAD_JAVA = ["class A { void f() { int x = ; } }", "class A { void f() { foo() } }", "class A { f() { } }", "class A { void f() { ", "class A { int x = 1 }", "clas A {}", 'class A { String s = "abc; }', "class A { char c = ''; }", "class A { void f() { x + 1; } }", "def f(): pass", "class A { } }", "class A { void f() { try { } } }", "<<<<<<< HEAD\nclass A {}", "/* open"]
GOOD_YAML = ["", "# c\n", "a: 1\nb:\n- x\n- y: 2\n  z: [1, {q: w}]\n", "a: |\n  x: y\n  =======\nb: >-\n  t\n", "--- \na: &k {x: 1}\nb: *k\n...\n---\nplain text\nmore\n", '{"a": [1, 2,\n "x"]}\n', "? k\n: v\n", "a: 'it''s'\nb: \"x\\ty\"\n", "import x\nfrom y\n"]
BAD_YAML = ["a: b: c\n", "a: 'open\n", "a: [1, 2\n", "a: 1\n b: 2\n", "a:\n\tb: 1\n", "a: @x\n", "a: - b\n", "<<<<<<< HEAD\na: 1\n", "a: 1\nb\n", "a: *nobody\n", 'a: "\\q"\n', "- a\nb: 1\n"]


def test_java():
    assert check("java", JAVA) == []
    assert all(not check("java", x) for x in ["", "// only\n", "package a;", "interface A { int X = 1; }"])
    assert [x for x in BAD_JAVA if not check("java", x)] == []


def test_yaml():
    assert [x for x in GOOD_YAML if check("yaml", x)] == []
    assert [x for x in BAD_YAML if not check("yml", x)] == []


def python_ok(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "x", "exec", dont_inherit=True)
            return True
        except (SyntaxError, ValueError):
            return False


def mutated(text, rnd):
    lines = text.split("\n")
    i = rnd.randrange(len(lines))
    kind = rnd.randrange(5)
    if kind == 0:
        del lines[i]
    elif kind == 1:
        lines[i] = lines[i][: rnd.randrange(len(lines[i]) + 1)]
    elif kind == 2:
        lines[i] = " " * rnd.randrange(4) + lines[i]
    elif kind == 3:
        at = rnd.randrange(len(lines[i]) + 1)
        lines[i] = lines[i][:at] + rnd.choice("()[]{}:,'\"=") + lines[i][at:]
    else:
        lines.insert(i, "<<<<<<< HEAD")
    return "\n".join(lines)


def test_python_against_the_compiler():
    import dataclasses
    import inspect

    rnd, text = random.Random(4), inspect.getsource(dataclasses)
    assert check("py", text) == []
    parts = ["\n".join(text.split("\n")[i : i + 40]) for i in range(0, 900, 30)]
    wrong = [t for p in parts for t in [p, *(mutated(p, rnd) for _ in range(8))] if bool(check("py", t)) == python_ok(t)]
    assert len(wrong) <= 2, wrong[:1]


@pytest.mark.parametrize("text,ok", [("", True), ("print 'x'", False), ("x = 010", False), ("def f(:\n  pass", False), ("f'{a!r:>{w}} {'q'}'", True), ("f'{a b}'", False), ("match x:\n  case [1, *_] | {'a': int()} if b: pass", True), ("match = 1; match(match)", True), ("def f(a, b=1, /, *, c, **k) -> int: return a", True), ("def f(a=1, b): pass", False), ("if x:\npass", False), ("return 1", False), ("async def f():\n  async with a as b, c: await d", True), ("a = b = *c, d", True), ("f(x for x in y, 1)", False), ("with (open(a) as b, open(c) as d): pass", True), ("lambda *a, k=1: (yield)", True), ("x: int = 1\ny[0]: str", True), ("1 = x", False), ("try: pass\nexcept* E: pass", True), ("type X[T] = list[T]", True), ("'\\N{DASH}'", False), ("'a' b'c'", False), ("(" * 90 + "1" + ")" * 90, True)])
def test_python_cases(text, ok):
    assert (not check("py", text)) == ok == python_ok(text)


def test_json_against_the_library():
    rnd, good = random.Random(6), json.dumps({"a": [1, -2.5e3, True, None, {"b": "x\u00e9\\n"}], "c": {}}, indent=1)

    def no(x):
        raise ValueError(x)

    for text in [good, "", "NaN", "[1,]", "01", '"\t"', '{"a" 1}', "[1] x", *(mutated(good, rnd) for _ in range(300))]:
        try:
            json.loads(text, parse_constant=no)
            ok = True
        except ValueError:
            ok = False
        assert (not check("json", text)) == ok, text


def test_panic_mode_finds_every_error():
    assert len(check("py", "x = = 1\ny = 2\nz = )\ndef f():\n    return 1 2\n")) >= 3
    assert len(check("java", "class A { void f() { int x = ; } void g() { y z w; } int q = ; }")) == 3
    assert len(check("json", '{"a": , "b": 1, "c": }')) == 2


def test_files(spark):
    rows = [(1, "r", "a.PY", "x = 1", "zz", 1), (1, "r", "a.PY", "x = 1", "zz", 1), (2, "r", "b.py", "x = (", None, 1), (3, "r", "c.md", "(((", None, 1), (4, None, "d.json", "", None, 1), (5, "r", "e.py", "", None, 1), (6, "r", "f.py", None, None, 1), (7, "r", None, "x", None, 1), (8, "r", "noext", "x", None, 1), (9, "r", "g.yaml", "a: " + "x" * 200_000, None, 1)]
    df = spark.createDataFrame(rows, FILES)
    parsed = s.parse_files(df)
    assert {r.file_id: r.accepted for r in parsed.collect()} == {1: True, 2: False, 4: False, 5: True, 9: True}
    assert {(r.repository, r.language): (r.files, r.invalid) for r in s.acceptance(parsed).collect()} == {("r", "python"): (3, 1), (None, "json"): (1, 1), ("r", "yaml"): (1, 0)}
    chunks = spark.createDataFrame([("n1", 0, "r", "./B.py"), ("n2", 0, "r", "a.py"), ("n3", 0, "r", None)], "node_id string, chunk_index int, repository string, file_path string")
    assert [r.node_id for r in s.broken_chunks(parsed, chunks).collect()] == ["n1"]
    assert s.parse_files(df.limit(0)).count() == 0 and s.documented_functions(df.limit(0)).count() == 0


PY = '''def outer(a):
    """Reads the file and keeps every line that matches.

    :param a: one two three four five six
    """
    class In:
        async def get_name(self, x=")", y={"a": [1]}) -> "x: y": # note
            # comment first

            r"Get name name get name of it."
            def deep(): "One line documentation of the deep function"
    f"""def fake(): 'one two three four five'"""
def strings():
    f"not a docstring but {1} formatted text here"
def parens(): ("A docstring in brackets of" " several words")
def calls():
    "this is a method call not a docstring".strip()
'''
JV = '''class A {
  /** Reads the file and keeps every line. */
  @Deprecated @X(")") public static <T> List<T> readAll(Map<String, List<T>> m) throws E { String s = "}"; /* } */
     Runnable r = new Runnable() { /** Runs it once for each of them. */ public void run() { } }; return null; }
  /* Not documentation at all for this one. */ void plain() { }
  /** Belongs to the field below it, not to a method. */ int x = 1;
  void near() { }
  /** readAll read all
   * @param a one two three four five */ void readAll() { }
  String t = "/** one two three four */ void no() {}";
  /** Nothing of a body but four words. */ abstract int noBody(int a);
}
'''


def test_functions():
    got = {(line, name): doc for line, name, doc, _ in s.functions("py", PY)}
    tree = {(n.lineno, n.name): d for n in ast.walk(ast.parse(PY)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and (d := ast.get_docstring(n, clean=False)) is not None}
    assert got == tree and len(got) == 4
    assert [(line, n) for line, n, *_ in s.functions("java", JV)] == [(3, "readAll"), (4, "run"), (9, "readAll"), (11, "noBody")]
    code = {n: c for _, n, _, c in s.functions("java", JV)}
    assert code["run"] == "public void run() { }" and code["noBody"].endswith(";")


def test_documented_functions(spark):
    crlf = PY.replace("\n", "\r\n")
    df = spark.createDataFrame([(1, "r", "a.py", crlf, None, 1), (1, "r", "a.py", crlf, None, 1), (2, "r", "A.java", JV, None, 1), (3, "r", "b.py", "def f(:\n    'one two three four five'", None, 1), (4, "r", "c.py", None, None, 1)], FILES)
    got = [(r.file_id, r.line, r.name) for r in s.documented_functions(df).collect()]
    assert sorted(got) == [(1, 1, "outer"), (1, 11, "deep"), (1, 15, "parens"), (2, 3, "readAll"), (2, 4, "run"), (2, 11, "noBody")]


@pytest.mark.parametrize("extension, text, valid", [
    ("json", "[" * 300_000 + "]" * 300_000, True), ("json", '{"a":' * 50_000 + "1" + "}" * 50_000, True), ("json", "[" * 300_000, False), ("json", '{"a": [1, {"b": null}], "c": {}}', True),
    ("json", '{"a": 1,}', False), ("json", "[1,]", False), ("json", "[] []", False), ("json", "", False), ("json", '{"a"}', False), ("json", "[1 2]", False), ("json", '{1: 2}', False),
    ("py", "x = " + "(" * 200 + "1" + ")" * 200, True), ("py", "x = " + "(" * 201 + "1" + ")" * 201, False),
])
def test_depth(extension, text, valid):
    assert (not check(extension, text)) == valid
