"""Parsing, construction and file formats."""

from __future__ import annotations

import pytest

from graphloom.operators import structural
from graphloom.sources import construction, files, parsers

PROJECT = {
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"app/auth"\n)\n\nfunc main() {\n\ts := NewServer()\n\ts.Start()\n\tauth.Check("x")\n\tfmt.Println("hi")\n}\n\nfunc loop() {\n\tloop()\n}\n',
    "server.go": "package main\n\ntype Starter interface {\n\tStart() error\n}\n\ntype Base struct {\n\tn int\n}\n\ntype Server struct {\n\tBase\n}\n\nfunc NewServer() *Server {\n\treturn &Server{}\n}\n\nfunc (s *Server) Start() error {\n\treturn nil\n}\n",
    "auth/auth.go": "package auth\n\nfunc Check(s string) bool {\n\treturn helper(s)\n}\n\nfunc helper(s string) bool { return s != \"\" }\n",
    "py/model.py": "import os\nfrom .util import clean\n\nLIMIT = 3\n\nclass Base:\n    def run(self):\n        return 1\n\nclass Model(Base):\n    def run(self):\n        super().run()\n        return clean(self.go())\n\n    def go(self) -> int:\n        return helper()\n\ndef helper():\n    return os.getpid()\n",
    "py/util.py": "def clean(x):\n    return x\n",
    "py/bad.py": "def (:\n",
    "web/app.ts": "import { draw } from './draw';\nexport class App extends Base implements Runner {\n  run(a: number): void {\n    draw(a);\n    this.stop();\n  }\n  stop() {\n  }\n}\nexport const go = async (x) => {\n  draw(x);\n}\n",
    "web/draw.ts": "export function draw(n: number) {\n  console.log(n);\n}\n",
    "web/index.html": '<html><body><a href="a.html">x</a><div id="root"></div><my-box></my-box></body></html>',
    "web/a.css": ".btn { color: red }\n#top { --main: 1 }\n@media (max-width: 1px) { a {} }\n",
    "db.sql": "CREATE TABLE users (\n  id INT,\n  name TEXT\n);\nCREATE VIEW v AS SELECT * FROM users;\n",
    "README.md": "# Title\n\nSee [x](docs/x.md).\n",
    "conf.yaml": "name: x\nother: y\n",
    "Dockerfile": "FROM alpine AS base\nENV A=1\n",
    "run.sh": "go() {\n  echo\n}\nexport X=1\nsource lib.sh\n",
    "x.unknown": "?",
}


@pytest.fixture(scope="module")
def project(spark):
    return spark.createDataFrame(list(PROJECT.items()), "file_path string, text string")


def test_parsers(project):
    s = {(r["file_path"], r["name"], r["kind"]) for r in parsers.symbols(project).collect()}
    assert {("main.go", "main", "function"), ("server.go", "Starter", "interface"), ("server.go", "Server", "struct"), ("py/model.py", "run", "method"), ("py/model.py", "LIMIT", "constant"), ("web/app.ts", "App", "class"), ("web/app.ts", "stop", "method"), ("web/app.ts", "go", "function")} <= s
    assert {("web/index.html", "root", "element"), ("web/index.html", "my-box", "component"), ("web/a.css", "btn", "css_class"), ("web/a.css", "--main", "css_variable"), ("db.sql", "users", "table"), ("db.sql", "name", "column"), ("README.md", "Title", "heading"), ("conf.yaml", "other", "key"), ("Dockerfile", "base", "stage"), ("run.sh", "go", "function")} <= s
    assert {r["file_path"] for r in parsers.parse_errors(project).collect()} == {"py/bad.py", "x.unknown"}
    assert parsers.invalid_symbols(parsers.symbols(project)).count() == 0
    i = {(r["file_path"], r["path"]) for r in parsers.imports(project).collect()}
    assert {("main.go", "fmt"), ("py/model.py", ".util"), ("web/app.ts", "./draw"), ("Dockerfile", "alpine"), ("README.md", "docs/x.md")} <= i


def test_graph(project):
    g = construction.build_graph(project)
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    e = {(names.get(r["src"], r["src"]), names.get(r["dst"], r["dst"]), r["etype"]) for r in g.edges.collect()}
    for want in [("main", "NewServer", "calls"), ("main", "Start", "calls"), ("main", "Check", "calls"), ("Check", "helper", "calls"), ("main", "fmt.Println", "calls"), ("Server", "Base", "embeds"), ("Model", "Base", "embeds"), ("Start", "Server", "receives"), ("NewServer", "Server", "returns"), ("run", "clean", "calls"), ("run", "run", "calls"), ("run", "go", "calls"), ("go", "helper", "calls"), ("run", "draw", "calls"), ("run", "stop", "calls"), ("Model", "run", "defines"), ("web/app.ts", "web/draw.ts", "imports"), ("py/model.py", "py/util.py", "imports")]:
        assert want in e, want
    assert ("Server", "Starter", "implements") in e and ("loop", "loop", "calls") not in e
    assert structural.dangling_edges(g).count() == 0
    assert construction.super_chain(parsers.symbols(project)).where("size(path) = 2").count() >= 2


def test_globs():
    import re

    fits = lambda g, p: bool(re.search(files.glob_regex(g), p))
    assert fits("**/*_test.go", "a/b/x_test.go") and fits("**/*_test.go", "x_test.go") and not fits("vendor/*", "vendor/a/b") and fits("vendor/**", "vendor/a/b")
    assert fits("*.{js,ts}", "a/b.ts") and fits("a?[!0-9].go", "x/abc.go") and not fits("a?[!0-9].go", "ab1.go") and not fits("*.go", "a.gox")


def test_files(spark, tmp_path, project):
    for p, t in PROJECT.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(t)
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "node_modules" / "z.ts").write_text("x")
    w = files.walk(spark, f"file://{tmp_path}/src", (".go", ".py", ".ts"))
    assert {r["file_path"] for r in w.select("file_path").collect()} == {p for p in PROJECT if p.endswith((".go", ".py", ".ts"))}
    assert files.manifest(w).count() == 8
    assert files.grep(project, r"func main", 1).count() == 3
    assert {r["dir"]: r["files"] for r in files.tree(project).collect()}["web"] == 4
    assert files.read_lines(project, "py/util.py", 2, 1).first()["text"] == "    return x"
    g = construction.build_graph(project)
    root = f"file://{tmp_path}/snap"
    for s in ("001", "002"):
        files.save_snapshot(g, root, s)
    back = files.load_snapshot(spark, root)
    assert files.list_snapshots(spark, root) == ["001", "002"]
    assert files.graph_hash(back).first() == files.graph_hash(g).first()
    files.delete_snapshot(spark, root, "001")
    assert files.list_snapshots(spark, root) == ["002"]
    j = files.from_json_lines(files.to_json_lines(g), g.nodes.schema.simpleString(), g.edges.schema.simpleString())
    assert files.graph_hash(j).first() == files.graph_hash(g).first()
    assert files.to_dot(g).count() == g.edges.count() + 2 and files.to_mermaid(g).count() == g.edges.count() + 1
    v = spark.createDataFrame([("a", [1.0])], "id string, vec array<float>")
    assert files.write_vectors(v, f"{root}/vec", "h") and not files.write_vectors(v, f"{root}/vec", "h")


def test_formats(spark):
    text = "--- a/x.go\n+++ b/x.go\n@@ -1,2 +1,3 @@\n a\n+b\n c\n@@ -10 +11,2 @@\n-d\n+e\n+f\n--- a/y.go\n+++ b/y.go\n@@ -5,1 +5,1 @@\n-q\n+r\n"
    h = files.diff_hunks(spark.createDataFrame([(text,)], "text string"))
    assert sorted(map(tuple, h.collect())) == [("x.go", 1, 2, 1, 3, 1, 0), ("x.go", 10, 1, 11, 2, 2, 1), ("y.go", 5, 1, 5, 1, 1, 1)]
    n = spark.createDataFrame([("f", "f", "x.go", 1, 2), ("g", "g", "x.go", 5, 9), ("h", "h", "y.go", 5, 5)], "id string, name string, file_path string, start_line int, end_line int")
    assert {r["id"] for r in files.changed_symbols(h, n).collect()} == {"f", "h"}
    c = files.coverage_profile(spark.createDataFrame([("mode: set",), ("x.go:1.2,3.4 5 1",)], "value string")).first()
    assert tuple(c) == ("x.go", 1, 3, 5, 1)
    l = files.lcov_profile(spark.createDataFrame([("SF:a.js\nDA:1,2\nDA:3,0\nend_of_record\nSF:b.js\nDA:1,1\nend_of_record\n",)], "text string"))
    assert sorted(map(tuple, l.collect())) == [("a.js", 1, 2), ("a.js", 3, 0), ("b.js", 1, 1)]
    from graphloom.operators.impact import owners

    o = owners(spark.createDataFrame([("a/x.go",), ("b/y.py",)], "file_path string"), spark.createDataFrame([(1, "*", "all"), (2, "a/**", "team")], "at int, pattern string, owner string"))
    assert sorted(map(tuple, o.select("file_path", "owner").collect())) == [("a/x.go", "team"), ("b/y.py", "all")]


def test_excludes_at_any_depth(spark, tmp_path):
    keep = ["svc/a.go", "web/x.ts", "building/a.go"]
    drop = ["svc/vendor/a.go", "web/node_modules/x/i.js", ".tox/a.py", "a/.mypy_cache/b.py", "x.test.jsx", "p/test_a.py", "p/conftest.py", "p/a_test.go", "build/z.go"]
    for p in keep + drop:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r["file_path"] for r in files.walk(spark, f"file://{tmp_path}").select("file_path").collect()) == sorted(keep)


def test_references_and_renamed_imports(spark):
    texts = {
        "lib/util.ts": "export function work(x: Item): Result {\n  return x\n}\nexport class Item {\n}\n",
        "lib/more.js": "function helper() {\n  return 1\n}\nmodule.exports = { helper }\n",
        "app.ts": "import { work as w } from './lib/util'\nconst m = require('./lib/more')\n@Inject(Item, Unknown)\nexport class App {\n}\nexport function go(a: Promise<Item>) {\n  if (a instanceof Item) { w(a) }\n  m.helper()\n}\nexport function later() {\n  return import('./lib/more')\n}\n",
        "m.py": "from n import run as r\n@deco(Model, 3)\ndef f(x: 'Model', y: list[Other]) -> Model:\n    if isinstance(x, Other):\n        return r(x)\n",
        "n.py": "class Model:\n    pass\nclass Other:\n    pass\ndef run(x):\n    return x\n",
        "s.go": "package s\ntype Store struct {\n}\nfunc Open(a *Store) Store {\n\tx := y.(Store)\n\treturn x\n}\n",
    }
    g = construction.build_graph(spark.createDataFrame(list(texts.items()), "file_path string, text string"))
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    rows = g.edges.collect()
    refs = {(names[r["src"]], names[r["dst"]], r["line"]) for r in rows if r["etype"] == "references"}
    assert {("work", "Item", 1), ("App", "Item", 3), ("App", "Unknown", 3), ("go", "Item", 6), ("go", "Item", 7), ("f", "Model", 2), ("f", "Model", 3), ("f", "Other", 3), ("f", "Other", 4), ("Open", "Store", 4), ("Open", "Store", 5)} <= refs
    assert not any(d == "Result" for _, d, _ in refs)
    calls = {(names[r["src"]], names[r["dst"]]) for r in rows if r["etype"] == "calls"}
    assert {("go", "work"), ("go", "helper"), ("f", "run")} <= calls
    assert ("app.ts", "lib/more.js") in {(names[r["src"]], names[r["dst"]]) for r in rows if r["etype"] == "imports"}


def test_call_sites_beyond_the_limit(spark):
    text = "def callee():\n    pass\ndef caller():\n" + "    callee()\n" * 1200
    f = spark.createDataFrame([("a.py", text)], "file_path string, text string")
    n = lambda most: construction.build_graph(f, most).edges.where("etype = 'calls'").count()
    assert n(1000) == 1000 and n(None) == 1200


def test_edits_and_exports(spark, tmp_path, project):
    assert {r["file_path"] for r in files.find_files(project, "*.go", "web/**").collect()} == {p for p in PROJECT if p.endswith(".go") or p.startswith("web/")}
    j = spark.createDataFrame([("a.json", '{"a": {"b": 1}}'), ("b.json", "[1]"), ("c.json", "no"), ("d.json", None)], "file_path string, text string")
    assert {r["file_path"]: r["text"] for r in files.json_set(j, "$.a.c", '"x"').collect()} == {"a.json": '{"a": {"b": 1, "c": "x"}}', "b.json": "[1]", "c.json": "no", "d.json": None}
    new = spark.createDataFrame([("a.json", "x\ny"), ("b.json", "[1]"), ("e.json", "n")], "file_path string, text string")
    old = spark.createDataFrame([("a.json", "x\nz\ny"), ("b.json", "[1]"), ("f.json", "q")], "file_path string, text string")
    assert sorted(tuple(r) for r in files.diff_lines(old, new).collect()) == [("a.json", "removed", 2, "z"), ("e.json", "added", 1, "n"), ("f.json", "removed", 1, "q")]
    g = construction.build_graph(project)
    assert "d3.v7" in files.to_html(g)
    with pytest.raises(ValueError, match="at most 1"):
        files.to_html(g, 1)
    rows = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    files.export(rows, f"file://{tmp_path}/c")
    files.export(rows, f"file://{tmp_path}/j", "json")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/c").first()["tags"] == '["a","b"]'
    assert spark.read.json(f"file://{tmp_path}/j").first()["tags"] == ["a", "b"]


def test_patterns_by_structure_and_conventions(spark):
    from graphloom.operators import code

    schema = "id string, name string, kind string, receiver string, package string, signature string, returns string, code string, exported boolean, file_path string"
    row = lambda name, kind="function", receiver=None, returns=None, sig="", text="": (f"{receiver or ''}.{name}", name, kind, receiver, "p", sig, returns, text, True, "a.go")
    s = spark.createDataFrame([
        row("Store", "struct"), row("Query", "struct"), row("Bus", "struct"), row("Shape", "interface"), row("Plain", "struct"),
        row("NewStore", returns="*Store"), row("NewThing", returns="int"), row("GetInstance", returns="Store"), row("WithSize", returns="Option"), row("WithNothing", returns="int"),
        row("Logged", sig="func Logged(next Handler) Handler", returns="Handler"), row("Where", "method", "Query", "*Query"), row("Limit", "method", "Query", "*Query"), row("Build", "method", "Query", "string"),
        row("Subscribe", "method", "Bus"), row("Notify", "method", "Bus"), row("Get", "method", "Store", "error"), row("Save", "method", "Store", "error"), row("Get", "method", "Plain"), row("TestX", text="for _, tt := range tests { t.Run() }"),
    ], schema)
    e = spark.createDataFrame([("Circle", ".Shape", "implements"), ("Square", ".Shape", "implements"), ("X", ".Plain", "implements")], "src string, dst string, etype string")
    got = {(r["id"], r["pattern"]) for r in code.structural_patterns(s, e).collect()}
    assert got == {(".NewStore", "factory"), (".GetInstance", "singleton"), (".WithSize", "options"), (".Logged", "middleware"), (".Shape", "strategy"), (".Query", "builder"), (".Bus", "observer"), (".Store", "repository")}
    imports = spark.createDataFrame([("a.go", None, False, True), ("a.go", "x", False, False)], "file_path string, alias string, is_wildcard boolean, is_relative boolean")
    share = {(r["kind"], r["pattern"]): r["share"] for r in code.conventions(s, imports, 0.1).collect()}
    assert share["imports", "relative"] == 0.5 and share["tests", "table driven"] == 1.0 and share["errors", "returned"] == round(2 / 15, 6) and ("imports", "wildcard") not in share
