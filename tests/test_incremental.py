"""A refreshed project equals one that is built anew, edge by edge, after random edits."""

from __future__ import annotations

import random
from collections import Counter

from graphloom.sources import construction

NAMES = ["alpha", "beta", "gamma", "delta", "load", "save"]
TYPES = ["Store", "Reader", "Base", "Cache"]
FILES = [f"pkg/{d}/m{i}.py" for d in ("a", "b") for i in range(3)] + ["pkg/go/x.go", "pkg/go/y.go"]


def python_file(r):
    out = []
    for _ in range(r.randint(0, 3)):
        module, name = f"pkg.{r.choice('ab')}.m{r.randrange(4)}", r.choice(NAMES + TYPES)
        out.append(r.choice([f"import {module}", f"from {module} import {name}", f"from {module} import {name} as short", f"import {module} as mod"]))
    for _ in range(r.randint(0, 2)):
        out += [f"class {r.choice(TYPES)}({r.choice(['', 'Base', 'Store', 'mod.Reader'])}):"] + [f"    def {r.choice(NAMES)}(self) -> {r.choice(TYPES)}:\n        self.{r.choice(NAMES)}()\n        super().{r.choice(NAMES)}()\n        return {r.choice(TYPES)}()" for _ in range(r.randint(1, 2))]
    for _ in range(r.randint(0, 3)):
        out += [f"def {r.choice(NAMES)}(x: {r.choice(TYPES)}):"] + [r.choice([f"    {r.choice(NAMES)}()", f"    x.{r.choice(NAMES)}()", "    short()", f"    mod.{r.choice(NAMES)}()", f"    Store.{r.choice(NAMES)}()"]) for _ in range(r.randint(1, 3))]
    return "\n".join(out) + "\n"


def go_file(r):
    out = ["package go"]
    for t in r.sample(TYPES, 2):
        out += [f"type {t} struct {{", "}"] + [f"func (s *{t}) {m.title()}() {{\n\ts.{r.choice(NAMES).title()}()\n}}" for m in r.sample(NAMES, 2)]
    i, m = r.choice(["Saver", "Loader"]), r.sample(NAMES, r.randint(1, 2))
    return "\n".join([*out, f"type {i} interface {{", *(f"\t{x.title()}()" for x in m), "}", f"func {r.choice(NAMES)}() {{\n\t{r.choice(NAMES)}()\n}}"]) + "\n"


def made(r, path):
    return python_file(r) if path.endswith(".py") else go_file(r)


def test_refresh_equals_rebuild(spark):
    r = random.Random(11)
    texts = {f: made(r, f) for f in FILES[:-1]}
    files = lambda t: spark.createDataFrame(sorted(t.items()), "file_path string, text string")
    project = construction.parse_project(files(texts))
    seen = set()
    for step in range(2):
        changed = r.sample(FILES, 3)
        for f in changed:
            k = r.random()
            if f in texts and k < 0.3:
                del texts[f]
            elif f in texts and k < 0.45:
                texts[f] = "\n" + texts[f]  # the same symbols, elsewhere
            else:
                texts[f] = made(r, f)
        project = construction.refresh(project, spark.createDataFrame([(f,) for f in changed], "file_path string"), files({f: texts[f] for f in changed if f in texts} | {"zz": ""}))
        new, old = construction.project_graph(project), construction.build_graph(files(texts))
        rows = lambda d: Counter(tuple(x) for x in d.select(*sorted(d.columns)).collect())
        assert rows(new.edges) == rows(old.edges)
        assert rows(new.nodes) == rows(old.nodes)
        seen |= {x["etype"] for x in new.edges.select("etype").distinct().collect()}
    assert {"calls", "imports", "embeds", "implements", "receives", "returns", "references"} <= seen


def test_body_edits_touch_their_file_only(spark):
    """A changed body resolves nothing in other files; a new name resolves its callers in files that didn't change."""
    a, b = "def f():\n    g()\n", "def h():\n    pass\n"
    project = construction.parse_project(spark.createDataFrame([("a.py", a), ("b.py", b)], "file_path string, text string"))
    outside = lambda p: {x["dst"] for x in construction.project_graph(p).edges.where("etype = 'calls'").collect()}
    assert outside(project) == {"external:g"}
    changed = spark.createDataFrame([("b.py",)], "file_path string")
    more = construction.refresh(project, changed, spark.createDataFrame([("b.py", b + "def g():\n    pass\n")], "file_path string, text string"))
    found = outside(more)
    assert len(found) == 1 and next(iter(found)).startswith("b.py")
    back = construction.refresh(more, changed, spark.createDataFrame([("b.py", b)], "file_path string, text string"))
    assert outside(back) == {"external:g"} and construction.project_graph(back).nodes.where("id = 'external:g'").count() == 1
