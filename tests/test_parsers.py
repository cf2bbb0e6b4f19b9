"""Parsers of brace languages against hand-marked files."""

from __future__ import annotations

import time

import pytest

from graphloom.sources import construction
from graphloom.sources.lexing import bare
from graphloom.sources.parsers import parse

GO = '''package demo

import (
	"fmt"
	str "strings" // func fake() {
	. "app/all"
)

// func commented() { nothing() }
const raw = `func inRaw() {
	call()
}`

type (
	ID int
	Pair[K comparable, V any] struct {
		*Base
		k K `json:"k{"`
	}
)

type Reader interface {
	Read(
		p []byte,
	) (n int, err error)
	Closer
}

var (
	a, b = 1, 2
	table = map[string]int{
		"x": 1,
	}
)

func Long(
	ctx Context,
	opts ...Option,
) (
	*Server,
	error,
) {
	s := "}{ notACall("
	r := '{'
	go func() {
		inner(fmt.Sprintf("%s }", s))
	}()
	return build(ctx)
}

func (p *Pair[K, V]) Map(f func(K) interface{}) interface{} {
	return f(p.k)
}

func After() struct{ X int } { return wrap() }
'''

TS = r'''import {
  draw as d,
  wipe,
} from "./draw"
import def, * as all from 'lib'
import './side'
const { x: y, z } = require('./more')
// function hidden() { a() }
const re = /[{"']\/}/g, half = 4 / 2 / 1
const msg = `a ${fmt({ k: `${deep()} }` })} { function no() {`

export async function outer<T extends { a: number }>(
  first: T,
  second = "){",
): Promise<Map<string, T>> {
  function inner(n: number): number {
    return helper(n) / 2
  }
  const arrow = (k) => inner(k)
  return inner(1) && msg.replace(/\(/g, go())
}

export abstract class Box<T> extends Base<T> implements Runner, Saver<T> {
  private count = 0
  #secret() { hush() }
  constructor(private readonly a: string) {
    super(a)
    this.init()
  }
  static async make(
    opts: { deep: boolean },
  ): Promise<Box> {
    if (opts.deep) { return new Box(text("}")) }
  }
  handle = async (e: Event): Promise<void> => {
    this.stop?.(e)
  }
  get size(): number { return this.count }
}

interface Saver<T> extends Other {
  save(item: T): void;
  load(): T
}
type Pick2 = { a: string }
enum Color { Red, Green }
export const one = 1
export default function () { anonymous() }
const lazy = () => import('./lazy')
'''


def _symbols(p):
    return [(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in p.symbols]


def test_go_declarations():
    p = parse("d/x.go", GO)
    assert _symbols(p) == [
        ("constant", "raw", 10, 10), ("type", "ID", 15, 15), ("struct", "Pair", 16, 19), ("interface", "Reader", 22, 27), ("method", "Read", 23, 25),
        ("variable", "a", 30, 30), ("variable", "table", 31, 31), ("function", "Long", 36, 49), ("method", "Map", 51, 53), ("function", "After", 55, 55),
    ]
    by = {s["name"]: s for s in p.symbols}
    assert by["Long"]["signature"] == "func Long(ctx Context, opts ...Option) (*Server, error)" and by["Long"]["returns"] == "*Server, error"
    assert by["Read"]["signature"] == "Read(p []byte) (n int, err error)" and by["Read"]["receiver"] == "Reader"
    assert by["Map"]["receiver"] == "Pair" and by["Map"]["returns"] == "interface{}" and by["After"]["returns"] == "struct{ X int }"
    assert by["Pair"]["bases"] == ["Base"] and by["Reader"]["bases"] == ["Closer"] and by["Long"]["code"].endswith("build(ctx)\n}")
    assert [(i["path"], i["alias"], i["is_wildcard"]) for i in p.imports] == [("fmt", None, False), ("strings", "str", False), ("app/all", ".", True)]
    assert [(c["caller_id"].split(":")[-1], c["receiver"], c["target"], c["line"]) for c in p.calls] == [("Long", None, "inner", 46), ("Long", "fmt", "Sprintf", 46), ("Long", None, "build", 48), ("Map", None, "f", 52), ("After", None, "wrap", 55)]


def test_script_declarations():
    p = parse("w/a.ts", TS)
    assert _symbols(p) == [
        ("constant", "re", 9, 9), ("constant", "msg", 10, 10), ("function", "outer", 12, 21), ("function", "inner", 16, 18), ("function", "arrow", 19, 19), ("class", "Box", 23, 39),
        ("method", "#secret", 25, 25), ("method", "constructor", 26, 29), ("method", "make", 30, 34), ("method", "handle", 35, 37), ("method", "size", 38, 38),
        ("interface", "Saver", 41, 44), ("method", "save", 42, 42), ("method", "load", 43, 43), ("type", "Pick2", 45, 45), ("enum", "Color", 46, 46), ("constant", "one", 47, 47), ("function", "lazy", 49, 49),
    ]
    by = {s["name"]: s for s in p.symbols}
    assert by["outer"]["signature"].startswith("export async function outer<T extends { a: number }>(first: T, second = ") and by["outer"]["signature"].endswith("): Promise<Map<string, T>>")
    assert by["inner"]["parent"] == by["outer"]["id"] and by["make"]["parent"] == by["Box"]["id"] and by["Box"]["bases"] == ["Base", "Runner", "Saver"] and by["Saver"]["bases"] == ["Other"]
    assert by["outer"]["exported"] and by["make"]["exported"] and not by["#secret"]["exported"] and not by["inner"]["exported"]
    assert {(i["path"], i["alias"], tuple(i["names"]), i["is_wildcard"]) for i in p.imports} == {
        ("./more", "y", ("x",), False), ("./more", None, ("z",), False), ("./draw", "d", ("draw",), False), ("./draw", None, ("wipe",), False), ("lib", "all", (), True), ("./side", None, (), False), ("./lazy", None, (), False),
    }
    assert [(c["caller_id"].split(":")[-1], c["receiver"], c["target"], c["line"]) for c in p.calls] == [
        ("inner", None, "helper", 17), ("arrow", None, "inner", 19), ("outer", None, "inner", 20), ("outer", "msg", "replace", 20), ("outer", None, "go", 20), ("#secret", None, "hush", 25), ("constructor", "this", "init", 28), ("make", None, "Box", 33), ("make", None, "text", 33),
    ]


def test_bare_texts():
    for text, script in ((GO, False), (TS, True), ("", True), ("`${`${", True), ("'\\", False), ("}])", False), ("a = b / c / d; x = /}/", True), ("/* {", True), ("\u00e9 '\u00e9{' {", False)):
        b = bare(text, script)
        assert len(b.text) == len(text) and b.text.count("\n") == text.count("\n")
        assert all(b.text[a] + b.text[z] in ("()", "[]", "{}") for a, z in b.close.items() if b.text[z] in ")]}" and "([{".index(b.text[a]) == ")]}".index(b.text[z]))
    assert bare("a / b / {c}", True).text == "a / b / {c}" and bare("(/{/)", True).text == "(   )" and bare("`{${ {a: `}`} }{`", True).text.count("{") == bare("`{${ {a: `}`} }{`", True).text.count("}") == 2


@pytest.mark.parametrize("name,text", [("x.go", 'func f() {\n\tg("}")\n}\n'), ("x.ts", "function f() {\n  g(`${h()}`)\n}\n"), ("y.ts", "class A {\n m() { q() }\n"), ("z.ts", "{(`${"), ("q.ts", "const a = /"), ("s.ts", "a<function f<"), ("t.go", "type T ["), ("u.go", "func f(")])
def test_time_is_linear(name, text):
    start = time.time()
    parse(name, text * 4000)
    assert time.time() - start < 10


def test_graph_of_nested_functions(spark):
    g = construction.build_graph(spark.createDataFrame([("d/x.go", GO), ("w/a.ts", TS), ("w/empty.ts", ""), ("w/none.go", None)], "file_path string, text string"))
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    calls = {(names[r["src"]], names[r["dst"]]) for r in g.edges.where("etype = 'calls'").collect()}
    assert {("arrow", "inner"), ("outer", "inner"), ("Long", "build")} <= calls and ("inner", "inner") not in calls
