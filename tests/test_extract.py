"""Extractors on small sources, with expected symbols and lines."""

import pytest

from gleanery.operators.extract import extract


def rows(path, text):
    return [(d.kind, d.name, d.start_line, d.end_line) for d in extract(path, text)]


def test_go():
    source = '''package svc

import "fmt"

// func Commented() {}
type Auth interface {
	Login(user string) (map[string]interface{}, error)
}

type Service[T any] struct{ n int }

func (s *Service[T]) Login(user string) (map[string]interface{}, error) {
	text := `func Raw() {`
	fmt.Println("func Quoted() {", text, '{')
	return nil, nil
}

func Routes() struct{ n int } {
	type local struct{}
	return struct{ n int }{1}
}

type (
	A struct{ x int }
	B = string
	C interface{}
)

type Id int
'''
    assert rows("svc/auth.go", source) == [
        ("interface", "Auth", 6, 8),
        ("struct", "Service", 10, 10),
        ("method", "Service.Login", 12, 16),
        ("func", "Routes", 18, 21),
        ("struct", "local", 19, 19),
        ("struct", "A", 23, 27),
        ("struct", "B", 23, 27),
        ("struct", "C", 23, 27),
        ("type", "Id", 29, 29),
    ]
    assert extract("a.go", source)[0].text.startswith("type Auth interface {") and extract("a.go", source)[0].text.endswith("}")


def test_python():
    source = '''@decorated
class Auth:
    def login(self):
        def inner():
            pass
        return 1

    class Nested:
        async def go(self): pass

def routes():
    return 2
'''
    expected = [
        ("class", "Auth", 2, 9),
        ("method", "Auth.login", 3, 6),
        ("method", "Auth.inner", 4, 5),
        ("class", "Nested", 8, 9),
        ("method", "Nested.go", 9, 9),
        ("func", "routes", 11, 12),
    ]
    assert rows("a/b.py", source) == expected
    assert extract("a.py", source)[1].text == "def login(self):\n        def inner():\n            pass\n        return 1"
    # text that doesn't parse
    assert rows("a/b.py", source + "\nbroken = (\n") == expected


def test_rust():
    source = '''use std::fmt;

/* fn commented() { /* nested */ } */
pub struct Parser<'a> { name: &'a str }
pub struct Unit;
struct Pair(i32, i32);
pub(crate) enum Kind { A { x: i32 }, B }

pub trait Walk {
    fn go(&self);
    fn twice(&self) { self.go(); }
}

impl<'a> Parser<'a> {
    pub fn new(name: &'a str) -> Self { let c = '{'; let s = r#"}"#; Parser { name } }
}

impl<T: Fn() -> i32> Walk for &'static Parser<'_> where T: Clone {
    fn go(&self) { fn helper() {} helper() }
}

#[test]
pub async unsafe fn top() -> impl Fn(i32) -> i32 { |x| x }
'''
    assert rows("src/lib.rs", source) == [
        ("struct", "Parser", 4, 4),
        ("struct", "Unit", 5, 5),
        ("struct", "Pair", 6, 6),
        ("enum", "Kind", 7, 7),
        ("interface", "Walk", 9, 12),
        ("method", "Walk.twice", 11, 11),
        ("method", "Parser.new", 15, 15),
        ("method", "Parser.go", 19, 19),
        ("method", "Parser.helper", 19, 19),
        ("func", "top", 23, 23),
    ]


def test_javascript():
    source = '''// function no() {}
class App extends Base {
  constructor(x) { super(x); if (x) { this.go() } }
  static async run(a, b = {c: 1}) {
    const o = { inner(z) { return z }, f: function (q) { return q } };
    return /[{}]/.test(`${a} {`);
  }
  get size() { return 1 }
}
async function start(a) { return new App().run() }
const arrow = () => { start() };
const table = {
  open() { },
  close: function () { },
};
export default function main() { }
'''
    assert rows("web/app.js", source) == [
        ("class", "App", 2, 9),
        ("method", "App.constructor", 3, 3),
        ("method", "App.run", 4, 7),
        ("method", "App.inner", 5, 5),
        ("method", "App.size", 8, 8),
        ("func", "start", 10, 10),
        ("method", "open", 13, 13),
        ("func", "main", 16, 16),
    ]


def test_typescript():
    source = '''export interface Runner<T> extends Base<T> {
  name: string;
  run(n: number): void;
  stop?(): Promise<{ a: number }>;
}
export class App<T extends { x: number }> implements Runner<T> {
  private readonly n: number = 1;
  public async run(n: number): Promise<void> { }
  stop(): Promise<{ a: number }> { return null as any }
}
function pick<K>(x: { k: K }): { k: K } { return x }
'''
    assert rows("web/app.ts", source) == [
        ("interface", "Runner", 1, 5),
        ("method", "Runner.run", 3, 3),
        ("method", "Runner.stop", 4, 4),
        ("class", "App", 6, 10),
        ("method", "App.run", 8, 8),
        ("method", "App.stop", 9, 9),
        ("func", "pick", 11, 11),
    ]


@pytest.mark.parametrize("path", ["a.go", "a.rs", "a.js", "a.ts", "a.py", "a.tsx", "a.jsx"])
def test_odd_sources(path):
    for text in ("", "\n", "{{{", ")]}", "func", "class", "impl", "type (", "fn a(", "interface X", '"unclosed', "`", "/*", "func (", "\x00", "class A { b(", "é" * 50):
        extract(path, text)


def test_other_extensions_give_nothing():
    assert extract("a.java", "class A {}") == extract("Makefile", "all:") == extract("dir.py/x", "def a(): pass") == []
