"""Declarations and calls of ten languages against what stands in small files: nesting, overloads, brackets in strings and comments."""

import pytest

from loomgraph.operators import syntax

#: By language: the file, its declarations (kind, name, owner, first and last line, exported, parameters, type), its calls (caller, callee, line).
CASES = {
    "java": (
        """package a.b;
import java.util.*;

@Service(name = "x { y")
public class Depot<T extends Item> extends Base implements Runnable {
    private final Map<String, List<T>> held = new HashMap<>();
    public int most;
    // void ghost() { }
    public Depot(String name, int... sizes) {
        super(name);
        setUp("}");
    }
    public Map<String, List<T>> stock(Map<String, T> in, int[] at) throws IOException, Oops {
        if (in.isEmpty()) { return Depot.none(); }
        for (T x : in.values()) { held.put(x.name(), new ArrayList<>()); }
        return held;
    }
    void stock(int n) { this.most = n; }
    static class Shelf {
        @Override
        public String toString() { return "{" + join('}', "a") ; }
    }
    enum Kind { SMALL, BIG }
    abstract String later(long id);
}
interface Store {
    List<Item> all();
    default int size() { return all().size(); }
}
record Pair(int a, int b) { }
""",
        [
            ("class", "Depot", None, 4, 25, True, None, None), ("field", "held", "Depot", 6, 6, False, None, None), ("field", "most", "Depot", 7, 7, True, None, None),
            ("function", "Depot", "Depot", 9, 12, True, ["name", "sizes"], None), ("function", "stock", "Depot", 13, 17, True, ["in", "at"], "Map<String, List<T>>"), ("function", "stock", "Depot", 18, 18, False, ["n"], "void"),
            ("class", "Shelf", "Depot", 19, 22, False, None, None), ("function", "toString", "Shelf", 20, 21, True, [], "String"), ("class", "Kind", "Depot", 23, 23, False, None, None),
            ("signature", "later", "Depot", 24, 24, False, ["id"], "String"), ("class", "Store", None, 26, 29, False, None, None), ("signature", "all", "Store", 27, 27, False, [], "List<Item>"),
            ("function", "size", "Store", 28, 28, False, [], "int"), ("class", "Pair", None, 30, 30, False, None, None),
        ],
        [("Depot", "setUp", 11), ("stock", "in.isEmpty", 14), ("stock", "Depot.none", 14), ("stock", "in.values", 15), ("stock", "held.put", 15), ("stock", "x.name", 15), ("toString", "join", 21), ("size", "all", 28), ("size", "size", 28)],
    ),
    "csharp": (
        """using System;
namespace Shop.Core
{
    [Serializable]
    public sealed class Cart : Base, ICart
    {
        private int count = 0;
        public string Name { get; set; }
        public Cart(string name) : base(name) { Reset("{"); }
        public async Task<List<int>> Load(string path, int most = 3)
        {
            var x = await File.ReadAsync(path);
            return new Parser(x).Run();
        }
        internal int Twice(int n) => Add(n, n);
        public struct Line { public int At; }
    }
    interface ICart { void Reset(string why); }
}
""",
        [
            ("class", "Cart", None, 4, 17, True, None, None), ("field", "count", "Cart", 7, 7, False, None, None), ("field", "Name", "Cart", 8, 8, True, None, None), ("function", "Cart", "Cart", 9, 9, True, ["name"], None),
            ("function", "Load", "Cart", 10, 14, True, ["path", "most"], "Task<List<int>>"), ("signature", "Twice", "Cart", 15, 15, False, ["n"], "int"), ("class", "Line", "Cart", 16, 16, True, None, None),
            ("field", "At", "Line", 16, 16, True, None, None), ("class", "ICart", None, 18, 18, False, None, None), ("signature", "Reset", "ICart", 18, 18, False, ["why"], "void"),
        ],
        [("Cart", "Reset", 9), ("Load", "File.ReadAsync", 12), ("Load", "new Parser", 13), ("Load", "Run", 13)],
    ),
    "go": (
        """package main

import (
\t"fmt"
\tl "log"
)

type Server struct {
\tHost string
\tPorts []int
\tnext *Server
}

type Reader interface {
\tRead(p []byte) (int, error)
}

func (s *Server) Start(ctx Context, f func(int) bool) error {
\tfmt.Println("start {", s.Host)
\tif f(1) {
\t\treturn s.listen(ctx)
\t}
\treturn nil
}

func helper() (int, error) {
\tgo func() { l.Fatal(`}`) }()
\treturn 1, nil
}
""",
        [
            ("class", "Server", None, 8, 12, True, None, None), ("field", "Host", "Server", 9, 9, True, None, None), ("field", "Ports", "Server", 10, 10, True, None, None), ("field", "next", "Server", 11, 11, False, None, None),
            ("class", "Reader", None, 14, 16, True, None, None), ("function", "Start", "Server", 18, 24, True, ["ctx", "f"], "error"), ("function", "helper", None, 26, 29, False, [], "(int, error)"),
        ],
        [("Start", "fmt.Println", 19), ("Start", "f", 20), ("Start", "s.listen", 21), ("helper", "l.Fatal", 27)],
    ),
    "rust": (
        """use std::io;
mod util;

#[derive(Debug, Clone)]
pub struct Engine<'a> { name: &'a str, open: char }

pub enum State { On, Off(u32) }

trait Runs { fn run(&self) -> u32; fn twice(&self) -> u32 { self.run() * 2 } }

impl<'a> Runs for Engine<'a> {
    fn run(&self) -> u32 {
        let brace = '{';
        helper(brace)
    }
}

impl<'a> Engine<'a> {
    pub fn new(name: &'a str, mut size: Option<Vec<u8>>) -> Result<Self, String> {
        let it = util::parse(name)?;
        Ok(Engine::with(it))
    }
}

pub(crate) async fn helper(c: char) -> u32 { /* } */ c.len_utf8() as u32 }
""",
        [
            ("class", "Engine", None, 4, 5, True, None, None), ("class", "State", None, 7, 7, True, None, None), ("class", "Runs", None, 9, 9, False, None, None), ("signature", "run", "Runs", 9, 9, False, ["self"], "u32"),
            ("function", "twice", "Runs", 9, 9, False, ["self"], "u32"), ("function", "run", "Engine", 12, 15, False, ["self"], "u32"), ("function", "new", "Engine", 19, 22, True, ["name", "size"], "Result<Self, String>"), ("function", "helper", None, 25, 25, True, ["c"], "u32"),
        ],
        [("twice", "self.run", 9), ("run", "helper", 14), ("new", "util::parse", 20), ("new", "Ok", 21), ("new", "Engine::with", 21), ("helper", "c.len_utf8", 25)],
    ),
    "php": (
        """<?php
namespace App\\Models;
use App\\Base;
# class Ghost { }
abstract class User extends Base implements HasName
{
    private ?string $name = "{";
    public static int $count = 0;
    public function __construct(private string $first, array $rest = []) { parent::__construct($first); }
    protected function label(int $n): ?string
    {
        $x = new Maker();
        return $this->format(strtoupper($this->name), Helper::pad($n));
    }
    abstract public function later(string $why): void;
}
interface HasName { public function name(): string; }
function boot(string $env): bool { return true; }
""",
        [
            ("class", "User", None, 5, 16, True, None, None), ("field", "$name", "User", 7, 7, False, None, None), ("field", "$count", "User", 8, 8, True, None, None), ("function", "__construct", "User", 9, 9, True, ["first", "rest"], None),
            ("function", "label", "User", 10, 14, False, ["n"], "?string"), ("signature", "later", "User", 15, 15, True, ["why"], "void"), ("class", "HasName", None, 17, 17, True, None, None),
            ("signature", "name", "HasName", 17, 17, True, [], "string"), ("function", "boot", None, 18, 18, True, ["env"], "bool"),
        ],
        [("__construct", "parent::__construct", 9), ("label", "new Maker", 12), ("label", "$this->format", 13), ("label", "strtoupper", 13), ("label", "Helper::pad", 13)],
    ),
    "cpp": (
        """#include <vector>
#define OPEN {
namespace geo {
template <typename T>
class Grid : public Base {
public:
    Grid(int w, int h) : w_(w), h_(h) { fill('{'); }
    virtual ~Grid() = default;
    std::vector<T> row(int y) const { return cells_.at(y); }
    int size();
private:
    int w_ = 0;
};
struct Point { int x; int y; };
}
int geo::Grid::size() { return std::max(w_, 1); }
static void quiet(const char* s, std::map<int, int>& m) { puts("}"); m.clear(); }
""",
        [
            ("class", "Grid", None, 4, 13, True, None, None), ("function", "Grid", "Grid", 6, 7, True, ["w", "h"], None), ("signature", "~Grid", "Grid", 8, 8, True, [], None), ("function", "row", "Grid", 9, 9, True, ["y"], "std::vector<T>"),
            ("signature", "size", "Grid", 10, 10, True, [], "int"), ("field", "w_", "Grid", 11, 12, True, None, None), ("class", "Point", None, 14, 14, True, None, None), ("field", "x", "Point", 14, 14, True, None, None), ("field", "y", "Point", 14, 14, True, None, None),
            ("function", "size", "Grid", 16, 16, True, [], "int"), ("function", "quiet", None, 17, 17, False, ["s", "m"], "void"),
        ],
        [("Grid", "fill", 7), ("row", "cells_.at", 9), ("size", "std::max", 16), ("quiet", "puts", 17), ("quiet", "m.clear", 17)],
    ),
    "kotlin": (
        """package a.b
import x.y.*

data class Point(val x: Int, val y: Int)

open class Shelf<T>(private val name: String) : Base(name), Runs {
    val size: Int = 0
    private var open = "{"
    override suspend fun find(key: Map<String, Int>, most: Int = 3): List<T> {
        return items.filter { it.matches(key) }.toList()
    }
    fun one() = first(size)
    companion object {
        fun make(): Shelf<Int> { return Shelf("a") }
    }
}
private fun String.shout(n: Int): String {
    /* } */ return uppercase()
}
object Store { fun boot() { Shelf.make() } }
""",
        [
            ("class", "Point", None, 4, 4, True, None, None), ("class", "Shelf", None, 6, 16, True, None, None), ("field", "size", "Shelf", 7, 7, True, None, None), ("field", "open", "Shelf", 8, 8, False, None, None),
            ("function", "find", "Shelf", 9, 11, True, ["key", "most"], "List<T>"), ("function", "one", "Shelf", 12, 12, True, [], None),
            ("function", "shout", None, 17, 19, False, ["n"], "String"), ("class", "Store", None, 20, 20, True, None, None), ("function", "boot", "Store", 20, 20, True, [], None),
        ],
        [("find", "matches", 10), ("find", "toList", 10), ("shout", "uppercase", 18), ("boot", "make", 20)],
    ),
    "swift": (
        """import Foundation

public final class Shelf<T>: Base, Runs {
    let size: Int = 0
    private var open = "{"
    init(name: String, most n: Int) {
        super.init(name)
        reset("}")
    }
    public func find(key: [String: Int], at place: Int) throws -> [T] {
        // }
        return items.filter(key)
    }
    struct Line { var at: Int }
}
extension Shelf {
    func twice() -> Int { return add(size, size) }
}
protocol Runs {
    func run(n: Int) -> Bool
}
fileprivate func helper() { Shelf.make() }
""",
        [
            ("class", "Shelf", None, 3, 15, True, None, None), ("field", "size", "Shelf", 4, 4, True, None, None), ("field", "open", "Shelf", 5, 5, False, None, None), ("function", "init", "Shelf", 6, 9, True, ["name", "n"], None),
            ("function", "find", "Shelf", 10, 13, True, ["key", "place"], "[T]"), ("class", "Line", "Shelf", 14, 14, True, None, None), ("field", "at", "Line", 14, 14, True, None, None), ("class", "Shelf", None, 16, 18, True, None, None),
            ("function", "twice", "Shelf", 17, 17, True, [], "Int"), ("class", "Runs", None, 19, 21, True, None, None), ("function", "run", "Runs", 20, 20, True, ["n"], "Bool"), ("function", "helper", None, 22, 22, False, [], None),
        ],
        [("init", "super.init", 7), ("init", "reset", 8), ("find", "items.filter", 12), ("twice", "add", 17), ("helper", "Shelf.make", 22)],
    ),
    "typescript": (
        """import { a } from './a';
export default class Shelf<T> extends Base implements Runs {
  private size: number = 0;
  static open = "{";
  constructor(private name: string, n?: number) {
    super(name);
    reset(`}${n}`);
  }
  async find<K>(key: Map<string, K>, ...rest: number[]): Promise<T[]> {
    if (this.size) { return this.items.filter(key); }
    return new Finder(key).run();
  }
  get total(): number { return this.size }
}
export interface Runs {
  run(n: number): boolean;
  label?: string
}
export async function load(path: string, most = 3): Promise<void> {
  // }
  const text = await read(path)
  helper(text)
}
const inner = (x: number): string => { return String(x); };
export const short = async (x) => twice(x)
enum Kind { A, B }
run(1);
function outer() { function nested() { deep() } }
""",
        [
            ("class", "Shelf", None, 2, 14, True, None, None), ("field", "size", "Shelf", 3, 3, False, None, None), ("field", "open", "Shelf", 4, 4, False, None, None), ("function", "constructor", "Shelf", 5, 8, False, ["name", "n"], None),
            ("function", "find", "Shelf", 9, 12, False, ["key", "rest"], "Promise<T[]>"), ("function", "total", "Shelf", 13, 13, False, [], "number"), ("class", "Runs", None, 15, 18, True, None, None), ("signature", "run", "Runs", 16, 16, False, ["n"], "boolean"),
            ("field", "label", "Runs", 17, 17, False, None, None), ("function", "load", None, 19, 23, True, ["path", "most"], "Promise<void>"), ("function", "inner", None, 24, 24, False, ["x"], "string"), ("function", "short", None, 25, 25, True, ["x"], None),
            ("class", "Kind", None, 26, 26, False, None, None), ("function", "outer", None, 28, 28, False, [], None),
        ],
        [("constructor", "reset", 7), ("find", "this.items.filter", 10), ("find", "new Finder", 11), ("find", "run", 11), ("load", "read", 21), ("load", "helper", 22), ("inner", "String", 24), ("outer", "deep", 28)],
    ),
    "scala": (
        """package a.b
import x.y._

case class Point(x: Int, y: Int)

sealed abstract class Shelf[T](name: String) extends Base(name) with Runs {
  private val open = "{"
  var size: Int = 0
  def find[K](key: Map[String, K], most: Int = 3): List[T] = {
    items.filter(key).toList()
  }
  private def one = first(size)
  override def run(n: Int): Boolean = check(n)
}
object Shelf {
  def make(): Shelf[Int] = {
    // }
    new Maker('{').build()
  }
}
private[b] trait Runs { def run(n: Int): Boolean }
""",
        [
            ("class", "Point", None, 4, 4, True, None, None), ("class", "Shelf", None, 6, 14, True, None, None), ("field", "open", "Shelf", 7, 7, False, None, None), ("field", "size", "Shelf", 8, 8, True, None, None),
            ("function", "find", "Shelf", 9, 11, True, ["key", "most"], "List[T]"), ("function", "one", "Shelf", 12, 12, False, [], None), ("function", "run", "Shelf", 13, 13, True, ["n"], "Boolean"),
            ("class", "Shelf", None, 15, 20, True, None, None), ("function", "make", "Shelf", 16, 19, True, [], "Shelf[Int]"), ("class", "Runs", None, 21, 21, False, None, None), ("function", "run", "Runs", 21, 21, True, ["n"], "Boolean"),
        ],
        [("find", "items.filter", 10), ("find", "toList", 10), ("make", "new Maker", 18), ("make", "build", 18)],
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{k}/{lang}", lang, text) for lang, (text, _, _) in CASES.items() for k in range(2)] + [("none", "java", None), ("empty", "go", ""), ("other", "cobol", "x {"), ("open", "java", "class A {\n void f() { g(")]
    toks = syntax.tokens(spark.createDataFrame(rows, "path string, language string, content string").repartition(3)).cache()
    declared = syntax.declarations(toks).cache()
    return toks, declared, syntax.calls(toks, declared).cache()


@pytest.mark.parametrize("language", sorted(CASES))
def test_declarations(found, language):
    for k in range(2):
        got = found[1].where(f"path = '{k}/{language}'").orderBy("start").collect()
        assert [(r.kind, r.name, r.owner, r.line, r["last"], r.exported, r.params, r.returns) for r in got] == CASES[language][1]


@pytest.mark.parametrize("language", sorted(CASES))
def test_calls(found, language):
    got = found[2].where(f"path = '1/{language}'").orderBy("at").collect()
    assert [(r.caller, r.callee, r.line) for r in got] == CASES[language][2]


def test_files_without_rows_and_files_that_do_not_close(found):
    assert found[0].where("path in ('none', 'empty', 'other')").isEmpty()
    got = found[1].where("path = 'open'").orderBy("start").collect()
    assert [(r.kind, r.name, r.owner, r.line, r["last"]) for r in got] == [("class", "A", None, 1, 2), ("function", "f", "A", 2, 2)]
    assert [(r.caller, r.callee) for r in found[2].where("path = 'open'").collect()] == [("f", "g")]
