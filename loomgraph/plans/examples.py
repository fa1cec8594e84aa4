"""Example files whose names follow a document's id, and what the parsers must find in them."""

from __future__ import annotations

#: Source files by language; ``{id}`` stands for a document's id.
SOURCES = {
    "typescript": """import { load } from './store{id}';
import * as path from "path";
// function hidden() { return 1; }
export function open{id}(name: string, n = 1): Promise<string> {
  const text = load(name);
  return path.join(text, format(n));
}
const inner = async (x: number) => open{id}(String(x));
export default class Shelf{id} extends Base {
  private size: number = 0;
  constructor(n: number) {
    super(n);
  }
  async find(key: string): Promise<void> {
    this.cache.get(key);
    const s = "brace { in a string";
    helper(s);
  }
}
export { inner as entry{id} };
""",
    "go": """package main

import (
\t"fmt"
\tstore "example.com/app{id}/store"
)

type Server{id} struct {
\tname string
}

type reader interface {
\tRead() string
}

func (s *Server{id}) Start(port int) error {
\tfmt.Println("start {")
\treturn s.listen(port)
}

func main{id}() {
\tstore.Open()
}
""",
    "rust": """use crate::store{id}::Shelf;
mod util;

pub struct Engine{id} {
    size: u32,
}

enum State { On, Off }

impl Engine{id} {
    pub fn new(size: u32) -> Self {
        log(size);
        Shelf::open(size)
    }
    fn step(&mut self) {
        self.turn();
    }
}

pub(crate) fn run{id}(n: usize) -> bool {
    Engine{id}::new(n)
}
""",
    "java": """package app;
import java.util.List;
import static app.Tools.check;

public class Store{id} {
    private int size;
    public Store{id}(int size) {
        this.size = size;
        init();
    }
    public List<String> names(String prefix, int n) {
        return check(new Finder(prefix).find(n));
    }
    private void init() {
    }
}
interface Reader {
    String read();
}
""",
    "csharp": """using System.Linq;
namespace App{id}
{
    public class Service{id} : Base
    {
        public Service{id}(int n) { Setup(n); }
        public string Name(int id)
        {
            return Format(id);
        }
        private void Setup(int n) => Log.Write(n);
    }
    internal interface IReader { }
}
""",
    "kotlin": """package app
import app.store.Shelf{id}
import app.tools.*

data class Item{id}(val name: String, val n: Int)

class Cart {
    fun add(item: Item{id}): Boolean {
        return check(item)
    }
    private fun check(item: Item{id}): Boolean = item.valid()
}

fun main{id}() {
    println(Cart().add(Item{id}("a", 1)))
}
""",
    "swift": """import Foundation

public class Player{id} {
    init(name: String) {
        setup(name)
    }
    func play(at position: Int) -> Bool {
        return engine.start(position)
    }
    private func stop() {
    }
}

func launch{id}() {
    let p = Player{id}(name: "x")
}
""",
    "php": """<?php
namespace App;
use App\\Store\\Shelf{id};

function helper{id}($a, $b) {
    return strlen($a);
}

class Cart{id} {
    public function add($item) {
        $this->check($item);
        Shelf::open($item);
    }
}
""",
    "cpp": """#include <vector>
#include "store{id}.h"

class Ring{id} {
public:
  int size() const { return count(items); }
};

static int helper{id}(int a) {
  return a;
}

int Ring{id}::push(int x) {
  return helper{id}(x);
}
""",
    "dart": """import 'package:app/store{id}.dart';

class Cart{id} {
  int add(int n) {
    return _check(n);
  }
}

int _check(int n) => n;

void main{id}() {
  print(Cart{id}().add(1));
}
""",
    "scala": """package app
import app.store.{Shelf, Box{id}}

trait Reader {
  def read(n: Int): String
}

class Engine{id} extends Reader {
  def read(n: Int): String = {
    format(n)
  }
  private def hidden(x: Int): Int = x
}
""",
    "ruby": """require 'json'
require_relative 'lib/store{id}'

module Shop
  class Cart{id}
    def add(item, n)
      check(item)
      @items.push(n)
    end

    def self.build()
      new()
    end
  end
end

def helper{id}(x)
  Shop.open(x)
end
""",
    "python": """import os
from .store{id} import load as fetch


def run{id}(name: str, n: int = 1) -> str:
    text = fetch(name)
    return os.path.join(text, str(n))


class Shelf{id}(Base):
    size: int = 0

    def find(self, key):
        return self.cache.get(key)
""",
}

#: What the parsers must find in them: kind, name, first and last line, what it lies in, exported, parameters, return type.
FOUND = {
    "typescript": [
        ("import", "./store{id}", 1, 1, None, False, None, None),
        ("import", "path", 2, 2, None, False, None, None),
        ("function", "open{id}", 4, 7, None, True, "name: string, n = 1", "Promise<string>"),
        ("call", "load", 5, 5, "open{id}", False, None, None),
        ("call", "path.join", 6, 6, "open{id}", False, None, None),
        ("call", "format", 6, 6, "open{id}", False, None, None),
        ("function", "inner", 8, 8, None, False, "x: number", None),
        ("call", "open{id}", 8, 8, "inner", False, None, None),
        ("call", "String", 8, 8, "inner", False, None, None),
        ("class", "Shelf{id}", 9, 19, None, True, None, None),
        ("method", "constructor", 11, 13, "Shelf{id}", False, "n: number", None),
        ("method", "find", 14, 18, "Shelf{id}", False, "key: string", "Promise<void>"),
        ("call", "this.cache.get", 15, 15, "find", False, None, None),
        ("call", "helper", 17, 17, "find", False, None, None),
        ("export", "entry{id}", 20, 20, None, True, None, None),
    ],
    "go": [
        ("import", "fmt", 4, 4, None, False, None, None),
        ("import", "example.com/app{id}/store", 5, 5, None, False, None, None),
        ("class", "Server{id}", 8, 10, None, True, None, None),
        ("class", "reader", 12, 14, None, False, None, None),
        ("function", "Start", 16, 19, "Server{id}", True, "port int", "error"),
        ("call", "fmt.Println", 17, 17, "Start", False, None, None),
        ("call", "s.listen", 18, 18, "Start", False, None, None),
        ("function", "main{id}", 21, 23, None, False, "", None),
        ("call", "store.Open", 22, 22, "main{id}", False, None, None),
    ],
    "rust": [
        ("import", "crate::store{id}::Shelf", 1, 1, None, False, None, None),
        ("import", "util", 2, 2, None, False, None, None),
        ("class", "Engine{id}", 4, 6, None, True, None, None),
        ("class", "State", 8, 8, None, False, None, None),
        ("function", "new", 11, 14, "Engine{id}", True, "size: u32", "Self"),
        ("call", "log", 12, 12, "new", False, None, None),
        ("call", "Shelf::open", 13, 13, "new", False, None, None),
        ("function", "step", 15, 17, "Engine{id}", False, "&mut self", None),
        ("call", "self.turn", 16, 16, "step", False, None, None),
        ("function", "run{id}", 20, 22, None, True, "n: usize", "bool"),
        ("call", "Engine{id}::new", 21, 21, "run{id}", False, None, None),
    ],
    "java": [
        ("import", "java.util.List", 2, 2, None, False, None, None),
        ("import", "app.Tools.check", 3, 3, None, False, None, None),
        ("class", "Store{id}", 5, 16, None, True, None, None),
        ("function", "Store{id}", 7, 10, "Store{id}", True, "int size", None),
        ("function", "names", 11, 13, "Store{id}", True, "String prefix, int n", "List<String>"),
        ("call", "check", 12, 12, "names", False, None, None),
        ("call", "new Finder", 12, 12, "names", False, None, None),
        ("function", "init", 14, 15, "Store{id}", False, "", "void"),
        ("class", "Reader", 17, 19, None, False, None, None),
    ],
    "csharp": [
        ("import", "System.Linq", 1, 1, None, False, None, None),
        ("class", "Service{id}", 4, 12, None, True, None, None),
        ("function", "Service{id}", 6, 6, "Service{id}", True, "int n", None),
        ("call", "Setup", 6, 6, "Service{id}", False, None, None),
        ("function", "Name", 7, 10, "Service{id}", True, "int id", "string"),
        ("call", "Format", 9, 9, "Name", False, None, None),
        ("function", "Setup", 11, 11, "Service{id}", False, "int n", "void"),
        ("call", "Log.Write", 11, 11, "Setup", False, None, None),
        ("class", "IReader", 13, 13, None, False, None, None),
    ],
    "kotlin": [
        ("import", "app.store.Shelf{id}", 2, 2, None, False, None, None),
        ("import", "app.tools.*", 3, 3, None, False, None, None),
        ("class", "Item{id}", 5, 5, None, True, None, None),
        ("class", "Cart", 7, 12, None, True, None, None),
        ("function", "add", 8, 10, "Cart", True, "item: Item{id}", "Boolean"),
        ("call", "check", 9, 9, "add", False, None, None),
        ("function", "check", 11, 11, "Cart", False, "item: Item{id}", "Boolean"),
        ("call", "item.valid", 11, 11, "check", False, None, None),
        ("function", "main{id}", 14, 16, None, True, "", None),
        ("call", "println", 15, 15, "main{id}", False, None, None),
        ("call", "Cart", 15, 15, "main{id}", False, None, None),
        ("call", "Item{id}", 15, 15, "main{id}", False, None, None),
    ],
    "swift": [
        ("import", "Foundation", 1, 1, None, False, None, None),
        ("class", "Player{id}", 3, 12, None, True, None, None),
        ("function", "init", 4, 6, "Player{id}", True, "name: String", None),
        ("call", "setup", 5, 5, "init", False, None, None),
        ("function", "play", 7, 9, "Player{id}", True, "at position: Int", "Bool"),
        ("call", "engine.start", 8, 8, "play", False, None, None),
        ("function", "stop", 10, 11, "Player{id}", False, "", None),
        ("function", "launch{id}", 14, 16, None, True, "", None),
        ("call", "Player{id}", 15, 15, "launch{id}", False, None, None),
    ],
    "php": [
        ("import", "App\\Store\\Shelf{id}", 3, 3, None, False, None, None),
        ("function", "helper{id}", 5, 7, None, True, "$a, $b", None),
        ("call", "strlen", 6, 6, "helper{id}", False, None, None),
        ("class", "Cart{id}", 9, 14, None, True, None, None),
        ("function", "add", 10, 13, "Cart{id}", False, "$item", None),
        ("call", "$this->check", 11, 11, "add", False, None, None),
        ("call", "Shelf::open", 12, 12, "add", False, None, None),
    ],
    "cpp": [
        ("import", "vector", 1, 1, None, False, None, None),
        ("import", "store{id}.h", 2, 2, None, False, None, None),
        ("class", "Ring{id}", 4, 7, None, True, None, None),
        ("function", "size", 6, 6, "Ring{id}", True, "", "int"),
        ("call", "count", 6, 6, "size", False, None, None),
        ("function", "helper{id}", 9, 11, None, False, "int a", "int"),
        ("function", "push", 13, 15, "Ring{id}", True, "int x", "int"),
        ("call", "helper{id}", 14, 14, "push", False, None, None),
    ],
    "dart": [
        ("import", "package:app/store{id}.dart", 1, 1, None, False, None, None),
        ("class", "Cart{id}", 3, 7, None, True, None, None),
        ("function", "add", 4, 6, "Cart{id}", True, "int n", "int"),
        ("call", "_check", 5, 5, "add", False, None, None),
        ("function", "_check", 9, 9, None, False, "int n", "int"),
        ("function", "main{id}", 11, 13, None, True, "", "void"),
        ("call", "print", 12, 12, "main{id}", False, None, None),
        ("call", "Cart{id}", 12, 12, "main{id}", False, None, None),
    ],
    "scala": [
        ("import", "app.store.{Shelf, Box{id}}", 2, 2, None, False, None, None),
        ("class", "Reader", 4, 6, None, True, None, None),
        ("function", "read", 5, 5, "Reader", True, "n: Int", "String"),
        ("class", "Engine{id}", 8, 13, None, True, None, None),
        ("function", "read", 9, 11, "Engine{id}", True, "n: Int", "String"),
        ("call", "format", 10, 10, "read", False, None, None),
        ("function", "hidden", 12, 12, "Engine{id}", False, "x: Int", "Int"),
    ],
    "ruby": [
        ("class", "Shop", 4, 15, None, True, None, None),
        ("class", "Cart{id}", 5, 14, "Shop", False, None, None),
        ("function", "add", 6, 9, "Cart{id}", False, "item, n", None),
        ("function", "self.build", 11, 13, "Cart{id}", False, "", None),
        ("function", "helper{id}", 17, 19, None, True, "x", None),
        ("call", "check", 7, 7, "add", False, None, None),
        ("call", "@items.push", 8, 8, "add", False, None, None),
        ("call", "Shop.open", 18, 18, "helper{id}", False, None, None),
        ("import", "json", 1, 1, None, False, None, None),
        ("import", "lib/store{id}", 2, 2, None, False, None, None),
    ],
    "python": [
        ("import", "os", 1, 1, None, False, None, None),
        ("import", ".store{id}", 2, 2, None, False, None, None),
        ("function", "run{id}", 5, 7, None, True, "name, n", "str"),
        ("call", "fetch", 6, 6, "run{id}", False, None, None),
        ("call", "os.path.join", 7, 7, "run{id}", False, None, None),
        ("call", "str", 7, 7, "run{id}", False, None, None),
        ("class", "Shelf{id}", 10, 14, None, True, None, None),
        ("method", "find", 13, 14, "Shelf{id}", False, "self, key", None),
        ("call", "self.cache.get", 14, 14, "find", False, None, None),
    ],
}
