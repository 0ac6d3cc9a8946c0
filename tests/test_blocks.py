"""Blocks of hand-written files in each language, as a syntax tree would have them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillet.operators import blocks, chunk
from quillet.operators.boundaries import language

FILES = {
    "a.js": """// function no() {
import x from "y";
export class A extends B {
  #p = "} {";
  static async run(a, b = `t ${ {k: `${1}}`} } {`) {
    if (a) { return /[}{/]/.test(b); }
    for (let i = 0; i < 3; i++) { go(i); }
  }
  get size() { return 1; }
}
function f(a,
           b) {
  const g = (x) => {
    return x;
  };
  /* } */
}
""",
    "b.ts": """export interface Shape {
  area(): number;
}
export default abstract class C<T> {
  constructor(private x: T) {
  }
  async get<K>(k: K): Promise<T> {
    return list.map(async (v): Promise<T> => {
      return v;
    });
  }
}
""",
    "c.go": """package main

type S struct {
	x int
}

func (s *S) Get(k string) (int, error) {
	r := `} raw {`
	c := '{'
	go func() {
		work()
	}()
	return 1, nil
}

func Map[T any](xs []T,
	f func(T) T) []T {
	return xs
}
""",
    "d.rs": """use std::fmt;
pub struct Unit;
pub(crate) struct P<'a> {
    x: &'a str,
}
impl<'a> fmt::Display for P<'a> {
    pub async unsafe fn fmt(&self, c: char) -> bool {
        let s = r#"} " {"#;
        /* outer /* inner } */ { */
        match c { '{' => true, '\\'' => false, _ => { false } }
    }
}
""",
    "e.java": """package p;
@Deprecated(since = "1")
public final class A<T extends B> implements C {
    private static final String S = "{";
    public A(int x) throws E {
        this.x = x;
    }
    @Override
    public <R> Map<String, R[]> get(List<R> in, char c) throws E, F {
        Runnable r = () -> { run(); };
        new Thread(new Runnable() {
            public void run() { }
        });
        if (c == '}') { return null; } else { throw new E(); }
    }
}
""",
    "f.rb": """# def no
module M
  class A < B
    class << self
      def make(x) = new(x)
    end
    def run(a)
      return 1 if a
      x = if a
        2
      end
      list.each do |y|
        while y do
          y = "end"
        end
      end
      y.class
    end
  end
end
""",
    "g.c": """#define BEGIN { \\
  {
struct S { int x; };
static int *
add(const struct S *s, int (*f)(int))
{
  char c = '}';
  while (f(1)) { c++; }
  return 0;
}
enum E { A, B };
""",
    "h.cpp": """namespace n {
class A : public B {
  int get() const noexcept { return 1; }
};
template <typename T>
A::A(int x) : B(x), y(x) {
  auto s = R"x(} {)x";
}
}
""",
    "i.cs": """namespace N {
  [Attr("x")]
  public sealed class A : B {
    string s = @"a ""{"" \\";
    int F(int x) { return x; }
  }
}
""",
    "j.php": """<?php
final class A extends B {
  public function get($x) {
    return <<<TXT
    } {
    TXT;
  }
}
function top() { # }
  return '}';
}
""",
    "k.kt": '''data class P(val x: Int) {
    override fun get(k: Int): String {
        return """} {"""
    }
    inline fun <T> each(f: (T) -> Unit) = f
}
''',
    "l.swift": """public struct S {
  static func make(_ x: Int) -> S {
    return S()
  }
}
extension S {
}
""",
    "m.scala": """object O {
  case class P(x: Int) {
    def get(k: Int): Int = {
      k match { case 1 => 2 }
    }
  }
}
""",
    "n.py": '''"""def no(): class"""
import x

@dec
class A(B):
    """doc

def still doc
    """
    x = {
"k": 1,
    }

    async def f(
        self,
    ) -> int:
        # comment
        if x:
            def g(): return "#"
        return g

    def h(self):
        """only
        a doc"""

y = 1
''',
}
WANT = {
    "a.js": [("class_declaration", 3, 7, 10), ("method_definition", 5, 2, 8), ("method_definition", 9, 2, 9), ("function_declaration", 11, 0, 17), ("arrow_function", 13, 12, 15)],
    "b.ts": [("interface_declaration", 1, 7, 3), ("class_declaration", 4, 15, 12), ("method_definition", 5, 2, 6), ("method_definition", 7, 2, 11), ("arrow_function", 8, 20, 10)],
    "c.go": [("method_declaration", 7, 0, 14), ("function_declaration", 16, 0, 19)],
    "d.rs": [("struct_item", 2, 0, 2), ("struct_item", 3, 0, 5), ("impl_item", 6, 0, 12), ("function_item", 7, 4, 11)],
    "e.java": [("class_declaration", 2, 0, 16), ("constructor_declaration", 5, 4, 7), ("method_declaration", 8, 4, 15), ("method_declaration", 12, 12, 12)],
    "f.rb": [("module", 2, 0, 20), ("class", 3, 2, 19), ("method", 7, 4, 18)],
    "g.c": [("function_definition", 4, 0, 10)],
    "h.cpp": [("function_definition", 3, 2, 3), ("function_definition", 6, 0, 8)],
    "i.cs": [("class_declaration", 2, 2, 6)],
    "j.php": [("class_declaration", 2, 0, 8), ("function_definition", 9, 0, 11)],
    "k.kt": [("class_declaration", 1, 0, 6), ("function_declaration", 2, 4, 4)],
    "l.swift": [("class_declaration", 1, 0, 5), ("function_declaration", 2, 2, 4), ("class_declaration", 6, 0, 7)],
    "m.scala": [("class_definition", 2, 2, 6), ("function_definition", 3, 4, 5)],
    "n.py": [("class_definition", 5, 0, 24), ("function_definition", 14, 4, 20), ("function_definition", 19, 12, 19), ("function_definition", 22, 4, 24)],
}


def table(spark, texts):
    return spark.createDataFrame([(1, p, t.splitlines(), True) for p, t in texts.items()], "review_id long, path string, lines array<string>, is_readable boolean").repartition(3)


@pytest.fixture(scope="module")
def nodes(spark):
    got = {}
    for r in blocks.BlockSyntax().nodes(table(spark, FILES)).collect():
        got.setdefault(r.path, []).append(r)
    return got


@pytest.mark.parametrize("path", sorted(FILES))
def test_nodes_of_a_file(nodes, path):
    rows = [r for r in nodes[path] if r.node_id]
    assert sorted((r.start_line, r.start_col, r.end_line, r.node_type) for r in rows) == sorted((a, c, b, k) for k, a, c, b in WANT[path])
    lines = FILES[path].splitlines()
    for r in rows:
        assert lines[r.end_line - 1][r.end_col - 1] in "};d" or path == "n.py"
    assert [r.parent_id for r in nodes[path] if not r.node_id] == [None]


def test_every_language_is_there(nodes):
    assert set(blocks.OPAQUE) == {"javascript", "typescript", "tsx", "go", "rust", "java", "ruby", "c", "cpp", "c_sharp", "php", "kotlin", "swift", "scala", "python"}


def test_parents(nodes):
    of = {(r.start_line, r.node_type): r for r in nodes["a.js"]}
    assert of[5, "method_definition"].parent_id == of[9, "method_definition"].parent_id == of[3, "class_declaration"].node_id
    assert of[13, "arrow_function"].parent_id == of[11, "function_declaration"].node_id and of[3, "class_declaration"].parent_id == 0
    of = {(r.start_line, r.node_type): r for r in nodes["n.py"]}
    assert of[19, "function_definition"].parent_id == of[14, "function_definition"].node_id
    assert of[22, "function_definition"].parent_id == of[5, "class_definition"].node_id


def test_masks_keep_places(spark):
    rows = table(spark, FILES).select("path", F.array_join("lines", "\n").alias("t")).withColumn("m", blocks.masked(F.col("t"), language(F.col("path")))).collect()
    for r in rows:
        assert len(r.m) == len(r.t) and [len(x) for x in r.m.split("\n")] == [len(x) for x in r.t.split("\n")], r.path
        assert all(a == b or a in " \x01\x02" for a, b in zip(r.m, r.t, strict=True))


def test_broken_files(spark):
    """A missing brace, one too many, strings and comments that end nowhere, an empty file, prose."""
    broken = {
        "a.js": "function a() {\n  x();\n}\nfunction b() {\n  if (y) {\n}\nfunction c() {\n}\n",
        "b.go": "}\n}\nfunc F() {\n}\n",
        "c.java": 'class A {\n  void f() {\n    s("{);\n  }\n}\n',
        "d.rs": "fn a() {\n}\n/* never { ends\nfn b() {\n}\n",
        "e.ts": "",
        "f.c": "so much prose, (with signs) and 'quotes that \"mix; " * 2000 + "{",
        "g.py": "def f(:\n    x = (\n  y\nclass A:\n    pass\n",
        "h.js": "x = `never ${ends\n" * 50,
    }
    got = {}
    for r in blocks.BlockSyntax().nodes(table(spark, broken)).collect():
        got.setdefault(r.path, []).append((r.node_type, r.start_line, r.end_line))
    assert all("program" in [k for k, _, _ in v] for v in got.values()) and set(got) == set(broken)
    assert ("function_declaration", 1, 3) in got["a.js"] and ("function_declaration", 4, 8) in got["a.js"]
    assert ("function_declaration", 3, 4) in got["b.go"]
    assert ("class_declaration", 1, 5) in got["c.java"] and ("method_declaration", 2, 4) in got["c.java"]
    assert ("function_item", 1, 2) in got["d.rs"] and len(got["d.rs"]) == 2


def test_chunks_by_blocks(spark):
    changed = spark.createDataFrame([(1, 1, "c.go", 13), (1, 2, "e.java", 6), (1, 3, "a.js", 2), (1, 4, "f.rb", 8)], "review_id long, file_seq long, path string, line_no long")
    got = {(r.path, r.start_line, r.end_line) for r in chunk.chunk_changes(changed, table(spark, FILES), blocks.BlockSyntax()).collect()}
    assert got == {("c.go", 7, 14), ("e.java", 5, 7), ("a.js", 1, 12), ("f.rb", 7, 18)}


def test_an_oversized_class_is_split_at_its_methods(spark):
    text = "class A {\n" + "".join(f"  m{i}() {{\n    x({i});\n  }}\n" for i in range(40)) + "}\n"
    changed = spark.createDataFrame([(1, 1, "a.js", n) for n in (1, 3, 60)], "review_id long, file_seq long, path string, line_no long")
    got = {(r.start_line, r.end_line) for r in chunk.chunk_changes(changed, table(spark, {"a.js": text}), blocks.BlockSyntax(), 50).collect()}
    assert got == {(2, 4), (59, 61)}
