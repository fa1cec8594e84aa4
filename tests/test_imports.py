from pyspark.sql import functions as F

from loomgraph.operators import imports


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def files(spark, *paths):
    return frame(spark, [(p,) for p in paths], "path string")


def found(df):
    return {(r.raw, r.target) for r in df.collect()}


def test_aliases(spark):
    f = files(spark, "web/src/ui/a.ts", "web/lib/b/index.ts", "web/x.ts")
    rules = frame(spark, [("web/tsconfig.json", 0, "@/*", "src/*", None), ("web/tsconfig.json", 1, "lib/*", "lib/*", None), ("web/tsconfig.json", 2, "up/*", "../../*", None)], "config string, ord int, pattern string, substitute string, base_url string")
    raw = frame(spark, [("web/x.ts", r) for r in ("@/ui/a", "lib/b", "up/x", "other")], "source string, raw string")
    assert found(imports.alias_imports(raw, f, rules)) == {("@/ui/a", "web/src/ui/a.ts"), ("lib/b", "web/lib/b/index.ts")}


def test_other_languages(spark):
    two = "source string, raw string"
    ruby = frame(spark, [("a/x.rb", "./y", True), ("a/x.rb", "z", False)], two + ", relative boolean")
    assert found(imports.ruby_imports(ruby, files(spark, "a/y.rb", "lib/z.rb", "z.rb"))) == {("./y", "a/y.rb"), ("z", "lib/z.rb")}
    rules = frame(spark, [("composer.json", "App\\", "src"), ("composer.json", "App\\Sub\\", "sub"), ("composer.json", "", "any")], "config string, prefix string, folder string")
    php = frame(spark, [("i.php", "App\\Sub\\T"), ("i.php", "App\\U"), ("i.php", "V")], two)
    assert found(imports.psr4_imports(php, files(spark, "sub/T.php", "src/Sub/T.php", "src/U.php", "any/V.php"), rules)) == {("App\\Sub\\T", "sub/T.php"), ("App\\U", "src/U.php"), ("V", "any/V.php")}
    rust = frame(spark, [("src/a/b.rs", r) for r in ("crate::m::n::f", "super::c::X", "self::d", "std::x")], two)
    assert found(imports.rust_imports(rust, files(spark, "src/m/n.rs", "src/m.rs", "src/a/c/mod.rs", "src/a/b/d.rs"))) == {("crate::m::n::f", "src/m/n.rs"), ("super::c::X", "src/a/c/mod.rs"), ("self::d", "src/a/b/d.rs")}
    c = frame(spark, [("src/a.c", "b.h"), ("src/a.c", "g.h")], two)
    assert found(imports.include_imports(c, files(spark, "src/b.h", "include/b.h", "include/g.h"))) == {("b.h", "src/b.h"), ("g.h", "include/g.h")}
    swift = frame(spark, [("A/x.swift", "Core")], two)
    assert found(imports.module_imports(swift, frame(spark, [("Core", "A/x.swift"), ("Core", "C/y.swift")], "module string, path string"))) == {("Core", "C/y.swift")}
    js = frame(spark, [("m.js", "const a = require('./a'); // require('./no')\n/* require('x') */ require(`y`)")], "path string, content string")
    assert {r.raw for r in imports.required_literals(js).collect()} == {"./a"}


def test_tests_find_their_subject(spark):
    tests = files(spark, "src/__tests__/a.test.ts", "tests/test_m.py", "p/q_test.go", "src/test/java/K/ATest.java", "z.spec.js")
    known = files(spark, "src/a.ts", "src/m.py", "p/q.go", "src/main/java/K/A.java", "z.js")
    got = imports.supplied_tests(tests, known, frame(spark, [("file:z.spec.js",)], "target string"))
    assert {(r.source, r.target) for r in got.collect()} == {("file:src/a.ts", "file:src/__tests__/a.test.ts"), ("file:src/m.py", "file:tests/test_m.py"), ("file:p/q.go", "file:p/q_test.go"), ("file:src/main/java/K/A.java", "file:src/test/java/K/ATest.java")}
    nodes = frame(spark, [("file:src/a.ts", ["x"]), ("file:n", ["y"])], "id string, tags array<string>")
    assert {r.id: r.tags for r in imports.tag_tested(nodes, got).collect()} == {"file:src/a.ts": ["x", "tested"], "file:n": ["y"]}


def test_candidates_by_language(spark):
    cases = {
        "a/x.test.ts": ["a/x.ts", "a/x.tsx", "a/x.js"], "a/__tests__/x.spec.jsx": ["a/__tests__/x.jsx", "a/__tests__/x.ts", "a/x.jsx", "a/x.ts"], "tests/ui/x.test.vue": ["tests/ui/x.vue", "src/ui/x.vue", "app/ui/x.ts", "lib/ui/x.js", "ui/x.vue"],
        "p/tests/test_m.py": ["p/tests/m.py", "p/m.py"], "tests/u/m_test.py": ["tests/u/m.py", "src/u/m.py", "app/u/m.py", "lib/u/m.py", "u/m.py"], "test_m.py": ["m.py"], "g/x_test.go": ["g/x.go"],
        "src/test/java/a/FooTests.java": ["src/main/java/a/Foo.java", "src/test/java/a/Foo.java"], "m/src/test/java/FooIT.java": ["m/src/test/java/Foo.java", "m/src/main/java/Foo.java"], "src/test/kotlin/FooTest.kt": ["src/main/kotlin/Foo.kt", "src/test/kotlin/Foo.kt"],
        "m/core/src/test/scala/a/FooSuite.scala": ["m/core/src/main/scala/a/Foo.scala", "m/core/src/test/scala/a/Foo.scala"], "svc/tests/u/BarTests.cs": ["svc/tests/u/Bar.cs", "svc/Bar.cs", "svc/src/u/Bar.cs"], "My.App.Tests/u/BarTest.cs": ["My.App.Tests/u/Bar.cs", "My.App/u/Bar.cs"],
        "c/test_q.cc": ["c/q.cc"], "c/q_test.cpp": ["c/q.cpp"], "c/q.cpp": [], "a/helpers.ts": [], "k/FooSpec.kt": ["k/Foo.kt"],
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r for r in df.select("path", imports.production_candidates(F.col("path")).alias("found"), imports.is_test_path(F.col("path")).alias("test")).collect()}
    for path, want in cases.items():
        found = list(got[path].found)
        assert [x for x in found if x in want] == want and len(set(found)) == len(found), path
        assert bool(want) == got[path].test and (found == want or ".test." in path or ".spec." in path), path
