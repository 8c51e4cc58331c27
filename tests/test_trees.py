"""Python environments, npm packages and Go modules, with both kinds of join."""

import pytest
from pyspark.sql import functions as F

from codecat.functions import code, paths
from codecat.operators.digest import digest
from codecat.operators.gomod import go_files, go_modules, go_rejects
from codecat.operators.npm import npm_modules, npm_packages, npm_rejects, npm_roots
from codecat.operators.python_env import python_modules, python_rejects, site_packages
from codecat.schema import Scope


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- paths -----------------------------------------------------------------


def test_path_expressions(spark):
    given = ["/a/b/c.txt", "/c.txt", "/a/.b/c", "/a//c"]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    path = F.col("path")
    found = df.select(
        "path",
        paths.base(path).alias("base"),
        paths.parent(path).alias("dir"),
        paths.depth(paths.parent(path)).alias("depth"),
        paths.ancestors(paths.parent(path)).alias("above"),
    ).collect()
    assert [tuple(r) for r in found] == [
        ("/a/b/c.txt", "c.txt", "/a/b", 3, ["/", "/a", "/a/b"]),
        ("/c.txt", "c.txt", "/", 1, ["/"]),
        ("/a/.b/c", "c", "/a/.b", 3, ["/", "/a", "/a/.b"]),
        ("/a//c", "c", "/a/", 3, ["/", "/a", "/a/"]),
    ]


def test_roots(spark):
    given = ["/home/x", "/home/x/a", "/home/xy", "/home/x/.a", "/home/.h/a", "/.top/home/x/a"]
    df = spark.createDataFrame([(p,) for p in given], "path string")

    def kept(test):
        return [r["path"] for r in df.where(test).collect()]

    path = F.col("path")
    assert kept(paths.under(path, ["/home/x"])) == ["/home/x", "/home/x/a", "/home/x/.a"]
    assert kept(paths.visible_under(path, ["/home/x/"])) == ["/home/x", "/home/x/a"]
    assert kept(paths.visible_under(path, ["/"])) == ["/home/x", "/home/x/a", "/home/xy"]
    # The root's own name counts, its parents do not.
    assert kept(paths.visible_under(path, ["/home/.h"])) == []
    assert kept(paths.visible_under(path, ["/.top/home/x"])) == ["/.top/home/x/a"]


# --- python ----------------------------------------------------------------


def test_python_modules(corpus, either_join):
    site9, site10 = "/w/v/lib/python3.9/site-packages", "/w/v/lib/python3.10/site-packages"
    contents = {
        "/w/v/pyvenv.cfg": "",
        f"{site9}/pkg/__init__.py": "",
        f"{site9}/pkg/mod.py": "",
        f"{site9}/pkg/data.txt": "",
        f"{site9}/pkg/sub/lone.py": "",
        f"{site9}/single.py": "",
        f"{site9}/foo.py/__init__.py": "",
        f"{site9}/pkg/site-packages/in/__init__.py": "",
        f"{site10}/old/__init__.py": "",
        "/w/bare/pyvenv.cfg": "",
        "/w/novenv/site-packages/p/__init__.py": "",
        "/w/flat/pyvenv.cfg": "",
        "/w/flat/site-packages/__init__.py": "",
        "/w/flat/site-packages/a-b.py": "",
    }
    contents |= {f"{site9}/pkg/m{i}.py": "" for i in range(20)}
    facts = digest(corpus(contents))
    assert rows(site_packages(facts), "venv", "site_packages") == [
        ("/w/flat", "/w/flat/site-packages"),
        ("/w/v", site9),
    ]
    assert rows(python_modules(facts), "name", "path") == sorted(
        [
            ("pkg", f"{site9}/pkg/__init__.py"),
            ("pkg.mod", f"{site9}/pkg/mod.py"),
            ("foo", f"{site9}/foo.py/__init__.py"),
            ("pkg.site-packages.in", f"{site9}/pkg/site-packages/in/__init__.py"),
            ("__init__", "/w/flat/site-packages/__init__.py"),
            ("a-b", "/w/flat/site-packages/a-b.py"),
            *[(f"pkg.m{i}", f"{site9}/pkg/m{i}.py") for i in range(20)],
        ]
    )
    assert rows(python_rejects(facts), "path", "reason") == [
        ("/w/bare/pyvenv.cfg", "no site-packages")
    ]
    assert rows(python_modules(facts, Scope(homes=("/w/flat",))), "name") == [("__init__",), ("a-b",)]


def test_last_site_packages_is_by_component(corpus, either_join):
    """``a-b`` sorts before ``a/`` as a string, but after ``a`` as a component."""
    facts = digest(
        corpus(
            {
                "/v/pyvenv.cfg": "",
                "/v/a/site-packages/x.so": "",
                "/v/a-b/site-packages/x.so": "",
                "/v/a-b/site-packages/y/site-packages/x.so": "",
            }
        )
    )
    assert rows(site_packages(facts), "site_packages") == [("/v/a-b/site-packages",)]


def test_environment_inside_site_packages(corpus, either_join):
    inner = "/v/lib/site-packages/p/env"
    facts = digest(
        corpus(
            {
                "/v/pyvenv.cfg": "",
                "/v/lib/site-packages/p/__init__.py": "",
                f"{inner}/pyvenv.cfg": "",
                f"{inner}/site-packages/q/__init__.py": "",
            }
        )
    )
    assert rows(python_modules(facts), "venv", "name") == [
        ("/v", "p"),
        ("/v", "p.env.site-packages.q"),
        (inner, "q"),
    ]


# --- npm -------------------------------------------------------------------

GOOD = '{"name":"n","version":"1"}'


def test_npm_modules(corpus, either_join):
    root = "/w/app/node_modules"
    contents = {
        f"{root}/a/package.json": GOOD,
        f"{root}/a/index.js": "",
        f"{root}/a/types.d.ts": "",
        f"{root}/a/view.jsx": "",
        f"{root}/a/view.tsx": "",
        f"{root}/a/m.mjs": "",
        f"{root}/a/UPPER.JS": "",
        f"{root}/a/.h/x.js": "",
        f"{root}/a/node_modules/b/package.json": '{"name":"b","version":"2"}',
        f"{root}/a/node_modules/b/x.js": "",
        f"{root}/@s/c/package.json": '{"name":"@s/c","version":"3"}',
        f"{root}/@s/c/x.ts": "",
        f"{root}/bad/package.json": "{bad",
        f"{root}/bad/x.js": "",
        f"{root}/bad/in/package.json": GOOD,
        f"{root}/bad/in/x.js": "",
        f"{root}/none/x.js": "",
        f"{root}/.hid/package.json": GOOD,
        f"{root}/.hid/x.js": "",
        f"{root}/a-b/package.json": GOOD,
        f"{root}/a-b/x.js": "",
        "/w/.cache/node_modules/a/package.json": GOOD,
        "/w/.cache/node_modules/a/x.js": "",
        "/w/anaconda3/node_modules/a/package.json": GOOD,
        "/w/anaconda3/node_modules/a/x.js": "",
        "/w/whole/node_modules/package.json": GOOD,
        "/w/whole/node_modules/x.js": "",
        "/w/whole/node_modules/p/package.json": GOOD,
        "/w/whole/node_modules/p/x.js": "",
        "/w/src/x.js": "",
    }
    contents |= {f"{root}/a/lib/f{i}.js": "" for i in range(20)}
    files = corpus(contents)
    facts = digest(files)
    assert rows(npm_roots(files), "root") == [(root,), ("/w/whole/node_modules",)]
    assert rows(npm_packages(facts), "dir", "manifest", "name", "version") == [
        (f"{root}/@s/c", "/@s/c/package.json", "@s/c", "3"),
        (f"{root}/a", "/a/package.json", "n", "1"),
        (f"{root}/a-b", "/a-b/package.json", "n", "1"),
        ("/w/whole/node_modules", "/package.json", "n", "1"),
    ]
    listed = ["index.js", "types.d.ts", "view.jsx", "view.tsx", ".h/x.js", "node_modules/b/x.js"]
    listed += [f"lib/f{i}.js" for i in range(20)]
    assert rows(npm_modules(facts), "name", "path") == sorted(
        [(f"a/{f}", f"{root}/a/{f}") for f in listed]
        + [("@s/c/x.ts", f"{root}/@s/c/x.ts"), ("a-b/x.js", f"{root}/a-b/x.js")]
        + [(f, f"/w/whole/node_modules/{f}") for f in ("x.js", "p/x.js")]
    )
    assert rows(npm_rejects(facts), "path") == [(f"{root}/bad/package.json",)]


@pytest.mark.parametrize(
    "content, expected",
    [
        (GOOD, ("n", "1")),
        ('{"name":"n","version":"1"} and more {', ("n", "1")),
        (' \n{"name":"a","name":"b","version":""}', ("b", "")),
        ('{"name":"\\u00e9","version":"1"}', ("é", "1")),
        ('{"name":5,"version":"1"}', (None, "1")),
        ('{"name":null,"version":"1"}', (None, "1")),
        ('{"Name":"n","version":"1"}', (None, "1")),
        ('{"name":"n"}', ("n", None)),
        ('{"name":"n","version":"1"', (None, None)),
        ('{"name":"n","version":"1",}', (None, None)),
        ("{'name':'n','version':'1'}", (None, None)),
        ('{"name":"n","version":"1","x":NaN}', (None, None)),
        ('[{"name":"n","version":"1"}]', (None, None)),
        ('{"x":{"name":"in"},"version":"1"}', (None, "1")),
        ("null", (None, None)),
        ("", (None, None)),
    ],
)
def test_manifests(corpus, content, expected):
    parsed = corpus({"p": content}).select(code.parsed_manifest(F.col("content")).alias("m"))
    fields = [code.manifest_text(F.col("m"), field) for field in ("name", "version")]
    assert tuple(parsed.select(*fields).first()) == expected


# --- go --------------------------------------------------------------------


def test_go_files(corpus, either_join):
    contents = {
        "/go/m@v1/go.mod": "module example.com/m\n",
        "/go/m@v1/a.go": "",
        "/go/m@v1/a_test.go": "",
        "/go/m@v1/x_test.go.go": "",
        "/go/m@v1/.go": "",
        "/go/m@v1/README.md": "",
        "/go/m@v1/sub/go.mod": 'go 1.2\nmodule\t"example.com/sub" // note',
        "/go/m@v1/sub/b.go": "",
        "/go/m@v12/c.go": "",
        "/go/none/go.mod": " module indented\n\rmodule after-cr",
        "/go/none/d.go": "",
        "/go.mod": "module top",
    }
    contents |= {f"/go/m@v1/deep/er/f{i}.go": "" for i in range(20)}
    facts = digest(corpus(contents))
    assert rows(go_modules(facts), "mod_dir", "module") == [
        ("/", "top"),
        ("/go/m@v1", "example.com/m"),
        ("/go/m@v1/sub", "example.com/sub"),
    ]
    scoped = Scope(go_paths=("/go",))
    assert rows(go_files(facts, scoped), "name", "path") == sorted(
        [
            ("example.com/m/a.go", "/go/m@v1/a.go"),
            ("example.com/m/.go", "/go/m@v1/.go"),
            ("example.com/m/sub/b.go", "/go/m@v1/sub/b.go"),
            ("example.com/sub/b.go", "/go/m@v1/sub/b.go"),
            *[
                (f"example.com/m/deep/er/f{i}.go", f"/go/m@v1/deep/er/f{i}.go")
                for i in range(20)
            ],
        ]
    )
    # A module at the root takes the place of the first slash.
    assert ("topgo/none/d.go", "/go/none/d.go") in rows(go_files(facts), "name", "path")
    assert rows(go_rejects(facts), "path") == [("/go/none/go.mod",)]


@pytest.mark.parametrize(
    "content, expected",
    [
        ("module a/b", "a/b"),
        ("// c\nmodule a/b // d", "a/b"),
        ("module\n\n a/b", "a/b"),
        ('module ""', ""),
        ("modulea/b", None),
        ("x\rmodule a", None),
        ("x\u0085module a", None),
        ("module a\x0bb", "a\x0bb"),
    ],
)
def test_go_module_names(corpus, content, expected):
    module = code.go_module(code.declared_module(F.col("content")))
    assert corpus({"p": content}).select(module).first()[0] == expected
