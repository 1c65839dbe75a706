"""Nodes, edges and impact over a five-file project and other languages."""

import pytest

from lodestone.operators import code_graph, graph
from lodestone.sources import code_nodes
from pyspark.sql import functions as F

FILES = {
    "consts.py": "LIMIT = 3\nNAMES = ['a']\n",
    "core.py": "import json\n\ndef load(path, enc='u'):\n    return json.loads(path)\n\ndef top(path):\n    return load(path)\n\nclass Box(dict):\n    size = 1\n    def get(self, k):\n        self.last = k\n        return load(k)\n",
    "main.py": "from core import load\ndata = load('x')\nprint(data.name)\n",
    "api.py": "from core import top\n\n@route\ndef view(p):\n    r = top(p)\n    r.save()\n    return r['id']\n",
    "far.py": "from api import view\nfrom consts import LIMIT\n\ndef outer():\n    return view(LIMIT)\n\ndef lonely():\n    return 1\n",
    "bad.py": "def (:\n",
    "a.js": "export function load(x) {\n  // load(1) {\n  return x;\n}\nconst use = () => {\n  const v = load('}');\n  v.items.map();\n  v.close();\n};\n",
    "b.go": "package b\n\nfunc Fetch() int {\n\treturn 1\n}\n\nfunc Run() {\n\tr := Fetch()\n\tr.Close()\n}\n",
}


@pytest.fixture(scope="module")
def nodes(spark):
    kinds = {"py": "python", "js": "javascript", "go": "go"}
    files = spark.createDataFrame([(p, kinds[p.rpartition(".")[2]], c) for p, c in FILES.items()], "path string, language string, content string")
    return code_nodes.nodes(files).cache()


@pytest.fixture(scope="module")
def edges(nodes):
    return code_graph.call_edges(nodes).cache()


def test_nodes(nodes):
    rows = {r["id"]: r for r in nodes.collect()}
    assert {i for i in rows if i.startswith("core")} == {"core.py::load", "core.py::top", "core.py::Box", "core.py::Box.get", "core.py::module_level::1-1"}
    assert rows["api.py::view"]["start_line"] == 3 and not any(i.startswith("bad") for i in rows)
    assert {tuple(u) for u in rows["api.py::view"]["usage"]} == {("top", ".save()"), ("top", "['id']")}
    assert "Box.last" in rows["core.py::Box.get"]["defines"] and "LIMIT" in rows["far.py::outer"]["references"]
    assert rows["a.js::load"]["end_line"] == 4 and ("load", ".close()") in {tuple(u) for u in rows["a.js::use"]["usage"]}
    assert ("Fetch", ".Close()") in {tuple(u) for u in rows["b.go::Run"]["usage"]}


def test_facts():
    import ast

    def facts(code, owner=None):
        return code_nodes.Facts(ast.parse(code).body, owner)

    f = facts("r = open_it(a[0]).next()\nr.close(x=pkg.mod.go())\nr.part.size\ns = r\ns['k']\nfetch().rows[1:]")
    assert set(f.calls) == {"open_it", "open_it.next", "r.close", "pkg.mod.go", "fetch"}
    assert f.usage == {("open_it", ".next()"), ("open_it", ".close()"), ("open_it", ".part"), ("open_it", ".size"), ("open_it", "['k']"), ("fetch", ".rows"), ("fetch", "[:]")}
    assert {"go", "pkg.mod", "next", "a", "open_it.close"} <= f.references and "x" not in f.references
    f = facts("box = lib.Box()\nself.size = box.width\nself.run()\nfor i, j in f(): pass\nwith lib.lock() as k:\n    k.go()\ndef inner():\n    hidden()", "Shape")
    assert {"box", "Shape.size", "i", "j", "k", "inner", "Shape.inner"} == set(f.defines)
    assert {"Box.width", "Shape.run", "Shape.size", "self.run"} <= f.references and "hidden" not in f.calls
    assert f.usage == {("lib.Box", ".width"), ("lib.lock", ".go()")}
    f = facts("import a.b as c, d.e\nfrom m.n import o as p")
    assert f.references == {"a.b", "c", "d.e", "d", "m.n", "o", "p", "m.n.o"}


def test_lexical_definitions():
    def found(language, code):
        return {(r["name"], r["context_type"]) for r in code_nodes.lexical_nodes("f", code, language) if r["name"]}

    assert found("rust", "pub(crate) async fn go(x: u8) {\n}\npub struct Point {\n}\n") == {("go", "function"), ("Point", "class")}
    assert found("java", "public class A {\n  public static List<String> names(int x) throws E {\n    if (x > 1) {\n    }\n  }\n}\n") == {("A", "class"), ("names", "function")}
    assert found("go", "func (s *Server) Serve(a int) error {\n}\ntype Box struct {\n}\n") == {("Serve", "function"), ("Box", "class")}
    assert found("typescript", "export default async function* f(x) {\n}\nexport const g = async (a: number): Promise<void> => {\n};\n") == {("f", "function"), ("g", "function")}
    assert found("cpp", "static int add(int a, int b) {\n}\nvoid Box::put(int x) const {\n}\n") == {("add", "function"), ("put", "function")}


def test_edges(edges, nodes):
    found = {(r["source"], r["target"]) for r in edges.collect()}
    want = {("core.py::top", "core.py::load"), ("core.py::Box.get", "core.py::load"), ("api.py::view", "core.py::top"), ("far.py::outer", "api.py::view"), ("a.js::use", "a.js::load"), ("b.go::Run", "b.go::Fetch")}
    assert want <= found
    assert ("main.py::module_level::1-3", "a.js::load") in found  # of two definitions elsewhere, the smaller id
    assert code_graph.graph_stats(nodes, edges).first()["files"] == 7


def test_impact(spark, nodes, edges):
    change = lambda *rows: spark.createDataFrame(rows, "file string, line int")
    hit = {r["node"]: r for r in code_graph.impact(nodes, edges, change(("core.py", 7))).collect()}
    assert set(hit) == {"api.py::view", "far.py::outer", "api.py::module_level::1-1"}
    assert (hit["api.py::view"]["depth"], hit["api.py::view"]["impact_reason"]) == (1, graph.USES_VALUE)
    assert hit["api.py::view"]["affected_attributes"] == [".save()", "['id']"] and hit["far.py::outer"]["depth"] == 2
    near = {r["node"] for r in code_graph.impact(nodes, edges, change(("core.py", 7)), max_depth=1).collect()}
    assert "far.py::outer" not in near and "api.py::view" in near
    assert code_graph.impact(nodes, edges, change(("far.py", 8))).count() == 0
    assert {r["node"] for r in code_graph.impact(nodes, edges, change(("consts.py", 1))).collect()} >= {"far.py::outer"}


def test_stale_files(spark):
    files = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "path string, mtime double")
    cached = spark.createDataFrame([("a", 1.0, 4), ("b", 1.5, 4), ("c", 3.0, 3)], "path string, mtime double, cache_version int")
    assert {r["path"] for r in code_graph.stale_files(files, cached, 4).collect()} == {"b", "c"}


def test_references_do_not_meet_all_definitions(spark):
    # 3000 calls of one name that 3000 nodes define: nine million pairs, were each to meet each.
    n = 3000
    nodes = spark.range(n).selectExpr("concat('n', lpad(id, 5, '0')) as id", "concat('f', id % 7) as file", "cast(null as string) as parent", "'go' as name", "cast(array() as array<string>) as defines", "array('go') as calls")
    edges = code_graph.call_edges(nodes)
    assert {(r["source"], r["target"]) for r in edges.collect()} == {(f"n{i:05}", f"n{i % 7:05}") for i in range(n)}
    assert joined_rows(edges) <= 4 * n


def test_references_never_resolve_to_themselves(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "y", 4)]
    part = spark.createDataFrame(rows, "sym string, file string, target long")
    refs = part.select("sym", "file", F.col("target").alias("me"))
    found = graph.resolve_references(refs, part, "sym", ["me"], "file", "target", own="me")
    assert {tuple(r) for r in found.collect()} == {(1, 2), (2, 1), (3, 1)}


def joined_rows(df):
    """The most rows that a join of the plan has put out; df has been collected."""
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)
