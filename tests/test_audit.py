"""Manifests, lockfiles and the audit on a small tree."""

import json

import pytest

from lodestone.functions import text as tx
from lodestone.functions import versions as vs
from lodestone.operators import audit
from lodestone.sources import lockfiles, manifests, tree
from pyspark.sql import functions as F

FILES = {
    "requirements.txt": "Flask==2.0.1  # web\n-r other.txt\n\nrequests\nnumpy>=1.0,<2\nuvicorn[standard]==0.3\ndjango==4.*\n",
    "app/pyproject.toml": '[project]\ndependencies = ["click~=8.1", "rich"]\n[tool.poetry.dependencies]\npython = "^3.11"\nhttpx = "^0.27"\nattrs = {version = "~23.1", extras = ["x"]}\n',
    "web/package.json": '{"dependencies": {"react": "^18.2.0"}, "devDependencies": {"vite": "5.0.0"}}',
    "svc/go.mod": "module example.com/me\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/net v0.9.0 // indirect\n)\nrequire gopkg.in/yaml.v3 v3.0.1\nrequire plain v1.0.0\n",
    "core/Cargo.toml": '[dependencies]\nserde = "1.0"\ntokio = {version = "1.2", features = []}\nlocal = {path = "x"}\n[dev-dependencies]\nrand = "0.8"\n',
    "jv/pom.xml": '<project xmlns="urn:m"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId></dependency></dependencies></project>',
    "bad/package.json": "{nope",
    ".hidden/package.json": '{"dependencies": {"ghost": "1"}}',
    "target/Cargo.toml": '[dependencies]\nghost = "1"\n',
    "pkg/__init__.py": "",
    "Pipfile.lock": json.dumps({"default": {"Requests": {"version": "==2.31.0"}, "rich": {}}, "develop": {"rich": {"version": "==1"}}}),
    "poetry.lock": '[[package]]\nname = "rich"\nversion = "13.7.0"\n[[package]]\nname = "rich"\nversion = "9"\n',
    "package-lock.json": json.dumps({"packages": {"": {"version": "0"}, "node_modules/left": {"version": "1.1.0"}, "node_modules/a/node_modules/b": {"version": "9"}}, "dependencies": {"old": {"version": "0.1.0"}}}),
    "yarn.lock": '# yarn\n"@scope/x@^1.0.0", "@scope/x@~1.0":\n  version "1.0.4"\n\nleft@^1:\n  version "3.0.0"\n',
    "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.200"\n',
    "go.sum": "github.com/A/b v1.2.3 h1:abc=\ngithub.com/A/b v1.2.3/go.mod h1:def=\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "blob.py").write_bytes(b"a\0b")
    return tree.read_tree(spark, str(root)).cache()


def test_tree(files):
    paths = {r["path"] for r in files.collect()}
    assert paths == {p for p in FILES if not p.startswith((".hidden", "target"))}
    top = [(r["name"], r["is_folder"]) for r in tree.folders(files).where("parent = ''").collect()]
    assert top[0] == ("app", True) and ("pkg", True) in top and top[-1] == ("yarn.lock", False)


def test_manifests(files):
    found = {(r["file_path"], r["name"]): (r["ecosystem"], r["version"], r["pinned"]) for r in manifests.packages(files).collect()}
    assert found == {
        ("requirements.txt", "Flask"): ("pip", "2.0.1", True),
        ("requirements.txt", "requests"): ("pip", "unknown", False),
        ("requirements.txt", "numpy"): ("pip", "1.0", True),
        ("requirements.txt", "uvicorn"): ("pip", "unknown", False),
        ("requirements.txt", "django"): ("pip", "4.", True),
        ("svc/go.mod", "plain"): ("go", "v1.0.0", True),
        ("app/pyproject.toml", "click"): ("pip", "8.1", True),
        ("app/pyproject.toml", "rich"): ("pip", "unknown", False),
        ("app/pyproject.toml", "httpx"): ("pip", "0.27", True),
        ("app/pyproject.toml", "attrs"): ("pip", "23.1", True),
        ("web/package.json", "react"): ("npm", "^18.2.0", True),
        ("web/package.json", "vite"): ("npm", "5.0.0", True),
        ("svc/go.mod", "github.com/a/b"): ("go", "v1.2.3", True),
        ("svc/go.mod", "golang.org/x/net"): ("go", "v0.9.0", True),
        ("svc/go.mod", "gopkg.in/yaml.v3"): ("go", "v3.0.1", True),
        ("core/Cargo.toml", "serde"): ("cargo", "1.0", True),
        ("core/Cargo.toml", "tokio"): ("cargo", "1.2", True),
        ("core/Cargo.toml", "local"): ("cargo", "unknown", False),
        ("jv/pom.xml", "g:a"): ("maven", "${v}", True),
    }


def test_lockfiles(files):
    found = {r["name_lower"]: r["version"] for r in lockfiles.locked_versions(lockfiles.lock_entries(files)).collect()}
    assert found == {"requests": "2.31.0", "rich": "13.7.0", "left": "1.1.0", "a/b": "9", "old": "0.1.0", "@scope/x": "1.0.4", "serde": "1.0.200", "github.com/a/b": "v1.2.3", "b": "v1.2.3"}


def test_report_and_health(spark, files):
    packages = audit.resolve(manifests.packages(files), lockfiles.locked_versions(lockfiles.lock_entries(files)))
    advisories = spark.createDataFrame([("pip", "Flask", "2.0.1", [("C-1", "bad")]), ("pip", "Flask", "2.0.1", [("C-2", "worse")])], "ecosystem string, name string, version string, cves array<struct<id:string,summary:string>>")
    registry = spark.createDataFrame(
        [("npm", "react", 0, "19.0.0", False), ("npm", "react", 1, "18.3.0", True), ("npm", "react", 2, "20.0.0", False), ("cargo", "serde", 0, "1.0.1", False), ("cargo", "serde", 1, "1.0.5", False), ("pip", "requests", 0, "2.31.9", True), ("pip", "click", 0, "9.0", True), ("npm", "vite", 0, "4.0.0", True)],
        "system string, name string, ord int, version string, is_default boolean",
    )
    reported = audit.report(packages, advisories, audit.latest_versions(registry))
    rows = {r["name"]: r for r in reported.collect()}
    grades = {n: r["severity"] for n, r in rows.items()}
    assert grades["Flask"] == "CRITICAL" and len(rows["Flask"]["cves"]) == 2
    assert (grades["react"], grades["serde"], grades["requests"], grades["click"], grades["vite"], grades["uvicorn"], grades["numpy"]) == ("MEDIUM", "LOW", "LOW", "HIGH", "OK", "UNPINNED", "OK")
    assert rows["requests"]["resolved_from"] == "lockfile" and rows["uvicorn"]["resolved_from"] == "none"
    score = audit.health(reported).first()
    n = len(rows)
    ok = n - 7 + 1  # all others: vite among the seven is OK too; the unpinned are counted below
    unpinned = sum(g == "UNPINNED" for g in grades.values())
    ok = sum(g == "OK" for g in grades.values())
    assert (score["total_packages"], score["critical"], score["high"], score["medium"], score["low"], score["unpinned"], score["ok"]) == (n, 1, 1, 1, 2, unpinned, ok)
    assert score["health_score"] == (ok * 100 + 2 * 75 + 50 + 25 + unpinned * 25) // n
    assert audit.health(reported.limit(0)).first()["health_score"] == 100


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("version", "low", "high", "want"),
    [("2.1", "2.0.0", "3.0.0", True), ("2.0", "2.0.0", "3.0.0", False), ("2.0.0", "2.5.0", "3.0.0", True), ("3.0.1", "2.0.0", "3.0.0", False), ("", "1.0", "2.0", False), ("9", "", "2.0", True), ("1.5", "2.0", "1.0", True)],
)
def test_version_window(spark, version, low, high, want):
    assert one(spark, vs.version_in_window(F.lit(version), F.lit(low), F.lit(high))) is want


def test_version_functions(spark):
    assert one(spark, vs.clean_version(F.lit("^~>= v1.2.3,<2"))) == "1.2.3"
    assert one(spark, vs.severity_parts(F.lit("^v1.2-rc3"))) == [1, 2, 0] and one(spark, vs.severity_parts(F.lit("none"))) == [0, 0, 0]
    assert one(spark, vs.version_tuple(F.lit("v1.2.3.4.5"))) == [1, 2, 3, 4]
    assert one(spark, vs.versions_in_text(F.lit("from 1.2 to v10.0.3, not 1.2.3.4.5x or 7"))) == ["1.2", "10.0.3", "1.2.3.4"]
    assert one(spark, vs.candidate_versions(F.lit("1.2.0"), F.lit("1.4.1"))) == ["1.2.0", "1.4.1", "1.0.0", "1.3.0", "1.4.0"]
    assert one(spark, vs.candidate_versions(F.lit("1.2.0"), F.lit("3.0.0"))) == ["1.2.0", "3.0.0", "1.0.0", "2.0.0", "1.3.0", "1.4.0", "1.5.0", "1.6.0"]
    assert one(spark, vs.repin(F.lit('Flask==2.0.1\nflask-x = "2.0.1"'), F.lit("flask"), F.lit("2.0.1"), F.lit("3.0.0"))) == 'Flask==3.0.0\nflask-x = "3.0.0"'


def test_text_functions(spark):
    assert one(spark, tx.slug(F.lit("pkg.HTTPClient.getItem"))) == "get_item" and one(spark, tx.slug(F.lit("a.!!"))) == "api"
    assert one(spark, tx.api_name(F.lit("std::io/Read()"))) == "std.io.read"
    assert [one(spark, tx.token_stem(F.lit(w))) for w in ("running", "used", "classes", "items", "ring")] == ["runn", "used", "class", "item", "ring"]
    assert one(spark, tx.html_text(F.lit("<p>a<br>b</p><script>x</script><div>c  d</div>"))) == "a\nb\nc d"
    assert one(spark, tx.repo_url(F.lit("git+ssh://git@github.com/a/b.git"))) == "https://github.com/a/b"
    assert one(spark, tx.repo_url(F.lit("https://github.com/sponsors/x"))) == "" and one(spark, tx.repo_url(F.lit("https://gitlab.com/a/b"))) == "https://gitlab.com/a/b"
    assert one(spark, tx.document_kind(F.lit("pypi"), F.lit("Migration"), F.lit(""))) == "registry"
    assert one(spark, tx.document_kind(F.lit("x"), F.lit("Migration guide"), F.lit(""))) == "migration_guide"
    assert one(spark, tx.evidence_text(F.lit("Use :py:func:`A.b`  `now`"))) == "use a.b now"
    assert one(spark, tree.under_root(F.lit("/a/b"), F.lit("../b/./c.py"))) == "c.py" and one(spark, tree.under_root(F.lit("/a/b"), F.lit("../x"))) is None


def test_pages_to_text(spark):
    import html

    pages = {
        "<h1>A &amp; B</h1><ul><li>one<li>two</ul>": "A & B\none two", "x&amp;lt;y": "x&lt;y", "<SCRIPT>a='</p>'</SCRIPT>b<br/>c<BR >d": "b\nc\nd", "&#x41;&#66;&#128;&#0;&#xD800;&#1114112;": "AB\u20ac\ufffd\ufffd\ufffd",
        "&copy 2 &eacute;&NotEqualTilde; &nosuch; & x": "\xa9 2 \xe9\u2242\u0338 &nosuch; & x", "a < b and c > d": "a d", "5 < 6": "5 < 6", "<p>\n\n \t<b>t</b>\xa0</p>": "t", "<a title='&lt;p'>z</a>": "z", "": "", "&#128512;": "\U0001f600",
    }
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "i int, html string").select("i", tx.html_text(F.col("html")).alias("t"))
    found = {r["i"]: r["t"] for r in rows.collect()}
    assert {p: found[i] for i, p in enumerate(pages)} == pages and found[len(pages)] is None
    names = [f"&{n}" for n in html.entities.html5 if n.endswith(";")]
    decoded = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.character_reference(F.col("n")).alias("t")).collect()
    assert all(r["t"] == html.unescape(r["n"]) for r in decoded)
