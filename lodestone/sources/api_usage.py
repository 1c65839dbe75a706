"""Uses of packages and of changed APIs in source files: one file a row, aliases resolved, comments left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = "file string, line int, col int, old_api string, matched_text string, code_snippet string"
_COMMENTS = {
    "python": re.compile(r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
}
_TAIL = r"(?:(?:\.|::|/)[A-Za-z_]\w*)"


def blank(content: str, language: str) -> str:
    """content with comments and strings as spaces, offsets unchanged."""
    pattern = _COMMENTS.get(language, _COMMENTS[""])
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


def aliases(content: str, language: str) -> dict[str, str]:
    """Local name to dotted real name, the last import of a name winning."""
    out: dict[str, str] = {}

    def bind(name: str, real: str) -> None:
        out[name] = re.sub(r"::|/", ".", real).strip(".")

    if language == "python":
        for m in re.finditer(r"^\s*from\s+([\w.]+)\s+import\s+(?:\(([^)]*)\)|([^\n#]+))", content, re.M):
            for part in re.findall(r"(\w+)(?:\s+as\s+(\w+))?", m[2] or m[3]):
                bind(part[1] or part[0], f"{m[1]}.{part[0]}")
        for m in re.finditer(r"^\s*import\s+([^\n#]+)", content, re.M):
            for real, name in re.findall(r"([\w.]+)(?:\s+as\s+(\w+))?", m[1]):
                if name:
                    bind(name, real)
    elif language in ("javascript", "typescript", "tsx"):
        for names, real in re.findall(r"import\s+([^;'\"]+?)\s+from\s+['\"]([^'\"]+)['\"]", content):
            braces = re.search(r"\{([^}]*)\}", names)
            for a, b in re.findall(r"([\w$]+)(?:\s+as\s+([\w$]+))?", braces[1] if braces else ""):
                bind(b or a, f"{real}.{a}")
            if star := re.search(r"\*\s+as\s+([\w$]+)", names):
                bind(star[1], real)
            if default := re.match(r"([\w$]+)\s*(?:,|$)", names.strip()):
                bind(default[1], real)
        for braces, name, real in re.findall(r"(?:const|let|var)\s+(?:\{([^}]*)\}|([\w$]+))\s*=\s*require\(['\"]([^'\"]+)['\"]\)", content):
            for a, b in re.findall(r"([\w$]+)(?:\s*:\s*([\w$]+))?", braces):
                bind(b or a, f"{real}.{a}")
            if name:
                bind(name, real)
    elif language == "go":
        for name, real in re.findall(r"^\s*(?:import\s+)?(?:([\w.]+)\s+)?\"([\w./\-]+)\"\s*$", content, re.M):
            bind(name or real.rpartition("/")[2], real)
    elif language == "rust":
        for tree in re.findall(r"\buse\s+([^;]+);", content):
            for name, real in rust_uses(re.sub(r"\s+", " ", tree.strip())):
                bind(name, real)
    elif language in ("java", "c_sharp", "kotlin", "scala"):
        for name, real in re.findall(r"^\s*(?:import|using)\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;?", content, re.M):
            bind(name or real.rpartition(".")[2], real)
    return out


def rust_uses(tree: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(local name, path) of a use tree with nested braces."""
    head, brace, inner = tree.partition("{")
    if brace:
        depth, part = 0, ""
        for c in inner[: inner.rfind("}")] + ",":
            if c == "," and not depth:
                if part.strip():
                    yield from rust_uses(part.strip(), prefix + head.strip())
                part = ""
            else:
                depth += (c == "{") - (c == "}")
                part += c
        return
    path, _, name = tree.partition(" as ")
    full = (prefix + path.strip()).removesuffix("::self")
    if not full.endswith("*"):
        yield name.strip() or full.rpartition("::")[2], full


def variable_types(plain: str, known: dict[str, str]) -> dict[str, str]:
    """Variable to the dotted class or factory it was made by, followed through at most three reassignments."""
    out: dict[str, str] = {}
    made = re.findall(r"\b([A-Za-z_]\w*)\s*(?::[^=\n]+)?(?::=|=(?!=))\s*(?:await\s+|new\s+)?([A-Za-z_]\w*(?:(?:\.|::)\w+)*)(\s*\()?", plain)
    for _ in range(3):
        for name, right, call in made:
            head, _, tail = right.replace("::", ".").partition(".")
            real = known.get(head) or out.get(head)
            if real and (call or not tail):
                out[name] = f"{real}.{tail}" if tail else real
    return out


def usages(content: str, language: str, roots: list[str]) -> set[str]:
    """Dotted names below the import roots that the file uses, through aliases and typed variables too."""
    names = aliases(content, language)
    plain = blank(content, language)
    mine = lambda real: any(real == r or real.startswith(f"{r}.") for r in roots)
    own = {n: r for n, r in names.items() if mine(r)}
    own |= {n: r for n, r in variable_types(plain, own | {r: r for r in roots}).items() if mine(r)}
    out = {r for n, r in names.items() if mine(r) and r not in roots}
    for head in {*own, *roots}:
        for m in re.finditer(rf"(?<![\w.$]){re.escape(head)}({_TAIL}+)", plain):
            out.add(own.get(head, head) + re.sub(r"::|/", ".", m[1]))
    return {u for u in out if u not in roots}


def matches(content: str, language: str, apis: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """(line, column, api, text) where an API is used: the longest spelling first, none overlapping another of its API."""
    names, plain = aliases(content, language), blank(content, language)
    types = variable_types(plain, names)
    for api in apis:
        dotted = re.sub(r"::|/", ".", api)
        spelled = {api, dotted, dotted.replace(".", "::"), dotted.replace(".", "/")}
        for name, real in {**types, **names}.items():
            if dotted == real or dotted.startswith(f"{real}."):
                spelled |= {name + dotted[len(real) :], (name + dotted[len(real) :]).replace(".", "::")}
        taken: list[tuple[int, int]] = []
        for form in sorted(spelled, key=lambda s: (-len(s), s)):
            for m in re.finditer(rf"(?<![\w$.]){re.escape(form)}(?![\w$])", plain):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append(m.span())
        for a, b in sorted(taken):
            yield content.count("\n", 0, a) + 1, a - (content.rfind("\n", 0, a) + 1), api, content[a:b]


def find_usages(files: DataFrame, import_roots: DataFrame) -> DataFrame:
    """package, usage: distinct API names of each package in files (path, language, content).

    import_roots: package, root; a few rows for each package, gathered as one small array.
    """
    roots = import_roots.groupBy("package").agg(F.array_sort(F.collect_set("root")).alias("roots")).agg(F.collect_list(F.struct("package", "roots")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(w["package"], u) for content, language, wanted in zip(batch["content"], batch["language"], batch["wanted"], strict=True) for w in wanted if any(r in content for r in w["roots"]) for u in usages(content, language, list(w["roots"]))}
            yield pd.DataFrame(sorted(found), columns=["package", "usage"])

    rows = files.where("content is not null and language is not null").select("content", "language").join(F.broadcast(roots), F.lit(True))
    return rows.mapInPandas(run, "package string, usage string").distinct()


def find_matches(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Places of changed APIs (old_api) in files: file, line, col, old_api, matched_text, code_snippet."""
    apis = changes.where("trim(old_api) <> ''").agg(F.array_sort(F.collect_set("old_api")).alias("apis"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, language, wanted in zip(batch["path"], batch["content"], batch["language"], batch["apis"], strict=True):
                lines = content.split("\n")
                rows += [(path, line, col, api, said, lines[line - 1].strip()) for line, col, api, said in matches(content, language, list(wanted))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MATCHES.split(", ")])

    rows = files.where("content is not null and language is not null").select("path", "content", "language").join(F.broadcast(apis), F.lit(True))
    return rows.mapInPandas(run, MATCHES)
