"""Parsers from file rows to metadata rows, and the registry that chooses one by suffix.

All parsers run in one pass: a file's row goes to a Python worker once, by Arrow batch, to the parser of its suffix, and comes
back with all its columns and the parsed ones. Syntax trees and brace counting are beyond expressions; what expressions can
say (tokens, estimates, signatures, complexity of plain patterns) is in functions.text.
"""

from __future__ import annotations

import ast
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import text as tx
from lodestone.schema import CLASS, FUNCTION, STRINGS, D, I, S, row

_FOUND = row(
    parser=S, module_path=S, imports=STRINGS, exports=STRINGS, functions=T.ArrayType(FUNCTION), classes=T.ArrayType(CLASS), complexity=D,
    internal_dependencies=STRINGS, external_dependencies=STRINGS, features=T.MapType(S, S), parse_error=S,
)
PARSED = T.StructType([T.StructField("path", S), *_FOUND.fields])
#: Rows of a file's structure: kind (import, function, async_function, class, decorator, global, variable, type, export), name, line.
STRUCTURE = row(path=S, kind=S, name=S, line=I, type=S)

Found = dict[str, object]


class Parser(ABC):
    """Finds what a text of one language holds. ``parse`` and ``structures`` are the same over rows (path, text, ..)."""

    name = ""
    language = ""
    extensions: tuple[str, ...] = ()

    @abstractmethod
    def find(self, text: str) -> Found:
        """Any of PARSED's fields; those that are left out are empty."""

    def outline(self, text: str) -> list[tuple]:
        """(kind, name, line, type) of a text's parts."""
        return []

    def tokenize(self, text: Column) -> Column:
        return tx.language_tokens(text, self.language)

    def parse(self, files: DataFrame) -> DataFrame:
        return _parse(files, lambda path: self)

    def structures(self, files: DataFrame) -> DataFrame:
        return _structures(files, lambda path: self)


def _safe(parser: Parser, text: str | None) -> Found:
    """What the parser finds; an error of its own is the row's, so that no file stops the others."""
    try:
        return {"parser": parser.name, **parser.find(text or "")}
    except Exception as e:  # noqa: BLE001 - a parser may be anyone's
        return {"parser": parser.name, "complexity": 0.0, "parse_error": f"{type(e).__name__}: {e}"}


def _parse(files: DataFrame, chosen: Callable[[str], Parser]) -> DataFrame:
    keep = [c for c in files.columns if c not in _FOUND.names]
    given = files.select(*keep)
    path, text = keep.index("path"), keep.index("text")
    fields = to_arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_safe(chosen(p or ""), t) for p, t in zip(batch.column(path).to_pylist(), batch.column(text).to_pylist(), strict=True)]
            cols = []
            for f in fields:
                empty = [] if pa.types.is_list(f.type) or pa.types.is_map(f.type) else None
                cols.append(pa.array([x.get(f.name, empty) for x in found], f.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*keep, *_FOUND.names])

    return given.mapInArrow(run, T.StructType([*given.schema.fields, *_FOUND.fields]))


def _structures(files: DataFrame, chosen: Callable[[str], Parser]) -> DataFrame:
    schema = to_arrow_schema(STRUCTURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(p, *x) for x in chosen(p or "").outline(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "text").mapInArrow(run, STRUCTURE)


_BRANCH = (ast.If, ast.While, ast.For, ast.ExceptHandler)
_COMP = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def complexity(tree: ast.AST, comprehensions: bool) -> int:
    n = 1
    for node in ast.walk(tree):
        if isinstance(node, _BRANCH) or (comprehensions and isinstance(node, _COMP)):
            n += 1
        elif isinstance(node, ast.BoolOp):
            n += len(node.values) - 1
    return n


def _dotted(node: ast.AST) -> str:
    """A decorator's name, without the arguments of its call."""
    return _dotted(node.func) if isinstance(node, ast.Call) else ast.unparse(node)


def _function(node) -> dict:
    return {
        "name": node.name, "args": [a.arg for a in node.args.args], "decorators": [_dotted(d) for d in node.decorator_list],
        "docstring": ast.get_docstring(node), "is_async": isinstance(node, ast.AsyncFunctionDef),
        "is_generator": any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node)), "line_number": node.lineno,
        "complexity": complexity(node, False), "return_type": ast.unparse(node.returns) if node.returns else None,
        "is_exported": not node.name.startswith("_"), "flags": [],
    }


def _class(node: ast.ClassDef) -> dict:
    methods = [x for x in node.body if isinstance(x, _DEF)]
    typed = [x for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
    return {
        "name": node.name, "type": "class", "bases": [ast.unparse(b) for b in node.bases], "implements": [],
        "decorators": [_dotted(d) for d in node.decorator_list], "docstring": ast.get_docstring(node),
        "methods": [{"name": m.name, "is_async": isinstance(m, ast.AsyncFunctionDef), "is_property": any(_dotted(d) == "property" for d in m.decorator_list)} for m in methods],
        "attributes": [{"name": x.target.id, "type": ast.unparse(x.annotation)} for x in typed], "line_number": node.lineno,
        "is_exported": not node.name.startswith("_"), "flags": [],
    }


_FALLBACK_IMPORT = re.compile(r"^\s*(?:from\s+(\S+)\s+)?import\s+(.+)$", re.M)
_FALLBACK_DEF = re.compile(r"^(async\s+)?def\s+(\w+)\s*\([^)]*\):", re.M)
_FALLBACK_CLASS = re.compile(r"^class\s+(\w+)(?:\s*\([^)]*\))?:", re.M)
_WORDS = re.compile(r"\b(?:" + "|".join(tx.KEYWORDS) + r")\b", re.I)
_LOGIC = re.compile(r"\b(?:and|or|&&|\|\|)\b")


def basic_complexity(text: str) -> float:
    return float(1 + len(_WORDS.findall(text)) + len(_LOGIC.findall(text)))


class PythonParser(Parser):
    """The module's syntax tree; a file that doesn't parse is read by patterns, with the error beside it."""

    name, language, extensions = "python", "python", (".py", ".pyi", ".pyx")

    def find(self, text: str) -> Found:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return {**self._by_patterns(text), "parse_error": f"{type(e).__name__}: {e}"}
        imports, inside, outside = [], [], []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for name in (a.name for a in node.names):
                    imports.append(name)
                    (inside if "." not in name else outside).append(name)
            elif isinstance(node, ast.ImportFrom) and node.module:
                imports.append(node.module)
                (inside if node.level else outside).append(node.module)
        exports = [n.name for n in tree.body if isinstance(n, (*_DEF, ast.ClassDef)) and not n.name.startswith("_")]
        for node in tree.body:
            named = isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets)
            if named and isinstance(node.value, (ast.List, ast.Tuple)):
                exports = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        return {
            "imports": imports, "exports": exports, "functions": [_function(n) for n in ast.walk(tree) if isinstance(n, _DEF)],
            "classes": [_class(n) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)], "complexity": float(complexity(tree, True)),
            "internal_dependencies": inside, "external_dependencies": outside,
        }

    def _by_patterns(self, text: str) -> Found:
        imports: list[str] = []
        for m in _FALLBACK_IMPORT.finditer(text):
            imports += [m[1]] if m[1] else [n.split()[0] for n in m[2].split(",") if n.strip()]
        functions = [{"name": m[2], "args": [], "decorators": [], "is_async": bool(m[1])} for m in _FALLBACK_DEF.finditer(text)]
        classes = [{"name": m[1], "type": "class", "bases": [], "methods": []} for m in _FALLBACK_CLASS.finditer(text)]
        return {"imports": imports, "functions": functions, "classes": classes, "complexity": basic_complexity(text)}

    def outline(self, text: str) -> list[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return self._outline_by_patterns(text)
        out: list[tuple] = []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out += [("import", a.name, n.lineno, None) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out += [("import", f"{'.' * n.level}{n.module or ''}:{a.name}", n.lineno, None) for a in n.names]
            elif isinstance(n, (*_DEF, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function" if isinstance(n, ast.FunctionDef) else "async_function"
                out.append((kind, n.name, n.lineno, None))
        seen: dict[str, int] = {}  # each decorator once, where it first is
        for d in (d for n in ast.walk(tree) if isinstance(n, (*_DEF, ast.ClassDef)) for d in n.decorator_list):
            seen[_dotted(d)] = min(d.lineno, seen.get(_dotted(d), d.lineno))
        out += [("decorator", name, line, None) for name, line in seen.items()]
        for n in tree.body:
            if isinstance(n, ast.Assign):
                out += [("global", t.id, n.lineno, None) for t in n.targets if isinstance(t, ast.Name)]
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                out.append(("global", n.target.id, n.lineno, ast.unparse(n.annotation)))
        return out

    def _outline_by_patterns(self, text: str) -> list[tuple]:
        kinds = {"import": r"^\s*((?:from\s+\S+\s+)?import\s+.+)$", "function": r"^(?:async\s+)?def\s+(\w+)", "class": r"^class\s+(\w+)", "decorator": r"^@(\w+)"}
        return [(k, m[1], text.count("\n", 0, m.start(1)) + 1, None) for k, p in kinds.items() for m in re.finditer(p, text, re.M)]


def _first(patterns: list[re.Pattern], line: str) -> re.Match | None:
    """The match of the first pattern that has one."""
    return next((m for p in patterns if (m := p.search(line))), None)


_Q = r"['\"]([^'\"]+)['\"]"
_all = lambda *ps: [re.compile(p) for p in ps]
_IMPORT = _all(
    rf"import\s*\{{([^}}]+)\}}\s*from\s*{_Q}", rf"import\s*\*\s*as\s+(\w+)\s*from\s*{_Q}", rf"import\s+(\w+)\s*from\s*{_Q}", rf"import\s*{_Q}",
    rf"const\s*\{{([^}}]+)\}}\s*=\s*require\s*\({_Q}\)", rf"const\s+(\w+)\s*=\s*require\s*\({_Q}\)",
)
_EXPORT = _all(
    r"export\s+default\s+(\w+)", r"export\s*\{([^}]+)\}", r"export\s+(?:class|const|function|let|var)\s+(\w+)", r"export\s+type\s+(\w+)", r"export\s+interface\s+(\w+)"
)
_ARGS = r"\(([^)]*)\)"
_CALLABLE = _all(
    rf"(?:async\s+)?function\s+(\w+)\s*{_ARGS}", rf"const\s+(\w+)\s*=\s*(?:async\s+)?{_ARGS}\s*=>", r"const\s+(\w+)\s*=\s*async\s+([^=]+)\s*=>",
    rf"(\w+)\s*{_ARGS}\s*\{{", rf"async\s+(\w+)\s*{_ARGS}\s*\{{",
)
_JS_CLASS = re.compile(r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?")
_METHOD, _PROPERTY = _all(r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", r"(?:public|private|protected)?\s*(\w+)\s*[:=]")
_VARIABLE = [re.compile(r"(?:const|let|var)\s+" + p + r"\s*=") for p in (r"(\w+)", r"\{([^}]+)\}", r"\[([^\]]+)\]")]
_TYPE = _all(r"type\s+(\w+)\s*=", r"interface\s+(\w+)\s*(?:extends\s+([^{]+))?\s*\{", r"enum\s+(\w+)\s*\{")
_LINE_COMMENT, _BLOCK_COMMENT = re.compile(r"(?<!:)//.*$", re.M), re.compile(r"/\*.*?\*/", re.S)
_COUNTED = {lang: [re.compile(p) for p in tx.complexity_patterns(lang)] for lang in tx.COMPLEXITY}
_SHOWN = {lang: {n: re.compile(p.replace(tx.WORD, r"\w")) for n, (_, p) in own.items()} for lang, own in tx.FEATURES.items()}


def _score(text: str, language: str) -> float:
    return float(1 + sum(len(p.findall(text)) for p in _COUNTED[language]))


def _features(text: str, language: str) -> list[tuple[str, str]]:
    return [(n, "true") for n, p in _SHOWN[language].items() if p.search(text)]


def _names(s: str) -> list[str]:
    return [n.strip() for n in s.split(",")]


class JavaScriptParser(Parser):
    """Line by line, after comments are gone: the first pattern of a kind that matches a line decides."""

    name, language, extensions = "javascript", "javascript", (".js", ".jsx", ".mjs", ".cjs")

    def _lines(self, text: str) -> tuple[str, list[str]]:
        bare = _BLOCK_COMMENT.sub("", _LINE_COMMENT.sub("", text))
        return bare, bare.split("\n")

    def _classes(self, lines: list[str]) -> list[dict]:
        out = []
        for i, line in enumerate(lines):
            if not (m := _JS_CLASS.search(line)):
                continue
            methods, properties, depth, begun = [], [], 0, False
            for j in range(i, len(lines)):
                own = lines[j]
                depth += own.count("{") - own.count("}")
                begun = begun or "{" in own
                if begun and j > i:
                    if x := _METHOD.search(own):
                        methods.append(x[1])
                    if (x := _PROPERTY.search(own)) and x[1] not in methods:
                        properties.append(x[1])
                if begun and depth == 0:
                    break
            out.append({
                "name": m[1], "type": "class", "bases": [m[2]] if m[2] else [], "implements": _names(m[3]) if m[3] else [],
                "methods": [{"name": x} for x in methods], "attributes": [{"name": x} for x in properties], "line_number": i + 1,
                "flags": ["abstract"] if "abstract" in line else [],
            })
        return out

    def _read(self, text: str) -> tuple[str, list, list, list, list, list]:
        """(bare text, (module, line), (export, line), functions, variables, types)."""
        bare, lines = self._lines(text)
        imports, exports, functions, variables, types = [], [], [], [], []
        for n, line in enumerate(lines, 1):
            if m := _first(_IMPORT, line):
                imports.append((m[m.re.groups], n))
            if m := _first(_EXPORT, line):
                exports += [(x, n) for x in (_names(m[1]) if "{" in m[0] else [m[1]])]
            if m := _first(_CALLABLE, line):
                functions.append({
                    "name": m[1], "args": [p.split(":")[0].strip() for p in m[2].split(",") if p.strip()], "is_async": "async" in line,
                    "line_number": n, "flags": ["arrow"] if "=>" in line else [],
                })
            if m := _first(_VARIABLE, line):
                kind = next((k for k in ("const", "let") if k in line), "var")
                variables += [(x, n, kind) for x in (re.findall(r"\w+", m[1]) if m[0].rstrip("= \t")[-1:] in "}]" else [m[1]])]
            if m := _first(_TYPE, line):
                kind = next((k for k in ("type", "interface") if k in line), "enum")
                bases = _names(m[2]) if kind == "interface" and m.re.groups > 1 and m[2] else []
                types.append({"name": m[1], "type": kind, "bases": bases, "line_number": n, "flags": []})
        return bare, imports, exports, functions, variables, types

    def find(self, text: str) -> Found:
        bare, imports, exports, functions, _, types = self._read(text)
        modules = [m for m, _ in imports]
        shown = [("types_count", str(len(types))), ("has_interfaces", str(any(t["type"] == "interface" for t in types)).lower()), ("has_enums", str(any(t["type"] == "enum" for t in types)).lower())]
        names = {e for e, _ in exports}
        return {
            "imports": modules, "exports": [e for e, _ in exports],
            "functions": [{**f, "is_exported": f["name"] in names} for f in functions],
            "classes": [{**c, "is_exported": c["name"] in names} for c in self._classes(bare.split("\n")) + self._typed(types)],
            "complexity": _score(bare, "javascript"), "internal_dependencies": [m for m in modules if m.startswith((".", "/"))],
            "external_dependencies": [m for m in modules if not m.startswith((".", "/"))], "features": (shown if types else []) + self._flags(text),
        }

    def _typed(self, types: list[dict]) -> list[dict]:
        return []

    def _flags(self, text: str) -> list[tuple[str, str]]:
        return []

    def outline(self, text: str) -> list[tuple]:
        bare, imports, exports, functions, variables, types = self._read(text)
        out = [("import", m, n, None) for m, n in imports] + [("export", e, n, None) for e, n in exports]
        out += [("function", f["name"], f["line_number"], None) for f in functions]
        out += [("class", c["name"], c["line_number"], None) for c in self._classes(bare.split("\n"))]
        return out + [("variable", *v) for v in variables] + [("type", t["name"], t["line_number"], t["type"]) for t in types]


class TypeScriptParser(JavaScriptParser):
    """As JavaScript; types, interfaces and enums are classes of their kind."""

    name, language, extensions = "typescript", "typescript", (".ts", ".tsx")

    def _typed(self, types: list[dict]) -> list[dict]:
        return types

    def _flags(self, text: str) -> list[tuple[str, str]]:
        return _features(text, "typescript")


class GoParser(Parser):
    """Patterns over the text as it is. A method is also listed with the type of its receiver."""

    name, language, extensions = "go", "go", (".go",)
    _package = re.compile(r"^package\s+(\w+)", re.M)
    _import = re.compile(r'import\s+(?:"([^"]+)"|\(([^)]+)\))')
    _func = re.compile(r"func\s+(?:\(([^)]+)\)\s+)?(\w+)\s*\([^)]*\)(?:\s*(?:\([^)]*\)|[^{]*))?")
    _type = re.compile(r"type\s+(\w+)\s+(struct|interface)")

    def find(self, text: str) -> Found:
        package = self._package.search(text)
        imports: list[str] = []
        for m in self._import.finditer(text):
            imports += [m[1]] if m[1] else [x[1] for x in (re.match(r'(?:\w+\s+)?"([^"]+)"', r.strip()) for r in m[2].split("\n")) if x]
        functions = [
            {"name": m[2], "receiver": m[1].split()[-1] if m[1] and m[1].split() else None, "args": [], "is_exported": m[2][0].isupper(), "line_number": text.count("\n", 0, m.start()) + 1, "flags": []}
            for m in self._func.finditer(text)
        ]
        methods: dict[str, list[dict]] = {}
        for f in functions:
            if f["receiver"]:
                methods.setdefault(f["receiver"].lstrip("*").split("[")[0], []).append({"name": f["name"]})
        classes = [
            {"name": m[1], "type": m[2], "is_exported": m[1][0].isupper(), "methods": methods.get(m[1], []), "line_number": text.count("\n", 0, m.start()) + 1, "flags": []}
            for m in self._type.finditer(text)
        ]
        return {
            "module_path": package[1] if package else None, "imports": imports, "functions": functions, "classes": classes,
            "exports": [x["name"] for x in functions + classes if x["is_exported"]], "complexity": _score(text, "go"), "features": _features(text, "go"),
        }

    def outline(self, text: str) -> list[tuple]:
        f = self.find(text)
        return [("import", i, None, None) for i in f["imports"]] + [("function", x["name"], x["line_number"], x["receiver"]) for x in f["functions"]] + [("class", x["name"], x["line_number"], x["type"]) for x in f["classes"]]


class RustParser(Parser):
    """Patterns over the text as it is; words before an item are its flags."""

    name, language, extensions = "rust", "rust", (".rs",)
    _mod = re.compile(r"^mod\s+(\w+)", re.M)
    _use = re.compile(r"use\s+([^;]+);")
    _fn = re.compile(r"(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?fn\s+(\w+)")
    _items = {k: re.compile(rf"(?:pub\s+)?{k}\s+(\w+)") for k in ("struct", "enum", "trait")}

    def find(self, text: str) -> Found:
        mod = self._mod.search(text)
        uses = [m[1].strip() for m in self._use.finditer(text)]
        line = lambda m: text.count("\n", 0, m.start()) + 1
        functions = [
            {"name": m[1], "args": [], "is_async": "async" in m[0], "is_exported": "pub" in m[0], "line_number": line(m), "flags": [w for w in ("pub", "async", "unsafe", "const") if w in m[0]]}
            for m in self._fn.finditer(text)
        ]
        classes = [
            {"name": m[1], "type": k, "is_exported": "pub" in m[0], "line_number": line(m), "flags": ["pub"] if "pub" in m[0] else []}
            for k, p in self._items.items() for m in p.finditer(text)
        ]
        own = ("crate::", "super::", "self::")
        return {
            "module_path": mod[1] if mod else None, "imports": uses, "functions": functions, "classes": classes,
            "exports": [x["name"] for x in functions + classes if x["is_exported"]], "complexity": _score(text, "rust"),
            "internal_dependencies": [u for u in uses if u.startswith(own)], "external_dependencies": [u for u in uses if not u.startswith(own)],
            "features": _features(text, "rust"),
        }

    def outline(self, text: str) -> list[tuple]:
        f = self.find(text)
        return [("import", i, None, None) for i in f["imports"]] + [("function", x["name"], x["line_number"], None) for x in f["functions"]] + [("class", x["name"], x["line_number"], x["type"]) for x in f["classes"]]


class YamlParser(Parser):
    """Keys as exports, variables as imports; the same patterns as functions.text.yaml_structure."""

    name, language, extensions = "yaml", "yaml", (".yaml", ".yml")

    def find(self, text: str) -> Found:
        n = lambda p: len(re.findall(p, text, re.M))
        indent = max((len(x) for x in re.findall(r"^( *)\S", text, re.M)), default=0)
        score = 1 + indent / 2 + n(r"^\s*\w[\w-]*:") * 0.1 + n(r"^\s*-\s") * 0.05 + n(r":\s*[|>]\s*$") * 0.5
        return {"imports": re.findall(r"\$\{(\w+)\}", text), "exports": re.findall(r"^(\w[\w-]*):", text, re.M), "complexity": score}


class MinimalParser(Parser):
    """No structure: for languages without a parser."""

    name, language = "minimal", "unknown"

    def find(self, text: str) -> Found:
        return {"complexity": 0.0}


BUILT_IN, PLUGIN, RUNTIME = 0, 10, 20


class Registry:
    """Suffix to parser: a later registration replaces an earlier one only with a strictly higher priority."""

    def __init__(self, group: str | None = None):
        self.rows: list[tuple[Parser, int, str]] = []
        self.by_ext: dict[str, tuple[Parser, int]] = {}
        self.minimal = MinimalParser()
        for p in (PythonParser(), JavaScriptParser(), TypeScriptParser(), GoParser(), RustParser(), YamlParser()):
            self.register(p, BUILT_IN, "built-in")
        if group:
            for e in entry_points(group=group):
                self.register(e.load()(), PLUGIN, "plugin")

    def register(self, parser: Parser, priority: int = RUNTIME, source: str = "runtime") -> None:
        self.rows.append((parser, priority, source))
        for ext in parser.extensions:
            have = self.by_ext.get(ext.lower())
            if have is None or priority > have[1]:
                self.by_ext[ext.lower()] = (parser, priority)

    def for_extension(self, ext: str) -> Parser | None:
        got = self.by_ext.get(ext.lower())
        return got[0] if got else None

    def for_file(self, path: str) -> Parser | None:
        m = re.search(r"[^/](\.[^./]+)$", path)
        return self.for_extension(m[1]) if m else None

    def for_language(self, language: str) -> Parser | None:
        return next((p for p, _, _ in sorted(self.rows, key=lambda r: -r[1]) if p.language == language), None)

    def info(self, name: str) -> dict | None:
        """Language, suffixes, priority and source of the parser of a name that has the highest priority."""
        own = sorted((r for r in self.rows if r[0].name == name), key=lambda r: -r[1])
        return {"name": name, "language": own[0][0].language, "extensions": list(own[0][0].extensions), "priority": own[0][1], "source": own[0][2]} if own else None

    def names(self) -> list[str]:
        return sorted({p.name for p, _, _ in self.rows})

    def extensions(self) -> list[str]:
        return sorted(self.by_ext)

    def stats(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, _, source in self.rows:
            out[source] = out.get(source, 0) + 1
        return out

    def factory(self) -> Callable[[str], Parser]:
        """What ships to the executors: from a path to its parser, the minimal one for suffixes without."""
        table, rest = {e: p for e, (p, _) in self.by_ext.items()}, self.minimal

        def chosen(path: str) -> Parser:
            name = path.rpartition("/")[2]
            return table.get("." + name.rpartition(".")[2].lower(), rest) if "." in name[1:] else rest

        return chosen

    def parse(self, files: DataFrame) -> DataFrame:
        """``files`` (path, text, ..) with PARSED's columns: each file by its suffix's parser, in one pass over the rows."""
        return _parse(files, self.factory())

    def structures(self, files: DataFrame) -> DataFrame:
        """STRUCTURE rows of all files."""
        return _structures(files, self.factory())
