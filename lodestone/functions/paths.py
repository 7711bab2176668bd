"""Column expressions over file paths: suffix, language, module, kind, checks, safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix to language.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".csv": "csv", ".go": "go", ".h": "c",
    ".hpp": "cpp", ".html": "html", ".java": "java", ".js": "javascript", ".json": "json", ".jsx": "javascript",
    ".kt": "kotlin", ".md": "markdown", ".mjs": "javascript", ".php": "php", ".py": "python", ".pyi": "python", ".pyx": "python",
    ".rb": "ruby", ".rs": "rust", ".rst": "restructuredtext", ".scala": "scala", ".sh": "shell", ".sql": "sql",
    ".swift": "swift", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".txt": "text", ".xml": "xml",
    ".yaml": "yaml", ".yml": "yaml",
}
ALLOWED = sorted({*".c .cpp .csv .go .h .hpp .java .js .json .jsx .md .php .py .rb .rs .rst .swift .ts .tsx .txt .xml .yaml .yml".split()})
FORBIDDEN = [".bat", ".cmd", ".dll", ".dylib", ".exe", ".ps1", ".so"]
FORBIDDEN_PARTS = ["etc", "sys", "proc", "dev", "root", "boot", ".git", ".ssh", ".aws", "private", "secrets"]
FORBIDDEN_PREFIXES = ["/var/log"]
CONFIG_NAMES = ["cargo.toml", "go.mod", "package.json", "pom.xml", "pyproject.toml", "requirements.txt", "setup.cfg", "setup.py"]
DOC_NAMES = ["readme", "readme.md", "readme.rst", "readme.txt"]
STDLIB = "collections csv datetime functools io itertools json logging math os pathlib re sys time typing".split()
IGNORED = "node_modules __pycache__ .git .venv venv env dist build target coverage .cache *.pyc *.pyo *.egg-info".split()
MAX_FILE_BYTES = 100 * 1024 * 1024
RESERVED = "con prn aux nul com1 com2 com3 com4 com5 com6 com7 com8 com9 lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9".split()


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; empty for none and for hidden names."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("unknown"))


def relative(path: Column, base: str) -> Column:
    head = base.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)


def module(rel: Column, lang: Column) -> Column:
    """Dotted module of a Python file, else the relative path."""
    bare = F.regexp_replace(rel, r"\.py$", "")
    dotted = F.regexp_replace(F.translate(bare, "/", "."), r"(^|\.)__init__$", "")
    return F.when((lang == "python") & rel.endswith(".py"), dotted).otherwise(rel)


def file_type(path: Column) -> Column:
    n = F.lower(name(path))
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return (
        F.when(n.isin(CONFIG_NAMES), "config")
        .when(n.isin(DOC_NAMES), "doc")
        .when(n.contains("test") | (parent == "tests"), "test")
        .when(n == "__init__.py", "init")
        .otherwise("source")
    )


def parser_file_type(path: Column, lang: Column) -> Column:
    """What a language's parser calls a file."""
    n = F.lower(name(path))
    return (
        F.when((lang == "go") & n.endswith("_test.go"), "test")
        .when((lang == "go") & (n == "main.go"), "main")
        .when((lang == "rust") & (n == "main.rs"), "main")
        .when((lang == "rust") & (n == "lib.rs"), "library")
        .when((lang == "rust") & (n == "mod.rs"), "module")
        .when((lang == "typescript") & n.endswith(".d.ts"), "declaration")
        .when((lang == "typescript") & (n.contains(".test.") | n.contains(".spec.")), "test")
        .otherwise("source")
    )


def external(imports: Column, project: str) -> Column:
    own = F.filter(imports, lambda x: ~(x.startswith(".") | x.startswith(project)))
    return F.array_distinct(F.filter(own, lambda x: ~F.regexp_extract(x, r"^([^.]*)", 1).isin(STDLIB)))


def internal(imports: Column, project: str) -> Column:
    return F.array_distinct(F.filter(imports, lambda x: x.startswith(".") | x.startswith(project)))


def allowed(path: Column) -> Column:
    return suffix(path).isin(ALLOWED)


def file_error(path: Column, size: Column) -> Column:
    """The first rule that a file breaks, null if none."""
    s = suffix(path)
    return (
        F.when(size > MAX_FILE_BYTES, "too large")
        .when(s.isin(FORBIDDEN), "forbidden extension")
        .when(~s.isin(ALLOWED), "extension not allowed")
    )


def ignored(path: Column, patterns: list[str] = IGNORED) -> Column:
    """A bare name equals a folder on the path, *.x a suffix; a pattern with a slash occurs anywhere."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    out = F.lit(False)
    for p in patterns:
        if p.startswith("*."):
            out = out | path.endswith(p[1:])
        elif "/" in p:
            out = out | path.contains(p)
        else:
            out = out | F.array_contains(folders, p)
    return out


def path_error(path: Column, base: str, depth: int = 20) -> Column:
    """The first rule that a path breaks, null if none."""
    p = parts(path)
    prefix = F.lit(False)
    for x in FORBIDDEN_PREFIXES:
        prefix = prefix | path.startswith(x)
    bad = F.exists(p, lambda x: x.isin(FORBIDDEN_PARTS))
    return (
        F.when(path.contains("\0"), "null byte")
        .when(F.size(p) > depth, "too deep")
        .when(F.array_contains(p, ".."), "leaves its base")
        .when(bad | prefix, "forbidden path")
        .when(~path.startswith(base), "outside its base")
    )


def safe_name(n: Column) -> Column:
    stem = F.lower(F.regexp_extract(n, r"^([^.]*)", 1))
    return n.rlike("^[a-zA-Z0-9._-]+$") & (F.length(n) <= 255) & ~stem.isin(RESERVED) & ~n.startswith(".")


def sanitize(n: Column, most: int = 200) -> Column:
    """Only safe characters, and at most so many with the suffix kept."""
    clean = F.regexp_replace(n, r"[^a-zA-Z0-9._-]", "_")
    ext = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    cut = F.concat(F.substring(clean, F.lit(1), F.lit(most) - F.length(ext)), ext)
    return F.when(F.length(clean) > most, cut).otherwise(clean)


def join_safe(base: str, rel: Column) -> Column:
    """base/rel, null if rel is absolute or leaves the base."""
    bad = rel.startswith("/") | F.array_contains(F.split(rel, "/"), "..") | rel.contains("\0")
    return F.when(~bad, F.concat(F.lit(base.rstrip("/") + "/"), rel))


def profile(path: Column) -> Column:
    """struct<strategy,level> of a file by its kind."""
    p, s = F.lower(name(path)), suffix(path)
    one = lambda strategy, level: F.struct(F.lit(strategy).alias("strategy"), F.lit(level).alias("level"))
    return (
        F.when(p.contains("test") | p.contains("spec"), one("signature", 9))
        .when(p.rlike(r"\.(min|bundle|dist)\.js$"), one("summary", 12))
        .when(s.isin(".md", ".rst", ".txt"), one("summary", 12))
        .when(s.isin(".json", ".yaml", ".toml", ".ini"), one("full", 6))
        .otherwise(one("structural", 9))
    )
