"""Path helpers as column expressions: names, stems, languages, globs, entry points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The file kinds that a corpus scan keeps and the language each is reported as.
LANGUAGES = {
    "py": "Python", "ts": "TypeScript", "tsx": "TypeScript (React)", "js": "JavaScript", "jsx": "JavaScript (React)", "go": "Go", "rs": "Rust", "java": "Java", "cpp": "C++", "c": "C", "h": "C/C++ Header",
    "hpp": "C++ Header", "cs": "C#", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "scala": "Scala", "toml": "TOML", "yaml": "YAML", "yml": "YAML", "json": "JSON", "md": "Markdown",
}
# Entry-point and configuration file names.
ENTRY_NAMES = ("main.py", "app.py", "index.js", "index.ts", "main.ts", "main.js", "main.go", "main.rs", "server.py", "__main__.py")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    """Base name without its last extension; a name that begins with its only dot keeps it."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def language(path: Column, names: dict[str, str] | None = None, other: str = "other") -> Column:
    """Language of a path by its extension; `names` maps extensions to languages."""
    pairs = [F.lit(x) for pair in (names or LANGUAGES).items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit(other))


def glob_regex(glob: str) -> str:
    """Java regular expression of a shell glob in which `*` also crosses `/`; a leading `**/` is optional."""
    out, i = "", 0
    if glob.startswith("**/"):
        out, i = "(?:.*/)?", 3
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
            while glob[i : i + 2] == "**":
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, *globs: str) -> Column:
    """Whether the whole path, or the path below some folder, matches any of the globs."""
    if not globs:
        return F.lit(False)
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g)) | path.rlike(glob_regex("**/" + g))
    return found


def is_entry_name(path: Column, names: tuple[str, ...] = ENTRY_NAMES) -> Column:
    return base_name(path).isin(*names)


def is_entry_point(path: Column, content: Column) -> Column:
    """Entry points by content, by the rule of the file's language; by name for scripts."""
    ext = extension(path)
    return (
        F.when(ext == "py", content.rlike(r"""if\s+__name__\s*==\s*['"]__main__['"]"""))
        .when(ext == "java", content.rlike(r"public\s+static\s+void\s+main"))
        .when(ext.isin("c", "cpp", "cc", "h", "hpp"), content.rlike(r"int\s+main\s*\("))
        .when(ext.isin("js", "ts", "jsx", "tsx"), base_name(path).isin("index.js", "main.js", "index.ts", "main.ts"))
        .otherwise(F.lit(False))
    )


def project_id(path: Column) -> Column:
    """Folder name, a dash and 12 hexadecimal digits of the path's SHA-1."""
    return F.concat_ws("-", base_name(path), F.substring(F.sha1(path.cast("binary")), 1, 12))


def source_files(files: DataFrame, config: tuple[str, ...] = ("toml", "yaml", "yml", "json"), docs: tuple[str, ...] = ("md",), keep: tuple[str, ...] = ("package.json",)) -> DataFrame:
    """Rows of `files` (path, ...) that hold source code: known extensions without documents and, but for `keep`, configuration."""
    ext = extension(F.col("path"))
    return files.where(ext.isin(*LANGUAGES) & ~ext.isin(*docs) & (~ext.isin(*config) | base_name(F.col("path")).isin(*keep)))
