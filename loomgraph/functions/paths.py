"""Column functions over paths, ids, arguments and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix to language of the extractors, in registration order; suffix to display label.
LANGUAGE_SUFFIXES = (("c", (".c", ".h")), ("go", (".go",)), ("js", (".jsx", ".js", ".ts", ".tsx", ".mjs", ".cjs")), ("python", (".py",)))
LABELS = {".py": "Python", ".go": "Go", ".js": "JavaScript", ".ts": "TypeScript", ".rb": "Ruby", ".rs": "Rust", ".java": "Java"}
# Directories that a scan never enters; what Python traces leave out.
PRUNED_DIRECTORIES = (".git", "node_modules", "venv", ".venv", "env", "__pycache__", ".tox")
NOISE_FILES = ("lib/", "site-packages", "<frozen")
NOISE_FUNCTIONS = ("<module>", "<genexpr>", "<listcomp>", "<dictcomp>", "__annotate__", "root")
ARGUMENT_CHARS = 120


def relative_path(path: Column, root: str) -> Column:
    """path below root; the root itself is '.'; other paths stay."""
    root = root.rstrip("/")
    return F.when(path == root, ".").when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def dirname(path: Column) -> Column:
    """Everything before the last slash; '.' for a bare name."""
    d = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(d == "", ".").otherwise(d)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """The extractor's language of a file, or null."""
    s, out = suffix(path), None
    for name, suffixes in LANGUAGE_SUFFIXES:
        out = F.when(s.isin(*suffixes), name) if out is None else out.when(s.isin(*suffixes), name)
    return out


def language_order(lang: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n, _ in LANGUAGE_SUFFIXES]), lang).cast("int")


def language_label(path: Column) -> Column:
    """The display name of a file's language, or null."""
    s, out = suffix(path), None
    for k, v in LABELS.items():
        out = F.when(s == k, v) if out is None else out.when(s == k, v)
    return out


def is_pruned(path: Column) -> Column:
    """Whether a directory of the path, or its last part, is one that scans never enter."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in PRUNED_DIRECTORIES]))


def function_id(lang: Column, path: Column, scope: Column, name: Column, package: Column | None = None) -> Column:
    """module[.Class].name for Python and JavaScript, package[.Receiver].name for Go, file::name for C."""
    module = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    dotted = F.concat_ws(".", module, scope, name)
    return F.when(lang == "c", F.concat(basename(path), F.lit("::"), name)).when(lang == "go", F.concat_ws(".", package if package is not None else F.lit("main"), scope, name)).otherwise(dotted)


def go_package(path: Column) -> Column:
    """The last part of the path that is not a .go file, or main."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.endswith(".go") & (x != ""))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("main"))


def is_noise(fn: Column, file: Column, root: str | None = None) -> Column:
    """Whether a Python trace event is left out of records."""
    noise = fn.isin(*NOISE_FUNCTIONS)
    for part in NOISE_FILES:
        noise = noise | file.contains(part)
    return noise | ~file.contains(root) if root else noise


def is_noise_js(file: Column, root: str) -> Column:
    return ~file.startswith(root) | file.contains("node_modules") | file.contains("js_trace")


def cut_argument(value: Column, chars: int = ARGUMENT_CHARS) -> Column:
    return F.when(F.length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit("..."))).otherwise(value)


def cut_arguments(args: Column, chars: int = ARGUMENT_CHARS) -> Column:
    return F.transform_values(args, lambda _, v: cut_argument(v, chars))


def heat(hits: Column) -> Column:
    return F.when(hits > 100, "blazing").when(hits > 20, "high").when(hits > 5, "med").when(hits > 0, "low").otherwise("none")
