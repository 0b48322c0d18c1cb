"""Column predicates and values over file paths."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values.
TEST_SUFFIXES = ("_test.py", ".test.ts", ".test.js", ".spec.ts", ".spec.js")
TEST_PATTERNS = ("test_%", "%/test_%", "%_test.py", "%.test.ts", "%.test.js", "%.spec.ts", "%.spec.js", "tests/%", "%/tests/%")
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_file(path: Column) -> Column:
    """By file name alone, case-sensitive."""
    name = base_name(path)
    return reduce(Column.__or__, [name.startswith("test_"), *[name.endswith(s) for s in TEST_SUFFIXES]])


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """By SQL patterns, case-insensitive."""
    return reduce(Column.__or__, [F.lower(path).like(p) for p in patterns])


def is_test_path(path: Column, strict: bool = False) -> Column:
    """By SQL patterns, case-insensitive; ``_`` is a wildcard unless ``strict``."""
    patterns = [p.replace("_", "\\_") for p in TEST_PATTERNS] if strict else TEST_PATTERNS
    return matches_any(path, patterns)


def language_of(path: Column) -> Column:
    """Language by suffix, null where there is no parser; case-sensitive."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    name = base_name(path)
    return F.when(name.contains("."), F.try_element_at(table, F.element_at(F.split(name, r"\."), -1)))


def module_name(path: Column) -> Column:
    """Dotted name: separators become dots, one source suffix and a trailing package file go."""
    dotted = F.translate(path, "/\\", "..")
    dotted = F.regexp_replace(dotted, r"\.(py|js|ts|jsx|tsx)$", "")
    return F.regexp_replace(dotted, r"\.__init__$", "")


# Fixed values.
PATH_SKIP = ("src", "lib", "app", "index", "__init__", "py", "js", "ts", "tsx", "jsx", "vue")


def path_tokens(path: Column, skip: Sequence[str] = PATH_SKIP) -> Column:
    """Parts of a path between ``/``, ``.`` and ``_``, without those that say nothing."""
    return F.filter(F.split(path, r"[/._]"), lambda t: (t != "") & ~t.isin(*skip))


def _regex(pattern: str) -> str:
    return fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether ignore patterns match. A pattern that ends in ``/``, or has neither ``/`` nor
    ``.``, names directories: a bare one any component but the last, one with a path any
    proper prefix. Others match the whole path or the last component; ``*`` crosses ``/``."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    tests = []
    for raw in patterns:
        pattern = raw.strip()
        if not pattern or pattern.startswith("#"):
            continue
        if pattern.endswith("/") or ("/" not in pattern and "." not in pattern):
            bare = pattern.rstrip("/")
            if "/" in bare:
                prefixes = F.transform(folders, lambda _, i: F.array_join(F.slice(folders, F.lit(1), i + 1), "/"))
                tests.append(_any(prefixes, bare))
            else:
                tests.append(_any(folders, bare))
        else:
            whole = "^" + _regex(pattern)
            tests.append(path.rlike(whole) | base_name(path).rlike(whole))
    return reduce(Column.__or__, tests, F.lit(False))


def _any(values: Column, pattern: str) -> Column:
    regex = "^" + _regex(pattern)
    return F.exists(values, lambda v: v.rlike(regex))


def qualified_name(kind: Column, path: Column, parent: Column, name: Column) -> Column:
    inner = F.concat(F.coalesce(F.concat(parent, F.lit(".")), F.lit("")), name)
    return F.when(kind == "File", path).otherwise(F.concat(path, F.lit("::"), inner))
