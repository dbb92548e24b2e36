"""Columns and tests over paths: parts, globs, types, kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own registry: type name to globs.
TYPES: dict[str, tuple[str, ...]] = {
    "py": ("*.py", "*.pyi"), "go": ("*.go",), "rust": ("*.rs",), "c": ("*.c", "*.h"), "cpp": ("*.cpp", "*.hpp", "*.cc"), "java": ("*.java",), "js": ("*.js", "*.mjs"),
    "ts": ("*.ts", "*.tsx"), "sql": ("*.sql",), "sh": ("*.sh", "*.bash"), "md": ("*.md", "*.markdown"), "txt": ("*.txt",), "html": ("*.html", "*.htm"),
    "json": ("*.json",), "yaml": ("*.yaml", "*.yml"), "toml": ("*.toml",), "csv": ("*.csv",), "cmake": ("CMakeLists.txt", "*.cmake"), "make": ("Makefile", "*.mk"),
    "en": ("*.en",), "fr": ("*.fr",), "de": ("*.de",), "es": ("*.es",),
}
DOC_TYPES, DATA_TYPES = ("md", "txt"), ("json", "yaml", "toml", "csv")
DOC_NAMES = ("README*", "CHANGELOG*", "LICENSE*", "NOTICE*", "AUTHORS*", "CONTRIBUTING*")
DOC_FOLDERS = ("doc", "docs")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """What is before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last suffix with its dot; none for names that only begin with a dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def is_hidden(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(^|/)\.[^/.][^/]*"))


def by_component(path: Column) -> Column:
    """A sort key: folder by folder, so a folder comes before a file whose name it begins."""
    return F.split(path, "/")


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """``**``, ``*``, ``?``, classes and ``{a,b}``; a glob without a slash holds at any depth, one
    with a leading slash from the root."""
    rooted, glob = "/" in glob.rstrip("/"), glob.removeprefix("/")
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return ("(?i)" if ignore_case else "") + ("^" if rooted else "(?:^|/)") + out + "(?:/.*)?$"


def in_globs(path: Column, globs: list[str], ignore_case: bool = False) -> Column:
    """The last glob that fits decides; ``!`` excludes. With any including glob, others are out."""
    verdict = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        verdict = F.when(F.rlike(path, F.lit(glob_regex(g.removeprefix("!"), ignore_case))), not g.startswith("!")).otherwise(verdict)
    return verdict


def registry(add: tuple[str, ...] = (), clear: tuple[str, ...] = ()) -> dict[str, tuple[str, ...]]:
    """The known types without those in ``clear`` and with ``name:glob`` or ``name:include:a,b``
    additions, the latter taking over other types' globs."""
    out = {k: v for k, v in TYPES.items() if k not in clear}
    for rule in add:
        name, _, glob = rule.partition(":")
        if not re.fullmatch(r"\w+", name) or name == "all" or not glob:
            raise ValueError(f"not a type definition: {rule!r}")
        if glob.startswith("include:"):
            others = glob.removeprefix("include:").split(",")
            if any(o not in out for o in others):
                raise ValueError(f"unknown type in {rule!r}")
            new = tuple(g for o in others for g in out[o])
        else:
            new = (glob,)
        out[name] = out.get(name, ()) + new
    return out


def of_types(path: Column, names: list[str], known: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether any of the types has the path; ``all`` stands for every known type."""
    known = TYPES if known is None else known
    unknown = [n for n in names if n not in known and n not in ("all", "docs")]
    if unknown:
        raise ValueError(f"unknown type {unknown[0]!r}")
    globs = [g for n in names for g in (sum(known.values(), ()) if n == "all" else known.get(n, ()))]
    test = F.rlike(path, F.lit("|".join(glob_regex(g) for g in globs))) if globs else F.lit(False)
    return test | (genus(path) == "docs") if "docs" in names else test


def genus(path: Column) -> Column:
    """docs, data or code, of every path exactly one: by its spelling, then by where it is."""
    fits = lambda globs: F.rlike(path, F.lit("|".join(glob_regex(g) for g in globs)))
    of = lambda names: fits([g for n in names for g in TYPES[n]])
    source = [n for n in TYPES if n not in DOC_TYPES + DATA_TYPES + ("en", "fr", "de", "es", "html")]
    folder = F.rlike(path, F.lit("(?:^|/)(?:" + "|".join(DOC_FOLDERS) + ")/"))
    return F.when(of(source), "code").when(of(DOC_TYPES) | fits(DOC_NAMES), "docs").when(of(DATA_TYPES), "data").when(folder, "docs").otherwise("code")


def parse_size(text: str) -> int:
    """Bytes of ``10``, ``4K``, ``2M`` or ``1G``."""
    m = re.fullmatch(r"(\d+)([KMG]?)", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def ancestors(path: Column) -> Column:
    """The folders above a path, outermost first."""
    parts = F.split(path, "/")
    up = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, up(p)).otherwise(F.array().cast("array<string>")))[0]


def _verdict(entry: Column, rules: list[tuple[str, str]], folder: bool) -> Column:
    """What the last rule that fits says of one file or folder."""
    verdict = F.lit(False)
    for base, rule in rules:
        glob = rule.removeprefix("!")
        if glob.endswith("/") and not folder:
            continue
        regex = glob_regex(glob.rstrip("/")).removesuffix("(?:/.*)?$") + "$"
        if base:
            below = "^\\Q" + base + "/\\E"
            regex = below + regex.removeprefix("^") if regex.startswith("^") else below + "(?:.*/)?" + regex.removeprefix("(?:^|/)")
        verdict = F.when(F.rlike(entry, F.lit(regex)), not rule.startswith("!")).otherwise(verdict)
    return verdict


def ignored(path: Column, rules: list[str] | dict[str, list[str]]) -> Column:
    """Ignore-file rules: those of the root in a list, or lists by the folder they are about (""
    is the root), where a deeper folder's rules outrank a higher one's. A later ``!`` rule takes
    back, but nothing comes back that is below an ignored folder."""
    by_folder = rules if isinstance(rules, dict) else {"": rules}
    ordered = [(f.strip("/"), r.rstrip()) for f in sorted(by_folder, key=lambda f: (len([x for x in f.split("/") if x]), f)) for r in by_folder[f]]
    ordered = [(f, r) for f, r in ordered if r and not r.startswith("#")]
    if not ordered:
        return F.lit(False)
    return F.exists(ancestors(path), lambda a: _verdict(a, ordered, True)) | _verdict(path, ordered, False)
