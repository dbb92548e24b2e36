"""Declarative search requests and their plans."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.patterns import Options, Pattern, compile_pattern
from siftline.operators import aggregate, rank, search

ALIASES = {"query": "pattern", "glob": "globs", "context_lines": "context"}
IGNORED = {"place", "at", "semantic"}


@dataclass(frozen=True)
class SearchRequest:
    pattern: str | tuple[str, ...]
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    line: bool = False
    unicode: bool = True
    invert: bool = False
    multiline: bool = False
    multiline_dotall: bool = False
    engine: str = "auto"
    max_count: int | None = None
    before: int = 0
    after: int = 0
    context: int = 0
    globs: tuple[str, ...] = ()
    iglobs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    genera: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    hidden: bool = False
    ignore_rules: tuple[str, ...] = ()
    max_depth: int | None = None
    max_size: int | None = None
    quiet: bool = False
    no_ignore: bool = False
    ignore_tree: tuple[tuple[str, tuple[str, ...]], ...] = ()  # folders and the rules of their ignore files
    type_add: tuple[str, ...] = ()
    type_clear: tuple[str, ...] = ()
    crlf: bool = False
    null_data: bool = False
    skip_binary: bool = False
    unrestricted: int = 0  # 1 heeds no ignore rules, 2 takes hidden files too, 3 binary ones too
    sort: str | None = None
    reverse: bool = False
    max_results: int | None = None

    def __post_init__(self) -> None:
        if self.null_data and (self.multiline or self.multiline_dotall):
            raise ValueError("null_data frames records, multiline searches whole texts")
        if not self.pattern or (not isinstance(self.pattern, str) and not all(self.pattern)):
            raise ValueError("empty pattern")

    @classmethod
    def from_tool(cls, arguments: dict) -> SearchRequest:
        """From a tool call's arguments; keys that mean nothing are errors. Where a list is meant, one text will do."""
        given = {ALIASES.get(k, k): v for k, v in arguments.items() if ALIASES.get(k, k) not in IGNORED}
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown option {unknown[0]!r}")
        several = {f.name for f in fields(cls) if f.type.startswith("tuple")}
        alone = {k: (v,) for k, v in given.items() if k in several and isinstance(v, str)}
        return cls(**given | {k: tuple(v) for k, v in given.items() if isinstance(v, list)} | alone)

    def compiled(self) -> Pattern:
        multi = self.multiline or self.multiline_dotall
        options = Options(self.fixed, self.ignore_case, self.smart_case, self.word, self.line, self.unicode, multi, self.multiline_dotall, self.crlf, self.engine, self.null_data)
        return compile_pattern(self.pattern if isinstance(self.pattern, str) else list(self.pattern), options)

    def scope(self, docs: DataFrame) -> DataFrame:
        """The documents the request is about. Path tests come before any read of bodies."""
        path, test = F.col("path"), F.lit(True)
        chosen = F.lit(False)  # globs that include bring in hidden and ignored paths, types hidden ones
        if self.globs or self.iglobs:
            globs = paths.in_globs(path, list(self.globs)) if self.globs else F.lit(True)
            globs = globs & (paths.in_globs(path, list(self.iglobs), True) if self.iglobs else F.lit(True))
            test = test & globs
            if any(not g.startswith("!") for g in (*self.globs, *self.iglobs)):
                chosen = globs
        if self.paths:
            test = test & F.rlike(path, F.lit("|".join(f"^\\Q{p.removeprefix('./').rstrip('/')}\\E(?:/|$)" for p in self.paths)))
        if not self.hidden and self.unrestricted < 2 and not self.types:
            test = test & (chosen | ~paths.is_hidden(path))
        if (self.ignore_rules or self.ignore_tree) and not self.no_ignore and not self.unrestricted:
            tree = {folder: list(rules) for folder, rules in self.ignore_tree}
            tree[""] = tree.get("", []) + list(self.ignore_rules)  # rules given by hand outrank the root's files
            test = test & (chosen | ~paths.ignored(path, tree))
        known = paths.registry(self.type_add, self.type_clear)
        if self.types:
            test = test & paths.of_types(path, list(self.types), known)
        if self.not_types:
            test = test & ~paths.of_types(path, list(self.not_types), known)
        if self.genera:
            wanted = [g for g in self.genera if not g.startswith("no-")]
            vetoed = [g.removeprefix("no-") for g in self.genera if g.startswith("no-")]
            kind = paths.genus(path)
            test = test & (kind.isin(wanted) if wanted else F.lit(True)) & ~kind.isin(vetoed)
        if self.max_depth is not None:
            test = test & (paths.depth(path) <= self.max_depth)
        if self.max_size is not None:
            test = test & (F.octet_length("body") <= self.max_size)
        if self.skip_binary and self.unrestricted < 3:
            test = test & ~F.contains("body", F.lit("\0"))
        return docs.where(test)

    def _around(self) -> tuple[int, int]:
        return self.before or self.context, self.after or self.context

    def _shown(self, rows: DataFrame) -> DataFrame:
        """In the order and up to the number of rows that the request names."""
        rows = rows if self.sort is None else search.in_order(rows, self.sort, self.reverse)
        return rows if self.max_results is None else rows.limit(self.max_results)

    def lines(self, docs: DataFrame) -> DataFrame:
        """path, line_number, line and, with context, kind and group_id; of a multiline search path,
        text, first_line and last_line."""
        rows, p = self.scope(docs), self.compiled()
        before, after = self._around()
        if p.options.multiline:
            if self.invert or before or after or self.max_count is not None:
                raise ValueError("a multiline search has spans; no invert, context or max_count")
            return self._shown(search.multiline_spans(rows, p))
        if before or after:
            return self._shown(search.with_context(rows, p, before, after, self.invert, self.max_count))
        return self._shown(search.matching_lines(rows, p, self.invert, self.max_count))

    def records(self, docs: DataFrame) -> DataFrame:
        return self._shown(search.match_records(self.scope(docs), self.compiled(), self.invert, self.max_count, *self._around()))

    def json(self, docs: DataFrame) -> DataFrame:
        before, after = self._around()
        return search.json_stream(self.scope(docs), self.compiled(), before, after, self.invert, self.max_count)

    def listing(self, docs: DataFrame) -> DataFrame:
        """The paths in scope; the pattern takes no part."""
        return self._shown(self.scope(docs).select("path"))

    def files(self, docs: DataFrame) -> DataFrame:
        return self._shown(search.files_with(self.scope(docs), self.compiled(), self.invert))

    def files_without(self, docs: DataFrame) -> DataFrame:
        return self._shown(search.files_without(self.scope(docs), self.compiled(), self.invert))

    def count(self, docs: DataFrame) -> int:
        rows = search.count_lines(self.scope(docs), self.compiled(), invert=self.invert, max_count=self.max_count)
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def count_matches(self, docs: DataFrame) -> int:
        rows = search.count_matches(self.scope(docs), self.compiled(), self.invert, self.max_count)
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def exists(self, docs: DataFrame) -> bool:
        return self.max_count != 0 and search.exists(self.scope(docs), self.compiled(), self.invert)

    def absent(self, docs: DataFrame) -> bool:
        """True only where nothing was found; an error is not an answer and raises."""
        return not self.exists(docs)

    def summary(self, docs: DataFrame, by="file", top: int = 0) -> DataFrame:
        return aggregate.summary(self.scope(docs), self.compiled(), by, top)

    def ranked(self, docs: DataFrame, top: int = 20) -> DataFrame:
        if self.before or self.after or self.context:
            raise ValueError("ranked search has no context")
        if self.engine == "backtracking":
            raise ValueError("ranked search has the linear engine only")
        return rank.ranked(self.scope(docs), self.compiled(), top)


def exit_code(request: SearchRequest, docs: DataFrame) -> int:
    """0 if the request has a match, 1 if it has none, 2 if it can't be answered."""
    try:
        return 0 if request.exists(docs) else 1
    except (ValueError, PySparkException):
        return 2


def capabilities() -> dict:
    return {"schema_version": 1, "options": sorted(f.name for f in fields(SearchRequest)), "axes": list(aggregate.AXES), "types": sorted(paths.TYPES), "genera": ["code", "data", "docs"]}
