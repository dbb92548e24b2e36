"""Search patterns: options to one Java regular expression, checked on the driver, with the
literals that every match must hold."""

from __future__ import annotations

import re
from re import _parser as sre_parser
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Non-characters that mark matches while spans are taken; text never holds them.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
#: POSIX class names and the Java classes that mean them.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "ascii": r"\p{ASCII}"}
SCRIPTS = ("Greek", "Cyrillic", "Latin", "Han", "Hiragana", "Katakana", "Arabic", "Hebrew", "Thai", "Hangul", "Devanagari", "Armenian", "Georgian")
_SPECIAL = set("\\.[]{}()*+?^$|")
_BACKTRACKING = re.compile(r"\(\?[=!>]|\(\?<[=!]|\\[1-9]|\\k<|\(\?P=|[*+?}]\+")


class PatternError(ValueError):
    """The pattern is malformed."""


class UnsupportedPattern(PatternError):
    """The pattern is well formed, but needs the backtracking engine."""


@dataclass(frozen=True)
class Options:
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    line: bool = False
    unicode: bool = True
    multiline: bool = False
    dotall: bool = False
    crlf: bool = False
    engine: str = "auto"  # linear, backtracking, auto
    null_data: bool = False


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern: ``regex`` for Java, ``literals`` that each match holds (maybe none)."""

    regex: str
    literals: tuple[str, ...] = ()
    plain: str | None = None  # set if a match is simply this text
    needs_backtracking: bool = False
    options: Options = field(default_factory=Options)

    def found_in(self, text: Column) -> Column:
        """Whether ``text`` has a match. Literals are tested first: Parquet scans can use those."""
        if self.plain is not None:
            return F.contains(text, F.lit(self.plain))
        test = F.rlike(text, F.lit(self.regex))
        for literal in self.literals:
            test = F.contains(text, F.lit(literal)) & test
        return test

    def may_be_in(self, body: Column) -> Column:
        """A test of a whole document that holds wherever one of its lines matches."""
        test = F.lit(True)
        for literal in self.literals if self.plain is None else (self.plain,):
            test = test & F.contains(body, F.lit(literal))
        return test

    def texts(self, text: Column) -> Column:
        """All matches, leftmost first, as the printers give them: see ``spans``."""
        return F.transform(self.spans(text), lambda m: m["text"])

    def spans(self, text: Column, replacement: str | None = None) -> Column:
        """array<struct<text, start, end>> with byte offsets; with a replacement also ``shown``, what would
        stand there, as made where the match stands. An empty match right behind another match is left out."""

        def cut(by: str) -> Column:
            return F.split(F.regexp_replace(text, F.lit(self.regex), F.lit(f"{OPEN}{by}{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)

        kind = "text:string,start:int,end:int,touches:boolean" + ("" if replacement is None else ",shown:string")
        both = F.struct(cut("$0").alias("p"), *([] if replacement is None else [cut(to_replacement(replacement)).alias("r")]))

        def of(x: Column) -> Column:
            p = x["p"]

            def at(k: Column) -> Column:
                before = F.aggregate(F.slice(p, 1, k), F.lit(0), lambda n, x: n + F.octet_length(x))
                gap = F.get(p, k - 1)
                return F.struct(F.get(p, k).alias("text"), before.alias("start"), (before + F.octet_length(F.get(p, k))).alias("end"), ((k > 1) & (gap == "")).alias("touches"), *([] if replacement is None else [F.get(x["r"], k).alias("shown")]))

            found = F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), at)).otherwise(F.array().cast(f"array<struct<{kind}>>"))
            kept = F.filter(found, lambda m: ~((m["text"] == "") & m["touches"]))
            names = ["text", "start", "end"] + ([] if replacement is None else ["shown"])
            return F.transform(kept, lambda m: F.struct(*(m[n].alias(n) for n in names)))

        return F.transform(F.array(both), of)[0]

    def occurrences(self, text: Column) -> Column:
        """Number of matches; patterns that can match nothing are counted by their spans."""
        nullable = self.plain is None and _can_be_empty(self.regex)
        return (F.size(self.spans(text)) if nullable else F.regexp_count(text, F.lit(self.regex))).cast("long")


def _can_be_empty(regex: str) -> bool:
    """Whether a match may have no characters; true where that can't be told."""
    body = re.sub(r"^\(\?[a-zA-Z]+\)", "", regex).replace(r"\z", r"\Z")
    body = re.sub(r"\\[pP](?:\{\^?\w+\}|\w)", r"\\w", body).replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")
    body = re.sub(r"\\k<(\w+)>", r"(?P=\1)", body)
    try:
        return sre_parser.parse(body).getwidth()[0] == 0
    except re.error:
        return True


#: A quantified group that ends in a quantifier itself: backtracking may try it in exponentially many ways.
_NESTED = re.compile(r"(?:[+*]|\{\d+,\d*\})\)(?:[+*]|\{\d+,\d*\})(?!\+)")


def to_java(pattern: str) -> str:
    """The reference dialect in Java's terms: named groups, scripts, POSIX classes."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"\\([pP])\{(" + "|".join(SCRIPTS) + r")\}", r"\\\1{Is\2}", out)
    return re.sub(r"\[:(\^?)(\w+):\]", lambda m: (POSIX.get(m[2], m[0]) if not m[1] else "[^" + POSIX.get(m[2], m[0]) + "]"), out)


def _groups(pattern: str) -> int:
    """Capturing groups, outside classes and escapes."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", bare))


def check(pattern: str, options: Options) -> None:
    """Raises for malformed patterns, and for those the linear engine doesn't take."""
    for number in re.findall(r"(?<!\\)(?:\\\\)*\\([1-9])", pattern):
        if int(number) > _groups(pattern):
            raise PatternError(f"no group {number} in {pattern!r}")
    if options.engine == "linear" and _BACKTRACKING.search(pattern):
        raise UnsupportedPattern(f"{pattern!r} needs the backtracking engine")
    if options.engine == "linear" and _NESTED.search(re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern, flags=re.S)):
        raise UnsupportedPattern(f"{pattern!r} repeats a repeated group, which no linear time can be promised for")
    jvm = getattr(SparkSession.getActiveSession(), "_jvm", None)
    try:
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(to_java(pattern))
        else:
            re.compile(pattern)
    except Exception as e:
        raise PatternError(f"malformed pattern {pattern!r}") from e


def literals(pattern: str) -> tuple[str, ...]:
    """Texts that each match surely holds: runs of plain characters at the top level, none at all
    where alternation, flags or classes could change that. A filter by them never loses a match."""
    if "|" in pattern or "(?" in pattern:
        return ()
    found, run, depth, i = [], "", 0, 0

    def close() -> None:
        nonlocal run
        if len(run) >= 3:
            found.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            step, ch = 2, pattern[i + 1] if pattern[i + 1] in _SPECIAL or not pattern[i + 1].isalnum() else None
            if ch is None and pattern[i + 1] in "pPx" and pattern[i + 2 : i + 3] == "{":
                step = pattern.index("}", i) - i + 1
            if ch is None and pattern[i + 1] in "xuc0Q":
                return ()
        elif c == "[":
            close()
            end = i + 1
            end += pattern[end : end + 1] == "^"
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else (pattern.index(":]", end) - end + 2 if pattern.startswith("[:", end) else 1)
            step, ch = end - i + 1, None
        elif c in "()":
            close()
            depth += 1 if c == "(" else -1
            i += 1
            continue
        else:
            step, ch = 1, c if c not in _SPECIAL else None
        after = pattern[i + step : i + step + 1]
        if ch is None or depth:
            close()
        elif after and after in "*?{":
            close()
        else:
            run += ch
            if after == "+":
                close()
        i += step
        if pattern[i : i + 1] and pattern[i] in "*+?{":
            i = pattern.index("}", i) + 1 if pattern[i] == "{" and "}" in pattern[i:] else i + 1
    close()
    return tuple(dict.fromkeys(found))


def compile_pattern(patterns: str | list[str], options: Options = Options()) -> Pattern:
    """One expression for one or more patterns (a text matches if any of them does)."""
    several = [patterns] if isinstance(patterns, str) else list(patterns)
    if not several or any(p == "" for p in several):
        raise PatternError("empty pattern")
    fold = options.ignore_case or (options.smart_case and not any(c.isupper() for p in several for c in p))
    if not options.fixed:
        for p in several:
            check(p, options)
    bodies = [re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", p) if options.fixed else to_java(p) for p in several]
    body = bodies[0] if len(bodies) == 1 else "|".join(f"(?:{b})" for b in bodies)
    ascii_only = not options.unicode or "(?-u)" in body
    flags = "d" + ("i" if fold else "") + ("" if ascii_only else "U") + ("u" if fold and not ascii_only else "")
    flags += ("m" if options.multiline else "") + ("s" if options.dotall else "")
    body = body.replace("(?-u)", "")
    if options.word:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    if options.line:
        body = rf"\A(?:{body})\z" if not options.multiline else rf"^(?:{body})$"
    only = several[0] if len(several) == 1 else None
    simple = options.fixed and not (fold or options.word or options.line)
    known = () if fold or only is None else ((only,) if options.fixed else literals(only))
    return Pattern(f"(?{flags}){body}", known, only if simple else None, any(_BACKTRACKING.search(p) for p in several) and not options.fixed, options)


def to_replacement(text: str) -> str:
    """``$1``, ``${1}``, ``$name`` and ``${name}`` in Java's terms; other backslashes are plain."""
    out = text.replace("\\", "\\\\")
    out = re.sub(r"\$\{(\d+)\}", r"$\1", out)
    return re.sub(r"\$([A-Za-z_]\w*)", r"${\1}", out)
