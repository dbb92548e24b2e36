"""Secret scans with a random forest against false positives (operator 5).

Candidates are found by shape, whatever their length: known key formats, quoted values of assignments,
unquoted ones after secret names, and long runs of key characters that carry digits. Each gets its length,
character transitions (between kinds, and how likely those between letters are in the dictionary's words),
the share of it that words of a dictionary cover, features of its path (folders and endings that tell, its
language) and of the words around it. A forest trained
on labelled findings then decides.

The dictionary is the words of a public vocabulary, the same for every corpus (``dictionary``). The path
of a document is its source, id and language, as the search operators name it (``path_of``).

``learn`` takes a table of labelled findings (candidate, left and right context, path, label).
``synthetic_findings`` makes the production set: secrets of documented formats and look-alikes
(hashes in listings, identifiers, words, numbers), drawn from a fixed seed; so no corpus row is
learnt from and the model is the same at every size.

Defined cases: null and empty texts have no findings; null paths are empty ones; candidates may
overlap, and secrets that do are joined to one span with the highest score; repeated rows are scanned each; other columns are kept
by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.common import hash_sample, small_batches

THRESHOLD = 0.5
TREES, DEPTH, LEAF = 40, 9, 3
MARK = "[SECRET]"
CONTEXT = 48
#: Labelled findings learnt from, about.
FINDINGS = 20_000

#: Published key formats. Fixed values.
FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{36,}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}",
    r"sk[-_](?:live[-_]|test[-_]|proj-)?[0-9A-Za-z]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}(?:\.[0-9A-Za-z_-]*)?",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----)?",
)
KNOWN = re.compile("|".join(FORMATS))
#: ... and any value of a quoted assignment, or a long run of key characters with a digit. Runs have no
#: upper bound; possessive, and begun only at a run's start, they stay linear.
ASSIGNED = r"""(?<=[=:]\s["'])[0-9A-Za-z+/_\-.~!@#$%^&*]{8,}+(?=["'])|(?<=[=:]["'])[0-9A-Za-z+/_\-.~!@#$%^&*]{8,}+(?=["'])"""
BARE = r"(?<![0-9A-Za-z+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[0-9A-Za-z+/_\-]{16,}+={0,2}"
SHAPED = re.compile(ASSIGNED + "|" + BARE)
#: ... and unquoted values; ``candidates`` keeps those after a name that holds one of NAMES.
UNQUOTED = re.compile(r"(?::=|=>|[=:])[ \t]*+(?P<value>[0-9A-Za-z+/_\-.~!@#$%^&*]{8,}+={0,2})")
NAMES = ("token", "secret", "key", "passw", "pwd", "auth", "credential", "bearer", "api", "private", "signing")
DECOYS = ("example", "dummy", "sample", "test", "placeholder", "sha", "md5", "hash", "commit", "checksum", "digest", "uuid", "version", "id")
#: Words of paths whose findings are mostly look-alikes, and mostly secrets; endings of languages. Fixed values.
HARMLESS = re.compile(r"(?:^|[^a-z])(?:tests?|spec|examples?|docs?|fixtures?|samples?|vendor|node_modules|lock)(?:[^a-z]|$)")
TELLING = re.compile(r"(?:^|[^a-z])(?:env|config|conf|settings|secrets?|credentials?|deploy|prod|ini|ya?ml|properties|pem|tfvars)(?:[^a-z]|$)")
CODE = re.compile(r"\.(?:py|js|ts|go|rs|java|rb|c|cpp|php|sh)$")
PROSE = re.compile(r"\.(?:en|fr|de|es|md|txt|rst|html)$")
SHORTEST_WORD, LONGEST_WORD = 4, 16

N_FEATURES = 32


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


@lru_cache(maxsize=1)
def dictionary() -> frozenset[str]:
    """Words of SHORTEST_WORD to LONGEST_WORD plain letters of the public vocabulary, as they begin in it."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    words = (p[1:].lower() for p in pieces if p.startswith("▁"))
    return frozenset(w for w in words if re.fullmatch(f"[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}", w))


@lru_cache(maxsize=2)
def transitions(words: frozenset[str]) -> list[list[float]]:
    """Log-likelihood of each letter after each other in ``words``; unseen ones count as seen once."""
    n = [[1.0] * 26 for _ in range(26)]
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            n[ord(a) - 97][ord(b) - 97] += 1
    return [[math.log(x / sum(row)) for x in row] for row in n]


def fluency(low: str, words: frozenset[str]) -> float:
    """Mean log-likelihood of the transitions between plain letters in ``low``; of none, an even draw's."""
    table = transitions(words)
    own = [table[ord(a) - 97][ord(b) - 97] for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    return sum(own) / len(own) if own else -math.log(26)


def coverage(low: str, words: frozenset[str]) -> float:
    """The largest share of ``low`` (small letters) that words without overlaps can cover."""
    best = [0] * (len(low) + 1)
    run = 0
    for i in range(1, len(low) + 1):
        run = run + 1 if "a" <= low[i - 1] <= "z" else 0
        most = best[i - 1]
        for k in range(SHORTEST_WORD, min(run, LONGEST_WORD) + 1):
            if best[i - k] + k > most and low[i - k : i] in words:
                most = best[i - k] + k
        best[i] = most
    return best[-1] / max(1, len(low))


def path_of(source, doc_id, lang) -> str:
    return f"{source or ''}/{'' if doc_id is None else doc_id}" + (f".{lang}" if lang else "")


def features(text: str, left: str, right: str, path: str, words: frozenset[str] | None = None) -> list[float]:
    n = max(1, len(text))
    kinds = [_kind(c) for c in text]
    share = [kinds.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    counts = [text.count(c) for c in set(text)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    low = text.lower()
    pairs = [low[i : i + 2] for i in range(len(low) - 1)]
    letters = [p for p in pairs if p.isalpha()]
    words = dictionary() if words is None else words
    covered = coverage(low, words)
    longest = max((len(m) for m in re.findall("[a-z]+", low)), default=0)
    digits = max((len(m) for m in re.findall("[0-9]+", low)), default=0)
    before, after = left.lower(), right.lower()
    near = re.findall(r"[a-z0-9_]+", before)[-3:]
    named = any(k in w for w in near for k in NAMES)
    decoy = any(w == d or w.startswith(d) for w in near for d in DECOYS)
    where = path.lower()
    first = re.match(r"\s*[\"']?\s*(\w*)", after)
    return [
        len(text), math.log(n), *share, moves, entropy, entropy / math.log2(n + 1), covered, len(letters) / max(1, len(pairs)), longest / n, digits / n, len(set(text)) / n,
        float(re.fullmatch("[0-9a-f]+", text) is not None), float(re.fullmatch("[0-9a-fA-F-]{36}", text) is not None), float(KNOWN.fullmatch(text) is not None),
        float(len(text) % 4 == 0), float(text.endswith("=")), float(text.count("/") > 1), float(text.count("-") + text.count("_") > 2),
        float(named), float(decoy), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""), float(after[:1] in "\"'" and after != ""),
        float(len(first[1]) if first else 0), fluency(low, words), *(float(p.search(where) is not None) for p in (HARMLESS, TELLING, CODE, PROSE)),
    ]


class Forest:
    """Binary trees on bootstrap samples, each split over a few features drawn at random; nodes are
    flat arrays, so scoring a batch walks all its rows down a tree at once."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 5) -> Forest:
        rng = np.random.Generator(np.random.PCG64(seed))
        out = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            cls._grow(x[rows], y[rows].astype(float), depth, leaf, rng, nodes)
            a = np.array(nodes)
            out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return cls(out)

    @classmethod
    def _grow(cls, x, y, depth, leaf, rng, nodes) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, y.mean()])
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return at
        best = (1e-9, 0, 0.0)
        whole = len(y) * y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            i = np.flatnonzero(v[1:] > v[:-1]) + 1
            i = i[(i >= leaf) & (i <= len(y) - leaf)]
            if not len(i):
                continue
            a, b = s[i - 1], s[-1] - s[i - 1]
            gain = whole - a * (1 - a / i) - b * (1 - b / (len(y) - i))
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, (v[i[k]] + v[i[k] - 1]) / 2)
        if best[0] > 1e-9:
            _, f, cut = best
            low = x[:, f] <= cut
            left = cls._grow(x[low], y[low], depth - 1, leaf, rng, nodes)
            right = cls._grow(x[~low], y[~low], depth - 1, leaf, rng, nodes)
            nodes[at] = [f, cut, left, right, nodes[at][4]]
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while True:
                step = np.where(x[np.arange(len(x)), f[at]] <= cut[at], left[at], right[at])
                if (step == at).all():
                    break
                at = step
            total += value[at]
        return total / len(self.trees)


def synthetic_findings(n: int = 6000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """(candidate, left, right, path, label), half of them secrets."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda s, k: "".join(r.choice(s) for _ in range(k))
    parts = "th er in an re on he ou en ti at nd le de la que ment tion ing ion est ver sch der".split()
    known = sorted(dictionary())
    # dictionary words, and invented ones: texts have both
    word = lambda k=3: r.choice(known) if r.random() < 0.5 else "".join(r.choice(parts) for _ in range(r.randint(1, k)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    plain = lambda: f"src{r.randint(0, 30)}/{r.randint(0, 10**6)}.{r.choice(['en', 'fr', 'de', 'es', 'py', 'js'])}"
    harmless = lambda: f"{r.choice(['tests', 'docs', 'examples', 'vendor', 'fixtures', 'src/test', 'spec'])}/{r.choice(known)}.{r.choice(['py', 'js', 'md', 'txt', 'lock', 'en'])}"
    telling = lambda: f"{r.choice(['config', 'deploy', 'settings', 'prod', 'app', 'src'])}/{r.choice(known)}.{r.choice(['env', 'yml', 'ini', 'properties', 'tfvars', 'pem'])}"

    def path(label: int) -> str:
        """Half are plain; the others tell the label of most."""
        if r.random() < 0.5:
            return plain()
        return telling() if r.random() < (0.96 if label else 0.25) else harmless()

    keys = (
        lambda: "AKIA" + of(up + dig, 16), lambda: "ghp_" + of(low + up + dig, 36), lambda: "sk-" + of(low + up + dig, r.choice([24, 32, 48])), lambda: "AIza" + of(low + up + dig + "_-", 35),
        lambda: "xoxb-" + of(dig, 11) + "-" + of(low + up + dig, 24), lambda: of("0123456789abcdef", r.choice([32, 40, 64])), lambda: of(low + up + dig + "+/", r.choice([32, 40, 44])),
        lambda: of(low + up + dig, r.randint(16, 40)), lambda: "eyJ" + of(low + up + dig, 20) + "." + of(low + up + dig, 40), lambda: of(low + up + dig + "!@#$%^&*", r.randint(10, 20)),
        lambda: "-----BEGIN RSA PRIVATE KEY-----", lambda: of(low + up + dig + "+/", r.choice([300, 344, 512, 1024])),
    )
    names = ("token", "api_key", "secret", "password", "auth_token", "SECRET_KEY", "aws_secret_access_key", "private_key", "bearer", "pwd", "client_secret", "key")
    out = []
    for _ in range(n // 2):
        kind = r.randrange(len(keys))
        text = keys[kind]()
        if r.random() < 0.75 or kind >= 5 and kind != 8 and kind != 10:
            q = r.choice(['"', "'", '"'])
            left, right = f"{prose()} {r.choice(names)}{r.choice([' = ', '=', ': '])}{q}", f"{q} {prose()}"
            if r.random() < 0.3:
                left, right = f"{prose()} {r.choice(names)}=", r.choice([" ", "\n"]) + prose()
                if r.random() < 0.5:
                    text = r.choice([lambda: word(4) + word(4) + word(4), lambda: word(2) + of(dig, 3) + word(2) + of(dig, 3)])()
        else:
            left, right = prose() + " ", r.choice(["", "### ", "*** "]) + " " + prose()
        out.append((text, left, right, path(1), 1))
        d = r.randrange(13)
        if d == 0:
            text, left = of("0123456789abcdef", r.choice([32, 40, 64])), f"{prose()} {r.choice(['sha256', 'commit', 'md5', 'checksum', 'digest'])}{r.choice([' ', ': ', '='])}"
        elif d == 1:
            text, left = "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), f"{prose()} {r.choice(['id', 'uuid', 'request'])}{r.choice([' ', ': '])}"
        elif d == 2:
            text, left = of(dig, r.randint(16, 24)), prose() + " "
        elif d == 3:
            text, left = "_".join(word(2) for _ in range(4)) + of(dig, 2), prose() + " "
        elif d == 4:
            text, left = "/".join(word(2) for _ in range(4)) + "/" + of(dig, 3), prose() + " "
        elif d == 5:
            text, left = word(6) + word(6) + of(dig, 1), prose() + " "
        elif d == 6:
            text, left = r.choice(["example", "your", "dummy", "test"]) + "_" + r.choice(names) + "_" + r.choice(["here", "123", "value"]), f'{prose()} {r.choice(names)} = "'
        elif d == 7:
            text, left = word(4) + "-" + word(4), f'{prose()} {r.choice(["class", "href", "name", "title", "lang", "ref"])}="'
        elif d == 8:
            text, left = of(dig, 4) + "-" + of(dig, 2) + "-" + of(dig, 2) + "T" + of(dig, 2), prose() + " "
        elif d == 9:
            text, left = word(3) + word(3), f"{prose()} {r.choice([*names, 'author', 'keyword', 'capital'])}: "
        elif d == 10:
            text, left = r.choice(["get", "load", "os.", "self.", "config."]) + word(2) + r.choice(["_", "."]) + word(2), f"{prose()} {r.choice(names)} = "
        elif d == 11:  # made-up keys of tests and examples: their path alone tells
            text, left = keys[r.choice([5, 6, 7, 9])](), f'{prose()} {r.choice(names)}{r.choice([" = ", "=", ": "])}"'
        else:
            text, left = "".join(of(low + up, r.randint(1, 3)) + word(2) for _ in range(4)) + of(dig, 1), prose() + " "
        out.append((text, left, ('"' if left.endswith('"') else "") + " " + prose(), harmless() if d == 11 else path(0), 0))
    return out


def learn(findings: DataFrame, sample: int = FINDINGS) -> Forest:
    """A forest from a table of labelled findings: candidate, before, after, path (texts) and label (0, 1). At most
    1.25 times ``sample`` of them, by the hashes of the candidates; nulls are empty texts, rows without label are left out."""
    names = ("candidate", "before", "after", "path")
    rows = hash_sample(findings.where("label is not null"), sample, "candidate", "before").select(*names, "label").collect()
    rows = sorted((*(r[k] or "" for k in names), int(r["label"])) for r in rows)
    return Forest.fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows]))


@lru_cache(maxsize=1)
def production_forest() -> Forest:
    rows = synthetic_findings()
    return Forest.fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows]))


#: Every candidate has a digit, a sign of assignment or the beginning of a key format in it or before it.
_HINT = re.compile(r"[0-9=:]|PRIVATE KEY|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ")


def _name_before(text: str, end: int) -> str:
    """The name that an assignment's sign at ``end`` follows."""
    while end and text[end - 1] in " \t\"'":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-."):
        start -= 1
    return text[start:end].lower()


def candidates(text: str) -> list[tuple[int, int]]:
    """Distinct character spans, in order. A key format inside a longer run is a candidate besides it."""
    if not _HINT.search(text):
        return []
    spans = {m.span() for p in (KNOWN, SHAPED) for m in p.finditer(text)}
    for m in UNQUOTED.finditer(text):
        name = _name_before(text, m.start())
        if any(k in name for k in NAMES):
            spans.add(m.span("value"))
    return sorted(spans)


def find(texts: list[str], paths: list[str], forest: Forest, threshold: float, words: frozenset[str] | None = None) -> tuple[list[list[tuple[int, int, float]]], list[int]]:
    """Spans and scores of what the forest takes for secrets, text by text; how many candidates each has."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    where, rows, n = [], [], []
    for i, (text, path) in enumerate(zip(texts, paths, strict=True)):
        met = candidates(text)
        n.append(len(met))
        for a, b in met:
            where.append((i, a, b))
            rows.append(features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path, words))
    if rows:
        for (i, a, b), s in zip(where, forest.score(np.array(rows)), strict=True):
            if s >= threshold:
                if out[i] and a < out[i][-1][1]:
                    begin, end, score = out[i].pop()
                    out[i].append((begin, max(b, end), max(float(s), score)))
                else:
                    out[i].append((a, b, float(s)))
    return out, n


def byte_spans(text: str, found: list[tuple[int, int, float]]) -> list[dict]:
    """Spans in order, in bytes; each byte is counted once."""
    out, at, behind = [], 0, 0
    for s, e, p in found:
        begin = behind + len(text[at:s].encode())
        at, behind = e, begin + len(text[s:e].encode())
        out.append({"begin": begin, "end": behind, "score": round(p, 9)})
    return out


def _columns(b: pa.RecordBatch, names: list[str]) -> tuple[list[str], list[str]]:
    """Texts and paths of a batch whose columns are ``names``; what a path lacks is left out of it."""
    values = lambda c: b.column(names.index(c)).to_pylist() if c in names else [None] * len(b)
    return [x or "" for x in values("text")], [path_of(*x) for x in zip(values("source"), values("doc_id"), values("lang"), strict=True)]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (byte begin and end, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((forest or production_forest(), dictionary()))
    names = ["doc_id", "text", *[c for c in ("source", "lang") if c in docs.columns]]
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            texts, paths = _columns(b, names)
            found, n = find(texts, paths, shared.value[0], threshold, shared.value[1])
            spans = [byte_spans(*x) for x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, kind)], ["doc_id", "n_candidates", "n_secrets", "spans"])

    return small_batches(docs.select(*names)).mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, spans array<struct<begin:int,end:int,score:double>>")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret replaced by MARK; all rows and columns stay. ``n_chars`` follows."""
    shared = docs.sparkSession.sparkContext.broadcast((forest or production_forest(), dictionary()))
    text = docs.columns.index("text")
    names = docs.columns
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            texts, paths = _columns(b, names)
            old, changed = b.column(text), {}
            for i, found in enumerate(find(texts, paths, shared.value[0], threshold, shared.value[1])[0]):
                if found:
                    t, parts, at = texts[i], [], 0
                    for s, e, _ in found:
                        parts += [t[at:s], MARK]
                        at = e
                    changed[i] = "".join([*parts, t[at:]])
            columns = list(b.columns)
            if changed:
                columns[text] = pa.array([changed.get(i, v) for i, v in enumerate(old.to_pylist())], old.type)
                if size is not None:
                    columns[size] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(b.column(size).to_pylist())], b.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    out = small_batches(docs).mapInArrow(run, ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)))
    return out.toDF(*docs.columns)
