"""Small trees with known answers, in the manner of the reference's binding tests."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.patterns import Options, PatternError, UnsupportedPattern, compile_pattern, literals
from siftline.operators import aggregate, index, search
from siftline.plans import charter
from siftline.plans.cursor import Cursor, push
from siftline.plans.request import SearchRequest, exit_code
from siftline.sources import corpus

TREE = {
    "a.py": "def alpha():\n    return TODO + TODO\n",
    "b.py": "class Beta:\n    pass  # TODO later\n",
    "c.txt": "nothing\n",
    "unicode.txt": "CAFÉ\ncafé\n",
    "pkg/d.py": "x = 1  # todo lowercase\nTODO upper\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    return corpus.from_texts(spark, TREE).cache()


def test_counts(tree):
    todo = SearchRequest("TODO")
    assert todo.count(tree) == 3
    assert todo.count_matches(tree) == 4
    assert SearchRequest("TODO", ignore_case=True).count(tree) == 4
    assert "c.txt" not in {r.path for r in todo.files(tree).collect()}
    assert SearchRequest("CAFÉ", ignore_case=True).count(tree) == 2
    assert SearchRequest("CAFÉ", ignore_case=True, unicode=False).count(tree) == 1
    spans = SearchRequest("def alpha.*TODO", multiline_dotall=True).lines(tree).collect()
    assert len(spans) == 1 and "\n" in spans[0].text and (spans[0].first_line, spans[0].last_line) == (1, 2)
    assert SearchRequest("zzz").absent(tree) and not todo.absent(tree)


@pytest.mark.parametrize("bad", ["[abc", "a{2,1}", r"a\1", ")("])
def test_malformed(spark, bad):
    for engine in ("linear", "auto", "backtracking"):
        with pytest.raises(PatternError):
            compile_pattern(bad, Options(engine=engine))


def test_unsupported(spark, tree):
    with pytest.raises(UnsupportedPattern):
        compile_pattern("(?<=return )TODO", Options(engine="linear"))
    assert SearchRequest("(?<=return )TODO").count(tree) == 1
    with pytest.raises(PatternError):
        compile_pattern("")


@pytest.mark.parametrize(
    ("pattern", "line", "spans"),
    [
        ("a*", "abc", [(0, 1), (2, 2), (3, 3)]),
        ("a*", "abcab", [(0, 1), (2, 2), (3, 4), (5, 5)]),
        ("a*", "bbb", [(0, 0), (1, 1), (2, 2), (3, 3)]),
        (r"\b", "hi yo", [(0, 0), (2, 2), (3, 3), (5, 5)]),
        (r"\w+", "é ab", [(0, 2), (3, 5)]),
        ("a+", "baac", [(1, 3)]),
    ],
)
def test_spans(spark, pattern, line, spans):
    got = spark.createDataFrame([(line,)], "line string").select(compile_pattern(pattern).spans(F.col("line"))).first()[0]
    assert [(m.start, m.end) for m in got] == spans


def test_tally(spark):
    record = "path string, line_number long, line string, kind string, submatches array<struct<text:string,start:int,end:int>>"
    rows = [("a/x.py", 1, "k", "match", [("T", 0, 1)]), ("a/x.py", 2, "k", "match", [("U", 0, 1)]), ("b/.hid", 1, " z ", "match", []), ("b/y", 1, "q", "context", [])]
    m = spark.createDataFrame(rows, record)
    of = lambda by, n=0: [tuple(r) for r in aggregate.tally(m, by, n).collect()]
    assert of("file") == [("a/x.py", 2, 1), ("b/.hid", 1, 1)]
    assert of("dir") == [("a", 2, 1), ("b", 1, 1)]
    assert of("ext") == [(".py", 2, 1), ("", 1, 1)]
    assert of("match") == [("T", 1, 1), ("U", 1, 1), ("z", 1, 1)]
    assert of(F.upper("path"), 1) == [("A/X.PY", 2, 1)]
    with pytest.raises(ValueError):
        aggregate.tally(m, "nope")


def test_summary_scope_and_rank(spark, tree):
    assert SearchRequest("TODO").summary(tree, "ext").first()[:2] == (".py", 3)
    assert SearchRequest("TODO", types=("py",)).count(tree) == 3
    docs = corpus.from_texts(spark, {"libs/a.py": "def widget():\n    return TODO\n", "libs/pkg/b.py": "x = TODO\nTODO again\n", "gen/c.py": "# do not edit\ndef widget():\n TODO TODO\n TODO\n"})
    best = SearchRequest("TODO").ranked(docs).collect()
    assert best[0].path == "libs/pkg/b.py" and best[0]["count"] == 2 and best[-1].path == "gen/c.py"
    assert SearchRequest("widget").ranked(docs).first().kind == "def"
    with pytest.raises(ValueError):
        SearchRequest("x", context=1).ranked(docs)


def test_paths(spark):
    names = ["a/CMakeLists.txt", "notes.txt", "docs/design/OVERVIEW", "CHANGELOG", "docs/conf.py", "src/main.c", "README.md", "x.json", ".hid/z.py"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kinds = dict(df.select("path", paths.genus(F.col("path"))).collect())
    assert {k for k, v in kinds.items() if v == "docs"} == {"notes.txt", "docs/design/OVERVIEW", "CHANGELOG", "README.md"}
    assert kinds["x.json"] == "data" and kinds["a/CMakeLists.txt"] == "code"
    pick = lambda c: {r.path for r in df.where(c).collect()}
    assert pick(paths.is_hidden(F.col("path"))) == {".hid/z.py"}
    assert pick(paths.in_globs(F.col("path"), ["*.{py,c}", "!docs/**"])) == {"src/main.c", ".hid/z.py"}
    assert pick(paths.ignored(F.col("path"), ["docs/", "*.md", "!README.md"])) == {"docs/design/OVERVIEW", "docs/conf.py"}
    order = [r.path for r in spark.createDataFrame([("w.go",), ("w/x.go",)], "path string").orderBy(paths.by_component(F.col("path"))).collect()]
    assert order == ["w/x.go", "w.go"]
    assert paths.parse_size("4k") == 4096


def test_request_mapping():
    assert SearchRequest.from_tool({"query": "x", "glob": "*.py", "context_lines": 2, "place": 1}) == SearchRequest("x", globs=("*.py",), context=2)
    for bad in ({"pattern": "x", "colour": 1}, {"pattern": ""}):
        with pytest.raises(ValueError):
            SearchRequest.from_tool(bad)


def test_literals_never_lose_a_match():
    draw = random.Random(5)
    parts = ["abc", "token", "x+", "[ab]c", "d?", "(ef)+", "g{2}", r"\.", r"\w", "h*", ".", "^", "lmn{0,2}", "[]x]q"]
    for _ in range(3000):
        pattern = "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
        text = "".join(draw.choice(["abc", "token", "xx", "ac", "bc", "d", "efef", "gg", ".", "h", "lm", "lmnn", "]q", "q"]) for _ in range(draw.randint(1, 6)))
        m = re.search(pattern, text)
        if m:
            assert all(t in m.group() for t in literals(pattern)), pattern


def test_prefiltered_is_unfiltered(spark):
    docs = corpus.documents(spark, "/root/testdata/sf0.001")
    posted = index.postings(docs).cache()
    for text in ('token = "[0-9a-f]+', "License", "the and", "(?i)LICENSE", "éa", "x?"):
        p = compile_pattern(text)
        want = sorted(map(tuple, search.matching_lines(docs, p, prefilter=False).collect()))
        assert sorted(map(tuple, search.matching_lines(docs, p).collect())) == want
        assert sorted(map(tuple, index.search_indexed(docs, posted, p).collect())) == want


def test_index_lifecycle(spark, tmp_path):
    docs = corpus.from_texts(spark, {f"f{i}": f"text {i} alpha\n" for i in range(20)})
    at = f"file://{tmp_path}/ix"
    index.build(docs, at)
    assert index.status(spark, at).first().files_indexed == 20
    assert index.amend(docs, at) == "current"
    new = docs.where("doc_id != 3").withColumn("body", F.when(F.col("doc_id") == 4, "fresh omega\n").otherwise(F.col("body")))
    assert index.amend(new, at) == "amended"
    p = compile_pattern("omega")
    assert [r.path for r in index.search_indexed(new, index.load(spark, at), p).collect()] == [r.path for r in search.matching_lines(new, p).collect()]
    assert index.indexed(spark, at).where("doc_id = 3").isEmpty() and index.amend(new, at) == "current"


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.gz").write_bytes(gzip.compress(b"needle one\n"))
    (tmp_path / "d/b.txt").write_bytes(b"\xff\xfe" + "needle zwei é\n".encode("utf-16-le"))
    (tmp_path / "d/c.bin").write_bytes(b"needle\0\n")
    root = f"file://{tmp_path}/d"
    p = compile_pattern("needle")
    found = lambda **how: search.matching_lines(corpus.files(spark, root, **how), p).count()
    assert found(encoding="auto", decompress=True) == 2
    assert found(encoding="auto", binary="text") == 2
    with pytest.raises(LookupError):
        corpus.decoded("content", "no-such-charset")
    with pytest.raises(Exception):
        corpus.files(spark, root + "/missing").count()


def test_continuous(spark, tmp_path):
    from siftline.streaming import continuous

    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a needle\nb", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(src)
    q = continuous.continuous_matches(continuous.watch(spark, src), compile_pattern("needle")).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("hits").collect()] == [("s/1.en", 1, "a needle")]


def test_requests_heed_every_option(spark):
    docs = corpus.from_texts(spark, {"a.txt": "hit one\nno\nhit two\nno\nno\nhit\r\n", "b.txt": "hit\n", "z\x00": "hit\0hit\nx\0no\0"})
    rows = lambda r, *c: sorted(tuple(x[k] for k in c) for x in r.collect())
    only_a = {"globs": ("a.txt",)}
    assert rows(SearchRequest("hit", invert=True, **only_a).records(docs), "line_number", "submatches") == [(2, []), (4, []), (5, [])]
    assert rows(SearchRequest("hit", invert=True, after=1, max_count=1, **only_a).lines(docs), "line_number", "kind") == [(2, "match"), (3, "context")]
    assert rows(SearchRequest("hit", invert=True).files(docs), "path") == [("a.txt",), ("z\0",)]
    assert rows(SearchRequest("hit", invert=True).files_without(docs), "path") == [("b.txt",)]
    assert SearchRequest("hit", max_count=2, **only_a).count(docs) == 2 and SearchRequest("hit", invert=True, **only_a).count_matches(docs) == 3
    assert SearchRequest("hit$", **only_a).count(docs) == 0 and SearchRequest("hit$", crlf=True, **only_a).count(docs) == 1
    assert rows(SearchRequest("hit", null_data=True, globs=("z*",)).lines(docs), "line_number", "line") == [(1, "hit"), (2, "hit\nx")]
    assert rows(SearchRequest("hit", skip_binary=True).files(docs), "path") == [("a.txt",), ("b.txt",)]
    assert [r.path for r in SearchRequest("hit", sort="path", reverse=True, max_results=2).files(docs).collect()] == ["z\0", "b.txt"]
    assert SearchRequest("hit", max_count=0).absent(docs) and exit_code(SearchRequest("hit"), docs) == 0
    for bad in ({"multiline": True, "invert": True}, {"multiline": True, "context": 1}, {"sort": "size"}, {"sort": "modified"}):
        with pytest.raises(ValueError):
            SearchRequest("hit", **bad).lines(docs)
    with pytest.raises(ValueError):
        SearchRequest("hit", null_data=True, multiline=True)


def test_json_stream(spark, tree):
    got = sorted((r.path or "~", r.seq, json.loads(r.value)) for r in SearchRequest("TODO", context=1).json(tree).collect())
    a = [v for path, _, v in got if path == "a.py"]
    assert [v["type"] for v in a] == ["begin", "context", "match", "end"]
    assert a[2]["data"]["submatches"][0] == {"text": "TODO", "start": 11, "end": 15} and a[3]["data"] == {"path": "a.py", "matched_lines": 1, "matches": 2}
    assert got[-1][2] == {"type": "summary", "data": {"files": 3, "matched_lines": 3, "matches": 4}}


def test_formatted(spark):
    rows = spark.createDataFrame([("a/b", 1, "  " + "x" * 9, "match"), ("a/b", 2, "y", "context")], "path string, line_number long, line string, kind string")
    of = lambda **how: [r.value for r in search.formatted(rows, **how).collect()]
    assert of() == ["a/b:1:  xxxxxxxxx", "a/b-2-y"]
    assert of(trim=True, max_columns=4, preview=True, path_separator="\\", number=False) == ["a\\b:xxxx [... more]", "a\\b-y"]
    assert of(with_path=False, max_columns=4) == ["1:[Omitted long line]", "2-y"] and of(null=True)[1] == "a/b\x002-y"


def test_ignore_tree(spark):
    docs = corpus.from_texts(spark, {".gitignore": "*.log\nbuild/\n# note\n", ".ignore": "!keep.log\n", "sub/.gitignore": "!in.log\n/top.txt\n", "a.log": "", "keep.log": "", "sub/in.log": "", "sub/out.log": "", "sub/top.txt": "", "sub/d/top.txt": "", "build/in.log": "", "build/keep.log": "", "x/build": ""})
    tree = corpus.ignore_tree(docs)
    seen = {r.path for r in SearchRequest("x", ignore_tree=tree).listing(docs).collect()}
    assert seen == {"keep.log", "sub/in.log", "sub/d/top.txt", "x/build"}
    assert SearchRequest("x", ignore_tree=tree, no_ignore=True).listing(docs).count() == 9
    assert "a.log" in {r.path for r in SearchRequest("x", ignore_tree=tree, globs=("*.log",)).listing(docs).collect()}


def test_type_registry():
    assert paths.registry(("x:*.x", "x:include:py,go"), ())["x"] == ("*.x", "*.py", "*.pyi", "*.go")
    assert "go" not in paths.registry((), ("go",))
    for bad in ("x", "x:", ":*.x", "all:*.x", "x:include:nope"):
        with pytest.raises(ValueError):
            paths.registry((bad,))


def test_charter():
    c = charter.parse('roots = ["src"]\nskip = ["vendor/"]\ntypes = ["x:*.x"]\n')
    assert charter.parse(c.to_toml()) == c
    r = c.apply(SearchRequest("q", ignore_rules=("*.log",)))
    assert r.paths == ("src",) and r.ignore_rules == ("*.log", "vendor/") and r.type_add == ("x:*.x",)
    assert c.apply(SearchRequest("q", paths=("lib",))).paths == ("lib",)
    assert [len(charter.problems(t)) for t in ("roots = 1", "colour = []", "types = ['x']", "= ", "")] == [1, 1, 1, 1, 0]


def test_cursor(spark):
    rows = spark.range(0, 1000, 1, 8)
    with Cursor(rows, max_results=10) as c:
        assert len(c.batch(4)) == 4 and len(c.batch(100)) == 6 and c.matched and c.stopped == "max_results"
    with Cursor(rows.limit(3), max_results=3) as c:
        assert len(list(c)) == 3 and c.stopped == "end"
    with Cursor(rows.where("id < 0")) as c:
        assert not list(c) and not c.matched and c.stopped == "end"
    slow = rows.select(F.expr("java_method('java.lang.Thread', 'sleep', 20L)").alias("x"))
    with Cursor(slow, timeout=0.5) as c:
        list(c)
        assert c.stopped == "timeout"
    seen = []
    assert push(rows, lambda r: seen.append(r.id) or len(seen) == 5) == "cancelled" and seen == [0, 1, 2, 3, 4]
    assert rows.count() == 1000  # others' jobs go on


def test_stale_index_gives_current_answers(spark, tmp_path):
    docs = corpus.from_texts(spark, {f"f{i}": f"text {i} alpha\n" for i in range(12)})
    at, p = f"file://{tmp_path}/ix", compile_pattern("alpha")
    index.build(docs, at)
    assert index.staleness(docs, at).first()[:2] == (12, 0)
    assert index.kept(docs, at, p).count() == 12 and index.kept(docs, at, p).count() == 12
    new = docs.where("doc_id > 2").withColumn("body", F.when(F.col("doc_id") == 5, "alpha alpha\nalpha\n").when(F.col("doc_id") == 6, "none").otherwise(F.col("body")))
    want = sorted(map(tuple, search.matching_lines(new, p).collect()))
    assert sorted(map(tuple, index.search_fresh(new, at, p).collect())) == want == sorted(map(tuple, index.kept(new, at, p).collect()))
    assert index.staleness(new, at).first().stale_files == 5


def test_preprocessor(spark, tmp_path):
    import gzip

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.up").write_bytes(b"needle\n")
    (tmp_path / "d/b.gz").write_bytes(gzip.compress(b"needle\n"))
    docs = corpus.files(spark, f"file://{tmp_path}/d", decompress=True, pre=bytes.upper, pre_globs=("*.up",))
    assert sorted(r.body for r in docs.collect()) == ["NEEDLE\n", "needle\n"]


def test_zstd_of_several_frames(spark, tmp_path):
    import struct

    import zstandard

    first, second = (zstandard.ZstdCompressor().compress(x) for x in (b"first line\n", b"second line\n"))
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    samples = [f"record {i} of the same kind, number {i * i}\n".encode() * 4 for i in range(500)]
    trained = zstandard.train_dictionary(2000, samples)
    packed = [zstandard.ZstdCompressor(dict_data=trained).compress(x) for x in samples[:2]]
    lead = struct.pack("<II", 0x184D2A5D, len(trained.as_bytes())) + trained.as_bytes()
    (tmp_path / "two.zst").write_bytes(first + second)
    (tmp_path / "led.zst").write_bytes(skip + first + skip + second)
    (tmp_path / "archive.zst").write_bytes(lead + b"".join(packed))
    got = {r.path.rsplit("/", 1)[1]: r.body for r in corpus.files(spark, str(tmp_path), decompress=True).collect()}
    assert got == {"two.zst": "first line\nsecond line\n", "led.zst": "first line\nsecond line\n", "archive.zst": b"".join(samples[:2]).decode()}


def test_replacement_keeps_what_stands_around(spark):
    docs = corpus.from_texts(spark, {"a": "MIT License, BSD License\nxay\n"})
    assert [r.text for r in search.only_matching(docs, compile_pattern("(?<=MIT )License"), "X").collect()] == ["X"]
    assert [(r.text, r.start, r.end) for r in search.only_matching(docs, compile_pattern("(a)(?=y)"), "<$1>").collect()] == [("<a>", 1, 2)]


def test_which_patterns_can_be_empty():
    from siftline.functions.patterns import _can_be_empty

    assert not any(map(_can_be_empty, ["(?d)[a-z]+ing", r"(?dU)\p{Lu}\p{IsLatin}x*", r"(?d)(?<k>a)\k<k>", "(?d)(?<=x)a|b", "(?d)e++r", r"(?d)^ab?$", r"(?d)(?<!\w)(?:the)(?!\w)"]))
    assert all(map(_can_be_empty, ["(?d)a*", r"(?d)\b", "(?d)(?=x)", "(?d)a|", "(?d)^$", r"(?d)\R"]))


def test_nested_quantifiers_are_not_linear(spark):
    for bad in ("(a+)+", "x(?:[ab]*)*y", "(a{1,}){2,}"):
        with pytest.raises(UnsupportedPattern):
            compile_pattern(bad, Options(engine="linear"))
        compile_pattern(bad)
    for good in (r"(a\+)+", "[+)]+", "(ab)+", "(a+)?", "(a+)b+"):
        compile_pattern(good, Options(engine="linear"))


def test_requests_from_tools_and_exit_codes(spark, tree):
    assert SearchRequest.from_tool({"query": "TODO", "types": "py", "glob": "*.py", "paths": ["pkg"]}).files(tree).collect()[0].path == "pkg/d.py"
    with pytest.raises(ValueError):
        SearchRequest.from_tool({"query": "x", "nonsense": 1})
    assert [exit_code(SearchRequest(p), tree) for p in ("TODO", "zzqq", "[abc")] == [0, 1, 2]


def test_tally_get_and_total(tree):
    t = SearchRequest("TODO").summary(tree)
    assert aggregate.total(t) == 3 and aggregate.get(t, "b.py") == 1 and aggregate.get(t, "none") == 0


def test_headings_and_budget(tree):
    rows = SearchRequest("TODO").lines(tree)
    shown = [r.value for r in search.headed(rows).orderBy("path", "seq").collect()]
    assert shown[:2] == ["a.py", "2:    return TODO + TODO"] and len(shown) == 6
    first = search.headed(rows).orderBy("path", "seq").collect()
    size = sum(len(r.value) + 1 for r in first[:3])
    assert [r.value for r in search.within_budget(search.headed(rows), size).orderBy("path", "seq").collect()] == shown[:3]
    assert search.within_budget(search.headed(rows), 3).isEmpty()


def test_followed_documents_are_found(spark, tmp_path):
    from siftline.streaming import continuous

    spark.createDataFrame([(i, f"words {i} omega\n", "en", "s", 3) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/in")
    at, p = f"file://{tmp_path}/ix", compile_pattern("omega")
    for built in (False, True):  # additions alone, and beside a generation
        if built:
            index.build(corpus.from_texts(spark, {"z": "older omega\n"}).withColumn("doc_id", F.lit(99).cast("long")), at)
        stream = continuous.follow(continuous.watch(spark, f"file://{tmp_path}/in", 2), at, f"file://{tmp_path}/cp{built}")
        stream.processAllAvailable()
        stream.stop()
        assert {r.doc_id for r in index.candidates(index.load(spark, at), p).collect()} == set(range(6)) | ({99} if built else set())
        assert index.status(spark, at).first().files_indexed == 6 + built and index.status(spark, at).first().bytes > 0


def test_known_times_and_lengths_are_not_read_again(spark, tmp_path):
    docs = corpus.from_texts(spark, {f"f{i}": f"text {i}\n" for i in range(8)}).withColumn("modified", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    at = f"file://{tmp_path}/ix"
    index.build(docs, at)
    # the same time and length: taken for unchanged; another time: hashed
    sly = docs.withColumn("body", F.when(F.col("doc_id") == 1, "TEXT 1\n").otherwise(F.col("body")))
    assert index.drift(sly, at)[0].count() == 0
    touched = docs.withColumn("modified", F.expr("timestamp'2024-02-02 00:00:00'"))
    assert index.drift(touched, at)[0].count() == 0
    assert [r.doc_id for r in index.drift(touched.withColumn("body", F.when(F.col("doc_id") == 1, "TEXT 1\n").otherwise(F.col("body"))), at)[0].collect()] == [1]


def test_rank_keeps_its_promises(spark):
    trees = {"lib/a.py": "def widget():\n    return 1\n", "lib/b.py": "x = widget()\nwidget()\n", "lib/gen/c.py": "def widget(): pass\nwidget widget\nwidget\n", "third_party/d.py": "def widget():\n", "e.txt": "nothing\n", "deep/er/f.py": "y = widget(1)\n"}
    docs, p = corpus.from_texts(spark, trees), compile_pattern("widget")
    got = SearchRequest("widget").ranked(docs, 20).collect()
    assert {r.path for r in got} == {r.path for r in search.files_with(docs, p).collect()} and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    place = {r.path: r["rank"] for r in got}
    assert place["lib/a.py"] == 1 and got[0].kind == "def"
    assert max(place["lib/b.py"], place["deep/er/f.py"]) < min(place["lib/gen/c.py"], place["third_party/d.py"])
    assert [tuple(r) for r in SearchRequest("widget").ranked(docs, 2).collect()] == [tuple(r) for r in got[:2]]


def test_ignore_sources(spark):
    docs = corpus.from_texts(spark, {".git/info/exclude": "*.log\n", "sub/.gitignore": "!keep.log\n*.tmp\n", ".ignore": "*.bak\n", "a.log": "x", "sub/keep.log": "x", "sub/a.tmp": "x", "b.bak": "x", "c.txt": "x", "d.glob": "x"})
    def seen(tree, **more):
        return {r.path for r in SearchRequest("x", ignore_tree=tree, **more).listing(docs).collect()}
    plain = {"sub/keep.log", "c.txt", "d.glob"}
    assert seen(corpus.ignore_tree(docs)) == plain
    assert seen(corpus.ignore_tree(docs, everywhere=("*.glob",))) == plain - {"d.glob"}
    assert seen(corpus.ignore_tree(docs, exclude=False)) == plain | {"a.log"}
    assert seen(corpus.ignore_tree(docs, vcs=False)) == plain | {"a.log", "sub/a.tmp"}
    assert seen(corpus.ignore_tree(docs, dot=False)) == plain | {"b.bak"}
    assert len(seen(corpus.ignore_tree(docs), unrestricted=1)) == 6 and len(seen(corpus.ignore_tree(docs), unrestricted=2)) == 9


def test_lz4_and_brotli(spark, tmp_path):
    import pyarrow as pa

    for codec, name in (("lz4", "a.lz4"), ("brotli", "b.txt.br")):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, codec) as out:
            out.write(b"needle\n")
        (tmp_path / name).write_bytes(sink.getvalue().to_pybytes())
    (tmp_path / "plain.br").write_bytes(b"not packed\n")
    assert sorted(r.body for r in corpus.files(spark, f"file://{tmp_path}", decompress=True).collect()) == ["needle\n", "needle\n", "not packed\n"]
