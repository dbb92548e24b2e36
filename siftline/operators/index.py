"""The trigram index: postings that may only skip work, never change an answer."""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.patterns import Pattern
from siftline.operators.search import matching_lines
from siftline.sources.stored import children, filesystem, size_of, written

#: Above this drift an amended index is built anew: documents, or an eighth of all.
DRIFT = 512
#: Folders of postings, how many tasks write them, and into how many parts a folder's rows are dealt: common
#: trigrams aren't one task's.
BUCKETS, POSTING_PARTITIONS, SPREAD = 64, 64, 4


def trigrams(text: Column) -> Column:
    """Distinct character trigrams, in no order; none of texts shorter than three."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def postings(docs: DataFrame) -> DataFrame:
    """tri, doc_id: one row for each distinct trigram of a document."""
    return docs.select("doc_id", F.explode(trigrams(F.col("body"))).alias("tri")).select("tri", "doc_id")


def trigram_stats(docs: DataFrame) -> DataFrame:
    """One row: files, distinct trigrams, postings."""
    p = postings(docs).groupBy("tri").agg(F.count(F.lit(1)).alias("n"))
    sums = p.agg(F.count(F.lit(1)).alias("distinct_trigrams"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
    return docs.agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(sums))  # one row each


def needed(p: Pattern) -> list[str]:
    """Trigrams that a document with a match must have."""
    texts = (p.plain,) if p.plain is not None else p.literals
    return sorted({t[i : i + 3] for t in texts for i in range(len(t) - 2)})


def candidates(index: DataFrame, p: Pattern) -> DataFrame | None:
    """doc_id of the documents that have all needed trigrams; None if nothing can be skipped."""
    tris = needed(p)
    if not tris:
        return None
    rows = index.where(F.col("tri").isin(tris))
    if "bucket" in index.columns:
        rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in tris})))
    return rows.groupBy("doc_id").agg(F.count_distinct("tri").alias("n")).where(F.col("n") == len(tris)).select("doc_id")


def search_indexed(docs: DataFrame, index: DataFrame, p: Pattern) -> DataFrame:
    chosen = candidates(index, p)
    return matching_lines(docs if chosen is None else docs.join(chosen, "doc_id", "left_semi"), p)


def crest(docs: DataFrame) -> DataFrame:
    """Longest run of hex digits, digits and capitals per document; a column store can skip by them."""
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.regexp_extract_all("body", F.lit(c), F.lit(0)), F.length)), F.lit(0)).cast("long")
    return docs.select("path", longest("[0-9a-f]+").alias("hex_run"), longest("[0-9]+").alias("digit_run"), longest("[A-Z]+").alias("upper_run"))


def overlay(base: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """base without changed and gone documents, plus the changed ones."""
    off = changed.select("doc_id").unionByName(gone.select("doc_id"))
    return base.join(off, "doc_id", "left_anti").unionByName(changed)


def _bucket(tri: Column) -> Column:
    return F.pmod(F.crc32(F.encode(tri, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _write(docs: DataFrame, found: DataFrame, folder: str) -> None:
    """Postings in a folder for each bucket of trigrams, so that a search opens those of its own only."""
    rows = found.withColumn("bucket", _bucket(F.col("tri")))
    rows.repartition(POSTING_PARTITIONS, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "tri").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    modified = F.col("modified").cast("timestamp") if "modified" in docs.columns else F.lit(None).cast("timestamp")
    facts = docs.select("doc_id", "path", F.octet_length("body").alias("length"), modified.alias("modified"), F.xxhash64("body").alias("digest"), F.lit(time.time_ns()).alias("added"))
    facts.write.mode("overwrite").parquet(f"{folder}/docs")


def build(docs: DataFrame, path: str) -> None:
    """Write a new generation, and then its manifest under a number of its own, in one rename: readers
    take the highest number, so they see the old generation or the new."""
    anchor = time.time_ns()
    generation = f"{path}/gens/{anchor}"
    _write(docs, postings(docs), generation)
    _publish(docs.sparkSession, path, {"generation": generation, "anchor_unix_ns": anchor, "schema_version": 2})


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    name = f"{manifest['anchor_unix_ns']:020d}.json"
    fs, draft = filesystem(spark, f"{path}/drafts/{name}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.mkdirs(draft.getParent().getParent().suffix("/manifests"))
    fs.rename(draft, filesystem(spark, f"{path}/manifests/{name}")[1])


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest; before any build, one without a generation."""
    names = children(spark, f"{path}/manifests")
    if not names:
        return {"generation": None, "anchor_unix_ns": 0, "schema_version": 2}
    fs, where = filesystem(spark, f"{path}/manifests/{names[-1]}")
    source = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def add(batch: DataFrame, path: str, name: str, gone: DataFrame | None = None) -> None:
    """Postings of arriving documents, and the ids of ``gone`` ones, beside the current generation until
    the next is built."""
    folder = f"{path}/deltas/{manifest(batch.sparkSession, path)['anchor_unix_ns']}/{name}"
    if gone is not None:
        gone.select("doc_id", F.lit(time.time_ns()).alias("left")).write.mode("overwrite").parquet(f"{folder}/gone")
    _write(batch, postings(batch), folder)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The generation and what was added to it since."""
    m = manifest(spark, path)
    base = f"{path}/deltas/{m['anchor_unix_ns']}"
    added = [f"{base}/{n}" for n in children(spark, base) if children(spark, f"{base}/{n}/docs")]
    out = ([m["generation"]] if m["generation"] else []) + added
    if not out:
        raise ValueError(f"no index in {path}")
    return out


def _read(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    parts = [spark.read.schema(schema).parquet(f"{f}/{what}") for f in _folders(spark, path)]
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, path: str) -> DataFrame:
    """tri, doc_id, bucket of the generation and of what was added since. A document that was indexed again
    has its old trigrams too: an index may give a document too many, never one too few."""
    return _read(spark, path, "postings", "tri string, doc_id long, bucket int")


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, length, modified, digest of what is indexed; without documents that have gone since."""
    rows = _read(spark, path, "docs", "doc_id long, path string, length int, modified timestamp, digest long, added long")
    gone = [spark.read.schema("doc_id long, left long").parquet(f"{f}/gone") for f in _folders(spark, path) if children(spark, f"{f}/gone")]
    if gone:
        last = reduce(DataFrame.unionByName, gone).groupBy("doc_id").agg(F.max("left").alias("left"))
        rows = rows.join(last, "doc_id", "left").where("left is null or added > left").drop("left")
    return rows.drop("added")


def status(spark: SparkSession, path: str) -> DataFrame:
    m = manifest(spark, path)
    n = indexed(spark, path).agg(F.count_distinct("doc_id").alias("files_indexed"))
    p = load(spark, path).agg(F.count_distinct("tri").alias("distinct_trigrams"), F.count(F.lit(1)).alias("postings"))
    age = (time.time_ns() - m["anchor_unix_ns"]) / 1e9
    size = sum(size_of(spark, f"{f}/postings") for f in _folders(spark, path))
    facts = (F.lit(size).cast("long").alias("bytes"), F.lit(m["anchor_unix_ns"]).alias("anchor_unix_ns"), F.lit(age).alias("age_seconds"))
    return n.join(F.broadcast(p)).select(F.lit(m["schema_version"]).alias("schema_version"), "*", *facts)


def drift(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(changed or new documents, ids of gone ones) since the index was built. Documents with the time and
    length that the index knows are unchanged unread; only others are hashed."""
    known = indexed(docs.sparkSession, path)
    rows = docs
    if "modified" in docs.columns:
        stamp = known.where("modified is not null").select("doc_id", F.col("modified").alias("_m"), F.col("length").alias("_l")).distinct()
        same = (docs["doc_id"] == stamp["doc_id"]) & (docs["modified"].cast("timestamp") == F.col("_m")) & (F.octet_length("body") == F.col("_l"))
        rows = docs.join(stamp, same, "left_anti")
    digest = known.select("doc_id", "digest")
    changed = rows.withColumn("digest", F.xxhash64("body")).join(digest, ["doc_id", "digest"], "left_anti").drop("digest")
    return changed, known.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def amend(docs: DataFrame, path: str) -> str:
    """Bring the index up to date: nothing, an addition for what changed, or a full build if much did."""
    changed, gone = drift(docs, path)
    new, lost = written(changed.select("doc_id")), written(gone)
    n = new.count() + lost.count()
    if n == 0:
        return "current"
    if n > max(DRIFT, docs.count() // 8):
        build(docs, path)
        return "rebuilt"
    add(docs.join(new, "doc_id", "left_semi"), path, f"amend-{time.time_ns()}", lost)
    return "amended"


def search_fresh(docs: DataFrame, path: str, p: Pattern) -> DataFrame:
    """Matching lines by a stored index that may be behind: what changed since it was built is
    searched without it, so the answer is always that of the documents as they are."""
    chosen = candidates(load(docs.sparkSession, path), p)
    if chosen is None:
        return matching_lines(docs, p)
    changed, _ = drift(docs, path)
    unindexed = changed.select("doc_id")
    return matching_lines(docs.join(chosen.unionByName(unindexed).distinct(), "doc_id", "left_semi"), p)


def staleness(docs: DataFrame, path: str) -> DataFrame:
    """One row: files indexed, stale (changed, new or gone) files, when the index was built."""
    changed, gone = drift(docs, path)
    m = manifest(docs.sparkSession, path)
    known = indexed(docs.sparkSession, path).agg(F.count_distinct("doc_id").alias("files_indexed"))
    stale = changed.select("doc_id").unionByName(gone).agg(F.count(F.lit(1)).alias("stale_files"))
    return known.join(F.broadcast(stale)).withColumn("built_unix_ns", F.lit(m["anchor_unix_ns"]))  # one row each


def kept(docs: DataFrame, path: str, p: Pattern) -> DataFrame:
    """Matching lines, kept as a table beside the index and read again while the index is current.
    A stale index keeps nothing."""
    spark, m = docs.sparkSession, manifest(docs.sparkSession, path)
    changed, gone = drift(docs, path)
    if not (changed.isEmpty() and gone.isEmpty()):
        return search_fresh(docs, path, p)
    key = hashlib.sha1(repr((p.regex, p.options, m["anchor_unix_ns"], _folders(spark, path))).encode()).hexdigest()
    place = f"{path}/kept/{key}"
    try:
        return spark.read.parquet(place)
    except AnalysisException:  # not kept yet
        search_fresh(docs, path, p).write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)
