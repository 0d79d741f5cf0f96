"""Problem 8: long exact spans shared between records.

A log-structured index of fingerprints.  Every batch of documents is fingerprinted
by winnowing: of each window of consecutive k-gram hashes the smallest (leftmost)
is kept, with k and the window chosen so that every span of ``size`` code points
holds a kept k-gram, the same one wherever the span occurs.  The fingerprints of a
batch become a sorted immutable run, one row for each, in a fixed number of ranges
of hashes; a new run is merge-joined with each historical one range by range, so
that history is neither shuffled nor sorted again.  As soon as ``fan_in`` runs of
one level exist they are merged into one of the next, so that a fingerprint is
written once for each level.  Matching fingerprints are only candidates: the text
around them is compared window by window, so a result is exact.

Groups of copies: a run holds each fingerprint once with its least and greatest
document; occurrences of one fingerprint with the same surroundings are one row
before anything is compared, and no pairs are made.  A fingerprint with very many
different surroundings is not gathered; its windows are grouped one by one by the
cluster instead.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.splitting import limit_of
from termloom.session import drop_path, fresh_path, materialize, parallelism, table

PRINTS = "fp long, id long, pos int"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
CHUNK = 1 << 20
INDEX_BITS = np.uint64(26)
#: Different surroundings of one fingerprint that one task may compare at once.
MOST_TOGETHER = 4096
#: Document ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def window_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive codes."""
    up, down = _power_tables(len(c) + 1)
    total = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(7)) * up[:-1], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: len(c) - k + 1])


def winnow(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, fingerprint) of the smallest of each w consecutive k-gram hashes in each text."""
    arrays = [codes(t) for t in texts]
    lengths = np.array([len(a) for a in arrays])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = window_hashes(np.concatenate(arrays), k)
    at = np.arange(len(h), dtype=np.uint64)
    key = ((h >> INDEX_BITS) << INDEX_BITS) | at
    # smallest of each window: blocks of w, prefix and suffix minima
    pad = -len(key) % w
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    least = np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n]) & ((np.uint64(1) << INDEX_BITS) - np.uint64(1))
    inside = np.zeros(n, dtype=bool)
    for s, length in zip(starts, lengths):
        inside[s : max(s, s + length - k - w + 2)] = True
    chosen = least[inside].astype(np.int64)
    if len(chosen):
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    owner = np.searchsorted(starts, chosen, side="right") - 1
    # empty texts share their start with the next one; the owner is the last that starts there
    return owner, chosen - starts[owner], h[chosen].view(np.int64)


def fingerprints(docs: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(fp, id, pos): winnowed fingerprints of every text of at least ``size`` code points."""
    k = size // 2
    w = size - k + 1
    long = docs.where(F.col(key).isNotNull() & (F.length(column) >= size)).select(F.col(key).cast("long").alias("id"), F.col(column).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list) -> pa.RecordBatch:
            owner, pos, fp = winnow(texts, k, w)
            return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.array(ids, dtype=np.int64)[owner]), pa.array(pos.astype(np.int32))], names=["fp", "id", "pos"])

        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n and n + len(t) > CHUNK:
                    yield out(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(t)
                n += len(t)
            if ids:
                yield out(ids, texts)

    return long.mapInArrow(run, PRINTS)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a folder that all executors share.

    ``add`` turns a batch into a run and returns the fingerprints that the batch
    shares with another document, in the batch or in history.  A run is (fp, lo,
    hi), in ``buckets`` files, each sorted.  What is where stands in a manifest, so
    that another session can open the index and go on.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "fingerprint-index")
        #: (level, name) of each run, and the folders of fingerprints with their places
        self.runs: list[tuple[int, str]] = []
        self.postings: list[str] = []
        self.fan_in, self.buckets, self.made = max(2, fan_in), buckets or parallelism(spark), 0
        state = self._manifest()
        if state:
            self.fan_in, self.buckets, self.made, self.postings = state["fan_in"], state["buckets"], state["made"], state["postings"]
            self.runs = [(level, name) for level, name in state["runs"]]

    def _manifest(self) -> dict | None:
        """The state that was saved last; each is a file of its own, so that a crash leaves the one before."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            return None
        last = max((str(f.getPath()) for f in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{f.getPath()}/_SUCCESS"))), default=None)
        return json.loads(self.spark.read.text(last).first()[0]) if last else None

    def _save(self) -> None:
        self.made += 1
        state = json.dumps({"fan_in": self.fan_in, "buckets": self.buckets, "made": self.made, "postings": self.postings, "runs": self.runs})
        self.spark.range(1).select(F.lit(state).alias("value")).coalesce(1).write.text(f"{self.path}/manifest/{self.made:08d}")

    def _write(self, heads: DataFrame, level: int, placed: bool = False) -> None:
        """Write a run; ``placed`` tells that each task has the rows of one range already."""
        name = f"run_{self.made}_{len(self.runs)}_{level}"
        table = self._name(name)
        self.spark.sql(f"drop table if exists {table}")
        rows = heads if placed else heads.repartition(self.buckets, "fp")
        rows.sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(table)
        self.runs.append((level, name))

    def _name(self, name: str) -> str:
        return f"termloom_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{name}"

    def run(self, name: str) -> DataFrame:
        """A run as its ranges, whose places and order the planner knows."""
        table = self._name(name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"create table {table} (fp bigint, lo bigint, hi bigint) using parquet clustered by (fp) sorted by (fp) into {self.buckets} buckets location '{self.path}/{name}'")
        return self.spark.table(table)

    def entries(self) -> DataFrame:
        """(fp, id, pos) of all batches."""
        return self.spark.read.schema(PRINTS).parquet(*self.postings)

    def joined(self, new: DataFrame, history: list[str]) -> DataFrame:
        """Fingerprints of the new run that another document of a historical one has."""
        out = None
        for name in history:
            old = self.run(name).select("fp", F.col("lo").alias("l"), F.col("hi").alias("h"))
            hit = new.hint("merge").join(old, "fp").where("l <> lo or h <> hi or lo <> hi").select("fp")
            out = hit if out is None else out.unionByName(hit)
        return out

    def add(self, prints: DataFrame, stored: str | None = None) -> DataFrame:
        """(fp): what the batch (fp, id, pos) shares; ``stored`` is the folder where its rows are already written."""
        if stored is None:
            stored = f"{self.path}/postings_{self.made}"
            prints.select("fp", "id", "pos").write.mode("overwrite").parquet(stored)
        self.postings.append(stored)
        history = [name for _, name in self.runs]
        heads = self.spark.read.schema(PRINTS).parquet(stored).groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        self._write(heads, 0)
        new = self.run(self.runs[-1][1])
        hits = new.where("lo <> hi").select("fp")
        with ordered_buckets(self.spark):
            hits = materialize(hits.unionByName(self.joined(new, history)).distinct() if history else hits, "fingerprint-hits")
        self.compact()
        self._save()
        return hits

    def compact(self) -> None:
        """Merge the runs of a level into one of the next wherever there are ``fan_in`` of them."""
        level = 0
        while any(x >= level for x, _ in self.runs):
            same = [name for x, name in self.runs if x == level]
            if len(same) >= self.fan_in:
                if len(same) == 2:
                    # both are in order range by range
                    a, b = (self.run(name).select(F.col("fp").alias(f"fp{i}"), F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")) for i, name in enumerate(same))
                    both = a.hint("merge").join(b, F.col("fp0") == F.col("fp1"), "full_outer")
                    with ordered_buckets(self.spark):
                        self._write(both.select(F.coalesce("fp0", "fp1").alias("fp"), F.least("lo0", "lo1").alias("lo"), F.greatest("hi0", "hi1").alias("hi")), level + 1, placed=True)
                else:
                    rows = self.spark.read.schema("fp long, lo long, hi long").parquet(*[f"{self.path}/{name}" for name in same])
                    self._write(rows.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), level + 1)
                self.runs = [(x, name) for x, name in self.runs if name not in same]
                for name in same:
                    self.spark.sql(f"drop table if exists {self._name(name)}")
                    drop_path(self.spark, f"{self.path}/{name}")
            level += 1


@contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of one sorted file for each bucket count as sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _surroundings(docs: DataFrame, key: str, column: str, hits: DataFrame, size: int) -> DataFrame:
    """(fp, id, pos, before, around): the text within reach of each candidate."""
    k = size // 2
    spark = docs.sparkSession
    each = hits.groupBy("id").agg(F.collect_list(F.struct("fp", "pos")).alias("at"))
    each = materialize(each, "span-candidates")
    text = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("t"))
    # few ids are broadcast so that the other texts need no shuffle; many are joined by shuffle
    if each.count() <= BROADCAST_IDS:
        text = text.join(F.broadcast(each.select("id")), "id", "left_semi")
    joined = each.join(text, "id").select("id", "t", F.explode("at").alias("a"))
    joined = joined.select("id", "t", F.col("a.fp").alias("fp"), F.col("a.pos").alias("pos"), F.least(F.col("a.pos"), F.lit(size - k)).alias("before"))
    return joined.select("fp", "id", "pos", "before", F.expr(f"substring(t, pos - before + 1, before + {size})").alias("around"))


def _compare(rows: pd.DataFrame, size: int, back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): stretches of each row's surroundings, from its fingerprint on, that another document has as well.

    Rows of one ``fp`` are in one call.  Column d of the matrix is the place d -
    back from the fingerprint.
    """
    m = len(rows)
    width = back + size
    text = np.zeros((m, width), dtype=np.uint32)
    before = rows["before"].to_numpy()
    lengths = np.empty(m, dtype=np.int64)
    for i, (b, t) in enumerate(zip(before, rows["around"])):
        c = codes(t)
        lengths[i] = len(c)
        text[i, back - b : back - b + len(c)] = c + np.uint32(1)
    first, end = back - before, back - before + lengths
    up, down = _power_tables(width + 1)
    total = np.zeros((m, width + 1), dtype=np.uint64)
    np.cumsum(text.astype(np.uint64) * up[:-1], axis=1, out=total[:, 1:])
    fp, lo, hi = rows["fp"].to_numpy(), rows["lo"].to_numpy(), rows["hi"].to_numpy()
    shared = np.zeros((m, back + 1), dtype=bool)
    for d in range(back + 1):
        ok = np.flatnonzero((first <= d) & (end >= d + size))
        if not len(ok):
            continue
        h = mixed((total[ok, d + size] - total[ok, d]) * down[d])
        order = np.lexsort((h, fp[ok]))
        r = ok[order]
        new = np.concatenate([[True], (fp[r][1:] != fp[r][:-1]) | (h[order][1:] != h[order][:-1])])
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        leader = r[head][group]
        other = leader != r
        if not (text[r[other], d : d + size] == text[leader[other], d : d + size]).all():  # a collision: compare the text itself
            ids = {}
            group = np.array([ids.setdefault((fp[x], text[x, d : d + size].tobytes()), len(ids)) for x in r])
            again = np.argsort(group, kind="stable")
            r, group = r[again], group[again]
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        twice = np.minimum.reduceat(lo[r], head) != np.maximum.reduceat(hi[r], head)
        shared[r, d] = twice[group]
    edge = np.diff(np.pad(shared, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rr, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return rr, a - back, b - 1 - back + size


def _stretches(kinds: DataFrame, size: int, parts: int) -> DataFrame:
    """(fp, ck, before, a, b) for each kind of surroundings, places counted from the fingerprint."""
    back = size - size // 2
    whole = f"before = {back} and length(around) = {back + size} and lo <> hi"
    simple = kinds.where(whole).select("fp", "ck", "before", F.lit(-back).alias("a"), F.lit(size).alias("b"))
    # a kind that two documents have is shared wholly, but still stands for others
    crowd = kinds.groupBy("fp").agg(F.count("*").alias("n")).where(f"n > {MOST_TOGETHER}").select("fp")
    many = kinds.join(crowd, "fp", "left_semi").where(f"not ({whole})")
    some = kinds.join(crowd, "fp", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(rows: pd.DataFrame) -> pd.DataFrame:
            rr, a, b = _compare(rows, size, back)
            return pd.DataFrame({"fp": rows["fp"].to_numpy()[rr], "ck": rows["ck"].to_numpy()[rr], "before": rows["before"].to_numpy()[rr], "a": a, "b": b})

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows["fp"].to_numpy() == rows["fp"].iloc[-1] if len(rows) else np.zeros(0, dtype=bool)
            held = rows[last].reset_index(drop=True) if len(rows) else None
            done = rows[~last].reset_index(drop=True)
            for i in _slices(done["fp"].to_numpy()):
                yield out(done.iloc[i].reset_index(drop=True))
        if held is not None and len(held):
            yield out(held)

    compared = some.repartition(parts, "fp").sortWithinPartitions("fp").mapInPandas(run, "fp long, ck long, before int, a int, b int")
    # windows of crowded fingerprints, one by one, grouped by the cluster
    crowded = kinds.join(crowd, "fp", "left_semi")
    window = crowded.select("fp", "ck", "before", "lo", "hi", "around", F.explode(F.expr(f"case when length(around) >= {size} then sequence(0, length(around) - {size}) else array() end")).alias("j"))
    window = window.select("fp", "ck", "before", "lo", "hi", (F.col("j") - F.col("before")).alias("a"), F.expr(f"substring(around, j + 1, {size})").alias("s"))
    twice = window.groupBy("fp", "a", F.md5("s").alias("h")).agg(F.min("lo").alias("l"), F.max("hi").alias("g")).where("l <> g").drop("l", "g")
    singly = window.withColumn("h", F.md5("s")).join(twice, ["fp", "a", "h"]).join(many.select("fp", "ck", "before").distinct(), ["fp", "ck", "before"], "left_semi")
    singly = singly.select("fp", "ck", "before", "a", (F.col("a") + size).alias("b"))
    return simple.unionByName(compared).unionByName(singly)


def _slices(fp: np.ndarray, most: int = 20_000) -> Iterator[slice]:
    """Whole groups of a sorted column, about ``most`` rows at a time."""
    start = 0
    while start < len(fp):
        end = min(len(fp), start + most)
        if end < len(fp):
            cut = np.searchsorted(fp[start:], fp[end - 1], side="left") + start
            end = cut if cut > start else int(np.searchsorted(fp[start:], fp[start], side="right")) + start
        yield slice(start, end)
        start = end


def merged_intervals(df: DataFrame, key: str) -> DataFrame:
    """Intervals (c0, c1) of each key united where they overlap or touch."""
    w = Window.partitionBy(key).orderBy("c0", "c1")
    before = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.select(key, "c0", "c1", F.coalesce((before < F.col("c0")).cast("int"), F.lit(1)).alias("_n"))
    group = new.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy(key, "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_g")


#: Deliveries that the queries take the documents in, and runs of a level that are merged: two of them make a compaction.
BATCHES, FAN_IN = 3, 2


def shared_spans(docs: DataFrame, key: str, column: str, size: int, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """(key, c0, c1): the stretches of each text covered by spans of at least ``size`` that another record has verbatim.

    The texts are fingerprinted once and go through the index in ``batches``, as
    deliveries would.  Null keys and texts and texts shorter than ``size`` have no
    row.  Rows of one key count as one record.  A key must be a whole number.
    """
    spark = docs.sparkSession
    at = fresh_path(spark, "fingerprints")
    fingerprints(docs, key, column, size).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(at)
    index = FingerprintIndex(spark, fan_in=fan_in)
    jvm = spark.sparkContext._jvm
    hits = None
    for b in range(batches):
        part = jvm.org.apache.hadoop.fs.Path(f"{at}/batch={b}")
        if part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(part):
            new = index.add(spark.read.schema(PRINTS).parquet(f"{at}/batch={b}"), f"{at}/batch={b}")
            hits = new if hits is None else hits.unionByName(new)
    if hits is None:
        return spark.createDataFrame([], f"`{key}` long, c0 int, c1 int")
    found = index.entries().join(hits.distinct(), "fp", "left_semi")
    around = _surroundings(docs, key, column, found, size).withColumn("ck", F.xxhash64("around"))
    around = materialize(around, "span-surroundings")
    kinds = around.groupBy("fp", "ck", "before").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("around").alias("around"))
    stretches = _stretches(kinds, size, parallelism(spark)).distinct()
    spans = around.select("fp", "ck", "before", "id", "pos").join(stretches, ["fp", "ck", "before"])
    spans = spans.select(F.col("id").alias(key), (F.col("pos") + F.col("a")).cast("int").alias("c0"), (F.col("pos") + F.col("b")).cast("int").alias("c1"))
    return merged_intervals(spans, key)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, c0, c1) of the documents."""
    size, _ = limit_of(spark, sf_dir, "documents.text", "shared")
    return shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", size)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part) of every document; null and empty texts share nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    part = found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("c1") - F.col("c0")).alias("s"))
    s = F.coalesce("s", F.lit(0)).cast("long")
    return docs.join(part, "doc_id", "left").select("doc_id", "n_chars", s.alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, s / F.col("n_chars")).otherwise(0.0), 6).alias("shared_part"))
