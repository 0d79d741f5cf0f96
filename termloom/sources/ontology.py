"""Ontologies: reading, normalising, and the relations derived from them.

``nodes`` is the common form: id, name, synonyms, definition, alt_ids, parents,
children, all ids in the usual spelling.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import norm, norm_id
from termloom.session import drop_path, fresh_path, materialize

STRINGS = "array<string>"
#: Edges that one task may walk; a larger graph is walked by the cluster, round by round.
SMALL_GRAPH = 100_000


def _ids(c: Column) -> Column:
    """Distinct usual ids of an array; null as none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast(STRINGS)), norm_id), lambda x: x.isNotNull()))


def _texts(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast(STRINGS)), lambda x: F.trim(x) != ""))


def nodes(concepts: DataFrame) -> DataFrame:
    """The common form of the table ``concepts``.  Rows without an id are dropped, repeated ids keep the least name."""
    rows = concepts.select(norm_id("hpo_id").alias("id"), F.col("hpo_name").alias("name"), _texts(F.col("hpo_synonyms")).alias("synonyms"), F.col("hpo_def").alias("definition"), _ids(F.col("alt_ids")).alias("alt_ids"), _ids(F.col("father")).alias("parents"), _ids(F.col("child")).alias("children"))
    rest = [c for c in rows.columns if c != "id"]
    one = rows.where("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("v"))
    return one.select("id", *[F.col("v")[c].alias(c) for c in rest])


def _listed(field: str) -> Column:
    """A JSON value that is a string, a list of strings, or an object whose keys matter, as a list."""
    v = F.trim(F.col(field))
    as_list = F.from_json(v, STRINGS)
    as_keys = F.map_keys(F.from_json(v, "map<string,string>"))
    plain = F.when(v.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), v, F.lit("]")), STRINGS), 1)).otherwise(v)
    return F.when(v.isNull() | (v == "") | (v == "null"), F.array().cast(STRINGS)).when(v.startswith("["), as_list).when(v.startswith("{"), as_keys).otherwise(F.array(plain))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``nodes`` of an ontology file: an object of objects by id, or a list of objects.

    Keys of an object may be written in several ways and their values be a
    string, a list or an object.  An entry without any id is dropped.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    each = whole.where(F.col("t").startswith("{")).select(F.explode(F.from_json("t", "map<string,string>")).alias("key", "body"))
    listed = whole.where(F.col("t").startswith("[")).select(F.explode(F.from_json("t", STRINGS)).alias("body")).select(F.lit(None).cast("string").alias("key"), "body")
    rows = each.unionByName(listed).select("key", F.from_json("body", "map<string,string>").alias("m"))

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.element_at("m", k) for k in keys])

    raw = rows.select(
        F.coalesce(first("id", "Id", "hpo_id"), F.col("key")).alias("id"), first("Name", "name", "label", "preferred_label").alias("name"), first("Synonym", "Synonyms", "synonym", "synonyms").alias("synonyms"),
        first("Def", "def", "definition").alias("definition"), first("Alt_id", "alt_id", "alt_ids").alias("alt_ids"), first("Father", "father", "parents").alias("parents"), first("Child", "child", "children").alias("children"),
    )
    concepts = raw.select(
        F.col("id").alias("hpo_id"), F.get(_listed("name"), 0).alias("hpo_name"), _listed("synonyms").alias("hpo_synonyms"),
        F.get(_listed("definition"), 0).alias("hpo_def"), _listed("alt_ids").alias("alt_ids"), _listed("parents").alias("father"), _listed("children").alias("child"),
    )
    return nodes(concepts)


def aliases(n: DataFrame) -> DataFrame:
    """(alias, id): older ids; one that is itself a main id, or stands for two, is resolved to the main and the least id."""
    a = n.select(F.explode("alt_ids").alias("alias"), "id").groupBy("alias").agg(F.min("id").alias("id"))
    return a.join(n.select(F.col("id").alias("alias")), "alias", "left_anti")


def resolver(n: DataFrame) -> DataFrame:
    """(any_id, id): main ids for themselves, older ones for their main id."""
    return n.select(F.col("id").alias("any_id"), "id").unionByName(aliases(n).select(F.col("alias").alias("any_id"), "id"))


def resolved(df: DataFrame, column: str, n: DataFrame, out: str = "concept_id") -> DataFrame:
    """The frame with the main id of an id column; an unknown id stays as it is, in its usual spelling."""
    r = resolver(n).select(F.col("any_id").alias("_any"), F.col("id").alias("_id"))
    return df.withColumn("_any", norm_id(column)).join(r, "_any", "left").withColumn(out, F.coalesce("_id", "_any")).drop("_any", "_id")


def clones(n: DataFrame) -> DataFrame:
    """``nodes`` with a copy of the main node for each older id."""
    copies = aliases(n).join(n, "id").drop("id").withColumnRenamed("alias", "id")
    return n.unionByName(copies.select(*n.columns))


def edges(n: DataFrame) -> DataFrame:
    """(parent, child): from both directions, older ids resolved, between known nodes, each once and none to itself."""
    down = n.select(F.col("id").alias("parent"), F.explode("children").alias("child"))
    up = n.select(F.explode("parents").alias("parent"), F.col("id").alias("child"))
    r = resolver(n)
    both = down.unionByName(up).distinct()
    p, c = r.select(F.col("any_id").alias("parent"), F.col("id").alias("p")), r.select(F.col("any_id").alias("child"), F.col("id").alias("c"))
    return both.join(p, "parent").join(c, "child").select(F.col("p").alias("parent"), F.col("c").alias("child")).where("parent <> child").distinct()


PAIRS = "ancestor string, descendant string, steps int"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Breadth-first from every node of a small graph."""
    below: dict[str, set[str]] = {}
    for b in batches:
        for p, c in zip(b["parent"], b["child"]):
            below.setdefault(p, set()).add(c)
    columns = ["ancestor", "descendant", "steps"]
    rows: list[tuple[str, str, int]] = []
    for start in sorted(below):
        seen: dict[str, int] = {}
        level, k = below[start], 1
        while level:
            seen.update(dict.fromkeys(level, k))
            level, k = {c for p in level for c in below.get(p, ())} - seen.keys(), k + 1
        rows.extend((start, c, n) for c, n in seen.items())
        if len(rows) >= 50_000:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    yield pd.DataFrame(rows, columns=columns)


def closure(e: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps): all pairs that a path of one step or more joins, and the length of the shortest.

    A graph of at most ``SMALL_GRAPH`` edges is walked by one task.  For a larger
    one the frontier of each round is written out, so that plans do not grow.  A
    pair already known is not followed again, so that cycles end.
    """
    spark = e.sparkSession
    path = fresh_path(spark, "edges")
    e.select("parent", "child").write.parquet(path)
    e = spark.read.schema("parent string, child string").parquet(path)
    if e.count() <= SMALL_GRAPH:
        return materialize(e.coalesce(1).mapInPandas(_walk, PAIRS), "closure")
    at = fresh_path(spark, "closure")
    frontier = e.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("steps"))
    frontier.write.parquet(f"{at}/round=1")
    for k in itertools.count(2):
        known = spark.read.schema(PAIRS).parquet(*[f"{at}/round={i}" for i in range(1, k)])
        last = spark.read.schema(PAIRS).parquet(f"{at}/round={k - 1}")
        new = last.join(e, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant")).distinct()
        new = new.join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").select("ancestor", "descendant", F.lit(k).alias("steps"))
        new.write.parquet(f"{at}/round={k}")
        if spark.read.schema(PAIRS).parquet(f"{at}/round={k}").isEmpty():
            drop_path(spark, f"{at}/round={k}")
            break
    return spark.read.schema(PAIRS).parquet(*[f"{at}/round={i}" for i in range(1, k)])


def depths(n: DataFrame, pairs: DataFrame, root: str | None = None) -> DataFrame:
    """(id, depth): steps by the shortest way from the node ``root``, or from any node without parents; a node that none reaches has 0."""
    if root is None:
        roots = n.join(pairs.select(F.col("descendant").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("ancestor"))
        pairs = pairs.join(roots, "ancestor")
    else:
        pairs = pairs.where(F.col("ancestor") == norm_id(F.lit(root)))
    d = pairs.groupBy(F.col("descendant").alias("id")).agg(F.min("steps").alias("depth"))
    return n.select("id").join(d, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def lexicon(n: DataFrame) -> DataFrame:
    """(term, id): normalised names and synonyms."""
    t = n.select("id", F.explode(F.array_append("synonyms", F.col("name"))).alias("t"))
    return t.select(norm("t").alias("term"), "id").where("term <> ''").distinct()
