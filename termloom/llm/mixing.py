"""Problem 7: mix sources to target weights.

The total is the largest at which every source can give its share when none of
its records is used more often than allowed.  Of each record the whole part of
its expected uses is given; the rest is an inclusion probability, rounded to 0 or
1 by the cube method: the flight phase moves the probabilities of a few records
at a time along the null space of the constraints (number of records and of
tokens), until at most as many are undecided as there are constraints.  It runs
in blocks of bounded size, what stays undecided goes to a next round, and only
the last few are rounded in the landing phase, to the nearest total.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.packing import document_tokens
from termloom.session import materialize, table

BLOCK = 2000
EPS = 1e-9
#: Records of a source left to the landing phase.
LANDING = 12


def flight(p: list[float], sizes: list[float], rng: random.Random, keep: int = 2) -> list[float]:
    """Probabilities with the same sum and the same expected size, at most ``keep`` (2 or more) of them between 0 and 1.

    Each step takes three undecided records; the vector that changes neither the
    sum of probabilities nor that of sizes is unique up to a factor, and the two
    ends of the way along it are taken with probabilities that keep the mean.
    """
    p = [x if EPS < x < 1 - EPS else float(round(x)) for x in p]
    undecided = sum(1 for x in p if 0 < x < 1)
    live: list[int] = []
    for i, x in enumerate(p):
        if undecided <= keep:
            break
        if not 0 < x < 1:
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # constraint rows (1, 1, 1) and the sizes
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[j]) / v if v > 0 else p[j] / -v) for j, v in zip(live, u) if v)
        down = min((p[j] / v if v > 0 else (1 - p[j]) / -v) for j, v in zip(live, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for j, v in zip(live, u):
            p[j] = min(1.0, max(0.0, p[j] + step * v))
            if not EPS < p[j] < 1 - EPS:
                p[j] = float(round(p[j]))
        undecided -= len(live)
        live = [j for j in live if 0 < p[j] < 1]
        undecided += len(live)
    return p


def landing(p: list[float], sizes: list[float]) -> list[float]:
    """The few undecided records rounded so that the size, then the number, is nearest to what was expected."""
    live = [i for i, x in enumerate(p) if 0 < x < 1]
    size, number = sum(p[i] * sizes[i] for i in live), sum(p[i] for i in live)
    best = min(itertools.product((0.0, 1.0), repeat=len(live)), key=lambda z: (abs(sum(a * sizes[i] for a, i in zip(z, live)) - size), abs(sum(z) - number), z))
    out = list(p)
    for i, a in zip(live, best):
        out[i] = a
    return out


def plan(targets: DataFrame, totals: DataFrame) -> list[dict]:
    """For each source (a few rows): share, cap, tokens and expected uses of each record.

    A target source without tokens gives nothing, the others keep their
    proportions.  Null shares count as 0, null or negative caps as 0.
    """
    rows = [r.asDict() for r in targets.join(totals, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["share"], r["cap"], r["tokens"] = float(r["target_share"] or 0), max(0, int(r["max_repeats"] or 0)), int(r["tokens"] or 0)
    able = [r for r in rows if r["share"] > 0 and r["cap"] and r["tokens"]]
    total = min((r["cap"] * r["tokens"] / r["share"] for r in able), default=0.0)
    for r in rows:
        r["uses"] = min(float(r["cap"]), r["share"] * total / r["tokens"]) if r in able else 0.0
    return rows


def _rounder(key: str, seed: int, level: int, last: bool):
    """The flight phase over one block of one source, in a shuffled order; in the last round the landing phase as well."""

    def run(k: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["tokens", key], kind="stable")
        rng = random.Random(f"{seed}/{level}/{k[0]}/{k[1]}")
        order = list(range(len(d)))
        rng.shuffle(order)
        d = d.iloc[order].reset_index(drop=True)
        s = d["tokens"].astype(float).tolist()
        # what the last round has to land on comes from all blocks of the source
        p = flight(d["p"].tolist(), s, rng, LANDING if last else max(2, LANDING // int(d["groups"].iloc[0])))
        return d.assign(p=landing(p, s) if last else p)[[key, "source", "tokens", "base", "p", "groups"]]

    return run


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(key, source, tokens, copies): how often each record is used; records that are not have no row.

    Records without tokens, key or target source are not used.  Repeated keys
    are separate records.
    """
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)[key]
    known = sizes.where(F.col("source").isNotNull() & F.col(key).isNotNull() & (F.col("tokens") > 0)).select(key, "source", "tokens")
    targets = targets.where("source is not null").dropDuplicates(["source"]).select("source", "target_share", "max_repeats")
    totals = known.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    rows = plan(targets, totals)
    # one row for each source of the fixed table of targets
    uses = spark.createDataFrame([(r["source"], r["uses"], int(-(-(r["n"] or 0) // block)) or 1) for r in rows if r["uses"] > 0], "source string, uses double, groups int")
    each = known.join(F.broadcast(uses), "source")
    base = F.floor(F.col("uses") + EPS).cast("int")
    each = each.select(key, "source", "tokens", base.alias("base"), F.greatest(F.lit(0.0), F.col("uses") - base).alias("p"), "groups")
    out = each.where(f"p <= {EPS}").select(key, "source", "tokens", F.col("base").alias("copies"))
    open_ = each.where(f"p > {EPS}")
    schema = f"`{key}` {kind}, source string, tokens int, base int, p double, groups int"
    level, groups = 0, max([1, *(int(-(-(r["n"] or 0) // block)) for r in rows)])
    while True:
        last = groups == 1
        run = _rounder(key, seed, level, last)
        g = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(level)), F.col("groups"))
        done = open_.withColumn("_g", g).groupBy("source", "_g").applyInPandas(run, schema)
        done = materialize(done, f"mix-level-{level}")
        out = out.unionByName(done.where("p = 0 or p = 1").select(key, "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")))
        if last:
            return out.where("copies > 0")
        # two at most are open in each block, so a next round has few blocks
        open_ = done.where("p > 0 and p < 1").withColumn("groups", F.greatest(F.lit(1), F.floor(F.col("groups") * 2 / block)).cast("int"))
        groups = max(1, groups * 2 // block)
        level += 1


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents that are used."""
    return mix(document_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, max_repeats, docs_used, most_copies, tokens_used, actual_share) of every target source."""
    used = mixture(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_used"))
    t = table(spark, sf_dir, "mix_targets").join(used, "source", "left").na.fill(0, ["docs_used", "most_copies", "tokens_used"])
    total = F.sum("tokens_used").over(Window.partitionBy())  # over the few rows of the table of targets
    return t.select("source", "target_share", "max_repeats", "docs_used", "most_copies", "tokens_used", F.round(F.col("tokens_used") / F.greatest(total, F.lit(1)), 6).alias("actual_share"))
