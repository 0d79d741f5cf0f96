"""Problem 6: fill containers of fixed capacity with items, little room unused.

Bin completion: around the largest document left, the undominated fillings of one
container are enumerated, fullest first; a depth-first branch and bound prunes
branches whose waste rules out beating the incumbent, which best-fit decreasing
provides at first.  Documents are packed in blocks of bounded size, so nothing
grows with the corpus; what stands in containers that a block could not fill goes
to a next round of blocks, until one block is left.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.splitting import limit_of
from termloom.llm.tokens import token_count, tokenizer_path
from termloom.session import materialize, table

BLOCK = 1000
#: Nodes of one block's search; where they run out, the incumbent stands.
NODES = 4000
#: Fillings considered around one item, and steps to find them.
FILLINGS = 6
STEPS = 400
#: Containers filled to at least this part are final in a round that is not the last.
FULL = 0.98


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; each item, from the largest, goes where it leaves least room."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_right(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(out)
            out.append([])
        out[b].append(i)
        insort(rooms, (room - sizes[i], b))
    return out


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling ``a`` can be got from ``b`` by putting items of ``a``, one or two, in place of single items of ``b``."""
    rest = sorted(a, reverse=True)
    for room in sorted(b, reverse=True):
        for _ in range(2):
            fit = next((i for i, x in enumerate(rest) if x <= room), None)
            if fit is None:
                break
            room -= rest.pop(fit)
    return not rest


def fillings(left: list[int], room: int) -> list[tuple[int, ...]]:
    """Undominated choices from the ascending sizes ``left`` with sum at most ``room``, fullest first; at most FILLINGS."""
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def search(end: int, room: int, chosen: tuple[int, ...]) -> bool:
        """True when enough exact fillings are known."""
        nonlocal steps
        i = bisect_right(left, room, 0, end) - 1
        if i < 0:
            found.append((room, chosen))
            return False
        tried = None
        while i >= 0 and steps < STEPS:
            if left[i] != tried:
                tried = left[i]
                steps += 1
                if room == tried:
                    found.append((0, (*chosen, tried)))
                    return sum(1 for w, _ in found if not w) >= FILLINGS
                if search(i, room - tried, (*chosen, tried)):
                    return True
            i -= 1
        return False

    search(len(left), room, ())
    out: list[tuple[int, ...]] = []
    for _, f in sorted(set(found), key=lambda x: (x[0], len(x[1]), [-y for y in x[1]])):
        if not any(dominated(f, g) for g in out):
            out.append(f)
        if len(out) == FILLINGS:
            break
    return out or [()]


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of item numbers, every item in one, no container over capacity.

    As few containers as the search finds within ``nodes``; never more than
    best-fit decreasing needs.  Equal sizes are interchangeable.  Sizes must be
    from 0 to ``capacity``.
    """
    if any(not 0 <= s <= capacity for s in sizes):
        raise ValueError("an item is larger than a container or negative")
    if not sizes:
        return []
    best = best_fit_decreasing(sizes, capacity)
    least = max(1, -(-sum(sizes) // capacity))
    if len(best) > least:
        count, chosen = len(best), None
        budget = nodes
        allowed = [(count - 1) * capacity - sum(sizes)]
        stack = [(sorted(s for s in sizes if s), (), 0)]
        while stack and budget > 0 and count > least:
            left, done, waste = stack.pop()
            budget -= 1
            if waste > allowed[0]:
                continue
            if not left:
                if max(1, len(done)) < count:
                    count, chosen = max(1, len(done)), done
                    allowed[0] = (count - 1) * capacity - sum(sizes)
                continue
            top = left[-1]
            options = fillings(left[:-1], capacity - top)
            for f in reversed(options):
                w = capacity - top - sum(f)
                if waste + w > allowed[0] and sum(f) + top != sum(left):
                    continue
                rest = left[:-1]
                for x in f:
                    del rest[bisect_right(rest, x) - 1]
                stack.append((rest, (*done, (top, *f)), waste + w))
        if chosen is not None:
            where: dict[int, list[int]] = {}
            for i, s in enumerate(sizes):
                where.setdefault(s, []).append(i)
            best = [[where[s].pop() for s in b] for b in chosen] or [[]]
            best[0].extend(where.get(0, []))
    return best


def _divided(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, t0, t1): items of at most ``capacity``; a larger one is divided into full parts and the rest."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / capacity)).cast("int")
    d = sizes.select(key, F.col(size).cast("long").alias("_s"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    t0 = F.col("part") * F.lit(capacity).cast("long")
    return d.select(key, "part", t0.alias("t0"), F.least(F.col("_s"), t0 + capacity).alias("t1"))


def _packer(key: str, capacity: int, level: int, last: bool):
    """Packs the rows of one block; containers that are not full are not final unless this is the last round."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "part"], kind="stable").reset_index(drop=True)
        s = (rows["t1"] - rows["t0"]).astype(int).tolist()
        names, final = [""] * len(s), [True] * len(s)
        for b, members in enumerate(bin_completion(s, capacity)):
            done = last or sum(s[i] for i in members) >= FULL * capacity
            for i in members:
                names[i], final[i] = f"{level}-{k[0]}-{b}", done
        return rows[[key, "part", "t0", "t1"]].assign(container=names, final=final)

    return run


def pack(sizes: DataFrame, key: str, size: str, capacity: int, block: int = BLOCK) -> DataFrame:
    """(key, part, t0, t1, container): each item of ``sizes`` in a container of ``capacity``.

    An item is divided, by ranges [t0, t1) of its size, only where it is larger
    than a container.  Items of size 0 take no room but have a container.  Null
    keys and sizes have no row.  Repeated keys are separate items.
    """
    kind = dict(sizes.dtypes)[key]
    items = _divided(sizes.where(F.col(key).isNotNull() & F.col(size).isNotNull()), key, size, capacity)
    full = items.where(F.col("t1") - F.col("t0") == capacity)
    rest = materialize(items.where(F.col("t1") - F.col("t0") < capacity), "pack-items")
    out = full.select(key, "part", "t0", "t1", F.format_string("full-%s-%d-%d", F.col(key).cast("string"), F.col("part"), F.monotonically_increasing_id()).alias("container"))
    schema = f"`{key}` {kind}, part int, t0 long, t1 long, container string, final boolean"
    level, n = 0, rest.count()
    groups = max(1, -(-n // block))
    while True:
        last = groups == 1
        run = _packer(key, capacity, level, last)
        group = F.pmod(F.xxhash64(key, "part", F.lit(level)), F.lit(groups))
        packed = rest.withColumn("_g", group).repartition(max(1, min(groups, 4096)), "_g").groupBy("_g").applyInPandas(run, schema)
        packed = materialize(packed, f"pack-level-{level}")
        out = out.unionByName(packed.where("final").drop("final"))
        if last:
            return out
        rest = packed.where("not final").drop("final", "container")
        level += 1
        left = rest.count()
        # at least halved each time, so that the rounds end
        groups = max(1, min(groups // 2, -(-left // block)))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents, written once; null texts are left out."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return materialize(docs.select("doc_id", "source", token_count(F.col("text"), tokenizer_path(spark)).alias("tokens")), "document-tokens")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, t0, t1, container): every text, by ranges of its tokens, in a container."""
    capacity, _ = limit_of(spark, sf_dir, "documents.text", "pack")
    return pack(document_tokens(spark, sf_dir), "doc_id", "tokens", capacity)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, least_containers, fill) of the packing."""
    capacity, _ = limit_of(spark, sf_dir, "documents.text", "pack")
    each = containers(spark, sf_dir).groupBy("container").agg(F.sum(F.col("t1") - F.col("t0")).alias("used"))
    total = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))
