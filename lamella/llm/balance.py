"""Mixing sources to target weights by the cube method: balanced sampling of documents.

Targets: all sources together get `share` times all sizes, split by weight; a source's target stops at `most` times its
size and what is left is split again among the others by weight, until none is above. A source whose target is r times its
size takes each document floor(r) times and once more with probability r - floor(r).

Which documents are taken once more is a balanced sample within each source: the vector of probabilities moves through the
null space of two constraints, the number of documents and the number of words, from one face of the cube to the next,
until fewer than three probabilities are fractional. Moves need three documents at a time only, so documents go in blocks by a
hash of their id (and seeds go by block: reruns agree); each block leaves two at most, these go in blocks again, and
so on until one block of a source is left. Its last LAND probabilities are the landing problem: of their 0/1 corners the
one is taken that misses the source's words, then its documents, by the least. A source of any size needs few rounds, and
no group is larger than a block.

Rows that are equal in id, source and size are one unit with a count, however many: of n equal ones floor(n p) are taken,
none is fractional but one. Null text counts as no words; a null source is a source of its own, ordered last; a null id is
an id like others. Documents without words take 0. A source without words has target 0. An empty table gives an empty result.
Further columns are not looked at. Long texts count with all their words.
"""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import SPACES, discard, fresh, staged

#: Units of a block.
BLOCK = 4096
#: Fractional units at which the last block of a source is landed: at most 2 ** LAND corners are compared.
LAND = 12


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.greatest(F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int"), F.lit(0)).cast("long")


def flight(sizes: list[float], p: list[float], rng: random.Random, stop: int = 2) -> list[float]:
    """Move p within the cube, keeping its sum and its sum weighted by sizes, until `stop` (2 at least) or fewer are fractional."""
    p = list(p)
    fractional = [k for k, x in enumerate(p) if 0 < x < 1]
    left = len(fractional)
    pool: list[int] = []
    rest = iter(fractional)
    while left > stop:
        while len(pool) < 3 and (k := next(rest, None)) is not None:
            pool.append(k)
        if len(pool) < 3:
            break
        a, b, c = pool
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(pool, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, -p[k] / d), min(down, -(1 - p[k]) / d)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(pool, u, strict=True):
            p[k] += step * d
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        whole = [k for k in pool if p[k] in (0.0, 1.0)]
        if not whole:  # rounding: the one nearest to a face goes there
            whole = [min(pool, key=lambda k: min(p[k], 1 - p[k]))]
            p[whole[0]] = float(round(p[whole[0]]))
        left -= len(whole)
        pool = [k for k in pool if k not in whole]
    return p


def landing(sizes: list[float], p: list[float], words: float, docs: float) -> list[float]:
    """0 or 1 for each of the few fractional p: the corner whose words, then documents, are nearest to what p's sums and
    the amounts still owed (words, docs) ask for; of equal ones the first."""
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    want_words = sum(sizes[k] * p[k] for k in open_) + words
    want_docs = sum(p[k] for k in open_) + docs
    best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda z: (abs(sum(sizes[k] * x for k, x in zip(open_, z, strict=True)) - want_words), abs(sum(z) - want_docs)))
    out = list(p)
    for k, x in zip(open_, best, strict=True):
        out[k] = float(x)
    return out


def targets(units: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target, n of every source. Its windows have a row per source."""
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    one = F.lit(1)
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    w = totals.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # Sources are capped in the order of their cap by weight: a source is capped if what is left by then, at its level, is above its cap.
    cap, every = F.col("source_size") * F.lit(most), Window.partitionBy(one)
    by_level = Window.partitionBy(one).orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", cap / F.col("weight"))
    w = w.withColumn("all", F.sum("source_size").over(every) * F.lit(share)).withColumn("weights", F.sum("weight").over(every))
    w = w.withColumn("rate", (F.col("all") - F.coalesce(F.sum(cap).over(by_level), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))))
    # NULL where the level is not reached: the first that is reached, in this order, ends the capping
    rate = F.min(F.when(F.col("rate") <= F.col("level"), F.struct("level", F.col("source").isNull(), "source", "rate"))).over(every).getField("rate")
    w = w.withColumn("final", rate)
    return w.select("source", "source_size", F.when(F.col("final").isNull(), cap).otherwise(F.least(cap, F.col("final") * F.col("weight"))).cast("double").alias("target"), "units")


_UNITS = "doc_id long, source string, size long, n long, source_size long, target double, base int, p double, taken_n long, blocks long, block long"


def _fly(level: int, seed: int):
    def fly(key, table):
        source, block = (k.as_py() for k in key)
        rng = random.Random(f"{seed}|{level}|{source}|{block}")
        order = list(range(table.num_rows))
        rng.shuffle(order)  # so that what is left to land has small and large documents
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")]).take(order)
        sizes, p = [float(x) for x in table["size"].to_pylist()], table["p"].to_pylist()
        last = table["blocks"][0].as_py() == 1
        q = flight(sizes, p, rng, LAND if last else 2)
        if last:
            q = landing(sizes, q, 0.0, 0.0)
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(q, pa.float64()))
        blocks = [max(1, -(-b // (BLOCK // 2))) for b in table["blocks"].to_pylist()]
        return table.set_column(table.schema.get_field_index("blocks"), "blocks", pa.array(blocks, pa.int64())).set_column(
            table.schema.get_field_index("block"), "block", pa.array([b % n for b, n in zip(table["block"].to_pylist(), blocks, strict=True)], pa.int64())
        )

    return fly


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of docs(doc_id, source, text), a row for each of its rows."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    units = staged(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    per_source = targets(units, share, most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = (
        units.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("r", ratio)
        .withColumn("base", F.floor("r").cast("int"))
        .withColumn("p1", F.col("r") - F.col("base"))
        # of n equal rows, whole ones first; p is the fraction of the one that is left
        .withColumn("taken_n", F.floor(F.col("n") * F.col("p1") + F.lit(1e-9)).cast("long"))
        .withColumn("p", F.greatest(F.col("n") * F.col("p1") - F.col("taken_n"), F.lit(0.0)))
        .withColumn("p", F.when((F.col("p") < 1e-9) | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("p")))
        .withColumn("blocks", F.ceil(F.col("units") / F.lit(BLOCK)).cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")))
    )
    names = [x.strip().split(" ")[0] for x in _UNITS.split(",")]
    level, done, state, fractional = 0, [], staged(start.select(*names), "mix-0"), (F.col("p") > 0) & (F.col("p") < 1)
    held = [units, state]
    while True:
        done.append(state.filter(~fractional))
        rest = state.filter(fractional)
        if rest.isEmpty():
            break
        level += 1
        state = staged(rest.groupBy("source", "block").applyInArrow(_fly(level, seed), _UNITS), f"mix-{level}")
        held.append(state)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = staged(out, "mix")
    discard(*held)
    extra = F.col("taken_n") + F.col("p").cast("long")
    copies = F.col("base") + (F.col("i") <= extra).cast("int")
    return out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """docs with each row as often as mix() takes it. Rows are matched by id, source and size; where several rows agree in
    these, the copies go to them in the order of their text."""
    key, of, n, rows, copies, number, times, nth = fresh(docs, "mix_id", "mix_source", "mix_size", "mix_rows", "mix_copies", "mix_words", "mix_times", "mix_nth")
    chosen = mix(docs, share, most, weights, seed).groupBy(F.col("doc_id").alias(key), F.col("source").alias(of), F.col("size").alias(n)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    chosen = chosen.filter(F.col(copies) > 0)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(of)) & (F.col(number) == F.col(n))
    # as large as docs in rows, so never broadcast
    found = docs.withColumn(number, n_words(F.col("text"))).join(chosen.hint("merge"), same)
    one = found.filter(F.col(rows) == 1).withColumn(nth, F.lit(1))
    several = found.filter(F.col(rows) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(key, of, n).orderBy("text")))
    each = F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("int")
    taken = one.unionByName(several).withColumn(times, each.cast("int")).filter(F.col(times) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)).select(*docs.columns)
