"""Chunks of bounded area and shelves of atlases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Items in order, a new chunk wherever the next item would pass the budget; an item above it stays alone. One fold
    over each key's items."""
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<ord:bigint,chunk:int>>").alias("out"))
    item = F.struct(F.col(order).cast("long").alias("ord"), F.col(size).cast("long").alias("size"))

    def step(a, x):
        opens = (a.getField("sum") > 0) & (a.getField("sum") + x.getField("size") > budget)
        chunk = a.getField("chunk") + opens.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(opens, x.getField("size")).otherwise(a.getField("sum") + x.getField("size")).alias("sum"), F.concat(a.getField("out"), F.array(F.struct(x.getField("ord").alias("ord"), chunk.alias("chunk")))).alias("out"))

    folded = items.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step, lambda a: a.getField("out")).alias("o"))
    return folded.select(key, F.explode("o").alias("x")).select(key, F.col("x.ord").alias(order), "x.chunk")


CELLS = "image_id long, ord long, x long, y long, w long, h long, scale double, atlas_w long, atlas_h long"


def shelves(side: int = 2048, rounds: int = 8, gap: int = 8):
    """For applyInArrow over (image_id, ord, w, h): cells on shelves, tallest first (by order on ties). Cells are 8 pixels at least and rounded down to even;
    the atlas's sides are multiples of 8. As long as the longer one is above `side` and the scale above 0.15, all are scaled by the excess, `rounds`
    times at most; the scale given is that of the next round where the last one didn't do."""
    import pyarrow as pa

    def even(v: int, scale: float) -> int:
        n = max(8, int(round(v * scale)))
        return n - n % 2

    def pack(key, table):
        rows = sorted(zip(table["ord"].to_pylist(), table["w"].to_pylist(), table["h"].to_pylist(), strict=True))
        scale = 1.0
        for _ in range(rounds):
            cells = [(ord_, even(w, scale), even(h, scale)) for ord_, w, h in rows]
            out, x, y, shelf, wide = [], 0, 0, 0, 8
            for ord_, w, h in sorted(cells, key=lambda c: -c[2]):
                if x > 0 and x + w > side:
                    x, y, shelf = 0, y + shelf + gap, 0
                out.append((key[0].as_py(), ord_, x, y, w, h))
                wide, x, shelf = max(wide, x + w), x + w + gap, max(shelf, h)
            size = [-(-v // 8) * 8 for v in (wide, max(y + shelf, 8))]
            if max(size) <= side or scale <= 0.15:
                break
            scale *= side / max(size)
        columns = list(zip(*[(*r, round(scale, 4), *size) for r in out], strict=True))
        names = [c.split(" ")[0] for c in CELLS.split(", ")]
        return pa.table([pa.array(c, pa.float64() if n == "scale" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    return pack
