"""Ties, empty inputs and borders of the layer operators."""

import json

import numpy as np
from pyspark.sql import functions as F

from lamella.functions.geometry import from_hex, half_even, hex_colour
from lamella.functions.text import family_of, has_cjk, is_number, json_in
from lamella.operators import dense, gates, occlusion, pack, plan, raster, scoring, stats
from lamella.sources.tables import cached, parsed, plans, with_overrides
from lamella.streaming.plans import call_counts, incoming

BOX = "image_id long, ord long, id string, z int, mode string, x0 long, y0 long, x1 long, y1 long"
RUN = "image_id long, layer_id long, y long, x0 long, x1 long"


def test_functions(spark):
    r = spark.range(1).select(half_even(F.lit(2.5)).alias("a"), half_even(F.lit(3.5)).alias("b"), hex_colour(F.lit(255), F.lit(0), F.lit(16)).alias("c"), from_hex(F.lit("#ff0010")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (2, 4, "#ff0010", [255, 0, 16])
    rows = spark.createDataFrame([("設定",), ("٣٤٥",), ("12",), ("btn_r1c2",), ("_3",), ("a_h1_2",)], "t string")
    got = {r.t: (r.c, r.n, r.f) for r in rows.select("t", has_cjk(F.col("t")).alias("c"), is_number(F.col("t")).alias("n"), family_of(F.col("t")).alias("f")).collect()}
    assert got["設定"][0] and got["٣٤٥"][1] and not got["12"][1]
    assert (got["btn_r1c2"][2], got["_3"][2], got["a_h1_2"][2]) == ("btn", "_3", "a_h1")
    answers = spark.createDataFrame([('{"a": 1}',), ('x\n```json\n{"a": 2}\n```',), ('so {"a": 3} it is',), ("nothing",), (None,)], "c string")
    assert [r[0] and json.loads(r[0])["a"] for r in answers.select(json_in(F.col("c"))).collect()] == [1, 2, 3, None, None]


def test_occlusion_borders(spark):
    rows = [(1, 1, "a", 0, "image", 0, 0, 10, 10), (1, 2, "b", 1, "none", 0, 0, 10, 10), (1, 3, "c", 1, "image", 10, 0, 40, 10), (1, 4, "d", 2, "none", 5, 0, 16, 10), (1, 5, "e", 0, "image", 0, 0, 300, 300), (1, 6, "f", 5, "none", 250, 250, 290, 290)]
    e = {(r.under_id, r.over_id) for r in occlusion.edges(spark.createDataFrame(rows, BOX)).collect()}
    # exactly 100 pixels is not enough, equal z is no edge, touching boxes share nothing, each pair over several tiles comes once
    assert e == {("e", "f"), ("e", "c"), ("e", "d")}
    assert occlusion.edges(spark.createDataFrame([], BOX)).count() == 0


def test_grid_of_cards(spark):
    """Cards in a grid, each with a lock and a badge over it: exactly these edges."""
    rows, want, n = [], set(), 0
    for i in range(4):
        for j in range(3):
            x, y = 300 * i, 400 * j
            for name, z, b in (("card", 1, (0, 0, 200, 300)), ("lock", 2, (20, 20, 60, 60)), ("badge", 3, (150, 250, 190, 290))):
                n += 1
                rows.append((1, n, f"{name}_{i}_{j}", z, "image" if name == "card" else "none", x + b[0], y + b[1], x + b[2], y + b[3]))
            want |= {(f"card_{i}_{j}", f"lock_{i}_{j}"), (f"card_{i}_{j}", f"badge_{i}_{j}")}
    layers = spark.createDataFrame(rows, BOX)
    edges = occlusion.edges(layers)
    assert {(r.under_id, r.over_id) for r in edges.collect()} == want
    assert {r.id for r in occlusion.needs_repair(layers, edges).filter("needs_repair").collect()} == {f"card_{i}_{j}" for i in range(4) for j in range(3)}


def masks(runs, h=40, w=60):
    out = {}
    for image, layer, y, x0, x1 in runs:
        out.setdefault((image, layer), np.zeros((h, w), bool))[y, x0:x1] = True
    return out


def test_runs_against_arrays(spark):
    rng = np.random.default_rng(3)
    runs = [(1, int(rng.integers(3)), int(y), int(x), int(min(50, x + rng.integers(1, 12)))) for y, x in zip(rng.integers(8, 30, 80), rng.integers(6, 48, 80), strict=True)]
    df = spark.createDataFrame(runs, RUN)
    want = masks(runs)
    rows = lambda d: masks([(r.image_id, r.layer_id, r.y, r.x0, r.x1) for r in d.collect()])
    same = lambda a, b: all((a.get(k, np.zeros((40, 60), bool)) == v).all() for k, v in b.items())
    assert same(rows(raster.coalesced(df)), want)
    grown = {k: np.zeros_like(v) for k, v in want.items()}
    for k, v in want.items():
        for dy in range(-2, 2):
            for dx in range(-2, 2):
                grown[k] |= np.roll(np.roll(v, dy, 0), dx, 1)
    assert same(rows(raster.dilate(df, 2, 1, 2, 1)), grown)
    one, other = df.filter("layer_id = 0"), raster.union(df.filter("layer_id = 1"))
    assert same(rows(raster.subtract(raster.coalesced(one), other)), {(1, 0): want[1, 0] & ~want[1, 1]})
    shared = {(r.a_id, r.b_id): r.pixels for r in raster.intersect(raster.coalesced(one), raster.coalesced(df.filter("layer_id = 2"))).collect()}
    assert shared == {(0, 2): int((want[1, 0] & want[1, 2]).sum())}
    assert raster.coalesced(spark.createDataFrame([], RUN)).count() == 0


def test_components(spark):
    runs = [(1, 1, 0, 0, 3), (1, 1, 1, 3, 5), (1, 1, 2, 0, 1), (1, 1, 2, 5, 6), (1, 1, 5, 0, 9)]
    df = spark.createDataFrame(runs, RUN)
    for eight, n in ((True, 3), (False, 5)):
        got = df.groupBy("image_id", "layer_id").applyInArrow(dense.components(eight), dense.LABELS)
        assert got.select("label").distinct().count() == n


def test_candidates(spark):
    c = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, 0.5), (1, 2, 0, 0.2)], "image_id long, layer_id long, k int, score double")
    got = {r.layer_id: (r.k, r.margin) for r in scoring.best(c).collect()}
    assert got == {1: (0, 0.0), 2: (0, None)}
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int")
    assert v.agg(scoring.upper_median("x")).first()[0] == 3


def test_gates(spark):
    t = spark.createDataFrame([("a", 0.3, 1, 9), ("a", 0.5, 1, 9), ("ab", 0.5, 1, 9), ("ab", 0.5, 0, 9), ("a", 0.9, 1, 9)], "text string, score double, w int, h int")
    assert [r[0] for r in t.select(gates.text_reason()).collect()] == ["low_conf", "single_latin", "vertical_deco", None, None]
    a = spark.createDataFrame([(1, 1, False, None), (1, 2, True, None), (2, 1, False, "x"), (2, 2, True, None)], "key int, ord int, accepted boolean, error string")
    assert {r.key: (r.accepted_at, r.used) for r in gates.first_accepted(a, "key", ["ord"]).collect()} == {1: (2, 2), 2: (None, 1)}


def test_chunks_and_shelves(spark):
    items = spark.createDataFrame([(1, 1, 900), (1, 2, 10), (1, 3, 80), (1, 4, 20)], "image_id long, ord long, size long")
    assert {r.ord: r.chunk for r in pack.chunked(items, "image_id", "ord", "size", 100).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    boxes = spark.createDataFrame([(1, k, 100 + 13 * k % 300, 50 + 29 * k % 200) for k in range(60)], "image_id long, ord long, w long, h long")
    cells = boxes.groupBy("image_id").applyInArrow(pack.shelves(512), pack.CELLS).collect()
    assert len(cells) == 60 and all(c.w % 2 == c.h % 2 == 0 and c.x + c.w <= c.atlas_w and c.y + c.h <= c.atlas_h for c in cells)
    assert not any(a.ord < b.ord and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h for a in cells for b in cells)


def test_statistics(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.normal(60, 9, 400), rng.normal(180, 12, 300))).clip(0, 255).astype(int)
    level = stats.otsu(spark.createDataFrame([(1, int(x)) for x in v], "g int, v int"), "g", "v").first().level
    assert 80 < level < 150
    template = rng.random((5, 6))
    image = rng.random((30, 40))
    image[11:16, 20:26] = template * 3 + 1
    y, x, value = dense.match(template, image)
    assert (y, x) == (11, 20) and value > 0.999


def test_plan_documents(spark, tmp_path):
    doc = {"source": "a", "queries": [{"id": "q", "kind": "", "role": None, "element_repair_mode": "odd", "z_order": "x", "geometry_hints": [None, {"bbox_norm": [0, 0, 1, 1]}]}, {"id": "none", "geometry_hints": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("not json")
    got = plans(spark, str(tmp_path))
    assert got.count() == 2 and got.filter("queries is null").count() == 1
    assert parsed(spark.createDataFrame([(1, json.dumps(doc)), (2, "{")], "k int, json string")).filter("queries is not null").count() == 1
    name = incoming(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    name.awaitTermination()
    q = plan.expand(plan.normalise(spark.table("arrived")))
    r = q.collect()
    assert [(x.id, x.kind, x.role, x["mode"], x.z, x.instance_count) for x in r] == [("q", "icon", "foreground", "none", 0, 1)]


def test_sources(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, "a", 5)], "k int, style string, margin int")
    o = spark.createDataFrame([(2, "b", 9)], "k int, style string, other int")
    assert sorted(tuple(r) for r in with_overrides(d, o, "k", ["style"]).collect()) == [(1, "a", 5), (2, "b", 5)]
    hit, miss = cached(d.withColumnRenamed("k", "cache_key"), spark.createDataFrame([(1, "x")], "cache_key int, image string"))
    assert hit.count() == miss.count() == 1
    calls = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind, 2.0 AS seconds UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0")
    assert [(r.n, float(r.seconds)) for r in call_counts(calls).collect()] == [(2, 5.0)]
