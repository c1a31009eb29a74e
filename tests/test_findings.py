"""Small cases of what reviewers found."""

import re

import numpy as np
import pytest

from lamella.operators import masks, occlusion, raster, routing
from lamella.plans.catalogue import QUERIES
from tests.conftest import DATA

RUN = "image_id long, layer_id long, y long, x0 long, x1 long"
LAYER = "image_id long, layer_id long, z int, ord long, family string, x0 long, y0 long, x1 long, y1 long"
#: Shuffles that the plan of a query may have: of the layers (once for each side), and of what is counted for each layer.
SHUFFLES = {"mask_duplicates": 2, "components_kept": 2, "mask_close": 2, "paint_topmost": 1, "peel_owners": 3, "mask_fill_holes": 2, "run_build": 1, "naming_swap": 6, "mask_touch": 2}


def test_best_template_of_equal_means(spark):
    """The same good matches in another order have the same mean: the first member stays the best."""
    values = [0.85, 0.86, 0.88, 0.91, 0.93, 0.95, 0.97, 0.99]

    def mean(order):
        total = 0.0
        for v in order:
            total += v
        return total / len(order)

    low, high = None, None
    for k in range(6000):
        row = np.random.default_rng(k).choice(values, 16).tolist()
        orders = [row[i:] + row[:i] for i in range(16)]
        low, high = min(orders, key=mean), max(orders, key=mean)
        if round(mean(low), 4) != round(mean(high), 4):
            break
    assert round(mean(low), 4) < round(mean(high), 4)
    pool = spark.createDataFrame([("g", m, 0, 10, 10, 17) for m in range(17)], "group string, member long, k int, w long, h long, members long")
    scores = [("g", m, 0, 2 + i, v) for m, order in ((0, low), (1, high)) for i, v in enumerate(order)]
    scores = spark.createDataFrame(scores, "group string, member long, k int, other long, value double").coalesce(1)
    best = routing.best_template(pool, scores).collect()
    assert [(r.member, r.k) for r in best] == [(0, 0)]


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_masks_are_not_shuffled(spark, name):
    """Layers are dealt by image once; their rows and pixels stay there."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= SHUFFLES[name], plan
    if name not in ("mask_close", "mask_fill_holes"):
        assert "Generate explode" not in plan


def random_masks(seed, n=5, w=23, h=19):
    """Masks of n layers in each of two images, as arrays and as runs."""
    rng = np.random.default_rng(seed)
    arrays = {(i, k): rng.random((h, w)) < 0.6 for i in (1, 2) for k in range(1, n + 1)}
    rows = []
    for (i, k), m in arrays.items():
        for y in range(h):
            at = np.flatnonzero(np.diff(np.concatenate([[False], m[y], [False]])))
            rows += [(i, k, y, int(a), int(b)) for a, b in zip(at[::2], at[1::2], strict=True)]
    return arrays, rows


def painted_rows(df, w, h):
    out = {i: np.full((h, w), -1) for i in (1, 2)}
    for r in df.collect():
        assert (out[r.image_id][r.y, r.x0 : r.x1] == -1).all()
        out[r.image_id][r.y, r.x0 : r.x1] = r.layer_id
    return out


def test_masks_of_several_images(spark):
    """Several layers and images at a time, against arrays."""
    w, h, n = 23, 19, 5
    arrays, rows = random_masks(7)
    runs = spark.createDataFrame(rows, RUN)
    layers = [(i, k, k % 3, 10 - k, "f", 3 * k, 2 * k, 3 * k + 5, 2 * k + 4) for i in (1, 2) for k in range(1, n + 1)]
    layer = spark.createDataFrame(layers, LAYER)
    top = painted_rows(raster.painted(runs.join(layer.select("image_id", "layer_id", "z", "ord"), ["image_id", "layer_id"])), w, h)
    own = painted_rows(masks.owners(layer, runs), w, h)
    touch = {tuple(r) for r in occlusion.touching(layer, runs).collect()}
    for i in (1, 2):
        for y in range(h):
            for x in range(w):
                has = [v for v in layers if v[0] == i and arrays[i, v[1]][y, x]]
                assert top[i][y, x] == (max(has, key=lambda v: (v[2], v[3]))[1] if has else -1)
                far = lambda v: np.float32(np.sqrt((x - (v[5] + v[7]) / 2) ** 2 + (y - (v[6] + v[8]) / 2) ** 2))  # noqa: B023, E731
                assert own[i][y, x] == (min(has, key=lambda v: (far(v), -v[3]))[1] if has else -1)
    grown = {k: np.any([np.pad(m, 2)[2 + a : 2 + a + h, 2 + b : 2 + b + w] for a in range(-2, 3) for b in range(-2, 3)], axis=0) for k, m in arrays.items()}
    assert touch == {(a[0], a[1], b[1]) for a in layers for b in layers if a[0] == b[0] and b[2] > a[2] and (arrays[a[:2]] & grown[b[:2]]).sum() > 20}


def test_twins_of_runs_and_bands(spark):
    boxes = [(1, 1, 0, 1, "a", 0, 0, 30, 30), (1, 2, 0, 2, "a", 1, 0, 31, 30), (1, 3, 0, 3, "b", 0, 1, 30, 31), (1, 4, 0, 4, "b", 60, 0, 90, 30), (2, 1, 0, 1, "a", 0, 0, 30, 30)]
    layer = spark.createDataFrame(boxes, LAYER)
    got = [sorted(tuple(r) for r in masks.duplicates(layer, m).collect()) for m in (raster.from_boxes(layer), raster.bands(layer))]
    iou = lambda shared: round(shared / (1800 - shared), 3)
    assert got[0] == got[1] == [(1, 2, 1, iou(29 * 30)), (1, 3, 2, iou(29 * 29))]


def test_kept_components_of_overlapping_boxes(spark):
    """Overlapping boxes of one mask are one component; an image without points keeps its largest one."""
    boxes = [(1, 1, 0, 0, 5, 5), (1, 1, 3, 3, 9, 9), (1, 1, 20, 0, 22, 2), (2, 1, 0, 0, 2, 2), (2, 1, 8, 8, 12, 12)]
    band = raster.bands(spark.createDataFrame(boxes, "image_id long, layer_id long, x0 long, y0 long, x1 long, y1 long"))
    points = spark.createDataFrame([(1, 1, 21, 1), (1, 7, 0, 0)], "image_id long, layer_id long, px long, py long")
    assert sorted(tuple(r) for r in masks.kept(band, points, 0.5).collect()) == [(1, 1, 0, 57, False), (1, 1, 1, 4, True), (2, 1, 1, 16, False)]


def test_alpha_and_holes_deals_layers_by_image(spark):
    """neither pixels nor runs are shuffled, nor what is counted of them; only layers are, and the list of images."""
    plan = QUERIES["alpha_and_holes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) <= 4 and all(re.fullmatch(r"_?image_id#\d+L, \d+", k) for k in keys), plan
    assert "Join" not in plan


@pytest.mark.parametrize("touch", [False, True])
def test_alpha_holes_and_account_of_several_images(spark, touch):
    """against sets of pixels; with siblings, reverted drops, children, text, a mask without a layer and an edge to nothing."""
    w, h, n, reach, least = 23, 19, 5, 2, 0.8
    arrays, rows = random_masks(11)
    rows += [(2, 77, 3, 4, 9)]
    layers = [(i, k, k % 3, 10 - k, "surface" if k % 2 else "image", 3 * k, 2 * k, 3 * k + 9 + i, 2 * k + 12) for i in (1, 2) for k in range(1, n + 1)]
    layer = spark.createDataFrame(layers, "image_id long, layer_id long, z int, ord long, mode string, x0 long, y0 long, x1 long, y1 long")
    kin = [(1, 1, 2, True), (2, 3, 1, True), (2, 4, 99, True), (1, 5, 4, False), (1, 1, 5, False), (2, 77, 1, True)]
    edges = spark.createDataFrame(kin, "image_id long, under_id long, over_id long, child boolean")
    text = spark.createDataFrame([(1, 4, 3, 9), (1, 4, 7, 15), (2, 8, 0, 30)], "image_id long, y long, x0 long, x1 long")
    written = {1: {(4, x) for x in range(3, 15)}, 2: {(8, x) for x in range(30)}}
    over = [(i, u, o, c) for i, u, o, c in kin]
    if touch:
        over += [(r.image_id, r.under_id, r.over_id, False) for r in occlusion.edges(layer.withColumn("id", layer.layer_id), touch=True).collect()]
        assert len(over) > len(kin)
    mask = {key: {(int(y), int(x)) for y, x in np.argwhere(m)} for key, m in arrays.items()} | {(2, 77): {(3, x) for x in range(4, 9)}}
    by = {v[:2]: v for v in layers}
    want, alphas, holes = {}, set(), set()
    for i, k in mask:
        pre = mask[i, k]
        drop, hollow, come, v = set(), set(), set(), by.get((i, k))
        if v:
            for y, x in pre:
                far = lambda v: np.float32(np.sqrt((x - (v[5] + v[7]) / 2) ** 2 + (y - (v[6] + v[8]) / 2) ** 2))  # noqa: B023, E731
                own = min((b for b in layers if b[0] == i and (y, x) in mask[b[:2]]), key=lambda v: (far(v), -v[3]))  # noqa: B023
                if own[1] != k and own[2] >= v[2]:
                    (drop if own[2] == v[2] else hollow).add((y, x))
            for at, u, o, child in over:
                if (at, u) == (i, k) and (b := by.get((i, o))):
                    shared = max(0, min(v[7], b[7]) - max(v[5], b[5])) * max(0, min(v[8], b[8]) - max(v[6], b[6]))
                    if child or shared >= 0.5 * (b[7] - b[5]) * (b[8] - b[6]):
                        come |= mask[i, o]
        reverted = len(pre) - len(drop) < least * len(pre)
        drop = set() if reverted else drop
        come -= drop
        alpha = (pre - drop) | come
        grown = {(y + a, x + b) for y, x in hollow | come for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)}
        hole = alpha & (grown | (written[i] if v and v[4] == "surface" else set()))
        want[i, k] = (len(pre), len(alpha), len(hole), len(drop), len(hollow), reverted)
        alphas |= {(i, k, *p) for p in alpha}
        holes |= {(i, k, *p) for p in hole}
    assert {v[5] for v in want.values()} == {False, True} and any(v[3] for v in want.values()) and any(v[4] for v in want.values())
    runs = spark.createDataFrame(rows, RUN)
    got = masks.account(layer, runs, edges, w, h, text, reach, least, touch=touch).collect()
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got} == want and len(got) == len(want)
    parts = masks.alpha_and_holes(layer, runs, edges, w, h, text, reach, least, touch=touch)
    for df, pixels in zip(parts, (alphas, holes), strict=False):
        found = [(r.image_id, r.layer_id, r.y, x) for r in df.collect() for x in range(r.x0, r.x1)]
        assert len(found) == len(pixels) and set(found) == pixels
    assert {tuple(r)[:2]: tuple(r)[2:] for r in parts[2].collect()} == {k: (v[0], v[1], *v[3:]) for k, v in want.items() if v[3] or v[4] or v[5]}
