"""Trees against plain recursive ones, and both ways of growing them against each other."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablelearn.operators import trees
from tablelearn.operators.trees import TreeFit, TreePlan, drawn_columns, drawn_rows
from tablelearn.session import Workspace


def rows_of(n, columns, classes, seed=1, values=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, columns)).astype(float)
    score = x[:, 0] * 2 - x[:, 1] + rng.normal(size=n) * 2
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes)).astype(float) if classes else score
    return x, y


def table(spark, x, y, folds=None):
    data = [(Vectors.dense(r), float(t), int(f)) for r, t, f in zip(x, y, folds if folds is not None else np.zeros(len(x)))]
    return spark.createDataFrame(data, ["features", "__label", "fold"]).coalesce(1)


# --- plain trees ------------------------------------------------------------


def plain_split(x, sums, plan, columns):
    """(gain, -column, cut) of the best split, or None."""
    best = None
    score = lambda s: (s[:-2] ** 2).sum() / (s[-2] + plan.penalty) if s[-2] + plan.penalty > 0 else 0.0
    for c in np.flatnonzero(columns):
        values = np.unique(x[sums[:, -1] > 0, c])
        for low, high in zip(values, values[1:]):
            left = x[:, c] <= low
            one, two = sums[left].sum(0), sums[~left].sum(0)
            if min(one[-1], two[-1]) < plan.min_leaf:
                continue
            gain = float(np.float32(score(one) + score(two) - score(one + two)))
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, c, low, high)
    return best


def plain_tree(x, sums, plan, tree):
    """Nodes as (column, low, high, left, right, value); children by number, nodes numbered as they are split."""
    nodes, where, depths = [[-1, None, None, -1, -1]], [np.ones(len(x), dtype=bool)], [0]
    value = lambda m: sums[m].sum(0)[:-2] / (sums[m].sum(0)[-2] + plan.penalty)

    def best(n):
        total = sums[where[n]].sum(0)[-1]
        if plan.max_depth is not None and depths[n] >= plan.max_depth or total < plan.min_split:
            return None
        return plain_split(x[where[n]], sums[where[n]], plan, drawn_columns(plan, tree, [n], x.shape[1])[0])

    def split(n, found):
        _, c, low, high = found
        left = where[n] & (x[:, c] <= low)
        nodes[n] = [c, low, high, len(nodes), len(nodes) + 1]
        for m in (left, where[n] & ~left):
            nodes.append([-1, None, None, -1, -1])
            where.append(m)
            depths.append(depths[n] + 1)
        return len(nodes) - 2, len(nodes) - 1

    if plan.max_leaves is None:
        level = [0]
        while level:
            answers = [(n, best(n)) for n in level]
            level = [c for n, f in answers if f for c in split(n, f)]
    else:
        open_ = {0: best(0)}
        leaves = 1
        while leaves < plan.max_leaves and any(open_.values()):
            n = max((n for n in open_ if open_[n]), key=lambda n: (open_[n][0], -n))
            for c in split(n, open_.pop(n)):
                open_[c] = best(c)
            leaves += 1
    return nodes, [value(m) for m in where], where


def leaves_of(nodes, values, x):
    out = []
    for r in x:
        n = 0
        while nodes[n][0] >= 0:
            n = nodes[n][3] if r[nodes[n][0]] <= nodes[n][1] else nodes[n][4]
        out.append(values[n])
    return np.array(out)


def same(one, two):
    """Whether two trees have the same splits, and values to rounding."""
    if len(one) != len(two) or len(one) != 4:
        return one == pytest.approx(two, abs=1e-8)
    return one[:2] == two[:2] and same(one[2], two[2]) and same(one[3], two[3])


def shape(tree, n=0):
    """A tree without its numbering: (column, cut, left, right), or a list of values."""
    if tree["column"][n] < 0:
        return [float(v) for v in tree["value"][n]]
    return (int(tree["column"][n]), float(tree["cut"][n]), shape(tree, tree["left"][n]), shape(tree, tree["right"][n]))


def plain_shape(nodes, values, n=0):
    c, low, high, left, right = nodes[n]
    if c < 0:
        return [float(v) for v in values[n]]
    return (int(c), float(low + high) / 2, plain_shape(nodes, values, left), plain_shape(nodes, values, right))


def whole_cuts(x, nodes):
    """Cuts lie halfway between neighbouring values of the column in the whole table."""
    for node in nodes:
        if node[0] >= 0:
            values = np.unique(x[:, node[0]])
            node[2] = values[np.searchsorted(values, node[1]) + 1]


BOOSTED = {
    "numbers": TreePlan(True, 0, 3, max_depth=3, rate=0.4, subsample=0.7, tree_columns=0.7),
    "two classes": TreePlan(True, 2, 3, max_depth=4, rate=0.3, min_leaf=3, penalty=1.0),
    "three classes": TreePlan(True, 3, 3, max_depth=3, rate=0.5, subsample=0.8),
    "by leaves": TreePlan(True, 0, 3, max_leaves=9, rate=0.3),
    "classes by leaves": TreePlan(True, 3, 2, max_leaves=7, max_depth=4, min_leaf=2),
}


@pytest.mark.parametrize("name", BOOSTED)
@pytest.mark.parametrize("spread", [False, True])
def test_boosting_is_the_plain_one(spark, monkeypatch, name, spread):
    plan = BOOSTED[name]
    x, y = rows_of(150, 3, plan.classes)
    if spread:
        monkeypatch.setattr(trees, "SMALL_ROWS", 0)
        monkeypatch.setattr(trees, "WRITTEN", 2)
    model = TreeFit(plan).fit(table(spark, x, y))
    margins, rows = np.zeros((len(x), plan.width)), np.arange(len(x))
    expected = []
    for t in range(plan.trees):
        added = []
        for k in range(plan.width):
            if not plan.classes:
                g, h = y - margins[:, 0], np.ones(len(y))
            elif plan.width == 1:
                p = 1 / (1 + np.exp(-margins[:, 0]))
                g, h = y - p, p * (1 - p)
            else:
                p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
                g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])
            seen = drawn_rows(plan, t, rows)
            nodes, values, _ = plain_tree(x, np.column_stack([g * seen, h * seen, seen]), plan, t)
            whole_cuts(x, nodes)
            expected.append(plain_shape(nodes, values))
            added.append((k, leaves_of(nodes, values, x)[:, 0]))
        for k, v in added:
            margins[:, k] += v * (plan.rate if t else 1.0)
    got = [shape(t) for t in model.trees]
    assert len(got) == len(expected) and all(map(same, got, expected))
    scored = model.transform(table(spark, x, y)).collect()
    if not plan.classes:
        assert [r["prediction"] for r in scored] == pytest.approx(margins[:, 0].tolist())
    elif plan.width > 1:
        p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
        assert np.array([r["probability"].toArray() for r in scored]) == pytest.approx(p)
    else:
        assert [r["probability"][1] for r in scored] == pytest.approx((1 / (1 + np.exp(-margins[:, 0]))).tolist())


FORESTS = {
    "classes": TreePlan(False, 3, 12, root_columns=True),
    "split and leaf sizes": TreePlan(False, 2, 3, min_split=15, min_leaf=4, root_columns=True),
    "numbers": TreePlan(False, 0, 3, max_depth=5),
    "all rows": TreePlan(False, 2, 2, bootstrap=False),
}


@pytest.mark.parametrize("name", FORESTS)
@pytest.mark.parametrize("spread", [False, True])
def test_forests_are_the_plain_ones(spark, monkeypatch, name, spread):
    plan = FORESTS[name]
    x, y = rows_of(90, 5, plan.classes, seed=3)
    y = np.round(y)
    if spread:
        monkeypatch.setattr(trees, "SMALL_ROWS", 0)
    model = TreeFit(plan).fit(table(spark, x, y))
    assert len(model.trees) == plan.trees
    total = np.zeros((len(x), plan.width))
    for t, got in enumerate(model.trees):
        seen = drawn_rows(plan, t, np.arange(len(x)))
        hit = (y[:, None] == np.arange(plan.classes)) * 1.0 if plan.classes else y[:, None]
        sums = np.column_stack([hit * seen[:, None], seen, seen])
        nodes, values, where = plain_tree(x, sums, plan, t)
        whole_cuts(x, nodes)
        assert same(shape(got), plain_shape(nodes, values))
        total += leaves_of(nodes, values, x)
        for node, rows in zip(nodes, where):
            size = sums[rows, -1].sum()
            assert size >= plan.min_leaf and (node[0] < 0 or size >= plan.min_split)
    scored = model.transform(table(spark, x, y)).collect()
    if plan.classes:
        assert np.array([r["probability"].toArray() for r in scored]) == pytest.approx(total / total.sum(1, keepdims=True))
    else:
        assert [r["prediction"] for r in scored] == pytest.approx((total[:, 0] / plan.trees).tolist())


def test_leaves_bound_leaves_and_not_depth(spark):
    x = np.arange(64.0)[:, None]
    y = 3.0 ** np.arange(64)
    model = TreeFit(TreePlan(True, 0, 1, max_leaves=6)).fit(table(spark, x, y))
    tree = model.trees[0]
    depth, level = 0, [0]
    while level:
        level = [c for n in level if tree["column"][n] >= 0 for c in (tree["left"][n], tree["right"][n])]
        depth += bool(level)
    assert (tree["column"] < 0).sum() == 6 and depth == 5


@pytest.mark.parametrize("boosted, classes", [(True, 0), (True, 2), (True, 3), (False, 0), (False, 3)])
def test_both_ways_of_making_many_fits_agree(spark, boosted, classes):
    x, y = rows_of(120, 4, classes, seed=5)
    folds = np.arange(120) % 3
    plans = [
        TreePlan(boosted, classes, n, max_depth=d, rate=0.3, subsample=0.8, fold=f, root_columns=not boosted)
        for n, d in ((4, 3), (7, 2))
        for f in range(3)
    ]
    seen = []
    for grow in (trees._in_tasks, trees._by_levels):
        with Workspace(spark) as work:
            binned = trees.bin_table(table(spark, x, y, folds), work, 256, "fold")
            assert binned.small
            found = grow(binned, plans, False).orderBy("fit", "row").toPandas()
            assert trees.held_out_predictions(binned, plans).count() == len(found)
            seen.append(found.to_numpy())
    assert len(seen[0]) == 2 * len(x) and seen[0] == pytest.approx(seen[1], abs=1e-8)
    one = TreeFit(TreePlan(boosted, classes, 4, max_depth=3, rate=0.3, subsample=0.8, root_columns=not boosted))
    assert len(one.fit(table(spark, x, y)).trees) == 4 * (3 if boosted and classes == 3 else 1)


def test_few_values_have_a_bin_each_and_many_share_them(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 7, 5000), rng.normal(size=5000), np.zeros(5000)])
    df = table(spark, x, x[:, 0]).repartition(4)
    cuts = trees.learn_cuts(df, 32)
    assert cuts[0].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and not len(cuts[2])
    sizes = np.bincount(np.searchsorted(cuts[1], x[:, 1]))
    assert len(sizes) <= 32 and sizes.max() < 2.5 * 5000 / 32


def test_models_survive_storage(spark, tmp_path):
    x, y = rows_of(60, 3, 3)
    df = table(spark, x, y)
    model = TreeFit(TreePlan(True, 3, 3, max_depth=2)).fit(df)
    PipelineModel(stages=[model]).write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).collect() == model.transform(df).collect()


def test_importances_name_the_column_that_decides(spark):
    x, y = rows_of(200, 4, 2)
    weights = TreeFit(TreePlan(False, 2, 20, root_columns=True)).fit(table(spark, x, y)).featureImportances.toArray()
    assert weights.argmax() == 0 and weights.sum() == pytest.approx(1)


def test_odd_tables(spark):
    one = table(spark, np.zeros((1, 2)), np.zeros(1))
    for plan in (TreePlan(True, 2, 2), TreePlan(False, 2, 2), TreePlan(True, 0, 2, max_leaves=4)):
        model = TreeFit(plan).fit(one)
        assert model.transform(one).count() == 1 and model.featureImportances.toArray().sum() == 0
        assert model.transform(one.limit(0)).collect() == []


def test_long_tables_reach_the_tasks_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trees, "PIECE_ROWS", 50_000)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, 210_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x.astype(float), "__label": (x > 4).astype(float)})).repartition(3)
    df = df.select(array_to_vector(F.array("x")).alias("features"), "__label")
    with Workspace(spark) as work:
        binned = trees.bin_table(df, work)
        assert binned.small
        sent = trees._send(binned)
        sizes = [len(piece.value[1]) // 8 for piece in sent]
        assert sum(sizes) == len(x) and max(sizes) <= 50_000
        got, label, _, rows = trees._received(sent, 1, binned.kind)
        assert ((got[0] > 4) == label).all() and len(set(rows.tolist())) == len(x)
        model = trees.fit_trees(binned, TreePlan(True, 2, 2, max_depth=2))
    assert model.transform(df).where("prediction <> __label").count() == 0


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_sums_of_gradients_are_the_same_in_any_order(classes):
    rng = np.random.default_rng(6)
    plan, n = TreePlan(True, classes, subsample=0.7), 3_000
    label = rng.integers(0, classes, n).astype(float) if classes else rng.normal(size=n) * 1e5
    margins, step = rng.normal(size=(n, plan.width)), trees.grid(n, 1.0 if classes else np.abs(label).max())
    sums = trees.gradients(plan, label, margins, 0, 0, np.arange(n), step)
    orders = [rng.permutation(n) for _ in range(5)]
    assert len({tuple(sums[o].cumsum(axis=0)[-1]) for o in orders}) == 1


def test_models_are_kept_in_little_space(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2_000, 3)), rng.normal(size=2_000)
    model = TreeFit(TreePlan(False, 0, 10)).fit(table(spark, x, y))
    nodes = sum(len(t["column"]) for t in model.trees)
    assert nodes > 10_000 and sum(map(len, model.known["parts"])) < 10 * nodes


@pytest.mark.parametrize("own", [False, True])
def test_columns_are_summed_together(monkeypatch, own):
    rng = np.random.default_rng(9)
    plan = TreePlan(False, 2, root_columns=own)
    x, slot = rng.integers(0, 40, (9, 600)).astype("uint8"), rng.integers(0, 3, 600)
    label, seen = (rng.random(600) < 0.4).astype(float), rng.integers(1, 4, 600).astype(float)
    parts = trees.parts_of(plan, label, np.zeros((0, 2)), 0, seen, 0.0)
    open_ = trees.drawn_columns(plan, 0, [0, 1, 2], 9)
    plain, cells, calls = [], trees._cells, []
    for n in range(3):
        for c in np.flatnonzero(open_[n]):
            mine = slot == n
            sums = np.column_stack([np.bincount(x[c][mine], weights=p[mine], minlength=40) for p in parts])
            plain.append((n, trees.best_bin(sums, int(c), plan)))
    best = {n: max((s for m, s in plain if m == n), key=lambda s: (s.gain, -s.column)) for n in range(3)}
    for values in (trees.VALUES, 1):
        monkeypatch.setattr(trees, "VALUES", values)
        monkeypatch.setattr(trees, "_cells", lambda *a: calls.append(1) or cells(*a))
        found = trees.best_splits(x, None, slot, parts, open_, 40, plan)
        for n, s in best.items():
            assert (found.gain[n], found.column[n], found.bin[n]) == (s.gain, s.column, s.bin)
            assert found.left[n].tolist() == s.left.tolist() and (found.total[n] - found.left[n]).tolist() == s.right.tolist()
        if values > 1:
            # Nine columns take two steps, the three of a node one.
            assert len(calls) == (1 if own else 2)


def test_nodes_of_one_class_are_not_searched(monkeypatch):
    x = np.arange(64, dtype="uint8")[None, :]
    label, searched, search = (np.arange(64) >= 32).astype(float), [], trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda *a: searched.append(len(a[4])) or search(*a))
    plan = TreePlan(False, 2)
    parts = trees.parts_of(plan, label, np.zeros((0, 2)), 0, np.ones(64), 0.0)
    tree, _ = trees.grow_tree(plan, 0, x, parts, 64)
    assert searched == [1] and tree["column"].tolist() == [0, -1, -1]


def test_importances_take_a_task_for_each_tree(spark, monkeypatch):
    x, y = rows_of(80, 4, 2)
    plan, taken = TreePlan(False, 2, 23, root_columns=True), []
    with Workspace(spark) as work:
        binned = trees.bin_table(table(spark, x, y), work)
        context, ranged = binned.df.sparkSession, type(binned.df.sparkSession).range
        monkeypatch.setattr(type(context), "range", lambda self, *a: taken.append(a[-1]) or ranged(self, *a))
        got = trees.fit_importances(binned, plan)
        monkeypatch.undo()
        assert taken == [23]
        assert got == trees.fit_trees(binned, plan).featureImportances


@pytest.mark.parametrize("classes, values", [(0, 4), (2, 200), (3, 200)])
def test_java_grows_the_trees_that_arrays_give(spark, monkeypatch, classes, values):
    assert trees.grower.loader(spark) is not None
    monkeypatch.setattr(trees, "_in_python", None)
    x, y = rows_of(4_000, 4, classes, seed=11, values=values)
    plans = [
        TreePlan(True, classes, 4, max_depth=6, subsample=0.7, tree_columns=0.8),
        TreePlan(True, classes, 4, max_depth=5, max_leaves=20, min_leaf=3, penalty=1.0),
        TreePlan(False, classes, 12, min_split=5, min_leaf=2, root_columns=classes > 0),
    ]
    with Workspace(spark) as work:
        binned = trees.bin_table(table(spark, x, y, np.arange(len(x)) % 3), work, 256, "fold")
        own = binned.df.toPandas().sort_values("row")
        bins = np.frombuffer(b"".join(own["bins"]), dtype=binned.kind).reshape(-1, 4).T
        arrays = [own[k].to_numpy() for k in ("label", "fold", "row")]
        for plan in plans:
            plan = replace(plan, fold=1)
            [parts] = trees._in_tasks(binned, [plan], True).values()
            got = [t for p in parts for t in trees._unpack(p)]
            expected, margins = trees.grow_rounds(plan, bins, *arrays, range(plan.rounds()), binned.step(plan), True)
            assert [t[:2] for t in got] == [t[:2] for t in expected]
            for (_, _, one), (_, _, two) in zip(got, expected):
                leaf = two["column"] < 0
                assert all((one[k] == two[k]).all() for k in ("column", "bin", "left", "right"))
                assert one["value"][leaf] == pytest.approx(two["value"][leaf])
                assert one["gains"] == pytest.approx(trees.gains_by_column(two, 4))
            held = trees._in_tasks(binned, [plan], False).orderBy("row").toPandas()
            assert held["row"].tolist() == own["row"][own["fold"] == 1].tolist()
            assert held[trees._margin_names(plan.width)].to_numpy() == pytest.approx(margins)


def test_rows_of_the_same_bins_come_as_one_cell(spark):
    x = np.array([[i % 3, i % 2] for i in range(600)], dtype=float)
    with Workspace(spark) as work:
        binned = trees.bin_table(table(spark, x, x[:, 0]), work)
        sent = trees.grower.send(trees._pieces(binned), 2, 1)
        coded, start, label, fold, rows = sent.value()
        assert len(coded) == 12 and sorted(np.diff(list(start))) == [100] * 6
        assert sorted(rows) == sorted(r["row"] for r in binned.df.select("row").collect())
        for a, b in zip(list(start), list(start)[1:]):
            assert len(set(list(label)[a:b])) == 1
        sent.destroy()
