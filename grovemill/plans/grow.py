"""Growing trees level by level: one histogram query and one split search for all nodes of a pass, over all trees."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemill.operators.histogram import Counter, arrow_histogram, sql_histogram, width
from grovemill.operators.impurity import Impurity
from grovemill.operators.split import ORDERED, RANDOM, Found, best_local, impurity_of, prediction_of, search, weight_of
from grovemill.plans.trees import MULTIWAY, NUMERIC, SUBSET, Feature, Flat, Node, Split, Tree

ENGINES = {"arrow": arrow_histogram, "sql": sql_histogram}


@dataclass(frozen=True)
class GrowOptions:
    """classes: 0 for regression. impurity: None for variance or entropy, by classes. mtry: features of a node, None for all.
    max_depth counts the root as 1. Nodes of subtree_weight or less are grown whole in one task each (0: never), max_subtrees at once."""

    classes: int = 0
    mtry: int | None = None
    max_depth: int = 30
    min_split: float = 2
    categories: str = ORDERED
    max_splits: int = 1024
    subtree_weight: float = 0
    max_subtrees: int = 10_000
    engine: str = "arrow"
    seed: int = 1
    impurity: Impurity | None = None

    def __post_init__(self) -> None:
        if self.categories not in (ORDERED, RANDOM, MULTIWAY) or self.engine not in ENGINES:
            raise ValueError(f"no such way: {self.categories}, {self.engine}")
        if min(self.max_splits, self.max_subtrees, self.max_depth) < 1 or (self.mtry is not None and self.mtry < 1) or self.classes == 1:
            raise ValueError("numbers of splits, sub-trees, levels and features are 1 at least; classes are 2 at least")

    def fits(self, node: Node) -> bool:
        return node.impurity > 0 and node.weight >= self.min_split and node.depth < self.max_depth

    def chosen(self, features: int, tree: int, node: int) -> list[int]:
        """The features that a node may be split by, in order."""
        if self.mtry is None or self.mtry >= features:
            return list(range(features))
        return sorted(np.random.default_rng([self.seed, tree, node]).choice(features, self.mtry, replace=False).tolist())


def node_of(i: int, depth: int, stats: np.ndarray, options: GrowOptions) -> Node:
    c = options.classes
    prediction, addendum = prediction_of(stats, c)
    return Node(i, depth, prediction, addendum, float(impurity_of(stats, c, options.impurity)), float(weight_of(stats, c)))


def divide(tree: Tree, at: int, found: Found, options: GrowOptions) -> list[Node]:
    """Gives node `at` its split and its children, in order; the first of the heaviest takes what has no child of its own."""
    node, free, c = tree.nodes[at], max(tree.nodes) + 1, options.classes
    if found.kind == MULTIWAY:
        stats = [s for _, s, _ in found.members]
    else:
        stats = found.parts
    made: list[Node | None] = []
    for s in stats:
        made.append(node_of(free, node.depth + 1, s, options) if weight_of(s, c) > 0 else None)
        free += made[-1] is not None
    children = [m for m in made if m]
    split = Split(found.feature, found.kind, found.impurity, max(children, key=lambda n: n.weight).id, found.cut)
    ids = [m.id if m else None for m in made]
    if found.kind == NUMERIC:
        split.left, split.right, split.missing = ids
    else:
        split.children = {b: ids[i] for b, _, i in found.members}
    node.split = split
    for n in children:
        tree.add(n)
    return children


def grow_local(bins: np.ndarray, y: np.ndarray, w: np.ndarray, features: list[Feature], options: GrowOptions, tree: int = 0, depth: int = 1) -> Tree:
    """A tree from arrays (bins has a row a feature); the root is at `depth` of the limit but numbered and placed as 1."""
    out, live = Tree(), w > 0
    bins, y, w = bins[:, live], y[live], w[live]
    limit = options.max_depth - depth + 1
    counter = Counter(features, 1, options.classes)
    queue = deque([(1, np.arange(len(y)))])
    while queue:
        at, rows = queue.popleft()
        block = np.zeros((1, int(counter.at[-1]), width(options.classes)))
        counter.dense(block, np.zeros(len(rows), np.int64), bins[:, rows], y[rows], w[rows])
        if at == 1:
            if not len(rows):
                raise ValueError("no row has weight")
            out.add(node_of(1, 1, block[0, counter.at[0] : counter.at[1]].sum(axis=0), options))
        node = out.nodes[at]
        if not options.fits(node) or node.depth >= limit:
            continue
        own = {j: block[0, counter.at[j] : counter.at[j + 1]] for j in options.chosen(len(features), tree, at)}
        found = best_local(own, features, options.classes, options.categories, options.seed, tree, at, options.impurity)
        if found.feature is None:
            continue
        children = divide(out, at, found, options)
        to = Flat(_stump(out, at), features).walk(bins[:, rows])
        ids = {c.id: i + 2 for i, c in enumerate(children)}
        queue += [(c.id, rows[to == ids[c.id]]) for c in children if options.fits(c) and c.depth < limit]
    return out


def _stump(tree: Tree, at: int) -> Tree:
    """Node `at` and its children as a tree of their own, numbered from 1."""
    n, s = tree.nodes[at], tree.nodes[at].split
    to = {c: i + 2 for i, c in enumerate(sorted(set(s.targets())))}
    out = Tree()
    out.add(Node(1, 1, n.prediction, n.addendum, n.impurity, n.weight, Split(s.feature, s.kind, s.impurity, to[s.heaviest], s.cut, to.get(s.left), to.get(s.right), to.get(s.missing), {b: to[c] for b, c in s.children.items()})))
    for c, i in to.items():
        m = tree.nodes[c]
        out.add(Node(i, 2, m.prediction, m.addendum, m.impurity, m.weight))
    return out


def grow_subtrees(frame: DataFrame, trees: list[Tree], features: list[Feature], roots: list[tuple[int, int]], options: GrowOptions) -> None:
    """Grows each (tree, node) of roots in one task. Its rows are no more than its weight, so tasks are bounded."""
    use = sorted({t for t, _ in roots})
    wanted = {(t, n): trees[t].nodes[n].depth for t, n in roots}
    flats = {t: Flat(trees[t], features) for t in use}
    names = [f"b_{j}" for j in range(len(features))]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bins = part[names].to_numpy(np.int64).T
            for t in use:
                node = flats[t].walk(bins)
                live = np.isin(node, [n for u, n in roots if u == t]) & (part[f"w_{t}"].to_numpy() > 0)
                if live.any():
                    yield part.loc[live, ["y", *names]].assign(w=part.loc[live, f"w_{t}"].astype(float), tree=t, node=node[live])

    fields = ", ".join(f"{b} int" for b in names)
    rows = frame.select(F.col("y").cast("double"), *[F.col(b).cast("int") for b in names], *[F.col(f"w_{t}").cast("double") for t in use]).mapInPandas(place, f"y double, {fields}, w double, tree int, node int")

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t, n = int(key[0]), int(key[1])
        own = grow_local(part[names].to_numpy(np.int64).T, part["y"].to_numpy(), part["w"].to_numpy(), features, options, t, wanted[t, n])
        return pd.DataFrame({"tree": [t], "node": [n], "nodes": [own.to_json()]})

    grown: dict[int, list] = {}
    for r in rows.groupBy("tree", "node").applyInPandas(finish, "tree int, node int, nodes string").collect():
        grown.setdefault(r["tree"], []).append((r["node"], r["nodes"]))
    for t, own in grown.items():
        for n, text in sorted(own):
            trees[t].graft(n, Tree.of_json(text))


def grow(frame: DataFrame, features: list[Feature], options: GrowOptions, trees: int = 1) -> list[Tree]:
    """Trees from frame: y, w_0.. (a weight for each tree), b_0.. (bin ids of the features).

    A pass takes up to max_splits nodes of all trees in the order in which they came. Rows find their nodes by walking the
    trees as grown so far, so nothing is stored between passes.
    """
    out: list[Tree] = [Tree() for _ in range(trees)]
    histogram, queue, small = ENGINES[options.engine], deque((t, 1) for t in range(trees)), deque()
    # Before the first pass, a node without values stands for each root.
    for t in out:
        t.add(Node(1, 1, 0.0, 0.0, 0.0, 0.0))
    while queue:
        batch = [queue.popleft() for _ in range(min(options.max_splits, len(queue)))]
        chosen = None if options.mtry is None or options.mtry >= len(features) else {(t, n): options.chosen(len(features), t, n) for t, n in batch}
        found = search(histogram(frame, out, features, batch, options.classes, chosen), features, options.classes, options.categories, options.seed, options.impurity)
        for t, n in batch:
            own, tree = found.get((t, n)), out[t]
            if own is None:
                raise ValueError(f"tree {t}: no row has weight")
            if n == 1:
                tree.nodes[1] = node_of(1, 1, own.totals, options)
            if own.feature is None or not options.fits(tree.nodes[n]):
                continue
            for child in divide(tree, n, own, options):
                if options.fits(child):
                    (small if child.weight <= options.subtree_weight else queue).append((t, child.id))
    while small:
        grow_subtrees(frame, out, features, [small.popleft() for _ in range(min(options.max_subtrees, len(small)))], options)
    return out


def leaf_ids(tree: Tree, features: list[Feature]):
    """The id of the leaf that a row of bins ends in."""
    return tree.on_bins(features, lambda n: F.lit(n.id))


__all__ = ["MULTIWAY", "ORDERED", "RANDOM", "SUBSET", "GrowOptions", "grow", "grow_local", "leaf_ids"]
