"""Decision trees over bins: nodes, routing as expressions and in numpy, importance, and rows to store them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from grovemill.operators.binning import Bins, CategoryBins, NumericBins

NUMERIC, SUBSET, MULTIWAY = "numeric", "subset", "multiway"


@dataclass(frozen=True)
class Feature:
    """A feature as trees see it: its name and its bins."""

    name: str
    bins: Bins

    @property
    def categorical(self) -> bool:
        return isinstance(self.bins, CategoryBins)


@dataclass
class Split:
    """Where a node's rows go. Numeric: bins below `cut` left, others right, missing values to their own child if there
    is one; without it, and for categories not seen, to the heaviest child. left is None if only missing values part."""

    feature: int
    kind: str
    impurity: float
    heaviest: int
    cut: int = 0
    left: int | None = None
    right: int | None = None
    missing: int | None = None
    children: dict[int, int] = field(default_factory=dict)

    def targets(self) -> list[int]:
        return list(dict.fromkeys(self.children.values())) if self.kind != NUMERIC else [c for c in (self.left, self.right, self.missing) if c is not None]


@dataclass
class Node:
    id: int
    depth: int
    prediction: float
    #: Of a regression the variance, of a classification the share of the predicted class.
    addendum: float
    impurity: float
    weight: float
    split: Split | None = None


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.split is None]

    def add(self, node: Node) -> None:
        if node.id in self.nodes:
            raise ValueError(f"there is a node {node.id} already")
        self.nodes[node.id] = node

    def graft(self, at: int, other: Tree) -> None:
        """The other tree in place of the node `at`; its further nodes are numbered on from the largest id."""
        own = self.nodes[at]
        shift = max(self.nodes) - 1
        to = {i: at if i == 1 else i + shift for i in other.nodes}
        for n in other.nodes.values():
            s = n.split
            new = None if s is None else Split(s.feature, s.kind, s.impurity, to[s.heaviest], s.cut, to.get(s.left), to.get(s.right), to.get(s.missing), {b: to[c] for b, c in s.children.items()})
            self.nodes[to[n.id]] = Node(to[n.id], n.depth + own.depth - 1, n.prediction, n.addendum, n.impurity, n.weight, new)

    def shape(self, at: int = 1) -> tuple:
        """The tree without its numbering, for comparisons."""
        n = self.nodes[at]
        kept = (round(n.prediction, 9), round(n.impurity, 9), round(n.weight, 9), n.depth)
        if n.split is None:
            return kept
        s = n.split
        below = tuple((b, self.shape(c)) for b, c in sorted(s.children.items())) if s.kind != NUMERIC else tuple(None if c is None else self.shape(c) for c in (s.left, s.right, s.missing))
        return (*kept, s.feature, s.kind, s.cut, below)

    def importance(self, features: int) -> np.ndarray:
        out = np.zeros(features)
        for n in self.nodes.values():
            if n.split:
                out[n.split.feature] += (n.impurity - n.split.impurity) * n.weight
        return out

    def dump(self, names: list[str] | None = None) -> str:
        lines = []
        for n in sorted(self.nodes.values(), key=lambda n: n.id):
            text = f"{n.id}: depth {n.depth}, prediction {n.prediction:g}, impurity {n.impurity:g}, weight {n.weight:g}"
            if s := n.split:
                name = names[s.feature] if names else f"feature {s.feature}"
                where = f"bin < {s.cut} -> {s.left}, else {s.right}" + f", missing -> {s.missing}" * (s.missing is not None) if s.kind == NUMERIC else ", ".join(f"{b} -> {c}" for b, c in sorted(s.children.items()))
                text += f"; {name}: {where}"
            lines.append(text)
        return "\n".join(lines)

    # Rows -----------------------------------------------------------------------------------------------------------
    SCHEMA = "id int, depth int, prediction double, addendum double, impurity double, weight double, split struct<feature:int,kind:string,impurity:double,heaviest:int,cut:int,left:int,right:int,missing:int,children:map<int,int>>"

    def rows(self) -> list[tuple]:
        return [(n.id, n.depth, float(n.prediction), float(n.addendum), float(n.impurity), float(n.weight), None if n.split is None else tuple(asdict(n.split).values())) for n in self.nodes.values()]

    @staticmethod
    def of_rows(rows: list) -> Tree:
        out = Tree()
        for r in sorted(rows, key=lambda r: r["id"]):
            s = r["split"]
            out.add(Node(r["id"], r["depth"], r["prediction"], r["addendum"], r["impurity"], r["weight"], None if s is None else Split(s["feature"], s["kind"], s["impurity"], s["heaviest"], s["cut"], s["left"], s["right"], s["missing"], dict(s["children"]))))
        return out

    def to_json(self) -> str:
        return json.dumps([asdict(n) for n in self.nodes.values()])

    @staticmethod
    def of_json(text: str) -> Tree:
        out = Tree()
        for n in json.loads(text):
            s = n.pop("split")
            out.add(Node(**n, split=None if s is None else Split(**{**s, "children": {int(b): c for b, c in s["children"].items()}})))
        return out

    # Routing ----------------------------------------------------------------------------------------------------------
    def expression(self, lost: Callable[[int], Column], below: Callable[[int, int], Column], code: Callable[[int], Column], value: Callable[[Node], Column]) -> Column:
        """The value of the node that a row ends in. lost(feature), below(feature, cut): tests; code(feature): category."""

        def at(i: int) -> Column:
            n = self.nodes[i]
            if (s := n.split) is None:
                return value(n)
            if s.kind == NUMERIC:
                if s.missing is not None:
                    rest = at(s.right) if s.left is None else F.when(below(s.feature, s.cut), at(s.left)).otherwise(at(s.right))
                    return F.when(lost(s.feature), at(s.missing)).otherwise(rest)
                left = below(s.feature, s.cut) & ~lost(s.feature)
                return F.when((left | lost(s.feature)) if s.heaviest == s.left else left, at(s.left)).otherwise(at(s.right))
            groups: dict[int, list[int]] = {}
            for b, c in s.children.items():
                groups.setdefault(c, []).append(b)
            chain = None
            for c, own in groups.items():
                if c != s.heaviest:
                    test = F.coalesce(code(s.feature).isin(sorted(own)), F.lit(False))
                    chain = F.when(test, at(c)) if chain is None else chain.when(test, at(c))
            return chain.otherwise(at(s.heaviest))

        return at(1)

    def on_bins(self, features: list[Feature], value: Callable[[Node], Column], column: str = "b_{}") -> Column:
        """Over columns of bin ids."""
        name = lambda f: F.col(column.format(f))
        lost = lambda f: F.lit(False) if features[f].bins.missing is None else name(f) == features[f].bins.missing
        return self.expression(lost, lambda f, cut: name(f) < cut, name, value)

    def on_values(self, features: list[Feature], value: Callable[[Node], Column], column: Callable[[int], Column]) -> Column:
        """Over encoded values: a bin's lower edge is the threshold."""
        lost = lambda f: column(f).isNull() | F.isnan(column(f))
        below = lambda f, cut: F.coalesce(column(f) < (features[f].bins.edges[cut - 1] if cut else float("-inf")), F.lit(False))
        return self.expression(lost, below, column, value)


class Flat:
    """A tree as arrays by node id, so a batch of rows walks it level by level. Codes below 0 are missing or not seen."""

    def __init__(self, tree: Tree, features: list[Feature], value: Callable[[Node], float] | None = None) -> None:
        n = max(tree.nodes) + 1
        self.feature, self.cut, self.kind = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int8)
        self.left, self.right, self.lost = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.value, table = np.zeros(n), []
        self.missing = np.array([-1 if f.bins.missing is None else f.bins.missing for f in features] or [-1])
        for node in tree.nodes.values():
            i, s = node.id, node.split
            self.value[i] = value(node) if value else node.prediction
            if s is None:
                continue
            self.feature[i] = s.feature
            self.lost[i] = s.heaviest if s.missing is None else s.missing
            if s.kind == NUMERIC:
                self.cut[i], self.left[i], self.right[i] = s.cut, s.right if s.left is None else s.left, s.right
            else:
                self.kind[i], self.start[i], self.size[i] = 1, len(table), max(s.children) + 1
                table += [s.children.get(b, s.heaviest) for b in range(max(s.children) + 1)]
        self.table = np.array(table or [0], np.int64)

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """Node ids; bins has a row for each feature."""
        at = np.ones(bins.shape[1], np.int64)
        live = np.arange(len(at)) if self.feature[1] >= 0 else np.zeros(0, np.int64)
        while len(live):
            i = at[live]
            f = self.feature[i]
            x = bins[f, live].astype(np.int64)
            to = np.where(x < self.cut[i], self.left[i], self.right[i])
            categorical = self.kind[i] == 1
            inside = categorical & (x >= 0) & (x < self.size[i])
            to[inside] = self.table[self.start[i][inside] + x[inside]]
            gone = (x < 0) | (categorical & ~inside) | (~categorical & (self.missing[f] >= 0) & (x == self.missing[f]))
            to[gone] = self.lost[i][gone]
            at[live] = to
            live = live[self.feature[to] >= 0]
        return at


def codes(features: list[Feature], values: list[np.ndarray]) -> np.ndarray:
    """Bin ids of encoded values, a row for each feature; -1 for missing values and categories."""
    out = np.full((len(features), len(values[0]) if values else 0), -1, np.int64)
    for j, (f, x) in enumerate(zip(features, values, strict=True)):
        fine = ~np.isnan(x)
        out[j, fine] = np.searchsorted(np.asarray(f.bins.edges), x[fine], "right") if isinstance(f.bins, NumericBins) else x[fine].astype(np.int64)
    return out
