"""Near-duplicate embeddings by dual traversal of cover trees.

Vectors are put on the unit sphere, where cosine >= t means a chord of at most sqrt(2 - 2t). A cover tree has nested
levels of centres whose radii halve from level to level; every node knows the exact covering radius of what lies below. Two
trees are walked at once: a pair of nodes whose centres are further apart than both covering radii and the chord allow is
pruned; a pair that is close enough for all below it to be linked is counted as a whole, so a large group of near copies
costs one entry; what is left is compared exactly, in double precision. Within a task the walk starts at the pairs of narrow nodes
(``SKIN``) that matrix products over their centres leave open.

Distribution: equal vectors are one node with a weight from the start. The upper levels are grown on the cluster, level by level:
a node of more than two blocks of vectors gets children around a bounded number of centres, with exact covering radii, and its
members are dealt to them in chunks. The upper levels are walked at once too, as a table of pairs of nodes that the same bound leaves open.
Where two nodes are so close that all their vectors are linked, sums are all that is needed, however large they are. What is left are
pairs of nodes, which meet in a task: a node is one block, or dealt to parts of up to ``PART`` blocks, with a cover tree for each block.
A task returns at most one row per vector: its links there and the smallest vector of its connected group there, never the pairs.
Levels that would leave most pairs open are not grown. Data that no bound can prune meet in all pairs of parts, in work that is
quadratic in their number; the number of copies of a vector is then half the number of parts, which ``block`` and ``PART`` govern.

Results for special input: vectors that are null, empty, zero or hold null or non-finite parts link with nothing, and so do
vectors of different lengths with each other; a null id links with nothing (component null, kept); rows that share an id are
one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, need, returning, tidy, whole_ids
from .components import components

BLOCK, LEAF = 4096, 24
#: Blocks that a part of a large node holds at most; parts meet in pairs, so a vector is copied half as often as its node has parts.
PART = 32
#: Nodes of a radius up to SKIN meet by matrix products; so do the first FEW of the axes of a fixed rotation, whose product and the rest's norms bound a cosine.
SKIN, FEW = 0.15, 20
#: A level is kept if it leaves open no more than this share of the pairs of vectors.
GAIN = 0.25
#: Up to so many bytes, the vectors that several rows share are sent to every task.
SHARED_BYTES = 4 << 20
#: Up to so many nodes, their sizes are sent to every task: a join by node would leave all parts of a node in one task.
NODES = 20_000
#: Centres that a node's children get at most; levels until a node that is still large is dealt by a hash.
FAN, LEVELS = 256, 40
MARGIN = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge parts lose their square
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2.0
    d += 2.0
    np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


@functools.lru_cache(8)
def _rotation(dim: int) -> np.ndarray:
    """The same orthogonal matrix in every task; any one is exact."""
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]


class CoverTree:
    """Nodes as arrays: centre, covering radius, children, and the range of ``order`` that lies below. A pickle holds the vectors as given, in that order."""

    def __init__(self, x: np.ndarray, raw: np.ndarray | None = None) -> None:
        self.x, self.raw = x, x if raw is None else raw
        self.order = np.empty(len(x), np.int64)
        self.centre, self.radius, self.kids, self.low, self.high = [], [], [], [], []
        self._grow(np.arange(len(x)), chord(x, x[:1])[:, 0], 2.0, 0)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.low, self.high = np.array(self.low), np.array(self.high)
        sizes = np.array([0 if k is None else len(k) for k in self.kids])
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # children of node k: child[first[k]:first[k + 1]]
        self.child = np.concatenate([np.empty(0, np.int64), *(k for k in self.kids if k is not None)]).astype(np.int64)

    def _grow(self, members: np.ndarray, far: np.ndarray, reach: float, low: int) -> int:
        """A node for members, whose first is the centre; far: their distances from it. Recursion is as deep as the levels, some fifty at most."""
        node, radius = len(self.kids), float(far.max())
        self.centre.append(int(members[0]))
        self.radius.append(radius)
        self.low.append(low)
        self.high.append(low + len(members))
        self.kids.append(None)
        if len(members) <= LEAF or radius < 1e-6:
            self.order[low : low + len(members)] = members
            if radius > SKIN:  # a wide leaf's members are nodes, so that the skin reaches everything
                self.kids[node] = np.array([self._grow(members[i : i + 1], np.zeros(1), reach, low + i) for i in range(len(members))])
            return node
        while reach >= radius:  # levels at which the centre alone covers everything
            reach /= 2
        near = far <= reach
        groups, rest = [(members[near], far[near])], members[~near]
        while len(rest):
            lead = rest[:256]
            d = chord(self.x[lead], self.x[lead])
            open_, chosen = np.ones(len(lead), bool), []
            for i in range(len(lead)):
                if open_[i]:
                    chosen.append(i)
                    open_ &= d[i] > reach
            owner, dist = np.full(len(rest), -1), np.zeros(len(rest))
            for s in range(0, len(rest), 2048):
                e = chord(self.x[rest[s : s + 2048]], self.x[lead[chosen]])
                fits = e <= reach
                first = fits.argmax(axis=1)
                has = fits[np.arange(len(first)), first]
                owner[s : s + 2048] = np.where(has, first, -1)
                dist[s : s + 2048] = e[np.arange(len(first)), first]
            owner[chosen], dist[chosen] = np.arange(len(chosen)), 0.0
            by = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[by], np.arange(len(chosen) + 1))
            for g in range(len(chosen)):
                m = by[ends[g] : ends[g + 1]]
                head = m == chosen[g]
                m = np.concatenate([m[head], m[~head]])
                groups.append((rest[m], dist[m]))
            rest = rest[owner < 0]
        kids = []
        for m, f in groups:
            kids.append(self._grow(m, f, reach, low))
            low += len(m)
        self.kids[node] = np.array(kids)
        return node


    def __getstate__(self) -> dict:
        at = np.empty(len(self.order), np.int32)
        at[self.order] = np.arange(len(at))
        short = {k: getattr(self, k).astype(np.int32) for k in ("low", "high", "first", "child")}
        return short | {"raw": self.raw[self.order], "centre": at[self.centre], "radius": self.radius}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= {k: v.astype(np.int64) if v.dtype == np.int32 else v for k, v in state.items()}
        self.x, self.order = unit(self.raw), np.arange(len(self.raw))

    @functools.cached_property
    def skin(self) -> np.ndarray:
        """The uppermost nodes whose radius is at most SKIN; everything lies below one of them."""
        found, nodes = [], np.zeros(1, np.int64)
        while len(nodes):
            wide = (self.radius[nodes] > SKIN) & (self.first[nodes + 1] > self.first[nodes])
            found.append(nodes[~wide])
            run, k = _spread(np.diff(self.first)[nodes[wide]])
            nodes = self.child[self.first[nodes[wide]][run] + k]
        return np.sort(np.concatenate(found))

    @functools.cached_property
    def classes(self) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        return self.by_radius(self.skin)

    def by_radius(self, nodes: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """The nodes by classes of their radius: the largest one, the nodes, their centres, and the first axes and the rest's norm of these; in single precision."""
        kind, out = np.digitize(self.radius[nodes], [1e-9, 0.05, 0.15, 0.3, 0.6, 0.8, 0.9]), []
        for u in np.unique(kind):
            mine = nodes[kind == u]
            x = self.x[self.centre[mine]]
            turned = x @ _rotation(x.shape[1])
            few = np.concatenate([turned[:, :FEW], np.sqrt((turned[:, FEW:] ** 2).sum(axis=1, keepdims=True))], axis=1)
            out.append((float(self.radius[mine].max()), mine, x.astype(np.float32), few.astype(np.float32)))
        return out


class Links:
    """Weighted link counts and groups over positions of several trees' orders, laid side by side."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, n = weight, len(weight)
        self.total = np.concatenate([[0], np.cumsum(weight)])
        self.ranged = np.zeros(n + 1, np.int64)  # differences: links that whole ranges gain
        self.single = np.zeros(n, np.int64)
        self.label = np.arange(n)
        self.waiting, self.held = [], 0

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Positions i and j are in one group, pair by pair; labels are smallest positions."""
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def whole(self, lo: int, hi: int, p: int, q: int) -> None:
        """All of [lo, hi) are linked with all of [p, q); the two ranges are the same or apart."""
        for a, b, c, d in {(lo, hi, p, q), (p, q, lo, hi)}:
            self.ranged[a] += self.total[d] - self.total[c]
            self.ranged[b] -= self.total[d] - self.total[c]
        if lo == p:
            self.single[lo:hi] -= self.weight[lo:hi]
        both = np.concatenate([np.arange(lo, hi), np.arange(p, q)])
        self.join(both, np.full(len(both), lo))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links between different positions, each once; they are counted a million at a time."""
        self.waiting.append((i, j))
        self.held += len(i)
        if self.held >= 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            np.add.at(self.single, i, self.weight[j])
            np.add.at(self.single, j, self.weight[i])
            self.join(i, j)
        self.waiting, self.held = [], 0

    def counts(self) -> np.ndarray:
        self.settle()
        return self.single + np.cumsum(self.ranged)[:-1]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run of each element and its place in the run."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def _true(flags: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true; eight are looked at at once, where they come in eights."""
    flags = flags.reshape(-1)
    if len(flags) % 8:
        return np.flatnonzero(flags)
    some = np.flatnonzero(flags.view(np.uint64))
    return (8 * some[:, None] + np.arange(8))[flags.reshape(-1, 8)[some]]


def dual(a: CoverTree, b: CoverTree | None, links: Links, threshold: float, at: tuple[int, int] = (0, 0), chunk: int = 1 << 17) -> None:
    """Links within a (b is None) or between a and b, whose positions begin at the two numbers of ``at``.

    The walk starts at the pairs of skin nodes that matrix products over their centres, by classes of covering radius, leave:
    above them the bounds prune little that a product does not find faster. Pairs of nodes are walked in batches; where two nodes
    have many children, one product gives the pairs of children that remain.
    """
    reach = float(np.sqrt(2.0 - 2.0 * threshold))
    same = b is None
    b = a if same else b
    base, shift = at
    kids_a, kids_b = np.diff(a.first), np.diff(b.first)
    stack = []

    def later(p: np.ndarray, q: np.ndarray) -> None:
        stack.extend((p[s : s + chunk], q[s : s + chunk]) for s in range(0, len(p), chunk))

    def product(left: list, right: list, mirrored: bool) -> None:
        """Pairs of nodes that the coarse bound of their radius classes leaves, in single precision with a margin. mirrored: both are one list, of which a pair is met once."""
        found = []
        for u, (ra, i, x, few_x) in enumerate(left):
            for v, (rb, j, y, few_y) in enumerate(right):
                if mirrored and v < u:
                    continue
                far = ra + rb + reach + MARGIN
                least = 1.0 - far * far / 2.0 - 1e-5 if far < 2 else -2.0
                few = least > 0.9 and x.shape[1] > FEW + 4
                rows, columns = (few_x, few_y) if few else (x, y)
                for t in range(0, len(j), 2048):
                    column = np.ascontiguousarray(np.pad(columns[t : t + 2048], ((0, -len(columns[t : t + 2048]) % 8 if few else 0), (0, 0))).T)
                    for s in range(0, min(len(i), t + 2048) if mirrored and u == v else len(i), 512):
                        hit = _true(rows[s : s + 512] @ column >= least)
                        m, n = s + hit // column.shape[1], t + hit % column.shape[1]
                        if mirrored and u == v:
                            m, n = m[m <= n], n[m <= n]
                        if few and len(m):
                            near = np.concatenate([np.einsum("ij,ij->i", x[m[k : k + 8192]], y[n[k : k + 8192]]) >= least for k in range(0, len(m), 8192)])
                            m, n = m[near], n[near]
                        if len(m):
                            found.append((i[m], j[n]))
                        if sum(len(x) for x, _ in found[-64:]) >= chunk:  # many pairs: they wait as few long arrays
                            later(*(np.concatenate(x) for x in zip(*found, strict=True)))
                            found = []
        if found:
            later(*(np.concatenate(x) for x in zip(*found, strict=True)))

    apart = 0.0 if same else chord(a.x[a.centre[:1]], b.x[b.centre[:1]])[0, 0]
    if apart <= a.radius[0] + b.radius[0] + reach + MARGIN:
        product(a.classes, b.classes, same)
    while stack:
        p, q = stack.pop()
        mine = (p == q) if same else np.zeros(len(p), bool)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", a.x[a.centre[p]], b.x[b.centre[q]])))
        d[mine] = 0.0
        ra, rb = a.radius[p], b.radius[q]
        near = d <= ra + rb + reach + MARGIN
        p, q, mine, d, ra, rb = p[near], q[near], mine[near], d[near], ra[near], rb[near]
        size = (a.high[p] - a.low[p]) * (b.high[q] - b.low[q])
        all_in = (d + ra + rb < reach - MARGIN) & (size >= 256)
        for k in np.flatnonzero(all_in):
            links.whole(int(a.low[p[k]]) + base, int(a.high[p[k]]) + base, int(b.low[q[k]]) + shift, int(b.high[q[k]]) + shift)
        p, q, mine = p[~all_in], q[~all_in], mine[~all_in]
        ends = (kids_a[p] == 0) & (kids_b[q] == 0)
        u, v = p[ends], q[ends]
        for s in range(0, len(u), 4096):  # leaves: all their members, exactly
            x, y = u[s : s + 4096], v[s : s + 4096]
            wide = b.high[y] - b.low[y]
            run, at = _spread((a.high[x] - a.low[x]) * wide)
            i, j = a.low[x][run] + at // wide[run], b.low[y][run] + at % wide[run]
            keep = ~(x == y)[run] | (i < j) if same else np.ones(len(i), bool)  # a leaf with itself has each pair twice
            i, j = i[keep], j[keep]
            for t in range(0, len(i), chunk):
                e, f = i[t : t + chunk], j[t : t + chunk]
                hit = np.einsum("ij,ij->i", a.x[a.order[e]], b.x[b.order[f]]) >= threshold
                links.pairs(e[hit] + base, f[hit] + shift)
        p, q, mine = p[~ends], q[~ends], mine[~ends]
        na, nb = np.maximum(kids_a[p], 1), np.maximum(kids_b[q], 1)
        big = (na * nb > 1024) & (kids_a[p] > 0) & (kids_b[q] > 0)
        for k in np.flatnonzero(big):
            left, right = a.child[a.first[p[k]] : a.first[p[k] + 1]], b.child[b.first[q[k]] : b.first[q[k] + 1]]
            product(a.by_radius(left), b.by_radius(right), same and p[k] == q[k])
        p, q, mine, na, nb = p[~big], q[~big], mine[~big], na[~big], nb[~big]
        for s in range(0, len(p), 4096):
            x, y, m, w = p[s : s + 4096], q[s : s + 4096], mine[s : s + 4096], nb[s : s + 4096]
            run, at = _spread(na[s : s + 4096] * w)
            down = lambda t, kids, node, k: np.where(kids[node] == 0, node, t.child[np.minimum(t.first[node] + k, max(0, len(t.child) - 1))] if len(t.child) else node)
            i, j = down(a, kids_a, x[run], at // w[run]), down(b, kids_b, y[run], at % w[run])
            keep = ~m[run] | (i <= j)
            later(i[keep], j[keep])


def usable(vec: str):
    """Non-null, non-empty, finite throughout, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    return np.asarray(c.flatten()).reshape(len(c), -1)


def _leaves(column: pa.Array) -> np.ndarray:
    """The numbers of a column of lists, or of lists of lists, one after the other."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return np.asarray(column)


def _far_apart(x: np.ndarray, net: np.ndarray, gap: float) -> np.ndarray:
    """net, and the rows of x that are further than gap from it and from those taken before them."""
    taken, least = [], chord(x, net).min(axis=1)
    for i in range(len(x)):
        if least[i] > gap:
            taken.append(i)
            least = np.minimum(least, chord(x, x[i : i + 1])[:, 0])
    return np.concatenate([net, x[taken]])


def _split(members: DataFrame, large: DataFrame, block: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One level. members: rep, copies, vec, node; large: the nodes to split. Returns members of the children, and the children with their parents.

    The centres of a node's children are its own centre and some of its vectors, further apart than half its radius. A vector
    goes to its nearest centre. Where that centre's cell is likely to be large, those within half the radius and those beyond it are two
    children; on deep levels this is so for all, and nodes are sure to shrink. The members of a node meet its centres in chunks, so
    a node of any size is dealt to many tasks.
    """
    wanted = F.greatest(F.lit(16), F.least(F.lit(FAN), F.ceil(F.col("size") / block)))
    held = members.join(large.select("node", "size", "radius", "centre"), "node")
    place = F.xxhash64("rep", F.lit(level))
    lead = held.withColumn("place", place).where(F.pmod("place", F.col("size")) < 4 * wanted)  # a few times the wanted number, whatever the size
    lead = lead.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("place", "rep"))).where(F.col("at") <= wanted)

    def choose(t: pa.Table) -> pa.Table:
        x, centre = unit(_matrix(t["vec"])), np.asarray(t["centre"][0].as_py())[None]
        net = _far_apart(x, centre, t["radius"][0].as_py() / 2)
        share = np.bincount(chord(x, net).argmin(axis=1), minlength=len(net)) / len(x)
        wide = (share * t["size"][0].as_py() > block) | (len(net) == 1) | (level > 2)
        return pa.table({"node": t["node"][:1], "net": pa.array([net.tolist()], pa.list_(pa.list_(pa.float64()))), "wide": pa.array([wide.tolist()], pa.list_(pa.bool_()))})

    nets = lead.select("node", "vec", "centre", "radius", "size").groupBy("node").applyInArrow(choose, "node string, net array<array<double>>, wide array<boolean>")
    nets = durable(large.join(nets, "node", "left").select("node", "size", "radius", F.coalesce("net", F.array("centre")).alias("net"), F.coalesce("wide", F.array(F.lit(True))).alias("wide")))
    chunks = F.ceil(F.col("size") / block).cast("int")
    left = held.select("node", "rep", "copies", "vec", F.pmod(F.xxhash64("rep", F.lit(-1)), chunks).cast("int").alias("chunk"))
    right = nets.select(F.col("node").alias("of"), "radius", "net", "wide", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("part"))

    def assign(t: pa.Table, centres: pa.Table) -> pa.Table:
        net = _leaves(centres["net"].combine_chunks()).reshape(len(centres["net"][0]), -1)
        d = chord(unit(_matrix(t["vec"])), net) if len(t) else np.zeros((0, len(net)))
        at = d.argmin(axis=1)
        far = d[np.arange(len(at)), at]
        beyond = (far > centres["radius"][0].as_py() / 2) & np.array(centres["wide"][0].as_py())[at]
        names = [f"{parent}.{k}{'o' if b else ''}" for parent, k, b in zip(t["node"].to_pylist(), at.tolist(), beyond.tolist(), strict=True)]
        return pa.table({"rep": t["rep"], "copies": t["copies"], "vec": t["vec"], "node": pa.array(names, pa.string()), "parent": t["node"], "at": pa.array(at.astype(np.int32)), "far": pa.array(far)})

    kind = members.schema["vec"].dataType.simpleString()
    to = left.groupBy("node", "chunk").cogroup(right.groupBy("of", "part"))
    placed = durable(to.applyInArrow(assign, f"rep long, copies long, vec {kind}, node string, parent string, at int, far double"))
    stats = placed.groupBy("parent", "node", "at").agg(F.count("*").alias("size"), F.max("far").alias("radius"), F.sum("copies").alias("weight"), F.min("rep").alias("low"))
    kids = stats.join(nets.select(F.col("node").alias("parent"), "net"), "parent").withColumn("centre", F.element_at("net", F.col("at") + 1))
    return placed.select("rep", "copies", "vec", "node"), durable(kids.select("parent", *NODE))


#: The root's name; a child's is its parent's and its number. What is known of a node of the tree: vectors, exact covering radius, rows of all its vectors, smallest rep.
ROOT = "0"
NODE = ("node", "size", "radius", "weight", "low", "centre")


def _met(pairs: DataFrame, kids: DataFrame, reach: float) -> DataFrame:
    """The pairs of children, of which a node without children here is its own, whose centres, radii and reach leave a link open. pairs: a, b, both structs of NODE."""
    listed = kids.groupBy("parent").agg(F.collect_list(F.struct(*NODE)).alias("kids"))
    for side in "ab":
        mine = listed.select(F.col("parent").alias(f"{side}_node"), F.col("kids").alias(f"{side}s"))
        pairs = pairs.join(mine, F.col(f"{side}.node") == F.col(f"{side}_node"), "left").withColumn(f"{side}s", F.coalesce(f"{side}s", F.array(side)))
    pairs = pairs.select("as", "bs", (F.col("a.node") == F.col("b.node")).alias("same"))
    node = "struct<node:string,size:long,radius:double,weight:long,low:long,centre:array<double>>"

    def expand(batches):
        for batch in batches:
            for r in range(len(batch)):
                left, right, same = batch.column(0)[r].values, batch.column(1)[r].values, batch.column(2)[r].as_py()
                centres = [_leaves(s.field("centre")).reshape(len(s), -1) for s in (left, right)]
                radii = [np.asarray(s.field("radius")) for s in (left, right)]
                for s in range(0, len(left), 512):
                    near = chord(centres[0][s : s + 512], centres[1]) <= radii[0][s : s + 512, None] + radii[1][None] + reach + MARGIN
                    i, j = np.nonzero(near)
                    i += s
                    if same:  # one list; a child always meets itself
                        i, j = i[i < j], j[i < j]
                        own = np.arange(s, min(s + 512, len(left)))
                        i, j = np.concatenate([i, own]), np.concatenate([j, own])
                    for t in range(0, len(i), 4096):
                        yield pa.RecordBatch.from_arrays([left.take(pa.array(i[t : t + 4096])), right.take(pa.array(j[t : t + 4096]))], ["a", "b"])

    return pairs.mapInArrow(expand, f"a {node}, b {node}")


def _whole(reach: float):
    """Whether all vectors of a are linked with all of b."""
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))
    apart = F.when(F.col("a.node") == F.col("b.node"), F.lit(0.0)).otherwise(apart)
    return apart + F.col("a.radius") + F.col("b.radius") < reach - MARGIN


def _volume(pairs: DataFrame, reach: float) -> float:
    """Pairs of vectors that pairs of nodes leave to be compared, both ways."""
    once = F.col("a.size").cast("double") * F.col("b.size") * F.when(F.col("a.node") == F.col("b.node"), 1).otherwise(2)
    return pairs.where(~_whole(reach)).agg(F.sum(once)).first()[0] or 0.0


def _divides(nodes: DataFrame, reach: float) -> bool:
    """Whether a level may pay, from a bounded sample: cells that are open by its radii, which are no larger than the true ones, are open. It governs the plan only."""
    seen = nodes.orderBy(F.xxhash64("rep"), "rep").limit(8 * FAN).select("vec").toArrow()
    x = unit(_matrix(seen["vec"]))
    net = _far_apart(x[:FAN], x[:1], 1.0)
    d = chord(x, net)
    at, size = d.argmin(axis=1), np.bincount(d.argmin(axis=1), minlength=len(net)).astype(np.float64)
    radius = np.zeros(len(net))
    np.maximum.at(radius, at, d[np.arange(len(x)), at])
    between, both = chord(net, net), radius[:, None] + radius[None]
    np.fill_diagonal(between, 0.0)
    open_ = (between <= both + reach + MARGIN) & (between + both >= reach - MARGIN)
    return bool((size[:, None] * size[None] * open_).sum() <= GAIN * len(x) ** 2)


def _linked(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """nodes: rep, copies, vec, all of one length, and node, the root's name. Returns rep, links, root for every node with a link to another one, by task."""
    spark = nodes.sparkSession
    reach = float(np.sqrt(2.0 - 2.0 * threshold))
    n, low, weight, first = nodes.agg(F.count("*"), F.min("rep"), F.sum("copies"), F.min_by("vec", "rep")).first()
    root = spark.createDataFrame([(ROOT, n, 2.0, weight, low, unit(np.array([first], np.float64))[0].tolist())], "node string, size long, radius double, weight long, low long, centre array<double>")
    open_ = (F.col("size") > 2 * block) & (2 * F.col("radius") >= reach - MARGIN)
    members, large = nodes, root.where(open_)
    pairs, ended, done = root.select(F.struct(*NODE).alias("a"), F.struct(*NODE).alias("b")), [], []
    level = 0
    levels = LEVELS if n > 2 * block and _divides(nodes, reach) else 0
    while level < levels and not large.isEmpty():
        placed, kids = _split(members, large, block, level)
        met = durable(_met(pairs, kids, reach))
        if _volume(met, reach) > GAIN * _volume(pairs, reach):  # bounds do not tell these vectors apart: larger parts meet, which are copied less
            break
        pairs = met
        large = kids.where(open_)
        more = [(F.col(f"{s}.size") > 2 * block) & (2 * F.col(f"{s}.radius") >= reach - MARGIN) for s in "ab"]
        ended.append(pairs.where(~(more[0] | more[1])))
        pairs = pairs.where(more[0] | more[1])
        level, members = level + 1, None
        if large.isEmpty():
            done.append(placed)
            break
        done.append(placed.join(large.select("node"), "node", "left_anti").select("rep", "copies", "vec", "node"))
        members = placed.join(large.select("node"), "node", "left_semi").select("rep", "copies", "vec", "node")
    members, pairs = functools.reduce(DataFrame.unionByName, [*done, *([members] if members is not None else [])]), functools.reduce(DataFrame.unionByName, [*ended, pairs])
    pairs = durable(pairs.select(*(F.struct(*(F.col(f"{s}.{c}").alias(c) for c in NODE[:-1])).alias(s) for s in "ab"), _whole(reach).alias("whole")))

    # nodes of which every vector is linked with every one of the other: by sums, whatever their sizes
    whole = pairs.where("whole")
    least = F.least("a.low", "b.low")
    gains = whole.select(F.col("a.node").alias("node"), F.col("b.weight").alias("gain"), (F.col("a.node") == F.col("b.node")).alias("own"), least.alias("root"))
    gains = gains.unionByName(whole.where("a.node != b.node").select(F.col("b.node").alias("node"), F.col("a.weight").alias("gain"), F.lit(False).alias("own"), least.alias("root")))
    gains = gains.groupBy("node").agg(F.sum("gain").alias("gain"), F.max("own").alias("own"), F.min("root").alias("root"))
    linked = members.join(gains, "node").select("rep", (F.col("gain") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"), "root")
    linked = linked.where("links > 0").unionByName(whole.select(F.col("a.low").alias("rep"), F.lit(0).cast("long").alias("links"), F.col("b.low").alias("root")).where("rep != root"))

    # all others are compared, part by part; a node of more than a few blocks is dealt to several parts by a hash
    dealt = lambda size: F.greatest(F.ceil(F.col(size) / (PART * block)), F.least(F.lit(3), F.ceil(F.col(size) / (4 * block)))).cast("int")
    pairs = pairs.where(~F.col("whole"))
    sizes = pairs.select(F.col("a.node").alias("node"), F.col("a.size").alias("size")).unionByName(pairs.select(F.col("b.node").alias("node"), F.col("b.size").alias("size"))).distinct()
    sizes = F.broadcast(sizes) if sizes.count() <= NODES else sizes
    rows = members.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("rep"), dealt("size")).cast("int"))

    def grow(t: pa.Table) -> pa.Table:
        t, trees = t.sort_by("rep"), []
        for k in range(0, len(t), block):
            x, rep, copies = _matrix(t["vec"][k : k + block]), np.asarray(t["rep"][k : k + block]), np.asarray(t["copies"][k : k + block])
            tree = CoverTree(unit(x), x)
            trees.append((tree, rep[tree.order], copies[tree.order] if copies.max() > 1 else None))
        return pa.table({"node": t["node"][:1], "block": t["block"][:1], "tree": pa.array([pickle.dumps(trees, 5)], pa.binary())})

    # one row per part, with a tree for each of its blocks: each tree is grown once and sent to the tasks of its pairs
    tidy(spark)
    trees = durable(rows.select("node", "block", "rep", "copies", "vec").repartition("node", "block").groupBy("node", "block").applyInArrow(grow, "node string, block int, tree binary"))
    blocks = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), dealt("a.size") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), dealt("b.size") - 1)))
    blocks = blocks.where("a.node != b.node or i <= j").select(F.struct(F.col("a.node").alias("node"), F.col("i").alias("block")).alias("one"), F.struct(F.col("b.node").alias("node"), F.col("j").alias("block")).alias("two"))
    turn = F.pmod(F.xxhash64("one", "two"), F.lit(2)) == 0  # so that no block is the second one of all its pairs
    blocks = blocks.select(F.when(turn, F.col("one")).otherwise(F.col("two")).alias("one"), F.when(turn, F.col("two")).otherwise(F.col("one")).alias("two"))
    with_one = blocks.join(trees.select(F.struct("node", "block").alias("one"), F.col("tree").alias("first")), "one")
    with_two = with_one.where("one != two").join(trees.select(F.struct("node", "block").alias("two"), F.col("tree").alias("second")), "two")
    work = with_two.select("first", "second").unionByName(with_one.where("one = two").select("first", F.lit(None).cast("binary").alias("second")))

    def compare(batches):
        for batch in batches:
            for r in range(len(batch)):
                parts = [pickle.loads(c[r].as_buffer()) for c in batch.columns if c[r].is_valid]
                trees = [t for part in parts for t in part]
                rep = np.concatenate([reps for _, reps, _ in trees])
                links = Links(np.concatenate([np.ones(len(reps), np.int64) if copies is None else copies for _, reps, copies in trees]))
                start = np.cumsum([0, *(len(reps) for _, reps, _ in trees)]).tolist()
                mine, alone = len(parts[0]), len(parts) == 1
                for i in range(mine):
                    if alone:
                        dual(trees[i][0], None, links, threshold, (start[i], start[i]))
                    for j in range(i + 1 if alone else mine, len(trees)):
                        dual(trees[i][0], trees[j][0], links, threshold, (start[i], start[j]))
                count = links.counts()
                root = np.full(len(rep), np.iinfo(np.int64).max)
                np.minimum.at(root, links.label, rep)
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(count[some].astype(np.int64)), pa.array(root[links.label][some])], ["rep", "links", "root"])

    return work.mapInArrow(returning(compare), "rep long, links long, root long").unionByName(linked)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = need(df, id_col, vec_col).select(whole_ids(df, id_col).alias("id"), F.col(vec_col).alias("vec"))
    nodes = durable(rows.where(F.col("id").isNotNull() & usable("vec")).groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.lit(ROOT)))
    found = None
    for (size,) in nodes.select(F.size("vec")).distinct().collect():  # normally one
        part = _linked(nodes.where(F.size("vec") == size), threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "rep long, links long, root long")
    found = durable(found)
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    linked = durable(found.groupBy("rep").agg(F.sum("links").alias("links")).join(comp, "rep", "full"))
    # vectors of several rows are looked up by value, all others by id
    shared = durable(nodes.where("copies > 1").join(linked, "rep", "left").select(F.col("vec").alias("v"), "rep", "copies", "links", "component"))
    few = shared.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("size")).first()
    shared = F.broadcast(shared) if 8 * few.n * few.size <= SHARED_BYTES else shared.hint("merge")
    known = rows.withColumn("usable", F.col("id").isNotNull() & usable("vec"))
    known = known.join(shared, F.col("usable") & (F.col("vec") == F.col("v")), "left").drop("vec", "v").withColumn("key", F.when(F.col("usable") & F.col("rep").isNull(), F.col("id")))
    alone = linked.select(F.col("rep").alias("key"), F.col("links").alias("own_links"), F.col("component").alias("own_component"))
    out = known.join(alone, "key", "left")
    links = F.coalesce("links", "own_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "own_component", "id"))
    return out.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def query(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings)
