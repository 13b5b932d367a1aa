"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree's top is fitted on a uniform sample of at most `SAMPLE` numbers (rows times dimensions) and has at most `LEAVES`
leaves, so that it can be sent to every task. While leaves hold over `SPLIT` rows and the rows outnumber what such a top
can divide into leaves of `LEAF`, each of them gets a tree of its own, fitted in a task on a bounded sample of its rows and
met there by its rows and queries; so the rows of a leaf, and a query's work, don't grow with the table.

A query walks a tree best bin first, the node with the nearest centre next, and so reaches leaves in order; the order is
worked out for many queries at once, by one matrix product with all centres. It widens its visits until the way to the next leaf is farther than to its first one by a margin, and until the leaves that it
visits hold more than k rows (all of them, where there are fewer): so no query gets less than k neighbours while there are
k. The margin of each level is calibrated: `TRIALS` sampled vectors that no tree is fitted on are compared with all rows,
and the margin is the least by which they would have found `RECALL` of their true neighbours.

Rows and visits meet in groups of neighbouring leaves, of about `CHUNK` rows (`BUNDLE` where trees of their own follow); a
leaf of more is dealt into several groups by a hash, each of which all its visits reach. A query comes to a group once, with
the leaves that it visits there, however many these are: its vector isn't repeated for each. A task holds the rows of one
group and lets the queries pass by, a batch at a time, so that it needs no more memory where more queries come or where
they visit more leaves. A query leaves a group with its k nearest there: for each leaf candidates are found by one matrix
product, those that can still be among the k are scored again row by row, in a way that gives equal vectors equal scores; so
ties go to the smaller id.

Nulls and odd rows: a vector that is null, zero or that holds null or a number not finite takes no part, nor does a null
id; only vectors of one length are compared, each length is searched apart; every query row has a list of its own, in which
other rows of its id may be; a repeated row is found repeatedly; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE, BRANCHES, LEAF, LEAVES, CHUNK, BUNDLE = 1_600_000, 8, 200, 4096, 16_384, 1 << 18
#: Rows of a leaf that gets a tree of its own, and rows that meet a copy of it at once.
SPLIT, MEET = 8 * LEAF, 16_384
#: Queries that walk a tree at once, and rows of a batch that they leave with.
WALK, BATCH = 128, 4096
#: Pairs that are scored at once.
PAIRS = 1 << 15
TRIALS, RECALL, SEED = 96, 0.97, 11


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


class Tree:
    """children by node; a node's centre; leaves by node, -1 for the others."""

    def __init__(self, points: np.ndarray, size: int, most: int, branches: int = BRANCHES) -> None:
        """points: unit vectors; size: the most points of a leaf that can be split, but there are `most` leaves at most."""
        rng = np.random.default_rng(SEED)
        self.centres: list[np.ndarray] = [points.mean(axis=0) if len(points) else np.zeros(points.shape[1])]
        self.children: list[list[int]] = [[]]
        todo, ends = [(-len(points), 0, points)], 1
        while todo and ends < most:
            _, node, own = heapq.heappop(todo)  # the largest first
            if len(own) <= size:
                break
            group, centres = self._split(own, min(branches, max(2, len(own) // size + 1), most - ends + 1), rng)
            if len(centres) < 2:
                continue
            ends += len(centres) - 1
            for g, c in enumerate(centres):
                child = len(self.centres)
                self.children[node].append(child)
                self.centres.append(c)
                self.children.append([])
                part = own[group == g]
                heapq.heappush(todo, (-len(part), child, part))
        self.leaf = [-1] * len(self.centres)
        for number, node in enumerate(n for n, c in enumerate(self.children) if not c):
            self.leaf[node] = number
        self.leaves = max(self.leaf) + 1
        self.matrix = np.array(self.centres)
        self.ends = np.array([n for n, c in enumerate(self.children) if not c])
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []  # nodes and their parents, by depth from 2
        above = self.children[0]
        while below := [(c, n) for n in above for c in self.children[n]]:
            above = [c for c, _ in below]
            self.steps.append((np.array(above), np.array([n for _, n in below])))

    @staticmethod
    def _split(own: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """k-means: the group of each point, and the centres, of which none is without points."""
        centres = own[rng.choice(len(own), k, replace=False)]
        group = np.zeros(len(own), dtype=np.int64)
        for _ in range(12):
            far = (own @ centres.T) - 0.5 * (centres * centres).sum(axis=1)
            now = far.argmax(axis=1)
            used, group_now = np.unique(now, return_inverse=True)
            centres = np.array([own[group_now == g].mean(axis=0) for g in range(len(used))])
            if len(used) == 1 or (group_now == group).all():
                group = group_now
                break
            group = group_now
        return group, centres

    def nearness(self, node_ids: list[int], x: np.ndarray) -> np.ndarray:
        own = self.matrix[node_ids]
        return x @ own.T - 0.5 * (own * own).sum(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            best = self.nearness(self.children[node], x[own]).argmax(axis=1)
            todo += [(c, own[best == k]) for k, c in enumerate(self.children[node]) if (best == k).any()]
        return out

    def ways(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the way to each leaf leads, by leaf and unit vector, beyond that to the first one; and each node's own distance.

        Best bin first, the queue hands out the node with the nearest centre next: so a leaf comes when the farthest node on
        the way to it does. Leaves without rows are never reached.
        """
        cost = 0.5 * (self.matrix * self.matrix).sum(axis=1)[:, None] - self.matrix @ x.T
        far = cost.copy()
        for nodes, parents in self.steps:
            far[nodes] = np.maximum(far[nodes], far[parents])
        far = far[self.ends]
        far[sizes == 0] = math.inf
        return far - far.min(axis=0), cost

    def visits(self, x: np.ndarray, margin: float, sizes: np.ndarray, least: int) -> np.ndarray:
        """By leaf and unit vector: whether the leaf is visited, being up to the margin or needed to hold `least` rows."""
        far, cost = self.ways(x, sizes)
        out = (far <= margin) & (sizes > 0)[:, None]
        for q in np.flatnonzero(sizes @ out < least):
            out[self.first(cost[:, q], sizes, least), q] = True
        return out

    def first(self, cost: np.ndarray, sizes: np.ndarray, least: int) -> list[int]:
        """The leaves that come first, until they hold `least` rows, through a priority queue of nodes; cost: of each node."""
        heap, out, held = [(0.0, 0)], [], 0
        while heap and held < least:
            _, node = heapq.heappop(heap)
            if (leaf := self.leaf[node]) >= 0 and sizes[leaf]:
                out.append(leaf)
                held += sizes[leaf]
            for c in self.children[node]:
                heapq.heappush(heap, (float(cost[c]), c))
        return out

    def need(self, x: np.ndarray, leaf: int, sizes: np.ndarray) -> float:
        """The margin at which a leaf is visited."""
        return float(self.ways(x[None, :], sizes)[0][leaf, 0])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the vector q with the rows of x, each row by the same operations."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


class Nearest:
    """The k nearest of some queries, by smaller id, among rows that come in turns.

    own: the numbers of the queries' own rows, which don't count.
    """

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.lengths = np.sqrt((queries * queries).sum(axis=1))
        self.units = queries / self.lengths[:, None]
        #: The best scores of each query so far, the least first: what is under it needn't be looked at again.
        self.top = np.full((len(queries), k), -math.inf)

    def among(self, which: np.ndarray, x: np.ndarray, units: np.ndarray, lengths: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and scores: of the queries `which`, those of these rows that can be among their k nearest.

        Found by one product for some queries at a time, scored again pair by pair, `PAIRS` at a time, since many rows can tie.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(which), 256):
            own = which[at : at + 256]
            near, bound = self.units[own] @ units.T, self.top[own, 0]
            if near.shape[1] > self.k + 1 and (bound == -math.inf).any():  # one more, which may be the query itself
                bound = np.maximum(bound, np.partition(near, -self.k - 1, axis=1)[:, -self.k - 1])
            i, j = np.nonzero(near >= (bound - 1e-9)[:, None])
            other = self.own[own[i]] != uids[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            q, score = own[i], np.empty(len(i))
            for a in range(0, len(i), PAIRS):
                u, v = q[a : a + PAIRS], j[a : a + PAIRS]
                score[a : a + PAIRS] = (x[v] * self.queries[u]).sum(axis=1) / (lengths[v] * self.lengths[u])
            kept, rank = first_of_each(i, score, ids[j], uids[j], self.k)
            i, j, score = i[kept], j[kept], score[kept]
            new = np.full((len(own), self.k), -math.inf)
            new[i, rank] = score
            self.top[own] = np.sort(np.concatenate([self.top[own], new], axis=1), axis=1)[:, -self.k :]
            found.append((own[i], j, score))
        return joined(found)


def joined(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and scores of several turns."""
    empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    i, j, score = (np.concatenate([f[c] for f in [empty, *found]]) for c in range(3))
    return i, j, score


def first_of_each(query: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each query, by score, then by smaller id, and their ranks from 0."""
    order = np.lexsort((uids, ids, -score, query))
    q = query[order]
    begins = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return order[rank < k], rank[rank < k]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def margin(needs: list[float], share: float) -> float:
    """The least margin that reaches a share of what is needed."""
    return float(np.sort(needs)[min(len(needs) - 1, math.ceil(share * len(needs)))]) if needs else math.inf


def search(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k nearest rows found. is_query: an expression over rows."""
    own = rows.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    kind = rows.select(vector).schema[0].dataType.elementType.typeName()
    kind = kind if kind == "float" else "double"  # a float is carried as one and reckoned with as the same double
    own = cut(own.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("uid")))
    widths = own.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect()
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in widths:
        found = found.unionByName(Search(own.where(F.size("x") == r["width"]), r["n"], r["width"], k, kind).run())
    return found


class Search:
    """One search over rows (id, x, q, uid) of one width. Leaves are numbers, `LEAVES` times their parent's plus their own.

    Groups of leaves are numbered within their bundle b, and a bundle is the group of the level above.
    """

    def __init__(self, rows: DataFrame, n: int, width: int, k: int, kind: str = "double") -> None:
        self.rows, self.n, self.width, self.k, self.spark = rows, n, width, k, rows.sparkSession
        self.vectors = lambda column: rows_of(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, width)
        self.kinds = f"id long, x array<{kind}>, q boolean, uid long"
        self.asking = f"id long, x array<{kind}>, uid long, b long, g long, leaves array<long>"
        self.chunk = min(CHUNK, max(1024, n // 32))
        #: For tables with a row for each divided leaf, of which there are n / SPLIT at most: rows that join with them stay where they are.
        self.small = F.broadcast if n <= SPLIT << 20 else lambda df: df

    def run(self) -> DataFrame:
        levels = next((k for k in range(1, 5) if self.n <= LEAF * LEAVES**k), 5)
        self.share = RECALL ** (1 / levels)  # what is missed on one level is missed for good
        most = max(2 * TRIALS, SAMPLE // self.width)
        hashed = F.xxhash64("uid")
        small = hashed < int(2**64 * 2 * most / self.n) - 2**63 if self.n > 4 * most else F.lit(True)  # about twice as many as are taken
        sample = self.rows.where(small).orderBy(hashed, "uid").limit(most).select("uid", "x").toArrow()
        points, uids = self.vectors(sample.column("x")), np.asarray(sample.column("uid").to_numpy())
        self.trials, self.trial_uids = points[:TRIALS], uids[:TRIALS]
        fitted = points[TRIALS:] if len(points) > 4 * TRIALS else points
        leaves = min(LEAVES, max(1, self.n // LEAF))
        top = Tree(unit(fitted), max(4, -(-len(fitted) // leaves)), LEAVES)
        index = cut(self.placed(top))
        truth = self.truth(index)
        sizes = np.zeros(top.leaves, dtype=np.int64)
        for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
            sizes[r["leaf"]] = r["n"]
        far = margin([top.need(unit(self.trials[r["t"]]), r["leaf"], sizes) for r in truth.collect()], self.share)
        asked, dealing = self.visited(index, top, far, sizes, self.chunk if levels == 1 else BUNDLE)
        for level in range(2, levels + 1):
            index, asked, truth, dealing = self.split(index, asked, truth, dealing, self.chunk if level == levels else BUNDLE)
        return self.met(index, asked, dealing)

    def placed(self, top: Tree) -> DataFrame:
        shared, vectors = self.spark.sparkContext.broadcast(top), self.vectors

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = shared.value.assign(unit(vectors(batch.column(1)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*ROWS, "leaf"])

        return self.rows.select(*ROWS).mapInArrow(place, f"{self.kinds}, leaf long")

    def truth(self, index: DataFrame) -> DataFrame:
        """The true neighbours of the trials: t, uid and leaf."""
        trials, own, vectors, k = self.trials, self.trial_uids, self.vectors, self.k

        def true_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest, all_of = Nearest(trials, own, k), np.arange(len(trials))
            for batch in batches:
                ids, x, uids, leaf = batch.column(0).to_numpy(), vectors(batch.column(1)), batch.column(3).to_numpy(), batch.column(4).to_numpy()
                t, row, score = nearest.among(all_of, x, unit(x), np.sqrt((x * x).sum(axis=1)), ids, uids)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(score), pa.array(ids[row]), pa.array(uids[row]), pa.array(leaf[row])], ["t", "score", "id", "uid", "leaf"])

        best = Window.partitionBy("t").orderBy(F.desc("score"), "id", "uid")
        found = index.mapInArrow(true_ones, "t int, score double, id long, uid long, leaf long").withColumn("r", F.row_number().over(best))
        return cut(found.where(F.col("r") <= k).select("t", "uid", "leaf"))

    def visited(self, index: DataFrame, top: Tree, far: float, sizes: np.ndarray, chunk: int) -> tuple[DataFrame, DataFrame]:
        """(id, x, uid, b, g, leaves): a row for each group that a query visits leaves of; and the leaves' groups of about `chunk` rows."""
        g = np.unique((np.cumsum(sizes) - sizes) // chunk, return_inverse=True)[1].astype(np.int64)
        dealing = self.spark.createDataFrame(pa.table({"leaf": np.arange(len(g)), "n": sizes, "b": np.zeros(len(g), dtype=np.int64), "g": g}))
        shared, vectors, least = self.spark.sparkContext.broadcast((top, far, sizes, g)), self.vectors, self.k + 1

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, margin, held, group = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, WALK):
                    own = batch.slice(at, WALK)
                    who, leaf = np.nonzero(tree.visits(unit(vectors(own.column(1))), margin, held, least).T)
                    yield from by_group(own, who, leaf, 0, group[leaf])

        return index.where("q").select("id", "x", "uid").mapInArrow(walk, self.asking), dealing

    def streamed(self, held: DataFrame, asked: DataFrame, keys: list[str], hold: Callable[[pa.RecordBatch], object], answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
        """answer(hold(rows held under some keys), some of the rows asked there), the held ones of one set of keys at a time."""
        names = ["late", *dict.fromkeys([*keys, *held.columns, *asked.columns])]
        both = held.withColumn("late", F.lit(0)).unionByName(asked.withColumn("late", F.lit(1)), allowMissingColumns=True).select(*names)

        def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, own, ready = None, [], None
            for batch in batches:
                marks = np.stack([batch.column(name).to_numpy() for name in [*keys, "late"]], axis=1)
                begins = np.flatnonzero((np.diff(marks, axis=0, prepend=marks[:1] - 1) != 0).any(axis=1))
                for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                    *key, late = marks[a].tolist()
                    if key != now:
                        now, own, ready = key, [], None
                    if not late:
                        own.append(batch.slice(a, b - a))
                    elif own or ready is not None:
                        if ready is None:
                            ready, own = hold(pa.Table.from_batches(own).combine_chunks().to_batches()[0]), []
                        yield from answer(ready, batch.slice(a, b - a))

        return both.repartition(*keys).sortWithinPartitions(*keys, "late").mapInArrow(pass_by, kinds)

    def beside(self, rows: DataFrame, trees: DataFrame, answer: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
        """answer(rows of a leaf, its tree), the rows dealt into parts of about MEET rows, each with a copy of the tree."""
        parts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts")).join(trees.select("leaf"), "leaf", "left_semi")
        dealt = rows.join(self.small(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(SEED)), F.col("parts")).cast("int")).drop("parts")
        copies = trees.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return dealt.groupBy("leaf", "part").cogroup(copies.groupBy("leaf", "part")).applyInArrow(answer, kinds)

    def split(self, index: DataFrame, asked: DataFrame, truth: DataFrame, dealing: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The next level: leaves of over SPLIT rows divided by a tree of their own; the others go on as their only child."""
        vectors, k, most = self.vectors, self.k, max(2, SAMPLE // self.width)
        large = index.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
        rank = F.pmod(F.xxhash64("uid", F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30)
        outside = F.broadcast(self.spark.createDataFrame([(int(u),) for u in self.trial_uids], "uid long"))
        sampled = index.join(self.small(large), "leaf").where(rank * F.col("n") < most).join(outside, "uid", "left_anti").select("leaf", "n", "x")

        def fit(own: pa.Table) -> pa.Table:
            leaves = min(LEAVES, max(2, own.column("n")[0].as_py() // LEAF))
            tree = Tree(unit(vectors(own.column("x"))), max(4, -(-own.num_rows // leaves)), LEAVES)
            return pa.table({"leaf": own.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        trees = cut(sampled.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"))
        kinds = f"{self.kinds}, leaf long"

        def place(own: pa.Table, tree: pa.Table) -> pa.Table:
            leaf = pickle.loads(tree.column("tree")[0].as_py()).assign(unit(vectors(own.column("x")))).astype(np.int64)  # noqa: S301
            return own.select(ROWS).append_column("leaf", pa.array(own.column("leaf").to_numpy() * LEAVES + leaf))

        only = lambda df: df.join(self.small(trees.select("leaf")), "leaf", "left_anti").withColumn("leaf", F.col("leaf") * LEAVES)
        new = cut(self.beside(index, trees, place, kinds).unionByName(only(index)))
        parent = F.call_function("div", F.col("leaf"), F.lit(LEAVES).cast("long"))
        bundles = dealing.select(F.col("leaf").alias("parent"), (F.col("b") * 2 * LEAVES + F.col("g")).alias("b"))
        along = Window.partitionBy("b").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        sizes = new.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("parent", parent).join(bundles, "parent")
        sizes = sizes.withColumn("at", F.floor(F.coalesce(F.sum("n").over(along), F.lit(0)) / chunk))
        sizes = cut(sizes.withColumn("g", F.dense_rank().over(Window.partitionBy("b").orderBy("at")).cast("long") - 1).select("leaf", "n", "b", "g"))
        held = sizes.groupBy(parent.alias("leaf")).agg(F.collect_list(F.struct(F.pmod("leaf", F.lit(LEAVES)).alias("own"), "n")).alias("held"))
        known = trees.join(held, "leaf")

        def with_sizes(tree: pa.Table) -> tuple[Tree, np.ndarray]:
            own = pickle.loads(tree.column("tree")[0].as_py())  # noqa: S301
            sizes = np.zeros(own.leaves, dtype=np.int64)
            for h in tree.column("held")[0].as_py():
                sizes[h["own"]] = h["n"]
            return own, sizes

        trials = self.trials

        def need(own: pa.Table, tree: pa.Table) -> pa.Table:
            t, sizes = with_sizes(tree)
            needs = [t.need(unit(trials[i]), leaf % LEAVES, sizes) for i, leaf in zip(own.column("t").to_pylist(), own.column("new").to_pylist(), strict=True)]
            return pa.table({"need": pa.array(needs, pa.float64())})

        now = cut(truth.join(new.select("uid", F.col("leaf").alias("new")), "uid"))
        far = margin([r["need"] for r in self.beside(now, known, need, "need double").collect()], self.share)
        children = sizes.groupBy("b", parent.alias("parent")).agg(F.collect_list(F.struct("leaf", "n", "g")).alias("children"))

        def bundle(own: pa.RecordBatch) -> dict[int, tuple[Tree | None, np.ndarray, np.ndarray]]:
            """By parent: its tree, and the sizes and groups of its leaves."""
            out = {}
            for p, tree, held in zip(own.column("parent").to_pylist(), own.column("tree").to_pylist(), own.column("children").to_pylist(), strict=True):
                made = pickle.loads(tree) if tree else None  # noqa: S301
                sizes, group = np.zeros((2, made.leaves if made else 1), dtype=np.int64)
                for h in held:
                    sizes[h["leaf"] % LEAVES], group[h["leaf"] % LEAVES] = h["n"], h["g"]
                out[p] = made, sizes, group
            return out

        def walk(parents: dict[int, tuple[Tree | None, np.ndarray, np.ndarray]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            b = batch.column("b")[0].as_py()
            for at in range(0, batch.num_rows, WALK):
                own = batch.slice(at, WALK)
                u, found = unit(vectors(own.column("x"))), []
                for p, which in by_leaf(own.column("leaves")):
                    tree, sizes, group = parents[p]
                    who, leaf = np.nonzero(tree.visits(u[which], far, sizes, k + 1).T) if tree else (np.arange(len(which)), np.zeros(len(which), dtype=np.int64))
                    found.append((which[who], p * LEAVES + leaf, group[leaf]))
                who, leaf, group = (np.concatenate([f[c] for f in found]) for c in range(3))
                order = np.lexsort((leaf, who))
                yield from by_group(own.select(["id", "x", "uid"]), who[order], leaf[order], b, group[order])

        together = children.join(trees.withColumnRenamed("leaf", "parent"), "parent", "left")
        here = asked.withColumn("b", F.col("b") * 2 * LEAVES + F.col("g")).drop("g")
        return new, cut(self.streamed(together, here, ["b"], bundle, walk, self.asking)), now.select("t", "uid", F.col("new").alias("leaf")), sizes

    def met(self, index: DataFrame, asked: DataFrame, dealing: DataFrame) -> DataFrame:
        """The k nearest of each query among the rows of the leaves that it visits."""
        dealing = dealing.withColumn("parts", F.ceil(F.col("n") / self.chunk).cast("int"))
        ways = F.broadcast if dealing.count() <= 1 << 20 else lambda df: df
        rows = index.join(ways(dealing.select("leaf", "b", "g", "parts")), "leaf")
        rows = rows.select("b", "g", F.pmod(F.xxhash64("uid", F.lit(SEED)), F.col("parts")).alias("part"), "id", "x", "uid", F.array("leaf").alias("leaves"))
        parts = dealing.groupBy("b", "g").agg(F.max("parts").alias("parts")).where(F.col("parts") > 1)
        asked = asked.join(ways(parts), ["b", "g"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
        vectors, k = self.vectors, self.k

        def ready(own: pa.RecordBatch) -> tuple:
            """The rows, those of a leaf beside one another, and the leaves' places."""
            leaf = own.column("leaves").flatten().to_numpy()
            order = np.argsort(leaf, kind="stable")
            x, leaf = vectors(own.column("x"))[order], leaf[order]
            begins = np.flatnonzero(np.diff(leaf, prepend=-1))
            at = {int(v): slice(a, b) for v, a, b in zip(leaf[begins], begins, [*begins[1:], len(leaf)], strict=True)}
            return at, x, unit(x), np.sqrt((x * x).sum(axis=1)), own.column("id").to_numpy()[order], own.column("uid").to_numpy()[order]

        def meet(rows: tuple, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at, *columns = rows
            ids, uids = columns[-2:]
            query, query_id = batch.column("uid").to_numpy(), batch.column("id").to_numpy()
            nearest, found = Nearest(vectors(batch.column("x")), query, k), []
            for v, which in by_leaf(batch.column("leaves")):
                if v in at:
                    i, j, score = nearest.among(which, *[c[at[v]] for c in columns])
                    found.append((i, j + at[v].start, score))
            i, j, score = joined(found)
            kept, _ = first_of_each(i, score, ids[j], uids[j], k)
            i, j, score = i[kept], j[kept], score[kept]
            yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(query_id[i]), pa.array(ids[j]), pa.array(uids[j]), pa.array(score)], ["query", "query_id", "vec_id", "uid", "score"])

        found = self.streamed(rows, asked, ["b", "g", "part"], ready, meet, "query long, query_id long, vec_id long, uid long, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ROWS = ["id", "x", "q", "uid"]


def by_leaf(leaves: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with the places of the lists that name it."""
    who, where = np.repeat(np.arange(len(leaves)), np.diff(leaves.offsets.to_numpy())), leaves.flatten().to_numpy()
    order = np.argsort(where, kind="stable")
    who, where = who[order], where[order]
    begins = np.flatnonzero(np.diff(where, prepend=-1))
    for a, b in zip(begins, [*begins[1:], len(where)], strict=True):
        yield int(where[a]), who[a:b]


def by_group(rows: pa.RecordBatch, who: np.ndarray, leaf: np.ndarray, b: int, g: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows (id, x, uid), each once for each group of its leaves, with these as a list; by row, then by leaf."""
    begins = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(g, prepend=-1) != 0))
    ends = np.append(begins[1:], len(who))
    for at in range(0, len(begins), BATCH):
        a, z = begins[at : at + BATCH], ends[at : at + BATCH]
        leaves = pa.ListArray.from_arrays(pa.array((np.append(a, z[-1]) - a[0]).astype(np.int32)), pa.array(leaf[a[0] : z[-1]].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([*rows.take(pa.array(who[a])).columns, pa.array(np.full(len(a), b)), pa.array(g[a]), leaves], ["id", "x", "uid", "b", "g", "leaves"])
