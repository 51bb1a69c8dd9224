"""Join of documents on the Jaccard similarity of their word n-gram sets by chosen paths.

A set is its n-gram hashes; equal sets form a class that is handled once. Sets
are split recursively: a node of the tree samples ``FANOUT`` coordinates of a
min-hash signature (shared tokens in the sense of the method), and a set goes
to the child of its own token at each. Buckets of up to ``SMALL`` sets are
compared by brute force, larger ones are split again, down to ``DEPTH`` or until a child
would hold most of its parent, which is counted before any set goes to its children.
What is left goes to one task, strip by strip, up to ``UNIT`` sets or ``GRAMS`` n-grams; only
beyond is it cut into blocks, and every pair of blocks is a unit of work of its own.
``runs`` trees are grown until the chance that a pair at the threshold meets nowhere is below ``1 - RECALL``.

A pair that meets in several buckets counts in the first only, which both
signatures tell, so links are counted inside the tasks and never written as
pairs. Sets travel only to buckets where they have a pair to verify; the
verification is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm.fragments import slices
from photospark.llm.repeats import Rolling, mix
from photospark.llm.scratch import keep, keyed, small
from photospark.llm.substrings import word_codes

NGRAM = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold is found; pairs above it are found with more.
RECALL = 0.999999
#: Signature coordinates, coordinates sampled per node, levels of the tree.
TOKENS = 32
FANOUT = 3
DEPTH = 3
#: Sets of a bucket from which it is split: below, copies of its rows for the children cost more than comparing signatures.
SMALL = 1024
#: Sets and n-grams a task compares at once: a bucket of more n-grams is split, too, and what could not be split is cut into blocks of as many.
UNIT = 4096
GRAMS = 1 << 21
#: A large bucket is compared without further splitting if one of its children holds this share of it.
ALIKE = 0.5
#: Rows of a task that are worked on at a time, pairs whose signatures are compared at a time, and pairs that are verified at a time.
CHUNK = 4096
STRIP = 1 << 16
PAIRS = 1 << 18
#: Odd multipliers that order the n-gram hashes, one per coordinate, by a rule.
FACTORS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def runs_needed(threshold: float, recall: float) -> int:
    """Trees until a pair at the threshold meets with chance ``recall``."""
    meet = 1.0
    for _ in range(DEPTH):
        meet = 1 - (1 - threshold * meet) ** FANOUT
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def least_equal(threshold: float, recall: float) -> int:
    """Equal signature tokens from which a pair is verified: a pair at the threshold has fewer with a tenth of the chance that the runs may miss it at most."""
    k, below = 0, (1 - threshold) ** TOKENS
    while k < TOKENS and below <= (1 - recall) / 10:
        k += 1
        below += math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k)
    return k


def tree(runs: int) -> list[tuple[int, ...]]:
    """All nodes as paths of coordinates, level by level. Runs take their first coordinates in turn, children follow on."""
    level = [(i % TOKENS,) for i in range(runs * FANOUT)]
    nodes = list(level)
    for _ in range(DEPTH - 1):
        deeper = []
        for n, path in enumerate(level):
            free = [c for c in range(TOKENS) if c not in path]
            deeper += [(*path, free[(7 * n + 11 * k + len(path)) % len(free)]) for k in range(FANOUT)]
        nodes += deeper
        level = deeper
    return nodes


def ngram_sets(codes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes text by text, sorted within a text, offsets)."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = Rolling(codes)(at, at + width)
    order = np.lexsort((grams, row))
    grams = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(counts)))])


def signatures(docs: DataFrame, width: int = NGRAM) -> DataFrame:
    """doc_id, k1, k2 (hash of the set), n (its size) and its signature, for documents with at least one n-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, offsets = ngram_sets(*word_codes(batch.column(1)), width)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            if not len(full):
                continue
            cut = offsets[full]
            tokens = np.stack([np.minimum.reduceat(grams * f, cut) >> np.uint64(32) for f in FACTORS], axis=1).astype(np.uint32).view(np.int32)
            keys = [np.add.reduceat(mix(grams ^ np.uint64(s)), cut).view(np.int64) for s in (0x5BD1, 0xC2B2)]
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * TOKENS, pa.int32()), pa.array(tokens.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), *map(pa.array, keys), pa.array(size[full].astype(np.int32)), sig], ["doc_id", "k1", "k2", "n", "sig"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n int, sig array<int>")


def _buckets(classes: DataFrame, nodes: list[tuple[int, ...]], runs: int) -> tuple[DataFrame, DataFrame]:
    """(leaf rows: rep, node, bucket, size, grams; open rows: rep, node) of all sets that share a bucket."""
    sigs = classes.select("rep", "sig")
    first = range(runs * FANOUT)
    rows = classes.select("rep", "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("node"), F.xxhash64(F.lit(i), F.get("sig", nodes[i][0])).alias("bucket")) for i in first])).alias("x")).select("rep", "n", "x.*")
    leaf = ("rep", "node", "bucket", "size", "grams")
    large = (F.col("size") > SMALL) | (F.col("grams") > GRAMS)
    leaves, opened = [], []
    children = {path: [] for path in nodes}
    for i, path in enumerate(nodes):
        if len(path) > 1:
            children[path[:-1]].append((i, path[-1]))
    begin = 0
    for depth in range(DEPTH):
        rows = keep(rows, "paths")
        sizes = keep(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams")).filter("size > 1"), "bucket-sizes")
        met = rows.join(sizes, "bucket")
        if depth == DEPTH - 1:
            leaves.append(met.select(*leaf))
            break
        leaves.append(met.filter(~large).select(*leaf))
        # only what is split further needs its signature again
        larger = keep(met.filter(large).join(sigs, "rep"), "larger")
        level = [p for p in nodes if len(p) == depth + 1]
        kids = F.create_map(*[v for i, path in enumerate(level, begin) for v in (F.lit(i), F.array(*[
            F.struct(F.lit(c).alias("node"), F.lit(t).alias("token")) for c, t in children[path]]))])
        begin += len(level)
        own = F.get(F.array(kids), 0)[F.col("node")]
        # where a child would hold most of its parent, the sets are alike and splitting them further only repeats them
        most = [larger.groupBy("bucket", "size", F.get("sig", F.get(own, k)["token"]).alias("token")).agg(F.count(F.lit(1)).alias("held"))
                .filter(F.col("held") >= ALIKE * F.col("size")).select("bucket") for k in range(FANOUT)]
        alike = small(keep(reduce(DataFrame.unionByName, most).distinct(), "alike"))
        leaves.append(larger.join(alike, "bucket", "left_semi").select(*leaf))
        split = larger.join(alike, "bucket", "left_anti")
        opened.append(split.select("rep", "node"))
        grown = split.select("rep", "n", "sig", F.col("bucket").alias("parent"), F.explode(own).alias("x"))
        rows = grown.select("rep", "n", "x.node", F.xxhash64("parent", "x.node", F.get("sig", F.col("x.token"))).alias("bucket"))
    return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, opened)


def _units(leaves: DataFrame) -> DataFrame:
    """Leaf rows as units of work: a bucket, or all pairs of its blocks if it passes ``UNIT`` sets or ``GRAMS`` n-grams."""
    blocks = F.greatest(F.ceil(F.col("size") / UNIT), F.ceil(F.col("grams") / GRAMS)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), "rep"), blocks.cast("bigint")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(own, b).alias("low"), F.greatest(own, b).alias("high")))
    rows = leaves.withColumn("own", own).withColumn("cell", F.explode(cells))
    return rows.select("rep", "node", F.xxhash64("bucket", "cell.low", "cell.high").alias("unit"), (F.col("own") == F.col("cell.high")).alias("late"),
                       (F.col("cell.low") < F.col("cell.high")).alias("across"))


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a unit in two; input sorted by unit."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held)
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield table.slice(0, cut)
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


class _Pairs:
    """Pairs of a table of whole units that are first met here and may reach the threshold."""

    def __init__(self, table: pa.Table, nodes: list[tuple[int, ...]], threshold: float, least: int):
        self.nodes, self.threshold, self.least = nodes, threshold, least
        self.unit, self.node, self.n = (table.column(c).to_numpy() for c in ("unit", "node", "n"))
        self.late, self.across = (table.column(c).to_numpy().astype(bool) for c in ("late", "across"))
        self.sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
        self.tokens = np.ascontiguousarray(self.sig.T)
        self.open = np.zeros((table.num_rows, len(nodes)), bool)
        lists = table.column("open").combine_chunks()
        self.open[np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
        edge = np.flatnonzero(np.append(True, self.unit[1:] != self.unit[:-1]))
        self.groups = list(zip(edge.tolist(), np.append(edge[1:], len(self.unit)).tolist(), strict=True))
        index = {path: i for i, path in enumerate(nodes)}
        self.parents = [[index[path[:k]] for k in range(1, len(path))] for path in nodes]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left rows, right rows) of about ``PAIRS`` pairs at a time, one strip more at most."""
        held, count = [], 0
        for i, j in self._near():
            pair = self._first_met(i, j)
            held.append(pair)
            count += len(pair[0])
            if count > PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, count = [], 0
        if count:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def _near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a unit with enough equal tokens: small units together, of a larger one a strip of rows at a time."""
        held, count = [], 0
        for a, b in self.groups:
            if b - a > 64:
                high = max(1, STRIP // (b - a))
                for top in range(a, b, high):
                    stop = min(top + high, b)
                    same = np.zeros((stop - top, b - top), np.uint8)
                    for token in self.tokens:
                        same += token[top:stop, None] == token[None, top:b]
                    i, j = np.nonzero(same >= self.least)
                    later = j > i
                    yield i[later] + top, j[later] + top
                continue
            i, j = np.triu_indices(b - a, 1)
            held.append((i + a, j + a))
            count += len(i)
            if count > STRIP:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, count = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def _first_met(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = self.n[i], self.n[j]
        # between two blocks only the pairs across count, those within are a unit of their own
        good = (np.minimum(n, m) >= self.threshold * np.maximum(n, m)) & (~self.across[i] | (self.late[i] != self.late[j]))
        i, j = i[good], j[good]
        equal = self.sig[i] == self.sig[j]
        good = equal.sum(axis=1) >= self.least
        i, j, equal = i[good], j[good], equal[good]
        here = self.node[i]
        first = np.full(len(i), -1)
        todo = np.arange(len(i))
        for v, path in enumerate(self.nodes):
            if not len(todo):
                break
            met = np.all(equal[np.ix_(todo, path)], axis=1)
            for u in self.parents[v]:
                met &= self.open[i[todo], u]
            if len(path) < DEPTH:
                met &= ~self.open[i[todo], v]
            first[todo[met]] = v
            todo = todo[~met]
        return i[first == here], j[first == here]


def _verified(table: pa.Table, nodes: list[tuple[int, ...]], threshold: float, least: int) -> pa.RecordBatch:
    """Per row of whole units: links (documents behind the sets it reaches) and the smallest set it hangs together with."""
    pairs = _Pairs(table, nodes, threshold, least)
    rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
    sets = table.column("grams").combine_chunks()
    grams, off = sets.flatten().to_numpy(), sets.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        common = _common(i, j, grams, off)
        both = pairs.n[i].astype(np.int64) + pairs.n[j] - common
        good = common >= threshold * both - 1e-9
        i, j = i[good], j[good]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    group = np.array([find(x) for x in range(len(rep))], np.int64)
    linked = np.flatnonzero(links > 0)
    knot = mix(pairs.unit[linked].astype(np.int64).view(np.uint64) + rep[group[linked]].astype(np.int64).view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(links[linked]), pa.array(knot)], ["rep", "links", "knot"])


def _common(i: np.ndarray, j: np.ndarray, grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    out = np.zeros(len(i), np.int64)
    rows = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(rows):
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            out[k] = len(np.intersect1d(grams[off[a] : off[a + 1]], grams[off[b] : off[b + 1]], assume_unique=True))
        return out
    # many pairs of few sets: products of 0/1 tiles over the tokens that occur twice
    size = np.diff(off)[rows]
    member = np.repeat(np.arange(len(rows)), size)
    _, code, count = np.unique(np.concatenate([grams[off[r] : off[r + 1]] for r in rows]), return_inverse=True, return_counts=True)
    shared = count > 1
    inside = shared[code]
    member, code = member[inside], (np.cumsum(shared) - 1)[code[inside]]
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    left, right = np.searchsorted(rows, i), np.searchsorted(rows, j)
    cells = left // 512 * len(rows) + right // 512
    by = np.argsort(cells, kind="stable")
    for mine in np.split(by, np.flatnonzero(np.diff(cells[by])) + 1):
        low, low2 = left[mine[0]] // 512 * 512, right[mine[0]] // 512 * 512
        total = np.zeros((512, 512))
        for c in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(code, [c, c + 4096])
            total += _tile(member[a:b] - low, code[a:b] - c) @ _tile(member[a:b] - low2, code[a:b] - c).T
        out[mine] = total[left[mine] - low, right[mine] - low2].astype(np.int64)
    return out


def _tile(member: np.ndarray, code: np.ndarray) -> np.ndarray:
    """512 sets by 4096 tokens: 1 where the set holds the token."""
    mine = (member >= 0) & (member < 512)
    tile = np.zeros((512, 4096), np.float32)
    tile[member[mine], code[mine]] = 1
    return tile


def _components(knots: DataFrame) -> DataFrame:
    """rep, label: smallest set of the component, for (rep, knot) rows; a knot ties at most one unit's sets together."""
    labels = keep(knots.select("rep").distinct().withColumn("label", F.col("rep")), "labels")
    while True:
        seen = knots.join(labels, "rep")
        least = keep(seen.groupBy("knot").agg(F.min("label").alias("label")), "knot-labels")
        new = knots.join(least, "knot").groupBy("rep").agg(F.min("label").alias("label"))
        new = keep(new, "labels-new")
        jump = new.select(F.col("rep").alias("label"), F.col("label").alias("further"))
        new = keep(new.join(jump, "label").select("rep", F.least("label", "further").alias("label")), "labels")
        changed = not new.join(labels, ["rep", "label"], "left_anti").isEmpty()
        labels = new
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, set_id, n_links: one row per document with an id.

    ``n_links`` counts the other documents whose ``width``-word n-gram sets
    have a Jaccard similarity of at least ``threshold``; ``set_id`` is the
    smallest document with the same set; ``class_id`` the smallest document of
    the connected group. Documents of fewer than ``width`` words (null and
    empty texts too) have no set: no links, a class of their own. Rows that
    repeat an id count as copies. Runs jobs while it is built; steps are
    written to the shared folder.
    """
    runs, least = runs_needed(threshold, recall), least_equal(threshold, recall)
    nodes = tree(runs)
    sets = keep(signatures(docs, width), "signatures")
    classes = keep(sets.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    leaves, opened = _buckets(classes, nodes, runs)
    units = keep(_units(leaves), "units")
    open_ = opened.groupBy("rep").agg(F.collect_list("node").alias("open"))
    facts = keep(units.select("rep").distinct().join(classes.select("rep", "weight", "n", "sig"), "rep").join(open_, "rep", "left").withColumn(
        "open", F.coalesce("open", F.array().cast("array<int>"))), "facts")
    columns = ("rep", "unit", "node", "late", "across", "weight", "n", "sig", "open")

    def dealt(rows: DataFrame) -> DataFrame:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "unit").sortWithinPartitions("unit", "rep")

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            used = np.zeros(table.num_rows, bool)
            for i, j in _Pairs(table, nodes, threshold, least):
                used[i] = used[j] = True
            if used.any():
                yield from table.filter(pa.array(used)).combine_chunks().to_batches()

    ddl = "rep bigint, unit bigint, node int, late boolean, across boolean, weight bigint, n int, sig array<int>, open array<int>"
    needed = keep(dealt(units.join(facts, "rep").select(*columns)).mapInArrow(needs, ddl), "needed")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = ngram_sets(*word_codes(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))], ["rep", "grams"])

    wanted = small(keep(needed.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    whole = texts.mapInArrow(grams, "rep bigint, grams array<bigint>")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 512):
            yield _verified(table, nodes, threshold, least)

    found = keep(dealt(needed.join(whole, "rep")).mapInArrow(verify, "rep bigint, links bigint, knot bigint"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = classes.select("k1", "k2", "rep", "weight").join(links, "rep", "left").join(_components(found.select("rep", "knot")), "rep", "left")
    linked = keep(linked.select("k1", "k2", "rep", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "linked")
    members = sets.select("doc_id", "k1", "k2").join(linked, ["k1", "k2"]).select(
        "doc_id", F.col("label").alias("class_id"), F.col("rep").alias("set_id"), F.col("links").alias("n_links"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    alone = ids.join(sets.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("bigint").alias("n_links"))
    return members.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = NGRAM) -> DataFrame:
    """``docs`` with one row of each connected group of near duplicates: the one with the smallest id, the first of such rows, rows without id last.

    Rows count by themselves, whatever their id: texts that are unlike stay even
    if they share an id, and copies go even if they have none.
    """
    rows = keyed(docs)
    classes = near_duplicates(rows.select("doc_id", "text"), threshold, width).select("doc_id", "class_id")
    own = rows.select("doc_id", F.col("row")["doc_id"].alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "doc_id"))["doc_id"]
    kept = classes.join(own, "doc_id").groupBy("class_id").agg(first.alias("doc_id")).select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
