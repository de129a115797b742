"""MinHash near-duplicate detection by the chosen-path set similarity join.

Every document is a set of word shingles with a sketch of minwise tokens. Equal sets are one document from the start.
A tree of the join branches on tokens: its root on one coordinate of the sketch, every larger node on a few
coordinates chosen by the node's own hash, so that documents that agree there stay together. A node of at most
``leaf`` documents is compared exhaustively (on sketches, then on the full sets); independent trees are repeated. A
pair of similarity s meets in one tree with probability s at the root and 1 - (1 - s)**branch at a further level:
with 10 trees, a pair at 0.8 is missed at the roots with probability 0.2**10.

Only what components need is compared. Members of small nodes are first joined by a spanning forest of their most
alike pairs, those of larger nodes with a few central members (nearest to the commonest tokens of a sample of the
node); these pairs are verified and give first components. After that only pairs of different components count: in
small nodes all of them; in large nodes with one large component, each outsider against it and the other outsiders in
blocks, once for all trees; other large nodes branch on. Nodes that are still large at the last level are compared in
blocks, so nothing is dropped for being frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import NULL_ID, given_id, ids_side, keyed, mix, pack, partitions, text_chunks, unpack, window_hashes, word_hashes, word_spans, written
from manyfold.llm.components import components

TOKENS = 48
TREES = 10
LEAF = 256
LEVELS = 6
PIVOTS = 3
#: Outsiders of a large component that are compared in blocks, at most; with more, the node branches.
OUTSIDERS = 1024
_MULTIPLIERS = np.random.default_rng(71).integers(1, 2**63, (TOKENS, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column, shingle: int):
    """For runs of texts: (first row, number of texts, text of each distinct shingle, its hash), sorted by both."""
    for row, data, offsets in text_chunks(column):
        start, end, first = word_spans(data, offsets)
        n = len(first) - 1
        words = word_hashes(data, start, end, fold_case=True)
        counts = np.diff(first)
        text = np.repeat(np.arange(n), counts)
        hashes = window_hashes(words, shingle)
        inside = np.arange(len(hashes)) - first[text[: len(hashes)]] + shingle <= counts[text[: len(hashes)]]
        texts, values = [text[: len(hashes)][inside]], [hashes[inside]]
        for size in range(1, shingle):  # a shorter text is one shingle
            short = np.flatnonzero(counts == size)
            if len(short):
                texts.append(short)
                values.append(mix(window_hashes(words, size)[first[short]] + np.uint64(size)))
        texts, values = np.concatenate(texts), np.concatenate(values)
        order = np.lexsort((values, texts))
        texts, values = texts[order], values[order]
        new = np.ones(len(texts), bool)
        new[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
        yield row, n, texts[new], values[new]


def _sketches(shingle: int):
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("sketch", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, texts, values in shingle_sets(batch.column(1), shingle):
                counts = np.bincount(texts, minlength=n)
                some = np.flatnonzero(counts)
                starts = np.concatenate(([0], np.cumsum(counts[some])))[:-1]
                sets = np.zeros((2, n), np.uint64)
                sketch = np.zeros((n, TOKENS), np.int32)
                if len(some):
                    for k, odd in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
                        sets[k, some] = np.add.reduceat(mix(values * np.uint64(odd)), starts)
                    for k, (times, plus) in enumerate(_MULTIPLIERS):
                        sketch[some, k] = (np.minimum.reduceat(values * times + plus, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TOKENS), pa.array(sketch.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(counts.astype(np.int64)), pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64)), lists], schema=schema)

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, texts, values in shingle_sets(batch.column(1), shingle):
                cuts = np.searchsorted(texts, np.arange(n + 1))
                sets = [pack(values[a:b] >> np.uint64(16)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return run


def _alike(one: np.ndarray, two: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= similarity * (len(one) + len(two) - both)


def _linked(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, one = [], None, None
            for k, (a, b) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                a = a.as_py()
                if a != last:
                    last, one = a, unpack(a, np.uint64)[0]
                if _alike(one, unpack(b.as_py(), np.uint64)[0], similarity):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def least_agreement(similarity: int) -> int:
    """Tokens that sketches of a linked pair share at least; fewer happen to one pair in 100,000 at the threshold."""
    s = similarity / 100
    return max(1, int(TOKENS * s - 4.4 * (TOKENS * s * (1 - s)) ** 0.5))


class _Forest:
    def __init__(self, labels: list[int]):
        self.root = {x: x for x in labels}

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.root[self.find(b)] = self.find(a)


def _nodes(table: pa.Table):
    """Columns of a bucket in order of node and document, and the bounds of its nodes."""
    table = table.combine_chunks()
    order = pc.sort_indices(table, sort_keys=[("node", "ascending"), ("rep", "ascending")])
    table = table.take(order).combine_chunks()
    nodes = table.column("node").to_numpy()
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))), [len(nodes)]))
    lists = table.column("sketch").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return table, nodes, lists.flatten().to_numpy().reshape(len(nodes), TOKENS), list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _candidates(lo: int, hi: int, ids, sizes, labels, sketch, similarity: int):
    """Pairs of a node whose labels differ and whose sketches agree, the most alike first."""
    left, right = np.triu_indices(hi - lo, 1)
    left, right = left + lo, right + lo
    ok = (labels[left] != labels[right]) & (ids[left] != ids[right])
    ok &= 100 * np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right])
    left, right = left[ok], right[ok]
    if not len(left):
        return left, right
    agree = np.concatenate([(sketch[left[k : k + 4096]] == sketch[right[k : k + 4096]]).sum(1) for k in range(0, len(left), 4096)])
    order = np.argsort(-agree, kind="stable")
    order = order[agree[order] >= least_agreement(similarity)]
    return left[order], right[order]


def _spanning(similarity: int):
    """(a, b): of each node, a spanning forest of the candidate pairs."""

    def run(table: pa.Table) -> pa.Table:
        table, _, sketch, bounds = _nodes(table)
        ids, sizes = table.column("rep").to_numpy(), table.column("n").to_numpy()
        out = []
        for lo, hi in bounds:
            left, right = _candidates(lo, hi, ids, sizes, ids, sketch, similarity)
            if len(left):
                forest = _Forest(ids[lo:hi].tolist())
                for a, b in zip(ids[left].tolist(), ids[right].tolist(), strict=True):
                    if forest.find(a) != forest.find(b):
                        forest.join(a, b)
                        out.append((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _open(similarity: int):
    """(node, rep): members of each node that are in a candidate pair of different components."""

    def run(table: pa.Table) -> pa.Table:
        table, _, sketch, bounds = _nodes(table)
        ids, sizes, labels = (table.column(c).to_numpy() for c in ("rep", "n", "label"))
        at = [np.unique(np.concatenate(_candidates(lo, hi, ids, sizes, labels, sketch, similarity))) for lo, hi in bounds]
        return table.select(["node", "rep"]).take(pa.array(np.concatenate(at).astype(np.int64)))

    return run


def _exact(similarity: int):
    """(a, b): of each node, links between components, on full sets; pairs that are joined already are passed over."""

    def run(table: pa.Table) -> pa.Table:
        table, _, sketch, bounds = _nodes(table)
        ids, sizes, labels = (table.column(c).to_numpy() for c in ("rep", "n", "label"))
        packed, out = table.column("hashes"), []
        for lo, hi in bounds:
            sets = {k: unpack(packed[k].as_py(), np.uint64)[0] for k in range(lo, hi)}
            forest = _Forest(labels[lo:hi].tolist())
            for a, b in zip(*(x.tolist() for x in _candidates(lo, hi, ids, sizes, labels, sketch, similarity)), strict=True):
                if forest.find(int(labels[a])) != forest.find(int(labels[b])) and _alike(sets[a], sets[b], similarity):
                    forest.join(int(labels[a]), int(labels[b]))
                    out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _central(similarity: int):
    """(node, pivot): the members of each node that agree most with its commonest tokens.

    A member that less than a twentieth of the node is a candidate of is no pivot: starring it would join next to
    nothing. What is left unjoined is compared later.
    """
    return lambda table: _pivots(table, least_agreement(similarity))


def _pivots(table: pa.Table, least: int) -> pa.Table:
    table, nodes, sketch, bounds = _nodes(table)
    ids, at = table.column("rep").to_numpy(), [np.zeros(0, np.int64)]
    for lo, hi in bounds:
        part = np.sort(sketch[lo:hi], axis=0)
        common = np.empty(TOKENS, np.int32)
        for k in range(TOKENS):
            values, counts = np.unique(part[:, k], return_counts=True)
            common[k] = values[counts.argmax()]
        agree = (sketch[lo:hi] == common).sum(1)
        central = lo + np.argsort(-agree, kind="stable")[:PIVOTS]
        near = np.array([((sketch[lo:hi] == sketch[k]).sum(1) >= least).sum() - 1 for k in central])
        at.append(central[near >= max(2, (hi - lo) / 20)])
    at = np.concatenate(at)
    return pa.table({"node": nodes[at], "pivot": ids[at]})


class _Join:
    def __init__(self, docs: DataFrame, shingle: int, similarity: int):
        self.docs, self.shingle, self.similarity = docs, shingle, similarity
        self.buckets = partitions(docs.sparkSession)
        self.sketches = written(docs.mapInArrow(_sketches(shingle), "_id long, n long, set1 long, set2 long, sketch array<int>"), "sketches")
        self.reps = written(
            self.sketches.filter("n > 0").groupBy("set1", "set2").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
            "distinct-sets",
        )

    def grown(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, rep) -> members of nodes with 2 to LEAF members, and of larger ones with the node's size."""
        members = written(members.distinct(), "nodes")
        counts = written(members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node-sizes")
        sized = written(members.join(counts, "node"), "sized-nodes")
        return sized.filter(F.col("size") <= LEAF).select("node", "rep"), sized.filter(F.col("size") > LEAF)

    def by_bucket(self, members: DataFrame, finer: int = 1):
        """Many nodes to a bucket, as a group costs more than a small node; finer for rows with whole sets."""
        rows = members.join(self.reps.select("rep", "n", "sketch"), "rep")
        return rows.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(self.buckets * finer)).cast("int")).groupBy("bucket")

    def stars(self, large: DataFrame) -> DataFrame:
        """(a, b): each member of a large node with the node's central members, where sketches agree."""
        sample = large.filter(F.pmod(F.xxhash64("node", "rep"), F.col("size")) < LEAF).select("node", "rep")  # about LEAF of each
        pivots = written(self.by_bucket(sample).applyInArrow(_central(self.similarity), "node long, pivot long"), "pivots")
        edges = large.join(pivots, "node").filter("rep != pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        one = self.reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        two = self.reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        agree = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
        near = (100 * F.least("n_a", "n_b") >= self.similarity * F.greatest("n_a", "n_b")) & (agree >= least_agreement(self.similarity))
        return edges.join(one, "a").join(two, "b").filter(near).select("a", "b")

    def children(self, members: DataFrame) -> DataFrame:
        """Each member of a node to a child for the one or two coordinates that the node's hash selects."""
        rows = members.join(self.reps.select("rep", "sketch"), "rep")
        at = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS)).cast("int") for k in (0, 1)]
        both = [F.xxhash64("node", i, F.col("sketch")[i]) for i in at]
        return rows.select(F.explode(F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(2)) == 0, F.array(*both)).otherwise(F.array(both[0]))).alias("node"), "rep")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        return written(self.docs.join(ids_side(ids), "_id", "left_semi").mapInArrow(_full_sets(self.shingle), "id long, hashes binary"), "full-sets")

    def verified(self, edges: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
        return written(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_linked(self.similarity), "a long, b long"), "links")

    def labelled(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        rows = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        return rows.withColumn("label", F.coalesce("component", "rep")).drop("component")

    def sorted_out(self, large: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(blocks of large components with their few outsiders, members of the other mixed nodes with sizes)."""
        rows = written(self.labelled(large, labels), "large-nodes")
        shares = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        most = shares.groupBy("node").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
        most = written(most.filter("labels > 1").select("node", F.col("top.label").alias("core"), F.col("top.n").alias("inside"), (F.col("all") - F.col("top.n")).alias("outside")), "cores")
        rows = rows.join(most, "node")
        few = (F.col("inside") > LEAF) & (F.col("outside") <= OUTSIDERS)
        # one node for each large component, whatever the tree
        family = written(rows.filter(few).select("core", "rep", (F.col("label") == F.col("core")).alias("in_core")).distinct(), "families")
        sizes = family.groupBy("core").agg(F.sum(F.col("in_core").cast("long")).alias("inside"), F.sum((~F.col("in_core")).cast("long")).alias("outside"))
        half = LEAF // 2
        family = family.join(written(sizes, "family-sizes"), "core")
        k_in, k_out = (F.ceil(F.col(c) / half).cast("int") for c in ("inside", "outside"))
        mine = F.pmod(F.xxhash64("rep"), F.when(F.col("in_core"), k_in).otherwise(k_out)).cast("int")
        with_core = F.transform(F.sequence(F.lit(0), k_in - 1), lambda j: F.xxhash64("core", F.lit("core"), j, mine))
        with_others = F.transform(F.sequence(F.lit(0), k_out - 1), lambda j: F.xxhash64("core", F.lit("others"), F.least(mine, j), F.greatest(mine, j)))
        inside = F.transform(F.sequence(F.lit(0), k_out - 1), lambda j: F.xxhash64("core", F.lit("core"), mine, j))
        blocks = family.select(F.explode(F.when(F.col("in_core"), inside).otherwise(F.concat(with_core, with_others))).alias("node"), "rep")
        return blocks, rows.filter(~few).select("node", "rep", "size")

    def blocks(self, members: DataFrame) -> DataFrame:
        """What is still large and mixed at the last level: nodes of the members of blocks i and j, for all pairs."""
        k = F.ceil(F.col("size") / (LEAF // 2)).cast("int")
        mine = F.pmod(F.xxhash64("rep"), k).cast("int")
        return members.select("node", "rep", mine.alias("mine"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other")).select(
            F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "rep"
        )

    def cross_links(self, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components within nodes, on full sets."""
        opened = written(self.by_bucket(self.labelled(members, labels)).applyInArrow(_open(self.similarity), "node long, rep long"), "open")
        lacking = written(opened.select(F.col("rep").alias("_id")).distinct().join(sets.select(F.col("id").alias("_id")), "_id", "left_anti"), "lacking")
        if lacking.take(1):
            sets = sets.unionByName(self.sets_of(lacking))
        rows = self.labelled(opened, labels).join(sets.withColumnRenamed("id", "rep"), "rep")
        return written(self.by_bucket(rows, 32).applyInArrow(_exact(self.similarity), "a long, b long").distinct(), "links")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links: components of the components, a graph of those only that a new link touches."""
    of_a, of_b = (labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    links = more.join(of_a, "a", "left").join(of_b, "b", "left")
    joined = components(links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    known = labels.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    fresh = joined.select(F.col("component").alias("id"), F.col("whole").alias("component")).join(labels.select("id"), "id", "left_anti")
    return written(known.unionByName(fresh), "labels")


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, n_shingles, component_id, kept.

    A-Z is lower-cased, words are [^ \\t-\\r]+, a document is its set of distinct shingles (with fewer words than
    that, of the whole sequence; without words the set is empty and links with nothing). Documents are linked when
    100 * intersection >= similarity * union on the full sets. component_id is the least id in the document's
    component and kept tells whether that is its own. Rows that share an id are linked as one document if any of their
    texts links; each row takes the component of its own text's set.
    """
    join = _Join(keyed(docs, id_col, text_col), shingle, similarity)
    roots = join.reps.select("rep", F.posexplode(F.slice("sketch", 1, TREES)).alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "rep")
    small, large = join.grown(roots)
    forest = join.by_bucket(small).applyInArrow(_spanning(similarity), "a long, b long")
    edges = written(forest.unionByName(join.stars(large)).distinct(), "candidates")
    sets = join.sets_of(written(edges.select(F.col("a").alias("_id")).union(edges.select("b")).distinct(), "candidate-ids"))
    links = join.verified(edges, sets)
    labels = components(links)

    leaves = [small]
    for level in range(2, LEVELS + 1):
        families, rest = join.sorted_out(large, labels)
        leaves.append(families)
        rest = written(rest, "rest")
        if not rest.take(1):
            break
        if level == LEVELS:
            leaves.append(join.blocks(rest))
            break
        small, large = join.grown(join.children(rest.select("node", "rep")))
        leaves.append(small)
    more = join.cross_links(reduce(DataFrame.unionByName, leaves), labels, sets)
    if more.take(1):
        labels = merged(labels, more)
    of_set = written(join.reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set1", "set2", F.coalesce("component", "rep").alias("component")), "set-components")
    return join.sketches.select("_id", "n", "set1", "set2").join(of_set, ["set1", "set2"], "left").select(
        "_id",
        F.col("n").alias("n_shingles"),
        given_id(F.coalesce(F.when(F.col("n") > 0, F.col("component")), "_id")).alias("component_id"),
        (F.col("_id") == F.coalesce(F.when(F.col("n") > 0, F.col("component")), "_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the least id; columns unchanged.

    Only the ids that go take part in the anti-join; documents without words stay, and so do all rows of an id that
    is kept for one of its texts.
    """
    verdict = written(near_dedup(docs, shingle, similarity, id_col, text_col), "near-copies")
    gone = verdict.groupBy("_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("_id").alias("_gone"))
    gone = ids_side(written(gone, "gone"))
    row_id = F.coalesce(F.col(f"_docs.{id_col}").cast("long"), F.lit(NULL_ID))
    return docs.alias("_docs").join(gone.alias("_out"), row_id == F.col("_out._gone"), "left_anti")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS z FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.z = e.a),
m AS (SELECT id, min(z) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
