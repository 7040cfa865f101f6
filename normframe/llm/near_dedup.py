"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word 5-grams. Sets are sketched by minwise
tokens. Each of several independent trees branches the documents: a node picks
one or (with the chance that keeps a similar pair's expected number of common
children at one or more) two token positions by a hash of its path, and a
document goes to the child of its token there. Nodes small enough are compared
exhaustively, as one leaf or in blocks of two parts each; larger nodes branch
on. Pairs that share a leaf in any tree and look similar form candidate groups.
Every candidate group is then checked on full sets: exhaustively if it is as
small as such nodes, and else in the leaves of its trees.

Large families of near copies share nearly all tokens, so branching does not
part them. They are linked first, in parts of large roots that share a document.
A large node of one family and few other documents is then finished: these meet
everything in it, and the family's own pairs, linked already, are left out.

Documents with equal sets are one class from the start, so a group of copies of
any size costs one member; links between different sets are confirmed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, labels_of, whole_groups
from .shared import materialize, read_table, remove, utf8
from .textscan import SPACED, mix64, shingles, slices, words

#: Minwise tokens of a sketch, and documents of a leaf.
TOKENS, LEAF = 64, 1000
#: The chance that a pair at the threshold shares a leaf of no tree, and the one that its sketches agree too little; they set the trees and the cut.
MISS = 3e-6
#: Leaves that a node may hold to be compared whole, in blocks, and trees whose larger roots are searched for families first.
BLOCKED, FIRST = 8, 3
#: Levels after which a node that never fell apart is compared in blocks.
DEPTH = 30
#: Candidate documents up to which the table of candidates is broadcast to the scan of texts.
BROADCAST_ROWS = 500_000

_ODD = (np.random.default_rng(7).integers(1, 1 << 63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def trees_for(threshold: float, levels: int = 0) -> int:
    """Independent trees, so that a pair at the threshold misses a root (of two tokens), or is parted in ``levels`` further levels, in all trees with a chance of MISS at most."""
    if threshold >= 1:
        return 1
    both, parted = 1 / threshold - 1, 0.0
    for _ in range(levels):
        one = 1 - threshold + threshold * parted  # by one token
        parted = (1 - both) * one + both * one**2
    return math.ceil(math.log(MISS) / math.log(1 - threshold**2 * (1 - parted)))


def agreement_for(threshold: float) -> int:
    """Equal sketch tokens of a candidate pair, so that a pair at the threshold has fewer with a chance of MISS at most."""
    tail, least = 0.0, 0
    while least < TOKENS:
        tail += math.comb(TOKENS, least) * threshold**least * (1 - threshold) ** (TOKENS - least)
        if tail > MISS:
            break
        least += 1
    return least


class Sets:
    """The shingle sets of a slice of texts: sorted distinct hashes, one document after the other."""

    def __init__(self, column: pa.Array, width: int):
        found = words(column, SPACED)
        h, doc = shingles(found, width)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, doc = h[new], doc[new]
        self.sizes = np.bincount(doc, minlength=found.n_docs).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.some = np.flatnonzero(self.sizes)

    def prints(self) -> np.ndarray:
        """A 64-bit fingerprint of each set; equal sets have equal ones. Zero for empty sets."""
        out = np.zeros(len(self.sizes), np.uint64)
        if len(self.some):
            at = self.bounds[:-1][self.some]
            out[self.some] = mix64(np.add.reduceat(mix64(self.hashes ^ np.uint64(0x8CB92BA72F3D8DD7)), at) + self.sizes[self.some].astype(np.uint64))
        return out.view(np.int64)

    def sketches(self) -> np.ndarray:
        """TOKENS minwise tokens of each set (zeros for empty sets)."""
        out = np.zeros((len(self.sizes), TOKENS), np.uint32)
        if len(self.some):
            at = self.bounds[:-1][self.some]
            for t in range(TOKENS):
                out[self.some, t] = np.minimum.reduceat((self.hashes * _ODD[t]) >> np.uint64(32), at)
        return out.view(np.int32)


def sketch_documents(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc, n_shingles, node (the set's fingerprint) and sketch of each document. No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = Sets(part.column(1), width)
                sketch = pa.FixedSizeListArray.from_arrays(pa.array(sets.sketches().ravel()), TOKENS).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets.sizes), pa.array(sets.prints()), sketch], ["doc", "n_shingles", "node", "sketch"])

    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc"), utf8(text_col).alias("text"))
    return docs.mapInArrow(scan, f"doc {kind}, n_shingles bigint, node bigint, sketch array<int>")


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """The next level: (node, sketch, path) with the paths of the children a document goes to."""
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
    both = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1_000_000)) < F.lit(int((1 / threshold - 1) * 1_000_000))
    chosen = F.when(both, F.array(first, second)).otherwise(F.array(first))
    out = rows.withColumn("_at", F.explode(chosen))
    return out.withColumn("path", F.xxhash64("path", "_at", F.element_at("sketch", F.col("_at") + 1))).drop("_at")


def leaves(
    sketches: DataFrame, threshold: float, trees: int | None = None, leaf: int = LEAF, families: DataFrame | None = None,
    scratch: list[str] | None = None, roots: DataFrame | None = None,
) -> DataFrame:
    """(path, node): the leaves of all trees with two or more documents.

    ``sketches``: a table of node, sketch, one row for each distinct set;
    ``families``: (node, root) of documents that are linked already; ``roots``:
    the first trees' roots, if they are there. Without a number of ``trees``,
    the first ones are as many as a pair needs that is parted at roots only.
    Documents in nodes that branched on go to further trees, as many as their
    deepest branching asks for: a pair can be parted only as deep as both of
    its documents got.
    """
    first = trees or trees_for(threshold)
    roots = _sized(_roots(sketches, 0, F.lit(first)), scratch) if roots is None else roots
    found, depths = _grow(roots, sketches, threshold, leaf, families, scratch)
    if trees is None and threshold < 1 and depths is not None:
        wanted = F.element_at(F.array(*[F.lit(trees_for(threshold, d)) for d in range(DEPTH + 1)]), F.col("depth") + 1)
        deep = sketches.join(depths.select("node", wanted.alias("trees")), "node").select("node", "sketch", "trees")
        found = found.union(_grow(_sized(_roots(deep, first, F.col("trees")), scratch), sketches, threshold, leaf, families, scratch)[0])
    return found


def _roots(sketches: DataFrame, tree: int, trees: Column) -> DataFrame:
    """(node, path, tree): the root of each document in the trees from number ``tree`` to ``trees``. A root branches by two tokens at once."""
    rows = sketches.filter(trees > tree).withColumn("tree", F.explode(F.sequence(F.lit(tree), trees - 1))).withColumn("path", F.xxhash64(F.col("tree").cast("long")))
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
    return rows.select("node", F.xxhash64("path", F.element_at("sketch", first + 1), F.element_at("sketch", second + 1)).alias("path"), "tree")


def _sized(rows: DataFrame, scratch: list[str] | None) -> DataFrame:
    """The rows of nodes with two or more documents, and their number ``n``, counted with partial aggregates."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    return materialize(rows.join(sizes, "path"), "level", scratch)


def _grow(
    table: DataFrame, sketches: DataFrame, threshold: float, leaf: int, families: DataFrame | None, scratch: list[str] | None,
) -> tuple[DataFrame, DataFrame | None]:
    """The leaves under the given roots (path, node, n), and (node, depth) of the documents in nodes that branched on.

    Only documents in nodes over BLOCKED leaves go on. What is still too large
    after DEPTH levels is compared in blocks too.
    """
    found: list[DataFrame] = []
    branched: list[DataFrame] = []
    for level in range(1, DEPTH + 1):
        whole = BLOCKED * leaf if level < DEPTH else 1 << 62
        found.append(_blocks(table.filter(F.col("n") <= whole), leaf))
        large = table.filter(F.col("n") > whole)
        if large.isEmpty():
            break
        if families is not None:
            met = materialize(_met(large, families), "met", scratch)
            found.append(_finished(met, leaf))
            large = met.filter(F.col("others") > leaf // 2)
            if large.isEmpty():
                break
        on = large.select("path", "node")
        branched.append(on.select("node", F.lit(level).alias("depth")))
        table = _sized(_children(on.join(sketches.select("node", "sketch"), "node"), threshold).select("path", "node"), scratch)
    depths = reduce(DataFrame.union, branched).groupBy("node").agg(F.max("depth").alias("depth")) if branched else None
    return reduce(DataFrame.union, found), depths


def _blocks(rows: DataFrame, leaf: int, key: str = "path") -> DataFrame:
    """(``key``, node): leaves in which all documents of a node (``key``, node, n) meet, for any number of them.

    A node over ``leaf`` is dealt into parts of half a leaf, and every two parts
    meet in a leaf.
    """
    parts = F.when(F.col("n") <= leaf, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(max(1, leaf // 2)))).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("own")) | (F.col("parts") == 1))
    dealt = rows.withColumn("parts", parts).withColumn("own", own).withColumn("p", F.explode(others))
    met = F.xxhash64(key, F.least("own", "p"), F.greatest("own", "p"))
    return dealt.select(F.when(F.col("parts") == 1, F.col(key)).otherwise(met).alias(key), "node")


def _met(large: DataFrame, families: DataFrame) -> DataFrame:
    """(path, node, main, of, others): whether a document is of its node's largest family, and how many are and are not."""
    own = large.join(families.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = own.groupBy("path", "root").agg(F.count("*").alias("c")).groupBy("path").agg(F.max(F.struct("c", "root")).alias("most"))
    return own.join(most, "path").select("path", "node", (F.col("root") == F.col("most.root")).alias("main"), F.col("most.c").alias("of"), (F.col("n") - F.col("most.c")).alias("others"))


def _finished(met: DataFrame, leaf: int) -> DataFrame:
    """(path, node): the leaves of nodes with few others: the family in parts, each with all others."""
    few = met.filter((F.col("others") <= leaf // 2) & (F.col("others") > 0)).withColumn("parts", F.ceil(F.col("of") / F.lit(max(1, leaf // 2))).cast("int"))
    mine = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = few.withColumn("p", F.explode(F.when(F.col("main"), mine).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return dealt.select(F.xxhash64("path", F.col("p").cast("long")).alias("path"), "node")


def _shared_parts(large: DataFrame, leaf: int) -> DataFrame:
    """(path, node): large nodes (path, node, n) dealt into parts that all hold the node's first document."""
    whole = large.withColumn("parts", F.ceil(F.col("n") / F.lit(max(1, leaf // 2))).cast("int"))
    heads = whole.groupBy("path").agg(F.min("node").alias("node"), F.first("parts").alias("parts")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = whole.select("path", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("p")).union(heads.select("path", "node", "p"))
    return dealt.select(F.xxhash64("path", F.col("p").cast("long"), F.lit(7)).alias("path"), "node").distinct()


def _candidates(nodes: DataFrame, sketches: DataFrame, threshold: float, families: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect, within each leaf, the documents that look similar and are not of one family; a forest for each leaf."""
    agree = agreement_for(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, "path"):
            node = batch.column(1).to_numpy(zero_copy_only=False)
            size = batch.column(2).to_numpy(zero_copy_only=False)
            root = batch.column(4).to_numpy(zero_copy_only=False)
            sketch = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, TOKENS)
            found_a, found_b = [], []
            for a, b in _pairs(starts):
                fits = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
                a, b = a[fits], b[fits]
                same = np.zeros(len(a), np.int64)
                for t in range(0, TOKENS, 8):
                    same += (sketch[a, t : t + 8] == sketch[b, t : t + 8]).sum(1)
                found_a.append(a[same >= agree])
                found_b.append(b[same >= agree])
            if found_a:
                label = labels_of(len(node), np.concatenate(found_a), np.concatenate(found_b))
                b = np.flatnonzero(label != np.arange(len(node)))
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(node[label[b]]), pa.array(node[b])], ["a", "b"])

    rows = nodes.join(sketches.select("node", "n_shingles", "sketch"), "node")
    rows = rows.withColumn("root", F.col("node")) if families is None else rows.join(families, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.select("path", "node", "n_shingles", "sketch", "root")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "path").sortWithinPartitions("path", "node")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _pairs(starts: np.ndarray, limit: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group, in chunks of about ``limit`` pairs."""
    out_a, out_b, size = [], [], 0
    for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if y - x > 1:
            if y - x == 2:
                a, b = np.array([x]), np.array([x + 1])
            else:
                a, b = (i + x for i in np.triu_indices(y - x, 1))
            out_a.append(a)
            out_b.append(b)
            size += len(a)
            if size >= limit:
                yield np.concatenate(out_a), np.concatenate(out_b)
                out_a, out_b, size = [], [], 0
    if size:
        yield np.concatenate(out_a), np.concatenate(out_b)


def linked(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with den * intersection >= num * union, by exact intersection sizes."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = int(sizes.sum()) - len(np.unique(np.concatenate(sets)))
        ok = den * both >= num * (int(sizes.sum()) - both)
        return (np.array([0]), np.array([1])) if ok else (np.zeros(0, np.int64),) * 2
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    keep = count[at] > 1  # others are in no intersection
    owner, at = owner[keep], at[keep]
    number = np.cumsum(count > 1) - 1
    at = number[at]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((m, m))
    total, width = int(number[-1]) + 1 if len(number) else 0, 4096
    for low in range(0, total, width):
        x, y = np.searchsorted(at, (low, low + width))
        block = np.zeros((m, min(width, total - low)), np.float32)
        block[owner[x:y], at[x:y] - low] = 1
        both += block @ block.T
    both = np.rint(both).astype(np.int64)
    a, b = np.nonzero(np.triu(den * both >= num * (sizes[:, None] + sizes[None, :] - both), 1))
    return a, b


def _confirm(keys: DataFrame, docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, n_docs: int) -> DataFrame:
    """Edges (a, b) between linked sets of one key, a forest for each key. ``keys``: key, node, doc (a document of that node)."""
    asked = keys.select("key", "node", F.col("doc").alias("_doc"))
    if n_docs <= BROADCAST_ROWS:  # counted; a larger table is joined by a shuffle
        asked = F.broadcast(asked)
    texts = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("text")).join(asked, F.col("_id").eqNullSafe(F.col("_doc")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = Sets(part.column(2), width)
                own = sets.prints() == part.column(1).to_numpy(zero_copy_only=False)  # not another text under that id
                data = sets.hashes.tobytes()
                bounds = (8 * sets.bounds).tolist()
                blobs = pa.array([data[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), blobs], ["key", "node", "elements"])
                yield out.filter(pa.array(own))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, "key"):
            node = batch.column(1).to_numpy(zero_copy_only=False)
            out_a, out_b = [], []
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                _, first = np.unique(node[x:y], return_index=True)
                if len(first) < 2:
                    continue
                sets = [np.frombuffer(batch.column(2)[x + int(i)].as_py(), np.uint64) for i in first]
                label = labels_of(len(first), *linked(sets, num, den))
                b = np.flatnonzero(label != np.arange(len(first)))
                out_a.append(node[x + first[label[b]]])
                out_b.append(node[x + first[b]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = texts.select("key", "node", "text").mapInArrow(cut, "key bigint, node bigint, elements binary")
    return sets.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, num: int = 85, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text", trees: int | None = None, leaf: int = LEAF,
    scratch: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Documents are linked if den * |A & B| >= num * |A | B|, confirmed on full
    sets of 64-bit shingle hashes. A null or empty text has an empty set and is
    linked with nothing. Repeated rows are copies; rows that repeat an id with
    different texts are told apart by their sets. A null id is kept only if its
    document is alone. ``scratch`` collects the paths of the tables that the
    result is read from; all others are removed here.
    """
    threshold = num / den
    spark, kept, scratch = docs.sparkSession, scratch, []
    scanned = materialize(sketch_documents(docs, width, id_col, text_col), "sketches", kept)
    filled = scanned.filter("n_shingles > 0")
    first = [F.first(c).alias(c) for c in ("n_shingles", "sketch")]
    classes = materialize(filled.groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), *first), "classes", kept)
    named = classes.select("node", "doc")

    def confirmed(keys: DataFrame) -> DataFrame:
        asked = materialize(keys.join(named, "node").select("key", "node", "doc"), "keys", scratch)
        return materialize(_confirm(asked, docs, width, num, den, id_col, text_col, asked.count()), "links", scratch)

    def similar(nodes: DataFrame, families: DataFrame | None = None) -> DataFrame:
        """Links in leaves: of those that look similar, in blocks of each group, or leaf by leaf if there are too many of these."""
        groups = components(_candidates(nodes, classes, threshold, families), scratch)
        sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
        member = materialize(groups.join(sizes, "root"), "candidates", scratch)
        small = _blocks(member.filter(F.col("n") <= BLOCKED * leaf).withColumnRenamed("root", "key"), leaf, "key")
        large = member.filter(F.col("n") > BLOCKED * leaf).join(nodes, "node").select(F.xxhash64("path", "root").alias("key"), "node")
        return confirmed(small.union(large))

    roots = _sized(_roots(classes, 0, F.lit(trees or trees_for(threshold))), scratch)
    large = roots.filter((F.col("n") > BLOCKED * leaf) & (F.col("tree") < FIRST))
    families, links = None, None
    if not large.isEmpty():
        links = similar(materialize(_shared_parts(large, leaf), "shared", scratch))
        families = components(links, scratch)
    found = similar(leaves(classes, threshold, trees, leaf, families, scratch, roots), families)
    parts = materialize(components(found if links is None else links.union(found), scratch), "parts", kept)
    for path in scratch:
        remove(spark, path)
    named = classes.select("node", "doc", "copies").join(parts, "node", "left").withColumn("part", F.coalesce("root", "node"))
    lowest = named.filter("root is not null").groupBy("root").agg(F.min("doc").alias("low"))
    known = named.filter("copies > 1 or root is not null").join(lowest, "root", "left").select("node", F.coalesce("low", "doc").alias("component_id"))
    out = scanned.select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(known, "node", "left")
    out = out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with the columns of ``docs``.

    Rows that share an id are one document: all of them stay or go. Rows with a
    null id stay. The ids that go are counted; few enough are broadcast, so that
    texts are not shuffled, and more are joined by a shuffle.
    """
    scratch: list[str] = []
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, scratch=scratch, **options).filter(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    gone = materialize(gone, "gone")
    for path in scratch:
        remove(docs.sparkSession, path)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op3_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents at a similarity of 0.85 on word 5-grams."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
