"""Nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by several projections onto Gaussian directions,
shifted and cut into slots of equal width. A near neighbour's slots are the
query's own or next to them, so a query also visits the buckets with some slots
moved by one, in the order of their estimated success: the sum of the squared
distances from the query's projections to the borders they cross. Candidates of
all tables are merged and ranked by exact distances.

Equal vectors are one indexed entry with their smallest ids, so a vector with
any number of copies costs one row; crowded buckets are dealt over several
tasks; queries left with fewer neighbours than asked for, or with neighbours farther
away than the slots suit, are answered by an exact scan in blocks; so are all
queries if no index reaches the recall asked for on the sample. Where the data
have no near neighbours, as vectors spread evenly over a sphere, the buckets
that reach the recall hold a large share of all vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import whole_groups
from .shared import materialize, read_table
from .textscan import mix64

TABLES, K = 10, 10
#: Vectors that the index is fitted on, those of them that act as queries, and the recall to reach there.
SAMPLE, SAMPLE_QUERIES, TARGET = 4000, 100, 0.95
#: Numbers of projections to choose from, slots in median neighbour distances, a probe's cost in distances computed, and buckets of a table that a query visits at least.
PROJECTIONS, WIDTH, PROBE_COST, LEAST_PROBES = (2, 3, 4, 5, 6, 8, 10, 12), 2.0, 16, 4
#: Entries of a bucket that one task takes, and probes of a table at most (all queries are scanned exactly if more were needed).
CROWDED, MOST_PROBES = 2000, 512
#: Crowded buckets up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Queries and entries that meet in one task of an exact scan.
SCAN_QUERIES, SCAN_ENTRIES = 4096, 50_000
#: Shares that the queries with one vector are dealt into, for theirs may be a third of all rows.
SHARES = 16
#: Results that a task gathers before it merges them.
HELD = 100_000


@dataclass
class Index:
    """Directions, shifts and slot width of all tables, and the number of buckets to probe in each."""

    directions: np.ndarray  # tables, projections, dimensions
    shifts: np.ndarray  # tables, projections, in slots
    width: float
    probes: int
    moves: list[tuple[int, ...]]
    limit: float = np.inf  # queries whose last neighbour found is farther away are answered by an exact scan
    met: float = 1.0  # the share of the sample that a query meets

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.directions[table].T / self.width + self.shifts[table]

    def key(self, slots: np.ndarray, table: int) -> np.ndarray:
        acc = np.full(slots.shape[:-1], np.uint64(table + 1), np.uint64)
        for k in range(slots.shape[-1]):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + slots[..., k].astype(np.int64).view(np.uint64))
        return acc.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return np.stack([self.key(np.floor(self.slots(x, t)), t) for t in range(len(self.directions))], 1)

    def probed(self, x: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """The buckets that each query visits in a table, likeliest first."""
        probes = self.probes if probes is None else probes
        slots = self.slots(x, table)
        own = np.floor(slots)
        n, m = own.shape
        below = slots - own
        gaps = np.concatenate((below, 1 - below), 1)  # to the border below, then to the one above
        ranked = np.argsort(gaps, 1, kind="stable")
        gap2 = np.take_along_axis(gaps, ranked, 1) ** 2
        cost = np.full((n, len(self.moves)), np.inf)
        shift = np.zeros((n, len(self.moves), m))
        at = np.arange(n)
        for k, move in enumerate(self.moves):
            score, step = np.zeros(n), np.zeros((n, m))
            valid = np.ones(n, bool)
            for j in move:
                side = ranked[:, j]
                valid &= step[at, side % m] == 0
                step[at, side % m] = np.where(side < m, -1, 1)
                score += gap2[:, j]
            cost[:, k], shift[:, k] = np.where(valid, score, np.inf), step
        first = np.argsort(cost, 1, kind="stable")[:, :probes]
        return self.key(own[:, None, :] + np.take_along_axis(shift, first[:, :, None], 1), table)


def likely_moves(projections: int, count: int) -> list[tuple[int, ...]]:
    """Sets of border ranks to cross, the likeliest first, by the expected squared distances of ranked borders."""
    m = projections
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(out) < count:
        score, move = heapq.heappop(heap)
        if not any(2 * m - 1 - j in move for j in move):  # one slot does not move both ways
            out.append(move)
        last = move[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*move[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*move, last + 1)))
    return out


def fit(sample: np.ndarray, n: int, k: int = K, tables: int = TABLES, target: float = TARGET, seed: int = 11, near: list[np.ndarray] | None = None) -> Index:
    """An index for ``n`` vectors: projections and probes that reach the recall asked for at the least cost, as measured on the sample.

    ``near``: the true neighbours of the first vectors of the sample; without
    them their neighbours within the sample stand in, which are farther away.
    The width suits distances about the median: queries at twice that get an
    exact scan, and all do if no index reaches the target.
    """
    rng = np.random.default_rng(seed)
    if near is None:
        near = []
        for at in range(min(SAMPLE_QUERIES, len(sample))):
            d2 = ((sample - sample[at]) ** 2).sum(1)
            d2[at] = np.inf
            near.append(sample[np.argsort(d2, kind="stable")[: min(k, len(sample) - 1)]])
    asked, sizes = sample[: len(near)], np.array([len(x) for x in near])
    owner, flat = np.repeat(np.arange(len(near)), sizes), np.concatenate([*near, np.zeros((0, sample.shape[1]))])
    reach = float(np.median(np.sqrt(((flat - asked[owner]) ** 2).sum(1)))) if len(flat) else 1.0
    width = WIDTH * reach if np.isfinite(reach) and reach > 0 else 1.0
    best, least = None, np.inf
    for projections in PROJECTIONS:
        moves = likely_moves(projections, 2 * MOST_PROBES)
        index = Index(rng.normal(size=(tables, projections, sample.shape[1])), rng.uniform(size=(tables, projections)), width, 1, moves, 2 * reach if reach > 0 else np.inf)
        if not len(flat):
            return index
        own, keys = index.buckets(flat), [index.probed(asked, t, MOST_PROBES) for t in range(tables)]
        found = np.full(len(flat), MOST_PROBES)  # the probe that first meets each neighbour
        for t in range(tables):
            hit = keys[t][owner] == own[:, t, None]
            found = np.minimum(found, np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
        index.probes = max(LEAST_PROBES, int(np.sort(found)[int(np.ceil(target * len(found))) - 1]) + 1)
        if index.probes > MOST_PROBES:
            break  # more projections part neighbours more
        buckets, met = index.buckets(sample), np.zeros((len(asked), len(sample)), bool)
        for t in range(tables):
            for q in range(len(asked)):
                met[q] |= np.isin(buckets[:, t], keys[t][q, : index.probes])
        index.met = float(met.mean())
        cost = tables * index.probes * PROBE_COST + index.met * n
        if cost < least:
            best, least = index, cost
    if best is None:
        index.probes, index.limit = 1, -1.0
        return index
    return best


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors stored as bytes."""
    if not len(column):
        return np.zeros((0, 0))
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(len(column), -1).astype(np.float64)


def _stored_kind(df: DataFrame, vector_col: str) -> str:
    """The type of stored components: floats stay floats, all others are doubles."""
    return "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def _packed(value: list | None, kind: str) -> bytes | None:
    """The bytes of a vector, None if it takes no part."""
    if not value or any(v is None for v in value):
        return None
    vector = np.array(value, kind) + np.array(0, kind)  # no negative zero
    return vector.tobytes() if np.isfinite(vector).all() and vector.any() else None


def _entries(df: DataFrame, id_col: str, vector_col: str, keep: int, kind: str) -> DataFrame:
    """Distinct vectors (as bytes) with their ``keep`` smallest ids and ``rep``, the smallest. Vectors that take no part are left out.

    A task merges the ids of its batch; what is left meets in two steps, so no
    task sees more than a share of a vector's copies.
    """
    id_kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list] = {}
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is not None and (data := _packed(value, kind)) is not None:
                    ids.setdefault(data, []).append(key)
            rows = [sorted(set(v))[:keep] for v in ids.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(rows, pa.list_(batch.schema.types[0]))], ["vector", "ids"])

    plain = "array<float>" if kind == "<f4" else "array<double>"
    partial = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(plain).alias("v")).mapInArrow(pack, f"vector binary, ids array<{id_kind}>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    shared = partial.groupBy("vector", F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share")).agg(smallest)
    return shared.groupBy("vector").agg(smallest).withColumn("rep", F.col("ids")[0])


def neighbours(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """query_id, rank, ``id_col`` and score: the k nearest found of each query, itself left out.

    ``queries``: rows with the same columns, taken from ``df``. Ties go to
    smaller ids. Vectors that are null, zero, or hold null or non-finite
    components, and rows with a null id take no part, as entries or queries;
    vectors of several dimensions are neighbours among their own. Repeated rows
    count once. An empty table, or one of such vectors only, gives no rows.
    Each dimension is a search of its own, of a dozen jobs: meant for tables with few.
    Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    id_kind, kind = df.schema[id_col].dataType.simpleString(), _stored_kind(df, vector_col)
    entries = materialize(_entries(df, id_col, vector_col, k + 1, kind), "vectors")
    asked = _asked(queries, entries, id_col, vector_col, id_kind, kind)
    own = asked.select("q").distinct()
    asked_vectors = materialize(entries.join(own, F.col("rep") == F.col("q"), "left_semi").select("rep", "vector"), "asked")
    parts = []
    for row in entries.groupBy(F.octet_length("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each dimension
        size = F.octet_length("vector") == row["size"]
        parts.append(_search(entries.filter(size), asked_vectors.filter(size), row["n"], k, tables, target, id_kind, kind))
    schema = f"query_id {id_kind}, rank int, {id_col} {id_kind}, score double"
    if not parts:
        return spark.createDataFrame([], schema)
    best = reduce(DataFrame.union, parts)
    # A query's list is one short row, repeated for each share of the query rows that have its vector.
    order = Window.partitionBy("q").orderBy("score", "id")
    single = best.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    first = single.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    listed = first.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    rows = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(SHARES)).cast("int")).join(listed, ["q", "share"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def _asked(queries: DataFrame, entries: DataFrame, id_col: str, vector_col: str, id_kind: str, kind: str) -> DataFrame:
    """(query_id, q): each query and the entry that stands for its vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([_packed(v, kind) for v in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["query_id", "vector"]).filter(data.is_valid())

    plain = "array<float>" if kind == "<f4" else "array<double>"
    rows = queries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).cast(plain).alias("v"))
    packed = rows.mapInArrow(pack, f"query_id {id_kind}, vector binary")
    return materialize(packed.join(entries.select("vector", F.col("rep").alias("q")), "vector").select("query_id", "q").distinct(), "queries")


def _search(entries: DataFrame, asked: DataFrame, n: int, k: int, tables: int, target: float, id_kind: str, kind: str) -> DataFrame:
    """(q, rep, score): the k + 1 nearest entries of each query vector (rep, vector), all of one dimension; the entry itself is one of them."""
    spark = entries.sparkSession
    rows = entries.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("rep", "vector").collect()
    sample = _matrix(pa.array([bytes(r["vector"]) for r in rows], pa.binary()), kind)
    index = fit(sample, n, k, tables, target, near=_true_neighbours(entries, rows[:SAMPLE_QUERIES], k, id_kind, kind))
    if index.limit < 0:
        return materialize(_scanned(entries, asked, n, k + 1, id_kind, kind), "found")
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = shared.value.buckets(_matrix(part.column(1), kind))
                row = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(row), part.column(1).take(row)], ["key", "id", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = _matrix(part.column(1), kind)
                for t in range(tables):
                    keys = shared.value.probed(x, t)
                    row = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(row), part.column(1).take(row)], ["key", "id", "vector"])

    stored = entries.select("rep", "vector").mapInArrow(deal, f"key bigint, id {id_kind}, vector binary")
    probes = asked.mapInArrow(probe, f"key bigint, id {id_kind}, vector binary")
    crowds = stored.groupBy("key").count().filter(F.col("count") > CROWDED).select("key", F.ceil(F.col("count") / CROWDED).cast("int").alias("parts"))
    crowds = materialize(crowds, "crowds")
    if crowds.count() <= BROADCAST_ROWS:  # so that a crowded bucket's rows are dealt where they are made
        crowds = F.broadcast(crowds)
    stored = stored.join(crowds, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    probes = probes.join(crowds, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    pairs = _met(stored.withColumn("key", F.xxhash64("key", "part")), probes.withColumn("key", F.xxhash64("key", "part")), k + 1, id_kind, kind)
    best = materialize(_nearest(pairs, k + 1), "found")
    full = entries.select("rep", F.size("ids").alias("copies"))
    total = entries.agg(F.sum(F.size("ids"))).first()[0]
    got = best.join(full, "rep").groupBy("q").agg(F.sum("copies").alias("n"), F.max("score").alias("last"))
    short = asked.join(got, asked["rep"] == got["q"], "left").filter((F.coalesce("n", F.lit(0)) < min(total, k + 1)) | (F.col("last") > index.limit))
    short = materialize(short.select("rep", "vector"), "short")
    if short.isEmpty():
        return best
    scanned = _scanned(entries, short, n, k + 1, id_kind, kind)
    return materialize(_nearest(best.union(scanned), k + 1), "found")


def _true_neighbours(entries: DataFrame, rows: list, k: int, id_kind: str, kind: str) -> list[np.ndarray]:
    """The k nearest vectors of each of some entries, SAMPLE_QUERIES at most: one scan with these broadcast."""
    packed = pa.array([bytes(r["vector"]) for r in rows], pa.binary())
    shared = entries.sparkSession.sparkContext.broadcast((pa.array(range(len(rows)), pa.int32()), _matrix(packed, kind)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = shared.value
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append(_best(numbers, q, part.column(0), _matrix(part.column(1), kind), k + 1))
            if held:
                held = [_merged(held, k + 1)]
        yield from held

    near = _nearest(entries.select("rep", "vector").mapInArrow(scan, f"q int, rep {id_kind}, score double"), k + 1)
    found = entries.select("rep", "vector").join(F.broadcast(near), "rep").filter("score > 0").select("q", "vector").collect()
    lists: list[list[bytes]] = [[] for _ in rows]
    for r in found:
        lists[r["q"]].append(bytes(r["vector"]))
    size = len(packed[0].as_py()) // np.dtype(kind).itemsize
    return [_matrix(pa.array(x, pa.binary()), kind).reshape(len(x), size) for x in lists]


def _scanned(entries: DataFrame, asked: DataFrame, n: int, k: int, id_kind: str, kind: str) -> DataFrame:
    """(q, rep, score): exact neighbours. Queries and entries are dealt into blocks, and every block of queries meets every block of entries in a group of its own."""
    blocks = max(1, -(-asked.count() // SCAN_QUERIES)), max(1, -(-n // SCAN_ENTRIES))
    dealt = []
    for rows, own, others, first in ((entries, blocks[1], blocks[0], False), (asked, blocks[0], blocks[1], True)):
        block = F.pmod(F.xxhash64("rep"), F.lit(own)).cast("int")
        met = rows.select(F.col("rep").alias("id"), "vector", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))
        pair = ("own", "other") if first else ("other", "own")
        dealt.append(met.select(F.xxhash64(*pair).alias("key"), "id", "vector"))
    return _nearest(_met(dealt[0], dealt[1], k, id_kind, kind), k)


def _met(stored: DataFrame, asked: DataFrame, k: int, id_kind: str, kind: str) -> DataFrame:
    """(q, rep, score): the k nearest stored vectors of each query within each key, merged in each task. Both tables: key, id, vector."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # each query's nearest in the groups so far
        added = 0
        for batch, starts in whole_groups(batches, "key"):
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                cut = x + int(np.searchsorted(asks[x:y], 1))
                if x < cut < y:
                    q, own = batch.slice(cut, y - cut), batch.slice(x, cut - x)
                    vectors = _matrix(own.column(3), kind)
                    for at in range(0, q.num_rows, 256):
                        held.append(_best(q.slice(at, 256).column(2), _matrix(q.slice(at, 256).column(3), kind), own.column(2), vectors, k))
                        added += held[-1].num_rows
                    if added > max(HELD, held[0].num_rows):
                        held, added = [_merged(held, k)], 0
        if held:
            yield _merged(held, k)

    both = stored.select("key", F.lit(0).alias("asks"), "id", "vector").union(asked.select("key", F.lit(1).alias("asks"), "id", "vector"))
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "key").sortWithinPartitions("key", "asks", "id")
    return dealt.mapInArrow(rank, f"q {id_kind}, rep {id_kind}, score double")


def _best(q_ids: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of ``x`` for each query, with exact distances; entries as near as the last of them are kept too.

    A matrix product selects them. Vectors are moved to their middle before, and
    the selection allows for what the product and the move may lose: entries
    that could be among the nearest are all compared exactly.
    """
    d2 = None
    if len(x) > k and np.abs(q).max(initial=0) + np.abs(x).max(initial=0) < 1e100:  # squares of larger ones overflow
        middle = x.mean(0)
        qm, xm = q - middle, x - middle
        norms = (qm**2).sum(1)[:, None] + (xm**2).sum(1)[None]
        d2 = norms - 2 * qm @ xm.T
        eps = np.finfo(float).eps
        far = np.abs(q).max(initial=0) + np.abs(x).max(initial=0)  # a component moves with this error at most, in eps
        slack = 8 * eps * (x.shape[1] * norms + far * np.sqrt(x.shape[1] * norms))
        edge = np.partition(d2 + slack, k - 1, 1)[:, k - 1]
        a, b = np.nonzero(d2 - slack <= edge[:, None])
    if d2 is None:
        a, b = (i.ravel() for i in np.indices((len(q), len(x))))
    with np.errstate(over="ignore"):
        score = np.concatenate([np.sqrt(((q[a[i : i + 8192]] - x[b[i : i + 8192]]) ** 2).sum(1)) for i in range(0, len(a), 8192)]) if len(a) else np.zeros(0)
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], ["q", "rep", "score"])


def _merged(found: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The k nearest distinct entries of each query among several results."""
    rows = pa.Table.from_batches(found).to_pandas().drop_duplicates(["q", "rep"]).sort_values(["q", "score", "rep"]).groupby("q", sort=False).head(k)
    return pa.RecordBatch.from_pandas(rows, schema=found[0].schema, preserve_index=False)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct entries of each query."""
    order = Window.partitionBy("q").orderBy("score", "rep")
    one = pairs.groupBy("q", "rep").agg(F.min("score").alias("score"))
    return one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("q", "rep", "score")


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours, by Euclidean distance, of every vector whose id is divisible by 100."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(rows, rows.filter(F.col("vec_id") % 100 == 0))
