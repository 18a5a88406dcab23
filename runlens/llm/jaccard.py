"""op8: exact n-gram Jaccard join in a metric space, and its components.

A document is its set of distinct word shingles (64-bit hashes). Documents with equal sets are one point. Jaccard
distance ``d = 1 - J`` is a metric; two points link when ``d <= r`` (``r = 0.25``).

1. Pivots and regions. Unrelated texts are all at distance 1 from each other, so whole documents are poor pivots for a whole corpus: no
   triangle window would exclude anything. The first pivots are therefore single shingles: a point is at distance ``1 - 1/n`` from
   each of its own and 1 from all others, and its own region is that of its first shingle in a global order (rare before
   frequent, then by hash). Linked points have more than a quarter of neither set outside the other, so they share one of the
   first ``n - ceil(0.75 n) + 1``; a point is replicated into just those regions.
2. Inside a region the pivot is its smallest point. Every point is measured against the pivot it meets in most of its regions, then, as
   far as still apart, against its other regions' pivots. Links found on the way join points to components, and points already
   joined are not compared again, so a large group of near copies costs one or a few comparisons a point.
3. Regions that still hold more than one component are joined recursively: a large one gets document pivots, its points go to the
   Voronoi region of their nearest pivot and, by the triangle inequality, to every other whose distance is at most ``2 r`` larger (the
   window), and those regions are split again while that leaves fewer pairs. Small ones, and those that no longer shrink, are
   compared in tiles: blocks of the points outside the largest component meet the region's points as they stream past, and
   only pairs that may link leave a task.

Replicas at rare shingles travel packed, by bucket of the shingle's hash; sketches travel as low bytes and a bit map of the high ones.

All decisions are exact: a pair is dropped on a bound that can only be too high, and else decided on the whole sets. The frequent shingles come from a sixteenth of the documents and are at most ``FREQUENT``;
they only change the order, never the result. Regions of frequent shingles are found with partial aggregates and joins that Spark
can split, all others by one sorted exchange.

Defined results: a text without words, or null, has an empty set and links with nothing; equal sets always link; a row without an id
links with nothing and has no component id; repeated rows are points of one component; an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import (U64, by_value, few, lower, mix64, scratch, shingle_hashes, slices, small_batches, stored, text_buffer,
                                words)

SIZE = 5                # words per shingle
NUM, DEN = 75, 100      # linked: DEN * intersection >= NUM * union
RADIUS = 1 - NUM / DEN
FREQUENT = 1 << 18
CLOSE = 0.5             # bound on the similarity from which a pair is measured on whole sets
SAMPLE = 16             # one document in so many is looked at for frequent shingles
SMALL = 64              # points of a region whose pairs are compared without further pivots
PIVOTS = 8
GROUP_ROWS = 512        # comparisons with one point that a task is given together
TILE = 512              # points of a tile's block
TILE_POINTS = 256       # points that pass a block together, if they
TILE_HITS = 1 << 18     # meet no more than so many equal values in it
PART_BYTES = 1 << 19
BUCKET_BITS = 13        # replicas at rare shingles are dealt by so many bits of the shingle's hash, and told apart by 32 more
PACK = 1 << 18          # replicas that a task packs together


def shingle_sets(part: pa.RecordBatch, size: int):
    """(row, sorted distinct shingle hashes) of the rows that have words."""
    buf, off = text_buffer(part.column("text"))
    w = words(lower(buf), off)
    row, h = shingle_hashes(w, part.num_rows, size)
    order = np.argsort(row, kind="stable")
    row, h = row[order], h[order]
    cut = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    for i, j in zip(cut[:-1], cut[1:]):
        yield int(row[i]), np.unique(h[i:j])


def point(u: np.ndarray) -> int:
    """Id of a set: equal sets, equal id."""
    with np.errstate(over="ignore"):
        s = mix64(u ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(u)) * U64(0x9E3779B97F4A7C15)
    return int(mix64(np.array([s], U64)).view(np.int64)[0])


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that repeat in the sample, sorted; their counts), at most ``FREQUENT``."""
    schema = pa.schema([("s", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for part in slices(batches, PART_BYTES):
            sets = [u for _, u in shingle_sets(part, size)]
            if sets:
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int32))], schema=schema)

    got = (docs.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(SAMPLE)) == 0).select("text")
           .mapInArrow(run, "s long, n int").groupBy("s").agg(F.sum("n").alias("n")).where("n > 1")
           .orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas())
    s = got.s.to_numpy(np.int64).view(U64)
    order = np.argsort(s)
    return s[order], got.n.to_numpy(np.int64)[order]


def pack_bits(u: np.ndarray) -> bytes:
    """The highest 16 bits of sorted hashes: a byte each for the lower eight, and a bit map in which the k-th one bit stands at k plus the
    upper eight."""
    v = (u >> U64(48)).astype(np.uint16)
    high = np.zeros(len(v) + 256, np.uint8)
    high[(v >> np.uint16(8)).astype(np.int64) + np.arange(len(v))] = 1
    return (v & np.uint16(255)).astype(np.uint8).tobytes() + np.packbits(high).tobytes()


def unpack_bits(data) -> np.ndarray:
    """The sorted 16-bit values of ``pack_bits``."""
    raw = np.frombuffer(data, np.uint8)
    n = (len(raw) - 32) * 8 // 9       # len(raw) = n + ceil((n + 256) / 8)
    high = np.flatnonzero(np.unpackbits(raw[n:])) - np.arange(n)
    return (high << 8).astype(np.uint16) | raw[:n]


POINTS = "kind int, doc_id long, th long, n long, s long, x long, size int, p long, p_size int"
_POINTS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()),
                     ("s", pa.int64()), ("x", pa.int64()), ("size", pa.int32()), ("p", pa.int64()), ("p_size", pa.int32())])
_PACKED = _POINTS.append(pa.field("data", pa.binary()))


def _rows(kind: int, m: int, /, schema=_POINTS, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)) if f.name == "kind" else
                                       pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(m, f.type)
                                       for f in schema], schema=schema)


def packed(s: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(buckets, data) of replicas (shingle, point, size): each bucket's points, next 32 bits of the shingles' hashes, and sizes by byte."""
    t = mix64(s)
    bucket = (t >> U64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, x, z = bucket[order], x[order].astype(np.int64), z[order].astype(np.int32)
    low = (t >> U64(32 - BUCKET_BITS)).astype(np.uint32)[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return bucket[cut[:-1]], [x[i:j].tobytes() + low[i:j].tobytes() + z[i:j].view(np.uint8).reshape(-1, 4).T.tobytes()
                              for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def unpacked(bucket: int, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The replicas (shingle, point, size) of one bucket; two shingles are one where all dealt bits agree, which only adds points to regions."""
    sizes = [len(d) // 16 for d in data]
    x = np.concatenate([np.frombuffer(d, np.int64, n) for d, n in zip(data, sizes)])
    low = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for d, n in zip(data, sizes)])
    z = np.concatenate([np.frombuffer(d, np.uint8, 4 * n, 12 * n).reshape(4, n).T for d, n in zip(data, sizes)])
    s = mix64((U64(bucket) << U64(32)) | low.astype(U64))
    return s.view(np.int64), x, np.ascontiguousarray(z).view(np.int32)[:, 0]


def points(docs: DataFrame, frequent, size: int) -> DataFrame:
    """kind 0: each document's point; 1 and 2: each point's replicas (once per task) at rare (``packed``, ``s`` is the bucket) and at
    frequent shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known, count = shared.value
        done, rare, held = set(), [], 0

        def flush():
            bucket, data = packed(*(np.concatenate(c) for c in zip(*rare)))
            return _rows(1, len(data), _PACKED, s=bucket, data=data)

        for part in slices(batches, PART_BYTES):
            ids = part.column("doc_id")
            x, n = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            out = []
            for row, u in shingle_sets(part, size):
                p = point(u)
                x[row], n[row] = p, len(u)
                if p in done or not ids[row].is_valid:
                    continue
                done.add(p)
                k = len(u) - -(-NUM * len(u) // DEN) + 1
                weight = np.zeros(len(u), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
                    weight = np.where(known[at] == u, count[at], 0)
                first = np.lexsort((u, weight))[:k] if weight.any() else np.arange(k)
                out.append((u[first], np.full(k, p), np.full(k, len(u), np.int32), weight[first] > 0))
            yield _rows(0, part.num_rows, _PACKED, doc_id=ids, th=part.column("th"), n=n, x=pa.array(x, mask=n == 0))
            if out:
                s, p, z, f = (np.concatenate(c) for c in zip(*out))
                if f.any():
                    yield _rows(2, int(f.sum()), _PACKED, s=s[f].view(np.int64), x=p[f], size=z[f])
                rare.append((s[~f], p[~f], z[~f]))
                held += len(rare[-1][0])
                if held >= PACK:
                    yield flush()
                    rare, held = [], 0
        if held:
            yield flush()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
            .mapInArrow(run, POINTS + ", data binary"))


def _by_size(s, x, z):
    """Regions of the rows (s, x, size): distinct points of a shingle whose sizes lie in one chain of possible links, with the smallest."""
    o = np.lexsort((x, z, s))
    s, x, z = s[o], x[o], z[o]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
    s, x, z = s[new], x[new], z[new]
    head = np.ones(len(s), bool)
    head[1:] = (s[1:] != s[:-1]) | (DEN * z[:-1].astype(np.int64) < NUM * z[1:].astype(np.int64))
    start = np.flatnonzero(head)
    n = np.diff(start, append=len(s))
    low = np.minimum.reduceat(x, start)
    own = np.repeat(low, n)
    pz = np.zeros(len(start), np.int32)
    region = np.repeat(np.arange(len(start)), n)
    pz[region[x == own]] = z[x == own]
    name = mix64(s.view(U64) * U64(31) + z[start].astype(U64)[region]).view(np.int64)
    many = np.repeat(n > 1, n)
    return [c[many] for c in (name, x, z, own, pz[region])]


def _shared_runs(batches):
    """Rows sorted by (kind, s): regions of rare shingles that at least two points have, bucket by bucket; other kinds pass."""
    at, held = None, []

    def emit():
        s, x, z, p, pz = _by_size(*unpacked(at, held))
        return _rows(1, len(s), s=s, x=x, size=z, p=p, p_size=pz)

    for b in batches:
        kind = np.asarray(b.column("kind"))
        other = kind != 1
        if other.any():
            yield b.filter(pa.array(other)).select(_POINTS.names)
        mine = b.filter(pa.array(~other))
        for bucket, data in zip(mine.column("s").to_pylist(), mine.column("data")):
            if bucket != at and held:
                yield emit()
                held = []
            at = bucket
            held.append(data.as_py())
    if held:
        yield emit()


def regions(replicas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents' points, regions): rare shingles by one sorted exchange, frequent ones by aggregates and joins that can be split."""
    key = F.when(F.col("kind") == 1, F.col("s")).otherwise(F.xxhash64("doc_id", "s", "x"))
    with scratch() as keep:
        return _regions(replicas, key, keep)


def _regions(replicas: DataFrame, key, keep) -> tuple[DataFrame, DataFrame]:
    found = stored(replicas.withColumn("key", key).repartition("key").sortWithinPartitions("kind", "s").drop("key")
                   .mapInArrow(_shared_runs, POINTS), "jaccard_points")
    rare = found.where("kind = 1").select("s", "x", "size", "p", "p_size")
    hot = found.where("kind = 2").groupBy("s", "x").agg(F.first("size").alias("size"))
    firsts = (hot.groupBy("s").agg(F.min(F.struct("x", "size")).alias("p"), F.max("x").alias("q")).where("p.x <> q")
              .select("s", F.col("p.x").alias("p"), F.col("p.size").alias("p_size")))
    hot = hot.join(firsts, "s").select("s", "x", "size", "p", "p_size")
    return (keep(stored(found.where("kind = 0").select("doc_id", "th", "n", "x"), "jaccard_own")),
            keep(stored(rare.unionByName(hot), "jaccard_regions")))


def may_link(a, b):
    """Sizes allow a link."""
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def sets_of(docs: DataFrame, owners: DataFrame, size: int, sketch: bool) -> DataFrame:
    """``x, data`` for the points in ``owners`` (x, doc_id): sorted hashes, or their highest 16 bits only (``pack_bits``)."""
    schema = pa.schema([("x", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for part in slices(batches, PART_BYTES):
            want = part.column("x")
            out = [(want[row].as_py(), pack_bits(u) if sketch else u.tobytes())
                   for row, u in shingle_sets(part, size) if point(u) == want[row].as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return stored(docs.select("doc_id", "text").join(few(owners), "doc_id").select("x", "text").mapInArrow(run, "x long, data binary"),
                  "jaccard_sets")


def common_hashes(own: np.ndarray):
    """Size of the intersection with ``own``, a sorted set of hashes."""
    def count(u: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(own, u), len(own) - 1)
        return int((own[at] == u).sum())
    return count


def common_bits(own: np.ndarray):
    """At least the size of the intersection: values both have, as often as both have them."""
    times = np.bincount(own, minlength=1 << 16)

    def count(u: np.ndarray) -> int:
        value, n = np.unique(u, return_counts=True)
        return int(np.minimum(times[value], n).sum())
    return count


def paired(pairs: DataFrame, sets: DataFrame, sketch: bool) -> DataFrame:
    """``a, b, common, total`` of the pairs: the (bound on the) size of the intersection, and the sum of both sizes.

    A point with many partners is dealt out in groups of about ``GROUP_ROWS``; its own set goes to each group.
    """
    groups = F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_ROWS)).cast("int")
    counts = stored(pairs.groupBy("a").agg(groups.alias("groups")), "jaccard_counts")
    tasks = stored(pairs.join(few(counts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g")),
                   "jaccard_tasks")
    right = sets.withColumnRenamed("x", "b").join(few(tasks), "b").select("a", "g", "b", "data")
    left = (sets.withColumnRenamed("x", "a").join(few(counts), "a")
            .select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"),
                    F.lit(None).cast("long").alias("b"), "data"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])
    common = common_bits if sketch else common_hashes

    def run(batches):
        count, n = None, 0
        for batch in batches:
            out = []
            a_col, b_col = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for a, b, data in zip(a_col, b_col, batch.column("data")):
                u = unpack_bits(data.as_buffer()) if sketch else np.frombuffer(data.as_buffer(), U64)
                if b is None:
                    count, n = common(u.copy()), len(u)
                else:
                    out.append((a, b, count(u), n + len(u)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return stored(left.unionByName(right).repartition("a", "g").sortWithinPartitions("a", "g", F.asc_nulls_first("b"))
                  .mapInArrow(run, "a long, b long, common long, total long"), "jaccard_pairs")


def components(edges: DataFrame) -> DataFrame:
    """``x, c``: smallest node of the component of every node of ``edges`` (u, v), by alternating large and small stars."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("x"), F.col("v").alias("c")).unionByName(
                e.select(F.col("v").alias("x"), F.col("v").alias("c")).distinct())
        before = now


def labelled(rows: DataFrame, comps: DataFrame | None, key: str, name: str) -> DataFrame:
    """``rows`` with the component of ``key`` as ``name`` (a point without links is its own)."""
    if comps is None:
        return rows.withColumn(name, F.col(key))
    c = few(comps.select(F.col("x").alias(key), F.col("c").alias(name)))
    return rows.join(c, key, "left").withColumn(name, F.coalesce(name, key))


class Join:
    """State of the recursive join: distances measured so far and the components of their links.

    A pair is first compared by 16 bits of each hash, which can only raise the intersection. If even so the similarity stays under
    ``CLOSE``, the distance's lower bound is kept (``exact`` false); all other pairs are measured on the whole sets.
    """

    def __init__(self, docs: DataFrame, owners: DataFrame, size: int):
        self.docs, self.owners, self.size = docs, owners, size
        self.sketches = sets_of(docs, owners, size, sketch=True)
        self.known, self.comps = None, None

    def measure(self, pairs: DataFrame) -> DataFrame:
        """``a, b, d, exact, linked`` of the pairs (a, b)."""
        rough = paired(pairs, self.sketches, sketch=True)
        near = F.col("common") >= CLOSE * (F.col("total") - F.col("common"))
        close = stored(rough.where(near).select("a", "b"), "jaccard_close")
        union = F.col("total") - F.col("common")
        d = (1 - F.col("common") / union).alias("d")
        far = rough.where(~near).select("a", "b", d, F.lit(False).alias("exact"), F.lit(False).alias("linked"))
        if close.isEmpty():
            return stored(far, "jaccard_distances")
        return stored(far.unionByName(self.whole(close)), "jaccard_distances")

    def whole(self, close: DataFrame) -> DataFrame:
        """``a, b, d, exact, linked`` of the pairs (a, b), on whole sets."""
        union = F.col("total") - F.col("common")
        ids = stored(close.select(F.col("a").alias("x")).unionByName(close.select(F.col("b").alias("x"))).distinct(), "jaccard_ids")
        owners = stored(self.owners.join(few(ids), "x", "left_semi"), "jaccard_owners")
        whole = paired(close, sets_of(self.docs, owners, self.size, sketch=False), sketch=False)
        return whole.select("a", "b", (1 - F.col("common") / union).alias("d"), F.lit(True).alias("exact"),
                            (DEN * F.col("common") >= NUM * union).alias("linked"))

    def compare(self, pairs: DataFrame) -> None:
        """Measure the distinct pairs (a, b) not measured yet and renew the components."""
        pairs = pairs.select("a", "b").distinct()
        if self.known is not None:
            pairs = pairs.join(self.known.select("a", "b"), ["a", "b"], "left_anti")
        with scratch() as keep:
            pairs = stored(pairs, "jaccard_pairs")
            if self.known is not None and pairs.isEmpty():
                return
            got = keep(self.measure(pairs))
        self.join(got)

    def join(self, got: DataFrame) -> None:
        """Take over new distances and renew the components."""
        self.known = got if self.known is None else self.known.unionByName(got)
        links = self.known.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        with scratch() as keep:
            self.comps = keep(stored(components(links), "jaccard_components"))

    def open_regions(self, rows: DataFrame) -> DataFrame:
        """The rows of regions that hold more than one component, with component ``c`` and the region's size ``n``.

        Of regions with the same points (near copies share most of their shingles) one is kept.
        """
        with scratch() as keep:
            rows = labelled(labelled(rows.select("s", "x", "size", "p"), self.comps, "x", "c"), self.comps, "p", "cp")
            still = stored(rows.where("c <> cp").select("s").distinct(), "jaccard_still")
            rows = stored(rows.join(few(still), "s", "left_semi").drop("cp"), "jaccard_open")
            mark = F.sum(F.xxhash64("x").cast("decimal(20,0)")).cast("string")
            each = rows.groupBy("s").agg(F.count("*").alias("n"), mark.alias("mark"), F.min("p").alias("p"))
            one = stored(each.groupBy("n", "mark", "p").agg(F.min("s").alias("s")).select("s", "n"), "jaccard_one")
            return keep(stored(rows.join(few(one), "s"), "jaccard_sized"))

    def meet(self, rows: DataFrame, turn: int) -> DataFrame:
        """Every point of the regions ``rows`` with each of up to ``PIVOTS`` pivots, and their distance; ``turn`` draws other pivots.

        A pivot is the point with the smallest hash of its slot, so regions that overlap draw the same ones.
        """
        drawn = F.xxhash64("x", F.lit(turn))
        pivots = (rows.groupBy("s", F.pmod(drawn, F.lit(PIVOTS)).alias("slot")).agg(F.min_by("x", F.struct(drawn, "x")).alias("q"))
                  .select("s", "q"))
        met = stored(rows.select("s", "x", "size", "c").join(stored(pivots, "jaccard_pivots"), "s"), "jaccard_met")
        at = labelled(met, self.comps, "q", "cq").where("c <> cq") if turn else met.where("x <> q")
        self.compare(at.select(F.least("x", "q").alias("a"), F.greatest("x", "q").alias("b")))
        return met

    def split(self, rows: DataFrame) -> DataFrame:
        """Voronoi regions of document pivots for every region in ``rows`` (s, x, size); boundary points are replicated."""
        met = self.meet(rows, 0)
        d = self.known.select("a", "b", "d", "exact")
        met = (met.withColumns({"a": F.least("x", "q"), "b": F.greatest("x", "q")}).join(d, ["a", "b"], "left")
               .withColumn("exact", (F.col("x") == F.col("q")) | F.col("exact"))
               .withColumn("d", F.when(F.col("x") == F.col("q"), 0.0).otherwise(F.col("d"))))
        own = met.groupBy("s", "x").agg(F.coalesce(F.min(F.when(F.col("exact"), F.col("d"))), F.lit(1.0)).alias("own"))
        return (met.join(own, ["s", "x"]).where(F.col("d") <= F.col("own") + 2 * RADIUS + 1e-12)
                .select(F.xxhash64("s", "q").alias("s"), "x", "size", F.col("q").alias("p")))

    def finish(self, rows: DataFrame) -> None:
        """Join the regions ``rows`` (s, x, size, p) exactly.

        Large regions first meet a few drawn pivots, turn by turn, while that still joins components. What stays apart is split into
        Voronoi regions, again and again while that makes the pairs inside regions fewer; then the regions are compared in tiles.
        """
        turn, last = 0, None
        while True:
            rows = self.open_regions(rows)
            sizes = rows.groupBy("s").agg(F.first("n").alias("n"), F.count_distinct("c").alias("k"))
            n = sizes.agg(F.count("*").alias("all"), F.sum(F.when(F.col("n") > SMALL, F.col("n") * F.col("n"))).alias("large"),
                          F.sum("k").alias("apart")).first()
            if not n["all"]:
                return
            if not n.large:
                break
            large, small = rows.where(F.col("n") > SMALL), rows.where(F.col("n") <= SMALL)
            if last is None or n.apart <= 0.7 * last:
                turn, last = turn + 1, n.apart
                self.meet(large, turn)
                continue
            parts = stored(self.split(large), "jaccard_regions")
            pairs = parts.groupBy("s").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
            if pairs is None or pairs > 0.7 * n.large:
                break
            rows, last = stored(small.select("s", "x", "size", "p").unionByName(parts), "jaccard_regions"), None
        self.tiles(rows)

    def tiles(self, rows: DataFrame) -> None:
        """Compare the points of different components in each region ``rows`` (s, x, p, c).

        Regions around the same pivot overlap and are compared as one, so a point passes once. Those outside the region's largest
        component are dealt, in the order of their ids (which are hashes), into blocks of about ``TILE``. The largest component's points
        stream past each block and a block's points past the blocks before, as 16-bit sketches; inside its block a point is sent once. Only pairs that may link by their sketches leave a task; they are measured on whole sets.
        """
        rows = stored(rows.select(F.col("p").alias("s"), "x", "c").distinct(), "jaccard_around")
        each = rows.groupBy("s", "c").agg(F.count("*").alias("m"))
        plan = (each.groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("main"), (F.sum("m") - F.max("m")).alias("side"))
                .select("s", "main", F.ceil(F.col("side") / TILE).cast("int").alias("blocks")))
        rows = stored(rows.select("s", "x", "c").join(few(stored(plan, "jaccard_plan")), "s"), "jaccard_tiled")
        own = F.least(F.floor((F.col("x") / F.lit(2.0 ** 64) + 0.5) * F.col("blocks")).cast("int"), F.col("blocks") - 1)
        last = F.when(F.col("c") == F.col("main"), F.col("blocks") - 1).otherwise(own)
        sent = (rows.withColumn("last", last).withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
                .withColumn("kind", F.when((F.col("c") != F.col("main")) & (F.col("block") == F.col("last")), 0).otherwise(1)))
        close = stored(sent.join(self.sketches, "x").select("s", "block", "kind", "x", "c", "main", "data")
                       .repartition("s", "block").sortWithinPartitions("s", "block", "kind")
                       .mapInArrow(lambda batches: near_pairs(tile_rows(batches)), "a long, b long").distinct(), "jaccard_close")
        if not close.isEmpty():
            with scratch() as keep:
                got = keep(stored(self.whole(close), "jaccard_distances"))
            self.join(got)


def tile_rows(batches):
    """Rows sorted by (s, block, kind) with ``pack_bits`` sketches, as ``near_pairs`` takes them: a block's points pass it too."""
    names = ["s", "block", "kind", "x", "c", "main"]
    at, block = None, []

    for b in batches:
        s, blk, kind = (np.asarray(b.column(k)) for k in names[:3])
        data = pa.array([unpack_bits(d.as_buffer()).tobytes() for d in b.column("data")], pa.binary())
        rows = pa.RecordBatch.from_arrays([*(b.column(k) for k in names), data], names=[*names, "data"])
        again = rows.set_column(2, "kind", pa.array(np.ones(len(s), np.int32)))
        cut = np.flatnonzero((np.diff(s, prepend=~s[:1]) != 0) | (np.diff(blk, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
        out = []
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(s)).tolist()):
            if block and ((s[i], blk[i]) != at or kind[i] == 1):
                out += block
                block = []
            at = (s[i], blk[i])
            out.append(rows.slice(i, j - i))
            if kind[i] == 0:
                block.append(again.slice(i, j - i))
        yield from pa.Table.from_batches(out, rows.schema).combine_chunks().to_batches()
    yield from block


def near_pairs(batches):
    """Rows sorted by (s, block, kind): pairs (a, b) of a block's points (kind 0) and the points that pass (kind 1), of different
    components, whose sketches allow a link. Equal 16-bit values of a set count as often as they meet, which can only raise the bound."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    at, block, index = None, [], None

    def indexed():
        x, c, n, v = (np.concatenate(col) for col in zip(*block))
        order = np.argsort(v, kind="stable")
        return v[order], np.repeat(np.arange(len(n)), n)[order], x, c, n

    def compared(x, c, main, n, v):
        lo = np.searchsorted(index[0], v)
        m = np.searchsorted(index[0], v, "right") - lo
        ends = np.concatenate([[0], np.cumsum(n)])
        hits = np.concatenate([[0], np.cumsum(m)])[ends]
        k = 0
        while k < len(x):
            e = max(k + 1, int(np.searchsorted(hits, hits[k] + TILE_HITS, "right")) - 1)
            yield compare(x[k:e], c[k:e], main, n[k:e], lo[ends[k]:ends[e]], m[ends[k]:ends[e]])
            k = e

    def compare(x, c, main, n, lo, m):
        _, row, bx, bc, bn = index
        hit = row[np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())]
        own = np.repeat(np.repeat(np.arange(len(x)) * len(bx), n), m)
        both = np.bincount(own + hit, minlength=len(x) * len(bx)).reshape(len(x), len(bx))
        both = np.minimum(both, np.minimum(n[:, None], bn[None, :]))
        ok = (DEN * both >= NUM * (n[:, None] + bn[None, :] - both)) & (c[:, None] != bc[None, :])
        ok &= (c == main)[:, None] | (x[:, None] > bx[None, :])
        i, j = np.nonzero(ok)
        return np.minimum(x[i], bx[j]), np.maximum(x[i], bx[j])

    for batch in batches:
        s, blk, kind, x, c, main = (np.asarray(batch.column(k)) for k in ("s", "block", "kind", "x", "c", "main"))
        raw, off = text_buffer(batch.column("data"))
        values, off = raw.view(np.uint16), off // 2
        n = np.diff(off)
        cut = np.flatnonzero((np.diff(s, prepend=~s[:1]) != 0) | (np.diff(blk, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
        out = []
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(s)).tolist()):
            if (s[i], blk[i]) != at:
                at, block, index = (s[i], blk[i]), [], None
            if kind[i] == 0:
                block.append((x[i:j].copy(), c[i:j].copy(), n[i:j], values[off[i]:off[j]].copy()))
                continue
            if not block:
                continue
            index = index or indexed()
            for k in range(i, j, TILE_POINTS):
                e = min(k + TILE_POINTS, j)
                out += compared(x[k:e], c[k:e], main[i], n[k:e], values[off[k]:off[e]])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*out)], schema=schema)


def classes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, th, n, c`` of every row: its text's hash, set size, and the name of its component (null: links with nothing)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch() as keep, small_batches(docs.sparkSession):
        own, rows = regions(points(docs, frequent_shingles(docs, size), size))
        met = stored(rows.where((F.col("x") != F.col("p")) & may_link(F.col("size"), F.col("p_size")))
                     .groupBy("x", "p").agg(F.count("*").alias("k")), "jaccard_met")
        reps = own.where("x is not null and doc_id is not null").groupBy("x").agg(F.min("doc_id").alias("doc_id"))
        state = Join(docs, stored(reps.join(rows.select("x").distinct(), "x", "left_semi"), "jaccard_reps"), size)
        state.compare(met.groupBy("x").agg(F.max_by("p", F.struct("k", "p")).alias("p"))
                      .select(F.col("p").alias("a"), F.col("x").alias("b")))
        open_ = labelled(labelled(met, state.comps, "x", "cx"), state.comps, "p", "cp").where("cx <> cp")
        state.compare(open_.select(F.col("p").alias("a"), F.col("x").alias("b")))
        state.finish(rows.select("s", "x", "size", "p"))
        return keep(stored(labelled(own, state.comps, "x", "c").select(
            "doc_id", "th", "n", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("c")), "jaccard_classes"))


def join(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = classes(docs, size)
    first = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "c", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of every component: smallest id, then text hash. Rows without an id or without words link with nothing and stay."""
    with scratch() as keep:
        rows = classes(docs, size)
        first = rows.where("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.*")
        copies = rows.where("c is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n"))
        keys = keep(stored(first.join(copies, ["doc_id", "th"]).withColumnsRenamed({"doc_id": "j_id", "th": "j_th"}), "jaccard_kept"))
    marked = docs.withColumn("j_hash", F.xxhash64("text"))
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))

    def of(chosen: DataFrame) -> DataFrame:
        chosen = few(chosen.select("j_id", "j_th"))
        return marked.where(linked).join(chosen, (F.col("doc_id").cast("long") == F.col("j_id"))
                                         & (F.col("j_hash") == F.col("j_th")), "left_semi")

    kept = of(keys.where("n = 1")).unionByName(of(keys.where("n > 1")).dropDuplicates(["doc_id", "j_hash"]))
    return kept.unionByName(marked.where(~linked)).select(*[F.col(f"`{c}`") for c in docs.columns])


JOIN_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \\t-\\r]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

by_value(common, sys.modules[__name__])
