"""MinHash near-dedup by HyperMinHash: compressed registers are banded, the estimate
of the Jaccard similarity is corrected for collisions, and full sets confirm links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, chunks, components, drop_stash, likely_among, mix, small_broadcasts, stash, table, text_shingles, texts

#: Registers of a sketch and the bands they are cut into: at a similarity of 0.85
#: a pair shares no band once in 10^7 times, at 0.8 once in 10^5.
BANDS, ROWS = 24, 4
BUCKETS = BANDS * ROWS
#: Bits after the leading one that a register keeps.
MANTISSA = 10
#: A pair is verified if its estimate is at most this far below the threshold: four
#: standard deviations of an estimate from 96 registers.
MARGIN = 0.16
#: Groups of at most so many documents are compared pair by pair; larger ones with one
#: lead each, and what its comparison leaves open is dealt into smaller groups.
SMALL = 16


def register(x: np.ndarray) -> np.ndarray:
    """16 bits for a 32-bit minimum: its leading zeros and the bits that follow the one."""
    _, exponent = np.frexp(x.astype(np.float64))  # x = m * 2^e with 0.5 <= m < 1; 0 for 0
    zeros = 32 - exponent
    shift = exponent - 1 - MANTISSA
    body = np.where(shift >= 0, x >> np.maximum(shift, 0).astype(np.uint64), x << np.maximum(-shift, 0).astype(np.uint64))
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (body.astype(np.uint64) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


_MULTIPLIERS = np.random.default_rng(9).integers(0, 1 << 62, BUCKETS).astype(np.uint64) * np.uint64(4) + np.uint64(1)
#: Hashes that are multiplied at once.
_PIECE = 4096


def sketch(distinct: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes.

    Every bucket has a hash function of its own and keeps its minimum over the whole
    set. Were the set dealt out over the buckets, most would be empty for a short
    text, and a band's registers would all come from one or two shingles: a common
    line would then fill a bucket with hundreds of unlike documents.
    """
    low = np.full(BUCKETS, np.iinfo(np.uint64).max)
    for i in range(0, len(distinct), _PIECE):
        np.minimum(low, np.multiply.outer(_MULTIPLIERS, distinct[i : i + _PIECE]).min(1), out=low)
    return register(low >> np.uint64(32))


@lru_cache(maxsize=10_000)
def _collisions(n: int, m: int) -> float:
    p, q = (np.diff(1 - (1 - _EDGES) ** max(1.0, 2 ** (x / 8))) for x in (n, m))
    return float(p @ q)


def collisions(n: int, m: int) -> float:
    """The part of the registers of two disjoint sets of n and m hashes that agree by
    chance: over the values a register can have, the product of their likelihoods.
    Worked out for sizes at steps of an eighth of an octave."""
    return _collisions(round(8 * np.log2(n)), round(8 * np.log2(m)))


def _edges() -> np.ndarray:
    """Ends of the ranges of values, as parts of 2^32, that share a register."""
    out = [np.zeros(1)]
    for zeros in range(32, -1, -1):
        top = 2.0 ** -zeros
        out.append(np.linspace(top / 2, top, (1 << MANTISSA) + 1)[:-1] if zeros < 32 else np.array([top]))
    return np.unique(np.append(np.concatenate(out), 1.0))


_EDGES = _edges()


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity of two sets from their sketches and sizes, less what agrees by chance."""
    by_chance = collisions(n, m)
    return max(0.0, (float((a == b).mean()) - by_chance) / (1 - by_chance))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    yield from map(np.unique, text_shingles(texts(batch), width))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, same, registers = [], [], []
            for s in _sets(batch, width):
                n.append(len(s))
                same.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.int64()), pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "same", "registers"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of every document's bands."""
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        r = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(-1, BANDS)
        keys = pa.array(mix(r ^ salt).ravel().view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), keys)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_shingles"), lists], names=["doc_id", "n_shingles", "bands"])


def _likely(threshold: float):
    """Pairs (a, b, their sizes and registers) whose sizes and estimate allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ra = np.frombuffer(b"".join(batch.column("ra").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            rb = np.frombuffer(b"".join(batch.column("rb").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            agree = (ra == rb).mean(1)
            keep = np.minimum(n, m) >= threshold * np.maximum(n, m)
            # What agrees by chance only lowers an estimate, so it is worked out where the rest passes.
            for i in np.flatnonzero(keep & (agree >= threshold - MARGIN)):
                keep[i] = estimate(ra[i], rb[i], int(n[i]), int(m[i])) >= threshold - MARGIN
            keep &= agree >= threshold - MARGIN
            rows = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(rows)), batch.column("b").take(pa.array(rows))], names=["a", "b"])

    return run


def _full(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in _sets(batch, width)], pa.binary())], names=["doc_id", "found"])

    return run


def _both(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(batch.column("sa"), batch.column("sb")):
        yield np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(_both(batch)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def _relation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document (set sa) how many shingles its lead (set sb) has, and the others."""
    for batch in batches:
        n, n_lead, held, rest = [], [], [], []
        for x, y in _both(batch):
            n.append(len(x))
            n_lead.append(len(y))
            other = np.setdiff1d(x, y, assume_unique=True)
            held.append(len(x) - len(other))
            rest.append(other.view(np.int64))
        counts = [pa.array(x, pa.int64()) for x in (n, n_lead, held)]
        columns = [batch.column("key"), batch.column("doc_id"), batch.column("lead"), *counts, pa.array(rest, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "lead", "n", "n_lead", "held", "rest"])


class _Links:
    """The links found so far and the components that they make."""

    def __init__(self, firsts: DataFrame, sets: DataFrame, copies: DataFrame, percent: int):
        self.firsts, self.sets, self.percent = firsts, sets, percent
        self.kind = firsts.schema["doc_id"].dataType.simpleString()
        self.group = stash(components(copies), "groups")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, ...) with c, the component of doc_id."""
        return rows.join(self.group.selectExpr("id AS doc_id", "component AS c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links: sizes and sketches allow it, the full sets confirm it."""
        one = lambda c: self.firsts.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
        ids = f"a {self.kind}, b {self.kind}"
        likely = stash(pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(_likely(self.percent / 100), ids), "likely")
        sets = lambda c: self.sets.select(F.col("doc_id").alias(c), F.col("found").alias(f"s{c}"))
        with batches_of(pairs.sparkSession, 200):
            found = stash(likely.join(sets("b"), "b").join(sets("a"), "a").mapInArrow(_confirmed(self.percent), ids), "links")
        drop_stash(likely)
        return found

    def add(self, links: DataFrame) -> None:
        """Join the components of the links (a, b)."""
        if links.isEmpty():
            return
        ends = self.labelled(links.select(F.col("a").alias("doc_id"), "b")).select(F.col("c").alias("a"), F.col("b").alias("doc_id"))
        ends = stash(self.labelled(ends).select("a", F.col("c").alias("b")).where("a <> b").distinct(), "ends")
        if ends.isEmpty():
            drop_stash(ends)
            return
        joined = stash(components(ends), "joined")
        drop_stash(ends)
        moved = self.group.join(joined.selectExpr("id AS component", "component AS now"), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
        before, self.group = self.group, stash(moved.unionByName(joined.join(self.group.select("id"), "id", "left_anti")), "groups")
        drop_stash(joined)
        drop_stash(before)


def _small(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components in groups of at most SMALL rows (key, doc_id, c)."""
    side = lambda d: rows.select("key", F.col("doc_id").alias(d), F.col("c").alias(f"c{d}"))
    return side("a").join(side("b"), "key").where("a < b AND ca <> cb").select("a", "b")


def _divided(found: _Links, rows: DataFrame) -> DataFrame:
    """rows (key, doc_id, n) of the keys with several components, with the component c,
    the size of the group and a lead: the given one, or a member of the component with
    most rows."""
    rows = found.labelled(rows)
    parts = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.min("lead" if "lead" in rows.columns else "doc_id").alias("lead"))
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("size"), F.max(F.struct("m", "lead"))["lead"].alias("lead")).where("parts > 1").drop("parts")
    return stash(rows.drop("lead").join(keys, "key"), "divided")


def _by_lead(found: _Links, rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, doc_id, n) of buckets with several components as groups (key, doc_id,
    n, lead) of like sizes under one lead, the smallest document of the component with
    most rows: buckets of the same cluster become one group. Partners are in one or in
    neighbouring ranges of sizes, so a group has two ranges, and each document goes into
    two groups; into one where the range before its own, or the one after, is empty."""
    rows = found.labelled(rows)
    parts = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "c"))["c"].alias("lead")).where("parts > 1").select("key", "lead")
    spread = F.floor(F.log("n") / (np.log(100 / percent) + 1e-6))
    wide = stash(rows.join(main, "key").select("lead", "doc_id", "n").distinct().withColumn("range", spread), "wide")
    there = wide.groupBy("lead").agg(F.collect_set("range").alias("there"))
    sides = [F.when(F.array_contains("there", F.col("range") - 1), F.col("range")), F.when(F.array_contains("there", F.col("range") + 1), F.col("range") + 1)]
    groups = F.array_compact(F.array(*sides))
    wide = wide.join(there, "lead").withColumn("range", F.explode(F.when(F.size(groups) > 0, groups).otherwise(F.array("range"))))
    return wide.select(F.xxhash64("lead", "range").alias("key"), "doc_id", "n", "lead")


def _related(found: _Links, rows: DataFrame) -> DataFrame:
    """The rows of large groups, each compared with its lead; see _relation."""
    sets = lambda c, s: found.sets.select(F.col("doc_id").alias(c), F.col("found").alias(s))
    both = rows.where("doc_id <> lead").select("key", "doc_id", "lead").join(sets("doc_id", "sa"), "doc_id").join(sets("lead", "sb"), "lead")
    with batches_of(rows.sparkSession, 200):
        return stash(both.mapInArrow(_relation, f"key long, doc_id {found.kind}, lead {found.kind}, n long, n_lead long, held long, rest array<bigint>"), "related")


def _open(found: _Links, related: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What may still link documents of a group that its lead did not bring together:
    smaller groups (key, doc_id, n) and pairs (a, b).

    Two sets D and X share at most min(held) shingles of the lead's, and of the others
    those that both have. A link needs `percent` / (100 + percent) of both sizes; so D
    must share at least `lacks` shingles that the lead has not (with the smallest
    partner that its size allows). Where that is one or more, one of D's rarest such
    shingles, all but lacks - 1, must be among the rarest of X too (prefix filter):
    these shingles make the smaller groups. Shingles that a single component has come
    first, as no partner has them. Where it is none, D and X may do without a common
    one, if the shingles of the lead that each holds are enough for both sizes: these
    pairs are given as such.

    The filter holds for any order of the shingles. So D's first ones by hash, which need
    no counting, tell beforehand who may have a partner; only the shingles of these are
    all laid out and counted.
    """
    whole = 100 + percent
    least = related.groupBy("key").agg(F.min("n").alias("least"))
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    rows = found.labelled(related).join(least, "key").withColumn("lacks", F.ceil((F.col("n") + partner) * percent / whole) - F.col("held"))
    rows = stash(rows.drop("least", "lead", "n_lead"), "lacking")
    first = F.size("rest") - F.greatest("lacks", F.lit(1)) + 1
    head = rows.where(first > 0).select("key", "doc_id", "c", F.explode(F.slice("rest", F.lit(1), first.cast("int"))).alias("x"))
    head = stash(head, "heads")
    several = lambda each: each.groupBy("key", "x").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key", "x", "df")
    met = stash(head.join(several(head), ["key", "x"]).select("key", "doc_id").distinct(), "met")
    each = stash(rows.join(met, ["key", "doc_id"], "left_semi").select("key", "doc_id", "c", F.explode("rest").alias("x")), "laid")
    mine = each.join(several(each), ["key", "x"]).groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("common"))
    chosen = first - (F.size("rest") - F.size("common"))
    groups = rows.join(mine, ["key", "doc_id"]).where(chosen > 0).select("key", "doc_id", "n", F.explode(F.slice("common", F.lit(1), chosen.cast("int"))).alias("x"))
    groups = stash(groups.select(F.xxhash64("key", "x.x").alias("key"), "doc_id", "n"), "groups")
    for done in (head, met, each):
        drop_stash(done)
    # Pairs that need no shingle beyond the lead's. reach: the largest partner of a document.
    bare = rows.where("lacks <= 0").select("key", "doc_id", "n", "c", F.floor(F.col("held") * whole / percent - F.col("n")).alias("reach"))
    main = bare.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "c"))["c"].alias("main")).where("parts > 1").drop("parts")
    bare = bare.join(main, "key")
    outside = bare.where("c <> main")
    bounds = outside.groupBy("key").agg(F.max("reach").alias("most"))
    inside = bare.where("c = main").join(bounds, "key").where("n <= most").drop("most")
    bare = stash(outside.unionByName(inside), "bare")
    side = lambda d: bare.select("key", *[F.col(c).alias(f"{d}_{c}") for c in ("doc_id", "n", "c", "reach")])
    pairs = side("a").join(side("b"), "key").where("a_doc_id < b_doc_id AND a_c <> b_c AND a_n <= b_reach AND b_n <= a_reach")
    return groups, pairs.selectExpr("a_doc_id AS a", "b_doc_id AS b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    A document's set: distinct runs of `width` words between ASCII white space,
    A-Z in lower case; the whole where there are fewer words. Documents are linked
    if 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable. Null and empty texts, and texts without words, have no shingle and
    no link. Rows with a null doc_id have a null component_id and are kept. Rows
    that repeat a doc_id share its component: a link of any of their texts is one of
    all. An empty table gives no rows. Columns beside the two are not looked at.

    Documents with equal sets form a class, whose smallest doc_id goes on. A bucket
    holds the documents that share a band. Buckets of at most SMALL documents are
    compared pair by pair, larger ones with their smallest document. What then is in
    several components of a large bucket goes on in groups of like sizes: all are
    compared with a lead, and those that may be linked all the same share one of
    their rarest shingles that the lead has not (`_open`), which makes smaller
    groups, until none is left. So every pair that shares a band is linked by a path,
    verified, or proven to be no link, and no step makes more rows than its group has
    rows and rare shingles.
    """
    docs = docs.select("doc_id", "text")
    with small_broadcasts(docs.sparkSession):
        sketches, group = _components(docs, width, percent)
    # A hint, as this runs outside.
    return (
        sketches.join(group.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of all rows, and (id, component) of the linked ones; see near_duplicates."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = stash(docs.mapInArrow(_sketches(width), f"doc_id {kind}, n_shingles long, same long, registers binary"), "sketches")
    known = sketches.where("doc_id IS NOT NULL AND same IS NOT NULL")
    classes = known.groupBy("same", "n_shingles").agg(F.min("doc_id").alias("first"))
    copies = stash(known.join(classes, ["same", "n_shingles"]).where("doc_id <> first").selectExpr("first AS a", "doc_id AS b"), "copies")
    firsts = stash(known.dropDuplicates(["doc_id", "same"]).join(classes.withColumnRenamed("first", "doc_id"), ["same", "n_shingles", "doc_id"], "left_semi"), "firsts")
    bands = firsts.mapInArrow(_bands, f"doc_id {kind}, n_shingles long, bands array<bigint>")
    rows = stash(bands.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct(), "bands")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last")
    buckets = stash(rows.join(shared, "key"), "buckets")
    drop_stash(rows)
    asked = likely_among(docs, buckets.select("doc_id").distinct())
    sets = stash(asked.mapInArrow(_full(width), f"doc_id {kind}, found binary"), "sets")
    found = _Links(firsts, sets, copies, percent)
    others = buckets.where("doc_id > lead")
    few = others.where(f"size > 2 AND size <= {SMALL}").withColumn("c", F.col("doc_id"))
    pairs = others.selectExpr("lead AS a", "doc_id AS b").unionByName(_small(few)).distinct()
    found.add(found.verified(pairs))
    rows, pairs = _by_lead(found, others.where(f"size > {SMALL}").select("key", "doc_id", "n"), percent), pairs.limit(0)
    while True:
        rows = _divided(found, rows)
        pairs = stash(pairs.unionByName(_small(rows.where(f"size <= {SMALL}"))).distinct(), "pairs")
        large = rows.where(f"size > {SMALL}")
        related = None if large.isEmpty() else _related(found, large)
        if not pairs.isEmpty():
            found.add(found.verified(pairs))
        if related is None:
            break
        found.add(related.where(f"{100 + percent} * held >= {percent} * (n + n_lead)").selectExpr("lead AS a", "doc_id AS b"))
        rows, pairs = _open(found, related, percent)
    for done in (buckets, sets, firsts, copies):
        drop_stash(done)
    return sketches.select("doc_id", "n_shingles"), found.group


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: shingles of three words, 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
