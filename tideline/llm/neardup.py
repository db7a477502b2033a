"""Near-duplicate documents by HyperMinHash.

Sketch. A document's set of word shingles (64-bit hashes) falls into `registers` buckets; each keeps the least hash of
its bucket as a leading-zero count and some mantissa bits, 16 bits in all. Bands of neighbouring registers are hashed;
empty registers borrow from the next full one for this, so that short documents have full bands.

Documents with equal sets are one node, found by a 128-bit digest of the set. Nodes that share a band with another and
have enough shingles in common with other nodes at all are live. In rounds, each live node meets one center of its bands
(stars, not all pairs). Then, for bands that still hold several components, nodes meet across components by the rarest
shingles of their sets: two sets that are alike share one within their first few in order of frequency, and where it
stands bounds how alike they can be. Pairs whose similarity, estimated from the registers and corrected for chance
collisions, isn't far below the threshold are confirmed on full sets. Components come from distributed star contraction.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import few, forget, materialize, rows_in, words

MANTISSA = 10
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)


class Shingles:
    """Sets of hashed shingles of whole texts; remembers the hashes of `most` words."""

    def __init__(self, size: int, most: int = 400_000) -> None:
        self.size, self.most, self.seen = size, most, {}

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = list(map(seen.get, tokens))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = seen[tokens[i]] = xxhash.xxh3_64_intdigest(tokens[i])
        return np.array(out, dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles. Fewer words than a shingle: the whole sequence is one. No words: none."""
        tokens = words(text)
        if not tokens:
            return np.zeros(0, np.uint64)
        h = self.hashes(tokens)
        n = min(self.size, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * np.uint64(MIX[i % len(MIX)])
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed)


def sketch(shingles: np.ndarray, registers: int) -> np.ndarray:
    """HyperMinHash registers: 0 is empty, otherwise (leading zeros + 1) << MANTISSA | mantissa of the bucket's least hash."""
    out = np.zeros(registers, np.uint16)
    if not len(shingles):
        return out
    bucket = ((shingles >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
    low = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)  # 63 fresh bits
    least = np.full(registers, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, bucket.astype(np.int64), low.view(np.int64))
    full = np.unique(bucket).astype(np.int64)
    value = least[full]
    exponent = np.frexp(value.astype(np.float64))[1]  # bits in use; a float's rounding may add one, alike for equal hashes
    zeros = np.clip(63 - exponent, 0, 61)
    shift = np.maximum(exponent - 1 - MANTISSA, 0)
    mantissa = (value >> shift) & ((1 << MANTISSA) - 1)
    out[full] = ((zeros + 1) << MANTISSA | mantissa).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; empty registers borrow from the next full one around the circle, with the distance."""
    full = np.flatnonzero(registers)
    n = len(registers)
    at = np.arange(bands * rows)
    near = full[np.searchsorted(full, at) % len(full)]
    value = registers[near].astype(np.uint64) << np.uint64(16) | ((near - at) % n).astype(np.uint64)
    value = value.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(MIX[1])
    for r in range(rows):
        key = (key ^ value[:, r]) * np.uint64(MIX[r % len(MIX)])
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


@functools.cache
def chance(n: int, m: int, registers: int) -> float:
    """Probability that a register of two unrelated sets of n and m shingles is equal and full: exact in the leading zeros,
    within one of them mantissas agree once in 2**MANTISSA."""
    a, b, total, span = n / registers, m / registers, 0.0, 1 << 6
    for z in range(60):
        inside = [[math.exp(-x * 2.0**-z * (0.5 + (i + k) / 2 / span)) for x in (a, b)] for i in range(span) for k in (0, 1)]
        for i in range(span):
            (p0, q0), (p1, q1) = inside[2 * i], inside[2 * i + 1]
            total += (p0 - p1) * (q0 - q1) * span / (1 << MANTISSA)
    return min(total, 0.5)


def coarse(n: int) -> int:
    """Set sizes to three binary digits, so that chance() is worked out a few hundred times at most."""
    return n if n < 8 else n >> (n.bit_length() - 3) << (n.bit_length() - 3)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Jaccard similarity corrected for collisions, and how many registers it rests on."""
    used = int(((a > 0) | (b > 0)).sum())
    same = int(((a == b) & (a > 0)).sum())
    share = chance(*sorted((coarse(n), coarse(m))), len(a)) * len(a) / max(used, 1)
    return max(0.0, (same / max(used, 1) - share) / (1 - share)), used


def _digests(found: np.ndarray) -> tuple[int | None, int | None]:
    """A 128-bit digest of a set in two signed halves; none for the empty set."""
    if not len(found):
        return None, None
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def sketches(docs: DataFrame, key: str, text: str, size: int, registers: int) -> DataFrame:
    """k, n (set size), d1, d2 (digest of the set, null for none), regs."""

    def run(batches):
        make = Shingles(size)
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = [make.of(said) for said in batch.column(1).to_pylist()]
                digests = [_digests(x) for x in made]
                columns = [[len(x) for x in made], [d for d, _ in digests], [d for _, d in digests]]
                regs = pa.array([sketch(x, registers).tobytes() if len(x) else None for x in made], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), regs], names=["k", "n", "d1", "d2", "regs"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, n long, d1 long, d2 long, regs binary")


def banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """band, k for each node and band; the key has the band's number in it."""

    def run(batches):
        for batch in batches:
            made = [band_keys(np.frombuffer(r, np.uint16), bands, rows) for r in batch.column(1).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["band", "k"])

    return nodes.select("k", "regs").mapInArrow(run, "band long, k long")


def shingle_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """d1, d2, shingles (sorted) of each row of docs."""

    def run(batches):
        make = Shingles(size)
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = [make.of(t) for t in batch.column(0).to_pylist()]
                digests = [_digests(x) for x in made]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["d1", "d2", "shingles"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "d1 long, d2 long, shingles array<long>")


def confirmed(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of live nodes with 100 * intersection >= percent * union. Pairs whose estimate from the registers is more
    than six deviations below that are ruled out (not where too few registers are full to tell); full sets decide on the rest."""
    floor = percent / 100

    def near(n: int, m: int, x: bytes, y: bytes) -> bool:
        if 100 * min(n, m) < percent * max(n, m):
            return False
        j, used = estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m)
        return used < 64 or j >= floor - 6 * math.sqrt(floor * (1 - floor) / used)

    def run(batches):
        for whole in batches:
            for batch in rows_in(iter([whole])):
                regs = [batch.column(i).to_pylist() for i in (2, 3)]
                flat, ends = [], []
                for i in (4, 5):
                    flat.append(batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                    sizes = np.asarray(pc.list_value_length(batch.column(i)))
                    ends.append(np.concatenate([[0], np.cumsum(sizes)]))
                ok = []
                for i in range(batch.num_rows):
                    x, y = (flat[s][ends[s][i] : ends[s][i + 1]] for s in (0, 1))
                    if not near(len(x), len(y), regs[0][i], regs[1][i]):
                        ok.append(False)
                        continue
                    if len(x) > len(y):
                        x, y = y, x
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sides = [live.select(F.col("k").alias(x), F.col("regs").alias(f"r{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab"]
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """k, c: for each end of a link the least node it reaches. Each round a node takes the least label among its neighbours' and
    links jump to labels, so rounds grow with the logarithm of a component's length; every round is a table in the shared folder."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "edges")
    while True:
        # Large star: a node's larger neighbours link to its least neighbour.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = edges.select(F.col("b").alias("x"), F.col("a").alias("y")).join(few(least.withColumnRenamed("a", "x")), "x").select(F.col("y").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large-star")
        # Small star: a node and its smaller neighbours link to the least of them.
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(few(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        after = materialize(small.distinct(), "small-star")
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            roots = after.select(F.col("b").alias("k"), F.col("b").alias("c")).distinct()
            return materialize(after.select(F.col("a").alias("k"), F.col("b").alias("c")).unionByName(roots), "labels")
        edges = after


def open_part(rows: DataFrame) -> DataFrame:
    """Of (band, k, c) the rows of bands that hold more than one component."""
    mixed = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    return rows.join(materialize(mixed, "mixed-bands"), "band").select(*rows.columns)


def relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """rows with each component c replaced by the one it has become in `moved` (k, c)."""
    moved = few(moved.select(F.col("k").alias("c"), F.col("c").alias("_to")))
    return rows.join(moved, "c", "left").withColumn("c", F.coalesce("_to", "c")).drop("_to")


def _order(turn: int) -> Column:
    return F.struct(F.lit(0) if turn else F.col("lack"), F.xxhash64("k", F.lit(turn)), "k")


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """For each node the center of another component that it shares most bands with. Each band has one center: at first the node that
    lacks least (of a group of near copies the one most like all others), then one drawn anew each turn. Nodes and centers only, so a
    band of n nodes gives n - 1 rows at most."""
    center = rows.groupBy("band").agg(F.min_by(F.struct("k", "c"), _order(turn)).alias("z"))
    center = materialize(center.select("band", F.col("z.k").alias("zk"), F.col("z.c").alias("zc")), "centers")
    met = rows.join(center, "band").where("c <> zc").groupBy("k", "zk").agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy(F.col("k").alias("a")).agg(F.max_by("zk", F.struct("times", -F.col("zk"))).alias("b"))


def spread(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """h, k, c, n: each shingle of the nodes in labels (k, c)."""
    return sets.join(few(labels, 1_000_000), "k").select("k", "c", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("h"))


def common(met: DataFrame) -> DataFrame:
    """h, df: shingles of more than one component, and how many nodes have them."""
    return met.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h", "df")


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """k of the nodes that can be linked at all: at least `percent` of their shingles occur in other nodes, too (an intersection
    can't be larger than that, nor a union smaller than the set); and lack, how many of its shingles don't."""
    met = sets.select("k", F.col("k").alias("c"), F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    able = met.join(common(met).select("h"), "h", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("n"))
    return able.where(F.col("s") * 100 >= F.col("n") * percent).select("k", (F.col("n") - F.col("s")).alias("lack"))


def prefixes(met: DataFrame, percent: int) -> DataFrame:
    """band (a shingle), k, c, n, at, lack: the first shingles of each node, by which it meets any set of another component that is like it.

    A node's shingles are put in one order for all nodes: first those of one component only, then by df. Sets of n shingles and
    more that are `percent` alike share one of the first n - ceil(n * percent / 100) + 1; `at` is the place, from 1. The order
    stays good when components have grown."""
    kinds = materialize(common(met), "common-shingles")
    node = Window.partitionBy("k")
    ranked = met.join(kinds, "h").withColumn("i", F.row_number().over(node.orderBy("df", "h"))).withColumn("s", F.count(F.lit(1)).over(node))
    at = F.col("n") - F.col("s") + F.col("i")
    return ranked.withColumn("at", at).where((F.col("n") - F.col("at") + 1) * 100 >= F.col("n") * percent).select(F.col("h").alias("band"), "k", "c", "n", "at", (F.col("n") - F.col("s")).alias("lack"))


def _room(percent: int) -> str:
    """Whether places a.at and b.at of a shared shingle leave room for sets that are alike. The first shingle that two sets share has
    all others behind it, so their intersection is at most what stands from there on in either."""
    return f"least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} AND least(a.n - a.at, b.n - b.at) + 1 >= (a.n + b.n) * {percent} / {100 + percent}.0D - 1e-9"


def prefix_stars(first: DataFrame, turn: int, percent: int) -> DataFrame:
    """As star_pairs(), by shingles of the prefixes, where their places leave room."""
    center = first.groupBy("band").agg(F.min_by(F.struct("k", "c", "n", "at"), _order(turn)).alias("z"))
    center = materialize(center.select("band", "z.*"), "centers")
    met = first.alias("a").join(center.alias("b"), "band").where(f"a.c <> b.c AND {_room(percent)}").groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("zk")).agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy(F.col("k").alias("a")).agg(F.max_by("zk", F.struct("times", -F.col("zk"))).alias("b"))


def across(first: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that share a shingle of their prefixes, where its places leave room for `percent`. The
    smaller set of a pair needs still fewer shingles: its size is the least that the other one can have."""
    short = first.where((F.col("n") - F.col("at") + 1) * (100 + percent) >= 2 * percent * F.col("n"))
    return short.alias("a").join(first.alias("b"), "band").where(f"a.c <> b.c AND (a.n < b.n OR a.n = b.n AND a.k < b.k) AND {_room(percent)}").select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


def _merged(labels: DataFrame | None, rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, open rows) after more links between nodes: links are taken to components, and only those are joined up."""
    if labels is not None:
        for end in "ab":
            names = few(labels.select(F.col("k").alias(end), F.col("c").alias("_c")))
            links = links.join(names, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    moved = components(links)
    if labels is None:
        labels = moved
    else:
        fresh = moved.join(labels.select("k"), "k", "left_anti")
        labels = materialize(relabelled(labels, moved).select("k", "c").unionByName(fresh.select("k", "c")), "labels")
    return labels, materialize(open_part(relabelled(rows, moved).select(*rows.columns)), "open-bands")


def _rounds(labels: DataFrame | None, rows: DataFrame, live: DataFrame, percent: int, stars) -> tuple[DataFrame | None, DataFrame]:
    """_merged() by rounds of stars (rows, turn), until less than a tenth of a round's pairs are links."""
    for turn in range(16):
        pairs = materialize(stars(rows, turn), "star-pairs")
        links = materialize(confirmed(pairs, live, percent), "links")
        tried, found = pairs.count(), links.count()
        if found:
            labels, rows = _merged(labels, rows, links)
        forget(pairs, links)
        if 10 * found < tried or not found:
            break
    return labels, rows


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 48, rows: int = 5) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z in lower
    case, words between ASCII white space). component_id is the least key that links reach; kept: the key is its component's.
    A text without words has no set and no links; one shorter than a shingle has its whole sequence as the only one. Equal sets
    are always linked. Rows with a null key are linked with nothing: component_id null, kept true. Rows that share a key are one
    document: all are in one component, whether or not they share their text. An empty table gives no rows. Shingles count by
    64-bit hashes: two of a text fall together once in 10**19 pairs.

    A link at the threshold shares no band with probability (1 - (percent / 100)**rows)**bands: 2e-8 at 80, 1e-12 at 85.
    """
    registers = bands * rows
    thin = materialize(sketches(docs, key, text, size, registers), "sketches")
    full = thin.where("k IS NOT NULL AND n > 0")
    nodes = full.groupBy("d1", "d2").agg(F.min("k").alias("least"), F.first("regs").alias("regs"))
    nodes = materialize(nodes.withColumn("k", F.monotonically_increasing_id()), "nodes")  # numbers are kept by the written table
    repeated = materialize(full.groupBy(F.col("k").alias("least")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("least"), "repeated-keys")
    repeats = not repeated.isEmpty()
    buckets = materialize(banded(nodes, bands, rows), "bands")
    several = materialize(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band"), "several")
    shared = materialize(buckets.join(several, "band", "left_semi"), "shared-bands")
    forget(buckets, several)
    # Full sets, of nodes that share a band only.
    wanted = nodes.join(shared.select("k").distinct(), "k", "left_semi").select("k", "least", "d1", "d2")
    wanted = few(materialize(wanted, "wanted"), 1_000_000)
    some = docs.join(wanted.select(F.col("least").alias("_least")).distinct() if repeats else wanted.select(F.col("least").alias("_least")), F.col(key).cast("long") == F.col("_least"), "left_semi")
    sets = shingle_sets(some, key, text, size).join(wanted.select("k", "d1", "d2"), ["d1", "d2"]).select("k", "shingles")
    sets = materialize(sets.dropDuplicates(["k"]) if repeats else sets, "sets")
    # Most bands are met by chance: nodes without enough shingles in common with any other go first.
    able = few(materialize(linkable(sets, percent), "linkable"), 1_000_000)
    live = materialize(sets.join(able.select("k"), "k").join(nodes.select("k", "regs").join(able, "k", "left_semi"), "k"), "live")
    rows = materialize(open_part(shared.join(able, "k").select("band", "k", F.col("k").alias("c"), "lack")), "open-bands")
    forget(sets, shared)
    labels = None
    if repeats:
        same = full.join(few(repeated.withColumnRenamed("least", "k")), "k", "left_semi").select(F.col("k").alias("doc"), "d1", "d2").distinct().join(nodes.select("k", "d1", "d2"), ["d1", "d2"])
        same = materialize(same.select("doc", F.col("k").alias("a")).distinct(), "repeated-nodes")
        links = same.join(same.groupBy("doc").agg(F.min("a").alias("b")), "doc").where("a <> b").select("a", "b")
        labels, rows = _merged(labels, rows, links)
    # Rounds of stars: cheap, and they join nearly all that belongs together. They end when few of their pairs are links.
    labels, rows = _rounds(labels, rows, live, percent, star_pairs)
    # What is left: nodes of different components that could still be linked, by the rarest shingles of their sets. Again stars
    # first, then all pairs across components.
    met = spread(live, materialize(rows.select("k", "c").distinct(), "open-labels"))
    first = materialize(open_part(prefixes(met, percent)), "prefixes")
    labels, first = _rounds(labels, first, live, percent, functools.partial(prefix_stars, percent=percent))
    pairs = materialize(across(first, percent).distinct(), "across")
    links = materialize(confirmed(pairs, live, percent), "links")
    labels, _ = _merged(labels, first, links)
    forget(first, pairs, links, live, rows)
    names = nodes.select("k", "least")
    ids = materialize(labels.join(names, "k").groupBy("c").agg(F.min("least").alias("id")), "component-ids")
    named = names.join(labels, "k", "left").join(few(ids), "c", "left").select("k", F.coalesce("id", "least").alias("id"))
    by_set = materialize(nodes.select("k", "d1", "d2").join(named, "k").select("d1", "d2", "id"), "ids-by-set")
    whole = thin.select("k", "n", "d1", "d2").join(by_set, ["d1", "d2"], "left")
    own = F.when(F.col("k").isNotNull(), F.coalesce(F.col("id"), F.col("k")))
    return whole.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("k") == own, F.lit(True)).alias("kept"))


def without(docs: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """docs less the rows whose key is in `gone` (a table in the shared folder); texts are shuffled only if it has over a million keys."""
    return docs.join(few(gone, 1_000_000), F.col(key).cast("long") == F.col(gone_key), "left_anti")
