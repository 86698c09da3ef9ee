"""SimHash fingerprints and their near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import fits_broadcast, pick, rest, sliced
from offerloom.llm.graph import components
from offerloom.session import cut_lineage, spread

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Minima of a shingle set: two sets agree on a whole band with probability J ** ROWS, and on none of all with (1 - J ** ROWS) ** BANDS.
BANDS, ROWS = 26, 5
#: Bands whose buckets are tied to hubs first; rows of a bucket in one unit, and guests for each of them.
HUB_BANDS, TILE, GUESTS = 3, 2048, 8
#: Links that a row is tried for in a unit before all others are.
LIKELIEST = 2
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_WEIGHTS = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:])), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where over half of the hashes have it; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for part in sliced(batches, chars="text", limit=4 << 20):
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])
        rest()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def minima(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima over the distinct shingle hashes, each under its own mixing of them."""
    least, base = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(base), 1024):
        mixed = base[at:at + 1024, None] * _FACTORS  # an odd factor permutes the values; its upper bits depend on all bits
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One hash a band of ROWS minima, as signed longs; the hash depends on the band."""
    rows = least.reshape(BANDS, ROWS).astype("<u4")
    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(row.tobytes(), number)) >> 63 else x for number, row in enumerate(rows)]


def _set_key(found: np.ndarray) -> int:
    """XXH64 of the sorted distinct shingle hashes, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)).astype(np.int64))


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_hash, fp, key, bands, digest`` of every row; key names the set of shingles, digest has a byte of each minimum.

    A set without shingles has neither bands nor a digest.
    """

    def run(batches):
        for part in sliced(batches, chars="text", limit=4 << 20):
            fps, keys, banded, digests = [], [], [], []
            for text in part.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle)
                found = np.unique(hashes)
                least = minima(found)
                fps.append(fingerprint(hashes))
                keys.append(_set_key(found))
                banded.append(bands(least) if len(found) else [])
                digests.append(least.astype(np.uint8).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.int64()),
                 pa.array(banded, pa.list_(pa.int64())), pa.array(digests, pa.binary())],
                ["doc_id", "text_hash", "fp", "key", "bands", "digest"])
        rest()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, key long, bands array<long>, digest binary")


def _least_equal(similarity: float, n: int = BANDS * ROWS) -> float:
    """How many of n minima sets of that similarity share at least, four standard deviations granted."""
    return (similarity - 4 * (similarity * (1 - similarity) / n) ** 0.5) * n


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def likely_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose digests do not rule the similarity out."""

    least = _least_equal(similarity)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                kept = pa.array((_bytes(batch.column("left")) == _bytes(batch.column("right"))).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(kept)
        rest()

    digests = nodes.where("digest IS NOT NULL").select("key", "digest")
    met = pairs.join(digests.toDF("a", "left"), "a").join(digests.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return met.mapInArrow(run, "a long, b long")


def _shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``key, members``: 32-bit halves of the shingle hashes of each wanted set, from one of its texts."""

    def run(batches):
        for part in sliced(batches, chars="text", limit=4 << 20):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column("text")]
            members = [np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in found], pa.int64()), pa.array(members, pa.list_(pa.int32()))], ["key", "members"])
        rest()

    named = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash")
    chosen = cut_lineage(rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min(named).alias("name")).select("name").distinct())
    texts = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")).withColumn("name", named)
    made = texts.join(fits_broadcast(chosen), "name", "left_semi").select("text").mapInArrow(run, "key long, members array<int>")
    return made.dropDuplicates(["key"])  # a row that occurs twice


def band_ties(nodes: DataFrame) -> DataFrame:
    """``a, b``: each set of a band's bucket tied to two members of it, other ones in each band.

    The two are a minimum and a maximum of a hash that the band salts, so a bucket of any size gives
    two edges a member and is combined map-side. It joins most of a large group of near copies cheaply;
    what it leaves apart meets in ``crossing_pairs``.
    """
    placed = nodes.select("key", F.explode("bands").alias("bucket"))
    rank = F.struct(F.xxhash64("key", "bucket").alias("by"), F.col("key").alias("hub"))
    hubs = placed.groupBy("bucket").agg(F.min(rank)["hub"].alias("low"), F.max(rank)["hub"].alias("high")).where("low <> high")
    tied = placed.join(hubs, "bucket").select("key", F.explode(F.array("low", "high")).alias("hub")).where("key <> hub")
    return tied.select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct()


def _units(rows: DataFrame) -> DataFrame:
    """The rows (key, root, bucket, ...) with ``unit, home``: bounded parts of each bucket in which every two groups meet.

    In each bucket the rows outside its largest group are at home, in tiles of at most about TILE rows; rows
    of the largest group, and of later tiles, are their guests, in chunks of GUESTS tiles. So a hot bucket
    whose rows are almost all linked costs what its few others cost, and no unit grows with it.
    """
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("all"))
    sizes = sizes.select("bucket", F.col("top.root").alias("major"), F.ceil((F.col("all") - F.col("top.size")) / TILE).alias("tiles"), F.ceil(F.col("all") / (GUESTS * TILE)).alias("chunks"))
    rows = rows.join(sizes.filter("tiles > 0"), "bucket")
    tile, chunk, zero = F.pmod(F.xxhash64("key"), "tiles"), F.pmod(F.xxhash64("key", F.lit("chunk")), "chunks"), F.lit(0).cast("long")
    unit = lambda t, c, home: F.struct(F.xxhash64("bucket", t, c).alias("unit"), F.lit(home).alias("home"))
    guest = F.transform(F.sequence(zero, F.col("tiles") - 1), lambda t: unit(t, chunk, False))
    units = F.when(F.col("root") == F.col("major"), guest).otherwise(F.concat(
        F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: unit(tile, c, True)), F.slice(guest, F.lit(1), tile.cast("int"))))
    return rows.select("key", "root", F.inline(units))


def _met(rows: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """``a, b`` of the rows (key, root, digest, unit, home): likely pairs of different groups that share a unit, one at home.

    Home rows are compared with the rows one, two, three places on, for all units of a batch at once. Of
    each row's pairs with a group only the ``most`` likeliest are kept. If the rows have their ``members``,
    pairs are verified instead, the likeliest first, and only those returned that join two groups.
    """
    least, exact = _least_equal(similarity), "members" in rows.columns

    def compared(held: pa.Table):
        unit, home, root, key = (held.column(c).to_numpy() for c in ("unit", "home", "root", "key"))
        digests = _bytes(held.column("digest").combine_chunks())
        at, ahead, found, waiting = np.flatnonzero(home), 1, [], 0

        def likeliest() -> tuple[np.ndarray, ...]:
            i, j, same = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-same, root[j], i))
            i, j, same = i[order], j[order], same[order]
            place = np.arange(len(i))
            opens = np.r_[True, (i[1:] != i[:-1]) | (root[j[1:]] != root[j[:-1]])]
            kept = place - np.maximum.accumulate(np.where(opens, place, 0)) < most
            return i[kept], j[kept], same[kept]

        def joining() -> tuple[np.ndarray, np.ndarray]:
            sets = held.column("members").combine_chunks()
            bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            i, j, same = (np.concatenate(x) for x in zip(*found))
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while x in above:
                    x = above[x]
                return x

            joined = []
            for x, y in zip(*(v[np.argsort(-same, kind="stable")].tolist() for v in (i, j))):
                one, two = top(int(root[x])), top(int(root[y]))
                if one == two:
                    continue
                left, right = values[bounds[x]:bounds[x + 1]], values[bounds[y]:bounds[y + 1]]
                if min(len(left), len(right)) >= similarity * max(len(left), len(right)):
                    shared = len(np.intersect1d(left, right, assume_unique=True))
                    if shared >= similarity * (len(left) + len(right) - shared):
                        above[max(one, two)] = min(one, two)
                        joined.append((x, y))
            return tuple(np.array(v, np.int64) for v in zip(*joined)) if joined else (np.empty(0, np.int64), np.empty(0, np.int64))

        while True:
            at = at[at + ahead < len(key)]
            at = at[unit[at] == unit[at + ahead]]
            if not len(at):
                break
            met = at[root[at] != root[at + ahead]]
            for lo in range(0, len(met), 1 << 16):
                i = met[lo:lo + (1 << 16)]
                same = (digests[i] == digests[i + ahead]).sum(axis=1)
                likely = same >= least
                if likely.any():
                    found.append((i[likely], i[likely] + ahead, same[likely]))
                    waiting += int(likely.sum())
                    if not exact and waiting > 1 << 20:
                        found = [likeliest()]
                        waiting = len(found[0][0]) // 2
            ahead += 1
        if found:
            i, j = joining() if exact else likeliest()[:2]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(key[i], key[j])), pa.array(np.minimum(key[i], key[j]))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            unit = held.column("unit").to_numpy()
            whole = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
            if whole:
                yield from compared(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None:
            yield from compared(held.combine_chunks())
        rest()

    return spread(rows, "unit").sortWithinPartitions("unit", F.desc("home")).mapInArrow(run, "a long, b long").distinct()


def crossing_pairs(nodes: DataFrame, roots: DataFrame, similarity: float, most: int) -> DataFrame:
    """``a, b``: pairs of different groups that share a bucket and may be that similar, the ``most`` likeliest of a row with a group in a unit.

    One link joins a row to a group, so these decide almost all. Every two groups of which any pair may be
    that similar have a pair among them. Only buckets that hold several groups are read on.
    """
    grouped = nodes.join(roots, nodes.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("root"), "bands")
    placed = cut_lineage(grouped).select("key", "root", F.explode("bands").alias("bucket"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rows = _units(cut_lineage(placed.join(mixed, "bucket")))
    return _met(rows.join(nodes.select("key", "digest"), "key"), similarity, most)


def joining_links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: verified links that join groups, found among all likely pairs of groups that may be near at all.

    Groups with a likely pair form clusters. The sets of a cluster's rows are sent to its units once, and
    pairs are verified there, so no pair is a row of a table but those that join two groups.
    """
    pairs = crossing_pairs(nodes, roots, similarity, 1)
    of = roots.toDF("key", "root")
    ends = pairs.join(of.toDF("a", "x"), "a", "left").join(of.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    clusters = cut_lineage(components(ends)).toDF("root", "bucket")
    grouped = nodes.join(of, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "digest").join(clusters, "root")
    grouped = cut_lineage(grouped.where("digest IS NOT NULL"))
    sets = cut_lineage(_shingle_sets(docs, rows, grouped.select("key"), shingle))
    members = _units(grouped.select("key", "root", "bucket")).join(grouped.select("key", "digest").join(sets, "key"), "key")
    return _met(members, similarity)


def similar_links(docs: DataFrame, rows: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """``node, root`` of the sets with links: candidates whose Jaccard similarity is ``similarity`` or more.

    Candidates come in steps: SimHash neighbours and two hubs of each bucket of the first bands; then the likeliest
    pairs of a bucket of any band that are not in one group yet; then all others of groups that may be near (``joining_links``). A pair shares a band with a probability of
    1 - (1 - J ** ROWS) ** BANDS. Digests of the minima drop unlikely candidates before sets are made,
    and every other one is verified on the sets. Only sets of such candidates are made again and shuffled.
    """
    nodes = cut_lineage(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("digest").alias("digest")))
    named = nodes.groupBy("fp").agg(F.min("key").alias("named"))

    def fingerprint_pairs():
        same_fp = nodes.select("key", "fp").join(named, "fp").where("key <> named").select(F.col("key").alias("a"), F.col("named").alias("b"))
        first, second = named.select(F.col("fp").alias("a"), F.col("named").alias("x")), named.select(F.col("fp").alias("b"), F.col("named").alias("y"))
        balls = ball_links(named.select("fp"), radius).join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        return likely_pairs(same_fp.union(balls), nodes, similarity)

    def hub_pairs():
        return likely_pairs(band_ties(nodes.select("key", F.slice("bands", 1, HUB_BANDS).alias("bands"))), nodes, similarity)

    found = None
    for step in (lambda: fingerprint_pairs().union(hub_pairs()).distinct(), lambda: crossing_pairs(nodes, roots, similarity, LIKELIEST)):
        edges = cut_lineage(step())
        ends = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        sets = cut_lineage(_shingle_sets(docs, rows, ends, shingle))
        paired = edges.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
        shared, total = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
        good = paired.where(F.least(F.size("left"), F.size("right")) >= similarity * F.greatest(F.size("left"), F.size("right"))).where(
            shared >= similarity * (total - shared)).select("a", "b")
        found = cut_lineage(good if found is None else good.union(found))
        roots = components(found)
    return components(cut_lineage(joining_links(docs, rows, nodes, roots, shingle, similarity).union(found)))


def ball_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` at ``radius`` (two or less) differing bits.

    Every fingerprint emits all variants within half the radius: itself and its 64 neighbours. Two
    fingerprints within the radius meet on a variant between them. A variant has at most 65 distinct
    members whatever the data, so a group never grows with a hot text. Within a group each member
    is tied to the smallest one after its distance is verified; all of a group are that near.
    """
    if not 0 <= radius <= 2:
        raise ValueError("one flipped bit on either side reaches two bits")
    flips = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)]]
    variants = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("variant"))
    groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    tied = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    return tied.where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept, text_hash`` of every document.

    Fingerprints are computed once and checkpointed; equal ones collapse to one row (map-side)
    before the ball hashing, so thousands of copies cost no more than one. Null, empty and blank
    texts have the fingerprint zero and are linked like any other. A repeated row gives a repeated
    result row. A null doc_id takes part but is never the smallest unless its whole group is null.
    kept: the row is the one of its group that stays: smallest doc_id, then smallest hash of the text
    (XXH64), so exact repeats of it are marked too. An empty table gives no rows.

    With a similarity, the groups are of documents linked by a Jaccard similarity of their shingle sets
    of at least that, verified on the sets; see similar_links.
    """
    node = "fp" if similarity is None else "key"
    rows = cut_lineage(fingerprints(docs, shingle) if similarity is None else set_rows(docs, shingle))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    distinct = cut_lineage(rows.groupBy(node).agg(F.min(rank).alias("lowest")))
    roots = components(ball_links(distinct.select("fp"), radius)) if similarity is None else similar_links(docs, rows, shingle, radius, similarity)
    linked = distinct.join(roots, distinct[node] == roots.node, "left").select(distinct[node], "lowest", F.coalesce("root", distinct[node]).alias("root"))
    linked = cut_lineage(linked)
    of_root = linked.groupBy("root").agg(F.min("lowest").alias("stays"))
    of_node = cut_lineage(linked.join(of_root, "root").select(node, "stays"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    return rows.join(of_node, node).select("doc_id", hexed.alias("fingerprint"), F.col("stays.doc_id").alias("component_id"), kept.alias("kept"), "text_hash")
