"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint is the bitwise majority of its shingles' hashes. Equal fingerprints are one point. A tree of vantage
points, fitted on a bounded sample, deals the points to shards: left of a node if their Hamming distance to its vantage
point is at most its radius, else right. A point on the right whose ball of the search radius reaches over the boundary is
queried on the left as well (by the triangle inequality no other pair crosses it), so each pair within the radius meets in
a shard. Each shard builds its own tree down to small buckets and searches it with the same bounds. A shard returns links
that span the components it sees, not all pairs; rounds of star contraction join the components of all shards.

Few bits stand for similarities near 1 only: at a similarity of 0.8 two fingerprints differ in ten of 64 bits, where no
ball prunes a tree. `keep_one` therefore joins the tree's links with those of texts whose shingle sets have a similarity of
SIMILARITY or more, found by bands of minima and checked exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_dir, fresh_dir

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BUCKET = 192
#: Fingerprints that live in a shard, about, and the sampled ones for each shard that shape the dealing tree. A tree has
#: MOST_SHARDS at most, so its sample is bounded; a shard where over OVERSIZE times its share live is dealt again by a tree of its
#: own. Guests grow with the number of shards (1.4 copies of a point at 4, 13 at 1,024), so shards are large.
SHARD, SAMPLE, MOST_SHARDS, OVERSIZE = 16_384, 64, 16_384, 4
#: Two texts of similarity 0.8 share one of BANDS bands of ROWS minima with a chance of 0.998.
SIMILARITY, BANDS, ROWS = 0.8, 16, 5
#: Comparisons with one text that a task gets at a time.
HEAP = 256


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included: A-Z in lower case; fewer words: all of them; none: no hash."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = WORD.findall((text or "").encode().lower())
    whole = b" ".join(found)
    if len(found) <= shingle:
        return np.array([digest(whole, seed)] if found else [], "<u8")
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: len(found) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)), "<u8", len(stops))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int] | None:
    """A signed key for each band: a hash of the least of the shingles' hashes under `rows` mixings; no shingle: None."""
    import xxhash

    if not len(hashes):
        return None
    mix = np.random.default_rng(7).integers(0, 1 << 64, (2, bands * rows), np.uint64)
    mask, odd = mix[0], mix[1] | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[k : k + 512, None] ^ mask) * odd).min(0), out=least)
    return [xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) - (1 << 63) for i in range(bands)]


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", bands: int = 0) -> DataFrame:
    """doc_id, k_text (a hash of the text), fp (the fingerprint as a signed long) and bands (null, or keys of `bands` bands) of every whole text.

    Null texts have no words.
    """
    rows = ROWS

    def run(batches):
        for b in batches:
            fps, keys = [], []
            for t in b.column(2).to_pylist():
                hashes = shingle_hashes(t, shingle)
                fps.append(majority(hashes))
                keys.append(band_keys(hashes, bands, rows) if bands else None)
            got = np.array(fps, "<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.view("<i8"), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "k_text", "fp", "bands"])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("k_text"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, k_text long, fp long, bands array<long>")


def distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def grow(sample: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """(vantage point, radius) of a complete tree's inner nodes in heap order, split at the lower median of the sample."""
    nodes, parts = [], [sample]
    while len(nodes) + 1 < leaves:
        rows = parts.pop(0)
        vantage = int(rows[len(rows) // 2]) if len(rows) else 0
        far = distance(rows, vantage)
        radius = int(np.sort(far)[(len(far) - 1) // 2]) if len(far) else 32
        nodes.append((vantage, radius))
        parts += [rows[far <= radius], rows[far > radius]]
    return nodes


def deal(points: np.ndarray, nodes: list[tuple[int, int]], reach: int, lives: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether it lives there) for every leaf that a point belongs to or is queried in. `lives`: which
    points live in what is dealt, where some are guests."""
    which, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool) if lives is None else lives
    if not nodes:
        return which, node, home
    vantage, radius = np.array([v for v, _ in nodes], np.uint64), np.array([r for _, r in nodes], np.int64)
    while node.size and node[0] < len(nodes):
        far = np.bitwise_count(points[which] ^ vantage[node]).astype(np.int64) - radius[node]
        # who lives outside is queried inside too; who is only queried here goes to both sides of a near boundary
        over = ((far > 0) & (far <= reach)) | (~home & (far <= 0) & (far > -reach))
        which, home = np.concatenate([which, which[over]]), np.concatenate([home, np.zeros(over.sum(), bool)])
        node = np.concatenate([2 * node + 1 + (far > 0), 2 * node[over] + 1 + (far[over] <= 0)])
    return which, node - len(nodes), home


def spanning(points: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indexes) that span the components of all pairs within reach, of which one point at least lives here."""
    parent = np.arange(len(points))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            for _ in range(64):
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            np.minimum.at(parent, high, low)

    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]  # (who lives in a node, who else is queried there)
    while todo:
        own, guests = todo.pop()
        if not len(own) or len(own) + len(guests) < 2:
            continue
        split = None
        if len(own) > BUCKET:
            vantage = points[own[len(own) // 2]]
            near = np.bitwise_count(points[own] ^ vantage).astype(np.int64)
            radius = int(np.sort(near)[(len(near) - 1) // 2])
            if radius < near.max():
                split = vantage, near, radius
        if split:
            vantage, near, radius = split
            d = np.bitwise_count(points[guests] ^ vantage).astype(np.int64)
            edge = own[(near > radius) & (near <= radius + reach)]  # they meet those inside there
            todo.append((own[near <= radius], np.concatenate([guests[d <= radius + reach], edge])))
            todo.append((own[near > radius], guests[d > radius - reach]))
        else:
            asked = np.concatenate([own, guests])
            for k in range(0, len(asked), 2048):
                block = asked[k : k + 2048]
                for o in range(0, len(own), 512):
                    part = own[o : o + 512]
                    i, j = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[part][None, :]) <= reach)
                    a, b = block[i], part[j]
                    if (a != b).any():
                        join(a[a != b], b[a != b])
    top = parent.copy()
    while (up := top[top]).tolist() != top.tolist():
        top = up
    linked = np.flatnonzero(top != np.arange(len(points)))
    return linked, top[linked]


def sampled(points: DataFrame, total: int, wanted: int) -> np.ndarray:
    """About `wanted` of the `total` fingerprints, chosen by their hash, ascending."""
    share = max(1, total // wanted)
    taken = points.filter(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).limit(4 * wanted).toArrow()
    return np.unique(taken.column(0).to_numpy().astype("<i8").view("<u8"))


def fitted(total: int, sample) -> list[tuple[int, int]]:
    """The inner nodes of a tree for so many fingerprints; sample(n) gives about n of them."""
    leaves = 1
    while leaves < MOST_SHARDS and total / leaves > SHARD:
        leaves *= 2
    return grow(sample(SAMPLE * leaves), leaves) if leaves > 1 else []


def dealt(points: DataFrame, reach: int) -> DataFrame:
    """(leaf, fp, home): each point in the shard where it lives and in those in which it is queried.

    A shard that holds too much is dealt again by a tree fitted on its own points, until none does or no tree divides it.
    Guests that may come near what lives beyond its boundary are dealt with it, so no pair is lost.
    """
    total = points.count()
    trees = {0: (1, fitted(total, lambda n: sampled(points.select("fp"), total, n)))}  # of a leaf: the number of its first part, and its tree
    now = points.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("home"))
    last, sizes = 0, {0: total}
    for _ in range(8):
        held = {k: (first, nodes) for k, (first, nodes) in trees.items() if nodes}
        if not held:
            return now
        last = max(first + len(nodes) for first, nodes in held.values())

        def send(batches, held=held):
            for b in batches:
                leaf, fp, home = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                out = [[], [], []]
                for k in np.unique(leaf):
                    own = leaf == k
                    if int(k) not in held:
                        parts = leaf[own], fp[own], home[own]
                    else:
                        first, nodes = held[int(k)]
                        which, part, lives = deal(fp[own].astype("<i8").view("<u8"), nodes, reach, home[own].astype(bool))
                        parts = first + part, fp[own][which], lives
                    for x, y in zip(out, parts, strict=True):
                        x.append(y)
                cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(bool))], ["leaf", "fp", "home"])

        now = cut(now.mapInArrow(send, "leaf long, fp long, home boolean"))
        # a row for each shard that is too large, not for each point
        big = [r for r in now.filter("home").groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > OVERSIZE * SHARD).collect() if r.n < 0.9 * sizes.get(r.leaf, 1 << 62)]
        trees, first = {}, last + 1
        for r in big:
            own = now.filter((F.col("leaf") == r.leaf) & F.col("home")).select("fp")
            nodes = fitted(r.n, lambda n, own=own, r=r: sampled(own, r.n, n))
            trees[r.leaf] = first, nodes
            sizes |= {first + k: r.n for k in range(len(nodes) + 1)}  # what doesn't become smaller isn't dealt again
            first += len(nodes) + 1
    return now


def links(points: DataFrame, reach: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that span the components of all pairs at most `reach` bits apart.

    Samples shape shards, not results.
    """

    def search(t: pa.Table) -> pa.Table:
        got = t.column("fp").to_numpy().astype("<i8").view("<u8")
        order = np.argsort(got, kind="stable")
        home = t.column("home").to_numpy(zero_copy_only=False)[order].astype(bool)
        got = got[order]
        a, b = spanning(got, home, reach)
        return pa.table({"a": pa.array(got[a].view("<i8"), pa.int64()), "b": pa.array(got[b].view("<i8"), pa.int64())})

    return dealt(points, reach).groupBy("leaf").applyInArrow(search, "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has a link, root being the least node of its component.

    Rounds of large-star and small-star: each node's greater neighbours are linked to its least one, then each node's
    lesser ones, until all links are stars, which links that are stars already pass without a round. Every round is read
    back from the shared folder. Stars of a hot centre are summed up before the shuffle, because only the least neighbour of
    a node is gathered; they are joined by a second hash as well, so both sides are dealt for the join itself and adaptive
    execution may split a hot centre's partition.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while True:
        # both ends of a link by one pass over it, as a union would read the links twice
        ends = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        # in a star a lesser end has no link of its own to a lesser one, and a greater end has one
        lesser = F.count_if(F.col("b") < F.col("a"))
        if ends.groupBy("a").agg(lesser.alias("low"), F.count("*").alias("n")).filter("low > 0 and n > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = ends.withColumn("g", F.hash("a"))
        least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.hash("a").alias("g"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, ["a", "g"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct().withColumn("g", F.hash("a"))
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumn("g", F.hash("a"))
        # a node's own link takes the row of its least neighbour, which needs none
        small = large.join(low, ["a", "g"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k_text, fp (signed long), root (a fingerprint that names the component) and component_id, the least doc_id that links reach, for every row.

    Null and empty texts have fingerprint 0 and are linked like others. Rows with equal doc_id each keep a row. A null
    doc_id takes part, but names a component only if no other row does.
    """
    rows = cut(fingerprints(docs, shingle, doc_id, text).drop("bands"))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = contract(links(points, reach))
    grouped = points.join(found, points.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(low, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "k_text", "fp", "root", "component_id")


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b, n) of nodes whose texts' shingle sets have a Jaccard similarity of `least` or more, as (a, b).

    n, the comparisons that `a` takes part in, is used to deal them: a text with many goes to many tasks, each with its copy.
    """

    def run(batches):
        last, kept = None, None
        for batch in batches:
            same = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, kept = a, np.unique(shingle_hashes(one, shingle))
                other = np.unique(shingle_hashes(two, shingle))
                common = len(np.intersect1d(kept, other, assume_unique=True))
                same.append(common >= least * (len(kept) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    dealt = pairs.withColumn("part", F.pmod(F.hash("b"), F.ceil(F.col("n") / HEAP).cast("int"))).drop("n")
    ones = dealt.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b").join(ones, ["a", "part"])
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def components(points: DataFrame, docs: DataFrame, near: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, root) of points that are linked: by `near` (a, b), or as their texts share a band and are similar.

    points: node, the hash of a text, first.doc_id of a row that has it, and bands. In each bucket of equal bands the least point is compared with all others,
    not each with each. What is connected by then needs no further comparison. In a bucket that still holds several
    components, points outside its largest one are compared with those of other components: one of each component, then
    four, sixteen, until all had their turn. So each pair of a bucket is compared or connected.
    """
    spark = points.sparkSession
    keyed = points.select("node", F.posexplode("bands").alias("band", "v")).select("node", F.xxhash64("band", "v").alias("key")).withColumn("g", F.hash("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a")).filter("n > 1").withColumn("g", F.hash("key"))
    members = cut(keyed.join(often, ["key", "g"]).select("key", "g", "node", "a", "n"))
    path = fresh_dir(spark, "texts")
    # of copies of a text only the first row's is moved
    wanted = points.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("f_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_text"), F.col("text").cast("string").alias("text"))
    rows.join(wanted, rows.k_id.eqNullSafe(wanted.f_id) & (rows.k_text == wanted.node)).select("node", "text").dropDuplicates(["node"]).write.parquet(path)
    texts = spark.read.parquet(path)

    def linked(pairs: DataFrame) -> DataFrame:
        each = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy("a", "b").agg(F.max("n").alias("n"))
        return alike(each, texts, shingle, least)

    found = near.union(linked(members.filter("node != a").select("a", F.col("node").alias("b"), "n")))
    members, share = members.select("key", "g", "node", (F.col("node") == F.col("a")).alias("tried")), 1
    while True:
        roots = contract(found)
        now = cut(members.join(roots, "node", "left").select("key", "g", "node", "tried", F.coalesce("root", "node").alias("root")))
        held = now.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("k"), F.sum("n").alias("n"))
        still = held.filter("k > 1").select("key", F.hash("key").alias("g"), "main", "n")
        rest = now.filter("not tried").join(still, ["key", "g"]).filter("root != main")
        turn = Window.partitionBy("key", "root").orderBy("node")
        centers = cut(rest.withColumn("i", F.row_number().over(turn)).filter(F.col("i") <= share).select("key", "g", F.col("node").alias("a"), F.col("root").alias("a_root"), "n"))
        if centers.isEmpty():
            drop_dir(spark, path)  # the roots are read back from a store of their own
            return roots
        pairs = now.filter("not tried").join(centers, ["key", "g"]).filter("root != a_root").select("a", F.col("node").alias("b"), "n")
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked(pairs))  # the stars stand for the links before
        done = centers.select("key", "g", F.col("a").alias("node"), F.lit(True).alias("done"))
        members = now.join(done, ["key", "g", "node"], "left").select("key", "g", "node", (F.col("tried") | F.col("done").isNotNull()).alias("tried"))
        share *= 4


def keep_one(docs: DataFrame, shingle: int = 5, reach: int = 3, least: float = SIMILARITY) -> DataFrame:
    """The row with the least doc_id of each component, in its own columns; of rows that share doc_id and text, one.

    Links are fingerprints of five-word shingles within three bits, by the tree, equal ones included, and texts whose sets of
    such shingles have a Jaccard similarity of `least` or more. Texts without a word are one component. Rows without doc_id
    are kept only if no row of their component has one.
    """
    rows = cut(fingerprints(docs, shingle, bands=BANDS))
    points = cut(rows.groupBy(F.col("k_text").alias("node"), "fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.first("bands").alias("bands")))
    ends = cut(points.groupBy("fp").agg(F.min("node").alias("end")))
    equal = points.withColumn("g", F.hash("fp")).join(ends.withColumn("g", F.hash("fp")), ["fp", "g"]).filter("node != end").select(F.col("node").alias("a"), F.col("end").alias("b"))
    ball = links(ends.select("fp"), reach)
    ball = ball.join(ends.withColumnsRenamed({"fp": "a", "end": "x"}), "a").join(ends.withColumnsRenamed({"fp": "b", "end": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(points, docs, equal.union(ball), shingle, least)
    grouped = points.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("first.none", "first.doc_id", F.col("node").alias("k_text")).alias("first"))
    first = grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("f_id"), F.col("first.k_text").alias("f_text"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_text"))
    kept = rows.join(first, rows.k_id.eqNullSafe(first.f_id) & (rows.k_text == first.f_text), "left_semi")
    return kept.dropDuplicates(["k_id", "k_text"]).select("doc.*")
