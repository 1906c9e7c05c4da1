"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass over the texts hashes each document's set of word shingles, names the set by a 64-bit hash of its elements
   (its node: equal sets are one node from then on) and sketches it. In SuperMinHash an element takes ranks 0, 1, 2, ...
   at the positions of its own permutation, so the values of one element are correlated over the signature; that lowers
   the variance, and rank j need not be looked at once every position holds a value below j.
2. Nodes that agree on a band of the signature are candidates. A bucket is not expanded into pairs: its members are
   compared with a pivot. Members that end in other components than their bucket's pivot take further pivots. What is
   still apart after that meets the rest of its buckets in families, where only the differences from the family's common
   shingles are compared (by_difference), so no candidate link between components is lost. Buckets of one node, which
   are nearly all of them, go before anything else is dealt by band.
3. Candidates whose sketches agree far too little are dropped; the others are confirmed on the full sets.
4. Links are grouped by union-find within partitions and star contraction across them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_slices, written

#: Values of a signature, and the probability that a pair at the threshold may miss every band.
M, MISS = 256, 1.3e-7
#: Standard deviations of the share of agreeing positions below which no pair at the threshold falls (about 1e-10).
SIGMAS = 6.4
#: Pivots of a bucket, words that a task remembers, links that union-find holds at once.
PIVOTS, REMEMBERED, HELD = 2, 100_000, 1_000_000
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; `seen` is a task's memory of about REMEMBERED of them."""
    new = set(words).difference(seen)
    if new:
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = set(words)
        seen.update((w, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")) for w in new)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `size` words; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, k = word_hashes(words, seen), min(size, len(words))
    out = mix(h[: len(h) - k + 1] + np.uint64(k))
    for j in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of M values (rank in the upper 16 bits) for each non-empty set."""
    sig = np.full((len(sets), M), MASK)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    start, stride = element & np.uint64(M - 1), (element >> np.uint64(8)) % np.uint64(M // 2) * np.uint64(2) + np.uint64(1)
    flat = sig.reshape(-1)
    for rank in range(M):
        j = np.uint64(rank)
        at = owner * M + ((start + stride * j) & np.uint64(M - 1)).astype(np.int64)
        np.minimum.at(flat, at, j << np.uint64(48) | mix(element + np.uint64(rank * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(16))
        live = sig.max(1) >= (j + np.uint64(1)) << np.uint64(48)  # some position may still take a higher rank
        if not live.any():
            break
        keep = live[owner]
        if not keep.all():
            element, owner, start, stride = element[keep], owner[keep], start[keep], stride[keep]
    return sig


def layout(percent: int) -> tuple[int, int]:
    """Bands and values in a band: the longest bands of which a pair at the threshold misses all with MISS at most."""
    for rows in range(12, 0, -1):
        miss = 1 - (percent / 100) ** rows
        bands = 1 if not miss else math.ceil(math.log(MISS) / math.log(miss))
        if bands * rows <= M:
            return bands, rows
    raise ValueError(f"no bands of {M} values find pairs at {percent} percent")


def slack(percent: int) -> float:
    """How far below the threshold the share of agreeing positions may fall."""
    return SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / M)


def bands_of(sig: np.ndarray, percent: int) -> np.ndarray:
    bands, rows = layout(percent)
    own = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), own.shape[:2])
    for r in range(rows):
        out = mix(out + own[:, :, r]) * np.uint64(0xD1342543DE82EF95)
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int, percent: int = 80) -> DataFrame:
    def run(seen, doc_id, text):
        sets = [shingle_set(t, size, seen) for t in text]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = super_minhash([sets[i] for i in full]) if full else np.empty((0, M), np.uint64)
        bands, sketch = bands_of(sig, percent), mix(sig).astype(np.uint8)
        place = dict(zip(full, range(len(full)), strict=True))
        return {
            "doc_id": doc_id,
            "n": [len(s) for s in sets],
            "node": [node_of(s) if len(s) else None for s in sets],
            "bands": [bands[place[i]] if i in place else None for i in range(len(sets))],
            "sketch": [sketch[place[i]].tobytes() if i in place else None for i in range(len(sets))],
        }

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n long, node long, bands array<long>, sketch binary", once=dict)


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) for every node of wanted, made anew from the texts; shingles are sorted as unsigned numbers."""

    def run(seen, text):
        sets = [shingle_set(t, size, seen) for t in text]
        return {"node": [node_of(s) if len(s) else None for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    ids = written(nodes.join(wanted, "node").select("doc_id").distinct(), "wanted")
    texts = join_small(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").select("text")
    sets = map_slices(texts, run, "node long, shingles array<long>", once=dict).filter("node IS NOT NULL")
    return written(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def union_find(links: DataFrame) -> DataFrame:
    """Links of each partition, reduced to a star around the least node of every group in it."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars():
            rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
            for at in range(0, len(rows), 65_536):
                v, u = zip(*rows[at : at + 65_536], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["v", "u"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:  # what is linked across such slices meets again in the contraction
                yield from stars()
                parent.clear()
        yield from stars()

    return links.mapInArrow(run, "v long, u long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (x, y): the least node of its connected component."""
    stars = written(union_find(links.select("x", "y")), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        stars = written(small.select("e.v", "e.u").filter("v <> u").distinct(), "stars")
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    centre = stars.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(centre)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (x, y) among candidate pairs: sketches first, then the full sets, made anew from the texts."""

    def near(x, y, a, b):
        same = (np.frombuffer(b"".join(a), np.uint8) == np.frombuffer(b"".join(b), np.uint8)).reshape(-1, M).mean(1)
        ok = np.flatnonzero(same >= percent / 100 - slack(percent))
        return {"x": [x[i] for i in ok], "y": [y[i] for i in ok]}

    sketch = lambda c, s: nodes.select(F.col("node").alias(c), F.col("sketch").alias(s))
    maybe = written(map_slices(pairs.join(sketch("x", "a"), "x").join(sketch("y", "b"), "y").select("x", "y", "a", "b"), near, "x long, y long", 4096), "maybe")
    sets = sets_of(maybe.select(F.explode(F.array("x", "y")).alias("node")).distinct(), nodes, docs, size)
    own = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
    shared = F.size(F.array_intersect("a", "b"))
    linked = maybe.join(own("x", "a"), "x").join(own("y", "b"), "y").filter((100 + percent) * shared >= percent * (F.size("a") + F.size("b")))
    return linked.select("x", "y")


def by_difference(rows: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates (x, y, nx, ny) among rows (band, node, n, comp, first, main) that share a band and no component.

    Nodes are dealt into families so that two nodes of a bucket share one if either is apart from the bucket's pivot. A
    set x differs from its family's common shingles (those of more than half of its members) in a set d(x). With
    s(x) = (100 + percent) |d(x)| - (100 - percent) |x|, sets are similar enough just when 2 (100 + percent) times the
    size of the overlap of d(x) and d(y) is at least s(x) + s(y). So

    - pairs whose s add up to at most 0 need no overlap; each of the two is also linked with the member of least s, and
      that star stands for all of them;
    - any other pair shares one of the rarest elements of both differences (prefix filter: all but so many elements as
      the least possible overlap needs, less one). Differences seldom agree, even where thousands of sets are alike.
    """
    both = 2 * (100 + percent)
    apart = rows.filter("comp <> main AND node <> first")
    owner = apart.groupBy("node").agg(F.min(F.struct(F.xxhash64("first", F.lit(0)).alias("o"), "first")).alias("r"))
    refs = apart.join(owner, "node").select("band", F.col("r.first").alias("ref")).distinct()
    members = rows.filter("node <> first").select("band", "node", "n", "comp").join(refs, "band").select("ref", "node", "n", "comp").distinct()
    members = written(members, "families")
    mixed = members.groupBy("ref").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("ref", "size")
    members = written(join_small(members, written(mixed, "mixed"), "ref", "inner"), "members")
    own = members.join(sets_of(members.select("node").distinct(), nodes, docs, size), "node")
    common = own.select("ref", "size", F.explode("shingles").alias("e")).groupBy("ref", "size", "e").agg(F.count(F.lit(1)).alias("c")).filter("2 * c > size")
    # at most twice the mean size of the sets; stored, so that the join below has plain sides and Spark can split a large family
    common = written(common.groupBy("ref").agg(F.collect_list("e").alias("common")), "common")
    diff = F.concat(F.array_except("shingles", "common"), F.array_except("common", "shingles"))
    apiece = own.join(common, "ref", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    apiece = apiece.select("ref", "node", "n", "comp", diff.alias("d"))
    apiece = written(apiece.withColumn("s", (100 + percent) * F.size("d") - (100 - percent) * F.col("n")), "differences")
    least = written(apiece.groupBy("ref").agg(F.min(F.struct("s", "node", "n", "comp")).alias("m")), "least")
    told = join_small(apiece, least, "ref", "inner").withColumn("star", F.col("s") + F.col("m.s") <= 0)
    star = told.filter("star AND comp <> m.comp").select(F.col("node").alias("x"), F.col("m.node").alias("y"), F.col("n").alias("nx"), F.col("m.n").alias("ny"))
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("m.s")) / both)).cast("int")
    each = told.select("ref", "node", "n", "comp", "s", "star", need.alias("need"), F.explode("d").alias("e"))
    often = each.groupBy("ref", "e").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = each.join(often, ["ref", "e"]).groupBy("ref", "node", "n", "comp", "s", "star", "need").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("d"))
    shared = shared.filter("size(d) >= need").withColumn("most", F.size("d"))  # other elements have no partner
    prefix = written(shared.select("ref", "node", "n", "comp", "s", "star", "most", F.posexplode(F.expr("slice(d, 1, most - need + 1).e")).alias("pos", "e")), "prefixes")
    x, y = (prefix.select("ref", "e", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "comp", "s", "star", "most", "pos"))) for k in "xy")
    met = x.join(y, ["ref", "e"]).filter("node_x < node_y AND comp_x <> comp_y AND NOT (star_x AND star_y)")
    rest = F.least(F.col("most_x") - F.col("pos_x"), F.col("most_y") - F.col("pos_y"))  # at the first element in common, the overlap at most
    met = met.filter(both * rest >= F.col("s_x") + F.col("s_y"))
    met = met.groupBy(F.col("node_x").alias("x"), F.col("node_y").alias("y")).agg(F.min("ref").alias("ref"))
    x, y = (apiece.select("ref", F.col("node").alias(k), *(F.col(c).alias(f"{c}{k}") for c in "nsd")) for k in "xy")
    overlap = F.size(F.array_intersect("dx", "dy"))
    near = written(met, "met").join(x, ["ref", "x"]).join(y, ["ref", "y"]).filter(both * overlap >= F.col("sx") + F.col("sy"))
    return star.unionByName(near.select("x", "y", "nx", "ny"))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """band, node and n of all buckets that hold two nodes or more."""
    rows = nodes.select(F.explode("bands").alias("band"), "node", "n")
    several = written(nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("band"), "several")
    return written(join_small(rows, several, "band", "left_semi"), "buckets")


def pivots_of(rows: DataFrame, order: int) -> DataFrame:
    """A node of each bucket, chosen by a hash: band, y, ny, cy."""
    p = F.min(F.struct(F.xxhash64("node", F.lit(order)).alias("o"), "node", "n", "comp"))
    return rows.groupBy("band").agg(p.alias("p")).select("band", F.col("p.node").alias("y"), F.col("p.n").alias("ny"), F.col("p.comp").alias("cy"))


def link(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(node, comp) of all nodes with a link; None where nothing is linked.

    The first turn holds every bucket against its first pivot; each later one takes what is still apart from it.
    """
    close = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    buckets = shared_bands(nodes)
    labels = firsts = None
    for turn in range(PIVOTS + 1):
        if labels is None:
            rows = buckets.withColumn("comp", F.col("node"))
        else:
            rows = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if firsts is None:
            firsts = written(pivots_of(rows, 0), "pivots")
            pivots = firsts
        else:  # buckets that still hold several components; what is apart from the first pivot's
            rows = written(rows, "labelled")
            mixed = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi AND size > 2").select("band")
            owner = firsts.select("band", F.col("y").alias("node")).join(mixed, "band").join(rows.select("band", "node", "comp"), ["band", "node"])
            owner = written(owner.select("band", F.col("node").alias("first"), F.col("comp").alias("main")), "mixed")
            rows = written(join_small(rows, owner, "band", "inner"), "apart")
            pivots = written(pivots_of(rows.filter("comp <> main"), turn), "pivots")
        if turn == PIVOTS:
            pairs = by_difference(rows, nodes, docs, size, percent)
        else:
            members = rows.filter("node <> first") if turn else rows  # the first pivot has met all of its bucket
            members = members.select("band", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
            pairs = join_small(members, pivots, "band", "inner").filter("cx <> cy")
        pairs = written(pairs.filter(close).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
        if not pairs.limit(1).count():
            continue
        new = written(confirmed(pairs, nodes, docs, size, percent), "confirmed")
        if new.limit(1).count():
            known = new if labels is None else new.unionByName(labels.filter("node <> comp").select(F.col("node").alias("x"), F.col("comp").alias("y")))
            labels = written(components(known), "labels")
    return labels


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    A document's set are its distinct shingles of `size` words (ASCII lower case); documents are linked if their sets'
    Jaccard similarity is at least percent / 100. component_id is the least doc_id that links reach. Null or empty
    texts, and texts without words, have no shingles and are linked with nothing. Equal texts are always linked; rows
    that repeat a doc_id get equal results for equal texts. Rows without a doc_id are their own component (null) and
    kept. Sets count as equal if their 64-bit hashes are. Very long texts are compared whole. Other columns are ignored; an
    empty table gives no rows.

    A pair at exactly the threshold misses every band with a probability of at most MISS, and the sketch filter with one
    of about 1e-10. At 80 percent a signature has 40 bands of 5 values; below about 25 percent no bands reach that (an
    error).
    """
    features = written(signatures(docs, size, percent), "signatures")
    named = features.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = written(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    labels = link(nodes, docs, size, percent)
    least = nodes.select("node", "doc_id")
    if labels is not None:
        joined = written(least.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
        roots = written(joined.groupBy("comp").agg(F.min("doc_id").alias("component")), "roots")
        least = join_small(joined, roots, "comp", "inner").select("node", F.col("component").alias("doc_id"))
    own = features.select("doc_id", "n", "node")
    out = own.filter("node IS NOT NULL").join(least.withColumnRenamed("doc_id", "component"), "node", "left")
    out = out.unionByName(own.filter("node IS NULL").withColumn("component", F.lit(None).cast("long")))  # no key to meet in
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, in all their columns, without those that another document of their group stands for.

    A doc_id goes if none of its rows is kept. Of rows with equal doc_id and text one stays. Null and empty texts, and
    rows without a doc_id, stay; texts are compared whole; an empty table gives an empty one.
    """
    each = groups(docs, size, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    known = written(each.filter("NOT kept OR n > 1"), "known")
    gone, twice = known.filter("NOT kept").select("doc_id"), known.filter("kept").select("doc_id")
    out = join_small(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    if not twice.limit(1).count():
        return out
    again = join_small(out, twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return join_small(out, twice, "doc_id", "left_anti").unionByName(again).select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END g FROM w),
c AS (SELECT doc_id, len(g) n, CASE WHEN len(g) > 0 THEN list_aggregate(list_sort(g), 'string_agg', chr(10)) END k FROM d),
u AS (SELECT k, min(doc_id) id, min(n) n FROM c WHERE k IS NOT NULL GROUP BY k),
s AS (SELECT u.id, u.n, unnest(d.g) g FROM u JOIN d ON d.doc_id = u.id),
e AS (SELECT a.id x, b.id y FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, reach) AS (SELECT id, id FROM u UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT id, min(reach) component_id FROM r GROUP BY id)
SELECT c.doc_id, CAST(c.n AS BIGINT) n_shingles, coalesce(m.component_id, c.doc_id) component_id, c.doc_id = coalesce(m.component_id, c.doc_id) kept
FROM c LEFT JOIN u ON u.k = c.k LEFT JOIN m ON m.id = u.id
"""
