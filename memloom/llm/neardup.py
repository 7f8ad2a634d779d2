"""Operator 2: near-duplicate documents by SuperMinHash.

A document's set is its distinct shingles of `width` words (64-bit hashes). Every element ranks the signature's slots by a
random permutation of its own and offers slot number j of it the value j plus a fraction, so that the first rounds fill nearly all slots and a
document stops once no later round can lower any. Rounds run over all elements of a chunk at once. BANDS bands of ROWS slots make
the buckets; with 40 bands of 5 rows a pair at a similarity of 0.8 shares none with a probability of 1.3e-7.

Equal sets are one representative from the start. Links are confirmed on full sets. Buckets are never expanded into pairs:
each offers pairs with its first member, then pairs of members that are still apart with pivots, and only what is still
apart after these is compared member by member, part by part of a bucket, by a bitmap that no link fails: no link between components is lost, and only
pairs that are links, or all but, leave a bucket. Groups grow by union of links, stars around the smallest id that are contracted until nothing changes.

Hot sets and hot partners are spread: what holds over 1/SHARE of a join's rows (so at most SHARE keys, whatever the input) is broadcast, or
dealt over as many parts as it has shares. A very long text is taken ELEMENTS shingles at a time; its set alone, 8 bytes a shingle, is held whole.
Equal sets are told by two independent 64-bit sums of hashes of their elements and by their size: two of n different sets are taken for one with a probability below
n * n / 2^128.

Null and empty texts, and texts without words, have an empty set and link with nothing. Equal similarities (ties) link like others. Columns beside doc_id and text are left out, but for drop_duplicates(), which keeps all. Rows of one doc_id are one document if
their sets are equal, and otherwise linked by their id. Rows without an id stand alone and have no component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.base import Words, chunks, mix, release, runs, table, written

BANDS, ROWS = 40, 5
#: Rounds of pivots before members are compared one by one.
PIVOTS = 1
#: 64-bit words of a document's bitmap.
WORDS = 32
#: Links that one task joins by union-find at most.
TASK_LINKS = 1_000_000
#: Keys with more than 1/SHARE of the rows are hot; there are fewer than SHARE of them.
SHARE = 1000
#: Members of a bucket in a part, and of a part that are compared at once.
MEMBERS, STEP = 4096, 512
#: Elements whose ranks are drawn at once, and rows whose bitmaps are made at once.
ELEMENTS, BITMAPS = 1 << 16, 1 << 10
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLD) & (1 << 64) - 1)


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows in turn, in order in each row, and each row's first (one more at the end)."""
    words = Words(buf, off, lower=True)
    row = words.row()
    h = runs(words.hash, width)
    inside = np.flatnonzero(row[: len(h)] == row[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    owner, h = row[inside], h[inside]
    counts = words.counts()
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):  # the whole sequence as one
        whole = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            live = counts[few] > k
            whole[live] = mix(whole[live] * _GOLD + words.hash[words.first[few[live]] + k] + np.uint64(k + 1))
        owner, h = np.concatenate((owner, few)), np.concatenate((h, whole))
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[keep], h[keep]
    return h, np.searchsorted(owner, np.arange(len(off)))


def superminhash(h: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of rows of distinct hashes; an empty row's is all infinite. Elements come ELEMENTS at a time and lower what those before them have left."""
    rows = len(first) - 1
    signature = np.full((rows, slots), np.inf)
    owner = np.repeat(np.arange(rows), np.diff(first))
    for a in range(0, len(h), ELEMENTS):
        part = owner[a : a + ELEMENTS]
        low, high = int(part[0]), int(part[-1]) + 1
        _lower(signature[low:high], h[a : a + ELEMENTS], part - low)
    return signature


def _lower(signature: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Lowers the signatures of rows by further elements, round by round, until no later round can."""
    slots, flat_signature = signature.shape[1], signature.reshape(-1)
    order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), slots)).copy()
    place = np.arange(len(h))
    for j in range(slots):
        draw = mix(h + _times(j + 1))
        pick = j + ((draw >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
        slot = order[place, pick]
        order[place, pick] = order[place, j]
        np.minimum.at(flat_signature, owner * slots + slot, j + (draw & np.uint64((1 << 40) - 1)).astype(np.float64) / float(1 << 40))
        if j + 1 < slots:
            open_rows = (signature.max(1) > j + 1) if j < 8 or j % 8 == 0 else open_rows
            live = open_rows[owner]
            if not live.all():
                h, owner, place = h[live], owner[live], place[live]
            if not len(h):
                break


def bands_of(signature: np.ndarray, bands: int, per: int) -> np.ndarray:
    """A 64-bit key of each band; bands have keys of their own."""
    values = signature.view(np.uint64).reshape(len(signature), bands, per)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, values.shape[:2]).copy()
    for k in range(per):
        key = mix(key + values[:, :, k])
    return key.view(np.int64)


def signatures(df: DataFrame, width: int, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and the keys of its bands (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch):
                h, first = shingles(buf, off, width)
                n = np.diff(first)
                full = n > 0
                prints = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                if len(h):
                    for k in range(2):
                        prints[k][full] = np.add.reduceat(mix(h ^ _times(k + 7)), first[:-1][full])
                keys = bands_of(superminhash(h, first, bands * per)[full], bands, per).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full))) * bands, pa.int32()), pa.array(keys, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in prints), lists], ["doc_id", "n", "p1", "p2", "keys"])
        release()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, p1 long, p2 long, keys array<long>")


def sets(df: DataFrame, width: int) -> DataFrame:
    """doc_id, its set as hashes in order, and the parities of its hashes in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch):
                h, first = shingles(buf, off, width)
                rows, counts = len(first) - 1, np.diff(first)
                bits = []
                for a in range(0, rows, BITMAPS):
                    size = counts[a : a + BITMAPS]
                    own = h[first[a] : first[a] + int(size.sum())]
                    parity = np.bincount(np.repeat(np.arange(len(size)), size) * (64 * WORDS) + (own >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=len(size) * 64 * WORDS) & 1
                    bits.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                bits = np.concatenate(bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * WORDS, pa.int32()), pa.array(bits))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64))), lists], ["doc_id", "items", "bits"])
        release()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, items array<long>, bits array<long>")


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node each leads to."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:  # roots of roots
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        u, v = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        node, root = joined(u, v)
        for at in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + (1 << 16)]), pa.array(root[at : at + (1 << 16)])], ["u", "v"])


def met(rows: DataFrame, facts: DataFrame, key: str, busy: DataFrame | None) -> DataFrame:
    """The rows joined with the one fact of their key. Facts of busy keys (fewer than SHARE; None: there are none) are broadcast, so that no task gets a hot key's rows."""
    if busy is None:
        return rows.join(facts, key)
    busy = F.broadcast(busy.select(key))
    return rows.join(F.broadcast(facts.join(busy, key, "left_semi")), key).unionByName(rows.join(busy, key, "left_anti").join(facts, key))


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """node and the smallest node that links (a, b) lead to, for the nodes of links.

    Union-find joins up to `task_links` links in a task. If there are more, what the tasks have found are stars that overlap: they
    are contracted around their smallest nodes until nothing changes.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    tasks = -(-edges.count() // task_links)
    forest = edges.coalesce(max(1, tasks)).mapInArrow(_union, "u long, v long")
    if tasks > 1:
        edges, seen = written(forest.where("u > v").distinct(), "links"), None
        while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen:
            seen = now
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = written(met(both, least, "u", hot(both, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = met(large, least, "u", hot(large, "u")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        forest = edges
    return written(forest.where("u > v").select(F.col("u").alias("node"), F.col("v").alias("component")), "components")


def hot(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, parts) of keys that hold more than 1/SHARE of the rows, with the shares that each holds: fewer than SHARE rows, so that a broadcast is bounded."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return rows.groupBy(*keys).agg(F.count("*").alias("held")).crossJoin(total).where(F.col("held") * SHARE > F.col("total")).select(*keys, F.ceil(F.col("held") * SHARE / F.col("total")).cast("int").alias("parts"))


def confirmed(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. A partner of very many is dealt over several parts, each with a copy of its set."""
    kept = items.select("doc_id", "items")
    busy = F.broadcast(hot(pairs, "a").withColumnRenamed("a", "hot"))  # fewer than SHARE rows
    dealt = pairs.join(busy, F.col("a") == F.col("hot"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("part"))
    copies = kept.join(busy, F.col("doc_id") == F.col("hot"), "left").select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long"))).alias("part"))
    joined = dealt.join(kept.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b").join(copies, ["a", "part"])
    both = F.size(F.array_intersect("items_a", "items_b"))
    return joined.withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("items_a") + F.size("items_b") - F.col("both"))).select("a", "b")


def _near(key: tuple, rows: pa.Table, percent: int) -> pa.Table:
    """The pairs of one cell that may be links: of different components, alike enough in size and bitmap, and of no earlier bucket."""
    bucket, low, high = (k.as_py() for k in key)
    doc, n, component, part = (rows[c].to_numpy() for c in ("doc_id", "n", "component", "part"))
    bits, keys = (rows[c].combine_chunks().flatten().to_numpy().reshape(len(doc), -1) for c in ("bits", "keys"))
    left, right, found = np.flatnonzero(part == low), np.flatnonzero(part == high), []
    for a in range(0, len(left), STEP):
        x = left[a : a + STEP]
        for b in range(0, len(right), STEP):
            y = right[b : b + STEP]
            # A bit counts the shingles of its hash modulo 2: where two documents' bits differ, so do at least as many shingles.
            differ = np.zeros((len(x), len(y)), np.uint16)
            for k in range(bits.shape[1]):
                differ += np.bitwise_count((bits[x, k][:, None] ^ bits[y, k]).view(np.uint64))
            small, large = np.minimum(n[x][:, None], n[y]), np.maximum(n[x][:, None], n[y])
            fits = (component[x][:, None] != component[y]) & (100 * small >= percent * large) & ((100 + percent) * differ.astype(np.int64) <= (100 - percent) * (small + large))
            i, j = np.nonzero(fits)
            i, j = x[i], y[j]
            once = keys[i] == keys[j]  # bands have keys of their own: a pair counts in the first bucket that it shares
            mine = keys[i, once.argmax(1)] == bucket if len(i) else np.zeros(0, bool)
            found.append((np.minimum(doc[i], doc[j])[mine], np.maximum(doc[i], doc[j])[mine]))
    pairs = np.unique(np.concatenate([np.stack(f) for f in found], 1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def close(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (key, doc_id, n, component, keys, bits) of buckets that may be links. A bucket is cut into parts of about MEMBERS, and each two of them are a cell: a task holds two parts, whatever the bucket's size."""
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = members.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    cells = each.select("key", "low", "high", "part", "doc_id", "n", "component", "keys", "bits")
    return cells.groupBy("key", "low", "high").applyInArrow(lambda key, rows: _near(key, rows, percent), "a long, b long")


def near_duplicates(df: DataFrame, width: int, percent: int = 80, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of documents (doc_id, text), which may have further columns: a row for each row."""
    rows = df.select("doc_id", "text")
    marked = written(signatures(rows, width, bands, per), "signatures")
    full = marked.where("n > 0 and doc_id is not null")
    first = written(full.groupBy("p1", "p2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("r"), F.count("*").alias("copies")).select("p1", "p2", "n", "copies", F.col("r.doc_id").alias("doc_id"), F.col("r.keys").alias("keys")), "sets")
    placed = first.select("doc_id", "n", F.explode("keys").alias("key"))
    leads = written(placed.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count("*").alias("held")).where("lead < last").drop("last"), "leads")
    busy = leads.where(F.col("held") * SHARE > bands * first.count()).select("key")
    busy = None if busy.isEmpty() else busy
    buckets = written(met(placed, leads.drop("held"), "key", busy), "buckets")
    candidates = buckets.select("doc_id").distinct()
    items = sets(rows.join(candidates, "doc_id", "left_semi"), width)
    repeated = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    items = written(items.distinct() if repeated else items, "items")

    sized = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    sizes = buckets.where("doc_id = lead").select("key", F.col("n").alias("lead_n"))
    pairs = met(buckets.where("doc_id > lead"), sizes, "key", busy).where(sized(F.col("n"), F.col("lead_n"))).select(*ends(F.col("lead"), F.col("doc_id"))).distinct()
    groups = components(confirmed(written(pairs, "pairs"), items, percent))
    for turn in range(PIVOTS + 1):
        known = buckets.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct(F.xxhash64("key", "doc_id", F.lit(turn)).alias("draw"), "doc_id", "n", "component")).alias("pivot")).where("lo < hi").select("key", "pivot")
        apart = written(met(known.select("key", "doc_id", "n", "component"), mixed, "key", busy), "apart")
        if apart.isEmpty():
            break
        if turn < PIVOTS:
            found = apart.where((F.col("component") != F.col("pivot.component")) & sized(F.col("n"), F.col("pivot.n")))
            pairs = found.select(*ends(F.col("doc_id"), F.col("pivot.doc_id"))).distinct()
        else:
            pairs = written(close(apart.select("key", "doc_id", "n", "component").join(first.select("doc_id", "keys"), "doc_id").join(items.select("doc_id", "bits"), "doc_id"), percent).distinct(), "pairs")
        links = confirmed(written(pairs, "pairs"), items, percent)
        star = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
        groups = components(star.unionByName(links))
    if repeated:  # rows of one id but different texts are linked by it
        copies = full.join(first.select("p1", "p2", F.col("doc_id").alias("rep")), ["p1", "p2"]).where("doc_id <> rep").join(first.select("doc_id"), "doc_id", "left_semi")
        groups = components(groups.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    reps = first.select("p1", "p2", "copies", F.col("doc_id").alias("node")).join(groups, "node", "left").select("p1", "p2", "copies", F.coalesce("component", "node").alias("component_id"))
    reps = written(reps, "reps")
    # Sets of very many copies are few and broadcast; the others' copies are dealt by their sets; rows without a set or an id meet nowhere.
    many = F.col("copies") * SHARE > full.count()
    common = F.broadcast(reps.where(many).select("p1", "p2", F.col("component_id").alias("common")))  # fewer than SHARE rows
    found = full.join(common, ["p1", "p2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("common").alias("component_id"))
    rest = full.join(common, ["p1", "p2"], "left_anti").join(reps.where(~many).drop("copies"), ["p1", "p2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = marked.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).unionByName(alone)


def drop_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that of the smallest id, with all its columns; of rows of one id, one of the smallest text."""
    found = written(near_duplicates(df, width, percent), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = df.join(gone, "doc_id", "left_anti")
    twice = not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not twice:
        return kept
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*kept.columns), "text").alias("row")).select("row.*")
    return one.unionByName(kept.where("doc_id is null"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
