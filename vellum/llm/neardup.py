"""Near duplicates by MinHash with tensored bands, candidates verified on full shingle sets.

A text has two collections of SIDE keys, each of WIDTH minhashes. Every pair of a key of one and a key of the
other is a table key, so 2 * SIDE * WIDTH minhashes serve SIDE * SIDE tables of 2 * WIDTH minhashes. A pair that
links with similarity s meets in some table with probability (1 - (1 - s ** WIDTH) ** SIDE) ** 2: 0.9997 at 0.85,
0.9985 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, fits, fresh, map_arrow, record, small_join
from vellum.llm.words import mixed, word_hashes

#: Words of a shingle, and the similarity in percent that links where a caller names no other.
WORDS, PERCENT = 5, 85
SIDE, WIDTH = 10, 3
#: All pairs of a bucket of up to so many different sets are verified; larger ones go by so many pivots, then by a join on prefixes.
SMALL, PIVOTS = 32, 2
#: Sets of a large bucket's key from which its hub is made, about.
SAMPLE = 32

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_A = _random.integers(0, 1 << 64, 2 * SIDE * WIDTH, np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 64, 2 * SIDE * WIDTH, np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted hashes of the distinct runs of WORDS words; of fewer words one for all of them; none of none."""
    n = len(words)
    if not n:
        return words
    width = min(n, WORDS)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mixed(h * _FACTOR + words[k : n - width + 1 + k])
    return np.unique(h)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The shingle set of each text; a null or empty text has none."""
    words, counts = word_hashes(texts)
    return [shingle_set(w) for w in np.split(words, np.cumsum(counts)[:-1])] if len(counts) else []


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, sig, keys) of docs: the text's hash, its set's size and 128-bit hash, and the 2 * SIDE keys."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text"))
            size = np.array([len(s) for s in sets], np.int64)
            full, keys = np.flatnonzero(size), []
            if len(full):
                flat, first = np.concatenate([sets[k] for k in full]), np.cumsum(size[full]) - size[full]
                least = np.stack([np.minimum.reduceat(flat * a + b, first) for a, b in zip(_A, _B, strict=True)])
                for k in range(2 * SIDE):
                    h = np.full(len(full), k, np.uint64)
                    for row in least[k * WIDTH : (k + 1) * WIDTH]:
                        h = mixed(h * _FACTOR + row)
                    keys.append(h)
            table = np.zeros((len(sets), 2 * SIDE), np.int64)
            if len(full):
                table[full] = np.stack(keys, 1).view(np.int64)
            offsets = np.r_[0, np.cumsum((size > 0) * 2 * SIDE)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[full].ravel()))
            return record(SKETCH, doc_id=batch.column("doc_id"), h=batch.column("h"), n_shingles=pa.array(size), sig=[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], keys=lists)

        return f

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), make, SKETCH)


SETS = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("members", T.ArrayType(T.LongType()))])


def full_sets(texts: DataFrame) -> DataFrame:
    """(text, sig) to (sig, members), the set's sorted hashes, where the text has that set."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = zip(batch.column("sig").to_pylist(), shingle_sets(batch.column("text")), strict=True)
            found = [(sig, s) for sig, s in sets if xxhash.xxh3_128_digest(s.tobytes()) == sig]
            return record(SETS, sig=[sig for sig, _ in found], members=pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64())))

        return f

    return map_arrow(texts.select("text", "sig"), make, SETS)


class Linker:
    """The steps from sketches to components; every intermediate table is written to the shared folder."""

    def __init__(self, docs: DataFrame, scratch: Scratch, percent: int = PERCENT):
        self.docs, self.scratch, self.percent, self.tested = docs, scratch, percent, []

    def buckets(self, nodes: DataFrame) -> DataFrame:
        """(bucket, sig, left) for the table keys that a set may share with another; left: the key of the first collection.

        A set's own keys are counted first: only keys that two sets have are paired, so that a set without
        near copies leaves after its 2 * SIDE keys and never makes SIDE * SIDE table keys.
        """
        keys = nodes.select("sig", F.posexplode("keys").alias("place", "key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        sides = [F.collect_list(F.when((F.col("place") < SIDE) == left, F.col("key"))).alias(n) for n, left in (("a", True), ("b", False))]
        mine = keys.join(shared, "key").groupBy("sig").agg(*sides).where((F.size("a") > 0) & (F.size("b") > 0))
        mine = mine.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
        return self.scratch.table(mine.select(F.xxhash64("a", "b").alias("bucket"), "sig", F.col("a").alias("left")), "buckets")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (x, y) of different sets whose similarity on full sets is `percent` or more; a pair is tested once."""
        for before in self.tested:
            pairs = pairs.join(before, ["x", "y"], "left_anti")
        pairs = self.scratch.table(pairs, f"{name}-pairs")
        self.tested.append(pairs)
        size = [self.sizes.select(F.col("sig").alias(side), F.col("n").alias(f"n{side}")) for side in ("x", "y")]
        close = small_join(small_join(pairs, size[0], "x", "inner"), size[1], "y", "inner")
        low, high = F.least("nx", "ny"), F.greatest("nx", "ny")
        close = close.where(100 * low >= self.percent * high).select("x", "y")
        full = [self.sets.select(F.col("sig").alias(side), F.col("members").alias(f"m{side}")) for side in ("x", "y")]
        both = close.join(full[0], "x").join(full[1], "y").withColumn("common", F.size(F.array_intersect("mx", "my")))
        either = F.size("mx") + F.size("my") - F.col("common")
        return self.scratch.table(both.where(100 * F.col("common") >= self.percent * either).select("x", "y"), f"{name}-links")

    def components(self, edges: DataFrame, name: str) -> DataFrame:
        """(sig, label): the least sig that the edges (x, y) reach. Labels jump to their labels' labels in each round."""
        edges = self.scratch.table(edges.union(edges.select("y", "x")).distinct(), f"{name}-edges")
        first = edges.groupBy(F.col("x").alias("sig")).agg(F.least(F.min("y"), F.col("sig")).alias("label"))
        labels, k = self.scratch.table(first, f"{name}-0"), 0
        small = fits(labels)

        def side(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if small else df

        while True:
            k += 1
            there = side(labels)
            near = edges.join(there.select(F.col("sig").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
            low = labels.join(side(near.withColumnRenamed("x", "sig")), "sig").withColumn("low", F.least("label", "near"))
            jump = there.select(F.col("sig").alias("low"), F.col("label").alias("further"))
            new = low.join(jump, "low").select("sig", F.least("low", "further").alias("label"), F.col("label").alias("old"))
            new = self.scratch.table(new, f"{name}-{k}")
            changed = not new.where("label <> old").isEmpty()
            labels = new.drop("old")
            if k > 1:
                self.scratch.drop(f"{name}-{k - 1}")
            if not changed:
                return labels

    def merged(self, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The labels after more links: components of the labels that the links join, of which there are few, carried to the sets."""
        for side in ("x", "y"):
            own = labels.select(F.col("sig").alias(side), F.col("label").alias(f"l{side}"))
            links = small_join(links, own, side).withColumn(side, F.coalesce(f"l{side}", side)).drop(f"l{side}")
        joins = self.scratch.table(links.where("x <> y").distinct(), f"{name}-joins")
        if joins.isEmpty():
            return labels
        root = self.components(joins, name).select(F.col("sig").alias("label"), F.col("label").alias("root"))
        known = labels.select("label").distinct()
        more = small_join(root.select("label"), known, "label", "left_anti").select(F.col("label").alias("sig"), "label")
        out = small_join(labels.unionByName(more), root, "label").select("sig", F.coalesce("root", "label").alias("label"))
        return self.scratch.table(out, f"{name}-labels")

    def in_large_buckets(self, large: DataFrame, labels: DataFrame) -> DataFrame:
        """The labels after all links within the large buckets (bucket, sig, left).

        A set has one row here, with the keys of the first collection that its large buckets have (SIDE at most): sets
        that share such a bucket share one of those. First, PIVOTS times, one set of each key is verified against all
        the others, the one that is in most large buckets, as what the copies were made from is: a group of near copies
        mostly becomes one component, and two sets of one component need no more. The sets of keys that still hold
        several components get a hub, what most of them have in common (`marked`), and meet the set nearest to it. Where several
        components are left, the differences from the hub are listed, and the sets go through those: first each
        meets the nearest one of each difference (`middle_pairs`), then the rest goes through an exact join (`prefix_pairs`).
        """
        crowd = large.groupBy("sig").agg(F.collect_set("left").alias("keys"), F.count("*").alias("degree"))
        crowd = self.scratch.table(crowd, "crowd")
        if crowd.isEmpty():
            return labels
        for k in range(PIVOTS + 1):
            here = small_join(crowd, labels, "sig").withColumn("label", F.coalesce("label", "sig"))
            here = self.scratch.table(here.select(F.explode("keys").alias("key"), "sig", "label", "degree"), f"here-{k}")
            if k == PIVOTS:
                break
            best = F.max_by(F.struct("sig", "label"), F.struct("degree", F.xxhash64("sig"))).alias("p")
            pivot = here.groupBy("key").agg(best).select("key", F.col("p.sig").alias("pivot"), F.col("p.label").alias("theirs"))
            pivot = self.scratch.table(pivot, f"pivot-{k}")
            pairs = small_join(here, pivot, "key", "inner").where("label <> theirs")
            pairs = pairs.select(F.least("sig", "pivot").alias("x"), F.greatest("sig", "pivot").alias("y")).distinct()
            labels = self.merged(labels, self.verify(pairs, f"pivots-{k}"), f"labels-{k}")
            used = pivot.select(F.col("pivot").alias("sig"), F.lit(0).cast("long").alias("spent")).distinct()
            crowd = small_join(crowd, used, "sig").withColumn("degree", F.coalesce("spent", "degree")).drop("spent")
            crowd = self.scratch.table(crowd, f"crowd-{k}")
        several = here.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        rest = self.scratch.table(small_join(here.select("key", "sig"), several, "key", "inner"), "apart")
        if rest.isEmpty():
            return labels
        marks = self.marked(rest)
        labels = self.merged(labels, self.verify(self.middle_pairs(marks, labels, ["hub"]), "hubs"), "labels-hubs")
        listed = self.listed(marks, labels)
        if listed.isEmpty():
            return labels
        labels = self.merged(labels, self.verify(self.middle_pairs(listed, labels, ["hub", "shingle"]), "middles"), "labels-middles")
        return self.merged(labels, self.verify(self.prefix_pairs(marks, listed, labels), "prefixes"), "labels-end")

    def marked(self, rest: DataFrame) -> DataFrame:
        """(hub, sig, n, other, d, f, least) of rest (key, sig), one row for each set.

        Keys that share a set have one hub, so that two sets of a key are always held against the same one: what more than
        half of its sets have in common, taken from about SAMPLE sets of it by their hash. It need not be a set of any row,
        and any hub gives the same links: a set of n shingles differs from it by d, the shingles `other`, and two sets by
        d + d' less twice the differences that they share. They link if they share
        (f + f') / (2 * (100 + percent)) at least, where f = (100 + percent) * d - (100 - percent) * n. `least` is the least f
        of the hub. In copies of one source few shingles are differences, and those that all copies have are none.
        """
        table, up, down = self.scratch.table, 100 + self.percent, 100 - self.percent
        own = table(rest.groupBy("sig").agg(F.sort_array(F.collect_set("key")).alias("keys")), "own-keys")
        ties = own.select(F.explode("keys").alias("x"), F.get("keys", F.lit(0)).alias("y")).distinct()
        hubs = self.components(ties, "hub-keys").select(F.col("sig").alias("key"), F.col("label").alias("hub"))
        named = table(small_join(own.select(F.get("keys", F.lit(0)).alias("key"), "sig"), hubs, "key", "inner").select("hub", "sig"), "hub-sets")
        crowded = table(named.groupBy("hub").agg(F.count("*").alias("crowded")), "hub-sizes")
        some = small_join(named, crowded, "hub", "inner").where(F.shiftrightunsigned(F.xxhash64("sig"), 32) * F.col("crowded") < SAMPLE << 32)
        some = table(some.select("hub", "sig"), "hub-samples")
        taken = some.groupBy("hub").agg(F.count("*").alias("taken"))
        often = some.join(self.sets, "sig").select("hub", F.explode("members").alias("shingle")).groupBy("hub", "shingle").agg(F.count("*").alias("df"))
        common = small_join(often, table(taken, "taken"), "hub", "inner").where(2 * F.col("df") > F.col("taken"))
        common = table(common.groupBy("hub").agg(F.collect_list("shingle").alias("common")), "hubs")
        # hubs without shingles in common are empty
        marks = small_join(named.join(self.sets, "sig"), common, "hub").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
        other = F.concat(F.array_except("members", "common"), F.array_except("common", "members")).alias("other")
        marks = marks.select("hub", "sig", F.size("members").cast("long").alias("n"), other).withColumn("d", F.size("other").cast("long"))
        marks = table(marks.withColumn("f", up * F.col("d") - down * F.col("n")), "differ")
        return small_join(marks, table(marks.groupBy("hub").agg(F.min("f").alias("least")), "least"), "hub")

    def listed(self, marks: DataFrame, labels: DataFrame) -> DataFrame:
        """(hub, sig, d, f, left, shingle): the differences that a link may still rest on, of hubs whose sets have several labels.

        The rarest of the hub come first: `left` counts those from it on. A set's partners have the least f of the hub at
        least; if the set has the label of the hub's middle, they have another, and so an f of more than the middle's
        with the sign turned, or they would be linked with it. Of those differences that other sets have too,
        the set lists so many that any partner shares one of them.
        """
        up, down = 100 + self.percent, 100 - self.percent
        rows = self.labelled(marks, labels)
        middle = F.min_by("label", F.struct("f", F.xxhash64("sig"))).alias("middle")
        apart = rows.groupBy("hub").agg(middle, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("hub", "middle")
        rows = small_join(rows, self.scratch.table(apart, "hubs-apart"), "hub", "inner")
        fewest = F.when(F.col("label") == F.col("middle"), F.greatest("least", 1 - F.col("least"))).otherwise(F.col("least"))
        rows = rows.withColumn("fewest", F.greatest(fewest, F.col("f") - 1 - F.expr(f"{200 * down} * n div {self.percent}")))
        rows = self.scratch.table(rows.where(2 * up * F.col("d") >= F.col("f") + F.col("fewest")).select("hub", "sig", "d", "f", "fewest", "other"), "differing")
        each = rows.select("hub", "sig", "d", "f", "fewest", F.explode("other").alias("shingle"))
        often = each.groupBy("hub", "shingle").agg(F.count("*").alias("df")).where("df > 1")
        shared = each.join(often, ["hub", "shingle"]).groupBy("hub", "sig", "d", "f", "fewest").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ordered"))
        needed = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("fewest")) / (2 * up)))
        shared = shared.withColumn("length", (F.size("ordered") - needed + 1).cast("int")).where("length > 0")
        out = shared.select("hub", "sig", "d", "f", F.size("ordered").alias("all"), F.posexplode(F.slice("ordered", F.lit(1), F.col("length"))).alias("at", "s"))
        return self.scratch.table(out.select("hub", "sig", "d", "f", (F.col("all") - F.col("at")).cast("long").alias("left"), "s.shingle"), "listed")

    def middle_pairs(self, rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
        """(x, y) for each row and the one of least f of its keys, where labels differ and the two can link: pairs as many as rows.

        By hub: where f + f' is 0 or less both sets link with their hub's middle, so those links are all found here.
        """
        name = "-".join(keys)
        rows = self.scratch.table(self.labelled(rows, labels).select(*keys, "sig", "label", "d", "f"), f"labelled-{name}")
        # of several with that f each difference takes its own
        middle = F.min_by(F.struct("sig", "label", "d", "f"), F.struct("f", F.xxhash64("sig", *keys[1:]))).alias("p")
        middle = rows.groupBy(*keys).agg(middle).select(*keys, F.col("p.sig").alias("other"), F.col("p.label").alias("theirs"), F.col("p.d").alias("their_d"), F.col("p.f").alias("their_f"))
        near = small_join(rows, self.scratch.table(middle, f"middle-{name}"), keys, "inner").where("label <> theirs")
        near = near.where(self.enough(F.least("d", "their_d")))
        return near.select(F.least("sig", "other").alias("x"), F.greatest("sig", "other").alias("y")).distinct()

    def enough(self, most: Column) -> Column:
        """Whether two sets, of f and their_f, may link if they share so many differences at most."""
        return 2 * (100 + self.percent) * most >= F.col("f") + F.col("their_f")

    def labelled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        return small_join(rows, labels, "sig").withColumn("label", F.coalesce("label", "sig"))

    def prefix_pairs(self, marks: DataFrame, listed: DataFrame, labels: DataFrame) -> DataFrame:
        """(x, y) for all sets of one hub, of different labels, that can be linked.

        Two sets that link share a difference, and behind the first one that they share enough must be left. Sets of the label of
        the hub's middle meet others only, and those have an f of more than the middle's with the sign turned, or they
        would be linked with it. Within a difference the sets of the most frequent label meet only those of others.
        """
        table = self.scratch.table
        middle = F.min_by("label", F.struct("f", F.xxhash64("sig"))).alias("middle")
        middle = table(self.labelled(marks, labels).groupBy("hub").agg(middle, F.min("f").alias("least")), "middles-after")
        rows = small_join(self.labelled(listed, labels), middle, "hub", "inner")
        fewest = F.when(F.col("label") == F.col("middle"), F.greatest("least", 1 - F.col("least"))).otherwise(F.col("least"))
        rows = rows.where(2 * (100 + self.percent) * F.col("left") >= F.col("f") + fewest)
        prefix = table(rows.select(F.xxhash64("hub", "shingle").alias("place"), "sig", "label", "f", "left"), "prefix")
        by_label = prefix.groupBy("place", "label").agg(F.count("*").alias("sets"))
        major = table(by_label.groupBy("place").agg(F.max_by("label", F.struct("sets", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1").select("place", "major"), "major")
        there = prefix.join(major, "place")
        few = there.where("label <> major").select("place", F.col("sig").alias("other"), F.col("label").alias("theirs"), F.col("f").alias("their_f"), F.col("left").alias("their_left"))
        apart = (F.col("label") != F.col("theirs")) & ((F.col("label") == F.col("major")) | (F.col("sig") < F.col("other")))
        both = there.join(few, "place").where(apart & self.enough(F.least("left", "their_left")))
        return both.select(F.least("sig", "other").alias("x"), F.greatest("sig", "other").alias("y")).distinct()

    def run(self) -> DataFrame:
        """(doc_id, h, n_shingles, sig, component_id, label) for each row of docs; label: the least sig of its component."""
        table = self.scratch.table
        marks = table(sketch(self.docs), "sketch")
        one = F.min(F.struct("h", "doc_id")).alias("one")
        nodes = marks.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("rep"), one, F.first("keys").alias("keys"), F.min("n_shingles").alias("n"), F.count("*").alias("rows"))
        nodes = table(nodes, "nodes")
        buckets = self.buckets(nodes)
        count = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sig").alias("x"), F.max("sig").alias("y"))
        count = table(count.where("n > 1"), "bucket-sizes")
        members = table(buckets.join(count.where("n > 2").select("bucket", "n"), "bucket"), "members")
        listed = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
        couples = listed.select(F.posexplode("sigs").alias("at", "x"), "sigs")
        couples = couples.select("x", F.explode(F.slice("sigs", F.col("at") + 2, F.size("sigs"))).alias("y"))
        pairs = table(count.where("n = 2").select("x", "y").unionByName(couples).distinct(), "couples")
        large = members.where(F.col("n") > SMALL).select("bucket", "sig", "left")
        wanted = table(pairs.select(F.explode(F.array("x", "y")).alias("sig")).union(large.select("sig")).distinct(), "wanted")
        chosen = table(small_join(nodes.select("sig", "n", "one"), wanted, "sig", "left_semi"), "chosen")
        self.sizes = chosen.select("sig", "n")
        # one row's text for each set, named by its hash and its doc_id
        sources = chosen.select("sig", F.col("one.h").alias("h"), F.col("one.doc_id").alias("doc_id"))
        texts = small_join(self.docs.select("doc_id", "text", F.xxhash64("text").alias("h")), sources, ["h", "doc_id"], "inner")
        self.sets = table(full_sets(texts).dropDuplicates(["sig"]), "sets")
        labels = self.in_large_buckets(large, self.components(self.verify(pairs, "couples"), "labels-couples"))
        group = table(small_join(nodes.select("sig", "rep"), labels, "sig", "inner"), "group")
        least = group.groupBy("label").agg(F.min("rep").alias("component_id"))
        linked = table(small_join(group, least, "label", "inner").select("sig", "component_id", "label"), "linked")
        # a set that one row has and nothing links to keeps that row's doc_id; the others are joined
        copied = small_join(nodes.where("rows > 1").select("sig", "rep"), linked, "sig", "left_anti")
        named = table(linked.unionByName(copied.select("sig", F.col("rep").alias("component_id"), F.col("sig").alias("label"))).withColumn("named", F.lit(True)), "named")
        found = small_join(marks.drop("keys"), named, "sig")
        own = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
        found = table(found.withColumn("component_id", own).withColumn("label", F.coalesce("label", "sig")).drop("named"), "linked-rows")
        self.scratch.keep("linked-rows")
        return found


def components(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, h, n_shingles, sig, component_id, kept.

    Documents link when their sets of five-word shingles are similar by `percent` or more; component_id is the least
    doc_id that links reach. Texts of equal sets are one node, so exact copies are never paired. A null or empty
    text, or one of white space, has no shingles and stands alone under its own doc_id. A null doc_id
    counts after all others: it is a component's id only where nothing else is. Repeated rows get the same component;
    further columns don't matter; an empty table gives an empty one.
    """
    out = Linker(docs, scratch, percent).run()
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, all its columns as they were; rows without words all stay.

    The row of the component's least doc_id stays; of several with that doc_id, one of the least text hash. Cases as in
    `components`; columns of docs may have any names.
    """
    text_hash = fresh("_hash", docs)
    found = scratch.table(components(docs, scratch, percent), "found")
    # several rows of a component may have its least doc_id, or none has an id
    kept = found.where(F.col("kept") & F.col("sig").isNotNull())
    several = kept.groupBy("label").agg(F.count("*").alias("rows"), F.min("h").alias("least")).where("rows > 1")
    crowd = scratch.table(small_join(kept, scratch.table(several, "several"), "label", "inner"), "crowd-kept")
    row = [F.col("doc_id"), F.col("h").alias(text_hash)]
    dropped = found.where(~F.col("kept")).select(*row).union(crowd.where("h <> least").select(*row)).distinct()
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    rest = small_join(hashed, scratch.table(dropped, "dropped"), ["doc_id", text_hash], "left_anti")
    once = scratch.table(crowd.where("h = least").select(*row).distinct(), "once")
    if once.isEmpty():
        return rest.drop(text_hash)
    repeated = small_join(rest, once, ["doc_id", text_hash], "left_semi").dropDuplicates(["doc_id", text_hash])
    return small_join(rest, once, ["doc_id", text_hash], "left_anti").unionByName(repeated).drop(text_hash)
