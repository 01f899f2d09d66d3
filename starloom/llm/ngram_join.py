"""Exact Jaccard self-join of documents on word n-grams, down to connected components.

A document is the set of its shingle hashes; equal sets form one class, and only classes are compared. The work is
dealt by signatures that lose no pair: sizes are cut into overlapping ranges, and in a range whose largest size is r the
shingles fall into k + T parts by hash, where k bounds the symmetric difference of a linked pair of that range. Such
a pair agrees on T whole parts at least. So a class that shares fewer than T of its signatures with other classes has no partner and is
out; the others meet under the signatures they share. There a T-occurrence search over inverted lists of
shingles finds the links (``TileIndex.search``). Most signatures stand in one class only: they are counted in packed blocks first,
and a row is made of those alone that come twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.components import connected_components
from starloom.llm.keysets import Members, frequent_keys, key_of, packed
from starloom.llm.tables import drop_finished_shuffles, packed_rows, tidy
from starloom.llm.words import WordHashes, mix, windows
from starloom.session import durable, one_row

RANGE_RATIO = 1.35  # of the largest to the smallest size of a range
TILE_CLASSES = 512  # classes in one half of a tile
TILE_SHINGLES = 1_000_000  # shingles in one half of a tile, 8 MB
BROADCAST_ROWS = 500_000  # of 36 bytes each
BLOCK_SIGNATURES = 500_000  # signatures a task holds before it hands on their counts
BUCKET_WORDS = 1_000_000  # words of texts whose signatures are counted in one place
MOST_BITS = 28  # the bitmap of repeated signatures has at most 2 ** 28 bits, 32 MB
AGREE = 5  # a linked pair agrees on one part more for each so many parts that may differ
MU = 0.02  # weight of a probe against a merged posting in the choice of the long lists


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased; of the whole text if it is shorter; none without words."""
    return np.unique(windows(cache.of((text or "").encode("utf-8").lower().split()), width))


def class_key(shingles: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=seed) - (1 << 63)


class Signatures:
    """Signatures of shingle sets for a Jaccard threshold."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.ranges: list[tuple[int, int]] = []  # smallest and largest size

    def ranges_of(self, n: int) -> list[int]:
        """The range of ``n`` and every higher one that may hold a partner of a set of ``n``."""
        while not self.ranges or self.ranges[-1][0] * self.threshold <= n:
            low = self.ranges[-1][1] + 1 if self.ranges else 1
            self.ranges.append((low, max(low, int(low * RANGE_RATIO))))
        return [i for i, (low, high) in enumerate(self.ranges) if high >= n and low * self.threshold <= n]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The signatures, with their range in the lowest 8 bits, and for each range (``need_code``) how many of them a linked set shares at least.

        Empty parts are left out where fewer than ``agree`` parts are empty, and counted as shared; then some of those a pair
        agrees on has shingles. Otherwise all parts count, and one of them must be shared.
        """
        found, needs = [], []
        spread = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15))
        for i in self.ranges_of(len(shingles)) if len(shingles) else []:
            differ = int(2 * self.ranges[i][1] * (1 - self.threshold) / (1 + self.threshold))
            agree = max(2, -(-differ // AGREE))
            parts = differ + agree
            part = (shingles >> np.uint64(9)) % np.uint64(parts)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, spread)
            names = mix(sums + mix(np.arange(parts, dtype=np.uint64) + np.uint64((i + 1) << 32)))
            names = (names & ~np.uint64(255)) | np.uint64(i)
            empty = np.bincount(part.astype(np.int64), minlength=parts) == 0
            skipped = int(empty.sum())
            found.append(names if skipped >= agree else names[~empty])
            needs.append(need_code(i, agree - skipped if skipped < agree else 1))
        return (np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)), needs


NO_SIGNATURES = (np.zeros(0, np.int64), [])


def need_code(size_range: int, need: int) -> int:
    return size_range << 32 | need


FEATURES = "doc_id long, text_hash long, n long, k long, k2 long, needs array<long>, bucket long, block binary"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches (text) with the shingle sets of their rows."""
    cache = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield part, [shingle_set(t, width, cache) for t in part.column("text").to_pylist()]


def document_features(documents: DataFrame, width: int, threshold: Fraction, buckets: int) -> DataFrame:
    """Rows of two kinds: of each document doc_id, text_hash, n (shingles), k and k2 (two independent hashes of the set) and needs; and
    blocks of the counted signatures of all sets (bucket, block; the rest null).

    Of the copies of a set in one task, the first alone has needs and signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, seen = Signatures(threshold), set()
        names: list[np.ndarray] = []
        size = 0
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "k", "k2")] + [("needs", pa.list_(pa.int64())), ("bucket", pa.int64()), ("block", pa.binary())])

        def blocks() -> pa.RecordBatch:
            keys, counts = np.unique(key_of(np.concatenate(names).view(np.uint64), buckets), return_counts=True)
            names.clear()
            rows = packed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, f.type) for f in list(schema)[:6]] + [rows.column("bucket"), rows.column("block")], schema=schema)

        for part, sets in _sets(batches, width):
            keys = [pa.array([class_key(s, seed) for s in sets], pa.int64()) for seed in (1, 2)]
            needs = []
            for s, k in zip(sets, keys[0].to_pylist()):
                own, need = NO_SIGNATURES if k in seen else signatures.of(s)
                seen.add(k)
                names.append(own)
                needs.append(need)
                size += len(own)
            none = [pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())]
            columns = [part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), *keys, pa.array(needs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *none], schema=schema)
            if size >= BLOCK_SIGNATURES:
                yield blocks()
                size = 0
        if names:
            yield blocks()

    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), FEATURES)


def shared_signatures(documents: DataFrame, width: int, threshold: Fraction, shared: Members, buckets: int) -> DataFrame:
    """Distinct rows (signature, k) of the signatures in ``shared``, read from the texts again: those that two or more classes, or copies of one class in several tasks, have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, seen = Signatures(threshold), set()
        for _, sets in _sets(batches, width):
            names, keys = [], []
            for s in sets:
                k = class_key(s, 1)
                if k not in seen:
                    seen.add(k)
                    own = signatures.of(s)[0]
                    own = own[shared.has(key_of(own.view(np.uint64), buckets))]
                    names.append(own)
                    keys.append(np.full(len(own), k, np.int64))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(keys))], ["signature", "k"])

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "signature long, k long").distinct()


class TileIndex:
    """Inverted lists of the shingle sets of a tile, and the T-occurrence search over them."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.threshold = threshold
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        self.postings = np.repeat(np.arange(len(sets)), self.sizes)[order]  # each list is sorted by place
        self.shingles, self.starts = np.unique(shingles[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(shingles))

    def search(self, query: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places among ``wanted`` (mask) of the sets linked with ``query``.

        A linked set shares at least T = ceil(threshold x size) shingles with the query. The L longest of the query's
        lists are set aside; the short ones are merged, and what stands in fewer than T - L of them is out. The others
        are looked up in the long lists by binary search, shortest list first, and dropped as soon as they cannot reach
        the overlap that their own size demands.
        """
        t = self.threshold
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        need = -(-t.numerator * len(query) // t.denominator)
        if len(at) < need:
            return np.zeros(0, np.int64)
        lengths = self.ends[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        aside = min(need - 1, int(need / (MU * np.log2(lengths.max() + 1) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merged = np.sort(np.concatenate([self.postings[self.starts[i] : self.ends[i]] for i in short]), kind="stable")  # runs are merged
        edges = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[edges], np.diff(np.append(edges, len(merged)))
        total = self.sizes[found] + len(query)
        required = -(-t.numerator * total // (t.numerator + t.denominator))
        fits = (self.sizes[found] * t.denominator >= t.numerator * len(query)) & (len(query) * t.denominator >= t.numerator * self.sizes[found])
        keep = wanted[found] & fits & (count >= need - aside) & (count + aside >= required)
        found, count, required = found[keep], count[keep], required[keep]
        for probed, i in enumerate(long, 1):
            if not len(found):
                break
            postings = self.postings[self.starts[i] : self.ends[i]]
            count = count + (postings[np.minimum(np.searchsorted(postings, found), len(postings) - 1)] == found)
            if probed % 8 == 0 or probed == aside:
                keep = count + (aside - probed) >= required
                found, count, required = found[keep], count[keep], required[keep]
        return found


def link_tile(keys: list[int], groups: list[int], roles: list[int], sets: list[np.ndarray], threshold: Fraction) -> list[tuple[int, int]]:
    """Links of one tile that join what was apart: at most one less than the tile has classes.

    Classes of role 0 are searched among those of role 1, those of role 2 among all of role 2. ``groups`` are
    components known before; classes of one group are not compared, here or once a link has joined them.
    """
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, g in enumerate(groups):
        parent[i] = first.setdefault(g, i)
    indexed = [i for i, role in enumerate(roles) if role > 0]
    if not indexed:
        return []
    index = TileIndex([sets[i] for i in indexed], threshold)
    place = np.array(indexed)
    links = []
    roots = np.array([root(i) for i in indexed])
    for i, role in enumerate(roles):
        if role == 1:
            continue
        wanted = roots != root(i)
        if role == 2:
            wanted &= place > i
        if not wanted.any():
            continue
        for j in place[index.search(sets[i], wanted)].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((keys[i], keys[j]))
        roots = np.array([root(j) for j in indexed]) if links and links[-1][0] == keys[i] else roots
    return links


def tile_shingles(documents: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (tile, k, role, comp, first: the doc_id of a member of the class) with the shingles of the class, read from the texts again.

    While the rows are few they are broadcast, and the texts stay where they are; beyond that both are shuffled by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        own, data, last = False, b"", None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep, found = [], []
                for k, text in zip(part.column("k").to_pylist(), part.column("text").to_pylist()):
                    if (k, text) != last:  # the tiles of a class follow each other
                        last, shingles = (k, text), shingle_set(text, width, cache)
                        own, data = class_key(shingles, 1) == k, shingles.tobytes()
                    keep.append(own)  # a doc_id may stand for several texts
                    if own:
                        found.append(data)
                kept = part.select(["tile", "k", "role", "comp"]).filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.binary())], ["tile", "k", "role", "comp", "shingles"])

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    found = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("first"))).select("tile", "k", "role", "comp", "text")
    return found.mapInArrow(tidy(run), "tile long, k long, role int, comp long, shingles binary")


def search_tiles(documents: DataFrame, rows: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Links (u, v) found in tiles; ``rows``: tile, k, role, comp, first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        current, last = None, None

        def finish() -> pa.RecordBatch:
            links = link_tile(*held, threshold) if held[0] else []
            for part in held:
                part.clear()
            u, v = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for tile, k, comp, role, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "k", "comp", "role", "shingles"))):
                if tile != current:
                    yield finish()
                    current = tile
                elif (role, k) == last:  # a row of the table that repeats another
                    continue
                last = (role, k)
                held[0].append(k)
                held[1].append(comp)
                held[2].append(role)
                held[3].append(np.frombuffer(data, np.uint64))
        yield finish()

    placed = tile_shingles(documents, durable(rows), width)
    return placed.repartition("tile").sortWithinPartitions("tile", "role", "k").mapInArrow(tidy(run), "u long, v long")


def half_size(n):
    """Classes in one half of a tile, where the largest has ``n`` shingles."""
    return F.greatest(F.lit(1), F.least(F.lit(TILE_CLASSES), F.floor(F.lit(TILE_SHINGLES) / F.greatest(n, F.lit(1))))).cast("long")


def star_tiles(members: DataFrame) -> DataFrame:
    """Tiles that compare, under every signature, its smallest class with all others; large stars are cut by a hash of the class."""
    leaders = members.groupBy("signature").agg(F.min("k").alias("leader"))
    pairs = members.join(leaders, "signature").where("k <> leader").select("leader", "k", "n").distinct()
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("c"), F.max("n").alias("most"))
    sizes = sizes.select("leader", F.ceil(F.col("c") / half_size(F.col("most"))).alias("cuts"))
    tile = lambda cut: F.xxhash64(F.lit("star"), "leader", cut)
    indexed = pairs.join(sizes, "leader").select(tile(F.pmod(F.xxhash64("k"), "cuts")).alias("tile"), "k", F.lit(1).alias("role"), F.col("k").alias("comp"))
    asking = sizes.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    return indexed.unionByName(asking.select(tile(F.col("cut")).alias("tile"), F.col("leader").alias("k"), F.lit(0).alias("role"), F.col("leader").alias("comp")))


def remaining_tiles(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles that compare, under every signature, all classes that are still in different components.

    Classes of a signature are dealt into chunks: a component larger than half a tile gets chunks of its own, smaller ones share.
    Every two chunks make a tile, unless both lie in one component.
    """
    placed = members.join(labels.select(F.col("u").alias("k"), F.col("v").alias("comp")), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    split = placed.groupBy("signature").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("n").alias("most")).where("a <> b")
    split = split.select("signature", half_size(F.col("most")).alias("half"))
    by_comp = placed.join(split, "signature").groupBy("signature", "comp", "half").agg(F.count("*").alias("c"))
    by_comp = by_comp.withColumn("large", F.col("c") > F.col("half"))
    small = by_comp.where("not large").groupBy("signature").agg(F.sum("c").alias("shared"))
    dealt = by_comp.join(small, "signature", "left").select(
        "signature", "comp", "large", F.ceil(F.when(F.col("large"), F.col("c")).otherwise(F.col("shared")) / F.col("half")).alias("cuts")
    )
    own = F.when(F.col("large"), F.col("comp"))
    cut = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("k")).otherwise(F.col("comp"))), F.col("cuts"))
    chunked = placed.join(dealt, ["signature", "comp"]).select("signature", "k", "comp", own.alias("own"), F.xxhash64(F.coalesce(own, F.lit(0)), F.col("large"), cut).alias("chunk"))
    chunks = chunked.groupBy("signature", "chunk").agg(F.first("own").alias("own"))
    other = chunks.select("signature", F.col("chunk").alias("chunk_b"), F.col("own").alias("own_b"))
    pairs = chunks.join(other, "signature").where("chunk <= chunk_b and (own is null or own_b is null or own <> own_b)")
    tiles = pairs.select("signature", "chunk", "chunk_b", F.xxhash64("signature", "chunk", "chunk_b").alias("tile"))
    alone = F.col("chunk") == F.col("chunk_b")
    sides = tiles.select("signature", "chunk", "tile", F.when(alone, 2).otherwise(0).alias("role")).unionByName(
        tiles.where(~alone).select("signature", F.col("chunk_b").alias("chunk"), "tile", F.lit(1).alias("role"))
    )
    return chunked.join(sides, ["signature", "chunk"]).select("tile", "k", "role", "comp")


def of_several_classes(members: DataFrame) -> DataFrame:
    """The rows (signature, k) of signatures of two or more classes."""
    several = members.groupBy("signature").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("signature")
    return members.join(several, "signature")


def often_enough(members: DataFrame, features: DataFrame) -> DataFrame:
    """``members`` (signature, k) without the classes that share fewer signatures of a range than a linked pair does, and without signatures of one class."""
    members = of_several_classes(members)
    in_range = F.col("signature").bitwiseAND(F.lit(255)).alias("r")
    needs = features.select("k", F.explode("needs").alias("code")).distinct().select("k", F.shiftright("code", 32).alias("r"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("need"))
    enough = members.groupBy("k", in_range).agg(F.count("*").alias("c")).join(needs, ["k", "r"]).where("c >= need").select("k", "r")
    left = members.withColumn("r", in_range).join(enough, ["k", "r"], "left_semi").select("signature", "k")
    return of_several_classes(left)


def cheaper_buckets(members: DataFrame) -> DataFrame:
    """Buckets (signature, k, n) that bring together all pairs which ``members`` (signature, k, n) does, in fewer rows of tiles.

    Near copies share most of their signatures, each with another choice of the group's members. Where the group of all
    classes connected by signatures makes tiles of fewer rows than its signatures do, the group becomes one bucket.
    """
    leaders = members.groupBy("signature").agg(F.min("k").alias("v"))
    edges = members.join(leaders, "signature").where("k <> v").select(F.col("k").alias("u"), "v").distinct()
    labels = connected_components(edges).select(F.col("u").alias("k"), F.col("v").alias("group"))
    grouped = members.join(labels, "k", "left").withColumn("group", F.coalesce("group", "k"))
    alone = grouped.select("group", "k", "n").distinct().groupBy("group").agg(F.count("*").alias("classes"), F.max("n").alias("most"))
    rows = grouped.groupBy("group").agg(F.count("*").alias("rows"))
    choice = alone.join(rows, "group").select("group", (F.col("classes") * F.ceil(F.col("classes") / half_size(F.col("most"))) <= F.col("rows")).alias("whole"))
    chosen = grouped.join(choice, "group")
    bucket = F.when(F.col("whole"), F.xxhash64(F.lit("group"), "group")).otherwise(F.col("signature"))
    return chosen.select(bucket.alias("signature"), "k", "n").distinct()


def ngram_jaccard_components(documents: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, text_hash, n_shingles, component_key, component_id.

    Two documents are linked when their shingle sets have a Jaccard similarity of ``threshold`` or more (an exact
    fraction); component_id is the smallest doc_id reachable by links. Equal sets are linked. A document without words, and one
    whose text is null, is linked with nothing. Repeated rows are documents like others; a null doc_id counts only
    where a component has no other. component_key names the component also where ids do not; null without words. An empty table gives an empty one. Other columns are ignored.

    Exact at every size: the signatures lose no linked pair, and every pair of classes that shares one is compared
    unless it is known to be in one component. Groups that fit into a tile are searched whole. A larger group of near copies
    is first compared with single members of it (a number of pairs linear in the rows); only classes that stay
    apart are then compared with each other, in tiles of bounded size. Set keys have 64 bits; a collision of two sets is found by a second hash and raises an error.
    """
    words = one_row(documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")))["chars"] // 6
    parts = min(1 << 31, -(-words // BUCKET_WORDS) or 1)
    found = durable(document_features(documents, width, threshold, parts))
    features = found.where("bucket is null").drop("bucket", "block")
    classes = durable(features.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("k2").alias("a"), F.max("k2").alias("b")))
    if not classes.where("a <> b").isEmpty():
        raise ValueError("two different shingle sets have the same 64-bit key")
    repeated = frequent_keys(found.where("bucket is not null").select("bucket", "block"), 2, min(MOST_BITS, max(16, (4 * words).bit_length())))
    shared = durable(shared_signatures(documents, width, threshold, repeated, parts))
    drop_finished_shuffles(documents.sparkSession)
    members = durable(often_enough(shared, features).join(classes.select("k", "n"), "k"))
    buckets = durable(cheaper_buckets(members))
    sizes = buckets.groupBy("signature").agg((F.count("*") <= half_size(F.max("n"))).alias("fits"))
    sized = durable(buckets.join(sizes, "signature"))
    drop_finished_shuffles(documents.sparkSession)
    within = sized.where("fits").select(F.col("signature").alias("tile"), "k", F.lit(2).alias("role"), F.col("k").alias("comp"))
    large = sized.where("not fits").drop("fits")
    ids = classes.select("k", "first")
    links = search_tiles(documents, within.unionByName(star_tiles(large)).join(ids, "k"), width, threshold)
    labels = connected_components(links)
    if not large.isEmpty():
        more = search_tiles(documents, remaining_tiles(large, labels).join(ids, "k"), width, threshold)
        labels = connected_components(labels.unionByName(more))
    named = classes.join(labels.select(F.col("u").alias("k"), F.col("v").alias("comp")), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "comp").select("k", "comp", "component_id")
    out = features.select("doc_id", "text_hash", "n", "k").join(by_class, "k", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).alias("component_key"), component.alias("component_id"))


def drop_near_duplicates(documents: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``documents`` with one row of each component: the smallest doc_id (a null one last), then the smallest text hash.

    Of rows that repeat both, one stays. Documents without words are linked with nothing and all stay. Columns and their order are kept.
    """
    found = durable(ngram_jaccard_components(documents, width, threshold).where("component_key is not null"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = found.groupBy("component_key").agg(F.min(place).alias("stays"))
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    judged = found.join(first, "component_key").withColumn("keep", stays)
    gone = durable(judged.where("not keep").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    if gone.count() <= BROADCAST_ROWS:  # then the texts stay where they are
        gone = F.broadcast(gone)
    hashed = packed_rows(documents).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("hash"))
    left = hashed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    repeated = durable(judged.where("keep").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")))
    if not repeated.isEmpty():  # rows alike in id and text: one of each
        alike = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("hash") == F.col("again_hash"))
        once = left.join(repeated, alike, "left_semi").dropDuplicates(["doc_id", "hash"])
        left = left.join(repeated, alike, "left_anti").unionByName(once)
    return left.select("row.*")
