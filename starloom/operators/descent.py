"""Matrix factorization by stochastic gradient descent in strata.

Users and items are dealt into B blocks each, and ratings into B x B tiles. Tiles on one diagonal share no user and no item,
so B tasks descend on them at once, each with the vectors of one user block and one item block. An epoch is B such steps, the first of which
is one with the last of the epoch before, and a step is one shuffle of vectors and tiles by the number of the task; a log that fits one tile is fitted by one task in one step. Models
of different seeds are fitted side by side. Inside a tile ratings are dealt into batches in which no
user and no item comes twice; a batch is then descended on at once with the result of one rating after the other.

A user or item with more ratings than a task should take is split into copies, which lie in blocks of their own. At the
end of each epoch its copies are set to their mean, weighted by ratings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.skew import maybe_broadcast, rows_per_task
from starloom.session import Stored, drop_ended_shuffles, durable, one_row, shared_folder

BLOCK_BYTES = 256 << 20  # vectors of a block; with fewer blocks an epoch has fewer steps, each of which moves all vectors
TILE_RATINGS = 4_000_000  # 64 MB
CHUNK_BYTES = 4 << 20  # vectors or ratings in one row
TABLE_ROWS = 2000  # of the fitted tables, in one batch
PIECE_RATINGS = 512  # ratings of a batch whose vectors are handled at once, so that they stay in the processor's cache
STEPS_STORED = 4  # steps between stored states; the shuffle files of that many stay on disk
STATE_BYTES = 256 << 20  # a larger state is stored after each step

PART = "id int, seed int, kind int, block int, chunk int, payload binary"
NAMES = ["id", "seed", "kind", "block", "chunk", "payload"]
USERS, ITEMS, TILE, MEAN = range(4)  # kinds of rows
RATING = np.dtype([("batch", "<i4"), ("user", "<i4"), ("item", "<i4"), ("rating", "<f4")])


def deal_into_batches(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """A batch number for each rating, the smallest that neither its user nor its item has yet."""
    of_user: dict[int, int] = {}
    of_item: dict[int, int] = {}
    batches = np.empty(len(users), np.int32)
    for at, (u, i) in enumerate(zip(users.tolist(), items.tolist())):
        a, b = of_user.get(u, 0), of_item.get(i, 0)
        taken = a | b
        bit = ~taken & (taken + 1)
        of_user[u], of_item[i] = a | bit, b | bit
        batches[at] = bit.bit_length() - 1
    return batches


def first_vectors(keys: np.ndarray, seed: int, rank: int, spread: float) -> np.ndarray:
    """Normal numbers for each key, the same wherever the key is placed; shape (keys, rank)."""
    mixed = keys.astype(np.uint64)[:, None] + np.arange(1, rank + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))

    def scattered(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53

    one, two = scattered(mixed), scattered(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return (spread * np.sqrt(-2 * np.log1p(-one)) * np.cos(2 * np.pi * two)).astype(np.float32)


def descend(users: np.ndarray, items: np.ndarray, ratings: np.ndarray, order: np.ndarray, mean: float, rate: float, reg: float, bias: bool) -> None:
    """One pass over the ``ratings`` (RATING, sorted by batch) of a tile, batch by batch in ``order``.

    With ``bias`` the last two columns of a vector are its bias and a constant one, crosswise for users and items, so that the product of
    two vectors includes both biases.
    """
    edges = np.searchsorted(ratings["batch"], np.arange(len(order) + 1)).tolist()
    keep, level, rate = np.float32(1 - rate * reg), np.float32(mean), np.float32(rate)
    of_users, of_items, values = (np.ascontiguousarray(ratings[c]) for c in ("user", "item", "rating"))
    for batch in order.tolist():
        for low in range(edges[batch], edges[batch + 1], PIECE_RATINGS):
            high = min(low + PIECE_RATINGS, edges[batch + 1])
            u, i = of_users[low:high], of_items[low:high]
            p, q = users[u], items[i]
            step = (rate * (values[low:high] - level - np.einsum("nk,nk->n", p, q)))[:, None]
            for_p, for_q = step * q, step * p
            p *= keep
            p += for_p
            q *= keep
            q += for_q
            if bias:
                p[:, -1] = 1
                q[:, -2] = 1
            users[u], items[i] = p, q


def diagonals(blocks: int, epochs: int) -> list[tuple[int, list[int]]]:
    """The diagonals in the order of their steps, each with its epochs: an epoch begins with the diagonal that the one before ended with, in the same step."""
    steps: list[tuple[int, list[int]]] = []
    for epoch in range(epochs):
        for diagonal in range(blocks) if epoch % 2 == 0 else reversed(range(blocks)):
            if steps and steps[-1][0] == diagonal:
                steps[-1][1].append(epoch)
            else:
                steps.append((diagonal, [epoch]))
    return steps


def entity_copies(ratings: DataFrame, key: str, other: str, limit: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Copies of each entity (key, copy, n, copies, block, place), and the ratings with the copy they belong to."""
    counts = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = durable(counts.where(F.col("_n") > limit).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / limit).cast("int").alias("copies")))  # at most ratings / limit
    placed = ratings.join(maybe_broadcast(hot), ratings[key].eqNullSafe(hot["_hot"]), "left") if not hot.isEmpty() else ratings.withColumn("copies", F.lit(None).cast("int"))
    copies = F.coalesce("copies", F.lit(1))
    placed = placed.withColumn(f"{key}_copy", F.when(copies > 1, F.pmod(F.xxhash64(other), copies)).otherwise(0).cast("int")).withColumn("copies", copies).drop("_hot")
    entities = placed.groupBy(key, F.col(f"{key}_copy").alias("copy"), "copies").agg(F.count(F.lit(1)).alias("n"))
    entities = entities.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.col("copy"), F.lit(key)), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(key, "copy")) - 1
    return durable(entities.withColumn("place", place)), placed.drop("copies")


class BlockDescent:
    """The fitted vectors: ``users`` and ``items`` with user_bias / item_bias (mean over seeds) and factors (those of all seeds, one after the other)."""

    def __init__(self, rank: int, epochs: int, rate: float, reg: float, seeds: tuple[int, ...] = (42,), bias: bool = True, spread: float = 0.1, blocks: int | None = None):
        self.rank, self.epochs, self.rate, self.reg, self.seeds, self.bias, self.spread, self.blocks = rank, epochs, rate, reg, tuple(seeds), bias, spread, blocks
        self.width = rank + (2 if bias else 0)

    def _tiles(self, ratings: DataFrame, blocks: int) -> DataFrame:
        """Rows (diagonal, PART) of the tiles' ratings, dealt into batches and stored by diagonal."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            current = None

            def finish() -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                column = lambda c: np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held])
                rows = np.empty(sum(h.num_rows for h in held), RATING)
                rows["user"], rows["item"], rows["rating"] = column("user_place"), column("item_place"), column("rating")
                rows["batch"] = deal_into_batches(rows["user"], rows["item"])
                rows = rows[np.argsort(rows["batch"], kind="stable")]
                size = CHUNK_BYTES // RATING.itemsize
                parts = [rows[a : a + size].tobytes() for a in range(0, len(rows), size)]
                own, n = current[0], len(parts)
                diagonal = (current[1] - own) % blocks
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * n, pa.int32()) for x in (diagonal, own, 0, TILE, own)] + [pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())],
                    ["diagonal", *NAMES],
                )
                held.clear()

            for batch in batches:
                a, b = batch.column("user_block").to_numpy(), batch.column("item_block").to_numpy()
                edges = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
                for low, high in zip(edges, edges[1:]):
                    if low < high:
                        if (int(a[low]), int(b[low])) != current:
                            yield from finish()
                            current = (int(a[low]), int(b[low]))
                        held.append(batch.slice(low, high - low))
            yield from finish()

        mixed = F.xxhash64("user_place", "item_place", "user_block", "item_block")
        rows = ratings.select("user_block", "item_block", "user_place", "item_place", F.col("rating").cast("float").alias("rating"), mixed.alias("mixed"))
        rows = rows.repartition("user_block", "item_block").sortWithinPartitions("user_block", "item_block", "mixed")
        tiles = rows.drop("mixed").mapInArrow(run, "diagonal int, " + PART)
        folder = shared_folder(ratings.sparkSession, "tiles")
        tiles.write.partitionBy("diagonal").parquet(folder)
        return ratings.sparkSession.read.schema(PART + ", diagonal int").parquet(folder)

    def _first(self, entities: DataFrame, key: str, kind: int) -> DataFrame:
        """PART rows of the vectors that a fit begins with."""
        rank, width, seeds, spread, bias = self.rank, self.width, self.seeds, self.spread, self.bias
        size = max(1, CHUNK_BYTES // (4 * width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # one row is one chunk
                for block, chunk, keys in zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "keys"))):
                    for at, seed in enumerate(seeds):
                        out = np.zeros((len(keys), width), np.float32)
                        out[:, :rank] = first_vectors(np.array(keys, np.int64), seed, rank, spread)
                        if bias:
                            out[:, -1 if kind == USERS else -2] = 1
                        yield _part(block, at, kind, block, chunk, out)

        member = F.struct("place", F.xxhash64(F.col(key), F.lit(key)).alias("h"))
        chunks = entities.groupBy("block", F.floor(F.col("place") / size).cast("int").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(member)), lambda m: m["h"]).alias("keys"))
        return chunks.mapInArrow(run, PART)

    def _step(self, state: DataFrame, tiles: DataFrame, means: DataFrame | None, step: int, epochs: Iterable[int], blocks: int) -> DataFrame:
        """The vectors after the tiles of one diagonal, once for each of ``epochs``."""
        width, seeds, rate, reg, bias, mean = self.width, self.seeds, self.rate, self.reg, self.bias, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], dict[int, list]] = {}
            for batch in batches:
                for number, seed, kind, block, chunk, payload in zip(*(batch.column(c).to_pylist() for c in NAMES)):
                    held.setdefault((number, seed), {}).setdefault(kind, []).append((chunk, block, payload))
            for number, seed in sorted(held):
                kinds, sides = held.pop((number, seed)), {}
                for kind in (USERS, ITEMS):
                    parts = sorted(kinds.get(kind, []), key=lambda p: p[0])
                    vectors = [np.frombuffer(p[2], np.float32).reshape(-1, width) for p in parts]
                    sides[kind] = np.concatenate(vectors) if vectors else np.zeros((0, width), np.float32), [p[:2] for p in parts], [len(v) for v in vectors]
                    kinds.pop(kind, None)  # the vectors are not held twice
                    del parts, vectors
                for place, kind, payload in kinds.get(MEAN, []):
                    sides[kind][0][place] = np.frombuffer(payload, np.float32)
                rows = [np.frombuffer(p[2], RATING) for p in sorted(kinds.get(TILE, []), key=lambda p: p[0])]
                if rows:
                    ratings = np.concatenate(rows)
                    for epoch in epochs:
                        order = np.random.default_rng([epoch, number, seeds[seed]]).permutation(int(ratings["batch"][-1]) + 1)
                        descend(sides[USERS][0], sides[ITEMS][0], ratings, order, mean, rate, reg, bias)
                for kind, (vectors, parts, lengths) in sides.items():
                    end = 0
                    for (chunk, block), length in zip(parts, lengths):
                        end += length
                        yield _part(number, seed, kind, block, chunk, vectors[end - length : end])

        task = F.when(F.col("kind") == ITEMS, F.pmod(F.col("block") - step, F.lit(blocks))).otherwise(F.col("block")).cast("int")
        mine = tiles.where(F.col("diagonal") == step).select("id", F.explode(F.array(*[F.lit(i) for i in range(len(seeds))])).alias("seed"), "kind", "block", "chunk", "payload")
        rows = state.withColumn("id", task).unionByName(mine)
        if means is not None:  # chunk is the place in the block, block the side
            rows = rows.unionByName(means.select(task.alias("id"), "seed", F.lit(MEAN).alias("kind"), F.col("kind").alias("block"), F.col("place").alias("chunk"), "payload"))
        return rows.repartitionById(blocks * len(seeds), F.col("id") * len(seeds) + F.col("seed")).mapInArrow(run, PART)

    def _vectors(self, state: DataFrame) -> DataFrame:
        """seed, kind, block, place, payload: one row per copy and seed."""
        size = 4 * self.width
        chunk_size = max(1, CHUNK_BYTES // size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for seed, kind, block, chunk, payload in zip(*(batch.column(c).to_pylist() for c in NAMES[1:])):
                    n = len(payload) // size
                    edges = np.arange(n + 1, dtype=np.int32) * np.int32(size)
                    cut = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(payload)])
                    same = [pa.array(np.full(n, x, np.int32)) for x in (seed, kind, block)]
                    places = pa.array(np.arange(n, dtype=np.int32) + np.int32(chunk * chunk_size))
                    yield pa.RecordBatch.from_arrays([*same, places, cut], ["seed", "kind", "block", "place", "payload"])

        return state.select(*NAMES).where("length(payload) > 0").mapInArrow(run, "seed int, kind int, block int, place int, payload binary")

    def _means(self, state: DataFrame, copies: DataFrame) -> DataFrame:
        """seed, kind, block, place, payload of each copy in ``copies`` (kind, block, place, entity, n): the mean over its entity's copies."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                means = []
                for parts in batch.column("parts").to_pylist():
                    total = sum(p["n"] * np.frombuffer(p["payload"], np.float32).astype(np.float64) for p in parts)
                    means.append((total / sum(p["n"] for p in parts)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("seed"), batch.column("kind"), batch.column("entity"), pa.array(means, pa.binary())], ["seed", "kind", "entity", "payload"])

        found = copies.join(self._vectors(state), ["kind", "block", "place"])
        groups = found.groupBy("seed", "kind", "entity").agg(F.collect_list(F.struct("n", "payload")).alias("parts"))  # an entity's copies: its ratings / limit
        means = groups.mapInArrow(run, "seed int, kind int, entity string, payload binary")
        return durable(copies.join(means, ["kind", "entity"]).select("seed", "kind", "block", "place", "payload"))

    def fit(self, ratings: DataFrame) -> "BlockDescent":
        """``ratings``: user, item, rating, stored; a pair comes once."""
        spark = ratings.sparkSession
        size = one_row(ratings.agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"), F.approx_count_distinct("user").alias("users"), F.approx_count_distinct("item").alias("items")))
        self.mean = float(size["mean"] or 0.0) if self.bias else 0.0
        blocks = self.blocks or max(1, -(-max(size["users"], size["items"]) * 4 * self.width // BLOCK_BYTES), int(np.ceil(np.sqrt(size["n"] / TILE_RATINGS))))
        limit = rows_per_task(spark)
        users, placed = entity_copies(ratings, "user", "item", limit, blocks)
        items, placed = entity_copies(placed, "item", "user", limit, blocks)
        for key, entities in (("user", users), ("item", items)):
            where = entities.select(F.col(key).alias("_key"), F.col("copy").alias("_copy"), F.col("block").alias(f"{key}_block"), F.col("place").alias(f"{key}_place"))
            placed = placed.join(where, placed[key].eqNullSafe(where["_key"]) & (placed[f"{key}_copy"] == where["_copy"])).drop("_key", "_copy")
        tiles = self._tiles(placed, blocks)
        split = lambda entities, key, kind: entities.where("copies > 1").select(F.lit(kind).alias("kind"), "block", "place", F.col(key).cast("string").alias("entity"), "n")
        copies = durable(split(users, "user", USERS).unionByName(split(items, "item", ITEMS)))
        divided = not copies.isEmpty()
        stored = Stored(self._first(users, "user", USERS).unionByName(self._first(items, "item", ITEMS)), "vectors")
        state, since, means = stored.rows, 0, None
        bytes_moved = (size["users"] + size["items"]) * 4 * self.width * len(self.seeds)
        unstored = 1 if bytes_moved > STATE_BYTES else STEPS_STORED
        steps = [(step, [epoch]) for epoch in range(self.epochs) for step in range(blocks)] if divided else diagonals(blocks, self.epochs)
        for step, epochs in steps:
            state = self._step(state, tiles, means, step, epochs, blocks)
            since, means = since + 1, None
            ended = divided and step == blocks - 1
            if since >= unstored or ended:
                stored = stored.replaced_by(state, "vectors")
                state, since = stored.rows, 0
            if ended:
                means = self._means(state, copies)
        if since:
            stored = stored.replaced_by(state, "vectors")
        state = stored.rows
        self.users, self.items = (self._table(state, e, key, kind, divided) for e, key, kind in ((users, "user", USERS), (items, "item", ITEMS)))
        stored.delete()
        drop_ended_shuffles(spark)
        return self

    def _table(self, state: DataFrame, entities: DataFrame, key: str, kind: int, divided: bool) -> DataFrame:
        """key, bias (mean over seeds), factors (those of all seeds), the mean over copies."""
        schema = f"{key} {dict(entities.dtypes)[key]}, {key}_bias double, factors array<double>"
        rows = state.where(F.col("kind") == kind)
        return Stored(self._mean_of_copies(rows, entities, key, kind, schema) if divided else self._whole_chunks(rows, entities, key, kind, schema), f"{key}_factors").rows

    def _whole_chunks(self, rows: DataFrame, entities: DataFrame, key: str, kind: int, schema: str) -> DataFrame:
        """The table if no entity is divided: chunks of vectors meet the keys of their places."""
        width, seeds, rank, bias = self.width, len(self.seeds), self.rank, self.bias
        size = max(1, CHUNK_BYTES // (4 * width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, parts in zip(batch.column("keys"), batch.column("parts").to_pylist()):
                    keys = keys.values
                    vectors = [np.frombuffer(p["payload"], np.float32).reshape(-1, width) for p in sorted(parts, key=lambda p: p["seed"])]
                    for low in range(0, len(keys), TABLE_ROWS):
                        high = min(low + TABLE_ROWS, len(keys))
                        factors = np.hstack([v[low:high, :rank] for v in vectors]).astype(np.float64)
                        own = sum(v[low:high, -2 if kind == USERS else -1].astype(np.float64) for v in vectors) / seeds if bias else np.zeros(high - low)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * (seeds * rank)), pa.array(factors.ravel()))
                        yield pa.RecordBatch.from_arrays([keys.slice(low, high - low), pa.array(own), lists], [key, f"{key}_bias", "factors"])

        names = entities.groupBy("block", F.floor(F.col("place") / size).cast("int").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", key))), lambda m: m[key]).alias("keys"))
        vectors = rows.groupBy("block", "chunk").agg(F.collect_list(F.struct("seed", "payload")).alias("parts"))  # as many as seeds
        return names.join(vectors, ["block", "chunk"]).mapInArrow(run, schema)

    def _mean_of_copies(self, rows: DataFrame, entities: DataFrame, key: str, kind: int, schema: str) -> DataFrame:
        width, seeds, rank, bias = self.width, len(self.seeds), self.rank, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, own = np.empty((batch.num_rows, seeds * rank)), np.zeros(batch.num_rows)
                for row, parts in enumerate(batch.column("parts").to_pylist()):
                    total = sum(p["n"] for p in parts) / seeds
                    for seed in range(seeds):
                        mean = sum(p["n"] / total * np.frombuffer(p["payload"], np.float32).astype(np.float64) for p in parts if p["seed"] == seed)
                        out[row, seed * rank : (seed + 1) * rank] = mean[:rank]
                        own[row] += mean[-2 if kind == USERS else -1] / seeds if bias else 0.0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (seeds * rank)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(own), lists], [key, f"{key}_bias", "factors"])

        found = entities.join(self._vectors(rows), ["block", "place"]).groupBy(key).agg(F.collect_list(F.struct("seed", "n", "payload")).alias("parts"))
        return found.mapInArrow(run, schema)


def _part(number: int, seed: int, kind: int, block: int, chunk: int, vectors: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([x], pa.int32()) for x in (number, seed, kind, block, chunk)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([vectors.tobytes()], pa.binary())], NAMES)
