"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens (only longer ones are cut; a first
piece takes what is left over).  Pieces are dealt into shards by a hash; each shard is
packed on its own, so no task holds more than about `SHARD` pieces.  A shard starts
with best-fit decreasing.  Where that does not meet a proven lower bound (Martello and
Toth's L2), `ISLANDS` populations evolve it: crossover injects whole well-filled bins of
one parent into the other, bins that hold a piece twice are dissolved, and mutation
dissolves the weakest and some other bins.  Displaced pieces first take the places of
one or two smaller ones where that fills a bin better (Falkenauer's replacement), then
are put back by best fit.  After every epoch each island's elite takes the place of the
worst in the next island of the ring, through a shuffle; after the last the best packing
of a shard is taken.  Bins that best fit fills to the last token stay out of the search,
but for as many of them as there are others.  A shard's weakest bins are dissolved into a
second, pooled round, so the shards' unfilled ends are packed together.

Cases: a null or empty text is one piece with the end id; a null doc_id is a document
like any other; repeated rows are packed each; no rows give no pieces; other columns of
the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common, tokens

SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8_192, 2, 2, 12, 4
#: Generations without a better packing after which an epoch ends; pieces of a bin up to
#: which pairs are taken out, and displaced pieces that are paired at once.
STALE, PAIRED_BIN, PAIRED = 6, 8, 48
#: Bins filled at least this far are injected by crossover; the pooled round takes bins below it.
WELL = 0.995
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length and the crc32 of its ids."""
    common.bounded_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encode = tokens.encoder(tokenizer).ids
        out: list[tuple] = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = memoryview(encode(text.as_py()) + end)
            n = len(x) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out += [(doc_id, k, i, j - i, zlib.crc32(x[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return common.arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, PIECE)


# -- one shard ---------------------------------------------------------------------


def lower_bound(size: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins (the L2 bound)."""
    count = np.bincount(size, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for k in range(half + 1):
        alone = int(n[-1] - n[capacity - k])
        large, large_sum = int(n[capacity - k] - n[half]), int(total[capacity - k] - total[half])
        small_sum = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small_sum - (large * capacity - large_sum)) // capacity)))
    return best


def best_fit(size: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, largest first, each into the fullest bin that has room, else a new one."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, b in enumerate(bins):
        room = capacity - sum(size[i] for i in b)
        if room:
            free[room].append(k)
            mask |= 1 << room
    for i in sorted(items, key=lambda i: -size[i]):
        s = size[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if left := room - s:
            free[left].append(k)
            mask |= 1 << left
    return bins


def loads_of(size: list[int], bins: list[list[int]]) -> list[int]:
    return [sum([size[i] for i in b]) for b in bins]


def fitness(size: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Less is better: bins, then Falkenauer's mean squared fill, negated."""
    fill = np.array(loads_of(size, bins)) / capacity
    return len(bins), -float((fill**2).mean()) if len(bins) else 0.0


def replaced(size: list[int], bins: list[list[int]], out: list[int], capacity: int, rng: np.random.Generator) -> list[int]:
    """Put one or two displaced pieces in the place of one or two smaller ones, wherever a bin
    comes out fuller; returns what is displaced then.  Every swap fills bins, so it ends."""
    out = sorted(out, key=size.__getitem__)
    loads = loads_of(size, bins)

    def sums() -> tuple[list[int], list[int], np.ndarray]:
        own = np.array([size[i] for i in out])
        few = np.sort(rng.permutation(len(out))[:PAIRED])
        x, y = np.triu_indices(len(few), 1)
        both = own[few[x]] + own[few[y]]
        order = np.argsort(both, kind="stable")
        return own.tolist(), both[order].tolist(), np.stack([few[x][order], few[y][order]], axis=1)

    one, two, which = sums()
    for k in rng.permutation(len(bins)).tolist():
        room = capacity - loads[k]
        if not room or not out:
            continue
        b = bins[k]
        takes = [(size[i], (i,)) for i in b]
        if len(b) <= PAIRED_BIN:
            takes += [(size[i] + size[j], (i, j)) for n, i in enumerate(b) for j in b[n + 1 :]]
        best, swap = 0, None
        for s, take in takes:
            at = bisect_right(one, s + room) - 1
            if at >= 0 and one[at] - s > best:
                best, swap = one[at] - s, (take, [at])
            at = bisect_right(two, s + room) - 1
            if at >= 0 and two[at] - s > best:
                best, swap = two[at] - s, (take, which[at].tolist())
            if best == room:
                break
        if swap:
            take, put = swap
            bins[k] = [i for i in b if i not in take] + [out[i] for i in put]
            loads[k] += best
            out = sorted([x for i, x in enumerate(out) if i not in put] + list(take), key=size.__getitem__)
            one, two, which = sums()
    return out


def crossover(size: list[int], a: list[list[int]], b: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled bins of b into a, dissolve bins with duplicates, replace, best-fit the displaced."""
    by_fill = sorted(zip(loads_of(size, b), range(len(b)), strict=True), reverse=True)
    full = [b[k] for load, k in by_fill if load >= WELL * capacity] or [b[k] for _, k in by_fill[: max(1, len(b) // 2)]]
    share = rng.uniform(0.1, 0.5)
    new = [list(full[k]) for k in np.flatnonzero(rng.random(len(full)) < share)]
    taken = {i for x in new for i in x}
    displaced: list[int] = []
    for x in a:
        if taken.isdisjoint(x):
            new.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return mutated(size, new, displaced, capacity, rng)


def mutated(size: list[int], bins: list[list[int]], displaced: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolve the weakest bins and a few others, replace and best-fit all displaced pieces."""
    loads = loads_of(size, bins)
    short = [k for k in np.argsort(loads, kind="stable").tolist() if loads[k] < capacity]
    gone = set(short[: 1 + len(bins) // 50])
    if bins:
        gone |= set(rng.integers(0, len(bins), 1 + len(bins) // 50).tolist())
    left = [x for k, x in enumerate(bins) if k not in gone]
    displaced = displaced + [i for k in gone for i in bins[k]]
    return best_fit(size, replaced(size, left, displaced, capacity, rng), left, capacity)


def _assign(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<u4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(data: bytes) -> list[list[int]]:
    which = np.frombuffer(data, "<u4")
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(which) else []


def evolve(size: list[int], seeds: list[list[list[int]]], capacity: int, seed: int) -> list[list[list[int]]]:
    """One epoch of one island: its population afterwards, best first."""
    rng, bound = np.random.default_rng(seed), lower_bound(np.array(size), capacity)
    population = [(fitness(size, b, capacity), b) for b in seeds]
    while len(population) < POPULATION:  # first fits in a shuffled order, by noise on the sizes
        noise = np.array(size) * rng.uniform(0.9, 1.1, len(size))
        bins: list[list[int]] = []
        for part in np.array_split(np.argsort(-noise), 8):
            bins = best_fit(size, part.tolist(), bins, capacity)
        population.append((fitness(size, bins, capacity), bins))
    population.sort(key=lambda x: x[0])
    population, stale = population[:POPULATION], 0
    for _ in range(GENERATIONS):
        if population[0][0][0] <= bound or stale >= STALE:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False).tolist())
        a, b = (i, j) if rng.random() < 0.5 else (j, i)
        child = crossover(size, population[a][1], population[b][1], capacity, rng)
        fit = fitness(size, child, capacity)
        stale = 0 if fit < population[0][0] else stale + 1
        if fit < population[-1][0] and all(fit != f for f, _ in population):
            population[-1] = (fit, child)
            population.sort(key=lambda x: x[0])
    return [b for _, b in population]


def searched(size: list[int], bins: list[list[int]], capacity: int, seed: int) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """(pieces, their bins, all other bins) of a packing: what the search works on.  Pieces are
    those of all bins with room, and of as many full ones, picked by chance."""
    loads = np.array(loads_of(size, bins))
    short, full = np.flatnonzero(loads < capacity), np.flatnonzero(loads == capacity)
    also = np.random.default_rng(seed).permutation(full)[: len(short)]
    work = set(short.tolist()) | set(also.tolist())
    mine = [x for k, x in enumerate(bins) if k in work]
    return sorted(i for x in mine for i in x), mine, [x for k, x in enumerate(bins) if k not in work]


# -- all shards --------------------------------------------------------------------

_ORDER = ["doc_id", "piece", "start", "length", "ids_crc32"]
_STATE = "shard long, island int, rank int, open boolean, n_bins int, fill double, bins binary"


def _state(shard: int, island: int, size: list[int], packings: list[list[list[int]]], capacity: int) -> pd.DataFrame:
    bound, rows = lower_bound(np.array(size), capacity), []
    for rank, bins in enumerate(packings):
        n, fill = fitness(size, bins, capacity)
        rows.append([shard, island, rank, n > bound, n, fill, _assign(bins, len(size))])
    return pd.DataFrame(rows, columns=["shard", "island", "rank", "open", "n_bins", "fill", "bins"])


def epoch_of(size: list[int], packings: list[list[list[int]]], capacity: int, seed: int, cut: int) -> list[list[list[int]]]:
    """An epoch on the part of a shard that is searched.  All islands of a shard cut it alike,
    from its first packing, which `packings` ends with; the rest of the shard stays."""
    pieces, mine, rest = searched(size, packings[-1], capacity, cut)
    place = {i: k for k, i in enumerate(pieces)}
    inside = [[[place[i] for i in x] for x in b if x[0] in place] for b in packings]
    grown = evolve([size[i] for i in pieces], inside, capacity, seed)
    return [[[pieces[i] for i in x] for x in b] + rest for b in grown]


def _pack_shards(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """items with (shard, PIECE columns) -> those and (bin, offset, load)."""

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = rows.sort_values(_ORDER)["length"].tolist()
        return _state(int(key[0]), 0, size, [best_fit(size, list(range(len(size))), [], capacity)], capacity)

    def epoch(key: tuple, rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        size = rows.sort_values(_ORDER)["length"].tolist()
        packings = [_bins(x) for x in seeds.sort_values(["start", "rank", "from"])["bins"]]
        out = epoch_of(size, packings, capacity, seed + 7919 * shard + 104_729 * int(seeds["epoch"].iloc[0]) + island, seed + shard)
        return _state(shard, island, size, out, capacity)

    begun = common.kept(items.groupBy("shard").applyInPandas(first, _STATE), "packing-first")
    ring = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    best, state = begun, None
    for e in range(EPOCHS):
        todo = begun.where("open").select("shard") if state is None else state.groupBy("shard").agg(F.bool_and("open").alias("open")).where("open").select("shard")
        if todo.isEmpty():
            break
        columns = ["shard", "island", "rank", "bins"]
        seeds = begun.join(todo, "shard", "left_semi").withColumn("island", ring).select(*columns, F.lit(True).alias("start"), F.lit(-1).alias("from"))
        if state is not None:  # the population stays, but for its worst, which the elite of the island before replaces
            alive = state.join(todo, "shard", "left_semi")
            seeds = seeds.union(alive.where(F.col("rank") < POPULATION - 1).select(*columns, F.lit(False), F.lit(0)))
            seeds = seeds.union(alive.where("rank = 0").select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "rank", "bins", F.lit(False), F.lit(1)))
        seeds = seeds.withColumn("epoch", F.lit(e))
        own = items.join(todo, "shard", "left_semi").withColumn("island", ring)
        state = common.kept(own.groupBy("shard", "island").cogroup(seeds.groupBy("shard", "island")).applyInPandas(epoch, _STATE), "packing-epoch")
        best = best.unionByName(state.where("rank = 0"))
    chosen = best.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "fill", "island")).alias("bins"))

    def place(key: tuple, rows: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_ORDER).reset_index(drop=True)
        if not len(rows):
            return pd.DataFrame(columns=[*rows.columns, "bin", "offset", "load"])
        rows["bin"] = np.frombuffer(bins["bins"].iloc[0], "<u4").astype(np.int64)
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        rows["load"] = rows.groupby("bin")["length"].transform("sum")
        return rows

    return items.groupBy("shard").cogroup(chosen.groupBy("shard")).applyInPandas(place, f"shard long, {PIECE}, bin long, offset long, load long")


def pack(items: DataFrame, capacity: int, seed: int = 1) -> DataFrame:
    """Sequences for pieces (the columns of `pieces`): adds sequence_id and offset."""
    n = items.count()

    def dealt(df: DataFrame, rows: int, salt: int) -> DataFrame:
        shards = max(1, -(-rows // SHARD))
        return df.select(F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(shards)).alias("shard"), *_ORDER)

    full = items.where(F.col("length") == capacity).select(*_ORDER, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = common.kept(_pack_shards(dealt(items.where(F.col("length") < capacity), n, 0), capacity, seed), "packed")
    poor = F.col("load") < WELL * capacity
    number = (F.shiftleft(F.col("shard"), 32) + F.col("bin")) * 2
    good = packed.where(~poor).select(*_ORDER, number.alias("sequence_id"), "offset")
    rest = packed.where(poor)
    again = _pack_shards(dealt(rest, rest.count(), 1), capacity, seed + 1)
    return full.unionByName(good).unionByName(again.select(*_ORDER, (number + 1).alias("sequence_id"), "offset"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed_documents(common.documents(spark, sf_dir))


def packed_documents(docs: DataFrame) -> DataFrame:
    rows = common.kept(pieces(docs, common.tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024), "pieces")
    return pack(rows, 1024).withColumn("length", F.col("length").cast("long"))
