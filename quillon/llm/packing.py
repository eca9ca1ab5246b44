"""Best-fit packing with a grouping genetic algorithm, distributed as islands with elite migration.

Documents become id sequences (their ids, then a separator), and only those over the capacity are cut. Pieces are dealt by hash
to blocks of about ``BLOCK`` pieces. Each block is evolved on ``ISLANDS`` islands, tasks of their own with their own seeds. An
individual is a grouping of the block's pieces into bins; the first ones are best fits in random orders, and one in falling order.
Crossover injects the well-filled bins of one parent whole, keeps the bins of the other that share no piece with them (so duplicates
go), and places the displaced pieces: a piece may take the place of one or two shorter ones, the others go by best fit, largest first.
Fewer bins are fitter; among as many, the more uneven filling is, since that empties the last bins. After each epoch an island sends its elite to the next
one, which takes them in instead of its worst. An island stops only when nothing can be better (as few bins as the total
length allows, all of them full but one), when two thirds of its work made no progress, or when its work is done. That work is the same
for every island, whatever the number of blocks, so a block is evolved alike in small and large inputs. In the end the fittest grouping of
each block is taken; pieces of bins that are not well filled are pooled over all blocks and evolved once more.

Memory of a task is bounded by a block, and blocks do not depend on sources, copies or keys. Where ids are unique, the result does not depend on
how files are split.

Defined cases: a null or empty text is one piece with the separator alone; a long text is cut into full pieces, which are sequences of their own, and a
rest. Repeated rows are packed each. Null ids stay null. Ties go to the earlier piece in falling order of (length, id, piece). Other columns of the table,
whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, materialize, plain_ids
from quillon.llm.tokens import default_path, encoder, slices

CAPACITY, SEPARATOR = 2048, 0
#: Pieces a block, islands a block, epochs, individuals an island, and how full a bin must be to count as well filled.
BLOCK, ISLANDS, EPOCHS, POPULATION, WELL = 4096, 3, 2, 5, 0.97
#: Pieces that an island may handle in an epoch (a child's pieces, and once more those that it places), and as many of them without progress
#: after which it stops. They hold for each island of every block, whatever the number of blocks, so all sizes of input are searched alike.
WORK, SEARCH = 60_000, 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, doc_id array<long>, piece array<int>, start array<long>, length array<int>, crc array<long>, population array<array<int>>, elite array<array<int>>, children int, progress int, first_bins int"


def cut_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """A row a piece: place and checksum of its ids."""
    tokenizer, tail = tokenizer or default_path(), separator.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        enc, step = encoder(tokenizer), 4 * capacity
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = enc.encode(text) + tail
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    out.append((doc_id, i // step, i // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def best_fit(order, lengths, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put pieces, in this order, each into the fullest bin that has room, else into a new one."""
    free = sorted((r, i) for i, r in enumerate(room) if r)  # a full bin takes no piece
    for x in order:
        n = lengths[x]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, i = free.pop(at)
            bins[i].append(x)
        else:
            r, i = capacity, len(bins)
            bins.append([x])
            room.append(capacity)
        room[i] = r - n
        if r > n:
            insort(free, (r - n, i))


def fitness(room: list[int], capacity: int) -> tuple:
    """Fewer bins first, then the more uneven filling."""
    return -len(room), sum((capacity - r) ** 2 for r in room)


class Island:
    """A population of groupings of one block's pieces, fittest first: (fitness, bins, room left in each).

    Full bins are never changed, so individuals share them.
    """

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, Random(seed)
        self.order = sorted(range(len(lengths)), key=lambda x: (-lengths[x], x))
        self.least = -(-sum(lengths) // capacity)
        self.people: list[tuple] = []
        self.children = self.progress = self.placed = 0  # crossovers, and those whose child was fitter than all before

    def add(self, bins: list[list[int]], room: list[int] | None = None) -> bool:
        """Take an individual in, whose room may be known; tells whether it is the fittest so far."""
        if room is None:
            room = [self.capacity - sum(self.lengths[x] for x in b) for b in bins]
        new = (fitness(room, self.capacity), bins, room)
        better = not self.people or new[0] > self.people[0][0]
        self.people.append(new)
        self.people.sort(key=lambda p: p[0], reverse=True)
        return better

    def start(self, count: int) -> None:
        """Best fit in falling order, and in orders that are more and more random."""
        for i in range(count):
            noise = [n * self.random.uniform(1 - i / count, 1) for n in self.lengths] if i else self.lengths
            bins: list[list[int]] = []
            best_fit(sorted(self.order, key=lambda x: -noise[x]), self.lengths, bins, [], self.capacity)
            self.add(bins)

    def done(self) -> bool:
        """Nothing can be fitter: as few bins as can be, and all of them full but one."""
        return bool(self.people) and len(self.people[0][1]) <= self.least and sum(r > 0 for r in self.people[0][2]) <= 1

    def child(self, a: tuple, b: tuple) -> tuple[list[list[int]], list[int]]:
        """Bins and their room: well-filled bins of ``a`` whole, bins of ``b`` without their pieces, and best fit for what is displaced (``placed`` pieces)."""
        draw = self.random.random
        spare = self.capacity * (1 - WELL) * draw() ** 2
        share = self.random.uniform(0.3, 1)
        kept = [(g, r) for g, r in zip(a[1], a[2], strict=True) if r <= spare and draw() < share]
        taken = set().union(*(g for g, _ in kept))
        free = taken.isdisjoint  # bins of one parent share nothing, so those of ``b`` meet the pieces of ``a`` alone
        kept += [(g, r) for g, r in zip(b[1], b[2], strict=True) if free(g) and (r <= spare or draw() < 0.5)]
        bins, room = [g for g, _ in kept], [r for _, r in kept]
        taken.update(*bins)
        displaced = [x for x in self.order if x not in taken]
        opened = [i for i, r in enumerate(room) if r]
        for i in opened:
            bins[i] = list(bins[i])
        best_fit(self.exchange(displaced, bins, room, opened), self.lengths, bins, room, self.capacity)
        self.placed = len(displaced)
        return bins, room

    def exchange(self, displaced: list[int], bins: list[list[int]], room: list[int], opened: list[int]) -> list[int]:
        """A displaced piece takes the place of one or two shorter pieces of a bin where that leaves the least room; returned is what is displaced then."""
        lengths, places = self.lengths, []
        for i in opened:
            for j, x in enumerate(bins[i]):
                places.append((lengths[x] + room[i], lengths[x], i, (x,)))
                places += [(lengths[x] + lengths[y] + room[i], lengths[x] + lengths[y], i, (x, y)) for y in bins[i][j + 1 : j + 4]]
        places.sort()
        left, changed = [], set()
        for x in displaced:
            n = lengths[x]
            at = bisect_left(places, (n,))
            for _, old, i, gone in places[at : at + 6]:
                if i not in changed and old < n:
                    bins[i] = [y for y in bins[i] if y not in gone] + [x]
                    room[i] -= n - old
                    changed.add(i)
                    left += gone
                    break
            else:
                left.append(x)
        return sorted(left, key=lambda x: (-lengths[x], x))

    def evolve(self, work: int, most: int, stall: int | None = None) -> None:
        """Children of random couples, until nothing can be fitter, or ``work`` pieces were handled, or ``stall`` of them (a third) without progress."""
        idle, stall = 0, work // 3 if stall is None else stall
        while work > 0 and idle < stall and len(self.people) > 1 and not self.done():
            a, b = self.random.sample(self.people, 2)
            better = self.add(*self.child(a, b))
            while len(self.people) > most:  # the worst goes, or the older of two alike
                twins = [i for i in range(1, len(self.people)) if self.people[i][0] == self.people[i - 1][0]]
                del self.people[twins[-1] if twins else -1]
            self.children += 1
            self.progress += better
            cost = self.placed + len(self.lengths)
            idle = 0 if better else idle + cost
            work -= cost


def _numbers(bins: list[list[int]], count: int) -> list[int]:
    out = [0] * count
    for i, g in enumerate(bins):
        for x in g:
            out[x] = i
    return out


def _bins(numbers) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for x, i in enumerate(numbers):
        out.setdefault(int(i), []).append(x)
    return list(out.values())


def evolve_blocks(pieces: DataFrame, blocks: int, salt: int, capacity: int, *, unique: bool = True) -> DataFrame:
    """A row an island of each block, with its last population: STATE."""
    members = F.array_sort(F.collect_list(F.struct("doc_id", "piece", "start", "length", "ids_crc32")))
    apart = [] if unique else [F.monotonically_increasing_id()]  # rows that agree in everything must not share a block
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", *apart, F.lit(salt)), F.lit(blocks)))
    state = dealt.groupBy("block").agg(members.alias("m")).select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.col("m.doc_id").alias("doc_id"),
        F.col("m.piece").alias("piece"),
        F.col("m.start").alias("start"),
        F.col("m.length").cast("array<int>").alias("length"),
        F.col("m.ids_crc32").alias("crc"),
        F.array().cast("array<array<int>>").alias("population"),
        F.array().cast("array<array<int>>").alias("elite"),
        *(F.lit(0).alias(c) for c in ("children", "progress", "first_bins")),
    )

    work, stall = WORK, SEARCH
    changed = ["block", "island", "length", "population", "elite", "children", "progress", "first_bins"]  # the others pass as they are

    def epoch(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(changed).to_pylist()[0]
                lengths = row.pop("length")
                island = Island(lengths, capacity, zlib.crc32(f"{row['block']},{row['island']},{row['children']},{salt}".encode()))
                for numbers in row["population"] + row["elite"]:
                    island.add(_bins(numbers))
                if not island.people:
                    island.start(POPULATION)
                    row["first_bins"] = len(island.people[0][1])
                del island.people[POPULATION:]
                island.evolve(work, POPULATION, stall)
                row["children"] += island.children
                row["progress"] += island.progress
                row["population"] = [_numbers(p[1], len(lengths)) for p in island.people]
                row["elite"] = row["population"][:1]
                columns = [pa.array([row[f.name]], f.type) if f.name in row else one.column(f.name) for f in batch.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    spread = min(-(-blocks * ISLANDS // 4), 4000)  # a few islands a task; which ones decides nothing
    for i in range(EPOCHS):
        state = state.repartition(spread, "block", "island").mapInArrow(epoch, STATE)
        state = materialize(state, f"islands{i}")
        if i + 1 < EPOCHS:
            sent = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), "elite")
            state = state.drop("elite").join(sent, ["block", "island"]).select(*state.columns)

    return state


def statistics(state: DataFrame) -> DataFrame:
    """What the evolution did to each block: crossovers, those that made progress, bins of the first best fit and of the fittest grouping."""
    bins = F.array_size(F.array_distinct(F.get("population", F.lit(0))))
    return state.groupBy("block").agg(
        F.sum("children").alias("children"), F.sum("progress").alias("progress"), F.min("first_bins").alias("first_bins"), F.min(bins).alias("bins")
    )


def fittest(state: DataFrame, capacity: int) -> DataFrame:
    """(pieces' columns, sequence_id): the fittest grouping of each block."""
    import pyarrow as pa

    out = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int64()), ("score", pa.int64())])

    def settle(batches):
        """The first individual is the fittest of its island; islands of a block are compared by the caller."""
        for batch in batches:
            for row in batch.select(["block", "island", "length", "population"]).to_pylist():
                bins = _bins(row["population"][0])
                room = [capacity - sum(row["length"][x] for x in g) for g in bins]
                score = fitness(room, capacity)
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "island": row["island"], "bins": score[0], "score": score[1]}], schema=out)

    scores = state.mapInArrow(settle, "block long, island int, bins long, score long")
    best = scores.groupBy("block").agg(F.max(F.struct("bins", "score", (-F.col("island")).alias("i"))).alias("b"))
    best = best.select("block", (-F.col("b.i")).alias("island"))
    rows = state.join(best, ["block", "island"]).select(
        "block", F.explode(F.arrays_zip("doc_id", "piece", "start", "length", "crc", F.get("population", F.lit(0)).alias("bin"))).alias("x")
    )
    return rows.select(
        F.col("x.doc_id").alias("doc_id"),
        F.col("x.piece").alias("piece"),
        F.col("x.start").alias("start"),
        F.col("x.length").cast("long").alias("length"),
        F.col("x.crc").alias("ids_crc32"),
        (F.col("block") * (1 << 20) + F.col("x.bin")).alias("sequence_id"),
    )


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = materialize(cut_documents(docs, tokenizer=tokenizer, capacity=capacity), "pieces")
    return pack_pieces(pieces, capacity=capacity, block=block)


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Stored pieces (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    from pyspark.sql import Window

    unique = plain_ids(pieces.where("piece = 0").select("doc_id"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == capacity)  # a full piece is a sequence of its own
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    first = materialize(fittest(evolve_blocks(rest, blocks, 1, capacity, unique=unique), capacity), "packed")
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    poor = F.col("fill") < int(WELL * capacity)
    filled = materialize(first.join(fill, "sequence_id"), "filled")
    pooled = filled.where(poor).select(*columns)
    again = fittest(evolve_blocks(pooled, max(1, -(-pooled.count() // block)), 2, capacity, unique=unique), capacity) if blocks > 1 else None
    kept = filled.where(~poor) if again is not None else filled
    number = [kept.select(*columns, (F.col("sequence_id") * 4).alias("sequence_id"))]
    if again is not None:
        number.append(again.select(*columns, (F.col("sequence_id") * 4 + 1).alias("sequence_id")))
    out = number[0]
    for more in number[1:]:
        out = out.unionByName(more)
    place = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("offset", F.sum("length").over(place) - F.col("length"))
    single = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 4 + 2).withColumn("offset", F.lit(0).cast("long"))
    return out.unionByName(single)
