"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt into groups of bounded size. A group is packed by several islands: an island holds a
population of packings, crossover injects whole well-filled bins of one parent into another, drops the
bins that would hold a document twice, and best-fits the documents thus displaced. Islands run as
separate tasks and send their best packing to the next island between rounds. Bins that stay loose are
opened again and their pieces packed together at the next level, with those of other groups.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import freed, need, shuffle_partitions, staged
from cladeframe.llm.tokens import default_tokenizer, encoder, slices

CAPACITY = 4096
END_ID = 1
#: Bytes of text that a worker tokenises at once.
TEXT_BYTES = 4 << 20
#: Pieces in a group, on average.
GROUP = 4096
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 6
POPULATION = 5
#: Bins filled below this share are opened again at the next level.
LOOSE = 0.98
#: A level that saves no more than this share of the bins it opened is the last.
LEAST_SAVED = 0.001

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32.

    A document's ids are those of its whole text and END_ID; null and empty texts have END_ID alone.
    Only documents of more than capacity ids are cut. Repeated rows give repeated pieces.
    """
    need(docs, "doc_id", "text")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1), TEXT_BYTES):
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[first:], words.ids(texts), strict=False):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(freed(run), PIECE_SCHEMA)


class Packing:
    """Bins over the items of one group: the bin of each item, and what each bin holds."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def copy_bins(self, bins: list[list[int]]) -> None:
        self.bins = [list(b) for b in bins]
        self.room = [self.capacity - sum(self.lengths[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the bin with the least room that suffices, or into a new one."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, r in enumerate(self.room):
            if r > 0:
                by_room[r].append(b)
                mask |= 1 << r
        lengths = self.lengths
        for i in items:
            n = lengths[i]
            fits = mask >> n
            if fits:
                r = (fits & -fits).bit_length() - 1 + n
                b = by_room[r].pop()
                if not by_room[r]:
                    mask ^= 1 << r
                self.bins[b].append(i)
            else:
                b, r = len(self.bins), self.capacity
                self.bins.append([i])
                self.room.append(r)
            left = r - n
            self.room[b] = left
            if left > 0:
                if not by_room[left]:
                    mask |= 1 << left
                by_room[left].append(b)

    def worth(self) -> tuple[int, int]:
        """Few bins first; of equal numbers the one that fills some bins and leaves others open."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)

    def assignment(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def packing_of(assignment: list[int], lengths: list[int], capacity: int) -> Packing:
    p = Packing(lengths, capacity)
    bins: list[list[int]] = [[] for _ in range(max(assignment, default=-1) + 1)]
    for i, b in enumerate(assignment):
        bins[b].append(i)
    p.copy_bins([b for b in bins if b])
    return p


def first_population(lengths: list[int], capacity: int, size: int, rng: random.Random) -> list[Packing]:
    """Best fit in falling order, then in orders that a little noise has changed."""
    people: list[Packing] = []
    for k in range(size):
        noise = 0.0 if k == 0 else 0.1 * k
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + noise * rng.random()))
        p = Packing(lengths, capacity)
        p.best_fit(order)
        people.append(p)
    return people


def crossover(into: Packing, donor: Packing, rng: random.Random) -> Packing:
    """A child of into that holds some well-filled bins of donor whole.

    Bins of into that hold one of their documents are opened, and so are its loosest ones; the documents thus
    displaced are best-fitted, the longest first.
    """
    full = sorted(range(len(donor.bins)), key=donor.room.__getitem__)
    full = full[: max(1, len(full) // 2)]
    some = rng.sample(full, max(1, len(full) // 3))
    held = {i for b in some for i in donor.bins[b]}
    loosest = set(sorted(range(len(into.bins)), key=into.room.__getitem__, reverse=True)[: rng.randint(1, 4)])
    child = Packing(into.lengths, into.capacity)
    child.bins = [list(donor.bins[b]) for b in some]
    child.room = [donor.room[b] for b in some]
    displaced = []
    for b, items in enumerate(into.bins):
        if b not in loosest and held.isdisjoint(items):
            child.bins.append(list(items))
            child.room.append(into.room[b])
        else:
            displaced += [i for i in items if i not in held]
    child.best_fit(sorted(displaced, key=lambda i: -child.lengths[i]))
    return child


def evolve(people: list[Packing], generations: int, rng: random.Random) -> list[Packing]:
    """So many generations; in each, the best of parents and children stay. The best packing never gets worse."""
    people = sorted(people, key=Packing.worth, reverse=True)
    for _ in range(generations):
        children = []
        for _ in range(max(1, len(people) // 2)):
            a, b = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
            children.append(crossover(a, b, rng))
        people = sorted(people + children, key=Packing.worth, reverse=True)[: len(people)]
    return people


ISLAND_SCHEMA = "grp long, island int, lengths array<int>, people array<array<int>>"
PACKED_SCHEMA = "mid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, opened boolean"


def _island_round(capacity: int, number: int, islands: int, generations: int, population: int, last: bool):
    """One island's round: its own row, and from the second round on the best packing of the island before it."""

    def run(table: pa.Table) -> pa.Table:
        grp, island = table.column("grp")[0].as_py(), table.column("island")[0].as_py()
        rng = random.Random(f"{grp}/{island}/{number}")
        rows = sorted(zip(table.column("lengths").to_pylist(), table.column("people").to_pylist(), strict=True), key=lambda r: r[0] is None)
        lengths = rows[0][0]
        people = [packing_of(p, lengths, capacity) for _, some in rows for p in some]
        best = evolve(people or first_population(lengths, capacity, population, rng), generations, rng)
        elite = [best[0].assignment()]
        if last:
            out = [(grp, island, None, elite)]
        else:
            out = [(grp, island, lengths, [p.assignment() for p in best[:population]]), (grp, (island + 1) % islands, None, elite)]
        types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["grp", "island", "lengths", "people"])

    return run


def _settle(capacity: int, loose: float, level: int):
    """A group's pieces with their places in the best packing of its islands, and whether their bin is loose."""

    def run(table: pa.Table) -> pa.Table:
        at = next(i for i, row in enumerate(table.column("items")) if row.is_valid)
        items = table.column("items")[at].values
        lengths = items.field("length").to_pylist()
        elites = [e for e in table.column("elite").to_pylist() if e is not None]
        best = max((packing_of(e, lengths, capacity) for e in elites), key=Packing.worth)
        n = len(lengths)
        bins, offsets, opened = [0] * n, [0] * n, [False] * n
        for b, own in enumerate(best.bins):
            place = 0
            slack = capacity - best.room[b] < loose * capacity
            for i in own:
                bins[i], offsets[i], opened[i] = b, place, slack
                place += lengths[i]
        base = (level << 56) + (table.column("grp")[0].as_py() << 24)
        names = ["mid", "doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.table(
            [*(items.field(x) for x in names), pa.array(np.array(bins, np.int64) + base), pa.array(offsets, pa.int64()), pa.array(opened, pa.bool_())],
            names=[*names, "sequence_id", "offset", "opened"],
        )

    return run


def _pack_level(pieces: DataFrame, groups: int, level: int, capacity: int, islands: int, rounds: int, generations: int, population: int) -> DataFrame:
    spark = pieces.sparkSession
    # Fixed counts of partitions: the rows are few and small, their work is not.
    tasks = max(1, min(groups * islands, 4 * shuffle_partitions(spark)))
    one = F.struct((-F.col("length")).alias("order"), "mid", "doc_id", "piece", "start", "length", "ids_crc32")
    # mid numbers rows, so groups are of near equal size whatever the documents hold.
    grouped = staged(
        pieces.groupBy(F.pmod(F.xxhash64("mid", F.lit(level)), F.lit(groups)).alias("grp")).agg(F.sort_array(F.collect_list(one)).alias("items")),
        f"pack-groups-{level}",
    )
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    state = grouped.select("grp", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), lengths.alias("lengths"), F.array().cast("array<array<int>>").alias("people"))
    for number in range(rounds):
        # One exchange a round: an island meets its own packings and the best of the island before it.
        turn = _island_round(capacity, number, islands, generations, population, number == rounds - 1)
        state = state.repartition(tasks, "grp", "island").groupBy("grp", "island").applyInArrow(turn, ISLAND_SCHEMA)
    items = grouped.schema["items"].dataType
    elites = state.select("grp", F.lit(None).cast(items).alias("items"), F.element_at("people", 1).alias("elite"))
    both = grouped.select("grp", "items", F.lit(None).cast("array<int>").alias("elite")).unionByName(elites)
    tasks = max(1, min(groups, 4 * shuffle_partitions(spark)))
    return both.repartition(tasks, "grp").groupBy("grp").applyInArrow(_settle(capacity, LOOSE, level), PACKED_SCHEMA)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) a sequence_id and an offset there.

    No sequence holds more than capacity tokens; offsets are gapless from 0. Pieces of the same length,
    repeated rows among them, are packed like any others. An empty table gives an empty result. A level that saves no more than
    LEAST_SAVED of the bins opened for it is the last, so lengths that fill no bin take two levels.
    """
    left = staged(pieces.withColumn("mid", F.monotonically_increasing_id()), "pack-pieces", texts=True)
    done, before, given, level = None, None, None, 0
    while True:
        groups = max(1, -(-left.count() // group))
        packed = staged(_pack_level(left, groups, level, capacity, islands, rounds, generations, population), f"pack-level-{level}")
        bins, open_bins = packed.agg(F.countDistinct("sequence_id"), F.countDistinct(F.when(F.col("opened"), F.col("sequence_id")))).first()
        # Loose bins are opened for another mixture of groups as long as that saves some.
        last = groups == 1 or open_bins == 0 or (given is not None and given - bins <= LEAST_SAVED * given)
        # A last level that took more bins than it was given counts for nothing.
        kept = before if last and given is not None and bins > given else packed if last else packed.where(~F.col("opened"))
        kept = kept.drop("opened", "mid")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        before, given = packed.where("opened"), open_bins
        left = before.drop("opened", "sequence_id", "offset")
        level += 1


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place; null texts are an end token, repeated rows are packed each, an empty table gives no row."""
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
