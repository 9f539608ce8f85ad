"""Packing documents into as few sequences as possible by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of ``capacity`` ids, of which only a document's first may be
shorter. Full pieces are sequences of their own. The others are dealt to cells of ``CELL`` pieces as they are read. For each cell several islands evolve
a population of packings: crossover injects whole well-filled bins, dissolves the bins that hold a
piece twice, and adds displaced pieces by best fit. Between epochs the best packings of each island migrate
to the next. A cell whose packing reaches the lower bound is proven best and stops at once. Bins that a
first level leaves poorly filled are dissolved, and their pieces packed again in cells of a second level, so
that cells waste no bin each.

How it scales: tokenising is a map; only (cell, number, length) rows are shuffled, one row of some KB
per cell and packing. Cells are bounded by a constant and independent of keys, so no source or group of
copies matters. Seeds follow from cell, island and epoch, so a lost task is repeated with the same result.

Null texts count as empty: one piece of one id. Repeated rows are packed as often as they occur.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import bins as B
from barloom.llm import tokens as T
from barloom.llm.ship import by_value
from barloom.session import written

by_value(__name__)

CAPACITY = 2048
CELL = 8192
ISLANDS = 2
POPULATION = 4
GENERATIONS = 12
ELITES = 1
FULL = 0.97
#: sequences are numbered (cell * CELL + bin) * 4 + level; full pieces have level 3
PER_PARTITION = 1 << 22

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, cell long, number int, sequence_id long"
PACKINGS = "cell long, island int, lengths array<int>, packing array<int>, bins int, filled double"


def pieces_of(vocabulary: str, capacity: int):
    def run(batches):
        encode, partition = T.Encoder(vocabulary), TaskContext.get().partitionId()
        parts, full = 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text)
                for piece, (start, length) in enumerate(T.cut_short_first(len(ids), capacity)):
                    row = [doc_id, piece, start, length, T.crc(ids[start : start + length])]
                    if length == capacity:
                        rows.append([*row, None, None, (partition * PER_PARTITION * CELL + full) * 4 + 3])
                        full += 1
                    else:
                        rows.append([*row, partition * PER_PARTITION + parts // CELL, parts % CELL, None])
                        parts += 1
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def as_bins(packing) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(max(packing)) + 1)] if len(packing) else []
    for item, n in enumerate(packing):
        out[n].append(item)
    return out


def as_row(cell, island, lengths, bins, capacity):
    packing = np.zeros(len(lengths), np.int32)
    for n, b in enumerate(bins):
        packing[b] = n
    count, filled = B.fitness(bins, lengths, capacity)
    return cell, island, lengths, packing.tolist(), count, filled


def settle(capacity: int, islands: int, population: int, generations: int, elites: int):
    """First epoch: rows (cell, island, lengths) to packings, the elites also for the next island."""
    def run(frames):
        for frame in frames:
            rows = []
            for cell, island, lengths in zip(frame["cell"], frame["island"], frame["lengths"]):
                lengths = [int(x) for x in lengths]
                bound, rng = B.lower_bound(lengths, capacity), np.random.default_rng([int(cell), int(island), 1])
                first = B.best_fit(lengths, B.descending(lengths), capacity, [])
                if len(first) <= bound:  # proven best
                    if island == 0:
                        rows.append(as_row(cell, 0, lengths, first, capacity))
                    continue
                found = B.evolve(B.start(lengths, capacity, population, rng), lengths, capacity, generations, rng, bound)
                rows += [as_row(cell, island, lengths, p, capacity) for p in found]
                rows += [as_row(cell, (island + 1) % islands, lengths, p, capacity) for p in found[:elites]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKINGS.split(", ")])

    return run


def resettle(capacity: int, generations: int):
    """Second epoch of one island with its immigrants: its best packing."""
    def run(frame):
        cell, island = int(frame["cell"][0]), int(frame["island"][0])
        lengths = [int(x) for x in frame["lengths"][0]]
        ordered = frame.sort_values(["bins", "filled"], kind="stable")
        bound, rng = B.lower_bound(lengths, capacity), np.random.default_rng([cell, island, 2])
        found = B.evolve([as_bins(p) for p in ordered["packing"]], lengths, capacity, generations, rng, bound)
        return pd.DataFrame([as_row(cell, island, lengths, found[0], capacity)], columns=[c.split()[0] for c in PACKINGS.split(", ")])

    return run


def pack_cells(items: DataFrame, capacity: int, level: int, keep: float, **search) -> DataFrame:
    """(cell, number, sequence_id, offset) of items (cell, number, length). Bins filled less than
    ``keep`` come back with a null sequence_id."""
    islands, generations = search["islands"], search["generations"]
    cells = items.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("number", "length"))).alias("held")).select(
        "cell", F.transform("held", lambda x: x["length"].cast("int")).alias("lengths"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
    )
    # a row is seconds of work: with a number of partitions the planner does not join them; beyond that number they hold several rows
    rows = items.select("cell").distinct().count() * islands
    tasks = max(1, min(rows, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    packings = written(
        cells.repartition(tasks, "cell", "island").mapInPandas(settle(capacity, islands, search["population"], generations, search["elites"]), PACKINGS),
        "packings",
    )
    better = packings.groupBy("cell", "island").applyInPandas(resettle(capacity, generations), PACKINGS)
    order = F.struct("bins", "filled", "island")
    best = better.groupBy("cell").agg(F.min_by(F.struct("lengths", "packing"), order).alias("p")).select("cell", "p.*")
    placed = best.select("cell", F.posexplode(F.arrays_zip("lengths", "packing")).alias("number", "p")).select("cell", "number", "p.lengths", "p.packing")
    # offsets: running sums inside a bin, which is at most as long as its cell
    inside = Window.partitionBy("cell", "packing")
    offset = F.sum("lengths").over(inside.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("lengths")
    number = ((F.col("cell") * CELL + F.col("packing")) * 4 + level).cast("long")
    return placed.select(
        "cell", "number", F.when(F.sum("lengths").over(inside) >= keep * capacity, number).alias("sequence_id"), offset.cast("long").alias("offset")
    )


def renumber(frames):
    """New cells for what is left over, in the order of the partition."""
    partition, seen = TaskContext.get().partitionId(), 0
    for frame in frames:
        at = np.arange(seen, seen + len(frame))
        seen += len(frame)
        yield frame.assign(cell=partition * PER_PARTITION + at // CELL, number=(at % CELL).astype("int32"))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = T.VOCABULARY, islands: int = ISLANDS, population: int = POPULATION,
         generations: int = GENERATIONS, elites: int = ELITES, full: float = FULL) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    search = {"islands": islands, "population": population, "generations": generations, "elites": elites}
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces_of(vocabulary, capacity), PIECES), "pieces")
    whole = pieces.where("cell is null").withColumn("offset", F.lit(0).cast("long")).select(*out)
    parts = pieces.where("cell is not null").drop("sequence_id")
    first = written(parts.join(pack_cells(parts, capacity, 0, full, **search), ["cell", "number"]), "packed")
    left = first.where("sequence_id is null").drop("sequence_id", "offset")
    n = left.count()
    done = whole.unionByName(first.where("sequence_id is not null").select(*out))
    if not n:
        return done
    names = [c for c in left.columns if c not in ("cell", "number")]
    again = written(
        left.repartition(max(1, n // (4 * CELL))).mapInPandas(renumber, left.schema).select("cell", "number", *names), "left"
    )
    second = again.join(pack_cells(again, capacity, 1, 0.0, **search), ["cell", "number"])
    return done.unionByName(second.select(*out))
