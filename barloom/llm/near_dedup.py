"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document's set are its distinct five-word shingles (64-bit hashes). A signature has ``PERMUTATIONS``
coordinates; a coordinate with its value is a token, and two documents that are similar enough share at
least ``MATCHES`` tokens, but for a chance of about 1e-5 at a similarity of exactly 0.75 and far less
above. By the pigeonhole principle such a pair also shares one of the first ``PERMUTATIONS - MATCHES + 1``
tokens of both documents in any common order. The order is rarest first, so that the long lists
(of passages that many documents share) are skipped when documents are posted. Candidates from those
prefixes have all their tokens counted, and what has enough matches is confirmed on the full sets.

Equal sets are one class from the start, so copies are never paired. In a posting list the most central
class (whose tokens are the most frequent) is compared with each other one, which is linear and links
the bulk of a group. Only classes whose lists still hold several components are looked at again: their
full sets are joined by prefixes whose length follows from the exact overlap that the two sizes need, and
only across components. So no link between components is lost, members of one component are never
compared, and classes that merely resemble each other meet only if they share rare shingles.

How it scales: texts are read once for signatures, and once more, in one shuffle, for the sets of the
classes that share a list. Counts of tokens combine before the shuffle; joins on tokens are plain
equi-joins whose skewed partitions the adaptive planner splits; a document has at most ``PERMUTATIONS``
postings.

Documents without words have an empty set, are linked with nothing and stay. Rows that share a doc_id
are one document. Null ids are linked like others but never name a component unless all are null. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.ship import by_value
from barloom.llm.text import apply_decisions, whole
from barloom.operators.perfile import with_group
from barloom.session import written

by_value(__name__)

PERMUTATIONS, MATCHES = 64, 32
PREFIX = PERMUTATIONS - MATCHES + 1
PERCENT = 75
WORDS = 5
PIECE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE = constants(256, 1)
POWER = np.concatenate([np.ones(1, U64), np.cumprod(np.full(4095, 0x9E3779B97F4A7C15 | 1, U64))])
PLACE = constants(WORDS, 2) | U64(1)
TIMES, PLUS, COORDINATE = constants(PERMUTATIONS, 3) | U64(1), constants(PERMUTATIONS, 4), constants(PERMUTATIONS, 5)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """Of every word of a lower-cased text, in pieces that end at a space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not SPACES[data[end]]:
            end += 1
        piece = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        inside = ~SPACES[piece]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            continue
        offsets = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
        value = BYTE[piece[inside]] * POWER[place & 4095]
        if lengths.max() > 4096:
            value = mix(value + (place >> 12).astype(U64) * U64(0xD6E8FEB86659FD93))
        out.append(mix(np.add.reduceat(value, offsets) + lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows; of all words if there are fewer."""
    words = word_hashes(data.lower())  # bytes: A-Z only
    if not len(words):
        return words
    n = min(WORDS, len(words))
    windows = sum(words[i : len(words) - n + 1 + i] * PLACE[i] for i in range(n))
    return np.unique(mix(windows + U64(n)))


def signature(values: np.ndarray) -> np.ndarray:
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(values), 2048):
        least = np.minimum(least, (values[at : at + 2048, None] * TIMES + PLUS).min(axis=0))
    return mix(least ^ COORDINATE)


def signatures_of(batches):
    for batch in batches:
        n, sets, tokens = [], [], []
        for text in batch.column("body").to_pylist():
            values = shingle_set(text)
            n.append(len(values))
            sets.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            tokens.append(signature(values).view(np.int64) if len(values) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
            ["doc_id", "print", "n_shingles", "class", "tokens"],
        )


def sets_of(batches):
    for batch in batches:
        sets = [shingle_set(text).view(np.int64) for text in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole("text")).alias("print"), whole("text").cast("binary").alias("body"))


def prefixes(classes: DataFrame) -> DataFrame:
    """(node, central, token): the prefix tokens that another class has too. The higher ``central``, the
    more frequent a class's tokens."""
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"), F.sum("df").alias("central")
    )
    # tokens of no other class come first in the order and take their share of the prefix
    room = F.lit(PREFIX - PERMUTATIONS) + F.size("held")
    return held.where(room > 0).select("node", "central", F.explode(F.slice("held", F.lit(1), room)).alias("h")).select(
        "node", "central", "h.token"
    )


def need(a: str, b: str):
    """The least overlap of two sets of these sizes that makes a link."""
    return F.ceil((F.col(a) + F.col(b)) * PERCENT / (100 + PERCENT))


def class_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) from the texts of the classes' first documents."""
    wanted = nodes.join(classes, "node").select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.print").alias("r_print"))
    body = bodies(docs)
    texts = body.join(wanted, body["doc_id"].eqNullSafe(wanted["r_id"]) & (body["print"] == wanted["r_print"]))
    # repeats of a row give the same set again
    return texts.select("node", "body").mapInArrow(sets_of, "node long, shingles array<bigint>").dropDuplicates(["node"])


def first_of_lists(posted: DataFrame) -> DataFrame:
    """Pairs of the most central class of a list with each other one."""
    lists = posted.groupBy("token").agg(F.max_by("node", F.struct("central", "node")).alias("a"))
    return posted.join(lists, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs with enough tokens in common."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    similar = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        similar & (F.size(F.array_intersect("t_a", "t_b")) >= MATCHES)
    ).select("a", "b")


def across_components(posted: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes in different components that may overlap enough, among those whose lists hold
    several components."""
    held = posted.select("node", "token").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = held.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    nodes = held.join(mixed, "token", "left_semi").select("node", "label").distinct()
    left = nodes.join(sets, "node").withColumn("n", F.size("shingles"))
    each = left.select("node", "label", "n", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(shared, "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    # shingles of no other class come first; nothing after a quarter of the set can be the first in common
    alone = F.col("n") - F.size("held")
    room = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - alone
    places = ordered.where(room > 0).select(
        "node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), room.cast("int"))).alias("k", "h")
    ).select("node", "label", "n", "h.shingle", (F.col("alone") + F.col("k") + 1).alias("place"))
    a, b = (places.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "place")]) for x in "ab")
    reach = lambda x: F.col(f"place_{x}") <= F.col(f"n_{x}") - need("n_a", "n_b") + 1
    return a.join(b, "shingle").where(
        (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & reach("a") & reach("b")
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough, as edges (u, v)."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"), F.size("shingles").alias(f"n_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.size(F.array_intersect("s_a", "s_b")) >= need("n_a", "n_b")
    ).select(F.col("a").alias("u"), F.col("b").alias("v"))


def decided(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, print, n_shingles, label, component_id, kept. ``label`` is the component's
    number, null for documents without words."""
    signed = written(bodies(docs).mapInArrow(
        signatures_of, "doc_id long, print long, n_shingles long, class binary, tokens array<bigint>"
    ), "signatures")
    classes = written(
        signed.where("class is not null").groupBy("class")
        .agg(F.min(F.struct("doc_id", "print")).alias("first"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print"))).alias("named"),
             F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
        .select("class", F.coalesce("named", "first").alias("rep"), "n_shingles", "tokens")
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    members = written(signed.select("doc_id", "print", "n_shingles", "class").join(
        classes.select("class", "node"), "class", "left").drop("class"), "members")
    posted = written(prefixes(classes), "postings")

    listed = posted.join(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "token", "left_semi")
    sets = written(class_sets(listed.select("node").distinct(), docs, classes), "sets")
    links = written(confirmed(matching(first_of_lists(posted), classes), sets), "links")
    rest = across_components(posted, components(links), sets)
    links = written(links.union(confirmed(rest, sets)), "links")
    # rows that share an id
    shared = members.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    linked = members.join(shared.select("doc_id", "u"), "doc_id").where("node <> u").select("u", F.col("node").alias("v"))
    labels = written(components(links.union(linked)), "labels")

    named = classes.select("node", "rep.doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = written(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "smallest")
    ids = with_group(named, smallest, "label", "node").select("node", "label", "component_id")
    found = members.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "print", "n_shingles", "label", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, print, n_shingles, component_id, kept."""
    return decided(docs).drop("label")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; one of each component, whether it has ids or not.
    Documents without words stay, rows that repeat one with id and text once."""
    kept = decided(docs).where("kept")
    named = kept.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "print")).alias("one")).select("one.*")
    empty = kept.where("label is null").select("doc_id", "print").distinct()
    return apply_decisions(docs, named.union(empty)).select("row.*")
