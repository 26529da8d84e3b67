"""Near-duplicates by MinHash and a multi-index Hamming join, links confirmed on full sets.

A document's set holds the distinct shingles of its words, A-Z lower-cased. Equal sets
form a class, and classes are compared. A signature has ``SYMBOLS`` b-bit MinHash symbols
in ``CHUNKS`` chunks. By the pigeonhole principle two signatures that differ in at most
``2 * CHUNKS - 1`` symbols have a chunk with at most one error, so a key is made for each
chunk and each symbol that may be wrong in it: all pairs within that distance share a key.
At similarity 0.8 a symbol differs with probability 0.2, and a pair is further apart than
the keys reach about once in ten million.

A bucket of equal keys never makes all its pairs:

1. each member is paired with the least of its bucket; of these each document has its
   best, by keys shared, confirmed first,
2. in buckets that then hold several components, members are paired with the least of the
   least component, again one for each document, as long as that finds links,
3. then the pairs across components are confirmed that the order of their shingles, their
   sizes and sketches allow to be similar.

No pair that could connect two components is left unconfirmed, whatever the bucket's size.

Defined cases: documents without words have an empty set and no links; rows without an id
have no links; rows repeated under one id are one class; rows that share an id but not a
text share their component. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carequeue.llm.batches import map_rows, small_batches
from carequeue.llm.components import settled
from carequeue.llm.hashed_words import TO_LOWER, mix, word_hashes
from carequeue.operators.shared import written

SYMBOLS = 60
CHUNKS = 12
PER_CHUNK = SYMBOLS // CHUNKS
SIMILARITY = 80  # percent
#: Sketches have two bits of each of twice as many symbols. At similarity 0.8 they differ
#: in 24 bits on average; pairs that differ in 60 and more are ruled out, by calculation
#: one in 50 million at similarity 0.8, which is less than the keys lose. At similarity
#: 0.35, as of documents with one passage in common, 78 bits differ on average.
SKETCH_BITS = 60
SKETCHES = ("sketch_a", "sketch_b", "sketch_c", "sketch_d")
#: Rounds of stars go on while one pair in so many is a link; then pairs are compared.
WORTHWHILE = 20
#: Pairs up to this number are sent to the tasks that read the texts (16 bytes each);
#: beyond it texts and pairs are joined by shuffling.
BROADCAST_PAIRS = 500_000
#: Bytes of text a worker takes at once: hashing words holds some 50 times as much.
BYTES_AT_ONCE = 1 << 18

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(1, 1 << 64, 2 * SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 64, 2 * SYMBOLS, dtype=np.uint64)
_KEY_SALTS = _rng.integers(0, 1 << 64, (CHUNKS, PER_CHUNK), dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes([t.encode().translate(TO_LOWER) for t in texts])
    sets = []
    for a, b in zip(bounds, bounds[1:]):
        h = hashes[a:b]
        n = min(words, len(h))
        if n:
            joined = mix(h[: len(h) - n + 1] + np.uint64(n))
            for i in range(1, n):
                joined = mix(joined * np.uint64(3) + h[i : len(h) - n + 1 + i])
            h = np.unique(joined)
        sets.append(h)
    return sets


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbols (16 bits each) and the four parts of the sketch, of sets that are not empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((len(sets), 2 * SYMBOLS), np.uint64)
    for j in range(2 * SYMBOLS):
        least[:, j] = np.minimum.reduceat(every * _FACTORS[j] + _SHIFTS[j], starts)
    mixed = mix(least)
    places = np.arange(SYMBOLS, dtype=np.uint64)
    parts = [
        ((half >> np.uint64(40 + k) & np.uint64(1)) << places).sum(axis=1, dtype=np.uint64)
        for half in (mixed[:, :SYMBOLS], mixed[:, SYMBOLS:])
        for k in range(2)
    ]
    return mixed[:, :SYMBOLS] & np.uint64(0xFFFF), parts


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """For each chunk and each symbol that may be wrong in it, a key of the others."""
    chunks = symbols.reshape(-1, CHUNKS, PER_CHUNK)
    keys = np.empty(chunks.shape, np.uint64)
    for wrong in range(PER_CHUNK):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for i in range(PER_CHUNK):
            if i != wrong:
                packed = packed << np.uint64(16) | chunks[:, :, i]
        keys[:, :, wrong] = mix(packed ^ _KEY_SALTS[:, wrong])
    return keys.reshape(len(symbols), -1).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketches, keys); nulls where there is no set."""

    def make():
        def work(texts):
            sets = shingle_sets(texts, words)
            full = [s for s in sets if len(s)]
            none = (0, *[None] * 6)
            if not full:
                return [none] * len(sets)
            symbols, parts = signatures(full)
            made = zip(*(p.tolist() for p in parts), chunk_keys(symbols).tolist())
            return [
                (len(s), xxhash.xxh3_128_digest(s.tobytes()), *next(made)) if len(s) else none
                for s in sets
            ]

        return work

    return map_rows(
        docs.select("doc_id", "text"),
        make,
        "n_shingles long, digest binary, sketch_a long, sketch_b long, sketch_c long,"
        " sketch_d long, keys array<long>",
        bytes_at_once=BYTES_AT_ONCE,
    )


def _with_sets(rows: DataFrame, words: int) -> DataFrame:
    def make():
        return lambda texts: [(s.tobytes(),) for s in shingle_sets(texts, words)]

    return map_rows(rows, make, "set binary", bytes_at_once=BYTES_AT_ONCE)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) whose full sets have the similarity.

    The set of u travels with its pair to v, whose set meets it there.
    """
    few = pairs.count() <= BROADCAST_PAIRS
    hint = F.broadcast if few else (lambda df: df)
    texts = docs.select("doc_id", "text")
    digests = classes.select(F.col("node").alias("doc_id"), F.col("digest").alias("_of"))

    def sets(wanted: DataFrame) -> DataFrame:
        # a class's text is that of its least id; the digest tells it from others there
        rows = _with_sets(texts.join(hint(wanted), "doc_id"), words)
        return rows

    first = sets(pairs.select(F.col("u").alias("doc_id"), "v", "u_digest")).select(
        F.col("doc_id").alias("u"), "v", "u_digest", F.col("set").alias("u_set")
    )
    second = sets(pairs.select(F.col("v").alias("doc_id"), "v_digest").distinct()).select(
        F.col("doc_id").alias("v"), "v_digest", F.col("set").alias("v_set")
    )

    def work(batches):
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("u_digest", "u_set", "v_digest", "v_set")]
            for i, values in enumerate(zip(*columns)):
                da, a, db, b = (x.as_py() for x in values)
                if xxhash.xxh3_128_digest(a) != da or xxhash.xxh3_128_digest(b) != db:
                    continue  # another text under the same id
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("u", "v")], ["u", "v"]
            )

    return first.join(second, "v").mapInArrow(work, "u long, v long")


def _pair_columns(left: str, right: str) -> list:
    return [
        F.col(f"{left}.node").alias("u"),
        F.col(f"{right}.node").alias("v"),
        F.col(f"{left}.digest").alias("u_digest"),
        F.col(f"{right}.digest").alias("v_digest"),
    ]


def _may_reach(left: str, right: str):
    """Sizes and sketches that do not rule the similarity out."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    far = sum(
        F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}")))
        for s in SKETCHES
    )
    return (100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)) & (far < SKETCH_BITS)


def near_duplicates(docs: DataFrame, words: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words)


def _near_duplicates(docs: DataFrame, words: int) -> DataFrame:
    rows = written(sketches(docs, words), "near-sketches")
    classes = written(
        rows.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("node"),
            F.any_value(F.struct("n_shingles", *SKETCHES, "keys")).alias("_s"),
        )
        .select("digest", "node", "_s.*"),
        "near-classes",
    )
    about = classes.drop("keys")
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = (
        keyed.groupBy("key")
        .agg(F.min("node").alias("leader"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    members = written(keyed.join(shared, "key"), "near-members")
    stars = (
        members.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("keys"))
    )
    l, r = about.alias("l"), about.alias("r")
    stars = written(
        stars.join(l, F.col("leader") == F.col("l.node"))
        .join(r, stars.node == F.col("r.node"))
        .where(_may_reach("l", "r"))
        .select(F.col("r.node").alias("u"), F.col("l.node").alias("v"),
                F.col("r.digest").alias("u_digest"), F.col("l.digest").alias("v_digest"), "keys"),
        "near-stars",
    )
    best = stars.groupBy("u").agg(
        F.max_by(F.struct("v", "u_digest", "v_digest"), F.struct("keys", -F.col("v"))).alias("_b")
    )
    best = written(best.select("u", "_b.*"), "near-best")
    found = settled(written(confirmed(best, classes, docs, words), "near-links"))

    done = best.select("u", "v")
    worthwhile = True
    while True:
        open_ = written(_mixed_buckets(_labelled(members.select("key", "node"), found)), "near-open")
        if open_.isEmpty():
            break
        if worthwhile:
            pairs = written(_next_stars(open_, about, done), "near-best")
            compared = pairs.count()
        if not worthwhile or not compared:
            crossing = written(_crossing(open_, about, docs, done, words), "near-crossing")
            found = settled(found.union(confirmed(crossing, classes, docs, words)))
            break
        new = written(confirmed(pairs, classes, docs, words), "near-links")
        done = written(done.union(pairs.select("u", "v")), "near-done")
        found = settled(found.union(new))
        worthwhile = WORTHWHILE * new.count() >= compared

    of_class = _labelled(classes.select("node", "digest"), found).select("digest", "component")
    by_class = rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(
        F.coalesce("component", "doc_id")
    )
    return by_class.select(
        "doc_id", "n_shingles", component.cast("long").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with a node and its component, its own where it hangs on no other."""
    least = found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rows.join(least, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def _mixed_buckets(labelled: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their bucket's leader:
    the least node of the least component."""
    least = F.min(F.struct("component", "node"))
    mixed = (
        labelled.groupBy("key")
        .agg(least.alias("_first"), F.max("component").alias("_last"))
        .where("_first.component != _last")
        .select("key", F.col("_first.component").alias("of"), F.col("_first.node").alias("leader"))
    )
    return labelled.join(mixed, "key")


def _next_stars(open_: DataFrame, about: DataFrame, done: DataFrame) -> DataFrame:
    """For each node its best leader of another component that it was not compared with."""
    l, r = about.alias("l"), about.alias("r")
    stars = (
        open_.where("component != of")
        .groupBy(F.col("node").alias("u"), F.col("leader").alias("v"))
        .agg(F.count("*").alias("keys"))
        .join(done, ["u", "v"], "left_anti")
    )
    possible = (
        stars.join(l, F.col("u") == F.col("l.node"))
        .join(r, F.col("v") == F.col("r.node"))
        .where(_may_reach("l", "r"))
    )
    chosen = F.struct("v", F.col("l.digest").alias("u_digest"), F.col("r.digest").alias("v_digest"))
    best = possible.groupBy("u").agg(
        F.max_by(chosen, F.struct("keys", -F.col("v"))).alias("_b")
    )
    return best.select("u", "_b.*")


def _crossing(
    open_: DataFrame, about: DataFrame, docs: DataFrame, done: DataFrame, words: int
) -> DataFrame:
    """The pairs across components, among the members of mixed buckets, that nothing rules out.

    Shingles are put in one order, rare ones first. Two sets with the similarity have their
    first common shingle early in both: what follows it must be enough for the overlap. So
    only the beginnings of the sets are joined, and copies of one text that each have a few
    changes of their own are not paired by what they all have in common.
    """
    nodes = written(open_.select("node", "component").distinct().join(about, "node"), "near-nodes")
    few = nodes.count() <= BROADCAST_PAIRS
    wanted = nodes.select(F.col("node").alias("doc_id"), F.col("digest").alias("_of"))
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")

    def make():
        def work(rows):
            sets = shingle_sets(rows, words)
            return [(xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64).tolist()) for s in sets]

        return work

    sets = map_rows(
        texts, make, "_digest binary, set array<long>", bytes_at_once=BYTES_AT_ONCE
    ).where("_digest = _of")
    shingles = written(
        sets.dropDuplicates(["doc_id"]).select(
            F.col("doc_id").alias("node"), F.explode("set").alias("shingle")
        ),
        "near-shingles",
    )
    common = shingles.groupBy("shingle").agg(F.count("*").alias("_f")).where("_f > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("_f", F.lit(1)), "shingle")
    n, at = F.col("n_shingles"), F.col("at")
    begins = (
        shingles.join(common, "shingle", "left")
        .withColumn("at", F.row_number().over(order) - 1)
        .where("_f is not null")
        .join(nodes, "node")
        .where(at <= n - F.ceil(n * SIMILARITY / 100))
    )
    begins = written(begins, "near-beginnings")
    a, b = begins.alias("a"), begins.alias("b")
    left = F.least(
        F.col("a.n_shingles") - F.col("a.at"), F.col("b.n_shingles") - F.col("b.at")
    )
    both = F.col("a.n_shingles") + F.col("b.n_shingles")
    pairs = (
        a.join(
            b,
            (F.col("a.shingle") == F.col("b.shingle"))
            & (F.col("a.component") < F.col("b.component"))
            & ((100 + SIMILARITY) * left >= SIMILARITY * both)
            & _may_reach("a", "b"),
        )
        .select(*_pair_columns("a", "b"))
        .distinct()
    )
    known = done.union(done.select("v", "u"))
    return pairs.join(known, ["u", "v"], "left_anti")


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents kept: of each group the one with the least id; columns unchanged.

    Rows without an id are all kept. Rows repeated under one id are kept as they are.
    """
    dropped = near_duplicates(docs, words).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
