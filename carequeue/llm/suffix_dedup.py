"""Removal of long repeated strings with a logarithmic family of suffix-array levels.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier, in a
document with a smaller id or further ahead in the same one.

*Sparse suffixes.* In each string of ``LENGTH`` bytes one gram of ``GRAM`` bytes is chosen:
the one with the least hash, the rightmost of equals. Equal strings choose equal grams, so
only suffixes at chosen grams are indexed, about 1 in 35. Neighbouring strings mostly
choose the same gram; such a run of strings is one entry: hash of the gram, hash of all
the run's bytes, document, first start, number of strings.

*Levels.* Documents come in batches of rising ids. A batch's entries, sorted by gram and
run, are its suffix array, dealt to buckets by gram. In each bucket it is merge-scanned
against the levels there are: a run that an earlier entry equals is repeated as a whole; a
gram that occurs in several runs marks them as edges. The batch then becomes a level of
size one and equal-sized levels merge to one of twice the size, as a binary counter does.

*Edges.* Strings of edge runs are compared singly, by their hashes: all but the earliest of
each are repeated. Entries without an edge cost nothing further.

Nothing is paired: in a task the first of equal runs and strings stands for all, so a
passage in a third of all documents reaches a bucket once per task. A gram with many runs
in one task goes to the edges at once and to its bucket with one entry.

Defined cases: null texts are empty; documents without an id come first, ordered by hash
of the text; rows that share id and text are one document, and none of them is earlier
than the others; other texts under one id are documents of their own, one after the other
by the hash of the text. Texts of any length are worked on whole, in pieces that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.llm.batches import parts_of
from carequeue.llm.hashed_words import BASE, BYTE_VALUES, mix
from carequeue.operators.rank import rank_rows
from carequeue.operators.shared import delete_table, new_path, written

LENGTH = 100
GRAM = 32
BATCHES = 3
#: Ids of documents with any finding up to this number go to all tasks (8 bytes each), so
#: that only those documents' texts are shuffled; beyond it all texts are.
BROADCAST_KEYS = 1_000_000
#: Strings of text that one bucket of the index and of the edges is made for.
BUCKET_BYTES = 8 << 20
PIECE = 1 << 18
LOCALLY_HOT = 8
RUNS_AT_ONCE = 400_000
_FLAG = 128
_PLACE_BITS = np.uint64(24)
_PLACES = np.uint64((1 << 24) - 1)
_GRAMS = LENGTH - GRAM + 1
_STEP = {n: np.uint64(pow(int(BASE), n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32)}

DUP, EDGE, ENTRIES = 0, 1, 2
ROWS = "kind int, bucket int, key long, start long, length long, blob binary"


def rolling_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every GRAM bytes and of every LENGTH bytes, by doubling."""
    h = {1: BYTE_VALUES[data]}

    def joined(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> np.ndarray:
        n = len(data) - na - nb + 1
        return a[:n] * _STEP[nb] + b[na : na + n]

    for n in (1, 2, 4, 8, 16, 32):
        h[2 * n] = joined(h[n], n, h[n], n)
    h96 = joined(h[64], 64, h[32], 32)
    return h[GRAM], joined(h96, 96, h[4], 4)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined parts of texts: bytes, and for each part (text, its offset, place, length).

    Parts of a long text overlap by LENGTH - 1 bytes, so each string is in one part.
    """
    parts, size, chunks = [], 0, []
    for row, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - LENGTH + 1), PIECE):
            chunk = text[offset : offset + PIECE + LENGTH - 1]
            parts.append((row, offset, size, len(chunk)))
            chunks.append(chunk)
            size += len(chunk)
            if size >= PIECE:
                yield np.frombuffer(b"".join(chunks), np.uint8), np.array(parts, np.int64)
                parts, size, chunks = [], 0, []
    if parts:
        yield np.frombuffer(b"".join(chunks), np.uint8), np.array(parts, np.int64)


def runs(data: np.ndarray, parts: np.ndarray):
    """The runs of strings: text, start, number of strings, gram and run hashes."""
    grams, h100 = rolling_hashes(data)
    order = (mix(grams) >> _PLACE_BITS) << _PLACE_BITS
    order |= _PLACES - np.arange(len(order), dtype=np.uint64)
    least, width = order, 1
    while 2 * width <= _GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _GRAMS - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    chosen = (_PLACES - (least & _PLACES)).astype(np.int64)
    ends = np.zeros(len(h100) + 1, np.int8)
    ends[parts[:, 2]] = 1
    last = parts[:, 2] + parts[:, 3] - LENGTH + 1
    np.subtract.at(ends, last, 1)
    at = np.flatnonzero(np.cumsum(ends[:-1]) > 0)
    chosen = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(at)))
    begin = at[first]
    part = parts[np.searchsorted(parts[:, 2], begin, "right") - 1]
    run = mix(mix(h100[begin] + number.astype(np.uint64)) * np.uint64(3) + h100[begin + number - 1])
    gram = mix(grams[chosen[first]] * np.uint64(5))
    return part[:, 0], part[:, 1] + begin - part[:, 2], number, gram, run


# entries in blobs, column by column and byte by byte so that they compress ---------------
_FIELDS = (
    ("gram", np.uint32, 4),
    ("run", np.uint64, 6),
    ("key", np.int64, 8),
    ("start", np.uint64, 5),
    ("number", np.uint8, 1),
)


def pack(entries: dict[str, np.ndarray]) -> bytes:
    out = []
    for name, kind, width in _FIELDS:
        values = np.ascontiguousarray(entries[name].astype(kind))
        if name in ("gram",):
            values = np.diff(values, prepend=values.dtype.type(0))
        out.append(values.view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes())
    return b"".join(out)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    total = sum(w for *_, w in _FIELDS)
    n = len(blob) // total
    data, at, made = np.frombuffer(blob, np.uint8), 0, {}
    for name, kind, width in _FIELDS:
        full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        full[:, :width] = data[at : at + n * width].reshape(width, n).T
        at += n * width
        values = full.view(kind).reshape(n)
        made[name] = np.cumsum(values, dtype=kind) if name == "gram" else values
    return made


def _taken(entries: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in entries.items()}


def _joined(many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([m[name] for m in many]) for name, *_ in _FIELDS}


def _spans(kind: int, buckets: int, key, start, number) -> list[tuple]:
    """Rows of runs, those that follow one another in a document joined."""
    if not len(key):
        return []
    order = np.lexsort((start, key))
    key, start, number = (x[order].astype(np.int64) for x in (key, start, number))
    new = np.ones(len(key), bool)
    if kind == DUP:
        new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + number[:-1])
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(start + number, first)
    made = zip(key[first].tolist(), start[first].tolist(), (stop - start[first]).tolist())
    return [(kind, k % buckets, k, s, n, None) for k, s, n in made]


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in ROWS.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _slices(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from parts_of(batch, "packed" if "packed" in batch.schema.names else "text")


def suffix_arrays(docs: DataFrame, buckets: int) -> DataFrame:
    """Sorted entries of the documents of each task by bucket; repeats inside it at once."""

    def parts(batches):
        """Keys and runs of about ``RUNS_AT_ONCE`` runs, however long the texts are."""
        made, n = [], 0
        for part in _slices(batches):
            keys = part.column("_key").to_numpy(zero_copy_only=False)
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            for piece in pieces(texts):
                row, *rest = runs(*piece)
                made.append((keys[row], *rest))
                n += len(row)
                if n >= RUNS_AT_ONCE:
                    yield made
                    made, n = [], 0
        if made:
            yield made

    def work(batches):
        for made in parts(batches):
            key, start, number, gram, run = (np.concatenate(c) for c in zip(*made))
            del made
            bucket = (gram >> np.uint64(32)) % np.uint64(buckets)
            entries = {
                "gram": gram.astype(np.uint32), "run": run & np.uint64((1 << 48) - 1),
                "key": key, "start": start, "number": number.astype(np.uint8),
            }
            order = np.lexsort((start, entries["key"], entries["run"], entries["gram"], bucket))
            entries, bucket = _taken(entries, order), bucket[order]
            repeated, head = _repeats(entries, bucket)
            rows = _spans(DUP, buckets, *(entries[c][repeated] for c in ("key", "start", "number")))
            entries, bucket = _taken(entries, head), bucket[head]
            # grams with many runs here: all are edges, one stands for them in the bucket
            new = np.ones(len(bucket), bool)
            new[1:] = (entries["gram"][1:] != entries["gram"][:-1]) | (bucket[1:] != bucket[:-1])
            group = np.cumsum(new) - 1
            hot = np.bincount(group)[group] > LOCALLY_HOT
            rows += _spans(EDGE, buckets, *(entries[c][hot] for c in ("key", "start", "number")))
            entries["number"] = entries["number"] | np.where(hot, _FLAG, 0).astype(np.uint8)
            sent = ~hot | new
            entries, bucket = _taken(entries, sent), bucket[sent]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    own = {k: v[cuts[b] : cuts[b + 1]] for k, v in entries.items()}
                    rows.append((ENTRIES, b, None, None, -1, pack(own)))
            for i in range(0, len(rows), 2000):
                yield _to_batch(rows[i : i + 2000])

    return docs.select("_key", "text").mapInArrow(work, ROWS)


def _repeats(entries, bucket=None) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries: which repeat an earlier one, and which are the first of theirs.

    Rows under one id and start are the same place; they neither repeat nor lead.
    """
    n = len(entries["run"])
    new = np.ones(n, bool)
    same = (entries["run"][1:] == entries["run"][:-1]) & (entries["gram"][1:] == entries["gram"][:-1])
    if bucket is not None:
        same &= bucket[1:] == bucket[:-1]
    new[1:] = ~same
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = (entries["key"] != entries["key"][lead]) | (entries["start"] != entries["start"][lead])
    return place & ~new, new


def _scan(buckets: int, merged: int, keep: bool):
    """Merge-scan of one bucket: the new batch's entries against those of all levels.

    ``merged``: levels below this one merge with the batch into one, which is returned
    where it is kept. Level numbers are in ``length``; the batch's is -1.
    """

    def work(table: pa.Table) -> pa.Table:
        rows, many, levels = [], [], []
        for r in table.to_pylist():
            if r["kind"] == ENTRIES:
                many.append(unpack(r["blob"]))
                levels.append(np.full(len(many[-1]["run"]), r["length"], np.int16))
                bucket = r["bucket"]
            else:
                rows.append(tuple(r.values()))
        if many:
            entries, level = _joined(many), np.concatenate(levels)
            order = np.lexsort((entries["start"], entries["key"], entries["run"], entries["gram"]))
            entries, level = _taken(entries, order), level[order]
            repeated, head = _repeats(entries)
            repeated &= level < 0
            number = entries["number"] & np.uint8(_FLAG - 1)
            rows += _spans(
                DUP, buckets, entries["key"][repeated], entries["start"][repeated], number[repeated]
            )
            flags = entries["number"] >= _FLAG
            new = np.ones(len(head), bool)
            new[1:] = entries["gram"][1:] != entries["gram"][:-1]
            group = np.cumsum(new) - 1
            several = np.bincount(group, head)[group] > 1
            marked = np.bincount(group, flags)[group] > 0
            edge = head & (several | marked) & ~flags
            rows += _spans(EDGE, buckets, entries["key"][edge], entries["start"][edge], number[edge])
            entries["number"] = entries["number"] | np.where(edge, _FLAG, 0).astype(np.uint8)
            if keep:
                # a flag on an entry that is not the first of its run must not be lost
                stay = (head | flags) & (level < merged)
                if stay.any():
                    rows.append((ENTRIES, bucket, None, None, merged, pack(_taken(entries, stay))))
        return pa.Table.from_batches([_to_batch(rows)])

    return work


def _index(docs: DataFrame, buckets: int, batches: int) -> list[str]:
    """Paths of the scans' results, one for each batch of rising ids."""
    spark = docs.sparkSession
    steps = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("_key", steps, 1000)).first()[0] if steps else None
    bounds = sorted(set(bounds or []))
    found: list[str] = []
    levels: dict[int, str] = {}
    key = F.col("_key")
    for b, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        own = docs
        if low is not None:
            own = own.where(key > low)
        if high is not None:
            own = own.where(key <= high)
        rows = suffix_arrays(own, buckets)
        for path in levels.values():
            rows = rows.union(_entries(spark, path))
        merged = 0
        while merged in levels:
            merged += 1
        keep = b < len(bounds)
        path = new_path(spark, "suffix-level")
        scan = _scan(buckets, merged, keep)
        rows.groupBy("bucket").applyInArrow(scan, ROWS).write.partitionBy("kind").parquet(path)
        found.append(path)
        for i in range(merged):
            delete_table(spark, f"{levels.pop(i)}/kind={ENTRIES}")
        levels[merged] = path
    return found


def _stored(spark, path: str) -> DataFrame:
    schema = ", ".join([*ROWS.split(", ")[1:], "kind int"])
    return spark.read.schema(schema).parquet(path)


def _entries(spark, path: str) -> DataFrame:
    rows = _stored(spark, path).where(F.col("kind") == ENTRIES)
    return rows.select(*[c.split()[0] for c in ROWS.split(", ")])


def _strings(docs: DataFrame, buckets: int) -> DataFrame:
    """The strings of edge runs by bucket of their hash, repeats inside a task at once."""

    def parts(batches):
        """Bytes of edge runs with key, start and number, about ``RUNS_AT_ONCE`` strings."""
        found, n = [], 0
        for part in _slices(batches):
            for r in part.to_pylist():
                text = zstandard.decompress(r["packed"])
                for e in r["edges"]:
                    s, number = e["start"], e["length"]
                    piece = np.frombuffer(text[s : s + number + LENGTH - 1], np.uint8)
                    found.append((piece, r["_key"], s, number))
                    n += number
                if n >= RUNS_AT_ONCE:
                    yield found
                    found, n = [], 0
        if found:
            yield found

    def work(batches):
        for hashed in parts(batches):
            key, start = [], []
            values = []
            for i in range(0, len(hashed), 512):
                group = hashed[i : i + 512]
                _, h100 = rolling_hashes(np.concatenate([p for p, *_ in group]))
                at = np.cumsum([0, *(len(p) for p, *_ in group[:-1])])
                for a, (_, k, s, n) in zip(at, group):
                    values.append(h100[a : a + n])
                    key.append(np.full(n, k, np.int64))
                    start.append(np.arange(s, s + n))
            h, key, start = mix(np.concatenate(values)), np.concatenate(key), np.concatenate(start)
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            entries = {
                "gram": (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), "run": h >> np.uint64(32),
                "key": key, "start": start, "number": np.ones(len(h), np.uint8),
            }
            order = np.lexsort((start, key, h, entries["gram"], bucket))
            entries, bucket = _taken(entries, order), bucket[order]
            repeated, head = _repeats(entries, bucket)
            rows = _spans(DUP, buckets, *(entries[c][repeated] for c in ("key", "start", "number")))
            entries, bucket = _taken(entries, head), bucket[head]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    own = {k: v[cuts[b] : cuts[b + 1]] for k, v in entries.items()}
                    rows.append((ENTRIES, b, None, None, -1, pack(own)))
            for i in range(0, len(rows), 2000):
                yield _to_batch(rows[i : i + 2000])

    return docs.mapInArrow(work, ROWS)


def _first_strings(buckets: int):
    def work(table: pa.Table) -> pa.Table:
        rows, many = [], []
        for r in table.to_pylist():
            if r["kind"] == ENTRIES:
                many.append(unpack(r["blob"]))
            else:
                rows.append(tuple(r.values()))
        if many:
            entries = _joined(many)
            order = np.lexsort((entries["start"], entries["key"], entries["run"], entries["gram"]))
            entries = _taken(entries, order)
            repeated, _ = _repeats(entries)
            rows += _spans(DUP, buckets, *(entries[c][repeated] for c in ("key", "start", "number")))
        return pa.Table.from_batches([_to_batch(rows)])

    return work


def removed_spans(n: int, dups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes covered by repeated strings given as (first start, number)."""
    found: list[list[int]] = []
    for start, number in sorted(dups):
        stop = min(n, start + number + LENGTH - 1)
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], stop)
        else:
            found.append([start, stop])
    return [(a, b) for a, b in found]


def _results(rows: DataFrame, extra: list[str], touched: bool) -> DataFrame:
    """Figures of each document from its text and the repeated strings in ``dups``.

    ``touched`` also gives back the packed text and edges of documents that have edges.
    Otherwise texts may come packed.
    """
    schema = "_key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += "".join(f", {e}" for e in extra)

    def work(batches):
        for part in _slices(batches):
            out = []
            for r in part.to_pylist():
                if touched and r["edges"]:
                    out.append((r["_key"], r["doc_id"], None, None, None, None, zstandard.compress((r["text"] or "").encode()), r["edges"], r["dups"]))
                    continue
                data = zstandard.decompress(r["packed"]) if "packed" in r else (r["text"] or "").encode()
                spans = removed_spans(len(data), [(d["start"], d["length"]) for d in r["dups"] or ()])
                kept, done = [], 0
                for a, b in spans:
                    kept.append(data[done:a])
                    done = b
                kept = b"".join([*kept, data[done:]])
                made = (r["_key"], r["doc_id"], len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append(made + (None, None, None) * touched)
            if out:
                yield _rows_batch(out, touched)

    return rows.mapInArrow(work, schema)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _rows_batch(out: list[tuple], touched: bool) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.string()] + [pa.binary(), _SPAN, _SPAN] * touched
    names = ["_key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["packed", "edges", "dups"] * touched
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _by_document(rows: DataFrame, kind: int, name: str) -> DataFrame:
    span = F.struct("start", "length")
    return (
        rows.where(F.col("kind") == kind).groupBy("key").agg(F.collect_set(span).alias(name))
    )


def _keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents with a key in their order, one for each id and text; and their bytes.

    The key is the id where no two texts share one. Else ids are spaced out, and the texts
    of an id numbered between; where ids lie too far apart for that, their ranks are.
    """
    ids, hashed = F.col("doc_id").cast("long"), F.xxhash64("text")
    unnamed = -F.lit(1 << 62) - hashed.bitwiseAND(F.lit((1 << 61) - 1))
    narrow = written(
        docs.select(ids.alias("id"), hashed.alias("hash"), F.octet_length("text").alias("size")),
        "suffix-ids",
    )
    size = narrow.agg(F.sum("size")).first()[0] or 0
    docs = docs.select("doc_id", ids.alias("_id"), hashed.alias("_hash"), "text")
    by_id = narrow.where("id is not null").groupBy("id")
    shared = by_id.agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a != b")
    shared = written(shared.select("id"), "suffix-shared-ids")
    if shared.isEmpty():
        return docs.select("doc_id", F.coalesce("_id", unnamed).alias("_key"), "text"), size

    texts = narrow.join(shared, "id", "left_semi").select("id", "hash").distinct()
    numbered = rank_rows(texts, F.col("id").asc(), F.col("hash").asc(), position="at")
    first = numbered.groupBy("id").agg(F.min("at").alias("first"))
    places = written(
        numbered.join(first, "id").select(
            F.col("id").alias("_id"), F.col("hash").alias("_hash"), (F.col("at") - F.col("first")).alias("_place")
        ),
        "suffix-places",
    )
    few = places.count() <= BROADCAST_KEYS
    docs = docs.join(F.broadcast(places) if few else places, ["_id", "_hash"], "left")
    room = places.agg(F.max("_place")).first()[0].bit_length()
    least, most = narrow.agg(F.min("id"), F.max("id")).first()
    if (most - least + 1) << room < 1 << 61:
        docs = docs.withColumn("_of", F.col("_id") - least)
    else:
        ranks = rank_rows(narrow.where("id is not null").select("id").distinct(), F.col("id").asc(), position="_of")
        docs = docs.join(ranks.withColumnRenamed("id", "_id"), "_id", "left")
    key = F.shiftleft("_of", room) + F.coalesce("_place", F.lit(0))
    return docs.select("doc_id", F.coalesce(key, unnamed).alias("_key"), "text"), size


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    spark = docs.sparkSession
    docs, size = _keyed(docs)
    buckets = 1 + size // BUCKET_BYTES
    found = None
    for path in _index(docs, buckets, batches):
        rows = _stored(spark, path).where(F.col("kind") != ENTRIES)
        found = rows if found is None else found.union(rows)
    spans = _by_document(found, DUP, "dups").join(_by_document(found, EDGE, "edges"), "key", "full")
    keys = written(found.select(F.col("key").alias("_key")).distinct(), "suffix-keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    kinds = "array<struct<start:bigint,length:bigint>>"
    clean = docs.join(few, "_key", "left_anti").withColumn("dups", F.lit(None).cast(kinds))
    joined = (
        docs.join(few, "_key", "left_semi")
        .join(spans.withColumnRenamed("key", "_key"), "_key", "left")
        .select("_key", "doc_id", "text", "dups", "edges")
    )
    first = written(
        _results(joined, ["packed binary", f"edges {kinds}", f"dups {kinds}"], True), "suffix-first"
    )
    touched = first.where("packed is not null").select("_key", "doc_id", "packed", "edges", "dups")
    more = _strings(touched.select("_key", "packed", "edges"), buckets)
    more = more.groupBy("bucket").applyInArrow(_first_strings(buckets), ROWS)
    more = _by_document(more, DUP, "more").withColumnRenamed("key", "_key")
    none = F.array().cast(kinds)
    rest = touched.join(more, "_key", "left").select(
        "_key",
        "doc_id",
        "packed",
        F.concat(F.coalesce("dups", none), F.coalesce("more", none)).alias("dups"),
    )
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    parts = [_results(clean, [], False), first.where("packed is null"), _results(rest, [], False)]
    return parts[0].select(*result).union(parts[1].select(*result)).union(parts[2].select(*result))
