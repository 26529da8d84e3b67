"""Awkward rows of the training-data operators, and their figures worked out a second way."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carequeue.llm import (
    batches,
    chat,
    mixing,
    near_duplicates,
    quality,
    sentencepiece_spans,
    suffix_dedup,
    token_counts,
    winnowing,
)
from carequeue.llm.registry import LLM_ORACLE, LLM_QUERIES, PIECE_MODEL, WORD_MODEL, tokenizer_path
from carequeue.operators.shared import intermediate_tables

FOLDER = "/root/testdata/sf0.001"


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


# -- mixing --------------------------------------------------------------------------


def test_no_document_is_repeated_above_the_limit(spark):
    """Sources at their limit, with documents without words among theirs."""
    rng = random.Random(1)
    rows = [(i, "a", sentence(rng, 200)) for i in range(60)]
    rows += [(100 + i, "b", sentence(rng, 3) if i % 3 else "  ") for i in range(60)]
    rows += [(200 + i, "c", "") for i in range(10)] + [(300, None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.mix_plan(docs, weights=(1, 5, 1))
    counts = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs, mix).groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= mixing.MAX_EPOCHS
    taken = {r.doc_id: r.taken for r in mixing.mix_report(mix).collect()}
    sizes = {i: len(t.split()) for i, _, t in rows}
    assert all(counts.get(i, 0) * sizes[i] == taken[i] for i in sizes)


# -- reply trees ---------------------------------------------------------------------


def plain_paths(messages):
    """Root-to-leaf paths; messages on a circle of replies start trees of their own."""
    parent = {n: p for n, p in messages if p in dict(messages)}
    circles = set()
    for node in parent:
        seen, at = {node}, parent[node]
        while at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        if at == node:  # it leads back to itself
            circles.add(node)
    parent = {n: p for n, p in parent.items() if n not in circles and p is not None}
    found = set()
    for node, _ in messages:
        if node not in parent.values():
            path = [node]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            found |= {(node, n, d) for d, n in enumerate(path)}
    return found


@pytest.mark.parametrize("seed", [0, 2])
def test_circles_of_replies_end(spark, seed):
    rng = random.Random(seed)
    n = [5, 30, 60, 45][seed]
    messages = [(i, rng.choice([None, i - 1, rng.randrange(n), i, 999])) for i in range(n)]
    messages += [(n + i, n + (i + 1) % 20) for i in range(20)]  # one long circle
    messages += [(n + 20, n + 3), (n + 21, n + 20), (n + 22, n + 22)]
    rows = [("c", 1, i, p, "user", f"m{i}", 1.0) for i, p in messages]
    schema = "_conv string, conv_id long, node long, parent long, role string, text string, score double"
    df = spark.createDataFrame(rows, schema)
    found = {(r.leaf, r.node, r.distance) for r in chat.paths(df).collect()}
    assert found == plain_paths(messages)
    assert chat.format_paths(df).count() == len({leaf for leaf, _, _ in found})


# -- long repeated strings -----------------------------------------------------------


def plain_removals(rows):
    """Rows (key, text) in order; those of one key are one document."""
    seen, out = {}, []
    for key, text in sorted(set(rows)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            s = data[at : at + 100]
            if s in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.setdefault(s, key)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("spread", [1, 1 << 57])
def test_texts_that_share_an_id(spark, spread):
    rng = random.Random(3)
    shared = [sentence(rng, 40) for _ in range(4)]
    rows = []
    for i in range(12):
        for _ in range(rng.randrange(1, 4)):
            rows.append((i * spread - 3, " ".join(rng.choice([*shared, sentence(rng, 15)]) for _ in range(4))))
    rows += [rows[0], (5 * spread - 3, None), (5 * spread - 3, ""), (7 * spread - 3, "x" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    expected = {}
    for key, *figures in plain_removals([((i, hashed[t]), t) for i, t in rows]):
        expected[key] = tuple(figures)
    found = sorted(map(tuple, suffix_dedup.deduplicated(df).collect()))
    assert found == sorted((i, *expected[i, hashed[t]]) for i, t in rows)


def test_span_counts_and_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    rng = random.Random(9)
    shared = [sentence(rng, 30) for _ in range(5)]
    texts = [" ".join(rng.choice([*shared, sentence(rng, 20)]) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = sorted(map(tuple, suffix_dedup.deduplicated(df).collect()))
    assert found == [tuple(r) for r in plain_removals(list(enumerate(texts)))]


# -- tokens --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_counts():
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_MODEL)
    library = Tokenizer.from_file(path)
    own = token_counts.transducer_of(path, token_counts.letters_of(path))
    return lambda t: len(library.encode(t, add_special_tokens=False).ids), own.count


def test_counts_of_every_kind_of_character(word_counts):
    """One of each code point between letters; those of newer Unicode versions among them."""
    library, own = word_counts
    rng = random.Random(1)
    points = [p for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF]
    some = points[:0x3100] + points[0xA000:0xB000] + list(range(0x32000, 0x33500))
    some += rng.sample(points, 30_000) + [0xA7CB, 0xA7DC, 0x32808, 0x3285C]
    wrong = [hex(p) for p in some if own(f"a{chr(p)}b") != library(f"a{chr(p)}b")]
    assert wrong == []
    pool = [chr(p) for p in rng.sample(some, 8000)] + list("abc'sn \n\t12.<>Σσς") * 500
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 25))) for _ in range(12_000)]
    assert [t for t in texts if own(t) != library(t)] == []


def test_limit_of_tokens(spark):
    path = tokenizer_path(WORD_MODEL)
    rows = [(n, "the " * n) for n in (2047, 2048, 2049)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.counted_documents(df, path).collect()}
    assert found == {2047: (2047, False), 2048: (2048, False), 2049: (2049, True)}


def spans_digest(pieces):
    assert [0, *(p.end for p in pieces)][: len(pieces)] == [p.begin for p in pieces]
    edges = np.array([0, *(p.end for p in pieces)], "<u4")
    return hashlib.sha256(edges.tobytes()).hexdigest()


AWKWARD = [
    "", None, "one", " two  spaces ", "Écrit ▁ à\n", "中文字 ab", "\U0001f600\U0001f601 x", "\t tab",
    "▁", " ", "ﬁne ①② ｱﾞ", "x" * 3000, "à b", "1 22 333",
]


def test_spans_cover_every_byte(spark):
    path = tokenizer_path(PIECE_MODEL)
    rng = random.Random(2)
    texts = AWKWARD + [sentence(rng, 50, "abé中 ▁\U0001f600z") for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoder = sentencepiece_spans.encoder_of(path)
    for r in sentencepiece_spans.encoded_documents(df, path).collect():
        text = texts[r.doc_id] or ""
        pieces = encoder.encode_spans(text)
        assert r.covered_bytes == len(text.encode()) and len(pieces) == r.n_tokens
        assert r.spans_sha256 == spans_digest(pieces), repr(text)


def test_a_model_with_a_character_map(spark, tmp_path):
    """Normalization changes lengths; ids are the library's and spans those of the original."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(tokenizer_path(PIECE_MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    other = pb.ModelProto()
    other.ParseFromString(normalizer.serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    spans = {r.doc_id: r for r in sentencepiece_spans.document_spans(df, path).collect()}
    for r in sentencepiece_spans.encoded_documents(df, path).collect():
        text = AWKWARD[r.doc_id] or ""
        ids = library.encode(text)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        own = spans[r.doc_id]
        assert own.ids == ids and len(own.begins) == r.n_tokens
        assert all(a <= b for a, b in zip(own.begins, own.ends))
        assert all(b <= len(text.encode()) for b in own.ends)
        for i, a, b in zip(own.ids, own.begins, own.ends):
            piece = library.id_to_piece(i).replace("▁", " ").strip()
            if piece.isascii() and piece and text[:1] not in "\t" and text.isascii():
                assert text.encode()[a:b].decode().strip() == piece


# -- near-duplicates -----------------------------------------------------------------


def test_links_at_the_edge_of_the_similarity(spark):
    """Pairs planted at similarities from 0.80 to 0.82: every one is linked."""
    rng = random.Random(4)
    rows, expected = [], {}
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(101)]
        changed = list(words)
        # replaced words in a row: each run of n words changes n + 1 shingles
        at, n = rng.randrange(5, 80), 9 + (k % 2)
        changed[at : at + n] = [f"z{k}x{i}" for i in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        same = 100 - (n + 1)
        near = 100 * same >= 80 * (200 - same)
        expected[2 * k + 1] = 2 * k if near else 2 * k + 1
    assert sum(v % 2 == 0 for v in expected.values()) > 70
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(df).collect()}
    assert {i: found[i] for i in expected} == expected


def test_workers_get_few_texts_at_once(spark, monkeypatch, tmp_path):
    """Neither the batches sent to workers nor the texts hashed together grow with a partition."""
    rng = random.Random(6)
    texts = [" ".join(f"{rng.random()}" for _ in range(150)) for _ in range(1500)]
    texts[7] = texts[3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain, seen = batches.parts_of, str(tmp_path)

    def noted(batch, *args):
        with open(f"{seen}/{os.getpid()}", "a") as file:
            for part in plain(batch, *args):
                size = sum(len(t.as_py()) for t in part.column("text"))
                file.write(f"{batch.num_rows} {part.num_rows} {size}\n")
                yield part

    monkeypatch.setattr(batches, "parts_of", noted)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(df).collect()}
    assert found == {i: 3 if i == 7 else i for i in range(1500)}
    assert spark.conf.get(rows) == before
    notes = [tuple(map(int, x.split())) for f in tmp_path.iterdir() for x in f.open()]
    assert sum(part for _, part, _ in notes) >= 1500
    assert max(sent for sent, _, _ in notes) <= 256
    assert max(size for _, _, size in notes) <= 1 << 18


# -- quality -------------------------------------------------------------------------


POSTERIORS = """
with s as (select *, round(1000000 / (1 + exp(-evidence))) as chance from scored),
total as (select greatest(0.001, least(0.999, sum(chance) / 1e6 / count(*))) as mean from s),
sites as (select _site, count(*) as n, sum(chance) / 1e6 / count(*) as rate from s group by all),
sections as (select _site, _section, count(*) as n, sum(chance) / 1e6 / count(*) as rate
             from s group by all),
a as (select greatest(2, least(1e6, mean * (1 - mean) / greatest(1e-9,
        sum(n * ((rate - mean) ** 2 - mean * (1 - mean) / n)) / sum(n)) - 1)) as k, mean
      from sites, total group by mean),
b as (select greatest(2, least(1e6, mean * (1 - mean) / greatest(1e-9,
        sum(n * ((rate - mean) ** 2 - mean * (1 - mean) / n)) / sum(n)) - 1)) as k
      from sections, total group by mean),
site as (select _site, round((n * rate + a.k * mean) / (n + a.k), 6) as post from sites, a),
section as (select x._site, x._section, site.post as site_post,
    round((x.n * x.rate + b.k * site.post) / (x.n + b.k), 6) as post
  from sections x join site using (_site), b)
select s.doc_id, site_post, post,
  round(1 / (1 + exp(-(evidence + {weight} * (ln(post / (1 - post))
    - ln(round(a.mean, 6) / (1 - round(a.mean, 6))))))), 4) as quality
from s join section using (_site, _section), a
"""


def test_posteriors_equal_sql(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(1 if i % 5 else -2, 2), f"s{i % 7 if i % 3 else 0}", rng.choice("xyz"), i % 16)
            for i in range(400)]
    scored = spark.createDataFrame(rows, "doc_id long, evidence double, _site string, _section string, _salt int")
    own = quality.with_posterior(scored, quality.site_posteriors(scored))
    found = {r.doc_id: (r.site_posterior, r.section_posterior, r.quality, r.kept) for r in own.collect()}
    con = duckdb.connect()
    con.register("scored", scored.toPandas())
    expected = con.sql(POSTERIORS.format(weight=quality.SITE_WEIGHT)).fetchall()
    assert len(expected) == len(found) == 400
    for i, site, section, value in expected:
        assert found[i][0] == pytest.approx(site, abs=2e-6)
        assert found[i][1] == pytest.approx(section, abs=2e-6)
        assert found[i][2] == pytest.approx(value, abs=2e-4)
        assert found[i][3] == (found[i][2] >= quality.THRESHOLD)


# -- fingerprints --------------------------------------------------------------------


def test_choices_of_every_window(spark):
    """Hashes by the session, windows by brute force: the least, the rightmost of equals."""
    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(0, 60), "ab") for _ in range(60)] + ["a b " * 40, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = winnowing.fingerprint_columns(df, "text", "own").select(
        "doc_id", winnowing.hashes(F.col("own")).alias("h"), winnowing.positions(F.col("own")).alias("p")
    )
    found = {r.doc_id: list(zip(r.h, r.p)) for r in rows.collect()}
    grams = sorted({tuple(t.split()[i : i + 4]) for t in texts for i in range(len(t.split()) - 3)})
    hashed = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    token = [F.xxhash64(F.col("g")[i]) for i in range(4)]
    twos = [F.xxhash64(token[i], token[i + 1]) for i in range(3)]
    four = F.shiftrightunsigned(F.xxhash64(twos[0], twos[2]), 24)
    of = {tuple(r.g): r.h for r in hashed.select("g", four.alias("h")).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        h = [of[tuple(words[k : k + 4])] for k in range(len(words) - 3)]
        if not h:
            continue
        chosen = set()
        for at in range(max(1, len(h) - 7)):
            window = range(at, min(at + 8, len(h)))
            chosen.add(max((k for k in window if h[k] == min(h[w] for w in window))))
        assert sorted(found[i], key=lambda x: x[1]) == [(h[k], k) for k in sorted(chosen)]


def test_likeness_of_repeated_rows(spark):
    rng = random.Random(7)
    texts = {1: sentence(rng, 80), 2: sentence(rng, 90), 4: sentence(rng, 5), 9: None}
    rows = [(i, t) for i, t in texts.items()] + [(2, texts[2]), (2, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = winnowing.fingerprinted_documents(df).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == [1, 2, 2, 2, 4, 9]

    def bag(s):
        return {x.split(":")[0] for x in s.split(",") if x}

    prints = {r.doc_id: bag(r.fingerprint) for r in found}
    for r in found:
        both = bag(r.fingerprint) | bag(r.edited_fingerprint)
        alike = len(bag(r.fingerprint) & bag(r.edited_fingerprint)) / len(both) if both else 1.0
        assert r.near_edited == pytest.approx(alike)
    likely = {r.doc_id: r.near_next for r in found if r.doc_id in (1, 4, 9)}
    for i, j in ((1, 9), (4, 2), (9, 4)):
        union = prints[i] | prints[j]
        assert likely[i] == pytest.approx(len(prints[i] & prints[j]) / len(union) if union else 1.0)
    assert sorted(r.near_next for r in found if r.doc_id == 2)[-2:] == [1.0, 1.0]


# -- SQL and the pipeline ------------------------------------------------------------


def plain(value):
    return "" if value is None else repr(float(value)) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = LLM_QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = con.sql(LLM_ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder: documents with nulls, repeats, copies and further columns."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 90_000)
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.union(docs.limit(4)).union(more).union(odd)
    every = every.withColumns({"_salt": F.lit(1), "u": F.lit("x"), "quality": F.lit(0.5)})
    every.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_of_the_pipeline(spark, corpus):
    """Each stage on what the one before kept, against the operator's own report."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    with intermediate_tables(spark):
        before = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, corpus)
            assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
            after = spark.createDataFrame(after.collect(), after.schema)
            kept = sorted((r.doc_id or -1) for r in after.select("doc_id").collect())
            if name == "quality":
                report = quality.quality(before, spark.read.parquet(f"{corpus}/labels.parquet"))
                assert kept == sorted((r.doc_id or -1) for r in report.where("kept").collect())
                assert 0 < len(kept) < before.count()
            elif name == "near_duplicates":
                groups = near_duplicates.near_duplicates(before, 5)
                gone = {r.doc_id for r in groups.where("not kept").collect()}
                expected = sorted((r.doc_id or -1) for r in before.collect() if r.doc_id not in gone or r.doc_id is None)
                assert kept == expected
            elif name == "personal_data":
                assert kept == sorted((r.doc_id or -1) for r in before.select("doc_id").collect())
                texts = "\n".join(r.text or "" for r in after.collect())
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts)
                assert after.where("text is not null and n_chars <> char_length(text)").count() == 0
            else:
                report = mixing.mix_report(mixing.mix_plan(before)).collect()
                words = sum(r.taken for r in report)
                assert after.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == words
            before = after
        ids = corpus_pipeline.STAGES[-1][1](spark, before, corpus).collect()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    texts = {}
    for r in before.collect():
        texts.setdefault(r.doc_id, set()).add(tuple(library.encode(r.text or "")))
    assert all(tuple(r.ids) in texts[r.doc_id] and r.n_tokens == len(r.ids) for r in ids)
    assert len(ids) == before.count()


def test_the_whole_run(spark, corpus):
    found = corpus_pipeline.run(spark, corpus)
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    counts = {}
    for r in found.select("doc_id", "n_tokens").collect():
        counts.setdefault(r.doc_id, []).append(r.n_tokens)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert set(counts) <= {r.doc_id for r in docs.select("doc_id").collect()} and counts
    # copies of a row in the mix are encoded alike, and none is taken too often
    copies = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    for doc_id, tokens in counts.items():
        assert len(tokens) <= mixing.MAX_EPOCHS * copies[doc_id]
        assert doc_id is None or len(set(tokens)) == 1


def test_the_whole_run_over_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
