"""Training-data operators on small tables with every awkward row, against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from carequeue.llm import (
    chat,
    fertility,
    mixing,
    near_duplicates,
    personal_data,
    quality,
    sentencepiece_spans,
    suffix_dedup,
    token_counts,
    winnowing,
)
from carequeue.llm.registry import PIECE_MODEL, WORD_MODEL, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, size int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [sentence(rng, 70) for _ in range(12)]
    near = texts[0].split()
    near[3] = "changed"
    texts += [
        texts[0], texts[0].upper(), " ".join(near), "", None, "one", "Écrit ▁ à a.b@mail.org\n",
        "x" * 6000, "ab " * 300, "<|endoftext|> it's ΣΑΣ [INST]", texts[1] + " " + texts[2],
        "call +1 (555) 555-0100 or 10.0.0.255, card 4111 1111 1111 1111.",
    ]
    made = [
        (i, t, ["en", None, "fr"][i % 3], ["s1", None, "s2"][i % 3], None, 7, 8)
        for i, t in enumerate(texts)
    ]
    return [*made, made[-1]]  # a row twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets(docs, empty, rows):
    mix = mixing.mix_plan(docs)
    found = mixing.mix_report(mix).collect()
    assert len(found) == len(rows)
    assert all(r.taken <= 3 * r["size"] for r in found)
    largest = max(r["size"] for r in found)
    for target, size in {(r.target, r.source_size) for r in found}:
        taken = sum(r.taken for r in found if (r.target, r.source_size) == (target, size))
        assert abs(taken - target) <= 2 * largest
    again = mixing.mix_report(mixing.mix_plan(docs)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    assert mixing.mixed_documents(docs, mix).columns == docs.columns
    assert mixing.mix_report(mixing.mix_plan(empty)).count() == 0


def test_chat_reads_back_what_went_in(spark):
    said = [
        (1, 0, "user", "</s>[INST] \\<| ok"), (1, 1, "assistant", "<|end|>\n\\["),
        (1, 1, "assistant", "<|end|>\n\\["), (None, 0, None, None), (2, None, "a|>\nb", "t"),
    ]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_paths(chat.linear_messages(df)))).collect()}
    for conv in (1, 2, None):
        mine = [(r or "", t or "") for c, _, r, t in said if c == conv]
        whole = "".join(f"{r}\n{t}\n" for r, t in mine)
        learned = "".join(t for r, t in mine if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert got[conv].n_turns == len(mine)
    assert chat.format_paths(chat.linear_messages(df.where("false"))).count() == 0


def test_branches_are_ranked(spark):
    tree = spark.createDataFrame(
        [("c", 1, 1, None, "user", "q", 1.0), ("c", 1, 2, 1, "assistant", "a", 0.2),
         ("c", 1, 3, 1, "assistant", "b", 0.9), ("c", 1, 4, 3, "user", "more", 0.9)],
        "_conv string, conv_id long, node long, parent long, role string, text string, score double",
    )
    best = chat.format_paths(tree, branches=1).collect()
    assert [r.leaf for r in best] == [4]
    assert best[0].formatted.count("<|end|>") == 3
    assert chat.format_paths(tree).count() == 2


def test_sentencepiece_equals_library(docs, empty, rows):
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {r.doc_id: r for r in sentencepiece_spans.encoded_documents(docs, path).collect()}
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in sentencepiece_spans.document_spans(docs, path).collect():
        size = len((rows[r.doc_id][1] or "").encode())
        assert [0, *r.ends] == [*r.begins, size]
    assert sentencepiece_spans.encoded_documents(empty, path).count() == 0


def test_compiled_character_map_keeps_alignment():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pb.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    found = sentencepiece_spans.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ("ﬁne", "①②", "ｱﾞ", "plain"):
        data, out, at = text.encode(), [], 0
        while at < len(data):
            hit = found.longest(data, at)
            size = hit[1] if hit else len(data[at:].decode()[0].encode())
            out.append(hit[0] if hit else data[at : at + size])
            at += size
        assert b"".join(out).decode() == normalizer.normalize(text).removeprefix("▁")


@pytest.mark.parametrize("chunk", [3, 50, 100_000])
def test_token_counts_equal_library(rows, chunk):
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_MODEL)
    library, own = Tokenizer.from_file(path), token_counts.transducer_of(path, token_counts.letters_of(path))
    for _, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert own.count(text or "", chunk) == len(ids)


def test_token_counts_table(docs, empty):
    path = tokenizer_path(WORD_MODEL)
    found = token_counts.counted_documents(docs, path, limit=1000)
    assert {r.n_tokens for r in found.where("text is null" if "text" in found.columns else "n_bytes = 0").collect()} == {0}
    assert token_counts.counted_documents(empty, path).count() == 0


def test_base_patterns_equal_plain_regexes():
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and personal_data.luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    rng = random.Random(4)
    parts = ["a", ".", "@", "1", "25", "255", "+", "-", " ", "(", "é", "4111111111111111", "x.y", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        expected = {
            k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in plain.items()
        }
        assert personal_data.base_spans(text) == expected


def test_personal_data_adds_and_keeps(docs, empty):
    texts = [f"reach joe{i}.b@mail{i}.example.com or +1 ({200 + i}) 555-01{i:02} now" for i in range(60)]
    model = personal_data.fit(texts)
    first, every = personal_data.all_spans("mail joe.x [at] host [dot] org or a@b.co", model)
    assert set(first) < set(every)
    assert personal_data.all_spans("version 2.0 of 1999", model)[1] == []
    redacted = {r.doc_id: r.text for r in personal_data.redacted_documents(docs, model).collect()}
    assert redacted[23] == "call <PHONE> or <IP>, card <CARD>."
    assert redacted[16] is None and redacted[15] == ""
    assert personal_data.personal_data(empty).count() == 0


def brute_components(rows, words):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(docs, empty, rows):
    expected = brute_components(rows, 2)
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_suffix_dedup_equals_brute_force(docs, empty, rows):
    seen, expected = set(), {}
    for i, text, *_ in rows[:-1]:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            s = data[at : at + 100]
            if s in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        expected[i] = (len(data), sum(gone), hashlib.sha256(kept).hexdigest())
    found = suffix_dedup.deduplicated(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in found} == expected
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_winnowing(docs, empty, rows):
    found = {r.doc_id: r for r in winnowing.fingerprinted_documents(docs.dropDuplicates(["doc_id"])).collect()}
    texts = {i: t or "" for i, t, *_ in rows}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and found[i].n_chars == len(text)
    assert found[0].fingerprint == found[12].fingerprint != found[1].fingerprint
    assert winnowing.fingerprinted_documents(empty).count() == 0


@pytest.mark.parametrize("first, last", [("一", "龥"), ("ก", "ฮ"), ("ぁ", "ゖ"), ("a", "z"), ("𠀀", "𠿿")])
def test_winnowing_of_unspaced_text(spark, first, last):
    rng = random.Random(6)
    text = "".join(chr(rng.randint(ord(first), ord(last))) for _ in range(5000))
    made = [(text, first + text), (text, text[:2500] + first + text[2500:]), (text, text[1:] + " end")]
    df = spark.createDataFrame(made, "a string, b string")
    for side in "ab":
        df = winnowing.fingerprint_columns(df, side, f"_{side}")
    for r in df.select(winnowing.likeness(F.col("_a"), F.col("_b")).alias("same"), F.size("_a").alias("n")).collect():
        assert r.same > 0.97 and r.n > 500


def test_winnowing_tokens(spark):
    texts = {
        "short words\tand\n16 sixteen-letters": ["short", "words", "and", "16", "sixteen-letters"],
        "x" * 16 + " " + "y" * 17: ["x" * 16, *"y" * 17],
        "一二 ab三cd，四": ["一", "二", "ab", "三", "cd，", "四"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", F.regexp_extract_all("t", F.lit(winnowing._TOKENS), F.lit(0)).alias("of")).collect()
    assert {r.t: r.of for r in found} == texts


def test_fertility_figures(docs, empty, rows):
    found = {r.doc_id: r for r in fertility.quality_rules(docs, tokenizer_path(PIECE_MODEL)).collect()}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert not (r.base_failed and r.kept)
    assert fertility.quality_rules(empty, tokenizer_path(PIECE_MODEL)).count() == 0


def test_fertility_counts_the_tokens_of_the_encoder(docs, rows):
    encoder = sentencepiece_spans.encoder_of(tokenizer_path(PIECE_MODEL))
    found = {r.doc_id: r for r in fertility.figures(docs, tokenizer_path(PIECE_MODEL)).collect()}
    for i, text, *_ in rows:
        ids = encoder.encode(text or "")
        spelled = sum(k in encoder.byte_of for k in ids)
        assert found[i].n_tokens == len(ids)
        assert found[i].byte_share == (spelled / len(ids) if ids else 0.0)


def test_fertility_bands_on_small_tables(spark):
    rng = random.Random(5)
    words = (
        "time house water people world school night story paper music light field green small town"
        " river letter winter garden father mother table window street summer morning doctor market"
        " island forest bridge engine picture village teacher kitchen history machine weather"
    ).split()
    clean = [" ".join(rng.choice(words) for _ in range(rng.choice([60, 120, 250]))) for _ in range(30)]
    clean.append(" ".join(rng.choice(words) for _ in range(6000)))  # alone in its size class
    junk = " ".join(f"{''.join(rng.choice('qxzjkvw') for _ in range(7))}\u0e5b\u0d79" for _ in range(5000))
    made = [(i, t, "en") for i, t in enumerate([*clean, junk, junk[:900]])]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    found = fertility.quality_rules(df, tokenizer_path(PIECE_MODEL)).collect()
    assert len(found) == len(made) and not any(r.base_failed for r in found if r.doc_id >= 30)
    assert {r.doc_id for r in found if not r.kept and not r.base_failed} == {31, 32}


def test_fertility_width(spark):
    folder = "/root/testdata/sf0.1"  # the width is chosen on even ids and tried on odd ones
    df = spark.read.parquet(f"{folder}/documents.parquet").repartition(16)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = fertility.measured(df, tokenizer_path(PIECE_MODEL)).where("not base_failed")
    found = rows.join(labels, "doc_id").select("doc_id", "quality", "beyond").collect()
    beyond = {(h, q): [r.beyond for r in found if (r.doc_id % 2, r.quality) == (h, q)] for h in (0, 1) for q in (0, 1)}

    def rejected(half, label, width):
        return sum(x > width for x in beyond[half, label]) / len(beyond[half, label])

    assert rejected(0, 1, fertility.WIDTH) <= 0.005 < rejected(0, 1, fertility.WIDTH - 0.25)
    assert rejected(1, 0, fertility.WIDTH) >= 0.75
    assert rejected(1, 1, fertility.WIDTH) <= 0.005


def test_fertility_rejects_junk(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clean = df.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    clean = [(r.doc_id, r.text, r.lang) for r in clean.select("doc_id", "text", "lang").collect()]
    words = [w for _, text, lang in clean if lang == "en" for w in text.split()][:300]
    junk = [
        (-1, " ".join(f"{w}{c * 3}" for w, c in zip(words, "%&#$" * 75)), "en"),
        (-2, " | ".join(words), "en"),
    ]
    made = spark.createDataFrame([*clean, *junk], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in fertility.quality_rules(made.repartition(4), tokenizer_path(PIECE_MODEL)).collect()}
    assert not any(found[i].base_failed or found[i].kept for i, *_ in junk)
    passed = [found[i] for i, *_ in clean if not found[i].base_failed]
    assert sum(r.kept for r in passed) >= 0.99 * len(passed)


def test_quality_held_out(spark, empty, docs):
    folder = "/root/testdata/sf0.1"  # some 2,000 labels to learn from, as many held out
    df = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.where("doc_id % 2 = 1").collect()}
    found = {r.doc_id: r.kept for r in quality.quality(df, labels.where("doc_id % 2 = 0")).collect()}
    right = sum(found[i] == g for i, g in good.items())
    majority = max(sum(good.values()), len(good) - sum(good.values()))
    assert len(found) == df.count()
    assert right > majority + (len(good) - majority) / 2
    assert sum(found[i] for i, g in good.items() if g) >= 0.97 * sum(good.values())
    assert quality.good_documents(docs, labels.where("false")).count() == docs.count()
    assert quality.quality(empty, labels).count() == 0


def test_texts_go_to_a_worker_once(docs, rows, monkeypatch):
    sent = []
    for of in (quality, personal_data):
        def noted(df, *args, made=of.map_rows, **more):
            sent.append(df.schema.simpleString())
            return made(df, *args, **more)

        monkeypatch.setattr(of, "map_rows", noted)
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    good = quality.good_documents(docs, labels)
    redacted = personal_data.redacted_documents(docs, personal_data.fit([]))
    assert [s.count("text:string") for s in sent] == [1] * len(sent) and len(sent) == 4
    assert good.columns == redacted.columns == docs.columns
    key = lambda r: (r.doc_id, r.text or "")
    assert sorted(good.collect(), key=key) == sorted(docs.collect(), key=key)
    found = redacted.collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in rows)
    assert [r.doc_id for r in found if r.text is None] == [i for i, t, *_ in rows if t is None]
