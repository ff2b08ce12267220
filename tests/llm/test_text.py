"""Operators 3 to 6 and 8 to 10 against libraries, brute force and held-out rows."""

import collections
import hashlib
import os
import random
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import strandwise  # noqa: E402
from strandwise.llm import bpe, language_id, packing, pii, quality_rules, queries, sharding, token_counts  # noqa: E402
from strandwise.llm.common import store  # noqa: E402

MORE = "/root/testdata/sf0.01"
ODD = [
    "a", "b", "é", "é", " ", "\n", "　", "\x1c", "Σ", "ß", "İ", "1", "2", "½", "٣", "漢", "\U0001f389", "'s", "'t", "'",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<", "!", "#", "\xa0", "​", "\x85", "Å", "ﬁ", "the ", "aaaaaa", "hello", "̀", "\x00", "  ",
]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "a" * 5000, "ab" * 3000, "0" * 1000]


def documents(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS length", "'k' AS key", "2 AS row", "3 AS shard")


def test_new_chunks_call_no_python():
    """New chunks and words get their numbers without a Python call each."""
    texts = [" ".join(f"x{i}y" for i in range(at, at + 500)) for at in range(0, 5000, 500)]
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_file(public_tokenizers.path("word_bpe_49k.json"))))
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        found = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert calls["call"] < 1000 and len(encoder.chunks) == 5000
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_chunks_leave_no_objects():
    """Chunks and words stay in Arrow arrays: no object of Python each."""
    text = " ".join(f"{''.join(chr(97 + i // 26**k % 26) for k in range(4))}," for i in range(20_000))
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_file(queries.WORD_BPE)))
    encoder.encode(["first"])
    before = sys.getallocatedblocks()
    encoder.encode([text])
    assert len(encoder.chunks) >= 20_000 and sys.getallocatedblocks() - before < 5_000


def test_known_words_of_new_chunks_are_not_merged_again(monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_file(queries.WORD_BPE)))
    encoder.encode(["unhappiness (straightforward) , ."])
    merged = []
    monkeypatch.setattr(encoder.vocabulary, "_ranks", lambda left, *_: merged.append(len(left)))
    found = encoder.encode(["(unhappiness, straightforward. Unhappiness)"])
    library = Tokenizer.from_file(queries.WORD_BPE)
    assert not merged and found[0].tolist() == library.encode("(unhappiness, straightforward. Unhappiness)", add_special_tokens=False).ids


def test_encoder_outlives_a_task():
    """Tasks get functions by value; those of one worker share its encoder."""
    cloudpickle.register_pickle_by_value(strandwise)
    sent = cloudpickle.dumps(bpe.encoder)
    content = bpe.read_file(queries.WORD_BPE)
    assert cloudpickle.loads(sent)(content) is cloudpickle.loads(sent)(content)


def test_words_by_kinds_equal_those_of_the_pattern():
    known = bpe.Vocabulary(bpe.read_file(queries.WORD_BPE))
    rng = random.Random(3)
    parts = [x for x in ODD if not set(x) & set(bpe.WHITE_SPACE)] + ["'", "s", "t", "re", "ve", "l", "v", "e", "d", "Ⅷ", "²", "\n", "\n"]
    lines = "".join(rng.choice(parts) for _ in range(50_000))
    fast = known.words(lines)
    known.by_kinds = False
    slow = known.words(lines)
    assert fast[0].to_pylist() == slow[0].to_pylist() and fast[1].tolist() == slow[1].tolist()


def test_bpe_equals_library(spark):
    texts = odd_texts(1500) + [None]
    library = Tokenizer.from_file(queries.WORD_BPE)
    found = bpe.encode(documents(spark, texts), queries.WORD_BPE)
    ids = {r.doc_id: r.ids for r in found.collect()}
    assert all(ids[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decode(found, queries.WORD_BPE).collect()}
    assert all(back[i] == library.decode(ids[i], skip_special_tokens=False) for i in ids)


def test_bpe_forgets_and_goes_on(monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_file(queries.WORD_BPE)))
    texts = odd_texts(300)
    first = [x.tolist() for x in encoder.encode(texts)]
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 5)
    assert [encoder.encode([t])[0].tolist() for t in texts] == first


def test_merges_one_by_one_agree():
    known = bpe.Vocabulary(bpe.read_file(queries.WORD_BPE))
    words = ["aaaaaaa", "banana", "mississippi", "x", "ababababab"]
    fast = known.encode_words(words)
    known.one_by_one = True
    slow = known.encode_words(words)
    assert fast[0].tolist() == slow[0].tolist() and fast[1].tolist() == slow[1].tolist()


def test_bpe_registered(spark):
    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    for r in queries.op3_bpe(spark, MORE).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_equal_library_and_cache_is_used(spark):
    texts = odd_texts(800) + [None, "again", "again"]
    library = Tokenizer.from_file(queries.BYTE_BPE)
    cache = token_counts.new_cache(spark)
    df = documents(spark, texts)
    for _ in range(2):
        found = {r.doc_id: r for r in token_counts.count_tokens(df, queries.BYTE_BPE, cache).collect()}
        for i, t in enumerate(texts):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((t or "").encode()), n > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    # Another tokenizer's counts are no use.
    stored.selectExpr("content_sha256", "'other' AS tokenizer_sha256", "n_tokens + 1 AS n_tokens").write.mode("append").parquet(cache)
    again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, queries.BYTE_BPE, cache).collect()}
    assert again == {i: r.n_tokens for i, r in found.items()}


def test_counts_of_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c d e"), (1, "x"), (1, "y z"), (1, "y z")], "doc_id long, text string")
    found = token_counts.count_tokens(df, queries.BYTE_BPE, token_counts.new_cache(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 2), (0, 3), (1, 1), (1, 2), (1, 2)]


@pytest.mark.parametrize("width", [7, 50])
def test_packing_plan(width):
    rng = random.Random(width)
    for _ in range(30):
        counts = collections.Counter(rng.randint(1, width) for _ in range(rng.randint(0, 60)))
        steps, sequences = packing.plan(counts, width)
        used = collections.defaultdict(list)
        for length, _, n, first, offset in steps.tolist():
            for i in range(n):
                used[first + i].append((offset, length))
        assert len(used) == sequences and sum(len(u) for u in used.values()) == counts.total()
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= width
        # Best-fit decreasing one by one needs as many.
        gaps = []
        for length in sorted(counts.elements(), reverse=True):
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((width if fit is None else fit) - length)
        assert sequences == len(gaps)


def test_packing_registered(spark):
    library = Tokenizer.from_file(queries.WORD_BPE)
    ids = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    seen, used = collections.Counter(), collections.defaultdict(list)
    for r in queries.op4_packing(spark, MORE).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(part) == r.length and zlib.crc32(part) == r.ids_crc32
        used[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in ids.items()}
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
        assert sum(n for _, n in parts) <= 2048
    assert len(used) <= 1.01 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a " * 5000)], "doc_id long, text string")
    found = packing.pack_documents(df, queries.WORD_BPE).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in found) == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 2048), (2, 1, 2048), (2, 2, 905)]


def test_packing_holds_one_worker_per_task(spark, monkeypatch):
    """Every plan has one step in Python: a task with two holds two workers, which stay alive."""
    plans = []

    def stored(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(packing, "store", stored)
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a " * 5000)], "doc_id long, text string")
    found = packing.pack_documents(df, queries.WORD_BPE)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert [p.count("MapInArrow") for p in plans] == [1, 1]
    assert sorted((r.doc_id, r.piece, r.length) for r in found.collect()) == [(1, 0, 3), (2, 0, 1), (3, 0, 2048), (3, 1, 2048), (3, 2, 905)]


def test_quality_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a " * 5000] + ["".join(rng.choice(["a ", "bc ", "é", "#", "\n", "|", " ", "x y z "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    found = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts).selectExpr("*", "CAST(NULL AS STRING) AS lang", "'s' AS source")).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.base_failed and r.kept)


def test_quality_finds_outliers(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = [r for r in queries.op6_quality_rules(spark, MORE).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id].quality == 1)
    bad = [r for r in rows if labels[r.doc_id].quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) > 0


def test_chi_square_quantile():
    assert quality_rules.chi_square_quantile(0.5, 5) == pytest.approx(4.351, rel=0.01)
    assert quality_rules.chi_square_quantile(0.01, 5) == pytest.approx(15.086, rel=0.01)


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, MORE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spoiled).collect()} == plain


def test_language_of_odd_rows(spark):
    texts = ["the cat is here and there"] * 8 + ["der hund ist hier und dort"] * 8 + [None, "", "123 !!", "the cat " * 20000, "x"]
    langs = ["en"] * 8 + ["de"] * 8 + [None] * 5
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [found[i].lang_pred for i in (0, 8, 16, 17, 18, 19)] == ["en", "de", "und", "und", "und", "en"]
    none = language_id.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_bloom_filter_corrects_false_positives():
    known = language_id.Filter(["a", "b"])
    rng = np.random.default_rng(1)
    known.add(0, rng.integers(0, 1 << 40, 400_000).astype(np.uint64))
    known.add(1, np.arange(10, dtype=np.uint64))
    known.seal()
    assert known.false_positive[0] > 0.01 > known.false_positive[1]


def test_private_base_spans(spark):
    rng = random.Random(9)
    parts = ["1", "23", "4", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "\U0001f389", "\n", "_", "%", "\x01", "\x03",
             "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+1 (900) 555-2077"]
    texts = [None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["1 2 " * 9000, "a" * 50000, "a." * 20000 + "@b.c", "x@" + "a." * 20000 + "b", "7" * 50000, "+1" + "(" * 50000, "1.2.3.4 " * 500]
    df = documents(spark, texts)
    for r in pii.detect(df).collect():
        spans = brute.private(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        count = collections.Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
    out = {r.doc_id: r.text for r in pii.redact(df).select("doc_id", "text").collect()}
    assert out[0] is None and len(out) == len(texts)
    assert all(not brute.private(t) or out[i] != t for i, t in enumerate(texts))


def test_private_adds_named_secrets(spark):
    rows = pii.detect(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    added = [s for r in rows.select("spans").collect() for s in r.spans.split(",") if s and s.split(":")[0] not in pii.BASE]
    assert sum(s.startswith("secret:") for s in added) > 50


def test_private_keeps_rare_secrets(spark):
    rng = random.Random(3)
    value = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(24))
    texts = [" and ".join(f"{rng.randint(10**7, 10**9)}" for _ in range(20)) for _ in range(1000)]
    texts += [f'id {value()} then token = "{value()}"' for _ in range(60)]
    candidates = pii._features(pii.find(documents(spark, texts)))
    # 20,000 numbers, 60 secrets, and a sample that a uniform draw fills with numbers.
    _, thresholds, scored = pii.learn(candidates, sample=400)
    assert 1 in thresholds
    assert scored.count() == candidates.count()
    assert scored.filter("generator = 1 AND label = 1").filter(scored.score >= thresholds[1]).count() == 60


def test_private_assignments(spark):
    value = "sk_live_0123456789abcdef"
    texts = [
        f"api_key={value}", f"PASSWORD={value}", f"export AWS_SECRET_ACCESS_KEY={value}", f"https://a.example/some/long/path?x=1&token={value}&y=2",
        f"token:{value}", f'token = "{value}"', "secret=QUJDREVGR0hJSktMTU5PUA== end", f"nothing={value}",
    ]
    found = pii._features(pii.find(documents(spark, texts))).filter("generator = 1")
    text = {r.row: texts[r.key] for r in pii.find(documents(spark, texts)).select("row", "key").collect()}
    named = collections.defaultdict(set)
    for r in found.collect():
        named[text[r.row]] |= {text[r.row][r.start : r.end]} if r.label else set()
    assert [named[t] for t in texts] == [{value}] * 6 + [{"QUJDREVGR0hJSktMTU5PUA=="}, set()]


def test_private_long_number_runs(spark):
    texts = ["n " + "12 34-" * 40 + "5 and 1234567 8a", "7" * 300, "1" + "-" * 50000 + "a"]
    rows = pii.find(documents(spark, texts)).select("key", "found_number").collect()
    found = {r.key: [(s.start, s.end) for s in r.found_number] for r in rows}
    assert found == {0: [(2, 243), (248, 255)], 1: [(0, 300)], 2: []}


def test_thresholds_count_for_the_fitted():
    strata = {(1, 1.0): 40, (1, 0.0): 1000}
    # 10 of 40 are outside the fit, and 999 of 1,000: 40 right ones at 80, with 4 wrong ones.
    steps = [(1, 1.0, 80, 10), (1, 0.0, 80, 4), (1, 0.0, 60, 495), (1, 0.0, 10, 500)]
    assert pii.thresholds(strata, steps, 0.9) == {1: 0.8}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz now", 7), (1, None, 8), (None, "ip 1.2.3.4", 9)], "doc_id long, text string, row int")
    found = pii.redact(df)
    assert found.columns == df.columns
    assert sorted((r.row, r.text) for r in found.collect()) == [(7, "mail [EMAIL] now"), (8, None), (9, "ip [IP]")]


def test_redaction_of_any_columns(spark):
    """Names that the operator could use itself, twice the same name, repeated rows, overlapping spans."""
    row = (1, "a x@y.zz b 1.2.3.4", "A", 2, "B", "C")
    df = spark.createDataFrame([row, row], "doc_id long, text string, _row string, number int, _spans string, _text string")
    df = df.withColumnsRenamed({"_text": "key"}).select("*", F.col("number").alias("c1"), F.col("key").alias("spans"))
    found = pii.redact(df)
    assert found.columns == df.columns
    assert [tuple(r) for r in found.collect()] == [(1, "a [EMAIL] b [IP]", "A", 2, "B", "C", 2, "C")] * 2
    assert pii.redact(df.select("text", "key", "key")).columns == ["text", "key", "key"]


@pytest.mark.parametrize("n", [1, 255, 256, 257, 40_000])
def test_many_matches_in_a_text(spark, n):
    """Positions over the pieces' bounds, and time that doesn't grow with the square of the matches."""
    text = "é 1.2.3.4 " * n
    begun = time.time()
    found = pii.find(documents(spark, [text])).first()
    assert [(s.start, s.end) for s in found.ip] == [(10 * i + 2, 10 * i + 9) for i in range(n)]
    assert pii.redact(documents(spark, [text])).first().text == "é [IP] " * n
    assert time.time() - begun < 90


def test_candidates_under_base_spans(spark):
    rng = random.Random(4)
    parts = ["1.2.3.4", "x@y.zz", "4111111111111111", "+1 (900) 555-2077", "abcdefghijklmnop0123", " ", "-", "7", "@", "12 34 56"]
    found = pii.find(documents(spark, ["".join(rng.choice(parts) for _ in range(60)) for _ in range(40)]))
    base = {r.row: [(s.start, s.end) for k in pii.BASE for s in r[k]] for r in found.collect()}
    rows = pii._features(found).collect()
    assert len(rows) == sum(len(r[f"found_{g}"]) for r in found.collect() for g in pii.GENERATORS)
    assert all(r.covered == any(a < r.end and b > r.start for a, b in base[r.row]) for r in rows)
    assert len({r.covered for r in rows}) == 2


def test_packing_plan_opens_only_what_is_filled():
    # {5, 5, 5} and {5, 4, 4, 4}: two sequences, as one by one.
    assert packing.plan({5: 4, 4: 3}, 17)[1] == 2


def test_shards(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    rows = queries.op10_shards(spark, MORE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = collections.defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
        assert r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    assert set(shards) == set(range(40))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sizes = [sum(r.size for r in s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)


def test_shards_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20, "en", "a") for i in range(400)] + [(400 + i, f"text {i} " * (i % 17 + 1), "de", str(i % 5)) for i in range(800)] + [(None, None, None, None)] * 3
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8).collect()
    sizes = collections.Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len(found) == len(rows) and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8


TEXT_TABLE = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: bpe.digests(df, queries.WORD_BPE),
        lambda df: packing.pack_documents(df, queries.WORD_BPE),
        lambda df: token_counts.count_tokens(df, queries.BYTE_BPE, token_counts.new_cache(df.sparkSession)),
        quality_rules.judge,
        language_id.identify,
        pii.detect,
        pii.redact,
        sharding.shard,
    ],
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], TEXT_TABLE)).count() == 0
