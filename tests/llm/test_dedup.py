"""Operators 1, 2 and 7 against brute force."""

import os
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from strandwise.llm import common, embedding_dedup, jaccard_join, queries, substring_dedup  # noqa: E402
from strandwise.llm.common import Words, batches, mix  # noqa: E402
from strandwise.llm.components import components  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "1 AS n", "'x' AS key", "2 AS component", "0 AS pack") if extra else df


def test_a_batch_of_texts_takes_little_memory():
    """What a task holds while it finds the n-grams of a batch."""
    rng = np.random.default_rng(1)
    texts, size = [], 0
    while size < jaccard_join._BATCH:
        texts.append(" ".join(f"w{x}" for x in rng.integers(0, 99_999, 300)))
        size += len(texts[-1])
    tracemalloc.start()
    grams, first = jaccard_join.gram_sets(pa.array(texts), 5)
    jaccard_join.arrange((grams[:0], grams[:0]), grams, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and len(grams) > 40_000


def test_words_match_split():
    rng = random.Random(3)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab é\n\t Z") for _ in range(rng.randint(0, 12))) for _ in range(7)]
        array = pa.array(texts, pa.string()).slice(rng.randint(0, 3))
        words = Words(array, lower=True)
        expected = [w for t in array.to_pylist() if t for w in t.encode().lower().split()]
        assert [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)] == expected
        assert np.diff(words.first).tolist() == [len((t or "").encode().split()) for t in array.to_pylist()]
        assert len(dict(zip(expected, words.hash.tolist()))) == len(set(words.hash.tolist()))


def test_batches_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"k": list(range(5)), "text": ["a" * 10, None, "b" * 100, "", "c"]})
    assert [k for b in batches([batch], "text", 20) for k in b.column(0).to_pylist()] == list(range(5))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(5, 5), (1000, 1001)] + [(i, i + 1) for i in range(2000, 2100)]
    found = components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    expected = brute.union({i for p in links for i in p}, links)
    assert {r.node: r.component for r in found} == {i: c for i, c in expected.items() if any(i in p and p[0] != p[1] for p in links)}
    assert len({r.node for r in found}) == len(found)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), int(rng.integers(0, 2))) for i in range(150)]
    for i in range(150, 300):
        _, v, label = rows[int(rng.integers(0, 20))]
        rows.append((i, (np.array(v) + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).tolist(), label))
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1e300] * 16, [1e-300] * 16, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(900 + i, v, 1) for i, v in enumerate(odd)] + [(950, [1.0] * 16, None)]


@pytest.mark.parametrize("leaf", [1024, 50])
def test_embeddings(spark, leaf):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 AS rep", "1 AS node")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, leaf=leaf).collect()}
    assert found == brute.embeddings(rows)


def test_embedding_recall(spark):
    """At the registered settings, with labels of several leaves: at least 0.99 of the links of
    near vectors, and none that is not there."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    near = base[rng.integers(0, 1500, 2500)] + rng.normal(size=(2500, 64)) * rng.uniform(0.0, 0.25, (2500, 1))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = brute.embeddings([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(found[i][0] <= exact[i][0] for i in exact)
    assert sum(f[0] for f in found.values()) >= 0.99 * sum(e[0] for e in exact.values()) > 2000
    reps = df.selectExpr("vec_id AS rep", "cast(embedding AS array<double>) AS vector", "label")
    leaves = embedding_dedup._leaves(reps, 6, 1024, 0.8 * (0.04 / 64) ** 0.5).groupBy("node").count().collect()
    assert len(leaves) >= 6 * 4 and max(r["count"] for r in leaves) <= 1024


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0


def passages(words):
    rng = random.Random(words)
    base = [rng.choice("abcdefgh é") + str(rng.randint(0, words)) for _ in range(2000)]
    docs = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(1900)
            text += base[at : at + rng.randint(5, 60)]
            if rng.random() < 0.5:
                text.append(f"x{rng.randint(0, 99)}")
        docs.append((rng.randint(-(10**12), 10**12), None if rng.random() < 0.03 else rng.choice([" ", "\n ", "\t"]).join(text)))
    return [*docs, (10**13, ""), (10**13 + 1, " \n"), (10**13 + 2, "a " * 30000), (10**13 + 3, "a " * 20)]


@pytest.mark.parametrize("words", [1, 3, 300])
def test_substrings(spark, words):
    docs = passages(words)
    df = documents(spark, docs)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(df, digest=True, pack_bytes=3000).collect()}
    assert found == brute.substrings(docs)


def test_substring_factors(spark):
    docs = passages(300)
    text = {d: brute.WORD.findall(t or "") for d, t in docs}
    found = substring_dedup.factors(documents(spark, docs), pack_bytes=3000).collect()
    assert found
    for f in found:
        assert f.ref_doc < f.doc_id and f.length >= 13
        assert text[f.doc_id][f.start : f.start + f.length] == text[f.ref_doc][f.ref_start : f.ref_start + f.length]


def test_substrings_repeated_and_null_keys(spark):
    same = " ".join(f"w{i}" for i in range(20))
    rows = [(5, same), (5, same), (7, same), (None, None), (9, "short")]
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove(documents(spark, rows)).collect())
    assert found == [(-1, 0, 0), (5, 20, 0), (5, 20, 0), (7, 20, 20), (9, 5 - 4, 0)]
    kept = substring_dedup.rewrite(documents(spark, rows))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, None), (5, same), (5, same), (9, "short")]
    assert kept.columns == ["doc_id", "text", "n", "key", "component", "pack"]


def test_substrings_registered(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, MORE).collect()}
    assert found == brute.substrings(docs)


def near_copies():
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    docs = []
    for i in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice("abcxyz")
        text = " ".join(words)
        docs.append((i, None if rng.random() < 0.03 else text.upper() if rng.random() < 0.2 else text))
    odd = ["", " ", "a", "A", "a b", "a  b", "b a", "a b c d e", "A B C D E f", "z " * 5000]
    return docs + [(1000 + i, t) for i, t in enumerate(odd)]


@pytest.mark.parametrize("least, block", [(8, 16 << 20), (3, 2000)])
def test_jaccard(spark, least, block):
    docs = near_copies()
    found = jaccard_join.near_components(documents(spark, docs), least=least, block_bytes=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard(docs)


def test_jaccard_registered(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_jaccard(spark, MORE).collect()}
    assert found == brute.jaccard(docs)


def test_jaccard_heads(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (7, ""), (8, None), (9, "q")]
    kept = jaccard_join.heads(documents(spark, rows))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text is not None) == [(-1, "a b c d e f"), (2, "A b c d e f"), (7, ""), (9, "q")]
    assert kept.columns == ["doc_id", "text", "n", "key", "component", "pack"]


def test_jaccard_of_clashing_keys(spark):
    text = lambda name, last: " ".join([*(f"{name}{i}" for i in range(40)), last])
    docs = [(10 * k, text(f"{side}{k}_", "end")) for k in range(1, 9) for side in "ab"]
    copies = [(10 * k + i + 1, text(f"{side}{k}_", "other")) for k in range(1, 9) for i, side in enumerate("ab")]
    found = jaccard_join.near_components(documents(spark, docs + copies)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, i // 10 * 10) for i, _ in docs + copies)
    kept = jaccard_join.heads(documents(spark, docs + copies)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(docs)


def test_trie_prunes_and_shares():
    sets = {1: np.array([1, 2, 3, 4, 5], np.uint64), 2: np.array([1, 2, 3, 4, 9], np.uint64), 3: np.array([7, 8], np.uint64)}
    trie = jaccard_join.Trie(sets)
    probe = np.array([1, 2, 3, 4, 5], np.uint64)
    assert trie.similar(probe, [1, 2, 3], 80) == [1]
    assert sorted(trie.similar(probe, [1, 2, 3], 60)) == [1, 2]


def ordered_sets(rng, groups, copies):
    sets = []
    for _ in range(groups):
        base = rng.choice(1 << 40, int(rng.integers(1, 400)), replace=False)
        for _ in range(copies):
            keep = rng.random(len(base)) > rng.choice([0, 0.05, 0.2])
            sets.append(np.union1d(base[keep], rng.choice(1 << 40, int(rng.integers(0, 30)))).astype(np.uint64))
    return sorted((x for x in sets if len(x)), key=len)


def similar_pairs(sets, chunk, inside):
    out = []
    for b in range(len(sets)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (chunk[a] == chunk[b]) == inside:
                out.append((a, b))
    return out


@pytest.mark.parametrize("inside", [True, False])
def test_block_links(inside):
    rng = np.random.default_rng(11)
    for _ in range(4):
        sets = ordered_sets(rng, 8, 12)
        chunk = rng.integers(0, 1 if inside else 3, len(sets))
        expected = similar_pairs(sets, chunk, inside)
        found = jaccard_join.block_links(sets, chunk, inside, 80)
        assert expected and set(found) <= set(expected) and len(found) < len(sets)
        assert brute.union(range(len(sets)), found) == brute.union(range(len(sets)), expected)


def test_signatures_bound_the_difference():
    sets = ordered_sets(np.random.default_rng(12), 5, 6)
    sign = jaccard_join.signatures(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])])
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert np.bitwise_count(sign[a] ^ sign[b]).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("at_once", [1, 50, 64_000])
def test_signatures_in_pieces(monkeypatch, at_once):
    """Sets of any size, whatever is signed at once, against parities counted one by one."""
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (0, 3, 0, 200, 1, 49, 50, 51, *[7] * 300)]
    monkeypatch.setattr(jaccard_join, "_SIGNED", at_once, raising=False)
    sign = jaccard_join.signatures(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])])
    for x, row in zip(sets, sign):
        odd = np.bincount((mix(x) & np.uint64(2047)).astype(int), minlength=2048) % 2
        assert np.array_equal(np.packbits(odd.astype(bool)).view(np.uint64), row)


def test_a_block_takes_little_memory():
    """What a task holds, besides the sets, while it looks for the links of a block."""
    rng = np.random.default_rng(14)
    sets = [np.sort(rng.integers(0, 1 << 63, 800, np.uint64)) for _ in range(1000)]
    tracemalloc.start()
    try:
        assert jaccard_join.block_links(sets, np.zeros(len(sets), int), True, 80) == []
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * sum(x.nbytes for x in sets)


def test_a_group_gives_memory_back(monkeypatch):
    """Also where its function fails; Spark sees as many arguments as before."""
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    assert common.giving_back(lambda key, table: (key, table))(1, 2) == (1, 2)
    assert common.giving_back(lambda key, left, right: (key, left, right))(1, 2, 3) == (1, 2, 3)
    with pytest.raises(ZeroDivisionError):
        common.giving_back(lambda key, table: key / table)(1, 0)
    assert len(called) == 3
    assert common.giving_back(lambda key, left, right: key).__code__.co_argcount == 3


def test_trie_leaves_subtrees():
    """A path common to many sets is walked once; below a node that can't reach the overlap nothing is."""
    path = np.arange(0, 256, dtype=np.uint64)
    sets = {i: np.r_[path, np.arange(1000 * i + 1000, 1000 * i + 1044, dtype=np.uint64)] for i in range(50)}
    trie = jaccard_join.Trie(sets)
    assert trie.similar(np.r_[path, np.uint64(10**6)], range(50), 80) == list(range(50))
    assert trie.visited == 256 + 50 * 44
    trie = jaccard_join.Trie(sets)
    assert trie.similar(np.arange(10**6, 10**6 + 300, dtype=np.uint64), range(50), 80) == []
    assert trie.visited == 128


def test_jaccard_frequent_passage(spark):
    """One passage in all texts, and groups whose members are too far apart to link."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(25):
            words = [f"x{g}{k}{i}" if rng.random() < 0.01 * (k % 5) else w for i, w in enumerate(base)]
            docs.append((100 * g + k, f"{passage} {' '.join(words)}"))
    found = jaccard_join.near_components(documents(spark, docs), block_bytes=3000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard(docs)


@pytest.mark.parametrize("operator", [substring_dedup.remove, substring_dedup.rewrite, jaccard_join.near_components, jaccard_join.heads])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0
