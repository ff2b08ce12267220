"""Operators 11 to 13 against brute force."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from strandwise.llm import grid, hard_negatives, lexical_search, nearest, queries  # noqa: E402

MORE = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(n=400, dim=8):
    """Ties, repeated rows and ids, mixed lengths, odd components, missing ids and labels."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-3, 4, dim).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-6, 6)).tolist(), int(rng.integers(0, 3))) for i in range(0, 200, 4)]
    rows += rows[:5] * 2 + [(None, rows[0][1], 0), (None, rows[1][1], 1), (300, rows[2][1], None), (100, None, 1), (200, [], 1)]
    odd = [[0.0] * dim, [1.0, None] * (dim // 2), [float("nan")] * dim, [float("inf")] * dim, [1e-310] * dim, [1e-200, *[0.0] * (dim - 1)]]
    return rows + [(1000 + 100 * i, v, 1) for i, v in enumerate(odd)]


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "1 AS row", "2 AS id", "3 AS cell", "4 AS side", "'d' AS dim")


@pytest.mark.parametrize("blocks", [{}, {"query_block": 5, "row_block": 60}])
def test_nearest(spark, blocks):
    rows = vectors()
    found = nearest.nearest(table(spark, rows), **blocks)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert listed(found) == brute.nearest([r[:2] for r in rows])


def test_nearest_with_overflow(spark):
    rows = [(20 * i, [1e300 * (i - 2), 1.0], 1) for i in range(5)]
    found = {(r.query_id, r.vec_id): r.score for r in nearest.nearest(table(spark, rows)).collect()}
    assert len(found) == 20 and found[0, 20] == float("inf") and found[0, 80] == float("-inf") and found[40, 0] == 1.0


def test_tiles_spare_products():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(6000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    arrays = lambda at: [pa.array(np.arange(6000)[at]), pa.array(np.arange(6000)[at]), pa.array(list(data[at]))]
    state = nearest._Nearest(pa.Table.from_arrays(arrays(slice(0, 50)), ["row", "id", "vector"]), 20)
    state.feed(pa.RecordBatch.from_arrays(arrays(slice(0, 6000)), ["row", "id", "vector"]))
    truth = data[:50] @ data.T
    truth[np.arange(50), np.arange(50)] = -9
    assert (state.best.held["id"] == np.argsort(-truth, axis=1)[:, :20]).all()
    assert state.survived < 0.1 * truth.size


def test_code_bounds_hold():
    rng = np.random.default_rng(2)
    for spread in (0.0, 3.0, 30.0):
        x, y = (rng.normal(size=(40, 1500)) * 10 ** (spread * rng.normal(size=(40, 1500))) for _ in range(2))
        a, b = nearest.Codes(x), nearest.Codes(y)
        near = a.products(b) * a.scale[:, None] * b.scale
        assert (np.abs(near - x @ y.T) <= a.rest[:, None] * b.size + a.known[:, None] * b.rest).all()
        assert (a.products(b) == a.codes.astype(np.int64) @ b.codes.astype(np.int64).T).all()


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "row_block": 60}])
def test_hard_negatives(spark, blocks):
    rows = vectors()
    for settings in ({"every": 10}, {"every": 4, "positives": 9, "negatives": 2, "low": 30}):
        found = listed(hard_negatives.mine(table(spark, rows), **settings, **blocks))
        assert found == brute.hard_negatives(rows, **settings) and len(found) > 100


def test_hard_negatives_of_large_numbers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 6) for _ in range(4)], rng.randint(0, 1)) for i in range(60)]
    assert listed(hard_negatives.mine(table(spark, rows), every=3)) == brute.hard_negatives(rows, every=3)
    # Products that don't fit are the largest number.
    rows = [(0, [1e200, 0.0], 1), (1, [1e200, 0.0], 1), (2, [1e190, 1.0], 2)]
    assert listed(hard_negatives.mine(table(spark, rows))) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_keys_sort_like_their_fields():
    rng = random.Random(4)
    number = lambda: rng.choice([-(2**63), -5, -1, 0, 1, 2, 2**63 - 1])
    fields = [(number(), number(), number(), rng.randint(0, 1), rng.randint(0, 1), number(), number()) for _ in range(300)]
    keys = np.empty(len(fields), hard_negatives.KEY)
    for name, values in zip(hard_negatives.KEY.names, zip(*fields)):
        wide = name not in ("negative", "missing")
        keys[name] = hard_negatives._shift(np.array(values, np.int64)) if wide else values
    by_bytes = sorted(range(300), key=lambda i: keys[i].tobytes())
    assert [fields[i] for i in by_bytes] == sorted(fields)
    assert hard_negatives._back(keys["below"]).tolist() == [f[2] for f in fields]


WORDS = ["the", "The", "cat", "CAT", "é", "É", "İ", "漢字", "x1", "1", " ", "dog", "sat", "ran", "x2", "bird"]


def corpus(n=300):
    rng = random.Random(11)
    text = lambda most: "".join(rng.choice(WORDS) + rng.choice([" ", "\n", "-", "\x00", "", "'", "_"]) for _ in range(rng.randint(0, most)))
    docs = [(rng.randint(-50, 10**6), text(12)) for _ in range(n)]
    docs += [(10**7 + i, docs[i % 7][1]) for i in range(90)] + [(None, docs[0][1]), (None, None), (5, None), (6, ""), (7, " .. "), (8, "the cat " * 20000), (8, "the cat")]
    rng.shuffle(docs)
    items = [(i, text(8)) for i in range(40)] + [(100, None), (101, ""), (None, "the cat"), (102, "unknown words"), (103, "cat " * 500), (7, "dog sat")]
    return docs, items


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_search(spark, block):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS class", "2 AS m", "3 AS item", "'b' AS bag")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    found = lexical_search.search(df, asked, block_bytes=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert listed(found) == brute.search(docs, items)


def test_search_takes_no_hash_for_a_word(monkeypatch):
    docs, items = corpus(50)
    texts = [t for _, t in docs]
    plain = lexical_search.Vocabulary([t for _, t in items])
    expected = plain.find(lexical_search.term_words(pa.array(texts)))

    def weak(texts):
        words = lexical_search.Words(lexical_search.pa.array(texts)) if isinstance(texts, list) else whole(texts)
        words.hash = words.hash % np.uint64(3)
        return words

    whole = lexical_search.term_words
    monkeypatch.setattr(lexical_search, "term_words", weak)
    known = lexical_search.Vocabulary([t for _, t in items])
    assert known.most > 1
    assert known.find(weak(pa.array(texts))).tolist() == expected.tolist()
    assert (expected >= 0).any() and (expected < 0).any()


def test_scores_beyond_double_precision():
    rng = np.random.default_rng(3)
    items = [{0: 10**6, 3: 7}, {5: 1}, {}, {9: 2}]
    row, term = np.repeat(np.arange(4), 3), np.array([0, 3, 5] * 4)
    count, m, weights = rng.integers(1, 99, 12), np.array([80, 90, 100, 5000]), np.array([44000] * 10)
    exact, fast = lexical_search.Scorer(items, weights), lexical_search.Scorer(items, weights)
    assert not exact.exact
    fast.exact = True
    for a, b in zip(exact.scores(row, term, count, m), fast.scores(row, term, count, m)):
        assert a.dtype == np.int64 and np.allclose(a, b)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert nearest.nearest(none).count() == 0 and hard_negatives.mine(none).count() == 0
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([(1, "a b")], items.schema)).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "a b")], docs.schema), items).count() == 0


def test_registered(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{MORE}/embeddings.parquet").collect()]
    assert listed(queries.op13_nearest(spark, MORE)) == brute.nearest([r[:2] for r in rows])
    moved = [(i, v, g if i % 7 else (g + 1) % 10) for i, v, g in rows]
    assert listed(queries.op11_hard_negatives(spark, MORE)) == brute.hard_negatives(moved)


def test_blocks_of_a_grid_meet_once(spark):
    df = spark.range(500).selectExpr("id AS row", "id", "array(1.0D) AS vector", "1 AS dim")

    class Pairs:
        def __init__(self, table):
            self.queries, self.rows = table.num_rows, 0

        def feed(self, batch):
            self.rows += batch.num_rows

        def finish(self):
            return pa.RecordBatch.from_arrays([pa.array([self.queries * self.rows])], ["n"])

    found = grid.meet(df.filter("row < 100"), df, Pairs, "n long", query_block=17, row_block=90).collect()
    assert sum(r.n for r in found) == 100 * 500 and len(found) > 20
