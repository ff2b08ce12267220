"""Operator 8: language identification with a bit-sliced Bloom filter of byte n-grams.

All languages share one filter: cell ``i`` holds a bitmask with a bit per language, so the AND
of the cells that an n-gram hashes to is the set of languages that contain it. A text's score
for a language is its popcount over the n-grams, corrected for the false positives that the
fill of that language's bits makes us expect; the highest decides.

Learning uses at most about ``per_language`` labelled documents of each language, chosen by a
hash of the key (a documented bound; smaller corpora are used whole). An n-gram counts as
contained in a language if it is there at least ``least`` times and at least ``part`` as
frequent as in the language where it is most frequent; the ``grams`` most frequent ones of a
language enter the filter, whose size is fixed. Prediction reads whole texts.

Texts that are null or have no letter are ``und`` with score 0. Texts without a known n-gram,
and ties, get the first language in alphabetical order (score 0, or 0.5 for two). Without
labelled rows everything is ``und``. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import batches, drop_stored, mix, plain, store

SIZES = (3, 5)  # bytes of an n-gram
_PIECE = 256 << 10  # bytes of text at once: an n-gram takes 8 bytes in each of some ten arrays
_CELLS = 1 << 21
_HASHES = 3
# Capital letters count as small ones, digits as one digit, white space as one blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def held_out(key: Column) -> Column:
    """Every fourth document by hash is never learned from; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each between two blanks, and the bounds of each."""
    blank = pa.scalar(" ", pa.large_string())
    joined = pc.binary_join_element_wise(blank, column.cast(pa.large_string()).fill_null(""), blank, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return _FOLD[data], offsets - offsets[0]


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on as one number, with their count on top."""
    out = np.full(max(len(data) - n + 1, 0), n, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : len(data) - n + 1 + i]
    return out


def _of_text(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Sum per text of a value per n-gram, without those that reach into the next text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.maximum(bounds[1:] - n + 1, bounds[:-1])
    last = len(sums) - 1
    return sums[np.minimum(ends, last)] - sums[np.minimum(bounds[:-1], last)]


class Filter:
    """Languages of n-grams: ``add`` sets bits, ``scores`` counts and corrects them."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.cells = [np.zeros(_CELLS, self._kind(at)) for at in range(0, len(languages), 64)]

    def parts(self) -> tuple:
        """Plain lists and arrays, which workers can read without this package."""
        return self.languages, self.cells, self.false_positive

    @classmethod
    def of(cls, languages: list[str], cells: list[np.ndarray], false_positive: np.ndarray) -> Filter:
        known = cls.__new__(cls)
        known.languages, known.cells, known.false_positive = languages, cells, false_positive
        return known

    def _kind(self, at: int):
        left = len(self.languages) - at
        return np.uint8 if left <= 8 else np.uint16 if left <= 16 else np.uint32 if left <= 32 else np.uint64

    @staticmethod
    def _at(grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams)
        step = np.uint64(_CELLS.bit_length() - 1)
        return [((h >> (step * np.uint64(i))) & np.uint64(_CELLS - 1)).astype(np.int64) for i in range(_HASHES)]

    def add(self, language: int, grams: np.ndarray) -> None:
        cells = self.cells[language // 64]
        for at in self._at(grams):
            cells[at] |= cells.dtype.type(1 << language % 64)

    def seal(self) -> None:
        """Find the chance of a false positive for each language from the share of set bits."""
        fill = [
            np.count_nonzero(self.cells[i // 64] & self.cells[i // 64].dtype.type(1 << i % 64)) / _CELLS
            for i in range(len(self.languages))
        ]
        self.false_positive = np.array(fill) ** _HASHES

    def scores(self, column: pa.Array) -> np.ndarray:
        """Corrected hits, a row per text and a column per language."""
        data, bounds = _texts(column)
        hits = np.zeros((len(column), len(self.languages)))
        total = np.zeros(len(column))
        for n in SIZES:
            at = self._at(_grams(data, n))
            total += np.maximum(np.diff(bounds) - n + 1, 0)
            for block, cells in enumerate(self.cells):
                masks = cells[at[0]]
                for a in at[1:]:
                    masks &= cells[a]
                for i in range(block * 64, min(block * 64 + 64, len(self.languages))):
                    bit = (masks & cells.dtype.type(1 << i % 64)) != 0
                    hits[:, i] += _of_text(bit, bounds, n)
        expected = total[:, None] * self.false_positive
        return np.maximum((hits - expected) / (1 - self.false_positive), 0)


def learn(
    docs: DataFrame, per_language: int = 1500, grams: int = 60_000, least: int = 3, part: float = 0.3,
    key: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Filter:
    """The filter from documents that are labelled and not held out."""
    rows = plain(docs, **{key: "long", text: "string", lang: "string"}).toDF("key", "text", "lang")
    labelled = rows.filter(~held_out(F.col("key")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    known = Filter(languages)
    if not languages:
        known.seal()
        return known
    number = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*(F.lit(v) for x in languages for v in (x, per_language / counts[x])))
    draw = F.pmod(F.xxhash64("key", F.lit("learn")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = labelled.filter(draw < share[F.col("lang")]).select("lang", "text")

    def count(items):
        for batch in batches(items, "text", _PIECE):
            data, bounds = _texts(batch.column(1))
            label = np.array([number[x] for x in batch.column(0).to_pylist()])
            for n in SIZES:
                found = _grams(data, n)
                inside = np.ones(len(found), bool)
                for end in bounds[1:]:
                    inside[max(end - n + 1, 0) : end] = False
                owner = np.repeat(label, np.diff(bounds))[: len(found)]
                for i in np.unique(label):
                    values, times = np.unique(found[inside & (owner == i)], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), i), pa.int32()), pa.array(values.astype(np.int64)), pa.array(times)],
                        ["lang", "gram", "n"],
                    )

    summed = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    summed = store(summed, "grams")  # read again for the totals, the rates and the best of them
    totals = {r["lang"]: r["t"] for r in summed.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    rate = F.col("n") / F.create_map(*(F.lit(v) for i, t in totals.items() for v in (i, float(t))))[F.col("lang")]
    rated = summed.select("lang", "gram", "n", rate.alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    contained = rated.join(best, "gram").filter((F.col("n") >= least) & (F.col("rate") >= part * F.col("best")))
    contained = store(contained.select("lang", "gram", "n"), "contained")
    for i in range(len(languages)):
        # At most `grams` numbers of each language reach the driver.
        top = contained.filter(F.col("lang") == i).orderBy(F.desc("n"), "gram").limit(grams).select("gram").toArrow()
        known.add(i, top.column("gram").to_numpy().astype(np.uint64))
    known.seal()
    drop_stored(summed)
    drop_stored(contained)
    return known


def predict(docs: DataFrame, known: Filter, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with ``lang_pred`` and ``score``.

    The score is the winner's part of its own and the runner-up's corrected hits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known.parts())
    names = docs.columns if keep is None else keep
    kinds = dict(docs.dtypes)
    letters = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    fields = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    # A kept text goes to the workers once.
    sent = text in names and kinds[text] == "string"
    place = names.index(text) if sent else len(names) + 1

    def run(items):
        known = Filter.of(*shared.value)
        for batch in batches(items, text if sent else "_text", _PIECE):
            column = batch.column(place)
            lettered = np.asarray(batch.column(len(names)))
            scores = known.scores(column)
            if scores.shape[1]:
                best = scores.argmax(axis=1)
                top = np.sort(scores, axis=1)
                first = top[:, -1]
                second = top[:, -2] if scores.shape[1] > 1 else np.zeros(len(top))
                score = np.divide(first, first + second, out=np.zeros(len(top)), where=first > 0)
                pred = [known.languages[i] if ok else "und" for i, ok in zip(best, lettered)]
            else:
                pred, score = ["und"] * len(scores), np.zeros(len(scores))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))],
                [*names, "lang_pred", "score"],
            )

    columns = [*(F.col(f"`{n}`") for n in names), letters.alias("_letters")]
    rows = docs.select(*columns, *([] if sent else [F.col(f"`{text}`").cast("string").alias("_text")]))
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every document."""
    known = learn(docs, key=key, text=text, lang=lang)
    rows = plain(docs, **{key: "long", text: "string"})
    scored = predict(rows.toDF("key", "text"), known, keep=["key"])
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
