"""Operator 3: BPE encoding and decoding in batched numpy merge rounds.

A text falls apart at white space into chunks whose ids don't depend on their neighbours, so
each task encodes a chunk once, and a word of a chunk once. Chunks and words stay in Arrow arrays,
whose hash tables tell which are new; no string becomes an object of Python. The symbols of all
new words lie in one flat array; a round looks up the rank of every neighbouring pair that has
changed, takes the lowest rank of each word, and merges all its places. Words without a pair leave.

Nulls are encoded as the empty text. Special strings in a text become their ids. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import batches, plain

# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Arrow's utf8_split_whitespace also cuts at these four, which are no white space for the tokenizer.
_SEPARATORS = "[\x1c-\x1f]"
_SPACES = f"[{WHITE_SPACE}]+"
KNOWN_CHUNKS = 300_000  # chunks a worker remembers, some 15 MB; then it starts anew
KNOWN_WORDS = 300_000  # likewise the words of chunks
_LINE_END, _LETTER, _NUMBER, _OTHER = range(4)
_NEWLINE = pa.scalar("\n", pa.large_string())
# With this pattern, kinds of code points and these endings tell where words begin.
_BY_KINDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> np.ndarray:
    """Of each code point, whether it is a line's end, a letter, a number or something else."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32).tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, points):
            kinds[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    kinds[10] = _LINE_END
    return kinds


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file (kind BPE, byte-level, optional suffix at word ends)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE_SPACE))
        self.line_pattern = regex.compile(self.word_pattern.pattern + r"|\n")
        self.by_kinds = split["pattern"]["Regex"] == _BY_KINDS
        self.kinds = _kinds() if self.by_kinds else None
        self.inner = np.array([self.vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([self.vocab[s + self.suffix] for s in byte_symbols()], np.int64)
        self.base = max(self.vocab.values()) + 1
        pairs = np.array([(self.vocab[a], self.vocab[b]) for a, b in model["merges"]], np.int64)
        made = np.array([self.vocab[a + b] for a, b in model["merges"]], np.int64)
        ranks = np.arange(len(pairs))
        # Merging every place of a word's lowest pair at once equals merging one place after
        # another as long as what a merge makes is only used by later merges.
        first_made = np.full(self.base, -1)
        np.maximum.at(first_made, made, ranks)
        self.one_by_one = bool((first_made[pairs].max(axis=1) >= ranks).any())
        keys = pairs[:, 0] * self.base + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], ranks[order], made
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case; each character by itself, so no final sigma."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def words(self, lines: str) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all lines, and how many each line has: what ``word_pattern`` finds in the
        normal form of lines without white space.
        """
        lines = self.normal(lines)
        if not self.by_kinds:
            found = self.line_pattern.findall(lines + "\n")
            ends = np.flatnonzero(np.fromiter((w == "\n" for w in found), bool, len(found)))
            return pa.array([w for w in found if w != "\n"], pa.large_string()), np.diff(np.r_[-1, ends]) - 1
        points = np.frombuffer((lines + "\n").encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        begins = np.ones(len(points), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        line_end = kind == _LINE_END
        begins[1:] |= line_end[:-1]
        # An ending such as 's is a word if the apostrophe begins one.
        quotes = np.flatnonzero(begins & (points == 39))
        for ending in _ENDINGS:
            at = quotes[quotes + len(ending) < len(points)]
            for i, c in enumerate(ending):
                at = at[points[at + 1 + i] == ord(c)]
            begins[at + 1] = False
            begins[at + 1 + len(ending)] = True
        begins &= ~line_end
        bounds = np.flatnonzero(begins)
        before = np.r_[0, np.cumsum(begins)[line_end]]
        # Bounds in the bytes of the lines put together.
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        sizes[line_end] = 0
        places = np.r_[0, np.cumsum(sizes)]
        return _strings(lines.replace("\n", "").encode(), np.r_[places[bounds], places[-1]]), np.diff(before)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word begins in it (one more)."""
        ids, lengths = self.encode_strings(pa.array(words, pa.large_string()))
        return ids, np.r_[0, np.cumsum(lengths)]

    def encode_strings(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, of which none is empty, in one array, and how many each word has."""
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        lengths = np.diff(bounds)
        symbols = self.inner[data]
        symbols[np.cumsum(lengths) - 1] = self.last[data[np.cumsum(lengths) - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.ranks)
        rank = np.full(len(symbols), none)  # of each symbol and the next one of its word
        rank[:-1] = self._ranks(symbols[:-1], symbols[1:], word[:-1] == word[1:])
        done_symbols, done_words = [], []
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, begins)
            size = np.diff(np.r_[begins, len(word)])
            busy = lowest < none
            if not busy.all():
                stay = np.repeat(busy, size)
                done_symbols.append(symbols[~stay])
                done_words.append(word[~stay])
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                size, lowest = size[busy], lowest[busy]
                if not len(symbols):
                    break
            place = np.flatnonzero(rank == np.repeat(lowest, size))
            if self.one_by_one:
                place = place[np.r_[True, word[place[1:]] != word[place[:-1]]]]
            else:
                # Of places that overlap ("aaa"), every other one from the left.
                begin = np.flatnonzero(np.r_[True, np.diff(place) != 1])
                run = np.arange(len(place)) - np.repeat(begin, np.diff(np.r_[begin, len(place)]))
                place = place[run % 2 == 0]
            symbols[place] = self.made[rank[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # Only the pairs next to a merge have changed.
            place -= np.arange(len(place))
            changed = np.zeros(len(symbols), bool)
            changed[place] = True
            changed[place[place > 0] - 1] = True
            near = np.flatnonzero(changed)
            last = near == len(symbols) - 1
            after = near[~last] + 1
            rank[near[last]] = none
            near = near[~last]
            rank[near] = self._ranks(symbols[near], symbols[after], word[near] == word[after])
        if done_words:
            symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        return symbols, np.bincount(word, minlength=len(words))

    def _ranks(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, by binary search; past all ranks if it has none."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & same, self.ranks[at], len(self.ranks))


def _strings(data: bytes, bounds: np.ndarray) -> pa.LargeStringArray:
    """The strings between neighbouring bounds in ``data``."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data))


class Known:
    """Different strings and the ids of each."""

    def __init__(self):
        self.strings = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def find(self, strings: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each of these different strings; ``encode`` gives all ids of the new ones
        in one array, and how many each has.
        """
        at = pc.index_in(strings, value_set=self.strings)
        new = pc.is_null(at)
        numbers = np.asarray(at.fill_null(0)).astype(np.int64)
        strings = strings.filter(new)
        if len(strings):
            numbers[np.asarray(new)] = len(self.strings) + np.arange(len(strings))
            ids, lengths = encode(strings)
            self.strings = pa.concat_arrays([self.strings, strings])
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(lengths) - lengths]
            self.lengths = np.r_[self.lengths, lengths]
            self.ids = np.r_[self.ids, ids.astype(np.uint32)]
        return numbers


class Encoder:
    """Encodes texts; remembers the ids of up to ``KNOWN_CHUNKS`` chunks between batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._chunks, self._words = Known(), Known()

    @property
    def chunks(self) -> pa.Array:
        return self._chunks.strings

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new chunks, each different word of them encoded once."""
        v = self.vocabulary
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), _NEWLINE)[0].as_py()
        if "<|" in lines:
            # Chunks with special strings are cut there; what is left is searched like the rest.
            pieces = [v.special_pattern.split(c) if "<|" in c else (c,) for c in lines.split("\n")]
            pieces_of = np.fromiter(map(len, pieces), np.int64, len(pieces))
            pieces = [p for some in pieces for p in some]
            special = np.fromiter((v.special.get(p, -1) for p in pieces), np.int64, len(pieces))
            lines = "\n".join("" if p in v.special else p for p in pieces)
        else:
            pieces_of, special = None, np.full(len(chunks), -1)
        words, words_of = v.words(lines)
        distinct = words.dictionary_encode()
        number = self._words.find(distinct.dictionary, v.encode_strings)[np.asarray(distinct.indices)]
        # One more entry for a piece's end: a special's id, or nothing.
        ends = np.cumsum(words_of)
        begin = np.insert(self._words.starts[number], ends, len(self._words.ids) + np.arange(len(special)))
        size = np.insert(self._words.lengths[number], ends, special >= 0)
        ids = np.r_[self._words.ids, special][spread(begin, size)]
        entries = words_of + 1 if pieces_of is None else np.add.reduceat(words_of + 1, np.cumsum(pieces_of) - pieces_of)
        return ids, np.add.reduceat(size, np.cumsum(entries) - entries)

    def encode(self, texts: pa.Array | Iterable[str | None]) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each text, with those of special strings in it."""
        if len(self._chunks.strings) > KNOWN_CHUNKS:
            self._chunks = Known()
        if len(self._words.strings) > KNOWN_WORDS:
            self._words = Known()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        odd = pc.any(pc.match_substring_regex(texts, _SEPARATORS)).as_py()
        parts = pc.split_pattern_regex(texts, _SPACES) if odd else pc.utf8_split_whitespace(texts)
        distinct = parts.flatten().dictionary_encode()
        number = self._chunks.find(distinct.dictionary, self._learn)[np.asarray(distinct.indices)]
        size = self._chunks.lengths[number]
        ids = self._chunks.ids[spread(self._chunks.starts[number], size)]
        ends = np.r_[0, np.cumsum(size)][np.cumsum(np.asarray(pc.list_value_length(parts)))]
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), then the same for the others."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - ends + size, size) + np.arange(total)


class Decoder:
    """Ids to the text that the tokenizer's decode gives: token strings joined by spaces."""

    def __init__(self, vocabulary: Vocabulary):
        count = max(vocabulary.tokens) + 1
        tokens = [(" " + vocabulary.tokens.get(i, "")).encode() for i in range(count)]
        self.sizes = np.fromiter(map(len, tokens), np.int64, count)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.starts[ids], self.sizes[ids])].tobytes()[1:]


def encoder(content: str) -> Encoder:
    """The worker's encoder for a tokenizer file, with the chunks it knows already."""
    # Functions sent to workers by value get copies of their globals for each task; `sys` outlives
    # them, if it is asked here and not where the module is read.
    kept = vars(sys).setdefault("_strandwise_tokenizers", {})
    key = ("word", hashlib.sha256(content.encode()).hexdigest())
    if key not in kept:
        kept[key] = Encoder(Vocabulary(content))
    return kept[key]


def read_file(path: str) -> str:
    """A tokenizer file, read on the driver; tasks get its content (a few MB, by its size)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text."""
    return _mapped(docs, tokenizer, key, text, "ids array<int>", lambda ids, _: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))])


def decode(tokens: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every id sequence; null ids decode to the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(items):
        decoder = Decoder(encoder(shared.value).vocabulary)
        for batch in items:
            texts = [decoder.decode(np.asarray(x, np.int64)).decode() if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    plain_ids = tokens.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return plain_ids.mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both."""

    def columns(ids, decoder):
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids], pa.string()),
        ]

    return _mapped(docs, tokenizer, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _mapped(docs, tokenizer, key, text, schema, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))
    names = ["key", *(c.split()[0] for c in schema.split(", "))]

    def run(items):
        known = encoder(shared.value)
        decoder = Decoder(known.vocabulary)
        for batch in batches(items, "text", 2 << 20):
            ids = known.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(ids, decoder)], names)

    rows = plain(docs, **{key: "long", text: "string"}).toDF("key", "text")
    return rows.mapInArrow(run, f"key long, {schema}").withColumnRenamed("key", key)
