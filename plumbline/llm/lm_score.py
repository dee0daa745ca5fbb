"""Language-model scores from a log-frequency Bloom filter.

Tasks gather the hashed words and word pairs of the training texts as sorted blocks, one for each range of hashes, so
that frequent ones are summed before the shuffle and no range grows with a frequent word. For each range the summed
counts are quantised to powers of two and a filter is filled: an n-gram of level q is entered with each of the levels 1
to q. A level is read by probing 1, 2, ... until a probe misses. The ranges' filters together are broadcast; where they
are larger than a bound, they stay where they are and are asked: blocks of texts send the hashes that they need to the
ranges and get the levels back. Both ways read the same bits, and scores don't depend on the bound. The score
of a word after another is interpolated from the pair's and the word's quantised counts; the weight of pairs is the share
of the training tokens, of those after a word found more than once, whose pair is found again (the Good-Turing estimate
of seen mass), and after other words there is none.

The table of frequent words is broadcast and has a size that a parameter bounds. Exact counts of the words outside the
table come by a join, so the base score is exact at every size. Counts are held by 64-bit hashes of the words.

Null and empty texts have one token, the end. Texts are taken whole. Repeated rows each count in training and score
alike. Without training rows all counts are 0. An empty table gives an empty result. Columns of the input stay,
but for those that have the name of a result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import OTHERS, apart
from plumbline.llm.common import documents, give_back, mix64, shuffle_partitions, small_batches, stored, text_slices
from plumbline.llm.toxicity import remainder

END = np.uint64(0x5EED0E4D)
LEVELS = 40
WORDS, PAIRS = 0, 1


@dataclass(frozen=True)
class ModelSize:
    filter_bytes: int = 64 << 20  # of a filter that is broadcast, at most
    table_words: int = 1_500_000  # of the table of frequent words, at most
    table_count: int = 8  # of a word of the table, at least
    bits: int = 8  # of the filter, for each entry
    probes: int = 4
    least_pair: int = 2  # a pair found once says nothing about the next text
    block: int = 1_000_000  # tokens of a block
    asked: int = 128 << 20  # bytes of hashes that a task looks up, about


class WordIds(dict):
    """Numbers words of bytes; hashes of new ones are taken when asked for."""

    def __init__(self, at_most: int = 150_000):
        super().__init__()
        self.at_most, self.new = at_most, []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def tokens_of(texts: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of the texts, and how many each text has. bytes know the ASCII letters and spaces only."""
    found = [t.lower().split() for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    flat = np.fromiter((i for x in found for i in map(ids.__getitem__, x)), np.int64, int(counts.sum()))
    return flat, counts


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes with an end after each text, of what stands before each, and where each text begins."""
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(int(counts.sum()) + len(counts), np.uint64)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = hashes, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[:1] = END
    return out, before, ends - counts


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(before * np.uint64(0x9E3779B97F4A7C15) + after)


def summed(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    n = np.diff(np.append(first, len(hashes))) if counts is None else np.add.reduceat(counts, first)
    return hashes[first], n.astype(np.int64)


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Those found once without a count."""
    more = counts > 1
    return np.uint64(more.sum()).tobytes() + hashes[more].tobytes() + counts[more].tobytes() + hashes[~more].tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint64, 1)[0])
    more, counts = np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n)
    once = np.frombuffer(blob, np.uint64, offset=8 + 16 * n)
    return np.concatenate([more, once]), np.concatenate([counts, np.ones(len(once), np.int64)])


def gathered(texts: DataFrame, ranges_log2: int, size: ModelSize) -> DataFrame:
    """Blocks (range, kind, packed) of the words and pairs of a table with one binary column."""

    def blocks(batches):
        ids, known = WordIds(), np.zeros(0, np.uint64)
        words, pairs, n = [], [], 0

        def flush():
            rows = []
            for kind, parts in ((WORDS, words), (PAIRS, pairs)):
                h, c = summed(np.concatenate(parts))
                cuts = np.searchsorted(h, np.arange(1, 1 << ranges_log2, dtype=np.uint64) << np.uint64(64 - ranges_log2))
                for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)])):
                    if b > a:
                        rows.append((i, kind, packed(h[a:b], c[a:b])))
            words.clear()
            pairs.clear()
            for i in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 16]), (pa.int32(), pa.int32(), pa.binary()))], ["range", "kind", "grams"])

        for batch in batches:
            for _, texts in text_slices(batch.column(0), 1 << 21):
                flat, counts = tokens_of(texts, ids)
                known = np.concatenate([known, hashes_of(ids.new)])
                ids.new.clear()
                h, before, _ = with_ends(known[flat], counts)
                if len(ids) > ids.at_most:
                    ids.clear()
                    known = known[:0]
                words.append(h)
                pairs.append(pair_hash(before, h))
                n += len(h)
                if n >= size.block:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()
        give_back()

    return texts.mapInArrow(blocks, "range int, kind int, grams binary")


def level(counts: np.ndarray) -> np.ndarray:
    """1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS - 1).astype(np.uint8)


def ranges(blocks: DataFrame, size: ModelSize) -> DataFrame:
    """One row for each range: words with counts, pairs with levels (from least_pair up), and how many have which level."""
    least = int(size.least_pair)

    def merge(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"range": [table["range"][0].as_py()]}
        for kind, name in ((WORDS, "word"), (PAIRS, "pair")):
            parts = [unpacked(g) for g, k in zip(table["grams"].to_pylist(), table["kind"].to_pylist()) if k == kind]
            h, c = summed(*map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if kind == WORDS:
                out |= {"tokens": [int(c.sum())], "ends": [int(c[h == END].sum())], "word_counts": [c.tobytes()]}
            else:
                h, c = h[c >= least], c[c >= least]
                out |= {"pair_tokens": [int(c.sum())], "pair_levels": [level(c).tobytes()]}
            out |= {f"{name}s": [h.tobytes()], f"{name}_hist": [np.bincount(level(c), minlength=LEVELS).tolist()]}
        return pa.table({f: out[f] for f in FIELDS}).cast(SCHEMA)

    return blocks.groupBy("range").applyInArrow(merge, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


FIELDS = {
    "range": "int", "tokens": "long", "ends": "long", "pair_tokens": "long", "words": "binary", "word_counts": "binary", "pairs": "binary", "pair_levels": "binary",
    "word_hist": "array<long>", "pair_hist": "array<long>",
}
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(k, ARROW[v]) for k, v in FIELDS.items()])


class Filter:
    """Filters of all ranges in one array of bits."""

    def __init__(self, ranges_log2: int, bits: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, probes: int):
        self.shift, self.bits, self.offsets, self.sizes, self.probes = np.uint64(64 - ranges_log2), bits, offsets, sizes, probes

    @staticmethod
    def places(hashes: np.ndarray, lev: int | np.ndarray, probe: int, sizes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = mix64(hashes + np.asarray(lev).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(probe) * np.uint64(0xD6E8FEB86659FD93))
            return ((key >> np.uint64(32)) * sizes) >> np.uint64(32)

    def has(self, hashes: np.ndarray, lev: int) -> np.ndarray:
        alive = np.arange(len(hashes))
        where = (hashes >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(hashes), np.int64)
        for k in range(self.probes):
            h, w = hashes[alive], where[alive]
            at = self.offsets[w] + self.places(h, lev, k, self.sizes[w])
            hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            alive = alive[hit.astype(bool)]
        out = np.zeros(len(hashes), bool)
        out[alive] = True
        return out

    def level(self, hashes: np.ndarray, first: int = 1) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        for lev in range(first, LEVELS):
            alive = alive[self.has(hashes[alive], lev)]
            if not len(alive):
                break
            out[alive] = lev
        return out


def count_of(lev: np.ndarray) -> np.ndarray:
    """About the geometric middle of a level's counts, exact for 1; 0 for none."""
    return np.where(lev > 1, np.exp2(lev - 0.5), np.where(lev > 0, 1.0, 0.0))


def first_level(hist: np.ndarray, room: float, least: int, entries=lambda q, first: q - first + 1) -> int:
    """The lowest level from which all n-grams fit."""
    for first in range(least, LEVELS):
        if sum(int(n) * entries(q, first) for q, n in enumerate(hist) if q >= first) <= room:
            return first
    return LEVELS


@dataclass
class Model:
    tokens: int
    distinct: int
    filter: Filter
    pair_from: int
    table: np.ndarray  # hashes of frequent words, sorted
    table_counts: np.ndarray
    table_from: int  # level
    weight: float  # of pairs
    ranges_log2: int
    filters: DataFrame | None = None  # (range, bits), where they are not broadcast

    def __getstate__(self):
        return self.__dict__ | {"filters": None}

    def word_facts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, exact count (-1: not in the table) and filter level of each."""
        h = hashes_of(words)
        return h, *self.facts(h)

    def facts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.full(len(h), -1, np.int64)
        if len(self.table):
            at = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
            c = np.where(self.table[at] == h, self.table_counts[at], -1)
        return c, self.filter.level(h)


def trained(spark: SparkSession, texts: DataFrame, size: ModelSize = ModelSize()) -> tuple[Model, DataFrame]:
    """The model of a table with one binary column of training texts, and the stored ranges of its counts."""
    log2 = max(1, (shuffle_partitions(spark) - 1).bit_length())
    held = stored(ranges(gathered(texts, log2, size).repartition(1 << log2, "range"), size), "lm-counts")
    sums = held.select("tokens", "pair_tokens", "word_hist", "pair_hist").toArrow()  # a row for each range
    hist = {k: np.array(sums[f"{k}_hist"].to_pylist(), np.int64).reshape(-1, LEVELS).sum(0) for k in ("word", "pair")}
    pair_from = int(level(np.array([size.least_pair]))[0])
    entries = sum(int(n) * q for q, n in enumerate(hist["word"])) + sum(int(n) * (q - pair_from + 1) for q, n in enumerate(hist["pair"]) if q >= pair_from)
    fits = entries * size.bits <= size.filter_bytes * 8
    least = int(level(np.array([size.table_count]))[0])
    table_from = first_level(hist["word"], size.table_words, least, lambda q, first: 1)
    bits, probes = size.bits, size.probes

    def fill(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, c = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["word_counts"], np.int64)
                p, q = np.frombuffer(row["pairs"], np.uint64), np.frombuffer(row["pair_levels"], np.uint8)
                lev = level(c)
                often = lev >= table_from
                keys = [(h[lev >= j], j) for j in range(1, LEVELS)]
                keys += [(p[q >= j], j) for j in range(pair_from, LEVELS)]
                n = max(64, sum(len(x) for x, _ in keys) * bits + 7 & ~7)
                marks = np.zeros(n, bool)
                for x, j in keys:
                    for k in range(probes):
                        marks[Filter.places(x, j, k, np.uint64(n)).astype(np.int64)] = True
                yield pa.RecordBatch.from_pydict(
                    {"range": pa.array([row["range"]], pa.int32()), "bits": [np.packbits(marks, bitorder="little").tobytes()], "words": [h[often].tobytes()], "counts": [c[often].tobytes()]}
                )

    filled = held.mapInArrow(fill, "range int, bits binary, words binary, counts binary")
    filters = None
    if not fits:
        filled = stored(filled, "lm-filters")
        filters = filled.select("range", "bits")
        filled = filled.withColumn("bits", F.lit(b""))
    filled = filled.toArrow().sort_by("range")  # bounded, see above
    sizes, offsets, at = np.ones(1 << log2, np.uint64), np.zeros(1 << log2, np.uint64), 8
    for r, b in zip(filled["range"].to_pylist(), filled["bits"] if fits else []):
        sizes[r], offsets[r] = len(b.as_py()) * 8, at
        at += len(b.as_py()) * 8
    joined = np.frombuffer(b"\0" + b"".join(b.as_py() for b in filled["bits"]), np.uint8)
    table = np.frombuffer(b"".join(b.as_py() for b in filled["words"]), np.uint64)
    counts = np.frombuffer(b"".join(b.as_py() for b in filled["counts"]), np.int64)
    tokens = sum(sums["tokens"].to_pylist())
    after_known = tokens - int(hist["word"][1])  # tokens after a word that isn't found once only
    weight = min(0.95, sum(sums["pair_tokens"].to_pylist()) / (after_known + 2.0))
    return Model(tokens, int(hist["word"].sum()), Filter(log2, joined, offsets, sizes, probes), pair_from, table, counts, table_from, weight, log2, filters), held


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.ids = WordIds()
        self.clear()

    def clear(self):
        self.ids.clear()
        self.hash, self.count, self.level = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        c, lev = self.m.facts(np.array([END]))
        self.end_count, self.end_level = int(c[0]), int(lev[0])

    def read(self, texts: list[bytes]):
        """For all tokens: hash, exact count or -1, level, level of the token before, level of the pair; texts' beginnings."""
        if len(self.ids) > self.ids.at_most:
            self.clear()
        flat, counts = tokens_of(texts, self.ids)
        new = self.m.word_facts(self.ids.new)
        self.ids.new.clear()
        self.hash, self.count, self.level = (np.concatenate(x) for x in zip((self.hash, self.count, self.level), new))
        h, before, first = with_ends(self.hash[flat], counts)
        own = np.ones(len(h), bool)
        own[first + counts] = False
        c, lev = np.full(len(h), self.end_count), np.full(len(h), self.end_level)
        c[own], lev[own] = self.count[flat], self.level[flat]
        lev_before = np.append(self.end_level, lev[:-1])
        pair = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.maybe(lev, lev_before))
        pair[maybe] = self.m.filter.level(pair_hash(before[maybe], h[maybe]), self.m.pair_from)
        return h, c, lev, lev_before, np.minimum(pair, np.minimum(lev, lev_before)), first

    def maybe(self, lev, lev_before) -> np.ndarray:
        """Which pairs can be in the filter: a pair isn't more frequent than its words."""
        return (lev >= self.m.pair_from) & (lev_before >= self.m.pair_from)

    def logs(self, lev, lev_before, pair) -> np.ndarray:
        m = self.m
        single = (count_of(lev) + 1) / (m.tokens + m.distinct + 1)
        w = np.where(lev_before >= m.pair_from, m.weight, 0.0)
        both = np.divide(count_of(pair), count_of(lev_before), out=np.zeros(len(pair)), where=lev_before > 0)
        return np.log10(w * np.minimum(both, 1.0) + (1 - w) * single)


_scorer: list = []


def scorer(sent) -> Scorer:
    if not _scorer or _scorer[0] is not sent.value:
        _scorer[:] = [sent.value, Scorer(sent.value)]
    return _scorer[1]


def needed(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the tokens of texts: sorted distinct hashes, places in them of each token and of that before it, sorted distinct
    pairs, the place of each token's pair, and how many tokens each text has."""
    parts = []
    for _, rows in text_slices(texts, 1 << 20):
        ids = WordIds()
        flat, counts = tokens_of(rows, ids)
        h, before, first = with_ends(hashes_of(ids.new)[flat], counts)
        parts.append((h, before, counts + 1))
    h, before, counts = (np.concatenate(x) for x in zip(*parts))
    words, at = np.unique(h, return_inverse=True)
    pairs, pair_at = np.unique(pair_hash(before, h), return_inverse=True)
    return words, at, np.searchsorted(words, before), pairs, pair_at, counts


def by_ranges(model: Model, rows: DataFrame, size: ModelSize) -> DataFrame:
    """(_scored, score) of stored rows (_block, _row, _t), those of a block together and in order, by filters that stay in their ranges."""
    spark, log2 = rows.sparkSession, model.ranges_log2
    sent = spark.sparkContext.broadcast(model)
    shares = 1 + 16 * model.tokens // (size.asked << log2)  # tasks of a range

    def ask(batches):
        block, first, texts = None, 0, []

        def flush():
            words, _, _, pairs, _, _ = needed(pa.concat_arrays(texts))
            edges = np.arange(1, 1 << log2, dtype=np.uint64) << np.uint64(64 - log2)
            cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (words, pairs)]
            out = [(r, block, first, words[a:b].tobytes(), pairs[c:d].tobytes()) for r, (a, b, c, d) in enumerate(zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])) if b > a or d > c]
            texts.clear()
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["range", "_block", "_first", "words", "pairs"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])[: len(blocks)]).tolist()
            for a, b in zip(starts, [*starts[1:], len(blocks)]):
                if texts and blocks[a] != block:
                    yield flush()
                if not texts:
                    block, first = int(blocks[a]), batch.column(1)[a].as_py()
                texts.append(batch.column(2).slice(a, b - a))
        if texts:
            yield flush()
        give_back()

    def answer(filters: pa.Table, asked: pa.Table) -> pa.Table:
        m = sent.value
        bits = np.frombuffer(filters["bits"][0].as_py(), np.uint8) if len(filters) else np.zeros(1, np.uint8)
        one = Filter(0, bits, np.zeros(1, np.uint64), np.array([len(bits) * 8 if len(filters) else 1], np.uint64), m.filter.probes)
        levels = {k: [one.level(np.frombuffer(x.as_py(), np.uint64), f).astype(np.uint8).tobytes() for x in asked[k]] for k, f in (("words", 1), ("pairs", m.pair_from))}
        return pa.table({k: pa.array(levels[k], pa.binary()) if k in levels else asked[k] for k in ("range", "_block", "_first", "words", "pairs")})

    asked = rows.select("_block", "_row", "_t").mapInArrow(ask, "range int, _block long, _first long, words binary, pairs binary")
    asked = asked.withColumn("_share", F.pmod("_block", F.lit(shares)))
    filters = model.filters.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    answers = filters.groupBy("range", "_share").cogroup(asked.groupBy("range", "_share")).applyInArrow(answer, "range int, _block long, _first long, words binary, pairs binary")

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        s = scorer(sent)
        texts, answers = texts.sort_by("_row").combine_chunks(), answers.sort_by([("_first", "ascending"), ("range", "ascending")])
        row, firsts, scores = texts["_row"].to_numpy(), answers["_first"].to_numpy(), []
        parts = np.unique(firsts)
        cuts = np.searchsorted(row, parts).tolist()
        for part, a, b in zip(parts, cuts, [*cuts[1:], len(row)]):
            _, at, before_at, _, pair_at, counts = needed(pa.concat_arrays(texts["_t"].slice(a, b - a).chunks))
            own = answers.filter(pa.array(firsts == part))
            words, pairs = (np.frombuffer(b"".join(x.as_py() for x in own[k]), np.uint8).astype(np.int64) for k in ("words", "pairs"))
            lev, before = words[at], words[before_at]
            pair = np.where(s.maybe(lev, before), np.minimum(pairs[pair_at], np.minimum(lev, before)), 0)
            scores.append(np.bincount(np.repeat(np.arange(b - a), counts), s.logs(lev, before, pair), b - a))
        return pa.table({"_scored": texts["_row"], "score": np.concatenate(scores)})

    return rows.select("_block", "_row", "_t").groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(score, "_scored long, score double")


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
SCORED = "n_tokens long, n_words_known long, log_known double, score double, block long, rest array<long>"


def lm_scores(docs: DataFrame, train: Column, text: str = "text", size: ModelSize = ModelSize()) -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score; learnt from rows where train holds."""
    own, names, back = apart(small_batches(docs), [text], _learn=train)
    return back(_lm_scores(own, names[0], size), RESULTS, [text])


def _lm_scores(docs: DataFrame, text: str, size: ModelSize) -> DataFrame:
    """docs: the text, OTHERS and _learn."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t")
    model, held = trained(spark, docs.where("_learn").select(raw), size)
    sent = spark.sparkContext.broadcast(model)
    kept = [OTHERS]

    @F.arrow_udf(f"struct<{SCORED.replace(' ', ':').replace(',:', ',')}>")
    def score(texts: pa.Array) -> pa.Array:
        s, parts = scorer(sent), []
        block = uuid.uuid4().int >> 66  # rows that are sent together
        for _, rows in text_slices(texts, 1 << 20):
            h, c, lev, before, pair, first = s.read(rows)
            n = np.diff(np.append(first, len(h)))
            of = np.repeat(np.arange(len(rows)), n)
            known = c > 0
            rest = c < 0
            rests = np.append(0, np.cumsum(np.bincount(of[rest], minlength=len(rows))))
            parts.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array(n),
                        pa.array(np.bincount(of[known], minlength=len(rows))),
                        pa.array(np.bincount(of, np.where(known, np.log10(np.maximum(c, 0) + 1.0), 0.0), len(rows))),
                        pa.array(np.bincount(of, s.logs(lev, before, pair), len(rows))),
                        pa.array(np.full(len(rows), block)),
                        pa.ListArray.from_arrays(pa.array(rests, pa.int32()), pa.array(h[rest].view(np.int64))),
                    ],
                    ["n_tokens", "n_words_known", "log_known", "score", "block", "rest"],
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([]))

    out = docs.select(*kept, score(raw).alias("_s"), F.monotonically_increasing_id().alias("_row"), *([] if model.filters is None else [raw]))
    whole = model.filters is None
    out = rows = stored(out.select(*kept, "_row", "_s.*", *([] if whole else ["_t"])), "lm-scores")
    table_from = model.table_from

    def rare(batches):
        for batch in batches:
            for w, c in zip(batch["words"].to_pylist(), batch["word_counts"].to_pylist()):
                h, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                few = level(c) < table_from
                yield pa.RecordBatch.from_pydict({"_h": h[few].view(np.int64), "_c": c[few]})

    tail = held.select("words", "word_counts").mapInArrow(rare, "_h long, _c long")
    rest = out.select("_row", F.explode("rest").alias("_g")).join(tail, F.col("_g") == F.col("_h"))
    rest = rest.groupBy(F.col("_row").alias("_r")).agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("_c") + 1.0)).alias("_log"))
    out = out.join(rest, F.col("_row") == F.col("_r"), "left")
    if not whole:
        scores = by_ranges(model, rows.select(F.col("block").alias("_block"), "_row", "_t"), size)
        out = out.drop("score").join(scores, F.col("_row") == F.col("_scored"))
    total, distinct = model.tokens, model.distinct
    base = F.col("log_known") + F.coalesce("_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select(
        *kept,
        "n_tokens",
        (F.col("n_words_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(documents(spark, sf_dir).select("doc_id", "text"), remainder("doc_id", 7) != 2)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
