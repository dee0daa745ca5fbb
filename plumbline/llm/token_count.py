"""Token counts by byte-pair merging over a heap and a linked list.

Null and empty texts count 0 tokens. Texts are taken whole. Repeated rows are counted alike. Columns of the
input stay; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, small_batches

#: Pieces between white space, as the vocabulary file splits them (fixed value of its format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries that a worker remembers of each kind, before it forgets all of them.
CACHE = 400_000
#: Characters of an entry, at most; longer ones are counted each time.
LONGEST = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class PairMerger:
    """Counts the symbols that are left when no pair of neighbours has a rank any more."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            held = json.load(f)
        model, ids = held["model"], held["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        signs = byte_symbols()
        self.inner, self.last = [ids[s] for s in signs], [ids[s + end] for s in signs]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
        self.specials = [t["content"] for t in held["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pieces = regex.compile(PIECES)
        self.whole = PieceCounts(self)
        self.chunks = ChunkCounts(self)

    def symbols(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        n = left = len(ids)
        if n < 2:
            return n
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := ranks.get(ids[i] << 32 | ids[i + 1]):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or (now := ranks.get(ids[i] << 32 | ids[j])) is None or now[0] != rank:
                continue  # one of the pair has been merged meanwhile
            ids[i], ids[j] = merged, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get(merged << 32 | ids[k]):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get(ids[h] << 32 | merged)):
                heapq.heappush(heap, (found[0], h, found[1]))
        return left

    def count(self, text: str) -> int:
        return sum(map(self.chunks.__getitem__, chunks(text)))


class Remembered(dict):
    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger = merger

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[key] = n
        return n


class PieceCounts(Remembered):
    def count(self, key: str) -> int:
        return self.merger.symbols(key)


class ChunkCounts(Remembered):
    """Of what stands between white space. No piece, special string or composition reaches across white space."""

    def count(self, key: str) -> int:
        m = self.merger
        if m.special is None or "<|" not in key:
            return self.plain(key)
        return sum(1 if part in m.specials else self.plain(part) for part in regex.split(f"({m.special.pattern})", key) if part)

    def plain(self, key: str) -> int:
        if not key.isascii():
            key = unicodedata.normalize("NFC", key).replace("Σ", "σ")  # each character by itself: no final sigma
        pieces = self.merger.whole
        return sum(pieces[x] for x in self.merger.pieces.findall(key.lower()))


#: White space as the Unicode property has it; str.split() also splits at U+001C to U+001F.
WHITE = regex.compile(r"[^\s]+")
ODD = regex.compile(r"[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    return WHITE.findall(text) if ODD.search(text) else text.split()


_mergers: dict[str, PairMerger] = {}


def merger(vocabulary: str) -> PairMerger:
    if vocabulary not in _mergers:
        _mergers[vocabulary] = PairMerger(vocabulary)
    return _mergers[vocabulary]


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of each whole text (null: empty) by the vocabulary file at that path, which every worker can read."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        m = merger(vocabulary)
        return pa.array([m.count(x.as_py() or "") for x in texts], pa.int64())

    return counted(text)


def with_token_counts(df: DataFrame, vocabulary: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    return df.withColumn(count, token_count(F.col(text), vocabulary))


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    docs = with_token_counts(small_batches(documents(spark, sf_dir).select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
