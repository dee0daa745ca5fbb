"""Byte-level BPE: encoding without regular expressions, and decoding.

Code points become classes, classes become transition functions of a small automaton, and prefix compositions of
these functions (composition is associative) give the state before each character, from which the boundaries of the
pieces follow. Pieces go through a cache of merged pieces. With the ids come the offsets at which the tokens begin in the
text's bytes; decoding copies each token's bytes out of the vocabulary's, which stand one after another, to its offset.

Null and empty texts have no tokens. Texts are taken whole; a long one is cut into several runs of the scan only where
a run of the automaton starts anew, and pieces are the same as in one run. Repeated rows are encoded alike. Columns of
the input stay; those that have the name of a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import apart
from plumbline.llm.common import documents, give_back, small_batches

#: Symbols: letter, number, other, apostrophe before s t m d, apostrophe before re ve ll, white space that more white
#: space or the end follows, other white space but a blank, blank before anything else, start of a text.
L, N, O, A1, A2, W, X, J, R = range(9)
#: States: at a start, after a joining blank, in letters, in numbers, in others, in white space, one or two letters to go.
START, BLANK, IN_L, IN_N, IN_O, IN_W, GO1, GO2 = range(8)
#: White space (fixed values: the Unicode property).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters of one scan and columns of its blocks.
AT_ONCE, BLOCK = 1 << 20, 64
#: Pieces that a worker remembers, before it forgets all of them.
CACHE = 200_000
#: Tokens that are decoded at once.
DECODED = 1 << 17


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after the symbol, and whether the symbol begins a piece."""
    if symbol == L:
        if state in (GO1, GO2):
            return (START, GO1)[state == GO2], False
        return IN_L, state not in (BLANK, IN_L)
    if symbol == N:
        return IN_N, state not in (BLANK, IN_N)
    if symbol in (A1, A2) and state not in (BLANK, IN_O):
        return (GO1, GO2)[symbol == A2], True
    if symbol in (O, A1, A2):
        return IN_O, state not in (BLANK, IN_O)
    if symbol == W:
        return IN_W, state != IN_W
    return (BLANK if symbol == J else START), True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, products of functions (first, then), state from START, whether a symbol begins a piece."""
    basic = [tuple(step(s, c)[0] for s in range(8)) for c in range(9)]
    found = {f: None for f in [tuple(range(8)), *basic]}
    queue = list(found)
    while queue:
        f = queue.pop()
        for g in basic:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = None
                queue.append(h)
    number = {f: i for i, f in enumerate(found)}
    product = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8 if len(number) < 256 else np.uint16)
    begins = np.array([[step(s, c)[1] for c in range(9)] for s in range(8)], bool)
    return np.array([number[f] for f in basic], product.dtype), product, np.array([f[START] for f in found], np.uint8), begins


@cache
def classes() -> np.ndarray:
    """Letter, number, white space (W) or other (O) of each code point."""
    table = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = L if kind == "L" else N
    table[WHITE] = W
    return table


def scan(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], functions[i]]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, functions.dtype)  # function 0 changes nothing
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, width = product.ravel(), product.shape[1]
    for i in range(1, BLOCK):
        grid[i] = flat[grid[i - 1].astype(np.intp) * width + grid[i]]
    before = np.zeros(rows, functions.dtype)
    before[1:] = scan(grid[-1], product)[:-1]
    grid = flat[before.astype(np.intp) * width + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts that begin at first (and end where the next begins)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    of_symbol, product, state_of, begins = monoid()
    kinds = classes()[points]
    starts = np.zeros(n + 1, bool)
    starts[first] = True
    starts[n] = True
    after = np.append(kinds[1:], W)
    after[starts[1:]] = W  # a text's end counts as white space that follows
    symbols = kinds.copy()
    last = (kinds == W) & (after != W)
    symbols[last] = X
    symbols[last & (points == 32)] = J
    marks = np.flatnonzero((points == 39) & (after == L))
    if len(marks):
        one = points[marks + 1]
        two = np.where((marks + 2 < n) & ~starts[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
        symbols[marks[np.isin(one, [115, 116, 109, 100])]] = A1
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        symbols[marks[pair]] = A2
    functions = of_symbol[symbols]
    # what comes before a text doesn't matter: its first character begins a piece from START
    heads = np.flatnonzero(starts[:n])
    reset = of_symbol[R]
    functions[heads] = product[reset, functions[heads]]
    states = state_of[scan(functions, product)]
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = states[:-1]
    before[heads] = START
    return np.flatnonzero(begins[before, symbols])


class BytePairs:
    """Encodes texts by a file of ranks and decodes what it encodes."""

    def __init__(self, ranks: str):
        with open(ranks, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pieces = Pieces(self)

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self.merged_long(parts)
        none = len(self.tokens)
        costs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[x] for x in parts]

    def merged_long(self, parts: list[bytes]) -> list[int]:
        """The same by a heap, for pieces of thousands of bytes."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], gone[j] = joined, True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, joined + parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + joined))
        return [ranks[x] for x, g in zip(parts, gone) if not g]

    def encode_batch(self, texts: list[str]):
        """(ids as little-endian unsigned 32-bit integers, offsets) for each text: where each token begins in the text's
        bytes, and where the last one ends."""
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > AT_ONCE:
                yield from self._encode(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        yield from self._encode(held)

    def _encode(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cuts = boundaries(points, (ends - lengths)[lengths > 0])
        edges = [*cuts.tolist(), len(joined)]
        upto = np.searchsorted(cuts, ends).tolist()
        pieces, at = self.pieces, 0
        for to in upto:
            ids = b"".join([pieces[joined[a:b]] for a, b in zip(edges[at:to], edges[at + 1 : to + 1])])
            yield ids, self.offsets(ids)
            at = to

    def offsets(self, ids: bytes) -> np.ndarray:
        found = np.frombuffer(ids, "<u4")
        out = np.zeros(len(found) + 1, np.int64)
        np.cumsum(self.lengths[found], out=out[1:])
        return out

    def decode(self, ids: bytes, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of the tokens, each at its offset; offsets are those of encoding, or found anew."""
        found = np.frombuffer(ids, "<u4")
        offsets = self.offsets(ids) if offsets is None else offsets
        out = np.empty(int(offsets[-1]), np.uint8)
        for i in range(0, len(found), DECODED):
            part, at = found[i : i + DECODED], offsets[i : i + DECODED + 1]
            own = np.repeat(self.starts[part] - at[:-1], self.lengths[part])  # from a place in the text to one in the vocabulary
            out[at[0] : at[-1]] = self.bytes[own + np.arange(at[0], at[-1])]
        return out.tobytes()


class Pieces(dict):
    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = np.array(self.pairs.merged(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


_pairs: dict[str, BytePairs] = {}


def byte_pairs(ranks: str) -> BytePairs:
    if ranks not in _pairs:
        _pairs[ranks] = BytePairs(ranks)
    return _pairs[ranks]


def listed(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Adds the ids (array<int>) of each whole text by the rank file at that path, which every worker can read, and the
    offsets (array<long>): where each token begins in the text's bytes, and where the last one ends."""

    @F.arrow_udf("struct<ids:array<int>,offsets:array<long>>")
    def encoded(texts: pa.Array) -> pa.Array:
        found = list(byte_pairs(ranks).encode_batch([x.as_py() or "" for x in texts]))
        give_back(False)
        columns = [listed([np.frombuffer(x, "<i4") for x, _ in found], pa.int32()), listed([at for _, at in found], pa.int64())]
        return pa.StructArray.from_arrays(columns, ["ids", "offsets"])

    own, (text,), back = apart(df, [text])
    held = own.withColumn("_found", encoded(F.col(text)))
    return back(held, [F.col("_found.ids").alias(ids), F.col("_found.offsets").alias(offsets)])


def decode(df: DataFrame, ranks: str, ids: str = "ids", offsets: str | None = "offsets", out: str = "decoded") -> DataFrame:
    """Adds the bytes (binary) of each array of ids, put where the offsets say; without offsets they are found anew."""

    @F.arrow_udf("binary")
    def decoded(column: pa.Array, places: pa.Array) -> pa.Array:
        p = byte_pairs(ranks)
        both = zip(column, places)
        return pa.array([p.decode(np.array(x.as_py() or [], "<u4").tobytes(), np.array(at.as_py(), np.int64) if at.is_valid else None) for x, at in both], pa.binary())

    at = F.col(offsets) if offsets else F.lit(None).cast("array<long>")
    return df.withColumn(out, decoded(F.col(ids), at))


def round_trip(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256") -> DataFrame:
    """Adds the ids and the SHA-256 of the bytes that they decode to, in one pass over the texts."""

    @F.arrow_udf("struct<ids:array<int>,digest:string>")
    def there_and_back(texts: pa.Array) -> pa.Array:
        p = byte_pairs(ranks)
        give_back(False)
        rows, digests = [], []
        for x, at in p.encode_batch([x.as_py() or "" for x in texts]):
            rows.append(np.frombuffer(x, "<i4"))
            digests.append(hashlib.sha256(p.decode(x, at)).hexdigest())
        return pa.StructArray.from_arrays([listed(rows, pa.int32()), pa.array(digests, pa.string())], ["ids", "digest"])

    own, (text,), back = apart(df, [text])
    held = own.withColumn("_there", there_and_back(F.col(text)))
    return back(held, [F.col("_there.ids").alias(ids), F.col("_there.digest").alias(digest)])


DIGEST = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def digests(df: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and the SHA-256 of the ids and of the decoded bytes, without carrying ids through Spark."""

    @F.arrow_udf(DIGEST)
    def digested(texts: pa.Array) -> pa.Array:
        p = byte_pairs(ranks)
        give_back(False)
        rows = []
        for x, at in p.encode_batch([x.as_py() or "" for x in texts]):
            rows.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(p.decode(x, at)).hexdigest()))
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    own, (text,), back = apart(df, [text])
    held = own.withColumn("_digest", digested(F.col(text)))
    return back(held, [F.col(f"_digest.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = digests(small_batches(documents(spark, sf_dir).select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
