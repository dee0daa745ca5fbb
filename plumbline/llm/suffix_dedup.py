"""Removing repeated passages by a distributed sort of sparse suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Every such string holds an anchor:
of its k-grams, those of the least hash. Its other occurrences have the same anchor at the same place, so it is enough
to look at suffixes that begin at anchors. A first scan gathers the anchors' hashes and marks those found twice in a
bitmap of fixed size. A second scan cuts the suffixes at marked anchors (length bytes, and what stands before them),
sorts them into runs, and sends the runs, front-coded, to ranges of the sort order. There a loser tree merges them: each
head knows the length of its common prefix with the last suffix put out, so known prefixes are never compared again. In
the merged order, neighbours that share k bytes make a cluster; each suffix's longest matches to both sides follow from
its cluster, compared byte by byte, and add up to spans.

The bitmap only spares work: a bit that is set for another hash lets a suffix take part that has no partner.

Null and empty texts, and those shorter than the length, lose nothing. Texts are taken whole, and matches never reach
over a text's end. Repeated rows are each other's repeats. An empty table gives an empty result. Columns of the input
stay. Rows are told apart by 64-bit hashes of id and text.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import apart
from plumbline.llm.common import documents, give_back, mix64, settle, shuffle_partitions, small_batches, stored, text_slices


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    gram: int = 64  # a power of two
    bitmap_log2: int = 28  # bits that mark hashes found twice
    run: int = 40_000  # suffixes of a run
    splitter_bytes: int = 24
    samples: int = 40  # texts for each splitter
    pairwise: int = 4096  # comparisons up to which a cluster is compared pair by pair
    copies: int = 4_000_000  # whole copies that are known beforehand, at most; others are found like any passage

    @property
    def window(self) -> int:
        return self.length - self.gram + 1

    @property
    def before(self) -> int:
        return self.length - self.gram


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for each i where it fits."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h = mix64(np.arange(256, dtype=np.uint64))[data]
    have = 1
    with np.errstate(over="ignore"):
        while have < gram:
            odd = mix64(np.array([have + 1000], np.uint64))[0] | np.uint64(1)
            h = h[:-have] * odd + h[have:]
            have *= 2
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, how: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of joined texts that end there. Anchors are the least of many, so their hashes are
    mixed anew: leading bits, which choose ranges and bits, are spread evenly."""
    if len(data) < how.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, how.gram)
    order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = sliding(order, how.window, np.minimum)  # of the string that begins at each position
    inside = np.zeros(len(data) + 1, np.int32)
    starts = np.append(0, ends[:-1])
    full = ends - starts >= how.length
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - how.length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0  # it would reach over a text's end
    w = how.window - 1
    padded = np.concatenate([np.zeros(w, np.uint32), least, np.zeros(w, np.uint32)])
    most = sliding(padded, how.window, np.maximum)[: len(order)]
    at = np.flatnonzero(most == order)
    return at, mix64(h[at])


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.cumsum([len(t) for t in texts])


def whole_copies(texts: DataFrame, how: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of texts that have an equal one, and which of them stand for their copies.

    texts: (key, text). All bytes of such texts go, and one of each group is enough for others to be compared with. To
    know them only spares work, so the table is cut at a bound."""
    held = texts.select("key", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("n")).where(F.col("n") >= how.length)
    groups = held.groupBy("h", "g", "n").agg(F.min("key").alias("rep"), F.count("*").alias("_many")).where("_many > 1").drop("_many")
    copies = held.join(groups, ["h", "g", "n"]).where("key <> rep").select("key", "rep").distinct().limit(how.copies).toArrow()
    own, rep = copies["key"].to_numpy(), np.unique(copies["rep"].to_numpy())
    keys = np.concatenate([own, rep])
    order = np.argsort(keys, kind="stable")
    return keys[order], (np.arange(len(keys)) >= len(own))[order]


def place_in(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each key its place in a sorted array, -1 if it isn't there."""
    if not len(found):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.where(found[at] == keys, at, -1)


def without_copies(batch: pa.RecordBatch, copies: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows (key, text) but for copies that another stands for."""
    keys, rep = copies
    at = place_in(batch.column(0).to_numpy(zero_copy_only=False), keys)
    return batch if not len(keys) else batch.filter(pa.array((at < 0) | rep[at]))


def marked(texts: DataFrame, copies, how: Repeats) -> tuple[np.ndarray, list[bytes]]:
    """The bitmap of anchor hashes found twice, by their leading bits, and splitters of the sort order."""
    spark = texts.sparkSession
    log2 = max(1, (shuffle_partitions(spark) - 1).bit_length())

    def gather(batches):
        parts, size = [], 0

        def flush():
            h = np.sort(np.concatenate(parts))
            first = np.append(True, h[1:] != h[:-1])
            twice = np.append(first[1:] == 0, False)[first]
            h = h[first]
            cuts = np.searchsorted(h, np.arange(1, 1 << log2, dtype=np.uint64) << np.uint64(64 - log2))
            rows = [(i, h[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)])) if b > a]
            parts.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["range", "hashes", "twice"])

        for batch in batches:
            for _, rows in text_slices(without_copies(batch, copies.value).column(1), 1 << 19):
                data, ends = joined(rows)
                _, h = anchors(np.frombuffer(data, np.uint8), ends, how)
                parts.append(h)
                size += len(h)
                if size >= 500_000:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        give_back()

    blocks = texts.mapInArrow(gather, "range int, hashes binary, twice binary")
    bits = how.bitmap_log2

    def mark(table: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(bool) for x, h in zip(table["twice"], hs)]
        h = np.sort(np.concatenate(hs))
        found = np.concatenate([h[1:][h[1:] == h[:-1]], *(x[t] for x, t in zip(hs, twice))])
        place = np.unique(found >> np.uint64(64 - bits)).astype(np.uint32)
        r = table["range"][0].as_py()
        segment = np.zeros(1 << bits - log2, bool)
        segment[place - np.uint32(r << bits - log2)] = True
        return pa.table({"range": pa.array([r], pa.int32()), "bits": pa.array([zstandard.compress(np.packbits(segment, bitorder="little").tobytes(), 1)], pa.binary())})

    found = blocks.repartition(1 << log2, "range").groupBy("range").applyInArrow(mark, "range int, bits binary").toArrow()
    bitmap = np.zeros(1 << bits - 3, np.uint8)  # what is collected is that large at most
    width = 1 << bits - log2 - 3
    for r, b in zip(found["range"].to_pylist(), found["bits"]):
        bitmap[r * width : (r + 1) * width] = np.frombuffer(zstandard.decompress(b.as_py()), np.uint8)
    ranges = 8 * shuffle_partitions(spark)
    # splitters only balance the ranges: a piece out of each of a bounded number of texts
    place = F.pmod(F.xxhash64("key"), F.octet_length("text") - how.length).cast("int") + 1
    pieces = texts.where(F.octet_length("text") > how.length).select("key", F.substring("text", place, F.lit(how.splitter_bytes)).alias("s"))
    sample = sorted(pieces.orderBy(F.xxhash64("key"), "s").limit(how.samples * ranges).toArrow()["s"].to_pylist())
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    return bitmap, splitters


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which that much is known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return known + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7 >> 3)


def coded(entries: list) -> bytes:
    """A sorted run of (suffix, before, [keys], [places]), each suffix without what it shares with the one before it."""
    shared, rest, before, counts, keys, places = [], [], [], [], [], []
    last = b""
    for suffix, left, k, p in entries:
        n = common(last, suffix)
        shared.append(n)
        rest.append(suffix[n:])
        before.append(left)
        counts.append(len(k))
        keys += k
        places += p
        last = suffix
    held = (bytes(shared) if max(shared) < 256 else shared, rest, before, counts, np.array(keys, np.int64).tobytes(), np.array(places, np.int64).tobytes())
    return zstandard.compress(pickle.dumps(held, protocol=5), 3)


def decoded(run: bytes):
    """(shared, suffix, before, keys, places) of a run, in order."""
    shared, rest, before, counts, keys, places = pickle.loads(zstandard.decompress(run))
    keys, places = np.frombuffer(keys, np.int64), np.frombuffer(places, np.int64)
    last, at = b"", 0
    for n, r, left, c in zip(shared, rest, before, counts):
        last = last[:n] + r
        yield n, last, left, keys[at : at + c], places[at : at + c]
        at += c


def merged(runs: list):
    """The entries of sorted runs in one order, each with the length of what it shares with the entry before it."""
    n = len(runs)
    size = 1
    while size < n:
        size *= 2
    heads: list = [None] * size
    known = [-1] * size  # length shared with the last entry put out; -1: the run is at its end
    for i in range(n):
        if (head := next(runs[i], None)) is not None:
            heads[i], known[i] = head, 0
    losers = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two runs. Who shares more with the last entry is the lesser; if both share as much,
        they are compared from there on, and the loser's length becomes that shared with the winner."""
        a, b = known[x], known[y]
        if a > b:
            return x, y
        if a < b:
            return y, x
        if a < 0:
            return x, y
        p, q = heads[x][1], heads[y][1]
        c = common(p, q, a)
        if c == len(p) or (c < len(q) and p[c] < q[c]):
            known[y] = c
            return x, y
        known[x] = c
        return y, x

    winners = list(range(size))
    tree = [0] * size + winners
    for node in range(size - 1, 0, -1):
        tree[node], losers[node] = play(tree[2 * node], tree[2 * node + 1])
    top = tree[1]
    while known[top] >= 0:
        head = heads[top]
        yield known[top], head
        nxt = next(runs[top], None)
        if nxt is None:
            known[top] = -1
        else:
            heads[top], known[top] = nxt, nxt[0]
        node = top + size >> 1
        while node:
            winner, loser = play(top, losers[node])
            losers[node], top = loser, winner
            node >>= 1


def reach(cluster: list, how: Repeats) -> list[tuple[int, int]]:
    """For each (shared, suffix, before, occurrences) of a cluster in order, how far matches of the length reach before
    and after its anchor; (0, 0) without any."""
    n = len(cluster)
    out = [(0, 0)] * n
    open_ = []
    for i, (_, suffix, left, times) in enumerate(cluster):
        if times > 1 and len(suffix) + len(left) >= how.length:
            out[i] = (len(left), len(suffix))
        else:
            open_.append(i)
    if n == 1 or not open_:
        return out
    if n * len(open_) <= how.pairwise:
        backwards = [x[2][::-1] for x in cluster]
        for i in open_:
            far_left = far_right = 0
            for way in (-1, 1):
                r, j = len(cluster[i][1]), i
                while 0 <= j + way < n:
                    r = min(r, cluster[j][0] if way < 0 else cluster[j + 1][0])
                    j += way
                    if r < how.gram:
                        break
                    l = common(backwards[i], backwards[j])
                    if l + r >= how.length:
                        far_left, far_right = max(far_left, l), max(far_right, r)
            out[i] = (far_left, far_right)
        return out
    # by columns: which strings of the length, begun as many bytes before the anchor, are found twice
    width = how.before + how.length
    grid = np.zeros((n, width), np.uint8)
    has = np.zeros((n, 2), np.int64)
    times = np.array([x[3] for x in cluster])
    for i, (_, suffix, left, _) in enumerate(cluster):
        grid[i, how.before - len(left) : how.before] = np.frombuffer(left, np.uint8)
        grid[i, how.before : how.before + len(suffix)] = np.frombuffer(suffix, np.uint8)
        has[i] = len(left), len(suffix)
    least, most = np.full(n, width), np.full(n, -1)
    for a in range(how.before + 1):
        fits = np.flatnonzero((has[:, 0] >= a) & (has[:, 1] >= how.length - a))
        if not len(fits):
            continue
        part = np.ascontiguousarray(grid[fits, how.before - a : how.before - a + how.length])
        _, which, count = np.unique(part.view(np.dtype((np.void, how.length))).ravel(), return_inverse=True, return_counts=True)
        found = fits[(np.bincount(which, times[fits])[which] > 1)]
        least[found] = np.minimum(least[found], a)
        most[found] = a
    for i in open_:
        if most[i] >= 0:
            out[i] = (int(most[i]), how.length - int(least[i]))
    return out


def spans(texts: DataFrame, copies, bitmap: np.ndarray, splitters: list[bytes], how: Repeats) -> tuple[DataFrame, Broadcast]:
    """(key, spans) of a table (key, binary text): beginnings and ends of matches, in several rows for a key; and a broadcast
    that is needed until they have been taken."""
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, splitters))

    def runs(batches):
        bits, cuts = sent.value
        held: dict = {}
        count = 0

        def flush():
            ordered = sorted((s, left, *occ) for (s, left), occ in held.items())
            held.clear()
            at = 0
            edges = [*cuts, None]
            while at < len(ordered):
                r = bisect_right(cuts, ordered[at][0])
                to = at
                if edges[r] is None:
                    to = len(ordered)
                else:
                    lo, hi = at, len(ordered)
                    while lo < hi:
                        mid = lo + hi >> 1
                        if ordered[mid][0] < edges[r]:
                            lo = mid + 1
                        else:
                            hi = mid
                    to = lo
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([coded(ordered[at:to])], pa.binary())], ["range", "run"])
                at = to
            ordered.clear()
            give_back()

        for batch in batches:
            batch = without_copies(batch, copies.value)
            for first, rows in text_slices(batch.column(1), 1 << 19):
                data, ends = joined(rows)
                at, h = anchors(np.frombuffer(data, np.uint8), ends, how)
                place = h >> np.uint64(64 - how.bitmap_log2)
                at = at[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                keys = batch.column(0).slice(first, len(rows)).to_pylist()
                row = np.searchsorted(ends, at, side="right").tolist()
                bounds = [0, *ends.tolist()]
                for p, i in zip(at.tolist(), row):
                    begin, end = bounds[i], bounds[i + 1]
                    what = (data[p : min(p + how.length, end)], data[max(begin, p - how.before) : p])
                    occ = held.get(what)
                    if occ is None:
                        held[what] = ([keys[i]], [p - begin])
                    else:
                        occ[0].append(keys[i])
                        occ[1].append(p - begin)
                    count += 1
                if count >= how.run:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        cluster: list = []

        def close():
            # equal suffixes stand together; with what stands before them also equal they count as one
            same: list = []
            at: dict[bytes, list] = {}
            for shared, suffix, left, keys, places in cluster:
                if not same or suffix != same[-1][1]:
                    at.clear()
                if (old := at.get(left)) is not None:
                    old[3] += len(keys)
                    old[4].append((keys, places))
                else:
                    at[left] = old = [shared, suffix, left, len(keys), [(keys, places)]]
                    same.append(old)
            if len(same) == 1 and same[0][3] == 1:
                return
            for (l, r), (_, _, _, _, occ) in zip(reach([x[:4] for x in same], how), same):
                if l + r >= how.length:
                    for keys, places in occ:
                        for k, p in zip(keys.tolist(), places.tolist()):
                            found.setdefault(k, []).append((p - l, p + r))

        for shared, (_, suffix, left, keys, places) in merged([decoded(r.as_py()) for r in table["run"]]):
            if shared < how.gram and cluster:
                close()
                cluster.clear()
            cluster.append((shared, suffix, left, keys, places))
        if cluster:
            close()
        each = [united(v) for v in found.values()]
        flat = np.array([x for v in each for x in v], np.int64).reshape(-1, 2)
        ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
        out = pa.table({"key": pa.array(list(found), pa.int64()), "spans": pa.ListArray.from_arrays(ends, pairs)})
        del found, each, flat
        give_back()
        return out

    sorted_runs = texts.mapInArrow(runs, "range int, run binary").repartition(len(splitters) + 1, "range")
    return sorted_runs.groupBy("range").applyInArrow(merge, f"key long, spans {SPANS}"), sent


SPANS = "array<struct<begin:bigint,end:bigint>>"


def united_column(spans: Column) -> Column:
    """Sorted spans, those that touch as one."""

    @F.arrow_udf(SPANS)
    def united_rows(column: pa.Array) -> pa.Array:
        rows = []
        for row in column:
            begin, end = (x.to_numpy(zero_copy_only=False) for x in row.values.flatten()) if row.is_valid else np.zeros((2, 0), np.int64)
            order = np.argsort(begin, kind="stable")
            begin, upto = begin[order], np.maximum.accumulate(end[order])
            first = np.append(True, begin[1:] > upto[:-1])[: len(begin)]
            rows.append((begin[first], upto[np.append(first[1:], True)[: len(begin)]]))
        ends = pa.array(np.cumsum([0, *(len(a) for a, _ in rows)]), pa.int32())
        begins, upto = (np.concatenate(x) for x in zip(*rows)) if rows else np.zeros((2, 0), np.int64)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(begins, pa.int64()), pa.array(upto, pa.int64())], ["begin", "end"]))

    return united_rows(spans)


def united(pairs) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


BITMAP = 26


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "spans", how: Repeats = Repeats(), rest: str | None = None, characters: bool = False) -> DataFrame:
    """docs with the sorted, disjoint spans of bytes that go: array<struct<begin,end>>.

    rest: a column for the bytes (binary) that are left; characters: of them, parts of UTF-8 characters go too."""
    own, (key, text), back = apart(small_batches(docs), [key, text])
    found = _with_spans(own, key, text, how, rest is not None, characters)
    return back(found, [F.col("_gone").alias(out), *([F.col("_kept").alias(rest)] if rest is not None else [])])


def _with_spans(docs: DataFrame, key: str, text: str, how: Repeats, with_rest: bool, characters: bool) -> DataFrame:
    out, rest = "_gone", "_kept" if with_rest else None
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    own = F.xxhash64(F.col(key), F.col(text))
    texts = docs.select(own.alias("key"), raw.alias("text"))
    copies = docs.sparkSession.sparkContext.broadcast(whole_copies(texts, how))
    bitmap, splitters = marked(texts, copies, how)
    settle(docs.sparkSession)
    found, sent = spans(texts, copies, bitmap, splitters, how)
    found = found.groupBy(F.col("key").alias("_found")).agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    found = stored(found, "spans")  # after the shuffle, which leaves a few files instead of one for each range
    sent.destroy()
    del bitmap
    settle(docs.sparkSession)
    # texts without a span needn't be shuffled: a bitmap of fixed size tells most of them
    place = F.pmod(F.xxhash64("_found"), F.lit(1 << BITMAP))
    bits = found.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_found), {1 << BITMAP}) % 64 as int))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << BITMAP - 6, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("int")
    def kind(keys: pa.Array, places: pa.Array) -> pa.Array:
        """2: a whole copy, 1: may have spans, 0: has none."""
        at = places.to_numpy(zero_copy_only=False)
        some = (sent.value[at >> 6] >> (at & 63) & 1).astype(np.int32)
        return pa.array(np.where(place_in(keys.to_numpy(zero_copy_only=False), copies.value[0]) >= 0, 2, some).astype(np.int32))

    keyed = docs.withColumn("_key", own).withColumn("_kind", kind(own, F.pmod(F.xxhash64(own), F.lit(1 << BITMAP))))
    none = F.array().cast(SPANS)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length(text).cast("long").alias("end")))
    whole = keyed.where("_kind <> 1").withColumn(out, F.when(F.col("_kind") == 2, all_of).otherwise(none)).drop("_key", "_kind")
    cut = keyed.where("_kind = 1").join(found, F.col("_key") == F.col("_found"), "left")
    cut = cut.withColumn(out, united_column(F.coalesce("_spans", none))).drop("_key", "_kind", "_spans", "_found")
    if rest is not None:
        whole = whole.withColumn(rest, F.when(F.size(out) > 0, F.lit(b"")).otherwise(raw))
        cut = cut.withColumn(rest, remaining(F.col(text), F.col(out), characters))
    return whole.unionByName(cut)


def cut_out(text: bytes, gone: list, characters: bool = False) -> bytes:
    goes_on = lambda at: at < len(text) and text[at] & 0xC0 == 0x80
    parts, at = [], 0
    for s in gone:
        begin, end = s["begin"], s["end"]
        if characters:
            while begin > at and goes_on(begin):
                begin -= 1
            while goes_on(end):
                end += 1
        parts.append(text[at:begin])
        at = max(at, end)
    parts.append(text[at:])
    return b"".join(parts)


def remaining(text: Column, gone: Column, characters: bool = False) -> Column:
    """The bytes (binary) that are left of a text."""

    @F.arrow_udf("binary")
    def rest(texts: pa.Array, all_gone: pa.Array) -> pa.Array:
        return pa.array([cut_out(t.as_py() or b"", g.as_py() or [], characters) for t, g in zip(texts, all_gone)], pa.binary())

    return rest(text.cast("binary"), gone)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(documents(spark, sf_dir).select("doc_id", "text"), rest="kept")
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
