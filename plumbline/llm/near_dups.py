"""Near duplicates by SetSketch registers.

A text's set holds the hashes of its word shingles; a text of fewer words has one shingle, all its words. Register i of
its sketch is the truncated logarithm of the least of exponentially distributed values, one for each element, so
sketches of parts merge by the maximum, and registers of similar sets are often equal. Texts with equal sets form a
class, of which the least id goes on. Bands of registers make buckets. A pair is plausible if, by the joint likelihood
of its registers given both sizes, a similarity of the threshold isn't far less likely than the best one. In each bucket
all are first paired with the least id; then, in the buckets that still hold different groups, those of different groups
with each other, in blocks. Plausible pairs make groups. Inside a group, pairs are confirmed on the full sets, the
likeliest first and none that is connected already. Confirmed links make components.

At similarity 0.8, a pair shares no bucket with a probability of (1 - 0.8**3)**20 < 1e-6. Sets are told apart by 64-bit
hashes, equal sets by 128 bits.

Null and empty texts, and texts without a word, have no shingles and no links. Texts are taken whole. Repeated rows
have one component; a row without an id has none, and stays. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import NUMBER, numbered
from plumbline.llm.common import documents, give_back, mix64, settle, small_batches, stored, text_slices
from plumbline.llm.graph import components
from plumbline.llm.lm_score import WordIds, hashes_of, tokens_of


@dataclass(frozen=True)
class Sketching:
    shingle: int = 4
    percent: int = 80  # similarity of a link, at least
    bands: int = 20
    rows: int = 3
    base: float = 1.001
    rate: float = 20.0
    most: int = 65534
    margin: float = 14.0  # of log-likelihood
    block: int = 3000  # rows of a bucket or group that are compared at once

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class Shingler:
    """Sorted sets of shingle hashes of texts."""

    def __init__(self, width: int):
        self.width, self.ids, self.known = width, WordIds(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.ids) > self.ids.at_most:
            self.ids.clear()
            self.known = self.known[:0]
        flat, counts = tokens_of(texts, self.ids)
        self.known = np.concatenate([self.known, hashes_of(self.ids.new)])
        self.ids.new.clear()
        words = self.known[flat]
        # the hash of a shingle of k words depends on the words, their order and k
        k = self.width
        ends = np.cumsum(counts)
        out = []
        with np.errstate(over="ignore"):
            full = mix64(words + np.uint64(1))[: max(0, len(words) - k + 1)] if len(words) >= k else np.zeros(0, np.uint64)
            for j in range(1, k):
                full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    h = mix64(words[a : a + 1] + np.uint64(b - a - k + 1 & 0xFFFFFFFF))
                    for j in range(a + 1, b):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def register_seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(2 * m, dtype=np.uint64)
    seeds = mix64(i * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return seeds[:m] | np.uint64(1), seeds[m:]


def registers(sets: list[np.ndarray], how: Sketching) -> np.ndarray:
    """One row of registers for each set; zeros for empty ones."""
    out = np.zeros((len(sets), how.registers), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    odd, plus = register_seeds(how.registers)
    least = np.empty((len(full), how.registers))
    with np.errstate(over="ignore"):
        for i in range(how.registers):
            y = x * odd[i] + plus[i]
            y ^= y >> np.uint64(32)
            y *= np.uint64(0x9E3779B97F4A7C15)
            least[:, i] = np.minimum.reduceat(y, starts)
    u = np.maximum(least / 2.0**64, 2.0**-64)
    k = np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 2.0**-53)) / how.rate) / np.log(how.base))
    out[full] = np.clip(k, 0, how.most + 1)
    return out


def band_keys(regs: np.ndarray, how: Sketching) -> np.ndarray:
    r = regs.reshape(len(regs), how.bands, how.rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(how.bands, dtype=np.uint64)), r.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(how.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
    return key.view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, how: Sketching) -> np.ndarray:
    """Whether a similarity of the threshold or more is no far worse explanation of the registers than the best one."""
    na, nb = na.astype(float), nb.astype(float)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    fits = 100 * np.minimum(na, nb) >= how.percent * np.maximum(na, nb)
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    base = how.base

    def share(x):
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def loglik(j):
        p, q = np.maximum(share(u - v * j), 1e-9), np.maximum(share(v - u * j), 1e-9)
        return up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-9))

    steps = np.linspace(0, 1, 41)[None, :]
    best = loglik(steps * most[:, None]).max(1)
    t = how.percent / 100
    near = loglik(t + steps * np.maximum(most[:, None] - t, 0)).max(1)
    return fits & (near >= best - how.margin)


def sketches(docs: DataFrame, key: str, text: str, how: Sketching) -> DataFrame:
    """(id, n, s1, s2, keys, regs) for each row: set size, two digests of the set, band keys and registers."""

    def sketch(batches):
        shingler = Shingler(how.shingle)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), 1 << 20):
                sets = shingler.sets(texts)
                regs = registers(sets, how)
                with np.errstate(over="ignore"):
                    s1 = np.array([mix64(s).sum() if len(s) else 0 for s in sets], np.uint64)
                    s2 = np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64)
                keys = band_keys(regs, how)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * how.bands, pa.int32()), pa.array(keys.ravel())),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["id", "n", "s1", "s2", "keys", "regs"],
                )

    raw = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return raw.mapInArrow(sketch, "id long, n long, s1 long, s2 long, keys array<long>, regs binary")


BITMAP = 26  # log2 of the bits by which a scan leaves out most texts that aren't compared


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, how: Sketching) -> tuple[DataFrame, Broadcast]:
    """(id, s, set) for the wanted (id, s), where s is the first digest of the set, and the broadcast that it reads."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP))
    bits = wanted.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << BITMAP}) % 64 as int))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**20 rows at most
    words = np.zeros(1 << BITMAP - 6, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def sets(batches):
        shingler = Shingler(how.shingle)
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for first, texts in text_slices(batch.column(2), 1 << 20):
                found = shingler.sets(texts)
                with np.errstate(over="ignore"):
                    s = np.array([mix64(x).sum() if len(x) else 0 for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(s), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "s", "set"])

    raw = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).where("id IS NOT NULL")
    found = raw.select("id", place.alias("p"), "t").mapInArrow(sets, "id long, s long, set binary")
    return found.join(wanted, ["id", "s"], "left_semi").dropDuplicates(["id", "s"]), sent


class Unions:
    """Which of some labels are known to belong together."""

    def __init__(self):
        self.over: dict = {}

    def root(self, x):
        while (y := self.over.get(x, x)) != x:
            self.over[x] = x = self.over.get(y, y)
        return x

    def join(self, x, y) -> bool:
        """Whether they were apart so far."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.over[max(x, y)] = min(x, y)
        return True


def enough_equal(how: Sketching) -> int:
    """Equal registers that a pair at the threshold has but for a probability of less than 1e-7."""
    t = how.percent / 100
    return int(how.registers * t - 5.4 * (how.registers * t * (1 - t)) ** 0.5)


def forest(ids: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: list[bytes], block: np.ndarray, i: int, j: int, how: Sketching, joined: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that links connect among two blocks of rows, each confirmed on the full sets.

    joined: rows that are known to be connected. Pairs go by falling number of equal registers, and those already connected
    are left out, so a large group of close copies costs about one comparison of sets for each of its rows."""
    unions, out = Unions(), []
    known = np.flatnonzero(joined).tolist()
    for x in known[1:]:
        unions.join(known[0], x)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    full = [np.frombuffer(x, np.uint64) for x in sets]
    least = enough_equal(how)
    xs, ys, es = [], [], []
    for x in left:
        y = right[right > x] if i == j else right
        y = y[(100 * np.minimum(n[y], n[x]) >= how.percent * np.maximum(n[y], n[x])) & ~(joined[y] & joined[x])]
        equal = (regs[y] == regs[x]).sum(1)
        hit = equal >= least
        xs.append(np.full(int(hit.sum()), x))
        ys.append(y[hit])
        es.append(equal[hit])
        if sum(map(len, xs)) > 2_000_000:  # bounded memory: what is gathered is settled first
            _settle(xs, ys, es, ids, full, unions, out, how)
    _settle(xs, ys, es, ids, full, unions, out, how)
    return out


def are_linked(p: np.ndarray, q: np.ndarray, how: Sketching) -> bool:
    """Whether two sets, as sorted hashes, are similar enough."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= how.percent * (len(p) + len(q) - shared)


def _settle(xs, ys, es, ids, full, unions: Unions, out: list, how: Sketching) -> None:
    if xs:
        x, y, e = np.concatenate(xs), np.concatenate(ys), np.concatenate(es)
        for k in np.argsort(-e, kind="stable").tolist():
            a, b = int(x[k]), int(y[k])
            if unions.root(a) == unions.root(b):
                continue
            if are_linked(full[a], full[b], how):
                unions.join(a, b)
                out.append((int(ids[a]), int(ids[b])))
    xs.clear()
    ys.clear()
    es.clear()


def confirmed(docs: DataFrame, grouped: DataFrame, key: str, text: str, how: Sketching) -> tuple[DataFrame, Broadcast]:
    """Links (u, v) that connect what links connect, and a broadcast that is needed until they have been taken. grouped: (id, s1, n, regs, c), where c is a group that no plausible
    pair leaves. Large groups are cut into blocks, and each pair of blocks is looked at by itself."""
    size = grouped.groupBy(F.col("c").alias("_c")).agg(F.count("*").alias("_n")).where("_n > 1")
    size = size.select("_c", F.ceil(F.col("_n") / how.block).cast("int").alias("_blocks"))
    grouped = stored(grouped.join(size, F.col("c") == F.col("_c")).drop("_c"), "groups")
    sets, sent = full_sets(docs, grouped.select("id", F.col("s1").alias("s")), key, text, how)
    held = grouped.join(sets.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("s1") == F.col("s"))).drop("_id", "s")
    none = F.lit(False).alias("main")
    if grouped.where("_blocks > 1").isEmpty():
        return linked(in_blocks(held.withColumn("main", none), how), how), sent
    held = stored(held, "grouped-sets")  # read twice, and texts are scanned once
    large = held.where("_blocks > 1")
    near = stored(beside_least(large, how), "near-least")
    known = near.select(F.col("id").alias("_i"), F.col("s1").alias("_s"), F.lit(True).alias("_near"))
    large = large.join(known, (F.col("id") == F.col("_i")) & (F.col("s1") == F.col("_s")), "left").withColumn("main", F.coalesce("_near", F.lit(False))).drop("_i", "_s", "_near")
    both = held.where("_blocks = 1").withColumn("main", none).unionByName(large)
    return linked(in_blocks(both, how), how).unionByName(near.select(F.col("least").alias("u"), F.col("id").alias("v"))), sent


def beside_least(large: DataFrame, how: Sketching) -> DataFrame:
    """(id, s1, least): the rows of large groups that are linked with the least row of their group, and that row itself.

    Each block of a group gets the least row as a guest, so no group comes together."""
    own = F.pmod(F.xxhash64("id", "s1"), F.col("_blocks")).cast("int").alias("_own")
    least = large.groupBy("c").agg(F.min_by(F.struct("id", "s1", "n", "set"), F.struct("id", "s1")).alias("_l"), F.max("_blocks").alias("_blocks"))
    guests = least.select("c", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_own"), F.lit(0).alias("_turn"), "_l.id", "_l.s1", "_l.set")
    rows = large.select("c", own, F.lit(1).alias("_turn"), "id", "s1", "set").unionByName(guests)
    rows = rows.repartition("c", "_own").sortWithinPartitions("c", "_own", "_turn")

    def compare(batches):
        guest = None
        for batch in batches:
            found = []
            for turn, i, s1, held in zip(*(batch.column(x).to_pylist() for x in ("_turn", "id", "s1", "set"))):
                held_set = np.frombuffer(held, np.uint64)
                if turn == 0:
                    guest = (i, held_set)
                elif are_linked(guest[1], held_set, how):
                    found.append((i, s1, guest[0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["id", "s1", "least"])

    return rows.mapInArrow(compare, "id long, s1 long, least long")


def in_blocks(rows: DataFrame, how: Sketching, group: str = "c") -> DataFrame:
    """rows (group, id, s1, main, _blocks, ...) for each pair of blocks (i, j) in which two of them have to be compared.

    Of a large group, the main rows are known to be connected, and only the others are compared with them and with each
    other. Both have blocks of their own, so rows are multiplied by the number of blocks of the others, not of all."""
    out = F.count_if(~F.col("main"))
    sizes = rows.where("_blocks > 1").groupBy(F.col(group).alias("_of")).agg(F.ceil((F.count("*") - out) / how.block).cast("int").alias("_m"), F.ceil(out / how.block).cast("int").alias("_o"))
    held = rows.join(sizes, F.col(group) == F.col("_of"), "left").withColumns({"_m": F.coalesce("_m", F.lit(0)), "_o": F.coalesce("_o", F.lit(1))})
    place = F.xxhash64("id", "s1")
    own = F.when(F.col("main"), F.pmod(place, F.greatest("_m", F.lit(1)))).otherwise(F.col("_m") + F.pmod(place, F.greatest("_o", F.lit(1)))).cast("int")
    first = F.when(F.col("main"), F.col("_m")).otherwise(0)
    others = F.when(F.col("_m") + F.col("_o") > first, F.sequence(first, F.col("_m") + F.col("_o") - 1))
    held = held.withColumn("_own", own).withColumn("_other", F.explode(others))
    return held.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_other", "_of", "_m", "_o", "_blocks")


def linked(blocks: DataFrame, how: Sketching) -> DataFrame:
    """Confirmed links (u, v) of rows in pairs of blocks."""
    held = blocks.select("c", "i", "j", "_own", "id", "n", "regs", "set", "main").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")

    def link(batches):
        rows: list = []
        last = None

        def close():
            ids, n, own = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 3))
            regs = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(len(rows), -1)
            return forest(ids, n, regs, [r[7] for r in rows], own, last[1], last[2], how, np.array([r[8] for r in rows], bool))

        found: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != last:
                    if rows:
                        found += close()
                        rows.clear()
                    last = row[:3]
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])
                found = []
        if rows:
            found = close()
            rows.clear()
            give_back()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    return held.mapInArrow(link, "u long, v long")


def plausible(pairs: DataFrame, reps: DataFrame, how: Sketching) -> DataFrame:
    """Those pairs (a, sa, b, sb) that the registers don't speak against."""

    @F.arrow_udf("boolean")
    def ok(x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1) for c in (x, y))
        return pa.array(likely(x, y, nx.to_numpy(zero_copy_only=False), ny.to_numpy(zero_copy_only=False), how))

    first = reps.select(F.col("id").alias("a"), F.col("s1").alias("sa"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    second = reps.select(F.col("id").alias("b"), F.col("s1").alias("sb"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(second, ["b", "sb"]).join(first, ["a", "sa"])
    both = both.where(100 * F.least("na", "nb") >= how.percent * F.greatest("na", "nb"))
    return both.where(ok("ra", "rb", "na", "nb")).select("a", "sa", "b", "sb")


def across(buckets: DataFrame, reps: DataFrame, how: Sketching) -> DataFrame:
    """Pairs (u, v) of groups, which connect all groups of which rows share a bucket and the registers don't speak against.

    buckets: (key, id, s1, c); reps: (id, s1, n, regs, ...). A large bucket is cut into blocks of rows, and each pair of blocks
    is a task's group; the rows of its most frequent group are compared with the others only."""
    size = buckets.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_n"), F.min("c").alias("_lo"), F.max("c").alias("_hi"))
    size = size.where("_lo <> _hi AND _n > 2").select("_k", F.ceil(F.col("_n") / how.block).cast("int").alias("_blocks"))
    held = stored(buckets.join(size, F.col("key") == F.col("_k")).drop("_k"), "buckets")  # those whose rows differ in group
    often = held.where("_blocks > 1").groupBy(F.col("key").alias("_k"), F.col("c").alias("_c")).agg(F.count("*").alias("_n"))
    often = often.groupBy("_k").agg(F.max_by("_c", F.struct("_n", "_c")).alias("_most"))
    held = held.join(often, F.col("key") == F.col("_k"), "left").withColumn("main", F.coalesce(F.col("c") == F.col("_most"), F.lit(False))).drop("_k", "_most")
    held = in_blocks(held, how, "key").drop("main").join(reps.select("id", "s1", "n", "regs"), ["id", "s1"])

    least = enough_equal(how)

    def compare(table: pa.Table) -> pa.Table:
        ids, n, c, block = (table[x].to_numpy() for x in ("id", "n", "c", "_own"))
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(ids), -1)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        unions, out = Unions(), []
        for x in left:
            y = right[(c[right] != c[x]) & (np.minimum(n[right], n[x]) * 100 >= how.percent * np.maximum(n[right], n[x]))]
            if i == j:
                y = y[y > x]
            y = y[(regs[y] == regs[x]).sum(1) >= least] if len(y) else y
            if len(y):
                y = y[likely(np.broadcast_to(regs[x], (len(y), regs.shape[1])), regs[y], np.full(len(y), n[x]), n[y], how)]
                out += [(int(c[x]), int(c[z])) for z in y if unions.join(int(c[x]), int(c[z]))]
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return held.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Sketching = Sketching()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs. Ids are of any type that has an order."""
    docs, keys = numbered(small_batches(docs).select(F.col(key).alias("_key_of"), F.col(text).alias("_text_of")), "_key_of")
    out = _near_duplicates(docs, NUMBER, "_text_of", how)
    if keys is None:
        return out
    for c in ("id", "component_id"):
        out = out.join(keys.select(F.col("_key").alias(f"_{c}"), F.col(NUMBER).alias("_n")), F.col(c) == F.col("_n"), "left").drop("_n")
    return out.select(F.col("_id").alias("id"), "n_shingles", F.col("_component_id").alias("component_id"), "kept")


def _near_duplicates(docs: DataFrame, key: str, text: str, how: Sketching) -> DataFrame:
    held = stored(sketches(docs, key, text, how), "sketches")
    classes = held.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n")
    reps = stored(classes.agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("regs").alias("regs")), "classes")

    buckets = reps.select(F.explode("keys").alias("key"), "id", "s1")
    least = buckets.groupBy(F.col("key").alias("_k")).agg(F.min(F.struct("id", "s1")).alias("_m"), F.count("*").alias("_n")).where("_n > 1")
    star = buckets.join(least, F.col("key") == F.col("_k"))
    star = star.select(F.col("_m.id").alias("a"), F.col("_m.s1").alias("sa"), F.col("id").alias("b"), F.col("s1").alias("sb")).where("a <> b").distinct()
    star = plausible(star, reps, how).select(F.col("a").alias("u"), F.col("b").alias("v"))
    hung = components(star)
    settle(docs.sparkSession)

    part = reps.join(hung, F.col("id") == F.col("u"), "left").withColumn("c", F.coalesce("v", "id")).drop("u", "v")
    more = stored(across(part.select(F.explode("keys").alias("key"), "id", "s1", "c"), reps, how), "across")
    if not more.isEmpty():
        over = components(more)
        part = part.join(over, F.col("c") == F.col("u"), "left").withColumn("c", F.coalesce("v", "c"))
    settle(docs.sparkSession)
    links, sent = confirmed(docs, part.select("id", "s1", "n", "regs", "c"), key, text, how)
    hung = components(links)
    sent.destroy()
    settle(docs.sparkSession)

    named = reps.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("n").alias("_n"), F.col("id").alias("_rep"))
    out = held.select("id", "n", "s1", "s2").join(named, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n")), "left")
    out = out.join(hung, F.col("_rep") == F.col("u"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("v", "_rep", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")


OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS u, doc_id AS c FROM sizes
  UNION
  SELECT e.v, r.c FROM reach r JOIN edges e ON e.u = r.u WHERE r.c < e.v),
best AS (SELECT u, min(c) AS c FROM reach GROUP BY u)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sizes JOIN best ON u = doc_id
"""
