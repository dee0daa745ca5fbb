"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the labelled ordinary texts, one on the toxic texts. Most of a toxic
text says what ordinary texts say too, and would fill its dictionary; so the trainer gets of toxic texts the passages
made of those byte strings that are typical of them (in a share of the toxic texts, and several times the share of
ordinary texts that has them). The toxic dictionary stands behind the ordinary one, so that both sides know the ordinary
language and lengths differ by what toxic texts have of their own. A text is cut into overlapping windows that begin and
end between words; each is compressed with either side, and its distance is what the toxic dictionary saves. A document
is described by how many of its windows reach each of several distances, alone and for each hundred windows; a logistic
curve, fitted on labelled documents that the dictionaries measured there have not seen, makes that a score.

Only the text is an input of a score. Null and empty texts have no windows and get the score of a text without hits.
Texts are scored whole. Learning takes the labelled rows whose ids hash lowest, at most max_labelled of them and of
max_bytes together, and takes place in one task, whose result is the model; the driver gets no texts. Without rows of
both classes every score is the share of toxic rows (0 without any row). Repeated rows score alike. Columns of the input
stay; those that have the name of a result are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import documents, give_back, mix64, small_batches

DISTANCES = (1, 2, 3, 4, 5, 6)
#: Bytes of a text that are cut into windows at once, and windows that are compressed at once.
PIECE, AT_ONCE = 1 << 20, 4096
#: Strings that are gathered before they are counted.
COUNTED = 1 << 22


@dataclass(frozen=True)
class Training:
    max_labelled: int = 10_000
    max_bytes: int = 64 << 20  # of their texts
    window: int = 36  # bytes, at least
    step: int = 24  # from a window to the next, at least
    gram: int = 8  # bytes of a string that may be typical
    least_texts: int = 8  # that have it
    least_share: float = 0.02  # of the toxic texts that have it
    contrast: float = 6.0  # times the share of the ordinary texts that have it
    ordinary_bytes: int = 65_536
    sampled_bytes: int = 4 << 20  # of ordinary texts that the trainer gets, about
    toxic_bytes: int = 2_048
    segment: int = 20  # of the toxic dictionary
    level: int = 3
    least_match: int = 4
    ridge: float = 0.1
    threshold: float = 0.3


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    how: Training
    weights: np.ndarray | None
    mean: np.ndarray | None
    spread: np.ndarray | None
    prior: float


def normal(text: bytes) -> bytes:
    """Lower-case words, a blank before and after each."""
    return b" " + b" ".join(text.lower().split()) + b" "


def pieces(text: bytes) -> Iterator[bytes]:
    """The normal text; of a long one, parts that end between words."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and text[cut] > 32:
            cut += 1
        yield normal(text[at:cut])
        at = cut
    yield normal(text[at:])


def windows(piece: bytes, how: Training) -> list[bytes]:
    """Overlapping windows: each begins at the first word after a multiple of step, and ends after the word that fills it."""
    blanks = np.flatnonzero(np.frombuffer(piece, np.uint8) == 32)
    if len(blanks) < 2 or len(piece) < 3:
        return []
    begin = np.searchsorted(blanks, np.arange(0, int(blanks[-2]) + 1, how.step))
    begin = blanks[np.unique(begin)]
    end = blanks[np.minimum(np.searchsorted(blanks, begin + how.window), len(blanks) - 1)]
    new = np.append(True, end[1:] != end[:-1])  # at the end of a text, windows inside the one before say nothing new
    return [piece[a : b + 1] for a, b in zip(begin[new].tolist(), end[new].tolist())]


def compressor(held: bytes, how: Training) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(how.level, min_match=how.least_match, write_content_size=False, write_dict_id=False, write_checksum=False)
    words = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=settings)


class Distances:
    def __init__(self, model: Model):
        self.how = model.how
        self.ordinary, self.toxic = (compressor(x, model.how) for x in (model.ordinary, model.ordinary + model.toxic))

    def of(self, found: list[bytes]) -> np.ndarray:
        """For each window, the bytes that the toxic dictionary saves."""
        a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(found, threads=1)), np.int64, len(found)) for c in (self.ordinary, self.toxic))
        return a - b

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """For each text, its windows and those that reach each of DISTANCES."""
        out = np.zeros((len(texts), len(DISTANCES) + 1))
        held: list[bytes] = []
        owner: list[int] = []

        def settle():
            if held:
                d, of = self.of(held), np.repeat(np.arange(len(texts)), np.bincount(owner, minlength=len(texts)))
                out[:, 0] += np.bincount(of, minlength=len(texts))
                for i, t in enumerate(DISTANCES, 1):
                    out[:, i] += np.bincount(of, d >= t, len(texts))
                held.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text):
                new = windows(piece, self.how)
                held += new
                owner += [i] * len(new)
                if len(held) >= AT_ONCE:
                    settle()
        settle()
        return out


def features(counts: np.ndarray) -> np.ndarray:
    """Hits alone and for a hundred windows, and the length; a text without hits has no evidence, however short it is."""
    n, hits = counts[:, :1] + 5.0, counts[:, 1:]
    return np.hstack([np.log1p(hits), np.log1p(100 * hits / n), np.log(n)])


def expanded(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -4, 8)
    return np.hstack([np.ones((len(z), 1)), z, z * z])


def gram_codes(text: bytes, gram: int) -> np.ndarray:
    """The text's strings of that many bytes (8 at most) as integers."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(raw) - gram + 1), np.uint64)
    for j in range(gram if len(out) else 0):
        out = out << np.uint64(8) | raw[j : j + len(out)]
    return out


def found_in(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the codes are in a sorted array."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def surroundings(text: bytes, gram: int) -> np.ndarray:
    """For each string of the text, a hash of it with as many bytes before and after it."""
    wide = gram_codes(b" " * gram + text + b" " * gram, gram)
    with np.errstate(over="ignore"):
        return mix64(mix64(mix64(wide[: -2 * gram]) + wide[gram:-gram]) + wide[2 * gram :])


def typical(toxic: list[bytes], ordinary: list[bytes], how: Training) -> np.ndarray:
    """Sorted codes of the strings that are typical of toxic texts.

    A string counts once for each text and for each surrounding, whichever is less: copies of a text add nothing. Only
    strings of enough toxic texts are counted in the others."""
    toxic = [t for t in toxic if len(t) >= how.gram]
    least = max(how.least_texts, how.least_share * len(toxic))
    codes, n, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for i, t in enumerate(toxic, 1):
        new.append(np.unique(gram_codes(t, how.gram)))
        if i == len(toxic) or sum(map(len, new)) > COUNTED:
            more, m = np.unique(np.concatenate(new), return_counts=True)
            both = np.concatenate([codes, more])
            codes, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(codes)).astype(np.int64)
            new.clear()
    codes, n = codes[n >= least], n[n >= least]
    around = [np.zeros((2, 0), np.uint64)]
    for t in toxic:
        c = gram_codes(t, how.gram)
        hit = found_in(c, codes)
        around.append(np.stack([surroundings(t, how.gram)[hit], c[hit]]))
    around = np.concatenate(around, 1)
    around = around[1, np.unique(around[0], return_index=True)[1]]
    n = np.minimum(n, np.bincount(np.searchsorted(codes, around), minlength=len(codes)))
    codes, n = codes[n >= least], n[n >= least]
    other = np.zeros(len(codes), np.int64)
    for t in ordinary:
        c = gram_codes(t, how.gram)
        c = np.unique(c[found_in(c, codes)])
        other[np.searchsorted(codes, c)] += 1
    return codes[n * len(ordinary) >= how.contrast * other * len(toxic)]


def passages(text: bytes, known: np.ndarray, gram: int) -> list[bytes]:
    """The passages of a text that consist of known strings."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found_in(gram_codes(text, gram), known).view(np.int8), [0]])))
    return [text[a : b + gram - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def trained(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """A dictionary by zstandard's trainer; the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(labelled: list[tuple[bytes, int]], how: Training) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of texts of both classes."""
    toxic, ordinary = ([normal(t) for t, y in labelled if y == label] for label in (1, 0))
    known = typical(toxic, ordinary, how)
    own = [p for t in toxic for p in passages(t, known, how.gram)]
    said = [t[i : i + 96] for t in ordinary for i in range(0, len(t), 96)]
    said = said[:: max(1, sum(map(len, said)) // how.sampled_bytes)]  # pieces of all texts, evenly
    return trained(own, how.toxic_bytes, how.segment, 8), trained(said, how.ordinary_bytes, 32, 6)


def fit(labelled: list[tuple[bytes, int]], how: Training) -> Model:
    """labelled: texts with their labels, in an order that doesn't depend on either. Every second text is measured with
    dictionaries of the others to calibrate; the model's dictionaries are of all of them."""
    prior = sum(y for _, y in labelled) / max(1, len(labelled))
    own, rest = labelled[::2], labelled[1::2]
    if any(len({y for _, y in half}) < 2 for half in (own, rest)):
        return Model(b"", b"", how, None, None, None, prior)
    distances = Distances(Model(*dictionaries(own, how), how, None, None, None, prior))
    x = features(np.concatenate([distances.counts([t for t, _ in rest[i : i + 200]]) for i in range(0, len(rest), 200)]))
    y = np.array([y for _, y in rest], float)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    e = expanded(x, mean, spread)
    w = np.zeros(e.shape[1])
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
        gradient = e.T @ (p - y) + how.ridge * w
        w -= np.linalg.solve((e * (p * (1 - p))[:, None]).T @ e + how.ridge * np.eye(len(w)), gradient)
    return Model(*dictionaries(labelled, how), how, w, mean, spread, prior)


def scores(texts: list[bytes], model: Model, distances: Distances | None) -> np.ndarray:
    if model.weights is None or distances is None:
        return np.full(len(texts), model.prior)
    x = features(distances.counts(texts))
    return 1 / (1 + np.exp(-np.clip(expanded(x, model.mean, model.spread) @ model.weights, -30, 30)))


def learnt(docs: DataFrame, labels: DataFrame, train: Column, how: Training = Training(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the labelled rows for which train holds (a condition on labels)."""
    chosen = labels.where(train & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k").limit(how.max_labelled)  # a bound: it can be broadcast, and learnt from in one task
    found = docs.select(F.col(key).alias("_d"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
    found = found.groupBy("_k").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y"))
    first = W.orderBy(F.xxhash64("_k"), "_k").rowsBetween(W.unboundedPreceding, 0)  # of max_labelled rows
    found = found.withColumn("_upto", F.sum(F.octet_length("_t")).over(first)).where(F.col("_upto") <= how.max_bytes)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_o", "ascending"), ("_y", "ascending")])
        model = fit([(t.as_py(), int(y.as_py() > 0)) for t, y in zip(table["_t"], table["_y"])], how)
        del table
        give_back()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = found.select(F.lit(0).alias("_g"), F.xxhash64("_k").alias("_o"), "_t", "_y").groupBy("_g").applyInArrow(learn, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else Model(b"", b"", how, None, None, None, 0.0)


_distances: dict[tuple[bytes, bytes], Distances] = {}


def distances_of(model: Model) -> Distances | None:
    if model.weights is None:
        return None
    key = (model.ordinary, model.toxic)
    if key not in _distances:
        _distances.clear()
        _distances[key] = Distances(model)
    return _distances[key]


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        give_back(False)
        return pa.array(scores([t.as_py() or b"" for t in texts], model, distances_of(model)), pa.float64())

    return docs.withColumn(score, of(F.col(text).cast("binary")))


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n (null: empty)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def toxicity(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """docs with score and predicted, learnt from labels but for a quarter of them that is held out."""
    model = learnt(docs, labels, remainder("doc_id", 4) != 2, how)
    return scored(docs, model).withColumn("predicted", (F.col("score") >= how.threshold).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(documents(spark, sf_dir).select("doc_id", "text"))
    out = toxicity(docs, documents(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
