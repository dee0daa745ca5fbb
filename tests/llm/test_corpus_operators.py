"""Near duplicates, repeated passages, fingerprints, mixing and the pipeline, against brute force and SQL."""

from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from plumbline.llm import fingerprints, mixing, near_dups, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    held = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in held.description]
    df = queries.QUERIES[name](spark, SF)
    order = lambda cols: [cols.index(c) for c in sorted(cols)]
    as_rows = lambda found, cols: sorted(repr(tuple(r[i] for i in order(cols))) for r in found)
    assert as_rows([tuple(r) for r in df.collect()], df.columns) == as_rows(held.fetchall(), names)


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_texts() -> list:
    pick = random.Random(8)
    base = [[f"w{pick.randint(0, 400)}" for _ in range(pick.randint(20, 200))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(10):
            w = list(b)
            for _ in range(pick.choice([0, 0, 1, 2, 4, 8])):
                w[pick.randrange(len(w))] = f"x{pick.randint(0, 9999)}"
            texts.append(" ".join(w))
    return [*texts, "", None, " \n ", "a b", "A b", "a b c", "a"]


@pytest.mark.parametrize("block", [3000, 3])
def test_near_duplicates(spark, block):
    texts = near_texts()
    df = spark.createDataFrame([(1000 - i, t, "x", "x") for i, t in enumerate(texts)] + [(1000, texts[0], "x", "x"), (None, "a b", "x", "x")], "doc_id long, text string, component_id string, n string")
    found = near_dups.near_duplicates(df, how=near_dups.Sketching(block=block)).collect()
    assert len(found) == len(texts) + 2
    sets = {1000 - i: shingles(t) for i, t in enumerate(texts)}
    over = {i: i for i in sets}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                over[y] = x
    for r in found:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["id"]]), root(r["id"]), root(r["id"]) == r["id"])
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("how", [suffix_dedup.Repeats(), suffix_dedup.Repeats(pairwise=0, run=50, bitmap_log2=12), suffix_dedup.Repeats(gram=32, run=100, copies=3)])
def test_repeated_passages(spark, how):
    pick = random.Random(3)
    base = ["".join(pick.choice("ab ") for _ in range(pick.randint(0, 900))) for _ in range(20)]
    texts = ["", "x" * 199, "x" * 200, "x" * 201, "ab" * 300, None, "é" * 150]
    for _ in range(100):
        t = list(pick.choice(base) + pick.choice(base))
        for _ in range(pick.choice([0, 0, 1, 2, 5]) if t else 0):
            t[pick.randrange(len(t))] = pick.choice("abc é")
        texts.append("".join(t))
    texts += texts[-5:]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, key string, spans string").repartition(3)
    gone = repeats(texts)
    found = {r["doc_id"]: r for r in suffix_dedup.with_spans(df, how=how, rest="rest").collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        mark = bytearray(len(gone[i]))
        for s in found[i]["spans"]:
            mark[s["begin"] : s["end"]] = b"\1" * (s["end"] - s["begin"])
        assert bytes(mark) == gone[i]
        assert bytes(found[i]["rest"]) == bytes(b for b, g in zip((t or "").encode(), gone[i]) if not g)
    assert suffix_dedup.with_spans(df.limit(0), how=how).count() == 0


def test_cut_characters():
    text = "aé€b".encode()
    assert suffix_dedup.cut_out(text, [{"begin": 2, "end": 4}], True).decode() == "ab"
    assert suffix_dedup.cut_out(text, [{"begin": 0, "end": 1}], True).decode() == "é€b"


def test_merged_runs():
    pick = random.Random(1)
    runs = [sorted({bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 12))) for _ in range(40)}) for _ in range(5)]
    coded = [suffix_dedup.decoded(suffix_dedup.coded([(x, b"", [1], [2]) for x in r])) for r in runs]
    out = list(suffix_dedup.merged(coded))
    assert [h[1] for _, h in out] == sorted(x for r in runs for x in r)
    assert all(n == suffix_dedup.common(a[1], b[1]) for (_, a), (n, b) in zip(out, out[1:]))


@pytest.mark.parametrize("bucket", [4000, 3])
def test_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket)
    found = fingerprints.op9_fingerprints(spark, SF).toPandas().sort_values("doc_id")
    texts = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").text.tolist()
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    assert found.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert found.n_chars.tolist() == [len(t) for t in texts]
    assert (found.near_edited > found.near_next).mean() > 0.95 and found.near_edited.between(0, 1).all()
    assert abs(found.near_edited.mean() - 0.8) < 0.08
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, ""), (3, None)], "doc_id long, text string")
    out = {(r["doc_id"], r["text"]): r["next_text"] for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    assert out[(None, "c")] in ("a", "b") and out[(3, None)] == "c" and {out[(1, "a")], out[(1, "b")]} <= {"a", "b", ""} and len(out) == 5
    assert fingerprints.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    one = fingerprints.with_next(df.limit(1), "doc_id", ["text"]).first()
    assert one["next_text"] == one["text"]


def test_sketch(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a b",), ("",), (None,)], "text string")
    got = [r["s"] for r in fingerprints.with_sketch(df, "text", "s").collect()]
    assert len(got[0]) >= 1 and len(got[1]) == 1 and got[2] == [] and got[3] == []


def test_mixing(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 5)] * 10 + [("b", 500)] * 20 + [(None, 50)] * 10 + [("c", 0)] * 3)]
    df = spark.createDataFrame([*rows, rows[0], (99, "a", None), (None, "b", "w")], "doc_id long, source string, text string")
    sizes = mixing.measured(df)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * sum(s for s, _ in targets.values()))
    assert all(t <= 2 * s + 1e-9 for s, t in targets.values())
    taken = mixing.queue(sizes)
    assert taken.groupBy("_row").count().where("count > 2").count() == 0
    again = mixing.queue(sizes).groupBy("source").sum("size").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, taken.groupBy("source").sum("size").collect()))
    assert mixing.queue(mixing.measured(df.limit(0))).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name.replace(" ", "-"))
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            if name == "near duplicates":
                assert docs.count() < before
    rows = docs.collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", "en", None, 3)], docs_schema())
    for name, stage in corpus_pipeline.STAGES:
        odd = corpus_pipeline.stored(stage(spark, odd, SF), name.replace(" ", "-"))
    assert {r["doc_id"] for r in odd.collect()} == {1, None}  # the mix takes nothing of a source without a word
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], docs_schema()), SF).count() == 0


def docs_schema() -> str:
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_anchors_fill_ranges_evenly():
    pick = random.Random(4)
    data = np.frombuffer(bytes(pick.choices(range(97, 123), k=400_000)), np.uint8)
    _, h = suffix_dedup.anchors(data, np.array([len(data)]), suffix_dedup.Repeats())
    shares = np.bincount((h >> np.uint64(59)).astype(np.int64), minlength=32) / len(h)
    assert len(h) > 2000 and shares.min() > 0.01 and shares.max() < 0.06


def test_stage_compares_five_words(spark):
    words = [f"w{i}" for i in range(90)]
    other = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 0.83 by four words, 0.79 by five
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate([words, other, [*words[:89], "y"]])], docs_schema())
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 1]


def test_rows_that_share_an_id(spark):
    words = [f"w{i}" for i in range(90)]
    unique = {i: " ".join(f"u{i}x{j}" for j in range(40)) for i in range(2, 12)}
    rows = [(1, " ".join(words))] + [(i, " ".join([*words[:89], f"y{i}"])) for i in unique] + 2 * [*unique.items()]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs_schema()).repartition(5)
    found = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert found == [(1, " ".join(words)), *sorted(unique.items())]


@pytest.mark.parametrize(("main", "others", "block"), [(95, 5, 10), (40, 37, 8), (30, 0, 7), (0, 25, 6), (3, 2, 9)])
def test_pairs_of_blocks(spark, main, others, block):
    """Rows outside of the main part meet each row once; the main part is multiplied by the blocks of the others only."""
    n = main + others
    rows = spark.createDataFrame([(1, i, i, i < main, -(-n // block)) for i in range(n)], "c long, id long, s1 long, main boolean, _blocks int")
    held = near_dups.in_blocks(rows, near_dups.Sketching(block=block)).toPandas()
    met = collections.Counter()
    for (i, j), group in held.groupby(["i", "j"]):
        left, right = group[group._own == i].id, group[group._own == j].id
        met.update(tuple(sorted((a, b))) for a in left for b in right if i != j or a < b)
    if n > block:
        assert set(met.values()) <= {1} and set(met) == {(a, b) for b in range(main, n) for a in range(b)}
        assert (held.id < main).sum() == main * -(-others // block)
    else:
        assert set(met) == {(a, b) for b in range(n) for a in range(b)}


def test_large_groups_of_near_copies(spark):
    """Chains of copies, of which the least text is near some only, in groups cut into many blocks."""
    pick = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts, w = [], list(base)
    for i in range(240):
        if i % 60 == 0:
            w = [f"{x}g{i}" for x in base]
        if i % 3 == 0:
            w = list(w)
            w[pick.randrange(60)] = f"x{i}"  # drifts away, each text near the last ones
        texts.append(" ".join([*w[:-1], f"y{i}"]))
    sets = [shingles(t) for t in texts]
    over = list(range(len(texts)))

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                over[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (3000, 9):
        found = {r["id"]: r["component_id"] for r in near_dups.near_duplicates(df, how=near_dups.Sketching(block=block)).collect()}
        assert found == {i: root(i) for i in range(len(texts))}
