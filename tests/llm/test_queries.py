"""The queries of the operators as they are registered, over whole tables, against brute force; and what all operators share:
clashing column names, ids of any type, very long texts."""

from __future__ import annotations

import base64
import collections
import hashlib
import html.parser
import math
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_corpus_operators import repeats
from test_text_operators import quality_counts
from tokenizers import Tokenizer

from plumbline.llm import byte_bpe, columns, fingerprints, graph, html_text, lm_score, mixing, near_dups, quality, suffix_dedup, token_count, toxicity
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


def found(spark, name):
    return QUERIES[name](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)


def test_op1(spark, docs):
    got = found(spark, "op1_token_counts")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = [len(e.ids) for e in library.encode_batch(docs.text.tolist(), add_special_tokens=False)]
    assert got.n_tokens.tolist() == n and got.over_limit.tolist() == [x > 2048 for x in n]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in docs.text] and got.doc_id.tolist() == docs.doc_id.tolist()


def test_op2(spark, docs):
    """kept by exact quantiles: sketches of this size hold all values of so few documents."""
    got = found(spark, "op2_quality_rules")
    counts = [quality_counts(t) for t in docs.text]
    assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False)] == counts
    failed = [n < 10 or 100 * r > 20 * n for n, _, _, _, r in counts]
    assert got.base_failed.tolist() == failed
    measures = quality.with_measures(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values("doc_id", ignore_index=True)
    rules = quality.QualityRules()

    def group_of(i):
        for keys in (("lang", "source"), ("lang",), ()):
            same = pd.Series(True, docs.index)
            for k in keys:
                same &= (docs[k] == docs[k][i]) | (docs[k].isna() & pd.isna(docs[k][i]))
            if same.sum() >= rules.min_group or not keys:
                return measures[same]

    for i in docs.index:
        inside = True
        for f in rules.fences:
            held = sorted(group_of(i)[f.measure])
            low, high = (held[max(0, math.ceil(q * len(held)) - 1)] for q in (0.25, 0.75))
            reach = f.ranges * max(high - low, f.least_range)
            inside &= (low - reach if f.both_sides else -math.inf) <= measures[f.measure][i] <= high + reach
        assert got.kept[i] == (inside and not failed[i]), docs.doc_id[i]


def brute_scores(texts, held_out, size):
    """The model of the operator's docstring by dictionaries, with exact counts in place of the filter."""
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    pairs = [list(zip([None, *w[:-1]], w)) for w in tokens]
    single = collections.Counter(w for ws, h in zip(tokens, held_out) if not h for w in ws)
    double = collections.Counter(p for ps, h in zip(pairs, held_out) if not h for p in ps)
    n, v = sum(single.values()), len(single)
    level = lambda c: math.frexp(c)[1] if c else 0
    count = lambda q: 2 ** (q - 0.5) if q > 1 else float(q)
    first = level(size.least_pair)
    again = sum(c for c in double.values() if c >= size.least_pair)
    weight = min(0.95, again / (n - sum(level(c) == 1 for c in single.values()) + 2.0))
    out = []
    for ps in pairs:
        total = 0.0
        for a, b in ps:
            q, qa = level(single[b]), level(single[a])
            qp = min(level(double[a, b]) if double[a, b] >= size.least_pair else 0, q, qa)
            w = weight if qa >= first else 0.0
            both = min(count(qp) / count(qa), 1.0) if qa else 0.0
            total += math.log10(w * both + (1 - w) * (count(q) + 1) / (n + v + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("size", [lm_score.ModelSize(bits=64, probes=8), lm_score.ModelSize(bits=64, probes=8, filter_bytes=4096, table_words=30, least_pair=1)])
def test_op3_score(spark, docs, size):
    """A filter of 64 bits and 8 probes for each entry has next to no false positives."""
    held_out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id]
    want = brute_scores(docs.text, held_out, size)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lm_score.lm_scores(df, lm_score.remainder("doc_id", 7) != 2, size=size).toPandas().sort_values("doc_id", ignore_index=True)
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got.score, want))


def test_op3(spark, docs):
    got = found(spark, "op3_lm_scores")
    tokens = [[*(t or "").encode().lower().split(), None] for t in docs.text]
    held_out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id]
    c = collections.Counter(w for ws, h in zip(tokens, held_out) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    assert got.held_out.tolist() == held_out and set(got.train_tokens) == {n}
    assert got.n_tokens.tolist() == list(map(len, tokens)) and got.n_known.tolist() == [sum(c[w] > 0 for w in ws) for ws in tokens]
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) for ws in tokens]
    assert all(abs(a - b) < 1e-6 for a, b in zip(got.base_score, base))
    near = brute_scores(docs.text, held_out, lm_score.ModelSize())  # false positives of the filter move a score a little
    off = sorted(abs(a - b) / abs(b) for a, b in zip(got.score, near))  # 0.6% in all, at most 11% of a text, when written
    assert abs(got.score.sum() - sum(near)) < 0.02 * abs(sum(near)) and off[int(0.95 * len(off))] < 0.05
    assert got.score[got.held_out].sum() / got.n_tokens[got.held_out].sum() > got.base_score[got.held_out].sum() / got.n_tokens[got.held_out].sum()


def test_op4(spark, docs):
    got = found(spark, "op4_suffix_dedup")
    for r, text, gone in zip(got.itertuples(), docs.text, repeats(docs.text)):
        raw = text.encode()
        spans = sum(b == 1 and (i == 0 or gone[i - 1] != 1) for i, b in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), gone.count(1), spans)
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(raw, gone) if g != 1)).hexdigest()


def test_op5(spark, docs):
    got = found(spark, "op5_toxicity")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    assert got.score.between(0, 1).all() and got.predicted.tolist() == [int(s >= 0.3) for s in got.score]
    # the same model in this process gives the same scores
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learnt(df, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.remainder("doc_id", 4) != 2)
    want = toxicity.scores([t.encode() for t in docs.text], model, toxicity.distances_of(model))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got.score, want))


class Article(html.parser.HTMLParser):
    """Blocks of the article of a page of the test tables, whose articles hold nothing but text, headings and lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.held, self.depth, self.aside = [], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS or tag == "article":
            self.flush_inside()
        self.depth += tag == "article"
        self.aside += bool(self.depth and tag in ("nav", "aside", "script", "style", "form", "footer", "figure"))
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS or tag == "article":
            self.flush_inside()
        self.aside -= bool(self.depth and tag in ("nav", "aside", "script", "style", "form", "footer", "figure"))
        self.depth -= tag == "article"

    def flush_inside(self):
        self.flush() if self.depth and not self.aside else self.held.clear()

    def handle_data(self, data):
        self.held.append(data)


def test_op6(spark):
    """Against a reader by the standard library's parser, over all pages of sf0.01."""
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op6_html_text"](spark, sf).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    assert len(got) == len(pages)
    wrong = []
    for page, url, text in pages[["page_id", "url", "html"]].itertuples(index=False):
        reader = Article()
        reader.feed(text)
        want = "\n".join(reader.blocks)
        r = got.loc[page]
        assert r.url == url and r.n_chars == len(r.text)
        if r.text != want:
            wrong.append((page, r.text[:200], want[:200]))
    assert not wrong, wrong[:2]


def shingle_hashes(text):
    words = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    if not words:
        return set()
    if len(words) < 5:
        return {signed(xxhash.xxh64_intdigest(" ".join(str(signed(w)) for w in words).encode(), 42))}
    out = set()
    for i in range(len(words) - 4):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        out.add(signed(h))
    return out


def sketch(text):
    h = shingle_hashes(text)
    low = -(1 << 63) + (1 << 64) // fingerprints.SCALE
    return sorted(x for x in h if x < low) or sorted(h)[:1]


def likeness(a, b):
    least = min(len(a), len(b))
    return len(set(a) & set(b)) / least if least else float(len(a) == len(b))


def test_op9(spark, docs):
    got = found(spark, "op9_fingerprints")
    texts = docs.text.tolist()
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, following)]
    written = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
    assert got.n_chars.tolist() == list(map(len, texts)) and got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert got.fingerprint.tolist() == [written(sketch(t)) for t in texts] and got.edited_fingerprint.tolist() == [written(sketch(t)) for t in edited]
    assert got.near_edited.tolist() == [likeness(sketch(a), sketch(b)) for a, b in zip(texts, edited)]
    assert got.near_next.tolist() == [likeness(sketch(a), sketch(b)) for a, b in zip(texts, following)]


def test_sketches_merge(spark):
    parts = [" ".join(f"w{i}" for i in range(a, a + 400)) for a in (0, 396, 792)]  # each overlaps the next by a shingle less one
    df = fingerprints.with_sketch(spark.createDataFrame([(t,) for t in parts], "text string"), "text", "s")
    whole = fingerprints.with_sketch(spark.createDataFrame([(" ".join(f"w{i}" for i in range(1192)),)], "text string"), "text", "s")
    assert df.agg(fingerprints.merged(F.col("s")).alias("s")).first()["s"] == whole.first()["s"]


def test_op10(spark, docs):
    got = found(spark, "op10_byte_bpe")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [library.encode_ordinary(t) for t in docs.text]
    assert got.n_tokens.tolist() == list(map(len, ids))
    assert got.ids_sha256.tolist() == [hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x)).hexdigest() for x in ids]
    assert got.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in docs.text]


WORD, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
OPERATORS = {
    "op1": lambda d, s: token_count.with_token_counts(d, WORD),
    "op2": lambda d, s: quality.judged(d),
    "op3": lambda d, s: lm_score.lm_scores(d, lm_score.remainder("doc_id", 7) != 2),
    "op4": lambda d, s: suffix_dedup.with_spans(d, rest="rest"),
    "op5": lambda d, s: toxicity.toxicity(d, s.read.parquet(f"{SF}/labels.parquet")),
    "op6": lambda d, s: html_text.main_text(d, "source", "text", "found"),
    "op7": lambda d, s: mixing.mixed(d),
    "op8": lambda d, s: near_dups.near_duplicates(d),
    "op9": lambda d, s: fingerprints.with_next(fingerprints.with_sketch(d, "text", "sketch"), "doc_id", ["text", "sketch"]),
    "op10": lambda d, s: byte_bpe.decode(byte_bpe.encode(byte_bpe.digests(byte_bpe.round_trip(d, BYTES), BYTES), BYTES), BYTES),
}
#: Names that the operators use inside, and of their results.
CLASHING = (
    "_in0 _in1 _others _number c0 _learn _row _s _t _known _r _c _g _h _k _w _v _twice _lines rest block n_words_known log_known symbol_share_low symbol_share_high n_0 _found _spans _key _kind _gone _kept"
    " _host _html _url _groups _group _text _run _page _a source_size target weight size taken _cap _cell _upto _turn _finish _id _o _bucket _first _wraps _at _hash _b _guest _next0 _digest _there _found_"
    " ids offsets decoded n_tokens n_words kept base_failed score predicted spans text_found next_text next_sketch sketch id n s1 s2 regs component_id"
).split()


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, docs, name):
    """The same rows with 90 more columns give the same results, and the columns stay unless a result has their name."""
    df = spark.createDataFrame(docs.head(40)[["doc_id", "text", "lang", "source"]])
    plain = OPERATORS[name](df, spark)
    wide = OPERATORS[name](df.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING}), spark)
    results = [c for c in plain.columns if c in wide.columns]
    assert results == plain.columns
    as_rows = lambda d: sorted(map(repr, (tuple(r) for r in d.select(*plain.columns).collect())))
    held = wide.persist()
    assert as_rows(held) == as_rows(plain)
    kept = [c for c in CLASHING if c in wide.columns and c not in plain.columns]
    if name != "op8":
        assert set(kept) | set(results) >= set(CLASHING) - {"text_found"} and held.where(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in kept)).isEmpty()
    held.unpersist()


def test_ids_of_any_type(spark, docs):
    df = spark.createDataFrame(docs.head(60)[["doc_id", "text"]])
    named = df.withColumn("doc_id", F.format_string("d%08d", "doc_id"))
    want = {(f"d{r['id']:08d}", r["n_shingles"], f"d{r['component_id']:08d}", r["kept"]) for r in near_dups.near_duplicates(df).collect()}
    assert {tuple(r) for r in near_dups.near_duplicates(named.union(named.limit(1))).collect()} == want
    following = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    assert {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(named, "doc_id", ["text"]).collect()} == {f"d{k:08d}": v for k, v in following.items()}
    assert columns.numbered(named.limit(0), "doc_id")[0].count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, docs, name):
    """Texts of 2 MB and more, with blanks and without, beside others: whole results, and no other row changes."""
    few = docs.head(12)
    df = spark.createDataFrame(few[["doc_id", "text", "lang", "source"]])
    long = [(10**6, "word and other words here " * 90_000, "en", "s"), (10**6 + 1, "x" * 2_000_000, "en", "s"), (10**6 + 2, " \n" * 1_000_000, None, None)]
    both = df.union(spark.createDataFrame(long, df.schema))
    rows = OPERATORS[name](both, spark).collect()
    assert len(rows) == 15
    by = {r[0]: r for r in rows}
    if name == "op1":
        assert by[10**6]["n_tokens"] == 90_000 * token_count.merger(WORD).count("word and other words here") and by[10**6 + 2]["n_tokens"] == 0
    if name == "op2":
        assert (by[10**6]["n_words"], by[10**6]["n_repeat_words"], by[10**6 + 1]["n_words"]) == (450_000, 450_000, 1)
    if name == "op3":
        assert (by[10**6]["n_tokens"], by[10**6 + 2]["n_tokens"]) == (450_001, 1)
    if name == "op4":
        assert [len(by[10**6 + i]["rest"]) for i in range(3)] == [0, 0, 0]
    if name == "op8":
        assert [by[10**6 + i]["n_shingles"] for i in range(3)] == [5, 1, 0]
    if name == "op10":
        assert bytes(by[10**6]["decoded"]) == long[0][1].encode()


def test_components_are_exact(spark):
    links = [(i + 1, i) for i in range(60)] + [(200, 100), (200, 150), (151, 150), (7, 300)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in [*range(1, 61), 300]} | {200: 100, 150: 100, 151: 100}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_op7_with_all_columns(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(mixing.OP7_SQL).df()
    got = mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert got[key].sort_values(key, ignore_index=True).equals(want[key].astype(got[key].dtypes).sort_values(key, ignore_index=True))
