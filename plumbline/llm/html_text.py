"""Main text of web pages, by their structure and by what the pages of a host repeat.

A page is cut into blocks, each inside an article (or main) element, inside an element that is no main text by its name,
role or class, or neither. The token streams of all pages of a host, but for their articles, are concatenated, and a
suffix array over them, with the lengths that neighbours share, gives for each place the longest string that another page
has too. A block that is in no article and not known by its element is dropped if such strings of `run` tokens or more
cover half of it, whether the page has an article or not. A block shorter than that, beside an article, is also dropped
if distinct pages have it; on pages without an article it can be a cell or a heading of the main text. Blocks of an article stay even if other pages have the same ones: pages that quote or copy
each other share long passages which are no boilerplate.

A large host is cut into groups of pages by a hash of page and URL, so that no group is unbounded, not even one of copies. Each group has its suffix
array; runs of open blocks that are found again only in other groups come from a count over the host: hashed runs with
hashes of their pages, of all hosts of several groups that have an open block, are shuffled by run, and those of distinct
pages are sent to the groups whose blocks they may decide. So results don't depend on the size of a group. Runs and pages
are told apart there by 64-bit hashes.

Null and empty pages have an empty text. Pages without a host (or without a URL) are a host. Malformed markup is read as
far as it goes: unclosed elements end with their parent, a script ends at its end tag only, a quoted value of any length
ends at its quote. Repeated rows each have
their result, and don't count as distinct pages. An empty table gives an empty result. Columns of the input stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import OTHERS, apart
from plumbline.llm.common import documents, mix64, small_batches, stored, text_slices

MAIN, ASIDE, OPEN = "main", "aside", "open"
#: Elements whose content is no text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "title", "xmp"}
#: Elements that are no part of an article, wherever they stand.
NO_TEXT = {"nav", "footer", "aside", "form", "head", "button", "select", "option", "dialog", "menu", "label", "input", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog", "toolbar", "tablist"}
#: Parts of class names and ids of what is no part of an article.
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related "
    "recommended recommendations share sharing social comment comments respond reply replies disqus footer masthead toolbar pagination pager login search".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Distinct pages that make a string a repeated one.
PAGES = 2
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A comment, a tag or a declaration. A value's quote, which stands after "=" only, is looked for to the end of the page; a
#: quote that is never closed is a character as any other. Repeats are possessive: each is read once.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class HostRepeats:
    run: int = 4  # tokens of a repeated string, at least
    covered: float = 0.5  # of a block that is dropped
    group: int = 500  # pages of a suffix array, about
    broadcast: int = 100_000  # hosts of more pages than that whose table is broadcast, at most


def _is_aside(name: str, attributes: str, zone: str) -> bool:
    if name in NO_TEXT or name == "header" and zone != MAIN:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id"):
            parts = PART.findall(value)
            if not NAMES.isdisjoint(parts) or "header" in parts and zone != MAIN:
                return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, zone) of each block that has text, in page order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # elements that hold others, with the zone inside
    zone, parts, at, last = OPEN, [], 0, page.rfind(">")

    def close():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, zone))

    while True:
        m = TAG.search(page, at, last + 1)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCKS:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name not in BLOCKS:
                    break
            zone = stack[-1][1] if stack else OPEN
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if not end:
                break
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        aside = _is_aside(name, m[3], zone)
        if name not in BLOCKS and not aside:
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()
            zone = stack[-1][1] if stack else OPEN
        inside = ASIDE if aside or zone == ASIDE else MAIN if name in ("article", "main") else zone
        if inside != zone:
            close()
        stack.append((name, inside))
        zone = inside
    close()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many tokens each shares with the one before it (0 for the first).

    By prefix doubling: ranks by 1, 2, 4, ... tokens until all differ. Ranks of neighbours, from the longest prefixes to the
    shortest, give the length that they share. The last token must be one of its own."""
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1]]
    have = 1
    while have < n and ranks[-1].max() < n - 1:
        r = ranks[-1]
        after = np.zeros(n, np.int64)
        after[:-have] = r[have:] + 1
        ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1])
        have *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = np.flatnonzero(fits)
        same = same[ranks[level][a[same]] == ranks[level][b[same]]]
        shared[same + 1] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, shared


def longest_elsewhere(order: np.ndarray, shared: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each place in the order, the longest string that begins there and, at another place, in another page.

    It is shared with the next suffix of another page on either side: the least of what neighbours share on the way."""
    n = len(order)
    p = page[order]
    new = np.append(True, p[1:] != p[:-1])

    def before(shared: np.ndarray, new: np.ndarray) -> np.ndarray:
        part = np.cumsum(new)  # suffixes of one page that stand together
        step = np.int64(n + 1)
        return np.minimum.accumulate(shared - part * step) + part * step

    back = before(shared, new)
    after = np.append(shared[1:], 0)[::-1]
    ahead = before(after, np.append(True, (p[1:] != p[:-1])[::-1]))[::-1]
    return np.maximum(back, ahead)


def shared_runs(streams: list[list[str]], how: HostRepeats) -> list[np.ndarray]:
    """For each page's tokens, which are covered by a string of `run` tokens or more that another page has."""
    lengths = np.array([len(s) for s in streams], np.int64)
    ids: dict[str, int] = {}
    each = [np.fromiter((ids.setdefault(t, len(ids)) for t in s), np.int64, len(s)) for s in streams]
    # a token of its own after each page: no string goes over a page's end
    tokens = np.concatenate([x for i, s in enumerate(each) for x in (s, [len(ids) + i])]) if each else np.zeros(0, np.int64)
    if not len(ids):
        return [np.zeros(0, bool) for _ in streams]
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    order, shared = suffix_array(tokens)
    reach = longest_elsewhere(order, shared, page)
    long = reach >= how.run
    covered = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(covered, order[long], 1)
    np.add.at(covered, order[long] + reach[long], -1)
    hit = np.cumsum(covered)[:-1] > 0
    ends = np.cumsum(lengths + 1)
    return [hit[e - 1 - k : e - 1] for e, k in zip(ends.tolist(), lengths.tolist())]


def run_hashes(tokens: list[str], k: int, host: str) -> np.ndarray:
    """Hashes of the host's runs of k tokens, in order; of all tokens, where there are fewer."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, xxhash.xxh3_64_intdigest(host, k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out + h[j : j + n])
    return out


def page_runs(found: list[tuple[str, str]], k: int, host: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs, and short blocks, of a page's stream outside of articles; which of them have a token of an open block."""
    outside = [(text.split(), zone == OPEN) for text, zone in found if zone != MAIN]
    tokens = [t for words, _ in outside for t in words]
    hashes, asks = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    if len(tokens) >= k:
        opened = np.cumsum([0, *(o for words, o in outside for _ in words)])
        hashes.append(run_hashes(tokens, k, host))
        asks.append(opened[k:] > opened[:-k])
    for words, o in outside:
        if len(words) < k:
            hashes.append(run_hashes(words, k, host))
            asks.append(np.array([o]))
    runs, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return runs, np.bincount(at, np.concatenate(asks), len(runs)) > 0


def main_texts(pages: list[str], how: HostRepeats, known: np.ndarray | None = None, host: str = "") -> list[str]:
    """Main texts of the pages of a host, or of a group of them; known: hashes of runs that distinct pages of the host share."""
    cut = [blocks(p) for p in pages]
    distinct: dict[str, int] = {}
    which = [distinct.setdefault(p, len(distinct)) for p in pages]
    firsts = [which.index(i) for i in range(len(distinct))] if len(distinct) < len(pages) else list(range(len(pages)))
    runs = shared_runs([[t for text, zone in cut[i] if zone != MAIN for t in text.split()] for i in firsts], how)
    short = Counter(text for i in firsts for text in {text for text, zone in cut[i] if zone != MAIN and len(text.split()) < how.run})
    if known is not None and len(known):
        for j, i in enumerate(firsts):
            outside = [text.split() for text, zone in cut[i] if zone != MAIN]
            tokens = [t for words in outside for t in words]
            if len(tokens) >= how.run:
                for at in np.flatnonzero(np.isin(run_hashes(tokens, how.run, host), known)):
                    runs[j][at : at + how.run] = True
            for words in outside:
                if len(words) < how.run and np.isin(run_hashes(words, how.run, host), known)[0]:
                    short[" ".join(words)] = PAGES
    out = []
    for i, found in enumerate(cut):
        hit, at, kept = runs[which[i]], 0, []
        has_main = any(zone == MAIN for _, zone in found)
        for text, zone in found:
            if zone == MAIN:
                kept.append(text)
                continue
            n = len(text.split())
            repeated = hit[at : at + n].sum() >= how.covered * n or has_main and n < how.run and short[text] >= PAGES
            at += n
            if zone == OPEN and not repeated:
                kept.append(text)
        out.append("\n".join(kept))
    return out


def main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text", how: HostRepeats = HostRepeats()) -> DataFrame:
    """pages without the markup, with the main text."""
    own, names, back = apart(pages, [url, page])
    return back(_main_text(own, *names, how), [F.col("_text").alias(out)], [page])


def _main_text(pages: DataFrame, url: str, page: str, how: HostRepeats) -> DataFrame:
    kept, out = [url, OTHERS], "_text"
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    keyed = small_batches(pages).select(*kept, F.coalesce(F.col(page), F.lit("")).alias("_html"), F.col(url).alias("_url"), host.alias("_host"))
    large = keyed.groupBy(F.col("_host").alias("_h")).agg(F.ceil(F.count("*") / how.group).cast("int").alias("_groups")).where("_groups > 1")
    large = stored(large, "large-hosts")
    # one row for each host of many pages: broadcast while they are few, so that pages are shuffled once, by group
    few = large.limit(how.broadcast + 1).count() <= how.broadcast
    near = F.broadcast if few else lambda hosts: hosts
    group = F.pmod(F.xxhash64("_html", "_url"), F.coalesce("_groups", F.lit(1))).alias("_group")
    split = keyed.select("_host", "_html", "_url").join(near(large), F.col("_host") == F.col("_h"))

    @F.arrow_udf("boolean")
    def has_open(htmls: pa.Array) -> pa.Array:
        return pa.array([any(zone == OPEN for _, zone in blocks(p.as_py())) for p in htmls], pa.bool_())

    asking = stored(split.where(has_open("_html")).select(F.col("_host").alias("_a")).distinct(), "open-hosts")

    def runs(batches):
        for batch in batches:
            for first, htmls in text_slices(batch.column(3), 1 << 20):
                hosts = batch.column(0).slice(first, len(htmls)).to_pylist()
                found = [page_runs(blocks(p.decode()), how.run, h) for p, h in zip(htmls, hosts)]
                at = np.repeat(np.arange(first, first + len(htmls)), [len(r) for r, _ in found])
                if not len(at):
                    continue
                asks = pa.array(np.concatenate([a for _, a in found]))
                hosts, groups, pages = (batch.column(i).take(pa.array(at)) for i in range(3))
                run = pa.array(np.concatenate([r for r, _ in found]).view(np.int64))
                columns = [run, pages, pc.if_else(asks, hosts, pa.scalar(None, pa.string())), pc.if_else(asks, groups, pa.scalar(None, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["_run", "_page", "_h", "_g"])

    asked = split.join(near(asking), F.col("_host") == F.col("_a"), "left_semi").select("_host", group, F.xxhash64("_html").alias("_page"), "_html")
    asked = asked.mapInArrow(runs, "_run long, _page long, _h string, _g long")
    # a run is repeated if two of its pages differ; its groups are as many as its host has, at most
    asks = F.collect_set(F.when(F.col("_h").isNotNull(), F.struct("_h", "_g")))
    asked = asked.groupBy("_run").agg(F.min("_page").alias("_first"), F.max("_page").alias("_last"), asks.alias("_asks")).where("_first <> _last")
    asked = asked.select("_run", F.explode("_asks").alias("_a")).groupBy("_a._h", "_a._g").agg(F.collect_list("_run").alias("_runs"))

    keyed = keyed.join(near(large), F.col("_host") == F.col("_h"), "left").select(*kept, "_html", "_host", group)
    schema = keyed.select(*kept).schema.add(out, "string")

    def extract(table: pa.Table, runs: pa.Table) -> pa.Table:
        known = np.array(runs["_runs"][0].as_py(), np.int64).view(np.uint64) if len(runs) else None
        texts = main_texts(table["_html"].to_pylist(), how, known, table["_host"][0].as_py())
        return table.select(kept).append_column(out, pa.array(texts, pa.string()))

    return keyed.groupBy("_host", "_group").cogroup(asked.groupBy("_h", "_g")).applyInArrow(extract, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
