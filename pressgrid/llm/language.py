"""A page's language by Bayesian fusion of its text, its markup, its address and its host.

Character n-grams of labelled documents are counted for the text's likelihood.
What the markup declares and what the address's ending suggests are weighed by
how often each value goes with each language, smoothed towards all pages, and
hosts have priors smoothed towards their domain and then towards all pages; these
tables come from grouped sums of the pages' own text posteriors. A page's own
share is taken out of these sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.llm.buffers import LOWER, mixed, slices, text_bytes
from pressgrid.operators.lookup import lookup
from pressgrid.session import settle

BUCKETS = 1 << 14  # hashed n-grams; the model has this many numbers per language
WIDTHS = (2, 3, 4)
HELD = 64  # labels whose counts a task holds at a time
EVIDENCE_GRAMS = 40  # a longer text counts as so many independent n-grams
HOST_PAGES, DOMAIN_PAGES = 5.0, 20.0  # pages that a prior from above is worth
HINT_PAGES = 20.0  # pages that all pages are worth beside those with one declared value or ending
ODD = 1.0  # pages added to each language's sum over all pages
SCORED = 1024  # pages scored at a time
_TWO_PART = ["co", "com", "org", "net", "ac", "gov", "edu"]  # second-level endings under a country's


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of all widths that lie within one text, and each one's text."""
    data, offsets = text_bytes(column)
    low = LOWER[data].astype(np.uint64)
    low[(low < 32) | ((low >= 33) & (low < 65)) | ((low > 90) & (low < 97)) | ((low > 122) & (low < 128))] = 32
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams, owner = [], []
    for width in WIDTHS:
        n = len(low) - width + 1
        if n <= 0:
            continue
        code = np.full(n, width, np.uint64)
        for k in range(width):
            code = (code << np.uint64(8)) | low[k : n + k]
        inside = text[:n] == text[width - 1 :]
        grams.append((mixed(code) % np.uint64(BUCKETS)).astype(np.int32)[inside])
        owner.append(text[:n][inside])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owner)


def count_grams(docs: DataFrame, lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log shares of hashed n-grams, counted over all labelled documents (text, `lang`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in (p for b in batches for p in slices(b)):
            labels = batch.column("lang").dictionary_encode()
            grams, owner = _grams(batch.column("text"))
            code = labels.indices.to_numpy()[owner]
            own = labels.dictionary.to_pylist()
            for k in range(0, len(own), HELD):
                some = own[k : k + HELD]
                at = (code >= k) & (code < k + HELD)
                counts = np.bincount((code[at] - k) * BUCKETS + grams[at], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
                for name, row in zip(some, counts, strict=True):
                    totals[name] = totals.get(name, 0) + row
                if len(totals) > HELD:
                    yield _counts(totals)
                    totals = {}
        if totals:
            yield _counts(totals)

    def logs(table: pa.Table) -> pa.Table:
        counts = np.full(BUCKETS, 0.5)
        counts[table.column("gram").to_numpy()] += table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "logs": pa.array([np.log(counts / counts.sum()).astype(np.float32).tobytes()], pa.binary())})

    known = docs.filter(f"{lang} is not null and text is not null").select("text", F.lower(F.trim(F.col(lang).cast("string"))).alias("lang"))
    got = (
        known.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .groupBy("lang").applyInArrow(logs, "lang string, logs binary").toArrow()  # 64 KB a label
    )
    tables = dict(zip(got.column("lang").to_pylist(), got.column("logs").to_pylist(), strict=True))
    names = sorted(tables)
    return names, np.frombuffer(b"".join(tables[x] for x in names), np.float32).reshape(len(names), BUCKETS)


def _counts(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    some = {k: np.flatnonzero(v) for k, v in totals.items()}
    return pa.record_batch([
        pa.array([k for k, at in some.items() for _ in at], pa.string()),
        pa.array(np.concatenate(list(some.values())).astype(np.int32)),
        pa.array(np.concatenate([totals[k][at] for k, at in some.items()]).astype(np.int64))], ["lang", "gram", "n"])


def visible_text(html: Column) -> Column:
    """A page without scripts, styles, comments and tags; null stays null."""
    html = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(html, r"<[^>]*>", " ")


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without user, port and www; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def domain_of(host: Column) -> Column:
    """The last two labels of a host, or three under a country's second-level ending."""
    labels = F.split(host, r"\.")
    three = (F.size(labels) > 2) & F.element_at(labels, -2).isin(_TWO_PART) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(F.size(labels) < 2, host).otherwise(F.array_join(F.slice(labels, -F.when(three, 3).otherwise(2), 3), "."))


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _smoothed(sums: np.ndarray, above: np.ndarray, pages: float) -> np.ndarray:
    """Shares of languages, drawn towards those `above` as by so many pages."""
    return (sums + pages * above) / (sums.sum(axis=1, keepdims=True) + pages)


def page_languages(pages: DataFrame, names: list[str], shares: np.ndarray) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) per row of `pages` (page_id, url, html).

    `text_lang` is the choice by text alone, `lang` the choice of all evidence,
    `confidence` its posterior. A null or empty page has only its other evidence;
    an address without host shares the host ''. Ties go to the language that
    comes first by name. Without languages, lang is null and confidence 0. Rows
    are independent but for the sums; other columns are ignored.
    """
    n = len(names)
    narrow = pages.select(
        F.col("page_id"), host_of(F.col("url")).alias("host"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)).alias("declared"),
        visible_text(F.col("html")).alias("text"))
    if not n:
        return narrow.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"),
                             F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))
    kind = dict(pages.dtypes)["page_id"]

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            grams, owner = _grams(batch.column("text"))
            count = np.bincount(owner, minlength=len(batch)) if len(owner) else np.zeros(len(batch))
            weight = np.minimum(count, EVIDENCE_GRAMS) / np.maximum(count, 1)
            log = np.stack([np.bincount(owner, shares[k][grams], len(batch)) if len(owner) else np.zeros(len(batch)) for k in range(n)], axis=1)
            log *= weight[:, None]
            log -= log.max(axis=1, keepdims=True)
            log -= np.log(np.exp(log).sum(axis=1, keepdims=True))
            flat = pa.array(log.ravel())
            yield pa.record_batch([
                *(batch.column(c) for c in ("page_id", "host", "declared")),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(batch) + 1, n, dtype=np.int32)), flat)], ["page_id", "host", "declared", "log"])

    seen = settle(narrow.mapInArrow(likelihoods, f"page_id {kind}, host string, declared string, log array<double>"))

    def sums(rows: DataFrame, key: str, of: str, name: str) -> DataFrame:
        each = [F.exp(F.col(of)[k]) if of == "log" else F.col(of)[k] for k in range(n)]
        return rows.groupBy(key).agg(F.array(*[F.sum(x) for x in each]).alias(name))

    hosts = sums(seen, "host", "log", "h")
    hosts = settle(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": F.element_at(F.split("host", r"\."), -1)}))
    everywhere = np.array(hosts.agg(*[F.coalesce(F.sum(F.col("h")[k]), F.lit(0.0)) for k in range(n)]).first()) + ODD
    everywhere = everywhere / everywhere.sum()
    hosts = lookup(hosts.join(sums(hosts, "domain", "h", "d"), "domain"), settle(sums(hosts, "suffix", "h", "s")), "suffix")
    rows = seen.join(settle(hosts.select("host", "h", "d", "s")), "host")
    rows = lookup(rows, settle(sums(seen, "declared", "log", "v")), "declared")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = np.array(names, object)
        for batch in (b.slice(a, SCORED) for b in batches for a in range(0, len(b), SCORED)):
            log = _rows(batch.column("log"), n)
            h, d, s, v = (np.maximum(_rows(batch.column(c), n) - np.exp(log), 0) for c in "hdsv")
            prior = _smoothed(h, _smoothed(d, everywhere, DOMAIN_PAGES), HOST_PAGES)
            score = log + np.log(prior) + sum(np.log(_smoothed(x, everywhere, HINT_PAGES) / everywhere) for x in (s, v))
            sure = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.record_batch([
                *(batch.column(c) for c in ("page_id", "host", "declared")), pa.array(named[log.argmax(axis=1)], pa.string()),
                pa.array(named[score.argmax(axis=1)], pa.string()), pa.array(sure)],
                ["page_id", "host", "declared", "text_lang", "lang", "confidence"])

    return rows.select("page_id", "host", "declared", "log", "h", "d", "s", "v").mapInArrow(
        scored, f"page_id {kind}, host string, declared string, text_lang string, lang string, confidence double")
