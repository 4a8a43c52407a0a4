"""Language of web pages by fusing evidence: the text, the declared markup language, the address suffix and the host.

The text's likelihoods come from a naive Bayes model over character trigrams. What a declaration or a suffix says about
the language, and what language a host tends to have, is counted over all pages: the pages' posteriors by text alone are
summed by declaration, by suffix, by domain and by host, each smoothed with the level above it and without the page's
own share. The posterior is the product of the text's likelihood, the host's prior and the ratios that declaration and
suffix add.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_sample, written
from .html_extract import blocks

#: Buckets of trigrams. Share of a text's log-likelihood that counts, since its trigrams are not independent; trigrams
#: beyond which a longer text counts no more.
BUCKETS, TEMPER, ENOUGH = 1 << 16, 0.3, 300
#: Pages' worth of the level above that smooths a host, a domain, a suffix and a declaration.
SMOOTH = 5.0
LETTERS = re.compile(r"[\W\d_]+")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the letters and spaces of a whole text."""
    points = np.frombuffer(f" {LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, dtype=np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


@dataclass
class TextModel:
    """Languages, in order, and log-probabilities of trigrams (a row each)."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, text: str, enough: int = ENOUGH) -> np.ndarray:
        grams = trigrams(text)
        if not len(grams):
            return np.zeros(len(self.languages))
        return self.table[:, grams].sum(axis=1) * TEMPER * min(1.0, enough / len(grams))


def fit_text_model(rows: list[tuple[str, str]]) -> TextModel | None:
    """Model from (language, text) rows; None without any."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    counts = np.full((len(languages), BUCKETS), 0.05)
    for lang, text in rows:
        np.add.at(counts[languages.index(lang)], trigrams(text), 1.0)
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def training_rows(docs: DataFrame, sample: int, longest: int, lang_column: str = "lang", text_column: str = "text") -> list[tuple[str, str]]:
    """At most ``sample`` documents with a language and at most ``longest`` characters: those with the least hash."""
    some = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") <= longest))
    return [(r["lang"], r["text"]) for r in text_sample(some, sample)]


def identify_languages(pages: DataFrame, model: TextModel | None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", enough: int = ENOUGH) -> DataFrame:
    """Per page: url, lang, confidence (its posterior), text_lang (by text alone), declared, suffix.

    A null or empty html has even likelihoods, so host, declaration and suffix decide; a null url, or one without host,
    has an empty host and suffix and shares them with the other such pages. Without a model lang is null. All trigrams of
    a text are read; beyond ``enough`` of them the sum is scaled down to that many, so that a long text's likelihoods do
    not silence the other evidence. Ids may be
    null or repeated and rows keep their multiplicity; other columns are ignored. Pages are parsed once into narrow rows
    in the shared folder; sums by host, domain, suffix and declaration are combined before they are shuffled.
    """
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"), host.alias("host"))
    names = model.languages if model else ["und"]

    def read(batches):
        for batch in batches:
            texts, declared = [], []
            for html in batch["html"].to_pylist():
                html = html or ""
                found = DECLARED.search(html)
                declared.append(found[1].lower() if found else "")
                lines = blocks(html)
                main = [x for x, is_main, frame in lines if is_main and not frame] or [x for x, _, frame in lines if not frame]
                texts.append(" ".join(main))
            scores = [model.likelihoods(t, enough) if model else np.zeros(1) for t in texts]
            yield {**{k: batch[k] for k in ("id", "url", "host")}, "declared": declared, "scores": [s - s.max() for s in scores]}

    narrow = map_rows(keyed, read, "id bigint, url string, host string, declared string, scores array<double>", slice_rows=128)
    narrow = narrow.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*\.?[^.]*)$", 1))
    narrow = written(narrow, "languages")

    size, each = len(names), range(len(names))
    at = lambda c, i: F.element_at(c, i + 1)
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    norm = total([F.exp(at("scores", i)) for i in each])
    shares = narrow.withColumns({f"t{i}": F.exp(at("scores", i)) / norm for i in each})

    def summed(keys: list[str], prefix: str) -> DataFrame:
        return shares.groupBy(*keys).agg(*[F.sum(f"t{i}").alias(f"{prefix}{i}") for i in each])

    # no join is on null: host, domain, suffix and declaration are never null
    wide = shares
    everything = summed([], "g").first()
    overall = [float(everything[f"g{i}"] or 0.0) for i in each]
    for key, prefix in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m")):
        wide = wide.join(summed([key], prefix), key)

    def without(prefix: str, i: int) -> Column:
        """Sum of the other pages of the page's group."""
        return F.greatest(F.col(f"{prefix}{i}") - F.col(f"t{i}"), F.lit(0.0))

    n = sum(overall)
    base = [F.lit((overall[i] + 1.0) / (n + size)) for i in each]

    def smoothed(prefix: str, above: list[Column]) -> list[Column]:
        count = total([without(prefix, i) for i in each])
        return [(without(prefix, i) + F.lit(SMOOTH) * above[i]) / (count + F.lit(SMOOTH)) for i in each]

    wide = wide.withColumns({f"ps{i}": c for i, c in enumerate(smoothed("s", base))})
    wide = wide.withColumns({f"pd{i}": c for i, c in enumerate(smoothed("d", [F.col(f"ps{i}") for i in each]))})
    wide = wide.withColumns({f"ph{i}": c for i, c in enumerate(smoothed("h", [F.col(f"pd{i}") for i in each]))})
    wide = wide.withColumns({f"pm{i}": c for i, c in enumerate(smoothed("m", base))})
    # the suffix is part of the host's prior; the declaration adds its ratio to what all pages have
    wide = wide.withColumns({f"z{i}": at("scores", i) + F.log(f"ph{i}") + F.when(F.col("declared") != "", F.log(f"pm{i}") - F.log(base[i])).otherwise(F.lit(0.0)) for i in each})
    top = F.greatest(*[F.col(f"z{i}") for i in each]) if size > 1 else F.col("z0")
    wide = wide.withColumn("norm", total([F.exp(F.col(f"z{i}") - top) for i in each])).withColumn("top", top)
    pick = lambda prefix, best: F.coalesce(*[F.when(F.col(f"{prefix}{i}") >= best, F.lit(names[i])) for i in each])
    text_top = F.greatest(*[F.col(f"t{i}") for i in each]) if size > 1 else F.col("t0")
    known = model is not None
    return wide.select(
        F.col("id").alias(id_column),
        F.col("url").alias(url_column),
        (pick("z", F.col("top")) if known else F.lit(None).cast("string")).alias("lang"),
        (F.lit(1.0) / F.col("norm")).alias("confidence"),
        (pick("t", text_top) if known else F.lit(None).cast("string")).alias("text_lang"),
        "declared",
        "suffix",
    )


def language_id(pages: DataFrame, docs: DataFrame, sample: int = 4000, longest: int = 10_000, enough: int = ENOUGH) -> DataFrame:
    """Fit the text model on labelled documents, fuse the evidence of all pages."""
    return identify_languages(pages, fit_text_model(training_rows(docs, sample, longest)), enough=enough)
