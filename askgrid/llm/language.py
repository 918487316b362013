"""Language identification by Bayesian fusion of independent evidence.

log posterior = tempered text log likelihood + log P(declared markup language | language)
+ log P(address suffix | language) + log host prior.

Text likelihoods are hashed byte-trigram multinomials, fitted on a bounded sample of distinct texts of
each labelled language (``SAMPLE_ROWS``, in hash order); region and script of a language code don't
count, and labels that are no codes (``German``) are names of their own. Host priors are counts of the text's best
language by host, smoothed towards the counts of the host's domain, and those towards the whole
corpus: three grouped aggregations over all rows. Host priors reach the rows by a broadcast
while there are at most ``BROADCAST_HOSTS`` hosts, and by a shuffled join beyond.

Each text is scored once: the evidence is written down with the columns that are kept, and both
the priors and the fusion read that table.

Defined results: null, blank or letterless text has no language (``und``), posterior 0 and isn't
kept; a null host or address has the domain's or the corpus's prior; ties go to the first language
by name; rows repeated whole have equal results; an empty table gives an empty result. Added
columns are language, posterior and kept, with ``ag_`` in front where the input has a column of
that name, which stays as it is; inner columns begin with ``_ag_``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm import textcore
from askgrid.llm.workspace import forget, free_name, lean_batches, written

BUCKETS, SAMPLE_ROWS, PARTS = 1 << 15, 4000, 4
BROADCAST_HOSTS = 500_000
#: Labelled languages that a model holds at most, and hashes of chosen texts that are broadcast; more are joined by a shuffle.
MOST_LANGUAGES, BROADCAST_TEXTS = 300, 500_000
#: Trigrams are far from independent: a text counts as so many at most.
EFFECTIVE = 60.0
#: Chance that a declared language or an address suffix speaks for the language it names.
DECLARED, SUFFIX = 0.9, 0.8
#: Documents of pseudo-count that a host takes from its domain, and a domain from the corpus.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
LEAST_POSTERIOR = 0.5
#: Country suffixes by language.
SUFFIXES = {
    "de": ["de", "at"],
    "en": ["uk", "us", "au", "nz", "ie"],
    "es": ["es", "mx", "ar", "cl", "co", "pe"],
    "fr": ["fr"],
    "it": ["it"],
    "nl": ["nl"],
    "pt": ["pt", "br"],
    "vi": ["vn"],
}
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_TAG = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text's letters, all else being one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    letter = _LETTER[raw] if len(raw) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64)
    body = np.where(letter, raw, np.uint8(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    body = np.concatenate([[np.uint8(32)], body[keep], [np.uint8(32)]]).astype(np.uint32)
    code = (body[:-2] << np.uint32(16)) | (body[1:-1] << np.uint32(8)) | body[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def plain(text: str) -> str:
    """Text without markup."""
    return _TAG.sub(" ", text)


@dataclass(frozen=True)
class Likelihoods:
    languages: tuple[str, ...]
    log_share: np.ndarray  # languages x BUCKETS

    def of(self, text: str) -> list[float] | None:
        """Tempered log likelihood by language; None without letters."""
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return None
        return (self.log_share[:, grams].mean(axis=1) * min(len(grams), EFFECTIVE)).tolist()


def _label(lang: Column) -> Column:
    """The language that a label names: of a code, what stands before its region or script (zh of zh-CN), else the label."""
    said = F.lower(F.trim(lang.cast("string")))
    return F.regexp_replace(said, r"^([a-z]{2,3})[-_].*$", "$1")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Likelihoods:
    """Trigram multinomials from at most ``rows`` distinct texts of each labelled language.

    Any label with a letter counts, but for ``und``; ValueError where there are more than MOST_LANGUAGES.
    """
    lean_batches(docs.sparkSession)
    known = docs.select(F.col(text_col).cast("string").alias("text"), _label(F.col(lang_col)).alias("lang"))
    known = known.where(r"text is not null and lang rlike '\\p{L}' and lang <> 'und'").withColumn("h", F.xxhash64("text", "lang"))
    # The limit applies in each task before the shuffle too.
    order = Window.partitionBy("lang").orderBy("h")
    chosen = known.select("lang", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    chosen = written(chosen.select("lang", "h"), "chosen")
    if (named := chosen.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{named} languages are labelled, and at most {MOST_LANGUAGES} can be told apart")
    few = chosen.select("h")
    few = F.broadcast(few) if chosen.count() <= BROADCAST_TEXTS else few
    found = known.join(few, "h", "left_semi").dropDuplicates(["h"])
    counts: dict[str, np.ndarray] = {}
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))])

    def count(frames):
        own: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                own[lang] = own.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in own.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": [lang], "bucket": [at.astype(np.int32)], "n": [n[at]]})

    # A language's texts are in one of PARTS tasks each, so at most PARTS rows a language come back.
    parted = found.select("text", "lang", F.pmod("h", F.lit(PARTS)).alias("part")).repartition("lang", "part")
    for r in parted.select("text", "lang").mapInPandas(count, schema).toLocalIterator():
        own = counts.setdefault(r["lang"], np.zeros(BUCKETS))
        own[r["bucket"]] += r["n"]
    forget(chosen)
    languages = sorted(counts)
    smoothed = [np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS)) for x in languages]
    return Likelihoods(tuple(languages), np.array(smoothed).reshape(len(languages), BUCKETS))


def _text_evidence(model: Likelihoods, markup: bool):
    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        found = (t.as_py() for t in texts)
        scores = [None if t is None else model.of(plain(t) if markup else t) for t in found]
        textcore.release()
        return pa.array(scores, pa.list_(pa.float64()))

    return evidence


def _named(value: Column, languages: tuple[str, ...], names: dict[str, list[str]], strength: float) -> list[Column]:
    """Log likelihood, by language, of a value that names one or several languages; 0 where it names none."""
    every = [n for x in languages for n in names[x]]
    miss = float(np.log((1 - strength) / max(1, len(languages) - 1)))
    known = value.isin(every) if every else F.lit(False)
    return [F.when(known, F.when(value.isin(names[x]) if names[x] else F.lit(False), float(np.log(strength))).otherwise(miss)).otherwise(0.0) for x in languages]


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def identify(docs: DataFrame, model: Likelihoods, text_col: str = "text", host: Column | None = None, declared: Column | None = None, markup: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or their columns ``keep``, with language, posterior and kept; host and declared are expressions over its columns."""
    lean_batches(docs.sparkSession)
    languages, keep = model.languages, docs.columns if keep is None else keep
    added = [free_name(keep, c) for c in ("language", "posterior", "kept")]
    own = [F.col(f"`{c}`") for c in keep]
    host = (F.lit(None) if host is None else host).cast("string")
    declared = (F.lit(None) if declared is None else declared).cast("string")
    if not languages:
        return docs.select(*own, *[F.lit(v).alias(c) for v, c in zip(("und", 0.0, False), added)])
    text = F.col(text_col).cast("string")
    best = lambda scores: F.array_position(scores, F.array_max(scores)) - 1  # noqa: E731  ties to the first by name
    scored = written(docs.select(*own, host.alias("_ag_host"), declared.alias("_ag_said"), _text_evidence(model, markup)(text).alias("_ag_text")), "evidence")
    seen = scored.select("_ag_host", "_ag_text").where("_ag_text is not null")
    votes = [F.count_if(F.col("_ag_best") == k).alias(f"_ag_v{k}") for k in range(len(languages))]
    # Pre-aggregated by host in each task, so a host with a third of all rows is one row a task.
    hosts = seen.select("_ag_host", best(F.col("_ag_text")).alias("_ag_best")).groupBy("_ag_host").agg(*votes)
    hosts = written(hosts, "hosts")
    sums = lambda p: [F.sum(f"_ag_v{k}").alias(f"{p}{k}") for k in range(len(languages))]
    whole = hosts.agg(*sums("w")).first()
    total = sum(whole[k] or 0 for k in range(len(languages)))
    share = [((whole[k] or 0) + 1) / (total + len(languages)) for k in range(len(languages))]
    named = hosts.where("_ag_host is not null").withColumn("_ag_domain", domain_of(F.col("_ag_host")))
    domains = named.groupBy("_ag_domain").agg(*sums("_ag_d"))
    near = named.join(domains, "_ag_domain")
    in_host = sum((F.col(f"_ag_v{k}") for k in range(1, len(languages))), F.col("_ag_v0"))
    in_domain = sum((F.col(f"_ag_d{k}") for k in range(1, len(languages))), F.col("_ag_d0"))
    prior = []
    for k in range(len(languages)):
        wider = (F.col(f"_ag_d{k}") + DOMAIN_WEIGHT * share[k]) / (in_domain + DOMAIN_WEIGHT)
        prior.append(F.log((F.col(f"_ag_v{k}") + HOST_WEIGHT * wider) / (in_host + HOST_WEIGHT)))
    priors = near.select("_ag_host", F.array(*prior).alias("_ag_prior"))
    priors = F.broadcast(priors) if named.count() <= BROADCAST_HOSTS else priors

    rows = scored.join(priors, "_ag_host", "left")
    names = {x: [x] for x in languages}
    said = _named(F.lower(F.substring_index(F.substring_index(F.col("_ag_said"), "-", 1), "_", 1)), languages, names, DECLARED)
    suffix = _named(F.lower(F.substring_index(F.col("_ag_host"), ".", -1)), languages, {x: SUFFIXES.get(x, []) for x in languages}, SUFFIX)
    scores = [F.col("_ag_text")[k] + F.coalesce(F.col("_ag_prior")[k], F.lit(float(np.log(share[k])))) + said[k] + suffix[k] for k in range(len(languages))]
    rows = rows.withColumn("_ag_scores", F.when(F.col("_ag_text").isNotNull(), F.array(*scores)))
    top = F.array_max("_ag_scores")
    mass = F.aggregate(F.transform("_ag_scores", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    language = F.lit("und")
    for k, name in reversed(list(enumerate(languages))):  # ties to the first by name
        language = F.when(F.col("_ag_scores")[k] == top, name).otherwise(language)
    rows = rows.withColumns({"_ag_language": language, "_ag_posterior": F.coalesce(1 / mass, F.lit(0.0))})
    kept = (F.col("_ag_language") != "und") & (F.col("_ag_posterior") >= LEAST_POSTERIOR)
    return rows.select(*own, *[v.alias(c) for v, c in zip((F.col("_ag_language"), F.col("_ag_posterior"), kept), added)])


def keep_known(docs: DataFrame, model: Likelihoods, **evidence) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with all their columns and no others."""
    kept = free_name(docs.columns, "kept")
    return identify(docs, model, **evidence).where(F.col(f"`{kept}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def page_host(url: Column) -> Column:
    """The lower-case host of an address, without user, port or a leading www."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def markup_language(html: Column) -> Column:
    """The language that the html tag declares."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", 1), F.lit(""))
