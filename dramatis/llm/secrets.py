"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Method: two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are trained on labelled samples: random strings of a seeded generator over the
alphabets that keys are written in, and identifiers put together from the words of the corpus. A
run of key characters of CANDIDATE or more, or what pattern matches leave of it, is a secret if the
ratio is above MARGIN per character. If it is not, its best-scoring stretches of CANDIDATE or more are, each as far as
the separators around it, so that a name or path beside a key does not hide it. Every text is scanned whole.

Training reads the words of at most TRAINING_DOCS documents, those least by hash of their id (where ids repeat, one row of each, of least text); that
bound is the parameter ``training_docs``. Of their distinct words (about 85,000 in 2,000 documents of sf0.1) at most TRAINING_WORDS,
those least by hash, are used; that bound is the parameter ``most_words``.

Defined results: a null text counts as empty and has no span. Repeated rows are scanned alike. An
empty table gives an empty result (the models then rest on built-in words). ``redacted`` keeps
all columns, and a null text stays null.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dramatis.llm.common import ID, TEXT, drawn, mapped, table, text_batches

# The patterns of the contract, in its order, with the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Least length of a candidate of the models, and the mean log-likelihood ratio per character above which it is one.
CANDIDATE, MARGIN = 20, 0.8
SEPARATORS = "=/_-"
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
TRAINING_DOCS, TRAINING_WORDS, SEED = 2000, 20_000, 11
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Identifiers of which any corpus may have some.
BUILT_IN = "get user name list index count value first last table column number string buffer default request response handler error message configuration".split()


def training_words(docs: DataFrame, training_docs: int = TRAINING_DOCS, id_col: str = ID, text_col: str = TEXT, most_words: int = TRAINING_WORDS) -> list[str]:
    """At most ``most_words`` distinct words of letters of a bounded sample of documents, in order."""
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    ids = [r.id for r in slim.where(drawn(F.col("id"), training_docs, F.lit(slim.count()))).orderBy(F.xxhash64("id"), "id").limit(training_docs).collect()]
    sample = docs.where(F.col(id_col).isin(ids)).groupBy(F.col(id_col)).agg(F.min(text_col).alias("text"))
    words = sample.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,14}"), 0)).alias("w")).select(F.lower("w").alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(most_words)
    return [r.w for r in words.collect()]


def labelled_samples(words: list[str], each: int = 6000) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers)."""
    rng = random.Random(SEED)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", LETTERS[:62], LETTERS[:62], LETTERS[:64], LETTERS[26:62]]
    strings = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 44))) for _ in range(each)]
    words = words + BUILT_IN * max(1, len(words) // 200)
    forms = ["".join, "_".join, "-".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), lambda w: "".join(w) + str(rng.randint(0, 99)), lambda w: "=" * rng.randint(20, 40), lambda w: rng.choice("-_") * rng.randint(20, 60), lambda w: str(rng.randint(0, 10**9)) + "-" + str(rng.randint(0, 10**9))]
    weights = [6, 6, 4, 2, 4, 2, 2, 0.2, 0.2, 0.5]
    identifiers = [rng.choices(forms, weights)[0](rng.choices(words, k=rng.randint(2, 6))) for _ in range(each)]
    return strings, identifiers


class Models:
    """Log-likelihood ratio of random strings to ordinary identifiers, by pair of characters."""

    def __init__(self, strings: list[str], identifiers: list[str]):
        self.code = {c: i for i, c in enumerate(LETTERS)}
        self.ratio = self.logs(strings) - self.logs(identifiers)

    def logs(self, samples: list[str]) -> np.ndarray:
        """Row 0 stands for the start."""
        counts = np.full((len(LETTERS) + 1, len(LETTERS)), 0.5)
        for s in samples:
            at = 0
            for c in s:
                i = self.code[c]
                counts[at, i] += 1
                at = i + 1
        return np.log(counts / counts.sum(1, keepdims=True))

    def ratios(self, run: str) -> np.ndarray:
        """Of each character after the one before it."""
        codes = np.fromiter((self.code[c] for c in run), np.int64, len(run))
        return self.ratio[np.concatenate([[0], codes[:-1] + 1]), codes]

    def score(self, run: str) -> float:
        return float(self.ratios(run).sum()) / len(run)

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the random parts of a run: all of it, or its best-scoring stretches of CANDIDATE characters or more, up to the next separators."""
        if self.score(run) > MARGIN:
            return [(0, len(run))]
        total = np.concatenate([[0.0], np.cumsum(self.ratios(run) - MARGIN)])
        found, parts = [], [(0, len(run))]
        while parts:
            start, end = parts.pop()
            if end - start < CANDIDATE:
                continue
            own = total[start : end + 1]
            gain = own[CANDIDATE:] - np.minimum.accumulate(own[: len(own) - CANDIDATE])
            last = int(gain.argmax())
            if gain[last] <= 0:
                continue
            a, b = start + int(own[: last + 1].argmin()), start + last + CANDIDATE
            while a > start and run[a - 1] not in SEPARATORS:
                a -= 1
            while b < end and run[b] not in SEPARATORS:
                b += 1
            found.append((a, b))
            parts += [(start, a), (b, end)]
        return found


def find_spans(text: str, models: Models) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all secrets of a text, ordered; offsets count code points."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if max(map(len, text.split()), default=0) >= CANDIDATE:
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        covered, k = joined(found), 0
        for m in RUN.finditer(text):
            at, end = m.span()
            while k < len(covered) and covered[k][1] <= at:
                k += 1
            while at < end:
                s, e = covered[k] if k < len(covered) and covered[k][0] < end else (end, end)
                if s - at >= CANDIDATE:
                    found += [(at + a, 3, at + b) for a, b in models.stretches(text[at:s])]
                at = e
                if at < end:
                    k += 1
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans cover, as ordered stretches that do not touch."""
    out: list[tuple[int, int]] = []
    for start, _, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def trained(docs: DataFrame, training_docs: int = TRAINING_DOCS, id_col: str = ID, text_col: str = TEXT, most_words: int = TRAINING_WORDS) -> Models:
    return Models(*labelled_samples(training_words(docs, training_docs, id_col, text_col, most_words)))


def scan(docs: DataFrame, models: Models, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per document: counts by pattern, digest of the pattern spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1):
                found = find_spans(text.as_py() or "", models)
                base = [x for x in found if x[1] < 3]
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with each maximal run of spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, models: Models, text_col: str = TEXT, length_col: str = "n_chars") -> DataFrame:
    """The documents with secrets replaced, and ``length_col``, if there is one, brought up to date."""

    text_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return mapped(texts, lambda t: t and redact(t, find_spans(t, models)), pa.string())

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, trained(docs))
