"""Language identification by a byte convolutional network.

Method: texts are cut into windows of WINDOW bytes (the last one padded with zeros). Filters of several widths run
over the bytes of a window, each filter's largest response is kept, and a softmax layer gives the
probabilities. The network is trained in numpy, with Adam on the cross-entropy, on labelled text. The answer for a
text is the mean of the log-probabilities over all its windows, weighted by their bytes.

As an input byte selects a row of a filter's weights, a filter of width two is one look-up in a table over
byte pairs; wider ones are sums of such look-ups.

Training reads at most PER_LANGUAGE documents of each language, those least by hash of their id (where ids repeat, one row of each, of least text), and at most
PER_DOCUMENT windows of each, which are cut on the executors; both are parameters. Of the id only the split into training and held-out rows is
derived; language, source and id are no inputs.

``accepted``, the pipeline's first stage, drops `und` and answers of a score below LEAST_SCORE, a parameter.

Defined results: a null text, or one without a letter, is `und` with score 0. With no labelled row at all,
every text is `und`. A null id is not held out, nor trained on. Repeated rows get equal answers. Texts of
any length are read whole. Extra columns are ignored, and kept by ``accepted``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.llm.common import ID, TEXT, drawn, fresh_name, slices, table, text_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE, PER_DOCUMENT, EPOCHS, BATCH, RATE, SEED = 400, 3, 4, 64, 0.01, 3
#: Windows that are worked on at once.
AT_ONCE = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Below this mean probability the pipeline does not trust the answer.
LEAST_SCORE = 0.4


@dataclass
class Network:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        self.tables: dict[int, list[np.ndarray]] | None = None

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, tables over byte pairs (65,536 rows) and, for an odd width, a last one over bytes."""
        if self.tables is None:
            self.tables = {}
            for width, w in self.filters.items():
                pairs = [(w[k][:, None] + w[k + 1][None]).reshape(65536, -1) for k in range(0, width - 1, 2)]
                self.tables[width] = pairs + ([w[-1]] if width % 2 else [])
        return self.tables

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Per width, (windows, positions, filters) before the bias."""
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for width, tables in self.pair_tables().items():
            n = x.shape[1] - width + 1
            total = None
            for k, t in enumerate(tables):
                rows = pairs[:, 2 * k : 2 * k + n] if len(t) > 256 else x[:, 2 * k : 2 * k + n]
                part = np.take(t, rows, axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(total)
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([r.max(1) for r in self.responses(x)], 1) + self.bias
        logits = np.maximum(pooled, 0) @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, window)


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """A network from (window, language); None without samples."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for data, lang in samples:
        own = windows_of(data)[0]
        x.append(own)
        y.append(languages.index(lang))
        if rng.random() < 0.3:  # short texts occur as well
            cut = own.copy()
            cut[rng.integers(8, 128) :] = 0
            x.append(cut)
            y.append(languages.index(lang))
    x, y = np.stack(x), np.array(y)
    features, classes = FILTERS * len(WIDTHS), len(languages)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, {w: normal(0.3, w, 256, FILTERS) for w in WIDTHS}, np.zeros(features, np.float32), normal(0.2, features, classes), np.zeros(classes, np.float32))
    weights = [*net.filters.values(), net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            step += 1
            some = order[at : at + BATCH]
            grads = gradients(net, x[some], y[some])
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.tables = None
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, in the order of the weights. Only where a filter's response is largest does it get any."""
    rows, places, pooled = np.arange(len(x))[:, None], [], []
    for width, w in net.filters.items():
        n = x.shape[1] - width + 1
        r = sum(np.take(w[k], x[:, k : k + n], axis=0) for k in range(width))
        best = r.argmax(1)
        places.append(best)
        pooled.append(np.take_along_axis(r, best[:, None], 1)[:, 0])
    hidden = np.concatenate(pooled, 1) + net.bias
    active = np.maximum(hidden, 0)
    logits = active @ net.out + net.out_bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.out.T) * (hidden > 0)
    grads = []
    for (width, w), best, part in zip(net.filters.items(), places, np.split(back, len(net.filters), 1), strict=True):
        g = np.zeros_like(w)
        for k in range(width):
            np.add.at(g[k], (x[rows, best + k], np.arange(FILTERS)[None]), part)
        grads.append(g)
    return [*grads, back.sum(0), active.T @ p, p.sum(0)]


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cut_windows(text: Column, doc_id: Column, per_document: int) -> Column:
    """At most ``per_document`` windows of a binary column, evenly spread from a place that the id decides."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / WINDOW).cast("int"))
    taken = F.least(F.lit(per_document), n)
    place = lambda i: F.pmod(F.pmod(F.xxhash64(doc_id, F.lit("window")), n) + i * F.floor(n / taken), n).cast("int")
    return F.transform(F.sequence(F.lit(0), taken - 1), lambda i: F.substring(text, place(i) * WINDOW + 1, F.lit(WINDOW)))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = ID, text_col: str = TEXT, lang_col: str = "lang", per_document: int = PER_DOCUMENT) -> list[tuple[bytes, str]]:
    """Windows of a bounded sample of labelled documents: ids first, from slim columns, then ``per_document`` windows of each, so the driver gets no whole text."""
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    slim = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).distinct()
    counts = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))  # one row a language
    slim = slim.join(F.broadcast(counts), "lang").where(drawn(F.col("id"), per_language, F.col("total")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids: dict[str, list] = {}
    for r in slim.withColumn("rank", rank).where(F.col("rank") <= per_language).collect():
        ids.setdefault(r.lang, []).append(r.id)
    sampled = reduce(or_, [(F.col(lang_col) == lang) & F.col(id_col).isin(own) for lang, own in ids.items()], F.lit(False))
    texts = usable.where(sampled).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    one = texts.groupBy("id", "lang").agg(F.min("text").alias("text")).where("text is not null")  # one row an id and language
    rows = one.select("id", "lang", cut_windows(F.col("text"), F.col("id"), per_document).alias("windows")).collect()
    return [(bytes(w), r.lang) for r in sorted(rows, key=lambda r: (r.id, r.lang)) for w in r.windows]


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = ID, text_col: str = TEXT, lang_col: str = "lang") -> Network | None:
    return train(training_sample(docs, per_language, id_col, text_col, lang_col))


def answers(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, score) of whole texts."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    named = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if net else []
    for at in range(0, len(named), AT_ONCE):
        some = named[at : at + AT_ONCE]
        data = [texts[k].encode("utf-8") for k in some]
        x = [windows_of(d) for d in data]
        weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(w))) for d, w in zip(data, x, strict=True)])
        owner = np.repeat(np.arange(len(some)), [len(w) for w in x])
        flat = np.concatenate(x)
        logs = np.concatenate([net.log_probabilities(flat[k : k + AT_ONCE]) for k in range(0, len(flat), AT_ONCE)]) * weight[:, None]
        mean = np.add.reduceat(logs, np.searchsorted(owner, np.arange(len(some))), 0).astype(np.float64) / np.array([[len(d)] for d in data])
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k, best, score in zip(some, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            langs[k], scores[k] = net.languages[best], min(1.0, score)
    return langs, scores


def answered(net: Network | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``answers`` for an Arrow array."""
    langs, scores = [], []
    for part in slices(texts):
        got = answers(net, part)
        langs += got[0]
        scores += got[1]
    return pa.array(langs, pa.string()), pa.array(scores, pa.float64())


def predicted(docs: DataFrame, net: Network | None, text_col: str = TEXT) -> Column:
    """A column (lang string, score double) over ``text_col``."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("lang string, score double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([*answered(shared.value, texts)], ["lang", "score"])

    return of(F.col(text_col))


def predict(docs: DataFrame, net: Network | None, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *answered(shared.value, batch.column(2))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least_score: float = LEAST_SCORE, text_col: str = TEXT) -> DataFrame:
    """The documents whose language is told with at least ``least_score``, with all their columns."""
    names, answer = docs.columns, fresh_name(docs, "answer")
    return docs.withColumn(answer, predicted(docs, net, text_col)).where((F.col(f"{answer}.lang") != UNKNOWN) & (F.col(f"{answer}.score") >= least_score)).select(*names)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, trained(docs))
