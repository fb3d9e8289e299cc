"""Topic models (LDA) by online variational Bayes, with the words' weights as a table.

Every round takes a hashed part of the texts. Their word counts meet the weights of their words in a
join, tasks infer the topics of whole texts, and the sums by word go into a new table of weights. The
driver sees a number for each topic, never one for each word, so the vocabulary may be of any size.
Starts and parts are by hash, so reruns agree but for the last digits of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farglass.operators.thin import random_thin
from farglass.operators.vectors import coherence
from farglass.runtime import discard, materialise

#: Rate of a round: (TAU + round) ** -KAPPA.
TAU, KAPPA = 1024, 0.51
#: Part of the texts that a round takes.
SHARE = 0.05
#: A text is inferred until its mean change is below this, at most so many times.
CHANGE, TURNS = 1e-3, 200


@dataclass
class TopicModel:
    """``weights``: ``word, df, x`` with an array of ``k`` positive numbers; ``totals``: their sums; ``alpha``: the texts' prior."""

    weights: DataFrame
    totals: np.ndarray
    alpha: np.ndarray
    n_texts: int


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: recurrence up to 6, then the asymptotic series."""
    x, shift = np.array(x, dtype="float64"), np.zeros_like(x, dtype="float64")
    for _ in range(6):
        low = x < 6
        shift -= np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, dtype="float64"), np.zeros_like(x, dtype="float64")
    for _ in range(6):
        low = x < 6
        shift += np.where(low, 1 / (x * x), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def _expected(x: np.ndarray) -> np.ndarray:
    """Expected logarithms of what rows of ``x`` are Dirichlet parameters of."""
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def _counted(batches: Iterator) -> Iterator:
    """``key, word, n`` from ``key, words``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        flat = pa.table({"row": pc.list_parent_indices(batch.column(1)), "word": batch.column(1).flatten()})
        made = flat.filter(pc.is_valid(flat.column("word"))).group_by(["row", "word"]).aggregate([([], "count_all")])
        whole = pa.table({"key": pa.chunked_array([batch.column(0)]).take(made.column("row")), "word": made.column("word"), "n": made.column("count_all")})
        yield from whole.to_batches(max_chunksize=10_000)


def _placed(texts: DataFrame, key: str, words: str, weights: DataFrame) -> DataFrame:
    """``key, word, n, x`` of the texts' words that have weights, a text's rows together."""
    kind = texts.schema[key].dataType.simpleString()
    counts = texts.where(F.col(key).isNotNull()).select(key, words).mapInArrow(_counted, f"key {kind}, word string, n long")
    # The table of weights is left out of broadcasts: it grows with the corpus and would pass the driver each round.
    met = counts.join(weights.select("word", "x").hint("merge"), "word")
    return met.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "x")


def infer(starts: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Dirichlet parameters of texts, whose words are rows from ``starts`` on."""
    gamma, text = np.ones((len(starts), len(alpha))), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
    active = np.arange(len(starts))
    for _ in range(TURNS):
        theta = np.exp(_expected(gamma[active]))
        part = n / ((theta[text] * beta).sum(axis=1) + 1e-100)
        after = theta * np.add.reduceat(beta * part[:, None], starts, axis=0) + alpha
        moving = np.abs(after - gamma[active]).mean(axis=1) >= CHANGE
        gamma[active] = after
        if not moving.any():
            break
        if not moving.all():
            kept = moving[text]
            active, n, beta = active[moving], n[kept], beta[kept]
            sizes = np.bincount(text[kept], minlength=len(moving))[moving]
            starts, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(active)), sizes)
    return gamma


def _whole_texts(batches: Iterator) -> Iterator:
    """Batches that end where a text ends."""
    import pyarrow as pa

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        keys = table.column(0).combine_chunks()
        last = keys[len(keys) - 1]
        cut = int(np.searchsorted(_same_as(keys, last), True))  # its rows come last
        if cut:
            yield table.slice(0, cut).combine_chunks()
        left = table.slice(cut)
    if left is not None:
        yield left.combine_chunks()


def _same_as(keys, key) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.equal(keys, key).to_numpy(zero_copy_only=False)


def _starts(keys) -> np.ndarray:
    """First rows of runs of equal keys."""
    import pyarrow.compute as pc

    if len(keys) < 2:
        return np.arange(len(keys))
    return np.append(0, 1 + np.nonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))[0])


def _step(totals: np.ndarray, alpha: np.ndarray, learn: bool) -> Callable[[Iterator], Iterator]:
    """Inferred texts: their topics, or what a round sums up (for each word; without a word, for all texts)."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k = len(alpha)
        for table in _whole_texts(batches):
            keys, words = (table.column(c).combine_chunks() for c in ("key", "word"))
            beta = np.exp(digamma(table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, k)) - digamma(totals))
            n, starts = table.column("n").to_numpy().astype("float64"), _starts(keys)
            gamma = infer(starts, n, beta, alpha)
            if not learn:
                shares = gamma / gamma.sum(axis=1, keepdims=True)
                yield from pa.table({"key": keys.take(pa.array(starts)), "topics": _lists(shares)}).to_batches(max_chunksize=10_000)
                continue
            logs = _expected(gamma)
            theta = np.exp(logs)[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))]
            stats = theta * beta * (n / ((theta * beta).sum(axis=1) + 1e-100))[:, None]
            coded = words.dictionary_encode()
            sums = np.zeros((len(coded.dictionary), k))
            np.add.at(sums, coded.indices.to_numpy(), stats)
            yield pa.RecordBatch.from_arrays([coded.dictionary, _lists(sums), pa.array(np.zeros(len(sums), "int64"))], names=["word", "s", "texts"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), _lists(logs.sum(axis=0, keepdims=True)), pa.array([len(starts)])], names=["word", "s", "texts"])

    return rows


def _lists(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype="int32"), np.ascontiguousarray(x).ravel())


def _sums(table: DataFrame, column: str, k: int) -> np.ndarray:
    found = table.agg(*(F.sum(F.get(column, F.lit(j))).alias(f"s{j}") for j in range(k))).first()
    return np.array([v or 0.0 for v in found])


def _next_alpha(alpha: np.ndarray, logs: np.ndarray, texts: int, rate: float) -> np.ndarray:
    """A damped Newton step of the texts' prior; the old one where it would leave the positive numbers."""
    gradient = texts * (logs / texts - _expected(alpha))
    c, q = texts * trigamma(alpha.sum()), -texts * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    after = alpha - rate * (gradient - b) / q
    return after if (after > 0).all() else alpha


def fit(texts: DataFrame, key: str, words: str, k: int, *, min_documents: int = 2, seed: int = 1, rounds: int = 20, share: float = SHARE) -> TopicModel:
    """A model of ``k`` topics over all words that ``min_documents`` texts have. ``key`` tells texts apart."""
    n_texts = texts.count()
    df = texts.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where((F.col("df") >= min_documents) & F.col("word").isNotNull())
    df = materialise(df.withColumn("id", F.xxhash64("word")), "vocabulary")
    # Weights begin near 1: normal numbers by the word's hash in the place of gamma ones of shape 100.
    numbers = random_thin(df, k, seed, "word", "df")
    weights = materialise(numbers.select("word", "df", F.transform("x", lambda x: F.greatest(1 + x / 10, F.lit(0.5))).alias("x")), "weights")
    alpha, eta, totals = np.full(k, 1 / k), 1 / k, None
    for r in range(rounds):
        totals = _sums(weights, "x", k) if totals is None else totals
        part = texts.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), key), F.lit(1 << 30)) < int(share * (1 << 30)))
        stats = materialise(_placed(part, key, words, weights).mapInArrow(_step(totals, alpha, True), "word string, s array<double>, texts long"), "topic_stats")
        over = stats.where("word is null")
        taken = over.agg(F.sum("texts")).first()[0]
        if taken:
            rate = (TAU + r + 1.0) ** -KAPPA
            summed = stats.where("word is not null").groupBy("word").agg(F.array(*(F.sum(F.get("s", F.lit(j))) for j in range(k))).alias("s"))
            # A word that the part has not keeps its place among the others.
            s = F.coalesce("s", F.array_repeat(F.lit(0.0), k))
            moved = F.zip_with("x", s, lambda x, y: x * (1 - rate) + (y * (n_texts / taken) + eta) * rate)
            after = materialise(weights.join(summed.hint("merge"), "word", "left").select("word", "df", moved.alias("x")), "weights")
            alpha = _next_alpha(alpha, _sums(over, "s", k), taken, rate)
            discard(weights)
            weights, totals = after, None
        discard(stats)
    discard(df)
    return TopicModel(weights, _sums(weights, "x", k), alpha, n_texts)


def topic_words(model: TopicModel, n: int = 10, weight: float = 0.5) -> DataFrame:
    """The n most relevant words of each topic: weight * ln p(word | topic) + (1 - weight) * ln lift,
    with a word's share of documents as its corpus probability."""
    shares = F.transform("x", lambda x, j: x / F.get(F.array(*map(F.lit, model.totals.tolist())), j))
    terms = model.weights.select("word", "df", F.posexplode(shares).alias("topic", "p"))
    scored = terms.withColumn("relevance", weight * F.ln("p") + (1 - weight) * F.ln(F.col("p") / (F.col("df") / model.n_texts)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("relevance"), "word"))).where(F.col("rank") <= n).select("topic", "word", "relevance", "rank")


def document_topics(model: TopicModel, texts: DataFrame, key: str, words: str) -> DataFrame:
    """``key, topics`` (probabilities, in the order of topics; zeros for a text without a known word)."""
    k, kind = len(model.alpha), texts.schema[key].dataType.simpleString()
    found = _placed(texts, key, words, model.weights).mapInArrow(_step(model.totals, model.alpha, False), f"key {kind}, topics array<double>")
    found = materialise(found, "text_topics")
    return texts.select(key).join(found.withColumnRenamed("key", key), key, "left").select(key, F.coalesce("topics", F.array_repeat(F.lit(0.0), k)).alias("topics"))


def likeliest(model: TopicModel, n: int) -> list[list[str]]:
    """The ``n`` likeliest words of each topic."""
    found = topic_words(model, n, 1.0).orderBy("topic", "rank").collect()  # n for each topic
    return [[r.word for r in found if r.topic == t] for t in range(len(model.alpha))]


def search(texts: DataFrame, key: str, words: str, ks: Sequence[int], *, seeds: Sequence[int] = (1,), n: int = 10, **options) -> tuple[TopicModel, list[tuple[int, int, float]]]:
    """The model of the best coherence over a grid, and ``(k, seed, coherence)`` of all of them. Of equal ones the first wins."""
    table, best = [], None
    for k in ks:
        for seed in seeds:
            model = fit(texts, key, words, k, seed=seed, **options)
            score = coherence(likeliest(model, n), texts, words)
            table.append((k, seed, score))
            if best is None or score > best[0]:
                best = (score, model)
    return best[1], table
