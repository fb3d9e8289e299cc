"""Ranked lexical search over inverted treaps, one for each term and block of documents.

Documents are read once and reduced to the terms that some query asks for, with their counts. Sums
over these rows give the collection's figures (documents, terms, document frequencies). Then each
task takes its rows in blocks of bounded size and builds a treap for each term of a block: a search
tree by document, a heap by impact (the term's part of the score), so a subtree's largest impact is
at its root. A query goes down its terms' treaps together: a range of documents has the topmost node
in it of each treap, and the sum of their impacts bounds every score in the range. Ranges that cannot
reach the query's top k are cut off; others are split at the document of their largest impact, which
is scored. A task keeps its best k for each query, and the best of all tasks are ranked at the end.

Nothing is shuffled but the tasks' best rows; a term in every document only means a treap in every
block. Queries come in blocks too (``ITEM_TERMS`` terms in all or one query), and only such a block
is sent to the tasks.

Scores are integers, see ``weight`` and ``impacts``. Defined results: a null text has no terms; null
ids come last among equal scores; rows that repeat an id are documents (or queries) of their own, so
an id may come twice; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.llm.words import license_words
from farglass.runtime import materialise, numbered

#: Postings in a block of documents: about 40 bytes each in memory.
BLOCK_POSTINGS = 1 << 21
#: Distinct terms of each query, summed, in a block of queries.
ITEM_TERMS = 100_000
#: Ranges that are split at once, and nodes in them at most.
CHUNK, CHUNK_NODES = 256, 1 << 19

#: ASCII letters in lower case, digits and all bytes of other characters; the rest separates terms.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def weight(documents: Column, frequency: Column) -> Column:
    """A term's weight, from doubles: floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log((2 * documents + 2).cast("double") / (2 * frequency + 1).cast("double"))).cast("long")


def impacts(weights, counts, sizes, documents: int, terms: int):
    """What terms add to scores, from their weights, their counts and the sizes of their documents."""
    m = 10 + (90 * sizes * documents) // max(terms, 1)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _tally(vocabulary: dict[bytes, int]) -> Callable[[Iterator], Iterator]:
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        known = vocabulary.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").translate(FOLDED).split()
                found = [(t, c) for w, c in Counter(words).items() if (t := known(w)) is not None]
                sizes.append(len(words))
                terms.append([t for t, _ in found])
                counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], schema=schema)

    return rows


def tally(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n`` (all terms with repeats), ``terms`` (numbers of those in the vocabulary) and ``counts``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(_tally(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>")


class Treaps:
    """The treaps of one block, in flat arrays; position ``end`` stands for no node."""

    def __init__(self, ids, absent, sizes, lengths, terms, counts, weights, documents: int, all_terms: int):
        import numpy as np

        order = np.lexsort((ids, absent))  # documents by id, those without one last
        self.ids, self.absent = ids[order], absent[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        docs = np.repeat(place, lengths)
        values = impacts(weights[terms], counts, np.repeat(sizes, lengths), documents, all_terms)
        by_doc = np.argsort(docs, kind="stable")
        self.doc_terms, self.doc_values = terms[by_doc], values[by_doc]
        self.doc_starts = np.searchsorted(docs[by_doc], np.arange(len(ids) + 1))
        by_term = np.lexsort((docs, terms))
        terms, docs, values = terms[by_term], docs[by_term], values[by_term]
        self.end = len(docs)
        self.doc, self.value = np.append(docs, -1), np.append(values, 0)
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if self.end else np.zeros(0, int)
        self.root = np.full(len(weights), self.end)
        # Equal impacts are ordered by a hash of the document, so that equal runs do not make long paths.
        heights = ((values << 16) | ((docs * 40503) & 0xFFFF)).tolist()
        left, right = [self.end] * (self.end + 1), [self.end] * (self.end + 1)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), self.end], strict=True):
            path: list[int] = []
            for i in range(a, b):
                last, x = self.end, heights[i]
                while path and heights[path[-1]] < x:
                    last = path.pop()
                left[i] = last
                if path:
                    right[path[-1]] = i
                path.append(i)
            self.root[terms[a]] = path[0]
        self.left, self.right = np.array(left), np.array(right)

    def _topmost(self, nodes, low, high):
        """In each treap, the first node on the way down whose document is between ``low`` and ``high``."""
        import numpy as np

        flat, width = nodes.ravel(), nodes.shape[1]
        todo = np.flatnonzero(flat != self.end)
        while len(todo):
            now, row = flat[todo], todo // width
            at = self.doc[now]
            before, after = at <= low[row], at >= high[row]
            moved = before | after
            todo, now = todo[moved], now[moved]
            flat[todo] = now = np.where(before[moved], self.right[now], self.left[now])
            todo = todo[now != self.end]
        return nodes

    def _scores(self, docs, asked):
        import numpy as np

        starts, n = self.doc_starts[docs], self.doc_starts[docs + 1] - self.doc_starts[docs]
        where = np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        parts = self.doc_values[where] * asked[self.doc_terms[where]]
        return np.add.reduceat(parts, np.append(0, np.cumsum(n)[:-1]))

    def search(self, terms, asked, best: Best) -> int:
        """Offers ``best`` every document that can be among its k; returns how many were scored.

        ``asked``: a flag for each term of the vocabulary, set for ``terms``.
        """
        import numpy as np

        roots = self.root[terms]
        roots = roots[roots != self.end]
        if not len(roots):
            return 0
        chunk, seen = max(1, min(CHUNK, CHUNK_NODES // len(roots))), 0
        stack = [(self.value[roots].sum()[None], np.array([-1]), np.array([len(self.ids)]), roots[None, :])]
        while stack:
            got = [stack.pop()]
            while stack and sum(len(x[0]) for x in got) < chunk:
                got.append(stack.pop())
            bounds, low, high, nodes = (np.concatenate(x) for x in zip(*reversed(got), strict=True)) if len(got) > 1 else got[0]
            live = bounds >= best.least
            if not live.all():
                bounds, low, high, nodes = bounds[live], low[live], high[live], nodes[live]
            if not len(bounds):
                continue
            if len(bounds) > chunk:
                stack.append((bounds[:-chunk], low[:-chunk], high[:-chunk], nodes[:-chunk]))
                low, high, nodes = low[-chunk:], high[-chunk:], nodes[-chunk:]
            top = nodes[np.arange(len(nodes)), self.value[nodes].argmax(axis=1)]
            docs = self.doc[top]
            seen += len(docs)
            best.offer(self._scores(docs, asked), self.ids[docs], self.absent[docs])
            low, high = np.concatenate((low, docs)), np.concatenate((docs, high))
            wide = high - low > 1
            low, high = low[wide], high[wide]
            nodes = self._topmost(np.concatenate((nodes, nodes))[wide], low, high)
            bounds = self.value[nodes].sum(axis=1)
            order = np.argsort(bounds, kind="stable")  # the best range is taken first
            order = order[np.searchsorted(bounds[order], best.least) :]
            stack.append((bounds[order], low[order], high[order], nodes[order]))
        return seen


class Best:
    """The k best documents of one query so far: highest score, then smallest id."""

    def __init__(self, k: int):
        import numpy as np

        self.k, self.scores, self.ids, self.absent = k, np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document with a lower score cannot enter; one with this score may, by its id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, scores, ids, absent) -> None:
        import numpy as np

        good = scores >= self.least
        if good.any():
            scores, ids, absent = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[good]), (self.absent, absent[good])))
            order = np.lexsort((ids, absent, -scores))[: self.k]
            self.scores, self.ids, self.absent = scores[order], ids[order], absent[order]


def _search(items: list[tuple[int, list[int]]], weights: list[int], documents: int, all_terms: int, k: int) -> Callable[[Iterator], Iterator]:
    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        w, best = np.array(weights, "int64"), [Best(k) for _ in items]

        def run(parts: list) -> None:
            if parts:
                treaps = Treaps(*(np.concatenate(x) for x in zip(*parts, strict=True)), w, documents, all_terms)
                asked = np.zeros(len(w), bool)
                for (_, terms), own in zip(items, best, strict=True):
                    terms = np.array(terms, int)
                    asked[terms] = True
                    treaps.search(terms, asked, own)
                    asked[terms] = False

        parts, postings = [], 0
        for batch in batches:
            ids, sizes, terms, counts = (batch.column(i) for i in range(4))
            parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), sizes.to_numpy(zero_copy_only=False), np.asarray(terms.value_lengths()), terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)))
            postings += len(parts[-1][4])
            if postings >= BLOCK_POSTINGS:
                run(parts)
                parts, postings = [], 0
        run(parts)
        for (item, _), own in zip(items, best, strict=True):
            if n := len(own.scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(own.ids, pa.int64(), mask=own.absent), pa.array(own.scores, pa.int64())], schema=schema)

    return rows


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank`` (from 1), ``doc_id, score``: the k best documents with a score above 0 for each
    row of ``queries`` (``item_id, text``), equal scores by id."""
    items = numbered(queries.select("item_id", F.array_distinct(license_words(F.col("text").cast("string"))).alias("asked"))).select(F.col("rank").alias("item"), "item_id", "asked")
    items = materialise(items, "items")
    total = items.agg(F.sum(F.size("asked"))).first()[0] or 0
    blocks = -(-total // ITEM_TERMS)
    found = [_search_block(docs, items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", first).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    asked = [(r.item, [w.encode() for w in r.asked]) for r in items.select("item", "asked").collect()]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in asked for w in words))}
    tallied = materialise(tally(docs, vocabulary), "tallied")
    sums = tallied.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequencies = tallied.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # A row for each term of this block of queries.
    weights = [0] * len(vocabulary)
    for r in frequencies.select("term", weight(F.lit(sums.documents), F.col("df")).alias("w")).collect():
        weights[r.term] = r.w
    return tallied.where(F.size("terms") > 0).mapInArrow(_search([(item, [vocabulary[w] for w in words]) for item, words in asked], weights, sums.documents, sums.terms, k), "item long, doc_id long, score long")
