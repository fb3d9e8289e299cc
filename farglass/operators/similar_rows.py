"""Nearest rows by cosine: blocks of queries against batches of rows as matrix products.

A product of unit vectors is rough in its last digits, so it only tells which pairs may be among a
query's best; these are scored again as ``vectors.cosine`` does it, and order and ties go by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Queries in one product.
WIDTH = 256
#: What a product of unit vectors may be off, amply.
SLACK = 1e-9
#: Pairs that are scored again at a time.
PAIRS = 500_000


def _matrix(lists, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of that length without nulls as a matrix (zeros elsewhere), and which those are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pc.fill_null(pc.equal(pc.list_value_length(lists), length), False).to_numpy(zero_copy_only=False).copy()
    flat = lists.flatten()
    if flat.null_count:
        whole[pc.list_parent_indices(lists).to_numpy()[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    out = np.zeros((len(lists), length))
    if length and whole.any():
        out[whole] = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    return out, whole


def _squares(x: np.ndarray) -> np.ndarray:
    """Sums of squares from the first place to the last, as a loop adds them."""
    total = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for j in range(x.shape[1]):
            total += x[:, j] * x[:, j]
    return total


def _unit(x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the rows for which a product tells nothing (too small, too large, NaN)."""
    odd = ~((squares > 1e-200) & (squares < 1e200)) & (squares != 0)
    return x / np.sqrt(np.where(odd | (squares == 0), 1.0, squares))[:, None], odd


def _candidates(rough: np.ndarray, k: int, least: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may be among the best ``k`` of a row of ``rough``, of which ``least`` is known,
    and of those that are ``tried`` anyhow."""
    n = rough.shape[1]
    best = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -np.inf)
    return np.nonzero(((rough >= (np.maximum(best, least) - SLACK)[:, None]) | tried) & (rough > -np.inf))


def nearest(keys, lists, k: int) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow`` over ``key, vector``: a task's best ``k`` rows of every query as ``query, key, similarity``.

    ``keys`` and ``lists`` (arrays of doubles) are the queries, as Arrow arrays.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = pc.list_value_length(lists)
        # Queries of one length at a time; a query without a vector (-1) is like no row.
        known = pc.fill_null(lengths, -1).to_numpy(zero_copy_only=False)
        parts = [(length, np.nonzero(known == length)[0]) for length in sorted(set(known.tolist()))]
        asked = []
        for length, at in parts:
            for a in range(0, len(at), WIDTH):
                own = at[a : a + WIDTH]
                y, fine = _matrix(lists.take(pa.array(own)), max(length, 0))
                fine &= length >= 0
                squares = _squares(y)
                asked.append((length, own, y, fine, squares, *_unit(y, squares)))
        # The best of each query so far: its place, what ranks it (falling similarities, NaN first as in
        # Spark, null last), the row's key and the similarity.
        held = None
        least = np.full(len(keys), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = {length: _matrix(batch.column(1), max(length, 0)) for length, _ in parts}
            norms = {length: (s := _squares(x), *_unit(x, s)) for length, (x, _) in made.items()}
            same = pc.index_in(batch.column(0), value_set=keys)
            twins = same.null_count < len(same)
            found = [] if held is None else [held]
            for length, own, y, fine, squares, units, odd in asked:
                (x, whole), (x_squares, x_units, x_odd) = made[length], norms[length]
                with np.errstate(all="ignore"):
                    rough = units @ x_units.T
                # Pairs without a similarity come behind all others; what a product cannot tell is tried.
                empty = ~fine[:, None] | ~whole[None, :]
                tried = (odd[:, None] | x_odd[None, :]) & ~empty
                rough[empty | tried | (squares == 0)[:, None] | (x_squares == 0)[None, :]] = -2.0
                if twins:
                    rough[keys.take(pa.array(own)).to_numpy(zero_copy_only=False)[:, None] == batch.column(0).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                qi, xi = _candidates(rough, k, least[own], tried)
                for a in range(0, len(qi), PAIRS):
                    q, r = qi[a : a + PAIRS], xi[a : a + PAIRS]
                    dots = np.zeros(len(q))
                    with np.errstate(all="ignore"):
                        for j in range(x.shape[1]):
                            dots += y[q, j] * x[r, j]
                        apart = np.sqrt(x_squares[r]) * np.sqrt(squares[q])
                        similarity = dots / apart
                    null = empty[q, r] | (apart == 0)
                    order = np.where(null, np.inf, np.where(np.isnan(similarity), -np.inf, -similarity))
                    found.append(pa.table({"q": pa.array(own[q]), "order": pa.array(order), "key": batch.column(0).take(pa.array(r)), "similarity": pa.array(similarity, mask=null)}))
            if not found:
                continue
            held = pa.concat_tables(found).combine_chunks()
            held = held.take(pc.sort_indices(held, sort_keys=[("q", "ascending"), ("order", "ascending"), ("key", "ascending")]))
            q = held.column("q").to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            order = held.column("order").to_numpy()[last]
            least[q[last]] = np.where(np.isposinf(order), -2.0, np.where(np.isneginf(order), 2.0, -order))
            held = held.filter(pa.array(place < k))
        if held is not None:
            for part in pa.table({"query": keys.take(held.column("q").combine_chunks()), "key": held.column("key"), "similarity": held.column("similarity")}).to_batches(max_chunksize=10_000):
                yield part

    return rows
