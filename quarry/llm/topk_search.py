"""Exact top-k by inner product with MaxScore over shards of integer vectors.

Components are terms, and a shard keeps a posting list for each: the rows where the component is not zero,
with its values (a list of over half of the rows is kept as a column).  A term's contribution to a
query's score is bounded by the term's least and largest value in the shard.  Terms are ordered by
bound.  The essential terms are the shortest prefix without which no row could reach the query's
threshold: rows outside their postings are never looked at.  Essential postings are traversed; the other terms
are probed a few at a time while rows' partial scores plus the remaining bounds still reach the
threshold: by whole postings while many are competitive, as in dense vectors, and then only for the
few that are left.

One shard is searched first, with thresholds from its rows that lead on the first few terms.  Its k-th
scores are the thresholds in all other shards, where a query whose bounds stay below is skipped.
Every shard returns its k best for every query; shards are merged by rank.

Shards and query blocks have a bounded number of rows, dealt by hash; a unit of work is one shard
and one query block.  No bound is approximate, so results are exact; ties go to the smaller id.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; a
shorter vector counts as padded with zeros; rows of the query's own id are not candidates for it;
rows repeated under one id are separate candidates, and equal query rows ask once; fewer than k candidates give fewer rows; an empty
table gives an empty result.  Vectors whose sums might not be exact in doubles are scored with whole
numbers of any length; a score beyond 64 bits is ranked by its true value and reported as the nearest
64-bit one.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.columns import named
from quarry.plans.scratch import Scratch, ship

#: Terms that seed the threshold at least (else half of them), and that are probed at a time.
LEAD, PROBE = 8, 8
#: Queries whose essential prefixes are of similar length and are traversed together.
GROUP = 256
#: Share of competitive rows below which they are gathered for probing; above it, whole postings cost less.
GATHER = 0.02
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the usable vectors."""
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = rows.select(named(rows, id_col).cast("long").alias("id"), named(rows, vec_col).cast("array<double>").alias("v"))
    return plain.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(ok)


def _behind(x: np.ndarray) -> np.ndarray:
    """Sums of each row from every place on, and 0 behind the last."""
    return np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)


class Shard:
    """Postings of one shard, without zeros, and the terms' bounds."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.asfortranarray(values[order])
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.full = 2 * np.count_nonzero(values, axis=0) > len(values)
        self.postings = {int(t): np.flatnonzero(self.values[:, t]) for t in np.flatnonzero(~self.full)}

    def _traverse(self, terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in these terms' postings, and their partial scores for each query."""
        full = self.full[terms]
        if full.any():
            rows = np.arange(len(self.ids))
            partial = self.values[:, terms[full]] @ asked[:, full].T
        else:
            rows = np.unique(np.concatenate([self.postings[int(t)] for t in terms])) if len(terms) else np.zeros(0, np.int64)
            partial = np.zeros((len(rows), len(asked)))
        for at in np.flatnonzero(~full):
            mine = self.postings[int(terms[at])]
            partial[np.searchsorted(rows, mine)] += np.outer(self.values[mine, terms[at]], asked[:, at])
        return rows, partial

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of each query, queries in order and best rows first.

        ``floor`` are scores that k rows elsewhere are known to reach: less is of no interest.  Terms are
        ordered by their mean bound over the queries, so that a block of queries shares its prefixes; each
        query's own bounds decide what is essential and what is probed.
        """
        bound = np.maximum(queries * self.low, queries * self.high)
        order = np.argsort(-(bound - np.minimum(queries * self.low, queries * self.high)).mean(axis=0), kind="stable")
        asked, n_terms = queries[:, order], len(order)
        most = _behind(bound[:, order])  # what the terms from a place on can add at most
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        threshold = self._thresholds(order, asked, first, last, k) if floor is None else floor
        # a row outside of the postings of a query's essential terms does not reach its threshold
        essential = np.minimum((most[:, :n_terms] >= threshold[:, None]).cumprod(axis=1).sum(axis=1), n_terms)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        hoping = np.flatnonzero(most[:, 0] >= threshold)
        by_length = hoping[np.argsort(essential[hoping], kind="stable")]
        for a in range(0, len(by_length), GROUP):
            group = by_length[a : a + GROUP]
            at = int(essential[group].max())
            if not np.isfinite(threshold[group]).all():
                rows, partial = np.arange(len(self.ids)), self.values[:, order[:at]] @ asked[group, :at].T
            else:
                rows, partial = self._traverse(order[:at], asked[group, :at])
            for c, q in enumerate(group):
                partial[slice(*np.searchsorted(rows, [first[q], last[q]])), c] = -np.inf
            alive = partial >= threshold[group] - most[group, at]
            while at < n_terms and np.count_nonzero(alive) > GATHER * alive.size:
                to = min(at + PROBE, n_terms)
                partial += self.values[np.ix_(rows, order[at:to])] @ asked[group, at:to].T
                at = to
                alive = partial >= threshold[group] - most[group, at]
            at_rows, cols = np.nonzero(alive & (partial > -np.inf))
            score, cols, at_rows = partial[at_rows, cols], group[cols], rows[at_rows]
            while at < n_terms and len(at_rows):
                to = min(at + PROBE, n_terms)
                score = score + np.einsum("ij,ij->i", self.values[at_rows][:, order[at:to]], asked[cols, at:to])
                at = to
                keep = score + most[cols, at] >= threshold[cols]
                at_rows, cols, score = at_rows[keep], cols[keep], score[keep]
            found = [np.concatenate([x, y]) for x, y in zip(found, (cols, at_rows, score))]
        cols, rows, score = found
        best = np.lexsort((rows, -score, cols))  # rows are in order of id
        cols, rows, score = cols[best], rows[best], score[best]
        place = np.arange(len(cols)) - np.searchsorted(cols, cols, "left")
        return cols[place < k], rows[place < k], score[place < k]

    def _thresholds(self, order: np.ndarray, asked: np.ndarray, first, last, k: int) -> np.ndarray:
        """For each query the least score among the k rows that lead on the first few terms."""
        lead = min(max(LEAD, len(order) // 2), len(order))
        out = np.full(len(asked), -np.inf)
        if len(self.ids) <= k:
            return out
        for a in range(0, len(asked), GROUP):
            part = slice(a, a + GROUP)
            partial = self.values[:, order[:lead]] @ asked[part, :lead].T
            for c, q in enumerate(range(a, min(a + GROUP, len(asked)))):
                partial[first[q] : last[q], c] = -np.inf
            rows = np.argpartition(-partial, k - 1, axis=0)[:k]
            full = np.einsum("kqt,qt->kq", self.values[rows][:, :, order], asked[part])
            full[np.isinf(np.take_along_axis(partial, rows, axis=0))] = -np.inf
            out[part] = full.min(axis=0)
        return out


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, for doubles of any size."""
    one = lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale))
    return np.array([[one(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def ordered(score: int) -> str:
    """A string that sorts as the number does, for numbers beyond 64 bits; empty for the others."""
    if _LEAST <= score <= _MOST:
        return "~" if score == _LEAST else ""  # above all that are reported as the least
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _score_unit(ids, raw, is_query, floor, k: int, scale: int) -> list[tuple[int, int, int, str]]:
    """(query, id, score, order of scores beyond 64 bits) of one shard and one block of queries."""
    width = raw.shape[1]
    with np.errstate(over="ignore"):
        values = np.floor(raw * scale)
    plain = (np.abs(values) <= (2**53 / width) ** 0.5).all(axis=1)  # any sum of products is exact
    out = []
    docs, asking = ~is_query & plain, is_query & plain
    if docs.any() and asking.any():
        shard = Shard(ids[docs], values[docs])
        cols, rows, score = shard.top(ids[asking], values[asking], k, None if floor is None else floor[asking])
        out += zip(ids[asking][cols].tolist(), shard.ids[rows].tolist(), score.astype(np.int64).tolist(), [""] * len(cols))
    if plain.all():
        return out
    exact = whole_numbers(raw, scale)
    for q in np.flatnonzero(is_query):
        mine = np.flatnonzero(~is_query & (ids != ids[q]) & ~(plain & plain[q]))
        scored = []
        for a in range(0, len(mine), 1024):
            part = mine[a : a + 1024]
            scored += zip(exact[part] @ exact[q], ids[part].tolist())
            scored = sorted(scored, key=lambda p: (-p[0], p[1]))[:k]
        out += [(int(ids[q]), i, min(max(s, _LEAST), _MOST), ordered(s)) for s, i in scored]
    return out


def search(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    scale: int = 64,
    shard_rows: int = 8192,
    block_queries: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score) for the queries, the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "search")
    vectors = scratch.table(finite_vectors(rows, id_col, vec_col).withColumn("salt", F.monotonically_increasing_id()), "vectors")
    asked = F.pmod("id", F.lit(every)) == 0
    n, q = vectors.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_queries))
    spread = lambda m: F.pmod(F.xxhash64("id", "salt"), F.lit(m)).cast("int")
    candidates = vectors.select(spread(shards).alias("shard"), F.lit(False).alias("q"), F.lit(None).cast("double").alias("floor"), "id", "v")
    queries = vectors.filter(asked).dropDuplicates(["id", "v"]).select(spread(blocks).alias("block"), F.lit(True).alias("q"), "id", "v")
    schema = "query_id long, id long, score long, beyond string"
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])

    def unit(table: pa.Table) -> pa.Table:
        is_query, ids = table.column("q").to_numpy(), table.column("id").to_numpy()
        if is_query.all() or not is_query.any():
            return out.empty_table()
        lists = table.column("v").combine_chunks()
        lens = lists.value_lengths().to_numpy(zero_copy_only=False)
        raw = np.zeros((len(ids), max(1, int(lens.max(initial=0)))))
        raw[np.arange(raw.shape[1]) < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        floor = table.column("floor").to_numpy(zero_copy_only=False)
        known = None if np.isnan(floor[is_query]).all() else np.where(np.isnan(floor), -np.inf, floor)
        found = _score_unit(ids, raw, is_query, known, k, scale)
        return pa.table({c: pa.array([r[j] for r in found], out.field(c).type) for j, c in enumerate(out.names)}, schema=out)

    def searched(candidates: DataFrame, queries: DataFrame, numbers) -> DataFrame:
        """Units of these candidates, each with every block of queries, and these queries, each with the numbered shards."""
        each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
        cols = ["shard", "block", "q", "floor", "id", "v"]
        dealt = candidates.withColumn("block", each(0, blocks - 1)).select(*cols).unionByName(queries.withColumn("shard", each(*numbers)).select(*cols))
        return dealt.groupBy("shard", "block").applyInArrow(unit, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = searched(candidates.filter("shard = 0"), queries.withColumn("floor", F.lit(None).cast("double")), (0, 0))
    if shards > 1:
        best = scratch.table(ranked(best), "first")
        kth = best.filter((F.col("rank") == k) & (F.col("score") > _LEAST)).select(F.col("query_id").alias("id"), "score")
        # as a double, at most the score itself
        floor = F.when(F.abs(F.col("score")) < 1 << 53, F.col("score").cast("double")).otherwise(F.col("score").cast("double") - 4096.0)
        floored = queries.join(kth.select("id", floor.alias("floor")), "id", "left")
        others = searched(candidates.filter("shard > 0"), floored, (1, shards - 1))
        best = best.drop("rank").unionByName(others)
    return ranked(best).select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""
