"""Near-duplicate documents by bottom-k sketches, inverted lists, estimation and exact Jaccard.

1. Each text's shingle set is hashed by one function; the ``k`` smallest hashes are its sketch.
   Texts with equal sets form one class, represented by the row with its smallest id.
2. Inverted lists of the retained values: of each representative only a prefix of its values,
   rarest first, is listed.  Two sketches that overlap in t values or more share one of the
   (size - t + 1) rarest of each, so values retained by one text alone and, for most texts, those
   of wide-spread passages need no list.  t is exact where the union has at most k
   shingles (num / den of the set's size); beyond that it lies five standard deviations below what two
   sets at the threshold share among the k smallest values of their union.  The few texts that are
   listed get longer sketches of ``k_long`` values (for most, the whole set) and are listed anew.
3. Lists do not give all pairs.  In each round every list has one pivot, compared with those members
   that are not yet in its component; it then leaves the list, as nothing is left to learn from it.
   Pivots after the first come from a list's smallest component.  Lists whose members are in one
   component are done.  What one or two rounds leave are families of texts around the threshold;
   their members are compared in blocks, on full sets, without a row for each pair.
4. Pairs pass an estimate on the union sketch, then the exact test on full sets.

Rows are numbered once, in a table that is written, and all steps go by these numbers; ids only name
components.

Defined results: null and empty texts have n_shingles 0 and are linked with nothing; rows of one id
are judged by their own texts; rows of equal sets (ties, repeated rows) are linked; a component is named
by its smallest id and keeps its rows of that id; null ids get the component of their text but never
name one, and a component of null ids alone has a null name and keeps one row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.words import shingle_sets, split_words, text_slices
from quarry.plans.columns import named
from quarry.plans.components import contract
from quarry.plans.scratch import Scratch, ship

#: Remaining pairs per listed row up to which one round of pivots is enough.
REST_PER_ROW = 4
#: Open lists whose pivots are broadcast (some 60 bytes each); beyond that they are joined by shuffle.
FEW_LISTS = 50_000


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(_uid, doc, n, s1, s2, sketch): distinct shingles, 128-bit signature of the set, k smallest hashes."""
    ship(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("_uid", T.LongType()),
            T.StructField("doc", docs.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("s1", T.LongType()),
            T.StructField("s2", T.LongType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                n, s1, s2, low, cuts = [], [], [], [], [0]
                for s in shingle_sets(split_words(data, offsets, lower=True), width):
                    u = s.view(np.uint64)
                    n.append(len(s))
                    s1.append(int(u.sum().view(np.int64)))
                    s2.append(int((u ^ (u >> np.uint64(31)) * np.uint64(0x9FB21C651E98DF25)).sum().view(np.int64)))
                    low.append(s[:k])
                    cuts.append(cuts[-1] + len(low[-1]))
                flat = pa.array(np.concatenate(low), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)
                ids = [batch.column(c).slice(a, b - a) for c in ("_uid", "doc")]
                cols = [*ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("_uid", docs[id_col].alias("doc"), docs[text_col].alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, text_col: str, width: int, k: int) -> DataFrame:
    """(rep, n, sketch, items) of each row (_uid, text): items are the sorted distinct shingle hashes as packed 64-bit integers.

    Words are hashed anew, by a function that has nothing in common with that of the first sketches.
    """
    names = ["rep", "n", "sketch", "items"]
    types = [T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, types)])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                sets = list(shingle_sets(split_words(data, offsets, lower=True, seed=1), width))
                low = [s[:k] for s in sets]
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(low), pa.int64()))
                n = pa.array([len(s) for s in sets], pa.int64())
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_uid").slice(a, b - a), n, lists, packed], names=names)

    return docs.select("_uid", docs[text_col].alias("text")).mapInArrow(run, schema)


def _similar(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, x, y) of packed sets with den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u = np.frombuffer(x.as_buffer(), np.int64)
                v = np.frombuffer(y.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(v, u), max(0, len(v) - 1))
                both = int((v[at] == u).sum()) if len(v) else 0
                keep.append(den * both >= num * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select("a", "b").schema)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    source, cols = _numbered(docs, [id_col, text_col], scratch)
    rows = _judged(source, cols[id_col], cols[text_col], scratch, spent=True, **kw)
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _numbered(docs: DataFrame, names: list[str], scratch: Scratch) -> tuple[DataFrame, dict[str, str]]:
    """These columns with a row number _uid, written once, and what the columns are called there."""
    cols = {c: f"c_{i}" for i, c in enumerate(names)}
    rows = docs.select(*[named(docs, c).alias(x) for c, x in cols.items()], F.monotonically_increasing_id().alias("_uid"))
    return scratch.table(rows, "rows"), cols


def _judged(
    source: DataFrame,
    id_col: str,
    text_col: str,
    scratch: Scratch,
    width: int = 5,
    num: int = 75,
    den: int = 100,
    k: int = 64,
    k_long: int = 1024,
    spent: bool = False,
) -> DataFrame:
    """(_uid, doc, n, component_id, kept) of each numbered row; a spent source is deleted once its texts are not needed any more."""
    sketched = scratch.table(sketches(source, id_col, text_col, width, k), "sketches")
    sig = ["s1", "s2", "n"]
    all_rows = scratch.table(sketched.drop("sketch"), "signatures")
    least = F.struct(F.col("doc").isNull().alias("nul"), F.col("doc").alias("id"), F.col("_uid").alias("uid"))
    classes = scratch.table(
        all_rows.filter("n > 0").groupBy(*sig).agg(F.min(least).alias("least")).withColumn("rep", F.col("least.uid")), "classes"
    )
    reps = scratch.table(
        sketched.select(F.col("_uid").alias("rep"), "n", "sketch").join(classes.select("rep"), "rep"), "reps"
    )
    scratch.drop(sketched)
    need = _lists(scratch, reps, num, den, k, lambda lists: lists.select("rep").distinct())
    ids = need.select(F.col("rep").alias("_uid"))
    scratch.drop(reps)
    sets = scratch.table(full_sets(source.join(ids, "_uid", "left_semi"), text_col, width, k_long), "sets")
    scratch.drop(need, *([source] if spent else []))
    listed = _lists(scratch, sets.select("rep", "n", "sketch"), num, den, k_long)
    roots = _link_lists(scratch, listed, sets, num, den, k)
    scratch.drop(sets, listed)
    name = F.col("least")
    if roots is not None:
        linked = scratch.table(roots.withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep"), "linked", rows=roots.count())
        names = linked.groupBy("root").agg(F.min("least").alias("name"))
        classes = classes.join(linked.select("rep", "root").join(names, "root").select("rep", "name"), "rep", "left")
        name = F.coalesce("name", "least")
    out = all_rows.select("_uid", "doc", *sig).join(classes.select(*sig, name.alias("name")), sig, "left")
    # without shingles a row is its own component; null ids alone keep the row with the smallest number
    return out.select(
        "_uid",
        "doc",
        "n",
        F.when(F.col("name").isNull(), F.col("doc")).otherwise(F.col("name.id")).alias("component_id"),
        F.when(F.col("name").isNull(), F.lit(True))
        .when(F.col("name.nul"), F.col("name.uid") == F.col("_uid"))
        .otherwise(F.coalesce(F.col("doc") == F.col("name.id"), F.lit(False)))
        .alias("kept"),
    )


def _least(num: int, den: int, k: int) -> int:
    """Values of the k smallest of a union that similar sets share, but for five standard deviations."""
    q = num / den
    return int(q * k - 5 * (k * q * (1 - q)) ** 0.5)


def _lists(scratch: Scratch, reps: DataFrame, num: int, den: int, k: int, part=lambda lists: lists) -> DataFrame:
    """(v, rep, n), or the part of it that is wanted: the prefix of each sketch that has to be listed, values that only one sketch has left out.

    Counts are written, so that the join reads two plain shuffles, whose skewed parts can be split.
    """
    each = reps.select("rep", "n", F.explode("sketch").alias("v"))
    shared = scratch.table(each.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "counts")
    ranked = (
        each.join(shared, "v")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    )
    size = F.least("n", F.lit(k))
    whole = F.expr(f"cast((n * {num} + {den - 1}) div {den} as int)")
    least = F.least(whole, F.lit(_least(num, den, k)))
    alone = size - F.size("vs")
    take = (size - least + 1 - alone).cast("int")
    lists = (
        ranked.withColumn("take", take)
        .filter("take > 0")
        .select("rep", "n", F.explode(F.expr("slice(vs, 1, take)")).alias("e"))
        .select(F.col("e.v").alias("v"), "rep", "n")
    )
    out = scratch.table(part(lists), "lists")
    scratch.drop(shared)
    return out


def _link_lists(scratch: Scratch, listed, sets, num: int, den: int, k: int):
    """(node, root) of linked representatives, or None."""
    fits = F.least("n", "pn") * den >= F.greatest("n", "pn") * num
    roots, links, step, rows = None, None, 0, 0
    size = listed.count()
    left, stored = listed.withColumn("root", F.col("rep")), None
    while True:
        one = left.groupBy("v", "root").agg(
            F.count(F.lit(1)).alias("c"),
            F.min_by(F.struct("rep", "n", "root"), F.xxhash64("rep", F.lit(step)) if step else F.col("rep")).alias("p"),
        )
        spread = one.groupBy("v").agg(
            F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count(F.lit(1)).alias("parts"),
            F.min_by("p", F.struct("c", "p.rep") if step else F.col("p.rep")).alias("p"),
        ).filter("parts > 1")
        spread = scratch.table(spread, "open", rows=size)
        across = (F.col("c") * F.col("c") - F.col("within")) / 2
        total = spread.agg(F.sum("c").alias("rows"), F.sum(across).alias("pairs"), F.count(F.lit(1)).alias("lists")).first()
        if not total["rows"]:
            return roots
        rows = rows or total["rows"]
        if step > 1 or step and total["pairs"] <= REST_PER_ROW * rows:
            rest = left.join(spread.select("v"), "v", "left_semi")
            found = scratch.table(_in_blocks(scratch, rest, sets, num, den), "links")
            if found.isEmpty():
                return roots
            return contract(found if links is None else links.unionByName(found), scratch)
        pivots = spread.select("v", "p")
        left = left.join(F.broadcast(pivots) if total["lists"] <= FEW_LISTS else pivots, "v")
        members = left.select("v", "rep", "n", "root", F.col("p.rep").alias("q"), F.col("p.n").alias("pn"), F.col("p.root").alias("qroot"))
        pairs = members.filter((F.col("rep") != F.col("q")) & (F.col("root") != F.col("qroot")) & fits)
        pairs = pairs.select(F.least("rep", "q").alias("a"), F.greatest("rep", "q").alias("b"))
        found = scratch.table(_verified(pairs.distinct(), sets, num, den, k), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = contract(links, scratch)
        left = left.filter(F.col("rep") != F.col("p.rep")).select("v", "rep", "n")
        if roots is not None:
            left = left.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
                "v", "rep", "n", F.coalesce("root", "rep").alias("root")
            )
        else:
            left = left.withColumn("root", F.col("rep"))
        size = total["rows"]
        before, stored = stored, scratch.table(left, "left", rows=size)
        left = stored
        scratch.drop(spread, *([] if before is None else [before]))
        step += 1


def _in_blocks(scratch: Scratch, rest, sets, num: int, den: int, block: int = 400):
    """Links (a, b) between components among the documents that the remaining lists hold together.

    Documents that meet in lists, directly or by others, form a group; it is cut into blocks of about
    ``block`` documents (fewer, if they are long), and each pair of blocks is one task's unit, compared on full sets by products
    of incidence matrices.  A unit's memory does not depend on the group, and only links leave it.
    """
    first = rest.groupBy("v").agg(F.min("rep").alias("a"))
    groups = contract(rest.join(first, "v").select("a", F.col("rep").alias("b")).distinct(), scratch)
    docs = rest.select("rep", "n", "root").distinct().join(groups.withColumnRenamed("node", "rep").withColumnRenamed("root", "grp"), "rep")
    docs = scratch.table(docs, "rest", rows=rest.count())
    load = F.greatest(F.count(F.lit(1)) / block, F.sum("n") / (block * 1000))
    many = docs.groupBy("grp").agg(F.ceil(load).cast("int").alias("nb"))
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    units = docs.join(many, "grp").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = units.select("grp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "n", "root")
    dealt = units.join(sets.select("rep", "items"), "rep").repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")

    def links(unit):
        sets_ = [np.frombuffer(r[6], np.int64) for r in unit]
        size = np.array([len(x) for x in sets_])
        row = np.repeat(np.arange(len(unit)), size)
        _, col, df = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        rank = np.cumsum(df > 1) - 1
        met = df[col] > 1
        row, col = row[met], rank[col[met]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(unit), len(unit)), np.float32)
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
            x, y = np.searchsorted(col, [c, c + 2048])
            m = np.zeros((len(unit), 2048), np.float32)
            m[row[x:y], col[x:y] - c] = 1
            both += m @ m.T
        root = np.unique([r[5] for r in unit], return_inverse=True)[1]
        side = np.array([r[3] for r in unit])
        ok = den * both >= num * (size[:, None] + size[None, :] - both)
        ok &= root[:, None] < root[None, :]
        if unit[0][1] != unit[0][2]:
            ok &= side[:, None] != side[None, :]
        return [(unit[a][4], unit[b][4]) for a, b in zip(*np.nonzero(ok))]

    def run(batches):
        unit, out = [], []
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("grp", "lo", "hi", "i", "rep", "root", "items")]):
                if unit and unit[0][:3] != r[:3]:
                    out.extend(links(unit))
                    unit = []
                unit.append(r)
        if unit:
            out.extend(links(unit))
        one, two = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(one, kind), pa.array(two, kind)], names=["a", "b"])

    kind = to_arrow_type(rest.schema["rep"].dataType)
    pairs = dealt.select("grp", "lo", "hi", "i", "rep", "root", "items").mapInArrow(run, T.StructType([T.StructField(c, rest.schema["rep"].dataType) for c in "ab"]))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs, sets, num: int, den: int, k: int):
    """The pairs that are similar on full sets, after the estimate on the union sketch of the k smallest values of each."""
    one = sets.select(F.col("rep").alias("a"), F.slice("sketch", 1, k).alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.slice("sketch", 1, k).alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    likely = (
        pairs.join(one, "a").join(two, "b").withColumn("u", union)
        .filter(F.when(F.size("u") < k, both * den >= F.size("u") * num).otherwise(both >= _least(num, den, k)))
        .select("a", "b")
    )
    x = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    return _similar(likely.join(x, "a").join(y, "b").select("a", "b", "x", "y"), num, den).distinct()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that ``near_groups`` keeps, with their own columns."""
    scratch = Scratch(docs.sparkSession, "near")
    source, cols = _numbered(docs, docs.columns, scratch)
    gone = _judged(source, cols[id_col], cols[text_col], scratch, **kw).filter("not kept").select("_uid")
    return source.join(gone, "_uid", "left_anti").select(*[F.col(x).alias(c) for c, x in cols.items()])
