"""Near-duplicate embeddings by sorted projection passes.

Each pass draws its own random hyperplanes, writes which side of each a vector is on as the bits of a number, and orders the
vectors of a label by it. Near vectors share many leading bits, so they come near each other in some pass; each
vector is compared, by cosine in double precision, with the `window` vectors after it. Verified pairs
of all passes are joined to components. The order is dealt to tasks in ranges; the rows at the ends of each range are compared
once more with those of its neighbours, so that no window ends at the edge of a task.

Hyperplanes go through the mean of the label, since around a common direction sides of planes through the origin tell little. The
number of passes follows the data: `passes_for` says how many find a pair at the threshold itself with probability `recall`, from the size of
a label and the spread around its mean; closer pairs are found more surely. So passes grow with a label's size, by about its fifth root.

That model takes a label to be evenly spread around its mean, and a label of several tight groups is not. So what the passes found is
checked: from the numbers of pairs that one pass alone found and that two did, Chao's estimator tells how many pairs no pass found. Labels
in which that is more than 1 - `assured` of all are compared in full, and so are labels for which windows would cost as much as that, or
that need more than `PASSES`. These comparisons are quadratic in such a label.

All pairs within a component, and only those (of labels compared in full, all pairs), are compared by matrix products over tiles, pairs of strips of
bounded size, for the number of links of each vector; a hot component is so spread over many tasks. Of a label compared in full each tile also
gives a forest that joins what it links, at most one link a vector.

Equal vectors of a label are one row with a count throughout, so a very common vector costs what one does.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label,
link with nothing (n_links 0, component_id = vec_id, kept). Repeated rows of one vec_id and vector link with each other as
others do; different vectors of one vec_id have counts of their own. Rows with a null vec_id are returned unlinked. Vectors of different
lengths never link. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, n_tasks, written
from augsearch.llm.components import components

THRESHOLD = 0.93
TOGETHER, WINDOW, BLOCK, RECALL, ASSURED = 4, 24, 512, 0.999, 0.998
#: Passes at most, which is enough for labels of 10^8 evenly spread vectors; labels that need more are compared in full.
PASSES = 128
#: A strip has a quarter of its component, at least BLOCK rows and at most about so many components of vectors.
STRIP = 1 << 21


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """Rows of doubles, a group for each length: (rows, matrix)."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.float64)
    ends = np.cumsum(sizes)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable() -> Column:
    e = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    whole &= F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(whole, F.lit(False))


def passes_for(size: float, spread: float, threshold: float, window: int, recall: float) -> int:
    """How many passes bring a pair of that cosine into one window with that probability. spread: the mean squared distance of a label's unit
    vectors from their mean, 1 for evenly spread ones."""
    # of the pair as seen from the mean; in labels so tight that it would be less, most vectors are linked, and any window finds links
    cosine = max(0.6, 1 - (1 - threshold) / max(spread, 1e-9))
    same_side = 1 - np.arccos(cosine) / np.pi
    bits = max(0.0, np.log2(max(size, 1.0) / window))  # that a pair has to share, so that fewer than a window's rows come between
    found = same_side**bits
    return 1 if found >= recall else int(min(PASSES + 1, np.ceil(np.log(1 - recall) / np.log1p(-found))))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pass", pa.int32()), ("label", pa.int64()), ("code", pa.int64()), ("vec", pa.int64()), ("embedding", pa.list_(pa.float64()))])
_FOUND_DDL = "a long, b long, pass int, label long, code long, vec long, embedding array<double>"


def _links(threshold: float, window: int, ends: bool):
    """Rows (pass, label, code, vec, embedding) of a range of the order -> pairs that are near enough (a, b); where `ends`, also the first and the last rows of the range."""

    def edge(b: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(b.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *(c.cast(f.type) for c, f in zip(b.columns, list(_FOUND)[2:]))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen = None, 0  # the last rows of what came before
        for b in batches:
            if not b.num_rows:
                continue
            if ends and seen < window:
                yield edge(b.slice(0, window - seen))
            seen += b.num_rows
            if tail is not None:
                b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
            new = 0 if tail is None else tail.num_rows
            key = np.stack([np.asarray(b.column(i)) for i in (0, 1)], 1)  # pass and label
            vec = np.asarray(b.column(3))
            left, right, at = [], [], []
            for rows, x in _matrix(b.column(4)):
                x = _unit(x)
                for d in range(1, min(window, len(rows) - 1) + 1):
                    i, j = rows[:-d], rows[d:]
                    ok = (key[i] == key[j]).all(1) & (j >= new)
                    near = np.flatnonzero(ok)
                    near = near[np.einsum("ij,ij->i", x[near], x[near + d]) >= threshold]
                    left.append(vec[i[near]])
                    right.append(vec[j[near]])
                    at.append(key[i[near]])
            if left:
                pairs = np.unique(np.concatenate([np.sort(np.stack([np.concatenate(left), np.concatenate(right)], 1), 1), np.concatenate(at)], 1), axis=0)
                none = [pa.nulls(len(pairs), f.type) for f in list(_FOUND)[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32)), pa.array(pairs[:, 3]), *none], schema=_FOUND)
            tail = b.slice(max(0, b.num_rows - window))
        if ends and tail is not None:
            yield edge(tail)

    return run


def _codes(passes: list[int], seed: int):
    """Rows (vec, label, embedding, centre) -> each vector once for each pass, with its place in the pass's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for (rows, x), (_, centre) in zip(_matrix(b.column(2)), _matrix(b.column(3))):
                parts.append((rows, _unit(x) - centre))
            for p in passes:
                code = np.zeros(b.num_rows, np.uint64)
                for rows, x in parts:
                    planes = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], 64))
                    code[rows] = ((x @ planes) > 0) @ (np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, p, np.int32)), b.column(1), pa.array((code ^ np.uint64(1 << 63)).view(np.int64)), b.column(0), b.column(2)], names=["pass", "label", "code", "vec", "embedding"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, embedding) -> of each label and length in the task: label, dims, n, sum of the unit vectors."""
    sums: dict[tuple[int, int], list] = {}
    for b in batches:
        label = np.asarray(b.column(0))
        for rows, x in _matrix(b.column(1)):
            x = _unit(x)
            for one in np.unique(label[rows]):
                part = x[label[rows] == one]
                n, s = sums.get((int(one), x.shape[1]), (0, 0.0))
                sums[int(one), x.shape[1]] = (n + len(part), s + part.sum(0))
    if sums:
        rows = [(label, dims, n, s) for (label, dims), (n, s) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["label", "dims", "n", "sum"])


_TILE = ["component", "label", "dims", "i", "j"]
#: The component of labels that are compared in full.
FULL = -1


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of the links a-b among numbers below n, as few as join the same numbers: each number's row is one it is joined to, or itself."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        up = up[up]
        if np.array_equal(before, up):
            return up


def _compared(threshold: float, block: int = 1024):
    """Of each pair of strips, how many links each vector has into the other strip; of labels compared in full also links (a, b) that
    join what it links. Rows come by _TILE, then side; the strip of side 0 is held, that of side 1 streams."""

    def part(b: pa.RecordBatch):
        vec, key, n = (np.asarray(b.column(i)) for i in range(6, 9))
        return vec, key, n, _unit(np.asarray(b.column(9).flatten()).reshape(b.num_rows, -1))

    def out(label, vec, key, links):
        none = pa.nulls(len(vec), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), label)), pa.array(vec), pa.array(key), pa.array(links), none, none], names=["label", "vec", "hash", "links", "a", "b"])

    def joining(one, two, joins: list):
        """The links of a forest over the rows of both."""
        vec = np.concatenate([one[0], two[0]])
        a, b = (np.concatenate([j[n] for j in joins]) for n in (0, 1))
        up = _forest(a, b + len(one[0]), len(vec))
        at = np.flatnonzero(up != np.arange(len(vec)))
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(vec[at]), pa.array(vec[up[at]])], names=["label", "vec", "hash", "links", "a", "b"])

    def compare(one, two, same: bool, joins: list | None = None):
        """Links of the rows of one and of two; of pairs of one strip each is seen from both sides in the first. joins: gets a forest of each block's links."""
        left, right = np.zeros(len(one[0]), np.int64), np.zeros(len(two[0]), np.int64)
        for i in range(0, len(left), block):
            for j in range(0, len(right), block):
                a, b = slice(i, i + block), slice(j, j + block)
                near = one[3][a] @ two[3][b].T >= threshold
                if same and i == j:
                    np.fill_diagonal(near, False)
                left[a] += near @ two[2][b]
                right[b] += one[2][a] @ near
                if joins is not None and near.any():
                    x, y = np.nonzero(near)
                    up = _forest(x, y + len(near), sum(near.shape))
                    rows = np.flatnonzero(up[: len(near)] != np.arange(len(near)))  # a row joined to another is so through a column
                    first = near.argmax(1)
                    columns = np.flatnonzero(near.any(0))
                    joins.append((np.concatenate([rows, up[len(near) + columns]]) + i, np.concatenate([first[rows], columns]) + j))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, one, links = None, [], None, None

        def gathered():
            return tuple(np.concatenate(c) for c in zip(*held))

        def done():
            if one is None and held and tile[3] == tile[4]:
                strip, joins = gathered(), [] if tile[0] == FULL else None
                yield out(tile[1], strip[0], strip[1], compare(strip, strip, True, joins)[0])
                if joins:
                    yield joining(strip, strip, joins)
            elif one is not None:
                yield out(tile[1], one[0], one[1], links)

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(6)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                *at, side = keys[start].tolist()
                if at != tile:
                    yield from done()
                    tile, held, one, links = at, [], None, None
                rows = part(b.slice(start, stop - start))
                if side == 0:
                    held.append(rows)
                elif held:
                    if one is None:
                        one, held = gathered(), [rows]
                        links = np.zeros(len(one[0]), np.int64)
                    joins = [] if tile[0] == FULL else None
                    left, right = compare(one, rows, False, joins)
                    links += left
                    yield out(tile[1], rows[0], rows[1], right)
                    if joins:
                        yield joining(one, rows, joins)
        yield from done()

    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, block: int = BLOCK, seed: int = 3, recall: float = RECALL, assured: float | None = ASSURED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. passes: by default as many as `recall` needs. assured: the share of links that
    the passes have to have found by the estimate, or a label is compared in full; None for what the passes find and no more."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("hash", F.when(usable(), F.xxhash64("embedding")))
    # each usable vector of a label once, under its least vec_id
    distinct = written(rows.filter("hash is not null").groupBy("label", "hash", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n")), "vectors")
    # the mean of each label; a row for each label and length
    dims = F.size("embedding").alias("dims")
    sums = distinct.select("label", "embedding").mapInArrow(_sums, "label long, dims int, n long, sum array<double>").select("label", "dims", "n", F.posexplode("sum"))
    sums = sums.groupBy("label", "dims", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum"))
    means = sums.groupBy("label", "dims").agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("sum") / F.col("n")).alias("mean")))), lambda x: x["mean"]).alias("centre"))
    spread = 1 - F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)
    kinds = {"size_of": F.ceil(F.log2("size") * 4).cast("int"), "spread_of": F.ceil(spread * 64).cast("int")}
    means = written(means.withColumns(kinds), "means")
    # what a label needs follows its size and spread
    needs = []
    for k in means.select(*kinds).distinct().collect():  # some 200 sizes by 65 spreads at most
        size = 2 ** (k.size_of / 4)
        need = passes_for(size, max(k.spread_of - 1, 0.5) / 64, threshold, window, recall) if passes is None else passes
        needs.append((k.size_of, k.spread_of, need, assured is not None and (need > PASSES or need * window >= size / 2)))
    needs = spark.createDataFrame(needs, "size_of int, spread_of int, passes int, full boolean")
    means = means.join(F.broadcast(needs), list(kinds)).select("label", "dims", "centre", "passes", "full")
    centred = distinct.select("vec", "label", "embedding", dims).join(means.filter("not full"), ["label", "dims"]).select("vec", "label", "embedding", "centre", "passes")
    found = spark.createDataFrame([], "a long, b long, pass int, label long")
    order = ("pass", "label", "code", "vec")
    for p in range(0, max((n.passes for n in needs.filter("not full").collect()), default=0), TOGETHER):
        coded = centred.filter(F.col("passes") > p).mapInArrow(_codes(list(range(p, p + TOGETHER)), seed), "pass int, label long, code long, vec long, embedding array<double>")
        ranges = written(coded.repartitionByRange(n_tasks(spark), *order).sortWithinPartitions(*order).mapInArrow(_links(threshold, window, True), _FOUND_DDL), "links")
        ends = ranges.filter("a is null").select(*order, "embedding").distinct().repartition(n_tasks(spark), "pass", "label").sortWithinPartitions(*order)
        links = ranges.filter("a is not null").union(ends.mapInArrow(_links(threshold, window, False), _FOUND_DDL))
        found = found.union(links.select("a", "b", "pass", "label"))
    # a vec may stand for different vectors of one repeated vec_id: those need no link
    pairs = written(found.filter("a <> b").distinct().groupBy("label", "a", "b").agg(F.count("*").alias("times")), "pairs")
    often = lambda n: F.sum((F.col("times") == n).cast("double"))
    unseen = F.col("once") * (F.col("once") - 1) / (2 * (F.col("twice") + 1))
    told = pairs.groupBy("label").agg(F.count("*").alias("all"), often(1).alias("once"), often(2).alias("twice"))
    doubtful = told.filter(F.col("all") < F.lit(assured or 0.0) * (F.col("all") + unseen)).select("label")
    full = written(means.filter("full").select("label", "dims").union(means.join(doubtful, "label").select("label", "dims")).distinct(), "full-labels")
    sure = pairs.join(full.select("label").distinct(), "label", "left_anti")
    joined = written(components(sure.select("a", "b").distinct()), "embedding-components")
    vectors = distinct.select("label", dims, "vec", "hash", "n", "embedding")
    members = vectors.join(joined, F.col("vec") == F.col("node")).join(full, ["label", "dims"], "left_anti").select("component", *vectors.columns)
    members = members.union(vectors.join(full, ["label", "dims"]).select(F.lit(FULL).cast("long"), *vectors.columns))
    # strips follow the size of the component: few copies of each vector, and a strip that a task can hold
    sized = members.groupBy("component", "label", "dims").agg(F.count("*").alias("size")).filter("size > 1")
    rows_of_strip = F.least(F.greatest(F.lit(block), F.ceil(F.col("size") / 4)), F.greatest(F.lit(block), F.floor(F.lit(STRIP) / F.col("dims"))))
    sized = sized.select("component", "label", "dims", F.ceil(F.col("size") / rows_of_strip).cast("int").alias("strips"))
    dealt = members.join(sized, ["component", "label", "dims"]).withColumn("own", F.pmod(F.xxhash64("vec", "hash", F.lit(seed)), F.col("strips")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    tiles = dealt.select("component", "label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "vec", "hash", "n", "embedding")
    tiles = tiles.repartition(n_tasks(spark), *_TILE).sortWithinPartitions(*_TILE, "side")
    compared = written(tiles.mapInArrow(_compared(threshold), "label long, vec long, hash long, links long, a long, b long"), "compared")
    linked = compared.filter("a is null").groupBy("label", "vec", "hash").agg(F.sum("links").alias("links"))
    edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(compared.select("a", "b")).filter("a <> b")
    joined = written(components(edges, "all-components"), "all-components")
    classes = distinct.join(joined, F.col("vec") == F.col("node"), "left").join(linked, ["label", "vec", "hash"], "left")
    classes = classes.select("label", "hash", "embedding", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    all_rows = rows.join(classes, ["label", "hash", "embedding"], "left")
    component = F.coalesce("component", "vec", "vec_id")
    return all_rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))
