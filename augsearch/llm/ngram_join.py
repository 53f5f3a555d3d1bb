"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

1. A scan hashes each whole text's shingles. Documents of equal sets become one class under their least doc_id; classes
   alone go on.
2. In one order of all tokens, frequent ones last, two linked sets of n tokens share n / 20 of the first quarter of each (prefix
   filter), and their sizes are at most a step apart. Classes that share fewer with all others together go, then pairs that share fewer. Classes that
   the other pairs connect are a *neighbourhood*; no link leaves one. Texts of one language share some token by chance, and the more texts there are,
   the more of them do, so a single token would connect all. These are the top of the hierarchy.
3. Below it are signature trees. Classes in order of neighbourhood are dealt to blocks, and each block is the leaves of a
   tree: a leaf holds the bitmap of its set, over the tokens that more than one leaf has, a node the OR of its
   children's, and the range of their sizes. Pairs of nodes are traversed from the top, and a pair is dropped when its largest
   possible overlap is too small, its sizes are too far apart, it has no neighbourhood in common, or all of it is one component
   already. Bitmaps of leaves are exact, so what is left at the bottom are links.
4. Neighbourhoods of several blocks go on: a few members of each component are the leaves of new trees until that joins nothing more. Then all their
   classes, in order of component, are dealt to blocks anew, and the trees of any two blocks that share a token of the prefix
   between different components are traversed against each other. A hot neighbourhood is so spread over pairs of blocks, each of bounded size.

The frequency of tokens decides their order alone, so it bears on cost and never on results. Sets are read from
the documents through a Bloom filter of fixed size, so that sets of documents without a neighbour are neither stored nor shuffled; with
more ids than the filter holds, more sets are stored, and results stay the same.

Defined results: texts that are null or have no word have n_shingles 0 and are linked with nothing; rows of a repeated
doc_id are one node; rows with a null doc_id are returned unlinked; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, forget, freed, n_tasks, slices, written
from augsearch.llm.components import components

WORDS = 5
PERCENT = 80
#: Leaves of a block, and children of a node.
BLOCK, FAN = 512, 16
#: A block ends before it has this many tokens; a set larger than that is a block of its own.
BLOCK_TOKENS = 1 << 20
#: A token is common when this many documents have it in their prefix by hash; such tokens come late in the order.
COMMON = 3
#: Linked sets share one token of their prefixes, and one more for so many tokens that they have in common at least.
SPARE = 16
#: Tokens that at most this many classes of a step have are counted for each pair; those of a more frequent one are taken to be connected.
FEW = 16
#: A token is frequent when at least one document in this many has it.
FREQUENT = 1000
#: Bits of the Bloom filters, at most (8 MB).
BLOOM = 1 << 26

_LOWER = np.array([0 if b == 32 or 9 <= b <= 13 else (b + 33 if 65 <= b <= 90 else b + 1) for b in range(256)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K = np.random.default_rng(91).integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]), dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    with np.errstate(over="ignore"):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        c = _LOWER[data]
        inside = c > 0
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & ~before)
        if not len(starts):
            return [np.zeros(0, np.uint64)] * len(texts)
        ends = np.flatnonzero(before & ~inside)
        at = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
        power = _powers(int((ends - starts).max()) + 1)
        word = np.add.reduceat(c * power[np.where(inside, at, 0)], starts) + (ends - starts).astype(np.uint64)
        word = _mix(word * _BASE)
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        firsts = np.concatenate([[0], bounds[:-1]])
        runs = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            runs += word[k : k + len(runs)] * _K[k]
        runs = _mix(runs)
        out = []
        for a, b in zip(firsts.tolist(), bounds.tolist()):
            if b - a >= WORDS:
                out.append(np.unique(runs[a : b - WORDS + 1]))
            elif b > a:
                out.append(_mix(np.array([(word[a:b] * _K[: b - a]).sum() + _K[WORDS] * np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _texts(batches: Iterator[pa.RecordBatch]):
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            yield b.column(0).to_pylist(), [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]


_SCAN = pa.schema([("frequent", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _scan(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A row per document, with the prefix of its set by hash; then a row per token that many documents of the task have (doc_id: the token, n: how many)."""
    none = np.zeros(0, np.uint64)
    seen: list[np.ndarray] = []
    docs = held = 0
    often: dict[int, int] = {}

    def count():
        nonlocal seen, held
        if seen:
            tokens, n = np.unique(np.concatenate(seen), return_counts=True)
            some = n >= max(3, len(seen) // (2 * FREQUENT))
            for t, k in zip(tokens[some].view(np.int64).tolist(), n[some].tolist()):
                often[t] = often.get(t, 0) + k
        seen, held = [], 0

    with np.errstate(over="ignore"):
        for ids, texts in _texts(batches):
            rows = []
            for doc_id, tokens in zip(ids, shingle_sets(texts)):
                docs += 1
                if not len(tokens):
                    rows.append((False, doc_id, 0, None, None))
                    continue
                rows.append((False, doc_id, len(tokens), hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), prefix(tokens, none, None, percent).view(np.int64)))
                seen.append(tokens)
                held += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN)], schema=_SCAN)
            if held > 4 << 20:
                count()
        count()
    items = list(often.items())
    for i in range(0, len(items), 10_000):
        t, n = zip(*items[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([True] * len(t), t, n, [None] * len(t), [None] * len(t)), _SCAN)], schema=_SCAN)


def prefix(tokens: np.ndarray, frequent: np.ndarray, common: Bloom | None, percent: int, spare: bool = False) -> np.ndarray:
    """The first tokens in the order (frequent or common, token) of which any set at least that similar has one; if spare, as many more as
    let the prefixes of two such sets have 1 + overlap // SPARE tokens in common, for the overlap that the smaller set has to have at least."""
    n = len(tokens)
    overlap = -(-percent * n // 100)
    size = n - overlap + 1 + spare * (overlap // SPARE)
    often = np.zeros(n, bool)
    if len(frequent):
        often |= frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    if common is not None:
        often |= common.has(tokens)
    if often.any():
        tokens = np.concatenate([tokens[~often], tokens[often]])
    return tokens[:size]


class Bloom:
    """A set of 64-bit hashes. May say yes to others, never no to a member."""

    def __init__(self, hashes: DataFrame, column: str, count: int):
        self.bits = min(BLOOM, max(1 << 12, 1 << (12 * count).bit_length()))
        places = F.explode(F.array(*[F.shiftrightunsigned(column, k).bitwiseAND(F.lit(self.bits - 1)) for k in (0, 13, 26)])).alias("at")
        words = hashes.select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        table = words.toArrow()  # bits / 64 rows at most
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[np.asarray(table.column(0)).astype(np.int64)] = np.asarray(table.column(1)).astype(np.int64).view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: unsigned."""
        out = np.ones(len(hashes), bool)
        for k in (0, 13, 26):
            at = (hashes >> np.uint64(k)) & np.uint64(self.bits - 1)
            out &= ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def _sets_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """doc_id, n, tokens (binary) of the documents whose id is among ids (and of a few others)."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(ids.select(F.xxhash64("doc_id").alias("hash")), "hash", ids.count()))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(bloom.value.has(np.asarray(b.column(1)).astype(np.int64).view(np.uint64))))
            for doc_ids, texts in _texts([b]):
                sets = shingle_sets(texts)
                rows = [(d, len(s), s.tobytes()) for d, s in zip(doc_ids, sets) if len(s)]
                if rows:
                    d, n, s = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.binary())], names=["doc_id", "n", "tokens"])

    return written(docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(run, "doc_id long, n long, tokens binary"), name)


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of these ids (and a few others), so that a join with the ids doesn't shuffle the rest."""
    bloom = sets.sparkSession.sparkContext.broadcast(Bloom(ids.select(F.xxhash64("doc_id").alias("hash")), "hash", ids.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.value.has(np.asarray(b.column(3)).view(np.uint64)))).select(["doc_id", "n", "tokens"])

    return sets.select("doc_id", "n", "tokens", F.xxhash64("doc_id").alias("hash")).mapInArrow(run, "doc_id long, n long, tokens binary")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Of each sorted set a bitmap over the tokens that more than one of them has."""
    tokens, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    words = max(1, -(-int(shared.sum()) // 64))
    keep = shared[column]
    row, at = np.repeat(np.arange(len(sets)), sizes)[keep], (np.cumsum(shared) - 1)[column[keep]]
    out = np.zeros((len(sets), words), np.uint64)
    if len(at):
        word = row * words + (at >> 6)  # ascending, since the sets are sorted
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out.ravel()[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
    return out


class Tree:
    """levels[0] are the leaves; nodes are (bitmap, least and most size, least and most neighbourhood)."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, near: np.ndarray):
        node = (bits, n, n, near, near)
        self.levels = [node]
        while len(node[1]) > 1:
            cuts = np.arange(0, len(node[1]), FAN)
            node = tuple(f.reduceat(x, cuts, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.minimum, np.maximum), node))
            self.levels.append(node)


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes i of x and j of y may hold a link; exact for leaves."""
    bits, least, most, low, high = range(5)
    out = (100 * x[most][i] >= percent * y[least][j]) & (100 * y[most][j] >= percent * x[least][i])
    out &= (x[low][i] <= y[high][j]) & (y[low][j] <= x[high][i])
    at = np.flatnonzero(out)
    for part in np.array_split(at, max(1, len(at) * x[bits].shape[1] // (1 << 20) + 1)):
        a, b = i[part], j[part]
        overlap = np.bitwise_count(x[bits][a] & y[bits][b]).sum(1).astype(np.int64)
        overlap = np.minimum(overlap, np.minimum(x[most][a], y[most][b]))
        out[part] = (100 + percent) * overlap >= percent * (x[least][a] + y[least][b])
    return out


def _children(i: np.ndarray, j: np.ndarray, one: Tree, two: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of this level below pairs of the level above it. A tree that is less high waits at its root."""
    a, b = ((k[:, None] * FAN + np.arange(FAN)) if level < len(tree.levels) - 1 else k[:, None] for k, tree in ((i, one), (j, two)))
    i, j = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
    inside = (i < len(_level(one, level)[1])) & (j < len(_level(two, level)[1]))
    return i[inside], j[inside]


def _level(tree: Tree, level: int) -> tuple:
    return tree.levels[min(level, len(tree.levels) - 1)]


def traverse(one: Tree, two: Tree | None, comp: np.ndarray, percent: int, together: int = 32) -> Iterator[tuple[int, int]]:
    """Links that join components, as pairs of leaves; two is None: within one. comp has the component of each leaf of one, then of two, and is updated."""
    other, offset = two or one, 0 if two is None else len(one.levels[0][1])
    depth = max(len(one.levels), len(other.levels))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth - 2, 0, -1):
        i, j = _children(i, j, one, other, level)
        if two is None:
            i, j = i[i <= j], j[i <= j]
        ok = possible(_level(one, level), i, _level(other, level), j, percent)
        i, j = i[ok], j[ok]
    if two is None:  # what is near in the order first
        order = np.argsort(j - i, kind="stable")
        i, j = i[order], j[order]
    up = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    for k in range(0, len(i), together):
        a, b = (i[k : k + together], j[k : k + together])
        if depth > 1:
            a, b = _children(a, b, one, other, 0)
        some = comp[a] != comp[b + offset]
        if two is None:
            some &= a < b
        a, b = a[some], b[some]
        ok = possible(one.levels[0], a, other.levels[0], b, percent)
        grown = False
        for x, y in zip(a[ok].tolist(), (b[ok] + offset).tolist()):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                grown = True
                yield x, y
        if grown:
            distinct, inverse = np.unique(comp, return_inverse=True)
            comp[:] = np.array([root(c) for c in distinct.tolist()], np.int64)[inverse]


def links_of(docs: np.ndarray, near: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], first: int | None, percent: int) -> list[tuple[int, int]]:
    """Links among the leaves, or, where `first` is given, between the first so many and the others: pairs of doc_ids. Updates comp."""
    bits, n = bitmaps(sets), np.array([len(x) for x in sets], np.int64)
    if first is None:
        found = traverse(Tree(bits, n, near), None, comp, percent)
    else:
        found = traverse(Tree(bits[:first], n[:first], near[:first]), Tree(bits[first:], n[first:], near[first:]), comp, percent)
    return [(int(docs[x]), int(docs[y])) for x, y in found]


_LEAF = "near long, comp long, doc_id long, n long, tokens binary"


def _leaves(b: pa.RecordBatch) -> tuple:
    near, comp, docs, n = (np.asarray(b.column(k)) for k in range(4))
    return near, comp, docs, n, [np.frombuffer(x, np.uint64) for x in b.column(4).to_pylist()]


def _in_blocks(work, block: int, most: int):
    """work: (number of a block, its leaves) -> batches. Leaves come in order; a block ends between neighbourhoods once it is half full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, tokens, last = TaskContext.get().partitionId() << 32, [], 0, 0, None
        for b in batches:
            start = 0
            for k, (near, n) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                half = near != last and (2 * rows >= block or 2 * tokens >= most)
                if rows and (half or rows >= block or tokens + n > most):
                    held.append(b.slice(start, k - start))
                    yield from work(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    number, held, start, rows, tokens = number + 1, [], k, 0, 0
                rows, tokens, last = rows + 1, tokens + n, near
            held.append(b.slice(start))
        if rows:
            yield from work(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _linked(percent: int):
    """Work on a block: its links (a, b), then its members (doc_id, near, block, was: the component before, comp: the component that they have in the block)."""

    def work(number: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        near, comp, docs, _, sets = _leaves(b)
        was, comp = comp, comp.copy()
        found = links_of(docs, near, comp, sets, None, percent) if b.num_rows > 1 else []
        x, y = (list(c) for c in zip(*found)) if found else ([], [])
        members = [docs.tolist(), near.tolist(), [number] * len(docs), was.tolist(), comp.tolist()]
        columns = [x + [None] * len(docs), y + [None] * len(docs), *[[None] * len(x) + m for m in members]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "doc_id", "near", "block", "was", "comp"])

    return work


def _tiled(number: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number)), *b.columns], names=["block", *b.schema.names])


def _across(percent: int):
    """Rows of pairs of blocks (i, j, side, leaf), in order -> links between the blocks, or within the block where i = j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            if now is None:
                return
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            near, comp, docs, _, sets = _leaves(b.select(["near", "comp", "doc_id", "n", "tokens"]))
            first = int((np.asarray(b.column(2)) == 0).sum())
            found = links_of(docs, near, comp.copy(), sets, None if now[0] == now[1] else first, percent) if b.num_rows > 1 else []
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                pair = tuple(keys[start].tolist())
                if pair != now:
                    yield from done()
                    now, held = pair, []
                held.append(b.slice(start, stop - start))
        yield from done()

    return run


def _overlap(n: Column, percent: int) -> Column:
    """The least overlap of a set of n tokens with a linked one, which is also the least size of that."""
    return F.floor((percent * n + 99) / 100).cast("long")


def _needed(n: Column, percent: int) -> Column:
    """Tokens that the prefix of a set of n tokens has in common with that of a linked set that is no smaller."""
    return 1 + F.floor(_overlap(n, percent) / SPARE).cast("long")


def _supported(keyed: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """keyed: token, doc_id, n. Without the rows of documents that have too few tokens in common with all others together, and of tokens that only one
    of the rest has."""
    for k in range(rounds):
        # a linked set may be as small as the least overlap
        docs = keyed.groupBy("doc_id").agg(F.count("*").alias("held"), F.min("n").alias("n")).filter(F.col("held") >= _needed(_overlap(F.col("n"), percent), percent))
        rest = keyed.join(docs.select("doc_id"), "doc_id")
        tokens = rest.groupBy("token").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
        now = written(rest.join(tokens.select("token"), "token").select("token", "doc_id", "n"), f"keyed-{k + 1}")
        forget(keyed)
        keyed = now
        freed(keyed.sparkSession)
    return keyed


def _connected(postings: DataFrame, percent: int) -> DataFrame:
    """postings: token, step, doc_id, n, low (the lower step of doc_id), size (of the group of a token and step). -> a, b that may be linked, or, of
    groups larger than FEW, each document with the least one.

    A pair meets at a token once, under the higher of its lower steps. Of the tokens that it has to share, those of larger groups are taken to be shared.
    A pair that no other group has shares tokens of larger groups alone, so documents with too few of these need not be connected by them."""
    groups = postings.filter(F.col("size") <= FEW).groupBy("token", "step").agg(F.collect_list(F.struct("doc_id", "n", "low")).alias("all"))
    pairs = groups.select("step", "all", F.explode("all").alias("x")).select("step", "x", F.explode(F.expr("filter(all, y -> y.doc_id > x.doc_id and greatest(x.low, y.low) = step)")).alias("y"))
    smaller, larger = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    pairs = pairs.filter(smaller >= _overlap(larger, percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), _needed(smaller, percent).alias("needed"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("held"), F.min("needed").alias("needed"))
    large = postings.filter(F.col("size") > FEW)
    more = written(large.groupBy("doc_id").agg(F.count_distinct("token").alias("count"), F.min("n").alias("n")), "in-large-groups")
    large = large.join(more.filter(F.col("count") >= _needed(_overlap(F.col("n"), percent), percent)).select("doc_id"), "doc_id").select("token", "step", "doc_id")
    large = large.join(large.groupBy("token", "step").agg(F.min("doc_id").alias("least")), ["token", "step"])
    for c in "ab":
        pairs = pairs.join(more.select(F.col("doc_id").alias(c), F.col("count").alias(f"more_{c}")), c, "left")
    likely = pairs.filter(F.col("held") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) >= F.col("needed"))
    return written(likely.select("a", "b").union(large.filter("doc_id <> least").select("least", "doc_id").distinct()), "pairs")


def _step(percent: int) -> Column:
    """Sets whose steps differ by more than one can't be linked."""
    return F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")


_BLOCKS = "a long, b long, doc_id long, near long, block long, was long, comp long"


def _crossing(sets: DataFrame, members: DataFrame, postings: DataFrame, percent: int, block: int, most: int) -> DataFrame | None:
    """The links that neighbourhoods of several blocks still lack. members: doc_id, near, block, comp; two of one comp are known to be connected."""
    spark = sets.sparkSession
    several = members.groupBy("near").agg(F.count_distinct("block").alias("blocks")).filter("blocks > 1").select("near")
    left = written(members.join(several, "near").groupBy("doc_id", "near").agg(F.min("comp").alias("comp")), "crossing")
    if left.isEmpty():
        return None
    sets, links, count = written(_among(sets, left.select("doc_id").distinct()), "crossing-sets"), None, None
    while True:
        open_ = left.groupBy("near").agg(F.count_distinct("comp").alias("comps")).filter("comps > 1")
        now = open_.agg(F.sum("comps")).first()[0] or 0
        if not now or (count is not None and now > 0.9 * count):
            break
        count = now
        # a few members of each component stand for it
        some = left.join(open_.select("near"), "near").join(sets.select("doc_id", "n").distinct(), "doc_id").groupBy("near", "comp")
        some = some.agg(F.array_distinct(F.array(F.min("doc_id"), F.max_by("doc_id", F.xxhash64("doc_id")), F.min_by("doc_id", "n"), F.max_by("doc_id", "n"))).alias("docs"))
        leaves = some.select("near", "comp", F.explode("docs").alias("doc_id")).join(sets, "doc_id")
        found = written(_dealt(leaves.withColumn("step", _step(percent)), "near", "step", "n", "doc_id").mapInArrow(_in_blocks(_linked(percent), block, most), _BLOCKS), "crossing-blocks")
        some = found.filter("a is not null").select("a", "b")
        links = some if links is None else links.union(some)
        joined = found.filter("a is null").groupBy(F.col("was").alias("comp")).agg(F.min("comp").alias("now"))
        left = written(left.join(joined, "comp", "left").select("doc_id", "near", F.coalesce("now", "comp").alias("comp")), "crossing-state")
    if not now:
        return links
    left = left.join(open_.select("near"), "near")
    first = postings.groupBy("doc_id").agg(F.min("token").alias("first"))
    leaves = left.join(sets, "doc_id").join(first, "doc_id").withColumn("step", _step(percent))
    tiles = _dealt(leaves, "near", "comp", "step", "first", "doc_id").mapInArrow(_in_blocks(_tiled, block, most), f"block long, {_LEAF}")
    tiles = written(tiles, "crossing-tiles")
    ends = postings.select("token", "step", "doc_id").join(tiles.select("doc_id", "near", "block", "comp", "n"), "doc_id")
    ends = ends.groupBy("token", "step", "near", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    one, two = (ends.select("token", "step", "near", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high", "least", "most")]) for k in "12")
    differ = "block_1 <= block_2 and not (low_1 = high_1 and low_2 = high_2 and low_1 = low_2)"
    pairs = one.join(two, ["token", "step", "near"]).filter(differ).filter((100 * F.col("most_1") >= percent * F.col("least_2")) & (100 * F.col("most_2") >= percent * F.col("least_1")))
    pairs = written(pairs.select(F.col("block_1").alias("i"), F.col("block_2").alias("j")).distinct(), "crossing-pairs")
    freed(spark)
    sides = pairs.select("i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).union(pairs.filter("i < j").select("i", "j", F.lit(1), "j"))
    rows = sides.join(tiles, "block").select("i", "j", "side", "near", "comp", "doc_id", "n", "tokens")
    rows = rows.repartition(n_tasks(spark), "i", "j").sortWithinPartitions("i", "j", "side", "near", "comp", "n", "doc_id")
    found = written(rows.mapInArrow(_across(percent), "a long, b long").distinct(), "crossing-found")
    return found if links is None else links.union(found)


def _dealt(leaves: DataFrame, *order: str) -> DataFrame:
    """The leaves in ranges of the order."""
    return leaves.repartitionByRange(n_tasks(leaves.sparkSession), *order).sortWithinPartitions(*order).select("near", "comp", "doc_id", "n", "tokens")


def links(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, most: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n), equal sets (a, b) and links found in trees (a, b): enough of them to tell the components."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = written(docs.mapInArrow(lambda batches: _scan(batches, percent), "frequent boolean, doc_id long, n long, key binary, prefix array<long>"), "shingles")
    rows = scan.filter("not frequent").drop("frequent")
    sets = rows.filter("key is not null and doc_id is not null")
    n_docs = sets.count()
    # at most (shingles of a document on average) * FREQUENT tokens can be this frequent
    frequent = scan.filter("frequent").groupBy("doc_id").agg(F.sum("n").alias("n")).filter(F.col("n") * FREQUENT >= n_docs).select("doc_id").toArrow().column(0)
    frequent = spark.sparkContext.broadcast(np.sort(np.asarray(frequent).astype(np.int64).view(np.uint64)))
    often = written(sets.select(F.explode("prefix").alias("token")).groupBy("token").count().filter(F.col("count") >= COMMON).select("token"), "common")
    common = spark.sparkContext.broadcast(Bloom(often, "token", often.count()))
    freed(spark)
    # classes of equal sets
    classes = sets.groupBy("key").agg(F.min("doc_id").alias("rep"))
    equal = written(sets.select("doc_id", "key").join(classes, "key").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "equal")
    reps = written(classes.select(F.col("rep").alias("doc_id")).distinct(), "classes")
    # the prefixes by hash have done their work
    rows = written(rows.select("doc_id", "n"), "sizes")
    forget(scan)
    freed(spark)

    # who has no larger id of a class is in no doubt, and what surely has no least one goes unread; the few between are joined, so no prefixes are shuffled
    copies = equal.select("b").distinct()
    least, other = (spark.sparkContext.broadcast(Bloom(ids.select(F.xxhash64(ids.columns[0]).alias("hash")), "hash", ids.count())) for ids in (reps, copies))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(least.value.has(np.asarray(b.column(1)).astype(np.int64).view(np.uint64))))
            start, sure = 0, ~other.value.has(np.asarray(b.column(1)).astype(np.int64).view(np.uint64))
            for ids, texts in _texts([b]):
                sets = shingle_sets(texts)
                found = [prefix(x, frequent.value, common.value, percent, spare=True).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(sure[start : start + len(ids)])], names=["doc_id", "n", "tokens", "sure"])
                start += len(ids)

    known = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("hash"), "text")
    table = written(known.mapInArrow(prefixes, "doc_id long, n long, tokens array<long>, sure boolean").filter("n > 0"), "prefixes")
    prefixed = table.filter("sure").drop("sure").union(table.filter("not sure").drop("sure").join(reps, "doc_id", "left_semi"))
    # tokens that more than one class has
    by_token = prefixed.select(F.explode("tokens").alias("token"), "doc_id").groupBy("token").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = written(by_token.filter("least < most").select("token"), "shared-tokens")
    freed(spark)
    bloom = spark.sparkContext.broadcast(Bloom(shared, "token", shared.count()))

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = np.asarray(b.column(2).flatten())
            ok = bloom.value.has(tokens.view(np.uint64))
            doc, n, row = np.asarray(b.column(0)), np.asarray(b.column(1)), np.repeat(np.arange(b.num_rows), np.asarray(b.column(2).value_lengths()))
            # as in _supported, for each set; a linked set may be as small as the least overlap
            least = -(-percent * n // 100)
            ok &= (np.bincount(row[ok], minlength=b.num_rows) >= 1 + -(-percent * least // 100) // SPARE)[row]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[ok]]), pa.array(n[row[ok]]), pa.array(tokens[ok])], names=["doc_id", "n", "token"])

    keyed = written(prefixed.mapInArrow(hopeful, "doc_id long, n long, token long").join(shared, "token").select("token", "doc_id", "n"), "keyed")
    forget(often, table, shared)
    freed(spark)
    # linked sets have a step in common, and tokens that they share are posted under it
    keyed = _supported(keyed, percent)
    rows_of = keyed.withColumn("low", _step(percent)).withColumn("step", F.explode(F.array("low", F.col("low") + 1)))
    groups = rows_of.groupBy("token", "step").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size")).filter("least < most")
    postings = written(rows_of.join(groups.select("token", "step", "size"), ["token", "step"]), "postings")
    forget(keyed)
    pairs = _connected(postings, percent)
    freed(spark)
    near = written(components(pairs, "neighbourhoods").select(F.col("node").alias("doc_id"), F.col("component").alias("near")), "near")
    sets = _sets_of(docs, near.select("doc_id"), "sets")
    # a neighbourhood that fits in a block is not parted; a larger one is in order of size and least shared token
    large = near.groupBy("near").count().select("near", (F.col("count") > block // 2).alias("large"))
    first = postings.groupBy("doc_id").agg(F.min("token").alias("first"))
    placed = near.join(large, "near").join(first, "doc_id").join(sets, "doc_id").withColumn("comp", F.col("doc_id"))
    for name, key in (("k1", _step(percent)), ("k2", F.col("first")), ("k3", F.col("doc_id"))):
        placed = placed.withColumn(name, F.when(F.col("large"), key).otherwise(F.lit(0)).cast("long"))
    dealt = placed.repartitionByRange(n_tasks(spark), "near", "k1", "k2", "k3").sortWithinPartitions("near", "k1", "k2", "k3", "n", "doc_id").select("near", "comp", "doc_id", "n", "tokens")
    blocks = written(dealt.mapInArrow(_in_blocks(_linked(percent), block, most), _BLOCKS), "blocks")
    freed(spark)
    found = blocks.filter("a is not null").select("a", "b")
    more = _crossing(sets, blocks.filter("a is null").select("doc_id", "near", "block", "comp"), postings, percent, block, most)
    return rows, equal, found if more is None else found.union(more)


def jaccard_join(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, most: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, equal, found = links(docs, percent, block, most)
    joined = written(components(equal.union(found), "components"), "jaccard-components").select(F.col("node").alias("id"), "component")
    return rows.join(joined, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
