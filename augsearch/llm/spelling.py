"""Spelling variants: words of one edit's distance are grouped under their most frequent form, by dense prefix-suffix tiling.

1. Tasks count the runs of letters of whole texts; words that occur often enough are written to the shared folder.
2. The single edit between two words lies in one of `segments` parts of the shorter one: what stands before and
   behind that part is equal. Words are blocked by these pairs of ends, once for their own length and once for the
   length below. A block of more than `most` words is cut into four times as many segments, so its words are dealt to
   smaller blocks, again until none is too large or a segment is a single code point; then a block holds at most all words that differ in one place, or by two code points there.
3. Blocks are compared in tiles: padded matrices of code points, one aligned left and one right, give for all pairs of
   two tiles the lengths of common prefix and suffix. Prefix plus suffix of at least the longer length less one is a single edit. A pair
   counts in the block whose segment its common prefix ends in, so once.
4. Each tile gives for a word its number of near words and the best of them; these are added up by word. Forms at
   least double the number of occurrences, so roots are found by doubling of pointers in a few joins.

Defined results: null, empty and letterless texts have no words; a null doc_id counts as an empty string before the colon;
repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.llm.common import documents, n_tasks, slices, written

MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a block before it is cut further, words of a tile, cells of a tile's matrices, and words that a task counts before it passes them on.
BLOCK, TILE, CELLS, HELD = 512, 128, 1 << 22, 1 << 18
MODULUS = 97
#: Latin-1 letters stay, A-Z in lower case; the rest parts runs.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, occurrences) of a task, a word more than once if there are very many."""
    held: Counter[str] = Counter()

    def passed_on() -> Iterator[pa.RecordBatch]:
        words, n = list(held), list(held.values())
        held.clear()
        for i in range(0, len(words), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 8192], pa.string()), pa.array(n[i : i + 8192], pa.int64())], names=["word", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter((text or "").encode("latin-1", "replace").translate(_FOLD).split()).items():
                    if len(run) < MIN_LENGTH:
                        continue
                    word = run.decode("latin-1")
                    h = zlib.crc32(run if run.isascii() else word.encode(), start)
                    if h % MODULUS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield from passed_on()
    yield from passed_on()


def words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _blocked(vocabulary: DataFrame, segments: int, parts: str) -> DataFrame:
    """Rows of vocabulary by block. parts: SQL for the segments of each row, numbers of 0 to segments - 1."""
    cut = f"size * %s div {segments}"
    before, behind = cut % "s", cut % "(s + 1)"
    key = f"xxhash64(size, s, {segments}, substr(word, 1, {before}), substr(word, length(word) - (size - {behind}) + 1))"
    blocks = f"transform(filter({parts}, s -> {before} < {behind}), s -> struct(s as segment, {key} as key))"
    return vocabulary.selectExpr("word", "n", "size", f"explode({blocks}) as block").select("word", "n", "size", "block.*")


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a with all of b: how many columns are equal from the first on. Padding of a and b has to differ."""
    equal, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for i in range(min(a.shape[1], b.shape[1])):
        equal &= a[:, i, None] == b[None, :, i]
        if not equal.any():
            break
        out += equal
    return out


class Tiles:
    """Words sorted by block, as matrices of code points."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points, self.end = points, np.cumsum(self.length)

    def matrices(self, of: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' code points aligned left, and from the last to the first."""
        length = self.length[of]
        row, column = np.repeat(np.arange(len(of)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        points = self.points[np.repeat(self.end[of] - length, length) + column]
        left, right = (np.full((len(of), length.max()), 0x110000 + padding, np.uint32) for _ in range(2))
        left[row, column] = points
        right[row, np.repeat(length, length) - 1 - column] = points
        return left, right

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows of a and b one edit apart, and their common prefix."""
        (left_a, right_a), (left_b, right_b) = self.matrices(a, 0), self.matrices(b, 1)
        prefix, suffix = _lengths(left_a, left_b), _lengths(right_a, right_b)
        one, two = self.length[a][:, None], self.length[b][None, :]
        longer = np.maximum(one, two)
        i, j = np.nonzero((abs(one - two) <= 1) & (prefix + suffix >= longer - 1) & ~((one == two) & (prefix == longer)))
        return a[i], b[j], prefix[i, j].astype(np.int64)


def _tiles(block: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Rows, sorted by block, in tiles: small blocks share one, large ones have several of their own."""
    out, start = [], 0
    bounds = np.flatnonzero(np.diff(block, append=-1)) + 1
    for end in bounds.tolist():
        most = max(1, min(TILE, CELLS // int(length[start:end].max())))
        if end - start > most or (out and (out[-1][1] - out[-1][0] + end - start > most or out[-1][2])):
            out += [(i, min(i + most, end), end - start > most) for i in range(start, end, most)]
        elif out:
            out[-1] = (out[-1][0], end, False)
        else:
            out.append((start, end, False))
        start = end
    return [np.arange(a, b) for a, b, _ in out]


def _compared(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            words, n, size, segment, key = (table[c].to_pylist() if c == "word" else table[c].to_numpy() for c in table.schema.names)
            block = np.cumsum((np.diff(size, prepend=-1) != 0) | (np.diff(segment, prepend=-1) != 0) | np.append(True, key[1:] != key[:-1]))
            whole, found = Tiles(words), []
            tiles = _tiles(block, whole.length)
            for t, tile in enumerate(tiles):
                last = block[tile[-1]]
                for other in tiles[t:]:  # sorted by block: those that share its last
                    if block[other[0]] > last:
                        break
                    a, b, prefix = whole.near(tile, other)
                    ok = (a < b) & (block[a] == block[b]) & (np.minimum(whole.length[a], whole.length[b]) == size[a])
                    a, b, prefix = a[ok], b[ok], prefix[ok]
                    s, low = size[a], segment[a]  # the segment that the common prefix ends in; the last has the end too
                    ok = (prefix >= s * low // segments) & ((prefix < s * (low + 1) // segments) | (s * (low + 1) // segments == s))
                    found.append((a[ok], b[ok]))
            a, b = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            one, two = np.concatenate([a, b]), np.concatenate([b, a])
            if not len(one):
                return
            names, of = np.unique(np.array(words, object)[one], return_inverse=True)
            spelt = np.unique(np.array(words, object)[two], return_inverse=True)[1]  # ties go by the word
            order = np.lexsort((spelt, -n[two], of))
            first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
            near = np.bincount(of, minlength=len(names))
            for i in range(0, len(names), 8192):
                at = slice(i, i + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.string()), pa.array(near[at], pa.int64()), pa.array(n[two[first[at]]], pa.int64()), pa.array([words[w] for w in two[first[at]]], pa.string())], names=["word", "n_near", "form_n", "form"])

        def last_block(table: pa.Table) -> int:
            """Where the last block begins; it may go on in the next batch."""
            size, segment, key = (table[c].to_numpy() for c in ("size", "segment", "key"))
            other = np.flatnonzero((size != size[-1]) | (segment != segment[-1]) | (key != key[-1]))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8192 or sum(b.nbytes for b in held) > 64 << 20:
                table = pa.Table.from_batches(held)
                cut = last_block(table)
                if cut:
                    yield from compare(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return run


def near_words(vocabulary: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n_near, best (n and word of the near word of largest n, ties to the smallest). vocabulary: word, n; a table, as it is read repeatedly."""
    spark, on = vocabulary.sparkSession, ["size", "segment", "key"]
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    rows, segments = _blocked(vocabulary.select("word", "n", sizes).filter(f"size >= {MIN_LENGTH}"), 2, "sequence(0, 1)"), 2
    out = None
    while True:
        rows = written(rows, "blocks")
        large = rows.groupBy(on).count().filter(F.col("count") > most).select(on)
        final = segments >= longest
        fit = rows if final else rows.join(large, on, "left_anti")
        # a block in one task, several blocks in each
        compared = fit.select("word", "n", *on).repartition(n_tasks(spark), *on).sortWithinPartitions(*on).mapInArrow(_compared(segments), "word string, n_near long, form_n long, form string")
        out = compared if out is None else out.unionByName(compared)
        if final or not large.limit(1).count():
            break
        rows = rows.join(large, on, "left_semi")
        segments *= 4
        rows = _blocked(rows.select("word", "n", "size", "segment"), segments, "sequence(4 * segment, 4 * segment + 3)")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def variants(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = written(words(docs), "vocabulary")
    has_form = F.col("form_n") >= 2 * F.col("n")
    grouped = vocabulary.join(near_words(vocabulary, most), "word", "left").select(
        "word", F.when(has_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("form_n")).alias("form_n")
    )
    grouped = written(grouped, "forms")
    roots = grouped.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # n doubles from word to form, so there are few rounds
        roots = written(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nearer = roots.join(further, "root", "left")
        if not nearer.filter("further is not null").limit(1).count():
            break
        roots = nearer.select("word", F.coalesce("further", "root").alias("root"))
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


#: The 256 entries of the table come from the polynomial; a run's checksum goes on from that of "<doc_id>:", so it is taken over both together.
SQL = r"""
WITH RECURSIVE divided AS (
  SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) t(i)),
steps AS (SELECT list(c ORDER BY i) AS step FROM divided),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)]::BIGINT[] END)) AS b FROM distinct_runs),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(b, lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM bytes, steps),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i - 1) || '.' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.less = w.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS form, max(w.n) AS form_n FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways AS (
  SELECT word, word AS root, form AS onward FROM forms
  UNION ALL SELECT ways.word, forms.word, forms.form FROM ways JOIN forms ON ways.onward = forms.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM ways WHERE onward IS NULL) USING (word)
"""
