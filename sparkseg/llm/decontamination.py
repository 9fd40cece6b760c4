"""Benchmark decontamination by CGK embeddings.

A walk over words repeats each word or moves on as a random bit of the word and the step says; texts at
a small edit distance give walks at a small Hamming distance.  Four sampled steps of a walk are a key.
Every word of a text starts a window; its keys, over WALKS walks and SAMPLES samples of each, are looked
up in hash tables of the items' keys.  What meets in any table is compared by exact word edit distance.

A walk of STEPS steps reads about half as many words, so it fits into windows of LEAST words, the shortest
items with edits, and tables serve items of all lengths.  An item of 2 * LEAST words or more is cut into
pieces of LEAST words at least: one of them has no more than its share of the edits, and is found by it.
Items below LEAST words allow no edit, so that one table suffices, whose key is the whole item.

Of 600 random items of each length, with the largest number of edits, 0.997 met in a table at 10 and 19
words, 0.998 at 14, and all at 20, 33 and 59.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, row_key
from .textkernel import U64, blocks, gram_hashes, mix, tidy

WALKS, SAMPLES, SYMBOLS = 8, 6, 4
LEAST, STEPS = 10, 15
#: Items travel with every task, at most so many bytes at once.
ITEM_BYTES = 4 << 20
_CHUNK = 1 << 14
_PAD = U64(0x5851F42D4C957F2D)
_HITS = "array<struct<item:long,at:long,words:long,edits:int>>"
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x165667B19E3779F9], dtype=U64)
_RNG = np.random.Generator(np.random.PCG64(1966))
_SAMPLED = [[sorted(_RNG.choice(STEPS, SYMBOLS, replace=False).tolist()) for _ in range(SAMPLES)] for _ in range(WALKS)]


def allowed_edits(n: int) -> int:
    """A fifth of an item's words; none below ten words."""
    return n // 5 if n >= LEAST else 0


def walk_keys(words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the walks from each start, an array for each walk and sample.  words must go on for STEPS words."""
    times = [(words * k >> U64(32)).astype(np.uint32) for k in _TIMES]
    spare = np.empty(len(starts), dtype=np.int64)
    for walk in range(WALKS):
        bits = mix(words ^ U64(0xA0761D6478BD642F * (walk + 1) % 2**64)).view(np.int64)
        needed = {t for sample in _SAMPLED[walk] for t in sample}
        at, place = starts.astype(np.int64), {}
        for step in range(max(needed) + 1):
            if step in needed:
                place[step] = at.copy()
            np.take(bits, at, out=spare, mode="clip")
            np.right_shift(spare, step, out=spare)
            np.bitwise_and(spare, 1, out=spare)
            np.add(at, spare, out=at)
        for sample in _SAMPLED[walk]:
            key = np.take(times[0], place[sample[0]])
            for j in range(1, SYMBOLS):
                key += np.take(times[j], place[sample[j]])
            yield key


def edit_distances(pattern: np.ndarray, texts: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits between each row of pattern and any run of words of the same row of texts, and where the first such run ends.

    With `most`, rows that have more edits than that after some words are given up: their value is just above it.
    """
    m, n = pattern.shape
    width = texts.shape[1]
    ramp = np.arange(width + 1, dtype=np.int16)
    alive = np.arange(m)
    before = np.zeros((m, width + 1), dtype=np.int16)
    best, end = np.full(m, np.int16(32767 if most is None else most + 1)), np.zeros(m, dtype=np.int64)
    for i in range(n):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        np.minimum(before[:, :-1] + (texts[alive] != pattern[alive, i : i + 1]), before[:, 1:] + 1, out=now[:, 1:])
        before = np.minimum.accumulate(now - ramp, axis=1) + ramp  # a word that only the text has costs one a column
        if most is not None and i % 4 == 3 and i + 1 < n:
            fine = before.min(1) <= most
            alive, before = alive[fine], before[fine]
            if not len(alive):
                return best, end
    end[alive] = before.argmin(1)
    best[alive] = before.min(1)
    return best, end


class _Table:
    """Sorted keys of 32 bits with what they belong to, behind a table of flags that lets few others through."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.shift = np.uint32(32 - min(20, max(12, int(len(keys) * 64).bit_length())))
        self.flags = np.zeros(1 << 32 - int(self.shift), dtype=bool)
        self.flags[keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among keys, and owners, of all that is in the table."""
        at = np.flatnonzero(self.flags[(keys >> self.shift).astype(np.int64)])
        some = keys[at]
        low = np.searchsorted(self.keys, some)
        same = self.keys[np.minimum(low, len(self.keys) - 1)] == some if len(self.keys) else np.zeros(0, bool)
        at, low = at[same], low[same]
        each = np.searchsorted(self.keys, some[same], side="right") - low
        return np.repeat(at, each), self.owners[np.repeat(low, each) + (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))]


class Items:
    """Benchmark items as word hashes, their pieces, and the hash tables of the pieces' walks (of short items: of all their words)."""

    def __init__(self, ids: list, texts: list[str | None]):
        words: list[np.ndarray] = []
        for block in blocks(pa.array(texts, pa.string()), lower=True):
            words += np.split(block.words, block.offsets[1:-1])
        some = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words = np.array([ids[i] for i in some], dtype=np.int64), [words[i] for i in some]
        pieces = []  # item, first word, words, edits
        for i, w in enumerate(self.words):
            n, count = len(w), len(w) // LEAST
            cuts = [n * j // count for j in range(count + 1)] if count else []
            pieces += [(i, a, b - a, -(-(b - a) * allowed_edits(n) // n)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.pieces = np.array(pieces, dtype=np.int64).reshape(-1, 4)
        pad = np.full(STEPS + 1, _PAD)
        flat = np.concatenate([x for w in self.words for x in (w, pad)] or [pad])
        first = np.cumsum([0] + [len(w) + len(pad) for w in self.words])
        self.flat, self.starts = flat, first[self.pieces[:, 0]] + self.pieces[:, 1]
        self.tables = [_Table(keys, np.arange(len(self.pieces))) for keys in walk_keys(flat, self.starts)]
        self.lengths = np.unique(self.pieces[:, 2:4], axis=0).tolist()
        self.vocabulary = np.zeros(1 << 20, dtype=bool)
        self.vocabulary[flat >> U64(44)] = True
        self.short: dict[int, _Table] = {}
        for n in sorted({len(w) for w in self.words if len(w) < LEAST}):
            mine = [i for i, w in enumerate(self.words) if len(w) == n]
            self.short[n] = _Table(np.array([gram_hashes(self.words[i], n)[0] >> U64(32) for i in mine], dtype=np.uint32), np.array(mine))


def _regions(words: np.ndarray, starts: np.ndarray, size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """size words from each start, a mark that equals nothing for those outside first .. end."""
    place = starts[:, None] + np.arange(size)
    return np.where((place >= first[:, None]) & (place < end[:, None]), words[np.clip(place, 0, len(words) - 1)], _PAD)


def _candidates(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(window's first word, piece), each once, that meet in some table.

    A window is looked up if its surroundings hold as many words of any items as some piece needs: a piece
    within reach leaves all its words but the edited ones there.
    """
    padded = np.concatenate([words, np.full(STEPS + 1, _PAD)])
    known = np.concatenate([[0], np.cumsum(items.vocabulary[words >> U64(44)])])
    n, found = len(words), []
    worth = np.zeros(n, dtype=bool)
    at = np.arange(n)
    for size, most in items.lengths:
        worth |= known[np.minimum(at + size + 2 * most, n)] - known[np.maximum(at - most, 0)] >= size - most
    starts = np.flatnonzero(worth)
    for at in range(0, len(starts), _CHUNK):
        mine = starts[at : at + _CHUNK]
        part = padded[mine[0] : mine[-1] + STEPS + 1]
        for table, keys in zip(items.tables, walk_keys(part, mine - mine[0]), strict=True):
            place, piece = table.find(keys)
            if len(place):
                found.append(mine[place] * len(items.pieces) + piece)
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // max(1, len(items.pieces)), both % max(1, len(items.pieces))


def _block_hits(words: np.ndarray, offsets: np.ndarray, items: Items) -> dict[int, list[tuple[int, int, int, int]]]:
    """Row of the block to (item, first word, words, edits): the nearest run of words of each neighbourhood within reach."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    if not len(words):
        return out

    def row_of(p: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, p, side="right") - 1

    for n, table in items.short.items():
        place, item = table.find((gram_hashes(words, n) >> U64(32)).astype(np.uint32))
        row = row_of(place)
        for p, i, r in zip(place.tolist(), item.tolist(), row.tolist(), strict=True):
            if p + n <= offsets[r + 1] and (words[p : p + n] == items.words[i]).all():
                out.setdefault(r, []).append((i, p - int(offsets[r]), n, 0))
    if not len(items.pieces):
        return out
    start, piece = _candidates(words, items)
    row = row_of(start)
    near = []
    for n, most in items.lengths:
        mine = np.flatnonzero((items.pieces[piece, 2] == n) & (items.pieces[piece, 3] == most))
        for at in range(0, len(mine), 4096):
            c = mine[at : at + 4096]
            pattern = items.flat[items.starts[piece[c], None] + np.arange(n)]
            region = _regions(words, start[c] - most, n + 3 * most, offsets[row[c]], offsets[row[c] + 1])
            fine = (pattern[:, :, None] == region[:, None, :]).any(2).sum(1) >= n - most  # words that edits leave in place
            c, pattern, region = c[fine], pattern[fine], region[fine]
            edits, _ = edit_distances(pattern, region, most)
            near.append(c[edits <= most])
    near = np.concatenate(near) if near else np.zeros(0, np.int64)
    whole = np.unique(np.stack([items.pieces[piece[near], 0], row[near], start[near] - items.pieces[piece[near], 1]]), axis=1) if len(near) else np.zeros((3, 0), np.int64)
    for item in np.unique(whole[0]).tolist():
        word = items.words[item]
        n, most = len(word), allowed_edits(len(word))
        _, r, p = whole[:, whole[0] == item]
        hits = set()
        for at in range(0, len(p), max(1, (1 << 22) // (n + 5 * most))):
            part = slice(at, at + max(1, (1 << 22) // (n + 5 * most)))
            low = p[part] - 2 * most
            edits, end = edit_distances(np.repeat(word[None], len(low), axis=0), _regions(words, low, n + 5 * most, offsets[r[part]], offsets[r[part] + 1]))
            fine = np.flatnonzero(edits <= most)
            if len(fine):  # backwards from the end, to see where the run begins
                stop = low[fine] + end[fine]
                back, size = edit_distances_from(word[::-1], _regions(words, stop - n - most, n + most, offsets[r[part][fine]], offsets[r[part][fine] + 1])[:, ::-1])
                hits |= {(int(a), int(b - c), int(c), int(d)) for a, b, c, d in zip(r[part][fine], stop, size, back, strict=True)}
        for a, b, c, d in _nearest(sorted(hits), n):
            out.setdefault(a, []).append((item, b - int(offsets[a]), c, d))
    return out


def edit_distances_from(word: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits between word and a run that begins each row of texts, and the words of the shortest such run."""
    width = texts.shape[1]
    ramp = np.arange(width + 1)
    before = np.repeat(ramp[None], len(texts), axis=0)
    for i, symbol in enumerate(word):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(before[:, :-1] + (texts != symbol), before[:, 1:] + 1)
        before = np.minimum.accumulate(now - ramp, axis=1) + ramp
    return before.min(1), before.argmin(1)


def _nearest(hits: list[tuple[int, int, int, int]], n: int) -> Iterator[tuple[int, int, int, int]]:
    """Of (row, start, words, edits) in order, the one with the least edits of each run of starts no more than half an item apart."""
    best = last = None
    for hit in hits:
        if last is not None and (hit[0] != last[0] or hit[1] - last[1] > n // 2):
            yield best
            best = None
        best = hit if best is None or hit[3] < best[3] else best
        last = hit
    if best is not None:
        yield best


def _mark(items: Items):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item", pa.int64()), ("at", pa.int64()), ("words", pa.int64()), ("edits", pa.int32())]))
        for batch in batches:
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for block in blocks(batch.column("body"), lower=True):
                for row, found in _block_hits(block.words, block.offsets, items).items():
                    hits[block.first + row] += [{"item": int(items.ids[i]), "at": p, "words": n, "edits": e} for i, p, n, e in found]
            n = batch.num_columns
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n - 1)] + [pa.array([sorted(h, key=lambda x: (x["item"], x["at"])) for h in hits], kind)], names=[*batch.schema.names[:-1], "hits"])

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", name: str = "hits", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Adds `hits` (under that name or another): (item, at, words, edits) for each place where a run of words is within a fifth of an item's words in edits.

    The run may have fewer or more words than the item.  Words are compared with A-Z lower-cased; items
    below ten words must occur unchanged.  A null or empty text has no hits, and items without words, or
    with a null id, are nobody's; items that repeat give a hit each.  Rows are judged one by one and nothing
    is shuffled.  A benchmark beyond item_bytes goes over the texts part by part: each part's hits are
    written by text, and joined to the rows at the end, so that the driver holds one part at a time.  A
    column of that name is replaced; all others stay.
    """
    given = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("body"))
    size = given.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    parts = int(size // item_bytes) + 1
    kept = [c for c in docs.columns if c != name]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    body = F.col(f"`{text_col}`").cast("string").alias("body")

    def items(part: int) -> Items:
        mine = given if parts == 1 else given.where(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == part)
        rows = mine.orderBy("id", "body").collect()  # at most about item_bytes
        return Items([r[0] for r in rows], [r[1] for r in rows])

    if parts == 1:
        schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"hits {_HITS}"])
        return docs.select(*fields, body).mapInArrow(_mark(items(0)), schema).toDF(*kept, name)
    texts, found = docs.select(body).where("body is not null").select(*row_key("body"), "body"), None
    for part in range(parts):
        one = cut(texts.mapInArrow(_mark(items(part)), f"k1 long, k2 long, hits {_HITS}").where(F.size("hits") > 0).dropDuplicates(["k1", "k2"]))
        found = one if found is None else found.unionAll(one)
    found = found.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    keyed = docs.select(*fields, body).withColumns(dict(zip(("k1", "k2"), row_key("body"), strict=True)))
    out = keyed.join(found, ["k1", "k2"], "left")
    return out.select(*(f"c{i}" for i in range(len(kept))), F.coalesce("hits", F.array().cast(_HITS)).alias("hits")).toDF(*kept, name)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_distinct(F.transform("hits", lambda h: h["item"])).alias("item_ids"), F.size("hits").cast("long").alias("n_hits"))
