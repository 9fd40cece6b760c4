"""Substring dedup: windows of words that start at a second place anywhere are cut out of every text.

A window's anchor is its rarest-hashing run of ANCHOR words (leftmost of equals), so equal windows
have equal anchors and meet in one shard.  Consecutive windows with one anchor form a segment; equal
segments of a text are one row with all their places.  Segments whose anchor occurs once cannot repeat
and end there.  Of the others, equal segments are counted before they are dealt out; one that occurs
twice is repeated throughout.  The rest are streamed against the FM-index of their shard, whose matching
statistics of window length or more are the repeated windows.

No shorter anchor splits the segments around a passage that very many texts hold, each with words of its
own beside it.  For an anchor with more than `hot` different segments the whole window is the anchor
instead: a shard would then hold one window only, so it is enough to count it, by 128 bits of hash.
Anchors with more kinds of segments, and segments with more copies, than 1 / HOT_SHARE of all are joined where
their rows lie, so no task gathers them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .frames import cut, partitions, row_key
from .textkernel import U64, blocks, gram_hashes, mix, span_hashes

WINDOW = 35
ANCHOR = 8
HOT = 2_000
#: At most so many keys can each have more than 1 / HOT_SHARE of all rows: 20,000 keys are broadcast at most.
HOT_SHARE = 20_000
SHARD_WORDS = 400_000
_PLACE = U64((1 << 28) - 1)


def anchors(words: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a block: first window, number of windows, anchor hash."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none.astype(U64)
    grams = gram_hashes(words, anchor)
    if len(grams) > int(_PLACE):
        raise ValueError("a text has more words than a segment's place can hold")
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
    span, have = window - anchor + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = (least & _PLACE).astype(np.int64)
    sizes = np.diff(offsets)
    counts = np.maximum(0, sizes - window + 1)
    valid = np.repeat(offsets[:-1], counts) + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    place = place[valid]
    if not len(valid):
        return none, none, none.astype(U64)
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
    at = np.flatnonzero(new)
    return valid[at], np.diff(np.append(at, len(valid))), grams[place[at]]


def _segments(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(x).to_numpy() for x in ("k1", "k2"))
            for block in blocks(batch.column("body")):
                first, n, anchor_hash = anchors(block.words, block.offsets, window, anchor)
                if len(first):
                    row = np.searchsorted(block.offsets, first, side="right") - 1
                    content = span_hashes(block.words, first, first + n + window - 1)
                    order = np.lexsort((first, content, anchor_hash, row))
                    row, content, anchor_hash = row[order], content[order], anchor_hash[order]
                    new = np.ones(len(row), dtype=bool)
                    new[1:] = (row[1:] != row[:-1]) | (content[1:] != content[:-1]) | (anchor_hash[1:] != anchor_hash[:-1])
                    at, place = np.flatnonzero(new), (first[order] - block.offsets[row]) << 8 | n[order]
                    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(place))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor_hash[at].view(np.int64), content[at].view(np.int64), k1[row[at] + block.first], k2[row[at] + block.first])] + [places], names=["anchor", "content", "k1", "k2", "places"])

    return run


def _contents(window: int):
    """Texts of the wanted segments, as bytes of their words, and of hot anchors' their windows' hashes; of neighbouring rows with one key the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            k1, k2 = (batch.column(x).to_numpy() for x in ("k1", "k2"))
            if not len(k1):
                continue
            fresh = np.ones(len(k1), dtype=bool)
            fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            fresh[0], last = (k1[0], k2[0]) != last, (k1[-1], k2[-1])
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
                k1, k2 = k1[fresh], k2[fresh]
            wanted = batch.column("wanted")
            flat, ends = wanted.flatten(), wanted.offsets.to_numpy()
            place, anchor, content, copies, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            for block in blocks(batch.column("body")):
                at = slice(ends[block.first] - ends[0], ends[block.first + len(block)] - ends[0])
                row = np.repeat(np.arange(len(block)), np.diff(ends[block.first : block.first + len(block) + 1]))
                start = block.offsets[row] + (place[at] >> 8)
                stop = start + (place[at] & 255) + window - 1
                data = block.data.tobytes()
                texts = [data[a:b] for a, b in zip(block.starts[start], block.ends[stop - 1], strict=True)]
                hashes = [block.words[a:b] for a, b in zip(start, stop, strict=True)]
                each = [gram_hashes(h, window).view(np.int64) if x else [] for h, x in zip(hashes, hot[at], strict=True)]
                more = [gram_hashes(mix(h), window).view(np.int64) if x else [] for h, x in zip(hashes, hot[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(content[at]), pa.array(copies[at]), pa.array(k1[block.first + row]), pa.array(k2[block.first + row]), pa.array(place[at]), pa.array(texts, pa.binary())] + [pa.array(x, pa.list_(pa.int64())) for x in (each, more)], names=["anchor", "content", "copies", "k1", "k2", "place", "body", "windows", "checks"])

    return run


_FOUND = "k1 long, k2 long, place long, mask long"


def _search(window: int, shard_words: int):
    """Builds the index of one shard after another from rows in the order of anchors; looks up segments without a copy."""

    def shard(rows: list[pa.Table]) -> pa.RecordBatch | None:
        table = pa.concat_tables(rows)
        anchor, content, copies = (table.column(x).to_numpy() for x in ("anchor", "content", "copies"))
        once = np.ones(len(anchor), dtype=bool)  # a row that the input repeats comes here more than once
        once[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        table, copies = table.filter(pa.array(once)), copies[once]
        sequences: list[np.ndarray] = []
        for block in blocks(table.column("body")):
            sequences += np.split(block.words, block.offsets[1:-1])
        alone = np.flatnonzero(copies == 1)
        if not len(alone):
            return None
        longest = FMIndex(sequences, copies).matching_statistics([sequences[i] for i in alone])
        masks = np.array([np.sum(np.int64(1) << np.flatnonzero(m[: len(m) - window + 1] >= window)) for m in longest], dtype=np.int64)
        found = table.take(pa.array(alone[masks > 0])).select(["k1", "k2", "place"])
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in found.columns] + [pa.array(masks[masks > 0])], names=["k1", "k2", "place", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        words, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            anchor = batch.column("anchor").to_numpy()
            sizes = (batch.column("place").to_numpy() & 255) + window - 1
            turns = np.flatnonzero(np.concatenate([[last is None or anchor[0] != last], anchor[1:] != anchor[:-1]]))
            last, at, run_words = anchor[-1], 0, np.concatenate([[0], np.cumsum(sizes)])
            for turn in turns:
                if words + run_words[turn] - run_words[at] >= shard_words:
                    held.append(table.slice(at, turn - at))
                    if (out := shard([x for x in held if x.num_rows])) is not None:
                        yield out
                    held, words, at = [], 0, turn
            held.append(table.slice(at))
            words += int(run_words[-1] - run_words[at])
        if any(x.num_rows for x in held) and (out := shard([x for x in held if x.num_rows])) is not None:
            yield out

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(k1, k2, body) in; (k1, k2, place, mask) out: place is first window << 8 | windows, mask has a bit for each repeated one."""
    n = partitions(docs.sparkSession)
    segments = docs.mapInArrow(_segments(window, anchor), "anchor long, content long, k1 long, k2 long, places array<long>")
    again = cut(segments.groupBy("anchor").agg(F.sum(F.size("places")).alias("times")).where("times > 1").select("anchor"))  # read back, so that the join below may split a hot anchor's rows
    segments = cut(segments.join(again, "anchor", "left_semi"))
    kinds = cut(segments.groupBy("anchor", "content").agg(F.sum(F.size("places")).alias("copies"), F.min(F.struct("k1", "k2", F.col("places")[0].alias("place"))).alias("one")))
    open_anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1")
    open_anchors = cut(open_anchors)
    most = kinds.count() // HOT_SHARE + 1
    common = F.broadcast(open_anchors.where(F.col("kinds") > most))  # at most HOT_SHARE
    wanted = kinds.join(common, "anchor").unionAll(kinds.join(common, "anchor", "left_anti").join(open_anchors.where(F.col("kinds") <= most), "anchor")).select("one.k1", "one.k2", F.struct("one.place", "anchor", "content", "copies", (F.col("kinds") > hot).alias("hot")).alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    contents = docs.join(wanted, ["k1", "k2"]).mapInArrow(_contents(window), "anchor long, content long, copies long, k1 long, k2 long, place long, body binary, windows array<long>, checks array<long>")
    contents = cut(contents)
    found = contents.where(F.size("windows") == 0).drop("windows", "checks").repartition(n, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_search(window, shard_words), _FOUND)
    single = contents.where(F.size("windows") > 0).dropDuplicates(["anchor", "content"]).select("k1", "k2", "place", "copies", F.posexplode(F.arrays_zip("windows", "checks")).alias("bit", "w")).select("k1", "k2", "place", "copies", "bit", "w.windows", "w.checks")
    twice = single.groupBy("windows", "checks").agg(F.sum("copies").alias("times")).where("times > 1").select("windows", "checks")
    rest = single.where("copies = 1").join(twice, ["windows", "checks"], "left_semi").groupBy("k1", "k2", "place").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    return found.unionAll(rest).unionAll(_copied(segments, kinds.where("copies > 1").select("anchor", "content", "copies")))


def _copied(segments: DataFrame, kinds: DataFrame) -> DataFrame:
    """All windows of segments that occur more than once.  The commonest, at most HOT_SHARE of them, are broadcast, so their rows stay where they are."""
    most = (kinds.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE + 1
    common = F.broadcast(kinds.where(F.col("copies") > most).select("anchor", "content"))
    rest = kinds.where(F.col("copies") <= most).select("anchor", "content")
    keys = ["anchor", "content"]
    rows = segments.join(common, keys, "left_semi").unionAll(segments.join(common, keys, "left_anti").join(rest, keys, "left_semi"))
    return rows.select("k1", "k2", F.explode("places").alias("place")).select("k1", "k2", "place", F.expr("shiftleft(1L, cast(place & 255 as int)) - 1").alias("mask"))


def _clean(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column("cuts")
            flat, ends = cuts.flatten(), cuts.offsets.to_numpy() - cuts.offsets[0].as_py()
            place, mask = (flat.field(k).to_numpy() for k in range(2))
            sizes = np.where(cuts.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            n_words, removed, digest, text = [], [], [], []
            for block in blocks(batch.column("body")):
                at = slice(ends[block.first], ends[block.first + len(block)])
                row = np.repeat(np.arange(len(block)), sizes[block.first : block.first + len(block)])
                start, bits = block.offsets[row] + (place[at] >> 8), mask[at]
                change = np.zeros(len(block.words) + 1, dtype=np.int64)
                for bit in range(int(bits.max()).bit_length() if len(bits) else 0):
                    first = start[bits >> bit & 1 == 1] + bit
                    np.add.at(change, first, 1)
                    np.add.at(change, first + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                data = block.data.tobytes()
                for i in range(len(block)):
                    a, b = block.offsets[i], block.offsets[i + 1]
                    keep = np.flatnonzero(~gone[a:b]) + a
                    kept = b" ".join([data[s:e] for s, e in zip(block.starts[keep].tolist(), block.ends[keep].tolist(), strict=True)])
                    n_words.append(b - a)
                    removed.append(b - a - len(keep))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    text.append(kept)
            columns = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(text, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Removes every word that a repeated window covers; windows are judged on the input.

    Returns the id, n_words, n_removed, kept_sha256 and, with keep_text, the kept words joined by spaces.
    A null or empty text, or one shorter than a window, has no window and loses nothing.  A row that the
    input holds twice counts as two places, so both copies lose their windows.  Ids may be null or equal.
    Other columns are not read.  window is 9 to 68 words.
    """
    if not ANCHOR < window <= ANCHOR + 60:
        raise ValueError(f"window must be {ANCHOR + 1} to {ANCHOR + 60}")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    keyed = base.select("id", "body", *row_key("id", "body"))
    spans = repeated_windows(keyed.where("body is not null").select("k1", "k2", "body"), window, hot=hot, shard_words=shard_words)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "mask")).alias("cuts"))  # a set: rows that the input repeats share their key
    kind = base.schema["id"].dataType.simpleString()
    out = keyed.join(spans, ["k1", "k2"], "left").select("id", "body", "cuts").mapInArrow(_clean(window, keep_text), f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


ORACLE_SQL = """
WITH w AS (SELECT doc_id, rowid_ AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
           FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
p AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT r, i, sha256(array_to_string(words[i:i+34], ' ')) AS h FROM p),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + o AS i FROM h JOIN d USING (h), range(35) t(o)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""
