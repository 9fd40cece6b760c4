"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound by multiplying its letters'
vectors, each rotated by its place; a text's vector is the bundle (sum) of its trigrams, and a language's
prototype the bundle of its texts.  A text takes the language whose prototype has the largest cosine.
Letters are lower-cased, marks that combine with letters are kept as symbols of their own, and a run of
anything else counts as one space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import BLOCK_BYTES, pieces, tidy

DIMENSIONS = 1024
#: The prototypes travel with every task; 10,000 languages are 40 MB.
MOST_LANGUAGES = 10_000
_vectors: dict[int, np.ndarray] = {}
_kinds: dict[int, int] = {}


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random vector of each code point (0 is the space); every code point has its own."""
    for p in points.tolist():
        if p not in _vectors:
            _vectors[p] = (np.random.Generator(np.random.PCG64([1789, p])).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)
    return np.stack([_vectors[p] for p in points.tolist()])


def _kind(point: int) -> int:
    """2 for a letter, 1 for a mark that combines with one, else 0."""
    have = _kinds.get(point)
    if have is None:
        have = _kinds[point] = 2 if chr(point).isalpha() else int(unicodedata.category(chr(point))[0] == "M")
    return have


def _symbols(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points that are symbols, 0 first; which of them each point is, 0 for what is none; and whether it is a letter."""
    if len(points) and points.max() < 1 << 16:
        seen = np.flatnonzero(np.bincount(points, minlength=1))
        place = np.zeros(int(points.max()) + 1, dtype=np.int64)
        place[seen] = np.arange(len(seen))
        at = place[points]
    else:
        seen, at = np.unique(points, return_inverse=True)
    kinds = np.array([_kind(int(p)) for p in seen], dtype=np.int64)
    number = np.where(kinds > 0, np.cumsum(kinds > 0), 0)
    return np.concatenate([[0], seen[kinds > 0]]).astype(np.int64), number[at], (kinds == 2)[at]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text's trigrams (texts x kinds), the kinds' vectors, and how many letters each text has."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered])
    used, symbols, letter = _symbols(np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32))
    row = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(row[letter], minlength=len(texts))
    ends = np.cumsum(sizes)
    symbols, row = np.insert(symbols, ends, 0), np.insert(row, ends, np.arange(len(texts)))  # each text ends with a space
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0) | (row[1:] != row[:-1])
    symbols, row = symbols[keep], row[keep]
    if len(symbols) < 3:
        return np.zeros((len(texts), 1), np.float32), np.zeros((1, DIMENSIONS), np.float32), letters
    s, n = symbols, len(used)
    code, same = (s[:-2] * n + s[1:-1]) * n + s[2:], row[2:] == row[:-2]
    code, row = code[same], row[2:][same]
    if n**3 <= 4_000_000:
        seen = np.zeros(n**3, dtype=bool)
        seen[code] = True
        kinds = np.flatnonzero(seen)
        place = np.zeros(n**3, dtype=np.int32)
        place[kinds] = np.arange(len(kinds))
        place = place[code]
    else:
        kinds, place = np.unique(code, return_inverse=True)
    if not len(kinds):
        return np.zeros((len(texts), 1), np.float32), np.zeros((1, DIMENSIONS), np.float32), letters
    counts = np.bincount(row * len(kinds) + place, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds)).astype(np.float32)
    alone = letter_vectors(used)
    vectors = alone[kinds // (n * n)] * np.roll(alone, 1, axis=1)[kinds // n % n] * np.roll(alone, 2, axis=1)[kinds % n]
    return counts, vectors.astype(np.float32), letters


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a block; a text beyond a block comes in pieces by its row's number."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES) and to - at < 512:
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vector and number of letters of each text."""
    vectors, letters = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), np.int64)
    for at, part in _parts(texts):
        if len(part) == 1 and len(part[0]) > 8 * BLOCK_BYTES:  # pieces overlap by two letters, so no trigram is lost but for runs of spaces at a cut
            for i in range(0, len(part[0]), 4 * BLOCK_BYTES):
                counts, kinds, n = trigrams([part[0][max(0, i - 2) : i + 4 * BLOCK_BYTES]])
                vectors[at] += (counts @ kinds)[0]
                letters[at] += n[0]
            continue
        counts, kinds, n = trigrams(part)
        vectors[at : at + len(part)] = counts @ kinds
        letters[at : at + len(part)] = n
    return vectors, letters


@tidy
def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in (piece for whole in batches for piece in pieces(whole, whole.schema.get_field_index("body"))):
        langs, texts = batch.column("lang").to_pylist(), batch.column("body").to_pylist()
        for at, part in _parts(texts):
            names, row = np.unique(langs[at : at + len(part)], return_inverse=True)
            counts, kinds, _ = trigrams(part)
            for i, name in enumerate(names):
                sums[str(name)] = sums.get(str(name), np.zeros(DIMENSIONS, np.int64)) + np.rint(counts[row == i].sum(0, dtype=np.float64) @ kinds).astype(np.int64)
    for name, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["lang", "dimension", "value"])


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit vector for each non-null label, from every labelled text.  Raises if there are over MOST_LANGUAGES."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"))
    sums = rows.mapInArrow(_learn, "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    found = sums.limit(MOST_LANGUAGES * DIMENSIONS + 1).toPandas()
    if len(found) > MOST_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for name, group in found.groupby("lang", sort=True):
        vector = np.zeros(DIMENSIONS)
        vector[group["dimension"].to_numpy()] = group["value"].to_numpy()
        out[str(name)] = (vector / max(np.linalg.norm(vector), 1e-9)).astype(np.float32)
    return out


def _predict(names: list[str], prototypes: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, whole.num_columns - 1)):
            vectors, letters = bundles([t or "" for t in batch.column("body").to_pylist()])
            cosine = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) if names else np.zeros((len(letters), 1))
            best = cosine.argmax(1)
            known = (letters > 0) & bool(names)
            lang = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score (the cosine, 0 to 1) under the names of out, in place of columns of these names.

    A null text, or one without a letter, is `und` with score 0, and so is every text if nothing was
    learned.  Of equal cosines the first language by name wins.  Nothing but the text is looked at.
    """
    names = sorted(prototypes)
    table = np.stack([prototypes[n] for n in names]) if names else np.zeros((1, DIMENSIONS), np.float32)
    kept = [c for c in docs.columns if c not in out]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    found = docs.select(*fields, F.col(f"`{text_col}`").cast("string").alias("body")).mapInArrow(_predict(names, table), f"{schema}{', ' * bool(schema)}lang_pred string, score double")
    return found.toDF(*kept, *out)


def held_out(id_col: str = "doc_id") -> F.Column:
    """A row is held out if crc32 of its id as text leaves 2 modulo 4; one with a null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = learn_prototypes(docs.where(~held_out()))
    return identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes).drop("text")
