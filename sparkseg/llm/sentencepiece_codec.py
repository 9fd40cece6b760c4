"""SentencePiece models on the tokenizers library.

The model's protobuf is read here: pieces with scores and kinds, model type, byte fallback, normaliser.
A unigram model becomes a unigram tokenizer with the same scores; a BPE model's merges are its pieces'
splits in the order of their scores.  Pieces that hold the space mark only in front cannot cross from
one space-led chunk to the next, so a chunk is encoded once and then looked up; anything else is encoded
whole.  Every chunk that a task meets for the first time is compared with the sentencepiece library.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import pieces, tidy

MARK = "▁"
#: Path of the model; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The model travels with every task.
MODEL_BYTES = 64 << 20
#: Chunks that a task keeps; beyond that, the half of them that came in most batches stays, without those that came in one.
CHUNKS = 200_000
#: Texts that the libraries encode at once, as what they return takes far more memory than the ids.
_AT_ONCE = 32
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def protobuf(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) pairs of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value = data[at : at + n]
            if len(value) < n:
                raise ValueError("the model is cut short")
            at += n
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    mark_last: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls([])
        for field, value in protobuf(data):
            if field == 1:
                piece = dict(protobuf(value))
                out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                spec = dict(protobuf(value))
                out.kind, out.byte_fallback, out.mark_last = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif field == 3:
                spec = dict(protobuf(value))
                out.charsmap, out.dummy_prefix, out.squeeze, out.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if out.kind not in (UNIGRAM, BPE) or not out.escape or out.mark_last:
            raise ValueError("only unigram and BPE models with a leading space mark are supported")
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """A BPE model's merges, best first.  The runs of marks share one score, so the leftmost pair goes first: the run in front grows to the next longer piece."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        blanks = sorted(len(p) for p in ids if not p.strip(MARK))
        out = []
        for piece, score, kind in self.pieces:
            if kind != NORMAL:
                continue
            blank = not piece.strip(MARK)
            shorter = [n for n in blanks if n < len(piece)] if blank else []
            for i in range(1, len(piece)) if not blank else shorter[-1:]:
                if piece[:i] in ids and piece[i:] in ids:
                    out.append((-score, -len(piece) if blank else 0, ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:]))
        return [x[4:] for x in sorted(out)]

    def tokenizer(self, decoding: bool = False, single: bool = False):
        """The model as a tokenizer of the tokenizers library; single: for marked words without runs of spaces, each met once.

        Its unigram lattice would also match the names of control and byte pieces in a text, so when encoding
        these have names that no text holds, and the codec puts the bytes of unknown stretches.
        """
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0 if single else 10_000)
        else:
            core = models.Unigram([(p if kind == NORMAL or decoding else f"\U0010ffff{i}", s) for i, (p, s, kind) in enumerate(self.pieces)], self.unknown, False)
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        steps += [normalizers.Prepend(MARK)] * self.dummy_prefix + [normalizers.Replace(" ", MARK)]
        if single:
            out.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "never", True)
            return out
        out.normalizer = normalizers.Sequence(steps)
        if self.chunked:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return out

    @property
    def chunked(self) -> bool:
        """Whether no piece holds a mark after another character."""
        return all(MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)


def load_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model's bytes: from a local path on the driver, or through Spark's reader where the path has a scheme."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    if len(data) > MODEL_BYTES:
        raise ValueError("the model is too large to travel with tasks")
    return data


def _runs(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at first, one after another."""
    stop = np.cumsum(size)
    return values[np.repeat(first - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)]


class Codec:
    """Encodes and decodes batches; parity compares what is encoded with the sentencepiece library."""

    def __init__(self, data: bytes, threads: int = 2, parity: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.parse(data)
        self.plain = self.model.chunked and not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        self.reference = None
        if parity:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.leads = np.array([kind != BYTE and p.startswith(MARK) for p, _, kind in self.model.pieces])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_ends = np.cumsum([len(p) for p in pieces])
        self.piece_sizes = np.array([len(p) for p in pieces])
        self.clear()

    @cached_property
    def tokenizer(self):
        return self.model.tokenizer()

    @cached_property
    def single(self):
        return self.model.tokenizer(single=True) if self.plain else self.tokenizer

    @cached_property
    def decoder(self):
        return self.tokenizer if self.model.kind == BPE else self.model.tokenizer(decoding=True)

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.first, self.size, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Keeps the chunks that came in most batches, half of CHUNKS at most, and none that came in one batch only."""
        kept = np.argsort(-self.met[: len(self.place)], kind="stable")[: CHUNKS // 2]
        kept = kept[self.met[kept] > 0]
        names, met, size = list(self.place), self.met[kept] // 2, self.size[kept]
        ids = _runs(self.flat, self.first[kept], size)
        self.clear()
        self._put([names[i] for i in kept.tolist()], ids, np.cumsum(size) - size, size, met)

    def _put(self, chunks: list[str], ids: np.ndarray, first: np.ndarray, size: np.ndarray, met: np.ndarray | int = 0) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        have, to = len(self.place), len(self.place) + len(chunks)
        if to > len(self.first):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros(to, np.int64)]) for x in (self.first, self.size, self.met))
        self.first[have:to], self.size[have:to], self.met[have:to] = first + self.used, size, met
        self.place.update(zip(chunks, range(have, to), strict=True))
        self.used += len(ids)

    def _encode(self, texts: list[str], single: bool = False) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), _AT_ONCE):
            yield from (np.array(x, np.int32) for x in self._encode_part(texts[i : i + _AT_ONCE], single))

    def _encode_part(self, texts: list[str], single: bool) -> list[list[int]]:
        marked = [MARK + t.replace(" ", MARK) for t in texts] if single else texts
        core = self.single if single else self.tokenizer
        run = core.encode_batch_fast if self.model.kind == BPE else core.encode_batch  # the fast form leaves out the tokens' texts
        found = run(marked, add_special_tokens=False)
        ids = [self._with_bytes(e) for e in found] if self.model.kind == UNIGRAM and self.model.byte_fallback else [e.ids for e in found]
        if self.reference is not None:
            wanted = self.reference.encode(texts)
            if ids != wanted:
                bad = next(t for t, a, b in zip(texts, ids, wanted, strict=True) if a != b)
                raise ValueError(f"the libraries disagree on {bad[:200]!r}")
        return ids

    def _with_bytes(self, encoding) -> list[int]:
        unknown, out = self.model.unknown, []
        for i, token in zip(encoding.ids, encoding.tokens, strict=True):
            out += [i] if i != unknown else [self.byte_ids[b] for b in token.encode()]
        return out

    def _keep(self, chunks: list[str]) -> None:
        """Encodes chunks joined by spaces: the ids of one end where a piece begins with the mark."""
        if not chunks:
            return
        ids = np.concatenate(list(self._encode([" ".join(chunks[i : i + 256]) for i in range(0, len(chunks), 256)], single=True)))
        first = np.flatnonzero(self.leads[ids])
        if len(first) != len(chunks):
            raise ValueError("chunks don't match pieces that begin with the mark")
        self._put(chunks, ids, first, np.diff(np.append(first, len(ids))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's end; a null or empty text has none."""
        if len(self.place) > CHUNKS:
            self._thin()
        texts = pc.fill_null(texts, "")
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        split = some & self.plain
        for test, part in ((pc.match_substring, "  "), (pc.match_substring, MARK), (pc.starts_with, " "), (pc.ends_with, " ")):
            split &= ~test(texts, part).to_numpy(zero_copy_only=False)
        rows, whole = np.flatnonzero(split), np.flatnonzero(some & ~split)
        lists = pc.split_pattern(texts.take(pa.array(rows)), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] += 1
        short = np.array([len(chunks[i]) <= 64 for i in fresh.tolist()], bool)
        at[fresh[short]] = len(self.place) + np.arange(int(short.sum()))
        self._keep([chunks[i] for i in fresh[short].tolist()])
        # long chunks and whole texts are encoded one by one and not kept; they stand behind the kept chunks
        n, long = len(self.place), fresh[~short]
        at[long] = n + np.arange(len(long))
        apart = list(self._encode([chunks[i] for i in long.tolist()] + texts.take(pa.array(whole)).to_pylist()))
        sizes = np.array([len(x) for x in apart], np.int64)
        flat = np.concatenate([self.flat[: self.used], *apart])
        first, size = np.concatenate([self.first[:n], self.used + np.cumsum(sizes) - sizes]), np.concatenate([self.size[:n], sizes])
        counts = np.zeros(len(some), np.int64)
        counts[rows], counts[whole] = pc.list_value_length(lists).to_numpy(zero_copy_only=False), 1
        units = np.concatenate([at[coded.indices.to_numpy(zero_copy_only=False)], n + len(long) + np.arange(len(whole))])
        if len(whole):
            units = units[np.argsort(np.concatenate([np.repeat(rows, counts[rows]), whole]), kind="stable")]
        ends = np.concatenate([[0], np.cumsum(size[units])])[np.cumsum(counts)]
        return _runs(flat, first[units], size[units]), ends

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the leading mark: the fast form of decode for whole round trips."""
        n = self.piece_sizes[ids]
        stop = np.cumsum(n)
        if not len(ids):
            return b""
        out = self.piece_bytes[np.repeat(self.piece_ends[ids] - stop, n) + np.arange(int(stop[-1]))].tobytes()
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode_batch(ids, skip_special_tokens=False)


#: What a worker's last task left: a codec without chunks.  To build one takes over a second, and a large input has thousands of tasks.
_spare: dict[tuple[bytes, int, bool], Codec] = {}


@contextmanager
def _codec(data: bytes, threads: int, parity: bool) -> Iterator[Codec]:
    key = (data, threads, parity)
    codec = _spare.pop(key, None) or Codec(data, threads, parity)
    yield codec
    codec.clear()
    _spare.clear()
    _spare[key] = codec


def _encode(data: bytes, threads: int, parity: bool, text_at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data, threads, parity) as codec:
            for batch in batches:
                for piece in pieces(batch, text_at):
                    texts = piece.column(text_at)
                    ids, ends = codec.encode(texts)
                    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    exact = [codec.decode_bytes(ids[a:b]) == (t or "").replace(MARK, " ").encode() for a, b, t in zip(first, ends, texts.to_pylist(), strict=True)]
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns = [piece.column(i) for i in range(piece.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(np.diff(np.concatenate([[0], ends]))), pa.array(exact)], names=[*piece.schema.names[:-1], "ids", "n_ids", "exact"])

    return run


def encode_texts(docs: DataFrame, model: bytes, text_col: str = "text", threads: int = 2, parity: bool = True) -> DataFrame:
    """Adds ids, n_ids and exact (whether the ids decode to the whole text, with any U+2581 as a space).

    A null or empty text has no ids and is exact.  Columns of these three names are replaced; others
    stay.  exact is false where a model drops characters: unknown ones without byte fallback, or spaces
    that its normaliser squeezes.  Rows are encoded one by one, whole, and nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("ids", "n_ids", "exact")]
    schema = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text_col}`").cast("string").alias("body"))
    return out.mapInArrow(_encode(model, threads, parity, len(kept)), f"{schema}ids array<int>, n_ids long, exact boolean").toDF(*kept, "ids", "n_ids", "exact")


def decode_ids(encoded: DataFrame, model: bytes, ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """Adds `decoded`, the text of a list of ids; a null list gives null.  A column `decoded` is replaced."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = "".join(f"c{i} {encoded.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(model, threads, False) as codec:
            for batch in batches:
                lists = batch.column(batch.num_columns - 1).to_pylist()
                texts = iter(codec.decode([x for x in lists if x is not None]))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array([None if x is None else next(texts) for x in lists], pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    return encoded.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{ids_col}`").cast("array<int>").alias("body")).mapInArrow(run, f"{schema}decoded string").toDF(*kept, "decoded")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, load_model(spark)).drop("text")
