"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is a protobuf message; ``parse_model`` reads its wire format and gives the pieces with
their scores and kinds, the model type and the normaliser's settings.  ``build`` rebuilds the
tokenizer from them: character map, white space handling, the metaspace marker, byte fallback, and
either the unigram scores or, for a BPE model, the merges that the piece scores imply.  Texts are
encoded in batches, in as many threads as the task has cores (``spark.task.cpus``), and parity with the sentencepiece library
itself is reported for every text, ids and decoded text both.

The model is read once on the driver (a vocabulary, well below a megabyte for 32,000 pieces) and its bytes
travel with the job, so executors need no file.

Edge cases: null text is empty; an empty text has no tokens and decodes to itself.  Texts of any length are
encoded whole.  A literal metaspace marker in a text decodes to a space, as sentencepiece does.
Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows

# Field numbers and enumerations of the model file format, and the metaspace marker.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNK_ID = 3, 35, 40
CHARS_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 1 << 19
KNOWN_WORDS = 200_000
WORDS_AT_ONCE = 1000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    chars_map: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(field number, value) of a protobuf message: varints, 32-bit floats, 64-bit values and byte strings."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        else:
            raise ValueError(f"wire type {kind} is not part of a model file")
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == PIECES:
            piece = {PIECE_SCORE: 0.0, PIECE_KIND: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[PIECE_TEXT].decode(), piece[PIECE_SCORE], piece[PIECE_KIND]))
        elif number == TRAINER:
            spec = dict(_fields(value))
            model.kind = spec.get(MODEL_TYPE, UNIGRAM)
            model.byte_fallback = bool(spec.get(BYTE_FALLBACK, 0))
            model.unk_id = spec.get(UNK_ID, 0)
        elif number == NORMALIZER:
            spec = dict(_fields(value))
            model.chars_map = spec.get(CHARS_MAP, b"")
            model.dummy_prefix = bool(spec.get(DUMMY_PREFIX, 1))
            model.remove_extra_spaces = bool(spec.get(EXTRA_SPACES, 1))
            model.escape_spaces = bool(spec.get(ESCAPE_SPACES, 1))
    return model


def implied_merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces whose concatenation is a piece, best score first, then by the left part's length."""
    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for text, i in ids.items():
        for k in range(1, len(text)):
            if text[:k] in ids and text[k:] in ids:
                found.append((-model.pieces[i][1], i, k, text[:k], text[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model, careful: bool = True):
    """The tokenizers.Tokenizer equivalent to the model.

    No piece of a usual model holds a marker behind another character, so texts may be cut before
    every run of markers.  The faster cut, before every marker, is for texts without runs of
    markers (``careful`` false).
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = model.pieces[model.unk_id][0]
    if model.kind == UNIGRAM:
        backend = models.Unigram([(t, s) for t, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        backend = models.BPE({t: i for i, (t, _, _) in enumerate(model.pieces)}, implied_merges(model), unk_token=unk,
                             fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.chars_map)] if model.chars_map else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if model.escape_spaces and all(MARK not in t.lstrip(MARK) for t, _, k in model.pieces if k == NORMAL):
        out.pre_tokenizer = (pre_tokenizers.Split(Regex(MARK + "+[^" + MARK + "]*"), "isolated") if careful
                             else pre_tokenizers.Split(MARK, "merged_with_next"))
    trim = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *trim])
    return out


class Codec:
    """Encodes and decodes batches of texts with a model."""

    def __init__(self, data: bytes):
        self.model = parse_model(data)
        self.careful, self.fast = build(self.model), build(self.model, careful=False)
        m = self.model
        # pieces stay within a word and every word gets a marker: words may be encoded once and put together
        self.by_word = (m.dummy_prefix and m.escape_spaces and not m.chars_map and not m.remove_extra_spaces
                        and all(MARK not in t.lstrip(MARK) for t, _, k in m.pieces if k == NORMAL))
        self.known: dict[str, bytes] = {}
        self.leads = np.array([t[:1] == MARK for t, _, _ in m.pieces])
        # a piece's bytes as they stand in the text, None for pieces that only the backend's decoder knows; their
        # characters, None where they need their neighbours
        self.shown = [t.replace(MARK, " ").encode() if k in (NORMAL, USER_DEFINED) else bytes([int(t[3:5], 16)]) if k == BYTE else None
                      for t, _, k in self.model.pieces]
        self.chars = [None if b is None or len(b) == 1 and b[0] > 127 else b.decode() for b in self.shown]

    def _learn(self, words: list[str]) -> None:
        """Ids of words without spaces and markers: a thousand words to a text, cut again at the pieces with a marker."""
        for at in range(0, len(words), WORDS_AT_ONCE * 64):
            texts = [words[i:i + WORDS_AT_ONCE] for i in range(at, min(len(words), at + WORDS_AT_ONCE * 64), WORDS_AT_ONCE)]
            for part, e in zip(texts, self.fast.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<i4")
                cuts = [*np.flatnonzero(self.leads[ids]).tolist(), len(ids)]
                data = ids.tobytes()
                for w, start, end in zip(part, cuts[:-1], cuts[1:], strict=True):
                    self.known[w] = data[4 * start:4 * end]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out: list = [None] * len(texts)
        plain, rest = [], []
        for i, t in enumerate(texts):
            careful = not self.by_word or t[:1] == " " or t[-1:] == " " or "  " in t or MARK in t
            (rest if careful else plain).append(i)
        words = [texts[i].split(" ") if texts[i] else [] for i in plain]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self._learn(list(set(filterfalse(self.known.__contains__, chain.from_iterable(words)))))
        for i, ws in zip(plain, words, strict=True):
            out[i] = b"".join(map(self.known.__getitem__, ws))
        for i, e in zip(rest, self.careful.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<i4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, "<i4").tolist() for b in self.encode_bytes(texts)]

    def decode(self, batch: list[list[int]]) -> list[str]:
        """Pieces put together, a replacement character for each byte that is no UTF-8; what has other pieces goes through the backend's decoder."""
        codecs.register_error("one_mark_a_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        out: list = []
        for ids in batch:
            try:
                text = "".join(map(self.chars.__getitem__, ids))
            except TypeError:
                try:
                    text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "one_mark_a_byte")
                except TypeError:
                    out.append(self.careful.decode(ids, skip_special_tokens=False))
                    continue
            out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        return out


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _codec(data: bytes):
    """Codec and reference of a model, built once in a Python worker."""
    import sentencepiece

    # this module travels by value, anew with every task; an attribute of an installed one stays in the worker
    built = sentencepiece.__dict__.setdefault("_codecs_of_models", {})
    name = hashlib.sha256(data).hexdigest()
    if name not in built:
        built[name] = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    return built[name]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _coded(data: bytes, column: pa.Array) -> Iterator[tuple[list[str], list[bytes], list[list[int]], list[str], list[bool]]]:
    """(texts, id bytes, ids, decoded texts, parity) of the texts of a column, slice by slice, with the cores of the task."""
    task = TaskContext.get()
    threads = task.cpus() if task else 1
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    codec, reference = _codec(data)
    for part in _slices(column.fill_null("").to_pylist()):
        coded = codec.encode_bytes(part)
        ids = reference.encode(part, num_threads=threads)
        same = [array("i", theirs).tobytes() == own for own, theirs in zip(coded, ids, strict=True)]
        ids = [theirs if s else np.frombuffer(own, "<i4").tolist() for own, theirs, s in zip(coded, ids, same, strict=True)]
        decoded = codec.decode(ids)
        parity = [s and a == b for s, a, b in zip(same, decoded, reference.decode(ids, num_threads=threads), strict=True)]
        yield part, coded, ids, decoded, parity


def encode(documents: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, ids, decoded, parity`` per row; parity: the sentencepiece library gives the same ids and the same text for them."""
    data = read_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, _, ids, decoded, parity in _coded(data, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(parity)],
                    names=["doc_id", "ids", "decoded", "parity"])
                at += len(ids)

    docs = arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string, parity boolean")


def digest(documents: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, parity``; ids are hashed as little-endian 32-bit numbers."""
    data = read_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts, coded, ids, decoded, parity in _coded(data, batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(ids)), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in coded], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                    pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()), pa.array(parity, pa.bool_()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity"])
                at += len(ids)

    docs = arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean")
