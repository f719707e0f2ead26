"""Problem 6: the corpus encoded with a public byte-level BPE vocabulary, by a sentencepiece model built from it.

The vocabulary's ranks are written straight into sentencepiece's model format: each piece is a token's bytes, mapped
one by one to printable letters, with its negative rank as score, so that the best-scored merge is the one of lowest
rank. Normalisation is the identity. A text is cut into pre-tokens, each is byte-mapped and encoded on its own, and
ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the public pre-token pattern of this vocabulary, white space spelled out by code point.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Distinct pre-tokens whose ids a worker keeps; a full cache is emptied, which costs time and nothing else.
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_letters() -> list[str]:
    """A printable letter for each byte: its own where Latin-1 prints it, else the next free one from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) not in (" ", "­")]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(tag: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes with their length, a float as 32 bits, else a varint."""
    if isinstance(value, bytes):
        return _number(tag << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    return _number(tag << 3) + _number(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""
    letters = byte_letters()
    by_rank = sorted((rank, token) for token, rank in ranks.items())
    if [rank for rank, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have gaps")
    pieces = [_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1)) for rank, token in by_rank]
    unknown = len(pieces)
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, unknown) + b"".join(_number(tag << 3) + _number((1 << 64) - 1) for tag in (41, 42, 43))
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class Encoder:
    """Encodes and decodes texts; made once in each worker from the serialised model."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN, regex.VERSION1).findall
        letters = byte_letters()
        self.latin = str.maketrans({chr(b): letters[b] for b in range(256)})
        self.back = {ord(letter): b for b, letter in enumerate(letters)}
        self.cache: dict[str, list[int]] = {}

    def mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.latin)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        words = self.cut(text)
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list(dict.fromkeys(words))
            for word, ids in zip(new, self.pieces.encode([self.mapped(w) for w in new], num_threads=1), strict=True):
                cache[word] = ids
        for word in words:
            out += cache[word]
        return out

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.pieces.id_to_piece(i) for i in ids)
        return bytes(self.back[ord(c)] for c in letters).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def worker_model(spark: SparkSession, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Callable[[], Encoder]:
    """The model, built once on the driver (about 1 MB whatever the data) and sent to each executor once."""
    sent = spark.sparkContext.broadcast(model_bytes(read_ranks(os.path.join(directory, vocabulary))))
    return lambda: encoder_of(sent.value)


def encoded(documents: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, ids). Null and empty texts have the empty list; whole texts are encoded,
    and text that looks like a special token is text. Repeated rows stay rows; other columns aren't read."""
    make = worker_model(documents.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            ids = pa.array([encoder.encode(text) for text in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def sized(documents: DataFrame, *keep: str, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents -> (doc_id, *keep, n_tokens: bigint), without carrying the ids."""
    make = worker_model(documents.sparkSession, directory, vocabulary)
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            counts = pa.array([len(encoder.encode(text)) for text in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), counts], [*kept, "n_tokens"])

    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.select(*kept, "text").mapInArrow(run, f"{kinds}, n_tokens bigint")


def decoded(encodings: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), the inverse of ``encoded`` for non-null texts."""
    make = worker_model(encodings.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            texts = pa.array([None if ids is None else encoder.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    kind = encodings.schema["doc_id"].dataType.simpleString()
    return encodings.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
