"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

The vocabulary of byte strings becomes sentencepiece pieces (each byte mapped to a printable character, score the
negative rank, identity normalisation). A text is cut into pre-tokens, each pre-token is encoded by the model, and
the ids map back to bytes by the inverse table.

Null texts count as empty. Empty texts have no ids. Rows are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textops import sliced

#: Pre-tokens that a worker remembers; a full memory is emptied.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it has one, otherwise one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file ("base64 rank" a line), in order of rank from 0 without gaps."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is byte string i (score -i); the last piece is the unknown one."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(vocabulary):
        out += _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # model_type BPE, vocab_size, and the ids of unk, bos, eos, pad
    out += _field(2, _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


#: A common pattern of byte-level BPE, and the same for texts of Latin-1 letters, where the re module does it faster.
_COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = _COMMON.replace(r"\p{L}+", r"[A-Za-zÀ-ÖØ-öø-ÿ]+").replace(r"\p{L}", "A-Za-zÀ-ÖØ-öø-ÿ").replace(r"\p{N}+", "[0-9]+").replace(r"\p{N}", "0-9")
_IN_LATIN = re.compile(r"[\t-\r -~\xa0-©«-±´¶-¸»¿-ÿ]*").fullmatch


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encodes and decodes texts by a serialised model."""

    def __init__(self, model: bytes, vocabulary: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.vocabulary = vocabulary
        self.any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.latin = re.compile(_LATIN).findall if pattern == _COMMON else None
        self.table = dict(enumerate(byte_characters()))
        self.memory: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.latin(text) if self.latin and _IN_LATIN(text) else self.any(text)

    def mapped(self, token: str) -> str:
        return token.encode("utf-8", "replace").decode("latin-1").translate(self.table)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, tokens = self.memory, [self.split(x) for x in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*tokens).difference(known)
        broken = [x for x in new if "\n" in x]
        plain = list(new.difference(broken))
        pieces = [*map(self.mapped, broken), *(self.mapped("\n".join(plain)).split(self.table[10]) if plain else ())]
        for token, own in zip(broken + plain, self.model.encode(pieces, num_threads=1), strict=True):
            known[token] = _packed(own)
        return [b"".join(map(known.__getitem__, x)) for x in tokens]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def _codec(key: int, holder) -> Codec:
    return Codec(*holder.value)


class _Holder:
    """Hashes alike for one broadcast, so that a worker builds its codec once."""

    def __init__(self, broadcast):
        self.broadcast = broadcast
        self.key = broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else 0

    def __getstate__(self):
        return {"broadcast": self.broadcast, "key": self.key}

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.broadcast.value


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_decode(df: DataFrame, text: str = "text", *, vocabulary_path: str | None = None, pattern: str | None = None, ids: str = "ids_le", decoded: str = "decoded") -> DataFrame:
    """Adds two binary columns: `ids` (little-endian unsigned 32-bit ids of the text) and `decoded` (bytes of those ids).

    The model (a few MB, bounded by the vocabulary) is built on the driver and broadcast; no other column is read by
    Python. Columns of the input that have the new names are replaced.
    """
    vocabulary = read_ranks(vocabulary_path or default_vocabulary_path())
    holder = _Holder(df.sparkSession.sparkContext.broadcast((serialise_model(vocabulary), vocabulary, pattern or default_pattern())))
    kept = df.drop(*{ids, decoded} & set(df.columns))
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])
    at = names.index(text)

    def run(batches):
        codec = _codec(holder.key, holder)
        for batch in sliced(batches, 256):
            encoded = codec.encode([x or "" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoded, pa.binary()), pa.array(map(codec.decode, encoded), pa.binary())], [*names, ids, decoded])

    return kept.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """op9: per document the number of ids and digests of ids and decoded bytes."""
    coded = encode_decode(df.select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
