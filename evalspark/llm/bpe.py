"""Byte-level BPE encoding by tree concatenation, and decoding.

Texts up to ``piece_chars`` are encoded in one go. A longer text is cut into pieces that Spark spreads over tasks;
each piece is encoded on its own. Neighbours are then joined pair by pair, like a tree: the tokens around a join are
decoded and encoded again as one window, and the window grows until its outer tokens agree with those of both sides.
Tokens that agree carry the proof: a sequence is the encoding of its bytes when every adjacent pair is, and beyond an
agreeing token all pairs are those of a valid side. A window starts with 16 tokens a side, more than a special token's
length, and covers a whole side at the latest, so the result is exact for any text, with or without white space.

Strings of special tokens in a text are encoded as those tokens, as the tokenizers library does by default.

Edge cases. A null or empty text has no tokens and decodes to the empty string. Rows repeat as they come. All columns
of the input stay; ``ids`` (unsigned 32-bit little-endian) and ``n_tokens`` are added, or replaced if they exist.
"""

from __future__ import annotations

import base64
import functools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SPECIAL = {"byte_bpe_50k.tiktoken": {"<|endoftext|>": 50256}}
PIECE_CHARS = 32_768
FIRST_WINDOW, AGREE = 16, 2
BATCH_CHARS = 1 << 20


class Vocabulary:
    """Token bytes and the encoder of short texts, loaded once per Python worker from a vocabulary file.

    The encoder is built when a text is encoded: a worker that only decodes does not hold one.
    """

    def __init__(self, path: str, special: dict[str, int]):
        self.path, self.names, self.special = path, special, set(special)
        ranks = self._ranks()
        self.token = [b""] * (1 + max(max(ranks.values()), *special.values()))
        for word, i in [*ranks.items(), *((name.encode(), i) for name, i in special.items())]:
            self.token[i] = word

    def _ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    @functools.cached_property
    def encoder(self):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self._ranks(), special_tokens=self.names)

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode(text, allowed_special=self.special, disallowed_special=())

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


@functools.cache
def vocabulary(name: str) -> Vocabulary:
    """A vocabulary by file name or path; the public files are found on the worker itself."""
    import os

    import public_tokenizers

    path = name if os.path.sep in name else public_tokenizers.path(name)
    return Vocabulary(path, SPECIAL[os.path.basename(name)])


def join(left: list[int], right: list[int], v: Vocabulary, agree: int = AGREE) -> list[int]:
    """Encoding of the two sides' concatenated bytes, from the encodings of the sides."""
    if not left or not right:
        return left + right
    width = FIRST_WINDOW
    while True:
        i, j = max(0, len(left) - width), min(len(right), width)
        while 0 < i and v.token[left[i]][0] & 0xC0 == 0x80:  # not inside a character
            i -= 1
        while j < len(right) and v.token[right[j]][0] & 0xC0 == 0x80:
            j += 1
        window = v.encode(v.decode(left[i:] + right[:j]).decode("utf-8"))
        a, b = min(agree, len(left) - i), min(agree, j)
        if (i == 0 or window[:a] == left[i : i + a]) and (j == len(right) or window[-b:] == right[j - b : j]):
            return left[:i] + window + right[j:]
        width *= 2


def join_all(parts: list[list[int]], v: Vocabulary) -> list[int]:
    """Pairwise joins, level by level."""
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2], v) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _counts(ids: list[bytes]) -> pa.Array:
    return pa.array([len(i) // 4 for i in ids], pa.int64())


def unpacked(ids: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(ids) // 4}I", ids)


def _slices(table: pa.RecordBatch, sizes, limit: int):
    """Parts of a batch with about ``limit`` in size each."""
    start = total = 0
    for row, size in enumerate(sizes):
        total += size or 0
        if total >= limit:
            yield table.slice(start, row + 1 - start)
            start, total = row + 1, 0
    if start < table.num_rows:
        yield table.slice(start)


def _add(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [name for name in batch.schema.names if name not in columns]
    arrays = [batch.column(name) for name in kept] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])


def _schema_with(df: DataFrame, **kinds: str) -> str:
    from pyspark.sql.types import StructType

    kept = StructType([f for f in df.schema.fields if f.name not in kinds])
    added = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in kinds.items()))
    return StructType(kept.fields + added.fields)


def encode(docs: DataFrame, vocab: str = "byte_bpe_50k.tiktoken", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` of ``text``. Short texts are never shuffled, pieces of long ones are."""
    import pyspark.sql.types as T

    def whole(batches):
        v = vocabulary(vocab)
        for batch in batches:
            for part in _slices(batch, pa.compute.utf8_length(batch.column("text")).to_pylist(), BATCH_CHARS):
                ids = [packed(v.encode(t)) if t else b"" for t in part.column("text").to_pylist()]
                yield _add(part, n_tokens=_counts(ids), ids=pa.array(ids, pa.binary()))

    long = F.coalesce(F.char_length("text"), F.lit(0)) > piece_chars
    short = docs.where(~long)
    done = short.mapInArrow(whole, _schema_with(short, n_tokens="bigint", ids="binary"))

    # Pieces are keyed by a number of their row. The numbered rows are stored: the plan reads them twice, and a number that
    # were given anew on unstored input could name another row.
    row, piece = _free("_row", docs), _free("_piece", docs)
    rows = stored(docs.where(long).drop("n_tokens", "ids").withColumn(row, F.monotonically_increasing_id()), "long-texts")
    count = F.ceil(F.char_length("text") / piece_chars).cast("int")
    pieces = rows.select(row, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias(piece)).select(
        row, piece, F.substring("text", F.col(piece) * piece_chars + 1, F.lit(piece_chars)).alias("text"))
    spread = pieces.repartition(F.col(row), F.col(piece))
    encoded = spread.mapInArrow(whole, _schema_with(spread, n_tokens="bigint", ids="binary")).select(row, piece, "ids")

    def joined(batches):
        v = vocabulary(vocab)
        for batch in batches:
            ids = [packed(join_all([list(unpacked(p)) for p in parts.as_py()], v)) for parts in batch.column("parts")]
            yield pa.RecordBatch.from_arrays([batch.column(row), _counts(ids), pa.array(ids, pa.binary())], names=[row, "n_tokens", "ids"])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct(piece, "ids"))), lambda p: p["ids"])
    grouped = encoded.groupBy(row).agg(ordered.alias("parts"))
    whole_ids = grouped.mapInArrow(joined, T.StructType.fromDDL(f"`{row}` bigint, n_tokens bigint, ids binary"))
    return done.unionByName(rows.join(whole_ids, row).drop(row))


def _free(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def decode(tokens: DataFrame, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Add ``decoded``: the text of ``ids``, special tokens included; bytes that are no UTF-8 become U+FFFD."""

    def texts(batches):
        v = vocabulary(vocab)
        for batch in batches:
            for part in _slices(batch, pa.compute.binary_length(batch.column("ids")).to_pylist(), 4 * BATCH_CHARS):
                out = [v.decode(unpacked(i)).decode("utf-8", "replace") if i else "" for i in part.column("ids").to_pylist()]
                yield _add(part, decoded=pa.array(out, pa.string()))

    return tokens.mapInArrow(texts, _schema_with(tokens, decoded="string"))
