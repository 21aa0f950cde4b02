"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Short texts go to the library as they are. A text of more than `chunk` characters is encoded in chunks that overlap by
`overlap` characters, with the offsets of the pieces. Neighbouring chunks are spliced at a character position where both
encodings begin a piece and which is proven stable: a space after something else, in a vocabulary where no piece holds
such a pair, so that no merge can cross it and what follows it is encoded as in the whole text. Where an overlap has no
such position, it is doubled, up to the whole rest of the text.

Defined results: null or empty text has 0 bytes and 0 tokens; very long texts are counted whole, by chunks where the
vocabulary allows it; counts have no ties; repeated rows, and rows of one key, are counted each; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.common import slices, text_buffer

SCHEMA = "n_bytes bigint, n_tokens bigint, over_limit boolean"
_MARK = "▁"


def model_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def space_is_stable(path: str) -> bool:
    """Whether no merge can cross a space that follows another character, and characters are taken as they are."""
    sp = load(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    crossing = any(a != _MARK and b == _MARK for p in pieces for a, b in zip(p, p[1:], strict=False))
    probe = "x  ½ ﬁ y "
    kept = "".join(p.surface for p in sp.encode(probe, return_type="proto").pieces)
    return not crossing and kept == probe


def decoded(column: pa.Array) -> list[str]:
    """Python strings; null is empty, broken UTF-8 is replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _begins(sp, text: str) -> list[int]:
    """The character offset at which each token begins; the library tells offsets in bytes."""
    begins = [p.begin for p in sp.encode(text, return_type="proto").pieces]
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return begins
    return (np.cumsum((data & 0xC0) != 0x80)[begins] - 1).tolist()


def spliced_count(path: str, text: str, chunk: int, overlap: int) -> int:
    """Tokens of the whole text, from overlapping chunks."""
    sp = load(path)
    if len(text) <= chunk or not space_is_stable(path):
        return len(sp.encode(text))
    total, frm, end = 0, 0, chunk  # tokens before character frm are counted
    begins = _begins(sp, text[:end])
    base = 0  # of the chunk that begins are of
    while end < len(text):
        width = overlap
        while True:
            low = max(end - width, base)
            stop = min(low + chunk + width, len(text))
            ahead = _begins(sp, text[low:stop])
            common = {b + base for b in begins} & {b + low for b in ahead}
            at = max((x for x in common if max(low, frm) < x < end and text[x] == " " and text[x - 1] != " "), default=None)
            if at is not None:
                total += sum(frm <= b + base < at for b in begins)
                frm, base, begins, end = at, low, ahead, stop
                break
            if low == base:  # nothing to align on in the whole chunk: it grows
                stop = min(end + max(chunk, end - base), len(text))
                begins, end = _begins(sp, text[base:stop]), stop
                break
            width *= 2
    return total + sum(frm <= b + base for b in begins)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = 32768, overlap: int = 256) -> DataFrame:
    """One row per row of docs: the key, UTF-8 bytes, tokens, and whether they are more than limit."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches):
        path = model_path(model)
        sp = load(path)
        for batch in batches:
            for part in slices(batch, text):
                n_bytes = [int(x) for x in _sizes(part.column(text))]
                strings = decoded(part.column(text))
                short = [i for i, x in enumerate(strings) if len(x) <= chunk]
                counts = [0] * len(strings)
                for i, ids in zip(short, sp.encode([strings[i] for i in short], num_threads=1), strict=True):
                    counts[i] = len(ids)
                for i, x in enumerate(strings):
                    if len(x) > chunk:
                        counts[i] = spliced_count(path, x, chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, {SCHEMA}")


def _sizes(column: pa.Array):
    _, offsets = text_buffer(column)
    return offsets[1:] - offsets[:-1]
