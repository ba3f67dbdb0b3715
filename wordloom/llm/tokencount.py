"""Token counts with overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in chunks that overlap, with
the offsets of all tokens.  Two neighbouring encodings are spliced at a stable common boundary in
the overlap: a place where both have a token begin, and of which it is proven that
tokens on either side do not depend on the other side.  For a tokenizer that
drops white space that is any token that follows an ASCII space (its merges see one word at a
time); for a piece model without pieces that go on over a space it is a token that begins with the space
after a letter or digit; for others the encodings must agree on ``agree`` tokens on
each side of the place.  If no such place is in the overlap it is doubled, at last
to the whole rest of the text, so a text without any boundary is encoded whole
and the count is always the library's own.  Shorter texts are counted at once.

Defined cases.  Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted one by
one.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm.encode import SPACES, json_encoder

CHUNK, OVERLAP, AGREE = 16_384, 256, 8


class _Json:
    def __init__(self, path: str):
        self.encoder = json_encoder(path)

    def starts(self, text: str) -> np.ndarray:
        got = self.encoder.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in got), np.int64, len(got))

    def stable(self, text: str, at: np.ndarray) -> np.ndarray | None:
        """Of tokens that begin at ``at`` (ascending), those no merge can cross; None if that is not known."""
        if not self.encoder.by_word:
            return None
        return np.fromiter((a > 0 and text[a - 1] in SPACES for a in at.tolist()), bool, len(at))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        return self.encoder.counts(texts)


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # no piece goes on over a space after other characters: then no merge crosses one
        self.by_space = not any("\u2581" in p.lstrip("\u2581") for p in pieces)

    def starts(self, text: str) -> np.ndarray:
        places = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # places are bytes
        return character[np.minimum(places, len(data) - 1)] if len(data) else places

    def stable(self, text: str, at: np.ndarray) -> np.ndarray | None:
        if not self.by_space:
            return None
        return np.fromiter((text[a] == " " and text[a - 1].isascii() and text[a - 1].isalnum() for a in at.tolist()), bool, len(at))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        return np.array([len(x) for x in self.model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)], np.int64)


@cache
def counter(path: str) -> _Json | _Pieces:
    return _Json(path) if path.endswith(".json") else _Pieces(path)


def common_boundary(left: np.ndarray, right: np.ndarray, begin: int, end: int, stable, agree: int = AGREE) -> int | None:
    """A place strictly inside (begin, end) where two encodings can be spliced: the middle one of those proven."""
    shared = np.intersect1d(left, right)
    shared = shared[(shared > begin) & (shared < end)]
    proven = stable(shared)
    if proven is not None:
        shared = shared[proven]
    else:
        same = []
        for at in shared.tolist():
            i, j = np.searchsorted(left, at), np.searchsorted(right, at)
            a, b = left[max(i - agree, 0): i + agree], right[max(j - agree, 0): j + agree]
            same.append(i >= agree and j >= agree and len(a) == len(b) == 2 * agree and bool((a == b).all()))
        shared = shared[np.array(same, bool)] if len(shared) else shared
    return int(shared[len(shared) // 2]) if len(shared) else None


def spliced_count(text: str, library: _Json | _Pieces, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded in overlapping chunks."""
    begin, end, cut, total = 0, min(chunk, len(text)), 0, 0
    left = library.starts(text[:end])
    while end < len(text):
        width = overlap
        while True:
            start = max(end - width, cut, begin)
            stop = min(start + max(chunk, 2 * width), len(text))
            right = library.starts(text[start:stop]) + start
            at = common_boundary(left, right, max(start, cut), end, lambda x: library.stable(text, x))
            if at is not None:
                total += int(np.searchsorted(left, at) - np.searchsorted(left, cut))
                break
            if start == max(cut, begin):  # nothing left to widen: the last chunk again, longer
                start, stop = begin, min(max(stop, end + 2 * (end - begin)), len(text))
                at, right = cut, library.starts(text[begin:stop]) + begin
                break
            width *= 2
        begin, cut, left, end = start, at, right, stop
    return total + int(len(left) - np.searchsorted(left, cut))


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit -- a row per input row; ``tokenizer``: a .json or .model file every task can read."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(rows, texts):
        library = counter(tokenizer)
        raw = texts.cast(pa.large_binary()).to_pylist()
        size = np.array([len(t) for t in raw], np.int64)
        tokens = np.zeros(len(raw), np.int64)
        long = [i for i in np.flatnonzero(size > chunk) if len(raw[i].decode("utf-8", "replace")) > chunk]
        rest = np.setdiff1d(np.arange(len(raw)), long)
        tokens[rest] = library.counts([raw[i] for i in rest])
        for i in long:
            tokens[i] = spliced_count(raw[i].decode("utf-8", "replace"), library, chunk, overlap)
        return {"id": rows["id"], "n_bytes": size, "n_tokens": tokens, "over_limit": tokens > limit}

    return cm.map_texts(docs, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", doc_id)
