"""Alignment of two tokenizers' tokens over the bytes of each text, in Arrow tables.

A text (with one space before it) is encoded by a byte-level BPE (A) and by a piece model (B, which adds that space
itself).  Tokens are lists in an Arrow column: flattened, with the indices of their parents, their byte
lengths are summed up inside each parent, and an Acero hash join on (parent, end) finds the pairs of tokens that
end together.  The common ends cut a text into groups; ``Table.group_by`` counts the pairs of ids of a slice of
texts, and Spark merges these partial counts over the corpus.

One pass encodes and writes a row per slice of about 1 MB of text beside the checkpoints: for its documents
the numbers and the hash of the groups, the slice's distinct pairs with their counts, and which of them each
document has how often.  A second pass joins these pairs with the corpus counts.

The corpus counts are broadcast.  Their size is bounded by the vocabularies, not by the corpus: tokens that end together
are such that the bytes of one are an ending of the other's, and ``pair_bound`` counts such pairs (324,302 rows of 17
bytes with the given files).

Long texts are cut into units before a single space between two ASCII letters.  There A always begins a new token
and, where no piece of B goes on over a space (else texts are not cut), B does too, so units are
encoded apart and memory is bounded by the unit, but for the ids themselves.

Defined cases.  Null and empty texts, and texts of which either tokenizer's bytes do not give the text back,
have no tokens: zeros and an empty hash; they count for no pair.  Repeated rows are counted one by one, null ids kept.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm.tokenids import fresh_path

UNIT_CHARS = 1 << 19
CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
#: Characters for which two libraries' splitting patterns are compared one by one before the faster one is used.
SETTLED = re.compile("[\x00-\u024f\u2010-\u2027]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for the characters from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(other)}


class BytePairs:
    """A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        alphabet = byte_of_character()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokens = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in (self.library.id_to_token(i) or "" for i in range(size))]
        self.fast = self._fast(path)

    def _fast(self, path: str):
        """The same merges in the tiktoken library, if they can be given by rank and both split every settled character alike; else None."""
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, split = config["model"], config.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not config.get("normalizer") and not model.get("ignore_merges")
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]] if plain else [-1]
        if merged != sorted(set(merged)) or merged[0] < 0:
            return None
        import tiktoken

        added = {t["id"] for t in config.get("added_tokens", [])}
        ranks = {self.tokens[i]: i for i in model["vocab"].values() if i not in added}
        fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        probes = [f"a{c}b{c}1{c}. {c} {c}{c}'s{c}\n{c}" for c in map(chr, chain(range(0x250), range(0x2010, 0x2028)))]
        return fast if [fast.encode_ordinary(p) for p in probes] == self._library(probes) else None

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._library(texts)
        other = [i for i, t in enumerate(texts) if not SETTLED.fullmatch(t)]
        out = [None if i in other else self.fast.encode_ordinary(t) for i, t in enumerate(texts)] if other else [self.fast.encode_ordinary(t) for t in texts]
        for i, ids in zip(other, self._library([texts[i] for i in other]) if other else [], strict=True):
            out[i] = ids
        return out


class Pieces:
    """B: a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_space = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers with the bytes of their tokens, and the parts of a groups string: ids followed by ``,`` or by what ends their side of a group."""

    def __init__(self, a: str, b: str):
        self.a, self.b = BytePairs(a), Pieces(b)
        self.bytes = tuple(pa.array(t.tokens, pa.large_binary()) for t in (self.a, self.b))
        n, m = len(self.a.tokens), len(self.b.tokens)
        self.parts = pa.array([f"{i}{end}" for size, last in ((n, "|"), (m, ";")) for end in (",", last) for i in range(size)], pa.large_string())
        self.shift = (n, 2 * n, m)


@cache
def pair_of(a: str, b: str) -> Pair:
    return Pair(a, b)


def pair_bound(pair: Pair) -> int:
    """How many pairs of ids can end together: the bytes of one are an ending of the other's."""
    def endings(longer: list[bytes], shorter: list[bytes], whole: bool) -> int:
        times = Counter(shorter)
        return sum(times[t[k:]] for t in longer for k in range(0 if whole else 1, len(t)))

    return endings(pair.a.tokens, pair.b.tokens, True) + endings(pair.b.tokens, pair.a.tokens, False)


def units(text: str, size: int = UNIT_CHARS) -> Iterator[str]:
    """``text`` with a space before it, cut before single spaces between ASCII letters into runs of about ``size`` characters."""
    text, at = " " + text, 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def token_lists(lists: list[list[int]]) -> pa.LargeListArray:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))


def contents(taken: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values of a binary or string array that ``take`` made begin and end, and their concatenated bytes."""
    data = taken.buffers()[2]
    return np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1], memoryview(data if data is not None else b"").cast("B")


def spans(lists: pa.LargeListArray, tokens: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent, id, end) of all tokens, ``end`` in bytes from the beginning of the parent."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    run = pc.cumulative_sum(pc.cast(pc.take(pc.binary_length(tokens), flat), pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), run])                # bytes before each token
    base = pc.take(before, pc.subtract(lists.offsets, lists.offsets[0])[:-1])  # and before each parent's first one
    return parent, flat, pc.subtract(run, pc.take(base, parent))


def unfaithful(lists: pa.LargeListArray, tokens: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Which lists' tokens do not give the text's bytes back."""
    ends, data = contents(pc.take(tokens, pc.list_flatten(lists)))
    at = ends[lists.offsets.to_numpy()]
    return np.array([data[at[i]:at[i + 1]] != t for i, t in enumerate(texts)], bool)


def links(a: pa.LargeListArray, b: pa.LargeListArray, pair: Pair) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """Links (unit, end, a, b, i, j) in order, the last token of each group on either side, and the parts of all groups strings in order."""
    (unit_a, ids_a, end_a), (unit_b, ids_b, end_b) = spans(a, pair.bytes[0]), spans(b, pair.bytes[1])
    n, m = len(ids_a), len(ids_b)
    left = pa.table({"unit": unit_a, "end": end_a, "a": ids_a, "i": pa.array(np.arange(n))})
    right = pa.table({"unit": unit_b, "end": end_b, "b": ids_b, "j": pa.array(np.arange(m))})
    got = left.join(right, ["unit", "end"], join_type="inner", use_threads=False).sort_by([("i", "ascending"), ("j", "ascending")])
    unit, end, i, j = (got[c].to_numpy() for c in ("unit", "end", "i", "j"))
    last = np.ones(len(i), bool)
    last[:-1] = (unit[1:] != unit[:-1]) | (end[1:] != end[:-1])
    i, j = i[last], j[last]
    # a group's A tokens stand before its B tokens
    group_a, group_b = np.searchsorted(i, np.arange(n)), np.searchsorted(j, np.arange(m))
    order = np.empty(n + m, np.int64)
    ends_a, ends_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    ends_a[i], ends_b[j] = 1, 1
    before_b = np.concatenate([[0], j + 1])[group_a]
    order[np.arange(n) + before_b] = ids_a.to_numpy() + pair.shift[0] * ends_a
    order[np.arange(m) + (i + 1)[group_b]] = pair.shift[1] + ids_b.to_numpy() + pair.shift[2] * ends_b
    return got, i, j, pc.take(pair.parts, pa.array(order))


def _block(rows: pa.RecordBatch, texts: pa.Array, pair: Pair) -> dict:
    """One slice: its documents, distinct pairs and each document's pairs, as lists of one row."""
    words = [t.decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).to_pylist()]
    n = len(words)
    of, all_units = [], []
    for row, text in enumerate(words):
        for unit in units(text, UNIT_CHARS if pair.b.by_space else max(len(text) + 1, 1)) if text else ():
            of.append(row)
            all_units.append(unit)
    of = np.array(of, np.int64)
    # units in runs of bounded size (one run, but for long texts)
    size = np.cumsum([0] + [len(u) for u in all_units])
    run_of = size[:-1] // (2 * UNIT_CHARS) if len(all_units) else np.empty(0, np.int64)
    runs, bad = [], np.zeros(n, bool)
    for run in np.unique(run_of):
        at = np.flatnonzero(run_of == run)
        part = [all_units[k] for k in at]
        a, b = token_lists(pair.a.encode(part)), token_lists(pair.b.encode([u[1:] for u in part]))
        raw = [u.encode() for u in part]
        bad[of[at[unfaithful(a, pair.bytes[0], raw) | unfaithful(b, pair.bytes[1], raw)]]] = True
        runs.append((of[at], a, b))
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    hashes = [None] * n
    found = []
    for owner, a, b in runs:
        good = pa.array(~bad[owner])
        owner, a, b = owner[~bad[owner]], a.filter(good), b.filter(good)
        if not len(owner):
            continue
        got, last_i, _, parts = links(a, b, pair)
        unit = got["unit"].to_numpy()
        at_a, at_b = a.offsets.to_numpy(), b.offsets.to_numpy()
        np.add.at(counts["n_a"], owner, np.diff(at_a))
        np.add.at(counts["n_b"], owner, np.diff(at_b))
        np.add.at(counts["n_links"], owner[unit], 1)
        np.add.at(counts["n_groups"], owner[np.searchsorted(at_a, last_i, "right") - 1], 1)
        ends, data = contents(parts)
        for k, row in enumerate(owner.tolist()):
            if hashes[row] is None:
                hashes[row] = hashlib.sha256()
            else:
                hashes[row].update(b";")
            hashes[row].update(data[ends[at_a[k] + at_b[k]]: ends[at_a[k + 1] + at_b[k + 1]] - 1])
        got = got.append_column("row", pa.array(owner[unit])).select(["row", "a", "b"])
        found.append(got.group_by(["row", "a", "b"], use_threads=False).aggregate([([], "count_all")]))
    none = pa.table({"row": pa.array([], pa.int64()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "times": pa.array([], pa.int64())})
    uses = pa.concat_tables([t.rename_columns(["row", "a", "b", "times"]) for t in found]) if found else none
    if len(found) > 1:
        uses = uses.group_by(["row", "a", "b"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["row", "a", "b", "times"])
    partial = uses.group_by(["a", "b"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["a", "b", "c"])
    partial = partial.append_column("pair", pa.array(np.arange(len(partial), dtype=np.int32)))
    uses = uses.join(partial.select(["a", "b", "pair"]), ["a", "b"], join_type="inner", use_threads=False).sort_by([("row", "ascending"), ("pair", "ascending")])
    first = np.searchsorted(uses["row"].to_numpy(), np.arange(n + 1))
    one = {"id": rows["id"], **counts, "sha": ["" if h is None else h.hexdigest() for h in hashes], "first": first,
           "a": partial["a"], "b": partial["b"], "c": partial["c"], "pair": uses["pair"], "times": uses["times"]}
    return {c: _list(v) for c, v in one.items()}


def _list(values) -> pa.Array:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per slice of texts, written beside the checkpoints."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = f"id array<{docs.schema['id'].dataType.simpleString()}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, " \
             "sha array<string>, first array<bigint>, a array<int>, b array<int>, c array<bigint>, pair array<int>, times array<bigint>"
    path = fresh_path(docs.sparkSession, "alignment")
    cm.map_texts(docs, lambda rows, texts: _block(rows, texts, pair_of(a, b)), schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def pair_counts(slices: DataFrame) -> DataFrame:
    """a, b, n_links, best (no other id of A has more links with this id of B) over the corpus; bounded by the vocabularies."""
    one = slices.select(F.explode(F.arrays_zip("a", "b", "c")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.c").alias("n_links"))
    return one.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def aligned(slices: DataFrame, counts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 -- a row per input row."""
    spark = slices.sparkSession
    kind = slices.schema["id"].dataType.elementType.simpleString()
    sink = pa.BufferOutputStream()
    table = counts.select("a", "b", "n_links", "best").toArrow()  # bounded by the vocabularies
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shipped = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    columns = ("id", "n_a", "n_b", "n_groups", "n_links", "sha")

    def run(batches):
        corpus = pa.ipc.open_stream(shipped.value).read_all()
        for batch in batches:
            owner = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["a"]).to_numpy(zero_copy_only=False))
            pairs = pa.table({"at": pa.array(np.arange(len(owner))), "a": batch["a"].flatten(), "b": batch["b"].flatten()})
            pairs = pairs.join(corpus, ["a", "b"], join_type="inner", use_threads=False).sort_by("at")
            total, best = pairs["n_links"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
            base = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(batch)))])
            for k in range(len(batch)):
                at = base[k] + batch["pair"][k].values.to_numpy()
                times, first = batch["times"][k].values.to_numpy(), batch["first"][k].values.to_numpy()
                sums = [np.diff(np.concatenate([[0], np.cumsum(v[at] * times)])[first]) for v in (best, total)]
                values = {c: batch[c][k].values for c in columns} | {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
                yield pa.RecordBatch.from_pydict({c: values[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")})

    cm.workers_find_package(spark)
    rows = slices.drop("c").mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return rows.withColumnRenamed("id", doc_id)


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Both passes over ``docs``; ``a``: a byte-level .json file, ``b``: a .model file, which every task can read."""
    slices = blocks(docs, a, b, doc_id, text)
    return aligned(slices, pair_counts(slices), doc_id)
