"""Exact tokenizer output at the price of a dictionary lookup per word.

Where a tokenizer drops white space before its merges, no token spans two words,
so a text's ids are those of its words one after the other.  Words are split, made distinct and looked up by
Arrow, ``GROUP_BYTES`` of text at a time: the more text, the fewer of its words are distinct.  A plain word -- Latin letters and a run of marks after them -- is two
pre-tokens, and where the tokenizer lower-cases, the letters' case does not matter: such words are kept
by their lower-cased letters, and the marks by themselves.  The library is asked once in a process for
each of these; other words of printable ASCII and these letters are cut by the file's own pattern first, and the library merges
the parts.  Answers are kept in two generations: when the younger one holds ``MEMO_WORDS`` words it becomes the
older one, and words that are met again move over, so frequent words are never asked for again.  Long texts are
taken in pieces cut at white space, so neither the words in hand nor the library's answers grow with a
text.  For any other tokenizer whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MEMO_WORDS = 300_000  # of each generation
CALL_WORDS = 8192
PIECE_BYTES = 1 << 20
GROUP_BYTES = 4 << 20  # of text whose distinct words are looked up together
SPACES = "\t\n\x0b\x0c\r "
MARKS = ".,;:!?"
#: Letters that no normaliser here splits or composes, and whose lower case is one of them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
COMMON = re.compile(f"[!-~{LETTERS}]+")  # neither white space nor anything that a normaliser here changes but by lower-casing
EACH_LETTER = "".join(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c))
JOINED = 256
SPACE = re.compile(b"[\t\n\x0b\x0c\r ]")


class _Answers:
    """Numbered words, and the ids of word ``n`` in ``ids[first[n]:first[n + 1]]``."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.first, self.lengths, self.ids = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)), strict=True))
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def find(self, words: list[str]) -> np.ndarray:
        """Number of each word, or -1."""
        return np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them in order."""
        lengths = self.lengths[codes]
        return lengths, self.ids[_places(self.first[codes], lengths)]


def _places(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of every i, one after the other."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _flat(answers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each answer has, and all of them."""
    sizes = np.fromiter(map(len, answers), np.int64, len(answers))
    return sizes, np.fromiter(chain.from_iterable(answers), np.uint32, int(sizes.sum()))


class JsonEncoder:
    """A file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = drops_white_space(config)
        suffix = (config.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.array([bool(suffix) and t.endswith(suffix) for t in self._tokens()])
        self.cut = self.added = None
        self.letters = self._for_letters(path, config) if self.by_word and suffix else None
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.young, self.old = _Answers(), _Answers()

    def _for_letters(self, path: str, config: dict):
        """The same tokenizer without the steps that change nothing for lower-case letters: its pattern, and its normaliser
        (whose lower-casing is made before); None unless it lower-cases, and takes letters and marks as two pre-tokens each."""
        from tokenizers import Tokenizer, pre_tokenizers

        kinds = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [config.get("normalizer") or {}])]
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if "Lowercase" not in kinds or [s.get("type") for s in steps] != ["Split", "ByteLevel"]:
            return None
        pattern = steps[0]["pattern"]["Regex"]
        probes = ["abzéÿ" + m for m in ("", *MARKS, MARKS, "..")]
        if any(regex.findall(pattern, p) != [x for x in ("abzéÿ", p[5:]) if x] for p in probes):
            return None
        plain = Tokenizer.from_file(path)
        plain.no_truncation()
        plain.no_padding()
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        cut = regex.compile(pattern)
        self.added = [t["content"].lower() for t in config.get("added_tokens", [])]
        # does the pattern cut as the library does, and take all of a word?
        seen = [chr(c) for c in range(0x21, 0x7F)] + list("éÉß")
        probes = [p for c in seen for p in (c, c + c, f"a{c}b", f"A{c}", f"1{c}2", f"'{c}", f"{c}'s", f"'{c}e", f".{c}é")]
        if self._library(probes) == self._library([" ".join(cut.findall(p.lower())) for p in probes], plain):
            self.cut = cut
        return plain

    def _library(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _tokens(self) -> list[str]:
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def _parts(self, word: str) -> list[str]:
        """The pre-tokens of a word of common characters; none if they are not known without the library."""
        if self.cut is None or not COMMON.fullmatch(word):
            return []
        word = word.lower()
        return [] if any(t in word for t in self.added) else self.cut.findall(word)

    def _asked(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them.  Lower-case letters and the parts of common words go to the library with spaces
        between them, which is cheaper; the tokens that end a part tell them apart.  A run with another number of such ends is asked word by word."""
        some = np.flatnonzero(plain).tolist()
        spaced, parts, rest = [words[i] for i in some], [1] * len(some), []
        for i in np.flatnonzero(~plain).tolist():
            cut = self._parts(words[i])
            if cut:
                some.append(i)
                spaced.append(" ".join(cut))
                parts.append(len(cut))
            else:
                rest.append(i)
        some, parts, begins = np.array(some, np.int64), np.array(parts, np.int64), np.arange(0, len(some), JOINED)
        sizes, ids = _flat(self._library([" ".join(spaced[at: at + JOINED]) for at in begins.tolist()], self.letters)) if len(some) else (parts, np.empty(0, np.uint32))
        is_end, stops = self.ends[ids], np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(is_end)])
        good = (total[stops] - total[stops - sizes] == (np.add.reduceat(parts, begins) if len(some) else parts)) & (sizes > 0)
        good[good] &= is_end[stops[good] - 1]
        if not good.all():
            kept = np.repeat(good, JOINED)[: len(some)]
            rest += some[~kept].tolist()
            some, parts, ids = some[kept], parts[kept], ids[np.repeat(good, sizes)]
        lengths = np.zeros(len(words), np.int64)
        lengths[some] = np.diff((np.flatnonzero(self.ends[ids]) + 1)[np.cumsum(parts) - 1], prepend=0)
        lengths[rest], others = _flat(self._library([words[i] for i in rest]))
        order = np.concatenate([some, np.array(rest, np.int64)])
        out = np.empty(int(lengths.sum()), np.uint32)
        out[_places((np.cumsum(lengths) - lengths)[order], lengths[order])] = np.concatenate([ids, others])
        return lengths, out

    def _learned(self, words: list[str], plain: np.ndarray) -> np.ndarray:
        """Numbers of distinct words in the younger generation; new ones come from the older one or from the library, which gets
        ``CALL_WORDS`` at a time, as its answers take some kilobytes each."""
        codes = self.young.find(words)
        new = np.flatnonzero(codes < 0)
        if not len(new):
            return codes
        names = [words[i] for i in new.tolist()]
        known = self.old.find(names)
        moved = np.flatnonzero(known >= 0)
        codes[new[moved]] = len(self.young.codes) + np.arange(len(moved))
        self.young.add([names[i] for i in moved.tolist()], *self.old.of(known[moved]))
        asked = np.flatnonzero(known < 0)
        codes[new[asked]] = len(self.young.codes) + np.arange(len(asked))
        group, kinds = [names[i] for i in asked.tolist()], plain[new[asked]]
        got = [self._asked(group[at: at + CALL_WORDS], kinds[at: at + CALL_WORDS]) for at in range(0, len(group), CALL_WORDS)]
        if got:
            lengths, ids = zip(*got, strict=True)
            self.young.add(group, np.concatenate(lengths), np.concatenate(ids))
        return codes

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each distinct word, where its ids begin, all their ids)."""
        if self.letters is None:
            codes = self._learned(_names(words), np.zeros(len(words), bool))
            lengths, ids = self.young.of(codes)
            return lengths, np.cumsum(lengths) - lengths, ids
        stems = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(stems, f"^[{LETTERS}]+$")
        keys = pc.if_else(plain, pc.utf8_lower(stems), words).dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        # letters, or a whole word that is not plain; a key is of one kind only
        kinds = np.zeros(len(keys.dictionary), bool)
        kinds[keys.indices.to_numpy()] = plain
        own = self._learned(_names(keys.dictionary), kinds)[keys.indices.to_numpy()]
        own_lengths, own_ids = self.young.of(own)
        # the marks after plain words: runs of a few characters, few of them distinct
        marked = np.flatnonzero(plain & pc.not_equal(stems, words).to_numpy(zero_copy_only=False))
        marks = pc.utf8_ltrim(words.take(pa.array(marked)), EACH_LETTER).dictionary_encode()
        tails, names = _Answers(), _names(marks.dictionary)
        tails.add(names, *_flat(self._library(names)))
        tail_lengths, tail_ids = tails.of(marks.indices.to_numpy())
        lengths = own_lengths.copy()
        lengths[marked] += tail_lengths
        first = np.cumsum(lengths) - lengths
        ids = np.empty(int(lengths.sum()), np.uint32)
        ids[_places(first, own_lengths)] = own_ids
        ids[_places((first + own_lengths)[marked], tail_lengths)] = tail_ids
        return lengths, first, ids

    def _coded(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text of each piece, words of each piece, distinct number of every word, and what ``_distinct`` tells) by groups of pieces."""
        for group in _groups(texts):
            if len(self.young.codes) > MEMO_WORDS:
                self.young, self.old = _Answers(), self.young
            pieces = _strings([piece for _, piece in group])
            split = pc.ascii_split_whitespace(pieces)
            words, piece = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
            full = pc.not_equal(pc.binary_length(words), 0)
            words, piece = words.filter(full).dictionary_encode(), piece[full.to_numpy(zero_copy_only=False)]
            rows = np.array([row for row, _ in group])
            yield rows, np.bincount(piece, minlength=len(group)), words.indices.to_numpy(), *self._distinct(words.dictionary)

    def _sizes(self, rows: np.ndarray, words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> None:
        """Add the ids of each piece to its text's."""
        total = np.concatenate([[0], np.cumsum(lengths)])
        np.add.at(sizes, rows, np.diff(total[np.concatenate([[0], np.cumsum(words)])]))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        if not self.by_word:
            return np.array([len(x) for x in self._library([t.decode("utf-8", "replace") for t in texts])], np.int64)
        sizes = np.zeros(len(texts), np.int64)
        for rows, words, distinct, lengths, _, _ in self._coded(texts):
            self._sizes(rows, words, lengths[distinct], sizes)
        return sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if not self.by_word:
            sizes, ids = _flat(self._library([t.decode("utf-8", "replace") for t in texts]))
            return ids, sizes
        sizes, out = np.zeros(len(texts), np.int64), []
        for rows, words, distinct, lengths, first, ids in self._coded(texts):
            lengths = lengths[distinct]
            self._sizes(rows, words, lengths, sizes)
            out.append(ids[_places(first[distinct], lengths)])
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), sizes


def _names(words: pa.Array) -> list[str]:
    """Arrow strings as Python's, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _strings(pieces: list[bytes]) -> pa.Array:
    """Texts as Arrow strings; bytes that are no UTF-8 become U+FFFD."""
    try:
        return pa.array(pieces, pa.large_binary()).cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([p.decode("utf-8", "replace") for p in pieces], pa.large_string())


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into runs of about ``PIECE_BYTES`` bytes (more only for a longer word)."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        space = SPACE.search(text, at + PIECE_BYTES)
        to = space.start() if space else len(text)
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(text, piece) in runs of about ``GROUP_BYTES`` bytes."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for piece in _pieces(text):
            if group and size + len(piece) > GROUP_BYTES:
                yield group
                group, size = [], 0
            group.append((row, piece))
            size += len(piece)
    if group:
        yield group


def drops_white_space(config: dict) -> bool:
    """Whether the first step after normalisation keeps only matches of a pattern that no white space is part of."""
    step = config.get("pre_tokenizer") or {}
    step = (step.get("pretokenizers") or [{}])[0] if step.get("type") == "Sequence" else step
    if step.get("type") != "Split" or step.get("behavior") != "Removed" or not step.get("invert") or "Regex" not in step.get("pattern", {}):
        return False
    pattern = step["pattern"]["Regex"]
    probe = "".join(f"a{s}b1{s}2.{s}.'{s}s{s}{s}" for s in SPACES)
    known = (config.get("normalizer") or {}).get("normalizers", [config.get("normalizer") or {}])
    plain = all(n.get("type") in (None, "NFC", "Lowercase") or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " ") for n in known)
    added = all(not any(s in t["content"] for s in SPACES) and not t["single_word"] for t in config.get("added_tokens", []))
    return plain and added and not any(set(m) & set(SPACES) for m in regex.findall(pattern, probe))


@cache
def json_encoder(path: str) -> JsonEncoder:
    return JsonEncoder(path)
