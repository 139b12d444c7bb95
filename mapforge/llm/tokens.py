"""Encoding and decoding with byte-pair vocabularies, exactly as the tokenizers library does, by tree concatenation.

A text of more than LONG characters is halved, wherever that falls, down to leaves. The leaves of many texts are
encoded at once; then neighbours are joined, pair by pair up the tree, by encoding a growing window of text around
the join until what the window gives agrees with both sides, in ids and in place. So an id near a cut, be it in the
middle of a word or of a special token, comes from a window that holds the cut, and all others from a leaf.

What two encodings can agree on are cuts: a run of ASCII white space and the word after it. No pre-token of the two
kinds of vocabulary reaches across their rims, so the ids of a text are those of its cuts, one after the other, and a
window agrees with a side when its outermost cut is the side's. A worker encodes each cut once and then looks it up.
(A text in which other white space occurs is encoded as a whole, since a run of mixed white space may be split
differently.)

A long cut without white space has nothing to agree on but its tokens: its pre-tokens are halved, and joined by windows
of tokens until the window's ids agree with those on both sides, in id and in place. Byte-pair encoding is determined by
neighbouring tokens alone: a sequence in which every neighbouring pair is what their joint text encodes to is the
encoding of the whole, so the result is exact, not approximate. A pre-token is never guessed: the library's own
pre-tokenizer cuts the text, and only single long pre-tokens are halved.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import SPACE, column_names, in_batches, pieces, ragged

#: Characters of a text or a pre-token that is one leaf by itself, and of the leaves that a longer one is cut into.
LONG, LEAF = 2048, 2048
#: Tokens, and cuts, on each side of a join that the first window holds.
WINDOW, WINDOW_CUTS = 8, 1
#: Cuts after which a worker's memory of them starts afresh, and characters that it encodes at a time.
CACHE_CUTS = 300_000
CHUNK = 2_000_000

_CUTS = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: White space beyond [\x20\x09-\x0D], in UTF-8.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: Texts of ASCII and the Latin-1 letters are cut into pre-tokens here, by the same patterns as the library's; their
#: letters are composed already and lower-case one by one. All others go through the library's own steps.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = r" \t\n\x0b\x0c\r"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERNS = {
    "bytes": "{0}| ?[{1}]+| ?[0-9]+| ?[^{2}{1}0-9]+|[{2}]+(?![^{2}])|[{2}]+",
    "words": "{0}|[{1}]+|[0-9]|[^{2}{1}0-9]+",
}
_PRETOKENS = {k: re.compile(v.format(_CONTRACTIONS, _LETTERS, _BLANK)) for k, v in _PATTERNS.items()}
#: The same for many texts at once, which NUL parts: nothing reaches across it, and it is white space to what comes before.
_PARTED = {
    "bytes": re.compile("\x00|" + _PATTERNS["bytes"].replace("(?![^{2}])", "(?![^{2}\x00])").replace("?[^{2}{1}", "?[^{2}\x00{1}").format(_CONTRACTIONS, _LETTERS, _BLANK)),
    "words": re.compile("\x00|" + _PATTERNS["words"].replace("[^{2}{1}", "[^{2}\x00{1}").format(_CONTRACTIONS, _LETTERS, _BLANK)),
}


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else the next one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


_BYTES = _byte_alphabet()


def load(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def join_encoded(text: str, cut: int, left: list[tuple[int, int]], right: list[tuple[int, int]], encode: Callable[[str], list[tuple[int, int]]], window: int = WINDOW) -> list[tuple[int, int]]:
    """The (id, start) of text from those of text[:cut] and text[cut:], all starts counted in text.

    encode gives the (id, start) of a string by itself. A window of tokens around the cut is encoded until it has a
    token in common with the left side and one with the right side; it grows to the whole text at most.
    """
    if not left or not right:
        return left or right
    while True:
        i, j = max(0, len(left) - window), min(len(right), window)
        begin = left[i][1]
        end = right[j][1] if j < len(right) else len(text)
        mid = [(t, s + begin) for t, s in encode(text[begin:end])]
        if i == 0 and j == len(right):
            return mid
        # The window's last token ends where its text does, which is no real end unless it is the text's own.
        inner = mid if j == len(right) else mid[:-1]
        mine, others = {x: n for n, x in enumerate(left[i:])}, {x: n for n, x in enumerate(right[: j if j < len(right) else None])}
        first = 0 if i == 0 else next((n for n, x in enumerate(inner) if x in mine and mine[x] + i < len(left) - 1), None)
        last = len(mid) if j == len(right) else next((n for n in range(len(inner) - 1, -1, -1) if inner[n] in others), None)
        if first is not None and last is not None and first <= last:
            head = left[: i + mine[inner[first]]] if i else []
            tail = right[others[inner[last]] :] if j < len(right) else []
            return head + mid[first:last] + tail
        window *= 2


def _kind(said: dict) -> str | None:
    """Which of the two known ways of cutting into pre-tokens a vocabulary has."""
    pre, norm = said.get("pre_tokenizer") or {}, said.get("normalizer")
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in said["added_tokens"]):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
        return "bytes"
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
    if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and pre["pretokenizers"][0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        return "words"
    return None


def _kernel(said: dict):
    """A faster encoder of single pre-tokens as bytes with the same merges, or None if ids don't follow the merges' order.

    A vocabulary with an end-of-word suffix gets the byte 0xFF in its place, which no UTF-8 text holds: pairs of a byte
    and that mark come before all merges, just as the suffixed characters are there before any merge.
    """
    model, special = said["model"], {t["content"] for t in said["added_tokens"]}
    suffix, byte = model.get("end_of_word_suffix") or "", {c: b for b, c in _BYTES.items()}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            end = suffix and token.endswith(suffix)
            ranks[bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + (b"\xff" if end else b"")] = i
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])) or made and made[0] != len(ranks) - len(made) or len(set(ranks.values())) != len(ranks):
        return None
    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Cuts(dict):
    """Numbers cuts in the order of their first lookup and notes the new ones."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []
        self.seen = 0  # cuts that take_new() has returned

    def __missing__(self, cut: bytes) -> int:
        n = self[cut] = len(self)
        self.names.append(cut)
        return n

    def take_new(self) -> list[bytes]:
        new, self.seen = self.names[self.seen :], len(self.names)
        return new


class Codec:
    """Encodes texts with one vocabulary, remembering cuts."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, cache: int = CACHE_CUTS):
        self.tok, self.long, self.leaf, self.cache = load(path), long, leaf, cache
        self.bare = Tokenizer(self.tok.model)
        said = json.loads(self.tok.to_str())
        self.kind = _kind(said)
        self.kernel = _kernel(said) if self.kind else None
        self.end = b"\xff" if said["model"].get("end_of_word_suffix") else b""
        self.specials = [t["content"] for t in said["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.joins = self.grown = 0  # joins of halves of texts, and those whose window had to grow
        self.forget()

    def forget(self) -> None:
        self.known = _Cuts()
        self.foreign: set[int] = set()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bounds = np.zeros(1 << 16, np.int64)  # where the ids of each known cut begin, and one place more
        self.tokens: dict[str, list[int]] = {}  # ids of pre-tokens of up to three characters

    # Single strings

    def _models(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """(id, start) of strings by the bare model, encoded in parallel."""
        return [[(t, o[0]) for t, o in zip(e.ids, e.offsets)] for e in self.bare.encode_batch(words, add_special_tokens=False)]

    def _model(self, word: str) -> list[tuple[int, int]]:
        return self._models([word])[0]

    def pretoken(self, word: str) -> list[int]:
        """Ids of one pre-token, in the alphabet that the model works on; long ones by tree concatenation."""
        if len(word) <= self.long:
            return [t.id for t in self.tok.model.tokenize(word)]
        bounds = [*range(0, len(word), self.leaf), len(word)]
        parts = [[(t, s + a) for t, s in got] for a, got in zip(bounds, self._models([word[a:b] for a, b in zip(bounds, bounds[1:])]))]
        while len(parts) > 1:
            after, kept = [], [0]
            for n in range(0, len(parts) - 1, 2):
                begin, cut, end = bounds[n], bounds[n + 1], bounds[n + 2]
                back = lambda x, d=begin: [(t, s - d) for t, s in x]
                joined = join_encoded(word[begin:end], cut - begin, back(parts[n]), back(parts[n + 1]), self._model)
                after.append([(t, s + begin) for t, s in joined])
                kept.append(end)
            if len(parts) % 2:
                after.append(parts[-1])
                kept.append(bounds[-1])
            parts, bounds = after, kept
        return [t for t, _ in parts[0]]

    def _unsplit(self, text: str) -> list[int]:
        """Ids of any text. Special tokens' strings stand for these tokens, as in the library."""
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += [*self._ordinary(text[at : m.start()]), self.tok.token_to_id(m[0])]
            at = m.end()
        return out + self._ordinary(text[at:])

    def _ordinary(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        if self.kernel and _PLAIN.fullmatch(text):
            for w in _PRETOKENS[self.kind].findall(text.lower() if self.kind == "words" else text):
                if len(w) <= 3 and w in self.tokens:
                    out += self.tokens[w]
                elif len(w) > self.long:
                    out += self.pretoken(w.encode().decode("latin-1").translate(_BYTES))
                else:
                    got = self.kernel(w.encode() + self.end)
                    if len(w) <= 3:
                        self.tokens[w] = got
                    out += got
            return out
        plain = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(plain):
            out += self.pretoken(w)
        return out

    # Many texts

    def _learn(self) -> None:
        new = self.known.take_new()
        n = len(self.known) - len(new)
        if len(self.known) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(max(len(self.bounds), len(new)), np.int64)])
        if not new:
            return
        all_ids: list[int] = []
        joined = b"\x00".join(new).decode("utf-8", "surrogatepass")
        simple = self.kernel and len(max(new, key=len)) <= self.long and joined.count("\x00") == len(new) - 1 and _PLAIN.fullmatch(joined) and not (self.special and self.special.search(joined))
        if simple:
            at, kernel, end, short = n + 1, self.kernel, self.end, self.tokens
            for w in _PARTED[self.kind].findall(joined.lower() if self.kind == "words" else joined):
                if w == "\x00":
                    self.bounds[at] = self.used + len(all_ids)
                    at += 1
                elif w in short:
                    all_ids += short[w]
                else:
                    got = kernel(w.encode() + end)
                    all_ids += got
                    if len(w) <= 3:
                        short[w] = got
            self.bounds[at] = self.used + len(all_ids)
        else:
            for i, cut in enumerate(new, n):
                all_ids += self._unsplit(cut.decode("utf-8", "surrogatepass"))
                self.bounds[i + 1] = self.used + len(all_ids)
        if _OTHER_SPACE.search(b"\x00".join(new)):
            self.foreign.update(i for i, cut in enumerate(new, n) if _OTHER_SPACE.search(cut))
        if self.used + len(all_ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * (self.used + len(all_ids)), np.uint32)])
        self.flat[self.used : self.used + len(all_ids)] = all_ids
        self.used += len(all_ids)

    def _leaves(self, text: str) -> list[str]:
        """The text halved until no part is longer than a leaf."""
        if len(text) <= self.long:
            return [text]
        n = 1 << (-(-len(text) // self.leaf) - 1).bit_length()
        ends = [len(text) * i // n for i in range(n + 1)]
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def _split(self, raw: list[bytes]) -> list[list[bytes]]:
        # Vocabularies of words drop white space, so that their cuts need none.
        return [t.split() for t in raw] if self.kind == "words" else list(map(_CUTS.findall, raw))

    def _join(self, left: list[np.ndarray], right: list[np.ndarray], apart: bool) -> list[np.ndarray]:
        """The cuts of a text, in pieces, from those of its two halves; apart says that white space is at the join."""
        left, right = [p for p in left if len(p)], [p for p in right if len(p)]
        if not left or not right:
            return left or right
        self.joins += 1
        window, names = WINDOW_CUTS, self.known.names
        while True:
            while len(left[-1]) <= window and len(left) > 1:
                left = [*left[:-2], np.concatenate(left[-2:])]
            while len(right[0]) <= window and len(right) > 1:
                right = [np.concatenate(right[:2]), *right[2:]]
            a, b = left[-1], right[0]
            i, j = max(0, len(a) - window), min(len(b), window)
            one, two = [names[n] for n in a[i:].tolist()], [names[n] for n in b[:j].tolist()]
            text = b" ".join(one) + (b" " if apart else b"") + b" ".join(two) if self.kind == "words" else b"".join(one + two)
            mid = [self.known[c] for c in self._split([text])[0]]
            if (i == 0 or mid[0] == a[i]) and (j == len(b) or mid[-1] == b[j - 1]):
                return [*left[:-1], a[:i], np.array(mid, np.int64), b[j:], *right[1:]]
            self.grown += window == WINDOW_CUTS
            window *= 2

    def _joined_up(self, leaves: list[list[str]], per_text: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cuts, number of cuts of each text) from those of all leaves, level by level up each text's tree."""
        ends = np.cumsum(counts)
        last = np.cumsum(per_text)
        parts, sizes, done = [], np.empty(len(leaves), np.int64), 0
        for n, own in enumerate(leaves):
            first = last[n] - len(own)
            if len(own) == 1:
                sizes[n] = counts[first]
                continue
            begin = int(ends[first] - counts[first])
            parts.append(at[done:begin])
            done = int(ends[last[n] - 1])
            level = [[at[e - c : e]] for e, c in zip(ends[first : last[n]].tolist(), counts[first : last[n]].tolist())]
            apart = [a[-1:] in SPACE or b[:1] in SPACE for a, b in zip(own, own[1:])]  # at each join
            step = 1
            while len(level) > 1:
                level = [self._join(level[k], level[k + 1], apart[(k + 1) * step - 1]) for k in range(0, len(level), 2)]
                step *= 2
            parts += level[0]
            sizes[n] = sum(map(len, level[0]))
        return np.concatenate([*parts, at[done:]]), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as uint32, one text after the other, and each text's number of ids."""
        if len(self.known) > self.cache:
            self.forget()
        leaves = [self._leaves(t) for t in texts]
        split = self._split([t.encode("utf-8", "surrogatepass") for own in leaves for t in own])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        cuts = [c for s in split for c in s]
        at = np.fromiter(map(self.known.__getitem__, cuts), np.int64, len(cuts))
        self._learn()
        per_text = np.fromiter(map(len, leaves), np.int64, len(leaves))
        if len(split) > len(texts):
            at, counts = self._joined_up(leaves, per_text, at, counts)
            self._learn()
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        sizes = sums[ends] - sums[ends - counts]
        if self.foreign:
            odd = np.isin(at, np.fromiter(self.foreign, np.int64))
            marks = np.concatenate([[0], np.cumsum(odd)])
            whole = np.flatnonzero(marks[ends] > marks[ends - counts])
            if len(whole):
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                for i in whole.tolist():
                    parts[i] = np.array(self._unsplit(texts[i]), np.uint32)
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, sizes


#: One codec for each vocabulary in each Python worker, since workers are used again by later tasks.
_CODECS: dict[tuple, Codec] = {}


def codec(path: str, long: int = LONG, leaf: int = LEAF) -> Codec:
    key = (path, long, leaf)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, long, leaf)
    return _CODECS[key]


@contextmanager
def borrowed(path: str, long: int = LONG, leaf: int = LEAF) -> Iterator[Codec]:
    """A task's use of the worker's codec, which forgets its cuts after it."""
    own = codec(path, long, leaf)
    try:
        yield own
    finally:
        own.forget()


def encode_column(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: str = "ids", long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """(key, ids array<int>): the token ids of each row's whole text; null counts as empty and gives no ids.

    One row for each row of docs: null or repeated keys are carried along. Other columns are ignored; no rows give none.
    """

    def run(batches):
        with borrowed(path, long, leaf) as own:
            for part, texts in pieces(batches, text, CHUNK):
                flat, sizes = own.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(key), ragged(flat.astype(np.int32), sizes, pa.int32())], [key, ids])

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(column_names(docs, key, text), run, f"`{key}` {kind}, `{ids}` array<int>")


def decode(tok: Tokenizer, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The texts of consecutive runs of ids, special tokens' strings included."""
    ends = np.cumsum(sizes).tolist()
    return tok.decode_batch([flat[e - n : e].tolist() for e, n in zip(ends, sizes.tolist())], skip_special_tokens=False)


def decode_column(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """(key, text): the text of each row's ids. Null ids count as none.

    One row for each row of encoded: null or repeated keys are carried along. Other columns are ignored; no rows give none.
    """

    def run(batches):
        tok = codec(path).tok
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [x or [] for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(tok.decode_batch(lists, skip_special_tokens=False), pa.string())], [key, text])

    return in_batches(encoded.select(key, ids), run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, `{text}` string")


def round_trip(docs: DataFrame, path: str, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids array<int>, decoded): each whole text's ids, and the text that these decode to.

    One row for each row of docs; a null or empty text has no ids and decodes to the empty text. Null or repeated
    doc_ids are carried along; other columns are ignored. Both steps are in one pass: a second one would need a
    second Python worker, with a vocabulary and a memory of cuts of its own, beside each task.
    """

    def run(batches):
        with borrowed(path, long, leaf) as own:
            for part, texts in pieces(batches, limit=CHUNK):
                flat, sizes = own.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ragged(flat.astype(np.int32), sizes, pa.int32()), pa.array(decode(own.tok, flat, sizes), pa.string())], ["doc_id", "ids", "decoded"])

    return in_batches(column_names(docs, "doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")
