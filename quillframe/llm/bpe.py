"""Byte-level BPE: batched numpy merge rounds for encoding, a table of bytes for decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillframe.llm.common import map_batches, pieces

#: Bytes of pieces that a worker remembers, about; past that it starts afresh.
CACHE_BYTES = 160 << 20
#: Of one remembered piece besides its characters and ids: its string, its entry, its place.
_PIECE_BYTES = 180


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Where byte-level pre-tokenizers cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r" (?:\s|$)")
#: A line feed between visible characters is a word of its own.
_LINE = re.compile(r"(?<!\s)\n(?!\s)")
_MARKS = ".,;:!?"


def byte_alphabet() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pieces:
    """Encodes whole texts by pieces that it remembers, whatever encodes a piece.

    A text is cut at each space that a visible character follows; there the
    pre-tokenizer always begins a new word, so what lies between can be
    encoded alone. Texts with other runs of spaces go through the
    pre-tokenizer's own pattern as a whole.
    """

    added: dict[str, int]
    cut: regex.Pattern | None

    def __init__(self, added: dict[str, int]):
        self.added = added
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.clear()

    def encode_pieces(self, new: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of prefix + piece for all pieces in one flat array, and where each piece begins and the last ends."""
        raise NotImplementedError

    def clear(self) -> None:
        """Forget all pieces."""
        #: place of a key among the remembered pieces. A piece after a space is its own key, as it
        #: never begins with white space; other pieces have a space before, added tokens a tab.
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.size, self.n = np.zeros(1 << 15, dtype=np.int64), np.zeros(1 << 15, dtype=np.int32), 0

    def _parts(self, key: str) -> list[str] | None:
        """The keys of what a piece surely falls into: lines, and the marks behind a line's last letter; None if it stays whole."""
        if key[:1] in (" ", "\t"):
            return None
        found: list[str] = []
        for n, line in enumerate(_LINE.split(key) if "\n" in key else [key]):
            if n:
                found.append(" \n")
            word = line.rstrip(_MARKS)
            if word and word != line and word[-1].isalpha() and word[-1] < "\u0530":
                found += [" " + word if n else word, " " + line[len(word) :]]
            elif line:
                found.append(" " + line if n else line)
        return found if len(found) > 1 else None

    def _learn(self, new: list[str]) -> None:
        """Encode the pieces of keys not seen before, and remember them."""
        whole = {k: parts for k in new if (k[-1:] in _MARKS or "\n" in k) and (parts := self._parts(k))}
        simple = [k for k in new if k not in whole]
        if whole:
            known = self.known
            inside = dict.fromkeys(x for parts in whole.values() for x in parts)
            simple += [x for x in inside.keys() - dict.fromkeys(simple).keys() if x not in known]
        groups = ([k for k in simple if k[:1] not in (" ", "\t")], [k for k in simple if k[:1] == " "], [k for k in simple if k[:1] == "\t"])
        for keys, prefix in zip(groups, (" ", "", None), strict=True):
            for k in range(0, len(keys), 50_000):
                some = keys[k : k + 50_000]
                if prefix is None:
                    ids, ends = np.array([self.added[x[1:]] for x in some], dtype=np.uint32), np.arange(len(some) + 1)
                else:
                    ids, ends = self.encode_pieces([x[1:] for x in some] if prefix == "" else some, prefix)
                self._remember(some, ids, ends)
        if whole:
            at = np.fromiter((self.known[x] for parts in whole.values() for x in parts), dtype=np.int64)
            count = np.concatenate(([0], np.cumsum(np.fromiter(map(len, whole.values()), dtype=np.int64, count=len(whole)))))
            ids, ends = self._ids(at)
            self._remember(list(whole), ids, ends[count])

    def _remember(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(keys)] = self.used + ends[:-1]
        self.size[self.n : self.n + len(keys)] = np.diff(ends)
        self.known.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self.used, self.n = self.used + len(ids), self.n + len(keys)
        self.held += sum(map(len, keys)) + _PIECE_BYTES * len(keys) + 4 * len(ids)

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered pieces one after the other, and where each begins and the last ends."""
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        return self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(int(ends[-1]))], ends

    def _keys(self, text: str, keys: list[str]) -> None:
        """Append the keys of a text's pieces."""
        for added, part in self._split(text):
            if added:
                keys.append("\t" + part)
            elif _ODD_SPACE.search(part):
                keys += [" " + w for w in self.pattern.findall(part)]
            else:
                cut = part.split(" ")
                cut[0] = " " + cut[0]
                keys += cut

    def _places(self, keys: list[str]) -> np.ndarray:
        """Places of keys among the remembered pieces, which new ones join."""
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            wanted = [keys[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(wanted)))
            at[missing] = np.fromiter(map(self.known.__getitem__, wanted), dtype=np.int64, count=len(wanted))
        return at

    def _plain(self, text: str) -> bool:
        """Whether a text is cut at each of its spaces."""
        return not _ODD_SPACE.search(text) and not any(t in text for t in self.added)

    def _flat(self, at: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts out of their pieces' places; ends: the pieces before each text, and all."""
        flat, sums = self._ids(at)
        cut = sums[ends].tolist()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, null as empty; what tokenizers gives without special tokens around a text."""
        if self.held > CACHE_BYTES:
            self.clear()
        plain = [k for k, t in enumerate(texts) if t and self._plain(t)]
        other = sorted({*range(len(texts))} - {*plain})
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        if plain:
            # Arrow finds the distinct pieces, so that only those are looked up
            lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
            ends = lists.offsets.to_numpy()
            words = lists.flatten()
            inside = np.ones(len(words), dtype=bool)
            inside[ends[:-1]] = False
            coded = words.filter(pa.array(inside)).dictionary_encode()
            at = np.empty(len(words), dtype=np.int64)
            at[ends[:-1]] = self._places([" " + w for w in words.take(pa.array(ends[:-1])).to_pylist()])
            at[inside] = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            for k, ids in zip(plain, self._flat(at, ends), strict=True):
                out[k] = ids
        if other:
            keys: list[str] = []
            ends = np.zeros(len(other) + 1, dtype=np.int64)
            for n, k in enumerate(other, 1):
                if texts[k]:
                    self._keys(texts[k], keys)
                ends[n] = len(keys)
            for k, ids in zip(other, self._flat(self._places(keys), ends), strict=True):
                out[k] = ids
        return out

    def _split(self, text: str) -> Iterator[tuple[bool, str]]:
        """A text cut at added tokens: (True, token) or (False, text between)."""
        if self.cut is None or not any(t in text for t in self.added):
            if text:
                yield False, text
            return
        at = 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]


class Bpe(Pieces):
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre, dec = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        plain = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges")
            and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and dec.get("type") == "ByteLevel"
        )
        if not plain:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocab, letter = dict(model["vocab"]), byte_alphabet()
        back = {c: b for b, c in letter.items()}
        self.first = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        none = len(merges)
        self.rank_or_none = np.append(self.rank, none)
        pairs = (self.first[:, None] << 32 | self.first[None, :]).ravel()
        found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        self.byte_pairs = np.where(self.keys[found] == pairs, found, none)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with context aren't supported")
        super().__init__(added)
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in vocab.items():
            if t not in added:
                self.bytes[i] = bytes(back[c] for c in t)
        for t, i in added.items():
            self.bytes[i] = t.encode()

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has.

        All symbols lie in one array. A round finds the rank of every
        neighbouring pair by binary search, takes each word's lowest rank and
        merges that pair wherever the word has it, left to right.
        """
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sizes = np.zeros(len(words), dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym, word = self.first[raw], np.repeat(np.arange(len(words)), n)
        none = np.int64(len(self.rank))
        at = np.zeros(len(sym), dtype=np.int64)  # of each symbol and its right neighbour: place among the merges
        if len(sym) > 1:
            at[:-1] = self.byte_pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]
            at[:-1][word[:-1] != word[1:]] = none
        at[-1:] = none
        done_sym, done_word = [], []
        while len(sym):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(head, len(sym)))
            rank = self.rank_or_none[at]
            low = np.minimum.reduceat(rank, head)
            busy = low < none
            if not busy.all():
                over = np.repeat(~busy, length)
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, at, rank, low, length = sym[keep], word[keep], at[keep], rank[keep], low[busy], length[busy]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            # of hits that overlap (a run of one pair, like "aaa"), every other one counts, from the left
            if len(hit) > 1:
                close = np.concatenate(([False], np.diff(hit) == 1))
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(close, 0, np.arange(len(hit))))
                hit = hit[run % 2 == 0]
            sym[hit] = self.merged[at[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, at, hit = sym[stay], word[stay], at[stay], moved[hit]
            # only the pairs on both sides of a merged symbol are new
            near = np.zeros(len(sym) + 1, dtype=bool)
            near[hit] = near[hit - 1] = True  # the one before the first is the last, which has no pair
            left = np.flatnonzero(near[: len(sym) - 1])
            at[-1] = none
            pair = sym[left] << 32 | sym[left + 1]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            at[left] = np.where((self.keys[found] == pair) & (word[left] == word[left + 1]), found, none)
        out, owner = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (done_sym, done_word))
        order = np.argsort(owner, kind="stable")
        sizes += np.bincount(owner, minlength=len(words))
        return out[order].astype(np.uint32), sizes

    def encode_pieces(self, new: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of prefix + piece for all pieces in one flat array, and where each piece begins and the last ends."""
        if prefix:
            # no such piece holds a space, so the words that begin with one begin the pieces
            words = self.pattern.findall(prefix + prefix.join(new))
            begin = np.flatnonzero(np.fromiter(map(str.startswith, words, repeat(prefix)), dtype=bool, count=len(words)))
            begin = np.append(begin, len(words))
        else:
            cut = [self.pattern.findall(p) for p in new]
            words = [w for x in cut for w in x]
            begin = np.concatenate(([0], np.cumsum([len(x) for x in cut], dtype=np.int64)))
        place: dict[str, int] = {}
        which = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words))
        ids, sizes = self.merge_words([w.encode() for w in place])
        at = np.cumsum(sizes) - sizes
        size = sizes[which]
        ids = ids[np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ends = np.concatenate(([0], np.cumsum(size)))[begin]
        return ids, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_loaded: dict[str, Bpe] = {}


def load(path: str | None = None) -> Bpe:
    """The tokenizer of a file, once for each worker."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of docs; null texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in pieces(batches, "text"):
            found = bpe.encode_batch(part.column("text").to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.record_batch([part.column("doc_id"), ids], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of encoded (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs: encoded, then decoded from those ids.

    Null and empty texts have no tokens. Repeated rows and null doc_ids are
    kept; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in pieces(batches, "text"):
            n, ids, back = [], [], []
            for x in bpe.encode_batch(part.column("text").to_pylist()):
                n.append(len(x))
                ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(x).encode()).hexdigest())
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), run, schema)
