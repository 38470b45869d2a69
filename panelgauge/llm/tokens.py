"""Token ids of a public word-level BPE vocabulary, with each distinct word encoded once per worker.

The vocabulary drops white space and never joins characters across a space or a
line feed, so the ids of a text are the ids of its space-separated parts, one
after the other. Trailing ASCII marks after a letter and ASCII capitals are
split off first, since the vocabulary's own rules separate the former and lower
the latter. Words of letters are handed to the library many at a time; the ids
that end a word (their token ends with the vocabulary's word-end suffix) cut its
answer. Known words stay in Arrow and numpy arrays, so no Python object is made
for a word. When an encoder opens, probes of all these rules are compared with
the library's ids of whole texts; a vocabulary that follows other rules is
encoded by whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORKER_CACHES

#: Distinct parts that a worker keeps; a full table is emptied (memory only, results don't change).
CACHE_PARTS = 1_000_000
#: Characters that form tokens of their own class after a letter, and never change or join it.
_MARKS = "!#$%&*+,-./:;=?@_~"
_TAIL = r"^.*?([!#$%&*+,\-./:;=?@_~]+)$"
_PROBES = ["Some Words, of THE text.", "It's a state-of-the-art... \n test_case\n\nx", "Été ÉTÉ straße, naïve; a1 1a 3.14", "a\tb  c!? (d) [e] \"f\" ~g~ #h @i", "日本 ไทย İI ΑΣ.", "IT'S we'LL. a'S!! ''s"]
_open: dict[str, "Encoder"] = {}
WORKER_CACHES.append(_open)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... (size[i] of them) for each i, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - size), size) + np.arange(total)


class Encoder:
    def __init__(self, path: str):
        self.most = CACHE_PARTS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix") or ""
        self.n_ids = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.n_ids, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.clear()
        self.by_words = True
        ids, ends = self.coded(pa.array(_PROBES, pa.large_string()))
        self.by_words = all(ids[a:b].tolist() == self.one(t) for t, a, b in zip(_PROBES, ends, ends[1:], strict=False))

    def clear(self) -> None:
        """Forget the known words: word i has the ids ids[first[i] : first[i] + size[i]]."""
        self.words = pa.array([""], pa.large_string())
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def one(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of letters only."""
        n = len(words)
        starts = [*range(0, n, 250), n]
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), pa.scalar(" ", pa.large_string())).to_pylist()
        ids, sizes = [], []
        for i, answer in enumerate(self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)):
            got = np.array(answer.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != starts[i + 1] - starts[i] or (len(cuts) and cuts[-1] != len(got)):
                each = [self.one(w) for w in words[starts[i] : starts[i + 1]].to_pylist()]
                got, sizes_here = np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)
            else:
                sizes_here = np.diff(np.r_[0, cuts])
            ids.append(got)
            sizes.append(sizes_here)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep the words; their numbers."""
        at = len(self.words)
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        self.ids = np.r_[self.ids, ids]
        self.words = pa.concat_arrays([self.words, words])
        return np.arange(at, len(self.words))

    def _place(self, words: pa.Array) -> np.ndarray:
        """The number of each word among the known ones, -1 for others."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def learn(self, missing: pa.Array) -> np.ndarray:
        """Keep distinct words that are not known yet, and their stems; the words' numbers."""
        out = np.zeros(len(missing), np.int64)
        stems = pc.utf8_rtrim(missing, characters=_MARKS)
        letters = pc.utf8_is_alpha(stems)
        odd = missing.filter(pc.invert(letters))
        rows = np.flatnonzero(letters.to_numpy(zero_copy_only=False))
        if len(odd):
            each = [self.one(w) for w in odd.to_pylist()]
            out[~letters.to_numpy(zero_copy_only=False)] = self._add(odd, np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64))
            missing, stems = missing.filter(letters), stems.filter(letters)
        if not len(missing):
            return out
        low = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        coded = low.dictionary_encode()
        place = self._place(coded.dictionary)
        fresh = np.flatnonzero(place < 0)
        words = coded.dictionary.take(pa.array(fresh))
        place[fresh] = self._add(words, *self._letters(words))
        at = place[coded.indices.to_numpy()]
        out[rows] = at
        rest = np.flatnonzero(pc.not_equal(missing, low).to_numpy(zero_copy_only=False))
        if not len(rest):
            return out
        pick = pa.array(rest)
        missing, stems, at = missing.take(pick), stems.take(pick), at[rest]
        marked = pc.less(pc.binary_length(stems), pc.binary_length(missing))
        tails = pc.if_else(marked, pc.replace_substring_regex(missing, _TAIL, r"\1"), pa.scalar("", pa.large_string())).dictionary_encode()
        each = [self.one(t) for t in tails.dictionary.to_pylist()]
        tail_size = np.array([len(e) for e in each], np.int64)
        tail_ids = np.array([x for e in each for x in e], np.uint32)
        tail_first = np.cumsum(tail_size) - tail_size
        t = tails.indices.to_numpy()
        a, b = self.size[at], tail_size[t]
        ids = np.empty(int((a + b).sum()), np.uint32)
        first = np.cumsum(a + b) - (a + b)
        ids[ranges(first, a)] = self.ids[ranges(self.first[at], a)]
        ids[ranges(first + a, b)] = tail_ids[ranges(tail_first[t], b)]
        out[rows[rest]] = self._add(missing, ids, a + b)
        return out

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and the bounds of each text's ids among them (one more than texts); nothing for null."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for e in each for x in e], np.uint32), np.cumsum([0, *map(len, each)])
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        place = self._place(words.dictionary)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            if len(self.words) + len(fresh) > self.most:
                self.clear()
                place = self._place(words.dictionary)
                fresh = np.flatnonzero(place < 0)
            place[fresh] = self.learn(words.dictionary.take(pa.array(fresh)))
        at = place[words.indices.to_numpy()]
        size = self.size[at]
        ends = np.r_[0, np.cumsum(size)]
        return self.ids[ranges(self.first[at], size)], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def stream(self, texts: pa.Array, most_bytes: int = 8_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, *coded()) over runs of rows of about so many bytes of text."""
        size = np.r_[0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, size[at] + most_bytes, "right")) - 1)
            yield at, end, *self.coded(texts[at:end])
            at = end


def encoder(path: str, most: int = CACHE_PARTS) -> Encoder:
    """One encoder per worker process and vocabulary; ``most``: parts to keep (memory only)."""
    if path not in _open:
        _open[path] = Encoder(path)
    _open[path].most = most
    return _open[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text's ids."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    stays = np.ones(len(out), bool)
    after = bounds + np.arange(n + 1)
    stays[after[1:] - 1] = False
    out[stays] = ids
    return out, after
