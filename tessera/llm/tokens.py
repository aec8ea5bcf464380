"""Token ids of texts by the tokenizers library, each different word encoded about once.

The tokenizer drops white space and never joins what white space parts, so the ids of a
text are those of its words in order. Words are found and told apart by Arrow. A word of
Latin letters with signs at its end is two pre-tokens: its letters, put into lower case as
the tokenizer does itself, and its signs are encoded apart. A memo of bounded size, in flat
arrays, holds the ids of words already met; new ones are encoded many at a time, their ends
told by the ids that close a word.

Texts are taken in slices of about SLICE_BYTES; a longer text is cut at white space, so
memory is bounded by the longest run without any (and the ids of one text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import word_hashes

#: Words in the memo of a Python worker, some 40 bytes each; beyond that it starts anew.
MEMO_WORDS = 1_000_000
#: Longer words are encoded wherever they occur.
MEMO_BYTES = 64
#: Bytes of text encoded at once.
SLICE_BYTES = 4_000_000
#: Words of one call to the tokenizer.
CALL_WORDS = 4096
#: Signs that may follow a word of letters and are a pre-token of their own there.
TAILS = ".,;:!?#%&*$|"
#: Letters whose lower case is one letter, the same to all libraries, and in normal form.
LATIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"

_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Free the encoders of this Python worker, which serves later steps too."""
    _encoders.clear()


class Memo:
    """Runs of ids by two hashes of their word: arrays in order of the first hash, and one pool."""

    def __init__(self, dtype):
        self.key = np.zeros(0, dtype=np.uint64)
        self.check = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int32)
        self.size = np.zeros(0, dtype=np.uint8)
        self.pool = np.zeros(0, dtype=dtype)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for new ones."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        short = size < 256
        start = np.cumsum(size) - size + len(self.pool)
        key, order = np.unique(np.concatenate([self.key, key[short]]), return_index=True)
        self.key = key
        self.check = np.concatenate([self.check, check[short]])[order]
        self.start = np.concatenate([self.start, start[short].astype(np.int32)])[order]
        self.size = np.concatenate([self.size, size[short].astype(np.uint8)])[order]
        self.pool = np.concatenate([self.pool, ids])


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after the other."""
    take = np.repeat(start - (np.cumsum(size) - size), size)
    take += np.arange(len(take), dtype=take.dtype)
    return pool[take]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.closes = np.zeros(self.size, dtype=bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.memo = Memo(self.dtype)

    def _ids(self, text: str) -> np.ndarray:
        # without offsets, which nothing here needs
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's), word by word."""
        runs = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        return np.fromiter((i for run in runs for i in run), dtype=self.dtype, count=int(sizes.sum())), sizes

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _each, for words of Latin letters in lower case: each is one pre-token, closed by one id."""
        parts = []
        for k in range(0, len(words), CALL_WORDS):
            part = words.slice(k, CALL_WORDS)
            ids = self._ids(pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), " ")[0].as_py())
            ends = np.flatnonzero(self.closes[ids]) + 1
            whole = len(ends) == len(part) and ends[-1] == len(ids)
            parts.append((ids, np.diff(ends, prepend=0)) if whole else self._each(part))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=np.int64))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's) of different words, none empty."""
        bare = pc.ascii_rtrim(words, characters=TAILS)
        latin = pc.match_substring_regex(bare, LATIN)
        # what is encoded as one: letters in lower case, or the word as it is
        core = pc.if_else(latin, pc.utf8_lower(bare), words).dictionary_encode()
        is_latin = np.asarray(pc.match_substring_regex(core.dictionary, LATIN))
        cores = core.dictionary
        if not len(cores):
            return np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=np.int64)
        key, check = word_hashes(cores, 0), word_hashes(cores, 1)
        found = self.memo.find(key, check)
        start, size = np.zeros(len(cores), dtype=np.int64), np.zeros(len(cores), dtype=np.int64)
        old = found >= 0
        start[old], size[old] = self.memo.start[found[old]], self.memo.size[found[old]]
        pools, at = [self.memo.pool], len(self.memo.pool)
        brief = np.asarray(pc.binary_length(cores)) <= MEMO_BYTES
        fresh = []
        for chosen, encode in ((~old & is_latin, self._letters), (~old & ~is_latin, self._each)):
            rows = np.flatnonzero(chosen)
            ids, sizes = encode(cores.take(pa.array(rows)))
            start[rows], size[rows] = at + np.cumsum(sizes) - sizes, sizes
            at += len(ids)
            pools.append(ids)
            fresh.append(rows[brief[rows]])
        pool = np.concatenate(pools)
        self._keep(key, check, pool, start, size, np.concatenate(fresh))
        # signs at the end of words of letters
        tails = pc.utf8_slice_codeunits(words, 0)  # replaced below where there is one
        which = core.indices.to_numpy(zero_copy_only=False)
        has_tail = np.asarray(latin) & (np.asarray(pc.binary_length(bare)) < np.asarray(pc.binary_length(words)))
        rows = np.flatnonzero(has_tail)
        if not len(rows):
            return gather(pool, start[which], size[which]), size[which]
        tails = pc.replace_substring_regex(words.take(pa.array(rows)), "^.*?([" + TAILS + "]+)$", r"\1").dictionary_encode()
        ids, sizes = self._each(tails.dictionary)
        tail_start, tail_size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        of = tails.indices.to_numpy(zero_copy_only=False)
        tail_start[rows], tail_size[rows] = (len(pool) + np.cumsum(sizes) - sizes)[of], sizes[of]
        pool = np.concatenate([pool, ids])
        both_start = np.stack([start[which], tail_start], axis=1).ravel()
        both_size = np.stack([size[which], tail_size], axis=1).ravel()
        return gather(pool, both_start, both_size), size[which] + tail_size

    def _keep(self, key, check, pool, start, size, rows) -> None:
        if len(self.memo.key) + len(rows) > MEMO_WORDS:
            self.memo = Memo(self.dtype)
        self.memo.add(key[rows], check[rows], gather(pool, start[rows], size[rows]), size[rows])

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and in all: one more entry than texts). Null: empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        del lists
        filled = np.asarray(pc.binary_length(words.dictionary)) > 0  # white space at either end leaves empty words
        ids, sizes = np.zeros(0, dtype=self.dtype), np.zeros(len(filled), dtype=np.int64)
        if filled.any():
            ids, sizes[filled] = self.words(words.dictionary.filter(pa.array(filled)))
        which = words.indices.to_numpy(zero_copy_only=False)
        if not len(which):
            return ids, np.zeros(len(bounds), dtype=np.int64)
        starts = (np.cumsum(sizes) - sizes)[which].astype(np.int32 if len(ids) < 1 << 31 else np.int64)
        each = sizes[which]
        before = np.concatenate([[0], np.cumsum(each)])
        return gather(ids, starts, each.astype(starts.dtype)), before[bounds]


def segments(text: pa.Scalar, most: int) -> pa.Array:
    """A text in parts of about most bytes, cut at white space."""
    raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
    cuts, at = [0], 0
    while at + most < len(raw):
        at += most
        while at < len(raw):  # ASCII white space is never inside a character
            here = raw[at : at + 4096]
            space = np.flatnonzero((here == 32) | ((here >= 9) & (here <= 13)))
            if len(space):
                at += int(space[0])
                cuts.append(at)
                break
            at += len(here)
    cuts.append(len(raw))
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.asarray(cuts, dtype=np.int64)), text.as_buffer()).cast(pa.string())


def encoded(batch: pa.RecordBatch, column: str, path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (slice of the batch, its ids, ids before each row and in all)."""
    own = encoder(path)
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        if int(ends[end - 1]) - base > SLICE_BYTES:  # one long text
            parts = [own.column(part)[0] for part in _parts(texts[at])]
            ids = np.concatenate(parts)
            yield batch.slice(at, 1), ids, np.array([0, len(ids)])
        else:
            yield (batch.slice(at, end - at), *own.column(texts.slice(at, end - at)))
        at = end


def _parts(text: pa.Scalar) -> Iterator[pa.Array]:
    cut = segments(text, SLICE_BYTES)
    return (cut.slice(k, 1) for k in range(len(cut)))
