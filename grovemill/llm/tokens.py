"""Batch tokenization of distinct words, with merges applied to many pieces at once.

The tokenizer of `word_bpe_49k.json` drops white space before it looks for pairs, so the ids of a text are the ids of its
white-space separated words, one after another. `WordEncoder` therefore encodes each distinct word of a batch once, and
gathers the ids of whole texts with numpy. Words of printable characters below U+0180 are lower-cased and cut by the
tokenizer's pattern over arrays of code points, and the vocabulary's merges are applied to all pieces of one length
together: in each the pair of least rank, of equal ones the first, as the library does one by one. All other words, and
pieces of more than LONG bytes, go through the library. `tests/llm/test_tokens.py` holds both ways against direct calls.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Of words below TOP, but for the one whose lower case is two characters, normalization is lower-casing alone.
TOP, TWO_LOWER = 0x180, 0x130
#: Bytes of a piece that is merged here, and words that are encoded at a time.
LONG, WORDS = 64, 1 << 17
LETTER, DIGIT, OTHER = range(3)
NEVER = np.iinfo(np.int32).max
#: The pattern by which the vocabulary cuts words: fixed values, as its file has them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class WordEncoder:
    """encode(texts) -> (ids, ends): all ids in a row, and where each text ends in them.

    plain_specials: strings of special tokens inside a text are ordinary text, so no text can contain the separator's id.
    keep: the memo of the library's words is emptied beyond so many, which bounds memory.
    """

    def __init__(self, path: str | None = None, plain_specials: bool = False, keep: int = 50_000) -> None:
        from tokenizers import Tokenizer

        path = path or default_vocabulary()
        self.one, self.keep = Tokenizer.from_file(path), keep
        self.one.encode_special_tokens = plain_specials
        self.model, self.memo = self.one.model, {}
        self.specials = [t.content for t in self.one.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        kinds = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = [x for x in cuts if x["type"] == "Split"]
        if kinds != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
            raise ValueError("this vocabulary does not treat white space as a separator that it drops")
        byte_level, model = [x for x in cuts if x["type"] == "ByteLevel"], rules["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if split[0]["pattern"].get("Regex") != PATTERN or len(byte_level) != 1 or byte_level[0]["add_prefix_space"] or byte_level[0]["use_regex"] or model["type"] != "BPE" or odd:
            raise ValueError("this vocabulary does not cut and merge words in the way that is built in here")
        self.letters, vocab, last = byte_letters(), model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[self.letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[self.letters[b] + last] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self._table(keys)
        self.lower = np.array([ord(chr(c).lower()) if c != TWO_LOWER else c for c in range(TOP)], np.uint32)
        kind = lambda c: LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else OTHER
        self.kind = np.array([kind(chr(c)) for c in range(TOP)], np.int8)
        self.easy = np.array([33 <= c < 127 or c > 160 and c != TWO_LOWER for c in range(TOP)] + [False])
        self.dtype = np.uint16 if self.one.get_vocab_size() <= 65_536 else np.int32

    def _table(self, keys: np.ndarray) -> None:
        """An open hash table from pairs to ranks."""
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        ranks, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(ranks):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[ranks[free]]
            mine = self.slot_key[at] == keys[ranks]
            self.slot_rank[at[mine]] = ranks[mine]
            ranks, at = ranks[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; NEVER for those that are not merged."""
        keys = left.astype(np.int64) * self.base + right
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], np.int32(NEVER))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def direct(self, text: str) -> list[int]:
        return self.one.encode(text, add_special_tokens=False).ids

    def _merged(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges pieces of up to LONG symbols in place, each from its start on; how many symbols each has then."""
        counts, order = lengths.copy(), np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(LONG + 2))
        top = int(min(lengths.max(initial=0), LONG))
        who, rows, ranks = order[:0], np.empty((0, top), np.int32), np.empty((0, max(top - 1, 0)), np.int32)
        for n in range(top, 1, -1):
            # All pieces that have n symbols now: those that came down to it, and those that begin with it.
            fresh = order[bounds[n] : bounds[n + 1]]
            if len(fresh):
                own = symbols[starts[fresh][:, None] + np.arange(n)]
                rank = self._rank(own[:, :-1].ravel(), own[:, 1:].ravel()).reshape(-1, n - 1)
                who, rows, ranks = np.concatenate([who, fresh]), np.concatenate([rows, own]), np.concatenate([ranks, rank])
            if len(who):
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(who)), at]
                if len(done := np.flatnonzero(best == NEVER)):
                    symbols[starts[who[done]][:, None] + np.arange(n)] = rows[done]
                    counts[who[done]] = n
                    go = best != NEVER
                    who, rows, ranks, at, best = who[go], rows[go], ranks[go], at[go], best[go]
            if not len(who):
                rows, ranks = np.empty((0, n - 1), np.int32), np.empty((0, n - 2), np.int32)
                continue
            line, new = np.arange(len(who)), self.made[best]
            rows[line, at] = new
            keep = np.ones(rows.shape, bool)
            keep[line, at + 1] = False
            rows = rows[keep].reshape(len(who), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(who), n - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            ranks[left, at[left] - 1] = self._rank(rows[left, at[left] - 1], new[left])
            ranks[right, at[right]] = self._rank(new[right], rows[right, at[right] + 1])
        if top > 1 and len(who):
            symbols[starts[who]] = rows[:, 0]
            counts[who] = 1
        return counts

    def _begins(self, chars: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where the pattern begins a piece: at changes of kind, at each digit, and around the endings with an apostrophe."""
        kind = self.kind[chars]
        begins = np.ones(len(chars), bool)
        begins[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        ends = np.flatnonzero(begins & (chars == ord("'")))
        if len(ends):
            last = len(chars) - 1
            same = lambda k: (ends + k <= last) & (word[np.minimum(ends + k, last)] == word[ends])
            after = [np.where(same(k), chars[np.minimum(ends + k, last)], 0) for k in (1, 2)]
            one = np.isin(after[0], [ord(c) for c in "stmd"])
            two = np.zeros(len(ends), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (after[0] == ord(a)) & (after[1] == ord(b))
            begins[ends[one | two] + 1] = False
            begins[ends[one & same(2)] + 2] = True
            begins[ends[two] + 2] = False
            begins[ends[two & same(3)] + 3] = True
        return begins

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each word's begin in them and how many they are."""
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]
        sizes = np.diff(edges)
        odd = np.concatenate([[0], np.cumsum(~self.easy[np.minimum(chars, TOP)])])
        simple = odd[edges[1:]] == odd[edges[:-1]]
        for special in self.specials:
            simple &= ~pc.match_substring(words, special).to_numpy(zero_copy_only=False)
        own = np.repeat(simple, sizes)
        chars, word = self.lower[chars[own]], np.repeat(np.arange(len(words)), sizes)[own]
        begins = self._begins(chars, word)
        wide = chars >= 0x80
        place = np.cumsum(1 + wide) - 1 - wide
        octets = np.zeros(len(chars) + int(wide.sum()), np.uint8)
        octets[place] = np.where(wide, 0xC0 | chars >> 6, chars)
        octets[place[wide] + 1] = 0x80 | (chars[wide] & 63)
        starts = place[begins]
        lengths = np.diff(np.concatenate([starts, [len(octets)]]))
        symbols = self.inner[octets]
        symbols[starts + lengths - 1] = self.final[octets[starts + lengths - 1]]
        counts = self._merged(symbols, starts, lengths)
        for i in np.flatnonzero(lengths > LONG).tolist():
            text = "".join(map(self.letters.__getitem__, octets[starts[i] : starts[i] + lengths[i]].tolist()))
            found = [t.id for t in self.model.tokenize(text)]
            symbols[starts[i] : starts[i] + len(found)], counts[i] = found, len(found)
        ids = symbols[np.repeat(starts, counts) + within(counts)].astype(self.dtype)
        number = np.bincount(word[begins], counts, len(words)).astype(np.int64)
        first = np.cumsum(number) - number
        if not simple.all():
            rest, at, more = np.flatnonzero(~simple), len(ids), []
            for i, text in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
                found = self.memo.get(text)
                if found is None:
                    if len(self.memo) >= self.keep:
                        self.memo.clear()
                    found = self.memo[text] = self.direct(text)
                first[i], number[i] = at, len(found)
                at += len(found)
                more += found
            ids = np.concatenate([ids, np.array(more, self.dtype)])
        return ids, first, number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        which, found, at = words.indices.to_numpy(), [], 0
        for k in range(0, len(words.dictionary), WORDS):
            ids, first, number = self._words(words.dictionary.slice(k, WORDS))
            found.append((ids, first + at, number))
            at += len(ids)
        if not found:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        ids, first, number = (np.concatenate(x) for x in zip(*found, strict=True))
        size = number.astype(np.int32)[which]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.repeat((first[which] - ends[:-1]).astype(np.int32 if max(ends[-1], len(ids)) < 2**30 else np.int64), size)
        at += np.arange(len(at), dtype=at.dtype)
        return ids[at], ends[bounds[1:] - bounds[0]]


@lru_cache(maxsize=2)
def shared_encoder(path: str, plain_specials: bool = False) -> WordEncoder:
    """One encoder for all tasks of a Python worker: its tables and memo outlive a task."""
    return WordEncoder(path, plain_specials)
