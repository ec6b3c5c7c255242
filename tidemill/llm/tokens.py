"""Token ids of whole texts by a ``tokenizers`` file, word by word through a bounded store.

Both kinds of file here cut a text between a visible character and white space, after a line
feed, and between a letter and an ASCII character that is none. What stands between two such
places gets the same ids alone as in the text. Arrow cuts the texts and finds the distinct
pieces of a batch, a store has the ids of frequent ones, and the library encodes the rest. Texts
in which that rule could fail (control characters, strings of added tokens, white space other
than single spaces and line feeds) are cut at white space only, or given to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CONTROL = r"[\x00-\x09\x0b-\x1f\x7f" + _SPACES + "]"
_GAPS = r"[ \n][ \n]|\A[ \n]|[ \n]\z"
_LETTER_END = r"(\p{L})([!-@\[-`{-~])"
_UNSAFE = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
_RUNS = re.compile(r"\s*\S+|\s+")
STORE = 250_000
SLICE_BYTES = 4_000_000
JOINED = 256  # pieces that the library gets as one text

_loaded: dict[tuple[str, int], "WordTokenizer"] = {}


class Store:
    """A bounded store of two generations: what is used moves to the young one, and the old one goes when that is full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def values(self, keys: list[str], make) -> list[bytes]:
        """The value of each key; ``make`` gives those of a list of unknown keys."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            old = list(map(self.old.get, [keys[i] for i in missing]))
            fresh = [keys[i] for i, v in zip(missing, old, strict=True) if v is None]
            made = iter(make(fresh) if fresh else ())
            for i, v in zip(missing, old, strict=True):
                found[i] = self.young[keys[i]] = next(made) if v is None else v
        return found


class WordTokenizer:
    """``encode(texts)`` gives for each text the little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, store: int = STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # byte-level files keep white space; files that mark ends of words drop it
        self.keeps_space = not getattr(self.library.model, "end_of_word_suffix", None)
        added = self.library.get_added_tokens_decoder()
        self.added = [x.content for _, x in sorted(added.items())]
        self.mark = next(((x.content, i) for i, x in sorted(added.items()) if not (x.single_word or x.lstrip or x.rstrip or x.normalized)), None)
        self.store = Store(store)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of many short texts without added tokens: one of these stands between each two, where the library cuts first."""
        if self.mark is None:
            return self.whole(texts)
        mark, mark_id = self.mark
        groups = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        out: list[bytes] = []
        for own, found in zip(groups, self.library.encode_batch_fast([mark.join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            at = (4 * np.flatnonzero(ids == mark_id)).tolist()
            if len(at) != len(own) - 1:  # a mark that is more than a mark
                out += self.whole(own)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)], strict=True)]
        return out

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts the rule for letters and single spaces can't be used on."""
        marks = pc.match_substring_regex(texts, _CONTROL + (f"|{_GAPS}" if self.keeps_space else ""))
        for x in self.added:
            marks = pc.or_(marks, pc.match_substring(texts, x))
        return marks.to_numpy(zero_copy_only=False)

    def one(self, text: str) -> bytes:
        """A text of any kind."""
        if not text:
            return b""
        if _UNSAFE.search(text) or any(x in text for x in self.added):
            return self.whole([text])[0]
        return b"".join(self.store.values(_RUNS.findall(text) if self.keeps_space else text.split(), self.pieces))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = self.odd(texts)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.one(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        sizes = pc.binary_length(texts).to_numpy()[plain]
        group = np.cumsum(sizes) // SLICE_BYTES
        for part in np.split(plain, np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                for i, ids in zip(part.tolist(), self.plain(texts.take(pa.array(part))), strict=True):
                    out[i] = ids
        return out

    def plain(self, texts: pa.Array) -> list[bytes]:
        cut = pc.replace_substring(texts, " ", "\x01 " if self.keeps_space else "\x01")
        cut = pc.replace_substring(cut, "\n", "\x01\n\x01" if self.keeps_space else "\x01")
        cut = pc.split_pattern(pc.replace_substring_regex(cut, _LETTER_END, "\\1\x01\\2"), "\x01")
        words = cut.flatten().dictionary_encode()
        ids = self.store.values(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.pieces)
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(lengths) - lengths
        at = words.indices.to_numpy()
        counts = lengths[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        raw = flat[np.repeat(firsts[at] - (ends - counts), counts) + np.arange(total)].tobytes()
        bounds = 4 * np.concatenate(([0], ends))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        bounds = bounds.tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def tokenizer(path: str, store: int = STORE) -> WordTokenizer:
    """One tokenizer a process, file and size of the store, whose two generations hold ``store`` pieces each."""
    if (path, store) not in _loaded:
        _loaded[path, store] = WordTokenizer(path, store)
    return _loaded[path, store]
