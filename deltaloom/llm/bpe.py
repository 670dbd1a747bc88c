"""Exact byte-pair encoding by parts: split a text as the tokenizer does, encode distinct parts once.

The library's own model encodes the parts, so a text's ids are those of its parts in order. Texts whose
characters are all in a plain Latin set are split by an equal pattern here; any other text is split by
the library's own normaliser and pre-tokeniser.

Special strings are found in the text as it is, before any normaliser: `<|endoftext|>` is one id, and
`<|ENDOFTEXT|>` is ordinary text, whatever it spells in lower case.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The patterns of the two public vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Ids that are put together at once.
GATHERED_IDS = 1 << 20
#: Code points on which Python's and the library's classes and case rules agree, and that NFC leaves alone:
#: Latin without controls, no-break space, soft hyphen and the dotted capital I.
_PLAIN_POINTS = [*range(9, 14), *range(32, 127), *range(161, 173), *range(174, 304), *range(305, 592)]


def _plain_class(kind: str = "") -> str:
    """The inside of a character class: the plain characters of a Unicode category's first letter."""
    return "".join(re.escape(c) for c in map(chr, _PLAIN_POINTS) if unicodedata.category(c).startswith(kind))



def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follows 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


BYTE_CHARS = _byte_chars()
#: Code points of the vocabulary's characters by byte; 255, which no UTF-8 has, parts the parts.
_SPELL = np.array([*map(ord, BYTE_CHARS[:255]), 32], "<u4")
#: A full stop or comma that isn't between a letter or digit and white space.
_GROUPED_STOPS = re.compile(r"[.,](?:\S|(?<![^\W_][.,]))")
_PLAIN = re.compile(f"[{_plain_class()}]*")


def tokenizer_path(name: str) -> str:
    """Where a named vocabulary of the public tokenizers package lies; other paths stay as they are."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Splitter:
    """Splits texts into pre-tokens; special strings come out whole, as the library's default has them."""

    def __init__(self, name: str):
        import json

        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._starts = tuple({s[:2] for s in self.special})
        self.spaceless = spec["normalizer"] is not None
        # On plain characters the standard library's engine with spelled-out classes finds the same, faster.
        pattern = WORD_PATTERN if self.spaceless else BYTE_PATTERN
        for short, kind in ((r"[\p{L}]", "L"), (r"[\p{N}]", "N"), (r" ?\p{L}", " ?L"), (r" ?\p{N}", " ?N")):
            pattern = pattern.replace(short, f"{kind[:-1]}[{_plain_class(kind[-1])}]")
        pattern = pattern.replace(r"\p{L}\p{N}", _plain_class("L") + _plain_class("N"))
        self.pattern = re.compile(pattern)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        if self.spaceless:
            from tokenizers import Regex, pre_tokenizers

            self._split = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True)
        else:
            self._split = self.library.pre_tokenizer
        self._prepare_parts(Tokenizer)

    def _prepare_parts(self, kind: type) -> None:
        """The library's model behind a plain white-space split, for parts in the vocabulary's characters, and what its ids spell."""
        from tokenizers import pre_tokenizers

        self._model = kind(self.library.model)
        self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: One more than the greatest id, and the least type that holds all ids.
        self.vocabulary_size = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        self.id_type = "<u2" if self.vocabulary_size <= 1 << 16 else "<u4"
        self._spelt = np.zeros(self.vocabulary_size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self._spelt[i] = len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self._starts) and self._specials.search(text) is not None

    def _segment(self, text: str) -> list[str]:
        if self.plain(text):
            return self.pattern.findall(text.lower() if self.spaceless else text)
        if self.spaceless:
            return [x for x, _ in self._split.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return [text[a:b] for _, (a, b) in self._split.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text in order."""
        if not self.has_special(text):
            return self._segment(text)
        return list(chain.from_iterable([x] if x in self.special else self._segment(x) for x in self._specials.split(text) if x))

    def spaced(self, text: str) -> str | None:
        """The text in lower case, with white space between parts whose ids, in order, are the text's; None where
        it takes `pieces` to split it.

        White space is dropped by the vocabulary, so words will do. A full stop or comma between a letter
        or digit and white space is a pre-token of its own, so it is cut off: the distinct parts are then
        about the distinct pre-tokens. A text that spells a special string, or would in lower case, is
        left to `pieces`.
        """
        if not self.spaceless or not self.plain(text):
            return None
        low = text.lower()
        if self.has_special(low) or self.has_special(text):
            return None
        return low if _GROUPED_STOPS.search(low) else low.replace(",", " ,").replace(".", " .")

    def ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all parts in order, and where each part's end; parts come from `spaced` or `pieces`.

        Pre-tokens go to the library's model as one text, in the vocabulary's own characters; what each
        id spells tells where parts end.
        """
        known = self.special
        if not any(p in known for p in parts):
            return self._ordinary(parts)
        # Special strings have one id each; what lies between them is encoded as one run.
        ids, ends, run, at = [], [], [], 0

        def flush() -> None:
            nonlocal at
            if run:
                own, stops = self._ordinary(run)
                ids.append(own), ends.append(stops + at)
                at += len(own)
                run.clear()

        for p in parts:
            if p in known:
                flush()
                at += 1
                ids.append(np.array([known[p]])), ends.append(np.array([at]))
            else:
                run.append(p)
        flush()
        return np.concatenate(ids), np.concatenate(ends)

    def _ordinary(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = pc.binary_length(pa.array(parts, pa.string())).to_numpy()
        if self.spaceless and self.plain(text := " ".join(parts)):
            parts = self.pattern.findall(text)  # a plain part may be several pre-tokens; any other one is a pre-token
        data = np.frombuffer(b"\xff".join(map(str.encode, parts)), np.uint8)
        text = _SPELL[data].tobytes().decode("utf-32-le")
        ids = np.array(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        return ids, np.searchsorted(np.cumsum(self._spelt[ids]), np.cumsum(sizes), "left") + 1


@lru_cache(maxsize=4)
def splitter(name: str) -> Splitter:
    """One a worker process and vocabulary."""
    return Splitter(name)


class CachedEncoder:
    """Ids of whole texts; at most `bound` distinct parts are remembered, as places in one array of ids."""

    def __init__(self, name: str, bound: int = 800_000):
        self.split, self.bound, self.known = splitter(name), bound, {"": 0}  # nothing has no ids
        self.ids, self.ends = np.zeros(1 << 16, self.split.id_type), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Numbers new parts after those that are known, and stores their ids after theirs."""
        ids, ends = self.split.ids_of(new)
        at = len(self.known)
        used = int(self.ends[at - 1])
        self.ids, self.ends = (x if need <= len(x) else np.concatenate([x, np.zeros(max(len(x), need - len(x)), x.dtype)]) for x, need in ((self.ids, used + len(ids)), (self.ends, at + len(new))))
        self.ids[used : used + len(ids)] = ids
        self.ends[at : at + len(new)] = ends + used
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def _gathered(self, distinct: list[str], place: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The ids of texts that have so many parts each; place: of each part among the distinct ones."""
        known = list(map(self.known.get, distinct))
        if None in known:
            gaps = [i for i, x in enumerate(known) if x is None]
            new, kept = [distinct[i] for i in gaps], len(self.known)
            self._learn(new)
            for i, at in enumerate(gaps):
                known[at] = kept + i
            for p in new[max(0, self.bound - kept) :]:  # the parts that came first stay, and the frequent ones are among them
                del self.known[p]
        at = np.array(known, np.int64)
        end = self.ends[at]
        n, end = (end - np.where(at > 0, self.ends[at - 1], 0))[place], end[place]
        after = np.cumsum(n)
        words = np.concatenate([[0], np.cumsum(sizes)])
        stops = np.concatenate([[0], after])[words]
        # About GATHERED_IDS at once, which bounds the places that are in memory.
        cuts = np.unique([0, *np.searchsorted(stops, np.arange(GATHERED_IDS, stops[-1], GATHERED_IDS)), len(sizes)]).tolist()
        out: list[np.ndarray] = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            w = slice(words[x], words[y])
            ids = self.ids[np.repeat(end[w] - after[w], n[w]) + np.arange(stops[x], stops[y])]
            edges = (stops[x : y + 1] - stops[x]).tolist()
            out += [ids[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        spaced = [self.split.spaced(t) if t else "" for t in texts]
        words = pc.ascii_split_whitespace(pa.array([x or "" for x in spaced], pa.string()))
        found = words.flatten().dictionary_encode()
        out = self._gathered(found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), words.value_lengths().to_numpy())
        for i, x in enumerate(spaced):
            if x is None:
                parts = self.split.pieces(texts[i])
                number = {p: k for k, p in enumerate(dict.fromkeys(parts))}
                out[i] = self._gathered(list(number), np.array([number[p] for p in parts], np.int64), np.array([len(parts)]))[0]
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> CachedEncoder:
    """One a worker process and vocabulary, so that tasks of a worker share what is known."""
    return CachedEncoder(name)
