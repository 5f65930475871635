"""Token ids of whole texts, by the `tokenizers` library, with a bounded cache of word encodings.

Both public vocabularies split a text into pre-tokens before they merge, and no pre-token spans a space that follows
a non-space. So the ids of a text are the ids of its space-separated words one after another, and a word that was
seen before needs no second encoding. New words of a batch are encoded together in one call; the token byte lengths
tell where each word's ids end. Words of Latin letters alone are one pre-token, so the library encodes them with the
same model behind a plain split at spaces, without the pattern. Whatever does not fit this scheme (runs of white space,
very long words) is encoded as a piece of its own, and a text that holds the spelling of an added token goes whole to
the library, which gives that token's id.

When the cache is full, the words of the last batches stay in it.

Defined cases: a null text is the caller's to replace; an empty text has no ids; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached words for each Python worker, and the longest word that is cached.
CACHE_WORDS = 500_000
LONGEST = 64
#: Words of letters below this code point are one pre-token in both vocabularies, and NFC leaves them as they are.
LATIN_END = "ɐ"
#: Closing marks that both vocabularies split from a letter or digit before them.
MARKS = ",.;:!?%&$*#"

_SAFE_BREAK = re.compile(r"(?<=\S)(?= )")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file by name; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain_tokenizer(path: str, drops_space: bool):
    """The vocabulary's model behind a split at spaces, for words that are one pre-token each."""
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    spec |= {"added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None}
    plain = Tokenizer.from_str(json.dumps(spec))
    split = pre_tokenizers.WhitespaceSplit() if drops_space else pre_tokenizers.Split(" ", "merged_with_next")
    plain.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


class WordEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(vocabulary(path)), most
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = self.tokenizer.normalizer is not None
        self.plain = _plain_tokenizer(vocabulary(path), self.drops_space)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.removesuffix("</w>")) if self.drops_space else len(token)
        self.newline = self._ids(["\n"])[0]
        self.spaced: dict[str, bytes | None] = {"": b"" if self.drops_space else None}
        self.heads: dict[str, bytes | None] = {"": b""}
        self.recent: list[list[str]] = []

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_letters(self, words: list[str]) -> None:
        """Adds the encodings of words of Latin letters that follow a space."""
        gap = 0 if self.drops_space else 1
        lower = [w.lower() for w in words] if self.drops_space else words
        sizes = pc.binary_length(pa.array(lower, pa.string())).to_numpy() + gap
        for at in range(0, len(words), 512):
            ids = np.array(self.plain.encode_batch_fast([" " * gap + " ".join(lower[at : at + 512])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(sizes[at : at + 512])
            cuts = (4 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            self.spaced.update(zip(words[at : at + 512], map(raw.__getitem__, map(slice, [0, *cuts], cuts))))

    def _is_letters(self, word: str) -> bool:
        if word.isascii():
            return word.isalpha() and len(word) <= LONGEST
        return word.isalpha() and len(word) <= LONGEST and max(word) < LATIN_END and (not self.drops_space or word.lower().isalpha())

    def _learn(self, words: list[str], into: dict[str, bytes | None], gap: str) -> None:
        """Adds the encodings of words that follow a space (gap " ") or none (gap a newline, whose id is left out)."""
        keep = 1 if gap == " " and not self.drops_space else 0
        lead = 0 if keep or self.drops_space else 1
        fit = [w for w in words if 0 < len(w) <= LONGEST and not w[0].isspace() and not w[-1].isspace()]
        for at in range(0, len(fit), 512):
            some = fit[at : at + 512]
            joined = gap + gap.join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            plain = self.tokenizer.normalizer.normalize_str(joined)[1:].split(" ") if self.drops_space else some
            ends = np.cumsum([len(p.encode()) + keep + lead for p in plain])
            reached = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(reached, ends)
            if len(plain) == len(some) and len(ids) and cuts[-1] < len(ids) and (reached[cuts] == ends).all():
                start, raw = 0, ids.tobytes()
                for w, end in zip(some, (4 * (cuts + 1)).tolist()):
                    into[w] = raw[start + 4 * lead : end]
                    start = end
        rest = [w for w in words if w not in into]
        into.update(zip(rest, self._ids([" " * keep + w for w in rest])))

    def _split(self, word: str) -> tuple[dict[str, bytes | None], str, str]:
        """Where a word's encoding is looked up, its core, and its closing marks if they are tokens of their own."""
        known, body = (self.heads, word[1:]) if word[0] == "\n" else (self.spaced, word)
        core = body.rstrip(MARKS)
        return (known, core, body[len(core) :]) if core != body and core and core[-1].lower().isalnum() else (known, body, "")

    def _compose(self, word: str) -> bytes | None:
        """A new word from the encodings of its line break, its core and its closing marks; None where they don't part so."""
        known, core, marks = self._split(word)
        if not core or core[0].isspace() or core[-1].isspace():
            return None
        out = [known[core], self.heads[marks]]
        return None if None in out else (self.newline if word[0] == "\n" else b"") + b"".join(out)

    def _make_room(self) -> None:
        """A full cache keeps the words of the last batches."""
        if len(self.spaced) + len(self.heads) > self.most:
            kept = {"": self.spaced[""]}
            for words in reversed(self.recent):
                if len(kept) + len(words) <= self.most // 4 * 3:
                    kept.update((w, self.spaced[w]) for w in words if w in self.spaced)
            self.spaced = kept
            self.heads = {"": b""}

    def _learn_new(self, new: list[str], firsts: set[str]) -> dict[str, bytes | None]:
        """Encodes new words; those too long for the cache come back as a dictionary of their own."""
        alpha = pc.ascii_is_alpha(pa.array(new, pa.string())).to_numpy(zero_copy_only=False).tolist()
        letters = [w for w, plain in zip(new, alpha) if (plain and len(w) <= LONGEST) or self._is_letters(w)]
        others = set(new).difference(letters)
        wanted: dict[int, set[str]] = {id(self.spaced): set(), id(self.heads): set(firsts)}
        for word in others:
            known, core, marks = self._split(word)
            wanted[id(known)].add(core)
            wanted[id(self.heads)].add(marks)
        spaced, heads = wanted[id(self.spaced)].difference(self.spaced), wanted[id(self.heads)].difference(self.heads)
        cores = [w for w in spaced if self._is_letters(w)]
        self._learn_letters(list({*letters, *cores}))
        self._learn(list(spaced.difference(cores)), self.spaced, " ")
        self._learn(list(heads), self.heads, "\n" if not self.drops_space else " ")
        rare = {}
        for word in others:
            if len(word) > LONGEST:
                rare[word] = self._compose(word)
            elif word not in self.spaced:
                self.spaced[word] = self._compose(word)
        for word in [w for w in spaced if len(w) > LONGEST]:
            rare.setdefault(word, self.spaced.pop(word))
        return rare

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("")
        if not len(column):
            return []
        added = np.logical_or.reduce([pc.match_substring(column, a).to_numpy(zero_copy_only=False) for a in self.added] or [np.zeros(len(column), bool)])
        if added.any():
            rest = iter(self.encode(column.filter(pa.array(~added))))
            return [self._ids([t])[0] if whole else next(rest) for t, whole in zip(column.to_pylist(), added)]
        self._make_room()
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " " if self.drops_space else " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        words, at, edges = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        self.recent = [*self.recent[-2:], words]
        firsts = [] if self.drops_space else [words[i] for i in at[edges[:-1]]]
        rare = self._learn_new([w for w in words if w not in self.spaced], set(firsts))
        ids = list(map(self.spaced.get, words))
        if rare:
            ids = [rare.get(w) if v is None else v for w, v in zip(words, ids)]
        odd = np.zeros(len(column), bool)
        if None in ids:
            none = np.fromiter((v is None for v in ids), bool, len(ids))[at]
            if firsts:
                none[edges[:-1]] = False
            odd = np.logical_or.reduceat(none, edges[:-1])
        laid = pa.array([v or b"" for v in ids], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64)[edges + laid.offset].tolist()
        starts = np.frombuffer(laid.buffers()[1], np.int64)[edges[:-1] + laid.offset + (1 if firsts else 0)].tolist()
        raw, out = memoryview(laid.buffers()[2] or b""), []
        several = (np.diff(edges) > 1).tolist()
        for i, (start, end) in enumerate(zip(starts, ends[1:])):
            head = self._head(firsts[i], several[i]) if firsts else b""  # nothing stands before a text's first word
            if head is None or odd[i]:
                out.append(b"".join(self._ids(_SAFE_BREAK.split(column[i].as_py()))))
            else:
                out.append(head + raw[start:end].tobytes())
        for word in [w for w in self.heads if len(w) > LONGEST] if firsts else []:
            del self.heads[word]
        return out

    def _head(self, first: str, more: bool) -> bytes | None:
        if not first:
            return None if more else b""
        return None if first[0].isspace() or first[-1].isspace() else self.heads[first]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
