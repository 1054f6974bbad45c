"""Exact, cached tokenization with a public word-level BPE vocabulary.

The vocabulary of the ``tokenizers`` library used here drops white space, so the
ids of a text are the ids of its white-space separated chunks, one after the
other.  Chunks repeat; their ids are kept per worker in a bounded cache, and only
words not seen before go to the library's merge model.  ``encode_all`` gives
exactly what ``Tokenizer.encode(text, add_special_tokens=False)`` gives (tests
compare the two on prose and on random Unicode).  A file that states other steps
is not cached so: its texts go to the library whole.
"""

from __future__ import annotations

import json
import struct

import regex

#: Bound of each of the two caches of one worker: ids of chunks, ids of words.
MAX_CACHED = 250_000

#: White space for ``str.split`` but not for the vocabulary's splitter; special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Below this code point no character is changed by NFC and lower case needs no context.
_SIMPLE = "\u0250"
#: The splitting pattern and the normalising steps that the public vocabulary file states.  Fixed values.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = regex.compile(_PATTERN)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one after 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


_LETTERS = _byte_letters()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]

_loaded: dict[str, "WordTokenizer"] = {}


def default_path() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str | None = None) -> "WordTokenizer":
    """The tokenizer of this worker process for a vocabulary file."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class _Words(dict):
    """Ids of pieces of the splitting pattern, in lower case; made when first asked for."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.tokenize(letters)]
        got = self[word] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)
        return got


class _Chunks(dict):
    """Ids of chunks between white space; made when first asked for."""

    def __init__(self, owner: "WordTokenizer"):
        self.owner, self.words = owner, owner.words

    def __missing__(self, chunk: str) -> bytes:
        words = self.words
        if not chunk.isascii() and max(chunk) >= _SIMPLE:  # normalising may do anything: the library's own way
            got = self.owner._plain(chunk)
        elif (low := chunk.lower()).isalpha():
            got = words[low]
        elif low[:-1].isalpha() and not low[-1].isalnum():
            got = words[low[:-1]] + words[low[-1]]
        else:
            got = b"".join(map(words.__getitem__, _SPLIT.findall(low)))
        self[chunk] = got
        return got


def _is_known(file: dict) -> bool:
    """Whether a vocabulary file normalises and splits as the cache takes it; any other goes to the library as it is."""
    normalizer, split = file.get("normalizer") or {}, (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (
        normalizer.get("normalizers") == _NORMALISED
        and len(split) == 2
        and split[0].get("pattern") == {"Regex": _PATTERN}
        and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
        and (split[1].get("type"), split[1].get("add_prefix_space"), split[1].get("use_regex")) == ("ByteLevel", False, False)
        and file["model"].get("type") == "BPE"
        and not file["model"].get("dropout")
        and not file.get("truncation")
        and file.get("post_processor") is None
        and all(t["content"].startswith("<|") for t in file.get("added_tokens", ()))
    )


class WordTokenizer:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _is_known(json.loads(self.tokenizer.to_str()))
        self.words = _Words(self.tokenizer.model)
        self.cache = _Chunks(self)

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: as empty), 4 bytes each, without special tokens."""
        for cache in (self.cache, self.words):
            if len(cache) > MAX_CACHED:
                cache.clear()
        get, out = self.cache.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.known or any(x in text for x in _ODD):
                out.append(self._plain(text))
            else:
                out.append(b"".join(map(get, text.split())))
        return out
