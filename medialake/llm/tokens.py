"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

In the supported pipeline (NFC, white space collapsed, lower case; a splitting pattern that drops white space;
byte-level BPE with a word end) no token crosses white space, so the ids of a text are the ids of its
blank-separated chunks in a row. Each Python worker asks the library once for every distinct chunk it meets
and keeps the answer as packed little-endian integers; the memo is emptied at a fixed size, so memory stays
bounded. A chunk that is one Latin word, with or without sentence marks after it, goes straight to the
library's BPE model, as normalising and splitting it has a known outcome; any other chunk goes through the
whole library pipeline, and with any other vocabulary every text does.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

MEMO_ENTRIES = 400_000
#: One Latin word in small letters, then sentence marks: two pieces for the splitting pattern.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
_encoders: dict[str, "Encoder"] = {}


def chunkable(spec: dict) -> bool:
    """Whether the vocabulary has the pipeline that this module may take apart at blanks."""
    normalizers = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        normalizers == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and pre[0]["behavior"] == "Removed"
        and pre[0]["invert"]
        and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pre[0]["pattern"].get("Regex", "")
        and not (pre[1]["add_prefix_space"] or pre[1]["use_regex"])
        and model["type"] == "BPE"
        and not model["dropout"]
        and spec.get("post_processor") is None
        and len(os.path.commonprefix([t["content"] for t in spec["added_tokens"]])) > 0
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\v\f")) for t in spec["added_tokens"])
    )


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.memo = Memo(self._chunk)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = chunkable(spec)
        self.added = os.path.commonprefix([t["content"] for t in spec["added_tokens"]]).encode()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(piece)]

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids of one chunk, packed."""
        text = chunk.decode()
        parts = PLAIN.fullmatch(text.lower())
        if parts is None or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        word, marks = parts.groups()
        ids = array("I", self._piece(word))
        if marks:
            ids.extend(self._piece(marks))
        return ids.tobytes()

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            return self._encode([t.decode() for t in texts])
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        get = self.memo.__getitem__
        # A-Z may be lower-cased early, except where an added token could be spelt; bytes.split() cuts at the six
        # ASCII blanks alone, and any other white space is the library's matter
        return [b"".join(map(get, (t if self.added in t else t.lower()).split())) for t in texts]


class Memo(dict):
    """Chunks and their packed ids; an unknown chunk is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[bytes], bytes]) -> None:
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.encode(chunk)
        return ids


def encoder(path: str) -> Encoder:
    """One encoder, and one memo, for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
