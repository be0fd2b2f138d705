"""Token ids of whole texts, with the library called once per new word instead of per text.

The word vocabulary's rules drop white space and never look across it, so the ids of a text
are the ids of its pieces between blanks.  Only blanks and line feeds are cut at; whatever
other white space there is stays inside a piece.  A batch's distinct pieces are found by Arrow.  Those of plain
Latin-1 characters are folded and split here by the same rules, all in one pass, and the library's model encodes
their parts; any other piece goes through the whole library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from treeline.llm import cache

#: Pieces of these characters, and blanks between them.
PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*").fullmatch
#: The split rule of the vocabulary file for folded plain pieces; blanks between them are parts of their own.
PARTS = re.compile(r"[a-zß-öø-ÿ]+| |[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+").findall

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts with ``tokenizers`` file *path*, ids as little-endian unsigned integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.model = self.library.model
        self.bytes = _byte_letters()
        self.raw = [np.array([i], self.dtype).tobytes() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        # Other pieces are rare, so most of the room is for parts.
        self.part = cache.Cache(self._part, 2 * cache.CACHE_WORDS).__getitem__
        self.other = cache.Cache(self._other, max(1, cache.CACHE_WORDS // 2)).__getitem__

    def _part(self, part: str) -> bytes:
        if part == " ":
            return b""
        spelled = part if part.isascii() else "".join(map(self.bytes.__getitem__, part.encode()))
        return b"".join([self.raw[t.id] for t in self.model.tokenize(spelled)])

    def _other(self, piece: str) -> bytes:
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def _plain(self, pieces: list[str], joined: str) -> pa.Array:
        """Ids of plain pieces; *joined* has them with a blank between any two."""
        parts = PARTS(joined.lower())
        ids = list(map(self.part, parts))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        offsets = np.zeros(len(pieces) + 1, np.int64)
        offsets[1:-1] = ends[np.fromiter(map(" ".__eq__, parts), bool, len(parts))]
        offsets[-1:] = ends[-1:] if len(ends) else 0
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(ids))])

    def _distinct(self, pieces: list[str]) -> pa.Array:
        joined = " ".join(pieces)
        if PLAIN(joined) and "<|" not in joined:
            return self._plain(pieces, joined)
        plain = np.fromiter((PLAIN(p) is not None and "<|" not in p for p in pieces), bool, len(pieces))
        ours = [p for p, own in zip(pieces, plain.tolist()) if own]
        others = [self.other(p) for p, own in zip(pieces, plain.tolist()) if not own]
        place = np.where(plain, np.cumsum(plain) - 1, len(ours) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([self._plain(ours, " ".join(ours)), pa.array(others, pa.large_binary())]).take(pa.array(place))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        pieces = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        ids = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[pieces.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def id_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with its texts' ids, *end_id* appended; a null text counts as empty."""
    own = encoder(path)
    end = np.array([end_id], own.dtype).tobytes()
    for batch in batches:
        yield batch, [ids + end for ids in own.encode(batch.column(batch.schema.get_field_index("text")))]
