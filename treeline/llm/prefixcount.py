"""Exact token counts at every prefix by dynamic programming over pieces.

A merge never crosses the end of a piece that stays, so the tokens of a prefix are those of a
shorter prefix and one last piece; which piece is decided by whether it may follow the piece
before it.  ``counts[j] = counts[j - len(piece)] + 1``.  No piece has a blank after another
character or a line feed inside, so texts are handled run by run (blanks and the word after
them) and the runs' tables follow each other.

The table of a text is stored as steps, one signed byte a character: how much the count changes with it.  Counts are their
running sums.  :func:`prefix_tables` makes the tables of all texts; how many tokens a text has, whether it is over a limit and where
it has to be cut (:func:`answer`) is read from stored tables, without the texts.

Cases: a null text is empty and has no tokens; texts of any length are counted whole; characters
without a piece count as their UTF-8 bytes; repeated rows all stay; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm.cache import Cache
from treeline.llm.common import id_text, prepare, stage

BLANK = "▁"
CACHE_WORDS = 600_000
CACHE_PAIRS = 1_000_000
CACHE_STARTS = 60_000
START = 6

_counters: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Counts of sentencepiece BPE model *path* with a blank put before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = functools.partial(sp.encode, out_type=int)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in ids}
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("pieces cross words: runs can't be counted one by one")
        # All pieces that end at each character, longest first.
        self.ending = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.ending.add_word(piece, (i, len(piece)))
        self.ending.make_automaton()
        self.width = sp.vocab_size() + 1
        self.spelled = [sp.id_to_piece(i).replace(BLANK, " ") for i in range(sp.vocab_size())]
        # Tables of the first characters of runs, which many runs have in common.
        self.starts = Cache(self._grow, CACHE_STARTS)
        self.pairs: dict[int, bool] = {}
        # Steps of a run, and of what stands between two single blanks.
        self.runs = Cache(self._run_steps, CACHE_WORDS // 4)
        self.keys = Cache(self._key_steps, CACHE_WORDS)
        self.run = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
        if 4 * max(map(len, self.pieces)) > 127:
            raise ValueError("pieces are too long for steps of a byte")

    def _follows(self, last: int, piece: int) -> bool:
        """Whether *piece* after *last* (-1: a barrier) comes out as just these two."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        # Before the text come the library's blank and the line feed's byte.
        if last < 0:
            found = self.encode("\n" + self.spelled[piece])[2:] == [piece]
        else:
            found = self.encode("\n" + self.spelled[last] + self.spelled[piece])[2:] == [last, piece]
        self.pairs[last * self.width + piece] = found
        return found

    def run_counts(self, run: str) -> list[int]:
        """Tokens of run[:j] for each j; *run* has blanks as ``BLANK``."""
        if len(run) <= START:
            return self.starts[run][0]
        return self._grow(run, *self.starts[run[:START]])[0]

    def _grow(self, run: str, counts: list[int] = [0], lasts: list[int] = [-1]) -> tuple[list[int], list[int]]:
        """Counts and last pieces of all prefixes of *run*, from those of its first prefixes."""
        counts, lasts, get, width, done = counts[:], lasts[:], self.pairs.get, self.width, len(counts) - 1
        for end, (piece, size) in self.ending.iter(run):
            if end < done:
                continue  # known, or a longer piece has been found to end here
            while done < end:
                self._bytes_of(run[done], counts, lasts)
                done += 1
            at = end + 1 - size
            ok = get(lasts[at] * width + piece)
            if ok is None:
                ok = self._follows(lasts[at], piece)
            if ok:
                counts.append(counts[at] + 1)
                lasts.append(piece)
                done += 1
        while done < len(run):
            self._bytes_of(run[done], counts, lasts)
            done += 1
        return counts, lasts

    @staticmethod
    def _bytes_of(char: str, counts: list[int], lasts: list[int]) -> None:
        """No piece ends with this character: it falls back to bytes, which merge with nothing."""
        counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))
        lasts.append(-1)

    def _run_steps(self, run: str) -> bytes:
        if run == "\n":
            return b"\x01"
        return np.diff(np.array(self.run_counts(run))).astype(np.int8).tobytes()

    def _key_steps(self, key: str) -> bytes:
        """Steps of a word with the blank before it, or of a line feed and the word after it."""
        return b"".join(map(self._run_steps, self.run.findall(key if key[0] == "\n" else BLANK + key)))

    def steps(self, text: str) -> bytes:
        """The table of *text*: by how much the count changes with each character, as signed bytes."""
        if not text:
            return b""
        keys = text.replace(BLANK, " ").replace("\n", " \n").split(" ")
        if "" not in keys:
            out = b"".join(map(self.keys.__getitem__, keys))
        else:  # blanks that meet, or outer ones, belong to one run with the word after them
            out = b"".join(map(self.runs.__getitem__, self.run.findall(BLANK + text.replace(" ", BLANK))))
        # The library's blank before the text counts with the first character.
        first = int.from_bytes(out[:1], signed=True) + int.from_bytes(out[1:2], signed=True)
        return first.to_bytes(1, signed=True) + out[2:]


def counts_of(steps: bytes) -> np.ndarray:
    """Tokens of every prefix, from none to the whole text."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def total_of(steps: bytes) -> int:
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


def fitting(steps: bytes, budget: int) -> int:
    """The longest prefix, in characters, of *budget* tokens or fewer."""
    return int(np.flatnonzero(counts_of(steps) <= budget)[-1])


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_tables(spark: SparkSession, docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and steps, the table of the whole text: see :func:`counts_of`."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(own.steps, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "steps"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, steps binary")


def answer(spark: SparkSession, tables: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the longest prefix within *limit* tokens, from *tables* alone."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column(2).to_pylist()
            totals = [total_of(s) for s in steps]
            fits = [len(s) if n <= limit else fitting(s, limit) for s, n in zip(steps, totals)]
            columns = [*batch.columns[:2], pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return tables.select("doc_id", "n_bytes", "steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def count_tokens(spark: SparkSession, docs: DataFrame, model: str, limit: int) -> DataFrame:
    """Store the tables of *docs* and answer from them."""
    return answer(spark, stage(spark, prefix_tables(spark, docs, model), "prefix-tables"), limit)
