"""Operator 10: token counts of whole texts, by batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are split at safe boundaries: a word piece of this model has its
space mark only in front, so no merge crosses the border between a character and a following space, nor a
line feed, which no piece holds. The parts' counts therefore add up to the whole text's. A part is a run of other bytes with
the spaces before it; each distinct part is encoded once and remembered by its 64-bit hash, so most of a text
is counted by array look-ups. Texts that hold the space mark itself are encoded whole, and so is every
text if the model's pieces don't have that form.

Null counts as the empty text: no bytes, no tokens. Repeated rows and null ids stay as they are.
Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._shared import read

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
#: Distinct parts that a worker remembers at most (12 bytes each); then it starts anew.
REMEMBERED = 2_000_000
#: Characters of texts encoded in one call, about.
ENCODED = 1 << 18
#: Characters of short parts joined to one text.
JOINED = 1500
_MARK = "▁"
_SPACE, _FEED = 0x20, 0x0A


class Counter:
    """Token counts of texts by a sentencepiece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        #: Whether parts may be counted apart: no piece has the mark behind a character, none has a line feed.
        self.splits = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        self.opens = np.array([p.startswith(_MARK) for p in pieces])
        self.feed = self.model.piece_to_id("<0x0A>")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> np.ndarray:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > ENCODED:
                out += [len(x) for x in self.model.encode(some, num_threads=1)]
                some, size = [], 0
        return np.array(out + [len(x) for x in self.model.encode(some, num_threads=1)], np.int64)

    def _joined(self, texts: list[str], by: str) -> np.ndarray:
        """Counts of texts without spaces or feeds, encoded as one text, joined by a space or a feed (which they then begin with)."""
        size = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.flatnonzero(np.diff(size // JOINED, prepend=-1)).tolist() + [len(texts)]
        joined = [("" if by == " " else by) + by.join(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.fromiter(itertools.chain.from_iterable(self.model.encode(joined, num_threads=1)), np.int64)
        if by == " ":
            return np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
        feeds = np.flatnonzero(ids == self.feed)
        lead = np.diff(feeds, append=len(ids))
        last = np.cumsum(np.diff(cuts)) - 1  # what follows is the next call's leading mark
        lead[last[:-1]] -= 1
        return lead

    def _part(self, spaces: np.ndarray, texts: list[str]) -> np.ndarray:
        """Counts of parts: so many spaces, then text. The model sets one space before what it encodes."""
        n = np.ones(len(texts), np.int64)  # of one space alone
        full = np.array([bool(t) and _MARK not in t for t in texts], bool)  # texts with a mark are counted elsewhere
        for k, by in ((1, " "), (0, "\n")):
            rows = np.flatnonzero(full & (spaces == k))
            if len(rows):
                n[rows] = self._joined([texts[i] for i in rows], by) - (k == 0)
        rows = np.flatnonzero(spaces > 1)
        if len(rows):
            n[rows] = self._encode([" " * int(spaces[i] - 1) + texts[i] for i in rows])
        return n

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = texts.fill_null("")
        if not self.splits:
            return self._encode(texts.to_pylist())
        data, off = X.buffers(texts)
        out = np.zeros(len(texts), np.int64)
        if len(data):
            self._count(data, off, out)
        for i in np.flatnonzero(pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)):
            out[i] = self._encode([texts[int(i)].as_py()])[0]
        return out

    def _count(self, data: np.ndarray, off: np.ndarray, out: np.ndarray) -> None:
        feed = data == _FEED
        hashes, begin, end = X.run_hashes(data, off, feed | (data == _SPACE))
        feeds = np.flatnonzero(feed)
        owner = np.searchsorted(off, np.concatenate([begin, feeds]), "right") - 1
        np.add.at(out, owner[len(begin) :], 1)
        # spaces before a run, and those before a feed or an end; what comes before them is a run, a feed or the text's start
        before = np.sort(np.concatenate([off[:-1], end, feeds + 1]))
        starts = np.zeros(len(data) + 1, bool)
        starts[off[:-1]] = True
        bound = before[np.searchsorted(before, begin, "right") - 1]
        self._add(out, owner[: len(begin)], begin - bound + starts[bound], hashes, data, begin, end)
        full = np.flatnonzero(np.diff(off))
        stop = np.concatenate([feeds, off[1:][full]])
        whose = np.concatenate([owner[len(begin) :], full])
        # an end that is the next text's start is bounded by what lies inside its own text
        at = np.searchsorted(before, stop, "right") - 1
        inner = np.concatenate([np.zeros(len(feeds), bool), np.ones(len(full), bool)])
        ends_here = inner & (before[at] == stop)
        closed = np.zeros(len(data) + 1, bool)
        closed[end] = True
        closed[feeds + 1] = True
        done = ends_here & closed[stop]
        at = at - ends_here
        left = before[at]
        k = np.where(done, 0, stop - left + starts[left])
        some = np.flatnonzero(k > 0)
        if len(some):
            spaces, which = np.unique(k[some], return_inverse=True)
            np.add.at(out, whose[some], self._part(spaces, [""] * len(spaces))[which])

    def _add(self, out, owner, spaces, hashes, data, begin, end) -> None:
        keys, first, which = np.unique(X.mix(hashes + spaces.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        n = np.zeros(len(keys), np.int64)
        n[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            rows = first[new]
            texts = [data[a:b].tobytes().decode() for a, b in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)]
            n[new] = self._part(spaces[rows], texts)
            if len(self.keys) > REMEMBERED:
                self._forget()
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.counts = np.insert(self.keys, where, keys[new]), np.insert(self.counts, where, n[new])
        np.add.at(out, owner, n[which])


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_counters: dict[str, Counter] = {}
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def worker_counter(path: str) -> Counter:
    """One counter for each worker process: what it remembers serves all its tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _counts(path: str | None, limit: int):
    def run(batches):
        counter = worker_counter(path or model_path())
        for batch in batches:
            for part in X.slices(batch):
                n_bytes = np.diff(X.buffers(part.column("text"))[1])
                tokens = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], schema=_SCHEMA)

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text); path: the model's file on each executor."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_counts(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
