"""Byte-level BPE of whole texts: content-defined chunks are encoded once and joined exactly."""

import base64
import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from shelfmark.llm.common import texts

#: A cut is where the rolling hash of the last 16 characters has ten zero bits, at least MIN_CHUNK characters after the last.
WINDOW = 16
CUT_BITS = 10
MIN_CHUNK = 128
MAX_CHUNK = 4096
#: Characters of chunks that a task remembers with their tokens; those unused longest go first.
REMEMBERED = 8_000_000

#: Runs of white space from this length on are cut by hand: the regular expression beneath runs out of stack on a million.
LONG_SPACE = 100_000

_ROLL = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
#: Between these two characters a new piece always begins, whatever surrounds them: every alternative of the
#: splitting pattern takes white space at its start or takes nothing else.
_SAFE = regex.compile(r"\S(?=\s)")
_LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(text: str) -> list[int]:
    """Where a text is cut, its end included; a cut depends only on the characters before it since the last few cuts."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n]
    value = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    factor, width = _ROLL, 1
    while width < WINDOW:
        value = value[:-width] * factor + value[width:]
        factor = np.uint32(int(factor) * int(factor) & 0xFFFFFFFF)
        width *= 2
    marks = np.flatnonzero((value * _SPREAD) >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    found, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > MAX_CHUNK:
            last += MAX_CHUNK
            found.append(last)
        if mark - last >= MIN_CHUNK or mark == n:
            if mark > last:
                found.append(mark)
            last = mark
    return found


class ChunkEncoder:
    """Encodes texts as the tokenizers library does with the given vocabulary file.

    ``special`` strings of the file become their ids wherever they occur; the text
    between them is cut into chunks by content. The tokens of a chunk's inside, from its
    first to its last safe place, are computed once and remembered, so passages that many
    documents share cost once per task. A join is mended by encoding the text from the left
    side's last safe place to the right side's first one; it grows over chunks without a safe
    place until both sides agree. A place is safe if a non-space precedes a space: there,
    encoding left and right apart equals encoding both together.
    """

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ranks_file = Path(path).with_suffix(".tiktoken")
        lines = (line.split() for line in ranks_file.read_bytes().splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.coder = tiktoken.Encoding(
            "chunks",
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=ranks,
            special_tokens=self.special,
        )
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: OrderedDict[str, list] = OrderedDict()
        self.held = 0
        self.encoded = 0

    def _chunk(self, chunk: str) -> tuple[int, int, list[int]]:
        """The first and the last safe place of a chunk and the tokens between them; (-1, -1, []) without one."""
        known = self.memory.get(chunk)
        if known is not None:
            self.memory.move_to_end(chunk)
            return known
        self.encoded += 1
        first = _SAFE.search(chunk)
        if first is None:
            known = (-1, -1, [])
        else:
            begin, end = first.end(), _last_safe(chunk)
            known = (begin, end, self.coder.encode_ordinary(chunk[begin:end]))
        self.memory[chunk] = known
        self.held += len(chunk)
        while self.held > REMEMBERED and len(self.memory) > 1:
            self.held -= len(self.memory.popitem(last=False)[0])
        return known

    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        join, start = "", 0  # join: text since the last safe place
        for stop in cuts(text):
            chunk, start = text[start:stop], stop
            begin, end, tokens = self._chunk(chunk)
            if begin < 0:
                join += chunk
                continue
            ids += self._pieces(join + chunk[:begin])
            ids += tokens
            join = chunk[end:]
        return ids + self._pieces(join)

    def _pieces(self, text: str) -> list[int]:
        """Tokens of a text, found by the pattern's pieces.

        A long run of white space is one piece but for its last character, which may begin the
        next piece; at the end of the text it is one piece as a whole. A piece is merged without the pattern.
        """
        if len(text) < LONG_SPACE:
            return self.coder.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.coder.encode_ordinary(text[at : run.start()])
            ids += self.coder._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.coder.encode_ordinary(text[at:])

    def encode(self, text: str) -> list[int]:
        if self.split is None:
            return self._plain(text)
        ids: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._plain(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text, special tokens kept; bytes that are no UTF-8 become replacement characters."""
        return self.coder.decode(ids, errors="replace")


def _last_safe(chunk: str) -> int:
    """The last place after a non-space and before a space; there is one."""
    step = 64
    while True:
        from_ = max(0, len(chunk) - step)
        found = [m.end() for m in _SAFE.finditer(chunk, from_)]
        if found:
            return found[-1]
        step *= 4


def _mapper(path: str, emit: Callable[[ChunkEncoder, list], list[pa.Array]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or ChunkEncoder(path)
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *emit(coder, part.column(1).to_pylist())], names)

    return run


def _ids(coder: ChunkEncoder, values: list) -> list[pa.Array]:
    return [pa.array([coder.encode(v) for v in values], pa.list_(pa.int32()))]


def _decoded(coder: ChunkEncoder, values: list) -> list[pa.Array]:
    return [pa.array([coder.decode(v or []) for v in values], pa.string())]


def _digests(coder: ChunkEncoder, values: list) -> list[pa.Array]:
    counts, ids_sha, text_sha = [], [], []
    for value in values:
        ids = coder.encode(value)
        counts.append(len(ids))
        ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        text_sha.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "replace")).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every whole text; empty for an empty or null text. Rows stay where they are."""
    run = _mapper(path or default_path(), _ids, ["doc_id", "ids"])
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    run = _mapper(path or default_path(), _decoded, ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode, without a row leaving its task.

    One row per input row, repeated rows and rows without doc_id included. A null text
    counts as empty: no tokens, digests of the empty string.
    """
    run = _mapper(path or default_path(), _digests, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
