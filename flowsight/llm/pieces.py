"""Merge-type sentencepiece vocabularies: encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

A text starts as its characters. Every adjacent pair whose concatenation is a piece waits in an agenda, best score first
and leftmost first among equals; the best pair is merged, and the pairs that the merged symbol forms with its neighbours
join the agenda. Pairs whose symbols have changed meanwhile are skipped when they come up. What is left are the pieces;
characters without one become their UTF-8 bytes.

No piece of the usual vocabularies has a space mark behind another character, or letters next to other characters, so no
merge crosses from one such segment to the next. Texts are then cut there, and each different segment goes through the
agenda once while it is remembered. All pieces are examined for that: a vocabulary in which some piece would be cut is
encoded by words, or whole text by whole text.

The work is one Arrow pass without a shuffle. Each batch can be checked against the sentencepiece library, ids and decoded
text (``check=True``): the column ``agrees`` says for every document whether both are the same.

Null and empty texts give begin and end id and an empty decoded text. Very long texts are encoded whole; a segment takes
memory and n log n time in its own length only. Repeated rows, repeated or null ids: every row is encoded on its own. An
empty table gives an empty table. All input columns are kept, except that ``ids``, ``decoded`` and ``agrees`` replace
columns of these names.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

SPACE = "▁"
BATCH_BYTES = 4 << 20  # texts encoded at a time
MEMORY_CHARS = 8_000_000  # characters of remembered segments, about 200 MB; then they are forgotten and learned anew
LONG_SEGMENT = 64  # longer ones are hardly repeated and not remembered

# Kinds of pieces in the model file, as its format defines them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_MODEL = 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message, which is what the model file is."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, message[at : at + size]
        at += size


def _cuts() -> list[re.Pattern]:
    """Ways to cut a marked text into segments, finest first: space marks go with what follows them."""
    letters = "A-Za-zÀ-ÖØ-öø-ɏ"
    words = f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}]+|{SPACE}+"
    return [re.compile(words), re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), re.compile("(?s).+")]


class Vocabulary:
    """Pieces, scores and settings of one model file."""

    def __init__(self, model: bytes):
        parts = [(n, dict(_fields(v)) if n != 1 else v) for n, v in _fields(model)]
        entries = [dict(_fields(v)) for n, v in parts if n == 1]
        trainer = next((v for n, v in parts if n == 2), {})
        normalizer = next((v for n, v in parts if n == 3), {})
        if trainer.get(3, 1) != MERGE_MODEL:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only vocabularies that keep texts and their spaces as they are")
        kinds = [e.get(3, NORMAL) for e in entries]
        if USER_DEFINED in kinds or UNUSED in kinds or not trainer.get(35, 0):
            raise ValueError("only vocabularies with byte pieces and without user-defined or unused ones")
        names = [e[1].decode() for e in entries]
        self.prefix = bool(normalizer.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {p: i for i, (p, k) in enumerate(zip(names, kinds)) if k == NORMAL}
        score = {p: struct.unpack("<f", entries[i].get(2, bytes(4)))[0] for p, i in self.ids.items()}
        places = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.place = {p: places[x] for p, x in score.items()}
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(names, kinds)) if k == BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.control, self.unknown = ({i for i, k in enumerate(kinds) if k == kind} for kind in (CONTROL, UNKNOWN))
        shown = {NORMAL: lambda p: p.replace(SPACE, " "), UNKNOWN: lambda p: " ⁇ "}
        self.surface = [shown.get(k, lambda p: "")(p) for p, k in zip(names, kinds)]
        self.segments = next(cut for cut in _cuts() if not any(len(cut.findall(p)) > 1 for p in self.ids))

    def marked(self, text: str) -> str:
        """The text with space marks, one of them before it."""
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def merge(self, segment: str) -> list[int]:
        """Piece ids of one segment, by the agenda. An entry is the place of its score, then that of its left symbol."""
        if len(segment) <= LONG_SEGMENT:
            return self.merge_short(segment)
        place, symbols = self.place.get, list(segment)
        count = len(symbols)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        agenda = [p << 32 | i for i, pair in enumerate(map(str.__add__, segment, segment[1:])) if (p := place(pair)) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= count or not symbols[left]:
                continue
            pair = symbols[left] + symbols[right]
            if place(pair) != entry >> 32:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = pair, ""
            right = after[left] = after[right]
            if right < count:
                before[right] = left
                if (p := place(pair + symbols[right])) is not None:
                    heapq.heappush(agenda, p << 32 | left)
            earlier = before[left]
            if earlier >= 0 and (p := place(symbols[earlier] + pair)) is not None:
                heapq.heappush(agenda, p << 32 | earlier)
        return self.numbers(filter(None, symbols))

    def merge_short(self, segment: str) -> list[int]:
        """The same with the agenda as a list in order of place, one entry for each pair: quicker where there are few."""
        place, never, symbols = self.place.get, len(self.place), list(segment)
        agenda = [place(pair, never) for pair in map(str.__add__, segment, segment[1:])]
        while agenda and (best := min(agenda)) < never:
            left = agenda.index(best)
            del agenda[left]
            pair = symbols[left] = symbols[left] + symbols.pop(left + 1)
            if left:
                agenda[left - 1] = place(symbols[left - 1] + pair, never)
            if left < len(agenda):
                agenda[left] = place(pair + symbols[left + 1], never)
        return self.numbers(symbols)

    def numbers(self, symbols: Iterable[str]) -> list[int]:
        """Ids of merged symbols; a character that is no piece gives its bytes."""
        found: list[int] = []
        for symbol in symbols:
            if symbol in self.ids:
                found.append(self.ids[symbol])
            else:
                found += [self.byte[b] for b in symbol.encode()]
        return found

    def decode(self, ids: Iterable[int], opens: bool = True) -> str:
        """Text of any ids: control pieces vanish, byte pieces that are no UTF-8 give replacement characters.

        Where the ids open a text, the space that encoding has put before it vanishes too.
        """
        shown: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _is_character(run[at : at + n])), 0)
                shown.append(run[at : at + size].decode() if size else "�")
                at += size or 1
            run.clear()

        first = opens
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                first = False
                continue
            if run:
                flush()
            text = self.surface[i]
            if first and self.prefix and text[:1] == " " and i not in self.unknown:
                text = text[1:]
            first = first and i in self.control
            shown.append(text)
        flush()
        return "".join(shown)


def _is_character(part: bytes) -> bool:
    try:
        return len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


class _Segments(dict):
    """Segment -> (its ids as little-endian 32-bit numbers, their decoded text), filled on demand."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.chars = vocabulary, 0

    def __missing__(self, segment: str) -> tuple[bytes, str]:
        ids = self.vocabulary.merge(segment)
        made = struct.pack(f"<{len(ids)}I", *ids), self.vocabulary.decode(ids, opens=False)
        if len(segment) <= LONG_SEGMENT:
            if self.chars > MEMORY_CHARS:
                self.clear()
                self.chars = 0
            self.chars += len(segment)
            self[segment] = made
        return made


@cache
def _segments(model: bytes) -> _Segments:
    return _Segments(Vocabulary(model))


@cache
def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _encoded(texts: list[str], segments: _Segments) -> tuple[list[bytes], list[str]]:
    vocabulary = segments.vocabulary
    begin, end = struct.pack("<I", vocabulary.begin), struct.pack("<I", vocabulary.end)
    ids, decoded = [], []
    for text in texts:
        parts = [segments[s] for s in vocabulary.segments.findall(vocabulary.marked(text))]
        ids.append(begin + b"".join([p[0] for p in parts]) + end)
        shown = "".join([p[1] for p in parts])
        decoded.append(shown[1:] if vocabulary.prefix and shown[:1] == " " else shown)
    return ids, decoded


def _agreement(texts: list[str], ids: list[bytes], decoded: list[str], model: bytes) -> list[bool]:
    library = _library(model)
    theirs = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    texts_back = library.decode(theirs, num_threads=1) if theirs else []
    same = [a == array("I", b).tobytes() for a, b in zip(ids, theirs)]
    return [s and a == b for s, a, b in zip(same, decoded, texts_back)]


def by_bytes(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``most`` bytes; a single row is never cut."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_batches(
    batches: Iterable[pa.RecordBatch], model: bytes, check: bool, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[str], list[bool] | None]]:
    """(rows, ids as little-endian 32-bit numbers, decoded texts, agreement with the library) for slices of the batches."""
    for rows in by_bytes(batches, BATCH_BYTES):
        texts = [t or "" for t in rows.column(text).to_pylist()]
        ids, decoded = _encoded(texts, _segments(model))
        yield rows, ids, decoded, _agreement(texts, ids, decoded, model) if check else None


def encode_documents(docs: DataFrame, model_path: str, check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (begin and end id included), ``decoded`` and, if asked for, ``agrees``."""
    model = Path(model_path).read_bytes()
    own = ["ids", "decoded", *["agrees"] * check]
    kept = docs.drop(*own)
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema]
    schema = ", ".join([*fields, "ids array<int>", "decoded string", *["agrees boolean"] * check])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, decoded, agrees in encode_batches(batches, model, check):
            starts = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=starts[1:])
            numbers = pa.array(np.frombuffer(b"".join(ids), np.int32))
            columns = [*rows.columns, pa.ListArray.from_arrays(pa.array(starts), numbers), pa.array(decoded, pa.string())]
            columns += [pa.array(agrees, pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, *own])

    return map_arrow(kept, run, schema)


REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


def token_report(docs: DataFrame, model_path: str) -> DataFrame:
    """Digest of each document's ids and decoded text, and whether the library gives the same."""
    from hashlib import sha256

    model = Path(model_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, decoded, agrees in encode_batches(batches, model, True):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array(agrees, pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
            )

    return map_arrow(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text"), run, REPORT)
