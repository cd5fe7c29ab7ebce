"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import map_batches, slices, utf8

#: Words, and parts of words, whose ids a worker remembers: a bound on its memory, never on what is encoded.
WORDS = 300_000
#: Pieces shorter than a window that a task places together, and tokens of them; both bound its memory.
GROUP = 200_000
HELD = 4 << 20
#: Free tokens up to which a window stays as best-fit leaves it; fuller ones are filled by cutting the pieces of the emptiest.
ROOM = 48

# Fixed values of one kind of tokenizer file: its normalizers and the pattern of its parts, first as the file has it, then
# for small Latin letters. White space is never part of a token there, so that words can be encoded on their own.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
_LATIN = re.compile("[\x00-\x7f\xdf-\xf6\xf8-\xff]+")

_encoders: dict[str, _Encoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _bytes_of(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder != "little":
        found.byteswap()
    return found.tobytes()


class _Parts(dict):
    """Parts of words, as the tokenizer cuts them, to id bytes."""

    def __init__(self, model) -> None:
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()])
        found = _bytes_of([t.id for t in self.tokenize(letters)])
        if len(self) < WORDS and len(part) <= 64:  # frequent ones come early
            self[part] = found
        return found


class _Encoder(dict):
    """Word bytes to id bytes.

    If the file cuts at white space and into the parts of _PATTERN, a text's ids are those of its words in a row, and
    words of Latin letters are cut here and only their parts handed to the model. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kinds = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", ())]
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", ())
        patterns = [(x["type"], x.get("pattern"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in cuts]
        self.by_words = kinds == _NORMALIZERS and patterns == [("Split", {"Regex": _PATTERN}, True, None, None), ("ByteLevel", None, None, False, False)] and file["model"]["type"] == "BPE"
        self.special = {x["content"].encode()[0] for x in file.get("added_tokens", ())}
        self.encode, self.parts = tokenizer.encode, _Parts(tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        if self.special.isdisjoint(word) and (low.isascii() or _LATIN.fullmatch(low)):
            found = self.parts[low] if low.isalpha() else b"".join(map(self.parts.__getitem__, _PARTS.findall(low)))
        else:
            found = _bytes_of(self.encode(text, add_special_tokens=False).ids)
        if len(self) < WORDS and len(word) <= 64:
            self[word] = found
        return found

    def text(self, text: bytes | None) -> bytes:
        if self.by_words:
            return b"".join(map(self.__getitem__, (text or b"").split()))
        return _bytes_of(self.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids)


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = _Encoder(path)
    return _encoders[path]


class RoomTree:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities 0 to ``size`` and whose
    nodes tell whether any window below is open."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.size = size
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window of least capacity of at least ``need``: (window, capacity)."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """The window of each length (each at most ``size``) and the room left in each window."""
    tree, left, placed = RoomTree(size), [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        window, room = tree.tightest(lengths[i]) or (len(left), size)
        if window == len(left):
            left.append(0)
        placed[i], left[window] = window, room - lengths[i]
        if left[window]:
            tree.add(window, left[window])
    return placed, left


def _binary(n: int) -> Iterator[int]:
    while n:
        yield (part := 1 << (n.bit_length() - 1))
        n -= part


def arrange(pieces: list[tuple], size: int) -> Iterator[tuple[int, tuple, int, int, int]]:
    """(window, piece, from, length, offset) for pieces (.., length); every token of a piece lies in one row.

    Best-fit decreasing places all pieces whole. Of the windows that it leaves with more than ROOM tokens free, the emptiest
    give up their pieces, which are cut to fill the others to the brim; no more windows are emptied than that takes, so that
    their tokens are those that had to be cut at any rate. What is left over, under one window, is cut at powers of two.
    """
    placed, left = best_fit_decreasing([p[-1] for p in pieces], size)
    open_ = sorted((w for w in range(len(left)) if left[w] > ROOM), key=left.__getitem__)
    loose, room, filled = sum(size - left[w] for w in open_), 0, 0
    while filled < len(open_) and room + left[open_[filled]] <= loose - (size - left[open_[filled]]):
        room += left[open_[filled]]
        loose -= size - left[open_[filled]]
        filled += 1
    emptied = set(open_[filled:])
    number = {w: n for n, w in enumerate(w for w in range(len(left)) if w not in emptied)}
    at, cut = [0] * len(left), []
    for p, w in zip(pieces, placed, strict=True):
        if w in emptied:
            cut.append(p)
            continue
        yield number[w], p, 0, p[-1], at[w]
        at[w] += p[-1]
    over = [*[size] * ((loose - room) // size), *_binary((loose - room) % size)]
    rooms = chain(((number[w], size - left[w], left[w]) for w in open_[:filled]), ((len(number) + k, 0, n) for k, n in enumerate(over)))
    window = start = free = 0
    for p in cut:
        done = 0
        while done < p[-1]:
            if not free:
                window, start, free = next(rooms)
            n = min(p[-1] - done, free)
            yield window, p, done, n, start
            done, start, free = done + n, start + n, free - n


def _pack(batches, path: str, size: int, end_id: int, with_ids: bool):
    encode, base = encoder(path).text, TaskContext.get().partitionId() << 40
    end, used, waiting = end_id.to_bytes(4, "little"), 0, []
    rows: list[tuple] = []

    def row(doc, start: int, ids: bytes, total: int, sequence: int, offset: int) -> None:
        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + sequence, offset, *([ids] if with_ids else [])))

    def flush() -> pa.RecordBatch:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        found = list(zip(*rows, strict=True)) or [[]] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for x, n in zip(found, names, strict=True)], names)

    def place() -> int:
        n = 0
        for window, (doc, start, ids, total, _), done, length, at in arrange(waiting, size):
            row(doc, start + done, ids[4 * done : 4 * (done + length)], total, used + window, at)
            n = max(n, window + 1)
        waiting.clear()
        return used + n

    held = 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text) + end
            total = len(ids) // 4
            for start in range(0, total - size + 1, size):
                row(doc, start, ids[4 * start : 4 * (start + size)], total, used, 0)
                used += 1
            if rest := total % size:
                waiting.append((doc, total - rest, ids[4 * (total - rest) :], total, rest))
                held += rest
        if len(waiting) >= GROUP or held >= HELD:
            used, held = place(), 0
        if rows:
            yield flush()
    place()
    yield flush()
    _encoders.clear()  # the worker lives on for other tasks


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids
    (little-endian unsigned 32-bit numbers).

    ``tokenizer`` is the path, on the workers, of any tokenizer file. A document's ids are those of its text and
    ``end_id``; a null or empty text has just that. Documents of over ``size`` ids are first cut into full windows; what is
    left is placed best-fit decreasing within its task, so that nothing is shuffled and a lost task is done again alike. A
    task places its pieces whenever it holds GROUP of them or HELD tokens, some thousand windows: after each such group
    no window but those at a power of two has more than ROOM free tokens. A sequence is gapless from offset 0; its number
    holds the partition's number in the upper bits. Very long texts are encoded whole. Repeated rows are packed each, ties in
    length go by order of arrival, a null id stays null, an empty table gives no rows. Other columns are ignored.
    """
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return map_batches(df.select(F.col(id_col).cast("long"), utf8(text_col)), partial(_pack, path=tokenizer, size=size, end_id=end_id, with_ids=with_ids), schema)
