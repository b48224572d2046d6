"""SentencePiece encoding that keeps the place of every piece in the original bytes, and decoding.

A text is normalised by the longest prefixes of the model's compiled character map, which also
records for every normalised character where its source starts. The pair merges of the model then
run on each run of blanks with the word behind it: no piece of such a vocabulary holds a blank
behind another character, so no merge crosses that border. A piece's bytes are those between the
sources of its first character and of the first one behind it.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.llm.common import slices, text_of
from vulnspark.operators.arrow import list_array

BLANK, REPLACEMENT, UNKNOWN = "▁", "�", " ⁇ "
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6
PAIR_MERGES = 2
#: Words up to these lengths are merged together in arrays; longer ones go through a heap.
WIDTHS = (6, 9, 12, 16, 24, 48)
#: Places of the arrays in which words are merged together.
CELLS = 150_000
#: Remembered words and their ids, of a process, forgotten together once a batch begins with more.
REMEMBERED, REMEMBERED_IDS = 300_000, 3_000_000
NEVER = 1 << 30
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialized protocol buffer message."""
    at, view = 0, memoryview(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = view[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(view):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, bytes(view[at : at + size])
        at += size


class CharacterMap:
    """The compiled map: a double array over the bytes of the sources, and the texts they become.

    Layout: size of the array in bytes, its 32-bit units, then the texts, each ended by a zero byte.
    A unit holds the byte that leads to it (bits 0-7), whether a source ends here (bit 8), and the
    distance to its children (from bit 10, shifted by 8 more if bit 9 is set); a value unit has bit
    31 and the place of the text.
    """

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4) if size else ()
        self.texts = data[4 + size :]
        self.starts = re.compile(f"[{re.escape(''.join(self._first_characters()))}]") if size else None

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The unit that `byte` leads to from the children at `node`."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def _first_characters(self) -> list[str]:
        found, open_ = [], [(self._children(self.units[0]), b"")]
        while open_:
            node, read = open_.pop()
            for byte in range(1, 256):
                at = self._step(node, byte)
                if at is None:
                    continue
                more = read + bytes([byte])
                try:
                    found.append(more.decode())
                except UnicodeDecodeError:
                    open_.append((at ^ self._children(self.units[at]), more))
        return found

    def longest(self, text: str, at: int) -> tuple[str, int] | None:
        """What the longest source at this place becomes, and how many characters it takes."""
        node, best = self._children(self.units[0]), None
        for i in range(at, len(text)):
            for byte in text[i].encode():
                unit = self._step(node, byte)
                if unit is None:
                    return self._text(best)
                node = unit ^ self._children(self.units[unit])
            if self.units[unit] >> 8 & 1:
                best = self.units[node] & 0x7FFFFFFF, i + 1 - at
        return self._text(best)

    def _text(self, best: tuple[int, int] | None) -> tuple[str, int] | None:
        return best and (self.texts[best[0] : self.texts.index(b"\0", best[0])].decode(), best[1])


class Numbers(dict):
    """The number of every word, in the order of their first use."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the runs that begin at `starts`, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encoder and decoder of one model file (pair merges with byte fallback)."""

    def __init__(self, model: bytes):
        fields = list(message(model))
        trainer = dict(message(next((v for k, v in fields if k == 2), b"")))
        normalizer = dict(message(next((v for k, v in fields if k == 3), b"")))
        denormalizer = dict(message(next((v for k, v in fields if k == 5), b"")))
        pieces = [dict(message(v)) for k, v in fields if k == 1]
        self.names = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        normal = {n: i for i, n in enumerate(self.names) if self.kinds[i] == NORMAL}
        unsupported = (
            trainer.get(3, 1) != PAIR_MERGES
            or not trainer.get(35, 0)
            or trainer.get(24, 0)
            or not normalizer.get(5, 1)
            or denormalizer.get(2)
            or {*self.kinds} - {NORMAL, UNK, CONTROL, BYTE}
            or any(BLANK in n.lstrip(BLANK) for n in normal)
        )
        if unsupported:
            raise ValueError("only pair-merge models with byte fallback and no symbols of their own are supported")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.ids, self.scores = normal, {n: scores[i] for n, i in normal.items()}
        self.bytes = np.zeros(256, np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.bytes[int(self.names[i][3:5], 16)] = i
        self.value = {i: b for b, i in enumerate(self.bytes.tolist())}
        shown = {CONTROL: "", UNK: UNKNOWN}
        self.surfaces = [shown.get(k, n.replace(BLANK, " ")) for k, n in zip(self.kinds, self.names, strict=True)]
        # What ids stand for, a byte as itself.
        self.raw = pa.array(
            [bytes([self.value[i]]) if k == BYTE else t.encode() for i, (k, t) in enumerate(zip(self.kinds, self.surfaces, strict=True))],
            pa.binary(),
        )
        self._forget()
        self._index_pairs(normal)

    def _forget(self) -> None:
        """Of the remembered words: numbers, and by number the ids and how many characters each takes."""
        self.words = Numbers()
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.spans = np.empty(0, np.int32), np.empty(0, np.int32)

    def _index_pairs(self, normal: dict[str, int]) -> None:
        """Symbols (pieces, and characters that only occur inside pieces) and the pairs that merge.

        A pair's key is first symbol times `span` plus second symbol; `made` is the piece it makes."""
        symbols = dict(normal)
        for name in normal:
            for c in name:
                symbols.setdefault(c, len(self.names) + len(symbols))
        self.span = 1 + max(symbols.values(), default=0)
        pairs = [
            (symbols[name[:k]] * self.span + symbols[name[k:]], i)
            for name, i in normal.items()
            for k in range(1, len(name))
            if name[:k] in symbols and name[k:] in symbols
        ]
        pairs.append((1 << 62, 0))
        keys, self.made = (np.array(c, np.int64) for c in zip(*sorted(pairs), strict=True))
        self.pairs = keys
        better = sorted({self.scores[n] for n in normal}, reverse=True)
        place = {v: r for r, v in enumerate(better)}
        self.place = np.full(len(self.names), NEVER, np.int64)
        for n, i in normal.items():
            self.place[i] = place[self.scores[n]]
        self.place_of_pair = self.place[self.made]
        self.place_of_pair[-1] = NEVER
        # Characters by code point; those of no piece are one symbol that merges with none.
        single = {ord(c): i for c, i in symbols.items() if len(c) == 1}
        self.characters = np.array(sorted(single), np.uint32)
        self.character_ids = np.array([single[c] for c in sorted(single)], np.int64)

    # --- normalisation ---

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and the source byte of each of its characters, and of its end."""
        raw = np.frombuffer(text.encode(), np.uint8)
        source = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        if not text:
            return "", source
        new, places = self._mapped(text, source[:-1]) if self.map.starts else (text, source[:-1])
        end = len(raw)
        if self.squeeze:
            blank = np.frombuffer(new.encode("utf-32-le"), np.uint32) == 32
            kept = ~(blank & np.append(True, blank[:-1]))
            new = "".join(np.array(list(new), dtype=object)[kept]) if len(new) else ""
            places = places[kept]
            if not new:
                return "", source[-1:]
        start = places[:1] if len(places) else source[:1]
        if self.prefix:
            new, places = " " + new, np.concatenate([start if self.squeeze else source[:1], places])
        new = new.replace(" ", BLANK)
        while self.squeeze and new.endswith(BLANK):
            new, end, places = new[:-1], int(places[-1]), places[:-1]
        return new, np.append(places, end)

    def _mapped(self, text: str, source: np.ndarray) -> tuple[str, np.ndarray]:
        parts, places, done = [], [], 0
        for start in self.map.starts.finditer(text):
            at = start.start()
            if at < done or (found := self.map.longest(text, at)) is None:
                continue
            new, length = found
            parts += [text[done:at], new]
            places += [source[done:at], np.full(len(new), source[at])]
            done = at + length
        return "".join([*parts, text[done:]]), np.concatenate([*places, source[done:]])

    # --- merges ---

    def _coded(self, parts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many characters each takes."""
        ids, lengths = [], []
        for part in parts:
            at = self.ids.get(part)
            if at is not None:
                ids.append(at)
                lengths.append(len(part))
                continue
            # Merges only make pieces, so this is a single character; its last byte stands for it.
            coded = part.encode()
            ids += [self.bytes[b] for b in coded]
            lengths += [0] * (len(coded) - 1) + [1]
        return np.array(ids, np.int32), np.array(lengths, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of `new`, the words that were numbered last."""
        if not new:
            return
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(lengths, kind="stable")
        by_width = [new[i] for i in order.tolist()]
        found, start = [], 0
        for width in WIDTHS:
            stop = int(np.searchsorted(lengths[order], width, "right"))
            step = CELLS // width
            for at in range(start, stop, step):
                found.append(self._merge_short(by_width[at : min(at + step, stop)], width))
            start = stop
        for word in by_width[start:]:
            ids, spans = self._coded(self._merge_long(word))
            found.append((ids, spans, np.array([len(ids)])))
        flat, spans, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        starts = np.empty(len(new), np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        own = np.empty(len(new), np.int64)
        own[order] = sizes
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, own])
        self.flat, self.spans = np.concatenate([self.flat, flat]), np.concatenate([self.spans, spans])

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order of merges, piece made) of each pair of symbols."""
        keys = np.where((a >= 0) & (b >= 0), a * self.span + b, 1 << 62)
        at = np.searchsorted(self.pairs, keys)
        found = self.pairs[at] == keys
        return np.where(found, self.place_of_pair[at], NEVER), self.made[at]

    def _merge_short(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges in all words at once: a round takes the best pair of every word that has one.

        Ids of all words, how many characters each takes, and the number of ids of every word."""
        n = len(words)
        sizes = np.array([len(w) for w in words])
        inside = np.arange(width + 1) < sizes[:, None]
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.characters, code), len(self.characters) - 1)
        # One more place on either side, so that every symbol has neighbours.
        symbol = np.full((n, width + 2), -1, np.int64)
        symbol[:, 1:][inside] = np.where(self.characters[at] == code, self.character_ids[at], -2)
        character = np.zeros((n, width + 2), np.uint32)
        character[:, 1:][inside] = code
        length = (symbol != -1).astype(np.int32)
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        order, made = self._lookup(symbol[:, :-1], symbol[:, 1:])
        rows = np.arange(n)
        while len(rows):
            best = order[rows].argmin(axis=1)
            live = order[rows, best] < NEVER
            rows, k = rows[live], best[live]
            gone = after[rows, k]
            behind = after[rows, gone]
            symbol[rows, k] = made[rows, k]
            length[rows, k] += length[rows, gone]
            length[rows, gone], order[rows, gone] = 0, NEVER
            after[rows, k], before[rows, behind] = behind, k
            order[rows, k], made[rows, k] = self._lookup(symbol[rows, k], symbol[rows, behind])
            ahead = before[rows, k]
            order[rows, ahead], made[rows, ahead] = self._lookup(symbol[rows, ahead], symbol[rows, k])
        kept = length > 0
        ids, lengths, of_word = symbol[kept].astype(np.int32), length[kept], np.nonzero(kept)[0]
        # Merges only make pieces, so the other symbols are single characters; their last byte stands for them.
        odd = (ids < 0) | (ids >= len(self.names))
        alone = character[kept][odd]
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] += (alone >= 0x80).astype(np.int64) + (alone >= 0x800) + (alone >= 0x10000)
        of_byte = np.repeat(odd, sizes)
        coded, spans = np.repeat(ids, sizes), np.repeat(lengths, sizes)
        coded[of_byte] = self.bytes[np.frombuffer(alone.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        spans[of_byte] = 0
        spans[np.cumsum(sizes)[odd] - 1] = 1
        return coded, spans, np.bincount(of_word, sizes, n).astype(np.int64)

    def _merge_long(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        n, score = len(parts), self.scores.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (value := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-value, i, len(parts[i]), j, len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, j, b = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or len(parts[i]) != a or len(parts[j]) != b:
                continue
            parts[i], parts[j], right[i] = parts[i] + parts[j], None, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    # --- both directions ---

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every text: ids, and the first byte and the byte behind the last one of each in its UTF-8."""
        if len(self.words) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self._forget()
        known, number = len(self.sizes), self.words.__getitem__
        normal = [self.normalize(t) for t in texts]
        split = []
        for new, _ in normal:
            words = WORDS.findall(new)
            split.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn(list(islice(self.words, known, None)))
        coded = []
        for (_, places), words in zip(normal, split, strict=True):
            at = gathered(self.starts[words], self.sizes[words])
            borders = places[np.append(0, np.cumsum(self.spans[at]))].astype(np.int32)
            coded.append((self.flat[at], borders[:-1], borders[1:]))
        return coded

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, bytes that form no character become U+FFFD each,
        and the blank before the first piece goes if the model puts one there."""
        if not len(ids):
            return ""
        # The taken texts lie one behind the other in Arrow's buffer.
        _, ends, data = self.raw.take(pa.array(ids).cast(pa.int64())).buffers()
        size = int(np.frombuffer(ends, np.int32)[len(ids)])
        try:
            text = data[:size].to_pybytes().decode() if size else ""
        except UnicodeDecodeError:
            text = "".join(self._with_bytes(ids.tolist()))
        return text[self._leading(ids) :]

    def _leading(self, ids: np.ndarray) -> int:
        """Blanks of the first pieces that are not part of the text."""
        gone = 0
        for i in map(int, ids if self.prefix or self.squeeze else ()):
            if self.kinds[i] == CONTROL:
                continue
            gone += self.kinds[i] == NORMAL and self.names[i].startswith(BLANK)
            if not self.squeeze or self.names[i] != BLANK:
                break
        return gone

    def _with_bytes(self, ids: list[int]) -> Iterator[str]:
        held = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                held.append(self.value[i])
                continue
            if held:
                yield _characters(bytes(held))
                held.clear()
            yield self.surfaces[i]
        yield _characters(bytes(held))


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in range(1, 5):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def _kept(path: str, changed: int, size: int) -> Codec:
    with open(path, "rb") as file:
        return Codec(file.read())


def _load(path: str) -> Codec:
    """The codec of a file, kept with its words for the next task of the process while the file stays as it is."""
    state = os.stat(path)
    return _kept(path, state.st_mtime_ns, state.st_size)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids, begins, ends (arrays by piece) and the decoded text.

    `model` is a path that every worker can open. begins and ends are places in the UTF-8 bytes of
    the text; a character without a piece becomes one id per byte, of which the last spans the
    character and the others are empty. Null and empty texts have no pieces. Very long texts take
    n log n steps. Null or repeated ids and repeated rows are rows of their own; other columns are
    not read; an empty table gives an empty result.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begins", "ends")),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _load(model)
        for batch in slices(batches):
            coded = codec.encode(batch.column(1).to_pylist())
            sizes = np.array([len(c[0]) for c in coded], np.int64)
            lists = [list_array(sizes, pa.array(np.concatenate(part), pa.int32())) for part in zip(*coded, strict=True)]
            decoded = pa.array([codec.decode(c[0]) for c in coded], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, decoded], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, model: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of an array of ids; null ids give null, an id outside the vocabulary is an error."""
    schema = T.StructType([*coded.schema.fields, T.StructField(into, T.StringType())])
    at = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _load(model)
        for batch in batches:
            texts = [None if (ids := x.as_py()) is None else codec.decode(np.array(ids, np.int64)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return coded.mapInArrow(run, schema)


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text."""
    return pieces.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
