"""Token ids of whole texts by a vocabulary file of the tokenizers library.

The vocabulary drops white space before it merges, so ids of a text are those of its
pieces between spaces, one after another, and ids of a word of Latin letters with marks
behind it are the word's and the marks'. Pieces repeat, so each worker keeps the ids of
those it has met, up to a bounded number, and asks the library for the rest.
Texts are cut, and their ids put together, by Arrow, BLOCK bytes of texts at a time, and
pieces told apart and looked up RUN bytes at a time; Python sees those that are new only.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import text_bytes

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Pieces kept by a worker: beyond so many, those of the last run only; a piece of over LONG characters is not kept.
KEPT, LONG = 800_000, 64
#: Marks of which a run is a word of its own after letters, and a control character that parts pieces sent to the library together.
MARKS, APART = string.punctuation, "\x01"
_WORD = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"  #: Latin letters only: one word to the vocabulary
RUN, BLOCK = 1 << 24, 1 << 21  #: bytes of texts whose pieces are looked up, and whose ids are put together, at a time; a single text is never divided
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] = _CLEAN[97:123]  # A-Z become a-z
_CLEAN[10] = 32  # and a line's end a space
#: Words of Latin letters in lower case pass this normaliser, and those of ASCII this pre-tokeniser, as they are.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cleaned(column: pa.Array) -> pa.Array:
    """The texts with spaces for line ends, null ones empty, and in lower case, as the vocabulary has it, where all is Latin-1.

    Beyond Latin-1 lower case is left to the library, and where it could make a special token.
    """
    data, offsets = text_bytes(column)
    clean = _CLEAN[data]
    if len(data):
        # Latin-1 letters are two bytes, the first 0xC3 for those that have a case; what is beyond begins with 0xC4 or more.
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        upper = after[(data[after] < 0x9F) & (data[after] != 0x97)]
        clean[upper] += 0x20
        beyond = np.flatnonzero(data >= 0xC4)
        as_is = set((np.searchsorted(offsets, beyond, "right") - 1).tolist()) if len(beyond) else set()
        as_is.update(np.flatnonzero(pc.match_substring(column, "<|").fill_null(False).to_numpy(zero_copy_only=False)).tolist())
        for row in as_is:
            a, b = offsets[row], offsets[row + 1]
            part = data[a:b]
            clean[a:b] = np.where(part == 10, np.uint8(32), part)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(clean))


def _is_word(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether pieces are Latin letters only, and whether they are of ASCII besides."""
    plain = pc.ascii_is_alpha(pieces).to_numpy(zero_copy_only=False)
    word, rest = plain.copy(), np.flatnonzero(~plain)
    word[rest] = pc.match_substring_regex(pieces.take(pa.array(rest)), _WORD).to_numpy(zero_copy_only=False)
    return word, plain


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _parted(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces with marks behind a word of Latin letters as pieces of their own, and where each one's parts start and the last's end."""
    stems = pc.ascii_rtrim(pieces, MARKS)
    offsets = _offsets(pieces)
    cuts = offsets[:-1] + np.diff(_offsets(stems))
    cuts = cuts[(cuts < offsets[1:]) & _is_word(stems)[0]]
    parts = np.sort(np.concatenate((offsets, cuts)), kind="stable")
    column = pa.LargeStringArray.from_buffers(len(parts) - 1, pa.py_buffer(parts), pieces.buffers()[2])
    return column, np.arange(len(offsets)) + np.searchsorted(cuts, offsets)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def gathered(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about RUN bytes of texts, those of ``column``, so that more of their pieces are looked up together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        # A row counts for 256 bytes at least, so that rows with little or no text are not held without a bound.
        size += max(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0, len(batch) << 8)
        if size >= RUN:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _runs(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """The rows in runs of ``most`` bytes at most, or of one row."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, to - at)
        at = to


class Encoder:
    """Little-endian unsigned 16- or 32-bit ids of texts; one a worker and vocabulary file.

    ``splits`` says that the vocabulary's ids of a text are those of its pieces between white space;
    with another vocabulary each text goes to the library whole.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, splits: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = splits
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if hasattr(self.tokenizer.model, "_resize_cache"):  # the library's own cache only costs time beside ours
            self.tokenizer.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        #: The pieces kept, and of each where its ids start among those stored and (in the lower 32 bits) how many there are.
        self.kept, self.codes = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.stored, self.used = np.empty(1 << 16, self.type), 0
        self.apart: np.ndarray | None = None
        #: For words in lower case, of Latin-1 and of ASCII: the same model without the steps that leave them as they are.
        self.latin = self.ascii = self.tokenizer
        steps = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        if steps == [_NORMALIZER, _PRE_TOKENIZER]:
            self.latin, self.ascii = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.latin.pre_tokenizer = self.tokenizer.pre_tokenizer
            self.ascii.pre_tokenizer = WhitespaceSplit()

    @classmethod
    def of(cls, path: str, splits: bool = True) -> Encoder:
        if (path, splits) not in cls._made:
            cls._made[path, splits] = cls(path, splits)
        return cls._made[path, splits]

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one whole text, without an end id."""
        return next(iter(self.ended([text])))[:-1]

    def _run(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids and the end id of each text. What is unknown in any of them goes to the library together."""
        lists = [pc.split_pattern(_cleaned(part), " ") for part in _runs(column, BLOCK)]
        found = pa.chunked_array([x.flatten() for x in lists], pa.large_string()).dictionary_encode()
        parts, firsts = _parted(found.chunk(0).dictionary)
        parts = parts.dictionary_encode()
        raw = self._known(parts.dictionary).take(parts.indices)
        # The last of the different pieces is the end id, which follows each text's own.
        size, end = len(firsts) - 1, np.array([END_ID], self.type).tobytes()
        ends = np.append(_offsets(raw)[firsts], _offsets(raw)[-1] + len(end))
        data = np.append(np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: ends[-2]], np.frombuffer(end, np.uint8))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), size + 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        for chunk, texts in zip(found.chunks, lists):
            stops = np.asarray(texts.offsets)[1:].astype(np.int64) - texts.offsets[0].as_py()
            ids = raw.take(pa.array(np.insert(chunk.indices.to_numpy(), stops, size)))
            places = _offsets(ids)[stops + np.arange(1, len(stops) + 1)] // len(end)
            ids, at = np.frombuffer(ids.buffers()[2], self.type), 0
            for to in places.tolist():
                yield ids[at:to]
                at = to

    def _known(self, column: pa.Array) -> pa.Array:
        """The ids of different pieces."""
        codes = np.full(len(column), -1)
        if len(column) < len(self.kept):  # the smaller side is hashed
            at = pc.index_in(self.kept, value_set=column).fill_null(-1).to_numpy()
            here = np.flatnonzero(at >= 0)
            codes[at[here]] = self.codes[here]
        else:
            at = pc.index_in(column, value_set=self.kept).fill_null(-1).to_numpy()
            codes = np.append(self.codes, -1)[at]
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            codes[unknown] = self._learn(column.take(pa.array(unknown)))
        sizes = codes & 0xFFFFFFFF
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.stored[_places(codes >> 32, sizes)]
        if len(self.kept) > KEPT:
            short = np.flatnonzero(pc.utf8_length(column).to_numpy() <= LONG)[:KEPT]
            self.kept, self.codes = column.take(pa.array(short)), ends[short] << 32 | sizes[short]
            self.stored, self.used = data, len(data)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends * self.type.itemsize), pa.py_buffer(data)])

    def _store(self, ids: np.ndarray) -> int:
        """Put ids behind those stored, and say where."""
        at, to = self.used, self.used + len(ids)
        if to > len(self.stored):
            self.stored = np.concatenate((self.stored[:at], np.empty(max(to, len(self.stored)), self.type)))
        self.stored[at:to] = ids
        self.used = to
        return at

    def _learn(self, column: pa.Array) -> np.ndarray:
        """Make pieces known, each named once, and say where their ids are; those too long or too many to keep are stored until the next call."""
        codes = np.zeros(len(column), np.int64)
        word, plain = _is_word(column)
        keep = pc.utf8_length(column).to_numpy() <= LONG
        keep[np.flatnonzero(keep)[KEPT:]] = False
        for here in (np.flatnonzero(keep), np.flatnonzero(~keep)):
            end = self.used
            pieces = column.take(pa.array(here))
            codes[here] = self._fill(pieces.to_numpy(zero_copy_only=False).tolist(), word[here], plain[here])
            if len(here) and keep[here[0]]:
                end = self.used
                self.kept = pa.concat_arrays([self.kept, pieces])
                self.codes = np.append(self.codes, codes[here])
        self.used = end
        return codes

    def _fill(self, pieces: list[str], word: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Ask the library for pieces, many in one text, and say where their ids are stored.

        A piece of Latin letters (``plain``: of ASCII) is one word to the vocabulary, and a word's last id says that it ends a word.
        Others have a control character between them, and those that hold it are asked for one by one.
        """
        if self.apart is None:
            self.apart = self._ask([APART])[0]
        mark = np.zeros(len(self.ends_word), dtype=bool)
        mark[self.apart[-1:]] = len(self.apart) == 1
        others = np.flatnonzero(~word).tolist()
        alone, others = [k for k in others if APART in pieces[k]], [k for k in others if APART not in pieces[k]]
        codes = np.zeros(len(pieces), np.int64)
        groups = ((plain, " ", self.ends_word, self.ascii), (word & ~plain, " ", self.ends_word, self.latin))
        for group, between, ends, tokenizer in (*((np.flatnonzero(g).tolist(), *rest) for g, *rest in groups), (others, f" {APART} ", mark, None)):
            skip = 0 if tokenizer else 1
            for at in range(0, len(group), 300):
                part = group[at : at + 300]
                text = between.join([pieces[k] for k in part])
                ids = self._ask([text.lower()], tokenizer)[0] if tokenizer else self._ask([text])[0]
                stops = np.flatnonzero(ends[ids]) + 1 - skip
                if skip:
                    stops = np.append(stops, len(ids))
                if len(stops) != len(part):
                    alone += part
                    continue
                starts = np.concatenate(([0], stops[:-1] + skip))
                codes[part] = self._store(ids) + starts << 32 | stops - starts
        for k, ids in zip(alone, self._ask([pieces[k] for k in alone]) if alone else []):
            codes[k] = self._store(ids) << 32 | len(ids)
        return codes

    def _ask(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def ended(self, texts: pa.Array | Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text and the end id."""
        if not self.splits:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else list(texts)
            for ids in self._ask([t or "" for t in texts]):
                yield np.append(ids, np.array(END_ID, self.type))
            return
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string())
        for part in _runs(column, RUN):
            yield from self._run(part)
