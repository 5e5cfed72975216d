"""Token ids of whole texts, with a memory of words already encoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ID = "<u4"
# Texts are encoded in slices of about so many bytes.
_SLICE = 4 << 20
# Pieces that are encoded in one call.
_GROUP = 256
_MARKS = ".,"
# Letters below this are Latin, and no vocabulary's pattern joins them with a mark behind.
_LATIN_END = "\u0250"
# All that Unicode or Python takes for white space.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def gathered(
    values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``values`` one behind the other, and where each begins."""
    many = sizes[at].astype(np.int32)
    upto = np.zeros(len(at) + 1, np.int32)
    np.cumsum(many, out=upto[1:])
    places = np.repeat(begins[at].astype(np.int32) - upto[:-1], many)
    places += np.arange(upto[-1], dtype=np.int32)
    return values[places], upto


class Encoder:
    """Encodes with a file of the ``tokenizers`` library.

    A byte-level vocabulary never joins what a single blank or line end separates: it cuts
    texts in front of a white space that stands between two other characters, and between a
    letter and a full stop or comma. So a slice of texts is cut there, and only its distinct
    pieces are encoded, unless their ids are remembered. The remembered pieces and their ids
    lie in flat arrays; a memory of more than ``memory`` pieces is cut down to the half that
    was seen last. Texts with any other white space are encoded as a whole, like all texts
    of other vocabularies.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, memory: int = 800_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        # Byte-level tokens are written with one character for each byte.
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)])
        self.round = 0
        self.pieces = pa.array([], pa.string())
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.plain = np.zeros(0, bool)
        self.seen = np.zeros(0, np.int64)
        self.ids = np.zeros(0, _ID)
        probe = self._cut(pa.array(["\nAb", " c1", "\nd.", " e"]))
        marks = [self._whole(f"a{mark}")[1:] for mark in _MARKS]
        self.by_pieces = probe is not None and [len(ids) for ids in marks] == [1] * len(_MARKS)
        self.marks = np.concatenate(marks)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, dtype=_ID)

    def _cut(self, written: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of pieces encoded in one go and the number of each; None if ids cross pieces."""
        ids = self._whole("".join(written.to_pylist()))
        ends = np.cumsum(pc.binary_length(written).to_numpy(zero_copy_only=False))
        reached = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(reached, ends)
        if not len(ids) or cuts[-1] != len(ids) - 1 or (reached[cuts] != ends).any():
            return None
        return ids, np.diff(cuts, prepend=-1)

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, the number of each, and whether they may be used."""
        line = pc.starts_with(pieces, "\n")
        words = pc.if_else(line, pc.utf8_slice_codeunits(pieces, 1), pieces)
        spaced = pc.or_(pc.match_substring_regex(words, _SPACE), pc.equal(words, ""))
        plain = ~spaced.to_numpy(zero_copy_only=False)
        # What begins with no line end had a blank in front of it.
        written = pc.binary_join_element_wise(pc.if_else(line, "\n", " "), words, "")
        sizes = np.zeros(len(pieces), np.int64)
        chosen = np.flatnonzero(plain)
        groups = [chosen[at : at + _GROUP] for at in range(0, len(chosen), _GROUP)][::-1]
        ids = [np.zeros(0, _ID)]
        while groups:
            group = groups.pop()
            found = self._cut(written.take(pa.array(group)))
            if found is not None:
                ids.append(found[0])
                sizes[group] = found[1]
            elif len(group) > 1:
                groups += [group[len(group) // 2 :], group[: len(group) // 2]]
            else:
                plain[group] = False
        return np.concatenate(ids), sizes, plain

    def _forget(self) -> None:
        """Keep the half of the memory that was seen last."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: self.memory // 2])
        self.ids, upto = gathered(self.ids, self.begins, self.sizes, kept)
        self.begins, self.sizes = upto[:-1].astype(np.int64), self.sizes[kept]
        self.plain, self.seen = self.plain[kept], self.seen[kept]
        self.pieces = self.pieces.take(pa.array(kept))

    def _remember(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of the distinct ``pieces`` among those remembered."""
        self.round += 1
        if len(self.pieces) + len(pieces) > self.memory:
            self._forget()
        found = pc.index_in(pieces, value_set=self.pieces)
        missing = pieces.filter(found.is_null())
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            ids, sizes, plain = self._new(missing)
            place[place < 0] = len(self.pieces) + np.arange(len(missing))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.plain = np.concatenate([self.plain, plain])
            self.seen = np.concatenate([self.seen, np.zeros(len(missing), np.int64)])
            self.ids = np.concatenate([self.ids, ids])
            self.pieces = pa.concat_arrays([self.pieces, missing])
        self.seen[place] = self.round
        return place

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text. A line end is set in front, so that a first word is like others."""
        blank = pc.replace_substring(texts, "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", blank, ""), " ")
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        written = coded.dictionary
        core = pc.utf8_slice_codeunits(written, 0, -1)
        mark = pc.index_in(pc.utf8_slice_codeunits(written, -1, 1 << 30), value_set=pa.array(list(_MARKS)))
        before = pc.utf8_slice_codeunits(core, -1, 1 << 30)
        cut = pc.and_(pc.utf8_is_alpha(before), pc.less(before, _LATIN_END))
        cut = pc.and_(pc.is_valid(mark), cut)
        words = pc.if_else(cut, core, written).dictionary_encode()
        place = self._remember(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        # The ids of every distinct piece with its mark, then those of all pieces in order.
        cut = cut.to_numpy(zero_copy_only=False)
        behind = len(self.ids) + mark.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.stack([self.begins[place], behind], axis=1).ravel()
        sizes = np.stack([self.sizes[place], cut.astype(np.int64)], axis=1).ravel()
        ids, upto = gathered(np.concatenate([self.ids, self.marks]), begins, sizes, np.arange(len(sizes)))
        starts = upto[::2]
        ids, upto = gathered(ids, starts[:-1], np.diff(starts), at)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(counts)])
        other = np.concatenate([[0], np.cumsum(~self.plain[place][at])])[edges]
        upto = upto[edges].tolist()
        for n, spaced in enumerate((other[1:] > other[:-1]).tolist()):
            # The first id is that of the line end set in front.
            yield self._whole(texts[n].as_py()) if spaced else ids[upto[n] + 1 : upto[n + 1]]

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text (unsigned 32-bit), then ``end_id``; null is empty."""
        end = np.array([end_id], dtype=_ID)
        texts = texts.cast(pa.string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        reached = np.cumsum(sizes)
        first = 0
        while first < len(texts):
            before = int(reached[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(reached, before + _SLICE, "right")))
            part = texts.slice(first, last - first)
            found = self._slice(part) if self.by_pieces else map(self._whole, part.to_pylist())
            for ids in found:
                yield np.concatenate([ids, end])
            first = last
            # Workers live on after a task; what a slice took goes back at once.
            pa.default_memory_pool().release_unused()

    def encode(self, text: str, end_id: int) -> np.ndarray:
        """The ids of ``text`` (unsigned 32-bit), then ``end_id``."""
        return next(self.encode_all(pa.array([text], pa.string()), end_id))
