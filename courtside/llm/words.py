"""Token ids of many texts at once, for vocabularies that know no white space and no case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from courtside.llm.tokens import gathered

_ID = "<u4"
# Texts are encoded in slices of about so many bytes; a longer text is cut at white space.
_SLICE = 8 << 20
# A token of the vocabulary that ends a word ends in this.
_WORD_END = "</w>"
_BLANKS = " \n\t\r"
_MARKS = ".,"


class WordEncoder:
    """Encodes with a file of the ``tokenizers`` library that drops white space and case.

    Such a vocabulary never joins what white space separates, and a letter never joins the
    full stop or comma behind it. So a slice of texts is lower-cased (A-Z) and cut into
    words, and only its distinct words are encoded, unless their ids are remembered. Their ids
    lie in one flat array, and a memory of more than ``memory`` words is cut down
    to those of the last slice. Texts with ``<|`` may hold a special token, whose case
    counts: these are encoded as they are, like all texts of a vocabulary that keeps white
    space or case.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str, memory: int = 400_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        self.places: dict[str, int] = {}
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, _ID)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(_WORD_END)
        apart = [self._whole(word) for word in ("abc", "de", ".", "f", ",")]
        together = self._whole(" Abc\tdE. \nf,")
        self.by_words = together.tolist() == [i for ids in apart for i in ids.tolist()]

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder per worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _lists(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=_ID) for e in found]

    def _whole(self, text: str) -> np.ndarray:
        return self._lists([text])[0]

    def _new_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Encode words: the words in another order, all their ids, and the ids of each.

        Words of letters only are encoded a few hundred in one call and told apart by the
        tokens that end words.
        """
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        groups = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        done: list[str] = []
        ids, sizes = [], []
        for group, found in zip(groups, self._lists([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(found):
                done += group
                ids.append(found)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                # Some letter of these words becomes something else in lower case.
                other += group
        for at in range(0, len(other), 4096):
            found = self._lists(other[at : at + 4096])
            done += other[at : at + 4096]
            ids += found
            sizes.append(np.array(list(map(len, found)), dtype=np.int64))
        return done, np.concatenate(ids), np.concatenate(sizes)

    def _remember(self, words: list[str]) -> np.ndarray:
        """The place of each of the distinct ``words`` among those remembered."""
        found = list(map(self.places.get, words))
        missing = [w for w, at in zip(words, found, strict=True) if at is None]
        if not missing:
            return np.array(found, dtype=np.int64)
        if len(self.places) + len(missing) > self.memory:
            known = [w for w, at in zip(words, found, strict=True) if at is not None]
            kept = np.array([at for at in found if at is not None], dtype=np.int64)
            self.ids, upto = gathered(self.ids, self.begins, self.sizes, kept)
            self.begins, self.sizes = upto[:-1].astype(np.int64), self.sizes[kept]
            self.places = dict(zip(known, range(len(known)), strict=True))
        new, ids, sizes = self._new_words(missing)
        self.places.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        return np.array(list(map(self.places.__getitem__, words)), dtype=np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins among them, and their number."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        written = coded.dictionary
        # A mark behind letters only is a word of its own. The lower case of U+0130 ends
        # in a mark that would join it.
        core = pc.utf8_slice_codeunits(written, 0, -1)
        marks = pa.array(list(_MARKS))
        mark = pc.index_in(pc.utf8_slice_codeunits(written, -1, 1 << 30), value_set=marks)
        cut = pc.and_(pc.is_valid(mark), pc.utf8_is_alpha(core))
        cut = pc.and_not(cut, pc.match_substring(core, "\u0130"))
        words = pc.if_else(cut, core, written).dictionary_encode()
        known = pa.concat_arrays([words.dictionary, marks]).dictionary_encode()
        place = self._remember(known.dictionary.to_numpy(zero_copy_only=False).tolist())
        place = place[known.indices.to_numpy(zero_copy_only=False)]
        first = place[words.indices.to_numpy(zero_copy_only=False)]
        cut = cut.to_numpy(zero_copy_only=False)
        nothing = len(self.sizes)
        behind = np.full(len(first), nothing)
        behind[cut] = place[len(words.dictionary) + mark.drop_null().to_numpy(zero_copy_only=False)[
            cut[mark.is_valid().to_numpy(zero_copy_only=False)]
        ]]
        # The ids of every distinct word with its mark, then those of all words in order.
        pairs = np.stack([first, behind], axis=1).ravel()
        ids, upto = gathered(
            self.ids, np.append(self.begins, 0), np.append(self.sizes, 0), pairs
        )
        starts = upto[::2]
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, upto = gathered(ids, starts[:-1], np.diff(starts), at)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]

    def _cut(self, text: str) -> list[str]:
        """Parts of a very long text, cut at white space."""
        parts, at = [], 0
        while len(text) - at > _SLICE // 4:
            end = max(text.rfind(blank, at, at + _SLICE // 4) for blank in _BLANKS)
            if end <= at:
                after = [text.find(blank, at + 1) for blank in _BLANKS]
                end = min((a for a in after if a > 0), default=len(text))
            parts.append(text[at:end])
            at = end
        return [*parts, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The number of each text in ``texts`` and its ids, in order."""
        slice_of: list[int] = []
        waiting: list[str] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            ids, upto = self._slice(pa.array(waiting, pa.string()))
            for n, i, j in zip(slice_of, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                yield n, ids[i:j]

        for n, text in enumerate(texts):
            if not self.by_words or "<|" in text:
                if waiting:
                    yield from flush()
                    slice_of, waiting, size = [], [], 0
                yield n, self._whole(text)
                continue
            if size + len(text) > _SLICE // 2 and waiting:
                yield from flush()
                slice_of, waiting, size = [], [], 0
            if len(text) > _SLICE // 4:
                made = [self._slice(pa.array([part], pa.string()))[0] for part in self._cut(text)]
                if waiting:
                    yield from flush()
                    slice_of, waiting, size = [], [], 0
                yield n, np.concatenate(made)
                continue
            slice_of.append(n)
            waiting.append(text)
            size += len(text)
        if waiting:
            yield from flush()
