"""Token ids of whole texts, computed in Arrow batches inside the tasks.

The vocabulary file drops white space and never joins characters across it,
so a text is the concatenation of its white-space-free pieces. The pieces of a
batch are cut, parted into word and closing mark (the vocabulary never joins
letters and marks, and case makes no difference to ASCII letters) and made
distinct by Arrow, so Python sees a word once per batch, and the ids of the batch are put together by NumPy. Each worker keeps
the ids of words it has met, in bounded memory, and asks the tokenizer for
new ones only.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain
from string import ascii_letters, digits

CACHE_PIECES = 800_000  # words remembered per worker
CACHE_CHARS = 48  # longer pieces are rarely met again

_CACHES: dict[str, PieceIds] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 bytes themselves, the others after them."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


_CLOSING = ".,;:!?"
_PLAIN = frozenset(ascii_letters + digits)


def plain_word(piece: str) -> str | None:
    """A piece that is one run of letters, as the merges expect it: composed, in lower case, bytes as letters."""
    if piece.isascii():
        return piece.lower() if piece.isalpha() else None
    word = unicodedata.normalize("NFC", piece)
    if "\u03a3" in word:  # its lower case depends on the place in str.lower()
        return None
    word = word.lower()
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS) if word.isalpha() else None


def ends_in_letter(word: str) -> bool:
    """Whether the last character, composed and lowered as the tokenizer does, is a letter or an ASCII digit."""
    return word[-1] in _PLAIN or (word[-1].isalpha() and unicodedata.normalize("NFC", word).lower()[-1].isalpha())


def parted(pieces):
    """Distinct pieces as words and, dictionary-encoded, the marks that close them; ids of the two are those of the piece.

    A piece whose word doesn't end in a letter, or whose closing marks are
    several, may join them in one token and stays whole, with no marks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.ascii_lower(pc.utf8_rtrim(pieces, characters=_CLOSING))
    n_marks = pc.subtract(pc.utf8_length(pieces), pc.utf8_length(words)).to_numpy()
    plain = pc.match_substring_regex(words, "[a-z0-9]$").to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~plain & (n_marks == 1))
    ends = np.zeros(len(plain), bool)
    ends[odd] = [w != "" and ends_in_letter(w) for w in words.take(pa.array(odd)).to_pylist()]
    apart = (plain | ends) & (n_marks <= 1)
    last = pc.utf8_slice_codeunits(pieces, start=-1)
    marks = pc.if_else(pa.array(apart & (n_marks == 1)), last, pa.scalar("", pa.large_string()))
    return pc.if_else(pa.array(apart), words, pieces), marks.dictionary_encode()


def _joined(flat, starts, sizes, units, each: int):
    """The runs ``units`` of ``flat`` one after the other, and start and size of every ``each`` of them together."""
    import numpy as np

    lengths = sizes[units]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    places = np.repeat(starts[units] - begins, lengths)
    places += np.arange(len(places))
    starts = begins[::each]
    return flat[places], starts, np.diff(np.append(starts, len(places)))


class PieceIds:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}

    def ask(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces: words by the vocabulary's merges alone, all else by the whole tokenizer."""
        import numpy as np

        merge, words, runs, others = self._tokenizer.model.tokenize, [], [], []
        for piece in pieces:
            word = piece if piece.isascii() and piece.isalpha() and piece.islower() else plain_word(piece)
            if word is None:
                others.append(piece)
            else:
                words.append(piece)
                runs.append(word)
        ids = [[t.id for t in merge(run)] for run in runs]
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            ids += [e.ids for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * 4).tolist()
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return {piece: flat[start:end] for piece, start, end in zip(words + others, [0, *ends], ends)}

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces; short ones are remembered."""
        known = self._known
        found = [known.get(w) for w in words]
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            fresh = self.ask(new)
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
            if len(known) + len(fresh) > CACHE_PIECES:
                self._known = {}
            self._known.update((k, v) for k, v in fresh.items() if len(k) <= CACHE_CHARS)
        return found

    def encode(self, texts):
        """All ids of an Arrow string column, and where those of each text start and end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        pieces = split.flatten().dictionary_encode()
        words, marks = parted(pieces.dictionary)
        words = words.dictionary_encode()
        ids = self.of_words(words.dictionary.to_pylist()) + self.of_words(marks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        flat, starts, sizes = _joined(
            flat, starts, sizes, np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)], axis=1).ravel(), 2
        )  # of distinct pieces: a word and its mark
        flat, starts, sizes = _joined(flat, starts, sizes, pieces.indices.to_numpy(), 1)
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return flat, np.append(starts, len(flat))[borders]


def piece_ids(path: str) -> PieceIds:
    """The tokenizer of this worker process."""
    if path not in _CACHES:
        _CACHES[path] = PieceIds(path)
    return _CACHES[path]


def batches(texts, max_bytes: int = 8_000_000):
    """Row ranges of an Arrow string column with at most ``max_bytes``, or one row, each."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + size > max_bytes:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
