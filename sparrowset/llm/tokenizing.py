"""Token ids of whole texts by the tokenizers library, with a bounded memo of the pieces seen before."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import numpy as np

#: The end id that follows each document.
END_ID = 2
TOKENIZER_FILE = "byte_bpe_50k.json"

#: Byte-level BPE never joins what stands before a space or line feed that follows a visible character to what stands
#: after it, so a text may be cut there and its pieces encoded apart. No other places are used.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: White space beside which a cut may be wrong, or that split(" ") doesn't see; texts with it are cut by CUT.
OTHER_SPACE = re.compile("[" + "".join(map(chr, (9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")

#: A worker's memo: a dict of at most NEAR pieces (about 170 bytes each) and two tables of at most FAR pieces each (about
#: 30 bytes each). A full dict is folded into the newer table; when that is full it becomes the older one, and what is
#: still used moves over. So the memo takes some 150 MB whatever the corpus.
NEAR_PIECES = 400_000
FAR_PIECES = 1_000_000
#: A memo of 25 MB, slower by a third, for jobs whose executors have little memory beside other stages.
SMALL_MEMO = (50_000, 200_000)
#: Longer pieces don't stay in the memo.
MEMO_CHARS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


class _Table:
    """piece -> its ids, in flat arrays; a piece is known by two keyed 64-bit hashes of this process."""

    def __init__(self):
        self.first, self.second, self.start, self.size = (np.empty(0, np.int64) for _ in range(4))
        self.raw = b""

    def __len__(self) -> int:
        return len(self.first)

    @staticmethod
    def _second(pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, map(add, pieces, repeat("\0"))), np.int64, len(pieces))

    def find(self, pieces: list[str]) -> dict[str, bytes]:
        """Those of the pieces that it holds."""
        if not len(self.first) or not pieces:
            return {}
        own = np.fromiter(map(hash, pieces), np.int64, len(pieces))
        at = np.minimum(np.searchsorted(self.first, own), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == own)
        found, at = [pieces[k] for k in hit.tolist()], at[hit]
        same = (self.second[at] == self._second(found)).tolist()
        begin = self.start[at]
        end = (begin + self.size[at]).tolist()
        raw = self.raw
        return {p: raw[a:b] for p, yes, a, b in zip(found, same, begin.tolist(), end, strict=True) if yes}

    def add(self, items: dict[str, bytes]) -> None:
        pieces = [*items]
        size = np.fromiter(map(len, items.values()), np.int64, len(items))
        start = len(self.raw) + np.cumsum(size) - size
        self.raw += b"".join(items.values())
        first = np.concatenate([self.first, np.fromiter(map(hash, pieces), np.int64, len(pieces))])
        first, order = np.unique(first, return_index=True)  # of two pieces with one first hash the older stays
        self.first = first
        self.second, self.start, self.size = (np.concatenate(x)[order] for x in ((self.second, self._second(pieces)), (self.start, start), (self.size, size)))


class Encoder:
    """ids(texts): for each text the bytes of its ids (little-endian unsigned 32 bits), as the library gives them for the
    whole text with add_special_tokens=False.

    By the library's default, the string of an added token in a text becomes that token's id; with added_as_text it is
    ordinary text. Pieces that aren't in the memo are joined and encoded in one call; the ids are cut apart by the
    lengths of their tokens. Texts that hold the string of an added token are encoded whole, and so are all texts if the
    tokenizer is of a kind for which cuts may be wrong (anything but plain byte-level BPE). Lone surrogates can't occur
    in Spark strings.
    """

    def __init__(self, path: str, added_as_text: bool = False, near_pieces: int = NEAR_PIECES, far_pieces: int = FAR_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = added_as_text
        self.size = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder()
        own = [t for t in added.values() if not (added_as_text and t.special)]
        self.added = [t.content for t in own if t.content]
        self.cuttable = self._is_byte_level() and not any(t.normalized or re.search(r"\s", t.content) for t in own)
        #: Byte-level vocabularies write each byte of a token as one character.
        self.n_bytes = np.array([0 if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        self.memo: dict[str, bytes] = {}
        self.pending: dict[str, bytes] = {}  # what is in the dict and not in the newer table
        self.new, self.old = _Table(), _Table()
        self.near_pieces, self.far_pieces = near_pieces, far_pieces

    def _is_byte_level(self) -> bool:
        import json

        t = self.tokenizer
        kind = json.loads(t.pre_tokenizer.__getstate__()) if t.pre_tokenizer is not None else {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        model = t.model
        return bool(plain and t.normalizer is None and type(model).__name__ == "BPE" and not model.dropout and not model.continuing_subword_prefix and not model.end_of_word_suffix)

    def _apart(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Pieces that begin with a space or line feed and end with a visible character."""
        if not pieces:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)))
        at = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return self._apart(pieces)
        raw, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the pieces: a piece that begins with a space is written without it, any other after a zero byte,
        except that a line feed at the start stands for itself."""
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n " in spaced or spaced[-1] in " \n" or spaced[0] == " " or "\0" in spaced or OTHER_SPACE.search(spaced):
            return [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in "\0\n" else p if p[0] == "\n" else "\0" + p for p in CUT.split(text)]
        pieces = spaced.split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces

    @staticmethod
    def piece(key: str) -> str:
        return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key

    def _fold(self) -> None:
        """Empty the dict; what the newer table doesn't hold goes there."""
        self.new.add(self.pending)
        self.memo, self.pending = {}, {}
        if len(self.new) > self.far_pieces:
            self.old, self.new = self.new, _Table()

    def _learn(self, keys: set[str]) -> None:
        """Put the keys that the dict doesn't hold into it."""
        found = self.new.find([*keys])
        self.memo.update(found)
        keys = keys.difference(found)
        fresh = self.old.find([*keys])
        keys = keys.difference(fresh)
        # those that may stand behind another piece in one string
        plain = [k for k in keys if k[0] != "\0" and not k[-1].isspace()]
        other = list(keys.difference(plain))
        fresh.update(zip(plain, self._joined([k if k[0] == "\n" else " " + k for k in plain]), strict=True))
        fresh.update(zip(other, self._apart([*map(self.piece, other)]), strict=True))
        self.memo.update(fresh)
        self.pending.update(fresh)
        for k in keys:
            if len(k) > MEMO_CHARS:
                del self.pending[k]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        whole = [bool(t) and (not self.cuttable or any(a in t for a in self.added)) for t in texts]
        cut = [self.cut(t) if t and not w else [] for t, w in zip(texts, whole, strict=True)]
        wanted = set().union(*cut)
        new = wanted.difference(self.memo)
        if len(self.memo) + len(new) > self.near_pieces:
            self._fold()
            new = wanted
        self._learn(new)
        get = self.memo.__getitem__
        out = [b"".join(map(get, keys)) for keys in cut]
        for k in new:
            if len(k) > MEMO_CHARS:
                del self.memo[k]
        if any(whole):
            at = [k for k, w in enumerate(whole) if w]
            for k, raw in zip(at, chain.from_iterable(self._apart([texts[j]]) for j in at), strict=True):
                out[k] = raw
        return out


@lru_cache(maxsize=1)
def encoder(path: str, added_as_text: bool = False, memo: tuple[int, int] = (NEAR_PIECES, FAR_PIECES)) -> Encoder:
    """One for each Python worker, which Spark reuses from task to task."""
    return Encoder(path, added_as_text, *memo)


def run_chars(memo: tuple[int, int]) -> int:
    """How many characters to encode at once: more of them share more pieces, and take more memory beside the memo."""
    return 1_000_000 if memo[0] >= NEAR_PIECES else 300_000


def groups(column, chars: int = 300_000):
    """(first, texts) runs of an Arrow column, of about so many bytes: memory follows them and the longest text, not the
    batch."""
    import pyarrow.compute as pc

    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        end = min(n, int(np.searchsorted(ends, before + chars)) + 1)
        yield start, column.slice(start, end - start).to_pylist()
        start = end
