"""Token ids of whole texts by a tokenizers-library file, as little-endian uint32 bytes.

Encoding a text costs about a microsecond a byte in the library, nearly all of it merging
the same words again.  Both vocabularies used here split a text before merging, and never
across a lone blank or line break, so a text is cut there, each piece is encoded once by
the library and its ids are kept in a bounded table of the Python worker.  Texts in which
blanks stand next to other white space go to the library whole, and so do texts that hold
one of the file's added tokens, which the library cuts out before anything else.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: A blank or line break beside other white space: such a text is not cut at all.
_CROWDED = re.compile(r"[ \n]\s|\s[ \n]")


#: Pieces kept by a Python worker, about 200 bytes each; fewer cost time, never other ids.
KEPT_PIECES = 1_000_000


def _crowded(text: str) -> bool:
    if text.replace("\n", "").isprintable():  # then its only white space is blanks and line breaks
        return "  " in text or " \n" in text or "\n " in text or "\n\n" in text
    return _CROWDED.search(text) is not None


class PieceEncoder:
    """Encodes texts with one tokenizer file.

    ``keeps_blank``: the vocabulary's words carry the blank before them (byte-level);
    otherwise white space is dropped and case ignored.  ``table_size`` bounds the kept
    pieces per worker; pieces beyond it are encoded each time, with the same ids.
    ``plain_controls``: control strings inside a text are ordinary text; by default they
    become their own ids, as in the library.
    """

    def __init__(self, path: str, keeps_blank: bool, table_size: int = KEPT_PIECES, longest_kept: int = 48, plain_controls: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_controls
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added and not plain_controls else None
        self.added_start, self.shortest_added = os.path.commonprefix(added), min(map(len, added), default=0) if self.added else 2**62
        self.keeps_blank, self.table_size, self.longest_kept = keeps_blank, table_size, longest_kept
        #: Stands between pieces that are encoded in one call; pieces that hold it go alone.
        self.mark = "\n" if keeps_blank else "0"
        self.between = self.mark if keeps_blank else f" {self.mark} "
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.kept: dict[str, bytes] = {"": b"", self.mark: np.asarray([self.mark_id], "<u4").tobytes()}

    def _cut(self, text: str) -> list[str]:
        if self.added is not None and self.added_start in text and self.added.search(text):
            return [text]
        if self.keeps_blank:
            if "\x00" in text or _crowded(text):
                return [text]
            return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        return text.replace("\n", " ").split(" ")

    def _together(self, groups: list[list[str]]) -> Iterable[list[bytes] | None]:
        """The pieces of each group in one text; None if the marks between them don't come out again."""
        for pieces, said in zip(groups, self.tokenizer.encode_batch_fast([self.between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(said.ids, "<u4")
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) != len(pieces) - 1:
                yield None
                continue
            raw, ends = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
            starts = [0, *(e + 4 for e in ends[:-1])]
            yield [raw[a:b] for a, b in zip(starts, ends, strict=True)]

    def _plain(self, piece: str) -> bool:
        """Whether a piece may be encoded beside others; short ones can't hold an added token."""
        return len(piece) <= self.longest_kept and self.mark not in piece and not piece[-1].isspace() and not (len(piece) >= self.shortest_added and self.added.search(piece))

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain = [p for p in pieces if self._plain(p)]
        groups = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        for at in range(0, len(groups), 16):
            for group, found in zip(groups[at : at + 16], self._together(groups[at : at + 16]), strict=True):
                if found:
                    out.update(zip(group, found, strict=True))
        alone = pieces if not out else [p for p in pieces if p not in out]
        for at in range(0, len(alone), 256):
            group = alone[at : at + 256]
            encoded = self.tokenizer.encode_batch_fast(group, add_special_tokens=False)
            out.update((p, np.asarray(e.ids, "<u4").tobytes()) for p, e in zip(group, encoded, strict=True))
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        cuts = [self._cut(t) for t in texts]
        kept = self.kept
        new = set().union(*cuts).difference(kept)
        if new:
            room = max(0, self.table_size - len(kept))
            kept.update(self._encode(list(new)))
        out = [b"".join(map(kept.__getitem__, c)) for c in cuts]
        if new:  # what is long or beyond the table's size goes again
            short = 0
            for p in new:
                if len(p) > self.longest_kept or short >= room:
                    del kept[p]
                else:
                    short += 1
        return out


def encoder(path: str, keeps_blank: bool, table_size: int = KEPT_PIECES) -> PieceEncoder:
    """The worker's encoder for a file; made once, so its table serves every task."""
    return worker_state(("encoder", path, keeps_blank, table_size), lambda: PieceEncoder(path, keeps_blank, table_size))


def text_groups(column: pa.Array, most: int = 800_000) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive ranges of a column of texts of about ``most`` bytes, each with its texts.

    Only one range's texts are Python strings at a time.
    """
    start, held, last = 0, 0, len(column) - 1
    for i, size in enumerate(pc.binary_length(column).to_pylist()):
        held += size
        if held >= most or i == last:
            yield start, i + 1, column.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0
