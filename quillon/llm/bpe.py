"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can stand last in the prefix's encoding. It is
found from the tokens that end there: the one whose left neighbour, the last token of the remaining
prefix, forms a pair that the merges would keep apart. The list of last tokens is all the state an
encoding needs, so text can be appended at the end without redoing what stands before, and an edit
is redone only from its piece on.

Text is first cut into pieces by the vocabulary's pattern; no token crosses a piece. Strings of
special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import regex

#: Fixed: the pattern that cuts a text into pieces before the merges apply.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO_LIMIT = 400_000


class Vocabulary:
    """Tokens with the pair each was merged from, read from a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.kept_apart: dict[tuple[int, int], bool] = {}
        #: Suffix filter: every proper suffix chain is walked longest first, so know which lengths end in which byte.
        self.lengths: dict[int, list[int]] = {}
        by_last: dict[int, set[int]] = {}
        for tok in ranks:
            by_last.setdefault(tok[-1], set()).add(len(tok))
        self.lengths = {b: sorted(s) for b, s in by_last.items()}
        for tok, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(tok) == 1:
                continue
            pair = self._split(tok, rank)
            self.parts[rank] = pair
            self.merged[pair] = rank

    def _split(self, tok: bytes, rank: int) -> tuple[int, int]:
        """The two tokens the merges had made of ``tok`` just before its own merge."""
        seq = [tok[i : i + 1] for i in range(len(tok))]
        while len(seq) > 2:
            best, at = rank, -1
            for i in range(len(seq) - 1):
                r = self.ranks.get(seq[i] + seq[i + 1], rank)
                if r < best:
                    best, at = r, i
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return self.ranks[seq[0]], self.ranks[seq[1]]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether encoding left+right gives just these two tokens.

        Walks both tokens' merge trees along the seam from the latest merge back; a merge across the
        seam that would have come earlier than the one undone last rules the pair out."""
        got = self.kept_apart.get((left, right))
        if got is not None:
            return got
        a, b, limit, apart = left, right, 1 << 60, True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                apart = False
                break
            split_a, split_b = self.parts.get(a), self.parts.get(b)
            if split_a is None and split_b is None:
                break
            # undo the later of the two merges; of equal tokens the right one was made last
            if split_b is None or (split_a is not None and a > b):
                limit, a = a, split_a[1]
            else:
                limit, b = b + 1, split_b[0]
        if len(self.kept_apart) > MEMO_LIMIT:
            self.kept_apart.clear()
        self.kept_apart[(left, right)] = apart
        return apart


@lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return Vocabulary(path)


class Prefixes:
    """The last token of every prefix of one piece; grows at the end."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        ranks, lengths, apart, last = self.vocab.ranks, self.vocab.lengths, self.vocab.stays_apart, self.last
        start = len(self.data)
        self.data = data = self.data + more
        for end in range(start + 1, len(data) + 1):
            found = None
            for n in lengths.get(data[end - 1], ()):
                if n > end:
                    break
                tok = ranks.get(data[end - n : end])
                if tok is None:
                    continue
                if n == end or apart(last[end - n - 1][0], tok):
                    found = tok
                    break
            if found is None:
                raise ValueError("the vocabulary does not cover every byte")
            last.append((found, n))

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            tok, n = self.last[at - 1]
            out.append(tok)
            at -= n
        out.reverse()
        return out


class Encoder:
    """Encodes texts; remembers the encodings of pieces seen before, up to a bound."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.vocab = vocabulary(path)
        self.pieces = regex.compile(PIECES).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocab.ranks.get(data)
        got = (whole,) if whole is not None else tuple(Prefixes(self.vocab, data).ids())
        if len(piece) <= 64:
            if len(self.memo) > MEMO_LIMIT:
                self.memo.clear()
            self.memo[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has the empty list."""
        out: list[int] = []
        memo, extend = self.memo, out.extend
        for p in self.pieces(text or ""):
            got = memo.get(p)
            extend(self.piece(p) if got is None else got)
        return out

    def count(self, text: str | None) -> int:
        memo = self.memo
        return sum(len(memo.get(p) or self.piece(p)) for p in self.pieces(text or ""))


class EditableText:
    """A text with its encoding, kept right under appends and edits by redoing the pieces nearby."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self._cut(0, text)

    def _cut(self, keep: int, tail: str) -> None:
        if keep == 0:
            self.parts: list[tuple[int, str, tuple[int, ...]]] = []
        del self.parts[keep:]
        at = self.parts[-1][0] + len(self.parts[-1][1]) if self.parts else 0
        for p in self.encoder.pieces(tail):
            self.parts.append((at, p, self.encoder.memo.get(p) or self.encoder.piece(p)))
            at += len(p)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of text[start:end]; pieces that end well before stay as they are."""
        import bisect

        text = self.text[:start] + new + self.text[end:]
        keep = max(0, bisect.bisect_right(self.parts, start, key=lambda p: p[0]) - 3)
        shift = len(text) - len(self.text)
        # pieces after the edit are taken over from the first place where the new cuts meet the old ones
        old = {p[0] + shift: i for i, p in enumerate(self.parts) if p[0] >= end + 2}
        rest = self.parts[:]
        self.text = text
        at = self.parts[keep][0] if keep < len(self.parts) else (self.parts[-1][0] + len(self.parts[-1][1]) if self.parts else 0)
        del self.parts[keep:]
        for m in regex.finditer(PIECES, text, pos=at):
            i = old.get(m.start())
            if i is not None and m.start() >= start + len(new) + 2:
                self.parts.extend((p[0] + shift, p[1], p[2]) for p in rest[i:])
                return
            p = m.group()
            self.parts.append((m.start(), p, self.encoder.memo.get(p) or self.encoder.piece(p)))

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [t for _, _, ids in self.parts for t in ids]
