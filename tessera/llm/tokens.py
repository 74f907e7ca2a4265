"""Encoding with a public tokenizer file, with a memo of the pieces between spaces.

Pre-tokenization rules of the two vocabularies never join characters across certain spaces, so a
text is cut there and each distinct piece is encoded once per worker. The result is the one that
the tokenizers library gives for the whole text; ``tests/llm/test_tokens.py`` holds the two together.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from .common import give_back

#: Entries of a worker's memo, about 180 bytes each, at which it becomes the old one, of which only what is met again is kept.
MEMO_ENTRIES = 600_000
#: Characters of text handed to the library at once.
BATCH_CHARS = 4_000_000

_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(texts) yields for each text its ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # as the vocabularies' own description has it: the names of special tokens in a text are ordinary text, so a document can't
        # forge the mark of its own end
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.size = self.tokenizer.get_vocab_size()
        self.special = tuple(t["content"] for t in rules.get("added_tokens", []))
        pre = rules.get("pre_tokenizer") or {}
        #: "keep": a single space belongs to the word after it; "drop": spaces are dropped; else no cuts.
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not rules.get("normalizer"):
            self.rule = "keep"
        elif '"Replace"' in json.dumps(rules.get("normalizer")) and '"Removed"' in json.dumps(pre):
            self.rule = "drop"
        else:
            self.rule = ""
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.line = len(next(self._encode(["\n"]), b""))

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False):
                yield np.asarray(e.ids, dtype="<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of each piece: many are encoded as one text, set apart by a mark whose id none of them can have."""
        mark = "\n" if self.rule == "keep" else "|"
        joint = "\n" if self.rule == "keep" else " | "
        at = self.tokenizer.encode(mark, add_special_tokens=False).ids
        if len(at) != 1:
            yield from self._encode(pieces)
            return
        odd = iter(list(self._encode([x for x in pieces if mark in x])))
        plain = [x for x in pieces if mark not in x]
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]

        def found() -> Iterator[bytes]:
            for group, ids in zip(groups, self._encode([joint.join(g) for g in groups]), strict=True):
                a = np.frombuffer(ids, dtype="<u4")
                ends = np.flatnonzero(a == at[0])
                if len(ends) != len(group) - 1:
                    yield from self._encode(group)
                    continue
                start = 0
                for end in [*ends.tolist(), len(a)]:
                    yield ids[4 * start : 4 * end]
                    start = end + 1

        rest = found()
        for x in pieces:
            yield next(odd) if mark in x else next(rest)

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces whose ids, joined, are those of the text; None if it must be encoded whole."""
        if self.rule == "drop":
            return [x for x in text.replace("\n", " ").split(" ") if x]
        if self.rule == "keep":
            return text.replace("\n", " \n").split(" ")
        return None

    def _odd(self, new: set[str]) -> set[str]:
        """Pieces at whose ends white space meets white space of the text: a cut there may not be one of the rules'."""
        if self.rule == "drop":
            return set()
        return {x for x in new if x in ("", "\n") or x[-1].isspace() or (x[1:] if x[0] == "\n" else x)[0].isspace()}

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        batch, chars = [], 0
        for text in texts:
            batch.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from self._batch(batch)
                batch, chars = [], 0
        yield from self._batch(batch)

    def release(self) -> None:
        """At the end of a partition: what the batches took goes back to the system; the memos, of bounded size, stay for the next one."""
        give_back()

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.memo) > MEMO_ENTRIES:
            self.old, self.memo = self.memo, {}
            self.odd.clear()
        memo = self.memo
        pieces = [self._pieces(t) if t and not any(s in t for s in self.special) else None for t in texts]
        keep = self.rule == "keep"
        for p in pieces if keep else ():
            if p:
                p[0] = "\n" + p[0]  # the first piece has no space before it; the line break is taken off below
        new = set(chain.from_iterable(p for p in pieces if p)).difference(memo)
        if self.old:
            known = {x: self.old[x] for x in new if x in self.old}
            memo.update(known)
            new.difference_update(known)
        if new:
            odd = self._odd(new)
            self.odd |= odd
            todo = list(new - odd)
            # below "keep", a piece "\nX" stands for a line break and X, any other X for a space and X
            raw = [x[1:] if x[0] == "\n" else " " + x for x in todo] if keep else todo
            memo.update(zip(todo, self._encode_pieces(raw), strict=True))
            if keep:
                line = next(self._encode(["\n"]))
                memo.update((x, line + memo[x]) for x in todo if x[0] == "\n")
        if self.odd:
            pieces = [None if p and not self.odd.isdisjoint(p) else p for p in pieces]
        whole = iter(list(self._encode([t for t, p in zip(texts, pieces, strict=True) if p is None])))
        for p in pieces:
            if p is None:
                yield next(whole)
            elif keep:
                yield b"".join(map(memo.__getitem__, p))[self.line :]
            else:
                yield b"".join(map(memo.__getitem__, p))


def forget() -> None:
    """Gives up this process's encoders and their memos: called by tasks of other operators, whose worker may have served this one before."""
    if _encoders:
        _encoders.clear()
        give_back()


def encoder(path: str) -> Encoder:
    """The encoder of this process for the vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
