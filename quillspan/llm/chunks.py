"""Encode texts chunk by chunk with a bounded memory of what each chunk encodes to.

A chunk ends before a space that a non-space follows, and before a line end that a non-space goes before. The split pattern of
the public byte-level vocabularies always starts a new piece there, so encoding chunks separately and joining the ids equals
encoding the whole text; natural texts repeat their chunks, so most are looked up. Of a chunk that is not known, the letters are
looked up apart from the line end before and the marks behind them, which are pieces of their own. Nothing is capped: a
forgotten chunk is encoded again.
"""

from __future__ import annotations

import gc
import re
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count, islice

import numpy as np

#: The split pattern that the chunks below are right for (a fixed value of the public byte-level vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BOUNDARY = re.compile(r" (?=\S)")
MARKS = ".,;:!?"  #: a run of these behind letters is one piece


def split_chunks(text: str) -> list[str]:
    """Chunks of a text; all but the first and those that begin with a line end stand for themselves with one space before.

    Where white space is single spaces and line ends between other characters, every line end begins a chunk too.
    """
    lines = text.replace("\n", " \n")
    if "  " in lines or "\n " in lines or lines[:1] == " " or lines[-1:] in " \n" or not text.replace("\n", "").isprintable():
        return BOUNDARY.split(text)  # no chunk but the first begins with white space here
    return lines.split(" ")


class ChunkEncoder:
    """``encode_many`` maps texts to their ids as little-endian unsigned 32-bit bytes.

    A dictionary numbers the chunks; their ids lie end to end in one array, from which whole texts are gathered. Beyond
    ``limit`` chunks (or ``HELD`` characters of them a chunk) those are forgotten that were met only once, and those over
    ``longest`` characters. The first chunk of a text has no space before it and is kept under a key of its own.
    """

    HELD = 24

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 1_200_000, longest: int = 64):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self._begin([], np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _begin(self, keys: list, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.known: defaultdict = defaultdict(count(len(keys)).__next__, zip(keys, range(len(keys))))
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes
        self.n_ids, self.n, self.chars = len(flat), len(keys), sum(map(_length, keys))
        self.uses = np.ones(len(keys), np.int64)

    def _room(self, chunks: int, ids: int) -> None:
        if self.n + chunks > len(self.sizes):
            more = max(self.n + chunks, 2 * len(self.sizes))
            self.sizes, self.starts, self.uses = (np.resize(x, more) for x in (self.sizes, self.starts, self.uses))
        if self.n_ids + ids > len(self.flat):
            self.flat = np.resize(self.flat, max(self.n_ids + ids, 2 * len(self.flat)))

    def _keep(self, values: list[bytes]) -> None:
        """Put down the ids of the chunks numbered next."""
        data = np.frombuffer(b"".join(values), "<u4")
        self._room(len(values), len(data))
        new = slice(self.n, self.n + len(values))
        self.sizes[new] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        self.starts[new] = self.n_ids + np.cumsum(self.sizes[new]) - self.sizes[new]
        self.uses[new] = 0
        self.flat[self.n_ids : self.n_ids + len(data)] = data
        self.n, self.n_ids = self.n + len(values), self.n_ids + len(data)

    def _learn(self, fresh: list) -> None:
        """Ids of the chunks ``fresh``, numbered from ``n`` on, and behind them of the bare letters that they brought up."""
        known, n = self.known, self.n
        ids: dict[str, bytes] = {}  # of the texts that these chunks are made of
        names: dict[str, object] = {}
        wanted: list[str] = []
        plans: list[tuple[str, ...]] = []
        for key in fresh:
            first = type(key) is tuple
            if not first and key.isalpha():
                text = f" {key}"
                if text not in ids:
                    ids[text] = b""
                    wanted.append(text)
                plans.append((text,))
                continue
            chunk = key[0] if first else key
            line = not first and chunk[:1] == "\n"
            rest = chunk[1:] if line else chunk
            body = rest.rstrip(MARKS)
            if body.isalpha() and len(body) < len(chunk):
                name, text = ((body,), body) if first or line else (body, f" {body}")
                if text not in ids:
                    at = known.get(name, n)
                    if at < n:
                        start = self.starts[at]
                        ids[text] = self.flat[start : start + self.sizes[at]].tobytes()
                    else:
                        names[text] = name
                plan = ("\n", text, rest[len(body) :]) if line else (text, rest[len(body) :])
            else:
                plan = (chunk if first or line else f" {chunk}",)
            for text in plan:
                if text and text not in ids:
                    ids[text] = b""
                    wanted.append(text)
            plans.append(plan)
        ids[""] = b""
        ids.update(zip(wanted, self.encode_many(wanted)))
        values = [ids[plan[0]] if len(plan) == 1 else b"".join([ids[t] for t in plan]) for plan in plans]
        for text, name in names.items():
            if name not in known:
                known[name]  # numbers it
                fresh.append(name)
                values.append(ids[text])
        self._keep(values)
        self.chars += sum(map(_length, fresh))

    def _forget(self) -> None:
        n = self.n
        stays = [(key, at) for at, (key, again) in enumerate(zip(self.known, (self.uses[:n] > 1).tolist())) if again and _length(key) <= self.longest]
        if 2 * len(stays) > self.limit:  # all in use: begin again rather than look through them at every batch
            stays = []
        at = np.fromiter((k for _, k in stays), np.int64, len(stays))
        self._begin([key for key, _ in stays], *self._gather(at))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks ``at``, end to end, and how many each has."""
        sizes = self.sizes[at]
        places = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        places += np.arange(len(places))
        return self.flat[places], sizes

    def __call__(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing here is cyclic; scanning millions of small objects again and again costs more than the work
        try:
            split = [split_chunks(text) for text in texts]
            for chunks in split:
                chunks[0] = (chunks[0],)
            many = np.fromiter(map(len, split), np.int64, len(split))
            before = len(self.known)
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
            del split
            if fresh := list(islice(reversed(self.known), len(self.known) - before))[::-1]:
                self._learn(fresh)
            self.uses[: self.n] += np.bincount(at, minlength=self.n)
            flat, sizes = self._gather(at)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(many)].tolist()
            data = flat.tobytes()
            if self.n > self.limit or self.chars > self.HELD * self.limit:
                self._forget()
            return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        except BaseException:
            self._begin([], np.zeros(0, "<u4"), np.zeros(0, np.int64))  # some chunks may have a number and no ids
            raise
        finally:
            gc.enable()


def _length(key: str | tuple[str]) -> int:
    return len(key[0]) if type(key) is tuple else len(key)
