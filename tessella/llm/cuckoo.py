"""A cuckoo filter over digests, with the content of its buckets beside it."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

SLOTS = 4
KICKS = 200
#: Bytes of a digest, and numbers kept with each.
WIDTH, NUMBERS = 32, 3
#: Part of the slots that is meant to be taken.
LOAD = 0.85


class CuckooIndex:
    """Live digests, each with a few numbers.

    The filter is a table of 16-bit marks in buckets of four; a digest's mark lies in one of two buckets, which mark and
    either bucket tell. What a mark stands for lies in the same slot of the bucketed content: the whole digest and its
    numbers. There is no other way to a digest: where no mark agrees it is not live, and where one does, the content of that
    slot tells whether it is the same digest. A mark that is displaced takes its content along. When no slot can be freed the
    index is built anew from the stored digests, with twice the buckets."""

    def __init__(self, capacity: int = 1024) -> None:
        self.live = self.resized = self.hits = self.false_hits = 0
        self._kick = 1
        self._clear(1 << max(1, math.ceil(math.log2(max(2, capacity / (SLOTS * LOAD))))))

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.digests = bytearray(WIDTH * SLOTS * buckets)
        self.numbers = array("q", bytes(8 * NUMBERS * SLOTS * buckets))

    def _mark(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[2:8], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def candidates(self, digest: bytes) -> list[int]:
        """The slots whose marks agree, by the filter alone. There may be ones of other digests; a live digest's is always there."""
        mark, a = self._mark(digest)
        b, found = self._other(a, mark), []
        for bucket in (a, b) if a != b else (a,):
            begin = bucket * SLOTS
            own = self.marks[begin : begin + SLOTS]
            if mark in own:
                found += [begin + k for k in range(SLOTS) if own[k] == mark]
        return found

    def find(self, digest: bytes) -> int:
        """The slot of a live digest, or -1."""
        for slot in self.candidates(digest):
            if self.digests[slot * WIDTH : slot * WIDTH + WIDTH] == digest:
                self.hits += 1
                return slot
            self.false_hits += 1
        return -1

    def get(self, slot: int) -> tuple[int, ...]:
        return tuple(self.numbers[slot * NUMBERS : slot * NUMBERS + NUMBERS])

    def put(self, slot: int, numbers: tuple[int, ...]) -> None:
        self.numbers[slot * NUMBERS : slot * NUMBERS + NUMBERS] = array("q", numbers)

    def _put(self, slot: int, mark: int, digest: bytes, numbers: array) -> None:
        self.marks[slot] = mark
        self.digests[slot * WIDTH : slot * WIDTH + WIDTH] = digest
        self.numbers[slot * NUMBERS : slot * NUMBERS + NUMBERS] = numbers

    def _free(self, bucket: int) -> int:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.marks[slot]:
                return slot
        return -1

    def insert(self, digest: bytes, numbers: tuple[int, ...]) -> None:
        """The digest must not be live."""
        self.live += 1
        left = self._placed(digest, array("q", numbers))
        if left:
            self._grow([*((d, array("q", n)) for d, n in self.items()), left])

    def _grow(self, stored: list[tuple[bytes, array]]) -> None:
        buckets = self.buckets
        while True:
            buckets *= 2
            self.resized += 1
            self._clear(buckets)
            if not any(self._placed(d, n) for d, n in stored):
                return

    def _placed(self, digest: bytes, numbers: array) -> tuple[bytes, array] | None:
        """Puts a digest into one of its buckets, displacing others if need be. What has no place in the end is given back."""
        mark, bucket = self._mark(digest)
        for at in (bucket, self._other(bucket, mark)):
            if (slot := self._free(at)) >= 0:
                self._put(slot, mark, digest, numbers)
                return None
        for _ in range(KICKS):
            self._kick = self._kick * 1_103_515_245 + 12_345 & 0x7FFFFFFF
            slot = bucket * SLOTS + (self._kick >> 16 & SLOTS - 1)
            out = self.marks[slot], bytes(self.digests[slot * WIDTH : slot * WIDTH + WIDTH]), array("q", self.get(slot))
            self._put(slot, mark, digest, numbers)
            mark, digest, numbers = out
            bucket = self._other(bucket, mark)
            if (slot := self._free(bucket)) >= 0:
                self._put(slot, mark, digest, numbers)
                return None
        return digest, numbers

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out, its mark and its content."""
        slot = self.find(digest)
        if slot < 0:
            return False
        self._put(slot, 0, bytes(WIDTH), array("q", [0] * NUMBERS))
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        for slot, mark in enumerate(self.marks):
            if mark:
                yield bytes(self.digests[slot * WIDTH : slot * WIDTH + WIDTH]), self.get(slot)
