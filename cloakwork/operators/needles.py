"""Known secrets that are few enough to travel: a search of whole texts by the first bytes of all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

Place = tuple[int, int, str]  # start, stop, ref
MOST_BITS = 24


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes (at most 8) from each place of the text, as a big-endian number."""
    out = np.zeros(max(len(data) - width + 1, 0), np.uint64)
    for k in range(width):
        out <<= np.uint64(8)
        out |= data[k : k + len(out)]
    return out


class Heads:
    """A table with a bit for a hash of each beginning of `width` bytes, asked at every place of a text, in numpy; besides
    beginnings it lets through one place in 64 or so."""

    def __init__(self, heads: np.ndarray, n: int) -> None:
        bits = min(MOST_BITS, max(10, (64 * n).bit_length()))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[self._slots(heads)] = True

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def places(self, grams: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[self._slots(grams)])


class Matcher:
    """Secrets of (repo, pattern, ref), by their first `width` bytes (at most 8) and their length: what their `Heads` let through is looked up."""

    def __init__(self, rows: Iterable[tuple[str, bytes, str]], width: int) -> None:
        self.width, self.groups = width, {}
        for repo, pattern, ref in rows:
            self.groups.setdefault(pattern[:width], {}).setdefault(len(pattern), {}).setdefault(pattern, {}).setdefault(repo, []).append(ref)
        self.heads = Heads(np.frombuffer(b"".join(h.ljust(8, b"\0") for h in self.groups), ">u8").astype(np.uint64) >> np.uint64(8 * (8 - width)), len(self.groups))

    def places(self, text: bytes, repo: str) -> list[Place]:
        """Every occurrence, overlapping ones too, of the repo's secrets, by start."""
        if len(text) < self.width or not self.groups:
            return []
        found = []
        for i in self.heads.places(grams(np.frombuffer(text, np.uint8), self.width)).tolist():
            for size, owned in self.groups.get(text[i : i + self.width], {}).items():
                for ref in owned.get(text[i : i + size], {}).get(repo, ()):
                    found.append((i, i + size, ref))
        return found


def shown(places: Iterable[Place]) -> list[Place]:
    """The longest occurrence at each end, the least ref of equals, cut where a later one starts; empty pieces go."""
    longest: dict[int, tuple[int, str]] = {}
    for start, stop, ref in places:
        longest[stop] = min(longest.get(stop, (start, ref)), (start, ref))
    out, later = [], None
    for stop, (start, ref) in sorted(longest.items(), reverse=True):
        end = stop if later is None else min(stop, later)
        if start < end:
            out.append((start, end, ref))
        later = start if later is None else min(later, start)
    return out[::-1]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, object, bytes | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True)


def find(shared, as_shown: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(repo, id, start, stop, ref) of (repo, id, text): all occurrences, or the pieces `shown`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value[0]
        for batch in batches:
            rows = []
            for repo, key, text in _texts(batch):
                places = matcher.places(text or b"", repo)
                rows += [(repo, key, *p) for p in (shown(places) if as_shown else places)]
            kinds = (pa.string(), batch.schema.field(1).type, pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["repo", "id", "start", "stop", "ref"])

    return run


def replace(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(repo, id, text, n_hits) of (repo, id, text): each shown piece replaced by its ref's mark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, marks = shared.value
        for batch in batches:
            texts, counts = [], []
            for repo, _, text in _texts(batch):
                pieces, out, at = shown(matcher.places(text or b"", repo)), [], 0
                for start, stop, ref in pieces:
                    out += [text[at:start], marks[ref]]
                    at = stop
                texts.append(b"".join([*out, text[at:]]) if pieces else text)
                counts.append(len(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["repo", "id", "text", "n_hits"])

    return run
