"""Redaction of text that arrives in pieces: nothing is let out before it is certain that no secret starts in it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import redact_command
from ..operators.gate import check_policy, detect_caller
from ..operators.needles import Heads, grams, shown
from ..sources.shared import shared_folder

OUT = "stream_id string, from_seq long, text string, refs array<string>, gap_to long"
HITS = "stream_id string, ref string, n long"
WAITING = 1 << 20  # characters of chunks that wait for an earlier one


class Needles:
    """The secrets to look for, of (pattern, ref), the least ref of each pattern; texts have one character a byte.

    Every worker of an executor holds all of them, so they stay sorted in Arrow buffers: some 30 bytes each beside their own,
    where an object for each would take a thousand."""

    def __init__(self, rows: pa.Table | Iterable[tuple[str, str]]) -> None:
        table = rows if isinstance(rows, pa.Table) else pa.table([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] or [pa.array([], pa.string())] * 2, ["pattern", "ref"])
        table = table.cast(pa.schema([("pattern", pa.large_binary()), ("ref", pa.large_string())]))
        table = table.take(pc.sort_indices(table, [("pattern", "ascending"), ("ref", "ascending")])).combine_chunks()
        same = pc.equal(table.column(0).slice(1), table.column(0).slice(0, max(len(table) - 1, 0))).to_numpy()
        table = table.filter(pa.array(np.r_[np.ones(min(len(table), 1), bool), ~same] & (pc.binary_length(table.column(0)).to_numpy() > 0))).combine_chunks()
        patterns, self.refs = (c.chunk(0) if len(table) else pa.array([], c.type) for c in table.columns)
        self.n, (_, ends, data) = len(table), patterns.buffers()
        self.ends, self.data = np.frombuffer(ends, np.int64)[: self.n + 1] if self.n else np.zeros(1, np.int64), memoryview(data or b"")
        sizes = np.diff(self.ends)
        self.longest, self.width = int(sizes.max(initial=1)), int(sizes.min(initial=8))
        self.first = np.zeros(self.n, np.uint64)  # the first `width` bytes of each
        for k in range(self.width):
            self.first = (self.first << np.uint64(8)) | np.frombuffer(self.data, np.uint8)[self.ends[:-1] + k]
        self.heads = Heads(self.first, self.n)
        self.inner = self._inner(sizes)

    def _pattern(self, i: int) -> bytes:
        return bytes(self.data[self.ends[i] : self.ends[i + 1]])

    def _inner(self, sizes: np.ndarray) -> np.ndarray:
        """For each needle the longest other one that it begins with, or -1: one that others begin with stands just before the first of them."""
        inner = np.full(self.n, -1, np.int32)
        for i in np.flatnonzero((self.first[1:] == self.first[:-1]) & (sizes[1:] > sizes[:-1])).tolist():
            own = self._pattern(i)
            if self._pattern(i + 1).startswith(own):
                inner[i + 1 : bisect_right(range(self.n), own, i + 1, self.n, key=lambda k: self._pattern(k)[: len(own)])] = i
        return inner

    def places(self, text: str) -> list[tuple[int, int, str]]:
        """(stop, start, ref) of every occurrence, by stop, the longest first."""
        data = text.encode("latin-1")
        if not self.n or len(data) < self.width:
            return []
        heads = grams(np.frombuffer(data, np.uint8), self.width)
        at = self.heads.places(heads)
        low, high = (np.searchsorted(self.first, heads[at], side) for side in ("left", "right"))
        found = []
        for start, a, b in zip(*(x[low < high].tolist() for x in (at, low, high)), strict=True):
            rest = data[start : start + self.longest]
            # of needles that `rest` begins with, all but the last one up to it are what that one begins with
            k = bisect_right(range(self.n), rest, a, b, key=self._pattern) - 1
            while k >= a:
                pattern = self._pattern(k)
                if rest.startswith(pattern):
                    found.append((start + len(pattern), start, self.refs[k].as_py()))
                k = int(self.inner[k])
        return sorted(found)

    def begun(self, text: str) -> int:
        """Length of the longest end of a text that is the beginning of a needle, but not all of it."""
        end = text[max(len(text) - self.longest + 1, 0) :].encode("latin-1") if self.longest > 1 else b""
        heads = grams(np.frombuffer(end + bytes(self.width - 1), np.uint8), self.width) if end else np.empty(0, np.uint64)
        left = np.arange(len(end), 0, -1)
        # an end that is shorter than `width` is followed by anything
        free = np.array([(1 << 8 * max(self.width - n, 0)) - 1 for n in left], np.uint64)
        low, high = np.searchsorted(self.first, heads, "left"), np.searchsorted(self.first, heads | free, "right")
        for n, a, b in zip(*(x[low < high].tolist() for x in (left, low, high)), strict=True):
            if n < self.width:
                return n
            rest = end[len(end) - n :]
            at = bisect_right(range(self.n), rest, a, b, key=self._pattern)  # the first needle after it, which a longer one that begins with it must be
            if at < b and self._pattern(at).startswith(rest):
                return n
        return 0

    def release(self, text: str, done: bool, idle: bool = False) -> tuple[str, list[str], str]:
        """(what may go out, the refs shown in it, what must wait): all if `done`, else up to where a secret may yet start; when
        `idle`, only what has begun to be a secret waits."""
        places = self.places(text)
        limit = len(text) if done else len(text) - self.begun(text) if idle else max(len(text) - self.longest + 1, 0)
        runs: list[list[int]] = []
        for start, stop in sorted((a, b) for b, a, _ in places):
            if runs and start < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], stop)
            else:
                runs.append([start, stop])
        limit = min([limit, *(a for a, b in runs if b > limit)])
        out, at, refs = [], 0, []
        for start, stop, ref in shown((a, b, ref) for b, a, ref in places):
            if stop <= limit:
                out += [text[at:start], "sv://", ref]
                refs.append(ref)
                at = stop
        return "".join([*out, text[at:limit]]), refs, text[limit:]


def as_text(latin: str) -> str:
    """Bytes, one a character, as text."""
    return latin.encode("latin-1", "replace").decode("utf-8", "replace")


def advance(known: Needles, following: int, pending: str, waiting: dict[int, tuple[str, bool]], idle: bool, most: int) -> tuple[str, list[str], int, str, bool, int | None]:
    """(text to let out, refs shown in it, the next seq, what waits, whether the end was reached, the seq after a gap): takes
    from `waiting` what follows; where that holds more than `most` characters, the missing chunks are given up."""
    done, out, refs, gap = False, [], [], None
    while True:
        while following in waiting and not done:
            part, done = waiting.pop(following)
            pending, following = pending + part, following + 1
        if done or sum(len(v[0]) + 1 for v in waiting.values()) <= most:
            break
        text, marks, _ = known.release(pending, True)
        out, refs, pending, following = [*out, text], [*refs, *marks], "", min(waiting)
        gap = following
    text, marks, pending = known.release(pending, done, idle)
    # a character's bytes stay together
    while text and not done and pending and 0x80 <= ord(pending[0]) < 0xC0:
        text, pending = text[:-1], text[-1] + pending
    return "".join([*out, text]), refs + marks, following, pending, done, gap


_known: dict[str, Needles] = {}


def known_needles(path: str) -> Needles:
    """The needles of a table in the shared folder, read once a worker."""
    if path not in _known:
        system, inner = fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", path))
        _known.clear()
        _known[path] = Needles(pq.read_table(inner, columns=["pattern", "ref"], filesystem=system))
        pa.default_memory_pool().release_unused()
    return _known[path]


class Redactor(StatefulProcessor):
    """The streams (`part`) of a key: what each lets out, or with `counts` how often each ref was shown in all of them so far.

    State: for each stream the next seq and what waits, one row for each chunk that came too early, one for each ref counted."""

    def __init__(self, needles: str, idle_ms: int | None, most: int, counts: bool) -> None:
        self.needles, self.idle_ms, self.most, self.counts = needles, idle_ms, most, counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState("heads", "part string", "next long, pending string, ended boolean")
        self.early = handle.getMapState("early", "part string, seq long", "chunk string, last boolean")
        self.hits = handle.getMapState("hits", "ref string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, dict[int, tuple[str, bool]]] = {}
        for frame in rows:
            for part, seq, chunk, last in zip(frame["part"], frame["seq"], frame["chunk"], frame["done"], strict=True):
                fresh.setdefault(part, {})[int(seq)] = (("" if chunk is None else chunk).encode().decode("latin-1"), bool(last))
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._let_out(key, fresh, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        heads = {k[0]: v for k, v in self.heads.iterator()}
        if all(ended for _, _, ended in heads.values()):
            for state in (self.heads, self.early, self.hits):
                state.clear()
        else:
            yield from self._let_out(key, {part: {} for part, (_, _, ended) in heads.items() if not ended}, True)

    def _let_out(self, key, fresh: dict[str, dict[int, tuple[str, bool]]], idle: bool) -> Iterator[pd.DataFrame]:
        # each call of the state store is a message: a stream without a head has no early chunks either
        held = {part: self.heads.getValue((part,)) for part in fresh if self.heads.containsKey((part,))}
        early: dict[str, dict[int, tuple[str, bool]]] = {}
        for (part, seq), chunk in self.early.iterator() if held else ():
            early.setdefault(part, {})[seq] = tuple(chunk)
        out, counted = [], {}
        for part, chunks in fresh.items():
            following, pending, ended = held.get(part, (0, "", False))
            if ended:
                continue
            first, stored = following, early.get(part, {})
            waiting = stored | {k: v for k, v in chunks.items() if k >= following}
            text, refs, following, pending, done, gap = advance(known_needles(self.needles), following, pending, waiting, idle, self.most)
            for seq in stored:
                if done or seq not in waiting:
                    self.early.removeKey((part, seq))
            if not done:
                for seq in waiting.keys() - stored.keys():
                    self.early.updateValue((part, seq), waiting[seq])
            if done and not (self.idle_ms or self.counts):
                if part in held:
                    self.heads.removeKey((part,))
            else:
                self.heads.updateValue((part,), (following, pending, done))
            for ref in refs if self.counts else ():
                counted[ref] = counted.get(ref, 0) + 1
            out.append((part, first, as_text(text), refs, gap))
        if not self.counts:
            columns = dict(zip(("stream_id", "from_seq", "text", "refs", "gap_to"), zip(*out, strict=True), strict=True)) if out else {}
            if out:
                yield pd.DataFrame(columns | {"gap_to": pd.array(columns["gap_to"], dtype="Int64")})
            return
        for ref, n in counted.items():
            counted[ref] = n + (self.hits.getValue((ref,))[0] if self.hits.containsKey((ref,)) else 0)
            self.hits.updateValue((ref,), (counted[ref],))
        if counted:
            yield pd.DataFrame({"stream_id": [key[0]] * len(counted), "ref": list(counted), "n": list(counted.values())})


def _processed(chunks: DataFrame, needles: DataFrame, idle_ms: int | None, most: int, counts: bool) -> DataFrame:
    path = shared_folder(needles.sparkSession, "needles")
    needles.select("pattern", "ref").write.parquet(path)
    # a table, not a part of the code: code of more than 1 MB becomes a broadcast, which the stream's driver worker doesn't load
    processor = Redactor(path, idle_ms, most, counts)
    return chunks.groupBy("key").transformWithStateInPandas(processor, HITS if counts else OUT, "update" if counts else "append", "processingTime" if idle_ms else "none")


def redact_stream(chunks: DataFrame, needles: DataFrame, idle_ms: int | None = None, waiting_chars: int = WAITING) -> DataFrame:
    """(stream_id, from_seq, text, refs, gap_to) from (stream_id, seq, chunk, done): what each batch lets out of each stream.

    Chunks may come in any order and are taken by `seq`, from 0; repeated ones are left out. At the end (`done`) all that waits
    goes out and the state goes too; after `idle_ms` without chunks, if given, all but what has begun to be a secret. All texts
    of a stream in order are what `operators.redact` makes of the whole. What waits is shorter than the longest needle and the
    run of secrets that it touches; chunks that wait for an earlier one hold `waiting_chars` at most, beyond which the missing
    ones are given up: what came before ends there, and `gap_to` names the seq that goes on; chunks of a gap that come later
    are left out. Starting the stream needs the state store of `run.STATE_STORE`; building the plan writes the needles to the
    shared folder, from where each worker reads all of them."""
    return _processed(chunks.select(F.col("stream_id").alias("key"), F.col("stream_id").alias("part"), "seq", "chunk", "done"), needles, idle_ms, waiting_chars, False)


def hits_stream(chunks: DataFrame, needles: DataFrame, waiting_chars: int = WAITING) -> DataFrame:
    """(stream_id, ref, n) from (session, fd, seq, chunk, done), in update mode: how often each ref was shown so far in all the
    outputs of a session, each of which is a stream of its own; `stream_id` is the session. No table stands in between."""
    return _processed(chunks.select(F.col("session").cast("string").alias("key"), F.col("fd").cast("string").alias("part"), "seq", "chunk", "done"), needles, None, waiting_chars, True)


def with_stream_id(chunks: DataFrame) -> DataFrame:
    """Chunks of (session, fd, ...), the outputs of a program, each a stream of its own."""
    return chunks.withColumn("stream_id", F.concat_ws("/", "session", F.col("fd").cast("string")))


def running_hits(redacted: DataFrame, merge: bool = False) -> DataFrame:
    """(stream_id, ref, n) of what `redact_stream` let out, batch or stream (in update mode, from where it was written); with
    `merge`, the outputs of a session are one."""
    stream = F.regexp_replace("stream_id", r"/[^/]*\z", "") if merge else F.col("stream_id")
    return redacted.select(stream.alias("stream_id"), F.explode("refs").alias("ref")).groupBy("stream_id", "ref").agg(F.count("*").alias("n"))


def gate_stream(commands: DataFrame, env: DataFrame) -> DataFrame:
    """The commands of agents, with caller, program and refusal: (session, argv, ...) against the table `env` of sessions."""
    callers = detect_caller(env)
    return check_policy(commands.join(callers, "session").where("caller = 'agent'"))


def refusal_log(gated: DataFrame) -> DataFrame:
    """Refused commands as rows of the audit log, safe to write."""
    return gated.where("refusal is not null").select(F.lit("refused").alias("event"), "caller", F.col("refusal").alias("reason"), redact_command(F.col("argv")).alias("command"))
