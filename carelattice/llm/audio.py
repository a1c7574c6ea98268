"""Chroma fingerprints of recordings in media columns, and their alignment.

A recording becomes frames of 12 pitch-class energies.  Sums over rectangles of that image come from its integral
image; 16 filters compare such sums, each gives two bits, and the 16 pairs make one 32-bit integer for each frame.
Recordings with the same integers form a class.  Halves of integers that two classes share vote for the offset between them;
the bit errors over the overlap at the strongest offset decide whether they are aligned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.session import cut_lineage

RATE, FRAME, HOP = 4096, 1024, 512
LOWEST, HIGHEST, TUNING = 55.0, 1760.0, 440.0
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SPAN = 16  # frames a filter sees at most
# The 16 filters by a rule: shape, lowest pitch class, number of pitch classes, number of frames.
FILTERS = tuple((k % 5, (5 * k) % (13 - (2, 3, 4, 6)[k // 4]), (2, 3, 4, 6)[k // 4], (4, 8, 12, 16)[k % 4]) for k in range(16))
LIMITS = np.array([-0.12, 0.0, 0.12])     # of log((1 + a) / (1 + b)): four levels
GRAY = np.array([0, 1, 3, 2], np.uint32)  # neighbouring levels differ in one bit
# At their best offset foreign melodies mostly differ in over a fifth of the bits, noisy copies in less; frames nearer than SPAN are alike
# by themselves, so a short overlap tells little.
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 2, 24, 0.2
SHARD, BLOCK = 1 << 18, 512  # frames of recordings and queries that meet in one task, about
MEETINGS = 1 << 22           # equal halves of a query and a shard counted in one go, about

Decoder = Callable[[object], np.ndarray | None]  # a media value to samples at RATE, or None


def pcm16(value: object) -> np.ndarray | None:
    """Little-endian signed 16-bit samples; an odd last byte is ignored."""
    return None if value is None else np.frombuffer(value, "<i2", len(value) // 2).astype(np.float32) / 32768


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 pitch-class energies, smoothed over five frames, each frame of unit length; none if too short."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    energy = (np.abs(np.fft.rfft(frames * _window(), axis=1)) ** 2) @ _pitches()
    padded = np.pad(energy, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(s * padded[i:i + len(energy)] for i, s in enumerate(SMOOTHING))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0)


@cache
def _window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


@cache
def _pitches() -> np.ndarray:
    """Frequency bins x pitch classes."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hertz >= LOWEST) & (hertz <= HIGHEST)
    out = np.zeros((len(hertz), 12), np.float32)
    out[np.flatnonzero(use), np.round(12 * np.log2(hertz[use] / TUNING)).astype(int) % 12] = 1
    return out


def integers(image: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame from which SPAN frames follow; none if there are fewer."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)  # the integral image

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return whole[t1:t1 + n, y1] - whole[t0:t0 + n, y1] - whole[t1:t1 + n, y0] + whole[t0:t0 + n, y0]

    out = np.zeros(n, np.uint32)
    for shape, y, high, wide in FILTERS:
        half_y, half_t, third = y + high // 2, wide // 2, max(1, wide // 3)
        total = area(0, wide, y, y + high)
        if shape == 0:    # against the other pitch classes
            a, b = total, area(0, wide, 0, 12) - total
        elif shape == 1:  # low against high
            a = area(0, wide, y, half_y)
            b = total - a
        elif shape == 2:  # early against late
            a = area(0, half_t, y, y + high)
            b = total - a
        elif shape == 3:  # one diagonal against the other
            a = area(0, half_t, y, half_y) + area(half_t, wide, half_y, y + high)
            b = total - a
        else:             # middle against both sides
            a = area(third, wide - third, y, y + high)
            b = total - a
        level = np.searchsorted(LIMITS, np.log((1 + a) / (1 + b)), side="right")
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def fingerprints(media: DataFrame, id_column: str, media_column: str, decode: Decoder = pcm16) -> DataFrame:
    """recording, prints: array of the integers as signed ints, one row per row of ``media``; other columns are not read.
    Null media, and recordings too short for one integer, have an empty array.  Silence has integers like any sound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                samples = decode(value.as_py())
                found.append(integers(chroma(samples)).view(np.int32) if samples is not None else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["recording", "prints"])

    return media.select(F.col(id_column).cast("long").alias("recording"), F.col(media_column).alias("media")).mapInArrow(run, "recording long, prints array<int>")


def classes(prints: DataFrame) -> DataFrame:
    """(class_id, prints): recordings with the same integers; class_id is the smallest recording.  Those without
    integers, and nulls alone, are in no class."""
    return prints.where((F.size("prints") > 0) & F.col("recording").isNotNull()).groupBy("prints").agg(F.min("recording").alias("class_id")).select("class_id", "prints")


class _Votes:
    """Prints of many recordings by the halves of their integers, and what a query has in common with them."""

    def __init__(self, prints: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in prints], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.frames = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        at = np.flatnonzero(_turns(self.frames, self.starts[:-1]))
        keys = _halves(self.frames[at])
        order = np.argsort(keys, kind="stable")
        self.at = np.tile(at, 2)[order]
        self.first = np.searchsorted(keys[order], np.arange(2 ** 17 + 1))
        self.owner = np.repeat(np.arange(len(prints)), self.sizes)

    def offsets(self, query: np.ndarray, min_votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recording, offset, votes) of each recording's strongest offset with so many votes; ties go to the smaller
        absolute offset, then the smaller."""
        own = np.flatnonzero(_turns(query, np.zeros(1, np.int64)[:len(query)]))
        keys, mine = _halves(query[own]), np.tile(own, 2)
        lo, n = self.first[keys], self.first[keys + 1] - self.first[keys]
        span = len(query) + int(self.sizes.max(initial=0)) + 1
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.append(np.flatnonzero(np.diff(np.append(-1, np.cumsum(n) // MEETINGS))), len(n))
        for some in map(slice, cuts[:-1], cuts[1:]):
            taken = n[some]
            at = self.at[np.repeat(lo[some] - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())]
            who = self.owner[at]
            new, times = np.unique(who * span + (at - self.starts[who]) - np.repeat(mine[some], taken) + len(query), return_counts=True)
            codes, place = np.unique(np.append(codes, new), return_inverse=True)
            counts = np.bincount(place, np.append(counts, times), len(codes)).astype(np.int64)
        codes, counts = codes[counts >= min_votes], counts[counts >= min_votes]
        who, offset = codes // span, codes % span - len(query)
        order = np.lexsort((offset, np.abs(offset), -counts, who))
        best = order[np.append(True, np.diff(who[order]) > 0)[:len(order)]]
        return who[best], offset[best], counts[best]

    def errors(self, query: np.ndarray, who: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(overlap, bit errors over it) at the given offsets."""
        skip = np.maximum(0, -offset)
        begin = np.maximum(0, offset)
        overlap = np.minimum(len(query) - skip, self.sizes[who] - begin)
        ends = np.cumsum(overlap)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - overlap, overlap)
        wrong = np.bitwise_count(query[np.repeat(skip, overlap) + step] ^ self.frames[np.repeat(self.starts[who] + begin, overlap) + step])
        total = np.append(0, np.cumsum(wrong, dtype=np.int64))
        return overlap, total[ends] - total[ends - overlap]


def _turns(frames: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a frame differs from the one before it, or begins a recording."""
    out = np.append(True, frames[1:] != frames[:-1])[:len(frames)]
    out[starts[starts < len(frames)]] = True
    return out


def _halves(frames: np.ndarray) -> np.ndarray:
    """The upper halves, then the lower ones, told apart."""
    return np.concatenate([frames >> np.uint32(16), (frames & np.uint32(0xFFFF)) | np.uint32(1 << 16)]).astype(np.int64)


def align(every: DataFrame, queries: DataFrame, min_votes: int = MIN_VOTES, min_overlap: int = MIN_OVERLAP, max_error: float = MAX_ERROR) -> DataFrame:
    """query_class, class_id, offset, votes, overlap, bit_errors of the aligned pairs of different classes.

    ``every`` and ``queries``: (class_id, prints).  Frame i of the query is frame i + offset of the other.  Equal halves of
    integers vote for an offset, so an integer with wrong bits in one half still votes; of equal integers in a row only the first
    does.  Votes only propose: the strongest offset is taken if the bit errors over the overlap are few enough.  A pair of queries is
    found from both sides.  Recordings in shards and queries in blocks meet as pairs, so a frequent integer is
    counted within a task and not joined with itself."""
    frames = every.agg(F.sum(F.size("prints"))).first()[0] or 0
    shards, blocks = max(1, -(-frames // SHARD)), max(1, -(-queries.count() // BLOCK))

    def pair(shard: pa.Table, block: pa.Table) -> pa.Table:
        ids, found = shard["other_id"].to_numpy(), []
        if len(ids) and len(block):
            votes = _Votes(_prints(shard["other"]))
            for own, query in zip(block["query_class"].to_pylist(), _prints(block["prints"])):
                who, offset, counts = votes.offsets(query, min_votes)
                overlap, wrong = votes.errors(query, who, offset)
                keep = (overlap >= min_overlap) & (wrong <= overlap * 32 * max_error) & (ids[who] != own)
                found.append([x[keep] for x in (np.full(len(who), own), ids[who], offset, counts, overlap, wrong)])
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(6)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns)})

    names = ["query_class", "class_id", "offset", "votes", "overlap", "bit_errors"]
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = every.select(F.col("class_id").alias("other_id"), F.col("prints").alias("other"), dealt("class_id", shards).alias("shard"), each(blocks).alias("block"))
    right = queries.select(F.col("class_id").alias("query_class"), F.col("prints").alias("prints"), dealt("class_id", blocks).alias("block"), each(shards).alias("shard"))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(pair, ", ".join(f"{n} long" for n in names))
    return met.select("query_class", "class_id", *(F.col(n).cast("long" if n == "votes" else "int").alias(n) for n in names[2:]))


def _prints(lists: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint32) for chunk in lists.chunks for x in chunk]


def search(prints: DataFrame, is_query) -> DataFrame:
    """Membership and links in one table.  kind "member": recording, class_id, frames.  kind "link": query_class, class_id, offset,
    votes, overlap, bit_errors, between classes; copies are not expanded into pairs.

    ``is_query``: a condition on recording; a class with a query among its members is searched against all classes."""
    known = cut_lineage(classes(prints))
    members = prints.join(known, "prints", "left")
    asked = members.where(is_query & F.col("class_id").isNotNull()).select("class_id").distinct()
    links = align(known, known.join(asked, "class_id", "left_semi"))
    member = members.select(F.lit("member").alias("kind"), "recording", "class_id", F.size("prints").alias("frames"))
    return member.unionByName(links.withColumn("kind", F.lit("link")), allowMissingColumns=True)


def melody(vector: list[float] | None) -> np.ndarray | None:
    """A vector as sound: each component a note of HOP samples, its pitch by the component's size and sign.  Null
    vectors are no recording; null and non-finite components are rests."""
    if vector is None:
        return None
    x = np.array([np.nan if v is None else v for v in vector], dtype=float)
    sounds = np.isfinite(x)
    step = np.clip(np.round(np.where(sounds, x, 0) * 48), -18, 18)  # semitones around 440 Hz
    time = np.arange(HOP) / RATE
    hertz = TUNING * 2 ** (step / 12)
    return ((np.sin(2 * np.pi * hertz[:, None] * time) * 0.5) * sounds[:, None]).astype(np.float32).ravel()
