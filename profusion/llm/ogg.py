"""Media columns: Ogg containers written to and read from binary columns.

``mux`` writes logical streams of timed packets as Ogg pages, interleaved by time; ``demux`` verifies each
page's checksum, keeps the streams apart by serial number, puts packets together from the lacing values
(over page ends too) and derives times from granule positions. The stored form of a payload is a PCM
stream of unsigned 8-bit samples at 8 kHz beside a stream of one mark per second.

Defined cases: a null or empty text has the empty payload, padded to one block; equal payloads have equal
bytes, whatever their ids; damaged bytes, streams without a last page, and headers that make no sense raise
``OggError`` in ``demux`` or ``load`` and give a null row with the reason in ``read_media``; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from profusion.llm.common import slices, task

RATE, BLOCK, PACKET, PAGE_SEGMENTS = 8000, 192, 4096, 255
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_PCM = struct.Struct(">8sHHIIBBHI")
_PCM_MAGIC, _MARK_MAGIC = b"PCM     ", b"MARKS   "
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(data: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, no inversion.

    It is the common CRC-32 of the bit-reversed bytes, itself bit-reversed, with the inversions undone.
    """
    crc = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Stream:
    """A logical stream: packets, and for each the granule position at its end."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)


def _pages(s: Stream) -> Iterator[tuple[int, bytes]]:
    """(granule, page) of a stream; the first packet has a page of its own."""
    segments, body, flags, number, granule = [], [], FIRST, 0, -1

    def page(last: bool) -> tuple[int, bytes]:
        head = _HEAD.pack(b"OggS", 0, flags | (LAST if last else 0), granule, s.serial, number, 0, len(segments)) + bytes(segments)
        data = b"".join(body)
        crc = checksum(head + data)
        return granule, head[:22] + crc.to_bytes(4, "little") + head[26:] + data

    for i, (packet, end) in enumerate(zip(s.packets, s.granules, strict=True)):
        at, more = 0, True
        while more:
            take = packet[at : at + 255]
            segments.append(len(take))
            body.append(take)
            at, more = at + len(take), len(take) == 255
            done = not more
            if done:
                granule = end
            final = done and i == len(s.packets) - 1
            if len(segments) == PAGE_SEGMENTS or final or (done and i == 0):
                yield page(final)
                segments, body, number, granule = [], [], number + 1, -1
                flags = 0 if done else CONTINUED


def mux(streams: list[Stream], rate: dict[int, int]) -> bytes:
    """The pages of all streams: first pages first, then by time."""
    every = []
    for k, s in enumerate(streams):
        time = 0.0
        for n, (granule, page) in enumerate(_pages(s)):
            time = granule / rate[s.serial] if granule >= 0 else time
            every.append((n > 0, time, k, n, page))
    return b"".join(x[-1] for x in sorted(every, key=lambda x: x[:4]))


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number."""
    out: dict[int, Stream] = {}
    partial: dict[int, list[bytes]] = {}
    number: dict[int, int] = {}
    over: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError(f"cut off at byte {at}")
        magic, version, flags, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"cut off at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if bool(flags & FIRST) == (serial in out) or seq != number.get(serial, -1) + 1:
            raise OggError(f"page {seq} of stream {serial} is out of order")
        if serial in over:
            raise OggError(f"stream {serial} goes on after its last page")
        if flags & LAST:
            over.add(serial)
        number[serial] = seq
        stream, parts = out.setdefault(serial, Stream(serial)), partial.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(parts):
            raise OggError(f"a packet of stream {serial} has lost a part")
        pos, ended = at + 27 + n, 0
        for length in lacing:
            parts.append(data[pos : pos + length])
            pos += length
            if length < 255:
                stream.packets.append(b"".join(parts))
                parts.clear()
                ended += 1
        # Only the last packet that ends on a page has a granule position.
        stream.granules.extend([-1] * max(0, ended - 1) + [granule] * bool(ended))
        at = end
    if any(partial.values()):
        raise OggError("a stream ends within a packet")
    if cut := set(out) - over:
        raise OggError(f"stream {min(cut)} has no last page")
    return out


def times(s: Stream, rate: int, samples: list[int]) -> list[float]:
    """Start time of each packet in seconds, from the granule positions and the packets' lengths.

    Lengths count back from each known position to the packets before it on the same page.
    """
    ends: list[int] = [0] * len(samples)
    known = None
    for i in range(len(samples) - 1, -1, -1):
        if s.granules[i] < 0 and known is None:
            raise OggError(f"stream {s.serial} has no granule position at its end")
        known = s.granules[i] if s.granules[i] >= 0 else known - samples[i + 1]
        ends[i] = known
    return [(e - n) / rate for e, n in zip(ends, samples, strict=True)]


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def store(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono PCM in Ogg, beside one mark per second."""
    serial = zlib.crc32(payload)
    pcm = Stream(serial, [_PCM.pack(_PCM_MAGIC, 0, 0, 1, RATE, 8, 1, PACKET, 0)], [0])
    for i in range(0, len(payload), PACKET):
        pcm.packets.append(payload[i : i + PACKET])
        pcm.granules.append(min(i + PACKET, len(payload)))
    marks = Stream(serial ^ 0xFFFFFFFF, [_MARK_MAGIC + RATE.to_bytes(4, "big")], [0])
    for t in range(0, len(payload), RATE):
        marks.packets.append(f"{t // RATE}".encode())
        marks.granules.append(t)
    return mux([pcm, marks], {pcm.serial: RATE, marks.serial: RATE})


def load(media: bytes) -> tuple[bytes, dict[str, float]]:
    """The payload read back from the stored bytes, and what the container says."""
    streams = demux(media)
    audio = next((s for s in streams.values() if s.packets and s.packets[0].startswith(_PCM_MAGIC)), None)
    if audio is None:
        raise OggError("no PCM stream")
    if len(audio.packets[0]) != _PCM.size:
        raise OggError("the PCM header has another length")
    _, _, _, _, rate, bits, channels, _, _ = _PCM.unpack(audio.packets[0])
    if bits != 8 or channels != 1 or not rate:
        raise OggError("not 8-bit mono with a rate")
    payload = b"".join(audio.packets[1:])
    start = times(audio, rate, [0, *map(len, audio.packets[1:])])
    return payload, {"streams": len(streams), "packets": sum(len(s.packets) for s in streams.values()), "rate": rate, "seconds": len(payload) / rate, "last": start[-1]}


def feature(payload: bytes, about: dict[str, float]) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    return f"streams={about['streams']};packets={about['packets']};rate={about['rate']};seconds={about['seconds']:.6f};last={about['last']:.6f};mean={x.mean():.4f};rms={rms:.4f};peak={int(np.abs(x).max())};crossings={crossings}"


_DIGEST = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(text: str | None) -> tuple:
    payload, n = padded(text)
    media = store(payload)
    back, about = load(media)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return n, len(back), sha(back), zlib.crc32(back[-16:]), len(media), sha(media), feature(back, about)


def media_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns per document: sizes, digests and features of the stored and reread payload."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                cols = list(zip(*map(_digest, batch.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, _DIGEST, strict=True))], names=["doc_id", *_DIGEST.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): the text's padded payload as Ogg."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([store(padded(t)[0]) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, payload (binary) and error (string, null if sound) from a media column."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                out = []
                for m in batch.column("media").to_pylist():
                    try:
                        out.append((load(m)[0], None) if m is not None else (None, "no media"))
                    except OggError as e:
                        out.append((None, str(e)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "payload", "error"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, payload binary, error string")
