"""Telephony audio columns: 8-bit mu-law, A-law and IMA ADPCM in WAV containers.

store() writes a payload byte for byte as samples of one codec into a table of the shared
folder; decode() expands mu-law and A-law by lookup tables, decodes ADPCM block-parallel in
numpy (one step of all blocks at a time) and resamples to 16 kHz PCM, which store_pcm() writes
as a table too; digest() reads the stored bytes back and describes them and their PCM.

Defined results: a null text is an empty one; a payload is filled up with blanks to a
positive multiple of 192 bytes; equal texts give equal bytes; an empty table gives no rows;
repeated rows are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import bounded_batches, gathered, materialize, text_or_empty

UNIT = 192
RATE, TARGET_RATE = 8000, 16000
CODECS = ("mulaw", "alaw", "adpcm")
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: Fixed values of the IMA ADPCM format: step sizes, and index changes by code.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """The 256 mu-law codes' linear values, from the rule of G.711."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 A-law codes' linear values, from the rule of G.711."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent = code >> 4 & 7
    size = ((code & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Blocks of UNIT bytes, a row each -> a row of 1 + 2 * (UNIT - 4) samples for each."""
    n = len(blocks)
    out = np.empty((1 + 2 * (UNIT - 4), n), np.int16)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0]
    value = head.astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(body.shape[0]):
        for half, code in enumerate((body[k] & 15, body[k] >> 4)):
            step = STEPS[index]
            change = step >> 3
            change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = value
    return out.T


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file that holds payload as this codec's samples."""
    if codec == "adpcm":
        per_block = 1 + 2 * (UNIT - 4)
        fmt = struct.pack("<HHIIHHHH", 17, 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
        samples = len(payload) // UNIT * per_block
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
        samples = len(payload)
    chunks = b"".join(
        name + struct.pack("<I", len(data)) + data
        for name, data in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload))
    )
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and sample bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, ""
    while at < len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _half_filter(taps: int = 8) -> np.ndarray:
    """Windowed sinc that gives the sample halfway between two."""
    at = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / (taps / 2 + 0.5)))
    return np.round(h / h.sum() * 16384).astype(np.int64)


HALF = _half_filter()


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, and the filtered value halfway to the next (edges held)."""
    n, taps = len(pcm), len(HALF)
    wide = np.concatenate([np.full(taps // 2 - 1, pcm[0]), pcm, np.full(taps // 2, pcm[-1])]).astype(np.int32)
    between = np.zeros(n, np.int32)
    for k, weight in enumerate(HALF.tolist()):
        between += wide[k : k + n] * np.int32(weight)
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((between + 8192) >> 14, -32768, 32767)
    return out


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def codec_of(payload: bytes) -> str:
    """The default choice, by content: so equal texts are stored alike."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def decoded(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, stored bytes and 16 kHz PCM of WAV files; all ADPCM blocks are decoded together."""
    read = [read_wav(m) for m in media]
    own = [k for k, (codec, _) in enumerate(read) if codec == "adpcm"]
    pcm: dict[int, np.ndarray] = {}
    if own:
        blocks = np.frombuffer(b"".join(read[k][1] for k in own), np.uint8).reshape(-1, UNIT)
        samples, at = decode_adpcm(blocks), 0
        for k in own:
            n = len(read[k][1]) // UNIT
            pcm[k] = samples[at : at + n].ravel()
            at += n
    for k, (codec, data) in enumerate(read):
        if codec != "adpcm":
            pcm[k] = TABLES[codec][np.frombuffer(data, np.uint8)]
    return [(codec, data, resample(pcm[k])) for k, (codec, data) in enumerate(read)]


def store(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media: each text as a stored WAV file of one codec (default: by content)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            texts = [t.as_buffer().to_pybytes() for t in text_or_empty(batch).cast(pa.large_binary())]
            payloads = [payload_of(t) for t in texts]
            media = [wav(codec or codec_of(p), p) for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    with bounded_batches(docs.sparkSession):
        return materialize(docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary"), "media")


def decode(stored: DataFrame) -> DataFrame:
    """doc_id, codec, rate, pcm: the stored audio as 16-bit PCM at the target rate."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, mb=4):
            rows = decoded(batch.column("media").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c for c, _, _ in rows]),
                 pa.array([TARGET_RATE] * len(rows), pa.int32()), pa.array([p.astype("<i2").tobytes() for _, _, p in rows])],
                ["doc_id", "codec", "rate", "pcm"],
            )

    return stored.select("doc_id", "media").mapInArrow(read, "doc_id long, codec string, rate int, pcm binary")


def store_pcm(stored: DataFrame) -> DataFrame:
    """The table of decode(), written and read again."""
    with bounded_batches(stored.sparkSession, mb=4):
        return materialize(decode(stored), "pcm")


def feature_of(codec: str, pcm: np.ndarray) -> str:
    """Codec, rate, samples, root mean square, sign changes, checksum of the resampled PCM."""
    wide = pcm.astype(np.int64)
    rms = math.isqrt(int(wide @ wide) // len(pcm))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{TARGET_RATE}:{len(pcm)}:{rms}:{turns}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def digest(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back from them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, mb=4):
            media = batch.column("media").to_pylist()
            rows = decoded(media)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"),
                 pa.array([len(d) for _, d, _ in rows], pa.int64()),
                 pa.array([hashlib.sha256(d).hexdigest() for _, d, _ in rows]),
                 pa.array([zlib.crc32(d[-16:]) for _, d, _ in rows], pa.int64()),
                 pa.array([len(m) for m in media], pa.int64()),
                 pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                 pa.array([feature_of(c, p) for c, _, p in rows])],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                 "feature"],
            )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )
