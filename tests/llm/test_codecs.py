"""Codecs and tokenizers against plain versions and round trips."""

import base64
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from corefold.llm import byte_bpe, media, token_files

ODD = ["", " ", "a", "ab 's it's\n\n x  ", "é ́x İI ß", "a" * 3000, " " * 99, "\x1c\x1d\x85 　x", "中文🙂हि १２³½", "<|endoftext|> x<|startoftext|>", "tab\tand\r\nline"]


def random_texts(n, seed=5):
    draw = random.Random(seed)
    letters = "ab 'sT\n\t\x1c\x85 　  १２²½éЖ中文🙂़हि12.,!?-- "
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(n)]


def padded(text):
    raw = text.encode()
    return raw.ljust(max(-(-len(raw) // 192), 1) * 192, b" ")


@pytest.mark.parametrize("size", [192, 384, 192 * 17, 192 * 500])
def test_image_keeps_every_byte(size):
    data = [random.Random(size + i).randbytes(size) for i in range(3)]
    assert [p for p, _ in media.read_media([media.write_media(x) for x in data])] == data


def test_long_payload_becomes_frames(monkeypatch):
    monkeypatch.setattr(media, "FRAME_BYTES", 192 * 40)
    data = random.Random(1).randbytes(192 * 101)
    stored = media.write_media(data)
    assert stored.count(b"\xff\xd8\xff\xfe") == 3
    ((payload, rgb),) = media.read_media([stored])
    assert payload == data and rgb.shape[1:] == (256, 3)


def test_pixels_do_not_depend_on_the_batch():
    data = [padded(t) for t in ODD + random_texts(30)]
    stored = [media.write_media(x) for x in data]
    together = media.read_media(stored)
    for one, (payload, rgb) in zip(stored, together):
        ((alone, pixels),) = media.read_media([one])
        assert alone == payload and (pixels == rgb).all()


class Bits:
    """Bit-at-a-time writer of the reference streams below."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes().replace(b"\xff", b"\xff\x00")


#: Eight-bit codes for all symbols that the sparse images use.
SYMBOLS = [r << 4 | s for r in range(16) for s in (1, 2, 3)] + [r << 4 for r in range(16)]
TABLE = (bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8), bytes(SYMBOLS))


def sparse_image(blocks):
    """A grey progressive image of sparse blocks: one DC scan, a first and a
    refining scan of 1 to 63, written by the plain rules of the format."""
    code = {s: i for i, s in enumerate(SYMBOLS)}
    dc, first, later = Bits(), Bits(), Bits()
    last = 0
    for b in blocks:
        diff = int(b[0]) - last
        last = int(b[0])
        size = abs(diff).bit_length()
        dc.put(size, 4)
        dc.put(diff if diff >= 0 else diff + (1 << size) - 1, size)
    run = 0

    def flush(out, n):
        if n:
            power = n.bit_length() - 1
            out.put(code[power << 4], 8)
            out.put(n - (1 << power), power)

    for b in blocks:
        r = 0
        coarse = [int(np.sign(v)) * (abs(int(v)) >> 1) for v in b]
        for k in range(1, 64):
            v = coarse[k]
            if not v:
                r += 1
                continue
            flush(first, run)
            run = 0
            while r > 15:
                first.put(code[0xF0], 8)
                r -= 16
            size = abs(v).bit_length()
            first.put(code[r << 4 | size], 8)
            first.put(v if v > 0 else v + (1 << size) - 1, size)
            r = 0
        if r:
            run += 1
    flush(first, run)
    for b in blocks:  # no run over several blocks here: each closes by itself
        r, held = 0, []
        fresh = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        for k in range(1, 64):
            v = int(b[k])
            if abs(v) > 1:
                held.append(abs(v) & 1)
            elif v == 0:
                r += 1
                if r == 16 and any(f > k for f in fresh):
                    later.put(code[0xF0], 8)
                    later.bits += held
                    r, held = 0, []
            else:
                later.put(code[r << 4 | 1], 8)
                later.put(int(v > 0), 1)
                later.bits += held
                r, held = 0, []
        if r or held:
            later.put(code[0x00], 8)
            later.bits += held
    n = len(blocks)
    segment = media._segment
    return b"".join([
        b"\xff\xd8", segment(0xDB, bytes([0]) + bytes([3]) * 64), segment(0xC2, struct.pack(">BHHB", 8, 8, 8 * n, 1) + bytes([1, 0x11, 0])),
        segment(0xC4, bytes([0]) + bytes([0, 0, 0, 15] + [0] * 12) + bytes(range(15))), segment(0xC4, bytes([0x10]) + TABLE[0] + TABLE[1]),
        segment(0xDA, bytes([1, 1, 0, 0, 0, 0])), dc.done(), segment(0xDA, bytes([1, 1, 0, 1, 63, 1])), first.done(),
        segment(0xDA, bytes([1, 1, 0, 1, 63, 0x10])), later.done(), b"\xff\xd9",
    ])


def test_sparse_scans_with_zero_runs_and_ended_blocks():
    draw = np.random.default_rng(3)
    for share in (0.0, 0.03, 0.2, 0.9):
        blocks = np.where(draw.random((9, 64)) < share, draw.integers(-15, 16, (9, 64)), 0)
        blocks[:, 0] = draw.integers(-200, 200, 9)
        image = media.Image(sparse_image(blocks), 0)
        (coef,) = media.read_coefficients([image])
        assert (coef == blocks).all()


def test_inverse_transform_matches_the_formula():
    coef = np.zeros((1, 64), np.int64)
    coef[0, :5] = [80, -31, 12, 7, 44]
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.where(u == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    square = np.zeros(64)
    square[media.ZIGZAG] = coef[0]
    wanted = np.clip(np.round(basis.T @ square.reshape(8, 8) @ basis) + 128, 0, 255)
    image = media.Image(sparse_image(np.zeros((1, 64), np.int64)), 0)
    image.quant[0] = np.ones(64, np.int64)
    assert abs(media.to_pixels([image], [coef])[0].reshape(8, 8) - wanted).max() <= 1


@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe_equals_tiktoken(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = ODD + random_texts(2000)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_byte_bpe_table_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 20)
    own = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = random_texts(300)
    assert [own.decode(x) for t in texts for x in own.encode([t])] == [t.encode() for t in texts]
    assert len(own.seen) < 100


def test_word_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ODD + random_texts(2000)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_word_encoder_splits_where_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    blanks = [chr(c) for c in (*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [f"one{b}two.{b}{b}3{b}!four" for b in blanks]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_encoder_joins_marks_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    longer = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and len(chr(c).lower()) > 1]
    texts = [f"{word}{mark} geldi" for word in ["AL\u0130", "\u0130", "a\u0130b", *longer] for mark in ".,;:!?"]
    assert longer and own.lowers
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_control_bytes_round_trip():
    draw = np.random.default_rng(1)
    ids = [np.array(x, np.uint32) for x in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], draw.integers(0, 2**32, 1001), [])]
    packed = token_files.pack(ids)
    assert len(packed[2][0]) == 2 and len(packed[2][1]) == 1 + 2 + 2 + 3 + 3 + 4 + 4
    back = token_files.unpack([c for c, _ in packed], [d for _, d in packed], [len(x) for x in ids])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(ids, back))
