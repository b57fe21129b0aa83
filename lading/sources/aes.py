"""AES over many blocks at once, and the key derivations of archive formats. numpy only,
so that encrypted members can be read where no cryptography package is installed."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np

from lading.errors import Corrupt, Encrypted


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The S-box from inverses in GF(2^8), its inverse, and products by 1 to 15."""
    def mul(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = (a << 1) ^ (0x11B if a & 0x80 else 0), b >> 1
        return out

    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if mul(a, b) == 1)
            inverse[a], inverse[b] = b, a
    turn = lambda x, n: (x << n | x >> (8 - n)) & 255
    box = np.array([x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse], np.uint8)
    back = np.empty(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back, np.array([[mul(a, b) for a in range(256)] for b in range(15)], np.uint8)


_BOX, _BACK, _MUL = _tables()
#: Row r of the state turns by r columns; bytes stand in columns.
_ROWS = np.array([(c + r) % 4 * 4 + r for c in range(4) for r in range(4)])
_UNROWS = np.argsort(_ROWS)


class Aes:
    """The block cipher for keys of 16, 24 or 32 bytes; blocks are rows of 16 bytes."""

    def __init__(self, key: bytes):
        n, rounds = len(key) // 4, len(key) // 4 + 6
        words, power = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        for i in range(n, 4 * (rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = [int(_BOX[x]) for x in w[1:] + w[:1]]
                w[0] ^= power
                power = int(_MUL[2][power])
            elif n > 6 and i % n == 4:
                w = [int(_BOX[x]) for x in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = np.array(words, np.uint8).reshape(rounds + 1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.keys[0]
        for k in self.keys[1:-1]:
            s = _BOX[s][:, _ROWS].reshape(-1, 4, 4)
            two, three = _MUL[2][s], _MUL[3][s]
            s = (two ^ np.roll(three, -1, 2) ^ np.roll(s, -2, 2) ^ np.roll(s, -3, 2)).reshape(-1, 16) ^ k
        return _BOX[s][:, _ROWS] ^ self.keys[-1]

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = _BACK[(blocks ^ self.keys[-1])[:, _UNROWS]]
        for k in self.keys[-2:0:-1]:
            s = (s ^ k).reshape(-1, 4, 4)
            s = _MUL[14][s] ^ np.roll(_MUL[11][s], -1, 2) ^ np.roll(_MUL[13][s], -2, 2) ^ np.roll(_MUL[9][s], -3, 2)
            s = _BACK[s.reshape(-1, 16)[:, _UNROWS]]
        return s ^ self.keys[0]


def counter_mode(cipher: Aes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Counter mode with a little-endian counter from 1, its own inverse."""
    block, held = 1, b""
    for data in chunks:
        data = held + data
        whole = len(data) // 16 * 16
        for part in filter(None, (data[:whole],)):
            n = whole // 16
            count = np.zeros((n, 16), np.uint8)
            count[:, :8] = np.arange(block, block + n, dtype="<u8").view(np.uint8).reshape(n, 8)
            yield (np.frombuffer(part, np.uint8) ^ cipher.encrypt(count).ravel()).tobytes()
            block += n
        held = data[whole:]
    if held:
        count = np.zeros((1, 16), np.uint8)
        count[0, :8] = np.array([block], "<u8").view(np.uint8)
        yield (np.frombuffer(held, np.uint8) ^ cipher.encrypt(count).ravel()[: len(held)]).tobytes()


def chained_decrypt(key: bytes, start: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cipher block chaining; a rest of less than a block is corruption."""
    cipher, before, held = Aes(key), np.frombuffer(start, np.uint8), b""
    for data in chunks:
        data = held + data
        whole = len(data) // 16 * 16
        held = data[whole:]
        if whole:
            blocks = np.frombuffer(data[:whole], np.uint8).reshape(-1, 16)
            yield (cipher.decrypt(blocks) ^ np.vstack([before, blocks[:-1]])).tobytes()
            before = blocks[-1]
    if held:
        raise Corrupt("encrypted data isn't whole blocks")


def _winzip_start(chunks: Iterator[bytes], size: int, strength: int, password: bytes) -> tuple[bytes, bytes, Iterator[bytes]]:
    """Keys under a password that the check bytes let pass, and what follows these."""
    length = {1: 16, 2: 24, 3: 32}[strength]
    if size < length // 2 + 12:
        raise Corrupt("the encrypted member is too short")
    head, data = b"", iter(chunks)
    while len(head) < length // 2 + 2:
        head += next(data)
    salt, check, rest = head[: length // 2], head[length // 2 : length // 2 + 2], head[length // 2 + 2 :]
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * length + 2)
    if keys[-2:] != check:
        raise Encrypted("the password's check bytes differ")
    return keys, rest, data


def winzip_passes(chunks: Iterator[bytes], size: int, strength: int, password: bytes) -> bool:
    """Whether the check bytes let a password pass; one in 65,536 wrong ones does."""
    try:
        return bool(_winzip_start(chunks, size, strength, password))
    except Encrypted:
        return False


def winzip_encrypted(chunks: Iterator[bytes], size: int, strength: int, password: bytes) -> tuple[bytes, Iterator[bytes]]:
    """The key, and a member's data still encrypted, held against its authentication code as it is read."""
    length = {1: 16, 2: 24, 3: 32}[strength]
    keys, rest, data = _winzip_start(chunks, size, strength, password)
    code, left = hmac.new(keys[length : 2 * length], digestmod="sha1"), size - length // 2 - 2 - 10

    def body() -> Iterator[bytes]:
        nonlocal left, rest
        part = rest
        while left:
            part = part or next(data, b"")
            if not part:
                raise Corrupt("the encrypted member ends early")
            use, part = part[:left], part[left:]
            left -= len(use)
            code.update(use)
            yield use
        tail = part + b"".join(data)
        if not hmac.compare_digest(code.digest()[:10], tail[:10]):
            raise Corrupt("the member's authentication code differs")

    return keys[:length], body()


def winzip(chunks: Iterator[bytes], size: int, strength: int, password: bytes) -> Iterator[bytes]:
    """A WinZip AES member: salt, two check bytes, data, ten bytes of authentication."""
    key, body = winzip_encrypted(chunks, size, strength, password)
    return counter_mode(Aes(key), body)


def sevenzip_key(properties: bytes, password: bytes) -> tuple[bytes, bytes]:
    """Key and initial vector of a 7z AES coder: SHA-256 over 2^n rounds of salt, password and a counter."""
    first = properties[0]
    rounds, has_salt, has_iv = first & 63, first >> 7 & 1, first >> 6 & 1
    second = properties[1] if len(properties) > 1 else 0
    n_salt, n_iv = has_salt + (second >> 4), has_iv + (second & 15)
    salt, iv = properties[2 : 2 + n_salt], properties[2 + n_salt : 2 + n_salt + n_iv]
    wide = password.decode("utf-8", "surrogateescape").encode("utf-16-le", "surrogatepass")
    if rounds == 63:
        return (salt + wide).ljust(32, b"\0")[:32], iv.ljust(16, b"\0")
    if rounds > 24:
        raise Corrupt(f"2^{rounds} rounds of key derivation")
    h, step = hashlib.sha256(), 1 << min(rounds, 12)
    for i in range(0, 1 << rounds, step):
        h.update(b"".join(salt + wide + k.to_bytes(8, "little") for k in range(i, i + step)))
    return h.digest(), iv.ljust(16, b"\0")


def rar5_keys(password: bytes, salt: bytes, rounds: int) -> tuple[bytes, bytes, bytes]:
    """Key, the key that checksums are mixed with, and the password check value."""
    if rounds > 24:
        raise Corrupt(f"2^{rounds} rounds of key derivation")
    one, n = [], 1 << rounds
    u = hmac.new(password, salt + b"\0\0\0\1", "sha256").digest()
    total, base = int.from_bytes(u, "big"), hmac.new(password, digestmod="sha256")
    for k in range(1, n + 32):
        if k in (n, n + 16):
            one.append(total.to_bytes(32, "big"))
        h = base.copy()
        h.update(u)
        u = h.digest()
        total ^= int.from_bytes(u, "big")
    one.append(total.to_bytes(32, "big"))
    check = np.frombuffer(one[2], np.uint8).reshape(4, 8)
    return one[0], one[1], np.bitwise_xor.reduce(check, 0).tobytes()


def rar5_mixed_crc(crc: int, key: bytes) -> int:
    """What an encrypted RAR 5 member stores in place of its CRC-32."""
    digest = hmac.new(key, crc.to_bytes(4, "little"), "sha256").digest()
    return int(np.bitwise_xor.reduce(np.frombuffer(digest, "<u4")))


def rar5_mixed_blake(digest: bytes, key: bytes) -> bytes:
    return hmac.new(key, digest, "sha256").digest()
