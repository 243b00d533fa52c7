"""Standard security handler: RC4 of 40 to 128 bits, AES-128 and AES-256; passwords of user and owner."""

from __future__ import annotations

import hashlib
import hmac

from folioflow.pdf.objects import PdfError

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = byte ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= (p << 1) ^ (0x11B if p & 0x80 else 0)
        p &= 255
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 0x80:
            q ^= 0x09
        rot = lambda n: ((q << n) | (q >> (8 - n))) & 255  # noqa: B023, E731
        box[p] = q ^ rot(1) ^ rot(2) ^ rot(3) ^ rot(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inverse = [0] * 256
    for i, v in enumerate(box):
        inverse[v] = i
    return box, inverse


BOX, INVERSE = _boxes()
_M = {k: [_times(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[list[int]]:
    words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
    n, rcon = len(words), 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1][:]
        if i % n == 0:
            w = [BOX[b] for b in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            w = [BOX[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


def _decrypt_block(block: bytes, keys: list[list[int]]) -> list[int]:
    s = [a ^ b for a, b in zip(block, keys[-1])]
    for r in range(len(keys) - 2, -1, -1):
        s = [INVERSE[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
        s = [a ^ b for a, b in zip(s, keys[r])]
        if r:
            out = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                out += [
                    _M[14][a] ^ _M[11][b] ^ _M[13][d] ^ _M[9][e], _M[9][a] ^ _M[14][b] ^ _M[11][d] ^ _M[13][e],
                    _M[13][a] ^ _M[9][b] ^ _M[14][d] ^ _M[11][e], _M[11][a] ^ _M[13][b] ^ _M[9][d] ^ _M[14][e],
                ]
            s = out
    return s


def _encrypt_block(block: list[int], keys: list[list[int]]) -> list[int]:
    s = [a ^ b for a, b in zip(block, keys[0])]
    for r in range(1, len(keys)):
        s = [BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if r < len(keys) - 1:
            out = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                out += [_M[2][a] ^ _M[3][b] ^ d ^ e, a ^ _M[2][b] ^ _M[3][d] ^ e, a ^ b ^ _M[2][d] ^ _M[3][e], _M[3][a] ^ b ^ d ^ _M[2][e]]
            s = out
        s = [a ^ b for a, b in zip(s, keys[r])]
    return s


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """CBC with the first block as the initial vector; a valid PKCS padding is taken off."""
    if len(data) < 32 or len(data) % 16:
        if len(data) < 32:
            return b""
        data = data[: len(data) // 16 * 16]
    keys, out = _round_keys(key), bytearray()
    for i in range(16, len(data), 16):
        out += bytes(a ^ b for a, b in zip(_decrypt_block(data[i : i + 16], keys), data[i - 16 : i]))
    n = out[-1]
    return bytes(out[:-n]) if 1 <= n <= 16 and out[-n:] == bytes((n,)) * n else bytes(out)


def aes_encrypt(key: bytes, data: bytes, iv: bytes, pad: bool = True) -> bytes:
    """The initial vector, then the blocks."""
    n = 16 - len(data) % 16
    data, keys, out = data + bytes((n,)) * n if pad else data, _round_keys(key), bytearray(iv)
    for i in range(0, len(data), 16):
        out += bytes(_encrypt_block([a ^ b for a, b in zip(data[i : i + 16], out[-16:])], keys))
    return bytes(out)


def strong_hash(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """The 256-bit hash of revisions 5 (one SHA-256) and 6 (rounds of AES and SHA-2 chosen by the data)."""
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = aes_encrypt(k[:16], (password + k + user) * 64, k[16:32], pad=False)[16:]
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    """Decrypts strings and streams after a password has been accepted."""

    def __init__(self, encrypt: dict, file_id: bytes, password: bytes = b""):
        self.v, self.r = encrypt.get("V", 0), encrypt.get("R", 2)
        self.permissions = encrypt.get("P", 0)
        if self.v not in (1, 2, 4, 5) or (self.v == 5 and self.r not in (5, 6)):
            raise PdfError("UnsupportedEncryption", f"V{self.v} R{self.r}")
        self.o, self.u = encrypt.get("O", b"")[:32], encrypt.get("U", b"")
        self.n = 5 if self.r == 2 else int(encrypt.get("Length", 128 if self.v == 4 else 40)) // 8
        self.metadata = encrypt.get("EncryptMetadata", True)
        self.id = file_id
        self.aes = False
        self.identity = False
        if self.v in (4, 5):
            name = encrypt.get("StmF", "Identity")
            method = (encrypt.get("CF") or {}).get(name, {}).get("CFM", "None") if name != "Identity" else "None"
            self.aes, self.identity, self.n = method in ("AESV2", "AESV3"), method == "None", 32 if self.v == 5 else 16
        if self.v == 5:
            self.o = encrypt.get("O", b"")[:48]
            self.key = self._accept_strong(password[:127], encrypt.get("UE", b""), encrypt.get("OE", b""))
        else:
            self.key = self._accept(password)

    def _accept_strong(self, password: bytes, ue: bytes, oe: bytes) -> bytes:
        u = self.u[:48]
        for entry, extra, sealed in ((u, b"", ue), (self.o, u, oe)):
            if hmac.compare_digest(strong_hash(password, entry[32:40], extra, self.r), entry[:32]):
                key, out = _round_keys(strong_hash(password, entry[40:48], extra, self.r)), b""
                last = bytes(16)
                for i in range(0, 32, 16):
                    out += bytes(a ^ b for a, b in zip(_decrypt_block(sealed[i : i + 16], key), last))
                    last = sealed[i : i + 16]
                return out
        raise PdfError("WrongPassword")

    @property
    def algorithm(self) -> str:
        return "AES-256" if self.v == 5 else "AES-128" if self.aes else f"RC4-{self.n * 8}"

    def _derive(self, password: bytes) -> bytes:
        data = (password + PAD)[:32] + self.o + (self.permissions & 0xFFFFFFFF).to_bytes(4, "little") + self.id
        if self.r >= 4 and not self.metadata:
            data += b"\xff\xff\xff\xff"
        key = hashlib.md5(data).digest()
        for _ in range(50 if self.r >= 3 else 0):
            key = hashlib.md5(key[: self.n]).digest()
        return key[: self.n]

    def user_entry(self, key: bytes) -> bytes:
        if self.r == 2:
            return rc4(key, PAD)
        out = rc4(key, hashlib.md5(PAD + self.id).digest())
        for i in range(1, 20):
            out = rc4(bytes(b ^ i for b in key), out)
        return out

    def _owner_to_user(self, password: bytes) -> bytes:
        key = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            key = hashlib.md5(key).digest()
        key, out = key[: self.n], self.o
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            out = rc4(bytes(b ^ i for b in key), out)
        return out

    def _accept(self, password: bytes) -> bytes:
        n = 32 if self.r == 2 else 16
        for candidate in (password, self._owner_to_user(password)):
            key = self._derive(candidate)
            if hmac.compare_digest(self.user_entry(key)[:n], self.u[:n]):
                return key
        raise PdfError("WrongPassword")

    def decrypt(self, data: bytes, num: int, gen: int) -> bytes:
        if self.identity:
            return data
        if self.v == 5:
            return aes_decrypt(self.key, data)
        key = hashlib.md5(self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.aes else b"")).digest()[: min(self.n + 5, 16)]
        return aes_decrypt(key, data) if self.aes else rc4(key, data)
