"""Arrow-batched functions for what Spark has no expression for: inflate, keyed hashes, block cipher."""

from __future__ import annotations

import hashlib
import hmac
import os
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a block's payload is stored.
ZLIB, RAW = 0x01, 0xFF


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.compress(b))


@F.pandas_udf(T.BinaryType())
def payload(data: pd.Series, kind: pd.Series) -> pd.Series:
    """The uncompressed payload; null where it can't be inflated.  Unknown kinds raise ValueError."""

    def one(b, k):
        if b is None:
            return None
        if k == RAW:
            return b
        if k != ZLIB:
            raise ValueError(f"unknown data type {k}")
        try:
            return zlib.decompress(b)
        except zlib.error:
            return None

    return pd.Series([one(b, k) for b, k in zip(data, kind)], dtype=object)


def keyed_hash(key: bytes, data: bytes, depth: int = 1) -> bytes:
    """HMAC-MD5 under a 16-byte key (shorter ones are padded with zeros), its output hashed again depth times."""
    key = key.ljust(16, b"\0")[:16]
    for _ in range(depth):
        data = hmac.new(key, data, hashlib.md5).digest()
    return data


# Rounds and suffixes of key derivation.
KEY_ROUNDS, ACCESS_PAD, BACKUP_PAD = 20_000, b"*ACCESS*KEY*PAD*", b"*ENCRYPTION*PAD*"


def _derived(account: str, password: str, pad: bytes) -> bytes:
    return keyed_hash(hashlib.md5(password.encode("utf-8")).digest(), account.encode("utf-8") + pad, KEY_ROUNDS)


def access_key(account: str, password: str) -> bytes:
    """The key that a client proves to know; the server stores it."""
    return _derived(account, password, ACCESS_PAD)


def backup_key(account: str, password: str) -> bytes:
    """The key under which the data key is kept; only the client can make it."""
    return _derived(account, password, BACKUP_PAD)


def data_key() -> bytes:
    """A random data key."""
    return os.urandom(16)


def session_key(account: str, nonce: bytes, key: bytes) -> bytes:
    """The key of one session, from the account's hash, the server's nonce and the access key."""
    return keyed_hash(key, hashlib.md5(account.encode("utf-8")).digest() + nonce, KEY_ROUNDS)


def keyed_hash_udf(key: bytes, depth: int = 1):
    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else keyed_hash(key, bytes(b), depth))

    return run


def encrypt_block(data, key, iv):
    """One 16-byte block under AES-128-CBC without padding, from Spark's padded cipher."""
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), 17, 16)


def decrypt_block(data, key, iv):
    """Inverse of encrypt_block.

    A second block that deciphers to a full block of padding is made by encrypting the padding under
    the first cipher block, so that the padded cipher accepts the two.
    """
    pad = F.lit(bytes([16]) * 16)
    tail = F.substring(F.aes_encrypt(pad, key, F.lit("CBC"), F.lit("PKCS"), data), 17, 16)
    return F.aes_decrypt(F.concat(iv, data, tail), key, F.lit("CBC"), F.lit("PKCS"))
