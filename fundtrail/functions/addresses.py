"""Format verdict for a column of reported bitcoin addresses.

Everything decidable by length, alphabet and prefix is decided by built-in expressions; only
strings that reach a checksum go through one Arrow function, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params

# The base58 and bech32 alphabets, the bech32 generator and its two constants.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
PLAIN, MODIFIED = 1, 0x2BC830A3


#: Size of a decoded address, and bits of a limb of a number in base 256.
RAW, LIMB = 25, 32


def _base58_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(decodable, raw): the 25 bytes of every string that has them; strings of equal length go together.

    A number is a row of limbs, multiplied by 58 and added to one character at a time for all rows. Strings of 25 bytes have 25 to 35
    characters, so seven limbs hold any of them.
    """
    good, raw = np.zeros(len(texts), dtype=bool), np.zeros((len(texts), RAW), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    for size in np.unique(sizes[(sizes >= 25) & (sizes <= 35)]):
        at = np.flatnonzero(sizes == size)
        codes = "".join(texts[i] for i in at).encode("latin-1", "replace")
        digits = DIGIT58[np.frombuffer(codes, dtype=np.uint8)].reshape(len(at), size)
        number = np.zeros((len(at), 7), dtype=np.uint64)  # lowest limb first
        for column in np.maximum(digits, 0).T:
            carry = column.astype(np.uint64)
            for i in range(7):
                v = number[:, i] * np.uint64(58) + carry
                number[:, i], carry = v & np.uint64((1 << LIMB) - 1), v >> np.uint64(LIMB)
        whole = np.ascontiguousarray(number[:, ::-1]).astype(">u4").view(np.uint8)
        length = whole.shape[1] - (np.append(whole, np.ones((len(at), 1), np.uint8), axis=1) != 0).argmax(axis=1)
        zeros = (np.append(digits, np.ones((len(at), 1), digits.dtype), axis=1) != 0).argmax(axis=1)
        good[at] = (digits >= 0).all(axis=1) & (zeros + length == RAW)
        raw[at] = whole[:, -RAW:]
    return good, raw


def _base58_verdict(raw: Column) -> Column:
    """Verdict of 25 bytes: the last four are the head of the double hash of the others."""
    once = F.unhex(F.sha2(F.substring(raw, 1, RAW - 4), 256))
    version = F.hex(F.substring(raw, 1, 1))
    return (
        F.when(F.upper(F.substring(F.sha2(once, 256), 1, 8)) != F.hex(F.substring(raw, RAW - 3, 4)), "bad-checksum")
        .when(version == "00", "p2pkh").when(version == "05", "p2sh").otherwise("wrong-network")
    )


# What each value of the top five bits folds back into the running checksum.
FOLD = np.array(
    [np.bitwise_xor.reduce([g for i, g in enumerate(GENERATOR) if top >> i & 1] or [0]) for top in range(32)],
    dtype=np.int64,
)
DIGIT = np.full(128, -1, dtype=np.int64)
DIGIT[[ord(c) for c in BECH32]] = range(32)


def _checksums(words: np.ndarray) -> np.ndarray:
    """Bech32 checksum of every row of five-bit words, one column step at a time."""
    check = np.ones(len(words), dtype=np.int64)
    for column in words.T:
        check = ((check & 0x1FFFFFF) << 5) ^ column ^ FOLD[check >> 25]
    return check


DIGIT58 = np.full(256, -1, dtype=np.int64)
DIGIT58[[ord(c) for c in BASE58]] = range(58)


def _bech32_batch(texts: pd.Series) -> tuple[pd.Series, pd.Index]:
    """Verdicts of segwit-looking strings, and those that are none after all; rows of equal length and separator go together."""
    low = texts.str.lower()
    out = pd.Series("malformed", index=texts.index, dtype=object)
    other = [texts.index[:0]]
    sized = ((texts == low) | (texts == texts.str.upper())) & (texts.str.len() <= 90)
    mark = low.str.rfind("1")
    for (size, at), group in low[sized].groupby([low.str.len(), mark]):
        # A data part too short for its checksum counts as a checksum failure.
        if size - at - 1 < 6:
            out[group.index] = "bad-checksum"
            continue
        codes = np.frombuffer("".join(group).encode(), dtype=np.uint8).reshape(len(group), size).astype(np.int64)
        prefix, digits = codes[:, :at], DIGIT[codes[:, at + 1:]]
        clean = (digits >= 0).all(axis=1)
        words = np.hstack([prefix >> 5, np.zeros((len(group), 1), np.int64), prefix & 31, digits])
        check = _checksums(words)
        summed = (check == PLAIN) | (check == MODIFIED)
        out[group.index] = np.where(summed, _programs(prefix, digits, check), "bad-checksum")
        out[group.index[~clean]] = "malformed"
        other.append(group.index[~clean])
    return out, other[0].append(other[1:])


def _programs(prefix: np.ndarray, digits: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Verdicts of witness programs of one length under right checksums: version, payload in five-bit digits, six digits of checksum."""
    size, spare = divmod(5 * (digits.shape[1] - 7), 8)
    if digits.shape[1] < 7 or spare > 4 or not 2 <= size <= 40:
        return np.full(len(digits), "malformed", dtype=object)
    version = digits[:, 0]
    bad = (version > 16) | ((check == PLAIN) != (version == 0)) | (digits[:, -7] & ((1 << spare) - 1) != 0)
    if size not in (20, 32):
        bad |= version == 0
    main = (prefix == np.frombuffer(b"bc", dtype=np.uint8)).all(axis=1) if prefix.shape[1] == 2 else np.zeros(len(digits), dtype=bool)
    kind = np.where(version > 0, "witness-v1-plus", "p2wpkh" if size == 20 else "p2wsh")
    return np.select([bad, ~main], ["malformed", "wrong-network"], kind).astype(object)


@F.pandas_udf(T.StructType([T.StructField("verdict", T.StringType()), T.StructField("raw", T.BinaryType())]))
def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The verdict of a segwit string, or the bytes of a base58 one, whose hashes are left to built-in functions."""
    segwit = ("bc1", "tb1", "bcrt1")
    for batch in batches:
        batch = batch.reset_index(drop=True)
        verdict, raw = pd.Series(None, index=batch.index, dtype=object), pd.Series(None, index=batch.index, dtype=object)
        known = batch.notna()
        wit = known & batch.str.lower().str.startswith(segwit, na=False)
        judged, other = _bech32_batch(batch[wit])
        verdict[wit] = judged
        rest = batch.index[known & ~wit].append(other)
        good, data = _base58_batch(batch[rest].tolist())
        verdict[rest] = np.where(good, None, "malformed")
        data = data[good].tobytes()
        raw[rest[good]] = [data[i : i + RAW] for i in range(0, len(data), RAW)]
        yield pd.DataFrame({"verdict": verdict, "raw": raw})


KINDS = ("p2pkh", "p2sh", "p2wpkh", "p2wsh", "witness-v1-plus")


def guard_verdict(text: Column, max_length: int) -> Column:
    """Reason found without decoding, else null."""
    return (
        F.when(text.isNull(), "malformed")
        .when(text == "", "empty")
        .when(F.length(text) > max_length, "too-long")
        .when(~text.rlike(r"^[\x21-\x7e]+$"), "non-ascii-or-whitespace")
        # 25 bytes in base58 take 25 to 35 characters of its alphabet.
        .when(~text.rlike("^(?i)(bc1|tb1|bcrt1)") & ~text.rlike(f"^[{BASE58}]{{25,35}}$"), "malformed")
    )


def address_quality(df: DataFrame, column: str = "address", params: Params = Params()) -> DataFrame:
    """Add ``valid``, ``kind`` (valid addresses) and ``reason`` (all others)."""
    text = F.regexp_replace(F.col(column).cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    guarded = df.withColumn("_text", text).withColumn("_guard", guard_verdict(F.col("_text"), params.address_max_length))
    decoded = guarded.withColumn("_decoded", decode(F.when(F.col("_guard").isNull(), F.col("_text"))))
    summed = F.when(F.col("_decoded.raw").isNotNull(), _base58_verdict(F.col("_decoded.raw")))
    judged = decoded.withColumn("_verdict", F.coalesce("_guard", summed, "_decoded.verdict"))
    valid = F.col("_verdict").isin(*KINDS)
    return judged.withColumns(
        {"valid": valid, "kind": F.when(valid, F.col("_verdict")), "reason": F.when(~valid, F.col("_verdict"))}
    ).drop("_text", "_guard", "_decoded", "_verdict")


def quality_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("valid", "kind", "reason").agg(F.count("*").alias("addresses"))
