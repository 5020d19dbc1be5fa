"""Published address vectors, and bad addresses built here by breaking one thing of a good one."""

import hashlib
import random

from fundtrail.functions.addresses import BASE58, BECH32, address_quality, quality_counts

# Segwit vectors of BIP-173 and BIP-350, and the address of the first block.
VALID = [
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "p2pkh"),
    ("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", "p2wpkh"),
    ("bc1pw508d6qejxtdg4y5r3zarvary0c5xw7kw508d6qejxtdg4y5r3zarvary0c5xw7kt5nd6y", "witness-v1-plus"),
    ("BC1SW50QGDZ25J", "witness-v1-plus"),
    ("bc1zw508d6qejxtdg4y5r3zarvaryvaxxpcs", "witness-v1-plus"),
    ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "witness-v1-plus"),
]
WITNESS_V0 = VALID[1][0].lower()
TEST_NETWORK = "tb1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3q0sl5k7"


def base58(version, payload):
    """Base58 with checksum, as any wallet writes it."""
    raw = bytes([version]) + payload
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    number, out = int.from_bytes(raw, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        out = BASE58[digit] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def payloads(n, size=20):
    rng = random.Random(n)
    return [rng.randbytes(size) for _ in range(n)]


GOOD = [(base58(v, p), kind) for p in payloads(15) for v, kind in ((0, "p2pkh"), (5, "p2sh"))]
BROKEN = (
    [(a[:-1] + BASE58[BASE58.index(a[-1]) - 1], "bad-checksum") for a, _ in GOOD]
    + [(base58(v, p), "wrong-network") for p in payloads(6) for v in (111, 196)]
    + [(base58(0, p), "malformed") for size in (15, 19, 21) for p in payloads(3, size)]
    + [(a[:8] + c + a[9:], "malformed") for (a, _), c in zip(GOOD, "0OIl", strict=False)]
    + [(a[:8] + c + a[8:], "non-ascii-or-whitespace") for (a, _), c in zip(GOOD, (" ", "\u00e9", "\n"), strict=False)]
    + [(WITNESS_V0[:9] + WITNESS_V0[9:].upper(), "malformed"), (TEST_NETWORK, "wrong-network"), (WITNESS_V0 + "q" * 90, "too-long")]
    + [("", "empty"), (" \t ", "empty"), (None, "malformed"), ("9" * 24, "malformed")]
)


def judge(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, address string")
    return {r["i"]: r for r in address_quality(df).collect()}


def test_vectors(spark):
    good = VALID + GOOD + [(f"  {GOOD[0][0]}\n", GOOD[0][1])]
    rows = judge(spark, [t for t, _ in good + BROKEN])
    for i, (text, expected) in enumerate(good + BROKEN):
        row = rows[i]
        assert (row["kind"] if i < len(good) else row["reason"]) == expected, text
        assert row["valid"] == (i < len(good))


def test_any_single_change_breaks_a_segwit_address(spark):
    base, rng = WITNESS_V0, random.Random(1)
    changed = []
    for _ in range(60):
        at = rng.randrange(4, len(base))
        changed.append(base[:at] + rng.choice([c for c in BECH32 if c != base[at]]) + base[at + 1:])
    assert {r["reason"] for r in judge(spark, changed).values()} == {"bad-checksum"}


def test_counts(spark):
    df = spark.createDataFrame([(t,) for t, _ in VALID] + [("",)], "address string")
    counts = {(r["valid"], r["kind"], r["reason"]): r["addresses"] for r in quality_counts(address_quality(df)).collect()}
    assert counts[(False, None, "empty")] == 1 and sum(counts.values()) == len(VALID) + 1
