"""Plain-loop counterpart of the fingerprint query; the hashes are XXH64 with the seed that Spark uses."""

import hashlib
import re
import struct

import xxhash

from orograph.llm.fingerprints import K, S, SIZE, UNIT


def h(*values) -> int:
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def anchors(text: str | None) -> list[tuple[int, int]]:
    units = [h(u) for u in re.findall(r"[^ \t\n\x0b\f\r]{1,%d}" % UNIT, text or "")]
    if len(units) < K:
        total = 0
        for u in units:
            total = h(total, u)
        return [(total, 0)] if units else []
    out = []
    for i in range(len(units) - K + 1):
        inner = [h(*units[i + j:i + j + S]) for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((h(*units[i:i + K]), i))
    return out


def codes(text: str | None) -> list[int]:
    return sorted({(a % (1 << 64)) >> 32 for a, _ in anchors(text)})[:SIZE]


def like(a: list[int], b: list[int]) -> float:
    both = sorted({*a, *b})[:SIZE]
    if not both:
        return 1.0
    j = len({*a} & {*b} & {*both}) / len(both)
    return 2 * j / (1 + j)


def report(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """Rows by id; ids are distinct."""
    docs, out = [(i, t or "") for i, t in sorted(docs)], []
    for k, (i, text) in enumerate(docs):
        follows = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follows[:half]
        a, b = codes(text), codes(edited)
        hexes = ["".join(f"{c:08x}" for c in x) for x in (a, b)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexes, like(a, b), like(a, codes(follows))))
    return out
