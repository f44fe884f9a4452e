"""Plain single-machine versions of the operators, to hold them against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(texts: list[str | None], tokenizer_file: str) -> list[list[int]]:
    t = tokenizer(tokenizer_file)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def op1(docs: list[tuple], tokenizer_file: str) -> list[tuple]:
    docs = sorted(docs)
    out, at = [], 0
    for (doc_id, _), ids in zip(docs, token_ids([t for _, t in docs], tokenizer_file)):
        ids = [*ids, 1]
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def op2(docs: list[tuple], window: int = 35) -> list[tuple]:
    all_words = [words_of(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, all_words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op3_fingerprint(text: str | None) -> int:
    w = words_of((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op3(docs: list[tuple]) -> list[tuple]:
    prints = np.array([op3_fingerprint(t) for _, t in docs], dtype=np.uint64)
    component = components(prints)
    ids = [d for d, _ in docs]
    least: dict[int, int] = {}
    for i, c in enumerate(component):
        least[c] = min(least.get(c, ids[i]), ids[i])
    return [(ids[i], f"{int(prints[i]):016x}", least[component[i]]) for i in range(len(docs))]


def components(prints: np.ndarray, bits: int = 3) -> list[int]:
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits) + i + 1:
            parent[root(int(j))] = root(i)
    return [root(i) for i in range(len(prints))]


def op5(docs: list[tuple], window: int = 400) -> list[tuple]:
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(hash(d[i : i + window]) for d in data for i in range(len(d) - window + 1))
    out = []
    for (doc_id, _), d in zip(docs, data):
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - window + 1):
            if seen[hash(d[i : i + window])] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def op6_base(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def op6(docs: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in docs:
        base = op6_base(text)
        n = Counter(k for _, _, k in base)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        out.append((doc_id, n["assign"], n["access"], n["hex"], digest))
    return out


def op8_base(text: str | None) -> tuple:
    text = text or ""
    w = words_of(text)
    triples = Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if triples[w[i], w[i + 1], w[i + 2]] > 1:
            hit[i : i + 3] = [True] * 3
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in lines
            lines.add(line)
    repeat = sum(hit)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def edit_distance_within(pattern: str, text: str) -> int:
    """Least edits that turn ``pattern`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
