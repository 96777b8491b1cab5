"""Plain Python versions of the operators, for comparison on small tables."""

import collections
import hashlib
import re

import xxhash


def tokens(text):
    return [w.decode() for w in (text or "").encode().split()]


def line_counts(text):
    words = tokens(text)
    lines = [x for x in (text or "").split("\n") if x.encode().strip(b" \t\n\r\x0b\x0c")]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            cover[i : i + 8] = [True] * 8
    n, rep = len(words), sum(cover)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": rep, "base_failed": n < 20 or 100 * rep > 30 * n,
    }


def simhash(text, shingle=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < shingle else [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    """{id: smallest id reachable} of {id: fingerprint}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(texts, n=100):
    """{id: (n_bytes, kept bytes, n_spans)} of {id: text}: bytes covered by an n-byte string that also starts earlier."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            if s in seen:
                cover[p : p + n] = b"\x01" * n
            seen.add(s)
        spans = sum(1 for p in range(len(b)) if cover[p] and (p == 0 or not cover[p - 1]))
        out[i] = (len(b), bytes(x for x, c in zip(b, cover) if not c), spans)
    return out


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def _line_fails(line):
    import regex

    from tidemark.llm.line_clean import BOILERPLATE

    words = tokens(line)
    n, symbols = len(words), len(re.findall(r"[#*$%&|<>]", line))
    alone = sum(w in set("|>»›·•/") for w in words)
    shout = 1 + len(re.findall(r"[!?]{2,}", line))
    return n > 0 and (
        (re.search(BOILERPLATE, line.lower()) and n <= 40) or (symbols >= 2 and 5 * symbols > n) or (alone >= 2 and 5 * alone > n)
        or ("!!" in line and 10 * shout > 3 * n + 10) or not regex.search(r"[\p{L}\p{N}]", line)
        or (n < 10 and not re.search(r"[.!?…:;\"”»。！？)\]][ \t-\r]*\Z", line))
    )


def cleaned(text):
    """``(clean text, words kept, kept)`` by the line rules, one line after the other."""
    seen, lines = set(), []
    for line in (text or "").split("\n"):
        if _line_fails(line) or (tokens(line) and line in seen):
            continue
        seen.add(line)
        lines.append(line)
    n, left = len(tokens(text)), sum(len(tokens(x)) for x in lines)
    return "\n".join(lines), left, not line_counts(text)["base_failed"] and 100 * left >= 50 * n
