"""Brute-force versions of the operators, straight from their definitions."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from haulcube.llm.common import NULL_ID

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def line_dedup(rows, min_words=5):
    """Removed lines by definition, comparing every pair of lines."""
    lines = []
    for r, (i, t) in enumerate(rows):
        for no, line in enumerate((t or "").split("\n")):
            if t is not None:
                lines.append((NULL_ID if i is None else i, r, no, line, line.encode().split()))
    out = {r: (i, None if t is None else [], 0, 0) for r, (i, t) in enumerate(rows)}
    for key, r, no, line, w in lines:
        i, kept, n, gone = out[r]
        drop = False
        for key2, r2, no2, _, w2 in lines:
            if w and w2 and (key2 < key or r2 == r and no2 < no):
                if w == w2 or min(len(w), len(w2)) >= min_words and slow_distance(w, w2) <= 1:
                    drop = True
                    break
        if not drop:
            kept.append(line)
        out[r] = (i, kept, n + bool(w), gone + drop)
    return sorted(((i, None if k is None else "\n".join(k), n, g) for i, k, n, g in out.values()), key=str)


def slow_distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows, d=2):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= d:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(w))
    return k, {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def contaminated(docs, items, threshold=0.8):
    held = {}
    out = set()
    for item, text in items:
        k, want = shingles(text)
        if not want:
            continue
        for i, t in docs:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            held.setdefault((i, item), set()).update({" ".join(w[a:a + k]) for a in range(len(w) - k + 1)} & want)
        for i, _ in docs:
            n = len(held[i, item])
            if i is not None and n >= threshold * len(want):
                out.add((i, item, len(want), n, n / len(want)))
    return sorted(out)


def verify_packing(docs, rows, length):
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])] += 1
    seqs = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        seqs[r.sequence_id].append(r)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sorted(seqs) == list(range(-(-total // length)))
    for s, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_tokens == (length if s < max(seqs) else total - length * max(seqs))
        assert pieces[0].padded_length == (at if at & (at - 1) == 0 else length)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for i, pieces in by_id.items():
        texts = [ids for (k, ids), n in want.items() if k == i for _ in range(n)]
        if len(texts) == 1:
            pieces.sort(key=lambda r: r.start)
            joined = np.frombuffer(b"".join(r.ids for r in pieces), "<u4")
            assert tuple(joined) == texts[0] and all(r.doc_tokens == len(texts[0]) for r in pieces)
        else:
            assert sum(r.length for r in pieces) == sum(map(len, texts))
    return rows
