"""Plain versions of the operators, and documents with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, n_words string, kept int, k1 double, id string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_rows(words=900, seed=3):
    """Nulls, empty and blank texts, short and very long ones, copies, near copies, shared passages, repeated rows."""
    pick = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ab é ü xyz QR s t".split() for b in range(40)]
    text = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(50)
    near = base.split()
    near[7] = "changed"
    rows = [(1, base), (2, base.upper().replace(" ", "\n")), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"),
            (None, text(20)), (10, text(60)), (10, text(60)), (11, base), (12, f"{text(30)} {passage} {text(10)}"), (13, f"{passage}\n{text(40)}"),
            (14, text(words * 40)), (15, "a b c"), (16, "a  b\x0bc"), (17, "x " * 200), (18, "naïve 中文 ▁ <|x|>   it's")]
    rows += [(19, text(70))] * 3
    return [(k, t, "clash", 1, 0.5, "clash") for k, t in rows]


def shingles(text, n):
    words = PLAIN.findall(lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def groups(rows, n=4, percent=80):
    """Per row: set size and the smallest id of its group."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)].append(k)
    return [(len(s), min(low[find(i)], default=None) if s else rows[i][0], find(i)) for i, s in enumerate(sets)]


def without_repeats(rows, window=35):
    """Per row: words, removed words and the text kept."""
    words = [PLAIN.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def hits(text, items, width=13):
    """Words, hit words and ids of the items found."""
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = ALNUM.findall(lower(item_text))
        size = min(width, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if windows and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def katz(rows, estimate, held, top=5, beyond=0.5):
    """Per row: held out, tokens, known tokens, training tokens, base score and score."""
    tokens = [PLAIN.findall(lower(t)) + ["\n"] for _, t in rows]
    trained = [t for t, h in zip(tokens, held) if not h]
    pairs_of = lambda t: list(zip(["\0"] + t[:-1], t))
    words, pairs = Counter(w for t in trained for w in t), Counter(p for t in trained for p in pairs_of(t))
    n, total = sum(words.values()), sum(words.values()) + len(words) + 1
    of_counts = Counter(pairs.values())
    star = estimate([0] + [of_counts[i] for i in range(1, top + 2)] + [0])
    less = lambda c: star[c - 1] if c <= top else c - beyond
    single = lambda w: (words[w] + 1) / total
    contexts = defaultdict(dict)
    for (v, w), c in pairs.items():
        contexts[v][w] = c
    weight = {v: (1 - sum(map(less, d.values())) / sum(d.values())) / (1 - sum(map(single, d))) for v, d in contexts.items()}
    mass = {v: sum(less(c) for c in d.values()) / sum(d.values()) + weight[v] * (1 - sum(map(single, d))) for v, d in contexts.items()}
    assert all(abs(m - 1) < 1e-9 for m in mass.values())
    out = []
    for t, h in zip(tokens, held):
        score = 0.0
        for v, w in pairs_of(t):
            c = pairs[v, w]
            score += math.log10(less(c) / sum(contexts[v].values())) if c else math.log10(weight.get(v, 1.0) * single(w))
        out.append((h, len(t), sum(words[w] > 0 for w in t), n, sum(math.log10(single(w)) for w in t), score))
    return out


def katz_of_order(rows, estimate, held, order, top=5, beyond=0.5):
    """Per row: tokens, base score and score, by the recursion token by token."""
    tokens = [PLAIN.findall(lower(t)) + ["\n"] for _, t in rows]
    padded = [["\0"] * (order - 1) + t for t in tokens]
    grams = lambda t, k: [tuple(t[i - k + 1 : i + 1]) for i in range(order - 1, len(t))]
    counts = {k: Counter(g for t, h in zip(padded, held) if not h for g in grams(t, k)) for k in range(1, order + 1)}
    total = sum(counts[1].values()) + len(counts[1]) + 1
    star, behind = {}, defaultdict(dict)
    for k in range(2, order + 1):
        of_counts = Counter(counts[k].values())
        star[k] = estimate([0] + [of_counts[i] for i in range(1, top + 2)] + [0])
        for g, c in counts[k].items():
            behind[g[:-1]][g[-1]] = c
    less = lambda c, k: star[k][c - 1] if c <= top else c - beyond
    weights = {}

    def p(w, h):
        if not h:
            return (counts[1][(w,)] + 1) / total
        own = behind.get(h)
        if own is None:
            return p(w, h[1:])
        if w in own:
            return less(own[w], len(h) + 1) / sum(own.values())
        if h not in weights:
            weights[h] = (1 - sum(p(x, h) for x in own)) / (1 - sum(p(x, h[1:]) for x in own))
        return weights[h] * p(w, h[1:])

    every = [x for (x,) in counts[1]]
    for h in list(behind)[::97]:  # with the mass of unknown words each context sums to one
        assert abs(sum(p(w, h) for w in [*every, "\1"]) - 1) < 1e-9
    return [(len(t), sum(math.log10(p(w, ())) for w in t), sum(math.log10(p(g[-1], g[:-1])) for g in grams(q, order))) for t, q in zip(tokens, padded)]


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


def tokens_of_both(path_a, path_b):
    """Ids and bytes of a text's tokens by both tokenizers, from the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(0x100, 0x200))
    byte_of = {chr(i) if i in printable else chr(next(odd)): i for i in range(256)}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a" and byte_of["Ġ"] == 32

    def encode(text):
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        same = text and b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        return (left, right) if same else ([], [])

    return encode


def alignments(rows, encode):
    """Per row what the alignment query returns, and documents and links of every pair."""

    def spans(tokens):
        at = 0
        for i, raw in tokens:
            yield i, at, at + len(raw)
            at += len(raw)

    found, docs, links = [], Counter(), Counter()
    for _, text in rows:
        left, right = (list(spans(t)) for t in encode(text or ""))
        both = [(i, j) for i, s, e in left for j, u, v in right if max(s, u) < min(e, v)] if len(left) < 300 else None
        if both is None:  # the same by two pointers, for long texts
            both, low = [], 0
            for i, s, e in left:
                while right[low][2] <= s:
                    low += 1
                k = low
                while k < len(right) and right[k][1] < e:
                    both.append((i, right[k][0]))
                    k += 1
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, x, y = [], 0, 0
        for cut in cuts:
            a, b = [], []
            while x < len(left) and left[x][2] <= cut:
                a.append(str(left[x][0]))
                x += 1
            while y < len(right) and right[y][2] <= cut:
                b.append(str(right[y][0]))
                y += 1
            groups.append(f"{','.join(a)}|{','.join(b)}")
        found.append((len(left), len(right), groups, both))
        docs.update(set(both))
        links.update(both)
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    rows = [(a, b, len(groups), len(both), sum(docs[p] == best[p[0]] for p in both), sum(docs[p] for p in both),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for a, b, groups, both in found]
    return rows, {p: (docs[p], links[p]) for p in docs}
