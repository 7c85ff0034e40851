"""Plain Python counterparts of some operators."""

import re
from collections import Counter

import public_tokenizers

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def grams(text, width):
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = [(d, grams(t, width)) for d, t in rows]
    known = [(d, s) for d, s in sets if d is not None and s]
    links = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[k + 1 :]
             if a != b and 100 * len(x & y) >= percent * len(x | y)]
    root = roots_of({d for d, _ in sets if d is not None}, links)
    return Counter((d, len(s), root.get(d)) for d, s in sets)


def brute_pieces(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in rows]
