"""Plain versions of the operators, for small tables."""

import functools
import hashlib
import unicodedata
import re

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(a), root(i)) for i, a in sets}


def repeats(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}"""
    seen, out = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if seen.setdefault(raw[k : k + 100], (i, k)) != (i, k):
                gone[k : k + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


@functools.lru_cache(maxsize=4096)
def template_words(text, names=True):
    """[(template word, value)] of a text, read character by character; a word that is no placeholder is its own value."""
    from lodestack.llm import template_decontamination as t

    text = "".join(" " if c in t.NUMBER + t.UNIT + t.NAME else c for c in text)
    units, out, at = set(t.UNITS), [], 0
    letter = lambda k: 0 <= k < len(text) and unicodedata.category(text[k])[0] == "L"
    number = lambda k: 0 <= k < len(text) and unicodedata.category(text[k])[0] == "N"
    digit = lambda k: 0 <= k < len(text) and text[k] in "0123456789"
    while at < len(text):
        if digit(at):
            stop = at
            while digit(stop) or stop < len(text) and text[stop] in ".,":
                stop += 1
            while not digit(stop - 1):
                stop -= 1
            out.append((t.NUMBER, text[at:stop]))
            gaps = [0, 1] if text[stop : stop + 1] == "-" else [k for k in range(5) if text[stop : stop + k].isspace() or not k]
            for gap in reversed(gaps):
                end = stop + gap
                while letter(end):
                    end += 1
                if text[stop + gap : end].lower() in units and not number(end):
                    out.append((t.UNIT, text[stop + gap : end].lower()))
                    stop = end
                    break
            at = stop
        elif letter(at):
            stop = at
            while letter(stop):
                stop += 1
            word = text[at:stop]
            kinds = [unicodedata.category(c) for c in word]
            alone = not number(at - 1) and not number(stop)
            name = names and alone and len(word) > 1 and kinds[0] == "Lu" and set(kinds[1:]) == {"Ll"}
            out.append((t.NAME if name else word.lower(), word.lower()))
            at = stop
        else:
            at += 1
    return out


def holds(doc, item, size=8, coverage=0.3, least=4):
    """Whether a document holds an item of a benchmark in one of its readings: enough windows, and a sound alignment."""
    plain, named = template_words(item or "", False), template_words(item or "")
    if 0 < len(plain) < least:
        own = template_words(doc or "", False)
        return len(own) == len(plain) and reads(own, plain, size, coverage)
    d = template_words(doc or "")
    return bool(plain) and (reads(d, plain, size, coverage) or named != plain and reads(d, named, size, coverage))


def reads(d, q, size, coverage):
    n = min(size, len(q))
    at = {}
    for k in range(len(d) - n + 1):
        at.setdefault(tuple(w for w, _ in d[k : k + n]), []).append(k)
    own = {k: tuple(w for w, _ in q[k : k + n]) for k in range(len(q) - n + 1)}
    total = len(set(own.values()))
    met = {}
    for k, w in own.items():
        for place in at.get(w, []):
            met.setdefault(place - k, []).append(k)
    if len({own[k] for ks in met.values() for k in ks}) / total < coverage:
        return False
    mark = lambda x: ord(x[0][0]) >= 0xE000 and len(x[0]) == 1
    if not any(mark(x) for x in q):
        return True
    enough = [s for s, ks in met.items() if len({own[k] for k in ks}) / total >= coverage] or list(met)
    for shift in enough:
        inside = sorted({k + j for k in met[shift] for j in range(n)})
        values = {}
        for k in inside:
            if mark(q[k]):
                values.setdefault(q[k], set()).add(d[k + shift][1])
        marks = sum(mark(q[k]) for k in inside)
        same = all(v == {q_[1]} for q_, v in values.items())
        if all(len(v) == 1 for v in values.values()) and (same or len(inside) - marks >= marks):
            return True
    return False
