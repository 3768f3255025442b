"""Plain versions of the contracts, and a table with every awkward case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, part bigint, s int, fp string, th string, n bigint, matches string"


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = para(120)
    line = "This Line Stands In Many Documents, all right"
    out = [None, "", " \n\t ", "one", "a b", "\n\n", "x" * 5000, para(300) + "\n" + para(10)]
    out += [out[7]] * 3  # exact copies
    words = out[7].split(" ")
    for k in (5, 60, 150):  # near copies
        out.append(" ".join(w if i != k else "changed" for i, w in enumerate(words)))
    out += [f"{para(30)} {shared} {para(20)}", f"{para(8)}\n{shared}\n{para(9)} Äé ß", f"{shared}{para(3)}"]
    out += [f"{line}\n{para(5)}\n  {line.upper()} \n{para(3)}" for _ in range(5)] + [line]
    out += ["Mail a.b+c@ex-ample.co.uk, or x@y.z+q@w.v now; ip 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112; call +49 (30) 123-4567 or +1", "IBAN DE89 3704 0044 0532 0130 00 of the account; SSN 123-45-6789"]
    out += ["repeat me now " * 40, "### *** $$$ " * 30, "word " * 49, "word " * 50 + "\nAA\nAA\n \n"]
    out += ["Ünïcode ÀÉ wörds " + para(60), para(4000)]
    return out


def rows():
    t = texts()
    ids = list(range(10, 10 + len(t)))
    out = [(i, x, "en", f"s{i % 3}", len(x or ""), "k", 1, 2, "f", "t", 3, "m") for i, x in zip(ids, t, strict=True)]
    return [*out, out[7], (None, "no id " + (t[7] or ""), None, None, None, None, None, None, None, None, None, None)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if x]
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(fps, radius=2):
    """Smallest index reachable, for each."""
    n = len(fps)
    comp = list(range(n))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lines(docs):
    key = lambda x: lower(re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x))
    holders = collections.defaultdict(set)  # documents are told apart by their ids
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20 and d is not None:
                holders[k].add(d)
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if not (len(h := holders.get(key(x), ())) >= 3 and max(h) != d)]
        out.append((d, len(all_lines), len(all_lines) - len(stay), sha("\n".join(stay))))
    return out


def luhn(s):
    t = 0
    for k, c in enumerate(reversed(s)):
        v = int(c) * (2 if k % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
}


def private(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in KINDS.items() for m in re.finditer(p, text or "") if ok(m.group())]


def stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[a : a + n])].add(k)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if x := wins.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def repeats(docs, length=400):
    data = [(d, (t or "").encode()) for d, t in docs]
    c = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if c[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), spans, sha(kept)))
    return out


def passages(docs, size=250, words=50):
    """Runs of more than 50 whole words in bytes that stand elsewhere in strings of 250."""
    data = [(d, (t or "").encode()) for d, t in docs]
    c = collections.Counter(b[p : p + size] for _, b in data for p in range(len(b) - size + 1))
    out = []
    for d, b in data:
        again = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - size + 1):
            if c[b[p : p + size]] > 1:
                again[p + 1 : p + size + 1] = True
        edges = np.flatnonzero(again[1:] != again[:-1]).tolist()
        n = sum(sum(s <= m.start() and m.end() <= e for m in re.finditer(rb"[^ \t-\r]+", b)) > words for s, e in zip(edges[::2], edges[1::2], strict=True))
        out.append((d, n))
    return out


def pieces(docs, path, cap=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = []
    for d, x in docs:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(d, k, s, len(ids[s : s + cap]), zlib.crc32(ids[s : s + cap].tobytes())) for k, s in enumerate(range(0, len(ids), cap))]
    return out
